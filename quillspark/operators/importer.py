"""HTML pages to block markup by the roles of their nodes.

One pass goes over the node tree in document order.  ``RULES`` is the ordered table of roles: the first
rule whose test fits a node turns it, and the siblings that belong to it, into blocks.  A wrapper that no
rule knows is entered, never dropped.  Notes are harvested before, so markers in the text can point at
their numbers; headings, verse, music, quotations, lists, threads and signatures keep their forms.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import functions as F, types as T

from quillspark.operators.edits import tree

BREAK = "\0"
#: Calls that one level of nodes may take, at most.
FRAMES = 12

# Class names and tags by role (fixed values).
NO_TEXT = {"script", "style", "head", "title", "noscript", "template"}
CHROME_TAGS = {"header", "nav", "footer", "h1", "hr", "button", "form", "iframe", "svg", "audio", "video", "canvas"} | NO_TEXT
CHROME = {"crumbs", "breadcrumbs", "byline", "colophon", "license", "attribution", "pager", "prevnext", "divider", "ornament", "skip", "epi-label", "epigraph-label"}
INLINE = {"a", "em", "i", "b", "strong", "span", "sup", "sub", "small", "u", "s", "code", "mark", "cite", "abbr", "br", "wbr", "time", "#text"}
NOTE_REF, POPUP = {"fnref", "fn-ref", "noteref", "note-ref", "fnmark"}, {"pop", "fn-pop", "fn-preview", "tooltip"}
NOTE_BOX, NOTE_ITEM, NOTE_ANON = {"notes", "footnotes", "references"}, {"note", "footnote", "fn"}, {"note-anon", "fn-anon"}
NOTE_MARK, NOTE_BACK, NOTE_BODY = {"num", "marker"}, {"back", "backref", "upref"}, {"fn-body", "fn-text", "note-body"}
CITE = {"cite", "epi-cite", "epi-source", "author", "src"}
EPIGRAPH, DEDICATION, CODA = {"epi", "epigraph"}, {"dedication"}, {"coda"}
CRY, SIGNED = {"closing", "banner", "shout", "call", "resume"}, {"sign", "signature", "signoff", "signed"}
DATED, TAGGED, SEE_ALSO = {"dateline", "secmeta", "date"}, {"tags", "tag"}, {"seealso", "see-also"}
DECK, SUBTITLE, POEM_TITLE = {"sec-sub", "deck", "standfirst"}, {"subtitle", "article-subtitle"}, {"poemsub", "poem-sub", "poemtitle"}
STANZA, VERSE, VERSE_LINE = {"stanza", "st"}, {"verse", "poem"}, {"line", "ln", "verse-line"}
TRACK, MUSIC_LABEL = {"track", "player"}, {"music-label", "mus-label", "lbl"}
TRACK_TITLE, TRACK_AUTHOR = {"t-name", "track-title", "song-title", "t-title"}, {"t-author", "artist", "track-artist", "by"}
QUOTE_LABEL, DIALOG = {"qlabel", "q-label", "quote-label"}, {"q", "a", "qa", "dialog", "dialogue", "question", "answer", "speaker", "replica"}
SPEAKER = DIALOG | {"who", "poster", "answer-head", "reply-label"}
HANGING = {"n", "num", "pnum", "num-h", "para-num"}
STOP_TAGS = {"h1", "h2", "h3", "h4", "ul", "ol", "details", "table", "section"}
RICH = {"blockquote", "h2", "h3", "table", "ol", "ul", "details"}
DATE = re.compile(r"(?i)\d{1,2}\s+[а-яё]+\s+\d{4}|\d{4}[/.\-]\d{2}[/.\-]\d{2}|\d{2}[.\-/]\d{2}[.\-/]\d{2,4}")
LABELS = {"эпиграф", "эпиграфы"}
ALSO = re.compile(r"(?i)^см\.?\s*также\s*:?\s*")
VIDEO = re.compile(r"(?:v=|youtu\.be/|embed/)([A-Za-z0-9_-]{11})")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str]
    said: str = ""
    kids: list[Node] = field(default_factory=list)
    up: Node | None = None

    def __post_init__(self):
        self.names = set(self.attrs.get("class", "").split())

    def below(self) -> Iterator[Node]:
        todo = self.kids[::-1]
        while todo:
            k = todo.pop()
            yield k
            if k.kids:
                todo += k.kids[::-1]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next(filter(test, self.below()), None)

    def raw(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.tag == "#text":
                out.append(n.said)
            elif n.tag not in NO_TEXT:
                todo += n.kids[::-1]
        return "".join(out)

    def plain(self) -> str:
        return " ".join(self.raw().split())

    def without(self, test: Callable[[Node], bool]) -> Node:
        """A copy that lacks the nodes below for which ``test`` holds."""
        return Node(self.tag, self.attrs, self.said, [k.without(test) for k in self.kids if not test(k)], self.up)

    def blank(self) -> bool:
        return self.tag == "#text" and not self.said.strip()


def deepest(root: Node) -> int:
    """The greatest number of nodes that lie in each other."""
    most, todo = 0, [(root, 0)]
    while todo:
        n, depth = todo.pop()
        most = max(most, depth)
        todo += [(k, depth + 1) for k in n.kids]
    return most


@contextmanager
def room_for(depth: int) -> Iterator[None]:
    """Calls may nest as deep as a page whose tags never close; they are calls of Python alone, which take no C stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 1000 + FRAMES * depth))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parsed(html: str | None) -> Node:
    root, nodes = Node("#root", {}), []
    for n in tree(html):
        up = root if n["parent"] is None else nodes[n["parent"]]
        nodes.append(Node(n["tag"], n["attrs"], n["text"] or "", up=up))
        up.kids.append(nodes[-1])
    return root


def squeezed(text: str) -> str:
    return " ".join(text.replace(BREAK, " ").split())


def groups_of(lines: list[str]) -> list[list[str]]:
    """Lines between blank lines."""
    out: list[list[str]] = [[]]
    for line in lines:
        if line:
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return [g for g in out if g]


def like_verse(lines: list[str]) -> bool:
    full = [x for x in lines if x]
    return len(full) >= 2 and sum(map(len, full)) < 50 * len(full)


def tagged(tag: str, body: str, **attrs: str | None) -> str:
    """One block; short ones that are a single line by nature stay on it."""
    given = "".join(f' {k}="{v}"' if " " in v or k == "cite" else f" {k}={v}" for k, v in attrs.items() if v)
    if tag in ("sub", "line"):
        return f"[{tag}{given}]{body}[/{tag}]"
    return f"[{tag}{given}]\n{body}\n[/{tag}]"


@dataclass
class Note:
    item: Node
    group: str | None
    number: int | None
    star: str | None
    glyph: str | None


class Page:
    """The state of one conversion."""

    def __init__(self, html: str | None, known: dict[str, str] | None = None):
        self.root = parsed(html)
        self.known = known or {}  # href -> id of a page that has one
        self.out: list[str] = []
        self.numbers: dict[str, str] = {}  # anchor id -> number of its note
        self.used: set[int] = set()  # nodes that notes hold
        self.notes: list[Note] = []
        self.begun = self.epigraph = self.contents = False
        self.entries = {}  # anchor -> words of the page's own contents
        for n in self.root.below():
            if n.tag == "a" and n.attrs.get("href", "").startswith("#") and self._in_contents(n):
                self.entries[n.attrs["href"][1:]] = n.plain()
        self._harvest()
        self.targets: dict[str, tuple[str, int, str]] = {}  # id of a track that the text points at -> group, number, glyph
        self._point_at_tracks()

    @staticmethod
    def _in_contents(n: Node | None) -> bool:
        while n is not None:
            if n.attrs.get("id") == "toc" or any("toc" in c for c in n.names):
                return True
            n = n.up
        return False

    # -- notes ----------------------------------------------------------------------

    def _harvest(self) -> None:
        """Containers by role, a container in another belonging to it; items by class, id, back link or as list items."""
        back = lambda x: x.tag == "a" and (x.names & NOTE_BACK or re.fullmatch(r"[↑↩↪⤴^\s]+", x.raw() or " ") and x.attrs.get("href", "").startswith("#"))
        by_id = lambda x: re.match(r"(?:fn|note|cite_note)[-_]?\w*\d+$", x.attrs.get("id", ""))
        boxes: list[Node] = []
        inside: set[int] = set()
        for n in self.root.below():
            box = n.tag in ("section", "div", "ol", "ul") and n.names & NOTE_BOX
            lone = not box and n.tag in ("li", "p", "div") and (n.names & NOTE_ITEM or by_id(n)) and n.first(back) and n.up is not None
            here = n if box else n.up if lone else None
            if here is not None and id(here) not in inside and not any(here is b for b in boxes):
                boxes.append(here)
                inside |= {id(k) for k in here.below()}
        for b, box in enumerate(boxes, 1):
            group = f"s{b}" if len(boxes) > 1 else None
            items = [k for k in box.below() if k.tag in ("li", "p", "div") and not k.names & NOTE_BOX and (k.names & (NOTE_ITEM | NOTE_ANON) or by_id(k) or k.tag == "li")]
            for seq, item in enumerate(items, 1):
                if id(item) in self.used:
                    continue
                self.used |= {id(item), *(id(k) for k in item.below())}
                marker, link = item.first(lambda x: x.names & NOTE_MARK), item.first(back)
                mark = re.sub("[∗✱⁎★]", "*", marker.raw()).strip() if marker else ""
                glyph = re.sub(r"[\d\s.):]+", "", mark)
                anchor = item.attrs.get("id") or next((k.attrs["id"] for k in item.below() if k.attrs.get("id")), "")
                found = [re.findall(r"\d+", s) for s in (mark, link.attrs.get("href", "") if link else "", anchor)]
                number = next((int(d[-1]) for d in found if d), seq if any(k.tag == "ol" for k in (box, *box.below())) else None)
                star = glyph if glyph and not glyph.strip("*") and not re.search(r"\d", mark) else None
                if star or item.names & NOTE_ANON:
                    number = None
                if anchor and (number is not None or star):
                    self.numbers[anchor] = star or (f"{group}.{number}" if group else str(number))
                self.notes.append(Note(item, group, number, star, glyph if 0 < len(glyph) <= 2 and not star else None))

    def _point_at_tracks(self) -> None:
        """Tracks with an id that a link outside tracks leads to are targets of notes."""
        tracks = {n.attrs["id"]: n for n in self.root.below() if n.attrs.get("id") and is_track(n)}
        inside = {id(k) for n in tracks.values() for k in n.below()}
        for a in self.root.below() if tracks else ():
            at = a.attrs.get("href", "").removeprefix("#")
            found = re.fullmatch(r"(.*?)-?(\d+)", at)
            if a.tag == "a" and at in tracks and id(a) not in inside and found:
                group = re.sub("[^A-Za-z0-9_-]", "", found[1]) or "trk"
                self.numbers[at] = f"{group}.{int(found[2])}"
                self.targets.setdefault(at, (group, int(found[2]), re.sub(r"[\d\s.):]+", "", a.raw())[:2]))

    def note_lines(self) -> list[str]:
        """The definitions, serialised now that all numbers are known; further lines are indented."""
        out = []
        for n in self.notes:
            body = n.item.first(lambda x: x.names & NOTE_BODY) or n.item
            body = body.without(lambda x: x.names & (NOTE_MARK | NOTE_BACK) or x.tag == "a" and re.fullmatch(r"[↑↩↪⤴^\s]+", x.raw() or " ") is not None)
            lines = [x for x in self.lines(body) if x]
            if lines:
                name = n.star or ("" if n.number is None else f"{n.group}.{n.number}" if n.group else str(n.number))
                out.append(f"[^{name}]: " + "\n    ".join(lines))
        return out

    def notes_title(self) -> str | None:
        """The last second-level heading before the first note."""
        first, found = self.notes[0].item if self.notes else None, None
        for n in self.root.below():
            if n is first:
                return found
            if n.tag == "h2":
                found = squeezed(self.inline(n))
        return None

    # -- inline text -----------------------------------------------------------------

    def _marker(self, n: Node) -> str:
        link = n if n.tag == "a" else n.first(lambda x: x.tag == "a")
        target = (link.attrs.get("href", "") if link is not None else n.attrs.get("href", "")).partition("#")[2]
        number = self.numbers.get(target) or next(iter(re.findall(r"\d+|\*+", n.raw())), None)
        return f"[^{number}]" if number else n.raw()

    def _link(self, n: Node) -> str:
        text, href = self.inline(n).strip(), n.attrs.get("href", "")
        if not text or not href or href.startswith("#"):
            return text
        return f"[[{self.known[href]}]]" if href in self.known else f"[{href}|{text}]"

    def inline(self, n: Node, br: str = " ") -> str:
        out = []
        for k in n.kids:
            if k.tag == "#text":
                out.append(re.sub(r"\s+", " ", k.said) if br == BREAK else k.said)
            elif k.tag == "br":
                out.append(br)
            elif k.tag == "sup" or k.tag in ("a", "span") and k.names & NOTE_REF:
                out.append(self._marker(k))
            elif k.tag == "a":
                out.append(self._link(k))
            elif k.tag in ("em", "i"):
                text = self.inline(k, br).strip()
                out.append(f"_{text}_" if text else "")
            elif k.names & {"term", "leit"}:
                text = self.inline(k, br).strip()
                out.append(f"{{{'leit' if 'leit' in k.names else 'term'}|{text}}}" if text else "")
            elif k.names & POPUP:
                held = k.first(lambda x: x.tag == "sup" or bool(x.names & NOTE_REF))
                out.append(self._marker(held) if held is not None else "")
            elif "kicker" in k.names or k.tag in NO_TEXT:
                continue
            elif k.tag == "p":
                out.append(br * 2 + self.inline(k, br) + br * 2)
            else:
                out.append(self.inline(k, br))
        return "".join(out)

    def lines(self, n: Node) -> list[str]:
        """The author's lines: breaks count, line feeds of the source don't."""
        return [" ".join(x.split()) for x in self.inline(n, BREAK).split(BREAK)]

    def one_line(self, n: Node) -> str:
        return squeezed(self.inline(n, BREAK))

    def paragraphs(self, n: Node) -> list[str]:
        """Verse-like lines make a poem, blank lines part paragraphs, ornaments go."""
        lines = self.lines(n)
        groups = groups_of(lines)
        if like_verse(lines):
            return [tagged("poem", "\n\n".join("\n".join(g) for g in groups))]
        texts = ["\n".join(g) for g in groups]
        return [t for t in texts if re.search(r"\w", t) and t.lower() not in LABELS]

    def verse(self, nodes: list[Node]) -> list[str]:
        """One poem of stanzas: marked lines, else breaks and the source's own line feeds."""
        stanzas = []
        for n in nodes:
            marked = [k for k in n.kids if k.names & VERSE_LINE]
            if marked:
                stanzas.append([self.one_line(k) for k in marked])
            else:
                text = re.sub(r"[ \t]*\n?[ \t]*\0[ \t]*\n?[ \t]*", BREAK, self._verse_text(n)).replace(BREAK, "\n")
                stanzas += groups_of([" ".join(x.split()) for x in text.split("\n")])
        found = ["\n".join(x for x in s if x) for s in stanzas]
        return [tagged("poem", "\n\n".join(x for x in found if x))] if any(found) else []

    def _verse_text(self, n: Node) -> str:
        out = []
        for k in n.kids:
            if k.tag == "#text":
                out.append(k.said)
            elif k.tag == "br":
                out.append(BREAK)
            else:
                out.append(self.inline(Node("#root", {}, kids=[k])))
        return "".join(out)

    def framed(self, tag: str, n: Node, kind: str | None = None) -> list[str]:
        """An epigraph or a quotation: its source apart, its label gone, its lines kept."""
        source = n.first(lambda x: x.tag == "cite" or bool(x.names & CITE))
        cite = source.without(lambda x: x.tag == "sup").plain().strip("— ") if source is not None else None
        body = n.without(lambda x: x is source or x.tag == "cite" or bool(x.names & (CITE | QUOTE_LABEL | {"epi-label", "label"})))
        lines = self.lines(body)
        if tag == "quote" and lines and re.fullmatch(r"(?i)[«\"“]?\s*цитата\s*[:.]?\s*[»\"”]?", next((x for x in lines if x), "")):
            lines = lines[next(i for i, x in enumerate(lines) if x) + 1 :]
        groups = groups_of(lines)
        if not groups:
            return []
        if tag == "epi" and not kind and like_verse(lines):
            kind = "verse"
        return [tagged(tag, "\n\n".join("\n".join(g) for g in groups), kind=kind, cite=cite)]

    # -- music --------------------------------------------------------------------------

    def music(self, nodes: list[Node]) -> list[str]:
        """Tracks, labels and notes between them, in order; an untitled copy of a titled video goes."""
        label, entries = "", []
        for n in nodes:
            if n.names & MUSIC_LABEL:
                label = self.one_line(n).rstrip(":")
            elif is_remark(n):
                entries.append((None, self.one_line(n), "", None))
            else:
                entries.append((*self.track(n), self.targets.get(n.attrs.get("id", ""))))
        titled = {video(u) for u, t, a, _ in entries if u and (t or a)} - {None}
        lines, seen, asked = [], set(), None
        for url, title, author, target in entries:
            if url is None:
                lines.append(f"> {title}")
            elif (url or title) and (title or author or target or video(url) not in titled):
                key = (video(url) or url, title, author)
                asked = target or asked
                if key not in seen or target:
                    seen.add(key)
                    lines.append(f"[{url}|{title}|{author}" + (f"|{target[1]}]" if target else "]"))
        if not lines:
            return []
        if asked:
            return [f"[mus refs={asked[0]}" + (f" glyph={asked[2]}" if asked[2] else "") + "]\n" + "\n".join(lines) + "\n[/mus]"]
        head = "" if not label or "настроени" in label.lower() and "[^" not in label else f'="{label}"'
        return [f"[mus{head}]\n" + "\n".join(lines) + "\n[/mus]"]

    def track(self, n: Node) -> tuple[str, str, str]:
        """(url, title, author): by class, else bold is the author, else `author — title`."""
        clean = lambda s: re.sub(r"^[▶►▸·•\s]+|^[—–-]\s*|\s*[—–-]$", "", " ".join(s.split())).strip()
        link = n.first(lambda x: x.tag == "a" and "http" in x.attrs.get("href", ""))
        data = next((x.attrs[k] for x in (n, *n.below()) for k in ("data-embed", "data-yt") if x.attrs.get(k)), "")
        url = link.attrs["href"] if link is not None else data if data.startswith("http") else f"https://youtu.be/{data}" if data else ""
        name, by = n.first(lambda x: bool(x.names & TRACK_TITLE)), n.first(lambda x: bool(x.names & TRACK_AUTHOR))
        if name is not None:
            title = clean(name.without(lambda x: bool(x.names & TRACK_AUTHOR)).raw())
            return url, title, clean(by.raw()) if by is not None else ""
        bold, whole = n.first(lambda x: x.tag in ("b", "strong")), clean(n.raw())
        if bold is not None:
            author = clean(bold.raw())
            return url, clean(whole.replace(author, "", 1)), author
        author, dash, title = whole.partition(" — ")
        return (url, clean(title), clean(author)) if dash else (url, whole, "")

    # -- the walk --------------------------------------------------------------------------

    def emit(self, blocks: list[str], begins: bool = True) -> None:
        self.out += blocks
        self.begun = self.begun or (begins and bool(blocks))

    def heading_for(self, n: Node) -> None:
        """An entry of the page's contents that leads to a block without a heading becomes one."""
        anchor = n.attrs.get("id")
        if anchor in self.entries and n.first(lambda x: x.tag in ("h1", "h2", "h3", "h4")) is None:
            self.emit([f"## {self.entries[anchor]} {{{anchor}}}"])

    def refs(self, n: Node) -> None:
        """Where a group's first note stands, its place in the text."""
        note = next((x for x in self.notes if x.item is n and x.group), None)
        if note and next(x for x in self.notes if x.group == note.group) is note:
            self.emit([f"[refs={note.group}" + (f" glyph={note.glyph}" if note.glyph else "") + "]"])

    def walk(self, n: Node) -> None:
        run: list[Node] = []  # text and inline nodes that stand bare among blocks

        def flush() -> None:
            if run:
                self.emit(self.paragraphs(Node("p", {}, kids=run[:])))
                run.clear()

        i = 0
        while i < len(n.kids):
            k = n.kids[i]
            if id(k) in self.used:
                flush()
                self.refs(k)
                i += 1
                continue
            if k.tag in INLINE and not k.names & (TRACK | {"num-h", "para-num"}):
                bare = not any(not r.blank() for r in run)
                if bare and k.tag in ("b", "strong") and k.plain().rstrip(":").lower() in LABELS:
                    self.epigraph = True
                else:
                    run.append(k)
                i += 1
                continue
            flush()
            for test, act in RULES:
                if test(self, k):
                    i = act(self, n, i)
                    break
        flush()


def video(url: str | None) -> str | None:
    found = VIDEO.search(url or "")
    return found[1] if found else None


def is_remark(n: Node) -> bool:
    return n.tag in ("p", "div") and "remark" in n.names | {"remark" if "note" in n.names else ""} and not n.names & NOTE_REF


def is_track(n: Node) -> bool:
    if n.tag not in ("div", "details", "figure", "li"):
        return False
    data = lambda x: bool(x.attrs.get("data-yt") or x.attrs.get("data-embed"))
    if n.names & TRACK or data(n):
        return True
    small = len("".join(n.raw().split())) <= 200 and n.first(lambda x: x.tag in ("h1", "h2", "h3", "p")) is None
    return small and n.first(data) is not None


def is_rich(n: Node) -> bool:
    return n.tag in RICH or n.tag == "div" and n.first(lambda x: x.tag == "p") is not None


def hanging(n: Node) -> tuple[int, str] | None:
    """The number that hangs before a paragraph, and its mark."""
    head = next((k for k in n.kids if not k.blank()), None)
    if n.tag != "p" or head is None or head.tag != "span" or not head.names & HANGING:
        return None
    found = re.fullmatch(r"(\d+)\s*([.)])?", head.plain())
    return (int(found[1]), found[2] or ".") if found else None


def speaker_label(n: Node) -> str | None:
    """The name in a short node that announces who speaks."""
    text = n.plain()
    if n.tag not in ("p", "div") or not 0 < len(text) <= 80:
        return None
    if re.search(r"написал\(а\)\s*:?$", text) or re.fullmatch(r"(?i)(вопрос|ответ|реплика)(\s*\([^)]*\))?\s*[:.]?", text) or text.endswith(":") and n.names & SPEAKER:
        return re.sub(r"\s*(написал\(а\))?\s*[:.]?$", "", text)
    return None


def ends_speech(n: Node) -> bool:
    stop = EPIGRAPH | VERSE | STANZA | SIGNED | DATED | NOTE_BOX | CHROME | {"music", "kicker"}
    return n.tag != "hr" and (n.tag in CHROME_TAGS | STOP_TAGS or bool(n.names & stop))


RULES: list[tuple[Callable[[Page, Node], bool], Callable[[Page, Node, int], int]]] = []


def rule(test: Callable[[Page, Node], bool]):
    """The next rule of the table: ``act(page, parent, place)`` emits blocks and returns the place after them."""

    def add(act):
        RULES.append((test, act))
        return act

    return add


def single(emit: Callable[[Page, Node], None]) -> Callable[[Page, Node, int], int]:
    """A rule's act that takes one node."""

    def act(page: Page, up: Node, i: int) -> int:
        emit(page, up.kids[i])
        return i + 1

    return act


def run_of(up: Node, i: int, test: Callable[[Node], bool]) -> tuple[list[Node], int]:
    """The neighbours from ``i`` on that fit, blank text between them passed over, and the place after."""
    out = []
    while i < len(up.kids) and (up.kids[i].blank() or test(up.kids[i])):
        out += [] if up.kids[i].blank() else [up.kids[i]]
        i += 1
    return out, i


def has(names: set[str], *tags: str) -> Callable[[Page, Node], bool]:
    return lambda page, n: bool(n.names & names) and (not tags or n.tag in tags)


BOX = ("p", "div", "blockquote")


@rule(lambda page, n: n.tag in ("details", "nav", "div", "ol", "ul", "aside", "section") and (n.attrs.get("id") == "toc" or any("toc" in c for c in n.names)))
@single
def contents(page, n):
    if not page.contents:
        page.contents = True
        page.emit(["[toc collapsed]" if n.tag == "details" and "open" not in n.attrs else "[toc]"], begins=False)


@rule(lambda page, n: n.tag == "header")
@single
def rescued(page, n):
    """What describes the page in its header stays: subtitles and decks, each once."""
    for k in n.below():
        text = page.one_line(k)
        block = tagged("sub", text) if k.names & SUBTITLE else tagged("subsec", text) if k.names & DECK else None
        if text and block and block not in page.out:
            page.emit([block], begins=False)


@rule(lambda page, n: n.tag in CHROME_TAGS or n.tag == "img" or bool(n.names & CHROME))
@single
def chrome(page, n):
    pass


@rule(lambda page, n: "kicker" in n.names and not page.begun)
@single
def kicker(page, n):
    text = page.one_line(n)
    if text and len(text) < 40 and DATE.search(text):
        page.emit([tagged("line", text, kind="dateline")])
    elif text:
        page.emit([tagged("sub", text)], begins=False)


@rule(has(DATED, "p", "div", "span"))
@single
def dated(page, n):
    if text := page.one_line(n):
        page.emit([tagged("line", text, kind="dateline")])


@rule(has(TAGGED, "p", "div"))
@single
def tags(page, n):
    if text := page.one_line(n):
        page.emit([tagged("line", text, kind="tags")])


@rule(has(SEE_ALSO, "p", "div"))
def see_also(page, up, i):
    """One line for each label and what follows it; a label alone goes; tags behind it join it."""
    n = up.kids[i]
    rows: list[list[str]] = []
    parts = [k for k in n.kids if k.tag == "p"] if n.tag == "div" else []
    for text in map(page.one_line, parts if len(parts) > 1 else [n]):
        if ALSO.match(text) or not rows:
            rows.append([])
        rows[-1].append(ALSO.sub("", text))
    more, after = run_of(up, i + 1, lambda k: k.tag == "p" and "tag" in k.names)
    if rows and more:
        rows[-1] += map(page.one_line, more)
    said = [" ".join(x for x in r if x) for r in rows]
    page.emit([f"См. также: {s}" for s in said if s])
    return after if more else i + 1


@rule(has(CRY, "p", "div"))
@single
def cry(page, n):
    if lines := [x for x in page.lines(n) if x]:
        page.emit([tagged("cry", "\n".join(lines))])


@rule(has(SIGNED, "p", "div"))
@single
def signed(page, n):
    """A signature, or a date line where hardly anything but a date is left."""
    body = "\n".join(x for x in page.lines(n.without(lambda x: bool(x.names & {"sig-label", "sig-head"}))) if x)
    rest = re.sub(r"(?i)\b(написано|написана|дата|от)\b", "", DATE.sub("", body))
    if body and "\n" not in body and DATE.search(body) and len(re.sub(r"[\s.,:;г\-–—()]", "", rest)) <= 1:
        page.emit([tagged("line", body, kind="dateline")])
    elif body:
        page.emit([tagged("sig", body)])


@rule(has(DEDICATION, *BOX))
@single
def dedication(page, n):
    page.emit(page.framed("epi", n, "dedi"))


@rule(lambda page, n: n.tag in BOX and (page.epigraph or bool(n.names & (EPIGRAPH | CODA))))
@single
def epigraph(page, n):
    page.epigraph = False
    page.heading_for(n)
    page.emit(page.framed("epi", n))


@rule(has(POEM_TITLE, "h2", "h3", "h4"))
@single
def poem_title(page, n):
    page.emit([tagged("subsec", "\n".join(x for x in page.lines(n) if x))], begins=False)


@rule(lambda page, n: n.tag in ("h2", "h3", "h4") and (page.one_line(n).lower() in LABELS or n.attrs.get("id") in ("epigraph", "epi")))
@single
def epigraph_heading(page, n):
    """A label over an epigraph goes, unless the page's contents lead to it."""
    if n.attrs.get("id") in page.entries:
        page.emit([f"## {page.one_line(n)} {{{n.attrs['id']}}}"])
    page.epigraph = True


@rule(lambda page, n: n.tag in ("h2", "h3", "h4") and not (n.names & SUBTITLE))
def heading(page, up, i):
    n = up.kids[i]
    if text := page.one_line(n):
        lone = sum(k.tag in ("h2", "h3", "h4") for k in up.kids) == 1
        named = n.first(lambda x: x.tag == "a" and bool(x.attrs.get("name")))
        slug = n.attrs.get("id") or (up.attrs.get("id") if lone else None) or (named.attrs["name"] if named is not None else None)
        page.emit([("## " if n.tag == "h2" else "### ") + text + (f" {{{slug}}}" if slug else "")])
    return i + 1


@rule(lambda page, n: n.tag in ("div", "section", "details", "aside") and any("music" in c for c in n.names) and not n.names & MUSIC_LABEL)
@single
def music_box(page, n):
    head = n.first(lambda x: x.tag in ("h2", "h3"))
    if head is None:
        page.heading_for(n)
    elif text := page.one_line(head):
        slug = head.attrs.get("id") or n.attrs.get("id")
        page.emit([("## " if head.tag == "h2" else "### ") + text + (f" {{{slug}}}" if slug else "")])
    found: list[Node] = []

    def gather(x: Node) -> None:
        for k in x.kids:
            if is_track(k) or k.names & MUSIC_LABEL or is_remark(k):
                found.append(k)
            else:
                gather(k)

    gather(n)
    page.emit(page.music(found))
    if len(page.out) > 1 and (m := re.match(r'\[mus="([^"\[]*)(\[\^[^\]]+\])"\]', page.out[-1])) and re.sub(r"^#+ | \{.*\}$", "", page.out[-2]).lower() == m[1].lower():
        page.out[-2] = re.sub(r"( \{.*\})?$", rf"{m[2]}\1", page.out[-2], count=1)  # the marker moves to the equal heading
        page.out[-1] = page.out[-1].replace(m[2], "", 1)


@rule(lambda page, n: is_track(n) or bool(n.names & MUSIC_LABEL))
def tracks(page, up, i):
    found, after = run_of(up, i, lambda k: is_track(k) or bool(k.names & MUSIC_LABEL) or is_remark(k))
    page.emit(page.music(found))
    return after


@rule(lambda page, n: bool(n.names & DECK) or bool(n.names & SUBTITLE) and bool(page.out) and page.out[-1].startswith("##"))
@single
def deck(page, n):
    if lines := [x for x in page.lines(n) if x]:
        page.emit([tagged("subsec", "\n".join(lines))], begins=False)


@rule(lambda page, n: bool(n.names & SUBTITLE) or "sub" in n.names and not page.begun)
@single
def subtitle(page, n):
    if text := page.one_line(n):
        page.emit([tagged("sub", text)], begins=False)


@rule(lambda page, n: n.tag == "pre" or bool(n.names & VERSE))
@single
def verse(page, n):
    """Stanzas run together; prose between them parts poems; a collection with headings is entered."""
    if n.first(lambda x: x.tag in ("h2", "h3", "h4")) is not None:
        return page.walk(n)
    kids = [k for k in n.kids if not k.blank()]
    stanzas = [k for k in kids if k.names & STANZA]
    if not stanzas:
        return page.emit(page.verse([k for k in kids if k.tag == "p"] or [n]))
    run: list[Node] = []
    for k in kids:
        if k.tag == "p" and not k.names & STANZA:
            page.emit(page.verse(run))
            run = []
            page.emit(page.paragraphs(k))
        else:
            run.append(k)
    return page.emit(page.verse(run))


@rule(has(STANZA))
def stanzas(page, up, i):
    found, after = run_of(up, i, lambda k: bool(k.names & STANZA))
    page.emit(page.verse(found))
    return after


@rule(has(QUOTE_LABEL, "p", "div"))
@single
def quote_label(page, n):
    pass


@rule(lambda page, n: n.tag == "blockquote" or n.tag in ("div", "p") and any("quote" in c and "label" not in c for c in n.names))
@single
def quote(page, n):
    page.emit(page.framed("quote", n, "scripture" if "scripture" in n.names else None))


def _items(page: Page, n: Node) -> list[Node]:
    items = [k for k in n.kids if k.tag == "li"]
    for k in items:
        if id(k) in page.used:
            page.refs(k)
    return [k for k in items if id(k) not in page.used]


def _nested(page: Page, n: Node) -> str:
    """The blocks of a rich item by themselves."""
    held, page.out = page.out, []
    page.walk(n)
    inner, page.out = "\n\n".join(page.out), held
    return inner


@rule(lambda page, n: n.tag == "ol")
@single
def numbered(page, n):
    """Items by blank lines; with blocks inside items, numbers go on over them from the list's start."""
    items = _items(page, n)
    if any(li.first(is_rich) is not None for li in items):
        start = int(n.attrs["start"]) if n.attrs.get("start", "").strip().isdigit() else 1
        said = [_nested(page, li) if li.first(is_rich) is not None else "\n".join(x for x in page.lines(li) if x) for li in items]
        page.emit([tagged("num", "\n".join(f"{k}. {s}".rstrip() for k, s in enumerate(said, start)))] if said else [])
    else:
        said = ["\n".join(x for x in page.lines(li) if x) for li in items]
        page.emit([tagged("num", "\n\n".join(s for s in said if s))] if any(said) else [])


@rule(lambda page, n: n.tag == "ul")
@single
def bulleted(page, n):
    plain: list[str] = []
    for li in _items(page, n):
        if li.first(is_rich) is not None:
            page.emit([tagged("ul", "\n".join(plain))] if plain else [])
            plain = []
            page.walk(li)
        elif lines := [x for x in page.lines(li) if x]:
            plain.append("- " + "\n".join(lines))
    page.emit([tagged("ul", "\n".join(plain))] if plain else [])


@rule(lambda page, n: n.tag == "dl")
@single
def terms(page, n):
    """Definitions as a list: a term and its text; either may stand alone."""
    items: list[str] = []
    open_ = False
    named = lambda t: f"{{term|{t}}}" if re.fullmatch(r"[^{}\[\]\n|]+", t) else t
    for k in n.below():
        text = page.one_line(k) if k.tag in ("dt", "dd") else ""
        if not text:
            continue
        if k.tag == "dt":
            items.append(f"- {named(text)}")
        elif open_:
            items[-1] += f" — {text}"
        else:
            items.append(f"- {text}")
        open_ = k.tag == "dt"
    page.emit([tagged("ul", "\n".join(items))] if items else [])


@rule(lambda page, n: n.tag == "table")
@single
def table(page, n):
    rows = [squeezed(" ".join(page.inline(c) for c in k.kids if c.tag in ("td", "th"))) for k in n.below() if k.tag == "tr"]
    page.emit([r for r in rows if r])


@rule(lambda page, n: hanging(n) is not None)
def hanging_numbers(page, up, i):
    found, after = run_of(up, i, lambda k: hanging(k) is not None)
    items = []
    for k in found:
        number, mark = hanging(k)
        text = "\n".join(x for x in page.lines(k.without(lambda x: x.tag == "span" and bool(x.names & HANGING))) if x)
        items.append(f"{number}{mark} {text}".rstrip())
    page.emit([tagged("num", "\n\n".join(items))])
    return after


@rule(lambda page, n: n.tag == "span" and bool(n.names & HANGING))
def number_outside(page, up, i):
    """A number that stands before its paragraph."""
    found, after = re.fullmatch(r"(\d+)\s*([.)])?", up.kids[i].plain()), i + 1
    while after < len(up.kids) and up.kids[after].blank():
        after += 1
    if found and after < len(up.kids) and up.kids[after].tag == "p":
        first, *rest = page.paragraphs(up.kids[after]) or [""]
        page.emit([tagged("num", f"{found[1]}{found[2] or '.'} {first}"), *rest])
        return after + 1
    page.emit(page.paragraphs(Node("p", {}, kids=[up.kids[i]])))
    return i + 1


@rule(lambda page, n: speaker_label(n) is not None)
def thread(page, up, i):
    """Labels and the neighbours that follow each until the next label or a node that ends speech."""
    posts: list[str] = []
    while i < len(up.kids):
        label, body, j = speaker_label(up.kids[i]), [], i + 1
        if label is None:
            break
        while j < len(up.kids) and (up.kids[j].blank() or speaker_label(up.kids[j]) is None and not ends_speech(up.kids[j]) and id(up.kids[j]) not in page.used):
            if not up.kids[j].blank() and up.kids[j].tag != "hr":
                held = [x for x in up.kids[j].kids if x.tag in BOX] or [up.kids[j]]
                body += ["\n".join(g) for x in held for g in groups_of(page.lines(x))]
            j += 1
        posts.append("\n\n".join([f">> {label}", *body]))
        i = j
    page.emit([tagged("dlg", "\n\n".join(posts))])
    return i


@rule(has(DIALOG))
def dialog(page, up, i):
    """Neighbouring turns as one block; with blocks inside them they stay as they are."""
    found, after = run_of(up, i, lambda k: bool(k.names & DIALOG) and speaker_label(k) is None)
    held, page.out = page.out, []
    for k in found:
        if k.tag == "p":
            page.emit(page.paragraphs(k))
        else:
            page.walk(k)
    said, page.out = page.out, held
    page.emit([tagged("dlg", "\n\n".join(said))] if said and not any(s.startswith(("[", "#")) for s in said) else said)
    return after


@rule(lambda page, n: n.tag == "p")
@single
def paragraph(page, n):
    if n.plain().rstrip(":").lower() != "музыка под настроение":
        page.emit(page.paragraphs(n))


@rule(lambda page, n: any(not k.blank() for k in n.kids) and all(k.tag in INLINE for k in n.kids))
@single
def bare_text(page, n):
    page.emit(page.paragraphs(n))


@rule(lambda page, n: True)
@single
def wrapper(page, n):
    page.heading_for(n)
    page.walk(n)


UNSEEN_TAGS = CHROME_TAGS | {"sup"}
UNSEEN = POPUP | CHROME | QUOTE_LABEL | NOTE_MARK | NOTE_BACK | MUSIC_LABEL | CITE | TAGGED | HANGING | NOTE_REF


def visible(n: Node) -> int:
    """Characters, white space apart, that a reader sees and the markup should hold; ``n`` isn't below the page's contents."""
    seen, todo = 0, [n]
    while todo:
        n = todo.pop()
        if n.tag == "#text":
            seen += len("".join(n.said.split()))
        elif n.tag == "header":
            seen += sum(len("".join(k.raw().split())) for k in n.below() if k.names & (SUBTITLE | DECK))
        elif not (n.tag in UNSEEN_TAGS or not UNSEEN.isdisjoint(n.names) or n.attrs.get("id") == "toc" or any("toc" in c for c in n.names)):
            todo += n.kids
    return seen


def shown(markup: str) -> int:
    """The same of markup: tags, marks, targets and numbers of the format don't count."""
    s = re.sub(r"(?m)^\[line kind=tags\].*$", "", markup)
    s = re.sub(r"(?m)^\[\^[^\]]*\]:|^\d+[.)] |^- |^>+ |^#+ | \{[\w-]+\}$", "", s)
    s = re.sub(r"\[\^[^\]]*\]|\[/?[a-z]+(?:[= ][^\]\n|]*)?\]", "", s)
    s = re.sub(r"\[[^|\]\s]*\|([^\]]*)\]", lambda m: m[1].replace("|", ""), s)
    s = re.sub(r"\{(?:term|leit)\|([^}]*)\}", r"\1", s)
    return len("".join(re.sub(r"(?<!\w)_([^_\n]+)_(?!\w)", r"\1", s).split()))


def work_type(blocks: list[str]) -> str:
    """dialog, numbered, poem, verse or prose, by what a page consists of."""
    of = lambda tag: [b for b in blocks if re.match(rf"\[{tag}[\] =]", b)]
    size = lambda bs: sum(len("".join(re.sub(r"\[/?[a-z]+[^\]]*\]", "", b).split())) for b in bs)
    verse_chars = size(of("poem"))
    prose = size([b for b in blocks if not b.startswith(("[", "#"))])
    if of("dlg"):
        return "dialog"
    if of("num"):
        return "numbered"
    if verse_chars and verse_chars >= prose:
        return "poem" if sum(b.startswith("## ") for b in blocks) >= 2 else "verse"
    return "prose"


def converted(page: Page) -> dict:
    top = page.root.first(lambda x: x.tag == "h1")
    title = squeezed(page.inline(top)) if top is not None else ""
    page.walk(page.root)
    notes, heading = page.note_lines(), page.notes_title()
    fields = {"title": title}
    heads = [k for k, b in enumerate(page.out) if b.startswith("## ")]
    if heading and heads and re.sub(r" \{.*\}$", "", page.out[heads[-1]][3:]) == heading and not any(not b.startswith("[refs") for b in page.out[heads[-1] + 1 :]):
        page.out.pop(heads[-1])
        fields["notes"] = heading
    body = "\n\n".join(page.out) + ("\n\n" + "\n".join(notes) if notes else "")
    front = "".join(f"{k}: {v}\n" for k, v in fields.items())
    mass = visible(page.root)
    return {"title": title, "markup": f"---\n{front}---\n\n{body}\n", "kind": work_type(page.out), "notes": len(notes), "coverage": round(shown("\n".join([*fields.values()][1:]) + "\n\n" + body) / mass, 3) if mass else 1.0, "error": None}


def imported(html: str | None, known: dict[str, str] | None = None) -> dict:
    """(title, markup, kind, notes, coverage, error) of a page.

    The heading over the notes goes if it is the last one, and is named in the frontmatter.  A page
    that fails has its error and no markup, and doesn't stop the others.
    """
    try:
        page = Page(html, known)
        with room_for(deepest(page.root)):
            return converted(page)
    except Exception as e:  # one page that fails doesn't stop the others
        return {"title": None, "markup": None, "kind": None, "notes": None, "coverage": None, "error": f"{type(e).__name__}: {e}"}


IMPORTED = T.StructType().add("title", "string").add("markup", "string").add("kind", "string").add("notes", "integer").add("coverage", "double").add("error", "string")

NOTE_ROW = T.StructType().add("pos", "integer").add("grp", "string").add("id", "long").add("glyph", "string").add("body", "string")


def harvested(html: str | None) -> list[dict]:
    """The notes of a page by themselves: group (if there are several containers), number, series glyph and text."""
    page = Page(html)
    body = lambda n: n.item.without(lambda x: bool(x.names & (NOTE_MARK | NOTE_BACK)) or x.tag == "a" and x.attrs.get("href", "").startswith("#"))
    with room_for(deepest(page.root)):
        return [{"pos": k, "grp": n.group, "id": n.number, "glyph": n.glyph, "body": page.one_line(body(n))} for k, n in enumerate(page.notes)]


harvest_notes = F.udf(harvested, T.ArrayType(NOTE_ROW), useArrow=True)
import_page = F.udf(lambda html: imported(html), IMPORTED, useArrow=True)
