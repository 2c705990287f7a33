"""Block markup to HTML, one document at a time (Arrow UDFs).

A ``Renderer`` holds what one document's rendering knows: the context (titles of other documents, the
reference index, proper nouns), the frontmatter's switches, the notes met so far and the contents.  Inline
text goes through ``Renderer.cascade``, whose order is part of the format.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F, types as T

from quillspark.functions.markup import parse_blocks, parse_notes, split_notes
from quillspark.functions.text import CASE_ENDINGS, YES

# Wording and forms of the pages (fixed values).
NOTES, CONTENTS, TO_TOP, BACK_TO_TEXT = "Примечания", "Содержание", "К началу статьи", "Вернуться к месту в тексте"
SEE_ALSO = "См. также"
GLYPHS = (r"&lt;\\\^/&gt;", r"&lt;/v\\&gt;", r";::\)+")
UNITS = (("СВЯТ БЛАГОСЛОВЕН ОН", "Свят Благословен Он"), ("БЛАГОСЛОВЕН ОН", "Благословен Он"))  # capitalised as one
_UP = f'<a class="back-to-toc" href="#article-title" title="{TO_TOP}">↑</a>'
_MARK = re.compile(r"\[\^(?:([A-Za-zЀ-ӿ0-9_-]+)\.)?(\d+|\*+)\]")
_POINT = re.compile(r'\[fp\b((?:"[^"]*"|[^\]"])*)\]')


@dataclass(frozen=True)
class Context:
    """What a document's rendering takes from other tables."""

    titles: dict[str, str] = field(default_factory=dict)  # id -> title
    chapters: dict[str, str] = field(default_factory=dict)  # chapter -> its words in a reference
    articles: dict[str, str] = field(default_factory=dict)  # chapter/number -> title
    paragraphs: dict[str, str] = field(default_factory=dict)  # chapter/paragraph -> number
    nouns: frozenset[str] = frozenset()  # proper nouns in capitals
    base: str = ""  # of reference links
    book: str = ""  # the name of what references lead to
    prefix: str = ""  # of links to other documents


def escape(s: str) -> str:
    return _html.escape(s, quote=False)


def slug(text: str) -> str:
    words = re.sub("[^А-Яа-яA-Za-z0-9 -]", "", text).split()[:3]
    return "-".join(w.lower() for w in words) or "section"


def note_key(group: str | None, number: str) -> str:
    if number.startswith("*"):
        return f"star{len(number)}"
    return f"{group}-{int(number)}" if group else str(int(number))


def attributes(raw: str) -> dict[str, str]:
    from quillspark.functions.markup import attributes as parse

    return parse(raw)


def is_capitals(line: str) -> bool:
    """At least three Cyrillic letters beside tags, seven of ten in upper case."""
    letters = re.findall("[А-Яа-яЁё]", re.sub("<[^>]+>", "", line))
    return len(letters) >= 3 and 10 * sum(c.isupper() for c in letters) >= 7 * len(letters)


def is_noun(word: str, nouns: frozenset[str]) -> bool:
    """A proper noun, or its stem with an ending of a case."""
    folded = word.upper().replace("Ё", "Е")
    if folded in nouns:
        return True
    stems = {b[:-1] if b[-1:] in "ЬЙАЯ" else b for b in nouns}
    return any(folded.startswith(s) and folded[len(s) :] in CASE_ENDINGS for s in stems if s)


def small_capitals(line: str, nouns: frozenset[str] = frozenset()) -> str:
    """A line of capitals in lower case but for proper nouns, the honorific, forced words and sentence starts; tags stay."""
    forced = re.sub(r"\^([A-ZА-ЯЁ][A-ZА-ЯЁ-]*)", lambda m: m[1].capitalize(), line)
    for upper, unit in UNITS:
        forced = re.sub(rf"(?<!\w){upper.replace(' ', chr(92) + 's+')}(?!\w)", unit, forced)
    pieces = re.split(r"(<[^>]+>)", forced)
    fold = lambda m: m[0].capitalize() if is_noun(m[0], nouns) else m[0].lower()
    pieces = [p if p.startswith("<") else re.sub(r"(?<!\w)[А-ЯЁA-Z][А-ЯЁA-Z-]*(?!\w)", fold, p) for p in pieces]
    begun = False
    for k, p in enumerate(pieces):
        if not p.startswith("<") and p:
            pieces[k] = re.sub(r"([.!?]\s+)(\w)", lambda m: m[1] + m[2].upper(), p)
            if not begun and (m := re.search(r"[^\W\d_]", p)):
                pieces[k] = pieces[k][: m.start()] + pieces[k][m.start()].upper() + pieces[k][m.start() + 1 :]
                begun = True
    return "".join(pieces)


def capitals(text: str, nouns: frozenset[str] = frozenset(), merged: bool = False) -> str:
    """Every line of capitals as small capitals, ``^WORD`` elsewhere with one capital; ``merged``: one span for
    neighbouring lines of capitals."""
    out: list[str] = []
    before = False
    for line in text.split("\n"):
        now = is_capitals(line)
        if now and before and merged:
            out[-1] = f"{out[-1].removesuffix('</span>')}\n{small_capitals(line, nouns)}</span>"
        elif now:
            out.append(f'<span class="sb">{small_capitals(line, nouns)}</span>')
        else:
            out.append(re.sub(r"\^([A-ZА-ЯЁ][A-ZА-ЯЁ-]*)", lambda m: m[1].capitalize(), line))
        before = now
    return "\n".join(out)


class Renderer:
    def __init__(self, source: str | None, context: Context | None = None):
        src = (source or "").replace("\r\n", "\n").replace("\r", "\n")
        front = re.match(r"---\n(.*?)\n?---(?:\n|\Z)", src, flags=re.S)
        pairs = [x.partition(":") for x in (front[1] if front else "").split("\n") if ":" in x]
        self.fields = {k.strip(): v.strip() for k, _, v in pairs}
        body, notes = split_notes((src[front.end() :] if front else src).lstrip("\n"))
        self.context = context or Context()
        self.blocks, self.notes = parse_blocks(body), parse_notes(notes)
        self.caps, self.verse = (self.fields.get(k, "").lower() in YES for k in ("caps", "allow_faw"))
        self.asked = {note_key(*m) for m in _MARK.findall("\n".join([body, self.fields.get("title", ""), self.fields.get("notes_title", ""), *(n["body"] for n in self.notes)]))}
        self.glyphs = {b.get("grp") or "": b["attrs"]["glyph"] for b in self.blocks if b["type"] == "refs" and b["attrs"].get("glyph")}
        self.glyphs |= {b["attrs"]["refs"]: b["attrs"]["glyph"] for b in self.blocks if b["type"] == "mus" and b["attrs"].get("refs") and b["attrs"].get("glyph")}
        self.seen: dict[str, int] = {}
        self.shown: set[str] = set()  # groups of notes that stand in the text
        self.contents: list[tuple[int, str, str]] = []  # level, slug, label
        self.missing: list[str] = []

    # -- inline -----------------------------------------------------------------------------

    def _notes(self, s: str) -> str:
        def one(m: re.Match) -> str:
            key = note_key(m[1], m[2])
            self.seen[key] = self.seen.get(key, 0) + 1
            again = "" if self.seen[key] == 1 else f"-extra{self.seen[key] - 1}"
            glyph = self.glyphs.get(m[1] or "")
            label = m[2] if m[2].startswith("*") else f"{escape(glyph)}{int(m[2])}" if m[1] and glyph else f"[{int(m[2])}]"
            return f'<sup id="cite_ref-{key}{again}"><a href="#cite_note-{key}">{label}</a></sup>'

        return _MARK.sub(one, s)

    def _internal(self, s: str) -> str:
        def one(m: re.Match) -> str:
            title = self.context.titles.get(m[1])
            if title is None:
                self.missing.append(m[1])
                return f'<a class="broken" href="#">{m[0]}</a>'
            return f'<a class="internal" href="{self.context.prefix}{m[1]}.html">{escape(title or m[1])}</a>'

        return re.sub(r"\[\[([A-Za-z0-9]+)\]\]", one, s)

    def reference(self, tag: str, chapter: str | None, number: str | None, paragraph: str | None) -> tuple[str, str] | None:
        """(address, words) of a reference: to the book, a chapter, an article or a paragraph; None if there is no such place."""
        c = self.context
        if not chapter:
            return None if number or paragraph else (f"{c.base}/", c.book)
        if chapter not in c.chapters:
            return None
        words = f"{c.book}, {c.chapters[chapter]}"
        if not number and not paragraph:
            return f"{c.base}/{chapter}/", words
        owner = c.paragraphs.get(f"{chapter}/{paragraph}") if paragraph else None
        number = str(int(number)) if number else owner
        title = c.articles.get(f"{chapter}/{number}")
        if title is None or paragraph and owner != number:
            return None
        at = f"{c.base}/{chapter}/{number.zfill(3)}.html"
        return (f"{at}#p{paragraph}", f"{words}, {title}, § {paragraph}") if paragraph else (at, f"{words}, {title}")

    def _reference(self, s: str) -> str:
        def one(m: re.Match) -> str:
            found = self.reference(*m.group(0, 1, 2, 3))
            return f'<a class="broken" href="#">{m[0]}</a>' if found is None else f'<a class="reference" href="{found[0]}">{escape(found[1])}</a>'

        return re.sub(r"\{([a-z][a-z0-9-]*)?\|(\d*)(?:\|(\d*))?\}", one, s)

    @staticmethod
    def _terms(s: str) -> str:
        return re.sub(r"\{(term|leit)\|([^}\n]+)\}", r'<span class="\1">\2</span>', s)

    @staticmethod
    def _external(s: str) -> str:
        return re.sub(r"\[(https?://[^\s|\]]+)(?:\|([^\]]+))?\]", lambda m: f'<a href="{m[1]}" target="_blank" rel="noopener">{m[2] or m[1]}</a>', s)

    @staticmethod
    def _italic(s: str) -> str:
        return re.sub(r"(?<![A-Za-zА-Яа-яёЁ0-9_])_([^_\n]{1,60}?)_(?![A-Za-zА-Яа-яёЁ0-9_])", r"<em>\1</em>", s)

    @staticmethod
    def _glyphs(s: str) -> str:
        return re.sub("|".join(GLYPHS), lambda m: f'<span class="glyph">{m[0]}</span>', s)

    def _capitals(self, s: str) -> str:
        return capitals(s, self.context.nouns) if self.caps else s

    @staticmethod
    def _spoiler(s: str) -> str:
        cover = lambda m: f" style=\"--spl-cover:url('{m[1]}')\"" if m[1] else ""
        return re.sub(r'(?s)\[spl(?:="([^"]*)")?\](.*?)\[/spl\]', lambda m: f'<span class="spoiler"{cover(m)}><span class="spoiler-content">{m[2]}</span></span>', s)

    #: The passes over inline text, in their order.
    CASCADE = ("notes", "internal", "reference", "terms", "external", "italic", "glyphs", "capitals", "spoiler")

    def inline(self, text: str, but: tuple[str, ...] = ()) -> str:
        s = escape(text)
        for name in self.CASCADE:
            if name not in but:
                s = getattr(self, f"_{name}")(s)
        return s

    def lines(self, text: str) -> str:
        return "<br>\n".join(x for x in (self.inline(line.strip()) for line in text.split("\n")) if x)

    # -- blocks -----------------------------------------------------------------------------

    def heading(self, b: dict) -> str:
        own, level = b.get("slug") or slug(b["text"]), min(max(b["level"], 2), 3)
        seen = dict(self.seen)
        label = self.inline(" ".join(re.sub(r"\[\^[^\]\s]+\]", "", b["text"]).split()))
        self.seen = seen
        self.contents.append((level, own, label))
        return f'<h{level} id="{own}">{self.inline(b["text"])} {_UP}</h{level}>'

    def paragraph(self, b: dict) -> str:
        return f"<p>{self.lines(b['text'])}</p>"

    def poem(self, b: dict) -> str:
        body = "\n".join(self.inline(x, but=("capitals",)) for x in b["inner"].strip("\n").split("\n"))
        title = b["attrs"].get("title")
        shown = f'<div class="poem-title">{escape(title)}</div>' if title else ""
        return f'<div class="poem">{shown}{capitals(body, self.context.nouns, merged=True) if self.caps else body}</div>'

    def framed(self, b: dict) -> str:
        kind, cite = b["attrs"].get("kind"), b["attrs"].get("cite")
        paras = "".join(f"<p>{self.lines(p)}</p>" for p in re.split(r"\n\s*\n", b["inner"].strip("\n")) if p.strip())
        name = "epigraph" if b["type"] == "epi" else "quote"
        return f'<blockquote class="{name}{f" {kind}" if kind else ""}">{paras}{f"<cite>{self.inline(cite)}</cite>" if cite else ""}</blockquote>'

    def simple(self, b: dict) -> str:
        tag = "p" if b["type"] in ("sub", "subsec", "sig", "line") else "div"
        kind = b["attrs"].get("kind")
        return f'<{tag} class="{b["type"]}{f" {kind}" if kind else ""}">{self.lines(b["inner"])}</{tag}>'

    def bullets(self, b: dict) -> str:
        items = [x for x in (x.strip() for x in f"\n{b['inner']}".split("\n- ")) if x]
        return "<ul>" + "".join(f"<li>{self.lines(x)}</li>" for x in items) + "</ul>"

    def numbers(self, b: dict) -> str:
        """Items keep their author's numbers; blocks inside an item are rendered under it."""
        split = r"\n(?=\d+[.)]\s)" if re.search(r"(?m)^\d+[.)]\s*\[\w+", b["inner"]) else r"\n\s*\n"
        out, last = [], 0
        for raw in re.split(split, b["inner"].strip("\n")):
            m = re.match(r"(\d+)([.)])\s*", raw.strip())
            last = int(m[1]) if m else last + 1
            rest = raw.strip()[m.end() :] if m else raw.strip()
            inner = "\n".join(self.block(x) for x in parse_blocks(rest)) if rest.startswith("[") else self.lines(rest)
            out.append(f'<li value="{last}">{inner}</li>')
        return '<ol class="num">' + "".join(out) + "</ol>"

    def dialog(self, b: dict) -> str:
        """Explicit labels rule a whole block; else the label patterns; what has no label belongs to the open post."""
        paras = [p.strip() for p in re.split(r"\n\s*\n", b["inner"].strip("\n")) if p.strip()]
        explicit = any(p.startswith(">>") for p in paras)
        posts: list[tuple[str | None, list[str]]] = []
        for p in paras:
            head, _, rest = p.partition("\n")
            label, said = (head[2:].strip(), rest) if p.startswith(">>") else (None, p) if explicit else spoken(p)
            if label is not None or not posts:
                posts.append((label, []))
            if said.strip():
                posts[-1][1].append(self.lines(said))
        who = lambda x: f'<b class="who">{self.inline(x)}</b>' if x is not None else ""
        return '<div class="dlg">' + "".join(f'<div class="post">{who(label)}{"".join(f"<p>{s}</p>" for s in said)}</div>' for label, said in posts) + "</div>"

    def free_verse(self, b: dict) -> str:
        """Switched on: lines in turn a and b, stanzas by ``sta``, paragraphs at bare point marks; else prose."""
        parts = [" ".join(x.split()) for x in top_level(b["inner"])]
        parts = [p for p in parts if p]
        if not self.verse:
            return self._as_prose(" ".join(parts))
        size = int(b["attrs"]["sta"]) if b["attrs"].get("sta", "").isdigit() else 0
        paras: list[list[str]] = [[]]
        for n, part in enumerate(parts):
            if part.startswith("[fp]"):
                part = part[4:].strip()
                paras += [[]] if paras[-1] else []
            end = " faw-se" if size and (n + 1) % size == 0 and n < len(parts) - 1 else ""
            paras[-1].append(f'<span class="faw-l {"ab"[n % 2]}{end}">{self._points(part)}</span>')
        return '<div class="faw">' + "".join('<div class="faw-p">' + "\n".join(p) + "</div>" for p in paras if p) + "</div>"

    def _badge(self, raw: str) -> str:
        given = attributes(raw)
        label = given.get("label", "").strip()
        if not label:
            return ""
        own = given.get("slug") or slug(label)
        self.contents.append((2, own, escape(label)))
        return f'<span class="faw-pt" id="{own}">{escape(label)}</span>'

    def _points(self, part: str) -> str:
        pieces = _POINT.split(part)  # text, attributes, text, ...
        out, capital = [], False
        for k, piece in enumerate(pieces):
            if k % 2:
                out.append(self._badge(piece))
                continue
            said = self.inline(piece)
            if not capital and (m := re.match(r"([^\w<]*)([^\W\d_])", said)):
                said = f'{m[1]}<span class="faw-cap">{m[2]}</span>{said[m.end() :]}'
                capital = True
            out.append(said)
        return "".join(out)

    def _as_prose(self, flat: str) -> str:
        pieces = _POINT.split(flat)
        out, badge = [], ""
        for k, piece in enumerate(pieces):
            if k % 2:
                badge = self._badge(piece)
                continue
            said = self.inline(" ".join(piece.split()))
            if badge or said:
                out.append(f"<p>{badge}{' ' if badge and said else ''}{said}</p>")
            badge = ""
        return "\n".join(out)

    def music(self, b: dict) -> str:
        rows = []
        for line in b["inner"].strip("\n").split("\n"):
            if line.startswith(">"):
                rows.append(f'<p class="mus-note">{self.inline(line[1:].strip())}</p>')
            elif m := re.fullmatch(r"\[([^|\]]*)\|([^|\]]*)\|?([^|\]]*)(?:\|(\d+))?\]", line.strip()):
                name = " — ".join(x for x in (m[3], m[2]) if x)
                group = b["attrs"].get("refs")
                own = f' id="cite_note-{note_key(group, m[4])}"' if m[4] and group else ""
                rows.append(f'<div class="track"{own}>' + (f'<a href="{escape(m[1])}">{self.inline(name)}</a>' if m[1] else self.inline(name)) + "</div>")
        label = b["attrs"].get("label")
        return '<div class="mus">' + (f"<h4>{self.inline(label)}</h4>" if label else "") + "".join(rows) + "</div>"

    def refs(self, b: dict) -> str:
        """A group of notes, once, at its first mark; a mark without notes left is flagged."""
        group = b.get("grp") or ""
        if group in self.shown or not any((n.get("grp") or "") == group for n in self.notes):
            return f'<!-- orphan-refs group="{group}" -->'
        self.shown.add(group)
        return self.note_list([n for n in self.notes if (n.get("grp") or "") == group])

    def note_list(self, notes: list[dict]) -> str:
        out = []
        for n in notes:
            body, kind = self.lines(n["body"]), n["kind"]
            key = note_key(n.get("grp"), str(n["id"])) if kind == "numbered" else note_key(None, n["star"]) if kind == "starred" else None
            back = f'<a class="backref" href="#cite_ref-{key}" title="{BACK_TO_TEXT}">↑</a> ' if key in self.asked else ""
            glyph = self.glyphs.get(n.get("grp") or "") if n.get("grp") else None
            if kind == "numbered" and not glyph:
                out.append(f'<li id="cite_note-{key}" value="{n["id"]}">{back}{body}</li>')
            elif key:
                mark = f"{escape(glyph)}{n['id']}" if glyph else n["star"]
                out.append(f'<li class="anon" id="cite_note-{key}">{back}{mark} {body}</li>')
            else:
                prefix = n.get("prefix")
                out.append(f'<li class="anon{"" if prefix is not None else " anon-bare"}">{f"{escape(prefix or SEE_ALSO)}: " if prefix is not None else ""}{body}</li>')
        return '<ol class="notes">\n' + "\n".join(out) + "\n</ol>"

    def image(self, b: dict) -> str:
        src, alt = b["attrs"].get("label") or b["attrs"].get("src", ""), b["attrs"].get("alt", "")
        return f'<img src="{_html.escape(src)}" alt="{_html.escape(alt)}">'

    FORMS = {"heading": heading, "paragraph": paragraph, "poem": poem, "epi": framed, "quote": framed, "ul": bullets, "num": numbers, "dlg": dialog, "faw": free_verse, "mus": music, "shir": music, "refs": refs, "img": image}

    def block(self, b: dict) -> str:
        return self.FORMS.get(b["type"], Renderer.simple)(self, b)

    def list_of_contents(self, attrs: dict, notes: bool) -> str:
        rows = self.contents + ([(2, "notes", self.fields.get("notes_title") or NOTES)] if notes else [])
        if not rows:
            return ""
        out, inner, item = [], False, False
        for level, own, label in rows:
            if level >= 3 and not inner:
                out.append("<ol>")
                inner = True
            elif level < 3:
                out.append(("</ol>" if inner else "") + ("</li>" if item else ""))
                inner, item = False, True
            out.append(f'<li><a href="#{own}">{label}</a>' + ("</li>" if level >= 3 else ""))
        out.append(("</ol>" if inner else "") + ("</li>" if item else ""))
        opened, bare = "" if attrs.get("collapsed") else " open", " nonum" if attrs.get("nonum") else ""
        return f'<details class="article-toc{bare}"{opened}><summary>{CONTENTS}</summary><ol>{"".join(out)}</ol></details>'

    def render(self) -> dict:
        out: list[str] = []
        marks: list[tuple[int, dict]] = []  # contents are known only at the end
        for b in self.blocks:
            if b["type"] == "toc":
                marks.append((len(out), b["attrs"]))
                out.append("")
            else:
                out.append(self.block(b))
        rest = [n for n in self.notes if (n.get("grp") or "") not in self.shown]
        if rest:
            out.append(f'<h2 id="notes">{self.inline(self.fields.get("notes_title") or NOTES)} {_UP}</h2>\n{self.note_list(rest)}')
        for at, attrs in marks[:1]:
            out[at] = self.list_of_contents(attrs, bool(rest))
        return {"html": "\n".join(x for x in out if x), "headings": sum(level < 9 for level, _, _ in self.contents), "error": None}


def spoken(paragraph: str) -> tuple[str | None, str]:
    """(label, words) by the label patterns of dialogue paragraphs."""
    from quillspark.functions.markup import SPEAKERS

    for pattern in SPEAKERS:
        if m := re.match(pattern, paragraph.lstrip()):
            return m[1].strip(), paragraph.lstrip()[m.end() :]
    return None, paragraph


def top_level(text: str, separator: str = "|") -> list[str]:
    """The parts of a text at separators outside square brackets; a closing bracket too many counts as none."""
    parts, depth = [""], 0
    for c in text:
        depth = max(0, depth + (c == "[") - (c == "]"))
        if c == separator and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def render(source: str | None, context: Context | dict[str, str] | None = None) -> dict:
    """The HTML of a document's body; a document that fails gives its error and stops no other."""
    try:
        return Renderer(source, Context(titles=context) if isinstance(context, dict) else context).render()
    except Exception as e:
        return {"html": None, "headings": None, "error": f"{type(e).__name__}: {e}"}


RENDERED = T.StructType().add("html", "string").add("headings", "integer").add("error", "string")
render_document = F.udf(render, RENDERED, useArrow=True)


def renderer(context: Context):
    """The rendering of a column of documents in one context, whose tables are of a size to be sent to all tasks."""
    return F.udf(lambda source: render(source, context), RENDERED, useArrow=True)


folded_capitals = F.udf(lambda s: None if s is None else capitals(s), T.StringType(), useArrow=True)


def filled(template: str, values: dict[str, str], last: str = "body") -> str:
    """A template with its marks replaced in the order of ``values``, the body at the end, so nothing in it is taken for a mark."""
    for name, value in [(k, v) for k, v in values.items() if k != last] + [(last, values.get(last, ""))]:
        template = template.replace("{{" + name + "}}", value)
    return template


def markdown(text: str) -> str:
    """Headings, lists, tables, quotes, code, bold and links of Markdown as HTML."""
    def inline(s: str) -> str:
        s = _html.escape(s, quote=False)
        s = re.sub(r"`([^`]+)`", r"<code>\1</code>", s)
        s = re.sub(r"\*\*([^*]+)\*\*", r"<b>\1</b>", s)
        return re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)

    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
        elif line.startswith("- "):
            items = []
            while i < len(lines) and lines[i].startswith("- "):
                items.append(f"<li>{inline(lines[i][2:])}</li>")
                i += 1
            out.append("<ul>" + "".join(items) + "</ul>")
            continue
        elif line.startswith("|"):
            rows = []
            while i < len(lines) and lines[i].startswith("|"):
                cells = [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", lines[i].strip())[1:-1]]
                if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                    rows.append("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in cells) + "</tr>")
                i += 1
            out.append("<table>" + "".join(rows) + "</table>")
            continue
        elif line.startswith("> "):
            out.append(f"<blockquote>{inline(line[2:])}</blockquote>")
        elif line.strip():
            out.append(f"<p>{inline(line)}</p>")
        i += 1
    return "\n".join(out)


markdown_html = F.udf(lambda s: None if s is None else markdown(s), T.StringType(), useArrow=True)
