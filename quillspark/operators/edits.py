"""Span edits, JSON and diff helpers over single texts (Arrow UDFs), and tokens in HTML."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F, types as T

EDIT = "array<struct<start:int,end:int,text:string>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def apply_edits(text: str, edits: list) -> tuple[str, int]:
    """Edits from right to left; one that overlaps an applied edit to its right is skipped."""
    limit, done = len(text) + 1, 0
    for e in sorted(edits, key=lambda e: (-e["start"], -e["end"])):
        if 0 <= e["start"] <= e["end"] <= min(limit, len(text)):
            text = text[: e["start"]] + e["text"] + text[e["end"] :]
            limit, done = e["start"], done + 1
    return text, done


@F.udf(T.StructType().add("text", "string").add("applied", "integer"), useArrow=True)
def edited(text, edits):
    if text is None:
        return None
    out, done = apply_edits(text, [e if isinstance(e, dict) else e.asDict() for e in edits or []])
    return {"text": out, "applied": done}


def balanced_json(text: str) -> str | None:
    """The first object or array in a text that parses."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        starts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not starts:
            return None
        at = min(starts)
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            at += 1


@F.udf(T.StringType(), useArrow=True)
def first_json(text):
    return None if text is None else balanced_json(text)


def elide(a: str, b: str, context: int = 45) -> tuple[str, str]:
    """Both texts without their common ends, but for some context."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)

    def cut(s: str) -> str:
        x, y = max(0, head - context), min(len(s), len(s) - tail + context)
        return ("…" if x else "") + s[x:y] + ("…" if y < len(s) else "")

    return cut(a), cut(b)


@F.udf(T.StructType().add("a", "string").add("b", "string"), useArrow=True)
def elided(a, b):
    return None if a is None or b is None else dict(zip("ab", elide(a, b)))


def outside(text: str, opening: str, closing: str, change) -> str:
    """``change`` applied to what lies outside paired regions; an unclosed region counts as text."""
    out, at = [], 0
    while (a := text.find(opening, at)) >= 0 and (b := text.find(closing, a + len(opening))) >= 0:
        out += [change(text[at:a]), text[a : b + len(closing)]]
        at = b + len(closing)
    return "".join([*out, change(text[at:])])


class _Tree(HTMLParser):
    """Nodes in document order; a closing tag closes up to its nearest open match, else nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def _add(self, tag, attrs, text=None):
        self.nodes.append({"id": len(self.nodes), "parent": self.open[-1] if self.open else None, "depth": len(self.open), "tag": tag, "attrs": {k: v or "" for k, v in attrs}, "text": text})

    def handle_starttag(self, tag, attrs):
        self._add(tag, attrs)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self._add("#text", [], data)


NODE = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("id", "parent", "depth")]
        + [T.StructField("tag", T.StringType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]
    )
)


def tree(html: str | None) -> list[dict]:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


html_nodes = F.udf(tree, NODE, useArrow=True)


def nested_anchors(html: str) -> str:
    """Anchors inside anchors lose their tags; scripts and styles are left alone."""
    out, depth, at = [], 0, 0
    raw = None
    for m in re.finditer(r"(?is)<(/?)(a|script|style)\b[^>]*>", html):
        out.append(html[at : m.start()])
        at = m.end()
        closing, tag = bool(m[1]), m[2].lower()
        if raw:
            raw = None if closing and tag == raw else raw
            out.append(m[0])
        elif tag != "a":
            raw = None if closing else tag
            out.append(m[0])
        elif not closing:
            depth += 1
            out.append(m[0] if depth == 1 else "")
        else:
            depth = max(depth - 1, 0)
            out.append(m[0] if depth == 0 else "")
    return "".join([*out, html[at:]])


unnested = F.udf(lambda html: None if html is None else nested_anchors(html), T.StringType(), useArrow=True)
