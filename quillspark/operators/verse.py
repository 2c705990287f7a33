"""Verse segmentation: syllable groups, the cheapest split into lines, and the meter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import functions as F, types as T

from quillspark.functions.text import VOWELS

#: Cost of a line that is short by 0, 1, 2 ... syllables (fixed values); beyond, one more for each.
SHORT = (0.0, 1.2, 3.0, 4.5, 5.5, 6.5, 8.0, 10.0)
ENDS = ".,;:!?…—–-»)"
#: The mark of a paragraph that begins inside a text, and of a point in marked verse (fixed forms).
PARAGRAPH = "¶"
POINT = re.compile(r'\[fp\b(?:"[^"]*"|[^\]"])*\]')
STRIP = "«»„“”\"'().,;:!?…—–-"


def counter(known: dict[str, int] | None = None) -> Callable[[str], int]:
    """Syllables of a token: from the dictionary, as it is or stripped, else its vowels."""
    known = known or {}

    def count(token: str) -> int:
        low = token.lower()
        return known.get(low, known.get(low.strip(STRIP), sum(c in VOWELS for c in token)))

    return count


def dictionary(lines: Iterable[str]) -> dict[str, int]:
    """``token N`` lines, cut at the last space; blank and ``#`` lines don't count, any other line is an error."""
    known = {}
    for line in map(str.strip, lines):
        if line and not line.startswith("#"):
            token, _, number = line.rpartition(" ")
            if not token.strip() or not number.lstrip("-").isdigit():
                raise ValueError(f"bad dictionary line: {line}")
            known[token.strip().lower()] = int(number)
    return known


def override_blocks(text: str | None) -> list[list[str]]:
    """Blocks of lines, parted by blank lines; ``#`` lines don't count."""
    lines = [x.strip() for x in (text or "").replace("\r", "").split("\n")]
    blocks: list[list[str]] = [[]]
    for line in lines:
        if not line:
            blocks.append([])
        elif not line.startswith("#"):
            blocks[-1].append(line)
    return [b for b in blocks if b]


def labelled_tokens(text: str) -> list[tuple[str, str | None]]:
    """Tokens, each with the section or paragraph mark that it begins: ``=== name ===`` lines name sections."""
    out: list[tuple[str, str | None]] = []
    for k, part in enumerate(re.split(r"(?m)^[ \t]*===\s*(.+?)\s*===[ \t]*$", text)):
        if k % 2:
            name = part
            continue
        for words in map(str.split, re.split(r"\n[ \t]*\n+", part)):
            if words:
                mark = name if k and name else PARAGRAPH if out else None
                name = None
                out += [(words[0], mark), *((w, None) for w in words[1:])]
    return out


def fixed_cuts(words: list[str], blocks: list[list[str]]) -> tuple[set[int], set[int]]:
    """(forced, locked) places between tokens: the lines of a block stay as they are.  A block that isn't
    in the text is passed over; one that is there more than once is an error."""
    forced: set[int] = set()
    locked: set[int] = set()
    for block in blocks:
        wanted = [line.split() for line in block]
        flat = [w for line in wanted for w in line]
        places = [i for i in range(len(words) - len(flat) + 1) if words[i : i + len(flat)] == flat]
        if len(places) > 1:
            raise ValueError(f"override stands more than once: {block[0]}")
        for at in places:
            forced.add(at)
            for line in wanted:
                locked.update(range(at + 1, at + len(line)))
                at += len(line)
                forced.add(at)
    return forced, locked - forced


class Group(NamedTuple):
    text: str
    syllables: int
    label: str | None
    begin: int
    end: int


def groups_of(tokens: list[tuple[str, str | None]], count: Callable[[str], int], forced: set[int] = frozenset()) -> list[Group]:
    """Tokens without a syllable join the next word, before a forced cut and at the end the last."""
    out: list[Group] = []
    waiting: list[int] = []
    for i, (token, _) in enumerate(tokens):
        n = count(token)
        waiting.append(i)
        close = not n and (i + 1 == len(tokens) or i + 1 in forced)
        if not n and not (close and out):
            continue
        text = " ".join(tokens[k][0] for k in waiting)
        if n:
            out.append(Group(text, n, next((tokens[k][1] for k in waiting if tokens[k][1]), None), waiting[0], i + 1))
        else:
            out[-1] = out[-1]._replace(text=f"{out[-1].text} {text}", end=i + 1)
        waiting = []
    return out


def line_cost(size: int, meter: int) -> float:
    if size > meter:
        return 2.0 + 2.5 * (size - meter - 1)
    missing = meter - size
    return SHORT[missing] if missing < len(SHORT) else 10.0 + missing - 7


def bonus(text: str) -> float:
    return 0.5 if text[-1] in ".!?" else 0.35 if text[-1] in ENDS else 0.0


def split_lines(groups: list[Group], meter: int, forced: set[int] = frozenset(), locked: set[int] = frozenset()) -> list[tuple[int, int]]:
    """(first, end) groups of each line of the cheapest split; of equal splits the one whose last
    line is shortest.  A line has at most meter + 6 syllables, crosses no forced cut and begins at no locked place."""
    best: list[tuple[float, int] | None] = [(0.0, -1)]
    for end in range(1, len(groups) + 1):
        here, size = None, 0
        if end == len(groups) or groups[end].begin not in locked:
            for first in range(end - 1, -1, -1):
                size += groups[first].syllables
                if size > meter + 6 or first < end - 1 and groups[first + 1].begin in forced:
                    break
                if best[first] is not None and groups[first].begin not in locked:
                    cost = best[first][0] + line_cost(size, meter) - bonus(groups[end - 1].text)
                    if here is None or cost < here[0]:
                        here = (cost, first)
        best.append(here)
    if best[-1] is None:
        raise ValueError(f"no split into lines of about {meter}")
    cuts, end = [], len(groups)
    while end:
        cuts.append((best[end][1], end))
        end = best[end][1]
    return cuts[::-1]


def detect_meter(groups: list[Group], low: int = 5, high: int = 14) -> int:
    """Of the meters within 0.03 of the best share of exact lines, the one of the largest share of
    lines that end in punctuation (to three places, half to even), then the largest."""
    table = []
    for meter in range(low, high + 1):
        lines = split_lines(groups, meter)
        exact = sum(sum(g.syllables for g in groups[a:b]) == meter for a, b in lines) / len(lines)
        ended = sum(groups[b - 1].text[-1] in ENDS for _, b in lines) / len(lines)
        table.append((meter, exact, float(round(Decimal(ended), 3))))
    top = max(r[1] for r in table)
    return max((r[2], r[0]) for r in table if r[1] >= top - 0.03)[1]


VERSE = T.StructType(
    [
        T.StructField("meter", T.LongType()),
        T.StructField("lines", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("syllables", T.LongType()), T.StructField("label", T.StringType())]))),
        T.StructField("error", T.StringType()),
    ]
)


def segmented(text: str | None, meter: int | None = None, known: dict[str, int] | None = None, overrides: str | None = None, low: int = 5, high: int = 14) -> dict:
    """The lines of a verse text: (meter, lines of text, syllables and the label that they begin with, error).

    The meter is found where it isn't given; the dictionary's counts come before vowels; lines of
    override blocks stay.  On an error the block stays as it was.
    """
    try:
        tokens = labelled_tokens(POINT.sub(" ", (text or "").replace("|", " ")))
        forced, locked = fixed_cuts([t[0] for t in tokens], override_blocks(overrides))
        groups = groups_of(tokens, counter(known), forced)
        if not groups:
            return {"meter": meter, "lines": [], "error": None}
        chosen = meter or detect_meter(groups, low, high)
        rows = [groups[a:b] for a, b in split_lines(groups, chosen, forced, locked)]
        lines = [{"text": " ".join(g.text for g in r), "syllables": sum(g.syllables for g in r), "label": next((g.label for g in r if g.label), None)} for r in rows]
        return {"meter": chosen, "lines": lines, "error": None}
    except Exception as e:
        return {"meter": None, "lines": None, "error": f"{type(e).__name__}: {e}"}


split_verse = F.udf(lambda text, meter: segmented(text, meter), VERSE, useArrow=True)


def splitter(known: dict[str, int] | None = None, low: int = 5, high: int = 14):
    """``split_verse`` with a dictionary of its own, and a column of override blocks."""
    return F.udf(lambda text, meter, overrides: segmented(text, meter, known, overrides, low, high), VERSE, useArrow=True)


def joined(found, text):
    """The text with `` | `` between lines and a point where a section or paragraph begins; on an error as it was."""
    point = lambda x: F.when(x["label"] == PARAGRAPH, "[fp] ").when(x["label"].isNotNull(), F.concat(F.lit('[fp="'), x["label"], F.lit('"] '))).otherwise("")
    return F.when(found["error"].isNull() & (F.size(found["lines"]) > 0), F.array_join(F.transform(found["lines"], lambda x: F.concat(point(x), x["text"])), " | ")).otherwise(text)


def marked(text, meter):
    """``joined`` of a text's own lines; marking twice changes nothing where no section is named."""
    return joined(split_verse(text, meter), text)
