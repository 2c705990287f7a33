"""License scans: winnowed template fingerprints pick candidates, banded alignment decides.

Templates are cut into words; of their hashed GRAM-word parts, winnowing keeps the least
of every WINDOW neighbours.  The kept hashes form an inverted index (hash to template and
place), of a size set by the templates alone.  All parts of a text are looked up, so
GRAM + WINDOW - 1 words in a row that agree with a template are enough to find it.  Of
templates of at most SHORT words all two-word parts are kept, so two words do.  Each
region found is aligned with its template (match 2, mismatch and gap -1, within BAND of
the diagonal); the share of template words matched is the coverage.  Before a region is aligned,
the words that template and band share, in any order, bound what can match: long templates meet
ordinary prose at little cost.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.bytespans import Rolling, Words
from quillspark.llm.common import map_blocks
from quillspark.llm.license_templates import TEMPLATES

GRAM = 3
WINDOW = 2
BAND = 8
LEAST = 0.8
#: Words of the longest template with which a coverage of LEAST may leave fewer than GRAM + WINDOW - 1 words in a row.
SHORT = 15
#: ASCII letters and digits and all bytes of other characters make words; the rest is space.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def fold(text: bytes | None) -> bytes:
    return text.lower().translate(_FOLD) if text else b""


def winnow(hashes: np.ndarray) -> list[int]:
    """Places of the least hash (the rightmost of equals) in every WINDOW neighbours."""
    last = max(hashes.size - WINDOW + 1, 1) if hashes.size else 0
    return sorted({max(range(i, min(i + WINDOW, hashes.size)), key=lambda j: (-int(hashes[j]), j)) for i in range(last)})


class Index:
    """The inverted index of templates."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        self.words = [fold(t.encode()).split() for t in templates.values()]
        self.bags = [Counter(w) for w in self.words]
        self.grams: set[int] = set()  # sizes of the parts
        found: list[tuple[int, int, int]] = []
        for k, words in enumerate(self.words):
            gram = min(2, len(words)) if len(words) <= SHORT else GRAM
            whole = Words([b" ".join(words)])
            hashes = Parts(whole, Rolling(whole.hashes()), gram).hashes
            places = range(hashes.size) if len(words) <= SHORT else winnow(hashes)
            found += [(int(hashes[at]), k, at) for at in places]
            self.grams.add(gram)
        found.sort()
        self.hashes = np.array([f[0] for f in found], np.uint64)
        self.places = [(f[1], f[2]) for f in found]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are in the index."""
        if not self.hashes.size:
            return np.zeros(hashes.size, bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
        return self.hashes[at] == hashes

    def at(self, value: int) -> list[tuple[int, int]]:
        a, b = np.searchsorted(self.hashes, np.array([value], np.uint64), "left")[0], np.searchsorted(self.hashes, np.array([value], np.uint64), "right")[0]
        return self.places[a:b]


class Parts:
    """The parts of ``gram`` words of folded texts."""

    def __init__(self, words: Words, rolling: Rolling, gram: int):
        index = np.arange(words.start.size)
        self.at = index[index + gram <= words.limit]
        self.hashes = rolling.windows(self.at, np.full(self.at.size, gram))


def align(template: list[bytes], words: list[bytes | None], diagonal: int) -> tuple[int, int, int, int]:
    """(score, matched words, first word, end word) of the best local alignment of the template with
    ``words``, where template word i stands near word i + diagonal.  None is a word that no alignment crosses."""
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}  # word -> (score, matched, first word)
    for i, t in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - BAND), min(len(words), i + diagonal + BAND + 1)):
            if words[j] is None:
                continue
            s, m, f = above.get(j - 1, (0, 0, j))
            same = t == words[j]
            cell = (s + 2, m + 1, f) if same else (s - 1, m, f)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[j] = cell
                if same and cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best


def matches(index: Index, words: list[bytes], hits: list[tuple[int, int]], least: float) -> list[tuple[str, int, int, int, float]]:
    """(template, matched, first word, end word, coverage) of one text, by first word.

    ``hits``: (word, hash) of the parts found in the index.  Of overlapping matches the
    one of most matched words stays.
    """
    regions: dict[int, list[int]] = {}
    for at, value in hits:
        for k, place in index.at(value):
            regions.setdefault(k, []).append(at - place)
    found = []
    for k, diagonals in regions.items():
        template, bag = index.words[k], index.bags[k]
        need = least * len(template)
        left: list[bytes | None] = list(words)
        while diagonals:
            # a neighbouring copy may hide another in the same band, so asked again without what is found
            best, again, last = [], [], None
            for d in sorted(set(diagonals)):
                if len(template) > SHORT and last is not None and d - last <= BAND // 2:
                    continue  # the band of the last alignment holds this one
                band = Counter(left[max(0, d - BAND) : max(0, d + len(template) + BAND)])
                if (bag & band).total() < need:
                    continue  # no alignment here can match enough words
                last = d
                _, m, a, b = align(template, left, d)
                if m and m >= need:
                    best.append((m, a, b))
                    again.append(d)
            for m, a, b in sorted(best, key=lambda x: (-x[0], x[1], x[2])):
                if None not in left[a:b]:
                    found.append((index.names[k], m, a, b, m / len(template)))
                    left[a:b] = [None] * (b - a)
            diagonals = again
    found.sort(key=lambda x: (-x[1], -x[4], x[2], x[0]))
    begins: list[int] = []  # of the matches kept, ascending; they don't overlap, so one look-up tells
    kept: list[tuple] = []
    for x in found:
        i = bisect_right(begins, x[2])
        if (i == 0 or kept[i - 1][3] <= x[2]) and (i == len(kept) or x[3] <= begins[i]):
            begins.insert(i, x[2])
            kept.insert(i, x)
    return kept


def templates_of(folder: str) -> dict[str, str]:
    """The texts (``*.txt`` or without an ending) of a folder of license texts, by file name, to be scanned for."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".txt") or "." not in n or n[-1].isdigit())
    out = {}
    for name in names:
        with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
            out[name.removesuffix(".txt")] = f.read()
    return out


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, matched_words, coverage, start_char, end_char): a row for each match.

    The span is in code points of the text.  Of alignments of one score the first found stays (the least template
    word, then the least word of the text); of overlapping matches the one of more matched words, then of
    higher coverage, of the earlier begin and of the lesser name.  Null, empty and unlicensed texts give no row;
    equal rows give equal matches; a null id is kept; no rows or templates give no rows; other columns are
    ignored.
    """
    held: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not held:
            held.append(Index(templates))
        index = held[0]
        texts = batch.column("t").to_pylist()
        folded = [fold(t) for t in texts]
        held_words = Words(folded)
        rolling = Rolling(held_words.hashes())
        parts = [Parts(held_words, rolling, gram) for gram in sorted(index.grams)]
        hit = [np.flatnonzero(index.lookup(p.hashes)) for p in parts]
        if not any(h.size for h in hit):
            return None
        at = np.concatenate([p.at[h] for p, h in zip(parts, hit)])
        hashes = np.concatenate([p.hashes[h] for p, h in zip(parts, hit)])
        doc = np.searchsorted(held_words.first, at, "right") - 1
        out: list[tuple] = []
        for d in np.unique(doc):
            mine = doc == d
            hits = list(zip((at[mine] - held_words.first[d]).tolist(), hashes[mine].tolist()))
            places = [m.span() for m in _WORD.finditer(folded[d])]
            words = [folded[d][a:b] for a, b in places]
            for name, m, a, b, coverage in matches(index, words, hits, least):
                start = len(texts[d][: places[a][0]].decode())
                out.append((int(d), name, m, coverage, start, start + len(texts[d][places[a][0] : places[b - 1][1]].decode())))
        if not out:
            return None
        row, *columns = zip(*out)
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
        names = ["doc_id", "license", "matched_words", "coverage", "start_char", "end_char"]
        return pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    return map_blocks(source, run, f"doc_id {kind}, license string, matched_words int, coverage double, start_char long, end_char long", "t")
