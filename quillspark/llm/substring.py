"""Removal of long repeated passages by a compacted de Bruijn graph of words.

Edges of the graph are the word k-mers (windows of ``window`` words); a repeated edge is
one whose word sequence starts at two places or more.  The graph is never built edge by
edge over the corpus: consecutive windows of a document that share the least hash of
their ``GRAM``-word parts form a path without branches inside its document, and only
these paths (about one for every 14 windows) go through joins:

1. paths are counted by their least hash; one that stands alone can have no equal
   window in another path and leaves the graph;
2. where all paths of a hash are equal, the path is repeated as a whole.  The same count tells whether
   all its places have one path before it and one after it (the end of a document is a path of its own): the
   degrees of the nodes at its ends.  Joined with its degrees, each repeated path is compacted with the next
   where the node between them has one way in and one way out, so all places of a compacted path are whole;
3. where paths of a hash differ, the graph branches inside them: they are opened into
   their edges, which are counted per (hash, edge);
4. source coordinates (document, first word) bring the words of every compacted path back from its
   places, and the words themselves are compared; if any two differ under one hash, all windows of
   compacted paths are compared by their words instead;
5. coordinates bring the repeated paths and edges back to their texts, where they merge to spans;
   repeats within one document are found there.

Step 3 splits a hash with many paths by edge, so a passage of a third of all documents
spreads over tasks.  Documents are known by 128 bits of what their rows hold, not by their place in
a scan, so a lost task that reads its rows in another order changes nothing; equal rows share their marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.llm.bytespans import Rolling, Words
from quillspark.llm.common import checkpointed, fresh, map_blocks, whole_groups

#: Words of the parts whose least hash names a path.
GRAM = 8
#: Paths of one hash that are opened in one task; with more, edges are dealt over tasks.
PATHS_A_TASK = 2048


class _Paths:
    """The windows of a block of documents and the paths that they form."""

    def __init__(self, texts: list[bytes | None], window: int):
        self.words = w = Words(texts)
        index = np.arange(w.start.size)
        self.at = index[index + window <= w.limit]  # first word of each window
        self.rolling = Rolling(w.hashes())
        self.doc = np.searchsorted(w.first, self.at, "right") - 1
        self.window = window

    def edges(self) -> np.ndarray:
        return self.rolling.windows(self.at, np.full(self.at.size, self.window))

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, least hash, hash of all words) of each path."""
        gram = min(GRAM, self.window)
        n = self.words.start.size - gram + 1
        if not self.at.size:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
        least = self.rolling.windows(np.arange(n), np.full(n, gram))
        span = 1  # the least of `span` parts from each place, doubled up to what a window holds
        parts = self.window - gram + 1
        while 2 * span <= parts:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < parts:
            rest = parts - span
            least = np.minimum(least[:-rest], least[rest:])
        least = least[self.at]
        begins = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (self.doc[1:] != self.doc[:-1])]))
        sizes = np.diff(np.concatenate([begins, [self.at.size]]))
        whole = self.rolling.windows(self.at[begins], sizes + self.window - 1)
        return begins, sizes, least[begins], whole


def _paths(table: DataFrame, window: int, keys: list[str], held: str, bits: int) -> DataFrame:
    """(least, whole, prev, next, k, k2, first, n) of every path; prev and next are the hashes of its neighbours."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        p = _Paths(batch.column(held).to_pylist(), window)
        begins, sizes, least, whole = p.compact()
        if not begins.size:
            return None
        doc = p.doc[begins]
        whole = whole >> np.uint64(64 - bits)
        inner = doc[1:] == doc[:-1]
        prev, after = np.zeros(doc.size, np.int64), np.zeros(doc.size, np.int64)  # 0: the document's end
        prev[1:][inner], after[:-1][inner] = whole.view(np.int64)[:-1][inner], whole.view(np.int64)[1:][inner]
        place = [batch.column(k).to_numpy(zero_copy_only=False)[doc] for k in keys]
        first = p.at[begins] - p.words.first[doc]
        columns = (least.view(np.int64), whole.view(np.int64), prev, after, *place, first.astype(np.int32), sizes.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["least", "whole", "prev", "next", "k", "k2", "first", "n"])

    return map_blocks(table, run, "least long, whole long, prev long, next long, k long, k2 long, first int, n int", held)


def _opened(table: DataFrame, window: int, keys: list[str], held: str, opened: str) -> DataFrame:
    """The edges of the paths that branch, as (least, part, k, k2, first, at, edges)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        p = _Paths(batch.column(held).to_pylist(), window)
        edges = p.edges()
        offset = np.searchsorted(p.at, p.words.first[:-1])  # first window of each document
        out: list[tuple] = []
        places = zip(*(batch.column(k).to_pylist() for k in keys))
        for d, (place, paths) in enumerate(zip(places, batch.column(opened).to_pylist())):
            for x in paths:
                a = offset[d] + x["first"]
                mine = edges[a : a + x["n"]]
                if x["parts"] == 1:
                    out.append((x["least"], 0, *place, x["first"], None, mine.tobytes()))
                    continue
                part = (mine % np.uint64(x["parts"])).astype(np.int64)
                for k in np.unique(part):
                    at = np.flatnonzero(part == k)
                    out.append((x["least"], int(k), *place, x["first"], at.astype(np.int32).tobytes(), mine[at].tobytes()))
        if not out:
            return None
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        names = ["least", "part", "k", "k2", "first", "at", "edges"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return map_blocks(table, run, "least long, part int, k long, k2 long, first int, at binary, edges binary", held)


def _repeated(opened: DataFrame, width: int) -> DataFrame:
    """(k, k2, at): first words of the edges that occur at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, 2):
            least, part, k, k2, first, at, edges = (c.to_numpy() if i < 5 else c.to_pylist() for i, c in enumerate(group.columns))
            size = np.array([len(e) // 8 for e in edges])
            edge = np.frombuffer(b"".join(edges), np.uint64)
            where = np.concatenate([np.arange(n) if a is None else np.frombuffer(a, np.int32) for a, n in zip(at, size)]) + np.repeat(first, size)
            new = np.concatenate([[0], np.cumsum((least[1:] != least[:-1]) | (part[1:] != part[:-1]))])
            key = np.repeat(new, size)
            order = np.lexsort((edge, key))
            same = (edge[order][1:] == edge[order][:-1]) & (key[order][1:] == key[order][:-1])
            twice = np.zeros(edge.size, bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            row = np.repeat(np.arange(size.size), size)[twice]
            if not row.size:
                continue
            rows, begin = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, row.size).astype(np.int32)), pa.array(where[twice].astype(np.int32)))
            for a in range(0, rows.size, 10_000):
                here = rows[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(k[here]), pa.array(k2[here]), lists.slice(a, 10_000)], names=["k", "k2", "at"])

    dealt = opened.repartition(width, "least", "part").sortWithinPartitions("least", "part")
    return dealt.mapInArrow(run, "k long, k2 long, at array<int>")


def compacted(paths: list[dict]) -> list[tuple[int, int]]:
    """(first window, windows) of the compacted paths of one document: ``paths`` by first window, each with
    whether it has one neighbour before (``left``) and one after it (``right``) at all its places."""
    out: list[tuple[int, int]] = []
    free = False
    for x in sorted(paths, key=lambda x: x["first"]):
        if out and free and x["left"] and sum(out[-1]) == x["first"]:
            out[-1] = (out[-1][0], out[-1][1] + x["n"])
        else:
            out.append((x["first"], x["n"]))
        free = x["right"]
    return out


def _spans(table: DataFrame, window: int, keys: list[str], held: str, chain: str, bits: int, single: bool = False) -> DataFrame:
    """(key, n, words, k, k2, first): the words of every compacted path at each of its places; ``single``:
    of each of its windows instead."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = _Paths(batch.column(held).to_pylist(), window)
        w, buf = p.words, p.words.buf
        first, n, doc = [], [], []
        for d, paths in enumerate(batch.column(chain).to_pylist()):
            for a, m in compacted(paths):
                some = range(a, a + m) if single else (a,)
                first += some
                n += [1 if single else m] * len(some)
                doc += [d] * len(some)
        if not first:
            return
        first, n, doc = np.array(first), np.array(n), np.array(doc)
        place = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        for s in range(0, first.size, 4096):
            f, m, d = first[s : s + 4096], n[s : s + 4096], doc[s : s + 4096]
            a = w.first[d] + f
            key = (p.rolling.windows(a, m + window - 1) >> np.uint64(64 - bits)).view(np.int64)
            words = [buf[x:y] for x, y in zip(w.start[a].tolist(), w.end[a + m + window - 2].tolist())]
            columns = [pa.array(key), pa.array(m, pa.int32()), pa.array(words, pa.binary()), *(pa.array(x[d]) for x in place), pa.array(f, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "words", "k", "k2", "first"])

    return map_blocks(table, run, "key long, n int, words binary, k long, k2 long, first int", held)


def _row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all that a row holds."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(F.lit(seed), *(plain(f) for f in docs.schema.fields if not isinstance(f.dataType, T.VariantType)))


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked in ``gone``, each with the white space after it."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.append(begins[1:], raw.size)
    keep = np.ones(raw.size, bool)
    for i in np.flatnonzero(gone):
        keep[begins[i] : ends[i]] = False
    return raw[keep].tobytes().rstrip(b" \t\n\v\f\r") if gone[-1] else raw[keep].tobytes()


def remove_repeats(docs: DataFrame, window: int = 35, joined: bool = False, text_col: str = "text", bits: int = 64) -> DataFrame:
    """The input rows with their text less every word covered by a repeated window.

    A window of ``window`` words is repeated if its word sequence also starts anywhere
    else, in the same document too; windows are judged on the input.  ``joined``: the kept
    words joined by one space; otherwise white space stays as it was.  Added columns:
    n_words, n_removed long, and removed array<struct<first, n>>, the spans of words.
    ``bits`` of a path's hash are used; fewer give the comparison of words more to do, never another result.

    Null and empty texts have no words and become empty; texts of fewer words keep all;
    equal rows repeat each other; ids and other columns are carried and not looked at; an
    empty table gives no rows.  Columns named n_words, n_removed or removed are replaced.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    carried = [c for c in docs.columns if c not in ("n_words", "n_removed", "removed")]
    key, key2, held, marked, opened, chain = (fresh(docs, name) for name in ("__k", "__kk", "__t", "__marks", "__paths", "__chain"))
    keys = [key, key2]
    others = [c for c in carried if c != text_col]
    names = [F.col(f"`{c}`") for c in others]
    source = docs.select(*names, F.col(text_col).cast("binary").alias(held), _row_hash(docs, 1).alias(key), _row_hash(docs, 2).alias(key2))
    table = source.repartition(width, *keys)  # only what meets texts again shuffles them
    by_row = lambda rows: rows.groupBy(F.col("k").alias(key), F.col("k2").alias(key2))

    paths = _paths(source, window, keys, held, bits)
    one = lambda c: F.min(c) == F.max(c)
    known = paths.groupBy("least").agg(F.count("*").alias("c"), one("whole").alias("same"), one("prev").alias("left"), one("next").alias("right")).filter("c > 1")
    known = checkpointed(known)  # a row for each repeated hash; a common one's paths may be split in the join
    found = checkpointed(paths.select("least", "k", "k2", "first", "n").join(known, "least"))

    parts = F.ceil(F.col("c") / PATHS_A_TASK).cast("int").alias("parts")
    branching = by_row(found.filter("not same")).agg(F.collect_set(F.struct("least", "first", "n", parts)).alias(opened))
    edges = _repeated(_opened(table.join(branching, keys), window, keys, held, opened), width)
    single = edges.select("k", "k2", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("n"), "at")

    repeated = found.filter("same")
    placed = table.join(by_row(repeated).agg(F.collect_set(F.struct("first", "n", "left", "right")).alias(chain)), keys)
    words = _spans(placed, window, keys, held, chain, bits).groupBy("key", "n", "words").agg(F.count("*").alias("times"))
    doubted = words.groupBy("key", "n").agg(F.count("*").alias("variants"), F.sum("times").alias("times")).filter("variants > 1 or times < 2")
    if not doubted.isEmpty():  # different words under one hash: each window is compared by its words
        windows = _spans(placed, window, keys, held, chain, bits, single=True)
        repeated = windows.join(windows.groupBy("words").agg(F.count("*").alias("c")).filter("c > 1"), "words")
    whole = repeated.select("k", "k2", "first", "n", F.lit(None).cast("array<int>").alias("at"))
    marks = by_row(whole.unionByName(single)).agg(F.collect_set(F.struct("first", "n", "at")).alias(marked))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(held).to_pylist()
        p = _Paths(texts, window)
        edge = p.edges()
        order = np.lexsort((edge, p.doc))
        same = (edge[order][1:] == edge[order][:-1]) & (p.doc[order][1:] == p.doc[order][:-1])
        twice = np.zeros(edge.size, bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        step = np.zeros(p.words.start.size + 1, np.int64)  # +1 where cover begins, -1 where it ends
        np.add.at(step, p.at[twice], 1)
        np.add.at(step, p.at[twice] + window, -1)
        for d, marks_of in enumerate(batch.column(marked).to_pylist()):
            base = p.words.first[d]
            for x in marks_of or ():
                if x["at"] is None:
                    step[base + x["first"]] += 1
                    step[base + x["first"] + x["n"] + window - 1] -= 1
                else:
                    at = base + np.array(x["at"])
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        kept, words, removed, spans = [], [], [], []
        for d, text in enumerate(texts):
            a, b = p.words.first[d], p.words.first[d + 1]
            mine = gone[a:b]
            n = int(mine.sum())
            words.append(int(b - a))
            removed.append(n)
            edges_ = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
            spans.append([{"first": int(x), "n": int(y - x)} for x, y in zip(edges_[::2], edges_[1::2])])
            if joined:
                split = text.split() if text else []
                kept.append(b" ".join([w for w, g in zip(split, mine.tolist()) if not g] if n else split))
            else:
                kept.append(_cut(text, mine) if n else text or b"")
        out = [batch.column(c) for c in others] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())]
        out.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))))
        return pa.RecordBatch.from_arrays(out, names=[*others, text_col, "n_words", "n_removed", "removed"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in table.schema.fields if f.name in others)
    done = map_blocks(
        table.join(marks, keys, "left"), run, f"{kinds}`{text_col}` string, n_words long, n_removed long, removed array<struct<first:int,n:int>>", held
    )
    return done.select(*(F.col(f"`{c}`") for c in carried), "n_words", "n_removed", "removed")
