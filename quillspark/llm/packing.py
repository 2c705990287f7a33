"""Best-fit packing of tokenised documents by swap-based local search.

Only documents longer than a sequence are cut.  Their full pieces fill sequences alone;
what is left of each document, one remainder at most, is packed.  Remainders are dealt at
random into groups of about ``GROUP`` and each group is packed by itself: best fit in
decreasing order, then moves and exchanges between underfull sequences that increase the
sum of squared fills, so that light sequences run empty.  A group holds items of all
sizes, so it wastes about one sequence in thousands, and its size doesn't depend on the
corpus, its sources or its copies.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.bpe import byte_symbols
from quillspark.llm.common import checkpointed, map_blocks, tokenizer_path

#: Remainders packed together.
GROUP = 32768


class Tokenizer:
    """A byte-level BPE file without normalizer, whose ids are in merge order; special
    strings inside texts are special tokens, as the tokenizers library has it."""

    def __init__(self, text: str):
        import tiktoken
        from public_tokenizers import PATTERN

        spec = json.loads(text)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(to_byte[c] for c in surface): i for surface, i in spec["model"]["vocab"].items() if all(c in to_byte for c in surface)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in special:
            ranks.pop(s.encode(), None)
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all")


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a shorter first."""
    head = n % most or most
    return [(0, head), *((s, most) for s in range(head, n, most))]


def pieces(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of every document's ids and the end id."""
    with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    held: list[Tokenizer] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Tokenizer(shared.value))
        row, piece, start, length, crc, blob = [], [], [], [], [], []
        for i, text in enumerate(batch.column("t").to_pylist()):
            raw = np.append(held[0].ids(text or ""), end_id).astype("<u4").tobytes()
            for k, (s, n) in enumerate(cut_points(len(raw) // 4, most)):
                mine = raw[4 * s : 4 * (s + n)]
                row.append(i)
                piece.append(k)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(mine))
                if with_ids:
                    blob.append(mine)
        columns = [batch.column("i").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(blob, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_blocks(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run, schema, "t")


class Bins:
    """Bins of a capacity, with an index from free space to bins."""

    def __init__(self, most: int):
        self.most = most
        self.items: list[list[tuple[int, int]]] = []  # (size, item), ascending
        self.free: list[int] = []
        self._by_free: list[set[int]] = [set() for _ in range(most + 1)]
        self._some = 0  # bit f: a bin with f free

    def _index(self, b: int, free: int) -> None:
        old = self.free[b]
        self._by_free[old].discard(b)
        if not self._by_free[old]:
            self._some &= ~(1 << old)
        self.free[b] = free
        self._by_free[free].add(b)
        self._some |= 1 << free

    def fitting(self, size: int, but: int = -1) -> int:
        """The fullest bin with room for ``size``, not ``but``; -1 if none."""
        some = self._some >> size << size
        while some:
            f = (some & -some).bit_length() - 1
            for b in self._by_free[f]:
                if b != but and self.items[b]:
                    return b
            some &= some - 1
        return -1

    def put(self, b: int, entry: tuple[int, int]) -> None:
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.free.append(self.most)
            self._index(b, self.most)
        mine = self.items[b]
        mine.append(entry)
        mine.sort()
        self._index(b, self.free[b] - entry[0])

    def take(self, b: int, entry: tuple[int, int]) -> None:
        self.items[b].remove(entry)
        self._index(b, self.free[b] + entry[0])

    def used(self) -> int:
        return sum(map(bool, self.items))


def _exchange(bins: Bins, a: int, b: int) -> bool:
    """The best move or exchange that takes weight from the lighter bin a to the fuller b.

    Considered are one item for none, one for one, one for two and two for one; the gain
    in squared fill grows with the weight moved, so the best is the largest that fits b.
    """
    room = bins.free[b]
    best, give, get = 0, (), ()
    ones_a, ones_b = bins.items[a], bins.items[b]
    for x in ones_a:
        if best < x[0] <= room:
            best, give, get = x[0], (x,), ()
    pairs_b = [(y[0] + z[0], (y, z)) for i, y in enumerate(ones_b) for z in ones_b[i + 1 :]]
    pairs_a = [(y[0] + z[0], (y, z)) for i, y in enumerate(ones_a) for z in ones_a[i + 1 :]]
    for out, back in (([(x[0], (x,)) for x in ones_a], [(y[0], (y,)) for y in ones_b] + pairs_b), (pairs_a, [(y[0], (y,)) for y in ones_b])):
        for w, xs in out:
            for v, ys in back:
                if best < w - v <= room:
                    best, give, get = w - v, xs, ys
    if not best:
        return False
    for x in give:
        bins.take(a, x)
    for y in get:
        bins.take(b, y)
    for x in give:
        bins.put(b, x)
    for y in get:
        bins.put(a, y)
    return True


def pack(sizes: list[int], most: int, partners: int = 64) -> list[list[int]]:
    """Items in bins: best fit decreasing, then local search until nothing improves.

    The lightest bin gives weight away to the ``partners`` bins with most room, fuller than
    itself, as long as an exchange increases the squared fill; empty bins go.  The search
    ends when the lightest bins that still have a partner all fail, or when no fewer bins
    can hold the total.
    """
    bins = Bins(most)
    for size, item in sorted(((s, i) for i, s in enumerate(sizes)), reverse=True):
        bins.put(bins.fitting(size), (size, item))
    least = -(-sum(sizes) // most)
    failed: set[int] = set()
    while bins.used() > least:
        under = sorted((b for b in range(len(bins.items)) if bins.items[b] and bins.free[b]), key=lambda b: -bins.free[b])
        light = next((b for b in under[:partners] if b not in failed), None)
        if light is None:
            break
        moved = False
        for b in under[: partners + 1]:
            while b != light and bins.items[light] and bins.free[light] >= bins.free[b] > 0 and _exchange(bins, light, b):
                moved = True
            if not bins.items[light]:
                break
        if moved:
            failed.clear()
        else:
            failed.add(light)
    return [[i for _, i in b] for b in bins.items if b]


def place(found: DataFrame, most: int = 2048, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset.  ``found`` must be stored or deterministic."""
    full = found.filter(F.col("length") == most)
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = found.filter(F.col("length") < most)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_pylist()
        base = table.column("__group")[0].as_py() << 24
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for b, items in enumerate(pack(sizes, most)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = base + b, at
                at += sizes[i]
        kept = table.drop_columns(["__group"])
        return kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    placed = rest.groupBy("__group").applyInArrow(run, full.schema)
    return full.unionByName(placed)


def best_fit(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", most: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null and empty texts are the end id alone; rows of equal ids or texts are packed each for
    itself; a null id is kept; no rows give no rows; other columns are ignored.
    """
    return place(checkpointed(pieces(docs, tokenizer, most, id_col=id_col, text_col=text_col)), most)
