"""Near-duplicate removal: SimHash links and, for what they can't reach, MinHash keys make candidates; shingle sets decide.

Candidates come through operator 5 (``simhash.links``): SimHash fingerprints that differ in at
most MOST_BITS bits, found without loss over anchors.  Pairs of similarity 0.8 differ in ten bits on
average, more than anchors can cover, so those that operator 5 doesn't link are found beside it.
A set of distinct word shingles has BANDS keys, each made of ROWS minima of the set under
hash functions of their own.  Two sets of Jaccard similarity s share a key with
probability s^ROWS, whatever their sizes, so a pair of similarity 0.8 shares none of the
BANDS keys with probability (1 - 0.8^5)^40 = 1.3e-7, a likelier one less often.  Sets that
share a key are candidates, without any other condition.  Shingle sets then decide exactly
within the candidates' components, so neither a fingerprint nor a key alone removes a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.bytespans import Words, mix
from quillspark.llm.common import checkpointed, fresh, map_blocks, whole_groups
from quillspark.llm.components import components
from quillspark.llm.simhash import links, majority_bits

MOST_BITS = 4
BANDS = 40
ROWS = 5
#: Documents of one candidate component that are checked in one task: as probes, and as those they meet.
CHECK_TILE = 2048
#: Odd factors, one for each hash function.
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _shingles(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = Words(texts, lower=True).shingles(words)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]


def band_keys(sets: list[bytes]) -> np.ndarray:
    """(sets, BANDS) keys of sets that aren't empty."""
    shingles = np.frombuffer(b"".join(sets), np.uint64)
    first = np.cumsum([0, *(len(x) // 8 for x in sets)])[:-1]
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k, factor in enumerate(_FACTORS if sets else ()):
        band = k // ROWS
        least = np.minimum.reduceat(shingles * factor, first)
        out[:, band] = mix((out[:, band] if k % ROWS else np.uint64(band + 1)) * np.uint64(31) + least)
    return out


def _prints(rows: DataFrame, words: int) -> DataFrame:
    """(id, k, h, node, node2, fp, keys) of each row: its set's 128-bit name, SimHash (0 if it is empty) and keys (none if it is empty)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = _shingles(batch.column("__t").to_pylist(), words)
        sets = [x.tobytes() for x in own]
        names = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
        fp = majority_bits(np.concatenate(own), np.cumsum([0, *(x.size for x in own)])).view(np.int64)
        keys = band_keys([x for x in sets if x]).view(np.int64).reshape(-1)
        ends = np.cumsum([0, *(BANDS * bool(x) for x in sets)])
        columns = [*(pa.array(np.ascontiguousarray(names[:, k])) for k in range(2)), pa.array(fp), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), batch.column("h"), *columns], names=["id", "k", "h", "node", "node2", "fp", "keys"])

    kind = rows.schema["id"].dataType.simpleString()
    return map_blocks(rows, run, f"id {kind}, k long, h long, node long, node2 long, fp long, keys array<long>", "__t")


def _span(probes: np.ndarray, near, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of probes x members.  ``near(p)``: members near probe p
    among those outside its component; labels are merged as links are found."""
    out = []
    for p in probes:
        other = near(p)
        if other.size:
            labels, pick = np.unique(label[other], return_index=True)
            out += [(p, int(j)) for j in other[pick]]
            label[np.isin(label, labels)] = label[p]
    return out


def _candidates(classes: DataFrame) -> DataFrame:
    """Links (u, v) of nodes: operator 5's over their fingerprints, and of every node with the least node of each of its keys."""
    full = classes.filter(F.size("keys") > 0).select("node", "fp", "keys")
    prints = checkpointed(full.groupBy("fp").agg(F.min("node").alias("first")))
    near = links(prints.select("fp"), MOST_BITS)
    near = near.join(prints.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    # equal fingerprints are one more key
    keys = full.select("node", F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("last")).filter("v < last").select("key", "v")
    shared = keys.join(least, "key").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    return shared.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _linked(rows: DataFrame, texts: DataFrame, words: int, similarity: float, width: int) -> DataFrame:
    """Links (u, v) that span, for each (root, tile), the pairs of at least ``similarity`` between probes and
    all rows; rows of an equal ``label`` are joined already."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = [x.tobytes() for x in _shingles(batch.column("__t").to_pylist(), words)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(blobs, pa.binary())], names=[*names, "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            root, tile, probing, node, known = (table.column(k).to_numpy() for k in range(5))
            blobs = table.column(5).to_pylist()
            ends = np.concatenate([[0], np.flatnonzero((root[1:] != root[:-1]) | (tile[1:] != tile[:-1])) + 1, [root.size]])
            found: list[tuple[int, int]] = []
            for a, b in zip(ends[:-1], ends[1:]):
                own = [np.frombuffer(x, np.uint64) for x in blobs[a:b]]
                size = np.array([x.size for x in own])
                flat = np.concatenate(own)
                owner = np.repeat(np.arange(b - a), size)
                label = np.unique(known[a:b], return_inverse=True)[1]

                def near(p: int) -> np.ndarray:
                    # only members outside p's component and of a size that allows the similarity
                    open_ = (label != label[p]) & (size >= similarity * size[p] - 1e-9) & (similarity * size <= size[p] + 1e-9)
                    if not open_.any() or not size[p]:
                        return np.zeros(0, int)
                    pick = open_[owner]
                    at = np.minimum(np.searchsorted(own[p], flat[pick]), size[p] - 1)
                    both = np.bincount(owner[pick][own[p][at] == flat[pick]], minlength=b - a)
                    return np.flatnonzero(open_ & (both >= similarity * (size + size[p] - both) - 1e-9))

                found += [(a + int(p), a + q) for p, q in _span(np.flatnonzero(probing[a:b]), near, label)]
            if found:
                pair = np.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(node[pair[:, 0]]), pa.array(node[pair[:, 1]])], names=["u", "v"])

    names = ["root", "tile", "probes", "node", "label"]
    rows = map_blocks(rows.join(texts, ["k", "h"]).select(*names, "__t"), sets, "root long, tile long, probes boolean, node long, label long, shingles binary", "__t")
    return rows.repartition(width, "root", "tile").sortWithinPartitions("root", "tile").mapInArrow(run, "u long, v long")


def _tiles(n: str) -> Column:
    return F.ceil(F.col(n) / CHECK_TILE).cast("long")


def _place(tiles: str) -> Column:
    """The tile of a row among as many."""
    return F.pmod(F.xxhash64("node"), F.col(tiles))


def _checked(members: DataFrame, texts: DataFrame, words: int, similarity: float, width: int) -> DataFrame:
    """Links (u, v) that span the pairs of at least ``similarity`` in each candidate component (root) of members.

    A component of up to CHECK_TILE rows is checked at once.  A larger one is cut into tiles; each links
    its own rows, then one row of every part found meets those of the others, in rounds.  What remains are pairs between different parts:
    all rows outside the component's largest part meet all others, tile by tile.  So a large group of near
    copies is read a few times, however many tiles it has, and no pair is left out.
    """
    counts = members.groupBy("root").count()
    large = checkpointed(counts.filter(F.col("count") > CHECK_TILE).select("root", "count"))
    if large.isEmpty():
        whole = members.select("*", F.lit(0).cast("long").alias("tile"), F.lit(True).alias("probes"), F.col("node").alias("label"))
        return _linked(whole, texts, words, similarity, width)
    cut = members.join(large, "root", "left").withColumn("tiles", F.coalesce(_tiles("count"), F.lit(1).cast("long")))
    cut = cut.withColumn("tile", _place("tiles")).withColumn("probes", F.lit(True)).withColumn("label", F.col("node"))
    inside = checkpointed(_linked(cut, texts, words, similarity, width))
    big = members.join(large, "root")

    def parts(found: DataFrame) -> DataFrame:
        named = components(found).withColumnRenamed("root", "part")
        return checkpointed(big.join(named, "node", "left").withColumn("label", F.coalesce("part", "node")).drop("part"))

    # one row of each part meets the others', again as long as they fill several tiles and parts grow together
    across, labelled, more = inside, parts(inside), True
    while more:
        firsts = labelled.filter("node = label").drop("count")
        firsts = firsts.join(firsts.groupBy("root").agg(F.count("*").alias("firsts")).filter("firsts > 1"), "root").withColumn("tiles", _tiles("firsts"))
        firsts = checkpointed(firsts.withColumn("tile", _place("tiles")).withColumn("probes", F.lit(True)))
        found = checkpointed(_linked(firsts, texts, words, similarity, width))
        more = not firsts.filter("tiles > 1").isEmpty() and not found.isEmpty()
        across = across.unionByName(found)
        labelled = parts(across)
    sizes = labelled.groupBy("root", "label").count()
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("others")).filter("others > 0")
    open_ = labelled.join(checkpointed(main), "root").withColumn("ways", _tiles("others")).withColumn("tiles", _tiles("count"))
    asks = F.when(F.col("label") != F.col("main"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.struct((_place("ways") * F.col("tiles") + j).alias("tile"), F.lit(True).alias("probes"))))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1), lambda i: F.struct((i * F.col("tiles") + _place("tiles")).alias("tile"), F.lit(False).alias("probes")))
    spots = open_.withColumn("at", F.explode(F.concat(F.coalesce(asks, F.slice(meets, 1, 0)), meets))).select("root", "node", "k", "h", "label", "at.*")
    return across.unionByName(_linked(spots, texts, words, similarity, width))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows less all but one document of each near-duplicate group.

    A group is a component of links of at least ``similarity`` between the sets of word
    shingles; texts without letter case or white space differences count as equal.  The
    row of the smallest id stays (null ids last; of rows of one id that of the least text hash; of
    equal rows one).  Null and empty texts are copies of each other; a text of fewer words
    than a shingle is one shingle; only texts of equal shingle sets (by a 128-bit hash) are
    one before the check; other columns are carried; an empty table gives no rows.

    Rows are known by what they hold, hashes of id and text, not by their place, so the result
    doesn't depend on how a scan is split.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, mark = fresh(docs, "__k"), fresh(docs, "__h")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    known = docs.withColumn(mark, F.xxhash64(text)).withColumn(key, F.xxhash64(F.col(id_col), F.col(mark)))
    texts = known.select(F.col(id_col).alias("id"), F.col(key).alias("k"), F.col(mark).alias("h"), F.col(text_col).cast("binary").alias("__t"))
    prints = checkpointed(_prints(texts, words))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "k"))
    classes = checkpointed(prints.groupBy("node", "node2").agg(first.alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    found = components(_candidates(classes))
    members = checkpointed(classes.join(found, "node").select("root", "node", "least.k", "least.h"))
    groups = components(_checked(members, texts.select("k", "h", "__t"), words, similarity, width))
    rooted = classes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.k").alias(key), F.col("least.h").alias(mark))
    again = prints.groupBy(F.col("k").alias(key), F.col("h").alias(mark)).count().filter("count > 1").select(key, mark)
    again = checkpointed(kept.join(again, [key, mark]))  # kept rows that the table repeats
    if again.isEmpty():
        return known.join(kept, [key, mark], "left_semi").select(*docs.columns)
    once = known.join(kept.join(again, [key, mark], "left_anti"), [key, mark], "left_semi")
    return once.unionByName(known.join(again, [key, mark], "left_semi").dropDuplicates([key, mark])).select(*docs.columns)
