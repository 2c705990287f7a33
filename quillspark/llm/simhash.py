"""SimHash near-duplicate groups by anchor-point covering.

A document's fingerprint has 64 bits: bit i is 1 if it is set in more than half of the
XXH64 hashes of its word shingles.  Two fingerprints link at ``threshold`` or fewer
differing bits.

Anchor points.  The 64 bits are cut into ``parts`` fields.  Two fingerprints that differ
in at most ``threshold`` bits differ in at most ``threshold // parts`` bits of one field.
In each field the anchors are a covering code: the [15, 11] Hamming code on 15 bits beside
the other bits as they are, of covering radius 1.  A field's value therefore has a home
anchor at distance 0 or 1, and whatever lies within t of it lies within 1 + t of that
anchor.  Every fingerprint is replicated to all anchors of its fields within 1 + t, and
compared with the others there; no link can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.bytespans import Words
from quillspark.llm.common import checkpointed, map_blocks, whole_groups
from quillspark.llm.components import Forest, components

RADIUS = 1
CODE_BITS = 15
#: Fingerprints of one anchor that are compared as one tile; larger groups are tiled.
TILE = 4096
#: Up to this size groups are compared together, at every lag.
SMALL = 64
#: Keys of large groups that are broadcast, at most (16 bytes each).
HOT_BROADCAST = 100_000
#: From so many distinct fingerprints on, two wide fields select better than three.
WIDE_FROM = 1 << 27


def fingerprints_of(texts: list[bytes | None], words: int) -> np.ndarray:
    """The unsigned 64-bit SimHash of each text; 0 where it has no word."""
    return majority_bits(*Words(texts, lower=True).shingles(words))


def majority_bits(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits set in more than half of the hashes of each text, which begin at ``first``; 0 where there are none."""
    out = np.zeros(len(first) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for d in range(out.size):
        a, b = first[d], first[d + 1]
        if a < b:
            ones = np.zeros(64, np.int64)
            for c in range(a, b, 1 << 16):  # a long text in slices
                h = shingles[c : min(b, c + (1 << 16))]
                bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            out[d] = weights[2 * ones > b - a].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each input row; fp holds the unsigned bits."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints_of(batch.column("t").to_pylist(), words).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("i"), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    return map_blocks(source, run, f"doc_id {kind}, fp long", "t")


def fields_of(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each field."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


@lru_cache(maxsize=8)
def _masks(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits of which at most ``most`` are set."""
    return np.array([sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)], np.uint64)


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    """Syndrome of every 15-bit value in the Hamming code; 0 marks a codeword."""
    values = np.arange(1 << CODE_BITS)
    out = np.zeros(values.size, np.uint8)
    for bit in range(CODE_BITS):
        out ^= np.where(values >> bit & 1, bit + 1, 0).astype(np.uint8)
    return out


def anchors(fp: np.ndarray, parts: int, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(field, indexes of fp, anchors) of all fingerprints and the anchors that they go to."""
    syndrome = _syndromes()
    for field, (low, width) in enumerate(fields_of(parts)):
        value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for mask in _masks(width, RADIUS + threshold // parts):
            at = value ^ mask
            hit = np.flatnonzero(syndrome[(at & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)] == 0)
            if hit.size:
                yield field, hit, at[hit]


def _replicas(fps: DataFrame, parts: int, threshold: int) -> DataFrame:
    """(anchor, fp): anchor holds the field in its upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, all_fp.size, 4096):
                fp = all_fp[a : a + 4096]
                key, who = [], []
                for field, hit, at in anchors(fp.view(np.uint64), parts, threshold):
                    key.append((at | np.uint64(field << 40)).view(np.int64))
                    who.append(fp[hit])
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(who))], names=["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def tile_links(probes: np.ndarray, others: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that span the components of probes x others: at most one for each node."""
    nodes = np.concatenate([probes, others])
    label = np.arange(nodes.size)
    label[np.argsort(nodes, kind="stable")] = np.unique(nodes, return_inverse=True)[1][np.argsort(nodes, kind="stable")]
    out = []
    for i in range(probes.size):
        near = np.flatnonzero(np.bitwise_count(nodes ^ probes[i]) <= threshold)
        other = near[label[near] != label[i]]
        if other.size:
            labels, pick = np.unique(label[other], return_index=True)
            out += [(int(probes[i]), int(nodes[j])) for j in other[pick]]
            label[np.isin(label, labels)] = label[i]
    return out


def small_links(key: np.ndarray, fp: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links inside runs of equal keys, by comparing rows at every lag; spanning links only."""
    forest, out = Forest(), []
    live = np.arange(key.size)
    lag = 1
    while live.size:
        live = live[live + lag < key.size]
        live = live[key[live] == key[live + lag]]
        if live.size:
            hit = live[np.bitwise_count(fp[live] ^ fp[live + lag]) <= threshold]
            for x, y in zip(fp[hit].tolist(), fp[hit + lag].tolist()):
                if forest.join(x, y):
                    out.append((x, y))
        lag += 1
    return out


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1]))], names=["u", "v"])


def deal(rows: DataFrame, key: str, member: list[str], size: int) -> DataFrame:
    """Rows with the columns ``tile`` and ``probes``: groups of one key, cut for comparison.

    A group of more than ``size`` rows has as many tiles as it takes; each row is the
    probe of one tile and a member of all, so that tiles together compare all pairs.
    The few large keys are broadcast only if they are few; else they are joined.
    """
    hot = rows.groupBy(key).count().filter(F.col("count") > size).select(key, F.ceil(F.col("count") / size).cast("int").alias("tiles"))
    hot = checkpointed(hot)
    n = hot.count()
    if not n:
        return rows.withColumn("tile", F.lit(0)).withColumn("probes", F.lit(True))
    rows = rows.join(F.broadcast(hot) if n <= HOT_BROADCAST else hot, key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64(*member), F.col("tiles")).cast("int")
    rows = rows.withColumn("__own", own).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumn("probes", F.col("__own") == F.col("tile")).drop("__own", "tiles")


def links(fps: DataFrame, threshold: int = 4, parts: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints that give the components of all pairs with
    ``threshold`` or fewer differing bits.

    Anchor groups are streamed from sorted partitions.  A group of more than ``TILE``
    fingerprints is tiled: its members probe in chunks of about ``TILE``, each chunk in a
    task of its own against all members, so a hot anchor spreads over the cluster and
    no comparison is left out.  Each tile emits spanning links, never all its pairs.
    """
    parts = parts or (3 if fps.count() < WIDE_FROM else 2)
    rows = deal(_replicas(fps, parts, threshold), "anchor", ["fp"], TILE).select("anchor", "tile", "probes", "fp")
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "anchor", "tile").sortWithinPartitions("anchor", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            key, tile, probes, fp = (c.to_numpy() for c in table.columns)
            fp = fp.view(np.uint64)
            ends = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            size = np.diff(np.concatenate([[0], ends, [key.size]]))
            group = np.repeat(np.arange(size.size), size)
            big = np.repeat(size > SMALL, size)
            pairs = small_links(group[~big], fp[~big], threshold)
            for g in np.flatnonzero(size > SMALL):
                a, b = np.searchsorted(group, [g, g + 1])
                pairs += tile_links(fp[a:b][probes[a:b]], fp[a:b][~probes[a:b]], threshold)
            if pairs:
                yield _edge_batch(pairs)

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): one row for each input row.

    component_id is the smallest id reachable over links, itself included.  Null and empty
    texts have fingerprint zero and link like any other; rows of an equal id or text each
    get their row; an id that is null never becomes a component's least id unless all are
    null; no rows give no rows; other columns are ignored.
    """
    fps = checkpointed(fingerprints(docs, words, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), threshold))
    grouped = distinct.join(roots, distinct.fp == roots.node).select("fp", "least", "root")
    least = checkpointed(grouped.groupBy("root").agg(F.min("least").alias("component_id")))  # stored, so a large group may be split in the join
    named = grouped.join(least, "root").select("fp", "component_id")
    classes = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")
