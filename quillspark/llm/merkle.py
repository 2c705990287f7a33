r"""Document fingerprints: Merkle trees over leaves, paragraphs and sections, in SQL functions.

A paragraph is a line; ``SECTION`` paragraphs make a section; inside a paragraph, leaves are
sentences cut after ``LEAF`` characters at most.  A paragraph's digest is the SHA-256 of
its text, a section's that of its paragraphs' digests, the root's that of its sections'
digests.  The fingerprint is one string::

    root ; section,section,... ; paragraphs/paragraphs/... ; leaves

with 32 hex digits of the root, 8 of each section, 8 of each paragraph (``/`` parts sections) and 8
(of XXH64) of each leaf.  Equal roots mean equal texts.  Where roots differ, sections and then
paragraphs that differ locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SECTION = 8
LEAF = 32
_PIECES = rf"[^.!?\n]{{0,{LEAF - 1}}}[.!?]+|[^.!?\n]{{1,{LEAF}}}"


def leaf_hashes(text: Column) -> Column:
    """The leaves of a text, in order, as array<int>.  No leaf crosses a line feed, so the leaves of a
    text are those of the lines before any line and of the lines from it on."""
    return F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), lambda x: F.shiftright(F.xxhash64(x), 32).cast("int"))


def _in_sections(items: Column) -> Column:
    sections = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / SECTION).cast("int"))
    return F.transform(sections, lambda i: F.array_join(F.slice(items, i * SECTION + 1, F.lit(SECTION)), ""))


def branches(text: Column) -> Column:
    """The fingerprint of a text down to its paragraphs: ``root;sections;paragraphs``."""
    digests = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    sections = F.transform(_in_sections(digests), lambda s: F.sha2(s, 256))
    first = F.substring(F.sha2(F.array_join(sections, ""), 256), 1, 32)
    short = F.array_join(F.transform(sections, lambda s: F.substring(s, 1, 8)), ",")
    return F.concat_ws(";", first, short, F.array_join(_in_sections(F.transform(digests, lambda d: F.substring(d, 1, 8))), "/"))


def with_leaves(upper: Column, hashes: Column) -> Column:
    """The whole fingerprint from its branches and leaves."""
    digits = F.transform(hashes, lambda x: F.substring(F.hex(x.cast("long") + F.lit(1 << 33)), 2, 8))
    return F.concat(upper, F.lit(";"), F.lower(F.array_join(digits, "")))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""
    known = F.coalesce(text, F.lit(""))
    return with_leaves(branches(known), leaf_hashes(known))


def root(fp: Column) -> Column:
    return F.substring_index(fp, ";", 1)


def leaves(fp: Column) -> Column:
    """The leaves of a fingerprint, in order, as hex digits."""
    return F.regexp_extract_all(F.substring_index(fp, ";", -1), F.lit("[0-9a-f]{8}"), F.lit(0))


def likeness_of(same_root: Column, x: Column, y: Column) -> Column:
    """The likeness of two trees from their leaves, best given as columns, which are then read once."""
    every = F.greatest(F.size(x) + F.size(y), F.lit(1))
    places = 2.0 * F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda n, k: n + k) / every
    shared = 2.0 * F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)), F.lit(1))
    return F.when(same_root, 1.0).otherwise(F.greatest(places, shared))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal roots; else the larger of two shares, of distinct leaves found in
    both trees wherever they stand, and of leaves that are equal place by place (repeated
    leaves count each time there)."""
    return likeness_of(root(a) == root(b), leaves(a), leaves(b))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs where two trees differ, place by place; only
    sections whose digests differ are entered."""
    part = lambda fp, k: F.split(F.split_part(fp, F.lit(";"), F.lit(k)), "[,/]", -1)
    sections = F.arrays_zip(part(a, 2).alias("da"), part(b, 2).alias("db"), part(a, 3).alias("pa"), part(b, 3).alias("pb"))

    def inside(section: Column, i: Column) -> Column:
        each = lambda c: F.regexp_extract_all(F.coalesce(section[c], F.lit("")), F.lit("[0-9a-f]{8}"), F.lit(0))
        pairs = F.arrays_zip(each("pa").alias("x"), each("pb").alias("y"))
        places = F.transform(pairs, lambda p, j: F.when(~p["x"].eqNullSafe(p["y"]), i * SECTION + j))
        return F.when(section["da"].eqNullSafe(section["db"]), F.array().cast("array<int>")).otherwise(F.array_compact(places))

    return F.flatten(F.transform(sections, inside))


def fingerprint_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the column ``fingerprint``; any row gets one, null texts that of an empty text,
    equal texts equal ones; no rows give no rows; other columns are carried."""
    return docs.withColumn("fingerprint", fingerprint(F.col(text_col)))


#: Ids drawn for each range to find where ranges of even size begin.
DRAWN = 20
#: Ranges at most; with more rows they only grow.
RANGES = 1024


def _range_of(value: Column, starts: list) -> Column:
    """How many of the sorted ``starts`` are at most ``value``, by binary search; 0 for null."""
    if not starts:
        return F.lit(0)

    def search(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(value >= F.lit(starts[middle]), search(middle + 1, b)).otherwise(search(a, middle))

    return F.when(value.isNull(), 0).otherwise(search(0, len(starts)))


def with_next(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``next``, the struct of the columns ``order`` of the row that follows in their ascending
    order (nulls first); after the last comes the first.  No two rows agree in all of ``order``.

    Rows are dealt by ranges of the first of these columns, whose bounds come from at most DRAWN values for each
    shuffle partition (those of least hash).  Neighbours inside a range come from a window over that
    range, neighbours across ranges from a table with one row for each range.
    """
    width = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), RANGES)
    first = order[0]
    known = rows.select(first).filter(F.col(first).isNotNull())
    drawn = sorted(r[0] for r in known.orderBy(F.xxhash64(first), first).limit(DRAWN * width).collect())
    starts = sorted(set(drawn[DRAWN::DRAWN]))
    me = F.struct(*order)
    dealt = rows.withColumn("__range", _range_of(F.col(first), starts))
    here = Window.partitionBy("__range").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    ranked = dealt.withColumn("__at", F.row_number().over(here)).withColumn("next", F.lead(me).over(here))
    firsts = ranked.filter("__at = 1").select("__range", me.alias("__first"))  # a row for each range
    by_range = Window.orderBy("__range")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = firsts.select("__range", F.coalesce(F.lead("__first").over(by_range), F.first("__first").over(whole)).alias("__next"))
    inner = ranked.filter("next is not null").drop("__at", "__range")
    last = ranked.filter("next is null").join(follows, "__range").withColumn("next", F.col("__next"))
    return inner.unionByName(last.select(inner.columns))


def against_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to it and to the next
    document's: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as
    many of the next document, in ascending order of doc_id, then of length, then of the text's hash.  Every
    row gives a row; rows equal in id and text are one place in that order.  Null texts are empty; a null id comes before
    all others; a single document is its own next; no rows give no rows; other columns are ignored.

    A text's tree is made once, where it is read: the branches, the leaves before the line that the
    edit begins in, and those from there on.  Texts are shuffled once, with their trees; a document
    sends its predecessor only the characters that the edit needs, its root and its leaves.  The
    edited tree takes over the leaves before the edit.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("h"), "text")
    key = lambda row: F.concat_ws("|", F.concat(F.lit("="), row["doc_id"].cast("string")), row["n"].cast("string"), row["h"].cast("string"))
    own = {c: F.col(c) for c in ("doc_id", "n", "h")}
    need = F.floor(F.col("n") / 4).cast("int")
    kept = F.left("text", F.col("n") - need)
    line = F.length(kept) - F.length(F.substring_index(kept, "\n", -1))  # where the line begins that the edit is in
    cut = placed.select(key(own).alias("key"), "doc_id", "n", need.alias("need"), line.alias("line"), "text")
    made = cut.select(
        "key",
        F.struct(
            "doc_id",
            "n",
            "need",
            "line",
            "text",
            branches(F.col("text")).alias("branches"),
            leaf_hashes(F.left("text", F.col("line"))).alias("before"),
            leaf_hashes(F.substring("text", F.col("line") + 1, F.col("n"))).alias("after"),
        ).alias("row"),
    )
    # one struct, and a count that both joins ask for, so they share one exchange of the texts
    texts = made.groupBy("key").agg(F.first("row").alias("row"), F.count("*").alias("times")).filter("times > 0")
    # places come from a narrow scan of their own, so texts are shuffled once
    order = with_next(placed.select("doc_id", "n", "h").distinct(), ["doc_id", "n", "h"])
    needs = order.select(key(own).alias("to"), key(F.col("next")).alias("next_key"), need.alias("wanted"))
    sent = needs.join(texts, F.col("next_key") == F.col("key")).select(
        "to", F.left("row.text", F.col("wanted")).alias("taken"), root(F.col("row.branches")).alias("next_root"), F.concat("row.before", "row.after").alias("next_leaves")
    )
    both = texts.join(sent, F.col("key") == F.col("to")).select("row.*", "times", "taken", "next_root", "next_leaves")
    edited = F.concat(F.left("text", F.col("n") - F.col("need")), "taken")
    both = both.withColumn("edited", edited)
    both = both.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "branches",
        branches(F.col("edited")).alias("edited_branches"),
        "next_root",
        F.concat("before", "after").alias("own"),
        F.concat("before", leaf_hashes(F.substring("edited", F.col("line") + 1, F.length("edited")))).alias("changed"),
        "next_leaves",
        F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("again"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        with_leaves(F.col("branches"), F.col("own")).alias("fingerprint"),
        with_leaves(F.col("edited_branches"), F.col("changed")).alias("edited_fingerprint"),
        likeness_of(root(F.col("branches")) == root(F.col("edited_branches")), F.col("own"), F.col("changed")).alias("near_edited"),
        likeness_of(root(F.col("branches")) == F.col("next_root"), F.col("own"), F.col("next_leaves")).alias("near_next"),
    )
