"""Lookup, precedence and audit joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def resolve(refs: DataFrame, targets: DataFrame, key: str, title: str, broken: str = "broken") -> DataFrame:
    """Every reference with its target's title; a reference without a target stays, flagged.

    ``targets`` holds one row for each key.  Spark picks the join from the sides' sizes.
    """
    known = targets.select(F.col(key), F.col(title)).withColumn("__known", F.lit(True))
    return refs.join(known, key, "left").withColumn(broken, F.col("__known").isNull()).drop("__known")


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): the value of the least ``order`` for each key, with map-side aggregation."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def two_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only = lambda x, y, side: x.join(y, key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def by_precedence(base: DataFrame, overrides: list[DataFrame], key: str, value: str) -> DataFrame:
    """The base's value replaced by the first override that has one."""
    out = base.withColumnRenamed(value, "__0")
    for i, o in enumerate(overrides, 1):
        out = out.join(o.select(key, F.col(value).alias(f"__{i}")), key, "left")
    order = [F.col(f"__{i}") for i in range(1, len(overrides) + 1)] + [F.col("__0")]
    return out.withColumn(value, F.coalesce(*order)).drop(*(f"__{i}" for i in range(len(overrides) + 1)))


def resolve_rules(rows: DataFrame, id_col: str, kinds: dict[str, str], rules: DataFrame, values: list[str], default: dict[str, str]) -> DataFrame:
    """(id, values): for each value the row's own setting, else that of the first rule that matches and has one,
    else the default.

    ``kinds`` maps a rule's kind to the row's column; ``rules``: (pos, kind, value, settings...).
    Each row is exploded to its (kind, value) pairs, so rules meet it by an equality join.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()))).alias("p")
    renamed = rules.select("pos", "kind", "value", *(F.col(v).alias(f"__{v}") for v in values))
    first = [F.min_by(f"__{v}", F.when(F.coalesce(F.col(f"__{v}"), F.lit("")) != "", F.col("pos"))).alias(f"__{v}") for v in values]
    matched = rows.select(id_col, pairs).select(id_col, "p.kind", "p.value").join(renamed, ["kind", "value"]).groupBy(id_col).agg(*first)
    blank = lambda c: F.nullif(c, F.lit(""))
    chosen = [F.coalesce(blank(F.col(v)) if v in rows.columns else F.lit(None), blank(F.col(f"__{v}")), F.lit(default[v])).alias(v) for v in values]
    return rows.join(matched, id_col, "left").select(id_col, *chosen)


def compare_and_swap(lines: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edits with ``status`` and the ``line`` after them: applied where the line equals ``before``, done where it
    equals ``after``, missing without such a line, ignored for kind TEXT, else mismatch."""
    both = edits.join(lines.select(*keys, F.col("line").alias("__line")), keys, "left")
    status = (
        F.when(F.col("kind") == "TEXT", "ignored")
        .when(F.col("__line").isNull(), "missing")
        .when(F.col("__line") == F.col("before"), "applied")
        .when(F.col("__line") == F.col("after"), "done")
        .otherwise("mismatch")
    )
    return both.withColumn("status", status).withColumn("line", F.when(F.col("status") == "applied", F.col("after")).otherwise(F.col("__line"))).drop("__line")


def frozen_violations(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``new`` that change a column of an existing row that must stay."""
    was = old.select(key, F.col(column).alias("old_value"))
    return new.join(was, key).filter(~F.col(column).eqNullSafe(F.col("old_value")))


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def to_run(queue: DataFrame, done: DataFrame, key: str, order: list[str], only: list | None = None, section: tuple[str, str] | None = None, limit: int | None = None, force: bool = False) -> DataFrame:
    """The rows of a queue that a run takes: given ids whatever their state, else what isn't done (all with ``force``), of one
    section if named, at most ``limit`` in the queue's order."""
    if only is not None:
        return queue.filter(F.col(key).isin(only))
    rows = queue if force else queue.join(done.select(key), key, "left_anti")
    if section:
        rows = rows.filter(F.col(section[0]) == section[1])
    return rows.orderBy(*order).limit(limit) if limit is not None else rows
