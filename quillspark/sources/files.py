"""File sources and sinks of a corpus: documents, catalogues, listings, bytes in other charsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def documents(spark: SparkSession, folder: str, ids: list[str] | None = None, suffix: str = ".doc") -> DataFrame:
    """(art, src) of the files with the suffix; ``ids`` restricts them; empty files give no row."""
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*){suffix.replace('.', chr(92) + '.')}$", 1)
    found = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True).select(name.alias("art"), F.col("value").alias("src"))
    return found.filter(F.col("art").isin(ids)) if ids is not None else found


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def xml_rows(spark: SparkSession, path: str, tag: str = "work", schema: str = "_url string, _link string") -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def listing(spark: SparkSession, folder: str, drop_names: list[str], drop_folders: list[str]) -> DataFrame:
    """(path, modified, length) of all files below a folder but for names and folders left out; empty files give no row."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    keep = ~F.regexp_extract("path", "([^/]+)$", 1).isin(drop_names)
    for d in drop_folders:
        keep = keep & ~F.contains("path", F.lit(f"/{d}/"))
    return found.filter(keep)


def decoded(raw: Column, charset: str = "windows-1251") -> Column:
    """Bytes of another charset as text; what can't be read becomes a replacement mark."""

    @F.udf("string", useArrow=True)
    def decode(b):
        return None if b is None else bytes(b).decode(charset, "replace")

    return decode(raw)


def comment_free(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a list file without blank and ``#`` lines."""
    return spark.read.text(path).filter("trim(value) <> '' and not trim(value) like '#%'").select(F.trim("value").alias("line"))


def pages_of(listing_pages: DataFrame, size: int = 50, keys: list[str] | None = None) -> DataFrame:
    """(keys, offset, pos, item) of paged listings up to and with each one's first short page; an item counts where it is first."""
    keys = keys or []
    first_short = listing_pages.filter(F.size("items") < size).groupBy(*keys).agg(F.min("offset").alias("last"))
    known = listing_pages.join(first_short, keys, "left") if keys else listing_pages.crossJoin(F.broadcast(first_short))  # one row without keys
    rows = known.filter(F.col("last").isNull() | (F.col("offset") <= F.col("last"))).select(*keys, "offset", F.posexplode("items").alias("pos", "item"))
    return rows.groupBy(*keys, "item").agg(F.min(F.struct("offset", "pos")).alias("at")).select(*keys, "at.offset", "at.pos", "item")


def publish(df: DataFrame, folder: str, partition: str | None = None) -> None:
    """Write a complete result in one commit: readers see the old or the new, never a part."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)


def publish_changed(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Only rows that are new or differ from what is published."""
    return new.join(old.select(key, F.struct(*old.columns).alias("__old")), key, "left").filter(~F.col("__old").eqNullSafe(F.struct(*(F.col(c) for c in old.columns)))).select(*new.columns)


def remaining(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return queue.join(done.select(key), key, "left_anti")
