"""Structured Streaming over the event table: windowed counts with a watermark, and the capped log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.sources.folders import work_folder


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of its files (a file source watches a folder; a single file is picked by name)."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped by the engine."""
    stamped = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stamped.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def run_once(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """What the stream gives over all that is there now: one availableNow run whose result is written as Parquet in the
    shared folder, by the executors; a batch that is run again after a failure writes the same files anew."""
    spark = stream.sparkSession
    base = work_folder(spark, "stream")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'whole' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.foreachBatch(store).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{base}/log").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")
