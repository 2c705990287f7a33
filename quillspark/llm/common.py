"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.bytespans import blocks

#: Bytes of text handled together inside a Python worker.
BLOCK_BYTES = 1 << 20


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies: a path is taken as it is, a bare name is looked up."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs on one
    machine (as in tests) a temporary folder is taken.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_blocks(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, size_of: str | None = None
) -> DataFrame:
    """``mapInArrow`` in blocks of about a megabyte of the column ``size_of``, so a worker's
    memory follows the block (or one long text), not the Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(size_of)] if size_of else [1] * batch.num_rows
            for a, b in blocks(sizes, BLOCK_BYTES):
                out = function(batch.slice(a, b - a))
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    out = (out,)
                yield from (x for x in out if x.num_rows)

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by their first ``keys`` columns (not null)."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in range(keys))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        last = key(batch, n - 1)
        same = None
        for k in range(keys):
            equal = pc.equal(batch.column(k), pa.scalar(last[k], batch.schema.field(k).type))
            same = equal if same is None else pc.and_(same, equal)
        cut = n - pc.sum(same).as_py()  # the last group begins here
        if held and (cut or key(held[-1], held[-1].num_rows - 1) != last):
            if key(held[-1], held[-1].num_rows - 1) == key(batch, 0):
                held.append(batch.slice(0, cut))
                head = 0
            else:
                head = cut
            yield pa.Table.from_batches(held)
            held = []
            if head:
                yield pa.Table.from_batches([batch.slice(0, head)])
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
