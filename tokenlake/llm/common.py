"""Shared pieces of the training-data operators: tables, scratch storage, word classes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII blanks that separate words in most contracts.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


#: Rows of text in one Arrow batch, so that a Python worker holds few megabytes at a time.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS; it counts when a query is planned, so it stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


_OPENED: ContextVar[list | None] = ContextVar("opened", default=None)


@contextmanager
def opening() -> Iterator[list[Scratch]]:
    """The Scratches that this thread opens meanwhile, for who clears them; other threads have their own."""
    opened: list[Scratch] = []
    before = _OPENED.set(opened)
    try:
        yield opened
    finally:
        _OPENED.reset(before)


class Scratch:
    """Tables written under the cluster's shared checkpoint folder, to cut lineage.

    A lost executor costs a reread of these files, not a recomputation. Where
    ``spark.checkpoint.dir`` is unset, a folder under the SQL warehouse serves
    on a single machine, as in tests; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = root or spark.conf.get("spark.sql.warehouse.dir")
        self.root = f"{root.rstrip('/')}/tokenlake-{name}-{uuid.uuid4().hex}"
        self.n = 0
        if (mine := _OPENED.get()) is not None:
            mine.append(self)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return a DataFrame that reads it."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table that write() returned."""
        self._delete(df._scratch_path)

    def clear(self) -> None:
        """Delete all tables; what reads them must have been written elsewhere."""
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """df with ``rank``, the 1-based position in the given order, without a one-task sort.

    Rows are range partitioned and written; positions are a running number in
    each range plus the sizes of the ranges before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.write(
        df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), name
    )
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range: as many as there are shuffle partitions
    before = sizes.select(
        "_range",
        (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"),
    )
    w = Window.partitionBy("_range").orderBy(*order)
    return (
        dealt.withColumn("_i", F.row_number().over(w))
        .join(F.broadcast(before), "_range")
        .withColumn("rank", F.col("_i") + F.col("_before"))
        .drop("_range", "_i", "_before")
    )


def map_texts(docs: DataFrame, work, out: str, keep: list[str], text: bool = False) -> DataFrame:
    """Run ``work(texts) -> list of Arrow arrays`` on batches of docs.text.

    Gives columns ``row`` (struct of the kept columns), ``out`` (struct of the
    made ones) and, on demand, ``text``. Structs keep names from clashing.
    """
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    fields = [x.split() for x in out.split(",")]
    names = [n for n, _ in fields]
    row = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(True).alias("_"))
    df = docs.select(row.alias("row"), docs["text"].cast("string").alias("text"))
    schema = f"row {df.schema['row'].dataType.simpleString()}, " + ("text string, " if text else "") + f"out struct<{','.join(f'{n}:{t}' for n, t in fields)}>"

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = pa.StructArray.from_arrays(work(b.column("text")), names)
                kept = [b.column("row")] + ([b.column("text")] if text else [])
                yield pa.record_batch([*kept, made], names=["row"] + ["text"] * text + ["out"])

    return df.mapInArrow(run, schema)
