"""Tables that cut lineage: written once to the folder all executors share, then read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; any other session raises, since its executors would
    not see each other's files.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lodeframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, name: str = "cut", batch_rows: int | None = None, group_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the table read back.

    One pass over the plan, replicated by the file system, and later readers neither recompute it nor depend on the
    executors that made it. ``release`` deletes it. While it is written, Arrow batches hold ``batch_rows`` rows, if given.
    Row groups end after ``group_bytes``, if given: else Parquet first looks after 100 rows, and a task that writes or reads
    rows of megabytes holds all of these at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodeframe/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(batch_rows))
    try:
        sized = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1} if group_bytes else {}
        df.write.options(**sized).parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(key, before)
    return holding(spark.read.schema(df.schema).parquet(path), path)


def holding(df: DataFrame, *tables: DataFrame | str | None) -> DataFrame:
    """``df``, noting the tables (or paths) that it reads and that nothing else needs; ``release(df)`` deletes them."""
    held = list(getattr(df, "_lodeframe_paths", []))
    for t in tables:
        held += [t] if isinstance(t, str) else getattr(t, "_lodeframe_paths", [])
    df._lodeframe_paths = held
    return df


def release(*tables: DataFrame | None) -> None:
    """Deletes what ``cut`` wrote for these tables; nothing may read them any more."""
    for t in tables:
        for path in getattr(t, "_lodeframe_paths", []):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
