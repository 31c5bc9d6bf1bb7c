"""Session defaults and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", app: str = "lodeframe", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use; a cluster brings its own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LODEFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Catalyst prunes the columns and pushes the filters into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: So many rows of an input a task sorts or groups at most on average, where ``tasks`` gives the number of tasks.
TASK_ROWS = 1 << 20


def tasks(df: DataFrame) -> int:
    """How many tasks share the rows of an input: as many as shuffles have, more once each would get over ``TASK_ROWS``.

    The rows of a table are counted from the footers of its files.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def spread(df: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """``df`` hashed by columns into ``n`` tasks, or as many as shuffles have, for steps that make many rows of one.

    Adaptive execution joins small partitions by the size before such a step, down to one task; a given number stays.
    """
    return df.repartition(n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
