"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only in local mode, as in tests, that may be unset."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = getattr(context, "_cachesight_tables", None)
        if root is None:
            root = context._cachesight_tables = tempfile.mkdtemp(prefix="cachesight-")
    return f"{root.rstrip('/')}/cachesight/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: later jobs start from the files, also after a lost executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where rows are dealt out for a group-by, a window or a join that keeps them in memory.
TASK_ROWS = 250_000


def tasks(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """In how many parts to deal ``df`` out, so that a task has about ``rows`` rows whatever their number. Spark's own number is fixed.
    ``df`` is counted: it should be a table, of which footers tell."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def deal_finely(spark: SparkSession, rows: int) -> None:
    """Lets shuffles of the session begin with a part for every ``TASK_ROWS`` of ``rows``. Spark merges small ones up to its advisory
    size, but it never splits those of its own fixed number, whose tasks would grow with the tables."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if (wanted := -(-rows // TASK_ROWS)) > least:
        spark.conf.set(name, str(wanted))


_written: dict[tuple[str, str, str], str] = {}


def written_path(spark: SparkSession, source: str, name: str, write) -> str:
    """The folder that the first of this application's queries that need it has written by ``write(path)``."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _written:
        path = shared_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def written_once(spark: SparkSession, source: str, name: str, make) -> DataFrame:
    """``make()``, written by the first of this application's queries that need it, for the others to read."""
    return spark.read.parquet(written_path(spark, source, name, lambda path: make().write.parquet(path)))


def bucketed_once(spark: SparkSession, source: str, name: str, column: str, make) -> DataFrame:
    """As ``written_once``, but dealt out by ``column`` into buckets of about ``TASK_ROWS`` rows, which group-bys, windows and joins on
    keys that have the column read as they are, with no shuffle. ``make()`` gives the rows and the number of buckets."""
    table = lambda path: f"cachesight_{path.rsplit('-', 1)[1]}"

    def write(path: str) -> None:
        df, n = make()
        df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).saveAsTable(table(path))

    return spark.table(table(written_path(spark, source, name, write)))
