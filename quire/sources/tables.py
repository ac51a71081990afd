"""Driver tables: one parquet file (or folder) per table name."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Text tables whose per-row work (regex, tokenising, JSON parsing) is CPU
# heavy, with a unique spread key (even hash partitions that later joins or
# aggregations on the key can reuse).  Numeric tables are left as read: a
# repartition costs them more than the parallelism gains.
SPREAD_KEYS = {"documents": "doc_id", "pages": "page_id"}
MIN_SPREAD_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str | None, min_bytes: int = MIN_SPREAD_BYTES) -> DataFrame:
    """Give an under-split input as many partitions as the cluster has cores.

    Large inputs arrive as thousands of file splits and are returned as is;
    only an input that is both non-trivial in size and read as fewer splits
    than cores (e.g. one big row group) is repartitioned, so CPU-heavy
    per-row work (regex, tokenising) is not confined to one task.
    """
    spark = df.sparkSession
    try:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no JVM handles (e.g. a remote session): read as is
        return df
    if size < min_bytes:
        return df
    n = cores * 2
    return df.repartition(n, key) if key else df.repartition(n)


DEALT_BYTES = 8 << 20  # of a table's files: what one task holds of a table dealt by a key


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df``, a table as read, dealt by ``key`` into one part per ``DEALT_BYTES``
    of its files, the session's shuffle partitions at least: a task's share stays
    the same however large the table grows.  Without a size: by the session's number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no JVM handles (e.g. a remote session)
        return df.repartition(key)
    return df.repartition(max(n, -(-size // DEALT_BYTES)), key)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` reads on first use.

    Reads are plain parquet scans, so column pruning and filter pushdown
    reach the files from whatever the caller selects downstream (they pass
    through the optional repartition of ``spread``).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, spread_inputs: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.spread_inputs = spread_inputs

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = read_table(self.spark, self.sf_dir, name)
            if self.spread_inputs and name in SPREAD_KEYS:
                df = spread(df, SPREAD_KEYS[name])
            setattr(self, name, df)
            return df
        raise AttributeError(name)

    def dealt(self, name: str, key: str) -> DataFrame:
        return dealt(getattr(self, name), key)

    @cached_property
    def names(self) -> tuple[str, ...]:
        return TABLES
