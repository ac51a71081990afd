"""Intermediate tables: written once to the shared folder, then read back.

The folder is the one named by ``spark.checkpoint.dir`` (see
``quire.session.ensure_checkpoint_dir``), so every executor can read what any
other wrote and a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from quire.session import ensure_checkpoint_dir


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under a fresh folder and return the written table."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
