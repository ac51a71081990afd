"""Join helpers with checked broadcast sides.

A side is broadcast only when its size is proven: either it is a fixed
literal table, or ``limit(max_rows + 1).count()`` shows it is within
``max_rows`` (the limit stops the scan early).  Otherwise the join is a
normal shuffle join and AQE may still convert it at run time from the
measured shuffle size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 200_000


def is_bounded(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def literal_table(spark, rows, schema) -> DataFrame:
    """A fixed small table; safe to broadcast (size is the literal)."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def small_join(left: DataFrame, right: DataFrame, on, how: str = "inner",
               max_rows: int | None = DEFAULT_MAX_ROWS) -> DataFrame:
    """Join ``left`` to a side expected to be small.

    ``right`` is broadcast after a size check; above the bound the join
    falls back to a shuffle join on the same condition.
    """
    if max_rows is not None and is_bounded(right, max_rows):
        right = F.broadcast(right)
    return left.join(right, on, how)


BNLJ_MAX_ROWS = 1000
HEADS = 16  # lengths of pattern heads


def contains_join(left: DataFrame, text: str, right: DataFrame, pattern: str) -> DataFrame:
    """Rows where ``left[text]`` contains ``right[pattern]`` as a substring.

    One path at every size: a pattern is joined by its head to the distinct pieces
    of each text, then verified whole.  Heads and pieces have up to ``HEADS`` lengths,
    chosen among those of the patterns (a head is as long as the pattern allows; with
    few lengths it is the whole pattern), so patterns that begin alike do not meet
    every text.  Empty patterns are in every text.  Null texts and patterns match nothing.
    """
    full = right.where(F.length(pattern) > 0)
    lengths = full.select(F.length(pattern).alias("_n")).distinct().agg(F.sort_array(F.collect_list("_n")).alias("_s"))
    step = F.greatest(F.ceil(F.size("_s") / HEADS), F.lit(1)).cast("int")
    short = lengths.select(F.filter("_s", lambda n, i: i % step == 0).alias("_g"))  # one row
    pieces = F.array_distinct(F.flatten(F.transform(
        F.filter("_g", lambda g: g <= F.length(text)),
        lambda g: F.transform(F.sequence(F.lit(1), F.length(text) - g + 1), lambda i: F.substring(F.col(text), i, g)))))
    texts = left.crossJoin(F.broadcast(short)).withColumn("_piece", F.explode(pieces)).drop("_g")
    head = F.substring(F.col(pattern), F.lit(1), F.array_max(F.filter("_g", lambda g: g <= F.length(pattern))))
    heads = full.crossJoin(F.broadcast(short)).withColumn("_head", head).drop("_g")
    found = texts.join(heads, (F.col("_piece") == F.col("_head")) & F.contains(F.col(text), F.col(pattern))) \
        .drop("_piece", "_head")
    # empty patterns meet every text over a constant key (a row each, by definition)
    blank = right.where(F.length(pattern) == 0).withColumn("_one", F.lit(1))
    every = left.where(F.col(text).isNotNull()).withColumn("_one", F.lit(1)).join(blank, "_one").drop("_one")
    return found.unionByName(every)
