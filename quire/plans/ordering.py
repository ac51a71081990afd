"""Exact global ordering without a single-task window.

A window with ``orderBy`` and no ``partitionBy`` runs in one task, and so does
the part of a window that belongs to one key.  These helpers number rows (or
accumulate) over a total order in two distributed steps:

1. rows are split into *buckets* that are monotone in the order (a prefix of
   a uniform hash, or ranges between sample quantiles), and a window runs
   inside each bucket;
2. per-bucket totals form a table with one row per bucket (bounded by the
   bucket count, not by the data); their exclusive prefix sums are
   broadcast back as offsets.

With a key, only hot keys are split: the ``MOST_HOT`` largest with more than
``HOT_ROWS`` rows.  Any other key has at most ``HOT_ROWS`` rows or a share of
1 / ``MOST_HOT`` of the table, and is one part of a plain window.  Whether a key
is hot is counted while the plan is built (``has_hot``); where none is, the plan
is that plain window.

Everything is deterministic: recomputation after an executor loss gives
the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_PREFIX_HEX = 4  # 16**4 = 65,536 buckets for hash-ordered data


def hash_key(*cols: Column | str, seed: int | str = 42) -> Column:
    """Deterministic shuffle key: md5 of the values and the seed (hex text).

    The same text is produced by DuckDB's ``md5``, so oracles can sort by it.
    """
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat(*parts, F.lit(str(seed))))


def hash_int(expr: Column, digits: int = 8) -> Column:
    """First ``digits`` hex digits of md5(expr) as a non-negative long."""
    return F.conv(F.substring(F.md5(expr.cast("string")), 1, digits), 16, 10).cast("long")


# DuckDB text of hash_int (8 hex digits -> bigint).
SQL_HASH_INT = ("list_reduce(list_transform(string_split(substr(md5(cast({} as varchar)), 1, 8), ''), "
                "lambda c: cast(position(c in '0123456789abcdef') - 1 as bigint)), lambda a, b: a * 16 + b)")


SAMPLES_PER_BUCKET = 32
FAN = 64  # boundaries under one head of the two-step search


def _sortable(df: DataFrame) -> list[str]:
    """Columns that can be hashed (maps cannot)."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]


def range_bucket(df: DataFrame, order: Sequence[str], buckets: int | None = None, name: str = "_bucket") -> DataFrame:
    """``df`` with a bucket id that is monotone in the whole ``order``.

    Boundaries are quantiles of a sample of rows, those with the smallest
    hashes over all their columns (so rows that share an order value are
    sampled each for itself), at most ``SAMPLES_PER_BUCKET`` per bucket
    whatever the table's size.  They form one row, computed when the query runs
    (no job while the plan is built) and are a pure function of the data, so every branch
    of a plan and every recomputation sees the same buckets (unlike physical
    partition ids).  Any sortable types will do; rows with one order value are in
    one bucket.  Nulls sort first.
    """
    n = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    size = n * SAMPLES_PER_BUCKET
    key = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sample = df.select(key.alias("k"), F.xxhash64(*_sortable(df)).alias("h")).orderBy("h", "k").limit(size)
    ends = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))  # one row
    # every ``step``-th sample value ends a bucket; every FAN-th end is a head
    step = F.greatest(F.floor(F.size("s") / n), F.lit(1)).cast("int")
    picks = ends.select(F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (i % step == 0))).alias("ends"))
    # scalar subqueries: computed once when the query runs, not carried by the rows
    all_ends = picks.scalar()
    heads = picks.select(F.filter("ends", lambda x, i: i % FAN == 0)).scalar()

    def below(bounds: Column) -> Column:
        """How many of the sorted bounds the row is above (higher-order functions take no subquery)."""
        return (F.array_position(F.sort_array(F.array_append(bounds, F.col("_at"))), F.col("_at")) - 1).cast("int")

    rows = df.withColumn("_at", key)
    rows = rows.withColumn("_head", F.greatest(below(heads) - 1, F.lit(0)) * FAN)
    return rows.withColumn(name, F.col("_head") + below(F.slice(all_ends, F.col("_head") + 1, F.lit(FAN)))) \
        .drop("_at", "_head")


HOT_ROWS = 1 << 20   # rows of a key that one task may sort
MOST_HOT = 512       # hot keys that are split
HOT_SLOTS = 1 << 14  # slots of key hashes that are counted before keys are
HOT_BUCKETS = 1024   # most buckets of one hot key


def hot_keys(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """(names, _n) of the ``MOST_HOT`` largest keys with more than ``HOT_ROWS`` rows.

    Rows are counted by slots of the key's hash first (``HOT_SLOTS`` rows a task
    at most), keys only in slots that hold more than ``HOT_ROWS`` rows, so a table
    without hot keys is not shuffled by key for the count."""
    r = rows.select(*names, F.pmod(F.xxhash64(*names), F.lit(HOT_SLOTS)).alias("_slot"))
    slots = r.groupBy("_slot").agg(F.count("*").alias("_rows")).where(F.col("_rows") > HOT_ROWS).select("_slot")
    counts = r.join(F.broadcast(slots), "_slot", "left_semi").groupBy(*names).agg(F.count("*").alias("_n"))
    return counts.where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n")).limit(MOST_HOT)  # so many rows at most


def has_hot(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key of ``df`` is hot: one count by slots, run at once.  The
    plan that is built next then holds the branches of hot keys only where there
    are some, and else plain windows by key that share one shuffle."""
    return not hot_keys(df.select(*[F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]),
                        [f"_k{i}" for i in range(len(keys))]).isEmpty()


def _split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_bucket``: -1 for the rows of ordinary keys, ranges of the
    order for those of hot keys (see the module's text)."""
    same = [F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]  # a struct: null keys meet
    names = [f"_k{i}" for i in range(len(keys))]
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.select("*", *same)
    hot = hot_keys(rows, names)
    parts = F.least(F.ceil(F.col("_n") / HOT_ROWS), F.lit(HOT_BUCKETS))
    few = F.greatest(F.floor(F.col("_n") / (parts * SAMPLES_PER_BUCKET)), F.lit(1))
    sample = rows.join(F.broadcast(hot), names).where(F.pmod(F.xxhash64(*_sortable(df)), few) == 0)
    ends = sample.groupBy(*names).agg(F.max(parts).alias("_parts"), F.sort_array(F.collect_list(at)).alias("_s"))
    step = F.greatest(F.floor(F.size("_s") / F.col("_parts")), F.lit(1))
    ends = ends.select(*names, F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (i % step == 0))).alias("_ends"))
    heads = F.filter("_ends", lambda x, i: i % FAN == 0)
    ends = ends.select(*names, "_ends", heads.alias("_heads"))  # MOST_HOT rows of HOT_BUCKETS ends
    out = rows.join(F.broadcast(ends), names, "left")

    def below(bounds: Column) -> Column:
        return F.aggregate(bounds, F.lit(0), lambda acc, e: acc + F.when(e < at, 1).otherwise(0))

    head = F.greatest(below(F.col("_heads")) - 1, F.lit(0)) * FAN
    bucket = F.when(F.col("_ends").isNull(), F.lit(-1)).otherwise(head + below(F.slice("_ends", head + 1, F.lit(FAN))))
    return out.withColumn("_bucket", bucket.cast("int")).drop(*names, "_ends", "_heads")


_COMBINE = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, order: Sequence[str], aggs: dict[str, tuple[Column, str]],
            bucket: Column | None = None, partitions: int | None = None, inclusive: bool = True,
            partition_by: Sequence[str] = ()) -> DataFrame:
    """Running aggregates (``sum``/``min``/``max``) over ``order`` (a total
    order), restarting per ``partition_by`` group.

    ``bucket`` must be monotone in ``order``; when omitted, hot keys (without
    keys: the whole table) are split by ranges of all order columns.
    """
    keys = list(partition_by)
    if keys and bucket is None and not has_hot(df, keys):
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select(*[c for c in df.columns if c not in aggs],
                         *[(F.coalesce(F.sum(c).over(w), F.lit(0)) if k == "sum" else _COMBINE[k][0](c).over(w)).alias(n) for n, (c, k) in aggs.items()])
    if bucket is not None:
        b = df.withColumn("_bucket", bucket)
    else:
        b = _split_hot(df, keys, list(order)) if keys else range_bucket(df, list(order), partitions)
    only_hot = bool(keys) and bucket is None
    frame_end = 0 if inclusive else -1
    part = Window.partitionBy(*keys, "_bucket")
    w = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    # running value and the (key, bucket) total come from the same window pass
    local = b.select("*", *[_COMBINE[k][0](c).over(w).alias(f"_loc_{n}") for n, (c, k) in aggs.items()])
    split = b.where(F.col("_bucket") >= 0) if only_hot else b
    totals = split.groupBy(*keys, "_bucket").agg(*[_COMBINE[k][0](c).alias(f"_tot_{n}") for n, (c, k) in aggs.items()])
    # One row per (bucket, key) that is split: MOST_HOT x HOT_BUCKETS, or one per bucket.
    wb = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    offsets = totals.select("_bucket", *same, *[_COMBINE[k][0](f"_tot_{n}").over(wb).alias(f"_off_{n}")
                                                for n, (_, k) in aggs.items()])
    out = local.select("*", *same).join(F.broadcast(offsets) if only_hot or not keys else offsets, ["_bucket", *names], "left")
    for n, (_, k) in aggs.items():
        loc, off = F.col(f"_loc_{n}"), F.col(f"_off_{n}")
        if k == "sum":
            val = F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0))
        else:
            val = _COMBINE[k][1](loc, off)
        out = out.withColumn(n, val)
    return out.drop("_bucket", *names, *[f"_loc_{n}" for n in aggs], *[f"_off_{n}" for n in aggs])


def running_totals(df: DataFrame, order: Sequence[str], sums: dict[str, Column],
                   bucket: Column | None = None, partitions: int | None = None,
                   inclusive: bool = True, partition_by: Sequence[str] = ()) -> DataFrame:
    """Running sums (see ``running``)."""
    return running(df, order, {n: (c, "sum") for n, c in sums.items()}, bucket, partitions, inclusive,
                   partition_by)


def positions(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based position of each row inside its key (skew-safe row_number - 1)."""
    out = running_totals(df, list(order), {name: F.lit(1).cast("long")}, partition_by=list(key))
    return out.withColumn(name, F.col(name) - 1)


def neighbour(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str], ahead: bool = False,
              prefix: str = "prev_") -> DataFrame:
    """Values of the row before (or ``ahead``: after) inside its key, null at
    the ends.  A plain ``lag`` per (key, bucket); the first row of a bucket of
    a hot key takes them from the edge row of the nearest bucket with rows."""
    keys = list(key)
    if not has_hot(df, keys):
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if ahead else F.asc(c) for c in order])
        return df.select(*df.columns, *[F.lag(c).over(w).alias(prefix + c) for c in cols])
    b = _split_hot(df, keys, list(order))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(c) if ahead else F.asc(c) for c in order])
    vals = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    local = b.select("*", F.lag(vals).over(w).alias("_near"))
    at = F.struct(*[F.col(c) for c in order])
    edges = b.where(F.col("_bucket") >= 0).groupBy(*keys, "_bucket").agg(
        (F.min_by if ahead else F.max_by)(vals, at).alias("_edge"))  # a row per bucket of a hot key
    wb = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if ahead else F.asc("_bucket"))
    same = [F.struct(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    before = edges.select(*same, "_bucket", F.lag("_edge").over(wb).alias("_far"))
    out = local.select("*", *same).join(F.broadcast(before), [*names, "_bucket"], "left")
    got = F.coalesce("_near", "_far")
    return out.select(*df.columns, *[got[f"v{i}"].alias(prefix + c) for i, c in enumerate(cols)])


def global_row_number(df: DataFrame, order: Sequence[str], bucket: Column | None = None,
                      partitions: int | None = None, name: str = "rn") -> DataFrame:
    """1-based row number over a total order, computed per bucket + offsets."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, bucket, partitions)


def hash_row_number(df: DataFrame, key: str, seed: int | str = 42, name: str = "rn") -> DataFrame:
    """Row number in the deterministic shuffled order md5(key || seed), key.

    Buckets are the first hex digits of the hash: uniform, so no bucket is
    hot even when the data are skewed on other columns.
    """
    h = hash_key(key, seed=seed)
    d = df.withColumn("_h", h)
    bucket = F.substring(F.col("_h"), 1, HASH_PREFIX_HEX)
    return global_row_number(d, ["_h", key], bucket=bucket, name=name).drop("_h")
