"""Run summaries and run logs: seed statistics, curves, labels, key parsing.

All per-group statistics are plain ``groupBy().agg`` (partial aggregation
before the shuffle, so a hot run/data-set key is combined map-side).
Per-step ordering uses ``min_by``/``max_by`` with a tie-break struct
instead of windows wherever the rule allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.joins import contains_join, small_join
from quire.plans.ordering import positions

STDERR_MODES = ("n", "sqrt_n", "sample_std")


def seed_stats(df: DataFrame, by: Sequence[str], value: str, stderr: str = "n",
               prefix: str = "") -> DataFrame:
    """Mean and spread over seeds.

    ``stderr="n"``: population std / n (the LM templates);
    ``"sqrt_n"``: population std / sqrt(n); ``"sample_std"``: sample std
    (NULL for one row, where the reference shows NaN).
    """
    v = F.col(value)
    if stderr == "n":
        spread = F.stddev_pop(v) / F.count(v)
    elif stderr == "sqrt_n":
        spread = F.stddev_pop(v) / F.sqrt(F.count(v))
    elif stderr == "sample_std":
        spread = F.stddev_samp(v)
    else:
        raise ValueError(f"stderr must be one of {STDERR_MODES}")
    return df.groupBy(*by).agg(
        F.avg(v).alias(f"{prefix}mean"),
        spread.alias(f"{prefix}stderr" if stderr != "sample_std" else f"{prefix}std"),
        F.count(v).alias(f"{prefix}n"),
    )


def single_run(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Summary layout of a single run: mean with stderr fixed to 0.0."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.lit(0.0).alias("stderr"))


def seed_values(df: DataFrame, by: Sequence[str], seed: str, value: str) -> DataFrame:
    """Per-seed values kept as a list in seed order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seed).alias("s"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda x: x["v"]).alias("values"))


def curve_band(log: DataFrame, by: Sequence[str], seed: str, order: str, value: str,
               truncate: bool = False) -> DataFrame:
    """Learning-curve band: per position mean and std/sqrt(n) over seeds.

    Position = rank of ``order`` inside (by, seed).  With ``truncate`` every
    seed is cut to the shortest seed of its group and the x axis is taken
    from the first seed (lowest seed id).
    """
    pos = positions(log, [*by, seed], [order], "pos").withColumn("pos", F.col("pos") + 1)
    if truncate:
        lengths = pos.groupBy(*by, seed).agg(F.max("pos").alias("_len"))
        shortest = lengths.groupBy(*by).agg(F.min("_len").alias("_minlen"))
        pos = pos.join(shortest, list(by)).where(F.col("pos") <= F.col("_minlen"))
    v = F.col(value)
    return pos.groupBy(*by, "pos").agg(
        F.min_by(F.col(order), F.col(seed)).alias("x"),
        F.avg(v).alias("mean"),
        (F.stddev_pop(v) / F.sqrt(F.count(v))).alias("stderr"),
        F.count(v).alias("n"),
    )


def fill_curve(log: DataFrame, axis: DataFrame, keys: Sequence[str], order: str, value: str,
               fill: float = 0.0) -> DataFrame:
    """Zero-fill a metric on a common axis: every (key, step) of ``axis``."""
    return (axis.join(log.select(*keys, order, value), [*keys, order], "left")
            .select(*keys, order, F.coalesce(F.col(value), F.lit(fill)).alias(value)))


def label_runs(runs: DataFrame, labels: DataFrame, key: str = "run") -> DataFrame:
    """Only labelled runs are reported (inner equi-join to the label table)."""
    return small_join(runs, labels, key, "inner")


def label_or_name(runs: DataFrame, labels: DataFrame, key: str = "run",
                  label: str = "label") -> DataFrame:
    """Unlabelled runs keep their own name as label."""
    return (small_join(runs, labels, key, "left")
            .withColumn(label, F.coalesce(F.col(label), F.col(key))))


def match_keys(log_keys: DataFrame, datasets: DataFrame, key: str = "key",
               dataset: str = "dataset", kind: str = "val_info", strict: bool = False) -> DataFrame:
    """Match log keys ``{dataset}_{seed}_{kind}`` to data-set names.

    Reference rule (``strict=False``): substring containment of the data set
    and of ``kind`` (so ``x`` also matches ``xy_0_val_info``).  The
    substring join of ``plans.joins`` is an equi-join on pieces, at every size.
    ``strict=True`` parses the key and equi-joins.
    """
    k = F.col(key)
    if strict:
        parsed = log_keys.withColumn(
            dataset, F.regexp_extract(k, r"^(.*)_([^_]+)_([a-z]+_info)$", 1))
        return (parsed.where(F.regexp_extract(k, r"_([a-z]+_info)$", 1) == kind)
                .join(datasets.select(dataset), dataset))
    return contains_join(log_keys.where(F.contains(k, F.lit(kind))), key, datasets.select(dataset), dataset)


def parse_key(c: Column) -> Column:
    """``dataset_seed_kind`` -> struct(dataset, seed, kind) (split on ``_``)."""
    parts = F.split(c, "_")
    return F.struct(
        parts.getItem(0).alias("dataset"),
        parts.getItem(1).alias("seed"),
        F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(1))), "_").alias("kind"),
    )


def seeds(log: DataFrame, key: str = "key") -> DataFrame:
    """Distinct seeds from log keys (second ``_`` part)."""
    return log.select(F.split(F.col(key), "_").getItem(1).alias("seed")).distinct()


def thin(df: DataFrame, step: str, k: int, r: int = 0) -> DataFrame:
    """Keep rows with ``step % k == r`` (``r = k-1`` is the last-of-block form)."""
    return df.where(F.pmod(F.col(step), F.lit(k)) == r)


def numeric_only(metrics: DataFrame, metric: str, order: str, value: str) -> DataFrame:
    """Keep a metric only if its first value (lowest ``order``) parses as a number."""
    first = metrics.groupBy(metric).agg(
        F.min_by(F.col(value), F.col(order)).alias("_first"))
    ok = first.where(F.col("_first").try_cast("double").isNotNull()).select(metric)
    return metrics.join(ok, metric, "left_semi")


def present(metrics: DataFrame, value: str) -> DataFrame:
    """Runs lacking the metric are left out."""
    return metrics.where(F.col(value).isNotNull())


def last_record(log: DataFrame, key: Sequence[str], order: str, mode_col: str = "mode",
                mode: str = "eval") -> DataFrame:
    """Last record (highest ``order``) whose ``mode`` equals ``mode``, per key."""
    cols = [c for c in log.columns if c not in key]
    rec = F.struct(*[F.col(c) for c in cols])
    return (log.where(F.col(mode_col) == mode).groupBy(*key)
            .agg(F.max_by(rec, F.col(order)).alias("_r")).select(*key, "_r.*"))


def iteration_axis(df: DataFrame, epoch: str, batch: str, size: Column | int, batch_size: int) -> DataFrame:
    """Unified x axis: epoch * (size div batch_size) + batch."""
    size_c = size if isinstance(size, Column) else F.lit(size)
    return df.withColumn("iteration", F.col(epoch) * F.floor(size_c / batch_size) + F.col(batch))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append result rows (one ``unionByName``, missing columns as NULL)."""
    return a.unionByName(b, allowMissingColumns=True)


def explode_means(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """``{dataset: {"means": {metric: v}}}`` JSON -> rows (key, dataset, metric, value)."""
    parsed = F.from_json(F.col(json_col), "map<string, struct<means: map<string, double>>>")
    return (df.select(key, F.explode(parsed).alias("dataset", "_s"))
            .select(key, "dataset", F.explode("_s.means").alias("metric", "value")))


def wide(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Wide join of several per-(run, data set) tables on the same keys."""
    items = list(parts.items())
    out = items[0][1]
    for _, df in items[1:]:
        out = out.join(df, list(keys), "inner")
    return out
