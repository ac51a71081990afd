"""User plug-ins: a text scorer applied per Arrow batch, binary operations on
pair tables, and SSIM per image pair.

Plug-ins are the Python slow path by nature; each runs vectorised per
batch (``mapInPandas``), never per row through a row-at-a-time UDF.  SSIM needs
no Python: it is grouped window sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORE_SCHEMA = "is_paper boolean, confidence double, reason string"


def score_text(df: DataFrame, fn: Callable[[str], tuple], key: str = "doc_id", text: str = "text",
               schema: str = SCORE_SCHEMA) -> DataFrame:
    """Apply ``fn(text) -> (verdict, confidence, reason)`` to every row; a
    failing call yields a NULL verdict row instead of failing the job."""
    ktype = dict(df.dtypes)[key]
    out_schema = f"{key} {ktype}, {schema}"
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        for pdf in batches:
            res = []
            for t in pdf[text]:
                try:
                    res.append(tuple(fn(t)))
                except Exception:  # noqa: BLE001 - a failing plug-in call gives a NULL row
                    res.append((None,) * len(names))
            out = pd.DataFrame(res, columns=names)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return df.select(key, text).mapInPandas(run, out_schema)


def demo_scorer(text: str) -> tuple:
    """A deterministic stand-in classifier (tests and examples): fails on
    texts ending in a digit, to exercise the NULL-row path."""
    if text[-1:].isdigit():
        raise ValueError("scorer failure")
    return ("Abstract" in text, round((len(text) % 100) / 100, 2), f"len={len(text)}")


def binary_table(elements: DataFrame, col: str, p: int, op: Callable[[Column, Column], Column]) -> DataFrame:
    """Pair table (a, b in [0, p)) with a user operation ``op(a, b) -> Column``."""
    t = elements.select(F.col(col).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("b"))
    return t.withColumn("c", op(F.col("a"), F.col("b")))


def _bell(size: int, sigma: float) -> list[float]:
    """Normalised Gaussian weights of a window of ``size`` places."""
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(raw) for v in raw]


def _windowed(df: DataFrame, keys: list[str], axis: str, values: list[str], weights: list[float], last: int) -> DataFrame:
    """Weighted sums over windows along ``axis``: every row is added to the
    windows that cover it (start 0..last), then the windows are summed."""
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(weights)])
    e = df.select(*keys, axis, *values, F.explode(taps).alias("_tap"))
    e = e.withColumn(axis, F.col(axis) - F.col("_tap.i")).where(F.col(axis).between(0, last))
    return e.groupBy(*keys, axis).agg(*[F.sum(F.col(c) * F.col("_tap.v")).alias(c) for c in values])


def ssim(pixels: DataFrame, image: str, r: str, c: str, a: str, b: str, h: int, w: int, max_val: float,
         channel: str | None = None, size: int = 11, sigma: float = 1.5, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """Mean SSIM per image pair from long pixel rows (missing pixels are 0):
    Gaussian windows that lie inside the image, variances not below 0, the
    covariance not above the geometric mean of the variances.

    The window sums are two grouped passes (along rows, then along columns), so
    the work is spread over pixels; a window without any pixel counts as 1.
    """
    keys = [image] + ([channel] if channel else [])
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = pixels.select(*keys, F.col(r).cast("int").alias("_r"), F.col(c).cast("int").alias("_c"), x.alias("_x"), y.alias("_y"),
                      (x * x).alias("_xx"), (y * y).alias("_yy"), (x * y).alias("_xy"))
    names, bell = ["_x", "_y", "_xx", "_yy", "_xy"], _bell(size, sigma)
    m = _windowed(m, [*keys, "_c"], "_r", names, bell, h - size)
    m = _windowed(m, [*keys, "_r"], "_c", names, bell, w - size)
    px, py = F.col("_x"), F.col("_y")
    vx, vy = (F.greatest(F.col(q) - e * e, F.lit(0.0)) for q, e in (("_xx", px), ("_yy", py)))
    cov = F.col("_xy") - px * py
    cov = F.signum(cov) * F.least(F.abs(cov), F.sqrt(vx * vy))
    f1, f2 = (k1 * max_val) ** 2, (k2 * max_val) ** 2
    like = (2 * px * py + f1) * (2 * cov + f2) / ((px * px + py * py + f1) * (vx + vy + f2))
    places = (h - size + 1) * (w - size + 1)
    n = F.countDistinct(channel) if channel else F.lit(1)
    per = m.groupBy(image).agg(F.sum(like).alias("_s"), F.count("*").alias("_n"), n.alias("_k"))
    total = F.col("_k") * places
    return per.select(image, ((F.col("_s") + total - F.col("_n")) / total).alias("ssim"))
