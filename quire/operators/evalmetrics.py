"""Evaluation metrics as aggregates: weighted losses, accuracies, exceedance,
ROC AUC, average precision, weighted cross-entropy, PSNR, throughput, OLS.

ROC AUC and average precision first aggregate to one row per distinct
score (map-side partial aggregation), then accumulate across the score
order with bucketed running totals (``quire.plans.ordering``), so no step
needs all rows, or all distinct scores, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.ordering import running_totals


def weighted_loss(batches: DataFrame, loss: str, n: str, correct: str, order: str | None = None,
                  max_batches: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Σ(loss·n)/Σn and correct/total over at most ``max_batches`` batches
    (first by ``order``, which is a batch index)."""
    b = batches if max_batches is None else batches.where(F.col(order) < max_batches)
    return b.groupBy(*by).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"),
                              (F.sum(correct) / F.sum(n)).alias("accuracy"))


def batch_loss(batches: DataFrame, loss: str, n: str, correct: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted batch-loss mean and percent accuracy."""
    return batches.groupBy(*by).agg(F.avg(loss).alias("loss"),
                                    (100.0 * F.sum(correct) / F.sum(n)).alias("accuracy_pct"))


def prefix_accuracy(df: DataFrame, pred: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions that start with the target."""
    return df.groupBy(*by).agg(F.avg(F.startswith(F.col(pred), F.col(target)).cast("double")).alias("accuracy"))


def argmax_accuracy(scores: DataFrame, truth: DataFrame, key: str, cls: str, score: str,
                    true_cls: str) -> DataFrame:
    """Predicted class = argmax score (ties -> smallest class) vs truth."""
    pred = scores.groupBy(key).agg(F.min_by(F.col(cls), F.struct(-F.col(score), F.col(cls))).alias("_pred"))
    j = pred.join(truth, key)
    return j.agg(F.avg((F.col("_pred") == F.col(true_cls)).cast("double")).alias("accuracy"),
                 F.count("*").alias("n"))


def exceedance(df: DataFrame, cell: str, value: str, thr: float = 3.5, n_times: int | Column | None = None,
               time: str | None = None) -> DataFrame:
    """Per cell: share of time steps with value > thr; absent steps count as 0,
    so the denominator is the total number of time steps."""
    if n_times is None:
        n_times = df.agg(F.count_distinct(time)).scalar()
    nt = n_times if isinstance(n_times, Column) else F.lit(n_times)
    return df.groupBy(cell).agg((F.sum((F.col(value) > thr).cast("double")) / nt).alias("freq"))


def _score_counts(df: DataFrame, y: str, score: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, score).agg(F.sum(F.col(y).cast("long")).alias("_pos"),
                                      F.sum((1 - F.col(y)).cast("long")).alias("_neg"))


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties (equals the trapezoid AUC)."""
    counts = _score_counts(df, y, score, by)
    cum = running_totals(counts, [score], {"_before": F.col("_pos") + F.col("_neg")}, inclusive=False,
                         partition_by=by)
    avg_rank = F.col("_before") + (F.col("_pos") + F.col("_neg") + 1) / 2.0
    agg = cum.groupBy(*by).agg(F.sum(F.col("_pos") * avg_rank).alias("_rpos"),
                               F.sum("_pos").alias("P"), F.sum("_neg").alias("N"))
    p, n = F.col("P"), F.col("N")
    auc = (F.col("_rpos") - p * (p + 1) / 2.0) / (p * n)
    return agg.select(*by, F.when((p > 0) & (n > 0), auc).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AP = Σ ΔRecall · Precision over distinct thresholds (descending score)."""
    counts = _score_counts(df, y, score, by).withColumn("_neg_score", -F.col(score))
    cum = running_totals(counts, ["_neg_score"], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}, inclusive=True,
                         partition_by=by)
    if by:
        tot = counts.groupBy(*by).agg(F.sum("_pos").alias("P"))
        j = cum.join(tot, list(by))
    else:
        j = cum.withColumn("P", counts.agg(F.sum("_pos")).scalar())
    prec = F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    return j.groupBy(*by).agg(F.sum(F.col("_pos") / F.col("P") * prec).alias("average_precision"))


def weighted_log_loss(df: DataFrame, y: str, logits: Sequence[str], weights: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """Class-weighted cross-entropy on logits: Σ w_y·(−log softmax_y) / Σ w_y."""
    mx = F.greatest(*[F.col(c) for c in logits])
    lse = mx + F.log(sum(F.exp(F.col(c) - mx) for c in logits))
    chosen = F.lit(None).cast("double")
    w = F.lit(None).cast("double")
    for k, c in enumerate(logits):
        chosen = F.when(F.col(y) == k, F.col(c)).otherwise(chosen)
        w = F.when(F.col(y) == k, F.lit(float(weights[k]))).otherwise(w)
    nll = lse - chosen
    return df.groupBy(*by).agg((F.sum(w * nll) / F.sum(w)).alias("loss"))


def psnr(pixels: DataFrame, image: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Per image MSE and PSNR = −10·log10(mse); plus the mean over images."""
    per = pixels.groupBy(image).agg(F.avg(F.pow(F.col(a) - F.col(b), 2)).alias("mse"))
    per = per.withColumn("psnr", -10.0 * F.log10("mse"))
    return per, per.agg(F.avg("mse").alias("mean_mse"), F.avg("psnr").alias("mean_psnr"))


def throughput(df: DataFrame, by: Sequence[str], tokens: str, seconds: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(tokens) / F.col(seconds)).alias("tokens_per_second"),
                               F.avg(seconds).alias("seconds_per_item"))


def cholesky(s: Column, size: int) -> Column:
    """Lower triangle L (rows of growing length) with L·Lᵀ = s, for a column
    that holds the symmetric matrix as an array of rows.  Null where s is not
    positive definite."""
    nothing, number = F.array().cast("array<double>"), F.lit(0.0)

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), number, lambda acc, x: acc + x)

    def row(done, i):
        def entry(r, j):
            other = F.get(done, j)
            rest = F.get(F.get(s, i), j) - dot(r, F.when(j < i, F.slice(other, 1, F.size(r))).otherwise(r))
            return F.when(j < i, F.try_divide(rest, F.get(other, j))).otherwise(F.when(rest > 0, F.sqrt(rest)))

        return F.aggregate(F.sequence(F.lit(0), i), nothing, lambda r, j: F.array_append(r, entry(r, j)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.array().cast("array<array<double>>"),
                       lambda done, i: F.array_append(done, row(done, i)))


def ols_effect(df: DataFrame, y: str, x: str, adjust: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """OLS with intercept: coefficient and standard error of ``x`` given the
    adjustment set, per group of ``by``.

    One aggregate gives the covariances of [adjust, x, y] (combined before the
    shuffle); the rest is Column algebra on its rows, in the same plan.  With
    L·Lᵀ the scatter matrix in that order, the last two rows of L hold the
    answer: coefficient L[y][x] / L[x][x], residual sum of squares L[y][y]²,
    and 1 / L[x][x]² is the entry of the inverse for x.  Rows with a null take
    no part; collinear regressors, or no rows to spare, give nulls."""
    cols = [*adjust, x, y]
    p = len(cols) - 1
    rows = df.select(*by, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(cols)]).dropna(subset=list(dict.fromkeys(cols)))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.array(*[F.avg(c) for c in cols]).alias("_mean"),
        F.array(*[F.array(*[F.covar_pop(cols[max(i, j)], cols[min(i, j)]) for j in range(p + 1)]) for i in range(p + 1)]).alias("_s"))
    fit = sums.withColumn("_l", cholesky(F.col("_s"), p + 1))

    def at(i, j):
        return F.get(F.get("_l", F.lit(i)), F.lit(j))

    fit = fit.withColumn("_b", F.array().cast("array<double>"))
    for j in range(p - 1, -1, -1):  # back substitution: the coefficient of x first
        known = [at(i, j) * F.get("_b", F.lit(i - j - 1)) for i in range(j + 1, p)]
        fit = fit.withColumn("_b", F.array_prepend("_b", F.try_divide(sum((-k for k in known), at(p, j)), at(j, j))))
    slope = F.get("_b", F.lit(p - 1))
    spare = F.when(F.col("n") > p + 1, F.col("n") - p - 1)
    err = F.sqrt(at(p, p) * at(p, p) * F.col("n") / spare) / (at(p - 1, p - 1) * F.sqrt("n"))
    shift = F.get("_mean", F.lit(p)) - sum((F.get("_b", F.lit(i)) * F.get("_mean", F.lit(i)) for i in range(1, p)),
                                           F.get("_b", F.lit(0)) * F.get("_mean", F.lit(0)))
    return fit.select(*by, F.lit(x).alias("regressor"), slope.alias("coef"), err.alias("std_err"), shift.alias("intercept"), "n")
