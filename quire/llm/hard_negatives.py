"""Hard-negative mining with a BOND vertical scan.

Rows are cut into columnar blocks (one array per dimension).  For each anchor a
block is read dimension by dimension, in the order of the anchor's falling
magnitudes; the least and greatest value of every dimension in the block bound
what the remaining ones can still add, so after each step a bitmap keeps only
candidates that can reach a result.  What is left at the end has its exact
integer score.

Two scans use it: the first finds the positives (most similar rows of the
anchor's label), whose scores set one window per positive; the second finds the
best rows of other labels inside each window.  A candidate stays while its
bounds touch a window whose list it can still enter.

Work: anchors go to the tasks in groups of ``GROUP`` (their number is a fixed
bound on what is broadcast), once per scan of the table; no vector is
shuffled.  A task returns at most ``k`` rows per anchor and window, which are
merged by anchor; lists of a task carry over from block to block, so most
blocks are cut short.  Memory of a task is one block and the lists of a group.

Defined cases: rows with a null label or vector, with a null or non-finite
component, no component, or one beyond 2^26 in scaled size take no part; only
vectors of one length meet; a row is never its own partner nor that of a row with its id;
repeated rows stand each by themselves, repeated anchors count once, anchors
with one id and different vectors are mined separately; null ids are no
anchors and no partners; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import table

GROUP = 16_384    # anchors handed to the tasks at a time
BLOCK = 8_192     # rows of a columnar block
FIRST, STEP = 8, 8  # dimensions read before the first cut, and between cuts
FAR = np.int64(1) << np.int64(62)


def prepare(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, v): usable rows with components ``floor(scale * x)``."""
    x = F.col(vector_col)
    whole = F.transform(x, lambda c: F.floor(scale * c.cast("double")))
    usable = x.isNotNull() & (F.size(x) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < float(1 << 26)))
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                       F.when(usable, whole).alias("v")).where("id is not null and label is not null and v is not null")


class Block:
    """Rows of one vector length by dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.dims = np.ascontiguousarray(vectors[order].T)
        self.least, self.most = self.dims.min(axis=1), self.dims.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, useful) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the rows of bitmap ``alive`` that last.

        ``useful(low, high, rows)`` says which rows, with scores between
        ``low`` and ``high``, can still reach a result.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack((a * self.least[order], a * self.most[order]))
        low_left = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        high_left = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        at = alive.nonzero()[0]
        score = np.zeros(len(at), np.int64)
        d, n = 0, len(a)
        while d < n and len(at):
            e = min(n, d + (STEP if d else FIRST))
            whole = len(at) == len(self.ids)
            for k in range(d, e):
                column = self.dims[order[k]]
                score += a[k] * (column if whole else column[at])
            d = e
            keep = useful(score + low_left[d], score + high_left[d], at)
            if not keep.all():
                at, score = at[keep], score[keep]
        return at, score


class Best:
    """The k best (score falling, id rising) of what was added."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bar(self):
        """Scores below this cannot enter."""
        return self.scores[-1] if len(self.scores) == self.k else -FAR

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        best = np.lexsort((ids, -scores))[:self.k]
        self.ids, self.scores = ids[best], scores[best]


def _blocks(batches, size: int):
    """Columnar blocks of the rows of a task, by vector length."""
    wait: dict[int, list] = {}
    held: dict[int, int] = {}

    def block(width):
        parts = wait.pop(width)
        held.pop(width)
        return Block(*(np.concatenate([p[k] for p in parts]) for k in range(3)))

    for pdf in batches:
        widths = pdf["v"].map(len).to_numpy()
        for width in np.unique(widths):
            part = pdf[widths == width]
            wait.setdefault(width, []).append((part["id"].to_numpy(np.int64), part["label"].to_numpy(np.int64),
                                               np.stack(part["v"].to_numpy()).astype(np.int64)))
            held[width] = held.get(width, 0) + len(part)
            if held[width] >= size or len(wait) > 8:
                yield block(width)
    for width in list(wait):
        yield block(width)


def _groups(anchors: DataFrame):
    """Anchors in groups of about ``GROUP``, as broadcast lists."""
    spark = anchors.sparkSession
    number = max(1, -(-anchors.count() // GROUP))
    for g in range(number):
        part = anchors.where(F.pmod("akey", F.lit(number)) == g).toPandas()  # a bounded group
        part["v"] = [np.asarray(v, np.int64) for v in part["v"]]
        yield spark.sparkContext.broadcast(part.to_dict("records"))


def _merged(parts: list[DataFrame], by: list[str], k: int) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def positives(rows: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(akey, id, score, rank): the ``k`` rows of the anchor's label with the
    largest scores; anchors are (akey, id, label, v)."""
    parts = []
    for held in _groups(anchors):

        def run(batches, held=held, block=BLOCK):
            todo = [(a, a["v"], Best(k)) for a in held.value]
            for b in _blocks(batches, block):
                by_label = {x: b.labels == x for x in np.unique(b.labels)}
                for a, v, best in todo:
                    alive = by_label.get(a["label"])
                    if alive is None or len(v) != len(b.dims):
                        continue

                    def useful(low, high, at, best=best):
                        bar = best.bar
                        if len(low) > k:
                            bar = max(bar, np.partition(low, len(low) - k)[len(low) - k])
                        return high >= bar

                    at, score = b.scan(v, alive & (b.ids != a["id"]), useful)
                    best.add(b.ids[at], score)
            for a, _, best in todo:
                if len(best.ids):
                    yield pd.DataFrame({"akey": a["akey"], "id": best.ids, "score": best.scores})

        parts.append(table(rows.mapInPandas(run, "akey long, id long, score long"), "positives"))
        held.unpersist()
    return _merged(parts, ["akey"], k)


def negatives(rows: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(akey, low, high, id, score, rank): for every window of an anchor the
    ``k`` best rows of other labels with low <= score <= high; ``windows`` are
    (akey, id, label, v, windows: array of (low, high))."""
    parts = []
    for held in _groups(windows):

        def run(batches, held=held, block=BLOCK):
            todo = [(a, a["v"], [(int(w["low"]), int(w["high"]), Best(k)) for w in a["windows"]])
                    for a in held.value]
            for b in _blocks(batches, block):
                by_label = {x: b.labels != x for x in np.unique(b.labels)}
                every = np.ones(len(b.ids), bool)
                for a, v, lists in todo:
                    if len(v) != len(b.dims):
                        continue

                    def useful(low, high, at, lists=lists):
                        keep = np.zeros(len(low), bool)
                        for lo, hi, best in lists:
                            bar = max(lo, int(best.bar))
                            sure = low[(low >= lo) & (high <= hi)]  # surely inside
                            if len(sure) > k:
                                bar = max(bar, int(np.partition(sure, len(sure) - k)[len(sure) - k]))
                            keep |= (high >= bar) & (low <= hi)
                        return keep

                    at, score = b.scan(v, by_label.get(a["label"], every) & (b.ids != a["id"]), useful)
                    for lo, hi, best in lists:
                        inside = (score >= lo) & (score <= hi)
                        best.add(b.ids[at[inside]], score[inside])
            for a, _, lists in todo:
                for lo, hi, best in lists:
                    if len(best.ids):
                        yield pd.DataFrame({"akey": a["akey"], "low": lo, "high": hi, "id": best.ids, "score": best.scores})

        parts.append(table(rows.mapInPandas(run, "akey long, low long, high long, id long, score long"), "negatives"))
        held.unpersist()
    return _merged(parts, ["akey", "low", "high"], k)


def mine(rows: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 10,
         least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) of ``prepare`` rows: for each anchor and positive the first
    rows of other labels whose score is between the two percentages of the
    positive's."""
    rows = table(rows, "vectors")
    anchors = rows.where(is_anchor).dropDuplicates().withColumn("akey", F.xxhash64("id", "label", "v"))
    anchors = table(anchors.select("akey", "id", "label", "v"), "anchors")
    best = table(positives(rows, anchors, k_positive).select("akey", F.col("id").alias("positive_id"),
                                                              F.col("score").alias("positive_score"), F.col("rank").alias("at")), "positives")
    # 100 * score between least * s and most * s, in whole numbers
    least, most = f"{int(least_percent)} * positive_score", f"{int(most_percent)} * positive_score"
    best = best.withColumn("low", F.expr(f"({least} + pmod(-({least}), 100)) div 100")) \
        .withColumn("high", F.expr(f"({most} - pmod({most}, 100)) div 100"))
    open_ = best.where("low <= high").groupBy("akey").agg(F.collect_set(F.struct("low", "high")).alias("windows"))  # k_positive at most
    found = negatives(rows, table(anchors.join(open_, "akey"), "windows"), k_negative)
    out = best.join(found.select("akey", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")),
                    ["akey", "low", "high"])
    out = out.join(anchors.select("akey", F.col("id").alias("anchor_id")), "akey")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
