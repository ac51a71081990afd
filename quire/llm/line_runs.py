"""Line dedup: repeated line runs by a suffix array over line ids.

Lines are those between newlines; blank lines are not part of the sequence.
Every other line gets a 128-bit id, and suffixes of the id sequences are
ordered by prefix doubling as Spark tables:

* level 0 ranks a suffix by its first line, level k+1 by the pair of level-k
  ranks at places p and p + 2^k.  A rank is one number for all suffixes that
  share their first 2^k lines, in lexicographic order of those lines.  A pair
  seen once has no repeat, so its suffix leaves the table: levels shrink to
  what repeats.
* an *LCP interval* of depth L holds the suffixes that share L lines.  With
  k = floor(log2 L) it is named by (L, rank_k(p), rank_k(p + L - 2^k)), so the
  members of an interval meet in one grouping, whatever L is.

A run counts if it has at least ``min_words`` words.  Every maximal repeated
run of that size is covered by its shortest qualifying windows (from each line
on, and up to each line), and the interval of each window tells whether the
run occurs earlier (by doc_id, then by text, then by place).  Windows have at
most ``min_words`` lines, so the levels end at log2(min_words).  Later copies
are deleted, the first stays; overlapping repeats inside one document are
deleted the same way.

Hot lines: ranks, pairs and intervals only count and take minima (combined
before the shuffle); ordering inside a rank is cut into ranges.  Joins on a
hot interval are skew joins that AQE may split.

Defined cases: null text stays null, empty text stays empty.  Rows with the
same doc_id and text are one document here: both get the same result.  A null
doc_id sorts first.  Extra columns pass through.  A text whose lines are all
deleted becomes empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.decontaminate import may_hold
from quire.llm.store import table

KEY = ("__id", "__key")
RANGES = 1024
SLICE = 512  # texts whose lines a task holds at a time


def _windows(words: np.ndarray, least: int) -> list[np.ndarray]:
    """For each line the lengths of the shortest windows with ``least`` words
    that begin at it or are the shortest ending somewhere."""
    n = len(words)
    upto = np.concatenate(([0], np.cumsum(words)))
    out: list[set[int]] = [set() for _ in range(n)]
    stop = np.searchsorted(upto, upto[:-1] + least)        # first end of a window from each start
    for i in np.flatnonzero(stop <= n):
        out[i].add(int(stop[i] - i))
    begin = np.searchsorted(upto, upto[1:] - least, side="right") - 1  # last start of a window to each end
    for e in np.flatnonzero(upto[1:] >= least):
        out[begin[e]].add(int(e + 1 - begin[e]))
    return [np.array(sorted(s), dtype=np.int32) for s in out]


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """One row per non-blank line: document key, place, raw line number, id
    and the lengths of the windows that begin at it."""

    def run(batches):
        import xxhash

        for pdf in (p.iloc[lo:lo + SLICE] for p in batches for lo in range(0, len(p), SLICE)):
            rows = {c: [] for c in ("__id", "__key", "ord", "raw", "h1", "h2", "lens")}
            for doc_id, text in zip(pdf["__id"], pdf["t"]):
                if not text:
                    continue
                key = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)  # Spark's xxhash64(text)
                key -= (key >> 63) << 64
                lines = text.split("\n")
                counts = [len(x.split()) for x in lines]
                raw = [i for i, c in enumerate(counts) if c]
                if not raw:
                    continue
                win = _windows(np.array([counts[i] for i in raw]), min_words)
                for o, (i, lens) in enumerate(zip(raw, win)):
                    h = xxhash.xxh128_digest(lines[i].encode("utf-8", "replace"), 7)
                    rows["__id"].append(doc_id)
                    rows["__key"].append(key)
                    rows["ord"].append(o)
                    rows["raw"].append(i)
                    rows["h1"].append(int.from_bytes(h[:8], "little", signed=True))
                    rows["h2"].append(int.from_bytes(h[8:], "little", signed=True))
                    rows["lens"].append(lens)
            if not rows["ord"]:
                continue
            out = pd.DataFrame(rows)
            out["__id"] = out["__id"].astype("Int64")
            yield out

    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("t"))
    return src.mapInPandas(run, "__id long, __key long, ord int, raw int, h1 long, h2 long, lens array<int>")


def _starts(groups: DataFrame, part: str, by: list[str], cut) -> DataFrame:
    """``groups`` with ``start``: rows (column n) before each group of its
    ``part``, in the order ``by``; ``cut`` is a coarse, order-keeping range of
    ``by``, so no window holds more than one range."""
    g = groups.withColumn("__cut", cut)
    sums = g.groupBy(part, "__cut").agg(F.sum("n").alias("__s"))
    before = Window.partitionBy(part).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(part).alias("__p"), F.col("__cut").alias("__c"),
                       F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(part, "__cut").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return g.join(sums, (g[part] == F.col("__p")) & (g["__cut"] == F.col("__c"))) \
        .withColumn("start", F.col("__base") + F.col("__in")).drop("__p", "__c", "__base", "__in", "__cut")


def _first_rank(lines: DataFrame) -> DataFrame:
    """Level 0: suffixes that begin with a line that occurs again, ranked."""
    seen = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("__top", F.shiftright("h1", 50))
    seen = _starts(seen.withColumn("__all", F.shiftright("h1", 62)), "__all", ["h1", "h2"], F.col("__top"))
    tops = seen.groupBy("__all").agg(F.sum("n").alias("s"))  # four rows
    ahead = Window.orderBy("__all").rowsBetween(Window.unboundedPreceding, -1)
    base = tops.withColumn("b", F.coalesce(F.sum("s").over(ahead), F.lit(0))).select("__all", "b")
    seen = seen.join(F.broadcast(base), "__all").select("h1", "h2", (F.col("start") + F.col("b")).alias("r"))
    return lines.join(seen, ["h1", "h2"]).select(*KEY, "ord", "raw", "lens", "r")


def _next_rank(level: DataFrame, k: int, size: int) -> DataFrame:
    """Level k+1 from level k: rank the pairs (r at p, r at p + 2^k)."""
    ahead = Window.partitionBy(*KEY).orderBy("ord")
    step = 1 << k
    pairs = level.withColumn("o2", F.lead("ord", step).over(ahead)).withColumn("r2", F.lead("r", step).over(ahead)) \
        .where(F.col("o2") == F.col("ord") + step).drop("o2")
    again = pairs.groupBy("r", "r2").agg(F.count("*").alias("n")).where("n > 1")
    width = max(1, -(-size // RANGES))
    again = _starts(again, "r", ["r2"], F.floor(F.col("r2") / width)) \
        .select(F.col("r").alias("ra"), F.col("r2").alias("rb"), (F.col("r") + F.col("start")).alias("rn"))
    return pairs.join(again, (F.col("r") == F.col("ra")) & (F.col("r2") == F.col("rb"))) \
        .select(*KEY, "ord", "raw", "lens", F.col("rn").alias("r"))


def _later(level: DataFrame, k: int) -> DataFrame:
    """(key, ord, len) of the windows of level k that are not the first of
    their LCP interval."""
    win = level.select(*KEY, "ord", "r", F.explode("lens").alias("len")) \
        .where((F.col("len") >= (1 << k)) & (F.col("len") < (2 << k)))
    if k:
        other = level.select(F.col("__id").alias("i2"), F.col("__key").alias("k2"), F.col("ord").alias("e2"),
                             F.col("r").alias("q"))
        win = win.withColumn("e", F.col("ord") + F.col("len") - (1 << k))
        win = win.join(other, win["__id"].eqNullSafe(other["i2"]) & (win["__key"] == other["k2"])
                       & (win["e"] == other["e2"])).select(*KEY, "ord", "len", "r", "q")
    else:
        win = win.withColumn("q", F.col("r"))
    spot = F.struct("__id", "__key", "ord")
    first = win.groupBy("len", "r", "q").agg(F.count("*").alias("n"), F.min(spot).alias("first")).where("n > 1") \
        .select(F.col("len").alias("l1"), F.col("r").alias("r1"), F.col("q").alias("q1"), "first")
    return win.join(first, (F.col("len") == F.col("l1")) & (F.col("r") == F.col("r1")) & (F.col("q") == F.col("q1"))) \
        .where(spot != F.col("first")).select(*KEY, "ord", "len")


def deleted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(__id, __key, lines): raw numbers of the lines to delete, per document."""
    lines = table(line_table(docs, id_col, text_col, min_words), "lines")
    unique = lines.groupBy(*KEY, "ord").agg(*[F.first(c).alias(c) for c in ("raw", "h1", "h2", "lens")])
    level = table(_first_rank(unique), "line-rank")
    base, gone, k = level, None, 0
    size = base.count()  # ranks stay below this at every level
    while True:
        later = table(_later(level, k), "line-windows")
        gone = later if gone is None else gone.union(later)
        if (2 << k) > min_words or level.isEmpty():
            break
        level = table(_next_rank(level, k, size), "line-rank")
        k += 1
    spots = gone.select(*KEY, F.explode(F.sequence("ord", F.col("ord") + F.col("len") - 1)).alias("o")).distinct() \
        .select(F.col("__id").alias("i2"), F.col("__key").alias("k2"), "o")
    hit = base.join(spots, base["__id"].eqNullSafe(spots["i2"]) & (base["__key"] == spots["k2"])
                    & (base["ord"] == spots["o"]))
    return hit.groupBy(*KEY).agg(F.collect_list("raw").alias("lines"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from the text, plus
    ``__deleted`` (lines deleted)."""
    gone = table(deleted_lines(docs, id_col, text_col, min_words), "line-deleted") \
        .select(F.col("__id").alias("__gone_id"), F.col("__key").alias("__gone_key"), F.col("lines").alias("__lines"))
    key = F.xxhash64(text_col)
    maybe = may_hold(gone, "__gone_key")  # most texts lose nothing and need no join
    # merge: neither side has a bound that would allow a broadcast
    joined = docs.where(maybe(key)).join(gone.hint("merge"), (key == F.col("__gone_key"))
                                         & F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__lines"))
    text = F.when(F.col("__lines").isNull(), F.col(text_col)) \
        .otherwise(F.array_join(F.transform(keep, lambda i: F.get(parts, i)), "\n"))
    cut = [F.col(c) if c != text_col else text.alias(text_col) for c in docs.columns]
    rest = docs.where(~maybe(key)).select(*docs.columns, F.lit(0).alias("__deleted"))
    return rest.union(joined.select(*cut, F.coalesce(F.size("__lines"), F.lit(0)).alias("__deleted")))
