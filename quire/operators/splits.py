"""Reproducible splits, draws, batches, prompt tables and vocabularies.

Randomness is a hash of key and seed (md5), never ``rand()``: results are
the same on every run and after any task retry.  Exact global orders use
``quire.plans.ordering`` (bucketed windows + bounded offsets) instead of a
window without ``partitionBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.ordering import global_row_number, hash_int, hash_row_number


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled k-fold assignment (``fold`` 0..k-1): first ``n mod k`` folds
    get one more row, as in a shuffled KFold."""
    n = df.agg(F.count("*")).scalar()  # scalar subquery: same plan, no eager job
    q = F.floor(n / k)
    r = n - q * k
    numbered = hash_row_number(df, key, seed)
    rn = F.col("rn")
    big = r * (q + 1)
    fold = (F.when(rn <= big, F.ceil(rn / (q + 1)))
            .otherwise(r + F.ceil((rn - big) / F.greatest(q, F.lit(1))))) - 1
    return numbered.withColumn("fold", fold.cast("int")).drop("rn")


def kfold_hash(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Large-scale mode: fold = hash(key, seed) mod k, map-only (no ordering,
    fold sizes differ slightly).  The hash is the md5-derived integer of
    ``hash_int`` so other engines can reproduce the assignment."""
    h = hash_int(F.concat(F.col(key).cast("string"), F.lit("_"), F.lit(str(seed))))
    return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))


def train_test(folded: DataFrame, test_fold: int) -> tuple[DataFrame, DataFrame]:
    return folded.where(F.col("fold") != test_fold), folded.where(F.col("fold") == test_fold)


def fraction(df: DataFrame, key: str, frac: float, seed: int = 42) -> DataFrame:
    """``is_train``: shuffled index < int(n * frac)."""
    cut = F.floor(df.agg(F.count("*")).scalar() * frac)
    return hash_row_number(df, key, seed).withColumn("is_train", F.col("rn") <= cut).drop("rn")


def every_k(df: DataFrame, order: Sequence[str], k: int = 8) -> DataFrame:
    """``holdout``: position (0-based, in ``order``) divisible by k."""
    return (global_row_number(df, list(order)).withColumn("holdout", F.pmod(F.col("rn") - 1, F.lit(k)) == 0)
            .drop("rn"))


def stride_sample(df: DataFrame, order: Sequence[str], m: int) -> DataFrame:
    """Every ``max(n div m, 1)``-th row in ``order`` (starting at the first)."""
    stride = F.greatest(F.floor(df.agg(F.count("*")).scalar() / m), F.lit(1))
    return (global_row_number(df, list(order)).where(F.pmod(F.col("rn") - 1, stride) == 0)
            .drop("rn"))


def epoch_batches(df: DataFrame, key: str, batch: int, seed: int = 42) -> DataFrame:
    """Permutation cut into batches of ``batch`` rows; incomplete tail dropped."""
    keep = F.floor(df.agg(F.count("*")).scalar() / batch) * batch
    rn = F.col("rn")
    return (hash_row_number(df, key, seed).where(rn <= keep)
            .withColumn("batch", F.floor((rn - 1) / batch).cast("long")).drop("rn"))


def complement(df: DataFrame, holdout: DataFrame, key: str) -> DataFrame:
    """All rows minus the holdout rows (by key)."""
    return df.join(holdout.select(key), key, "left_anti")


def drop_head(df: DataFrame, key: Sequence[str], order: str, n: int = 10) -> DataFrame:
    """Discard the first ``n`` rows of every series (skew-safe positions)."""
    from quire.plans.ordering import positions

    return positions(df, list(key), [order], "_pos").where(F.col("_pos") >= n).drop("_pos")


def time_holdout(df: DataFrame, day: str, n: int = 1000) -> DataFrame:
    """``is_test``: the last ``n`` days (day > max(day) - n); max is one scalar."""
    mx = df.agg(F.max(day)).scalar()
    return df.withColumn("is_test", F.col(day) > mx - n)


def segments(df: DataFrame, day: str, length: int, cycles: int, seed: int = 42) -> DataFrame:
    """One contiguous day window of ``length`` per cycle, start from a hash of
    (cycle, seed) over the observed day range.  Output rows carry ``cycle``."""
    lo = df.agg(F.min(day)).scalar()  # lazy scalar subqueries
    hi = df.agg(F.max(day)).scalar()
    span = F.greatest(hi - lo + 1 - length + 1, F.lit(1))
    spark = df.sparkSession
    starts = spark.range(cycles).select(
        F.col("id").cast("int").alias("cycle"),
        (lo + F.pmod(hash_int(F.concat(F.col("id").cast("string"), F.lit("_"), F.lit(str(seed)))),
                     span)).cast("int").alias("_start"))
    # one row per (cycle, day): rows find their cycles by an equi-join
    days = starts.select("cycle", F.explode(F.sequence(F.col("_start"), F.col("_start") + (length - 1))).alias("_day"))
    return df.join(days, F.col(day) == F.col("_day")).select(*df.columns, "cycle")


def draw(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement by uniform row index (hash of draw, seed).

    Rows are numbered in key order with the bucketed global numbering, then
    draws equi-join on the row number (no pair enumeration)."""
    count = df.agg(F.count("*")).scalar()  # lazy scalar subquery
    numbered = global_row_number(df, [key])
    spark = df.sparkSession
    draws = spark.range(n).select(
        F.col("id").alias("draw"),
        (F.pmod(hash_int(F.concat(F.col("id").cast("string"), F.lit("_"), F.lit(str(seed)))), count) + 1)
        .alias("rn"))
    return draws.join(numbered, "rn").drop("rn")


def zip_rows(a: DataFrame, b: DataFrame, order_a: str | Sequence[str], order_b: str | Sequence[str],
             n: int | None = None, strict: bool = False) -> DataFrame:
    """Positional zip: i-th row of ``a`` with i-th row of ``b`` in their orders
    (one or more columns of any sortable type, file names for instance)."""
    if strict:
        ca, cb = a.count(), b.count()
        if ca != cb:
            raise ValueError(f"zip_rows(strict=True): lengths differ ({ca} != {cb})")
    za = global_row_number(a, [order_a] if isinstance(order_a, str) else order_a, name="_pos")
    zb = global_row_number(b, [order_b] if isinstance(order_b, str) else order_b, name="_pos")
    out = za.join(zb, "_pos")
    if n is not None:
        out = out.where(F.col("_pos") <= n)
    return out.withColumnRenamed("_pos", "pos")


def grid(**axes: Sequence) -> Column:
    """Parameter grid as one exploded literal array of structs (no joins)."""
    import itertools
    names = list(axes)
    combos = list(itertools.product(*[axes[k] for k in names]))
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, c)]) for c in combos]))


def chars(text: Column) -> Column:
    """Code points of a text (surrogate pairs stay whole)."""
    return F.regexp_extract_all(text, F.lit(r"(?s)."), 0)


def _points(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def build_vocab(texts: DataFrame, text: str, reserved: Sequence[str] = ("<pad>", "<unk>")) -> DataFrame:
    """Vocabulary (symbol, id): reserved symbols first, then distinct
    characters in code-point order.  A task marks the code points of its texts
    in one table (of the size of Unicode), so the shuffle carries at most one
    row per task and character."""

    def run(batches):
        seen = np.zeros(0x110000, dtype=bool)
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    seen[_points(t)] = True
        yield pd.DataFrame({"symbol": [chr(p) for p in np.flatnonzero(seen)]}, dtype=object)

    distinct = texts.select(F.col(text).alias("text")).mapInPandas(run, "symbol string").distinct()
    numbered = global_row_number(distinct, ["symbol"])
    spark = texts.sparkSession
    res = spark.createDataFrame([(s, i) for i, s in enumerate(reserved)], "symbol string, id int")
    return res.unionByName(numbered.select("symbol", (F.col("rn") - 1 + len(reserved)).cast("int").alias("id")))


def encode(text: Column, by_point: Column, unk: int = 1) -> Column:
    """Ids of the characters; ``by_point`` is the array of ids by code point."""
    return F.transform(chars(text), lambda c: F.coalesce(F.get(by_point, F.ascii(c)), F.lit(unk)))


def decode(ids: Column, symbols: Column) -> Column:
    """Text of ids; ``symbols`` is the array of symbols by id."""
    return F.array_join(F.transform(ids, lambda i: F.get(symbols, i)), "")


def _encoded(texts: pa.Array, by_point: np.ndarray, unk: int = 1) -> pa.Array:
    """Ids of the characters (null for null); ``by_point`` is the array of ids
    by code point, -1 where there is none (its last place is one such)."""
    def one(t):
        if t is None:
            return None
        ids = by_point[np.minimum(_points(t), len(by_point) - 1)]
        return np.where(ids < 0, np.int32(unk), ids)
    return pa.array([one(t) for t in texts.to_pylist()], pa.list_(pa.int32()))


def _decoded(ids: pa.Array, symbols: list[str | None]) -> pa.Array:
    """Text of ids (null for null); ``symbols`` is the list of symbols by id.
    Ids without a symbol give nothing."""
    point = np.array([ord(s) if s is not None and len(s) == 1 else -1 for s in symbols] + [-1], dtype=np.int64)
    flat = ids.values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat[(flat < 0) | (flat >= len(symbols))] = len(symbols)
    at, there = ids.offsets.to_numpy(), ids.is_valid().to_pylist()

    def one(x):
        p = point[x]
        if (p >= 0).all():
            return p.astype("<u4").tobytes().decode("utf-32-le")
        return "".join(symbols[i] or "" for i in x if i < len(symbols))
    return pa.array([one(flat[at[i]:at[i + 1]]) if there[i] else None for i in range(len(ids))], pa.string())


ROWS_HELD = 512  # texts that a task codes at a time


def _mapped(df: DataFrame, key: str, col: str, out: str, kind: str, fn) -> DataFrame:
    """(key, out): ``fn`` (Arrow array to array) of a column, a bounded number of rows at a time."""
    src = df.select(F.col(key).alias("key"), F.col(col).alias("value"))
    schema = T.StructType([src.schema["key"], T.StructField("value", T._parse_datatype_string(kind))])

    def run(batches):
        for part in (b.slice(lo, ROWS_HELD) for b in batches for lo in range(0, b.num_rows, ROWS_HELD)):
            yield pa.RecordBatch.from_arrays([part.column(0), fn(part.column(1))], names=["key", "value"])

    return src.mapInArrow(run, schema).toDF(key, out)


def encode_table(docs: DataFrame, key: str, text: str, vocab: DataFrame, unk: int = 1) -> DataFrame:
    """(key, ids) per document; null texts have null ids.

    One path at every size: the ids of single-character symbols are one array by
    code point (at most 1,114,112 ids, the size of Unicode), sent to a task once."""
    rows = vocab.where(F.char_length("symbol") == 1).select("symbol", "id").toPandas()  # bounded by Unicode
    by_point = np.full(max(map(ord, rows["symbol"]), default=0) + 2, -1, dtype=np.int32)
    by_point[[ord(s) for s in rows["symbol"]]] = rows["id"].to_numpy(np.int32)
    return _mapped(docs, key, text, "ids", "array<int>", lambda x: _encoded(x, by_point, unk))


def decode_table(coded: DataFrame, key: str, ids: str, vocab: DataFrame) -> DataFrame:
    """(key, text) per document from ids of ``build_vocab``'s numbering; ids
    outside of the vocabulary give nothing.  The symbols are one list, bounded
    like the table of ``encode_table``."""
    rows = vocab.select("symbol", "id").toPandas()
    symbols: list[str | None] = [None] * (int(rows["id"].max()) + 1 if len(rows) else 0)
    for s, i in zip(rows["symbol"], rows["id"]):
        symbols[int(i)] = s
    return _mapped(coded, key, ids, "text", "string", lambda x: _decoded(x, symbols))


def vocab_size(a: DataFrame, b: DataFrame, col: str, approx: bool = False) -> DataFrame:
    u = a.select(F.col(col)).union(b.select(F.col(col)))
    f = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return u.agg(f.alias("n_vocab"))


def symbols(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).distinct()


def blocks(tokens: DataFrame, key: str, arr: str, size: int, n_starts: int, seed: int = 42) -> DataFrame:
    """Fixed-length blocks with next-token targets from each token array:
    x = data[i:i+B], y = data[i+1:i+1+B], i = hash(key, j, seed) mod (n - B)."""
    n = F.size(F.col(arr))
    starts = F.sequence(F.lit(0), F.lit(n_starts - 1))
    t = tokens.where(n > size).select(key, arr, F.explode(starts).alias("j"))
    i = F.pmod(hash_int(F.concat_ws("_", F.col(key).cast("string"), F.col("j").cast("string"), F.lit(str(seed)))),
               F.size(F.col(arr)) - size)
    return t.select(key, "j", i.alias("start"),
                    F.slice(F.col(arr), i + 1, size).alias("x"), F.slice(F.col(arr), i + 2, size).alias("y"))


def fewshot_prompts(df: DataFrame, order: str, inp: str, target: str, n: int = 10, sep: str = ", ") -> DataFrame:
    """Groups of ``n`` consecutive rows -> "in1:t1, ..., inN:" (last target left
    out); the incomplete tail is dropped.  Fewer than ``n`` rows are an error
    when the query runs; an empty table gives no prompt."""
    total = df.agg(F.count("*")).scalar()  # lazy scalar subquery
    num = global_row_number(df, [order])
    g = F.floor((F.col("rn") - 1) / n)
    last = F.pmod(F.col("rn") - 1, F.lit(n)) == n - 1
    piece = F.when(last, F.concat(F.col(inp), F.lit(":"))).otherwise(
        F.concat(F.col(inp), F.lit(":"), F.col(target), F.lit(sep)))
    full = F.when(total < n, F.raise_error(F.lit(f"no full group of {n} rows")).cast("long")).otherwise(total - F.pmod(total, F.lit(n)))
    kept = num.where(F.col("rn") <= full).select(g.alias("prompt_no"), "rn", piece.alias("_p"))
    parts = F.array_sort(F.collect_list(F.struct("rn", "_p")))
    return kept.groupBy("prompt_no").agg(F.array_join(F.transform(parts, lambda x: x["_p"]), "").alias("prompt"))


def test_prompts(df: DataFrame, inp: str) -> DataFrame:
    return df.withColumn("prompt", F.concat(F.col(inp), F.lit(":")))


def even_picks(df: DataFrame, group: str, order: str, total: int = 20, span: int = 199) -> DataFrame:
    """Quota of ``total`` picks spread over groups (remainder to the first
    groups in name order); in each group the rows at positions
    floor(linspace(0, span, quota)) of its order.  Only the first span+1
    rows per group are ever needed, so the window is a per-group top-k; the
    picks are at most ``total`` rows, whatever the number of groups."""
    groups = df.select(F.col(group).alias("_g")).distinct()
    n = groups.agg(F.count("*")).scalar()
    base = F.floor(F.lit(total) / n)
    more = (F.col("rn") <= F.lit(total) - base * n).cast("long")
    quota = global_row_number(groups, ["_g"]).select("_g", (base + more).alias("_quota")).where(F.col("_quota") > 0)
    picks = quota.select("_g", "_quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_quota") - 1)).alias("_j")) \
        .select("_g", F.floor(F.col("_j") * span / F.greatest(F.col("_quota") - 1, F.lit(1))).alias("_idx")).distinct()
    w = Window.partitionBy(group).orderBy(order)
    head = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= span + 1)
    return head.join(F.broadcast(picks), head[group].eqNullSafe(picks["_g"]) & (F.col("_rn") - 1 == F.col("_idx"))) \
        .select(*df.columns)
