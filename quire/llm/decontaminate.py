"""Benchmark decontamination: n-gram seeds, then Smith-Waterman scores.

1. Every benchmark item is cut into word n-grams (lower-cased letters and
   digits).  A fixed-size bit table of their hashes (``BITS`` bits, whatever
   the number of items) goes to the tasks, which scan whole documents and
   write only n-grams that may be in a benchmark; the join with the item
   n-grams drops the chance hits of the bit table.
2. Every n-gram of an item is a seed: a passage that shares any of them with
   the item is aligned.  Ranking them by document frequency would count the
   leaked copies, so that copies of an item hide its edited copies.
3. Seed hits of one document and item that lie near each other make one
   passage (two item lengths to both sides).  Passages that share too few words
   with the item to reach ``min_score`` at all are left out (``may_reach``);
   the others are aligned by Smith-Waterman over words (match 2, mismatch -1, gap -1).  The score is
   the best alignment over that of an exact copy: 1 for a copy, about 0.7 with
   every fifth word changed, 0.5 for half of the item.

Defined cases: null or empty texts have no n-grams and no hits; items of fewer
words than ``n`` have no seeds and match nothing.  Rows with the same id and
text are one document; a null id is reported as null.  Repeated items are
reported once per item_id.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import table
from quire.llm.words import BY_LETTER, blocks, grams

BITS = 25
MATCH, MISMATCH, GAP = 2, -1, -1


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, g, words): n-grams of every item."""

    def run(batches):
        for pdf in batches:
            ids = pdf["item_id"].to_numpy()
            for owner, h, _, _, _ in blocks(pdf["text"].tolist(), BY_LETTER):
                g, at = grams(h, owner, n)
                size = np.bincount(owner, minlength=len(ids)) if len(owner) else np.zeros(len(ids), int)
                yield pd.DataFrame({"item_id": ids[owner[at]], "g": g.view(np.int64), "words": size[owner[at]]})

    return items.mapInPandas(run, "item_id long, g long, words int")


def bit_table(seeds: DataFrame) -> np.ndarray:
    """Fixed-size bit table of the hashes in column g (2**BITS bits)."""

    def pack(batches):
        for pdf in batches:
            yield pd.DataFrame({"w": [pdf["w"].to_numpy(np.int32).tobytes()], "b": [pdf["b"].to_numpy(np.int64).tobytes()]})

    rows = seeds.select(F.expr(f"shiftright(g & {(1 << BITS) - 1}L, 6)").cast("int").alias("w"),
                        F.expr("shiftleft(1L, cast(g & 63 as int))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).mapInPandas(pack, "w binary, b binary")
    bits = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    for r in rows.toLocalIterator():
        bits[np.frombuffer(r["w"], np.int32)] = np.frombuffer(r["b"], np.int64).view(np.uint64)
    return bits


def may_hold(df: DataFrame, key: str):
    """Whether a hash may be among those in column ``key`` of ``df`` (a function
    of a column, by ``bit_table``): spares a join the rows that cannot match."""
    bits = df.sparkSession.sparkContext.broadcast(bit_table(df.select(F.col(key).alias("g"))))

    def found(g: pd.Series) -> pd.Series:
        g = g.to_numpy(np.int64).view(np.uint64)
        at = (g & np.uint64((1 << BITS) - 1)) >> np.uint64(6)
        return pd.Series((bits.value[at] >> (g & np.uint64(63))) & np.uint64(1) > 0)

    return F.pandas_udf(found, "boolean")


def hits(docs: DataFrame, seeds: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, g, at): n-grams of whole documents that may be among ``seeds``;
    ``key`` is Spark's xxhash64 of the text, ``at`` the word place."""
    bits = docs.sparkSession.sparkContext.broadcast(bit_table(seeds))

    def run(batches):
        import xxhash

        mask = np.uint64((1 << BITS) - 1)
        for pdf in batches:
            ids, texts = pdf["id"].to_numpy(), pdf["t"].tolist()
            keys: dict[int, int] = {}
            for owner, h, _, _, _ in blocks(texts, BY_LETTER):
                g, at = grams(h, owner, n)
                on = (bits.value[(g & mask) >> np.uint64(6)] >> (g & np.uint64(63))) & np.uint64(1) > 0
                g, at = g[on], at[on]
                if not len(g):
                    continue
                who = owner[at]
                first = np.searchsorted(owner, who)  # owners are in order inside a block
                for i in np.unique(who):
                    if i not in keys:
                        k = xxhash.xxh64_intdigest((texts[i] or "").encode("utf-8", "replace"), 42)
                        keys[i] = k - ((k >> 63) << 64)
                yield pd.DataFrame({"id": pd.Series(ids[who]).astype("Int64"), "key": [keys[i] for i in who],
                                    "g": g.view(np.int64), "at": at - first})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return src.mapInPandas(run, "id long, key long, g long, at int")


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Smith-Waterman of each item with its passage: (score, first, last + 1)
    in passage words.  All pairs advance together, one item word a step."""
    score, end = _sweep(items, passages)
    back = [p[:e][::-1] for p, e in zip(passages, end)]
    _, length = _sweep([i[::-1] for i in items], back, want=score)
    return [(int(s), int(e - n), int(e)) for s, e, n in zip(score, end, length)]


def _sweep(items, passages, want=None):
    """Best score and the passage place where it is (first) reached."""
    rows, wide = len(items), max((len(p) for p in passages), default=0)
    tall = max((len(i) for i in items), default=0)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    if not rows or not wide or not tall:
        return best, end
    p = np.zeros((rows, wide), np.uint64)
    there = np.zeros((rows, wide), bool)
    q = np.zeros((rows, tall), np.uint64)
    size = np.array([len(i) for i in items])
    for r, (i, x) in enumerate(zip(items, passages)):
        p[r, :len(x)], there[r, :len(x)], q[r, :len(i)] = x, True, i
    slope = np.arange(wide, dtype=np.int32) * -GAP
    h = np.zeros((rows, wide + 1), np.int32)
    done = np.zeros(rows, bool)
    for k in range(tall):
        pair = np.where((p == q[:, k:k + 1]) & there, MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(np.maximum(h[:, :-1] + pair, h[:, 1:] + GAP), 0)
        # gaps along the passage: running maximum of value + place
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[~there] = 0
        new[size <= k] = 0
        h[:, 1:] = new
        top = new.max(axis=1)
        up = top > best if want is None else (top == want) & ~done
        best = np.where(up, top, best)
        end = np.where(up, new.argmax(axis=1) + 1, end)
        done |= up
    return best, end


def may_reach(item: np.ndarray, passage: np.ndarray, min_score: float) -> bool:
    """Whether the words that both have, each as often as the rarer side, would
    score ``min_score`` if all of them matched: no alignment scores more."""
    words, count = np.unique(item, return_counts=True)
    there, often = np.unique(passage, return_counts=True)
    at = np.minimum(np.searchsorted(there, words), len(there) - 1)
    same = np.minimum(count, often[at])[there[at] == words].sum() if len(there) else 0
    return bool(same >= min_score * len(item))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3,
          min_score: float = 0.5) -> DataFrame:
    """(id, key, item_id, score, first_word, last_word): the best passage of
    every document and item with a score of ``min_score`` or more; word places
    count from 0, ``last_word`` included."""
    items = table(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
                  .where("text is not null").distinct(), "bench-items")
    item = table(item_grams(items, n).groupBy("item_id", "g").agg(F.max("words").alias("words")), "bench-grams")
    every = table(hits(docs, item.select("g").distinct(), n, id_col, text_col), "bench-hits")
    cell = F.floor(F.col("at") / (2 * F.col("words")))
    spots = every.join(item, "g").groupBy("id", "key", "item_id", "words", cell.alias("cell")) \
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    spots = spots.select("id", "key", "item_id", F.greatest(F.lit(0), F.col("lo") - 2 * F.col("words")).alias("lo"),
                         (F.col("hi") + 2 * F.col("words") + n).alias("hi"))
    per_doc = table(spots.groupBy("id", "key").agg(F.collect_list(F.struct("item_id", "lo", "hi")).alias("spots")),
                    "bench-spots")
    with_text = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("dk"),
                            F.col(text_col).alias("t"))
    with_text = with_text.join(per_doc.hint("merge"), F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("dk"))) \
        .select("id", "key", "spots", "t").dropDuplicates(["id", "key"])

    def cut(batches):
        for pdf in batches:
            rows = []
            for i, key, spots, text in zip(pdf["id"], pdf["key"], pdf["spots"], pdf["t"]):
                start, end, raw = [], [], (text or "").encode("utf-8", "replace")
                for _, _, s, e, _ in blocks([text], BY_LETTER):
                    start, end = s, e
                for x in spots:
                    a, b = x["lo"], min(x["hi"], len(start))
                    rows.append((i, key, x["item_id"], a, raw[start[a]:end[b - 1]].decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["id", "key", "item_id", "lo", "passage"])
            out["id"] = out["id"].astype("Int64")
            yield out

    passages = with_text.mapInPandas(cut, "id long, key long, item_id long, lo int, passage string")
    pairs = passages.join(items, "item_id")

    def rate(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                q = [_hashes(t) for t in part["text"]]
                p = [_hashes(t) for t in part["passage"]]
                on = [i for i in range(len(q)) if may_reach(q[i], p[i], min_score)]
                for s in _by_size(p, on):
                    found = align([q[i] for i in s], [p[i] for i in s])
                    rows = part.iloc[s]
                    yield pd.DataFrame({
                        "id": rows["id"].astype("Int64"), "key": rows["key"], "item_id": rows["item_id"],
                        "score": [f[0] / (MATCH * len(q[i])) for f, i in zip(found, s)],
                        "first_word": rows["lo"].to_numpy() + [f[1] for f in found],
                        "last_word": rows["lo"].to_numpy() + [f[2] - 1 for f in found]})

    scored = pairs.mapInPandas(rate, "id long, key long, item_id long, score double, first_word int, last_word int") \
        .where(F.col("score") >= min_score)
    best = F.max_by(F.struct("score", "first_word", "last_word"),
                    F.struct("score", -F.col("first_word"), -F.col("last_word"))).alias("b")
    return scored.groupBy("id", "key", "item_id").agg(best).select("id", "key", "item_id", "b.*")


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([h for _, h, _, _, _ in blocks([text], BY_LETTER)])


def _by_size(p, on, cells: int = 1 << 20):
    """Lists of the indices ``on``, pairs of like size whose padded tables stay small."""
    order = sorted(on, key=lambda i: len(p[i]))
    part: list[int] = []
    for i in order:
        if part and (len(part) + 1) * len(p[i]) > cells:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    bad = table(leaks(docs, benchmark, id_col, text_col, **options).select("id", "key").distinct(), "bench-leaks") \
        .select(F.col("id").alias("__leak_id"), F.col("key").alias("__leak_key"))
    return docs.join(bad.hint("merge"), docs[id_col].cast("long").eqNullSafe(F.col("__leak_id"))
                     & (F.xxhash64(docs[text_col]) == F.col("__leak_key")), "left_anti")
