"""The character model against a dictionary version, its pieces and its limits."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from quire.llm import char_model, kn_quality
from quire.llm.decontaminate import may_hold

S, E = "\x02", "\x03"


def plain(texts):
    """log p(text) by modified Kneser-Ney over dictionaries."""
    pad = lambda t: [S] * 4 + list(t) + [E]
    grams = lambda t: [tuple(pad(t)[i:i + 5]) for i in range(len(t) + 1)]
    c = {5: Counter(g for t in texts for g in grams(t))}
    for k in (4, 3, 2, 1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    total, cut = {}, {}
    for k, level in c.items():
        n = [0] + [sum(v == i for v in level.values()) for i in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)]
        total[k], cut[k] = defaultdict(int), defaultdict(float)
        for g, v in level.items():
            total[k][g[:-1]] += v
            cut[k][g[:-1]] += d[min(v, 3)]
        c[k] = {g: v - d[min(v, 3)] for g, v in level.items()}

    def p(g):
        if not g:
            return 1 / (len(c[1]) + 1)
        k = len(g)
        if g[:-1] not in total[k]:
            return p(g[1:])
        return c[k].get(g, 0) / total[k][g[:-1]] + cut[k][g[:-1]] / total[k][g[:-1]] * p(g[1:])

    return lambda t: sum(math.log(p(g)) for g in grams(t))


def test_scores_equal_a_dictionary_model(spark):
    rng = random.Random(27)
    text = lambda n: " ".join(rng.choice(["the", "Haus", "naïve", "мир", "word", "worn", "☃😀"]) for _ in range(n))
    train = [text(n) for n in (2, 9, 30) for _ in range(8)]
    texts = [*train, text(12), "zebra quilt", "a", "", None, "word" * 40]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    key = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    model = [plain([t for t in train if key[t] & 1 == 1 - h]) for h in (0, 1)]
    counts = kn_quality.gram_counts(spark.createDataFrame([("en", t) for t in train], "lang string, text string")) \
        .where("hi >= 0").select(F.col("g").alias("half"), "hi", "lo", "c").localCheckpoint()
    for slots in (8, 1 << 12):  # nearly all asked of the shards; some held by the task
        got = {r["key"]: r for r in char_model.score(df.select("text"), counts, 30, slots=slots).collect()}
        assert set(got) == set(key.values())
        for t, k in key.items():
            assert got[k]["chars"] == len(t or "")
            if not t:
                assert got[k]["char_log_perplexity"] is None
            else:
                assert abs(got[k]["char_log_perplexity"] + model[k & 1](t) / (len(t) + 1)) < 1e-4, (slots, t)


def test_windows_of_divided_texts():
    texts = ["Ab é☃" * 9, None, "", "xyz", "q" * 31]
    want = [np.concatenate(x) for x in zip(*map(char_model.windows, char_model.pieces(texts)))]
    for size in (1, 3, 7, 40):
        got = [np.concatenate(x) for x in zip(*map(char_model.windows, char_model.pieces(texts, size)))]
        assert all(np.array_equal(a, b) for a, b in zip(got, want))


def test_every_language_has_limits(spark):
    """Three trusted rows are enough for a language's own, shrunk ones."""
    rng = random.Random(3)
    rows = [("en", 100, 2 + rng.random()) for _ in range(50)] + [("fr", 100, 4 + rng.random()) for _ in range(3)] + [(None, 100, 3.0)]
    base = spark.createDataFrame(rows, "lang string, chars long, char_log_perplexity double")
    got = kn_quality.char_limits(base, 0.05, 1.0)
    assert set(got) == {"en", "fr", "*"} and got["en"][0] < got["fr"][0] < 4.5
    assert all(low < 0 < high for _, low, high in got.values())
    assert kn_quality.char_limits(base.limit(1), 0.05, 1.0) == {} == kn_quality.char_limits(base.limit(0), 0.05, 1.0)


def test_bit_table_holds_every_key(spark):
    """``may_hold`` spares a join rows without a match, and never one with."""
    held = spark.range(0, 3000).select(F.xxhash64("id").alias("g"))
    maybe = may_hold(held, "g")
    some = spark.range(0, 100000).where(maybe(F.xxhash64("id")))
    assert some.where("id < 3000").count() == 3000 and some.count() < 3100


def test_messages_are_small():
    """Asks of a few texts for the same n-grams: sorted differences, two bytes an ask or less."""
    rng = np.random.default_rng(4)
    asks = np.sort(rng.choice(rng.integers(0, 1 << 48, 400, dtype=np.uint64), 50_000) << np.uint64(14)
                   | rng.integers(0, 8192, 50_000, dtype=np.uint64))
    for x in (asks, asks[:1], asks[:7], asks[:0], np.array([0, 0, (1 << 62) - 1], np.uint64)):
        wide, data = char_model.pack_sorted(x)
        assert np.array_equal(char_model.unpack_sorted(len(x), wide, data), x)
    assert sum(map(len, char_model.pack_sorted(asks))) < 2 * len(asks)


def test_short_parts_are_held_first(spark):
    """Every missing n-gram asks for a part of each length: the few short ones are held before the many long ones."""
    rows = [(k, (k + 1 << 40) + 32 * k + i, 0.5, c) for k, n, c in ((0, 50, 9), (1, 10, 1), (6, 10, 1), (2, 20, 2), (4, 300, 500)) for i in range(n)]
    whole, parts = char_model.frequent(spark.createDataFrame(rows, "kind int, key long, v float, c long"), slots=512)
    key = lambda k, n: np.array([(k + 1 << 40) + 32 * k + i for i in range(n)], np.uint64)
    assert all(parts(key(k, n))[0].all() for k, n in ((1, 10), (6, 10), (2, 20)))
    assert whole(key(0, 50))[0].all()


def test_models_hold_no_shuffle(spark):
    """Every order is written: what the driver plans does not grow with the orders joined."""
    counts = kn_quality.gram_counts(spark.createDataFrame([("en", "a word or two"), ("en", "another word")], "lang string, text string")).localCheckpoint()
    chars = char_model.train(counts.where("hi >= 0").select(F.col("g").alias("half"), "hi", "lo", "c"))[0]
    symbols = kn_quality.train(counts.where("hi < 0 and g >= 0").select("lang", "g", "c"))
    for model in (chars, symbols):
        assert "Exchange" not in model._jdf.queryExecution().executedPlan().toString()
