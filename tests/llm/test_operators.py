"""Each operator on small tables: edge cases and brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import (
    ann_partitions,
    budget_mix,
    chat_masks,
    decontaminate,
    ef_trie_lm,
    kn_quality,
    license_scan,
    line_runs,
    simhash_trie,
    site_style,
)
from quire.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ord int, id string, __n int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    full = [(i, t, "en", "src1", len(t or ""), 7, "x", 1) for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def some_text(rng, n, words=("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta")):
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


# ------------------------------------------------------------- 1 neighbours

def test_search_finds_near_vectors_and_breaks_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 2000)] + 0.3 * rng.standard_normal((2000, 16))
    x[100:140] = x[100]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16), (9004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_partitions.search(df, F.col("id") % 20 == 0, k=10).toPandas()
    assert set(got["query_id"]) == set(range(0, 2000, 20))
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        exact = (x * x[q]).sum(1)
        best = [j for j in np.lexsort((np.arange(2000), -exact)) if j != q][:10]
        hit += len(set(best) & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and (np.diff(g["score"]) <= 0).all()
        assert np.array_equal(g["score"].to_numpy(), exact[g["vec_id"].to_numpy()])
    assert hit / (10 * 100) >= 0.9
    tied = [v for v in got[got["query_id"] == 100].sort_values("rank")["vec_id"] if 101 <= v < 140]
    assert tied == list(range(101, 101 + len(tied)))


def test_search_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann_partitions.search(df, F.col("id") == 0, k=20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 1, 2.0), (2, 2, 2.0)]
    assert ann_partitions.search(df.limit(0), F.col("id") == 0).count() == 0


# ---------------------------------------------------------------- 2 simhash

def test_simhash_fingerprint_is_spark_xxhash(spark):
    assert simhash_trie.fingerprint(None) == simhash_trie.fingerprint(" \t\n") == 0
    one = spark.range(1).select(F.xxhash64(F.lit("a b")).alias("h")).first()["h"]
    assert simhash_trie.fingerprint("A\x0bB") == one % (1 << 64)


@pytest.mark.parametrize("pair_rows", [1 << 16, 40])
def test_trie_join_equals_brute_force(spark, pair_rows):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for b in base[:60]:
        for _ in range(3):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    leaves = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = components(simhash_trie.links(leaves, 3, pair_rows)).collect()
    root = {f: f for f in signed}
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                old, new = root[signed[a]], root[signed[b]]
                root = {k: new if v == old else v for k, v in root.items()}
    low = {}
    for k, v in root.items():
        low[v] = min(low.get(v, k), k)
    want = {k: low[v] for k, v in root.items()}
    assert {r["node"]: r["component"] for r in got} == {k: c for k, c in want.items()
                                                       if sum(x == c for x in want.values()) > 1}


def test_near_groups_edge_cases_and_keep_first(spark):
    rng = random.Random(2)
    long = some_text(rng, 400)
    rows = [(5, long), (3, long.upper()), (9, long), (1, None), (2, ""), (7, "one two"), (7, "one two"),
            (None, "lonely words here"), (None, long)]
    df = docs_of(spark, rows)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_trie.near_groups(df).collect()}
    by_id = {i: c for i, _, c in got if i is not None}
    assert by_id == {5: 3, 3: 3, 9: 3, 1: 1, 2: 1, 7: 7}
    assert {c for i, _, c in got if i is None} == {3, None}
    kept = simhash_trie.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted(
        [(3, long.upper()), (1, ""), (7, "one two"), (-1, "lonely words here")])
    assert simhash_trie.near_groups(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}}


# ------------------------------------------------------------------- 3 chat

def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<\\/s> <\\\\s>", "[ROLE]a[/ROLE]<s>", "", None, "naïve 日本 🙂 x", "a\\b </s", "[/INST"]
    rows = [(i, t, role, text) for i in range(3) for t, (role, text) in enumerate(
        (r, x) for r in ("system", "user", "assistant", "tool</s>", None) for x in hard)]
    rows += [(None, 0, "assistant", " lead and trail \n"), (4, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_masks.digests(chat_masks.format_conversations(df)).collect()}
    turns = [(r or "", x or "") for _, _, r, x in rows[:40]]
    whole = "".join(f"{r}\n{x}\n" for r, x in turns)
    loss = "".join(x for r, x in turns if r == "assistant")
    for i in range(3):
        assert got[i]["n_turns"] == 40 and got[i]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[i]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[i]["loss_chars"] == len(loss)
    assert got[None]["loss_chars"] == len(" lead and trail \n") and got[4]["loss_chars"] == 0
    assert chat_masks.format_conversations(df.limit(0)).count() == 0


def test_token_mask_stays_inside_spans():
    offsets = np.array([[0, 4], [4, 6], [4, 6], [6, 9], [9, 12]])
    mask, ranges = chat_masks.token_mask(offsets, [(5, 8), (12, 12)])
    assert mask.tolist() == [0, 1, 1, 1, 0] and ranges == [[5, 8]]


# -------------------------------------------------------------------- 4 mix

def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "l_0 string, l_1 string, tokens long")
    weights = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0)], "level int, name string, weight double")
    got = {(r["l_0"], r["l_1"]): r["get"] for r in budget_mix.budgets(leaves, ["d", "l"], weights, 400.0, 2).collect()}
    assert got == {("a", "x"): 20, ("a", "y"): 180, ("b", "x"): 200}
    got = {(r["l_0"], r["l_1"]): r["get"] for r in budget_mix.budgets(leaves, ["d", "l"], weights, 4010.0, 2).collect()}
    assert got == {("a", "x"): 20, ("a", "y"): 1990, ("b", "x"): 2000}


def test_mix_is_seeded_and_whole(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), "en" if i % 2 else None, f"s{i % 3}", 0, 1, "x", 1) for i in range(300)]
    df = spark.createDataFrame(rows + [(900, None, "en", "s1", 0, 1, "x", 1), (5, rows[5][1], "en", "s2", 0, 1, "x", 1)], DOCS)
    levels = [("lang", F.col("lang")), ("source", F.col("source"))]
    none = spark.createDataFrame([], "level int, name string, weight double")
    take = lambda **o: sorted(tuple(r) for r in budget_mix.mix(df, levels, none, **o).select(
        F.coalesce("doc_id", F.lit(-1)), "mix_epoch", "mix_tokens").collect())
    a, b = take(budget_share=0.5), take(budget_share=0.5)
    assert a == b != take(budget_share=0.5, seed=4)
    total = sum(len(r[1].split()) for r in rows) + len(rows[5][1].split())
    assert 0.4 * total < sum(r[2] for r in a) <= 0.5 * total
    assert sum(r[2] for r in take(budget=1e9, max_epochs=3)) == 3 * total
    assert budget_mix.mix(df.limit(0), levels, none).count() == 0
    with pytest.raises(ValueError):
        budget_mix.mix(df, levels, spark.createDataFrame([(0, "en", 0.0)], none.schema))


def test_mix_tells_rows_of_one_id_and_text_apart_by_leaf(spark):
    text = "one two three four"
    rows = [(1, text, "en", "a"), (1, text, "en", "b"), (2, "five six", "en", "a"), (2, "five six", None, None)] + \
        [(10 + i, some_text(random.Random(i), 9), "en", "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("mix_tokens", F.lit(-1)) \
        .withColumn("mix_epoch", F.lit("x"))
    weights = spark.createDataFrame([(1, "b", 0.5)], "level int, name string, weight double")
    levels = [("lang", F.col("lang")), ("source", F.col("source"))]
    for budget in (0.0, 3.0, 10.0, 60.0, 150.0):
        got = budget_mix.mix(df, levels, weights, budget=budget, max_epochs=3).collect()
        plan = budget_mix.select_copies(df, levels, weights, budget=budget, max_epochs=3).collect()
        assert sum(r["mix_tokens"] for r in got) == sum(r["tokens"] * r["copies"] for r in plan) <= budget
        assert {(r["doc_id"], r["source"]) for r in got} == {(r["id"], r["l_1"]) for r in plan}


def test_keep_first_with_one_id_for_different_texts(spark):
    rng = random.Random(21)
    a, b, c = (some_text(rng, 200) for _ in range(3))
    df = docs_of(spark, [(7, a), (7, b), (7, a), (8, a + " "), (9, c), (3, c)])
    assert sorted((r["doc_id"], r["text"]) for r in simhash_trie.keep_first(df).collect()) == sorted([(7, a), (7, b), (3, c)])


# ---------------------------------------------------------- 5 decontaminate

def test_alignment_scores():
    h = lambda s: decontaminate._hashes(s)
    item = h("a b c d e f g h i j")
    got = decontaminate.align([item] * 4, [h("x y a b c d e f g h i j z"), h("a b c X e f g h i j"), h("q r s"),
                                           h("a b c d e")])
    assert got[0] == (20, 2, 12) and got[1][0] == 17 and got[2][0] == 0 and got[3] == (10, 0, 5)


def test_leaks_finds_copies_and_edits_only(spark):
    rng = random.Random(4)
    items = [(i, some_text(rng, 40)) for i in range(12)] + [(50, None), (51, ""), (52, "two words"), (1, None)]
    words = items[0][1].split()
    edited = " ".join(w if k % 6 else "changed" for k, w in enumerate(words))
    texts = [(1, some_text(rng, 200) + " " + items[3][1].upper() + ". " + some_text(rng, 50)), (2, edited),
             (3, some_text(rng, 300)), (4, None), (5, ""), (None, "pre " + items[5][1])]
    texts += [(100 + i, some_text(rng, 20) + " " + items[7][1]) for i in range(30)] + [(100, items[7][1])]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): r for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(1, 3), (2, 0), (None, 5)} | {(100 + i, 7) for i in range(30)}
    assert got[1, 3]["score"] == 1.0 and got[1, 3]["first_word"] == 200 and got[1, 3]["last_word"] == 239
    assert 0.6 < got[2, 0]["score"] < 0.9
    kept = decontaminate.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0
    assert decontaminate.leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("copies,gone", [(1, range(0, 40, 5)), (5, range(0, 40, 5)), (1, range(0, 40, 4)), (30, range(18))])
def test_copies_do_not_hide_an_edited_copy(spark, copies, gone):
    words = [f"w{k}" for k in range(40)]
    edited = [f"x{k}" if k in gone else w for k, w in enumerate(words)]
    texts = [(i, " ".join(words)) for i in range(copies)] + [(100, " ".join(edited)), (101, "only w3 w4 w5 of it")]
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = {r["id"]: r["score"] for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert set(got) == {*range(copies), 100} and got[0] == 1 and 0.5 < got[100] < 0.8


def test_pairs_left_out_cannot_reach_the_score():
    rng = np.random.default_rng(5)
    for _ in range(200):
        item, passage = (rng.integers(0, 12, n).astype(np.uint64) for n in rng.integers(1, 30, 2))
        score = decontaminate.align([item], [passage])[0][0] / (decontaminate.MATCH * len(item))
        assert decontaminate.may_reach(item, passage, score)


# ---------------------------------------------------------------- 6 license

def test_license_places_and_fuzzy_notice(spark):
    rows = [(1, "MIT License, mit-license. The APACHE  license"), (2, None), (3, ""), (4, "permit license"),
            (5, "Relased under the MIT Licence."), (6, "Éa général public license general public license"),
            (7, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert [got[1][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")] == [7, 3, 0, 5, "apache,mit"]
    assert got[2]["n_words"] == 0 and got[2]["first_word"] is None and got[2]["labels"] == "" and got[3]["score"] == 0.0
    assert got[4]["n_base"] == 0 and got[5]["base_labels"] == "" and got[5]["labels"] == "mit"
    assert 0.8 < got[5]["score"] < 1 and got[5]["spans"][0]["first_word"] == 0
    assert (got[6]["n_base"], got[6]["first_word"]) == (1, 4) and got[7]["labels"] == "cc-by-nc"


def test_pigeonhole_finds_every_bounded_match():
    rng = random.Random(6)
    notice = license_scan.Notice("released under the mit license", "mit")
    for _ in range(200):
        s = list(notice.text.decode())
        for _ in range(rng.randrange(notice.errors + 1)):
            k = rng.randrange(len(s))
            s[k:k + 1] = rng.choice([[], ["q"], [s[k], "z"]])
        norm, _ = license_scan.normalise(some_text(rng, 30) + " " + "".join(s) + " " + some_text(rng, 30))
        assert notice.find(norm)


# ---------------------------------------------------------------- 7 quality

def test_kneser_ney_sums_to_one_and_judges(spark):
    rng = random.Random(7)
    good = [(i, ". ".join(some_text(rng, 12).capitalize() for _ in range(8)), "en" if i % 2 else "de") for i in range(120)]
    bad = [(1000 + i, " ".join(w + "###" for w in some_text(rng, 60).split()).upper(), "en") for i in range(10)]
    rest = [(2000, None, "en"), (2001, "", None), (2002, good[0][1], "xx"), (2003, good[1][1], None), (None, good[2][1], "en")]
    df = spark.createDataFrame(good + bad + rest, "doc_id long, text string, lang string").withColumn("keep", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(1001, 0, 0), (1002, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    shards, _, _ = kn_quality.fit(df, labels)
    for rows in shards.values():
        p = np.exp(kn_quality.dense(rows).astype(float)).reshape(-1, kn_quality.SYMBOLS).sum(1)
        assert np.allclose(p, 1, atol=1e-4)
    got = {r["doc_id"]: r["keep"] for r in kn_quality.judge(df, labels).collect()}
    assert all(got[i] for i, *_ in good) and not any(got[i] for i, *_ in bad)
    assert not got[2000] and not got[2001] and got[2002] and got[2003] and got[None]
    kept = kn_quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(got.values())
    assert kn_quality.keep_good(df, labels.limit(0)).count() == len(good) + len(bad) + 3
    assert kn_quality.judge(df.limit(0), labels).count() == 0


def test_limits_of_null_unseen_small_and_many_languages(spark):
    rng = random.Random(17)
    text = lambda: ". ".join(some_text(rng, 12).capitalize() for _ in range(4))
    many = [f"l{k:02d}" for k in range(34)]
    good = [(i, text(), many[i % 34]) for i in range(34 * 20)] + [(5000, text(), "one")]
    clean = [(6000 + i, text(), lang) for i, lang in enumerate([None, "none", "one", "one", "l00", "l33"])]
    noise = [(7000 + i, (some_text(rng, 40) + "###").upper(), lang) for i, lang in enumerate([None, "none", "one", "l00", "l33"])]
    df = spark.createDataFrame(good + clean + noise, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good], "doc_id long, quality int, toxic int")
    shards, limits, scored = kn_quality.fit(df, labels, tail=0.05, slack=3.0)
    assert set(limits) == {*many, "*"} and len(set(limits.values())) == 35 and len(list(shards.values())) == 35
    used = {r["id"]: r["model_lang"] for r in scored.collect()}
    assert [used[6000 + i] for i in range(6)] == ["*", "*", "*", "*", "l00", "l33"] and len(used) == len(good + clean + noise)
    got = {r["doc_id"]: r["keep"] for r in kn_quality.judge(df, labels, tail=0.05, slack=3.0).collect()}
    assert all(got[6000 + i] for i in range(6)) and not any(got[7000 + i] for i in range(5))
    kept = kn_quality.keep_good(df, labels, tail=0.05, slack=3.0)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}


def test_long_text_in_pieces():
    text = "Ab é" * 1000
    assert np.array_equal(np.concatenate(list(kn_quality._pieces(text, 97))), kn_quality._codes(text))


# --------------------------------------------------------------------- 8 lm

def test_elias_fano_and_trie_in_a_mapped_file(tmp_path):
    rng = np.random.default_rng(8)
    v = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    ef = ef_trie_lm.EliasFano(ef_trie_lm.EliasFano.encode(v))
    at = np.arange(3000)
    assert np.array_equal(ef.get(at), v)
    ask = np.concatenate((v, v + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64), [np.uint64(0)]))
    lo, hi = np.zeros(len(ask), np.int64), np.full(len(ask), 3000)
    assert np.array_equal(ef.successor(ask, lo, hi), np.searchsorted(v, ask))
    ctx = np.sort(rng.integers(0, 50, 900)).astype(np.uint64) * np.uint64(977)
    pairs = sorted({(int(c), int(w)) for c, w in zip(ctx, rng.integers(0, 300, 900))})
    c, w = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
    raw, words = ef_trie_lm.build_shard(c, w, np.ones(len(c), np.int64))
    (tmp_path / "level").write_bytes(raw)
    trie = ef_trie_lm.Trie(np.memmap(tmp_path / "level", dtype=np.uint8, mode="r"))
    number = trie.context(c)
    assert (number >= 0).all() and (trie.context(c + np.uint64(1)) == -1).all()
    every = trie.lookup(np.repeat(np.unique(number), len(words)), np.tile(np.arange(len(words)), len(np.unique(number))))
    assert (every != ef_trie_lm.UNSEEN).sum() == len(pairs)


@pytest.mark.parametrize("block_bytes", [1 << 22, 3000])
def test_lm_scores_against_plain_counts(spark, block_bytes):
    rng = random.Random(9)
    rows = [(i, some_text(rng, rng.randrange(1, 80))) for i in range(120)] + [(500, None), (501, " \t"), (502, "Ab\x0bab"),
                                                                            (None, "alpha1"), (3, "again again")]
    got = ef_trie_lm.score(docs_of(spark, rows), block_bytes=block_bytes).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n,
                    round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                   for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    assert ef_trie_lm.score(docs_of(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------ 9 lines

def plain_line_dedup(rows, least=50):
    """All windows of at least ``least`` words that occur before, by brute force."""
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        raw = [k for k, x in enumerate(lines) if x.split()]
        gone = set()
        for a in range(len(raw)):
            for b in range(a + 1, len(raw) + 1):
                win = tuple(lines[k] for k in raw[a:b])
                if sum(len(x.split()) for x in win) >= least and first.setdefault(win, (i, a)) != (i, a):
                    gone |= set(raw[a:b])
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(10)
    pool = [some_text(rng, rng.choice([3, 8, 20, 30, 60])) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else some_text(rng, 5) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(x for y in lines for x in ((y, "") if rng.random() < 0.2 else (y,)))))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\nextra line"), (102, ""), (103, "\n".join([pool[0]] * 40))]
    got = {r["doc_id"]: r["text"] for r in line_runs.drop_repeats(docs_of(spark, rows)).collect()}
    assert got == plain_line_dedup(rows)


def test_line_runs_edge_cases(spark):
    text = "\n".join("w%d " % k * 30 for k in range(4))
    df = docs_of(spark, [(2, text), (1, text), (1, text), (None, None), (3, ""), (4, " \n\t\n")])
    got = sorted(((r["doc_id"] or 0), r["text"] or "", r["__deleted"]) for r in line_runs.drop_repeats(df).collect())
    assert got == [(0, "", 0), (1, text, 0), (1, text, 0), (2, "", 4), (3, "", 0), (4, " \n\t\n", 0)]
    assert line_runs.drop_repeats(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 10 html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p><article>no</article>";</script></head>
<body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad top">Buy</div><!-- <p>c</p> -->
<article class="post"><header><h1>Head &amp; line</h1><span>by me</span></header><p><b>One&nbsp;two
 three.<br><p>Caf&eacute; &#x41; &am x</p><ul><li>a<li>b</ul><form>f</form><div class="share">s</div>
<div class="comments"><p>reader</p></div><table><tr><td>1</td><td>2</td></tr></table></article><footer>&copy;</footer>"""


def test_notices_close_to_each_other_and_long_texts():
    import time

    notices = [license_scan.Notice(t, label) for t, label in license_scan.NOTICES]
    got = license_scan.scan_text("released undor the mit license and released under the mit license", notices)["spans"]
    assert [(s["first_word"], s["last_word"], s["errors"]) for s in got] == [(0, 4, 1), (6, 10, 0)]
    rng = random.Random(3)
    for n in notices:  # every planted copy with up to k errors is found, at its place
        words, want = [], []
        for _ in range(6):
            words += some_text(rng, rng.randrange(1, 9)).split()
            text = bytearray(n.text)
            for _ in range(rng.randrange(n.errors + 1)):
                k = rng.randrange(1, len(text) - 1)
                if text[k] != 32:
                    text[k] = ord("q")
            want.append(len(words))
            words += text.decode().split()
        spans = license_scan.scan_text(" ".join(words), [n])["spans"]
        assert [s["first_word"] for s in spans] == want
    sizes, times = (500, 4000), []
    for k in sizes:
        start = time.time()
        r = license_scan.scan_text("released under the mit license " * k, notices)
        times.append(time.time() - start)
        assert len(r["spans"]) == r["n_base"] == k and r["last_word"] == 5 * k - 2
    assert times[1] < 30 * times[0]  # eight times the text


def test_main_text():
    assert site_style.main_text(PAGE).split("\n\n") == ["Head & line", "One two three.", "Café A &am x", "a", "b", "1 2"]
    assert site_style.main_text(None) == site_style.main_text("") == site_style.main_text("<p") == ""
    assert site_style.main_text("<p>a<p>b <i>c</i>d") == "a\n\nb cd"
    assert site_style.main_text("<div>" * 5000 + "deep") == "deep"
    assert site_style.main_text("a <b>x</b> &lt; 3<p>c <i <b>d</i> e") == "a x < 3\n\nc d e"
    assert site_style.main_text("one <!-- two > three") == "one" and site_style.main_text("1 <!-- > --> 2 <? 3") == "1 2"


def test_long_malformed_pages_are_read_once():
    import time

    for part in ("<a ", "<a \"", "<a '\"", "<!x", "</", "<div><p ", "x>", "<a \">"):
        for tail in ("", ">", "\">"):
            start = time.time()
            site_style.main_text(part * (1_000_000 // len(part)) + tail)
            assert time.time() - start < 20  # some tenths of a second; quadratic reading takes hours


def test_style_tree_finds_template_under_many_wrappers(spark):
    note = "<div>" * 12 + '<div class="strip"><p>Same words on every page</p></div>' + "</div>" * 12
    rows = [(i, f"//a.example/{i}", f"<body>{note}<div class='txt'><p>Story number {i} tells of {i * 7}</p></div></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in site_style.extract(df).collect()} == {f"Story number {i} tells of {i * 7}" for i in range(12)}
    # importance of the merged nodes against a plain computation
    got = {(r["path"], r["up"]): r for r in site_style.style_tree(df).collect()}
    story = next(r for r in got.values() if r["importance"] > 0.99)
    assert story["pages"] == 12 and sum(r["importance"] < 1e-12 for r in got.values()) == 13


def test_style_tree_removes_site_template(spark):
    note = '<div class="strip"><p>Same words on every page</p></div>'
    rows = [(i, f"http://A.example/{i}", f"<body>{note}<div class='txt'><p>Story number {i} tells of {i * 7}</p></div></body>")
            for i in range(12)]
    rows += [(50, "http://b.example/", f"<body>{note}</body>"), (51, None, "<p>x</p>"), (52, "http://a.example/z", None)]
    rows += [(60 + i, "http://c.example/", "<body><div><p>Copied page</p></div></body>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("site", F.lit(1))
    got = {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    assert got[3] == "Story number 3 tells of 21" and got[50] == "Same words on every page"
    assert got[51] == "x" and got[52] == "" and got[60] == "Copied page" and len(got) == len(rows)
    assert site_style.extract(df.limit(0)).count() == 0
