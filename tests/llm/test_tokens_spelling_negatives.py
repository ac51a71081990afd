"""Token files, spelling variants and hard negatives against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives, mixing_coder, spelling, token_files

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, id string, n int, ids binary, tie long, word string"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, b"", 2, "w") for i, t in rows], DOCS)


# ------------------------------------------------------------ 11 token files

def blocks_of(rng, n, vocab, size):
    for k in range(n):
        kind, length = k % 4, int(rng.integers(0, size))
        if kind == 0:
            yield rng.integers(0, vocab, length)
        elif kind == 1:
            yield np.full(length, int(rng.integers(0, vocab)))
        elif kind == 2:
            yield np.resize(rng.integers(0, vocab, 7), length)
        else:
            yield np.minimum(rng.zipf(1.3, length), vocab) - 1


@pytest.mark.parametrize("vocab", [2, 256, 50_257, 200_000])
def test_blocks_round_trip(vocab):
    rng = np.random.default_rng(vocab)
    blocks = [b.astype(np.uint32) for b in blocks_of(rng, 24, vocab, 700)]
    data = mixing_coder.encode(blocks, vocab)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, mixing_coder.decode(data, vocab)))
    for k in (1, 5, 6):  # a block is coded and read as if alone
        assert mixing_coder.encode([blocks[k]], vocab) == [data[k]]
        assert np.array_equal(mixing_coder.decode([data[k]], vocab)[0], blocks[k])


def test_damaged_block_is_noticed():
    ids = np.arange(500, dtype=np.uint32) % 37
    data = mixing_coder.encode([ids], 50_257)[0]
    assert len(data) < 500
    for at in (9, 40, len(data) // 2):
        bad = data[:at] + bytes([data[at] ^ 1]) + data[at + 1:]
        with pytest.raises(ValueError):
            mixing_coder.decode([bad], 50_257)
    with pytest.raises(ValueError):
        mixing_coder.decode([data[:10]], 50_257)


def test_mixed_prediction_beats_order_0():
    """Ids that follow from the two before cost far less than their order-0 entropy."""
    rng = np.random.default_rng(1)
    a = [1, 2]
    for _ in range(2046):
        a.append((a[-1] * 31 + a[-2] * 17) % 13 if rng.random() < 0.97 else int(rng.integers(0, 13)))
    data = mixing_coder.encode([np.array(a, np.uint32)], 50_257)[0]
    share = np.array(list(Counter(a).values())) / len(a)
    assert len(data) * 8 < 0.8 * len(a) * -(share * np.log2(share)).sum()


def test_pieces_give_the_same_ids():
    enc = token_files.Encoder(token_files.TOKENIZER)
    assert enc.by_pieces
    rng = random.Random(5)
    letters = "ab'st dmlvre  \t\n\r\x0b\x0c1²½é×÷ª−—…€А ñ.,!?<|>[]  ὠ0́ \x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(600)] + ["<|endoftext|> x"]
    assert enc(texts) == enc.whole(texts)


def test_joined_crc():
    rng = random.Random(2)
    parts = [rng.randbytes(n) for n in (0, 1, 8191, 8192, 20_000, 3)]
    assert token_files.joined_crc((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(b"".join(parts))


def test_documents_read_back(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(("alpha", "béta", "Ωmega", "x1", "\n")) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (900, None), (901, ""), (902, "long text " * 9000)]
    rng.shuffle(rows)
    vocab = token_files.vocabulary(token_files.TOKENIZER)
    encoded = token_files.encode_texts(docs_of(spark, rows))
    blocks = token_files.write(encoded, vocab)
    got = token_files.digests(blocks, vocab).toPandas().sort_values("start")
    tok = Tokenizer.from_file(token_files.TOKENIZER)
    plain = sorted(((-1 if i is None else i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows), key=lambda r: r[0])
    assert [-1 if np.isnan(x) else int(x) for x in got["id"]] == [i for i, _ in plain]
    assert list(got["start"]) == [0, *np.cumsum(got["n"])[:-1]]
    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in plain]
    assert Counter(zip(got["id"].fillna(-1), got["n"], got["crc"])) == Counter((i, len(x), c) for (i, x), c in zip(plain, crc))
    whole = {r["start"]: bytes(r["ids"]) for r in token_files.documents(blocks, vocab).collect()}
    assert all(zlib.crc32(whole[s]) == c for s, c in zip(got["start"], got["crc"]))
    assert blocks.where("n > 2048").count() == 0 and blocks.count() > 8
    none = token_files.write(token_files.encode_texts(docs_of(spark, rows).limit(0)), vocab)
    assert token_files.digests(none, vocab).count() == 0 and none.count() == 0


# -------------------------------------------------------------- 12 spelling

def plain_variants(rows, every=31, least=7, ratio=10):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    words = {w: n for w, n in c.items() if len(w) >= least and n >= 2}
    near = defaultdict(set)
    by = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by[w[:k] + w[k + 1:], k].add(w)
    for (v, _), g in by.items():
        for a in g:
            near[a] |= g - {a}
            if v in words:
                near[a].add(v)
                near[v].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def edited(rng, w, letters):
    k, kind = rng.randrange(len(w) + 1), rng.randrange(3)
    if kind == 0:
        return w[:k] + rng.choice(letters) + w[k:]
    return w[:k] + (rng.choice(letters) if kind == 1 else "") + w[k + 1:]


@pytest.mark.parametrize("long", [False, True])
def test_variants_match_plain_version(spark, monkeypatch, long):
    if long:  # most words take the way of long ones
        monkeypatch.setattr(spelling, "LONG", 9)
    rng = random.Random(11)
    letters = "abéß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(60)]
    base += ["z" * 39, "z" * 40, "z" * 41, "y" * 300, "y" * 150 + "x" + "y" * 149, "aaaaaaa", "aaaaaaaa", "aaaaaab"]
    words = base + [edited(rng, edited(rng, w, letters), letters) for w in base] + [edited(rng, w, letters) for w in base]
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=80)))
            for i in range(60)]
    rows += [(None, " ".join(base)), (1, None), (2, ""), (3, "   ÷×÷×÷×÷ 1234567 short"), (3, " ".join(base)), (3, " ".join(base))]
    got = spelling.variants(spelling.word_counts(docs_of(spark, rows), damage_every=31))
    assert {tuple(r) for r in got.collect()} == plain_variants(rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_of_forms_and_no_words(spark):
    counts = [("abcdefg", 2), ("abcdefh", 25), ("abcdeih", 300), ("abcdjih", 3000), ("zzzzzzz", 9)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(counts, "word string, n long")).collect()}
    assert got == {"abcdefg": ("abcdefh", "abcdjih"), "abcdefh": ("abcdeih", "abcdjih"), "abcdeih": ("abcdjih", "abcdjih"),
                   "abcdjih": (None, "abcdjih"), "zzzzzzz": (None, "zzzzzzz")}
    assert spelling.variants(spelling.word_counts(docs_of(spark, [(1, None)]))).count() == 0


# -------------------------------------------------------------- 13 negatives

def plain_negatives(rows, every=100, kp=5, kn=10):
    use = [(i, lab, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, lab, v in rows
           if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in use:
        if i % every:
            continue
        s = sorted((-int(v @ w), j, other) for j, other, w in use if j != i and len(w) == len(v))
        for ps, p in [(-a, j) for a, j, other in s if other == lab][:kp]:
            hits = [(j, -a) for a, j, other in s if other != lab and 30 * ps <= -100 * a <= 90 * ps][:kn]
            out += [(i, p, r + 1, j, ps, ns) for r, (j, ns) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("block", [37, 8192])
def test_negatives_match_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    x = centres[rng.integers(0, 6, 900)] * 0.4 + 0.2 * rng.standard_normal((900, 24))
    x[200:260] = x[200]  # ties
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, 1, [0.0] * 24), (1100, 1, None), (1200, None, rows[0][2]), (1300, 2, [float("nan")] * 24), (1400, 2, [float("inf")] * 24),
             (1500, 2, []), (1600, 2, [1.0, 2.0]), (1601, 2, [2.0, 2.0]), (1602, 1, [0.7, 0.9]), (None, 1, rows[1][2]), (1700, 1, [None] * 24)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, id int, v int").repartition(3)
    got = hard_negatives.mine(hard_negatives.prepare(df, "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0)
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
                  for r in got.collect()) == plain_negatives(rows)


def test_groups_of_anchors_and_empty_table(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, int(i % 2), [float(c) for c in rng.random(5)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    rows = [(i, lab, [float(np.float32(c)) for c in v]) for i, lab, v in rows]
    monkeypatch.setattr(hard_negatives, "GROUP", 7)
    got = hard_negatives.mine(hard_negatives.prepare(df, "vec_id", "embedding", F.col("label")), F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, every=10)
    assert hard_negatives.mine(hard_negatives.prepare(df.limit(0), "vec_id", "embedding", F.col("label")), F.col("id") % 10 == 0).count() == 0
