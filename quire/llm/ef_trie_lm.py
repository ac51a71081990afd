"""LM scoring with an Elias-Fano bigram trie.

The model is trained on part of the corpus and scores all of it; nothing of
vocabulary size ever meets in one place.

1. Documents are dealt into blocks by hash.  A block (one task) hashes its
   words, and sends every shard the words and bigrams it wants to know, each
   once, with their counts in its training documents.
2. A shard adds up the counts of its words and builds the trie of its bigrams:
   level 1 the contexts, level 2 their following words.  Both levels are
   Elias-Fano sequences; the ranges of the children are monotone pointers, also
   Elias-Fano; keys of level 2 are made monotone by adding their context's
   number times the vocabulary, and are found by a successor search relative
   to that context.  Discounted probabilities and back-off weights are 8-bit
   codes (``STEP`` in log10).  All arrays lie in one memory map.
3. The answers go back to the blocks, which score their documents.

A context's following words are divided into ``CLASSES`` classes by hash and
the class is part of the context, so the children of a very frequent word are
spread over shards:  P(w | v) = P(class | v) * P(w | v, class), both
interpolated with the unigram P(w) = (c + 0.1) / (N + 0.1 (V + 1)).

Sizes: a block and a shard hold about ``max(BLOCK_BYTES, sqrt(1 KB * corpus))``
bytes, so that each message between them stays over a kilobyte.

Defined cases: null and empty texts are one end token; a null id counts as
empty text in the hash that picks held-out rows; repeated rows count and are
scored each; without training rows every word is unknown; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import mmap

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.words import BY_SPACE, GOLD, blocks, mix

BLOCK_BYTES = 8 << 20
CLASSES = 4
CTX_BYTES, WORD_BYTES = 6, 5  # hash bytes that name a context, and a word below its context, between tasks
STEP = 0.04
UNSEEN = 255
DISCOUNT = 0.75
PRIOR = 2.0   # weight of the class shares of the unigram model
END = np.uint64(0x2545F4914F6CDD1D)
BEGIN = np.uint64(0x9FB21C651E98DF25)


# ---------------------------------------------------------------- Elias-Fano

class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers in place.

    Low bits are packed; high bits are unary in a bit vector with a running
    count of ones per 64-bit word.  All arrays are views of one buffer.
    """

    NAMES = ("low", "high", "ones")

    @staticmethod
    def encode(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = (int(at[-1]) if n else 0) // 64 + 2
        flags = np.zeros(words * 64, dtype=np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))
        return {"head": np.array([n, bits], dtype="<i8"), "low": _pack(low, bits), "high": high, "ones": ones}

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in parts["head"])
        self.low, self.high, self.ones = parts["low"], parts["high"], parts["ones"]
        self.zeros = np.arange(len(self.high) + 1, dtype=np.int64) * 64 - self.ones

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        upper = _select(self.high, self.ones, i) - i
        return (upper.astype(np.uint64) << np.uint64(self.bits)) | _unpack(self.low, self.bits, i)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) with a value >= x (else hi), for each x."""
        if not self.n:
            return hi.copy()
        upper = (x >> np.uint64(self.bits)).astype(np.int64)
        # the values with this upper part lie between two zeros of the bit vector
        first = np.where(upper > 0, _select0(self.high, self.zeros, upper - 1) - (upper - 1), 0)
        stop = _select0(self.high, self.zeros, upper) - upper
        a, b = np.clip(first, lo, hi), np.clip(stop, lo, hi)
        rest = x & np.uint64((1 << self.bits) - 1)
        while True:  # halve the few that share the upper part
            go = np.flatnonzero(a < b)
            if not len(go):
                return a
            mid = (a[go] + b[go]) // 2
            less = _unpack(self.low, self.bits, mid) < rest[go]
            a[go] = np.where(less, mid + 1, a[go])
            b[go] = np.where(less, b[go], mid)


def _pack(v: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of ``bits`` bits each, one after the other, in 64-bit words."""
    out = np.zeros(len(v) * bits // 64 + 2, dtype=np.uint64)
    if bits and len(v):
        at = np.arange(len(v), dtype=np.uint64) * np.uint64(bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, v << off)
        over = off + np.uint64(bits) > 64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - off[over]))
    return out


def _unpack(packed: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), dtype=np.uint64)
    at = i.astype(np.uint64) * np.uint64(bits)
    word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = packed[word] >> off
    high = np.where(off > 0, packed[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each 64-bit word."""
    place = np.zeros(len(word), dtype=np.int64)
    k = k.copy()
    for half in (32, 16, 8, 4, 2, 1):
        part = (word >> place.astype(np.uint64)) & np.uint64((1 << half) - 1)
        c = np.bitwise_count(part).astype(np.int64)
        up = k >= c
        k -= np.where(up, c, 0)
        place += np.where(up, half, 0)
    return place


def _select(high: np.ndarray, ones: np.ndarray, i: np.ndarray) -> np.ndarray:
    w = np.searchsorted(ones, i, side="right") - 1
    return w * 64 + _in_word(high[w], i - ones[w])


def _select0(high: np.ndarray, zeros: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Place of the i-th zero; past the end the vector goes on with zeros."""
    last = len(high) - 1
    w = np.minimum(np.searchsorted(zeros, i, side="right") - 1, last)
    past = i >= zeros[-1]
    place = w * 64 + _in_word(~high[w], np.where(past, 0, i - zeros[w]))
    return np.where(past, len(high) * 64 + (i - zeros[-1]), place)


# --------------------------------------------------------------------- trie

class Trie:
    """Two-level trie over (context, word) numbers in one buffer."""

    PARTS = ("contexts", "pointers", "words")

    @staticmethod
    def build(ctx: np.ndarray, word: np.ndarray, prob: np.ndarray, backoff: np.ndarray, total: np.ndarray,
              vocabulary: int) -> bytes:
        """``ctx`` sorted with repeats, ``word`` numbers below ``vocabulary``
        sorted inside a context; prob, backoff: 8-bit codes; total: counts."""
        first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(ctx)]))))
        arrays = {"codes": prob, "backoff": backoff, "total": total.astype("<i8"),
                  "vocabulary": np.array([vocabulary], dtype="<i8")}
        seqs = {"contexts": ctx[first], "pointers": np.concatenate((first, [len(ctx)])).astype(np.uint64),
                "words": owner.astype(np.uint64) * np.uint64(vocabulary) + word.astype(np.uint64)}
        for name, v in seqs.items():
            for k, a in EliasFano.encode(v).items():
                arrays[f"{name}.{k}"] = a
        head, body, at = [], [], 0
        for k, a in arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            head.append(f"{k} {a.dtype.str} {len(a)} {at}")
            body.append(raw + b"\0" * (-len(raw) % 8))
            at += len(body[-1])
        index = "\n".join(head).encode()
        index += b" " * (-(len(index) + 8) % 8)
        return len(index).to_bytes(8, "little") + index + b"".join(body)

    def __init__(self, buffer):
        """``buffer``: bytes or any memory map of them; nothing is copied."""
        size = int.from_bytes(bytes(buffer[:8]), "little")
        parts = {}
        for line in bytes(buffer[8:8 + size]).decode().split("\n"):
            name, kind, n, at = line.split()
            parts[name] = np.frombuffer(buffer, dtype=kind, count=int(n), offset=8 + size + int(at))
        self.codes, self.backoff, self.total = parts["codes"], parts["backoff"], parts["total"]
        self.vocabulary = int(parts["vocabulary"][0])
        level = {p: EliasFano({k.split(".")[1]: v for k, v in parts.items() if k.startswith(p + ".")}) for p in self.PARTS}
        self.contexts, self.pointers, self.words = level["contexts"], level["pointers"], level["words"]

    def context(self, ctx: np.ndarray) -> np.ndarray:
        """Number of each context, -1 if it is not there."""
        n = self.contexts.n
        at = self.contexts.successor(ctx, np.zeros(len(ctx), np.int64), np.full(len(ctx), n))
        there = np.flatnonzero(at < n)
        out = np.full(len(ctx), -1)
        same = self.contexts.get(at[there]) == ctx[there]
        out[there[same]] = at[there[same]]
        return out

    def lookup(self, number: np.ndarray, word: np.ndarray) -> np.ndarray:
        """8-bit probability code of each (context number, word), or UNSEEN."""
        out = np.full(len(number), UNSEEN, dtype=np.uint8)
        ask = np.flatnonzero((number >= 0) & (word >= 0))
        c = number[ask]
        lo, hi = self.pointers.get(c).astype(np.int64), self.pointers.get(c + 1).astype(np.int64)
        key = c.astype(np.uint64) * np.uint64(self.vocabulary) + word[ask].astype(np.uint64)
        at = self.words.successor(key, lo, hi)
        there = np.flatnonzero(at < hi)
        same = self.words.get(at[there]) == key[there]
        out[ask[there[same]]] = self.codes[at[there[same]]]
        return out


def _code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-12)) / STEP), 0, UNSEEN - 1).astype(np.uint8)


def _value(code: np.ndarray) -> np.ndarray:
    return np.where(code == UNSEEN, 0.0, 10.0 ** (-STEP * code))


# ------------------------------------------------------------------- blocks

def _class(w: np.ndarray) -> np.ndarray:
    return ((w * GOLD) >> np.uint64(62)).astype(np.int64)  # CLASSES = 4


class Block:
    """Tokens of a block of documents, and the words and bigrams it asks for."""

    def __init__(self, texts: list[str | None], train: np.ndarray, shards: int):
        n = len(texts)
        parts = [(o, h) for o, h, *_ in blocks(texts, BY_SPACE)]
        owner = np.concatenate([o for o, _ in parts]) if parts else np.empty(0, np.int64)
        h = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.uint64)
        sizes = np.bincount(owner, minlength=n) + 1
        stops = np.cumsum(sizes)
        tok = np.full(int(sizes.sum()), END, dtype=np.uint64)
        body = np.ones(len(tok), dtype=bool)
        body[stops - 1] = False
        tok[body] = h
        self.doc, self.sizes = np.repeat(np.arange(n), sizes), sizes
        self.words, self.word_of = np.unique(tok, return_inverse=True)
        prev = np.empty(len(tok), dtype=np.int64)
        prev[1:] = self.word_of[:-1]
        prev[stops - sizes] = len(self.words)  # BEGIN
        code, self.bigram_of = np.unique(prev * len(self.words) + self.word_of, return_inverse=True)
        names = np.append(self.words, BEGIN)
        self.second = code % len(self.words)
        self.ctx_word = code // len(self.words)
        w2 = self.words[self.second]
        # context = word before, with the class of the word that follows
        self.ctx = mix(names[self.ctx_word] ^ mix(_class(w2).astype(np.uint64) + np.uint64(1)))
        self.ctx &= np.uint64((1 << 8 * CTX_BYTES) - 1)
        self.below = w2 & np.uint64((1 << 8 * WORD_BYTES) - 1)
        on = train[self.doc]
        self.word_count = np.bincount(self.word_of[on], minlength=len(self.words))
        self.bigram_count = np.bincount(self.bigram_of[on], minlength=len(code))
        self.docs_in_training = int(train.sum())
        self.word_shard = (mix(self.words) % np.uint64(shards)).astype(np.int64)
        self.bigram_shard = (mix(self.ctx) % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.bigram_order = np.argsort(self.bigram_shard, kind="stable")
        self.word_cut = np.searchsorted(self.word_shard[self.word_order], np.arange(shards + 1))
        self.bigram_cut = np.searchsorted(self.bigram_shard[self.bigram_order], np.arange(shards + 1))

    def of_words(self, s: int) -> np.ndarray:
        return self.word_order[self.word_cut[s]:self.word_cut[s + 1]]

    def of_bigrams(self, s: int) -> np.ndarray:
        return self.bigram_order[self.bigram_cut[s]:self.bigram_cut[s + 1]]


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of runs of equal neighbours."""
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.empty(0, np.int64)
    return v[first], np.diff(np.concatenate((first, [len(v)])))


REQUEST = "shard int, block int, words binary, word_count binary, ctx binary, ctx_run binary, second binary, bigram_count binary"
ANSWER = "block int, shard int, word_count binary, codes binary, backoff binary, total binary, class_count binary, class_types binary"


def _narrow(v: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of each number."""
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _widen(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1)


def _ask(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = Block(pdf["t"].tolist(), pdf["train"].to_numpy(bool), shards)
        rows = []
        for s in range(shards):
            w, g = b.of_words(s), b.of_bigrams(s)
            ctx, run = _runs(b.ctx[g])
            rows.append((s, int(pdf["block"].iloc[0]), b.words[w].tobytes(), b.word_count[w].astype("<i4").tobytes(),
                         _narrow(ctx, CTX_BYTES), run.astype("<i4").tobytes(), _narrow(b.below[g], WORD_BYTES),
                         b.bigram_count[g].astype("<i4").tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in REQUEST.split(", ")])
    return run


def _read(rows: pd.Series, kind: str | int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column (of a type, or of so many bytes) and
    where each row's end."""
    parts = [_widen(x, kind) if isinstance(kind, int) else np.frombuffer(x, dtype=kind) for x in rows]
    return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def build_shard(ctx: np.ndarray, second: np.ndarray, count: np.ndarray):
    """(trie bytes, its words) of the bigrams of a shard; all three aligned,
    sorted by context and then by word, counts above zero."""
    words = np.unique(second)
    first, run = _runs(ctx)
    owner = np.repeat(np.arange(len(first)), run)
    total = np.bincount(owner, count, len(first)).astype(np.int64) if len(first) else np.empty(0, np.int64)
    prob = (count - DISCOUNT) / total[owner] if len(ctx) else np.empty(0)
    back = DISCOUNT * run / np.maximum(total, 1)
    return Trie.build(ctx, np.searchsorted(words, second), _code(prob), _code(back), total, max(1, len(words))), words


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    words, word_end = _read(pdf["words"], "<u8")
    counts, _ = _read(pdf["word_count"], "<i4")
    known, back = np.unique(words, return_inverse=True)
    total = np.bincount(back, counts, len(known)).astype(np.int64)
    kind = _class(known)
    per_class = np.bincount(kind, total, CLASSES).astype(np.int64)
    types = np.bincount(kind, total > 0, CLASSES).astype(np.int64)

    ctx, ctx_end = _read(pdf["ctx"], CTX_BYTES)
    run, _ = _read(pdf["ctx_run"], "<i4")
    second, second_end = _read(pdf["second"], WORD_BYTES)
    times, _ = _read(pdf["bigram_count"], "<i4")
    vocab, second_no = np.unique(second, return_inverse=True)
    ctxs, ctx_no = np.unique(ctx, return_inverse=True)
    key, key_of = np.unique(np.repeat(ctx_no, run) * max(1, len(vocab)) + second_no, return_inverse=True)
    c = np.bincount(key_of, times, len(key)).astype(np.int64)
    c1, c2 = key // max(1, len(vocab)), key % max(1, len(vocab))
    seen = c > 0
    raw, trie_words = build_shard(ctxs[c1[seen]], vocab[c2[seen]], c[seen])
    with mmap.mmap(-1, max(1, len(raw))) as mapped:  # levels live in one memory map
        mapped.write(raw)
        trie = Trie(memoryview(mapped).toreadonly())
        number = trie.context(ctxs)
        place = np.searchsorted(trie_words, vocab)
        place = np.where((place < len(trie_words)) & (np.append(trie_words, 0)[np.minimum(place, len(trie_words))] == vocab),
                         place, -1)
        codes = trie.lookup(number[c1], place[c2]) if len(key) else np.empty(0, np.uint8)
        at = np.maximum(number, 0)
        backoff = np.where(number >= 0, np.append(trie.backoff, 0)[at], UNSEEN).astype(np.uint8)
        sums = np.where(number >= 0, np.append(trie.total, 0)[at], 0).astype("<i8")
        del trie
    rows, lo = [], (0, 0, 0)
    for i in range(len(pdf)):
        hi = (word_end[i], second_end[i], ctx_end[i])
        mine = ctx_no[lo[2]:hi[2]]
        rows.append((int(pdf["block"].iloc[i]), int(pdf["shard"].iloc[i]), total[back[lo[0]:hi[0]]].astype("<i8").tobytes(),
                     codes[key_of[lo[1]:hi[1]]].tobytes(), backoff[mine].tobytes(), sums[mine].tobytes(),
                     per_class.astype("<i8").tobytes(), types.astype("<i8").tobytes()))
        lo = hi
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


def _score(shards: int):
    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in names})
        train = pdf["train"].to_numpy(bool)
        b = Block(pdf["t"].tolist(), train, shards)
        c = np.zeros(len(b.words), np.int64)
        code = np.full(len(b.second), UNSEEN, np.uint8)
        back, sums = np.full(len(b.second), UNSEEN, np.uint8), np.zeros(len(b.second), np.int64)
        per_class, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in answers.itertuples(index=False):
            w, g = b.of_words(r.shard), b.of_bigrams(r.shard)
            c[w] = np.frombuffer(r.word_count, "<i8")
            code[g] = np.frombuffer(r.codes, np.uint8)
            _, run = _runs(b.ctx[g])
            back[g] = np.repeat(np.frombuffer(r.backoff, np.uint8), run)
            sums[g] = np.repeat(np.frombuffer(r.total, "<i8"), run)
            per_class += np.frombuffer(r.class_count, "<i8")
            types += np.frombuffer(r.class_types, "<i8")
        n, v = int(per_class.sum()), int(types.sum())
        whole = n + 0.1 * (v + 1)
        base = (c + 0.1) / whole
        share = (per_class + 0.1 * types + 0.1) / (whole + 0.1 * (CLASSES - 1))
        # contexts seen: as often as the word before (every text begins once and ends once)
        ends = c[np.searchsorted(b.words, END)]
        seen = np.append(c, ends)[b.ctx_word]
        kind = _class(b.words[b.second])
        in_class = (sums + PRIOR * share[kind]) / (seen + PRIOR)
        inner = base[b.second] * whole / ((per_class + 0.1 * types + 0.1)[kind])
        p = in_class * np.where(sums > 0, _value(code) + _value(back) * inner, inner)
        docs = len(pdf)
        add = lambda x: np.bincount(b.doc, x, docs)
        out = pd.DataFrame({"doc_id": pdf["id"].astype("Int64"), "held_out": ~train, "n_tokens": b.sizes,
                            "n_known": add(c[b.word_of] > 0).astype(np.int64), "train_tokens": n,
                            "base_score": add(np.log10(base)[b.word_of]), "score": add(np.log10(p)[b.bigram_of])})
        return out[names]
    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose crc32 of the id as text is not divisible by 10 train the model;
    all rows are scored.
    """
    whole = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    size = max(block_bytes, math.isqrt(whole * 1024))
    n = max(1, -(-whole // size))
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), F.lit(n)).cast("int").alias("block"),
                        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"),
                        (F.crc32(key.cast("binary")) % 10 != 0).alias("train"))
    asked = dealt.groupBy("block").applyInPandas(_ask(n), REQUEST)
    answers = asked.groupBy("shard").applyInPandas(_answer, ANSWER)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _score(n), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                   "base_score double, score double")
