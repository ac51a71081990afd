"""Kneser-Ney model over whole characters: count tables, asked shard by shard.

Counts.  Every text is read as its code points after ``ORDER - 1`` start marks
and before one end mark, without classes or folding.  Tasks count the
``ORDER``-grams of their texts, an aggregation adds them up (``count_block``).
Continuation counts, discounts, context totals, back-off weights and the
probability of every n-gram seen are aggregations and joins, one order after
the other (``train``).

Held out.  Texts fall in two halves by their hash.  Each half is scored with
the model of the other, so a trusted text is judged like any other text.

Scoring.  The log probability at a place is a sum over n-grams alone:
``b(context)`` of the orders 2 to ``ORDER`` and ``d(n-gram)`` of all orders, 0
where one was not seen, with d = log p(n-gram) - log b(context) - log p(the
n-gram without its first character).  So texts are scored by a join of their
n-grams with the count shards and a sum per text: tasks put the keys of a
block of texts into packets, one a shard; the shard answers with one sum a
text (``score``).  Tables of fixed size hold the n-grams met most often, which
would make hot shards, and are looked up in the task: whole n-grams by their
counts, and of the parts that a missing one asks for the short ones first,
as every missing n-gram asks for one of each length.  A bit table of fixed size
leaves out n-grams that no shard has.  All only spare messages, which hold
sorted keys as differences (``pack_sorted``).

Keys are 48 hash bits of an n-gram, texts are named by Spark's xxhash64.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.decontaminate import BITS, bit_table
from quire.llm.store import table
from quire.llm.words import GOLD, MIX1, mix

ORDER = 5
START, END = 0x110001, 0x110002  # code point + 1 is below both; 0: no character
WIDE, LOW, TWO = 21, (1 << 21) - 1, (1 << 42) - 1
WHOLE = 0                        # kinds of keys: log p of an n-gram of the highest order,
BACK = ORDER                     # 1 to ORDER: d of that order, BACK + 1 on: b of that order
PIECE = 1 << 18                  # characters looked at together
COUNT = 1 << 20                  # characters counted together
SLOTS = 1 << 21                  # of the table of frequent n-grams
OWNER = 14                       # bits of a text's number in its block
BLOCK_TEXTS, BLOCK_ASKS = 1 << 13, 1 << 20
_U = np.uint64


def pieces(texts: list[str | None], size: int = PIECE):
    """Lists of (number of the text, piece, the characters before it, whether
    the text ends here) of about ``size`` characters; long texts are divided."""
    part, held = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, len(t or ""), size):
            part.append((i, t[lo:lo + size], t[max(0, lo - ORDER + 1):lo], lo + size >= len(t)))
            held += len(part[-1][1])
            if held >= size:
                yield part
                part, held = [], 0
    if part:
        yield part


def _code(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1


def windows(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, first, last characters of the n-gram) of all places
    of ``pieces``: three and two characters of 21 bits each."""
    n = np.array([len(t) for _, t, _, _ in part])
    size = n + ORDER - 1 + np.array([e for *_, e in part], dtype=np.int64)
    at = np.cumsum(size) - size
    s = np.full(int(size.sum()), END, dtype=np.int64)
    s[np.arange(int(n.sum())) + np.repeat(at + ORDER - 1 - (np.cumsum(n) - n), n)] = _code("".join(t for _, t, _, _ in part))
    use = np.ones(len(s), dtype=bool)
    for k in range(ORDER - 1):
        s[at + k] = START
        use[at + k] = False
    for a, (_, _, before, _) in zip(at, part):
        if before:
            s[a + ORDER - 1 - len(before):a + ORDER - 1] = _code(before)
    use = use[ORDER - 1:]
    hi = (s[:-4] << 2 * WIDE | s[1:-3] << WIDE | s[2:-2])[use]
    lo = (s[3:-1] << WIDE | s[4:])[use]
    return np.repeat([i for i, *_ in part], size - ORDER + 1), hi, lo


def lower(order: int, hi, lo):
    """The last ``order`` characters of the n-grams (arrays)."""
    hi = hi & TWO if order == 4 else hi & LOW if order == 3 else hi if order == ORDER else np.zeros_like(hi)
    return hi, lo & LOW if order == 1 else lo


def context(hi, lo):
    """The n-grams without their last character (arrays)."""
    return hi >> WIDE, (hi & LOW) << WIDE | lo >> WIDE


def keys(kind, half, hi, lo) -> np.ndarray:
    tag = (np.asarray(kind) * 2 + half + 1).astype(np.uint64) * MIX1
    return mix(mix(hi.view(np.uint64) ^ tag) + lo.view(np.uint64) * GOLD)


def count_block(texts: list[str | None], half: np.ndarray) -> pd.DataFrame:
    """(half, hi, lo, c): n-gram counts of texts, for the other half's model."""
    found = [windows(p) for p in pieces(texts)]
    owner, hi, lo = (np.concatenate(x) if found else np.empty(0, np.int64) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 3
    m = 1 - half[owner]
    _, at, c = np.unique(keys(WHOLE, m, hi, lo), return_index=True, return_counts=True)
    return pd.DataFrame({"half": m[at].astype(np.int32), "hi": hi[at], "lo": lo[at], "c": c.astype(np.int64)})


def discounts(counts: DataFrame, by: str) -> DataFrame:
    """Modified Kneser-Ney discounts per ``by`` from counts of counts."""
    n = counts.groupBy(by).agg(*[F.sum((F.col("c") == i).cast("long")).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0),
                F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)),
                        F.lit(i - 0.05))).otherwise(0.5 * i) for i in (1, 2, 3)]
    return n.select(by, *[x.alias(f"d{i}") for i, x in zip((1, 2, 3), d)])


def train(counts: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """Model rows (half, kind, hi, lo, v, c) from n-gram counts (half, hi, lo,
    c), and the log probability of an unseen character by half.

    Every order's context sums and probabilities are written, so that no plan
    holds more than one order."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        hi = {4: F.expr(f"hi & {TWO}L"), 3: F.expr(f"hi & {LOW}L")}.get(k, F.lit(0).cast("long"))
        lo = F.expr(f"lo & {LOW}L") if k == 1 else F.col("lo")
        levels[k] = table(levels[k + 1].groupBy("half", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("c")), "kn-char-level")
    out, below, unseen = [], None, {}
    for k in range(1, ORDER + 1):
        d = F.lit(None).cast("double")
        for r in discounts(levels[k], "half").collect():  # two rows
            mine = F.when(F.col("c") == 1, r["d1"]).when(F.col("c") == 2, r["d2"]).otherwise(r["d3"])
            d = F.when(F.col("half") == r["half"], mine).otherwise(d)
        rows = levels[k].select("half", "hi", "lo", "c", d.alias("d"), F.expr(f"shiftright(hi, {WIDE})").alias("chi"),
                                F.expr(f"shiftleft(hi & {LOW}L, {WIDE}) | shiftright(lo, {WIDE})").alias("clo"))
        sums = table(rows.groupBy("half", "chi", "clo").agg(F.sum("c").alias("all"), F.sum("d").alias("cut"),
                                                            F.count("*").alias("kinds")), "kn-char-sums")
        rows = rows.join(sums, ["half", "chi", "clo"]).withColumn("b", F.col("cut") / F.col("all"))
        if k == 1:
            rows = rows.withColumn("q", 1 / (F.col("kinds") + 1))
        else:
            hi = {5: F.expr(f"hi & {TWO}L"), 4: F.expr(f"hi & {LOW}L")}.get(k, F.lit(0).cast("long"))
            lo = F.expr(f"lo & {LOW}L") if k == 2 else F.col("lo")
            rows = rows.withColumn("shi", hi).withColumn("slo", lo).join(below, ["half", "shi", "slo"])
        rows = rows.withColumn("p", (F.col("c") - F.col("d")) / F.col("all") + F.col("b") * F.col("q"))
        rows = table(rows.select("half", "hi", "lo", "c", "b", "q", "p"), "kn-char-p")
        below = rows.select("half", F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("q"))
        if k == 1:
            unseen = {r["half"]: r["u"] for r in rows.groupBy("half").agg(F.first(F.log(F.col("b") * F.col("q"))).alias("u")).collect()}
        else:
            out.append(sums.select("half", F.lit(BACK + k - 1).alias("kind"), F.col("chi").alias("hi"), F.col("clo").alias("lo"),
                                   F.log(F.col("cut") / F.col("all")).alias("v"), F.col("all").alias("c")))
        out.append(rows.select("half", F.lit(k).alias("kind"), "hi", "lo", F.log(F.col("p") / (F.col("b") * F.col("q"))).alias("v"), "c"))
    out.append(rows.select("half", F.lit(WHOLE).alias("kind"), "hi", "lo", F.log("p").alias("v"), "c"))
    model = out[0]
    for x in out[1:]:
        model = model.union(x)
    return model, unseen


def keyed(model: DataFrame) -> DataFrame:
    """(kind, key, v, c) of model rows."""

    def run(batches):
        for pdf in batches:
            k = keys(pdf["kind"].to_numpy(), pdf["half"].to_numpy(), pdf["hi"].to_numpy(np.int64), pdf["lo"].to_numpy(np.int64))
            yield pd.DataFrame({"kind": pdf["kind"], "key": k.view(np.int64), "v": pdf["v"], "c": pdf["c"]})

    return model.mapInPandas(run, "kind int, key long, v float, c long")


class Frequent:
    """Values of the n-grams met most often, one a slot."""

    def __init__(self, key: np.ndarray, v: np.ndarray, c: np.ndarray, slots: int):
        order = np.argsort(c, kind="stable")  # the last one stays in its slot
        key, v = key[order], v[order]
        self.name, self.v = np.zeros(slots, np.uint32), np.zeros(slots, np.float32)
        at = key & _U(slots - 1)
        self.name[at], self.v[at] = key >> _U(32), v

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys it holds, their values)."""
        at = key & _U(len(self.name) - 1)
        on = self.name[at] == (key >> _U(32)).astype(np.uint32)
        return on, self.v[at[on]]


def frequent(model: DataFrame, slots: int = SLOTS) -> tuple[Frequent, Frequent]:
    """The tables of frequent n-grams, whole ones and parts: a bounded number
    from ``keyed`` rows, the whole above a count that few enough reach, the
    parts shortest first, then by count."""
    length = F.when(F.col("kind") > BACK, F.col("kind") - BACK).otherwise(F.col("kind"))
    step = F.floor(F.log2("c") * 8).cast("int")
    hist = model.groupBy(length.alias("length"), step.alias("step")).agg(F.count("*").alias("n")).collect()  # a row per step
    none, least = (np.empty(0, np.uint64), np.empty(0, np.float32), np.empty(0, np.int64)), {}
    for whole, room in ((True, slots // 4), (False, slots // 8)):
        for r in sorted((r for r in hist if (r["length"] == WHOLE) == whole), key=lambda r: (r["length"], -r["step"])):
            room -= r["n"]
            if room < 0:
                break
            least[r["length"]] = r["step"]
    take = F.lit(False)
    for k, low in least.items():
        take = take | ((length == k) & (step >= low))

    def pack(batches):
        for pdf in batches:
            part = pdf["length"].to_numpy() > 0
            for x, rows in ((False, pdf[~part]), (True, pdf[part])):
                # in a slot the shorter n-gram stays, then the one of the higher count
                rank = rows["c"].to_numpy() + ((BACK - rows["length"].to_numpy(np.int64)) << 48)
                yield pd.DataFrame({"part": [x], "key": [rows["key"].to_numpy().tobytes()],
                                    "v": [rows["v"].to_numpy(np.float32).tobytes()], "c": [rank.tobytes()]})

    got = {False: [none], True: [none]}
    rows = model.where(take).select(length.alias("length"), "key", "v", "c") \
        .mapInPandas(pack, "part boolean, key binary, v binary, c binary")
    for r in rows.toLocalIterator():
        got[r["part"]].append((np.frombuffer(r["key"], np.uint64), np.frombuffer(r["v"], np.float32), np.frombuffer(r["c"], np.int64)))
    return tuple(Frequent(*(np.concatenate(x) for x in zip(*got[part])), n) for part, n in ((False, slots), (True, slots // 2)))


def pack_sorted(x: np.ndarray) -> tuple[bytes, bytes]:
    """Rising numbers as differences: how many bytes each takes (two to a
    byte), and those bytes."""
    d = np.diff(x, prepend=_U(0))
    wide = np.zeros(len(d) + len(d) % 2, np.uint8)
    for k in range(8):
        wide[:len(d)] += d >= _U(1 << 8 * k)
    return (wide[::2] << 4 | wide[1::2]).tobytes(), d.view(np.uint8).reshape(-1, 8)[np.arange(8) < wide[:len(d), None]].tobytes()


def unpack_sorted(n: int, wide: bytes, data: bytes) -> np.ndarray:
    """The ``n`` numbers of ``pack_sorted``."""
    two = np.frombuffer(wide, np.uint8)
    size = np.stack((two >> 4, two & 15), axis=1).ravel()[:n]
    d = np.zeros((n, 8), np.uint8)
    d[np.arange(8) < size[:, None]] = np.frombuffer(data, np.uint8)
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """Sums and open questions of some texts of a task."""

    def __init__(self, held, unseen: dict[int, float]):
        (self.held, self.parts), self.bits = held
        self.unseen = np.array([unseen.get(i, np.nan) for i in (0, 1)])
        self.names, self.n, self.sums, self.asks, self.open = [], [], [], [], 0

    def add(self, names: np.ndarray, texts: list[str | None]) -> None:
        first = sum(map(len, self.names))
        sums, half = np.zeros(len(names)), names & 1
        for part in pieces(texts):
            owner, hi, lo = windows(part)
            m = half[owner]
            on, v = self.held(keys(WHOLE, m, hi, lo))
            sums += np.bincount(owner[on], v, minlength=len(sums))
            owner, hi, lo, m = (x[~on] for x in (owner, hi, lo, m))
            sums += np.bincount(owner, self.unseen[m], minlength=len(sums))
            for k in range(1, ORDER + 1):
                gram = lower(k, hi, lo)
                sums += self._look(keys(k, m, *gram), owner, len(sums), first)
                if k > 1:
                    sums += self._look(keys(BACK + k - 1, m, *context(*gram)), owner, len(sums), first)
        sums[np.isnan(self.unseen[half])] = np.nan  # no model at all
        self.names.append(names)
        self.n.append(np.array([len(t) + 1 if t else 0 for t in texts], np.int64))
        self.sums.append(sums)

    def _look(self, key, owner, size, first) -> np.ndarray:
        there = (self.bits[(key & _U((1 << BITS) - 1)) >> _U(6)] >> (key & _U(63))) & _U(1) > 0
        key, owner = key[there], owner[there]
        on, v = self.parts(key)
        self.asks.append(key[~on] >> _U(16) << _U(OWNER) | (owner[~on] + first).astype(np.uint64))
        self.open += len(self.asks[-1])
        return np.bincount(owner[on], v, minlength=size)

    def full(self) -> bool:
        return sum(map(len, self.names)) >= BLOCK_TEXTS or self.open >= BLOCK_ASKS

    def packets(self, block: int, shards: int) -> pd.DataFrame:
        """A row per shard asked, and one with the texts' own sums."""
        asks = np.sort(np.concatenate([np.empty(0, np.uint64), *self.asks]))
        shard = asks >> _U(OWNER + 48 - shards.bit_length() + 1)
        cut = np.flatnonzero(np.diff(shard, prepend=~_U(0))) if len(shard) else np.empty(0, np.int64)
        rows = [(int(shard[a]), block, *pack_sorted(asks[a:b]), np.int64(b - a).tobytes(), None)
                for a, b in zip(cut, np.append(cut[1:], len(asks)))]
        rows.append((block % shards, block, None, np.concatenate(self.names).tobytes(), np.concatenate(self.n).tobytes(),
                     np.concatenate(self.sums).tobytes()))
        return pd.DataFrame(rows, columns=["shard", "block", "wide", "key", "n", "sums"])


def _answer(model: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """What a shard adds to the texts of each packet; other rows pass."""
    have, at = np.unique(model["key"].to_numpy(np.int64).view(np.uint64), return_index=True)
    v = model["v"].to_numpy(np.float64)[at]
    rows = []
    for r in asks.itertuples():
        if r.wide is None:
            rows.append((r.block, None, r.key, r.n, r.sums))
            continue
        asks = unpack_sorted(int(np.frombuffer(r.n, np.int64)[0]), r.wide, r.key)
        key, owner = asks >> _U(OWNER), (asks & _U((1 << OWNER) - 1)).astype(np.uint16)
        spot = np.minimum(np.searchsorted(have, key), max(len(have) - 1, 0))
        on = have[spot] == key if len(have) else np.zeros(len(key), bool)
        if on.any():
            who, back = np.unique(owner[on], return_inverse=True)
            rows.append((r.block, who.tobytes(), None, None, np.bincount(back, v[spot[on]]).astype(np.float32).tobytes()))
    return pd.DataFrame(rows, columns=["block", "owner", "key", "n", "sums"])


def _finish(rows: pd.DataFrame) -> pd.DataFrame:
    """Texts of a block with the answers of all shards."""
    own = rows[rows["owner"].isna()].iloc[0]
    sums, n = np.frombuffer(own["sums"], np.float64).copy(), np.frombuffer(own["n"], np.int64)
    for r in rows[rows["owner"].notna()].itertuples():
        sums[np.frombuffer(r.owner, np.uint16)] += np.frombuffer(r.sums, np.float32)
    ppl = -sums / np.maximum(n, 1)
    ppl = pd.Series(ppl).astype(object).where((n > 0) & ~np.isnan(ppl), None)
    return pd.DataFrame({"key": np.frombuffer(own["key"], np.int64), "chars": np.maximum(n - 1, 0), "char_log_perplexity": ppl})


def score(texts: DataFrame, counts: DataFrame, rows: int, slots: int = SLOTS) -> DataFrame:
    """(key, chars, char_log_perplexity) of every distinct text (column text)
    of about ``rows`` rows, under the model of ``counts``."""
    spark = texts.sparkSession
    if counts.isEmpty():  # no model: no score
        return texts.select(F.xxhash64("text").alias("key"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
                            F.lit(None).cast("double").alias("char_log_perplexity")).dropDuplicates(["key"])
    model, unseen = train(counts)
    model = table(keyed(model), "kn-char-model")
    asked = model.where(F.col("kind") != WHOLE)
    held = spark.sparkContext.broadcast((frequent(model, slots), bit_table(asked.select(F.col("key").alias("g")))))
    want = max(16, asked.count() >> 18, rows >> 13)
    shards = 1 << min(want - 1, (1 << 15) - 1).bit_length()

    def run(batches):
        from pyspark import TaskContext

        at, block = TaskContext.get().partitionId() << 32, Block(held.value, unseen)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo:lo + 256]
                block.add(part["key"].to_numpy(np.int64), part["text"].tolist())
                if block.full():
                    yield block.packets(at, shards)
                    at, block = at + 1, Block(held.value, unseen)
        if block.names:
            yield block.packets(at, shards)

    asks = texts.select(F.xxhash64("text").alias("key"), "text") \
        .mapInPandas(run, "shard int, block long, wide binary, key binary, n binary, sums binary")
    # the highest of the 48 bits name the shard; a shift without sign
    part = asked.select(F.expr(f"cast(shiftrightunsigned(key, {65 - shards.bit_length()}) as int)").alias("shard"),
                        F.expr("shiftrightunsigned(key, 16)").alias("key"), "v")
    said = part.groupBy("shard").cogroup(asks.groupBy("shard")) \
        .applyInPandas(_answer, "block long, owner binary, key binary, n binary, sums binary")
    done = said.groupBy("block").applyInPandas(_finish, "key long, chars long, char_log_perplexity double")
    return done.dropDuplicates(["key"])
