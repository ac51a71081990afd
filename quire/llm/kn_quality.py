"""Quality classifier: interpolated modified Kneser-Ney n-gram model.

Training.  The symbols of trusted texts (26 letters, classes of capitals,
digits, marks, symbols and non-ASCII bytes: ``SYMBOLS`` = 40) are counted as
4-grams.  Tasks count their own texts and send (lang, 4-gram, count) rows; one
aggregation per count shard adds them up.  Continuation counts of the lower
orders, context totals, the three discounts per language and order and the
back-off weights are aggregations and joins of these count tables, one order
after the other (``train``), so no table ever holds more than
``SYMBOLS ** 4`` rows a language, whatever the corpus size.

Scoring.  Every language with enough trusted texts for its quantiles
(``1 / tail``) has a table of its own, whatever their number; all others share
one over all languages.  The tables go to the tasks ``GROUP`` languages at a
time, so neither driver nor task holds more than that.  A task joins its texts
with the shard of each language in turn and sums the log probabilities of
every 4-gram of the whole text: log perplexity = -sum / symbols.

Decision.  Perplexity varies with text length, so a document is compared with
the trusted ones of its language on the standardised value
``(log perplexity - median) * sqrt(symbols)``.  It is rejected outside the
``tail`` and ``1 - tail`` quantiles of its language (over its trusted rows,
widened by ``slack``): too high is noise, too low is repetition.  The limits
of the shared table are those of all trusted rows scored with it.

Defined cases: null and empty texts have no symbols, no perplexity (null) and
are rejected unless ``keep_empty``.  Languages with fewer than ``1 / tail``
trusted rows or none (and null languages) use the shared table and its
quantiles.  Without two trusted rows that differ nothing can be judged and
every document with text is kept.  Repeated rows are
scored each by themselves; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import char_model
from quire.llm.decontaminate import may_hold
from quire.llm.store import table

SYMBOLS = 40
ORDER = 4
SHARED = "*"
FEW = 10  # rows that the median of all counts beside a language's own
GROUP = 32  # model languages handed to the tasks at a time
TABLES = 4  # dense tables of a task
SLICE = 512  # texts turned into Python strings at a time
TEXTS = -1  # in place of a 4-gram: the number of texts
START = 28  # the newline symbol: what stands before a text


def _symbol_table() -> np.ndarray:
    code = np.full(256, 35, dtype=np.uint8)             # other control bytes
    code[0x61:0x7B] = np.arange(26)                     # a-z
    code[0x41:0x5B] = 26                                # capitals
    code[0x30:0x3A] = 27                                # digits
    code[[0x0A, 0x0D]] = START
    code[[0x20, 0x09]] = 29
    code[ord(".")], code[ord(",")], code[ord("-")] = 30, 31, 32
    code[[ord(c) for c in "'\"()?:;"]] = 33
    code[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 34
    code[0x80:0xC0] = 36 + np.arange(64) % 2            # continuation bytes
    code[0xC0:0xE0] = 38                                # two-byte characters
    code[0xE0:] = 39                                    # longer ones
    return code


_CODE = _symbol_table()


def _codes(text: str) -> np.ndarray:
    """4-gram code at every symbol (the text begins after three newlines)."""
    s = np.full(len(raw := text.encode("utf-8", "replace")) + ORDER - 1, START, dtype=np.int32)
    s[ORDER - 1:] = _CODE[np.frombuffer(raw, dtype=np.uint8)]
    n = len(raw)
    out = s[:n].copy()
    for k in range(1, ORDER):
        out *= SYMBOLS
        out += s[k:k + n]
    return out


def _pieces(text: str, size: int = 1 << 20):
    """4-gram codes of a text in pieces of bounded size."""
    if len(text) <= size:
        yield _codes(text)
        return
    for lo in range(0, len(text), size):
        piece = text[max(0, lo - ORDER):lo + size]
        lead = len(text[max(0, lo - ORDER):lo].encode("utf-8", "replace"))
        yield _codes(piece)[lead:]


class _Symbols:
    """4-gram counts of a task by language, a bounded number of tables."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}
        self.texts: dict[str, int] = {}

    def _flush(self, lang) -> pd.DataFrame:
        c = self.held.pop(lang)
        g = np.flatnonzero(c)
        return pd.DataFrame({"lang": lang, "g": np.append(g, TEXTS).astype(np.int32),
                             "c": np.append(c[g], self.texts.pop(lang)).astype(np.int64)})

    def add(self, pdf: pd.DataFrame):
        held, texts = self.held, self.texts
        for lang, rows in pdf.groupby("lang", dropna=False, sort=True)["text"]:  # a table at a time
            lang = None if pd.isna(lang) else lang
            if lang not in held:
                if len(held) >= TABLES:
                    yield self._flush(min(held, key=texts.get))  # the least used makes room
                held[lang], texts[lang] = np.zeros(SYMBOLS ** ORDER, dtype=np.int64), 0
            c, wait, size = held[lang], [], 0
            for text in rows:
                if not text:
                    continue
                texts[lang] += 1
                for codes in _pieces(text):
                    wait.append(codes)
                    size += len(codes)
                    if size >= 1 << 19:
                        c += np.bincount(np.concatenate(wait), minlength=len(c))
                        wait, size = [], 0
            if wait:
                c += np.bincount(np.concatenate(wait), minlength=len(c))
            if c.max(initial=0) > 1 << 30:
                yield self._flush(lang)

    def rest(self):
        for lang in list(self.held):
            if self.texts[lang]:
                yield self._flush(lang)


def gram_counts(trusted: DataFrame) -> DataFrame:
    """(lang, g, hi, lo, c) of ``trusted`` (lang, text), counted in one pass:
    with hi = -1 the 4-grams g of symbols by language, and how many texts they
    are of (g = ``TEXTS``); else the n-grams (hi, lo) of characters for the
    model of half g (``char_model``)."""

    def run(batches):
        symbols, texts, half, size = _Symbols(), [], [], 0

        def chars():
            nonlocal texts, half, size
            out = char_model.count_block(texts, np.array(half, np.int64)).rename(columns={"half": "g"})
            texts, half, size = [], [], 0
            return out.assign(lang=None)

        for pdf in batches:
            yield from (x.assign(hi=-1, lo=-1) for x in symbols.add(pdf))
            for text, key in zip(pdf["text"], pdf["key"]):
                texts.append(text)
                half.append(key & 1)
                size += len(text or "")
                if size >= char_model.COUNT:
                    yield chars()
        if size:
            yield chars()
        yield from (x.assign(hi=-1, lo=-1) for x in symbols.rest())

    rows = trusted.select("lang", "text", F.xxhash64("text").alias("key")) \
        .mapInPandas(run, "lang string, g int, hi long, lo long, c long")
    return rows.groupBy("lang", "g", "hi", "lo").agg(F.sum("c").alias("c"))


def train(counts: DataFrame) -> DataFrame:
    """Model rows (lang, kind, order, g, v) from 4-gram counts (lang, g, c).

    kind 'p': discounted share of an n-gram, max(c - D, 0) / c(context);
    kind 'b': back-off weight of its context.  Orders 2 and 3 use continuation
    counts (distinct symbols before the n-gram), order 1 likewise, mixed with
    the uniform distribution.  Every order is written, so that no plan holds
    more than one.
    """
    level, out = counts, None
    for order in range(ORDER, 0, -1):
        ctx = F.floor(F.col("g") / SYMBOLS).cast("int")
        cuts = table(char_model.discounts(level, "lang"), "kn-cuts")  # a row per model language
        rows = level.join(F.broadcast(cuts), "lang").withColumn("ctx", ctx)
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        sums = table(rows.groupBy("lang", "ctx").agg(F.sum("c").alias("all"), F.sum(d).alias("cut"))
                     .withColumn("b", F.col("cut") / F.col("all")), "kn-sums")
        p = rows.withColumn("cut", d).join(sums.select("lang", "ctx", "all"), ["lang", "ctx"]) \
            .select("lang", F.lit("p").alias("kind"), F.lit(order).alias("order"), "g",
                    ((F.col("c") - F.col("cut")) / F.col("all")).alias("v"))
        b = sums.select("lang", F.lit("b").alias("kind"), F.lit(order).alias("order"), F.col("ctx").alias("g"),
                        F.col("b").alias("v"))
        p = table(p, "kn-shares")
        out = p.union(b) if out is None else out.union(p).union(b)
        if order > 1:  # how many distinct symbols stand before the (order - 1)-gram
            low = SYMBOLS ** (order - 1)
            level = table(level.groupBy("lang", (F.col("g") % low).cast("int").alias("g"))
                          .agg(F.count("*").alias("c")), "kn-lower")
    return out


def dense(rows: list[tuple[str, int, bytes, bytes]]) -> np.ndarray:
    """Log probabilities of all 4-grams of one language (float32)."""
    parts = {(kind, order): (np.frombuffer(g, np.int32), np.frombuffer(v, np.float64)) for kind, order, g, v in rows}
    none = (np.empty(0, np.int32), np.empty(0))
    prob = np.full(SYMBOLS, 1.0 / SYMBOLS, np.float32)
    for order in range(1, ORDER + 1):
        weight = np.ones(SYMBOLS ** (order - 1), np.float32)
        g, v = parts.get(("b", order), none)
        weight[g] = v
        # p(w | context) = share + weight(context) * p(w | shorter context)
        lower = prob.reshape(-1, SYMBOLS)
        prob = (weight.reshape(-1, len(lower), 1) * lower[None, :, :]).reshape(-1)
        g, v = parts.get(("p", order), none)
        prob[g] += v.astype(np.float32)
    np.maximum(prob, np.float32(1e-12), out=prob)
    return np.log(prob, out=prob)


class Scorer:
    """Scores texts of a task with the model shards it was handed."""

    def __init__(self, shards: dict[str, list]):
        self.shards, self.tables = shards, {}

    def _table(self, lang: str) -> np.ndarray:
        if lang not in self.tables:
            if len(self.tables) >= TABLES:  # so many at a time
                self.tables.clear()
            self.tables[lang] = dense(self.shards[lang])
        return self.tables[lang]

    def __call__(self, langs, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(model language, symbols, log perplexity or NaN) of each text."""
        return self.under([x if x in self.shards else SHARED for x in langs], texts)

    def under(self, use, texts):
        """The same with the model language of each text given."""
        n = np.array([len((t or "").encode("utf-8", "replace")) for t in texts], dtype=np.int64)
        ppl = np.full(len(n), np.nan)
        for lang in sorted(set(use) & set(self.shards)):  # one count shard after the other
            logp = self._table(lang)
            for i, (u, text) in enumerate(zip(use, texts)):
                if u == lang and text:
                    ppl[i] = -sum(float(logp[c].sum(dtype=np.float64)) for c in _pieces(text)) / n[i]
        return use, n, ppl


def shards_of(model: DataFrame) -> dict[str, list]:
    """Model rows by language, as arrays packed by the tasks: at most
    ``SYMBOLS ** 4`` n-grams an order and a bounded number of languages, so
    they fit the driver and every task."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return pd.DataFrame({"lang": [first["lang"]], "kind": [first["kind"]], "order": [first["order"]],
                             "g": [pdf["g"].to_numpy(np.int32).tobytes()], "v": [pdf["v"].to_numpy(np.float64).tobytes()]})

    packed = model.groupBy("lang", "kind", "order").applyInPandas(pack, "lang string, kind string, order int, g binary, v binary")
    shards: dict[str, list] = {}
    for r in packed.toLocalIterator():
        shards.setdefault(r["lang"], []).append((r["kind"], r["order"], bytes(r["g"]), bytes(r["v"])))
    return shards


class Shards:
    """The tables of all model languages, broadcast ``GROUP`` languages at a
    time, each time with the shared one."""

    def __init__(self, model: DataFrame, names: list[str]):
        self.names, self.groups = names, []
        for lo in range(0, max(len(names), 1), GROUP):
            part = names[lo:lo + GROUP]
            held = shards_of(model.where(F.col("lang").isin([*part, SHARED])))
            self.groups.append((part, model.sparkSession.sparkContext.broadcast(held)))

    def values(self):
        for i, (_, held) in enumerate(self.groups):
            yield from (v for k, v in held.value.items() if i == 0 or k != SHARED)

    def parts(self, docs: DataFrame, lang: Column):
        """(rows of ``docs``, their tables): the first with the languages
        that have no table."""
        if len(self.groups) == 1:
            yield docs, self.groups[0][1]
            return
        for i, (part, held) in enumerate(self.groups):
            rows = lang.isin(part) if i else lang.isin(part) | ~lang.isin(self.names) | lang.isNull()
            yield docs.where(rows), held


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def score(docs: DataFrame, shards: Shards, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, model_lang, symbols, log_perplexity, shared, key) of every row
    of ``docs``; ``shared`` is the log perplexity under the shared table,
    ``key`` names the text."""

    def scored(rows: DataFrame, held) -> DataFrame:
        def run(batches):
            scorer = Scorer(held.value)
            null = lambda x, pdf: pd.Series(x, index=pdf.index).astype(object).where(~np.isnan(x), None)
            for pdf in (p.iloc[lo:lo + SLICE] for p in batches for lo in range(0, len(p), SLICE)):
                texts = pdf["text"].tolist()
                use, n, ppl = scorer(pdf["lang"].tolist(), texts)
                own = any(u != SHARED for u in use)
                shared = scorer.under([SHARED] * len(texts), texts)[2] if own else ppl
                yield pd.DataFrame({"id": pdf["id"], "lang": pdf["lang"], "model_lang": use, "symbols": n,
                                    "log_perplexity": null(ppl, pdf), "shared": null(shared, pdf), "key": pdf["key"]})

        return rows.mapInPandas(run, "id long, lang string, model_lang string, symbols long, log_perplexity double, shared double, "
                               "key long")

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                      F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    return _all([scored(*x) for x in shards.parts(src, F.col("lang"))])


def _good(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)) \
        .select(F.col("doc_id").cast("long").alias("__good")).distinct()


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """(id, lang, text) of the documents labelled good and not toxic."""
    good, id_ = _good(labels), F.col(id_col).cast("long")
    some = docs.where(may_hold(good.select(F.xxhash64("__good").alias("g")), "g")(F.xxhash64(id_)))
    # merge: neither side has a bound that would allow a broadcast
    return some.join(good.hint("merge"), id_ == F.col("__good")) \
        .select(F.col("__good").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        tail: float = 0.0005, slack: float = 1.15):
    """(model shards, {model language: (median, low, high)}, scores of ``docs``) of the symbols.

    Limits are quantiles over all trusted rows of a model language; those of
    the shared table are over the trusted rows of all languages.
    """
    return _fit(docs, labels, id_col, text_col, lang_col, tail, slack)[:3]


def _fit(docs, labels, id_col, text_col, lang_col, tail, slack):
    """What ``fit`` returns, and the character counts (half, hi, lo, c)."""
    every = table(gram_counts(trusted_rows(docs, labels, id_col, text_col, lang_col)), "kn-counts")
    chars = every.where("hi >= 0").select(F.col("g").alias("half"), "hi", "lo", "c")
    every = every.where("hi < 0").select("lang", "g", "c")
    sizes = every.where((F.col("g") == TEXTS) & (F.col("lang") != SHARED) & (F.col("c") >= math.ceil(1 / tail)))
    names = sorted(r[0] for r in sizes.select("lang").collect())  # a row per model language
    every = every.where(F.col("g") != TEXTS)
    mine = F.col("lang").isin(names) if names else F.lit(False)
    shared = every.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(SHARED).alias("lang"), "g", "c")
    model = train(table(every.where(mine).union(shared), "kn-counts"))
    shards = Shards(table(model, "kn-model") if len(names) > GROUP else model, names)
    scored = table(score(docs, shards, id_col, text_col, lang_col), "kn-scores")
    base = scored.join(_good(labels), F.col("id") == F.col("__good"), "left_semi").where("log_perplexity is not null")
    base = base.where(F.col("model_lang") != SHARED).select("model_lang", "symbols", "log_perplexity") \
        .union(base.select(F.lit(SHARED), "symbols", "shared"))
    mid = base.groupBy("model_lang").agg(F.percentile_approx("log_perplexity", 0.5, 100000).alias("mid"))
    z = (F.col("log_perplexity") - F.col("mid")) * F.sqrt("symbols")
    q = base.join(F.broadcast(mid), "model_lang").groupBy("model_lang", "mid") \
        .agg(F.percentile_approx(z, [tail, 1 - tail], 100000).alias("q"))
    limits = {r["model_lang"]: (r["mid"], r["q"][0] * slack, r["q"][1] * slack) for r in q.collect()  # by language
              if r["q"][0] < r["q"][1]}
    return shards, limits, scored, chars


def char_limits(base: DataFrame, tail: float, slack: float) -> dict[str, tuple[float, float, float]]:
    """{language: (median, low, high)} of trusted rows (lang, chars,
    char_log_perplexity); ``SHARED``: those of all rows, for every other language.

    Every language has its own, however few rows n it has: its median counts
    like n rows beside ``FEW`` with the median of all, its quantiles like n
    beside ``1 / tail`` with the quantiles of all rows about their languages'
    medians."""
    half = F.percentile_approx("char_log_perplexity", 0.5, 100000)
    mid = base.agg(half).first()[0]
    if mid is None:
        return {}
    own = base.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), half.alias("own")) \
        .select(F.col("lang").alias("l"), "n", ((F.col("n") * F.col("own") + FEW * mid) / (F.col("n") + FEW)).alias("mid"))
    rows = base.join(F.broadcast(own), F.col("lang") == F.col("l"), "left")  # a row per language
    z = lambda m: (F.col("char_log_perplexity") - m) * F.sqrt(F.col("chars") + 1)
    at = lambda m: F.percentile_approx(z(m), [tail, 1 - tail], 100000)
    every, about = rows.agg(at(F.lit(mid)), at(F.coalesce("mid", F.lit(mid)))).first()
    if not every[0] < every[1]:
        return {}
    wide = lambda lo, hi: (min(lo, 0.0) * slack, max(hi, 0.0) * slack)
    limits, k = {SHARED: (mid, *wide(*every))}, 1 / tail
    for r in rows.where("l is not null").groupBy("l", "n", "mid").agg(at(F.col("mid")).alias("q")).collect():  # by language
        limits[r["l"]] = (r["mid"], *wide(*((r["n"] * q + k * a) / (r["n"] + k) for q, a in zip(r["q"], about))))
    return limits


def decided(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            keep_empty: bool = False, tail: float = 0.0005, slack: float = 1.15):
    """(symbol shards, symbol limits, decisions on every row of ``docs``); a row
    is kept if the symbols (``by_symbols``) and the characters (``by_chars``) keep it."""
    shards, limits, scored, counts = _fit(docs, labels, id_col, text_col, lang_col, tail, slack)
    chars = table(char_model.score(docs.select(F.col(text_col).alias("text")), counts, scored.count()), "kn-chars")
    scored = table(scored.join(chars, "key"), "kn-scores")
    base = scored.join(_good(labels), F.col("id") == F.col("__good"), "left_semi").where("char_log_perplexity is not null")
    own = char_limits(table(base.select("lang", "chars", "char_log_perplexity"), "kn-base"), tail, slack)
    cuts = [docs.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in x.items()],  # a row per language
                                              f"{a}_lang string, {a}mid double, {a}low double, {a}high double")
            for a, x in (("", limits), ("char_", own))]
    out = scored.join(F.broadcast(cuts[0]), F.col("model_lang") == F.col("_lang"), "left") \
        .join(F.broadcast(cuts[1]), F.when(F.col("lang").isin([k for k in own if k != SHARED]), F.col("lang"))
              .otherwise(SHARED) == F.col("char__lang"), "left")
    z = (F.col("log_perplexity") - F.col("mid")) * F.sqrt("symbols")
    y = (F.col("char_log_perplexity") - F.col("char_mid")) * F.sqrt(F.col("chars") + 1)
    out = out.withColumn("standard", z).withColumn("char_standard", y)
    by_symbols = F.when(F.col("symbols") == 0, F.lit(keep_empty)).when(F.col("mid").isNull(), F.lit(True)) \
        .otherwise(F.col("standard").between(F.col("low"), F.col("high")))
    by_chars = F.coalesce(F.col("char_standard").between(F.col("char_low"), F.col("char_high")), F.lit(True))
    return shards, limits, out.withColumn("by_symbols", by_symbols).withColumn("by_chars", by_chars)


def kept(use: list[str], n: np.ndarray, ppl: np.ndarray, limits: dict, keep_empty: bool) -> np.ndarray:
    """Decision for each text; the same rule as in ``judge``."""
    mid, low, high = (np.array([limits[u][k] if u in limits else np.nan for u in use], dtype=float) for k in range(3))
    z = (ppl - mid) * np.sqrt(n)
    return np.where(n == 0, keep_empty, np.isnan(mid) | ((z >= low) & (z <= high))).astype(bool)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          keep_empty: bool = False, **options) -> DataFrame:
    """(doc_id, lang, symbols, log_perplexity, standard, low, high, keep, and
    the characters' values) of every row of ``docs``; options as in ``fit``."""
    _, _, out = decided(docs, labels, id_col, text_col, lang_col, keep_empty, **options)
    return out.select(F.col("id").alias("doc_id"), "lang", "symbols", "log_perplexity", "standard", "low", "high",
                      (F.col("by_symbols") & F.col("by_chars")).alias("keep"), "chars", "char_log_perplexity", "char_standard",
                      "char_low", "char_high")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", keep_empty: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps; options as in ``fit``.  The
    symbols decide row by row in one pass (a pass per ``GROUP`` languages).  What
    the characters reject goes by a join of the rows that may be among it."""
    shards, limits, every = decided(docs, labels, id_col, text_col, lang_col, keep_empty, **options)
    gone = table(every.where("by_symbols and not by_chars").select(F.col("key").alias("__gone"), F.col("lang").alias("__lang")).distinct(),
                 "kn-gone")
    key, maybe = F.xxhash64(text_col), may_hold(gone, "__gone")
    # merge: neither side has a bound that would allow a broadcast
    left = docs.where(maybe(key)).join(gone.hint("merge"), (key == F.col("__gone"))
                                       & F.col(lang_col).cast("string").eqNullSafe(F.col("__lang")), "left_anti")
    rest = docs.where(~maybe(key)).union(left)
    at_lang, at_text = docs.columns.index(lang_col), docs.columns.index(text_col)

    def chosen(rows: DataFrame, held) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            scorer = Scorer(held.value)
            for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
                langs = batch.column(at_lang).cast(pa.string()).to_pylist()
                keep = kept(*scorer(langs, batch.column(at_text).to_pylist()), limits, keep_empty)
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, docs.schema)

    return _all([chosen(*x) for x in shards.parts(rest, F.col(lang_col).cast("string"))])
