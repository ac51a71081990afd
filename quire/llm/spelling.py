"""Spelling variants: words one edit apart, found by a frontier over a trie.

Words are counted over whole texts.  The trie of all words, read forwards and
(a second root) backwards, is a distributed edge table: one row per node with
its characters and children, a node being named by two 64-bit hashes of its prefix.
The frontier holds states (word, position, node, edits) and is joined with the edge
table level by level:

* a state without an edit follows the character of its word and also branches,
  with one edit, to every other child (a replaced character) and to every
  child without moving on in the word (an inserted one);
* a state with its edit follows the word's characters only;
* a state at the end of its word with one edit whose node ends a word is a pair.

An edit in the second half of a word is found forwards, one in the first half
backwards, so every search starts at the node of half its word instead of the
root, where each level would branch to the whole alphabet.  Deletions are the
insertions of the other word.  Names may collide, so a pair counts only if the
two words, compared directly, are one edit apart.

Words longer than ``LONG`` code points do not go level by level: their variants with one
code point left out are joined by hash and compared in the same way.  Levels thus number
``LONG`` at most, and the work on a word is in proportion to its length.

Sizes: a state branches to at most the alphabet (94 letters with case folded:
88); a popular node is split over tasks by salting its states, with a copy of
its one row per salt.  Counts are added up by word before any shuffle.

Defined cases: null and empty texts have no words; a null id is written as the
empty string in the hash; repeated rows count each; an empty table has no
words; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import table
from quire.llm.words import mix

RUN = "[A-Za-zÀ-ÿ]"
LONG = 40
HELD = 500_000  # distinct words a task counts before it sends them on
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def damaged(run: str, doc_id, every: int) -> str:
    """``run`` without one code point where the hash of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage_every: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased (A-Z only) maximal runs of letters.

    With ``damage_every`` a run loses a code point where that number divides
    the CRC-32 of ``id:run`` (the planted misspellings of the evaluation).
    """

    def run(batches):
        runs = re.compile(f"{RUN}{{{least_length},}}").findall
        held: Counter = Counter()

        def rows():
            got = pd.DataFrame({"word": list(held), "n": list(held.values())})
            held.clear()
            return got

        for ids, texts in ((p["id"].tolist(), p["text"].tolist()) for p in batches):
            for id_, text in zip(ids, texts):
                if not text:
                    continue
                found = Counter(runs(text.encode("utf-8", "replace").translate(_LOWER).decode("utf-8")))
                if damage_every is None:
                    held.update(found)
                else:
                    for w, n in found.items():
                        w = damaged(w, id_, damage_every)
                        if len(w) >= least_length:
                            held[w] += n
                if len(held) >= HELD:
                    yield rows()
        if held:
            yield rows()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = src.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


_MUL, _ONE = np.uint64(0xD1342543DE82EF95), np.uint64(1)


def _nodes(words: list[str], back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, place in it, character, node after it) of every
    place; a node is the hash of its prefix and its direction."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer("".join(w[::-1] if back else w for w in words).encode("utf-32-le"), "<u4")
    owner = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(chars)) - first[owner]
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, _MUL, np.uint64))
    part = mix(chars.astype(np.uint64) + _ONE) * powers[place]
    total = np.cumsum(part)
    total -= (total[first] - part[first])[owner]
    node = mix(total ^ mix((place.astype(np.uint64) + _ONE) * np.uint64(2) + np.uint64(int(back))))
    return owner, place, chars, node.view(np.int64)


def _letters(codes: np.ndarray) -> np.ndarray:
    """Code points as one-letter strings (0: the empty string)."""
    names, back = np.unique(codes, return_inverse=True)
    return np.array([chr(c) if c else "" for c in names], dtype=object)[back]


def _in_slices(pdf: pd.DataFrame, size: int = 20_000):
    for lo in range(0, len(pdf), size):
        yield pdf["word"].iloc[lo:lo + size].tolist()


def edges(words: DataFrame, least_depth: int) -> DataFrame:
    """(node, depth, kids): the tries of ``words`` in both directions, from
    ``least_depth`` on; a kid has its character ``ch``, node ``to``, the
    characters that follow it (``then``) and, as bits, how many characters
    below it words end (``heights``)."""

    def run(batches):
        for pdf in batches:
            for part in _in_slices(pdf):
                size = np.array([len(w) for w in part], np.int64)
                for back in (False, True):
                    owner, place, chars, node = _nodes(part, back)
                    at = np.flatnonzero(place >= least_depth)
                    ends = place[at] == size[owner[at]] - 1
                    then = np.where(ends, 0, np.append(chars, 0)[at + 1])
                    below = np.int64(1) << (size[owner[at]] - 1 - place[at])
                    yield pd.DataFrame({"node": node[at - 1], "depth": place[at].astype(np.int32), "ch": _letters(chars[at]),
                                        "to": node[at], "heights": below, "then": _letters(then)})

    rows = words.select("word").mapInPandas(run, "node long, depth int, ch string, to long, heights long, then string")
    kids = rows.groupBy("node", "depth", "ch", "to").agg(F.bit_or("heights").alias("heights"),
                                                         F.array_join(F.collect_set("then"), "").alias("then"))
    return kids.groupBy("node", "depth").agg(F.collect_list(F.struct("ch", "to", "heights", "then")).alias("kids"))


def _starts(words: DataFrame) -> DataFrame:
    """(word, rest, node, edits): each word at its half, in both directions."""

    def run(batches):
        for pdf in batches:
            for part in _in_slices(pdf):
                size = np.array([len(w) for w in part], np.int64)
                first = np.cumsum(size) - size
                for back in (False, True):
                    node = _nodes(part, back)[3][first + size // 2 - 1]
                    rest = [(w[::-1] if back else w)[len(w) // 2:] for w in part]
                    yield pd.DataFrame({"word": part, "rest": rest, "node": node, "edits": 0})

    return words.select("word").mapInPandas(run, "word string, rest string, node long, edits int")


def _ends(words: DataFrame) -> DataFrame:
    """(node, other): the last nodes of each word."""

    def run(batches):
        for pdf in batches:
            for part in _in_slices(pdf):
                last = np.cumsum([len(w) for w in part]) - 1
                for back in (False, True):
                    yield pd.DataFrame({"node": _nodes(part, back)[3][last], "other": part})

    return words.select("word").mapInPandas(run, "node long, other string")


def _step(frontier: DataFrame, trie: DataFrame) -> DataFrame:
    """The states one level deeper; those without a chance are left out: words
    must end as far below the node as the rest is long, and go on with its next
    character."""
    size, nxt = F.length("rest"), F.left("rest", F.lit(1))
    met = frontier.join(trie.select("node", "kids"), "node").select(
        "word", "rest", "edits", size.alias("size"), nxt.alias("nxt"), F.substring("rest", 2, LONG + 1).alias("tail"),
        F.substring("rest", 2, 1).alias("nxt2"), F.inline("kids"))

    def alive(length, first):
        end = F.call_function("shiftright", F.col("heights"), length).bitwiseAND(F.lit(1)) == 1
        return end & ((length == 0) | F.contains("then", first))

    same, edited = F.col("ch") == F.col("nxt"), F.col("edits") == 1
    on = (F.col("size") > 0) & ((same & ~edited) | ((same | ~edited) & alive(F.col("size") - 1, F.col("nxt2"))))
    insert = ~same & ~edited & alive(F.col("size"), F.col("nxt"))
    moved = F.when(on, F.struct(F.col("tail").alias("rest"), F.col("to").alias("node"), F.when(same & ~edited, 0).otherwise(1).alias("edits")))
    stayed = F.when(insert, F.struct(F.col("rest").alias("rest"), F.col("to").alias("node"), F.lit(1).alias("edits")))
    return met.where(on | insert).select("word", F.explode(F.array(moved, stayed)).alias("s")).where("s is not null").select("word", "s.*")


def _short_pairs(words: DataFrame, least_length: int) -> DataFrame:
    """(a, b): candidate pairs of words of ``LONG`` code points or fewer."""
    least_depth = max(least_length // 2, 1)
    trie = table(edges(words, least_depth), "trie")
    frontier, found = table(_starts(words), "frontier"), None
    for level in range(LONG + 1):
        got = table(_step(frontier, trie.where(F.col("depth") >= least_depth + level)), "frontier")
        done = (F.col("edits") == 1) & (F.length("rest") == 0)
        pairs = got.where(done).select("word", "node")
        found = pairs if found is None else found.union(pairs)
        frontier = got.where(~done)
        if frontier.isEmpty():
            break
    return found.join(_ends(words), "node").select(F.col("word").alias("a"), F.col("other").alias("b"))


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, b): candidate pairs of words of ``LONG`` code points or more, by the
    hashes of their variants without one code point."""

    def run(batches):
        for pdf in batches:
            for word, wid in zip(pdf["word"], pdf["wid"]):
                c = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64) + _ONE
                powers = np.cumprod(np.full(len(c) + 1, _MUL, np.uint64))
                before = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(c) * powers[:-1])))
                after = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(c[1:]) * powers[:-2])))
                less = before[:-1] + (after[-1] - after)   # without place i
                at = np.arange(len(c))
                yield pd.DataFrame({"wid": wid, "key": mix(less).view(np.int64), "place": at,
                                    "new": np.concatenate(([True], c[1:] != c[:-1]))})
                yield pd.DataFrame({"wid": [wid], "key": mix(before[-1:]).view(np.int64), "place": [-1], "new": [False]})

    ids = words.select("word", F.xxhash64("word").alias("wid"))
    rows = table(ids.mapInPandas(run, "wid long, key long, place long, new boolean"), "variants")
    gone = rows.where("place >= 0")
    same = gone.alias("x").join(gone.alias("y"), ["key", "place"]).where("x.wid < y.wid").select("x.wid", F.col("y.wid").alias("wid2"))
    more = rows.where("place < 0").alias("x").join(gone.where("new").alias("y"), "key").select("x.wid", F.col("y.wid").alias("wid2"))
    pairs = same.union(more).distinct()
    return pairs.join(ids.select("wid", F.col("word").alias("a")), "wid") \
        .join(ids.select(F.col("wid").alias("wid2"), F.col("word").alias("b")), "wid2").select("a", "b")


def near_pairs(words: DataFrame, least_length: int) -> DataFrame:
    """(a, b), a < b: all pairs of distinct ``words`` (column word, each once,
    ``least_length`` code points at least) that are one edit apart."""
    size = F.length("word")
    pairs = _short_pairs(words.where(size <= LONG), least_length).union(_long_pairs(words.where(size >= LONG)))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def variants(counts: DataFrame, least_length: int = 7, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``word_counts`` rows.

    ``form`` is the near word with the largest count (ties: the smaller word)
    if that is at least ``ratio`` times the word's own, and ``root`` the end of
    the chain of forms.  Counts rise by ``ratio`` at every step, so chains are
    short and have no circle; they are followed by doubling."""
    counts = table(counts, "words")
    pairs = table(near_pairs(counts.select("word"), least_length), "near")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = near.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    rows = counts.join(best, "word", "left")
    taken = -F.col("top.m") >= ratio * F.col("n")
    rows = table(rows.select("word", F.when(taken, F.col("top.other")).alias("form"), "n",
                             F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, -F.col("top.m")).alias("form_n")), "forms")
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = table(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        roots = step.select("word", "root")
        if step.where("next is not null").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
