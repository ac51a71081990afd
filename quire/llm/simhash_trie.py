"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

1. *Fingerprints* (``fingerprints``): lower-cased words, word shingles,
   XXH64 (seed 42) of each; a bit is set where more than half of the shingles
   set it.
2. *Trie* (``node_pairs``): equal fingerprints are one leaf.  Pairs of trie
   nodes are traversed together from the root, level by level, as a small
   table: each level joins both nodes with their children, adds the differing
   bits of the new level, and drops a pair as soon as the sum passes
   ``max_bits``.  A pair with few enough fingerprints below it is done; a
   node with many is split further, so a crowded branch becomes many pairs.
3. *Below a pair* (``_links_below``) one task walks the remaining levels the
   same way over sorted fingerprints, a bounded number of node pairs at a time, and returns a
   spanning forest of the links found: as many rows as fingerprints, not as
   pairs, yet with the same components.
4. *Groups*: connected components over the forest.

Nulls and empty texts have no words: fingerprint zero, linked like any other.
Texts of fewer words than the shingle give one shingle of the whole sequence.
Repeated rows share a fingerprint and therefore a group.  A null ``doc_id`` is
kept; it never names a group unless all ids of the group are null (then the
group is null).  Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.store import table

FIRST_BITS = 6     # levels of the trie that the first step opens
STEP_BITS = 4      # levels of each later step
PAIR_ROWS = 1 << 16  # fingerprints below a node pair that one task takes
FRONTIER = 1 << 20   # node pairs a task expands at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of one text (unsigned)."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, n)
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    stops = ends[k - 1:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(starts), 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo:lo + 65536], stops[lo:lo + 65536])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long with the bits of the fingerprint."""

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fp})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return src.mapInPandas(run, "id long, fp long")


def _node(level_bits: int):
    """Trie node at a depth: the leading bits of the fingerprint."""
    return F.shiftrightunsigned("fp", 64 - level_bits)


def node_pairs(leaves: DataFrame, max_bits: int, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(depth, a, b): trie node pairs that cover every pair of fingerprints
    within ``max_bits`` (a <= b), found by joint traversal with pruning."""
    spark = leaves.sparkSession
    open_pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    done = None
    depth, step = 0, FIRST_BITS
    while True:
        depth += step
        kids = table(leaves.groupBy(_node(depth).alias("node")).agg(F.count("*").alias("n")), "trie-level") \
            .withColumn("up", F.shiftrightunsigned("node", step))
        ka = kids.select(F.col("up").alias("a"), F.col("node").alias("ka"), F.col("n").alias("na"))
        kb = kids.select(F.col("up").alias("b"), F.col("node").alias("kb"), F.col("n").alias("nb"))
        # whole distance of the prefixes = bits carried down + bits of this step
        grown = open_pairs.join(ka, "a").join(kb, "b") \
            .where((F.col("ka") <= F.col("kb")) & (F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))) <= max_bits))
        grown = table(grown.select("ka", "kb", (F.col("na") + F.col("nb")).alias("n")), "trie-pairs")
        last = depth + STEP_BITS >= 64
        small = grown if last else grown.where(F.col("n") <= pair_rows)
        part = small.select(F.lit(depth).alias("depth"), F.col("ka").alias("a"), F.col("kb").alias("b"))
        done = part if done is None else done.union(part)
        if last or grown.where(F.col("n") > pair_rows).isEmpty():
            return done
        open_pairs = grown.where(F.col("n") > pair_rows).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
        step = STEP_BITS


def _links_below(x: np.ndarray, y: np.ndarray, depth: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of x, j of y) within ``max_bits``; x, y sorted, unsigned.

    Node pairs are index ranges; each round splits both ranges at the next
    bit, adds one where the branches differ and drops what passes the budget.
    """
    i_out, j_out = [], []
    if not len(x) or not len(y):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # what the two prefixes above already differ in
    above = int(np.bitwise_count((x[0] ^ y[0]) >> np.uint64(64 - depth))) if depth else 0
    work = [(np.array([0]), np.array([len(x)]), np.array([0]), np.array([len(y)]), np.array([above]), depth)]
    while work:
        xl, xh, yl, yh, err, d = work.pop()
        few = (xh - xl) * (yh - yl) <= 24
        if d >= 64:
            few[:] = True
        if few.any():
            a, b, c, e = xl[few], xh[few], yl[few], yh[few]
            ny = e - c
            size = (b - a) * ny
            for lo, hi in _slices(size):
                s = size[lo:hi]
                k = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                w = np.repeat(ny[lo:hi], s)
                i, j = np.repeat(a[lo:hi], s) + k // w, np.repeat(c[lo:hi], s) + k % w
                ok = np.bitwise_count(x[i] ^ y[j]) <= max_bits
                i_out.append(i[ok])
                j_out.append(j[ok])
        go = ~few
        if not go.any():
            continue
        xl, xh, yl, yh, err = xl[go], xh[go], yl[go], yh[go], err[go]
        bit = np.uint64(1) << np.uint64(63 - d)
        xm, ym = _split(x, xl, xh, d, bit), _split(y, yl, yh, d, bit)
        kids = []
        for (p, q), (r, s), add in (((xl, xm), (yl, ym), 0), ((xm, xh), (ym, yh), 0),
                                    ((xl, xm), (ym, yh), 1), ((xm, xh), (yl, ym), 1)):
            ok = (p < q) & (r < s) & (err + add <= max_bits)
            kids.append((p[ok], q[ok], r[ok], s[ok], err[ok] + add))
        new = [np.concatenate(c) for c in zip(*kids)]
        for lo in range(0, len(new[0]), FRONTIER):
            work.append((*(c[lo:lo + FRONTIER] for c in new), d + 1))
    none = np.empty(0, np.int64)
    return (np.concatenate(i_out), np.concatenate(j_out)) if i_out else (none, none)


def _slices(size: np.ndarray, most: int = 1 << 22):
    """Cut a list of sizes into runs whose sums stay near ``most``."""
    total = np.cumsum(size)
    lo = 0
    while lo < len(size):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + most, side="right")))
        yield lo, hi
        lo = hi


def _split(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, bit: np.uint64) -> np.ndarray:
    """Where, in each sorted range sharing ``d`` leading bits, the next bit becomes one."""
    mask = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
    cut = np.searchsorted(v, (v[lo] & mask) | bit, side="left")
    return np.clip(cut, lo, hi)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked node with the smallest node of its component (array union)."""
    lab = np.arange(n)
    while True:
        a, b = lab[i], lab[j]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    on = np.flatnonzero(lab != np.arange(n))
    return on, lab[on]


def links(leaves: DataFrame, max_bits: int = 3, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """(a, b): forest links between distinct fingerprints of ``leaves`` (fp)."""
    pairs = table(node_pairs(leaves, max_bits, pair_rows).withColumn("pair", F.monotonically_increasing_id()),
                  "trie-done")
    ends = pairs.select("pair", "depth", F.explode(F.when(F.col("a") == F.col("b"), F.array("a"))
                                                   .otherwise(F.array("a", "b"))).alias("node"))
    depths = sorted(r[0] for r in pairs.select("depth").distinct().collect())  # at most 16
    if not depths:
        return leaves.sparkSession.createDataFrame([], "a long, b long")
    at = leaves.select("fp", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _node(d).alias("node"))
                                                 for d in depths])).alias("s")).select("fp", "s.*")
    rows = at.join(ends, ["depth", "node"]).select("pair", "depth", "fp")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = int(pdf["depth"].iloc[0])
        v = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        top = v >> np.uint64(64 - depth)
        cut = int(np.searchsorted(top, top[-1]))  # two nodes, or one with itself
        x, y = (v, v) if top[0] == top[-1] else (v[:cut], v[cut:])
        i, j = _links_below(x, y, depth, max_bits)
        on, root = forest(i, j + (0 if x is v else cut), len(v))
        return pd.DataFrame({"a": v[on].view(np.int64), "b": v[root].view(np.int64)})

    return rows.groupBy("pair").applyInPandas(walk, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    ``component_id``: smallest id reachable over links of at most ``max_bits``
    differing bits.
    """
    return _grouped(docs, id_col, text_col, shingle, max_bits).drop("group")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """``near_groups`` with a name for each group that no other has."""
    fps = table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    leaves = table(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-leaves")
    part = components(links(leaves.select("fp"), max_bits))
    # smallest id of a component: a minimum over its fingerprints
    of = leaves.join(part, leaves["fp"] == part["node"], "left") \
        .select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = of.groupBy("c").agg(F.min("rep").alias("component_id"))
    of = table(of.join(least, "c").select("fp", "c", "component_id"), "simhash-groups")
    return fps.join(of, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.col("c").alias("group"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near group.

    Rows with one id and texts of different groups are judged each for itself.
    Of the rows of one id in one group one stays (the smallest text); rows with a null id stay only if
    their whole group has no id (then one of them stays).
    """
    groups = table(_grouped(docs, id_col, text_col, shingle, max_bits), "simhash-rows")
    first = groups.where(F.col("doc_id") == F.col("component_id"))
    by_id = groups.groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count("*").alias("__kept_rows"))
    kept = first.select(F.col("doc_id").alias("__kept_id")).distinct().join(by_id, "__kept_id")
    cols = [docs[c] for c in docs.columns]
    found = docs.join(kept.hint("merge"), docs[id_col] == F.col("__kept_id"))
    once = found.where("__kept_rows = 1").select(*cols)
    # ids with several rows: their fingerprints say which rows are of the group
    mark = first.select(F.col("doc_id").alias("__mark_id"), F.col("fingerprint").alias("__fp"), F.col("group").alias("__group")).distinct()
    again = _with_fingerprint(found.where("__kept_rows > 1").select(*cols), text_col, shingle) \
        .join(mark, (F.col(id_col) == F.col("__mark_id")) & (F.col("__fp_row") == F.col("__fp"))) \
        .groupBy("__mark_id", "__group").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col))).alias("__row")).select("__row.*")
    lone = groups.where("component_id is null").select("fingerprint").distinct()
    return once.unionByName(again).unionByName(_null_rows(docs, lone, id_col, text_col, shingle))


def _with_fingerprint(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pdf.assign(__fp_row=[f"{fingerprint(t, shingle):016x}" for t in pdf[text_col]])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, ddl + ", __fp_row string")


def _null_rows(docs: DataFrame, lone: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """For groups without any id: one of their rows (smallest text) per fingerprint."""
    rows = _with_fingerprint(docs.where(F.col(id_col).isNull()), text_col, shingle)
    with_fp = rows.join(lone, F.col("__fp_row") == F.col("fingerprint"), "left_semi")
    first = with_fp.groupBy("__fp_row").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text_col))).alias("__r"))
    return first.select("__r.*")
