"""Mixing sources to target weights: hierarchical token budgets.

The tree is domain, then language, then source (any list of level columns).
A budget enters at the root and is divided among siblings by weight:

* a child never gets more than it can give: its tokens times ``max_epochs``,
  summed over the leaves below it;
* what a child cannot give goes to its siblings by weight (water level over
  the siblings sorted by capacity per weight); only when all siblings are full
  does the rest reach the parent's siblings, because the parent's capacity is
  the sum of theirs;
* a leaf with budget b and t tokens repeats all its documents b // t times and
  adds the token-prefix of one more epoch, up to b mod t tokens.  Every epoch
  has an order of its own: md5 of seed, epoch and document id (then text).

The prefix of a leaf of any size is found without sorting it: the hashes are
cut into 4096 ranges, token sums per range are added up per leaf, and only
the range where the budget ends is ordered.  All steps are DataFrame
functions.

Defined cases: null or empty texts have no tokens; they cost nothing and are
selected with the whole epochs and with a prefix that reaches them.  Null level
values make a branch of their own.  Rows with equal id and text have equal
hashes: a prefix takes all of them or none.  A weight missing from the table
counts as ``default_weight``; weights must be positive.  An empty table gives an
empty result.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import table

CELL_DIGITS = 3  # hexadecimal digits of the hash that name a range: 4096 ranges a leaf
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """Words of a text (white space between them)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _spread(nodes: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Divide ``have`` (the parent's budget) among siblings: adds ``get``.

    ``nodes``: one row per child with w (weight) and cap (capacity).  Children
    are taken in order of cap / w; before child i the rest of the budget over
    the rest of the weight is the level; the first child that can give its
    share at that level fixes it for itself and all after it.
    """
    order = [F.col("cap") / F.col("w"), *[F.col(c) for c in nodes.columns if c.startswith("l_")]]
    here = Window.partitionBy(*parent).orderBy(*order)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    n = nodes.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        .withColumn("rest_w", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    level = (F.col("have") - F.col("full")) / F.col("rest_w")
    n = n.withColumn("level", F.when(F.col("cap") >= F.col("w") * level, level))
    fixed = F.first("level", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("fixed", fixed)
    return n.withColumn("get", F.when(F.col("fixed").isNull(), F.col("cap"))
                        .otherwise(F.least(F.col("cap"), F.col("w") * F.col("fixed")))) \
        .drop("full", "rest_w", "level", "fixed")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: DataFrame, budget: float, max_epochs: int,
            default_weight: float = 1.0) -> DataFrame:
    """(levels..., tokens, get): token budget of every leaf (``get``, floored).

    ``leaves``: levels (l_0, l_1, ...) and tokens.  ``weights``: (level int,
    name string, weight double), positive weights.
    """
    cols = [f"l_{i}" for i in range(len(levels))]
    caps = leaves.withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    have = leaves.agg(F.lit(float(budget)).alias("have"))
    parent: list[str] = []
    for i, col in enumerate(cols):
        nodes = caps.groupBy(*cols[:i + 1]).agg(F.sum("cap").alias("cap"))
        w = weights.where(F.col("level") == i).select(F.col("name").alias("__n"), F.col("weight").alias("__w"))
        nodes = nodes.join(w, F.col(col).eqNullSafe(F.col("__n")), "left") \
            .withColumn("w", F.coalesce("__w", F.lit(float(default_weight)))).drop("__n", "__w")
        if i == 0:
            nodes = nodes.crossJoin(F.broadcast(have))  # one row: the root
        else:
            up = have.select(*[F.col(c).alias(f"__{c}") for c in parent], F.col("get").alias("have"))
            same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in parent]
            cond = same[0]
            for s in same[1:]:
                cond = cond & s
            nodes = nodes.join(up, cond).drop(*[f"__{c}" for c in parent])
        have = _spread(nodes, parent or [F.lit(0)])
        parent = cols[:i + 1]
    out = have.select(*cols, "get")
    cond = None
    small = leaves.select(*[F.col(c).alias(f"__{c}") for c in cols], "tokens")
    for c in cols:
        same = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = same if cond is None else cond & same
    return out.join(small, cond).select(*cols, "tokens", F.floor("get").cast("long").alias("get"))


def _equal(cols: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return cond


def select_copies(docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: DataFrame,
                  budget: float | None = None, budget_share: float = 0.5, max_epochs: int = 4, seed: int = 17,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, l_0, l_1, ..., tokens, copies) of every selected document.

    ``levels``: (name, column) from the root down.  The budget is ``budget``
    tokens, or ``budget_share`` of all tokens.  ``text_key`` is xxhash64 of the
    text.
    """
    if not weights.where("weight is null or weight <= 0").isEmpty():
        raise ValueError("weights must be positive")
    cols = [f"l_{i}" for i in range(len(levels))]
    meta = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"),
                       *[c.cast("string").alias(a) for a, (_, c) in zip(cols, levels)],
                       tokens(F.col(text_col)).alias("tokens"),
                       F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))
    meta = table(meta, "mix-docs")
    leaves = table(meta.groupBy(*cols).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    total = budget if budget is not None else float(leaves.agg(F.sum("tokens")).first()[0] or 0) * budget_share
    plan = budgets(leaves, [n for n, _ in levels], weights, total, max_epochs)
    some = F.col("tokens") > 0
    plan = table(plan.select(*[F.col(c).alias(f"p_{c}") for c in cols],
                             F.when(some, F.floor(F.col("get") / F.col("tokens"))).otherwise(0).cast("int").alias("whole"),
                             F.when(some, F.col("get") % F.col("tokens")).otherwise(0).cast("long").alias("part")), "mix-plan")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"),
                            F.coalesce(F.col("id").cast("string"), F.lit("")), "text_md5"))
    placed = meta.join(plan, _equal(cols, "p_")).withColumn("k", key) \
        .withColumn("cell", F.conv(F.substring("k", 1, CELL_DIGITS), 16, 10).cast("int")) \
        .select("id", "text_key", *cols, "tokens", "whole", "part", "k", "cell")
    # the last, partial epoch: sums per hash range, then order inside the range where it ends
    sums = placed.groupBy(*cols, "cell").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy(*cols).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = table(sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0))), "mix-cells") \
        .select(*[F.col(c).alias(f"p_{c}") for c in [*cols, "cell"]], "s", "base")
    at = placed.join(sums, _equal([*cols, "cell"], "p_"))
    ends = F.col("base") + F.col("s")
    upto = Window.partitionBy(*cols, "cell").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = at.where((ends > F.col("part")) & (F.col("base") <= F.col("part"))) \
        .withColumn("last", (F.col("base") + F.sum("tokens").over(upto) <= F.col("part")).cast("int"))
    clear = at.where((ends <= F.col("part")) | (F.col("base") > F.col("part"))) \
        .withColumn("last", (ends <= F.col("part")).cast("int"))
    return edge.unionByName(clear).withColumn("copies", F.col("whole") + F.col("last")).where("copies > 0") \
        .select("id", "text_key", *cols, "tokens", "copies")


def mix(docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: DataFrame, id_col: str = "doc_id",
        text_col: str = "text", **options) -> DataFrame:
    """``docs`` as selected, one row per copy, plus ``mix_tokens`` and
    ``mix_epoch`` (0, 1, ...), in place of columns with these names.  A row gets
    the copies of its id, text and leaf; rows that agree in all three have one
    place in the order and so the same copies.  Options as in ``select_copies``."""
    cols = [f"l_{i}" for i in range(len(levels))]
    got = select_copies(docs, levels, weights, id_col=id_col, text_col=text_col, **options)
    got = got.groupBy(F.col("id").alias("__mix_id"), F.col("text_key").alias("__mix_key"), *[F.col(c).alias(f"__mix_{c}") for c in cols]) \
        .agg(F.max("tokens").alias("mix_tokens"), F.max("copies").alias("__mix_copies"))
    names = [c for c in docs.columns if c not in ("mix_tokens", "mix_epoch")]
    rows = docs.select(*names, F.xxhash64(text_col).alias("__doc_key"), *[c.cast("string").alias(f"__doc_{a}") for a, (_, c) in zip(cols, levels)])
    # merge: neither side has a bound that would allow a broadcast
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__mix_id")) & (F.col("__doc_key") == F.col("__mix_key"))
    for c in cols:
        same = same & F.col(f"__doc_{c}").eqNullSafe(F.col(f"__mix_{c}"))
    out = rows.join(got.hint("merge"), same)
    return out.select(*names, "mix_tokens", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1)).alias("mix_epoch"))
