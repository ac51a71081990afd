"""Language-model reply tables: JSON extraction, markers, reflection and
novelty folds, chunk prefixes, chat messages.

The engine never calls a model: replies arrive as a table
``(item_id, round, text)``.  Folds over rounds are single ``groupBy``
aggregations (``min_by``/``max_by`` on a round ordering), so no window
partition ever has to hold a whole hot item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.ordering import neighbour

# Marker phrases.
DONE = "I am done"
ALL_COMPLETED = "ALL_COMPLETED"
NOVEL = "decision made: novel"
NOT_NOVEL = "decision made: not novel"
EOT = "<|eot_id|>"

FENCED = r"(?s)```json(.*?)```"
BRACED = r"(?s)\{.*?\}"
CONTROL = r"[\x00-\x1F\x7F]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_control(c: Column) -> Column:
    """Drop control characters (second-chance parse)."""
    return F.regexp_replace(c, CONTROL, "")


def is_strict_json(c: Column) -> Column:
    """Parses as JSON and is one whole object/array (no trailing text)."""
    return (F.try_parse_json(c).isNotNull() & c.rlike(r"^[\[{]") & c.rlike(r"[\]}]$"))


def json_candidates(text: Column) -> Column:
    fenced = F.regexp_extract_all(text, F.lit(FENCED), 1)
    braced = F.regexp_extract_all(text, F.lit(BRACED), 0)
    return F.when(F.size(fenced) > 0, fenced).otherwise(braced)


def extract_json(text: Column) -> Column:
    """First candidate that parses (after strip, or after control-char repair);
    NULL if none.  Returns the JSON text."""
    def pick(x):
        s = strip(x)
        cleaned = clean_control(s)
        return F.when(is_strict_json(s), s).when(is_strict_json(cleaned), cleaned)

    parsed = F.filter(F.transform(json_candidates(text), pick), lambda y: y.isNotNull())
    return F.try_element_at(parsed, F.lit(1))


def json_field(js: Column, field: str, typ: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(js), f"$.{field}", typ)


def markers(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    low = F.lower(t)
    decision = (F.when(F.contains(low, F.lit(NOVEL)), F.lit("novel"))
                .when(F.contains(low, F.lit(NOT_NOVEL)), F.lit("not novel")))
    return df.select("*", F.contains(t, F.lit(DONE)).alias("done"),
                     F.contains(t, F.lit(ALL_COMPLETED)).alias("all_completed"),
                     decision.alias("decision"))


def reflect(responses: DataFrame, key: str = "item_id", rnd: str = "round", text: str = "text",
            max_rounds: int = 5, check_first: bool = True) -> DataFrame:
    """Reflection fold: stop at the first round >= 2 saying "I am done", else at
    the last round (<= max_rounds).  If a checked round up to the stop has no
    parseable JSON, the item is dropped.  Output (key, stop_round, json)."""
    r = F.col(rnd)
    js = extract_json(F.col(text))
    done = F.contains(F.col(text), F.lit(DONE)) & (r >= 2) & (r <= max_rounds)
    first_checked = 1 if check_first else 2
    agg = (responses.where(r <= max_rounds)
           .select(key, rnd, js.alias("_js"), done.alias("_done"))
           .groupBy(key).agg(
               F.min(F.when(F.col("_done"), r)).alias("_done_round"),
               F.max(r).alias("_last_round"),
               F.min_by("_js", F.when(F.col("_done"), r)).alias("_js_done"),
               F.max_by("_js", r).alias("_js_last"),
               F.min(F.when(F.col("_js").isNull() & (r >= first_checked), r)).alias("_fail")))
    stop = F.coalesce(F.col("_done_round"), F.col("_last_round"))
    return (agg.where(F.col("_fail").isNull() | (F.col("_fail") > stop))
            .select(key, stop.alias("stop_round"),
                    F.when(F.col("_done_round").isNotNull(), F.col("_js_done"))
                    .otherwise(F.col("_js_last")).alias("json")))


def decide_novelty(responses: DataFrame, key: str = "item_id", rnd: str = "round", text: str = "text",
                   max_rounds: int = 10) -> DataFrame:
    """First round with a decision wins (novel tested first); default not novel."""
    low = F.lower(F.col(text))
    dec = F.when(F.contains(low, F.lit(NOVEL)), True).when(F.contains(low, F.lit(NOT_NOVEL)), False)
    r = F.col(rnd)
    return (responses.where(r <= max_rounds).select(key, rnd, dec.alias("_d"))
            .groupBy(key).agg(F.coalesce(F.min_by("_d", F.when(F.col("_d").isNotNull(), r)), F.lit(False))
                              .alias("novel")))


def apply_novelty(ideas: DataFrame, decisions: DataFrame, idea_key: str = "seq",
                  key: str = "item_id") -> DataFrame:
    """Ideas that already carry ``novel`` keep it; others take the decision
    (or False when no reply rows exist)."""
    d = decisions.withColumnRenamed("novel", "_decided").withColumnRenamed(key, idea_key)
    return (ideas.join(d, idea_key, "left")
            .withColumn("novel", F.coalesce(F.col("novel"), F.col("_decided"), F.lit(False)))
            .drop("_decided"))


def first_valid(reviews: DataFrame, key: str, idx: str, review: str, meta: DataFrame | None = None,
                meta_col: str = "meta") -> DataFrame:
    """Meta review, or the first valid (non-null) review when it is missing."""
    fb = reviews.groupBy(key).agg(F.min_by(F.col(review), F.when(F.col(review).isNotNull(), F.col(idx)))
                                  .alias("_first"))
    if meta is None:
        return fb.select(key, F.col("_first").alias("review"))
    return (fb.join(meta, key, "left")
            .select(key, F.coalesce(F.col(meta_col), F.col("_first")).alias("review")))


def prefixes(chunks: DataFrame, key: str = "resp_id", order: str = "pos", chunk: str = "chunk",
             strip_token: str = EOT) -> DataFrame:
    """Growing prefixes of the chunk stream per response, token removed."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pre = F.array_join(F.collect_list(F.col(chunk)).over(w), "")
    return chunks.select(key, order, F.replace(pre, F.lit(strip_token), F.lit("")).alias("prefix"))


def assemble(chunks: DataFrame, key: str = "resp_id", order: str = "pos", chunk: str = "chunk",
             sep: str = "", strip_token: str | None = EOT) -> DataFrame:
    """Whole text per response from ordered chunks (final prefix)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(chunk).alias("c"))))
    txt = F.array_join(F.transform(parts, lambda x: x["c"]), sep)
    if strip_token:
        txt = F.replace(txt, F.lit(strip_token), F.lit(""))
    return chunks.groupBy(key).agg(txt.alias("text"))


def join_prefixes(chunks: DataFrame, key: str = "resp_id", order: str = "pos", chunk: str = "chunk",
                  final_only: bool = True) -> DataFrame:
    """``final_only``: last prefix.  Otherwise the compatible form: every
    growing prefix joined by newlines (the text repeats)."""
    if final_only:
        return assemble(chunks, key, order, chunk)
    pre = prefixes(chunks, key, order, chunk)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("prefix").alias("p"))))
    return pre.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("text"))


def messages(df: DataFrame, system: str, user_template: str, text: str = "text") -> Column:
    """system + user chat messages from templates ({paper_text} placeholder)."""
    user = F.replace(F.lit(user_template), F.lit("{paper_text}"), F.col(text))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def history(conv: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """Ordered message history per conversation: array<struct<role, content>>."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"),
                                                 F.col(text).alias("content"))))
    return conv.groupBy(key).agg(
        F.transform(parts, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
        .alias("messages"))


MOST_TURNS = 10_000  # turns of one history


def turn_tree(conv: DataFrame, samples: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
              text: str = "text", sample: str = "sample") -> DataFrame:
    """Turns as a tree (node, parent, key, sample, role, content).

    The turns of ``conv`` are a chain; every row of ``samples`` (key, sample,
    text) is a reply of the assistant to the last of them, so n replies are n
    leaves of one history.  Contents have the nested form ``[{type, text}]``.
    A conversation without samples ends without a leaf; a sample of an unknown
    key is a history of its own."""
    name = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    nested = F.array(F.struct(F.lit("text").alias("type"), F.col(text).alias("text"))).alias("content")
    turns = neighbour(conv.select(key, order, role, text), [key], [order], [order])
    parent = F.when(F.col("prev_" + order).isNotNull(), name(key, "prev_" + order))
    chain = turns.select(name(key, order).alias("node"), parent.alias("parent"), key, F.lit(None).cast(samples.schema[sample].dataType).alias(sample),
                         F.col(role).alias("role"), nested)
    last = conv.groupBy(key).agg(F.max(order).alias("_last"))
    leaf = samples.join(last, key, "left").select(
        F.concat(name(key), F.lit(":sample:"), name(sample)).alias("node"), F.when(F.col("_last").isNotNull(), name(key, "_last")).alias("parent"),
        key, sample, F.lit("assistant").alias("role"), nested)
    return chain.unionByName(leaf)


def histories(tree: DataFrame, leaves: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """(node, messages): the whole history of every leaf (column node) of a
    turn tree, from its root, with plain contents.

    A recursive query walks from all leaves to their parents at once and keeps
    (leaf, node, height), so no text moves before the histories are known;
    each turn is then looked up once per history that it is part of.  Paths
    longer than ``most_turns`` are an error, so a circle cannot go unnoticed."""
    spark = tree.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the rows are those of the result
    walk = spark.sql(f"""
        WITH RECURSIVE up(leaf, node, height) MAX RECURSION LEVEL {int(most_turns)} AS (
          SELECT node, node, 0 FROM {{leaves}}
          UNION ALL
          SELECT up.leaf, t.parent, up.height + 1 FROM up JOIN {{tree}} t ON t.node = up.node WHERE t.parent IS NOT NULL)
        SELECT leaf, node, height FROM up""", leaves=leaves.select("node"), tree=tree.select("node", "parent"))
    turn = F.struct((-F.col("height")).alias("o"), F.col("role"), flatten_content(F.col("content")).alias("content"))
    rows = walk.join(tree.select("node", "role", "content"), "node").groupBy("leaf").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return rows.select(F.col("leaf").alias("node"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
                       .alias("messages"))


def sampled_histories(conv: DataFrame, samples: DataFrame, key: str = "conv_id", sample: str = "sample", **columns: str) -> DataFrame:
    """(key, sample, messages): one history per sampled reply."""
    tree = turn_tree(conv, samples, key=key, sample=sample, **columns)
    leaves = tree.where(F.col(sample).isNotNull()).select("node", key, sample)
    return leaves.join(histories(tree, leaves), "node").select(key, sample, "messages")


def append_turn(msgs: Column, role: str, content: Column, drop_last: bool = False) -> Column:
    base = F.slice(msgs, 1, F.greatest(F.size(msgs) - 1, F.lit(0))) if drop_last else msgs
    return F.concat(base, F.array(F.struct(F.lit(role).alias("role"), content.alias("content"))))


def flatten_content(parts: Column) -> Column:
    """Nested ``[{type, text}]`` content -> plain text."""
    return F.array_join(F.transform(parts, lambda c: c["text"]), "")


def strip_prompt(reply: Column, prompt: Column) -> Column:
    """Remove the prompt prefix from the output by length."""
    return F.substring(reply, F.length(prompt) + 1, F.lit(1 << 30))
