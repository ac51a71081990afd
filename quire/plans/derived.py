"""Derived inputs (``D_*``) built from the driver tables.

Each builder is one scan of its source with pruned columns; where the
fixture is a UNION ALL of several SELECTs over the same table we emit it
as one scan plus ``explode``/``unpivot`` instead of several scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import Tables

BS = "\\"


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _opt(cond: Column, text: str) -> Column:
    return F.when(cond, F.concat(F.lit("\n"), F.lit(text))).otherwise(F.lit(""))


def d_papers(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        F.concat(
            F.col("text"),
            _opt(d % 4 != 3, "Method and results [1, 2] in Figure 3. We propose a novel model."),
            _opt(d % 2 == 0, "Abstract"),
            _opt(d % 3 != 1, "Introduction"),
            _opt(d % 5 != 2, "Conclusion"),
            _opt(d % 7 != 3, "References"),
            _opt(d % 11 == 4, "Dear customer"),
            _opt(d % 13 == 5, "Invoice total"),
            _opt(d % 17 == 6, "Chapter 2"),
            _opt(d % 19 == 7, "recipe"),
        ).alias("text"),
    )


def d_clf(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = F.array(
        F.struct(F.lit("scientific article").alias("label"), ((d * 37) % 100).cast("double") / 100),
        F.struct(F.lit("news article").alias("label"), ((d * 53) % 100).cast("double") / 100),
        F.struct(F.lit("blog post").alias("label"), F.lit(0.3).cast("double")),
    )
    return (t.labels.select("doc_id", F.inline(rows))
            .toDF("doc_id", "label", "score"))


def d_responses(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    fence = F.lit("```json")
    ks = _s(k)
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("ok"), F.lit("\n"), fence, F.lit("\n"), F.lit('{"Name": "idea_'), ks,
                                    F.lit('", "Novelty": '), _s(k % 10 + 1), F.lit("}"), F.lit("\n"), F.lit("```")))
        .when(k % 6 == 1, F.concat(F.lit("two"), F.lit("\n"), fence, F.lit("\n"), F.lit("{bad}"), F.lit("\n"), F.lit("```"), F.lit("\n"),
                                   fence, F.lit("\n"), F.lit('{"Name": "second_'), ks, F.lit('"}'), F.lit("\n"), F.lit("```")))
        .when(k % 6 == 2, F.concat(F.lit('bare {"Name": "bare_'), ks, F.lit('"} end')))
        .when(k % 6 == 3, F.lit("nothing to parse"))
        .when(k % 6 == 4, F.concat(F.lit("I am done"), F.lit("\n"), fence, F.lit("\n"), F.lit('{"Name": "done_'), ks,
                                   F.lit('"}'), F.lit("\n"), F.lit("```")))
        .otherwise(F.when(F.floor(k / 6) % 2 == 0, F.lit("Decision made: novel."))
                   .otherwise(F.lit("Decision made: not novel.")))
    )
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("item_id"),
        F.row_number().over(w).cast("int").alias("round"),
        F.concat(F.lit("THOUGHT:"), F.lit("\n"), text).alias("text"),
    )


def d_reviews(t: Tables) -> DataFrame:
    q = BS + '"'
    size = F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("paper_id"),
        F.concat(
            F.lit('{"review": "{' + q + "Overall" + q + ": "), _s(size % 10 + 1),
            F.lit(", " + q + "Decision" + q + ": " + q),
            F.when(size % 10 >= 5, F.lit("Accept")).otherwise(F.lit("Reject")),
            F.lit(q + ", " + q + "Strengths" + q + ": [" + q + "clear" + q + ']}"}'),
        ).alias("raw"),
    )


def d_scores(t: Tables) -> DataFrame:
    """Dealt by paper into parts of bounded size, so that aggregations and
    windows by paper (and field) need no other shuffle and no larger task."""
    wide = t.dealt("lineitem", "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.col("l_quantity").cast("int")).alias("Overall"),
        F.min((F.col("l_partkey") % 8).cast("int")).alias("Confidence"),
        F.min((F.col("l_suppkey") % 6).cast("int")).alias("Soundness"),
    )
    long = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("score")) for f in ("Overall", "Confidence", "Soundness")]))
    return wide.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("reviewer"), long)


def d_review_md(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    ds = _s(d)
    return t.documents.select(
        "doc_id",
        F.concat(
            F.lit("# Review\n## Summary\n- not collected\n## Weaknesses\n- w"), ds,
            F.lit("\n  * indented\n**bold** start\n-\nplain line\n"),
            F.when(d % 3 == 0, F.concat(F.lit("## Suggestions for improvement\n- s"), ds, F.lit("\n")))
            .otherwise(F.lit("## Questions\n- q\n")),
            F.when(d % 4 == 0, F.concat(F.lit("## Rating\n"), _s(d % 10), F.lit(": accept")))
            .when(d % 4 == 1, F.concat(F.lit("Overall rating: "), _s(d % 11), F.lit("/10")))
            .when(d % 4 == 2, F.concat(F.lit("We give "), _s(d % 11), F.lit("/10")))
            .otherwise(F.lit("no number")),
        ).alias("review"),
    )


def d_latex(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    bib = (BS + "begin{filecontents}{references.bib}\n@article{k1, title={A}}\n"
           "@article{k2, title={B}}\n" + BS + "end{filecontents}\n")
    return t.part.select(
        F.col("p_partkey").alias("doc_id"),
        F.concat(
            F.when(k % 9 != 8, F.lit(bib)).otherwise(F.lit("")),
            F.lit(BS + "section{Introduction}\nSee " + BS + "cite{k1, k"), _s(k % 4),
            F.lit("} and " + BS + "citep{k2}.\n" + BS + "includegraphics[width=1]{f"), _s(k % 3),
            F.lit(".png}\n"),
            F.when(k % 5 == 0, F.lit(BS + "section{Introduction}\n"))
            .otherwise(F.lit(BS + "section{Results}\n")),
            F.lit(BS + "includegraphics{f1.png}\n"),
        ).alias("tex"),
    )


def d_files(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    files = F.array(
        F.lit("f1.png"),
        F.when(F.col("p_size") % 2 == 0, F.lit("f2.png")),
        F.concat(_s(k % 3), F.lit("_"), _s(k), F.lit(".txt")),
    )
    return (t.part.select(k.alias("doc_id"), F.explode(files).alias("file"))
            .where(F.col("file").isNotNull()))


def d_runs(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.groupBy(
        F.concat(F.lit("run_"), _s(F.col("l_suppkey") % 4)).alias("run"),
        F.col("l_returnflag").alias("dataset"),
        (F.col("l_linenumber") % 3).cast("int").alias("seed"),
        (F.col("l_orderkey") % 50).cast("int").alias("step"),
    ).agg(
        F.min("l_extendedprice").alias("val_loss"),
        F.max("l_discount").alias("val_acc"),
    ).withColumn("phase", F.when(F.col("step") < 20, F.lit("full1")).otherwise(F.lit("partial")))


def d_attempts(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("user_id").alias("idea_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0).alias("ok"),
    )


def d_grid(t: Tables) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return (t.events.groupBy(F.col("user_id").alias("cell"), day.alias("day"))
            .agg(F.max("value").alias("value")))


def d_scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "n_chars")
    return t.labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"),
        ((F.col("n_chars") % 97).cast("double") / 97).alias("score"),
    )


def d_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id", F.col("label").alias("layer"), F.posexplode("embedding").alias("pos", "x"),
    ).select("vec_id", "layer", "pos", F.col("x").cast("double").alias("x"))


def d_points(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("mol"), F.col("l_linenumber").alias("atom")).agg(
        F.min("l_quantity").alias("x"),
        (F.min("l_discount") * 100).alias("y"),
        (F.min("l_tax") * 100).alias("z"),
    )


def d_frames(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("mol"), F.col("l_linenumber").alias("atom"),
        (F.col("l_orderkey") % 20).cast("int").alias("frame"),
    ).agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"), F.min("l_tax").alias("z"))


def d_rays(t: Tables) -> DataFrame:
    k = F.col("l_orderkey")
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.col("l_suppkey") % 10).alias("scene"),
        ((F.min("l_quantity") - 25) / 10).alias("ox"),
        (F.min(F.col("l_partkey") % 7) - 3).cast("double").alias("oy"),
        F.min("l_discount").alias("_disc"),
    ).select(
        (k * 10 + F.col("l_linenumber")).alias("ray"), "scene", "ox", "oy",
        F.lit(-4.0).alias("oz"), (k % 5 - 2).cast("double").alias("dx"),
        (F.col("_disc") - 0.05).alias("dy"), F.lit(1.0).alias("dz"),
    )


def d_poses(t: Tables) -> DataFrame:
    a = F.col("s_suppkey") / 7.0
    return t.supplier.select(
        F.col("s_suppkey").alias("frame"), F.cos(a).alias("r00"), (-F.sin(a)).alias("r01"),
        F.sin(a).alias("r10"), F.cos(a).alias("r11"), (F.col("s_acctbal") / 1000).alias("tx"),
        F.col("s_nationkey").cast("double").alias("ty"),
    )


def d_gridpix(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(
        (F.col("l_suppkey") % 5).alias("img"),
        (F.col("l_orderkey") % 16).cast("int").alias("r"),
        (F.col("l_partkey") % 16).cast("int").alias("c"),
    ).agg(F.min("l_quantity").alias("v"))


def d_archive(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("seq"), F.concat(F.lit("idea_"), _s(k % 1900)).alias("name"),
        F.col("p_name").alias("title"), F.col("p_type").alias("experiment"),
        (F.col("p_size") % 10 + 1).cast("int").alias("interestingness"),
        (k % 10 + 1).cast("int").alias("feasibility"),
        ((k * 7) % 10 + 1).cast("int").alias("novelty"),
        F.when(k % 6 == 0, F.lit(None).cast("boolean")).otherwise(F.col("p_size") % 4 != 0).alias("novel"),
    )


def d_chunks(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("resp_id"), F.col("turn").alias("pos"),
        F.concat("text", F.when(F.col("role") == "assistant", F.lit("<|eot_id|>")).otherwise(F.lit("")))
        .alias("chunk"),
    )
