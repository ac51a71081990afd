"""Idea archives: append, pending/novel filters, name matching, record
formatting (authors, venue, abstract) and prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.joins import contains_join


def append(seeds: DataFrame, generated: DataFrame, seq: str = "seq", allow_missing: bool = True) -> DataFrame:
    """Archive = seeds followed by generated ideas (UNION ALL, duplicates kept).

    The generated ``seq`` is offset past the last seed so order survives."""
    offset = F.coalesce(seeds.agg(F.max(seq)).scalar(), F.lit(0))  # lazy scalar subquery
    gen = generated.withColumn(seq, F.col(seq) + offset)
    return seeds.unionByName(gen, allowMissingColumns=allow_missing)


def duplicate_names(archive: DataFrame, name: str = "name") -> DataFrame:
    return archive.groupBy(name).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def novel_only(ideas: DataFrame, novel: str = "novel", strict: bool = False) -> DataFrame:
    """Keep novel ideas; ``strict`` raises when some idea has no verdict
    (the reference fails on a missing key)."""
    if strict:
        missing = ideas.where(F.col(novel).isNull()).limit(1).count()
        if missing:
            raise ValueError("idea without a novelty verdict")
    return ideas.where(F.col(novel))


def pending(ideas: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Ideas without a decision yet (resume)."""
    return ideas.join(decisions.select(key), key, "left_anti")


def match_by_name(folders: DataFrame, folder: str, ideas: DataFrame, name: str = "name",
                  seq: str = "seq") -> DataFrame:
    """First archive idea (lowest ``seq``) whose name occurs in the folder name;
    folders without a match are returned with NULLs (the reference errors).
    Only the first idea of each name is matched."""
    named = ideas.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(seq).alias(seq))
    hits = contains_join(folders.select(folder), folder, named.select(seq, name), name)
    first = hits.groupBy(folder).agg(F.min_by(F.struct(F.col(seq), F.col(name)), F.col(seq)).alias("_m"))
    return (folders.select(folder).join(first, folder, "left")
            .select(folder, F.col("_m")[seq].alias(seq), F.col("_m")[name].alias(name)))


def format_authors(arr: Column, limit: int = 20) -> Column:
    """' and '-joined when fewer than ``limit`` names, else 'first et al.'."""
    return F.when(F.size(arr) < limit, F.array_join(arr, " and ")).otherwise(
        F.concat(F.element_at(arr, 1), F.lit(" et al.")))


def pick_venue(locations: Column) -> Column:
    """Walk locations: take the source name of each location that has a
    source, stop at the first non-empty one; 'Unknown' when none has one."""
    init = F.struct(F.lit("Unknown").alias("venue"), F.lit(False).alias("stop"))
    folded = F.aggregate(
        locations, init,
        lambda acc, loc: F.when(acc["stop"] | loc["source"].isNull(), acc).otherwise(
            F.struct(loc["source"]["display_name"].alias("venue"),
                     (loc["source"]["display_name"] != "").alias("stop"))))
    return folded["venue"]


def clip_abstract(c: Column, n: int = 1000) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def idea_json(name: Column, title: Column, experiment: Column, i: Column, f: Column, n: Column) -> Column:
    """Idea as JSON text in the archive's key order (json.dumps layout)."""
    def q(c):
        return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    return F.concat(F.lit('{"Name": '), q(name), F.lit(', "Title": '), q(title), F.lit(', "Experiment": '),
                    q(experiment), F.lit(', "Interestingness": '), i.cast("string"), F.lit(', "Feasibility": '),
                    f.cast("string"), F.lit(', "Novelty": '), n.cast("string"), F.lit("}"))


def prompts(ideas: DataFrame, group: str, seq: str, idea_text: str, template: str) -> DataFrame:
    """One prompt per group: ``template`` with ``{prev_ideas_string}`` replaced
    by the group's ideas joined by blank lines in archive order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(idea_text).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda x: x["t"]), "\n\n")
    return ideas.groupBy(group).agg(
        F.replace(F.lit(template), F.lit("{prev_ideas_string}"), joined).alias("prompt"))
