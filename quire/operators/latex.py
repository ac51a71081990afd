"""LaTeX audits: citation keys, embedded bibliography, figures, sections,
missing references and figures, duplicates, bibliography insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the write-up checks.
CITE = r"\\cite[a-z]*\{([^}]*)\}"
BIB = r"(?s)\\begin\{filecontents\}\{references.bib\}(.*?)\\end\{filecontents\}"
FIGURE = r"\\includegraphics.*?\{(.*?)\}"
SECTION = r"\\section\{([^}]*)\}"
BIB_END = "\\end{filecontents}"


def cite_keys(tex: Column) -> Column:
    """All cite keys: every ``\\cite*{...}`` group, split on commas, trimmed."""
    groups = F.regexp_extract_all(tex, F.lit(CITE), 1)
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))),
                       lambda k: F.regexp_replace(k, r"^\s+|\s+$", ""))


def bib_block(tex: Column) -> Column:
    """Embedded references.bib text (first block), NULL when absent."""
    return F.when(tex.rlike(BIB), F.regexp_extract(tex, BIB, 1))


def figures(tex: Column) -> Column:
    return F.regexp_extract_all(tex, F.lit(FIGURE), 1)


def sections(tex: Column) -> Column:
    return F.regexp_extract_all(tex, F.lit(SECTION), 1)


def insert_bib(tex: Column, bib: Column) -> Column:
    """Insert text before every end-of-bibliography marker."""
    return F.replace(tex, F.lit(BIB_END), F.concat(bib, F.lit(BIB_END)))


def missing_cites(docs: DataFrame, key: str = "doc_id", tex: str = "tex") -> DataFrame:
    """Cite keys not found anywhere in the bib text (substring test); documents
    without a bib block are skipped, as the audit stops there."""
    d = docs.select(key, bib_block(F.col(tex)).alias("_bib"), cite_keys(F.col(tex)).alias("_keys"))
    return (d.where(F.col("_bib").isNotNull()).select(key, "_bib", F.explode("_keys").alias("cite"))
            .where(~F.contains(F.col("_bib"), F.col("cite"))).select(key, "cite"))


def missing_figures(docs: DataFrame, files: DataFrame, key: str = "doc_id", tex: str = "tex",
                    file: str = "file") -> DataFrame:
    """Figures used in the text but absent from the document's .png files."""
    used = docs.select(key, F.explode(figures(F.col(tex))).alias(file))
    pngs = files.where(F.col(file).endswith(".png")).select(key, file)
    return used.join(pngs, [key, file], "left_anti")


def duplicates(docs: DataFrame, what: str = "figure", key: str = "doc_id", tex: str = "tex") -> DataFrame:
    """Figure or section names occurring more than once in a document."""
    names = figures(F.col(tex)) if what == "figure" else sections(F.col(tex))
    return (docs.select(key, F.explode(names).alias("name")).groupBy(key, "name")
            .agg(F.count("*").alias("n")).where(F.col("n") > 1))
