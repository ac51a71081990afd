"""Literature retrieval re-aimed at a corpus table: TF-IDF top documents per
query, the best citation, result blocks, and unification of two record
layouts into one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-cased word terms (letters and digits)."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return (df.select(key, F.explode(terms(F.col(text))).alias("term"))
            .groupBy(key, "term").agg(F.count("*").alias("tf")))


BLOCK_DOCS = 32       # documents of a posting block
SEED_BLOCKS = 16      # blocks scored first for a query, the best-bounded ones
HOT_BLOCKS = 4096     # blocks of a term under one salt


class BlockIndex:
    """Posting table in blocks of documents of similar length, with the
    greatest count of each term in each block.

    A document's class is its length on a log scale; a class is cut into
    blocks of about ``BLOCK_DOCS`` documents by a hash of the key.  Scores grow
    with length, so blocks of short documents have low bounds."""

    def __init__(self, docs: DataFrame, dkey: str, dtext: str, vocabulary: DataFrame):
        size = F.floor(F.log2(F.length(dtext) + 1) * 6).cast("int").alias("_class")
        classes = docs.select(size).where("_class is not null").groupBy("_class").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("_n"))
        block = F.struct("_class", F.pmod(F.xxhash64(dkey), F.col("_n")).alias("_part")).alias("block")
        member = docs.select(dkey, dtext, size).join(F.broadcast(classes), "_class")  # some 6 rows per doubling of length
        words = member.select(dkey, block, F.explode(terms(F.col(dtext))).alias("term")).join(vocabulary, "term", "left_semi")
        self.dkey = dkey
        self.postings = written(words.groupBy("block", "term", dkey).agg(F.count("*").alias("tf")), "postings")
        self.tops = written(self.postings.groupBy("term", "block").agg(F.max("tf").alias("top"), F.count("*").alias("n")), "posting-tops")
        self.terms = self.tops.groupBy("term").agg(F.sum("n").alias("df"), F.ceil(F.count("*") / HOT_BLOCKS).alias("salts"))

    def bounds(self, weights: DataFrame, qkey: str) -> DataFrame:
        """(query, block, bound): no document of the block scores more.  A term
        in very many blocks meets the queries in several salts."""
        tops = self.tops.join(self.terms.select("term", "salts"), "term") \
            .withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")))
        salted = weights.join(self.terms.select("term", "salts"), "term") \
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        met = salted.select(qkey, "term", "salt", "w").join(tops, ["term", "salt"])
        return met.groupBy(qkey, "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))

    def scores(self, chosen: DataFrame, weights: DataFrame, qkey: str) -> DataFrame:
        """(query, document, score) for all documents with a shared term in
        the chosen (query, block) pairs."""
        asked = chosen.select(qkey, "block").join(weights, qkey)
        met = asked.join(self.postings, ["block", "term"])
        return met.groupBy(qkey, self.dkey).agg(F.sum(F.col("w") * F.col("tf")).alias("score"))


def survivors(index: BlockIndex, weights: DataFrame, qkey: str, n: int, slack: float) -> DataFrame:
    """(query, block) pairs that may hold one of the query's best ``n``.

    The ``n``-th best score over the best-bounded blocks is a lower limit for
    the final ``n``-th score, so a block whose bound stays below it has no part
    in the result.  Queries with fewer than ``n`` scores so far keep all."""
    bounds = written(index.bounds(weights, qkey), "block-bounds")
    best = Window.partitionBy(qkey).orderBy(F.desc("bound"), "block")
    seeds = bounds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= SEED_BLOCKS)
    nth = Window.partitionBy(qkey).orderBy(F.desc("score"))
    limit = index.scores(seeds, weights, qkey).withColumn("_r", F.row_number().over(nth)).where(F.col("_r") == n) \
        .select(qkey, F.col("score").alias("_least"))
    least = F.coalesce(F.col("_least") - F.abs("_least") * 1e-9 - slack, F.lit(float("-inf")))
    return bounds.join(limit, qkey, "left").where(F.col("bound") >= least).select(qkey, "block")


def top_documents(queries: DataFrame, qkey: str, qtext: str, docs: DataFrame, dkey: str, dtext: str,
                  n: int = 10, rounding: int | None = None) -> DataFrame:
    """Top ``n`` documents per query by Σ tf_q · tf_d · idf over shared terms,
    idf = ln(N / df); ties by document key (scores compared after rounding to
    ``rounding`` digits when given, so summation order cannot reorder
    near-ties).  Queries with no terms or no hit produce no rows (NULL result
    in the reference).

    Exact block-max pruning: every (query, block of documents) gets an upper
    bound from the block's greatest counts, and only blocks that can reach the
    ``n`` best are scored (``survivors``)."""
    n_docs = docs.agg(F.count("*")).scalar()  # lazy scalar subquery
    qt = written(term_counts(queries, qkey, qtext).withColumnRenamed("tf", "qtf"), "query-terms")
    index = BlockIndex(docs, dkey, dtext, qt.select("term").distinct())  # only query terms can score
    weights = written(qt.join(index.terms, "term").select(
        qkey, "term", (F.col("qtf") * F.log(n_docs.cast("double") / F.col("df"))).alias("w")), "query-weights")
    chosen = survivors(index, weights, qkey, n, 0.0 if rounding is None else 10.0 ** -rounding)
    scored = index.scores(chosen, weights, qkey)
    rank_score = F.round("score", rounding) if rounding is not None else F.col("score")
    w = Window.partitionBy(qkey).orderBy(rank_score.desc(), F.col(dkey))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_citation(hits: DataFrame, qkey: str, bibtex: str, abstract: str, max_bib: int = 50000,
                  max_abs: int = 1000) -> DataFrame:
    """Top-1 hit per query; stop (NULL prompt parts) without a bibtex entry;
    bibtex cut at ``max_bib``, abstract at ``max_abs`` characters."""
    top = hits.where(F.col("rank") == 1)
    has = F.col(bibtex).isNotNull()
    return top.select(qkey, "rank", has.alias("has_bibtex"),
                      F.when(has, F.substring(F.col(bibtex), 1, max_bib)).alias("bibtex"),
                      F.when(has, F.substring(F.coalesce(F.col(abstract), F.lit("")), 1, max_abs)).alias("abstract"))


def result_block(hits: DataFrame, qkey: str, order: str, title: str, authors: str, venue: str, year: str,
                 cites: str, abstract: str) -> DataFrame:
    """Per query: ``{i}: {title}. {authors}. {venue}, {year}.\\nNumber of
    citations: {cites}\\nAbstract: {abstract}`` (i from 0) joined by blank lines."""
    i = (F.col(order) - 1).cast("string")
    block = F.concat(i, F.lit(": "), F.col(title), F.lit(". "), F.col(authors), F.lit(". "), F.col(venue),
                     F.lit(", "), F.col(year).cast("string"), F.lit(".\nNumber of citations: "),
                     F.col(cites).cast("string"), F.lit("\nAbstract: "), F.col(abstract))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return hits.groupBy(qkey).agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias("papers"))


ENGINE1 = ("title string, authors array<struct<name string>>, venue string, year int, abstract string, "
           "citationStyles struct<bibtex string>, citationCount int")
ENGINE2 = "title string, authors string, venue string, year int, abstract string, citationCount int"


def unify(engine_1: DataFrame, engine_2: DataFrame, rec1: str = "rec", rec2: str = "rec") -> DataFrame:
    """Two provider layouts -> one schema (authors as text, bibtex nullable)."""
    from quire.operators.archive import format_authors

    a = engine_1.select(
        F.lit("engine_1").alias("engine"), F.col(f"{rec1}.title").alias("title"),
        format_authors(F.transform(F.col(f"{rec1}.authors"), lambda x: x["name"])).alias("authors"),
        F.col(f"{rec1}.venue").alias("venue"), F.col(f"{rec1}.year").alias("year"),
        F.col(f"{rec1}.abstract").alias("abstract"), F.col(f"{rec1}.citationCount").alias("citationCount"),
        F.col(f"{rec1}.citationStyles.bibtex").alias("bibtex"))
    b = engine_2.select(
        F.lit("engine_2").alias("engine"), F.col(f"{rec2}.title").alias("title"),
        F.col(f"{rec2}.authors").alias("authors"), F.col(f"{rec2}.venue").alias("venue"),
        F.col(f"{rec2}.year").alias("year"), F.col(f"{rec2}.abstract").alias("abstract"),
        F.col(f"{rec2}.citationCount").alias("citationCount"), F.lit(None).cast("string").alias("bibtex"))
    return a.unionByName(b)
