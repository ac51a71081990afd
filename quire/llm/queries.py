"""The registered queries of the subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import (
    ann_partitions,
    budget_mix,
    chat_masks,
    decontaminate,
    ef_trie_lm,
    hard_negatives,
    kn_quality,
    license_scan,
    line_runs,
    simhash_trie,
    site_style,
    spelling,
    token_files,
)
from quire.session import ensure_checkpoint_dir, ship_package
from quire.sources.tables import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MIX_WEIGHTS = [(0, "web", 6.0), (0, "reference", 4.0), (1, "en", 50.0), (1, "de", 20.0), (1, "fr", 20.0),
               (1, "es", 10.0), (2, "src0", 2.0)]
MIX_SHARE, MIX_EPOCHS, MIX_SEED, MIX_DEFAULT = 0.5, 4, 17, 1.0


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@query
def op2_simhash_trie(spark, sf_dir):
    """Near-duplicate groups of all documents (3-word shingles, 3 bits)."""
    return simhash_trie.near_groups(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def mix_levels():
    """Domain (numbered sources 0-9 are web, the rest reference), language, source."""
    return [("domain", F.when(F.col("source").rlike("^src[0-9]$"), "web").otherwise("reference")),
            ("lang", F.col("lang")), ("source", F.col("source"))]


def mix_weights(spark):
    return spark.createDataFrame(MIX_WEIGHTS, "level int, name string, weight double")


@query
def op4_budget_mix(spark, sf_dir):
    """Copies of documents that a mix of half of all tokens takes."""
    got = budget_mix.select_copies(read_table(spark, sf_dir, "documents"), mix_levels(), mix_weights(spark),
                                   budget_share=MIX_SHARE, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return got.select(F.col("id").alias("doc_id"), F.col("l_0").alias("domain"), F.col("l_1").alias("lang"),
                      F.col("l_2").alias("source"), F.col("tokens").alias("n_tokens"), "copies")


def _mix_oracle() -> str:
    values = ", ".join(f"({a}, '{b}', {c:.1f}::double)" for a, b, c in MIX_WEIGHTS)
    parts, cols = [], ["domain", "lang", "source"]
    for i in range(3):
        by = ", ".join(f"n.{c}" for c in cols[:i + 1])
        up = f"join b{i - 1} u on " + " and ".join(f"n.{c} is not distinct from u.{c}" for c in cols[:i]) if i else "cross join root u"
        part = "partition by " + ", ".join(cols[:i]) if i else ""
        order = f"order by cap / w, {', '.join(cols[:i + 1])}"
        parts.append(f"""n{i} as (select {by}, sum(n.cap) as cap from leaves n group by {by}),
  w{i} as (select {by}, n.cap, coalesce(w.weight, {MIX_DEFAULT}::double) as w, u.got as have
     from n{i} n left join weights w on w.level = {i} and n.{cols[i]} = w.name {up}),
  f{i} as (select *, coalesce(sum(cap) over ({part} {order} rows between unbounded preceding and 1 preceding), 0) as full_,
     sum(w) over ({part}) - coalesce(sum(w) over ({part} {order} rows between unbounded preceding and 1 preceding), 0) as rest from w{i}),
  v{i} as (select *, case when cap >= w * ((have - full_) / rest) then (have - full_) / rest end as lev from f{i}),
  x{i} as (select *, row_number() over ({part} {order}) as k from v{i}),
  y{i} as (select *, min(case when lev is not null then k end) over ({part}) as k0 from x{i}),
  z{i} as (select *, max(case when k = k0 then lev end) over ({part}) as lev0 from y{i}),
  b{i} as (select {', '.join(cols[:i + 1])}, case when k0 is null or k < k0 then cap else least(cap, w * lev0) end as got from z{i})""")
    return f"""with weights(level, name, weight) as (values {values}),
  d as (select doc_id, case when regexp_matches(source, '^src[0-9]$') then 'web' else 'reference' end as domain, lang, source,
     coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as tokens, md5(coalesce(text, '')) as tm from documents),
  leaves as (select domain, lang, source, sum(tokens)::bigint as tokens, (sum(tokens) * {MIX_EPOCHS})::double as cap
     from d group by all),
  root as (select sum(tokens)::double * {MIX_SHARE}::double as got from leaves),
  {', '.join(parts)},
  plan as (select l.domain, l.lang, l.source, case when l.tokens > 0 then (floor(got)::bigint // l.tokens) else 0 end as whole,
     case when l.tokens > 0 then floor(got)::bigint % l.tokens else 0 end as part
     from leaves l join b2 b on l.domain is not distinct from b.domain and l.lang is not distinct from b.lang and l.source is not distinct from b.source),
  p as (select d.*, whole, part, md5('{MIX_SEED}|' || whole::varchar || '|' || coalesce(doc_id::varchar, '') || '|' || tm) as k
     from d join plan q on d.domain is not distinct from q.domain and d.lang is not distinct from q.lang and d.source is not distinct from q.source),
  c as (select *, whole + (sum(tokens) over (partition by domain, lang, source order by k range between unbounded preceding and current row) <= part)::int as copies from p)
select doc_id, domain, lang, source, tokens as n_tokens, copies::int as copies from c where copies > 0"""


ORACLES["op4_budget_mix"] = _mix_oracle()


@query
def op5_decontaminate(spark, sf_dir):
    """Documents that hold benchmark passages, with item, score and place."""
    found = decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", "first_word", "last_word")


@query
def op7_kn_quality(spark, sf_dir):
    """Perplexity, language limits and decision for all documents."""
    return kn_quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op9_line_runs(spark, sf_dir):
    """All documents with later copies of repeated line runs (50 words or more) deleted."""
    out = line_runs.drop_repeats(read_table(spark, sf_dir, "documents"), min_words=50)
    return out.select("doc_id", "text", F.col("__deleted").alias("n_deleted"))


@query
def op1_learned_partitions(spark, sf_dir):
    """20 nearest vectors of every vector whose id is divisible by 20."""
    return ann_partitions.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


CONTROL_CASE = "</s>[INST] ok [/INST]"


@query
def op3_chat_masks(spark, sf_dir):
    """Formatted conversations with loss masks, as digests read back from the output."""
    cols = ["conv_id", "turn", "role", "text"]
    case = spark.createDataFrame([(-1, 0, "user", CONTROL_CASE), (-1, 1, "assistant", CONTROL_CASE)],
                                 "conv_id long, turn long, role string, text string")
    talks = read_table(spark, sf_dir, "conversations").select(*cols).unionByName(case)
    return chat_masks.digests(chat_masks.format_conversations(talks))


@query
def op6_license_scan(spark, sf_dir):
    """License phrases and fuzzy notices of all documents."""
    return license_scan.scan(read_table(spark, sf_dir, "documents")).drop("spans")


@query
def op8_ef_trie_lm(spark, sf_dir):
    """Log probabilities of all documents under the Elias-Fano bigram model."""
    return ef_trie_lm.score(read_table(spark, sf_dir, "documents"))


@query
def op10_site_style(spark, sf_dir):
    """Main text of all pages."""
    return site_style.extract(read_table(spark, sf_dir, "pages"))


@query
def op11_token_files(spark, sf_dir):
    """All documents as range-coded token blocks, digests read back from them."""
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    ids = token_files.encode_texts(docs, token_files.TOKENIZER, end_id=0)
    vocab = token_files.vocabulary(token_files.TOKENIZER)
    got = token_files.digests(token_files.write(ids, vocab), vocab)
    return got.select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


@query
def op12_trie_frontier(spark, sf_dir):
    """Words of all documents, with the words one edit apart and their forms."""
    counts = spelling.word_counts(read_table(spark, sf_dir, "documents"), least_length=7, least_count=2, damage_every=31)
    return spelling.variants(counts, least_length=7, ratio=10)


@query
def op13_bond_negatives(spark, sf_dir):
    """Hard negatives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.prepare(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, k_positive=5, k_negative=10, least_percent=30, most_percent=90)


ORACLES["op13_bond_negatives"] = """with e as (
  select vec_id as id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
     list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
     and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
  s as (select a.id as anchor_id, b.id, a.label = b.label as same,
     list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
     from e a join e b on a.id <> b.id and len(a.v) = len(b.v) where a.id % 100 = 0),
  p as (select anchor_id, id as positive_id, score as positive_score from s where same
     qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, row_number() over w as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)
qualify row_number() over w <= 10"""
