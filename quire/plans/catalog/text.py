"""Archive, LaTeX and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fmt import r6
from quire.operators import archive as AR
from quire.operators import latex as LX
from quire.operators import replies as RP
from quire.operators import retrieval as RT
from quire.plans import derived as D
from quire.plans.registry import query

# ------------------------------------------------------------------- LaTeX

CITE_KEYS_SQL = (f"list_transform(flatten(list_transform(regexp_extract_all(tex, '{LX.CITE}', 1), "
                 "lambda g: string_split(g, ','))), lambda k: regexp_replace(k, '^\\s+|\\s+$', '', 'g'))")
BIB_SQL = f"case when regexp_matches(tex, '{LX.BIB}') then regexp_extract(tex, '{LX.BIB}', 1) end"


@query("sc9_cite_keys", f"select doc_id, array_to_string({CITE_KEYS_SQL}, '|') as cite_keys from d_latex", ("d_latex",))
def sc9(t):
    return D.d_latex(t).select("doc_id", F.array_join(LX.cite_keys(F.col("tex")), "|").alias("cite_keys"))


@query("sc10_bib_block", f"select doc_id, md5({BIB_SQL}) as bib_md5 from d_latex", ("d_latex",))
def sc10(t):
    return D.d_latex(t).select("doc_id", F.md5(LX.bib_block(F.col("tex"))).alias("bib_md5"))


@query("sc11_insert_bib", """
select doc_id, md5(replace(tex, chr(92) || 'end{filecontents}', '@article{k9, title={Z}}' || chr(10) || chr(92) || 'end{filecontents}')) as tex_md5
from d_latex""", ("d_latex",))
def sc11(t):
    out = LX.insert_bib(F.col("tex"), F.lit("@article{k9, title={Z}}\n"))
    return D.d_latex(t).select("doc_id", F.md5(out).alias("tex_md5"))


@query("sc12_figures_sections", f"""
select doc_id, array_to_string(regexp_extract_all(tex, '{LX.FIGURE}', 1), '|') as figures,
       array_to_string(regexp_extract_all(tex, '{LX.SECTION}', 1), '|') as sections from d_latex""", ("d_latex",))
def sc12(t):
    tex = F.col("tex")
    return D.d_latex(t).select("doc_id", F.array_join(LX.figures(tex), "|").alias("figures"),
                               F.array_join(LX.sections(tex), "|").alias("sections"))


@query("jn4_missing_figures", f"""
select u.doc_id, u.file from (select doc_id, unnest(regexp_extract_all(tex, '{LX.FIGURE}', 1)) as file from d_latex) u
anti join (select doc_id, file from d_files where ends_with(file, '.png')) f on u.doc_id = f.doc_id and u.file = f.file""",
       ("d_latex", "d_files"))
def jn4(t):
    return LX.missing_figures(D.d_latex(t), D.d_files(t))


@query("jn5_missing_cites", f"""
select doc_id, cite from (select doc_id, bib, unnest(keys) as cite from (
  select doc_id, {BIB_SQL} as bib, {CITE_KEYS_SQL} as keys from d_latex) where bib is not null)
where not contains(bib, cite)""", ("d_latex",))
def jn5(t):
    return LX.missing_cites(D.d_latex(t))


@query("ag30_duplicate_figures", f"""
select doc_id, name, count(*) as n from (select doc_id, unnest(regexp_extract_all(tex, '{LX.FIGURE}', 1)) as name from d_latex)
group by doc_id, name having count(*) > 1""", ("d_latex",))
def ag30f(t):
    return LX.duplicates(D.d_latex(t), "figure")


@query("ag30_duplicate_sections", f"""
select doc_id, name, count(*) as n from (select doc_id, unnest(regexp_extract_all(tex, '{LX.SECTION}', 1)) as name from d_latex)
group by doc_id, name having count(*) > 1""", ("d_latex",))
def ag30s(t):
    return LX.duplicates(D.d_latex(t), "section")


# ----------------------------------------------------------------- archive


@query("st1_archive_append", """
select seq, name from d_archive where seq <= 1000 union all select seq, name from d_archive where seq > 1000""",
       ("d_archive",))
def st1(t):
    a = D.d_archive(t)
    seeds = a.where(F.col("seq") <= 1000).select("seq", "name")
    gen = a.where(F.col("seq") > 1000).select((F.col("seq") - 1000).alias("seq"), "name")
    return AR.append(seeds, gen)


@query("st1_duplicate_names", "select name, count(*) as n from d_archive group by name having count(*) > 1",
       ("d_archive",))
def st1d(t):
    return AR.duplicate_names(D.d_archive(t))


@query("st2_append_with_extra_column", """
select seq, name, null::integer as score from d_archive where seq <= 1000
union all select seq, name, novelty * 10 as score from d_archive where seq > 1000""", ("d_archive",))
def st2(t):
    a = D.d_archive(t)
    seeds = a.where(F.col("seq") <= 1000).select("seq", "name")
    gen = a.where(F.col("seq") > 1000).select((F.col("seq") - 1000).alias("seq"), "name",
                                               (F.col("novelty") * 10).alias("score"))
    return AR.append(seeds, gen).select("seq", "name", "score")


DECIDED_SQL = """decided AS (select distinct item_id as seq from d_responses
   where contains(lower(text), 'decision made: novel') or contains(lower(text), 'decision made: not novel'))"""


@query("jn17_pending_ideas", f"""
WITH {DECIDED_SQL}
select a.seq, a.name from d_archive a anti join decided d on a.seq = d.seq""", ("d_archive", "d_responses"))
def jn17(t):
    m = RP.markers(D.d_responses(t))
    decided = m.where(F.col("decision").isNotNull()).select(F.col("item_id").alias("seq")).distinct()
    return AR.pending(D.d_archive(t), decided, "seq").select("seq", "name")


@query("pf8_novel_only", """
WITH d AS (select item_id, dec from (select item_id, round, case when contains(lower(text), 'decision made: novel') then true
                                       when contains(lower(text), 'decision made: not novel') then false end as dec
           from d_responses where round <= 10) where dec is not null qualify row_number() over (partition by item_id order by round) = 1)
select a.seq, a.name from d_archive a left join d on a.seq = d.item_id where coalesce(a.novel, d.dec, false)""",
       ("d_archive", "d_responses"))
def pf8(t):
    dec = RP.decide_novelty(D.d_responses(t))
    ideas = RP.apply_novelty(D.d_archive(t), dec)
    return AR.novel_only(ideas, strict=True).select("seq", "name")


FOLDERS_SQL = """folders AS (select distinct strftime(o_orderdate, '%Y%m%d') || '_idea_' || cast(o_orderkey % 2500 as varchar) as folder
   from orders)"""


def _folders(t):
    o = t.orders
    return o.select(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_idea_"),
                             (F.col("o_orderkey") % 2500).cast("string")).alias("folder")).distinct()


@query("jn6_match_idea_by_name", f"""
WITH {FOLDERS_SQL},
m AS (select f.folder, min(a.seq) as seq from folders f join d_archive a on contains(f.folder, a.name) group by f.folder)
select f.folder, m.seq, a.name from folders f left join m on f.folder = m.folder left join d_archive a on a.seq = m.seq""",
       ("d_archive",))
def jn6(t):
    return AR.match_by_name(_folders(t), "folder", D.d_archive(t).select("seq", "name"))


def _authors(t):
    words = F.split(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_type", "p_name"), " ")
    return F.slice(words, 1, F.col("p_size"))


@query("sc5_format_authors", """
select p_partkey, case when len(a) < 20 then array_to_string(a, ' and ') else a[1] || ' et al.' end as authors from (
  select p_partkey, string_split(concat_ws(' ', p_name, p_type, p_name, p_type, p_name), ' ')[1:p_size] as a from part)""")
def sc5(t):
    return t.part.select("p_partkey", AR.format_authors(_authors(t)).alias("authors"))


def _locations():
    s = F.col("p_size")
    src = lambda cond, name: F.when(cond, F.struct(name.alias("display_name")))
    return F.array(
        F.struct(src(s % 3 != 0, F.when(s % 4 == 0, F.lit("")).otherwise(F.col("p_brand"))).alias("source")),
        F.struct(src(s % 5 != 0, F.when(s % 7 == 0, F.lit("")).otherwise(F.col("p_type"))).alias("source")),
        F.struct(src(s % 2 == 0, F.lit("")).alias("source")))


@query("sc6_pick_venue", """
WITH l AS (select p_partkey, [
    {'source': case when p_size % 3 <> 0 then {'display_name': case when p_size % 4 = 0 then '' else p_brand end} end},
    {'source': case when p_size % 5 <> 0 then {'display_name': case when p_size % 7 = 0 then '' else p_type end} end},
    {'source': case when p_size % 2 = 0 then {'display_name': ''} end}] as locs from part)
select p_partkey, coalesce(list_filter(locs, lambda x: x.source is not null and x.source.display_name <> '')[1].source.display_name,
                           case when len(list_filter(locs, lambda x: x.source is not null)) > 0 then '' else 'Unknown' end) as venue
from l""")
def sc6(t):
    return t.part.select("p_partkey", AR.pick_venue(_locations()).alias("venue"))


@query("sc7_clip_abstract", """
select doc_id, md5(substring(coalesce(case when doc_id % 10 = 0 then null else text end, ''), 1, 1000)) as abstract_md5 from documents""")
def sc7(t):
    d = t.documents
    a = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(AR.clip_abstract(a)).alias("abstract_md5"))


TEMPLATE = "Previous ideas:\n{prev_ideas_string}\nPropose the next idea."


@query("sc16_archive_prompts", """
WITH i AS (select seq, experiment, '{"Name": ' || to_json(name) || ', "Title": ' || to_json(title) || ', "Experiment": ' || to_json(experiment)
    || ', "Interestingness": ' || cast(interestingness as varchar) || ', "Feasibility": ' || cast(feasibility as varchar)
    || ', "Novelty": ' || cast(novelty as varchar) || '}' as js from d_archive)
select experiment, md5(replace('Previous ideas:' || chr(10) || '{prev_ideas_string}' || chr(10) || 'Propose the next idea.', '{prev_ideas_string}',
                               string_agg(js, chr(10) || chr(10) order by seq))) as prompt_md5
from i group by experiment""", ("d_archive",))
def sc16(t):
    a = D.d_archive(t)
    js = AR.idea_json(F.col("name"), F.col("title"), F.col("experiment"), F.col("interestingness"),
                      F.col("feasibility"), F.col("novelty"))
    p = AR.prompts(a.withColumn("js", js), "experiment", "seq", "js", TEMPLATE)
    return p.select("experiment", F.md5("prompt").alias("prompt_md5"))


# --------------------------------------------------------------- retrieval

TFIDF_SQL = """
dt AS (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)) as term from documents) group by all),
dfs AS (select term, count(*) as df from dt group by term),
qt AS (select item_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0)) as term from benchmark) group by all),
sc AS (select q.item_id, d.doc_id, sum(q.qtf * d.tf * ln((select count(*) from documents)::double / f.df)) as score
       from qt q join dfs f on q.term = f.term join dt d on d.term = q.term group by q.item_id, d.doc_id),
hits AS (select item_id, doc_id, score, row_number() over (partition by item_id order by round(score, 9) desc, doc_id) as rank from sc)"""


def _hits(t, n=10):
    return RT.top_documents(t.benchmark.select("item_id", "text"), "item_id", "text",
                            t.documents.select("doc_id", "text"), "doc_id", "text", n=n, rounding=9)


@query("jn20_top_documents", f"""
WITH {TFIDF_SQL}
select item_id, doc_id, rank, round(score, 6) as score from hits where rank <= 10""")
def jn20(t):
    return _hits(t).select("item_id", "doc_id", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query("tk1_best_citation", f"""
WITH {TFIDF_SQL}
select h.item_id, d.doc_id % 3 <> 0 as has_bibtex,
       md5(case when d.doc_id % 3 <> 0 then substring(d.text, 1, 50000) end) as bibtex_md5,
       cast(length(case when d.doc_id % 3 <> 0 then substring(d.text, 1, 1000) end) as integer) as abstract_len
from hits h join documents d on h.doc_id = d.doc_id where h.rank = 1""")
def tk1(t):
    docs = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("bib"),
                              F.col("text").alias("abs"))
    h = _hits(t, 1).join(docs, "doc_id")
    out = RT.best_citation(h, "item_id", "bib", "abs")
    return out.select("item_id", "has_bibtex", F.md5("bibtex").alias("bibtex_md5"),
                      F.length("abstract").alias("abstract_len"))


@query("sc8_result_block", f"""
WITH {TFIDF_SQL}
select h.item_id, md5(string_agg(cast(h.rank - 1 as varchar) || ': doc ' || cast(d.doc_id as varchar) || '. ' || d.lang || '. ' || d.source || ', '
   || cast(2000 + d.doc_id % 25 as varchar) || '.' || chr(10) || 'Number of citations: ' || cast(d.n_chars as varchar) || chr(10) || 'Abstract: '
   || substring(d.text, 1, 1000), chr(10) || chr(10) order by h.rank)) as papers_md5
from hits h join documents d on h.doc_id = d.doc_id where h.rank <= 10 group by h.item_id""")
def sc8(t):
    d = t.documents.select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
                           F.col("lang").alias("authors"), F.col("source").alias("venue"),
                           (F.lit(2000) + F.col("doc_id") % 25).alias("year"), F.col("n_chars").alias("cites"),
                           AR.clip_abstract(F.col("text")).alias("abstract"))
    h = _hits(t).join(d, "doc_id")
    out = RT.result_block(h, "item_id", "rank", "title", "authors", "venue", "year", "cites", "abstract")
    return out.select("item_id", F.md5("papers").alias("papers_md5"))


@query("ud5_unify_providers", """
select 'engine_1' as engine, 'doc ' || cast(doc_id as varchar) as title, lang || ' and ' || source as authors, source as venue,
       cast(2000 + doc_id % 25 as integer) as year, cast(n_chars as integer) as citationCount, md5(substring(text, 1, 100)) as bibtex_md5
from documents
union all select 'engine_2', 'item ' || cast(item_id as varchar), 'anonymous', 'bench', 2024, cast(length(text) as integer), null from benchmark""")
def ud5(t):
    docs = t.documents
    rec1 = F.struct(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
                    F.array(F.struct(F.col("lang").alias("name")), F.struct(F.col("source").alias("name"))).alias("authors"),
                    F.col("source").alias("venue"), (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("year"),
                    F.col("text").alias("abstract"), F.struct(F.substring("text", 1, 100).alias("bibtex")).alias("citationStyles"),
                    F.col("n_chars").cast("int").alias("citationCount"))
    e1 = docs.select(F.from_json(F.to_json(rec1), RT.ENGINE1).alias("rec"))
    b = t.benchmark
    rec2 = F.struct(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("title"),
                    F.lit("anonymous").alias("authors"), F.lit("bench").alias("venue"), F.lit(2024).alias("year"),
                    F.col("text").alias("abstract"), F.length("text").alias("citationCount"))
    e2 = b.select(F.from_json(F.to_json(rec2), RT.ENGINE2).alias("rec"))
    u = RT.unify(e1, e2)
    return u.select("engine", "title", "authors", "venue", "year", "citationCount",
                    F.md5("bibtex").alias("bibtex_md5"))
