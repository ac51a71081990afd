"""The pipeline against stage-by-stage rules on the smallest table."""

import os

import pyarrow.parquet as pq

import corpus_pipeline
from quire.llm import decontaminate, kn_quality, line_runs, simhash_trie
from tests.conftest import SF001


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = [r["doc_id"] for r in kn_quality.judge(docs, labels).where("keep").collect()]
    cur = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = cur
        cur = spark.createDataFrame(stage(spark, before, SF001).toPandas())
        ids = sorted(r["doc_id"] for r in cur.select("doc_id").distinct().collect())
        if i < 4:
            assert cur.columns == docs.columns
        if i == 0:
            assert ids == sorted(want)
        elif i == 1:
            deleted = {r["doc_id"]: r["text"] for r in line_runs.drop_repeats(before).collect()}
            assert {r["doc_id"]: r["text"] for r in cur.collect()} == deleted
            assert all(r["n_chars"] == len(r["text"]) for r in cur.collect())
        elif i == 2:
            assert ids == sorted({r["component_id"] for r in simhash_trie.near_groups(before).collect()})
        elif i == 3:
            bad = {r["id"] for r in decontaminate.leaks(before, bench).collect()}
            assert bad and ids == sorted({r["doc_id"] for r in before.collect()} - bad)
        else:
            assert cur.columns == [*docs.columns, "mix_tokens", "mix_epoch"] and set(ids) <= {r["doc_id"] for r in before.collect()}
    assert pq.read_table(os.path.join(SF001, "documents.parquet")).num_rows == docs.count()


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    """Nulls, empty and repeated rows, extra columns with names the operators use."""
    long = " ".join(f"word{i % 97} and" for i in range(3000))
    rows = [(1, None), (2, ""), (None, "no id at all"), (3, "twice"), (3, "twice"), (4, long), (5, long + " more"), (6, "x\n" * 400)]
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "src1", len(t or ""), "a", 7, -1, "c") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, id string, n int, mix_tokens int, text_key string")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        want = docs.columns if i < 4 else [*(c for c in docs.columns if c != "mix_tokens"), "mix_tokens", "mix_epoch"]
        assert out.columns == want, name
        kept = [(r["doc_id"], r["text"]) for r in out.collect()]
        if i < 4:
            assert len(kept) <= len(rows) and {k for k, _ in kept} <= {k for k, _ in rows}, name
        none = stage(spark, docs.limit(0), SF001)
        assert none.columns == want and none.count() == 0, name
