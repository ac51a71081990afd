"""Vocabulary ids as Arrow arrays: keys, nulls and symbols of several characters."""

from quire.operators import splits as SP


def test_ids_and_texts_keep_keys_and_nulls(spark):
    rows = [((1 << 60) + 1, "a\U0001F600b"), (None, "ba"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "k long, t string")
    vocab = SP.build_vocab(docs, "t")
    coded = SP.encode_table(docs, "k", "t", vocab)
    assert {r["k"]: r["ids"] for r in coded.collect()} == {(1 << 60) + 1: [2, 4, 3], None: [3, 2], 3: None, 4: []}
    assert {r["k"]: r["text"] for r in SP.decode_table(coded, "k", "ids", vocab).collect()} == dict(rows)
    odd = spark.createDataFrame([(1, [0, 2, None, 99, -1, 1]), (2, None)], "k long, ids array<int>")
    assert {r["k"]: r["text"] for r in SP.decode_table(odd, "k", "ids", vocab).collect()} == {1: "<pad>a<unk>", 2: None}
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp_extract_all" not in plan  # no table of code points beside every row
