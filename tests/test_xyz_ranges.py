"""XYZ files of many byte ranges."""

from quire.sources import io as IO


def test_lines_frames_and_comments_over_ranges(spark, tmp_path):
    (tmp_path / "xyz").mkdir()
    want_lines, want_atoms, want_heads = [], [], []
    for f in range(3):
        lines = [line for m in range(40) for line in (str(2 + m % 3), f"mol={f * 100 + m}", *[f"C {m} {a}.5 -1.0" for a in range(2 + m % 3)])]
        (tmp_path / "xyz" / f"f{f}.xyz").write_text("\n".join(lines) + "\n")
        want_lines += [(f, i, x) for i, x in enumerate(lines)]
        want_heads += [(f, m + 1, f"mol={f * 100 + m}") for m in range(40)]
        want_atoms += [(f, m + 1, a, float(m)) for m in range(40) for a in range(2 + m % 3)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        path, at = str(tmp_path / "xyz"), lambda r: int(r["path"][-5])
        lines = IO.read_lines(spark, path)
        assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString().split("LogicalRelation")[0].split("Join")[0]
        assert sorted((at(r), r["line_no"], r["line"]) for r in lines.collect()) == want_lines
        assert sorted((at(r), r["frame"], r["atom"], r["x"]) for r in IO.read_xyz(spark, path).collect()) == want_atoms
        assert sorted((at(r), r["frame"], r["comment"]) for r in IO.read_xyz_comments(spark, path).collect()) == want_heads
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
