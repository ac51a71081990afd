"""Image lists of many byte ranges."""

import pytest

from quire.sources import io as IO


@pytest.mark.parametrize("skip", [0, 7])
def test_image_poses_are_numbered_over_ranges(spark, tmp_path, skip):
    (tmp_path / "img").mkdir()
    want = []
    for f in range(3):
        lines = ["# Image list", ""]
        for m in range(60):
            image = f * 100 + m
            lines += [f"{image} 1.0 0.5 0 0 {m}.25 0 -1 {m % 4} img {image} a.png", *["# between"] * (m % 5 == 0), f"{m}.5 2.0 -1", *[" "] * (m % 7 == 0)]
            if 2 * m + 1 >= 2 * skip:
                want.append((f, image, 1.0, m + 0.25, m % 4, f"img_{image}_a.png"))
        (tmp_path / "img" / f"f{f}.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        got = IO.read_image_poses(spark, str(tmp_path / "img"), skip_early=skip).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((int(r["path"][-5]), r["image_id"], r["qw"], r["tx"], r["camera_id"], r["name"]) for r in got) == want
