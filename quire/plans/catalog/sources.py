"""Source/sink queries: each writes data derived from the driver tables into
a fresh folder under the shared checkpoint folder, reads it back with the
reader under test and returns the parsed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fmt import r6
from quire.operators import runs as R
from quire.plans import derived as D
from quire.plans.registry import query
from quire.sources import io as IO


@query("src1_read_json_records", "select seq, name, novelty from d_archive", ("d_archive",))
def src1(t):
    path = IO.scratch_dir(t.spark, "records")
    IO.write_array_files(D.d_archive(t).select("seq", "name", "novelty", "experiment"), path, "experiment")
    df = IO.read_records(t.spark, path, "seq long, name string, novelty int")
    return df.select("seq", "name", "novelty")


def _write_runs(t, root):
    runs = D.d_runs(t)
    per = runs.groupBy("run", "dataset").agg(
        F.avg("val_loss").alias("l"), F.avg("val_acc").alias("a"),
        F.stddev_pop("val_loss").alias("ls"), F.stddev_pop("val_acc").alias("as_"), F.count("*").alias("n"))
    std = per.groupBy("run").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        "dataset", F.struct(F.create_map(F.lit("val_loss"), "l", F.lit("val_acc"), "a").alias("means"),
                            F.create_map(F.lit("val_loss"), "ls", F.lit("val_acc"), "as_").alias("stderrs"))))))
                            .alias("value"))
    whole = runs.groupBy("run").agg(F.avg("val_loss").alias("l"), F.avg("val_acc").alias("a"),
                                    F.stddev_pop("val_loss").alias("ls"), F.stddev_pop("val_acc").alias("as_"))
    shape_a = whole.select("run", F.to_json(F.struct(F.struct(F.col("l").alias("means")).alias("val_loss"),
                                                     F.struct(F.col("a").alias("means")).alias("val_acc"))).alias("value"))
    shape_b = whole.select("run", F.to_json(F.struct(
        F.struct(F.col("l").alias("means"), F.col("ls").alias("stds")).alias("val_loss"),
        F.struct(F.col("a").alias("means"), F.col("as_").alias("stds")).alias("val_acc"))).alias("value"))
    nested = per.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(
        "dataset", F.struct(F.struct(F.col("l").alias("val_loss"), F.col("a").alias("val_acc")).alias("metrics"),
                            F.col("n").alias("n"))))).alias("m"))
    shape_c = nested.select("run", F.to_json(F.struct(
        F.struct(F.col("m").alias("means")).alias("MACE"),
        F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("solution"))).alias("value"))
    out = (std.where(F.col("run") == "run_0")
           .unionByName(shape_a.where(F.col("run") == "run_1"))
           .unionByName(shape_b.where(F.col("run") == "run_2"))
           .unionByName(shape_c.where(F.col("run") == "run_3")))
    out.repartition("run").write.mode("overwrite").partitionBy("run").text(root)


RUNS_ORACLE = """
WITH per AS (select run, dataset, avg(val_loss) as l, avg(val_acc) as a, stddev_pop(val_loss) as ls, stddev_pop(val_acc) as as_, count(*) as n from d_runs group by run, dataset),
whole AS (select run, avg(val_loss) as l, avg(val_acc) as a, stddev_pop(val_loss) as ls, stddev_pop(val_acc) as as_ from d_runs group by run)
select run, dataset, metric, round(mean, 6) as mean, round(stderr, 6) as stderr from (
  select run, dataset, 'val_loss' as metric, l as mean, ls as stderr from per where run = 'run_0'
  union all select run, dataset, 'val_acc', a, as_ from per where run = 'run_0'
  union all select run, null, 'val_loss', l, null from whole where run = 'run_1'
  union all select run, null, 'val_acc', a, null from whole where run = 'run_1'
  union all select run, null, 'val_loss', l, ls from whole where run = 'run_2'
  union all select run, null, 'val_acc', a, as_ from whole where run = 'run_2'
  union all select run, 'MACE', dataset || '.metrics.val_loss', l, null from per where run = 'run_3'
  union all select run, 'MACE', dataset || '.metrics.val_acc', a, null from per where run = 'run_3'
  union all select run, 'MACE', dataset || '.n', n, null from per where run = 'run_3')"""


@query("src3_discover_runs", RUNS_ORACLE, ("d_runs",))
def src3(t):
    root = IO.scratch_dir(t.spark, "runs")
    _write_runs(t, root)
    out = IO.read_runs(t.spark, root)
    return out.select("run", "dataset", "metric", r6("mean").alias("mean"), r6("stderr").alias("stderr"))


@query("src4_read_jsonl_last_eval", """
select run, dataset, seed, step, val_loss from (
  select *, row_number() over (partition by run, dataset, seed order by step desc) as rn from d_runs where phase = 'full1') where rn = 1""",
       ("d_runs",))
def src4(t):
    path = IO.scratch_dir(t.spark, "jsonl")
    runs = D.d_runs(t).select("run", "dataset", "seed", "step", "val_loss",
                              F.when(F.col("phase") == "full1", "eval").otherwise("train").alias("mode"))
    IO.write_json(runs, path)
    df = IO.read_jsonl(t.spark, path, "run string, dataset string, seed int, step int, val_loss double, mode string")
    out = R.last_record(df, ["run", "dataset", "seed"], "step", "mode", "eval")
    return out.select("run", "dataset", "seed", "step", "val_loss")


@query("src5_flatten_run_log", """
select run, dataset || '_' || cast(seed as varchar) || '_val_info' as log_key, step as iter, phase, metric, value from (
  select run, dataset, seed, step, phase, 'val_loss' as metric, val_loss as value from d_runs
  union all select run, dataset, seed, step, phase, 'val_acc', val_acc from d_runs)""", ("d_runs",))
def src5(t):
    runs = D.d_runs(t)
    steps = F.array_sort(F.collect_list(F.struct(F.col("step").alias("iter"), "val_loss", "val_acc", "phase")))
    per_seed = runs.groupBy("run", "dataset", "seed").agg(steps.alias("steps"))
    key = F.concat_ws("_", "dataset", F.col("seed").cast("string"), F.lit("val_info"))
    logs = per_seed.groupBy("run", "dataset").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "steps")))).alias("log"))
    out = IO.flatten_run_log(logs, "run")
    return out.select("run", "log_key", "iter", "phase", "metric", "value")


@query("src6_read_tsv_dataset", """
select mol, atom, x, y from d_points where (case mol % 3 when 0 then 'dino' when 1 then 'circle' else 'line' end) = 'dino'""",
       ("d_points",))
def src6(t):
    path = IO.scratch_dir(t.spark, "tsv")
    pts = D.d_points(t).select(
        F.when(F.col("mol") % 3 == 0, "dino").when(F.col("mol") % 3 == 1, "circle").otherwise("line").alias("dataset"),
        "mol", "atom", "x", "y")
    IO.write_csv(pts, path, sep="\t")
    df = IO.read_tsv(t.spark, path, "dataset string, mol long, atom int, x double, y double",
                     where=F.col("dataset") == "dino")
    return df.select("mol", "atom", "x", "y")


@query("src7_read_whole_documents", """
select doc_id % 4 as grp, cast(sum(length(review) + 1) as bigint) as n_chars from d_review_md group by doc_id % 4""", ("d_review_md",))
def src7(t):
    path = IO.scratch_dir(t.spark, "docs")
    md = D.d_review_md(t).select((F.col("doc_id") % 4).alias("grp"), F.col("review").alias("value"))
    md.repartition("grp").write.mode("overwrite").partitionBy("grp").text(path)
    docs = IO.read_documents(t.spark, path)
    grp = F.regexp_extract("path", r"grp=(\d+)", 1).cast("long")
    return docs.groupBy(grp.alias("grp")).agg(F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("src7_read_corpus", """
select doc_id, cast(length(review) as int) as n_chars, md5(review) as text_md5 from d_review_md""", ("d_review_md",))
def src7c(t):
    """Documents read back from files of many records each."""
    path = IO.scratch_dir(t.spark, "corpus")
    md = D.d_review_md(t).select(F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.col("review")).alias("value"))
    IO.write_corpus(md, path, "value")
    docs = IO.read_corpus(t.spark, path)
    head = F.substring_index("text", "\n", 1)
    body = F.substring(F.col("text"), F.length(head) + 2, F.length("text"))
    return docs.select(head.cast("long").alias("doc_id"), F.length(body).alias("n_chars"), F.md5(body).alias("text_md5"))


@query("src8_read_xyz_frames", """
select mol, cast(row_number() over (partition by mol order by atom) - 1 as bigint) as atom, x, y, z from d_points""",
       ("d_points",))
def src8(t):
    path = IO.scratch_dir(t.spark, "xyz")
    pts = D.d_points(t)
    line = F.concat_ws(" ", F.lit("C"), F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string"))
    blocks = pts.groupBy("mol").agg(F.array_sort(F.collect_list(F.struct("atom", line.alias("l")))).alias("a"))
    text = F.concat_ws("\n", F.size("a").cast("string"), F.concat(F.lit("mol="), F.col("mol").cast("string")),
                       F.array_join(F.transform("a", lambda s: s["l"]), "\n"))
    blocks.select((F.col("mol") % 8).alias("grp"), text.alias("value")) \
        .write.mode("overwrite").partitionBy("grp").text(path)  # by every task: a folder's frames are in many files
    atoms = IO.read_xyz(t.spark, path)
    comments = IO.read_xyz_comments(t.spark, path).where(F.col("comment").startswith("mol="))
    mols = comments.select("path", "frame", F.regexp_extract("comment", r"mol=(\d+)", 1).cast("long").alias("mol"))
    return atoms.join(mols, ["path", "frame"]).select("mol", F.col("atom").cast("long").alias("atom"), "x", "y", "z")


CAMERA_MODEL_SQL = ("case s_nationkey % 5 when 0 then 'SIMPLE_PINHOLE' when 1 then 'PINHOLE' when 2 then 'SIMPLE_RADIAL' "
                    "when 3 then 'RADIAL' else 'OPENCV' end")


@query("src8_read_cameras", f"""
WITH c AS (select s_suppkey as camera_id, {CAMERA_MODEL_SQL} as model, 640.0 as w, 480.0 as h, 500.0 + s_nationkey as f, s_nationkey as k from supplier)
select camera_id, model, cast(case when model in ('PINHOLE', 'OPENCV') then f + 1 else f end as double) as fl_y,
       cast(case when model = 'SIMPLE_PINHOLE' or model = 'SIMPLE_RADIAL' or model = 'RADIAL' then 300.0 + k when model in ('PINHOLE', 'OPENCV') then 301.0 + k end as double) as cx,
       cast(case when model = 'RADIAL' then 0.5 when model = 'OPENCV' then 0.25 else 0.0 end as double) as k2,
       round(atan(w / (f * 2)) * 2, 9) as angle_x,
       round(atan(h / ((case when model in ('PINHOLE', 'OPENCV') then f + 1 else f end) * 2)) * 2, 9) as angle_y from c""")
def src8c(t):
    path = IO.scratch_dir(t.spark, "cameras")
    s = t.supplier
    k = F.col("s_nationkey")
    f = (F.lit(500) + k).cast("double")
    model = (F.when(k % 5 == 0, "SIMPLE_PINHOLE").when(k % 5 == 1, "PINHOLE").when(k % 5 == 2, "SIMPLE_RADIAL")
             .when(k % 5 == 3, "RADIAL").otherwise("OPENCV"))
    ks = k.cast("double")
    params = (F.when(k % 5 == 0, F.array((300 + ks), F.lit(240.0)))
              .when(k % 5 == 1, F.array(f + 1, 301 + ks, F.lit(241.0)))
              .when(k % 5 == 2, F.array(300 + ks, F.lit(240.0), F.lit(0.1)))
              .when(k % 5 == 3, F.array(300 + ks, F.lit(240.0), F.lit(0.1), F.lit(0.5)))
              .otherwise(F.array(f + 1, 301 + ks, F.lit(241.0), F.lit(0.1), F.lit(0.25), F.lit(0.01), F.lit(0.02))))
    line = F.concat_ws(" ", F.col("s_suppkey").cast("string"), model, F.lit("640"), F.lit("480"), f.cast("string"),
                       F.array_join(F.transform(params, lambda x: x.cast("string")), " "))
    header = t.spark.createDataFrame([("# Camera list with one line of data per camera:",)], "value string")
    s.select(line.alias("value")).unionByName(header).write.mode("overwrite").text(path)
    cams = IO.read_cameras(t.spark, path)
    return cams.select("camera_id", "model", "fl_y", "cx", "k2", F.round("angle_x", 9).alias("angle_x"),
                       F.round("angle_y", 9).alias("angle_y"))


@query("src8_read_image_poses", """
select s_suppkey as image_id, s_acctbal / 1000 as qw, cast(s_nationkey as double) as tx, 'img_' || cast(s_suppkey as varchar) || '_a' as name from supplier""")
def src8i(t):
    path = IO.scratch_dir(t.spark, "images")
    s = t.supplier
    rec = F.concat_ws(" ", F.col("s_suppkey").cast("string"), (F.col("s_acctbal") / 1000).cast("string"),
                      F.lit("0.0 0.0 0.0"), F.col("s_nationkey").cast("double").cast("string"), F.lit("0.0 0.0 1"),
                      F.concat(F.lit("img "), F.col("s_suppkey").cast("string"), F.lit(" a")))
    s.select(F.concat(rec, F.lit("\n"), F.lit("1.0 2.0 -1")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    out = IO.read_image_poses(t.spark, path, skip_early=0)
    return out.select("image_id", "qw", "tx", "name")


@query("src9_read_frames_json", """
select './f_' || cast(frame as varchar) as file_path, frame % 4 as scene, tx as m03, r10 as m10, 0.6911112070083618::double as camera_angle_x from d_poses""",
       ("d_poses",))
def src9(t):
    path = IO.scratch_dir(t.spark, "frames")
    p = D.d_poses(t)
    m = F.array(F.array("r00", "r01", F.lit(0.0), "tx"), F.array("r10", "r11", F.lit(0.0), "ty"),
                F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    fr = F.struct(F.concat(F.lit("./f_"), F.col("frame").cast("string")).alias("file_path"), m.alias("transform_matrix"))
    scenes = p.groupBy((F.col("frame") % 4).alias("scene")).agg(F.collect_list(fr).alias("frames"))
    scenes.select("scene", F.to_json(F.struct(F.lit(0.6911112070083618).alias("camera_angle_x"), "frames")).alias("value")) \
        .repartition("scene").write.mode("overwrite").partitionBy("scene").text(path)
    df = IO.read_frames(t.spark, path)
    scene = F.regexp_extract("path", r"scene=(\d+)", 1).cast("long")
    return df.select("file_path", scene.alias("scene"), F.col("transform_matrix")[0][3].alias("m03"),
                     F.col("transform_matrix")[1][0].alias("m10"), "camera_angle_x")


@query("src10_split_pose_rows", """
select vec_id, round(cast(embedding[16] as double), 9) as near, round(cast(embedding[17] as double), 9) as far, round(cast(embedding[8] as double), 9) as pose_1_2 from embeddings""")
def src10(t):
    e = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 17), lambda x: x.cast("double")).alias("v"))
    out = IO.split_pose_rows(e, "v")
    return out.select("vec_id", F.round("near", 9).alias("near"), F.round("far", 9).alias("far"),
                      F.round(F.col("pose")[1][2], 9).alias("pose_1_2"))


@query("src11_pick_split_files", """
select doc_id, file from d_files where starts_with(file, '2_')
union all select doc_id, file from d_files f where starts_with(file, '1_')
  and not exists (select 1 from d_files g where g.doc_id = f.doc_id and starts_with(g.file, '2_'))""", ("d_files",))
def src11(t):
    return IO.pick_split_files(D.d_files(t), "doc_id", "file", "test").select("doc_id", "file")


@query("tk5_sorted_listing", """
select doc_id, array_to_string(list_sort(list(file)), '|') as listing from d_files group by doc_id""", ("d_files",))
def tk5(t):
    f = D.d_files(t)
    return f.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("file")), "|").alias("listing"))


FOLDER_SQL = """f AS (select s_nationkey as scene, concat(case when s_nationkey % 3 = 0 and s_suppkey % 3 = 2 then 0 else s_suppkey % 3 end, '_', s_suppkey,
     case when s_suppkey % 4 = 0 then ' a+b.txt' else '.txt' end) as name, s_name as body from supplier)"""


def _pose_folder(t):
    """A real folder: one file per supplier, named by its folder level."""
    path = IO.scratch_dir(t.spark, "pose-folder")
    k = F.col("s_suppkey")
    split = F.when((F.col("s_nationkey") % 3 == 0) & (k % 3 == 2), F.lit(0)).otherwise(k % 3)
    name = F.concat(split.cast("string"), F.lit("_"), k.cast("string"), F.when(k % 4 == 0, F.lit(" a+b.txt")).otherwise(F.lit(".txt")))
    rows = t.supplier.select(F.col("s_nationkey").alias("scene"), name.alias("file"), F.col("s_name").alias("value"))
    IO.write_folders(rows, path, ["scene", "file"])
    files = IO.listing(t.spark, path, ".txt")
    return files.select(IO.folder_value("path", "scene").cast("long").alias("scene"), IO.folder_value("path", "file").alias("name"), "size")


@query("src11_inventory_split", f"""
WITH {FOLDER_SQL}
select scene, name, octet_length(encode(body)) + 1 as size from f where starts_with(name, '2_')
union all select scene, name, octet_length(encode(body)) + 1 from f where starts_with(name, '1_')
  and not exists (select 1 from f g where g.scene = f.scene and starts_with(g.name, '2_'))""")
def src11i(t):
    """Test files of every scene in a real folder, from paths alone."""
    return IO.pick_split_files(_pose_folder(t), "scene", "name", "test").select("scene", "name", "size")


@query("tk5_folder_listing", f"""
WITH {FOLDER_SQL}
select scene, row_number() over (partition by scene order by name) - 1 as place, name from f""")
def tk5f(t):
    """Sorted listing of every scene of a real folder."""
    return IO.sorted_listing(_pose_folder(t), ["scene"]).select("scene", "place", "name")


@query("src12_json_sink_roundtrip", "select run, dataset, seed, step, val_loss from d_runs", ("d_runs",))
def src12(t):
    path = IO.scratch_dir(t.spark, "json-sink")
    IO.write_json(D.d_runs(t).select("run", "dataset", "seed", "step", "val_loss"), path, partition_by=["run"])
    back = t.spark.read.schema("dataset string, seed int, step int, val_loss double, run string").json(path)
    return back.select("run", "dataset", "seed", "step", "val_loss")


@query("src13_csv_sink_partitioned", """
select cast(vec_id % 3 as int) as split, layer, beta, round(avg(x * beta), 6) as accuracy
from d_vectors, (select unnest([1, 5]) as beta) group by vec_id % 3, layer, beta""", ("d_vectors",))
def src13(t):
    path = IO.scratch_dir(t.spark, "csv-sink")
    v = D.d_vectors(t).withColumn("beta", F.explode(F.array(F.lit(1), F.lit(5))))
    res = (v.groupBy((F.col("vec_id") % 3).cast("int").alias("split"), "layer", "beta")
           .agg(r6(F.avg(F.col("x") * F.col("beta"))).alias("accuracy")))
    IO.write_csv(res, path, partition_by=["split", "layer", "beta"])
    back = t.spark.read.option("header", True).schema("accuracy double, split int, layer int, beta int").csv(path)
    return back.select("split", "layer", "beta", "accuracy")
