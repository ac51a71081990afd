"""Readers and writers for the research-pipeline file formats.

JSON records and arrays, doubly encoded reviews, run folders with drifted
summary shapes, line-delimited logs, run logs (dict of lists of dicts),
TSV point files, whole-text documents, XYZ frames, camera text files,
frame JSON, fixed-width pose rows, file inventories, JSON/CSV sinks.

Readers use Spark data sources (``json``, ``text``, ``csv``,
``binaryFile``) with explicit schemas; parsing is column expressions.
Scratch output goes under the shared folder named by
``spark.checkpoint.dir`` (never a machine-local temp folder).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.plans.ordering import positions, running
from quire.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quire-io/{name}-{uuid.uuid4().hex[:12]}"


def file_path() -> Column:
    return F.col("_metadata.file_path")


# ---------------------------------------------------------------- records


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays or objects (one document per file); the template name is
    the parent folder of each file."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.withColumn("template", F.regexp_extract(file_path(), r"/([^/]+)/[^/]+$", 1))


def write_json(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """JSON lines sink (write to a new folder; never over a path being read)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)
    return path


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite",
              sep: str = ",") -> str:
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


def write_array_files(df: DataFrame, path: str, group: str) -> str:
    """One JSON array file per ``group`` value (rows of a group kept together)."""
    rows = F.to_json(F.collect_list(F.struct(*[c for c in df.columns if c != group])))
    arrays = df.groupBy(group).agg(rows.alias("value"))
    arrays.repartition(group).write.mode("overwrite").partitionBy(group).text(path)
    return path


# ------------------------------------------------------------------- runs


def _nesting(text: Column) -> Column:
    """How deep the objects of a JSON text are nested (braces outside strings)."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"', "")
    braces = F.split(F.regexp_replace(bare, r"[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a, x):
        now = a["now"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda a: a["most"])


def read_runs(spark: SparkSession, root: str, pattern: str = "run*/*") -> DataFrame:
    """Discover run folders (name starting with ``run``) and flatten their
    summaries to (run, dataset, metric, mean, stderr).

    Tolerated shapes: {dataset: {means: {metric: v}, stderrs: {...}}};
    {metric: {means: v}} and {metric: {means: v, stds: s}} (dataset NULL);
    nested objects inside ``means`` (metric = dotted path of numeric leaves,
    as many levels as the deepest file has, found by one pass); extra non-object members (e.g. ``solution``) ignored."""
    raw = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True)
    run = F.regexp_extract(file_path(), r"/(run[^/]*)/[^/]+$", 1)
    run = F.regexp_replace(run, r"^run=", "")
    top = raw.select(run.alias("run"), F.explode(F.parse_json("value").cast("map<string,variant>")).alias("k", "v"))
    top = top.where(F.try_variant_get("v", "$.means", "variant").isNotNull())
    num = top.select("run", F.lit(None).cast("string").alias("dataset"), F.col("k").alias("metric"),
                     F.try_variant_get("v", "$.means", "double").alias("mean"),
                     F.coalesce(F.try_variant_get("v", "$.stds", "double"),
                                F.try_variant_get("v", "$.stderrs", "double")).alias("stderr")
                     ).where(F.col("mean").isNotNull())
    lvl1 = top.select("run", F.col("k").alias("dataset"),
                      F.try_variant_get("v", "$.stderrs", "map<string,double>").alias("_se"),
                      F.explode(F.try_variant_get("v", "$.means", "map<string,variant>")).alias("m1", "v1"))
    leaf1 = lvl1.select("run", "dataset", F.col("m1").alias("metric"),
                        F.try_variant_get("v1", "$", "double").alias("mean"),
                        F.element_at("_se", F.col("m1")).alias("stderr")).where(F.col("mean").isNotNull())
    out = num.unionByName(leaf1)
    deepest = raw.agg(F.max(_nesting(F.col("value")))).first()[0] or 0
    level = lvl1.select("run", "dataset", F.col("m1").alias("metric"), F.col("v1").alias("v"))
    for _ in range(deepest - 3):  # the file, the dataset and means are objects too
        level = level.select("run", "dataset", "metric",
                             F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("m", "v")) \
            .select("run", "dataset", F.concat_ws(".", "metric", "m").alias("metric"), "v")
        out = out.unionByName(level.select("run", "dataset", "metric", F.try_variant_get("v", "$", "double").alias("mean"),
                                           F.lit(None).cast("double").alias("stderr")).where(F.col("mean").isNotNull()))
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line (order kept through a written ``line_no``)."""
    return spark.read.schema(schema).json(path)


LOG_SCHEMA = "map<string, array<struct<iter: int, val_loss: double, val_acc: double, phase: string>>>"


def flatten_run_log(df: DataFrame, key: str, log: str = "log", schema: str = LOG_SCHEMA,
                    metrics: Sequence[str] = ("val_loss", "val_acc")) -> DataFrame:
    """Run log JSON (dict of lists of step dicts) -> (key, log_key, step, phase, metric, value)."""
    parsed = df.select(key, F.explode(F.from_json(F.col(log), schema)).alias("log_key", "_steps"))
    steps = parsed.select(key, "log_key", F.explode("_steps").alias("_s")).select(key, "log_key", "_s.*")
    return steps.unpivot([key, "log_key", "iter", "phase"], list(metrics), "metric", "value")


def read_tsv(spark: SparkSession, path: str, schema: str, where: Column | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
    return df if where is None else df.where(where)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: (path, text)."""
    return spark.read.text(path, wholetext=True).select(file_path().alias("path"), F.col("value").alias("text"))


# -------------------------------------------------------- record text files


def read_corpus(spark: SparkSession, path: str, separator: str = "\n\x1e\n") -> DataFrame:
    """(path, text): the records of text files that hold many of them, each
    ended by ``separator``.  A file is read in byte ranges by many tasks, each of
    which goes on to the end of its last record, so no row holds a file."""
    df = spark.read.option("lineSep", separator).text(path)
    return df.select(file_path().alias("path"), F.col("value").alias("text"))


def write_corpus(df: DataFrame, path: str, text: str, separator: str = "\n\x1e\n") -> str:
    """Records for ``read_corpus``; the separator must not be in a text."""
    df.select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", separator).text(path)
    return path


def _ranged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, _range, line_no, line) of text files, ``_range`` the place of the
    byte range that a line was read in.

    A range is read by one task, row after row, so a line's place in its range is
    its row id less the smallest of the range; one row per range (its first id and
    its lines) gives the lines of the file before it.  No line is shuffled."""
    df = spark.read.text(path).select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("_range"),
                                      F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    ranges = df.groupBy("path", "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("path", "_range", (before - F.col("_first")).alias("_shift"))  # a row per range: as many as tasks
    return df.join(F.broadcast(ranges), ["path", "_range"]).select("path", "_range", (F.col("_row") + F.col("_shift")).alias("line_no"), "line")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line): the lines of text files, numbered from 0.

    Files are read in byte ranges; no row holds a file and no task more than a
    range of it (see ``_ranged_lines``)."""
    return _ranged_lines(spark, path).select("path", "line_no", "line")


def _xyz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line, frame, _start) of XYZ files: the frame of every line,
    from 1, and the number of its count line.  Running values inside byte ranges,
    carried on by one row per range."""
    lines = _ranged_lines(spark, path)
    is_count = F.trim("line").rlike(r"^\d+$")
    return running(lines, ["line_no"], {"frame": (is_count.cast("long"), "sum"), "_start": (F.when(is_count, F.col("line_no")), "max")},
                   bucket=F.col("_range"), partition_by=["path"]).drop("_range")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """XYZ frames: count line, comment line, ``sym x y z`` lines; several
    frames per file.  A frame starts at a line holding one integer; atom
    index = position after the frame's two header lines."""
    parts = F.split(F.trim("line"), r"\s+")
    atoms = _xyz_lines(spark, path).where((F.col("line_no") >= F.col("_start") + 2) & (F.size(parts) == 4))
    return atoms.select("path", "frame", (F.col("line_no") - F.col("_start") - 2).alias("atom"),
                        parts.getItem(0).alias("symbol"),
                        *[parts.getItem(i).cast("double").alias(a) for i, a in ((1, "x"), (2, "y"), (3, "z"))])


def read_xyz_comments(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, comment): the line after the count line of every frame of ``read_xyz``."""
    lines = _xyz_lines(spark, path).where(F.col("line_no") == F.col("_start") + 1)
    return lines.select("path", "frame", F.col("line").alias("comment"))


# Parameter layout per camera model (after id, model, w, h, f).
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": ("cx", "cy"),
    "PINHOLE": ("fl_y", "cx", "cy"),
    "SIMPLE_RADIAL": ("cx", "cy", "k1"),
    "RADIAL": ("cx", "cy", "k1", "k2"),
    "OPENCV": ("fl_y", "cx", "cy", "k1", "k2", "p1", "p2"),
}


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Camera list lines ``id MODEL w h f params...`` ('#' lines skipped);
    unknown fields default (fl_y = f, cx = w/2, cy = h/2, k* = p* = 0);
    angle_x = 2·atan(w / 2f), angle_y = 2·atan(h / 2 fl_y)."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    e = F.split("value", " ")
    model = e.getItem(1)
    w, h, f = (e.getItem(i).cast("double") for i in (2, 3, 4))

    def field(name, default):
        expr = default
        for m, names in CAMERA_MODELS.items():
            if name in names:
                expr = F.when(model == m, e.getItem(5 + names.index(name)).cast("double")).otherwise(expr)
        return expr

    df = raw.select(e.getItem(0).cast("long").alias("camera_id"), model.alias("model"), w.alias("w"), h.alias("h"),
                    f.alias("fl_x"), field("fl_y", f).alias("fl_y"), field("cx", w / 2).alias("cx"),
                    field("cy", h / 2).alias("cy"), field("k1", F.lit(0.0)).alias("k1"),
                    field("k2", F.lit(0.0)).alias("k2"), field("p1", F.lit(0.0)).alias("p1"),
                    field("p2", F.lit(0.0)).alias("p2"))
    return (df.withColumn("angle_x", F.atan(F.col("w") / (F.col("fl_x") * 2)) * 2)
            .withColumn("angle_y", F.atan(F.col("h") / (F.col("fl_y") * 2)) * 2))


def read_image_poses(spark: SparkSession, path: str, skip_early: int = 0) -> DataFrame:
    """Image list: non-comment lines numbered from 1; lines before
    ``skip_early*2`` skipped; odd lines are records
    ``id qw qx qy qz tx ty tz camera name...``.  Records are numbered inside
    byte ranges, carried on by one row per range."""
    lines = _ranged_lines(spark, path).withColumn("_t", F.trim("line"))
    kept = lines.where((F.length("_t") > 0) & ~F.col("_t").startswith("#"))
    num = running(kept, ["line_no"], {"i": (F.lit(1).cast("long"), "sum")}, bucket=F.col("_range"), partition_by=["path"])
    rec = num.where((F.col("i") >= skip_early * 2) & (F.col("i") % 2 == 1))
    e = F.split("_t", " ")
    return rec.select("path", e.getItem(0).cast("long").alias("image_id"),
                      *[e.getItem(k).cast("double").alias(n) for k, n in
                        enumerate(["qw", "qx", "qy", "qz", "tx", "ty", "tz"], start=1)],
                      e.getItem(8).cast("long").alias("camera_id"),
                      F.array_join(F.slice(e, F.lit(10), F.greatest(F.size(e), F.lit(1))), "_").alias("name"))


FRAMES_SCHEMA = ("camera_angle_x double, frames array<struct<file_path: string, "
                 "transform_matrix: array<array<double>>>>")


def read_frames(spark: SparkSession, path: str, schema: str = FRAMES_SCHEMA) -> DataFrame:
    """Frame metadata JSON -> one row per frame with its 4×4 matrix."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    return df.select(file_path().alias("path"), "camera_angle_x", F.posexplode("frames").alias("frame_no", "_f")) \
        .select("path", "camera_angle_x", "frame_no", "_f.file_path", "_f.transform_matrix")


def split_pose_rows(df: DataFrame, values: str) -> DataFrame:
    """17 numbers -> 3×5 pose (row-major), near, far."""
    v = F.col(values)
    pose = F.array(*[F.slice(v, 1 + 5 * r, 5) for r in range(3)])
    return df.withColumn("pose", pose).withColumn("near", F.element_at(v, 16)).withColumn("far", F.element_at(v, 17))


def pick_split_files(files: DataFrame, key: str, file: str, split: str,
                     prefixes: dict[str, str] | None = None) -> DataFrame:
    """Files of a split by name prefix ('0_' train, '1_' val, '2_' test); the
    test split falls back to '1_' for keys that have no '2_' file."""
    prefixes = prefixes or {"train": "0_", "val": "1_", "test": "2_"}
    f = F.col(file)
    if split != "test":
        return files.where(f.startswith(prefixes[split]))
    has_test = files.where(f.startswith(prefixes["test"])).select(key).distinct()
    direct = files.where(f.startswith(prefixes["test"]))
    fallback = files.where(f.startswith(prefixes["val"])).join(has_test, key, "left_anti")
    return direct.unionByName(fallback)


def listing(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """File inventory of a folder and all below it: path, name, size.

    Only paths and file status are read (the contents column is pruned), and
    the folder is listed by Spark's file index, so any store that it reads
    will do.  Order is left to the caller; an empty folder gives no row."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = df.select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size").toDF("path", "name", "size")
    return df.where(F.col("name").endswith(suffix)) if suffix else df


def write_folders(df: DataFrame, path: str, levels: Sequence[str]) -> str:
    """Text files in folders by ``levels``, for many folders: rows are dealt by
    folder to as many tasks as the session has partitions or cores, and each task
    moves its files to their place (committer version 2), not the driver one by one."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    df.repartition(tasks, *levels).write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2") \
        .partitionBy(*levels).text(path)
    return path


def folder_value(path: Column | str, key: str) -> Column:
    """Value of the folder level ``key=value`` in a path (null without one)."""
    got = F.regexp_extract(path, f"/{key}=([^/]+)/", 1)
    return F.when(got != "", F.call_function("url_decode", F.replace(got, F.lit("+"), F.lit("%2B"))))


def sorted_listing(files: DataFrame, folder: list[str], name: str = "name") -> DataFrame:
    """``files`` with ``place``, the 0-based place of the name in its folder's
    sorted listing (code-point order; a folder of any size, see ``plans.ordering``)."""
    return positions(files, folder, [name], "place")
