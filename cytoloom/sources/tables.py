"""Scans and sinks: O001 to O020."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import FEATURES, query
from .scratch import new_path


def cell_exports(spark: SparkSession, path: str, aliases: dict[str, list[str]], numeric: list[str], required: list[str]) -> DataFrame:
    """O001, O002, O011: tab-delimited exports, read as text; headers lose white space and byte-order marks and are matched without case against aliases; rows without a required value go; the file and its folder are stamped."""
    df = spark.read.option("sep", "\t").option("header", True).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).csv(path)
    clean = {c.replace("﻿", "").strip().lower(): c for c in df.columns}
    cols = []
    for name, others in aliases.items():
        have = next((clean[a.lower()] for a in [name, *others] if a.lower() in clean), None)
        c = F.col(f"`{have}`") if have else F.lit(None).cast("string")
        cols.append((c.try_cast("double") if name in numeric else c).alias(name))
    file = F.col("_metadata.file_path")
    out = df.select(*cols, file.alias("source_file"), F.element_at(F.split(file, "/"), -2).alias("algorithm_id"))
    return out.dropna(subset=required)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """O004, O007: by suffix parquet, orc, json, tsv/txt or csv; of the columns asked for those that exist."""
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1]
    if kind in ("tsv", "txt", "csv"):
        df = spark.read.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(path)
    else:
        df = spark.read.format({"parquet": "parquet", "orc": "orc", "json": "json"}[kind]).load(path)
    return df.select([c for c in columns if c in df.columns]) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """O007, O015, O016: the counterpart of read_table; refuses to overwrite."""
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1]
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if kind in ("tsv", "txt", "csv"):
        w.option("header", True).option("sep", "," if kind == "csv" else "\t").option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)
    else:
        w.format({"parquet": "parquet", "orc": "orc", "json": "json"}[kind]).save(path)
    return path


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """O008: UTF-8 unless a replacement character appears in it, else Windows-1252: read as ISO-8859-1, whose control characters then become that code page's."""
    read = lambda e: spark.read.option("header", True).option("encoding", e).csv(path)
    df = read("UTF-8")
    if df.where(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns]).contains("\ufffd")).isEmpty():
        return df
    here = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]
    a, b = "".join(map(chr, here)), bytes(here).decode("cp1252")
    df = read("ISO-8859-1")
    return df.select(*[F.translate(F.col(f"`{c}`"), a, b).alias(c.translate(str.maketrans(a, b))) for c in df.columns])


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """O009, O014: many parquet folders as one table with source_file; missing columns are null."""
    out = None
    for p in paths:
        x = spark.read.parquet(p)
        x = x.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def chunk_of(df: DataFrame, key: str, size: int) -> DataFrame:
    """O016: chunk number by sorted distinct key. Keys are ranked apart from the rows."""
    k = df.select(key).distinct().withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("int") + 1)
    return df.join(k, key)


def save_config(spark: SparkSession, config: dict, path: str) -> DataFrame:
    """O017, O019: a run's configuration as one JSON row, read back."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.text(path)
    return spark.read.option("multiLine", True).json(path)


def backfill(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """O020: canonical columns, each from the first alias with a value; null where there is none."""
    pick = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(*[pick([c, *names]).alias(c) for c, names in columns.items()])


def cohort_prefix(path: Column, known: list[str]) -> Column:
    """O002: what stands before `_Core[` in a file's name, less a trailing ` (n)`; of known prefixes the first that it starts with, else null."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.trim(F.regexp_replace(F.split(name, r"_Core\[")[0], r" \(\d+\)$", ""))
    return F.when(name.contains("_Core["), F.coalesce(*[F.when(stem.startswith(k), F.lit(k)) for k in known], F.lit(None).cast("string")))


def core_key(path: Column, suffix: str) -> Column:
    """O002: a file's name less a suffix; null if it has another one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix)))


def files_of(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """O002, O009: files below a folder whose names match, by Spark's own listing (no content is read): file, modified, bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return f.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def bundle_index(files: DataFrame, kinds: list[str], column: str = "file") -> DataFrame:
    """O009: result bundles: files named <key>__<kind>.csv by key, whether each kind is there, and how many files repeat a kind. Of repeated ones the first path counts."""
    name = F.element_at(F.split(F.col(column), "/"), -1)
    pattern = rf"^(.+)__({'|'.join(kinds)})\.csv$"
    f = files.where(name.rlike(pattern)).select(F.regexp_extract(name, pattern, 1).alias("bundle"), F.regexp_extract(name, pattern, 2).alias("kind"), F.col(column).alias("file"))
    one = f.groupBy("bundle", "kind").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"))
    return one.groupBy("bundle").agg(*[F.max(F.when(F.col("kind") == k, F.col("file"))).alias(k) for k in kinds], F.sum(F.col("n") - 1).alias("n_duplicates"), (F.count(F.lit(1)) == len(kinds)).alias("complete"))


def standardise(df: DataFrame, targets: dict[str, list[str]], coalesced: set[str] = frozenset(), numeric: set[str] = frozenset(), inferred: dict[str, Column] | None = None) -> DataFrame:
    """O011: each target from the first alias that is a column (matched without case), or row by row from all of them for `coalesced` ones; else from `inferred`; else null. Numeric targets become null where they are no number."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, aliases in targets.items():
        found = [F.col(f"`{have[x.lower()]}`") for x in [name, *aliases] if x.lower() in have]
        found = [c.cast("string").try_cast("double") if name in numeric else c.cast("string") for c in found]
        use = found if name in coalesced else found[:1]
        guess = (inferred or {}).get(name, F.lit(None))
        out.append(F.coalesce(*use, guess.cast("double" if name in numeric else "string")).alias(name))
    return df.select(*out)


def write_parts(df: DataFrame, path: str, rows_per_file: int = 1_000_000, merge: bool = False) -> bool:
    """O015: parquet parts of at most rows_per_file rows, or one file; done before, nothing is written (a folder with Spark's success mark is done, one without it is an error). Returns whether it wrote."""
    spark = df.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return False
    (df.coalesce(1) if merge else df).write.mode("errorifexists").option("maxRecordsPerFile", 0 if merge else rows_per_file).parquet(path)
    return True


@query("o002_file_names", "WITH f AS (SELECT c_custkey, 'runs/a/' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' (2)' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '_slide' ELSE '_Core[1,' || c_nationkey || ',B]' END || '_[100,20]' || CASE WHEN c_custkey % 7 = 0 THEN '.log' ELSE '_cells.txt' END AS p FROM customer) SELECT c_custkey, CASE WHEN contains(p, '_Core[') THEN CASE WHEN p LIKE 'runs/a/BUILD%' THEN 'BUILD' WHEN p LIKE 'runs/a/MACHINERY%' THEN 'MACHINERY' END END AS cohort, CASE WHEN p LIKE '%_cells.txt' THEN left(p[8:], length(p) - 17) END AS core FROM f")
def _o002(t):
    n = F.col("c_custkey")
    p = F.concat(F.lit("runs/a/"), "c_mktsegment", F.when(n % 3 == 0, " (2)").otherwise(""), F.when(n % 5 == 0, "_slide").otherwise(F.concat(F.lit("_Core[1,"), F.col("c_nationkey").cast("string"), F.lit(",B]"))), F.lit("_[100,20]"), F.when(n % 7 == 0, ".log").otherwise("_cells.txt"))
    return t("customer").withColumn("p", p).select("c_custkey", cohort_prefix(F.col("p"), ["BUILD", "MACHINERY"]).alias("cohort"), core_key(F.col("p"), "_cells.txt").alias("core"))


@query("o009_bundle_index", "WITH k AS (SELECT s_suppkey, unnest(['summary', 'folds', 'oof']) AS kind FROM supplier), f AS (SELECT 'x/ctx' || s_suppkey || '__' || kind || '.csv' AS file, 'ctx' || s_suppkey AS bundle, kind FROM k WHERE NOT (kind = 'oof' AND s_suppkey % 4 = 0) UNION ALL SELECT 'y/ctx' || s_suppkey || '__folds.csv', 'ctx' || s_suppkey, 'folds' FROM supplier WHERE s_suppkey % 3 = 0) SELECT bundle, min(file) FILTER (WHERE kind = 'summary') AS summary, min(file) FILTER (WHERE kind = 'folds') AS folds, min(file) FILTER (WHERE kind = 'oof') AS oof, (count(*) - count(DISTINCT kind))::BIGINT AS n_duplicates, count(DISTINCT kind) = 3 AS complete FROM f GROUP BY 1")
def _o009(t):
    s, kinds = t("supplier"), ["summary", "folds", "oof"]
    name = lambda top, k: F.concat(F.lit(f"{top}/ctx"), F.col("s_suppkey").cast("string"), F.lit("__"), k, F.lit(".csv")).alias("file")
    every = s.select("s_suppkey", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).where("NOT (kind = 'oof' AND s_suppkey % 4 = 0)").select(name("x", F.col("kind")))
    return bundle_index(every.unionByName(s.where("s_suppkey % 3 = 0").select(name("y", F.lit("folds")))).unionByName(s.select(F.lit("z/readme.txt").alias("file"))), kinds)


@query("o011_standardise", "SELECT c_custkey::VARCHAR AS patient, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, c_nationkey) AS metric, 'ctx' AS context, NULL::DOUBLE AS absent, TRY_CAST(c_mktsegment AS DOUBLE) AS odd FROM customer")
def _o011(t):
    c = t("customer").select(F.col("c_custkey").alias("Patient_ID"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("oof_auc"), F.col("c_nationkey").alias("AUC"), F.col("c_mktsegment").alias("odd"))
    return standardise(c, {"patient": ["patient_id", "id"], "metric": ["oof_auc", "auc"], "context": [], "absent": ["nowhere"], "odd": []}, {"metric"}, {"metric", "absent", "odd"}, {"context": F.lit("ctx")})


@query("o015_part_sink", "SELECT s_suppkey, s_name FROM supplier")
def _o015(t):
    path, s = new_path(t.spark, "parts"), t("supplier").select("s_suppkey", "s_name")
    if not write_parts(s, path, 10) or write_parts(s.where("false"), path):
        raise RuntimeError("a finished sink was written again")
    return t.spark.read.parquet(path)


@query("o001_cell_export_scan", "SELECT event_id AS cell_id, user_id AS sample_name, value AS x FROM events WHERE event_id % 10 <> 0")
def _o001(t):
    e = t("events").select(F.col("event_id").cast("string").alias("﻿Cell ID "), F.col("user_id").alias("Sample Name"), F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias(" Cell X Position"))
    path = write_table(e, new_path(t.spark, "export") + "/core/calls.tsv")
    return cell_exports(t.spark, path.rsplit("/", 2)[0], {"cell_id": ["Cell ID"], "sample_name": ["Sample Name"], "x": ["Cell X Position"], "y": []}, ["x", "y"], ["cell_id", "x"]).select(F.col("cell_id").cast("long"), F.col("sample_name").cast("long"), "x")


@query("o004_projection_fallback", "SELECT s_suppkey, s_acctbal FROM supplier")
def _o004(t):
    return read_table(t.spark, f"{t.sf_dir}/supplier.parquet", ["s_suppkey", "no_such_column", "s_acctbal"])


@query("o007_format_round_trip", "SELECT s_suppkey, s_name, 'csv.gz' AS kind FROM supplier UNION ALL SELECT s_suppkey, s_name, 'tsv' FROM supplier UNION ALL SELECT s_suppkey, s_name, 'orc' FROM supplier UNION ALL SELECT s_suppkey, s_name, 'json' FROM supplier")
def _o007(t):
    s, out = t("supplier").select("s_suppkey", "s_name"), None
    for kind in ("csv.gz", "tsv", "orc", "json"):
        x = read_table(t.spark, write_table(s, f"{new_path(t.spark, 'format')}/s.{kind}")).select(F.col("s_suppkey").cast("long"), "s_name", F.lit(kind).alias("kind"))
        out = x if out is None else out.unionByName(x)
    return out


@query("o008_tolerant_csv", "SELECT s_suppkey, 'caf' || chr(233) || chr(8364) || s_nationkey AS v FROM supplier")
def _o008(t):
    path = new_path(t.spark, "latin")
    s = t("supplier").select("s_suppkey", F.concat(F.lit("café\x80"), F.col("s_nationkey").cast("string")).alias("v"))
    s.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_tolerant(t.spark, path).select(F.col("s_suppkey").cast("long"), "v")


@query("o014_recursive_union", "SELECT s_nationkey AS key, s_acctbal AS balance, NULL AS extra, 'a' AS source_file FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment, 'b' FROM customer")
def _o014(t):
    root = new_path(t.spark, "many")
    t("supplier").select(F.col("s_nationkey").alias("key"), F.col("s_acctbal").alias("balance")).write.parquet(f"{root}/a")
    t("customer").select(F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("extra")).write.parquet(f"{root}/b")
    return read_many(t.spark, [f"{root}/a", f"{root}/b"])


@query("o016_chunk_writer", "SELECT chunk::INT AS chunk, cohort, count(*) AS n FROM (SELECT o_orderkey, o_orderstatus AS cohort, (dense_rank() OVER (ORDER BY o_custkey) - 1) // 100 + 1 AS chunk FROM orders) GROUP BY ALL")
def _o016(t):
    o = chunk_of(t("orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("cohort")), "o_custkey", 100)
    path = write_table(o.repartition("cohort", "chunk"), new_path(t.spark, "chunks") + "/prep.parquet", ["cohort", "chunk"])
    return t.spark.read.parquet(path).groupBy("chunk", "cohort").agg(F.count(F.lit(1)).alias("n"))


def array_index(contexts: DataFrame, keys: list[str]) -> DataFrame:
    """O017: a manifest of the work to do: array_id from 0 over the sorted different contexts, with the rows of each. Contexts are numbered apart from the rows."""
    n = contexts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("array_id", F.row_number().over(Window.orderBy(*keys)) - 1).select("array_id", *keys, "n_rows")


@query("o017_run_config", "SELECT row_number() OVER (ORDER BY p_brand, p_type)::INT - 1 AS array_id, p_brand, p_type, n_rows, 10::BIGINT AS k_max, 'screen' AS name, 0.9::DOUBLE AS near FROM (SELECT p_brand, p_type, count(*) AS n_rows FROM part GROUP BY ALL)")
def _o017(t):
    """The manifest of the parts' brands and types and the run's configuration, each written and read back."""
    config = save_config(t.spark, {"name": "screen", "k_max": 10, "near": 0.9}, new_path(t.spark, "config"))
    m = t.spark.read.parquet(write_table(array_index(t("part"), ["p_brand", "p_type"]), new_path(t.spark, "manifest") + "/m.parquet"))
    return m.join(F.broadcast(config), F.lit(True))  # one row


@query("o018_square_matrix", f"WITH {FEATURES}, f AS (SELECT feature, round(avg(value), 6) AS m FROM features GROUP BY 1) SELECT a.feature AS uid_a, b.feature AS uid_b, a.m * b.m AS value FROM f a, f b")
def _o018(t):
    f = t.features().groupBy("feature").agg(F.round(F.avg("value"), 6).alias("m"))
    g = f.select(F.col("feature").alias("uid_b"), F.col("m").alias("mb"))
    sq = f.crossJoin(F.broadcast(g)).select(F.col("feature").alias("uid_a"), "uid_b", (F.col("m") * F.col("mb")).alias("value"))
    return t.spark.read.parquet(write_table(sq, new_path(t.spark, "square") + "/m.parquet"))


@query("o020_backfill", "SELECT coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' END), ''), c_mktsegment) AS coord, c_custkey::VARCHAR AS cell_id, NULL::VARCHAR AS panel FROM customer")
def _o020(t):
    c = t("customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, " ").alias("sample_name"), F.col("c_mktsegment").alias("region_id"), F.col("c_custkey").alias("id"))
    return backfill(c, {"coord": ["sample_name", "region_id", "core_key"], "cell_id": ["id"], "panel": []})
