"""Operator 10. WARC archives with boundary-chain verification.

Writing: pages with equal payloads of at least REVISIT_BYTES share one response record (of the smallest page_id); the others become revisit
records with an empty block. The text writer puts records end to end, so each task's file is a WARC file.

Reading: the text reader cuts files, also within one file, at the version line. Each segment is a candidate record: its byte offset
follows from the lengths before it, its successor's offset from its Content-Length. A version line inside a payload gives a false
candidate. Inside each block of a file pointer jumping contracts a candidate to its exit from the block; the few exits are followed from
the file's start; the true entry of each block then marks the reachable records. What isn't reachable is payload, and is glued back.

Null html is an empty payload. An empty table gives no archives and no rows. A repeated row (page_id and payload) repeats the response,
so both are responses. A null page_id is written as none and counts as the largest: it revisits a response if there is one. Payloads of any length
up to Spark's 2 GB a value are written and read whole. Extra columns, whatever their names, are left out. `query` fails if a payload that was read
back differs from the digest written with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialise, new_path, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 100
#: Up to so many digests that occur twice (about 100 bytes each) their table is broadcast, and payloads stay where they are; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
#: Names of archives that go into a filter.
FEW = 200


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, refers_to); refers_to is null for responses. The group's smallest id is found from digests alone, and only digests that occur twice are joined."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = p.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialise(first, "digests")
    if first.count() <= broadcast_rows:
        first = F.broadcast(first)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id"))
    return p.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "payload_bytes", refers.alias("refers_to"))


def write_archives(rec: DataFrame, path: str) -> None:
    """One WARC file a task, by Spark's text writer."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit("none")), F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.col("url"), r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", F.col("payload_bytes")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to"), F.lit(">")))).otherwise(""), F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"),
    )
    rec.select(F.concat(head, F.lit(END), F.when(revisit, "").otherwise(F.col("payload"))).alias("value")).write.option("lineSep", END).text(path)


_JUMP = "file string, block long, m long, succ long, leave long"


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pointer jumping in one block of a file: each candidate's first offset outside the block's candidates."""
    pdf = pdf.sort_values("m", kind="stable")
    m, succ = pdf["m"].to_numpy(), pdf["succ"].to_numpy()
    at = np.minimum(np.searchsorted(m, succ), len(m) - 1)
    inside = m[at] == succ
    jump = np.where(inside, at, np.arange(len(m)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return pdf.assign(leave=succ[jump])[["file", "block", "m", "succ", "leave"]]


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the file's start along the blocks' exits: the true entries."""
    leave, at, seen = dict(zip(pdf["m"], pdf["leave"], strict=True)), 0, []
    while at in leave:
        seen.append(at)
        at = leave[at]
    return pd.DataFrame({"file": pdf["file"].iloc[0] if len(pdf) else None, "m": np.array(seen, np.int64)})


def _mark(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Records of a block that its true entry reaches."""
    if not len(left) or not len(right):
        return pd.DataFrame({"file": pd.Series(dtype=str), "m": pd.Series(dtype="int64")})
    left = left.sort_values("m", kind="stable")
    m, succ = left["m"].to_numpy(), left["succ"].to_numpy()
    at = np.minimum(np.searchsorted(m, succ), len(m) - 1)
    jump = np.where(m[at] == succ, at, np.arange(len(m)))
    good = np.isin(m, right["m"].to_numpy())
    while True:  # the set reached doubles its depth each time
        more = good.copy()
        more[jump[good]] = True
        if (more == good).all():
            break
        good, jump = more, jump[jump]
    return pd.DataFrame({"file": key[0], "m": m[good]})


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records: file, block (start of the reader's split), m (byte offset of the version line), header fields, succ, and whether the record ends with its segment."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    head = F.substring_index("value", END, 1)
    body = F.octet_length(head) + len(END)
    size = F.octet_length("value").cast("long")
    field = lambda name, what: F.nullif(F.regexp_extract(F.col("head"), rf"(?m)^{name}: {what}\r?$", 1), F.lit(""))
    s = raw.select("file", "block", "i", "value", head.alias("head"), body.cast("long").alias("body"), size.alias("size"))
    s = s.withColumn("length", field("Content-Length", r"(\d+)").try_cast("long"))
    whole = F.col("body") + F.col("length") + len(END) == F.col("size")
    payload = F.when(whole, F.substring(F.col("value").cast("binary"), F.col("body").cast("int") + 1, F.col("length").cast("int")))
    s = s.select(
        "file", "block", "i", "size", "body", "length", whole.alias("whole"), "value", payload.alias("payload"), field("WARC-Type", r"(\w+)").alias("record_type"), field("WARC-Record-ID", r"<urn:page:(\d+)>").try_cast("long").alias("page_id"),
        field("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("said_digest"), field("WARC-Payload-Length", r"(\d+)").try_cast("long").alias("said_bytes"), field("WARC-Refers-To", r"<urn:page:(\d+)>").try_cast("long").alias("refers_to"),
    )
    return s


def _located(s: DataFrame) -> DataFrame:
    """Adds m and succ. Lengths are summed within a block, then over a file's blocks."""
    step = F.col("size") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("i")
    totals = s.groupBy("file", "block").agg(F.sum(step).alias("t"))
    over = Window.partitionBy("file").orderBy("block")
    base = totals.select("file", "block", (F.sum("t").over(over) - F.col("t")).alias("base"))
    s = s.withColumn("before", F.sum(step).over(inside) - step).join(base, ["file", "block"])
    s = s.withColumn("m", F.col("base") + F.col("before") - len(MAGIC)).where("m >= 0")  # what stands before the first version line is no record
    return s.withColumn("succ", F.col("m") + len(MAGIC) + F.col("body") + F.col("length") + len(END)).drop("base", "before", "i")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The true records: page_id, record_type, refers_to, payload_bytes, payload_digest (of the payload as read for responses, as declared for revisits), digest_ok."""
    digest, n = F.sha2("payload", 256), F.octet_length("payload").cast("long")
    found = materialise(_located(segments(spark, path).withColumn("read_digest", digest).withColumn("read_bytes", n).drop("payload", "value")), "segments")
    good = materialise(reachable(found), "records")
    r = found.join(good, ["file", "m"], "left_semi")
    revisit = F.col("record_type") == "revisit"
    out = lambda d: d.select("page_id", "record_type", "refers_to", F.when(revisit, F.col("said_bytes")).otherwise(F.col("read_bytes")).alias("payload_bytes"), F.when(revisit, F.col("said_digest")).otherwise(F.col("read_digest")).alias("payload_digest"), F.when(revisit, F.lit(True)).otherwise(F.col("read_digest") == F.col("said_digest")).alias("digest_ok"))
    cut = r.where("NOT whole").select("file").distinct()
    if cut.isEmpty():
        return out(r)
    return out(r.where("whole")).unionByName(out(_glue(spark, path, cut, good).withColumn("read_digest", digest).withColumn("read_bytes", n)))


def reachable(found: DataFrame) -> DataFrame:
    """(file, m) of candidates that the chain from the file's start reaches."""
    chain = found.where("length IS NOT NULL").select("file", "block", "m", "succ")
    jumps = chain.groupBy("file", "block").applyInPandas(_contract, _JUMP)
    targets = jumps.select("file", F.col("leave").alias("m")).distinct().unionByName(jumps.where("m = 0").select("file", "m")).distinct()
    entries = jumps.join(targets, ["file", "m"]).select("file", "block", "m", "leave").groupBy("file").applyInPandas(_follow, "file string, m long")
    placed = entries.toDF("f", "e").join(chain.toDF("f", "b", "e", "s"), ["f", "e"]).select("f", "b", "e").toDF("file", "block", "m")
    return chain.groupBy("file", "block").cogroup(placed.groupBy("file", "block")).applyInPandas(_mark, "file string, m long")


def _glue(spark: SparkSession, path: str, cut: DataFrame, good: DataFrame) -> DataFrame:
    """Records whose payload holds version lines: payloads put together from the segments up to the successor. Up to FEW files with such records are named to the scan, which reads no others; more are joined."""
    s, names = segments(spark, path).drop("payload"), [x[0] for x in cut.limit(FEW + 1).collect()]
    s = s.where(F.col("file").isin(names)) if len(names) <= FEW else s.join(cut, "file", "left_semi")
    s = _located(s).join(good.withColumn("hit", F.lit(True)), ["file", "m"], "left")
    s = s.where("NOT whole OR hit IS NULL").withColumn("owner", F.last(F.when(F.col("hit"), F.col("m")), ignorenulls=True).over(Window.partitionBy("file").orderBy("m")))
    fields = ["record_type", "page_id", "said_digest", "said_bytes", "refers_to", "body", "length"]
    g = s.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("p"), *[F.min_by(c, "m").alias(c) for c in fields])
    whole = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).cast("binary")
    return g.select(*fields, F.substring(whole, F.col("body").cast("int") + 1, F.col("length").cast("int")).alias("payload"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(records(pages), path)
    return read_archives(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = round_trip(table(spark, sf_dir, "pages"))
    digest = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    return r.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, sha256(t) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to FROM f
"""
