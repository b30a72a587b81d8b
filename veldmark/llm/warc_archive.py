"""WARC archives: writing, and reading back by boundary-chain verification.

Writing. Of pages with equal payloads of at least ``least_bytes``, the one
with the smallest id is a response, the others are revisits that refer to it
and carry no payload. Records are rows of Spark's text writer with CRLF CRLF
between them, so a part file is a WARC file and Spark's commit protocol
guards it.

Reading. Spark's text reader cuts archives at the magic ``WARC/1.0`` CRLF,
in splits, so a file of any size is read by many tasks. A task emits for each
magic a candidate: its offset and, by its Content-Length, that of its
successor. Offsets inside a split are made absolute by the lengths of the
splits before it; tasks also follow chains to where they leave the split.
Then the entries of splits are found from the file's start by pointer jumping
(jumps of jumps, doubling each round), and each split is walked from its
entries: magic inside a payload is no record unless the chain from the start
reaches it. Payloads that were cut at such a magic are joined again from the
pieces between two records; only then are they read a second time.

Defined cases: null html is an empty payload; a null id is written as "null",
ranks last and comes back as null; payloads under ``least_bytes`` are all
responses; equal rows with one id: one response, the others revisit it; a very long
payload is one row where it is written and read;
the header block of a record is at most what one row can hold; other columns
are ignored; no pages give an empty archive and an empty result. Bytes
outside the chain (a truncated last record, for example) are dropped.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Workspace

MAGIC = "WARC/1.0\r\n"
BETWEEN = "\r\n\r\n"
SALTS = 32
#: A fixed value: the profile of revisits in the WARC standard.
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, payload, digest, n_bytes, record_type and refers_to of each page. A payload that a third of all pages share is dealt over SALTS keys."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("n_bytes"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    equal = pages.select(F.col(id_col).alias("page_id"), payload.alias("payload")).where(F.octet_length("payload") >= least_bytes).groupBy(F.sha2("payload", 256).alias("digest"), "page_id").agg(F.count(F.lit(1)).alias("n"))
    # the smallest id, null last, and how many rows have it
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n")
    shared = equal.groupBy("digest").agg(F.min(order).alias("least"), F.sum("n").alias("copies")).where("copies > 1")
    shared = shared.select("digest", F.col("least.page_id").alias("first_id"), F.col("least.n").alias("n_first"), "copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = rows.join(shared, ["digest", "salt"], "left")
    return joined.withColumn("is_first", F.col("copies").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100, compression: str = "gzip") -> None:
    """Write one record for each page below path. compression: of whole files, or "none", which readers can split."""
    rows = classify(pages, id_col=id_col, html_col=html_col, least_bytes=least_bytes)
    # rows that repeat a first page's id and payload: all but one revisit it
    tie = "is_first and copies is not null and n_first > 1"
    if rows.where(tie).limit(1).count():
        nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy(F.lit(1)))
        rows = rows.where(f"not coalesce({tie}, false)").withColumn("nth", F.lit(1)).unionByName(rows.where(tie).withColumn("nth", nth))
    else:
        rows = rows.withColumn("nth", F.lit(1))
    revisit = F.col("copies").isNotNull() & (~F.col("is_first") | (F.col("nth") > 1))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    header = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name("page_id"), F.lit(">\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {SAME_DIGEST}\r\nWARC-Refers-To: <urn:page:"), name("first_id"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http-payload\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string")), F.lit("\r\n\r\n"),
    )
    rows.select(F.concat(header, F.when(revisit, "").otherwise(F.col("payload"))).alias("value")).write.mode("overwrite").option("lineSep", BETWEEN).option("compression", compression).text(path)


HEADER = re.compile(rb"(?im)^(WARC-Type|WARC-Record-ID|WARC-Payload-Digest|X-Payload-Length|WARC-Refers-To|Content-Length): *([^\r\n]*)")
PIECES = "file string, split long, mag long, len long, succ long, leave long, first long, size long, whole boolean, kind string, record string, digest string, full_len long, refers string, body_len long, body_sha256 string"
TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _table(rows: list[dict], schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], TYPES[t]) for n, t in names], [n for n, _ in names])


def _splits(batches):
    """file, split and the value and place of each piece, by split in order. Places count from the split's start; the magic stands before."""
    here, at = None, 0
    for batch in batches:
        for value, file, split in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "split")), strict=True):
            if (file, split) != here:
                here, at = (file, split), 0
            yield file, split, at - len(MAGIC), value or b""
            at += len(value or b"") + len(MAGIC)


def _piece(file: str, split: int, mag: int, value: bytes) -> dict:
    """What a piece says if it is a record; digests of payloads that lie in it whole."""
    head, gap, _ = value.partition(b"\r\n\r\n")
    found = {k.lower(): v.decode("utf-8", "replace") for k, v in HEADER.findall(head)} if gap else {}
    row = dict.fromkeys(x.split()[0] for x in PIECES.split(", "))
    row |= {"file": file, "split": split, "mag": mag, "len": len(value) + len(MAGIC), "first": len(head) + 4, "whole": False}
    size = found.get(b"content-length", "")
    if size.isdigit() and len(size) < 16:
        end = len(head) + 4 + int(size)
        full = found.get(b"x-payload-length", "")
        row |= {"size": int(size), "succ": mag + len(MAGIC) + end + len(BETWEEN), "whole": len(value) >= end, "kind": found.get(b"warc-type"), "record": found.get(b"warc-record-id"), "digest": found.get(b"warc-payload-digest"), "full_len": int(full) if full.isdigit() else None, "refers": found.get(b"warc-refers-to")}
        if row["whole"]:
            row |= {"body_len": int(size), "body_sha256": hashlib.sha256(value[row["first"] : end]).hexdigest()}
    return row


def _pieces(batches):
    """Candidates of each split, each with its successor and with where its chain leaves the split."""
    rows: list[dict] = []

    def resolved():
        leave: dict[int, int | None] = {}
        for r in reversed(rows):
            r["leave"] = leave.get(r["succ"], r["succ"])
            leave[r["mag"]] = r["leave"]
        return _table(rows, PIECES)

    for file, split, mag, value in _splits(batches):
        if rows and (rows[0]["file"], rows[0]["split"]) != (file, split):
            yield resolved()
            rows = []
        rows.append(_piece(file, split, mag, value))
    if rows:
        yield resolved()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def candidates(spark: SparkSession, path: str, work: Workspace) -> DataFrame:
    """Candidates with absolute offsets: off, succ and leave. The piece before a file's first magic is left out."""
    pieces = work.write(_lines(spark, path).mapInArrow(_pieces, PIECES), "pieces")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    start = pieces.groupBy("file", "split").agg(F.sum("len").alias("total")).withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    at = lambda c: (F.col(c) + F.col("start")).alias({"mag": "off"}.get(c, c))
    rest = [c for c in pieces.columns if c not in ("len", "succ", "leave")]
    found = work.write(pieces.join(start.drop("total"), ["file", "split"]).select(*rest, at("mag"), at("succ"), at("leave")).where("off >= 0"), "candidates")
    work.drop(pieces)
    return found


def entries(found: DataFrame, work: Workspace) -> DataFrame:
    """file, off of the first real record of each split, by pointer jumping from the file's start."""
    jumps = found.select("file", "off", F.col("leave").alias("to"))
    reached = work.write(jumps.where("off = 0").select("file", "off"), "reached")
    n = reached.count()
    while True:
        step = reached.join(jumps, ["file", "off"]).where("to is not null").select("file", F.col("to").alias("off"))
        new = work.write(reached.union(step.join(jumps, ["file", "off"], "left_semi")).distinct(), "reached")
        m = new.count()
        work.drop(reached)
        if m == n:
            return new
        reached, n = new, m
        on = jumps.select("file", F.col("off").alias("to"), F.col("to").alias("next"))
        jumps = work.write(jumps.join(on, ["file", "to"], "left").select("file", "off", F.col("next").alias("to")), "jumps")


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """Records of one split on the chain from its entries."""
    succ = dict(zip(group["off"], group["succ"], strict=True))
    real: set[int] = set()
    for off in group.loc[group["entry"], "off"]:
        while off in succ and off not in real:
            real.add(off)
            off = succ[off]
    return group.loc[group["off"].isin(list(real)), ["file", "off"]]


def reachable(found: DataFrame, work: Workspace) -> DataFrame:
    """file, off of all records on the chain from each file's start."""
    marked = found.select("file", "split", "off", "succ").join(entries(found, work).withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "split").applyInPandas(_walk, "file string, off long")


RAW = "file string, split long, mag long, raw binary"


def _raw_pieces(batches):
    rows: list[dict] = []
    held = 0
    for file, split, mag, value in _splits(batches):
        rows.append({"file": file, "split": split, "mag": mag, "raw": value})
        held += len(value)
        if held > 1 << 23:
            yield _table(rows, RAW)
            rows, held = [], 0
    if rows:
        yield _table(rows, RAW)


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("off")
    head = group.iloc[0]
    start, size = int(head["first"]), int(head["size"])
    body = MAGIC.encode().join(group["raw"])[start : start + size]
    return pd.DataFrame([{"file": head["file"], "off": head["off"], "body": body if len(body) == size else None}])


def read_archive(spark: SparkSession, path: str, *, bodies: bool = True) -> DataFrame:
    """kind, record, refers, digest and full_len (as the header has them), body_len and body_sha256 of each record below path, and with bodies its body."""
    work = Workspace(spark, "warc")
    found = candidates(spark, path, work)
    chain = work.write(reachable(found, work).withColumn("real", F.lit(True)), "chain")
    marked = found.join(chain, ["file", "off"], "left")
    own = ["kind", "record", "refers", "digest", "full_len", "body_len", "body_sha256"]
    whole = marked.where("real and whole")
    # records that a magic in their payload has cut: the pieces up to the next record belong to them
    last = F.max(F.when(F.col("real"), F.struct("off", "succ", "whole")))
    inside = last.over(Window.partitionBy("file", "split").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a record that is still open where its split begins is the last of the splits before: of a file only one row for each split meets in a task
    ends = marked.groupBy("file", "split").agg(last.alias("end"))
    before = ends.select("file", "split", F.max("end").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    parts = marked.select("file", "split", "mag", "off", "succ", "whole", "real", "first", "size").withColumn("inside", inside).join(before, ["file", "split"], "left")
    parts = parts.withColumn("owner", F.coalesce("inside", "open"))
    parts = work.write(parts.where("not owner.whole and off < owner.succ").select("file", "split", "mag", "off", "first", "size", F.col("owner.off").alias("owner")), "parts")
    raw = _lines(spark, path).mapInArrow(_raw_pieces, RAW)
    cut = None
    if parts.limit(1).count():  # only then are payloads read again
        bodies_of = raw.join(parts, ["file", "split", "mag"]).groupBy("file", "owner").applyInPandas(_joined, "file string, off long, body binary").where("body is not null")
        cut = found.drop("body_len", "body_sha256").join(bodies_of, ["file", "off"]).select("*", F.octet_length("body").cast("bigint").alias("body_len"), F.sha2("body", 256).alias("body_sha256"))
    if not bodies:
        out = whole.select(*own)
        return out.unionByName(cut.select(*own)) if cut is not None else out
    out = whole.join(raw, ["file", "split", "mag"]).select(*own, F.expr("substring(raw, int(first + 1), int(size))").alias("body"))
    return out.unionByName(cut.select(*own, "body")) if cut is not None else out


def archive_report(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record that was read back: responses by their payload, revisits by what their header says of it."""
    rows = read_archive(spark, path, bodies=False)
    of = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("null")).try_cast(id_type)
    response = F.col("kind") == "response"
    return rows.select(
        of(F.col("record")).alias("page_id"), F.when(response, F.col("body_len")).otherwise(F.col("full_len")).alias("payload_bytes"),
        F.when(response, F.col("body_sha256")).otherwise(F.regexp_replace("digest", "^sha256:", "")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(~response, of(F.col("refers"))).alias("refers_to"),
        (~response | (F.concat(F.lit("sha256:"), "body_sha256") == F.col("digest"))).alias("digest_agrees"),
    )


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = Workspace(spark, "warc").path("archive")
    write_archive(pages, path)
    return archive_report(spark, path, dict(pages.dtypes)["page_id"])


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, cast(payload_bytes as bigint) as payload_bytes, d.payload_digest,
  case when first_id is null or d.page_id = first_id then 'response' else 'revisit' end as record_type,
  case when d.page_id <> first_id then first_id end as refers_to, true as digest_agrees
from d left join f using (payload_digest)
"""
