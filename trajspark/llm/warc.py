"""Writing web pages as WARC archives, and reading archives with a verified chain of record boundaries.

Writing: each page is one record. Pages with equal payloads (of `least` bytes at least) are written once, as the response
of the smallest page id, and as revisits elsewhere. Spark's text sink writes the files, with the record trailer as its
line separator, so commits and retries are Spark's own and any file system will do.

Reading: Spark's text source splits the files at the magic bytes, wherever those stand. Every piece that parses as a
header is a candidate record, which names the offset of its successor. Adjacent candidates that name each other, and
that nothing else names, are contracted to runs; pointer jumping from each file's start then finds the runs that can be
reached. What can't be reached is magic inside a payload: it goes back into the payload of the record that covers it.

Defined results: a null payload is empty; a null URL or page id has no header. Rows that repeat a page id give a record
each. A file that doesn't start with a record has no records; records behind a broken length are not reached. An empty
table gives an empty archive and an empty result. Columns of pages other than id, url and payload are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, small

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_SHARED = 100


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", page.cast("string"), digest))
    cut = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = LEAST_SHARED,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Writes a record for each row of pages under path."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.regexp_replace(url_col, r"[\x00-\x20\x7F]", "").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    shared = materialize(
        rows.where(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.min("page").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "shared",
    )
    rows = rows.join(small(shared), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        _header("Content-Length", F.col("bytes")),
        F.lit("\r\n"),
    )
    block = F.when(again, F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _record_id(F.col("page"), F.col("digest"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("X-Page-Id", F.col("page")),
        _header("X-Payload-Length", F.col("bytes")),
        _header("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(again, _record_id(F.col("first"), F.col("digest")))),
        _header("X-Refers-To-Page-Id", F.when(again, F.col("first"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    rows.withColumn("http", http).withColumn("block", block).select(
        F.concat(head, "block").alias("value")
    ).write.option("lineSep", END).text(path)


def _field(head: Column, name: str, pattern: str = r"[^\r\n]*?") -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*({pattern})[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magics: file, split, place in reading order, and the text."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        )
    )


def _parsed(pieces: DataFrame, payload: bool) -> DataFrame:
    """The pieces with their header fields; digests instead of texts, unless a text is needed later."""
    head = F.substring_index("value", END, 1)
    body = F.expr("substring(cast(value AS binary), octet_length(head) + 5, int(content_length))")
    whole = F.octet_length("value") == F.octet_length("head") + 4 + F.col("content_length") + 4
    df = pieces.withColumn("head", head).withColumn(
        "content_length", _field(F.col("head"), "Content-Length", r"\d{1,18}").cast("long")
    )
    df = df.withColumns({"bytes": F.octet_length("value").cast("long"), "head_bytes": F.octet_length("head").cast("long")})
    df = df.withColumn("whole", F.coalesce(whole, F.lit(False)))
    return _described(df.withColumn("block", F.when(F.col("whole"), body.cast("string"))), payload).withColumn(
        "value", F.when(~F.col("whole"), F.col("value"))
    )


def _described(df: DataFrame, payload: bool) -> DataFrame:
    """Record columns from `head` and `block`."""
    http = F.octet_length(F.substring_index("block", END, 1)) + 5
    is_http = F.coalesce(_field(F.col("head"), "Content-Type").startswith("application/http"), F.lit(False))
    start = F.when(is_http, http).otherwise(F.lit(1))
    inner = F.expr("substring(cast(block AS binary), body_at, octet_length(block))")
    df = df.withColumns(
        {
            "record_type": _field(F.col("head"), "WARC-Type"),
            "record_id": _field(F.col("head"), "WARC-Record-ID"),
            "url": _field(F.col("head"), "WARC-Target-URI"),
            "page_id": _field(F.col("head"), "X-Page-Id", r"-?\d{1,19}").cast("long"),
            "refers_to": _field(F.col("head"), "X-Refers-To-Page-Id", r"-?\d{1,19}").cast("long"),
            "told_digest": F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha256:", ""),
            "told_bytes": _field(F.col("head"), "X-Payload-Length", r"\d{1,18}").cast("long"),
            "body_at": start,
        }
    )
    df = df.withColumn("payload", inner)
    revisit = F.col("record_type") == "revisit"
    df = df.withColumns(
        {
            "payload_bytes": F.when(revisit, F.col("told_bytes")).otherwise(F.octet_length("payload").cast("long")),
            "payload_digest": F.when(revisit, F.col("told_digest")).otherwise(F.sha2("payload", 256)),
        }
    )
    return df.drop("block", "body_at", "told_digest", "told_bytes", *([] if payload else ["payload"]))


FIELDS = ("record_type", "record_id", "url", "page_id", "refers_to", "payload_bytes", "payload_digest")


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """offset: where the piece's magic stands in its file (-10 for what comes before the first magic)."""
    size = F.col("bytes") + F.lit(len(MAGIC))
    splits = pieces.groupBy("file", "split").agg(F.sum(size).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("inner", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(starts, ["file", "split"])
        .withColumn("offset", F.col("start") + F.col("inner") - F.lit(len(MAGIC)))
        .drop("start", "inner")
    )


def _reached(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, split, place, offset, next) on the chain from each file's start."""
    named = candidates.groupBy("file", F.col("next").alias("offset")).agg(F.count("*").alias("named"))
    order = Window.partitionBy("file", "split").orderBy("place")
    linked = candidates.join(named, ["file", "offset"], "left").withColumn(
        "new", F.coalesce((F.lag("next").over(order) != F.col("offset")) | (F.col("named") != 1), F.lit(True))
    )
    linked = materialize(linked.withColumn("run", F.sum(F.col("new").cast("int")).over(order)), "candidates")
    runs = linked.groupBy("file", "split", "run").agg(
        F.min("offset").alias("head"), F.max(F.struct("offset", "next"))["next"].alias("to")
    )
    runs = materialize(runs, "runs")
    jump = runs.select("file", "head", "to")
    known = jump.where("head = 0").select("file", "head")
    count = -1
    while (n := known.count()) != count:
        count = n
        more = known.join(jump, ["file", "head"]).select("file", F.col("to").alias("head"))
        more = more.join(runs.select("file", "head"), ["file", "head"], "left_semi")
        known = materialize(known.unionByName(more).distinct(), "reached")
        ahead = jump.select("file", F.col("head").alias("to"), F.col("to").alias("further"))
        jump = materialize(
            jump.join(ahead, ["file", "to"]).select("file", "head", F.col("further").alias("to")), "jump"
        )
    good = runs.join(known, ["file", "head"], "left_semi").select("file", "split", "run")
    return linked.join(good, ["file", "split", "run"], "left_semi").select("file", "offset")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(file, offset, record_type, record_id, url, page_id, refers_to, payload_bytes, payload_digest[, payload]).

    A row for each record that the chain of boundaries from its file's start reaches.
    """
    pieces = materialize(_with_offsets(_parsed(_pieces(spark, path), payload)), "pieces")
    fields = [*FIELDS, *(["payload"] if payload else [])]
    after = F.col("offset") + len(MAGIC) + F.col("head_bytes") + 4 + F.col("content_length") + 4
    candidates = pieces.where("offset >= 0 and content_length is not null and head_bytes < bytes").select(
        "file", "split", "place", "offset", after.alias("next")
    )
    reached = materialize(_reached(candidates), "reached")
    plain = pieces.where("whole").join(reached, ["file", "offset"], "left_semi").select("file", "offset", *fields)
    # records whose payload holds magic: put the pieces that they cover together again
    broken = pieces.where("not whole").join(reached, ["file", "offset"], "left_semi").select("file", "offset")
    broken = materialize(broken, "broken")
    if broken.isEmpty():
        return plain
    inside = pieces.where("offset >= 0").join(reached, ["file", "offset"], "left_anti")
    parts = inside.select("file", "split", "place", "offset", "value", F.lit(None).cast("long").alias("owner"))
    parts = parts.unionByName(
        pieces.join(broken, ["file", "offset"], "left_semi").select(
            "file", "split", "place", "offset", "value", F.col("offset").alias("owner")
        )
    )
    upto = Window.partitionBy("file").orderBy("offset")
    parts = parts.withColumn("owner", F.last("owner", ignorenulls=True).over(upto)).where("owner is not null")
    parts = materialize(parts, "parts")
    # texts that weren't kept are read once more, by their place in the file, which doesn't depend on how reads are split
    missing = materialize(parts.where("value is null").select("file", "offset"), "missing")
    files = materialize(missing.select("file").distinct(), "files")
    again = _pieces(spark, path).join(small(files), "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long"))
    texts = _with_offsets(again).select("file", "offset", F.col("value").alias("again")).join(small(missing), ["file", "offset"], "left_semi")
    lost = F.raise_error(F.concat(F.lit("no piece at "), F.col("offset").cast("string"), F.lit(" in "), F.col("file")))
    full = parts.join(texts, ["file", "offset"], "left").select(
        "file", "owner", "offset", F.coalesce("value", "again", lost.cast("string")).alias("value")
    )
    joined = full.groupBy("file", F.col("owner").alias("offset")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC
        ).alias("value")
    )
    joined = joined.withColumn("head", F.substring_index("value", END, 1)).withColumn(
        "content_length", _field(F.col("head"), "Content-Length", r"\d{1,18}").cast("long")
    )
    block = F.expr("cast(substring(cast(value AS binary), octet_length(head) + 5, int(content_length)) AS string)")
    return plain.unionByName(_described(joined.withColumn("block", block), payload).select("file", "offset", *fields))


def archive_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: the records, one for each row of pages."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, **columns)
    return read_warc(pages.sparkSession, path)
