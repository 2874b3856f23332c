"""WARC archives: pages written as records, and archives read back as one nested row per capture."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritsieve.llm.shared import new_path, stored
from gritsieve.operators.ranks import SHARES, lookup

#: Fixed values of the format (WARC 1.1).
VERSION = "WARC/1.1"
LINE, RECORD_END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Production parameters: payloads shorter than this are never written as revisits; the date of all captures.
LEAST_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
#: Records per archive file at most, which bounds what one task reads at once.
FILE_RECORDS = 3000
#: Payload bytes that the reader hands on at once, about.
BATCH_BYTES = 8 << 20


def _record_id(kind: str, *parts: Column) -> Column:
    """A urn:uuid that depends on the kind of record and the parts only."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *parts))
    return F.concat(F.lit("<urn:uuid:"), *(
        x for i, (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        for x in ([F.lit("-")] if i else []) + [F.substring(h, at, n)]
    ), F.lit(">"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the end mark, which the writer puts after every row. Headers without a value are left out."""
    fields = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), *headers,
              ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(LINE)) for name, value in fields]
    return F.concat(F.lit(VERSION + LINE), *(F.coalesce(x, F.lit("")) for x in lines), F.lit(LINE), block)


def captures_to_write(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page, url, html, digest, record_id, target): target is the record to revisit, null for a response.

    Digests that several pages share are aggregated map-side and written. Those with over one in SHARES of all pages, fewer
    than SHARES, reach their pages by broadcast, and such pages are dealt by a key of their own, so a payload that a third of
    all pages have is no single task. Record ids follow from id, URL and payload.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha1(html).alias("digest"),
        F.octet_length(html).alias("bytes"))
    shared = stored(rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct("page", "url")).alias("last"), F.count("*").alias("times")).where("times > 1"), "digests")
    hot = shared.where(F.col("times") * SHARES > pages.count())
    tagged = rows.join(F.broadcast(hot.select("digest", F.col("last").alias("hot"))), "digest", "left")
    alone = F.concat(F.lit("page "), F.xxhash64("page", "url").cast("string"))
    tagged = tagged.withColumn("_key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(alone))
    joined = tagged.join(shared.select(F.col("digest").alias("_key"), "last"), "_key", "left")
    joined = joined.withColumn("last", F.coalesce("hot", "last")).drop("hot", "_key")
    own = F.struct("page", "url")
    again = (F.col("bytes") >= least_bytes) & F.col("last").isNotNull() & ~own.eqNullSafe(F.col("last"))

    def name(kind: str, page: Column, url: Column) -> Column:
        known = (F.coalesce(page.cast("string"), F.lit("")), F.coalesce(F.md5(url), F.lit("")))
        return _record_id(kind, *known, F.col("digest"))

    return joined.select(
        "page", "url", "html", "digest",
        name("request", F.col("page"), F.col("url")).alias("request_id"),
        name("metadata", F.col("page"), F.col("url")).alias("metadata_id"),
        F.when(again, name("revisit", F.col("page"), F.col("url"))).otherwise(
            name("response", F.col("page"), F.col("url"))).alias("record_id"),
        F.when(again, name("response", F.col("last.page"), F.col("last.url"))).alias("target"))


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = LEAST_BYTES, compression: str = "gzip",
) -> None:
    """Write three records per page: a response or revisit, and a request and metadata concurrent to it.

    The payload is the page in UTF-8. Of pages with equal payloads of `least_bytes` or more, the one with the largest id
    (then URL; nulls are smallest) is written as a response and the others revisit it, without payload; shorter ones are
    all responses. Null html is an empty payload, a null URL an absent header (control characters in a URL go), a null
    id an absent field. Rows that agree in everything are written as often as they stand. Spark's text writer commits
    the files, so a lost executor leaves no half of one; each file is one gzip stream. An empty table gives no record.
    """
    c = captures_to_write(pages, id_col, url_col, html_col, least_bytes)
    url = F.regexp_replace("url", r"[\x00-\x1F\x7F]", "")
    first, record_id = F.col("target").isNull(), F.col("record_id")
    uri, to = ("WARC-Target-URI", url), ("WARC-Concurrent-To", record_id)
    answer = [uri, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
              ("Content-Type", F.lit("application/http; msgtype=response"))]
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = F.concat(F.coalesce(F.concat(F.lit("page: "), F.col("page").cast("string"), F.lit(LINE)), F.lit("")),
                      F.lit("via: table\r\n"))
    records = F.array(
        _record("request", F.col("request_id"), [
            uri, to, ("Content-Type", F.lit("application/http; msgtype=request"))], F.lit("GET / HTTP/1.1\r\n\r\n")),
        F.when(first, _record("response", record_id, answer, F.concat(F.lit(head), F.col("html")))).otherwise(
            _record("revisit", record_id, [
                *answer, ("WARC-Refers-To", F.col("target")), ("WARC-Profile", F.lit(PROFILE))], F.lit(head))),
        _record("metadata", F.col("metadata_id"), [
            uri, to, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    rows = c.select(F.explode(records).alias("value"))
    rows.write.option("lineSep", RECORD_END).option("compression", compression).option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


def _records(stream: io.BufferedIOBase, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: a record should start here, not {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"{name}: a record ends early")
        yield headers, block


RECORD = (
    "record_type string, record_id string, date string, uri string, concurrent_to string, refers_to string, "
    "stated_digest string, payload_bytes long, payload_digest string, fields map<string,string>"
)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under `path`, gzip or plain, in any number of gzip members.

    payload_bytes and payload_digest (SHA-1 in hex) are of the block behind the HTTP header, or of the whole block of
    other records; `payloads` adds the payload itself. `fields` holds the lines of a warc-fields block. A record that
    ends early, or has no version line, raises. One task reads one file at a time, without unpacking it whole; Spark
    hands files over as rows, so an archive must be under 2 GB.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * payloads
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                raw = io.BytesIO(content)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                rows, size = [], 0
                for h, block in _records(stream, name):
                    kind, fields = h.get("content-type", ""), {}
                    if kind.startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    elif kind.startswith("application/warc-fields"):
                        lines = block.decode("utf-8", "replace").splitlines()
                        fields = {k.strip(): v.strip() for k, sign, v in (x.partition(":") for x in lines) if sign}
                    rows.append((
                        h.get("warc-type"), h.get("warc-record-id"), h.get("warc-date"), h.get("warc-target-uri"),
                        h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-payload-digest"), len(block),
                        hashlib.sha1(block).hexdigest(), fields, *([block] * payloads)))
                    size += len(block) * payloads
                    if size > BATCH_BYTES or len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(parsed, RECORD + ", payload binary" * payloads)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (also a revisit) and metadata, as structs or null.

    Records are joined through their concurrent-to identifiers: one without is the centre of its capture. A capture
    that is written several times over gives as many rows. Request or metadata records whose centre is missing give a
    row without response.
    """
    kind = F.when(F.col("record_type").isin("request", "metadata"), F.col("record_type")).otherwise("response")
    whole = F.struct(*(f"`{c}`" for c in records.columns if c != "fields"), F.map_entries("fields").alias("fields"))
    joined = records.where("record_type <> 'warcinfo'").groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        *(F.max(F.when(kind == k, whole)).alias(k) for k in ("request", "response", "metadata")),
        *(F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in ("request", "response", "metadata")))
    times = F.greatest("n_request", "n_response", "n_metadata").cast("int")
    out = joined.select("capture_id", "request", "response", "metadata", F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return out.withColumn("metadata", F.col("metadata").withField("fields", F.map_from_entries("metadata.fields"))).drop("copy")


def resolved(found: DataFrame) -> DataFrame:
    """`captures` with the payload figures of the record that a revisit refers to: payload_bytes, payload_digest, target.

    target is the nested row referred to; a revisit whose target is missing has its stated digest, and no bytes.
    """
    centre = found.where("response.record_type <> 'revisit'")
    targets = centre.groupBy(F.col("response.record_id").alias("_id")).agg(
        F.max(F.struct("response.payload_bytes", "response.payload_digest",
                       F.col("metadata.fields").getItem("page").alias("page"))).alias("target"))
    # Only revisits are joined: rows without a target would all have the null key, and so one task.
    revisits = found.where("response.record_type = 'revisit'")
    revisits = revisits.withColumn("_id", F.coalesce("response.refers_to", F.lit("")))
    known = lookup(revisits, stored(targets, "targets"), ["_id"]).drop("_id")
    stated = F.regexp_replace("response.stated_digest", "^sha1:", "")
    known = known.withColumns({
        "payload_bytes": F.col("target.payload_bytes"), "payload_digest": F.coalesce("target.payload_digest", stated)})
    others = found.where("response.record_type <> 'revisit' or response is null").withColumns({
        "target": F.lit(None).cast(known.schema["target"].dataType),
        "payload_bytes": F.col("response.payload_bytes"), "payload_digest": F.col("response.payload_digest")})
    return others.unionByName(known)


def pages_through_warc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write `pages` to archives in the shared folder, read them back, and report each page as it was found there.

    (page_id, payload_bytes, payload_digest, record_type, refers_to): the last is the page that a revisit refers to.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    found = resolved(stored(captures(read_records(spark, path, payloads=False)), "captures"))
    kind = pages.schema[id_col].dataType
    return found.select(
        F.col("metadata.fields").getItem("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.col("target.page")).cast(kind).alias("refers_to"))
