"""WARC archives: write captures, read records, and put transactions together again.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record.  Requests and metadata name the response that they belong to
(WARC-Concurrent-To); `transactions` joins by that and makes one nested row of
each capture.  Archives go through Spark's own writer and reader, so any store
that Spark knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Bytes of records that a file holds, by their mean size; a reader holds a file at once.
FILE_BYTES = 32 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each ten hex digits are eight digits to base 32."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _urn(*parts: Column | str) -> Column:
    digest = F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its last line feed, which the text writer adds."""
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\n")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n")]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write every row as request, response or revisit, and metadata, to gzip archives under path.

    Of equal payloads of at least `least_revisit_bytes` bytes, that with the largest id is the
    response; smaller ones are all responses.  Payloads are strings in UTF-8 or binary; null
    is empty.  A null url is written as about:blank, a null id as none.  Line breaks in urls
    become spaces.  Rows alike in id, url and payload are captures with the same record ids.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")), "[\r\n]", " ")
    rows = pages.select(F.col(id_col).alias("id"), clean.alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload").cast("binary")).alias("digest"))
    # One row per payload, counted before any payload moves.
    first = rows.filter(F.col("bytes") >= least_revisit_bytes).groupBy("digest", "bytes").agg(F.max_by(F.struct("id", "url"), "id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(first.select("digest", "bytes", "first"), ["digest", "bytes"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id")) & F.col("first.id").isNotNull()
    own = _urn("response", F.col("id"), F.col("url"), F.col("digest"))
    named = rows.select("*", revisits.alias("revisit"), own.alias("own"), _urn("response", F.col("first.id"), F.col("first.url"), F.col("digest")).alias("refers"))
    host, rest = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1)
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", date)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    response = _record("response", [("WARC-Record-ID", F.col("own")), *common, digest, ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("payload")))
    revisit = _record("revisit", [("WARC-Record-ID", F.col("own")), *common, digest, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", F.col("refers")), ("Content-Type", "application/http; msgtype=response")], http)
    request = _record("request", [("WARC-Record-ID", _urn("request", F.col("own"))), ("WARC-Concurrent-To", F.col("own")), *common, ("Content-Type", "application/http; msgtype=request")], F.concat(F.lit("GET "), F.when(rest == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")))
    metadata = _record("metadata", [("WARC-Record-ID", _urn("metadata", F.col("own"))), ("WARC-Concurrent-To", F.col("own")), *common, ("Content-Type", "application/warc-fields")], F.concat(F.lit("page-id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("\r\n")))
    records = named.select(F.explode(F.array(request, F.when(F.col("revisit"), revisit).otherwise(response), metadata)).alias("value"))
    mean = rows.agg(F.avg(F.col("bytes") + 2000) / 3).first()[0] or 1.0
    records.write.option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, digest_ok boolean, fields map<string,string>"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, data[start:stop]
        at = stop + 4


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives under path, gzip or not; payload (binary) only where asked for.

    payload_bytes and payload_digest are of the full payload: recomputed for a response,
    as its headers say for a revisit.  fields: HTTP or warc-fields headers, names in lower
    case.  digest_ok: null where there is nothing to compare.
    """
    schema = RECORD + ", payload binary" * with_payload

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.replace("map<string,string>", "map").split(", ")]
        kinds = {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    whole, left = [], data
                    while left:
                        one = zlib.decompressobj(31)
                        whole.append(one.decompress(left))
                        left = one.unused_data
                    data = b"".join(whole)
                found = []
                for headers, block in parse(data):
                    kind, payload, size, ok, digest = headers.get("warc-type"), None, None, None, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if "application/http" in headers.get("content-type", ""):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        fields = _fields(head.partition(b"\r\n")[2])
                        if kind == "response":
                            size, sha = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            ok, digest = (digest == sha if digest else None), sha
                        elif kind == "revisit":
                            size = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
                    else:
                        fields = _fields(block)
                    found.append((kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, size, ok, list(fields.items()), payload))
                for at in range(0, len(found), 1000):
                    part = list(zip(*found[at : at + 1000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.string())) for n, x in zip(names, part, strict=False)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: target_uri, response (a response or revisit), request, metadata (array).

    Request and metadata are null or empty where no record names the response; records that
    name none that exists are left out.  Of several requests the one with the smallest id
    counts; equal metadata records count once.  A response that was written twice, for rows
    alike in all that is written, is two rows.  An empty table gives an empty result.
    """
    body = [c for c in records.columns if c not in ("record_type", "concurrent_to")]
    kind = F.col("record_type")
    captured = kind.isin("response", "revisit")
    of = F.when(captured, F.col("record_id")).when(kind.isin("request", "metadata"), F.col("concurrent_to"))
    side = F.struct("record_id", "target_uri", "fields")
    entries = F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields"))
    together = records.filter(of.isNotNull()).groupBy(of.alias("of")).agg(
        F.first(F.when(captured, F.struct("record_type", *body)), ignorenulls=True).alias("response"),
        F.count_if(captured).alias("copies"),
        F.min_by(F.when(kind == "request", side), F.when(kind == "request", F.col("record_id"))).alias("request"),
        F.sort_array(F.collect_set(F.when(kind == "metadata", entries))).alias("metadata"),
    )
    told = together.filter("copies > 0").select("response", "request", "metadata", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return told.select(F.col("response.target_uri").alias("target_uri"), "response", "request", "metadata")
