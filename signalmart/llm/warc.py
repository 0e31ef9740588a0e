"""WARC archives of pages, and a two-level capture index over them.

``write_archives`` writes one record per page as text that ends in the blank lines that end a WARC record, so
the archives are plain ``.warc`` content written by Spark's own writer to the shared folder.  Of pages with equal payloads
the one with the smallest id is a response, the others are revisits that refer to it.

``build_index`` sorts the captures by reversed-host URL key into compressed blocks.  The block directory holds
the first and last key of each block, the top directory those of each range of blocks.  ``lookup`` sends keys to
their ranges by the top directory, finds the blocks by binary search and opens just those; ``fetch`` cuts
the byte ranges that the index names out of the archives and parses the records.

Null payload: empty.  Null url: the empty key.  Null id: a record without a number, never referred to.  Rows that
repeat both the smallest id and the payload are all responses.  Pages' other columns are not looked at.  An
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmart.operators.sizing import broadcast_if_small
from signalmart.sources.shared import shared_folder, stage

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK_CAPTURES = 1_000
RANGE_CAPTURES = 200_000
ARCHIVE_BYTES = 32 * 1024 * 1024
CAPTURE = "key string, page_id string, file string, offset long, length long"
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``http://a.example.com/x`` is ``com,example,a)/x``."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*", 0), r"^.*@|:\d+$", ""))
    rest = F.regexp_replace(plain, r"^[^/?]*", "")
    return F.when(plain == "", "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def base32_sha1(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: eight digits from every ten."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0) -> None:
    """Archives of all pages below ``folder``; payloads of less than ``revisit_from`` bytes are never revisits."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("sha"))
    repeated = stage("warc-repeated")(
        rows.where(F.col("bytes") >= revisit_from).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
        .where("n > 1 and first_id is not null").select("sha", "first_id"))
    known = rows.join(broadcast_if_small(repeated), "sha", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20"),
        F.lit(f"{CRLF}WARC-Date: {DATE}"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _record_id(F.col("first_id"))))
        .otherwise(""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), base32_sha1(F.col("sha")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length("block").cast("string"), F.lit(END))
    # Files are read whole, so they are kept small.
    n, total = rows.agg(F.count("*"), F.sum("bytes")).first()
    per_file = max(1, int(ARCHIVE_BYTES / (1_000 + (total or 0) / max(n, 1))))
    known.withColumn("block", block).select(F.concat(head, "block").alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", per_file).text(folder)


def parse_record(record: bytes) -> dict[str, str | int | bytes]:
    """Header fields (lower case), and the payload's bytes or, for a revisit, its length."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields: dict = {}
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields["payload"] = payload
    for line in http.decode("utf-8", "replace").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length":
            fields["payload-length"] = int(value)
    return fields


def record_spans(archive: bytes) -> Iterator[tuple[int, int]]:
    """Offset and length of every record, from the lengths in their headers."""
    at = 0
    while at < len(archive):
        body = archive.index(b"\r\n\r\n", at) + 4
        lengths = [line for line in archive[at:body].split(b"\r\n") if line.lower().startswith(b"content-length:")]
        length = body - at + int(lengths[-1].partition(b":")[2]) + 4
        yield at, length
        at += length


def _page(record_id: str) -> str | None:
    """The page's id, left as text: pandas would turn numbers with nulls among them into floats."""
    number = record_id.rpartition(":")[2].rstrip(">")
    return None if number == "none" else number


def archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(
        F.col("path").alias("file"), "content")


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``CAPTURE`` rows of all records in the archives."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                rows = []
                for at, length in record_spans(content):
                    head = content[at:content.index(b"\r\n\r\n", at)].decode("utf-8", "replace").split(CRLF)
                    named = dict(line.partition(": ")[::2] for line in head[1:])
                    rows.append((named["WARC-Target-URI"], _page(named["WARC-Record-ID"]), file, at, length))
                yield pd.DataFrame(rows, columns=["url", "page_id", "file", "offset", "length"])

    found = archives(spark, folder).mapInPandas(scan, CAPTURE.replace("key", "url"))
    return found.select(url_key(F.col("url")).alias("key"), "page_id", "file", "offset", "length")


def build_index(captures: DataFrame) -> DataFrame:
    """Blocks of sorted captures: ``range, block, first_key, last_key, n, data`` (compressed lines).

    Ranges follow key and place, so captures of one URL may fill many ranges.
    """
    placed = stage("warc-captures")(captures)
    ranges = max(1, -(-placed.count() // RANGE_CAPTURES))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, number = pd.DataFrame(), 0

        def block(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal number
            lines = "\n".join(
                f"{k}\t{p or ''}\t{f}\t{o}\t{n}"
                for k, p, f, o, n in zip(rows["key"], rows["page_id"], rows["file"], rows["offset"], rows["length"]))
            number += 1
            return pd.DataFrame({
                "block": [number - 1], "first_key": [rows["key"].iloc[0]], "last_key": [rows["key"].iloc[-1]],
                "n": [len(rows)], "data": [zlib.compress(lines.encode())]})

        for batch in batches:
            held = pd.concat([held, batch], ignore_index=True)
            while len(held) >= BLOCK_CAPTURES:
                yield block(held.iloc[:BLOCK_CAPTURES])
                held = held.iloc[BLOCK_CAPTURES:]
        if len(held):
            yield block(held)

    order = ["key", "file", "offset"]
    made = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInPandas(
        blocks, "block long, first_key string, last_key string, n long, data binary")
    return stage("warc-index")(made.select(F.spark_partition_id().alias("range"), "*"))


def _captures_of(data: bytes) -> list[tuple[str, str | None, str, int, int]]:
    rows = (line.split("\t") for line in zlib.decompress(data).decode().split("\n"))
    return [(k, p or None, f, int(o), int(n)) for k, p, f, o, n in rows]


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures (``CAPTURE``) of every ``key``, each once."""
    top = index.groupBy("range").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("range").collect()
    if not top:
        return keys.sparkSession.createDataFrame([], CAPTURE)
    lows, highs = [r["low"] for r in top], [r["high"] for r in top]

    @F.pandas_udf("array<int>")
    def ranges_of(batch: pd.Series) -> pd.Series:
        def found(key: str) -> list[int]:
            at = bisect_left(highs, key)
            out = []
            while at < len(lows) and lows[at] <= key:
                out.append(int(top_ranges[at]))
                at += 1
            return out
        return batch.map(found)

    top_ranges = [r["range"] for r in top]

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        firsts, lasts, data = blocks["first_key"].tolist(), blocks["last_key"].tolist(), blocks["data"].tolist()
        out, at_hand, opened = [], -1, []
        for key in sorted(wanted["key"]):
            b = bisect_left(lasts, key)
            while b < len(firsts) and firsts[b] <= key:
                if b != at_hand:
                    at_hand, opened = b, _captures_of(data[b])
                    names = [c[0] for c in opened]
                i = bisect_left(names, key)
                while i < len(opened) and names[i] == key:
                    out.append(opened[i])
                    i += 1
                b += 1
        frame = pd.DataFrame(out, columns=["key", "page_id", "file", "offset", "length"])
        return frame.astype({"offset": "int64", "length": "int64"})

    asked = keys.select("key").distinct().select("key", F.explode(ranges_of("key")).alias("range"))
    return asked.groupBy("range").cogroup(index.groupBy("range")).applyInPandas(search, CAPTURE)


def fetch(spark: SparkSession, folder: str, captures: DataFrame) -> DataFrame:
    """The records (``RECORD``) of captures, read from their byte ranges; a response's digest is checked."""
    ranges = captures.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    wanted = broadcast_if_small(stage("warc-wanted")(ranges), max_bytes=16 * 1024 * 1024)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, spans in zip(batch["content"], batch["spans"]):
                rows = []
                for span in spans:
                    record = parse_record(content[span["offset"]:span["offset"] + span["length"]])
                    digest, kind = record["warc-payload-digest"].removeprefix("sha1:"), record["warc-type"]
                    if kind == "response":
                        read = base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()
                        if read != digest or len(record["payload"]) != record["payload-length"]:
                            raise ValueError(f"damaged record {record['warc-record-id']}")
                    refers = record.get("warc-refers-to")
                    rows.append((_page(record["warc-record-id"]), record["payload-length"], digest, kind,
                                 _page(refers) if refers else None))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    read = archives(spark, folder).join(wanted, "file").select("content", "spans").mapInPandas(cut, RECORD)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write the archives of all pages, index them, look up every page's key and read the records back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder)
    index = build_index(read_captures(spark, folder))
    captures = lookup(index, pages.select(url_key(F.regexp_replace(
        F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")).alias("key")))
    return fetch(spark, folder, captures)
