"""Web archives with revisit records, and a merged index of their captures.

Pages are written as WARC records by Spark's own writer, so the files are committed
like any other table; equal payloads are stored once. Reading parses each file by
record lengths, checks payload digests, and gives a locally sorted run of captures per
file. Runs are dealt out by ranges of (URL key, time) and merged by a loser tree in
each range, which orders the capture histories globally.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftwalk.llm.base import column, read, register, text_or_empty
from driftwalk.staging import new_path, stage

MIN_REVISIT_BYTES = 100
# Bounds what a reader holds at once: one file's captures and its compressed bytes.
RECORDS_PER_FILE = 5000
# Time of a page without one: this, and its id in seconds.
FIRST_CAPTURE = "2024-01-01 00:00:00"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = (
    "url_key string, captured string, page_id long, url string, record_type string, "
    "refers_to long, payload_bytes long, payload_digest string, file string, offset long"
)
_SCHEMA = pa.schema(
    [
        ("url_key", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("file", pa.string()),
        ("offset", pa.int64()),
    ]
)


def _utc(time: str) -> Column:
    """ISO text of an instant in UTC, whatever the session's zone."""
    plain = f"TIMESTAMP_NTZ'1970-01-01' + make_dt_interval(0, 0, 0, unix_seconds({time}))"
    shown = F.substring(F.expr(plain).cast("string"), 1, 19)
    return F.concat(F.replace(shown, F.lit(" "), F.lit("T")), F.lit("Z"))


def _records(pages: DataFrame, page_id: str, url: str, html: str, captured: str | None) -> DataFrame:
    """(head, payload) of every page's record; revisits have an empty payload."""
    time = column(captured).cast("timestamp") if captured else F.lit(None).cast("timestamp")
    rows = pages.select(
        column(page_id).cast("long").alias("page_id"),
        text_or_empty(url).alias("url"),
        text_or_empty(html).alias("payload"),
        F.coalesce(
            time,
            F.timestamp_seconds(
                F.unix_seconds(F.lit(f"{FIRST_CAPTURE}Z").cast("timestamp")) + F.coalesce(column(page_id), F.lit(0))
            ),
        ).alias("captured"),
    ).withColumns(
        {
            "digest": F.sha2("payload", 256),
            "bytes": F.octet_length("payload").cast("long"),
        }
    )
    # Only payloads that several pages share are looked up.
    firsts = (
        rows.where(F.col("bytes") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
        .where("pages > 1")
        .select("digest", "first")
    )
    found = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def identifier(value: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("")), F.lit(">"))

    safe_url = F.replace(
        F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")
    )
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", identifier(F.col("page_id"))),
        line("WARC-Date", _utc("captured")),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", identifier(F.col("first"))),
                line("WARC-Profile", F.lit(PROFILE)),
                line("X-Payload-Length", F.col("bytes").cast("string")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    return found.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    captured: str | None = None,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record per page to compressed archives in the folder ``path``.

    Of pages with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes that with the
    smallest id is a response and the others refer to it; rows that repeat this id are
    responses too. A null page is an empty payload, a null URL an empty one, and a page
    without an id is never the one referred to while another has one. An empty table
    gives a folder without records.
    """
    # A record ends with two line ends, which the writer puts after every row.
    _records(pages, page_id, url, html, captured).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """Sortable key: host labels reversed, path and sorted query, all in lower case."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:  # no URL; it is its own key
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    where = ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "")
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{where}){parts.path.rstrip('/') or '/'}" + (f"?{query}" if query else "")


def _number(identifier: str | None) -> int | None:
    text = (identifier or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def parse_archive(content: bytes, file: str) -> Iterator[dict]:
    """The captures of one archive, each payload checked against its digest."""
    packed = content[:2] == b"\x1f\x8b"
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if packed else io.BytesIO(content)
    while True:
        offset = stream.tell()
        version = stream.readline()
        if not version:
            return
        if not version.startswith(b"WARC/"):
            raise ValueError(f"{file}: no record at {offset}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        length = int(head["content-length"])
        payload = stream.read(length)
        if len(payload) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{file}: record at {offset} is cut off")
        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{file}: payload at {offset} has another digest")
        url = head["warc-target-uri"]
        yield {
            "url_key": url_key(url),
            "captured": head["warc-date"],
            "page_id": _number(head["warc-record-id"]),
            "url": url,
            "record_type": kind,
            "refers_to": _number(head.get("warc-refers-to")),
            "payload_bytes": int(head.get("x-payload-length", length)),
            "payload_digest": digest,
            "file": file,
            "offset": offset,
        }


def _order(capture: dict) -> tuple:
    page = capture["page_id"]
    return (capture["url_key"], capture["captured"], page is None, page or 0, capture["offset"])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in ``path``; each file's are a sorted run."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                found = sorted(parse_archive(content.as_py(), file.as_py()), key=_order)
                yield pa.RecordBatch.from_pylist(found, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(runs, CAPTURES)


class LoserTree:
    """Merge of sorted runs: each step replays one path from a leaf to the root."""

    def __init__(self, runs: list[list], key):
        self.runs = [iter(run) for run in runs]
        self.key = key
        self.heads = [self._next(run) for run in range(len(runs))]
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.losers = [-1] * size
        self.winner = self._play(1)

    def _next(self, run: int):
        item = next(self.runs[run], None)
        return None if item is None else (self.key(item), run, item)

    def _beats(self, one: int, other: int) -> bool:
        """Whether run ``one`` comes before; runs that have ended or are missing lose."""
        heads = self.heads
        if other < 0 or other >= len(heads) or heads[other] is None:
            return True
        if one < 0 or one >= len(heads) or heads[one] is None:
            return False
        return heads[one][:2] < heads[other][:2]

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.heads and self.winner < len(self.heads) and self.heads[self.winner]:
            run = self.winner
            yield self.heads[run][2]
            self.heads[run] = self._next(run)
            node = (run + self.size) // 2
            while node:
                if not self._beats(run, self.losers[node]):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def merge_captures(captures: DataFrame) -> DataFrame:
    """``captures`` in global order: by ``range_no``, then ``position``.

    Order is by URL key, time, id (null last). A range holds the slices of all runs
    that fall into it; a URL with very many captures spans several ranges. A run that
    arrives in pieces is merged as several runs.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[list[dict]]] = {}
        for batch in batches:
            for capture in batch.to_pylist():
                pieces = runs.setdefault(capture["file"], [[]])
                if pieces[-1] and _order(capture) < _order(pieces[-1][-1]):
                    pieces.append([])
                pieces[-1].append(capture)
        place, rows = TaskContext.get().partitionId(), []
        tree = LoserTree([piece for pieces in runs.values() for piece in pieces], _order)
        schema = _SCHEMA.append(pa.field("range_no", pa.int32())).append(
            pa.field("position", pa.int64())
        )
        for position, capture in enumerate(tree):
            rows.append({**capture, "range_no": place, "position": position})
            if len(rows) == 5000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ranged = captures.repartitionByRange(
        F.col("url_key"), F.col("captured"), F.asc_nulls_last("page_id"), F.col("file"), F.col("offset")
    )
    return ranged.mapInArrow(merged, f"{CAPTURES}, range_no int, position long")


@register(
    "op8_warc",
    f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest
  FROM pages
),
firsts AS (
  SELECT *, CASE WHEN n >= {MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY digest) END AS first
  FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts
""",
)
def op8_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    captures = stage(read_captures(spark, path), "captures")
    histories = merge_captures(captures)
    return histories.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
