"""WARC archives: writing, reading back, and a globally ordered capture index.

Spark's text sink writes the records: the separator it puts after each row is the blank line that
ends a WARC record. Every record begins with the id of its archive, a fresh UUID; version line and id
together are the separator for reading, so payloads with blank lines or quoted WARC records do not
matter, and plain files split for reading. Length and digest of every payload are checked on reading.

The index is an external merge. Every reading task sorts its captures by URL key and time and
writes them as a run. The runs are dealt out by ranges of (URL key, time, page), so that even one URL
with a third of all captures is spread; a loser tree per range merges the parts of all runs. Read in
the order of ``part`` and ``place`` the captures are in global order.

Defined cases: a null payload is empty; a null URL has an empty key; blanks and control characters
in a URL are written as %20; of rows that repeat page and payload one is the response; a null page
comes after all others of its payload and of its URL; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkrank.llm.tables import materialised, replayable
from chunkrank.session import shared_dir

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Captures have no time of their own here: page n was fetched n seconds after this one.
FIRST_FETCH = 1_577_836_800
NULL_ID = (1 << 63) - 1


def base32_sha1(payload: F.Column) -> F.Column:
    """Upper-case base32 of the SHA-1: eight groups of 20 bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def url_key(url: F.Column) -> F.Column:
    """Sort-friendly key: host labels reversed, then path and query in lower case."""
    plain = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")
    rest = F.regexp_extract(plain, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", plain).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    )


def _fields(*pairs: tuple[str, F.Column | str]) -> F.Column:
    parts: list[F.Column] = []
    for name, value in pairs:
        value = F.lit(value) if isinstance(value, str) else value
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*parts)


def records(pages: DataFrame, archive: str, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """One WARC record per page as text, without the blank line at its end."""
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        F.regexp_replace(F.col(f"`{url}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("bytes"),
        F.monotonically_increasing_id().alias("place"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    entry = F.struct(
        F.coalesce(F.col("page_id"), F.lit(NULL_ID)).alias("id_order"), "place", F.col("page_id").alias("page_id")
    )
    first = (
        rows.filter(F.col("bytes") >= least_bytes)
        .groupBy(F.col("digest").alias("first_digest"))
        .agg(F.min(entry).alias("first"))
    )
    known = (F.col("digest") == F.col("first_digest")) & (F.col("bytes") >= least_bytes)
    rows = rows.join(first, known, "left").withColumn(
        "again", F.coalesce(F.col("place") != F.col("first.place"), F.lit(False))
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"),
        F.lit(BLANK),
    )
    block = F.when(F.col("again"), head).otherwise(F.concat(head, F.col("payload")))
    fetched = F.timestamp_seconds(FIRST_FETCH + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(10**9)))

    def named(n: F.Column) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(n.cast("string"), F.lit("")), F.lit(">"))

    def if_again(value: F.Column) -> F.Column:
        return F.when(F.col("again"), value)

    fields = _fields(
        ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        ("WARC-Record-ID", named(F.col("page_id"))),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Date", F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", if_again(named(F.col("first.page_id")))),
        ("WARC-Profile", if_again(F.lit(PROFILE))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(F.lit(VERSION + _archive_line(archive)), fields, F.lit("\r\n"), block).alias("value"))


def _archive_line(archive: str) -> str:
    return f"WARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    compression: str = "gzip",
) -> str:
    """Write WARC files below the folder; returns the id of the archive, which reading needs.

    A gzip file holds all its records as one stream and is read by one task; its size is that of a
    shuffle partition. Files written with ``compression="none"`` split for reading.
    Payloads of at least ``least_bytes`` are stored once; later pages with the same one revisit it.
    """
    archive = str(uuid.uuid4())
    found = records(replayable(pages), archive, page_id, url, html, least_bytes)
    found.write.option("lineSep", BLANK).option("compression", compression).text(folder)
    return archive


def read_archives(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """page_id, url, captured, record_type, payload_digest, payload_bytes, refers_to, payload, file."""
    lines = spark.read.text(folder, lineSep=BLANK + VERSION + _archive_line(archive))
    # The first record of a file has no separator before it.
    own = F.replace(F.col("value"), F.lit(VERSION + _archive_line(archive)), F.lit(""))
    whole = F.when(F.startswith("value", F.lit(VERSION + _archive_line(archive))), own).otherwise(F.col("value"))
    parsed = lines.select(
        F.col("_metadata.file_name").alias("file"),
        F.concat(F.substring_index(whole, BLANK, 1), F.lit("\r\n")).alias("header"),
        whole.cast("binary").alias("raw"),
    )

    def field(name: str, pattern: str = r"([^\r\n]*)", of: str = "header") -> F.Column:
        found = F.regexp_extract(F.col(of), rf"(?:^|\r\n){name}: {pattern}\r\n", 1)
        return F.nullif(found, F.lit(""))

    size = field("Content-Length", r"(\d+)").cast("int")
    block = F.substring(F.col("raw"), F.octet_length("header") + 3, size)
    parsed = parsed.withColumn("size", size).withColumn("block", block)
    http = F.substring_index(F.substring("block", 1, 200).cast("string"), BLANK, 1)
    parsed = parsed.withColumn("http", F.concat(http, F.lit("\r\n")))
    payload = F.substring(F.col("block"), F.octet_length("http") + 3, F.col("size"))
    digest = field("WARC-Payload-Digest", r"sha1:([A-Z2-7]*)")
    bytes_ = field("Content-Length", r"(\d+)", "http").cast("long")
    kind = field("WARC-Type")
    sound = (F.octet_length("block") == F.col("size")) & (
        (kind == "revisit") | ((base32_sha1(payload) == digest) & (F.octet_length(payload) == bytes_))
    )
    return parsed.select(
        field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Date"), r"[^0-9]", "").alias("captured"),
        kind.alias("record_type"),
        F.when(sound, digest).otherwise(F.raise_error(F.lit("a record does not hold what it says"))).alias("payload_digest"),
        bytes_.alias("payload_bytes"),
        field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        F.when(kind == "response", payload).alias("payload"),
        "file",
    )


# --- the index -------------------------------------------------------------------------------


class LoserTree:
    """Merges sorted lists of keys; every inner node keeps the run that lost there."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)
        self.losers = [-1] * max(1, len(runs))
        for run in range(len(runs)):
            self._enter(run)

    def _beats(self, a: int, b: int) -> bool:
        """Does the head of run a come before that of run b? An exhausted run comes last."""
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _enter(self, run: int) -> None:
        """Play a run upwards; while the tree fills, the first to reach an open node waits there."""
        node = (run + len(self.runs)) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position in it) in merged order."""
        while self.runs:
            run = self.losers[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield run, self.at[run]
            self.at[run] += 1
            self._enter(run)


KEY = ("url_key", "captured", "page_id")


def sorted_runs(captures: DataFrame) -> DataFrame:
    """The captures of every reading task, sorted and written as one run."""
    entries = captures.drop("payload").withColumns(
        {"url_key": url_key(F.col("url")), "run": F.spark_partition_id()}
    )
    return materialised(entries.sortWithinPartitions("url_key", "captured", F.col("page_id").asc_nulls_last()))


def merged_index(runs: DataFrame) -> DataFrame:
    """All captures in global order by ``part`` and ``place``."""
    order = ("url_key", "captured", F.col("page_id").asc_nulls_last())
    dealt = runs.repartitionByRange(*order).sortWithinPartitions("run", *order)
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "place": F.lit(0).cast("long")})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([*batches], schema=None) if (batches := [*batches]) else None
        if table is None or not len(table):
            return
        columns = [table.column(n).to_pylist() for n in KEY]
        keys = [(k, t, n is None, n or 0) for k, t, n in zip(*columns)]
        number = table.column("run").to_pylist()
        cuts = [i for i in range(len(number)) if not i or number[i] != number[i - 1]]
        tree = LoserTree([keys[a:b] for a, b in zip(cuts, [*cuts[1:], len(keys)])])
        merged = table.take(pa.array([cuts[run] + at for run, at in tree], pa.int64()))
        place = pa.array(range(len(merged)), pa.int64())
        yield from merged.set_column(merged.column_names.index("place"), "place", place).to_batches()

    return dealt.mapInArrow(merge, dealt.schema)


def archived(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write the pages as WARC files, read these back, and return the merged capture index."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    archive = write_archives(pages, folder, least_bytes=least_bytes)
    return merged_index(sorted_runs(read_archives(spark, folder, archive)))
