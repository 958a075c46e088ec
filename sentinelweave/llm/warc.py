"""Content-addressed web archive: payload bytes once, headers apart, records restored by joins.

``payload_table`` keeps every distinct payload once under its SHA-256 address. ``header_table`` keeps the exact
header block of every record. ``write_archives`` joins both back into records and writes gzip files of WARC/1.1
records through Spark's text writer, whose committer survives lost tasks: a row is a header block and its
payload, and the row separator is the two line ends that close a record. ``read_archives`` parses the files by
Content-Length, verifies each payload against the address in its header and raises where they differ.
``restore`` gives revisits the payload facts of their response by a join.

Of pages with one payload of at least ``least`` bytes that with the largest page_id is the response and the
others revisit it; smaller payloads are always responses.

Defined cases: a null payload is empty; a null page_id counts as the smallest, and such pages are responses
where no page of the group has an id; repeated rows of the response's page_id are responses too; a null url has
no target line; control characters of a url are percent-encoded; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sentinelweave.llm.common import small_batches, stored

#: Smallest payload that a revisit saves.
LEAST_BYTES = 1000
#: Date line of all records of one run.
RUN_DATE = "2026-01-01T00:00:00Z"
#: Records of one archive file at most; a file is read by one task.
FILE_RECORDS = 20_000
LINE = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def addressed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, n, address)``: payload bytes with their SHA-256."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("address")
    )


def holders(pages: DataFrame) -> DataFrame:
    """``(address, holder)``: the largest page_id of every payload."""
    return addressed(pages).groupBy("address").agg(F.max("page_id").alias("holder"))


def payload_table(pages: DataFrame, held: DataFrame) -> DataFrame:
    """``(address, payload)``: every distinct payload once, taken from its holder."""
    key = lambda c: F.coalesce(F.col(c), F.lit(-(2**63)))
    base = addressed(pages).select("address", key("page_id").alias("k"), "payload")
    keys = held.select("address", key("holder").alias("k"))
    # Both steps use one partitioning by (address, k): payload bytes move once.
    return base.join(keys, ["address", "k"], "left_semi").dropDuplicates(["address", "k"]).select("address", "payload")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(LINE))


def header_table(pages: DataFrame, held: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``(address, header, response)``: the exact header block of every page's record."""
    base = addressed(pages).select("page_id", "url", "address", "n", F.sha1("payload").alias("sha1")).join(held, "address")
    response = (F.col("n") < least) | F.col("page_id").eqNullSafe(F.col("holder"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(response, F.col("n")).otherwise(F.lit(0)).cast("string")
    header = F.concat(
        F.lit("WARC/1.1" + LINE),
        _line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", F.lit(RUN_DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Block-Address", F.concat(F.lit("sha256:"), F.col("address"))),
        F.when(response, F.lit("")).otherwise(F.concat(_line("WARC-Profile", F.lit(REVISIT_PROFILE)), _line("WARC-Refers-To", urn(F.col("holder"))))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", length),
        F.lit(LINE),
    )
    return base.select("address", response.alias("response"), header.alias("header"))


def write_archives(headers: DataFrame, payloads: DataFrame, path: str) -> None:
    """Write all records as gzip archives under ``path``."""
    full = headers.filter("response").join(payloads, "address").select(F.concat("header", "payload").alias("value"))
    bare = headers.filter("not response").select(F.col("header").alias("value"))
    full.unionByName(bare).write.option("lineSep", LINE + LINE).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, payload) of every record of an archive."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {first[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(": ")
            fields[name] = value[:-2]
        size = int(fields["Content-Length"])
        payload = stream.read(size)
        if len(payload) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is cut short")
        yield fields, payload


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, address string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``, payloads verified; ``payloads`` off leaves them out."""
    small_batches(spark)

    def number(urn: str | None) -> int | None:
        value = urn[len("<urn:page:") : -1] if urn else "none"
        return None if value == "none" else int(value)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, payload in _parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    address = fields["WARC-Block-Address"].removeprefix("sha256:")
                    digest = None
                    if fields["WARC-Type"] == "response":
                        digest = hashlib.sha1(payload).hexdigest()
                        if hashlib.sha256(payload).hexdigest() != address or f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    rows.append((
                        number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), fields["WARC-Type"], number(fields.get("WARC-Refers-To")),
                        address, len(payload), digest, payload if payloads else None,
                    ))
                    held += len(payload) if payloads else 0
                    if len(rows) >= 1000 or held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(work, READ_SCHEMA)


def restore(records: DataFrame) -> DataFrame:
    """Every record with the facts of its full payload; a revisit has those of the response it refers to."""
    facts = ["payload_bytes", "payload_digest"] + [c for c in ("payload",) if c in records.columns]
    own = records.filter("record_type = 'response'")
    source = own.groupBy("address").agg(*[F.any_value(c).alias(c) for c in facts])
    back = records.filter("record_type = 'revisit'").drop(*facts).join(source, "address")
    return own.unionByName(back)


def round_trip(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> DataFrame:
    """Archive ``pages`` under ``path`` and read them back:
    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    spark = pages.sparkSession
    held = stored(holders(pages), "holders")
    payloads = stored(payload_table(pages, held), "payloads")
    headers = stored(header_table(pages, held, least), "headers")
    write_archives(headers, payloads, path)
    records = read_archives(spark, path, payloads=False).drop("payload", "url")
    return restore(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
