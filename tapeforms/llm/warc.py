"""WARC archives as a PySpark Python data source, for reading and writing.

Writing gives each task archives of about `roll` bytes and, when all tasks are done, a manifest of the files and of the places
at which records begin, about every `split` bytes. Reading plans its partitions from the manifests: a file and a range of it
each, so large archives are read in parallel; foreign archives without manifest are one partition per file. Predicates on
the record type and on the other header columns are pushed down: a record's header is parsed first, and the payload of
a record that fails, or all payloads if option payload is "false", are skipped by seeking and never decoded. Files named
*.gz, one gzip member per record or not, are read as a stream.

Edge cases: a null payload is an empty one; a null header value is a header that is left out; control characters in header
values are percent-encoded; an empty table gives no archive and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tapeforms.llm import shared

# The header names of WARC 1.1.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "warc_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
ROLL, SPLIT = 256 << 20, 16 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int | None

    def __init__(self, file: str, start: int, end: int | None):
        self.file, self.start, self.end = file, start, end


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("roll", ROLL)), int(self.options.get("split", SPLIT)), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: dict[str, set[Any]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            elif column in HEADERS and isinstance(f, IsNotNull) and column in self.wanted:
                continue
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, base = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        manifests = [x.path for x in found if x.base_name.startswith("_manifest-")]
        if not manifests:
            return [Range(x.path, 0, None) for x in found if re.search(r"\.warc(\.gz)?$", x.base_name)] or [Range("", 0, 0)]
        out = []
        for m in manifests:
            with system.open_input_stream(m) as source:
                for file in json.loads(source.read()):
                    out += [Range(f"{base}/{file['name']}", a, b) for a, b in zip(file["splits"], [*file["splits"][1:], file["bytes"]], strict=True)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(partition.file) as raw:
            stream: Any = gzip.open(raw) if partition.file.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            stream.seek(partition.start)
            for row in self._records(stream, partition.end):
                rows.append(row)
                held += len(row[-1] or b"")
                if len(rows) >= 1000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, stream, end: int | None) -> Iterator[tuple]:
        while end is None or stream.tell() < end:
            line = stream.readline()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {line[:40]!r}")
            header: dict[str, str] = {}
            while (line := stream.readline()).strip():
                key, _, value = line.decode("utf-8", "replace").partition(":")
                header[key.strip().lower()] = value.strip()
            size = int(header["content-length"])
            values = tuple(header.get(h.lower()) for h in HEADERS.values())
            kept = all(dict(zip(HEADERS, values, strict=True))[c] in allowed for c, allowed in self.wanted.items())
            payload = None
            if kept and self.payload:
                payload = stream.read(size)
                if "application/http" in (header.get("content-type") or ""):
                    payload = payload.partition(b"\r\n\r\n")[2]
            else:
                stream.seek(size, io.SEEK_CUR)
            if kept:
                yield (*values, payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], names=[*HEADERS, "payload"])


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, split: int, overwrite: bool):
        self.path, self.roll, self.split, self.overwrite = path, roll, split, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        files: list[dict] = []
        out, at = None, 0
        try:
            for batch in iterator:
                columns = {c: batch.column(c) for c in (*HEADERS, "payload") if c in batch.schema.names}
                for i in range(batch.num_rows):
                    record = as_record({c: v[i].as_py() for c, v in columns.items()})
                    if out is None or at >= self.roll:
                        if out is not None:
                            out.close()
                        files.append({"name": f"{uuid.uuid4().hex}.warc", "splits": [0], "bytes": 0})
                        out, at = system.open_output_stream(f"{base}/{files[-1]['name']}"), 0
                    elif at - files[-1]["splits"][-1] >= self.split:
                        files[-1]["splits"].append(at)
                    out.write(record)
                    at += len(record)
                    files[-1]["bytes"] = at
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        name = f"{base}/_manifest-{uuid.uuid4().hex}.json"
        old = [x.path for x in system.get_file_info(pafs.FileSelector(base)) if x.base_name.startswith("_manifest-")] if self.overwrite else []
        with system.open_output_stream(name) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for m in old:
            system.delete_file(m)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{base}/{f['name']}")


def as_record(row: dict[str, Any]) -> bytes:
    payload = row.get("payload") or b""
    if "application/http" in (row.get("content_type") or ""):
        payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", *(f"{h}: {_clean(row[c])}" for c, h in HEADERS.items() if row.get(c) is not None), f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]|^\s|\s$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def base32_sha1(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of binary data: 40 bits, or 8 characters, at a time."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below path. Filters on header columns are pushed down, for which Spark has a setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write(records: DataFrame, path: str) -> None:
    """Writes records with any of the columns of SCHEMA below path."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode("append").option("path", path).save()


PAGE_ID = "urn:x-page:"


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per page: of equal payloads of at least least_bytes, the page with the largest id is a response and the others revisit it."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("target_uri"), payload.alias("payload")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    heads = shared.cut(rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    placed = shared.sized_join(rows, heads, ["payload_digest"], "left")
    again = F.col("top").isNotNull() & (F.octet_length("payload") >= least_bytes) & ~F.col("id").eqNullSafe(F.col("top"))

    def name(c: str) -> Column:
        return F.concat(F.lit("<" + PAGE_ID), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    write(placed.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), name("id").alias("record_id"), F.lit(date).alias("warc_date"), "target_uri",
        F.concat(F.lit("sha1:"), "payload_digest").alias("payload_digest"), F.when(again, name("top")).alias("refers_to"),
        F.when(~again, F.lit("application/http;msgtype=response")).alias("content_type"), F.when(~again, F.col("payload")).alias("payload"),
    ), path)


def archived_pages(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of the pages in archives that archive() wrote.

    Sizes and digests are those of the payloads read; for a revisit, of the response that it refers to. A revisit without its response is an error.
    """

    def number(c: str) -> Column:
        return F.nullif(F.regexp_extract(F.col(c), f"<{PAGE_ID}(.*)>", 1), F.lit("")).cast("long")

    responses = read(spark, path).where(F.col("warc_type") == "response")
    # Both uses stand on what was read and digested once.
    found = shared.cut(responses.select(number("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")))
    revisits = read(spark, path, payload=False).where(F.col("warc_type") == "revisit").select(number("record_id").alias(id_col), number("refers_to").alias("refers_to"))
    of = found.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).withColumnRenamed(id_col, "refers_to")
    columns = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = found.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(columns)
    missing = F.raise_error(F.concat(F.lit("no response that a revisit refers to: "), F.coalesce(F.col("refers_to").cast("string"), F.lit("none")))).cast("long")
    again = revisits.join(of, "refers_to", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", missing))
    return first.unionByName(again.withColumn("record_type", F.lit("revisit")).select(columns))
