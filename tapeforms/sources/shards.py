"""Bars in database files: a folder of SQLite shards as a Python data source, in batch and as a stream.

A shard is a file `*.db` with a table `bars`, by (symbol, ts, source), times as ISO-8601 text in UTC. Shards that write() has made are named in manifests with
the least and largest key that they hold, so a reader opens those alone that its predicates can meet; others, such as a file that a collector is still filling, are
opened by the tasks. On a file system that isn't local, a shard is read as a whole and opened in memory.
"""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from tapeforms.sources.store import BARS

# The table of other installations' files.
TABLE = """CREATE TABLE IF NOT EXISTS bars (symbol TEXT NOT NULL, ts TEXT NOT NULL, open REAL NOT NULL, high REAL NOT NULL, low REAL NOT NULL,
close REAL NOT NULL, volume REAL NOT NULL, source TEXT NOT NULL, ingested_at TEXT NOT NULL, PRIMARY KEY (symbol, ts, source))"""
COLUMNS = [c.split()[0] for c in BARS.split(", ")]
TIMES = ("ts", "ingested_at")
ROLL = 400_000  # rows of a shard, some 60 MB
SPLIT = 64 << 20  # bytes of a local shard that a task reads
COMPARED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}
ARROW = pa.schema([(c, pa.timestamp("us") if c in TIMES else pa.string() if c in ("symbol", "source") else pa.float64()) for c in COLUMNS])


@dataclass
class Part(InputPartition):
    """Rows of a shard: the part-th of `parts` ranges of row ids, or those with ids from above `after` up to `until`."""

    file: str
    part: int = 0
    parts: int = 1
    after: int | None = None
    until: int | None = None


@dataclass
class Made(WriterCommitMessage):
    shards: list[dict[str, Any]]


def as_text(t: dt.datetime) -> str:
    return t.isoformat() + "+00:00"


def as_time(text: str) -> dt.datetime:
    t = dt.datetime.fromisoformat(text)
    return t.astimezone(dt.UTC).replace(tzinfo=None) if t.tzinfo else t


def opened(uri: str, file: str) -> sqlite3.Connection:
    system, _ = pafs.FileSystem.from_uri(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return sqlite3.connect(f"file:{file}?mode=ro", uri=True)
    with system.open_input_stream(file) as source:
        data = bytearray(source.read())
    data[18:20] = b"\x01\x01"  # a file that was written with a write-ahead log can't be opened in memory as such
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(data))
    return db


@dataclass
class Wanted:
    """What predicates let through: symbols (None: all) and comparisons of ts."""

    symbols: frozenset[str] | None = None
    times: tuple[tuple[str, dt.datetime], ...] = ()

    def meets(self, shard: dict[str, Any]) -> bool:
        if self.symbols is not None and not any(shard["low"][0] <= s <= shard["high"][0] for s in self.symbols):
            return False
        first, last = as_time(shard["first"]), as_time(shard["last"])
        return all((last > t if op == ">" else last >= t if op == ">=" else first < t if op == "<" else first <= t if op == "<=" else first <= t <= last) for op, t in self.times)

    def keeps(self, t: dt.datetime) -> bool:
        return all((t > u if op == ">" else t >= u if op == ">=" else t < u if op == "<" else t <= u if op == "<=" else t == u) for op, u in self.times)

    def where(self) -> tuple[list[str], list[Any]]:
        """Conditions that the primary key serves. Seconds are compared as text, whatever comes behind them; keeps() does the rest."""
        terms, values = [], []
        if self.symbols is not None:
            terms.append(f"symbol IN ({', '.join('?' * len(self.symbols))})")
            values += sorted(self.symbols)
        for op, t in self.times:
            second = t.isoformat()[:19]
            if op[0] in ">=":
                terms.append("ts >= ?")
                values.append(second)
            if op[0] in "<=":
                terms.append("ts < ?")
                values.append(second + "~")
        return terms, values


def rows_of(uri: str, part: Part, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    if not part.file:
        return
    db = opened(uri, part.file)
    try:
        terms, values = wanted.where()
        after, until = part.after, part.until
        if part.parts > 1:
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM bars").fetchone()
            if low is None:
                return
            after, until = (low - 1 + (high - low + 1) * n // part.parts for n in (part.part, part.part + 1))
        for name, bound in (("rowid > ?", after), ("rowid <= ?", until)):
            if bound is not None:
                terms.append(name)
                values.append(bound)
        found = db.execute(f"SELECT {', '.join(COLUMNS)} FROM bars{' WHERE ' + ' AND '.join(terms) if terms else ''}", values)
        while rows := found.fetchmany(10_000):
            columns: list[Any] = [list(c) for c in zip(*rows, strict=True)]
            for name in TIMES:
                columns[COLUMNS.index(name)] = list(map(as_time, columns[COLUMNS.index(name)]))
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)
            if wanted.times:
                batch = batch.filter(pa.array(list(map(wanted.keeps, columns[COLUMNS.index("ts")]))))
            yield batch
    finally:
        db.close()


def listed(uri: str, after: str = "") -> tuple[list[tuple[str, dict[str, Any]]], list[pafs.FileInfo]]:
    """Shards by manifest, of the manifests behind `after`, and the files that no manifest names. Only manifests are read."""
    system, base = pafs.FileSystem.from_uri(uri)
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    named = []
    for m in sorted(x.base_name for x in found if x.base_name.startswith("_manifest-")):
        if m > after:
            with system.open_input_stream(f"{base}/{m}") as source:
                named += [(m, s) for s in json.loads(source.read())]
    return named, [x for x in found if x.base_name.endswith(".db") and not x.base_name.startswith("shard-")]


class ShardSource(DataSource):
    """Options: path; symbol, a symbol that a stream is limited to; roll, rows of a shard written."""

    @classmethod
    def name(cls) -> str:
        return "bar_shards"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def streamReader(self, schema) -> ShardStream:
        return ShardStream(self.options["path"], self.options.get("symbol"))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], int(self.options.get("roll", ROLL)))


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "symbol" and isinstance(f, (EqualTo, In)):
                names = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted.symbols = names if self.wanted.symbols is None else self.wanted.symbols & names
            elif column == "ts" and type(f) in COMPARED and isinstance(f.value, dt.datetime):
                self.wanted.times = (*self.wanted.times, (COMPARED[type(f)], f.value.replace(tzinfo=None)))
            elif isinstance(f, IsNotNull) and column in COLUMNS:  # no column of the table is null
                continue
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, base = pafs.FileSystem.from_uri(self.path)
        named, loose = listed(self.path)
        local = isinstance(system, pafs.LocalFileSystem)
        sizes = [(f"{base}/{s['name']}", s["bytes"]) for _, s in named if self.wanted.meets(s)] + [(x.path, x.size) for x in loose]
        out = []
        for file, size in sizes:
            n = max(1, -(-size // SPLIT)) if local else 1
            out += [Part(file, i, n) for i in range(n)]
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition, self.wanted)


class ShardStream(DataSourceStreamReader):
    """Offsets are the last manifest that was read and, of files without one, the last row id. A row that replaces another has a new id, so corrections come too."""

    def __init__(self, path: str, symbol: str | None):
        self.path, self.wanted = path, Wanted(frozenset([symbol]) if symbol else None)

    def initialOffset(self) -> dict:
        return {"manifest": "", "rows": {}}

    def latestOffset(self) -> dict:
        system, base = pafs.FileSystem.from_uri(self.path)
        found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        manifest = max((x.base_name for x in found if x.base_name.startswith("_manifest-")), default="")
        rows = {}
        for x in found:
            if x.base_name.endswith(".db") and not x.base_name.startswith("shard-"):
                if isinstance(system, pafs.LocalFileSystem):
                    db = opened(self.path, x.path)
                    rows[x.base_name] = db.execute("SELECT coalesce(max(rowid), 0) FROM bars").fetchone()[0]
                    db.close()
                else:
                    rows[x.base_name] = -1  # such a file doesn't change
        return {"manifest": manifest, "rows": rows}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        _, base = pafs.FileSystem.from_uri(self.path)
        named, _ = listed(self.path, start["manifest"])
        out = [Part(f"{base}/{s['name']}") for m, s in named if m <= end["manifest"] and self.wanted.meets(s)]
        for name, last in end["rows"].items():
            before = start["rows"].get(name, 0)
            if last < 0:
                out += [] if name in start["rows"] else [Part(f"{base}/{name}")]
            elif last > before:
                out.append(Part(f"{base}/{name}", after=before, until=last))
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition, self.wanted)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        shards: list[dict[str, Any]] = []
        db, n = None, 0
        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                if db is None:
                    db, n = sqlite3.connect(":memory:"), 0
                    db.execute(TABLE)
                block = batch.slice(at, min(10_000, self.roll - n))
                at += block.num_rows
                columns = {c: block.column(c).to_pylist() for c in COLUMNS}
                for c in TIMES:
                    columns[c] = [as_text(t.replace(tzinfo=None)) for t in columns[c]]
                rows = list(zip(*(columns[c] for c in COLUMNS), strict=True))
                db.executemany(f"INSERT OR REPLACE INTO bars ({', '.join(COLUMNS)}) VALUES ({', '.join('?' * len(COLUMNS))})", rows)
                n += len(rows)
                if n >= self.roll:
                    shards.append(self._ended(system, base, db))
                    db = None
        if db is not None:
            shards.append(self._ended(system, base, db))
        return Made(shards)

    def _ended(self, system: pafs.FileSystem, base: str, db: sqlite3.Connection) -> dict[str, Any]:
        db.commit()
        low, high, first, last, n = db.execute("SELECT min(symbol), max(symbol), min(ts), max(ts), count(*) FROM bars").fetchone()
        data, name = db.serialize(), f"shard-{uuid.uuid4().hex}.db"
        db.close()
        with system.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
        return {"name": name, "bytes": len(data), "rows": n, "low": [low], "high": [high], "first": first, "last": last}

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/_manifest-{time.time_ns():020d}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([s for m in messages if m for s in m.shards]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        for s in (s for m in messages if m for s in m.shards):
            system.delete_file(f"{base}/{s['name']}")


def write(bars: DataFrame, path: str, roll: int = ROLL) -> None:
    """Adds bars, with the columns of the store, as new shards of narrow ranges of (symbol, ts), so that a busy symbol has many. One writer at a time.

    Within a shard a later row replaces an earlier one of its key; a key that was written twice comes once from each write, and bars.upsert tells them apart."""
    bars.sparkSession.dataSource.register(ShardSource)
    bars.select(*COLUMNS).repartitionByRange("symbol", "ts").write.format("bar_shards").mode("append").option("path", path).option("roll", roll).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All bars of the folder; filters on symbol and ts are pushed down, for which Spark has a setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)
    return spark.read.format("bar_shards").option("path", path).load()


def stream(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """The bars as a stream: what is there, then what is added or replaced."""
    spark.dataSource.register(ShardSource)
    reader = spark.readStream.format("bar_shards").option("path", path)
    return (reader.option("symbol", symbol) if symbol else reader).load()
