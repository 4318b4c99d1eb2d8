"""The bar store: Parquet by symbol and month, replaced month by month; and append-only logs."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeforms.operators import bars as B

BARS = "symbol string, ts timestamp_ntz, source string, open double, high double, low double, close double, volume double, ingested_at timestamp_ntz"


def made_once(spark: SparkSession, part, whole) -> bool:
    """Gives a finished file the name `whole` in one step (Hadoop paths); False, and nothing done, if there is one: by a link where the folder is local, by a rename elsewhere.
    An object store renames in several steps; there one process alone may write."""
    files, jvm = part.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm
    if files.getUri().getScheme() != "file":
        return not files.exists(whole) and files.rename(part, whole)
    try:
        jvm.java.nio.file.Files.createLink(*(jvm.java.io.File(p.toUri().getPath()).toPath() for p in (whole, part)))
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


class BarStore:
    """Bars below a folder, by symbol and month. An upsert writes only the months that it touches, each whole, and then names them in a
    manifest, so readers see either what was or what is. A version is named by a file that only one of several writers can make: who comes second names the next one if
    the versions in between left its months alone, else it merges its bars into what these made of them."""

    MANIFEST = "seq long, v string, symbol string, month string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema(self.MANIFEST).json(f"{self.folder}/manifest")

    def seq(self) -> int:
        """The number of the latest version; -1 of an empty store."""
        return self._manifest().agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] if self._exists(f"{self.folder}/manifest") else -1

    def read(self, at: int | None = None, months: DataFrame | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
        """All bars; version, symbol and month are partitions, so files that the manifest has replaced are pruned, and a filter on symbol or ts reaches the rest.

        at: as they were after that version. months (symbol, month): only these. begin, end: only bars from and until these times, of whose months alone files are read.
        """
        if not (self._exists(f"{self.folder}/manifest") and self._exists(f"{self.folder}/data")):
            return self.spark.createDataFrame([], BARS)
        names = BARS.split(", ")
        stored = ", ".join([*(n for n in names if not n.startswith("symbol ")), "v string", "symbol string", "month string"])
        known = self._manifest() if at is None else self._manifest().where(F.col("seq") <= at)
        latest = known.groupBy("symbol", "month").agg(F.max_by("v", "seq").alias("v"))
        if months is not None:
            latest = latest.join(months, ["symbol", "month"], "left_semi")
        rows = self.spark.read.schema(stored).parquet(f"{self.folder}/data")
        if begin is not None:
            rows = rows.where((F.col("month") >= begin[:7]) & (F.col("ts") >= F.lit(begin).cast("timestamp_ntz")))
        if end is not None:
            rows = rows.where((F.col("month") <= end[:7]) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
        return rows.join(latest, ["v", "symbol", "month"], "left_semi").select(*(n.split()[0] for n in names))

    def touched(self, since: int, until: int) -> DataFrame:
        """(symbol, month): what the versions after `since` up to `until` have written."""
        return self._manifest().where((F.col("seq") > since) & (F.col("seq") <= until)).select("symbol", "month").distinct()

    def changed_sessions(self, since: int, until: int | None = None) -> DataFrame:
        """(symbol, session) of bars that were added, corrected or taken away between two versions. Only months that were written in between are read."""
        until = self.seq() if until is None else until
        months = self.touched(since, until)
        prices = ["source", *B.PRICES, "volume"]
        old, new = (self.read(n, months).select("symbol", "ts", F.struct(*prices).alias(name)) for n, name in ((since, "_o"), (until, "_n")))
        both = old.join(new, (old["symbol"] == new["symbol"]) & (old["ts"] == new["ts"]) & (old["_o.source"] == new["_n.source"]), "full")
        named = both.where(~F.col("_o").eqNullSafe(F.col("_n"))).select(F.coalesce(old["symbol"], new["symbol"]).alias("symbol"), F.coalesce(old["ts"], new["ts"]).alias("ts"))
        return named.select("symbol", F.to_date(B.new_york()).alias("session")).distinct()

    def load(self, symbol: str, end_ts: str | None = None) -> DataFrame:
        rows = self.read().where(F.col("symbol") == symbol)
        return (rows if end_ts is None else B.until(rows, F.lit(end_ts).cast("timestamp_ntz"))).orderBy("ts")

    def upsert(self, batch: DataFrame) -> int:
        """Replaces bars by (symbol, ts, source); returns the batch's rows. An empty batch changes and logs nothing."""
        n = batch.count()
        if not n:
            return 0
        month = F.date_format("ts", "yyyy-MM").alias("month")
        new = batch.select(*(c.split()[0] for c in BARS.split(", ")))
        touched = new.select("symbol", month).distinct()
        B.ingestion_log(batch).write.parquet(f"{self.folder}/ingestions/append={uuid.uuid4().hex}")  # a folder for each, since writers in one would clear each other's
        base, version = self.seq(), None
        while True:
            if version is None:
                version = uuid.uuid4().hex
                kept = self.read(base).select("*", month).join(touched, ["symbol", "month"], "left_semi").select(*new.columns)
                B.upsert(kept, new).select("*", month).repartition("symbol", "month").write.partitionBy("symbol", "month").parquet(f"{self.folder}/data/v={version}")
            if self._name(base + 1, version, touched):
                return n
            now = self.seq()
            if not self.touched(base, now).join(touched, ["symbol", "month"], "left_semi").isEmpty():
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/v={version}")  # ours, and in no manifest
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
                version = None
            base = now

    def _name(self, seq: int, version: str, touched: DataFrame) -> bool:
        """Whether the version is now that of seq; if not, another writer's is."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        staged, manifest = f"{self.folder}/staged/{uuid.uuid4().hex}", f"{self.folder}/manifest"
        touched.select(F.lit(seq).cast("long").alias("seq"), F.lit(version).alias("v"), "symbol", "month").coalesce(1).write.json(staged)
        files = path(manifest).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path(manifest))
        part = next(f.getPath() for f in files.listStatus(path(staged)) if f.getPath().getName().startswith("part-"))
        made = made_once(self.spark, part, path(f"{manifest}/{seq:012d}.json"))
        files.delete(path(staged), True)
        return made

    def refresh(self, feed: DataFrame) -> int:
        """Takes from a feed, with source and ingested_at, what is new since a day before the last bar, in regular hours."""
        return self.upsert(B.regular_hours(B.to_refresh(self.read(), feed)))

    def sessions(self) -> DataFrame:
        return B.sessions(self.read())

    def coverage(self) -> DataFrame:
        return B.coverage(self.sessions())


class EventLog:
    """An append-only table of events with a rising seq. Each append is a folder of its own, so several writers may append at once."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def append(self, rows: list[tuple] | DataFrame, name: str | None = None) -> None:
        """Returns when the events are committed; what spends a test does this before it computes. An append of a name that there is replaces it."""
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
        df.write.mode("overwrite").parquet(f"{self.folder}/append={name or uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, append string").parquet(self.folder)
        return rows.drop("append")


class BatchLog:
    """The rows that each batch of one stream gives, in a folder of its own; that stream alone writes. A batch that is run again replaces its rows.

    After every `merge_every` batches (None: never) their folders become one, so that the number of files grows a good deal slower than that of the batches. A reader sees a merged folder only
    when it is whole, and from then on not the folders that went into it, which are removed by the next merge.
    """

    FILE_BYTES = 128 << 20  # of a file of a merged folder, about

    def __init__(self, spark: SparkSession, folder: str, schema: str, merge_every: int | None = 64):
        self.spark, self.folder, self.schema, self.merge_every = spark, folder, schema, merge_every

    def _bytes(self, names: list[str]) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(files.getContentSummary(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")).getLength() for n in names)

    def _parts(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, name) of the whole folders, those that lie within another left out."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []
        whole = [n for n in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        spans = [(*map(int, n.split("-")), n) for n in whole]
        merged = [(a, b) for a, b, _ in spans if a < b]
        return [(a, b, n) for a, b, n in spans if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in merged)]

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{batch:012d}-{batch:012d}")
        single = [p for p in self._parts() if p[0] == p[1] and p[0] < batch]  # not the batch itself, which may be run again
        if self.merge_every is not None and len(single) >= max(2, self.merge_every):  # one alone would be merged into itself
            merged = [n for _, _, n in single]
            self._read(merged).coalesce(1 + self._bytes(merged) // self.FILE_BYTES).write.mode("overwrite").parquet(f"{self.folder}/{single[0][0]:012d}-{single[-1][1]:012d}")
            self._clear(single[0][0])

    def _clear(self, before: int) -> None:
        """Removes single batches before that one, which an earlier merge holds."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        held = {n for _, _, n in self._parts()}
        for f in files.listStatus(path):
            name = f.getPath().getName()
            first, last = map(int, name.split("-"))
            if first == last < before and name not in held:
                files.delete(f.getPath(), True)

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{n}" for n in names))

    def read(self, batch: int | None = None) -> DataFrame:
        """All rows, or those of one batch that was appended last."""
        return self._read([n for _, _, n in self._parts()] if batch is None else [f"{batch:012d}-{batch:012d}"])


class Claims:
    """Names that can be taken once, by whoever comes first, in a folder that all writers share.

    A claim is a file that is made only if it isn't there: in one step by the operating system where the folder is local, and by the file system where it
    is not (HDFS does it in one step; of an object store, its driver has to be set to make files only where there are none).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def take(self, name: str) -> bool:
        """Whether the name is now ours. It stays taken, whatever becomes of us."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(path.getParent())
        try:
            if files.getUri().getScheme() == "file":
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(path.toUri().getPath()).toPath(), self.spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                files.create(path, False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def taken(self) -> list[str]:
        """The names that are taken; they are few, one for each evaluation ever made."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []


class FoldedLog:
    """A log of events with a rising seq of which the latest state of each key is wanted: a snapshot of one row per key, and the appends since then.

    append() is told who writes and the number of the batch, so a batch that is run again changes nothing. fold() merges the appends into a new snapshot and then names it
    in a manifest; a reader sees what one manifest says and the appends that it doesn't name, so what is read grows with the keys and with the appends of one period, not with the log's
    age. Of each column the snapshot keeps the seq that it comes from, so an append that is late gives the same as in the log as a whole.
    Any number may append and read while one folds; of two that fold at once, the second raises Busy and has changed nothing. What a fold has replaced is removed by the next one, so a
    reader has that long.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, seq: str = "seq"):
        self.spark, self.folder, self.schema, self.key, self.seq = spark, folder, schema, key, seq
        self.kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
        self.values = [c for c in self.kinds if c not in (key, seq)]

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, of: str) -> list[str]:
        files, path = self._files(), self._path(of)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def _manifest(self, number: int | None = None) -> dict:
        """number, snapshot (None at first), held: the appends in it that may still be there; batches: by writer, the last batch in it."""
        known = [n for n in self._names("manifests") if n.endswith(".json")]
        name = known[-1] if number is None and known else f"{number:012d}.json" if number is not None else None
        if name not in known:
            return {"number": -1, "snapshot": None, "held": [], "batches": {}}
        stream = self._files().open(self._path(f"manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _appends(self, held: list[str]) -> list[str]:
        """Finished appends that the manifest doesn't hold."""
        files = self._files()
        return [n for n in self._names("appends") if n not in set(held) and files.exists(self._path(f"appends/{n}/_SUCCESS"))]

    def has(self, writer: str, batch: int) -> bool:
        """Whether the batch is in the snapshot, or was appended as a whole."""
        return batch <= self._manifest()["batches"].get(writer, -1) or self._files().exists(self._path(f"appends/{writer}={batch:012d}/_SUCCESS"))

    def append(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Whether the batch is new to the snapshot; one that is written again replaces itself. A writer's batches rise, and it begins one when the one before is written."""
        if batch <= self._manifest()["batches"].get(writer, -1):
            return False
        rows.select(*self.kinds).write.mode("overwrite").parquet(f"{self.folder}/appends/{writer}={batch:012d}")
        return True

    def _tail(self, appends: list[str]) -> DataFrame:
        if not appends:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/appends/{n}" for n in appends))

    def _folded(self, manifest: dict, appends: list[str]) -> DataFrame:
        """(key, column, column_seq, ...): of each column the last value that isn't null, and its seq."""
        pairs = self._tail(appends).select(self.key, *(x for c in self.values for x in (F.col(c), F.when(F.col(c).isNotNull(), F.col(self.seq)).alias(f"{c}_seq"))))
        if manifest["snapshot"] is not None:
            kinds = ", ".join([f"{self.key} {self.kinds[self.key]}", *(f"{c} {self.kinds[c]}, {c}_seq {self.kinds[self.seq]}" for c in self.values)])
            pairs = pairs.unionByName(self.spark.read.schema(kinds).parquet(f"{self.folder}/snapshots/{manifest['snapshot']}"))
        return pairs.groupBy(self.key).agg(*(x for c in self.values for x in (F.max_by(c, f"{c}_seq").alias(c), F.max(f"{c}_seq").alias(f"{c}_seq"))))

    def current(self) -> DataFrame:
        """What ledger.current gives of all events ever appended."""
        manifest = self._manifest()
        return self._folded(manifest, self._appends(manifest["held"])).select(self.key, *self.values)

    def tail(self) -> list[str]:
        """The appends that a reader has to read besides the snapshot."""
        return self._appends(self._manifest()["held"])

    def fold(self) -> int:
        """Merges what is finished into a snapshot; the number of appends that it took. Raises Busy if another process folds."""
        before = self._manifest()
        number = before["number"] + 1
        appends = self._appends(before["held"])
        if not appends:
            return 0
        version = uuid.uuid4().hex
        self._folded(before, appends).write.parquet(f"{self.folder}/snapshots/{version}")
        batches = dict(before["batches"])
        for name in appends:
            writer, _, batch = name.rpartition("=")
            batches[writer] = max(batches.get(writer, -1), int(batch))
        held = sorted({*before["held"], *appends} & set(self._names("appends")))
        self._publish({"number": number, "snapshot": version, "held": held, "batches": batches})
        self._clear(before)
        return len(appends)

    def _publish(self, manifest: dict) -> None:
        """Names the manifest in one step, which fails if there is one of this number: by a link where the folder is local, by a rename elsewhere.
        An object store renames in several steps; there one process alone may fold."""
        files = self._files()
        files.mkdirs(self._path("manifests"))
        part, whole = self._path(f"manifests/{uuid.uuid4().hex}.part"), self._path(f"manifests/{manifest['number']:012d}.json")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        made = made_once(self.spark, part, whole)
        files.delete(part, False)
        if not made:
            raise Busy(f"fold {manifest['number']} of {self.folder}")

    def _clear(self, before: dict) -> None:
        """Removes what no reader of the manifest `before` needs: the appends in its snapshot, the snapshot and the manifest that came before it."""
        files = self._files()
        for name in before["held"]:
            files.delete(self._path(f"appends/{name}"), True)
        older = self._manifest(max(before["number"] - 1, 0))
        if before["number"] > 0 and older["snapshot"] is not None:
            files.delete(self._path(f"snapshots/{older['snapshot']}"), True)
            files.delete(self._path(f"manifests/{older['number']:012d}.json"), False)


class Busy(RuntimeError):
    """Another process is folding the log."""
