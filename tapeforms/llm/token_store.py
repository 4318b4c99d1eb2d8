"""Content-addressed store of token ids.

Texts are encoded to id streams, each closed by an end id. A rolling hash over the last 16 ids cuts a stream into chunks
where the ids themselves say so, so equal passages give equal chunks. A chunk is named by the SHA-256 of its ids (as
little-endian unsigned 32-bit integers) and stored once, in the file of the task that its name falls to. A document's
recipe lists its chunks, with the Merkle root over their names, its number of ids and the number of ids before it;
recipes are written in ascending order of id. Reading takes the chunk files, recomputes the name of every chunk from
what is in the file, follows the recipes and compares the roots, so each document is verified. The checksum of a
document comes from those of its chunks, by the rule for the CRC of a concatenation; chunks need not be moved for it.

Texts are encoded once and each chunk is shuffled at most once per task that met it; repeats carry only the name.

Chunk file: b"TFCHUNK1"; then per chunk its name (32 bytes), its number of ids and the bytes that follow (two unsigned 32-bit
little-endian integers), and the zstd frame of its ids in 2 bytes each (4 if the vocabulary needs it, told by the size
of the content); then 32 zero bytes, the number of chunks (64 bits) and the Merkle root over all names (32 bytes).

Edge cases: null and empty texts have the end id only; repeated rows each have their place in the stream; equal ids with
different texts are ordered by a hash of the text; null ids come last; an empty table gives empty recipes; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tapeforms.llm import shared

MAGIC = b"TFCHUNK1"
WINDOW_STEPS = (1, 2, 4, 8)  # a hash over 16 ids, by doubling
CUT_BITS = 9
LEAST, MOST = 128, 4096
#: Bytes of a worker's table of words, and names of chunks that a task remembers; both only spare repeated work.
TABLE_BYTES = 48 << 20
SENT = 100_000
#: A character that is a word of its own, between words that are encoded together.
MARK = "\x01"


class WordEncoder:
    """The tokenizers library's encoding of whole texts, with the ids of words kept.

    Where the vocabulary's splitting pattern drops white space, normalisation changes no word by its neighbours, and no
    special token holds a space, a text has the ids of its words between spaces and line feeds, one after the other. This
    is looked up in the vocabulary file; with another kind of vocabulary whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        self.by_word = splits_at_spaces(vocabulary)
        #: Special tokens are found before letters are made small, so texts with one keep their capitals.
        self.special = [t["content"].lower().encode() for t in vocabulary.get("added_tokens", ())]
        self.lowers = {"type": "Lowercase"} in steps_of(vocabulary)
        self.table = shared.WordIds(self.apart, TABLE_BYTES)
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids if self.by_word else (None,)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> list[bytes]:
        """The ids of each word: many go to the library as one text, with a mark between them that no word holds."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if MARK not in w]
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([f" {MARK} ".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            data = ids.tobytes()
            for i, a, b in zip(group, [-1, *ends], ends, strict=False):
                out[i] = data[4 * (a + 1) : 4 * b]
        others = [i for i, w in enumerate(words) if MARK in w]
        for i, ids in zip(others, self.encode([words[i] for i in others]), strict=True):
            out[i] = ids
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more entry for the end)."""
        if self.by_word:
            data = shared.text_bytes(texts)[0].tobytes().lower()
            free = not any(t in data for t in self.special)
            return self.table.of(texts, bare=True, lower=free and self.lowers, marks=b",." if free else b"")
        ids = self.encode(texts.to_pylist())
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)])


def steps_of(vocabulary: dict) -> list[dict]:
    """The normalizers of a tokenizer file, one after another."""
    normalizer = vocabulary.get("normalizer") or {"type": "Sequence", "normalizers": []}
    return normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]


def splits_at_spaces(vocabulary: dict) -> bool:
    """Whether a tokenizer file encodes words apart: its normalizers are among those that work letter by letter, its first
    split keeps only matches of a pattern that can't hold white space, and its special tokens have no space about them."""
    local = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps_of(vocabulary))
    splitter = vocabulary.get("pre_tokenizer") or {}
    first = (splitter.get("pretokenizers") or [splitter])[0]
    # Fixed value: a pattern all of whose matches are letters, digits or other signs, of which none is white space.
    solid = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and first.get("pattern") == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
    return bool(local and solid and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in vocabulary.get("added_tokens", ())))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Chunk ends within each stream; the streams lie one after another in ids and begin at starts.

    A chunk ends where the top CUT_BITS bits of the rolling hash are 0, after LEAST ids or more, or after MOST ids. No
    window reaches into the stream before, as it is shorter than LEAST.
    """
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    for step in WINDOW_STEPS:
        y = x.copy()
        y[step:] += x[:-step] << np.uint64(step)
        x = y
    marks = np.flatnonzero(x >> np.uint64(64 - CUT_BITS) == 0) + 1
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        ends, at = [], a
        for m in marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while b - at > MOST:
            at += MOST
            ends.append(at)
        if b > at:
            ends.append(b)
        out.append(ends)
    return out


def merkle_root(names: Iterable[bytes]) -> bytes:
    """Root of the binary hash tree over names; an odd one is carried up."""
    level = list(names) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(level) & ~1 :]
    return level[0]


@lru_cache(maxsize=1)
def _zeros() -> np.ndarray:
    """(48, 4, 256): what the CRC-32 becomes by 2^k zero bytes, by each byte of it; appending zeros is linear in the CRC."""
    rows = np.array([0xEDB88320, *(1 << i for i in range(31))], dtype=np.uint32)  # one zero bit: row i is the image of bit i
    out = np.empty((48, 4, 256), dtype=np.uint32)

    def image(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        bits = (x[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
        return np.bitwise_xor.reduce(bits * rows, axis=-1)

    for _ in range(3):
        rows = image(rows, rows)
    for k in range(48):
        out[k] = image(rows, np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32)[:, None]))
        rows = image(rows, rows)
    return out


def crcs_of_all(crcs: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each concatenation, from those of its parts and their bytes; the parts of concatenation i end before ends[i], and each has one."""
    starts = np.concatenate(([0], ends[:-1]))
    crcs, out = crcs.astype(np.uint32), crcs[starts].astype(np.uint32)
    live, tables = np.arange(len(ends)), _zeros()
    step = 0
    while len(live):
        step += 1
        live = live[starts[live] + step < ends[live]]
        at = starts[live] + step
        x, n, k = out[live], sizes[at].astype(np.int64), 0
        while n.any():
            odd = (n & 1).astype(bool)
            y = x[odd]
            x[odd] = tables[k, 0][y & 255] ^ tables[k, 1][(y >> 8) & 255] ^ tables[k, 2][(y >> 16) & 255] ^ tables[k, 3][y >> 24]
            n, k = n >> 1, k + 1
        out[live] = x ^ crcs[at]
    return out


def packed(ids: np.ndarray, wide: bool, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def chunked(docs: DataFrame, path: str, end_id: int, id_col: str, text: str) -> DataFrame:
    """(id_col, t, seq, n, name, data): the chunks of each document; data is null where the task has sent that chunk before."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press, sent = encoder(path), zstandard.ZstdCompressor(level=3), set()
        for whole in batches:
            for batch, texts in shared.slices(whole, 2):
                ids, bounds = own.texts(texts)
                ids = np.insert(ids, bounds[1:], end_id)
                starts = bounds[:-1] + np.arange(len(texts))
                row, seq, n, name, data = [], [], [], [], []
                for i, ends in enumerate(cuts(ids, starts)):
                    a = int(starts[i])
                    for k, b in enumerate(ends):
                        part = ids[a:b]
                        digest = hashlib.sha256(part.tobytes()).digest()
                        row.append(i)
                        seq.append(k)
                        n.append(b - a)
                        name.append(digest)
                        data.append(None if digest in sent else packed(part, own.wide, press))
                        if len(sent) > SENT:
                            sent.clear()
                        sent.add(digest)
                        a = b
                where = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(seq, pa.int32()), pa.array(n, pa.int32()), pa.array(name, pa.binary()), pa.array(data, pa.binary())], names=[id_col, "t", "seq", "n", "name", "data"])

    return docs.select(id_col, F.xxhash64(text).alias("t"), text).mapInArrow(run, f"`{id_col}` {kind}, t long, seq int, n int, name binary, data binary")


def store_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes each chunk once, into files of `folder`; (…, seq, n, name, file) for each chunk of each document, without data."""
    kept = [c for c in chunks.columns if c != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name != "data") + ", file string"
    deal = F.when(F.col("data").isNull(), F.xxhash64(chunks.columns[0], "t", "seq")).otherwise(F.xxhash64("name"))
    dealt = chunks.withColumn("_d", deal).repartition(shared.partitions(chunks.sparkSession), "_d").sortWithinPartitions(F.col("data").isNull(), "name").drop("_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        file = f"chunks-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        out, names, last = None, [], None
        try:
            for batch in batches:
                for name, n, data in zip(batch.column("name"), batch.column("n"), batch.column("data"), strict=True):
                    if not data.is_valid:
                        break
                    if (name := name.as_py()) == last:
                        continue
                    if out is None:
                        system.create_dir(base, recursive=True)
                        out = system.open_output_stream(f"{base}/{file}")
                        out.write(MAGIC)
                    last, data = name, data.as_py()
                    out.write(name + struct.pack("<II", n.as_py(), len(data)) + data)
                    names.append(name)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([None if out is None else file] * batch.num_rows, pa.string())], names=[*kept, "file"])
            if out is not None:
                out.write(bytes(32) + struct.pack("<Q", len(names)) + merkle_root(names))
        finally:
            if out is not None:
                out.close()

    return dealt.mapInArrow(run, schema)


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> str:
    """Encodes and stores docs below `folder`, a path that all machines share, and returns that folder."""
    spark = docs.sparkSession
    placed = shared.cut(store_chunks(chunked(docs, path, end_id, id_col, text), f"{folder}/chunks"))
    placed.select("file").where("file is not null").distinct().write.parquet(f"{folder}/files")
    # Repeated rows share a recipe; each copy gets its own place.
    recipes = placed.groupBy(id_col, "t").agg(F.sort_array(F.collect_set(F.struct("seq", "n", "name"))).alias("chunks"), F.count_if(F.col("seq") == 0).alias("m"))
    recipes = recipes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).drop("m")
    order = [F.col(id_col).asc_nulls_last(), "t", "copy"]
    ranged = recipes.withColumn("n_tokens", F.aggregate("chunks", F.lit(0).cast("long"), lambda s, c: s + c["n"])).repartitionByRange(shared.partitions(spark), *order).sortWithinPartitions(*order)
    kind = docs.schema[id_col].dataType.simpleString()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            sums = before + np.cumsum(n)
            before = int(sums[-1]) if len(sums) else before
            roots = [merkle_root(c["name"] for c in chunks) for chunks in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("chunks"), batch.column("n_tokens"), pa.array(sums - n), pa.array([part] * len(n), pa.int32()), pa.array(roots, pa.binary())], names=[id_col, "chunks", "n_tokens", "local", "part", "root"])

    rows = shared.cut(ranged.select(id_col, "chunks", "n_tokens").mapInArrow(within, f"`{id_col}` {kind}, chunks array<struct<seq:int,n:int,name:binary>>, n_tokens long, local long, part int, root binary"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition
    offsets = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows.join(F.broadcast(offsets), "part").select(id_col, (F.col("base") + F.col("local")).alias("start"), "n_tokens", "root", "chunks").write.parquet(f"{folder}/recipes")
    return folder


def read_chunks(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(name, n, crc[, ids]) of each chunk in the files; name and crc are computed from the ids read, and the file's manifest is verified."""
    files = spark.read.parquet(f"{folder}/files")
    spread = files.repartition(max(1, shared.partitions(spark)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(f"{folder}/chunks")
        for file in (x.as_py() for b in batches for x in b.column(0)):
            with system.open_input_stream(f"{base}/{file}") as source:
                if source.read(len(MAGIC)) != MAGIC:
                    raise ValueError(f"{file} is no chunk file")
                names, rows = [], []
                while (name := source.read(32)) != bytes(32):
                    n, size = struct.unpack("<II", source.read(8))
                    ids = unpacked(source.read(size), n).tobytes()
                    found = hashlib.sha256(ids).digest()
                    if found != name or len(ids) != 4 * n:
                        raise ValueError(f"a chunk of {file} is not what its name says")
                    names.append(found)
                    rows.append((found, n, zlib.crc32(ids), ids if with_ids else None))
                    if len(rows) >= 2000:
                        yield _batch(rows, with_ids)
                        rows = []
                count, root = struct.unpack("<Q", source.read(8))[0], source.read(32)
                if count != len(names) or root != merkle_root(names):
                    raise ValueError(f"the manifest of {file} does not hold")
                if rows:
                    yield _batch(rows, with_ids)

    return spread.mapInArrow(run, "name binary, n int, crc long" + ", ids binary" * with_ids)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    name, n, crc, ids = zip(*rows, strict=True)
    columns = [pa.array(name, pa.binary()), pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns[: 3 + with_ids], names=["name", "n", "crc", "ids"][: 3 + with_ids])


def _followed(spark: SparkSession, folder: str, with_ids: bool) -> tuple[DataFrame, str]:
    """The recipes, each chunk with what its file holds, one row per document, and the type of the id."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    id_col = recipes.columns[0]
    steps = recipes.select("start", F.inline("chunks"))
    held = read_chunks(spark, folder, with_ids).withColumnRenamed("n", "held")
    what = ["seq", "held", "name", "crc", *["ids"] * with_ids]
    # What Catalyst knows of the chunks' size is that of the list of files, so the join is named: it must not be a broadcast.
    found = steps.hint("merge").join(held.hint("merge"), "name", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct(*what))).alias("found"))
    return recipes.select(id_col, "start", "n_tokens", "root").hint("merge").join(found.hint("merge"), "start"), id_col


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files, each verified against its Merkle root."""
    joined, id_col = _followed(spark, folder, False)
    kind = joined.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            found = lists.flatten()
            held, names = (found.field(c).to_pylist() for c in ("held", "name"))
            ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))
            stops = ends.tolist()
            for n, root, a, b in zip(batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist(), [0, *stops], stops, strict=False):
                if None in held[a:b] or merkle_root(names[a:b]) != root or sum(held[a:b]) != n:
                    raise ValueError("a document is not what its recipe says")
            sums = crcs_of_all(found.field("crc").to_numpy(), 4 * np.array(held, dtype=np.int64), ends).astype(np.int64) if stops else []
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (id_col, "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, ids): the documents' ids put together again, as little-endian unsigned 32-bit integers in binary."""
    joined, id_col = _followed(spark, folder, True)
    return joined.select(id_col, "start", F.aggregate("found", F.lit(b"").cast("binary"), lambda all_, c: F.concat(all_, c["ids"])).alias("ids"))
