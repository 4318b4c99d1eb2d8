"""Fill-in-middle: a text is cut at two line ends into prefix, middle and suffix, which are laid out anew between markers.

A text's UTF-8 bytes are translated to "0" and "1" by class and read as one big integer, a bit for each byte, the first byte as
the highest bit. Shifting the mask of line feeds by a bit marks where lines begin; bit_count gives their number; the line
of a rank is found by halving the integer again and again, by the count of its upper half. The mask of bytes that begin a code
point turns places into characters the same way. All of it is linear in the bytes of a text, whatever its length.

Each document draws from the SHA-256 of `seed:id`, so reruns and other partitionings agree. Nothing is shuffled.

Edge cases: a null text is empty, and empty texts and texts that hold a marker stay plain; a null id draws from the seed alone;
repeated rows get equal results; an empty table gives an empty result; extra columns are kept, but those with the name of a
result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeforms.llm import shared

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of a hundred documents, how many are transformed, and how many of these have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
RESULTS = {"n": T.LongType(), "form": T.StringType(), "output": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}
LINE_FEED = bytes(49 if b == 10 else 48 for b in range(256))
LEADING = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))  # all but what continues a code point


def mask(text: bytes, table: bytes) -> int:
    """A bit for each byte of a text, set where the table has a "1"; the first byte is the highest bit."""
    return int(text.translate(table), 2) if text else 0


def line_starts(text: bytes) -> int:
    """The mask of bytes at which a line begins: the first, and those after a line feed."""
    return mask(text, LINE_FEED) >> 1 | 1 << len(text) - 1 if text else 0


def place(bits: int, size: int, rank: int) -> int:
    """At which byte the set bit of that rank (from 0) is, among `size` of them; size where there are not so many."""
    if rank >= bits.bit_count():
        return size
    at = 0
    while size > 1:
        low = size >> 1
        upper = bits >> low
        n = upper.bit_count()
        if rank < n:
            bits, size = upper, size - low
        else:
            rank -= n
            at += size - low
            bits, size = bits & (1 << low) - 1, low
    return at


def characters(text: bytes) -> int:
    return mask(text, LEADING).bit_count()


def draws(doc_id: int | str | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """The first four unsigned 32-bit numbers of the SHA-256 of `seed:id`."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def laid_out(text: bytes, doc_id: int | str | None, seed: int, rate: int, suffix_first: int) -> tuple[int, str, bytes, int | None, int | None]:
    """(n, form, output, prefix_chars, middle_chars) of one text."""
    starts = line_starts(text)
    n = starts.bit_count()
    first, second, form, order = draws(doc_id, seed)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not text or any(x in text for x in (p, s, m)) or form % 100 >= rate:
        return n, "plain", text, None, None
    lo, hi = sorted((first % (n + 1), second % (n + 1)))
    a = place(starts, len(text), lo)
    b = place(starts, len(text), hi)
    before, middle, after = text[:a], text[a:b], text[b:]
    sizes = characters(before), characters(middle)
    if order % 100 < suffix_first:
        return n, "spm", b"".join((s, after, p, before, m, middle)), *sizes
    return n, "psm", b"".join((p, before, s, after, m, middle)), *sizes


def transformed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs with n (lines), form (plain, psm or spm), output, prefix_chars and middle_chars (code points; null if plain)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS)).alias("_row"), F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([rows.schema["_row"], *(T.StructField(k, v) for k, v in RESULTS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in shared.slices(batch, 2):
                data, ends = shared.text_bytes(texts)
                data, ends = memoryview(data), ends.tolist()
                made = [laid_out(bytes(data[a:b]), i, seed, rate, suffix_first) for a, b, i in zip(ends, ends[1:], part.column(1).to_pylist(), strict=False)]
                n, form, output, before, middle = zip(*made, strict=True)
                columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), _strings(output), pa.array(before, pa.int64()), pa.array(middle, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_row", *RESULTS])

    made = rows.mapInArrow(run, schema)
    return made.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c not in RESULTS), *RESULTS)


def _strings(parts: tuple[bytes, ...]) -> pa.Array:
    """Texts of at most 2 GB together, as they are: what Spark holds isn't always valid UTF-8."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.StringArray.from_buffers(len(parts), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form come from. No text that was laid out holds a marker, so each is met once."""

    def after(x: Column, marker: str) -> Column:
        return F.substring(x, F.instr(x, marker) + len(marker), F.length(x))

    def before(x: Column, marker: str) -> Column:
        return F.substring_index(x, marker, 1)

    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
