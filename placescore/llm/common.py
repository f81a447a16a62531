"""Helpers shared by the corpus operators: tables, lineage cuts, words, hashes.

The numpy helpers work on one Arrow string column at a time (a record batch of a
Spark task).  They look at every byte of every text; a batch is walked in slices
of about ``SLICE_BYTES`` so that memory stays bounded whatever the batch size.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

SLICE_BYTES = 2 << 20

_GAPS = np.zeros(256, bool)
_GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Gap table for word characters only: ASCII letters and digits and all UTF-8 bytes from 0x80.
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], dtype=np.uint64)


# --- tables and lineage -------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few given rows as a frame that Spark makes itself (no Python data on the executors)."""
    names = [part.split()[0] for part in schema.split(", ")]
    data = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in schema.split(', '))}>>")))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the session names.

    ``spark.checkpoint.dir`` is read from the session.  A folder of our own is
    made only for a local master that names none (tests); on a cluster a missing
    setting is an error, as executors would not see a local folder.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in that folder and read back: smaller than a checkpoint, for larger tables."""
    path = f"{checkpoint_folder(df.sparkSession)}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpus-ckpt-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def words(text: Column) -> Column:
    """The words of a text as an array (null text: empty array)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit digest (hex) of id and text; null, of either, differs from any value."""
    text = F.coalesce(F.md5(F.col(text_col)), F.lit("n"))
    return F.md5(F.concat(text, F.coalesce(F.concat(F.lit(":"), F.col(id_col).cast("string")), F.lit("n"))))


# --- numpy over Arrow strings -------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64; a bijection."""
    x = (x ^ (x >> _S1)) * _M1
    x = (x ^ (x >> _S2)) * _M2
    return x ^ (x >> _S3)


def text_slices(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) over slices of a string column; null is empty.

    ``bytes`` has 8 zero bytes more than ``offsets[-1]`` so that 8-byte loads
    stay inside.  A slice has at least one row and at most ``SLICE_BYTES`` bytes
    unless a single text is longer.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1)
        part = np.zeros(offs[end] - offs[row] + 8, np.uint8)
        part[:-8] = data[offs[row]:offs[end]]
        yield row, part, offs[row:end + 1] - offs[row]
        row = end


def word_spans(part: np.ndarray, offs: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text, and one past the last) of all words."""
    n = int(offs[-1])
    gap = (_NOT_ALNUM if alnum else _GAPS)[part[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.ones(n, bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def loads(part: np.ndarray) -> np.ndarray:
    """A view with the 8 bytes from each position on as one little-endian integer."""
    return np.ndarray(shape=(len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased if ``lower``)."""
    if lower:
        part = _LOWER[part]
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    view = loads(part)
    for k in np.flatnonzero(size > 64):
        out[k] = int.from_bytes(hashlib.blake2b(part[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    todo = np.flatnonzero((size > 0) & (size <= 64))
    at = 0
    while len(todo):
        piece = view[starts[todo] + at] & _KEEP[np.minimum(size[todo] - at, 8)]
        out[todo] = mix(out[todo] ^ piece)
        at += 8
        todo = todo[size[todo] > at]
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; fewer words make one run; none make none."""
    if not len(hashes):
        return hashes
    w = min(width, len(hashes))
    out = np.full(len(hashes) - w + 1, np.uint64(w))
    for k in range(w):
        out = mix(out ^ hashes[k:len(hashes) - w + 1 + k]) + np.uint64(k)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
