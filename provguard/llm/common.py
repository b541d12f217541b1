"""Shared helpers: vectorised words and hashes inside Arrow tasks, scratch tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# White space that parts words: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element-wise."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# One random 64-bit value for each byte, made by rule.
BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_M = 0xD6E8FEB86659FD93
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse mod 2^64, kept between batches."""
    have = _POWERS.get("m")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inv = pow(_M, -1, 1 << 64)
        for name, base in (("m", _M), ("inv", inv)):
            p = np.ones(size, U64)
            k = 1
            while k < size:  # p[k:2k] = p[:k] * base^k
                m = min(k, size - k)
                p[k:k + m] = p[:m] * U64(pow(base, k, 1 << 64))
                k *= 2
            _POWERS[name] = p
    return _POWERS["m"][:n], _POWERS["inv"][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    if len(off) == 0 or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of every word, and the word offsets (n+1) of every text."""
    inside = ~sep[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]  # words end with their text
    ends[edge - 1] = inside[edge - 1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off)


SPAN_BLOCK = 1 << 20


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, in order of place: equal bytes, equal hash, wherever they stand.

    Sums run over ``SPAN_BLOCK`` bytes at a time, so that memory follows the longest span and not the data."""
    out = np.zeros(len(s), U64)
    i = 0
    while i < len(s):
        first = int(s[i])
        j = max(i + 1, int(np.searchsorted(e, first + SPAN_BLOCK, "right")))
        part = data[first:int(e[j - 1])]
        m, inv = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, U64)
        np.cumsum(BYTE_HASH[part] * m[:-1], out=total[1:])
        a, z = s[i:j] - first, e[i:j] - first
        out[i:j] = mix((total[z] - total[a]) * inv[a] + (z - a).astype(U64))
        i = j
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive word hashes at every start (text ends are the caller's)."""
    if len(words) < n:
        return np.zeros(0, U64)
    k = len(words) - n + 1
    h = np.zeros(k, U64)
    for j in range(n):
        h = (h ^ words[j:j + k]) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(32)
    return mix(h)


def text_of_item(off: np.ndarray) -> np.ndarray:
    """For offsets of n texts, the text number of each item."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def first_of(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each owner's first k by score downwards, then by id."""
    order = np.lexsort((ident, -score, owner))
    o = owner[order]
    start = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    place = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
    return order[place < k]


def window_ok(woff: np.ndarray, n: int) -> np.ndarray:
    """Marks, for each start of an n-gram over all words, that it stays in one text."""
    total = int(woff[-1])
    if total < n:
        return np.zeros(0, bool)
    d = text_of_item(woff)
    return d[:total - n + 1] == d[n - 1:]


def slices(batches, max_bytes: int = 4 << 20, text: str = "text"):
    """Cut Arrow batches into row ranges of about ``max_bytes`` of text (one row at least)."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0)).astype(np.int64)
        total = np.cumsum(size)
        i = 0
        while i < n:
            base = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, base + max_bytes, "right")))
            yield b.slice(i, j - i)
            i = j


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back: lineage ends, and a
    lost executor costs only the tasks it ran."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the named columns, each once; extra columns never clash with the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in needed])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    fd, path = tempfile.mkstemp(suffix=".zip", prefix=f"{package.name}-")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    spark.sparkContext.addPyFile(path)  # from the driver's disk to every executor
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
