"""Asking about very many keys across documents with little shuffled data.

Documents are written once as chunks: rows of (chunk_id, body), where a body holds some
MB of documents, compressed, in a table bucketed by chunk_id, so that later passes and
joins on chunk_id read it without a shuffle.

A pass asks a question about 64-bit keys ("does this key stand in another chunk?").  Each
chunk sorts its distinct keys, so a key that a third of all documents share costs one
entry a chunk, and deals them by hash into key ranges ("buckets"): one row for each
(chunk, bucket), sorted keys delta-coded.  One task joins the entries of one bucket; their
number is held near ``per_bucket`` by taking as many buckets as the input needs, and
they are sorted one range of keys after the other (``by_parts``).  The answers go back as bitmaps, one bit for each entry, in the order in which the chunk, which
is the same at every pass, lists its keys.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import input_bytes, scratch_path
from .common import U64, checked_columns, map_arrow, ship

NULL_ID = np.iinfo(np.int64).max  # a null doc_id: larger than any other


def write_chunks(docs: DataFrame, name: str, chunk_bytes: int = 4 << 20, buckets: int | None = None,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, n_bytes, body) rows of all (doc_id, text, *carry) rows, as a bucketed scratch table."""
    spark = docs.sparkSession

    def run(batches):
        part = TaskContext.get().partitionId()
        held, size, k = [], 0, 0

        def body():
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | k], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["chunk_id", "n_bytes", "body"])

        for b in batches:
            lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= chunk_bytes:
                    held.append(b.slice(at, i + 1 - at))
                    yield body()
                    held, size, k, at = [], 0, k + 1, i + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield body()

    rows = checked_columns(docs, ["doc_id", "text", *carry]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in carry])
    chunks = map_arrow(rows, run, "chunk_id long, n_bytes long, body binary")
    path, table = scratch_path(spark, name), f"provguard_{name}_{uuid.uuid4().hex[:12]}"
    # As many buckets as shuffles have partitions, fewer for an input of fewer chunks (texts in
    # files take at least half their size).
    most = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = input_bytes(docs)
    n = buckets or (min(most, 2 + 2 * known // chunk_bytes) if known else most)
    (chunks.write.format("parquet").option("path", path).option("compression", "none")
     .bucketBy(n, "chunk_id").saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # external: the catalog forgets it, the files stay
    return out


def read_body(body: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.BufferReader(body)) as r:
        return r.read_all()


def bucket_count(chunks: DataFrame, keys_per_byte: float, per_bucket: int = 3_000_000) -> int:
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(1, int(np.ceil(total * keys_per_byte / per_bucket)))


def route(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key, from its low half."""
    return ((keys & U64(0xFFFFFFFF)) * U64(buckets)) >> U64(32)


def short_keys(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the key's high half in one number: enough to name candidates, since
    the buckets grow with the input and each keeps 32 bits."""
    return (route(keys, buckets) << U64(32)) | (keys >> U64(32))


def edges(sorted_buckets: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(sorted_buckets, np.arange(buckets + 1, dtype=U64))


def _zip(a: np.ndarray) -> bytes:
    return pa.compress(a.tobytes(), codec="zstd", asbytes=True)


def _unzip(b: bytes, n: int, dtype) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    return np.frombuffer(pa.decompress(b, decompressed_size=size, codec="zstd", asbytes=True), dtype) if n else np.zeros(0, dtype)


def pack(keys: np.ndarray, low_bits: int) -> bytes:
    """Sorted distinct keys as differences: low bits raw, the rest, mostly 0, compressed."""
    d = np.diff(keys, prepend=U64(0))
    low = (d & U64((1 << low_bits) - 1)).view(np.uint8).reshape(-1, 8)[:, :low_bits // 8]
    high = _zip((d >> U64(low_bits)).astype(np.uint16))
    return np.uint32(len(keys)).tobytes() + np.uint32(len(high)).tobytes() + high + low.tobytes()


def unpack(b: bytes, low_bits: int) -> np.ndarray:
    n, m = (int(x) for x in np.frombuffer(b[:8], np.uint32))
    high = _unzip(b[8:8 + m], n, np.uint16).astype(U64)
    low = np.zeros((n, 8), np.uint8)
    low[:, :low_bits // 8] = np.frombuffer(b[8 + m:], np.uint8).reshape(n, low_bits // 8)
    return np.cumsum((high << U64(low_bits)) + low.view(U64).ravel(), dtype=U64)


def key_groups(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each entry's key among all distinct keys, and how many there are."""
    u, inv = np.unique(keys, return_inverse=True)
    return inv, len(u)


def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair's number among the distinct pairs (a, b) in order, and a place of each distinct pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def by_parts(judge, lists: list[np.ndarray], *beside: list[np.ndarray], size: int = 1 << 18) -> list[np.ndarray]:
    """What ``judge`` gives for the entries of sorted key lists, list by list.

    ``judge`` takes keys and what stands beside them, and gives an array whose last axis is theirs.  It gets
    one range of keys after the other, about ``size`` entries each and all entries of a key together, so
    that its sorts need memory for a part and not for the bucket."""
    full = [k for k in lists if len(k)]
    low, high = min((int(k[0]) for k in full), default=0), max((int(k[-1]) for k in full), default=0)
    n = max(1, -(-sum(map(len, lists)) // size))
    bounds = np.array([low + (high - low) * i // n for i in range(1, n)], U64)  # keys are hashes: about equal parts
    cuts = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]).tolist() for k in lists]
    out: list[np.ndarray] = []
    for p in range(n):
        at = [slice(c[p], c[p + 1]) for c in cuts]
        off = np.concatenate([[0], np.cumsum([s.stop - s.start for s in at])]).tolist()
        if n > 1 and not off[-1]:
            continue
        found = judge(*[np.concatenate([x[s] for x, s in zip(column, at)]) for column in (lists, *beside)])
        out = out or [np.empty((*found.shape[:-1], len(k)), found.dtype) for k in lists]
        for x, s, a, z in zip(out, at, off, off[1:]):
            x[..., s] = found[..., a:z]
    return out


def ask(packed: DataFrame, answer) -> DataFrame:
    """Rows (bucket, chunk_id, keys, extra) -> (chunk_id, replies) with one reply a bucket.

    ``answer`` takes the lists of key and extra payloads of one bucket and gives a list of replies."""
    ship(packed.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        replies = answer(list(pdf["keys"]), list(pdf["extra"]))
        return pd.DataFrame({"chunk_id": pdf["chunk_id"], "bucket": pdf["bucket"], "reply": replies})

    out = packed.groupBy("bucket").applyInPandas(run, "chunk_id long, bucket int, reply binary")
    return out.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))


PACKED = "bucket int, chunk_id long, keys binary, extra binary"


def packed_rows(chunk_id: int, items: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in items], pa.int32()), pa.array([chunk_id] * len(items), pa.int64()),
         pa.array([x[1] for x in items], pa.binary()), pa.array([x[2] for x in items], pa.binary())],
        names=["bucket", "chunk_id", "keys", "extra"])


def bits_of(replies: list[dict] | None, at: np.ndarray, planes: int) -> np.ndarray:
    """Answer bits (planes x keys) of a chunk's sorted keys; ``at``: its bucket edges."""
    out = np.zeros((planes, int(at[-1])), bool)
    for r in replies or ():
        a, z = int(at[r["bucket"]]), int(at[r["bucket"] + 1])
        b = np.unpackbits(np.frombuffer(r["reply"], np.uint8)).astype(bool)
        width = 8 * -(-(z - a) // 8)
        for p in range(planes):
            out[p, a:z] = b[p * width:p * width + z - a]
    return out


def replies_by(chunks: DataFrame, **replies: DataFrame) -> DataFrame:
    """Chunks with the replies of earlier passes beside them."""
    out = chunks.select("chunk_id", "body")
    for name, r in replies.items():
        r = r.select(F.col("chunk_id").alias(f"{name}_chunk"), F.col("replies").alias(name))
        out = out.join(r, F.col("chunk_id") == F.col(f"{name}_chunk"), "left").drop(f"{name}_chunk")
    return out
