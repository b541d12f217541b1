"""Repeated byte strings by prefix doubling over sparse suffixes, with hash names in place of ranks.

A suffix array by prefix doubling names every position by the rank of the string of
length h that starts there, sorts pairs of names (position p, position p + h), names
the pairs, and goes on with 2h until a name is unique or the length passes the threshold.
Here names are hashes: Spark deals them to key ranges and counts them there, but ranks nothing anew.
Two things keep the data that is dealt small:

* Only anchors are sorted.  The anchor of a ``length``-byte window is the position of the
  least 16-byte hash among its first ``length - core + 1`` positions (``core`` a power of
  two).  It depends on the window's bytes alone, so equal windows have equal anchors, and
  all windows of an anchor hold the ``core`` bytes from it.
* Ranks are 64-bit names instead of dense numbers.  Names up to a quarter of the core are
  made inside a task; from there on Spark deals the pairs to key ranges (``packed``).

Rounds: pairs at core/4 and at core/2; anchors with a unique name leave after each.  Past the
core, anchors with one name are sorted by the whole string their windows cover: if that
repeats, all its windows repeat; if all strings of a name are alike but do not repeat, none
does; the windows of the rest are sorted themselves at the full length.

Strings are judged on the input, overlaps and repeats inside one document count, and no
string crosses documents.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; rows
with equal ids are separate documents (so they remove each other); an empty table gives no rows;
extra columns are ignored; a text of one repeated byte has an anchor at every position and
costs as much more.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed as P
from .common import BYTE_HASH, U64, map_arrow, mix, text_bytes, write_scratch

GRAM, BASE = 16, 32  # bytes that choose anchors; the shortest name kept for a whole chunk
SLICE = 1 << 17


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for pairs of names."""
    t = (a ^ (b >> U64(32))) * U64(0x9FB21C651E98DF25) + b * U64(0xD6E8FEB86659FD93)
    return t ^ (t >> U64(32))


def double(h: np.ndarray, step: int) -> np.ndarray:
    return pair(h[:-step], h[step:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    m, n = x, 1
    while 2 * n <= width:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[:len(m) - (width - n)], m[width - n:]) if width > n else m


class Chunk:
    """Bytes of a chunk's documents, names of BASE bytes everywhere, and the anchors:
    position, first and last window that it stands for."""

    def __init__(self, body: bytes, length: int, core: int):
        self.table = P.read_body(body)
        self.data, self.off = text_bytes(self.table.column(1))
        self.length, self.core = length, core
        width = length - core + 1
        self.names = np.zeros(len(self.data), U64)
        found = []
        sizes = np.diff(self.off)
        i, n = 0, len(sizes)
        while i < n:  # documents in slices that fit the cache
            j = i + 1
            while j < n and self.off[j + 1] - self.off[i] <= SLICE:
                j += 1
            a, z = int(self.off[i]), int(self.off[j])
            if z - a >= length:
                found.append(self._slice(a, z, self.off[i:j + 1] - a, width))
            i = j
        none = np.zeros(0, np.int64)
        self.at, self.first, self.last = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none)

    def _slice(self, a: int, z: int, off: np.ndarray, width: int):
        h, n = BYTE_HASH[self.data[a:z]], 1
        while n < GRAM:
            h, n = double(h, n), 2 * n
        key = (mix(h) & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
        while n < BASE:
            h, n = double(h, n), 2 * n
        self.names[a:a + len(h)] = h
        anchor = (sliding_min(key, width) & U64(0xFFFFFFFF)).astype(np.int64)
        ok = np.zeros(z - a, bool)
        for s, e in itertools.pairwise(off.tolist()):
            if e - s >= self.length:
                ok[s:e - self.length + 1] = True
        x = np.flatnonzero(ok)
        p = anchor[x]
        new = np.ones(len(x), bool)
        new[1:] = (p[1:] != p[:-1]) | (x[1:] != x[:-1] + 1)
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(x)) - 1
        return p[s] + a, x[s] + a, x[e] + a

    def rank(self, x: np.ndarray, n: int) -> np.ndarray:
        """Names of the n bytes from x, n a power of two."""
        return self.names[x] if n == BASE else pair(self.rank(x, n // 2), self.rank(x + n // 2, n // 2))

    def window(self, x: np.ndarray) -> np.ndarray:
        """Names of the full-length windows at x."""
        return mix(pair(self.rank(x, self.core), self.rank(x + self.length - self.core, self.core)))

    def keep(self, which: np.ndarray) -> None:
        self.at, self.first, self.last = self.at[which], self.first[which], self.last[which]

    def paired(self, half: int, buckets: int):
        """Sorted distinct names of pairs (half bytes at the anchor, half bytes after), each anchor's, and how often."""
        k = P.short_keys(mix(pair(self.rank(self.at, half), self.rank(self.at + half, half))), buckets)
        return np.unique(k, return_inverse=True, return_counts=True)

    def survive(self, half: int, buckets: int, replies) -> None:
        keys, inv, n = self.paired(half, buckets)
        self.keep((P.bits_of(replies, P.edges(keys >> U64(32), buckets), 1)[0] | (n > 1))[inv])

    def covers(self, buckets: int):
        """Distinct (core name, whole string) pairs in order, each anchor's, and how often."""
        k = P.short_keys(mix(self.rank(self.at, self.core)), buckets)
        whole = pair(pair(self.window(self.first), self.window(self.last)),
                     mix(((self.at - self.first) * 4096 + self.last - self.first).astype(U64)))
        order = np.lexsort((whole, k))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(k[order]) != 0) | (np.diff(whole[order]) != 0)
        number = np.zeros(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return k[order][new], whole[order][new], number, np.bincount(number, minlength=int(new.sum()))

    def windows(self, buckets: int, replies):
        """Anchors whose windows all repeat, and the windows to be looked up."""
        k, _, number, n = self.covers(buckets)
        again, mixed = P.bits_of(replies, P.edges(k >> U64(32), buckets), 2)
        sure = (again | (n > 1))[number]
        f, z = self.first[mixed[number]], self.last[mixed[number]]
        size = z - f + 1
        return sure, np.repeat(f - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(f) else np.zeros(0, np.int64)

    def window_keys(self, x: np.ndarray):
        g = self.window(x)
        return np.unique((g << U64(32)) | (g >> U64(32)), return_inverse=True, return_counts=True)


def _swap(k: np.ndarray) -> np.ndarray:
    return (k << U64(32)) | (k >> U64(32))


def elsewhere(low_bits: int):
    """Answers whether each key stands in another chunk."""
    def judge(k):
        inv, n = P.key_groups(k)
        return np.bincount(inv, minlength=n)[inv] > 1

    def answer(keys, extra):
        return [np.packbits(hit).tobytes() for hit in P.by_parts(judge, [P.unpack(k, low_bits) for k in keys])]
    return answer


def answer_covers(keys, extra):
    """For (core name, whole string): whether another chunk has it; whether the name has other strings."""
    def judge(k, whole):
        order = np.lexsort((whole, k))
        name = np.cumsum(np.append(True, np.diff(k[order]) != 0)) - 1
        both = np.cumsum(np.append(True, (np.diff(k[order]) != 0) | (np.diff(whole[order]) != 0))) - 1
        strings = np.bincount(name[np.append(True, np.diff(both) != 0)])
        again, mixed = np.zeros(len(k), bool), np.zeros(len(k), bool)
        again[order] = np.bincount(both)[both] > 1
        mixed[order] = strings[name] > 1
        return np.stack([again, mixed])

    found = P.by_parts(judge, [P.unpack(k, 16) for k in keys], [np.frombuffer(x, U64) for x in extra])
    return [np.packbits(again).tobytes() + np.packbits(mixed).tobytes() for again, mixed in found]


def remove_repeats(docs: DataFrame, length: int = 400, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256): every text without the
    bytes of strings of ``length`` bytes that also start elsewhere."""
    core = 1 << ((length * 3 // 4).bit_length() - 1)
    if core < 4 * BASE:
        raise ValueError("length must be at least 172")
    chunks = P.write_chunks(docs, "chunks", chunk_bytes)
    buckets = P.bucket_count(chunks, 2 / (length - core))
    ranges = P.bucket_count(chunks, 1 / 16)

    def ask(frame: DataFrame, emit, answer, name: str) -> DataFrame:
        """One round: every chunk, cut down by the earlier rounds' replies, sends its keys."""
        def run(batches):
            for b in batches:
                for row in zip(b.column(0).to_pylist(), b.column(1), *[c.to_pylist() for c in b.columns[2:]]):
                    c = Chunk(row[1].as_py(), length, core)
                    for half, replies in zip((core // 4, core // 2), row[2:4]):
                        c.survive(half, buckets, replies)
                    yield P.packed_rows(row[0], emit(c, row[4:]))
        return write_scratch(P.ask(map_arrow(frame, run, P.PACKED), answer), name)

    def items(keys, of_bucket, n, low_bits, extra=None, mask=U64(0xFFFFFFFF)):
        return [(i, P.pack(keys[a:z] & mask, low_bits), extra[a:z].tobytes() if extra is not None else b"")
                for i, (a, z) in enumerate(itertools.pairwise(P.edges(of_bucket, n))) if z > a]

    def emit_pairs(half):
        def emit(c, _):
            keys = c.paired(half, buckets)[0]
            return items(keys, keys >> U64(32), buckets, 16)
        return emit

    def emit_covers(c, _):
        k, whole, _, _ = c.covers(buckets)
        return items(k, k >> U64(32), buckets, 16, whole)

    def emit_windows(c, replies):
        keys = c.window_keys(c.windows(buckets, replies[0])[1])[0]
        return items(keys, P.route(_swap(keys), ranges), ranges, 48, mask=U64(0xFFFFFFFFFFFFFFFF))

    quarter = ask(chunks.select("chunk_id", "body"), emit_pairs(core // 4), elsewhere(16), "pairs-1")
    half = ask(P.replies_by(chunks, r1=quarter), emit_pairs(core // 2), elsewhere(16), "pairs-2")
    cover = ask(P.replies_by(chunks, r1=quarter, r2=half), emit_covers, answer_covers, "covers")
    full = ask(P.replies_by(chunks, r1=quarter, r2=half, r3=cover), emit_windows, elsewhere(48), "windows")

    def finish(batches):
        for b in batches:
            for row in zip(b.column(1), *[c.to_pylist() for c in b.columns[2:]]):
                c = Chunk(row[0].as_py(), length, core)
                c.survive(core // 4, buckets, row[1])
                c.survive(core // 2, buckets, row[2])
                sure, x = c.windows(buckets, row[3])
                keys, inv, n = c.window_keys(x)
                found = x[(P.bits_of(row[4], P.edges(P.route(_swap(keys), ranges), ranges), 1)[0] | (n > 1))[inv]]
                mark = np.zeros(len(c.data) + 1, np.int32)
                np.add.at(mark, np.concatenate([c.first[sure], found]), 1)
                np.subtract.at(mark, np.concatenate([c.last[sure], found]) + length, 1)
                keep = np.cumsum(mark[:-1]) == 0
                start = ~keep
                start[1:] &= keep[:-1]
                edge = c.off[1:-1]
                edge = edge[edge < len(keep)]
                start[edge] = ~keep[edge]
                total = lambda m: np.diff(np.concatenate([[0], np.cumsum(m)])[c.off])
                kept = [c.data[s:e][keep[s:e]].tobytes() for s, e in itertools.pairwise(c.off.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [c.table.column(0).combine_chunks(), pa.array(np.diff(c.off)), pa.array(total(~keep)), pa.array(total(start)),
                     pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return map_arrow(P.replies_by(chunks, r1=quarter, r2=half, r3=cover, r4=full), finish,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
