"""Substring dedup by fixed-block anchors.

Reference blocks: every document's words are cut into non-overlapping blocks of ``block``
words.  A repeated window of ``window`` >= 2 * block - 1 words holds a whole block of the
document it repeats, wherever the block grid falls, so it is enough to index blocks and to
probe them with every rolling window of ``block`` words.

1. Block keys are indexed and probed by all rolling keys, across documents (packed keys:
   see ``packed``).  Both sides learn which of their blocks and probes hit.
2. Hits are extended: every full window around a hit, on either side, is looked up by
   its key for the smallest document that holds it.
3. Runs of windows found in a smaller document are maximal exact repeats; their words go.

Windows are judged on the input.  Keys are 64-bit hashes of word hashes; the hashes in step
1 only choose candidates.  In step 2, which decides, each window has a second hash beside its key, so
that windows are taken for equal by 128 bits.

Defined cases: null or empty text has no words and an empty kept text; texts of fewer
words than a window lose nothing; a null doc_id counts as larger than all others; rows
with equal ids don't remove words from each other; repeats inside one document stay;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed as P
from .common import U64, map_arrow, mix, ngram_hashes, span_hashes, text_bytes, text_of_item, window_ok, word_spans, write_scratch

OUT = ["doc_id", "n_words", "n_removed", "kept"]
SECOND = U64(0xA24BAED4963EE407)  # makes the second word hashes


class Chunk:
    """Words of a chunk's documents and the two passes' keys."""

    def __init__(self, body: bytes):
        self.table = P.read_body(body)
        self.ids = np.asarray(self.table.column(0).fill_null(P.NULL_ID))
        data, off = text_bytes(self.table.column(1))
        s, e, self.woff = word_spans(data, off)
        self.h = span_hashes(data, s, e)
        self.doc = text_of_item(self.woff)

    def block_keys(self, block: int, buckets: int):
        """Starts of all rolling windows, the sorted distinct keys, each window's key, whether it is a block."""
        at = np.flatnonzero(window_ok(self.woff, block))
        keys, inv = np.unique(P.short_keys(ngram_hashes(self.h, block)[at], buckets), return_inverse=True)
        return at, keys, inv, (at - self.woff[self.doc[at]]) % block == 0

    def candidates(self, block: int, window: int, buckets: int, replies) -> np.ndarray:
        """Starts of the full windows around hits."""
        at, keys, inv, is_block = self.block_keys(block, buckets)
        known = P.bits_of(replies, P.edges(keys >> U64(32), buckets), 2)
        d = self.doc[at]

        def other(of: np.ndarray) -> np.ndarray:
            """For each window: does its key stand in another document of this chunk, among ``of``?"""
            low, high = np.full(len(keys), len(self.ids)), np.full(len(keys), -1)
            low[inv[of][::-1]] = d[of][::-1]  # the first document is written last
            high[inv[of]] = d[of]
            return (low[inv] < len(self.ids)) & ((low[inv] != d) | (high[inv] != d))

        everywhere = np.arange(len(at))
        hit = known[0][inv] | other(np.flatnonzero(is_block)) | (is_block & (known[1][inv] | other(everywhere)))
        total = np.zeros(len(self.h) + 1, np.int64)
        total[at[hit] + 1] = 1
        np.cumsum(total, out=total)
        w = np.flatnonzero(window_ok(self.woff, window))
        return w[total[w + window - block + 1] > total[w]]

    def window_keys(self, starts: np.ndarray, window: int):
        """Distinct full windows in order (keys by bucket, second hashes), each start's window, each window's smallest document."""
        none = np.zeros(0, U64)
        g = ngram_hashes(self.h, window)[starts] if len(starts) else none
        second = ngram_hashes(mix(self.h ^ SECOND), window)[starts] if len(starts) else none
        ids = self.ids[self.doc[starts]]
        inv, at = P.numbered(_swap(g), second)  # low half first: sorted by bucket
        low = np.full(len(at), P.NULL_ID)
        np.minimum.at(low, inv, ids)
        return _swap(g)[at], second[at], inv, low, ids


def _swap(k: np.ndarray) -> np.ndarray:
    return (k << U64(32)) | (k >> U64(32))


def answer_blocks(keys, extra):
    """For each key: whether it is a block of another chunk; whether it is a block that another chunk holds anywhere."""
    lists = [P.unpack(k, 16) for k in keys]

    def judge(k, flag):
        inv, n = P.key_groups(k)
        probes, blocks = np.bincount(inv, minlength=n), np.bincount(inv[flag], minlength=n)
        return np.stack([blocks[inv] - flag > 0, flag & (probes[inv] > 1)])

    flags = [np.unpackbits(np.frombuffer(x, np.uint8))[:len(k)].astype(bool) for x, k in zip(extra, lists)]
    return [np.packbits(hits).tobytes() + np.packbits(hit).tobytes() for hits, hit in P.by_parts(judge, lists, flags)]


def answer_windows(keys, extra):
    """Whether a document with a smaller id, in another chunk, holds the window."""
    lists = [P.unpack(k, 48) for k in keys]

    def judge(k, second, ids):
        inv, distinct = P.numbered(k, second)
        low = np.full(len(distinct), P.NULL_ID)
        np.minimum.at(low, inv, ids)
        return low[inv] < ids

    second = [np.frombuffer(x, U64, len(k)) for x, k in zip(extra, lists)]
    ids = [P._unzip(memoryview(x)[8 * len(k):], len(k), np.int64) for x, k in zip(extra, lists)]
    return [np.packbits(earlier).tobytes() for earlier in P.by_parts(judge, lists, second, ids)]


def ask_blocks(chunks: DataFrame, block: int, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for cid, body in zip(b.column(0).to_pylist(), b.column(1)):
                c = Chunk(body.as_py())
                _, keys, inv, is_block = c.block_keys(block, buckets)
                flag = np.zeros(len(keys), bool)
                flag[inv[is_block]] = True
                at = P.edges(keys >> U64(32), buckets)
                yield P.packed_rows(cid, [(i, P.pack(keys[a:z] & U64(0xFFFFFFFF), 16), np.packbits(flag[a:z]).tobytes())
                                          for i, (a, z) in enumerate(itertools.pairwise(at)) if z > a])

    return P.ask(map_arrow(chunks.select("chunk_id", "body"), run, P.PACKED), answer_blocks)


def ask_windows(found: DataFrame, block: int, window: int, buckets: int, ranges: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for cid, body, replies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                c = Chunk(body.as_py())
                keys, second, _, low, _ = c.window_keys(c.candidates(block, window, buckets, replies), window)
                at = P.edges(P.route(_swap(keys), ranges), ranges)
                yield P.packed_rows(cid, [(i, P.pack(keys[a:z], 48), second[a:z].tobytes() + P._zip(low[a:z])) for i, (a, z) in enumerate(itertools.pairwise(at)) if z > a])

    return P.ask(map_arrow(found, run, P.PACKED), answer_windows)


def remove_repeats(docs: DataFrame, window: int = 13, chunk_bytes: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256, *carry): every text without the words of
    ``window``-word strings that a document with a smaller id also holds.  ``kept`` is the
    text as it was if nothing goes, else the words left, joined by spaces."""
    block = (window + 1) // 2
    chunks = P.write_chunks(docs, "chunks", chunk_bytes, carry=carry)
    buckets = P.bucket_count(chunks, 1 / 6)
    blocks = write_scratch(ask_blocks(chunks, block, buckets), "block-hits")
    found = P.replies_by(chunks, blocks=blocks)
    ranges = buckets
    windows = ask_windows(found, block, window, buckets, ranges)

    def run(batches):
        for b in batches:
            for body, r1, r2 in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                c = Chunk(body.as_py())
                starts = c.candidates(block, window, buckets, r1)
                keys, _, inv, low, ids = c.window_keys(starts, window)
                earlier = P.bits_of(r2, P.edges(P.route(_swap(keys), ranges), ranges), 1)[0]
                gone = starts[earlier[inv] | (low[inv] < ids)]
                mark = np.zeros(len(c.h) + 1, np.int64)
                np.add.at(mark, gone, 1)
                np.subtract.at(mark, gone + window, 1)
                keep = np.cumsum(mark[:-1]) == 0
                removed = np.concatenate([[0], np.cumsum(~keep)])
                removed = removed[c.woff[1:]] - removed[c.woff[:-1]]
                kept, sha = [], []
                for i, t in enumerate(c.table.column(1).to_pylist()):
                    words = t.encode().split() if t else []
                    if removed[i]:
                        words = list(itertools.compress(words, keep[c.woff[i]:c.woff[i + 1]].tolist()))
                    left = b" ".join(words)
                    sha.append(hashlib.sha256(left).hexdigest())
                    kept.append(left if removed[i] else t.encode() if t else b"")
                yield pa.RecordBatch.from_arrays(
                    [c.table.column(0).combine_chunks(), pa.array(np.diff(c.woff), pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string()),
                     *[c.table.column(x).combine_chunks() for x in carry]],
                    names=[*OUT, "kept_sha256", *carry])

    return map_arrow(P.replies_by(chunks, blocks=blocks, windows=windows), run,
                     ", ".join(["doc_id long, n_words long, n_removed long, kept string, kept_sha256 string",
                                *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]]))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i
      FROM (SELECT doc_id, list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) AS s FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN m USING (s) WHERE m.first < doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept
      FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d) ANTI JOIN c USING (doc_id, j) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
