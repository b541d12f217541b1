"""Benchmark decontamination by spaced-seed hashing.

A seed looks at ``len(mask)`` consecutive words and hashes those where a fixed mask has
a 1, so words at the 0s may differ.  Seeds of the benchmark and of the documents are joined by
hash; each hit's surroundings are compared word by word.  Every stretch around a seed counts that
has ``min_equal`` equal words or more, at least ``min_share`` of its length, whatever stands beside it.

Document seeds first pass a bit filter of the benchmark's seeds: 2**FILTER_BITS bits
whatever the benchmark's size (8 MB; a fuller filter only lets more rows through to the join,
which decides).  Documents with a seed that passes are written once as chunks of ``CHUNK``
words.  A hit only names a diagonal of a document and an item: the whole item is laid along
it word by word, all overlaps on it are found, and those that touch are one.

Items shorter than the masks have one seed, all their words, and match where these stand
in a row, whatever ``min_equal``.

Defined cases: null text has no words; items without words match nothing; each row of a
document or an item is reported by itself, whatever its id (repeated or null); empty tables
give no rows; extra columns are ignored; texts are read whole; a text that repeats itself (one
word over and over) overlaps an item on many diagonals and gives a row for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checked_columns, lower_ascii, map_arrow, mix, slices, span_hashes, text_bytes, text_of_item, window_ok, word_spans, write_scratch

# Fixed masks: 12 words, of which 8 count.
MASKS = ("111010010111", "110111010011", "101101111001")
FILTER_BITS = 26
CHUNK = 1024  # words of a document in one row

PARTS = np.ones(256, bool)  # words are ASCII letters (lower case), digits and all beyond ASCII
PARTS[48:58], PARTS[97:123], PARTS[128:] = False, False, False


def seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    k = len(h) - len(mask) + 1
    if k <= 0:
        return np.zeros(0, U64)
    x = np.full(k, salt + 1, U64)
    for j, bit in enumerate(mask):
        if bit == "1":
            x = (x ^ h[j:j + k]) * U64(0x9FB21C651E98DF25)
            x ^= x >> U64(32)
    return mix(x)


def filter_slots(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = U64((1 << FILTER_BITS) - 1)
    return (seeds & low).astype(np.int64), ((seeds >> U64(FILTER_BITS)) & low).astype(np.int64)


def seed_rows(frame: DataFrame, masks: tuple[str, ...], chunk: int | None = None, short: tuple[int, ...] = (), bits=None) -> DataFrame:
    """(row, id, n, chunk, words, seeds, ats) of texts with a seed: ``row`` numbers the texts, ``n``
    is the text's length, ``words`` the chunk's words as 4-byte hashes.

    With ``bits`` seeds must pass the filter and texts also have seeds of the ``short`` lengths;
    without, a text shorter than the masks has one seed of all its words."""
    span = len(masks[0])

    def run(batches):
        table = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            data, off = text_bytes(b.column(1))
            data = lower_ascii(data)
            s, e, woff = word_spans(data, off, PARTS)
            h = span_hashes(data, s, e)
            d, size = text_of_item(woff), np.diff(woff)
            words = (h >> U64(32)).astype(np.uint32)
            found = []
            for salt, mask in [*enumerate(masks), *((len(masks) + k, "1" * k) for k in (range(1, span) if table is None else short))]:
                x, keep = seed_hashes(h, mask, salt), window_ok(woff, len(mask))
                if table is None and len(mask) < span:
                    keep = keep & (size[d[:len(keep)]] == len(mask))
                if table is not None:
                    for slot in filter_slots(x):
                        keep = keep & ((table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1)
                at = np.flatnonzero(keep)
                found.append((x[at], at))
            x, at = (np.concatenate(v) for v in zip(*found))
            order = np.argsort(at, kind="stable")
            x, at = x[order], at[order]
            cuts = [(t, c, a) for t in np.unique(d[at]).tolist() for c, a in enumerate(range(int(woff[t]), int(woff[t + 1]), chunk or int(size[t])))]
            if cuts:
                t, c, a = (np.array(v) for v in zip(*cuts))
                z = np.minimum(a + (chunk or len(h)), woff[t + 1])
                edges = pa.array(np.append(np.searchsorted(at, a), len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + t), b.column(0).take(pa.array(t)), pa.array(size[t]), pa.array(c),
                     pa.array([words[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist())], pa.binary()),
                     pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int64))), pa.ListArray.from_arrays(edges, pa.array(at - woff[d[at]]))],
                    names=["row", "id", "n", "chunk", "words", "seeds", "ats"])
            row += b.num_rows

    kind = frame.schema[0].dataType.simpleString()
    return map_arrow(frame, run, f"row long, id {kind}, n long, chunk long, words binary, seeds array<long>, ats array<long>")


def filter_bits(seeds: DataFrame) -> bytes:
    """Bit filter of all seeds; Spark ORs the bits, at most 2**(FILTER_BITS - 6) words reach the driver."""
    low = F.lit((1 << FILTER_BITS) - 1)
    slots = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(low), F.shiftrightunsigned("seed", FILTER_BITS).bitwiseAND(low))).alias("s"))
    words = (slots.groupBy(F.shiftright("s", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toPandas())
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.tobytes()


def overlaps(eq: np.ndarray, masks: tuple[str, ...], min_equal: int, min_share: float) -> list[tuple[int, int, int]]:
    """(start, end, equal words) of the overlaps on one diagonal, from its marks of equal words.

    An overlap is a stretch that holds a seed, ``min_equal`` equal words and ``min_share`` of its length of
    them.  With equal words worth 1 - min_share and others -min_share, the last says that its sum is not
    negative.  For each end only the first start of no larger sum matters, starts are strict lowest
    sums so far and ends strict highest ones from there on: each stretch that passes lies in one of these.  They
    are cut to their outer equal words, and those that touch are one."""
    span = len(masks[0])
    k = len(eq) - span + 1
    if k <= 0:
        return []
    hit = np.zeros(k, bool)
    for mask in masks:
        hit |= np.all([eq[j:j + k] for j, bit in enumerate(mask) if bit == "1"], axis=0)
    share = round(1000 * min_share)
    total = np.concatenate([[0], np.cumsum(np.where(eq, 1000 - share, -share))])
    equal = np.concatenate([[0], np.cumsum(eq)])
    hits = np.concatenate([[0], np.cumsum(hit)])
    low = np.flatnonzero(np.concatenate([[True], total[1:] < np.minimum.accumulate(total)[:-1]]))
    high = np.flatnonzero(np.concatenate([total[:-1] > np.maximum.accumulate(total[::-1])[::-1][1:], [True]]))
    at = np.searchsorted(-total[low], -total[high], "left")
    high, at = high[at < len(low)], at[at < len(low)]
    start, end = low[at], high
    ok = (end - start >= span) & (equal[end] - equal[start] >= min_equal)
    start, end = start[ok], end[ok]
    seeded = hits[end - span + 1] > hits[start]
    start, end = start[seeded], end[seeded]
    place = np.flatnonzero(eq)
    out: list[list[int]] = []
    for a, z in sorted(set(zip(place[equal[start]].tolist(), (place[equal[end] - 1] + 1).tolist()))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z, int(equal[z] - equal[a])) for a, z in out]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_equal: int = 12,
                  min_share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, first_word, end_word, n_equal, item_first): overlaps of documents with items."""
    span = len(masks[0])
    items = write_scratch(seed_rows(checked_columns(benchmark, ["item_id", "text"]), masks), "decontaminate-items")
    t = items.select(F.col("row").alias("item"), F.col("n").alias("item_n"), F.explode(F.arrays_zip("seeds", "ats")).alias("s"))
    t = t.select("item", "item_n", F.col("s.seeds").alias("seed"), F.col("s.ats").alias("item_at"))
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(t))  # 8 MB, whatever the data
    short = tuple(r.n for r in items.where(F.col("n") < span).select("n").distinct().collect())  # at most span - 1
    texts = write_scratch(seed_rows(checked_columns(docs, ["doc_id", "text"]), masks, CHUNK, short, bits), "decontaminate-docs")
    seeds = texts.select("row", F.explode(F.arrays_zip("seeds", "ats")).alias("s"))
    lines = (seeds.join(t, F.col("s.seeds") == F.col("seed"))
             .select("row", "item", "item_n", (F.col("s.ats") - F.col("item_at")).alias("diagonal")).distinct())
    # The document's chunks beside the whole item.
    first = F.greatest(F.col("diagonal"), F.lit(0).cast("long"))
    lines = lines.withColumn("at_chunk", F.explode(F.sequence(F.floor(first / CHUNK), F.floor((F.col("diagonal") + F.col("item_n") - 1) / CHUNK))))
    x = texts.select(F.col("row").alias("x_row"), F.col("id").alias("doc_id"), "chunk", "words")
    y = items.select(F.col("row").alias("y_item"), F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    beside = (lines.join(x, (F.col("row") == F.col("x_row")) & (F.col("at_chunk") == F.col("chunk")))
              .join(y, F.col("item") == F.col("y_item"))
              .select("row", "item", "diagonal", "doc_id", "item_id", "chunk", "words", "item_words"))

    def compare(batches):
        for b in batches:
            cols = (b.column(n).to_pylist() for n in ("diagonal", "chunk", "words", "item_words"))
            marks = []
            for diagonal, c, x, y in zip(*cols):
                x, y, at = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), c * CHUNK - diagonal
                i, j = max(at, 0), min(at + len(x), len(y))  # the item's words beside this chunk
                marks.append((x[i - at:j - at] == y[i:j]).tobytes() if i < j else b"")
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "item", "diagonal", "doc_id", "item_id", "chunk")),
                                              pa.array([len(y) // 4 for y in b.column("item_words").to_pylist()], pa.int64()), pa.array(marks, pa.binary())],
                                             names=["row", "item", "diagonal", "doc_id", "item_id", "chunk", "item_n", "marks"])

    kinds = {c: beside.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    ids = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}"
    marks = map_arrow(beside, compare, f"row long, item long, diagonal long, {ids}, chunk long, item_n long, marks binary")
    marks = (marks.groupBy("row", "item", "diagonal", "item_n", "doc_id", "item_id")
             .agg(F.sort_array(F.collect_list(F.struct("chunk", "marks"))).alias("parts"))
             .select("doc_id", "item_id", "item_n", "diagonal", F.col("parts.marks").alias("parts")))

    def run(batches):
        for b in batches:
            rows = []
            for k, (n, diagonal, parts) in enumerate(zip(*(b.column(c).to_pylist() for c in ("item_n", "diagonal", "parts")))):
                eq, at = np.frombuffer(b"".join(parts), bool), max(-diagonal, 0)
                if n < span:
                    found = [(0, n, n)] if len(eq) == n and eq.all() else []
                else:
                    found = overlaps(eq, masks, min_equal, min_share)
                rows += [(k, at + diagonal + a, at + diagonal + z, equal, at + a) for a, z, equal in found]
            k = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(k), b.column("item_id").take(k), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)]],
                                             names=["doc_id", "item_id", "first_word", "end_word", "n_equal", "item_first"])

    return map_arrow(marks, run, f"{ids}, first_word long, end_word long, n_equal long, item_first long")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Overlaps of whole documents with all benchmark items, one row each."""
    from .common import read_table
    return find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
