"""Hierarchical packing of documents into sequences of several context sizes.

A document is its token ids and the end id.  Whole windows of the longest context are cut off
first and make sequences of their own.  The rest, shorter than a window, is routed to the smallest tier
(context size, a power of two) that holds it.  Tiers are packed from the longest down: a
window opens with the longest waiting rest of its tier, its gap is filled from the shorter
tiers, longest fitting rest first, and what then remains is filled by a piece cut from the
shortest rest that is longer.  So every window is full, but for the last one of a cell, which is laid
out as sequences of powers of two (the binary digits of its length): no token is padding.

Rests are dealt into cells of about ``cell_tokens`` by a hash of their row, so that a cell is one
bounded task whatever the input's size or the copies in it, and full windows go along as
checksums only.  Step groups hold sequences of one context and about ``step_tokens`` tokens: inside a cell
and a context, sequences are dealt in turns, back and forth, in order of their attention cost (the
sum of squared piece lengths), so groups agree in length to one sequence and nearly in cost.

Spark: texts are encoded once in Arrow tasks and written (row key, checksums of full windows,
ids of the rest); one shuffle of the rests by cell; pieces come out of the cells' tasks.

Defined cases: null or empty text is the end id alone; rows repeat as they are, each packed by itself,
whatever its id; a null id stays null; a text of any length gives one row and at most one rest;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_columns, map_arrow, ship, slices, text_bytes, write_scratch
from .encode import encoder

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
END_ID = 1
CELL_TOKENS = 1 << 21
STEP_TOKENS = 1 << 17


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False))


def encode_documents(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """(row, doc_id, doc_tokens, full, rest): ids of each text and the end id; ``full`` holds the
    checksums of its whole windows, ``rest`` the ids after them."""
    rows = checked_columns(docs, ["doc_id", "text"])

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            data, off = text_bytes(b.column(1))
            ids, at = encoder(vocabulary)(data, off)
            total, full, rest = [], [], []
            for i in range(b.num_rows):
                x = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id))
                n = len(x) // window
                total.append(len(x))
                full.append(np.array([checksum(x[w * window:(w + 1) * window]) for w in range(n)], "<u4").tobytes())
                rest.append(x[n * window:].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array((part << 40) + k + np.arange(b.num_rows)), b.column(0), pa.array(total, pa.int64()),
                 pa.array(full, pa.binary()), pa.array(rest, pa.binary())],
                names=["row", "doc_id", "doc_tokens", "full", "rest"])
            k += b.num_rows

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"row long, doc_id {kind}, doc_tokens long, full binary, rest binary")


class Waiting:
    """Rests that wait for a window, by length; lengths in use are the bits of one number."""

    def __init__(self, lengths: list[int]):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        self.used = 0
        for i, n in enumerate(lengths):
            if n:
                self.put(n, i, 0)

    def put(self, n: int, doc: int, start: int):
        self.by_length.setdefault(n, []).append((doc, start))
        self.used |= 1 << n

    def longest(self, most: int) -> int:
        """The longest waiting length up to ``most``; 0 if there is none."""
        return max((self.used & ((2 << most) - 1)).bit_length() - 1, 0)

    def shortest_above(self, n: int) -> int:
        above = self.used >> (n + 1)
        return n + (above & -above).bit_length() if above else 0

    def take(self, n: int) -> tuple[int, int]:
        held = self.by_length[n]
        out = held.pop()
        if not held:
            self.used &= ~(1 << n)
        return out


def pack_tiers(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Rests of the given lengths -> sequences (context, pieces), pieces as (rest, start, length).

    Every sequence is full; contexts below the smallest tier occur in the last window's parts only."""
    waiting, out = Waiting(lengths), []
    for k, size in enumerate(tiers):
        below = tiers[k + 1] if k + 1 < len(tiers) else 0
        while (n := waiting.longest(size)) > below:
            pieces, gap = [], size
            while gap:
                n = waiting.longest(gap)
                if n:
                    pieces.append((*waiting.take(n), n))
                elif n := waiting.shortest_above(gap):  # cut
                    doc, start = waiting.take(n)
                    pieces.append((doc, start, gap))
                    waiting.put(n - gap, doc, start + gap)
                    n = gap
                else:
                    break
                gap -= n
            if gap:
                out += binary_parts(pieces, size - gap)
            else:
                out.append((size, pieces))
    return out


def binary_parts(pieces: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Pieces of ``total`` tokens laid out as full sequences of the powers of two in ``total``."""
    out, pieces = [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        size = 1 << bit
        if not total & size:
            continue
        part, gap = [], size
        while gap:
            doc, start, n = pieces.pop()
            part.append((doc, start, min(n, gap)))
            if n > gap:
                pieces.append((doc, start + gap, n - gap))
            gap -= min(n, gap)
        out.append((size, part))
    return out


def step_groups(context: np.ndarray, cost: np.ndarray, step_tokens: int) -> np.ndarray:
    """A group number for each sequence: one context a group, sequences dealt back and forth by cost."""
    out, base = np.zeros(len(context), np.int64), 0
    for size in np.unique(context)[::-1]:
        at = np.flatnonzero(context == size)
        groups = -(-len(at) * int(size) // step_tokens)
        at = at[np.argsort(-cost[at], kind="stable")]
        turn, place = np.divmod(np.arange(len(at)), groups)
        out[at] = base + np.where(turn % 2 == 0, place, groups - 1 - place)
        base += groups
    return out


def pack_cell(cell: int, rows: pa.Table, window: int, tiers: tuple[int, ...], step_tokens: int) -> pa.Table:
    """All pieces of the documents of one cell."""
    rows = rows.sort_by("row").combine_chunks()
    tokens = rows["doc_tokens"].to_numpy()
    rest = [np.frombuffer(x, "<u4") for x in rows["rest"].to_pylist()]
    full = [np.frombuffer(x, "<u4") for x in rows["full"].to_pylist()]
    windows = np.fromiter(map(len, full), np.int64, len(full))
    whole = int(windows.sum())
    sequences = pack_tiers([len(x) for x in rest], tiers)
    # Full windows first, each one piece; then the packed rests.
    doc = [np.repeat(np.arange(len(full)), windows)]
    start = [(np.arange(whole) - np.repeat(np.cumsum(windows) - windows, windows)) * window]
    pieces = [(d, s, n, q, c) for q, (c, held) in enumerate(sequences) for d, s, n in held]
    d, s, n, q, _ = np.array(pieces, np.int64).reshape(-1, 5).T
    crc = np.array([checksum(rest[a][b:b + c]) for a, b, c in zip(d.tolist(), s.tolist(), n.tolist())], np.int64)
    doc, start = np.concatenate([*doc, d]), np.concatenate([*start, windows[d] * window + s])
    length = np.concatenate([np.full(whole, window), n])
    sequence = np.concatenate([np.arange(whole), whole + q])
    context = np.concatenate([np.full(whole, window), np.array([c for c, _ in sequences], np.int64)])
    cost = np.bincount(sequence, length.astype(float) ** 2, len(context))
    ends = np.cumsum(length)
    first = np.concatenate([[0], np.flatnonzero(np.diff(sequence)) + 1]) if len(sequence) else np.zeros(0, np.int64)
    before = np.repeat((ends - length)[first], np.diff(np.append(first, len(sequence))))
    step = step_groups(context, cost, step_tokens)
    return pa.table({
        "doc_id": rows["doc_id"].take(pa.array(doc)), "start": start, "length": length,
        "ids_crc32": np.concatenate([*full, np.zeros(0, np.uint32)]).astype(np.int64).tolist() + crc.tolist(),
        "doc_tokens": tokens[doc], "sequence_id": (cell << 32) + sequence, "offset": ends - length - before,
        "context": context[sequence], "step_group": (cell << 32) + step[sequence]})


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID, window: int = WINDOW,
                   tiers: tuple[int, ...] = TIERS, cell_tokens: int = CELL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group).

    ``tiers``: falling powers of two, the first one ``window``.  A sequence's tokens number ``context``."""
    if tiers[0] != window or any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be falling powers of two from the window's length")
    encoded = write_scratch(encode_documents(docs, vocabulary, window, end_id), "encoded")
    # A rest weighs its ids, a row and a window's checksum something too, so that a cell is bounded in all.
    weight = F.octet_length("rest") / 4 + F.octet_length("full") / 4 + 16
    total = encoded.agg(F.sum(weight)).first()[0] or 0
    cells = max(1, -(-int(total) // cell_tokens))
    ship(docs.sparkSession)

    def run(key, rows):
        return pack_cell(key[0].as_py(), rows.drop_columns("cell"), window, tiers, step_tokens)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("long")).groupBy("cell").applyInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
             "context long, step_group long")


def op11_pack_sequences(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return pack_documents(read_table(spark, sf_dir, "documents"))
