"""Hard negatives by exact integer scores from a residue-number-system matrix product.

Vectors become integers, floor(scale * x).  Rows are packed into tiles of ``tile_rows``, anchors
into blocks of ``block_rows``, both as matrices.  Every block meets every tile in some task: blocks are
repeated for each group of tiles, tiles for each block (the anchors are the query set), and
one shuffle on (block, group) brings them together.  So no task holds more than a block and
a few tiles, whatever labels, ids or copies are in them.

A task multiplies block and tile modulo several primes below 1024: centred residues are at most
511, 64 products of them add up to less than 2^24, so float32 BLAS gives each partial sum exactly; the
sums are reduced modulo the prime and the signed score is put together by mixed-radix Chinese
remaindering.  As many primes are taken as the tile and block need: the product of their largest
norms bounds every score (Cauchy-Schwarz).

Two passes: the first keeps each anchor's best rows of its own label in every group of tiles, and a
window picks the positives; the second keeps, for each anchor and positive, the best rows of other
labels whose score lies in the positive's range, and a window ranks them.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part;
neither do rows whose integer vector is as long as 2^31 or more, so that every score between rows
that do fits a long; vectors meet those of their own length only, empty vectors score 0; a row of the
anchor's own id is not its positive; repeated rows count as rows each; a null id comes after all
others of its score; an anchor without positives or negatives gives no rows; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import first_of, map_arrow, ship, write_scratch

DEPTH = 64  # products added up in float32: DEPTH * 511^2 < 2^24
LONGEST = float(1 << 31)
NO_ID = np.iinfo(np.int64).max
SUB = 256  # anchors scored at a time


@cache
def primes(n: int) -> tuple[int, ...]:
    """The n largest primes below 1024, largest first."""
    out, x = [], 1023
    while len(out) < n:
        if all(x % d for d in range(3, math.isqrt(x) + 1, 2)):
            out.append(x)
        x -= 2
    return tuple(out)


def primes_for(bound: int) -> tuple[int, ...]:
    """Primes whose product is above twice the bound, so that they name every score within it."""
    n = 1
    while math.prod(primes(n)) <= 2 * bound + 1:
        n += 1
    return primes(n)


def centred(a: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p-1)/2 to (p-1)/2 as float32."""
    r = np.remainder(a, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def modular_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, by float32 products of at most DEPTH columns."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], DEPTH):
        out += (centred(a[:, k:k + DEPTH], p) @ centred(b[:, k:k + DEPTH], p).T).astype(np.int64)
    return np.remainder(out, p)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows of a and b as int64; norms below 2^31."""
    norm = lambda x: float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)))
    moduli = primes_for(int(1.001 * norm(a) * norm(b)) + 1)
    out, radix = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli:
        # The next mixed-radix digit makes the number right modulo p as well; digits are centred,
        # so what is built is the signed score.
        digit = np.remainder((modular_product(a, b, p) - np.remainder(out, p)) * pow(radix, -1, p), p)
        digit -= p * (digit > p // 2)
        out += digit * radix
        radix *= p
    return out


# --- tiles and blocks ---------------------------------------------------------------

TILE = "tile long, n int, d int, ids binary, labels binary, matrix binary"


def pack_rows(rows: DataFrame, scale: float, tile_rows: int) -> DataFrame:
    """(tile, n, d, ids, labels, matrix): rows (id, label, vector) packed as integer matrices of one width."""
    def run(batches):
        part, made, held = TaskContext.get().partitionId(), 0, {}

        def tile(d):
            nonlocal made
            ids, labels, matrix = (np.concatenate(x) for x in zip(*held.pop(d)))
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([d], pa.int32()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())],
                names=["tile", "n", "d", "ids", "labels", "matrix"])

        for b in batches:
            vectors = b.column(2)
            widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            first = np.cumsum(widths) - widths
            ids = pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            labels = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for d in np.unique(widths).tolist():
                at = np.flatnonzero(widths == d)
                matrix = np.floor(x[first[at][:, None] + np.arange(d)] * scale)
                with np.errstate(invalid="ignore", over="ignore"):
                    ok = np.sqrt((matrix ** 2).sum(1)) < LONGEST  # false for NaN too
                at, matrix = at[ok], matrix[ok].astype(np.int32)
                for k in range(0, len(at), tile_rows):
                    part_at = at[k:k + tile_rows]
                    held.setdefault(d, []).append((ids[part_at], labels[part_at], matrix[k:k + tile_rows]))
                    if sum(len(i) for i, *_ in held[d]) >= tile_rows:
                        yield tile(d)
        for d in list(held):
            yield tile(d)

    return map_arrow(rows, run, TILE)


def unpack_tile(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix) of a tile or block."""
    n, d = r["n"], r["d"]
    return (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64),
            np.frombuffer(r["matrix"], np.int32).reshape(n, d))


def on_grid(tiles: DataFrame, blocks: DataFrame, n_blocks: int, groups: int, run, schema: str) -> DataFrame:
    """``run(blocks, tiles)`` once for each block and group of tiles; both are lists of rows."""
    t = (tiles.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
         .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    a = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ship(tiles.sparkSession)

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist(), right.to_pylist())

    return a.groupBy("part", "group").cogroup(t.groupBy("part", "group")).applyInArrow(task, schema)


# --- the two passes ----------------------------------------------------------------------

NEAR = "anchor long, anchor_id long, ident long, score long"
HARD = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, ident long, score long"


def same_label(k: int):
    """First pass: each anchor's k best rows of its label."""
    def run(blocks: list[dict], tiles: list[dict]) -> pa.Table:
        found = []
        for a in blocks:
            a_ids, a_labels, a_matrix = unpack_tile(a)
            for t in tiles:
                if t["d"] != a["d"]:
                    continue
                ids, labels, matrix = unpack_tile(t)
                for s in range(0, len(a_ids), SUB):
                    mine = slice(s, s + SUB)
                    score = exact_scores(a_matrix[mine], matrix)
                    i, j = np.nonzero((a_labels[mine][:, None] == labels) & (a_ids[mine][:, None] != ids))
                    score = score[i, j]
                    best = first_of(i, score, ids[j], k)
                    found.append(np.stack([a["tile"] * 2**12 + s + i[best], a_ids[s + i[best]], ids[j[best]], score[best]]))
        x = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
        x = x[:, first_of(x[0], x[3], x[2], k)]
        return pa.table({"anchor": x[0], "anchor_id": x[1], "ident": x[2], "score": x[3]})
    return run


def other_labels(k: int, low: int, high: int):
    """Second pass: for each anchor and positive, the k best rows of other labels with
    low * positive <= 100 * score <= high * positive."""
    def run(blocks: list[dict], tiles: list[dict]) -> pa.Table:
        found = []
        for a in blocks:
            a_ids, a_labels, a_matrix = unpack_tile(a)
            goals = a["goals"]
            pos = np.array([g["at"] for g in goals], np.int64)
            slot = np.array([g["slot"] for g in goals], np.int64)
            positive = np.array([g["ident"] for g in goals], np.int64)
            goal = [int(g["score"]) for g in goals]
            least = np.array([-(-low * g // 100) for g in goal], np.int64)
            most = np.array([high * g // 100 for g in goal], np.int64)
            goal = np.array(goal, np.int64)
            for t in tiles:
                if t["d"] != a["d"]:
                    continue
                ids, labels, matrix = unpack_tile(t)
                for s in range(0, len(a_ids), SUB):
                    here = np.flatnonzero((pos >= s) & (pos < s + SUB))
                    score = exact_scores(a_matrix[s:s + SUB], matrix)
                    other = a_labels[s:s + SUB][:, None] != labels
                    for q in np.unique(slot[here]).tolist():
                        g = here[slot[here] == q]
                        row = pos[g] - s
                        x = score[row]
                        i, j = np.nonzero(other[row] & (x >= least[g][:, None]) & (x <= most[g][:, None]))
                        x = x[i, j]
                        best = first_of(i, x, ids[j], k)
                        h = g[i[best]]
                        found.append(np.stack([a["tile"] * 2**12 + pos[h], a_ids[pos[h]], slot[h], positive[h], goal[h], ids[j[best]], x[best]]))
        x = np.concatenate(found, 1) if found else np.zeros((7, 0), np.int64)
        x = x[:, first_of(x[0] * 2**8 + x[2], x[6], x[5], k)]
        return pa.table({"anchor": x[0], "anchor_id": x[1], "slot": pa.array(x[2], pa.int32()), "positive_id": x[3],
                         "positive_score": x[4], "ident": x[5], "score": x[6]})
    return run


def ranked(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The first k rows of each group by score downwards, then id, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ident")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine_hard_negatives(rows: DataFrame, ident: str, vector: str, label: Column, anchors: Column, scale: float = 256.0,
                        positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                        tile_rows: int = 4096, block_rows: int = 1024, group_tiles: int = 2) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every row where
    ``anchors`` holds.  Negatives score from ``low`` to ``high`` percent of their positive."""
    if positives > 255 or block_rows > 4096:
        raise ValueError("at most 255 positives and blocks of 4096 rows")
    data = (rows.select(F.col(f"`{ident}`").cast("long").alias("id"), label.cast("long").alias("label"),
                        F.col(f"`{vector}`").alias("vector"), anchors.alias("is_anchor"))
            .where(F.col("label").isNotNull() & F.col("vector").isNotNull()))
    tiles = write_scratch(pack_rows(data.select("id", "label", "vector"), scale, tile_rows), "tiles")
    chosen = data.where("is_anchor").select("id", "label", "vector")
    n = chosen.count()
    n_blocks = max(1, -(-n // block_rows))
    # Dealt evenly, a partition is one block or little more; its rows go under one number.
    blocks = pack_rows(chosen.repartition(n_blocks), scale, block_rows)
    blocks = write_scratch(blocks.withColumn("part", F.shiftright("tile", 32).cast("int")), "blocks")
    groups = max(1, tiles.count() // group_tiles)
    near = on_grid(tiles, blocks, n_blocks, groups, same_label(positives), NEAR)
    near = write_scratch(ranked(near, ["anchor"], positives, "slot"), "positives")
    goals = near.select(F.shiftright("anchor", 12).alias("of"), F.struct(
        (F.col("anchor") % 4096).alias("at"), "slot", "ident", "score").alias("goal"))
    goals = goals.groupBy("of").agg(F.collect_list("goal").alias("goals"))  # at most block_rows * positives
    aimed = blocks.join(goals, F.col("tile") == F.col("of")).drop("of")
    hard = on_grid(tiles, aimed, n_blocks, groups, other_labels(negatives, low, high), HARD)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return ranked(hard, ["anchor", "slot"], negatives, "rank").select(
        known("anchor_id").alias("anchor_id"), known("positive_id").alias("positive_id"), "rank",
        known("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
             CASE WHEN len(a.q) = 0 THEN 0 ELSE list_dot_product(a.q, b.q) END::BIGINT AS score
      FROM v a JOIN v b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id IS DISTINCT FROM anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
