"""Ranked lexical search by dense blocked matrix products of exact integers in float64.

Items (the queries) are taken in blocks of at most ``block_items`` rows and ``block_bytes`` of text (one item
at least).  A block's distinct terms are its vocabulary; only these are looked up in documents, so
what is broadcast is bounded by the block, and more items make more passes, not larger ones.

A pass has two jobs.  The first reads all documents in Arrow tasks, counts every term and writes tiles
of (document, vocabulary term, count) in compressed rows, together with each task's document
frequencies.  The second multiplies, in every task, the item tile (items x terms, term weights) with
dense document tiles (terms x documents, impacts).  Weight times impact is below
max(weight) * 10^6; terms are cut into tiles so that no sum of a product reaches 2^53, so float64 BLAS is
exact in any order, and the tiles' sums are added as int64.  Each task keeps the best rows of every
item, ties by id included; windows merge the tasks' lists in two steps, first within runs of tasks.

Defined cases: a null or empty document has no terms, counts nowhere and is never found; an item
without terms gives no rows; repeated documents are documents each, and all are listed; item rows
that are wholly equal count once, items of one id and different texts are ranked each by itself; null
ids come after all others of their score; an empty table on either side gives no rows; texts of any
length are read whole; extra columns are ignored.  ``doc_id`` is a number.  Terms are told apart by a 64-bit hash
of their bytes and length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_columns, first_of, lower_ascii, map_arrow, slices, span_hashes, text_bytes, text_of_item, word_spans, write_scratch

# Bytes that part terms: all ASCII but digits and letters.
MARK = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
EXACT = 1 << 53
IMPACT = 1_000_000  # no impact is larger: 10^9 tf div (1000 tf + 20 m) with m > 0
NO_ID = np.iinfo(np.int64).max
DOC_TILE, TERM_TILE = 512, 2048


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all texts and n+1 offsets."""
    data, off = text_bytes(texts)
    data = lower_ascii(data)
    s, e, at = word_spans(data, off, MARK)
    return span_hashes(data, s, e), at


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


# --- items ------------------------------------------------------------------------------------

def item_blocks(items: DataFrame, block_items: int, block_bytes: int) -> DataFrame:
    """(block, ids, texts): items in bounded blocks."""
    rows = checked_columns(items, ["item_id", "text"]).where("text is not null").distinct()
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = max(1, -(-n // block_items), -(-(size or 0) // block_bytes))

    def run(batches):
        part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([texts], pa.list_(pa.string()))],
                names=["block", "ids", "texts"])

        for b in batches:
            kind = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (len(ids) >= block_items or size + len(t) > block_bytes):
                    yield block()
                    made, ids, texts, size = made + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield block()

    kind = rows.schema["item_id"].dataType.simpleString()
    return write_scratch(map_arrow(rows.repartition(parts), run, f"block long, ids array<{kind}>, texts array<string>"), "items")


# --- first job: documents as counts of vocabulary terms -------------------------------------------

COUNTS = "n int, ids binary, sizes binary, ptr binary, terms binary, counts binary, df array<long>, n_docs long, n_terms long"


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """Tiles of documents that hold vocabulary terms, and a last row for each task with its document
    frequencies, documents with terms and terms.  ``vocabulary``: broadcast sorted hashes."""
    rows = checked_columns(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def row(n, arrays, df=None, n_docs=None, n_terms=None):
        return pa.RecordBatch.from_arrays(
            [pa.array([n], pa.int32()), *[pa.array([x if x is None else x.tobytes()], pa.binary()) for x in arrays], pa.array([df], pa.list_(pa.int64())),
             pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())],
            names=["n", "ids", "sizes", "ptr", "terms", "counts", "df", "n_docs", "n_terms"])

    def run(batches):
        words = vocabulary.value
        df, n_docs, n_terms = np.zeros(len(words), np.int64), 0, 0
        for b in slices(batches):
            h, at = term_hashes(b.column(1))
            sizes = np.diff(at)
            n_docs += int((sizes > 0).sum())
            n_terms += len(h)
            place = np.minimum(np.searchsorted(words, h), len(words) - 1)
            hit = np.flatnonzero(words[place] == h)
            pairs, counts = np.unique(text_of_item(at)[hit] * len(words) + place[hit], return_counts=True)
            doc, term = np.divmod(pairs, len(words))
            df += np.bincount(term, minlength=len(words))
            held, first = np.unique(doc, return_index=True)
            if len(held):
                ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                yield row(len(held), [ids[held].astype(np.int64), sizes[held], np.append(first, len(doc)), term.astype(np.int32), counts.astype(np.int64)])
        yield row(0, [None] * 5, df.tolist(), n_docs, n_terms)

    return map_arrow(rows, run, COUNTS)


# --- second job: scores ------------------------------------------------------------------------

def term_tiles(weight: np.ndarray, largest: int = TERM_TILE) -> list[slice]:
    """Runs of terms whose weights times the largest impact add up to less than 2^53."""
    most = max(1, min(largest, (EXACT - 1) // (IMPACT * max(1, int(weight.max(initial=1))))))
    return [slice(k, k + most) for k in range(0, len(weight), most)]


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 50 + (50 * size * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def tile_scores(items: np.ndarray, weight: np.ndarray, n: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """int64 scores (items x n documents) from the documents' sparse impacts; items hold their weights."""
    out = np.zeros((len(items), n), np.int64)
    for s in term_tiles(weight):
        here = (term >= s.start) & (term < s.stop)
        dense = np.zeros((len(weight[s]), n))
        dense[term[here] - s.start, doc[here]] = impact[here]
        out += (items[:, s] @ dense).astype(np.int64)
    return out


def score_tiles(counts: DataFrame, query, k: int) -> DataFrame:
    """Each task's best k documents of every item.  ``query``: broadcast (items x terms, weights, N, L)."""
    def run(batches):
        items, weight, n_docs, n_terms = query.value
        part = TaskContext.get().partitionId()
        item, ident, score = (np.zeros(0, np.int64) for _ in range(3))
        least = np.ones(len(items), np.int64)  # what a score must reach
        for b in batches:
            for r in b.to_pylist():
                ids, sizes, ptr = (np.frombuffer(r[c], np.int64) for c in ("ids", "sizes", "ptr"))
                term, tf = np.frombuffer(r["terms"], np.int32), np.frombuffer(r["counts"], np.int64)
                doc = np.repeat(np.arange(len(ids)), np.diff(ptr))
                impact = impacts(tf, sizes[doc], n_docs, n_terms)
                for s in range(0, len(ids), DOC_TILE):
                    e = min(s + DOC_TILE, len(ids))
                    a, z = ptr[s], ptr[e]
                    x = tile_scores(items, weight, e - s, doc[a:z] - s, term[a:z], impact[a:z])
                    i, j = np.nonzero(x >= least[:, None])
                    item, ident, score = (np.concatenate(p) for p in ((item, i), (ident, ids[s + j]), (score, x[i, j])))
                    if len(item) > 4 * k * len(items):
                        keep = first_of(item, score, ident, k)
                        item, ident, score = item[keep], ident[keep], score[keep]
                        full = np.bincount(item, minlength=len(items)) >= k
                        low = np.full(len(items), NO_ID)
                        np.minimum.at(low, item, score)
                        least = np.where(full, low, 1)
        keep = first_of(item, score, ident, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keep), part), pa.int32()), pa.array(item[keep], pa.int32()), pa.array(ident[keep]), pa.array(score[keep])],
            names=["part", "item", "ident", "score"])

    tiles = counts.where("n > 0").select("ids", "sizes", "ptr", "terms", "counts")
    return map_arrow(tiles, run, "part int, item int, ident long, score long")


def first_rows(found: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ident")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_items: int = 256, block_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, scores above 0."""
    spark = docs.sparkSession
    blocks = item_blocks(items, block_items, block_bytes)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for at in sorted(r[0] for r in blocks.select("block").collect()):
        block = blocks.where(F.col("block") == at).first()  # bounded
        h, off = term_hashes(pa.array(block["texts"]))
        words = np.unique(h)
        if not len(words):
            continue
        held = np.zeros((len(block["ids"]), len(words)), bool)
        held[text_of_item(off), np.searchsorted(words, h)] = True
        counts = write_scratch(count_terms(docs, spark.sparkContext.broadcast(words)), "term-counts")
        stats = counts.where("n = 0")
        n_docs, n_terms = stats.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_terms:
            continue
        df = np.zeros(len(words), np.int64)  # as many as the block's terms
        for t, n in stats.select(F.posexplode("df").alias("t", "n")).groupBy("t").agg(F.sum("n")).collect():
            df[t] = n
        w = weights(n_docs, df)
        query = spark.sparkContext.broadcast((held * w.astype(np.float64), w, n_docs, n_terms))
        found = score_tiles(counts, query, k)
        found = first_rows(found.withColumn("run", F.floor(F.col("part") / 64)), ["run", "item"], k).drop("rank", "run")
        names = F.array(*[F.lit(i).cast(kind) for i in block["ids"]])
        out = out.union(first_rows(found, ["item"], k).select(
            names[F.col("item")].alias("item_id"), "rank", F.when(F.col("ident") != NO_ID, F.col("ident")).alias("doc_id"), "score"))
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT sum(len(t))::BIGINT AS l, count(*)::BIGINT AS n FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT q, item_id, unnest(list_distinct(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
      FROM (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL))),
f AS (SELECT r, doc_id, size, term, count(*)::BIGINT AS tf
      FROM (SELECT r, doc_id, len(t)::BIGINT AS size, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f GROUP BY term),
i AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * (SELECT n FROM c)) // (SELECT l FROM c))) AS impact FROM f),
s AS (SELECT q, item_id, r, doc_id, sum(w * impact)::BIGINT AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL HAVING sum(w * impact) > 0)
SELECT item_id, (row_number() OVER x)::INTEGER AS rank, doc_id, score FROM s
WINDOW x AS (PARTITION BY q ORDER BY score DESC, doc_id) QUALIFY row_number() OVER x <= 50
"""
