"""Language ID by error-correcting output codes over binary n-gram classifiers.

Each language has a codeword of bits.  For each bit a binary classifier tells the
languages with a 1 from those with a 0 by hashed byte n-grams (smoothed log odds for
each n-gram, from counts that Spark adds up).  A text's margin on a bit is the mean
over its n-grams; decoding picks the codeword with the least weighted logistic loss,
where a bit weighs as much as it parted the languages in training.  Texts whose two best
codewords lie close are flagged ambiguous.

Counts come from a bounded sample of labelled rows (``sample_rows``, chosen by an md5
of the id, of the text where the id is null); the model has n_languages x 2**table_bits counts.  Predictions read only text.

Defined cases: null text, or one without a letter, gives ``und`` with score 0; null
labels do not train; no labels at all: every prediction is ``und``; one language:
it is predicted with score 1; rows repeat as they are; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_columns, map_arrow, lower_ascii, mix, slices, text_bytes, text_of_item

UND = "und"


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1: every two-way parting for few languages, else rows of a
    hash-made code of 15 log2(n) bits without repeated or constant columns."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, float).T
    bits = 15 * int(np.ceil(np.log2(n)))
    code = np.where((mix(np.arange(n * bits, dtype=np.uint64) + np.uint64(77)) >> np.uint64(63)).reshape(n, bits) > 0, 1.0, -1.0)
    code = code[:, np.abs(code.sum(0)) < n]
    return np.unique(code, axis=1)


def hashed_ngrams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Table slots of all byte n-grams (those over a text's end are the caller's)."""
    h = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for j in range(n):
        h = h * np.uint32(257) + data[j:j + len(h)]
    return (h * np.uint32(2654435761)) >> np.uint32(32 - bits)


def ngram_slots(b, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of a batch's texts (column 1) and their text numbers."""
    data, off = text_bytes(b.column(1))
    slots = hashed_ngrams(lower_ascii(data), n, bits)
    d = text_of_item(off)
    ok = d[:len(slots)] == d[n - 1:] if len(slots) else np.zeros(0, bool)
    return slots[ok], d[:len(slots)][ok]


def fit(train: DataFrame, n: int = 3, table_bits: int = 14, sample_rows: int = 20_000) -> dict:
    """Model from (doc_id, text, lang) rows: languages, codewords, weights of n-grams and bits."""
    rows = checked_columns(train, ["doc_id", "text", "lang"]).where("lang is not null and text is not null")
    total = rows.count()
    if total > sample_rows:
        share = int(sample_rows / total * (1 << 28))
        name = F.coalesce(F.col("doc_id").cast("string"), "text")  # rows without an id are drawn by their text
        rows = rows.where(F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long") < share)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in (s for b in batches for s in slices([b])):
            slots, d = ngram_slots(b, n, table_bits)
            langs = b.column(2).to_pylist()
            code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            owner = np.array([code[x] for x in langs])
            c = np.bincount(owner[d] * (1 << table_bits) + slots, minlength=len(code) << table_bits)
            for x, i in code.items():
                held[x] = held.get(x, 0) + c[i << table_bits:(i + 1) << table_bits]
        for x, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())],
                                             names=["lang", "slot", "n"])

    counts = map_arrow(rows, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # One row a language for the driver: its slots' counts as one blob.
    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(1 << table_bits, np.int64)
        c[pdf["slot"]] = pdf["n"]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [zlib.compress(c.tobytes())]})

    got = sorted((r.lang, r.counts) for r in counts.groupBy("lang").applyInPandas(gather, "lang string, counts binary").collect())
    langs = [x for x, _ in got]
    table = np.array([np.frombuffer(zlib.decompress(c), np.int64) for _, c in got], float).reshape(len(langs), 1 << table_bits)
    rate = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * (1 << table_bits))
    code = codewords(len(langs))
    if len(langs) > 1:
        ones, zeros = ((code.T == s).astype(float) for s in (1, -1))
        weight = np.log(ones @ rate / ones.sum(1, keepdims=True)) - np.log(zeros @ rate / zeros.sum(1, keepdims=True))
        # How far each language lies on each bit's right side, at least, weighs the bit.
        apart = (rate @ weight.T) * code
        bit = np.maximum(apart.min(0), 1e-3)
    else:
        weight, bit = np.zeros((1, 1 << table_bits)), np.ones(1)
    return {"langs": langs, "code": code, "weight": weight.T.astype(np.float32).copy(), "bit": bit / bit.sum(), "n": n, "bits": table_bits}


def predict(docs: DataFrame, model: dict, sharpness: float = 20.0, gap: float = 0.2) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row."""
    langs, code, weight, bit = (model[k] for k in ("langs", "code", "weight", "bit"))

    def run(batches):
        names = np.array([*langs, UND], object)
        for b in slices(batches):
            k = b.num_rows
            letter = np.array([t is not None and any(map(str.isalpha, t)) for t in b.column(1).to_pylist()], bool)
            slots, d = ngram_slots(b, model["n"], model["bits"])
            edges = np.searchsorted(d, np.arange(k + 1))
            total = np.zeros((k, weight.shape[1]))
            has = edges[1:] > edges[:-1]
            if has.any():  # empty texts have no n-gram: their margin stays 0
                total[has] = np.add.reduceat(weight[slots], edges[:-1][has], axis=0)
            margin = total / np.maximum(1, edges[1:] - edges[:-1])[:, None]
            best, score, close = np.full(k, len(langs)), np.zeros(k), np.zeros(k, bool)
            if langs:
                loss = (np.logaddexp(0, -sharpness * margin[:, None, :] * code[None]) * bit).sum(2)
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
                best, score = np.where(letter, loss.argmin(1), len(langs)), np.where(letter, p.max(1), 0.0)
                if len(langs) > 1:
                    top = np.sort(p, 1)
                    close = letter & (top[:, -1] - top[:, -2] < gap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(close)],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = checked_columns(docs, ["doc_id", "text"])
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
