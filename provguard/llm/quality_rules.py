"""Quality rules: distribution divergence against language references.

A first pass adds up, for each language, character-class counts and word counts over all
documents; words with at least ``common_share`` of a language's words are its common
words (so at most 1 / common_share of them).  A second pass compares every text's
two histograms (character classes; common words, with all other words as one bin) with its
language's by Jensen-Shannon distance (base 2, from 0 to 1).  Texts under a minimum
length are not judged by a histogram too short to mean anything.

Words are told apart by 64-bit hashes made inside the tasks; only (language, word hash,
count) rows are shuffled, already added up for each slice of a few MB.  A hot language or
word adds one row a slice.

Defined cases: null text has no words (and fails the length rule); a null language, or
one without a reference, is judged by the nearest reference; an empty table gives no
rows; repeated rows are judged alike; extra columns are ignored; whole texts count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (SPACE, U64, checked_columns, map_arrow, mix, ngram_hashes, slices, span_hashes, text_bytes,
                     text_of_item, window_ok, word_spans)

# Character classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 other ASCII, 7 beyond ASCII.
N_CLASSES = 8
CLASS = np.full(256, 6, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[32, 9]], CLASS[[10, 13]] = 3, 4
CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
CLASS[0xC0:] = 7
FOLLOWS = (np.arange(256) & 0xC0) == 0x80  # UTF-8 continuation bytes: not a character of their own
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
FIXED_CLASS = -1  # lang_counts: rows with kind -1 hold classes, others words


def _text_numbers(data, off, mask) -> np.ndarray:
    """How many marked bytes each text has."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _class_table(data, off) -> np.ndarray:
    own = ~FOLLOWS[data]
    d = text_of_item(off)[own]
    n = len(off) - 1
    return np.bincount(d * N_CLASSES + CLASS[data][own], minlength=n * N_CLASSES).reshape(n, N_CLASSES)


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, kind, item, n): counts of character classes (kind 0) and of word hashes (kind 1)."""
    rows = checked_columns(docs, ["text", "lang"]).where("lang is not null and text is not null")

    def run(batches):
        for b in (s for b in batches for s in slices([b])):
            data, off = text_bytes(b.column(0))
            langs = b.column(1).to_pylist()
            names = {x: k for k, x in enumerate(dict.fromkeys(langs))}
            owner = np.array([names[x] for x in langs])
            s, e, woff = word_spans(data, off)
            h = span_hashes(data, s, e)
            of = owner[text_of_item(woff)]
            classes = np.zeros((len(names), N_CLASSES), np.int64)
            np.add.at(classes, owner, _class_table(data, off))
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
            lang = np.concatenate([np.repeat(np.arange(len(names)), N_CLASSES), of[first]])
            items = np.concatenate([np.tile(np.arange(N_CLASSES), len(names)), h[first].astype(np.int64)])
            n = np.concatenate([classes.ravel(), np.diff(np.append(first, len(h)))])
            kind = np.repeat([0, 1], [classes.size, len(first)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(names), pa.string()).take(pa.array(lang)), pa.array(kind), pa.array(items), pa.array(n)],
                names=["lang", "kind", "item", "n"])

    return (map_arrow(rows, run, "lang string, kind int, item long, n long")
            .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")))


def language_references(docs: DataFrame, common_share: float = 0.004) -> dict[str, dict]:
    """For each language: class shares, common word hashes (sorted) and their shares.

    The driver gets at most 8 + 1 / common_share rows a language."""
    counts = language_counts(docs)
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "l").withColumnRenamed("kind", "k")
    got = (counts.join(F.broadcast(totals), (F.col("lang") == F.col("l")) & (F.col("kind") == F.col("k")))  # two rows a language
           .where((F.col("kind") == 0) | (F.col("n") >= common_share * F.col("total")))
           .select("lang", "kind", "item", (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("share")).collect())
    by_lang: dict[str, list] = {}
    for r in got:
        by_lang.setdefault(r.lang, []).append(r)
    out: dict[str, dict] = {}
    for lang in sorted(by_lang):
        classes = np.zeros(N_CLASSES)
        words = {}
        for r in by_lang[lang]:
            if r.kind == 0:
                classes[r.item] = r.share
            else:
                words[np.int64(r.item).astype(U64)] = r.share
        keys = np.array(sorted(words), U64)
        shares = np.array([words[k] for k in keys])
        out[lang] = {"classes": classes, "words": keys, "shares": np.append(shares, max(0.0, 1 - shares.sum()))}
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of rows of p to q; a row without counts is at 0."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        d = np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))
    return np.where(p.sum(1) > 0, d, 0.0)


def repeated_words(h: np.ndarray, woff: np.ndarray, n: int = 3) -> np.ndarray:
    """Words in n-word windows found twice or more in their text."""
    ok = window_ok(woff, n)
    covered = np.zeros(len(h) + 1, np.int32)
    if ok.any():
        at = np.flatnonzero(ok)
        key = mix(ngram_hashes(h, n)[at] ^ mix(text_of_item(woff)[at].astype(U64)))
        order = np.argsort(key)
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        again = at[order[same]]
        np.add.at(covered, again, 1)
        np.subtract.at(covered, again + n, 1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return total[woff[1:]] - total[woff[:-1]]


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


LIMITS = {"min_words": 50, "max_repeat": 50, "min_chars": 500, "min_common_words": 50, "max_class": 0.22, "max_common": 0.5}


def judge_batch(text: pa.Array, lang: pa.Array, refs: dict[str, dict], limits: dict) -> dict[str, np.ndarray]:
    """Counts, base rules and distances of a batch of texts; ``kept`` needs all rules.

    ``min_chars``, ``min_common_words``: texts with fewer characters or words aren't judged
    by that histogram; ``max_class``, ``max_common``: largest distances kept.
    """
    names, k = list(refs), len(text)
    data, off = text_bytes(text)
    s, e, woff = word_spans(data, off)
    h = span_hashes(data, s, e)
    n_words = np.diff(woff).astype(np.int64)
    chars = _text_numbers(data, off, ~FOLLOWS[data] & ~SPACE[data])
    symbols = _text_numbers(data, off, SYMBOL[data])
    lines = np.array([repeated_lines(t) for t in text.to_pylist()], np.int64)
    repeat = repeated_words(h, woff).astype(np.int64)
    failed = (n_words < limits["min_words"]) | (100 * repeat > limits["max_repeat"] * n_words)
    table = _class_table(data, off)
    d = text_of_item(woff)
    by_class, by_word = np.zeros((k, len(names))), np.zeros((k, len(names)))
    for j, x in enumerate(names):
        ref = refs[x]
        by_class[:, j] = js_distance(table, ref["classes"])
        m = len(ref["words"])
        at = np.minimum(np.searchsorted(ref["words"], h), max(0, m - 1))
        slot = np.where(ref["words"][at] == h, at, m) if m else np.zeros(len(h), np.int64)
        hist = np.bincount(d * (m + 1) + slot, minlength=k * (m + 1)).reshape(k, m + 1)
        by_word[:, j] = js_distance(hist, ref["shares"])
    if names:
        number = {x: j for j, x in enumerate(names)}
        own = np.array([number.get(x, -1) for x in lang.to_pylist()])
        pick = np.where(own >= 0, own, (by_class + by_word).argmin(1))
        by_class, by_word = by_class[np.arange(k), pick], by_word[np.arange(k), pick]
    else:
        by_class, by_word = np.zeros(k), np.zeros(k)
    far = (((chars >= limits["min_chars"]) & (by_class > limits["max_class"]))
           | ((n_words >= limits["min_common_words"]) & (by_word > limits["max_common"])))
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat,
            "base_failed": failed, "kept": ~failed & ~far, "class_distance": by_class, "common_distance": by_word}


def quality_rules(docs: DataFrame, common_share: float = 0.004, **limits) -> DataFrame:
    """(doc_id, counts, base_failed, kept, distances) of every row."""
    refs, limits = language_references(docs, common_share), LIMITS | limits

    def run(batches):
        for b in slices(batches):
            got = judge_batch(b.column(1), b.column(2), refs, limits)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, got.values())], names=["doc_id", *got])

    rows = checked_columns(docs, ["doc_id", "text", "lang"])
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
                                "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, common_distance double")


def keep_good(docs: DataFrame, common_share: float = 0.004, **limits) -> DataFrame:
    """The rows that the rules keep, with all their columns; nothing is shuffled but the counts."""
    refs, limits = language_references(docs, common_share), LIMITS | limits
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(judge_batch(b.column(text), b.column(lang), refs, limits)["kept"]))

    return map_arrow(docs, run, docs.schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return quality_rules(read_table(spark, sf_dir, "documents"))
