"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

1. Document evidence: a naive Bayes classifier over hashed presence features (words,
   symbol runs, layout marks) gives log odds for "good" and for "toxic".  Only features
   whose counts differ between the classes beyond chance (a G statistic, also against the
   number of texts, so that families of copies do not pass) and by much (the log odds)
   towards the bad class get a weight; words that one class merely favours do not.
   It is fitted on a bounded sample of labelled rows (``sample_rows``).
2. Site posteriors: each document's probability is added up by path and host (grouped
   aggregation with partial sums, so a hot host is one row a task).  A path's rate is
   shrunk to its host's and a host's to the global rate, each with the strength that the
   spread between groups supports (method of moments for a beta prior).
3. A document's posterior: evidence plus the log odds of its path's shrunk rate, from
   which its own contribution is taken out.

Defined cases: null text has no evidence, so the site decides; a null host or path is
a group of its own; without labels of a class the evidence is 0 and the prior 0.5; a row
repeated counts each time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_columns, map_arrow, read_table, write_scratch

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
BITS = 18
# Least G statistic for each labelled text: layout marks of poor texts are few and telling,
# toxic words many and each rare.
LEAST_SHARE = {"quality": 0.02, "toxic": 0.008}
TASKS = ("quality", "toxic")
ALARM = {"quality": -1, "toxic": 1}  # the side that features speak for: low quality, toxic


def features(text: str | None) -> np.ndarray:
    """Distinct feature slots of a text: lower-case words, symbol runs, layout marks."""
    if not text:
        return np.zeros(0, np.int64)
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    found = {t.lower() for t in tokens}
    words = [t for t in tokens if t[0].isalnum()]
    n = max(1, len(words))
    found.add(f"\0upper{int(10 * sum(map(str.isupper, words)) / n)}")
    found.add(f"\0symbols{int(10 * (len(tokens) - len(words)) / len(tokens))}")
    found.add(f"\0distinct{int(10 * len(set(words)) / n)}")
    found.add(f"\0length{len(tokens).bit_length()}")
    return np.unique([slot(x) for x in found])


def slot(x: str) -> int:
    """A feature's slot."""
    return zlib.crc32(x.encode()) & ((1 << BITS) - 1)


def sample_labels(labels: DataFrame, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` labelled ids, chosen by md5; all of them if there are no more."""
    total = labels.count()
    if total <= sample_rows:
        return labels
    share = int(sample_rows / total * (1 << 28))
    return labels.where(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("long") < share)


def fit(labelled: DataFrame, least_g: float = 30.0, least_share: dict[str, float] = LEAST_SHARE, least_weight: float = 2.0) -> dict[str, np.ndarray]:
    """Weights by task from (doc_id, text, quality, toxic) rows: an array of slots and their log odds.

    Counts are screened in Spark; only the features that pass reach the driver, and few can:
    a feature needs ``least_share`` of the texts' information about the label."""
    rows = checked_columns(labelled, ["doc_id", "text", *TASKS])

    def count(batches):
        c = np.zeros((len(TASKS), 2, (1 << BITS) + 1), np.int64)  # the last slot counts texts
        for b in batches:
            labels = [b.column(2 + t).to_pylist() for t in range(len(TASKS))]
            for i, text in enumerate(b.column(1).to_pylist()):
                f = np.append(features(text), 1 << BITS)
                for t in range(len(TASKS)):
                    if labels[t][i] in (0, 1):
                        c[t, labels[t][i], f] += 1
        for t in range(len(TASKS)):
            at = np.flatnonzero(c[t].sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[t, 1, at]), pa.array(c[t, 0, at])],
                                             names=["task", "slot", "a", "b"])

    counts = map_arrow(rows, count, "task int, slot int, a long, b long").groupBy("task", "slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = write_scratch(counts, "feature-counts")
    texts = {r.task: (r.a, r.b) for r in counts.where(F.col("slot") == 1 << BITS).collect()}  # a row for each task
    out = {}
    for t, name in enumerate(TASKS):
        n1, n0 = texts.get(t, (0, 0))
        if not n0 or not n1:
            out[name] = np.zeros((2, 0))
            continue
        share = (F.col("a") + F.col("b")) / F.lit(n0 + n1)
        part = lambda k, n, s: F.when(k > 0, k * F.log(k / (F.lit(n) * s))).otherwise(0.0)
        g = 2 * (part(F.col("a"), n1, share) + part(F.lit(n1) - F.col("a"), n1, 1 - share)
                 + part(F.col("b"), n0, share) + part(F.lit(n0) - F.col("b"), n0, 1 - share))
        weight = F.log((F.col("a") + 0.5) / F.lit(n1 + 1)) - F.log((F.col("b") + 0.5) / F.lit(n0 + 1))
        got = (counts.where((F.col("task") == t) & (F.col("slot") < 1 << BITS))
               .select("slot", g.alias("g"), weight.alias("w"))
               .where((F.col("g") > max(least_g, least_share[name] * (n0 + n1))) & (F.col("w") * ALARM[name] >= least_weight)).orderBy("slot").collect())
        out[name] = np.array([[r.slot for r in got], [r.w for r in got]], float).reshape(2, -1)
    return out


def evidence(docs: DataFrame, weights: dict[str, np.ndarray], host: Column, path: Column, limit: float = 12.0) -> DataFrame:
    """(doc_id, host, path, e_quality, e_toxic): log odds of each text, held within +-``limit``."""
    def run(batches):
        full = []
        for t in TASKS:
            w = np.zeros(1 << BITS)
            w[weights[t][0].astype(np.int64)] = weights[t][1]
            full.append(w)
        for b in batches:
            f = [features(t) for t in b.column(3).to_pylist()]
            e = [np.clip([w[x].sum() for x in f], -limit, limit) for w in full]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array(x, pa.float64()) for x in e]],
                                             names=["doc_id", "host", "path", "e_quality", "e_toxic"])

    rows = docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, path string, e_quality double, e_toxic double")


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, rate: str, n: str, prior: str) -> Column:
    """Prior strength (in documents) by the method of moments over groups, as one row.

    Between-group variance beyond sampling noise v gives strength m(1 - m) / v - 1."""
    m = F.sum(F.col(prior) * F.col(n)) / F.sum(n)
    spread = F.sum(F.col(n) * F.pow(F.col(rate) - F.col(prior), 2)) / F.sum(n)
    noise = m * (1 - m) * F.count(F.lit(1)) / F.sum(n)
    return F.greatest(F.lit(1.0), m * (1 - m) / F.greatest(spread - noise, F.lit(1e-6)) - 1)


def site_posteriors(scored: DataFrame, task: str) -> DataFrame:
    """(host, path, n, s, rate): shrunk rate of each path, in three grouped steps."""
    p = f"p_{task}"
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("h_n"), F.sum("s").alias("h_s"))
    world = hosts.agg((F.sum("h_s") / F.sum("h_n")).alias("world"))
    hosts = hosts.crossJoin(F.broadcast(world))  # one row of global figures
    hosts = hosts.withColumn("h_rate", F.col("h_s") / F.col("h_n"))
    hk = hosts.agg(strength(hosts, "h_rate", "h_n", "world").alias("h_k"))
    hosts = (hosts.crossJoin(F.broadcast(hk))  # one row
             .withColumn("h_mean", (F.col("h_s") + F.col("h_k") * F.col("world")) / (F.col("h_n") + F.col("h_k")))
             .select(F.col("host").alias("h_host"), "h_mean"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h_host"))).drop("h_host")
    paths = paths.withColumn("raw", F.col("s") / F.col("n"))
    pk = paths.agg(strength(paths, "raw", "n", "h_mean").alias("k"))
    return (paths.crossJoin(F.broadcast(pk))  # one row
            .select(F.col("host").alias("g_host"), F.col("path").alias("g_path"), F.col("n").alias(f"n_{task}"), F.col("s").alias(f"s_{task}"),
                    F.col("h_mean").alias(f"h_{task}"), F.col("k").alias(f"k_{task}")))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample_rows: int = 40_000,
             least_quality: float = 0.05, most_toxic: float = 0.99) -> DataFrame:
    """(doc_id, host, path, e_*, site_* , p_quality, p_toxic, kept) of every row.

    The limits ask for more than one weak sign before a document goes."""
    docs = checked_columns(docs, list(dict.fromkeys(["doc_id", "text", *columns_of(docs, host, path)])))
    y = checked_columns(labels, ["doc_id", *TASKS]).where("doc_id is not null").groupBy("doc_id").agg(*[F.max(t).alias(t) for t in TASKS])
    picked = sample_labels(y, sample_rows).withColumnRenamed("doc_id", "label_id")
    # At most about sample_rows rows of three numbers: a bounded broadcast.
    weights = fit(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).drop("label_id"))
    base = y.agg(*[((F.sum(F.col(t)) + 0.5) / (F.count(t) + 1)).alias(t) for t in TASKS]).first()
    scored = evidence(docs, weights, host, path)
    for t in TASKS:
        prior = float(base[t] if base[t] is not None else 0.5)
        scored = scored.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"e_{t}") + F.lit(float(np.log(prior / (1 - prior))))))))
    scored = write_scratch(scored, "evidence")  # read three times below
    out = scored.withColumnsRenamed({f"p_{t}": f"own_{t}" for t in TASKS})
    sites = None
    for t in TASKS:
        s = site_posteriors(scored, t)
        sites = s if sites is None else sites.withColumnsRenamed({"g_host": "a_host", "g_path": "a_path"}).join(
            s, F.col("a_host").eqNullSafe(F.col("g_host")) & F.col("a_path").eqNullSafe(F.col("g_path"))).drop("a_host", "a_path")
    out = out.join(sites, F.col("host").eqNullSafe(F.col("g_host")) & F.col("path").eqNullSafe(F.col("g_path")), "left")
    for t in TASKS:
        site = (F.col(f"s_{t}") - F.col(f"own_{t}") + F.col(f"k_{t}") * F.col(f"h_{t}")) / (F.col(f"n_{t}") - 1 + F.col(f"k_{t}"))
        out = out.withColumn(f"site_{t}", site).withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"e_{t}") + logit(F.col(f"site_{t}"))))))
    kept = (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic)
    return out.select("doc_id", "host", "path", *[f"{a}_{t}" for t in TASKS for a in ("e", "site", "p")], kept.alias("kept"))


def columns_of(docs: DataFrame, *cols: Column) -> list[str]:
    """Columns of a frame that expressions use."""
    plan = docs.select(*cols)._jdf.queryExecution().analyzed()
    used = plan.references().toSeq()
    names = {used.apply(i).name() for i in range(used.size())}
    return [c for c in docs.columns if c in names]


def op10_site_quality(spark, sf_dir: str) -> DataFrame:
    """A document's source is its host; a language section of a host is a path."""
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, read_table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
