"""Hard negatives and ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provguard.llm import hard_negatives, lexical_search
from provguard.llm.common import write_scratch

from ..conftest import SF_SMALL

VECTORS = "vec_id long, embedding array<float>, label int, extra int, tile int"


# --- residue products ---------------------------------------------------------------

def test_primes():
    p = hard_negatives.primes(8)
    assert p[0] == 1021 and all(all(x % d for d in range(2, x)) for x in p) and list(p) == sorted(p, reverse=True)
    assert all(hard_negatives.DEPTH * (x // 2) ** 2 < 1 << 24 for x in p)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.sampled_from([1, 255, 40_000, 2**24, 2**30]))
def test_exact_scores(seed, d, size):
    rng = np.random.default_rng(seed)
    size = max(1, min(size, int(2**30.9 / math.sqrt(d))))
    a, b = (rng.integers(-size, size + 1, (n, d)).astype(np.int32) for n in (5, 7))
    a[0], b[0], b[1] = size, size, -size
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert hard_negatives.exact_scores(a, b).tolist() == want


def brute_negatives(rows, positives=5, negatives=5, scale=256):
    """Rows (id, vector, label): label already final; ids divisible by 100 are anchors."""
    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [r for r in ok if math.sqrt(sum(x * x for x in r[1])) < 2**31]
    last = lambda i: (i is None, i or 0)
    out = Counter()
    for a, v, lab in ok:
        if a is None or a % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), i, m) for i, w, m in ok if len(w) == len(v)), key=lambda r: (-r[0], last(r[1])))
        for p, i, _ in [r for r in scored if r[2] == lab and r[1] != a][:positives]:
            hard = [r for r in scored if r[2] != lab and 80 * p <= 100 * r[0] <= 100 * p][:negatives]
            out.update((a, i, k + 1, j, p, s) for k, (s, j, _) in enumerate(hard))
    return out


def vectors(seed, n, d=6):
    rng = random.Random(seed)
    out = [(k, [rng.choice([rng.gauss(0, 0.3), 0.25, 0.5]) for _ in range(d)], rng.randrange(3)) for k in range(n)]
    same = [0.25] * d
    out += [(1000 + k, same, k % 2) for k in range(30)]  # ties, an anchor among them
    out += [(5, out[5][1], out[5][2]), (200, same, 0), (300, None, 1), (400, [0.1] * d, None), (None, same, 1), (None, same, 0),
            (500, [None, *[0.1] * (d - 1)], 0), (600, [float("nan")] * d, 0), (700, [float("inf")] * d, 0), (800, [], 0), (801, [], 1), (802, [], 0),
            (900, [0.5] * 70, 0), (901, [0.5] * 70, 0), (902, [0.45] * 70, 1), (903, [1e30] * d, 1), (904, [1e6] * d, 0), (1100, [1e6] * d, 1), (1101, [1e6] * d, 1)]
    return out


@pytest.mark.parametrize("sizes", [(4096, 1024, 2), (16, 3, 1)])
def test_hard_negatives(spark, sizes):
    rows = vectors(1, 420)
    df = spark.createDataFrame([(i, v, lab, 1, 2) for i, v, lab in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in hard_negatives.mine_hard_negatives(
        df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 100 == 0, tile_rows=sizes[0], block_rows=sizes[1], group_tiles=sizes[2]).collect())
    assert got == brute_negatives(rows)


def test_hard_negatives_query(spark):
    got = Counter(tuple(r) for r in hard_negatives.op12_hard_negatives(spark, SF_SMALL).collect())
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert got == brute_negatives(rows) and got


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine_hard_negatives(df, "vec_id", "embedding", F.col("label"), F.lit(True)).collect() == []
    one = spark.createDataFrame([(1, [0.5], 1, 0, 0), (2, [0.5], 1, 0, 0)], VECTORS)  # no anchor
    assert hard_negatives.mine_hard_negatives(one, "vec_id", "embedding", F.col("label"), F.lit(False)).collect() == []


# --- lexical search ----------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_search(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, total, df = sum(n > 0 for n in sizes), sum(sizes), Counter(t for _, c in counts for t in c)
    out = defaultdict(list)
    for item, text in {x for x in items if x[1] is not None}:
        words = set(terms(text))
        found = []
        for (i, c), n in zip(counts, sizes):
            m = 100 - 50 + (50 * n * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in words if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out[item] += [[(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]]
    return Counter(x for lists in out.values() for y in lists for x in y)


ITEMS = [(1, "w1 w2 w3 W4"), (1, "w1 w2 w3 W4"), (2, "the Ünï cödé tab"), (3, ""), (4, None), (None, "x one a B"), (5, "edit01 nothing w7 w7 w8"), (5, "b"), (6, "!? --")]


@pytest.mark.parametrize("k, block_items, block_bytes", [(50, 256, 4 << 20), (3, 2, 4 << 20), (7, 256, 10)])
def test_search(spark, docs, rows, k, block_items, block_bytes):
    items = spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, score int, rank int")
    got = Counter(tuple(r) for r in lexical_search.search(docs, items, k, block_items, block_bytes).collect())
    assert got == brute_search([(r[0], r[1]) for r in rows], ITEMS, k)


def test_search_ties_and_empty(spark, empty):
    """More equal documents than are kept, over several parts: the smallest ids stand."""
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    rows = [(k, "alpha x" if k % 3 else "beta alpha") for k in range(1500)] + [(9999, "gamma")] * 700
    random.Random(2).shuffle(rows)
    got = Counter(tuple(r) for r in lexical_search.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), items).collect())
    assert got == brute_search(rows, [(1, "alpha beta")])
    assert lexical_search.search(empty, items).collect() == []
    assert lexical_search.search(spark.createDataFrame(rows[:5], "doc_id long, text string"), items.where("false")).collect() == []


def test_sums_stay_exact():
    """Terms are cut so that no float64 sum can reach 2^53; sums over the cuts are exact."""
    for w in (1, 45_000, 10**9):
        weight = np.full(5000, w, np.int64)
        cuts = lexical_search.term_tiles(weight)
        assert sum(s.stop - s.start for s in cuts) >= 5000
        assert all(min(s.stop - s.start, 5000) * w * lexical_search.IMPACT < 1 << 53 for s in cuts)
    rng = np.random.default_rng(4)
    weight = np.full(40, 10**9, np.int64)
    impact = rng.integers(1, lexical_search.IMPACT, 120)
    doc, term = np.divmod(np.arange(120), 40)
    got = lexical_search.tile_scores(np.ones((1, 40)) * weight, weight, 3, doc, term, impact)
    assert got.tolist() == [[int(x) * 10**9 for x in np.bincount(doc, impact.astype(float)).astype(int)]]
    assert lexical_search.impacts(np.array([10**9]), np.array([1]), 1, 1).max() < lexical_search.IMPACT


def test_written_tiles(spark):
    """Tiles come back from the scratch folder as they were."""
    df = spark.createDataFrame([(k, k % 2, [k / 4.0] * 3) for k in range(50)], "id long, label long, vector array<double>")
    tiles = write_scratch(hard_negatives.pack_rows(df, 256.0, 8), "tiles").collect()
    ids = sorted(i for t in tiles for i in hard_negatives.unpack_tile(t.asDict())[0].tolist())
    assert ids == list(range(50)) and all(t.n <= 8 + 7 for t in tiles)
