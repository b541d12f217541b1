"""Substring, suffix and n-gram joins and decontamination against brute force."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provguard.llm import decontaminate, ngram_join, packed, substring_dedup, suffix_dedup
from provguard.llm.common import lower_ascii

SMALL = 3000  # bytes a chunk, so that the few rows make many chunks


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("window", [13, 8])
def test_substring_dedup(docs, rows, window):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, window, SMALL).collect())
    order = lambda i: float("inf") if i is None else i
    words = [(order(i), i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for o, _, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first.get(key, o), o)
    want = Counter()
    for o, i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < o for j in range(window)}
        want[(i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert got == want


@pytest.mark.parametrize("length", [400, 200])
def test_suffix_dedup(docs, rows, length):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, SMALL).collect())
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k:k + length] for _, b in texts for k in range(len(b) - length + 1))
    want = Counter()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(b) else 0
        want[(i, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))] += 1
    assert got == want


def brute_components(rows, n, num, den):
    sets = []
    for i, t, *_ in rows:
        w = lower_ascii(np.frombuffer((t or "").encode(), np.uint8)).tobytes().split()
        sets.append((i, frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    link = defaultdict(set)
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and i is not None and j is not None and den * len(x & y) >= num * len(x | y):
                link[i].add(j), link[j].add(i)
    out = Counter()
    for i, x in sets:
        reach, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - reach:
                reach.add(j), todo.append(j)
        out[(i, len(x), min(reach) if i is not None else None)] += 1
    return out


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (3, 97, 100)])
def test_ngram_join(docs, rows, n, num, den):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(docs, n, num, den, SMALL).collect())
    assert got == brute_components(rows, n, num, den)


def test_ngram_join_chain_and_unlinked_family(spark):
    """A chain whose ends don't link, and a family that shares prefixes without links."""
    base = [f"c{k}" for k in range(120)]
    rows = []
    for k in range(12):  # each differs from the next by one word
        rows.append((k, " ".join(base), None, None, 1))
        base = [*base[:k * 9], f"x{k}", *base[k * 9 + 1:]]
    stem = [f"s{k}" for k in range(80)]
    for k in range(40):
        w = list(stem)
        for j in range(4):
            w[(k * 7 + j * 19) % 80] = f"y{k}_{j}"
        rows.append((100 + k, " ".join(w), None, None, 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, 3, 90, 100, SMALL).collect())
    assert got == brute_components(rows, 3, 90, 100)


def test_ngram_join_passage_in_every_prefix(spark):
    """A passage rare enough to stand in all prefixes: most documents that share it don't link, some do."""
    import random
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(24)]
    common = [[word() for _ in range(60)] for _ in range(3)]
    rows = []
    for k in range(90):
        body = list(rng.choice(common)) if k % 2 else [word() for _ in range(40)]
        for _ in range(rng.randrange(4)):
            body[rng.randrange(len(body))] = word()
        rows.append((k, " ".join(body[:20] + passage[rng.randrange(3):] + body[20:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, num in ((3, 90), (3, 60), (5, 80)):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, n, num, 100, SMALL).collect()}
        sets = {i: {tuple(t.split()[k:k + n]) for k in range(len(t.split()) - n + 1)} for i, t in rows}
        label = {i: i for i in sets}
        moved = True
        while moved:
            moved = False
            for a in sets:
                for b in sets:
                    if label[b] < label[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                        label[a], moved = label[b], True
        assert got == {(i, len(x), label[i]) for i, x in sets.items()}


def test_ngram_join_unlinked_members_leave_few_rows(spark, monkeypatch):
    """Members of a family that share all prefixes but do not link leave no row for each pair of them."""
    import random
    rng = random.Random(8)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(120):
        w = list(base)
        at = [7 * x + 3 for x in rng.sample(range(20), 4)]
        if k % 2:  # linked with the base: one word is another
            w[at[0]] = f"x{k}"
        else:  # four words are others, two of them as in some other documents
            for j, i in enumerate(at):
                w[i] = f"y{k}_{j}" if j < 2 else f"z{i}_{k % 8}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, f"{rows[0][1]} {' '.join(base[k:])}") for k in range(4)]
    made, near_groups = [], ngram_join.near_groups

    def counted(hits, *args):
        made.append(hits.count())
        return near_groups(hits, *args)

    monkeypatch.setattr(ngram_join, "near_groups", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, 5, 80, 100, SMALL).collect())
    assert got == brute_components(rows, 5, 80, 100)
    assert len({i for _, _, i in got}) > 40
    assert sum(made) < 10 * len(rows), made


def test_parities_never_exceed_the_difference(spark):
    """Parities count no more than two sets differ in; a group's count no more than any of its sets differs in."""
    rng = np.random.default_rng(3)
    of = lambda x: np.array(ngram_join.parities(np.array(sorted(x), np.uint64))).view(np.uint64)
    bits = lambda x: int(np.bitwise_count(x).sum())
    for size in (0, 1, 30, 400):
        base = set(rng.integers(0, 1 << 64, size, dtype=np.uint64).tolist())
        sets = []
        for edits in (0, 1, 5, 40):
            kept = set(rng.permutation(sorted(base)).tolist()[edits:])
            sets.append(kept | set(rng.integers(0, 1 << 64, edits, dtype=np.uint64).tolist()))
        for x in sets:
            assert all(bits(of(x) ^ of(y)) <= len(x ^ y) for y in sets)
    assert bits(of({1, 2, 3}) ^ of({2, 3, 4, 5})) == 3 and bits(of({7, 7 + ngram_join.PARITIES})) == 0
    group = [{1, 2, 3, 4}, {1, 2, 3, 9}, {1, 2, 3, 70}]
    both = np.bitwise_and.reduce([of(x) for x in group])
    same = ~(both ^ np.bitwise_or.reduce([of(x) for x in group]))
    pivot, lead, group_lead = {3, 5, 200}, 2, 1
    cols = {f"p_odd{i}": int(v) for i, v in enumerate(of(pivot).view(np.int64))} | {f"odd{i}": int(v) for i, v in enumerate(both.view(np.int64))}
    cols |= {f"same{i}": int(v) for i, v in enumerate(same.view(np.int64))} | {"p_lead": lead, "lead": group_lead}
    got = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} long" for c in cols)).select(ngram_join.differing().alias("d")).first().d
    assert got == lead + group_lead + 4  # 1, 2, 5 and 200 differ from all; 4, 9 and 70 are not in common
    assert all(got - lead - group_lead <= len(pivot ^ x) for x in group)


def test_sets_apart_by_both_signatures():
    """Two sets that meet in the first 64-bit sum alone both stay."""
    u = lambda *x: np.array(x, np.uint64)
    pay = lambda keys, ids, second: (packed.pack(u(*keys), 48), packed._zip(np.array([*ids, *second], np.int64)))
    chunks = [pay((5, 5, 9), (7, 3, 1), (10, 11, 12)), pay((5, 9), (4, 1), (10, 12))]
    got = [np.unpackbits(np.frombuffer(r, np.uint8))[:n].tolist()
           for r, n in zip(ngram_join.answer_copies(*map(list, zip(*chunks))), (3, 2))]
    assert got == [[1, 0, 0], [0, 1]]
    number, at = packed.numbered(u(5, 9, 5, 5), u(2, 0, 1, 2))
    assert number.tolist() == [1, 2, 0, 1] and u(5, 9, 5, 5)[at].tolist() == [5, 5, 9]


def test_by_parts():
    """Any part size gives the same answers, and a key's entries come together."""
    rng = np.random.default_rng(3)
    lists = [np.sort(rng.integers(0, 60, n).astype(np.uint64) << np.uint64(s)) for n, s in ((0, 0), (40, 0), (1, 58), (90, 58))]
    for some in (lists, lists[:2], lists[:1], [lists[1][:1]] * 3, [np.array([2**64 - 1], np.uint64)] * 2):
        beside = [np.arange(len(k)) for k in some]

        def judge(k, x):
            of, n = packed.key_groups(k)
            return np.stack([np.bincount(of, minlength=n)[of], x])

        whole = judge(np.concatenate(some), np.concatenate(beside))
        for size in (1, 7, 10**6):
            got = packed.by_parts(judge, some, beside, size=size)
            assert [g.shape[1] for g in got] == [len(k) for k in some]
            assert (np.concatenate(got, 1) == whole).all()


def test_answers_need_little_memory():
    """A full bucket of keys is sorted part by part: its task takes far less than the bucket's sort would."""
    rng = np.random.default_rng(4)
    keys = [np.unique(rng.integers(0, 1 << 32, 20_000, dtype=np.uint64)) for _ in range(50)]
    short, long = ([packed.pack(k, bits) for k in keys] for bits in (16, 48))
    flags = [np.packbits(np.ones(len(k), bool)).tobytes() for k in keys]
    ones = [packed._zip(np.ones(len(k), np.uint32)) for k in keys]
    whole = [k.tobytes() for k in keys]
    ids = [k.tobytes() + packed._zip(np.arange(len(k))) for k in keys]
    pairs = [packed._zip(np.concatenate([np.arange(len(k)), k.view(np.int64)])) for k in keys]
    n = sum(map(len, keys))
    for answer, asked, extra, most in (
            (substring_dedup.answer_blocks, short, flags, 36), (substring_dedup.answer_windows, long, ids, 48),
            (ngram_join.answer_frequency, short, ones, 40), (ngram_join.answer_copies, long, pairs, 52),
            (suffix_dedup.elsewhere(16), short, flags, 32), (suffix_dedup.answer_covers, short, whole, 38)):
        tracemalloc.start()
        answer(asked, extra)
        peak = tracemalloc.get_traced_memory()[1] / n
        tracemalloc.stop()
        assert peak < most


def test_decontaminate_tolerates_substitutions(spark, docs):
    item = [f"q{k}" for k in range(30)]
    changed = [*item[:8], "zzz", *item[9:21], "yyy", *item[22:]]
    text = {100: "lead in " + " ".join(item).upper() + " out", 101: "x " * 50 + ", ".join(changed), 102: " ".join(item[:9]) + " other " + " ".join(item[12:15]),
            103: None, 104: "", 105: "x y " * 4000 + " ".join(item) + " z" * 4000}
    train = spark.createDataFrame([(k, v, 1) for k, v in text.items()], "doc_id long, text string, seed int")
    test = spark.createDataFrame([(1, " ".join(item), 3), (2, None, 3), (3, "too short", 3), (None, "other words " * 30, 3)], "item_id long, text string, words int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(train, test).collect()}
    assert set(got) == {(100, 1), (101, 1), (105, 1)}
    assert (got[100, 1].first_word, got[100, 1].end_word, got[100, 1].n_equal) == (2, 32, 30)
    assert (got[101, 1].first_word, got[101, 1].n_equal) == (50, 28)
    assert got[105, 1].first_word == 8000
    assert decontaminate.find_overlaps(docs, test).collect() == []


def brute_overlaps(docs, items, masks=decontaminate.MASKS):
    """On every diagonal every (start, end) that holds a seed, 12 equal words and 80 % of them, cut to equal words; those that touch are one."""
    out = Counter()
    for (i, x), (j, y) in ((a, b) for a in docs for b in items):
        x, y = (x or "").split(), (y or "").split()
        if 0 < len(y) < 12:
            out.update((i, j, d, d + len(y), len(y), 0) for d in range(len(x) - len(y) + 1) if x[d:d + len(y)] == y)
            continue
        for d in range(12 - len(y), len(x) - 11):
            at = max(0, -d)
            eq = np.array([a == b for a, b in zip(x[max(0, d):], y[at:])], bool)
            for a, z in brute_stretches(eq, masks):
                out[i, j, d + at + a, d + at + z, int(eq[a:z].sum()), at + a] += 1
    return out


def brute_stretches(eq, masks=decontaminate.MASKS, min_equal=12, min_share=0.8):
    seeds = [p for p in range(len(eq) - 11) if any(all(eq[p + k] for k in range(12) if m[k] == "1") for m in masks)]
    if not seeds:
        return []
    n = np.concatenate([[0], np.cumsum(eq)])
    a, z = np.triu_indices(len(eq) + 1, 12)
    same = n[z] - n[a]
    last = np.array([max([p for p in seeds if p + 12 <= e], default=-1) for e in range(len(eq) + 1)])
    ok = (same >= min_equal) & (1000 * same >= round(1000 * min_share) * (z - a)) & (last[z] >= a)
    place, good = np.flatnonzero(eq), np.zeros(2 * len(eq) + 2, bool)  # places, and the steps between them
    for b, e in set(zip(place[n[a[ok]]].tolist(), place[n[z[ok]] - 1].tolist())):
        good[2 * b:2 * e + 3] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(int)))
    return [(int(b) // 2, int(e - 1) // 2) for b, e in zip(edges[::2], edges[1::2])]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([0.8, 0.75, 0.9, 1.0]), st.sampled_from([12, 8, 20]))
def test_overlaps_against_every_stretch(seed, min_share, min_equal):
    rng = np.random.default_rng(seed)
    eq = np.concatenate([rng.random(rng.integers(0, 60)) < rng.choice([0, 0.2, 0.5, 0.75, 0.8, 0.9, 1]) for _ in range(rng.integers(1, 6))])
    got = decontaminate.overlaps(eq, decontaminate.MASKS, min_equal, min_share)
    assert got == [(a, z, int(eq[a:z].sum())) for a, z in brute_stretches(eq, min_equal=min_equal, min_share=min_share)]


def test_copies_behind_similar_words(spark):
    """Words before an exact copy that are much alike, but not enough, do not hide it; nor does an earlier overlap."""
    item = [f"q{k}" for k in range(640)]
    before = [w if k % 9 < 7 else f"c{k}" for k, w in enumerate(item[:540])]
    docs = [(1, " ".join([*before, *item[540:570]])), (2, " ".join(["x"] * 540 + item[540:570]))]
    docs += [(3, " ".join([*item[:100], *["y"] * 33, *item[133:147]]))]
    got = {(r.doc_id, r.first_word, r.end_word) for r in decontaminate.find_overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert {(2, 540, 570), (3, 0, 100), (3, 133, 147)} <= got and any(i == 1 and a <= 540 and z == 570 for i, a, z in got)
    many = spark.createDataFrame([(1, "same " * 600)], "doc_id long, text string")
    rows = decontaminate.find_overlaps(many, spark.createDataFrame([(1, "same " * 40)], "item_id long, text string")).collect()
    assert len(rows) == 600 + 40 - 23  # one for each diagonal of 12 words or more


def check_overlaps(spark, docs, items):
    train = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = decontaminate.find_overlaps(train, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == brute_overlaps(docs, items)
    return {(r.doc_id, r.item_id) for r in got}


def test_decontaminate_verifies_every_hit(spark):
    """A weak first hit on a diagonal does not hide a later one; long items are laid along whole."""
    item = [f"q{k}" for k in range(40)]
    weak = [w if k >= 19 or (k < 12 and decontaminate.MASKS[0][k] == "1") else f"c{k}" for k, w in enumerate(item)]
    long = [f"r{k}" for k in range(3000)]
    rng = np.random.default_rng(3)
    noisy = [w if rng.random() > 0.15 else "n" for w in long]
    docs = [(1, " ".join(weak)), (2, "s " * 1010 + " ".join(noisy[100:400]) + " t" * 30 + " " + " ".join(long[430:470]))]
    docs += [(10 + k, " ".join(w if rng.random() > 0.1 + 0.02 * k else "n" for w in item[k:])) for k in range(15)]
    assert {(1, 1), (2, 2)} <= check_overlaps(spark, docs, [(1, " ".join(item)), (2, " ".join(long[:600]))])


def test_decontaminate_short_items_and_repeated_ids(spark):
    """Items shorter than the masks match as a whole; rows of one id, or of none, are told apart."""
    item = [f"q{k}" for k in range(30)]
    cut = " ".join([*item[:6], "b", "b", "b", *item[9:13], "b", "b", "b", *item[16:20]])
    docs = [(1, " ".join(item)), (1, cut), (1, " ".join(item)), (None, " ".join(item[5:])), (None, "no match"), (2, "what is it"),
            (3, "so what is it then what is it"), (4, "what was it"), (5, "x"), (6, None), (7, "v " * 1022 + "what is it")]
    items = [(1, " ".join(item)), (1, "other " * 20), (None, " ".join(item)), (2, "what is it"), (2, "x"), (3, ""), (4, None),
             (5, " ".join(item[3:14]))]
    assert {(3, 2), (2, 2), (5, 2), (7, 2), (None, None), (1, 5)} <= check_overlaps(spark, docs, items)


def test_empty_tables(empty, spark):
    assert substring_dedup.remove_repeats(empty).collect() == []
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert ngram_join.ngram_join(empty).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_overlaps(empty, none).collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_packed_keys_round_trip(short, long):
    for keys, bits in ((short, 16), (long, 48)):
        a = np.unique(np.array(keys, np.uint64))
        assert (packed.unpack(packed.pack(a, bits), bits) == a).all()
