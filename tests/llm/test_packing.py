"""Packing: every id once, gapless full sequences, tiers, step groups, odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from provguard.llm import encode, packing
from provguard.llm.common import text_bytes


def plain_ids(texts):
    tok = encode.Encoder("byte_bpe_50k.json").tok
    return [x.ids for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(got, rows, window=2048):
    """Pieces against the tokenizer's own ids; returns the sequences."""
    want = defaultdict(list)  # texts of one id are told apart by the pieces' own checksums
    for (i, *_), x in zip(rows, plain_ids([r[1] for r in rows]), strict=True):
        want[i].append([*x, 1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append(r)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    for i, docs in want.items():
        for n in {len(x) for x in docs}:
            same = [x for x in docs if len(x) == n]
            held = by_doc.pop((i, n))
            assert sum(r.length for r in held) == n * len(same)
            counts = defaultdict(int)
            for r in held:
                assert r.ids_crc32 in {crc(x[r.start:r.start + r.length]) for x in same}
                counts[r.start] += 1
                counts[r.start + r.length] -= 1
            assert counts.pop(0) == len(same) and counts.pop(n) == -len(same) and not any(counts.values())
    assert not by_doc
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [0, *np.cumsum([r.length for r in held])[:-1].tolist()]
        total = sum(r.length for r in held)
        assert total <= window and total == held[0].context and total & (total - 1) == 0
        assert len({(r.context, r.step_group) for r in held}) == 1
    return by_sequence


@pytest.mark.parametrize("cell_tokens", [1 << 21, 4000])
def test_pack_documents(docs, rows, cell_tokens):
    got = packing.pack_documents(docs, cell_tokens=cell_tokens, step_tokens=4096).collect()
    sequences = check_pieces(got, rows)
    steps = defaultdict(set)
    for q, held in sequences.items():
        steps[held[0].step_group].add((q, held[0].context))
    for held in steps.values():
        assert len({c for _, c in held}) == 1 and sum(c for _, c in held) <= 4096


def test_pack_empty_and_small(spark, empty):
    assert packing.pack_documents(empty).collect() == []
    rows = [(None, None), (1, ""), (1, ""), (2, "a " * 5000), (None, "one word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_pieces(packing.pack_documents(df).collect(), rows)


def test_pack_bad_tiers(empty):
    with pytest.raises(ValueError):
        packing.pack_documents(empty, tiers=(2048, 1000))


@pytest.mark.parametrize("seed", range(20))
def test_pack_tiers(seed):
    """Whole lengths, full sequences, few cuts."""
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 2048), rng.randrange(1, 300), 0, 1, 256, 1024]) for _ in range(rng.choice([0, 1, 5, 400]))]
    out = packing.pack_tiers(lengths, packing.TIERS)
    left = defaultdict(list)
    for context, pieces in out:
        assert sum(n for *_, n in pieces) == context and context & (context - 1) == 0
        for doc, start, n in pieces:
            left[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, m in sorted(left.get(doc, [])):
            assert start == at
            at += m
        assert at == n
    assert sum(c < 256 for c, _ in out) <= 8
    assert sum(map(len, left.values())) <= len(lengths) + len(out) + 12


def test_step_groups_balance():
    rng = np.random.default_rng(1)
    context = rng.choice([2048, 1024, 256], 900)
    cost = rng.integers(1, 1000, 900).astype(float)
    group = packing.step_groups(context, cost, 1 << 15)
    for size in (2048, 1024, 256):
        per = np.bincount(group[context == size] - group[context == size].min())
        assert per.max() * size <= 1 << 15 and per.max() - per.min() <= 1
        share = np.bincount(group[context == size] - group[context == size].min(), cost[context == size]) / per
        assert share.max() / share.min() < 1.5


def test_encoder_equals_tokenizer():
    """Odd spaces, marks and special strings, with and without a full table."""
    rng = random.Random(3)
    marks = [" ", "  ", "\n", "\u0085", " ", " ", "　", "a", "b's", "'ll", "1", "é", "中", "x,", "<|endoftext|>", "\t", "—", "😀", "\x1c",
             "\x7f", "​", "ア", " the", "\r", "\n\n", ".\nX"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(0, 14))) for _ in range(5000)] + ["y" * 400 + " q" * 9, "z" * 70_000]
    enc = encode.Encoder("byte_bpe_50k.json")
    want = plain_ids(texts)
    for _ in range(2):
        ids, off = enc(*text_bytes(pa.array(texts)))
        assert [ids[a:z].tolist() for a, z in zip(off, off[1:])] == want
        enc.bytes = encode.TABLE_BYTES + 1  # the table starts anew
