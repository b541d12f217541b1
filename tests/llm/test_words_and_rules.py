"""Quality rules, licence scan, mixing and token counts against plain Python."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from provguard.llm import common, encode, license_scan, mixing, quality_rules, token_count
from provguard.llm.common import text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts(docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = Counter()
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
              len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert have == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_divergence_rejects_symbol_text(spark, rows):
    clean = [(i, t, "en", "s", 1) for i, t, *_ in rows if t and len(t.split()) >= 60 and "w" in t]
    junk = (999, " ".join(f"{'#' * (k % 5 + 1)}{k}$$%" for k in range(300)), "en", "s", 1)
    df = spark.createDataFrame([*clean, junk], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert not got[999].kept and got[999].class_distance > 0.3
    assert got[8].class_distance < 0.2
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def test_quality_columns_stay(docs):
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_license_base_places(docs, spark):
    texts = {1: "Released under the MIT License. mit  license", 2: None, 3: "", 4: "GNU General Public License, gnu general\npublic license v3",
             5: "apache-license cc by-nc", 6: "xmit license", 7: "the the the license mit", 8: "Ünder mit license"}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, places int")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, v in texts.items():
        w = words.findall("".join(c.lower() if c.isascii() else c for c in v or ""))
        want = sorted((i, label) for p, label in license_scan.BASE_PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert got[k].n_words == len(w)
        assert [(p.start, p.label) for p in got[k].places] == want


def test_license_spans_survive_a_changed_word(spark):
    t = license_scan.TEMPLATES[0][1].split()
    t[9] = "somebody"
    df = spark.createDataFrame([(1, "intro words " + " ".join(t).upper() + " outro")], "doc_id long, text string")
    (r,) = license_scan.scan_licenses(df).collect()
    assert [s.label for s in r.spans] == ["mit"] and r.spans[0].coverage > 0.8 and r.spans[0].first == 2


def test_suffix_automaton_matching_statistics():
    sa = license_scan.SuffixAutomaton([[1, 2, 3, 4, 1, 2], [2, 3, 5, 1, 2, 3]])
    strings = {tuple(s[i:j]) for s in ([1, 2, 3, 4, 1, 2], [2, 3, 5, 1, 2, 3]) for i in range(6) for j in range(i + 1, 7)}
    text = [9, 1, 2, 3, 5, 1, 2, 9, 4, 1, 2, 3, 4, 1, 2, 2, 3, 5]
    for start, n, seq, at in sa.matches(text, 2):
        m = tuple(text[start:start + n])
        assert m in strings
        assert start + n == len(text) or (*m, text[start + n]) not in strings
    assert sum(n for _, n, _, _ in sa.matches(text, 2)) >= 12


def brute_matches(text, sequences, least):
    """Runs of equal tokens on every diagonal of every sequence, as long as they go."""
    out = set()
    for k, seq in enumerate(sequences):
        for i in range(len(text)):
            for j in range(len(seq)):
                if text[i] == seq[j] and not (i and j and text[i - 1] == seq[j - 1]):
                    n = next((n for n in range(1, len(seq)) if i + n >= len(text) or j + n >= len(seq) or text[i + n] != seq[j + n]), len(seq))
                    if n >= least:
                        out.add((i, n, k, j))
    return out


def test_all_matches_of_all_templates():
    rng = random.Random(8)
    for _ in range(150):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        sequences.append(sequences[0][:5] + sequences[1][2:])
        text = [rng.randrange(4) for _ in range(40)] + sequences[4]
        got = list(license_scan.SuffixAutomaton(sequences).all_matches(text, 2))
        assert len(got) == len(set(got)) and set(got) == brute_matches(text, sequences, 2)


def test_each_template_alone_is_found_whole():
    scan = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.TEMPLATES, 4, 12, 0.6).scan
    for label, t in license_scan.TEMPLATES:
        n = len(t.split())
        for text, first in ((t, 0), (f"Intro: {t.title()}.", 1)):
            assert (label, first, first + n, 1.0) in scan(text)[2]


def brute_chains(matches, max_gap, least):
    """All chains of matches, tried one after the other; the best is taken, the rest cut, and again."""
    out, left = [], set(matches)

    def chains(cover, first, end, at):
        yield cover, -end, first
        for s, n, p in left:
            over = max(0, end - s, at - p)
            if over < n and s + over - end <= max_gap:
                yield from chains(cover + n - over, first, s + n, p + n)

    while True:
        cover, end, first = max((c for s, n, p in left for c in chains(n, s, s + n, p + n)), default=(0, 0, 0))
        if not left or cover < least:
            return sorted(out, key=lambda c: c[1:])
        end = -end
        out.append((cover, first, end))
        cut = set()
        for s, n, p in left:
            if s < first:
                cut.add((s, min(n, first - s), p))
            if s + n > end:
                d = max(0, end - s)
                cut.add((s + d, n - d, p + d))
        left = cut


def test_chains_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        seq = [rng.randrange(6) for _ in range(10)]
        text = []
        for _ in range(rng.randrange(1, 4)):  # edited copies, some side by side
            copy = list(seq)
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(copy))
                copy[i:i + rng.randrange(3)] = [9] * rng.randrange(2)
            text += copy + [9] * rng.randrange(3)
        found = [(s, n, at) for s, n, _, at in license_scan.SuffixAutomaton([seq]).all_matches(text, 2)]
        for least in (1, 5):
            assert license_scan.chain(found, 2, least) == brute_chains(found, 2, least)


def test_each_template_is_found_with_one_edit():
    """A word gone, changed or added costs at most the edit and the words that are cut off from a match of 4."""
    scan = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.TEMPLATES, 4, 12, 0.6).scan
    for label, t in license_scan.TEMPLATES:
        w = t.split()
        for i in range(len(w)):
            for new, lost in (((), 1), (("zzz",), 1), (("zzz", w[i]), 0), ((w[i], w[i]), 0)):
                short = [n for n in (i, len(w) - i - lost) if n < 4]
                if len(w) - lost - sum(short) >= 0.6 * len(w):
                    best = max((c for x, _, _, c in scan(" ".join([*w[:i], *new, *w[i + 1:]]))[2] if x == label), default=0)
                    assert best >= (len(w) - lost - sum(short)) / len(w) - 1e-9, (t, i, new)


def test_license_notice_with_a_passage_gone():
    """The matches around a gap share the word 'it': 25 of the 29 words are there."""
    scan = license_scan.Scanner(license_scan.BASE_PHRASES, license_scan.TEMPLATES, 4, 12, 0.6).scan
    t = license_scan.TEMPLATES[4][1]
    cut = t.replace(" and or modify it", "")
    assert ("gpl", 2, 27, 25 / 29) in scan(f"a b {cut} c")[2]
    # a stray match between two parts of a span, and copies side by side
    w = t.split()
    stray = " ".join([*w[:14], *w[2:6], *w[14:]])
    assert ("gpl", 0, 33, 1.0) in scan(stray)[2]
    assert [s for s in scan(" ".join([t] * 400))[2] if s[0] == "gpl"] == [("gpl", 29 * k, 29 * k + 29, 1.0) for k in range(400)]


def test_mixing_budgets(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, text, _, source, _ in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted([s for s in size if s is not None]) + [s for s in size if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:  # cap those above, share the rest again
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= 2 * size[s]
            free.discard(s)
    taken, by_size = defaultdict(int), {v: k for k, v in size.items()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[by_size[r.source_size]])
        taken[by_size[r.source_size]] += r.taken
    for s in names:
        assert taken[s] == math.floor(target[s] + 1e-9)


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, rows, vocabulary, spark):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(docs, vocabulary, table_bytes=50, batch_bytes=300).collect())
    path = token_count.vocabulary_path(vocabulary)
    if vocabulary.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    want = Counter()
    for i, t, *_ in rows:
        n = count(t or "")
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want


def test_token_pieces_add_up():
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_count.vocabulary_path("byte_bpe_50k.json"))
    whole = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    texts = ["a  b c\n d", "x <|endoftext|> y<|endoftext|>z", "it's  we'll \u00e9 \u00fc  x", " lead trail ", "a\u00a0 b", "1 2 33 !! ?? a.b c"]
    for t in texts:
        data, off = text_bytes(pa.array([t]))
        at = [*encode.safe_starts(data, off).tolist(), len(data)]
        assert sum(whole(data[a:z].tobytes().decode()) for a, z in itertools.pairwise(at)) == whole(t)
    rng = random.Random(12)
    marks = ["a", "Be", "'s", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u4e2d", "\u00e9", "7", ".", "-", "_", "|", "<|endoftext|>", "\x0b", "\U0001f600", "\u2028", "\x00", "\u0301"]
    texts += ["".join(rng.choices(marks, k=rng.randrange(1, 30))) for _ in range(4000)]
    for table in (0, 1 << 20):
        enc = encode.Encoder("byte_bpe_50k.json", table)
        for k in range(0, len(texts), 500):
            data, off = text_bytes(pa.array(texts[k:k + 500]))
            assert enc.lengths(data, off).tolist() == [whole(t) for t in texts[k:k + 500]]


def test_span_hashes_by_bytes_alone(monkeypatch):
    rng = random.Random(14)
    words = ["".join(rng.choices("abc", k=rng.choice([1, 2, 3, 40]))) for _ in range(500)]
    data, off = text_bytes(pa.array([" ".join(words), "", "abc " * 30 + "x" * 900]))
    s, e, _ = common.word_spans(data, off)
    whole = common.span_hashes(data, s, e)
    of = {data[a:z].tobytes(): h for a, z, h in zip(s, e, whole.tolist())}
    assert [of[data[a:z].tobytes()] for a, z in zip(s, e)] == whole.tolist() and len(set(of.values())) == len(of)
    for block in (1, 50, 700):
        monkeypatch.setattr(common, "SPAN_BLOCK", block)
        assert common.span_hashes(data, s, e).tolist() == whole.tolist()


def test_long_pieces_stay_out_of_the_table(monkeypatch):
    """Texts without a boundary, longer than a block: counted whole, and no table of them is kept."""
    monkeypatch.setattr(encode, "BLOCK", 1000)
    enc = encode.Encoder("byte_bpe_50k.json", 5000)
    rng = random.Random(13)
    texts = ["".join(rng.choices("abcXYZ019", k=3000)) for _ in range(20)] + ["\u4e2d\u6587" * 900, " ".join(f"w{rng.randrange(10**9)}" for _ in range(3000))]
    data, off = text_bytes(pa.array(texts))
    assert enc.lengths(data, off).tolist() == [len(enc.tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert enc.bytes < 5000 + 1000 * 40 and enc.ids.nbytes < 50_000


def test_empty_tables(empty):
    assert quality_rules.quality_rules(empty).collect() == []
    assert license_scan.scan_licenses(empty).collect() == []
    assert mixing.mix_sources(empty).collect() == []
    assert token_count.count_tokens(empty).collect() == []
