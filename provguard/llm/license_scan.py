"""License scans by a generalised suffix automaton over licence tokens.

All templates' tokens form one automaton.  A file's tokens stream through it once; at
each token the automaton's depth is the longest string that ends there and occurs in
some template (matching statistics), and the state and its links name the longest for
each place of each template.  Long local maxima are chained, in order and on
one template, into a covered span, the best chain first; where two overlap, the later one
is cut.  Coverage is the share of the template's tokens in the chain.  Each template is judged by itself: text that several templates share counts
for all of them (a whole GPL notice also covers 16 of the 17 tokens of the LGPL's).  The templates are a fixed parameter, so the automaton is small and each
Python worker builds it once; files are scanned where they lie, without a shuffle.

Base phrases are templates of their own: a place is where all words of the phrase stand
consecutively.

Defined cases: null text has no words; an empty or unmatched text has no labels, null
first and last word, score 0; rows repeat as they are; an empty table gives no rows;
extra columns are ignored.  Whole texts are scanned, however long.
"""

from __future__ import annotations

import bisect
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import checked_columns, map_arrow

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Openings and grants of public licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("mit", "released under the mit license"),
)


class SuffixAutomaton:
    """Generalised suffix automaton of token sequences; a state knows all its template places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.sequences = sequences
        marked: dict[int, set[tuple[int, int]]] = {}
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                marked.setdefault(last, set()).add((k, i + 1))
        # All (sequence, end) places of each state: its own and those of the states that link to it.
        ends = [marked.get(v, set()) for v in range(len(self.link))]
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(by_length):
            ends[self.link[v]] = ends[self.link[v]] | ends[v]
        self.place = [min(e, default=(-1, -1)) for e in ends]
        # (sequence, end, longest string of the state that ends there): the state's own places, then
        # those that only a state up its links has.
        self.ends: list[list[tuple[int, int, int]]] = [[] for _ in ends]
        for v in by_length:
            self.ends[v] = [(k, e, self.length[v]) for k, e in sorted(ends[v])]
            self.ends[v] += [x for x in self.ends[self.link[v]] if x[:2] not in ends[v]]

    def _clone(self, p: int, q: int, c: int) -> int:
        r = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        self.link[q] = r
        return r

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # already there, from an earlier sequence
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def _steps(self, tokens: list[int]):
        """(depth, state) after each token."""
        state = depth = 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                depth = self.length[state]
            if c in self.next[state]:
                state, depth = self.next[state][c], depth + 1
            else:
                state = depth = 0
            yield depth, state

    def matches(self, tokens: list[int], least: int):
        """Maximal matches of at least ``least`` tokens in any sequence: (start, length, sequence, start in it)."""
        last = (0, 0)
        for i, (depth, state) in enumerate(self._steps(tokens)):
            if depth <= last[0] and last[0] >= least:
                yield self._match(i, *last)
            last = depth, state
        if last[0] >= least:
            yield self._match(len(tokens), *last)

    def all_matches(self, tokens: list[int], least: int):
        """Maximal matches of at least ``least`` tokens with each place of each sequence, in order of
        their ends: (start, length, sequence, start in it)."""
        for i, (depth, state) in enumerate(self._steps(tokens), 1):
            if depth < least:
                continue
            c = tokens[i] if i < len(tokens) else None
            for k, e, longest in self.ends[state]:
                n, seq = min(depth, longest), self.sequences[k]
                if n >= least and (c is None or e == len(seq) or seq[e] != c):
                    yield i - n, n, k, e - n

    def _match(self, end: int, depth: int, state: int) -> tuple[int, int, int, int]:
        k, e = self.place[state]
        return end - depth, depth, k, e - depth


def chain(matches: list[tuple[int, int, int]], max_gap: int, least: float) -> list[tuple[int, int, int]]:
    """Best chains of one template's matches (start, length, start in it): (covered tokens, first, end).

    In a chain the matches follow in text and template, at most ``max_gap`` tokens apart in the
    text; what overlaps is cut from the later one.  The chain of most tokens is taken, the
    matches are cut to the text beside it, and so on while a chain has ``least`` tokens."""
    at = sorted((s + n, n, p + n) for s, n, p in matches)  # by ends; cuts keep this order
    if not at:
        return []
    widest = max(n for _, n, _ in at)
    reach = (max_gap + 1) * max(q for _, _, q in at) + max_gap  # text that a chain can span
    best: list[tuple[int, int]] = [(0, 0)] * len(at)  # most tokens of a chain that ends here, and its latest start
    heap: list[tuple[int, int, int, int]] = []

    def fill(j: int) -> None:
        end, n, q = at[j]
        if n <= 0:  # taken
            return
        top, i = (n, end - n), j - 1
        while i >= 0 and end - n - at[i][0] <= max_gap:
            e, m, r = at[i]
            left = min(n, end - e, q - r)  # tokens left behind the other match
            if m > 0 and left > 0 and end - left - e <= max_gap:
                top = max(top, (best[i][0] + left, best[i][1]))
            i -= 1
        best[j] = top
        if top[0] >= least:
            heapq.heappush(heap, (-top[0], end, -top[1], j))

    for j in range(len(at)):
        fill(j)
    out = []
    while heap:
        cover, end, first, j = heapq.heappop(heap)
        cover, first = -cover, -first
        if at[j][1] <= 0 or at[j][0] != end or best[j] != (cover, first):
            continue  # of before a cut
        out.append((cover, first, end))
        low = bisect.bisect_right(at, (first, widest, reach))
        high = bisect.bisect_right(at, (end + max(reach, widest), widest, reach))
        for i in range(low, high):
            e, n, q = at[i]
            if e > end:
                at[i] = e, min(n, e - end), q
            elif e - n < first:
                at[i] = first, n - (e - first), q - (e - first)
            else:
                at[i] = first, 0, q
        for i in range(low, high):
            fill(i)
    return sorted(out, key=lambda c: c[1:])


class Scanner:
    """Scans one text: base places, and chained spans of templates."""

    def __init__(self, phrases, templates, min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases]
        self.labels = [label for label, _ in templates]
        words = [t.encode().split() for _, t in templates]
        self.ids: dict[bytes, int] = {}
        for w in (*[w for t in words for w in t], *[w for p, _ in self.phrases for w in p]):
            self.ids.setdefault(w, len(self.ids))
        self.sizes = [len(t) for t in words]
        self.automaton = SuffixAutomaton([[self.ids[w] for w in t] for t in words])
        self.base = [(tuple(self.ids[w] for w in p), label) for p, label in self.phrases]

    def scan(self, text: str | None):
        """(n_words, places [(start, label)], spans [(label, first, end, coverage)])."""
        words = WORDS.findall(text.encode().lower()) if text else []
        get = self.ids.get
        known = [get(w, -1) for w in words]
        places, found = [], []
        i, n = 0, len(known)
        while i < n:  # runs of known words; a match cannot cross an unknown one
            if known[i] < 0:
                i += 1
                continue
            j = i + 1
            while j < n and known[j] >= 0:
                j += 1
            if j - i >= 2:
                run = known[i:j]
                for p, label in self.base:
                    m = len(p)
                    places += [(i + k, label) for k in range(j - i - m + 1) if run[k] == p[0] and tuple(run[k:k + m]) == p]
                if j - i >= self.min_match:
                    found += [(i + s, m, k, at) for s, m, k, at in self.automaton.all_matches(run, self.min_match)]
            i = j
        of: dict[int, list[tuple[int, int, int]]] = {}
        for s, m, k, at in found:
            of.setdefault(k, []).append((s, m, at))
        spans = [(self.labels[k], first, end, cover / self.sizes[k]) for k in sorted(of)
                 for cover, first, end in chain(of[k], self.max_gap, self.min_cover * self.sizes[k])]
        return len(words), sorted(places), spans


def scan_licenses(docs: DataFrame, phrases=BASE_PHRASES, templates=TEMPLATES, min_match: int = 4,
                  max_gap: int = 12, min_cover: float = 0.6) -> DataFrame:
    """(doc_id, n_words, places, spans): phrase places and covered template spans of each text.

    ``min_match``: shortest match kept; ``max_gap``: tokens allowed between chained
    matches; ``min_cover``: share of a template that a span must cover.
    """
    kept: list[Scanner] = []

    def run(batches):
        if not kept:
            kept.append(Scanner(phrases, templates, min_match, max_gap, min_cover))
        scan = kept[0].scan
        place = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"start": s, "label": x} for s, x in r[1]] for r in rows], place),
                pa.array([[dict(zip(("label", "first", "end", "coverage"), x)) for x in r[2]] for r in rows], span)],
                names=["doc_id", "n_words", "places", "spans"])

    rows = checked_columns(docs, ["doc_id", "text"])
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, "
                                "places array<struct<start:long,label:string>>, "
                                "spans array<struct<label:string,first:long,end:long,coverage:double>>")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    names = "array_join(array_sort(array_distinct({})), ',')"
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(places) as long) AS n_base",
        "array_min(transform(places, x -> x.start)) AS first_word",
        "array_max(transform(places, x -> x.start)) AS last_word",
        names.format("transform(places, x -> x.label)") + " AS base_labels",
        names.format("concat(transform(places, x -> x.label), transform(spans, x -> x.label))") + " AS labels",
        "coalesce(array_max(transform(spans, x -> x.coverage)), if(size(places) > 0, 0.5D, 0.0D)) AS score")
