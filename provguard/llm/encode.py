"""Token ids of whole Arrow batches, with each distinct piece of text encoded once.

Texts are cut at safe boundaries, where a byte-level pre-tokenizer always starts a new piece:
before a single space and on both sides of a single line feed between two characters that are
not white space, and before an ASCII mark that follows an ASCII letter or digit (not the bar,
which stands so inside a special string; no special string holds white space).  So the pieces'
ids, laid end to end, are the whole text's.  Bytes that may belong to white space beyond ASCII
make no boundary.

Pieces are named by a 64-bit hash of their bytes and length.  Those a worker has seen
come from its table; new ones go to the tokenizer in batches of bounded bytes.  The table
holds about ``TABLE_BYTES`` of pieces, none above ``LONG_PIECE`` bytes, and starts anew when it
is full.  Texts are worked through ``BLOCK`` bytes at a time, so memory does not follow the
length of a text, but for one piece without any safe boundary, which is encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from .common import U64, span_hashes

BLOCK = 4 << 20
LONG_PIECE = 256
TABLE_BYTES = 64 << 20
# First bytes of characters among which there is white space: U+0085, U+00A0, U+1680, U+2000 on, U+3000.
MAY_BE_SPACE = np.zeros(256, bool)
MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
PLAIN = np.zeros(256, bool)  # ASCII characters that are neither white space nor controls
PLAIN[0x21:0x7F] = True
WORDLIKE = np.array([chr(b).isalnum() and b < 0x80 for b in range(256)])
MARK = PLAIN & ~WORDLIKE
MARK[ord("|")] = False


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def safe_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of all pieces: of each text that is not empty, and every safe boundary."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 2:
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        white = np.flatnonzero((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) + 1
        before, after = data[white - 1], data[white + 1]
        wide = (before >= 0x80) & ~MAY_BE_SPACE[data[np.maximum(white - 2, 0)]] & ~MAY_BE_SPACE[data[np.maximum(white - 3, 0)]]
        ok = (PLAIN[before] | wide) & (PLAIN[after] | (after >= 0x80) & ~MAY_BE_SPACE[after])
        white = white[ok & ~edge[white] & ~edge[white + 1]]
        start[white] = True
        start[white[data[white] == 0x0A] + 1] = True
        mark = np.flatnonzero(MARK[data[1:]] & WORDLIKE[data[:-1]]) + 1
        start[mark[~edge[mark]]] = True
    start[off[:-1]] = True
    return np.flatnonzero(start[:-1])


class Encoder:
    """Ids of texts by a ``tokenizers`` vocabulary whose pieces part at safe boundaries."""

    def __init__(self, vocabulary: str, table_bytes: int = TABLE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.line, = self.tok.encode("\n", add_special_tokens=False).ids
        self.table_bytes = table_bytes
        self.clear()

    def clear(self):
        self.known, self.slot = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.ptr, self.bytes = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of new pieces, handed to the tokenizer about 256 kB at a time.

        Pieces without a line feed that open with one space at most and do not end in white space
        go in one text, joined by line feeds: there each line feed is a token of its own and parts
        the rest as before.  The others go one by one."""
        out, at, size = [None] * len(texts), [], 0
        alone = [i for i, t in enumerate(texts) if t[-1].isspace() or "\n" in t or t[0].isspace() and (t[0] != " " or t[1].isspace())]
        single = set(alone)
        for i, t in enumerate(texts):
            if i not in single:
                at.append(i)
                size += len(t)
            if size >= 1 << 18 or i + 1 == len(texts):
                if at:
                    ids = np.array(self.tok.encode_batch_fast(["\n".join([texts[k] for k in at])], add_special_tokens=False)[0].ids, np.uint32)
                    line = np.flatnonzero(ids == self.line)
                    for k, a, z in zip(at, [0, *(line + 1).tolist()], [*line.tolist(), len(ids)], strict=True):
                        out[k] = ids[a:z]
                at, size = [], 0
        for k in range(0, len(alone), 1000):
            for i, x in zip(alone[k:k + 1000], self.tok.encode_batch_fast([texts[i] for i in alone[k:k + 1000]], add_special_tokens=False)):
                out[i] = np.array(x.ids, np.uint32)
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate([*out, np.zeros(0, np.uint32)]), lengths

    def _block(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of pieces that stand one after another."""
        base, raw = int(s[0]), data[s[0]:e[-1]].tobytes()
        if len(s) == 1:
            return self._encode([raw.decode()])
        h, first, which = np.unique(span_hashes(data[s[0]:e[-1]], s - base, e - base), return_index=True, return_inverse=True)
        if self.bytes > self.table_bytes:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        at_new = first[~old]
        new, lengths = self._encode([raw[a:z].decode() for a, z in zip((s[at_new] - base).tolist(), (e[at_new] - base).tolist())])
        ids = np.concatenate([self.ids, new])
        ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(lengths)])
        slots = np.empty(len(h), np.int64)
        if old.any():
            slots[old] = self.slot[at[old]]
        slots[~old] = len(self.ptr) - 1 + np.arange(len(lengths))
        piece = slots[which]
        n = ptr[piece + 1] - ptr[piece]
        end = np.cumsum(n)
        out = ids[np.repeat(ptr[piece] - (end - n), n) + np.arange(int(end[-1]))]
        size = e[at_new] - s[at_new]
        short = size <= LONG_PIECE
        if short.all():
            self.ids, self.ptr = ids, ptr
            keys, kept = h[~old], slots[~old]
        else:
            self.ids = np.concatenate([self.ids, new[np.repeat(short, lengths)]])
            kept = len(self.ptr) - 1 + np.arange(int(short.sum()))
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(lengths[short])])
            keys = h[~old][short]
        self.bytes += int(size[short].sum()) + 24 * len(keys)
        place = np.searchsorted(self.known, keys)
        self.known, self.slot = np.insert(self.known, place, keys), np.insert(self.slot, place, kept)
        return out, n

    def _blocks(self, data: np.ndarray, s: np.ndarray):
        """(ids, ids of each piece) of the pieces that start at ``s``, block by block."""
        e = np.append(s[1:], len(data))
        i = 0
        while i < len(s):  # at least one piece, else up to BLOCK bytes
            j = max(i + 1, int(np.searchsorted(e, s[i] + BLOCK, "right")))
            yield self._block(data, s[i:j], e[i:j])
            i = j

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts as bytes and n+1 offsets -> all their ids and n+1 offsets into them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        s = safe_starts(data, off)
        ids, counts = zip(*self._blocks(data, s))
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), total[np.searchsorted(s, off)]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Number of ids of each text; no block's ids outlive it."""
        if not len(data):
            return np.zeros(len(off) - 1, np.int64)
        s = safe_starts(data, off)
        total = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in self._blocks(data, s)]))])
        return np.diff(total[np.searchsorted(s, off)])


_LOADED: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, loaded once."""
    if vocabulary not in _LOADED:
        _LOADED[vocabulary] = Encoder(vocabulary)
    return _LOADED[vocabulary]
