"""Token counts: Arrow batches go to the tokenizer, only lengths come back.

A byte-level vocabulary counts by pieces (``encode``): texts are split at safe boundaries, where the
tokenizer starts a new piece anyway, so the pieces' counts add up to the whole text's, and no
piece of a long text is long unless it has no boundary.  The pieces of a whole Arrow batch
are taken together and dealt into blocks of bounded bytes, whatever texts they come from; each distinct
piece of a block goes to the tokenizer once, and short ones are kept in a table of
bounded bytes (``table_bytes``) for each Python worker.

A vocabulary whose model crosses spaces is not split (sentencepiece and word_bpe): there whole
texts make batches of about ``batch_bytes`` bytes.

Defined cases: null or empty text has 0 bytes and 0 tokens; a text or a stretch of it without a
safe boundary is encoded whole; rows repeat as they are; an empty table gives no rows; extra
columns are ignored.  Strings of special tokens inside texts follow the library's default.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import checked_columns, map_arrow, slices, text_bytes
from .encode import TABLE_BYTES, Encoder, vocabulary_path

_LOADED: dict[tuple, object] = {}


def _whole(name: str):
    """texts -> token counts of whole texts."""
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary_path(name))
    tok.no_truncation()
    tok.no_padding()
    return lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _loaded(*key):
    """The worker's encoder for (vocabulary, table_bytes), or its whole-text counter for (vocabulary,)."""
    if key not in _LOADED:
        _LOADED[key] = _whole(*key) if len(key) == 1 else Encoder(*key)
    return _LOADED[key]


def encode_by_bytes(encode, texts: list[str], sizes: np.ndarray, batch_bytes: int) -> np.ndarray:
    """Token counts of texts of ``sizes`` bytes, handed over in batches of about ``batch_bytes``."""
    out: list[int] = []
    at = weight = 0
    for i, n in enumerate(sizes.tolist()):
        weight += n
        if weight >= batch_bytes:
            out += encode(texts[at:i + 1])
            at, weight = i + 1, 0
    return np.array(out + (encode(texts[at:]) if at < len(texts) else []), np.int64)


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024,
                 batch_bytes: int = 1 << 18, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    cut = vocabulary.startswith("byte_bpe")

    def run(batches):
        for b in slices(batches, 16 << 20):
            data, off = text_bytes(b.column(1))
            if cut:
                total = _loaded(vocabulary, table_bytes).lengths(data, off)
            else:
                total = encode_by_bytes(_loaded(vocabulary), [t or "" for t in b.column(1).to_pylist()], np.diff(off), batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()), pa.array(total), pa.array(total > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = checked_columns(docs, ["doc_id", "text"])
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, "
                                "n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import read_table
    return count_tokens(read_table(spark, sf_dir, "documents"))
