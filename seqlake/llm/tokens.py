"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are split at safe boundaries, where the vocabulary's pre-tokenizer
always starts a new piece, so that the counts of the parts add up to the
count of the whole. Arrow batches are cut into runs of about BATCH_BYTES.
Parts that were seen before on the same worker aren't encoded again.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows
and repeated ids give a row each; a null id stays null; an empty table gives
an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import documents, runs_by_bytes, spread, text_bytes

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
BATCH_BYTES = 4 << 20
#: Distinct parts that a worker remembers, and the longest one it remembers.
MEMORY_PARTS, MEMORY_CHARS = 600_000, 48

#: A blank between two visible characters always starts a piece of the byte-level pattern ...
_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: ... and so do a lone line break between visible characters, and a mark that ends a word.
_BREAK = re.compile(r"(?<=\S)\n(?=\S)")
_MARK = re.compile(r"(?<=[A-Za-z])([.,])(?=[ \n])")
_CUT = "\x01"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per worker, without truncation or padding."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def split_safely(text: str) -> list[str]:
    """Parts of a text whose token counts add up to its own."""
    if _CUT in text:
        return [text]
    text = _BLANK.sub(_CUT + " ", text)
    if "\n" in text:
        text = _BREAK.sub(f"{_CUT}\n{_CUT}", text)
    return _MARK.sub(_CUT + r"\1", text.replace(_CUT + " ", " " + _CUT)).replace(" " + _CUT, _CUT + " ").split(_CUT)


class PartLengths(dict):
    """Part -> number of tokens; parts that are missing are encoded together."""

    def __init__(self, path: str):
        super().__init__()
        self.path = path

    def count(self, texts: list[str]) -> list[int]:
        if len(self) > MEMORY_PARTS:
            self.clear()
        parts = [split_safely(x) for x in texts]
        missing = list({p for own in parts for p in own if p not in self})
        for p, done in zip(missing, tokenizer(self.path).encode_batch_fast(missing, add_special_tokens=False)):
            self[p] = len(done)
        got = [sum(map(self.__getitem__, own)) for own in parts]
        for p in missing:
            if len(p) > MEMORY_CHARS:
                del self[p]
        return got


_lengths: dict[str, PartLengths] = {}


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, for every row."""

    def counts(batches):
        known = _lengths.setdefault(path, PartLengths(path))
        for batch in batches:
            texts = batch.column(1)
            data, offsets = text_bytes(texts)
            n_tokens = np.zeros(len(texts), dtype=np.int64)
            for a, b in runs_by_bytes(offsets, BATCH_BYTES):
                n_tokens[a:b] = known.count([x or "" for x in texts.slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(counts, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), default_path(VOCABULARY))
