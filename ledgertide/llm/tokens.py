"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgertide.operators.storage import written

#: Rank file of the vocabulary and the pattern that cuts a text into the stretches BPE works on (fixed value).
VOCABULARY = os.environ.get("LEDGERTIDE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of so many distinct words are remembered in a task, then forgotten; only speed depends on it.
REMEMBERED = 300_000


class _Counts(dict):
    """Tokens of a word with the space before it, computed once per word."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(" " + word))
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that gives the number of tokens of a text, special tokens being ordinary text.

    The pattern never joins what stands before a single space with what follows it, so the count of a
    text is the sum of the counts of its words, each with its space. Runs of two or more spaces are cut
    otherwise; a text that holds one is encoded as a whole.
    """
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known = _Counts(encode)

    def count(text: str) -> int:
        if "  " in text:
            return len(encode(text))
        first, *rest = text.split(" ")
        return len(encode(first)) + sum(map(known.__getitem__, rest))

    return count


def with_tokens(df: DataFrame, text: str, name: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` but with its number of tokens as ``name`` (0 for null and empty texts)."""
    others = [c for c in df.columns if c != text]
    schema = df.select(*others, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            n = pa.array([count(t) if t else 0 for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], n], names=[*others, name])

    return df.mapInArrow(run, schema)


def sizes_of(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``row_id`` and ``n_tokens`` in place of ``text``, written so that no text is read twice."""
    return written(with_tokens(df.withColumn("row_id", F.monotonically_increasing_id()), text, "n_tokens", vocabulary), "sizes")
