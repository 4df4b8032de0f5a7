"""Encoding of whole texts with a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_automaton import TokenAutomaton, load_byte_bpe

#: Where the vocabulary files lie; a parameter of every function below.
TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the pre-splitting pattern of the byte_bpe_50k vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank beside other white space: there, cutting at blanks could differ from the pattern.
UNEVEN = regex.compile(r" \s|\s |^\s| $")


class _Known(dict):
    """Ids by stretch of text; forgets everything when it grows beyond its bound."""

    def __init__(self, automaton: TokenAutomaton, prefix: str, bound: int = 300_000):
        super().__init__()
        self.automaton, self.prefix, self.bound = automaton, prefix, bound

    def __missing__(self, text: str) -> tuple[int, ...]:
        encode = self.automaton.encode
        ids = tuple(chain.from_iterable(encode(w.encode()) for w in WORDS.findall(self.prefix + text)))
        if len(text) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Pre-splits texts and encodes the words with the automaton.

    A single blank between two other characters always begins a new word of the pattern, so
    texts without uneven white space are cut at blanks first and known stretches looked up.
    """

    def __init__(self, automaton: TokenAutomaton):
        self.whole, self.after_blank = _Known(automaton, ""), _Known(automaton, " ")

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if UNEVEN.search(text):
            return list(chain.from_iterable(map(self.whole.__getitem__, WORDS.findall(text))))
        first, *rest = text.split(" ")
        out = list(self.whole[first]) if first else []
        out.extend(chain.from_iterable(map(self.after_blank.__getitem__, rest)))
        return out


def decode(automaton: TokenAutomaton, ids: list[int]) -> str:
    """The text whose bytes the labels spell."""
    return b"".join(map(automaton.spelling().__getitem__, ids)).decode("utf-8", errors="replace")


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", directory: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, ids) of every row; ids is an empty list for an empty and for a null text.

    The compiled vocabulary (fixed size, some 50,000 merges) is broadcast; the rows are never
    shuffled. Repeated rows come out as often as they go in; other columns are left out, so
    clashing names do no harm. An empty table gives an empty table.
    """
    automaton = df.sparkSession.sparkContext.broadcast(load_byte_bpe(f"{directory}/{vocabulary}"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(automaton.value)
        for batch in batches:
            ids = [encoder.ids(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
