"""Token counts by byte-pair merging on a heap and a linked list.

Text is cut into words at white space (no piece of the vocabulary has its space mark anywhere but in
front, which is checked when the model is read, so no merge crosses such a cut).  Each different word
is merged once: its characters are a linked list, its adjacent pairs that the vocabulary has are a
heap by rank, and the lowest-ranked pair is joined again and again.  The count is the number of
initial symbols less the number of merges, plus the extra bytes of characters that the vocabulary
lacks.  No identifier is made.

Defined cases: null counts as an empty text, which has no tokens; strings that look like control
pieces are ordinary text; nothing is truncated.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh, map_arrow, named, steps, text_of

#: Counted words that a worker remembers, and the characters of the longest of them.
MEMO_WORDS, LONGEST = 500_000, 100
MARK = "▁"
#: A word with the spaces and marks before it, or such characters alone at the end of the text.
WORD = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protobuf message: number, and bytes or integer."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Ranks:
    """The ranks of the pieces of a model file, and its counts of words."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = f.read()
        pieces: list[tuple[float, str]] = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                if kind in (4, 5):
                    raise ValueError("models with user-defined or unused pieces are not supported")
                if kind == 1:
                    pieces.append((float(np.frombuffer(piece[2], "<f4")[0]), piece[1].decode()))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
                    raise ValueError("only byte-pair models with byte fallback are supported")
            elif number == 3:
                normalizer = dict(_fields(value))
                if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
                    raise ValueError("only models that prefix and mark spaces, and change nothing else, are supported")
        if any(MARK in piece.lstrip(MARK) for _, piece in pieces):
            raise ValueError("a piece has a space inside")
        pieces.sort(key=lambda x: -x[0])
        self.rank = {piece: k for k, (_, piece) in enumerate(pieces)}
        self.memo: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of a word whose spaces are marks already."""
        rank = self.rank
        n = len(word)
        extra = 0
        for c in word:
            if c not in rank:
                extra += len(c.encode()) - 1
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        if not heap:
            return n + extra
        heapq.heapify(heap)
        # The list: a symbol begins at i and ends before end[i]; start[j] is where the one that ends at j begins.
        end = list(range(1, n + 1))
        start = list(range(-1, n))
        push, pop = heapq.heappush, heapq.heappop
        get = rank.get
        merges = 0
        while heap:
            _, i, stop = pop(heap)
            middle = end[i]
            if middle < 0 or middle >= stop or end[middle] != stop:
                continue
            end[middle] = -1
            end[i] = stop
            start[stop] = i
            merges += 1
            if i:
                before = start[i]
                if (r := get(word[before:stop])) is not None:
                    push(heap, (r, before, stop))
            if stop < n:
                after = end[stop]
                if (r := get(word[i:after])) is not None:
                    push(heap, (r, i, after))
        return n - merges + extra

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for text in texts:
            total = 0
            if text:
                words = WORD.findall(" " + text)
                try:
                    total = sum(map(memo.__getitem__, words))
                except KeyError:
                    for w in words:
                        n = memo.get(w)
                        if n is None:
                            n = self.count(w.replace(" ", MARK))
                            if len(w) <= LONGEST:
                                memo[w] = n
                        total += n
            out.append(total)
        return out


def count_column(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in place of text; columns of docs with these names are replaced."""
    bounded_batches(docs.sparkSession)
    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    kept = [c for c in docs.columns if c.lower() not in {"text", *(f.name for f in new)}]
    schema = T.StructType([*(docs.schema[c] for c in kept), *new])
    source = docs.select(*named(kept), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias(fresh(docs, "text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        for batch in batches:
            ranks = ranks or Ranks(path)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts = [n for a, b in steps(texts) for n in ranks.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], [f.name for f in schema])

    return map_arrow(source, run, schema)
