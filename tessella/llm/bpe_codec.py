"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The lexicon holds the most frequent words of the corpus and their id sequences.  Each task counts the
words of its texts and sends its TASK_WORDS most frequent ones, so what is shuffled grows with the tasks
and not with the text; a word that is frequent nowhere may be missing, which costs its merges only.  It is a minimal acyclic automaton: words share prefixes and suffixes, arcs carry integer
outputs whose sum along a word is the word's row in a table of id sequences.  The arrays are one file in
the shared folder, which Spark hands to each executor that needs it; the Python workers there
memory-map it and so share its pages.  Words that the lexicon lacks are merged exactly by merge rank.
Decoding joins the bytes of the ids.

Defined cases: null is an empty text, which has no ids and decodes to an empty text; the special
string of the vocabulary becomes its id wherever it stands in a text, as the library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, map_arrow, named, shared_path, stash, steps, text_of

#: Words in the lexicon.  They only make encoding faster; any number gives the same ids.
LEXICON_WORDS = 1 << 16
#: Words that a task sends, and that it counts at once (half of them stay when there are more).
TASK_WORDS, HELD_WORDS = 1 << 15, 1 << 19
#: Merged words that a worker remembers, and the characters of the longest that is counted or remembered.
MEMO_WORDS, LONGEST = 300_000, 32

#: The pattern of byte-level BPE with the classes of the code points below U+0250 written out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
NEVER = 1 << 62
BEYOND = re.compile("[^\0-ɏ]")


def split_words(text: str) -> list[str]:
    """The words of a text, in order; they join to the text.

    Texts with code points from U+0250 on are split by the library, since which of those are letters
    depends on the Unicode version of its pattern engine.
    """
    if BEYOND.search(text):
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
    return LATIN.findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merge ranks and bytes of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        raw = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw |= {i: s.encode() for s, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        #: By both ids in one number: the rank and the id of the joined token in one number, so the least is the next merge.
        self.merge = {ids[a] << 24 | ids[b]: rank << 24 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        size = max(raw) + 1
        self.length = np.array([len(raw.get(i, b"")) for i in range(size)], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(size)), np.uint8)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: the leftmost pair of lowest rank is joined until no pair has a rank."""
        first = self.first
        out = [first[b] for b in word]
        if len(out) > 48:
            return self._merged_long(out)
        get = self.merge.get
        ranks = [get(a << 24 | b, NEVER) for a, b in zip(out, out[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            at = ranks.index(best)
            out[at] = new = best & 0xFFFFFF
            del out[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(out[at - 1] << 24 | new, NEVER)
            if at < len(ranks):
                ranks[at] = get(new << 24 | out[at + 1], NEVER)
        return out

    def _merged_long(self, out: list[int]) -> list[int]:
        """The same with a heap, for words whose square would take long."""
        n, get = len(out), self.merge.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, out[i] << 24 | out[i + 1]) for i in range(n - 1) if (r := get(out[i] << 24 | out[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = right[i]
            if out[i] < 0 or j < 0 or out[i] << 24 | out[j] != pair:
                continue
            out[i], out[j] = best & 0xFFFFFF, -1
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := get(key := out[x] << 24 | out[y])) is not None:
                    heapq.heappush(heap, (r, x, key))
        return [x for x in out if x >= 0]


def build_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of entries, as the bytes of its file.

    Words come in order, so a state is final for all words to come as soon as the next word leaves
    its path; it is then replaced by an equal state if there is one, which makes the automaton
    minimal.  The output of an arc is the number of words that leave its state before it.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    final: list[bool] = []
    count: list[int] = []

    def settled(state: tuple[list, bool]) -> int:
        key = (tuple(state[0]), state[1])
        if (known := register.get(key)) is None:
            known = register[key] = len(arcs)
            arcs.append(state[0])
            final.append(state[1])
            count.append(state[1] + sum(count[to] for _, to in state[0]))
        return known

    path: list[list] = [[[], False]]
    before = b""
    for word in words:
        same = len(os.path.commonprefix([before, word]))
        for depth in range(len(before), same, -1):
            to = settled(tuple(path.pop()))
            path[-1][0].append((before[depth - 1], to))
        path += [[[], False] for _ in word[same:]]
        path[-1][1] = True
        before = word
    for depth in range(len(before), 0, -1):
        to = settled(tuple(path.pop()))
        path[-1][0].append((before[depth - 1], to))
    root = settled(tuple(path.pop()))
    keys, targets, outputs = [], [], []
    for state, out in enumerate(arcs):
        passed = int(final[state])
        for byte, to in out:
            keys.append(state << 8 | byte)
            targets.append(to)
            outputs.append(passed)
            passed += count[to]
    ids = [entries[w] for w in words]
    parts = [
        np.array([root, len(keys), len(final), len(ids), sum(map(len, ids))], np.int32),
        np.array([k >> 8 for k in keys], np.int32), np.array([k & 255 for k in keys], np.int32), np.array(targets, np.int32), np.array(outputs, np.int32), np.array(final, np.int32),
        np.cumsum([0, *map(len, ids)]).astype(np.int32), np.array([x for y in ids for x in y], np.int32),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The memory-mapped automaton."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            view = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int32)
        self.root, arcs, self.states, words, ids = map(int, view[:5])
        state, byte, self.to, self.out, self.final, self.start, self.ids = np.split(view[5:], np.cumsum([arcs, arcs, arcs, arcs, self.states, words + 1]))
        #: Arcs in order of state and byte.
        self.keys = state.astype(np.int64) << 8 | byte

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, -1 for a word that is not in the lexicon.  All words walk at once, a byte a step."""
        n = len(words)
        row = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return row
        length = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(length) - length
        blob = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        live, state, total = np.arange(n), np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        depth = 0
        while len(live):
            done = length[live] == depth
            if done.any():
                ends = live[done]
                ok = self.final[state[done]] == 1
                row[ends[ok]] = total[done][ok]
                live, state, total = live[~done], state[~done], total[~done]
            key = state << 8 | blob[start[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, state, total = live[ok], self.to[at[ok]].astype(np.int64), total[ok] + self.out[at[ok]]
            depth += 1
        return row


def gathered(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + length[i]] for all i, joined."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return values[shift + np.arange(total)]


class Codec:
    """Encodes and decodes texts in one worker."""

    def __init__(self, path: str, lexicon: str) -> None:
        self.vocabulary, self.lexicon = Vocabulary(path), Lexicon(lexicon)
        self.memo: dict[bytes, list[int]] = {}

    def _unseen(self, word: bytes) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            ids = self.vocabulary.merged(word)
            if len(word) <= 4 * LONGEST:
                self.memo[word] = ids
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts joined, and the number of ids of each text."""
        number: dict[str, int] = {}
        index: list[int] = []
        per_text = []
        special = self.vocabulary.special
        for text in texts:
            at = len(index)
            whole = not special or not any(s in text for s in special)
            for part in [text] if whole else self.vocabulary.cut.split(text):
                if not whole and part in special:
                    index.append(number.setdefault(f"\0{part}", len(number)))
                else:
                    index += [number.setdefault(w, len(number)) for w in split_words(part)]
            per_text.append(len(index) - at)
        words = [w.encode() for w in number]
        row = self.lexicon.rows(words)
        start = self.lexicon.start[row].astype(np.int64)
        length = self.lexicon.start[row + 1] - start
        extra: list[int] = []
        base = len(self.lexicon.ids)
        for i in np.flatnonzero(row < 0).tolist():
            word = words[i]
            name = word[1:].decode() if word[:1] == b"\0" else ""
            ids = [special[name]] if name in special else self._unseen(word)
            start[i], length[i] = base + len(extra), len(ids)
            extra += ids
        table = np.concatenate([self.lexicon.ids, np.array(extra, np.int64)])
        at = np.array(index, np.int64)
        counts = np.array(per_text, np.int64)
        ends = np.concatenate([[0], np.cumsum(length[at])])
        upto = np.concatenate([[0], np.cumsum(counts)])
        return gathered(table, start[at], length[at]), ends[upto[1:]] - ends[upto[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids.  Bytes that aren't UTF-8 become U+FFFD."""
        v = self.vocabulary
        blob = gathered(v.blob, v.start[ids], v.length[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(v.length[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        return [blob[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _kept(counts: Counter, most: int) -> Counter:
    """The most frequent words, less the count of the first that goes (Misra and Gries 1982): no word is counted
    too often, and none too low by more than all counts divided by ``most``."""
    top = counts.most_common(most + 1)
    less = top[most][1] if len(top) > most else 0
    return Counter({w: n - less for w, n in top if n > less})


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most ``words``, between spaces and line ends.

    The driver gets a histogram of the counts, and then only the words of the lexicon.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for cell in batch.column(0):
                found = cell.as_py().split()
                if found and len(max(found, key=len)) > LONGEST:
                    found = [w for w in found if len(w) <= LONGEST]
                counts.update(found)
                if len(counts) > HELD_WORDS:
                    counts = _kept(counts, HELD_WORDS // 2)
        top = [(w, n) for w, n in counts.most_common(TASK_WORDS) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    counts = stash(docs.select(text_of().alias("text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    # How many words are how frequent (in at most a thousand steps), then those above the step that fits.
    step = F.when(F.col("n") < 500, F.col("n")).otherwise(F.least(F.lit(1000), 500 + F.floor(20 * F.log2(F.col("n") / 500)))).cast("int")
    least, total = 1001, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if total + r["count"] > words:
            break
        least, total = r.step, total + r["count"]
    return [r.w for r in counts.where(step >= least).select("w").orderBy("w").limit(words).collect()]


def corpus_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> bytes:
    """The lexicon of a corpus."""
    vocabulary = Vocabulary(path)
    entries: dict[bytes, list[int]] = {}
    for text in frequent_words(docs, words):
        first, *rest = split_words(" " + text)
        for w in (first, first[1:], *rest):
            entries.setdefault(w.encode(), [])
    entries.pop(b"", None)
    for w in entries:
        entries[w] = vocabulary.merged(w)
    return build_lexicon(entries)


def shipped(spark: SparkSession, blob: bytes) -> str:
    """Puts bytes into the shared folder, from which Spark hands them to each executor.  Returns the name
    under which workers find the file."""
    path = shared_path(spark, "lexicon")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(blob))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


ENCODED = "ids array<int>, decoded string"


def encode_column(docs: DataFrame, path: str, words: int = LEXICON_WORDS, finish=None, schema: str = ENCODED, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with what ``finish`` makes of the ids and decoded texts.

    finish(ids, counts, decoded) returns the arrays of the columns in ``schema``; without it these
    are the ids and the decoded text.  A column of docs with the name of a new one is replaced.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    lexicon = shipped(spark, corpus_lexicon(docs, path, words))
    make = finish or (lambda ids, counts, decoded: [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())])
    new = spark.createDataFrame([], schema).schema
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name.lower() for f in new}]
    source = docs.select(*named(kept), text_of().alias(fresh(docs, "text")))
    out = docs.select(*named(kept)).schema
    for field in new:
        out = out.add(field)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path, SparkFiles.get(lexicon))
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in steps(texts):
                ids, counts = codec.encode(texts[a:b])
                made = make(ids, counts, codec.decode(ids, counts))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], *made], [f.name for f in out])

    return map_arrow(source, run, out)


def digests(ids: np.ndarray, counts: np.ndarray, decoded: list[str]) -> list[pa.Array]:
    """n_tokens, ids_sha256 and decoded_sha256."""
    flat = ids.astype("<u4")
    ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
    sha = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
    return [pa.array(counts, pa.int64()), pa.array(sha), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
