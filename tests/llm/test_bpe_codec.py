import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe_codec
from tessella.llm.queries import op1_bpe_codec, tokenizer

from .helpers import CLASHING, DATA, ODD, clashing, empty_docs, needs_data, odd_docs, same_columns

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def codec(tmp_path_factory):
    vocabulary = bpe_codec.Vocabulary(PATH)
    words = [b" the", b"the", b" of", b" ofs", b" word", b"word", " é".encode()]
    path = tmp_path_factory.mktemp("lexicon") / "x"
    path.write_bytes(bpe_codec.build_lexicon({w: vocabulary.merged(w) for w in words}))
    return bpe_codec.Codec(PATH, str(path))


TEXTS = st.text(max_size=60) | st.text("aeiou stlnr'\n\t 09.,!<|>endoftx", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", " the", "the ", "of", "'s", "'ll ", "　", "\xa0", "é", "ǅ", "٣", "½", "\r\n", "  "]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_as_the_library_does(codec, library, texts):
    ids, counts = codec.encode(texts)
    decoded = codec.decode(ids, counts)
    at = 0
    for text, n, back in zip(texts, counts.tolist(), decoded, strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == wanted
        assert back == library.decode(wanted, skip_special_tokens=False) == text
        at += n


@pytest.mark.parametrize("n", [49, 200, 5000])
def test_long_words(codec, library, n):
    random.seed(n)
    text = "".join(random.choice("abcdeé") for _ in range(n))
    ids, _ = codec.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_automaton_is_minimal_and_ordered(tmp_path):
    words = sorted({("ab"[i & 1] + "cd"[i >> 1 & 1] + "ing"[: i % 4]).encode() for i in range(16)})
    path = tmp_path / "x"
    path.write_bytes(bpe_codec.build_lexicon({w: [k, k + 1] for k, w in enumerate(words)}))
    lexicon = bpe_codec.Lexicon(str(path))
    assert lexicon.rows([*words, b"zz", b"", b"abc", b"acingx"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    # The states differ in the sets of words that lead from them to an end.
    trie = {w[:i] for w in words for i in range(len(w) + 1)}
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in trie}
    assert lexicon.states == len(rights)


def test_empty_lexicon(tmp_path, library):
    path = tmp_path / "x"
    path.write_bytes(bpe_codec.build_lexicon({}))
    ids, counts = bpe_codec.Codec(PATH, str(path)).encode(["the end", ""])
    assert ids.tolist() == library.encode("the end").ids and counts.tolist() == [len(ids), 0]


def test_odd_tables(spark, library):
    rows = bpe_codec.encode_column(odd_docs(spark), PATH).collect()
    assert len(rows) == len(ODD)
    texts = {(r.doc_id, r.n_chars): r for r in rows}
    for doc, text, _, _, n in ODD:
        r = texts[doc, n]
        assert r.decoded == (text or "") and r.ids == library.encode(text or "").ids
    assert bpe_codec.encode_column(empty_docs(spark), PATH).count() == 0
    out = bpe_codec.encode_column(clashing(odd_docs(spark)), PATH)
    assert same_columns(out, [c for c in CLASHING if c not in ("ids", "decoded")])


def test_lexicon_size_changes_nothing(spark):
    docs = odd_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    found = [{r.doc_id: r.ids for r in bpe_codec.encode_column(docs, PATH, words=n).collect()} for n in (0, 3, 1000)]
    assert found[0] == found[1] == found[2]


@needs_data
def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    import hashlib

    rows = op1_bpe_codec(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_frequent_words_of_tasks(spark, monkeypatch):
    """Counts are of all texts; with room for fewer words, the frequent ones stay."""
    rows = [(f"often often often rare{i} " + "y" * 40,) for i in range(600)] + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "text string").repartition(3)
    assert bpe_codec.frequent_words(docs) == ["often"]
    monkeypatch.setattr(bpe_codec, "HELD_WORDS", 20)
    assert bpe_codec.frequent_words(docs) == ["often"]
    kept = bpe_codec._kept(bpe_codec.Counter({"a": 9, "b": 5, "c": 2, "d": 1}), 2)
    assert kept == {"a": 7, "b": 3}
