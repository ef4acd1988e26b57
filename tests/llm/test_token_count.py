import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import token_count
from tessella.llm.queries import op7_token_count, tokenizer

from .helpers import CLASHING, DATA, ODD, clashing, empty_docs, needs_data, odd_docs, same_columns

PATH = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ranks():
    return token_count.Ranks(PATH)


TEXTS = st.text(max_size=60) | st.text("aeiou stlnr▁ \n09.,<s>/unk", max_size=80) | st.lists(st.sampled_from(["<s>", "</s>", "<unk>", "<0x0A>", " the", "▁", "▁▁", "  ", "　", "é", "漢", "😀", "\0", "ﬁ"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_as_the_library_does(ranks, library, text):
    assert ranks.counts([text]) == [len(library.encode(text))]


def test_long_words(ranks, library):
    for text in ("a" * 5000, "abcde" * 999, "_" * 3000, "é" * 2000):
        assert ranks.counts([text]) == [len(library.encode(text))]


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x12\x02\x18\x01")  # a trainer of another kind
    with pytest.raises(ValueError):
        token_count.Ranks(str(tmp_path / "m"))


def test_odd_tables(spark, library):
    rows = token_count.count_column(odd_docs(spark), PATH, limit=100).collect()
    assert sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == sorted((len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for _, t, *_ in ODD)
    assert token_count.count_column(empty_docs(spark), PATH).count() == 0
    assert same_columns(token_count.count_column(clashing(odd_docs(spark)), PATH), [c for c in CLASHING if c != "n_tokens"])


@needs_data
def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op7_token_count(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
