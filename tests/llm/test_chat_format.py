import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import chat_format
from tessella.llm.queries import op8_chat_format

from .helpers import DATA, clashing, needs_data

SCHEMA = "conv_id long, turn long, role string, text string"
PIECE = st.sampled_from(["[INST] ", " [/INST]", "</s>", "<s>", " ", "\\", "\\o", "\\b", "[", "]", "<", "[OUT+] ", "[ROLE x] ", " [/ROLE]", "[INST+] ", "hello", "é😀", "\n", "+", "] "])
TEXT = st.lists(PIECE, max_size=6).map("".join) | st.none()
ROLE = st.sampled_from(["user", "assistant", "system", "tool]", "", "a[b", "+ x", "user "]) | st.none()


def digest(turns):
    spelt = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(spelt.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def found(spark, chats):
    rows = [(c, k, r, t) for c, turns in chats.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.report(df).collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.lists(st.tuples(ROLE, TEXT), min_size=1, max_size=5), min_size=20, max_size=60))
def test_any_text_comes_back(spark, chats):
    chats = dict(enumerate(chats))
    assert found(spark, chats) == {c: digest(t) for c, t in chats.items()}


@pytest.mark.parametrize("said", ["</s>[INST] ok [/INST]", "x [/INST", " [/INST] ", "</s", "\\l", "[OUT+] x</s>", "", " "])
def test_marks_in_texts(spark, said):
    chats = {-7: [("user", said), ("assistant", said)], 1: [("assistant", said), ("system", said), ("user", said)], 2: [("assistant", said), ("assistant", said)]}
    assert found(spark, chats) == {c: digest(t) for c, t in chats.items()}


def test_plain_texts_stay_plain(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi [there] <b>"), (1, 1, "assistant", "yes \\ no")], SCHEMA)
    row = chat_format.format_chats(df).first()
    assert row.formatted == "<s>[INST] hi [there] <b> [/INST] yes \\ no</s>" and row.level == 0
    (span,) = row.loss_spans
    assert row.formatted[span.start : span.stop] == "yes \\ no"


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (5, None, None, None), (6, 1, "user", "x"), (6, 1, "user", "x"), (6, 1, "assistant", None), (7, 2, "assistant", "z" * 200_000), (7, 1, "user", "w")]
    out = {r.conv_id: r for r in chat_format.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (out[None].n_turns, out[None].turns_sha256) == digest([("user", "b"), ("user", "a")])[:2]
    assert out[5].turns_sha256 == digest([(None, None)])[1]
    assert out[6].n_turns == 3 and out[6].turns_sha256 == digest([("assistant", None), ("user", "x"), ("user", "x")])[1]
    assert out[7].loss_chars == 200_000
    assert chat_format.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat_format.report(spark.createDataFrame([(1, 1, "user", "a")], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@needs_data
def test_query(spark):
    chats = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats.setdefault(r.conv_id, []).append((r.role, r.text))
    rows = op8_chat_format(spark, DATA).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == {c: digest(t) for c, t in chats.items()}


def test_formatted_chars_and_clashing_columns(spark):
    """formatted_chars is the length of the text as rendered; columns that the operator has no use for change nothing."""
    rows = [(1, 0, "system", "be [brief]"), (1, 1, "user", "hi é😀"), (1, 2, "assistant", "yes</s>"), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    formatted = {1: "<s>[ROLE system] be [brief] [/ROLE][INST] hi é😀 [/INST][OUT+] yes\\l/s></s>", 2: "<s>[INST]  [/INST]"}
    assert {r.conv_id: r.formatted for r in chat_format.format_chats(df).collect()} == formatted
    extra = df
    for name in ("turns", "sorted", "formatted", "parsed", "level", "loss_spans", "read", "loss", "it", "given"):
        extra = extra.withColumn(name, F.lit("mine"))
    want = {c: len(t) for c, t in formatted.items()}
    for source in (df, extra, clashing(df)):
        assert {r.conv_id: r.formatted_chars for r in chat_format.report(source).collect()} == want
        assert chat_format.report(source).columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_more_turns_than_a_block(spark):
    n = 2 * chat_format.BLOCK + 3
    chats = {k: [("user" if i % 2 else "assistant", f"text {i} <{i % 7}") for i in range(k)] for k in (1, chat_format.BLOCK - 1, chat_format.BLOCK, chat_format.BLOCK + 1, n)}
    assert found(spark, chats) == {c: digest(t) for c, t in chats.items()}
    rows = [(c, k, r, t) for c, turns in chats.items() for k, (r, t) in enumerate(turns)]
    for row in chat_format.format_chats(spark.createDataFrame(rows, SCHEMA)).collect():
        assert [row.formatted[s.start : s.stop] for s in row.loss_spans] == [t for r, t in chats[row.conv_id] if r == "assistant"]
