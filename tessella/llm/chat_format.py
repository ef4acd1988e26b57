r"""Chat formatting checked by a grammar round trip, in DataFrame operations only.

The rendered text is ``<s>`` and then the turns.  A user turn is ``[INST] text [/INST]``, an assistant
turn is `` text</s>`` (a space before it), and any other role is ``[ROLE name] text [/ROLE]``.  A turn
whose text was escaped has ``+`` in its opening (``[INST+] ``, ``[ROLE+ name] `` and for an assistant
``[OUT+] `` in place of the space).  The escape writes ``\b`` for a backslash, ``\o`` for ``[`` and ``\l``
for ``<``; an escaped text has no character that a mark begins with, so it can't hold a mark.

A deterministic grammar (one regular expression whose alternatives start differently) parses the
rendered text again.  First nothing is escaped; conversations whose parsed turns differ from the source
are rendered again with the turns escaped that hold the start of a mark; those that still differ get
every turn escaped, which always parses back.

Defined cases: null text is empty; null role is an empty role; turns are ordered by turn, then role,
then text, with null first, so repeated rows are repeated turns; a null conv_id is a conversation like
any other; an empty table gives an empty result.  A conversation is one value of the output and so is
built in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The starts of marks.  A text without any of them needs no escape, unless its edges meet a mark.
MARKS = ("[INST", "[/INST]", "[OUT", "[ROLE", "[/ROLE]", "<s>", "</s>")
#: One turn of the rendered text.  Group 1: a user's text, 2 and 3: an assistant's, 4 and 5: role and text of others.
TURN = r"(?s)\[INST\+?\] (.*?) \[/INST\]|\[OUT\+\] (.*?)</s>| (.*?)</s>|\[ROLE\+? ([^\]]*)\] (.*?) \[/ROLE\]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("["), F.lit("\\o")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\o"), F.lit("[")), F.lit("\\b"), F.lit("\\"))


def _role_out(role: Column) -> Column:
    """A role inside its mark: the escape, with a closing bracket as \\c too."""
    return F.replace(escape(role), F.lit("]"), F.lit("\\c"))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit("]")))


def _rendered(turn: Column, escaped: Column) -> Column:
    text = F.when(escaped, escape(turn["text"])).otherwise(turn["text"])
    plus = F.when(escaped, F.lit("+")).otherwise(F.lit(""))
    return (
        F.when(turn["role"] == "user", F.concat(F.lit("[INST"), plus, F.lit("] "), text, F.lit(" [/INST]")))
        .when(turn["role"] == "assistant", F.concat(F.when(escaped, F.lit("[OUT+] ")).otherwise(F.lit(" ")), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE"), plus, F.lit(" "), _role_out(turn["role"]), F.lit("] "), text, F.lit(" [/ROLE]")))
    )


def _opening(piece: Column) -> Column:
    """Characters of a rendered turn before its text."""
    return (
        F.when(piece.startswith("[INST+] "), F.lit(8))
        .when(piece.startswith("[INST] ") | piece.startswith("[OUT+] "), F.lit(7))
        .when(piece.startswith(" "), F.lit(1))
        .otherwise(F.instr(piece, "] ") + 1)
    )


def _closing(piece: Column) -> Column:
    """Characters of a rendered turn after its text."""
    return F.when(piece.startswith("[INST") | piece.startswith("[ROLE"), F.lit(8)).otherwise(F.lit(4))


def parsed(formatted: Column) -> Column:
    """The turns of a rendered text: role, text, and where the raw text stands (start, length in characters)."""
    pieces = F.regexp_extract_all(F.substring(formatted, 4, 2**31 - 1), F.lit(TURN), F.lit(0))

    def turn(piece: Column) -> Column:
        opening, closing = _opening(piece), _closing(piece)
        raw = piece.substr(opening + 1, F.length(piece) - opening - closing)
        plus = piece.startswith("[INST+") | piece.startswith("[OUT+") | piece.startswith("[ROLE+")
        named = piece.substr(F.when(piece.startswith("[ROLE+"), F.lit(8)).otherwise(F.lit(7)), F.lit(2**31 - 1))
        role = F.when(piece.startswith("[INST"), F.lit("user")).when(piece.startswith("[ROLE"), _role_in(F.substring_index(named, "] ", 1))).otherwise(F.lit("assistant"))
        return F.struct(role.alias("role"), F.when(plus, unescape(raw)).otherwise(raw).alias("text"), opening.alias("opening"), F.length(raw).alias("chars"), F.length(piece).alias("width"))

    return F.transform(pieces, turn)


def _same(turns: Column, again: Column) -> Column:
    """Whether the parsed turns are the source's."""
    return turns == F.transform(again, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), formatted, parsed, level (0 to 2, the escape that was needed) and
    loss_spans (start, stop: characters of formatted, the assistants' texts, from 0)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), turn.alias("it"))))
    chats = rows.groupBy("conv_id").agg(order.alias("sorted")).select("conv_id", F.transform("sorted", lambda x: F.struct(x["it"]["role"].alias("role"), x["it"]["text"].alias("text"))).alias("turns"))

    def rendered(escaped) -> Column:
        return F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: _rendered(t, escaped(t))), ""))

    def marked(t: Column) -> Column:
        found = F.lit(False)
        for mark in MARKS:
            found = found | t["text"].contains(mark)
        return found

    out = chats.withColumn("formatted", rendered(lambda t: F.lit(False))).withColumn("parsed", parsed(F.col("formatted"))).withColumn("level", F.lit(0))
    for level, escaped in ((1, marked), (2, lambda t: F.lit(True))):
        ok = _same(F.col("turns"), F.col("parsed"))
        out = out.withColumn("level", F.when(ok, F.col("level")).otherwise(F.lit(level)))
        again = F.when(F.col("level") == level, rendered(escaped)).otherwise(F.col("formatted"))
        out = out.withColumn("formatted", again).withColumn("parsed", F.when(F.col("level") == level, parsed(F.col("formatted"))).otherwise(F.col("parsed")))
    wrong = F.raise_error(F.concat(F.lit("conversation does not parse back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    out = out.withColumn("formatted", F.when(_same(F.col("turns"), F.col("parsed")), F.col("formatted")).otherwise(wrong))
    return out.withColumn("loss_spans", _loss_spans(F.col("parsed")))


#: Turns whose places are added up one by one; an array grows by a copy, so long conversations go in blocks of so many.
BLOCK = 256


def _loss_spans(turns: Column) -> Column:
    """Where the assistants' texts stand.  First the width of each block of turns, then the places in each block."""
    number = F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((size(parsed) - 1) div {BLOCK} AS int)")))
    blocks = F.transform(number, lambda k: F.slice(turns, k * BLOCK + 1, F.lit(BLOCK)))
    widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, t: n + t["width"]))
    starts = F.aggregate(
        widths,
        F.struct(F.lit(3).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")),
    )["starts"]

    def placed(block: Column, start: Column) -> Column:
        span = lambda s, t: F.struct((s["at"] + t["opening"]).alias("start"), (s["at"] + t["opening"] + t["chars"]).alias("stop"))
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast("array<struct<start: int, stop: int>>").alias("spans")),
            lambda s, t: F.struct((s["at"] + t["width"]).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(span(s, t)))).otherwise(s["spans"]).alias("spans")),
        )["spans"]

    return F.flatten(F.zip_with(blocks, starts, placed))


def report(rows: DataFrame) -> DataFrame:
    """The digests of each conversation, all read back from formatted and loss_spans."""
    out = format_chats(rows.select("conv_id", "turn", "role", "text"))
    again = out.select("conv_id", "formatted", "loss_spans", parsed(F.col("formatted")).alias("read"))
    spelt = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def masked(span: Column) -> Column:
        raw = F.col("formatted").substr(span["start"] + 1, span["stop"] - span["start"])
        escaped = F.col("formatted").substr(span["start"] - 6, F.lit(7)) == "[OUT+] "
        return F.when((span["start"] >= 7) & escaped, unescape(raw)).otherwise(raw)

    loss = F.array_join(F.transform("loss_spans", masked), "")
    return again.withColumn("loss", loss).select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(spelt, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
