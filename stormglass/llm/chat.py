"""Chat formatting: conversations as one training text each, with a loss mask, and back.

A conversation's turns are collected as structs and sorted; adjacent turns of one role become one block
(slices of the array, so long conversations stay linear); blocks are concatenated. All of it, and reading
the turns back from the text, is made of Spark expressions.

Form: ``<s>``, then per block
- user ``[INST] texts [/INST]``, system ``[SYS] texts [/SYS]``, assistant `` texts</s>``,
- any other role ``[ROLE]role[/ROLE] texts [/ROLE]``.
The texts of one block are parted by ``[NEXT]``. A control string inside a text or role gets a backslash
behind its first character, and one more if it has some already; reading back takes one away. So no text
holds a mark, and every text comes back as it was.

The mask lists the spans of assistant texts as (start, length) in bytes of the UTF-8 form, one per turn.

Rows are ordered by (turn, role, text), so ties and repeated rows, which all stay, have one order; a null
turn comes first. Null text and null role are empty. Rows whose conversation id is null are one
conversation, as in GROUP BY. An empty table gives no rows. Only the four named columns are read. A
conversation is one row of the result, so it must fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormglass.llm import arrow as A

#: Control strings, with any number of backslashes behind the first character.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|NEXT\])"
NEXT = "[NEXT]"
START = "<s>"
#: Opening and closing mark of the roles that have their own.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE]", "[/ROLE] ", " [/ROLE]")
BLOCK = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[ROLE\].*?\[/ROLE\] .*? \[/ROLE\]| .*?</s>"
STEP = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _case(role: Column, others: Column, place: int) -> Column:
    mark = F.when(F.lit(False), "")
    for name, marks in MARKS.items():
        mark = mark.when(role == name, F.lit(marks[place]))
    return mark.otherwise(others)


def _opening(role: Column) -> Column:
    return _case(role, F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), 0)


def _closing(role: Column) -> Column:
    return _case(role, F.lit(OTHER[2]), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _before(numbers: Column) -> Column:
    """Per element the sum of those before it, by steps so that long arrays don't cost their square."""
    starts = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda s: F.slice(numbers, s, STEP))
    sums = F.transform(parts, _sum)
    base = F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i)))
    return F.flatten(F.zip_with(parts, base, lambda part, b: F.transform(part, lambda _, i: b + _sum(F.slice(part, F.lit(1), i)))))


def format_chats(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: its id, ``formatted`` and ``mask`` (array of start and length of assistant texts)."""
    rows = A.pick(conversations, key, turn, role, text).toDF("id", "turn", "role", "text")
    filled = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("id").agg(F.array_sort(F.collect_list(filled)).alias("turns"))
    turns = F.col("turns")

    def other_role(i: Column, shift: int) -> Column:
        return F.coalesce(F.get(turns, i + shift)["role"] != F.get(turns, i)["role"], F.lit(True))

    # first and last turn of every run of one role
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    runs = F.arrays_zip(
        F.filter(places, lambda i: other_role(i, -1)).alias("first"), F.filter(places, lambda i: other_role(i, 1)).alias("last")
    )
    merged = sorted_turns.select(
        "id",
        F.transform(
            runs,
            lambda r: F.struct(
                F.get(turns, r["first"])["role"].alias("role"),
                F.transform(F.slice(turns, r["first"] + 1, r["last"] - r["first"] + 1), lambda t: escape(t["text"])).alias("texts"),
            ),
        ).alias("blocks"),
    )
    written = merged.select(
        "id",
        F.transform(
            "blocks",
            lambda b: F.struct(
                b["role"].alias("role"),
                _opening(b["role"]).alias("open"),
                F.array_join(b["texts"], NEXT).alias("body"),
                F.transform(b["texts"], lambda t: F.octet_length(t).cast("bigint")).alias("lengths"),
                _closing(b["role"]).alias("close"),
            ),
        ).alias("blocks"),
    )
    blocks = F.col("blocks")
    whole = F.transform(blocks, lambda b: F.concat(b["open"], b["body"], b["close"]))
    placed = written.select(
        "id",
        F.concat(F.lit(START), F.array_join(whole, "")).alias("formatted"),
        blocks,
        _before(F.transform(whole, lambda t: F.octet_length(t).cast("bigint"))).alias("starts"),
    )

    def spans(block: Column, start: Column) -> Column:
        first = start + F.octet_length(block["open"]) + len(START)
        return F.zip_with(
            block["lengths"],
            _before(F.transform(block["lengths"], lambda n: n + len(NEXT))),
            lambda n, before: F.struct((first + before).alias("start"), n.alias("length")),
        )

    of_role = F.zip_with(blocks, "starts", lambda b, s: F.when(b["role"] == "assistant", spans(b, s)))
    mask = F.flatten(F.filter(of_role, lambda x: x.isNotNull()))
    return placed.select(F.col("id").alias(key), "formatted", mask.alias("mask"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text in order, as array of (role, text)."""

    def inner(block: Column, opening: Column, closing: str) -> Column:
        return F.substring(block, F.length(opening) + 1, F.length(block) - F.length(opening) - len(closing))

    def read(block: Column) -> Column:
        named = F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[/ROLE\] ", 1)
        role = F.when(block.startswith("[INST]"), "user").when(block.startswith("[SYS]"), "system")
        role = role.when(block.startswith("[ROLE]"), unescape(named)).otherwise("assistant")
        body = F.when(block.startswith("[ROLE]"), inner(block, F.concat(F.lit(OTHER[0]), named, F.lit(OTHER[1])), OTHER[2]))
        for mark in ("user", "system"):
            opening, closing = MARKS[mark]
            body = body.when(block.startswith(opening), inner(block, F.lit(opening), closing))
        body = body.otherwise(inner(block, F.lit(MARKS["assistant"][0]), MARKS["assistant"][1]))
        return F.transform(F.split(body, r"\[NEXT\]"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.regexp_extract_all(F.substring(formatted, len(START) + 1, 2**31 - 1), F.lit(BLOCK), F.lit(0))
    return F.flatten(F.transform(blocks, read))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts below the mask, each as it was before escaping."""
    data = F.encode(formatted, "UTF-8")
    return F.transform(mask, lambda m: unescape(F.decode(F.substring(data, (m["start"] + 1).cast("int"), m["length"].cast("int")), "UTF-8")))
