import hashlib
import random

from pyspark.sql import functions as F

from stormglass.llm import chat, queries
from tests.llm import helpers as H

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "[NEXT]", "[ROLE]", "[/ROLE]", "[SYS]", "[\\INST]", "<\\\\/s>", "\\", "[", "<", " ", "\n", "é𝄞", "ab", "]", "/"]


def read_back(spark, rows):
    out = chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = out.select("conv_id", "formatted", chat.turns_of(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("mask")).alias("loss"))
    return {r.conv_id: (r.formatted, [tuple(t) for t in r.turns], r.loss) for r in out.collect()}


def expected(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def test_every_turn_comes_back(spark):
    draw = random.Random(5)
    rows = []
    for conv in range(300):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant", "system", "tool", "[ROLE]", "", None, "[/ROLE] x"])
            rows.append((conv, turn if draw.random() < 0.8 else draw.randint(0, 3), role, "".join(draw.choices(PARTS, k=draw.randint(0, 8)))))
    got = read_back(spark, rows)
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert got[conv][1] == turns
        assert got[conv][2] == [t for r, t in turns if r == "assistant"]


def test_form_and_merged_turns(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b</s>"), (1, 3, "assistant", None), (1, 4, "tool", "t")]
    assert read_back(spark, rows)[1][0] == "<s>[INST] a[NEXT]b<\\/s> [/INST] c[NEXT]</s>[ROLE]tool[/ROLE] t [/ROLE]"


def test_nulls_repeats_long_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, 0, "assistant", H.LONG), (1, 0, "assistant", H.LONG), (2, 0, "user", "")]
    got = read_back(spark, rows)
    assert got[None][1] == [("", ""), ("user", "x")]
    assert got[1][1] == [("assistant", H.LONG)] * 2 and got[1][2] == [H.LONG] * 2
    assert got[2][1] == [("user", "")] and got[2][2] == []
    df = spark.createDataFrame(rows, SCHEMA)
    clashing = df.select("*", *[F.lit(1).alias(c) for c in ("turns", "blocks", "id", "Text", "formatted", "mask", "starts")])
    key = lambda r: str(r.conv_id)
    assert sorted(chat.format_chats(clashing).collect(), key=key) == sorted(chat.format_chats(df).collect(), key=key)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}é") for i in range(3000)]
    got = read_back(spark, rows)[1]
    assert got[1] == [(r, t) for _, _, r, t in rows] and got[2] == [t for _, _, r, t in rows if r == "assistant"]


def test_query_against_plain_digests(spark):
    rows = [tuple(r) for r in H.table(spark, "conversations").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv, turns in expected(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        want[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op13_chat_formatting(spark, H.SF).collect()}
    assert got == want
