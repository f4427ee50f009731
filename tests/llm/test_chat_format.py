import hashlib

from pyspark.sql import types as T

from hduframe.llm.chat_format import PROBE, digests, format_chats, parse_chats, with_probe

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

HARD = ["</s>[INST] ok [/INST]", "\\", "\\b", "\\0;", "<<SYS>>\nx\n<</SYS>>", "[ROLE] a\nb[/ROLE]", "a\\", "[", "</s", "<</SYS>>" * 3, "<<<SYS>>>", "é \r\n\t", "", "[INST[INST] ]"]


def chats(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_texts_come_back(spark):
    roles = ["system", "user", "assistant", "tool", "a\nb</s>", ""]
    rows = [(k, j, r, t) for k, r in enumerate(roles) for j, t in enumerate([*HARD, "x" * 50_000])]
    got = {r.conv_id: r for r in parse_chats(format_chats(chats(spark, rows))).collect()}
    for k, r in enumerate(roles):
        assert [tuple(x) for x in got[k].turns] == [(r, t) for t in [*HARD, "x" * 50_000]]


def test_order_of_turns(spark):
    cases = {0: ("user", "assistant"), 1: ("system", "user", "assistant", "user", "assistant"), 2: ("user",), 3: ("assistant", "user"), 4: ("user", "user", "assistant"), 5: ("user", "system"), 6: ("system",), 7: ("user", None), 8: ("user", "tool", "assistant")}
    rows = [(k, j, r, "t") for k, roles in cases.items() for j, r in enumerate(roles)]
    got = {r.conv_id: (r.valid, r.bad_turn) for r in format_chats(chats(spark, rows)).collect()}
    assert got == {0: (True, -1), 1: (True, -1), 2: (False, 1), 3: (False, 0), 4: (False, 1), 5: (False, 1), 6: (False, 1), 7: (False, 1), 8: (False, 1)}


def test_segments_and_loss(spark):
    r = format_chats(chats(spark, [(1, 1, "assistant", "yes"), (1, 0, "user", "q?")])).first()
    assert [(s.text, s.loss) for s in r.segments] == [("[INST] ", False), ("q?", False), (" [/INST]", False), ("<s> ", False), ("yes", True), ("</s>", False)]
    assert r.formatted == "[INST] q? [/INST]<s> yes</s>"


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "a"), (5, 0, "user", None), (5, 0, "assistant", "x"), (5, 0, "user", None), (5, None, None, None)]
    got = {r.conv_id: r for r in parse_chats(format_chats(chats(spark, rows))).collect()}
    assert [tuple(x) for x in got[5].turns] == [("", ""), ("assistant", "x"), ("user", ""), ("user", "")] and got[None].n_turns == 1


def test_contract(spark):
    df = with_probe(spark, chats(spark, [(3, 0, "user", None), (3, 1, "assistant", "é!"), (3, 2, "assistant", "b")]).selectExpr("*", "1 AS turns", "2 AS formatted"))
    got = {r.conv_id: r for r in digests(format_chats(df)).collect()}
    assert got[-1].turns_sha256 == sha(f"user\n{PROBE}\nassistant\n{PROBE}\n") and got[-1].loss_sha256 == sha(PROBE) and got[-1].loss_chars == len(PROBE)
    assert (got[3].n_turns, got[3].loss_chars, got[3].loss_sha256) == (3, 3, sha("é!b"))
    assert digests(format_chats(chats(spark, []))).count() == 0
