from duck import assert_same
from pyspark.sql import functions as F

from fedframe.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    df = chat.format_chats(spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("conv", F.lit("clash")))
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.lost, r.formatted) for r in df.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost")).collect()}


def test_query(spark, sf):
    assert_same(queries.op3_chat(spark, sf), queries.oracle_sql()["op3_chat"], sf)


def test_template(spark):
    got = back(spark, [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")])
    assert got[1][2] == "<|turn|>user<|text|>a<|end|>\n<|turn|>assistant<|text|>b<|next|>c<|end|>\n"
    assert got[1][1] == "bc"


def test_control_strings_come_back(spark):
    evil = ["<|end|>\n", "\\<|turn|>", "<<||text|>", "\\", "\\|", "<\\|next|>", "<|", "a<", "|>", "", "é漢🙂\r\n"]
    rows = [(1, i, "assistant" if i % 3 else "user", t) for i, t in enumerate(evil)] + [(2, 0, "<|text|>\\", "x")]
    got = back(spark, rows)
    assert [t for _, t in got[1][0]] == evil
    assert got[1][1] == "".join(t for i, t in enumerate(evil) if i % 3)
    assert got[2][0] == [("<|text|>\\", "x")] and got[2][1] == ""


def test_odd_rows(spark):
    got = back(spark, [(1, 1, "user", None), (1, 1, None, "n"), (1, None, "system", "s"), (1, 1, "user", "u"), (1, 1, "user", "u"), (None, 1, "assistant", "z" * 100_000)])
    assert got[1][0] == [("system", "s"), ("", "n"), ("user", ""), ("user", "u"), ("user", "u")]
    assert got[None][1] == "z" * 100_000
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_starts_of_long_arrays(spark):
    df = spark.range(1).select(chat.starts(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x % 7)).alias("s"), chat.starts(F.array(F.lit(5))).alias("one"))
    r, total, want = df.first(), 0, []
    for x in range(1, 1001):
        want.append(total)
        total += x % 7
    assert r.s == want and r.one == [0]


def test_a_long_conversation(spark):
    """Thousands of turns, in runs of one role of every length up to the whole."""
    n = 6000
    rows = [(1, i, "assistant" if (i // (1 + i // 500)) % 2 else "user", f"t{i}" * (i % 3)) for i in range(n)] + [(2, i, "assistant", f"<|{i}") for i in range(n)]
    got = back(spark, rows)
    assert got[1][0] == [(r, t) for c, _, r, t in rows if c == 1] and got[2][0] == [(r, t) for c, _, r, t in rows if c == 2]
    assert got[1][1] == "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert got[2][2].count("<|turn|>") == 1 and got[2][2].count("<|next|>") == n - 1 and got[2][2].endswith("<|end|>\n")
