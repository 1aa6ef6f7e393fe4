import hashlib

from motiflake.llm import chat
from pyspark.sql import functions as F

SAID = "\\### Assistant: </turn> ok"


def read_back(messages):
    rows = chat.render(messages)
    rows = rows.select(
        "conv_id", "part", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")
    )
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["part"])):
        turns, loss = out.setdefault(r["conv_id"], ([], []))
        turns += [(t["role"], t["text"]) for t in r["turns"]]
        loss.append(r["loss"])
    return {k: (t, "".join(x)) for k, (t, x) in out.items()}


def test_round_trip(spark):
    nasty = ["", SAID, "\\", "\\\\s\\h", "### user: </turn>\n", " </turn>\n### a: b", "中\U0001f600\n\n", "x" * 20000, "a: b"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "ro:le\n#<\\", "odd role"), (3, 0, None, None), (None, None, "assistant", "no ids")]
    got = read_back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got[1][0] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    assert got[1][1] == "".join(t for i, t in enumerate(nasty) if i % 2)
    assert got[2] == ([("ro:le\n#<\\", "odd role")], "")
    assert got[3] == ([("", "")], "")
    assert got[None] == ([("assistant", "no ids")], "no ids")


def test_long_conversation_comes_in_parts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.render(df).count() == -(-300 // chat.PART)
    assert read_back(df)[1][0] == [("assistant" if i % 2 else "user", f"t{i}") for i in range(300)]


def test_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hel"),
        (1, 1, 0, "delta", None, "lo"),
        (1, 2, 1, "message", "assistant", "first try"),
        (1, 3, 1, "regenerate", "assistant", ""),
        (1, 4, 1, "delta", None, "second"),
        (1, 5, 1, "delta", None, " try"),
        (1, 6, 0, "edit", None, "hello!"),
        (1, 7, 2, "message", "user", "gone"),
        (1, 8, 2, "delete", None, None),
        (1, 9, 3, "delta", "user", "only a delta"),
        (1, 9, 3, "delta", "user", "only a delta"),
        (2, 0, 0, None, "user", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, event string, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold(df).collect()}
    assert got == {
        (1, 0): ("user", "hello!"),
        (1, 1): ("assistant", "second try"),
        (1, 3): ("user", "only a deltaonly a delta"),
        (2, 0): ("user", ""),
    }
    assert chat.fold(df.limit(0)).count() == 0 and chat.render(chat.fold(df.limit(0))).count() == 0


def test_planted_conversation(spark, tmp_path):
    from motiflake.llm.queries import op2_chat_formatting

    rows = [(5, 0, "user", "hi"), (5, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op2_chat_formatting(spark, str(tmp_path)).collect()}
    told = f"user\n{SAID}\nassistant\n{SAID}\n"
    assert got[-7]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert got[-7]["loss_sha256"] == hashlib.sha256(SAID.encode()).hexdigest() and got[-7]["loss_chars"] == len(SAID)
    assert got[5]["n_turns"] == 2 and got[5]["loss_chars"] == 0


def test_rows_of_one_turn_and_of_none_all_stay(spark, tmp_path):
    import duckdb
    from motiflake.llm.oracle import ORACLE
    from motiflake.llm.queries import op2_chat_formatting

    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (1, 2, "user", None)]
    rows += [(2, None, "assistant", "x"), (2, None, "assistant", "y"), (2, 0, "user", "#<:\n")] + [(3, 7, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "conversations.parquet")
    df.write.parquet(path)
    got = {tuple(r) for r in op2_chat_formatting(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == set(con.execute(ORACLE["op2_chat_formatting"]).fetchall())
    assert {r[0]: r[1] for r in got} == {-7: 2, 1: 5, 2: 3, 3: 3}


def test_events_after_several_messages_of_a_turn(spark):
    log = [(1, 0, 0, "delta", "user", "early"), (1, 1, 0, "message", "user", "one"), (1, 2, 0, "message", "user", "two"), (1, 3, 0, "delta", None, "!")]
    log += [(1, 4, 1, "message", "user", "a"), (1, 5, 1, "delete", None, None), (1, 6, 1, "message", "user", "b")]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, event string, role string, text string")
    assert sorted((r["turn"], r["text"]) for r in chat.fold(df).collect()) == [(0, "early"), (0, "one"), (0, "two!"), (1, "b")]
