"""Conversation repair against whole paths, turn by turn; large conversations over many tasks; odd rows."""

from __future__ import annotations

import random

import plain_dialogue
import pytest

from rdspark.llm import dialogue, queries

ROWS = "conv_id long, turn long, role string, text string"


def random_rows(n: int, seed: int, longest: int = 9) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            text = r.choice(["Fine.", "Fine.", "And then", "  ", "", None, "What?\n\t ", "x" * 300 + "!", "é 日本。", "no end \x0b"])
            out.append((conv if conv else None, r.choice([turn, turn, turn + 3, None]) if r.random() < 0.2 else turn, r.choice(["system", "user", "user", "assistant", "assistant", "tool", "admin", "", None]), text))
    seen, kept = set(), []      # one row for each conversation, turn and role: ties of other texts are ordered by a hash
    for row in out:
        if row[:3] not in seen:
            seen.add(row[:3])
            kept.append(row)
    r.shuffle(kept)
    return kept


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("block,fan", [(dialogue.BLOCK, dialogue.FAN), (2, 2)])
def test_repair_is_the_cheapest(spark, block, fan):
    rows = random_rows(300, 4)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = found(dialogue.repaired_conversations(dialogue.damaged(df), ids=df, block=block, fan=fan, copies="copies"))
    assert got == {c: plain_dialogue.repaired(t) for c, t in plain_dialogue.damage(rows).items()}


def test_one_conversation_over_many_tasks(spark):
    """A conversation with a third of all rows and more is dealt out by turn, and spans meet in several rounds."""
    rows = [(r[0] if k % 3 else 7, k, r[2], r[3]) for k, r in enumerate(random_rows(400, 8))]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = dialogue.turns(dialogue.keyed(df))
        parts = dialogue.spans(own, 8).where("conv = '7'").selectExpr("no >> 32 AS task").distinct().count()
        got = found(dialogue.repaired_conversations(df, block=8, fan=3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1
    turns: dict = {}
    for c, t, r, x in sorted(rows, key=lambda q: q[1]):
        turns.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert got == {c: plain_dialogue.repaired(t) for c, t in turns.items()}


def test_cells_do_not_depend_on_the_split():
    r = random.Random(2)
    for _ in range(200):
        cells = [dialogue.turn_cell(r.choice("suax"), r.random() < 0.3, r.choice([0, 0, 0, 1, 3])) for _ in range(r.randint(1, 9))]
        whole = dialogue.NOTHING
        for c in cells:
            whole = dialogue.combined(whole, c)
        for k in range(len(cells) + 1):
            left, right = dialogue.NOTHING, dialogue.NOTHING
            for c in cells[:k]:
                left = dialogue.combined(left, c)
            for c in cells[k:]:
                right = dialogue.combined(right, c)
            assert dialogue.combined(dialogue.combined(left, right), dialogue.NOTHING) == dialogue.combined(whole, dialogue.NOTHING)


def test_equal_turns_ties_and_texts(spark):
    """Equal rows are repeats of one turn; rows of one turn and role with other texts keep an order of their own that does not change."""
    rows = [(1, 0, "user", "Hi.")] * 3 + [(1, 1, "assistant", "Yes.")] + [(2, 5, "user", t) for t in ("One.", "Two.", "Three.")] + [(2, None, "system", "Be kind.")]
    df = spark.createDataFrame(rows, ROWS)
    got = found(dialogue.repaired_conversations(df))
    assert got[1][:7] == (0, 0, 2, 0, 2, 4, "KDDK")
    assert got[2][:6] == (0, 0, 0, 0, 2, 3) and got[2] == found(dialogue.repaired_conversations(df.repartition(7)))[2]
    told = dialogue.repaired_turns(dialogue.keyed(df), dialogue.parsed(dialogue.turns(dialogue.keyed(df))))
    assert sorted(tuple(r) for r in told.where("conv = '1'").collect()) == [("1", 0, "user", "Hi."), ("1", 1, "assistant", "Yes.")]


def test_long_texts_empty_table_and_other_columns(spark):
    rows = [(1, 0, "user", "a b. " * 100_000), (1, 1, "assistant", "b" * 2_000_000)]
    want = plain_dialogue.repaired([r[1:] for r in rows])
    clash = spark.createDataFrame([(*r, "x", "y", "z", 5, 9) for r in rows], f"{ROWS}, conv string, n string, h1 string, kind int, copies int")
    assert found(dialogue.repaired_conversations(clash)) == {1: want}
    nothing = spark.createDataFrame([], ROWS)
    assert dialogue.repaired_conversations(dialogue.damaged(nothing), ids=nothing, copies="copies").count() == 0


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_conversation_repair(spark, folder)) == {c: plain_dialogue.repaired(t) for c, t in plain_dialogue.damage(rows).items()}
