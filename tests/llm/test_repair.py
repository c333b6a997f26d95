"""Conversation repair against a shortest path over whole edit strings."""

import itertools
import random

import brute
import pytest

from limnos.llm import repair
from limnos.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, counts int, k int, h1 string, gone string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def wanted(rows):
    return sorted(((conv, *brute.repair_conversation(kept)) for conv, kept in brute.damaged(rows).items()), key=repr)


def random_rows(rng, convs, longest):
    out = []
    for conv in range(convs):
        roles = itertools.cycle(["user", "assistant"])
        for turn in range(rng.randrange(longest)):
            role = next(roles) if rng.random() < 0.8 else rng.choice(["system", "tool", "user", "assistant", None, "", "unit"])
            text = rng.choice(["One.", "Two", "Three?  ", None, "", " \n", "é! ", "a" * 50 + rng.choice("xy.")]) if rng.random() < 0.5 else f"Text {rng.random()}."
            out.append((conv, turn, role, text))
    return out


def test_random_conversations(spark):
    rows = random_rows(random.Random(3), 300, 14)
    assert found(repair.repair_report(repair.damage(frame(spark, rows)))) == wanted(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "assistant", "b."), (1, 9, "user", "a."),
            (2, 5, "user", "x."), (2, 5, "user", "x."), (2, 5, "user", "x."), (2, 7, "assistant", "y" * 200_000 + "."), (3, 0, "ассистент", "й!"),
            *[(4, t, "user", "same text.") for t in range(60)], *[(5, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(400)],
            *[(6, 1, r, t) for r in ("user", "assistant") for t in ("p.", "q.", None)]]
    assert found(repair.repair_report(repair.damage(frame(spark, rows)))) == wanted(rows)


def test_empty_table(spark):
    assert repair.repair_report(repair.damage(frame(spark, []))).collect() == []


def test_any_partitioning_and_repaired_turns(spark):
    rows = random_rows(random.Random(8), 60, 30)
    whole = wanted(rows)
    for n in (1, 13):
        assert found(repair.repair_report(repair.damage(frame(spark, rows).repartition(n)))) == whole
    turns = repair.repaired_turns(repair.damage(frame(spark, rows))).collect()
    for conv in range(60):
        assert [r.role[:1] for r in turns if r.conv_id == conv and r.edit == "I"].count("s") == 0
    assert {r.edit for r in turns} == {"K", "R", "I"}


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_block_length_changes_nothing(block):
    rng, tables, plain = random.Random(block), repair.BlockTables(block), repair.BlockTables(1)
    for _ in range(300):
        symbols = bytes(rng.randrange(9) for _ in range(rng.randrange(40)))
        assert tables.solve(symbols) == plain.solve(symbols)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.001")) == wanted(rows)
