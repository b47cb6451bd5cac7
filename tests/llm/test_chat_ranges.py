"""Chats (10): a conversation of many turns, and rows without an id, are no single task's load."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_groups import chats

from tagflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_a_conversation_over_many_ranges(spark, uncoalesced):
    rng = random.Random(6)
    long = [(t, rng.choice(["user", None]), f"t{rng.randrange(50)}") for t in range(900)]
    rows = [(1, *t) for t in long] + [(2, *t) for t in long[:400]] + [(3, *t) for t in long[:899]] + [(4, *t) for t in long] + [(5, *long[1])] + [(6, 7, "user", "same")] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sizes = [r["count"] for r in chat.in_ranges(df).where("conv_id = 1").groupBy("_part").count().collect()]
    assert len(sizes) > 1
    assert len(chat.in_ranges(df.where("conv_id = 6")).groupBy("_part").count().collect()) > 1
    assert Counter(map(tuple, chat.chat_format(df).collect())) == chats(rows)


def test_rows_without_an_id_are_conversations_of_one_turn(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "user", "a"), (None, 2, None, "b"), (None, 0, "user", "opening"), (1, 0, "user", "opening"), (1, 1, "user", "more")]
    got = chat.chat_format(spark.createDataFrame(rows, SCHEMA)).where(F.col("conv_id").isNull())
    shown = lambda r, x: f"<|im_start|>{r}\n{x}<|im_end|>\n"
    assert Counter(map(tuple, got.collect())) == Counter([(None, 1, 2, shown("user", "a")), (None, 1, 1, shown("", "b"))])
