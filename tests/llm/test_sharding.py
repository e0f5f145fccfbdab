from collections import Counter

import pytest

from sluicewire.llm.sharding import Node, assign, grow, shard_table, uniform_tree

DDL = "doc_id long, text string, shard string, slot int"


def rows(spark, data):
    return shard_table(spark.createDataFrame(data, DDL), uniform_tree(8)).collect()


def test_gapless_slots_and_growth_only_into_the_new_shard(spark):
    got = rows(spark, [(i, "x" * (i % 9), "clash", 1) for i in range(3000)])
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert 200 < sum(r["grown_shard"] == 8 for r in got) < 480


def test_nulls_repeats_and_an_empty_table(spark):
    got = rows(spark, [(None, None, None, None), (None, "a", None, None), (1, "é", "s", 1), (1, "é", "s", 1), (2, "", None, 0)])
    assert sorted((r["doc_id"] is None, r["size"]) for r in got) == [(False, 1), (False, 3), (False, 3), (True, 1), (True, 2)]
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert len({(r["shard"], r["slot"]) for r in got}) == 5
    assert rows(spark, []) == []


def test_weights_and_confined_movement(spark):
    def tree(w):
        return Node("root", children=(Node("east", children=(Node("a", w, 0), Node("b", 1.0, 1))), Node("west", children=(Node("c", 1.0, 2), Node("d", 0.0, 3)))))

    df = spark.range(20_000)
    got = df.select(assign(df["id"].cast("string"), tree(1.0)).alias("x"), assign(df["id"].cast("string"), tree(2.0)).alias("y")).collect()
    before, after = Counter(r["x"] for r in got), Counter(r["y"] for r in got)
    assert 3 not in after and abs(before[2] / 20_000 - 1 / 3) < 0.02 and abs(after[0] / 20_000 - 0.5) < 0.02
    # what moves goes to the east, whose weight grew, and inside it never from a to b
    assert all(r["y"] in (0, 1) for r in got if r["x"] != r["y"]) and not any(r["x"] == 0 and r["y"] == 1 for r in got)
    with pytest.raises(ValueError, match="positive"):
        assign(df["id"], Node("root", children=(Node("a", 0.0, 0),)))
    assert len(grow(uniform_tree(8)).leaves()) == 9
