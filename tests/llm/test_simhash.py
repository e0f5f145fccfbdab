import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluicewire.llm import simhash as s
from sluicewire.llm.common import split_join

DDL = "doc_id long, text string, fp string, component_id string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3).tolist():
            a, b = find(i), find(i + 1 + j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def cluster(rng, n, flips):
    centre = int(rng.integers(0, 2**64, dtype=np.uint64))
    out = {centre}
    for _ in range(n - 1):
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, flips + 1)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


def test_fingerprints():
    for t in (None, "", " \t\n", "One", "one TWO", "a b c a b c a b c", "É É\x0bx\x1cy z", "w " * 50_000):
        assert s.fingerprint(t) == plain(t)


def test_buckets_of_all_sizes():
    rng = np.random.default_rng(5)
    for n in (2, 3, 64, 65, 200, 900):
        fps = np.array(cluster(rng, n, 6), dtype=np.uint64)
        want = {i: r for i, r in enumerate(brute(fps)) if i != r}
        forest = s._large_forest(fps) if len(fps) > 64 else s._forest(s._small_links(fps, np.array([len(fps)])))
        assert {i: r for i, r in forest.items() if i != r} == want


def test_any_cut_leaves_two_blocks_of_a_link_alone():
    rng = random.Random(3)
    for cut in range(len(s.CUTS)):
        masks = [m % (1 << 64) for m in s.block_masks(cut)]
        assert len(masks) == 10 and all(sum(s.block(cut, b) == i for b in range(64)) >= 12 for i in range(5))
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not d & m for m in masks)
    # dealt again and again, a bucket has few open bits
    fixed = [0]
    for cut in range(len(s.CUTS)):
        fixed = sorted({f | m % (1 << 64) for f in fixed for m in s.block_masks(cut)}, key=int.bit_count)[:3000]
    assert 1 << 64 - fixed[0].bit_count() <= s.LARGE


@pytest.mark.parametrize("large", [16, 4])
def test_links_find_every_component_also_of_buckets_dealt_again(spark, monkeypatch, large):
    monkeypatch.setattr(s, "LARGE", large)
    rng = np.random.default_rng(6)
    fps = sorted({x for n in (1, 1, 2, 5, 120) for _ in range(4) for x in cluster(rng, n, 4)})
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(signed)], "doc_id long, tx long, fp long")
    of, _ = s.components(rows)
    got = {r["fp"]: r["first"]["doc_id"] for r in of.collect()}
    assert [got[x] for x in signed] == brute(np.array(fps, dtype=np.uint64))


def test_joins_of_hot_keys_are_between_plain_exchanges(spark):
    """Spark splits a hot partition of a join only where both sides are plain exchanges (and a sort)."""
    rows = spark.range(3000).select(F.col("id").alias("fp"))
    edges = rows.select((F.col("fp") % 7).alias("a"), F.col("fp").alias("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        grouped = split_join(edges, edges.groupBy("a").agg(F.min("b").alias("m")), ["a"])
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (s.links(rows), grouped)]
        assert sorted(map(tuple, grouped.collect())) == sorted((i % 7, i, i % 7) for i in range(3000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        lines = plan.split("\n")
        joins = [i for i, x in enumerate(lines) if "SortMergeJoin" in x]
        assert joins
        for i in joins:
            depth = lines[i].index("SortMergeJoin")
            # the two sides begin three characters further in
            for side in [j for j in range(i + 1, len(lines)) if lines[j][depth : depth + 3] in (":- ", "+- ")][:2]:
                below = [x for x in lines[side:] if "Sort [" in x or "Exchange" in x]
                assert "Sort [" in below[0] and "Exchange hashpartitioning" in below[1], plan


def test_nulls_ties_repeats_clashing_columns(spark):
    long = " ".join(f"w{i % 97}" for i in range(4000))
    data = [(5, long, "x", "y"), (3, long, None, None), (3, long, None, None), (None, None, None, None), (7, "", None, None), (None, " ", None, None), (9, "other words here", None, None)]
    got = sorted(map(repr, s.near_duplicates(spark.createDataFrame(data, DDL)).select("doc_id", "fingerprint", "component_id").toPandas().astype(str).itertuples(index=False, name=None)))
    assert len(got) == 7
    df = s.near_duplicates(spark.createDataFrame(data, DDL)).collect()
    assert {r["component_id"] for r in df if r["fingerprint"] == "0" * 16} == {7}
    assert {r["component_id"] for r in df if r["doc_id"] in (3, 5)} == {3}
    kept = s.keep_one(spark.createDataFrame(data, DDL))
    assert kept.columns == ["doc_id", "text", "fp", "component_id"] and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 9]
    clash = spark.createDataFrame([(1, "one text", "a", 5, "b", 6), (2, "one text", "c", 7, "d", 8)], "doc_id long, text string, tx string, n int, row string, `x.y` int")
    assert [tuple(r) for r in s.keep_one(clash).collect()] == [(1, "one text", "a", 5, "b", 6)]
    assert s.near_duplicates(spark.createDataFrame([], DDL)).count() == 0 and s.keep_one(spark.createDataFrame([], DDL)).count() == 0


def test_long_chains_are_one_component(spark):
    from sluicewire.llm.graph import stars

    rng = random.Random(2)
    ids = list(range(300))
    rng.shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r["a"]: r["b"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {1001: 1000}
