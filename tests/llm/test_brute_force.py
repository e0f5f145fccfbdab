"""Operators that SQL can't express, recomputed step by step in plain Python on a small corpus."""

import math
import os
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sluicewire.llm import imatch, mixing, registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def terms(text):
    return {xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(r"[^\w]|_", text.lower()) if w}


def fingerprint(text, band):
    kept = terms(text) & band
    out = ""
    for level in range(imatch.LEVELS):
        for s in range(imatch.SUBSETS):
            own = sorted(s << imatch.CODE_BITS | h & (1 << imatch.CODE_BITS) - 1 for h in kept if h >> 50 & ((1 << imatch.LEVEL_BITS * level) - 1) == 0 and h >> 40 & imatch.SUBSETS - 1 == s)
            text = "".join(f",{x:X}" for x in own) + ("," if s < imatch.SUBSETS - 1 else "")
            out += f"{max(1, xxhash.xxh64_intdigest(text.encode(), seed=42) >> 48):04x}" if own else "0000"
    return out


def likeness(a, b):
    if a == b:
        return 1.0
    shares, weights = 0.0, 0
    for level in range(imatch.LEVELS):
        at = range(level * imatch.SUBSETS * 4, (level + 1) * imatch.SUBSETS * 4, 4)
        pairs = [(a[i : i + 4], b[i : i + 4]) for i in at]
        used = sum(x != "0000" or y != "0000" for x, y in pairs)
        if used:
            shares += used * (33 - used) * (sum(x == y != "0000" for x, y in pairs) / used)
            weights += used * (33 - used)
    return shares / weights if weights else 0.0


def test_imatch(spark, docs):
    df = Counter(h for r in docs.values() for h in terms(r["text"]))
    low = max(1.0, imatch.MIN_SHARE * len(docs))
    high = max(imatch.MAX_SHARE * len(docs), low + 1)
    band = {s for s, n in df.items() if low <= n <= high}
    order = sorted(docs, reverse=True)
    prints = {i: fingerprint(docs[i]["text"], band) for i in docs}
    got = {r["doc_id"]: r for r in registry.QUERIES["op3_imatch"](spark, DIR).collect()}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t = docs[a]["text"]
        third = len(t) // 3
        edited = fingerprint(t[: len(t) - third] + docs[b]["text"][:third], band)
        assert (got[a]["fingerprint"], got[a]["edited_fingerprint"]) == (prints[a], edited)
        assert math.isclose(got[a]["near_edited"], likeness(prints[a], edited)) and math.isclose(got[a]["near_next"], likeness(prints[a], prints[b]))


def test_mixing(spark, docs):
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = base.select("doc_id", *mixing._keyed(base, "doc_id", "text", "source")).withColumn("_block", mixing.block_of(mixing.LEAST_BITS)).select("*", F.xxhash64("_s", "_block", F.lit(mixing.SEED + 2)).alias("o")).collect()
    assert all(r["_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"])) for r in rows)
    total = Counter()
    for r in rows:
        total[r["_s"]] += r["_tokens"]

    def weights(a):
        z = sum(t**a for t in total.values())
        return {s: t**a / z for s, t in total.items()}

    def repeats(a):
        passes = [w / total[s] for s, w in weights(a).items()]
        return max(passes) / min(passes)

    a = mixing.fit_exponent(spark.createDataFrame(list(total.items()), "_s string, tokens long"), mixing.Target())
    # the limit is met, and no flatter mixture would meet it
    assert abs(repeats(a) - mixing.MAX_REPEATS) < 1e-9 and repeats(a - 1e-6) > mixing.MAX_REPEATS
    rounded = {("=" + r["source"] if r["source"] is not None else ""): r["weight"] for r in registry.QUERIES["op8_mixing"](spark, DIR).select("source", "weight").distinct().collect()}
    assert rounded == {s: round(w, 9) for s, w in weights(a).items()}
    want = Counter()
    for s, t in total.items():
        epochs = (t / max(total.values())) ** (a - 1)
        passes = math.floor(epochs + 1e-9)
        budget = max(0, round((epochs - passes) * t))
        for r in rows:
            if r["_s"] == s:
                want.update((r["doc_id"], p) for p in range(1, passes + 1))
        blocks = {}
        for r in rows:
            if r["_s"] == s:
                blocks.setdefault((r["o"], r["_block"]), []).append(r)
        for key in sorted(blocks):
            block = sorted(blocks[key], key=lambda r: r["_u"])
            size = sum(r["_tokens"] for r in block)
            if size <= budget:
                want.update((r["doc_id"], passes + 1) for r in block)
                budget -= size
                continue
            if budget > 0:
                for r in block:
                    if r["_tokens"] > budget:
                        break
                    want[r["doc_id"], passes + 1] += 1
                    budget -= r["_tokens"]
            break
    assert Counter((r["doc_id"], r["pass"]) for r in registry.QUERIES["op8_mixing"](spark, DIR).collect()) == want
