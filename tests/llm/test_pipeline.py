import os
import random

import pytest

import corpus_pipeline as cp
from sluicewire.llm import mixing, registry
from sluicewire.llm.tokens import word_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages_over_a_small_corpus(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(50)) for _ in range(n))
    data = [(i, text(80) + (" vile nasty" if i % 5 == 0 else ""), "en", f"s{i % 3}", 0, "x") for i in range(200)]
    data += [(1000 + i, data[1][1], "en", "s0", 0, None) for i in range(30)] + [(2000, text(40) + " write to a@b.co", "en", "s1", 0, None), (None, None, None, None, None, None), (2001, "", None, None, None, None)]
    spark.createDataFrame(data, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    good, unique, redacted, mixed = counts
    assert good < len(data) - 35 and unique <= good - 30 and redacted == unique and mixed >= unique
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert 1 in ids and not set(ids) & set(range(1000, 1030)) and not set(ids) & set(range(0, 200, 5))
    assert docs.where("text like '%a@b.co%'").count() == 0 and docs.where("text like '%<EMAIL>%'").count() >= 1
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == set(ids)


def test_mixing_counts_the_ids_that_are_packed(spark):
    rng = random.Random(2)
    unspaced = lambda: "".join(rng.choice("0123456789漢字仮名交") for _ in range(300))
    # the unspaced source has a word a document, but most ids
    data = [(i, unspaced(), "l", "unspaced", 0, None) for i in range(100)] + [(1000 + i, "a few plain words", "l", "words", 0, None) for i in range(100)]
    docs = spark.createDataFrame(data, DOCS)
    ids = docs.select("doc_id", mixing.id_count(docs["text"]).alias("n")).toPandas().set_index("doc_id")["n"]
    assert all(ids[d] == len(word_tokenizer().encode(t)) // 4 for d, t, *_ in data)
    got = [r["doc_id"] for r in cp.mix_sources(spark, docs, "").collect()]
    assert set(got) == {d for d, *_ in data}
    assert sum(d < 1000 for d in got) == 100 and 140 <= sum(d >= 1000 for d in got) <= 150


def test_stage_list():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing sources", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_give_a_row_for_each_document(spark, name):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    df = registry.QUERIES[name](spark, d)
    assert df.select("doc_id").distinct().count() == n
    if name not in ("op5_packing", "op8_mixing"):
        assert df.count() == n
