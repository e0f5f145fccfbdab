import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicewire.llm import imatch, langid, mixing, packing, quality
from sluicewire.llm.tokens import word_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_token_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), word_tokenizer()
    rng = random.Random(3)
    parts = ["a", "Σ", "İ", "'s", "<|endoftext|>", " ", "\n", "\x1c", "\xa0", "é", "é", "漢", "12", "!", ".", "ß", "ſ", "ǅ", "​", "\x85", "'LL", "hello", "WORLD", "🙂"]
    for t in [*("".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)), "x" * 3000, ""]:
        assert np.frombuffer(fast.encode(t), "<u4").tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_cuts_cost_least():
    rng = random.Random(1)
    for _ in range(150):
        window = rng.choice([4, 7, 8, 16])
        cuts, at = [], 0
        while at < 40:
            at += rng.randint(1, min(window, 6))
            cuts.append(at)
        pen = np.array([rng.choice([0.0, 1.0, 8.0]) for _ in cuts])
        pos, best = [0, *cuts], [0.0]
        cost = lambda n: 0 if n & (n - 1) == 0 else window - n
        for j in range(1, len(pos)):
            best.append(min(best[i] + cost(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= window) + packing.WINDOW_COST + pen[j - 1])
        got = packing.choose_cuts(np.array(cuts), pen, window)
        assert got[-1] == cuts[-1] and all(b - a <= window for a, b in zip([0, *got], got))
        total = sum(cost(b - a) + packing.WINDOW_COST + pen[cuts.index(b)] for a, b in zip([0, *got], got))
        assert abs(total - best[-1]) < 1e-9


def test_every_id_is_in_one_piece(spark):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(["alpha", "beta.", "gamma!", "x"]) for _ in range(rng.choice([0, 3, 40, 900]))), 1, 2) for i in range(60)]
    data += [(None, None, 0, 0), (7, "repeated row", 0, 0), (7, "repeated row", 0, 0), (99, "z" * 20_000, 0, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, start int, length int").coalesce(2)
    got = [r.asDict() for r in packing.pack_table(df, window=64).collect()]
    docs = {}
    for r in got:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    tok = word_tokenizer()
    for doc_id, text, *_ in data:
        ids = tok.encode(text or "") + b"\1\0\0\0"
        pieces = sorted(docs[doc_id, len(ids) // 4], key=lambda r: r["start"])
        for r in pieces:
            assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        assert sum(r["length"] for r in pieces) == len(ids) // 4 * (2 if doc_id == 7 and text == "repeated row" else 1)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
        padding += 0 if at & (at - 1) == 0 else 64 - at
    assert padding < 0.02 * sum(r["length"] for r in got)
    assert packing.pack_table(df.where("false")).count() == 0


def grams_of(text, size):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    t = " " + " ".join(words) + " " if words else " "
    return [t[i : i + size] for i in range(len(t) - size + 1) if " " not in t[i + 1 : i + size - 1]]


def test_ngrams():
    for t in ("Hello, wörld 3x", "", "12", "a", "ab  cd"):
        for size in langid.SIZES:
            got = langid.ngrams(langid.code_points(t), size)
            want = grams_of(t, size)
            assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))


def test_language_id(spark):
    rng = random.Random(5)
    words = {"aa": ["the", "and", "thing", "other", "with"], "bb": ["der", "und", "nicht", "auch", "mit"], "cc": ["les", "des", "pour", "avec", "mais"]}
    data = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.choice([3, 30]))), k, "s", 0) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame([*data, (None, None, "aa", None, None), (500, "the", None, None, None)], DOCS)
    filters = langid.learn(df)
    assert filters.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.predict(df, filters).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _, _ in data) and all(0 <= r["score"] <= 1 for r in got.values())
    odd = langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "漢字"), (5, "the " * 50_000)], "doc_id long, text string"), filters).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd] == ["und", "und", "und", "aa", "aa"] and odd[3]["score"] == 0
    none = langid.learn(df.where("false"))
    assert none.languages == [] and [r["lang_pred"] for r in langid.predict(df.limit(2), none).collect()] == ["und", "und"]
    assert langid.predict(df.where("false"), filters).count() == 0
    # every language that contains an n-gram is returned
    for lang in words:
        for size in langid.SIZES:
            mask = filters.containing(langid.ngrams(langid.code_points(" ".join(words[lang])), size))
            assert (mask >> np.uint8(filters.languages.index(lang)) & np.uint8(1)).all()


def test_more_languages_than_a_mask_has_bits(spark):
    rng = random.Random(6)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(140)}
    # the last ones are the rarest
    data = [(1000 * k + j, " ".join(rng.choice(w) for _ in range(12)), lang, "s", 0) for k, (lang, w) in enumerate(words.items()) for j in range(3 if k < 70 else 2)]
    df = spark.createDataFrame(data, DOCS)
    filters = langid.learn(df)
    assert filters.languages == sorted(words)
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.3 for r in langid.predict(df, filters).collect())


def test_shapes_of_long_tokens():
    assert quality._shape("x" * 100 + "7" * 5000 + "=") == "a9="
    assert quality._shape("Ab1-" * 100) == "Aa9-" * 100 and quality._shape("") == ""


def test_scores_beside_clashing_columns(spark):
    model = quality.Model(np.zeros(quality.DIMENSIONS), np.array([-1.0, 0.0]))
    ddl = "doc_id long, text string, expected_grade string, _result int, row int, `x.y` int"
    df = spark.createDataFrame([(1, "a", "old", 5, 6, 7), (None, None, None, None, None, None), (1, "a", "old", 5, 6, 7)], ddl)
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "_result", "row", "x.y", "expected_grade", "tail_probability"]
    assert [(r["_result"], r["row"], r["x.y"], r["tail_probability"]) for r in got.where("doc_id = 1").collect()] == [(5, 6, 7, 0.5)] * 2
    assert quality.score(df.where("false"), model).count() == 0
    good = quality.keep_good(df, quality.Model(np.zeros(quality.DIMENSIONS), np.array([-50.0, -50.0])))
    assert good.columns == df.columns and sorted(map(str, good.collect())) == sorted(map(str, df.collect()))


def test_sample_bound_holds_for_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    taken = []
    real = quality.fit_rows
    quality.fit_rows = lambda *args: taken.append(len(args[3])) or real(*args)
    try:
        quality.fit(docs, labels, sample=40)
    finally:
        quality.fit_rows = real
    assert taken == [40]


def test_languages_beside_clashing_columns(spark):
    ddl = "doc_id long, text string, lang string, lang_pred string, SCORE int, _result int, `x.y` int"
    df = spark.createDataFrame([(1, "alpha beta", "aa", "old", 5, 6, 7), (1, "alpha beta", "aa", "old", 5, 6, 7), (2, None, None, None, None, None, None)], ddl)
    got = langid.predict(df, langid.learn(df))
    assert got.columns == ["doc_id", "text", "lang", "_result", "x.y", "lang_pred", "score"]
    assert sorted((r["doc_id"], r["lang_pred"], r["_result"], r["x.y"]) for r in got.where("doc_id = 1").collect()) == [(1, "aa", 6, 7)] * 2
    assert got.where("doc_id = 2").first()["lang_pred"] == "und"


def test_ordinal_regression(spark):
    rng = random.Random(8)
    mixed = lambda good: " ".join(rng.choice(["fine", "text", "words", "here"]) for _ in range(20)) + good
    data = []
    for i in range(600):
        g = i % 3
        data.append((i, mixed(["  vile nasty", " spam!! spam!! spam!!", ""][g]), "l", "s", 0))
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(450)] + [(None, 1, 0), (451, None, None), (10_000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    test = [(i, i % 3, got[i]) for i in range(450, 600)]
    assert all((r["tail_probability"] >= quality.KEEP_PROBABILITY) == (g == 2) for _, g, r in test)
    means = [np.mean([r["expected_grade"] for _, g, r in test if g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id % 3 < 2 and doc_id >= 450").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "w " * 100_000)], "doc_id long, text string")
    assert quality.score(odd, model).count() == 3
    nothing = quality.fit(docs, labels.where("false"))
    assert quality.keep_good(docs, nothing).count() == 600 and quality.keep_good(docs.where("false"), model).count() == 0


def mixed(spark, data, **target):
    return mixing.mix(spark.createDataFrame(data, DOCS + ", weight double, rank int"), mixing.Target(**target))


def test_mixing_meets_its_weights(spark):
    rng = random.Random(4)
    data = [(i, "w " * rng.randint(1, 30), None, "big" if i % 10 < 7 else ("mid" if i % 10 < 9 else None), 0, 0.5, 1) for i in range(4000)]
    got = mixed(spark, data, max_repeats=2.0).collect()
    passes, tokens, weight = {}, {}, {}
    for r in got:
        s = r["source"]
        tokens[s] = tokens.get(s, 0) + r["mix_tokens"]
        weight[s] = r["mix_weight"]
        passes[r["doc_id"]] = passes.get(r["doc_id"], 0) + 1
    assert len(passes) == 4000 and set(passes.values()) == {1, 2}
    total = sum(tokens.values())
    assert abs(sum(weight.values()) - 1) < 1e-9 and all(abs(tokens[s] / total - weight[s]) < 0.01 for s in tokens)
    # the partial pass stays within its budget: twice the tokens at most for the rarest
    rare = sum(r["mix_tokens"] for r in got if r["source"] is None and r["mix_pass"] == 1)
    assert tokens[None] <= 2 * rare + 1 and tokens[None] > 1.9 * rare
    assert all(r["mix_pass"] == 1 for r in got if r["source"] == "big")
    one = {(r["mix_pass"], r["mix_rank"]) for r in got}
    assert len(one) > 100


def test_exponent(spark):
    sizes = [8000.0, 1000, 1000]
    totals = spark.createDataFrame([(str(i), int(t)) for i, t in enumerate(sizes)], "_s string, tokens long")

    def entropy(a):
        w = np.array(sizes) ** a
        w /= w.sum()
        return float(-(w * np.log(w)).sum() / np.log(3))

    fit = lambda **target: mixing.fit_exponent(totals, mixing.Target(**target))
    a = fit(entropy=0.9, max_repeats=1e9)
    assert abs(entropy(a) - 0.9) < 1e-8
    # the flatter of the two targets can't be had: the repetition limit wins
    b = fit(entropy=1.0, max_repeats=2.0)
    assert abs(8 ** (1 - b) - 2) < 1e-9 and fit(max_repeats=2.0) == b
    assert fit(entropy=0.1, max_repeats=4.0) > 0.999 and fit(max_repeats=100) == 0.0 and fit(max_repeats=1) > 1 - 1e-9
    assert mixing.fit_exponent(totals.where("_s = '0'"), mixing.Target()) == 1.0
    assert mixing.fit_exponent(totals.where("_s > '0'"), mixing.Target(entropy=0.5)) == 1.0


def test_bisection_asks_for_several_halvings_at_once():
    asked = []

    def below(at):
        asked.append(len(at))
        return [x < 0.3 for x in at]

    for at_once in (1, 4):
        asked.clear()
        assert abs(mixing.bisect(0.0, 1.0, below, 40, at_once) - 0.3) < 1e-11
        assert asked == [2**at_once - 1] * (40 // at_once)


def test_mixing_of_clashing_columns(spark):
    ddl = DOCS + ", mix_pass string, MIX_RANK int, rank int, weight double, _row int, _s string, `a.b` int"
    df = spark.createDataFrame([(i, "w x", "l", "s", 0, "old", 7, i, 0.5, 3, "t", 4) for i in range(9)], ddl)
    got = mixing.mix(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "weight", "_row", "_s", "a.b", *mixing.MIXED]
    assert sorted((r["doc_id"], r["rank"], r["weight"], r["_row"], r["_s"], r["a.b"], r["mix_pass"]) for r in got.collect()) == [(i, i, 0.5, 3, "t", 4, 1) for i in range(9)]


def test_more_rows_make_more_blocks(spark):
    df = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    _, bits = mixing.plan(df.limit(300), mixing.Target())
    decided, more = mixing.plan(df.withColumn("source", F.when(F.col("doc_id") < 60_000, "s").otherwise("t")), mixing.Target())
    assert (bits, more) == (mixing.LEAST_BITS, 8) and decided.count() <= 512
    assert min(mixing.BLOCK_BITS, (10**9).bit_length() // 2) == 15


def test_mixing_of_odd_tables(spark):
    data = [(1, None, None, "a", None, None, None), (None, "x y", None, None, None, None, None), (2, "", None, "b", 0, None, None), (3, "p q r", None, "c", 0, None, None), (3, "p q r", None, "c", 0, None, None)]
    got = mixed(spark, data).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["mix_pass"] == 1) == ["1", "2", "3", "3", "None"]
    assert mixed(spark, []).count() == 0


def likeness(spark, a, b):
    df = spark.createDataFrame([(a, b, 1, 2)], "a array<int>, b array<int>, marks_near int, level_near_0 int")
    got = imatch.with_likeness(df, {"near": ("a", "b")})
    assert got.columns == [*df.columns, "near"]
    return got.first()["near"]


def test_likeness(spark):
    rest = [0] * imatch.SUBSETS
    blank = rest * imatch.LEVELS
    some = [7] * 4 + blank[4:]
    assert likeness(spark, some, some) == 1 and likeness(spark, blank, blank) == 1 and likeness(spark, some, blank) == 0
    assert likeness(spark, some, [7] * 2 + [8] * 2 + blank[4:]) == 0.5
    # a full level counts for little beside a half-filled one
    got = likeness(spark, [2] * 32 + [5] * 16 + [0] * 16 + rest, [1] * 32 + [5] * 8 + [6] * 8 + [0] * 16 + rest)
    assert abs(got - 0.5 * 16 * 17 / (16 * 17 + 32)) < 1e-12


def test_lexicon_holds_what_it_was_given(spark):
    rng = random.Random(3)
    data = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)] + [0, -1, 1, 2, 3]
    for given in (data[:1500] + data[-5:-2], data[:1], [], [0]):
        lex = imatch.Lexicon.of(given)
        assert set(given) <= set(lex.slots)
        got = spark.createDataFrame([(data,)], "h array<long>").select(F.filter("h", lex.holds)).first()[0]
        assert got == [h for h in data if h in set(given)]


def test_next_rows_of_a_hot_key(spark):
    # one key holds a third of the rows; it is cut into several ranges, and order still goes by the text's hash
    data = [(i if i % 3 else 7, f"text number {i}") for i in range(600)]
    df = spark.createDataFrame(data, "key long, text string").withColumn("tie", F.xxhash64("text"))
    dealt, order = imatch.with_next(df, ["text"], 30)
    got = dealt.select("*", F.lead("text").over(order).alias("next")).where("not ghost").collect()
    rows = sorted(got, key=lambda r: (-r["key"], r["tie"]))
    assert len(rows) == 600 and [r["next"] for r in rows] == [r["text"] for r in rows[1:] + rows[:1]]
    assert len({r["range"] for r in got if r["key"] == 7}) > 5


def test_imatch_edits_in_key_order(spark):
    rng = random.Random(9)
    vocab = [f"term{i}" for i in range(5000)]
    texts = {i: " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 60, 300]))) + " é🙂" for i in rng.sample(range(-500, 500), 120)}
    texts[501] = texts[max(texts)]
    data = [(k, v, "x", 1, 2) for k, v in texts.items()] + [(None, None, None, None, None)]
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string, fingerprint string, key int, tie int").repartition(5)).collect()}
    order = sorted(texts, reverse=True) + [None]
    texts[None] = ""
    assert len(got) == len(order)
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = texts[a], texts[b]
        third = len(t) // 3
        edited = t[: len(t) - third] + n[:third]
        assert got[a]["n_chars"] == len(t) and got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[a]["near_edited"] <= 1 and 0 <= got[a]["near_next"] <= 1
    assert got[501]["fingerprint"] == got[order[1]]["fingerprint"] and got[501]["near_next"] == 1
    some = [r for r in got.values() if r["n_chars"] > 300 and r["doc_id"] != 501]
    assert np.mean([r["near_edited"] for r in some]) > 3 * np.mean([r["near_next"] for r in some])


@pytest.mark.parametrize("data", [[], [(1, "only one text here")], [(None, "a"), (None, "b"), (None, None)], [(5, "same"), (5, "same"), (5, "other")]])
def test_imatch_of_odd_tables(spark, data):
    got = imatch.edited_fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == len(data)
    if len(data) == 1:
        t = data[0][1]
        assert got[0]["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 3] + t[: len(t) // 3]).encode()).hexdigest() and got[0]["near_next"] == 1


def test_imatch_plan_is_native(spark):
    df = imatch.edited_fingerprints(spark.createDataFrame([(i, f"word{i} text") for i in range(20)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
