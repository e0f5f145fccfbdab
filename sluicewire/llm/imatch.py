"""I-Match document fingerprints with randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms within a band of inverse document frequency over all documents. Terms
are letter and digit runs in lower case, told apart by 64-bit hashes and counted exactly. An in-band
term is in at least ``MIN_SHARE`` of the documents, so there are at most the mean number of distinct
terms of a document over ``MIN_SHARE`` of them, however many documents there are; expressions carry
them as one table.

A text's distinct in-band terms are sorted and dealt by hash over ``SUBSETS`` random subsets of the
lexicon on each of ``LEVELS`` levels; the sorted terms of each are hashed to 16 bits. The subsets of
a level are disjoint and random, so one edited term changes one digest a level, and not all as one
hash of the whole lexicon would. A level draws one eighth of the lexicon of the one before: an edit
leaves few of a long text's subsets of many terms alone, but many of those of few. The fingerprint
is the digests of all levels, four hex digits each. A text without an in-band term has the blank one,
all zeros.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, named, shuffle_partitions, spare

#: The band: terms in at least and at most such shares of the documents (idf of 6.2 and 3.0).
MIN_SHARE, MAX_SHARE = 0.002, 0.05
SUBSETS, LEVELS, LEVEL_BITS = 32, 3, 3


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text, unsorted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


@dataclass(frozen=True)
class Lexicon:
    """Term hashes in a cuckoo table: ``h`` is at ``h % n``, or at ``n + h % (n + 1)``, or nowhere.

    A free slot holds a number that belongs elsewhere, so a lookup is exact.
    """

    n: int
    slots: list[int]

    @classmethod
    def of(cls, found: list[int]) -> Lexicon:
        n = max(2, 6 * len(found) // 5)
        while (slots := cls._place(found, n)) is None:
            n += n // 4 + 1
        return cls(n, slots)

    @staticmethod
    def _place(found: list[int], n: int) -> list[int] | None:
        """All of ``found`` in a table, or None if they push each other around for too long."""
        held: list[int | None] = [None] * (2 * n + 1)
        for h in found:
            second, moves = False, 0
            while h is not None:
                at = n + h % (n + 1) if second else h % n
                h, held[at] = held[at], h
                second, moves = at < n, moves + 1
                if moves > 500:
                    return None
        return [i + 1 - (n if i >= n else 0) if h is None else h for i, h in enumerate(held)]

    def holds(self, h: Column) -> Column:
        """Whether the lexicon has a term; its table becomes a literal of the plan."""
        table = F.from_json(F.lit(json.dumps(self.slots)), "array<bigint>")
        first, second = F.pmod(h, F.lit(self.n).cast("long")), F.pmod(h, F.lit(self.n + 1).cast("long")) + self.n
        return (F.get(table, first.cast("int")) == h) | (F.get(table, second.cast("int")) == h)


def lexicon(df: DataFrame, text: str = "text") -> Lexicon:
    """The terms whose document frequency is in the band."""
    n = df.count()
    low = max(1.0, MIN_SHARE * n)
    high = max(MAX_SHARE * n, low + 1)
    counts = df.select(F.explode(terms(named(text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # bounded by the mean number of a document's terms, see above
    return Lexicon.of([r[0] for r in counts.where(F.col("df").between(low, high)).select("h").collect()])


def _level(found: Column, level: int) -> Column:
    mask = F.lit((1 << (LEVEL_BITS * level)) - 1).cast("long")
    return F.filter(found, lambda h: F.shiftrightunsigned(h, 50).bitwiseAND(mask) == 0) if level else found


#: A term's code: its subset in the five bits below the sign, and the low bits of its hash.
CODE_BITS = 58
_LOW = (1 << CODE_BITS) - 1


def _code(h: Column) -> Column:
    subset = F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(SUBSETS - 1).cast("long"))
    return F.shiftleft(subset, CODE_BITS).bitwiseOR(h.bitwiseAND(F.lit(_LOW).cast("long")))


def _digest(part: Column) -> Column:
    """16 bits of a subset's sorted terms: 0 without a term, else from 1 on."""
    return F.when(F.length(part) < 2, 0).otherwise(F.greatest(F.lit(1), F.shiftrightunsigned(F.xxhash64(part), 48).cast("int")))


def _digests(found: Column) -> Column:
    """One digest for each subset of an array of distinct term hashes.

    Codes sort by subset, then term. A code without low bits marks where each subset begins, so the
    sorted terms are written out once, cut at the marks, and hashed part by part.
    """
    marks = F.array(*[F.lit(s << CODE_BITS).cast("long") for s in range(SUBSETS)])
    codes = F.sort_array(F.concat(F.transform(found, _code), marks))
    written = F.array_join(F.transform(codes, lambda c: F.when(c.bitwiseAND(F.lit(_LOW).cast("long")) == 0, "!").otherwise(F.hex(c))), ",")
    return F.transform(F.slice(F.split(written, "!"), 2, SUBSETS), _digest)


def fingerprint_of(found: Column) -> Column:
    """The digests of all levels, as an array of ints, of an array of distinct in-band term hashes."""
    return F.concat(*[_digests(_level(found, level)) for level in range(LEVELS)])


def text_of(digests: Column) -> Column:
    """A fingerprint as text: four hex digits a digest."""
    return F.lower(F.array_join(F.transform(digests, lambda d: F.lpad(F.hex(d), 4, "0")), ""))


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with how far two columns of digests agree, 0 to 1, for each name of ``pairs``; equal ones are 1.

    A level's share is that of its subsets with equal digests among those with a term of either
    text. Levels are averaged with the weight ``used * (SUBSETS + 1 - used)``: one whose subsets are
    nearly all filled, or nearly all blank, tells little. A blank fingerprint is like a blank one only.
    """
    # 0 unused, 1 different, 2 equal; compared once, then counted for each level
    marked = {name: spare(df.columns, f"marks_{name}") for name in pairs}
    out = df.select("*", *[F.zip_with(named(a), named(b), lambda x, y: F.when(x != y, 1).when(x == 0, 0).otherwise(2)).alias(marked[name]) for name, (a, b) in pairs.items()])
    counted = {(name, level): spare(df.columns, f"level_{name}_{level}") for name in pairs for level in range(LEVELS)}

    def count(marks: Column, level: int) -> Column:
        of = F.slice(marks, level * SUBSETS + 1, SUBSETS)
        blank = F.size(F.filter(of, lambda m: m == 0))
        return F.struct((F.lit(SUBSETS) - blank).alias("used"), F.size(F.filter(of, lambda m: m == 2)).alias("equal"))

    out = out.select("*", *[count(F.col(marked[name]), level).alias(c) for (name, level), c in counted.items()])

    def average(name: str) -> Column:
        of = [F.col(counted[name, level]) for level in range(LEVELS)]
        shares = sum((x["equal"] * (SUBSETS + 1 - x["used"]) for x in of), F.lit(0))
        weights = sum((x["used"] * (SUBSETS + 1 - x["used"]) for x in of), F.lit(0))
        a, b = pairs[name]
        return F.when(named(a) == named(b), 1.0).when(weights > 0, shares / weights).otherwise(0.0).cast("double")

    return out.select(*map(named, df.columns), *[average(name).alias(name) for name in pairs])


def with_fingerprint(df: DataFrame, text: str, out: str, terms_of: Lexicon) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as ``out``; a null or blank text has the blank one."""
    found = spare(df.columns, "found")
    # a column of its own: the terms are found once, not once a level
    held = df.select("*", F.filter(terms(F.coalesce(named(text), F.lit(""))), terms_of.holds).alias(found))
    return held.select(*map(named, df.columns), fingerprint_of(F.col(found)).alias(out))


def _ranked(key: Column, splits: list[int]) -> Column:
    """How many of the increasing ``splits`` are at most ``key``, by binary search; null: 0."""
    if not splits:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(splits)), "array<bigint>")
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= len(splits)) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def with_next(df: DataFrame, carry: list[str], ranges: int) -> tuple[DataFrame, Window]:
    """(key, tie, ...) dealt into ranges, each with a copy of the row that follows it, and a window in descending key order.

    Nulls come last, ties go by ``tie``. Rows with ``ghost`` are the copies: the first row of the
    next range down, or of the top one after the last. So a lead over the window gives every real
    row its follower, and rows are shuffled once. Ranges are cut at quantiles of the key; a key that
    covers several of them is cut further by ``tie``.
    """
    probs = [i / ranges for i in range(1, ranges)]
    points = df.agg(F.percentile_approx("key", probs, max(10_000, 10 * ranges)).alias("p")).first()["p"] if probs else None
    splits = Counter(points or [])
    hot = [F.struct(F.lit(k).cast("long").alias("k"), F.lit(n).alias("n")) for k, n in splits.items() if n > 1]
    parts = F.coalesce(F.get(F.transform(F.filter(F.array(*hot), lambda x: x["k"] == F.col("key")), lambda x: x["n"]), F.lit(0)), F.lit(1)) if hot else F.lit(1)
    part = F.least((((F.col("tie") / F.lit(2.0**64)) + 0.5) * parts).cast("int"), parts - 1)
    # ascending in the window's order
    place = (F.lit(len(splits)) - _ranked(F.col("key"), sorted(splits))) * ranges + part
    order = F.struct(F.col("key").isNull().alias("none"), F.bitwise_not("key").alias("down"), F.col("tie"))
    ranged = df.select("*", place.cast("long").alias("range"))
    # one row for each range
    firsts = sorted((r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.min(order).alias("first")).collect())
    ghosts = [(here, *first, firsts[i - 1][0]) for i, (here, first) in enumerate(firsts)]
    table = df.sparkSession.createDataFrame(ghosts, "f_range long, none boolean, down long, f_tie long, to long")
    same = (F.col("range") == F.col("f_range")) & F.bitwise_not("key").eqNullSafe(F.col("down")) & (F.col("tie") == F.col("f_tie"))
    both = ranged.join(F.broadcast(table), same, "left").select("key", "tie", *carry, "range", "to")
    here = F.struct(F.col("range").alias("r"), F.lit(False).alias("g"))
    there = F.struct(F.col("to").alias("r"), F.lit(True).alias("g"))
    dealt = both.select("key", "tie", *carry, F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x"))
    return dealt.select("key", "tie", *carry, F.col("x.r").alias("range"), F.col("x.g").alias("ghost")), Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("key"), "tie")


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has its last third (in code points, rounded down) replaced by the start of the
    next document's, in descending key order, null keys last, ties by the text's hash; after the
    last comes the first. Null texts are empty. Texts of any length are read whole. Repeated rows
    stay, and follow each other. Other columns are not read, whatever their names. An empty table
    gives no rows.
    """
    body = F.coalesce(named(text), F.lit(""))
    docs = df.select(named(key).cast("long").alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"))
    found = lexicon(docs)
    dealt, order = with_next(with_fingerprint(docs, "text", "own", found), ["text", "own"], 16 * shuffle_partitions(df.sparkSession))
    following = dealt.select("key", "ghost", "text", "own", F.lead(F.struct("text", "own")).over(order).alias("next")).where(~F.col("ghost"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = following.select("key", "own", F.col("next.own").alias("after"), n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third)).alias("edited"))
    rows = with_fingerprint(edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "new", found)
    rows = with_likeness(rows.select("key", "n_chars", "edited_sha256", "own", "after", "new"), {"near_edited": ("own", "new"), "near_next": ("own", "after")})
    return rows.select(F.col("key").alias(key), "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("new")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of all ``documents``; see :func:`edited_fingerprints` for nulls, ties, repeats and the rest."""
    return edited_fingerprints(documents(spark, sf_dir))
