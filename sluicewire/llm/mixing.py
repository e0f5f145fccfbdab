"""Mixing sources to target weights by temperature.

Weights are the sources' token shares to a power between 0 (uniform) and 1 (as they are), found by
bisection: the least power that keeps to the repetition limit (the most repeated source's passes
over the least repeated one's), and, with a target entropy, the largest from there on that reaches
it. Weights are realised without losing a document: the least repeated source passes once, others
more often, and the last, partial pass of a source takes blocks of documents in a permuted order up
to its token budget.

Whole blocks are decided from a table of block sums; only the one block in which a budget ends
looks at its documents. A source has about as many blocks as the square root of the number of rows,
so a source's blocks and a block's documents both stay few beside the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD, documents, durable, named
from .tokens import word_tokenizer

#: Bits of a document's block number, and the fewest that are used.
BLOCK_BITS, LEAST_BITS = 20, 8
#: A plan of at most so many rows (a few MB) is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 50_000
MAX_REPEATS = 1.5
SEED = 17


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(ASCII_WORD)), F.lit(0)).cast("long")


def id_count(text: Column) -> Column:
    """Ids of the tokenizer that packing uses; null has none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = word_tokenizer()
        for texts in batches:
            yield pa.array([len(tokenizer.encode(t.as_py() or "")) // 4 for t in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)


@dataclass(frozen=True)
class Target:
    """``entropy``: of the weights, as a part (0 to 1) of that of uniform ones; None for no target."""

    entropy: float | None = None
    max_repeats: float = MAX_REPEATS


def bisect(lo: float, hi: float, below: Callable[[list[float]], list[bool]], halvings: int = 48, at_once: int = 1) -> float:
    """Where ``below``, true from ``lo`` up to somewhere, turns false on the way to ``hi``, by halving.

    ``below`` is asked for all the middles that ``at_once`` halvings may come to in one call.
    """
    for _ in range(0, halvings, at_once):
        parts = 1 << at_once
        middles = [lo + (hi - lo) * i / parts for i in range(1, parts)]
        low = below(middles)
        first, last = 0, parts
        while last - first > 1:
            middle = (first + last) // 2
            first, last = (middle, last) if low[middle - 1] else (first, middle)
        lo, hi = lo + (hi - lo) * first / parts, lo + (hi - lo) * last / parts
    return lo


def fit_exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for ``totals`` (tokens > 0 for each source). Fewer than two sources, or equal ones: 1."""
    base = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("all"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if base["n"] < 2 or base["most"] == base["least"]:
        return 1.0
    spread = math.log(base["most"] / base["least"])
    limit = math.log(max(1.0, target.max_repeats))
    # passes of the most repeated source over those of the least: (most / least) ** (1 - a), which falls with a
    repeats = lambda at: [(1 - a) * spread > limit for a in at]
    floor = 0.0 if not repeats([0.0])[0] else bisect(0.0, 1.0, repeats)
    if target.entropy is None:
        return floor
    p = F.log(F.col("tokens") / F.lit(1.0)) - math.log(base["all"])

    def enough(at: list[float]) -> list[bool]:
        aggs = [x for i, a in enumerate(at) for x in (F.sum(F.exp(p * a)).alias(f"z{i}"), F.sum(F.exp(p * a) * p * a).alias(f"s{i}"))]
        r = totals.agg(*aggs).first()
        return [(math.log(r[f"z{i}"]) - r[f"s{i}"] / r[f"z{i}"]) / math.log(base["n"]) >= target.entropy for i in range(len(at))]

    # entropy falls as the power grows; four halvings a job
    return floor if not enough([floor])[0] else bisect(floor, 1.0, enough, 32, 4)


def _source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _keyed(df: DataFrame, key: str, text: str, source: str, tokens: Column | None = None) -> list[Column]:
    k = F.coalesce(named(key).cast("string"), F.lit(""))
    return [
        _source_key(named(source)).alias("_s"),
        F.shiftrightunsigned(F.xxhash64(k, F.xxhash64(named(text)), F.lit(SEED)), 64 - BLOCK_BITS).cast("int").alias("_bits"),
        F.xxhash64(k, F.xxhash64(named(text)), F.lit(SEED + 1)).alias("_u"),
        (token_count(named(text)) if tokens is None else tokens).alias("_tokens"),
    ]


def block_of(bits: int) -> Column:
    """The block of a document, if ``bits`` of its number tell blocks apart."""
    return F.shiftright("_bits", BLOCK_BITS - bits).alias("_block")


def plan(df: DataFrame, target: Target, key: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None) -> tuple[DataFrame, int]:
    """For each source and block: weight, passes (whole ones), extra (all, none, or those with ``_u <= cut``), rank; and the bits of a block."""
    # four numbers and a source a document; counted once
    rows = durable(df.select(*_keyed(df, key, text, source, tokens)))
    bits = min(BLOCK_BITS, max(LEAST_BITS, rows.count().bit_length() // 2))
    rows = rows.select("_s", block_of(bits), "_u", "_tokens")
    blocks = durable(rows.groupBy("_s", "_block").agg(F.sum("_tokens").alias("t")))
    totals = blocks.groupBy("_s").agg(F.sum("t").alias("tokens"))
    full = totals.where("tokens > 0")
    a = fit_exponent(full, target)
    # passes relative to the least repeated source: (share / greatest share) ** (a - 1)
    norm = full.agg(F.max("tokens").alias("most"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z")).first()
    most, z = float(norm["most"] or 1), float(norm["z"] or 1)
    tokens = F.col("tokens").cast("double")
    per_source = totals.select(
        "_s",
        F.when(F.col("tokens") > 0, F.pow(tokens, F.lit(a)) / z).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.pow(tokens / most, F.lit(a - 1))).otherwise(1.0).alias("epochs"),
        "tokens",
    ).select("_s", "weight", F.floor(F.col("epochs") + 1e-9).cast("int").alias("passes"), F.greatest(F.lit(0).cast("long"), F.round((F.col("epochs") - F.floor(F.col("epochs") + 1e-9)) * F.col("tokens")).cast("long")).alias("budget"))
    order = Window.partitionBy("_s").orderBy(F.xxhash64("_s", "_block", F.lit(SEED + 2)), "_block")
    ranked = blocks.join(per_source, "_s").select("*", F.row_number().over(order).alias("rank"), F.coalesce(F.sum("t").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    decided = ranked.withColumn("extra", F.when(F.col("budget") <= F.col("before"), "none").when(F.col("before") + F.col("t") <= F.col("budget"), "all").otherwise("part"))
    decided = durable(decided)
    # the one block of a source in which its budget ends: its documents in hash order, as far as they fit
    ends = decided.where("extra = 'part'").select("_s", "_block", (F.col("budget") - F.col("before")).alias("left"))
    edge = rows.join(_small(ends), ["_s", "_block"])
    so_far = F.sum("_tokens").over(Window.partitionBy("_s", "_block").orderBy("_u").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = edge.select("_s", "_block", "_u", "left", so_far.alias("c")).where(F.col("c") <= F.col("left")).groupBy("_s", "_block").agg(F.max("_u").alias("cut"))
    return durable(decided.join(cuts, ["_s", "_block"], "left").select("_s", "_block", "weight", "passes", "extra", "cut", "rank")), bits


def _small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is found to have at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


MIXED = ("mix_weight", "mix_pass", "mix_rank", "mix_tokens")


def mix(df: DataFrame, target: Target | None = None, key: str = "doc_id", text: str = "text", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """The rows of ``df``, each once for every pass that takes it, with mix_weight, mix_pass, mix_rank, mix_tokens.

    ``tokens`` counts those of a row; without it they are words between ASCII white space.
    Order by (mix_pass, mix_rank) within a source to follow its block permutations. Every row is in
    at least one pass; the partial pass never exceeds its budget; rows equal in key and text go
    together, and repeated rows stay. Null sources are a source; null and empty texts have no tokens;
    a source without tokens passes once at weight 0; sources of equal size get equal weights. A text
    of any length is counted whole. An input column named like one of the four results gives way to
    it; all others keep name and values. An empty table gives no rows.
    """
    decided, bits = plan(df, target or Target(), key, text, source, tokens)
    rest = [c for c in df.columns if c.lower() not in MIXED]
    rows = df.select(F.struct(*map(named, rest)).alias("_row"), *_keyed(df, key, text, source, tokens)).withColumn("_block", block_of(bits)).join(_small(decided), ["_s", "_block"])
    more = F.when(F.col("extra") == "all", 1).when((F.col("extra") == "part") & (F.col("_u") <= F.col("cut")), 1).otherwise(0)
    taken = rows.select("_row", "weight", F.explode(F.sequence(F.lit(1), F.col("passes") + more)).alias("pass"), "rank", "_tokens")
    return taken.select("_row.*", *[F.col(c).alias(name) for c, name in zip(("weight", "pass", "rank", "_tokens"), MIXED, strict=True)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed at the repetition limit; see :func:`mix` for nulls, ties, repeats and the rest."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 9).alias("weight"), F.col("mix_pass").alias("pass"), F.col("mix_rank").alias("block_rank"))
