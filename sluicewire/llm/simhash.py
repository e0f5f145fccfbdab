"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within three bits of each other agree on at least two of five blocks of bits, so
each goes to the bucket of its bits in every pair of blocks. Inside a bucket fingerprints are
stored vertically: word ``w`` of plane ``p`` holds bit ``p`` of 64 members. A query's bits flip the
planes into difference planes, carry-save counters add these for 64 members at a time, and words
whose members have all passed the radius are abandoned. A bucket gives a spanning forest of its
links, never all pairs.

A bucket of more than ``LARGE`` members isn't compared but dealt again: the same holds for any other
cut of the 64 bits into five blocks, so its members go to the buckets of two more blocks, of another
cut. Each time two fifths of the bits that were still open are fixed, so after six times a bucket has
at most 2^9 distinct fingerprints, and its members are copied ten times each time, not once for
every part of the bucket.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, holds, named, split_join
from .graph import stars

BITS, RADIUS, WORDS = 64, 3, 3
#: Blocks of bits; two must agree, which gives C(5, 2) tables with keys of 25 bits or more.
BLOCKS = 5
#: Members of a bucket that are compared with each other; those of a larger one are dealt again.
LARGE = 2048
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint; a null text and one without words have zero."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else iter([b" ".join(words)])  # noqa: B905
    n, total = 0, np.zeros(BITS, dtype=np.int64)
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), shingles)
    while part := list(itertools.islice(hashed, 1 << 15)):
        h = np.array(part, dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _signed(texts: pa.Array) -> pa.Array:
    holds("simhash")
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    """A text column's fingerprints as signed longs."""
    return F.arrow_udf(_signed, "long")(text)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: How the bits are cut into blocks, time after time: bit ``b`` counts as the ``b * m % 64``-th of them.
CUTS = (1, 51, 15, 37, 61, 57)


def block(cut: int, bit: int) -> int:
    return bit * CUTS[cut] % BITS * BLOCKS // BITS


def block_masks(cut: int = 0) -> list[int]:
    """One mask for each two blocks of a cut, as signed longs."""
    blocks = [sum(1 << b for b in range(BITS) if block(cut, b) == i) for i in range(BLOCKS)]
    masks = [sum(x) for x in itertools.combinations(blocks, BLOCKS - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _over(planes: np.ndarray, query: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Lanes further than three bits from their query, for ``planes`` (64, w) and query (…, w) or (…, 1).

    ``alive`` (…, w) has the lanes in use. Words all of whose lanes are out are abandoned.
    """
    shape = alive.shape
    ones, twos, over = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), ~alive
    at, flat = None, False
    query = np.broadcast_to(query, shape)
    for p in range(BITS):
        d = (planes[p] if not flat else planes[p][at[-1]]) ^ (np.uint64(0) - (query >> np.uint64(p) & np.uint64(1)))
        c1 = ones & d
        ones = ones ^ d
        c2 = twos & c1
        twos = twos ^ c1
        over = over | c2
        if p % 16 == 15 and p < BITS - 1:
            live = np.nonzero(over != _FULL)
            if not live[0].size:
                break
            if 2 * live[0].size < over.size:
                # go on with the words that still matter
                if at is None:
                    out = np.full(shape, _FULL)
                else:
                    out[at] = over
                at = live if at is None else tuple(x[live[0]] for x in at)
                ones, twos, over, query, flat = ones[live], twos[live], over[live], query[live], True
    if at is None:
        return over
    out[at] = over
    return out


def _small_links(fps: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links in buckets of at most 64 members, one word each; ``fps`` has the buckets end to end."""
    start = np.cumsum(sizes) - sizes
    slot = np.arange(len(fps)) - np.repeat(start, sizes)
    lane = np.uint64(1) << slot.astype(np.uint64)
    planes = np.stack([np.bitwise_or.reduceat(np.where(fps >> np.uint64(p) & np.uint64(1), lane, np.uint64(0)), start) for p in range(BITS)])
    valid = np.bitwise_or.reduceat(lane, start)
    for s in range(int(sizes.max()) - 1):
        active = np.flatnonzero(sizes > s + 1)
        # members after the query only
        later = valid[active] & ~(np.uint64((1 << (s + 1)) - 1))
        near = ~_over(planes[:, active], fps[start[active] + s], later)
        for i in np.flatnonzero(near).tolist():
            base, bits = int(start[active[i]]), int(near[i])
            while bits:
                low = bits & -bits
                yield base + s, base + low.bit_length() - 1
                bits ^= low


def _forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Each linked index with its group's least."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _large_forest(fps: np.ndarray, block: int = 128) -> dict[int, int]:
    """The same for one bucket of any size: rows of near lanes as bit sets, then a search over them."""
    m = len(fps)
    w = -(-m // 64)
    lanes = np.zeros(w * 64, np.uint64)
    lanes[:m] = fps
    pack = lambda bits: np.packbits(bits, bitorder="little").view("<u8")
    planes = np.stack([pack((lanes >> np.uint64(p) & np.uint64(1)).astype(np.uint8)) for p in range(BITS)])
    valid = pack((np.arange(w * 64) < m).astype(np.uint8))
    near = np.concatenate([~_over(planes, fps[i : i + block, None], np.broadcast_to(valid, (len(fps[i : i + block]), w))) for i in range(0, m, block)])
    left, out = valid.copy(), {}
    for root in range(m):
        if not left[root >> 6] >> np.uint64(root & 63) & np.uint64(1):
            continue
        left[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        todo = [root]
        while todo:
            new = np.bitwise_or.reduce(near[todo], axis=0) & left
            left &= ~new
            todo = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little")).tolist()
            out.update(dict.fromkeys(todo, root))
    return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From buckets (``fps`` array<long>, distinct) to the edges of spanning forests."""
    for batch in batches:
        lists = batch.column("fps")
        off = np.asarray(lists.offsets, dtype=np.int64)
        values = np.asarray(lists.values).view(np.uint64)
        sizes = np.diff(off)
        small = np.flatnonzero((sizes > 1) & (sizes <= 64))
        found: list[tuple[np.ndarray, dict[int, int]]] = []
        if small.size:
            small = small[np.argsort(sizes[small], kind="stable")]
            fps = np.concatenate([values[off[i] : off[i + 1]] for i in small])
            found.append((fps, _forest(_small_links(fps, sizes[small]))))
        for i in np.flatnonzero(sizes > 64):
            fps = values[off[i] : off[i + 1]]
            found.append((fps, _large_forest(fps)))
        a = [fps[np.fromiter(f, np.int64, len(f))] for fps, f in found]
        b = [fps[np.fromiter(f.values(), np.int64, len(f))] for fps, f in found]
        if a:
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], schema=_EDGES)


def _dealt(rows: DataFrame, cut: int) -> DataFrame:
    """(mask, k, fp): the buckets of ``rows`` (mask, fp), whose bits of ``mask`` agree, by two more blocks."""
    masks = F.explode(F.array(*[F.col("mask").bitwiseOR(F.lit(m).cast("long")) for m in block_masks(cut)]))
    return rows.select(masks.alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct longs ``fp`` of ``fps`` as links within RADIUS bits do."""
    rows, out = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    for cut in range(len(CUTS)):
        keyed = _dealt(rows, cut)
        # written, as both joins below take from it; they are between plain exchanges, whose hot partitions Spark splits
        sizes = durable(keyed.groupBy("mask", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        last = cut == len(CUTS) - 1
        few = sizes if last else sizes.where(F.col("n") <= LARGE)
        buckets = keyed.join(few.select("mask", "k"), ["mask", "k"]).groupBy("mask", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
        found = buckets.mapInArrow(bucket_links, "a long, b long")
        out = found if out is None else out.unionByName(found)
        many = sizes.where(F.col("n") > LARGE).select("mask", "k")
        if last or many.isEmpty():
            return out
        # a member may come from several buckets of the same bits
        rows = durable(keyed.join(many, ["mask", "k"]).select("mask", "fp"))
    return out


def components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, tx, fp): the table (fp, first), with the component's least (doc_id, tx), and these alone.

    A null doc_id comes after all others.
    """
    reps = durable(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tx")).alias("rep")))
    tree = stars(links(reps.select("fp")))
    member = tree.unionByName(tree.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "fp")
    first = reps.join(member, "fp").groupBy("b").agg(F.min("rep").alias("first"))
    # a component may hold a third of all fingerprints
    of = durable(reps.join(split_join(member, first, ["b"]).select("fp", "first"), "fp", "left").select("fp", F.coalesce("first", "rep").alias("first")))
    return of, of.select("first").distinct()


def fingerprint_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return durable(df.select(named(key).cast("long").alias("doc_id"), F.xxhash64(named(text)).alias("tx"), fingerprints(named(text)).alias("fp")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    A null text and a text without words have fingerprint zero and are linked like others. A
    component's id is its smallest key (null only if it has no other). Texts of any length are read
    whole. Rows that tie (equal texts or fingerprints) are one component, and repeated rows stay.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = fingerprint_rows(df, key, text)
    of, _ = components(rows)
    return rows.join(of, "fp").select(F.col("doc_id").alias(key), hex_of(F.col("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each component, that with the least (key, hash of the text).

    Null keys come last; of rows equal in both, one stays. All columns of ``df`` stay as they are,
    whatever their names. Null, empty and very long texts are as in :func:`near_duplicates`. An empty
    table gives no rows.
    """
    _, first = components(fingerprint_rows(df, key, text))
    id0 = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias("id0")
    keep = first.select("first.none", id0(F.col("first.doc_id")), "first.tx")
    rows = df.select(F.struct(*map(named, df.columns)).alias("row"), named(key).cast("long").alias("id"), F.xxhash64(named(text)).alias("tx"))
    rows = rows.select("row", F.col("id").isNull().alias("none"), id0(F.col("id")), "tx")
    # one exchange of the texts serves both steps
    once = Window.partitionBy("none", "id0", "tx").orderBy(F.lit(1))
    single = rows.withColumn("n", F.row_number().over(once)).where("n = 1")
    return single.join(keep, ["none", "id0", "tx"], "left_semi").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents``; see :func:`near_duplicates` for nulls, ties, repeats and the rest."""
    return near_duplicates(documents(spark, sf_dir))
