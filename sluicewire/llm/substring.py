"""Substring deduplication by compacting a sampled token De Bruijn graph.

The graph's edges are token k-mers in their surroundings. Of the k-mers inside each window of
``window`` tokens the one of least hash is taken (so equal windows take equal k-mers, and no repeated
window is without one), and an edge is such a k-mer with the tokens that windows through it can reach:
up to ``window - k`` before and after it. Successor edges are those of a document's next k-mer. All
k-mers can't be edges: their rows alone would be several times the corpus.

- K-mers of one document only are dropped: nothing repeats there.
- An edge whose every occurrence is followed by the same edge, at the same distance, which occurs
  nowhere else, doesn't branch there. A join of edges with their successors finds these links, and
  runs of linked edges are compacted to one path, a row with its first edge, number of edges and first
  source. All sources of an edge run through its whole path, so a later source needs one row a path.
- Where the surroundings of a k-mer branch, the first source of each of its edges lists its windows
  one by one, and a join on the windows finds those that an earlier document also has.

Each path is then verified at its coordinates in its first and its later sources: the tokens of both,
digested to 128 bits, must be the same. Windows are compared by 128 bits of hash. Verified paths
and windows are laid on each document, and where they overlap they merge into the long repeated
spans that are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, durable, holds, named, remove, spare, split_join, written

WINDOW, K = 50, 12
#: Bits of the distance to the next k-mer, below the position in ``place``.
GAP_BITS = 20
#: Word hashes remembered by one worker.
REMEMBERED = 500_000
_M64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(15, n.bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(b, len(p), 1 << 64))])
            both.append(p)
        have = _powers[base] = (both[0], both[1])
    return have


class _Words(dict):
    """Hashes of words; those not seen before are computed, and remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _forget() -> None:
    _words.clear()
    _powers.clear()


class Rolling:
    """Hashes of any stretches of a token sequence in constant time each."""

    def __init__(self, tokens: np.ndarray, base: int):
        power, self.back = _powers_of(base, len(tokens) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * power[: len(tokens)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.back[start])


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


class Scan:
    """A document's sampled k-mers and the edges that they are.

    ``at``: token positions of the k-mers; ``kmer`` their hashes; ``lo``, ``hi``: the bounds of their
    surroundings; ``edge``: the hash of these; ``least``: each window's k-mer hash.
    """

    def __init__(self, words: list[bytes], window: int, k: int):
        n, reach = len(words), window - k + 1
        first = word_hashes(words)
        self.words, self.n, self.window, self.first = words, n, window, first
        roll = Rolling(first, _BASES[0])
        self.roll = roll
        start = np.arange(n - k + 1)
        kmer = roll.of(start, start + k)
        self.least = _slide(kmer, reach, np.minimum)
        pad = np.zeros(reach - 1, np.uint64)
        self.at = np.flatnonzero(_slide(np.concatenate([pad, self.least, pad]), reach, np.maximum) == kmer)
        self.kmer = kmer[self.at]
        self.lo, self.hi = np.maximum(self.at + k - window, 0), np.minimum(self.at + window, n)
        self.edge = _mix(roll.of(self.lo, self.hi) + _mix((self.at - self.lo).astype(np.uint64) << np.uint64(32) | (self.hi - self.at).astype(np.uint64)))

    def successions(self) -> tuple[np.ndarray, ...]:
        """Distinct (edge, next edge, distance): k-mer, edge, next (0 at the end), first position and distance in one number, occurrences."""
        following = np.append(self.edge[1:], np.uint64(0))
        gap = np.append(np.diff(self.at), 0)
        _, one, n = np.unique(_mix(self.edge + _mix(following + gap.astype(np.uint64))), return_index=True, return_counts=True)
        return self.kmer[one], self.edge[one], following[one], self.at[one] << GAP_BITS | gap[one], n

    def spans(self, first: int, edges: int) -> list[tuple[int, int]]:
        """Where paths of so many edges that begin with the edge ``first`` lie."""
        at = np.flatnonzero(self.edge == np.uint64(first))
        return [(int(self.lo[i]), int(self.hi[i + edges - 1])) for i in at.tolist() if i + edges <= len(self.at)]

    def digest(self, lo: int, hi: int) -> tuple[int, int]:
        """128 bits of the tokens from ``lo`` to ``hi``, as signed longs."""
        raw = hashlib.blake2b(b" ".join(self.words[lo:hi]), digest_size=16).digest()
        return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)

    def windows_through(self, edges: np.ndarray) -> np.ndarray:
        """Starts of the windows whose k-mer is one of ``edges``."""
        chosen = np.zeros(len(self.least), dtype=bool)
        for i in np.flatnonzero(np.isin(self.edge, edges)).tolist():
            lo, hi = int(self.lo[i]), min(int(self.at[i]), len(self.least) - 1) + 1
            chosen[lo:hi] |= self.least[lo:hi] == self.kmer[i]
        return np.flatnonzero(chosen)

    def window_hashes(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each window."""
        other = Rolling(_mix(self.first + np.uint64(_BASES[1])), _BASES[1])
        return self.roll.of(start, start + self.window), other.of(start, start + self.window)

    def removed(self, paths: list[tuple[int, int, int, int]], windows: dict[int, int]) -> np.ndarray:
        """Which tokens are covered by verified paths (first edge, edges, digest) or by windows (hash and the other one) of an earlier document."""
        step = np.zeros(self.n + 1, dtype=np.int32)
        for first, edges, d1, d2 in paths:
            for lo, hi in self.spans(first % (1 << 64), edges):
                if self.digest(lo, hi) == (d1, d2):
                    step[lo] += 1
                    step[hi] -= 1
        if windows:
            w1, w2 = self.window_hashes(np.arange(len(self.least)))
            have1 = np.fromiter(windows, np.int64, len(windows)).view(np.uint64)
            have2 = np.fromiter(windows.values(), np.int64, len(windows)).view(np.uint64)
            order = np.argsort(have1)
            have1, have2 = have1[order], have2[order]
            place = np.minimum(np.searchsorted(have1, w1), len(have1) - 1)
            start = np.flatnonzero((have1[place] == w1) & (have2[place] == w2))
            np.add.at(step, start, 1)
            np.add.at(step, start + self.window, -1)
        return np.cumsum(step[:-1]) > 0


def _out(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in flat], schema=schema)


def _longs(names: str) -> tuple[str, pa.Schema]:
    return ", ".join(f"{x} long" for x in names.split()), pa.schema([(x, pa.int64()) for x in names.split()])


_EDGES_DDL, _EDGES = _longs("kmer edge next place n doc_id")
_FOUND_DDL, _FOUND = _longs("key other doc_id digest")


def _edges(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("words", _forget)
        for batch in batches:
            cols: list[list] = [[] for _ in _EDGES.names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if doc_id is None or len(words) < window:
                    continue
                found = Scan(words, window, k).successions()
                for c, x in zip(cols, (*found, np.full(len(found[0]), doc_id, np.int64)), strict=True):
                    c.append(x)
            yield _out(_EDGES, cols)

    return run


def _at_sources(window: int, k: int):
    """At the first sources: the windows of branching edges (``digest`` null), and the digests of paths (halves in ``other`` and ``digest``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("words", _forget)
        for batch in batches:
            keys, others, docs, digests = [], [], [], []
            for doc_id, text, branching, paths in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), strict=True):
                words = (text.as_py() or "").encode().split() if branching.is_valid or paths.is_valid else []
                if len(words) < window:
                    continue
                scan = Scan(words, window, k)
                if branching.is_valid and len(branching):
                    w1, w2 = scan.window_hashes(scan.windows_through(np.asarray(branching.values).view(np.uint64)))
                    w1, one = np.unique(w1, return_index=True)
                    keys.append(pa.array(w1.view(np.int64)))
                    others.append(pa.array(w2[one].view(np.int64)))
                    docs.append(pa.array(np.full(len(w1), doc_id, np.int64)))
                    digests.append(pa.nulls(len(w1), pa.int64()))
                rows = [(p["first"], *scan.digest(*spans[0])) for p in paths.as_py() or () if (spans := scan.spans(p["first"] % (1 << 64), p["edges"]))]
                if rows:
                    first, d1, d2 = zip(*rows, strict=True)
                    keys.append(pa.array(first, pa.int64()))
                    others.append(pa.array(d1, pa.int64()))
                    docs.append(pa.array(np.full(len(rows), doc_id, np.int64)))
                    digests.append(pa.array(d2, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([], pa.int64()), *c]) for c in (keys, others, docs, digests)], schema=_FOUND)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _lay(window: int, k: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("words", _forget)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n, gone = len(words), 0
                if found.is_valid and n >= window:
                    paths, windows = [], {}
                    key, edges, other, half = (found.values.field(i) for i in range(4))
                    for a, m, b, c in zip(key.to_pylist(), edges.to_pylist(), other.to_pylist(), half.to_pylist(), strict=True):
                        if m:
                            paths.append((a, m, b, c))
                        else:
                            windows[a] = b
                    removed = Scan(words, window, k).removed(paths, windows)
                    gone = int(removed.sum())
                    words = [w for w, r in zip(words, removed.tolist(), strict=True) if not r]
                kept = b" ".join(words)
                for c, x in zip(rows, (doc_id, n, gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _RESULT, strict=True)], schema=_RESULT)

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """(first, edges, source): the paths of ``edges`` (edge, n, next, gap, source, at), by their first edge, and their first source.

    ``next`` and ``gap`` are null where occurrences differ in them. An edge is linked to its successor
    if both occur equally often, for then no occurrence of the successor is behind another edge. Both
    have the same sources, and lie behind each other in the first; so runs of links are runs there.
    """
    after = edges.select(F.col("next").alias("edge"), F.col("n").alias("n_before"), F.col("edge").alias("before")).where("edge is not null")
    linked = edges.join(after, "edge", "left").select("edge", "source", "at", F.when((F.col("n_before") == F.col("n")) & (F.col("before") != F.col("edge")), F.col("before")).alias("before"))
    # two edges may have the same successor; then it occurs more often than either, and is linked to none
    one = linked.groupBy("edge", "source", "at").agg(F.max("before").alias("before"))
    order = Window.partitionBy("source").orderBy("at", "edge")
    begins = F.coalesce(F.col("before") != F.lag("edge").over(order), F.lit(True))
    runs = one.select("*", begins.cast("int").alias("begins")).select("*", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    return runs.groupBy("source", "run").agg(F.min_by("edge", F.struct("at", "edge")).alias("first"), F.count(F.lit(1)).cast("int").alias("edges")).select("first", "edges", "source")


def repeated_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, found): for each document its paths and windows that an earlier one has."""
    spark = docs.sparkSession
    place = written(docs.mapInArrow(_edges(window, k), _EDGES_DDL))
    rows = spark.read.parquet(place)
    repeated = rows.groupBy("kmer").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), (F.min("edge") < F.max("edge")).alias("branches")).where("d0 < d1").select("kmer", "branches")
    occur = durable(split_join(rows, repeated, ["kmer"]).drop("kmer"))
    remove(spark, place)
    gap = F.col("place").bitwiseAND(F.lit((1 << GAP_BITS) - 1).cast("long"))
    only = lambda a, c: F.when(F.min(c) == F.max(c), F.min(c)).alias(a)
    edges = durable(occur.groupBy("edge").agg(F.max("branches").alias("branches"), F.min(F.struct("doc_id", "place")).alias("begin"), F.max("doc_id").alias("last"), F.sum("n").alias("n"), only("next", F.col("next")), only("gap", gap)))
    shared = edges.where("begin.doc_id < last").select("edge", "n", F.when(F.col("gap").isNotNull() & (F.col("next") != 0), F.col("next")).alias("next"), F.col("begin.doc_id").alias("source"), F.col("begin.place").alias("at"))
    paths = durable(compacted(shared))
    sources = edges.where("branches").select(F.col("begin.doc_id").alias("doc_id"), F.col("edge").alias("branching"), F.lit(None).cast("struct<first:long,edges:int>").alias("path"))
    sources = sources.unionByName(paths.select(F.col("source").alias("doc_id"), F.lit(None).cast("long").alias("branching"), F.struct("first", "edges").alias("path")))
    # bounded by the document's own number of edges
    sources = sources.groupBy("doc_id").agg(F.collect_set("branching").alias("branching"), F.collect_list("path").alias("paths"))
    # an outer join, like that of the result, so that both read one exchange of the texts
    at_sources = docs.join(sources, "doc_id", "left").select("doc_id", "text", "branching", "paths").mapInArrow(_at_sources(window, k), _FOUND_DDL)
    # all that follows takes from this one exchange: hence one filter for all, and an array, out of which nobody's optimizer takes less
    at_sources = at_sources.where("key IS NOT NULL AND other IS NOT NULL").select("key", "other", F.array("doc_id", "digest").alias("of")).repartition("key", "other")
    doc_id, digest = F.get("of", F.lit(0)), F.get("of", F.lit(1))
    grouped = at_sources.groupBy("key", "other").agg(F.min(doc_id).alias("first"), F.max(doc_id).alias("last"), F.min(digest).alias("digest"))
    least = grouped.where("first < last AND digest IS NULL").select("key", "other", "first")
    again = at_sources.join(least, ["key", "other"]).select("*", doc_id.alias("doc_id")).where("doc_id > first").select("doc_id", F.struct("key", F.lit(0).alias("edges"), "other", F.lit(0).cast("long").alias("digest")).alias("f"))
    # rows that share a key may both have a path
    digests = grouped.where("digest IS NOT NULL").groupBy("key").agg(F.min(F.struct("other", "digest")).alias("d"))
    known = paths.join(digests, F.col("first") == F.col("key")).select("first", "edges", "source", "d")
    later = occur.select(F.col("edge").alias("first"), "doc_id").join(known, "first").where("doc_id > source").select("doc_id", F.struct(F.col("first").alias("key"), "edges", "d.other", "d.digest").alias("f"))
    # bounded by the document's own number of edges and windows
    return later.unionByName(again).groupBy("doc_id").agg(F.collect_set("f").alias("found"))


def remove_repeats(df: DataFrame, window: int = WINDOW, k: int = K, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The key, n_words, n_removed, kept: the words that stay, joined by one space (or, with ``digest``, their SHA-256).

    A word goes if a window of ``window`` words over it also starts in a document of a smaller key.
    Windows are judged on the input; copies inside a document don't count. Words end at ASCII white
    space. A null text has no words; a text of any length is read whole. Rows of a null key lose
    nothing and take nothing from others; rows that share a key count as one document. Repeated rows
    stay. Other columns are not read, whatever their names; a key that is called like a result makes
    way by an underscore at that result's name. An empty table gives no rows.
    """
    if not 0 < k <= window < 1 << GAP_BITS:
        raise ValueError("k must be between 1 and the window")
    docs = df.select(named(key).cast("long").alias("doc_id"), named(text).alias("text"))
    found = repeated_spans(docs, window, k)
    laid = docs.join(found, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(_lay(window, k, digest), "doc_id long, n_words long, n_removed long, kept string")
    return laid.select(F.col("doc_id").alias(key), *[F.col(c).alias(spare([key], c)) for c in ("n_words", "n_removed", "kept")])


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without repeats; see :func:`remove_repeats` for nulls, ties, repeats and the rest."""
    return remove_repeats(documents(spark, sf_dir), digest=True).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM docs, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM windows JOIN firsts USING (k), range(50) AS r(j) WHERE m < doc_id),
words AS (SELECT doc_id, p, ws[p] AS w FROM docs, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
