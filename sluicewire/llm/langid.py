"""Language identification with bit-sliced Bloom filters of character n-grams.

Languages share tables, 64 a table: slot ``i`` holds a bit for each language, so the AND of the few
slots of an n-gram is the set of languages that contain it. A language contains an n-gram if at
least ``MIN_RATE`` of its own n-grams are that one; by that rule it has at most ``1 / MIN_RATE``,
whatever the corpus, which bounds the tables. A text's n-grams give each language a popcount; the
count expected from false positives (the language's fill to the power of the number of hashes) is
taken out, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, documents, durable, holds, named

#: Lengths of the n-grams, and the least share of a language's n-grams of a length.
SIZES = (3, 4)
MIN_RATE = 5e-5
SLOTS, HASHES = 1 << 21, 3
#: Languages that a table holds (bits of a mask); there are as many tables as the languages need.
GROUP = 64
UNKNOWN = "und"
#: Characters counted or scored together; bounds a worker's memory.
PART = 1 << 21
#: Texts times languages scored together, for the same end.
CELLS = 1 << 22


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), dtype=bool, count=0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points, with one space for each stretch of other characters, and at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")
    letter = _letters()[c]
    c = np.concatenate(([32], np.where(letter, c, 32), [32])).astype(np.uint64)
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]


def ngrams(c: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the n-grams of one length that don't bridge two words (a space only first or last)."""
    if len(c) < size:
        return np.zeros(0, np.uint64)
    n = len(c) - size + 1
    h = np.full(n, size, np.uint64)
    ok = np.ones(n, dtype=bool)
    for i in range(size):
        part = c[i : i + n]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        if 0 < i < size - 1:
            ok &= part != 32
    return _mix(h[ok])


def _parts(texts: Iterator[tuple[object, str]], most: int = PART) -> Iterator[list[tuple[object, np.ndarray]]]:
    held, size = [], 0
    for key, text in texts:
        c = code_points(text)
        held.append((key, c))
        size += len(c)
        if size >= PART or len(held) >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of n-grams, summed over parts of a partition."""
    for batch in batches:
        rows = ((lang, t.as_py()) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for part in _parts(rows):
            of: dict[str, list[np.ndarray]] = {}
            for lang, c in part:
                of.setdefault(lang, []).append(c)
            for lang, texts in of.items():
                for size in SIZES:
                    gram, n = np.unique(np.concatenate([ngrams(c, size) for c in texts]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), size)), pa.array(gram.view(np.int64)), pa.array(n)], schema=_COUNTS)


def slots_of(gram: np.ndarray) -> list[np.ndarray]:
    return [(gram * np.uint64(2 * i + 1) + _mix(gram + np.uint64(i)) >> np.uint64(24)) & np.uint64(SLOTS - 1) for i in range(HASHES)]


class Filters:
    """The learned ``tables`` (a mask for each slot): bit ``b`` of table ``g`` is language ``g * GROUP + b``.

    ``groups`` gives the n-grams of at most GROUP languages at a time, all in the order of their names.
    """

    def __init__(self, groups: Iterable[dict[str, np.ndarray]]):
        self.languages: list[str] = []
        self.tables: list[np.ndarray] = []
        fill: list[float] = []
        for grams in groups:
            kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(grams) <= np.iinfo(t).bits)
            table = np.zeros(SLOTS, kind)
            for bit, gram in enumerate(grams.values()):
                for at in slots_of(gram):
                    np.bitwise_or.at(table, at, kind(1 << bit))
            fill += [np.count_nonzero(table >> kind(b) & kind(1)) / SLOTS for b in range(len(grams))]
            self.languages += grams
            self.tables.append(table)
        self.false = np.array(fill) ** HASHES

    def containing(self, gram: np.ndarray, group: int = 0) -> np.ndarray:
        """For each n-gram the mask of the languages of a table that contain it (or seem to)."""
        return self._masks(slots_of(gram), group)

    def _masks(self, slots: list[np.ndarray], group: int) -> np.ndarray:
        out = None
        for at in slots:
            hit = self.tables[group][at]
            out = hit if out is None else out & hit
        return out

    def shares(self, part: list[np.ndarray]) -> np.ndarray:
        """Corrected shares (texts, languages) of the n-grams of each text."""
        count = np.zeros((len(part), len(self.languages)))
        total = np.zeros(len(part))
        for size in SIZES:
            grams = [ngrams(c, size) for c in part]
            n = np.array([len(g) for g in grams])
            slots = slots_of(np.concatenate(grams))
            total += n
            ends = np.concatenate(([0], np.cumsum(n)))
            for group, table in enumerate(self.tables):
                mask, kind = self._masks(slots, group), table.dtype.type
                for at in range(group * GROUP, min(len(self.languages), (group + 1) * GROUP)):
                    run = np.concatenate(([0], np.cumsum(mask >> kind(at % GROUP) & kind(1), dtype=np.int64)))
                    count[:, at] += run[ends[1:]] - run[ends[:-1]]
        share = count / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from the rows of ``df`` with a text and a language; all such rows are counted."""
    rows = df.where(named(text).isNotNull() & named(lang).isNotNull()).select(named(lang).alias("lang"), named(text).alias("text"))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    counts = rows.mapInArrow(_count, "lang string, size long, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    # at most 1 / MIN_RATE n-grams for each language and length; the driver holds those of GROUP languages at a time
    kept = counts.join(F.broadcast(total), ["lang", "size"]).where(F.col("n") >= F.col("total") * MIN_RATE).select("lang", "gram")
    if len(names) > GROUP:
        kept = durable(kept)

    def grams(group: list[str]) -> dict[str, np.ndarray]:
        got = (kept.where(F.col("lang").isin(group)) if len(names) > GROUP else kept).toPandas()
        return {name: np.zeros(0, np.uint64) for name in group} | {name: g.to_numpy(dtype=np.int64).view(np.uint64) for name, g in got.groupby("lang")["gram"]}

    return Filters(grams(names[i : i + GROUP]) for i in range(0, len(names), GROUP))


def predict(df: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (0 to 1: the best language's part of all corrected shares).

    A null text, one without a letter, and every text if nothing was learned, give ``und`` with score
    0. Letters of no learned language give the first language with score 0. Ties go to the first, in
    the order of names. Texts of any length are read whole, in parts; repeated rows stay and get the same. A
    column of ``df`` named like one of the two gives way to it; all others keep name and values. An
    empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def run(texts: pa.Array) -> pa.Array:
        holds("langid")
        f = shared.value
        pred, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        if f.languages:
            for part in _parts(((i, t.as_py()) for i, t in enumerate(texts) if t.is_valid), max(1, CELLS // len(f.languages))):
                part = [(i, c) for i, c in part if len(c) > 1]  # the space alone: no letter
                if part:
                    share = f.shares([c for _, c in part])
                    at = [i for i, _ in part]
                    pred[at] = np.array(f.languages, dtype=object)[share.argmax(axis=1)]
                    score[at] = share.max(axis=1) / np.maximum(share.sum(axis=1), 1e-12)
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=["lang_pred", "score"])

    return beside(df, F.arrow_udf(run, "lang_pred string, score double")(named(text)), ["lang_pred", "score"])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id as text) mod 4 is not 2; predicts all.

    A null doc_id is not held out. See :func:`predict` for null texts, ties, repeats and the rest.
    """
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    filters = learn(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "text", "held_out"), filters).select("doc_id", "held_out", "lang_pred", "score")
