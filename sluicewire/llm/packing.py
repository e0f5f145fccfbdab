"""Packing by order-preserving dynamic programming.

Documents of a block, in the order in which they are read, form one stream of ids; window cuts are
chosen at document ends, at sentence ends, and (at a higher penalty) inside sentences at up to REACH
whole windows from a document end, so that padding plus truncation penalties are least. With ``best[i]`` the least cost of the stream up
to cut ``i``, a window (i, j] costs its padding ``window - (j - i)``, or none at a power of two,
plus a constant and the penalty of cutting at ``j``. For the padded windows the minimum over ``i``
is that of ``best[i] + i`` over a sliding range, which a monotone queue gives in constant amortised
time; the few power-of-two lengths are looked up one by one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, named
from .tokens import word_tokenizer

#: A block holds at least so many ids unless the partition ends; it bounds a worker's memory.
BLOCK_IDS = 1 << 20
#: Costs in ids of padding: a window, a cut between sentences of a document, a cut in a sentence.
WINDOW_COST, SENTENCE_CUT, HARD_CUT = 16.0, 1.0, 8.0
#: How many whole windows from a document end, either way, a cut inside a sentence may lie.
REACH = 8


def choose_cuts(cuts: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Positions that end windows, the last of ``cuts`` among them.

    ``cuts`` are increasing positions over 0, no two (nor 0 and the first) further apart than ``window``.
    """
    pos = np.concatenate(([0], cuts)).astype(np.int64)
    # the cuts that lie a power of two before each cut, end to end
    later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(window.bit_length()):
        if (length := 1 << k) <= window:
            at = np.searchsorted(pos, pos - length)
            hit = np.flatnonzero(pos[at] == pos - length)
            later.append(hit)
            earlier.append(at[hit])
    order = np.argsort(np.concatenate(later), kind="stable")
    exact = np.concatenate(earlier)[order].tolist()
    of = np.searchsorted(np.concatenate(later)[order], np.arange(len(pos) + 1)).tolist()
    p, pen = pos.tolist(), [0.0, *penalty.tolist()]
    best, came = [0.0] * len(p), [0] * len(p)
    # the queue, from ``head`` on: increasing keys of cuts within a window, and these cuts
    keys, queue, head = [0.0], [0], 0
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[head]] < here - window:
            head += 1
        cost, i = keys[head] + window - here, queue[head]
        if of[j] != of[j + 1]:
            for x in exact[of[j] : of[j + 1]]:
                if best[x] < cost:
                    cost, i = best[x], x
        cost += WINDOW_COST + pen[j]
        best[j], came[j] = cost, i
        key = cost + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = came[j]
    return out[::-1]


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and their penalties."""
    is_cut = np.zeros(len(ids) + 1, dtype=bool)
    is_cut[1:] = ends_sentence[ids]
    is_cut[doc_ends] = True
    soft = is_cut.copy()
    if len(ids) > window:
        whole = (doc_ends[:, None] + window * np.arange(-REACH, REACH + 1)).ravel()
        is_cut[whole[(whole > 0) & (whole < len(ids))]] = True
    cuts = np.flatnonzero(is_cut)
    gaps = np.diff(cuts, prepend=0)
    if (far := np.flatnonzero(gaps > window)).size:
        more = [np.arange(cuts[i] - gaps[i] + window // 8, cuts[i], window // 8) for i in far]
        cuts = np.union1d(cuts, np.concatenate(more))
    penalty = np.where(soft[cuts], SENTENCE_CUT, HARD_CUT)
    penalty[np.isin(cuts, doc_ends)] = 0.0
    return cuts, penalty


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


def _packer(window: int, path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        ends_sentence = tokenizer.sentence_ends()
        tail = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def pack() -> pa.RecordBatch:
            nonlocal sequence
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            sizes = np.array([len(x) // 4 for x in parts], dtype=np.int64)
            doc_ends = np.cumsum(sizes)
            cuts, penalty = candidate_cuts(ids, doc_ends, ends_sentence, window)
            stops = np.array(choose_cuts(cuts, penalty, window), dtype=np.int64)
            # a piece ends where a window or a document does
            to = np.union1d(stops, doc_ends)
            start = np.concatenate(([0], to[:-1]))
            doc = np.searchsorted(doc_ends, to)
            win = np.searchsorted(stops, to)
            begins = np.concatenate(([0], stops[:-1]))[win]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), to.tolist(), strict=True)]
            own = [names[i] for i in doc.tolist()]
            cols = (own, start - (doc_ends - sizes)[doc], to - start, crc, sizes[doc], sequence + win, start - begins)
            sequence += len(stops)
            names.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.encode(text.as_py() or "") + tail
                names.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
                if held >= BLOCK_IDS:
                    yield pack()
                    held = 0
        if parts:
            yield pack()

    return run


def pack_table(df: DataFrame, window: int = 2048, tokenizer_path: str | None = None, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents (see SCHEMA); a window of ids is a ``sequence_id``.

    A document's ids are those of its text (null: none) and ``end_id``. Pieces of one sequence are
    in reading order at gapless offsets. Every row is packed, repeated rows and null keys too.
    Nothing is shuffled: each input partition is a stream of its own, and its windows do not depend
    on other partitions. A text of any length is packed whole. Of windows of equal cost the shorter
    one is taken. Other columns are not read, whatever their names. An empty table gives no pieces.
    """
    return df.select(named(key).cast("long").alias("doc_id"), named(text).alias("text")).mapInArrow(_packer(window, tokenizer_path, end_id), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all ``documents``; see :func:`pack_table` for nulls, ties, repeats and the rest."""
    return pack_table(documents(spark, sf_dir))
