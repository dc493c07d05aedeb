"""Best-fit packing of token pieces by minimum bin slack.

How pieces fill bins depends on their lengths alone, so the plan is made over the histogram of
lengths, which has at most ``capacity`` entries whatever the corpus' size. For each bin the
greatest length left is fixed, and a subset-sum over bit sets finds the fullest combination with
it; the combination is used as often as the counts allow and then removed. Pieces get their
places by their rank among those of their length: a rank within its task's output, plus the
counts of the tasks before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, per_row, written
from .pretokens import Segments, default_vocabulary

CAPACITY = 2048
SEPARATOR = 0
#: Fixed value: the vocabulary's added token, whose string in a text is that token.
ADDED = {"<|endoftext|>": 50256}


def fullest(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Of (length, count) pairs, falling, the (length, times) that fill ``room`` most.

    Bit k of a set says that some choice sums to k. The search ends as soon as the room is
    filled, so the longest lengths that can do it are used.
    """
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length, count in lengths:
        if length > room:
            continue
        trail.append((length, count, reach))
        most, step = min(count, room // length), 1
        while most > 0:  # counts in doubling steps
            take = min(step, most)
            reach |= (reach << (take * length)) & mask
            most -= take
            step *= 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, []
    for length, count, before in reversed(trail):
        times = 0
        while not before >> left & 1:
            left -= length
            times += 1
        if times:
            out.append((length, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations of (length, times) and the number of bins that take each; lengths lie from 1 to ``capacity``."""
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        top = order[0]
        left[top] -= 1
        combo = {top: 1}
        for length, times in fullest([(n, left[n]) for n in order if left[n] > 0], capacity - top):
            combo[length] = combo.get(length, 0) + times
        left[top] += 1
        bins = min(left[n] // times for n, times in combo.items())
        for n, times in combo.items():
            left[n] -= times * bins
        out.append((sorted(combo.items(), reverse=True), bins))
        order = [n for n in order if left[n] > 0]
    return out


class Places:
    """Where the piece of a rank among its length goes; at most a few entries for each combination."""

    def __init__(self, combos: list[tuple[list[tuple[int, int]], int]]):
        self.of: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first_bin = 0
        for combo, bins in combos:
            offset = 0
            for length, times in combo:
                self.of.setdefault(length, []).append((taken.get(length, 0), first_bin, times, offset))
                taken[length] = taken.get(length, 0) + times * bins
                offset += length * times
            first_bin += bins
        self.n_bins = first_bin
        self.tables = {n: np.array(rows, np.int64) for n, rows in self.of.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and offsets."""
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for a, b in zip(cuts, cuts[1:], strict=False):
            rows = order[a:b]
            n = int(length[rows[0]])
            table = self.tables[n]
            start, first, times, base = table[np.searchsorted(table[:, 0], rank[rows], side="right") - 1].T
            k = rank[rows] - start
            bins[rows] = first + k // times
            offsets[rows] = base + k % times * n
        return bins, offsets


def ids_of(text: str, segments: Segments, added: dict[str, int]) -> bytes:
    """Ids of a whole text; it is cut at added tokens first, and what stands between them is encoded alone."""
    for token, number in added.items():
        if token in text:
            rest = {k: v for k, v in added.items() if k != token}
            return number.to_bytes(4, "little").join(ids_of(part, segments, rest) for part in text.split(token))
    return segments.ids(text)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, pattern: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Token pieces of every document: its ids, then the separator; only longer ones are cut, the first piece taking the rest.

    ``added`` tokens are those of the default vocabulary unless given. Null and empty texts are the separator alone. ``part`` and ``nth`` number the pieces of a
    length within the task that made them, so they hold for one written copy of the result.
    """
    own_path, own_pattern = default_vocabulary()
    added = (ADDED if path is None else {}) if added is None else added
    path, pattern = path or own_path, pattern or own_pattern
    end = SEPARATOR.to_bytes(4, "little")

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        segments, seen = Segments(path, pattern), {}
        part = TaskContext.get().partitionId()
        for doc_id, text in rows:
            ids = ids_of(text or "", segments, added) + end
            n = len(ids) // 4
            size = (n - 1) % capacity + 1
            start = piece = 0
            while start < n:
                seen[size] = nth = seen.get(size, -1) + 1
                yield doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), part, nth
                start, piece, size = start + size, piece + 1, capacity

    return per_row(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long", run)


def pack(docs: DataFrame, capacity: int = CAPACITY, **vocabulary) -> DataFrame:
    """Every piece with its sequence and its place there: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed each; an empty table packs to no rows; other columns are left out.
    """
    cut = written(pieces(docs, capacity, **vocabulary), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n_pieces"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n_pieces").alias("n")).collect()}  # at most `capacity` rows
    places = Places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n_pieces").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("nth"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            bins, offsets = places.find(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, schema)


def op3_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
