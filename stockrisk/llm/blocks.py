"""Helpers shared by the text operators: words of an Arrow column as numpy arrays, id sets of fixed size, components.

Words are runs of bytes outside ``\\x20\\x09-\\x0D`` of the UTF-8 text.  All positions and hashes of a slice of rows are
computed at once; slices hold about ``SLICE_BYTES`` of text, or one longer text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockrisk.session import written

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _bases(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A random value for each byte, an odd base and its inverse modulo 2**64."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))
    base = int(mix(np.array([seed + 77], np.uint64))[0]) | 5
    return values, _U(base), _U(pow(base, -1, 1 << 64))


_TABLES = {seed: _bases(seed) for seed in (1, 2, 3, 4)}
BYTE_VALUES = _TABLES[1][0]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(seed: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the seed's base (or of its inverse) modulo 2**64."""
    have = _POWERS.get((seed, inverse))
    if have is None or len(have) < n:
        steps = np.full(n, _TABLES[seed][2 if inverse else 1], np.uint64)
        steps[:1] = 1
        have = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + (SLICE_BYTES >> 2):  # longer ones serve one text only
            _POWERS[seed, inverse] = have
    return have[:n]


class RangeHash:
    """Rabin-Karp hashes of ranges ``values[start:end]`` from one running sum."""

    def __init__(self, values: np.ndarray, seed: int) -> None:
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(seed, len(values)), out=self.sums[1:])
        self.back = powers(seed, len(values) + 1, inverse=True)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    return RangeHash(values, seed)(starts, ends)


@dataclass
class Words:
    """Words of a slice of rows: byte ranges, row of each word, and ``first[i]:first[i+1]`` as the words of row i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return range_hash(_TABLES[seed][0][self.data], self.starts, self.ends, seed)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after another, and the offsets of the rows; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return (_LOWER if lower else _SAME)[data], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begin[inner] = solid[inner]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    finish[last] = solid[last]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def words_of(column: pa.Array, lower: bool = False) -> Words:
    return split_words(*text_bytes(column, lower))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``limit`` text bytes, at least one row each."""
    for batch in batches:
        sizes = batch.column(text).cast(pa.large_string()).fill_null("")
        if not batch.num_rows:
            continue
        offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give memory back at the end of a task: worker processes live on, beside those of the stages that follow."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library keeps freed memory back
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every run of ``size`` words inside one row."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(rows)) - begin[rows] + first[:-1][rows], rows


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices ``start, start+1, ...`` of all ranges, one after another."""
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin - starts, counts)


# Sets of ids in a fixed number of bytes ------------------------------------------------------------------------------

SET_BITS = 8_388_593  # a prime near 2**23: one MB, whatever the number of ids


def id_bits(ids: DataFrame, column: str = "doc_id") -> np.ndarray:
    """A bit map of ``id mod SET_BITS``, eight to a byte: it holds every id of the frame, and perhaps others.

    At most ``SET_BITS`` / 64 numbers reach the driver, however many ids there are.
    """
    slot = F.pmod(F.col(column), F.lit(SET_BITS))
    found = (
        ids.where(F.col(column).isNotNull())
        .select(slot.alias("slot"))
        .groupBy(F.expr("slot div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(SET_BITS // 64 + 1, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def maybe_in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = np.mod(ids, SET_BITS)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def maybe_rows(bits: np.ndarray, ids: pa.Array) -> np.ndarray:
    """For each id of a column whether the bit map may hold it; a null is in no map."""
    return maybe_in(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)


def rows_by_bits(df: DataFrame, bits: np.ndarray, inside: bool, column: str = "doc_id") -> DataFrame:
    """The rows whose id may be in the bit map, or all others (with those that have no id)."""

    sliced = "text" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches) if sliced else batches:
            yield part.filter(pa.array(maybe_rows(bits, part.column(column)) == inside))
        release()

    return df.mapInArrow(run, df.schema)


def without_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``df`` without the rows whose id is in ``ids`` (a written frame); only rows that may be among them are shuffled."""
    bits = id_bits(ids, column)
    left = rows_by_bits(df, bits, True, column).join(ids.select(column), column, "left_anti").select(df.columns)
    return rows_by_bits(df, bits, False, column).union(left)


# Connected components ------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``id, component_id`` (smallest id reachable) of every id in ``links`` (``a``, ``b``: long).

    Every round points each id at the smallest id known in its neighbourhood and then lets each pointer jump, so that a
    chain of n links takes about log n rounds.  Each round is written, so that a lost executor costs one round at most.
    """
    spark = links.sparkSession
    both = links.where("a <> b").selectExpr("a AS u", "b AS v").union(links.where("a <> b").selectExpr("b", "a"))
    edges = written(both.distinct(), "links")
    if edges.isEmpty():
        return links.select(F.col("a").alias("id"), F.col("a").alias("component_id")).where("false")
    label = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "id"), "labels")
    while True:
        # The label of a neighbour, offered both to the id and to the id's present label (hooking), then one jump.
        # Both are taken from one row and the hooked labels are written, so that no part of a round is planned twice.
        offers = edges.join(label.selectExpr("id AS v", "c AS offer"), "v").join(label.selectExpr("id AS u", "c AS old"), "u")
        best = (
            offers.selectExpr("offer", "explode(array(u, if(offer < old, old, u))) AS id")
            .groupBy("id")
            .agg(F.min("offer").alias("offer"))
        )
        hooked = written(label.join(best, "id", "left").selectExpr("id", "least(c, offer) AS n", "c AS before"), "hooked")
        jumped = hooked.join(hooked.selectExpr("id AS n", "n AS next"), "n", "left").selectExpr(
            "id", "least(n, next) AS c", "before"
        )
        label = written(jumped, "labels")
        if label.where("c <> before").isEmpty():
            return label.selectExpr("id", "c AS component_id")
        label = label.drop("before")


def with_components(ids: DataFrame, links: DataFrame, column: str = "doc_id") -> DataFrame:
    """``ids`` with ``component_id`` and ``kept``; an id without links is its own component."""
    found = components(links).withColumnRenamed("id", column)
    return ids.join(found, column, "left").withColumn(
        "component_id", F.coalesce("component_id", F.col(column))
    ).withColumn("kept", F.col(column) == F.col("component_id"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
