"""Periodic run detection: seeds are k-grams of the smallest overlap that a run must have with itself, pairs of occurrences in
one document are extended along their diagonal, and what is already covered at a lag is not extended again.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends, of at least ``max(6, 4 * q)``
words.  Shifted by q it overlaps itself in at least ``max(5, 3 * q)`` words.  Periods are therefore searched in classes:
1 to 5 with k-grams of 5 words, then from ``lo`` to ``3 * lo`` with k-grams of ``3 * lo`` words.  In every class k is at most
the overlap of any of its runs and at least any of its periods.  Hence

* each place of a run at which a k-gram and its shifted twin fit is a seed: the k-gram's next occurrence in the document is
  exactly q words on.  (A nearer one, d < q, would lie inside the run and give a piece of q words the periods d and q, so
  that the run's smallest period would be smaller.)  Only pairs of neighbouring occurrences are looked at, n at most;
* a seed is no run of a smaller period, for the same reason.

Seeds are ordered by lag and place.  The table of the furthest place covered at each lag is then the running end of that
order: a seed one word after another of the same lag is covered by its extension and is passed over.  Words, not hashes,
decide the extension of the others.

All runs together drop their words after the first period; the words left make the collapsed text.

Each document is searched in one task, in memory of about 100 bytes a word; slices of rows share one pass.  There is no
shuffle.

Defined results: a null or empty text has no words and no runs; rows are taken one by one, whatever their ``doc_id``; other
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockrisk.llm.blocks import mix, ragged, range_hash, slices, window_starts

LEAST_WORDS, REPEATS = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_U = np.uint64


def classes(n: int) -> Iterator[tuple[int, int, int]]:
    """Smallest period, largest period and k of every class that a text of ``n`` words can hold."""
    low, high, k = 1, LEAST_WORDS - 1, LEAST_WORDS - 1
    while n >= max(LEAST_WORDS, REPEATS * low):
        yield low, high, k
        low = high + 1
        k = high = (REPEATS - 1) * low


def coded(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers, equal where the words are equal, and the first place of each row."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    codes = np.fromiter((number[w] for words in rows for w in words), np.int64)
    return codes, np.cumsum([0, *map(len, rows)])


def seeds(codes: np.ndarray, first: np.ndarray, low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and lag of each pair of neighbouring occurrences of a k-gram in a row, ordered by lag and place."""
    starts, rows = window_starts(first, k)
    values = mix(codes.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019))
    keys = range_hash(values, starts, starts + k, 2) ^ mix(rows.astype(np.uint64) + _U(1))
    order = np.argsort(keys, kind="stable")
    keys, places, rows = keys[order], starts[order], rows[order]
    lag = places[1:] - places[:-1]
    pair = (keys[1:] == keys[:-1]) & (rows[1:] == rows[:-1]) & (lag >= low) & (lag <= high)
    places, lag = places[:-1][pair], lag[pair]
    order = np.lexsort((places, lag))
    return places[order], lag[order]


def extended(codes: np.ndarray, first: np.ndarray, places: np.ndarray, lag: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, start, end and lag of the diagonals ``codes[i] == codes[i + lag]`` around the seeds, each once."""
    fresh = np.r_[True, (lag[1:] != lag[:-1]) | (places[1:] != places[:-1] + 1)]  # not covered at this lag yet
    heads = np.flatnonzero(fresh)
    begin, lag = places[heads], lag[heads]
    end = places[np.r_[heads[1:] - 1, len(places) - 1]] + k
    # The words between: all equal, unless hashes of different k-grams met.
    which = np.repeat(np.arange(len(begin)), end - begin)
    at = ragged(begin, end - begin)
    equal = codes[at] == codes[at + lag[which]]
    edge = np.r_[True, which[1:] != which[:-1]]
    opens = np.flatnonzero(equal & (edge | ~np.r_[False, equal[:-1]]))
    closes = np.flatnonzero(equal & (np.r_[edge[1:], True] | ~np.r_[equal[1:], False]))
    begin, end, lag = at[opens], at[closes] + 1, lag[which[opens]]
    row = np.searchsorted(first, begin, side="right") - 1
    least, most = first[row], first[row + 1]
    while len(begin):
        left = begin > least
        left[left] = codes[begin[left] - 1] == codes[begin[left] - 1 + lag[left]]
        right = end + lag < most
        right[right] = codes[end[right]] == codes[end[right] + lag[right]]
        if not (left.any() or right.any()):
            break
        begin, end = begin - left, end + right
    _, once = np.unique(np.stack([lag, begin]), axis=1, return_index=True)
    return row[once], begin[once], end[once], lag[once]


def runs_of(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start (word of the row), length and period of all runs, by row, start and period."""
    counts = np.diff(first)
    found = [np.zeros((4, 0), np.int64)]
    for low, high, k in classes(int(counts.max(initial=0))):
        rows = np.flatnonzero(counts >= max(LEAST_WORDS, REPEATS * low))
        part = codes[ragged(first[rows], counts[rows])]
        edges = np.r_[0, np.cumsum(counts[rows])]
        places, lag = seeds(part, edges, low, high, k)
        if not len(places):
            continue
        row, begin, end, lag = extended(part, edges, places, lag, k)
        length = end - begin + lag
        long = length >= np.maximum(LEAST_WORDS, REPEATS * lag)
        found.append(np.stack([rows[row], begin - edges[row], length, lag])[:, long])
    every = np.concatenate(found, axis=1)
    return tuple(every[:, np.lexsort((every[3], every[1], every[0]))])


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The words of a text of ``n`` words that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def periodic_runs(docs: DataFrame, splice: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row: all runs by start and period, and the words left.

    ``splice`` may replace the words of a row, given its id, before they are searched.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("doc_id")
            rows = [(text or "").encode().split() for text in part.column("text").to_pylist()]
            if splice:
                rows = [splice(i, words) for i, words in zip(ids.to_pylist(), rows)]
            codes, first = coded(rows)
            row, start, length, period = runs_of(codes, first)
            edges = np.searchsorted(row, np.arange(len(rows) + 1))
            texts = []
            for words, a, b in zip(rows, edges[:-1], edges[1:]):
                if a < b:
                    gone = dropped(len(words), start[a:b], length[a:b], period[a:b])
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                texts.append(b" ".join(words).decode())
            each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each)
            columns = [ids, pa.array(np.diff(first)), lists, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, SCHEMA)


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words with a planted repetition for about a tenth of all ids, as a checksum of the id says; the others unchanged."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent, and checksums, from ``periodic_runs``."""
    best = """reduce(runs, cast(null AS struct<start: long, length: long, period: long>), (best, r) ->
        CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)"""
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.selectExpr(
        "doc_id",
        "cast(size(runs) AS long) AS n_runs",
        f"{best} AS top",
        f"sha2({listed}, 256) AS runs_sha256",
        "sha2(collapsed, 256) AS collapsed_sha256",
    ).selectExpr(
        "doc_id",
        "n_runs",
        "top.start AS start",
        "top.length AS length",
        "top.period AS period",
        "1000 * top.length div top.period AS exponent_milli",
        "runs_sha256",
        "collapsed_sha256",
    )
