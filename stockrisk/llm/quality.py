"""Quality classifier from weak labels: expectation maximisation estimates how far overlapping rules of thumb can be trusted,
and a hashed linear scorer learns from the labels that follow.

Every rule votes clean, junk or nothing on each whole text.  The votes of all documents are counted per pattern (at most
3 ** rules patterns, whatever the number of documents).  EM on these counts estimates the share of junk and, for each rule and
class, how often its votes are for either side; the posterior of a pattern is the weak label of its documents.  A logistic scorer on
hashed shapes of words, pairs of shapes and text measures then learns from these soft labels, on at most ``train_rows``
documents with the smallest hashed ids; it also judges texts on which the rules are silent or at odds.  All documents are
counted and scored.

Defined results: null and empty texts have no votes and no features, so that they score by the scorer's constant, as clean;
an empty table gives an empty table; rows that repeat an id are judged one by one.  All other columns come back in ``rest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import mix, slices, words_of
from stockrisk.llm.line_dedup import with_rest

TRAIN_ROWS = 8192
BUCKETS = 1 << 12
RULES = ["marked_words", "bars", "capitals", "stutter", "variety", "marks", "sentences"]
_U = np.uint64

_KIND = np.full(256, 5, np.uint8)  # bytes above 127
_KIND[:128] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 3, 2, 1
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_OUTER = np.isin(np.arange(256), [ord(c) for c in ".,;:?!'\"()-"])


def measures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures (rows x 7) and word counts of the texts; shape of each word and its row."""
    words = words_of(column)
    n, rows = words.counts, words.rows
    many = np.maximum(n, 1)
    starts, ends = words.starts, words.ends
    kind = _KIND[words.data]

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(rows, weights=flags, minlength=len(n))

    length = ends - starts
    last, before = kind[ends - 1], kind[np.maximum(ends - 2, starts)]
    marked = (last == 4) & (before == 4) & (length > 1)
    bar = (length == 1) & (last == 4)
    upper = np.r_[0, np.cumsum(kind == 2)]
    lower = np.r_[0, np.cumsum(kind == 1)]
    odd = np.r_[0, np.cumsum((kind == 4) & ~_OUTER[words.data])]
    in_word = [x[ends] - x[starts] for x in (upper, lower, odd)]
    hashes = words.hashes(1)
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((hashes, rows))
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    stop = np.isin(words.data[ends - 1], [ord(c) for c in ".,"])
    capitals, small, odd_bytes = (per_row(x) for x in in_word)
    table = np.stack(
        [
            per_row(marked) / many,
            per_row(bar) / many,
            capitals / np.maximum(capitals + small, 1),
            per_row(same) / many,
            np.bincount(rows[order], weights=new, minlength=len(n)) / many,
            odd_bytes / np.maximum(per_row(length), 1),
            per_row(stop) / many,
        ],
        axis=1,
    )
    shout = (in_word[0] > 1) & (in_word[1] == 0)
    shape = kind[starts].astype(np.int64)
    for part, size in ((last, 6), (before, 6), (shout, 2), (np.minimum(length, 11) // 3, 4), (same, 2)):
        shape = shape * size + part
    return table, n, shape, words.first


def votes(table: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Votes of the rules (rows x rules): 1 junk, 2 clean, 0 none."""
    marked, bars, capitals, stutter, variety, marks, sentences = table.T

    def vote(junk: np.ndarray, clean: np.ndarray) -> np.ndarray:
        return np.where(junk, 1, np.where(clean, 2, 0))

    return np.stack(
        [
            vote((marked > 0.15) & (n >= 5), (marked < 0.03) & (n >= 5)),
            vote((bars > 0.1) & (n >= 5), (bars < 0.02) & (n >= 5)),
            vote((capitals > 0.5) & (n >= 5), (capitals < 0.2) & (n >= 5)),
            vote((stutter > 0.25) & (n >= 8), (stutter < 0.05) & (n >= 8)),
            vote((variety < 0.25) & (n >= 60), (variety > 0.4) & (n >= 60)),
            vote((marks > 0.08) & (n >= 5), (marks < 0.02) & (n >= 5)),
            vote((sentences < 0.01) & (n >= 60), (sentences > 0.05) & (sentences < 0.5) & (n >= 20)),
        ],
        axis=1,
    )


def weak_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior probability of junk of each vote pattern (patterns x rules), by EM over the pattern counts."""
    start = (patterns == 1).sum(axis=1) - (patterns == 2).sum(axis=1) / patterns.shape[1]
    junk = 1 / (1 + np.exp(-2 * start))
    for _ in range(rounds):
        parts = []
        for share in (junk, 1 - junk):
            weight = counts * share
            # Counted in all patterns, with a little added so that no vote is impossible.
            # A silent rule says nothing: only its votes for one side or the other are compared.
            given = np.stack([[(weight * (patterns[:, r] == v)).sum() + 0.1 for v in (1, 2)] for r in range(patterns.shape[1])])
            logs = np.c_[np.zeros(len(given)), np.log(given / given.sum(axis=1, keepdims=True))]
            parts.append(np.log(weight.sum() + 1) + sum(logs[r, patterns[:, r]] for r in range(patterns.shape[1])))
        now = 1 / (1 + np.exp(np.clip(parts[1] - parts[0], -60, 60)))
        if np.abs(now - junk).max() < 1e-9:
            break
        junk = now
    return junk


def hashed_features(table: np.ndarray, n: np.ndarray, shape: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, bucket and value of the features: shares of word shapes and of pairs of them, and binned measures."""
    rows = np.repeat(np.arange(len(n)), n)
    pair = np.zeros(len(shape), np.uint64)
    pair[1:] = mix(shape[1:].astype(np.uint64) * _U(1 << 20) + shape[:-1].astype(np.uint64) + _U(1))
    pair[first[:-1][n > 0]] = 0
    single = mix(shape.astype(np.uint64) + _U(7 << 40))
    share = np.repeat(1 / np.maximum(n, 1), n)
    bins = np.minimum((table * 20).astype(np.int64), 19)
    some = np.flatnonzero(n > 0)
    names = mix((np.arange(bins.shape[1])[None, :] * 32 + bins[some]).astype(np.uint64) + _U(9 << 40))
    row = np.r_[rows, rows, np.repeat(some, bins.shape[1])]
    bucket = (np.r_[single, pair, names.ravel()] % _U(BUCKETS)).astype(np.int64)
    value = np.r_[share, share, np.full(names.size, 0.25)]
    # One entry per row and bucket.
    key = row * BUCKETS + bucket
    names, which = np.unique(key, return_inverse=True)
    return names // BUCKETS, names % BUCKETS, np.bincount(which, weights=value, minlength=len(names))


def fit_scorer(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, clean: np.ndarray, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic scorer for soft labels, by AdaGrad in batches."""
    weights, seen, bias, bias_seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 1.0, 1e-6
    docs = len(clean)
    cuts = np.searchsorted(rows, np.arange(docs + 1))
    order = np.random.default_rng(3).permutation(docs)
    for epoch in range(epochs):
        for a in range(0, docs, 256):
            own = np.sort(order[a : a + 256])
            at = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in own])
            local = np.repeat(np.arange(len(own)), cuts[own + 1] - cuts[own])
            x = np.bincount(local, weights=weights[buckets[at]] * values[at], minlength=len(own)) + bias
            error = 1 / (1 + np.exp(-np.clip(x, -40, 40))) - clean[own]
            grad = np.bincount(buckets[at], weights=error[local] * values[at], minlength=BUCKETS) + 1e-4 * weights
            seen += grad**2
            weights -= 0.5 * grad / np.sqrt(seen)
            bias_seen += error.sum() ** 2
            bias -= 0.5 * error.sum() / np.sqrt(bias_seen)
    return weights, max(bias, 0.0)


def _pattern(given: np.ndarray) -> np.ndarray:
    return (given * 3 ** np.arange(given.shape[1])).sum(axis=1)


def judge(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, junk_label, score, kept, rest``: weak label, scorer's probability of a clean text, and decision."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for part in slices(batches):
            table, n, _, _ = measures(part.column("text"))
            for name, times in zip(*np.unique(_pattern(votes(table, n)), return_counts=True)):
                total[int(name)] = total.get(int(name), 0) + int(times)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    known = counted.orderBy("pattern").collect()  # at most 3 ** rules rows
    names = np.array([r.pattern for r in known], np.int64)
    split = names[:, None] // 3 ** np.arange(len(RULES)) % 3
    junk = weak_labels(split, np.array([r.n for r in known], float)) if len(known) else np.zeros(0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            table, n, shape, first = measures(part.column("text"))
            row, bucket, value = hashed_features(table, n, shape, first)
            cuts = np.searchsorted(row, np.arange(len(n) + 1))
            lists = [pa.array([x[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])], t) for x, t in ((bucket, pa.list_(pa.int32())), (value, pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([pa.array(_pattern(votes(table, n)), pa.int64()), *lists], ["pattern", "buckets", "values"])

    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()
    weights, bias = np.zeros(BUCKETS), 1.0
    if picked:
        chosen = F.broadcast(docs.sparkSession.createDataFrame([(r.doc_id,) for r in picked], "doc_id long"))  # train_rows ids
        rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").join(chosen, "doc_id").select("text")
        sample = rows.mapInArrow(featured, "pattern long, buckets array<int>, values array<double>").orderBy("pattern", "buckets", "values")
        sample = sample.limit(train_rows).collect()
        label = 1 - junk[np.searchsorted(names, [r.pattern for r in sample])]
        row = np.repeat(np.arange(len(sample)), [len(r.buckets) for r in sample])
        weights, bias = fit_scorer(
            row,
            np.array([b for r in sample for b in r.buckets], np.int64),
            np.array([v for r in sample for v in r["values"]], float),
            label,
        )
    rest_rows = with_rest(docs)
    kind = rest_rows.schema["rest"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            table, n, shape, first = measures(part.column("text"))
            row, bucket, value = hashed_features(table, n, shape, first)
            x = np.bincount(row, weights=weights[bucket] * value, minlength=len(n)) + bias
            good = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
            weak = junk[np.searchsorted(names, _pattern(votes(table, n)))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(weak), pa.array(good), pa.array(good >= 0.5), part.column("rest")],
                ["doc_id", "text", "junk_label", "score", "kept", "rest"],
            )

    return rest_rows.mapInArrow(score, f"doc_id long, text string, junk_label double, score double, kept boolean, rest {kind}")
