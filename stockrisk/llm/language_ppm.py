"""Language ID by prediction by partial matching: one variable-order byte context tree per language, whose escape
probabilities give each text an exact code length under frozen counts; the shortest code names the language.

The code is PPM with escape method C and full exclusion over bytes with A-Z lowered; a text is taken to follow ``ORDER`` line
breaks.  A byte is coded in the longest context that the language has seen; each time it is not found there, an escape leads
to the context without its oldest byte, in which all bytes of the longer one are excluded.  Below the empty context the bytes
never seen share the rest evenly.  The code's probabilities sum to one.

What follows a context also follows its shorter ones, so what is excluded depends on the next longer context alone, and the
counts left after exclusion are kept with that context when the tree is built.  The code of a byte is then a function of it
and the ``ORDER`` bytes before it: it is worked out once for each distinct window of a slice, and remembered.  Lengths are
rounded to 2**-16 bits a byte, so that sums do not depend on how rows are sliced.

The trees are learned from a bounded sample of the labelled texts: of the ``LANGUAGES`` languages with the most distinct training
texts, whole distinct texts with the smallest hashes, ``TRAIN_BYTES`` in all, in equal shares.  A tree has at most one entry
an order for each of its bytes, which bounds what is broadcast.  Scoring covers every whole text.

Defined results: a null text and a text without a letter are ``und`` with score 0; so is every text if nothing could be
learned; equal code lengths go to the first name; rows without ``doc_id`` are training rows; rows that repeat an id are
scored one by one; a text longer than its language's share is no training text.  Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from stockrisk.llm.blocks import slices, text_bytes
from stockrisk.session import written

ORDER = 4
LANGUAGES = 256
TRAIN_BYTES = 2 << 20
CHUNK = 1 << 20
REMEMBERED = 1 << 22
UNIT = 65536.0
BEFORE = 10  # the byte that stands before a text
_U = np.uint64
_LANG = _U(8 * (ORDER + 1))


def windows(data: np.ndarray, offsets: np.ndarray, begin: int, end: int, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes ``begin:end``: each with the ``order`` bytes before it in its row as one number, and its row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.clip(offsets, begin, end)))
    place = np.arange(begin, end) - offsets[row]
    near = np.full(end - begin + order, BEFORE, np.uint8)  # with the bytes before ``begin``, as far as there are some
    first = max(begin - order, 0)
    near[order - (begin - first) :] = data[first:end]
    keys = near[order:].astype(np.uint64)
    for d in range(1, order + 1):
        before = near[order - d : len(near) - d].copy()
        before[place < d] = BEFORE
        keys |= before.astype(np.uint64) << _U(8 * d)
    return keys, row


def _low(keys: np.ndarray, n: int) -> np.ndarray:
    """The language and the last ``n`` bytes of combined keys."""
    return keys & ~(((_U(1) << _LANG) - _U(1)) ^ ((_U(1) << _U(8 * n)) - _U(1)))


def _context(keys: np.ndarray, n: int) -> np.ndarray:
    """The language and the ``n`` bytes before the last of combined keys."""
    return (keys >> _LANG << _LANG) | ((keys >> _U(8)) & ((_U(1) << _U(8 * n)) - _U(1)))


def _find(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted array, -1 for those it lacks."""
    if not len(have):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, at, -1)


@dataclass
class _Level:
    """Contexts of one length: their bytes with counts, and for each context its totals."""

    grams: np.ndarray  # language, context, byte
    counts: np.ndarray
    contexts: np.ndarray
    kinds: np.ndarray  # distinct bytes: the count of the escape
    total: np.ndarray  # all counts and the escape
    left_kinds: np.ndarray  # the same of the next shorter context without the bytes of this one
    left_total: np.ndarray


class Trees:
    """The context trees of all languages."""

    def __init__(self, names: list[str], keys: np.ndarray) -> None:
        """``keys``: windows of all training bytes with the number of their language above them."""
        self.names = names
        self.levels: list[_Level] = []
        keys, counts = np.unique(keys, return_counts=True)
        by_length = [(keys, counts)]
        for n in range(ORDER, 0, -1):
            keys, back = np.unique(_low(keys, n), return_inverse=True)
            counts = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
            by_length.append((keys, counts))
        for k, (grams, counts) in enumerate(reversed(by_length)):
            contexts, back, kinds = np.unique(_context(grams, k), return_inverse=True, return_counts=True)
            sums = np.bincount(back, weights=counts, minlength=len(contexts)).astype(np.int64)
            left_kinds = left_total = np.zeros(len(contexts), np.int64)
            if k:
                up = self.levels[-1]
                shorter = _find(up.contexts, _low(contexts, k - 1))
                excluded = np.bincount(back, weights=up.counts[_find(up.grams, _low(grams, k))], minlength=len(contexts))
                left_kinds = up.kinds[shorter] - kinds
                left_total = up.total[shorter] - up.kinds[shorter] - excluded.astype(np.int64) + left_kinds
            self.levels.append(_Level(grams, counts, contexts, kinds, sums + kinds, left_kinds, left_total))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window in each language."""
        n = len(self.names)
        every = np.tile(keys, n) | np.repeat(np.arange(n, dtype=np.uint64) << _LANG, len(keys))
        cost = np.zeros(len(every))
        open_ = np.ones(len(every), bool)
        longer = np.full(len(every), -1)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            context = _find(level.contexts, _context(every, k))
            gram = _find(level.grams, _low(every, k + 1))
            total, escape = level.total[context], level.kinds[context]
            if k < ORDER:
                after = longer >= 0
                total = np.where(after, self.levels[k + 1].left_total[longer], total)
                escape = np.where(after, self.levels[k + 1].left_kinds[longer], escape)
            hit = open_ & (gram >= 0)
            miss = open_ & (gram < 0) & (context >= 0) & (escape > 0)
            cost[hit] += np.log2(total[hit]) - np.log2(level.counts[gram[hit]])
            cost[miss] += np.log2(total[miss]) - np.log2(escape[miss])
            open_ &= ~hit
            longer = context
        kinds = np.bincount((self.levels[0].grams >> _LANG).astype(np.int64), minlength=n)
        cost[open_] += np.log2(256 - kinds)[(every[open_] >> _LANG).astype(np.int64)]
        return (np.rint(cost * UNIT) / UNIT).reshape(n, len(keys)).T

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, known: Known) -> np.ndarray:
        """Bits of every row in every language."""
        out = np.zeros((len(offsets) - 1, len(self.names)))
        for begin in range(0, len(data), CHUNK):
            keys, row = windows(data, offsets, begin, min(begin + CHUNK, len(data)))
            which, distinct = pd.factorize(keys)
            costs = known.costs(self, distinct)
            first, last = row[0], row[-1] + 1
            for i in range(len(self.names)):
                out[first:last, i] += np.bincount(row - first, weights=costs[:, i][which], minlength=last - first)
        return out


class Known:
    """Code lengths of windows met before, ``REMEMBERED`` numbers at most."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.table = np.zeros((0, 0))

    def costs(self, trees: Trees, keys: np.ndarray) -> np.ndarray:
        at = _find(self.keys, keys)
        fresh = np.flatnonzero(at < 0)
        out = np.empty((len(keys), len(trees.names)))
        if len(fresh) < len(keys):
            out[at >= 0] = self.table[at[at >= 0]]
        step = max(1, CHUNK // len(trees.names))
        for a in range(0, len(fresh), step):
            out[fresh[a : a + step]] = trees.bits(keys[fresh[a : a + step]])
        if len(fresh):
            keep = len(self.keys) and (len(self.keys) + len(fresh)) * len(trees.names) <= REMEMBERED
            keys_now = np.r_[self.keys, keys[fresh]] if keep else keys
            table_now = np.concatenate([self.table, out[fresh]]) if keep else out
            order = np.argsort(keys_now)
            self.keys, self.table = keys_now[order], table_now[order]
        return out


def training_rows(docs: DataFrame, languages: int, train_bytes: int) -> DataFrame:
    """``lang, text``: the bounded sample of distinct labelled texts outside the held-out fold."""
    rows = docs.where("coalesce(crc32(cast(cast(doc_id AS long) AS string)) % 4, 0) <> 2 AND lang IS NOT NULL AND text <> ''")
    rows = rows.selectExpr("lang", "xxhash64(text) AS h", "cast(octet_length(text) AS long) AS size", "text")
    kinds = written(rows.groupBy("lang", "h").agg({"size": "max"}).withColumnRenamed("max(size)", "size"), "texts")
    chosen = kinds.groupBy("lang").count().orderBy("count", "lang", ascending=[False, True]).limit(languages)
    chosen = written(chosen.select("lang"), "languages")
    share = train_bytes // max(1, chosen.count())
    short = kinds.where(f"size <= {share}").join(chosen, "lang")
    total = short.groupBy("lang").sum("size").withColumnRenamed("sum(size)", "total")
    # A part of the hash range with about twice the share comes first, so that no group holds a whole language.
    near = short.join(total, "lang").where(f"h / pow(2, 64) + 0.5 <= {2 * share} / total")
    picked = near.selectExpr("lang", "h", "sum(size) OVER (PARTITION BY lang ORDER BY h) AS reached").where(f"reached <= {share}")
    picked = written(picked.select("lang", "h"), "sample")
    return rows.join(picked, ["lang", "h"]).groupBy("lang", "h").agg({"text": "min"}).selectExpr("lang", "`min(text)` AS text")


def learn(docs: DataFrame, languages: int = LANGUAGES, train_bytes: int = TRAIN_BYTES) -> Trees:
    """The trees of ``docs`` (``doc_id, lang, text``); the sample that reaches the driver has ``train_bytes`` at most."""
    sample = training_rows(docs, languages, train_bytes).toArrow()
    return trees_of(sample.column("lang").to_pylist(), sample.column("text").combine_chunks())


def trees_of(lang: list[str], texts: pa.Array) -> Trees:
    names = sorted(set(lang))
    data, offsets = text_bytes(texts, lower=True)
    keys, row = windows(data, offsets, 0, len(data))
    number = np.array([names.index(x) for x in lang], np.uint64)
    return Trees(names, keys | (number[row] << _LANG))


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """``doc_id, lang_pred, score, bits, n_bytes`` for every row; ``bits`` is the length of the shortest code, ``score`` the
    predicted language's share of the probability that all languages give the text."""
    spark = docs.sparkSession
    frozen = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, known = frozen.value, Known()
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"), lower=True)
            named = part.column("has_letter").to_numpy(zero_copy_only=False)
            if trees.names:
                bits = trees.code_lengths(data, offsets, known)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
            else:
                named = np.zeros(len(named), bool)
                best, least, score = np.zeros(len(named), int), np.zeros(len(named)), np.zeros(len(named))
            columns = [
                part.column("doc_id"),
                pa.array([trees.names[b] if ok else "und" for b, ok in zip(best.tolist(), named.tolist())], pa.string()),
                pa.array(np.where(named, score, 0.0)),
                pa.array(least),
                pa.array(np.diff(offsets).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "bits", "n_bytes"])

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text", r"coalesce(text RLIKE '\\p{L}', false) AS has_letter")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, n_bytes long")


def predict(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, with trees learned outside the held-out fold."""
    held_out = "coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false) AS held_out"
    return identify(docs, learn(docs)).selectExpr("doc_id", held_out, "lang_pred", "score")
