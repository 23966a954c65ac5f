"""Ranked lexical search over a document FP-tree: term vectors restricted to the terms asked for, most frequent first, share the
paths of a trie; the largest counts and the smallest length factor below each node bound what any document there can
score, and a depth-first branch-and-bound walk per item leaves out what cannot reach its list.

Terms are the maximal runs of digits, letters and bytes from 0x80, with A-Z lowered.  With N documents that have a term, L
terms in all, n terms of a document, df documents with a term and tf of its places in a document, a term's weight is
``floor(1000 * ln((2N + 2) / (2df + 1)))`` and a document's length factor ``m = 75 + (25 * n * N) div L``.  A document scores the
sum over the item's terms, repeats included, of ``weight * ((10**9 * tf) div (1000 * tf + 12 * m))``, in 64-bit integers.

Items are taken in blocks of at most ``ITEMS`` items and about ``TERMS`` distinct terms (or one longer item); a block's terms are
what is broadcast.  For each block

1. every whole text is read once and gives its id, n, and the counts of the block's terms, written as packed rows;
2. N, L and the df come from these rows by aggregation, exactly;
3. each task builds trees of as many documents as make ``CELLS`` counts and walks them for every item, the list of one tree being
   the bar for the next.  A task passes on one list of ``k`` documents per item, whatever it read;
4. the lists are merged by one window per item, cut to k rows before their shuffle.

A node's bound is never below the score of a document under it, since a term's share grows with its count and falls with
the length factor, and weights are not negative.  Only nodes strictly below the bar are left out, so ties are decided by id.

Defined results: a null text has no terms; a document without terms counts nowhere; every row is a document of its own, and
every item row an item of its own; documents without ``doc_id`` come last among equals; items without terms or
without a document above 0 have no rows; no items or no documents give an empty result; other columns are dropped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockrisk.llm.blocks import ragged, slices
from stockrisk.session import written

TOP = 20
ITEMS, TERMS = 256, 1 << 14
CELLS = 1 << 22
LEAF = 32
PIECE = 1 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def term_lists(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``PIECE`` bytes."""
    body = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + PIECE)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


@dataclass
class Block:
    """Items with the numbers and repeats of their terms, and the number of each term."""

    item_ids: list[int | None]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    number: dict[bytes, int]


def blocks_of(items: DataFrame) -> Iterator[Block]:
    block = Block([], [], [], {})
    for row in items.selectExpr("cast(item_id AS long) AS item_id", "text").where("text IS NOT NULL").toLocalIterator():
        counts = Counter(term for part in term_lists(row.text) for term in part)
        if not counts:
            continue
        if block.item_ids and (len(block.item_ids) >= ITEMS or len(block.number) + len(counts) > TERMS):
            yield block
            block = Block([], [], [], {})
        numbers = [block.number.setdefault(term, len(block.number)) for term in counts]
        block.item_ids.append(row.item_id)
        block.terms.append(np.array(numbers))
        block.repeats.append(np.array(list(counts.values()), np.int64))
    if block.item_ids:
        yield block


# Restricted term vectors ------------------------------------------------------------------------------------------------


def restricted_vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts``: the number of terms of each text, and those asked for (packed 32-bit integers)."""
    asked = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = asked.value.get
        for part in slices(batches):
            sizes, terms, counts = [], [], []
            for text in part.column("text").to_pylist():
                size, found = 0, Counter()
                for words in term_lists(text):
                    size += len(words)
                    found.update(map(find, words))
                found.pop(None, None)
                sizes.append(size)
                terms.append(np.fromiter(found.keys(), np.uint32, len(found)).tobytes())
                counts.append(np.fromiter(found.values(), np.uint32, len(found)).tobytes())
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_counts(vectors: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents of each term; at most one row a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            packed = b"".join(batch.column("terms").to_pylist())
            total += np.bincount(np.frombuffer(packed, np.uint32), minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for row in vectors.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    return df


# Tree and walk ----------------------------------------------------------------------------------------------------------


@dataclass
class Statistics:
    """What the scores need besides the document: per term its place in order of frequency and its weight by that place."""

    documents: int
    all_terms: int
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, documents: int, all_terms: int, df: np.ndarray) -> Statistics:
        order = np.lexsort((np.arange(len(df)), -df))
        place = np.empty(len(df), np.int64)
        place[order] = np.arange(len(df))
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df[order].tolist()]
        return cls(documents, all_terms, place, np.array(weight, np.int64))

    def share(self, counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
        return (10**9 * counts) // (1000 * counts + 12 * factor)


class Tree:
    """The trie of some documents.  Documents stand in the order of their paths, so that every node is a range of them; paths
    without a fork are one edge, and neighbouring branches of few documents share a leaf."""

    def __init__(self, stats: Statistics, ids: np.ndarray, sizes: list[int], terms: list[bytes], counts: list[bytes]) -> None:
        places = [stats.place[np.frombuffer(t, np.uint32)] for t in terms]
        sorts = [np.argsort(p) for p in places]
        paths = [p[s] for p, s in zip(places, sorts)]
        order = sorted(range(len(paths)), key=[p.astype(">u4").tobytes() for p in paths].__getitem__)
        self.ids = ids[order]
        length = np.array([len(paths[i]) for i in order])
        self.path = np.concatenate([paths[i] for i in order])
        self.first = np.r_[0, np.cumsum(length)]
        tf = np.concatenate([np.frombuffer(counts[i], np.uint32)[sorts[i]] for i in order]).astype(np.int64)
        n, total = stats.documents, stats.all_terms
        factor = np.array([75 + (25 * sizes[i] * n) // total for i in order], np.int64)
        row = np.repeat(np.arange(len(order)), length)
        self.shares = np.zeros((len(order), len(stats.weight)), np.int64)
        self.shares[row, self.path] = stats.weight[self.path] * stats.share(tf, factor[row])
        self.ranges: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.root = self._grow(len(order))
        table = np.zeros(self.shares.shape, np.int64)
        table[row, self.path] = tf
        top = np.zeros((len(self.ranges), len(stats.weight)), np.int64)
        low = np.zeros(len(self.ranges), np.int64)
        for node, ((a, b), below) in enumerate(zip(self.ranges, self.children)):  # children come before their parent
            top[node] = top[below].max(axis=0) if below else table[a:b].max(axis=0)
            low[node] = low[below].min() if below else factor[a:b].min()
        self.bounds = stats.weight * stats.share(top, low[:, None])

    def _node(self, a: int, b: int, children: list[int]) -> int:
        self.ranges.append((a, b))
        self.children.append(children)
        return len(self.ranges) - 1

    def _forks(self, a: int, b: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """The ranges of ``a:b`` by their next term at the first depth where there is more than one."""
        first, length = self.first[a:b], np.diff(self.first[a : b + 1])
        while True:
            ended = length <= depth
            if ended.all():
                return [(a, b)], depth
            term = np.where(ended, -1, self.path[np.minimum(first + depth, len(self.path) - 1)])
            edges = np.flatnonzero(term[1:] != term[:-1]) + 1
            if len(edges):
                edges = [a, *(edges + a).tolist(), b]
                return list(zip(edges[:-1], edges[1:])), depth
            depth += 1

    def _grow(self, n: int) -> int:
        """All nodes from the leaves up, without recursion, since paths may be long."""
        done: list[int] = []
        work: list[tuple] = [(0, n, 0)]
        while work:
            task = work.pop()
            if len(task) == 2:  # all children of a node are there
                (a, b), how_many = task
                done[-how_many:] = [self._node(a, b, done[-how_many:])]
                continue
            a, b, depth = task
            forks, depth = self._forks(a, b, depth) if b - a > LEAF else ([(a, b)], depth)
            if len(forks) == 1:
                done.append(self._node(a, b, []))
                continue
            parts: list[tuple[int, int, int]] = []
            for start, end in forks:
                if parts and parts[-1][2] < 0 and end - parts[-1][0] <= LEAF:
                    parts[-1] = (parts[-1][0], end, -1)
                else:
                    parts.append((start, end, -1 if end - start <= LEAF else depth + 1))
            if len(parts) > 1:
                work.append(((a, b), len(parts)))
            work.extend((start, end, max(deep, 0)) for start, end, deep in reversed(parts))
        return done[0]

    def walk(self, places: np.ndarray, repeats: np.ndarray, best: Best) -> None:
        """Offers to ``best`` every document that may belong there, most promising branches first."""
        bounds = (self.bounds[:, places] @ repeats).tolist()
        stack = [self.root]
        while stack:
            node = stack.pop()
            if bounds[node] < best.bar:
                continue
            below = self.children[node]
            if below:
                stack.extend(sorted(below, key=bounds.__getitem__))
            else:
                a, b = self.ranges[node]
                best.offer(self.shares[a:b, places] @ repeats, self.ids[a:b])


class Best:
    """The k best (score, id) of an item so far; ``bar`` is the score that a further document must reach."""

    def __init__(self, k: int) -> None:
        self.k, self.bar = k, 1
        self.rows: list[tuple[int, int]] = []

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bar
        if good.any():
            self.rows = sorted([*self.rows, *zip((-scores[good]).tolist(), ids[good].tolist())])[: self.k]
            if len(self.rows) == self.k:
                self.bar = -self.rows[-1][0]


def task_lists(vectors: DataFrame, block: Block, stats: Statistics, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best documents of every task for every item of the block."""
    spark = vectors.sparkSession
    frozen = spark.sparkContext.broadcast((stats, [(stats.place[t], r) for t, r in zip(block.terms, block.repeats)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, items = frozen.value
        best = [Best(k) for _ in items]
        step = max(1, CELLS // len(stats.weight))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
                tree = Tree(stats, ids, *(part.column(c).to_pylist() for c in ("n", "terms", "counts")))
                for (places, repeats), list_ in zip(items, best):
                    tree.walk(places, repeats, list_)
        rows = [(item, None if i == _LAST else i, -s) for item, list_ in enumerate(best) for s, i in list_.rows]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["item", "doc_id", "score"])

    return vectors.where("length(terms) > 0").mapInArrow(run, "item int, doc_id long, score long")


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    vectors = written(restricted_vectors(docs, block.number), "vectors")
    sizes = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    stats = Statistics.of(sizes.documents, max(sizes.terms, 1), document_counts(vectors, len(block.number)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = task_lists(vectors, block, stats, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(block.item_ids)), "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 for every item."""
    found = [search_block(docs, block, k) for block in blocks_of(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)
