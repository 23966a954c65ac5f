"""Language-model scores by online logistic context mixing: hashed-context bit predictors, gated weights, adaptive refinement.

A text is its words (A-Z lowered), each followed by a blank, and one end, as bytes.  A byte is eight bits, from the upper one
down.  Six predictors see each bit: the counts of zeros and ones under the bits before it in its byte and the last 0 to
``ORDER`` bytes.  Their log odds are added with weights; the longest context seen, how often it has been seen, and whether it
has always given the same bit select (gate) the set of weights.  The mixed probability is averaged with what came of like
mixtures before (an adaptive map per gate).  A bit and its complement have probabilities that add up to one, so all texts do.

What a byte costs depends on it and the ``ORDER`` bytes before it, its window, alone.  So the work is done on windows:

1. every task counts the windows of its training texts and notes those of the others; they are added up by hashed context,
   so that a bucket holds all that follows the last two bytes of a context, and with them all longer contexts.  The
   counts under one byte or none are 65,536 numbers that every task gets;
2. online mixing: a task reads its buckets' windows in a scattered order, predicts each bit of a few thousand without their
   own occurrence, and moves the weights of each gate by a Newton step on all that the gate has seen, so that steps grow
   smaller as it reads; the maps take in what came.  Spark averages weights by what their gates saw, and adds up the maps;
3. the code length of every window is written, in units of 2**-16 bits, so that sums do not depend on slices;
4. every text is read and its windows added up.  The ``HOT`` most frequent windows are held by every task; the others of
   each text are joined with the written ones.

All that is gathered grows with the texts: the windows with their counts and the words.  ``HOT`` and ``HEAD`` only decide which
of them are looked up in a task and which by a join; scores are the same.  The score of a text depends on its own words and
on the training texts.

``base_score`` is the sum over tokens of log10((c + 1) / (N + V + 1)); counts of words beyond the ``HEAD`` most frequent come from
a join.

Defined results: a null text is empty (an end only); rows with a null id are scored, are not held out, and train; rows that
repeat an id are scored one by one; without training texts nothing is known and all bytes are equally likely; an empty
table gives an empty table; further columns are dropped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import Words, mix, ragged, slices, words_of
from stockrisk.llm.language_ppm import windows
from stockrisk.llm.toxicity import fold
from stockrisk.session import written

ORDER = 5
HEAD = 1 << 17
HOT = 1 << 20
TASK_WINDOWS = 1 << 21  # windows that a task counts before it passes them on
BUCKET_TOKENS = 1 << 22
MOST_BUCKETS = 1 << 16
CHUNK = 1 << 20
STEP = 4096  # windows whose bits are predicted with the same weights
FOLDS, HELD_OUT = 7, 2
GATES = (ORDER + 1) * 8
INPUTS = ORDER + 2
CELLS = 33
HOLD = 50.0  # what a gate must have seen before its weights move freely
UNIT = 65536.0
LEAST = 2.0**-20  # no bit is less likely
_BLANK, _END = 32, 10
_U = np.uint64


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a slice of texts, words followed by blanks and the texts by ends, and the offsets of the texts."""
    sizes, rows = words.ends - words.starts, words.rows
    places = np.cumsum(sizes + 1) - (sizes + 1) + rows
    length = np.bincount(rows, weights=sizes + 1, minlength=len(words.first) - 1).astype(np.int64) + 1
    offsets = np.r_[0, np.cumsum(length)]
    data = np.full(offsets[-1], _BLANK, np.uint8)
    data[ragged(places, sizes)] = words.data[ragged(words.starts, sizes)]
    data[offsets[1:] - 1] = _END
    return data, offsets


# Counts ------------------------------------------------------------------------------------------------------------------

_COUNTED = "bucket int, keys binary, counts binary"


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)


def _by_bucket(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Windows dealt by a hash of the last two bytes of their context."""
    bucket = (mix(((keys >> _U(8)) & _U(0xFFFF)) + _U(1)) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, keys, counts = bucket[order], keys[order], counts[order]
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    spans = list(zip(edges[:-1], edges[1:]))
    columns = [
        pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
        pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
        pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "counts"])


def _count_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in slices(batches):
            learns = ~part.column("held_out").to_numpy(zero_copy_only=False)
            data, offsets = stream(words_of(part.column("text"), lower=True))
            for begin in range(0, len(data), CHUNK):
                window, row = windows(data, offsets, begin, min(begin + CHUNK, len(data)), ORDER)
                which, distinct = pd.factorize(window)
                keys.append(distinct)
                counts.append(np.bincount(which, weights=learns[row], minlength=len(distinct)).astype(np.int64))
                if sum(map(len, keys)) > TASK_WINDOWS:
                    all_keys, all_counts = _added(np.concatenate(keys), np.concatenate(counts))
                    if len(all_keys) > TASK_WINDOWS // 2:
                        yield _by_bucket(all_keys, all_counts, buckets)
                        all_keys, all_counts = all_keys[:0], all_counts[:0]
                    keys, counts = [all_keys], [all_counts]
        yield _by_bucket(*_added(np.concatenate(keys), np.concatenate(counts)), buckets)

    return run


def _merge(group: pa.Table) -> pa.Table:
    keys, counts = (np.frombuffer(b"".join(group.column(n).to_pylist()), t) for n, t in (("keys", np.uint64), ("counts", np.int64)))
    keys, counts = _added(keys, counts)
    bucket = group.column("bucket").slice(0, 1)
    return pa.table({"bucket": bucket, "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})


def counted_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """``bucket, keys, counts``: the sorted windows of all texts and how often they stand in the training texts."""
    packed = rows.select("held_out", "text").mapInArrow(_count_windows(buckets), _COUNTED)
    return written(packed.groupBy("bucket").applyInArrow(_merge, _COUNTED), "windows")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bucket by bucket."""
    for batch in batches:
        for bucket, keys, counts in zip(*(batch.column(n) for n in ("bucket", "keys", "counts"))):
            yield bucket.as_py(), np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)


def _sums(vectors: DataFrame, size: int) -> np.ndarray:
    """Sums of ``cell, value`` rows; at most one number per cell reaches the driver."""
    out = np.zeros(size)
    for row in written(vectors.groupBy("cell").agg(F.sum("value").alias("value")), "sums").collect():
        out[row.cell] = row.value
    return out


def _cells(values: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(values)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at])], ["cell", "value"])


def pair_counts(counted: DataFrame) -> np.ndarray:
    """How often each byte follows each byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16)
        for _, keys, counts in _unpacked(batches):
            total += np.bincount((keys & _U(0xFFFF)).astype(np.int64), weights=counts, minlength=1 << 16)
        yield _cells(total)

    return _sums(counted.mapInArrow(run, "cell int, value double"), 1 << 16).reshape(256, 256)


# Mixing ------------------------------------------------------------------------------------------------------------------


def bits_of(keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits of the windows' bytes: the bit, and the zeros and ones that each context has seen there.

    ``keys`` are all windows of their contexts of two bytes and more; the shorter contexts' counts are those of ``pairs``.
    """
    byte, last = (keys & _U(255)).astype(np.int64), ((keys >> _U(8)) & _U(255)).astype(np.int64)
    orders = []
    for k in range(2, ORDER + 1):
        low = keys & ((_U(1) << _U(8 * (k + 1))) - _U(1))
        orders.append((k, low, np.argsort(low, kind="stable")))
    every = np.arange(256)
    for i in range(8):
        bit, node = (byte >> (7 - i)) & 1, (1 << i) | (byte >> (8 - i))
        place, side = (1 << i) | (every >> (8 - i)), (every >> (7 - i)) & 1
        after = np.zeros((2, 256, 256))
        np.add.at(after, (side[None, :], every[:, None], place[None, :]), pairs)
        seen = np.empty((2, ORDER + 1, len(keys)), np.float32)
        seen[:, 0], seen[:, 1] = after.sum(axis=1)[:, node], after[:, last, node]
        for k, low, order in orders:
            group, times, ones = (low >> _U(8 - i))[order], counts[order].astype(np.float64), bit[order]
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            spread = np.diff(np.r_[heads, len(group)])
            for y in (0, 1):
                seen[y, k, order] = np.repeat(np.add.reduceat(times * (ones == y), heads), spread)
        yield bit, seen[0], seen[1]


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the predictors say (inputs x bits), and the gate of each bit."""
    x = np.full((INPUTS, zeros.shape[1]), 0.3, np.float32)
    x[:-1] = np.log((ones + 0.3) / (zeros + 0.3))
    total, here = zeros + ones, np.arange(zeros.shape[1])
    longest = np.zeros(len(here), np.int64)
    for k in range(1, ORDER + 1):
        longest[total[k] > 0] = k
    n = total[longest, here]
    steps = (n > 1).astype(np.int64) + (n > 3) + (n > 12)
    return x, longest * 8 + steps * 2 + (np.minimum(zeros, ones)[longest, here] == 0)


class Mixer:
    """Weights and maps of all gates."""

    def __init__(self) -> None:
        self.weights = np.full((GATES, INPUTS), 0.3, np.float32)
        self.weights[:, -1] = 0
        self.bend = np.tile(np.eye(INPUTS) * HOLD, (GATES, 1, 1))
        self.hits, self.total = np.zeros((GATES, CELLS)), np.zeros((GATES, CELLS))

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weighted log odds of each bit and its cell of the maps."""
        dot = np.clip((self.weights[gate].T * x).sum(axis=0), -14, 14)
        return dot, gate * CELLS + np.clip(dot * 2 + CELLS / 2, 0, CELLS - 1).astype(np.int64)

    def learn(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> None:
        """Read the training windows of a bucket once: predict, look, and move."""
        own = np.flatnonzero(counts > 0)
        own = own[np.argsort(mix(keys[own]), kind="stable")]
        for bit, zeros, ones in bits_of(keys, counts, pairs):
            for a in range(0, len(own), STEP):
                at = own[a : a + STEP]
                y, times = bit[at].astype(np.float32), counts[at].astype(np.float64)
                x, gate = _inputs(np.maximum(zeros[:, at] - (1 - y), 0), np.maximum(ones[:, at] - y, 0))
                dot, cell = self._mixed(x, gate)
                self.hits += np.bincount(cell, weights=times * y, minlength=GATES * CELLS).reshape(GATES, CELLS)
                self.total += np.bincount(cell, weights=times, minlength=GATES * CELLS).reshape(GATES, CELLS)
                p = _squash(dot)
                pull, bend = (y - p) * times, np.maximum(p * (1 - p), 1e-4) * times
                for j in range(INPUTS):
                    for k in range(j, INPUTS):
                        more = np.bincount(gate, weights=bend * x[j] * x[k], minlength=GATES)
                        self.bend[:, j, k] += more
                        if k > j:
                            self.bend[:, k, j] += more
                pulls = np.stack([np.bincount(gate, weights=pull * x[j], minlength=GATES) for j in range(INPUTS)], axis=1)
                self.weights += np.linalg.solve(self.bend, pulls[:, :, None])[:, :, 0].astype(np.float32)

    def vector(self) -> np.ndarray:
        """Sums over tasks of these vectors make the mixer of all: what each gate saw, its weights times that, and its maps."""
        seen = self.total.sum(axis=1, keepdims=True)
        return np.concatenate([seen, seen * self.weights, self.hits, self.total], axis=1).ravel()

    @classmethod
    def of(cls, vector: np.ndarray) -> Mixer:
        rows = vector.reshape(GATES, -1)
        mixer = cls()
        seen = rows[:, 0] > 0
        mixer.weights[seen] = (rows[seen, 1 : INPUTS + 1] / rows[seen, :1]).astype(np.float32)
        mixer.hits, mixer.total = rows[:, INPUTS + 1 : INPUTS + 1 + CELLS], rows[:, INPUTS + 1 + CELLS :]
        return mixer

    def lengths(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Code length of the byte of every window of a bucket, in units."""
        middle = (np.arange(CELLS) - CELLS / 2 + 0.5) / 2
        refined = ((self.hits + 2 * _squash(middle)) / (self.total + 2)).ravel()
        out = np.zeros(len(keys))
        for bit, zeros, ones in bits_of(keys, counts, pairs):
            for a in range(0, len(keys), CHUNK):
                at = slice(a, a + CHUNK)
                dot, cell = self._mixed(*_inputs(zeros[:, at], ones[:, at]))
                p = np.clip((_squash(dot) + refined[cell]) / 2, LEAST, 1 - LEAST)
                out[at] -= np.log2(np.where(bit[at] == 1, p, 1 - p))
        return np.rint(out * UNIT).astype(np.int32)


VECTOR = GATES * (1 + INPUTS + 2 * CELLS)


def fit(counted: DataFrame, pairs: np.ndarray) -> Mixer:
    """One reading of all training windows: every task mixes its buckets online, and their mixers are averaged."""
    frozen = counted.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VECTOR)
        for _, keys, counts in _unpacked(batches):
            mixer = Mixer()
            mixer.learn(keys, counts, frozen.value)
            total += mixer.vector()
        yield _cells(total)

    return Mixer.of(_sums(counted.mapInArrow(run, "cell int, value double"), VECTOR))


def window_lengths(counted: DataFrame, pairs: np.ndarray, mixer: Mixer) -> DataFrame:
    """``bucket, keys, counts, units``: the counted windows with the code length of each."""
    frozen = counted.sparkSession.sparkContext.broadcast((pairs, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, mixer = frozen.value
        for bucket, keys, counts in _unpacked(batches):
            columns = [[bucket], [keys.tobytes()], [counts.tobytes()], [mixer.lengths(keys, counts, pairs).tobytes()]]
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "keys", "counts", "units"])

    return written(counted.mapInArrow(run, _COUNTED + ", units binary"), "lengths")


def _listed(lengths: DataFrame, least: int, most: int) -> DataFrame:
    """``key, units`` of the windows that are counted ``least`` to ``most`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(_unpacked(iter([batch])), batch.column("units")):
                _, keys, counts = part
                use = (counts >= least) & (counts <= most)
                units = np.frombuffer(packed.as_buffer(), np.int32)[use]
                yield pa.RecordBatch.from_arrays([pa.array(keys[use].astype(np.int64)), pa.array(units)], ["key", "units"])

    return lengths.mapInArrow(run, "key long, units int")


def hot_windows(lengths: DataFrame, hot: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of a hot window, and the keys and code lengths of these, at most ``hot``, by key."""
    top = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(top + 1)
        for _, _, counts in _unpacked(batches):
            total += np.bincount(np.minimum(counts, top), minlength=top + 1)
        yield _cells(total)

    at_least = np.cumsum(_sums(lengths.mapInArrow(run, "cell int, value double"), top + 1)[::-1])[::-1]
    fits = np.flatnonzero(at_least <= hot)
    least = int(fits[0]) if len(fits) else top + 1
    found = _listed(lengths, least, np.iinfo(np.int64).max).toArrow() if len(fits) else None
    if found is None or not found.num_rows:
        return least, np.zeros(0, np.uint64), np.zeros(0, np.int32)
    keys, units = (found.column(n).to_numpy() for n in ("key", "units"))
    order = np.argsort(keys)
    return least, keys[order].astype(np.uint64), units[order]


# Scores ------------------------------------------------------------------------------------------------------------------


def _distinct_words(words: Words) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a slice and which of them each word is."""
    one, two = words.hashes(1), words.hashes(2)
    _, sample, which = np.unique(one, return_index=True, return_inverse=True)
    if (two[sample][which] != two).any():  # two words with one hash: every word for itself
        sample = which = np.arange(len(one))
    data = words.data.tobytes()
    return [data[a:b] for a, b in zip(words.starts[sample].tolist(), words.ends[sample].tolist())], which


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    ends = 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for part in slices(batches):
        ends += part.num_rows
        names, which = _distinct_words(words_of(part.column("text"), lower=True))
        for name, n in zip(names, np.bincount(which, minlength=len(names)).tolist()):
            total[name] += n
        if len(total) > 200_000:
            yield rows()
            total.clear()
    if ends:
        total[b""] = ends  # no word is empty: the end
        yield rows()


def _lists(row: np.ndarray, what: np.ndarray, n_rows: int, n_kinds: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Per row its distinct kinds and how often: offsets, kinds, times."""
    pair, times = np.unique(row * max(n_kinds, 1) + what, return_counts=True)
    owner, kind = pair // max(n_kinds, 1), pair % max(n_kinds, 1)
    return pa.array(np.searchsorted(owner, np.arange(n_rows + 1)), pa.int32()), kind, times


def _structs(offsets: pa.Array, name: str, values: pa.Array, times: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([values, pa.array(times.astype(np.int64))], [name, "n"]))


_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, known long, logs double, units long, size long,"
    " rare array<struct<word: binary, n: long>>, cold array<struct<key: long, n: long>>"
)


def _score(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hot_keys, hot_units = shared.value
        for part in slices(batches):
            words, n_rows = words_of(part.column("text"), lower=True), part.num_rows
            names, which = _distinct_words(words)
            count = np.fromiter((head.get(w, -1) for w in [*names, b""]), np.int64, len(names) + 1)
            rows, mine = words.rows, count[:-1][which]
            common = mine >= 0
            known = np.bincount(rows[common], minlength=n_rows) + (count[-1] > 0)
            logs = np.bincount(rows[common], weights=np.log10(mine[common] + 1.0), minlength=n_rows) + np.log10(max(count[-1], 0) + 1.0)
            offsets, kind, times = _lists(rows[~common], which[~common], n_rows, len(names))
            rare = _structs(offsets, "word", pa.array([names[k] for k in kind.tolist()], pa.binary()), times)
            data, edges = stream(words)
            units, cold = np.zeros(n_rows, np.int64), []
            for begin in range(0, len(data), CHUNK):
                window, row = windows(data, edges, begin, min(begin + CHUNK, len(data)), ORDER)
                which, distinct = pd.factorize(window)
                at = np.minimum(np.searchsorted(hot_keys, distinct), max(len(hot_keys) - 1, 0))
                found = hot_keys[at] == distinct if len(hot_keys) else np.zeros(len(distinct), bool)
                cost = np.zeros(len(distinct))
                cost[found] = hot_units[at[found]]
                units += np.bincount(row, weights=cost[which], minlength=n_rows).astype(np.int64)
                open_ = ~found[which]
                cold.append((row[open_], window[open_]))
            row, window = (np.concatenate(x) for x in zip(*cold))
            which, distinct = pd.factorize(window)
            offsets, kind, times = _lists(row, which, n_rows, len(distinct))
            size = np.bincount(rows, weights=words.ends - words.starts, minlength=n_rows).astype(np.int64)
            arrays = [pa.array(x) for x in (words.counts + 1, known, logs, units, size)]
            colds = _structs(offsets, "key", pa.array(distinct[kind].astype(np.int64), pa.int64()), times)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), *arrays, rare, colds],
                ["doc_id", "held_out", "n_tokens", "known", "logs", "units", "size", "rare", "cold"],
            )

    return run


def score_documents(docs: DataFrame, head: int = HEAD, hot: int = HOT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row."""
    spark = docs.sparkSession
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held, "text")
    words = rows.where("NOT held_out").select("text").mapInArrow(_count_words, "word binary, n long")
    counts = written(words.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    tokens, distinct = total.tokens or 0, total.distinct
    end = counts.where("length(word) = 0").toArrow().to_pylist()  # one row, or none without training texts
    top = counts.where("length(word) > 0").orderBy(F.desc("n"), "word").limit(head).toArrow().to_pylist() + end

    counted = counted_windows(rows, int(min(max(8, tokens // BUCKET_TOKENS), MOST_BUCKETS)))
    pairs = pair_counts(counted)
    lengths = window_lengths(counted, pairs, fit(counted, pairs))
    least, keys, units = hot_windows(lengths, hot)
    shared = spark.sparkContext.broadcast(({row["word"]: row["n"] for row in top}, keys, units))
    scored = written(rows.mapInArrow(_score(shared), _SCORED).withColumn("row", F.monotonically_increasing_id()), "scores")

    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    met = rare.join(counts.select("word", F.col("n").alias("c")), "word")
    extra = met.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    cold = scored.select("row", F.explode("cold").alias("r")).select("row", "r.key", "r.n")
    told = cold.join(_listed(lengths, 0, least - 1), "key")
    spelt = told.groupBy("row").agg(F.sum(F.col("n") * F.col("units")).alias("more_units"))
    joined = scored.drop("rare", "cold").join(extra, "row", "left").join(spelt, "row", "left")
    norm = float(np.log10(tokens + distinct + 1))
    log2 = float(np.log10(2)) / UNIT
    score = -(F.col("units") + F.coalesce("more_units", F.lit(0))) * F.lit(log2)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        score.alias("score"),
        F.when(F.col("size") > 0, -score / F.lit(float(np.log10(2))) / F.col("size")).alias("bits_per_byte"),
    )
