"""Toxicity: a linear-chain conditional random field tags toxic words; its forward-backward marginals give each document a
score and the offending spans.

Only documents carry labels, so the words are labelled first: in toxic training texts, a word is toxic if it or its first 4,
5 or 6 bytes stand in many toxic training texts and, as a share, ``STRONG`` times less often in clean ones.  Copies count
once.  The field then learns from words, their beginnings and ends, and their neighbours, hashed into ``2**BITS`` weights.
A logistic function of the largest marginals, their sum and the text's length turns marginals into the score; it is
fitted on training texts that the field did not see.

Training uses a bounded sample: of the training labels those with the smallest hashed ids, at most ``train_toxic`` and
``train_clean`` texts and ``train_bytes`` bytes in all, so that the model and the time for it do not grow with the data.
Scoring covers every whole text.  ``lang``, ``source``, ``doc_id`` and the labels are no inputs of a score.

Defined results: null and empty texts score as a text without words; a document labelled more than once is toxic if any
of its labels is 1; null labels are no labels; rows that repeat an id are scored one by one; if the training labels are all
alike, all texts get their share of toxic ones (0 without labels).  All other columns come back in ``rest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import BYTE_VALUES, RangeHash, Words, mix, release, slices, words_of
from stockrisk.llm.line_dedup import with_rest

BITS = 20
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1000, 2000, 6 << 20
STRONG, SURE = 20.0, 15.0
EPOCHS, BATCH_DOCS, RATE = 4, 64, 0.5
LANE = 256
_U = np.uint64
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def trimmed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words without marks at their ends; a word of marks keeps its first byte."""
    starts, ends = words.starts.copy(), words.ends.copy()
    while True:
        cut = (ends - starts > 1) & _MARK[words.data[ends - 1]]
        if not cut.any():
            break
        ends[cut] -= 1
    while True:
        cut = (ends - starts > 1) & _MARK[words.data[starts]]
        if not cut.any():
            break
        starts[cut] += 1
    return starts, ends


def word_marks(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its first 4, 5 and 6 bytes (0 where it has no more than these), of its first 3 and its
    last 4 bytes."""
    starts, ends = trimmed(words)
    hashed = RangeHash(BYTE_VALUES[words.data], 1)
    out = [hashed(starts, ends)]
    for k in (4, 5, 6):
        out.append(np.where(ends - starts > k, hashed(starts, np.minimum(starts + k, ends)), _U(0)))
    out.append(hashed(starts, np.minimum(starts + 3, ends)))
    out.append(hashed(np.maximum(ends - 4, starts), ends))
    return out


def features(words: Words) -> list[np.ndarray]:
    """Numbers of the words' features, one array per kind: the word's own marks and its neighbours in the document."""
    marks = word_marks(words)
    whole = marks[0]
    before, after = np.roll(whole, 1), np.roll(whole, -1)
    filled = words.counts > 0
    before[words.first[:-1][filled]], after[words.first[1:][filled] - 1] = _U(1), _U(2)
    kinds = [*marks, before, after]
    # The marks are scrambled already; an odd factor per kind keeps the kinds apart.
    return [((m * _U(2 * k + 0x9E3779B1)) >> _U(64 - BITS)).view(np.int64) for k, m in enumerate(kinds)]


# Forward-backward ------------------------------------------------------------------------------------------------------


def _ratios(gain: np.ndarray, start: np.ndarray, move: np.ndarray, begin: float) -> np.ndarray:
    """x[t] = gain[t] * (move01 + x[t-1] * move11) / (move00 + x[t-1] * move10), and gain[t] * begin where ``start``.

    All lanes of ``LANE`` places advance together: first each lane's map as a 2 x 2 matrix, then the lanes' entry values one
    after another, then the values inside the lanes.
    """
    n = len(gain)
    lanes = -(-n // LANE)
    g = np.ones(lanes * LANE)
    s = np.zeros(lanes * LANE, bool)
    g[:n], s[:n] = gain, start
    g, s = np.ascontiguousarray(g.reshape(lanes, LANE).T), np.ascontiguousarray(s.reshape(lanes, LANE).T)
    # x = p / q with (p, q) = (a * p0 + b * q0, c * p0 + d * q0)
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for t in range(LANE):
        na, nb = g[t] * (move[0, 1] * c + move[1, 1] * a), g[t] * (move[0, 1] * d + move[1, 1] * b)
        nc, nd = move[0, 0] * c + move[1, 0] * a, move[0, 0] * d + move[1, 0] * b
        reset = s[t]
        # After a start the value no longer depends on what came before: p = gain * begin, q = 1 for any (p0, q0) > 0.
        na, nb = np.where(reset, g[t] * begin, na), np.where(reset, g[t] * begin, nb)
        nc, nd = np.where(reset, 1.0, nc), np.where(reset, 1.0, nd)
        size = np.maximum(np.maximum(na, nb), np.maximum(nc, nd))
        a, b, c, d = na / size, nb / size, nc / size, nd / size
    entry = np.empty(lanes)
    x = begin
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        entry[k] = x
        x = (ka * x + kb) / (kc * x + kd)
    out = np.empty((LANE, lanes))
    x = entry
    for t in range(LANE):
        x = g[t] * np.where(s[t], begin, (move[0, 1] + x * move[1, 1]) / (move[0, 0] + x * move[1, 0]))
        out[t] = x
    return out.T.ravel()[:n]


def marginals(scores: np.ndarray, first: np.ndarray, move: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(tag 1) of each word, and the forward and backward ratios; ``scores`` are log odds, ``move`` positive weights."""
    gain = np.exp(np.clip(scores, -30, 30))
    n = len(gain)
    start, last = np.zeros(n, bool), np.zeros(n, bool)
    filled = first[:-1] < first[1:]
    start[first[:-1][filled]] = True
    last[first[1:][filled] - 1] = True
    ahead = _ratios(gain, start, move, begin)
    # Backwards: y[t] = (move10 + move11 * z) / (move00 + move01 * z), z = gain[t+1] * y[t+1], and y = 1 at the end.  z follows
    # the same kind of map with the tags of the moves exchanged.
    z = _ratios(gain[::-1], last[::-1], move.T, 1.0)[::-1] if n else gain
    nxt = np.r_[z[1:], 1.0] if n else z
    back = np.where(last, 1.0, (move[1, 0] + move[1, 1] * nxt) / (move[0, 0] + move[0, 1] * nxt))
    odds = ahead * back
    return odds / (1 + odds), ahead, back


# Training --------------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: np.ndarray  # of the hashed features, as log odds of tag 1
    bias: float
    move: np.ndarray
    begin: float
    doc: np.ndarray | None  # of ``summary``; None: no field could be fitted
    share: float


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: 1, largest marginal, second largest, log(1 + sum), log(1 + words)."""
    docs = len(first) - 1
    n = np.diff(first)
    sums = np.r_[0.0, np.cumsum(p)]
    out = np.zeros((docs, 5))
    out[:, 0], out[:, 3], out[:, 4] = 1, np.log1p(np.maximum(sums[first[1:]] - sums[first[:-1]], 0)), np.log1p(n)
    filled = np.flatnonzero(n)
    if len(filled):
        heads = first[filled]
        top = np.maximum.reduceat(p, heads)
        out[filled, 1] = top
        rest = p.copy()
        rows = np.repeat(np.arange(len(filled)), n[filled])
        at = np.flatnonzero(p == top[rows])
        rest[at[np.r_[True, rows[at][1:] != rows[at][:-1]]]] = 0  # the first of the largest
        out[filled, 2] = np.maximum.reduceat(rest, heads)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def without_copies(words: Words, seen: list[set[int]]) -> np.ndarray:
    """Rows that do not repeat most of an earlier row: of four smallest word hashes at most one is in ``seen``, one set each."""
    hashes, keep = words.hashes(1), []
    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
        if a == b:
            continue
        own = np.unique(hashes[a:b])
        if b - a >= 3:  # pairs of words tell texts apart better than common words
            own = mix(hashes[a : b - 1] + mix(hashes[a + 1 : b]))
        least = [int(mix(own ^ _U(k * 0x9E3779B9 + 1)).min()) for k in range(4)]
        if sum(x in s for x, s in zip(least, seen)) < 2:
            keep.append(i)
        for x, s in zip(least, seen):
            s.add(x)
    return np.array(keep, np.int64)


def word_labels(rows: np.ndarray, marks: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """1 for the words of toxic rows that, or whose beginnings, are typical of toxic rows.  ``rows``: row of each word."""
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    out = np.zeros(len(rows), bool)
    for mark in marks:
        names, which = np.unique(mark, return_inverse=True)
        pairs = np.unique(rows * len(names) + which)  # each row counts once
        row, name = pairs // len(names), pairs % len(names)
        in_toxic = np.bincount(name[toxic[row]], minlength=len(names))
        in_clean = np.bincount(name[~toxic[row]], minlength=len(names))
        ratio = ((in_toxic + 0.5) / (n_toxic + 1)) / ((in_clean + 0.5) / (n_clean + 1))
        # Twice the log likelihood that toxic rows gain over the common rate.
        expected = (in_toxic + in_clean) * n_toxic / (n_toxic + n_clean)
        gain = 2 * in_toxic * np.log(np.maximum(in_toxic, 1) / expected)
        strong = (gain >= SURE) & (ratio >= STRONG) & (names != 0)
        out |= strong[which] & toxic[rows]
    return out


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    labels = np.array(toxic, bool)
    share = float(labels.mean()) if len(labels) else 0.0
    empty = Model(np.zeros(1 << BITS, np.float32), 0.0, np.ones((2, 2)), 1.0, None, share)
    if not 0 < labels.sum() < len(labels):
        return empty
    # Slice by slice, so that only numbers of the words stay in memory.
    column, seen, kept, counts, parts, marks = pa.array(texts, pa.string()), [set() for _ in range(4)], [], [], [], []
    at = 0
    for part in slices([pa.RecordBatch.from_arrays([column], ["text"])]):
        keep = without_copies(words_of(part.column("text"), lower=True), seen)
        words = words_of(part.column("text").take(pa.array(keep)), lower=True)
        kept.append(at + keep)
        counts.append(words.counts)
        parts.append(np.stack([f.astype(np.int32) for f in features(words)], axis=1))
        marks.append(word_marks(words)[:4])
        at += part.num_rows
    labels, counts, x = labels[np.concatenate(kept)], np.concatenate(counts), np.concatenate(parts)
    if not 0 < labels.sum() < len(labels):
        return empty
    starts = np.r_[0, np.cumsum(counts)]
    y = word_labels(np.repeat(np.arange(len(counts)), counts), [np.concatenate(m) for m in zip(*marks)], labels)
    del parts, marks
    # Every third document calibrates; the field learns from the others, if there are enough.
    docs = np.arange(len(counts))
    learn = docs % 3 != 2 if len(counts) >= 60 else np.ones(len(counts), bool)
    rng = np.random.default_rng(7)
    weights, grad_sq = np.zeros(1 << BITS), np.full(1 << BITS, 1e-2)
    bias, bias_sq = -4.0, 1e-2
    log_move, move_sq = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    log_begin = -4.0
    for _ in range(EPOCHS):
        order = rng.permutation(docs[learn])
        for a in range(0, len(order), BATCH_DOCS):
            own = order[a : a + BATCH_DOCS]
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
            first = np.r_[0, np.cumsum(counts[own])]
            if not len(at):
                continue
            tags, feats = y[at].astype(float), x[at]
            move = np.exp(log_move)
            p, ahead, back = marginals(weights[feats].sum(axis=1) + bias, first, move, np.exp(log_begin))
            error = p - tags
            grad = np.bincount(feats.ravel(), weights=np.repeat(error, feats.shape[1]), minlength=1 << BITS)
            touched = np.flatnonzero(grad)
            step = grad[touched] + 1e-3 * weights[touched]
            grad_sq[touched] += step**2
            weights[touched] -= RATE * step / np.sqrt(grad_sq[touched])
            total = error.sum()
            bias_sq += total**2
            bias -= RATE * total / np.sqrt(bias_sq)
            # Expected minus observed moves between neighbours.
            inner = np.ones(len(at), bool)
            inner[first[:-1][first[:-1] < len(at)]] = False
            t = np.flatnonzero(inner)
            if len(t):
                z = np.exp(np.clip(weights[feats[t]].sum(axis=1) + bias, -30, 30)) * back[t]
                left = np.stack([np.ones(len(t)), ahead[t - 1]], axis=1)
                right = np.stack([np.ones(len(t)), z], axis=1)
                joint = left[:, :, None] * move * right[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                seen = np.zeros((2, 2))
                np.add.at(seen, (tags[t - 1].astype(int), tags[t].astype(int)), 1)
                grad_move = joint.sum(axis=0) - seen
                move_sq += grad_move**2
                log_move -= 0.1 * grad_move / np.sqrt(move_sq)
                log_move = np.clip(log_move - log_move[0, 0], -6, 6)
    model = Model(weights.astype(np.float32), bias, np.exp(log_move), float(np.exp(log_begin)), None, share)
    p, _, _ = marginals(_log_odds(model, x.T), starts, model.move, model.begin)
    s = summary(p, starts)
    hold = ~learn if (~learn).any() and 0 < labels[~learn].sum() < (~learn).sum() else np.ones(len(labels), bool)
    model.doc = _logistic(s[hold], labels[hold].astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1.0  # length counts little
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _log_odds(model: Model, kinds: list[np.ndarray] | np.ndarray) -> np.ndarray:
    total = np.full(len(kinds[0]), model.bias)
    for numbers in kinds:
        total += model.weights[numbers]
    return total


def tag(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return marginals(_log_odds(model, features(words)), words.first, model.move, model.begin)


def score(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document scores, and the marginal of each word."""
    if model.doc is None:
        return np.full(len(words.first) - 1, model.share), np.zeros(len(words.starts))
    p, _, _ = tag(model, words)
    return _sigmoid(summary(p, words.first) @ model.doc), p


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def training_texts(
    docs: DataFrame, labels: DataFrame, train_toxic: int, train_clean: int, train_bytes: int
) -> tuple[list[str | None], list[int]]:
    """The bounded sample of labelled texts outside the held-out fold."""
    known = (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .where(fold("doc_id", 5) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .where("toxic IN (0, 1)")
    )
    picked = []
    for value, limit in ((1, train_toxic), (0, train_clean)):
        picked += known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    if not picked:
        return [], []
    spark = docs.sparkSession
    # At most ``train_toxic + train_clean`` rows of two numbers.
    sample = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int"))
    texts = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").join(sample, "doc_id")
    sizes = texts.selectExpr("doc_id", "coalesce(octet_length(text), 0) AS size").orderBy(F.xxhash64("doc_id"), "doc_id")
    use, total = [], 0
    for row in sizes.limit(train_toxic + train_clean).collect():
        if total + row.size <= train_bytes:
            use.append(row.doc_id)
            total += row.size
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(use))], "doc_id long"))
    rows = texts.join(chosen, "doc_id").orderBy("doc_id", "text").limit(train_toxic + train_clean).collect()
    return [r.text for r in rows], [r.toxic for r in rows]


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    train_toxic: int = TRAIN_TOXIC,
    train_clean: int = TRAIN_CLEAN,
    train_bytes: int = TRAIN_BYTES,
) -> DataFrame:
    """``doc_id, text, held_out, score, predicted, spans, rest`` for every row; spans are character offsets."""
    model = fit(*training_texts(docs, labels, train_toxic, train_clean, train_bytes))
    release()  # what the driver needed to fit
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = with_rest(docs)
    kind = rows.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"), lower=True)
            scores, p = score(shared.value, words)
            hit = np.flatnonzero(p >= 0.5)
            starts, ends = trimmed(words)
            letters = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
            row = np.searchsorted(words.first, hit, side="right") - 1
            offset = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False))]
            base = letters[offset[row].astype(int)]
            a, b = letters[starts[hit]] - base, letters[ends[hit]] - base
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            spans = pa.ListArray.from_arrays(
                pa.array(cuts, pa.int32()),
                pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]),
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), pa.array(scores, pa.float64()), spans, part.column("rest")],
                ["doc_id", "text", "score", "spans", "rest"],
            )

    scored = rows.mapInArrow(
        run, f"doc_id long, text string, score double, spans array<struct<start: long, end: long>>, rest {kind}"
    )
    return scored.select(
        "doc_id",
        "text",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "spans",
        "rest",
    )
