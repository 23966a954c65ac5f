"""Quality, language-model score and toxicity."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, rows

from stockrisk.llm import context_mixing, quality, toxicity
from stockrisk.llm.blocks import table, words_of
from stockrisk.llm.language_ppm import windows

FOLDER = "/root/testdata/sf0.01"


def test_weak_labels_follow_reliable_rules():
    rng = np.random.default_rng(0)
    junk = rng.random(4000) < 0.2
    right = [0.95, 0.9, 0.9, 0.6, 0.55]
    votes = np.stack([np.where(rng.random(4000) < p, np.where(junk, 1, 2), np.where(junk, 2, 1)) for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.weak_labels(patterns, counts.astype(float))
    assert ((posterior[which.ravel()] > 0.5) == junk).mean() > 0.95


def test_quality(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    judged = {r.doc_id: r for r in quality.judge(table(spark, FOLDER, "documents")).collect()}
    right = [judged[i].kept == bool(q) for i, q in labels.items() if i in judged and q is not None]
    assert len(judged) == 1000 and sum(right) / len(right) > 0.95
    small = quality.judge(documents(spark)).collect()
    assert len(small) == len(rows()) and all(0 <= r.score <= 1 and 0 <= r.junk_label <= 1 for r in small)
    assert all(r.kept for r in small if r.text in (None, "", " \t\n "))
    assert quality.judge(empty(spark)).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    first = np.array([0, 0, 4, 4, 9])
    scores, move, begin = rng.normal(size=9), np.exp(rng.normal(size=(2, 2))), 0.4
    p, _, _ = toxicity.marginals(scores, first, move, begin)
    for a, b in zip(first[:-1], first[1:]):
        n, total = b - a, 0.0
        sums = np.zeros(n)
        for path in range(1 << n):
            tags = [(path >> k) & 1 for k in range(n)]
            weight = begin ** tags[0] if n else 1.0
            weight *= math.prod(math.exp(scores[a + k]) for k in range(n) if tags[k])
            weight *= math.prod(move[tags[k], tags[k + 1]] for k in range(n - 1))
            total += weight
            sums += weight * np.array(tags)
        assert np.allclose(p[a:b], sums / total)


def test_toxicity(spark):
    labels = table(spark, FOLDER, "labels")
    scored = {r.doc_id: r for r in toxicity.score_documents(table(spark, FOLDER, "documents"), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id in scored}
    for r in scored.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)
        assert all(0 <= s.start < s.end <= len(r.text) for s in r.spans)
    held = [i for i in truth if scored[i].held_out]
    assert sum(scored[i].predicted == truth[i] for i in held) / len(held) > 0.85


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score_documents(documents(spark), labels).collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
    nothing = toxicity.score_documents(documents(spark), labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.0}
    assert toxicity.score_documents(empty(spark), labels).count() == 0


def test_offsets_count_characters():
    texts = ["éé bad, ok", "so bad"]
    model = toxicity.fit([f"a{i} bad b{i}" for i in range(40)] + [f"c{i} d{i}" for i in range(40)], [1] * 40 + [0] * 40)
    words = words_of(pa.array(texts), lower=True)
    _, p = toxicity.score(model, words)
    assert [round(float(x)) for x in p] == [0, 1, 0, 0, 1]


@pytest.mark.parametrize("source", ["odd", "sf"])
def test_language_model(spark, source):
    docs = documents(spark) if source == "odd" else table(spark, FOLDER, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts: Counter = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            counts["end"] += 1
    total, kinds = sum(counts.values()), len(counts)
    expected = {}
    for i, t in texts:
        tokens = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in tokens)
        expected.setdefault(i, []).append((len(tokens), sum(counts[x] > 0 for x in tokens), total, pytest.approx(base, abs=1e-4)))
    found: dict = {}
    gain = 0.0
    for r in context_mixing.score_documents(docs, head=2000).collect():
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert r.score < 0 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        gain += 0 if r.held_out else r.score - r.base_score
    assert {i: sorted(x) for i, x in found.items()} == {i: sorted(x, key=lambda t: t[:2]) for i, x in expected.items()}
    assert source == "odd" or gain > 0


def test_language_model_of_nothing(spark):
    assert context_mixing.score_documents(empty(spark)).count() == 0


def test_weights_learn_from_all_training_texts(spark, monkeypatch):
    seen, real = [], context_mixing.window_lengths

    def spy(counted, pairs, mixer):
        seen.append((mixer.total.sum(), pairs.sum()))
        return real(counted, pairs, mixer)

    monkeypatch.setattr(context_mixing, "window_lengths", spy)
    docs = table(spark, FOLDER, "documents").unionByName(spark.createDataFrame([(10**6, "one long text " * 6000)], "doc_id long, text string"), True)
    held = [r for r in context_mixing.score_documents(docs).collect() if r.held_out]
    words = [(r.doc_id, (r.text or "").split()) for r in docs.collect()]
    size = sum(1 + sum(len(w.encode()) + 1 for w in t) for i, t in words if zlib.crc32(str(i).encode()) % 7 != 2)
    assert seen == [(8 * size, size)]  # every bit of every training text, once
    assert sum(r.score for r in held) > 1.03 * sum(r.base_score for r in held)


def test_held_out_rows_alone(spark):
    """Without training texts nothing is known, not even the end."""
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame(list(zip(ids, ["two words", "", None])), "doc_id long, text string")
    found = sorted(context_mixing.score_documents(docs).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert found[0].score == pytest.approx(-11 * 8 * math.log10(2), rel=1e-6)


def test_stream_of_tokens():
    words = words_of(pa.array(["Two  words", None, " x ", ""]), lower=True)
    data, offsets = context_mixing.stream(words)
    assert bytes(data) == b"two words \n\nx \n\n" and offsets.tolist() == [0, 11, 12, 15, 16]


def window_counts(texts):
    data, offsets = context_mixing.stream(words_of(pa.array(texts), lower=True))
    keys, _ = windows(data, offsets, 0, len(data), context_mixing.ORDER)
    keys, counts = np.unique(keys, return_counts=True)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, ((keys >> np.uint64(8) & np.uint64(255)).astype(int), (keys & np.uint64(255)).astype(int)), counts)
    return keys, counts, pairs


def test_counts_of_bits_equal_plain_counting():
    keys, counts, pairs = window_counts(["abra cadabra abra", "a cab", "banana bandana", ""])
    strings = [(int(k).to_bytes(6, "big"), int(c)) for k, c in zip(keys, counts)]
    for i, (bit, zeros, ones) in enumerate(context_mixing.bits_of(keys, counts, pairs)):
        for at, (own, _) in enumerate(strings):
            assert bit[at] == own[5] >> (7 - i) & 1
            for k in range(context_mixing.ORDER + 1):
                alike = [(s, c) for s, c in strings if s[5 - k : 5] == own[5 - k : 5] and s[5] >> (8 - i) == own[5] >> (8 - i)]
                assert ones[k, at] == sum(c for s, c in alike if s[5] >> (7 - i) & 1)
                assert zeros[k, at] + ones[k, at] == sum(c for _, c in alike)


def test_probabilities_of_bytes_sum_to_one():
    keys, counts, pairs = window_counts(["abra cadabra abra " * 3, "a cab", "banana bandana", "other words in here"])
    mixer = context_mixing.Mixer()
    mixer.learn(keys, counts, pairs)
    merged = context_mixing.Mixer.of(2 * mixer.vector())
    assert np.allclose(merged.weights, mixer.weights) and merged.total.sum() == 16 * counts.sum()
    for context in (b"cadab", b"zzzzz", b"abra ", b"xband"):
        all_bytes = np.uint64(int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        every = np.union1d(keys, all_bytes)
        times = np.zeros(len(every), np.int64)
        times[np.searchsorted(every, keys)] = counts
        units = merged.lengths(every, times, pairs)[np.searchsorted(every, all_bytes)]
        assert np.exp2(-units / context_mixing.UNIT).sum() == pytest.approx(1, abs=1e-3)


def test_what_is_looked_up_by_a_join_costs_the_same(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    few = context_mixing.score_documents(docs, head=50, hot=500).collect()
    none = context_mixing.score_documents(docs, head=0, hot=0).collect()
    many = context_mixing.score_documents(docs).collect()
    for other in (few, none):
        for x, y in zip(sorted(other), sorted(many)):
            assert (x.doc_id, x.n_known, x.score) == (y.doc_id, y.n_known, pytest.approx(y.score, rel=1e-4))
            assert x.base_score == pytest.approx(y.base_score, rel=1e-9)


def test_what_is_gathered_grows_with_the_input(spark):
    sizes = []
    for folder in ("/root/testdata/sf0.001", FOLDER):
        rows = table(spark, folder, "documents").selectExpr("doc_id", "false AS held_out", "text")
        counted = context_mixing.counted_windows(rows, 8).collect()
        assert len({r.bucket for r in counted}) == len(counted) <= 8
        sizes.append(sum(len(r.keys) // 8 for r in counted))
    assert sizes[1] > 2 * sizes[0]
