"""Language ID: code lengths against a plain coder, the sample's bounds, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, rows

from stockrisk.llm import language_ppm
from stockrisk.llm.blocks import table, text_bytes
from stockrisk.llm.language_ppm import BEFORE, ORDER, Known
from stockrisk.llm.queries import queries


class PlainCoder:
    """The same code, symbol by symbol, with sets of excluded bytes."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for text in texts:
            line = bytes([BEFORE] * ORDER) + text.lower().encode()
            for i in range(ORDER, len(line)):
                for k in range(ORDER + 1):
                    self.counts[line[i - k : i]][line[i]] += 1

    def probability(self, context, symbol):
        p, excluded = 1.0, set()
        for k in range(ORDER, -1, -1):
            seen = {x: n for x, n in self.counts.get(context[ORDER - k :], {}).items() if x not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return p * seen[symbol] / total
            p *= len(seen) / total
            excluded |= set(seen)
        return p / (256 - len(excluded))

    def bits(self, text):
        line = bytes([BEFORE] * ORDER) + text.lower().encode()
        return -sum(math.log2(self.probability(line[i - ORDER : i], line[i])) for i in range(ORDER, len(line)))


@pytest.fixture(scope="module")
def two():
    rnd = random.Random(5)
    texts = {"x": ["abra cadabra", "Abracadabra aba", "a", "abba\nabba"], "y": ["".join(rnd.choice("xyzé ") for _ in range(300)) for _ in range(3)]}
    trees = language_ppm.trees_of([k for k, v in texts.items() for _ in v], pa.array([t for v in texts.values() for t in v]))
    return texts, trees


def lengths(trees, texts):
    return trees.code_lengths(*text_bytes(pa.array(texts, pa.string()), lower=True), Known())


def test_code_lengths_equal_a_plain_coder(two):
    texts, trees = two
    coders = [PlainCoder(v) for v in texts.values()]
    tried = ["abracadabra", "ABBA", "zzyx é", "", "new words: ÿ 日本", None, "\x00\x01", "a" * 50]
    found = lengths(trees, tried)
    assert trees.names == ["x", "y"]
    for text, row in zip(tried, found):
        assert row.tolist() == pytest.approx([c.bits(text or "") for c in coders], abs=1e-3)


def test_probabilities_sum_to_one(two):
    texts, trees = two
    for context in (b"abra", b"xyz ", b"qqqq", b"\n\n\n\n", b"dabr"):
        keys = np.uint64(int.from_bytes(context, "big") << 8) + np.arange(256, dtype=np.uint64)
        assert np.exp2(-trees.bits(keys)).sum(axis=0).tolist() == pytest.approx([1.0, 1.0], abs=1e-3)


def test_lengths_do_not_depend_on_slices(two, monkeypatch):
    trees = two[1]
    tried = ["abracadabra abba", "zzyx é yyz", "", "words and words"] * 5
    whole = lengths(trees, tried)
    monkeypatch.setattr(language_ppm, "CHUNK", 7)
    monkeypatch.setattr(language_ppm, "REMEMBERED", 20)
    assert (lengths(trees, tried) == whole).all()


def test_sample_is_bounded_and_distinct(spark):
    rnd = random.Random(2)
    data = [(i, "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(1, 200))), "en" if i % 3 else "fr") for i in range(3000)]
    data += [(i, "the same text in many rows", "en") for i in range(5000, 7000)] + [(9001, "b" * 20_000, "en"), (9002, "t", None), (9003, None, "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    sample = language_ppm.training_rows(docs, 8, 40_000).collect()
    held_out = {t for i, t, _ in data if zlib.crc32(str(i).encode()) % 4 == 2} - {t for i, t, _ in data if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len({(r.lang, r.text) for r in sample}) == len(sample) and not held_out & {r.text for r in sample}
    for lang in ("en", "fr"):
        size = sum(len(r.text) for r in sample if r.lang == lang)
        assert 15_000 < size <= 20_000
    only = language_ppm.training_rows(docs, 1, 40_000).collect()
    assert {r.lang for r in only} == {"en"}
    everything = language_ppm.training_rows(docs, 8, 1 << 24).collect()
    assert {r.text for r in everything} == {t for i, t, g in data if t and g and zlib.crc32(str(i).encode()) % 4 != 2}


def test_odd_rows(spark):
    found = language_ppm.predict(documents(spark)).collect()
    assert sorted((r.doc_id, r.held_out) for r in found if r.doc_id is not None) == sorted(
        (r[0], zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows() if r[0] is not None
    )
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {4, 5, 6}
    assert all(r.lang_pred == "en" and r.score == 1 for r in found if r.lang_pred != "und")
    assert language_ppm.predict(empty(spark)).count() == 0
    unlabelled = documents(spark).selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {(r.lang_pred, r.score) for r in language_ppm.predict(unlabelled).collect()} == {("und", 0.0)}


def test_labels_of_the_scored_rows_do_not_matter(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    trees = language_ppm.learn(docs)
    plain = language_ppm.identify(docs, trees).collect()
    changed = language_ppm.identify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "source"), trees).collect()
    assert sorted(plain) == sorted(changed)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in table(spark, folder, "documents").collect()}
    found = queries()["op11_language_ppm"](spark, folder).collect()
    held_out = [r for r in found if r.held_out]
    assert len(found) == len(lang) and len(held_out) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in held_out) / len(held_out) >= 0.97
    assert all(0 <= r.score <= 1 and r.lang_pred in {*lang.values(), "und"} for r in found)
