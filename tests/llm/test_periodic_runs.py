"""Periodic runs against trying every period at every place."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from fixtures import by_row, documents, empty, rows

from stockrisk.llm import periodic_runs
from stockrisk.llm.blocks import table
from stockrisk.llm.queries import queries


def brute_runs(words):
    """Stretches with period q, extended as far as they go, whose smallest period is q."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                piece = words[i : i + length]
                if not any(piece[d:] == piece[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(texts):
    codes, first = periodic_runs.coded(texts)
    out = [[] for _ in texts]
    for row, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(codes, first))):
        out[row].append(tuple(run))
    return out


@pytest.mark.parametrize("kinds", [1, 2, 3, 6])
def test_runs_of_random_words(kinds):
    rnd = random.Random(kinds)
    texts = []
    for _ in range(400):
        words = []
        while len(words) < rnd.randint(0, 150):
            unit = [rnd.choice("abcdefgh"[:kinds]) for _ in range(rnd.randint(1, 25))]
            words += (unit * rnd.randint(1, 7))[: rnd.randint(1, 120)]
        texts.append([w.encode() for w in words])
    assert found_runs(texts) == [brute_runs(t) for t in texts]


def test_runs_of_structured_words():
    a, b = ["a"], ["b"]
    for _ in range(11):  # Fibonacci words: dense in repetitions below the limit
        a, b = a + b, a
    nested = ((["x"] * 7 + ["y"]) * 5 + ["z"]) * 4
    long = [f"w{i}" for i in range(700)] * 4 + ["end"]
    short = [f"w{i}" for i in range(700)] * 3 + [f"w{i}" for i in range(699)]
    texts = [[w.encode() for w in t] for t in (a, nested, long, short, ["s"] * 5, ["s"] * 6, ["p", "q"] * 4, ["p", "q", "p"])]
    assert found_runs(texts) == [brute_runs(t) for t in texts]
    assert found_runs([[b"x"] * 200_000])[0] == [(0, 200_000, 1)]


def test_neighbouring_rows_do_not_meet():
    texts = [[b"s"] * 4, [b"s"] * 4, [], [b"s"] * 7, [b"t", b"s"]]
    assert found_runs(texts) == [[], [], [], [(0, 7, 1)], []]


def test_equal_hashes_of_different_words_make_no_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "range_hash", lambda values, starts, ends, seed: np.zeros(len(starts), np.uint64))
    assert found_runs([[b"a", b"b", b"c", b"d"] * 2 + [b"e"] * 3]) == [[]]


def test_classes_cover_every_period():
    for n in (5, 6, 100, 5000):
        spans = list(periodic_runs.classes(n))
        periods = [q for low, high, _ in spans for q in range(low, high + 1)]
        assert periods == list(range(1, len(periods) + 1)) and (n < 6 or len(periods) >= n // 4)
        assert all(high <= k <= max(6, 4 * low) - low for low, high, k in spans)


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id,
        len(runs),
        *(top or (None, None, None)),
        1000 * top[1] // top[2] if top else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    found = periodic_runs.digests(periodic_runs.periodic_runs(documents(spark), periodic_runs.repeated_tail))
    small = [r for r in rows() if r[0] != 8]
    assert by_row(found.where("doc_id IS NULL OR doc_id <> 8"), *COLUMNS) == sorted((expected(r[0], r[1]) for r in small), key=repr)
    assert found.where("doc_id = 8").first().n_runs == 1
    assert found.columns == COLUMNS and periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    found = queries()["op12_periodic_runs"](spark, folder)
    docs = table(spark, folder, "documents").collect()
    result = by_row(found, *COLUMNS)
    assert result == sorted((expected(r.doc_id, r.text) for r in docs), key=repr)
    assert sum(r[1] > 0 for r in result) >= 10
