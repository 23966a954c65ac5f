"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from fixtures import by_row, documents, empty, rows, words

from stockrisk.llm import lexical_search, queries
from stockrisk.llm.lexical_search import Best, Statistics, Tree

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return TERM.findall(lower)


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in counted if c)
    total = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            m = 75 + 25 * c.total() * n // max(total, 1)
            score = 0
            for t in terms(text):
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def test_terms():
    for text in ("A-b c9_d;É日\x00x", None, "", " ,. ", "word " * 9):
        assert [t for part in lexical_search.term_lists(text) for t in part] == terms(text)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 5)
    text = "several words, longer-than five\tbytes " * 20 + "y" * 50
    parts = list(lexical_search.term_lists(text))
    assert [t for part in parts for t in part] == terms(text) and len(parts) > 20


def shape(tree, node, depth=0):
    yield node, depth
    for child in tree.children[node]:
        yield from shape(tree, child, depth + 1)


@pytest.mark.parametrize("leaf", [1, 4])
def test_tree_bounds_and_walk(monkeypatch, leaf):
    monkeypatch.setattr(lexical_search, "LEAF", leaf)
    rnd = random.Random(leaf)
    kinds, n = 40, 300
    docs = [Counter(min(int(rnd.expovariate(0.2)), kinds - 1) for _ in range(rnd.randint(1, 30))) for _ in range(n)]
    sizes = [c.total() + rnd.randint(0, 60) for c in docs]
    df = np.array([sum(t in c for c in docs) for t in range(kinds)])
    stats = Statistics.of(n, sum(sizes), df)
    pack = [np.array(list(x), np.uint32).tobytes() for c in docs for x in (c.keys(), c.values())]
    tree = Tree(stats, np.arange(n), sizes, pack[::2], pack[1::2])
    nodes = dict(shape(tree, tree.root))
    assert len(nodes) == len(tree.ranges) and max(nodes.values()) > 3
    assert sorted(x for v in nodes if not tree.children[v] for x in range(*tree.ranges[v])) == list(range(n))
    for node in nodes:
        a, b = tree.ranges[node]
        assert (tree.bounds[node] >= tree.shares[a:b].max(axis=0)).all()
        if tree.children[node]:  # a path is shared: the documents of a branch agree up to its fork
            spans = [tree.ranges[c] for c in tree.children[node]]
            assert (spans[0][0], spans[-1][1]) == (a, b) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    left_out = 0
    for _ in range(60):
        item = Counter(rnd.randrange(kinds) for _ in range(rnd.randint(1, 12)))
        places, repeats = stats.place[np.array(list(item))], np.array(list(item.values()))
        best, offered = Best(5), []
        offer = best.offer
        best.offer = lambda scores, ids: (offered.extend(ids.tolist()), offer(scores, ids))
        tree.walk(places, repeats, best)
        scores = tree.shares[:, places] @ repeats
        expected = sorted((-s, i) for s, i in zip(scores.tolist(), tree.ids.tolist()) if s > 0)[:5]
        assert best.rows == expected
        left_out += n - len(offered)
    assert left_out > 60 * n * 0.2


ITEMS = [
    (1, " ".join(words(12, 1))),
    (2, "one two ONE"),
    (3, None),
    (4, "..."),
    (None, "text with the same id"),
    (2, "one two ONE"),
    (5, "日本語 letters x x q"),
    (6, "nowhere-to-be-found"),
    (7, " ".join(words(3000, 4))),
]


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical_search, "TERMS", 10)
        monkeypatch.setattr(lexical_search, "LEAF", 1)
    docs = [(r[0], r[1]) for r in rows()]
    items = spark.createDataFrame([(*i, 1, "x") for i in ITEMS], "item_id long, text string, doc_id int, score string")
    assert len(list(lexical_search.blocks_of(items))) == (4 if small else 1)
    for k in (20, 3):
        found = by_row(lexical_search.search(documents(spark), items, k), "item_id", "rank", "doc_id", "score")
        assert found == sorted(brute(docs, ITEMS, k), key=repr)
    assert lexical_search.search(empty(spark), items).count() == 0
    assert lexical_search.search(documents(spark), items.where("false")).count() == 0
    assert lexical_search.search(documents(spark).where("text IS NULL"), items).count() == 0


def test_many_equal_documents(spark):
    docs = [(i, "the same words here") for i in range(500)] + [(i, "the others") for i in range(500, 900)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "same words"), (2, "the")]
    found = by_row(lexical_search.search(frame, spark.createDataFrame(items, "item_id long, text string")), "item_id", "rank", "doc_id", "score")
    assert found == sorted(brute(docs, items), key=repr) and {r[2] for r in found if r[0] == 1} == set(range(20))


def test_query_equals_twin(spark):
    folder, name = "/root/testdata/sf0.01", "op13_lexical_search"
    assert difference(spark, connect(folder), folder, name, queries.queries()[name], queries.SQL[name]) is None
