"""Substring, line, near-duplicate and embedding dedup against brute force."""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import numpy as np
import pytest
from fixtures import by_row, closure, documents, empty, rows

from stockrisk.llm import embedding_dedup, line_dedup, minhash_dedup, substring_dedup
from stockrisk.llm.blocks import components
from stockrisk.llm.hnsw import Graph


def split(text):
    return (text or "").encode().split()


def brute_windows(size):
    firsts: dict[tuple, int] = {}
    table = [(r[0], split(r[1])) for r in rows()]
    for doc_id, w in table:
        for i in range(len(w) - size + 1):
            if doc_id is not None:
                key = tuple(w[i : i + size])
                firsts[key] = min(firsts.get(key, doc_id), doc_id)
    out = []
    for doc_id, w in table:
        gone = set()
        for i in range(len(w) - size + 1):
            if doc_id is not None and firsts[tuple(w[i : i + size])] < doc_id:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_windows(spark):
    found = substring_dedup.remove_repeats(documents(spark))
    assert by_row(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(50)
    removed = {r.doc_id: [(x.start, x.end) for x in r.removed] for r in found.collect() if r.removed}
    assert removed[3] == [(0, 120)] and removed[10] == [(2, 62)]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def one_edit(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.EDIT_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def test_lines(spark):
    table = [(r[0], r[1]) for r in rows()]
    every = [(d, i, x.encode().lower().split()) for d, t in table if t is not None for i, x in enumerate(t.split("\n"))]
    expected = []
    for doc_id, text in table:
        lines = [] if text is None else text.split("\n")
        gone = {
            i
            for i, line in enumerate(lines)
            if doc_id is not None
            and line.encode().split()
            and any(d is not None and (d, j) < (doc_id, i) and w and one_edit(w, line.encode().lower().split()) for d, j, w in every)
        }
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        expected.append((doc_id, kept, len(lines), len(gone)))
    found = line_dedup.remove_lines(documents(spark))
    assert by_row(found, "doc_id", "text", "n_lines", "n_removed") == sorted(expected, key=repr)
    assert {r.rest.rest for r in found.collect()} == {"clash"}
    assert line_dedup.remove_lines(empty(spark)).count() == 0


def test_near_duplicates(spark):
    sets: dict[int, list[set]] = {}
    for doc_id, text, *_ in rows():
        w = (text or "").encode().lower().split()
        s = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
        sets.setdefault(doc_id, []).append(s)
    ids = [i for i in sets if i is not None]
    links = [
        (a, b)
        for a, b in itertools.combinations(ids, 2)
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    ]
    component = closure(ids, links) | {None: None}
    expected = sorted(
        ((i, len(s), component[i], i is None or component[i] == i) for i, group in sets.items() for s in group), key=repr
    )
    found = minhash_dedup.near_duplicates(documents(spark), shingle=4)
    assert by_row(found, "doc_id", "n_shingles", "component_id", "kept") == expected
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_large_buckets_of_near_copies(spark):
    """A chain of edits: neighbours are alike, the ends are not; every link must be found, in blocks and after pivots."""
    rng = np.random.default_rng(4)
    text = [f"t{i}" for i in range(80)]
    docs = []
    for i in range(150):
        text = list(text)
        text[int(rng.integers(80))] = f"e{i}"
        docs.append((i, " ".join(text)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(77)} for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=4)
    assert {r.doc_id: r.component_id for r in found.collect()} == closure(list(sets), links)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    table = minhash_dedup.super_minhash(np.r_[np.sort(x[:200]), np.sort(x[20:220])], np.array([0, 200, 400]))
    assert abs((table[0] == table[1]).mean() - 180 / 220) < 0.12
    counts = Counter((table >> np.uint64(53)).ravel().tolist())
    assert max(counts) < 20  # early stop: levels of 200 elements stay low


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component_id for r in found.collect()} == closure([*range(61), 100, 101, 102], pairs)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.12
    hot = np.repeat(rng.normal(size=(1, 16)), 90, axis=0) + rng.normal(size=(90, 16)) * 0.03
    table = np.concatenate([base, near, hot, base[:20]])
    odd = [(9001, None, "a"), (9002, [0.0] * 16, "a"), (9003, [float("nan")] * 16, "a"), (9004, [None] * 16, "a"), (9005, [1.0], "a")]
    odd += [(9006, base[0].tolist(), None), (9007, [], "a"), (9008, (base[0] * 3).tolist(), "a"), (None, base[0].tolist(), "a")]
    return [(i, v.tolist(), "ab"[i % 7 == 0]) for i, v in enumerate(table)] + odd


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_embeddings(spark, vectors, shard_rows):
    good = {}
    for i, v, label in vectors:
        if v and label is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = (np.array(v), label)
    links = [
        (a, b)
        for a, b in itertools.combinations(good, 2)
        if good[a][1] == good[b][1]
        and len(good[a][0]) == len(good[b][0])
        and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93
    ]
    count = Counter(i for pair in links for i in pair)
    component = closure([i for i, _, _ in vectors if i is not None], links) | {None: None}
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label string")
    found = embedding_dedup.near_duplicates(frame, shard_rows=shard_rows)
    expected = [(i, count[i], component[i], i is None or component[i] == i) for i, _, _ in vectors]
    assert by_row(found, "vec_id", "n_links", "component_id", "kept") == sorted(expected, key=repr)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_huge_and_tiny_components_and_clashing_columns(spark):
    data = [
        (1, [1e200, 1e200], "a"),
        (2, [1e-200, 1.0000001e-200], "a"),
        (3, [5e-324, 5e-324], "a"),
        (4, [-1.7e308, 1.7e308], "a"),
        (5, [-1.0, 1.0], "a"),
        (6, [0.0, 0.0], "a"),
        (7, [float("inf"), 1.0], "a"),
        (8, [1.0, None], "a"),
        (9, [3.0, 3.0], "b"),
    ]
    frame = spark.createDataFrame([(*r, 1, "g", 2) for r in data], "vec_id long, embedding array<double>, label string, shard int, graph string, size int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), **{i: (0, i) for i in (6, 7, 8, 9)}}


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[700:1400] = x[:700] + rng.normal(size=(700, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = Graph.build(x)
    assert sorted(order.tolist()) == list(range(1500))
    truth = {(a, b) for a, b in np.argwhere(graph.unit @ graph.unit.T >= 0.93).tolist() if a != b}
    loaded = Graph.load(graph.dump())
    for audit, least in ((np.zeros(0, int), 0.9), (np.arange(0, 1500, 150), 0.99)):
        one, two, recall = embedding_dedup.range_search(loaded, graph.unit, 0.93, audit, own=True)
        found = len(truth & set(zip(one.tolist(), two.tolist()))) / len(truth)
        assert found >= least and (not len(audit) or recall == found)


def test_few_links_widen_the_audit():
    """Ten audited rows meet no link; the shard's six links are found all the same, whatever the beam finds at first."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 24)).astype(np.float32)
    x[:3] = x[100:103] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = Graph.build(x)
    place = np.argsort(order)
    links = {(int(place[a]), int(place[b])) for i in range(3) for a, b in ((i, 100 + i), (100 + i, i))}
    audit = np.setdiff1d(np.arange(800), [a for a, _ in links])[:10]
    one, two, recall = embedding_dedup.range_search(graph, graph.unit, 0.93, audit, own=True)
    assert links <= set(zip(one.tolist(), two.tolist())) and recall == 1.0
