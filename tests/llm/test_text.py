"""Token records, piece lattice, decontamination, and the pipeline."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from fixtures import by_row, closure, documents, empty, rows, words
from tokenizers import Tokenizer

import corpus_pipeline
from stockrisk.llm import decontamination, piece_lattice, token_records, toxicity
from stockrisk.llm.blocks import table


def test_token_records(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_records.VOCABULARY))
    start, expected = 0, []
    for doc_id, text, *_ in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_records.encode_documents(documents(spark))
    assert by_row(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert token_records.encode_documents(empty(spark)).count() == 0


def test_special_tokens_keep_their_case(spark):
    """The library finds special tokens in the text as given and lowers the rest."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(token_records.VOCABULARY))
    rnd = random.Random(3)
    parts = ["<|EndOfText|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "Ab", "b.", "a<|endoftext|>B,", "<", "|>", "<|X|>", "É<b", " "]
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|endoftext|>"] + [" ".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(300)]
    texts += ["".join(rnd.choices(parts, k=4)) for _ in range(200)]
    found = token_records.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    expected = [
        (i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        for i, ids in enumerate([*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts)
    ]
    assert by_row(found, "doc_id", "n_tokens", "ids_crc32") == sorted(expected, key=repr)


def test_records_are_framed_and_checked(spark, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = token_records.write_records(documents(spark), folder).collect()
    row = next(r for r in manifest if r.n_docs > 1)
    system, base = pafs.FileSystem.from_uri(folder)
    data = system.open_input_file(f"{base}/{row.path}.rec").read()
    offsets = np.frombuffer(system.open_input_file(f"{base}/{row.path}.idx").read(), "<u8")
    assert len(offsets) == row.n_docs and len(data) == row.n_bytes
    payload, end = token_records.unframe(memoryview(data), int(offsets[1]))  # any record by its offset
    assert len(payload) >= 8 + row.width and end == (offsets[2] if row.n_docs > 2 else row.n_bytes)
    assert struct.unpack_from("<Q", data, int(offsets[1]))[0] == len(payload)
    damaged = bytearray(data)
    damaged[int(offsets[1]) + 14] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_records.unframe(memoryview(damaged), int(offsets[1]))


@pytest.fixture(scope="module")
def lattice():
    return piece_lattice.Lattice(public_tokenizers.path(piece_lattice.VOCABULARY))


def every_path(lattice, unit):
    if not unit:
        return [(0.0, [])]
    out = []
    for j in range(1, len(unit) + 1):
        if unit[:j] in lattice.pieces:
            i, s = lattice.pieces[unit[:j]]
            out += [(s + a, [i, *b]) for a, b in every_path(lattice, unit[j:])]
    wide = len(unit.decode()[:1].encode())
    if unit[:wide] not in lattice.pieces:
        spelt = [lattice.byte_id[c] for c in unit[:wide]]
        out += [(wide * lattice.byte_score + a, spelt + b) for a, b in every_path(lattice, unit[wide:])]
    return out


def test_n_best_segmentations_equal_enumeration(lattice):
    rnd = random.Random(1)
    parts = ["the", "ion", "a", "b", "é", "ß", "☃", "▁", " ", "\n", "  ", ".", "x", "日"]
    for _ in range(150):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 5)))
        units, first = lattice.units([text])
        found = lattice.n_best(units[first[0] : first[1]], 4)
        best = sorted(every_path(lattice, (" " + text).encode()) if text else [(0.0, [])], key=lambda x: -x[0])[:4]
        assert np.allclose([s for s, _ in found], [s for s, _ in best])
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
        assert all(lattice.decode(ids) == text for _, ids in found)


def test_long_units(lattice):
    units, first = lattice.units(["q" * 3000, "w" * 30])
    assert lattice.decode(lattice.n_best(units[first[0] : first[1]], 4)[0][1]) == "q" * 3000
    one = lattice.search(b" " + b"w" * 20, 3)
    assert [s for s, _ in one] == sorted((s for s, _ in one), reverse=True)


def test_piece_lattice(spark):
    found = piece_lattice.encode(documents(spark)).collect()
    assert len(found) == len(rows()) and all(r.decoded == (r.text or "") for r in found)
    short = piece_lattice.encode_digests(documents(spark))
    assert all(r.decoded for r in short.collect()) and piece_lattice.encode(empty(spark)).count() == 0


def split(text):
    word, out = "", []
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_leaks(docs, items):
    """All item-sized windows that hold a shared shingle at its place, compared by weights."""
    out = set()
    for doc_id, text in docs:
        w = split(text)
        for item_id, item in items:
            x = split(item)
            k, n = min(5, len(x)), len(x)
            if not x:
                continue
            own = [tuple(x[i : i + k]) for i in range(n - k + 1)]
            for pos in range(len(w) - k + 1):
                for at, shingle in enumerate(own):
                    if tuple(w[pos : pos + k]) == shingle:
                        start = max(0, min(pos - at, len(w) - n))
                        part = w[start : start + n]
                        theirs = [tuple(part[i : i + k]) for i in range(len(part) - k + 1)]
                        kinds = set(own) | set(theirs)
                        less = sum(min(own.count(s), theirs.count(s)) for s in kinds)
                        more = sum(max(own.count(s), theirs.count(s)) for s in kinds)
                        if 100 * less >= 80 * more:
                            out.add((doc_id, item_id, start, n, less / more))
    return sorted(out, key=repr)


def test_leaks(spark):
    item, other = words(40, 90, 10**6), words(25, 91, 10**6)
    edge = [*item]
    edge[0] = "changed"
    middle = [*item]
    middle[15], middle[30] = "changed", "again"
    docs = [(r[0], r[1]) for r in rows()]
    docs += [
        (50, " ".join(["before", *item, "after"]).upper()),
        (51, "; ".join(edge)),
        (52, " ".join(middle)),
        (53, " ".join(other[:20])),
        (54, " ".join(words(30, 92) + other + words(30, 93) + other)),
        (55, "tiny item"),
    ]
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, "Tiny item."), (4, None), (5, "..."), (6, " ".join(item)), (None, "")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, start string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = by_row(decontamination.leaks(frame, bench), "doc_id", "item_id", "start", "n_words", "similarity")
    assert found == brute_leaks(docs, items)
    assert {r[0] for r in found} == {50, 51, 54, 55}
    assert decontamination.leaks(frame, bench.where("false")).count() == 0
    assert decontamination.leaks(frame.where("false"), bench).count() == 0


def test_leaks_of_repeated_rows(spark):
    item = words(40, 94, 10**6)
    text = " ".join(["before", *item, "after"])
    docs = [(60, text)] + [(61, text)] * 2 + [(62, text)] * 3 + [(None, text)] * 2 + [(62, "another text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = by_row(decontamination.leaks(frame, bench), "doc_id", "item_id", "start", "n_words", "similarity")
    assert found == sorted([(i, 1, 1, 40, 1.0) for i in (60, 61, 62, None)], key=repr)


def test_no_python_in_the_plan(spark):
    plan = decontamination.leaks(documents(spark), table(spark, "/root/testdata/sf0.001", "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    now, ids = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, folder), name)
        assert now.dtypes == docs.dtypes
        left = {r.doc_id for r in now.collect()}
        assert left <= ids and left
        ids = left
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} == ids and all(r.round_trip for r in found)
    planted = {r.doc_id for r in decontamination.leaks(docs, table(spark, folder, "benchmark")).collect()}
    assert not planted & ids


PLANTED = "doc_id long, text string, lang string, source string, n_chars long, rest string, score double, label string, n_lines int"


def planted(folder_rows, items):
    """Clean, repeated, near, leaking and odd rows beside the given documents."""
    clean = [" ".join(words(60, s, 10**6)) for s in range(200, 210)]
    line = " ".join(words(20, 220, 10**6))
    near = clean[1].split()
    near[30] = "changed"
    texts = [(9000 + i, t) for i, t in enumerate(clean)]
    texts += [
        (9100, clean[0]),
        (9101, "\n".join([line, "tail of its own that nobody else has here"])),
        (9102, "\n".join(["a first line that is nowhere else found", line.upper()])),
        (9103, line),
        (9104, " ".join(near)),
        (9105, " ".join(words(30, 230, 10**6) + items[0].split() + words(30, 231, 10**6))),
        (9106, None),
        (9107, ""),
        (9108, clean[2]),
        (9108, clean[3] + " and more of it"),
        (None, clean[4]),
        (None, None),
    ]
    return [(*r, "x", 0.5, "y", 3) for r in folder_rows] + [(i, t, "en", "s", 0, "x", 0.5, "y", 3) for i, t in texts]


def brute_lines(docs):
    lines = [(d, i, x.encode().lower().split()) for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))]
    first: dict = {}
    for d, i, w in lines:
        if d is not None and w:
            keys = [("full", tuple(w))] + ([("gap", p, len(w), *w[:p], *w[p + 1 :]) for p in range(len(w))] if len(w) >= 8 else [])
            keys += [("less", *w[:p], *w[p + 1 :]) for p in range(len(w))] if len(w) > 8 else []
            for k in keys:
                first[k] = min(first.get(k, (d, i)), (d, i))

    def earlier(d, i, w):
        keys = [("full", tuple(w))]
        if len(w) >= 8:
            keys += [("gap", p, len(w), *w[:p], *w[p + 1 :]) for p in range(len(w))] + [("less", *w)]
        if len(w) > 8:
            keys += [("full", tuple(w[:p] + w[p + 1 :])) for p in range(len(w))]
        return any(k in first and first[k] < (d, i) for k in keys)

    out = []
    for d, t in docs:
        kept = None if t is None else [x for i, x in enumerate(t.split("\n")) if d is None or not x.encode().split() or not earlier(d, i, x.encode().lower().split())]
        same = t is None or len(kept) == len(t.split("\n"))
        if same or "".join(kept).encode().split():
            out.append((d, t if same else "\n".join(kept)))
    return out


def brute_near(docs):
    sets: dict = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        if d is not None and w:
            sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    holders: dict = {}
    for d, group in sets.items():
        for s in group:
            for x in s:
                holders.setdefault(x, set()).add(d)
    links = set()
    for d, group in sets.items():
        for s in group:
            for other in {e for x in s for e in holders[x]} - {d}:
                if any(100 * len(s & o) >= 80 * len(s | o) for o in sets[other]):
                    links.add((d, other))
    component = closure(list(sets), sorted(links))
    return [(d, t) for d, t in docs if component.get(d, d) == d]


def test_pipeline_stages_equal_plain_rules(spark):
    """Every stage by itself, on documents with planted cases, against plain rules over what its predecessor kept."""
    folder = "/root/testdata/sf0.001"
    names = table(spark, folder, "documents").columns
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    given = planted([tuple(r[n] for n in names) for r in table(spark, folder, "documents").collect()], [t for _, t in items])
    docs = spark.createDataFrame(given, PLANTED)

    def run(number, now):
        out = corpus_pipeline.written(corpus_pipeline.STAGES[number][1](spark, now, folder), "stage")
        return out, sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    def content(frame):
        return [(r.doc_id, r.text) for r in frame.collect()]

    first, kept = run(0, docs)
    labels = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    toxic = {i for i, t in labels.items() if t == 1}
    assert first.dtypes == docs.dtypes
    gone = {d for d, t, *_ in given} - {d for d, _ in kept}
    assert gone & {i for i, t in labels.items() if t == 0} == set()
    scored = toxicity.score_documents(docs, table(spark, folder, "labels"))  # tested by itself in test_models
    assert gone == {r.doc_id for r in scored.where("predicted = 1").collect()} and len(gone & toxic) >= 5
    assert [x for x in kept if x[0] is None or x[0] >= 9000] == sorted(((d, t) for d, t, *_ in given if d is None or d >= 9000), key=repr)

    second, lines = run(1, first)
    assert lines == sorted(brute_lines(content(first)), key=repr) and second.dtypes == docs.dtypes
    assert (9103, line_text(given, 9103)) not in lines and 9102 in {d for d, _ in lines}

    third, near = run(2, second)
    assert near == sorted(brute_near(content(second)), key=repr)
    assert {9100, 9104} & {d for d, _ in near} == set() and (None, None) in near and third.dtypes == docs.dtypes

    fourth, clean = run(3, third)
    leaking = {d for d, *_ in brute_leaks(content(third), items)} - {None}
    assert clean == sorted(((d, t) for d, t in content(third) if d not in leaking), key=repr) and 9105 in leaking

    found = corpus_pipeline.STAGES[4][1](spark, fourth, folder).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((d for d, _ in clean), key=repr)
    assert all(r.round_trip for r in found)


def line_text(given, doc_id):
    return next(t for d, t, *_ in given if d == doc_id)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
