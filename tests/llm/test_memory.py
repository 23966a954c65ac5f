"""What the text operators hold at once, in a task and on the driver."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from stockrisk.llm import blocks, packed_keys


def test_a_group_is_unpacked_without_a_second_copy():
    rng = np.random.default_rng(1)
    packed, expected = [], []
    for _ in range(200):
        keys = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
        owners = np.sort(rng.integers(0, 50, 5000))
        places = np.arange(5000) % 700 * 3
        tags = (owners * 7).astype(np.uint32)
        packed += packed_keys.pack(keys, np.zeros(5000, np.uint64), owners, tags, places, 1)
        expected.append(sorted(zip(owners.tolist(), tags.tolist(), places.tolist(), keys.tolist())))
    group = packed_keys.packed_batch(packed)
    table = pa.Table.from_batches([group.slice(0, 90), group.slice(90)])
    tracemalloc.start()
    keys, owners, tags, places = packed_keys.unpack_all(table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.2 * sum(x.nbytes for x in (keys, owners, tags, places))
    found = list(zip(owners.tolist(), tags.tolist(), places.tolist(), keys.tolist()))
    assert [sorted(found[i : i + 5000]) for i in range(0, len(found), 5000)] == expected


def test_rows_without_keys_are_unpacked():
    rows = list(packed_keys.pack(None, np.zeros(3, np.uint64), np.array([5, 5, 9]), np.array([1, 1, 2]), np.array([4, 300, 0]), 1))
    keys, *others = packed_keys.unpack_all(pa.Table.from_batches([packed_keys.packed_batch(rows)]))
    assert len(keys) == 0 and [x.tolist() for x in others] == [[5, 5, 9], [1, 1, 2], [4, 300, 0]]
    assert [len(x) for x in packed_keys.unpack_all(pa.Table.from_batches([packed_keys.packed_batch([])]))] == [0, 0, 0, 0]


def test_buckets_hold_the_keys_of_16_mb_of_text(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('x', 16 * 1024 * 1024) AS text")
    assert packed_keys.buckets_of(docs) == 40


def test_an_id_map_takes_one_megabyte(spark):
    ids = [0, 1, 63, 64, 1000, blocks.SET_BITS - 1, blocks.SET_BITS + 5, -1, 1 << 60, None]
    bits = blocks.id_bits(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert bits.nbytes < 1.1 * (1 << 20)
    asked = np.array([i for i in ids if i is not None])
    assert blocks.maybe_in(bits, asked).all()
    others = np.array([2, 62, 65, 999, 6_000_000])
    assert not blocks.maybe_in(bits, others).any()
    assert blocks.maybe_rows(bits, pa.array([1, None, 2], pa.int64())).tolist() == [True, False, False]
    assert not blocks.maybe_in(blocks.id_bits(spark.createDataFrame([], "doc_id long")), asked).any()


def test_no_part_of_a_round_of_components_is_planned_twice(spark, monkeypatch):
    plans = []

    def written(df, purpose):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, purpose)

    kept = blocks.written
    monkeypatch.setattr(blocks, "written", written)
    chain = spark.range(40).selectExpr("id + 1 AS a", "id AS b")
    found = blocks.components(chain.union(spark.sql("SELECT 100L, 90L")))
    assert {r.id: r.component_id for r in found.collect()} == {i: 0 for i in range(41)} | {90: 90, 100: 90}
    assert max(plan.count("Join ") for plan in plans) <= 3
