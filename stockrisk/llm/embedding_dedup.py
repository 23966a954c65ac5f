"""Embedding near-dedup: a navigable small-world graph per shard of a label; every shard is queried with every vector of
its label; links are verified by their cosine in double precision; components are joined.

Equal vectors of one label are one class, represented by its smallest id; graphs hold representatives.  Shards have about
``SHARD_ROWS`` of them.  One task takes a pair of shards and asks each graph for the vectors of the other (or of its own),
in memory bounded by two shards.  It starts with a beam of ``BEAM``.  A query whose beam holds links only asks again with
four times the beam, and past ``WIDEST`` compares with the whole shard.  Then the search is audited: a hashed tenth of the
queries (at least 256) is compared with the whole shard, and all beams double until ``RECALL`` of the audited links are
found.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or id
have no links and are their own component; so are vectors of another length than those they are compared with.  Rows
that repeat an id are vectors of their own.  Further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import components, mix
from stockrisk.llm.hnsw import Graph
from stockrisk.session import written

COSINE = 0.93
SHARD_ROWS = 8192
BEAM, WIDEST = 48, 192
RECALL = 0.99
FEW_LINKS = 100
SLACK = 1e-4  # single-precision similarities below the bound by so much are still verified

def scaled(values: np.ndarray) -> np.ndarray:
    """Vectors with the largest component of each between 0.5 and 1, by a power of two and so without rounding: squares of
    huge or tiny components neither overflow nor vanish."""
    top = np.abs(values).max(axis=-1, keepdims=True)
    return np.ldexp(values, -np.frexp(top)[1])


_MARKED = "vec_id long, label string, size int, d1 long, d2 long, valid boolean, embedding array<double>"


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ones, twos, valid = [], [], []
        for vector, label, vec_id in zip(*(batch.column(n).to_pylist() for n in ("embedding", "label", "vec_id"))):
            ok = bool(vector) and label is not None and vec_id is not None and None not in vector
            values = np.array(vector if ok else [0.0], np.float64)
            ok = ok and bool(np.isfinite(values).all() and values.any())
            digest = np.frombuffer(hashlib.md5((values + 0.0).tobytes()).digest(), np.int64)
            ones.append(int(digest[0]))
            twos.append(int(digest[1]))
            valid.append(ok)
        sizes = pa.array([len(v) if v is not None else 0 for v in batch.column("embedding").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), sizes, pa.array(ones), pa.array(twos), pa.array(valid), batch.column("embedding")],
            ["vec_id", "label", "size", "d1", "d2", "valid", "embedding"],
        )


_SHARD = "label string, size int, shard int, graph binary, ids binary, weights binary, vectors binary"


def _build(key: tuple, group: pa.Table) -> pa.Table:
    group = group.sort_by("rep")
    vectors = scaled(np.array(group.column("embedding").to_pylist(), np.float64))
    unit = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    graph, order = Graph.build(unit)
    ids, weights = (group.column(n).to_numpy()[order] for n in ("rep", "n"))
    return pa.table(
        {
            "label": pa.array([key[0].as_py()], pa.string()),
            "size": pa.array([key[1].as_py()], pa.int32()),
            "shard": pa.array([key[2].as_py()], pa.int32()),
            "graph": pa.array([graph.dump()], pa.binary()),
            "ids": pa.array([ids.tobytes()], pa.binary()),
            "weights": pa.array([weights.astype(np.int64).tobytes()], pa.binary()),
            "vectors": pa.array([vectors[order].tobytes()], pa.binary()),
        }
    )


def _linked(graph: Graph, queries: np.ndarray, which: np.ndarray, bound: float, own: bool) -> set[tuple[int, int]]:
    """All pairs (query, row) of the chosen queries by comparing each with every row; without those of a row with itself."""
    out: set[tuple[int, int]] = set()
    for a in range(0, len(which), 512):
        part = which[a : a + 512]
        hit = np.argwhere(queries[part] @ graph.unit.T >= bound)
        out.update((q, r) for q, r in zip(part[hit[:, 0]].tolist(), hit[:, 1].tolist()) if not own or q != r)
    return out


def range_search(
    graph: Graph, queries: np.ndarray, bound: float, audit: np.ndarray, own: bool = False
) -> tuple[np.ndarray, np.ndarray, float]:
    """Pairs (query, row) of similarity ``bound`` or more, and the recall that the audit saw.

    ``own``: the queries are the graph's rows, whose links to themselves prove nothing.  If the audited rows of a shard have few
    links among its own, all its rows are audited.
    """
    wanted = _linked(graph, queries, audit, bound, own)
    if own and len(wanted) < FEW_LINKS and 0 < len(audit) < len(queries):
        wanted = _linked(graph, queries, np.arange(len(queries)), bound, own)
    beam = BEAM
    while True:
        ones, twos, left, width = [], [], np.arange(len(queries)), beam
        while len(left):
            if width > WIDEST or width >= len(graph.unit):
                for a in range(0, len(left), 1024):
                    hit = np.argwhere(queries[left[a : a + 1024]] @ graph.unit.T >= bound)
                    ones.append(left[a + hit[:, 0]])
                    twos.append(hit[:, 1])
                break
            ids, sims = graph.search(queries[left], width)
            full = sims[:, -1] >= bound
            hit = np.argwhere((sims >= bound) & ~full[:, None])
            ones.append(left[hit[:, 0]])
            twos.append(ids[hit[:, 0], hit[:, 1]])
            left, width = left[full], width * 4
        one, two = (np.concatenate(x) if x else np.zeros(0, int) for x in (ones, twos))
        found = set(zip(one.tolist(), two.tolist())) & wanted if wanted else wanted
        recall = len(found) / len(wanted) if wanted else 1.0
        if recall >= RECALL or beam >= len(graph.unit):
            return one, two, recall
        beam *= 2


def audited(ids: np.ndarray) -> np.ndarray:
    """A tenth of the queries by a hash of their ids, at least 256."""
    order = np.argsort(mix(ids.astype(np.uint64)), kind="stable")
    return np.sort(order[: max(256, len(ids) // 10)])


class _Sets:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def top(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a


_FOUND = "a long, b long, n long"


def _search(bound: float):
    def run(group: pa.Table) -> pa.Table:
        row = group.to_pylist()[0]
        sides = []
        for tag in ("x", "y"):
            ids = np.frombuffer(row[f"{tag}_ids"], np.int64)
            vectors = np.frombuffer(row[f"{tag}_vectors"], np.float64).reshape(len(ids), -1)
            weights = np.frombuffer(row[f"{tag}_weights"], np.int64)
            sides.append((Graph.load(row[f"{tag}_graph"]), ids, vectors, weights))
        (graph_x, ids_x, vec_x, w_x), (graph_y, ids_y, vec_y, w_y) = sides
        same = row["x_shard"] == row["y_shard"]
        one, two, _ = range_search(graph_y, graph_x.unit, bound - SLACK, audited(ids_x), same)
        if not same:
            back, forth, _ = range_search(graph_x, graph_y.unit, bound - SLACK, audited(ids_y))
            one, two = np.r_[one, forth], np.r_[two, back]
        else:
            one, two = np.minimum(one, two), np.maximum(one, two)
            one, two = one[one != two], two[one != two]
        pair = np.unique(one * len(ids_y) + two)
        one, two = pair // len(ids_y), pair % len(ids_y)
        norm_x, norm_y = np.linalg.norm(vec_x, axis=1), np.linalg.norm(vec_y, axis=1)
        ok = np.zeros(len(one), bool)
        for a in range(0, len(one), 20_000):
            i, j = one[a : a + 20_000], two[a : a + 20_000]
            ok[a : a + 20_000] = np.einsum("pd,pd->p", vec_x[i], vec_y[j]) / (norm_x[i] * norm_y[j]) >= bound
        one, two = one[ok], two[ok]
        # A spanning forest of the links is enough for the components.
        sets, forest = _Sets(len(ids_x) + (0 if same else len(ids_y))), []
        shift = 0 if same else len(ids_x)
        for i, j in zip(one.tolist(), two.tolist()):
            if sets.join(i, j + shift):
                forest.append((i, j))
        count_x = np.bincount(one, weights=w_y[two], minlength=len(ids_x)).astype(np.int64)
        count_y = np.bincount(two, weights=w_x[one], minlength=len(ids_y)).astype(np.int64)
        hit_x, hit_y = np.flatnonzero(count_x), np.flatnonzero(count_y)
        left = ids_x[[i for i, _ in forest]] if forest else np.zeros(0, np.int64)
        right = ids_y[[j for _, j in forest]] if forest else np.zeros(0, np.int64)
        counts = len(hit_x) + len(hit_y)
        return pa.table(
            {
                "a": pa.array(np.r_[ids_x[hit_x], ids_y[hit_y], left], pa.int64()),
                "b": pa.array([None] * counts + right.tolist(), pa.int64()),
                "n": pa.array(np.r_[count_x[hit_x], count_y[hit_y], np.zeros(len(left), np.int64)], pa.int64()),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    plain = vectors.selectExpr(
        "cast(vec_id AS long) AS vec_id", "cast(label AS string) AS label", "cast(embedding AS array<double>) AS embedding"
    )
    marked = written(plain.mapInArrow(_mark, _MARKED), "vectors")
    key = ["label", "size", "d1", "d2"]
    valid = marked.where("valid")
    classes = written(valid.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    reps = valid.join(classes, key).where("vec_id = rep").dropDuplicates(key)
    shards = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = reps.join(shards, ["label", "size"]).withColumn("shard", F.expr("cast(pmod(xxhash64(rep), shards) AS int)"))
    graphs = written(
        dealt.select("label", "size", "shard", "rep", "n", "embedding").groupBy("label", "size", "shard").applyInArrow(_build, _SHARD),
        "graphs",
    )

    def side(tag: str) -> DataFrame:
        return graphs.select("label", "size", *(F.col(c).alias(f"{tag}_{c}") for c in ("shard", "graph", "ids", "weights", "vectors")))

    pairs = side("x").join(side("y"), ["label", "size"]).where("x_shard <= y_shard")
    found = written(pairs.groupBy("label", "size", "x_shard", "y_shard").applyInArrow(_search(cosine), _FOUND), "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "rep")
    labels = components(found.where("b IS NOT NULL").select("a", "b")).selectExpr("id AS rep", "component_id")
    by_class = classes.join(counts, "rep", "left").join(labels, "rep", "left")
    return (
        marked.select("vec_id", "valid", *key)
        .join(by_class.withColumn("valid", F.lit(True)), ["valid", *key], "left")
        .select(
            "vec_id",
            F.coalesce(F.col("n") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "rep", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
