"""MinHash near-dedup by SuperMinHash signatures, banding, exact verification and connected components.

SuperMinHash gives each element of a set a random permutation of the slots and lets its j-th slot compete with the value
j + r, 0 <= r < 1.  A set is done with the first level j at which all its slots hold smaller values, so that large sets
stop after one or two levels.  Sets that agree in all slots of a band are candidates.  With bands of 5 slots, 32 bands
miss a pair of similarity 0.8 with probability 3e-6.

The set of a text: distinct runs of ``shingle`` words, letters A-Z lowered; a shorter text's whole sequence is its one
element.  Texts are linked if |intersection| * 100 >= ``percent`` * |union|, counted on the full sets.  Equal sets are one
class, represented by its smallest id; only representatives are compared.

Candidates are verified best first.  In each round, every member of a bucket names the members of *other* components that
its signature finds most alike (2, then all, in steps of 4096), the pairs not tested before are verified, and components
are joined.  Rounds go on until no list was cut short, so that each candidate pair is verified or lies inside one
component.  Signatures that agree in too few slots for a similarity of 0.8, by ``DEVIATIONS`` standard deviations of the
estimate for sets of their size, are no candidates.  A pair that meets in several buckets is named in the first of them
only.  Buckets of more than ``BLOCK`` members are compared in pairs of blocks, one task each.

Defined results: a null or wordless text has an empty set, links with nothing and is kept; rows with one ``doc_id`` are one
node; rows without ``doc_id`` link with nothing and are kept, with a null component; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import (
    components,
    id_bits,
    maybe_in,
    mix,
    range_hash,
    release,
    slices,
    window_starts,
    words_of,
)
from stockrisk.session import written

SLOTS, BAND, BANDS = 240, 5, 32
DEVIATIONS = 4.5
BLOCK = 2048
LARGE, PIVOTS = 64, 8  # buckets of more members begin with comparisons to their first ones
FIRST, WIDER = 2, 4096  # candidates named per member in the first round, and the growth of that number
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and the offsets of the rows."""
    words = words_of(column, lower=True)
    hashes = words.hashes(1)
    starts, rows = window_starts(words.first, size)
    long_ones = range_hash(hashes, starts, starts + size, 2)
    cuts = np.searchsorted(rows, np.arange(len(words.counts) + 1))
    parts = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= size:
            own = np.sort(long_ones[cuts[i] : cuts[i + 1]])
            parts.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            parts.append(range_hash(hashes, words.first[i : i + 1], words.first[i + 1 : i + 2], 2))
        else:
            parts.append(np.zeros(0, np.uint64))
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(sizes)]


def super_minhash(elements: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows x slots) of the sets ``elements[first[i]:first[i+1]]``; empty sets keep the largest value."""
    sets = len(first) - 1
    table = np.full(sets * slots, _EMPTY, np.uint64)
    rows = np.repeat(np.arange(sets), np.diff(first))

    def draw(items: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The value of each element at this level, and the place its permutation swaps into position ``level``."""
        bits = mix(items + _U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (_U(level) << _U(53)) | (bits >> _U(11))
        return value, level + (mix(bits) % _U(slots - level)).astype(np.int64)

    value, place = draw(elements, 0)
    np.minimum.at(table, rows * slots + place, value)
    open_sets = (table.reshape(sets, slots) == _EMPTY).any(axis=1) & (np.diff(first) > 0)
    take = open_sets[rows]
    items, rows, place = elements[take], rows[take], place[take]
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(items), 1))
    for level in range(1, slots):
        if not len(items):
            break
        each = np.arange(len(items))
        order[each, place], order[:, level - 1] = order[:, level - 1].copy(), order[each, place]
        value, place = draw(items, level)
        np.minimum.at(table, rows * slots + order[each, place].astype(np.int64), value)
        still = (table.reshape(sets, slots)[rows] == _EMPTY).any(axis=1) if len(items) < 5000 else None
        if still is None:  # look at each set once, not at each element
            alive = np.zeros(sets, bool)
            own = np.unique(rows)
            alive[own] = (table.reshape(sets, slots)[own] == _EMPTY).any(axis=1)
            still = alive[rows]
        if not still.all():
            items, rows, place, order = items[still], rows[still], place[still], order[still]
    return table.reshape(sets, slots)


def least_agreement(percent: int, slots: int = SLOTS, up_to: int = 4000) -> np.ndarray:
    """For each size of a union, the slots in which signatures of ``percent`` similarity agree but for chance.

    The variance is that of independent slots times 1 - c, where c falls from near 1 to 0 as the union outgrows the slots.
    """
    j = percent / 100
    out = np.empty(up_to + 1)
    levels = np.arange(1, slots, dtype=np.float64)
    for u in range(up_to + 1):
        c = 0.0
        if u >= 2:
            # Sum of l^u ((l+1)^u + (l-1)^u - 2 l^u) over (m-1)^(u-1) m^u (u-1), each factor scaled to stay in range.
            scale = u * np.log(levels / slots) + u * np.log((levels + 1) / (slots - 1))
            inner = 1 + ((levels - 1) / (levels + 1)) ** u - 2 * (levels / (levels + 1)) ** u
            c = float((np.exp(scale) * inner).sum()) * (slots - 1) / (u - 1)
        out[u] = slots * (j - DEVIATIONS * np.sqrt(j * (1 - j) / slots * min(1.0, max(1 - c, 0.02))))
    return np.floor(out)


def band_keys(signature: np.ndarray, band: int = BAND, bands: int = BANDS) -> np.ndarray:
    sets = len(signature)
    parts = mix(signature[:, : band * bands]).reshape(sets, bands, band)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(band):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return (keys & ~_U(255)) | np.arange(bands, dtype=np.uint64)


_SETS = "doc_id long, n long, d1 long, d2 long, bands binary, sig binary, heads binary"


def signatures(docs: DataFrame, shingle: int, slots: int = SLOTS) -> DataFrame:
    """Per row: set size, 128-bit digest of the set, band keys, one byte of each slot, and four bytes of each band key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            elements, first = shingle_sets(part.column("text"), shingle)
            table = super_minhash(elements, first, slots)
            keys = band_keys(table)
            small = (mix(table) >> _U(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(range_hash(elements, first[:-1], first[1:], 3).view(np.int64)),
                    pa.array(range_hash(elements, first[:-1], first[1:], 4).view(np.int64)),
                    pa.array([k.tobytes() for k in keys], pa.binary()),
                    pa.array([s.tobytes() for s in small], pa.binary()),
                    pa.array([h.tobytes() for h in (keys >> _U(32)).astype(np.uint32)], pa.binary()),
                ],
                ["doc_id", "n", "d1", "d2", "bands", "sig", "heads"],
            )

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, _SETS)


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per band; ``band`` is stored in the lowest bits of the key."""
    for batch in batches:
        keys = [np.frombuffer(b, np.int64) for b in batch.column("bands").to_pylist()]
        if keys:
            ids = np.repeat(batch.column("doc_id").to_numpy(), len(keys[0]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], ["key", "doc_id"])


def _agreement(sigs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of equal slots of every pair; ``sigs`` is slots x members."""
    like = np.zeros((len(left), len(right)), np.uint8)
    for slot in sigs:
        like += slot[left][:, None] == slot[right][None, :]
    return like


def _best_pairs(take: int, least: np.ndarray):
    """For each member of a bucket the ``take`` most alike members of other components; ``more`` if there were others.

    In the first round the members of a large bucket look at its first ``PIVOTS`` members only.  Later, only members outside
    the bucket's largest component have to look for partners.
    """

    def pairs_of(ids, comps, sizes, sigs, heads, band, left, right, out):
        step = max(1, (1 << 20) // max(len(right), 1))
        for a in range(0, len(left), step):
            x = left[a : a + step]
            like = _agreement(sigs, x, right)
            union = (sizes[x][:, None] + sizes[right][None, :]) * 5 // 9  # of a pair of similarity 0.8
            need = least[np.minimum(union, len(least) - 1)]
            like[(comps[x][:, None] == comps[right][None, :]) | (like < need)] = 0
            row, col = np.nonzero(like)
            if len(row):
                met = (heads[x[row], :band] == heads[right[col], :band]).any(axis=1)
                like[row[met], col[met]] = 0
            count = (like > 0).sum(axis=1)
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            n = min(take, like.shape[1])
            best = np.argsort(255 - like[hit], axis=1, kind="stable")[:, :n]
            ok = np.take_along_axis(like[hit], best, axis=1) > 0
            ones = np.repeat(ids[x[hit]], n).reshape(len(hit), n)[ok]
            out.append((ones, ids[right[best[ok]]], np.repeat(count[hit] > n, n).reshape(len(hit), n)[ok]))

    def run(group: pa.Table) -> pa.Table:
        ids, comps, key, n, lo, hi, blk = (group.column(c).to_numpy() for c in ("doc_id", "c", "key", "n", "lo", "hi", "blk"))
        sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        sigs = np.ascontiguousarray(sigs.T)
        heads = np.frombuffer(b"".join(group.column("heads").to_pylist()), np.uint32).reshape(len(ids), -1)
        order = np.lexsort((ids, hi, lo, key))
        k, l, h = key[order], lo[order], hi[order]
        edges = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (l[1:] != l[:-1]) | (h[1:] != h[:-1]), True])
        out: list = []
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            if b - a < 2 or (comps[own] == comps[own[0]]).all():
                continue
            if take == FIRST and b - a > LARGE:
                pairs_of(ids, comps, n, sigs, heads, int(k[a] & 255), own, own[:PIVOTS], out)
                out.append((np.full(1, -1), np.full(1, -1), np.ones(1, bool)))  # the other pairs are still to do
                continue
            names, sizes = np.unique(comps[own], return_counts=True)
            seeking = comps[own] != names[sizes.argmax()]
            if l[a] == h[a]:
                pairs_of(ids, comps, n, sigs, heads, int(k[a] & 255), own[seeking], own, out)
            else:
                side = blk[own] == l[a]
                pairs_of(ids, comps, n, sigs, heads, int(k[a] & 255), own[side & seeking], own[~side], out)
                pairs_of(ids, comps, n, sigs, heads, int(k[a] & 255), own[~side & seeking], own[side], out)
        ones, twos, more = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        a, b = np.minimum(ones, twos), np.maximum(ones, twos)
        if len(a):  # the same pair is often named in several buckets
            order = np.lexsort((~more, b, a))
            new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
            a, b, more = a[order][new], b[order][new], more[order][new]
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "more": more})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y")):  # views of the batch, one pair at a time
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                linked.append(100 * common >= percent * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])
        release()

    return run


def _full_sets(docs: DataFrame, bits: np.ndarray, shingle: int) -> DataFrame:
    """The full sets of the documents whose ids may be in ``bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.filter(pa.array(maybe_in(bits, part.column("doc_id").to_numpy())))
            elements, first = shingle_sets(part.column("text"), shingle)
            sets = [elements[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "elements"])

    return docs.where("doc_id IS NOT NULL").selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(
        run, "doc_id long, elements binary"
    )


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = written(signatures(docs, shingle), "signatures")
    real = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    copies = written(
        real.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).where("doc_id <> rep").selectExpr("doc_id AS a", "rep AS b"),
        "copies",
    )
    reps = real.join(classes, ["d1", "d2"]).where("doc_id = rep")
    bands = reps.select("doc_id", "bands").mapInArrow(_explode_bands, "key long, doc_id long")
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(sizes, "key"), "members")
    tested = links = None
    take, label, least = FIRST, None, least_agreement(percent)
    candidates = members.select("doc_id").distinct()
    full = written(_full_sets(docs, id_bits(candidates), shingle), "sets")
    sigs = written(candidates.join(reps.select("doc_id", "n", "sig", "heads"), "doc_id"), "sigs")
    while True:
        own = members if label is None else members.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        own = own.withColumn("c", F.col("doc_id") if label is None else F.coalesce("component_id", "doc_id"))
        if label is not None:
            mixed = own.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
            own = own.join(mixed.select("key"), "key", "left_semi")
        blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
        spread = (
            own.select("key", "doc_id", "c", blocks.alias("n"))
            .withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
            .withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
            .selectExpr("key", "doc_id", "c", "blk", "least(blk, other) AS lo", "greatest(blk, other) AS hi")
        )
        dealt = spread.join(sigs, "doc_id").withColumn(
            "part", F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(4 * partitions))
        )
        named = written(
            dealt.groupBy("part").applyInArrow(_best_pairs(take, least), "a long, b long, more boolean"), "named"
        )
        pairs = named.select("a", "b").where("a < b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        joined = (
            pairs.join(full.selectExpr("doc_id AS a", "elements AS x"), "a")
            .join(full.selectExpr("doc_id AS b", "elements AS y"), "b")
            .select("a", "b", "x", "y")
        )
        checked = written(joined.mapInArrow(_verify(percent), "a long, b long, linked boolean"), "checked")
        good, seen = checked.where("linked").select("a", "b"), checked.select("a", "b")
        links = good if links is None else links.union(good)
        tested = seen if tested is None else tested.union(seen)
        label = written(components(links), "components")
        if named.where("more").isEmpty():
            break
        take *= WIDER
    # Representatives have their components; a copy has that of its representative.
    found = copies.join(label.withColumnRenamed("id", "b"), "b", "left").selectExpr(
        "a AS doc_id", "coalesce(component_id, b) AS component_id"
    )
    # An id may stand in several rows with different sets: then all its classes are one component.
    all_found = found.union(label.selectExpr("id", "component_id")).union(
        found.selectExpr("component_id AS doc_id", "component_id")
    )
    several = all_found.groupBy("doc_id").agg(F.min("component_id").alias("m"), F.max("component_id").alias("n"))
    if not several.where("m < n").isEmpty():
        label = components(links.union(copies))
        all_found = label.selectExpr("id AS doc_id", "component_id")
    return (
        sets.selectExpr("doc_id", "n AS n_shingles")
        .join(all_found.dropDuplicates(["doc_id"]), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
