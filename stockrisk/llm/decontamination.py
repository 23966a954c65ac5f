"""Benchmark decontamination with DataFrame operations only: SimHash of item-sized windows, multi-index Hamming blocks, and
exact weighted-shingle similarity.

Words are runs of letters and digits, in lower case.  A shingle is ``SHINGLE`` words (all of them for a shorter item), its
weight the number of times it stands in the window.  A window has as many words as an item.  It is looked at if one of its
shingles is also the item's and stands where it stands in the item, so that no window without a common shingle is built;
windows that would begin before or end after the document are moved inside.

The fingerprint of a window has bit b set if shingles of more than half the weight have bit b of their hash set.  Two
fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1`` blocks of bits: the windows are joined with the items of
their size on each block, which finds all fingerprints within the radius.  At a similarity of 0.8 fingerprints differ in 10
bits on average, with a standard deviation of 3; equal texts never differ.  The pairs found are verified: sum of the
smaller weights over sum of the larger ones, at least ``percent`` of 100.

Defined results: null or wordless texts and items match nothing; of equal documents each is reported; rows that repeat a
``doc_id`` are looked at one by one (equal rows once) and reported once for equal places; a null ``doc_id`` or ``item_id`` is reported as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockrisk.session import written

SHINGLE = 5
RADIUS = 18
BITS = 64


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; none if there are fewer words."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - size),
        lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size))),
    )
    return F.when(F.size(hashes) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprints(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, fp, total`` from rows of ``keys, h, w``.  One sum counts two bits: their counts share a long."""
    half = BITS // 2
    mask = (1 << half) + 1
    sums = [F.sum(F.col("w") * F.shiftrightunsigned("h", b).bitwiseAND(F.lit(mask))).alias(f"s{b}") for b in range(half)]
    counted = weighted.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)

    def bit(b: int) -> Column:
        low = F.col(f"s{b % half}").bitwiseAND(F.lit((1 << half) - 1)) if b < half else F.shiftright(f"s{b % half}", half)
        return F.when(2 * low > F.col("total"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long"))

    return counted.select(*keys, "total", reduce(Column.bitwiseOR, (bit(b) for b in range(BITS))).alias("fp"))


def blocks(prints: DataFrame) -> DataFrame:
    """One row per block of the fingerprint: its number and bits."""
    edges = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    parts = [
        F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:])
    ]
    return prints.select("*", F.posexplode(F.array(*parts)).alias("block", "part"))


def leaks(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: one row per window that matches an item; ``start`` counts words."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("hashes"))
    own = own.where(F.size("hashes") > 0).select(
        "item_id", F.xxhash64("hashes").alias("item"), "hashes", F.size("hashes").alias("n")
    )
    own = own.withColumn("k", F.least(F.col("n"), F.lit(SHINGLE)))
    sizes = [row.k for row in own.select("k").distinct().collect()]  # at most SHINGLE numbers
    if not sizes:
        return docs.selectExpr("cast(doc_id AS long) AS doc_id").where("false").selectExpr(
            "doc_id", "cast(null AS long) AS item_id", "0 AS start", "0 AS n_words", "0.0D AS similarity"
        )
    parts = [own.where(F.col("k") == k).select("item", "n", "k", F.posexplode(shingles(F.col("hashes"), k)).alias("at", "h")) for k in sizes]
    item_rows = written(reduce(DataFrame.union, parts).distinct(), "items")
    anchors = written(item_rows.select("k", "h", "n", "at").distinct(), "anchors")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    hashed = texts.select("doc_id", "tag", word_hashes(F.col("text")).alias("hashes"))
    runs = [
        hashed.select("doc_id", "tag", F.size("hashes").alias("words"), F.lit(k).alias("k"), F.posexplode(shingles(F.col("hashes"), k)).alias("pos", "h"))
        for k in sizes
    ]
    hits = reduce(DataFrame.union, runs).join(anchors, ["k", "h"])
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("words") - F.col("n")))
    places = hits.select("doc_id", "tag", F.struct(start.alias("start"), "n", "k").alias("place"))
    # The places of one text are at most its words times the number of item sizes.
    windows = written(places.groupBy("doc_id", "tag").agg(F.collect_set("place").alias("places")), "places")

    # Ids and tags alone pick the texts; the places, which may be many, are brought to the few texts that are left.
    near = written(windows.selectExpr("doc_id AS found_id", "tag AS found_tag"), "near")
    same_row = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("tag") == F.col("found_tag"))
    # Equal rows have the same windows: one of them stands for all, or each shingle would count once per copy.
    found = texts.join(near, same_row, "left_semi").dropDuplicates(["doc_id", "tag"])
    placed = windows.withColumnsRenamed({"doc_id": "found_id", "tag": "found_tag"})
    found = found.join(placed.hint("merge"), same_row)
    cut = found.select("doc_id", "tag", word_hashes(F.col("text")).alias("hashes"), F.explode("places").alias("p")).select(
        "doc_id", "tag", "p.start", "p.n", "p.k", F.slice("hashes", F.col("p.start") + 1, F.col("p.n")).alias("hashes")
    )
    keys = ["doc_id", "tag", "start", "n"]
    each = [
        cut.where(F.col("k") == k).select(*keys, F.explode(shingles(F.col("hashes"), k)).alias("h")) for k in sizes
    ]
    weighted = written(reduce(DataFrame.union, each).groupBy(*keys, "h").agg(F.count("*").alias("w")), "weights")
    item_weights = item_rows.groupBy("item", "n", "h").agg(F.count("*").alias("w"))
    prints = written(fingerprints(weighted, keys), "prints")
    item_prints = fingerprints(item_weights, ["item", "n"])

    left = blocks(prints)
    right = blocks(item_prints).select("item", "n", F.col("fp").alias("ifp"), F.col("total").alias("itotal"), "block", "part")
    pairs = (
        left.join(right, ["n", "block", "part"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS)
        .select(*keys, "total", "item", "itotal")
        .distinct()
    )
    one = weighted.select(*(F.col(c).alias(f"w_{c}") for c in keys), "h", F.col("w").alias("x"))
    same = [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in keys]
    common = (
        pairs.join(one, reduce(Column.__and__, same))
        .join(item_weights.select(F.col("item").alias("i"), F.col("h").alias("ih"), F.col("w").alias("y")), (F.col("item") == F.col("i")) & (F.col("h") == F.col("ih")))
        .groupBy(*keys, "item", "total", "itotal")
        .agg(F.sum(F.least("x", "y")).alias("common"))
    )
    union = F.col("total") + F.col("itotal") - F.col("common")
    matched = common.where(100 * F.col("common") >= percent * union).select(
        "doc_id", "start", "n", "item", (F.col("common") / union).alias("similarity")
    )
    return (
        matched.join(own.select("item", "item_id").distinct(), "item")
        .select("doc_id", "item_id", "start", F.col("n").alias("n_words"), "similarity")
        .distinct()
    )
