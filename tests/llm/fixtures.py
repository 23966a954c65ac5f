"""Small tables with the odd rows that every text operator must bear: nulls, empties, long texts, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, rest string, n_lines long, score double, label string"


def words(n: int, seed: int, kinds: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(kinds)}" for _ in range(n)]


def rows() -> list[tuple]:
    base = words(120, 1)
    near = [*base]
    near[3] = "other"
    passage = " ".join(words(60, 2, 10**6))
    lines = [" ".join(words(12, s)) for s in range(20, 26)]
    edited = lines[1].split()
    edited[4] = "changed"
    shorter = lines[2].split()
    del shorter[6]
    texts = [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(base)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one two"),
        (7, "one two"),
        (7, "another text with the same id"),
        (None, " ".join(base)),
        (8, "x " * 30_000),
        (9, "start " + passage + " end here"),
        (10, "other beginning " + passage + " and a tail"),
        (11, "\n".join(lines)),
        (12, "\n".join([" ".join(edited), "short", " ".join(shorter), lines[3].upper(), "short"])),
        (13, "Ünïcode ▁ text with odd  blanks\r\nand 日本語 letters, don't you see?"),
        (14, "One Two"),
        (15, "q" * 5000),
    ]
    return [(i, t, "en", "clash", 5, 0.5, "a") for i, t in texts]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), DOCS)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def closure(ids: list, links: list[tuple]) -> dict:
    """Smallest id reachable from each."""
    up = {i: i for i in ids}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def by_row(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
