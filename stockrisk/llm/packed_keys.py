"""Counting of many 64-bit keys in few rows: keys of a slice of text are packed into one row per bucket and slice.

A row holds, for one bucket of the key space, the keys of a slice of documents with the owner (document id) and position
of each.  One group per bucket then sees every place of each of its keys.  A key costs little more than its eight bytes
in the shuffle.  A slice sends a key for its earliest owner only, so that a key that stands in a third of all documents
arrives once per slice, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import mix, release

ROW = "bucket int, owners binary, tags binary, counts binary, keys binary, low binary, high binary"
_ROW = pa.schema(
    [("bucket", pa.int32())] + [(n, pa.binary()) for n in ("owners", "tags", "counts", "keys", "low", "high")]
)
FOUND = "doc_id long, tag long, places binary"
_FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("places", pa.binary())])


BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 4096  # more only if there are more shuffle partitions: a slice sends a row to each


def buckets_of(df: DataFrame) -> int:
    """So many buckets that each holds the keys of about ``BUCKET_BYTES`` of text, whatever the shuffle partitions are.

    Beyond 64 GB of text buckets grow unless ``spark.sql.shuffle.partitions`` is raised above ``MOST_BUCKETS``.
    """
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(MOST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(8, min(-(-size // BUCKET_BYTES), most))


def pack(
    keys: np.ndarray | None, choose: np.ndarray, owners: np.ndarray, tags: np.ndarray, places: np.ndarray, buckets: int
) -> Iterator[dict]:
    """Rows of one slice, without keys if there are none.  ``tags`` tells rows with the same owner apart.  ``choose`` decides the bucket and must be a function of the key's content, independent of
    ``keys``; together they tell keys apart."""
    bucket = (choose % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((places, tags, owners, bucket))
    bucket, owners, places = bucket[order], owners[order], places[order].astype(np.uint32)
    keys = None if keys is None else keys[order]
    tags = tags[order].astype(np.uint32)
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:]):
        own, tag = owners[a:b], tags[a:b]
        heads = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (tag[1:] != tag[:-1])])
        # Gaps are small: their low bytes are stored apart from the others, which compress to nothing.
        gaps = np.diff(places[a:b], prepend=np.uint32(0))
        gaps[heads] = places[a:b][heads]
        planes = gaps.view(np.uint8).reshape(-1, 4)
        yield {
            "bucket": int(bucket[a]),
            "owners": own[heads].astype(np.int64).tobytes(),
            "tags": tag[heads].tobytes(),
            "counts": np.diff(np.r_[heads, b - a]).astype(np.uint32).tobytes(),
            "keys": b"" if keys is None else keys[a:b].tobytes(),
            "low": planes[:, 0].tobytes(),
            "high": np.ascontiguousarray(planes[:, 1:]).tobytes(),
        }


def unpack(owners: pa.Buffer, tags: pa.Buffer, counts: pa.Buffer, keys: pa.Buffer, low: pa.Buffer, high: pa.Buffer) -> tuple[np.ndarray, ...]:
    """Keys, owners, tags and places of one row."""
    n = low.size
    planes = np.empty((n, 4), np.uint8)
    planes[:, 0] = np.frombuffer(low, np.uint8)
    planes[:, 1:] = np.frombuffer(high, np.uint8).reshape(-1, 3)
    gaps = planes.view(np.uint32).ravel().astype(np.int64)
    counts = np.frombuffer(counts, np.uint32).astype(np.int64)
    heads = np.cumsum(counts) - counts
    total = np.cumsum(gaps)
    places = total - np.repeat(total[heads] - gaps[heads], counts)
    tags = np.repeat(np.frombuffer(tags, np.uint32), counts)
    return np.frombuffer(keys, np.uint64), np.repeat(np.frombuffer(owners, np.int64), counts), tags, places


def unpack_all(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, owners, tags and places of a group.  They are put in their place row by row out of the group's own memory, so
    that beside it there is no second copy of the group."""
    release()  # of the group before
    columns = [group.column(n) for n in ("owners", "tags", "counts", "keys", "low", "high")]
    sizes = [pc.sum(pc.binary_length(column)).as_py() or 0 for column in columns]
    n = sizes[-2]
    out = np.empty(sizes[3] // 8, np.uint64), np.empty(n, np.int64), np.empty(n, np.uint32), np.empty(n, np.int64)
    at = [0] * len(out)
    for row in zip(*columns):
        for i, values in enumerate(unpack(*(value.as_buffer() for value in row))):
            out[i][at[i] : at[i] + len(values)] = values
            at[i] += len(values)
    return out


def packed_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _ROW)


def to_documents(found: DataFrame) -> DataFrame:
    """``doc_id, tag, places`` with one row per document, from rows of ``by_owner``."""
    return found.groupBy("bucket").applyInArrow(_documents, FOUND)


def by_owner(owners: np.ndarray, tags: np.ndarray, places: np.ndarray, buckets: int) -> pa.Table:
    """Packed places without keys, dealt by owner."""
    choose = mix(owners.astype(np.uint64))
    return pa.Table.from_pylist(list(pack(None, choose, owners, tags, places, buckets)), _ROW)


def _documents(group: pa.Table) -> pa.Table:
    _, owners, tags, places = unpack_all(group)
    return found_table(owners, tags, places)


def found_table(owners: np.ndarray, tags: np.ndarray, places: np.ndarray) -> pa.Table:
    """One row per document with its found places in ascending order."""
    order = np.lexsort((places, tags, owners))
    owners, tags, places = owners[order], tags[order], places[order].astype(np.uint32)
    new = (owners[1:] != owners[:-1]) | (tags[1:] != tags[:-1])
    edges = np.flatnonzero(np.r_[True, new, True]) if len(owners) else np.zeros(1, int)
    return pa.table(
        {
            "doc_id": pa.array(owners[edges[:-1]], pa.int64()),
            "tag": pa.array(tags[edges[:-1]], pa.int64()),
            "places": pa.array([places[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
        },
        schema=_FOUND,
    )


def after_smallest(keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each entry whether its key also has an entry of smaller rank."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, ranks = keys[order], rank[order]
    heads = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, int)
    out = np.zeros(len(keys), bool)
    if len(heads):
        least = np.minimum.reduceat(ranks, heads)
        out[order] = ranks > np.repeat(least, np.diff(np.r_[heads, len(keys)]))
    return out
