"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeated windows merge into
maximal removal intervals.

A word goes if a window of ``size`` words that covers it starts, with the same words, also in a document with a smaller
``doc_id``.  Windows are judged on the input.

Defined results: a null text has no words; a text shorter than a window keeps all; copies inside one document do not
remove each other; rows with the same ``doc_id`` do not remove each other; rows without a ``doc_id`` come back unchanged
and remove nothing; an empty table gives an empty table; further columns are dropped.  Words keep their bytes.

Windows are told apart by 64 bits plus the bucket, from two independent rolling hashes.  ``documents`` is read twice;
full texts are shuffled only for documents that lose words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stockrisk.llm.blocks import id_bits, maybe_in, range_hash, slices, window_starts, words_of
from stockrisk.llm.packed_keys import (
    ROW,
    after_smallest,
    buckets_of,
    by_owner,
    pack,
    packed_batch,
    to_documents,
    unpack_all,
)
from stockrisk.session import written

WINDOW = 50


def text_tags(column: pa.Array) -> np.ndarray:
    """A checksum of each text; with the id it names a row."""
    return np.array([zlib.crc32((text or "").encode()) for text in column.to_pylist()], np.uint32)


def _window_rows(size: int, buckets: int):
    """Packed windows of each slice.  A window that a smaller id of the slice also has is already decided: it is packed
    under the bucket -1 - n and not compared again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(part.column("text"))
            starts, rows = window_starts(words.first, size)
            if not len(starts):
                continue
            hashes = words.hashes(1)
            one = range_hash(hashes, starts, starts + size, 2)
            two = range_hash(hashes, starts, starts + size, 3)
            owners = part.column("doc_id").to_numpy(zero_copy_only=False)[rows]
            tags = text_tags(part.column("text"))[rows]
            places = starts - words.first[:-1][rows]
            keys = one ^ np.left_shift(two, np.uint64(1))
            decided = after_smallest(keys, owners)
            open_ = ~decided
            out = list(pack(keys[open_], two[open_], owners[open_], tags[open_], places[open_], buckets))
            for row in pack(None, np.zeros(int(decided.sum()), np.uint64), owners[decided], tags[decided], places[decided], 1):
                out.append(row | {"bucket": -1 - int(two[0] % np.uint64(buckets))})
            yield packed_batch(out)

    return run


def _repeats(buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys, owners, tags, places = unpack_all(group)
        again = np.ones(len(owners), bool) if key[0].as_py() < 0 else after_smallest(keys, owners)
        return by_owner(owners[again], tags[again], places[again], buckets)

    return run


def repeated_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, tag, places``: starts of the windows of each document that a smaller id has too (packed 32-bit integers)."""
    buckets = buckets_of(docs)
    rows = docs.where("doc_id IS NOT NULL").selectExpr("cast(doc_id AS long) AS doc_id", "text")
    packed = rows.mapInArrow(_window_rows(size, buckets), ROW)
    return to_documents(packed.groupBy("bucket").applyInArrow(_repeats(buckets), ROW))


def covered(places: np.ndarray, size: int, n: int) -> np.ndarray:
    """Words covered by windows at ``places``: the maximal intervals as a mask."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, np.minimum(places + size, n), -1)
    return np.cumsum(steps[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of set entries as (start, end)."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept_text, kept_sha256`` for every row.

    ``removed`` lists the removed word intervals; ``kept_text`` joins the kept words with one blank.  The text is given
    for documents that lost words and is null for the others, whose own words are all kept.
    """
    found = written(repeated_windows(docs, size), "windows")
    bits = id_bits(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("doc_id")
            maybe = maybe_in(bits, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            counts, digests, texts = [], [], []
            for text, hold in zip(part.column("text").to_pylist(), maybe):
                words = (text or "").encode().split()
                counts.append(len(words))
                digests.append(None if hold else hashlib.sha256(b" ".join(words)).hexdigest())
                texts.append(b" ".join(words).decode() if hold else None)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(text_tags(part.column("text")), pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(texts, pa.string()),
                ],
                ["doc_id", "tag", "n_words", "kept_sha256", "text"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {name: [] for name in ("n_removed", "removed", "kept_text", "kept_sha256")}
            for text, packed, digest in zip(*(batch.column(n).to_pylist() for n in ("text", "places", "kept_sha256"))):
                if text is None or not packed:
                    values = (0, [], None, hashlib.sha256(text.encode()).hexdigest() if text is not None else digest)
                else:
                    words = text.encode().split()
                    gone = covered(np.frombuffer(packed, np.uint32).astype(np.int64), size, len(words))
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    runs = [{"start": a, "end": b} for a, b in intervals(gone)]
                    values = (int(gone.sum()), runs, kept.decode(), hashlib.sha256(kept).hexdigest())
                for name, value in zip(out, values):
                    out[name].append(value)
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words")]
                + [pa.array(values, kind) for values, kind in zip(out.values(), kinds)],
                ["doc_id", "n_words", *out],
            )

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(
        scan, "doc_id long, tag long, n_words long, kept_sha256 string, text string"
    )
    joined = rows.join(found, ["doc_id", "tag"], "left").select("doc_id", "n_words", "kept_sha256", "text", "places")
    return joined.mapInArrow(
        cut,
        "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string,"
        " kept_sha256 string",
    )
