"""Line dedup by a deletion-neighbourhood join: a line goes if an earlier line lies within one word edit of it.

Lines end at ``\\n``; a line is its words with A-Z lowered, and lines are ordered by (``doc_id``, line number).  A line is
removed if an earlier line has the same words, or, when both have at least ``edit_words`` words, if one word inserted, left
out or replaced makes them equal.  Lines are judged on the input.  Lines without words stay.

Each line stands for itself and for all its variants with one word left out, as hashed keys.  A key that two lines share
carries the place of the word left out, so that it also verifies the distance: the same place left out of lines of one
length is a replacement, a whole line that equals another's variant is an insertion, and two variants with different places
are no link.  Two filters that lose no link come first: only the earliest of equal lines needs variants, and two lines
within one edit share their first or their last h words, h a power of two at most half their length, so that lines that
share neither with any other line have no partner.

Defined results: a null text stays null, without lines; rows of one ``doc_id`` are told apart by their text, and a line of
one is not earlier than the same line number of the other; rows without ``doc_id`` stay as they are and remove nothing.
All other columns come back in ``rest``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.llm.blocks import id_bits, maybe_rows, mix, powers, ragged, range_hash, rows_by_bits, slices, split_words, text_bytes
from stockrisk.llm.packed_keys import ROW, buckets_of, by_owner, pack, packed_batch, to_documents, unpack_all
from stockrisk.llm.substring_dedup import text_tags
from stockrisk.session import written

EDIT_WORDS = 8
_U = np.uint64
_KIND = {"full": 1, "head": 2, "tail": 3, "replaced": 4}


class _Lines:
    """Lines of a slice: hashes of their words, first word of each line, row and line number."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column, lower=True)
        breaks = np.flatnonzero(data == 10)
        edges = np.unique(np.r_[offsets, breaks + 1])
        words = split_words(data, edges)  # line breaks are white space, so lines are rows of their own here
        self.hashes = words.hashes(1)
        starts = edges[:-1]
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        head = np.searchsorted(self.row, self.row, side="left")
        self.number = np.arange(len(starts)) - head
        self.first, self.n = words.first[:-1], words.counts

    def digest(self, at: np.ndarray, count: np.ndarray, kind: str, extra: np.ndarray, seed: int) -> np.ndarray:
        key = range_hash(self.hashes, at, at + count, seed)
        return mix(key + mix(extra.astype(np.uint64) * _U(8) + _U(_KIND[kind])))


def _rank(owners: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Places in the order (owner, line); equal ones share a place."""
    order = np.lexsort((lines, owners))
    new = np.r_[False, (owners[order][1:] != owners[order][:-1]) | (lines[order][1:] != lines[order][:-1])]
    rank = np.empty(len(owners), np.int64)
    rank[order] = np.cumsum(new)[: len(owners)]
    return rank


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, first entry of each key in it, and number of its entries."""
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, int)
    return order, heads, np.diff(np.r_[heads, len(keys)])


def _least(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the least rank under its key, and the number of entries under it."""
    order, heads, sizes = _groups(keys)
    least, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    if len(keys):
        least[order] = np.repeat(np.minimum.reduceat(rank[order], heads), sizes)
        count[order] = np.repeat(sizes, sizes)
    return least, count


# Step 1: equal lines, and lines that share a half -----------------------------------------------------------------------

# A place is 4 * line number + 2 * (key of a whole line) + (decided: an earlier equal line exists).
_WHOLE, _DECIDED = 2, 1


def _half_keys(lines: _Lines, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key and second key of the first and last h words of the chosen lines."""
    n = lines.n[use]
    level = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    below = (n == 1 << level) & (level > 1)  # such a line may have a partner one word shorter
    which, levels = np.r_[use, use[below]], np.r_[level, level[below] - 1]
    half = np.left_shift(1, np.maximum(levels - 1, 0))
    heads, tails = lines.first[which], lines.first[which] + lines.n[which] - half
    keys = [np.r_[lines.digest(heads, half, "head", levels, s), lines.digest(tails, half, "tail", levels, s)] for s in (2, 3)]
    return np.r_[which, which], keys[0], keys[1]


def _line_rows(edit_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = _Lines(part.column("text"))
            whole = np.flatnonzero(lines.n > 0)
            if not len(whole):
                continue
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            tags = text_tags(part.column("text"))
            owner = ids[lines.row]
            rank = _rank(owner, lines.number)
            full = [lines.digest(lines.first[whole], lines.n[whole], "full", lines.n[whole], s) for s in (2, 3)]
            least, _ = _least(full[0], rank[whole])
            decided = rank[whole] > least
            first_ones = whole[~decided]
            which, one, two = _half_keys(lines, first_ones[lines.n[first_ones] >= edit_words])
            half_least, half_count = _least(one, rank[which])
            send = rank[which] == half_least  # the others of a key are candidates already
            near = np.unique(which[half_count > 1])
            at = np.r_[first_ones, which[send]]
            kind = np.r_[np.full(len(first_ones), _WHOLE), np.zeros(int(send.sum()), int)]
            keys, choose = np.r_[full[0][~decided], one[send]], np.r_[full[1][~decided], two[send]]
            out = list(pack(keys, choose, owner[at], tags[lines.row[at]], 4 * lines.number[at] + kind, buckets))
            done = np.r_[whole[decided], near]
            flag = np.r_[np.full(int(decided.sum()), _DECIDED), np.zeros(len(near), int)]
            local = pack(None, np.zeros(len(done), np.uint64), owner[done], tags[lines.row[done]], 4 * lines.number[done] + flag, 1)
            out += [row | {"bucket": -1 - int(choose[0] % _U(buckets))} for row in local]
            yield packed_batch(out)

    return run


def _shared(buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        keys, owners, tags, places = unpack_all(group)
        if key[0].as_py() >= 0:
            rank = _rank(owners, places >> 2)
            least, count = _least(keys, rank)
            whole = places & _WHOLE > 0
            hit = np.where(whole, rank > least, count > 1)
            owners, tags = owners[hit], tags[hit]
            places = (places[hit] & ~3) + whole[hit] * _DECIDED
        return by_owner(owners, tags, places, buckets)

    return run


# Step 2: variants of the lines left -------------------------------------------------------------------------------------

# A place is 2 * line number + (the key is the line with a word left out, to be met by a whole line).
_SHORTER = 1


def marked_lines(packed: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers of a document that are decided, and of those that need variants."""
    if not packed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = np.frombuffer(packed, np.uint32).astype(np.int64)
    decided = np.unique(places[places & _DECIDED > 0] >> 2)
    return decided, np.setdiff1d(places[places & 3 == 0] >> 2, decided)


def _variant_rows(edit_words: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            lines = _Lines(part.column("text"))
            first_line = np.searchsorted(lines.row, np.arange(part.num_rows))
            wanted = [marked_lines(p)[1] + first_line[i] for i, p in enumerate(part.column("places").to_pylist())]
            use = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
            if not len(use):
                continue
            n, first = lines.n[use], lines.first[use]
            each = np.repeat(np.arange(len(use)), n)
            at = ragged(first, n)  # the word left out
            gap = at - first[each]
            keys = []
            for seed in (2, 3):
                # A running sum without the word left out: later words move one place down.
                left = range_hash(lines.hashes, first[each], at, seed)
                right = range_hash(lines.hashes, at + 1, first[each] + n[each], seed + 1)
                rest = mix(left * _U(0x9E3779B97F4A7C15) ^ right)
                keys.append(mix(rest + mix((gap * (1 << 30) + n[each]).astype(np.uint64) * _U(8) + _U(_KIND["replaced"]))))
            shorter = _without(lines.hashes, first[each], at, first[each] + n[each])
            whole = [lines.digest(first, n, "full", n, s) for s in (2, 3)]
            shorter = [mix(h + mix((n[each] - 1).astype(np.uint64) * _U(8) + _U(_KIND["full"]))) for h in shorter]
            ok = n[each] > edit_words  # the shorter partner must have so many words, too
            owner = part.column("doc_id").to_numpy()[lines.row[use]]
            tags = text_tags(part.column("text"))[lines.row[use]]
            line = np.r_[np.arange(len(use)), each, each[ok]]
            kind = np.r_[np.zeros(len(use) + len(each), int), np.full(int(ok.sum()), _SHORTER)]
            one = np.r_[whole[0], keys[0], shorter[0][ok]]
            two = np.r_[whole[1], keys[1], shorter[1][ok]]
            yield packed_batch(list(pack(one, two, owner[line], tags[line], 2 * lines.number[use][line] + kind, buckets)))

    return run


def _without(hashes: np.ndarray, start: np.ndarray, gap: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """``range_hash`` of the words start..end without the one at ``gap``, for the seeds 2 and 3."""
    out = []
    for seed in (2, 3):
        back = powers(seed, len(hashes) + 2, inverse=True)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(seed, len(hashes)), out=sums[1:])
        total = (sums[gap] - sums[start]) + (sums[end] - sums[gap + 1]) * back[1]
        out.append(mix(total * back[start] + (end - start - 1).astype(np.uint64)))
    return out


def _linked(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        keys, owners, tags, places = unpack_all(group)
        rank = _rank(owners, places >> 1)
        shorter = places & _SHORTER > 0
        least, _ = _least(keys, rank)
        far = np.iinfo(np.int64).max
        least_whole, _ = _least(keys, np.where(shorter, far, rank))
        hit = rank > np.where(shorter, least_whole, least)
        return by_owner(owners[hit], tags[hit], places[hit] >> 1, buckets)

    return run


def with_rest(docs: DataFrame) -> DataFrame:
    """``doc_id, text, rest``: all other columns in one struct (a null if there are none)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))


def remove_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``doc_id, text, n_lines, n_removed, rest`` for every row; ``text`` has the lines that stay."""
    buckets = buckets_of(docs)
    rows = with_rest(docs)
    packed = rows.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_line_rows(edit_words, buckets), ROW)
    found = written(to_documents(packed.groupBy("bucket").applyInArrow(_shared(buckets), ROW)), "lines")
    bits = id_bits(found)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.filter(pa.array(maybe_rows(bits, part.column("doc_id"))))
            tags = pa.array(text_tags(part.column("text")), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, tags], [*part.schema.names, "tag"])

    kind = rows.schema["rest"].dataType.simpleString()
    inside = rows.mapInArrow(tagged, f"doc_id long, text string, rest {kind}, tag long")
    marked = written(inside.join(found, ["doc_id", "tag"], "left"), "marked")
    variants = marked.where("places IS NOT NULL").select("doc_id", "text", "places").mapInArrow(_variant_rows(edit_words, buckets), ROW)
    more = to_documents(variants.groupBy("bucket").applyInArrow(_linked(buckets), ROW)).withColumnRenamed("places", "near")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, total, gone = [], [], []
            for text, places, near in zip(*(batch.column(n).to_pylist() for n in ("text", "places", "near"))):
                drop = set(marked_lines(places)[0].tolist()) | set(np.frombuffer(near or b"", np.uint32).tolist())
                lines = [] if text is None else text.split("\n")
                texts.append(None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in drop))
                total.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column("rest")],
                ["doc_id", "text", "n_lines", "n_removed", "rest"],
            )

    changed = marked.join(more, ["doc_id", "tag"], "left").select("doc_id", "text", "places", "near", "rest")
    changed = changed.mapInArrow(cut, f"doc_id long, text string, n_lines long, n_removed long, rest {kind}")
    same = rows_by_bits(rows, bits, False).select(
        "doc_id",
        "text",
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_removed"),
        "rest",
    )
    return changed.union(same)
