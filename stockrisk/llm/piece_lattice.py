"""SentencePiece encoding and decoding: N-best segmentations of a text over the lattice of its pieces.

Pieces come from the vocabulary file.  Such a file of merges has ranks and no probabilities; a piece of rank r gets those of
Zipf's law, p(r) = 1 / (r + ZIPF), normalised.  A character that is no piece is its bytes.  A blank is the mark of a piece, and
a blank is put before a text that is not empty, as the file asks for.

Between two bytes that stand side by side in no piece, every segmentation has a border.  These borders cut a text into short
units, whose lattices are independent.  Each distinct unit of a slice is solved once: forward Viterbi scores F for all units of
one length together; with the scores B of what follows, the best deviation of a unit is its best F + edge + B off the best
path.  The N best segmentations of a text deviate in its N - 1 units of best deviation only.  For these units an A-star search
runs backwards from the end of the unit: F is the exact score of what is still missing, so that paths leave the queue best
first.  The unit paths are then combined best first.

Decoding joins pieces and bytes and takes the first blank off: the text comes back byte for byte.

Defined results: null and empty texts have no ids, one (empty) segmentation, and decode to the empty text; a text with fewer
than N segmentations gives all of them; of equal scores, the longer last piece, and then the earlier unit comes first.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from stockrisk.llm.blocks import mix, ragged, range_hash, slices
from stockrisk.llm.line_dedup import with_rest
from stockrisk.llm.token_records import Growing

VOCABULARY = "piece_bpe_32k.model"
N_BEST = 4
ZIPF = 2.7
LONGEST = 24  # bytes of a unit that is solved together with others of its length
_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_FAR = -1e300


class Lattice:
    KEEP = 250_000

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        used, rank = {}, 0
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
                text = model.id_to_piece(i).replace("▁", " ").encode()
                self.bytes_of[i] = text
                used[text] = (i, rank)
                rank += 1
        total = np.log(sum(1 / (r + ZIPF) for r in range(rank)))
        self.pieces = {text: (i, -float(np.log(r + ZIPF)) - float(total)) for text, (i, r) in used.items()}
        self.byte_score = min(s for _, s in self.pieces.values()) - 2.0
        self.longest = max(map(len, self.pieces))
        self.beside = np.zeros((256, 256), bool)
        for text in self.pieces:
            raw = np.frombuffer(text, np.uint8)
            self.beside[raw[:-1], raw[1:]] = True
        keys, ids, scores = [], [], []
        for text, (i, s) in self.pieces.items():
            h = 0
            for c in text:
                h = (h * int(_FACTOR) + c + 1) & 0xFFFFFFFFFFFFFFFF
            keys.append(h)
            ids.append(i)
            scores.append(s)
        keys = mix(np.array(keys, np.uint64))
        order = np.argsort(keys)
        self.keys, self.key_id, self.key_score = keys[order], np.array(ids)[order], np.array(scores)[order]
        # The place of a key in the sorted keys, from its upper bits.
        self.guide = np.searchsorted(self.keys, np.arange((1 << 16) + 1, dtype=np.float64) * 2.0**48).astype(np.int32)
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.score, self.gap = Growing(np.float64), Growing(np.float64)
        self.starts, self.sizes, self.flat = Growing(np.int64), Growing(np.int32), Growing(np.uint32)
        self.found: dict[tuple[int, int], list] = {}

    # Units ------------------------------------------------------------------------------------------------------------

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of each unit of the texts, one text after another, and the first unit of each text."""
        coded = [b" " + t.encode() if t else b"" for t in texts]
        joined = b"".join(coded)
        data = np.frombuffer(joined, np.uint8)
        offsets = np.r_[0, np.cumsum([len(c) for c in coded])].astype(np.int64)
        border = np.ones(len(data), bool)
        border[1:] = ~self.beside[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        border[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(border)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        values = mix(data.astype(np.uint64) + _U(1))
        one, two = range_hash(values, starts, ends, 1), range_hash(values, starts, ends, 2)
        _, sample, which = np.unique(one, return_index=True, return_inverse=True)
        if (two[sample][which] != two).any():
            sample = which = np.arange(len(starts))
        distinct = [joined[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
        if len(self.index) > self.KEEP:
            self.reset()
        self.solve([u for u in dict.fromkeys(distinct) if u not in self.index])
        place = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        return place[which] if len(which) else np.zeros(0, np.int64), np.searchsorted(starts, offsets)

    def add(self, units: list[bytes], score: np.ndarray, gap: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(units, range(len(self.names), len(self.names) + len(units))))
        self.names += units
        self.starts.extend(len(self.flat) + np.cumsum(sizes) - sizes)
        for store, values in ((self.score, score), (self.gap, gap), (self.sizes, sizes), (self.flat, ids)):
            store.extend(values)

    def solve(self, units: list[bytes]) -> None:
        by_length: dict[int, list[bytes]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for n, group in by_length.items():
            if n > LONGEST:
                for u in group:
                    paths = self.search(u, 2)
                    ids = np.array(paths[0][1])
                    gap = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
                    self.add([u], np.array([paths[0][0]]), np.array([gap]), ids, np.array([len(ids)]))
                continue
            for a in range(0, len(group), 20_000):
                self._solve_equal(group[a : a + 20_000], n)

    def _solve_equal(self, units: list[bytes], n: int) -> None:
        m = len(units)
        raw = np.frombuffer(b"".join(units), np.uint8).reshape(m, n)
        letters = np.ascontiguousarray(raw.T)
        lead = [(c & 0xC0) != 0x80 for c in letters]
        width = [1 + (c >= 0xC0).astype(np.int8) + (c >= 0xE0) + (c >= 0xF0) for c in letters]
        edges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for i in range(n):
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _FACTOR + (letters[j - 1].astype(np.uint64) + _U(1))
                key = mix(h)
                at = self._place(key)
                is_piece = self.keys[at] == key
                score = np.where(is_piece, self.key_score[at], _FAR)
                ids = np.where(is_piece, self.key_id[at], -1)
                if j - i <= 4:
                    spelt = lead[i] & (width[i] == j - i) & ~is_piece
                    score[spelt], ids[spelt] = (j - i) * self.byte_score, -2
                if (score > _FAR).any():
                    edges[i, j] = score, ids
        ahead = [np.zeros(m)] + [np.full(m, _FAR) for _ in range(n)]
        origin = [np.zeros(m, np.int64) for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if (i, j) in edges:
                    value = ahead[i] + edges[i, j][0]
                    better = value > ahead[j]
                    ahead[j][better], origin[j][better] = value[better], i
        behind = [np.full(m, _FAR) for _ in range(n)] + [np.zeros(m)]
        for i in range(n - 1, -1, -1):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (i, j) in edges:
                    np.maximum(behind[i], edges[i, j][0] + behind[j], out=behind[i])
        # Which positions the best path visits, then its edges in order.
        visited = np.zeros((n + 1, m), bool)
        visited[n] = True
        for j in range(n, 0, -1):
            at = np.flatnonzero(visited[j])
            visited[origin[j][at], at] = True
        second = np.full(m, _FAR)
        tokens = np.full((m, n), -1, np.int64)
        for (i, j), (score, ids) in edges.items():
            on = visited[j] & visited[i] & (origin[j] == i)
            tokens[on, i] = ids[on]
            value = np.where(on, _FAR, ahead[i] + score + behind[j])
            np.maximum(second, value, out=second)
        best = ahead[n]
        gap = np.where(second < -1e200, np.inf, np.maximum(best - second, 0))
        spelt = np.argwhere(tokens == -2)
        for u, i in spelt.tolist():
            for k in range(int(width[i][u])):
                tokens[u, i + k] = self.byte_id[int(raw[u, i + k])]
        keep = tokens >= 0
        self.add(units, best, gap, tokens[keep], keep.sum(axis=1))

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where a key would stand in the sorted keys: the guide gives the first of its upper bits, a few steps the rest."""
        at = self.guide[(key >> _U(48)).astype(np.int64)].astype(np.int64)
        last = len(self.keys) - 1
        at = np.minimum(at, last)
        for _ in range(8):
            less = self.keys[at] < key
            if not less.any():
                return at
            at = np.minimum(at + less, last)
        return np.minimum(np.searchsorted(self.keys, key), last)

    # Search -----------------------------------------------------------------------------------------------------------

    def search(self, unit: bytes, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best paths of a unit: forward Viterbi, then A-star from the end with its scores as heuristic."""
        size = len(unit)
        ahead = [_FAR] * (size + 1)
        ahead[0] = 0.0
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            if ahead[i] == _FAR:
                continue
            for j in range(i + 1, min(size, i + self.longest) + 1):
                piece = self.pieces.get(unit[i:j])
                if piece:
                    into[j].append((i, piece[0], piece[1]))
                    ahead[j] = max(ahead[j], ahead[i] + piece[1])
            c = unit[i]
            wide = 1 + (c >= 0xC0) + (c >= 0xE0) + (c >= 0xF0)
            if unit[i : i + wide] not in self.pieces:
                into[i + wide].append((i, -2, wide * self.byte_score))
                ahead[i + wide] = max(ahead[i + wide], ahead[i] + wide * self.byte_score)
        queue = [(-ahead[size], 0, size, 0.0, None)]
        pushed, out = 0, []
        while queue and len(out) < n:
            _, _, j, after, path = heapq.heappop(queue)
            if j == 0:
                ids = []
                while path is not None:
                    (i, k, piece), path = path
                    ids += [piece] if piece >= 0 else [self.byte_id[c] for c in unit[i:k]]
                out.append((after, ids))
                continue
            for i, piece, score in into[j]:
                pushed += 1
                heapq.heappush(queue, (-(ahead[i] + score + after), pushed, i, after + score, ((i, j, piece), path)))
        return out

    def best_paths(self, unit: int, n: int) -> list[tuple[float, list[int]]]:
        if len(self.found) > 50_000:
            self.found.clear()
        if (unit, n) not in self.found:
            self.found[unit, n] = self.search(self.names[unit], n)
        return self.found[unit, n]

    def n_best(self, which: np.ndarray, n: int) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best segmentations of a text given as units: scores and ids, best first."""
        starts, sizes, flat = self.starts.view()[which], self.sizes.view()[which], self.flat.view()
        best = flat[ragged(starts, sizes)]
        score = float(self.score.view()[which].sum())
        out = [(score, best)]
        gaps = self.gap.view()[which]
        able = np.flatnonzero(np.isfinite(gaps))
        if n == 1 or not len(able):
            return out
        if len(able) > 4 * n:
            bound = np.partition(gaps[able], n - 2)[n - 2]
            able = able[gaps[able] <= bound]
        able = np.sort(able[np.argsort(gaps[able], kind="stable")[: n - 1]])
        paths = [self.best_paths(int(which[p]), n) for p in able]
        queue, seen = [(0.0, (0,) * len(able))], {(0,) * len(able)}
        cuts = np.cumsum(sizes) - sizes
        while queue and len(out) <= n:
            loss, choice = heapq.heappop(queue)
            if any(choice):
                parts, at = [], 0
                for p, k, options in zip(able, choice, paths):
                    if k:
                        parts += [best[at : cuts[p]], np.array(options[k][1], best.dtype)]
                        at = cuts[p] + sizes[p]
                out.append((score - loss, np.concatenate([*parts, best[at:]])))
                if len(out) == n:
                    break
            for p in range(len(able)):
                if choice[p] + 1 < len(paths[p]):
                    nxt = (*choice[:p], choice[p] + 1, *choice[p + 1 :])
                    if nxt not in seen:
                        seen.add(nxt)
                        lost = sum(o[0][0] - o[k][0] for o, k in zip(paths, nxt))
                        heapq.heappush(queue, (lost, nxt))
        return out

    def decode(self, ids: np.ndarray) -> str:
        joined = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return joined[1:].decode()


_LATTICES: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    """One lattice per worker process; what it solved serves the next task too."""
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


_BEST = "array<struct<score: double, ids: array<int>>>"


def encode(docs: DataFrame, n: int = N_BEST, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text, best, decoded, rest``: the ``n`` best segmentations of each text, and the first one decoded."""
    return _run(docs, n, vocabulary, full=True)


def encode_digests(docs: DataFrame, n: int = N_BEST, vocabulary: str | None = None) -> DataFrame:
    """As ``encode`` with the number and the CRC-32 of the ids instead of ids, and whether decoding gave the text."""
    return _run(docs, n, vocabulary, full=False)


def _run(docs: DataFrame, n: int, vocabulary: str | None, full: bool) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = with_rest(docs)
    kind = rows.schema["rest"].dataType.simpleString()
    names = ["score", "ids"] if full else ["score", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = lattice(path)
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            which, first = solver.units(texts)
            best, decoded = [], []
            for text, a, b in zip(texts, first[:-1].tolist(), first[1:].tolist()):
                found = solver.n_best(which[a:b], n)
                if full:
                    best.append([(s, ids.tolist()) for s, ids in found])
                    decoded.append(solver.decode(found[0][1]))
                else:
                    best.append([(s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for s, ids in found])
                    decoded.append(solver.decode(found[0][1]) == (text or ""))
            kinds = [pa.float64(), pa.list_(pa.int32())] if full else [pa.float64(), pa.int64(), pa.int64()]
            struct = pa.list_(pa.struct(list(zip(names, kinds))))
            values = pa.array([[dict(zip(names, x)) for x in row] for row in best], struct)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text"), values, pa.array(decoded, pa.string() if full else pa.bool_()), part.column("rest")],
                ["doc_id", "text", "best", "decoded", "rest"],
            )

    shape = _BEST if full else "array<struct<score: double, n_tokens: long, ids_crc32: long>>"
    return rows.mapInArrow(run, f"doc_id long, text string, best {shape}, decoded {'string' if full else 'boolean'}, rest {kind}")
