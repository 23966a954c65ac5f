"""Token-id output: length-delimited binary records with masked checksums, and a separate offset index.

Documents are dealt by ranges of ``doc_id`` and encoded in that order, one file per range.  A record is

    length of the payload (8 bytes) | masked CRC-32 of these 8 bytes (4) | payload | masked CRC-32 of the payload (4)

and its payload is ``doc_id`` (8 bytes, signed) followed by the ids, the document's end id last.  All numbers are
little-endian; ids take two bytes when the vocabulary fits, else four.  Masked: the checksum rotated right by 15 bits
plus a constant, so that a checksum of data that holds checksums is of use.  The index file beside it holds each
record's byte offset (8 bytes), so that a reader can fetch records in any order.

A task writes under a name of its own attempt, and only the names that tasks returned are read, so a lost executor or
a repeated task leaves no wrong file in the result.  Files go to the shared folder through ``pyarrow.fs``.

Defined results: null text is empty (one end id); rows with a null ``doc_id`` are written first; rows with equal ids are
written in order of their text; an empty table gives no files and no rows; further columns are dropped.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stockrisk.llm.blocks import ragged, slices, text_bytes, words_of
from stockrisk.session import shared_folder, written

VOCABULARY = "word_bpe_49k.json"
END = 1
NO_ID = -(1 << 63)  # stands for a null doc_id in a record
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long, width int"
_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("path", pa.string())]
    + [(name, pa.int64()) for name in ("n_docs", "n_tokens", "n_bytes")]
    + [("width", pa.int32())]
)
# Fixed values of the record format.
MASK_ADD, MASK_TURN = 0xA282EAD8, 15


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_TURN) | (crc << (32 - MASK_TURN))) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(buffer: memoryview, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place of the next record."""
    head = bytes(buffer[at : at + 8])
    (length,) = struct.unpack("<Q", head)
    (check,) = struct.unpack_from("<I", buffer, at + 8)
    payload = bytes(buffer[at + 12 : at + 12 + length])
    (check_payload,) = struct.unpack_from("<I", buffer, at + 12 + length)
    if check != masked(head) or check_payload != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + length


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.n

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.view(), np.zeros(self.n + 2 * len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def view(self) -> np.ndarray:
        return self.data[: self.n]


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    The vocabulary's pre-tokens never cross white space, and a run of letters before a final point or comma is a
    pre-token of its own, so a text's ids are those of its words in order.  The words seen are kept up to a bound.
    """

    KEEP = 1_000_000

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.end = end
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}  # word -> place in ``starts`` and ``sizes``
        self.starts, self.sizes = Growing(np.int64), Growing(np.int32)
        self.flat = Growing(np.uint16 if self.width == 2 else np.uint32)

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts.extend(len(self.flat) + np.cumsum(sizes) - sizes)
        self.sizes.extend(sizes)
        self.flat.extend(ids)

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self.index)
        ended = [w for w in new if w[-1] in b".," and len(w) > 1 and w[:-1].decode()[-1].isalpha()]
        need = new.difference(ended)
        need.update(core for core in [w[:-1] for w in ended] if core not in self.index)
        need.update(m for m in (b".", b",") if m not in self.index)
        # Letters only: one pre-token each, so that many are encoded as one text and told apart by its word numbers.
        plain, other = [], []
        for w in need:
            (plain if w.decode().isalpha() else other).append(w)
        for a in range(0, len(plain), 2000):
            part = plain[a : a + 2000]
            coded = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(part))
            if len(sizes) == len(part) and sizes.all():
                self.add(part, np.array(coded.ids, np.uint32), sizes)
            else:  # the library takes one of these letters for none
                other += part
        if other:
            coded = [c.ids for c in self.tokenizer.encode_batch([w.decode() for w in other], add_special_tokens=False)]
            self.add(other, np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded]))
        if ended:
            cores = np.array([self.index[w[:-1]] for w in ended])
            marks = np.array([self.index[w[-1:]] for w in ended])
            pairs = np.stack([cores, marks], axis=1).ravel()
            ids = self.flat.view()[ragged(self.starts.view()[pairs], self.sizes.view()[pairs])]
            self.add(ended, ids, self.sizes.view()[cores] + self.sizes.view()[marks])

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text with the end id."""
        words = words_of(column, lower=True)
        # The library finds special tokens in the text as it is, before it lowers the rest.
        raw, _ = text_bytes(column)
        special = np.unique(np.searchsorted(words.starts, np.flatnonzero(raw == ord("<")), side="right") - 1)
        kept = ragged(words.starts[special], words.ends[special] - words.starts[special])
        words.data[kept] = raw[kept]
        hashes, check = words.hashes(1), words.hashes(2)
        _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if (check[sample][which] != check).any():  # two words with one hash: every word for itself
            sample = which = np.arange(len(hashes))
        data = words.data.tobytes()
        distinct = [data[a:b] for a, b in zip(words.starts[sample].tolist(), words.ends[sample].tolist())]
        if len(self.index) > self.KEEP:
            self.reset()
        self.learn(set(distinct))
        place = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[which]
        flat, starts, sizes = self.flat.view(), self.starts.view()[place], self.sizes.view()[place]
        ids = flat[ragged(starts, sizes)]
        cuts = np.r_[0, np.cumsum(sizes)][words.first]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield np.append(ids[a:b], flat.dtype.type(self.end))


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end: int) -> WordEncoder:
    """One encoder per worker process; what it learned serves the next task too."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = WordEncoder(path, end)
    return _ENCODERS[path, end]


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write all documents below ``folder`` (a URI that every executor reaches); the manifest of the files."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    place = F.spark_partition_id().alias("shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = index = None
        shard = docs_n = tokens = at = 0
        coder = encoder(path, end)
        kind = np.dtype("<u2" if coder.width == 2 else "<u4")
        for part in slices(batches):
            if files is None:
                shard = part.column("shard")[0].as_py()
                system, base = pafs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
                name = f"{base}/part-{shard:06d}-{uuid.uuid4().hex}"
                files, index = system.open_output_stream(name + ".rec"), system.open_output_stream(name + ".idx")
            offsets = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text"))):
                record = frame(struct.pack("<q", NO_ID if doc_id is None else doc_id) + ids.astype(kind).tobytes())
                files.write(record)
                offsets.append(at)
                at, tokens, docs_n = at + len(record), tokens + len(ids), docs_n + 1
            index.write(np.array(offsets, "<u8").tobytes())
        if files is not None:
            files.close()
            index.close()
            values = (shard, os.path.basename(name), docs_n, tokens, at, coder.width)
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, values))], _MANIFEST)

    return written(dealt.select("*", place).mapInArrow(write, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: ids in all files before.  One row per file, so that one window holds them."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, its checksums verified."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            kind = np.dtype("<u2" if row["width"] == 2 else "<u4")
            with system.open_input_file(f"{base}/{row['path']}.idx") as f:
                offsets = np.frombuffer(f.read(), "<u8")
            start, out = row["start"], []
            with system.open_input_stream(f"{base}/{row['path']}.rec", buffer_size=1 << 20) as f:
                for n, at in enumerate(np.r_[offsets, row["n_bytes"]][1:].tolist()):
                    record = f.read(at - int(offsets[n]))
                    payload, _ = unframe(memoryview(record), 0)
                    ids = np.frombuffer(payload, kind, offset=8)
                    (doc_id,) = struct.unpack_from("<q", payload)
                    doc_id = None if doc_id == NO_ID else doc_id
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = with_starts(manifest).repartitionByRange(partitions, "shard")
    return each.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def records_folder(docs: DataFrame) -> str:
    """A new folder for records below the shared folder, as a URI."""
    folder = shared_folder(docs.sparkSession, "records")
    return folder if re.match(r"\w[\w+.-]*:/", folder) else f"file://{os.path.abspath(folder)}"


def encode_documents(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write the records of all documents to a new shared folder and read them back."""
    folder = records_folder(docs)
    return read_records(write_records(docs, folder, vocabulary, end), folder)
