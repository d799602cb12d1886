"""Token ids in files of fixed-width packed bits, written and read by Spark tasks.

A file holds whole documents in order::

    magic, bits, ids in a block, documents, ids, blocks        (HEAD, little-endian)
    byte offset of every block from the start of the payload   (u64 each)
    first id of every document, and the end                    (u64 each)
    document ids (i64 each), 1 for each that is null (u8 each)
    payload: blocks of ids in the minimum number of bits

Ids are packed little-endian into 64-bit words, 64 ids to ``bits`` words, so both directions are a
few dozen shifts over whole arrays, and any run of ids can be read from the blocks that hold it.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import find_words, shared_folder, span_hashes, stage, text_slices

MAGIC = b"IDBITS01"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK = 1 << 14
#: A file is closed after this many ids or documents (or one longer document).
FILE_IDS, FILE_DOCS = 1 << 22, 1 << 18


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words with ``bits`` bits an id; the last group of 64 is filled up with zeros."""
    rows = -(-len(ids) // 64)
    full = np.zeros(rows * 64, np.uint64)
    full[: len(ids)] = ids
    if len(ids) and int(full.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    lanes = np.ascontiguousarray(full.reshape(rows, 64).T)
    out = np.zeros((bits, rows), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    rows = len(words) // bits
    lanes = np.ascontiguousarray(words.reshape(rows, bits).T)
    out = np.empty((64, rows), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[j] = v & mask
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    starts = np.zeros(len(doc_ids) + 1, np.uint64)
    np.cumsum(lengths, out=starts[1:])
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *(b.nbytes for b in blocks)])[:-1].astype(np.uint64) if blocks else np.zeros(0, np.uint64)
    keys = np.array([0 if d is None else d for d in doc_ids], np.int64)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, offsets.tobytes(), starts.tobytes(), keys.tobytes(), nulls.tobytes(), *(b.tobytes() for b in blocks)])


class IdFile:
    """Random access to an open file of packed ids."""

    def __init__(self, source) -> None:  # noqa: ANN001  a seekable binary file
        self.source = source
        magic, self.bits, self.block, n_docs, self.n_ids, n_blocks = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        take = lambda n, kind: np.frombuffer(source.read(n * np.dtype(kind).itemsize), kind)
        self.offsets, self.starts = take(n_blocks, np.uint64), take(n_docs + 1, np.uint64).astype(np.int64)
        self.keys, self.nulls = take(n_docs, np.int64), take(n_docs, np.uint8).astype(bool)
        self.payload = HEAD.size + 8 * n_blocks + 8 * (n_docs + 1) + 9 * n_docs

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        tail = min(self.n_ids, (last + 1) * self.block) - last * self.block
        size = int(self.offsets[last]) + 8 * self.bits * (-(-tail // 64)) - int(self.offsets[first])
        self.source.seek(self.payload + int(self.offsets[first]))
        words = np.frombuffer(self.source.read(size), np.uint64)
        # all blocks but the last are full, so the run of blocks unpacks as one
        return unpack(words, self.bits, min(self.n_ids, (last + 1) * self.block) - first * self.block)[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def open_ids(path: str) -> IdFile:
    fs, at = pafs.FileSystem.from_uri(path)
    return IdFile(fs.open_input_file(at))


# Lower-case Latin letters with at most one mark of punctuation: one pre-token, and one more for the mark.
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
_PIECE = np.ones(256, bool)
_PIECE[[32, 9, 10, 13]] = False


class Encoder:
    """Ids of whole texts by the tokenizers library, called once per new blank-separated piece.

    The tokenizer drops white space and no rule of it reaches across, so the ids of a text are those
    of its pieces. Pieces are cut at plain blanks and line breaks only; other white space
    stays inside a piece and is left to the library. If the vocabulary marks ends of words, new plain words
    are encoded together and told apart by these marks. Up to ``most`` pieces are remembered by
    64-bit hashes in flat arrays (some 25 bytes each); two of them share a hash with a chance below 1e-6.
    """

    def __init__(self, path: str, most: int = 4_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.vocabulary = self.tool.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in self.tool.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        # marks end words only where blanks and case do not matter
        self.marked = self._ids("Aa B") == self._ids("aa") + self._ids("b") and bool(self.ends.any())
        self.signs = {c: np.array(self._ids(c), np.uint32) for c in ("", *".,;:!?")}
        self.most = most
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tool.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint16 if self.vocabulary <= 1 << 16 else np.uint32)

    def _words(self, words: list[str]) -> dict[str, np.ndarray] | None:
        """Ids of plain words from one call; None if the marks do not tell them apart."""
        ids = np.array(self._ids(" ".join(words)), np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words) or cut[-1] != len(ids):
            return None
        at = cut.tolist()
        return {w: ids[i:j] for w, i, j in zip(words, [0, *at], at, strict=False)}

    def ids_of(self, pieces: list[str]) -> list[np.ndarray]:
        plain = [_PLAIN.fullmatch(p.lower()) if self.marked else None for p in pieces]
        words = list({m[1] for m in plain if m})
        known = (self._words(words) if words else {}) or {}
        rest = [p for p, m in zip(pieces, plain, strict=True) if not m or m[1] not in known]
        known |= {p: np.array(e.ids, np.uint32) for p, e in zip(rest, self.tool.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        return [known[p] if p in known else np.concatenate([known[m[1]], self.signs[m[2]]]) if m[2] else known[m[1]] for p, m in zip(pieces, plain, strict=True)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice one after the other, and how many each text has."""
        starts, ends, first = find_words(_PIECE, data, off)
        hashes, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._forget()
        place = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != hashes[inside]
        if new.any():
            text = data.tobytes()
            found = self.ids_of([text[i:j].decode("utf-8", "surrogatepass") for i, j in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
            n = np.fromiter(map(len, found), np.int64, len(found))
            self.keys = np.insert(self.keys, place[new], hashes[new])
            self.start = np.insert(self.start, place[new], len(self.flat) + np.cumsum(n) - n)
            self.count = np.insert(self.count, place[new], n)
            self.flat = np.concatenate([self.flat, *found]).astype(self.flat.dtype)
            place = np.searchsorted(self.keys, hashes)
        n, s = self.count[place][inverse], self.start[place][inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(s - upto[:-1], n) + np.arange(upto[-1])].astype("<u4")
        return ids, np.diff(upto[first])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 1, slice_bytes: int = 1 << 21) -> DataFrame:
    """Write the ids of all texts to ``folder`` in ascending doc_id order; returns the files' list.

    Output, one row per file: part, seq, file, n_docs, n_ids, start (ids in all files before). Null
    doc_ids come first; rows with one doc_id are ordered by their text; a null text is empty and has only the
    end id. Files are named by attempt and listed by Spark's committed output, so a task that runs
    again leaves at most a file that nothing refers to. ``folder`` is any place pyarrow can write.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        bits = width(max(tool.vocabulary, end_id + 1))
        end = np.array([end_id], "<u4")
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        keys: list[int | None] = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        seq = total = 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:06d}-{seq:06d}-{attempt}.ids"
            ids = np.concatenate(held)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(file_bytes(keys, np.array(lengths, np.int64), ids, bits))
            row = [[part], [seq], [f"{folder}/{name}"], [len(keys)], [len(ids)]]
            keys.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["part", "seq", "file", "n_docs", "n_ids"])

        for b in batches:
            names = b.column("doc_id").to_pylist()
            for i, _, data, off in text_slices(b.column("text"), slice_bytes):
                ids, counts = tool.encode(data, off)
                upto = np.cumsum(counts).tolist()
                for k, (lo, hi) in enumerate(zip([0, *upto], upto, strict=False)):
                    n = hi - lo + 1
                    if keys and (total + n > FILE_IDS or len(keys) >= FILE_DOCS):
                        yield close()
                        seq, total = seq + 1, 0
                    keys.append(names[i + k])
                    lengths.append(n)
                    held += (ids[lo:hi], end)
                    total += n
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = stage(rows.mapInArrow(run, "part long, seq long, file string, n_docs long, n_ids long"), "id-files")
    # one row per file meets here
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(files: DataFrame) -> DataFrame:
    """Read the listed files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, start in zip(b["file"], b["start"], strict=True):
                f = open_ids(name)
                ids = f.ids(0, f.n_ids).astype("<u4")
                cut = f.starts
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                key = pd.Series(f.keys, dtype="Int64").mask(f.nulls)
                yield pd.DataFrame({"doc_id": key, "start": start + cut[:-1], "n_tokens": np.diff(cut), "ids_crc32": np.array(crc, np.int64)})

    n = files.count()
    return files.select("file", "start").repartition(max(1, n)).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode, write, read back: doc_id, start, n_tokens (with the end id), ids_crc32.

    ``ids_crc32`` is over the document's ids as little-endian unsigned 32-bit integers. Files go to a new
    folder under the cluster's shared folder unless one is given. An empty table writes no files and gives no rows;
    equal rows are written once each. Columns other than doc_id and text don't matter.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/llm-ids-{uuid.uuid4().hex}"
    return read_documents(stage(write_ids(docs, path, folder, end_id), "id-list"))
