"""Byte-level BPE over a rank file: a queue of ranks under a bitmap for the merges, and the way back to bytes.

A pre-token is a linked list of its parts. For every rank there is a bucket of list positions
whose pair has that rank; a bitmap of 64-way words, one level above the other, tells which buckets hold any.
Find-first-set from the top word down names the lowest rank, its leftmost position is merged and
the two pairs beside it are filed anew. Entries of pairs that have changed since are skipped when
they come up. So a merge costs a few word operations however long the pre-token is.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

REMEMBERED = 1 << 18
SHORT = 64


class RankQueue:
    """Positions by rank. ``pop`` gives the leftmost position of the lowest rank."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.levels: list[list[int]] = []  # from one bit a bucket up to a single word
        while ranks > 1 or not self.levels:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            at = rank
            for words in self.levels:
                at, bit = at >> 6, 1 << (at & 63)
                filled = words[at]
                words[at] = filled | bit
                if filled:
                    break
        heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        top = self.levels[-1][0]
        if not top:
            return None
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            rank = (rank << 6) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            at = rank
            for words in self.levels:
                at, bit = at >> 6, 1 << (at & 63)
                words[at] ^= bit
                if words[at]:
                    break
        return rank, position


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: bytes and rank, which is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def library_class(name: str) -> set[str]:
    """The characters that the library's pattern engine counts as ``name``."""
    engine = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found = set()
    for i in range(0, 0x110000, 0x800):  # the surrogates are no characters, and fill whole steps
        if not 0xD800 <= i < 0xE000:
            found.update(bytes(engine.encode_ordinary("".join(map(chr, range(i, i + 0x800))))).decode())
    return found


#: What a character of a class beyond ASCII is split as; any other one is split as "!".
STAND_INS = {r"\p{L}": (b"z", b"a-zA-Z"), r"\p{N}": (b"0", b"0-9"), r"\s": (b"\t", rb"\s")}


class Splitter:
    """Pre-tokens as the library's engine finds them.

    The pattern knows characters beyond ASCII by class only, so each of them is written as a stand-in
    of its class and the pattern runs over bytes, one a character. The classes are asked of
    the library, since engines follow different versions of Unicode.
    """

    def __init__(self, pattern: str) -> None:
        table = np.full(0x110000, ord("!"), np.uint8)
        for name, (stand_in, _) in STAND_INS.items():
            table[[ord(c) for c in library_class(name)]] = ord(stand_in)
        table[:128] = np.arange(128)
        self.table = table
        plain = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", lambda m: self._ascii(m[0]), pattern)
        self.find = re.compile(plain.encode()).findall

    @staticmethod
    def _ascii(part: str) -> str:
        for name, (_, chars) in STAND_INS.items():
            part = part.replace(name, chars.decode() if part[0] == "[" else f"[{chars.decode()}]")
        return part

    def split(self, text: str) -> list[str]:
        marks = text.encode() if text.isascii() else self.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tobytes()
        ends = list(accumulate(map(len, self.find(marks))))
        return [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]


class Coder(dict):
    """A rank file as an encoder, and a cache from pre-token to ids.

    What is remembered is bounded: beyond ``REMEMBERED`` pre-tokens all are forgotten, longer ones are
    never kept. The ids don't depend on it, nor on which pre-tokens are merged side by side.
    """

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.size = max(self.ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.splitter = Splitter(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        known = self.ranks.get
        pairs = ((a, b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := known(t[:k])) is not None and (b := known(t[k:])) is not None)
        table = np.array(sorted((a * self.size + b, i) for a, b, i in pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        ranks, longest, queue = self.ranks.get, self.longest, self.queue
        n = len(piece)
        end = list(range(1, n + 1))  # the part that starts here ends where the next one starts
        left = list(range(-1, n - 1))
        pair = [-1] * (n + 1)  # rank of the part here with the next one

        def file(at: int) -> None:
            """File the pair of the part at ``at`` and the next one, if it has a rank."""
            rest = end[at]
            rank = ranks(piece[at : end[rest]]) if rest < n and end[rest] - at <= longest else None
            pair[at] = -1 if rank is None else rank
            if rank is not None:
                queue.push(rank, at)

        for at in range(n - 1):
            file(at)
        while (best := queue.pop()) is not None:
            rank, at = best
            if pair[at] != rank:
                continue  # the pair has changed since
            gone = end[at]
            pair[gone] = -1
            end[at] = end[gone]
            if end[at] < n:
                left[end[at]] = at
            file(at)
            if left[at] >= 0:
                file(left[at])
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 for those that the file lacks."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, pieces: Sequence[bytes]) -> list[bytes]:
        """Ids of many short pre-tokens, four bytes each, merged side by side over one queue.

        A bucket holds the 64 ranks of a bottom word of the bitmap. A step takes the first bucket and in it
        each pre-token's lowest rank, leftmost position; since no pair of it ranks lower
        than the bucket, that is its next merge. The other entries are filed again.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(pieces)), sizes)
        nxt, left = np.arange(1, len(tok) + 1), np.arange(-1, len(tok) - 1)
        nxt[ends - 1] = -1
        left[ends - sizes] = -1
        pair, alive = np.full(len(tok), -1), np.ones(len(tok), bool)
        buckets = RankQueue(-(-self.size // 64))
        held: list[list[np.ndarray]] = [[] for _ in buckets.buckets]

        def file(at: np.ndarray) -> None:
            """File the pairs of the parts at ``at`` and their next ones."""
            rank = np.full(len(at), -1)
            has = nxt[at] >= 0
            rank[has] = self._rank(tok[at[has]], tok[nxt[at[has]]])
            pair[at] = rank
            keep(at[rank >= 0])

        def keep(at: np.ndarray) -> None:
            bucket = pair[at] >> 6
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for i, j, k in zip(cuts, [*cuts[1:], len(at)], bucket[cuts].tolist(), strict=False):
                if not held[k]:
                    buckets.push(k, 0)
                held[k].append(at[i:j])

        file(np.arange(len(tok)))
        while (best := buckets.pop()) is not None:
            bucket = best[0]
            at = np.unique(np.concatenate(held[bucket]))
            held[bucket] = []
            at = at[pair[at] >> 6 == bucket]  # the others have changed since
            if not len(at):
                continue
            order = np.lexsort((at, pair[at], word[at]))
            first = np.diff(word[at[order]], prepend=-1) > 0
            rest, at = at[order[~first]], at[order[first]]
            gone = nxt[at]
            tok[at] = pair[at]
            pair[gone] = -1
            alive[gone] = False
            nxt[at] = nxt[gone]
            follows = nxt[at] >= 0
            left[nxt[at[follows]]] = at[follows]
            before = left[at]
            rest = rest[alive[rest]]
            file(np.concatenate([at, before[before >= 0]]))
            keep(rest[pair[rest] >= 0])
        ids = tok[alive].astype(np.int32).tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(word[alive], minlength=len(pieces)))).tolist()]
        return [ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Find the ids of new pre-tokens. A pre-token that is an entry of the file is that entry, as in the library."""
        found, short = {}, {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short[piece] = raw
            else:
                found[piece] = np.array(self.merge(raw), np.int32).tobytes()
        found.update(zip(short, self.merge_many(list(short.values())) if short else [], strict=True))
        return found

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of texts, four bytes each."""
        split = [self.splitter.split(t) for t in texts]
        new = set().union(*split).difference(self)
        found = self.learn(new)
        if len(self) + len(found) > REMEMBERED:
            used = set().union(*split)
            found.update((p, self[p]) for p in used if p in self)
            self.clear()
        self.update(found)
        out = [b"".join(map(self.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > SHORT:
                del self[piece]
        return out


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The coder of a rank file, made once per worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every whole text by the ranks in ``path``; special tokens are ordinary text.

    Null and empty texts have no ids. Rows are independent: repeated rows get equal ids, an empty
    table gives no rows, columns other than doc_id and text don't matter. A text of any length is encoded
    whole, and so is a pre-token of any length, in time of about its length times the depth of
    the bitmap. One scan, no shuffle; memory is that of a slice of texts or of one long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(path, pattern)
        for b in batches:
            texts = b.column("text")
            for i, j, _, _ in text_slices(texts):
                parts = tool.encode([t or "" for t in texts.slice(i, j - i).to_pylist()])
                ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), ids], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) with the bytes that the ids stand for; null ids count as none.

    Bytes, since ids cut anywhere may end inside a character. An id that the file lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry = {i: t for t, i in read_ranks(path).items()}.__getitem__
        for b in batches:
            ids = b.column("ids")
            for i in range(0, b.num_rows, 256):
                part = ids.slice(i, 256)
                texts = [b"".join(map(entry, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in part]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 256), part, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the decimal ids joined by commas and of the decoded bytes."""
    d = decode(encode(docs, path, pattern), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
