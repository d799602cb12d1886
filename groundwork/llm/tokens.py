"""Token counts from a tokenizer compiled to finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers:

* the *splitter* over character classes cuts a text into pre-tokens. It has a dozen states, so a chunk
  of text is a map from entry state to exit state; the maps of all chunks are computed side by
  side and composed by a parallel prefix scan, which gives every chunk its entry state;
* the *counter* over bytes annotates each transition with the change in the number of tokens emitted
  so far. A state is the set of vocabulary prefixes that are open at this point, each with the
  token before it and the tokens since; it is determinised when a text first reaches it.

The counter rests on a property of BPE: the last token of a prefix is the one vocabulary suffix
that merges into itself next to the token before it, and the tokens before it are those of the
shorter prefix.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- the splitter ------------------------------------------------------------------------------
# The pattern that byte-level tokenizers split by, as classes and states.
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, STMD, RV, E, ELL, NUMBER, SPACE, WHITE, TICK, OTHER, END = range(11)
LETTERS = (LETTER, STMD, RV, E, ELL)
START, IN_L, IN_N, IN_O, S1, W1, S2, W2, AT_TICK, TICK_RV, TICK_L, DONE = range(12)
STATES = 12
HERE, BACK = 1, 2  # a pre-token starts at this character, at the one before
CHUNK = 64


def _splitter() -> tuple[bytes, bytes]:
    """Next state and cuts for state * 16 + class."""
    after, cuts = bytearray(256), bytearray(256)
    for s in range(STATES):
        for c in range(11):
            if c == END:
                to, cut = START, HERE | (BACK if s in (TICK_RV, TICK_L) else 0)
            elif c in (SPACE, WHITE):
                run = s in (S1, W1, S2, W2)
                to = (S2 if run else S1) if c == SPACE else (W2 if run else W1)
                cut = (0 if run else HERE) | (BACK if s in (TICK_RV, TICK_L) else 0)
            else:
                kind = IN_L if c in LETTERS else IN_N if c == NUMBER else IN_O
                joined = s in (S1, S2)  # the blank before belongs to this pre-token
                cut = BACK if s in (S2, W2) else 0
                to = kind
                if s == AT_TICK and c in (STMD, RV, ELL):
                    to = {STMD: DONE, RV: TICK_RV, ELL: TICK_L}[c]
                elif (s, c) in ((TICK_RV, E), (TICK_L, ELL)):
                    to = DONE
                elif s in (TICK_RV, TICK_L):  # no contraction: the letter began a pre-token
                    cut = BACK | (0 if kind == IN_L else HERE)
                    to = AT_TICK if c == TICK else kind
                elif c == TICK and not joined and s not in (IN_O, AT_TICK):
                    to, cut = AT_TICK, cut | HERE
                elif not joined and s != kind and not (s == AT_TICK and kind == IN_O):
                    cut |= HERE
            after[s * 16 + c], cuts[s * 16 + c] = to, cut
    return bytes(after), bytes(cuts)


AFTER, CUTS = _splitter()


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = kind.get(unicodedata.category(chr(c))[0])
        if k is not None:
            table[c] = k
    white = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[white] = WHITE
    for chars, k in ((" ", SPACE), ("'", TICK), ("stmd", STMD), ("rv", RV), ("e", E), ("l", ELL)):
        table[[ord(c) for c in chars]] = k
    return table


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """(states, chunks): the exit state of each chunk for each entry state. ``classes``: (CHUNK, chunks)."""
    state = np.repeat(np.arange(STATES, dtype=np.uint8), classes.shape[1]).reshape(STATES, -1)
    for row in classes:
        state = np.frombuffer(((state << 4) | row).tobytes().translate(AFTER), np.uint8).reshape(STATES, -1)
    return state


def entry_states(maps: np.ndarray) -> np.ndarray:
    """Entry state of every chunk, by a parallel prefix scan that composes the chunks' maps."""
    maps = maps.copy()
    d = 1
    while d < maps.shape[1]:
        maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d].astype(np.intp), axis=0)
        d *= 2
    return np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)


def split_points(classes: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens (and END marks) start."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.int64)
    full = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
    full[:n] = classes
    rows = np.ascontiguousarray(full.reshape(-1, CHUNK).T)
    state = entry_states(chunk_maps(rows))
    cuts = np.empty_like(rows)
    for k, row in enumerate(rows):
        at = ((state << 4) | row).tobytes()
        cuts[k] = np.frombuffer(at.translate(CUTS), np.uint8)
        state = np.frombuffer(at.translate(AFTER), np.uint8)
    flat = cuts.T.reshape(-1)[:n]
    here = (flat & HERE) > 0
    here[:-1] |= (flat[1:] & BACK) > 0
    return np.flatnonzero(here)


# ---- the counter -------------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Transducer over the bytes of a pre-token whose transition weights add up to its token count.

    States are built when first reached; beyond ``most`` states all are dropped and built anew, so
    memory is bounded and results do not change.
    """

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], most: int = 300_000) -> None:
        letters = _byte_letters()
        self.most = most
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_id = {self.bytes[i][0]: i for i in vocab.values() if len(self.bytes[i]) == 1}
        self.edges: dict[int, int] = {}
        self.token_at = [-1]
        for i, text in self.bytes.items():
            node = 0
            for b in text:
                nxt = self.edges.get(node << 8 | b)
                if nxt is None:
                    nxt = self.edges[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.moves: dict[int, tuple[int, int]] = {}
        if len(self.pairs) > self.most:
            self.pairs.clear()

    def merged(self, text: bytes) -> list[int]:
        """Tokens of a short byte string by applying the merges in order of rank."""
        ids = [self.byte_id[b] for b in text]
        while len(ids) > 1:
            rank, new, k = min((*self.merge.get((ids[j], ids[j + 1]), (1 << 60, -1)), j) for j in range(len(ids) - 1))
            if new < 0:
                break
            ids[k : k + 2] = [new]
        return ids

    def meets(self, left: int, right: int) -> bool:
        """Whether ``right`` stays a token of its own after ``left`` (-1: at the start)."""
        key = (left + 1) << 20 | right
        ok = self.pairs.get(key)
        if ok is None:
            want = [right] if left < 0 else [left, right]
            ok = self.pairs[key] = self.merged(b"".join(self.bytes[i] for i in want)) == want
        return ok

    def move(self, state: int, b: int) -> tuple[int, int]:
        """Build the transition on byte ``b``: next state and emitted-token weight."""
        found, live = None, []
        for node, before, since in self.states[state]:
            nxt = self.edges.get(node << 8 | b)
            if nxt is None:
                continue
            live.append((nxt, before, since))
            token = self.token_at[nxt]
            if found is None and token >= 0 and self.meets(before, token):
                found = (token, since + 1)
        token, weight = found
        to = (*((node, before, since - weight) for node, before, since in live), (0, token, 0))
        sid = self.ids.get(to)
        if sid is None:
            sid = self.ids[to] = len(self.states)
            self.states.append(to)
        out = self.moves[state << 8 | b] = (sid, weight)
        return out

    def count(self, text: bytes) -> int:
        if len(self.states) > self.most:
            self.reset()
        state = n = 0
        moves = self.moves
        for b in text:
            step = moves.get(state << 8 | b)
            if step is None:
                step = self.move(state, b)
                if len(self.states) > self.most * 4:  # one very long word can reach new states for ever
                    keep = self.states[step[0]]
                    self.reset()
                    moves = self.moves
                    sid = self.ids.setdefault(keep, len(self.states))
                    if sid == len(self.states):
                        self.states.append(keep)
                    step = (sid, step[1])
            state, w = step
            n += w
        return n


class Compiled:
    """A tokenizer file compiled for counting. ``count(texts)`` gives the tokens of each text."""

    def __init__(self, path: str, words: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token", "dropout") if model.get(k)]
        if model.get("type") != "BPE" or odd or model.get("ignore_merges") or spec["normalizer"] or split != split | {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}:
            raise ValueError(f"{path}: only byte-level BPE with the usual split can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take their surroundings with them cannot be compiled")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.counter = Counter({t: i for t, i in model["vocab"].items()}, merges)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.classes = _class_table()
        self.known: dict[str, int] = {}
        self.words = words

    def count(self, texts: Sequence[str]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            pieces = self.special.split(t) if self.special else [t]
            totals[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        if not parts:
            return totals
        joined = "\n".join(parts)
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        seps = np.cumsum(lengths + 1)[:-1] - 1
        classes[seps] = END
        cut = split_points(classes)
        if len(cut) == 0:
            return totals
        ends = np.append(cut[1:], len(classes))
        real = classes[cut] != END
        cut, ends = cut[real], ends[real]
        words = [joined[a:b] for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
        counts = np.fromiter(map(self.known.get, words, _NONE), np.int64, len(words))
        for k in np.flatnonzero(counts < 0):
            w = words[k]
            n = self.known.get(w)
            if n is None:
                n = self.counter.count(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(self.known) >= self.words:
                        self.known.clear()
                    self.known[w] = n
            counts[k] = n
        part = np.searchsorted(seps, cut, side="right")
        np.add.at(totals, np.array(owner)[np.unique(part)], np.add.reduceat(counts, np.flatnonzero(np.diff(part, prepend=-1))) if len(part) else 0)
        return totals


class _Minus:
    def __iter__(self):  # noqa: ANN204
        return self

    def __next__(self) -> int:
        return -1


_NONE = _Minus()
_COMPILED: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """The transducers of a tokenizer file, compiled once per worker process."""
    if path not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[path] = Compiled(path)
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, slice_chars: int = 1 << 20) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the tokenizer's own, without begin, end or added special tokens; the strings of
    special tokens inside a text count as that token. Null counts as empty, an empty text has no
    tokens, a text of any length is counted whole; rows are independent, so equal rows get equal
    counts and an empty table gives no rows. Columns other than doc_id and text don't matter.
    One scan, no shuffle; memory is bounded by a batch of texts and the bounded transducer tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = compiled(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            counts, at = [np.zeros(0, np.int64)], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= slice_chars):
                    size += len(texts[end])
                    end += 1
                counts.append(tool.count(texts[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(np.concatenate(counts))], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
