"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point. A run of three letters is
bound into one vector: the first letter's vector permuted twice, times the second's permuted once,
times the third's. A text is the bundle (sum) of its runs, a language the bundle of its training
texts, and a text belongs to the language with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mix
from .tokens import ELL, _class_table

DIM = 1024
UNKNOWN = "und"
#: Most languages that can be learned; each is DIM numbers on the driver and in every task.
MOST_LANGUAGES = 2000
SLICE_CHARS = 1 << 18
_STATE: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _STATE:
        _STATE["letters"] = _class_table() <= ELL
    return _STATE["letters"]


def letter_vectors(points: np.ndarray, dim: int = DIM) -> np.ndarray:
    """(letters, dim) of +1 and -1, the same for a code point everywhere."""
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (bits.astype(np.int8) << 1) - 1


def bind(grams: np.ndarray, dim: int = DIM) -> np.ndarray:
    """(runs, dim) vectors of runs of three code points; the permutation is a shift by one place."""
    points, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    v = letter_vectors(points, dim)
    return np.roll(v, 2, axis=1)[at[:, 0]] * np.roll(v, 1, axis=1)[at[:, 1]] * v[at[:, 2]]


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs around each letter: (distinct runs as code points, run index per letter, text per letter).

    Letters are lower-cased; anything else is one blank (0), also before and after a text. Each
    letter gives the run of its neighbours and itself.
    """
    joined = "\n".join(["", *(t.lower() for t in texts), ""])
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[c]
    mid = np.flatnonzero(letter)
    owner = np.searchsorted(np.cumsum(lengths + 1) + 1, mid, side="right")
    c = np.where(letter, c, 0)
    if len(mid) == 0:
        return np.zeros((0, 3), np.int64), mid, owner
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    points = np.flatnonzero(seen)
    small = np.zeros(0x110000, np.int64)
    small[points] = np.arange(len(points))
    a, s = len(points), small[c]
    key = (s[mid - 1] * a + s[mid]) * a + s[mid + 1]
    if a**3 <= 1 << 23:
        there = np.zeros(a**3, bool)
        there[key] = True
        keys = np.flatnonzero(there)
        place = np.zeros(a**3, np.int64)
        place[keys] = np.arange(len(keys))
        at = place[key]
    else:
        keys, at = np.unique(key, return_inverse=True)
    return np.stack([points[keys // (a * a)], points[keys // a % a], points[keys % a]], axis=1), at, owner


def _slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    i = size = 0
    for k, t in enumerate(texts):
        if k > i and size + len(t) > limit:
            yield i, k
            i, size = k, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)


def bundle(texts: list[str], groups: np.ndarray, n: int) -> np.ndarray:
    """(n, DIM) bundles of the runs of all texts of each group (-1: none)."""
    grams, at, owner = runs_of(texts)
    out = np.zeros((n, DIM), np.float32)
    g = groups[owner] if len(owner) else owner
    at, g = at[g >= 0], g[g >= 0]
    # runs in pieces, so that memory stays small with large alphabets
    for k in range(0, len(grams), 8192):
        here = (at >= k) & (at < k + 8192) if len(grams) > 8192 else slice(None)
        size = min(8192, len(grams) - k)
        counts = np.bincount(g[here] * size + at[here] - k, minlength=n * size).reshape(n, size)
        out += counts.astype(np.float32) @ bind(grams[k : k + size]).astype(np.float32)
    return out


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit profiles, from all rows with a language outside the held-out fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs = b.column("lang").to_pylist()
            for i, j in _slices(texts, 4 * SLICE_CHARS):
                names = sorted(set(langs[i:j]))
                index = {x: k for k, x in enumerate(names)}
                v = bundle(texts[i:j], np.array([index[x] for x in langs[i:j]]), len(names))
                for k, x in enumerate(names):
                    sums[x] = sums[x] + v[k] if x in sums else v[k].astype(np.float64)
        for x, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([v.astype(np.int64)], pa.list_(pa.int64()))], ["lang", "profile"])

    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    parts = rows.mapInArrow(run, "lang string, profile array<long>")
    sums = parts.select("lang", F.posexplode("profile").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    got = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).limit(MOST_LANGUAGES + 1).collect()  # DIM entries a row
    if len(got) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    got = sorted(((r["lang"], np.array([x["v"] for x in r["p"]], np.float64)) for r in got), key=lambda x: x[0])
    got = [(x, v / np.linalg.norm(v)) for x, v in got if v.any()]
    return [x for x, _ in got], np.array([v for _, v in got], np.float32).reshape(len(got), DIM)


def predict(texts: list[str], names: list[str], profiles: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Nearest language and cosine of each text; UNKNOWN and 0 without letters or languages."""
    v = bundle(texts, np.arange(len(texts)), len(texts))
    norm = np.linalg.norm(v, axis=1)
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    cos = (v @ profiles.T) / np.maximum(norm, 1e-9)[:, None]
    best = cos.argmax(axis=1)
    known = norm > 0
    score = np.where(known, np.clip(cos[np.arange(len(texts)), best], 0, 1), 0.0)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)], score.astype(np.float64)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (cosine, 0 to 1) of every whole text.

    Profiles are learned from text and lang of the rows outside the held-out fold; a prediction reads the
    text alone. Null, empty and letterless texts are ``und`` with score 0, as is every text if no
    language could be learned. Between equal cosines the first language by name wins. Equal texts get
    equal results; an empty table gives no rows; other columns don't matter. Two scans, no shuffle of texts.
    """
    names, profiles = learn(docs.select("doc_id", "lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            langs: list[str] = []
            scores = [np.zeros(0)]
            for i, j in _slices(texts):
                x, s = predict(texts[i:j], names, profiles)
                langs += x
                scores.append(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
