"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1. One scan turns each text into its set of five-word shingles, a digest of the set, MinHash values
   and band keys. Texts with equal sets become one class, named by its smallest doc_id.
2. Classes that share a band key meet in a bucket. Buckets with the same members are kept once. Inside a
   bucket signatures are compared a batch of hashes at a time; a pair leaves as soon as the
   posterior probability that it is similar enough drops below the chosen miss probability.
   What survives ties buckets together to clusters: no link between different clusters can exist.
3. Inside a cluster the full sets are compared. Pairs already known to be connected are skipped,
   and a cluster larger than a block is compared block by block: first inside blocks, then between
   representatives of what is connected so far, then all members outside its largest part
   with every member. No task holds more than two blocks, and no list of pairs is ever made.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, find_words, mix, span_hashes, stage, text_slices, window_hashes

SHINGLE = 5
SIMILARITY = 75  # in per cent
BANDS, ROWS = 32, 4
#: Probability, for each pair and comparison, that a similar pair is pruned.
MISS = 1e-6
BATCH = 32
#: Most members of a bucket that is compared by signature, and of a block that is compared in full.
BLOCK = 256
#: Shingles in a block, so that blocks of long texts have fewer members.
BLOCK_SHINGLES = 400_000
_HASHES = BANDS * ROWS
_SEEDS = np.random.default_rng(5).integers(1, 1 << 32, (2, _HASHES), dtype=np.uint64).astype(np.uint32)
# Word bytes, after A-Z became a-z: all but space and \t \n \v \f \r.
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``size`` words are one shingle."""
    data = _LOWER[data]
    starts, ends, first = find_words(_WORD, data, off)
    words = span_hashes(data, starts, ends)
    runs = window_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    total = lambda salt: int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64))
    return total(0x243F6A8885A308D3), total(0x13198A2E03707344)


def minhashes(sets: Sequence[np.ndarray]) -> np.ndarray:
    """(texts, hashes) smallest permuted shingles; all sets must have members."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), _HASHES), np.uint32)
    for k in range(_HASHES):
        y = x * (_SEEDS[0, k] | np.uint32(1))
        y += _SEEDS[1, k]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, k] = np.minimum.reduceat(y, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    grouped = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
    return h.astype(np.int64)


@lru_cache
def fewest_matches(miss: float = MISS, percent: int = SIMILARITY) -> tuple[int, ...]:
    """Matches that a pair needs after each batch of hashes to stay in.

    Signatures keep 8 bits a hash, so sets of similarity s match at a rate of s + (1 - s) / 256. With a
    uniform prior, the probability that the rate is at least r after k of n matches is that of
    k or fewer successes in n + 1 trials at rate r.
    """
    s = percent / 100
    rate = s + (1 - s) / 256
    out = []
    for n in range(BATCH, _HASHES + 1, BATCH):
        below, k = 0.0, -1
        while below < miss:
            k += 1
            below += math.comb(n + 1, k) * rate**k * (1 - rate) ** (n + 1 - k)
        out.append(k)
    return tuple(out)


def surviving_pairs(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, matches) of the signature pairs that are not pruned, most matches first.

    Without ``right``, pairs i < j of ``left``. Signatures are compared batch by batch.
    """
    if right is None:
        i, j = np.triu_indices(len(left), 1)
        right = left
    else:
        i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    n = np.zeros(len(i), np.int32)
    for batch, need in enumerate(fewest_matches()):
        cols = slice(batch * BATCH, (batch + 1) * BATCH)
        n += (left[i, cols] == right[j, cols]).sum(axis=1, dtype=np.int32)
        stay = n >= need
        i, j, n = i[stay], j[stay], n[stay]
    order = np.argsort(-n, kind="stable")
    return i[order], j[order], n[order]


class Groups:
    """Union of labels; a group is named by its smallest label."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(self.top(x), x) for x in self.up]


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, on sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(a) + len(b) - n)


# ---- step 1 ------------------------------------------------------------------------------------

_PRINTS = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, text = b.column("doc_id"), b.column("text")
        for i, j, data, off in text_slices(text, 1 << 20):
            sets = shingle_sets(data, off)
            full = [k for k, s in enumerate(sets) if len(s)]
            digests = [set_digest(s) for s in sets]
            bands: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            if full:
                sig = minhashes([sets[k] for k in full])
                for k, row, small in zip(full, band_keys(sig), (sig & np.uint32(255)).astype(np.uint8), strict=True):
                    bands[k], sigs[k] = row, small.tobytes()
            cols = [
                ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                pa.array([d[1] for d in digests], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "d1", "d2", "bands", "sig"])


# ---- step 2 ------------------------------------------------------------------------------------

def _bucket_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g = Groups()
        for members in b.column("members").to_pylist():
            ids = [m["node"] for m in members]
            sig = np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(len(ids), _HASHES)
            for x, y in zip(*(p.tolist() for p in surviving_pairs(sig)[:2]), strict=True):
                g.join(ids[x], ids[y])
        e = g.edges()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["src", "dst"])


def cluster_ties(classes: DataFrame) -> DataFrame:
    """(src, dst) edges whose components hold every link: survivors of the signature comparison.

    ``classes``: node, bands, sig. Members of a bucket larger than BLOCK are all tied to its smallest
    one, which loses nothing; their sets are compared in the cluster.
    """
    keyed = classes.select("node", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    ).where("n > 1")
    buckets = buckets.groupBy("n", "least", "most", "x1", "x2").agg(F.min("band").alias("band"))
    found = stage(keyed.join(buckets.select("band", "n", "least"), "band"), "dedup-buckets")
    large = found.where((F.col("n") > BLOCK) & (F.col("node") != F.col("least"))).select(F.col("least").alias("src"), F.col("node").alias("dst"))
    small = found.where(F.col("n") <= BLOCK).select("band", "node").join(classes.select("node", "sig"), "node")
    members = small.groupBy("band").agg(F.collect_list(F.struct("node", "sig")).alias("members"))  # at most BLOCK
    return large.unionByName(members.select("members").mapInArrow(_bucket_ties, "src long, dst long"))


# ---- step 3 ------------------------------------------------------------------------------------

def _sets_of(members: list[dict]) -> tuple[list[dict], list[np.ndarray]]:
    """Members whose text has the digest of their class (an id can have several texts), and their sets."""
    if not members:
        return [], []
    texts = pa.array([m["text"] for m in members], pa.string())
    sets = [s for _, _, data, off in text_slices(texts) for s in shingle_sets(data, off)]
    keep, seen = [], set()
    for k, m in enumerate(members):
        if (m["node"], m["d1"]) not in seen and set_digest(sets[k]) == (m["d1"], m["d2"]):
            seen.add((m["node"], m["d1"]))
            keep.append(k)
    return [members[k] for k in keep], [sets[k] for k in keep]


def _signatures(members: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(m["sig"] for m in members), np.uint8).reshape(len(members), _HASHES)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each row's members (among themselves, or ``others`` with ``members``), as stars."""
    for b in batches:
        g = Groups()
        across = "others" in b.schema.names
        for k in range(b.num_rows):
            members, sets = _sets_of(b.column("members")[k].as_py() or [])
            others, other_sets = _sets_of(b.column("others")[k].as_py() or []) if across else (members, sets)
            if not members or not others:
                continue
            pairs = surviving_pairs(_signatures(others), _signatures(members) if across else None)
            for x, y in zip(*(p.tolist() for p in pairs[:2]), strict=True):
                a, c = others[x]["label"], members[y]["label"]
                if g.top(a) != g.top(c) and similar(other_sets[x], sets[y]):
                    g.join(a, c)
        e = g.edges()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], ["src", "dst"])


_MEMBER = ("node", "label", "d1", "d2", "sig", "text")


def _blocks(members: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """Deal the members of each ``by`` into hash blocks of bounded count and size: adds blocks, block."""
    size = members.groupBy(*by).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    d = members.join(size, list(by))
    return d.withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int"))


def _inside(members: DataFrame) -> DataFrame:
    """Confirmed (src, dst) between labels inside each block."""
    rows = members.groupBy("cluster", "block").agg(F.collect_list(F.struct(*_MEMBER)).alias("members"))
    return rows.where(F.size("members") > 1).select("members").mapInArrow(_verify, "src long, dst long")


def _relabel(members: DataFrame, tops: DataFrame, name: str) -> DataFrame:
    """Members with ``tops`` (label, _to) applied."""
    return stage(members.join(tops, "label", "left").withColumn("label", F.coalesce("_to", "label")).drop("_to"), name)


def _stars(links: DataFrame) -> DataFrame:
    """Links found inside blocks that share no label are stars, so they name each label's part as they are."""
    return links.where("src <> dst").select(F.col("dst").alias("label"), F.col("src").alias("_to"))


def _large_clusters(m: DataFrame) -> DataFrame:
    """(node, label) of the members of clusters of several blocks, whose blocks have been compared inside."""
    before = None
    for seed in itertools.count(1):
        # one member for each connected part; parts merge through them without comparing their members
        parts = m.groupBy("cluster").agg(F.count_distinct("label").alias("k")).where("k > 1")
        now = parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("all"), F.coalesce(F.max("k"), F.lit(0)).alias("most")).first()
        if now["all"] == 0:
            return m.select("node", "label")
        # another round pays while it merges a quarter of the parts; what is left apart is compared below
        if before is not None and (before["most"] <= BLOCK or 4 * now["all"] > 3 * before["all"]):
            break
        before = now
        drawn = F.struct(F.xxhash64("node", F.lit(seed)).alias("u"), "node", "d1", "d2")
        first = m.groupBy("cluster", "label").agg(F.min(drawn).alias("_f"))
        pick = m.join(first, ["cluster", "label"]).where("node = _f.node and d1 = _f.d1 and d2 = _f.d2").drop("_f", "blocks", "block")
        links = stage(_inside(_blocks(pick, ["cluster"], seed)), "dedup-links")
        m = _relabel(m, _stars(links), "dedup-part")
    # every pair of different labels has a member outside the largest part of its cluster
    parts = m.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("_m"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select("cluster", F.col("_m.label").alias("main"))
    open_ = m.drop("blocks", "block").join(main, "cluster")
    all_ = _blocks(open_, ["cluster"], 0)
    outside = _blocks(open_.where("label <> main"), ["cluster"], 1)
    grid = all_.groupBy("cluster").agg(F.max("blocks").alias("nj")).join(outside.groupBy("cluster").agg(F.max("blocks").alias("ni")), "cluster")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    nothing = F.lit(None).cast(all_.select(F.struct(*_MEMBER).alias("m")).schema["m"].dataType)
    left = outside.join(grid, "cluster").withColumn("j", each("nj")).select("cluster", F.col("block").alias("i"), "j", F.struct(*_MEMBER).alias("o"), nothing.alias("x"))
    right = all_.join(grid, "cluster").withColumn("i", each("ni")).select("cluster", "i", F.col("block").alias("j"), nothing.alias("o"), F.struct(*_MEMBER).alias("x"))
    rows = left.unionByName(right).groupBy("cluster", "i", "j").agg(F.collect_list("o").alias("others"), F.collect_list("x").alias("members"))
    links = rows.select("others", "members").mapInArrow(_verify, "src long, dst long")
    tops = connected(links, "dedup-cross").select(F.col("node").alias("label"), F.col("component").alias("_to"))
    return _relabel(m.select("node", "label"), tops, "dedup-part")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is it).

    A document's set holds its distinct runs of five words (A-Z lower-cased, split at blanks), or all
    its words as one if there are fewer. Two documents are linked if their sets share at least
    75 % of their union. Null and empty texts have no set and stay alone. Rows of one doc_id are one
    document: copies have equal results, different texts under one id bring their links together. Rows without
    a doc_id take no part in links; they get the component of an equal text, else null, and are kept in
    that case. An empty table gives no rows.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = stage(text.mapInArrow(_fingerprints, _PRINTS), "dedup-prints")
    named = prints.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    named = stage(named, "dedup-classes")
    reps = prints.withColumnRenamed("doc_id", "node").join(named, ["node", "d1", "d2"], "left_semi").dropDuplicates(["node", "d1", "d2"])
    reps = stage(reps, "dedup-reps")

    clusters = connected(cluster_ties(reps), "dedup-ties").withColumnRenamed("component", "cluster")
    members = reps.select("node", "d1", "d2", "sig", "n_shingles").join(clusters, "node").withColumn("label", F.col("node"))
    members = stage(_blocks(members, ["cluster"], 0), "dedup-members")
    full = stage(members.join(text.withColumnRenamed("doc_id", "node"), "node"), "dedup-texts")
    links = stage(_inside(full), "dedup-links")
    labels = _stars(links).select(F.col("label").alias("node"), F.col("_to").alias("label"))
    if members.where("blocks > 1").head(1):
        large = _large_clusters(_relabel(full.where("blocks > 1"), _stars(links), "dedup-part")).select("node", "label")
        labels = labels.unionByName(large)
    labels = labels.groupBy("node").agg(F.min("label").alias("label"))

    named = named.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component_id"))
    out = prints.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the kept one of its group, each row once.

    Rows equal in doc_id and text are copies, of which one stays.
    """
    gone = stage(components(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct(), "dedup-gone")
    cols = docs.columns
    d = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)], F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"))
    d = d.join(gone, d["_id"].cast("long") == gone["_gone"], "left_anti").dropDuplicates(["_id", "_t"])
    return d.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(cols)])
