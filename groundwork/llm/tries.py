"""The prefix trie of conversations, from double-array tries over shards of the sorted conversations.

Turns become fixed-width records, conversations runs of records, cut at every ``CHUNK`` turns so that none is
one large value. The runs are sorted over the cluster by what they say. A shard is a slice of that order:
conversations that begin alike lie together, and a hot beginning, or a group of copies, simply takes
several shards. Each shard packs a double-array trie over its own dense turn ids and walks its conversations
through BASE and CHECK to aggregate the nodes.

In a sorted order the members of a node are neighbours. So only nodes on the path of a shard's first or last
conversation can have members elsewhere: all others are complete, and final. What is left, the upper
nodes and a path along every boundary, is merged globally, and sums over their subtrees are
taken by doubling: each round every node passes its sum to an ancestor twice as far up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, stage

RECORD = 20  # bytes of a turn: 16 of its digest, 4 of its code points
CHUNK = 64  # turns after which a conversation is cut
SHARD_TURNS = 1 << 17
GROUP, SHARED = 100, 6  # an opening is shared inside a hundred conversations, up to five turns of it
FINAL, PENDING, OPEN, ENDS = range(4)
_SCHEMA = (
    "kind int, h1 long, h2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved long, code_points long, ends string"
)
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_NONE = np.iinfo(np.int64).max
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- turns to runs of records ------------------------------------------------------------------

def _pieces(turns: DataFrame) -> DataFrame:
    """Runs of turns in order: conv_id, place of the first turn, records.

    All turns are sorted over the cluster by conversation, so that a hot one is cut like the others; only
    what a conversation has in earlier partitions must be added to the places counted in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            digest = b.column("digest").cast(pa.binary(16))
            records = np.empty((len(conv), RECORD), np.uint8)
            records[:, :16] = np.frombuffer(digest.buffers()[1], np.uint8)[16 * digest.offset :][: 16 * len(conv)].reshape(-1, 16)
            records[:, 16:] = b.column("size").to_numpy().astype("<i4").view(np.uint8).reshape(-1, 4)
            cuts = np.r_[0, np.flatnonzero(np.diff(conv)) + 1, len(conv)]
            place = np.zeros(len(cuts) - 1, np.int64)
            place[0] = seen if conv[0] == last else 0
            last, seen = conv[-1], int(place[-1] + cuts[-1] - cuts[-2])
            runs = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((RECORD * cuts).astype(np.int32)), pa.py_buffer(records.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(conv[cuts[:-1]]), pa.array(np.full(len(place), part, np.int32)), pa.array(place), runs], ["conv_id", "part", "place", "turns"])

    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("int").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "row")
    found = stage(rows.mapInArrow(run, "conv_id long, part int, place long, turns binary"), "trie-pieces")
    sizes = found.groupBy("conv_id", "part").agg((F.sum(F.octet_length("turns")) / RECORD).cast("long").alias("n"))
    several = sizes.groupBy("conv_id").agg(F.collect_list(F.struct("part", "n")).alias("parts")).where(F.size("parts") > 1)  # one row a partition at most
    several = several.select("conv_id", F.explode("parts").alias("p"), "parts").select(
        "conv_id", F.col("p.part").alias("part"),
        F.aggregate(F.filter("parts", lambda x: x["part"] < F.col("p.part")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("before"),
    )
    placed = found.join(several, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "turns")


def _bytes(c: str | Column, first: Column, n: Column) -> Column:
    """``n`` records of a run from record ``first`` on."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring(c, (first * RECORD + 1).cast("int"), (F.greatest(n, F.lit(0)) * RECORD).cast("int"))


def _joined(parts: Column) -> Column:
    """The records of (place, turns) parts, by place."""
    return F.aggregate(F.array_sort(parts), F.lit(b""), lambda a, x: F.concat(a, x["turns"]))


def share_openings(pieces: DataFrame, group: int = GROUP, shared: int = SHARED) -> DataFrame:
    """Rebuild every conversation c: the first h turns of c - c % ``group``, then its own after its first h.

    h is crc32 of the decimal c, modulo ``shared``. A group has at most ``group`` conversations, so no opening is hot.
    """
    c, n = F.col("conv_id"), (F.octet_length("turns") / RECORD).cast("long")
    most = F.lit(shared - 1).cast("long")
    heads = pieces.where((c % group == 0) & (F.col("place") < most)).select(c.alias("base"), "place", _bytes("turns", F.lit(0), most).alias("turns"))
    heads = heads.groupBy("base").agg(_bytes(_joined(F.collect_list(F.struct("place", "turns"))), F.lit(0), most).alias("head"))
    d = pieces.withColumn("base", c - c % group).join(heads, "base", "left")
    d = d.withColumn("h", F.crc32(c.cast("string").cast("binary")) % shared).withColumn("n", n)
    d = d.withColumn("given", F.least("h", F.coalesce(F.octet_length("head") / RECORD, F.lit(0)).cast("long")))
    skip = F.greatest(F.col("h") - F.col("place"), F.lit(0))
    own = _bytes("turns", skip, F.col("n") - skip)
    opening = F.when(F.col("given") > 0, _bytes("head", F.lit(0), F.col("given"))).otherwise(F.lit(b""))
    begins = F.col("place") == 0
    place = F.when(begins, F.lit(0)).otherwise(F.greatest("place", "h") - F.col("h") + F.col("given")).cast("long")
    d = d.select(c, place.alias("place"), F.when(begins, F.concat(opening, own)).otherwise(own).alias("turns"))
    return d.where((F.col("place") == 0) | (F.octet_length("turns") > 0))


# ---- runs to chunks with a known beginning -----------------------------------------------------

def _turn_hashes(digests: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of every (place, turn); a node's identity is their sums from the root on."""
    a, b = digests[:, 0], digests[:, 1]
    p = place.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(a + mix(b + p * np.uint64(0x9E3779B97F4A7C15))), mix(b ^ mix(a + p * np.uint64(0xC2B2AE3D27D4EB4F)))


def _digests(turns: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn counts of runs, the two halves of every digest, and code points."""
    ends = np.frombuffer(turns.buffers()[1], np.int32)[turns.offset : turns.offset + len(turns) + 1]
    data = turns.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    records = raw.reshape(-1, RECORD)
    return np.diff(ends) // RECORD, np.ascontiguousarray(records[:, :16]).view("<u8"), np.ascontiguousarray(records[:, 16:]).view("<i4").ravel().astype(np.int64)


def _chunks(runs: DataFrame) -> DataFrame:
    """Chunks of at most CHUNK turns: conv_id, chunk, sums of the turns before (_0.._3), whether it is the last."""
    place, n = F.col("place"), (F.octet_length("turns") / RECORD).cast("long")
    first = (place / CHUNK).cast("long")
    d = runs.withColumn("n", n).withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, ((place + n - 1) / CHUNK).cast("long")))))
    begin = F.greatest(F.col("chunk") * CHUNK, place)
    d = d.select("conv_id", "chunk", begin.alias("place"), _bytes("turns", begin - place, F.least((F.col("chunk") + 1) * CHUNK, place + F.col("n")) - begin).alias("turns"))
    d = stage(d.groupBy("conv_id", "chunk").agg(_joined(F.collect_list(F.struct("place", "turns"))).alias("turns")), "trie-chunks")
    sums = [F.lit(0).cast("long").alias(f"_{k}") for k in range(4)]
    later = d.where("chunk > 0")
    if not later.head(1):
        return d.select("*", *sums, F.lit(True).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, _ = _digests(b.column("turns"))
            chunk = b.column("chunk").to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            begins = np.cumsum(sizes) - sizes
            lanes = _turn_hashes(digests, np.arange(len(row)) - begins[row] + chunk[row] * CHUNK)
            out = []
            for lane in lanes:
                total = np.r_[np.uint64(0), np.cumsum(lane)]
                total = total[begins + sizes] - total[begins]
                out += [(total & np.uint64(0xFFFFFFFF)).astype(np.int64), (total >> np.uint64(32)).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("chunk"), *map(pa.array, out)], ["conv_id", "chunk", "_0", "_1", "_2", "_3"])

    long_ones = later.groupBy("conv_id").agg(F.max("chunk").alias("of"))
    mine = d.join(long_ones, "conv_id")
    parts = mine.select("conv_id", "chunk", "turns").mapInArrow(run, "conv_id long, chunk long, _0 long, _1 long, _2 long, _3 long")
    before = "sum({0}) over (partition by conv_id order by chunk rows between unbounded preceding and 1 preceding)"  # one row in CHUNK turns
    entry = parts.select("conv_id", "chunk", *[F.coalesce(F.expr(before.format(f"_{k}")), F.lit(0)).alias(f"_{k}") for k in range(4)])
    mine = mine.join(entry, ["conv_id", "chunk"]).select("conv_id", "chunk", "turns", "_0", "_1", "_2", "_3", (F.col("chunk") == F.col("of")).alias("last"))
    return mine.unionByName(d.join(long_ones, "conv_id", "left_anti").select("*", *sums, F.lit(True).alias("last")))


# ---- the double array --------------------------------------------------------------------------

class DoubleArray:
    """BASE and CHECK over dense symbols: the child of slot s by symbol c is slot BASE[s] + c, if CHECK of it is s."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        """``symbols``: the words one after the other, sorted so that words with one prefix are neighbours; ``sizes``: their lengths."""
        begins = np.cumsum(sizes) - sizes
        node = np.zeros(len(sizes), np.int64)  # the node each word has reached, by number; 0 is the root
        parents, labels, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
        for level in range(int(sizes.max(initial=0))):
            live = np.flatnonzero(sizes > level)
            c = symbols[begins[live] + level]
            new = np.ones(len(live), bool)
            new[1:] = (node[live][1:] != node[live][:-1]) | (c[1:] != c[:-1])
            parents.append(node[live][new])
            labels.append(c[new])
            node[live] = count + np.cumsum(new) - 1
            count += int(new.sum())
        self._pack(np.concatenate(parents), np.concatenate(labels), count)

    def _pack(self, parent: np.ndarray, label: np.ndarray, count: int) -> None:
        """Place families of several children by next fit, single children in the gaps."""
        first = np.flatnonzero(np.diff(parent, prepend=-1))  # children of one node are neighbours
        family = np.diff(np.r_[first, len(parent)])
        room = 2 * count + int(label.max(initial=0)) + 2
        used = np.zeros(room, bool)
        used[0] = True  # the root
        base, at = np.zeros(count, np.int64), 1
        several = np.flatnonzero(family > 1)
        for f in several[np.argsort(-family[several], kind="stable")].tolist():
            kids = np.sort(label[first[f] : first[f] + family[f]])
            kids, least = kids - kids[0], int(kids[0])
            step = max(16, (1 << 16) // len(kids))
            while True:
                if at + step + kids[-1] >= len(used):
                    used = np.r_[used, np.zeros(len(used) + step + int(kids[-1]), bool)]
                free = at + np.flatnonzero(~used[at : at + step])
                fits = free[~used[free[:, None] + kids].any(axis=1)] if len(free) else free
                if len(fits):
                    break
                at += step
            at = int(fits[0])
            used[at + kids] = True
            base[parent[first[f]]] = at - least
        single = first[family == 1]
        if len(used) < count + 1 + int(used.sum()):
            used = np.r_[used, np.zeros(count + 1, bool)]
        base[parent[single]] = np.flatnonzero(~used)[: len(single)] - label[single]
        slot = np.zeros(count, np.int64)
        slot[1:] = base[parent] + label
        size = int(slot.max(initial=0)) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]

    def step(self, slots: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The child of every slot by its symbol, -1 where there is none."""
        to = self.base[slots] + symbols
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct rows of the columns, by first occurrence."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    seen, first = np.unique(group, return_index=True)
    number = np.empty(len(seen), np.int64)
    number[np.argsort(first)] = np.arange(len(seen))
    return number[group]


def _shard(b: pa.RecordBatch) -> pa.RecordBatch:
    """Node rows of one shard: complete nodes, partial sums of open ones, and the conversations that end at these."""
    conv, chunk, last = b.column("conv_id").to_numpy(), b.column("chunk").to_numpy(), b.column("last").to_numpy(zero_copy_only=False)
    sizes, digests, code_points = _digests(b.column("turns"))
    parts = [b.column(f"_{k}").to_numpy().astype(np.uint64) for k in range(4)]
    rows, row = len(conv), np.repeat(np.arange(len(conv)), sizes)
    begins = np.cumsum(sizes) - sizes
    within = np.arange(len(row)) - begins[row]
    # identities: sums of turn hashes from the root
    lanes = _turn_hashes(digests, within + chunk[row] * CHUNK)
    entry = [parts[2 * k] + (parts[2 * k + 1] << np.uint64(32)) for k in (0, 1)]
    sums = []
    for lane, start in zip(lanes, entry, strict=True):
        total = np.r_[np.uint64(0), np.cumsum(lane)]
        sums.append((total[1:] - total[begins[row]] + start[row]).view(np.int64))
    # words: where the chunk begins, then its turns
    starts = _dense(chunk, *entry)
    symbols = np.empty(rows + len(row), np.int64)
    heads = begins + np.arange(rows)
    body = np.ones(len(symbols), bool)
    body[heads] = False
    symbols[heads] = starts
    symbols[body] = _dense(digests[:, 0], digests[:, 1]) + (starts.max(initial=-1) + 1)
    trie = DoubleArray(symbols, sizes + 1)
    # walk all conversations through it
    m = len(trie.check)
    n, least, depth, size = np.zeros(m, np.int64), np.full(m, _NONE), np.zeros(m, np.int64), np.zeros(m, np.int64)
    ids = np.zeros((2, m), np.int64)
    kept_open = np.zeros(m, bool)
    slots, levels = np.zeros(rows, np.int64), []
    for level in range(int(sizes.max(initial=0)) + 1):
        live = np.flatnonzero(sizes >= level)
        at = trie.step(slots[live], symbols[heads[live] + level])
        slots[live] = at
        n += np.bincount(at, minlength=m)
        np.minimum.at(least, at, conv[live])
        depth[at] = chunk[live] * CHUNK + level
        if level:
            turn = begins[live] + level - 1
            size[at], ids[0, at], ids[1, at] = code_points[turn], sums[0][turn], sums[1][turn]
            kept_open[at[(live == 0) | (live == rows - 1)]] = True
        else:
            ids[0, at], ids[1, at] = entry[0].view(np.int64)[live], entry[1].view(np.int64)[live]
            kept_open[at] = True
        levels.append(np.unique(at))
    # conversations that go on in another chunk
    goes_on = np.zeros(m, bool)
    goes_on[slots[~last]] = True
    ends_on = goes_on.copy()
    for at in levels[:0:-1]:
        np.logical_or.at(goes_on, trie.check[at], goes_on[at])
    kept_open |= goes_on & (n > 1)
    # sums over subtrees, from the leaves up; an open node adds up its complete children only
    children, leaves, saved = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for at in levels[:0:-1]:
        done = at[~kept_open[at]]
        children[done] += ends_on[done]  # alone, it goes on along one path
        leaves[done] += (leaves[done] == 0).astype(np.int64)
        saved[done] += (n[done] - 1) * size[done]
        up = trie.check[done]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[done])
        np.add.at(saved, up, saved[done])
    # rows
    ends = np.full(m, None, object)
    blocks: list[tuple[int, int, str]] = []
    ending = np.flatnonzero(last)
    cuts = np.r_[np.flatnonzero(np.diff(slots[ending], prepend=-1)), len(ending)]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at, text = slots[ending[i]], ",".join(map(str, conv[ending[i:j]].tolist()))
        if kept_open[at]:
            blocks.append((int(at), int(conv[ending[i]]), text))
        else:
            ends[at] = hashlib.sha256(text.encode()).hexdigest()
    nodes = np.concatenate(levels) if levels else np.zeros(0, np.int64)
    is_open, top = kept_open[nodes], depth[nodes] == 0
    parent = trie.check[nodes]
    entered = np.zeros(m, bool)
    entered[levels[0]] = True  # shards further up count the members of these, but for the root
    entered = entered[nodes] & ~top
    kind = np.where(is_open, OPEN, np.where(kept_open[parent], PENDING, FINAL))
    no_parent = top | entered
    columns = {
        "kind": pa.array(kind, pa.int32()), "h1": pa.array(ids[0, nodes]), "h2": pa.array(ids[1, nodes]),
        "p1": pa.array(ids[0, parent], mask=no_parent), "p2": pa.array(ids[1, parent], mask=no_parent),
        "conv_id": pa.array(least[nodes], mask=entered), "depth": pa.array(depth[nodes]), "parent_conv_id": pa.array(least[parent], mask=kind != FINAL),
        "n_convs": pa.array(np.where(entered, 0, n[nodes])), "n_children": pa.array(children[nodes]), "n_leaves": pa.array(leaves[nodes]),
        "saved": pa.array(saved[nodes]), "code_points": pa.array(size[nodes]), "ends": pa.array(ends[nodes], pa.string()),
    }
    out = pa.RecordBatch.from_arrays([columns[c] for c in _NAMES], _NAMES)
    if not blocks:
        return out
    at = np.array([x[0] for x in blocks])
    given = {"kind": np.full(len(at), ENDS, np.int32), "h1": ids[0, at], "h2": ids[1, at], "conv_id": np.array([x[1] for x in blocks]), "ends": [x[2] for x in blocks]}
    more = pa.RecordBatch.from_arrays([pa.array(given[c], f.type) if c in given else pa.nulls(len(at), f.type) for c, f in zip(_NAMES, out.schema, strict=True)], schema=out.schema)
    return pa.Table.from_batches([out, more]).combine_chunks().to_batches()[0]


def _shards(chunks: DataFrame, shard_turns: int) -> DataFrame:
    """Node rows of all shards, each a slice of the order of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = b.column("turns")
            ends = np.frombuffer(turns.buffers()[1], np.int32)[turns.offset : turns.offset + len(turns) + 1] // RECORD if b.num_rows else np.zeros(1, np.int64)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + shard_turns, side="right")) - 1)
                yield _shard(b.slice(i, j - i))
                i = j

    order = ["chunk", "_0", "_1", "_2", "_3", "turns", "conv_id"]
    return chunks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _SCHEMA)


# ---- the open nodes ----------------------------------------------------------------------------

def _end_digests(blocks: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at every open node: blocks of ids, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], ["h1", "h2", "ends"])

        for b in batches:
            for h1, h2, text in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "ends")), strict=True):
                if (h1, h2) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        yield out()
                    node, state = (h1, h2), hashlib.sha256()
                state.update(text.encode())
        if node is not None:
            yield out()

    rows = blocks.select("h1", "h2", "conv_id", "ends").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "conv_id")
    return rows.mapInArrow(run, "h1 long, h2 long, ends string")


def _open_nodes(parts: DataFrame) -> DataFrame:
    """Open nodes merged over all shards, with the sums over their whole subtrees."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    up = F.max(F.when(F.col("p1").isNotNull(), F.struct("p1", "p2"))).alias("p")
    d = parts.groupBy("h1", "h2").agg(*sums, F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("code_points").alias("size"), up)
    d = stage(d.where("n_convs > 0").select("*", "p.p1", "p.p2").drop("p"), "trie-open")  # others are complete further up
    kids = d.where("p1 is not null").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("kids"))
    d = d.join(kids, ["h1", "h2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    d = d.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size"))
    d = stage(d, "trie-open-sums")
    far = d.select("h1", "h2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), "n_leaves", "saved")
    while far.where("a1 is not null").head(1):
        add = far.where("a1 is not null").groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        above = far.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        far = far.join(add, ["h1", "h2"], "left").join(above, ["a1", "a2"], "left").select(
            "h1", "h2", F.col("b1").alias("a1"), F.col("b2").alias("a2"),
            (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
        )
        far = stage(far, "trie-far")
    return d.drop("n_leaves", "saved", "size").join(far.drop("a1", "a2"), ["h1", "h2"])


def prefix_trie(runs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, place, turns) runs; see ``conversation_trie``."""
    rows = stage(_shards(_chunks(runs), shard_turns), "trie-nodes")
    merged = stage(_open_nodes(rows.where(F.col("kind") == OPEN)), "trie-open-done")
    above = merged.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("_above"))
    ends = _end_digests(rows.where(F.col("kind") == ENDS))
    saved = F.col("saved").alias("saved_tokens")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends_sha256")]
    # a node above that is complete has one conversation, the one that goes on here
    parent = F.when(F.col("depth") > 0, F.coalesce("_above", "conv_id")).alias("parent_conv_id")
    final = rows.where(F.col("kind") == FINAL).select(*names)
    pending = rows.where(F.col("kind") == PENDING).drop("parent_conv_id").join(above, ["p1", "p2"], "left").withColumn("parent_conv_id", parent).select(*names)
    opened = merged.join(ends, ["h1", "h2"], "left").join(above, ["p1", "p2"], "left").withColumn("parent_conv_id", parent).select(*names)
    return final.unionByName(pending).unionByName(opened)


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations of (conv_id, turn, role, text), the root first.

    Per node: conv_id (smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. Sums are over whole subtrees, the node included.

    Turns are ordered by turn, null first, equal turns by the digest of what they say, so repeated rows stay as
    repeated turns. A null role or text is the empty one. Rows with a null conv_id belong to no
    conversation and have no part in it. A conversation may have any number of turns, and any number of
    conversations may be alike. Without conversations there are no nodes, not even the root. Other columns don't matter.

    Turns are told apart by 128-bit digests, nodes by two 64-bit sums. Per turn 20 bytes are sorted twice; the texts
    themselves are never shuffled.
    """
    return prefix_trie(share_openings(_pieces(turns)), shard_turns)
