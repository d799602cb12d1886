"""A lexical index kept as tables: written by ingest, segment after segment, and searched without the texts.

An index is a folder of Parquet tables, each with a part per segment. Passages of a tenant and access list lie in
shards of bounded size; inside a shard they are numbered in the order of their ids.

* ``postings``: one row per shard and term with the numbers of the passages and their counts as packed
  bytes (see ``narrow``), how many and what they sum up to, and what bounds the scores in it, the highest count and the
  shortest passage. Without a term, one row per shard with the ids and lengths of its passages;
* ``passages``: shard, number, id and length of every passage;
* ``terms`` and ``lengths``: how many passages hold a term, how many there are and how long, as
  differences: a segment that takes passages away writes negative numbers, so sums are always those of the live rows;
* ``gone``: passages of earlier segments that this one takes away.

``lengths`` is written last and tells which segments are complete; a segment that failed half way is not seen and
is overwritten by the next try.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut_lineage, release, written
from .retrieval import B, K1, access_key
from .skew import per_key, shuffled, top_k

BUCKETS = 16
SHARD_PASSAGES = 8192
PIECE = 256  # passages that a task has of an access list on average, from which on shards are filled where the passages are
HELD = 64 << 20  # bytes of passages that a task holds while it fills shards
TASKS = 20  # bits of a task's number in the number of a shard
QUESTIONS = 32768  # questions of a block
TERMS = 1 << 22  # terms of the questions of a block, on average
TOGETHER = 8  # shards that a task scores, on average
ASKED = 500_000  # different terms of the questions that are sent to the postings, at most
SHARD = ["segment", "tenant", "acl_key", "part"]
_TERM_BYTES = np.full(256, 32, np.uint8)
_TERM_BYTES[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
SCHEMAS = {
    "lengths": "tenant string, acl_key string, acl array<string>, n long, dl long, segment int",
    "terms": "tenant string, acl_key string, term string, df long, segment int, bucket int",
    "postings": "tenant string, acl_key string, part int, term string, n int, cf long, ats binary, tfs binary, max_tf int, min_dl long, segment int",
}


def last_segment(spark: SparkSession, path: str) -> int:
    """Number of the last complete segment, -1 for a folder without any."""
    try:
        return _read(spark, path, "lengths", 2**31 - 1).agg(F.coalesce(F.max("segment"), F.lit(-1))).first()[0]
    except AnalysisException:
        return -1


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _lines(passages: DataFrame) -> DataFrame:
    """(tenant, passage_id, acl, acl_key, terms) of passages, the terms as lower-cased text; a null access list has no labels."""
    acl = F.coalesce("acl", F.array().cast("array<string>"))
    return passages.select("tenant", "passage_id", acl.alias("acl"), access_key(acl).alias("acl_key"), F.lower("text").alias("terms"))


def split_terms(lines: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many terms, runs of a-z and 0-9, every line has, and all of them one after the other."""
    at = lines.buffers()
    if len(lines) == lines.null_count or at[2] is None:
        return np.zeros(len(lines), np.int64), pa.array([], pa.string()).dictionary_encode()
    blank = pa.py_buffer(_TERM_BYTES[np.frombuffer(at[2], np.uint8)])  # other bytes, those of other alphabets too, are blanks
    parts = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(lines), at[1], blank, at[0], lines.null_count, lines.offset))
    coded = parts.flatten().dictionary_encode()
    whole = np.flatnonzero(pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False))
    line = np.repeat(np.arange(len(lines)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy())
    code = coded.indices.to_numpy()
    if len(whole) < len(coded.dictionary):  # a line that starts or ends with a blank has an empty part
        place = np.full(len(coded.dictionary), -1)
        place[whole] = np.arange(len(whole))
        code = place[code]
        line, code = line[code >= 0], code[code >= 0]
    return np.bincount(line, minlength=len(lines)), pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), coded.dictionary.take(pa.array(whole)))


def narrow(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Lists of numbers from 0 on as bytes: each in the smallest of 1, 2 and 4 bytes a number that holds its largest."""
    if not len(cuts):
        return pa.array([], pa.binary())
    top = np.maximum.reduceat(x, cuts)
    width = np.where(top < 256, 1, np.where(top < 65536, 2, 4))
    size = np.diff(np.r_[cuts, len(x)])
    ends = np.cumsum(width * size)
    out, each = np.zeros(ends[-1], np.uint8), np.repeat(width, size)
    to = np.repeat(ends - width * size, size) + (np.arange(len(x)) - np.repeat(cuts, size)) * each
    for k in range(4):
        put = each > k
        if not put.any():
            break
        out[to[put] + k] = (x[put] >> (8 * k)) & 255
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(out)])


def widen(packed: pa.Array, n: np.ndarray) -> np.ndarray:
    """The numbers of ``narrow``, one list after the other; ``n`` tells how many each has."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64) if len(packed) else np.zeros(1, np.int64)
    width = np.repeat(np.diff(ends) // np.maximum(n, 1), n)
    at = np.repeat(ends[:-1], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * width
    data = np.frombuffer(packed.buffers()[2], np.uint8) if len(at) else np.zeros(0, np.uint8)
    out = np.zeros(len(at), np.int64)
    for k in range(4):
        wide = width > k
        if not wide.any():
            break
        out[wide] |= data[at[wide] + k].astype(np.int64) << (8 * k)
    return out


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, numbers, counts) of postings: how many each row has, and all of them one after the other."""
    n = rows.column("n").to_numpy().astype(np.int64)
    gaps = np.cumsum(widen(rows.column("ats").combine_chunks(), n))
    first = np.cumsum(n) - n
    at = gaps - np.repeat(np.r_[0, gaps][first], n)  # a list starts with a number and goes on with differences
    return n, at, widen(rows.column("tfs").combine_chunks(), n)


def _put(df: DataFrame, path: str) -> None:
    """Write a table in term buckets, in order of terms: a task holds a range of them."""
    df.repartitionByRange("bucket", "term", "tenant").sortWithinPartitions("bucket", "term", "tenant").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def _shard(same: dict, ids: pa.Array, length: np.ndarray, words: pa.Array, term: np.ndarray, at: np.ndarray, tf: np.ndarray) -> pa.Table:
    """Rows of one shard: its postings, then a row with the ids and lengths of its passages.

    ``term`` numbers ``words``, ``at`` the passages; both come in order. ``same`` holds the columns that all rows share.
    """
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    k = len(cuts)
    sizes = np.diff(np.r_[cuts, len(term)])
    gaps = np.diff(at, prepend=0)
    gaps[cuts] = at[cuts]
    best = [np.maximum.reduceat(tf, cuts), np.minimum.reduceat(length[at], cuts), np.add.reduceat(tf, cuts)] if k else [tf, tf, tf]
    length = pa.array(length, pa.int64())
    whole = lambda x: pa.chunked_array([pa.nulls(k, pa.list_(x.type)), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)])
    plain = lambda x, kind: pa.chunked_array([pa.array(x, kind), pa.nulls(1, kind)])
    columns = {
        "term": plain(words.take(pa.array(term[cuts])), pa.string()), "n": plain(sizes, pa.int32()), "cf": plain(best[2], pa.int64()), "ats": plain(narrow(gaps, cuts), pa.binary()),
        "tfs": plain(narrow(tf, cuts), pa.binary()), "max_tf": plain(best[0], pa.int32()), "min_dl": plain(best[1], pa.int64()), "ids": whole(ids), "dls": whole(length),
    }
    return pa.table({**{c: pa.repeat(x, k + 1) for c, x in same.items()}, **columns}).combine_chunks()


def invert(t: pa.Table, same: dict) -> pa.Table:
    """``_shard`` of (passage_id, terms as text) passages, numbered in the order of their ids."""
    t = t.sort_by("passage_id")
    n = t.num_rows
    length, coded = split_terms(t.column("terms").combine_chunks())
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    return _shard(same, t.column("passage_id").combine_chunks(), length, coded.dictionary, key // n, key % n, tf)


def join_shards(heads: pa.Table, rows: pa.Table, same: dict) -> pa.Table:
    """``_shard`` of the live passages of several shards. ``heads``: rows with the ids and lengths of a shard or its dead numbers; ``rows``: postings."""
    place_of, ids, dls, dead, total = {}, [], [], [], 0
    keys = list(zip(heads.column("segment").to_pylist(), heads.column("part").to_pylist()))
    for i, key in enumerate(keys):
        if heads.column("ids")[i].is_valid:
            place_of[key] = total
            ids.append(heads.column("ids")[i].values)
            dls.append(heads.column("dls")[i].values.to_numpy())
            total += len(ids[-1])
    for i, key in enumerate(keys):
        if heads.column("dead")[i].is_valid:
            dead.append(heads.column("dead")[i].values.to_numpy() + place_of[key])
    alive = np.ones(total, bool)
    alive[np.concatenate([np.zeros(0, np.int64), *dead])] = False
    held = np.flatnonzero(alive)
    every = pa.concat_arrays(ids)
    held = held[pc.array_sort_indices(every.take(pa.array(held))).to_numpy()]
    n, place = len(held), np.full(total, -1)
    place[held] = np.arange(n)
    first = np.array([place_of[k] for k in zip(rows.column("segment").to_pylist(), rows.column("part").to_pylist())], np.int64)
    coded = rows.column("term").combine_chunks().dictionary_encode()
    sizes, at, tf = unpacked(rows)
    at = place[at + np.repeat(first, sizes)]
    key = np.repeat(coded.indices.to_numpy().astype(np.int64), sizes) * n + at
    kept = np.flatnonzero(at >= 0)
    kept = kept[np.argsort(key[kept], kind="stable")]
    key, tf = key[kept], tf[kept]
    return _shard(same, every.take(pa.array(held)), np.concatenate(dls)[held], coded.dictionary, key // max(1, n), key % max(1, n), tf)


def _by_list(b: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of every tenant and access list of a batch."""
    coded = [pc.dictionary_encode(b[c], null_encoding="encode") for c in ("tenant", "acl_key")]
    key = coded[0].indices.to_numpy().astype(np.int64) * len(coded[1].dictionary) + coded[1].indices.to_numpy()
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
    t = pa.table({c: b[c] for c in ("passage_id", "terms")})
    for i, j in zip(cuts, np.r_[cuts[1:], len(key)]):
        yield tuple(b[c][int(order[i])].as_py() for c in ("tenant", "acl_key")), t.take(pa.array(order[i:j]))


def fill_shards(batches: Iterable[pa.RecordBatch], shard_passages: int, task: int) -> Iterator[pa.Table]:
    """Shards of the passages of a task: one is closed when it is full, the longest when the task holds more than HELD bytes."""
    held, made = {}, Counter()

    def close(key: tuple, t: pa.Table) -> pa.Table:
        part = task + (made[key] << TASKS)
        made[key] += 1
        return invert(t.combine_chunks(), {"tenant": pa.scalar(key[0], pa.string()), "acl_key": pa.scalar(key[1], pa.string()), "part": pa.scalar(part, pa.int32())})

    for b in batches:
        for key, t in _by_list(b) if b.num_rows else ():
            t = held[key] = pa.concat_tables([held[key], t]) if key in held else t
            while t.num_rows >= shard_passages:
                yield close(key, t.slice(0, shard_passages))
                t = held[key] = t.slice(shard_passages)
        while sum(t.get_total_buffer_size() for t in held.values()) > HELD:
            key = max(held, key=lambda k: held[k].get_total_buffer_size())
            yield close(key, held.pop(key))
    for key, t in held.items():
        if t.num_rows:
            yield close(key, t)


def _dealt(passages: DataFrame, shard_passages: int) -> DataFrame:
    """``passages`` with the number of their shard, ``part``, dealt by it."""
    cores = passages.sparkSession.sparkContext.defaultParallelism
    n = F.count(F.lit(1))
    parts = F.greatest(F.ceil(n / shard_passages), F.least(F.lit(cores), F.ceil(n / 256))).cast("int")
    # one row per access list; a shuffled join on it would deal all passages to as many tasks as there are lists
    sizes = per_key(cut_lineage(passages.groupBy("tenant", "acl_key").agg(parts.alias("parts"))))
    dealt = passages.join(sizes, ["tenant", "acl_key"]).withColumn("part", F.pmod(F.xxhash64("passage_id"), "parts").cast("int")).drop("parts")
    return dealt.repartition("tenant", "acl_key", "part")


def _laid(kind: str) -> str:
    return f"tenant string, acl_key string, part int, term string, n int, cf long, ats binary, tfs binary, max_tf int, min_dl long, ids array<{kind}>, dls array<long>"


def _same(t: pa.Table, part: str = "part") -> dict:
    return {"tenant": t.column("tenant")[0], "acl_key": t.column("acl_key")[0], "part": t.column(part)[0]}


def _lay(rows: DataFrame, path: str, segment: int) -> DataFrame:
    """Write rows of ``_shard`` as postings and passages; returns the former.

    A task writes what it has: neither texts nor postings are shuffled.
    """
    laid = written(rows, f"{path}/postings/segment={segment}")
    heads = laid.where("term is null").select("tenant", "acl_key", "part", F.posexplode(F.arrays_zip("ids", "dls")).alias("at", "p"))
    heads.select("tenant", "acl_key", "part", "at", F.col("p.ids").alias("passage_id"), F.col("p.dls").alias("dl")).write.mode("overwrite").parquet(f"{path}/passages/segment={segment}")
    release(rows.sparkSession)
    return laid.where("term is not null")


def add_segment(passages: DataFrame, path: str, gone: DataFrame | None = None, shard_passages: int = SHARD_PASSAGES) -> int:
    """Write the live (tenant, passage_id, text, acl) rows as the next segment; returns its number.

    ``gone``: passages with the same columns that earlier segments hold and that are no longer live. A passage may go
    and come back in a later segment. Every passage_id is at most once live in a tenant, which is the caller's to keep.

    Shards are filled where the passages are, unless that would leave fewer than PIECE passages in one on average, as with
    very many access lists; then passages are shuffled by shard.
    """
    spark = passages.sparkSession
    segment = last_segment(spark, path) + 1
    new = _lines(passages)
    old = _lines(gone) if gone is not None else new.where("false")
    kind = dict(passages.dtypes)["passage_id"]
    rows = new.select("tenant", "acl_key", "passage_id", "terms")
    pieces = new.groupBy("tenant", "acl_key", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.first("acl").alias("acl"))
    pieces = cut_lineage(pieces.groupBy("tenant", "acl_key").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n"), F.first("acl").alias("acl")))
    n = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces")).first()
    if n["n"] >= PIECE * n["pieces"]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in fill_shards(batches, shard_passages, TaskContext.get().partitionId()):
                yield from t.to_batches()

        made = rows.mapInArrow(run, _laid(kind))
    else:
        made = _dealt(rows, shard_passages).groupBy("tenant", "acl_key", "part").applyInArrow(lambda t: invert(t, _same(t)), _laid(kind))
    laid = _lay(made, path, segment)
    key = ["bucket", "tenant", "acl_key", "term"]
    old = old.withColumn("terms", tokens("terms"))
    less = old.select("tenant", "acl_key", F.explode(F.array_distinct("terms")).alias("term")).select(_bucket(), "tenant", "acl_key", "term", F.lit(-1).cast("long").alias("df"))
    more = laid.withColumn("bucket", _bucket()).select(*key, F.col("n").cast("long").alias("df"))
    _put(more.unionByName(less).groupBy(*key).agg(F.sum("df").alias("df")), f"{path}/terms/segment={segment}")
    old.select("tenant", "passage_id").write.mode("overwrite").parquet(f"{path}/gone/segment={segment}")
    lengths = spark.read.parquet(f"{path}/passages/segment={segment}").groupBy("tenant", "acl_key").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl"))
    both = lengths.join(pieces.select("tenant", "acl_key", "acl"), ["tenant", "acl_key"])
    if gone is not None:
        dl = F.coalesce(F.array_size("terms"), F.lit(0)).cast("long")
        both = both.unionByName(old.groupBy("tenant", "acl_key").agg(F.first("acl").alias("acl"), (-F.count(F.lit(1))).alias("n"), (-F.sum(dl)).alias("dl")))
    lengths = both.groupBy("tenant", "acl_key").agg(F.first("acl").alias("acl"), F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{path}/lengths/segment={segment}")
    release(spark)
    return segment


def merge_segments(spark: SparkSession, path: str, to: str, shard_passages: int = SHARD_PASSAGES) -> None:
    """Write what is live in all segments of ``path`` as the one segment of a new index at ``to``.

    Shards without dead passages that can't be joined with others are copied; only the rest is shuffled, and only its postings.
    """
    last = last_segment(spark, path)
    if last < 0 or last_segment(spark, to) >= 0:
        raise ValueError(f"{path} holds no index, or {to} holds one")
    heads = _heads(spark, path, last)
    kind = heads.schema["ids"].dataType.elementType.simpleString()
    sizes = heads.groupBy(*SHARD).agg(F.sum(F.coalesce(F.array_size("ids"), F.lit(0))).alias("n"), F.sum(F.coalesce(F.array_size("dead"), F.lit(0))).alias("dead"))
    plan = spark.createDataFrame(pack(sizes.collect(), shard_passages), "segment int, tenant string, acl_key string, part int, target int, alone boolean")  # one row a shard
    same = F.col("s.segment") == F.col("d.segment"), F.col("s.tenant").eqNullSafe(F.col("d.tenant")), F.col("s.acl_key") == F.col("d.acl_key"), F.col("s.part") == F.col("d.part")
    put = lambda d: d.alias("d").join(F.broadcast(plan.alias("s")), reduce(Column.__and__, same)).select("d.*", F.col("s.target").alias("target"), F.col("s.alone").alias("alone"))
    heads, rows = put(heads), put(_read(spark, path, "postings", last))
    key = ["tenant", "acl_key", "target"]
    names = [c.split()[0] for c in _laid(kind).split(", ")]
    copied = rows.unionByName(heads.drop("dead"), allowMissingColumns=True).where("alone").withColumn("part", F.col("target")).select(*names)
    left, right = heads.where("not alone").select(*key, "segment", "part", "ids", "dls", "dead"), rows.where("not alone").select(*key, "segment", "part", "term", "n", "ats", "tfs")
    joined = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda x, y: join_shards(x, y, _same(x, "target")), _laid(kind))
    _lay(copied.unionByName(joined), to, 0)
    terms = _read(spark, path, "terms", last).groupBy("bucket", "tenant", "acl_key", "term").agg(F.sum("df").alias("df"))
    _put(terms.where("df > 0"), f"{to}/terms/segment=0")
    _read(spark, path, "gone", last).where("false").drop("segment").write.mode("overwrite").parquet(f"{to}/gone/segment=0")
    _lengths(spark, path, last).write.mode("overwrite").parquet(f"{to}/lengths/segment=0")
    release(spark)


def pack(sizes: list, shard_passages: int) -> list[tuple]:
    """(segment, tenant, acl_key, part, number of its new shard, whether it is alone there and whole) of the shards that live."""
    out, groups = [], {}
    for r in sizes:
        if r["n"] > r["dead"]:
            groups.setdefault((r["tenant"], r["acl_key"]), []).append((r["n"] - r["dead"], r["segment"], r["part"], r["dead"] == 0))
    for (tenant, acl_key), shards in groups.items():
        bins, filled = [[]], 0
        for x in sorted(shards, key=lambda s: (s[0], s[1], s[2])):
            if bins[-1] and filled + x[0] > shard_passages:
                bins.append([])
                filled = 0
            bins[-1].append(x)
            filled += x[0]
        for into, held in enumerate(bins):
            out += [(segment, tenant, acl_key, part, into, len(held) == 1 and whole) for _, segment, part, whole in held]
    return out


def _read(spark: SparkSession, path: str, name: str, last: int) -> DataFrame:
    """A table of the complete segments; tables without ids have a known schema, which spares looking it up in the files."""
    known = SCHEMAS.get(name)
    read = spark.read.schema(known) if known else spark.read
    d = read.parquet(f"{path}/{name}").where(F.col("segment") <= last)
    return d.where("term is not null") if name == "postings" else d


def _postings(spark: SparkSession, path: str, last: int) -> DataFrame:
    """(tenant, acl_key, term, n, cf, max_tf): the counts of every shard and term without the passages that later segments took away."""
    kept = ["term", "n", "cf", "max_tf"]
    schema = "tenant string, acl_key string, term string, n int, cf long, max_tf int"

    def count(dead: pa.Table, rows: pa.Table) -> pa.Table:
        if dead.num_rows and rows.num_rows:
            off = np.concatenate([x.values.to_numpy() for x in dead.column("dead")])
            n, at, tf = unpacked(rows)
            tf, first = np.where(np.isin(at, off), 0, tf), np.cumsum(n) - n
            live, cf, top = (f.reduceat(x, first) for f, x in ((np.add, (tf > 0).astype(np.int64)), (np.add, tf), (np.maximum, tf)))
            rows = pa.table({"tenant": rows.column("tenant"), "acl_key": rows.column("acl_key"), "term": rows.column("term"), "n": pa.array(live, pa.int32()), "cf": pa.array(cf, pa.int64()), "max_tf": pa.array(top, pa.int32())})
            rows = rows.filter(pc.greater(rows.column("n"), 0))
        return rows.select(["tenant", "acl_key", *kept])

    dead = _heads(spark, path, last).where("dead is not null").select(*SHARD, "dead")
    rows = _read(spark, path, "postings", last).select(*SHARD, *kept, "ats", "tfs")
    return dead.groupBy(*SHARD).cogroup(rows.groupBy(*SHARD)).applyInArrow(count, schema)


def _live(spark: SparkSession, path: str, last: int, dead: bool = False) -> DataFrame:
    """Passages that no later segment took away; with ``dead`` all, those others with a null id."""
    gone = _read(spark, path, "gone", last).groupBy("tenant", "passage_id").agg(F.max("segment").alias("_gone"))
    d = _read(spark, path, "passages", last).join(gone, ["tenant", "passage_id"], "left")
    lives = F.coalesce("_gone", F.lit(-1)) <= F.col("segment")
    return (d.withColumn("passage_id", F.when(lives, F.col("passage_id"))) if dead else d.where(lives)).drop("_gone")


def _heads(spark: SparkSession, path: str, last: int) -> DataFrame:
    """(SHARD, ids, dls, dead): per shard a row with the ids and lengths of its passages and, where later segments took some away, one with their numbers."""
    kind = dict(_read(spark, path, "passages", last).dtypes)["passage_id"]
    schema = f"tenant string, acl_key string, part int, ids array<{kind}>, dls array<long>, segment int"
    heads = spark.read.schema(schema).parquet(f"{path}/postings").where((F.col("segment") <= last) & F.col("ids").isNotNull()).select(*SHARD, "ids", "dls")
    gone = _read(spark, path, "gone", last).groupBy("tenant", "passage_id").agg(F.max("segment").alias("_gone"))
    if not gone.head(1):
        return heads.withColumn("dead", F.lit(None).cast("array<int>"))
    dead = _read(spark, path, "passages", last).join(per_key(gone), ["tenant", "passage_id"]).where("_gone > segment")
    return heads.unionByName(dead.groupBy(*SHARD).agg(F.collect_list("at").alias("dead")), allowMissingColumns=True)


def _lengths(spark: SparkSession, path: str, last: int) -> DataFrame:
    """Live passages and their tokens per tenant and access list."""
    d = _read(spark, path, "lengths", last).groupBy("tenant", "acl_key")
    return d.agg(F.first("acl").alias("acl"), F.sum("n").alias("n"), F.sum("dl").alias("dl")).where("n > 0")


def term_counts(spark: SparkSession, path: str, tenant: str, accessible: list[str]) -> DataFrame:
    """(term, df, cf, max_tf) over the live passages of a tenant that these labels may see."""
    last = last_segment(spark, path)
    sees = F.arrays_overlap(F.split("acl_key", ","), F.array(*[F.lit(a) for a in accessible]))
    seen = (F.col("tenant") == tenant) & sees
    whole = not _read(spark, path, "gone", last).head(1)  # then the counts stand in the index
    d = (_read(spark, path, "postings", last) if whole else _postings(spark, path, last)).where(seen)
    return d.groupBy("term").agg(F.sum("n").cast("long").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").cast("long").alias("max_tf"))


def _gain(tf, dl, avgdl):  # noqa: ANN001, ANN202  numbers or arrays
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def best_of_shard(terms: list[tuple[float, float, np.ndarray, np.ndarray]], length: np.ndarray, live: np.ndarray, avgdl: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers and scores of a shard's best ``k`` live passages, some near ties more, for one question.

    ``terms``: (weight, bound, numbers, counts) per term of the question that the shard holds. The terms with the highest bounds
    are scored first. Once the rest together can't lift a passage over the k-th best so far, the rest is
    looked up for the passages that are still in reach only. The last value tells how many postings were scored.
    """
    return _best([(w, bound, at, _gain(tf, length[at], avgdl)) for w, bound, at, tf in terms], np.zeros(len(length)), None if live.all() else live, k)


def _best(terms: list[tuple[float, float, np.ndarray, np.ndarray]], score: np.ndarray, live: np.ndarray | None, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """``best_of_shard`` for terms with gains in place of counts; ``live`` is None where all passages are.

    ``score`` has a zero per passage and is handed back so. Passages below ``floor`` may be left out.
    """
    n, read = len(score), 0
    terms = sorted(terms, key=lambda t: -t[1])
    rest = list(accumulate(t[1] for t in reversed(terms)))[::-1]
    among, done = None, []
    for i, (weight, _, at, gain) in enumerate(terms):
        if among is None and floor > rest[i]:
            held = np.unique(np.concatenate([np.zeros(0, np.int64), *done])) if 8 * read < n else np.flatnonzero(score)  # the others have nothing but the rest
            among = held[score[held] + rest[i] >= floor]
            among = among if live is None else among[live[among]]
            sums = score[among]
        if among is not None:
            if not len(among):
                break
            place = np.minimum(np.searchsorted(at, among), len(at) - 1)
            hit = at[place] == among
            sums[hit] += weight * gain[place[hit]]
            read += int(np.count_nonzero(hit))
            continue
        sums = score[at] + weight * gain
        score[at] = sums
        done.append(at)
        read += len(at)
        sums = sums if live is None else sums[live[at]]
        if len(sums) >= k:  # so many passages have this much already
            floor = max(floor, _reach(_kth(sums, k)))
    if among is None:
        among = np.flatnonzero(score if live is None else np.where(live, score, 0.0))
        sums = score[among]
    if 8 * sum(map(len, done)) < n:
        for at in done:
            score[at] = 0.0
    else:
        score.fill(0.0)
    found = sums > 0
    among, sums = among[found], sums[found]
    if len(among) > k:
        near = sums >= _kth(sums, k) - 2e-6  # scores are rounded later
        among, sums = among[near], sums[near]
        order = np.lexsort((among, -np.round(sums, 6)))[: 4 * k]
        among, sums = among[order], sums[order]
    return among, sums, read


def _kth(score: np.ndarray, k: int) -> float:
    """The k-th highest of ``k`` numbers or more."""
    return float(score.max() if k == 1 else np.partition(score, len(score) - k)[len(score) - k])


def _reach(kth):  # noqa: ANN001, ANN202  a number or an array
    """What a passage must reach to rank with the k-th best: scores are rounded later."""
    return kth * (1 - 1e-12) - 2e-6


def best_of_questions(rows: pa.Table, length: np.ndarray, live: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Question ids, passage numbers and scores: a shard's best for every question of a block.

    ``rows``: a term each, with its postings (ats, tfs, max_tf, min_dl) and the questions that want it, qs.
    """
    whole = lambda c: rows.column(c).combine_chunks()
    ats, qs = whole("ats"), whole("qs")
    pairs = qs.flatten()
    term = np.repeat(np.arange(len(qs)), pc.list_value_length(qs).to_numpy())
    coded = pc.struct_field(pairs, "query_id").dictionary_encode()
    shard = (ats.flatten().to_numpy(), whole("tfs").flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(ats).to_numpy())], whole("max_tf").to_numpy(), whole("min_dl").to_numpy())
    asked, found, scores = _asked(*shard, term, coded.indices.to_numpy(), pc.struct_field(pairs, "w").to_numpy(), pc.struct_field(pairs, "avgdl").to_numpy(), length, None if live.all() else live, k)
    return coded.dictionary.take(pa.array(asked)), found, scores


def _asked(at, tf, ends, max_tf, min_dl, term, query, weight, avgdl, length, alive, k, floors=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: ANN001
    """Questions, passage numbers and scores of a shard's best. An entry of term, query, weight and avgdl says that a question wants a term.

    What a posting is worth depends on the question's mean length only, so it is computed once for all questions with the
    same. Questions whose terms together can't lift a passage to their floor are passed over.
    """
    asked, found, scores, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(len(length))
    for mean in np.unique(avgdl):
        gain = _gain(tf, length[at], mean)
        parts = [(at[i:j], gain[i:j]) for i, j in zip(ends[:-1], ends[1:])]
        mine = np.flatnonzero(avgdl == mean)
        mine = mine[np.lexsort((term[mine], query[mine]))]
        bound = weight[mine] * _gain(max_tf, min_dl, mean)[term[mine]]
        cuts = np.flatnonzero(np.diff(query[mine], prepend=-1))
        ends_of = np.r_[cuts[1:], len(mine)]
        who = query[mine[cuts]]
        floor = np.zeros(len(who)) if floors is None else floors[who]
        todo = np.flatnonzero(np.add.reduceat(bound, cuts) >= floor) if len(cuts) else cuts
        bound, ts, ws = bound.tolist(), term[mine].tolist(), weight[mine].tolist()
        for q, i, j, least in zip(who[todo].tolist(), cuts[todo].tolist(), ends_of[todo].tolist(), floor[todo].tolist()):
            numbers, sums, _ = _best([(ws[x], bound[x], *parts[ts[x]]) for x in range(i, j)], score, alive, k, least)
            if len(numbers):
                asked.append(np.full(len(numbers), q, np.int64))
                found.append(numbers)
                scores.append(sums)
    return np.concatenate(asked), np.concatenate(found), np.concatenate(scores)


def seal(held: dict) -> bytes:
    """Arrays of a block or shard as bytes."""
    plain = pickle.dumps(held, 5)
    return len(plain).to_bytes(8, "little") + pa.Codec("zstd").compress(plain, asbytes=True)


def unseal(packed: pa.Scalar | bytes) -> dict:
    packed = packed if isinstance(packed, bytes) else packed.as_py()
    return pickle.loads(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions of one block, counted: (block, rows), rows with ids, their classes of tenant and access, words, and how often a question has a word."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    coded = [t.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("tenant", "access", "query_id")]
    tenant, access, ids = (c.indices.to_numpy().astype(np.int64) for c in coded)
    pair, kind = np.unique(tenant * len(coded[1].dictionary) + access, return_inverse=True)
    asked, query = np.unique(ids * len(pair) + kind, return_inverse=True)  # a repeated question has its terms more often
    length, words = split_terms(t.column("terms").combine_chunks())
    n = max(1, len(words.dictionary))
    key, qtf = np.unique(np.repeat(query, length) * n + words.indices.to_numpy(), return_counts=True)
    out = {
        "ids": coded[2].dictionary.take(pa.array(asked // len(pair))), "kind": (asked % len(pair)).astype(np.int32), "tenant": coded[0].dictionary.take(pa.array(pair // len(coded[1].dictionary))).to_pylist(),
        "access": coded[1].dictionary.take(pa.array(pair % len(coded[1].dictionary))).to_pylist(), "words": words.dictionary, "query": (key // n).astype(np.int32), "term": (key % n).astype(np.int32), "qtf": qtf.astype(np.int32),
    }
    yield pa.RecordBatch.from_pydict({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "rows": pa.array([seal(out)], pa.binary())})


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, tenant, access, term): the terms of every class of a block, and a row without a term for the class."""
    for b in batches:
        for block, rows in zip(b["block"].to_pylist(), b["rows"]):
            q = unseal(rows)
            n = max(1, len(q["words"]))
            key = np.unique(q["kind"][q["query"]].astype(np.int64) * n + q["term"])
            for kind, (tenant, access) in enumerate(zip(q["tenant"], q["access"])):
                term = pa.concat_arrays([q["words"].take(pa.array(key[key // n == kind] % n)), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(x, k), len(term)) for x, k in ((block, pa.int32()), (tenant, pa.string()), (access, pa.string()))] + [term], ["block", "tenant", "access", "term"])


def _weighed(questions: pa.Table, counts: pa.Table) -> pa.Table:
    """Questions of a block with what their terms weigh in their class; ``counts``: df per class and term, n, avgdl and acl_keys per class."""
    block, q = questions.column("block")[0].as_py(), unseal(questions.column("rows")[0])
    kinds, n = {x: i for i, x in enumerate(zip(q["tenant"], q["access"]))}, max(1, len(q["words"]))
    about = counts.filter(pc.is_null(counts.column("term")))
    size, mean, sees = np.zeros(len(kinds)), np.ones(len(kinds)), [[]] * len(kinds)
    for r in about.select(["tenant", "access", "n", "avgdl", "acl_keys"]).to_pylist():
        i = kinds[r["tenant"], r["access"]]
        size[i], mean[i], sees[i] = r["n"], r["avgdl"], r["acl_keys"]
    counts = counts.filter(pc.is_valid(counts.column("term")))
    kind = np.array([kinds[x] for x in zip(counts.column("tenant").to_pylist(), counts.column("access").to_pylist())], np.int64)
    key = kind * n + pc.index_in(counts.column("term").combine_chunks(), q["words"]).to_numpy()
    order = np.argsort(key)
    key, df = np.r_[key[order], -1], np.r_[counts.column("df").to_numpy()[order], 0]
    mine = q["kind"][q["query"]].astype(np.int64)
    want = mine * n + q["term"]
    at = np.searchsorted(key[:-1], want)
    known = key[at] == want
    df, mine = df[at[known]], mine[known]
    weight = q["qtf"][known] * np.log(1 + (size[mine] - df + 0.5) / (df + 0.5))
    out = {"block": block, "ids": q["ids"], "words": q["words"], "query": q["query"][known], "term": q["term"][known], "weight": weight, "kind": mine.astype(np.int32), "mean": mean, "tenant": q["tenant"], "sees": [frozenset(x) for x in sees]}
    return pa.table({"block": pa.array([block], pa.int32()), "rows": pa.array([seal(out)], pa.binary())})


def _shards(t: pa.Table) -> Iterator[dict]:
    """Whole shards of rows with a shard's number: postings, ids and lengths, dead numbers."""
    number = t.column("shard").to_numpy()
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.diff(number[order], prepend=-1))
    for i, j in zip(cuts, np.r_[cuts[1:], len(order)]):
        rows = t.take(pa.array(order[i:j])).combine_chunks()
        head = rows.filter(pc.is_valid(rows.column("ids")))
        posts = rows.filter(pc.is_valid(rows.column("term")))
        dead = rows.filter(pc.is_valid(rows.column("dead"))).column("dead")
        if not head.num_rows or not posts.num_rows:
            continue
        live = None
        if len(dead):
            live = np.ones(len(head.column("dls")[0].values), bool)
            live[np.concatenate([x.values.to_numpy() for x in dead])] = False
        n, at, tf = unpacked(posts)
        small = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        yield {
            "tenant": head.column("tenant")[0].as_py(), "acl_key": head.column("acl_key")[0].as_py(), "ids": head.column("ids")[0].values, "length": head.column("dls")[0].values.to_numpy(), "live": live,
            "words": posts.column("term").combine_chunks(), "n": small(n), "at": small(at), "tf": small(tf), "max_tf": posts.column("max_tf").to_numpy(), "min_dl": posts.column("min_dl").to_numpy(),
        }


class _Best:
    """The best ``k`` passages so far for each question of a block, over the shards of a task."""

    def __init__(self, block: dict, k: int) -> None:
        self.q, self.k, self.found = block, k, []
        self.top = np.zeros((len(block["ids"]), k))

    def add(self, shard: dict) -> None:
        q = self.q
        sees = np.array([t == shard["tenant"] and shard["acl_key"] in keys for t, keys in zip(q["tenant"], q["sees"])], bool)
        row = pc.index_in(q["words"], shard["words"]).fill_null(-1).to_numpy()[q["term"]]
        mine = np.flatnonzero(sees[q["kind"]] & (row >= 0))
        if not len(mine):
            return
        ends = np.r_[0, np.cumsum(shard["n"].astype(np.int64))]
        ask = row[mine], q["query"][mine], q["weight"][mine], q["mean"][q["kind"][mine]]
        floors = _reach(self.top[:, 0])
        asked, at, score = _asked(shard["at"].astype(np.int64), shard["tf"].astype(np.float64), ends, shard["max_tf"], shard["min_dl"], *ask, shard["length"].astype(np.float64), shard["live"], self.k, floors)
        if len(asked):
            self.found.append(pa.table({"query": asked, "passage_id": shard["ids"].take(pa.array(at)), "score": np.round(score, 6)}))
            order = np.lexsort((-score, asked))
            asked, score = asked[order], score[order]
            place = np.arange(len(asked)) - np.searchsorted(asked, asked)
            new = np.zeros_like(self.top)
            new[asked[place < self.k], place[place < self.k]] = score[place < self.k]
            self.top = np.sort(np.concatenate([self.top, new], 1), axis=1)[:, self.k :]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            t = pa.concat_tables(self.found).sort_by([("query", "ascending"), ("score", "descending"), ("passage_id", "ascending")])
            query = t.column("query").to_numpy()
            kept = pa.array(np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) < self.k))
            t = t.take(kept).combine_chunks()
            yield from pa.table({"query_id": self.q["ids"].take(t.column("query").combine_chunks()), "passage_id": t.column("passage_id"), "score": t.column("score")}).combine_chunks().to_batches()


def search(spark: SparkSession, path: str, questions: DataFrame, k: int) -> DataFrame:
    """BM25 top ``k`` of the index at ``path``: (query_id, passage_id, score, rank).

    ``questions``: (query_id, tenant, text, accessible array). A question sees the live passages of its tenant
    whose access list shares a label with its own; document frequency and mean length are those of these
    passages. A question without a tenant sees nothing, a null text has no terms. Ids may be of any type.

    Questions are packed in blocks of bounded size. One block is sent to the tasks, and postings of its terms are
    shuffled by shard and scored. With more, shards and blocks are written once, packed, and read again for every pair; a task
    scores a block on several shards and gives back ``k`` rows a question. Neither questions nor postings are ever copied per pair.
    """
    last = last_segment(spark, path)
    kinds = dict(questions.dtypes)["query_id"], dict(_read(spark, path, "passages", last).dtypes)["passage_id"]
    qs = questions.withColumn("access", access_key(F.col("accessible")))
    size = qs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(tokens(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("terms")).first()
    classes = qs.select("tenant", "access", "accessible").dropDuplicates(["tenant", "access"]).select("tenant", "access", F.explode("accessible").alias("label"))
    # one row per tenant, access class and access list, not per passage
    seen = _lengths(spark, path, last).withColumn("label", F.explode("acl")).join(classes, ["tenant", "label"]).select("tenant", "access", "acl_key", "n", "dl").distinct()
    seen = cut_lineage(seen)
    stats = seen.groupBy("tenant", "access").agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"), F.collect_list("acl_key").alias("acl_keys"))
    heads = _heads(spark, path, last).join(F.broadcast(seen.select("tenant", "acl_key").distinct()), ["tenant", "acl_key"])
    shards = [tuple(r) for r in heads.select(*SHARD).distinct().collect()]  # one row a shard
    cores = spark.sparkContext.defaultParallelism
    # where many questions meet few shards, blocks are made smaller for all cores to have some
    blocks = max(1, -(-size["n"] // QUESTIONS), -(-size["terms"] // TERMS), min(-(-2 * cores // max(1, len(shards))), -(-size["n"] // 2048)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    packed = qs.select(block, "query_id", "tenant", "access", F.lower("text").alias("terms")).repartitionById(blocks, F.col("block"))
    packed = cut_lineage(packed.mapInArrow(_gathered, "block int, rows binary"))
    wanted = packed.mapInArrow(_wanted, "block int, tenant string, access string, term string")
    terms = cut_lineage(wanted.where("term is not null").withColumn("bucket", _bucket()))
    few = terms.limit(ASKED + 1).count() <= ASKED
    dfs = _read(spark, path, "terms", last).drop("segment").join(F.broadcast(terms) if few else shuffled(terms), ["bucket", "tenant", "term"])
    dfs = dfs.join(per_key(seen.select("tenant", "access", "acl_key")), ["tenant", "access", "acl_key"]).groupBy("block", "tenant", "access", "term").agg(F.sum("df").alias("df")).where("df > 0")
    about = wanted.where("term is null").drop("term").join(stats, ["tenant", "access"])
    asked = packed.groupBy("block").cogroup(dfs.unionByName(about, allowMissingColumns=True).groupBy("block")).applyInArrow(lambda x, y: _weighed(x, y) if x.num_rows else x, "block int, rows binary")
    parts = max(1, min(len(shards), max(-(-len(shards) // TOGETHER), -(-2 * cores // blocks))))
    plan = F.broadcast(spark.createDataFrame([(*x, i) for i, x in enumerate(shards)], "segment int, tenant string, acl_key string, part int, shard int"))
    rows = _read(spark, path, "postings", last)
    rows = rows.join(F.broadcast(terms.select("tenant", "term").distinct()), ["tenant", "term"], "left_semi") if few else rows
    rows = rows.join(plan, SHARD).select("shard", "term", "n", "ats", "tfs", "max_tf", "min_dl")
    rows = rows.unionByName(heads.join(plan, SHARD).select("shard", "tenant", "acl_key", "ids", "dls", "dead"), allowMissingColumns=True)
    rows = rows.repartitionById(parts, F.pmod(F.col("shard"), F.lit(parts)))
    schema = f"query_id {kinds[0]}, passage_id {kinds[1]}, score double"
    whole = lambda batches: pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
    if blocks == 1:
        sent = spark.sparkContext.broadcast([bytes(r["rows"]) for r in asked.select("rows").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = whole(batches)
            if t is not None:
                for x in sent.value:
                    best = _Best(unseal(x), k)
                    for shard in _shards(t):
                        best.add(shard)
                    yield from best.rows()

        found = rows.mapInArrow(run, schema)
    else:
        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = whole(batches)
            for shard in _shards(t) if t is not None else ():
                yield pa.RecordBatch.from_pydict({"b": pa.array([seal(shard)], pa.binary())})

        laid = cut_lineage(rows.mapInArrow(put, "b binary"))
        asked = cut_lineage(asked.repartitionById(blocks, F.col("block")))
        release(spark)

        def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {}
            for b in batches:
                for block, x, y in zip(b["block"].to_pylist(), b["rows"], b["b"]):
                    if block not in best:
                        best[block] = _Best(unseal(x), k)
                    best[block].add(unseal(y))
            for x in best.values():
                yield from x.rows()

        found = asked.join(laid.hint("shuffle_replicate_nl"), F.lit(True)).mapInArrow(run_pairs, schema)
    return top_k(found.where("score > 0"), ["query_id"], [F.desc("score"), F.col("passage_id")], k)
