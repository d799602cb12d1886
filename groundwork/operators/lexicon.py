"""Terms of a lexicon inside texts: one pass over the texts for each bounded block of terms, no shuffle of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import automaton
from ..session import cut_lineage

#: Bytes of terms in a block: at most so many states, with one number for each byte value that its terms use.
BLOCK = 1 << 17
#: Bytes of text that a task searches at once; a longer text alone.
SLICE = 8 << 20

_TERM = "_term"


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most SLICE bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _search(block, text: str, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = block.value
        names = pa.array(terms, type=pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if offsets[-1] == offsets[0]:
                continue
            data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
            rest = batch.select(keep)
            for i, j in _slices(offsets):
                base = offsets[i]
                rows, found = automaton.find(machine, data[base : offsets[j]], offsets[i:j] - base, offsets[i + 1 : j + 1] - base)
                if len(rows):
                    out = rest.take(pa.array(rows + i))
                    yield pa.RecordBatch.from_arrays([*out.columns, names.take(pa.array(found))], names=[*keep, _TERM])

    return run


def _blocks(terms: DataFrame) -> Iterator[list[str]]:
    """``terms`` (term), dealt by hash into blocks that are about half full, one at a time."""
    total = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("n")).first()["n"]
    if total <= BLOCK:
        if total:
            yield sorted(r["term"] for r in terms.collect())
        return
    n = -(-2 * total // BLOCK)
    dealt = cut_lineage(terms.withColumn("_b", F.pmod(F.xxhash64("term"), F.lit(n))).repartition("_b"))
    for b in range(n):
        block = sorted(r["term"] for r in dealt.where(F.col("_b") == b).select("term").collect())
        if block:
            yield block


def lexicon_join(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """All (needle row, hay row) pairs with ``needle`` a substring of ``text``: columns of both but ``text``.

    Every block of the lexicon becomes an automaton in flat arrays that is sent to the tasks; a task walks its texts
    once a block, whole and of any length, and hands on (row, term) hits, each once however often the term occurs.
    Only hits are joined with the lexicon. Null and empty needles and texts meet nothing; repeated rows on either
    side give repeated pairs; empty tables give none. For lexicons far larger than the texts, ``contains_join``
    is the better form, since here the texts are read once for each 64 KB of terms.
    """
    sc = hay.sparkSession.sparkContext
    keep = [c for c in hay.columns if c != text]
    schema = T.StructType([*(hay.schema[c] for c in keep), T.StructField(_TERM, T.StringType())])
    terms = needles.where(F.length(needle) > 0).select(F.col(needle).alias("term")).distinct()
    parts = []
    for block in _blocks(terms):
        sent = sc.broadcast((block, automaton.build([t.encode() for t in block])))
        parts.append(hay.mapInArrow(_search(sent, text, keep), schema))
    if not parts:
        return needles.join(hay.drop(text).withColumn(_TERM, F.lit(None).cast("string")).where(F.lit(False)), F.col(needle) == F.col(_TERM)).drop(_TERM)
    hits = reduce(DataFrame.unionByName, parts)
    return needles.join(hits, F.col(needle) == F.col(_TERM)).drop(_TERM)
