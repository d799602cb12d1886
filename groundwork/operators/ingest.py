"""One ingest batch as one plan: detect, convert, chunk, extract, graph, versions, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import versions as V
from .convert import paragraph_passages
from .extract import concept_backfill, contradiction_flags, low_confidence, mentions, relations, resolve_entities
from .graph import cooccurrence
from .skew import latest


def ingest_batch(incoming: DataFrame, documents: DataFrame, passages: DataFrame, lexicon: DataFrame, delimiter: str = r"\n\s*\n") -> dict[str, DataFrame]:
    """Run a batch of records (tenant, source, uri, text, content_hash[, arrival]) against the store.

    Returns the tables to write: status, documents, passages, ledger, mentions, nodes, edges, queue.
    The detected work is written once, because every later table starts from it; unchanged records
    go no further. Vectors come from ``functions.udfs.hash_embed`` over ``passages``.
    """
    status = V.ingest_diff(incoming, documents, [c for c in ("arrival",) if c in incoming.columns] + ["content_hash"])
    work = cut_lineage(status.where("status <> 'noop'"))
    new = paragraph_passages(work.select("document_id", "content_hash", "version", "text"), "text", delimiter)
    new = new.select(
        V.stable_id(F.col("document_id"), F.col("version").cast("string"), F.col("pos").cast("string")).alias("passage_id"), "document_id", "version", "pos",
        F.col("passage").alias("text"), "content_hash", F.lit("1").alias("source_version"), F.lit(None).cast("string").alias("superseded_by"),
    )
    # a version that a later record of the batch replaced is superseded from the start
    last = latest(work, ["document_id"], ["version"])
    new = new.join(last.select("document_id", F.col("version").alias("_last")), "document_id")
    new = new.withColumn("superseded_by", F.when(F.col("version") < F.col("_last"), F.concat(F.lit("v"), (F.col("version") + 1).cast("string")))).drop("_last")
    found = cut_lineage(mentions(new, lexicon).join(new.select("passage_id", "document_id", "pos"), "passage_id"))
    stated = relations(new).join(new.select("passage_id", "document_id", "pos"), "passage_id")
    nodes = resolve_entities(found.withColumn("arrival", F.struct("document_id", "pos", "passage_id")))
    extra = concept_backfill(nodes, stated)
    edges = contradiction_flags(stated.select("src", "relation", "dst", F.struct("document_id", "pos", "sentence").alias("arrival"), "confidence"))
    contextual = cooccurrence(found.select("document_id", "passage_id", F.col("key").alias("node")))
    ledger, ledger_rows = V.record_versions(new)
    changed = work.where("status = 'updated'").groupBy("document_id").agg(F.min("version").alias("version"))
    docs = V.upsert(documents, last.select("tenant", "document_id", "source", "uri", "content_hash", F.col("version").alias("current_version"), F.lit("active").alias("status")), ["document_id"])
    return {
        "status": status, "documents": docs, "passages": V.supersede(passages, changed).unionByName(new, allowMissingColumns=True), "new_passages": new, "ledger": ledger,
        "ledger_rows": ledger_rows, "mentions": found, "nodes": nodes, "concepts": extra, "stated_edges": edges, "contextual_edges": contextual, "queue": low_confidence(found),
    }
