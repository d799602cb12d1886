"""Folder, upload, sheet, ledger and repository-file sources and sinks."""

from __future__ import annotations

import csv
import io
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = "tenant string, source string, source_version string, uri string, mime string, title string, body binary, language string, meta map<string,string>, acl array<string>"

# Endings to mime types, source kinds, endings of repository files, size caps.
MIMES = {
    "csv": "text/csv", "tsv": "text/tab-separated-values", "html": "text/html", "htm": "text/html", "md": "text/markdown", "json": "application/json", "pdf": "application/pdf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "py": "text/x-code", "js": "text/x-code", "ipynb": "application/x-ipynb+json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
KINDS = ("document", "table", "image", "jira", "confluence", "code", "analysis")
CODE_FILE = r"(?i)\.(py|js|ts|tsx|jsx|go|java|rb|cs|sh|sql|rs|kt)$"
DOC_FILE = r"(?i)\.(md|rst|txt|adoc)$"
IMAGE_FILE = r"(?i)\.(png|jpg|jpeg|gif|webp|svg)$"
CONFIG_FILE = r"(?i)\.(ya?ml|json|toml|ini|cfg|tf|xml)$"
MANIFEST = r"(^|/)(requirements[^/]*\.txt|package\.json|pyproject\.toml|go\.mod|Cargo\.toml|Gemfile|pom\.xml|build\.gradle|composer\.json)$"
MAX_FILE, MAX_IMAGE = 512_000, 5_000_000


def mime_of(path: Column) -> Column:
    m = F.create_map(*[x for k, v in MIMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text/plain"))


def _title(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def drop_folder(spark: SparkSession, folder: str, tenant: str, source: str = "files", acl: tuple[str, ...] = ("public",)) -> DataFrame:
    """Every file under a folder as one canonical record. The scan is Spark's own, split by file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return f.select(
        F.lit(tenant).alias("tenant"), F.lit(source).alias("source"), F.date_format("modificationTime", "yyyyMMddHHmmss").alias("source_version"),
        F.concat(F.lit("file://"), name).alias("uri"), mime_of(name).alias("mime"), _title(name).alias("title"), F.col("content").alias("body"), F.lit("en").alias("language"),
        F.create_map(F.lit("path"), F.col("path")).alias("meta"), F.array(*[F.lit(a) for a in acl]).alias("acl"),
    )


def uploads(batch: DataFrame, tenant: str, acl: tuple[str, ...] = ("public",)) -> DataFrame:
    """Canonical records of uploaded (filename, data) rows."""
    return batch.select(
        F.lit(tenant).alias("tenant"), F.lit("upload").alias("source"), F.lit("1").alias("source_version"), F.concat(F.lit("upload://"), "filename").alias("uri"), mime_of(F.col("filename")).alias("mime"),
        _title(F.col("filename")).alias("title"), F.col("data").alias("body"), F.lit("en").alias("language"), F.create_map().cast("map<string,string>").alias("meta"), F.array(*[F.lit(a) for a in acl]).alias("acl"),
    )


def stamp_meta(records: DataFrame, now_ms: int) -> DataFrame:
    """Default ACL, arrival time, checked source kind and citation url; keys starting with ``_`` go."""
    from ..operators.convert import source_kind

    m = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.startswith("_"))
    asked = F.try_element_at(m, F.lit("source_kind"))
    kind = F.when(asked.isin(*KINDS), asked).otherwise(source_kind(F.col("mime"), F.col("uri")))
    cite = F.coalesce(F.try_element_at(m, F.lit("citation_url")), F.col("uri"))
    at = F.coalesce(F.try_element_at(m, F.lit("arrived_at")), F.lit(str(now_ms)))
    rest = F.map_filter(m, lambda k, v: ~k.isin("source_kind", "citation_url", "arrived_at"))
    acl = F.when(F.size(F.coalesce("acl", F.array().cast("array<string>"))) > 0, F.col("acl")).otherwise(F.array(F.lit("public")))
    return records.withColumn("meta", F.map_concat(rest, F.create_map(F.lit("source_kind"), kind, F.lit("citation_url"), cite, F.lit("arrived_at"), at))).withColumn("acl", acl)


def parse_delimited(content: bytes, sep: str) -> list[list[str]]:
    """Cells of all rows of a delimited text; quoted cells may hold separators and line breaks."""
    text = content.decode("utf-8-sig", "replace")
    return [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row]


def delimited_sheets(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Sheets from .csv or .tsv files, all cells as text: (sheet_id, row, cells array).

    A file is a sheet and is read by one task, because only its start tells where a quoted cell
    ends; files are spread over the cluster. Rows are numbered from 0 and keep all their cells.
    """
    sep = sep or ("\t" if path.lower().rstrip("*").endswith(".tsv") else ",")
    parse = F.udf(lambda b: parse_delimited(bytes(b), sep), "array<array<string>>", useArrow=True)
    n = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("sheet_id"), "content")
    return n.select("sheet_id", F.posexplode(parse("content")).alias("row", "cells"))


LEDGER = T.StructType([
    T.StructField(n, t) for n, t in [
        ("ts", T.StringType()), ("run_id", T.StringType()), ("workflow", T.StringType()), ("purpose", T.StringType()), ("model", T.StringType()), ("repo", T.StringType()),
        ("doc_id", T.StringType()), ("question_hash", T.StringType()), ("input_tokens", T.LongType()), ("output_tokens", T.LongType()), ("cache_read_input_tokens", T.LongType()),
        ("cache_creation_input_tokens", T.LongType()), ("thinking_tokens", T.LongType()), ("latency_ms", T.DoubleType()), ("cost_usd", T.DoubleType()), ("request_id", T.StringType()), ("day", T.DateType()),
    ]
])


def read_ledger(spark: SparkSession, path: str, since_day: str) -> DataFrame:
    """Ledger rows from day folders on; older folders are pruned, bad lines dropped."""
    return spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where(F.col("day") >= F.lit(since_day).cast("date"))


def append_ledger(calls: DataFrame, prices: DataFrame, path: str) -> None:
    """Append priced calls by day; an unknown purpose is flagged, never dropped."""
    from ..operators.telemetry import purpose_flag, with_cost

    rows = with_cost(calls.withColumn("purpose", purpose_flag(F.col("purpose"))), prices).withColumn("day", F.to_date(F.substring("ts", 1, 10)))
    rows.write.partitionBy("day").mode("append").json(path)


def merge_facts(stored: DataFrame, block: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the rows of the keys in ``block`` and keep all others."""
    return stored.join(block.select(*keys).distinct(), keys, "left_anti").unionByName(block, allowMissingColumns=True)


# Folders and files left out of a repository scan.
SKIP_DIR = r"(^|/)(\.git|node_modules|vendor|dist|build|target|__pycache__|\.venv|venv)/"


def _file_kind() -> Column:
    p = F.col("path")
    return F.when(p.rlike(IMAGE_FILE), "image").when(p.rlike(CODE_FILE), "code").when(p.rlike(DOC_FILE), "doc").when(p.rlike(MANIFEST), "manifest").when(p.rlike(CONFIG_FILE), "config")


def _skip_reason() -> Column:
    """Why a file of a clone is left out; null for files that are read."""
    kind = _file_kind()
    cap = F.when(kind == "image", MAX_IMAGE).otherwise(MAX_FILE)
    return F.when(F.col("path").rlike(SKIP_DIR), "folder").when(kind.isNull(), "kind").when(F.col("length") <= 0, "empty").when(F.col("length") > cap, "oversize")


def repository_files(files: DataFrame, repo: str, branch: str) -> DataFrame:
    """Classify clone files (path, length[, content]) by kind, area and mime; ``skipped_files`` lists the others."""
    p, kind = F.col("path"), _file_kind()
    area = F.when((kind == "doc") | F.lower(p).startswith("docs/"), "Architecture").otherwise("Code")
    mime = F.when(kind == "image", mime_of(p)).when(kind == "code", "text/x-code").when(F.lower(p).endswith(".md"), "text/markdown").otherwise("text/plain")
    return files.where(_skip_reason().isNull()).select(
        *files.columns, kind.alias("kind"), area.alias("area"), mime.alias("mime"), F.concat(F.lit(f"github://{repo}/"), p).alias("uri"), F.concat(F.lit(f"https://github.com/{repo}/blob/{branch}/"), p).alias("citation_url"),
    )


def skipped_files(files: DataFrame) -> DataFrame:
    """Clone files that are left out, with the reason: folder, kind, empty or oversize."""
    return files.withColumn("reason", _skip_reason()).where("reason is not null").select("path", "length", "reason")
