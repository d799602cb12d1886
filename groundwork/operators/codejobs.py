"""Jobs over a table of source files: symbols, comments, manifests, licences, capabilities, readiness, cards."""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.braces import blocks
from .definitions import GRAMMARS, definitions, notebook
from .skew import shuffled
from .telemetry import stab_join

SYMBOLS = (
    "repo string, path string, language string, kind string, symbol string, qualified string, cls string, module string, start_line int, end_line int, "
    "signature string, docstring string, calls array<string>, imports array<string>, decorators array<string>"
)
# Language by ending, definition starts of languages without blocks.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "cs": "csharp", "sql": "sql", "yml": "yaml", "yaml": "yaml", "ipynb": "notebook",
}
STARTS = {"sql": r"(?i)^\s*(create\s+(?:or\s+replace\s+)?(?:table|view|function|index))\s+(?:if\s+not\s+exists\s+)?([\w.]+)", "yaml": r"^()([A-Za-z_][\w-]*):"}


def language_of(path: Column) -> Column:
    m = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def _module(path: str) -> str:
    return re.sub(r"\.\w+$", "", path).strip("/").replace("/", ".")


def _name(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _name(node.value)
        return f"{left}.{node.attr}" if left else ""
    return ""


def _module_row(path: str, text: str, docstring: str = "", imports: list[str] | None = None) -> tuple:
    """A whole file: its symbol is the file's name, its last line the last one with text or a line end."""
    mod = _module(path)
    return ("module", path.rsplit("/", 1)[-1], mod, None, mod, 1, max(1, len(text.splitlines())), "", docstring, [], imports or [], [])


def _called(tree: ast.AST) -> list[str]:
    return sorted({c for k in ast.walk(tree) if isinstance(k, ast.Call) and (c := _name(k.func))})


def _imported(tree: ast.AST) -> list[str]:
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [f"{'.' * n.level}{n.module or ''}.{a.name}" for a in n.names]
    return sorted(set(out))


def _python(path: str, text: str) -> list[tuple]:
    tree = ast.parse(text)
    mod = _module(path)
    rows = [_module_row(path, text, ast.get_docstring(tree) or "", _imported(tree))]
    marks = lambda n: [ast.unparse(d) for d in n.decorator_list]

    def visit(body: list, prefix: str, cls: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef) and cls is None:
                # the class itself ends where its first method begins; classes inside classes are no symbols
                first = next((m.lineno for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))), None)
                bases = ", ".join(ast.unparse(b) for b in n.bases)
                end = n.end_lineno if first is None else max(n.lineno, first - 1)
                rows.append(("class", n.name, f"{prefix}.{n.name}", cls, mod, n.lineno, end, f"{n.name}({bases})" if bases else n.name, ast.get_docstring(n) or "", [], [], marks(n)))
                visit(n.body, f"{prefix}.{n.name}", n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                calls = _called(n)
                sig = f"def {n.name}({ast.unparse(n.args)})"
                rows.append(("method" if cls else "function", n.name, f"{prefix}.{n.name}", cls, mod, n.lineno, n.end_lineno, sig, ast.get_docstring(n) or "", calls, [], marks(n)))

    visit(tree.body, mod, None)
    return rows


def _by_starts(path: str, text: str, language: str) -> list[tuple]:
    """Symbols of a language without blocks: a definition runs to the line before the next one."""
    mod, lines = _module(path), text.splitlines()
    rx = re.compile(STARTS[language])
    hits = [(i, m.group(1), m.group(2)) for i, ln in enumerate(lines, 1) if (m := rx.match(ln))]
    rows = [_module_row(path, text)]
    for j, (i, word, name) in enumerate(hits):
        end = hits[j + 1][0] - 1 if j + 1 < len(hits) else len(lines)
        rows.append(("statement" if word else "key", name, f"{mod}.{name}", None, mod, i, end, lines[i - 1].strip(), "", [], [], []))
    return rows


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbol rows of source files (repo, path, text); a file that does not parse keeps its module row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            braced = b["language"].isin(list(GRAMMARS)).to_numpy()
            found = iter(blocks(b["text"][braced].tolist()))  # the structure of all files of the batch at once
            for repo, path, text, lang in zip(b["repo"], b["path"], b["text"], b["language"], strict=True):
                try:
                    if lang in GRAMMARS:
                        rows = list(definitions(path, _module(path), next(found), lang))
                    elif lang == "notebook":
                        rows = list(notebook(path, _module(path), text, _called, _imported))
                    else:
                        rows = _python(path, text) if lang == "python" else _by_starts(path, text, lang)
                except SyntaxError:
                    rows = [_module_row(path, text)]
                out += [(repo, path, lang, *r) for r in rows]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SYMBOLS.split(", ")])

    f = files.withColumn("language", language_of(F.col("path"))).where("language is not null").select("repo", "path", F.coalesce("text", F.lit("")).alias("text"), "language")
    return f.mapInPandas(run, SYMBOLS)


# Comment markers by language, tags, sizes worth keeping.
LINE_MARK = {"python": r"^\s*#+", "yaml": r"^\s*#+", "sql": r"^\s*--+", "javascript": r"^\s*//+", "typescript": r"^\s*//+", "go": r"^\s*//+", "java": r"^\s*//+", "csharp": r"^\s*//+"}
TRAIL_MARK = {"python": r"\s#\s+(.*)$", "yaml": r"\s#\s+(.*)$", "sql": r"\s--\s+(.*)$", "javascript": r"\s//\s+(.*)$", "typescript": r"\s//\s+(.*)$", "go": r"\s//\s+(.*)$", "java": r"\s//\s+(.*)$", "csharp": r"\s//\s+(.*)$"}
TAG = r"\b(TODO|FIXME|NOTE|HACK)\b"
MIN_BLOCK_LINES, MIN_WORDS = 2, 8


def extract_comments(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Docstrings, tagged comments, blocks of two or more lines and lines of eight or more words.

    Comment lines are found per line; neighbouring whole-line comments form a block by the classic
    row-number difference. The enclosing symbol is the narrowest one whose lines hold the comment.
    """
    f = files.withColumn("language", language_of(F.col("path"))).where("language is not null")
    ln = f.select("repo", "path", "language", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    full = trail = F.lit(None).cast("string")
    for lang in LINE_MARK:
        full = F.when((F.col("language") == lang) & F.col("line").rlike(LINE_MARK[lang]), F.trim(F.regexp_replace("line", LINE_MARK[lang], ""))).otherwise(full)
        trail = F.when(F.col("language") == lang, F.nullif(F.trim(F.regexp_extract("line", TRAIL_MARK[lang], 1)), F.lit(""))).otherwise(trail)
    ln = ln.withColumn("_full", full).withColumn("_trail", F.when(F.col("_full").isNull(), trail))
    w = Window.partitionBy("repo", "path").orderBy("line_no")
    c = ln.where("_full is not null").withColumn("_g", F.col("line_no") - F.row_number().over(w))
    blocks = c.groupBy("repo", "path", "language", "_g").agg(
        F.min("line_no").alias("line_no"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_full"))), lambda x: x["_full"]), " ").alias("text")
    ).drop("_g")
    one = ln.where("_trail is not null").select("repo", "path", "language", "line_no", F.col("line_no").alias("end_line"), F.lit(1).cast("long").alias("lines"), F.col("_trail").alias("text"))
    u = blocks.unionByName(one)
    tag = F.nullif(F.regexp_extract("text", TAG, 1), F.lit(""))
    kind = F.when(tag.isNotNull(), F.lower(tag)).when(F.col("lines") >= MIN_BLOCK_LINES, "block").when(F.size(F.split(F.trim("text"), r"\s+")) >= MIN_WORDS, "line")
    u = u.withColumn("kind", kind).where("kind is not null").select("repo", "path", "line_no", "kind", "text")
    doc = symbols.where("docstring <> '' and language = 'python'").select("repo", "path", F.col("start_line").alias("line_no"), F.lit("docstring").alias("kind"), F.col("docstring").alias("text"), F.col("qualified").alias("symbol"))
    placed = enclosing(u, symbols)
    return placed.unionByName(doc)


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds ``symbol``: the narrowest non-module symbol of the file whose lines hold ``line_no``."""
    s = symbols.where("kind <> 'module'").select("repo", "path", "start_line", "end_line", "qualified")
    hit = stab_join(points.select("repo", "path", "line_no").distinct(), "line_no", s, "start_line", "end_line", ["repo", "path"])
    best = hit.groupBy("repo", "path", "line_no").agg(F.min_by("qualified", F.struct(F.col("end_line") - F.col("start_line"), "start_line", "qualified")).alias("symbol"))
    return points.join(shuffled(best), ["repo", "path", "line_no"], "left")


# ---- manifests ----------------------------------------------------------------------------
# Structured manifests by file name: format, ecosystem, and the sections that list dependencies
# (``list`` of requirement strings, ``groups`` of such lists, ``map`` of name to version or table).
STRUCTURED = {
    "pyproject.toml": ("toml", "pypi", [("project.dependencies", "list"), ("project.optional-dependencies", "groups"), ("tool.poetry.dependencies", "map")]),
    "Pipfile": ("toml", "pypi", [("packages", "map"), ("dev-packages", "map")]),
    "Cargo.toml": ("toml", "cargo", [("dependencies", "map"), ("dev-dependencies", "map"), ("build-dependencies", "map")]),
    "package.json": ("json", "npm", [("dependencies", "map"), ("devDependencies", "map"), ("peerDependencies", "map")]),
    "composer.json": ("json", "packagist", [("require", "map"), ("require-dev", "map")]),
}
# Manifests read by pattern: file name, ecosystem, pattern with name and version.
PATTERNED = [
    (r"requirements.*\.txt$", "pypi", r"(?m)^[ \t]*(?!(?:#|-|git\+|http))([A-Za-z0-9][\w.-]*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*([^;#\n]*)"),
    (r"go\.mod$", "go", r"(?m)^(?:require[ \t]+|[ \t]+)([^\s/()]+/\S+)[ \t]+([^\s/]\S*)"),
    (r"Gemfile$", "rubygems", r"(?m)^\s*gem\s+['\"]([^'\"]+)['\"]\s*(?:,\s*['\"]([^'\"]+)['\"])?"),
    (r"build\.gradle(?:\.kts)?$", "maven", r"(?:implementation|api|compile|testImplementation|runtimeOnly|compileOnly)\s*\(?\s*['\"]([^'\":]+:[^'\":]+)(?::([^'\":]+))?[^'\"]*['\"]"),
]
REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;#)]*)")


def _section(data: dict, path: str) -> object:
    for k in path.split("."):
        data = data.get(k) if isinstance(data, dict) else None
    return data or {}


def _structured(text: str, kind: str, sections: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    try:
        data = tomllib.loads(text) if kind == "toml" else json.loads(text)
    except ValueError:  # a broken file has no dependencies
        return
    for path, shape in sections:
        part = _section(data, path)
        if shape == "map":
            for name, v in part.items() if isinstance(part, dict) else ():
                version = v.get("version", "") if isinstance(v, dict) else v
                if not (name.lower() == "python" and path.startswith("tool.poetry")):
                    yield name, "" if version == "*" else str(version)
            continue
        lists = part.values() if shape == "groups" and isinstance(part, dict) else [part]
        for entry in (e for x in lists if isinstance(x, list) for e in x):
            if m := REQUIREMENT.match(str(entry)):
                yield m[1], m[2]


def _markup(text: str, name: str) -> Iterator[tuple[str, str]]:
    """Dependencies of pom.xml and package references of .csproj files."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return
    for el in root.iter():
        tag = el.tag.rsplit("}", 1)[-1]
        if name == "pom.xml" and tag == "dependency":
            part = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in el}
            if part.get("artifactId"):
                yield ":".join(x for x in (part.get("groupId"), part["artifactId"]) if x), part.get("version", "")
        elif name != "pom.xml" and tag == "PackageReference" and el.get("Include"):
            yield el.get("Include"), el.get("Version", "")


def parse_manifest(path: str, text: str) -> list[tuple[int, str, str, str]]:
    """(position, ecosystem, name, version as written) of the dependencies a manifest names."""
    name = path.rsplit("/", 1)[-1]
    if name in STRUCTURED:
        kind, eco, sections = STRUCTURED[name]
        found: Iterator[tuple[str, str]] = _structured(text, kind, sections)
    elif name == "pom.xml" or name.endswith(".csproj"):
        eco, found = ("maven" if name == "pom.xml" else "nuget"), _markup(text, name)
    else:
        rule = next(((e, rx) for ending, e, rx in PATTERNED if re.match(ending, name)), None)
        if rule is None:
            return []
        eco = rule[0]
        if eco == "go":  # only what follows require, alone or in a block
            text = "\n".join(re.sub(r"//.*", "", x) for x in text.splitlines())
            text = "\n".join([*re.findall(r"(?m)^require[ \t]+[^(\s].*", text), *re.findall(r"(?ms)^require\s*\((.*?)^\)", text)])
        found = re.findall(rule[1], text)
    return [(i, eco, n.strip(), v.strip().removeprefix("@").strip()) for i, (n, v) in enumerate(found) if n.strip()]


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of manifest files, first per (repo, ecosystem, name): (repo, ecosystem, path, name, version).

    Sections are read as the formats define them, so package metadata and classifiers are no
    dependencies. Versions stay as written, with their operators.
    """
    parse = F.udf(parse_manifest, "array<struct<i:int,ecosystem:string,name:string,version:string>>", useArrow=True)
    is_manifest = F.col("path").rlike(r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|Pipfile|package\.json|composer\.json|go\.mod|pom\.xml|build\.gradle(\.kts)?|Gemfile|Cargo\.toml|[^/]*\.csproj)$")
    out = files.where(is_manifest & F.col("text").isNotNull()).select("repo", "path", F.explode(parse("path", "text")).alias("d")).select("repo", "path", "d.*")
    first = F.min(F.struct("path", "i", "name", "version"))
    g = out.groupBy("repo", "ecosystem", F.lower("name").alias("_k")).agg(first.alias("f"))
    return g.select("repo", "ecosystem", "f.path", "f.name", "f.version")


# Licence categories, tried in this order.
LICENCE_CATEGORIES = [
    ("non_commercial", [
        r"non[- ]?commercial", r"\bNC\b", "CC-BY-NC", "PolyForm-Noncommercial", "BUSL", "Business Source", "SSPL", "Server Side Public", r"Elastic-2\.0", "Elastic License",
        "Commons[- ]Clause", "RSALv?2?", "Redis Source Available", "Proprietary", "LicenseRef-Proprietary", "All Rights Reserved",
    ]),
    ("copyleft", [
        r"\bA?GPL\b", "GPL-?[123]", "AGPL", "LGPL", "General Public License", "Lesser General Public", "Affero", "MPL", "Mozilla Public", "EPL", "Eclipse Public", "CDDL", "CC-BY-SA",
        "ShareAlike", "OSL-3", "EUPL", "CeCILL",
    ]),
    ("permissive", [
        r"^MIT\b", "MIT License", r"\bMIT\b", "Apache", r"\bBSD\b", "BSD-[23]", "0BSD", r"\bISC\b", "PSF", "Python Software Foundation", r"Python-2\.0", "Unlicense", r"\bZlib\b", "PostgreSQL",
        "CC0", "CC-BY(?!-NC|-SA)", "Boost Software", r"BSL-1\.0", "WTFPL", "Artistic", "X11", "Public Domain", "blessing", "MIT-0", "HPND", "Ruby", "OpenSSL", "NCSA", "Zope Public", "ZPL", "AFL-", "UPL-",
    ]),
]


def licence_category(licence: Column) -> Column:
    t = F.trim(F.coalesce(licence, F.lit("")))
    out = F.when((t == "") | (F.lower(t) == "unknown"), "unknown")
    for name, pats in LICENCE_CATEGORIES:
        out = out.when(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in pats)), name)
    return out.otherwise("unknown")


def dependency_summary(deps: DataFrame) -> DataFrame:
    """Counts by category and by ecosystem per repository, one pass."""
    x = deps.select("repo", F.explode(F.array(F.struct(F.lit("category").alias("dimension"), F.col("category").alias("bucket")), F.struct(F.lit("ecosystem").alias("dimension"), F.col("ecosystem").alias("bucket")))).alias("x"))
    return x.groupBy("repo", "x.dimension", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


# ---- capabilities -------------------------------------------------------------------------
# Evidence patterns per capability, sizes and floors.
CAPABILITIES = {
    "rag": r"(?i)\b(faiss|chromadb|pgvector|pinecone|weaviate|qdrant|milvus|lancedb|embedding|embeddings|retriev\w*|bm25|rank_bm25|rerank\w*|rrf|mmr|hybrid search|reciprocal rank)\b",
    "knowledge_graph": r"(?i)\b(networkx|neo4j|rdflib|igraph|vis-network|three\.js|force-graph|forceSimulation|knowledge[_ -]?graph|entities|triples|graph_edges|GraphEdge|GraphNode)\b",
    "caching": r"(?i)\b(lru_cache|cachetools|diskcache|redis|valkey|cache_control|prompt caching|kv[ _-]?cache|paged attention|[a-z_]*cache[a-z_]*)\b",
    "auth": r"(?i)\b(login|sign_in|signin|authenticate|verify_token|jwt|oauth2?|passlib|bcrypt|flask_login|fastapi\.security|msal|saml|oidc)\b",
    "dashboard_ui": r"(?i)(\.(dashboard|kpi|card|chart|tile|panel|grid)\b|\b(plotly|chart\.js|chartjs|d3|recharts|echarts)\b|dashboard)",
    "api_service": r"(?i)\b(fastapi|flask|django|express|gin-gonic|gin\.Default|spring(?:boot|framework)?|HTTPServer|BaseHTTPRequestHandler|@app\.(get|post|route)|app\.(get|post|use)\()",
    "agent": r"(?i)\b(tool_use|tool_result|tools=|function[_ ]calling|langgraph|mcp|MCPServer|stop_reason|agent loop|ReAct|run_agent|toolrunner|tool_runner)\b",
    "data_pipeline": r"(?i)\b(airflow|prefect|dagster|luigi|cron:|schedule:|etl\b|pipeline\.run|DAG\()",
    "ml_model": r"(?i)\b(torch|tensorflow|sklearn|scikit-learn|xgboost|lightgbm|transformers|keras)\b",
}
MAX_EVIDENCE, WEAK_CAP = 8, 0.5


def capability_evidence(files: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    """Evidence lines per repository and capability, one line per file before second lines: (repo, capability, rank, path, line_no, snippet)."""
    ln = files.select("repo", "path", F.posexplode(F.split("text", r"\r?\n")).alias("i", "line")).withColumn("line_no", F.col("i") + 1)
    caps = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), c) for c, p in CAPABILITIES.items()]))
    e = ln.withColumn("caps", caps).where(F.size("caps") > 0).select("repo", "path", "line_no", F.substring(F.trim("line"), 1, 160).alias("snippet"), F.explode("caps").alias("capability"))
    w = Window.partitionBy("repo", "capability", "path").orderBy("line_no")
    e = e.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    v = Window.partitionBy("repo", "capability").orderBy(F.col("_n") > 1, "path", "line_no")
    return e.withColumn("rank", F.row_number().over(v)).where(F.col("rank") <= limit).drop("_n")


def capability_confidence(files: DataFrame, supports: dict[str, str] | None = None) -> DataFrame:
    """min(1, 0.3 + 0.15 x files with evidence) per repository; at most 0.5 without the supporting signal.

    ``supports`` maps a capability to the pattern some file of the repository must hold.
    """
    supports = supports or {}
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), c) for c, p in CAPABILITIES.items()]))
    g = files.select("repo", "path", F.explode(hits).alias("capability")).groupBy("repo", "capability").agg(F.count_distinct("path").alias("files"))
    sig = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), c) for c, p in supports.items()], F.lit(None).cast("string")))
    s = files.select("repo", F.explode(sig).alias("capability")).distinct().withColumn("_s", F.lit(True))
    j = g.join(s, ["repo", "capability"], "left")
    conf = F.round(F.least(F.lit(1.0), 0.3 + 0.15 * F.col("files")), 2)
    need = F.col("capability").isin(*supports) if supports else F.lit(False)
    return j.select("repo", "capability", "files", F.when(need & F.col("_s").isNull(), F.least(conf, F.lit(WEAK_CAP))).otherwise(conf).alias("confidence"))


# Readiness checks on paths.
READINESS = [
    ("Dockerfile", r"^Dockerfile$"), ("compose", r"^(docker-compose\.yml|compose\.ya?ml)$"), ("k8s or terraform", r"(?i)(\.tf$|(^|/)(k8s|kubernetes|helm)/|Chart\.yaml$)"),
    ("CI", r"^\.github/workflows/.*\.ya?ml$|^\.gitlab-ci\.yml$|^Jenkinsfile$"), ("tests directory", r"(^|/)(tests?|__tests__|spec)/"), ("logging or telemetry", r"(?i)(telemetry|logging|otel|opentelemetry|metrics)"),
    ("env config", r"^(\.env\.example|\.env\.sample|config\.yaml|settings\.py)$|(^|/)config/"), ("migrations", r"(^|/)(migrations|alembic|db/migrate)/"), ("load test", r"(?i)(load_?test|locust|k6|gatling)"),
    ("setup README", r"(?i)^README(\.md|\.rst)?$"), ("licence file", r"^(LICENSE(\.md|\.txt)?|LICENCE)$"),
]
TEST_FILE = r"(test_.*\.py|_test\.(py|go)|\.(test|spec)\.[jt]sx?)$"


def readiness_checklist(files: DataFrame, facts: DataFrame) -> DataFrame:
    """16 checks per repository and their percentage. ``facts``: (repo, releases, environments)."""
    p = F.col("path")
    g = files.groupBy("repo").agg(
        *[F.bool_or(p.rlike(rx)).alias(f"_{i}") for i, (_, rx) in enumerate(READINESS)], (F.count_if(p.rlike(TEST_FILE)) >= 20).alias("_tests"),
        F.bool_or(F.col("text").rlike(CAPABILITIES["auth"])).alias("_auth"), F.bool_or(F.col("text").rlike(r"(?i)rate[_ ]?limit")).alias("_rate"),
    ).join(facts, "repo", "left")
    checks = [(n, F.col(f"_{i}")) for i, (n, _) in enumerate(READINESS)]
    checks += [("tests >= 20", F.col("_tests")), ("auth", F.col("_auth")), ("rate limiting", F.col("_rate")), ("releases", F.coalesce("releases", F.lit(0)) > 0), ("multi-environment deployments", F.coalesce("environments", F.lit(0)) >= 2)]
    have = F.array_compact(F.array(*[F.when(c, n) for n, c in checks]))
    return g.select("repo", have.alias("present"), F.round(100.0 * F.size(have) / len(checks)).cast("int").alias("score"))


def repository_card(files: DataFrame, symbols: DataFrame, deps: DataFrame, caps: DataFrame) -> DataFrame:
    """One card row per repository: languages, tests, CI, containers, infrastructure and counts."""
    p = F.col("path")
    f = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set(language_of(p))).alias("languages"), F.count_if(p.rlike(TEST_FILE) | p.rlike(r"(^|/)tests?/")).alias("tests"),
        F.bool_or(p.rlike(READINESS[3][1])).alias("ci"), F.bool_or(p.rlike(r"(^|/)Dockerfile$")).alias("containers"), F.bool_or(p.rlike(READINESS[2][1])).alias("infrastructure"),
    )
    s = symbols.where("kind <> 'module'").groupBy("repo").agg(F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("docstring") != "").alias("documented"))
    d = deps.groupBy("repo").agg(F.count(F.lit(1)).alias("dependencies"))
    c = caps.groupBy("repo").agg(F.count_distinct("capability").alias("capabilities"))
    j = f.join(s, "repo", "left").join(d, "repo", "left").join(c, "repo", "left").fillna(0, ["symbols", "documented", "dependencies", "capabilities"])
    return j.withColumn("line", F.format_string("%d files, %d symbols, %d dependencies, %d capabilities", "files", "symbols", "dependencies", "capabilities"))


def cited_paths(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Cited paths of a summary that name no file or directory of the repository: (repo, section, path)."""
    parts = F.split("path", "/")
    pre = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    known = files.select("repo", F.explode(pre).alias("path")).distinct()
    want = citations.withColumn("path", F.regexp_replace("path", "/+$", ""))
    return want.join(known, ["repo", "path"], "left_anti")


def summary_line() -> Column:
    """Kind and qualified name of a symbol, and the first line of its docstring."""
    return F.concat_ws(" ", F.col("kind"), F.col("qualified"), F.when(F.col("docstring") != "", F.concat(F.lit("- "), F.element_at(F.split("docstring", "\n"), 1))))


def symbol_passages(files: DataFrame, symbols: DataFrame, branch: str = "main") -> DataFrame:
    """One passage per symbol with its own lines, a summary line and a line-anchored url."""
    s = symbols.where("kind <> 'module'").join(files.select("repo", "path", "text"), ["repo", "path"])
    body = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    url = F.format_string(f"https://github.com/%s/blob/{branch}/%s#L%d-L%d", "repo", "path", "start_line", "end_line")
    return s.select("repo", "path", "language", "kind", "symbol", "qualified", "start_line", "end_line", url.alias("url"), summary_line().alias("summary_line"), F.regexp_replace(body, r"\s+$", "").alias("text"))
