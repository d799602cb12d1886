"""Source-code queries. Each part is a small source file (language by size) and a manifest, derived from its row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codejobs as K
from ..operators import convert, graph, names, retrieval
from ..registry import query
from ..session import cut_lineage, table, wide_table

_PY = '''"""Module %k for %n."""
import os
from util.%w import helper

# TODO: check %n again
# the catalogue keeps a price for every size of this item
# and the cache is refreshed each night

class Item%k:
    """Item %k."""

    def price(self, qty):
        # NOTE: cached value
        return self.base(qty) + lookup_%k(qty)

    def base(self, qty):
        return helper(qty)


def lookup_%k(qty):
    """Look up %k in the cache."""
    login(qty)
    return cache.get(%k)
'''
_JS = "// the front end keeps one card for every item in the shop list\nexport function show%k(x) {\n  return fetch(x);\n}\nclass Card%k {\n}\nfunction draw%k() {\n  show%k(1);\n}\n"
_GO = "package m\n\nfunc Run%k(x int) int {\n\treturn helper(x)\n}\n"
_SQL = "-- FIXME: index\nCREATE TABLE t%k (a int);\nCREATE VIEW v%k AS SELECT a FROM t%k;\n"
_YML = "name: n%k\nsteps: []\n"
_EXTS = ("py", "js", "go", "sql", "yml")


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    p = wide_table(spark, sf, "part")
    form = F.col("p_size") % 5
    t = F.lit(_YML)
    for i, body in enumerate((_PY, _JS, _GO, _SQL)):
        t = F.when(form == i, body).otherwise(t)
    k = F.col("p_partkey").cast("string")
    for mark, v in (("%k", k), ("%n", F.col("p_name")), ("%w", F.element_at(F.split("p_name", " "), -1))):
        t = F.replace(t, F.lit(mark), v)
    ext = F.element_at(F.array(*[F.lit(x) for x in _EXTS]), (form + 1).cast("int"))
    repo = F.concat(F.lit("acme/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    return p.select(repo.alias("repo"), F.concat(F.lit("src/m"), k, F.lit("."), ext).alias("path"), t.alias("text"), F.col("p_partkey").alias("k"), form.alias("form"))


_SF = "sf AS (SELECT 'acme/' || lower(replace(p_brand, '#', '')) AS repo, 'src/m' || p_partkey || '.' || (['py','js','go','sql','yml'])[p_size % 5 + 1] AS path, p_partkey AS k, p_size % 5 AS form, p_name FROM part)"


_JAVA = """package org.acme.shop;
import java.util.List;

/** Keeps %n. */
@Entity
public class Shelf%k {
    private int size = 1; // } no block

    public Shelf%k(int size) { this.size = size; }

    @Override
    public String toString() {
        String open = "{";
        return label(open + size);
    }

    static class Slot {
        int depth() { return 1; }
    }
}
"""
_CS = """using System.Linq;
namespace Acme.Shop
{
    public record Price%k(int Amount);

    [Serializable]
    public class Cart%k : Base
    {
        // adds one item
        public async Task<int> Add(string item)
        {
            /* { */
            return await Store.Put(item);
        }
    }
}
"""
_TSX = """import React from 'react';
const { util } = require('./util');
export interface Props { title: string }
export abstract class Panel%k extends React.Component {
  static label = `a { ${1}`;
  render(): void {
    draw(this.props);
  }
}
export const useShop%k = async (id: number) => {
  return fetch(`/shop/${id}`);
};
"""
_GO2 = """package store

import (
\t"fmt"
)

// Box holds %n.
type Box%k struct {
\tn int
}

func (b *Box%k) Size(x int) int {
\tfmt.Println("{", x)
\treturn grow(b.n)
}
"""
_IPYNB = '{"cells": [{"cell_type": "markdown", "source": ["# Stock of %n\\n", "counted"]}, {"cell_type": "code", "source": "import pandas\\n%matplotlib inline\\ncount(%k)"}]}'


def more_files(spark: SparkSession, sf: str) -> DataFrame:
    """Five more files of every fifth part each: Java, C#, TSX, Go with types, a notebook."""
    p = wide_table(spark, sf, "part")
    form = F.col("p_partkey") % 5
    k = F.col("p_partkey").cast("string")
    t, ext = F.lit(_IPYNB), F.lit("ipynb")
    for i, (body, end) in enumerate(((_JAVA, "java"), (_CS, "cs"), (_TSX, "tsx"), (_GO2, "go"))):
        t, ext = F.when(form == i, body).otherwise(t), F.when(form == i, end).otherwise(ext)
    t = F.replace(F.replace(t, F.lit("%k"), k), F.lit("%n"), F.col("p_name"))
    repo = F.concat(F.lit("acme/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    return p.select(repo.alias("repo"), F.concat(F.lit("lib/x"), k, F.lit("."), ext).alias("path"), t.alias("text"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BODY_SQL = "replace(replace(replace(" + " ".join(["CASE sf.form"] + [f"WHEN {i} THEN {_sql_text(t)}" for i, t in enumerate((_PY, _JS, _GO, _SQL, _YML))]) + " END, '%k', k::VARCHAR), '%n', p_name), '%w', string_split(p_name, ' ')[-1])"


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return K.extract_symbols(source_files(spark, sf))


#: What the files of ``more_files`` define: form, kind, qualified name, lines, signature, doc, calls, decorators.
_DEFINED = """(VALUES
 (0, 'class', 'org.acme.shop.Shelf%k', 6, 6, 'class Shelf%k', 'Keeps %n.', '', '@Entity,public'), (0, 'method', 'org.acme.shop.Shelf%k.Shelf%k', 9, 9, 'Shelf%k(int size)', '', '', 'public'),
 (0, 'method', 'org.acme.shop.Shelf%k.toString', 12, 15, 'String toString()', '', 'label', '@Override,public'), (0, 'class', 'org.acme.shop.Shelf%k.Slot', 17, 17, 'class Slot', '', '', 'static'),
 (0, 'method', 'org.acme.shop.Shelf%k.Slot.depth', 18, 18, 'int depth()', '', '', ''), (0, 'module', 'lib.x%k', 1, 20, '', '', '', ''),
 (1, 'class', 'Acme.Shop.Price%k', 4, 4, 'record Price%k', '', '', 'public'), (1, 'class', 'Acme.Shop.Cart%k', 7, 7, 'class Cart%k', '', '', '[Serializable],public'),
 (1, 'method', 'Acme.Shop.Cart%k.Add', 10, 14, 'Task<int> Add(string item)', 'adds one item', 'Store.Put', 'public,async'), (1, 'module', 'lib.x%k', 1, 16, '', '', '', ''),
 (2, 'class', 'lib.x%k.Props', 3, 3, 'interface Props', '', '', 'export'), (2, 'class', 'lib.x%k.Panel%k', 4, 4, 'class Panel%k extends React.Component', '', '', 'export,abstract'),
 (2, 'method', 'lib.x%k.Panel%k.render', 6, 8, 'render()', '', 'draw', ''), (2, 'function', 'lib.x%k.useShop%k', 10, 12, 'useShop%k(id: number)', '', 'fetch', 'export'), (2, 'module', 'lib.x%k', 1, 12, '', '', '', ''),
 (3, 'class', 'store.Box%k', 8, 10, 'type Box%k struct', 'Box holds %n.', '', ''), (3, 'method', 'store.Box%k.Size', 12, 15, 'func (b *Box%k) Size(x int) int', '', 'fmt.Println,grow', ''), (3, 'module', 'lib.x%k', 1, 15, '', '', '', ''),
 (4, 'cell', 'lib.x%k.cell-1', 1, 2, 'markdown cell 1', '# Stock of %n' || chr(10) || 'counted', '', ''), (4, 'cell', 'lib.x%k.cell-2', 4, 6, 'code cell 2', '# Stock of %n' || chr(10) || 'counted', 'count', '')
) d(form, kind, qualified, start_line, end_line, signature, docstring, calls, decorators)"""


@query("code_definitions", "K1 C10", f"""
WITH p AS (SELECT 'acme/' || lower(replace(p_brand, '#', '')) AS repo, 'lib/x' || p_partkey || '.' || (['java','cs','tsx','go','ipynb'])[p_partkey % 5 + 1] AS path, p_partkey, p_name FROM part),
f AS (SELECT repo, path, d.*, p_partkey::VARCHAR AS k, p_name FROM p JOIN {_DEFINED} ON form = p_partkey % 5)
SELECT repo, path, kind, replace(qualified, '%k', k) AS qualified, start_line, end_line, replace(signature, '%k', k) AS signature, replace(docstring, '%n', p_name) AS docstring, calls, decorators FROM f
""")
def code_definitions(spark: SparkSession, sf: str) -> DataFrame:
    s = K.extract_symbols(more_files(spark, sf))
    return s.select("repo", "path", "kind", "qualified", "start_line", "end_line", "signature", "docstring", F.array_join("calls", ",").alias("calls"), F.array_join("decorators", ",").alias("decorators"))


@query("code_symbols", "K1", f"""
WITH {_SF}, m AS (SELECT repo, path, k, form, 'src.m' || k AS mod FROM sf)
SELECT repo, path, 'module' AS kind, mod AS qualified, 1 AS start_line, (CASE form WHEN 0 THEN 23 WHEN 1 THEN 9 WHEN 2 THEN 5 WHEN 3 THEN 3 ELSE 2 END)::INTEGER AS end_line FROM m
UNION ALL SELECT repo, path, 'class', mod || '.Item' || k, 9, 11 FROM m WHERE form = 0 UNION ALL SELECT repo, path, 'method', mod || '.Item' || k || '.price', 12, 14 FROM m WHERE form = 0 UNION ALL SELECT repo, path, 'method', mod || '.Item' || k || '.base', 16, 17 FROM m WHERE form = 0
UNION ALL SELECT repo, path, 'function', mod || '.lookup_' || k, 20, 23 FROM m WHERE form = 0
UNION ALL SELECT repo, path, 'function', mod || '.show' || k, 2, 4 FROM m WHERE form = 1 UNION ALL SELECT repo, path, 'class', mod || '.Card' || k, 5, 5 FROM m WHERE form = 1 UNION ALL SELECT repo, path, 'function', mod || '.draw' || k, 7, 9 FROM m WHERE form = 1
UNION ALL SELECT repo, path, 'function', 'm.Run' || k, 3, 5 FROM m WHERE form = 2 UNION ALL SELECT repo, path, 'statement', mod || '.t' || k, 2, 2 FROM m WHERE form = 3 UNION ALL SELECT repo, path, 'statement', mod || '.v' || k, 3, 3 FROM m WHERE form = 3
UNION ALL SELECT repo, path, 'key', mod || '.name', 1, 1 FROM m WHERE form = 4 UNION ALL SELECT repo, path, 'key', mod || '.steps', 2, 2 FROM m WHERE form = 4
""")
def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).select("repo", "path", "kind", "qualified", "start_line", "end_line")


@query("symbol_passages", "C10", f"""
WITH {_SF}, y(form, symbol, kind, tail, a, b, doc) AS (VALUES (0, 'Item%k', 'class', 'Item%k', 9, 11, 'Item %k.'), (0, 'price', 'method', 'Item%k.price', 12, 14, ''), (0, 'base', 'method', 'Item%k.base', 16, 17, ''), (0, 'lookup_%k', 'function', 'lookup_%k', 20, 23, 'Look up %k in the cache.'),
 (1, 'show%k', 'function', 'show%k', 2, 4, 'the front end keeps one card for every item in the shop list'), (1, 'Card%k', 'class', 'Card%k', 5, 5, ''), (1, 'draw%k', 'function', 'draw%k', 7, 9, ''), (2, 'Run%k', 'function', 'Run%k', 3, 5, ''),
 (3, 't%k', 'statement', 't%k', 2, 2, ''), (3, 'v%k', 'statement', 'v%k', 3, 3, ''), (4, 'name', 'key', 'name', 1, 1, ''), (4, 'steps', 'key', 'steps', 2, 2, '')),
x AS (SELECT repo, path, sf.form, k::VARCHAR AS ks, y.*, {_BODY_SQL} AS body FROM sf JOIN y ON y.form = sf.form)
SELECT path, replace(symbol, '%k', ks) AS symbol, 'https://github.com/' || repo || '/blob/main/' || path || '#L' || a || '-L' || b AS url,
 kind || ' ' || CASE WHEN x.form = 2 THEN 'm.' ELSE 'src.m' || ks || '.' END || replace(tail, '%k', ks) || CASE WHEN doc <> '' THEN ' - ' || replace(doc, '%k', ks) ELSE '' END AS summary_line,
 regexp_replace(array_to_string(string_split(body, chr(10))[a:b], chr(10)), '\\s+$', '') AS text FROM x
""")
def symbol_passages(spark: SparkSession, sf: str) -> DataFrame:
    p = K.symbol_passages(source_files(spark, sf), symbols(spark, sf))
    return p.select("path", "symbol", "url", "summary_line", "text")


@query("code_windows", "C11", f"""
WITH {_SF}, y(form, symbol, a, b) AS (VALUES (0, 'module', 1, 8), (0, 'Item%k', 9, 11), (0, 'price', 12, 15), (0, 'base', 16, 19), (0, 'lookup_%k', 20, 24), (1, 'module', 1, 1), (1, 'show%k', 2, 4), (1, 'Card%k', 5, 6), (1, 'draw%k', 7, 10),
 (2, 'module', 1, 2), (2, 'Run%k', 3, 6), (3, 'module', 1, 4), (4, 'module', 1, 3))
SELECT path, replace(symbol, '%k', k::VARCHAR) AS symbol, a AS start_line, b AS end_line FROM sf JOIN y USING (form)
""")
def code_windows(spark: SparkSession, sf: str) -> DataFrame:
    return convert.code_windows(source_files(spark, sf)).select("path", "symbol", "start_line", "end_line")


@query("code_comments", "K2 J12", f"""
WITH {_SF} SELECT path, 5 AS line_no, 'todo' AS kind, NULL AS symbol FROM sf WHERE form = 0 UNION ALL SELECT path, 13, 'note', 'src.m' || k || '.Item' || k || '.price' FROM sf WHERE form = 0
UNION ALL SELECT path, 1, 'docstring', 'src.m' || k FROM sf WHERE form = 0 UNION ALL SELECT path, 9, 'docstring', 'src.m' || k || '.Item' || k FROM sf WHERE form = 0 UNION ALL SELECT path, 20, 'docstring', 'src.m' || k || '.lookup_' || k FROM sf WHERE form = 0
UNION ALL SELECT path, 1, 'line', NULL FROM sf WHERE form = 1 UNION ALL SELECT path, 1, 'fixme', NULL FROM sf WHERE form = 3
""")
def code_comments(spark: SparkSession, sf: str) -> DataFrame:
    s = cut_lineage(symbols(spark, sf))
    return K.extract_comments(source_files(spark, sf), s).select("path", "line_no", "kind", "symbol")


@query("call_graph", "G30", f"""
WITH {_SF}, m AS (SELECT repo, k, 'src.m' || k AS mod FROM sf WHERE form = 0), j AS (SELECT repo, k, 'src.m' || k AS mod FROM sf WHERE form = 1)
SELECT repo, mod || '.Item' || k || '.price' AS src, mod || '.Item' || k || '.base' AS dst FROM m UNION ALL SELECT repo, mod || '.Item' || k || '.price', mod || '.lookup_' || k FROM m UNION ALL SELECT repo, mod || '.draw' || k, mod || '.show' || k FROM j
""")
def call_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_graph(cut_lineage(symbols(spark, sf)))


@query("call_degrees", "G31", f"""
WITH {_SF}, e AS (SELECT repo, 'src.m' || k || '.Item' || k || '.price' AS q, 2 AS d FROM sf WHERE form = 0 UNION ALL SELECT repo, 'src.m' || k || '.Item' || k || '.base', 1 FROM sf WHERE form = 0 UNION ALL SELECT repo, 'src.m' || k || '.lookup_' || k, 1 FROM sf WHERE form = 0
 UNION ALL SELECT repo, 'src.m' || k || '.draw' || k, 1 FROM sf WHERE form = 1 UNION ALL SELECT repo, 'src.m' || k || '.show' || k, 1 FROM sf WHERE form = 1)
SELECT repo, q AS qualified, d::BIGINT AS degree, row_number() OVER (PARTITION BY repo ORDER BY d DESC, q)::INTEGER AS rank FROM e QUALIFY rank <= 30
""")
def call_degrees(spark: SparkSession, sf: str) -> DataFrame:
    s = cut_lineage(symbols(spark, sf)).withColumnRenamed("kind", "symbol_kind")
    e = graph.call_graph(s.withColumn("kind", F.col("symbol_kind")))
    return graph.call_degrees(s, e).select("repo", "qualified", "degree", "rank")


_MANIFESTS = (
    ("requirements.txt", "# pinned\n%w==1.%s\n-r other.txt\nrequests[socks]>=2 ; python_version > '3'\n"),
    ("package.json", '{"name": "x", "version": "1", "dependencies": {"%w": "^2.%s"}, "devDependencies": {"jest": "~29"}, "peerDependencies": {"react": "18"}}'),
    ("pom.xml", "<project xmlns='urn:m'><version>9</version><dependencies><dependency><groupId>org.acme</groupId><artifactId>%w</artifactId><version>3</version></dependency></dependencies></project>"),
    ("pyproject.toml", '[project]\nname = "x"\nversion = "1"\nclassifiers = [\n  "Programming Language :: Python :: 3",\n]\ndependencies = ["%w[all]>=1.%s", "numpy"]\n[project.optional-dependencies]\ntest = ["pytest~=8"]\n[tool.poetry.dependencies]\npython = "^3.12"\nhttpx = {version = "0.27"}\n'),
    ("Pipfile", '[packages]\n%w = "*"\nflask = "==3.%s"\n[dev-packages]\nblack = {version = "24"}\n'),
    ("Cargo.toml", '[package]\nname = "x"\nversion = "0.1"\nedition = "2021"\n[dependencies]\n%w = "1.%s"\n[dev-dependencies]\nserde = {version = "1", features = ["derive"]}\n'),
    ("go.mod", "module a/b\ngo 1.22\nrequire c.io/%w v1.%s // direct\nrequire (\n\tgithub.com/x/y v2\n)\nreplace q.io/z => ../z\n"),
    ("build.gradle.kts", 'plugins { id("a") }\nimplementation("org.g:%w:4.%s")\ntestImplementation("junit:junit")\n'),
    ("Gemfile", "source 'https://r'\ngem '%w', '~> 5.%s'\ngem \"rails\"\n"),
    ("app.csproj", '<Project><ItemGroup><PackageReference Include="%w" Version="6.%s" /><PackageReference Include="Serilog" /></ItemGroup></Project>'),
)
# what each of them names, in order: ecosystem, position, name, version
_NAMED = (
    (0, "pypi", 0, "%w", "==1.%s"), (0, "pypi", 1, "requests", ">=2"), (1, "npm", 0, "%w", "^2.%s"), (1, "npm", 1, "jest", "~29"), (1, "npm", 2, "react", "18"),
    (2, "maven", 0, "org.acme:%w", "3"), (3, "pypi", 0, "%w", ">=1.%s"), (3, "pypi", 1, "numpy", ""), (3, "pypi", 2, "pytest", "~=8"), (3, "pypi", 3, "httpx", "0.27"),
    (4, "pypi", 0, "%w", ""), (4, "pypi", 1, "flask", "==3.%s"), (4, "pypi", 2, "black", "24"), (5, "cargo", 0, "%w", "1.%s"), (5, "cargo", 1, "serde", "1"),
    (6, "go", 0, "c.io/%w", "v1.%s"), (6, "go", 1, "github.com/x/y", "v2"), (7, "maven", 0, "org.g:%w", "4.%s"), (7, "maven", 1, "junit:junit", ""),
    (8, "rubygems", 0, "%w", "~> 5.%s"), (8, "rubygems", 1, "rails", ""), (9, "nuget", 0, "%w", "6.%s"), (9, "nuget", 1, "Serilog", ""),
)


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest per part, its kind by size."""
    p = table(spark, sf, "part")
    form = F.col("p_size") % len(_MANIFESTS)
    pick = lambda j: F.element_at(F.array(*[F.lit(m[j]) for m in _MANIFESTS]), (form + 1).cast("int"))
    text = F.replace(F.replace(pick(1), F.lit("%w"), F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("%s"), F.col("p_size").cast("string"))
    path = F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/"), pick(0))
    return p.select(F.concat(F.lit("acme/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("repo"), path.alias("path"), text.alias("text"))


_K3 = " UNION ALL ".join(
    f"SELECT repo, '{eco}' AS ecosystem, 'm' || k || '/{_MANIFESTS[f][0]}' AS path, {i} AS i, replace('{n}', '%w', w) AS name, replace('{v}', '%s', p_size::VARCHAR) AS version FROM p WHERE form = {f}"
    for f, eco, i, n, v in _NAMED
)


@query("manifest_dependencies", "K3", f"""
WITH p AS (SELECT 'acme/' || lower(replace(p_brand, '#', '')) AS repo, p_partkey::VARCHAR AS k, replace(p_name, ' ', '-') AS w, p_size, p_size % {len(_MANIFESTS)} AS form FROM part), d AS ({_K3})
SELECT repo, ecosystem, path, name, version FROM d QUALIFY row_number() OVER (PARTITION BY repo, ecosystem, lower(name) ORDER BY path, i, name, version) = 1
""")
def manifest_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return K.manifest_dependencies(manifests(spark, sf))


@query("licence_lines", "K4", """
WITH l AS (SELECT doc_id, unnest(string_split(text, e'\\n')) AS line FROM documents), h AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '(?i)licen[cs]e|copyright|spdx')),
c AS (SELECT doc_id, CASE WHEN regexp_matches(line, '(?i)non[- ]?commercial|\\bNC\\b|BUSL|Business Source|SSPL|Server Side Public|Elastic-2\\.0|Elastic License|Commons[- ]Clause|RSALv?2?|Redis Source Available|Proprietary|All Rights Reserved') THEN 'non_commercial'
 WHEN regexp_matches(line, '(?i)\\bA?GPL\\b|GPL-?[123]|AGPL|LGPL|General Public License|Lesser General Public|Affero|MPL|Mozilla Public|EPL|Eclipse Public|CDDL|CC-BY-SA|ShareAlike|OSL-3|EUPL|CeCILL') THEN 'copyleft'
 WHEN regexp_matches(line, '(?i)\\bMIT\\b|MIT License|Apache|\\bBSD\\b|BSD-[23]|0BSD|\\bISC\\b|PSF|Python Software Foundation|Python-2\\.0|Unlicense|\\bZlib\\b|PostgreSQL|CC0|CC-BY|Boost Software|BSL-1\\.0|WTFPL|Artistic|X11|Public Domain|blessing|MIT-0|HPND|Ruby|OpenSSL|NCSA|Zope Public|ZPL|AFL-|UPL-') THEN 'permissive' ELSE 'unknown' END AS category FROM h)
SELECT doc_id, category, count(*)::BIGINT AS lines FROM c GROUP BY ALL
""")
def licence_lines(spark: SparkSession, sf: str) -> DataFrame:
    from .common import documents

    ln = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("(?i)licen[cs]e|copyright|spdx"))
    return ln.groupBy("doc_id", K.licence_category(F.col("line")).alias("category")).agg(F.count(F.lit(1)).alias("lines"))


@query("capability_evidence", "K6", f"""
WITH {_SF}, e AS (SELECT repo, path, 'caching' AS capability, unnest([7, 13, 21, 23]) AS line_no FROM sf WHERE form = 0 UNION ALL SELECT repo, path, 'auth', 22 FROM sf WHERE form = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY repo, capability, path ORDER BY line_no) AS n FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY repo, capability ORDER BY n > 1, path, line_no) AS rank FROM n WHERE n <= 8)
SELECT repo, capability, path, line_no::INTEGER AS line_no, rank::INTEGER AS rank FROM r WHERE rank <= 8
""")
def capability_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = K.capability_evidence(source_files(spark, sf)).where("capability in ('caching', 'auth')")
    return e.select("repo", "capability", "path", "line_no", "rank")


@query("capability_confidence", "K7", f"""
WITH {_SF}, g AS (SELECT repo, count(*) AS n FROM sf WHERE form = 0 GROUP BY 1) SELECT repo, c AS capability, n::BIGINT AS files, CASE WHEN c = 'auth' THEN least(5e-1, round(least(1e0, 3e-1 + 15e-2 * n), 2)) ELSE round(least(1e0, 3e-1 + 15e-2 * n), 2) END AS confidence FROM g, (SELECT unnest(['caching', 'auth']) AS c)
""")
def capability_confidence(spark: SparkSession, sf: str) -> DataFrame:
    c = K.capability_confidence(source_files(spark, sf), {"auth": r"\bpassword\b", "caching": r"\bcache\.get\b"})
    return c.where("capability in ('caching', 'auth')")


@query("readiness_checklist", "K8", f"""
WITH {_SF}, f AS (SELECT repo, bool_or(form = 0) AS py, count(*) AS n FROM sf GROUP BY 1) SELECT repo, CASE WHEN py THEN 'auth,releases' ELSE 'releases' END AS present, round(1e2 * CASE WHEN py THEN 2 ELSE 1 END / 16)::INTEGER AS score FROM f
""")
def readiness_checklist(spark: SparkSession, sf: str) -> DataFrame:
    f = source_files(spark, sf)
    facts = f.groupBy("repo").agg(F.count(F.lit(1)).alias("releases"), F.lit(1).alias("environments"))
    return K.readiness_checklist(f, facts).withColumn("present", F.array_join("present", ","))


@query("repository_cards", "K9", f"""
WITH {_SF}, g AS (SELECT repo, count(*) AS files, sum(CASE form WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END) AS symbols, sum(CASE form WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS documented, string_agg(DISTINCT (['python','javascript','go','sql','yaml'])[form + 1], ',' ORDER BY (['python','javascript','go','sql','yaml'])[form + 1]) AS languages FROM sf GROUP BY 1)
SELECT repo, files::BIGINT AS files, symbols::BIGINT AS symbols, documented::BIGINT AS documented, languages FROM g
""")
def repository_cards(spark: SparkSession, sf: str) -> DataFrame:
    f = source_files(spark, sf)
    c = K.repository_card(f, symbols(spark, sf), K.manifest_dependencies(manifests(spark, sf)), K.capability_confidence(f))
    return c.select("repo", "files", "symbols", "documented", F.array_join("languages", ",").alias("languages"))


@query("cited_paths", "K10", f"""
WITH {_SF}, c AS (SELECT DISTINCT repo, 'components' AS section, CASE WHEN k % 3 = 0 THEN path WHEN k % 3 = 1 THEN 'src' ELSE 'lib/m' || k || '.py' END AS path FROM sf) SELECT repo, section, path FROM c WHERE path LIKE 'lib/%'
""")
def cited_paths(spark: SparkSession, sf: str) -> DataFrame:
    f = source_files(spark, sf)
    c = f.select("repo", F.lit("components").alias("section"), F.when(F.col("k") % 3 == 0, F.col("path")).when(F.col("k") % 3 == 1, "src/").otherwise(F.concat(F.lit("lib/m"), F.col("k").cast("string"), F.lit(".py"))).alias("path")).distinct()
    return K.cited_paths(c, f.select("repo", "path"))


def code_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Code passages with numeric ids."""
    p = K.symbol_passages(source_files(spark, sf), symbols(spark, sf)).where("language in ('python', 'javascript', 'go')")
    return cut_lineage(p.select(F.xxhash64("repo", "qualified").alias("passage_id"), F.xxhash64("repo", "path").alias("document_id"), "repo", "symbol", "qualified", "path", "summary_line", "text", F.col("summary_line").alias("docstring")))


def code_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per part naming its symbol."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("query_id"), F.concat(F.when(F.col("p_size") % 5 == 0, "where is lookup").when(F.col("p_size") % 5 == 1, "what does draw").otherwise("how does Run"), F.col("p_partkey").cast("string"), F.lit(" work in m"), F.col("p_partkey").cast("string")).alias("text"))


def brand_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per brand, naming the first look-up function of its files."""
    p = table(spark, sf, "part").where("p_size % 5 = 0").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.min_by("p_name", "p_partkey").alias("n"))
    return p.select(F.col("k").alias("query_id"), F.concat(F.lit("where is lookup_"), F.col("k").cast("string"), F.lit(" for the price of "), "n").alias("text"))


def _qtok(q: DataFrame) -> DataFrame:
    from ..functions.text import content_tokens

    return q.select("query_id", F.explode(content_tokens("text")).alias("token")).where("length(token) >= 3")


@query("identifier_scores", "R31", f"""
WITH {_SF}, sy AS (SELECT repo, path, k, CASE form WHEN 0 THEN unnest(['Item' || k, 'price', 'base', 'lookup_' || k]) WHEN 1 THEN unnest(['show' || k, 'Card' || k, 'draw' || k, NULL]) ELSE unnest(['Run' || k, NULL, NULL, NULL]) END AS symbol, CASE form WHEN 0 THEN unnest(['Item' || k, 'Item' || k || '.price', 'Item' || k || '.base', 'lookup_' || k]) WHEN 1 THEN unnest(['show' || k, 'Card' || k, 'draw' || k, NULL]) ELSE unnest(['Run' || k, NULL, NULL, NULL]) END AS tail FROM sf WHERE form < 3),
s AS (SELECT lower(symbol) AS symbol, lower(CASE WHEN path LIKE '%.go' THEN 'm.' ELSE 'src.m' || k || '.' END || tail) AS qualified, path FROM sy WHERE symbol IS NOT NULL),
q AS (SELECT p_partkey AS query_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(CASE p_size % 5 WHEN 0 THEN 'where is lookup' WHEN 1 THEN 'what does draw' ELSE 'how does Run' END || p_partkey || ' work in m' || p_partkey), '[a-z0-9]+')), lambda t: length(t) >= 3 AND t NOT IN ('where','what','does','how','the'))) AS t FROM part),
v AS (SELECT DISTINCT t FROM q), h AS (SELECT t, s.qualified, s.path, CASE WHEN contains(s.symbol, t) THEN 3 WHEN contains(s.qualified, t) THEN 2 WHEN contains(lower(s.path), t) THEN 1 ELSE 0 END AS w FROM v JOIN s ON contains(s.qualified, t) OR contains(lower(s.path), t))
SELECT query_id, count(*)::BIGINT AS hits, sum(sc)::DOUBLE AS total FROM (SELECT query_id, qualified, path, sum(w) AS sc FROM q JOIN h USING (t) GROUP BY ALL) GROUP BY query_id
""")
def identifier_scores(spark: SparkSession, sf: str) -> DataFrame:
    h = retrieval.identifier_hits(_qtok(code_questions(spark, sf)).distinct(), code_assets(spark, sf), {"symbol": 3, "qualified": 2, "path": 1}, first_only=True)
    return h.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("total"))


@query("code_answers", "R32 R31")
def code_answers(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.code_answer(_qtok(brand_questions(spark, sf)), code_assets(spark, sf), "code")


@query("asset_search", "R33")
def asset_search(spark: SparkSession, sf: str) -> DataFrame:
    a, q = code_assets(spark, sf), brand_questions(spark, sf)
    lex = retrieval.bm25_topk(q.withColumn("accessible", F.array(F.lit("public"))), a.select("passage_id", "text").withColumn("acl", F.array(F.lit("public"))), 40)
    return retrieval.asset_search(lex, _qtok(q), a, 6)


@query("symbol_search", "R38 A15")
def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    # what code_assets has of a symbol, without the join with its file for the lines
    files = source_files(spark, sf).where(K.language_of(F.col("path")).isin("python", "javascript", "go"))
    s = K.extract_symbols(files).where("kind <> 'module'")
    s = s.select(F.xxhash64("repo", "qualified").alias("symbol_id"), "repo", "path", "symbol", "qualified", K.summary_line().alias("docstring"))
    return names.find_symbols(brand_questions(spark, sf), cut_lineage(s))


@query("symbol_examples", "A15", f"""
WITH {_SF}, s AS (SELECT 'price' AS symbol, repo, path, 'src.m' || k || '.Item' || k || '.price' AS qualified FROM sf WHERE form = 0 UNION ALL SELECT 'base', repo, path, 'src.m' || k || '.Item' || k || '.base' FROM sf WHERE form = 0)
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY repo, path, qualified)::INTEGER AS rank FROM s QUALIFY rank <= 3
""")
def symbol_examples(spark: SparkSession, sf: str) -> DataFrame:
    return names.symbol_examples(symbols(spark, sf).where("kind = 'method'"))
