"""Typed sheets from delimited text.

Raw sheets are long tables (sheet_id, row, col, value) of text cells, many sheets at once. Header,
names and types are aggregates per sheet or column over all cells.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import per_key, shuffled

# Number forms; calls that leave the engine; the kinds of plan node that a query is made of.
INT = r"^[+-]?\d{1,18}$"
NUMBER = r"^[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?%?$"
CALLS_OUT = ("REFLECT", "TRY_REFLECT", "JAVA_METHOD")
QUERY_NODES = (
    "UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation OneRowRelation UnresolvedInlineTable LocalRelation Project Filter UnresolvedHaving "
    "Aggregate Window WithWindowDefinition Sort Distinct GlobalLimit LocalLimit Offset Join LateralJoin Generate Union Except Intersect Pivot Unpivot UnresolvedPivot UnresolvedUnpivot Sample"
).split()


def cells(rows: DataFrame, sheet: str, row: str, values: str) -> DataFrame:
    """Long form of (sheet, row number, array of cells)."""
    return rows.select(F.col(sheet).alias("sheet_id"), F.col(row).alias("row"), F.posexplode(values).alias("col", "value"))


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def is_number(c: Column) -> Column:
    return F.trim(c).rlike(NUMBER)


def detect_header(long: DataFrame) -> DataFrame:
    """(sheet_id, first_row, width, had_header): header when the first row is all text and either a
    number appears below it or its cells are unique."""
    filled = long.where(~_blank(F.col("value")))
    first = filled.groupBy("sheet_id").agg(F.min("row").alias("first_row"))
    width = long.groupBy("sheet_id").agg((F.max("col") + 1).alias("width"))
    j = long.join(per_key(cut_lineage(first)), "sheet_id").where("row >= first_row")
    top = F.col("row") == F.col("first_row")
    g = j.groupBy("sheet_id", "first_row").agg(
        F.count_if(top & ~_blank(F.col("value"))).alias("filled"), F.bool_and(F.when(top, ~_blank(F.col("value")) & ~is_number(F.col("value")))).alias("textual"),
        F.bool_or(~top & is_number(F.col("value"))).alias("below"), F.count_distinct(F.when(top, F.lower(F.trim("value")))).alias("names"),
    ).join(shuffled(width), "sheet_id")
    head = F.col("textual") & (F.col("filled") == F.col("width")) & (F.coalesce("below", F.lit(False)) | (F.col("names") == F.col("width")))
    return cut_lineage(g.select("sheet_id", "first_row", "width", F.coalesce(head, F.lit(False)).alias("had_header")))


def column_names(long: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet_id, col, name): collapsed whitespace, empty to colN, repeats get _2, _3."""
    top = long.join(per_key(headers), "sheet_id").where("row = first_row")
    base = F.coalesce(F.nullif(F.trim(F.regexp_replace("value", r"\s+", " ")), F.lit("")), F.concat(F.lit("col"), (F.col("col") + 1).cast("string")))
    named = top.select("sheet_id", "col", F.when(F.col("had_header"), base).otherwise(F.concat(F.lit("col"), (F.col("col") + 1).cast("string"))).alias("base"))
    w = Window.partitionBy("sheet_id", F.lower("base")).orderBy("col")
    n = named.withColumn("_n", F.row_number().over(w))
    return n.select("sheet_id", "col", F.when(F.col("_n") > 1, F.concat_ws("_", "base", F.col("_n").cast("string"))).otherwise(F.col("base")).alias("name"))


def body(long: DataFrame, headers: DataFrame) -> DataFrame:
    j = long.join(per_key(headers.select("sheet_id", "first_row", "had_header")), "sheet_id")
    return j.where(F.col("row") >= F.col("first_row") + F.col("had_header").cast("int")).drop("first_row", "had_header")


def column_types(cells_: DataFrame) -> DataFrame:
    """(sheet_id, col, type): int, real or text over all non-empty cells of the column."""
    v = F.trim(F.col("value"))
    c = cells_.where(~_blank(F.col("value"))).groupBy("sheet_id", "col").agg(
        F.bool_and(F.regexp_replace(v, ",", "").rlike(INT)).alias("i"), F.bool_and(is_number(v)).alias("n")
    )
    t = c.select("sheet_id", "col", F.when(F.col("i"), "int").when(F.col("n"), "real").otherwise("text").alias("_t"))
    return cells_.select("sheet_id", "col").distinct().join(t, ["sheet_id", "col"], "left").select("sheet_id", "col", F.coalesce("_t", F.lit("text")).alias("type"))


def coerce(value: Column, ctype: Column) -> tuple[Column, Column]:
    """(number or null, text or null): commas go, % divides by 100, what fails to parse stays as trimmed text."""
    t = F.trim(value)
    plain = F.regexp_replace(t, ",", "")
    num = F.when(plain.endswith("%"), F.expr("null").cast("double")).otherwise(plain.try_cast("double"))
    num = F.when(plain.endswith("%"), F.regexp_replace(plain, "%$", "").try_cast("double") / 100.0).otherwise(num)
    num = F.when(ctype == "int", F.when(plain.rlike(INT), num)).when(ctype == "real", num)
    return F.when(~_blank(value), num), F.when(~_blank(value) & num.isNull(), t)


def numeric_ranges(cells_: DataFrame, types: DataFrame) -> DataFrame:
    """Min and max per numeric column."""
    j = cells_.join(per_key(cut_lineage(types)), ["sheet_id", "col"]).where(F.col("type") != "text")
    n, _ = coerce(F.col("value"), F.col("type"))
    return j.select("sheet_id", "col", n.alias("n")).where("n is not null").groupBy("sheet_id", "col").agg(F.min("n").alias("min"), F.max("n").alias("max"))


def row_passages(cells_: DataFrame, names: DataFrame, cap: int | None = None) -> DataFrame:
    """``col: value; ...`` per row, blanks skipped. ``cap`` limits rows per sheet when given."""
    c = cells_ if cap is None else cells_.where(F.col("row") <= cap)
    j = c.where(~_blank(F.col("value"))).join(per_key(cut_lineage(names)), ["sheet_id", "col"])
    g = j.groupBy("sheet_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.concat_ws(": ", "name", F.trim("value")).alias("t")))).alias("p"))
    return g.select("sheet_id", "row", F.array_join(F.transform("p", lambda x: x["t"]), "; ").alias("passage"))


def sheet_summary(cells_: DataFrame, names: DataFrame, ranges: DataFrame, title: str = "sheet") -> DataFrame:
    """One sentence per sheet: rows x columns, names, numeric ranges."""
    rows = cells_.groupBy("sheet_id").agg(F.count_distinct("row").alias("rows"))
    fmt = lambda c: F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    c = names.join(ranges, ["sheet_id", "col"], "left").groupBy("sheet_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("col", "name"))).alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("min").isNotNull(), F.struct("col", F.concat("name", F.lit(" min "), fmt(F.col("min")), F.lit(" max "), fmt(F.col("max"))).alias("t"))))).alias("rg"),
    )
    j = rows.join(c, "sheet_id")
    rg = F.when(F.size("rg") > 0, F.concat(F.lit(" Numeric ranges: "), F.array_join(F.transform("rg", lambda x: x["t"]), "; "), F.lit("."))).otherwise("")
    txt = F.concat(F.lit("Sheet '"), F.col("sheet_id"), F.lit(f"' of {title}: "), F.col("rows").cast("string"), F.lit(" rows × "), F.col("n").cast("string"), F.lit(" columns ("), F.array_join(F.transform("names", lambda x: x["name"]), ", "), F.lit(")."), rg)
    return j.select("sheet_id", txt.alias("summary"))


def describe(df: DataFrame, sample: int = 5) -> tuple[list[tuple[str, str]], DataFrame, DataFrame]:
    """Columns with types, row count and sample rows of a typed sheet."""
    return df.dtypes, df.agg(F.count(F.lit(1)).alias("rows")), df.limit(sample)


class TableQueryError(ValueError):
    pass


# One pass from the left, so that a quote in a comment or a comment mark in a string opens nothing.
_LITERALS = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|(?P<mark>--|/\*|['\"`])")


def check_select(sql: str) -> str:
    """The statement without its closing semicolon; raises TableQueryError unless it begins as one query.

    Comments, backslashes and unclosed literals are refused, so that this reading and Spark's cannot
    differ. What the statement does and which tables it reads is checked on its plan.
    """
    if not isinstance(sql, str) or not sql.strip():
        raise TableQueryError("empty SQL")
    if "\\" in sql or any(m["mark"] for m in _LITERALS.finditer(sql)):
        raise TableQueryError("comments, backslashes and open quotes are not allowed")
    bare = _LITERALS.sub(" '' ", sql)
    if ";" in bare.rstrip().rstrip(";"):
        raise TableQueryError("multiple statements are not allowed")
    words = re.findall(r"[A-Za-z_]\w*", bare)
    if not words or words[0].upper() not in ("SELECT", "WITH"):
        raise TableQueryError("only a single SELECT statement is allowed")
    for w in words:
        if w.upper() in CALLS_OUT:
            raise TableQueryError(f"'{w}' is not allowed in a table query")
    return sql.strip().rstrip(";")


def _only_query_nodes(df: DataFrame, sql: str) -> None:
    """Parse ``sql`` without running it; raise unless every node of the parsed plan, at any depth, only reads.

    Spark runs a command as soon as its statement is given to ``sql``, so this comes before. Kinds of node
    that are not listed are refused: inserts, commands, scripts, table functions, hints.
    """
    try:
        plan = df.sparkSession._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise TableQueryError(str(e)) from e
    todo = [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName().rstrip("$")
        if kind not in QUERY_NODES:
            raise TableQueryError(f"{kind} is not allowed in a table query")
        for group in (p.children(), p.innerChildren(), p.subqueries()):
            for x in (group.apply(i) for i in range(group.size())):
                todo.append(x)


def _relations(plan) -> list:  # noqa: ANN001  a plan of the JVM
    """Leaf relations of an analysed plan and of the subqueries in its expressions."""
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        kids, inner = p.children(), p.subqueries()
        todo += [x.apply(i) for x in (kids, inner) for i in range(x.size())]
        if kids.size() == 0:
            out.append(p)
    return out


def _only_reads(out: DataFrame, df: DataFrame) -> DataFrame:
    """``out`` if it reads nothing but what ``df`` reads (or no relation at all)."""
    allowed = _relations(df._jdf.queryExecution().analyzed())
    for leaf in _relations(out._jdf.queryExecution().analyzed()):
        kind = leaf.nodeName()
        if kind not in ("OneRowRelation", "CTERelationRef") and not any(leaf.sameResult(x) for x in allowed):
            raise TableQueryError(f"only the table 't' may be queried (saw {kind})")
    return out


def table_query(df: DataFrame, sql: str) -> DataFrame:
    """Run a checked SELECT over ``df`` as table ``t``. Only ``t`` and the statement's own names can be read.

    ``t`` is a common table expression of the statement itself, so no view of the session is set or
    replaced; a statement that does anything but read, at any depth, is refused after parsing, and any
    other relation in the analysed plan before anything runs.
    """
    stmt = check_select(sql)
    rest = re.sub(r"(?i)^WITH\b(?!\s*RECURSIVE\b)", "", stmt)
    whole = f"{', ' if rest != stmt else ' '}{rest}"
    _only_query_nodes(df, f"WITH t AS (SELECT * FROM rows){whole}")
    try:
        out = df.sparkSession.sql("WITH t AS (SELECT * FROM {rows})" + whole.replace("{", "{{").replace("}", "}}"), rows=df)
    except AnalysisException as e:
        raise TableQueryError(str(e)) from e
    return _only_reads(out, df)


def table_page(df: DataFrame, sql: str, max_rows: int) -> tuple[DataFrame, bool]:
    """The first ``max_rows`` rows of a table query, and whether there were more."""
    out = table_query(df, sql)
    return out.limit(max_rows), out.limit(max_rows + 1).count() > max_rows
