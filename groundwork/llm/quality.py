"""Quality rules with adaptive thresholds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_of, stage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: What a group's parent (its language, or the corpus) counts for in the group's quantiles, in documents.
PARENT_DOCS = 200
#: Word length differs by language, so a language's own figures stand alone; its reach is widened as if by so many documents of doubt.
DOUBT_DOCS = 50
#: How many spreads (the distance of the quartiles, or the least spread if larger) a word length may lie from the median.
SPREADS, LEAST_SPREAD = 6, 25
#: The other metrics are zero in most documents, so their bounds come from the upper tail: this much above the mean of the TAIL percentiles.
ABOVE_TAIL = {"symbols": 50, "dup_lines": 250, "repeats": 150}
METRICS = ("word_length", *ABOVE_TAIL)
QUARTILES, TAIL = (25, 50, 75), (80, 85, 90, 95)
WHITE = r"[\x20\x09-\x0D]"


def _bind(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value computed once, also where it is used inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside those windows of WINDOW words that occur twice or more in the text."""

    def positions(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(_bind(marked, twice), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(positions(h)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    some = _bind(_bind(hashed, windows), count)
    return F.when(F.size(words) > WINDOW, some).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with _words .. columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, _n_lines.

    Two windows of eight words count as the same if 64-bit hashes of their words agree.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    words = F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")
    # the arrays are used several times: they are bound once per row and the counts leave as one struct
    counts = _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    line_counts = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("_n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.withColumns({"_w": counts, "_l": line_counts})
    word_chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return out.withColumns({
        "n_words": F.col("_w.n_words"), "word_chars": word_chars.cast("long"), "n_symbols": symbols.cast("long"),
        "n_dup_lines": F.col("_l.n_dup_lines"), "n_repeat_words": F.col("_w.n_repeat_words"), "_n_lines": F.col("_l._n_lines"),
    }).drop("_w", "_l")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def metrics() -> dict[str, Column]:
    """The judged metrics as whole numbers: characters a word times 100, the others in thousandths."""
    per = lambda a, times, b: F.expr(f"({times} * {a}) div greatest({b}, 1L)")
    return {
        "word_length": per("word_chars", 100, "n_words"), "symbols": per("n_symbols", 1000, "n_words"),
        "dup_lines": per("n_dup_lines", 1000, "_n_lines"), "repeats": per("n_repeat_words", 1000, "n_words"),
    }


def sketch(measured: DataFrame) -> DataFrame:
    """Mergeable quantile sketches: (_lang, _source, metric, bucket, n), merged by adding up n.

    Values below 1024 are their own bucket, larger ones fall into 64 buckets per doubling, so a sketch
    has a few thousand rows at most and its error is below 1.1 % of the value.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_m_{m}").alias("v")) for m in METRICS]))
    rows = measured.select("_lang", "_source", each.alias("x")).select("_lang", "_source", "x.*")
    bucket = F.when(F.col("v") < 1024, F.col("v")).otherwise(1024 + F.floor(64 * F.log2(F.col("v") / 1024)))
    return rows.groupBy("_lang", "_source", "metric", bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` and metric: docs and the percentiles q25 .. q95, from the bucket counts."""
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "metric").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = merged.withColumn("_cum", F.sum("n").over(run)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys, "metric")))
    value = F.when(F.col("bucket") < 1024, F.col("bucket")).otherwise(F.floor(1024 * F.pow(F.lit(2.0), (F.col("bucket") - 1024) / 64)))
    at = lambda q: F.min(F.when(100 * F.col("_cum") >= q * F.col("_all"), value)).alias(f"q{q}")
    return cum.groupBy(*keys, "metric").agg(F.max("_all").alias("docs"), *[at(q) for q in (*QUARTILES, *TAIL)])


def thresholds(measured: DataFrame) -> DataFrame:
    """Highest (and for word length lowest) value kept, per (_lang, _source) and metric.

    Documents that fail the base rules don't count. Every quantile of a group is drawn towards that
    of its language, and that towards the corpus's, as if the parent's were PARENT_DOCS documents more; so a group of
    any size has bounds of its own and one document more or less moves them a little. Word length knows no
    corpus: a language stands alone there, with a reach that widens as its documents get fewer.
    """
    s = stage(sketch(measured.where(~F.col("base_failed"))), "quality-sketch")
    named = lambda df, tag: df.withColumnsRenamed({c: f"{c}_{tag}" for c in df.columns if c[0] not in "_m"})
    own = named(quantiles(s, ["_lang", "_source"]), "o")
    t = own.join(named(quantiles(s, ["_lang"]), "l"), ["_lang", "metric"]).join(named(quantiles(s, []), "c"), "metric")
    drawn = lambda n, q, parent: F.expr(f"({n} * {q} + {PARENT_DOCS} * {parent}) div ({n} + {PARENT_DOCS})")
    for q in TAIL:
        t = t.withColumn(f"q{q}_l", F.when(F.col("metric") == "word_length", F.col(f"q{q}_l")).otherwise(drawn("docs_l", f"q{q}_l", f"q{q}_c")))
    for q in (*QUARTILES, *TAIL):
        t = t.withColumn(f"q{q}", drawn("docs_o", f"q{q}_o", f"q{q}_l"))
    reach = F.expr(f"({SPREADS} * greatest(q75 - q25, {LEAST_SPREAD}) * (docs_l + {DOUBT_DOCS})) div docs_l")
    above = F.expr(" ".join(["case metric", *[f"when '{m}' then {n}" for m, n in ABOVE_TAIL.items()], "end"]))
    tail = F.expr(f"({' + '.join(f'q{q}' for q in TAIL)}) div {len(TAIL)}")
    long = F.col("metric") == "word_length"
    t = t.withColumn("hi", F.when(long, F.col("q50") + reach).otherwise(above + tail)).withColumn("lo", F.when(long, F.col("q50") - reach))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return stage(t.groupBy("_lang", "_source").agg(*[of(m, "hi").alias(f"_hi_{m}") for m in METRICS], of("word_length", "lo").alias("_lo_word_length")), "quality-bounds")


def measure(docs: DataFrame) -> DataFrame:
    d = features(docs).withColumn("base_failed", base_failed())
    return d.withColumns({"_lang": key_of(F.col("lang")), "_source": key_of(F.col("source")), **{f"_m_{m}": c for m, c in metrics().items()}})


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: base rules passed and every metric inside the bounds of the row's group."""
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & (F.col(f"_m_{m}") <= F.col(f"_hi_{m}"))
    inside = inside & (F.col("_m_word_length") >= F.col("_lo_word_length"))
    # a group without bounds has only rows that failed the base rules
    return measured.join(limits, ["_lang", "_source"], "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame) -> DataFrame:
    """Base figures and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail; null lang or source is a group like others; equal rows
    get equal verdicts; an empty table gives no rows. The text is read once: its figures are staged
    (a few numbers a row), sketched per language and source, and joined with the bounds.
    """
    m = measure(docs.select("doc_id", "text", "lang", "source")).drop("text", "lang", "source", "_n_lines")
    m = stage(m, "quality-figures")
    return judge(m, thresholds(m)).select("doc_id", *OUT, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs`` and no others.

    Nulls, empty texts, repeated rows and empty tables: as in ``assess``; columns may have any names. The rows are
    staged with their figures, so a text is read once and none is shuffled; the bounds are one row a group.
    """
    cols = docs.columns
    own = docs.select(F.struct(*cols).alias("_row"), "text", "lang", "source", F.lit(None).cast("long").alias("doc_id"))
    m = stage(measure(own).drop("text", "lang", "source", "doc_id", "_n_lines", *OUT), "quality-rows")
    return judge(m, thresholds(m)).where("kept").select(*[F.col("_row").getField(c).alias(c) for c in cols])
