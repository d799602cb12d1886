"""Question bank, gates, graded sets, coverage matrix, template questions, known questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, content_tokens, normal_question
from ..session import cut_lineage
from .skew import per_key, shuffled, top_k

# Promotion thresholds, set gates, bank gates, generic title words.
THRESHOLDS = {"citation_coverage": 0.75, "grounding_pass_rate": 0.6, "answer_supportedness": 0.75, "recall": 0.5}
GATES = {"false_answer_rate": 0.0, "exact_count_accuracy": 1.0, "citation_rate": 0.95, "agent_success": 0.85}
CONFIDENCE_GATE, MIN_CITED_DOCS = 0.56, 2
GENERIC = "product products service services overview document policy guide company the a an of and for".split()
CODE_PREFIX = r"^\s*(?:\d+[\s._-]*)+"


def title_subject(title: Column) -> Column:
    """Title without its leading code and generic words."""
    w = F.split(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), CODE_PREFIX, "")), r"[\s/_-]+")
    return F.array_join(F.filter(w, lambda x: (x != "") & ~F.lower(x).isin(*GENERIC)), " ")


def bank_candidates(documents: DataFrame) -> DataFrame:
    """Two questions per distinct title subject; the first document in id order gives the spelling."""
    s = documents.select("document_id", title_subject(F.col("title")).alias("subject")).where("subject <> ''")
    one = s.groupBy(F.lower("subject").alias("_k")).agg(F.min_by("subject", "document_id").alias("subject"))
    q = F.array(
        F.struct(F.lit("definition").alias("family"), F.concat(F.lit("what is "), "subject", F.lit("?")).alias("question")),
        F.struct(F.lit("coverage").alias("family"), F.concat(F.lit("what does "), "subject", F.lit(" cover?")).alias("question")),
    )
    return one.select(F.explode(q).alias("q")).select("q.*")


def keep_bank(answers: DataFrame) -> DataFrame:
    """Confident answers that cite at least two documents: (question, kind, confidence, cited array)."""
    return answers.where((F.col("kind") == "answer") & (F.col("confidence") >= CONFIDENCE_GATE) & (F.size(F.array_distinct("cited")) >= MIN_CITED_DOCS))


def bank_metrics(answers: DataFrame, expected: DataFrame, threshold: float) -> DataFrame:
    """Coverage, supportedness, grounding pass rate and recall.

    ``answers``: (question_id, kind, grounding, n_cites, resolvable) one per banked question;
    ``expected``: (question_id, document_id, cited boolean) exploded expectations.
    """
    n = F.count(F.lit(1))
    cited = (F.col("kind") == "answer") & (F.col("n_cites") > 0)
    m = answers.agg(
        n.alias("n"), F.round(F.count_if(cited) / n, 4).alias("citation_coverage"), F.round(F.count_if(cited & F.col("resolvable")) / n, 4).alias("answer_supportedness"),
        F.round(F.count_if(F.col("grounding") >= threshold) / n, 4).alias("grounding_pass_rate"),
    )
    r = expected.agg(F.when(F.count(F.lit(1)) > 0, F.round(F.count_if("cited") / F.count(F.lit(1)), 4)).otherwise(0.0).alias("recall"))
    return m.join(r, F.lit(True))


def promotion_gate(metrics: DataFrame) -> DataFrame:
    """Metrics against their floors and the verdict: passes only when every floor is met."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("floor")) for k, v in THRESHOLDS.items()])
    x = metrics.select("n", F.explode(pairs).alias("p")).select("n", "p.*").withColumn("ok", F.col("value") >= F.col("floor"))
    return x.groupBy("n").agg(F.bool_and("ok").alias("_ok"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("metric")))), ",").alias("regressions")).select(
        (F.col("_ok") & (F.col("n") > 0)).alias("passed"), "regressions"
    )


def promote(versions: DataFrame, candidate: int, passed: DataFrame) -> DataFrame:
    """Index versions after the gate: a passing candidate goes live and retires the live one."""
    j = versions.where(F.col("version") != candidate).join(passed.select("passed"), F.lit(True))
    kept = j.withColumn("state", F.when(F.col("passed") & (F.col("state") == "live"), "retired").otherwise(F.col("state"))).drop("passed")
    new = passed.select(F.lit(candidate).cast("long").alias("version"), F.when(F.col("passed"), "live").otherwise("candidate").alias("state"))
    return kept.select("version", "state").unionByName(new)


def grade(df: DataFrame) -> DataFrame:
    """Adds ``ok``: expected number, list or text found in the answer.

    Columns: answer, kind, expect_number double, expect_list array<string>, expect_text. Integers must
    occur exactly; decimals within 0.01 or half a percent.
    """
    low = F.lower("answer")
    nums = F.transform(F.regexp_extract_all("answer", F.lit(r"\d[\d,]*\.?\d*"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("double"))
    e = F.col("expect_number")
    exact = F.exists(nums, lambda x: x == e)
    near = F.exists(nums, lambda x: (F.abs(x - e) < 0.01) | (F.abs(x - e) <= 0.005 * F.abs(e)))
    ok = F.when(F.col("expect_list").isNotNull(), F.forall("expect_list", lambda x: F.contains(low, F.lower(x)))).when(
        e.isNotNull(), F.when(e == F.floor(e), exact).otherwise(near)).otherwise(F.contains(low, F.lower("expect_text")))
    return df.withColumn("ok", F.coalesce(ok, F.lit(False)))


def set_metrics(graded: DataFrame) -> DataFrame:
    """Per set: rows, passes, citation rate, false answers (answered but wrong)."""
    n = F.count(F.lit(1))
    return graded.groupBy("set").agg(
        n.alias("n"), F.count_if("ok").alias("passed"), F.round(F.count_if("ok") / n, 4).alias("accuracy"), F.round(F.count_if("cited") / n, 4).alias("citation_rate"),
        F.round(F.count_if(F.col("answered") & ~F.col("ok")) / n, 4).alias("false_answer_rate"),
    )


def set_gates(graded: DataFrame, counted: tuple[str, ...]) -> DataFrame:
    """Overall gates over the counted sets (exact counts, false answers) and all sets (citations)."""
    c = F.col("set").isin(*counted)
    g = graded.agg(
        F.round(F.count_if(c & F.col("ok")) / F.count_if(c), 4).alias("exact_count_accuracy"),
        F.round(F.count_if(c & F.col("answered") & ~F.col("ok")) / F.count_if(c), 4).alias("false_answer_rate"), F.round(F.avg(F.col("cited").cast("int")), 4).alias("citation_rate"),
    )
    fail = F.array_compact(F.array(
        F.when(F.col("false_answer_rate") > GATES["false_answer_rate"], "false_answer_rate"), F.when(F.col("exact_count_accuracy") < GATES["exact_count_accuracy"], "exact_count_accuracy"),
        F.when(F.col("citation_rate") < GATES["citation_rate"], "citation_rate"),
    ))
    return g.withColumn("gate_failures", F.array_join(fail, ","))


def coverage_matrix(cells: DataFrame, graded: DataFrame, held: DataFrame) -> DataFrame:
    """Status of each (data_type, audience) cell: green, amber, coral or na.

    ``cells``: the matrix; ``graded``: (data_type, audience, ok); ``held``: data types with content.
    """
    g = graded.groupBy("data_type", "audience").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("passed"))
    j = cells.join(g, ["data_type", "audience"], "left").join(held.select("data_type", F.lit(True).alias("_h")), "data_type", "left")
    n, p = F.coalesce("n", F.lit(0)), F.coalesce("passed", F.lit(0))
    st = F.when(F.col("_h").isNull() | (n == 0), "na").when(p == n, "green").when(p == 0, "coral").otherwise("amber")
    return j.select("data_type", "audience", n.alias("n"), F.when(F.col("_h").isNull(), 0).otherwise(p).alias("passed"), st.alias("status"))


def routing_distribution(answers: DataFrame) -> DataFrame:
    """Questions per level and the share of the lower two."""
    g = answers.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    t = answers.agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("level") <= 2).alias("_l"))
    return g.join(t, F.lit(True)).select("level", "n", F.round(F.col("_l") / F.col("_t"), 4).alias("lower_two_share"))


def dimension_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("dimension").agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))


def doc_kind(mime: Column, uri: Column, title: Column) -> Column:
    """repo, pr, code, sheet, image or doc."""
    m, u, t = (F.lower(F.coalesce(c, F.lit(""))) for c in (mime, uri, title))
    return (
        F.when(m.startswith("image/") | u.rlike(r"\.(png|jpg|jpeg|gif|webp)$"), "image")
        .when(u.contains("/pull/") | u.contains("/pulls/") | t.startswith("pr "), "pr")
        .when(m.isin("text/csv", "application/vnd.ms-excel") | m.contains("spreadsheet") | u.rlike(r"\.(csv|xlsx|xls|sqlite|tsv)$"), "sheet")
        .when(m.contains(";code") | u.rlike(r"\.(py|js|ts|go|java|rs)$"), "code")
        .when(t.contains("repository overview") | (u.startswith("github://") & u.endswith("readme.md")), "repo")
        .otherwise("doc")
    )


def template_questions(documents: DataFrame) -> DataFrame:
    """Questions by document kind, unique by normal form within a document: (document_id, pos, question)."""
    t = F.regexp_replace(F.coalesce("title", F.lit("")), CODE_PREFIX, "")
    title = F.coalesce(F.nullif(collapse(t), F.lit("")), F.trim("title"))
    kind = doc_kind(F.col("mime"), F.col("uri"), F.col("title"))
    repo = F.coalesce(F.nullif(F.regexp_extract(F.col("uri"), "github://([^/]+/[^/]+)", 1), F.lit("")), title)
    sheet = F.regexp_replace(title, r"(?i)\.(csv|xlsx|xls|tsv|sqlite)$", "")
    path = F.coalesce(F.nullif(F.regexp_replace(F.col("uri"), r"^github://[^/]+/[^/]+/", ""), F.lit("")), title)
    q = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    out = (
        F.when(kind == "repo", F.array(q("what does ", repo, " do"), q("who worked on ", repo), q("which capabilities does ", repo, " provide"), q("how is ", repo, " organised")))
        .when(kind == "pr", F.array(q("what changed in ", title), q("who worked on ", title), q("why was ", title, " made")))
        .when(kind == "sheet", F.array(q("how many rows in ", sheet), q("what columns are in ", sheet), q("what is ", sheet, " about")))
        .when(kind == "image", F.array(q("what does ", title, " show"), q("what is ", title)))
        .when(kind == "code", F.array(q("what does ", title, " do"), q("where is ", path)))
        .otherwise(F.array(q("what is ", title), q("what does ", title, " cover"), q("when was ", title, " updated")))
    )
    d = documents.where(F.coalesce("title", F.lit("")) != "").select("document_id", F.posexplode(out).alias("pos", "question"))
    d = d.withColumn("_k", normal_question(F.col("question"))).where("_k <> ''")
    return d.groupBy("document_id", "_k").agg(F.min(F.struct("pos", "question")).alias("m")).select("document_id", F.col("m.pos").alias("pos"), F.col("m.question").alias("question"))


def bake_recommendations(failures: DataFrame, limit: int = 50, sample: int = 6) -> DataFrame:
    """Failed questions per document with six samples and reason counts, most failures first.

    ``failures``: (document_id, seq, question, reason). Samples are picked by rank, so a document with
    many failures never gathers them all.
    """
    code = F.coalesce(F.nullif(F.element_at(F.split(F.coalesce("reason", F.lit("")), ":"), 1), F.lit("")), F.lit("failed"))
    by_reason = failures.groupBy("document_id", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    tot = by_reason.groupBy("document_id").agg(
        F.sum("n").alias("failed"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws("=", x["code"], x["n"].cast("string"))), ",").alias("reasons")
    )
    top = top_k(failures, ["document_id"], [F.col("seq")], sample, "_r").groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "question"))), lambda x: x["question"]).alias("questions"))
    return tot.join(top, "document_id").orderBy(F.desc("failed"), "document_id").limit(limit)


def known_question_match(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """Best registry entry per question: an exact example first, else the entry with the most fixed tokens, all present.

    ``registry``: (entry_id, seq, pattern, examples array, enabled). A pattern can only match a question
    that holds its rarest fixed token, so the two meet on that token and the rest is verified.
    """
    r = cut_lineage(registry.where("enabled").withColumn("fixed", content_tokens(F.regexp_replace("pattern", "<[^>]*>", " "))))
    q = questions.select("query_id", normal_question(F.col("text")).alias("_qn"), content_tokens(F.col("text")).alias("_qt"))
    ex = r.select("entry_id", "seq", "fixed", F.explode(F.transform("examples", lambda e: normal_question(e))).alias("_qn"))
    exact = q.join(per_key(ex), "_qn").select("query_id", "entry_id", "seq", F.lit(2).alias("tier"), F.size("fixed").alias("nf"))
    df = q.select(F.explode("_qt").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    ft = r.select("entry_id", "seq", "fixed", F.explode("fixed").alias("t")).join(shuffled(df), "t", "left").fillna(0, ["n"])
    rare = cut_lineage(ft.groupBy("entry_id", "seq", "fixed").agg(F.min_by("t", F.struct("n", "t")).alias("t")))
    toks = q.select("query_id", "_qt", F.explode("_qt").alias("t"))
    pat = toks.join(per_key(rare), "t").where(F.size(F.array_except("fixed", "_qt")) == 0)
    pat = pat.select("query_id", "entry_id", "seq", F.lit(1).alias("tier"), F.size("fixed").alias("nf"))
    best = exact.unionByName(pat).groupBy("query_id").agg(F.max_by(F.struct("entry_id", "tier", "nf"), F.struct(F.col("tier"), F.col("nf"), (-F.col("seq")).alias("s"))).alias("b"))
    return best.select("query_id", "b.entry_id", "b.tier", "b.nf")


def audience_suggestions(registry: DataFrame, audiences: Column, limit: int = 6) -> DataFrame:
    """First example per entry for the audiences, registry order, unique by normal form."""
    r = registry.where(F.col("enabled") & F.arrays_overlap("persona", audiences))
    ex = F.coalesce(F.try_element_at("examples", F.lit(1)), F.col("pattern"))
    r = r.select("entry_id", "seq", ex.alias("question"), normal_question(ex).alias("_k")).where("_k <> ''")
    one = r.groupBy("_k").agg(F.min(F.struct("seq", "entry_id", "question")).alias("m")).select("m.*")
    return one.orderBy("seq").limit(limit)


def volume_expectations(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """Sources under their expected volume; the message separates zero after a good preflight from low.

    ``expected``: (source, unit, need, preflight_ok); ``counts``: (source, n).
    """
    j = expected.join(counts, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    zero = (F.col("n") == 0) & F.col("preflight_ok")
    msg = F.when(zero, F.concat("source", F.lit(": preflight OK but 0 "), "unit")).otherwise(
        F.concat("source", F.lit(": only "), F.col("n").cast("string"), F.lit(" "), "unit", F.lit(" (need "), F.col("need").cast("string"), F.lit(")"))
    )
    return j.select("source", "n", "need", msg.alias("message"))


def answer_key(question: Column) -> Column:
    """Name of a baked answer: first 16 hex digits of the hash of the normal form."""
    return F.substring(F.sha2(normal_question(question), 256), 1, 16)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
