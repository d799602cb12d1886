"""Versions as a state machine, ordered folds, streams against batch, sinks and sources."""

import io
import json
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from groundwork.operators import answers, convert, evaluate, sheets, telemetry
from groundwork.operators import versions as V
from groundwork.sources import files
from groundwork.sources.records import rich_text
from groundwork.streaming import ingest, live


def test_rollback_leaves_one_live_version(spark):
    docs = spark.createDataFrame([("d", "h2", 2)], "document_id string, content_hash string, current_version long")
    p = spark.createDataFrame(
        [("a1", "d", 1, 0, "x", "h1", "1", "v2"), ("a2", "d", 1, 1, "y", "h1", "1", "v2"), ("b1", "d", 2, 0, "x", "h2", "1", None)],
        "passage_id string, document_id string, version long, pos long, text string, content_hash string, source_version string, superseded_by string",
    )
    led, rows = V.record_versions(p)
    out = V.rollback(docs, p, led, rows, spark.createDataFrame([("d", 1)], "document_id string, to_version long"))
    r = out["outcome"].first()
    assert (r.ok, r.new_version, r.reactivated, r.superseded) == (True, 3, 2, 1)
    assert {x.passage_id: x.superseded_by for x in out["passages"].collect()} == {"a1": None, "a2": None, "b1": "v3"}
    assert out["documents"].first().content_hash == "h1"
    gone = V.rollback(docs, p.where("passage_id <> 'a2'"), led, rows, spark.createDataFrame([("d", 1)], "document_id string, to_version long"))
    assert gone["outcome"].first().ok is False and gone["passages"].where("passage_id = 'b1'").first().superseded_by is None


def test_diff_is_a_multiset(spark):
    mk = lambda t: spark.createDataFrame([("d", i, x) for i, x in enumerate(t)], "document_id string, pos long, text string")
    a, b = mk(["x", "x", "y", "z"]), mk(["x", "y", "y"])
    r = V.version_diff(a, b).first()
    assert (r.added, r.removed, r.unchanged) == (1, 2, 2)
    rows = sorted((x.change, x.pos, x.text) for x in V.diff_rows(a, b).collect())
    assert rows == [("added", 1, "y"), ("removed", 0, "x"), ("removed", 3, "z")]


def test_budget_skips_refused_spends(spark):
    r = spark.createDataFrame([(i, "t", None, i, a) for i, a in enumerate([5.0, 7.0, 4.0, 3.0, 1.0])] + [(9, "free", None, 0, 1e9)], "request_id long, tenant string, agent string, at long, amount double")
    caps = spark.createDataFrame([("t", None, 10.0)], "tenant string, agent string, cap double")
    got = {x.request_id: x.admitted for x in telemetry.budget_admission(r, caps).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 9: True}


def brute_rate(rows, limit, window):
    state, out = {}, {}
    for eid, sub, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, n = state.get(sub, (None, 0))
        if start is None or at - start > window:
            state[sub], out[eid] = (at, 1), True
        elif n >= limit:
            out[eid] = False
        else:
            state[sub], out[eid] = (start, n + 1), True
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rows = [(i, f"u{i % 3}", float((i * 37) % 400)) for i in range(200)]
    d = spark.createDataFrame(rows, "event_id long, subject string, at double").withColumn("tenant", F.lit("t"))
    want = brute_rate(rows, 5, 60.0)
    got = {r.event_id: r.allowed for r in telemetry.rate_limit(d, 5, 60.0).collect()}
    assert got == want
    src = str(tmp_path / "in")
    for i, (lo, hi) in enumerate([(0, 150), (150, 300), (300, 401)]):
        d.where((F.col("at") >= lo) & (F.col("at") < hi)).coalesce(1).write.parquet(f"{src}/p{i}")
    parts = [spark.read.parquet(f"{src}/p{i}") for i in range(3)]
    flat = str(tmp_path / "flat")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(flat)
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(flat)
    q = live.rate_limit_stream(s, 5, 60.0).writeStream.format("memory").queryName("rl").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.allowed for r in spark.sql("select * from rl").collect()} == want


def test_stream_ingest_replay_and_return_to_old_content(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    rec = lambda u, at, body, dele=False: json.dumps({"source": "s", "uri": u, "updated": at, "deleted": dele, "body": body})
    (src / "1.json").write_text("\n".join([rec("a", "2024-01-01T00:00:00", "A"), rec("a", "2024-01-01T00:00:00", "A"), "not json", rec("b", "2024-01-01T01:00:00", "B")]))
    run = lambda: ingest.run(ingest.fresh(ingest.watch(spark, str(src), "*.json"), "30 days"), root).awaitTermination()
    run()
    (src / "2.json").write_text("\n".join([rec("a", "2024-01-02T00:00:00", "A2"), rec("b", "2024-01-02T00:00:00", "", True)]))
    run()
    (src / "3.json").write_text(rec("a", "2024-01-03T00:00:00", "A"))
    run()
    cur = {r.uri: r.body for r in ingest.current(spark, root).collect()}
    assert cur == {"a": "A"}
    assert ingest.dead_letters(spark, root).count() == 1
    h = ingest.health(spark, root).agg(F.sum("deletions").alias("d")).first()
    assert h.d == 1


def test_job_states(spark):
    ev = [(1, "leased", 1, 1), (1, "ack", 2, 2)] + [(2, e, t, t) for t, e in enumerate(["leased", "nack"] * 5)] + [(3, "leased", 1, 1)]
    got = {r.job_id: r.state for r in live.job_states(spark.createDataFrame(ev, "job_id long, event string, at long, seq long")).collect()}
    assert got == {1: "done", 2: "dead", 3: "running"}


def test_drop_folder_office_and_sheets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "note.md").write_text("hello")
    (tmp_path / "t.csv").write_text('name,total\n"a, b",3\nc,4\n')
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:p ><w:t>Short</w:t></w:p>" + "".join(f"<w:p ><w:t>A long paragraph number {i} &amp; more text</w:t></w:p>" for i in range(5)))
    (tmp_path / "d.docx").write_bytes(z.getvalue())
    s = io.BytesIO()
    with zipfile.ZipFile(s, "w") as f:
        f.writestr("ppt/slides/slide2.xml", "<a:t>two</a:t>")
        f.writestr("ppt/slides/slide10.xml", "<a:t>ten</a:t><a:t>x</a:t>")
    (tmp_path / "s.pptx").write_bytes(s.getvalue())
    d = {r.uri: r for r in files.drop_folder(spark, str(tmp_path), "t1").collect()}
    assert d["file://note.md"].title == "note" and d["file://note.md"].mime == "text/markdown" and bytes(d["file://note.md"].body) == b"hello"
    raw = spark.read.format("binaryFile").load(str(tmp_path / "*.*x"))
    got = [(r.path.rsplit("/", 1)[1], r.page, r.paragraph, r.passage) for r in convert.office_passages(raw).collect()]
    assert sorted(x[1:] for x in got if x[0] == "s.pptx") == [(2, 1, "two"), (10, 1, "ten x")]
    doc = [x for x in got if x[0] == "d.docx"]
    assert len(doc) == 5 and doc[4][1:3] == (2, 1) and "&" in doc[0][3]
    sh = files.delimited_sheets(spark, str(tmp_path / "t.csv"))
    assert [list(r.cells) for r in sh.orderBy("row").collect()] == [["name", "total"], ["a, b", "3"], ["c", "4"]]
    (tmp_path / "wide.csv").write_text(",".join(f"c{i}" for i in range(100)) + '\n"two\nlines, one cell",2\n')
    wide = {r.row: r.cells for r in files.delimited_sheets(spark, str(tmp_path / "wide.csv")).collect()}
    assert len(wide[0]) == 100 and wide[1] == ["two\nlines, one cell", "2"] and len(wide) == 2


def test_ledger_roundtrip_prunes_days(spark, tmp_path):
    calls = spark.createDataFrame(
        [("2024-01-01T00:00:00", "answer_bake", "m", 100, 10, 0, 0), ("2024-02-01T00:00:00", "odd", "nope", 1, 1, 0, 0)],
        "ts string, purpose string, model string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long",
    )
    prices = spark.createDataFrame([("m", 3.0, 15.0, 0.3, 3.75)], "model string, p_in double, p_out double, p_read double, p_write double")
    path = str(tmp_path / "ledger")
    files.append_ledger(calls, prices, path)
    r = files.read_ledger(spark, path, "2024-01-15").collect()
    assert [(x.purpose, x.cost_usd) for x in r] == [("unknown:odd", 0.0)]
    plan = files.read_ledger(spark, path, "2024-01-15")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_typed_sheet_golden_values(spark):
    rows = [("D-1", "critical", 3), ("D-2", "high", 5), ("D-3", "critical", 8), ("D-4", "low", 13)]
    d = spark.createDataFrame(rows, "key string, priority string, story_points long")
    q = lambda s: sheets.table_query(d, s).collect()
    assert q("SELECT COUNT(*) AS n FROM t WHERE priority = 'critical'")[0].n == 2
    assert q("WITH x AS (SELECT SUM(story_points) AS s FROM t) SELECT s FROM x")[0].s == 29
    spark.createDataFrame([("hidden",)], "x string").createOrReplaceTempView("secrets")
    spark.createDataFrame([("mine",)], "x string").createOrReplaceTempView("t")
    bad = (
        "DROP TABLE t", "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM t JOIN secrets ON 1=1", "", "WITH x AS (SELECT 1) DELETE FROM t", "SELECT * FROM t, secrets",
        "SELECT '--', x.* FROM secrets x", "SELECT '/*', x.* FROM secrets x --'*/", "SELECT \"'\" AS a, x FROM secrets WHERE x <> \"'\"", "SELECT (SELECT max(x) FROM secrets) FROM t",
        "WITH t AS (SELECT * FROM secrets) SELECT * FROM t", "SELECT reflect('java.lang.System', 'getenv', 'PATH') FROM t", "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "SELECT TRANSFORM(key) USING 'cat' AS (k) FROM t", "SELECT r'\\' FROM t", "FROM t INSERT OVERWRITE DIRECTORY '/tmp/x' SELECT *",
    )
    for text in bad:
        with pytest.raises(sheets.TableQueryError):
            sheets.table_query(d, text)
    assert spark.table("t").first().x == "mine"
    out = tempfile.mkdtemp()
    writes = (
        f"WITH x AS (SELECT * FROM t AS INSERT (a)) INSERT OVERWRITE DIRECTORY '{out}/d' USING parquet SELECT a FROM x", "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x",
        f"WITH x AS (SELECT key FROM t) FROM x INSERT OVERWRITE DIRECTORY '{out}/e' USING parquet SELECT key", "WITH x AS (SELECT 1) CREATE TABLE made AS SELECT * FROM x", "SELECT * FROM range(9)",
        "WITH x AS (SELECT key FROM t) SELECT TRANSFORM(key) USING 'touch' FROM x", "WITH x AS (SELECT 1) SET spark.app.name=changed", "SELECT * FROM t WHERE key IN (SELECT id FROM range(3))",
    )
    for text in writes:
        with pytest.raises(sheets.TableQueryError):
            sheets.table_query(d, text)
    assert os.listdir(out) == [] and not spark.catalog.tableExists("made") and spark.conf.get("spark.app.name") != "changed"
    assert q("SELECT priority, MAX(story_points) AS m, COUNT(*) OVER () AS n FROM t GROUP BY priority HAVING MAX(story_points) > 5 ORDER BY m LIMIT 1")[0].m == 8
    assert len(q("SELECT key AS insert_key FROM t UNION ALL (SELECT priority FROM t WHERE EXISTS (SELECT 1 FROM t AS u WHERE u.key = t.key)) EXCEPT SELECT 'low'")) == 6
    assert q("SELECT concat('{', key, '}') AS k FROM t WHERE key IN (SELECT key FROM t WHERE story_points > 8)")[0].k == "{D-4}"
    rows, cut = sheets.table_page(d, "SELECT * FROM t ORDER BY key", 3)
    assert rows.count() == 3 and cut and not sheets.table_page(d, "SELECT * FROM t", 4)[1]


def test_rich_text_and_html():
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "i"}]}]}]}]}
    assert rich_text(doc).strip() == "a\nb\n\n- i"
    html = "<head><title>t</title></head><body><p>One &amp; two</p><table><tr><td>a</td><td>b</td></tr></table><script>x</script>tail"
    assert convert.html_to_paragraphs(html) == ["One & two", "a | b", "tail"]


def test_plans_and_conditions(spark):
    q = spark.createDataFrame([
        (1, "If the gate passes then what is the release date otherwise who signs the waiver?"), (2, "Compare alpha cache with beta cache?"),
        (3, "What is the index and how does ranking work; then list the owners"), (4, "What is the entry and exit criteria?"),
    ], "query_id long, text string")
    p = answers.plan_questions(q).collect()
    mode = {r.query_id: r["mode"] for r in p}
    assert mode == {1: "conditional", 2: "compare", 3: "multistep", 4: "single"}
    assert [r.role for r in sorted((r for r in p if r.query_id == 1), key=lambda r: r.step)] == ["condition", "then", "otherwise", "synthesize"]
    assert len([r for r in p if r.query_id == 3 and r.kind == "lookup"]) == 3
    s = spark.createDataFrame([(1, 1, "the gate passes", "answer", 0.9, "The gate passes today. Other text."), (2, 1, "the gate passes", "answer", 0.9, "The gate never passes.")], "query_id long, step int, clause string, kind_of_answer string, grounding double, answer string")
    assert {r.query_id: r.condition for r in answers.decide_condition(s).collect()} == {1: True, 2: False}


def test_keep_cited_and_followups(spark):
    t = "Good one [1]. Bad one.\n```\ncode\n```\nNot cited here.\n```\nother\n```\n- item [2]\n- item [9]"
    d = spark.createDataFrame([(1, t, 2)], "answer_id long, text string, n_citations int")
    kept = [r.unit for r in answers.keep_cited(d).where("kept").orderBy("seq").collect()]
    assert kept == ["Good one [1].", "- item [2]"]
    sub = spark.createDataFrame([("falcon", "Falcon"), ("heron", "Heron")], "key string, display string")
    turns = spark.createDataFrame([(1, 1, "What is Falcon?"), (1, 2, "does it support tables"), (1, 3, "what about Heron"), (2, 1, "it?")], "conv_id long, turn long, question string")
    got = {(r.conv_id, r.turn): (r.rule, r.resolved) for r in answers.resolve_followups(turns, sub).collect()}
    assert got[(1, 2)] == ("pronoun", "does Falcon support tables") and got[(1, 3)][0] == "self" and got[(2, 1)][0] == "clarify"


def test_grading_rules(spark):
    rows = [("1,284 commits", 1284.0, None, None), ("1,285 commits", 1284.0, None, None), ("avg 4.83", 4.8333, None, None), ("Alpha and beta", None, ["alpha", "Beta"], None), ("none", None, None, "x")]
    d = spark.createDataFrame(rows, "answer string, expect_number double, expect_list array<string>, expect_text string")
    assert [r.ok for r in evaluate.grade(d).collect()] == [True, False, True, True, False]


def test_tenants_and_order_inside_a_batch(spark):
    d = spark.createDataFrame([("t1", "1", "s", "u", "h", 1, "active"), ("t2", "2", "s", "u", "h", 1, "active")], "tenant string, document_id string, source string, uri string, content_hash string, current_version long, status string")
    p = spark.createDataFrame([("p1", "1"), ("p2", "2")], "passage_id string, document_id string")
    docs, left, vec = V.tombstone(d, p, p, d.where("tenant = 't1'").select("tenant", "source", "uri"))
    assert {r.tenant: r.status for r in docs.collect()} == {"t1": "tombstoned", "t2": "active"}
    assert [r.passage_id for r in left.collect()] == [r.passage_id for r in vec.collect()] == ["p2"]
    batch = [("t1", "s", "u", "h", 1), ("t1", "s", "u", "a", 2), ("t1", "s", "u", "a", 3), ("t1", "s", "u", "h", 4), ("t1", "s", "new", "n", 5), ("t1", "s", "new", "m", 6)]
    got = V.ingest_diff(spark.createDataFrame(batch, "tenant string, source string, uri string, content_hash string, arrival int"), d, ["arrival"])
    assert [(r.arrival, r.status, r.version) for r in got.orderBy("arrival").collect()] == [(1, "noop", 1), (2, "updated", 2), (3, "noop", 2), (4, "updated", 3), (5, "ok", 1), (6, "updated", 2)]


def test_span_pages_pass_over_nothing(spark):
    s = spark.createDataFrame([("t1", i, 5.0) for i in range(7)] + [("t1", 9, 6.0), ("t2", 8, 5.0)], "tenant string, id long, started_at double")
    seen, at, last = [], 0.0, None
    while page := telemetry.read_spans(s, "t1", at, last, limit=3).collect():
        seen += [r.id for r in page]
        at, last = page[-1].started_at, page[-1].id
    assert seen == [0, 1, 2, 3, 4, 5, 6, 9]


def test_chain_is_one_component(spark):
    from groundwork.operators.graph import connected_components

    n = spark.range(200).select(F.col("id").alias("node"))
    e = spark.range(199).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(n, e).select("comp").distinct().count() == 1
