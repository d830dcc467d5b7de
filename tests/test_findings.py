import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.functions import text as T
from quern.operators import findings as A
from quern.operators import measures as M
from quern.operators import rules as R
from quern.operators import exchange as X
from quern.operators import lifecycle as L
from quern.operators import reports, syntax
from quern.operators import selection as S
from quern.plans import documents, exchange, registry, reporting, service, structure  # noqa: F401
from quern.sources import loaders, readers
from quern.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in registry.view.__globals__["TABLES"]:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def value(x):
    if isinstance(x, float):
        return float(f"{x:.9g}")
    return [value(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr([value(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(f"select {', '.join(cols)} from ({registry.ORACLES[name]})").fetchall()
    assert mine == sorted(repr([value(x) for x in r]) for r in found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def gate(spark, rows):
    df = spark.createDataFrame([("r", *x) for x in rows], "run_id string, level string, confidence double, baseline_state string, suppressed_by string")
    return [r.decision for r in A.gate(df).collect()]


@pytest.mark.parametrize(
    ("rows", "decision"),
    [
        ([("error", 0.9, None, None)], "reject"), ([("error", 0.85, None, None)], "review"), ([("warning", 0.7, None, None)], "review"), ([("error", 0.95, "absent", None)], "merge"),
        ([("error", 0.95, "new", None)], "reject"), ([("error", 0.95, "unchanged", None), ("error", 0.9, "new", None)], "reject"), ([("error", 0.95, None, "why")], "merge"), ([("error", None, None, None)], "review"),
    ],
)
def test_gate_table(spark, rows, decision):
    assert gate(spark, rows) == [decision]


@pytest.mark.parametrize(("path", "clean"), [("./a/b.go", "a/b.go"), ("a\\b.go", "a/b.go"), ("./foo/../a/b.go", "a/b.go"), ("", "."), ("/../x//y/.", "/x/y"), ("../../a", "../../a"), ("a/..", ".")])
def test_normalize_path(spark, path, clean):
    assert spark.range(1).select(T.normalize_path(F.lit(path))).first()[0] == clean


def test_percentile_is_lower_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert df.agg(M.percentile(F.col("v"), 0.95)).first()[0] == 9


def test_percentiles_as_sorted_lists(spark):
    rng = random.Random(7)
    rows = [(k, v) for k in ("a", "b", None) for v in [rng.choice([-3.5, 0.0, 1.0, 1.0001, 1e9, float("inf"), float("-inf"), rng.random()]) for _ in range(rng.randrange(1, 60))] + [None]]
    df = spark.createDataFrame([*rows, ("none", None)], "k string, v double")
    ps = {"low": 0.0, "mid": 0.5, "high": 0.99, "top": 1.0}
    want = df.groupBy("k").agg(*[M.percentile(F.col("v"), p).alias(c) for c, p in ps.items()])
    assert sorted(map(repr, M.percentiles(df, "k", "v", ps).collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["latency_percentiles", "overlap_dedup"])
def test_no_group_is_gathered_in_one_array(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_overlap_dedup_of_one_hot_file_as_a_loop(spark):
    rng = random.Random(9)
    rows = [(i, "r", "u", (lo := rng.randrange(200)), lo + rng.randrange(3), rng.choice([None, 0.1, 0.5, 0.9])) for i in range(30_000)]
    kept, best = [], rows[0]
    for x in rows[1:]:
        if x[3] <= best[4] and best[3] <= x[4]:
            best = x if (x[5] or 0) > (best[5] or 0) else best
        else:
            kept.append(x[0])
    df = spark.createDataFrame([*rows, (-1, "r", None, 1, 1, 0.5)], "ord long, rule_id string, uri string, start_line int, end_line int, confidence double")
    assert sorted(r.ord for r in A.overlap_dedup(df).collect()) == sorted([*kept, best[0], -1])


def score(source, expected, actual, tolerance):
    used, missed = set(), 0
    for level, rule, lo, hi, must in expected:
        for i, (a_level, a_rule, line, *_) in enumerate(actual):
            if i not in used and level in ("", a_level) and rule in ("any", a_rule) and ((lo, hi) == (0, 0) or line is None or lo - tolerance <= line <= hi + tolerance):
                used.add(i)
                break
        else:
            missed += must
    sure = lambda rows: (lambda c: sum(c) / len(c) if c else 0.0)([r[4] for r in rows if r[4] is not None])
    wrong = [a for i, a in enumerate(actual) if i not in used]
    lost = sum(1 for a in wrong if a[3] and source and not a[3].endswith(source.rsplit("/", 1)[-1]))
    return len(used), len(wrong), missed, lost, sure([a for i, a in enumerate(actual) if i in used]), sure(wrong)


def test_score_cases_as_greedy_matching(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for case in range(60):
        e = [(rng.choice(["a", "b", ""]), rng.choice(["any", "r1", "r2"]), (lo := rng.choice([0, rng.randrange(20)])), lo + 2 if lo else 0, rng.random() < 0.6) for _ in range(rng.randrange(4))]
        a = [(rng.choice("ab"), rng.choice(["r1", "r2"]), rng.choice([None, rng.randrange(25)]), rng.choice([None, "", "x/s.go", "s.go", "other.go"]), rng.choice([None, 0.25, 0.75])) for _ in range(rng.randrange(5))]
        source = rng.choice(["d/s.go", "", None])
        want[case] = score(source, e, a, 1)
        rows.append((case, source, [(i, *x) for i, x in enumerate(e)], [(i, *x, i) for i, x in enumerate(a)]))
    schema = "case_id int, source string, expected array<struct<ord:int,level:string,rule_id:string,lo:int,hi:int,must_find:boolean>>, actual array<struct<ord:int,level:string,rule_id:string,line:int,uri:string,confidence:double,no:int>>"
    found = M.score_cases(spark.createDataFrame(rows, schema), 1).collect()
    assert {r.case_id: (r.tp, r.fp, r.fn, r.hallucinations, r.tp_conf, r.fp_conf) for r in found} == want


def test_two_artifacts_of_one_path_keep_their_lines(spark):
    text = "\n\n// TODO: x\n// TODO: y"
    found = R.regex_scan(spark.createDataFrame([("a.go", text), ("a.go", "\n// TODO: z"), ("a.go", text)], "path string, content string"), R.BUILT_IN).collect()
    assert sorted(r.start_line for r in found) == [2, 3, 3, 4, 4]


def test_java_patterns_differ_where_dialects_do(spark):
    content = "\x0bif err\x0b!= nil {}\npaſſword = 'abcd'\n\n  v, _ := f()"
    found = R.regex_scan(spark.createDataFrame([("a.go", content)], "path string, content string"), R.BUILT_IN).collect()
    assert sorted((r.rule_id, r.start_line) for r in found) == [("S1086", 3), ("S2068", 2)]


def test_diff(spark):
    diff = "noise\ndiff --git a/x.go b/x.go\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +20 @@\n-b\ndiff --git a/d/y.py b/d/y.py\n@@ -1 +0,0 @@\n-gone"
    rows = readers.split_diff(spark.createDataFrame([(1, diff)], "diff_id int, diff string")).select("path", readers.changed_range(F.col("content")).alias("r")).collect()
    assert {r.path: (r.r.start, r.r.end) for r in rows} == {"x.go": (3, 20), "d/y.py": (None, None)}


def test_read_directory(spark, tmp_path):
    for name, data in {"a.go": b"x", "d/b.py": b"y", ".git/c": b"z", "d/bad": b"\xff\xfe", ".env": b"e"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path.rsplit("/", 1)[1] for r in readers.read_directory(spark, str(tmp_path)).collect()} == {"a.go", "b.py"}


def test_streams_agree_with_batch(spark, tmp_path):
    events = registry.view(spark, SF, "analysis_events")
    events.coalesce(1).sortWithinPartitions("ts", "ord").write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), events.schema)
    q = jobs.changed_only(stream).writeStream.format("memory").queryName("changed").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = sorted(r.ord for r in M.changed_only(events).select("ord").collect())
    assert sorted(r.ord for r in spark.table("changed").collect()) == want
    q = jobs.hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
    q = jobs.sliding(stream).writeStream.format("memory").queryName("slides").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("slides").agg(F.sum("n")).first()[0] == 12 * events.count()


def test_syntax_checks(spark):
    source = """
def ok(a, b, *args, c=1, **kw):
    if a:
        pass
    elif b:
        for x in a:
            while x:
                with x:
                    if x: pass
    return 1
async def wide(a, b, c, /, d, e, *f: int):
    try:
        ok(a)
    except:
        pass
    except ValueError:
        pass; ok(b)
"""
    files = spark.createDataFrame([("a.py", source), ("b.py", "def f(:"), ("c.go", source), ("d.py", None), ("e.py", "")], "path string, content string")
    found = sorted((r.uri, r.rule_id, r.start_line, r.end_line) for r in syntax.syntax_scan(files).collect())
    assert found == [("a.py", "AST002", 9, 9), ("a.py", "AST003", 14, 15), ("a.py", "AST004", 11, 17)]


def test_policy_overlay(spark):
    rows = [("p", 0, "d", "s", "i", True), ("p", 1, "", "t", "", False), ("q", 0, "d", "", "", True), ("q", 1, "", "", "", False), ("r", 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "name string, layer int, description string, severity string, instruction string, enabled boolean")
    got = {r.name: tuple(r)[1:] for r in reports.policy_overlay(df, ["description", "severity", "instruction"]).collect()}
    assert got == {"p": ("d", "t", "i", True), "q": ("d", "", "", False), "r": ("", "", "", False)}


@pytest.mark.parametrize(
    ("path", "watch", "ignore", "hit"),
    [
        ("/p/src/main.go", ["**/*.go"], [], True), ("/p/main.py", ["**/*.go"], [], False), ("/p/node_modules/a.go", ["**/*.go"], ["**/node_modules/**"], False), ("file:///p/a.go", ["*.go"], [], True),
        ("a.go", [], [], True), ("a.go", [], ["*.go"], False), ("src/x/a.ts", ["src/**"], [], True), ("lib/a.ts", ["src/**"], [], False), ("p/main_test.go", ["main_*.g?"], [], True), ("p/m[1].go", ["m[[]1].go"], [], True), ("p\\\\b.go", ["[a-c].go"], [], True), ("p/d.go", ["[^a-c].go"], [], True), ("p/b.go", ["[^a-c].go"], [], False),
    ],
)
def test_watch_patterns(spark, path, watch, ignore, hit):
    assert spark.createDataFrame([(path,)], "p string").select(S.watched(F.col("p"), watch, ignore)).first()[0] is hit


def test_model_scan(spark):
    a = spark.createDataFrame([("a.go", "x"), ("b.go", "")], "path string, content string")
    model = lambda prompt, why: [{"rule_id": why, "message": prompt}, {"rule_id": "r", "uri": "other.go", "confidence": 0.5}]
    found = sorted((r.uri, r.rule_id, r.message) for r in S.model_scan(a, "p", model).collect())
    assert found == [("a.go", "p", "// File: a.go\nx"), ("b.go", "p", "// File: b.go\n"), ("other.go", "r", None), ("other.go", "r", None)]
    assert S.model_scan(a, "", model).count() == 0

    def broken(prompt, why):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        S.model_scan(a, "p", broken).collect()


@pytest.mark.parametrize("n", [0, 5, 20, 21, 22, 23, 47])
def test_retention_as_one_event_after_the_other(spark, n):
    log = []
    for i in range(n):
        log.append(i)
        if len(log) > 20:
            log = log[2:]
    assert sorted(r.id for r in L.retained(spark.range(n), ["id"], 20).collect()) == log


RULES = """
rules:
  - {id: A1, pattern: "x+", level: error, confidence: 0.5, message: m, languages: [go], cwe: [CWE-1]}
  - {id: B2, type: ast, ast_check: param-count, ast_config: {max_params: 3}, level: note, confidence: 1, message: n, category: security}
"""


def test_rule_files(spark, tmp_path):
    (tmp_path / "b.YML").write_text(RULES)
    (tmp_path / "a.yaml").write_text("rules:\n  - {id: C3, pattern: y, level: note, confidence: 0.1, message: o}")
    (tmp_path / "c.txt").write_text("rules: [{}]")
    rules = loaders.load_rules(str(tmp_path))
    assert [r.id for r in rules] == ["C3", "A1", "B2"] and rules[1].languages == ["go"] and rules[2].ast_config == {"max_params": 3}
    assert loaders.load_rules(str(tmp_path / "none")) == [] and loaders.parse_rules("") == []
    merged = loaders.merge_rules(rules, [R.Rule("A1", "note", 1.0, "new", "")])
    assert [(r.id, r.level) for r in merged] == [("A1", "note"), ("B2", "note"), ("C3", "note")]
    found = R.regex_scan(spark.createDataFrame([("a.go", "axx\nx"), ("a.py", "y")], "path string, content string"), rules).collect()
    assert sorted((r.uri, r.rule_id, r.start_line) for r in found) == [("a.go", "A1", 1), ("a.go", "A1", 2), ("a.py", "C3", 1)]


@pytest.mark.parametrize(
    ("rule", "why"),
    [
        ("{pattern: x, level: note, confidence: 1, message: m}", "missing required field: id"), ("{id: a, level: note, confidence: 1, message: m}", "missing required field: pattern"), ("{id: a, type: ast, level: note, confidence: 1, message: m}", "missing required field: ast_check"),
        ("{id: a, type: odd, pattern: x, level: note, confidence: 1, message: m}", "unknown rule type: odd"), ("{id: a, pattern: x, confidence: 1, message: m}", "missing required field: level"), ("{id: a, pattern: x, level: note, confidence: 1}", "missing required field: message"),
        ("{id: a, pattern: x, level: note, confidence: 0, message: m}", "confidence"), ("{id: a, pattern: x, level: note, confidence: 1.1, message: m}", "confidence"),
    ],
)
def test_rules_that_are_refused(rule, why):
    with pytest.raises(ValueError, match=why):
        loaders.parse_rules(f"rules:\n  - {rule}")


def test_rules_that_repeat_an_id_are_refused():
    with pytest.raises(ValueError, match="duplicate"):
        loaders.parse_rules("rules:\n" + "  - {id: a, pattern: x, level: note, confidence: 1, message: m}\n" * 2)


def test_suppression_and_corpus_files(spark, tmp_path):
    assert loaders.load_suppressions(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "s.yaml").write_text("suppressions:\n  - {rule_id: A1, file: ./a.go, reason: why}\n  - {rule_id: B2, reason: all}")
    s = loaders.load_suppressions(spark, str(tmp_path / "s.yaml"))
    assert [(r.s_ord, r.rule_id, r.file) for r in s.orderBy("s_ord").collect()] == [(0, "A1", "./a.go"), (1, "B2", "")]
    case = tmp_path / "corpus/go/one"
    case.mkdir(parents=True)
    (tmp_path / "corpus/.git/x").mkdir(parents=True)
    (case / "source.go").write_text("package x")
    (case / "metadata.yaml").write_text("name: one")
    (case / "expected.yaml").write_text("findings:\n  - {rule_id: any, severity: error, line_range: [3, 5], must_find: true}\n  - {rule_id: A1}")
    sources, expected = loaders.load_corpus(spark, str(tmp_path / "corpus"))
    assert [(r.case_id, r.content) for r in sources.collect()] == [("go/one", "package x")]
    assert [(r.rule_id, r.level, r.lo, r.hi, r.must_find) for r in expected.orderBy("ord").collect()] == [("any", "error", 3, 5, True), ("A1", "", 0, 0, False)]
    (tmp_path / "corpus/go/two").mkdir()
    with pytest.raises(ValueError, match="no source"):
        loaders.load_corpus(spark, str(tmp_path / "corpus"))


def test_runs_out_and_in(spark, tmp_path):
    rows = [("run1", 0, "A1", "error", "m \"q\"", "a.go", 3, 4, 0.5, "fast"), ("run1", 1, "B2", "note", "n", None, None, None, None, None)]
    f = spark.createDataFrame(rows, "run_id string, ord long, rule_id string, level string, message string, uri string, start_line int, end_line int, confidence double, tier string")
    results = [r.result for r in X.nested_run(f).orderBy("ord").collect()]
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1/log.json").write_text('{"runs": [\n{"results": [' + ",\n".join(results) + "]}]}")
    back = loaders.read_logs(spark, str(tmp_path / "*/log.json"))
    assert sorted(map(tuple, back.select(*f.columns).collect()), key=repr) == sorted(map(tuple, f.collect()), key=repr)
    assert loaders.read_baseline(spark, str(tmp_path / "run1/log.json"), str(tmp_path / "store")).count() == 2
    readers.write_run(f, str(tmp_path / "store"))
    assert loaders.read_baseline(spark, "run1", str(tmp_path / "store")).count() == 2 and loaders.read_baseline(spark, "run2", str(tmp_path / "store")).count() == 0
    assert readers.read_runs(spark, str(tmp_path / "store")).count() == 2
    loaders.write_results(f, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == sorted(results)
    v = spark.createDataFrame([("run1", "reject", "why")], "run_id string, decision string, reason string")
    loaders.write_verdicts(v, str(tmp_path / "verdicts"))
    assert loaders.read_verdicts(spark, str(tmp_path / "verdicts")).first().decision == "reject"
    loaders.append_run_metrics(M.run_measures(f), str(tmp_path / "metrics"))
    loaders.append_run_metrics(M.run_measures(f), str(tmp_path / "metrics"))
    assert [(r.total, r.llm, r.avg_conf) for r in loaders.read_run_metrics(spark, str(tmp_path / "metrics")).collect()] == [(2, 1, 0.25)] * 2


def test_alerts_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"number": 1, "state": "dismissed", "dismissed_reason": "false positive", "rule": {"id": "A1"}, "most_recent_instance": {"location": {"path": "a.go", "start_line": 3}}},\n {"number": 2, "state": "open"}]')
    a = readers.alert_verdicts(loaders.read_alerts(spark, str(tmp_path / "a.json")))
    assert [(r.number, r.verdict, r.rule_id, r.uri) for r in a.collect()] == [(1, "wrong", "A1", "a.go")]
    files = readers.read_files(spark, str(tmp_path / "a.json")).collect()
    assert len(files) == 1 and files[0].kind == "file" and files[0].content.startswith("[{")


def test_more_streams(spark, tmp_path):
    (tmp_path / "queue").mkdir()
    (tmp_path / "queue/1.json").write_text('{"team": "a", "rule_id": "r", "verdict": "noise", "ts": "2024-01-01T00:00:00"}\n{broken\n')
    (tmp_path / "queue/2.json").write_text('{"team": "a", "rule_id": "r", "verdict": "useful", "ts": "2024-01-01T00:05:00"}\n{"team": "b", "rule_id": "r", "verdict": "wrong", "ts": "2024-01-01T03:00:00"}\n')
    stream = loaders.queued_events(spark, str(tmp_path / "queue"), "team string, rule_id string, verdict string, ts timestamp")
    for _ in range(2):  # the second run has nothing new to deliver
        assert jobs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), lambda d: d.where("team is not null")).awaitTermination(120) in (True, None)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 3
    q = jobs.profiles(stream).writeStream.format("memory").queryName("profiles").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.team, r.total, r.noise) for r in spark.table("profiles").collect()) == [("a", 2, 1), ("b", 1, 0)]
    q = jobs.debounce(stream, "team").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.team, r.changes) for r in spark.table("bursts").collect()] == [("a", 2)]


def test_summary_text(spark):
    s = spark.createDataFrame([("base", 3.0, 0.5)], "variant string, total_mean double, total_std double")
    assert [r.text for r in reports.summary_text(s, "variant", {"Total findings": "total"}).collect()] == ["  Total findings              3.0 ±0.5  "]


def test_run_name_of_any_name(spark, tmp_path):
    """Slashes, backslashes, colons and spaces of the name itself too, one for one, in the query and in its SQL."""
    names = ["Customer#1", "a  b@c", "a/b\\c:d e", "\\\\x::y//z", "", None, "é ü/ß", " x\ty\n"]
    spark.createDataFrame(list(enumerate(names)), "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    mine = sorted((r.c_custkey, r.name) for r in registry.QUERIES["run_name"](spark, str(tmp_path)).collect())
    put = lambda x: "".join("-" if c in "/\\: " else c for c in f"//git@#{x or ''} /x:")
    assert mine == [(k, put(x)) for k, x in enumerate(names)]
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert mine == sorted(con.execute(registry.ORACLES["run_name"]).fetchall())


def _plain_enclosing(findings, functions):
    """Of each finding (run, ord, uri, line) the least (span, fn_ord, name) of functions (run, uri, name, fn_ord, start, end)."""
    out = []
    for run, no, uri, line in findings:
        around = [(e - s, k, n) for r, u, n, k, s, e in functions if (r, u) == (run, uri) and None not in (uri, line, s, e) and s <= line <= e]
        out.append((run, no, min(around)[2] if around else None))
    return sorted(out, key=repr)


def test_enclosing_of_any_lines(spark):
    """Lines of all sizes, below 0 too, at the edges of blocks, ties, nulls, functions that end before they start or never."""
    rnd = random.Random(5)
    edge = [w * k + d for w in (1, 3, 64, 4096, 2**18, 2**24) for k in (-2, 1, 3) for d in (-1, 0, 1)] + [2**31 - 2, 0]
    span = lambda s: s + rnd.choice([-3, 0, 1, 5, 30, 62, 63, 64, 127, 300, 5000, 2**20, 2**30])
    functions = [(rnd.choice(["A", "B", None]), rnd.choice(["u", "v", None]), f"n{k % 50}", k % 90, s := rnd.choice(edge), min(span(s), 2**31 - 1)) for k in range(700)]
    functions += [("A", "u", "null", 0, None, 9), ("A", "u", "null", 0, 1, None), ("B", "v", "file", 1, 0, 2**31 - 1)]
    findings = [(rnd.choice(["A", "B", None]), no, rnd.choice(["u", "v", "w", None]), rnd.choice([*edge, rnd.randrange(6000), None])) for no in range(900)]
    findings += findings[:20]  # rows that are there twice stay twice
    f = spark.createDataFrame(findings, "run_id string, ord long, uri string, start_line int").selectExpr("*", "'x' as line", "'y' as level")
    assert A.enclosing(f, spark.createDataFrame([("u", "n", 0, 1, 9)], "uri string, name string, fn_ord int, start_line int, end_line int")).columns == [*f.columns, "function"]
    g = spark.createDataFrame(functions, "run_id string, uri string, name string, fn_ord int, start_line int, end_line int")
    got = lambda rows, width: sorted(((r.run_id, r.ord, r.function) for r in rows(width).collect()), key=repr)
    for width in (64, 7):
        assert got(lambda w: A.enclosing(f, g, w), width) == _plain_enclosing(findings, functions)
        alone = [(None, *x[1:]) for x in findings]
        assert [x[1:] for x in got(lambda w: A.enclosing(f.withColumn("run_id", F.lit(None).cast("string")), g.drop("run_id"), w), width)] == [x[1:] for x in _plain_enclosing(alone, [(None, *x[1:]) for x in functions])]


def test_enclosing_does_not_pair_findings_with_functions(spark):
    """A file of 1200 functions around each line and 1200 findings on few lines: no join makes as many rows as there are pairs."""
    f = spark.range(1200).selectExpr("'r' as run_id", "id as ord", "'u' as uri", "cast(id % 40 + 1000 as int) as start_line")
    g = spark.range(1200).selectExpr("'u' as uri", "concat('n', id) as name", "id as fn_ord", "cast(id % 300 as int) as start_line", "cast(2000 + id % 700 as int) as end_line")
    out = A.enclosing(f, g)
    assert sum(r.function is not None for r in out.collect()) == 1200
    made, todo = [], [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            made.append(node.metrics().apply("numOutputRows").value())
    assert len(made) == 2 and max(made) <= 6 * 1200
