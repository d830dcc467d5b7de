"""Policies, nearest examples, corpora, ingest and sliding figures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import lifecycle as L
from quern.operators import nearest as N
from quern.operators import policy as Y
from quern.operators import sliding as S
from quern.sources import loaders
from quern.streaming import ingest

F_SCHEMA = "run_id string, rule_id string, level string, uri string, start_line int, confidence double, tier string, baseline_state string, suppressed_by string"


def test_policy_of_a_file(spark):
    rows = [("a", "S1", "error", "x.go", 1, 0.9, "fast", None, None), ("a", "S2", "note", None, None, None, None, None, None), ("b", "S1", "error", "x.go", 1, 0.9, None, "unchanged", None), ("c", "S1", "error", "x.go", 1, 0.9, None, "new", "why"), ("d", "S1", "error", "x.go", 1, 0.85, None, "new", None)]
    f = spark.createDataFrame(rows, F_SCHEMA)
    decided = lambda p: {r.run_id: r.decision for r in Y.decide(f, p).collect()}
    assert decided(Y.DEFAULT) == {"a": "reject", "b": "merge", "c": "merge", "d": "review"}
    own = Y.parse_policy('let odd = rule like "S%" and file <> "x#y" # a comment\nlet bare = odd and not (line > 0)\nreject when bare > 0\n')
    assert decided(own) == {"a": "reject", "b": "review", "c": "review", "d": "review"}
    assert decided(Y.parse_policy("default merge")) == dict.fromkeys("abcd", "merge")
    assert Y.decide(f.limit(0), own).count() == 0


@pytest.mark.parametrize(("text", "why"), [("default maybe", "p:1: unknown decision"), ("\nlet x = colour = 3", "p:2: unknown name 'colour'"), ("let level = line > 1", "p:1: 'level' is taken"), ("let a = line > 1\nlet a = line > 2", "p:2: 'a' is taken"), ("merge when x = 0", "p:1: unknown name 'x'"), ("let a = line ; 1", "p:1: can't read"), ("accept when all = 0", "p:1: unknown decision 'accept'"), ("line > 3", "p:1: neither"), ('let a = rule = "', "p:1: can't read")])
def test_what_is_wrong_with_a_policy(text, why):
    with pytest.raises(Y.PolicyError, match=why):
        Y.parse_policy(text, "p")


def test_strings_of_policies_stay_strings(spark):
    f = spark.createDataFrame([("a", "it's \\ \"q\"", "error", None, None, None, None, None, None)], F_SCHEMA)
    p = Y.parse_policy('let x = rule = "it\'s \\\\ \\"q\\""\nlet y = rule = "\' or true or \'"\nreject when y > 0\nmerge when x = 1')
    assert Y.decide(f, p).first().decision == "merge"


def test_the_last_policy_file_counts(tmp_path):
    assert Y.load_policy(str(tmp_path / "none"), Y.DEFAULT) is Y.DEFAULT and Y.load_policy(str(tmp_path), Y.DEFAULT) is Y.DEFAULT
    (tmp_path / "a.policy").write_text("default reject")
    (tmp_path / "b.policy").write_text("default merge")
    (tmp_path / "c.txt").write_text("default review")
    assert Y.load_policy(str(tmp_path), Y.DEFAULT).default == "merge"


@pytest.mark.parametrize("block", [4096, 5])
def test_nearest_examples_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUESTIONS", block)
    rng = random.Random(2)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]
    examples = [(i, rng.choice("ab"), vector()) for i in range(60)] + [(70, "a", None), (71, "a", [0.0] * 3), (72, "a", [1.0, float("nan"), 0.0]), (73, None, [1.0] * 3), (74, "a", [1.0, 2.0])]
    questions = [(i, rng.choice("abc"), vector()) for i in range(30)] + [(30, "a", None), (31, "a", [3.0, 1.0])]
    norm = lambda v: sum(x * x for x in v) ** 0.5
    fine = lambda v: v and None not in v and all(x == x for x in v) and any(v)
    want = {}
    for no, g, v in questions:
        near = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), 9), i) for i, h, w in examples if fine(v) and fine(w) and h == g and len(v) == len(w))[:3]
        want |= {(no, r): -c for r, (c, _) in enumerate(near, 1)}
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, team string, v array<double>")
    found = N.nearest_examples(frame(questions, "no"), frame(examples, "id")).collect()
    assert {(r.no, r.rank): pytest.approx(r.cosine, abs=1e-9) for r in found} == want
    assert N.nearest_examples(frame(questions, "no"), frame(examples[:0], "id")).count() == 0


def test_corpus_of_many_cases(spark, tmp_path):
    n = 600
    for i in range(n):
        case = tmp_path / ("go" if i % 2 else "py") / f"case{i:04}"
        case.mkdir(parents=True)
        (case / "b.src").write_text("second")
        (case / "a.src").write_text(f"source {i} é")
        (case / "expected.yaml").write_text(json.dumps({"findings": [{"rule_id": "any", "severity": "error", "line_range": [i, i + 1], "must_find": True}] * (i % 3)}))
        (case / "metadata.yaml").write_text("{}")
    (tmp_path / ".hidden/case").mkdir(parents=True)
    (tmp_path / "go/.git").mkdir()
    sources, expected = loaders.load_corpus(spark, str(tmp_path))
    assert {(r.case_id, r.language, r.content) for r in sources.collect()} == {(f"{'go' if i % 2 else 'py'}/case{i:04}", "go" if i % 2 else "py", f"source {i} é") for i in range(n)}
    assert expected.count() == sum(i % 3 for i in range(n)) and expected.where("case_id = 'go/case0005'").orderBy("ord").first().lo == 5
    (tmp_path / "go/case0001/expected.yaml").unlink()
    with pytest.raises(ValueError, match="no expected.yaml found in go/case0001"):
        loaders.load_corpus(spark, str(tmp_path))


def request(folder, name, team, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(events if isinstance(events, str) else json.dumps({"team_id": team, "events": events}))


def feedback(rule, verdict, confidence=0.5, team="acme", **more):
    return {"type": "feedback_received", "team_id": team, "timestamp": "2026-03-04T00:00:00Z", "payload": {"rule_id": rule, "verdict": verdict, "confidence": confidence}} | more


def test_a_bad_event_turns_its_batch_away_and_a_crash_counts_nothing_twice(spark, tmp_path):
    folder, store = tmp_path / "in", ingest.Store(spark, str(tmp_path / "store"))
    request(folder, "1.json", "acme", [feedback("S1", "noise")] * 6 + [feedback("S1", "useful", 0.9)] * 2)
    request(folder, "2.json", "acme", [feedback("S1", "useful"), feedback("S1", "great")])
    request(folder, "3.json", "", [feedback("S1", "useful", team="")])
    request(folder, "4.json", "acme", [])
    request(folder, "5.json", "", "not json")
    request(folder, "6.json", "acme", [feedback("S2", "wrong", type="surprise")])
    request(folder, "7.json", "acme", [feedback("S2", "wrong", timestamp="soon")])
    request(folder, "8.json", "beta", [feedback("S2", "wrong", team="acme")])

    stream = lambda: ingest.requests(spark, str(folder), 3)
    write, left = store._write, {"n": 5}

    def broken(df, name, batch):
        left["n"] -= 1
        if left["n"] == 0:
            raise RuntimeError("lost")
        write(df, name, batch)

    store._write = broken
    q = store.start(stream(), str(tmp_path / "c"))
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    store._write = write
    store.start(stream(), str(tmp_path / "c")).awaitTermination()
    row = store.profiles().where("rule_id = 'S1'").first()
    assert (row.total, row.noise, row.useful, row.suppress_below, row.noise_rate) == (8, 6, 2, 0.5, 0.75) and row.conf_calibration == pytest.approx(0.4)
    assert store.read("events").count() == 8 and store.profiles().count() == 1
    assert sorted(r.why for r in store.read("turned_away").collect()) == ["bad feedback", "bad timestamp", "event of another team", "no events", "no team", "not readable", "unknown event type"]
    # a batch that is taken once more gives the same
    rows = spark.read.schema(ingest.REQUEST).option("multiLine", True).json(str(folder / "1.json")).withColumn("request", F.lit("1"))
    last = max(r.number for r in spark.read.parquet(str(tmp_path / "store/ledger")).collect())
    store.take(rows, last + 1)
    store.take(rows, last + 1)
    assert store.profiles().where("rule_id = 'S1'").first().total == 16


EVENTS = "ts timestamp, tier string, error string, finding_count long, ms long, queue_ms long, total_ms long, tokens_in long, tokens_out long, cache_result string"


def test_last_hours_as_plain_recomputation(spark):
    rng = random.Random(4)
    start = dt.datetime(2026, 1, 1)
    events = [(start + dt.timedelta(seconds=rng.randrange(3 * 3600)), rng.choice("ab"), rng.choice(["", "x"]), rng.randrange(4), rng.choice([None, *range(40)]), rng.randrange(9), rng.randrange(99), rng.randrange(50), rng.randrange(5), rng.choice(["hit", "miss", "stale", ""])) for _ in range(500)]
    df = spark.createDataFrame(events, EVENTS)
    # of two halves of the events, as batches bring them
    parts = [df.where("queue_ms < 4"), df.where("queue_ms >= 4")]
    sums, counts = S.minute_sums(parts[0]).unionByName(S.minute_sums(parts[1])), S.minute_counts(parts[0]).unionByName(S.minute_counts(parts[1]))
    found = {r.until: r for r in S.last_hours(sums, counts, 60, 5).collect()}
    for i in range(1, 48):
        until = start + dt.timedelta(minutes=5 * i)
        own = [e for e in events if until - dt.timedelta(hours=1) <= e[0] < until]
        if not own:
            assert until not in found
            continue
        r, ms = found[until], sorted(e[4] for e in own if e[4] is not None)
        assert (r.n, r.findings, r.tokens_in, r.tokens_out, r.max_ms) == (len(own), sum(e[3] for e in own), sum(e[7] for e in own), sum(e[8] for e in own), ms[-1])
        assert (r.p50, r.p95, r.p99) == tuple(ms[int((len(ms) - 1) * p)] for p in (0.5, 0.95, 0.99))
        hits = [e[9] for e in own if e[9]]
        assert r.hit_rate == pytest.approx(hits.count("hit") / len(hits)) and r.per_minute == pytest.approx(len(own) / 60) and r.avg_queue_ms == pytest.approx(sum(e[5] for e in own) / len(own))


def test_service_figures_without_events_and_as_json(spark):
    none = spark.createDataFrame([], EVENTS)
    row, tiers = S.service_stats(none)
    assert (row.first().n, row.first().per_minute, tiers.count()) == (0, 0.0, 0)
    some = spark.createDataFrame([(dt.datetime(2026, 1, 1, 0, i), "fast", "", 2, 10 * i, 1, 2, 3, 4, "hit") for i in range(1, 4)], EVENTS)
    row, tiers = S.service_stats(some)
    said = json.loads(S.stats_json(row, tiers).first().json)
    assert (said["n"], said["per_minute"], said["w_p50"], said["w_max_ms"], said["hit_rate"]) == (3, 1.5, 20, 30, 1.0)
    assert said["by_tier"] == {"fast": {"n": 3, "avg_ms": 20.0, "error_rate": 0.0}}
    lines = [r.text for r in S.report(row, tiers).orderBy("place").collect()]
    assert "P50:                20ms" in lines and lines[-1] == "fast: Count: 3, Avg Latency: 20ms, Error Rate: 0.0%"


def test_unsuppress_says_what_it_did_not_find(spark):
    s = spark.createDataFrame([(0, "S1", "a.go", "w"), (1, "S2", "", "w")], "s_ord long, rule_id string, file string, reason string")
    gone = lambda *rows: spark.createDataFrame(rows, "rule_id string, file string")
    assert [r.s_ord for r in L.checked_unsuppress(s, gone(("S1", "./a.go"))).collect()] == [1]
    with pytest.raises(ValueError, match="no suppression of rule S3"):
        L.checked_unsuppress(s, gone(("S2", ""), ("S3", "")))


@pytest.mark.parametrize(("text", "value"), [('log {"id":"x","n":{}}', "x"), ('{"id":"y","r":[{"a":1}]}', "y"), ('{"id":"a"} and {"id":"b","n":{"id":"c"}}', "b"), ('{"id":"whole","n":{"id":"z"}}', "whole"), ("none", ""), ('{"id":""}', ""), ('x {"id":"p"} then {"k":1} end', ""), ('a { b {"id":"q"}', "q"), (None, ""), ('{"id":"k"} tail', "k")])
def test_last_json_field(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(T.last_json_field(F.col("t"), "id").alias("v")).first().v == value
