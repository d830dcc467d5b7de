"""Repair of conversations, hard negatives and near-duplicate embeddings against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import common, hard_negatives, multi_index, queries, turn_repair

SF = "/root/testdata/sf0.001"


# --- conversations ---------------------------------------------------------------------------------------------------


def cheapest(codes, initials):
    """(cost, letters) of the cheapest edits with the least letters, by all prefixes of rows."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {(len(codes), ""): (0, ""), (len(codes), "a"): (0, "")}

    def at(i, state, room):
        """room: how many turns may still be inserted here."""
        if (i, state) in best and room == 3:
            return best[i, state]
        options = [(0, "")] if i == len(codes) and state in ("", "a") else []
        if room:
            c, t = at(i, turn[state], room - 1)
            options.append((c + 5, "I" + t))
        if i < len(codes):
            c, t = at(i + 1, state, 3)
            options.append((c + 2, "D" + t))
            if codes[i] < 2:
                more = 5 * codes[i]
                if initials[i] in after[state]:
                    c, t = at(i + 1, after[state][initials[i]], 3)
                    options.append((c + more, "K" + t))
                c, t = at(i + 1, turn[state], 3)
                options.append((c + more + 1, "R" + t))
        found = min(options, default=(10**9, ""))
        if room == 3:
            best[i, state] = found
        return found

    return at(0, "", 3)


def repaired(rows, initials, letters):
    after, turn, out, state, i = {"s": "s", "u": "u", "a": "a"}, {"": "u", "s": "u", "u": "a", "a": "u"}, [], "", 0
    names = {"u": "user", "a": "assistant"}
    for x in letters:
        if x in "IR":
            state = turn[state]
            out.append((names[state], rows[i][1] if x == "R" else ""))
        elif x == "K":
            state = after[initials[i]]
            out.append(rows[i])
        i += x != "I"
    return out


def report(conversations):
    """What op11 asks for, row by row. conversations: (conv_id, turn, role, text)."""
    groups = {c: [] for c, *_ in conversations}
    for c, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            groups[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, rows in groups.items():
        hashed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashed(r[2])))
        turns, seen, codes = [r[0] for r in rows if r[0] is not None], set(), []
        for _, role, text in rows:
            spoken = text.rstrip(" \t\n\x0b\f\r")
            codes.append(2 if not spoken else 3 if (role, text) in seen else int(spoken[-1] not in ".!?"))
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, letters = cheapest(codes, initials)
        lines = "\n".join(f"{r}:{t}" for r, t in repaired([r[1:] for r in rows], initials, letters))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = Counter(codes)
        out.append((c, gaps, n[2], n[3], n[1], illegal, cost, letters, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_turn_repair_query(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").collect()]
    assert found(queries.op11_turn_repair(spark, SF)) == report(rows)


@pytest.mark.parametrize("chunk", [4096, 4])
def test_turn_repair_as_brute_force(spark, monkeypatch, chunk):
    """Nulls, blanks, repeated rows, shared turns, odd roles; chunks that cut conversations."""
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["Yes.", "No!", "cut off", " ", "", None, "\x0b\t", "who?", "été.", "a b c.  "]
    roles = ["user", "assistant", "system", "tool", None, "", "usher", "Ünder"]
    rows = [(None if c == 9 else c, rng.choice([None, *range(9)]) if rng.random() < 0.2 else i, rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.5 else f"text {i}{rng.choice('.!x')}") for c in range(12) for i in range(rng.choice([1, 2, 5, 11, 23]))]
    rows += rng.sample(rows, 6) + [(77, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("no", F.lit(1)).withColumn("chunk", F.lit("x"))
    assert found(turn_repair.repair_report(turn_repair.damaged(df), df)) == report(rows)


def test_turn_repair_of_one_long_conversation_and_long_texts(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(9000)] + [(2, 0, "user", "w " * 1_500_000 + "."), (2, 1, "assistant", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    mine = {r.conv_id: r for r in turn_repair.repair_report(df, df).collect()}
    assert (mine[1].audit, mine[1].cost) == ("K" * 9000, 0)
    assert mine[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:9000]).encode()).hexdigest()
    assert (mine[2].audit, mine[2].truncated) == ("DD", 1)


def test_repaired_rows_and_empty_conversations(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "tool", "Yes."), (2, 0, "user", "Well."), (2, 1, "user", "And?")], SCHEMA)
    rows = sorted((r.conv_id, r.chunk, r.at, r.role, r.text, r.edit) for r in turn_repair.repair(df).collect())
    assert [(r[0], *r[3:]) for r in rows] == [(1, "user", "Hi.", "K"), (1, "assistant", "Yes.", "R"), (2, "user", "Well.", "K"), (2, "assistant", "And?", "R")]
    none = df.limit(0)
    assert turn_repair.repair(none).count() == 0 and turn_repair.repair_report(none, none).count() == 0
    left = turn_repair.repair_report(none, df).collect()
    assert {tuple(r)[1:] for r in left} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_block_tables_as_single_steps():
    t, rng = turn_repair.Tables(), np.random.default_rng(5)
    assert len(t.vectors) < 200
    for n in (0, 1, 2, 3, 7, 50):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        at, cost = t.through(symbols)
        v = list(turn_repair.LAST)
        for s in symbols[::-1]:
            v = turn_repair.before(int(s), tuple(v))
        assert tuple(c + int(cost[t.last]) for c in t.vectors[at[t.last]]) == tuple(v)


# --- hard negatives --------------------------------------------------------------------------------------------------


def negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (vec_id, label, vector)."""
    fine = [(i, lab, [math.floor(x * 256) if abs(x) < 1e290 else int(x) * 256 for x in v]) for i, lab, v in rows if None not in (i, lab, v) and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, lab, q in {(a, b, tuple(c)) for a, b, c in fine if a % 50 == 0}:
        dot = [(sum(x * y for x, y in zip(q, w, strict=True)), i, m) for i, m, w in fine if i != a and len(w) == len(q)]
        best = sorted(dot, key=lambda x: (-x[0], x[1]))
        for p, i, _ in [x for x in best if x[2] == lab][:5]:
            hard = [x for x in best if x[2] != lab and 50 * p <= 100 * x[0] <= 95 * p][:3]
            out += [(a, i, r, x[1], common.as_long(p), common.as_long(x[0])) for r, x in enumerate(hard, 1)]
    return sorted(out)


def vector_rows(rng, n, d=6):
    rows = [(i, i % 3 if i % 11 else None, [float(np.float32(x)) for x in rng.normal(size=d)]) for i in range(n)]
    rows[5] = (5, 1, None)
    rows[6] = (6, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0])
    rows[7] = (7, 1, [float("nan")] * d)
    rows[8] = (8, 1, [float("inf")] * d)
    rows[9], rows[10] = (9, 1, []), (None, 1, [1.0] * d)
    rows += [rows[100], rows[101], rows[12], (n, 0, [1.0, 2.0]), (n + 1, 1, [1.0, 1.0]), (50 * n, 0, [1.0, 1.5])]
    rows += [(n + 10 + i, i % 3, rows[100][2]) for i in range(9)]
    return rows


KINDS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("scale", [1.0, 9e6, 1e18, 1e300])
def test_hard_negatives_as_brute_force(spark, monkeypatch, scale):
    """Narrow components, ones whose sums leave 64 bits, ones beyond that, and ones near the end of doubles, mixed."""
    monkeypatch.setattr(hard_negatives, "BLOCK_COMPONENTS", 600)
    rows = vector_rows(np.random.default_rng(3), 180)
    rows = [(i, lab, [x * scale if x is not None else x for x in v] if v and i is not None and i % 4 == 1 else v) for i, lab, v in rows]
    df = spark.createDataFrame(rows, KINDS).withColumn("score", F.lit("x")).withColumn("group", F.lit(0))
    got = hard_negatives.hard_negatives(df.where("vec_id % 50 = 0"), df)
    assert sorted(tuple(r) for r in got.collect()) == negatives(rows)
    assert len(negatives(rows)) > 10


def test_hard_negatives_of_empty_tables(spark):
    none, some = spark.createDataFrame([], KINDS), spark.createDataFrame([(0, 1, [1.0]), (1, 1, [2.0]), (2, 2, [1.5])], KINDS)
    assert hard_negatives.hard_negatives(none, some).count() == hard_negatives.hard_negatives(some, none).count() == 0
    assert [tuple(r) for r in hard_negatives.hard_negatives(some.where("vec_id = 0"), some).collect()] == [(0, 1, 1, 2, 131072, 98304)]


def test_order_keys():
    n = sorted([*range(-600, 600), *(s * 2**k + d for k in (15, 16, 63, 64, 200) for s in (1, -1) for d in (-1, 0, 1))])
    assert [common.key_number(common.order_key(x)) for x in n] == n
    assert sorted(map(common.order_key, n)) == list(map(common.order_key, n))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_embedding_dedup"])
def test_vector_queries_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == sorted(want) and want


# --- near-duplicate embeddings ---------------------------------------------------------------------------------------


def groups(rows, cosine):
    """(vec_id, n_links, component_id, kept) by all pairs; rows (vec_id, label, vector)."""
    ok = [None not in (i, lab, v) and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, lab, v in rows]
    units = [np.array(v) / np.abs(v).max() if o else None for (_, _, v), o in zip(rows, ok, strict=True)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]):
            a, b = units[i], units[j]
            if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    component = [r[0] if r[0] is None or not ok[i] else min(least[top(i)]) for i, r in enumerate(rows)]
    return sorted(((r[0], links[i], component[i], r[0] == component[i]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("per_cell", "members", "kind"), [(512, 2048, "double"), (4, 7, "double"), (2, 3, "float")])
def test_vector_groups_as_brute_force(spark, monkeypatch, per_cell, members, kind):
    """Groups of near copies, exact and scaled ones, chains, and what takes no part; with small cells and turns."""
    monkeypatch.setattr(multi_index, "MEMBERS", members)
    monkeypatch.setattr(multi_index, "VISITORS", members * 3)
    rng = np.random.default_rng(per_cell)
    rows = vector_rows(rng, 150)
    for centre in range(6):
        c, n = rng.normal(size=6), len(rows)
        rows += [(1000 + n + i, centre % 3, [float(np.float32(x)) for x in c + rng.normal(size=6) * 0.04 * (i % 9)]) for i in range(25)]
    rows += [(3000 + i, rows[i + 20][1], [x * 2.0 for x in rows[i + 20][2]]) for i in range(10)] + [(4000, 1, [0.0] * 6), (4001, 1, [-0.0] * 6)]
    df = spark.createDataFrame(rows, KINDS).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).withColumn("no", F.lit("x")).withColumn("cell", F.lit(1))
    got = multi_index.near_duplicate_vectors(df, 0.98, per_cell=per_cell)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == groups(rows, 0.98)
    assert sum(r[1] for r in groups(rows, 0.98)) > 200


def test_a_lower_recall_visits_fewer_cells():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = multi_index.Grid.fit(x[:1000], 12)
    whole, part = grid.stop(x[:1000], 0.98, 1.0), grid.stop(x[:1000], 0.98, 0.95)
    assert part < whole
    other = 0.98 * x + math.sqrt(1 - 0.98**2) * (lambda a: a / np.linalg.norm(a, axis=1, keepdims=True))((lambda a: a - (a * x).sum(axis=1, keepdims=True) * x)(rng.normal(size=x.shape)))
    (_, bounds), (home, _) = grid.bounds(x), grid.bounds(other)
    seen = {stop: [h in grid.visits(bounds, i, stop) for i, h in enumerate(home.tolist())] for stop in (whole, part)}
    assert all(seen[whole]) and np.mean(seen[part]) > 0.9
    cost = {stop: np.mean([len(grid.visits(bounds, i, stop)) for i in range(200)]) for stop in (whole, part)}
    assert cost[part] < cost[whole] < 144


def test_traversal_is_in_order_of_bounds():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 9))
    grid = multi_index.Grid.fit(x, 7)
    home, bounds = grid.bounds(x)
    for i in range(20):
        seen = grid.visits(bounds, i, 0.5)
        width = len(grid.books[1])
        sums = bounds[0][i][seen // width] + bounds[1][i][seen % width]
        assert seen[0] == home[i] or sums[0] == 0
        assert (np.diff(sums) >= 0).all() and len(set(seen.tolist())) == len(seen) == int(((bounds[0][i][:, None] + bounds[1][i]) <= 0.5).sum())


def test_vector_groups_of_an_empty_table(spark):
    assert multi_index.near_duplicate_vectors(spark.createDataFrame([], KINDS)).count() == 0
