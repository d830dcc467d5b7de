"""Stages of the pipeline against plain versions of their own, on awkward rows; and one very long text through every operator."""

import math
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, mixing, near_dedup, piece_counts, pitman_yor, quality, queries, secrets, sharding, token_store

from . import texts
from .test_operators import BPE, mixed

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def plain_scores(model, rows):
    size = lambda data, t: sum(len(zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(t[i : i + 2048])) for i in range(0, len(t), 2048))
    out = []
    for text in rows:
        t = (text or "").encode()
        gap = (size(model.bad, t) - size(model.good, t)) / max(1, len(t))
        out.append(1 / (1 + math.exp(-(model.weights[0] * gap / model.spread + model.weights[1]))))
    return out


def test_quality_stage_as_plain_python(spark):
    docs = queries.table(spark, SF, "documents")
    docs = docs.unionByName(docs.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**7, "", "en", "x", 0)], docs.schema))
    rows = docs.collect()
    model = quality.fit(docs, queries.table(spark, SF, "labels"))
    scores = plain_scores(model, [r.text for r in rows])
    assert all(abs(s - 0.5) > 1e-9 for s in scores)
    want = Counter((r.doc_id, r.text) for r, s in zip(rows, scores, strict=True) if s >= 0.5)
    kept = STAGES["quality"](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == want and 0 < len(kept) < len(rows)


def test_mix_stage_as_recursion(spark):
    docs = [(i, t) for i, t in texts.awkward(3) if i is not None]
    kept = STAGES["mix"](spark, texts.frame(spark, docs), SF)
    want, _ = mixed(docs, 0.5, 1, [queries.WEIGHTS[x] for x in ("domain", "lang", "source")])
    assert kept.columns == texts.frame(spark, docs).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, _), n in want.items()})


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_keep_columns_of_any_name_and_empty_tables(spark, name):
    docs = texts.frame(spark, texts.awkward(5, 12))
    odd = {"place_among_repeats": F.lit("p"), "kept_aside_quality_score": F.lit("k"), "kept_aside_mix_tokens": F.lit("a"), "mix_epoch": F.lit("e"), "hit_id": F.lit("h"), "text_hash": F.lit("t"), "h": F.lit(1), "bucket": F.lit("b"), "row": F.lit("r"), "kept": F.lit("x"), "m": F.create_map(F.lit("a"), F.lit(1))}
    docs = docs.withColumns(odd)
    out = STAGES[name](spark, docs, SF)
    rows, given = out.collect(), Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(n <= given[k] for k, n in Counter((r.doc_id, r.text) for r in rows).items()) and (rows or name == "quality")
    assert out.columns == docs.columns if name != "shard" else {*docs.columns} <= {*out.columns}
    same = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars") and (name, c) not in (("shard", "shard"), ("shard", "slot"))]
    first = docs.first()
    assert all(r[c] == first[c] for r in rows for c in same)
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0


def test_a_long_text_through_every_operator(spark):
    """3 MB of words, 1.5 MB without a space, and a short text."""
    words = " ".join(f"w{i * 7919 % 5003} password = abcdef{i % 90}" if i % 50 == 0 else f"w{i * 7919 % 5003}" for i in range(450_000))
    docs = [(1, words), (2, words + " end"), (3, "x" * 1_500_000), (4, "short")]
    frame = texts.frame(spark, docs)
    found = {r.doc_id: r for r in near_dedup.near_duplicates(frame).collect()}
    assert [found[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 4] and found[1].n_shingles == len(texts.shingles(words, 5))
    rows = sharding.external_shuffle(frame, shards=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter([1, 2, 3, 4])
    ten = " ".join(texts.ascii_words(words)[400_000:400_010])
    bench = spark.createDataFrame([("b", ten), ("c", "not there at all, is it, no, never and nowhere")], "item_id string, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(frame, bench).collect()}
    assert hit[1][0] == len(texts.ascii_words(words)) and hit[1][1] >= 10 and hit[1][2] == 1 and hit[3] == (1, 0, 0) and hit[4] == (1, 0, 0)
    model = quality.fit(frame, spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int"))
    assert all(0 <= r.quality_score <= 1 for r in quality.score(frame, model).collect())
    report = {r.doc_id: r.n_assign for r in secrets.secret_report(frame).collect()}
    assert report == {1: 9000, 2: 9000, 3: 0, 4: 0}
    tokens = {r.doc_id: (r.start, r.n_tokens) for r in token_store.token_table(frame, BPE).collect()}
    counts = {r.doc_id: r.n_pieces for r in piece_counts.piece_counts(frame, BPE).collect()} if "n_pieces" in piece_counts.piece_counts(frame, BPE).columns else None
    assert tokens[1][0] == 0 and tokens[2][0] == tokens[1][1] and tokens[2][1] > 450_000
    assert counts is None or counts[1] >= 450_000
    scored = {r.doc_id: r for r in pitman_yor.language_model(frame).collect()}
    assert scored[1].n_tokens == len(words.split()) + 1 and math.isfinite(scored[1].score) and scored[3].n_tokens == 2
    assert {r.doc_id for r in mixing.mix(frame, queries.LEVELS, queries.WEIGHTS, fraction=1.0, epochs=1).collect()} <= {1, 2, 3, 4}
