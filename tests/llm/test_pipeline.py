"""Each stage of the pipeline against a plain version on what the stage before kept."""

from collections import Counter

import corpus_pipeline
from quern.llm import quality, queries
from quern.llm.common import written

from . import texts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    extra = [(None, "a text without an id of its own", "en", "src1", 5), (10**6, None, None, None, None), (10**6 + 1, "", "fr", "x", 0)]
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame(extra, docs.schema))
    columns, kept = docs.columns, {}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        rows = docs.collect()
        assert docs.columns == columns or name == "shard"
        kept[name] = (before, rows)
        before = rows

    old, new = kept["quality"]
    start = spark.createDataFrame(old, queries.table(spark, SF, "documents").schema)
    scored = quality.score(start, quality.fit(start, queries.table(spark, SF, "labels"))).where("quality_score >= 0.5").collect()
    assert Counter((r.doc_id, r.text) for r in new) == Counter((r.doc_id, r.text) for r in scored)

    old, new = kept["near_dedup"]
    want = {i for i, _, _, keep in texts.near_duplicates(list({(r.doc_id, r.text) for r in old}), 80, 5) if keep}
    assert Counter(r.doc_id for r in new) == Counter(want)

    old, new = kept["decontaminate"]
    found = texts.windows([tuple(r) for r in queries.table(spark, SF, "benchmark").collect()], 10)
    phrases = {p for p, _ in found}
    grams = lambda t: {tuple(w[i : i + n]) for w in [texts.ascii_words(t)] for n in {len(p) for p in phrases} for i in range(len(w) - n + 1)}
    assert Counter(r.doc_id for r in new) == Counter(r.doc_id for r in old if not grams(r.text) & phrases)
    assert len(new) < len(old)

    old, new = kept["mix"]
    ids = {r.doc_id for r in new}
    assert ids <= {r.doc_id for r in old} and len(ids) == len(new) and 0 < len(new) < len(old)

    old, new = kept["shard"]
    assert Counter((r.doc_id, r.text) for r in old) == Counter((r.doc_id, r.text) for r in new)
    n = Counter(r.shard for r in new)
    assert max(n.values()) - min(n.values()) <= 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 20 and {"shard", "slot"} <= set(out.columns)
