"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, mixing, multi_index, near_dedup, piece_counts, pitman_yor, quality, secrets, sharding, token_store, topk, turn_repair

#: A mixture over domain, language and source; what isn't named weighs 1.
LEVELS = {
    "domain": "case when try_cast(substring(source, 4, 2) as int) < 5 then 'web' when try_cast(substring(source, 4, 2) as int) < 12 then 'books' else 'forum' end",
    "lang": "lang",
    "source": "source",
}
WEIGHTS = {"domain": {"web": 4, "books": 3, "forum": 3}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 1, "src1": 2}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold_pct=85, width=3)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.external_shuffle(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", sharding.row_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    s = F.col("quality_score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), F.when(s >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_store.token_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "n_end", "first_end")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.language_model(table(spark, sf_dir, "documents"), pitman_yor.held_out(F.col("doc_id")))


def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.piece_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"), LEVELS, WEIGHTS, fraction=0.5, epochs=2)
    return chosen.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_epoch")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return turn_repair.repair_report(turn_repair.damaged(c), c)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh row are moved on by one first, so that some are wrong."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(vectors.where("vec_id % 50 = 0"), vectors)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_shards, op3_contamination, op4_quality, op5_secrets, op6_tokens, op7_language_model, op8_piece_counts, op9_mixture, op10_top_k, op11_turn_repair, op12_hard_negatives, op13_embedding_dedup)}

ORACLE_SQL: dict[str, str] = {
    "op3_contamination": """
with words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
items as (
  select cast(item_id as varchar) as item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
windows as (
  select distinct item_id, len, phrase from (
    select item_id, least(10, len(w)) as len, array_to_string(w[i:i + 9], ' ') as phrase
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0))),
grams as (
  select doc_id, n as len, i as pos, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct len as n from windows))),
found as (select g.doc_id, g.pos, g.len, x.item_id from grams g join windows x on g.len = x.len and g.phrase = x.phrase),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + len)) as p from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from found) group by doc_id),
tok as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from words),
freq as (select term, count(*) as n from tok group by term),
win as (select distinct phrase, string_split(phrase, ' ') as ws from windows),
ranked as (select p.phrase, p.term, p.shift, row_number() over (partition by p.phrase order by coalesce(f.n, 0), p.shift) as bit
  from (select phrase, unnest(ws) as term, unnest(range(len(ws))) as shift from win) p left join freq f on f.term = p.term),
anchor as (select *, max(bit) over (partition by phrase) as need from ranked where bit <= 3),
starts as (select t.doc_id, a.phrase, t.pos - a.shift as s, a.bit, a.need from tok t join anchor a on a.term = t.term),
lagged as (select *, lag(s) over o as was, lag(bit) over o as was_bit from starts window o as (partition by doc_id, phrase order by s, bit)),
cand as (select distinct doc_id, phrase, case when need = 1 then s else was end as s from lagged where need = 1 or (bit <> was_bit and s - was <= 4)),
near as (select c.doc_id, count(distinct c.phrase) as n_near from cand c join words d on d.doc_id = c.doc_id join win x on x.phrase = c.phrase
  where len(list_intersect(list_distinct(x.ws), d.w[greatest(1, c.s - 3):greatest(1, c.s - 3) + len(x.ws) + 7])) >= len(list_distinct(x.ws)) - len(list_distinct(x.ws)) // 5 group by c.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n_hit, 0) as bigint) as n_hit, cast(coalesce(named.n_items, 0) as bigint) as n_items,
  sha256(coalesce(named.ids, '')) as items_sha256, coalesce(hit.n_hit, 0) > 0 as contaminated, cast(coalesce(near.n_near, 0) as bigint) as n_near
from words d left join hit on d.doc_id = hit.doc_id left join named on d.doc_id = named.doc_id left join near on near.doc_id = d.doc_id
""",
    "op10_top_k": """
with q as (select vec_id, [cast(floor(cast(x as double) * 256) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
pairs as (select a.vec_id as query_id, b.vec_id, list_sum([x[1] * x[2] for x in list_zip(a.v, b.v)]) as score
  from q a join q b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from ranked where rank <= 5
""",
    "op12_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [cast(floor(cast(x as double) * 256) as bigint) for x in embedding] as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
scores as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum([x[1] * x[2] for x in list_zip(a.q, b.q)]) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 50 = 0),
pos as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from pos p join scores s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
window w as (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) qualify row_number() over w <= 3
""",
    "op13_embedding_dedup": """
with recursive v as (select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings where embedding is not null and label is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
n as (select vec_id, label, e, sqrt(list_sum([x * x for x in e])) as norm from v where len([x for x in e if x <> 0]) > 0),
links as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and a.label = b.label and len(a.e) = len(b.e)
  where list_sum([x[1] * x[2] for x in list_zip(a.e, b.e)]) / (a.norm * b.norm) >= 0.98),
reach as (select a as x, b as y from links union select reach.x, links.b from reach join links on reach.y = links.a)
select e.vec_id, coalesce((select count(*) from links where a = e.vec_id), 0) as n_links, least(e.vec_id, coalesce((select min(y) from reach where x = e.vec_id), e.vec_id)) as component_id,
  least(e.vec_id, coalesce((select min(y) from reach where x = e.vec_id), e.vec_id)) = e.vec_id as kept from embeddings e
""",
}
