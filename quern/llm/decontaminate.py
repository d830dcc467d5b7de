"""Benchmark decontamination with a positional inverted index, as DataFrame operations only.

Word frequencies of the benchmark's terms are counted over all documents. Each benchmark window is then
anchored on its three rarest terms, and the postings (document, term, position) of all anchor terms are stored.
Shifting a posting by the anchor's offset gives the place where the window would start. Starts that both rarest terms
agree on are compared with the document word by word; starts of two anchors that are a few words apart make
near matches, if most of the window's words stand around there."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many rows and bytes of benchmark terms, anchors or phrases are broadcast; beyond it they are joined by a
#: shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
ANCHORS = 3


def word_array(text: Column) -> Column:
    """Words of a text after lower-casing A-Z only; null has none."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATORS), "")


def _small(table: DataFrame, name: str) -> DataFrame:
    """table written out; with a broadcast hint only if its counted rows and bytes are within the bounds."""
    table = written(table, name)
    rows, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*table.columns)))), F.lit(0))).first()
    return F.broadcast(table) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else table


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(window, words, item_ids): each distinct run of `width` words of an item, or the whole item if shorter."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text").cast("string")).alias("words"))
    items = items.where(F.size("words") > 0).select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))).alias("at"))
    return items.select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("words")).groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(F.xxhash64(F.array_join("words", " ")).alias("window"), "words", "item_ids")


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """The whole positional index, written once for any number of benchmarks: (term, doc_id, text_hash, position), in
    order of terms, so that a reader passes over the files that hold none of its terms. A frequent term's postings are
    cut by document, so no file or task has all of them."""
    _tokens(_keyed(docs)).repartitionByRange("term", "doc_id", "position").sortWithinPartitions("term", "doc_id", "position").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _tokens(keyed: DataFrame) -> DataFrame:
    return keyed.select("doc_id", "text_hash", F.posexplode(word_array(F.col("text"))).alias("position", "term"))


def anchors(windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """(term, window, shift, bit, need): the rarest terms of each window by their count among tokens (term, ...); bit is
    their place from 1, need their number."""
    terms = _small(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = terms.join(tokens.select("term").join(terms, "term").groupBy("term").agg(F.count("*").alias("n")), "term", "left")
    placed = windows.select("window", F.posexplode("words").alias("shift", "term")).join(counts, "term")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "shift"))
    chosen = placed.withColumn("bit", rank).where(F.col("bit") <= ANCHORS)
    return chosen.select("term", "window", "shift", "bit", F.max("bit").over(Window.partitionBy("window")).alias("need"))


def candidates(keyed: DataFrame, windows: DataFrame, slop: int, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, window, start, exact): where both rarest terms of a window agree on its start, and where two of
    its anchors do so within slop words. index: build_index() of the same docs; without it only the postings of
    anchor terms are made and stored."""
    tokens = _tokens(keyed) if index is None else index
    anchor = _small(anchors(windows, tokens), "anchors")
    terms = _small(anchor.select("term").distinct(), "anchor_terms")
    found = tokens.join(terms, "term")
    found = written(found, "postings") if index is None else found
    starts = found.join(anchor, "term").select("doc_id", "text_hash", "window", (F.col("position") - F.col("shift")).alias("start"), "bit", "need")
    w = Window.partitionBy("doc_id", "text_hash", "window").orderBy("start", "bit")
    before = starts.withColumns({"was": F.lag("start").over(w), "was_bit": F.lag("bit").over(w)})
    # of starts within slop that aren't all of one anchor, two neighbours are of different ones
    exact = (F.col("need") == 1) | (F.col("start") == F.col("was")) & (F.col("was_bit") == 1) & (F.col("bit") == 2)
    near = (F.col("bit") != F.col("was_bit")) & (F.col("start") - F.col("was") <= slop)
    hit = before.withColumns({"exact": F.coalesce(exact, F.lit(False)), "near": F.coalesce(near, F.lit(False))}).where("exact or near")
    return hit.select("doc_id", "text_hash", "window", F.when(F.col("exact"), F.col("start")).otherwise(F.col("was")).alias("start"), "exact").distinct()


def _close(words: Column, start: Column, length: Column, phrase: Column, slop: int) -> Column:
    """Whether all but a fifth of a phrase's distinct words stand within slop words of its place."""
    own = F.array_distinct(F.split(phrase, " "))
    around = F.slice(words, F.greatest(F.lit(1), start + 1 - slop), length + 2 * slop)
    return F.size(F.array_intersect(own, around)) >= F.size(own) - F.floor(F.size(own) / 5)


@tidy("contamination")
def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 4, index: DataFrame | None = None) -> DataFrame:
    """Exact phrase matches of benchmark windows in docs, and how many windows have a near match.

    docs: (doc_id, text, ...), benchmark: (item_id, text, ...). Returns a row per row of docs: doc_id,
    text_hash, n_words, n_hit (words inside an exact match), n_items, items_sha256, item_ids (as sorted strings),
    contaminated, n_near (windows with an exact or near match: two of the three rarest terms within slop words of their
    distance, and all but a fifth of the distinct words around there). Null and empty texts have no words; items
    without an id or without words take no part; rows that repeat an item_id add their windows to that item; rows of
    docs that repeat or lack a doc_id are each judged by their own text. Empty tables give no rows or no hits. Other
    columns are ignored."""
    keyed, windows = _keyed(docs), written(benchmark_windows(benchmark, width), "windows")
    found = candidates(keyed, windows, slop, index)
    phrase = _small(windows.select("window", F.size("words").alias("len"), F.array_join("words", " ").alias("phrase"), "item_ids"), "phrases")
    places = found.join(phrase, "window").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), "len", "phrase", "item_ids", "exact", "window")).alias("places"))
    places = places.withColumnsRenamed({"doc_id": "p_id", "text_hash": "p_hash"})
    joined = keyed.join(places, keyed.doc_id.eqNullSafe(places.p_id) & (keyed.text_hash == places.p_hash), "left")
    # inline() computes the words once a row, before the functions below go through the places
    split = joined.select("doc_id", "text_hash", "places", F.inline(F.array(F.struct(word_array(F.col("text")).alias("words")))))
    some = F.col("places").isNotNull()
    same = F.when(some, F.filter("places", lambda p: p.exact & (p.start >= 0) & (F.array_join(F.slice("words", F.greatest(F.lit(1), p.start + 1), p.len), " ") == p.phrase)))
    close = F.when(some, F.array_distinct(F.transform(F.filter("places", lambda p: _close(F.col("words"), p.start, p.len, p.phrase, slop)), lambda p: p.window)))
    held = split.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.explode(F.array(F.struct(same.alias("hits"), F.coalesce(F.size(close), F.lit(0)).cast("long").alias("n_near")))).alias("x"))
    hits = F.array_sort(F.transform("x.hits", lambda p: F.struct(p.start.alias("start"), (p.start + p.len).alias("end"))))
    cover = F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, p: F.struct((s.n + F.greatest(F.lit(0), p.end - F.greatest(p.start, s.end))).alias("n"), F.greatest(s.end, p.end).alias("end")), lambda s: s.n)
    ids = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("x.hits", lambda p: p.item_ids)))), F.array().cast("array<string>"))
    out = held.select("doc_id", "text_hash", "n_words", F.coalesce(cover, F.lit(0)).cast("long").alias("n_hit"), ids.alias("item_ids"), F.when(F.col("x.n_near") > 0, F.col("x.n_near")).otherwise(0).alias("n_near"))
    return out.select("doc_id", "text_hash", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"), "n_near")


@tidy("proximity")
def proximity_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 4, index: DataFrame | None = None) -> DataFrame:
    """Where near matches, as contamination() counts them, are: (doc_id, item_id, window, start), a row each; starts are
    those of the earlier anchor, so an exact match is there too."""
    keyed, windows = _keyed(docs), written(benchmark_windows(benchmark, width), "windows")
    found = candidates(keyed, windows, slop, index).withColumnsRenamed({"doc_id": "p_id", "text_hash": "p_hash"})
    joined = found.join(windows.select("window", F.size("words").alias("len"), F.array_join("words", " ").alias("phrase"), "item_ids"), "window")
    # texts that occur more than once in docs are the same text
    texts = keyed.dropDuplicates(["doc_id", "text_hash"])
    on = texts.doc_id.eqNullSafe(joined.p_id) & (texts.text_hash == joined.p_hash)
    near = joined.join(texts, on).where(_close(word_array(F.col("text")), F.col("start"), F.col("len"), F.col("phrase"), slop))
    return near.select("doc_id", F.explode("item_ids").alias("item_id"), "window", "start").distinct()
