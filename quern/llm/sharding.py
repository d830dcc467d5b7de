"""Two-pass external shuffle of records into shards, with DataFrame operations only.

Pass one scatters records by a seeded hash into buckets that fit in memory; pass two shuffles each bucket
(Spark's shuffle() of an array is a seeded Fisher-Yates shuffle) and lays the buckets end to end. That order is
cut into shards whose sizes differ by one row at most; a shard is a run of it, so a bucket lies in one shard or on
the border of a few and is written from where it was shuffled."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def row_bytes(column: str = "text"):
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)).cast("long") + 1


def external_shuffle(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of docs, and shard (0 .. shards-1) and slot (gapless from 0 in each shard).

    docs: (doc_id, text, ...). Rows are scattered by doc_id and text. Null and empty texts count one byte; repeated rows
    each keep their place; an empty table gives no rows. Columns may be of any kind that JSON can hold, maps included.
    Input columns that are called shard or slot are replaced. The same seed, data, number of buckets and number of
    shuffle partitions give the same order (Spark's shuffle() adds the partition to the seed). bucket_bytes is the
    mean size of a bucket, which a task holds one after the other. Rows that agree in doc_id and text have one hash; where
    more of them agree than a bucket holds on average (or a two-thousandth of all rows, if that is more), they are dealt over
    all buckets by their place in the input."""
    plain = [c for c in docs.columns if c not in ("shard", "slot")]
    spread = F.xxhash64(F.lit(seed), "doc_id", "text")
    total = docs.agg(F.sum(row_bytes()).alias("bytes"), F.count("*").alias("rows")).first()
    rows, buckets = total.rows, max(1, math.ceil((total.bytes or 0) / bucket_bytes))
    hashed = docs.select(F.struct(*plain).alias("row"), spread.alias("h"))
    # fewer than 2000
    hot = [r.h for r in hashed.groupBy("h").count().where(F.col("count") > max(1, rows // buckets, rows // 2000)).select("h").collect()]
    scattered = hashed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    if hot:
        # their buckets are written down, as another run of a task might number rows otherwise
        names = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in hot], "h long"))
        dealt = hashed.join(names, "h", "left_semi").select("row", "h", F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(buckets)).alias("bucket"))
        scattered = scattered.join(names, "h", "left_anti").select("row", "h", "bucket").unionByName(written(dealt, "repeated-rows"))
    counts = scattered.groupBy("bucket").count().withColumn("group", F.floor(F.col("bucket") / 1024))
    scattered = scattered.withColumn("tie", F.xxhash64(F.to_json("row")))
    # a row a bucket; sums go by groups of buckets first
    groups = counts.groupBy("group").agg(F.sum("count").alias("own")).select("group", (F.sum("own").over(Window.orderBy("group")) - F.col("own")).alias("earlier"))
    inside = F.sum("count").over(Window.partitionBy("group").orderBy("bucket")) - F.col("count")
    before = counts.withColumn("inside", inside).join(groups, "group").select("bucket", (F.col("earlier") + F.col("inside")).alias("before"))
    less = lambda a, b: F.when(a.h < b.h, -1).when(a.h > b.h, 1).when(a.tie < b.tie, -1).when(a.tie > b.tie, 1).otherwise(0)
    held = scattered.repartition(max(1, buckets // 2), "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "tie", "row")), less).alias("rows"))
    shuffled = held.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    placed = shuffled.join(before, "bucket").select("before", F.posexplode("rows").alias("pos", "item"))
    at = (F.col("before") + F.col("pos")).cast("decimal(38,0)")
    # shard s is the run from s * rows / shards, rounded up
    shard = F.floor(at * shards / F.lit(max(1, rows)))
    whole = placed.select("item.row.*", shard.cast("int").alias("shard"), at.cast("long").alias("slot"))
    return whole.withColumn("slot", F.col("slot") - F.ceil(F.col("shard").cast("decimal(38,0)") * rows / F.lit(shards)).cast("long"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard; rows keep their slot as a column. Each task writes the buckets it
    has shuffled, in order, so nothing is moved again."""
    shuffled.write.partitionBy("shard").parquet(path)
