"""Ingest of event batches as a whole or not at all, and counters that no replay adds up twice.

A request is one JSON file: {"team_id": ..., "events": [{"type", "team_id", "timestamp", "payload"}, ...]}. One bad event turns its
whole request away. Each micro-batch writes its rows under its own number, replacing what an attempt before may have left, and
then its number into the ledger; what the ledger doesn't name doesn't count. A batch that is replayed after a crash
thus gives the same rows once, and profiles are sums over the batches of the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.measures import profile_measures

PAYLOAD = "struct<rule_id:string,severity:string,verdict:string,reason:string,confidence:double>"
REQUEST = f"team_id string, events array<struct<type:string,team_id:string,timestamp:string,payload:{PAYLOAD}>>, _bad string"
#: Types of events, and verdicts of feedback.
TYPES, VERDICTS = ("analysis_completed", "finding_created", "feedback_received", "outcome_observed"), ("useful", "noise", "wrong")


def requests(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of request files; what can't be read is a request too, a bad one."""
    return spark.readStream.schema(REQUEST).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).json(folder).withColumn("request", F.col("_metadata.file_path"))


def judged(rows: DataFrame) -> DataFrame:
    """Requests with why they are turned away; null if they aren't."""
    own = F.coalesce("team_id", F.lit(""))
    wrong = lambda e: F.when(~F.coalesce(e.type, F.lit("")).isin(*TYPES), F.lit("unknown event type")).when(F.coalesce(e.team_id, own) != own, F.lit("event of another team")).when(F.try_to_timestamp(e.timestamp).isNull(), F.lit("bad timestamp")).when((e.type == "feedback_received") & ((F.coalesce(e.payload.rule_id, F.lit("")) == "") | ~F.coalesce(e.payload.verdict, F.lit("")).isin(*VERDICTS)), F.lit("bad feedback"))
    first = F.get(F.filter(F.transform("events", wrong), lambda x: x.isNotNull()), F.lit(0))
    why = F.when(F.col("_bad").isNotNull(), "not readable").when(own == "", "no team").when(F.coalesce(F.size("events"), F.lit(0)) <= 0, "no events").otherwise(first)
    return rows.withColumn("why", why)


def feedback_counts(events: DataFrame) -> DataFrame:
    """What feedback adds to the profiles of teams and rules: (team, rule_id, total, useful, noise, wrong, useful_n, useful_sum, noise_n,
    noise_sum). Rows add up."""
    f = events.where("type = 'feedback_received'").select(F.col("team_id").alias("team"), "payload.rule_id", "payload.verdict", "payload.confidence")
    of = lambda v: F.when(F.col("verdict") == v, F.col("confidence"))
    sums = [x for v in ("useful", "noise") for x in (F.count(of(v)).alias(f"{v}_n"), F.coalesce(F.sum(of(v)), F.lit(0.0)).alias(f"{v}_sum"))]
    return f.groupBy("team", "rule_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS], *sums)


class Store:
    """Folders of accepted events, of requests turned away, of counters, and the ledger, all by number of batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def take(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch; for foreachBatch. It may be run again at any point."""
        seen = judged(rows).persist()
        good = seen.where("why is null").select("request", F.col("team_id").alias("team"), F.explode("events").alias("e")).select("request", "e.type", "team", F.coalesce("e.team_id", "team").alias("team_id"), "e.timestamp", "e.payload")
        self._write(good, "events", batch)
        self._write(seen.where("why is not null").select("request", "team_id", "why", F.to_json("events").alias("events")), "turned_away", batch)
        self._write(feedback_counts(good), "counters", batch)
        self._write(self.spark.range(1).select(F.lit(batch).cast("long").alias("number")), "ledger", batch)
        seen.unpersist()

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, name: str) -> DataFrame:
        """Rows of the batches that the ledger names."""
        table = self.spark.read.parquet(f"{self.folder}/{name}")
        done = self.spark.read.parquet(f"{self.folder}/ledger").select(F.col("number").alias("batch")).distinct()
        return table.join(done, "batch", "left_semi").drop("batch")

    def profiles(self) -> DataFrame:
        """Profiles of teams and rules from all feedback so far, with what is learnt from them."""
        return profile_measures(add_up(self.read("counters")))


def add_up(counters: DataFrame) -> DataFrame:
    """feedback_counts() of any number of batches as one, with mean confidences."""
    sums = [F.sum(c).alias(c) for c in ("total", *VERDICTS, "useful_n", "useful_sum", "noise_n", "noise_sum")]
    mean = lambda v: F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_sum") / F.col(f"{v}_n"))
    return counters.groupBy("team", "rule_id").agg(*sums).withColumns({"useful_conf": mean("useful"), "noise_conf": mean("noise")}).drop("useful_n", "useful_sum", "noise_n", "noise_sum")
