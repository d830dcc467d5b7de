"""What is kept and what goes: suppressions, events, caches, teams, runs and the grid of an experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_path


def _file(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) == "", "").otherwise(normalize_path(F.col(c)))


def unsuppress(suppressions: DataFrame, removals: DataFrame, first_only: bool = False) -> DataFrame:
    """suppressions (rule_id, file, s_ord, ...) without those of a removal's rule and file (none: for all files); with
    first_only, without the first of each such rule and file."""
    gone = removals.select(F.col("rule_id").alias("g_rule"), _file("file").alias("g_file")).distinct()
    on = (F.col("rule_id") == F.col("g_rule")) & (F.col("n_file") == F.col("g_file"))
    named = suppressions.withColumn("n_file", _file("file"))
    if first_only:
        place = F.row_number().over(Window.partitionBy("rule_id", "n_file").orderBy("s_ord"))
        hit = named.withColumn("place", place).join(gone, on, "left")
        return hit.where("place > 1 or g_rule is null").select(*suppressions.columns)
    return named.join(gone, on, "left_anti").select(*suppressions.columns)


def checked_unsuppress(suppressions: DataFrame, removals: DataFrame, first_only: bool = False) -> DataFrame:
    """unsuppress(), but a removal that matches nothing is an error that names it."""
    gone = removals.select(F.col("rule_id").alias("g_rule"), _file("file").alias("g_file")).distinct()
    named = suppressions.select(F.col("rule_id").alias("rule"), _file("file").alias("file"))
    lost = gone.join(named, (F.col("rule") == F.col("g_rule")) & (F.col("file") == F.col("g_file")), "left_anti").orderBy("g_rule", "g_file").first()
    if lost:
        raise ValueError(f"no suppression of rule {lost.g_rule}" + (f" for {lost.g_file}" if lost.g_file else ""))
    return unsuppress(suppressions, removals, first_only)


def retained(events: DataFrame, order: list[str], most: int = 10_000) -> DataFrame:
    """What a log keeps that drops its oldest tenth whenever it holds more than `most` events: the newest ones."""
    n, drop = events.count(), most // 10
    keep = n if n <= most or not drop else n - ((n - most - 1) // drop + 1) * drop
    # `most` rows at most
    return events.orderBy(*[F.desc(c) for c in order]).limit(keep)


def fresh_entries(wanted: DataFrame, cache: DataFrame, key: str, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """wanted with the value of the newest cache entry (key, created, value) and whether it is a hit, a miss or expired;
    an entry lives ttl_seconds (0: for ever)."""
    newest = cache.groupBy(F.col(key).alias("c_key")).agg(F.max(F.struct("created", "value")).alias("entry"))
    alive = F.lit(True) if not ttl_seconds else F.unix_timestamp(F.col("entry.created").cast("timestamp")) + ttl_seconds >= F.unix_timestamp(now)
    state = F.when(F.col("entry").isNull(), "miss").when(alive, "hit").otherwise("expired")
    out = wanted.join(newest, F.col(key) == F.col("c_key"), "left").withColumn("state", state)
    return out.withColumn("value", F.when(F.col("state") == "hit", F.col("entry.value"))).drop("c_key", "entry")


def latest_generation(requests: DataFrame, key: str, generation: list[str]) -> DataFrame:
    """The newest request of each key; it supersedes those before it."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in generation])
    return requests.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def without_team(table: DataFrame, team: str) -> DataFrame:
    """A table of events or profiles without one team's rows; rows without a team stay."""
    return table.where(~F.col("team").eqNullSafe(team))


def profile_lookup(profiles: DataFrame, team: str, rules: DataFrame) -> DataFrame:
    """A team's profiles of the wanted rules (rule_id); none wanted, none found."""
    return profiles.where(F.col("team") == team).join(rules.select("rule_id").distinct(), "rule_id", "left_semi")


def with_guid(runs: DataFrame, key: str = "run_id") -> DataFrame:
    """runs (key, guid, started, ...) with a guid where it is missing, of version-4 form but made of the key, so that a
    task that is run again gives the same; and the guid of the run before as baseline_guid."""
    h = F.md5(F.col(key).cast("string"))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return runs.withColumn("guid", F.coalesce(F.nullif(F.col("guid"), F.lit("")), made))


def link_baselines(runs: DataFrame, target: str, order: str) -> DataFrame:
    """runs (guid, ...) with baseline_guid: the run of the same target before it."""
    return runs.withColumn("baseline_guid", F.lag("guid").over(Window.partitionBy(target).orderBy(order, "guid")))


def experiment_grid(targets: DataFrame, variants: list[str], runs: int) -> DataFrame:
    """Each target by each variant and run from 1."""
    grid = targets.withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    return grid.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def custom_gate(findings: DataFrame, policy: list[tuple[str, str]], key: str = "run_id", otherwise: str = "review") -> DataFrame:
    """A decision a run by a policy: (decision, condition) in order, the first condition that holds decides. Conditions
    are SQL over aggregates of a run's findings, such as count_if(level = 'error') > 3."""
    held = findings.groupBy(key).agg(*[F.expr(c).alias(f"c{i}") for i, (_, c) in enumerate(policy)])
    decision = F.lit(otherwise)
    for i, (name, _) in reversed(list(enumerate(policy))):
        decision = F.when(F.col(f"c{i}"), F.lit(name)).otherwise(decision)
    return held.select(key, decision.alias("decision"))
