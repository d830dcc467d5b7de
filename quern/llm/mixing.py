"""Mixing sources to target weights with hierarchical budgets.

A token budget goes down a tree (domain, language, source) by the nodes' weights. A node never gets more
than its leaves hold over the allowed epochs; what it cannot take goes to its siblings first, and an
ancestor's siblings get it only when all of them are full. Each leaf then takes whole epochs of its
documents in a seeded order, and of the last epoch the prefix that fits into its budget."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a leaf that a task puts in order, unless one key of the order is repeated
EDGE_ROWS = 1 << 16


def word_count(text: Column) -> Column:
    """Words of a text, split at ASCII white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    known = F.lit(1.0)
    for name, w in weights.items():
        known = F.when(F.col(level) == name, F.lit(float(w))).otherwise(known)
    return known


def _shares(nodes: DataFrame, parent: list[str], level: str, budget: str) -> DataFrame:
    """Fill siblings in proportion to weight up to their capacity: adds `share` to nodes.

    By capacity over weight in rising order, the k smallest are full, and the rest share what remains by
    weight. The level is that share at the first k where it isn't above the next ratio; at each later k it
    is lower, so the level is the largest that qualifies. Nodes of weight 0 get what no sibling could take."""
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    w = Window.partitionBy(*parent).orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    at = nodes.withColumn("ratio", ratio).withColumn("full", F.coalesce(F.sum("capacity").over(w), F.lit(0.0))).withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(w), F.lit(0.0)))
    fill = (F.col(budget) - F.col("full")) / F.col("rest")
    # 1e-9: differences of sums of weights are not exact
    level_of = F.max(F.when((F.col("weight") > 0) & (F.col("rest") > 1e-9) & (fill <= F.col("ratio")), fill)).over(whole)
    weighed = F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).over(whole)
    idle = F.sum(F.when(F.col("weight") > 0, 0.0).otherwise(F.col("capacity"))).over(whole)
    spare = F.greatest(F.lit(0.0), F.col(budget) - weighed) / F.when(idle > 0, idle)
    share = F.when(F.col("weight") > 0, F.least(F.col("capacity"), F.coalesce(F.col("weight") * level_of, F.col("capacity")))).otherwise(F.coalesce(F.col("capacity") * F.least(F.lit(1.0), spare), F.lit(0.0)))
    return at.withColumn("share", share).drop("ratio", "full", "rest")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], fraction: float, epochs: int) -> DataFrame:
    """leaves: the levels' columns and tokens. Adds budget: whole tokens of the leaf to take, over all epochs."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    nodes = leaves.withColumn("budget0", F.lit(fraction) * F.lit(total))
    for i, level in enumerate(levels):
        kept = levels[: i + 1]
        grouped = nodes.groupBy(*kept).agg((F.sum("tokens") * epochs).cast("double").alias("capacity"), F.first(f"budget{i}").alias(f"budget{i}")).withColumn("weight", _weight(level, weights.get(level, {})))
        parent = levels[:i] or [F.lit(1)]
        given = _shares(grouped, parent, level, f"budget{i}").select(*kept, F.col("share").alias(f"budget{i + 1}"))
        given = given.withColumnsRenamed({c: f"g_{c}" for c in kept})
        on = [nodes[c].eqNullSafe(given[f"g_{c}"]) for c in kept]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        nodes = nodes.join(given, cond).drop(*[f"g_{c}" for c in kept])
    return nodes.select(*levels, "tokens", F.floor(F.col(f"budget{len(levels)}") + 1e-6).cast("long").alias("budget"))


def _same(left: DataFrame, right: DataFrame, names: list[str], prefix: str) -> Column:
    """Equality of the levels, null being a value; right's are called prefix + name."""
    cond = F.lit(True)
    for c in names:
        cond = cond & left[c].eqNullSafe(right[f"{prefix}{c}"])
    return cond


def _place(seed: str, epoch: Column) -> Column:
    """A row's key in the order of an epoch, as 48 hexadecimal digits: md5(seed:epoch:id), then the text's hash, the lowest
    first."""
    tie = F.lpad(F.hex(F.col("tie").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), "id")), F.lower(tie))


def ends(slim: DataFrame, budgets: DataFrame, names: list[str], epochs: int, seed: str, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Where each leaf's budget ends: the levels under e_<name>, full (epochs that are taken whole), last (the key in the
    next epoch at which the budget is used up; null where there is none) and copies (rows with that key to take).

    Sums over ranges of keys tell in which range the budget ends; that range is cut again, two digits a pass, until
    it has edge_rows or fewer, and only those are put in order, keys and tokens alone."""
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(epochs))
    leaves = budgets.withColumn("full", F.least(full, F.lit(epochs)).cast("int"))
    leaves = written(leaves.withColumn("room", F.col("budget") - F.col("full") * F.col("tokens")).withColumnsRenamed({c: f"e_{c}" for c in names}), "leaves")
    begun = leaves.where(F.col("full") < epochs)
    left = slim.join(begun.select(*[f"e_{c}" for c in names], "full", "room"), _same(slim, begun, names, "e_"))
    left = left.select(*names, _place(seed, F.col("full")).alias("place"), F.col("mix_tokens").alias("n"), "room")
    depth = 0
    while True:
        depth += 2
        cell = F.substring("place", 1, depth)
        sums = left.groupBy(*names, cell.alias("cell")).agg(F.sum("n").alias("n"), F.first("room").alias("room"))
        before = F.sum("n").over(Window.partitionBy(*names).orderBy("cell")) - F.col("n")
        edge = sums.withColumn("before", before).where("before <= room and before + n > room")
        edge = written(edge.select(*[F.col(c).alias(f"e_{c}") for c in names], F.col("cell").alias("e_cell"), (F.col("room") - F.col("before")).alias("e_room")), "edge")
        inside = left.join(edge, _same(left, edge, names, "e_") & (cell == edge.e_cell))
        left = written(inside.select(*names, "place", "n", F.col("e_room").alias("room")), "edge-rows")
        # a range with a single key isn't cut: its rows are counted before the keys are put in order
        sizes = left.groupBy(*names).agg(F.count("*").alias("rows"), F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo < hi")
        if (sizes.agg(F.max("rows")).first()[0] or 0) <= edge_rows:
            break
    keys = left.groupBy(*names, "place").agg(F.max("n").alias("one"), F.count("*").alias("rows"), F.first("room").alias("room"))
    before = F.sum(F.col("one") * F.col("rows")).over(Window.partitionBy(*names).orderBy("place")) - F.col("one") * F.col("rows")
    last = keys.withColumn("before", before).where("before <= room and before + one * rows > room")
    last = last.select(*[F.col(c).alias(f"l_{c}") for c in names], F.col("place").alias("last"), F.floor((F.col("room") - F.col("before")) / F.col("one")).alias("copies"))
    on = F.lit(True)
    for c in names:
        on = on & F.col(f"e_{c}").eqNullSafe(F.col(f"l_{c}"))
    return leaves.join(last, on, "left").select(*[f"e_{c}" for c in names], "full", "last", "copies")


def mix(docs: DataFrame, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, float]], fraction: float = 0.5, epochs: int = 1, seed: str = "mix", edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Choose documents so that each leaf's tokens come to its budget.

    docs: (doc_id, text, ...). levels: name -> SQL expression over docs' columns, from root to leaf; a null value
    is a node of its own. weights: level -> {node's name: weight}; others weigh 1. fraction: of all tokens, to
    take. Returns docs' columns, the levels under mix_<name>, mix_tokens, mix_epoch: one row for each epoch
    that takes the document. An epoch orders a leaf's documents by md5(seed:epoch:doc_id), ties by text hash, and
    takes the longest prefix within what is left of the budget. Texts without words weigh nothing and go with their
    place in that order. Repeated rows and rows without a doc_id each count; of rows that agree in id and text, at which
    the budget ends, any as many as fit are taken. Columns of docs with such a name are replaced; an empty table
    gives no rows. No more than edge_rows of a leaf are put in order by a task, and their texts never are."""
    names = [f"mix_{c}" for c in levels]
    plain = [c for c in docs.columns if c not in (*names, "mix_tokens", "mix_epoch")]
    told = docs.select(F.struct(*plain).alias("row"), *[F.expr(c).cast("string").alias(f"mix_{n}") for n, c in levels.items()], word_count(F.col("text").cast("string")).alias("mix_tokens"))
    told = told.withColumns({"id": F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "tie": F.xxhash64("row.text")})
    slim = written(told.select(*names, "mix_tokens", "id", "tie"), "mix_tokens")
    leaves = written(slim.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")), "leaf_tokens")
    budgets = leaf_budgets(leaves, names, {f"mix_{k}": v for k, v in weights.items()}, fraction, epochs)
    end = written(ends(slim, budgets, names, epochs, seed, edge_rows), "ends")
    rows = told.join(end, _same(told, end, names, "e_"))
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.least(F.col("full"), F.lit(epochs - 1)))))
    whole = F.col("mix_epoch") < F.col("full")
    rows = rows.withColumn("place", F.when(~whole, _place(seed, F.col("mix_epoch"))))
    keep = ["row.*", *names, "mix_tokens", "mix_epoch"]
    taken = rows.where(whole | (F.col("place") < F.col("last"))).select(*keep)
    # only rows that agree in id and text share the last key
    one = F.row_number().over(Window.partitionBy(*names).orderBy("place"))
    edge = rows.where(~whole & (F.col("place") == F.col("last")) & (F.col("copies") > 0))
    return taken.unionByName(edge.withColumn("copy", one).where("copy <= copies").select(*keep))
