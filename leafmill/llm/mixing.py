"""Mixing sources to target weights by hierarchical budgeting, in built-in expressions only.

Leaves of a tree (domain, language, source, say) hold tokens; a leaf can give its tokens up
to ``max_epochs`` times. A budget goes down the tree: a node's share is divided among its
children by weight, a child that cannot fill its share gives the rest to its siblings
by their weights, and only what the siblings cannot take either comes back to the parent's
siblings. As a node's capacity is the sum of its leaves' capacities, this is one
water-filling per level: with children in the order of capacity / weight, the level is
the largest (budget - capacities before) / (weights from here on), and a child gets
min(capacity, weight * level).

A leaf with budget b and s tokens takes all its documents b div s times, then a prefix of
b mod s tokens of the next epoch. In epoch e documents are ordered by
md5(seed-e-doc_id); the prefix is found from sums over 4096 ranges of that key, then
inside one range, so that no task ever orders a whole leaf.

Null levels form a node of their own, named ``(none)``. Null and empty texts have no
tokens; such a document is in a prefix if it stands before its end. Rows that share
a ``doc_id`` (or lack one) share a key and are taken together. A node without weight gets
the default weight; weight 0 gives nothing. Further columns are carried through whatever
their names; columns of ``docs`` named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import WORD, checkpointed, written

MISSING = "(none)"
_RANGE_DIGITS = 3  # hex digits of the key that name a range


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit(MISSING))
    return F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), name))


def _weight(level: str, weights: Mapping[str, int], default: int) -> Column:
    if not weights:
        return F.lit(float(default))
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(float(default)))


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    budget: float,
    weights: Mapping[str, Mapping[str, int]],
    default_weight: int = 1,
    max_epochs: int = 1,
) -> DataFrame:
    """``leaves`` (levels, tokens) with the budget of each leaf in whole tokens."""
    nodes = leaves.withColumn("_budget", F.lit(float(budget)))
    for depth, level in enumerate(levels):
        parent = list(levels[:depth])
        below = list(levels[: depth + 1])
        children = nodes.groupBy(*below).agg(
            (F.sum("tokens") * max_epochs).cast("double").alias("cap"),
            F.first("_budget").alias("_budget"),
        )
        children = children.withColumn(
            "w", _weight(level, weights.get(level, {}), default_weight)
        )
        order = W.partitionBy(*parent, F.lit(0)).orderBy(
            F.when(F.col("w") > 0, F.col("cap") / F.col("w")).asc_nulls_last(), level
        )
        before = F.coalesce(
            F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
        )
        following = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
        children = children.select(
            *below,
            "cap",
            "w",
            F.when(following > 0, (F.col("_budget") - before) / following).alias("line"),
        )
        line = F.max("line").over(W.partitionBy(*parent, F.lit(0)))
        share = F.coalesce(F.least("cap", F.col("w") * line), F.lit(0.0))
        children = children.select(*below, F.greatest(share, F.lit(0.0)).alias("_budget"))
        nodes = nodes.drop("_budget").join(children, below)
    return nodes.withColumn("leaf_budget", F.floor("_budget").cast("long")).drop("_budget")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    budget: float | None = None,
    budget_share: float | None = None,
    default_weight: int = 1,
    max_epochs: int = 1,
    seed: int = 17,
) -> DataFrame:
    """Rows of ``docs`` that make up the mix, a row per epoch in which a document is taken.

    Adds the levels, n_tokens, epoch, leaf_budget and taken_tokens (less than n_tokens only
    for the last document of a leaf's prefix). The budget is given in tokens or as a share
    of all tokens.
    """
    # The user's columns go through as one and levels by number, so that no name can clash.
    made = [*levels, "n_tokens", "epoch", "leaf_budget", "taken_tokens"]
    replaced = {c.lower() for c in made}
    carried = [c for c in docs.columns if c.lower() not in replaced]
    names = [f"level{i}" for i in range(len(levels))]
    weights = {n: weights.get(level, {}) for n, level in zip(names, levels, strict=True)}
    ready = docs.select(
        F.struct(*carried).alias("row"),
        F.col("doc_id"),
        *[
            F.coalesce(v.cast("string"), F.lit(MISSING)).alias(n)
            for n, v in zip(names, levels.values(), strict=True)
        ],
        count_tokens(F.col("text")).alias("n_tokens"),
    )
    narrow = checkpointed(
        ready.groupBy("doc_id", *names).agg(
            F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")
        )
    )
    leaves = narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    if budget is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        budget = float(int(total * (1.0 if budget_share is None else budget_share)))
    plan = leaf_budgets(leaves, names, budget, weights, default_weight, max_epochs)
    empty = F.col("tokens") == 0
    # written with a known size, so that a short list of leaves is not a reason to move texts
    plan = written(
        plan.withColumn("full", F.when(empty, 0).otherwise(F.expr("leaf_budget div tokens")))
        .withColumn("rest", F.when(empty, 0).otherwise(F.col("leaf_budget") % F.col("tokens")))
        .withColumn("full", F.col("full").cast("long")),
        "budgets",
    )

    # Where the prefix of the partial epoch ends: first its range, then the key.
    partial = narrow.join(plan.filter("rest > 0").drop("tokens"), names).withColumn(
        "key", order_key(seed, F.col("full"), F.col("doc_id"))
    )
    partial = partial.withColumn("range", F.substring("key", 1, _RANGE_DIGITS))
    by_range = W.partitionBy(*names).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    at_end = (
        partial.groupBy(*names, "range", "rest")
        .agg(F.sum("tokens").alias("inside"))
        .withColumn("before", F.coalesce(F.sum("inside").over(by_range), F.lit(0)))
        .filter("before < rest and before + inside >= rest")
        .select(*names, "range", "before")
    )
    by_key = W.partitionBy(*names).orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        partial.join(at_end, [*names, "range"])
        .groupBy(*names, "key", "rest", "before")
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(by_key), F.lit(0)))
        .filter("start < rest")
        .groupBy(*names)
        .agg(
            F.max("key").alias("last_key"),
            F.max_by(F.col("rest") - F.col("start"), "key").alias("last_tokens"),
        )
    )
    plan = written(plan.drop("tokens").join(ends, names, "left"), "prefixes")
    whole = F.col("epoch") < F.col("full")
    key = order_key(seed, F.col("epoch"), F.col("doc_id"))
    return (
        ready.join(plan, names)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
        .filter(whole | (key <= F.col("last_key")))
        .withColumn(
            "taken_tokens",
            F.when(whole | (key < F.col("last_key")), F.col("n_tokens")).otherwise(
                F.least("n_tokens", "last_tokens")
            ),
        )
        .select(
            "row.*",
            *[F.col(n).alias(level) for n, level in zip(names, levels, strict=True)],
            *made[len(names) :],
        )
    )
