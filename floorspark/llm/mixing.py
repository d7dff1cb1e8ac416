"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of domains, languages and sources. Each node
splits what it gets among its children by weight; a child that cannot use its
share (its sources repeat ``max_epochs`` times at most) gets what it can use, and
the shortage goes to its siblings by their weights. A node gets no more than its
subtree can use, so a shortage passes to the ancestors' other children only when
siblings are full. Each source then gives whole epochs and, of one more epoch in
seeded order, the longest prefix that fits.

Only Spark expressions are used. Budgets are computed on tables of nodes. The
prefix of a source is found from sums over slices of the seeded order, so that a
source of any size is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floorspark.session import stored

LEVELS = ("domain", "lang", "source")
#: Hex digits that name a slice of a source's seeded order: 4,096 slices.
SLICE_DIGITS = 3

_EXACT = "decimal(38,0)"


def token_count(text: Column) -> Column:
    """Words between blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, count: int = 3) -> Column:
    """The default domains: the source's final number, dealt to ``count``."""
    digits = F.regexp_extract(source, r"([0-9]{1,9})$", 1)
    return F.when(digits != "", F.concat(F.lit("domain"), (digits.cast("int") % count).cast("string"))).otherwise(F.lit("other"))


def _weight(path: Column, weights: Mapping[str, int]) -> Column:
    """The weight of a node by its path, such as ``domain0/en``; 1 if not given."""
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(path == name, F.lit(int(weight))).otherwise(out)
    return out.cast(_EXACT)


def _share(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Splits ``amount`` of each parent among its nodes by ``weight``, none over
    its ``capacity``; the result is in ``granted``, rounded down."""
    # In the order of capacity per weight, the full ones come first.
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.greatest("weight", F.lit(1).cast(_EXACT)), "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parents)
    zero = F.lit(0).cast(_EXACT)
    nodes = nodes.withColumn("rest", F.col("amount") - F.coalesce(F.sum("capacity").over(before), zero))
    nodes = nodes.withColumn("pull", F.sum("weight").over(after)).withColumn("turn", F.row_number().over(order))
    full = F.col("capacity") * F.col("pull") <= F.col("rest") * F.col("weight")
    nodes = nodes.withColumn("from", F.min(F.when(~full, F.col("turn"))).over(whole))
    at = F.col("turn") == F.col("from")
    nodes = nodes.withColumn("level_rest", F.max(F.when(at, F.col("rest"))).over(whole))
    nodes = nodes.withColumn("level_pull", F.max(F.when(at, F.col("pull"))).over(whole))
    part = F.expr("(level_rest * weight) div level_pull").cast(_EXACT)
    granted = F.when(F.col("from").isNull() | (F.col("turn") < F.col("from")), F.col("capacity")).otherwise(part)
    return nodes.withColumn("granted", granted)


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, int], budget: Column, max_epochs: int) -> DataFrame:
    """Adds ``granted`` tokens to leaves (domain, lang, source, tokens)."""
    path = F.concat_ws("/", *LEVELS)
    leaves = leaves.withColumn("own_weight", _weight(path, weights))
    usable = F.col("tokens").cast(_EXACT) * max_epochs
    leaves = leaves.withColumn("capacity", F.when(F.col("own_weight") > 0, usable).otherwise(F.lit(0).cast(_EXACT)))

    def capacity(depth: int) -> DataFrame:
        names = list(LEVELS[:depth])
        if depth == len(LEVELS):
            return leaves.select(*names, "tokens", "capacity", F.col("own_weight").alias("weight"))
        nodes = capacity(depth + 1).groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").cast(_EXACT).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(F.concat_ws("/", *names), weights))
        return nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast(_EXACT)))

    granted = leaves.groupBy().agg(F.sum("tokens").alias("tokens"), F.sum("capacity").cast(_EXACT).alias("capacity"))
    granted = granted.select(F.least(budget.cast(_EXACT), capacity(1).groupBy().agg(F.sum("capacity").cast(_EXACT).alias("c")).select("c").scalar()).alias("amount"))
    for depth in range(1, len(LEVELS) + 1):
        names = list(LEVELS[:depth])
        nodes = capacity(depth).withColumn("name", F.col(names[-1]))
        nodes = nodes.join(granted, names[:-1]) if depth > 1 else nodes.withColumn("amount", granted.scalar())
        nodes = _share(nodes, names[:-1])
        kept = [*names, "tokens"] if depth == len(LEVELS) else names
        granted = nodes.select(*kept, F.col("granted").alias("amount"))
    return granted.withColumnRenamed("amount", "granted")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _node(docs: DataFrame, domain: Column | None) -> dict[str, Column]:
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source"))
    return {"domain": domain if domain is not None else domain_of(source), "lang": lang, "source": source}


def _cutoffs(docs: DataFrame, weights: Mapping[str, int], share: tuple[int, int], max_epochs: int, seed: int, domain: Column | None) -> tuple[DataFrame, DataFrame]:
    """(documents with tokens and node; for each node its whole epochs and the
    last key of the next epoch that is still in)."""
    sized = docs.select("doc_id", token_count(F.col("text")).alias("tokens"), *[c.alias(n) for n, c in _node(docs, domain).items()])
    sized = stored(sized, "sized")
    leaves = sized.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    leaves = stored(leaves, "leaves")
    total = leaves.groupBy().agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast(_EXACT).alias("t")).scalar()
    budget = F.floor(total * share[0] / share[1])
    granted = leaf_budgets(leaves, weights, budget, max_epochs)
    per_token = F.greatest("tokens", F.lit(1))
    granted = granted.withColumn("granted", F.col("granted").cast("long"))
    granted = granted.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("granted div greatest(tokens, 1)")).otherwise(0))
    granted = granted.withColumn("room", F.col("granted") - F.col("epochs") * per_token)
    granted = stored(granted.select(*LEVELS, "epochs", "room"), "granted")

    keyed = sized.join(granted, list(LEVELS)).withColumn("key", _key(seed, F.col("epochs"), F.col("doc_id")))
    keyed = keyed.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    sums = keyed.groupBy(*LEVELS, "room", "slice").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice")
    sums = sums.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
    split = sums.where((F.col("before") + F.col("tokens") > F.col("room")) & (F.col("before") <= F.col("room")))
    # The first slice that does not fit whole; empty ones may share its start.
    split = split.groupBy(*LEVELS).agg(F.min("slice").alias("slice"), F.min("before").alias("before"))
    split = stored(split, "split")
    inside = keyed.join(split, [*LEVELS, "slice"])
    running = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))
    inside = inside.withColumn("upto", F.col("before") + running).where(F.col("upto") <= F.col("room"))
    last = inside.groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cut = granted.join(split.select(*LEVELS, "slice"), list(LEVELS), "left").join(last, list(LEVELS), "left")
    # Keys are hex, so all of them come before "g".
    cut = cut.select(*LEVELS, "epochs", F.coalesce("last", "slice", F.lit("g")).alias("cutoff"))
    return sized, stored(cut, "cutoffs")


def _epochs(seed: int, doc_id: Column, max_epochs: int) -> Column:
    again = _key(seed, F.col("__mix_epochs"), doc_id) <= F.col("__mix_cutoff")
    return F.least(F.col("__mix_epochs") + again.cast("int"), F.lit(max_epochs)).cast("long")


def mix_plan(docs: DataFrame, weights: Mapping[str, int], share: tuple[int, int] = (3, 4), max_epochs: int = 2, seed: int = 7, domain: Column | None = None) -> DataFrame:
    """How often each document is used: doc_id, domain, lang, source, n_tokens,
    epochs (at least 1; documents not used have no row).

    ``docs`` has doc_id, text, lang and source; other columns are ignored.
    ``weights`` maps paths (``domain0``, ``domain0/en``, ``domain0/en/src3``) to
    whole numbers; a path not named weighs 1, one of weight 0 is left out. The
    budget is ``share`` of all tokens.

    A null lang or source is the node ''. A null or empty text has no tokens and
    goes with the epoch's prefix. Repeated rows come in or stay out together;
    rows without doc_id have one place in their source's order. Rounding leaves
    at most one token of a node's budget for each child unused.
    """
    sized, cut = _cutoffs(docs, weights, share, max_epochs, seed, domain)
    cut = cut.withColumnsRenamed({"epochs": "__mix_epochs", "cutoff": "__mix_cutoff"})
    used = sized.join(cut, list(LEVELS)).withColumn("epochs", _epochs(seed, F.col("doc_id"), max_epochs)).where("epochs > 0")
    return used.select("doc_id", *LEVELS, F.col("tokens").alias("n_tokens"), "epochs")


def mixed(docs: DataFrame, weights: Mapping[str, int], share: tuple[int, int] = (3, 4), max_epochs: int = 2, seed: int = 7, domain: Column | None = None) -> DataFrame:
    """The documents that :func:`mix_plan` uses, with all their columns and
    ``epochs``, which takes the place of a column of that name. Texts are not shuffled for it where the nodes are few."""
    _, cut = _cutoffs(docs, weights, share, max_epochs, seed, domain)
    cut = cut.select(*[F.col(c).alias(f"__mix_{c}") for c in cut.columns])
    out = docs.withColumns({f"__mix_{n}": c for n, c in _node(docs, domain).items()})
    out = out.join(cut, [f"__mix_{c}" for c in LEVELS]).withColumn("epochs", _epochs(seed, F.col("doc_id"), max_epochs))
    return out.where("epochs > 0").select(*[c for c in docs.columns if c != "epochs"], "epochs")
