"""Mixing sources to target weights: budgets flow down a domain-language-source tree; DataFrame functions only.

1. Tokens are counted natively (words ``[^\\x20\\x09-\\x0D]+``) and summed by leaf with a partial aggregate. A node's
   capacity is the tokens below it times ``max_epochs``.
2. From the root down, each node divides its budget among its children by weight. A child gets no more than its capacity;
   what it can't use goes to its siblings, by weight, as far as they have room. A node's capacity is all that its leaves
   can give, so a shortage reaches another branch only when the siblings are exhausted. Sorted by capacity for each unit of
   weight, the children that are filled up are a prefix, so one running sum decides; there is no iteration. All sums are
   integers; what rounding down leaves over goes, a token each, to the first of the other children by name.
3. A leaf's budget is whole epochs and a rest. Each epoch has its own seeded order of the leaf's documents; the whole
   epochs take every document, the last one takes documents from the start of its order while their running sum of tokens
   stays within the rest.

A leaf of any size is many tasks' work: documents meet their leaf's budget by (leaf, share of ids), of which there are
``SALT``; its order is cut into 4096 buckets, whose totals decide, in spans of 64, which are taken whole; documents meet that decision
by share again, and only the one bucket where the rest runs out is ordered document by document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._rank import bucket_offsets, hashed_bucket, hashed_order
from ._spark import fresh, materialise

#: Shares of a leaf's documents that meet its budget in tasks of their own.
SALT = 64
WORD = r"[^\x20\x09-\x0D]+"


def count_tokens(text: Column) -> Column:
    """The number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """What a mix aims at.

    ``weights`` has positive integers by path (``"web"``, ``"web/en"``, ``"web/en/src0"``; 0 takes a branch out);
    siblings that it doesn't name have ``default_weight``. The budget is ``budget_tokens``, or ``budget_share`` (in
    thousandths) of the tokens that there are. No document is taken more than ``max_epochs`` times.
    """

    budget_share: int = 500
    budget_tokens: int | None = None
    max_epochs: int = 4
    seed: int = 42
    default_weight: int = 1
    weights: dict[str, int] = field(default_factory=dict)


def _weight(mix: Mix, path: Column) -> Column:
    found = F.lit(mix.default_weight)
    if mix.weights:
        known = F.create_map(*[F.lit(x) for pair in sorted(mix.weights.items()) for x in pair])
        found = F.coalesce(F.element_at(known, path), found)
    return found.cast("decimal(38,0)")


def allocate(nodes: DataFrame, parent: list[str], name: str, mix: Mix) -> DataFrame:
    """``nodes`` (``capacity``, ``parent_budget``) and ``budget``: the parent's budget shared among siblings."""
    nodes = nodes.withColumn("w", _weight(mix, F.concat_ws("/", *parent, name)))
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # most easily filled first; nodes without weight get nothing and come last
    ordered = siblings.orderBy(F.when(F.col("w") > 0, F.col("capacity") / F.col("w")).asc_nulls_last(), name)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    big = F.col("capacity").cast("decimal(38,0)")
    nodes = (
        nodes.withColumn("left", F.col("parent_budget") - F.coalesce(F.sum(big).over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", (F.col("w") > 0) & (big * F.col("w_left") <= F.col("left") * F.col("w")))
        .withColumn("rest", F.col("parent_budget") - F.sum(F.when(F.col("full"), big).otherwise(0)).over(siblings))
        .withColumn("w_rest", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(siblings))
    )
    share = F.when(F.col("w_rest") > 0, F.expr("(rest * w) div w_rest")).otherwise(0)
    open_ = ~F.col("full") & (F.col("w") > 0)
    nodes = nodes.withColumn("share", F.when(F.col("full"), big).otherwise(share).cast("decimal(38,0)"))
    # an open child has room for a token more than its share rounded down
    by_name = siblings.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    nodes = nodes.withColumn("spare", F.col("parent_budget") - F.sum("share").over(siblings)).withColumn("place", F.sum(F.when(open_, 1).otherwise(0)).over(by_name))
    budget = F.col("share") + F.when(open_ & (F.col("place") <= F.col("spare")), 1).otherwise(0)
    return nodes.withColumn("budget", budget.cast("long")).drop("w", "left", "w_left", "full", "rest", "w_rest", "share", "spare", "place")


def leaf_budgets(docs: DataFrame, mix: Mix) -> DataFrame:
    """``domain, lang, source, leaf_tokens, budget`` of each leaf of ``domain, lang, source, tokens`` rows."""
    levels = ["domain", "lang", "source"]
    leaves = materialise(docs.groupBy(*levels).agg(F.sum("tokens").alias("leaf_tokens")), "leaves")
    total = F.floor(F.sum("leaf_tokens").cast("decimal(38,0)") * mix.budget_share / 1000)
    if mix.budget_tokens is not None:
        total = F.lit(mix.budget_tokens)
    budgets = leaves.agg(total.cast("decimal(38,0)").alias("parent_budget"))
    parent: list[str] = []
    for level in levels:
        keys = [*parent, level]
        nodes = leaves.groupBy(*keys).agg(F.sum("leaf_tokens").alias("leaf_tokens"))
        nodes = nodes.withColumn("capacity", (F.col("leaf_tokens") * mix.max_epochs).cast("long"))
        # one row at the root; below it, one for each parent
        nodes = nodes.join(budgets, parent) if parent else nodes.join(F.broadcast(budgets), F.lit(True))
        budgets = allocate(nodes, parent, level, mix).select(*keys, "leaf_tokens", F.col("budget").cast("decimal(38,0)").alias("parent_budget"))
        if level != "source":
            budgets = budgets.drop("leaf_tokens")
        parent = keys
    return budgets.select(*levels, "leaf_tokens", F.col("parent_budget").cast("long").alias("budget"))


def select_mix(docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each input row: ``doc_id, domain, lang, source, tokens long, budget long, copies int``.

    ``budget`` is that of the row's leaf; ``copies`` is how often the mix takes the document, 0 to ``max_epochs``. A null
    domain, language or source is a branch of its own, named ``''``. Null texts have no tokens; documents without tokens
    are taken with the whole epochs and wherever they stand in the selected part of an order. Rows with a null id are
    ordered as if their id was ``''``. Rows that repeat an id share its place in the order and are counted each; where the
    rest runs out between them, none of them is taken. An empty table gives an empty result. Other columns are ignored.
    """
    named = {"domain": domain, "lang": F.col(lang_col), "source": F.col(source_col)}
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in named.items()],
        count_tokens(F.col(text_col)).alias("tokens"),
    )
    base = materialise(base, "tokens")
    leaf = ["domain", "lang", "source"]
    budgets = leaf_budgets(base, mix)
    budgets = materialise(
        budgets.withColumn("epochs", F.when(F.col("leaf_tokens") > 0, F.expr("budget div leaf_tokens")).otherwise(0).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("leaf_tokens")),
        "budgets",
    )
    # a leaf may hold most of the documents: each share of its ids meets a copy of its budget
    salted = budgets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(SALT)).cast("int")).join(salted, [*leaf, "salt"])
    order = hashed_order(F.lit(mix.seed), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = materialise(rows.withColumn("order", order).withColumn("bucket", hashed_bucket(F.col("order"))), "ordered")
    # the last bucket that begins within the rest is cut: those before it are taken whole, those behind it not at all
    offsets = bucket_offsets(rows, leaf, "bucket", F.col("tokens"), "before", {"room": F.max("rest")}).where("before <= room")
    cuts = offsets.groupBy(*leaf).agg(F.max("bucket").alias("last"), F.max("before").alias("before"))
    cuts = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    state = F.when(F.col("bucket") < F.col("last"), 1).when(F.col("bucket") == F.col("last"), 0).otherwise(-1)
    rows = rows.join(cuts, [*leaf, "salt"]).withColumn("state", state).drop("salt", "last")
    cut = rows.where("state = 0")
    # documents of one place in the order, such as those that share an id, are one row here
    places = cut.groupBy(*leaf, "order").agg(F.sum("tokens").alias("tokens"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    running = Window.partitionBy(*leaf).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    places = places.select(*leaf, "order", (F.col("before") + F.sum("tokens").over(running) <= F.col("rest")).alias("taken"))
    at_cut = cut.join(places, [*leaf, "order"])
    others = rows.where("state <> 0").withColumn("taken", F.col("state") > 0)
    copies = F.least(F.col("epochs") + F.when(F.col("taken"), 1).otherwise(0), F.lit(mix.max_epochs)).cast("int")
    return at_cut.select(*others.columns).unionByName(others).select("doc_id", *leaf, "tokens", "budget", copies.alias("copies"))


def apply_mix(docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, rows without an id and rows that share one as well.

    Columns of any name stay as they are. An empty table gives an empty result. Null and empty texts cost nothing and stay
    or go as :func:`select_mix` says.
    """
    chosen = select_mix(docs, mix, domain, id_col, text_col, lang_col, source_col)
    # an id has one place in its leaf's order, so all its rows there are taken equally often
    leaf = {"domain": domain, "lang": F.col(lang_col), "source": F.col(source_col)}
    names = {n: fresh(docs, f"_{n}") for n in (*leaf, "doc_id", "copies")}
    chosen = chosen.groupBy("doc_id", *leaf).agg(F.max("copies").alias("copies")).withColumnsRenamed(names)
    joined = docs.withColumns({names[n]: F.coalesce(c.cast("string"), F.lit("")) for n, c in leaf.items()} | {names["doc_id"]: F.col(id_col).cast("long")})
    same = [joined[names[n]] == chosen[names[n]] for n in leaf]
    joined = joined.join(chosen, [joined[names["doc_id"]].eqNullSafe(chosen[names["doc_id"]]), *same]).where(F.col(names["copies"]) > 0)
    if mix.max_epochs > 1:
        joined = joined.withColumn(names["copies"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    return joined.select(*docs.columns)
