"""Mixing sources to target weights: hierarchical budgets, then a token-prefix of seeded epochs from every leaf.

Everything is relational. Budgets are shared out level by level by windows over the children of a node, and the cut of each leaf's last epoch is found by
sums over hash bits, so that neither leaves nor documents are gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import folded
from ..session import settle, spread
from .tokens import VOCABULARY, token_count

#: The order hash has 63 bits; a leaf's documents are narrowed down by so many at a time, twice, and those that are left are looked at one by one.
HASH_BITS, CUT_BITS = 63, 12
OTHER = "other"


def share_out(children: DataFrame, parent: Sequence[str], within: str = "parent_budget") -> DataFrame:
    """``children`` with ``budget``: their parent's budget, by weight, and what a child can't take (its capacity) to its siblings.

    children: the parent's columns, ``within`` (the parent's budget), weight > 0 and capacity. As a parent's capacity is that of its children, a shortage
    is met among siblings first, and only what all of them together lack reaches the ancestors. In order of capacity by weight those that are full come
    first: a child is full if its capacity lies below its share of what those before it leave.
    """
    all_ = Window.partitionBy(*parent)
    before = all_.orderBy(F.col("capacity") / F.col("weight"), "weight").rowsBetween(Window.unboundedPreceding, -1)
    taken, weights = F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = children.withColumn("goal_", F.least(F.col(within), F.sum("capacity").over(all_)))
    out = out.withColumn("full_", F.col("capacity") * weights <= F.col("weight") * (F.col("goal_") - taken) * (1 + 1e-12))
    rest = F.col("goal_") - F.coalesce(F.sum(F.when(F.col("full_"), F.col("capacity"))).over(all_), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("full_"), F.col("weight"))).over(all_)
    return out.withColumn("budget", F.when(F.col("full_"), F.col("capacity")).otherwise(F.greatest(F.col("weight") * rest / open_, F.lit(0.0)))).drop("goal_", "full_")


def budgets(leaves: DataFrame, total: Column) -> DataFrame:
    """leaves (domain, lang, source, weight, capacity) with the budget of each, shared out from the total down the domain - language - source tree."""
    sums = (F.sum("weight").alias("weight"), F.sum("capacity").alias("capacity"))
    of = leaves.where("weight > 0")
    langs = of.groupBy("domain", "lang").agg(*sums)
    domains = share_out(langs.groupBy("domain").agg(*sums).withColumn("parent_budget", total.cast("double")).withColumn("root_", F.lit(0)), ["root_"])
    langs = share_out(langs.join(domains.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"])
    return share_out(of.join(langs.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"]), ["domain", "lang"]).drop("parent_budget")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in a leaf's epoch: 63 bits, so that bits can be cut from the top."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("bigint"), doc_id), 1)


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 17,
    domains: DataFrame | None = None,
    language_weights: Mapping[str, float] | None = None,
    vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """(draws, shares): the documents drawn, and what each source was to have and has.

    draws: (doc_id, source, lang, tokens, epoch), one row per use of a document; epochs count from 0, and a document is used in
    the whole epochs of its leaf and, if it lies in the prefix, in the last one. shares: one row per named source of targets or documents, with
    target_share, budget_tokens, drawn_tokens, actual_share, n_documents, n_draws and most_uses.

    The tree is domain - language - source; a leaf is a source's texts in one language. Its weight is the source's target_share, divided among the
    source's languages by the tokens it has in them (or by ``language_weights``); nodes weigh what their leaves do. ``domains`` has (source, domain); a
    source it lacks is in the domain 'other'. ``total_tokens`` defaults to the tokens of all documents whose source is in targets. A leaf can give
    its tokens max_repeats times. Only documents of sources with a target are sized, and only their leaves are budgeted.

    Each leaf's epochs run in the order of a seeded hash, so they need no sort. The last one ends before or after the document in which the budget ends,
    whichever is nearer; so a leaf misses its budget by at most half that document. No leaf, whatever its share of the rows, is gathered in one task.

    Defined cases: source names are compared without case and outer blanks; a null or blank source is no source; a null or
    blank lang is 'und'; a null doc_id is dropped; rows of one doc_id count once; a null or negative share counts as 0, a
    null max_repeats as 1; of a source named twice the shares add up and the lower max_repeats holds; null or empty texts have
    0 tokens and are drawn if their hash falls in the prefix. Empty tables give empty results. Other columns are never read.
    """
    wanted = targets.select(folded(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("reps"))
    goal = wanted.where("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.min("reps").cast("int").alias("reps"))
    if domains is None:
        goal = goal.withColumn("domain", F.lit(OTHER))
    else:
        of = domains.select(folded(F.col("source")).alias("source"), "domain").where("source IS NOT NULL").groupBy("source").agg(F.min("domain").alias("domain"))
        goal = goal.join(of, "source", "left").withColumn("domain", F.coalesce("domain", F.lit(OTHER)))
    goal, _ = settle(goal.coalesce(1), "goal")
    named = documents.where(F.col("doc_id").isNotNull() & folded(F.col("source")).isNotNull()).select("doc_id", folded(F.col("source")).alias("source"), F.coalesce(folded(F.col("lang")), F.lit("und")).alias("lang"), F.col("text"))
    sized = spread(named).join(goal.select("source"), "source", "left_semi").select("doc_id", "source", "lang", token_count(F.col("text"), vocabulary).alias("tokens"))
    sized, _ = settle(sized.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "tokens")).alias("d")).select("doc_id", "d.*"), "mix")

    # a source without documents is a leaf without capacity, in no language: what it can't take goes to its domain first
    leaves = goal.join(sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")), "source", "left").withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    if language_weights is None:
        part = F.col("tokens").cast("double")
    else:
        part = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in language_weights.items() for x in kv]), F.col("lang")), F.lit(0.0)).cast("double")
    own = Window.partitionBy("source")
    leaves = leaves.withColumn("part", F.when(F.col("tokens") > 0, part).otherwise(0.0)).withColumn("weight", F.col("share") * F.coalesce(F.try_divide(F.col("part"), F.sum("part").over(own)), 1 / F.count(F.lit(1)).over(own))).withColumn("capacity", F.col("tokens").cast("double") * F.col("reps"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar() if total_tokens is None else F.lit(total_tokens)
    plan = budgets(leaves, total).where("tokens > 0").withColumn("whole", F.least(F.floor(F.col("budget") / F.col("tokens") + 1e-12), F.col("reps")).cast("int"))
    plan = plan.withColumn("rest", F.when(F.col("whole") < F.col("reps"), F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0.0))
    plan, _ = settle(plan.select("domain", "lang", "source", "tokens", "budget", "whole", "rest").coalesce(1), "plan")
    cuts, _ = settle(_cuts(sized, plan.where("rest > 0").select("source", "lang", "whole", "rest"), seed).coalesce(1), "cuts")

    rows = sized.join(plan.select("source", "lang", "whole"), ["source", "lang"]).join(cuts, ["source", "lang"], "left")
    h = order_hash(seed, F.col("whole"), F.col("doc_id"))
    in_prefix = F.coalesce((h < F.col("cut")) | ((h == F.col("cut")) & (F.col("doc_id") <= F.col("cut_id"))), F.lit(False))
    rows = rows.withColumn("uses", F.col("whole") + in_prefix.cast("int")).where("uses > 0").select("doc_id", "source", "lang", "tokens", "uses")
    draws = rows.select("doc_id", "source", "lang", "tokens", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("epoch"))

    drawn = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("drawn_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("uses").cast("bigint").alias("n_draws"), F.max("uses").alias("most_uses"))
    names = documents.select(folded(F.col("source")).alias("source")).where("source IS NOT NULL").unionByName(goal.select("source")).distinct()
    asked = names.join(goal, "source", "left").join(plan.groupBy("source").agg(F.sum("budget").alias("budget_tokens")), "source", "left")
    shares = asked.join(drawn, "source", "left").withColumn("all_tokens", drawn.agg(F.sum("drawn_tokens")).scalar())
    zero = lambda c, t="bigint", to=None: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(to or c)
    actual = F.round(F.coalesce(F.try_divide(F.col("drawn_tokens"), F.col("all_tokens")), F.lit(0.0)), 6).alias("actual_share")
    return draws, shares.select("source", zero("share", "double", "target_share"), zero("reps", "int", "max_repeats"), F.round(F.coalesce("budget_tokens", F.lit(0.0)), 3).alias("budget_tokens"), zero("drawn_tokens"), actual, zero("n_documents"), zero("n_draws"), zero("most_uses", "int"))


def _cuts(sized: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(source, lang, cut, cut_id) for leaves (source, lang, whole, rest): hash and doc_id of the last document of the prefix that has ``rest`` tokens of the epoch.

    A radix select in three steps. Sums over the first bits of the hash tell in which bucket the prefix ends; sums over the next bits, of that bucket only,
    narrow it down again; and of what is left, one in 2^24 of a leaf's documents, running sums tell the document. Two steps suffice for leaves of
    up to some 10^11 documents; a bucket holds so few that one task sorts it.
    """
    leaf = ["source", "lang"]
    docs = sized.join(wanted, leaf).withColumn("h", order_hash(seed, F.col("whole"), F.col("doc_id"))).withColumn("known", F.lit(0.0))
    for step in (1, 2):
        docs = docs.withColumn("b", F.expr(f"shiftright(h, {HASH_BITS - step * CUT_BITS})"))
        sums = docs.groupBy(*leaf, "b", "rest", "known").agg(F.sum("tokens").alias("t"))
        # tokens before the bucket; those of the buckets settled before are the same for all rows of a leaf
        before = F.col("known") + F.sum("t").over(Window.partitionBy(*leaf).orderBy("b")) - F.col("t")
        at = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("t"))).select(*leaf, "b", "before")
        docs = docs.drop("known").join(at.withColumnRenamed("before", "known"), [*leaf, "b"])
    before = F.col("known") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    last = docs.withColumn("before", before).withColumn("fits", (F.col("before") + F.col("tokens") <= F.col("rest")) | (F.col("before") + F.col("tokens") / 2 < F.col("rest")))
    found = last.groupBy(*leaf).agg(F.max(F.when(F.col("fits"), F.struct("h", "doc_id"))).alias("end"), F.expr(f"shiftleft(min(b), {HASH_BITS - 2 * CUT_BITS}) - 1").alias("none"))
    # a leaf without a bucket found ends, by rounding, with its whole epoch
    every = F.lit((1 << 63) - 1)
    ends = found.select(*leaf, F.coalesce("end.h", "none").alias("cut"), F.coalesce("end.doc_id", every).alias("cut_id"))
    return wanted.select(*leaf).join(ends, leaf, "left").select(*leaf, F.coalesce("cut", every).alias("cut"), F.coalesce("cut_id", every).alias("cut_id"))


def mix_check(draws: DataFrame, shares: DataFrame) -> DataFrame:
    """Per source with a target: whether no document is used more than max_repeats times or twice in an epoch, whether epochs have no gap, and whether the
    tokens drawn are those of the budget but for half a document in each language."""
    per = draws.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("epoch").alias("k"), F.max("epoch").alias("last"), F.max("tokens").alias("tokens"), F.max("lang").alias("lang"))
    own = per.groupBy("source").agg(F.max("n").alias("uses"), F.bool_and((F.col("n") == F.col("k")) & (F.col("last") == F.col("n") - 1)).alias("in_order"), F.max("tokens").alias("longest"), F.count_distinct("lang").alias("langs"))
    j = shares.where("max_repeats > 0").join(own, "source", "left")
    near = F.abs(F.col("drawn_tokens") - F.col("budget_tokens")) <= F.coalesce(F.col("longest") * F.col("langs") / 2, F.lit(0)) + 1
    return j.select("source", "target_share", "max_repeats", F.coalesce(F.col("uses") <= F.col("max_repeats"), F.lit(True)).alias("repeats_kept"), F.coalesce("in_order", F.lit(True)).alias("in_order"), F.coalesce(near | F.col("longest").isNull(), F.lit(True)).alias("budget_met"))
