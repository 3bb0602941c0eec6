"""Filling fixed-capacity containers: pattern packing by non-negative least squares.

The histogram of item sizes has at most capacity + 1 entries a class, whatever the number of items. On it alone one task a class decides how
many containers of which sizes there are; the items then learn their places from their rank among the items of their size, by a join on
class, size and block of ranks. Nothing goes to the driver.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window

from ..session import settle, spread
from .tokens import VOCABULARY, token_count

#: Sizes are seen by the patterns in so many steps of the capacity; a pattern has so many items at most.
STEPS, MOST_IN_PATTERN = 128, 3
#: Items of one size are ranked in groups, and meet their runs in blocks of ranks, of about so many.
RANK_GROUP = 20_000
RUN_SCHEMA = "container_class string, size bigint, rank_from bigint, rank_to bigint, each bigint, container_from bigint, position_from bigint, fill bigint"


@dataclass
class Group:
    """``m`` containers that hold the same: ``slots`` are (size, items of it in each container)."""

    m: int
    free: int
    slots: list[tuple[int, int]] = field(default_factory=list)


def patterns(steps: int = STEPS, most: int = MOST_IN_PATTERN) -> list[tuple[int, ...]]:
    """Every multiset of 1 to ``most`` sizes in steps that fills a container exactly, and those of one or two that nearly do."""
    out: list[tuple[int, ...]] = []

    def grow(rest: int, top: int, got: tuple[int, ...]) -> None:
        if rest == 0:
            out.append(got)
        elif len(got) < most:
            for s in range(min(rest, top), 0, -1):
                if s * (most - len(got)) < rest:
                    break
                grow(rest - s, s, (*got, s))

    grow(steps, steps, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |ax - b| over x >= 0 by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(np.argmax(w))
        if active.all() or w[j] <= tol:
            break
        active[j] = True
        while True:
            idx = np.flatnonzero(active)
            own = a[:, idx]
            s = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(idx)), own.T @ b)
            if (s > 1e-12).all():
                x[:] = 0
                x[idx] = s
                break
            bad = s <= 1e-12
            step = np.min(x[idx][bad] / np.maximum(x[idx][bad] - s[bad], 1e-300))
            x[idx] += step * (s - x[idx])
            drop = idx[x[idx] <= 1e-12]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def plan_groups(hist: dict[int, int], capacity: int, steps: int = STEPS) -> list[Group]:
    """Containers for a histogram of sizes 0..capacity, every item in exactly one.

    1. Fit repeat counts of few-item patterns to the histogram in steps by non-negative least squares, and round down.
    2. Fill the patterns with the real sizes, largest first; what the steps rounded up stays free.
    3. Pack the residuals, largest first, into the least free space that takes them, else into new containers.
    """
    left = {s: n for s, n in hist.items() if n > 0 and s > 0}
    groups: list[Group] = []
    if left:
        pats = patterns(steps)
        step_of = {s: -(-s * steps // capacity) for s in left}
        h = np.zeros(steps)
        for s, n in left.items():
            h[step_of[s] - 1] += n
        a = np.zeros((steps, len(pats)))
        for j, p in enumerate(pats):
            for s in p:
                a[s - 1, j] += 1
        # short items fit anywhere later, so a miss there costs least: rows weigh by size
        w = (np.arange(steps) + 1.0) / steps
        repeats = np.floor(nnls(a * w[:, None], h * w) + 1e-6).astype(np.int64)
        stock = Stock(left, step_of)
        for j in np.argsort([-max(p) for p in pats], kind="stable"):
            groups += _draw(pats[j], int(repeats[j]), stock, capacity)
        left = stock.left
    groups = _pack_rest(groups, left, capacity)
    return _spread_empty(groups, hist.get(0, 0), capacity)


class Stock:
    """The sizes not yet placed, in order, and by step."""

    def __init__(self, left: dict[int, int], step_of: dict[int, int]) -> None:
        self.left, self.sizes = dict(left), sorted(left)
        self.by_step: dict[int, list[int]] = defaultdict(list)
        for s in self.sizes:
            self.by_step[step_of[s]].append(s)

    def largest(self, step: int) -> int | None:
        """The largest size left in the step."""
        own = self.by_step[step]
        while own and not self.left.get(own[-1]):
            own.pop()
        return own[-1] if own else None

    def fitting(self, free: int) -> int | None:
        """The largest size left that fits into the space."""
        i = bisect.bisect_right(self.sizes, free) - 1
        return self.sizes[i] if i >= 0 else None

    def take(self, size: int, n: int) -> int:
        n = min(n, self.left[size])
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return n


def _draw(pattern: tuple[int, ...], r: int, stock: Stock, capacity: int) -> list[Group]:
    """At most ``r`` containers of the pattern: the largest sizes left in the steps of all but its last item, then, for the
    last, the largest size that really fits, so that what the steps rounded up isn't lost. Equal containers form one group."""
    heads = pattern[:-1] or pattern
    open_ = [Group(r, capacity)]
    for step in heads:
        nxt = []
        for g in open_:
            while g.m and (s := stock.largest(step)) is not None and s <= g.free:
                m = stock.take(s, g.m)
                nxt.append(Group(m, g.free - s, [*g.slots, (s, 1)]))
                g.m -= m
            if g.m and g.slots:
                nxt.append(g)
        open_ = nxt
    if len(pattern) > 1:
        nxt = []
        for g in open_:
            while g.m and (s := stock.fitting(g.free)) is not None:
                m = stock.take(s, g.m)
                nxt.append(Group(m, g.free - s, [*g.slots, (s, 1)]))
                g.m -= m
            if g.m:
                nxt.append(g)
        open_ = nxt
    return open_


def _pack_rest(groups: list[Group], left: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, largest first; a run of equal containers is filled, and split, as one."""
    by_free: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        by_free[g.free].append(g)
    frees = sorted(by_free)

    def put(g: Group) -> None:
        if not by_free[g.free]:
            bisect.insort(frees, g.free)
        by_free[g.free].append(g)

    for s in sorted(left, reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(frees, s)
            if i < len(frees):
                free = frees[i]
                g = by_free[free].pop()
                if not by_free[free]:
                    frees.pop(i)
            else:
                each = capacity // s
                g = Group(-(-n // each), capacity)
            each = min(g.free // s, n)
            m = min(g.m, n // each)
            if m < g.m:
                put(Group(g.m - m, g.free, list(g.slots)))
            n -= m * each
            put(Group(m, g.free - each * s, [*g.slots, (s, each)]))
    return [g for f in frees for g in by_free[f] if g.slots]


def _spread_empty(groups: list[Group], n: int, capacity: int) -> list[Group]:
    """Items of size 0, spread evenly over the containers there are."""
    if not n:
        return groups
    groups = groups or [Group(1, capacity)]
    each = -(-n // sum(g.m for g in groups))
    out = []
    for g in groups:
        m = min(g.m, n // each) if n >= each else 0
        if m:
            out.append(Group(m, g.free, [*g.slots, (0, each)]))
            n -= m * each
        if m < g.m and 0 < n < each:
            out.append(Group(1, g.free, [*g.slots, (0, n)]))
            n, m = 0, m + 1
        if m < g.m:
            out.append(Group(g.m - m, g.free, g.slots))
    return out


def runs_of(name: str, groups: list[Group], capacity: int) -> list[tuple]:
    """Rows of RUN_SCHEMA: which ranks of a size go to which containers and positions."""
    rank: dict[int, int] = defaultdict(int)
    out, container = [], 0
    for g in sorted(groups, key=lambda g: (g.free, g.slots)):
        position = 0
        for s, each in g.slots:
            n = g.m * each
            out.append((name, s, rank[s], rank[s] + n, each, container, position, capacity - g.free))
            rank[s] += n
            position += each
        container += g.m
    return out


def plan_runs(hist: DataFrame) -> DataFrame:
    """The runs of every class from its histogram (container_class, cap, size, count), one task a class. A class's histogram has at most capacity + 1 rows."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["cap"].iloc[0])
        rows = runs_of(pdf["container_class"].iloc[0], plan_groups(dict(zip(pdf["size"].astype(int), pdf["count"].astype(int), strict=True)), capacity), capacity)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RUN_SCHEMA.split(", ")])

    return hist.groupBy("container_class").applyInPandas(plan, RUN_SCHEMA)


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(container_class, doc_id, piece, n_pieces, tokens, container, position, fill) of every document in each class.

    A document longer than the capacity, and only such a one, is split: into pieces of the capacity and the rest. Each piece
    lies in one container, at a position counted from 0; ``fill`` is the number of tokens in that container.

    Sizes, histogram and runs are made once and written to the shared folder. Items are ranked inside groups of about 20,000 and join their runs by blocks of
    as many ranks, so equal sizes, even a third of all rows, never meet in one task, and no side of a join is broadcast but the few sizes that are ranked in groups, where Spark finds them small.
    Which of the items of one size gets which of its places is arbitrary.

    Defined cases: null or empty texts have 0 tokens and are spread over the containers; a null doc_id is an item like any
    other, rows of one doc_id are items of their own; a class without a positive capacity has no containers; of a class
    named twice the largest capacity holds; empty tables give an empty result; other columns are never read.
    """
    classes = containers.where("container_class IS NOT NULL AND capacity_tokens > 0").groupBy("container_class").agg(F.max("capacity_tokens").cast("bigint").alias("cap"))
    each_class = classes.agg(F.collect_list(F.struct("container_class", "cap"))).scalar()
    # numbers tell rows of one doc_id, or without one, apart; they are written with the sizes, so they stay what they are
    sized = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.monotonically_increasing_id().alias("no"), token_count(F.col("text"), vocabulary).alias("n"))
    sized, _ = settle(sized, "sizes")
    per = sized.select("doc_id", "no", "n", F.explode(each_class).alias("c")).select("doc_id", "no", "n", "c.*")
    whole = F.greatest(F.ceil(F.col("n") / F.col("cap")), F.lit(1)).cast("bigint")
    pieces = per.withColumn("n_pieces", whole).select("container_class", "doc_id", "no", "n_pieces", "cap", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)).alias("piece"))
    items = pieces.withColumn("size", F.least("cap", F.col("n") - F.col("piece") * F.col("cap")))
    hist, _ = settle(items.groupBy("container_class", "cap", "size").count().coalesce(1), "histogram")
    runs, _ = settle(plan_runs(hist), "runs")

    # rank of each item among those of its class and size: groups by hash, their offsets, and the order inside
    W, key = window.Window, ["container_class", "size", "g"]
    many = hist.where(F.col("count") > RANK_GROUP).select("container_class", "size", F.ceil(F.col("count") / RANK_GROUP).alias("n_groups"))
    keyed = items.drop("n", "cap").join(many, ["container_class", "size"], "left").withColumn("g", F.coalesce(F.pmod(F.xxhash64("no", "piece"), "n_groups"), F.lit(0)))
    counts = keyed.where("n_groups IS NOT NULL").groupBy(*key).count()
    offsets = counts.select(*key, (F.sum("count").over(W.partitionBy("container_class", "size").orderBy("g")) - F.col("count")).alias("before"))
    ranked = keyed.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "piece", "no")).cast("bigint") - 1).join(offsets, key, "left").withColumn("r", F.col("r") + F.coalesce("before", F.lit(0)))
    blocks = F.sequence(F.floor(F.col("rank_from") / RANK_GROUP), F.floor((F.col("rank_to") - 1) / RANK_GROUP))
    plan = runs.withColumn("block", F.explode(blocks))
    # merged, as runs grow with sizes and patterns; a broadcast of them would be bounded by the capacity only
    placed = ranked.withColumn("block", F.floor(F.col("r") / RANK_GROUP)).join(plan.hint("merge"), ["container_class", "size", "block"]).where((F.col("r") >= F.col("rank_from")) & (F.col("r") < F.col("rank_to")))
    at = F.col("r") - F.col("rank_from")
    return placed.select(
        "container_class", "doc_id", "piece", "n_pieces", F.col("size").alias("tokens"),
        (F.col("container_from") + F.floor(at / F.col("each"))).alias("container"), (F.col("position_from") + F.pmod(at, F.col("each"))).alias("position"), "fill",
    )


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per class: containers, items, tokens and the share of the space that they fill."""
    per = packed.groupBy("container_class").agg(F.max("container").alias("last"), F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("n_tokens"))
    caps = containers.groupBy("container_class").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    n = F.col("last") + 1
    return per.join(caps, "container_class").select("container_class", "capacity_tokens", n.alias("n_containers"), "n_items", "n_tokens", F.round(F.col("n_tokens") / (n * F.col("capacity_tokens")), 6).alias("filled_share"))


def pack_check(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """What must hold of any packing, per class: every document is there with all its pieces; how many containers are overfull, have another fill than they
    say, or positions other than 0, 1, 2, ...; how many documents are split without need."""
    caps = containers.groupBy("container_class").agg(F.max("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    per = packed.groupBy("container_class", "container").agg(F.sum("tokens").alias("t"), F.min("fill").alias("low"), F.max("fill").alias("high"), F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("k"), F.max("position").alias("last"))
    boxes = per.join(caps, "container_class").groupBy("container_class", "capacity_tokens").agg(
        F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_overfull"),
        F.count_if((F.col("t") != F.col("low")) | (F.col("t") != F.col("high"))).alias("n_wrong_fill"),
        F.count_if((F.col("n") != F.col("k")) | (F.col("last") != F.col("n") - 1)).alias("n_holes"),
    )
    short = (F.col("n_pieces") > 1) & (F.col("piece") < F.col("n_pieces") - 1) & (F.col("tokens") < F.col("capacity_tokens"))
    docs = packed.join(caps, "container_class").groupBy("container_class").agg(F.count_if(F.col("piece") == 0).alias("n_documents"), (F.sum(F.when(F.col("piece") == 0, F.col("n_pieces")).otherwise(0)) == F.count(F.lit(1))).alias("pieces_whole"), F.count_if(short | ((F.col("n_pieces") > 1) & (F.col("tokens") == 0))).alias("n_needless_splits"))
    return boxes.join(docs, "container_class")
