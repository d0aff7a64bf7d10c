"""Exact diameters of all components at once, by bounds on eccentricities.

The eccentricity of a node is its distance to the farthest node of its
component; the diameter is the largest.  A search from a node of eccentricity e
that reaches a node after k steps shows that the latter's eccentricity is at
least max(k, e - k) and at most e + k.  Each round searches from some nodes
of every unfinished component and narrows the bounds of all its nodes; a
component is finished when its largest lower bound meets its largest upper one.
No node is searched twice and a searched node's bounds are equal, so this ends.

Two more bounds spare most of the searches.  A node linked to all others leaves a
diameter of at most 2, and of 1 only where all nodes are such: stars need no
search.  And only *unsettled* nodes, whose upper bounds exceed the component's
largest lower bound, can be farther apart than that.  So to an unsettled node only
the distances to other unsettled ones matter: a search that reached it after k
steps and all unsettled nodes within r shows that its eccentricity is at most
k + r or else that lower bound.  This unsettles fewer nodes, so it is repeated.

Most components need few searches, some one from every node of a side.  So rounds
grow: 32 searches of a component, then 512, then as many as rows allow.

The searches of a component share one pass: bits in 64-bit words tell which of
them have just reached a node, a step ORs the words of its neighbours, combined ahead
of the shuffle.  In an undirected graph a search that comes back to a node left
it one or two steps ago, so two steps are remembered instead of all nodes seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from edgetables.functions.ids import big
from edgetables.operators.pairs import component_map
from edgetables.plans.components import ID_TYPES, find_components
from edgetables.plans.contract import MAX_BROADCAST_ROWS
from edgetables.plans.fixed_point import NotConverged
from edgetables.plans.hot_groups import join_facts
from edgetables.plans.keys import number_edges
from edgetables.plans.storage import TASK_ROWS, Workspace, task_count

WORD = 64  # searches in a word: the bits of a long
WIDTH = 8  # words in a row at most
FIRST = 32  # searches of one component in the first round
GROWTH = 16  # times as many in each further round, as far as rows allow
MAX_ROUNDS = 1000
STEPS = 8  # of a search in one job, where the links can be broadcast; fewer in wide rows
UNKNOWN = 2**62


@dataclass
class Diameters:
    """Bounds on the diameter of each component: ``rows (component, n_nodes, at_least, at_most)``.

    They are equal if ``exact``.  The rows are read from stored tables:
    ``close()``, or leaving the result as a context, removes them.
    """

    rows: DataFrame
    rounds: int
    exact: bool
    workspace: Workspace

    def __enter__(self) -> Diameters:
        return self

    def __exit__(self, *exc) -> None:
        self.workspace.close()

    def close(self) -> None:
        self.workspace.close()


class Round(NamedTuple):
    """What a round works with: up to ``n_nodes`` nodes, and ``most`` rows in a broadcast."""

    workspace: Workspace
    number: int
    n_nodes: int
    links: DataFrame
    n_links: int
    most: int
    limit: int | None

    @property
    def name(self) -> str:
        return f"round-{self.number}"


def component_diameters(edges: DataFrame, **options) -> DataFrame:
    """``(component, n_nodes, diameter)`` of ``edges (src, dst)``, taken as undirected; a lonely node has diameter 0."""
    if "on_limit" in options:
        raise TypeError("an unfinished result needs find_diameters, which marks it")
    return find_diameters(edges, **options).rows.select("component", "n_nodes", F.col("at_most").alias("diameter"))


def find_diameters(
    edges: DataFrame, max_rounds: int = MAX_ROUNDS, on_limit: str = "raise", max_group_rows: int | None = None
) -> Diameters:
    """Narrow the bounds on every component's diameter until they meet.

    Ids, nulls, self-loops and copies count as in ``find_components``.  After
    ``max_rounds`` rounds ``on_limit="return"`` hands back the bounds reached by
    then instead of raising.  Whatever raises leaves no table behind.
    """
    workspace = Workspace(edges.sparkSession)
    try:
        return _find(edges, max_rounds, on_limit, max_group_rows, workspace)
    except BaseException:
        workspace.close()
        raise


def _find(edges: DataFrame, max_rounds: int, on_limit: str, limit: int | None, workspace: Workspace) -> Diameters:
    spark, keyed = edges.sparkSession, None
    if any(dict(edges.dtypes)[end] not in ID_TYPES for end in ("src", "dst")):
        keyed = number_edges(edges, workspace, limit)
        edges = keyed.edges
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = edges.filter("src != dst").select(F.inline(ends)).select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    both = both.distinct()
    with find_components(edges, max_group_rows=limit) as run:
        if 2 * run.n_rows > TASK_ROWS:  # links to one node lie together, so tasks combine what reaches it
            both = both.repartitionByRange(task_count(2 * run.n_rows), "dst", "src")
        links, seen = workspace.write(both, "links", F.count(F.lit(1)).alias("n"), n_rows=2 * run.n_rows)
        n_links = seen["n"]
        degrees = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
        labels = component_map(run.pairs, run.lonely).join(degrees, "node", "left")
        alone = F.col("degree").isNull()
        first = labels.select(
            "node",
            "component",
            F.coalesce("degree", big(0)).alias("degree"),
            big(0).alias("lower"),
            F.when(alone, big(0)).otherwise(big(UNKNOWN)).alias("upper"),
            F.lit(False).alias("searched"),
        )
        bounds, seen = workspace.write(first, "bounds-0", F.count(F.lit(1)).alias("n"), n_rows=n_links)
    n_nodes, done, searches, n_met = seen["n"], 0, [], 0
    most = min(MAX_BROADCAST_ROWS, limit or MAX_BROADCAST_ROWS)
    is_open = F.col("at_least") < F.col("at_most")
    facts = F.count_if(is_open).alias("open"), F.max(F.when(is_open, F.col("n_nodes"))).alias("largest")
    sizes, seen = workspace.write(_sizes(bounds), "sizes-0", *facts)
    while seen["open"] and done < max_rounds:
        workspace.write(sizes.filter(~is_open), f"results/after-{done}")
        nodes = _of_open(bounds, sizes.filter(is_open), n_nodes, limit)
        at = Round(workspace, done, n_nodes, links, n_links, most, limit)
        met, n_rows = _search(nodes, min(FIRST * GROWTH**done, seen["largest"]), at)
        searches, n_met = [*searches, met], n_met + n_rows
        here, ends, shown = _ends(nodes.withColumn("at_least", big(0)), n_nodes, met, "ends", at)
        step, n_here, n_some, all_far = 0, n_rows, n_nodes, shown["far"]
        while True:
            frame = _narrowed(nodes, here, n_here, ends, shown["n"], at)
            nodes, counted = workspace.write(frame, f"{at.name}/bounds-{step}", F.count(F.lit(1)).alias("n"))
            sizes, seen = workspace.write(_sizes(nodes), f"{at.name}/sizes-{step}", *facts)
            n_nodes = counted["n"]
            if not seen["open"]:
                break
            unsettled = _of_open(nodes, sizes.filter(is_open), n_nodes, limit).filter("upper > at_least")
            some, left = workspace.write(unsettled, f"{at.name}/unsettled-{step}", F.count(F.lit(1)).alias("n"))
            if left["n"] == n_some or (step and 2 * left["n"] > n_some):
                break
            n_some, step = left["n"], step + 1
            if step == 1:  # older searches are read again only if these end sooner
                here, ends, shown = _ends(some, n_some, met, "ends-unsettled", at)
                if shown["far"] == all_far:
                    break
            if len(searches) > 1 or step > 1:
                here, ends, shown = _ends(some, n_some, _together(searches), f"ends-{step}", at)
                n_here = n_met
        bounds, done = nodes, done + 1
    if seen["open"] and on_limit == "raise":
        raise NotConverged(f"the diameter of {seen['open']} components is not settled after {max_rounds} rounds")
    workspace.write(sizes, f"results/after-{done}")
    for old in ("links", "searches", *[f"round-{i}" for i in range(max(0, done - 1))]):
        workspace.drop(old)
    rows = spark.read.schema(sizes.schema).parquet(f"{workspace.table('results')}/*")
    if keyed:
        facts = keyed.keys.select(F.col("id").alias("component"), "key")
        rows = rows.join(facts, "component").select(F.col("key").alias("component"), "n_nodes", "at_least", "at_most")
    return Diameters(rows, done, not seen["open"], workspace)


def _of_open(bounds: DataFrame, unfinished: DataFrame, n_nodes: int, limit: int | None) -> DataFrame:
    """The nodes of unfinished components with these components' ``n_nodes`` and ``at_least``."""
    facts = unfinished.select("component", "n_nodes", "at_least")
    return join_facts(bounds, facts, "component", n_nodes, limit).filter("n_nodes is not null")


def _sizes(bounds: DataFrame) -> DataFrame:
    """``(component, n_nodes, at_least, at_most)`` from the bounds of the nodes and from their degrees."""
    most = F.count(F.lit(1)) - 1
    linked_to_all = F.when(F.min("degree") == most, F.least(most, big(1))).when(F.max("degree") == most, big(2))
    return bounds.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.greatest(F.max("lower"), F.when(F.min("degree") == most, F.least(most, big(1))).otherwise(big(2))).alias("at_least"),
        F.least(F.max("upper"), linked_to_all).alias("at_most"),
    )


def _sources(nodes: DataFrame, n_searches: int, at: Round) -> DataFrame:
    """``(node, n_nodes, place)``: the nodes that tell most, up to ``n_searches`` per component with places from 0.

    Those that may be farthest out raise the lower bounds, those in the middle
    lower the upper ones, those with many unsettled neighbours settle them.  Of the
    first a quarter is enough.  Small numbers of ranks are limited per task before they are shuffled.
    """
    unsettled = nodes.filter("upper > at_least").select(F.col("node").alias("src"), F.lit(True).alias("unsettled"))
    if at.n_nodes <= at.most:
        beside = at.links.join(F.broadcast(unsettled), "src")
    else:
        beside = join_facts(at.links, unsettled, "src", at.n_links, at.limit).filter("unsettled")
    beside = beside.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("beside"))
    left = nodes.filter("not searched").join(beside, "node", "left")
    orders = [F.desc("upper"), F.desc("degree")], [F.asc("lower"), F.desc("degree")], [F.desc_nulls_last("beside")]
    ranked = []
    for share, order in zip((4, 1, 1), orders):
        place = F.row_number().over(Window.partitionBy("component").orderBy(*order, "node"))
        some = left.select("node", "component", "n_nodes", place.alias("place")).filter(F.col("place") <= n_searches)
        ranked.append(some.withColumn("place", share * F.col("place")))
    picked = reduce(DataFrame.unionByName, ranked).groupBy("node", "component").agg(F.any_value("n_nodes").alias("n_nodes"), F.min("place").alias("place"))
    place = F.row_number().over(Window.partitionBy("component").orderBy("place", "node"))
    return picked.select("node", "n_nodes", place.alias("place")).filter(F.col("place") <= n_searches).withColumn("place", F.col("place") - 1)


def _search(nodes: DataFrame, n_searches: int, at: Round) -> tuple[DataFrame, int]:
    """``(node, round, block, level, word_0, ...)``: which searches reach a node after ``level`` steps; and a bound on its rows.

    A row of the state has up to ``WIDTH`` words; nodes have as many rows (*blocks*) as a broadcast has room for.
    """
    width = min(WIDTH, -(-n_searches // WORD))
    n_searches = min(n_searches, WORD * width * max(1, at.most // at.n_nodes))
    small = at.n_links <= at.most
    steps = max(1, STEPS // width) if small else 1
    levels = [[f"{name}_{j}" for j in range(width)] for name in ("before", *[f"word_{i}" for i in range(steps + 1)])]
    own = [F.expr(f"if(place div {WORD} % {width} = {j}, shiftleft(1L, place % {WORD}), 0L)") for j in range(width)]
    start = _sources(nodes, n_searches, at).select(
        "node",
        F.expr(f"place div {WORD * width}").alias("block"),
        "n_nodes",
        F.lit(True).alias("going"),
        *[big(0).alias(c) for c in levels[0]],
        *[word.alias(c) for word, c in zip(own, levels[1])],
    )
    name = f"searches/{at.name}"
    state, seen = at.workspace.write(start, f"{at.name}/start", F.count(F.lit(1)).alias("n"), F.sum("n_nodes").alias("pairs"))
    base, n_rows, n_moving, unmet = 0, 0, seen["n"], seen["pairs"] - seen["n"]
    while True:
        now = state.select("node", "block", "going", *levels[0], *levels[1])
        for i in range(steps):
            now = _step(now, levels, i, small, n_moving, at)
        new = [c for level in levels[2:] for c in level]
        metrics = {
            "going": F.count_if("going"),
            "rows": F.sum(sum(_any(level).cast("long") for level in levels[1:])),
            "met": F.sum(sum(F.bit_count(c) for c in new)),
        }
        # Whether words have bits is stored: a filter on many columns that get other names takes the planner seconds.
        going = _any(levels[-1]).alias("going"), _any(levels[-1] + levels[-2]).alias("lately"), F.lit(base).alias("base")
        stored = now.select("node", "block", *[c for level in levels[1:] for c in level], *going)
        stored, seen = at.workspace.write(stored, f"{name}/{base}", *[m.alias(c) for c, m in metrics.items()])
        n_rows, n_moving, unmet = n_rows + (seen["rows"] or 0), seen["going"], unmet - (seen["met"] or 0)
        if not unmet:
            break
        renamed = [F.col(c).alias(to) for old, new in ((levels[-2], levels[0]), (levels[-1], levels[1])) for c, to in zip(old, new)]
        state = stored.filter("lately").select("node", "block", "going", *renamed)
        base += steps
    wide = at.workspace.spark.read.schema(stored.schema).parquet(f"{at.workspace.table(name)}/*")
    reached = [
        F.struct((F.col("base") + i).alias("level"), *[F.col(c).alias(f"word_{j}") for j, c in enumerate(level)])
        for i, level in enumerate(levels[1:])
    ]
    met = wide.select("node", F.lit(at.number).alias("round"), "block", "base", F.inline(F.array(*reached)))
    met = met.filter(_any(_words(met)) & F.expr("level > base or base = 0"))  # the last level opens the next table
    return met.drop("base"), n_rows


def _words(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c.startswith("word_")]


def _together(searches: list[DataFrame]) -> DataFrame:
    """The rows of all rounds' searches, in as many words as the widest has."""
    width = max(len(_words(met)) for met in searches)
    padded = [met.withColumns({f"word_{j}": big(0) for j in range(len(_words(met)), width)}) for met in searches]
    return reduce(DataFrame.unionByName, padded)


def _step(now: DataFrame, levels: list[list[str]], i: int, small: bool, n_moving: int, at: Round) -> DataFrame:
    """``now`` with the words of one more level, those that a node's neighbours have just got and it has not."""
    known, current = [c for level in levels[: i + 2] for c in level], levels[i + 1]
    came = [f"came_{j}" for j in range(len(current))]
    moved = [F.col(c).alias(to) for c, to in zip(current, came)]
    if small:  # one mention of ``now`` a step, or the plan would double with each
        met = now.join(F.broadcast(at.links), now["node"] == at.links["src"])
        itself = F.struct(F.col("src").alias("node"), *known, *[big(0).alias(c) for c in came])
        other = F.struct(F.col("dst").alias("node"), *[big(0).alias(c) for c in known], *moved)
        rows = met.select("block", F.inline(F.array(itself, other)))
        merged = rows.groupBy("node", "block").agg(*[F.bit_or(c).alias(c) for c in (*known, *came)])
    else:
        moving = now.filter("going").select(F.col("node").alias("src"), "block", *moved)
        if n_moving <= at.most:
            met = at.links.join(F.broadcast(moving), "src")
        else:  # then nodes have one row each
            met = join_facts(at.links, moving, "src", at.n_links, at.limit).filter("block is not null")
        others = met.groupBy(F.col("dst").alias("node"), "block").agg(*[F.bit_or(c).alias(c) for c in came])
        merged = now.drop("going").join(others, ["node", "block"], "full_outer").na.fill(0, [*known, *came])
    new = [
        F.col(c).bitwiseAND(F.bitwise_not(F.col(last).bitwiseOR(F.col(before)))).alias(to)
        for c, last, before, to in zip(came, current, levels[i], levels[i + 2])
    ]
    return merged.select("node", "block", *known, *new)


def _any(words: list[str]):
    """Whether any of the words has a bit."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.col(c) for c in words]) != 0


def _ends(some: DataFrame, n_some: int, met: DataFrame, name: str, at: Round) -> tuple[DataFrame, DataFrame, dict]:
    """``met`` of the nodes ``some``; for each block ``(far, word_0, ...)`` of its searches whose last steps to ``some`` are ``far``.

    And the number of blocks and the sum of the last steps.
    """
    words = _words(met)
    some = some.select("node", "component", "at_least")
    here = met.join(F.broadcast(some) if n_some <= at.most else some, "node")
    here = here.withColumn("searches", F.struct("component", "round", "block")).drop("component", "round", "block")
    levels = here.groupBy("searches", "level").agg(*[F.bit_or(c).alias(c) for c in words])
    before = Window.partitionBy("searches").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(c).over(before), big(0)))).alias(c) for c in words]
    last = levels.select("searches", F.col("level").alias("far"), *last).filter(_any(words))
    far = F.sum(F.col("far") * sum(F.bit_count(c) for c in words)).alias("far")
    ends = last.groupBy("searches").agg(F.collect_list(F.struct("far", *[F.col(c).alias(f"end_{c}") for c in words])).alias("ends"), far)
    ends, seen = at.workspace.write(ends, f"{at.name}/{name}", F.count(F.lit(1)).alias("n"), F.sum("far").alias("far"))
    return here, ends.drop("far"), seen


def _narrowed(nodes: DataFrame, here: DataFrame, n_here: int, ends: DataFrame, n_ends: int, at: Round) -> DataFrame:
    """The bounds of ``nodes`` by the searches that met some of them.

    A search shows of a node at most its own steps to the node and to the farthest of these nodes, and ``at_least``, which
    bounds the distances to all others.
    """
    if n_ends <= at.most:
        known = here.join(F.broadcast(ends), "searches")
    else:
        known = join_facts(here, ends, "searches", n_here, at.limit)
    words = _words(here)
    known = known.select("node", "at_least", "level", *words, F.inline("ends"))
    known = known.filter(reduce(lambda a, b: a | b, [F.col(c).bitwiseAND(F.col(f"end_{c}")) != 0 for c in words]))
    level, far = F.col("level").cast("bigint"), F.col("far").cast("bigint")
    shown = known.select(
        "node",
        F.lit(None).cast("bigint").alias("component"),
        big(0).alias("degree"),
        F.greatest(level, far - level).alias("lower"),
        F.greatest("at_least", far + level).alias("upper"),
        (level == 0).alias("searched"),
    )
    together = nodes.select("node", "component", "degree", "lower", "upper", "searched").unionByName(shown).groupBy("node")
    return together.agg(
        F.max("component").alias("component"),
        F.max("degree").alias("degree"),
        F.max("lower").alias("lower"),
        F.min("upper").alias("upper"),
        F.max("searched").alias("searched"),
    )
