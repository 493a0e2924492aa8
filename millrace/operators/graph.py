"""Property-graph operators over edges (src, dst[, weight, type]) and nodes (id, ...).

Walks are frontier joins with a bounded number of rounds. Each round is written to the shared folder, so a plan never holds more
than one round, whatever the depth. PageRank, blast radius and Louvain push values along edges that are stored once in
buckets of their source (``Links``); a round shuffles values, never edges, and every size of graph takes the same path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import risk_level
from millrace.operators import cover
from millrace.operators.incremental import with_ids
from millrace.operators.links import Links
from millrace.session import dropped, written

#: Sources whose walks go on at once: a node holds an eighth of this in bytes of masks at most.
SOURCES = 65_536
#: Sources in a row of their masks (a multiple of 64), and blocks whose sums a task holds.
BLOCK, HELD = 1024, 4096
#: Nodes at most whose rows are broadcast in a round, or that are a cover, and the edges that a node of the first kind has at least.
HUBS, HUB_EDGES = 2048, 64


def cut_lineage(df: DataFrame) -> DataFrame:
    return written(df, "graph")


def next_state(new: DataFrame, *old: DataFrame) -> DataFrame:
    """new, written; the tables that it came from and that no later round reads are removed."""
    new = cut_lineage(new)
    for df in old:
        dropped(df)
    return new


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree)."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def callees(edges: DataFrame, nodes: DataFrame, source: int) -> DataFrame:
    return edges.where(F.col("src") == source).select(F.col("dst").alias("id")).distinct().join(nodes, "id")


def callers(edges: DataFrame, nodes: DataFrame, target: int) -> DataFrame:
    return edges.where(F.col("dst") == target).select(F.col("src").alias("id")).distinct().join(nodes, "id")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight) both ways; weights of parallel and opposite edges add up, and a self loop counts twice."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("weight")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), w.alias("weight")))
    return both.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, the smaller id first."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """(id, depth): ids within ``depth`` steps of starts (id), with the fewest steps. Starts have 0. Each round is one join, written."""
    steps = edges.select("src", "dst")
    steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both_ways else steps
    seen = starts.select("id", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1)
        new = front.join(steps, front.id == steps.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = cut_lineage(seen.unionByName(new.select("id", F.lit(d).alias("depth"))))
        if not seen.where(F.col("depth") == d).limit(1).count():
            break
    return seen


def impact(edges: DataFrame, target: int, depth: int = 5) -> DataFrame:
    """(id, depth) of direct (1) and transitive callers of target. A depth out of 1..10 means 5 or 10."""
    depth = 5 if depth < 1 else min(depth, 10)
    spark = edges.sparkSession
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, spark.createDataFrame([(target,)], "id long"), depth).where("depth > 0")


def affected_files(declares: DataFrame, affected: DataFrame) -> DataFrame:
    """Files (path) that declare an affected symbol: declares (path, id)."""
    return declares.join(affected, "id", "left_semi").select("path").distinct()


def subgraph(edges: DataFrame, start: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth (at most 10) steps of start, and the edges among them."""
    nodes = reach(edges, edges.sparkSession.createDataFrame([(start,)], "id long"), min(depth, 10))
    return nodes, induced(edges, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct edges whose ends are both among nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").distinct()


def shortest_path(edges: DataFrame, start: int, goal: int, limit: int = 10, both_ways: bool = True) -> DataFrame:
    """(path, steps): of the shortest paths, the one whose ids come first; no row if there is none within limit steps."""
    steps = edges.select("src", "dst")
    steps = steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if both_ways else steps
    steps = steps.distinct()
    front = edges.sparkSession.createDataFrame([(start, [start])], "id long, path array<long>")
    seen = front.select("id")
    for _ in range(limit + 1):
        hit = front.where(F.col("id") == goal)
        if hit.limit(1).count():
            return hit.select("path", (F.size("path") - 1).alias("steps"))
        moved = front.join(steps, front.id == steps.src).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = cut_lineage(moved.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        seen = cut_lineage(seen.union(front.select("id")))
        if not front.limit(1).count():
            break
    return front.where("false").select("path", (F.size("path") - 1).alias("steps"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(id, rank) after a fixed number of rounds; the rank of nodes without out-edges is shared by all.

    Edges are bucketed once. A round joins the ranks to them, adds up by target (in part before the shuffle) and writes the ranks.
    """
    n = max(nodes.select("id").distinct().count(), 1)
    with Links(edges.select("src", "dst")) as links:
        out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("outs"))
        ranks = cut_lineage(nodes.select("id").distinct().join(out, "id", "left").withColumn("rank", F.lit(1.0 / n)))
        for _ in range(rounds):
            ranks = next_state(pagerank_round(links, ranks, damping, n), ranks)
    return ranks.select("id", "rank")


def pagerank_round(links: Links, ranks: DataFrame, damping: float, n: int) -> DataFrame:
    """The next (id, outs, rank) of all nodes."""
    loose = F.broadcast(ranks.where("outs is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose")))  # one row
    given = links.meet(ranks.where("outs is not null").select("id", (F.col("rank") / F.col("outs")).alias("share"))).groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("given"))
    new = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("given", F.lit(0.0)) + F.col("loose") / n)
    return ranks.drop("rank").join(given.hint("merge"), "id", "left").join(loose).select("id", "outs", new.alias("rank"))


def blast_radius(edges: DataFrame, start: int, ranks: DataFrame, depth: int = 3) -> DataFrame:
    """One row: nodes within depth steps either way (without start) and their share of all rank."""
    near = reach(edges, edges.sparkSession.createDataFrame([(start,)], "id long"), depth, both_ways=True).where("depth > 0")
    total = ranks.agg(F.sum("rank").alias("total"))
    return near.join(ranks, "id").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("rank"), F.lit(0.0)).alias("mass")).join(F.broadcast(total)).select("nodes", (F.col("mass") / F.col("total")).alias("share"))


def blast_shares(edges: DataFrame, ranks: DataFrame, depth: int = 3, sources: int = SOURCES) -> DataFrame:
    """(id, blast) for all nodes of ranks: the share of all rank within depth steps either way, the node itself left out.

    Where at most HUBS nodes are an end of every edge, the ranks are added up over those (``cover.masses``); else all nodes walk at once (``walked``).
    Both are exact.
    """
    both = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    both = cut_lineage(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    known = cut_lineage(ranks.select("id", "rank"))
    hubs = cover.hub_cover(both, HUBS) if depth > 1 else None
    if hubs:
        mass = cover.masses(both, known, hubs, depth)
    else:
        mass = walked(both, known, depth, sources)
    dropped(both)
    total = F.broadcast(known.agg(F.sum("rank").alias("total")))  # one row
    found = known.join(mass, "id", "left")
    share = F.when(F.col("total") > 0, F.greatest(F.coalesce("mass", F.lit(0.0)) - F.col("rank"), F.lit(0.0)) / F.col("total")).otherwise(0.0)
    return next_state(found.join(total).select("id", share.alias("blast")), known, mass)


def walked(both: DataFrame, ranks: DataFrame, depth: int, sources: int) -> DataFrame:
    """(id, mass): the rank of all nodes within depth steps, the node itself too.

    All nodes walk at once, BLOCK of them in a row: a row (id, block, b0, b1, ...) says which sources of a block have reached id.
    A round pushes the rows along the edges and ORs them by (id, block); every node has an edge to itself, so it keeps its own.
    Rows of the nodes with most edges (few) are broadcast to their edges, which lie in buckets of the target, so what goes
    from hubs to many nodes isn't shuffled. ``sources`` walks go on together, so a node never has more than
    sources / BLOCK rows of a fixed width; further sources take further passes.
    """
    known = next_state(with_ids(ranks.select(F.col("id").alias("node"), "rank"), ["node"]).select(F.col("node").alias("id"), F.col("id").alias("number"), "rank"))
    n = known.count()
    block, bit = F.floor(F.col("number") / BLOCK), F.expr("shiftleft(1L, cast(number % 64 as int))")
    bits = [f"b{i}" for i in range(BLOCK // 64)]
    ends = both.select("src").unionByName(known.select(F.col("id").alias("src"))).distinct()
    spark = both.sparkSession
    hubs = cut_lineage(both.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HUB_EDGES).orderBy(F.desc("n"), "src").limit(HUBS).select("src"))
    few = F.broadcast(hubs)  # HUBS rows at most
    sums = []
    with Links(both.join(few, "src", "left_anti").unionByName(ends.select("src", F.col("src").alias("dst")))) as even, Links(both.join(few, "src", "left_semi"), by="dst") as wide:
        for low in range(0, n, max(BLOCK, sources)):
            own = known.where(F.col("number").between(low, low + max(BLOCK, sources) - 1))
            state, old = own.select("id", block.alias("block"), *(F.when(F.floor(F.col("number") / 64) % (BLOCK // 64) == i, bit).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(bits))), ()
            ors = [F.bit_or(b).alias(b) for b in bits]
            for _ in range(depth):
                near = even.meet(state).groupBy("dst", "block").agg(*ors)
                sent = F.broadcast(state.withColumnRenamed("id", "src").join(few, "src", "left_semi"))  # HUBS * sources / BLOCK rows at most
                far = wide.even.join(sent, "src").groupBy("dst", "block").agg(*ors)
                state = next_state(near.unionByName(far).groupBy(F.col("dst").alias("id"), "block").agg(*ors), *old)
                old = (state,)
            reached = state.join(known.select("id", "rank"), "id").select("block", "rank", *bits)
            part = reached.mapInPandas(_masses, "block long, masses array<double>").select("block", F.posexplode("masses").alias("k", "mass")).where("mass > 0")
            sums.append(next_state(part.groupBy((F.col("block") * BLOCK + F.col("k")).alias("number")).agg(F.sum("mass").alias("mass")), *old))
    mass = sums[0] if sums else spark.createDataFrame([], "number long, mass double")
    for more in sums[1:]:
        mass = mass.unionByName(more)
    return next_state(known.join(mass, "number").select("id", "mass"), known, hubs, *sums)


def _masses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, masses): for each source of a block, the rank of this task's rows that it has reached; at most HELD blocks are held."""
    held: dict[int, np.ndarray] = {}

    def emit() -> pd.DataFrame:
        out = pd.DataFrame({"block": list(held), "masses": list(held.values())})
        held.clear()
        return out

    for f in frames:
        words = np.ascontiguousarray(f.iloc[:, 2:].to_numpy(np.int64)).astype("<i8", copy=False)
        blocks, rank = f.block.to_numpy(np.int64), f["rank"].to_numpy(np.float64)
        order = np.argsort(blocks, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], np.diff(blocks[order]) != 0, [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            at = order[a:b]
            set_ = np.unpackbits(np.ascontiguousarray(words[at]).view(np.uint8), axis=1, bitorder="little")
            own = int(blocks[at[0]])
            held[own] = held.get(own, 0.0) + rank[at] @ set_.astype(np.float64)
        if len(held) >= HELD:
            yield emit()
    if held:
        yield emit()


def risk(ranks: DataFrame, edges: DataFrame, blast: DataFrame) -> DataFrame:
    """(id, score, level): .35 of rank and .30 of in * out degree, each over its largest, and .35 of blast; at most 1."""
    rows = ranks.join(degrees(edges), "id", "left").fillna(0, ["in_degree", "out_degree"]).join(blast, "id", "left").fillna(0.0, ["blast"])
    rows = rows.withColumn("coupling", F.col("in_degree") * F.col("out_degree"))
    top = F.broadcast(rows.agg(F.max("rank").alias("mr"), F.max("coupling").alias("mc")))
    score = 0.35 * F.when(F.col("mr") > 0, F.col("rank") / F.col("mr")).otherwise(0.0) + 0.30 * F.when(F.col("mc") > 0, F.col("coupling") / F.col("mc")).otherwise(0.0) + 0.35 * F.col("blast")
    return rows.join(top).select("id", F.least(F.lit(1.0), score).alias("score")).withColumn("level", risk_level(F.col("score")))


def top(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    return rows.orderBy(F.desc(score), "id").limit(k)


def god_nodes(edges: DataFrame, threshold: int = 5, k: int = 20) -> DataFrame:
    return degrees(edges).where(F.col("degree") >= threshold).orderBy(F.desc("degree"), "id").limit(k)


def louvain(nodes: DataFrame, edges: DataFrame, passes: int = 500, least: float = 1e-10) -> DataFrame:
    """(id, community) by local moving: nodes join the neighbouring community of largest modularity gain, round after round,
    till none gains more than ``least``. Ties go to the smaller community; communities are numbered by their smallest member.

    Many nodes move in a round. Think of them as moving one after another, in an order that a hash gives anew in each round.
    A node moves if its gain outlasts the worst that moves before it can do: neighbours who leave its new community or come to
    its old one, and strength that gathers in the one or leaves the other (added up by powers of two of the order, not by
    node). So each move raises the modularity, whatever others do, no move is undone by another of its round, and the rounds
    end where no node gains. ``passes`` rounds that didn't suffice raise an error.
    """
    ids = nodes.select("id").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = cut_lineage(undirected(inner).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").cast("double").alias("weight")))
    m2 = both.agg(F.sum("weight").alias("m2")).first().m2
    strength = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"))
    labels = cut_lineage(ids.join(strength, "id", "left").select("id", F.col("id").alias("community"), F.coalesce("k", F.lit(0.0)).alias("k")))
    with Links(both) as links:
        for i in range(passes if m2 else 0):
            wish = cut_lineage(wishes(links, labels, m2, least, i))
            if not wish.limit(1).count():
                break
            moved = allowed(links, wish, m2).select("id", "to")
            labels = cut_lineage(labels.join(moved, "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k"))
        else:
            if m2:
                raise RuntimeError(f"nodes still move after {passes} rounds")
    names = labels.groupBy("community").agg(F.min("id").alias("first"))
    return cut_lineage(labels.join(names, "community").select("id", F.col("first").alias("community")))


def wishes(links: Links, labels: DataFrame, m2: float, least: float, turn: int) -> DataFrame:
    """(id, own, to, k, gain, place, level): nodes that gain by moving. gain is in units of weight; the smaller place moves first."""
    totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
    known = labels.join(totals, "community")
    near = links.meet(known.select("id", F.col("community").alias("to"), "total")).groupBy(F.col("dst").alias("id"), "to").agg(F.sum("weight").alias("w"), F.first("total").alias("to_total"))
    mine = near.join(known, "id")
    worth = F.round(F.col("w") - F.col("to_total") * F.col("k") / m2, 12)
    best = mine.groupBy("id").agg(
        F.max(F.when(F.col("to") != F.col("community"), F.struct(worth.alias("worth"), (-F.col("to")).alias("less")))).alias("best"),
        F.coalesce(F.max(F.when(F.col("to") == F.col("community"), F.col("w"))), F.lit(0.0)).alias("kept"),
        F.first("community").alias("own"), F.first("k").alias("k"), F.first("total").alias("total"))
    stay = F.col("kept") - (F.col("total") - F.col("k")) * F.col("k") / m2
    rows = best.where("best is not null").select("id", "own", (-F.col("best.less")).alias("to"), "k", (F.col("best.worth") - stay).alias("gain"))
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 1)
    level = F.floor(F.log2(F.greatest(place, F.lit(1)).cast("double"))).cast("int")
    return rows.where(2 * F.col("gain") / m2 > least).withColumn("place", place).withColumn("level", level)


def allowed(links: Links, wish: DataFrame, m2: float) -> DataFrame:
    """The wishes whose gain outlasts all wishes before them (see ``louvain``)."""
    before = links.meet(wish.select("id", F.col("own").alias("p_own"), F.col("to").alias("p_to"), F.col("place").alias("p_place"))).where("src <> dst")
    first = F.struct("p_place", "src") < F.struct("place", "id")
    leaves, comes = (F.col("p_own") == F.col("to")).cast("int"), (F.col("p_to") == F.col("own")).cast("int")
    harm = before.join(wish.select("id", "own", "to", "place"), before.dst == F.col("id")).where(first & (leaves + comes > 0))
    harm = harm.groupBy("id").agg(F.sum(F.col("weight") * (leaves + comes)).alias("harm"))
    touched = wish.select(F.explode(F.array("own", "to")).alias("community"), "level", "k").groupBy("community", "level").agg(F.sum("k").alias("k"))
    # at most 63 levels a community
    w = Window.partitionBy("community").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    drift = touched.select("community", "level", F.sum("k").over(w).alias("sum"))
    rows = wish.join(harm, "id", "left")
    for end in ("own", "to"):
        rows = rows.join(drift.select(F.col("community").alias(end), "level", F.col("sum").alias(f"{end}_sum")), [end, "level"])
    lost = F.coalesce("harm", F.lit(0.0)) + F.col("k") * F.greatest(F.col("own_sum") + F.col("to_sum") - 2 * F.col("k"), F.lit(0.0)) / m2
    return rows.where(F.col("gain") > lost)


def improvable(edges: DataFrame, labels: DataFrame, least: float = 1e-9) -> DataFrame:
    """(id, community, gain): nodes that would raise modularity by moving to a neighbour's community. edges: each undirected edge once."""
    links = undirected(edges)
    strength = links.groupBy("a").agg(F.sum("weight").alias("k"))
    named = labels.select(F.col("id").alias("a"), "community").join(strength, "a")
    totals = named.groupBy("community").agg(F.sum("k").alias("total"))
    m2 = F.broadcast(links.agg(F.sum("weight").alias("m2")))  # one row
    near = links.join(labels.select(F.col("id").alias("b"), F.col("community").alias("to")), "b").groupBy("a", "to").agg(F.sum("weight").alias("w"))
    own = near.select("a", F.col("to").alias("community"), F.col("w").alias("own"))
    rows = near.join(named, "a").where("to <> community").join(own, ["a", "community"], "left").join(totals, "community").join(totals.select(F.col("community").alias("to"), F.col("total").alias("to_total")), "to").join(m2)
    gain = 2 * (F.col("w") - F.col("to_total") * F.col("k") / F.col("m2") - F.coalesce("own", F.lit(0.0)) + (F.col("total") - F.col("k")) * F.col("k") / F.col("m2")) / F.col("m2")
    return rows.select(F.col("a").alias("id"), F.col("to").alias("community"), gain.alias("gain")).where(F.col("gain") > least)


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) by weighted label propagation; ties go to the smaller label, and nodes of odd hash move in odd rounds.

    The result is deterministic. Labels are the smallest ids that spread them.
    """
    links = undirected(edges.where("src <> dst")).select(F.col("a").alias("id"), "b", "weight")
    labels = nodes.select("id").distinct().withColumn("community", F.col("id"))
    for i in range(rounds):
        votes = links.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy("id", "community").agg(F.sum("weight").alias("weight"))
        best = votes.groupBy("id").agg(F.max_by("community", F.struct(F.round("weight", 9).alias("w"), (-F.col("community")).alias("c"))).alias("next"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        labels = cut_lineage(labels.join(best, "id", "left").select("id", F.when(turn, F.coalesce("next", "community")).otherwise(F.col("community")).alias("community")))
    return labels


def renumbered(labels: DataFrame) -> DataFrame:
    """(id, community, rank): communities numbered from 0 by size, ties by smallest member. The sizes are ranked by a range sort."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).withColumn("few", -F.col("n"))
    order = with_ids(sizes, ["few", "least"])
    return labels.join(order.select("community", F.col("id").alias("rank")), "community")


def community_labels(members: DataFrame) -> DataFrame:
    """The most frequent name of each community's members (community, name); ties go to the smaller name."""
    n = members.groupBy("community", "name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), "name")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("community", F.col("name").alias("label"))


def modularity(edges: DataFrame, labels: DataFrame, adjacent_only: bool = False) -> DataFrame:
    """One row: Newman-Girvan modularity; with adjacent_only, the expected weight counts for adjacent pairs only."""
    links = undirected(edges)
    a, b = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    strength = links.groupBy("a").agg(F.sum("weight").alias("k"))
    total = F.broadcast(links.agg(F.sum("weight").alias("m2")))  # one row
    inner = links.join(a, "a").join(b, "b").where("ca = cb")
    if adjacent_only:
        kb = strength.select(F.col("a").alias("b"), F.col("k").alias("kb"))
        return inner.join(strength, "a").join(kb, "b").join(total).agg((F.sum((F.col("weight") - F.col("k") * F.col("kb") / F.col("m2")) / F.col("m2"))).alias("modularity"))
    within = inner.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    square = strength.join(a, "a").groupBy("ca").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return within.join(square).join(total).select((F.col("w") / F.col("m2") - F.col("k2") / (F.col("m2") * F.col("m2"))).alias("modularity"))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, n, cohesion): half of the inner weight over n (n - 1), at most 1; 1 for single nodes."""
    links = undirected(edges.where("src <> dst"))
    a, b = labels.select(F.col("id").alias("a"), F.col("community").alias("ca")), labels.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inner = links.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("w"))
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") <= 1, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("w", F.lit(0.0)) / 2 / (F.col("n") * (F.col("n") - 1))))
    return sizes.join(inner, "community", "left").select("community", "n", value.alias("cohesion"))


def surprising_edges(edges: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """The heaviest edges between communities."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("src_community")), labels.select(F.col("id").alias("dst"), F.col("community").alias("dst_community"))
    return edges.join(a, "src").join(b, "dst").where("src_community <> dst_community").orderBy(F.desc("weight"), "src", "dst").limit(k)


def surprise(weight: Column, src_package: Column, dst_package: Column, src_community: Column, dst_community: Column) -> Column:
    """weight, times 1.5 between packages, times 1.2 between communities more than 3 apart."""
    return weight * F.when(src_package != dst_package, 1.5).otherwise(1.0) * F.when(F.abs(src_community - dst_community) > 3, 1.2).otherwise(1.0)


def repo_map(nodes: DataFrame, scores: DataFrame, budget: int = 2000) -> DataFrame:
    """Files by total score, as far as the running length of their lines / 4 stays within the budget. nodes: id, name, file."""
    files = nodes.join(scores, "id").groupBy("file").agg(F.sum("score").alias("score"), F.sum(F.length("name") + 1).alias("chars"), F.count(F.lit(1)).alias("symbols"))
    # a file takes a quarter of a token at least for each letter of its path, so the best 4 * budget files hold all that fit
    w = Window.orderBy(F.desc("score"), "file").rowsBetween(Window.unboundedPreceding, 0)
    files = files.orderBy(F.desc("score"), "file").limit(4 * budget)
    return files.withColumn("tokens", F.sum((F.col("chars") + F.length("file")) / 4).over(w)).where(F.col("tokens") <= budget)


def file_risk(scores: DataFrame) -> DataFrame:
    """The riskiest symbol of each file: scores (id, file, score)."""
    return scores.groupBy("file").agg(F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("i"))).alias("best")).select("file", "best.id", "best.score")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n) of nodes and edges by kind."""
    return nodes.groupBy(F.concat(F.lit("node:"), F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.concat(F.lit("edge:"), F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def symbol_search(nodes: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """Nodes whose fqn or name holds the part, in any case; equal fqns by id."""
    p = part.lower()
    return nodes.where(F.lower("fqn").contains(p) | F.lower("name").contains(p)).orderBy("fqn", "id").limit(limit)


def enclosing(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call site's (file, line) innermost first symbol: file, name, start_line, end_line. Joined by file, then by range."""
    hit = sites.join(symbols, "file").where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("file", "line").agg(F.min_by("name", F.struct("start_line", "name")).alias("symbol"))


def rationale(comments: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, name, notes): the comments from three lines before a symbol to its end, in order."""
    hit = comments.join(symbols, "file").where(F.col("line").between(F.col("start_line") - 3, F.col("end_line")))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "note"))), lambda s: s["note"]), "; ")
    return hit.groupBy("file", "name").agg(notes.alias("notes"))
