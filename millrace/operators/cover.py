"""What lies within a few steps of every node, in graphs where few nodes (hubs) are an end of every edge.

Nodes that are no hubs (leaves) have hubs as neighbours only, so a leaf is within ``depth`` steps of a node if one of its hubs is within
depth - 1. Distances between hubs are a small bit matrix; leaves with equal hubs are one class. What remains are pairs of
classes, compared in cells of two packed blocks: a cell's work is a few word operations for 64 pairs, and nothing of it is stored
but a sum for each source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import dropped, written

#: Classes of sources and of targets in a block, and parts at most into which the blocks of each are dealt.
SOURCE_ROWS, TARGET_ROWS, PARTS = 4096, 1 << 18, 64
#: Lists, or targets, that are held as bits at a time, and bytes of a source block's bits that are summed at a time.
ROWS, TILE = 128, 128


def hub_cover(both: DataFrame, most: int) -> list[int] | None:
    """At most ``most`` nodes so that each edge of both (src, dst; each in both directions) has an end among them; None if those with most edges are no such set."""
    spark = both.sparkSession
    best = [r.src for r in both.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(most).collect()]
    few = spark.createDataFrame(list(enumerate(best)), "at int, id long")
    placed = both.join(F.broadcast(few.select(F.col("id").alias("src"), F.col("at").alias("a"))), "src", "left").join(F.broadcast(few.select(F.col("id").alias("dst"), F.col("at").alias("b"))), "dst", "left")
    # each edge takes its end with more edges
    taken = [r.at for r in placed.select(F.least("a", "b").alias("at")).distinct().collect()]
    return None if None in taken else [best[i] for i in sorted(taken)]


def flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, their items)."""
    n = lists.str.len().to_numpy(np.int64)
    return n, np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)


def bits_of(n: np.ndarray, items: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each list, with the bits of its items."""
    out = np.zeros((len(n), 8 * width), bool)
    out[np.repeat(np.arange(len(n)), n), items] = True
    return np.packbits(out, axis=1, bitorder="little")


def ors(table: np.ndarray, n: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The OR of the table's rows that each list names; lists aren't empty."""
    return np.bitwise_or.reduceat(table[items], np.cumsum(n) - n, axis=0)


def slices(n: np.ndarray, rows: int, most: int = 1 << 15) -> Iterator[tuple[int, int, int, int]]:
    """(first list, end, first item, end) of runs of at most ``rows`` lists and about ``most`` items."""
    ends = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(n):
        b = max(a + 1, min(a + rows, int(np.searchsorted(ends, ends[a] + most, "right")) - 1))
        yield a, b, int(ends[a]), int(ends[b])
        a = b


def shared_hubs(lists: DataFrame, n_hubs: int) -> np.ndarray:
    """The bit matrix of hubs that are together in a list (hubs). A task holds one such matrix, and so does the driver."""
    width = row_bytes(n_hubs)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = np.zeros((n_hubs, width), np.uint8)
        for f in frames:
            n, items = flat(f.hubs)
            for a, b, i, j in slices(n, ROWS * 32):
                own, length = items[i:j], n[a:b]
                rows = bits_of(length, own, width)
                order = np.argsort(own, kind="stable")
                start = np.flatnonzero(np.diff(own[order], prepend=-1))
                met[own[order][start]] |= np.bitwise_or.reduceat(rows[np.repeat(np.arange(len(length)), length)[order]], start, axis=0)
        some = np.flatnonzero(met.any(1))
        yield pd.DataFrame({"at": some.astype(np.int32), "bits": [met[k].tobytes() for k in some]})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([np.frombuffer(b, np.uint8) for b in f.bits])
        return pd.DataFrame({"at": f["at"].iloc[:1], "bits": [np.bitwise_or.reduce(rows, axis=0).tobytes()]})

    found = lists.select("hubs").mapInPandas(part, "at int, bits binary").groupBy("at").applyInPandas(merged, "at int, bits binary")
    return matrix(found, n_hubs)


def row_bytes(n_hubs: int) -> int:
    return 8 * math.ceil(n_hubs / 64)


def matrix(rows: DataFrame, n_hubs: int) -> np.ndarray:
    """The rows (at, bits) as a matrix of hubs by hubs, true or false."""
    out = np.zeros((n_hubs, row_bytes(n_hubs)), np.uint8)
    for r in rows.collect():
        out[r["at"]] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out, axis=1, bitorder="little")[:, :n_hubs].astype(bool)


def hub_distances(beside: np.ndarray, shared: np.ndarray, depth: int) -> list[np.ndarray]:
    """For 0 to depth steps, which hubs are within them: a path goes on to a neighbour, or by a leaf to another hub of it."""

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.float32) @ b.astype(np.float32) > 0

    near = [np.eye(len(beside), dtype=bool), np.eye(len(beside), dtype=bool) | beside]
    while len(near) <= depth:
        near.append(product(near[-1], near[1]) | product(near[-2], shared))
    return near


def packed_bits(*parts: np.ndarray) -> np.ndarray:
    """The matrices' rows below each other, in bytes."""
    rows = np.packbits(np.concatenate(parts), axis=1, bitorder="little")
    out = np.zeros((len(rows), row_bytes(parts[0].shape[1])), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out


def blocks(rows: DataFrame, size: int, value: str, kind: str) -> DataFrame:
    """(n, hubs, value), all packed: blocks of at most ``size`` rows (hubs, value), sorted by the length of their lists."""
    parts = max(1, min(PARTS, math.ceil(rows.count() / size)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for f in frames:
            while len(f):
                held.append(f.iloc[: size - count])
                f, count = f.iloc[size - count :], count + len(held[-1])
                if count == size:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(held)
        f = f.iloc[np.argsort(f.hubs.str.len().to_numpy(np.int64), kind="stable")]
        n, items = flat(f.hubs)
        return pd.DataFrame([(n.astype(np.int32).tobytes(), items.tobytes(), f[value].to_numpy(kind).tobytes())], columns=["n", "hubs", value])

    return written(rows.select("hubs", value).repartition(parts).mapInPandas(run, f"n binary, hubs binary, {value} binary"), "cover").repartition(parts)


def reached_sums(sources: DataFrame, targets: DataFrame, near: np.ndarray) -> DataFrame:
    """(number, mass): for each source the weights of the targets of which a hub is near. sources, targets: blocks; near: a row of bits for each place in the sources' lists."""
    place = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                mass = cell(np.frombuffer(r.n, np.int32), np.frombuffer(r.hubs, np.int32), np.frombuffer(r.t_n, np.int32), np.frombuffer(r.t_hubs, np.int32), np.frombuffer(r.weight, np.float64))
                number = np.frombuffer(r.number, np.int64)
                yield pd.DataFrame({"number": number, "mass": mass[: len(number)]})

    def cell(n: np.ndarray, hubs: np.ndarray, t_n: np.ndarray, t_hubs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        wide = 64 * math.ceil(len(n) / 64)
        by_hub = np.zeros((8 * near.shape[1], wide // 8), np.uint8)
        for a, b, i, j in slices(n, 64 * ROWS):
            # slices start at a byte, as they have 64 * ROWS lists or are padded below
            own = np.unpackbits(ors(near, n[a:b], hubs[i:j]), axis=1, bitorder="little")
            ahead = a % 8
            by_hub[:, a // 8 : math.ceil(b / 8)] |= np.packbits(np.pad(own, ((ahead, 0), (0, 0))), axis=0, bitorder="little").T
        by_hub, mass = by_hub.view(np.uint64), np.zeros(wide)
        first = np.cumsum(t_n.astype(np.int64)) - t_n
        cut = np.flatnonzero(np.diff(t_n, prepend=-1, append=-1))
        for low, high in zip(cut[:-1], cut[1:]):  # lists of one length
            for a in range(low, high, ROWS):
                b = min(high, a + ROWS)
                own = t_hubs[first[a] : first[a] + (b - a) * t_n[a]].reshape(b - a, -1)
                met = by_hub[own[:, 0]]
                for k in range(1, own.shape[1]):
                    met |= by_hub[own[:, k]]
                add_up(met.view(np.uint8), weight[a:b], mass)
        return mass

    def add_up(met: np.ndarray, weight: np.ndarray, mass: np.ndarray) -> None:
        for c in range(0, met.shape[1], TILE):
            mass[8 * c : 8 * (c + TILE)] += weight @ np.unpackbits(met[:, c : c + TILE], axis=1, bitorder="little").astype(np.float64)

    pairs = sources.crossJoin(targets.select(F.col("n").alias("t_n"), F.col("hubs").alias("t_hubs"), "weight").hint("shuffle_replicate_nl"))  # nothing is broadcast
    return pairs.mapInPandas(run, "number long, mass double")


def hub_sums(sources: DataFrame, near: np.ndarray, weight: np.ndarray) -> DataFrame:
    """(number, mass): for each source the weights of the hubs that are near."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                n, hubs, out = np.frombuffer(r.n, np.int32), np.frombuffer(r.hubs, np.int32), []
                for a, b, i, j in slices(n, 8 * ROWS):
                    out.append(np.unpackbits(ors(near, n[a:b], hubs[i:j]), axis=1, bitorder="little")[:, : len(weight)].astype(np.float64) @ weight)
                yield pd.DataFrame({"number": np.frombuffer(r.number, np.int64), "mass": np.concatenate(out)})

    return sources.mapInPandas(run, "number long, mass double")


def masses(both: DataFrame, known: DataFrame, hubs: list[int], depth: int) -> DataFrame:
    """(id, mass): the rank of all nodes within ``depth`` (2 at least) steps, the node itself too. known: (id, rank); nodes without edges have no row."""
    spark, n_hubs = both.sparkSession, len(hubs)
    marked = spark.createDataFrame(list(enumerate(hubs)), "at int, hub long")
    few = F.broadcast(marked)  # as many rows as there are hubs
    lists = both.join(few, both.dst == F.col("hub")).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("at")).alias("hubs"))
    lists = written(lists.join(F.broadcast(marked.select(F.col("hub").alias("id"), F.col("at").alias("own"))), "id", "left"), "cover")
    leaves = lists.where("own is null").join(known, "id", "left")
    classes = leaves.groupBy("hubs").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("weight"), F.count("rank").alias("n"))
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()), "cover")
    width = row_bytes(n_hubs)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"at": f.own.astype(np.int32), "bits": [r.tobytes() for r in bits_of(*flat(f.hubs), width)]})

    beside = matrix(lists.where("own is not null").select("own", "hubs").mapInPandas(rows, "at int, bits binary"), n_hubs)
    near = hub_distances(beside, shared_hubs(classes, n_hubs), depth)
    weight = np.zeros(n_hubs)
    for r in marked.join(known, F.col("hub") == F.col("id")).select("at", "rank").collect():  # as many as there are hubs
        weight[r["at"]] += r["rank"]
    # a hub as a source is a list of one place, in the second half of the tables
    asked = classes.where("n > 0").select("hubs", "number").unionByName(marked.select(F.array(F.col("at") + n_hubs).alias("hubs"), (-1 - F.col("at")).cast("long").alias("number")))
    sources, targets = blocks(asked, SOURCE_ROWS, "number", "int64"), blocks(classes.where("weight > 0"), TARGET_ROWS, "weight", "float64")
    found = reached_sums(sources, targets, packed_bits(near[depth - 2], near[depth - 1])).unionByName(hub_sums(sources, packed_bits(near[depth - 1], near[depth]), weight))
    found = written(found.groupBy("number").agg(F.sum("mass").alias("mass")), "cover")
    own = lists.where("own is null").join(classes.select("hubs", "number"), "hubs").select("id", "number").unionByName(marked.select(F.col("hub").alias("id"), (-1 - F.col("at")).cast("long").alias("number")))
    out = written(own.join(found, "number").select("id", "mass"), "cover")
    for table in (lists, classes, found, sources, targets):
        dropped(table)
    return out
