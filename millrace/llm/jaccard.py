"""N-gram Jaccard join by T-occurrence search.

Documents are sets of distinct word shingles. Equal sets form classes at once; one document stands for each class. The
shingles of a set are ordered by hash, and two sets that reach the threshold t share s of the first n - ceil(t n) + s of
them (the prefix), for any s up to the overlap. With s a tenth of the set, documents that share a passage or a line are
no candidates. Inverted lists of the prefixes give the candidates. Each query set is then searched in its candidates: DivideSkip heap-merges the short inverted lists, probes the
long ones by binary search, and keeps the candidates that reach the overlap which the threshold requires.

Links only matter as far as they join components. So two rounds search each document in one candidate that shares most
lists with it; only lists that still hold several components are then searched in full, each document of the
smaller component against all of the larger. No link between components can be missed, and a group of n near copies
costs about n searches, not n squared.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt_dedup import BUCKET_BYTES, split
from .common import release, table, written

#: Up to so many ids are broadcast to filter the documents; beyond it, the join shuffles.
MAX_BROADCAST_IDS = 500_000
#: Sets in a block that is indexed at a time, and queries that go to one copy of it.
BLOCK, QUERIES = 1024, 4096
#: Pairs that are packed at a time.
PACK = 1 << 18
ROUNDS = 2
#: Lists that a pair must share besides a tenth of its shingles.
SHARED = 4


class Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, words: int, memo: Hashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of lower-cased words; one for the whole of a shorter text; none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ ids[j : len(ids) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def least_shared(n: int, percent: int) -> int:
    """Lists that a set of n shingles must share with a set that isn't smaller, for the pair to be a candidate."""
    return min(SHARED + n // 10, -(-percent * n // 100))


def enough(n, percent: int):
    """least_shared as an expression."""
    return F.least(F.lit(SHARED) + F.floor(n / 10), F.ceil(F.lit(percent) * n / 100))


def packed(documents: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, kind, ids, of, keys). Kind 1: distinct (shingle of a prefix, document) pairs by bucket of the shingle; keys are 5 bytes
    of its hash, of are places in ids. Kind 0: documents, with their numbers of shingles in of and the digests of their sets in keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo, held, size, turn = Hashes(), [], 0, 0

        def emit() -> list[tuple]:
            h, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, bounds = split((h % np.uint64(buckets)).astype(np.int64), buckets)
            out = []
            for k in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[k] : bounds[k + 1]]
                ids, of = np.unique(doc[own], return_inverse=True)
                five = (h[own] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                out.append((k, 1, ids.tobytes(), of.astype(np.uint32).tobytes(), np.ascontiguousarray(five.T).tobytes()))
            return out

        for f in frames:
            counts, digests, rows = [], [], []
            for i, t in zip(f.doc_id, f.text):
                s = shingles(t, words, memo)
                n = len(s)
                counts.append(n)
                digests.append(hashlib.md5(s.tobytes()).digest())
                if n:
                    p = n - -(-percent * n // 100) + least_shared(n, percent)
                    held.append((s[:p].copy(), np.full(min(p, n), i, np.int64)))
                    size += min(p, n)
                if size >= PACK:
                    rows += emit()
                    size = 0
            if len(f):
                turn += 1
                rows.append(((int(f.doc_id.iloc[0]) + turn) % buckets, 0, f.doc_id.to_numpy(np.int64).tobytes(), np.array(counts, np.int32).tobytes(), b"".join(digests)))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "ids", "of", "keys"])
            release()
        if size:
            yield pd.DataFrame(emit(), columns=["bucket", "kind", "ids", "of", "keys"])
        release()

    return documents.select("doc_id", "text").mapInPandas(run, "bucket int, kind int, ids binary, of binary, keys binary")


def unpacked(blobs: DataFrame, buckets: int) -> DataFrame:
    """Rows with n: (doc_id, n, sig), sig null for an empty set. Rows with tok: (doc_id, tok), for lists of several documents."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        plain, pairs = rows[rows.kind == 0], rows[rows.kind == 1]
        out = []
        for ids, of, keys in zip(plain.ids, plain.of, plain["keys"]):
            n = np.frombuffer(of, np.int32)
            out.append(pd.DataFrame({"doc_id": np.frombuffer(ids, np.int64), "n": n, "sig": [keys[16 * i : 16 * i + 16] if c else None for i, c in enumerate(n)]}))
        if len(pairs):
            keys, docs = [], []
            for ids, of, five in zip(pairs.ids, pairs.of, pairs["keys"]):
                of = np.frombuffer(of, np.uint32)
                wide = np.zeros((len(of), 8), np.uint8)
                wide[:, :5] = np.frombuffer(five, np.uint8).reshape(5, -1).T
                keys.append(wide.view("<u8").ravel())
                docs.append(np.frombuffer(ids, np.int64)[of])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc = key[new], doc[new]
            same = key[1:] == key[:-1]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            tok = key[several].astype(np.int64) * buckets + int(rows.bucket.iloc[0])
            out.append(pd.DataFrame({"doc_id": doc[several], "tok": tok}))
        release()
        done = pd.concat(out) if out else pd.DataFrame()
        return done.reindex(columns=["doc_id", "n", "sig", "tok"]).astype({"doc_id": "Int64", "n": "Int64", "tok": "Int64"})

    return blobs.groupBy("bucket").applyInPandas(run, "doc_id long, n long, sig binary, tok long")


class Index:
    """Inverted lists of a few thousand sets, each sorted and distinct."""

    def __init__(self, ids: list[tuple[int, int]], sets: list[np.ndarray]) -> None:
        """ids: each set's document and component."""
        self.ids, self.sets = ids, sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def search(self, query: np.ndarray, comp: int, percent: int) -> list[int]:
        """For each component but comp, a document whose overlap with the query reaches the threshold, by DivideSkip."""
        needs = -(-percent * (len(query) + self.sizes) // (100 + percent))
        fit = np.minimum(self.sizes, len(query)) >= needs
        if not fit.any():
            return []
        least = int(needs[fit].min())
        begin, end = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        lengths = end - begin
        n_long = min(least - 1, int(least / (0.01 * math.log2(2 + lengths.max()) + 1)))
        order = np.argsort(lengths, kind="stable")
        short, long = order[: len(query) - n_long], np.sort(order[len(query) - n_long :])
        counts: dict[int, int] = {}
        for c in heapq.merge(*(self.owner[begin[i] : end[i]].tolist() for i in short if lengths[i])):
            counts[c] = counts.get(c, 0) + 1
        probes, out, done = query[long], [], {comp}
        for c, n in counts.items():
            if fit[c] and n + n_long >= needs[c] and self.ids[c][1] not in done:
                own = self.sets[c]
                at = np.searchsorted(own, probes)
                if n + int((own[np.minimum(at, len(own) - 1)] == probes).sum()) >= needs[c]:
                    out.append(self.ids[c][0])
                    done.add(self.ids[c][1])
        return sorted(out)


def searched(queries: DataFrame, members: DataFrame, labels: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) of each query a of (g, k, a) to members b of (g, k, b), one for each other component; g, k is a block of bounded size.

    The queries of a block are split into salts of bounded size, each with its own copy of the members.
    """
    queries = written(queries.select("g", "k", "a").distinct(), "jaccard-queries")
    counts = queries.groupBy("g", "k").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("salts"))
    queries = queries.join(counts, ["g", "k"]).select("g", "k", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("s"), F.lit(1).alias("kind"), F.col("a").alias("rep"))
    members = members.select("g", "k", "b").join(counts, ["g", "k"]).select("g", "k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"), F.lit(0).alias("kind"), F.col("b").alias("rep"))
    rows = written(queries.unionByName(members).join(labels, "rep"), "jaccard-rows")
    needed = rows.select("rep").distinct()
    needed = F.broadcast(needed) if needed.count() <= MAX_BROADCAST_IDS else needed

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Hashes()
        for f in frames:
            yield pd.DataFrame({"rep": f.rep, "set": [shingles(t, words, memo).tobytes() for t in f.text]})
            release()

    texts = documents.select(F.col("doc_id").alias("rep"), "text").join(needed, "rep", "left_semi")
    sets = texts.mapInPandas(make, "rep long, set binary").dropDuplicates(["rep"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, index, ids, held = None, None, [], []
        for f in frames:
            found = []
            for g, k, s, kind, rep, comp, packed in zip(f.g, f.k, f.s, f.kind, f.rep, f.comp, f.set):
                if (g, k, s) != block:
                    block, index, ids, held = (g, k, s), None, [], []
                own = np.frombuffer(packed, np.uint64)
                if kind == 0:
                    ids.append((rep, comp))
                    held.append(own)
                else:
                    index = index or Index(ids, held)
                    found += [(rep, b) for b in index.search(own, comp, percent)]
            yield pd.DataFrame(found, columns=["a", "b"])
        index, held = None, []
        release()

    dealt = rows.join(sets, "rep").repartition(F.xxhash64("g", "k", "s")).sortWithinPartitions("g", "k", "s", "kind", "rep")
    return dealt.mapInPandas(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """rep, comp (the smallest id reachable) for the ends of links (a, b): smallest neighbour label, then pointer jumping, till nothing moves."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "jaccard-links")
    labels = written(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("m")).select("rep", F.least("rep", "m").alias("comp")), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "rep").select("rep", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        roots = labels.select(F.col("rep").alias("comp"), F.col("comp").alias("root"))
        jumped = written(step.join(roots, "comp").select("rep", "was", F.least("comp", "root").alias("comp")), "jaccard-labels")
        moved = jumped.where("comp <> was").limit(1).count()
        labels = jumped.select("rep", "comp")
        if not moved:
            return labels


def shared_lists(posted: DataFrame, percent: int) -> DataFrame:
    """posted without lists of one member, and then without documents in too few lists to reach the threshold with any other."""
    shared = posted.join(posted.groupBy("tok").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "tok")
    lists = shared.groupBy("rep").agg(F.count(F.lit(1)).alias("lists"), F.first("n").alias("size"))
    able = lists.where(F.col("lists") >= enough(F.ceil(F.lit(percent) * F.col("size") / 100), percent)).select("rep")
    return shared.join(able, "rep")


def link_components(documents: DataFrame, words: int, percent: int, same: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sig) of all rows, and (sig, component_id) of all sets. same: (doc_id, of), rows that belong together by name."""
    total = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    found = written(unpacked(packed(documents, words, percent, buckets), buckets), "jaccard-tokens")
    tokens = found.where("n is not null").select("doc_id", "n", "sig")
    reps = written(tokens.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "jaccard-reps")
    some = F.broadcast(reps) if reps.count() <= MAX_BROADCAST_IDS else reps
    posted = found.where("tok is not null").select(F.col("doc_id").alias("rep"), "tok").join(some.select("rep", "n"), "rep")
    posted = shared_lists(written(shared_lists(posted, percent), "jaccard-lists"), percent)
    posted = written(posted.join(posted.groupBy("tok").agg(F.count(F.lit(1)).alias("size")), "tok"), "jaccard-lists")

    links = documents.sparkSession.createDataFrame([], "a long, b long")
    labels = posted.select("rep", F.col("rep").alias("comp")).distinct()
    near = F.lit(percent) * F.col("n_a") <= F.lit(100) * F.col("n_b")
    near = near & (F.lit(percent) * F.col("n_b") <= F.lit(100) * F.col("n_a"))
    for r in range(ROUNDS):
        # the candidate of a list: in each band of sizes, one document, another one in each round
        band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100))
        first = F.struct(F.col("comp") if r == 0 else F.xxhash64("comp", F.lit(r)), "rep")
        placed = posted.join(labels, "rep").withColumn("band", band)
        stars = placed.groupBy("tok", "band").agg(F.min_by(F.struct("rep", "n", "comp"), first).alias("star"))
        chosen = placed.join(stars, ["tok", "band"])
        pairs = chosen.where("star.comp <> comp").select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("star.rep").alias("b"), F.col("star.n").alias("n_b")).where(near)
        best = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= 2).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        best = written(best.select(F.col("b").alias("g"), F.lit(0).alias("k"), "a", "b"), "jaccard-best")
        links = written(links.unionByName(searched(best, best.select("g", "k", "b").distinct(), labels, documents, words, percent)), "jaccard-found")
        labels = written(merged_labels(posted, links), "jaccard-comps")

    # lists that still hold several components: each document searches the blocks that hold documents of larger ones.
    # A large component has blocks of its own; the others are grouped by the longest list that a document is in.
    held = posted.join(labels, "rep")
    mixed = held.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok")
    totals = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("total"))
    held = held.join(mixed, "tok").join(totals, "comp")
    group = F.when(F.max("total") >= BLOCK // 8, F.max("comp")).otherwise(F.max_by("tok", F.struct("size", "tok")))
    grouped = written(held.groupBy("rep").agg(group.alias("g")), "jaccard-groups")
    members = grouped.join(grouped.groupBy("g").agg(F.count(F.lit(1)).alias("g_total")), "g")
    members = members.select("g", F.pmod(F.xxhash64("rep"), F.ceil(F.col("g_total") / BLOCK)).cast("int").alias("k"), F.col("rep").alias("b"))
    held = written(held.join(members.withColumnRenamed("b", "rep"), "rep"), "jaccard-mixed")
    blocks = held.groupBy("tok", "g", "k").agg(F.max(F.struct("total", "comp")).alias("top"))
    met = held.drop("g", "k").join(blocks, "tok").where(F.struct("total", "comp") < F.col("top")).groupBy("rep", "n", "g", "k").agg(F.count(F.lit(1)).alias("shared"))
    queries = met.where(F.col("shared") >= enough(F.ceil(F.lit(percent) * F.col("n") / 100), percent)).select("g", "k", F.col("rep").alias("a"))
    links = written(links.unionByName(searched(queries, members, labels, documents, words, percent)), "jaccard-found")
    if same is not None:
        named = same.where("of is not null").join(tokens, "doc_id").join(reps.select("sig", "rep"), "sig").select("of", "rep").distinct()
        least = named.groupBy("of").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        links = links.unionByName(named.join(least, "of").where("rep <> b").select(F.col("rep").alias("a"), "b"))
    joined = components(links)
    known = reps.select("sig", "rep").join(joined, "rep", "left").select("sig", F.coalesce("comp", "rep").alias("component_id"))
    return tokens.select("doc_id", "n", "sig"), known


def merged_labels(posted: DataFrame, links: DataFrame) -> DataFrame:
    """rep, comp of all posted documents, as the links so far join them."""
    return posted.select("rep").distinct().join(components(links), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))


def jaccard_components(documents: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A text without words has an empty
    set and is linked with nothing. Rows that repeat a doc_id are rows of one document: each keeps its own set, and all are in the
    component that any of them reaches. A row with a null doc_id links like any other, but doesn't name a component: that is
    null where no row of it has an id. A shingle's occurrences in prefixes meet in one task, about 10 bytes for
    each document that has it.
    """
    unclear = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not unclear:
        tokens, known = link_components(documents, words, percent)
        return tokens.join(known, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    # rows get numbers of their own, and a component the smallest doc_id of its rows
    rows = written(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "jaccard-numbered")
    named = rows.select("row", "doc_id")
    tokens, known = link_components(rows.select(F.col("row").alias("doc_id"), "text"), words, percent, named.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("of")))
    rooted = tokens.join(known, "sig", "left").select(F.col("doc_id").alias("row"), "n", F.coalesce("component_id", "doc_id").alias("root")).join(named, "row")
    found = rooted.join(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    least = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"))
    return found.join(least, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "component_id").alias("component_id"))


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id. Rows with a null doc_id stay."""
    dropped = written(jaccard_components(documents, words, percent).where("component_id <> doc_id").select("doc_id"), "jaccard-dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= MAX_BROADCAST_IDS else dropped
    return documents.join(dropped, "doc_id", "left_anti").select(*documents.columns)


def op8_jaccard_divideskip(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
