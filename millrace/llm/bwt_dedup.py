"""Exact substring dedup by column-wise construction of a sorted suffix order with common prefixes.

A byte is removed if it lies in a 50-byte string that also starts in a document with a smaller id.

Equal 50-byte windows have the same minimizer (the 16-byte string of smallest hash in them) at the same place, so a document
is cut into segments, each with the windows of one minimizer. Minimizers that only one document has are set aside
first, by packed (minimizer, document) pairs. The other segments go to buckets by minimizer, aligned on it.

In a bucket the order of all suffixes is built column by column, from the right: each round inserts one symbol for
each segment, by a stable distribution of the previous order (the step that updates the collection's Burrows-Wheeler
transform), and updates the longest common prefixes of neighbours from the minima of the previous column's. The columns
are written to a sequential file and read back one by one, so only the order and the prefixes stay in memory.
Neighbours with a common prefix of 50 are equal windows; the smallest document of each run of them decides.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

LENGTH, K = 50, 16
#: Columns left of the minimizer in which a window can start, and all columns of a segment.
LEFT = LENGTH - K
WIDTH = LEFT + LENGTH
#: Bytes that are hashed at a time, input bytes of a bucket of documents or minimizers, pairs that are packed at a time.
STEP_BYTES, BUCKET_BYTES, PACK_PAIRS = 1 << 20, 16 << 20, 1 << 20
#: Segments that are laid out in columns at a time.
ROWS = 1 << 14
NO_ID = np.iinfo(np.int64).max
#: Ids are hashed by a product modulo a prime; all stays below 2**62.
PRIME, SPREAD = (1 << 31) - 1, 1_640_531_527


def segments(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each run of windows with one minimizer: text, hash of the minimizer, its place, first and last window start."""
    lengths = np.array([len(r) for r in raw], np.int64)
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    n = len(b) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, span = b + np.uint64(1), 1
    for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
        h = h[:-span] * np.uint64(c) + h[span:]
        span *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= LEFT + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = LEFT + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(raw)), lengths)[:n]
    valid = np.arange(n) + LENGTH <= ends[owner]
    starts = np.flatnonzero(valid)
    at, owner = at[starts], owner[starts]
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])) if len(starts) else starts
    last = np.concatenate([cut[1:], [len(starts)]]) - 1 if len(starts) else cut
    text, base = owner[cut], (ends - lengths)[owner[cut]]
    return text, h[at[cut]], at[cut] - base, starts[cut] - base, starts[last] - base


def steps(rows) -> Iterator[list]:
    """Lists of (id, variant, bytes) rows of about STEP_BYTES; only rows that hold a window."""
    out, size = [], 0
    for row in rows:
        if len(row[2]) < LENGTH:
            continue
        if out and size + len(row[2]) > STEP_BYTES:
            yield out
            out, size = [], 0
        out.append(row)
        size += len(row[2])
    if out:
        yield out


def ids_of(column: pd.Series) -> list[int]:
    return [NO_ID if pd.isna(i) else int(i) for i in column]


def split(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and the bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def pack_pairs(documents: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, of, keys): distinct (minimizer, document) pairs. keys: 5 bytes of the hash; of: places in ids."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> pd.DataFrame:
            h, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, bounds = split((h % np.uint64(buckets)).astype(np.int64), buckets)
            rows = []
            for k in np.flatnonzero(np.diff(bounds)):
                own = order[bounds[k] : bounds[k + 1]]
                own = own[np.lexsort((doc[own], h[own]))]
                keys, docs = h[own] >> np.uint64(24), doc[own]
                new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])
                ids, of = np.unique(docs[new], return_inverse=True)
                five = keys[new].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                rows.append((k, ids.tobytes(), of.astype(np.uint32).tobytes(), np.ascontiguousarray(five.T).tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "ids", "of", "keys"])

        for f in frames:
            for part in steps((i, 0, (t or "").encode()) for i, t in zip(ids_of(f.doc_id), f.text)):
                text, h, *_ = segments([r[2] for r in part])
                held.append((h, np.array([r[0] for r in part], np.int64)[text]))
                size += len(h)
                if size >= PACK_PAIRS:
                    yield emit()
                    size = 0
        if size:
            yield emit()

    return documents.select("doc_id", "text").mapInPandas(run, "bucket int, ids binary, of binary, keys binary")


def place_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of documents that an id belongs to. The id is hashed, so ids with a common stride spread as well."""
    return np.mod(np.mod(np.mod(ids, PRIME) * SPREAD, PRIME), buckets)


def place(doc_id: str, buckets: int) -> Column:
    """place_of as an expression."""
    i = F.coalesce(F.col(doc_id), F.lit(int(NO_ID)))
    return F.pmod(F.pmod(F.pmod(i, F.lit(PRIME)) * F.lit(SPREAD), F.lit(PRIME)), F.lit(buckets)).cast("int")


def shared_minimizers(pairs: DataFrame, doc_buckets: int) -> DataFrame:
    """(q, ids, keys): the pairs whose minimizer occurs in several documents, by bucket of documents."""

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        keys, docs = [], []
        for ids, of, five in zip(blobs.ids, blobs.of, blobs["keys"]):
            of = np.frombuffer(of, np.uint32)
            wide = np.zeros((len(of), 8), np.uint8)
            wide[:, :5] = np.frombuffer(five, np.uint8).reshape(5, -1).T
            keys.append(wide.view("<u8").ravel())
            docs.append(np.frombuffer(ids, np.int64)[of])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(key)]])))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        live = several[group]
        key, doc = key[live], doc[live]
        rows = []
        order, bounds = split(place_of(doc, doc_buckets), doc_buckets)
        for q in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[q] : bounds[q + 1]]
            rows.append((q, doc[own].tobytes(), key[own].tobytes()))
        return pd.DataFrame(rows, columns=["q", "ids", "keys"])

    return pairs.groupBy("bucket").applyInPandas(run, "q int, ids binary, keys binary")


def variants(f: pd.DataFrame) -> list[tuple[int, int, bytes]]:
    """(id, variant, bytes) of each row: rows with one id and different texts are told apart by the order of their texts."""
    rows = [(i, (t or "").encode()) for i, t in zip(ids_of(f.doc_id), f.text)]
    texts: dict[int, set[bytes]] = {}
    for i, raw in rows:
        texts.setdefault(i, set()).add(raw)
    ranks = {i: {raw: k for k, raw in enumerate(sorted(s))} for i, s in texts.items() if len(s) > 1}
    return [(i, ranks[i][raw] if i in ranks else 0, raw) for i, raw in rows]


def whole_copies(rows: DataFrame) -> DataFrame:
    """(q, copy, digest, least) of the rows whose whole text a smaller document has (least); they need no comparison."""
    texts = rows.where(F.octet_length("text") >= LENGTH).select("q", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("copy"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    least = texts.groupBy("digest").agg(F.min("copy").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return texts.join(least, "digest").where(F.col("copy") > F.col("least")).select("q", "copy", "digest", "least")


def copies_in(found: pd.DataFrame) -> tuple[pd.DataFrame, set[tuple[int, bytes]]]:
    """The packed rows of a bucket, and the (id, digest) of its copies."""
    plain = found["copy"].isna()
    marked = found[~plain]
    return found[plain], {(int(c), bytes(d)) for c, d in zip(marked["copy"], marked.digest)}


def pack_segments(documents: DataFrame, shared: DataFrame, buckets: int) -> DataFrame:
    """(bucket, ids, variants, at, left, length, data): the segments of shared minimizers, of documents that aren't copies."""

    def run(texts: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
        out = []
        live, copies = copies_in(live)
        if len(live) and len(texts):
            ids = np.concatenate([np.frombuffer(x, np.int64) for x in live.ids])
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in live["keys"]])
            mixed = np.sort(mix(ids, keys))
            parts = []
            for rows in steps(r for r in dict.fromkeys(variants(texts)) if (r[0], hashlib.md5(r[2]).digest()) not in copies):
                text, h, at, lo, hi = segments([r[2] for r in rows])
                doc = np.array([r[0] for r in rows], np.int64)[text]
                want = mix(doc, h >> np.uint64(24))
                place = np.minimum(np.searchsorted(mixed, want), len(mixed) - 1)
                own = np.flatnonzero(mixed[place] == want)
                raw = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
                base = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])])[text[own]]
                length = hi[own] - lo[own] + LENGTH
                data = raw[np.repeat(base + lo[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())]
                variant = np.array([r[1] for r in rows], np.int32)[text[own]]
                parts.append((h[own], doc[own], variant, at[own].astype(np.int32), (at[own] - lo[own]).astype(np.uint8), length.astype(np.uint8), data))
            if parts:
                h, doc, variant, at, left, length, data = (np.concatenate(x) for x in zip(*parts))
                ends = np.cumsum(length, dtype=np.int64)
                order, bounds = split((h % np.uint64(buckets)).astype(np.int64), buckets)
                for k in np.flatnonzero(np.diff(bounds)):
                    own = order[bounds[k] : bounds[k + 1]]
                    n = length[own].astype(np.int64)
                    picked = data[np.repeat(ends[own] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    out.append((k, *(x[own].tobytes() for x in (doc, variant, at, left, length)), picked.tobytes()))
        return pd.DataFrame(out, columns=["bucket", "ids", "variants", "at", "left", "length", "data"])

    return documents.groupBy("q").cogroup(shared.groupBy("q")).applyInPandas(run, "bucket int, ids binary, variants binary, at binary, left binary, length binary, data binary")


def mix(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for an (id, key) pair. A chance collision only lets a segment through that finds no equal."""
    out = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (keys * np.uint64(0xC2B2AE3D27D4EB4F))
    return out ^ (out >> np.uint64(31))


def repeated_windows(doc: np.ndarray, left: np.ndarray, length: np.ndarray, data: np.ndarray) -> np.ndarray:
    """(segments, LEFT + 1) booleans: the window that starts so many columns from the left also starts in a smaller document."""
    m = len(doc)
    first = LEFT - left.astype(np.int64)
    size = length.astype(np.int64)
    out = np.zeros((m, LEFT + 1), bool)
    with tempfile.TemporaryFile() as file:
        symbols, ends = np.zeros((m, WIDTH), np.uint8), np.cumsum(size)
        for a in range(0, m, ROWS):
            n = size[a : a + ROWS]
            begin = ends[a] - n[0]
            flat = np.repeat(np.arange(len(n)) * WIDTH + first[a : a + ROWS] - (ends[a : a + ROWS] - n - begin), n) + np.arange(n.sum())
            symbols[a : a + ROWS].reshape(-1)[flat] = data[begin : begin + n.sum()]
        for c in range(WIDTH - 1, -1, -1):
            file.write(symbols[:, c].tobytes())
        del symbols
        file.seek(0)
        order = np.arange(m)
        common = np.zeros(m + 1, np.uint8)
        for c in range(WIDTH - 1, -1, -1):
            symbol = np.frombuffer(file.read(m), np.uint8)[order]
            inside = ((first <= c) & (c < first + size))[order]
            moved = np.argsort(symbol, kind="stable")
            least = np.minimum.reduceat(common, moved + 1)
            symbol, inside, order = symbol[moved], inside[moved], order[moved]
            common = np.zeros(m + 1, np.uint8)
            same = (symbol[1:] == symbol[:-1]) & inside[1:] & inside[:-1]
            common[1:m] = np.where(same, np.minimum(least[:-1], LENGTH - 1) + 1, 0)
            if c <= LEFT:
                begin = np.flatnonzero(common[:m] < LENGTH)
                smallest = np.minimum.reduceat(doc[order], begin)
                runs = np.diff(np.concatenate([begin, [m]]))
                out[order, c] = np.repeat(smallest, runs) < doc[order]
    return out


def repeated_spans(packed: DataFrame, doc_buckets: int) -> DataFrame:
    """(q, ids, variants, starts, ends): runs of bytes to remove."""

    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        doc, variant, at, left, length, data = (
            np.concatenate([np.frombuffer(x, kind) for x in blobs[name]])
            for name, kind in (("ids", np.int64), ("variants", np.int32), ("at", np.int32), ("left", np.uint8), ("length", np.uint8), ("data", np.uint8))
        )
        at = at.astype(np.int64)
        hit = repeated_windows(doc, left, length, data)
        edge = np.zeros((len(doc), LEFT + 3), np.int8)
        edge[:, 1:-1] = hit
        change = np.diff(edge, axis=1)
        row, begin = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        starts, ends = at[row] - LEFT + begin, at[row] - LEFT + end - 1 + LENGTH
        ids, rows = doc[row], []
        order, bounds = split(place_of(ids, doc_buckets), doc_buckets)
        for q in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[q] : bounds[q + 1]]
            rows.append((q, *(x[own].tobytes() for x in (ids, variant[row], starts, ends))))
        return pd.DataFrame(rows, columns=["q", "ids", "variants", "starts", "ends"])

    return packed.groupBy("bucket").applyInPandas(run, "q int, ids binary, variants binary, starts binary, ends binary")


def kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside all spans, and the number of maximal removed runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    begin, stop = starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])]
    keep = np.concatenate([[0], stop]), np.concatenate([begin, [len(raw)]])
    return b"".join(raw[a:b] for a, b in zip(*keep)), len(begin)


def remove_repeats(documents: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row; with texts, also ``kept`` (binary).

    A null text counts as empty; texts below 50 bytes stay whole. A null id counts as larger than all others. Rows with
    one id aren't smaller than each other, so they never remove each other's bytes. A seed's occurrences meet in
    one task, 16 bytes for each document that has it, and about 70 bytes for each of its segments.
    """
    total = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    rows = documents.select("doc_id", "text", place("doc_id", buckets).alias("q"))
    copies = whole_copies(rows).drop("least")
    shared = shared_minimizers(pack_pairs(documents, buckets), buckets).unionByName(copies, allowMissingColumns=True)
    # one plan, so that the texts are dealt to buckets once and read twice
    spans = repeated_spans(pack_segments(rows, shared, buckets), buckets).unionByName(copies, allowMissingColumns=True)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")

    def run(texts_of: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        where: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        found, gone = copies_in(found)
        if len(found):
            ids, variant, starts, ends = (np.concatenate([np.frombuffer(x, np.int32 if n == "variants" else np.int64) for x in found[n]]) for n in ("ids", "variants", "starts", "ends"))
            order = np.lexsort((variant, ids))
            ids, variant, starts, ends = ids[order], variant[order], starts[order], ends[order]
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (variant[1:] != variant[:-1]), [True]]))
            where = {(int(ids[a]), int(variant[a])): (starts[a:b], ends[a:b]) for a, b in zip(cut, cut[1:])}
        out = []
        for i, v, raw in variants(texts_of):
            if (i, hashlib.md5(raw).digest()) in gone:
                left, n = b"", 1
            else:
                left, n = kept(raw, *where[i, v]) if (i, v) in where else (raw, 0)
            row = (None if i == NO_ID else i, len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest())
            out.append((*row, left) if texts else row)
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    return rows.groupBy("q").cogroup(spans.groupBy("q")).applyInPandas(run, schema)


def op5_suffix_dedup_bwt(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
