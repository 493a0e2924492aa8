"""Benchmark decontamination by spaced-seed hashing.

A mask selects some of the tokens in a window and ignores the others, so a substitution at an ignored place does no harm.
Every window of the benchmark items and of the documents is hashed under each mask; equal hashes are hits. A hit fixes how
the item lies over the document. A document is contaminated by an item if any stretch there is long enough and mostly equal:
the best-scoring one (match 1, substitution -2) is the overlap or, if that fails the thresholds, the longest that is mostly equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table

TOKEN = re.compile(r"[^\W_]+")
#: Fixed masks of weight 6 and 8; every stretch of 13 tokens or more with 80 % equal ones has a window that one of them accepts.
MASKS = ("111111", "1101100101", "1010011011", "110010111", "1110001011", "11011010111")
#: Tokens of a reported overlap, at least (or the whole item, if shorter), and the share of them that are equal.
LEAST_TOKENS, LEAST_EQUAL, MISMATCH = 13, 0.8, 2
#: Equal tokens that one substitution needs at that share.
AGAINST = 4
#: Benchmark tokens that one pass over the documents holds in memory; a larger benchmark takes more passes.
BLOCK_TOKENS = 2_000_000
#: Characters of documents that are hashed together.
STEP_CHARS = 1 << 19


def _constants(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the window at each place where one fits."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, c in enumerate(_constants(len(mask))):
        if mask[i] == "1":
            out += ids[i : i + n] * c
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


class Benchmark:
    """The items' windows. Tokens that no item has share the number 0, which no item window contains.

    For each mask: a bitmap of the windows' hashes, the hashes in order, and each one's item and place; 16 bytes a window.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item, text in items:
            tokens = TOKEN.findall((text or "").lower())
            if tokens:
                self.items.append((item, np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.uint64)))
        sizes = np.array([len(ids) for _, ids in self.items], np.int64)
        ids = np.concatenate([ids for _, ids in self.items]) if self.items else np.zeros(0, np.uint64)
        owner, ends = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), np.cumsum(sizes)
        short = set(sizes[sizes < min(map(len, MASKS))].tolist())
        self.masks = [*MASKS, *("1" * n for n in sorted(short))]
        self.shift = 64 - max(16, int(len(ids)).bit_length() + 4)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for mask in self.masks:
            h = hashes(ids, mask)
            item = owner[: len(h)]
            inside = np.arange(len(h)) + len(mask) <= ends[item]
            if mask not in MASKS:
                inside &= sizes[item] == len(mask)
            at = np.flatnonzero(inside)
            order = at[np.argsort(h[at], kind="stable")]
            bits = np.zeros(1 << (64 - self.shift - 3), np.uint8)
            cell = h[order] >> np.uint64(self.shift)
            np.bitwise_or.at(bits, (cell >> np.uint64(3)).astype(np.int64), np.uint8(1) << (cell & np.uint64(7)).astype(np.uint8))
            self.tables.append((bits, h[order], owner[order], (order - (ends - sizes)[owner[order]]).astype(np.int32)))

    def hits(self, h: np.ndarray, table) -> Iterator[tuple[int, int, int]]:
        """(place, item, place in the item) of each hash that an item has."""
        bits, keys, item, at = table
        cell = h >> np.uint64(self.shift)
        maybe = np.flatnonzero(bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        left, right = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
        for p, a, b in zip(maybe.tolist(), left.tolist(), right.tolist()):
            for i in range(a, b):
                yield p, int(item[i]), int(at[i])

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(place of the text, item, first token in the text, first in the item, tokens, equal tokens); the best for each text and item.

        Texts are searched together up to STEP_CHARS, so memory doesn't depend on how many there are.
        """
        out, part, size, begin = [], [], 0, 0
        for i, text in enumerate(texts):
            part.append(text)
            size += len(text or "")
            if size >= STEP_CHARS or i + 1 == len(texts):
                out += [(t + begin, *rest) for t, *rest in self._search(part)]
                part, size, begin = [], 0, i + 1
        return out

    def _search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        get, parts, lengths = self.vocabulary.get, [], []
        for text in texts:
            tokens = TOKEN.findall((text or "").lower())
            parts.append(np.array([get(t, 0) for t in tokens], np.uint64))
            lengths.append(len(tokens))
        if not parts:
            return []
        ids = np.concatenate(parts)
        ends = np.cumsum(lengths)
        done: set[tuple[int, int, int]] = set()
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for mask, table in zip(self.masks, self.tables):
            for p, k, at in self.hits(hashes(ids, mask), table):
                t = int(np.searchsorted(ends, p, side="right"))
                key = (t, k, p - at)
                if key in done:
                    continue
                done.add(key)
                begin = int(ends[t]) - lengths[t]
                found = self._stretch(ids, begin, int(ends[t]), k, p - at, at, len(mask))
                if found and found[3] > best.get((t, k), (0, 0, 0, 0))[3]:
                    best[t, k] = found
        named: dict[tuple[int, int | None], tuple[int, int, int, int]] = {}
        for (t, k), v in sorted(best.items()):
            key = (t, self.items[k][0])
            if v[3] > named.get(key, (0, 0, 0, 0))[3]:
                named[key] = v
        return [(*key, *v) for key, v in named.items()]

    def _stretch(self, ids, begin, end, k, shift, at, span):
        """Item k lies over the tokens from ``shift`` on: the best stretch that meets the thresholds, or None."""
        item = self.items[k][1]
        a, b = max(0, begin - shift), min(len(item), end - shift)
        equal = ids[shift + a : shift + b] == item[a:b]
        score = np.where(equal, 1, -MISMATCH)
        total = np.concatenate([[0], np.cumsum(score)])
        low = np.minimum.accumulate(total)
        stop = int(np.argmax(total - low))
        start = int(np.flatnonzero(total[: stop + 1] == low[stop])[-1])
        n, same = stop - start, int(equal[start:stop].sum())
        if n < min(LEAST_TOKENS, len(item)) or same < LEAST_EQUAL * n:
            # the longest stretch whose share is met: its total of (equal ? 1 : -4) is 0 or more
            total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -AGAINST))])
            starts = np.searchsorted(-np.minimum.accumulate(total), -total)
            stop = int(np.argmax(np.arange(len(total)) - starts))
            start = int(starts[stop])
            n, same = stop - start, int(equal[start:stop].sum())
            if n < min(LEAST_TOKENS, len(item)):
                return None
        return shift + a + start - begin, a + start, n, same


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows, in blocks of about BLOCK_TOKENS tokens; rows without text are left out. Rows of one item_id share a block
    unless they alone are beyond that size."""
    rows, size, own = [], 0, 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(r.text) // 2 + 1
        if rows and size + n > BLOCK_TOKENS and (r.item_id != rows[-1][0] or own + n > BLOCK_TOKENS):
            yield rows
            rows, size = [], 0
        own = n + (own if rows and r.item_id == rows[-1][0] else 0)
        rows.append((r.item_id, r.text))
        size += n
    if rows:
        yield rows


def contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document and item that overlap: key, item_id, doc_start, item_start, n_tokens, n_equal (token places).

    A null or empty text overlaps with nothing; neither does an item without tokens. Items of fewer than 13 tokens must
    occur whole. Rows with one key are searched one by one. An item_id that repeats, a null one too, is
    reported once, for the text with most equal tokens; only where an item_id's texts exceed a whole block, once for each block.
    """
    kind = dict(documents.dtypes)[key]
    schema = f"`{key}` {kind}, item_id long, doc_start long, item_start long, n_tokens long, n_equal long"
    out = documents.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark):

        def search(frames: Iterator[pd.DataFrame], items=items) -> Iterator[pd.DataFrame]:
            held = Benchmark(items)
            for f in frames:
                found = [(f[key].iloc[t], *rest) for t, *rest in held.search(list(f.text))]
                yield pd.DataFrame(found, columns=[key, "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

        out = out.unionByName(documents.select(key, "text").mapInPandas(search, schema))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without the contaminated rows. Decided row by row, so repeated or null ids do no harm."""
    rows = documents
    for items in blocks(benchmark):
        rows = rows.where(_cleaner(items)("text"))
    return rows


def _cleaner(items: list[tuple[int, str]]):
    held: list[Benchmark] = []

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(Benchmark(items))
        out = np.ones(len(texts), bool)
        out[[r[0] for r in held[0].search(list(texts))]] = False
        release()
        return pd.Series(out)

    return clean


def op9_decontaminate_spaced_seeds(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
