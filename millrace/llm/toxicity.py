"""Toxicity: Levenshtein automata over a lexicon trie, with context windows for quotation.

The lexicon is learned from labelled documents: words whose documents are toxic far more often than chance allows.
Documents that are copies of each other count as about one (inverse Simpson index over their minimum shingle hash),
so the rare words of a copied document don't enter. Each term is a path in a trie. For a token, the Levenshtein
automaton and the trie are walked together; the states met (sets of trie node and edits used) are kept as a
deterministic automaton that grows as texts need it, so most tokens end after a few characters.

A hit counts less if it is quoted: inside quotation marks or shortly after a verb of reporting. A logistic model of the
hits and their density, fitted on the training fold, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, table, training_sample, written

MODULUS, HELD_OUT, THRESHOLD, BOUND = 3, 1, 0.7, 20_000
#: Least log-likelihood ratio (nats) of a term, fewest effective toxic documents.
LEAST_LLR, LEAST_DOCS = 12.0, 4.0
WINDOW = 6
#: States of the automaton that are held before it is started anew.
MOST_STATES = 200_000
TOKEN = re.compile(r"[^\W_]+")
QUOTES = re.compile(r"[\"“”«»„]")
#: Verbs of reporting, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes quoted called quote sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())


def edits(term: str) -> int:
    """Edits that a misspelling may have: short words allow none, as chance words are too near."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """A lexicon trie and the automaton of all words within each term's edits; match(token) gives 0 (no), 1 (fuzzy), 2 (exact).

    terms: each with the edits it allows. ordinary: tokens that are no misspellings, though near to a term.
    """

    def __init__(self, terms: dict[str, int], ordinary=()) -> None:
        self.terms, self.ordinary = dict(terms), frozenset(ordinary)
        self.ends: dict[int, str] = {}
        self.children: list[dict[str, int]] = [{}]
        self.allowed: list[int] = [-1]  # edits of the term that ends here
        self.most: list[int] = [0]  # the largest allowance below
        for term in sorted(self.terms):
            node = 0
            self.most[0] = max(self.most[0], terms[term])
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], terms[term])
            self.allowed[node], self.ends[node] = terms[term], term
        self.forget()

    def forget(self) -> None:
        """Start the automaton anew; it grows again as texts need it."""
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[list[str]] = []
        self.start = self._id({(0, 0)})

    def _id(self, items: set[tuple[int, int]]) -> int:
        """The number of the state with these (node, edits), after deletions; -1 if none is left."""
        todo, best = sorted(items), {}
        while todo:
            node, used = todo.pop()
            if used > self.most[node] or best.get(node, 9) <= used:
                continue
            best[node] = used
            todo += [(child, used + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.accepts.append([self.ends[node] for node, used in key if used <= self.allowed[node]])
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        items = set()
        for node, used in self.states[state]:
            items.add((node, used + 1))
            for letter, child in self.children[node].items():
                items.add((child, used if letter == c else used + 1))
        found = self.next[state][c] = self._id(items)
        return found

    def near(self, token: str) -> list[str]:
        """The terms that the token may be a misspelling of."""
        if len(self.states) > MOST_STATES:
            self.forget()
        state, tables = self.start, self.next
        for c in token if state >= 0 else "":
            following = tables[state].get(c)
            state = self._step(state, c) if following is None else following
            if state < 0:
                break
        return self.accepts[state] if state >= 0 else []

    def match(self, token: str) -> int:
        return 2 if token in self.terms else int(token not in self.ordinary and bool(self.near(token)))


def hits(text: str | None, lexicon: FuzzyLexicon, memo: dict[str, int]) -> tuple[float, float, float, int]:
    """(exact, fuzzy, quoted, tokens) of a whole text; quoted hits are in neither of the first two."""
    tokens = TOKEN.findall((text or "").lower())
    exact = fuzzy = quoted = 0
    found = []
    for i, token in enumerate(tokens):
        kind = memo.get(token)
        if kind is None:
            if len(memo) > 500_000:
                memo.clear()
            kind = memo[token] = lexicon.match(token)
        if kind:
            found.append((i, kind))
    if found:
        within = quoted_tokens(text.lower())
        for i, kind in found:
            if i in within or REPORTING.intersection(tokens[max(0, i - WINDOW) : i]):
                quoted += 1
            elif kind == 2:
                exact += 1
            else:
                fuzzy += 1
    return exact, fuzzy, quoted, len(tokens)


def quoted_tokens(text: str) -> set[int]:
    """Places of tokens between a quotation mark and the next, at most 4 windows further on the same line."""
    out: set[int] = set()
    place = 0
    for line in text.split("\n"):
        pieces = QUOTES.split(line)
        for k, piece in enumerate(pieces):
            n = len(TOKEN.findall(piece))
            if k % 2 and k < len(pieces) - 1 and n <= 4 * WINDOW:
                out.update(range(place, place + n))
            place += n
    return out


def features(exact: float, fuzzy: float, quoted: float, n: int) -> list[float]:
    weight = exact + 0.8 * fuzzy + 0.2 * quoted
    return [1.0, min(weight, 1.0), np.log1p(weight), min(1.0, 20 * weight / (n + 20)), float(exact > 0), min(quoted, 3.0) / 3]


def minimum_hash(words: list[str]) -> int:
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0) >> 1


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Terms from (text, y): all words of the sample are compared, and the driver gets those that pass."""

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = Counter()
        for b in batches:
            for text, y in zip(b.text, b.y):
                words = TOKEN.findall((text or "").lower())
                key = minimum_hash(words) if y else 0
                rows.update((w, y, key) for w in set(words))
        yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["word", "y", "key", "n"])

    counts = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    if not counts.toxic or counts.toxic == counts.n:
        return []
    words = sample.mapInPandas(words_of, "word string, y int, key long, n long").groupBy("word", "y", "key").agg(F.sum("n").alias("n"))
    toxic = lambda c: F.sum(F.when(F.col("y") == 1, c))
    found = words.groupBy("word").agg(toxic(F.col("n")).alias("docs"), (F.pow(toxic(F.col("n")), F.lit(2)) / toxic(F.col("n") * F.col("n"))).alias("eff"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("clean"))
    base = F.lit(counts.toxic / counts.n)
    rate = F.col("docs") / (F.col("docs") + F.col("clean"))
    gain = F.col("rate") * F.log(F.col("rate") / base) + F.when(F.col("rate") < 1, (1 - F.col("rate")) * F.log((1 - F.col("rate")) / (1 - base))).otherwise(0.0)
    passed = found.where(F.col("eff") >= LEAST_DOCS).withColumn("rate", rate).where((F.col("rate") > base) & (F.col("rate") >= 0.6)).where(F.col("eff") / F.col("rate") * gain >= LEAST_LLR)
    return sorted(r.word for r in passed.select("word").collect())


def learn_edits(sample: DataFrame, terms: list[str]) -> FuzzyLexicon:
    """The lexicon with edits: tokens near a term that clean documents use are ordinary."""

    def near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, rows = FuzzyLexicon({t: edits(t) for t in terms}), Counter()
        for b in batches:
            for text, y in zip(b.text, b.y):
                rows.update((w, y) for w in set(TOKEN.findall((text or "").lower())) if lexicon.match(w) == 1)
        yield pd.DataFrame([(w, y, n) for (w, y), n in rows.items()], columns=["word", "y", "n"])

    counted = sample.mapInPandas(near_words, "word string, y int, n long").groupBy("word").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(y = 0, n, 0)")).alias("clean"))
    ordinary = [r.word for r in counted.where("clean > 0 and clean >= toxic").select("word").collect()]
    return FuzzyLexicon({t: edits(t) for t in terms}, ordinary)


def fit(documents: DataFrame, labels: DataFrame, seed: int = 3, bound: int = BOUND) -> tuple[FuzzyLexicon, np.ndarray]:
    """The lexicon and the weights of the logistic model, from at most ``bound`` labelled rows of the training fold."""
    chosen = F.broadcast(training_sample(labels, "toxic", MODULUS, HELD_OUT, bound, seed))
    sample = written(documents.join(chosen, "doc_id").select("text", "y"), "toxicity-sample")
    lexicon = learn_edits(sample, learn_lexicon(sample))
    made = (lexicon.terms, lexicon.ordinary)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, memo = FuzzyLexicon(*made), {}
        for b in batches:
            yield pd.DataFrame([(*hits(t, lexicon, memo), y) for t, y in zip(b.text, b.y)], columns=["exact", "fuzzy", "quoted", "n", "y"])

    rows = sample.mapInPandas(measure, "exact double, fuzzy double, quoted double, n long, y int").collect()
    x = np.array([features(r.exact, r.fuzzy, r.quoted, r.n) for r in rows] + [features(2, 0, 0, 100), features(0, 2, 0, 100), features(0, 0, 1, 100)])
    y = np.array([r.y for r in rows] + [1, 1, 0], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.5 * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), grad)
    return lexicon, w


def scored(documents: DataFrame, lexicon: FuzzyLexicon, weights: np.ndarray) -> DataFrame:
    """documents with ``score`` (double); a column of that name is replaced. A null text scores as an empty one."""
    state: dict = {}
    made = (lexicon.terms, lexicon.ordinary)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not state:
            state.update(lexicon=FuzzyLexicon(*made), memo={})
        x = np.array([features(*hits(t, state["lexicon"], state["memo"])) for t in texts]).reshape(-1, len(weights))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return documents.withColumn("score", score("text"))


def op2_toxicity_levenshtein(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = scored(documents.select("doc_id", "text"), *fit(documents, labels))
    return rows.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
