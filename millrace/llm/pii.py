"""Personal data: overlapping candidate spans, boosted trees on format and context, calibrated thresholds.

Base spans follow fixed patterns and validity rules and always stay. What they cover is masked; several generators for each
kind then propose further spans over the rest (numbers without a country code, addresses with a spelled "at", ...),
which may overlap. Boosted trees score each candidate by its format, checksums and the words before it.

The trees learn from two sources of equal weight. The corpus gives valid base spans as positive examples, and as negative ones
what has the base format but fails its check (card numbers failing Luhn, addresses with parts above 255, ...).
Planted examples, made by rule and read by the same generators, show the forms that no base pattern has, and
their look-alikes: version numbers, ranges of years, order and page numbers. For each kind, the lowest score down to which
held-out examples reach the wished precision, and of whose own examples half are right, is the threshold. Of candidates at or above it that overlap, the best stay.

All rows are handled by DataFrame expressions: no Python runs on the executors. The driver fits the trees from counts of
feature combinations; there are at most as many as the features have values, whatever the input's size.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and the start-of-run guard change no match; they keep long texts linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_LOCAL, _HOST = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_AT, _DOT = r"(?:@|＠|\([Aa][Tt]\)|\[[Aa][Tt]\]|\{[Aa][Tt]\}|<at>)", r"(?:\.|\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\]|\{[Dd][Oo][Tt]\}|\[\.\])"
#: The generators of each kind; those of one kind may overlap as well.
WIDE = {
    "email": (rf"{_LOCAL}\x20?{_AT}\x20?{_HOST}(?:\x20?{_DOT}\x20?{_HOST})++", rf"{_LOCAL}\x20(?:at|AT)\x20{_HOST}(?:\x20(?:dot|DOT)\x20{_HOST})++"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)[0-9]{1,3}){3}(?![0-9])", r"(?<![0-9.,])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9])"),
    "card": (r"(?<![0-9])[0-9]{4}(?:[\x20./·_-]{1,2}[0-9]{4}){2,3}(?:[./·_-]?[0-9]{1,3})?(?![0-9])", r"(?<![0-9])[0-9]{4}[\x20./·_-]{1,2}[0-9]{6}[\x20./·_-]{1,2}[0-9]{4,5}(?![0-9])", r"(?<![0-9])[0-9]{2,6}(?:[./·_-][0-9]{2,6}){2,6}(?![0-9])"),
    "phone": (r"\([0-9]{2,5}\)[\x20-]?[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9])", r"(?<![0-9./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9]|[./,-][0-9])", r"(?<![0-9])00[0-9]{1,3}(?:[\x20./-]?[0-9]{2,4}){2,4}(?![0-9])"),
}
#: What a text must contain for a base pattern or a generator of the kind to be tried, and for any generator.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
MAY = {
    "email": r"[@＠]|[(\[{<][Aa][Tt][)\]}>]|\x20(?:dot|DOT)\x20",
    "ip": r"[0-9](?:\x20?[.,]\x20?|[\[(](?:\.|dot)[\])])[0-9]",
    "card": r"[0-9]{2}[\x20./·_-]{1,2}[0-9]{2}",
    "phone": r"[0-9]{2}(?:\)?[\x20./-]|\))[0-9]{2}|00[0-9]{5}",
}
#: Signs of an address, one of which a text needs; plain searches cost less than a pattern.
SIGNS = ("@", "＠", "at)", "at]", "at}", "at>", "AT)", "AT]", "AT}", " dot ", " DOT ")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|gateway|node|ping)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|account|pay(?:ment)?|amex|charge)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|dial|sms)\b",
}
#: Words before numbers that are none of these kinds.
AGAINST = r"(?i)\b(?:v|version|release|build|section|chapter|article|isbn|issn|order|invoice|ref|sku|part|page|pages|years?|scores?|serial|tracking|model|date)\b"
#: Features of a candidate besides its kind, generator and checks, with the number of values of each.
FEATURES = {"g": 4, "digits": 8, "form": 6, "before": 6, "after": 6, "cue": 2, "against": 2, "varied": 2, "tail": 3, "luhn": 2, "octets": 2}
ROUNDS, DEPTH, RATE, PRECISION, CONTEXT = 32, 3, 0.4, 0.95, 32
#: Matches whose places are added up at a time, neighbours that a span is compared with, rounds of that.
CHUNK, NEAR, SUPPRESS = 256, 32, 3
#: Planted examples of each template, and the character that hides what a base pattern took.
PLANTED, HIDDEN = 24, "\ue000"
OVERLAP = "(o.s < c.e AND c.s < o.e)"
EMPTY = "CAST(array() AS array<struct<s:int,e:int,m:string,b:string,a:string,g:int>>)"


def raw(pattern: str) -> str:
    """The pattern as an SQL literal."""
    return f"r'{pattern}'"


def matches(text: str, pattern: str, g: int = 0) -> str:
    """SQL for the leftmost non-overlapping matches as (s, e, m, b, a, g): code points, end exclusive; the match, the text before it as far
    as the match before, at most CONTEXT characters, and the character after it.

    An aggregate copies what it holds at each step, so it holds numbers only, and adds them up in chunks: many matches stay cheap.
    """
    with_lengths = "named_struct('found', u.found, 'pieces', u.pieces, 'size', zip_with(u.pieces, u.found, (p, m) -> length(p) + coalesce(length(m), 0)))"
    chunk = f"aggregate(slice(v.size, c + 1, {CHUNK}), array(element_at(y, -1)), (z, n) -> concat(z, array(element_at(z, -1) + n)))"
    ends = f"aggregate(sequence(0, size(v.found), {CHUNK}), array(0), (y, c) -> concat(y, slice({chunk}, 2, {CHUNK})))"
    placed = f"named_struct('found', v.found, 'pieces', v.pieces, 'ends', {ends})"
    span = f"named_struct('s', get(w.ends, i) + length(get(w.pieces, i)), 'e', get(w.ends, i + 1), 'm', m, 'b', right(get(w.pieces, i), {CONTEXT}), 'a', left(get(w.pieces, i + 1), 1), 'g', {g})"
    walk = let("v", with_lengths, let("w", placed, f"transform(w.found, (m, i) -> {span})"))
    both = f"named_struct('found', regexp_extract_all({text}, {raw(pattern)}, 0), 'pieces', split({text}, {raw(pattern)}, -1))"
    return let("u", both, f"CASE WHEN size(u.found) > 0 THEN {walk} ELSE {EMPTY} END")


def let(name: str, value: str, result: str) -> str:
    """SQL for the result with the name bound to the value, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {result}), 0)"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn_sum(d: str) -> str:
    """SQL; d: the reversed digits."""
    doubled = f"CAST(substring({d}, j, 1) AS INT) * 2"
    return f"aggregate(sequence(1, length({d})), 0, (t, j) -> t + CASE WHEN j % 2 = 1 THEN CAST(substring({d}, j, 1) AS INT) WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END)"


def octets(parts: str) -> str:
    return f"forall({parts}, p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(substring(ltrim('0', p), 1, 3) AS INT), 0) <= 255)"


def valid(kind: str, m: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        return octets(f"split({m}, r'\\.')")
    n = f"length({digits(m)})"
    if kind == "phone":
        return f"({n} BETWEEN 9 AND 15)"
    return f"(CASE WHEN {n} BETWEEN 12 AND 19 THEN {luhn_sum(f'reverse({digits(m)})')} % 10 = 0 ELSE false END)"


CARD_FORM = r"^(?:[0-9]{12,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-]?[0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5})$"


def look_alike(kind: str, m: str) -> str:
    """Has the base format of the kind, but fails its check: a negative example, unless it might be of another kind."""
    if kind == "email":
        return "false"
    some = {"ip": f"forall(split({m}, r'\\.'), p -> length(p) <= 3)", "card": f"{m} RLIKE {raw(CARD_FORM)}", "phone": "true"}[kind]
    return f"({some} AND NOT {valid(kind, m)})"


def character(c: str) -> str:
    """0 none, 1 blank, 2 letter, 3 digit, 4 hidden, 5 other."""
    return f"(CASE WHEN length({c}) = 0 THEN 0 WHEN {c} RLIKE r'\\s' THEN 1 WHEN {c} RLIKE r'\\p{{L}}' THEN 2 WHEN {c} RLIKE '[0-9]' THEN 3 WHEN {c} = '{HIDDEN}' THEN 4 ELSE 5 END)"


def form(kind: str, m: str) -> str:
    if kind == "email":
        bracket = f"CASE WHEN {m} RLIKE r'(?i)[(\\[{{]dot|\\[\\.\\]' THEN 3 ELSE 2 END"
        return f"(CASE WHEN {m} RLIKE r'\\.\\x20|\\x20\\.' THEN 5 WHEN {m} RLIKE r'\\x20(?:at|AT)\\x20' THEN 4 WHEN {m} RLIKE r'[(\\[{{<][Aa][Tt][)\\]}}>]' THEN {bracket} WHEN {m} RLIKE r'\\x20' THEN 1 ELSE 0 END)"
    inner = f"regexp_replace({m}, '[0-9]', '')"
    return f"(CASE WHEN {inner} RLIKE r'[(\\[]' THEN 1 WHEN {inner} = '' THEN 0 WHEN size(array_distinct(split({inner}, ''))) > 2 THEN 2 WHEN startswith({inner}, ' ') THEN 3 WHEN startswith({inner}, '-') THEN 4 ELSE 5 END)"


def described(kind: str) -> str:
    """Fields for the features of span x of that kind; g is its generator (0: base)."""
    d = digits("x.m")
    n = f"length({d})"
    tail = "regexp_extract(x.m, '([A-Za-z0-9-]+)$', 1)"
    fields = {
        "g": "x.g",
        "digits": f"CASE WHEN {n} < 4 THEN 0 WHEN {n} < 9 THEN 1 WHEN {n} < 10 THEN 2 WHEN {n} < 11 THEN 3 WHEN {n} < 13 THEN 4 WHEN {n} < 16 THEN 5 WHEN {n} < 17 THEN 6 ELSE 7 END",
        "form": form(kind, "x.m"),
        "before": character("right(x.b, 1)"),
        "after": character("x.a"),
        "cue": f"CAST(x.b RLIKE {raw(CUES[kind])} AS INT)",
        "against": f"CAST(x.b RLIKE {raw(AGAINST)} AS INT)",
        "varied": f"CAST(size(array_distinct(split({d}, ''))) > 4 AS INT)",
        "tail": f"CASE WHEN {tail} RLIKE '^[A-Za-z]{{2,4}}$' THEN 1 WHEN {tail} RLIKE '^[0-9]' THEN 2 ELSE 0 END" if kind == "email" else "0",
        "luhn": f"CAST({valid('card', 'x.m')} AS INT)" if kind == "card" else "0",
        "octets": "CAST(" + octets("filter(split(x.m, '[^0-9]+'), p -> p <> '')") + " AS INT)" if kind == "ip" else "0",
    }
    return ", ".join(f"'{name}', {value}" for name, value in fields.items())


def spans_of(k: int, kind: str) -> str:
    """SQL for the labelled spans and the candidates of a kind, with their features."""
    found = [f"filter(all_{kind}, x -> {valid(kind, 'x.m')} OR {look_alike(kind, 'x.m')})", *(f"CASE WHEN rest <> '' AND rest RLIKE {raw(MAY[kind])} THEN {matches('rest', p, g)} ELSE {EMPTY} END" for g, p in enumerate(WIDE[kind], 1))]
    y = f"CASE WHEN x.g > 0 THEN -1 WHEN {valid(kind, 'x.m')} THEN 1 ELSE 0 END"
    return f"transform(concat({', '.join(found)}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'y', {y}, {described(kind)}))"


def hide(text: str, kind: str) -> str:
    """SQL for the text with what the base pattern takes or refuses replaced, character by character."""
    taken = valid(kind, "m") if kind == "phone" else f"({valid(kind, 'm')} OR {look_alike(kind, 'm')})"
    covered = f"transform(regexp_extract_all({text}, {raw(BASE[kind])}, 0), m -> CASE WHEN {taken} THEN repeat('{HIDDEN}', length(m)) ELSE m END)"
    return f"array_join(zip_with(split({text}, {raw(BASE[kind])}, -1), {covered}, (p, m) -> concat(p, coalesce(m, ''))), '')"


def generate(documents: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, kind and y of planted rows, fold, base spans (s, k, e) and others (s, k, e, y, features); y: 1 base span, 0 look-alike, -1 candidate.

    A null text counts as empty; a null or repeated doc_id is carried along, as each row is handled alone.
    """
    extra = [c for c in ("kind", "y") if planted and c in documents.columns]
    rows = documents.selectExpr("doc_id", "coalesce(text, '') AS t", *extra).withColumn("rest", F.col("t"))
    rows = rows.withColumn("num", F.expr("t RLIKE '[0-9]'")).withColumn("address", F.expr(" OR ".join(f"contains(t, '{x}')" for x in SIGNS)))
    spans = []
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"all_{kind}", F.expr(f"CASE WHEN {'address' if kind == 'email' else 'num'} AND t RLIKE {raw(NEEDS[kind])} THEN {matches('t', BASE[kind])} ELSE {EMPTY} END"))
        rows = rows.withColumn("rest", F.expr(f"CASE WHEN size(all_{kind}) > 0 THEN {hide('rest', kind)} ELSE rest END"))
        spans.append(f"transform(filter(all_{kind}, x -> {valid(kind, 'x.m')}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))")
    rows = rows.withColumn("rest", F.expr("CASE WHEN num OR address THEN rest ELSE '' END"))
    every = ", ".join(spans_of(k, kind) for k, kind in enumerate(KINDS))
    return rows.selectExpr("doc_id", *extra, "pmod(crc32(CAST(t AS BINARY)), 4) = 0 AS fold", f"array_sort(concat({', '.join(spans)})) AS base", f"concat({every}) AS wide")


def examples() -> Iterator[tuple[str, int, str]]:
    """(text, kind, y): examples made by rule, PLANTED of each template; kind and y say what a span in the text is."""
    rng = random.Random(7)

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def grouped(d: str, sizes: tuple[int, ...], sep: str) -> str:
        return sep.join(d[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    def card(n: int, right: bool) -> str:
        head = "4" + number(n - 2)
        total = sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(head))))
        return head + str((-total + (0 if right else 3)) % 10)

    def email() -> tuple[str, str, str]:
        return rng.choice(("anna.berg", "j.smith", "info", "sales42", "m_lopez", "contact-us")), rng.choice(("example", "mail7", "city-hall", "uni3")), rng.choice(("com", "org", "de", "fr", "net", "info"))

    intro = {"email": ("write to", "contact", "his address", "and then", "e-mail"), "ip": ("host", "the server", "ip", "and then", "ping"), "card": ("card", "visa", "and then", "pay with", "number"), "phone": ("call", "tel.", "phone", "fax", "mobile")}
    other = ("version", "order", "section", "invoice", "ref", "build", "part", "serial", "isbn", "page", "tracking")
    for _ in range(PLANTED):
        for at, dot in ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("＠", "."), (" @ ", "."), ("[at]", "[.]"), ("{at}", "{dot}"), ("(AT)", "(DOT)")):
            local, host, top = email()
            yield f"{rng.choice(intro['email'])} {local}{at}{host}{dot}{top} ok", 0, 1
        for at, rest in ((" (at) ", ". Then"), (" @ ", ". The"), (" [at] ", ". So"), (" at ", " dot matrix"), (" (at) ", " . Next"), (" @ ", ".30")):
            yield f"{rng.choice(('we', 'look', 'arrived', 'met', 'stop', 'is'))}{at}{rng.choice(('noon', 'home', 'school', 'page', 'work', 'once'))}{rest} ok", 0, 0
        for sep in ("[.]", "(.)", "[dot]", "(dot)", " . "):
            parts = [str(rng.randrange(256)) for _ in range(4)]
            yield f"{rng.choice(intro['ip'])} {sep.join(parts)} ok", 1, 1
            yield f"{rng.choice(intro['ip'])} {sep.join([*parts[:3], '9' + number(2)])} ok", 1, 0
            yield f"{rng.choice(other)} {sep.join(str(rng.randrange(20)) for _ in range(4))} ok", 1, 0
        for sep in (",", ", ", " , "):
            yield f"{rng.choice(('scores', 'the numbers', 'pages', 'values'))} {sep.join(str(rng.randrange(300)) for _ in range(4))} ok", 1, 0
        for sep in "./·_":
            for sizes in ((4, 4, 4, 4), (4, 6, 5)):
                for y in (1, 0):
                    yield f"{rng.choice(intro['card'])} {grouped(card(sum(sizes), bool(y)), sizes, sep)} ok", 2, y
        a, b, c = number(3), number(3), number(4)
        for i, n in enumerate((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a}/{b} {c}", f"00{number(2)} {a} {b} {c}")):
            yield f"{rng.choice(intro['phone'])} {n} ok", 3, 1
            if i in (0, 5):
                yield f"{rng.choice(('me on', 'then', 'under', 'at night'))} {n} ok", 3, 1
            else:
                yield f"{rng.choice(other)} {n} ok", 3, 0
        for sep in "-/. ":
            yield f"{rng.choice(('in', 'since', 'the years'))} {sep.join((f'19{number(2)}', f'19{number(2)}', '2010'))} ok", 3, 0
            yield f"{rng.choice(('on', 'date', 'until'))} {sep.join(('2024', f'{rng.randrange(1, 13):02d}', f'{rng.randrange(1, 29):02d}'))} ok", 3, 0


def planted(spark: SparkSession) -> DataFrame:
    """(doc_id, null; text, kind, y) of the examples, a literal table."""
    rows = ", ".join(f"('{text}', {kind}, {y})" for text, kind, y in examples())
    return spark.sql(f"SELECT CAST(NULL AS LONG) AS doc_id, text, kind, y FROM VALUES {rows} AS t (text, kind, y)")


class Trees:
    """Boosted trees of depth DEPTH for log odds, fitted on counts of feature combinations."""

    def __init__(self, rows: list[tuple[tuple[int, ...], float, float]], names: list[str]) -> None:
        """rows: (feature values, positives, negatives)."""
        self.names, self.trees = names, []
        up, down = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.base = math.log((up + 0.5) / (down + 0.5))
        score = [self.base] * len(rows)
        for _ in range(ROUNDS if up and down else 0):
            p = [1 / (1 + math.exp(-s)) for s in score]
            grad = [a - (a + b) * q for (_, a, b), q in zip(rows, p)]
            hess = [(a + b) * q * (1 - q) for (_, a, b), q in zip(rows, p)]
            tree = self._grow(rows, grad, hess, list(range(len(rows))), DEPTH)
            self.trees.append(tree)
            score = [s + self._leaf(tree, r[0]) for s, r in zip(score, rows)]

    def _grow(self, rows, grad, hess, members, depth):
        g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
        best = (1e-9, None)
        for f in range(len(self.names)) if depth else ():
            by: dict[int, list[float]] = {}
            for i in members:
                s = by.setdefault(rows[i][0][f], [0.0, 0.0])
                s[0], s[1] = s[0] + grad[i], s[1] + hess[i]
            gl, hl = 0.0, 0.0
            for v in sorted(by)[:-1]:
                gl, hl = gl + by[v][0], hl + by[v][1]
                gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                best = max(best, (gain, (f, v)), key=lambda b: b[0])
        if best[1] is None:
            return RATE * g / (h + 1)
        f, v = best[1]
        left = [i for i in members if rows[i][0][f] <= v]
        right = [i for i in members if rows[i][0][f] > v]
        return f, v, self._grow(rows, grad, hess, left, depth - 1), self._grow(rows, grad, hess, right, depth - 1)

    def _leaf(self, tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x) -> float:
        return self.base + sum(self._leaf(t, x) for t in self.trees)

    def sql(self, x: str) -> str:
        """The score of candidate x."""

        def branch(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{float(tree)!r}D"
            f, v, left, right = tree
            return f"CASE WHEN {x}.{self.names[f]} <= {v} THEN {branch(left)} ELSE {branch(right)} END"

        return " + ".join([f"{self.base!r}D", *map(branch, self.trees)])


NAMES = ["k", *FEATURES]


def counted(rows: DataFrame) -> list[tuple[bool, tuple[int, ...], float, float]]:
    """(fold, feature values, positives, negatives) of (fold, c); as many rows as feature combinations."""
    sums = rows.groupBy("fold", *[F.col(f"c.{n}").alias(n) for n in NAMES]).agg(F.sum("c.y").alias("up"), F.count(F.lit(1)).alias("n"))
    return [(r.fold, tuple(r[n] for n in NAMES), float(r.up), float(r.n - r.up)) for r in sums.orderBy("fold", *NAMES).collect()]


def fit(generated: DataFrame) -> tuple[Trees, list[float]]:
    """The trees, and the threshold of each kind, from the corpus's examples and the planted ones; both weigh the same in all."""
    own = counted(generated.where("kind IS NULL").select("fold", F.explode("wide").alias("c")).where("c.y >= 0"))
    found = generated.where("kind IS NOT NULL").select("fold", "kind", "y", F.explode("wide").alias("c")).where("c.y < 0")
    made = counted(found.withColumn("c", F.expr("named_struct('y', CAST(c.k = kind AND y = 1 AS INT), " + ", ".join(f"'{n}', c.{n}" for n in NAMES) + ")")))
    weight = sum(a + b for _, _, a, b in made) / max(1.0, sum(a + b for _, _, a, b in own))
    counts = made + [(fold, x, a * weight, b * weight) for fold, x, a, b in own]
    trees = Trees([(x, a, b) for fold, x, a, b in counts if not fold], NAMES)
    limits = []
    for k in range(len(KINDS)):
        held = sorted(((trees.score(x), a, b) for fold, x, a, b in made if fold and x[0] == k), reverse=True)
        limit, up, n, own, all_own = math.inf, 0.0, 0.0, 0.0, 0.0
        for i, (score, a, b) in enumerate(held):
            up, n = up + a, n + a + b
            last = i + 1 == len(held) or held[i + 1][0] < score
            own, all_own = own + a, all_own + a + b
            if last and up >= PRECISION * n and 2 * own >= all_own:
                limit = score
            if last:
                own, all_own = 0.0, 0.0
        limits.append(limit)
    return trees, limits


def suppressed(spans: str, rows: DataFrame) -> DataFrame:
    """rows with only those of the scored spans, in order of place, that greedy suppression leaves: the best first, then the
    best of what it doesn't overlap. Each span is compared with NEAR neighbours on either side, and after SUPPRESS rounds
    what is still open is dropped, so many spans in a text stay linear."""
    near = f"slice({spans}, greatest(i + 1 - {NEAR}, 1), {2 * NEAR + 1})"
    beats = "(o.score > c.score OR (o.score = c.score AND named_struct('k', o.k, 's', o.s, 'e', -o.e) < named_struct('k', c.k, 's', c.s, 'e', -c.e)))"
    marked = "named_struct('s', c.s, 'k', c.k, 'e', c.e, 'score', c.score, 'state', {})"
    keep = f"transform({spans}, (c, i) -> CASE WHEN c.state = 0 AND NOT exists({near}, o -> o.state = 0 AND {OVERLAP} AND {beats}) THEN {marked.format(1)} ELSE c END)"
    drop = f"transform({spans}, (c, i) -> CASE WHEN c.state = 0 AND exists({near}, o -> o.state = 1 AND {OVERLAP}) THEN {marked.format(2)} ELSE c END)"
    for _ in range(SUPPRESS):
        rows = rows.withColumn(spans, F.expr(keep)).withColumn(spans, F.expr(drop))
    return rows.withColumn(spans, F.expr(f"filter({spans}, c -> c.state = 1)"))


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base and added spans of each row: arrays of (s, k, e), by start and then kind. Added spans overlap no other added one."""
    rows = documents.selectExpr("doc_id", "text", "CAST(NULL AS INT) AS kind", "CAST(NULL AS INT) AS y")
    generated = written(generate(rows.unionByName(planted(documents.sparkSession)), planted=True), "pii-candidates")
    trees, limits = fit(generated)
    generated = generated.where("kind IS NULL")
    enough = " OR ".join(["false", *(f"(c.k = {k} AND c.score >= {value - 1e-9!r}D)" for k, value in enumerate(limits) if value < math.inf)])
    scored = f"transform(filter(wide, x -> x.y = -1), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'score', {trees.sql('x')}, 'state', 0))"
    candidates = generated.selectExpr("doc_id", "base", f"array_sort(array_distinct(filter({scored}, c -> {enough}))) AS new")
    some = suppressed("new", candidates.where("size(new) > 0"))
    added = "transform(new, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e)) AS added"
    return candidates.where("size(new) = 0").selectExpr("doc_id", "base", added).unionByName(some.selectExpr("doc_id", "base", added))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(documents: DataFrame, mark: str = "[{}]") -> DataFrame:
    """documents with ``redacted``: each text with its spans, base and added, replaced by their kind.

    Rows are matched by doc_id, which must be unique; of overlapping spans the first is replaced.
    """

    def step(acc, x):
        names = F.array(*[F.lit(mark.format(k)) for k in KINDS])
        piece = F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))
        fresh = x["s"] >= acc["at"]
        return F.struct(F.when(fresh, x["e"]).otherwise(acc["at"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"), acc["text"].alias("text"))

    spans = find(documents).select("doc_id", F.array_sort(F.concat("base", "added")).alias("_spans"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.col("text").alias("text"))
    done = lambda acc: F.concat(acc["out"], F.substring(acc["text"], acc["at"] + 1, F.length(acc["text"])))
    return documents.join(spans, "doc_id", "left").withColumn("redacted", F.aggregate("_spans", begin, step, done)).drop("_spans")


def op1_pii_boosted(spark, sf_dir):
    rows = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {k})) AS LONG)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.array_sort(F.array_union("base", "added"))
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
