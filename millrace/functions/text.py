"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the lexical index.
STOP_WORDS = (
    "the is at which on a an and or but in to for of with by from as it that this be are was were been being have has had "
    "do does did will would could should may might not no so if then"
).split()

#: File extensions of markdown files.
MARKDOWN = ("md", "markdown", "mdx", "mkd", "mdown", "rst")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of more than one byte, without stop words; null gives none."""
    raw = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.filter(raw, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def term_rows(text: Column) -> Column:
    """The same words before the filter, to be exploded; ``is_term`` then picks them in generated code."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")


def is_term(term: Column) -> Column:
    return (F.octet_length(term) > 1) & ~term.isin(*STOP_WORDS)


def fields(text: Column) -> Column:
    """The whitespace-separated words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(fields(text))


def overlap_tail(text: Column, n: int) -> Column:
    """The last n words; the whole text if it has no more."""
    w = fields(text)
    return F.when(F.size(w) <= n, text).otherwise(F.array_join(F.slice(w, -n, n), " "))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Pieces that end at . ? or ! before white space or the end, trimmed, without empty ones."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"(?<=[.?!])(?=\s|$)")
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def clean_heading(h: Column) -> Column:
    """Without trailing # marks and a {#anchor}."""
    return F.trim(F.regexp_replace(F.regexp_replace(h, r"\s*\{#[^}]*\}\s*$", ""), r"\s*#+\s*$", ""))


def breadcrumb(path: Column) -> Column:
    """# A > ## B, levels capped at six marks."""
    return F.array_join(F.transform(path, lambda h, i: F.concat(F.repeat(F.lit("#"), F.least(i + 1, F.lit(6))), F.lit(" "), h)), " > ")


def cut(text: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters, then the mark if something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def cut_at_space(text: Column, limit: int, mark: str = "...") -> Column:
    """Like cut, but back to the last space before the limit."""
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) > limit, F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(mark))).otherwise(text)


def first_paragraph(text: Column, limit: int = 200) -> Column:
    """The first paragraph that isn't a heading, cut at a space."""
    found = F.filter(paragraphs(text), lambda p: ~F.startswith(p, F.lit("#")))
    return cut_at_space(F.coalesce(F.get(found, F.lit(0)), F.lit("")), limit)


def truncate_to_tokens(text: Column, limit: int) -> Column:
    """For embedding models: (limit - 64, 128 at least) * 2.5 characters, back to the last space."""
    n = int(max(limit - 64, 128) * 2.5)
    return F.when(F.length(text) > n, F.regexp_replace(F.substring(text, 1, n), r" [^ ]*$", "")).otherwise(text)


def limited(content: Column, limit: Column) -> Column:
    """A memory block's content within its character limit (0: none)."""
    cutoff = F.greatest(limit - 15, F.lit(0))
    return F.when((limit > 0) & (F.length(content) > limit), F.concat(F.substring(content, F.lit(1), cutoff), F.lit("... [truncated]"))).otherwise(content)


def table_cells(line: Column) -> Column:
    """A pipe row's trimmed cells."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))


def numbered_lines(text: Column, start: int = 1) -> Column:
    """Each line with its right-aligned number and a bar."""
    lines = F.split(text, "\n")
    width = F.length((F.size(lines) + start - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.lpad((i + start).cast("string"), width, F.lit(" ")), F.lit("|"), line)), "\n")


def package_of(name: Column) -> Column:
    """The package of a qualified name: without what follows the last dot, the last segment of the rest."""
    return F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_markdown(path: Column) -> Column:
    return extension(path).isin(*MARKDOWN)


#: Languages by extension.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "rs": "rust", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "lua": "lua", "sh": "bash", "bash": "bash", "ex": "elixir", "exs": "elixir", "hs": "haskell", "zig": "zig", "dart": "dart", "r": "r", "pl": "perl",
}

#: Media types by extension.
MEDIA = {"image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff"), "audio": ("mp3", "wav", "flac", "ogg", "m4a"), "video": ("mp4", "mov", "avi", "mkv", "webm")}


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(known, extension(path)), F.lit("unknown"))


def media_type(path: Column) -> Column:
    e = extension(path)
    out = F.lit("unknown")
    for kind, names in MEDIA.items():
        out = F.when(e.isin(*names), kind).otherwise(out)
    return out
