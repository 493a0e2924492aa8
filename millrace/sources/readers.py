"""Readers of documents: files as rows, ignore patterns, and extraction to markdown.

Files are read by Spark (``binaryFile``), so any store that Spark reaches will do; extraction is one narrow pass.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import extension
from millrace.sources.slices import frames_of, with_value

#: Directories that are never scanned, and extensions of binary files without a reader.
SKIPPED = ("node_modules", "vendor", "dist", "build", ".next")
BINARY = ("exe", "dll", "so", "bin", "o", "a", "class", "jar", "zip", "gz", "tar", "png", "jpg", "jpeg", "gif", "ico", "mp3", "mp4", "mov", "woff", "woff2", "ttf", "db", "sqlite")
READABLE = ("csv", "docx", "xlsx", "pptx", "html", "htm", "md", "markdown", "txt")
LARGEST = 1 << 20


def glob_pattern(pattern: str) -> str:
    """A regular expression over relative paths for one line of an ignore file (without ! and trailing /)."""
    anchored = "/" in pattern.strip("/")
    body = re.escape(pattern.strip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{body}(?:/.*)?$" if anchored else f"(?:^|/){body}(?:/.*)?$"


def ignored(path: Column, lines: list[str]) -> Column:
    """The last pattern that matches decides; ! takes a match back."""
    out = F.lit(False)
    for line in lines:
        line = line.strip()
        if line and not line.startswith("#"):
            out = F.when(path.rlike(glob_pattern(line.lstrip("!").rstrip("/"))), F.lit(not line.startswith("!"))).otherwise(out)
    return out


def eligible(path: Column, length: Column, ignore: list[str] = ()) -> Column:
    """Whether a file of that relative path is read."""
    hidden = path.rlike(r"(?:^|/)\.[^/]")
    skipped = path.rlike(r"(?:^|/)(?:" + "|".join(map(re.escape, SKIPPED)) + r")/")
    readable = extension(path).isin(*READABLE)
    return ~hidden & ~skipped & ~ignored(path, list(ignore)) & (~extension(path).isin(*BINARY)) & (readable | (length <= LARGEST))


def files(spark: SparkSession, root: str, ignore: list[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(path, length, content) of the eligible files below root; only: a table (path) of changed files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:").replace("//", "/"))
    rows = rows.select(F.regexp_replace("path", f"^.*?{base}/", "").alias("path"), "length", "content").where(eligible(F.col("path"), F.col("length"), ignore))
    return rows.join(only.select("path"), "path", "left_semi") if only is not None else rows


def markdown_table(rows: list[list[str]]) -> str:
    """A pipe table; rows are padded to the widest."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    full = [[str(c).replace("\n", " ").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in full]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def read_csv(data: bytes, name: str) -> str:
    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))) if r]
    width = len(rows[0]) if rows else 0
    return f"# {name}\n\n" + markdown_table([(r + [""] * width)[:width] for r in rows])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def read_docx(data: bytes, name: str) -> str:
    """Paragraphs, headings (one level below the title), list items and tables, in order."""
    body = next(iter(ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))))
    out = [f"# {name}"]
    for node in body:
        if _local(node.tag) == "tbl":
            out.append(markdown_table([[_texts(c) for c in row if _local(c.tag) == "tc"] for row in node if _local(row.tag) == "tr"]))
        elif _local(node.tag) == "p":
            style = next((v for s in node.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            text = _texts(node).strip()
            level = re.fullmatch(r"Heading([1-3])", style)
            if text:
                out.append("#" * (int(level[1]) + 1) + " " + text if level else "- " + text if style == "ListParagraph" else text)
    return "\n\n".join(out)


def read_xlsx(data: bytes, name: str) -> str:
    """Each sheet as a table."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(s) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = [s.attrib["name"] for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    out = [f"# {name}"]
    for i, sheet in enumerate(sheets, 1):
        rows = []
        for row in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter():
            if _local(row.tag) == "row":
                cells: list[str] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.attrib.get("r", ""))
                    at = len(cells)
                    if letters:
                        at = 0
                        for ch in letters[0]:
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), _texts(c))
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(value)] if c.attrib.get("t") == "s" and value else value
                rows.append(cells)
        out += [f"## {sheet}", markdown_table(rows)]
    return "\n\n".join(out)


def read_pptx(data: bytes, name: str) -> str:
    """Slides in order of their numbers."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() for m in [re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)] if m)
    out = [f"# {name}"]
    for i, n in slides:
        runs = [t.text for t in ET.fromstring(z.read(n)).iter() if _local(t.tag) == "t" and t.text]
        out += [f"## Slide {i}", " ".join(runs)]
    return "\n\n".join(out)


_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*>|<!--.*?-->|<![^>]*>", re.S)


def read_html(html: str, name: str = "") -> str:
    """Headings, paragraphs, line breaks and list items as markdown lines; other tags go, their text stays; entities stay."""
    out: list[str] = [f"# {name}"] if name else []
    prefix, buffer, at = "", [], 0

    def flush() -> None:
        line = " ".join("".join(buffer).split())
        if line:
            out.append(prefix + line)
        buffer.clear()

    for m in _TAG.finditer(html or ""):
        buffer.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if tag in ("h1", "h2", "h3", "p", "br", "li"):
            flush()
            prefix = {"h1": "## ", "h2": "### ", "h3": "#### ", "li": "- "}.get(tag, "") if not m[1] else ""
    buffer.append((html or "")[at:])
    flush()
    return "\n\n".join(out)


#: By extension: bytes and name to markdown. Others (pdf, media) can be added; a reader that fails gives null.
READERS: dict[str, Callable[[bytes, str], str]] = {
    "csv": read_csv, "docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx,
    "html": lambda d, n: read_html(d.decode("utf-8", "replace"), n), "htm": lambda d, n: read_html(d.decode("utf-8", "replace"), n),
}


def extracted(rows: DataFrame, readers: dict[str, Callable[[bytes, str], str]] | None = None) -> DataFrame:
    """(path, text) of files (path, content). Without a reader a file is UTF-8 text; bad documents give null."""
    known = READERS | (readers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames_of(frames, 16):
            out = []
            for path, content in zip(f.path, f.content):
                read = known.get(path.rsplit(".", 1)[-1].lower())
                try:
                    out.append((path, read(content, path.rsplit("/", 1)[-1]) if read else content.decode("utf-8", "replace")))
                except (KeyError, ValueError, ET.ParseError, zipfile.BadZipFile, StopIteration):
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "text"])

    return rows.select("path", "content").mapInPandas(run, "path string, text string")


def html_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with ``markdown``."""

    return with_value(pages, "markdown", [column], "string", pa.string(), read_html)


def pack(spark: SparkSession, manifest: dict, content: list[str]) -> DataFrame:
    """A knowledge pack's items (pack_id, slug, item as JSON) from JSON contents: a list, a map with one list, or one map."""
    rows = []
    for text in content:
        data = json.loads(text)
        if isinstance(data, dict):
            lists = [v for v in data.values() if isinstance(v, list)]
            data = lists[0] if len(lists) == 1 and len(data) == 1 else [data]
        rows += [(manifest["id"], str(i.get("id") or i.get("slug") or i.get("key") or ""), json.dumps(i, sort_keys=True)) for i in data if isinstance(i, dict)]
    return spark.createDataFrame(rows, "pack_id string, slug string, item string")


def pack_search(items: DataFrame, query: str, fields: list[str] = (), limit: int = 50) -> DataFrame:
    """Items with the query in one of the fields, or in any value, in any case."""
    values = F.from_json("item", "map<string,string>")
    q = query.lower()
    held = F.array(*[F.element_at(values, F.lit(f)) for f in fields]) if fields else F.map_values(values)
    return items.where(F.exists(held, lambda v: F.coalesce(F.lower(v).contains(q), F.lit(False)))).orderBy("slug").limit(min(limit, 500))
