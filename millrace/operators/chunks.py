"""Chunkers as table functions over a text column: one pass, no shuffle, columns of the input kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import chunking
from millrace.sources.slices import frames_of, with_value

CHUNK = pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("kind", pa.string()), ("name", pa.string())])
CHUNK_DDL = "array<struct<text:string,start:int,end:int,start_line:int,end_line:int,kind:string,name:string>>"


def _rows(chunks: list[chunking.Chunk]) -> list[dict]:
    return [vars(c) for c in chunks]


def _exploded(rows: DataFrame, columns: list[str], kind: str, type_: pa.DataType, split) -> DataFrame:
    """rows with total_chunks, chunk_index and chunk: what split(values of the columns) lists. Rows without chunks go."""
    held = with_value(rows, "_chunks", columns, kind, pa.list_(type_), split).withColumn("total_chunks", F.size("_chunks"))
    out = held.select("*", F.posexplode("_chunks").alias("chunk_index", "chunk"))
    return out.drop("_chunks")


def text_chunks(rows: DataFrame, column: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    """rows with chunk (text, offsets, lines), chunk_index and total_chunks. Null and blank texts give no rows."""
    return _exploded(rows, [column], CHUNK_DDL, CHUNK, lambda t: _rows(chunking.split_text(t or "", size, overlap)))


def code_chunks(rows: DataFrame, column: str, language: str, max_lines: int = 120) -> DataFrame:
    """Like text_chunks, by symbols; language: a column with the language's name."""
    return _exploded(rows, [column, language], CHUNK_DDL, CHUNK, lambda t, x: _rows(chunking.code_chunks(t or "", x, max_lines)))


def markdown_chunks(rows: DataFrame, column: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    kind = pa.struct([("section", pa.string()), ("text", pa.string())])
    return _exploded(rows, [column], "array<struct<section:string,text:string>>", kind, lambda t: [{"section": a, "text": b} for a, b in chunking.markdown_chunks(t or "", size, overlap)])


def sections(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, id, heading, level, line, parent, content) of each markdown section."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames_of(frames):
            out = [(k, s.id, s.heading, s.level, s.line, s.parent, s.content) for k, t in zip(f[key], f[column]) for s in chunking.sections(t)]
            yield pd.DataFrame(out, columns=[key, "id", "heading", "level", "line", "parent", "content"])

    return rows.select(key, column).mapInPandas(run, f"`{key}` {kind}, id string, heading string, level int, line int, parent string, content string")


def symbols(files: DataFrame) -> DataFrame:
    """(path, fqn, name, kind, start_line, end_line, calls) of source files (path, language, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames_of(frames):
            out = []
            for path, language, text in zip(f.path, f.language, f.text):
                for c in chunking.code_chunks(text or "", language):
                    if c.kind not in ("window", "preamble"):
                        fqn = path.rsplit("/", 1)[0].strip("/") + "." + c.name if "/" in path else c.name
                        out.append((path, fqn, c.name, c.kind, c.start_line, c.end_line, [x for x in chunking.outbound_calls(c.text) if x != c.name]))
            yield pd.DataFrame(out, columns=["path", "fqn", "name", "kind", "start_line", "end_line", "calls"])

    return files.select("path", "language", "text").mapInPandas(run, "path string, fqn string, name string, kind string, start_line int, end_line int, calls array<string>")


def call_edges(found: DataFrame) -> DataFrame:
    """(src, dst) of calls whose name one symbol has; the symbol of the same file first, else the smallest fqn."""
    calls = found.select("path", F.col("fqn").alias("src"), F.explode("calls").alias("name"))
    known = found.select("name", F.col("fqn").alias("dst"), F.col("path").alias("there"))
    met = calls.join(known, "name").groupBy("src", "name").agg(F.min_by("dst", F.struct((F.col("path") != F.col("there")).alias("far"), "dst")).alias("dst"))
    return met.select("src", "dst").distinct()


def with_summary(rows: DataFrame, column: str = "text") -> DataFrame:
    return with_value(rows, "summary", [column], "string", pa.string(), lambda t: chunking.extractive_summary(t or ""))
