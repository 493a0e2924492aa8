"""Joins between documents, their sections and chunks, and the symbols of a code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n a key in each task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def symbols_in_files(declares: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, id, ...) of the symbols that files (path; default all) declare: declares (path, id)."""
    rows = declares.join(files.select("path"), "path", "left_semi") if files is not None else declares
    return rows.join(symbols, "id")


def document_symbols(sections: DataFrame, chunks: DataFrame, explains: DataFrame, symbols: DataFrame) -> DataFrame:
    """(document, id, ...) along document - section - chunk - symbol: sections (document, section), chunks (section, chunk), explains (chunk, id)."""
    return sections.join(chunks, "section").join(explains, "chunk").select("document", "id").distinct().join(symbols, "id")


def document_context(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """documents (id, vpath, folder_id) with their folder's name, empty where there is none."""
    named = folders.select(F.col("id").alias("folder_id"), F.col("name").alias("folder"))
    return documents.join(named, "folder_id", "left").withColumn("folder", F.coalesce("folder", F.lit("")))


def full_documents(chunks: DataFrame) -> DataFrame:
    """(document, text) of chunks (document, chunk_id, content), in order of the number in chunk_id, a blank line between them."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("chunk_id").try_cast("long").alias("n"), "chunk_id", "content")))
    return chunks.groupBy("document").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("text"))


def neighbours(calls: DataFrame, symbols: DataFrame, picked: DataFrame, most: int | None = None) -> DataFrame:
    """picked (id, ...) with callees and callers, sorted arrays of fqn; most: how many of each, at most."""
    names = symbols.select("id", "fqn")

    def side(own: str, other: str, name: str) -> DataFrame:
        rows = calls.select(F.col(own).alias("id"), F.col(other).alias("_o")).join(picked.select("id").distinct(), "id", "left_semi").distinct()
        rows = rows.join(names.select(F.col("id").alias("_o"), F.col("fqn").alias("_f")), "_o").select("id", "_f")
        rows = first_of(rows, ["id"], ["_f"], most) if most else rows
        return rows.groupBy("id").agg(F.array_sort(F.collect_list("_f")).alias(name))

    none = F.array().cast("array<string>")
    out = picked.join(side("src", "dst", "callees"), "id", "left").join(side("dst", "src", "callers"), "id", "left")
    return out.withColumn("callees", F.coalesce("callees", none)).withColumn("callers", F.coalesce("callers", none))


def with_graph_context(results: DataFrame, documents: DataFrame, folders: DataFrame, declares: DataFrame, symbols: DataFrame, calls: DataFrame, most: int = 5) -> DataFrame:
    """results (source, ...) with ``document`` (title, folder) and ``symbols``: of the first ``most`` symbols of the source's file,
    by fqn, those with callers or callees. Both are null where there is nothing; sources are looked up once each."""
    sources = results.select(F.col("source").alias("path")).distinct()
    context = document_context(documents, folders).select(F.col("vpath").alias("source"), F.struct("title", "folder").alias("document"))
    picked = first_of(symbols_in_files(declares, symbols, sources), ["path"], ["fqn"], most)
    known = neighbours(calls, symbols, picked).where((F.size("callees") > 0) | (F.size("callers") > 0))
    grouped = known.groupBy(F.col("path").alias("source")).agg(F.array_sort(F.collect_list(F.struct("fqn", "kind", "callees", "callers"))).alias("symbols"))
    return results.join(context, "source", "left").join(grouped, "source", "left")


def navigate(symbols: DataFrame, calls: DataFrame, part: str, matches: int = 5, most: int = 10) -> DataFrame:
    """The first symbols whose fqn holds the part, with at most ``most`` callers and callees of each."""
    hit = symbols.where(F.lower("fqn").contains(part.lower())).orderBy("fqn", "id").limit(matches)
    return neighbours(calls, symbols, hit, most)


def with_parents(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """sections (id, ...) with the parent_id that a HAS_SUBSECTION edge (src, dst, type) gives them."""
    up = edges.where("type = 'HAS_SUBSECTION'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent_id"))
    return sections.join(up, "id", "left")


def of_types(symbols: DataFrame, kind: str) -> DataFrame:
    """Functions, classes or imports among symbols (kind)."""
    wanted = {"functions": ["function", "method"], "classes": ["class", "struct", "interface"], "imports": ["preamble", "import"]}
    return symbols.where(F.col("kind").isin(*wanted[kind]))


def without_document(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Sections, chunks or documents (vpath) without those of the documents gone (vpath)."""
    return rows.join(gone.select("vpath"), "vpath", "left_anti")


def weighted_relations(calls: DataFrame, declares: DataFrame, implements: DataFrame) -> DataFrame:
    """One edge table (src, dst, weight) for community analysis: calls weigh 1, declarations 0.3, implementations 0.8."""
    parts = [rows.select("src", "dst", F.lit(w).alias("weight")) for rows, w in ((calls, 1.0), (declares, 0.3), (implements, 0.8))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def with_provenance(chunks: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """chunks (metadata map) with the fields that aren't null or empty; they replace older ones."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    added = F.map_from_entries(entries)
    kept = F.map_filter("metadata", lambda k, _: ~F.map_contains_key(added, k))
    return chunks.withColumn("metadata", F.map_concat(kept, added))


def module_of(go_mod: Column, directory: Column) -> Column:
    """The name on the module line of a go.mod, else the directory's last part."""
    named = F.regexp_extract(go_mod, r"(?m)^module\s+(\S+)", 1)
    return F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.regexp_extract(directory, r"([^/]+)/*$", 1))


def suggested_questions(hubs: DataFrame, most: int = 3) -> DataFrame:
    """(question) about the hubs (name, degree) of largest degree."""
    best = hubs.orderBy(F.desc("degree"), "name").limit(most)
    return best.select(F.format_string("What depends on %s, and why do %d edges meet there?", "name", F.col("degree").cast("long")).alias("question"))
