"""Chunkers and document parsers: plain Python on one text, used from table functions (see millrace.operators.chunks).

Greedy chunks with carried overlap depend on what came before, which no SQL window expresses.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

SENTENCE_END = re.compile(r"(?<=[.?!])(?=\s|$)")


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in SENTENCE_END.split(text)) if s]


def paragraphs(text: str) -> list[str]:
    return [s for s in (p.strip() for p in text.split("\n\n")) if s]


@dataclass
class Chunk:
    text: str
    start: int
    end: int
    start_line: int = 0
    end_line: int = 0
    kind: str = "text"
    name: str = ""


def pieces(text: str, size: int) -> list[tuple[int, int]]:
    """Spans of paragraphs, or of a paragraph's sentences where it has more than ``size`` words."""
    out = []
    for m in re.finditer(r"(?:(?!\n\n).)+", text, re.S):
        if not m[0].strip():
            continue
        if len(m[0].split()) <= size:
            out.append(m.span())
            continue
        at = m.start()
        for s in SENTENCE_END.split(m[0]):
            if s.strip():
                out.append((at, at + len(s)))
            at += len(s)
    return out


def split_text(text: str, size: int = 512, overlap: int = 50) -> list[Chunk]:
    """Greedy chunks of at most ``size`` words (a longer sentence stays whole); each begins with the pieces that hold the last
    ``overlap`` words of the one before. Offsets are tracked, so a chunk's text is text[start:end]."""
    spans = pieces(text or "", size)
    counts = [len(text[a:b].split()) for a, b in spans]
    out, first, words = [], 0, 0
    for i, n in enumerate(counts):
        if i > first and words + n > size:
            out.append((spans[first][0], spans[i - 1][1]))
            back, carried = i, 0
            while back - 1 > first and carried + counts[back - 1] <= overlap:
                back -= 1
                carried += counts[back]
            first, words = back, carried
        words += n
    if spans:
        out.append((spans[first][0], spans[-1][1]))
    made = []
    for a, b in out:
        raw = text[a:b]
        a += len(raw) - len(raw.lstrip())
        raw = raw.strip()
        made.append(Chunk(raw, a, a + len(raw), text.count("\n", 0, a) + 1, text.count("\n", 0, a + len(raw)) + 1))
    return made


#: Line starts that open a new block of code.
BOUNDARY = re.compile(r"^(?:func|def|class|type|struct|interface|impl|fn|pub|export|public|private|protected|module|namespace|async def)\b")
#: A symbol's kind and name, by language.
SYMBOLS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("type", r"^type\s+(\w+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\(")],
    "java": [("class", r"^\s*(?:public|private|protected|abstract|final|\s)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "rust": [("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(\w+)")],
    "c": [("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("function", r"^[\w*]+\s+[\w*\s]*?(\w+)\s*\([^;]*$")],
    "ruby": [("function", r"^\s*def\s+([\w?!.]+)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
}
SYMBOLS["typescript"] = SYMBOLS["javascript"] + [("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)")]
SYMBOLS |= {"cpp": SYMBOLS["c"] + [("class", r"^\s*class\s+(\w+)")], "csharp": SYMBOLS["java"], "kotlin": [("function", r"^\s*(?:\w+\s+)*fun\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*class\s+(\w+)")], "scala": [("function", r"^\s*def\s+(\w+)"), ("class", r"^\s*(?:case\s+)?(?:class|object|trait)\s+(\w+)")], "php": [("function", r"^\s*(?:\w+\s+)*function\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*class\s+(\w+)")], "swift": [("function", r"^\s*(?:\w+\s+)*func\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|struct|enum|protocol)\s+(\w+)")]}


def code_chunks(source: str, language: str, max_lines: int = 120) -> list[Chunk]:
    """A preamble and one chunk from each symbol to the next; windows of lines where the language is unknown. Long ones are split."""
    lines = (source or "").split("\n")
    patterns = [(kind, re.compile(p)) for kind, p in SYMBOLS.get(language, [])]
    marks = []
    for i, line in enumerate(lines):
        for kind, p in patterns:
            m = p.match(line)
            if m:
                marks.append((i, kind, m[1]))
                break
    if not marks:
        return line_windows(source, max_lines, max_lines // 6)
    if any(x.strip() for x in lines[: marks[0][0]]):
        marks.insert(0, (0, "preamble", "preamble"))
    out, starts = [], [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    for (a, kind, name), b in zip(marks, [m[0] for m in marks[1:]] + [len(lines)]):
        for part, at in enumerate(range(a, b, max_lines)):
            to = min(b, at + max_lines)
            body = "\n".join(lines[at:to]).rstrip()
            if body.strip():
                out.append(Chunk(body, starts[at], starts[at] + len(body), at + 1, at + 1 + body.count("\n"), kind, name if b - a <= max_lines else f"{name}_part{part + 1}"))
    return out


def line_windows(text: str, size: int, overlap: int) -> list[Chunk]:
    """Windows of ``size`` lines that share ``overlap`` lines."""
    lines, out, at = (text or "").split("\n"), [], 0
    while at < len(lines):
        body = "\n".join(lines[at : at + size])
        start = sum(len(x) + 1 for x in lines[:at])
        if body.strip():
            out.append(Chunk(body, start, start + len(body), at + 1, min(len(lines), at + size), "window"))
        if at + size >= len(lines):
            break
        at += max(1, size - overlap)
    return out


def outbound_calls(body: str) -> list[str]:
    """Names that are called in a body, each once, in order."""
    known = {"if", "for", "while", "switch", "return", "func", "def", "catch", "print"}
    return list(dict.fromkeys(m for m in re.findall(r"(\w+)\s*\(", body) if m not in known))


RATIONALE = re.compile(r"(?:#|//|/\*|--)\s*(WHY|NOTE|HACK|TODO|IMPORTANT|FIXME|BUG)[:\s]\s*(.*)")


def rationale(source: str) -> list[tuple[int, str, str]]:
    """(line, tag, note) of comments that explain."""
    return [(i, m[1], m[2].strip()) for i, line in enumerate((source or "").split("\n"), 1) for m in [RATIONALE.search(line)] if m]


@dataclass
class Section:
    id: str
    heading: str
    level: int
    line: int
    parent: str | None
    content: str = ""
    path: list[str] = field(default_factory=list)


def sections(markdown: str) -> list[Section]:
    """Headings outside code fences and front matter, also underlined ones, with their parents, ids (s0, s0.1, ...) and text."""
    lines = (markdown or "").split("\n")
    found: list[tuple[int, int, str, int]] = []
    fence, i = None, 0
    if lines and lines[0].strip() == "---":
        closing = next((k for k, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
        i = closing + 1 if closing else 0
    while i < len(lines):
        line = lines[i]
        mark = re.match(r"^\s*(```|~~~)", line)
        if mark:
            fence = None if fence == mark[1] else fence or mark[1]
        elif not fence:
            m = re.match(r"^(#{1,6})\s+(.*)$", line)
            under = re.match(r"^(=+|-+)\s*$", lines[i + 1]) if i + 1 < len(lines) and line.strip() and not line.startswith(("#", "-", "|", ">")) else None
            if m:
                title = re.sub(r"\s*#+\s*$", "", re.sub(r"\s*\{#[^}]*\}\s*$", "", m[2])).strip()
                found.append((i, len(m[1]), title, i + 1))
            elif under and len(under[1]) >= 3:
                found.append((i, 1 if under[1][0] == "=" else 2, line.strip(), i + 2))
                i += 1
        i += 1
    out: list[Section] = []
    stack: list[Section] = []
    children: dict[str | None, int] = {}
    for k, (line, level, title, body) in enumerate(found):
        while stack and stack[-1].level >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        n = children.get(parent.id if parent else None, 0)
        children[parent.id if parent else None] = n + 1
        stop = found[k + 1][0] if k + 1 < len(found) else len(lines)
        s = Section(f"{parent.id}.{n}" if parent else f"s{n}", title, level, line + 1, parent.id if parent else None, "\n".join(lines[body:stop]).strip(), [*(parent.path if parent else []), title])
        out.append(s)
        stack.append(s)
    return out


def markdown_chunks(markdown: str, size: int = 512, overlap: int = 50) -> list[tuple[str, str]]:
    """(section id, text with its breadcrumb) of each section's chunks; plain chunks where there are no headings."""
    parts = sections(markdown)
    if not parts:
        return [("", c.text) for c in split_text(markdown, size, overlap)]
    out = []
    for s in parts:
        head = " > ".join("#" * min(i + 1, 6) + " " + h for i, h in enumerate(s.path))
        out += [(s.id, f"{head}\n\n{c.text}") for c in split_text(s.content, size, overlap)]
    return out


def document_graph(markdown: str, path: str) -> tuple[list[dict], list[dict]]:
    """Document and section nodes, with HAS_SECTION and HAS_SUBSECTION edges, under one key scheme: the path, and path#id."""
    parts = sections(markdown)
    title = next((s.heading for s in parts if s.level == 1), parts[0].heading if parts else path)
    node = {"id": path, "type": "Document", "title": title, "hash": hashlib.sha256((markdown or "").encode()).hexdigest(), "words": len((markdown or "").split()), "summary": extractive_summary(markdown or "")}
    nodes = [node] + [{"id": f"{path}#{s.id}", "type": "Section", "title": s.heading, "hash": hashlib.sha256(s.content.encode()).hexdigest(), "words": len(s.content.split()), "summary": first_paragraph(s.content)} for s in parts]
    edges = [{"src": f"{path}#{s.parent}" if s.parent else path, "dst": f"{path}#{s.id}", "type": "HAS_SUBSECTION" if s.parent else "HAS_SECTION"} for s in parts]
    return nodes, edges


def first_paragraph(text: str, limit: int = 200) -> str:
    p = next((p for p in paragraphs(text) if not p.startswith("#")), "")
    return p if len(p) <= limit else p[:limit].rsplit(" ", 1)[0] + "..."


def extractive_summary(text: str, keep: int = 3) -> str:
    """The sentences of 30 to 400 characters whose words are most frequent, in their order."""
    plain = re.sub(r"```.*?```", " ", text, flags=re.S)
    plain = re.sub(r"^#+ .*$|[*_`>|]|\[([^\]]*)\]\([^)]*\)", r"\1", plain, flags=re.M)
    all_sentences = [s for s in sentences(plain.replace("\n", " ")) if 30 < len(s) < 400]
    words = [re.findall(r"[^\W_]{4,}", s.lower()) for s in all_sentences]
    count: dict[str, int] = {}
    for ws in words:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    most = max(count.values(), default=1)
    rank = sorted(range(len(words)), key=lambda i: (-sum(count[w] / most for w in words[i]) / max(1, len(words[i])) ** 0.5, i))
    return " ".join(all_sentences[i] for i in sorted(rank[:keep]))


def faithfulness(source: str, extracted: str) -> float:
    """Percent of checks passed: headings, numbers and terms of the source that are kept, and sentences that it has."""
    checks = [h in extracted for h in [s.heading for s in sections(source)][:20]]
    checks += [n in extracted for n in list(dict.fromkeys(re.findall(r"\d+(?:\.\d+)?", source)))[:30]]
    checks += [w in extracted for w in list(dict.fromkeys(re.findall(r"\b[A-Z][a-zA-Z]{3,}\b", source)))[:50]]
    squeezed = re.sub(r"\W+", " ", source).lower()
    checks += [re.sub(r"\W+", " ", s).lower().strip() in squeezed for s in sentences(extracted)[:50]]
    return 100.0 * sum(checks) / len(checks) if checks else 100.0


def parse_tables(text: str) -> list[list[list[str]]]:
    """The pipe tables of a text: rows of cells, without separator rows."""
    out, rows = [], []
    for line in [*(text or "").split("\n"), ""]:
        if line.count("|") >= 2:
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c or "-") for c in cells):
                rows.append(cells)
        elif rows:
            out.append(rows)
            rows = []
    return out


def parse_step(response: str) -> dict[str, str]:
    """Thought, Action and Action Input of an agent's step, or its Final Answer."""
    out = {}
    for key in ("Thought", "Action", "Action Input", "Final Answer"):
        m = re.search(rf"^\s*{key}:\s*(.*)$", response or "", re.M)
        if m:
            out[key.lower().replace(" ", "_")] = m[1].strip()
    return out
