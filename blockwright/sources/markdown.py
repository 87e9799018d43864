"""Markdown documents to blocks: headings, paragraphs, lists, block quotes, code and pipe tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

HEADING = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
BULLET = re.compile(r"( {0,3})(?:[-*+]|\d{1,9}[.)])(?:\s+(.*)|$)")
RULE = re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
UNDERLINE = re.compile(r" {0,3}(=+|-+)\s*$")
DELIMITER = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
BLOCK = "block_idx int, block_type string, block_text string, level int, table_idx int, cell_values array<string>, is_header_group boolean, is_table_start boolean, is_table_end boolean"


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def tokens(text: str) -> Iterator[tuple[str, object]]:
    """(kind, content) of each element: heading (level, text), code, paragraph, list [items], table [rows], quote [texts], rule."""
    lines, i = text.replace("\r\n", "\n").split("\n"), 0
    begins = lambda s: HEADING.match(s) or FENCE.match(s) or BULLET.match(s) or RULE.match(s) or s.lstrip().startswith(">")
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := HEADING.match(line):
            yield "heading", (len(m[1]), m[2] or "")
            i += 1
        elif m := FENCE.match(line):
            end = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1]) and not lines[k].strip().strip(m[1][0])), len(lines))
            yield "code", "\n".join(lines[i + 1 : end]) + "\n"
            i = end + 1
        elif line.startswith("    "):
            end = i
            while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            yield "code", "\n".join(x[4:] for x in lines[i:end]).rstrip("\n")
            i = end
        elif RULE.match(line):
            yield "rule", None
            i += 1
        elif line.lstrip().startswith(">"):
            quoted = []
            while i < len(lines) and lines[i].strip() and (lines[i].lstrip().startswith(">") or not begins(lines[i])):
                quoted.append(re.sub(r"^\s*> ?", "", lines[i]))
                i += 1
            yield "quote", [content for kind, content in tokens("\n".join(quoted)) if kind in ("code", "paragraph")]
        elif m := BULLET.match(line):
            items: list[str] = []
            while i < len(lines):
                n = BULLET.match(lines[i])
                if n and len(n[1]) <= len(m[1]) + 1:
                    items.append(n[2] or "")
                elif not lines[i].strip():
                    after = next((x for x in lines[i:] if x.strip()), "")
                    if not (BULLET.match(after) or after.startswith("  ")):
                        break
                elif not lines[i].startswith(" ") and begins(lines[i]):
                    break
                elif not BULLET.match(lines[i].strip()) and lines[i - 1].strip():  # nested lists are left out
                    items[-1] += "\n" + lines[i].strip()
                i += 1
            yield "list", items
        elif "|" in line and i + 1 < len(lines) and DELIMITER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            rows, i, width = [_cells(line)], i + 2, len(_cells(line))
            while i < len(lines) and lines[i].strip() and "|" in lines[i]:
                rows.append((_cells(lines[i]) + [""] * width)[:width])
                i += 1
            yield "table", rows
        else:
            begin = i
            while i < len(lines) and lines[i].strip() and (i == begin or not begins(lines[i])):
                i += 1
                if i < len(lines) and UNDERLINE.match(lines[i]):
                    break
            said = "\n".join(x.strip() for x in lines[begin:i])
            if i < len(lines) and (m := UNDERLINE.match(lines[i])):
                yield "heading", (1 if m[1][0] == "=" else 2, said)
                i += 1
            else:
                yield "paragraph", said


def blocks(text: str | None) -> list[dict]:
    """A document's blocks. A heading is a header one level above its content; block_idx counts elements, so a list's items share one; rules are left out."""
    out, level, tables = [], 0, 0
    for idx, (kind, content) in enumerate(tokens(text or "")):
        add = lambda block_type, said, idx=idx, **more: out.append({"block_idx": idx, "block_type": block_type, "block_text": said, "level": level} | more)
        if kind == "heading":
            level = content[0]
            add("header", content[1])
            out[-1]["level"] = level - 1
        elif kind in ("paragraph", "code"):
            add("para", content)
        elif kind == "list":
            for item in content:
                add("list_item", item)
        elif kind == "quote":
            for said in content:
                add("para", said)
        elif kind == "table":
            for k, row in enumerate(content):
                add("table_row", " ".join(row), table_idx=tables, cell_values=row, is_header_group=k == 0, is_table_start=k == 0, is_table_end=k == len(content) - 1)
            tables += 1
    return out


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part (a block's place) and the block columns of each Markdown text; null and empty texts have no blocks."""
    kind = docs.schema[key].dataType.simpleString()
    fields = [f.split(" ")[0] for f in BLOCK.split(", ")]
    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(i, k, b) for i, t in enumerate(batch.column(1).to_pylist()) for k, b in enumerate(blocks(t))]
            columns = [pa.array([b.get(f) for _, _, b in made], t) for f, t in zip(fields, types, strict=True)]
            owners = batch.column(0).take(pa.array([i for i, _, _ in made], pa.int32()))
            yield pa.RecordBatch.from_arrays([owners, pa.array([k for _, k, _ in made], pa.int32()), *columns], names=[key, "part", *fields])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, part int, {BLOCK}")
