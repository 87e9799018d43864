"""Levels that need a stack: one loop over a document's blocks in an Arrow pass, linear in them (and in the chains they give)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHAINED = pa.list_(pa.struct([("level", pa.int32()), ("header_text", pa.string()), ("level_chain", pa.list_(pa.string()))]))


def chained(nodes: list[dict]) -> list[dict]:
    """level, header_text and level_chain (the nearest header first, its own for a header) of a page's nodes (key, rank, text).

    A header tag (rank above 0) closes all but those of smaller rank; a paragraph header goes on top of the others, or
    back to where its kind stood; nodes without a key stand below all.
    """
    stack: list[tuple[str, int, str]] = []
    out = []
    for node in nodes:
        key, rank = node["key"], node["rank"]
        kept = stack
        if rank > 0:
            kept = [e for e in stack if 0 < e[1] < rank]
        elif key is not None:
            kept = stack[: next((i for i, e in enumerate(stack) if e[0] == key), len(stack))]
        if key is not None:
            stack = [*kept, (key, rank, node["text"])]
        chain = [e[2] for e in reversed(stack)]
        out.append({"level": len(kept), "header_text": chain[0] if chain else "", "level_chain": chain})
    return out


def ranked(looks: list[dict]) -> list[int]:
    """The level of each look (size, weight, caps, kind, list): one on the stack closes what is above it and has its level; another closes what it outranks, or equals in rank with another list marker."""
    stack: list[tuple] = []
    out = []
    for x in looks:
        rank, own = (x["kind"], x["size"], x["weight"], x["caps"]), x["list"]
        if (rank, own) in stack:
            del stack[stack.index((rank, own)) :]
        else:
            stack = [e for e in stack if e[0] > rank or (e[0] == rank and e[1] != own)]
        out.append(len(stack))
        stack.append((rank, own))
    return out


def over(array: Column, loop: Callable[[list[dict]], list], kind: pa.DataType, sql: str) -> Column:
    """A loop over each array of structs, as a column."""

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([loop(row or []) for row in rows.to_pylist()], kind)

    return F.arrow_udf(run, sql)(array)


def chains(nodes: Column) -> Column:
    return over(nodes, chained, CHAINED, "array<struct<level:int,header_text:string,level_chain:array<string>>>")


def levels(looks: Column) -> Column:
    return over(looks, ranked, pa.list_(pa.int32()), "array<int>")
