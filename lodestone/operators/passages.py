"""Passages: bounded, citable pieces of a document's blocks, with exact spans back to them.

Two steps. Every block falls into parts by itself: a block's token ends are computed once, so how much fits from any place is
one look-up, and a long block costs what its length is. Then the parts of one run (the same kind, group and section, in
order) are gathered into passages by their prefix sums, as many as fit. A heading opens a group; tables and code stand alone.

Token counts come from a counter, text -> ends of its tokens, whose name is part of a passage's identity. A part's count is
that of the tokens it touches, which is never below the count of the part alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import hashing
from lodestone.functions import text as tx
from lodestone.sources.parsers import render_table

VERSION = "2"
# Tokens that a passage aims at, that it may have at most, and that parts of a long text share.
TARGET, MOST, OVERLAP = 450, 650, 40
#: Room for the blank lines between parts.
ROOM = 4

SCHEMA = "id string, passage_id string, ordinal int, kind string, grp string, section string, content string, tokens int, spans array<struct<block_id:string,start:int,end:int,unit:string>>, warnings array<string>, error string"
_SPAN = pa.struct([("block_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("unit", pa.string())])
_ARROW = pa.schema([("id", pa.string()), ("passage_id", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("grp", pa.string()), ("section", pa.string()), ("content", pa.string()), ("tokens", pa.int32()), ("spans", pa.list_(_SPAN)), ("warnings", pa.list_(pa.string())), ("error", pa.string())])

Counter = Callable[[str], np.ndarray]
_token = re.compile(r"\w{1,4}|[^\w\s]|\s{2,}")


def approximate(text: str) -> np.ndarray:
    """Up to four letters or digits, a mark, or a run of blanks each are one token."""
    return np.fromiter((m.end() for m in _token.finditer(text)), np.int64)


def marks(text: str, pattern: str) -> np.ndarray:
    """Where a text may be cut: after each match."""
    return np.fromiter((m.end() for m in re.finditer(pattern, text)), np.int64)


#: Cut points by kind, the better ones first: paragraphs' and sentences' ends; lines before an unindented one, and any line.
POINTS = {"prose": (r"\n[ \t]*\n\s*", r"[.!?…][\"'”’)\]]*\s+"), "code": (r"\n(?=[^\s)\]}])", r"\n")}


class TooLarge(ValueError):
    """A unit that can't be cut any further exceeds the budget."""


@dataclass
class Part:
    kind: str
    group: str
    section: str
    span: tuple[str, int, int, str]
    tokens: int
    warning: str | None = None


def cut(text: str, kind: str, budget: int, overlap: int, count: Counter = approximate) -> list[tuple[int, int, int, bool]]:
    """(start, end, tokens, whole) of a text's parts. A part ends at the last of the best cut points in the second half of what
    fits, else at the last of the others, else at a token's end, which is not whole. With overlap a part begins at the first
    point in the last so many tokens of the one before."""
    ends = count(text)
    levels = [marks(text, p) for p in POINTS[kind]]
    points = np.unique(np.concatenate([*levels, [0, len(text)]]))
    out, at, done, overlap = [], 0, 0, min(overlap, budget // 2)
    while at < len(text):
        first = int(np.searchsorted(ends, at, side="right"))
        last = first + max(1, budget)
        if last >= len(ends):
            out.append((at, len(text), len(ends) - first, True))
            break
        reach, to, whole = int(ends[last - 1]), 0, True
        for level in levels:
            i = int(np.searchsorted(level, reach, side="right")) - 1
            if i >= 0 and level[i] > max(done, at + (reach - at) // 2 if level is levels[0] else at):
                to = int(level[i])
                break
        if not to:
            to, whole = reach, False
        done = to
        out.append((at, to, int(np.searchsorted(ends, to, side="left")) + 1 - first, whole))
        again = int(ends[max(0, int(np.searchsorted(ends, to, side="right")) - overlap)])
        i = int(np.searchsorted(points, max(again, at + 1))) if overlap else len(points)
        at = int(points[i]) if i < len(points) and points[i] < to else to
    return out


def fill(sizes: list[int], budget: int) -> list[tuple[int, int]]:
    """Ranges of neighbours, each as long as fits the budget; a single larger one stays alone."""
    sums = np.cumsum([0, *sizes])
    out, at = [], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + budget, side="right")) - 1)
        out.append((at, to))
        at = to
    return out


def parts(block: dict, group: str, count: Counter = approximate) -> list[Part]:
    section = " / ".join(block["section_path"] or []) or "Document"
    budget = TARGET - len(count(section)) - ROOM
    bid, text = block["block_id"], block["content"]
    if block["type"] == "table":
        table = json.loads(block["structured"])
        head = len(count(render_table(table["headers"], [])))
        rows = [len(count(render_table([], [r])[len(render_table([], [])) :])) + 1 for r in table["rows"]]
        ranges = fill(rows, budget - head) or [(0, 0)]
        return [Part("table", group, section, (bid, a, b, "rows"), head + sum(rows[a:b])) for a, b in ranges]
    kind = "code" if block["type"] == "code" else "prose"
    size = len(count(text))
    if size + len(count(section)) <= (MOST if kind == "code" else TARGET) - ROOM:
        return [Part(kind, group, section, (bid, 0, len(text), "characters"), size)]
    told = {"code": "Large code unit split", "prose": None}[kind]
    found = cut(text, kind, budget, OVERLAP if kind == "prose" and size > MOST else 0, count)
    return [Part(kind, group, section, (bid, a, b, "characters"), n, told if kind == "code" else None if whole else "Oversized sentence split at a character") for a, b, n, whole in found]


def denoted(block: dict, start: int, end: int, unit: str) -> str:
    """What a span denotes: characters of the content, or rows of a table under its header."""
    if unit == "rows":
        table = json.loads(block["structured"])
        return render_table(table["headers"], table["rows"][start:end])
    return block["content"][start:end]


def pack(source: str, blocks: list[dict], count: Counter = approximate, counter: str = "approximate") -> list[dict]:
    by_id, group, every = {b["block_id"]: b for b in blocks}, "root", []
    for b in blocks:
        if b["type"] == "heading":
            group = b["block_id"]
        else:
            every += parts(b, group, count)
    if not every:  # headings alone are evidence, too
        every = [Part("prose", b["block_id"], " / ".join(b["section_path"] or []), (b["block_id"], 0, len(b["content"]), "characters"), len(count(b["content"]))) for b in blocks]
    out: list[dict] = []
    for (kind, grp, section), run in groupby(every, lambda p: (p.kind, p.group, p.section)):
        run = list(run)
        alone = kind != "prose"
        for a, b in [(i, i + 1) for i in range(len(run))] if alone else fill([p.tokens + 1 for p in run], TARGET - len(count(section))):
            spans = [p.span for p in run[a:b]]
            content = "\n\n".join(denoted(by_id[s[0]], *s[1:]) for s in spans)
            if not content.strip():
                continue
            tokens = len(count(section)) + len(count(content))
            if tokens > MOST:
                raise TooLarge("an indivisible unit exceeds the passage budget")
            named = [dict(zip(("block_id", "start", "end", "unit"), s, strict=True)) for s in spans]
            warnings = sorted({p.warning for p in run[a:b] if p.warning})
            pid = hashing.passage_id(VERSION, counter, source, len(out), kind, grp, section, content, named, warnings)
            out.append({"id": source, "passage_id": pid, "ordinal": len(out), "kind": kind, "grp": grp, "section": section, "content": content, "tokens": tokens, "spans": named, "warnings": warnings})
    return out


def packed(blocks: DataFrame) -> DataFrame:
    """Blocks (as of sources.blocks) to passages; a document that can't be packed gives one row with its error."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["ordinal"])
        try:
            out = pack(rows[0]["id"], rows)
        except TooLarge as e:
            out = [{"id": rows[0]["id"], "error": str(e)}]
        return pa.Table.from_pylist([{n: r.get(n) for n in _ARROW.names} for r in out], _ARROW)

    return blocks.filter("error IS NULL").groupBy("id").applyInArrow(run, SCHEMA)


def _rendered(headers: Column, rows: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, tx.table_cell), " | "), F.lit(" |"))

    return F.array_join(F.concat(F.array(line(headers), line(F.transform(headers, lambda _: F.lit("---")))), F.transform(rows, line)), "\n")


def unreconstructed(passages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Passages whose content isn't what their spans denote: (id, passage_id). Characters are cut, table rows rendered anew,
    all in the JVM."""
    spans = passages.filter("error IS NULL").select("id", "passage_id", "content", F.posexplode("spans").alias("k", "s"))
    b = blocks.select("id", F.col("block_id").alias("b"), F.col("content").alias("text"), F.from_json("structured", "headers array<string>, rows array<array<string>>").alias("table"))
    joined = spans.join(b, (spans["id"] == b["id"]) & (F.col("s.block_id") == F.col("b")), "left").select(spans["id"], "passage_id", "content", "k", "s", "text", "table")
    size = F.col("s.end") - F.col("s.start")
    made = F.when(F.col("s.unit") == "characters", F.substr("text", F.col("s.start") + 1, size)).otherwise(_rendered(F.col("table.headers"), F.slice("table.rows", F.col("s.start") + 1, size)))
    whole = joined.groupBy("id", "passage_id", "content").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce(made, F.lit("")).alias("c")))), lambda x: x["c"]), "\n\n").alias("made"))
    return whole.filter(F.col("made") != F.col("content")).select("id", "passage_id")
