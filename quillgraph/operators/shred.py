"""Deeply nested records as flat tables with parent links.

Method: columnar shredding. The outline of a record is written as leaf columns,
for each nesting level the paths items(.children)*.{kind,title,page,endPage}.
Each entry of a column is (r, d, v): r is the repetition level at which the
value repeats, d the definition level down to which its path exists, v the value.
A level adds two to the definition level: the list has this element, and the
element is no null. The node table of a level is read back from the level
sequences alone: an entry with repetition level r moves the position at level r
on by one and sets the deeper ones to 0.

Defined cases: a payload that is null or no complete JSON gives no rows; repeated
rows count once; payloads nest to any depth; an envelope nested too deep for a
look into it holds no outline; a null among siblings holds its position; a child outside a list
has position 0; children may be a JSON text of a list or an object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from json.decoder import scanstring
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import spread

LEAVES = ("kind", "title", "page", "endPage")
#: How the fields of a node may be written.
PAGE_KEYS = ("pageNumber", "page", "page_number")
END_KEYS = ("endPage", "end_page")
CHILD_KEYS = ("children", "items", "kids")
NODE_KEYS = ("title", *PAGE_KEYS, *END_KEYS, "children", "dest")


#: Entries of the columns that are held at once.
MOST_ENTRIES = 1_000_000
#: Rows that are handed on at once, and characters of their paths.
MOST_ROWS, MOST_CHARACTERS = 10_000, 20_000_000
BLANK = re.compile(r"[ \t\n\r]*")
SCALAR = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)")


def parsed(text: str) -> Any:
    """The JSON text; ValueError if it is not complete. Texts too deep for the usual reader are read with a stack of their own."""
    try:
        return json.loads(text)
    except RecursionError:
        return parsed_deep(text)


def parsed_deep(text: str) -> Any:
    top: list[Any] = []
    # open containers, each with the key that its next value gets
    opened: list[tuple[Any, list[str]]] = []
    at, need_comma = 0, False

    def put(x: Any) -> None:
        if not opened:
            top.append(x)
        elif isinstance(opened[-1][0], list):
            opened[-1][0].append(x)
        else:
            opened[-1][0][opened[-1][1].pop()] = x

    while True:
        at = BLANK.match(text, at).end()
        if not opened and top:
            if at != len(text):
                raise ValueError("text behind the value")
            return top[0]
        if at >= len(text):
            raise ValueError("the text ends early")
        c = text[at]
        holder = opened[-1][0] if opened else None
        if holder is not None and c == ("]" if isinstance(holder, list) else "}") and (need_comma or not holder):
            opened.pop()
            at, need_comma = at + 1, True
            continue
        if need_comma:
            if c != ",":
                raise ValueError("no comma")
            at, need_comma = BLANK.match(text, at + 1).end(), False
            c = text[at : at + 1]
        if isinstance(holder, dict):
            if c != '"':
                raise ValueError("no key")
            key, at = scanstring(text, at + 1, True)
            at = BLANK.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError("no colon")
            opened[-1][1].append(key)
            at = BLANK.match(text, at + 1).end()
            c = text[at : at + 1]
        if c in ("[", "{") and c:
            new: Any = [] if c == "[" else {}
            put(new)
            opened.append((new, []))
            at, need_comma = at + 1, False
        elif c == '"':
            x, at = scanstring(text, at + 1, True)
            put(x)
            need_comma = True
        elif m := SCALAR.match(text, at):
            put(json.loads(m[0]))
            at, need_comma = m.end(), True
        else:
            raise ValueError("no value")


def whole(number: Any) -> int | None:
    try:
        return None if isinstance(number, bool) else int(str(number).strip())
    except ValueError:
        return None


def elements(held: Any) -> list[Any]:
    """The siblings that a children field holds, in order, nulls included."""
    if isinstance(held, str):
        try:
            inner = parsed(held)
        except ValueError:
            return [held] if held.strip() else []
        return elements(inner) if isinstance(inner, (list, dict, str)) else [held] if inner is not None else []
    if isinstance(held, dict):
        if not any(k in held for k in NODE_KEYS):
            if isinstance(held.get("items"), (list, str)):
                return elements(held["items"])
            if held and all(k.isdigit() for k in held):
                out: list[Any] = [None] * (max(map(int, held)) + 1) if max(map(int, held)) < 4 * len(held) + 16 else []
                if not out:
                    return [held[k] for k in sorted(held, key=int)]
                for k, x in held.items():
                    out[int(k)] = x
                return out
        return [held]
    return held if isinstance(held, list) else []


def top_items(held: Any) -> list[Any]:
    """The top items of an outline, out of whatever envelope holds them."""
    if isinstance(held, str):
        try:
            return top_items(parsed(held))
        except ValueError:
            return []
    if isinstance(held, list):
        return held
    if isinstance(held, dict):
        if "items" in held:
            return elements(held["items"])
        if "outline" in held:
            return top_items(held["outline"])
        if any(k in held for k in NODE_KEYS):
            return [held]
        for inner in held.values():
            if isinstance(inner, dict) and (out := top_items(inner)):
                return out
        for inner in held.values():
            if isinstance(inner, list) and any(isinstance(x, dict) and any(k in x for k in NODE_KEYS) for x in inner):
                return inner
    return []


Columns = dict[str, list[tuple[int, int, Any]]]


class Node:
    """The leaves of a node and what it holds."""

    __slots__ = ("values", "kids")

    def __init__(self, held: dict[str, Any] | str):
        if isinstance(held, str):
            self.values: tuple[Any, ...] = ("title", held, None, None)
            self.kids: list[Any] = []
            return
        title = held.get("title")
        self.values = (
            "object",
            title if isinstance(title, str) or title is None else str(title),
            whole(next((held[x] for x in PAGE_KEYS if held.get(x) is not None), None)),
            whole(next((held[x] for x in END_KEYS if held.get(x) is not None), None)),
        )
        self.kids = elements(next((held[k] for k in CHILD_KEYS if held.get(k) is not None), None))


def tree(payload: str | None) -> tuple[list[Node | None], int, int]:
    """The top items with all below them, the number of siblings in all, and the height; nothing if the payload is no complete JSON."""
    try:
        top = list(top_items(parsed(payload.lstrip("\ufeff")))) if payload else []
    except (ValueError, RecursionError):
        return [], 0, 0
    count, height, level = 0, 0, [top]
    while level := [siblings for siblings in level if siblings]:
        height += 1
        below = []
        for siblings in level:
            count += len(siblings)
            for k, held in enumerate(siblings):
                siblings[k] = node = Node(held) if isinstance(held, (dict, str)) else None
                if node is not None:
                    node.kids = list(node.kids)
                    below.append(node.kids)
        level = below
    return top, count, height


def band(top: list[Node | None], low: int, high: int) -> list[Columns]:
    """The leaf columns of the levels low to high - 1."""
    out: list[Columns] = [{leaf: [] for leaf in LEAVES} for _ in range(low, high)]

    def missing(level: int, r: int, d: int) -> None:
        for columns in out[max(0, level - low) :]:
            for leaf in LEAVES:
                columns[leaf].append((r, d, None))

    stack: list[list[Any]] = [[top, 0, 0]]
    while stack:
        siblings, k, r = stack[-1]
        level = len(stack)
        if not siblings:
            missing(level, r, 2 * level - 2)
        if k >= len(siblings):
            stack.pop()
            continue
        stack[-1][1] += 1
        r, node = r if k == 0 else level, siblings[k]
        if node is None:
            missing(level, r, 2 * level - 1)
            continue
        if level >= low:
            for leaf, x in zip(LEAVES, node.values):
                out[level - low][leaf].append((r, 2 * level, x))
        if level + 1 < high:
            stack.append([node.kids, 0, r])
    return out


def shredded(payload: str | None) -> Iterator[Columns]:
    """The leaf columns by nesting level, from 1; none if the payload is no complete JSON.

    A short branch has an entry in the columns of all deeper levels, so of a tree
    that is both deep and wide only some levels are written at a time.
    """
    top, count, height = tree(payload)
    step = max(1, MOST_ENTRIES // max(1, count))
    for low in range(1, height + 1, step):
        yield from band(top, low, min(height + 1, low + step))


def assembled(levels: Iterable[Columns]) -> Iterator[dict[str, Any]]:
    """The nodes, from the level sequences of each level's columns."""
    for depth, columns in enumerate(levels, start=1):
        at = [-1] + [0] * (depth - 1)
        for kind, title, page, end in zip(*(columns[leaf] for leaf in LEAVES)):
            r, d, _ = kind
            if r == 0:
                at = [0] * depth
            else:
                at[r - 1] += 1
                at[r:] = [0] * (depth - r)
            if d == 2 * depth:
                yield {
                    "node_path": ".".join(map(str, at)),
                    "parent_path": ".".join(map(str, at[:-1])),
                    "depth": depth - 1,
                    "ord": at[-1],
                    "title": title[2],
                    "page": page[2],
                    "end_page": end[2],
                }


NODE_SCHEMA = "record_id long, doc_id long, node_path string, parent_path string, depth int, ord int, title string, page int, end_page int"
COLUMN_SCHEMA = "record_id long, path string, seq long, r int, d int, value string"


def distinct_records(raw: DataFrame) -> DataFrame:
    held = raw.select("record_id", "doc_id", "payload").filter(F.col("payload").isNotNull())
    return spread(held, "record_id", "doc_id", "payload").distinct()


def handed_on(rows: Iterator[tuple], size: Callable[[tuple], int]) -> Iterator[list[tuple]]:
    """The rows in parts of bounded number and size."""
    part, characters = [], 0
    for row in rows:
        part.append(row)
        characters += size(row)
        if len(part) >= MOST_ROWS or characters >= MOST_CHARACTERS:
            yield part
            part, characters = [], 0
    yield part


def leaf_columns(raw: DataFrame) -> DataFrame:
    """(record_id, path, seq, r, d, value): the shredded form as a table."""

    def rows(frame: pd.DataFrame) -> Iterator[tuple]:
        for record, payload in zip(frame["record_id"], frame["payload"]):
            for level, columns in enumerate(shredded(payload)):
                for leaf, entries in columns.items():
                    path = "items" + ".children" * level + "." + leaf
                    yield from ((record, path, k, r, d, None if v is None else str(v)) for k, (r, d, v) in enumerate(entries))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in handed_on(rows(frame), lambda row: len(row[1])):
                yield pd.DataFrame(part, columns=["record_id", "path", "seq", "r", "d", "value"])

    return distinct_records(raw).mapInPandas(run, COLUMN_SCHEMA)


def outline_nodes(raw: DataFrame) -> DataFrame:
    """One row a node of each readable payload, read back from the level sequences."""
    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]

    def rows(frame: pd.DataFrame) -> Iterator[tuple]:
        for record, doc, payload in zip(frame["record_id"], frame["doc_id"], frame["payload"]):
            for node in assembled(shredded(payload)):
                yield (record, doc, *(node[c] for c in names[2:]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in handed_on(rows(frame), lambda row: 2 * len(row[2])):
                yield pd.DataFrame(part, columns=names).astype({"page": "Int32", "end_page": "Int32", "doc_id": "Int64"})

    return distinct_records(raw).mapInPandas(run, NODE_SCHEMA)
