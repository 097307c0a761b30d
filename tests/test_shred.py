from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.operators import shred as S


def plain(siblings, path=()):
    """The nodes by walking the tree."""
    for k, x in enumerate(siblings):
        if isinstance(x, (dict, str)):
            yield ".".join(map(str, (*path, k))), ".".join(map(str, path)), x if isinstance(x, str) else x.get("title")
            if isinstance(x, dict):
                yield from plain(S.elements(x.get("children")), (*path, k))


node = st.deferred(lambda: st.one_of(st.none(), st.text(min_size=1, max_size=3).filter(lambda s: s.strip() and s[0] not in "[{\"0123456789-tfnNI"), st.fixed_dictionaries({"title": st.text(max_size=3)}, optional={"children": st.one_of(st.none(), st.lists(node, max_size=3))})))


@settings(max_examples=150, deadline=None)
@given(st.lists(node, max_size=4))
def test_levels_give_back_the_tree(items):
    got = sorted((n["node_path"], n["parent_path"], n["title"]) for n in S.assembled(S.shredded(json.dumps({"items": items}))))
    assert got == sorted(plain(items))


def nodes(payload):
    return sorted((n["node_path"], n["parent_path"], n["title"], n["page"]) for n in S.assembled(S.shredded(payload)))


def test_children_in_other_forms():
    inner = [{"title": "a", "pageNumber": "7"}, None, "bare"]
    want = [("0", "", "t", 1), ("0.0", "0", "a", 7), ("0.2", "0", "bare", None)]
    for held in (inner, json.dumps(inner)):
        assert nodes(json.dumps({"outline": {"items": [{"title": "t", "pageNumber": 1, "children": held}]}})) == want
    assert nodes(json.dumps([{"title": "t", "children": {"title": "only", "children": {"title": "deep"}}}])) == [("0", "", "t", None), ("0.0", "0", "only", None), ("0.0.0", "0.0", "deep", None)]


def test_unreadable_payloads_give_nothing():
    for payload in (None, "", "  ", "{", '[{"title": "a"', "null", "{}", '{"available": false}', '{"available": true, "items": null}'):
        assert nodes(payload) == []


def test_deep_nesting_and_long_titles():
    payload: object = {"title": "x" * 100_000}
    for _ in range(150):
        payload = {"title": "n", "children": [payload]}
    got = nodes(json.dumps([payload]))
    assert len(got) == 151 and max(len(n[2]) for n in got) == 100_000


def test_tables(spark):
    rows = [(1, 10, '[{"title":"a","children":["b"]}]', "x"), (1, 10, '[{"title":"a","children":["b"]}]', "x"), (2, None, "{", None), (3, 11, None, None)]
    raw = spark.createDataFrame(rows, "record_id long, doc_id long, payload string, title string")
    got = sorted((r.record_id, r.node_path, r.parent_path, r.title) for r in S.outline_nodes(raw).collect())
    assert got == [(1, "0", "", "a"), (1, "0.0", "0", "b")]
    paths = {r.path for r in S.leaf_columns(raw).collect()}
    assert "items.title" in paths and "items.children.kind" in paths
    assert S.outline_nodes(raw.limit(0)).count() == 0


def test_any_depth(spark):
    deep = 10_000
    payload = '[{"title":"n","children":' * deep + "null" + "}]" * deep
    rows = spark.createDataFrame([(1, 1, payload), (2, 2, payload[:-1]), (3, 3, '["x"]')], "record_id long, doc_id long, payload string")
    got = S.outline_nodes(rows).selectExpr("record_id", "depth", "length(node_path) n").groupBy("record_id").agg({"depth": "max", "n": "max", "*": "count"}).collect()
    assert {(r.record_id, r["count(1)"], r["max(depth)"], r["max(n)"]) for r in got} == {(1, deep, deep - 1, 2 * deep - 1), (3, 1, 0, 1)}


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=3)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=2), x, max_size=3)), max_leaves=12))
def test_the_reader_with_a_stack(held):
    text = json.dumps(held, indent=1)
    assert S.parsed_deep(text) == held
    if isinstance(held, (list, dict)):
        for broken in (text[:-1], text + "]", text.replace(":", "", 1) if isinstance(held, dict) and held else text[1:]):
            try:
                S.parsed_deep(broken)
            except ValueError:
                continue
            raise AssertionError(broken)


def test_bands_give_the_same_columns():
    items = [{"title": "a", "children": [{"title": "b", "children": ["c", None]}, "d"]}, None, "e"]
    top, count, height = S.tree(json.dumps(items))
    whole = S.band(top, 1, height + 1)
    assert height == 3 and [c for low in (1, 2, 3) for c in S.band(top, low, low + 1)] == whole
