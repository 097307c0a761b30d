from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.operators import reconcile as R


def test_mulmod_equals_integers():
    rng = random.Random(1)
    a = [rng.randrange(R.P) for _ in range(500)] + [0, 1, R.P - 1]
    b = [rng.randrange(R.P) for _ in range(500)] + [R.P - 1, R.P - 1, R.P - 1]
    got = R.mulmod(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
    assert [int(x) for x in got] == [x * y % R.P for x, y in zip(a, b)]


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, (1 << 60) - 1), max_size=8), st.sets(st.integers(0, (1 << 60) - 1), max_size=8), st.sets(st.integers(0, (1 << 60) - 1), max_size=40))
def test_polynomials_recover_the_difference(only_a, only_b, both):
    a, b = (only_a | both) - only_b, (only_b | both) - only_a
    z = R.points(16 + 2 + R.CHECK_POINTS)
    values = []
    for side in (a, b):
        xs = np.array(sorted(side), dtype=np.uint64)
        _, _, v = R.bucket_products(np.zeros(len(xs), dtype=np.int64), xs, z)
        values.append([int(x) for x in v[0]] if len(xs) else [1] * len(z))
    found = R.solved(*values, len(a) - len(b), 16)
    assert found is not None
    assert set(found[0]) == a - b and set(found[1]) == b - a


def upload(spark, rows):
    return spark.createDataFrame(rows, "id string, size long, digest string, verified_at timestamp, extra string")


def manifest(spark, rows):
    return spark.createDataFrame(rows, "id string, bytes long, sha256 string, extra string")


def test_differences_by_field(spark):
    from datetime import datetime

    h = bytes(range(32))
    other = "ff" * 32
    t1, t2 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    left = [
        (" A ", 1, h.hex(), "x"), (" A ", 1, h.hex(), "x"), ("b", 2, h.hex().upper(), None), ("c", None, None, None), ("d", 4, "  ", None), ("e", 5, other, None),
        ("gone", 1, other, None), (None, 1, other, None), ("  ", 1, other, None), ("f", 6, h.hex(), None), ("g", 7, "", None),
    ]
    right = [
        ("a", 1, "sha256:" + h.hex(), t1, None), ("B", 2, "sha256-" + base64.b64encode(h).decode(), t1, None), ("c", None, None, t1, None), ("d", 4, None, t1, None),
        ("e", 9, h.hex(), t2, None), ("e", 5, other, t1, None), ("new", 1, other, t1, None), ("f", 6, ":".join(h.hex()[k : k + 2] for k in range(0, 64, 2)), t1, None), ("g", None, other, t1, None),
    ]
    for bound in (2, 16):
        got = {(r.id, r.diff) for r in R.archive_differences(manifest(spark, left), upload(spark, right), bound).collect()}
        assert got == {("gone", "only_manifest"), ("new", "only_upload"), ("e", "bytes"), ("e", "sha256"), ("g", "bytes"), ("g", "sha256")}


def test_bound_doubles_until_all_is_found(spark):
    left = spark.createDataFrame([(str(k), k) for k in range(400)], "k string, v long")
    right = spark.createDataFrame([(str(k), k + (k % 2)) for k in range(100, 500)], "k string, v long")
    got = {r.k for r in R.differences(left, right, "k", ["v"], first_bound=2).collect()}
    assert got == {str(k) for k in range(500) if k < 100 or k >= 400 or k % 2}


@pytest.mark.parametrize("rows", [[], [("a", 1, "00" * 32, None)]])
def test_empty_tables(spark, rows):
    got = R.archive_differences(manifest(spark, rows), upload(spark, [])).collect()
    assert [(r.id, r.diff) for r in got] == [(r[0], "only_manifest") for r in rows]


def test_copies_that_share_nothing(spark):
    rows = [(k % 3, side, (k * 7919 + side) % (1 << 60)) for side in (0, 1) for k in range(400)]
    got = {tuple(r) for r in R.differing_elements(spark.createDataFrame(rows, "bucket long, side int, x long"), 4).collect()}
    sides = [{(b, x) for b, s, x in rows if s == k} for k in (0, 1)]
    assert got == {(b, 0, x) for b, x in sides[0] - sides[1]} | {(b, 1, x) for b, x in sides[1] - sides[0]}
    spark_few = spark.createDataFrame([(0, 0, 5), (0, 1, 5)], "bucket long, side int, x long")
    assert R.differing_elements(spark_few).count() == 0


def test_a_bound_too_small_is_seen():
    z = R.points(4 + 2 + R.CHECK_POINTS)
    a = np.arange(1, 20, dtype=np.uint64) * np.uint64(977)
    _, _, v = R.bucket_products(np.zeros(len(a), dtype=np.int64), a, z)
    assert R.solved(v[0].tolist(), [1] * len(z), len(a), 4) is None
