"""Differences between two copies of a keyed data set.

Method: set reconciliation with characteristic polynomials. Every row of a copy
becomes one element of GF(2^61 - 1), a 60-bit hash of its key and fields. Rows
fall into buckets by their key; of each bucket and copy only the values of the
characteristic polynomial prod(z - x) at a few points z are kept. The quotient of
the two copies' values is a rational function whose numerator and denominator
have the elements of one copy only as roots. It is reconstructed by the extended
Euclidean algorithm in quadratic time, checked by points beyond the bound on its
degree, and factored. Buckets that fail the check are taken again with the bound
doubled; as the bound passes the number of elements in a bucket, a sketch would be
larger than they are, so they are compared themselves and every bucket ends. The
recovered hashes fetch the rows that differ, and those are compared field by field.

Defined cases: null and blank keys name no row; null and blank fields are equal;
repeated rows count once; empty tables give one-sided rows only or none.
"""

from __future__ import annotations

import functools
import itertools
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import checkpoint, spread

P = (1 << 61) - 1
#: Elements are below 2^60, points above, so no point is ever an element.
ELEMENT_BITS = 60
ROWS_PER_BUCKET = 16
FIRST_BOUND = 8
CHECK_POINTS = 2


def points(n: int) -> np.ndarray:
    step = 0x9E3779B97F4A7  # odd and below 2^60: distinct points for every n in reach
    return np.array([(1 << ELEMENT_BITS) + (k * step) % ((1 << ELEMENT_BITS) - 1) for k in range(n)], dtype=np.uint64)


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod 2^61 - 1 in 64-bit arithmetic, by halves of 31 bits."""
    low = np.uint64((1 << 31) - 1)
    s31, s30, m30, p, one = np.uint64(31), np.uint64(30), np.uint64((1 << 30) - 1), np.uint64(P), np.uint64(1)
    a1, a0, b1, b0 = a >> s31, a & low, b >> s31, b & low
    mid = a1 * b0 + a0 * b1
    total = ((a1 * b1) << one) + (mid >> s30) + ((mid & m30) << s31)
    total = (total & p) + (total >> np.uint64(61))
    last = a0 * b0
    total += (last & p) + (last >> np.uint64(61))
    total = (total & p) + (total >> np.uint64(61))
    return np.where(total >= p, total - p, total)


def bucket_products(bucket: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their sizes and prod(z - x) of each bucket at each point."""
    order = np.argsort(bucket, kind="stable")
    bucket, x = bucket[order], x[order].astype(np.uint64)
    names, first, size = np.unique(bucket, return_index=True, return_counts=True)
    values = np.ones((len(names), len(z)), dtype=np.uint64)
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        gap = (z[None, :] - x[first[rows] + k][:, None]) % np.uint64(P)
        values[rows] = mulmod(values[rows], gap)
    return names, size, values


# Polynomials over GF(P): lists of coefficients, lowest first, no leading zero.


def trim(a: list[int]) -> list[int]:
    while a and a[-1] == 0:
        a.pop()
    return a


def divided(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    rest, out, inv = a[:], [0] * max(0, len(a) - len(b) + 1), pow(b[-1], -1, P)
    for k in range(len(a) - len(b), -1, -1):
        factor = rest[k + len(b) - 1] * inv % P
        out[k] = factor
        if factor:
            for i, c in enumerate(b):
                rest[k + i] = (rest[k + i] - factor * c) % P
    return trim(out), trim(rest)


def product(a: list[int], b: list[int]) -> list[int]:
    out = [0] * (len(a) + len(b) - 1) if a and b else []
    for i, c in enumerate(a):
        for j, d in enumerate(b):
            out[i + j] = (out[i + j] + c * d) % P
    return trim(out)


def common(a: list[int], b: list[int]) -> list[int]:
    while b:
        a, b = b, divided(a, b)[1]
    inv = pow(a[-1], -1, P)
    return [c * inv % P for c in a]


def value(a: list[int], z: int) -> int:
    out = 0
    for c in reversed(a):
        out = (out * z + c) % P
    return out


@functools.cache
def newton(n: int) -> tuple[list[int], list[list[int]], list[int]]:
    """The first n points, the inverses of their differences, and the product of all x - z."""
    z = [int(x) for x in points(n)]
    inverses = [[pow(z[k] - z[j], -1, P) for j in range(k)] for k in range(n)]
    whole = [1]
    for x in z:
        whole = [(c - x * d) % P for c, d in zip([0, *whole], [*whole, 0])]
    return z, inverses, whole


def through(v: list[int]) -> list[int]:
    """The polynomial of least degree with the values v at the points."""
    z, inverses, _ = newton(len(v))
    slopes: list[int] = []
    for k, y in enumerate(v):
        for j in range(k):
            y = (y - slopes[j]) * inverses[k][j] % P
        slopes.append(y)
    out: list[int] = []
    for x, c in zip(reversed(z), reversed(slopes)):
        out = [(a - x * b) % P for a, b in zip([0, *out], [*out, 0])]
        out[0] = (out[0] + c) % P
    return trim(out)


def reconstructed(v: list[int], extra: int) -> tuple[list[int], list[int]] | None:
    """Monic numerator and denominator of least degree with num/den = v at the points.

    extra is the elements of the first copy less those of the second, the
    difference of the degrees; null if no fraction of less degree than points allow has it.
    """
    n = len(v)
    if abs(extra) >= n:
        return None
    most = (n - 1 + extra) // 2
    r0, r1 = newton(n)[2], through(v)
    t0: list[int] = []
    t1 = [1]
    while len(r1) - 1 > most:
        q, r = divided(r0, r1)
        step = product(q, t1)
        size = max(len(t0), len(step))
        t = trim([((t0[k] if k < len(t0) else 0) - (step[k] if k < len(step) else 0)) % P for k in range(size)])
        r0, r1, t0, t1 = r1, r, t1, t
    if not r1 or not t1 or len(r1) - len(t1) != extra:
        return None
    out = []
    for side in (r1, t1):
        inv = pow(side[-1], -1, P)
        out.append([c * inv % P for c in side])
    # both sides are monic, as the copies' polynomials are
    return (out[0], out[1]) if r1[-1] == t1[-1] else None


def roots(a: list[int], rng: random.Random, splits: bool = False) -> list[int] | None:
    """All roots of a product of distinct linear factors; None if a is no such product. splits: it is known to be one."""
    if len(a) <= 1:
        return []
    if len(a) == 2:
        return [-a[0] * pow(a[1], -1, P) % P]

    if len(a) == 3:
        # P is 3 mod 4, so a root of a square is a power of it
        half = pow(2 * a[2], -1, P)
        square = (a[1] * a[1] - 4 * a[0] * a[2]) % P
        root = pow(square, (P + 1) // 4, P)
        return [(root - a[1]) * half % P, (-root - a[1]) * half % P] if square and root * root % P == square else None

    def powered(base: list[int], n: int) -> list[int]:
        out: list[int] = [1]
        for bit in bin(n)[2:]:
            out = divided(product(out, out), a)[1]
            if bit == "1":
                out = divided(product(out, base), a)[1]
        return out

    if not splits and powered([0, 1], P) != [0, 1]:
        return None
    while True:
        half = powered([rng.randrange(P), 1], (P - 1) // 2)
        half = trim([(c - (k == 0)) % P for k, c in enumerate(half or [0])])
        part = common(a, half) if half else a
        if 1 < len(part) < len(a):
            left, right = roots(part, rng, True), roots(divided(a, part)[0], rng, True)
            return None if left is None or right is None else left + right


def solved(va: list[int], vb: list[int], extra: int, bound: int) -> tuple[list[int], list[int]] | None:
    """Elements of the first and of the second copy only; None if the bound does not suffice."""
    v = [x * pow(y, -1, P) % P for x, y in zip(va, vb)]
    if extra == 0 and all(x == 1 for x in v):
        return [], []
    found = reconstructed(v, extra)
    # every point beyond the degrees is a check
    if found is None or len(found[0]) + len(found[1]) - 2 > bound:
        return None
    num, den = found
    if any(value(num, x) != y * value(den, x) % P for x, y in zip(newton(len(v))[0], v)):
        return None
    rng = random.Random(len(v))
    left, right = roots(num, rng), roots(den, rng)
    return None if left is None or right is None else (left, right)


def reconciled(bucket: np.ndarray, side: np.ndarray, x: np.ndarray, bound: int, outright: bool) -> list[tuple[int, int, int]]:
    """(bucket, side, x) of the elements that one side only has; side -1 marks a bucket that the bound does not suffice for."""
    z = points(bound + 2 + CHECK_POINTS)
    names = np.unique(bucket)
    size, values = np.zeros((2, len(names)), dtype=np.int64), np.ones((2, len(names), len(z)), dtype=np.uint64)
    for k in (0, 1):
        own, n, v = bucket_products(bucket[side == k], x[side == k], z)
        at = np.searchsorted(names, own)
        size[k, at], values[k, at] = n, v
    same = (size[0] == size[1]) & (values[0] == values[1]).all(axis=1)
    out: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(~same):
        name = int(names[k])
        if outright and size[:, k].sum() <= bound:
            rows = [set(x[(bucket == name) & (side == j)].tolist()) for j in (0, 1)]
            found: tuple[list[int], list[int]] | None = (list(rows[0] - rows[1]), list(rows[1] - rows[0]))
        else:
            found = solved(values[0, k].tolist(), values[1, k].tolist(), int(size[0, k] - size[1, k]), bound)
        out += [(name, -1, 0)] if found is None else [(name, j, e) for j in (0, 1) for e in found[j]]
    return out


def recovered(elements: DataFrame, bound: int, outright: bool = False) -> DataFrame:
    """(bucket, side, x) of the elements (bucket, side, x) of one copy only; side -1 marks an unsolved bucket.

    The elements of a bucket come together once; both copies' sketches are made
    and divided where they lie. Buckets are even, as they are taken by hash.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in itertools.chain(frames, [None]):
            held = pd.concat([f for f in (rest, frame) if f is not None]) if rest is not None or frame is not None else None
            if held is None or held.empty:
                continue
            # the last bucket may go on
            going = held["bucket"] == held["bucket"].iloc[-1] if frame is not None else np.zeros(len(held), dtype=bool)
            part, rest = held[~going], held[going]
            if len(part):
                rows = reconciled(part["bucket"].to_numpy(), part["side"].to_numpy(), part["x"].to_numpy(), bound, outright)
                yield pd.DataFrame(rows, columns=["bucket", "side", "x"])

    return spread(elements.select("bucket", "side", "x"), "bucket").sortWithinPartitions("bucket").mapInPandas(run, "bucket long, side int, x long")


def differing_elements(elements: DataFrame, first_bound: int = FIRST_BOUND) -> DataFrame:
    """(bucket, side, x) of the elements that only one of the copies 0 and 1 has."""
    bound, left, out = first_bound, elements, None
    while True:
        part = checkpoint(recovered(left, bound, bound > first_bound))
        known = part.filter("side >= 0")
        out = known if out is None else out.unionByName(known)
        failed = part.filter("side < 0").select("bucket")
        if failed.isEmpty():
            return out
        left = left.join(failed, "bucket", "left_semi")
        bound *= 2


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], first_bound: int = FIRST_BOUND) -> DataFrame:
    """Rows (key, in_left, in_right, left_<field>, right_<field>) of keys whose rows differ or lack a partner.

    Both sides have the key and the fields, at most one row a key (repeated rows
    count once). Null equals null.
    """
    rows = [side.select(key, *fields).filter(F.col(key).isNotNull()).distinct() for side in (left, right)]
    parts = checkpoint(
        rows[0].withColumn("side", F.lit(0)).unionByName(rows[1].withColumn("side", F.lit(1)))
    )
    buckets = max(1, parts.count() // (2 * ROWS_PER_BUCKET))
    mark: Column = F.struct(key, *fields)
    elements = parts.select(
        F.pmod(F.xxhash64(F.lit("bucket"), key), F.lit(buckets)).alias("bucket"),
        "side",
        # to_json drops null fields, so a null and an empty text stay apart
        F.shiftrightunsigned(F.xxhash64(F.to_json(mark)), 64 - ELEMENT_BITS).alias("x"),
        key,
        *fields,
    )
    found = differing_elements(elements, first_bound)
    hit = elements.join(found, ["bucket", "side", "x"], "left_semi")
    one, two = (hit.filter(F.col("side") == s).select(F.col(key), *[F.col(f).alias(f"{n}_{f}") for f in fields], F.lit(True).alias(f"in_{n}")) for s, n in ((0, "left"), (1, "right")))
    out = one.join(two, key, "full_outer")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_left", "in_right")})


def file_id(raw: Column) -> Column:
    """Trimmed and in lower case; null if nothing remains."""
    text = F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))
    return F.when(text != "", text)


def digest_value(raw: Column) -> Column:
    """One spelling of a 256-bit value: 64 hex digits in lower case.

    Takes hex in either case, with an algorithm name or 0x before it and blanks,
    colons or hyphens inside, and base64 in both alphabets. Blank gives null,
    another text itself, trimmed and in lower case.
    """
    text = F.regexp_replace(raw, r"(?U)\s+", "")
    bare = F.regexp_replace(text, r"(?i)^(sha-?2?-?256[:=\-]+|0x)", "")
    hexed = F.lower(F.regexp_replace(bare, r"(?i)^0x|[:\-]", ""))
    base = F.regexp_replace(F.translate(bare, "-_", "+/"), "=+$", "")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string"))
        .when(hexed.rlike("^[0-9a-f]{64}$"), hexed)
        .when(base.rlike("^[A-Za-z0-9+/]{43}$"), F.lower(F.hex(F.try_to_binary(F.concat(base, F.lit("=")), F.lit("base64")))))
        .otherwise(F.lower(text))
    )


def archive_differences(manifest: DataFrame, upload: DataFrame, first_bound: int = FIRST_BOUND) -> DataFrame:
    """(id, diff): files of the archive that one table lacks or whose size or checksum differ.

    Of several checks of a file the one with the latest verified_at counts; a
    check without a time comes before all others, ties fall to the larger values.
    """
    one = manifest.select(file_id(F.col("id")).alias("id"), F.col("bytes").cast("long").alias("bytes"), digest_value(F.col("sha256")).alias("sha256"))
    one = one.filter("id is not null").groupBy("id").agg(F.max(F.struct("bytes", "sha256")).alias("v")).select("id", "v.*")
    two = upload.select(
        file_id(F.col("id")).alias("id"), "verified_at", F.col("size").cast("long").alias("bytes"), digest_value(F.col("digest")).alias("sha256")
    )
    two = two.filter("id is not null").groupBy("id").agg(F.max(F.struct("verified_at", "bytes", "sha256")).alias("v")).select("id", "v.bytes", "v.sha256")
    diff = differences(one, two, "id", ["bytes", "sha256"], first_bound)
    both = F.col("in_left") & F.col("in_right")
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("in_right"), F.lit("only_manifest")),
            F.when(~F.col("in_left"), F.lit("only_upload")),
            F.when(both & ~F.col("left_bytes").eqNullSafe(F.col("right_bytes")), F.lit("bytes")),
            F.when(both & ~F.col("left_sha256").eqNullSafe(F.col("right_sha256")), F.lit("sha256")),
        )
    )
    return diff.select("id", F.explode(kinds).alias("diff"))
