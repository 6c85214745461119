"""Vector codes and hard negatives against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, width, seed, spread=0.2, labels=4):
    rng = np.random.default_rng(seed)
    out = [(int(i), [float(x) for x in rng.normal(0, spread, width).astype(np.float32)], int(rng.integers(labels))) for i in range(n)]
    out += [(n + i, out[i][1], out[i][2]) for i in range(0, n, 9)]  # the same vector again
    return out


ODD = [(None, [0.25] * 16, 1), (9001, None, 1), (9002, [0.5] * 15 + [None], 2), (9003, [float("nan")] + [0.0] * 15, 1), (9004, [float("inf")] + [0.0] * 15, 1), (9005, [0.125] * 16, None), (9100, [0.5, -0.5] * 8, None), (9100, [0.5, -0.5] * 8, 2), (9100, [0.5, -0.5] * 8, 2), (9200, [0.0] * 16, 3)]


def whole(row):
    return row[1] is not None and all(x is not None and math.isfinite(x) for x in row[1])


def scaled(v):
    return [math.floor(256 * x) for x in v]


# 11


def brute_codes(rows, parts, entries, rounds):
    rows = [r for r in rows if whole(r)]
    ints = [scaled(r[1]) for r in rows]
    width = len(ints[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[cut(ints[i], p) for i in first] for p in range(parts)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda v, book: min((d(v, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            near = [pick(cut(v, p), books[p])[1] for v in ints]
            books[p] = [[sum(c) // near.count(k) for c in zip(*(cut(v, p) for v, n in zip(ints, near) if n == k))] if k in near else e for k, e in enumerate(books[p])]
    out = []
    for r, v in zip(rows, ints):
        best = [pick(cut(v, p), books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), r[2]))
    sums = {}
    for o in out:
        sums[o[3]] = sums.get(o[3], 0) + o[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr(o[0]), o[1], o[2], sums[o[3]], sha) for o in out)


@pytest.mark.parametrize("block", [4, 64])
def test_codes_against_every_entry(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    monkeypatch.setattr(vector_codes, "SLICE", 50)
    rows = vectors(150, 16, 1) + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("x")).withColumn("id", F.lit(None)).withColumn("same", F.lit(1)).repartition(3)
    got = vector_codes.vector_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == brute_codes(rows, 16, 64, 2)
    coded, books = vector_codes.compress(df, parts=4, entries=7, rounds=3)
    assert sorted((repr(r["id"]), r["code"], r["error"]) for r in coded.collect()) == [x[:3] for x in brute_codes(rows, 4, 7, 3)]
    assert books.shape == (4, 7, 4)


def test_decoded_vectors_are_as_far_as_the_error(spark):
    rows = vectors(60, 8, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    coded, books = vector_codes.compress(df, parts=4, entries=9)
    ints = {r[0]: scaled(r[1]) for r in rows}
    for r in vector_codes.decode(coded, books).collect():
        assert sum((a - b) ** 2 for a, b in zip(ints[r["id"]], r["vector"])) == r["error"]


def test_codes_of_few_equal_and_large_vectors(spark):
    same = [(i, [1.5] * 16, 0) for i in range(70)]
    got = vector_codes.vector_codes(spark.createDataFrame(same, SCHEMA)).collect()
    assert {(r["code"], r["error"]) for r in got} == {("00" * 16, 0)}
    far = [(i, [float((-1) ** i * 900_000 + i)] * 16, 0) for i in range(90)]
    got = vector_codes.vector_codes(spark.createDataFrame(far, SCHEMA)).collect()
    assert sorted((repr(r[0]), *r[1:]) for r in got) == brute_codes(far, 16, 64, 2)
    assert vector_codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    with pytest.raises(Exception, match="2\\d+ or more"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA)).collect()


def test_shorter_vectors_end_in_zeros(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0], 0), (3, [], 0)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=2)
    assert books.tolist() == [[[256, 512], [256, 0], [0, 0]], [[768, 0], [0, 0], [0, 0]]]
    assert {r["id"]: (r["code"], r["error"]) for r in coded.collect()} == {1: ("0000", 0), 2: ("0101", 0), 3: ("0201", 0)}


def test_hilbert_neighbours_are_one_step_apart():
    side = 16
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    # Ten bits an axis: places of the coarse grid are visited one by one, each next to the one before.
    walk = points[np.argsort(vector_codes.hilbert(points * 64 + np.where(points == side - 1, 63, 0)))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("width", [1, 3, 64])
def test_shortlists_hold_every_nearest_entry(width):
    rng = np.random.default_rng(width)
    points, book = rng.integers(-9, 9, (333, width)).astype(np.int32), rng.integers(-9, 9, (20, width))
    flat = vector_codes.Flat.of(points)
    again = vector_codes.Flat.from_bytes(flat.to_bytes(), len(points), width)
    entry, error = vector_codes.nearest(again, book, True)
    d = ((flat.points[:, None].astype(np.int64) - book) ** 2).sum(axis=2)
    assert (entry == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    sums = vector_codes.part_sums(flat, book)
    assert all((sums[e, :-1] == flat.points[entry == e].sum(axis=0)).all() and sums[e, -1] == (entry == e).sum() for e in range(20))


# 13


def brute_negatives(rows):
    kept = [(i, r[0], r[2] if r[0] is None or r[0] % 7 else (r[2] + 1) % 10, scaled(r[1])) for i, r in enumerate(rows) if r[2] is not None and whole(r)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, a, label, v in kept:
        if a is None or a % 100:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), i, same == label) for m, i, same, w in kept if m != n]
        for s, p, _ in sorted((x for x in score if x[2]), key=order)[:5]:
            hard = sorted((x for x in score if not x[2] and 30 * s <= 100 * x[0] <= 90 * s), key=order)[:10]
            out += [(a, p, k + 1, x[1], s, x[0]) for k, x in enumerate(hard)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("anchors", [2, 4096])
def test_hard_negatives(spark, monkeypatch, anchors):
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "_TILE", 64)
    rows = vectors(400, 16, 3) + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("number", F.lit("x")).withColumn("rank", F.lit(1)).repartition(3)
    got = hard_negatives.hard_negatives(hard_negatives.moved_labels(df)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_long_vectors_and_ties(spark):
    rows = vectors(300, 200, 4, spread=30.0, labels=2)
    got = hard_negatives.hard_negatives(hard_negatives.moved_labels(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(rows)
    ties = [(i, [0.5] * 4 if i % 2 else [0.25] * 4, i % 2) for i in range(220)]
    got = hard_negatives.hard_negatives(hard_negatives.moved_labels(spark.createDataFrame(ties, SCHEMA))).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(ties)


def test_no_anchors_no_negatives(spark):
    for rows in ([], [(1, [1.0], 1)], [(100, [1.0], 1)], [(100, None, None)], [(100, [1.0], 1), (200, [1.0], 2)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("largest", [3, 200, 1 << 20])
def test_scores_are_exact(largest):
    rng = np.random.default_rng(5)
    a, b = rng.integers(-largest, largest + 1, (7, 150)), rng.integers(-largest, largest + 1, (11, 150))
    a[0], b[0] = largest, -largest
    scores = hard_negatives.Scores(a, largest)
    assert (scores.of(slice(0, 7), scores.rows(b)) == a @ b.T).all()
    assert math.prod(scores.primes) > 2 * 150 * largest**2
