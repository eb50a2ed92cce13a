import hashlib
import random

import numpy as np
import pytest

from ledgerline.llm import block_clusters, vector_codes
from ledgerline.llm.integer_vectors import Sums, means, whole_vectors

SCHEMA = "vec_id long, embedding array<double>, label int, x string, id int, square int, kept string"


def frame(spark, vectors, ids=None):
    """Vectors in a table with more columns, of names that the operators use inside."""
    ids = list(range(len(vectors))) if ids is None else ids
    return spark.createDataFrame([(i, v, None if n % 5 == 0 else n % 3, "x", 1, 2, "k") for n, (i, v) in enumerate(zip(ids, vectors, strict=True))], SCHEMA)


def crowd(n, dims, seed, spread=0.2, centres=6):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 1, (centres, dims))
    return (middle[r.integers(0, centres, n)] + r.normal(0, spread, (n, dims))).tolist()


def plain_means(assigned, old):
    return [[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := [x for i, x in assigned if i == e]) else entry for e, entry in enumerate(old)]


def nearest(x, entries):
    distances = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return distances.index(min(distances)), min(distances)


def floors(vector, scale):
    return [int(np.floor(scale * float(c))) for c in vector]


def plain_clusters(rows, scale=1024, k=8, rounds=10, seed=3):
    """rows: (id, vector) that take part. Brute force, in Python's integers."""
    rows = [(i, floors(v, scale)) for i, v in rows]
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    now = [x for _, x in order[:k]]
    for _ in range(rounds):
        now = plain_means([(nearest(x, now)[0], x) for _, x in rows], now)
    return [(i, *nearest(x, now)) for i, x in rows], now


def plain_codes(rows, scale=4096, parts=8, entries=16, rounds=6):
    rows = [(i, floors(v, scale)) for i, v in rows]
    width = len(rows[0][1]) // parts
    order, codes, errors, books = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), ["" for _ in rows], [0 for _ in rows], []
    for p in range(parts):
        cut = lambda x, p=p: x[p * width : (p + 1) * width]
        book = [cut(x) for _, x in order[:entries]]
        for _ in range(rounds):
            book = plain_means([(nearest(cut(x), book)[0], cut(x)) for _, x in rows], book)
        for n, (_, x) in enumerate(rows):
            at, d = nearest(cut(x), book)
            codes[n], errors[n] = codes[n] + f"{at:02x}", errors[n] + d
        books.append(book)
    return [(i, c, e) for (i, _), c, e in zip(rows, codes, errors, strict=True)], books


def odd_rows(dims, seed):
    """Vectors with ties, repeated rows and ids, null ids, and those that take no part."""
    good = crowd(60, dims, seed)
    good += [good[3]] * 5 + [[0.0] * dims] * 3 + [[-0.0] * dims] + [[-1e-9] * dims] + [[0.5] * dims, [-0.5] * dims] + good[:4]
    ids = [*range(60), *[3] * 5, *range(100, 103), 7, 8, 9, 10, None, None, *range(2)]
    assert len(ids) == len(good)
    bad = [None, [None] * dims, [float("nan")] + [0.0] * (dims - 1), [float("inf")] * dims]
    return good, ids, bad, [None, 1, 2, 3]


key = lambda rows: sorted(map(repr, rows))


@pytest.mark.parametrize("k", [3, 8, 200])
def test_clusters_against_brute_force(spark, k):
    good, ids, bad, bad_ids = odd_rows(20, 1)
    short = [[1.0] * 19, [], [1.0] * 21]
    table = frame(spark, good + bad + short, ids + bad_ids + [1, 2, 3]).repartition(5)
    got, centroids = block_clusters.cluster_vectors(table, dims=20, k=k)
    want, middle = plain_clusters(list(zip(ids, good, strict=True)), k=k)
    assert centroids == middle and got.columns == ["vec_id", "cluster", "distance", "compared"]
    assert key((r.vec_id, r.cluster, r.distance) for r in got.collect()) == key(want)


def test_clusters_of_nothing_and_of_one_point(spark):
    nothing, none = block_clusters.cluster_vectors(frame(spark, [None, [1.0]], [1, 2]))
    assert nothing.count() == 0 and none == [] and nothing.columns == ["vec_id", "cluster", "distance", "compared"]
    same, middle = block_clusters.cluster_vectors(frame(spark, [[0.25] * 64] * 10), k=4)
    assert {(r.cluster, r.distance) for r in same.collect()} == {(0, 0)} and middle == [[256] * 64] * 4


def test_bounds_of_norms_never_exceed_distances():
    r = np.random.default_rng(5)
    for size in (3, 2_000, 2**27):
        x, c = r.integers(-size, size + 1, (300, 64)), r.integers(-size, size + 1, (9, 64))
        c[3] = x[4]
        c[5] = 2 * x[6] // 2
        place, least, compared = block_clusters.nearest_centroids(x, (x * x).sum(axis=1), block_clusters.segment_norms(x), c)
        every = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
        assert least.tolist() == every.min(axis=1).tolist() and place.tolist() == every.astype(float).argmin(axis=1).tolist()
        assert compared.min() >= 1


def test_screening_spares_most_comparisons():
    r = np.random.default_rng(6)
    scale = r.uniform(0, 4000, (30, 8)).repeat(8, axis=1)  # centroids that differ in the norms of their segments
    c = (scale * r.choice([-1, 1], scale.shape)).astype(np.int64)
    x = c[r.integers(0, 30, 500)] + r.integers(-60, 61, (500, 64))
    _, _, compared = block_clusters.nearest_centroids(x, (x * x).sum(axis=1), block_clusters.segment_norms(x), c)
    assert compared.mean() < 0.2 * len(c)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large for distances of 64 bits"):
        block_clusters.cluster_vectors(frame(spark, [[1e300] * 64]))


def test_sums_are_exact_and_floor_down(spark):
    sums = Sums(3, 2)
    sums.add(np.array([2, 0, 2]), np.array([[-1, 2**40], [5, 5], [0, 2**40 + 1]]))
    rows = [(r["slot"], r["n"], r["sums"]) for r in sums.rows().to_pylist()] + [(2, 1, [-1, 0])]
    assert means(spark.createDataFrame(rows, "slot int, n long, sums array<long>")) == {0: [5, 5], 2: [-1, (2**41 + 1) // 3]}


@pytest.mark.parametrize("entries", [1, 5, 16, 100])
def test_codes_against_brute_force(spark, entries):
    good, ids, bad, bad_ids = odd_rows(24, 2)
    table = frame(spark, good + bad, ids + bad_ids).repartition(5)
    got, books = vector_codes.compress_vectors(table, keep="label", entries=entries)
    want, plain_books = plain_codes(list(zip(ids, good, strict=True)), entries=entries)
    assert books == plain_books and got.columns == ["vec_id", "code", "error", "label"]
    assert key((r.vec_id, r.code, r.error) for r in got.collect()) == key(want)
    labels = key((r.vec_id, r.label) for r in got.select("vec_id", "label").collect())
    assert labels == key((i, None if n % 5 == 0 else n % 3) for n, i in enumerate(ids))


def test_codes_of_nothing_and_of_lengths_that_differ(spark):
    nothing, none = vector_codes.compress_vectors(frame(spark, [None], [1]), keep="label")
    assert nothing.count() == 0 and none == [] and nothing.columns == ["vec_id", "code", "error", "label"]
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9]):
        with pytest.raises(ValueError, match="cannot be cut into 8 parts"):
            vector_codes.compress_vectors(frame(spark, vectors))
    with pytest.raises(ValueError, match="1 to 256"):
        vector_codes.compress_vectors(frame(spark, [[1.0] * 8]), entries=257)
    empty, books = vector_codes.compress_vectors(frame(spark, [[], []]))
    assert [(r.code, r.error) for r in empty.collect()] == [("00" * 8, 0)] * 2 and books == [[[], []]] * 8


def test_ball_trees_find_the_lowest_of_the_nearest():
    r = np.random.default_rng(7)
    for size, m in ((2, 40), (50, 200), (2**28, 60)):
        entries = r.integers(-size, size + 1, (m, 3))
        entries[m // 2] = entries[1]
        parts = np.concatenate((r.integers(-size, size + 1, (400, 3)), entries))
        place, least = vector_codes.BallTree(entries).nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert place.tolist() == every.argmin(axis=1).tolist() and least.tolist() == every.min(axis=1).tolist()


def test_ball_trees_leave_most_entries_out():
    r = random.Random(8)
    entries = np.array([[r.gauss(0, 1000) for _ in range(2)] for _ in range(256)]).astype(np.int64)
    tree = vector_codes.BallTree(entries)
    tree.nearest(entries[np.arange(2000) % 256] + 3)
    assert tree.compared < 0.25 * 2000 * 256


def test_codes_give_vectors_back(spark):
    table = frame(spark, crowd(200, 16, 9, spread=0.01))
    got, books = vector_codes.compress_vectors(table)
    back = {r.vec_id: np.array(r.vector) for r in vector_codes.decode_vectors(got, books).collect()}
    errors = {r.vec_id: r.error for r in got.collect()}
    for r in whole_vectors(table, "embedding", vector_codes.SCALE, id="vec_id").collect():
        assert ((back[r.id] * vector_codes.SCALE - np.array(r.x)) ** 2).sum() == errors[r.id]
    assert vector_codes.decode_vectors(spark.createDataFrame([(None,)], "code string"), books).first().vector is None
