"""Hard negatives against plain integer scoring of all rows."""

import math
import random

import pytest

from bibliomill.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, anchor boolean, `group` int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    use = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        use.append((i, vec_id, [math.floor(256 * x) for x in vector], label))
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for i, vec_id, vector, label in use:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), x, kind) for j, x, v, kind in use if j != i]
        for score, positive, _ in sorted((c for c in scored if c[2] == label), key=order)[:5]:
            fit = sorted((c for c in scored if c[2] != label and 30 * score <= 100 * c[0] <= 90 * score), key=order)[:10]
            out += [(vec_id, positive, rank, c[1], score, c[0]) for rank, c in enumerate(fit, 1)]
    return sorted(out, key=repr)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 5, True, 1) for r in rows], SCHEMA).repartition(3)
    report = negatives.hard_negatives(frame, **more)
    assert report.columns == COLUMNS
    return sorted((tuple(r) for r in report.collect()), key=repr)


def clustered(rng, n, size, labels=10):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(labels)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        vector = [float(f"{c + rng.gauss(0, 0.7):.3f}") for c in centres[label]]
        rows.append((i, vector, label))
    return rows


def as_float32(rows):
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("references", [0, 1, 16])
def test_same_lists_as_scoring_everything(spark, references):
    rows = as_float32(clustered(random.Random(5), 700, 12))
    assert got(spark, rows, references=references) == brute(rows)


def test_ties_repeated_rows_and_odd_values(spark):
    rng = random.Random(6)
    rows = clustered(rng, 230, 3, 3)
    rows += [rows[0], rows[100], (100, [0.5, 0.5, 0.5], 1), (None, [0.25, 0.25, 0.25], 2), (None, [0.25, 0.25, 0.25], 1)]
    rows += [(300, [0.0, 0.0, 0.0], 1), (400, None, 1), (401, [1.0, None, 1.0], 1), (402, [float("nan"), 0.0, 0.0], 1), (403, [float("inf"), 0.0, 0.0], 1), (404, [1.0, 1.0, 1.0], None)]
    # equal scores by the dozen
    rows += [(1000 + i, [1.0, 0.0, 0.0], i % 2) for i in range(40)] + [(2000 + i, [0.5, 0.0, 0.0], 2 + i % 2) for i in range(40)]
    rows = as_float32(rows)
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_scores_beyond_the_range_of_doubles_are_exact(spark):
    rng = random.Random(7)
    rows = as_float32([(i, [rng.choice([3e5, 2e5, 1.1e5]) * rng.uniform(0.9, 1.1) for _ in range(4)], i % 3) for i in range(120)])
    assert got(spark, rows) == brute(rows)


def test_a_crowd_of_equal_vectors_is_split(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 50)
    rows = as_float32([(i, [1.0, 0.5], i % 2) for i in range(400)])
    assert got(spark, rows) == brute(rows)
