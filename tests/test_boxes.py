"""Containment against comparing all pairs."""

import random

import pytest

from docquarry.operators import boxes

SCHEMA = "page long, {} long, x0 double, y0 double, x1 double, y1 double"


def brute(inner, outer, slack):
    return sorted((g, i, o) for g, i, *a in inner for h, o, *b in outer if None not in (g, i, o, *a, *b) and g == h and a[0] <= a[2] and a[1] <= a[3] and b[0] <= b[2] and b[1] <= b[3] and a[0] >= b[0] - slack and a[1] >= b[1] - slack and a[2] <= b[2] + slack and a[3] <= b[3] + slack)


def made(rng, n, largest, pages=4):
    out = []
    for i in range(n):
        x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice([0, 1, 7, rng.uniform(0, largest)]), rng.uniform(0, largest)
        out.append((rng.randrange(pages), i, x, y, x + w, y + h))
    return out


@pytest.mark.parametrize("slack", [0.0, 2.0])
def test_equals_all_pairs(spark, slack):
    rng = random.Random(3)
    inner, outer = made(rng, 300, 20), made(rng, 150, 400)
    inner += [(0, 900, *outer[0][2:]), (None, 901, 0.0, 0.0, 1.0, 1.0), (1, 902, None, 0.0, 1.0, 1.0), (1, 903, 5.0, 0.0, 1.0, 1.0), (2, 904, 1e9, 1e9, 1e9, 1e9)]
    outer += [(1, 901, -1e6, -1e6, 1e6, 1e6), (2, None, -1e6, -1e6, 1e6, 1e6), (3, 902, 4.0, 4.0, 4.0, 4.0)]
    got = boxes.contained(spark.createDataFrame(inner, SCHEMA.format("i")), spark.createDataFrame(outer, SCHEMA.format("o")), "page", "i", "o", slack).collect()
    assert sorted(map(tuple, got)) == brute(inner, outer, slack)


def test_a_crowded_cell_and_no_boxes(spark):
    rng = random.Random(4)
    inner = [(0, i, 1.0 + rng.random(), 1.0, 2.5, 2.5) for i in range(3_000)] + made(rng, 100, 10)
    outer = [(0, 1, 0.0, 0.0, 3.0, 3.0), (0, 2, 1.5, 0.5, 3.0, 3.0)]
    a, b = spark.createDataFrame(inner, SCHEMA.format("i")), spark.createDataFrame(outer, SCHEMA.format("o"))
    assert sorted(map(tuple, boxes.contained(a, b, "page", "i", "o", most_crowded=3).collect())) == brute(inner, outer, 0)
    assert boxes.contained(a, b.where("false"), "page", "i", "o").collect() == boxes.contained(a.where("false"), b, "page", "i", "o").collect() == []
    assert boxes.contained(a, b.where("false"), "page", "i", "o").columns == ["page", "i", "o"]
    assert "NestedLoop" not in boxes.contained(a, b, "page", "i", "o")._jdf.queryExecution().executedPlan().toString()
