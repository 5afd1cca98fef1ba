"""Hexagons, distances of distributions and folds, against plain versions."""

import math
import random

import pytest

from stopwise.operators import baseline, distribution, monitoring
from tests.helpers import frame


def plain_hexagons(points, across):
    up = int(across / math.sqrt(3))
    xs, ys = [x for x, _ in points], [y for _, y in points]
    sx, sy = ((max(v) - min(v) or 1.0) / n for v, n in ((xs, across), (ys, up)))
    counts = {}
    for x, y in points:
        ix, iy = (x - min(xs)) / sx, (y - min(ys)) / sy
        a, b = (math.floor(ix + 0.5), math.floor(iy + 0.5)), (math.floor(ix) + 0.5, math.floor(iy) + 0.5)
        gap = lambda c: (ix - c[0]) ** 2 + 3 * (iy - c[1]) ** 2
        best = a if gap(a) <= gap(b) else b
        key = round(2 * best[0]), round(2 * best[1])
        counts[key] = counts.get(key, 0) + 1
    return counts


@pytest.mark.parametrize("seed", [1, 2])
def test_hexagons(spark, seed):
    rng = random.Random(seed)
    # Points on the edges of cells as well.
    points = [(rng.choice([rng.random() * 10, rng.randint(0, 40) / 4]), rng.choice([rng.random() * 5, rng.randint(0, 20) / 4])) for _ in range(400)]
    df = frame(spark, points + [(None, 1.0), (1.0, None), (float("nan"), 2.0)], "a double, b double")
    got = distribution.hexagon_density(df, "a", "b", 8).collect()
    assert {(r["x_half"], r["y_half"]): r["count"] for r in got} == plain_hexagons(points, 8)
    assert all((r["x_half"] + r["y_half"]) % 2 == 0 for r in got)
    assert distribution.hexagon_density(df.limit(0), "a", "b").count() == 0
    assert distribution.hexagon_density(frame(spark, [(1.0, 2.0)] * 3, "a double, b double"), "a", "b").first()["count"] == 3


def plain_distance(a, b):
    values = sorted(set(a) | set(b))
    gaps = [(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)), -v) for v in values]
    best = max((round(g, 12), v) for g, v in gaps)
    return best[0], -best[1]


@pytest.mark.parametrize("seed", range(3))
def test_distance(spark, seed):
    rng = random.Random(seed)
    draw = lambda n, shift: [(rng.choice([None, float("nan"), 0.0, rng.gauss(shift, 1), float(rng.randint(-3, 3)), 1e9 * rng.random()]), rng.choice([None, 5])) for _ in range(n)]
    first, second = draw(150, 0), draw(90, 0.8)
    schema = "x double, y int"
    got = {r["feature"]: r for r in monitoring.distribution_distance(frame(spark, first, schema), frame(spark, second, schema), ["x", "y"]).collect()}
    known = lambda rows: [x for x, _ in rows if x is not None and not math.isnan(x)]
    distance, value = plain_distance(known(first), known(second))
    assert got["x"]["distance"] == pytest.approx(distance) and got["x"]["value"] == value
    assert (got["x"]["training_count"], got["x"]["recent_count"]) == (len(known(first)), len(known(second)))
    assert got["y"]["distance"] == 0
    alone = monitoring.distribution_distance(frame(spark, first, schema), frame(spark, [], schema), ["x"]).first()
    assert alone["distance"] is None and alone["recent_count"] == 0
    assert monitoring.distribution_distance(frame(spark, [], schema), frame(spark, [], schema), ["x"]).count() == 0


def test_folds_are_judged_by_the_others(spark):
    rng = random.Random(3)
    rows = [(f"o{i}", float(rng.choice([1, 2, 3, 100 + i // 40])), float(rng.randint(1, 30))) for i in range(200)]
    df = frame(spark, rows, "web_order_id string, floor double, minutes double")
    got = {r["web_order_id"]: r for r in baseline.cross_validated(df, ["floor"], 4, "minutes").collect()}
    assert len(got) == 200 and {r["fold"] for r in got.values()} == {0, 1, 2, 3}
    for key, floor, _ in rows:
        others = [(f, t) for k, f, t in rows if got[k]["fold"] != got[key]["fold"]]
        cell = [t for f, t in others if f == floor] or [t for _, t in others]
        assert got[key]["predicted"] == pytest.approx(sum(cell) / len(cell))
    assert baseline.cross_validated(df.limit(0), ["floor"], 4, "minutes").count() == 0


def test_stored_rows_are_not_processed_again(spark, sf_dir, monkeypatch):
    from stopwise.plans import catalog

    stored = catalog._stored(spark, sf_dir)
    monkeypatch.setattr(catalog, "process_tables", None)
    assert catalog.load_processed(spark, sf_dir).columns == stored.columns


def test_bounds_of_stored_rows_need_no_join(spark, sf_dir, monkeypatch):
    """The bounds come from the stored target; rows are those of the lazy plan, whose bounds come from weights."""
    from stopwise.plans import catalog, processing

    want = catalog._process(spark, sf_dir)
    monkeypatch.setattr(processing, "row_weights", None)
    stored = catalog._stored(spark, f"{sf_dir}/")  # another name, so that it is stored anew
    assert stored.columns == want.columns and stored.count() == want.count() > 0
    assert stored.exceptAll(want).isEmpty()
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "GreaterThanOrEqual(service_time_in_minutes" in plan.split("PushedFilters:")[1]
