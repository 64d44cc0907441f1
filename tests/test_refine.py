"""Refinement against a plain loop over triangles, and what a round moves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import refine
from tilewright.plans import refine_queries

N = 9
Z = 9  # below level 11 the deviation counts straight up and down
TILES = [(Z, 20, 30), (Z, 21, 30), (Z, 20, 31), (Z, 25, 31)]
STEPS = refine.STEPS
SIZE = math.radians(180.0 / 2**Z) * 6378137.0


def brute(tiles, cells, rounds, intensity):
    """Triangles after ``rounds``, as a set of corners (right angle first), all tiles together."""
    def height(px, py):
        found = []
        for _, x, y in tiles:
            u, v = (px / STEPS - x) * (N - 1), (py / STEPS - y) * (N - 1)
            if 0 <= u <= N - 1 and 0 <= v <= N - 1:
                c, r = int(u), int(v)
                fx, fy = u - c, v - r
                d, s = c + (fx > 0), r + (fy > 0)
                at = lambda i, j: cells[x, y, i, j]
                found.append((at(c, r) * (1 - fx) + at(d, r) * fx) * (1 - fy) + (at(c, s) * (1 - fx) + at(d, s) * fx) * fy)
        return sum(found) / len(found)

    def asks(t):
        (ax, ay), (bx, by), (cx, cy) = t
        metres = math.hypot(bx - cx, by - cy) / STEPS * SIZE
        if metres < SIZE * 0.1 / intensity:
            return False
        if metres > SIZE / 2.5 * 0.2:
            return True
        x, y = (ax + bx + cx) // (3 * STEPS), (ay + by + cy) // (3 * STEPS)
        ha, hb, hc = height(ax, ay), height(bx, by), height(cx, cy)
        worst, det = 0.0, (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
        for i in range(N):
            for j in range(N):
                dx, dy = x * STEPS + i * STEPS // (N - 1) - ax, y * STEPS + j * STEPS // (N - 1) - ay
                s, q = (dx * (cy - ay) - dy * (cx - ax)) / det, ((bx - ax) * dy - (by - ay) * dx) / det
                if s >= 0 and q >= 0 and s + q <= 1:
                    worst = max(worst, abs(cells[x, y, i, j] - (ha + s * (hb - ha) + q * (hc - ha))))
        return worst > SIZE * 0.02 / intensity * (metres / SIZE * 0.8 + 0.2)

    def longest(t):
        return frozenset(t[1:])

    new = []
    for _, x, y in tiles:
        w, s, e, n = x * STEPS, y * STEPS, (x + 1) * STEPS, (y + 1) * STEPS
        new += [((e, s), (w, s), (e, n)), ((w, n), (w, s), (e, n))]
    old = []
    for _ in range(rounds):
        marks = {longest(t) for t in new if asks(t)}
        mesh = old + new
        while True:
            more = {longest(t) for t in mesh if longest(t) not in marks and any(frozenset((t[0], p)) in marks for p in t[1:])}
            if not more:
                break
            marks |= more
        old, new = mesh, []
        for _ in range(2):
            split = [t for t in old + new if longest(t) in marks]
            old = [t for t in old if longest(t) not in marks]
            new = [t for t in new if longest(t) not in marks]
            for a, b, c in split:
                m = ((b[0] + c[0]) // 2, (b[1] + c[1]) // 2)
                new += [(m, a, b), (m, a, c)]
        if not marks:
            break
    return {(t[0], longest(t)) for t in old + new}


@pytest.fixture(scope="module")
def area(spark):
    rnd = random.Random(6)
    rough = {(x, y, i, j): rnd.choice([0, 0, 0, 0, 60 * x % 7, rnd.randrange(900)]) * 1.0 for _, x, y in TILES for i in range(N) for j in range(N)}
    cells = spark.createDataFrame([(Z, *k, v) for k, v in rough.items()], "z long, x long, y long, col long, row long, value double").cache()
    tiles = spark.createDataFrame(TILES, "z long, x long, y long")
    return rough, cells, tiles, spark.sql("select -180.0D w, -90.0D s, 180.0D e, 90.0D n")


@pytest.mark.parametrize("rounds, intensity", [(1, 4.0), (7, 1.2), (9, 1.2), (12, 2.0)])
def test_same_triangles(area, rounds, intensity):
    rough, cells, tiles, extent = area
    t, settled = refine.refine(refine.start(tiles), cells, N, extent, rounds, intensity)
    got = [((r.ax, r.ay), frozenset([(r.bx, r.by), (r.cx, r.cy)])) for r in t.collect()]
    want = brute(TILES, rough, rounds, intensity)
    assert len(got) == len(set(got)) and set(got) == want
    assert settled == refine.flag(t, cells, N, extent, intensity).isEmpty()


def test_one_round_at_a_time(area):
    rough, cells, tiles, extent = area
    t = refine.start(tiles)
    for _ in range(7):
        t, _ = refine.refine_once(t, cells, N, extent, 1.2)
    got = {((r.ax, r.ay), frozenset([(r.bx, r.by), (r.cx, r.cy)])) for r in t.collect()}
    assert got == brute(TILES, rough, 7, 1.2)


def test_missing_cells(spark, area):
    _, cells, tiles, extent = area
    holes = cells.where("(col + row) % 3 > 0 and x <> 25")
    t, settled = refine.refine(refine.start(tiles), holes, N, extent, intensity=1.2)
    assert settled
    v, f = refine.to_tables(t, holes, N)
    assert f.count() == t.count() and v.where("x = 25").agg(F.max(F.abs("h"))).first()[0] == 0.0
    assert refine.refine(refine.start(tiles.limit(0)), cells, N, extent)[0].count() == 0


def test_a_round_moves_neither_cells_nor_triangles(spark, area):
    _, cells, tiles, extent = area
    with refine.Store(spark) as store:
        state, grids, box = refine._begin(store, refine.start(tiles), cells, N, extent)
        plan = refine._tested(state, grids, N, box, 4.0)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        state = store.save(refine._tested(state, grids, N, box, 4.0))
        plan = refine._joined(state, refine._crossing(state))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # the marks that cross borders


def test_rounds_before_the_last_deal_cells_out_once(spark, area, monkeypatch):
    rough, cells, tiles, extent = area
    begun = []
    monkeypatch.setattr(refine, "_begin", lambda *a, real=refine._begin: begun.append(1) or real(*a))
    t, _ = refine.refine_once(refine.start(tiles), cells, N, extent, 1.2, before=6)
    got = {((r.ax, r.ay), frozenset([(r.bx, r.by), (r.cx, r.cy)])) for r in t.collect()}
    assert got == brute(TILES, rough, 7, 1.2) and len(begun) == 1


def test_as_many_rounds_as_it_takes(spark, monkeypatch):
    n = 513
    spike = "IF(col = 77 AND row = 77, 9000.0D, 0.0D)"  # a corner lies there after 17 rounds only
    cells = spark.range(n * n).selectExpr("9L AS z", "20L AS x", "30L AS y", f"id % {n} AS col", f"id div {n} AS row").selectExpr("*", f"{spike} AS value")
    tiles, extent = spark.createDataFrame([(Z, 20, 30)], "z long, x long, y long"), spark.sql("select -180.0D w, -90.0D s, 180.0D e, 90.0D n")
    rounds = []
    monkeypatch.setattr(refine, "_round", lambda *a, real=refine._round: rounds.append(1) or real(*a))
    t, settled = refine.refine(refine.start(tiles), cells, n, extent, rounds=None, intensity=20.0)
    assert settled and len(rounds) > refine.MAX_ROUNDS

    asked = []
    monkeypatch.setattr(refine, "refine", lambda *a, rounds=refine.MAX_ROUNDS: asked.append(rounds) or (t, rounds is None))
    inputs = type("Inputs", (), {"spark": spark, "mesh_tiles": tiles, "tile_cells": cells})
    assert refine_queries.refined(inputs) is t and asked == [None]
