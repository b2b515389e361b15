"""Filters on pixel tables: planted shapes, plain loops, borders, odd rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seriesforge.operators import graph, imaging

PIXEL = "frame long, px long, py long, gray double"


def reflected(i, n):
    return -i if i < 0 else 2 * (n - 1) - i if i >= n else i


def test_blur_equals_plain_loop(spark):
    rnd = random.Random(1)
    width, height = 11, 7
    gray = {(f, x, y): rnd.randrange(256) for f in (0, 3) for x in range(width) for y in range(height)}
    df = spark.createDataFrame([(*k, float(v)) for k, v in gray.items()] + [(None, 1, 1, 5.0), (0, None, 2, 1.0)], PIXEL).repartition(5)
    w = imaging.gaussian(1.5, 3)
    assert sum(w) == imaging.UNIT
    got = {(r.frame, r.px, r.py): r.gray for r in imaging.blurred(df, width, height, 1.5, 3).collect()}
    for (f, x, y), v in got.items():
        total = sum(w[i + 3] * w[j + 3] * gray[f, reflected(x + i, width), reflected(y + j, height)] for i in range(-3, 4) for j in range(-3, 4))
        assert v == (total + imaging.UNIT**2 // 2) // imaging.UNIT**2
    assert len(got) == len(gray)
    assert imaging.blurred(df.limit(0), width, height).count() == 0
    with pytest.raises(ValueError):
        imaging.blurred(df, 4, height, 2.0, 4)


def test_planted_discs_are_found_within_a_pixel(spark):
    """Bright and dark discs on a slope of gray, with noise: each is found, and nothing else."""
    rnd = random.Random(2)
    width, height = 120, 90
    discs = {0: [(30.0, 30.0, 14, 90), (84.0, 52.0, 18, -60)], 1: [(60.0, 45.0, 20, 70)], 2: []}
    rows = []
    for f, circles in discs.items():
        for x in range(width):
            for y in range(height):
                light = sum(v for cx, cy, r, v in circles if (x - cx) ** 2 + (y - cy) ** 2 <= r * r)
                rows.append((f, x, y, float(100 + x // 8 + light + rnd.randrange(-3, 4))))
    found = imaging.found_circles(spark.createDataFrame(rows, PIXEL), width, height, 10, 24, 25, 30.0).collect()
    for f, circles in discs.items():
        own = [r for r in found if r.frame == f]
        assert len(own) == len(circles)
        for cx, cy, radius, _ in circles:
            assert min(math.hypot(r.x - cx, r.y - cy) for r in own) <= 1.0
            assert min(abs(r.r - radius) for r in own if math.hypot(r.x - cx, r.y - cy) <= 1.0) <= 1.0


def test_local_contrast_spreads_gray(spark):
    """A dim, narrow range of gray in one corner becomes wider; values stay in bounds; an even frame stays even."""
    rows = [(0, x, y, float(100 + (x + y) % 4)) for x in range(64) for y in range(64)] + [(1, x, y, 7.0) for x in range(64) for y in range(64)] + [(2, 0, 0, 900.0), (2, 1, 0, -5.0)]
    out = imaging.equalised(spark.createDataFrame(rows, PIXEL), 64, 64)
    stats = {r.frame: r for r in out.groupBy("frame").agg(F.min("gray").alias("a"), F.max("gray").alias("b"), F.count("*").alias("n")).collect()}
    assert stats[0].n == stats[1].n == 64 * 64
    assert stats[0].b - stats[0].a > 3
    assert stats[1].a == stats[1].b
    assert all(0 <= s.a <= s.b <= 255 for s in stats.values())
    assert imaging.equalised(spark.createDataFrame([], PIXEL), 64, 64).count() == 0


def plain_thinning(pixels):
    """Two half rounds until nothing goes, on a set of places."""
    left, rounds = set(pixels), 0
    while True:
        before = len(left)
        rounds += 1
        for second in (False, True):
            gone = set()
            for x, y in left:
                p = [(x + i, y + j) in left for i, j in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
                up, right, down, leftward = p[0], p[2], p[4], p[6]
                turns = sum(1 for a, b in zip(p, p[1:] + p[:1]) if not a and b)
                blocked = (up and right and leftward, up and down and leftward) if second else (up and right and down, right and down and leftward)
                if 2 <= sum(p) <= 6 and turns == 1 and not any(blocked):
                    gone.add((x, y))
            left -= gone
        if len(left) == before:
            return left, rounds


def shape(seed):
    rnd = random.Random(seed)
    pixels = {(x, y) for x in range(4, 40) for y in range(8, 8 + 3 + seed * 2)} | {(x, y) for x in range(20, 26) for y in range(2, 30)}
    return {p for p in pixels if rnd.random() > 0.04}


def test_thinning_equals_plain_loop(spark, monkeypatch):
    rounds, one = [], imaging.staged
    monkeypatch.setattr(imaging, "staged", lambda df: rounds.append(1) or one(df))
    frames = {f: shape(f) for f in range(4)} | {7: {(0, 0)}, 8: {(0, 0), (1, 0), (0, 1), (1, 1)}}
    rows = [(f, x, y, 1.0) for f, ps in frames.items() for x, y in ps]
    df = spark.createDataFrame(rows + rows[:5] + [(None, 1, 1, 1.0)], PIXEL)
    got = imaging.thinned(df).collect()
    plain = {f: plain_thinning(ps) for f, ps in frames.items()}
    for f, (left, _) in plain.items():
        assert {(r.px, r.py) for r in got if r.frame == f} == left
    assert len(rounds) - 1 == max(n for _, n in plain.values()) <= 9  # half of the thickest mask's 9 pixels and holes, and the round that finds nothing
    assert imaging.thinned(df.limit(0)).count() == 0


def test_cleanup_drops_specks_and_feeds_the_spine(spark):
    bar = {(x, y) for x in range(10, 70) for y in range(20, 34)}
    rows = [(0, x, y, 1.0) for x, y in bar | {(75, 5), (76, 5), (3, 40)}]
    df = spark.createDataFrame(rows, PIXEL)
    clean = imaging.cleaned_mask(df, 80, 50, 10)
    kept = {(r.px, r.py) for r in clean.collect()}
    assert {(x, y) for x in range(16, 64) for y in range(22, 32)} <= kept and (75, 5) not in kept and (3, 40) not in kept
    spine = graph.longest_path(imaging.thinned(clean), "frame").collect()
    ys = {r.id >> 20 & (1 << 20) - 1 for r in spine if 20 <= (r.id & (1 << 20) - 1) < 60}
    assert len(spine) >= 40 and max(ys) - min(ys) <= 1
