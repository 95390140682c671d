import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.operators import geometry, layout

RUNS, PAGES = "g long, across boolean, line long, lo long, hi long", "g long, pixels_x int, pixels_y int, width double, height double"


def test_parts_equal_a_flood_fill():
    r = random.Random(4)
    image = np.array([[r.random() < 0.55 for _ in range(40)] for _ in range(30)])
    runs = []
    for y, row in enumerate(image):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(int), [0]))))
        runs += [(y, a, b) for a, b in zip(edges[::2], edges[1::2])]
    part = layout.joined_parts(*(np.array(c) for c in zip(*runs)))
    mark = np.full(image.shape, -1)
    for y, x in zip(*np.nonzero(image)):
        todo = [(y, x)] if mark[y, x] < 0 else []
        while todo:
            a, b = todo.pop()
            if 0 <= a < 30 and 0 <= b < 40 and image[a, b] and mark[a, b] < 0:
                mark[a, b] = y * 40 + x
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    pairs = {(p, mark[y, a]) for p, (y, a, _) in zip(part, runs)}
    assert len(pairs) == len({p for p, _ in pairs}) == len({m for _, m in pairs})


def test_rules_of_a_table_reach_the_table_finder(spark):
    """A grid drawn three pixels thick, with a broken line, a word and a black box beside it."""
    xs, ys = [100, 300, 600, 900, 1300, 1500, 1900], [200, 260, 400, 700]
    runs = [(1, True, y + t, xs[0], xs[-1] + 3) for y in ys for t in range(3)] + [(1, False, x + t, ys[0], ys[-1] + 3) for x in xs for t in range(3)]
    runs += [(1, True, 201, 2000, 2019), (1, True, 900, 100, 300), (1, True, 900, 310, 500), (1, True, 900, 520, 560), (1, True, 950, 9, 9)]
    runs += [(1, True, 1000 + t, 100, 200) for t in range(60)] + [(2, True, 5, 0, 29)]
    pages = spark.createDataFrame([(1, 2100, 1500, 700.0, 500.0), (2, 100, 100, 100.0, 100.0), (3, 10, 10, 1.0, 1.0)], PAGES)
    rules = layout.grid_lines(spark.createDataFrame(runs, RUNS), pages)
    got = sorted((round(r.x0, 3), round(r.y0, 3), round(r.x1, 3), round(r.y1, 3)) for r in rules.collect())
    down, level = [x for x in got if x[0] == x[2]], [x for x in got if x[1] == x[3]]
    assert [x[0] for x in down] == [round((x + 1.5) / 3, 3) for x in xs] and {x[1:4:2] for x in down} == {(round(200 / 3, 3), round(703 / 3, 3))}
    assert len(level) == 5 and (33.333, 300.167, 166.667, 300.167) in level
    table = geometry.ruled_table(rules, pages.select("g", "width", "height")).collect()
    assert [(r.g, len(r.xs), len(r.ys)) for r in table] == [(1, 7, 4)]
    assert layout.grid_lines(spark.createDataFrame([], RUNS), pages).count() == 0


def test_reading_order(spark):
    words = [(1, 0, 10, 0, 60, 10, "Title"), (1, 1, 70, 1, 300, 11, "here"), (1, 2, 10, 40, 50, 50, "a"), (1, 3, 60, 42, 90, 52, "b"), (1, 4, 10, 53, 50, 63, "c"), (1, 5, 200, 41, 240, 51, "d"), (1, 6, 200, 60, 240, 70, "e")]
    words += [(1, 7, 250, 60, 260, 70, " "), (1, 8, None, 60, 260, 70, "lost"), (2, 9, 5, 5, 6, 6, "alone"), (2, 10, 5, 5, 6, 6, "twice")]
    df = spark.createDataFrame([(g, i, *(None if v is None else float(v) for v in box), t) for g, i, *box, t in words], "g long, id long, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r.g: r.text for r in layout.reading_order(df.repartition(3, F.rand(1))).collect()}
    assert got == {1: "Title here\n\na b\nc\n\nd\ne", 2: "alone twice"}
