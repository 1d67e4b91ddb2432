"""Lines, rules and bands against plain loops, with pages of many words."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import layout


def folded(v, reach):
    lines, first, line = [], None, -1
    for y in v:
        if first is None or y - first > reach:
            first, line = y, line + 1
        lines.append(line)
    return lines


def test_lines_and_rules_like_a_fold(spark):
    rng = random.Random(1)
    pages = [sorted(round(rng.uniform(0, 40), rng.choice((0, 1, 3))) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    pages += [[0.1 * i for i in range(50)], [5.0] * 9, []]  # places whose sums are rounded
    rows = spark.createDataFrame(list(enumerate(pages)), "page int, v array<double>")
    for reach in (3.0, 1.0, 0.3):
        got = rows.select("page", layout.anchored_lines(F.col("v"), reach).alias("l"), layout.thinned(F.col("v"), reach).alias("t")).collect()
        for r in got:
            lines = folded(pages[r.page], reach)
            assert r.l == lines
            assert r.t == [y for i, y in enumerate(pages[r.page]) if not i or lines[i] != lines[i - 1]]


def test_a_page_of_many_words(spark):
    words = spark.range(100_000).select(F.lit(1).alias("page"), F.lit("w").alias("text"), (F.col("id") % 7).cast("double").alias("x0"), F.lit(9.0).alias("x1"), (F.col("id") * 1.5).alias("top"))
    began = time.time()
    lines = layout.words_in_lines(words).groupBy("line").count()
    assert lines.count() == 33_334 and lines.agg(F.max("count")).first()[0] == 3
    assert time.time() - began < 30
    assert len(layout._anchors(np.arange(1e6), 0.5)) == 1_000_000


@pytest.mark.parametrize("most", [100_000, 10, 1])
def test_words_in_bands(spark, most):
    rng = random.Random(2)
    panels, bands, words, want = [], [], [], []
    for page in range(12):
        for panel, (left, right) in enumerate(((0.0, 50.0), (50.0, 100.0))):
            panels.append((page, panel, left, right))
            ys = sorted(rng.sample(range(0, 100, 3), rng.randint(0, 8)))
            bands += [(page, panel, i, float(a), float(b)) for i, (a, b) in enumerate(zip(ys, ys[1:], strict=False)) if rng.random() > 0.2]
        words += [(page, f"w{i}", float(rng.randint(0, 110)), rng.choice((0.5, 1.0, 40.0)) + rng.randint(0, 90)) for i in range(rng.choice((0, 5, 60)))]
    for page, text, x0, top in words:
        for p, panel, left, right in panels:
            if p == page and left <= x0 < right:
                want += [(page, panel, b, text) for q, r, b, upper, lower in bands if (q, r) == (page, panel) and upper + 0.5 < top < lower - 0.5]
    got = layout.words_in_bands(
        spark.createDataFrame(words, "page int, text string, x0 double, top double"), spark.createDataFrame(bands, "page int, panel int, band int, upper double, lower double"),
        spark.createDataFrame(panels, "page int, panel int, left double, right double"), most)
    assert sorted((r.page, r.panel, r.band, r.text) for r in got.collect()) == sorted(want)
    assert set(got.columns) == {"page", "panel", "text", "x0", "top", "left", "right", "band", "upper", "lower"}
