"""Section types and cells of large tables: work once a line, and the same results."""

import math
import random
import re
import statistics

from pyspark.sql import functions as F

from pressline.operators import layout
from pressline.plans import mechanisms


def test_section_type_is_worked_out_once(spark):
    said = ["CHAMPION BUFFS", "Item   nerfs", "rune’s adjustments", "SYSTEM", "buff", "champion adjusted, item buff", "Item and SYSTEM nerf buffs", "champion buﬀ", "CHAMPION NERF", "cham pion buff", "", None]

    def slow(text):
        t = re.sub(r"\s+", " ", text.replace("’", "'").upper()) if text is not None else ""
        return next((f"{s.lower()}_{n}" for s in layout.SUBJECTS for c, n in layout.CHANGES.items() if s in t and c in t), None)

    df = spark.createDataFrame([(x,) for x in said], "x string").select("x", layout.section_type(F.col("x")).alias("t"))
    assert [(r.x, r.t) for r in df.collect()] == [(x, slow(x)) for x in said]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and "regexp" not in plan


def test_cells_stay_with_their_image(spark):
    """Lines that are dealt by image are not dealt again, whatever the tables beside them."""
    lines = spark.range(400).selectExpr("id div 40 image_id", "cast(id % 40 as int) line", "if(id % 7 = 0, 'ITEM BUFF', concat('text ', id)) text", "cast(id % 3 * 150 as int) x0", "cast(id % 40 * 10 as int) y0").selectExpr("*", "x0 + 90 x1", "y0 + 12 y1", "1000 width", "900 height", "0.5D confidence").repartition(4, "image_id")
    edges = spark.range(200).selectExpr("id % 10 image_id", "cast(id div 10 * 40 as int) y").repartition(4, "image_id")
    records = layout.cells(lines, edges, layout.divider(lines))
    for df in (records, layout.structure_confidence(records, edges, layout.divider(lines))):
        keys = re.findall(r"Exchange hashpartitioning\((.*)\), ", df._jdf.queryExecution().executedPlan().toString())
        assert keys and all(re.fullmatch(r"image_id#\d+L, \d+", k) for k in keys), keys
    assert records.count() > 0


def test_divider_against_a_slow_form(spark):
    rng = random.Random(11)
    images = {n: [rng.choice([125, 128, 130.5, 131, 200, 203, 207.25, 210, 300, 340, 10, 500]) for _ in range(rng.choice([1, 2, 3, 7, 8, 40]))] for n in range(60)}
    df = spark.createDataFrame([(n, k, "BUFF item" if k % 5 == 4 else "x", float(x), 1000) for n, xs in images.items() for k, x in enumerate(xs)], "image_id long, line int, text string, x0 double, width int")
    got = {r.image_id: (r.divider_x, round(r.support, 9)) for r in layout.divider(df).collect()}
    for n, xs in images.items():
        inner = [x for k, x in enumerate(xs) if k % 5 != 4 and 120 <= x <= 350]
        near = [[y for y in inner if abs(y - x) <= 8] for x in inner]
        need, best = max(3, math.floor(len(xs) * 0.07 + 0.5)), max(((len(c), -statistics.median(c)) for c in near), default=(0, 0))
        assert got[n] == (math.floor(-best[1] + 0.5), min(1.0, best[0] / 8)) if best[0] >= need else got[n] == (None, round(best[0] / need, 9))


def test_confidence_shares_dividers_and_boundaries(spark):
    """What the cells and the confidence both use is worked out once."""
    df = mechanisms.patch_confidence(spark, "/root/testdata/sf0.001")
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shared = re.findall(r"ReusedExchange \[image_id#\d+L?, (\w+)#", plan)
    assert sorted(set(shared)) == ["n", "y"], shared
