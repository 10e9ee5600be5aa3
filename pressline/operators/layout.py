"""Recognised text lines of patch images to sections, columns and rows.

Lines: image_id, line, text, x0, y0, x1, y1 (pixels), width and height of the image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pressline.functions.text import let

SUBJECTS = ("CHAMPION", "SYSTEM", "ITEM", "RUNE")
CHANGES = {"BUFF": "buff", "NERF": "nerf", "ADJUST": "adjustment"}


def section_type(text: Column) -> Column:
    """The section that a heading line opens; null for other lines. The words sought hold
    no blank and no apostrophe, so neither need be normalised; the capitals are made once,
    and subjects looked for only beside a change."""

    def first(t: Column, words: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for word, name in reversed(words.items()):
            out = F.when(t.contains(word), name).otherwise(out)
        return out

    subjects = {s: f"{s.lower()}_" for s in SUBJECTS}
    return let(F.upper(text), lambda t: let(first(t, CHANGES), lambda c: F.when(c.isNotNull(), F.concat(first(t, subjects), c))))


def center_y(y0: str = "y0", y1: str = "y1") -> Column:
    return (F.col(y0) + F.col(y1)) / 2


def lines_in_sections(lines: DataFrame) -> DataFrame:
    """Each line that is no heading with the last heading strictly above its centre.
    One window over each image; lines of one height see headings above that height only."""
    rows = lines.withColumn("section_type", section_type(F.col("text"))).withColumn("cy", center_y())
    above = Window.partitionBy("image_id").orderBy("cy").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.struct("cy", (-F.col("line")).alias("l"), F.col("section_type").alias("s"), F.col("text").alias("t"))
    # the headings up to this height as one ordered maximum, once with and once without this height itself
    rows = rows.withColumn("upto", F.max(F.when(F.col("section_type").isNotNull(), head)).over(above))
    heights = rows.groupBy("image_id", "cy").agg(F.max("upto").alias("upto"))
    before = F.lag("upto").over(Window.partitionBy("image_id").orderBy("cy"))
    known = heights.withColumn("head", before).select("image_id", "cy", "head")
    joined = rows.where("section_type is null").drop("section_type", "upto").join(known, ["image_id", "cy"])
    return joined.where("head is not null").select("image_id", "line", "text", "x0", "y0", "x1", "y1", "width", "height", F.col("head.s").alias("section_type"), F.col("head.t").alias("section_label"))


def _opens(along: WindowSpec) -> Column:
    """Whether a record's section is another one than that of the record before."""
    same = F.lag("section_type").over(along).eqNullSafe(F.col("section_type")) & F.lag("section_label").over(along).eqNullSafe(F.col("section_label"))
    return ~same | (F.row_number().over(along) == 1)


def section_groups(records: DataFrame) -> DataFrame:
    """Runs of records (image_id, position, section_type, section_label) with equal
    section: gaps and islands."""
    w = Window.partitionBy("image_id").orderBy("position")
    rows = records.withColumn("_g", F.sum(_opens(w).cast("int")).over(w))
    return rows.groupBy("image_id", F.col("_g").alias("group"), "section_type", "section_label").agg(F.count("*").alias("records"), F.min("position").alias("first_position"))


def divider(lines: DataFrame) -> DataFrame:
    """image_id, divider_x, support: the left edge on which most lines of the inner left
    stretch agree within a tolerance; of equal clusters the one further left. Edges are
    scaled by the tolerance, so that one range frame serves images of every width. Lines
    of one edge are counted first; a cluster is a run of the sorted edges, so its median
    is found by rank, and of equally large runs the first has the least median. The row that comes of an image
    is dealt once more, by the hint, so that two uses share the work."""
    tolerance = F.greatest(F.lit(4.0), F.col("width") * 0.008)
    inner = F.col("x0").between(F.col("width") * 0.12, F.col("width") * 0.35) & section_type(F.col("text")).isNull()
    edges = lines.select("image_id", F.when(inner, F.struct((F.col("x0") / tolerance).alias("scaled"), "x0")).alias("e")).groupBy("image_id", "e").agg(F.count("*").alias("n"))
    whole, along = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("e.scaled")
    own = F.when(F.col("e").isNotNull(), F.col("n"))  # lines elsewhere count in the total only
    upto = lambda low: F.sum(own).over(along.rangeBetween(low, 1))
    rows = edges.withColumn("total", F.sum("n").over(whole)).withColumn("size", upto(-1)).withColumn("before", upto(Window.unboundedPreceding) - F.col("size"))
    rows = rows.withColumn("seen", F.sum(own).over(Window.partitionBy("image_id").orderBy("e.scaled", "e.x0").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("b", F.max(F.when(F.col("e").isNotNull(), F.struct("size", (-F.col("before")).alias("m")))).over(whole))
    at = lambda rank: F.max(F.when((F.col("seen") - own < rank - F.col("b.m")) & (rank - F.col("b.m") <= F.col("seen")), F.col("e.x0")))
    size = F.col("b.size")
    joined = rows.groupBy("image_id").agg(F.max("total").alias("n"), F.max(size).alias("size"), at(((size + 1) / 2).cast("long")).alias("low"), at((size / 2).cast("long") + 1).alias("high")).hint("rebalance", "image_id")
    need = F.greatest(F.lit(3), F.round(F.col("n") * 0.07).cast("int"))
    enough = F.coalesce(F.col("size") >= need, F.lit(False))
    middle = (F.col("low") + F.col("high")) / 2
    return joined.select("image_id", F.when(enough, F.round(middle).cast("int")).alias("divider_x"), F.when(enough, F.least(F.lit(1.0), F.col("size") / 8)).otherwise(F.coalesce(F.col("size") / need, F.lit(0.0))).alias("support"))


def _line(height: Column) -> Column:
    """A line as it takes part in visual rows, in which it sorts."""
    return F.struct(height.cast("double").alias("cy"), F.col("x0").cast("double").alias("x"), "text")


def _row_texts(ls: Column, height: Column) -> Column:
    """The texts of the visual rows of sorted lines (``_line``) on an image of this height."""
    row = "struct<s:double,n:int,items:array<struct<x:double,text:string>>>"
    start, tol = F.expr(f"cast(array() as array<{row}>)"), F.greatest(F.lit(4.0), height * 0.004)

    def fold(acc, l):
        last = F.get(acc, F.size(acc) - 1)
        item = F.array(F.struct(l["x"].alias("x"), l["text"].alias("text")))
        fresh = F.concat(acc, F.array(F.struct(l["cy"].alias("s"), F.lit(1).alias("n"), item.alias("items"))))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["s"] + l["cy"]).alias("s"), (last["n"] + 1).alias("n"), F.concat(last["items"], item).alias("items"))))
        return F.when((F.size(acc) == 0) | (F.abs(l["cy"] - last["s"] / last["n"]) > tol), fresh).otherwise(grown)

    text = lambda r: F.array_join(F.filter(F.transform(F.array_sort(r["items"]), lambda i: F.trim(i["text"])), lambda t: t != ""), "  ")
    return F.transform(F.aggregate(ls, start, fold), text)


def visual_rows(lines: DataFrame, key: list[str]) -> DataFrame:
    """Lines of each key joined to visual rows: from top to bottom a line joins the row
    whose running mean centre is within the tolerance, else opens one. The fold is
    order-dependent, so it runs over the sorted array of one key's lines."""
    cells = lines.groupBy(*key).agg(F.array_sort(F.collect_list(_line(center_y()))).alias("ls"), F.max("height").alias("height"))
    return cells.select(*key, F.posexplode(_row_texts(F.col("ls"), F.col("height"))).alias("row", "text"))


# ---- cells ----------------------------------------------------------------------------

#: Height in pixels of the bins by which short lines and headings meet.
BIN = 64


def bands(boundaries: DataFrame, lines: DataFrame) -> DataFrame:
    """image_id, y0, y1, section_type, section_label: the stretches between neighbouring
    boundaries (image_id, y) that are high enough, under the last heading above their middle."""
    along = Window.partitionBy("image_id").orderBy("y")
    cut = boundaries.select("image_id", "y").distinct().withColumn("y1", F.lead("y").over(along))
    middles = cut.select("image_id", ((F.col("y") + F.col("y1")) / 2).alias("at"), F.struct(F.col("y").alias("y0"), "y1").alias("band"))
    head = F.when(F.col("section_type").isNotNull(), F.struct("section_type", F.col("text").alias("section_label")))
    marks = lines.withColumn("section_type", section_type(F.col("text"))).select("image_id", center_y().alias("at"), "line", "height", head.alias("head"))
    # a heading at the very middle comes after it; of headings at one height the last line counts
    before = Window.partitionBy("image_id").orderBy("at", F.col("band").isNull(), "line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.unionByName(middles, allowMissingColumns=True).withColumn("head", F.last("head", ignorenulls=True).over(before)).withColumn("height", F.max("height").over(Window.partitionBy("image_id")))
    high = F.col("band.y1") - F.col("band.y0") >= F.greatest(F.lit(7), F.bround(F.col("height") * 0.008).cast("int"))
    return rows.where(high & F.col("head").isNotNull()).select("image_id", F.col("band.y0").cast("int").alias("y0"), F.col("band.y1").cast("int").alias("y1"), "head.section_type", "head.section_label")


def decorations(lines: DataFrame) -> DataFrame:
    """image_id, line: short lines left of a heading, on its height and close to it. What
    shares a height shares a bin of heights, so only headings of a line's bins are looked at."""
    box = F.struct(*(F.col(c).alias(f"h{c}") for c in ("x0", "y0", "x1", "y1")))
    rows = lines.select("image_id", "line", section_type(F.col("text")).isNotNull().alias("heading"), (F.length(F.trim("text")) <= 3).alias("short"), "x0", "y0", "x1", "y1")
    bins = F.when(F.col("heading") | F.col("short"), F.sequence(F.floor(F.col("y0") / BIN), F.floor(F.col("y1") / BIN)))
    rows = rows.select("image_id", "line", "heading", "x0", "y0", "x1", "y1", F.explode(bins).alias("bin"))
    rows = rows.withColumn("heads", F.collect_list(F.when(F.col("heading"), box)).over(Window.partitionBy("image_id", "bin")))

    def near(h: Column) -> Column:
        head_height, height = F.greatest(F.lit(1.0), h["hy1"] - h["hy0"]), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
        shared = F.greatest(F.lit(0.0), F.least("y1", h["hy1"]) - F.greatest("y0", h["hy0"])) / F.least(height, head_height)
        gap = h["hx0"] - F.col("x1")
        return (F.col("x0") < h["hx0"]) & (F.col("x1") - F.col("x0") <= head_height * 1.5) & (shared >= 0.55) & gap.between(-head_height * 0.25, head_height)

    return rows.where(~F.col("heading") & F.exists("heads", near)).select("image_id", "line").distinct()


def cells(lines: DataFrame, boundaries: DataFrame, dividers: DataFrame, full: bool = True) -> DataFrame:
    """image_id, y0, y1, section_type, section_label, target, raw_changes, confidence: the
    records of patch tables. A line lies in the band that holds its centre: the last one
    that begins above it, unless it ends above it too, as bands never overlap. Left of the
    divider (image_id, divider_x; null: none) stands the target, right of it the changes.
    All steps go by image, so that lines dealt by image stay where they are."""
    plain = lines.where(section_type(F.col("text")).isNull()).select("image_id", "line", "text", "x0", "y0", "width", "height", "confidence", center_y().alias("at"))
    spread = bands(boundaries, lines).select("image_id", F.col("y0").cast("double").alias("at"), F.struct("y0", "y1", "section_type", "section_label").alias("band"))
    above = Window.partitionBy("image_id").orderBy("at", F.col("line").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = plain.unionByName(spread, allowMissingColumns=True).withColumn("band", F.last("band", ignorenulls=True).over(above))
    marks = decorations(lines).groupBy("image_id").agg(F.collect_set("line").alias("marks"))
    inside = placed.where(F.col("line").isNotNull() & (F.col("at") < F.col("band.y1"))).join(marks, "image_id", "left").where(~F.coalesce(F.array_contains("marks", F.col("line")), F.lit(False)))
    tolerance = F.greatest(F.lit(4.0), F.bround(F.col("width") * 0.008))
    sided = inside.join(dividers.select("image_id", "divider_x"), "image_id", "left").withColumn("left", F.coalesce(F.col("x0") < F.col("divider_x") - tolerance, F.lit(True)))
    item, right = F.when(F.col("left"), F.struct("y0", "x0", "line", F.trim("text").alias("text"))), ~F.col("left")
    changes = [F.array_sort(F.collect_list(F.when(right, _line(F.col("at"))))).alias("changes"), F.max(F.when(right, F.col("height"))).alias("height")] if full else []
    records = sided.groupBy("image_id", "band").agg(F.array_sort(F.collect_list(item)).alias("target"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), *changes)
    records = records.withColumn("target", F.array_join(F.filter(F.transform("target", lambda t: t["text"]), lambda t: t != ""), " ")).where("target <> ''")
    texts = _row_texts(F.col("changes"), F.col("height")) if full else F.array().cast("array<string>")
    return records.select("image_id", "band.*", "target", texts.alias("raw_changes"), "confidence")


def structure_confidence(records: DataFrame, boundaries: DataFrame, dividers: DataFrame, full: bool = True) -> DataFrame:
    """image_id, records, sections, paired, confidence: how sure the structure of each image's
    table is, from its ``cells``, boundaries and divider (divider_x, support); at most 0.35
    for a full table without a divider."""
    opened = records.withColumn("opens", _opens(Window.partitionBy("image_id").orderBy("y0")))
    counts = opened.groupBy("image_id").agg(F.count("*").alias("records"), F.sum((F.size("raw_changes") > 0).cast("int")).alias("paired"), F.sum(F.col("opens").cast("int")).alias("sections"))
    edges = boundaries.select("image_id", "y").distinct().groupBy("image_id").agg(F.count("*").alias("edges"))
    rows = edges.join(counts, "image_id", "left").join(dividers.select("image_id", "divider_x", "support"), "image_id", "left").na.fill(0, ["records", "paired", "sections"])
    n = F.col("records")
    edge = F.least(F.lit(1.0), F.col("edges") / F.greatest(F.lit(4), n + 1))
    section = F.least(F.lit(1.0), F.col("sections") / 3)
    pairing = F.when(n > 0, F.col("paired") / n).otherwise(0.0)
    if full:
        sure = 0.35 * F.coalesce("support", F.lit(0.0)) + 0.25 * edge + 0.3 * pairing + 0.1 * section
        sure = F.when(F.col("divider_x").isNull(), F.least(sure, F.lit(0.35))).otherwise(sure)
    else:
        sure = 0.55 * edge + 0.35 * section + F.when(n > 0, 0.1).otherwise(0.0)
    return rows.select("image_id", "records", "sections", "paired", F.round(sure, 6).alias("confidence"))
