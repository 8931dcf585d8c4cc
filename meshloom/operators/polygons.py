"""Polygons in the plane: nesting, and the union of many as a planar arrangement.

A polygon is a ring (id, p array of (x, y)), closed from its last point to its first, that doesn't cross itself. Rings that run
clockwise are turned round for nesting; in a union they are holes of the polygon with their id. Points meet sides by keyed joins on
slabs of x, of several widths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators import topology as T
from meshloom.operators.spatial import level_join
from meshloom.sources.shared import written

#: Points of a union are rounded to so many places, and lie on a side within as much.
PLACES = 9
NEAR = 10.0**-PLACES


def sides(rings: DataFrame) -> DataFrame:
    """(id, px, py, qx, qy): the sides of rings in turn; those without length are left out."""
    after = F.transform("p", lambda a, i: F.struct(a["x"].alias("px"), a["y"].alias("py"), F.get("p", (i + 1) % F.size("p"))["x"].alias("qx"), F.get("p", (i + 1) % F.size("p"))["y"].alias("qy")))
    return rings.select("id", F.inline(after)).where("px <> qx OR py <> qy")


def areas(rings: DataFrame) -> DataFrame:
    """(id, area, n): the area within rings, positive if they run counter-clockwise, and how many points they have."""
    s = sides(rings).groupBy("id").agg((F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py")) / 2).alias("area"))
    return rings.select("id", F.size("p").alias("n")).join(s, "id", "left").select("id", F.coalesce("area", F.lit(0.0)).alias("area"), "n")


def _slabs(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Points (l_x, l_y, ..) with the sides (r_px, r_py, r_qx, r_qy, ..) above, below or through them, ends and upright sides included.

    Sides may have lo_y and hi_y: the heights of points that they matter to.
    """
    flat = {f"{s}_{c}": F.lit(0.0) for s in ("lo", "hi") for c in "yz"}
    placed = flat
    if "lo_y" in lines.columns:
        flat = {"lo_z": F.lit(0.0), "hi_z": F.lit(0.0)}
        placed = flat | {"lo_y": F.col("y"), "hi_y": F.col("y")}
    lines = lines.withColumns({"lo_x": F.least("px", "qx"), "hi_x": F.greatest("px", "qx"), **flat})
    unit = lines.agg(F.avg(F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")))).first()[0] or 1.0
    return level_join(points.withColumns({"lo_x": F.col("x"), "hi_x": F.col("x"), **placed}), lines, unit).where("r_lo_x <= l_x AND l_x <= r_hi_x")


#: Of two sides that meet over a point, one counts; upright ones never do.
COUNTS = "l_x < r_hi_x"


def _height() -> Column:
    """Of a side over a point, where it is at the point's x; null for an upright one."""
    return F.col("r_py") + F.try_divide((F.col("l_x") - F.col("r_px")) * (F.col("r_qy") - F.col("r_py")), F.col("r_qx") - F.col("r_px")) - F.col("l_y")


def nesting(rings: DataFrame) -> DataFrame:
    """(id, parent, depth) of rings that don't cross each other: the smallest one around each, null if none, and how many there are.

    A ring is around another if all its points are within: an odd number of its sides lies above each. Of equal rings, that with the
    lower id is around the other.
    """
    size = written(areas(rings), "areas")
    points = rings.select(F.col("id"), F.posexplode("p").alias("k", "q")).select("id", "k", F.col("q.x").alias("x"), F.col("q.y").alias("y"))
    # a point below a ring is not within, so a side matters from its ring's lowest point up to itself
    reach = rings.select("id", (F.array_min(F.transform("p", lambda q: q["y"])) - 2 * NEAR).alias("lo_y"))
    lines = sides(rings).join(reach, "id").withColumn("hi_y", F.greatest("py", "qy") + 2 * NEAR)
    met = _slabs(points, lines).where("l_id <> r_id").withColumn("up", _height())
    # a point on a side is within, so that equal rings and ones that touch are told by their sizes
    on = F.when(F.col("up").isNull(), F.col("l_y").between(F.least("r_py", "r_qy") - NEAR, F.greatest("r_py", "r_qy") + NEAR)).otherwise(F.abs("up") <= NEAR)
    told = met.groupBy("l_id", "l_k", "r_id").agg(F.count_if(F.expr(COUNTS) & (F.col("up") > NEAR)).alias("above"), F.max(on).alias("touches"))
    held = told.where("touches OR above % 2 = 1").groupBy(F.col("l_id").alias("id"), F.col("r_id").alias("around")).agg(F.count(F.lit(1)).alias("m"))
    around = size.select(F.col("id").alias("around"), F.abs("area").alias("outer"))
    pairs = held.join(size.select("id", F.abs("area").alias("inner"), "n"), "id").join(around, "around").where("m = n AND (outer > inner OR outer = inner AND around < id)")
    found = pairs.groupBy("id").agg(F.min(F.struct("outer", F.negative("around").alias("last"))).alias("least"), F.count(F.lit(1)).alias("depth"))
    return rings.select("id").join(found, "id", "left").select("id", F.negative("least.last").alias("parent"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def _crossings(lines: DataFrame) -> DataFrame:
    """(line, x, y): where sides (line, px ..) meet others: single points, and the ends of stretches that two share."""
    flat = lines.withColumns({f"{s}_{c}": f("p" + c, "q" + c) for s, f in (("lo", F.least), ("hi", F.greatest)) for c in "xy"} | {"lo_z": F.lit(0.0), "hi_z": F.lit(0.0)})
    unit = flat.agg(F.avg(F.greatest(F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")))).first()[0] or 1.0
    met = level_join(flat, flat, unit).where("l_line < r_line")
    dx, dy, ex, ey = (F.col(f"{s}_q{c}") - F.col(f"{s}_p{c}") for s in "lr" for c in "xy")
    wx, wy = F.col("r_px") - F.col("l_px"), F.col("r_py") - F.col("l_py")
    det, off = dx * ey - dy * ex, wx * dy - wy * dx
    t, u = F.try_divide(wx * ey - wy * ex, det), F.try_divide(off, det)
    inside = lambda k: (k >= -NEAR) & (k <= 1 + NEAR)
    point = F.when((det != 0) & inside(t) & inside(u), F.array(F.struct((F.col("l_px") + t * dx).alias("x"), (F.col("l_py") + t * dy).alias("y"))))
    length = F.sqrt(dx * dx + dy * dy)
    ends = F.array(*[F.struct(F.col(f"{s}_{e}x").alias("x"), F.col(f"{s}_{e}y").alias("y")) for s in "lr" for e in "pq"])
    shared = F.when((det == 0) & (F.abs(off) <= NEAR * length), ends)
    found = met.select("l_line", "r_line", F.explode(F.coalesce(point, shared)).alias("at"))
    return found.select(F.explode(F.array("l_line", "r_line")).alias("line"), "at.x", "at.y")


def _stretches(lines: DataFrame) -> DataFrame:
    """(px, py, qx, qy, n): sides from left to right, or upwards, each once; n is how many more run back than that way.

    Level and upright ones are cut where others on the same straight line end, by running sums, so that equal stretches are one.
    """
    low, high = (f(F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("qx").alias("x"), F.col("qy").alias("y"))) for f in (F.least, F.greatest))
    back = F.when((F.col("px") < F.col("qx")) | (F.col("px") == F.col("qx")) & (F.col("py") < F.col("qy")), -1).otherwise(1)
    once = lines.select(low.alias("p"), high.alias("q"), back.alias("n")).select("p.x", "p.y", F.col("q.x").alias("u"), F.col("q.y").alias("v"), "n").groupBy("x", "y", "u", "v").agg(F.sum("n").alias("n"))
    upright = F.col("x") == F.col("u")
    slanted = once.where("x <> u AND y <> v").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("u").alias("qx"), F.col("v").alias("qy"), "n")
    ends = F.array(*[F.struct(F.when(upright, F.col(b)).otherwise(F.col(a)).alias("at"), (F.col("n") * s).alias("n"), F.lit(s).alias("here")) for a, b, s in (("x", "y", 1), ("u", "v", -1))])
    straight = once.where("x = u OR y = v").select(upright.alias("upright"), F.when(upright, F.col("x")).otherwise(F.col("y")).alias("place"), F.inline(ends))
    # ends that are rounded to one point are one
    steps = straight.groupBy("upright", "place", F.round("at", PLACES).alias("near")).agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.sum("here").alias("here"))
    along = Window.partitionBy("upright", "place").orderBy("near")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = steps.select("upright", "place", "at", F.lead("at").over(along).alias("to"), F.sum("n").over(so_far).alias("n"), F.sum("here").over(so_far).alias("here")).where("here > 0")
    of = lambda x, y: F.when(F.col("upright"), F.col(x)).otherwise(F.col(y))
    return slanted.union(cut.select(of("place", "at"), of("at", "place"), of("place", "to"), of("to", "place"), "n"))


def union(rings: DataFrame) -> DataFrame:
    """(loop, px, py, qx, qy): the boundary of what rings cover together, with the inside on the left: outer loops run counter-clockwise.

    Equal sides, and equal stretches of level and upright ones, are counted and taken once. Sides are cut where they meet. Each piece, once, is told how many polygons lie above it, by the sides over its middle, and below
    it, by those that run along it; pieces that have the covered on one side only are the boundary. Each goes on with the piece that
    turns right the most, so that parts which touch in a point are one; loops are the components of that.
    """
    lines = written(_stretches(sides(rings)).withColumn("line", F.monotonically_increasing_id()), "sides")
    near = lambda c: F.round(c, PLACES) + F.lit(0.0)
    ends = lines.select("line", F.inline(F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "pq"])))
    # a shared stretch's ends count only within the side
    at = lines.select("line", "n", *[F.col(k) for k in ("px", "py", "qx", "qy")]).join(ends.union(_crossings(lines)), "line")
    dx, dy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    at = at.withColumn("t", ((F.col("x") - F.col("px")) * dx + (F.col("y") - F.col("py")) * dy) / (dx * dx + dy * dy)).where((F.col("t") >= -NEAR) & (F.col("t") <= 1 + NEAR))
    points = at.select("line", "n", near("x").alias("x"), near("y").alias("y"), "t").groupBy("line", "n", "x", "y").agg(F.min("t").alias("t"))
    along = Window.partitionBy("line").orderBy("t", "x", "y")
    cut = points.select("n", "x", "y", F.lead("x").over(along).alias("u"), F.lead("y").over(along).alias("v")).where("u IS NOT NULL")
    # from left to right, or upwards; one that runs the other way has its inside below
    low, high = F.least(F.struct("x", "y"), F.struct(F.col("u").alias("x"), F.col("v").alias("y"))), F.greatest(F.struct("x", "y"), F.struct(F.col("u").alias("x"), F.col("v").alias("y")))
    back = F.when(low["x"] == F.col("x"), F.when(low["y"] == F.col("y"), -1).otherwise(1)).otherwise(1)
    pieces = cut.select(low.alias("a"), high.alias("b"), (-back * F.col("n")).alias("way")).groupBy("a", "b").agg(F.sum("way").alias("here"))
    pieces = written(pieces.select(F.monotonically_increasing_id().alias("piece"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), "here"), "pieces")
    over = None
    for upright in (False, True):
        own = pieces.where("ax = bx" if upright else "ax <> bx")
        # upright pieces are seen from their side: (x, y) becomes (y, -x), and what is to the left is above
        mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
        spots = own.select("piece", (my if upright else mx).alias("x"), (-mx if upright else my).alias("y"))
        turned = lines.select(F.col("py").alias("px"), (-F.col("px")).alias("py"), F.col("qy").alias("qx"), (-F.col("qx")).alias("qy"), "n") if upright else lines.select("px", "py", "qx", "qy", "n")
        above = _slabs(spots, turned).where(COUNTS).where(_height() > NEAR).groupBy(F.col("l_piece").alias("piece")).agg(F.sum(F.when(F.col("r_qx") < F.col("r_px"), -F.col("r_n")).otherwise(F.col("r_n"))).alias("over"))
        over = above if over is None else over.union(above)
    known = pieces.join(over, "piece", "left").withColumn("over", F.coalesce("over", F.lit(0)))
    upper, lower = F.col("over") > 0, F.col("over") + F.col("here") > 0
    edge = known.where(upper != lower).select("piece", *[F.when(upper, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"p{c}") for c in "xy"], *[F.when(upper, F.col(f"b{c}")).otherwise(F.col(f"a{c}")).alias(f"q{c}") for c in "xy"])
    edge = written(edge, "edge")
    after = edge.select(F.col("piece").alias("next"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("qx").alias("nx"), F.col("qy").alias("ny"))
    ax, ay, bx, by = F.col("qx") - F.col("px"), F.col("qy") - F.col("py"), F.col("nx") - F.col("qx"), F.col("ny") - F.col("qy")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    links = edge.join(after, ["qx", "qy"]).groupBy("piece").agg(F.min(F.struct(turn.alias("turn"), "next")).alias("m")).select(F.col("piece").alias("a"), F.col("m.next").alias("b"))
    loops = T.components(edge.select(F.col("piece").alias("id")), written(links, "next"))
    return edge.join(loops.select(F.col("id").alias("piece"), F.col("component").alias("loop")), "piece").select("loop", "px", "py", "qx", "qy")


def loop_measures(boundary: DataFrame) -> DataFrame:
    """(loop, area, length, n): area is negative for holes."""
    cross, dx, dy = F.col("px") * F.col("qy") - F.col("qx") * F.col("py"), F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    return boundary.groupBy("loop").agg((F.sum(cross) / 2).alias("area"), F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"), F.count(F.lit(1)).alias("n"))
