"""Points near lines on a map, and lines looked up by name in a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: kilometres of a degree of latitude.
DEGREE_KM = 111.195


def point(lat: Column, lon: Column) -> Column:
    """A point, null beyond the ranges of latitude and longitude."""
    fits = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(fits, F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon")))


def segments(lines: DataFrame) -> DataFrame:
    """(line, n, a, b) of lines (line, points array of lat and lon); a line of one point is a segment of no length."""
    pair = F.when(F.size("points") > 1, F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points")).alias("b"))).otherwise(F.array(F.struct(F.get("points", F.lit(0)).alias("a"), F.get("points", F.lit(0)).alias("b"))))
    return lines.where(F.size("points") > 0).select("line", F.posexplode(pair).alias("n", "s")).select("line", "n", "s.a", "s.b")


def distance_km(p: Column, a: Column, b: Column) -> Column:
    """From a point to a segment, on a plane whose degrees of longitude are as long as at the point."""
    shrink = F.cos(F.radians(p["lat"]))
    ax, ay = (a["lon"] - p["lon"]) * shrink, a["lat"] - p["lat"]
    bx, by = (b["lon"] - p["lon"]) * shrink, b["lat"] - p["lat"]
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    at = F.when(length > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    x, y = ax + at * dx, ay + at * dy
    return F.sqrt(x * x + y * y) * DEGREE_KM


def line_cells(lines: DataFrame, km: float, cell: float) -> DataFrame:
    """(line, n, a, b, r, c): the cells of a grid of `cell` degrees in which a point within km of a segment can lie.

    In each row of the grid they are those along the part of the segment whose latitude is near enough, widened by the distance as it is at
    the row's edge furthest from the equator; so a slanting segment takes a band of cells, not its box.
    """
    lat = km / DEGREE_KM + 1e-6  # a little more, for rounding
    box = lambda f, c: f(F.col(f"a.{c}"), F.col(f"b.{c}"))
    row = lambda x: F.floor(x / cell).cast("int")
    within = lambda x, most: F.greatest(F.lit(-most), F.least(F.lit(most), x))
    rows = F.sequence(row(within(box(F.least, "lat") - lat, 90.0)), row(within(box(F.greatest, "lat") + lat, 90.0)))
    placed = segments(lines).withColumn("r", F.explode(rows)).withColumn("low", F.col("r") * cell)
    rise = F.col("b.lat") - F.col("a.lat")
    # where along the segment (0 to 1) the latitude comes within reach of the row
    along = lambda edge: F.when(rise == 0, None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("a.lat")) / F.nullif(rise, F.lit(0.0)))))
    placed = placed.withColumns({"u": F.coalesce(along(F.col("low") - lat), F.lit(0.0)), "v": F.coalesce(along(F.col("low") + cell + lat), F.lit(1.0))})
    lon = lambda at: F.col("a.lon") + F.col(at) * (F.col("b.lon") - F.col("a.lon"))
    furthest = F.greatest(F.abs("low"), F.abs(F.col("low") + cell))
    # at the poles a distance covers every longitude
    wide = F.when(furthest < 90, F.least(F.lit(360.0), lat / F.cos(F.radians(furthest)) + 1e-6)).otherwise(360.0)
    columns = F.sequence(row(within(F.least(lon("u"), lon("v")) - wide, 180.0)), row(within(F.greatest(lon("u"), lon("v")) + wide, 180.0)))
    return placed.select("line", "n", "a", "b", "r", F.explode(columns).alias("c"))


def near_lines(points: DataFrame, lines: DataFrame, km: float, cell: float = 1.0) -> DataFrame:
    """(id, line, km): points (id, point) within a distance of lines (line, points), with the least distance to each.

    Points lie in one cell of a grid of `cell` degrees, segments in the cells along them (`line_cells`), so cells are an equi-join and the
    distance is measured on what meets. Lines across the date line have to be cut there before.
    """
    cells = line_cells(lines, km, cell)
    row = lambda x: F.floor(x / cell).cast("int")
    placed = points.where("point IS NOT NULL").withColumns({"r": row(F.col("point.lat")), "c": row(F.col("point.lon"))})
    met = placed.join(cells, ["r", "c"]).withColumn("km", distance_km(F.col("point"), F.col("a"), F.col("b")))
    return met.where(F.col("km") <= km).groupBy("id", "line").agg(F.min("km").alias("km"))


def lines_by_name(entities: DataFrame, geocodes: DataFrame, cache: DataFrame, least_mentions: int = 2, least_length: int = 3) -> tuple[DataFrame, DataFrame]:
    """(found, wanted): document and line of each place that no geocoder could confirm but the cache knows as a line, and the names to ask for.

    entities: doc, name, mentions. geocodes: name, resolved; places without one weren't checked yet and are left out. cache: name, resolved, line;
    a miss is kept there too, so that a name is asked for once.
    """
    asked = entities.where((F.col("mentions") >= least_mentions) & (F.length(F.trim("name")) >= least_length) & ~F.contains("name", F.lit('"')))
    rejected = asked.join(geocodes.where("NOT resolved").select("name").distinct(), "name", "left_semi")
    found = rejected.join(cache.where("resolved").select("name", "line"), "name").select("doc", "name", "line")
    return found, rejected.join(cache.select("name"), "name", "left_anti").select("name").distinct()
