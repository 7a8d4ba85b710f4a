"""Fields: a value for each cell of a grid, with the grid's frequency carried along and checked.

All algebra is column expressions after an equi-join on `cell`. Two fields of different frequency never join: the check is
made when the plan is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """df holds cell and v."""

    df: DataFrame
    frequency: int

    def __post_init__(self) -> None:
        if not {"cell", "v"} <= set(self.df.columns):
            raise ValueError("a field has the columns cell and v")


OPS = {
    "add": lambda a, b, ka, kb: ka * a + kb * b,
    "sub": lambda a, b, ka, kb: ka * a - kb * b,
    "mul": lambda a, b, ka, kb: (ka * a) * (kb * b),
    "min": lambda a, b, ka, kb: F.least(ka * a, kb * b),
    "max": lambda a, b, ka, kb: F.greatest(ka * a, kb * b),
    "lerp": lambda a, b, ka, kb: a * (1 - ka) + b * ka,
}


def math(op: str, a: Field, b: Field, ka: float = 1.0, kb: float = 1.0) -> Field:
    """op(ka * a, kb * b), cell by cell; lerp goes from a to b by ka."""
    if op not in OPS:
        raise ValueError(f"unknown operation {op!r}; there are {', '.join(OPS)}")
    if a.frequency != b.frequency:
        raise ValueError(f"fields of frequency {a.frequency} and {b.frequency}; resample one of them")
    both = a.df.select("cell", F.col("v").alias("a")).join(b.df.select("cell", F.col("v").alias("b")), "cell")
    return Field(both.select("cell", OPS[op](F.col("a"), F.col("b"), F.lit(ka), F.lit(kb)).alias("v")), a.frequency)


def mask(a: Field, threshold: float, smooth: float = 0.0, invert: bool = False) -> Field:
    """1 above the threshold and 0 below, or a smooth step of the given width."""
    if smooth > 0:
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - threshold) / smooth + 0.5))
        v = t * t * (3 - 2 * t)
    else:
        v = (F.col("v") > threshold).cast("double")
    return Field(a.df.select("cell", (1 - v if invert else v).alias("v")), a.frequency)


def combine(tectonic: Column, noise: Column, coast: Column, sea: float = 0.0, mix: float = 1.0) -> Column:
    """Elevation of large forms and detail, with a displaced coast line and a shelf of quadratic ramps."""
    z = tectonic + noise * mix
    z = z + 220.0 * coast * F.exp(-F.abs(z - sea) / 350.0)
    up, down = (z - sea) / 200.0, (sea - z) / 300.0
    return F.when((z > sea) & (z < sea + 200), sea + up * up * 200).when((z < sea) & (z > sea - 300), sea - down * down * 300).otherwise(z)


def temperature(lat_deg: Column, z: Column, noise: Column | None = None) -> Column:
    """Mean temperature by latitude and height, degrees C."""
    t = -23.0 + 50.0 * F.pow(F.greatest(F.lit(0.0), F.cos(F.radians(lat_deg))), F.lit(1.4)) - 6.5 * F.greatest(F.lit(0.0), z) / 1000.0
    return t if noise is None else t + 1.5 * noise


def runoff(z: Column, temp: Column, precip: Column, sea: float = 0.0) -> Column:
    """Water that runs off land, mm a year."""
    pet = F.least(F.lit(1800.0), F.greatest(F.lit(0.0), 45.0 * (temp + 5.0)))
    return F.when(z > sea, F.greatest(F.lit(0.0), precip - 0.55 * pet) + 15.0).otherwise(0.0)


#: Biome ids with their conditions, of which the first that holds decides; z above sea from here on, t in C, p in mm.
BIOMES = (
    (0, "z <= sea"),
    (1, "t < -12"),
    (2, "t < -2"),
    (9, "z > 3300"),
    (8, "p < 220"),
    (3, "t < 6"),
    (6, "t > 21 AND p > 1600"),
    (7, "t > 19 AND p < 1100"),
    (5, "p < 550"),
)
BIOME_ELSE = 4


def biome_sql(z: str, t: str, p: str, sea: float = 0.0) -> str:
    """SQL: biome id."""
    names = {"z": z, "t": t, "p": p, "sea": str(sea)}
    put = lambda cond: " ".join(f"({names[w]})" if w in names else w for w in cond.split(" "))
    return "CASE " + " ".join(f"WHEN {put(c)} THEN {k}" for k, c in BIOMES) + f" ELSE {BIOME_ELSE} END"


def vegetation(biome: Column, t: Column, p: Column) -> Column:
    """Plant cover, 0 to 1."""
    cover = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least(p / 1800.0, (t + 8.0) / 32.0)))
    return F.when(biome.isin(0, 1, 8), 0.0).otherwise(cover)


def friction(ocean: Column, slope: Column, biome: Column) -> Column:
    """Cost of crossing a cell; null for ocean, which can't be crossed."""
    rough = 1.0 + 4.0 * F.least(F.lit(1.0), slope * 3)
    return F.when(~ocean, rough + F.when(biome.isin(8, 2), 2.5).otherwise(0.0) + F.when(biome.isin(1, 9), 4.0).otherwise(0.0))


def around(cells: DataFrame, adjacency: DataFrame, value: str) -> DataFrame:
    """src, dst, here, there: a value of each cell next to that of each neighbour. The gather that kernels are made of."""
    v = cells.select("cell", value)
    return adjacency.select("src", "dst").join(v.toDF("src", "here"), "src").join(v.toDF("dst", "there"), "dst")


def slope(cells: DataFrame, adjacency: DataFrame, value: str = "z", scale: float = 40000.0) -> DataFrame:
    """cell, slope: the greatest difference to a neighbour, scaled."""
    return around(cells, adjacency, value).groupBy(F.col("src").alias("cell")).agg((F.max(F.abs(F.col("here") - F.col("there"))) / scale).alias("slope"))


def coast(cells: DataFrame, adjacency: DataFrame, value: str = "z", sea: float = 0.0) -> DataFrame:
    """cell, coast: land with an ocean neighbour."""
    near = around(cells, adjacency, value)
    return near.groupBy(F.col("src").alias("cell")).agg((F.max(F.col("here") > sea) & F.max(F.col("there") <= sea)).alias("coast"))


def downsample(pixels: DataFrame, step: int) -> DataFrame:
    """y, x, v of blocks of step x step pixels: their mean."""
    return pixels.groupBy(F.floor(F.col("y") / step).alias("y"), F.floor(F.col("x") / step).alias("x")).agg(F.avg("v").alias("v"))


def sample_nearest(points: DataFrame, pixels: DataFrame, w: int, h: int) -> DataFrame:
    """points (lon, lat, ...) with the value v of the pixel that they lie in."""
    x = F.least(F.lit(w - 1), F.floor((F.col("lon") + 180) / 360 * w)).cast("long")
    y = F.least(F.lit(h - 1), F.floor((90 - F.col("lat")) / 180 * h)).cast("long")
    return points.withColumn("__y", y).withColumn("__x", x).join(pixels.select(F.col("y").alias("__y"), F.col("x").alias("__x"), "v"), ["__y", "__x"]).drop("__y", "__x")


def sample_bilinear(points: DataFrame, key: str, pixels: DataFrame, w: int, h: int) -> DataFrame:
    """key, v: bilinear between four pixels; longitudes wrap, latitudes end. One join on exploded corners."""
    fx, fy = (F.col("lon") + 180) / 360 * w - 0.5, (90 - F.col("lat")) / 180 * h - 0.5
    p = points.select(key, fx.alias("fx"), fy.alias("fy")).withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")})
    tx, ty = F.col("fx") - F.col("x0"), F.col("fy") - F.col("y0")
    corner = lambda dx, dy, wt: F.struct(F.pmod(F.col("x0") + dx, F.lit(w)).alias("x"), F.least(F.lit(h - 1), F.greatest(F.lit(0), F.col("y0") + dy)).cast("long").alias("y"), wt.alias("wt"))
    corners = F.array(corner(0, 0, (1 - tx) * (1 - ty)), corner(1, 0, tx * (1 - ty)), corner(0, 1, (1 - tx) * ty), corner(1, 1, tx * ty))
    return p.select(key, F.explode(corners).alias("c")).select(key, "c.*").join(pixels.select("y", "x", "v"), ["y", "x"]).groupBy(key).agg(F.sum(F.col("wt") * F.col("v")).alias("v"))


def nearest_cell(points: DataFrame, key: str, cells: DataFrame, f: int) -> DataFrame:
    """key, cell: the cell whose centre is nearest to a point. points: key and a unit vector px, py, pz.

    Space is cut into cubes as wide as the greatest distance to a nearest centre; a point meets the centres of its own and the
    26 cubes around: an equi-join whose size is points times a constant. Products that are equal to the last bit go to the greater cell."""
    side = 1.4 / f if f > 1 else 1.4
    cube = lambda a, b, c: [F.floor(x / side).cast("int") for x in (a, b, c)]
    home = cells.select("cell", "x", "y", "z", *(e.alias(n) for e, n in zip(cube(F.col("x"), F.col("y"), F.col("z")), ("i", "j", "k"), strict=True)))
    around_ = F.explode(F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip((a, b, c), "abc", strict=True))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    at = points.select(key, "px", "py", "pz", around_.alias("d"))
    at = at.select(key, "px", "py", "pz", *((e + F.col(f"d.{n}")).alias(m) for e, n, m in zip(cube(F.col("px"), F.col("py"), F.col("pz")), "abc", "ijk", strict=True)))
    dot = F.col("px") * F.col("x") + F.col("py") * F.col("y") + F.col("pz") * F.col("z")
    return at.join(home, ["i", "j", "k"]).groupBy(key).agg(F.max(F.struct(dot.alias("dot"), "cell"))["cell"].alias("cell"))


def _faces() -> list[tuple[tuple[int, int, int], list[list[float]]]]:
    """The corners of the twenty faces, and the rows that turn a direction into weights on them."""
    from ..sources import grid

    at, near = np.array(grid._corners()), grid._touching()
    faces = [(a, b, c) for a in range(12) for b in near[a] if b > a for c in near[a] if c > b and c in near[b]]
    return [(f, np.linalg.inv(at[list(f)].T).tolist()) for f in faces]


def _unwarped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, px, py, pz -> key, the corners of the face that a point lies in, and its weights there with the grid's warp undone."""
    from ..sources import grid

    faces = sorted(_faces(), key=lambda f: f[0])  # of faces that share the point the last one counts
    for b in batches:
        p = [b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
        least, at, w = np.full(b.num_rows, -np.inf), np.zeros((b.num_rows, 3), "int32"), np.zeros((3, b.num_rows))
        for face, rows in faces:
            e = np.array([r[0] * p[0] + r[1] * p[1] + r[2] * p[2] for r in rows])
            better = (low := e.min(axis=0)) >= least
            least, at[better], w[:, better] = np.where(better, low, least), face, e[:, better]
        t = np.maximum(0.0, w / (w[0] + w[1] + w[2]))
        u = t
        for _ in range(40):
            g = u + grid.WARP_ALPHA * u * (1 - u) * (0.5 - u) + grid.WARP_BETA * u[0] * u[1] * u[2]
            u = np.minimum(1.0, np.maximum(0.0, u - (g / (g[0] + g[1] + g[2]) - t)))
        ends = pa.array(np.arange(0, 3 * b.num_rows + 1, 3, dtype="int32"))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (at, np.ascontiguousarray(u.T))]
        yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["key", "at", "t"])


def locate(points: DataFrame, key: str, f: int) -> DataFrame:
    """points (key, px, py, pz) -> key, at (a cell), weight: the cells of a grid of frequency f that form the triangle around a point, and its weights on them.

    The face is the one in which the least of the three weights is greatest. The grid's warp is undone by a fixed-point iteration; then the whole
    parts of the weights name the triangle's lower cells: of the fractions, which sum to one or two, each belongs to the cell with one more (or
    one less than all) on its corner. Points without a coordinate take no part."""
    from ..sources import grid

    there = points.where("px IS NOT NULL AND py IS NOT NULL AND pz IS NOT NULL").select(F.col(key).alias("key"), *(F.col(c).cast("double") for c in ("px", "py", "pz")))
    schema = T.StructType([there.schema["key"], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("t", T.ArrayType(T.DoubleType()))])
    best = there.mapInArrow(_unwarped, schema).select(F.col("key").alias(key), "at", F.col("t").alias("flat"))
    # Weights that are whole but for rounding are made whole.
    scaled = F.transform("flat", lambda v: F.when(F.abs(v * f - F.round(v * f)) < 1e-9, F.round(v * f)).otherwise(v * f))
    p = best.select(key, "at", scaled.alias("s")).select(key, "at", F.transform("s", lambda v: F.floor(v)).alias("n"), F.transform("s", lambda v: v - F.floor(v)).alias("r"))
    count = F.round(F.aggregate("r", F.lit(0.0), lambda s, v: s + v)).cast("int")
    near = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda m: F.get("n", m) + F.when(count == 2, (m != k).cast("int")).when(count == 1, (m == k).cast("int")).otherwise(0)).alias("n"),
        F.when(count == 2, 1 - F.get("r", k)).when(count == 1, F.get("r", k)).otherwise((k == 0).cast("double")).alias("weight"),
    )), lambda v: v["weight"] > 0)
    out = p.select(F.col(key).alias("__key"), "at", F.explode(near).alias("v"))
    on = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda m: F.struct(F.get("at", m).alias("corner"), F.get("v.n", m).cast("int").alias("weight"))), lambda v: v["weight"] > 0))
    named = grid.placed(points.sparkSession, f).select(grid._key(F.col("on")).alias("k"), "cell")
    found = out.select("__key", F.col("v.weight").alias("weight"), grid._key(on).alias("k")).join(named, "k")
    return found.select(F.col("__key").alias(key), F.col("cell").alias("at"), "weight")


def locate_cell(points: DataFrame, key: str, f: int) -> DataFrame:
    """key, cell: of the triangle around a point, the cell of the greatest weight, ties to the smaller cell."""
    return locate(points, key, f).groupBy(key).agg(F.max_by("at", F.struct("weight", -F.col("at"))).alias("cell"))


def sample(points: DataFrame, key: str, field: Field) -> DataFrame:
    """key, v: a field at points between its cells, by their weights."""
    at = locate(points, key, field.frequency).join(field.df.select(F.col("cell").alias("at"), "v"), "at")
    return at.groupBy(key).agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))


def resample(field: Field, f: int) -> Field:
    """The field at the cells of a grid of another frequency."""
    from ..sources import grid

    to = grid.cells(field.df.sparkSession, f).select("cell", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return Field(sample(to, "cell", field), f)


def rasterize(field: Field, w: int, h: int) -> DataFrame:
    """y, x, v: the field at the centres of the pixels of a raster (the grid's frame is z-up, that of longitudes y-up: lon = atan2(z, x), lat = asin(y))."""
    from ..functions import geo
    from ..sources import grid

    px = grid.pixels(field.df.sparkSession, w, h)
    dx, dy, dz = geo.direction(F.col("lon"), F.col("lat"))
    at = px.select("idx", dx.alias("px"), dy.alias("py"), dz.alias("pz"))
    return sample(at, "idx", field).select(F.floor(F.col("idx") / w).alias("y"), (F.col("idx") % w).alias("x"), "v")


def smooth_poles(pixels: DataFrame, w: int, h: int, rows: int = 10) -> DataFrame:
    """pixels (y, x, v): the rows next to a pole are mixed with the mean of the first row beyond them, taken there and on the other side of the pole; the more the nearer."""
    n = max(1, min(rows, max(1, h // 8)))
    south = F.col("y") >= h - n
    away = F.when(south, h - 1 - F.col("y")).otherwise(F.col("y"))
    share = F.when(away < n, 0.65 * (n - away) / n).otherwise(0.0)
    at = lambda x, name: pixels.where(F.col("y").isin(min(h - 1, n), max(0, h - 1 - n))).select(F.col("y").alias("ref"), x.alias("x"), F.col("v").alias(name))
    ref = F.when(south, max(0, h - 1 - n)).otherwise(min(h - 1, n)).cast("long")
    near = pixels.withColumn("ref", ref).join(at(F.col("x"), "a"), ["ref", "x"]).join(at((F.col("x") + w // 2) % w, "b"), ["ref", "x"])
    return near.select("y", "x", (F.col("v") * (1 - share) + 0.5 * (F.col("a") + F.col("b")) * share).alias("v"))


def river_intensity(accum: Column, ocean: Column, threshold: float) -> Column:
    """The drained area over twice the threshold, 1 at most; 0 at sea."""
    return F.when(ocean, 0.0).otherwise(F.least(F.lit(1.0), accum / (2 * threshold)))


def paint(field: Field, strokes: DataFrame) -> Field:
    """The field with values set by strokes (cell, v, ord): the last stroke of a cell counts."""
    last = strokes.groupBy("cell").agg(F.max_by("v", "ord").alias("__v"))
    return Field(field.df.join(last, "cell", "left").select("cell", F.coalesce("__v", "v").alias("v")), field.frequency)
