"""Exports: worlds as folders of tables, meshes, atlases, features and the numbers behind images."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_world(tables: Mapping[str, DataFrame], path: str) -> None:
    """One Parquet table for each name below path; what was there of that name is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def load_world(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def unit16(df: DataFrame, value: str) -> DataFrame:
    """df with `level`: the value scaled to 0..65535 over its own range; 0 where the range is a point."""
    ends = df.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    t = (F.col(value) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("level", F.coalesce(F.floor(t * 65535 + 0.5), F.lit(0)).cast("int")).drop("__a", "__b")


#: Height above the sea in m and colour; between two of them colours are mixed in proportion, beyond the ends they stay.
RAMP_SEA = ((-6000, (5, 15, 80)), (-200, (30, 80, 180)), (0, (70, 150, 245)))
RAMP_LAND = ((0, (20, 100, 30)), (200, (50, 170, 60)), (800, (220, 200, 40)), (2000, (210, 120, 30)), (4000, (190, 50, 30)), (6000, (140, 60, 170)), (9000, (255, 255, 255)))


def color_ramp(z: Column, sea: float = 0.0) -> Column:
    """struct(r, g, b) of a height."""
    h = z - sea

    def channel(i: int) -> Column:
        def along(stops: tuple) -> Column:
            out = F.lit(float(stops[0][1][i]))
            for (a, ca), (b, cb) in zip(stops, stops[1:], strict=False):
                t = F.least(F.lit(1.0), (h - a) / (b - a))
                out = F.when(h >= a, ca[i] + (cb[i] - ca[i]) * t).otherwise(out)
            return out

        return F.floor(F.when(h < 0, along(RAMP_SEA)).otherwise(along(RAMP_LAND)) + 0.5).cast("int")

    return F.struct(*(channel(i).alias(c) for i, c in enumerate("rgb")))


def mask255(on: Column) -> Column:
    return F.when(on, 255).otherwise(0)


def mesh(adjacency: DataFrame) -> DataFrame:
    """a, b, c of the triangles of a grid, each once with its smallest cell first: consecutive neighbours of a cell that are both greater."""
    ring = adjacency.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("slot", "dst"))).alias("r"))
    pairs = ring.select("src", F.posexplode("r").alias("k", "p"), "r").selectExpr("src", "p.dst AS b", "r[(k + 1) % size(r)].dst AS c")
    return pairs.where("src < b AND src < c").withColumnRenamed("src", "a")


#: The corners of the ten blocks, north 0 to 4 and south 5 to 9: a block is a rhombus of two faces, (x, y, z) and (y, z, w), that share the edge y z.
BLOCKS = [(0, 1 + k, 1 + (k + 1) % 5, 6 + k) for k in range(5)] + [(11, 6 + k, 6 + (k + 1) % 5, 1 + (k + 1) % 5) for k in range(5)]


def atlas(placed: DataFrame, f: int) -> DataFrame:
    """placed (cell, on, of grid.placed()) -> cell, block, i, j: ten rhombi of f x f pixels; the poles have none.

    In the affine frame of a block, x is at (0, 0), y at (f, 0), z at (0, f) and w at (f, f), so weights on its corners add up to a place:
    those of y and w along i, those of z and w along j. A block owns its pixels but those of its sides at i = 0 and j = f."""
    held = F.transform("on", lambda v: v["corner"])
    at = lambda c: F.coalesce(F.get(F.filter("on", lambda v: v["corner"] == c), F.lit(0))["weight"], F.lit(0))
    places = [F.when(F.size(F.array_except(held, F.array(*map(F.lit, b)))) == 0, F.struct(F.lit(k).cast("long").alias("block"), (at(b[1]) + at(b[3]) - 1).cast("long").alias("i"), (at(b[2]) + at(b[3])).cast("long").alias("j"))) for k, b in enumerate(BLOCKS)]
    own = F.filter(F.array(*places), lambda p: p.isNotNull() & (p["i"] >= 0) & (p["i"] < f) & (p["j"] >= 0) & (p["j"] < f))
    return placed.select("cell", F.explode(own).alias("p")).select("cell", "p.block", "p.i", "p.j")


def from_atlas(pixels: DataFrame, placed: DataFrame, f: int) -> DataFrame:
    """pixels (block, i, j, v) -> cell, v: the way back, by a join."""
    return atlas(placed, f).join(pixels, ["block", "i", "j"]).select("cell", "v")


def feature(kind: Column, lon: Column, lat: Column, properties: Column) -> Column:
    """A point as a GeoJSON feature."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), kind.alias("kind"), properties.alias("properties")))


def transcript(events: DataFrame) -> DataFrame:
    """One JSON text per event, for write.text()."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def load_transcript(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A transcript of JSON lines."""
    return spark.read.schema(schema).json(path)


def thinned(path: DataFrame, key: str, order: str, most: int = 120) -> DataFrame:
    """Every n-th vertex of each path, so that about `most` remain."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    n = path.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    return n.where(F.col("__i") % F.greatest(F.lit(1), F.floor(F.col("__n") / most)) == 0).drop("__i", "__n")


def roughness(cells: DataFrame, adjacency: DataFrame, value: str = "z", sea: float = 0.0) -> DataFrame:
    """roughness: mean distance of land cells from the mean of their neighbours."""
    from .fields import around

    mean = around(cells, adjacency, value).groupBy("src").agg(F.first("here").alias("here"), F.avg("there").alias("there"))
    return mean.where(F.col("here") > sea).agg(F.avg(F.abs(F.col("here") - F.col("there"))).alias("roughness"))


def seams(cells: DataFrame, adjacency: DataFrame, drop: float, value: str = "z", sea: float = 0.0) -> DataFrame:
    """seams: directed edges between land cells that fall by more than drop."""
    from .fields import around

    near = around(cells, adjacency, value).where((F.col("here") > sea) & (F.col("there") > sea))
    return near.agg(F.count_if(F.col("here") - F.col("there") > drop).alias("seams"))
