"""The sky over places and days: sun, moons, planets and stars, eclipses and conjunctions, and charts from other systems.

planets (planet, a, ecc, period, phase, radius_earth, albedo), moons (moon, period, phase0, inclination) and a home planet are short tables of a
world's author; days and places are the long side, so every answer is a broadcast of a checked, short table and a map. SHORT bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import astro
from .temporal import sessions

#: Rows of a table of planets or moons at most.
SHORT = 1000


def short(df: DataFrame) -> DataFrame:
    """df to be broadcast; an error if it isn't as short as an author's list."""
    if df.limit(SHORT + 1).count() > SHORT:
        raise ValueError(f"more than {SHORT} bodies")
    return F.broadcast(df)


def _home(days: DataFrame, home: dict) -> astro.Vector:
    return astro.orbit_position(F.col("day"), *(F.lit(float(home[k])) for k in ("period", "a", "ecc", "phase")))


def sun_direction(home: dict, tilt: float) -> astro.Vector:
    x, y, z = astro.orbit_position(F.col("day"), *(F.lit(float(home[k])) for k in ("period", "a", "ecc", "phase")))
    n = F.sqrt(x * x + y * y + z * z)
    return astro.tilted((-x / n, -y / n, -z / n), tilt)


def moons_of(days: DataFrame, moons: DataFrame, home: dict, tilt: float) -> DataFrame:
    """days (day, ...) x moons -> ... moon, x, y, z, elongation (radians), lit, phase."""
    both = days.crossJoin(short(moons))
    sun = sun_direction(home, tilt)
    m = astro.moon_direction(F.col("day"), F.col("period"), F.col("phase0"), F.col("inclination"), tilt)
    e = both.select(*days.columns, "moon", *(c.alias(n) for c, n in zip(m, "xyz", strict=True)), *(c.alias(f"s{n}") for c, n in zip(sun, "xyz", strict=True)))
    elong = astro.elongation((F.col("x"), F.col("y"), F.col("z")), (F.col("sx"), F.col("sy"), F.col("sz")))
    e = e.withColumn("elongation", elong)
    return e.select(*days.columns, "moon", "x", "y", "z", "elongation", astro.phase_fraction(F.col("elongation")).alias("lit"), astro.named_phase(F.col("elongation"), F.atan2("y", "x"), F.atan2("sy", "sx")).alias("phase"))


def over(places: DataFrame, moons: DataFrame, home: dict, tilt: float, hours: float) -> DataFrame:
    """places (place, lat, lon, day) -> place, sun_alt, sun_az, period, moonlight (the most of any risen moon) and moons, by name."""
    alt, az = astro.alt_az(sun_direction(home, tilt), F.col("lat"), F.col("lon"), F.col("day"), hours)
    sun = places.select("place", "lat", "lon", "day", alt.alias("sun_alt"), az.alias("sun_az"))
    sun = sun.withColumn("light_", F.when(F.col("sun_alt") > 0, "day").when(F.col("sun_alt") > -8, "twilight").otherwise("night"))
    m = moons_of(sun, moons, home, tilt).withColumnRenamed("light_", "period")
    malt, maz = astro.alt_az((F.col("x"), F.col("y"), F.col("z")), F.col("lat"), F.col("lon"), F.col("day"), hours)
    m = m.withColumns({"alt": malt, "az": maz})
    one = F.struct("moon", F.round("alt", 1).alias("alt"), F.round("az", 1).alias("az"), F.round("lit", 3).alias("lit"), "phase", (F.col("alt") > 0).alias("up"))
    risen = F.round(F.coalesce(F.max(F.when(F.col("alt") > 0, F.col("lit"))), F.lit(0.0)), 3)
    return m.groupBy("place", "sun_alt", "sun_az", "period").agg(risen.alias("moonlight"), F.sort_array(F.collect_list(one)).alias("moons"))


def lighting(sky: DataFrame) -> DataFrame:
    """over() with `light`: in words."""
    dim = F.when(F.col("moonlight") > 0.6, "bright moonlight").when(F.col("moonlight") > 0.15, "faint moonlight").otherwise("starlight only")
    return sky.withColumn("light", F.when(F.col("period") == "day", F.when(F.col("sun_alt") > 30, "full daylight").otherwise("low sun")).when(F.col("period") == "twilight", "twilight").otherwise(dim))


def eclipses(days: DataFrame, moon: str, moons: DataFrame, home: dict, tilt: float, near: float = 0.9) -> DataFrame:
    """days (day; a raster of time) -> type, day: the first day of each passage within `near` degrees of the sun or of the point against it.

    A passage takes a few steps, and the next one is half a month away at least, so passages are sessions with a gap of a quarter of the month."""
    at = moons_of(days.select("day"), moons.where(F.col("moon") == moon), home, tilt).withColumn("deg", F.degrees("elongation"))
    kind = F.when(F.col("deg") < near, "solar").when(F.col("deg") > 180 - near, "lunar")
    hits = at.select(kind.alias("type"), "day", "deg").where("type IS NOT NULL")
    quarter = moons.where(F.col("moon") == moon).first()["period"] / 4
    return sessions(hits, ["type"], "day", quarter, "deg").select("type", F.col("start").alias("day"))


def planets_at(days: DataFrame, planets: DataFrame, home: dict, tilt: float, luminosity: float = 1.0) -> DataFrame:
    """days (day, ...) x planets -> ... planet, x, y, z (equatorial, from home), magnitude, phase_deg."""
    both = days.crossJoin(short(planets))
    p = astro.orbit_position(F.col("day"), *(F.col(k) for k in ("period", "a", "ecc", "phase")))
    h = _home(days, home)
    e = both.withColumns({**{f"p{n}": c for n, c in zip("xyz", p, strict=True)}, **{f"h{n}": c for n, c in zip("xyz", h, strict=True)}})
    rel = tuple(F.col(f"p{n}") - F.col(f"h{n}") for n in "xyz")
    d, r = F.sqrt(astro.dot(rel, rel)), F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2)
    e = e.withColumns({"d": d, "r": r, **{f"r{n}": c for n, c in zip("xyz", rel, strict=True)}})
    chi = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sum(F.col(f"p{n}") * F.col(f"r{n}") for n in "xyz") / (F.col("r") * F.col("d")))))
    e = e.withColumn("chi", chi)
    direction = astro.tilted(tuple(F.col(f"r{n}") / F.col("d") for n in "xyz"), tilt)
    mag = astro.planet_magnitude(luminosity, F.col("r"), F.col("d"), F.col("chi"), F.col("radius_earth"), F.col("albedo"))
    return e.select(*days.columns, "planet", *(c.alias(n) for c, n in zip(direction, "xyz", strict=True)), mag.alias("magnitude"), F.degrees("chi").alias("phase_deg"))


def conjunctions(days: DataFrame, planets: DataFrame, home: dict, tilt: float, within_deg: float = 1.5, step: float = 0.5) -> DataFrame:
    """days (day; a raster of time by `step`) -> a, b, day, sep_deg: the closest moment of each spell in which two planets stand together."""
    at = planets_at(days.select("day"), planets, home, tilt).select("day", "planet", "x", "y", "z")
    both = at.toDF("day", "a", "ax", "ay", "az").join(at.toDF("day", "b", "bx", "by", "bz"), "day").where("a < b")
    sep = F.degrees(astro.elongation(tuple(F.col(f"a{n}") for n in "xyz"), tuple(F.col(f"b{n}") for n in "xyz")))
    close = both.select("a", "b", "day", sep.alias("sep")).where(F.col("sep") < within_deg)
    return sessions(close, ["a", "b"], "day", 1.5 * step, "sep").select("a", "b", F.col("peak").alias("day"), F.col("least").alias("sep_deg"))


def chart(stars: DataFrame, observer: DataFrame, years: float = 0.0, faintest: float = 6.5, most: int = 900) -> DataFrame:
    """stars (star, x, y, z in parsec, vx, vy, vz in parsec a year, absolute), observer (x, y, z; one row) -> star, dx, dy, dz, magnitude, parsec: what the
    naked eye sees from there at an epoch, the brightest first, `most` of them."""
    o = observer.select(*(F.col(c).alias(f"o{c}") for c in "xyz"))
    s = stars.crossJoin(F.broadcast(o.limit(1)))
    rel = {c: F.col(c) + F.col(f"v{c}") * years - F.col(f"o{c}") for c in "xyz"}
    s = s.withColumns({f"r{c}": e for c, e in rel.items()}).withColumn("parsec", F.sqrt(F.col("rx") ** 2 + F.col("ry") ** 2 + F.col("rz") ** 2)).where("parsec > 1e-6")
    s = s.withColumn("magnitude", astro.apparent_magnitude(F.col("absolute"), F.col("parsec"))).where(F.col("magnitude") <= faintest)
    return s.orderBy("magnitude", "star").limit(most).select("star", *((F.col(f"r{c}") / F.col("parsec")).alias(f"d{c}") for c in "xyz"), "magnitude", "parsec")


def brightest(stars: DataFrame, lat: float, lon: float, day: float, hours: float, most: int = 80) -> DataFrame:
    """stars (star, x, y, z equatorial, magnitude) -> star, alt, az, magnitude of the brightest `most` above the horizon."""
    alt, az = astro.alt_az((F.col("x"), F.col("y"), F.col("z")), F.lit(lat), F.lit(lon), F.lit(day), hours)
    return stars.select("star", alt.alias("alt"), az.alias("az"), "magnitude").where("alt > 0").orderBy("magnitude", "star").limit(most)


def catalogue(systems: DataFrame, names: DataFrame) -> DataFrame:
    """systems (star, ...) with the names that users gave them, or else their own."""
    given = names.groupBy("star").agg(F.max_by("name", "rev").alias("given"))
    return systems.join(given, "star", "left").withColumn("name", F.coalesce("given", "name")).drop("given")

