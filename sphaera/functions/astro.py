"""Stars, orbits and phases as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of the phases, from new on.
PHASES = ("new", "waxing crescent", "first quarter", "waxing gibbous", "full", "waning gibbous", "last quarter", "waning crescent")


def kepler(mean: Column, ecc: Column, steps: int = 8) -> Column:
    """Eccentric anomaly by a fixed number of Newton steps."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), mean + ecc * F.sin(mean), lambda e, _: e - (e - ecc * F.sin(e) - mean) / (1 - ecc * F.cos(e)))


def orbit_xy(day: Column, period: Column, axis: Column, ecc: Column, phase: Column) -> tuple[Column, Column]:
    """Position in the orbital plane."""
    e = kepler(2 * F.pi() * F.pmod(day / period + phase, F.lit(1.0)), ecc)
    return axis * (F.cos(e) - ecc), axis * F.sqrt(1 - ecc * ecc) * F.sin(e)


def apparent_magnitude(absolute: Column, parsec: Column) -> Column:
    return absolute + 5 * (F.log10(parsec) - 1)


def phase_fraction(elongation: Column) -> Column:
    """Lit fraction of a disc by its elongation in radians."""
    return (1 - F.cos(elongation)) / 2


def phase_name(longitude: Column) -> Column:
    """Name of the phase by a moon's longitude ahead of the sun, in radians."""
    octant = F.floor(F.pmod(longitude, 2 * F.pi()) / (F.pi() / 4) + 0.5) % 8
    return F.element_at(F.array(*map(F.lit, PHASES)), (octant + 1).cast("int"))


#: The sun's apparent magnitude at one astronomical unit, and the earth's radius in such units.
SUN_MAGNITUDE, EARTH_AU = -26.74, 4.26352e-5

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def tilted(v: Vector, radians: Column | float) -> Vector:
    """Turned about the x axis, as from the ecliptic to the equator."""
    c, s = (F.cos(F.lit(radians)), F.sin(F.lit(radians)))
    return v[0], v[1] * c - v[2] * s, v[1] * s + v[2] * c


def scaled(v: Vector, by: Column) -> Vector:
    return v[0] * by, v[1] * by, v[2] * by


def moon_direction(day: Column, period: Column, phase0: Column, inclination: Column, tilt: float) -> Vector:
    """Unit vector of a moon on a circle; angles in radians."""
    lam = 2 * F.pi() * (day / period) + phase0
    return tilted(tilted((F.cos(lam), F.sin(lam), F.lit(0.0)), inclination), tilt)


def orbit_position(day: Column, period: Column, axis: Column, ecc: Column, phase: Column) -> Vector:
    x, y = orbit_xy(day, period, axis, ecc, phase)
    return x, y, F.lit(0.0)


def alt_az(v: Vector, lat: Column, lon: Column, day: Column, hours: float) -> tuple[Column, Column]:
    """Height and azimuth (from north by east) in degrees of an equatorial direction, for a place in degrees on a planet that turns once in so many hours."""
    theta, la = 2 * F.pi() * (day * 24 / hours) + F.radians(lon), F.radians(lat)
    zenith = (F.cos(la) * F.cos(theta), F.cos(la) * F.sin(theta), F.sin(la))
    north = (-F.sin(la) * F.cos(theta), -F.sin(la) * F.sin(theta), F.cos(la))
    east = (north[1] * zenith[2] - north[2] * zenith[1], north[2] * zenith[0] - north[0] * zenith[2], north[0] * zenith[1] - north[1] * zenith[0])
    alt = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(v, zenith)))))
    return alt, F.pmod(F.degrees(F.atan2(dot(v, east), dot(v, north))), F.lit(360.0))


def elongation(a: Vector, b: Vector) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


def planet_magnitude(luminosity: float, from_star: Column, distance: Column, phase: Column, radius_earth: Column, albedo: Column) -> Column:
    """Of a planet that reflects its star as Lambert's sphere; distances in astronomical units, the phase angle in radians."""
    lambert = (F.sin(phase) + (F.pi() - phase) * F.cos(phase)) / F.pi()
    flux = luminosity / (from_star * from_star) * albedo * F.pow(radius_earth * EARTH_AU / distance, F.lit(2)) * (2.0 / 3.0) * F.greatest(lambert, F.lit(1e-9))
    return SUN_MAGNITUDE - 2.5 * F.log10(F.greatest(flux, F.lit(1e-30)))


def named_phase(elong: Column, moon_lon: Column, sun_lon: Column) -> Column:
    """Name of the phase by the elongation, waxing when the moon is ahead of the sun (angles in radians)."""
    octant = F.floor(elong / F.pi() * 4 + 0.5)
    k = F.when(F.sin(moon_lon - sun_lon) > 0, octant).otherwise((8 - octant) % 8)
    return F.element_at(F.array(*map(F.lit, PHASES)), (k + 1).cast("int"))
