"""Spherical geometry, vector rotation and sea-water equations as column expressions."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere in metres; degrees to metres along a meridian.
EARTH = 6367500.0
DEGREE = EARTH * radians(1.0)


def wrap(d: Column, period: float = 360.0) -> Column:
    """A difference of longitudes in the half-open interval from -period/2 to period/2."""
    return d - F.floor(d / period + 0.5) * period


def triangle_area(lon: list[Column], lat: list[Column]) -> Column:
    """Planar area of a triangle in square metres, with the cosine of the mean latitude; longitudes wrap."""
    c = F.cos(F.radians((lat[0] + lat[1] + lat[2]) / 3))
    ax, bx = wrap(lon[1] - lon[0]) * c, wrap(lon[2] - lon[0]) * c
    ay, by = lat[1] - lat[0], lat[2] - lat[0]
    return F.abs(ax * by - bx * ay) * (0.5 * DEGREE * DEGREE)


def side_length(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Length of an edge in metres, with the cosine of its mean latitude."""
    dx = wrap(lon1 - lon0) * F.cos(F.radians((lat0 + lat1) / 2))
    dy = lat1 - lat0
    return F.sqrt(dx * dx + dy * dy) * DEGREE


def cart3d(lon: Column, lat: Column, r: float = 1.0) -> tuple[Column, Column, Column]:
    """Cartesian coordinates on a sphere of radius ``r``."""
    x, y = F.radians(lon), F.radians(lat)
    return F.cos(y) * F.cos(x) * r, F.cos(y) * F.sin(x) * r, F.sin(y) * r


def euler(abg: tuple[float, float, float]) -> list[list[float]]:
    """Rotation matrix of three Euler angles in degrees (about z, x, z): geographic to rotated frame."""
    a, b, g = map(radians, abg)
    return [
        [cos(g) * cos(a) - sin(g) * cos(b) * sin(a), cos(g) * sin(a) + sin(g) * cos(b) * cos(a), sin(g) * sin(b)],
        [-sin(g) * cos(a) - cos(g) * cos(b) * sin(a), -sin(g) * sin(a) + cos(g) * cos(b) * cos(a), cos(g) * sin(b)],
        [sin(b) * sin(a), -sin(b) * cos(a), cos(b)],
    ]


def _turned(m: list[list[float]], v: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in m)


def _lonlat(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan2(y, x)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def geo_to_rot(abg, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in the rotated frame."""
    return _lonlat(*_turned(euler(abg), cart3d(lon, lat)))


def rot_to_geo(abg, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in the geographic frame; the inverse of a rotation is its transpose."""
    return _lonlat(*_turned([list(r) for r in zip(*euler(abg), strict=True)], cart3d(lon, lat)))


def refocus(lon: Column, lat: Column, focus: float) -> Column:
    """Longitude centred on ``focus``."""
    return geo_to_rot((focus, 0.0, 0.0), lon, lat)[0] + focus


def rotate_vector(abg, lon: Column, lat: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """East and north component of a vector given in the rotated frame, at geographic ``lon, lat``."""
    rlon, rlat = (F.radians(c) for c in geo_to_rot(abg, lon, lat))
    x = -v * F.sin(rlat) * F.cos(rlon) - u * F.sin(rlon)
    y = -v * F.sin(rlat) * F.sin(rlon) + u * F.cos(rlon)
    z = v * F.cos(rlat)
    gx, gy, gz = _turned([list(r) for r in zip(*euler(abg), strict=True)], (x, y, z))
    a, b = F.radians(lon), F.radians(lat)
    return -gx * F.sin(a) + gy * F.cos(a), -gx * F.sin(b) * F.cos(a) - gy * F.sin(b) * F.sin(a) + gz * F.cos(b)


def norm(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def decimal_year(t: Column) -> Column:
    """Year and the fraction of it that has passed at the start of the day; leap years have 366 days."""
    y = F.year(t)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return y + (F.dayofyear(t) - 1) / F.when(leap, 366.0).otherwise(365.0)


def sphere_distance(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = cart3d(lon0, lat0), cart3d(lon1, lat1)
    return F.acos(F.least(F.lit(1.0), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])) * EARTH


#: Coefficients of the UNESCO 1983 equation of state (EOS-80). Fixed values of the published standard.
EOS80 = {
    "water": (999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9),
    "salt1": (8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9),
    "salt15": (-5.72466e-3, 1.0227e-4, -1.6546e-6),
    "salt2": 4.8314e-4,
    "bulk_water": (19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5),
    "bulk_salt1": (54.6746, -0.603459, 1.09987e-2, -6.1670e-5),
    "bulk_salt15": (7.944e-2, 1.6483e-2, -5.3009e-4),
    "a_water": (3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7),
    "a_salt1": (2.2838e-3, -1.0981e-5, -1.6078e-6),
    "a_salt15": 1.91075e-4,
    "b_water": (8.50935e-5, -6.12293e-6, 5.2787e-8),
    "b_salt1": (-9.9348e-7, 2.0816e-8, 9.1697e-10),
}


def _poly(c, t):
    out = c[-1] * t
    for k in c[-2:0:-1]:
        out = (out + k) * t
    return out + c[0]


def sea_density(salt, temp, pressure: float, sqrt=F.sqrt):
    """EOS-80 density in kg/m3; ``pressure`` in decibars. Works on columns, and on numbers with their own ``sqrt``."""
    e, p = EOS80, pressure / 10.0
    root = salt * sqrt(salt)
    rho = _poly(e["water"], temp) + salt * _poly(e["salt1"], temp) + root * _poly(e["salt15"], temp) + salt * salt * e["salt2"]
    if not p:
        return rho
    bulk = _poly(e["bulk_water"], temp) + salt * _poly(e["bulk_salt1"], temp) + root * _poly(e["bulk_salt15"], temp)
    a = _poly(e["a_water"], temp) + salt * _poly(e["a_salt1"], temp) + root * e["a_salt15"]
    b = _poly(e["b_water"], temp) + salt * _poly(e["b_salt1"], temp)
    return rho / (1 - p / (bulk + p * a + p * p * b))


def sigma(temp: Column, salt: Column, reference: float = 0.0) -> Column:
    """Potential density minus 1000 at a reference pressure in decibars; salt 0 is missing."""
    return F.when(salt != 0, sea_density(salt, temp, reference) - 1000.0)


def adiabatic_gradient(s: Column, t: Column, p: Column) -> Column:
    """Adiabatic temperature gradient in degrees per decibar (UNESCO 1983). Fixed values of the published standard."""
    ds = s - 35.0
    return (
        3.5803e-5 + t * (8.5258e-6 + t * (-6.8360e-8 + t * 6.6228e-10)) + ds * (1.8932e-6 - 4.2393e-8 * t)
        + p * (1.8741e-8 + t * (-6.7795e-10 + t * (8.7330e-12 - 5.4481e-14 * t)) + ds * (-1.1351e-10 + 2.7759e-12 * t))
        + p * p * (-4.6206e-13 + t * (1.8676e-14 - 2.1687e-16 * t))
    )


def ptemp(salt: Column, temp: Column, pressure: Column, reference: float = 0.0) -> Column:
    """Potential temperature: one Runge-Kutta step of the adiabatic gradient in four stages."""
    dp = F.lit(reference) - pressure
    half = pressure + dp / 2
    d1 = dp * adiabatic_gradient(salt, temp, pressure)
    t1, q1 = temp + d1 / 2, d1
    d2 = dp * adiabatic_gradient(salt, t1, half)
    t2, q2 = t1 + 0.29289322 * (d2 - q1), 0.58578644 * d2 + 0.121320344 * q1
    d3 = dp * adiabatic_gradient(salt, t2, half)
    t3, q3 = t2 + 1.707106781 * (d3 - q2), 3.414213562 * d3 - 4.121320344 * q2
    d4 = dp * adiabatic_gradient(salt, t3, F.lit(reference))
    return t3 + (d4 - 2 * q3) / 6
