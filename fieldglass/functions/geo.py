"""Distances, bearings, cells and shapes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in metres, metres per degree of the cone frame.
RADIUS_SHARED, RADIUS_EXPOSURE = 6_372_800.0, 6_371_000.0
METRES_PER_DEGREE = 111_320.0
# Radius of rhumb lines, half-axes of the ellipsoid.
RADIUS_RHUMB = 6_378_137.0
ELLIPSOID_A, ELLIPSOID_B = 6_378_137.0, 6_356_752.3142


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Great-circle distance in metres; null if any argument is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / F.lit(2.0)), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / F.lit(2.0)), F.lit(2.0))
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_6372800(*args: Column) -> Column:
    return haversine(*args, radius=RADIUS_SHARED)


def haversine_6371000(*args: Column) -> Column:
    return haversine(*args, radius=RADIUS_EXPOSURE)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    turn = F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))
    return F.pmod(turn + F.lit(360.0), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Unsigned difference of two bearings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Great-circle midpoint."""
    d, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    x, y = F.cos(p2) * F.cos(d), F.cos(p2) * F.sin(d)
    lat = F.atan2(F.sin(p1) + F.sin(p2), F.sqrt(F.pow(F.cos(p1) + x, F.lit(2.0)) + y * y))
    return F.degrees(lat), F.degrees(F.radians(lon1) + F.atan2(y, F.cos(p1) + x))


def signed_angle(a: Column, b: Column) -> Column:
    """Turn from bearing a to bearing b in degrees, above -180 and up to 180."""
    turn = F.pmod(b - a, F.lit(360.0))
    return F.when(turn > 180, turn - F.lit(360.0)).otherwise(turn)


def rhumb_destination(lat: Column, lon: Column, metres: Column, degrees: Column) -> tuple[Column, Column]:
    """Where a constant course leads; on a parallel the stretch of longitude is that of the start."""
    d, p1, course = metres / F.lit(RADIUS_RHUMB), F.radians(lat), F.radians(degrees)
    dp = d * F.cos(course)
    grid = lambda p: F.tan(p / F.lit(2.0) + F.pi() / F.lit(4.0))
    dpsi = F.log(grid(p1 + dp) / grid(p1))
    q = F.when(F.abs(dpsi) > F.lit(10e-12), dp / dpsi).otherwise(F.cos(p1))
    return F.degrees(p1 + dp), lon + F.degrees(d * F.sin(course) / q)


def intermediate(lat1: Column, lon1: Column, lat2: Column, lon2: Column, share: Column) -> tuple[Column, Column]:
    """The point at a share of the great circle between two points."""
    p1, l1, p2, l2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    d = haversine(lat1, lon1, lat2, lon2, radius=1.0)
    a, b = F.sin((F.lit(1.0) - share) * d) / F.sin(d), F.sin(share * d) / F.sin(d)
    x, y = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2), a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    return F.degrees(F.atan2(a * F.sin(p1) + b * F.sin(p2), F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def projection_share(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where on a segment, from 0 to 1, the nearest point lies, in plain degrees; 0 on a segment without length."""
    dot = (lat2 - lat1) * (lat - lat1) + (lon2 - lon1) * (lon - lon1)
    size = (lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * (lon2 - lon1)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(dot / F.nullif(size, F.lit(0.0)), F.lit(0.0))))


def orthogonal_metres(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to a segment."""
    share = projection_share(lat, lon, lat1, lon1, lat2, lon2)
    return haversine_6372800(lat, lon, lat1 + (lat2 - lat1) * share, lon1 + (lon2 - lon1) * share)


def vincenty(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 20) -> Column:
    """Metres on the ellipsoid, by a fixed number of rounds; points that coincide are 0 apart."""
    f = (ELLIPSOID_A - ELLIPSOID_B) / ELLIPSOID_A
    u1, u2 = (F.atan(F.lit(1 - f) * F.tan(F.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2, apart = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2), F.radians(lon2 - lon1)
    zero = F.lit(0.0)

    def state(turn: Column) -> Column:
        t = c2 * F.sin(turn)
        v = c1 * s2 - s1 * c2 * F.cos(turn)
        return F.struct(turn.alias("turn"), F.sqrt(t * t + v * v).alias("ss"), (s1 * s2 + c1 * c2 * F.cos(turn)).alias("cs"))

    def angles(a: Column) -> tuple[Column, Column, Column]:
        sin_alpha = F.coalesce(c1 * c2 * F.sin(a["turn"]) / F.nullif(a["ss"], zero), zero)
        cos2 = F.lit(1.0) - sin_alpha * sin_alpha
        return sin_alpha, cos2, F.coalesce(a["cs"] - F.lit(2.0) * s1 * s2 / F.nullif(cos2, zero), zero)

    def step(a: Column, _: Column) -> Column:
        sin_alpha, cos2, mid = angles(a)
        c = F.lit(f / 16) * cos2 * (F.lit(4.0) + F.lit(f) * (F.lit(4.0) - F.lit(3.0) * cos2))
        sigma = F.atan2(a["ss"], a["cs"])
        bend = sigma + c * a["ss"] * (mid + c * a["cs"] * (F.lit(-1.0) + F.lit(2.0) * mid * mid))
        return state(apart + (F.lit(1.0) - c) * F.lit(f) * sin_alpha * bend)

    def finish(a: Column) -> Column:
        _, cos2, mid = angles(a)
        uu = cos2 * F.lit((ELLIPSOID_A**2 - ELLIPSOID_B**2) / ELLIPSOID_B**2)
        big = F.lit(1.0) + uu / F.lit(16384.0) * (F.lit(4096.0) + uu * (F.lit(-768.0) + uu * (F.lit(320.0) - F.lit(175.0) * uu)))
        small = uu / F.lit(1024.0) * (F.lit(256.0) + uu * (F.lit(-128.0) + uu * (F.lit(74.0) - F.lit(47.0) * uu)))
        inner = a["cs"] * (F.lit(-1.0) + F.lit(2.0) * mid * mid)
        outer = small / F.lit(6.0) * mid * (F.lit(-3.0) + F.lit(4.0) * a["ss"] * a["ss"]) * (F.lit(-3.0) + F.lit(4.0) * mid * mid)
        bend = small * a["ss"] * (mid + small / F.lit(4.0) * (inner - outer))
        return F.lit(ELLIPSOID_B) * big * (F.atan2(a["ss"], a["cs"]) - bend)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(apart), step, finish)


def ring_area(ring: Column) -> Column:
    """Signed planar area of a closed ring, in its own units squared; positive if counter-clockwise."""
    pairs = F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("p"), F.slice(ring, 2, 1_000_000).alias("q"))
    return F.aggregate(pairs, F.lit(0.0), lambda a, e: a + (e["p"]["lon"] * e["q"]["lat"] - e["q"]["lon"] * e["p"]["lat"]) / F.lit(2.0))


def box_around(lat: Column, lon: Column, metres: Column) -> Column:
    """struct<south, west, north, east> that reaches so far each way, cut at the poles and the date line."""
    high = F.degrees(metres / F.lit(RADIUS_SHARED))
    wide = high / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))
    return F.struct(
        F.greatest(lat - high, F.lit(-90.0)).alias("south"), F.greatest(lon - wide, F.lit(-180.0)).alias("west"),
        F.least(lat + high, F.lit(90.0)).alias("north"), F.least(lon + wide, F.lit(180.0)).alias("east"),
    )


def albers(lat: Column, lon: Column, lat1: float = 29.5, lat2: float = 45.5, lat0: float = 37.5, lon0: float = -96.0) -> tuple[Column, Column]:
    """Equal-area conic coordinates on the unit sphere."""
    p1, p2, p0 = (math.radians(x) for x in (lat1, lat2, lat0))
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho, rho0 = F.sqrt(F.lit(c) - F.lit(2 * n) * F.sin(F.radians(lat))) / F.lit(n), math.sqrt(c - 2 * n * math.sin(p0)) / n
    theta = F.lit(n) * F.radians(lon - F.lit(lon0))
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def cell(value: Column, size: float) -> Column:
    """Grid cell by floor, so that -75.5 and 75.5 are treated alike."""
    return F.floor(value / F.lit(float(size))).cast("long")


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.lit(float(1 << zoom))).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.pi()) / F.lit(2.0) * F.lit(float(1 << zoom))).cast("long")


def tile_west(x: Column, zoom: int) -> Column:
    """Longitude of a tile's left side."""
    return x / F.lit(float(1 << zoom)) * F.lit(360.0) - F.lit(180.0)


def tile_north(y: Column, zoom: int) -> Column:
    """Latitude of a tile's upper side."""
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - F.lit(2.0) * y / F.lit(float(1 << zoom))))))


def unmorton(code: Column, odd: bool, bits: int = 16) -> Column:
    """The number in the even (or odd) places of interleaved bits."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 2 * i + odd).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Interleaved bits of x (even places) and y (odd places)."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), 2 * i))
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + 1))
    return out


def wedge_ring(lat: Column, lon: Column, centre: Column, span: Column, radius_m: float = 60.0, steps: int = 8) -> Column:
    """Ring of a field of view: apex, arc of steps + 1 points, apex; array<struct<lon, lat>>."""
    east = F.lit(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))

    def at(i: Column) -> Column:
        a = F.radians(centre - span / F.lit(2.0) + span * i.cast("double") / F.lit(float(steps)))
        return F.struct((lon + F.lit(radius_m) * F.sin(a) / east).alias("lon"), (lat + F.lit(radius_m) * F.cos(a) / F.lit(METRES_PER_DEGREE)).alias("lat"))

    apex = F.array(F.struct(lon.alias("lon"), lat.alias("lat")))
    return F.concat(apex, F.transform(F.sequence(F.lit(0), F.lit(steps)), at), apex)


def cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Twice the signed area of a triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two segments share a point; segments that only lie on one line do not count."""
    return (cross(ax, ay, bx, by, cx, cy) * cross(ax, ay, bx, by, dx, dy) <= 0) & (
        cross(cx, cy, dx, dy, ax, ay) * cross(cx, cy, dx, dy, bx, by) <= 0
    ) & (F.greatest(F.abs(cross(ax, ay, bx, by, cx, cy)), F.abs(cross(ax, ay, bx, by, dx, dy))) > 0)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast; a ring is an array<struct<lon, lat>> whose last point is the first."""
    edges = F.arrays_zip(ring.alias("p"), F.slice(ring, 2, 1_000_000).alias("q"))

    def crosses(e: Column) -> Column:
        px, py, qx, qy = e["p"]["lon"], e["p"]["lat"], e["q"]["lon"], e["q"]["lat"]
        return ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / F.nullif(qy - py, F.lit(0.0)) + px)

    return F.size(F.filter(edges, lambda e: e["q"].isNotNull() & F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


# Metres in a unit of length, metres a second in a unit of speed.
LENGTH = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0}
SPEED = {"m/s": 1.0, "km/h": 1 / 3.6, "mph": 0.44704, "kn": 1852 / 3600}
# Kilograms in a unit of weight, degrees in a unit of angle.
WEIGHT = {"kg": 1.0, "t": 1000.0, "lb": 0.45359237}
ANGLE = {"deg": 1.0, "rad": 180 / math.pi, "mil": 360 / 6400}


def convert(value: Column, table: dict[str, float], source: str, target: str) -> Column:
    return value * F.lit(table[source] / table[target])


def fahrenheit(celsius: Column) -> Column:
    return celsius * F.lit(1.8) + F.lit(32.0)
