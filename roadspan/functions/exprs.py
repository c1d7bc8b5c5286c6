"""Column expressions of the trace geometry: angles, frames, boxes, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius of the local plane, the ego box, interval limits (m, m/s).
EARTH_RADIUS_M = 6378137.0
EGO_LENGTH, EGO_WIDTH, EGO_HEIGHT = 4.9, 1.9, 1.5


def turn_of(a: Column) -> Column:
    """Angle in [0, 360), by SQL's arithmetic: pmod differs in the last bit, and limits are compared exactly."""
    return (a % 360.0 + 360.0) % 360.0


def wrap_degrees(a: Column) -> Column:
    """Angle in [-180, 180)."""
    return turn_of(a + 180.0) - 180.0


def wrap_radians(a: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def yaw_of_heading(heading_deg: Column) -> Column:
    """Mathematical yaw in radians of a heading counted counter-clockwise from north."""
    return F.radians(F.pmod(heading_deg + 90.0, F.lit(360.0)))


def axis_angle(zrot: Column) -> Column:
    """Angle between a box's axis and the ego's, folded to [0, 90] degrees."""
    a = F.abs(wrap_degrees(F.degrees(zrot)))
    return F.least(a, 180.0 - a)


def local_east_north(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular metres from an anchor."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_M, F.radians(lat - lat0) * EARTH_RADIUS_M


def body_to_global(x: Column, y: Column, ex: Column, ey: Column, yaw: Column) -> tuple[Column, Column]:
    return ex + x * F.cos(yaw) - y * F.sin(yaw), ey + x * F.sin(yaw) + y * F.cos(yaw)


def global_to_body(x: Column, y: Column, ex: Column, ey: Column, yaw: Column) -> tuple[Column, Column]:
    return (x - ex) * F.cos(yaw) + (y - ey) * F.sin(yaw), (y - ey) * F.cos(yaw) - (x - ex) * F.sin(yaw)


def global_heading(yaw: Column, zrot: Column) -> Column:
    return turn_of(F.degrees(yaw + zrot))


def zrot_of_heading(heading_deg: Column, yaw: Column) -> Column:
    return wrap_radians(F.radians(heading_deg) - yaw)


def boxes_overlap(x1: Column, y1: Column, yaw1: Column, l1: Column, w1: Column, x2: Column, y2: Column, yaw2: Column, l2: Column, w2: Column) -> Column:
    """Separating-axis test of two oriented boxes; touching counts. Axes of edges up to 1e-9 long are left out."""
    dx, dy = x2 - x1, y2 - y1
    parts = []
    for yaw, side, own, edge in ((yaw1, 0, l1, l1), (yaw1, 1, w1, w1), (yaw2, 0, l2, l2), (yaw2, 1, w2, w2)):
        ux, uy = (F.cos(yaw), F.sin(yaw)) if side == 0 else (-F.sin(yaw), F.cos(yaw))
        reach = F.lit(0.0)
        for y, ln, wd in ((yaw1, l1, w1), (yaw2, l2, w2)):
            reach = reach + F.abs(ux * F.cos(y) + uy * F.sin(y)) * ln / 2 + F.abs(uy * F.cos(y) - ux * F.sin(y)) * wd / 2
        parts.append((edge <= 1e-9) | (F.abs(ux * dx + uy * dy) <= reach))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def severity(value: Column, medium: float, high: float) -> Column:
    """high, medium or null; limits themselves are allowed."""
    return F.when(value > high, "high").when(value > medium, "medium")


#: Limits of speed (m/s), acceleration (m/s2) and yaw rate (deg/s): medium, high.
SPEED_LIMITS, ACCEL_LIMITS, YAW_RATE_LIMITS = (45.0, 60.0), (6.0, 12.0), (15.0, 40.0)


def compass_bearing(yaw_deg: Column) -> Column:
    """True bearing, clockwise from north, of a mathematical yaw in degrees."""
    return F.pmod(450.0 - yaw_deg, F.lit(360.0))


def compass_label(bearing: Column) -> Column:
    """N, NE, ... of a bearing."""
    names = F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW")))
    return F.element_at(names, (F.pmod(F.floor(bearing / 45.0 + 0.5), F.lit(8)) + 1).cast("int"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180.0) / 6.0) + 1).cast("int")


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing (WGS 84) by the Krueger series to the third order."""
    n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (utm_zone(lon) * 6.0 - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * a * east, F.when(lat < 0, 1e7).otherwise(0.0) + 0.9996 * a * north


#: Words in an object's type, reference sizes (m) of models, categories, OpenDRIVE types of static objects.
PEDESTRIAN_WORDS, TRAILER_WORDS = ["pedestrian", "person"], ["trailer"]
MOTORCYCLE_WORDS = ["motorcycle", "motorbike", "bike", "bicycle", "scooter"]
TRUCK_WORDS, TRUCK_LENGTH = ["truck", "trailer", "semi"], 9.0
CAR_SIZE, MOTORBIKE_SIZE, TRUCK_WIDTH, PEDESTRIAN_HEIGHT = (4.10, 1.80), (1.95, 1.80), 1.8, 1.8
CATEGORIES = ["car", "truck", "van", "bus", "motorbike"]
STATIC_TYPES = {"Traffic Sign": "pole", "Highly Reflective Marker": "pole", "Highway Accessories": "none"}


def _any_word(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.lower(text).contains(w)
    return found


def actor_type(obj_type: Column) -> Column:
    """PEDESTRIAN, TRAILER, UNKNOWN or VEHICLE by words in the type."""
    return F.when(_any_word(obj_type, PEDESTRIAN_WORDS), "PEDESTRIAN").when(_any_word(obj_type, TRAILER_WORDS), "TRAILER").when(_any_word(obj_type, ["unknown"]), "UNKNOWN").otherwise("VEHICLE")


def model_guess(obj_type: Column, length: Column, width: Column) -> Column:
    """struct(model, scale_x, scale_y): a box for pedestrians, else an asset scaled to the object's size, four decimals."""
    scaled = lambda name, size: F.struct(F.lit(name).alias("model"), F.round(length / size[0], 4).alias("scale_x"), F.round(width / size[1], 4).alias("scale_y"))
    none = F.lit(None).cast("double")
    return (
        F.when(_any_word(obj_type, PEDESTRIAN_WORDS), F.struct(F.lit("box").alias("model"), none.alias("scale_x"), none.alias("scale_y")))
        .when(_any_word(obj_type, TRUCK_WORDS) | (length > TRUCK_LENGTH), F.struct(F.lit("CONFIGURABLE_SEMI_TRUCK").alias("model"), none.alias("scale_x"), F.round(width / TRUCK_WIDTH, 4).alias("scale_y")))
        .when(_any_word(obj_type, MOTORCYCLE_WORDS), scaled("GENERIC_DAELIM_MOTORBIKE", MOTORBIKE_SIZE))
        .otherwise(scaled("GENERIC_YARIS", CAR_SIZE))
    )


def scenario_category(obj_type: Column) -> Column:
    low = F.lower(F.trim(obj_type))
    return F.when(low.isin(CATEGORIES), low).otherwise("car")


def static_type(obj_type: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in STATIC_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(kinds, obj_type), F.lit("none"))


def slug(name: Column) -> Column:
    """Letters, digits, ``_`` and ``-``; runs of anything else are one ``-``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")


def moved_m(x: Column, y: Column, orig_x: Column, orig_y: Column) -> Column:
    """Distance from the place as recorded; 0 where nothing was moved."""
    return F.coalesce(F.hypot(x - orig_x, y - orig_y), F.lit(0.0))


def line_side(points: Column) -> Column:
    """left or right of the ego by the mean y of points in its frame; null without points."""
    mean = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["y"]) / F.size(points)
    return F.when(F.size(points) > 0, F.when(mean > 0, "left").otherwise("right"))
