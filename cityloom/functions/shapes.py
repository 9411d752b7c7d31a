"""Closed forms: ramps, curvature, piecewise lines, colours, bit fields, hashes, short programmes in strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def soft_knee(height: Column, drop: float, knee: float) -> Column:
    """0 up to `drop`, then rising, with the slope growing to 1 over twice the knee."""
    x = height - drop
    return F.when(x <= 0, 0.0).when(x < 2 * knee, x * x / (4 * knee)).otherwise(x - knee)


def smooth_ramp(distance: Column, flat: float, over: float) -> Column:
    """0 up to `flat`, then smoothly to 1 over the next `over`."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - flat) / over))
    return r * r * (3 - 2 * r)


def earth_drop(x: Column, z: Column, begin: float = 12_000.0, k: float = 0.13) -> Column:
    """How far the earth curves away at (x, z) from the origin, with refraction k."""
    r = F.greatest(F.hypot(x, z) - begin, F.lit(0.0))
    return r * r / (2 * 6_371_000.0 / (1 - k))


def curved(y: Column, drop: Column) -> Column:
    return F.when(y > 0, y * y / F.greatest(y + drop, F.lit(1e-6))).otherwise(y)


def uncurved(y: Column, drop: Column) -> Column:
    return F.when(y > 0, (y + F.sqrt(y * y + 4 * drop * F.greatest(y, F.lit(0.0)))) / 2).otherwise(y)


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through the points, constant beyond them."""
    out = F.when(x <= xs[0], float(ys[0]))
    for a, b, c, d in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= b, c + (x - a) / (b - a) * (d - c))
    return out.otherwise(float(ys[-1]))


def queue_length(length: Column, stop: Column, reach: Column, k: Column) -> Column:
    """Length of a lane's free coordinate where traffic slows to the share k of its speed over `reach` before `stop`."""
    slow = F.log(1 / k) / (1 - k)
    near = F.least(reach, stop)
    return F.when(k >= 0.99, length).otherwise(stop - near + (near + length - stop) * slow)


def channel(colour: Column, n: int) -> Column:
    """Channel 0 to 2 of #rrggbb, from 0 to 255."""
    return F.conv(F.substring(colour, 2 + 2 * n, 2), 16, 10).cast("int")


def linear(value: Column) -> Column:
    """An sRGB channel (0 to 255) in linear light, 0 to 1."""
    v = value / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def cylinder_bits(lying: Column, stand: Column) -> Column:
    """Bit 0 lying, bits 1 to 7 the stand's height in 5 cm."""
    return lying.cast("int").bitwiseOR(F.shiftleft(F.least(F.lit(127), F.bround(stand / 0.05).cast("int")), 1))


def panel_bits(front: Column, tank: Column) -> Column:
    """Bits 0 to 6 the front's height as a share of the back's, bit 7 a tank."""
    return F.least(F.lit(127), F.bround(front * 127).cast("int")).bitwiseOR(F.shiftleft(tank.cast("int"), 7))


def split_bytes(values: Column) -> Column:
    """Whole numbers as 16 bits (wrapping): all low bytes, then all high ones."""
    low = F.transform(values, lambda v: F.lpad(F.hex(v.bitwiseAND(255)), 2, "0"))
    high = F.transform(values, lambda v: F.lpad(F.hex(F.shiftright(v, 8).bitwiseAND(255)), 2, "0"))
    return F.unhex(F.array_join(F.concat(low, high), ""))


def id_share(number: Column, modulus: int = 1000) -> Column:
    """A fixed pseudorandom share, 0 to 1, of an id; the product never leaves 64 bits."""
    return F.pmod(F.pmod(number, F.lit(modulus)) * (2_654_435_761 % modulus), F.lit(modulus)) / modulus


def profile(text: Column) -> Column:
    """Parts `name` or `name:number`, split by commas -> array of (name, value)."""
    return F.transform(F.filter(F.split(text, ","), lambda p: F.trim(p) != ""), lambda p: F.struct(F.trim(F.split(p, ":")[0]).alias("name"), F.try_element_at(F.split(p, ":"), F.lit(2)).try_cast("double").alias("value")))


def decided(default: Column | str | None, rules: list[tuple[Column, Column | str]]) -> Column:
    """Masks in turn, each over what the ones before gave: the last that holds wins."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for condition, value in rules:
        out = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(out)
    return out


#: What a part of a massing cell begins with if it is a directive.
DIRECTIVES = ["crown@", "tops@", "lid@", "h@", "wing@", "base@", "fill@", "slot@", "shape@", "roofs@"]


def directives(text: Column) -> tuple[Column, Column]:
    """(profile, directives) of a cell whose parts are separated by semicolons; the last part that is no directive is the profile."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    starts = "^(" + "|".join(DIRECTIVES) + ")"
    plain = F.filter(parts, lambda p: ~p.rlike(starts))
    return F.when(F.size(plain) > 0, F.element_at(plain, -1)), F.filter(parts, lambda p: p.rlike(starts))


def knots(text: Column) -> Column:
    """A massing profile as knots: at a share of the height, the outline's scale along and across its long axis, how far it moves in (m), its turn
    (degrees), and the bearing that a lean is along. Words are height:scale; dome:f, shell:f:m and anti:f are upright to f, then a quarter ellipse
    of scale, one of inset, or a square antiprism; long: has a scale for either axis; lean:bearing: scales along that bearing. Null for none."""
    t = F.trim(text)
    kind, rest = F.split(t, ":", 2)[0], F.element_at(F.split(t, ":", 2), 2)
    number = lambda c: c.cast("double")
    knot = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).cast("double").alias(n) for n, x in zip(("height", "along", "across", "inset", "turn", "bearing"), v, strict=True)])
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    part = lambda w, k: number(F.split(w, ":")[k])
    first = part(rest, 0)
    foot = F.array(knot(0, 1, 1, 0, 0, None))
    eighths = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k * math.pi / 16)
    rise = lambda a: first + (1 - first) * F.sin(a)
    round_ = lambda a: F.greatest(F.cos(a), F.lit(0.08))
    dome = F.concat(foot, F.transform(eighths, lambda a: knot(rise(a), round_(a), round_(a), 0, 0, None)))
    shell = F.concat(foot, F.transform(eighths, lambda a: knot(rise(a), 1, 1, part(rest, 1) * (1 - F.cos(a)), 0, None)))
    anti = F.concat(foot, F.array(knot(first, 1, 1, 0, 0, None), knot(1, math.sqrt(0.5), math.sqrt(0.5), 0, 45, None)))
    long = F.transform(words(rest), lambda w: knot(part(w, 0), part(w, 1), part(w, 2), 0, 0, None))
    lean = F.transform(words(F.element_at(F.split(rest, ":", 2), 2)), lambda w: knot(part(w, 0), part(w, 1), 1, 0, 0, first))
    plain = F.transform(words(t), lambda w: knot(part(w, 0), part(w, 1), part(w, 1), 0, 0, None))
    return F.when(t == "", None).when(kind == "dome", dome).when(kind == "shell", shell).when(kind == "anti", anti).when(kind == "long", long).when(kind == "lean", lean).otherwise(plain)
