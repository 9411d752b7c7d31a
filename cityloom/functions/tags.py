"""Values from free-form map tags: heights, lengths, widths, levels, lanes, speeds. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT, INCH = 0.3048, 0.0254
# What the road classes are made of.
RAIL = ["rail", "light_rail", "subway", "narrow_gauge", "monorail", "tram"]
MAJOR = ["motorway", "trunk", "primary", "secondary"]
MINOR = ["tertiary", "residential", "unclassified", "living_street", "road"]
SERVICE = ["service", "pedestrian"]
SKIP_SERVICE = ["parking_aisle", "driveway", "drive-through"]
BIG = ["trunk", "primary"]


def first_number(text: Column) -> Column:
    """The first of a list's values as a number, a comma being a decimal point; null if it is none."""
    first = F.split(F.trim(F.element_at(F.split(F.regexp_replace(text, ",", "."), ";"), 1)), r"\s+")[0]
    return first.try_cast("double")


def _measure(part: Column, loose: bool) -> Column:
    """Metres of one value: feet and inches, else (loose) the number that it begins with."""
    t = F.lower(F.trim(part))
    feet = r"^([0-9.]+)\s*(?:'|ft|feet)\s*(?:([0-9.]+)\s*(?:\"|in))?$"
    whole = F.regexp_extract(t, feet, 1).try_cast("double") * FOOT
    inches = F.coalesce(F.regexp_extract(t, feet, 2).try_cast("double") * INCH, F.lit(0.0))
    plain = F.regexp_extract(t, r"^([0-9.]+)", 1).try_cast("double") if loose else first_number(t)
    return F.when(t.rlike(feet), whole + inches).otherwise(plain)


def height_m(text: Column) -> Column:
    """Metres of a height tag: of several values the largest, feet and inches converted; null if none can be read."""
    return F.array_max(F.transform(F.split(F.regexp_replace(text, ",", "."), ";"), lambda p: _measure(p, True)))


def length_m(text: Column) -> Column:
    """Metres of a length tag, its first value only."""
    return _measure(text, False)


def below_ground(level: Column) -> Column:
    """Whether all of a level tag's values are under 0. What can't be read is not."""
    parts = F.filter(F.split(level, ";"), lambda p: F.trim(p) != "")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    return F.coalesce((F.size(parts) > 0) & F.forall(numbers, lambda v: F.coalesce(v < 0, F.lit(False))), F.lit(False))


def underground(location: Column, layer: Column, level: Column, flag: Column) -> Column:
    """Whether any tag puts an outline under the ground; missing tags don't."""
    marked = F.lower(flag).isin("yes", "true", "1") | location.isin("underground", "indoor")
    return F.coalesce(marked, F.lit(False)) | F.coalesce(location == "underground", F.lit(False)) | (F.coalesce(layer.try_cast("double"), F.lit(0.0)) < 0) | below_ground(level)


def base_class(highway: Column) -> Column:
    return F.regexp_replace(highway, "_link$", "")


def road_class(railway: Column, highway: Column, service: Column, footbridge: Column) -> Column:
    """rail, service, major, minor or null: the first that holds."""
    base = base_class(F.coalesce(highway, F.lit("")))
    return (
        F.when(railway.isin(RAIL), "rail").when(footbridge == "yes", "service").when(base.isin(MAJOR), "major").when(base.isin(MINOR), "minor")
        .when(highway.isin(SERVICE) & ~F.coalesce(service.isin(SKIP_SERVICE), F.lit(False)), "service")
    )


def road_width(width: Column, kind: Column, highway: Column, lanes: Column, tracks: Column, oneway: Column, *, lane: float = 3.25, default: dict, footbridge: Column | None = None, foot: float = 4.0, parked: Column | float = 0.0) -> Column:
    """A way's width: its tag if plausible, else by tracks, lanes (and `parked`, the width of its parking lanes) or the class's default (two-way, one-way)."""
    tagged, n = length_m(width), first_number(lanes)
    two = F.create_map(*[x for k, v in default.items() for x in (F.lit(k), F.lit(float(v[0])))])
    one = F.create_map(*[x for k, v in default.items() for x in (F.lit(k), F.lit(float(v[1])))])
    cls = F.when(highway.endswith("_link"), "link").otherwise(highway)
    wide = F.when(F.coalesce(oneway.isin("yes", "1", "-1"), F.lit(False)), one[cls]).otherwise(two[cls])
    on_foot = F.coalesce(footbridge == "yes", F.lit(False)) if footbridge is not None else F.lit(False)
    return (
        F.when(tagged.between(2, 60), tagged).when(on_foot, foot)
        .when(kind == "rail", 3.2 * F.greatest(F.lit(1), F.floor(F.coalesce(first_number(tracks), F.lit(1.0)))))
        .when(n.between(1, 12), n * lane + F.when(highway.isin("motorway", "trunk"), 2).otherwise(0) + parked)
        .otherwise(wide)
    )


def lane_code(lanes: Column, width: Column, oneway: Column, highway: Column, parked: Column | float = 0.0) -> Column:
    """Lanes a direction (all of a one-way road's), plus 16 one-way, 32 big road, 64 motorway; 0 lanes on narrow two-way roads. Untagged lanes are
    what fits between the parking lanes, which are `parked` wide."""
    n, base = first_number(lanes), base_class(highway)
    moving = F.greatest(width - parked, F.lit(3.0)) / 3.5
    fitted = F.bround(moving).cast("int")
    single = F.when(n.between(1, 15), F.floor(n).cast("int")).otherwise(F.greatest(F.lit(1), fitted))
    both = F.when(n.between(2, 15), F.floor(n).cast("int")).when(width >= 6, F.greatest(F.lit(2), fitted)).otherwise(0)
    count = F.least(F.when(oneway, single).otherwise(F.floor(both / 2).cast("int")), F.lit(15))
    flags = F.when(oneway, 16).otherwise(0) + F.when(base.isin(BIG) | (base == "motorway"), 32).otherwise(0) + F.when(base == "motorway", 64).otherwise(0)
    return count.bitwiseOR(flags)


def parking_width(tags: Column, highway: Column, lanes: dict[str, int], each: float = 2.4) -> Column:
    """Metres that a road class's parking lanes take; none where a tag forbids parking on both sides."""
    forbidden = [F.coalesce(tags[k].isin("no", "no_parking", "no_stopping"), F.lit(False)) for k in ("parking:both", "parking:lane:both")]
    return F.when(forbidden[0] | forbidden[1], 0.0).otherwise(looked_up(highway, lanes, 0) * each)


def looked_up(key: Column, values: dict, default=None) -> Column:
    """values[key], as a double."""
    chain = F.lit(None if default is None else float(default)).cast("double")
    for k, v in values.items():
        chain = F.when(key == k, float(v)).otherwise(chain)
    return chain


def sidewalks(tag: Column, highway: Column, oneway: Column, elevated: Column, widths: dict, medians: dict, right_hand: bool = True) -> Column:
    """(left, right, median) metres. Decks and ramps have none; a one-way road of a class with a median has that on its inner side, in place of the
    walk, unless the tag tells of a walk there."""
    bare = elevated | highway.endswith("_link")
    told = F.coalesce(tag, F.lit(""))
    inner, outer = ("left", "right") if right_hand else ("right", "left")
    strip = looked_up(highway, medians)
    divided = ~bare & oneway & strip.isNotNull() & ~told.isin(inner, "both")
    walk = F.when(bare | told.isin("no", "none"), 0.0).otherwise(looked_up(highway, widths, 0))
    side = {s: F.when(told == other, 0.0).otherwise(walk) for s, other in (("left", "right"), ("right", "left"))}
    side[inner] = F.when(divided, 0.0).otherwise(side[inner])
    return F.struct(side["left"].alias("left"), side["right"].alias("right"), F.when(divided, strip).otherwise(0.0).alias("median"))


def bus_sides(tags: Column, oneway: Column, right_hand: bool = True) -> Column:
    """(left, right): which kerbs have a bus lane, as seen in the way's direction. Lanes of a direction lie along that direction's near kerb."""
    kerb = lambda k: F.coalesce(tags[k].isin("lane", "opposite_lane"), F.lit(False))
    some = lambda *keys: F.greatest(*[F.coalesce(first_number(tags[k]), F.lit(0.0)) for k in keys]) >= 1
    reserved = lambda k: F.transform(F.split(tags[k], r"\|"), lambda x: x.isin("designated", "yes"))
    held = lambda k: F.coalesce(F.exists(reserved(k), lambda x: x), F.lit(False))
    end = lambda k, at: F.coalesce(F.element_at(reserved(k), at), F.lit(False))
    plain = kerb("busway") | kerb("busway:both") | some("lanes:bus", "lanes:psv")
    ahead = some("lanes:bus:forward", "lanes:psv:forward") | held("bus:lanes:forward") | held("psv:lanes:forward") | plain
    back = some("lanes:bus:backward", "lanes:psv:backward") | held("bus:lanes:backward") | held("psv:lanes:backward") | (plain & ~oneway)
    left, right = (back, ahead) if right_hand else (ahead, back)
    left = left | kerb("busway:left") | end("bus:lanes", 1) | end("psv:lanes", 1)
    right = right | kerb("busway:right") | end("bus:lanes", -1) | end("psv:lanes", -1)
    return F.struct(left.alias("left"), right.alias("right"))


def cycle_lane(tags: Column) -> Column:
    """Whether a cycle lane is marked on the road, on whichever side."""
    keys = ("cycleway", "cycleway:both", "cycleway:left", "cycleway:right")
    return F.exists(F.array(*[tags[k] for k in keys]), lambda v: F.coalesce(v.isin("lane", "opposite_lane"), F.lit(False)))


def kerb_lines(tags: Column, highway: Column, mouth: Column, red_refs: list[str], lines: dict[str, str], mouths: dict[str, str]) -> Column:
    """0 none, 1 double yellow, 2 double red: roads with a red reference, then by class, at junction mouths by their own list; a ban on
    stopping marks the other mouths yellow where mouths are marked at all."""
    codes = {"yellow": 1, "red": 2}
    base = base_class(highway)
    refs = F.transform(F.split(F.coalesce(tags["ref"], F.lit("")), ";"), lambda r: F.trim(r))
    red = F.arrays_overlap(refs, F.array(*map(F.lit, red_refs))) if red_refs else F.lit(False)
    by_class = looked_up(base, {k: codes[v] for k, v in lines.items()})
    at_mouth = F.when(mouth, looked_up(base, {k: codes[v] for k, v in mouths.items()}))
    banned = F.coalesce(tags["parking:both"] == "no_stopping", F.lit(False)) | F.coalesce(tags["parking:lane:both"] == "no_stopping", F.lit(False))
    ban = F.when(banned & mouth & F.lit(bool(mouths)), 1.0)
    return F.when(red, 2).otherwise(F.coalesce(by_class, at_mouth, ban, F.lit(0.0))).cast("int")


def deck_heights(key: Column, lower: Column, railway: Column, decks: dict, drop: float) -> tuple[Column, Column]:
    """(deck, over water) of a named span: a height, lower levels `drop` under it; or a record of deck, lower, rail_lower (tracks are on the lower
    level), water (its height over the water)."""
    deck = water = F.lit(None).cast("double")
    on_rails = F.coalesce(railway.isin("subway", "rail", "light_rail"), F.lit(False))
    for name, told in decks.items():
        if isinstance(told, dict):
            under = lower | (on_rails if told.get("rail_lower") else F.lit(False))
            here = F.when(under, F.lit(told.get("lower")).cast("double")).otherwise(float(told["deck"]))
            water = F.when(key == name, F.lit(told.get("water")).cast("double")).otherwise(water)
        else:
            here = F.lit(float(told)) - F.when(lower, drop).otherwise(0.0)
        deck = F.when(key == name, here).otherwise(deck)
    return deck, water


def seen_height(seen: Column, storeys_height: Column, factor: float = 1.5) -> Column:
    """A measured height, unless storeys tell of a building much taller: built since it was measured."""
    return F.when(storeys_height > factor * seen, None).otherwise(seen)


def max_speed(text: Column) -> Column:
    """km/h; mph converted."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.endswith("mph"), F.trim(F.regexp_replace(t, "mph$", "")).try_cast("double") * 1.609).otherwise(t.try_cast("double"))


def parking(tags: Column, side: str) -> Column:
    """Whether cars park along a side: true, false or null (not told). The first of the schemes' keys decides; a ban overrides."""
    told = F.coalesce(*[tags[k] for k in (f"parking:{side}", "parking:both", f"parking:lane:{side}", "parking:lane:both")])
    ban = F.coalesce(tags[f"parking:{side}:restriction"], tags["parking:both:restriction"]).isin("no_parking", "no_stopping", "no_standing")
    value = F.when(ban & F.coalesce(told.isin("yes", "lane", "street_side"), F.lit(True)), "no").otherwise(told)
    return F.when(value.isin("yes", "lane", "street_side", "on_kerb", "half_on_kerb", "parallel", "diagonal", "perpendicular"), True).when(value.isin("no", "separate", "no_parking", "no_stopping", "fire_lane"), False)


def span_of(names: list[Column], keys: list[str]) -> tuple[Column, Column]:
    """(key, lower): the first key that a name holds, whatever the case, names in order; and whether that name says lower."""
    key = lower = F.lit(None)
    for name in reversed(names):
        text = F.lower(F.coalesce(name, F.lit("")))
        found = F.coalesce(*[F.when(F.contains(text, F.lit(k.lower())), k) for k in keys])
        key, lower = F.when(found.isNotNull(), found).otherwise(key), F.when(found.isNotNull(), F.contains(text, F.lit("lower"))).otherwise(lower)
    return key, F.coalesce(lower, F.lit(False))


def plain_name(text: Column) -> Column:
    """Lower case, without a closing parenthesis."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s*\([^)]*\)\s*$", "")))


def year_of(*texts: Column, low: int = 1000, high: int = 2100) -> Column:
    """The first plausible year: four digits of the sources in order of trust."""
    years = [F.regexp_extract(t, r"([0-9]{4})", 1).try_cast("int") for t in texts]
    return F.coalesce(*[F.when(y.between(low, high), y) for y in years])
