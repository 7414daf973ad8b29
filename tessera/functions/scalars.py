"""Column expressions: bit flags, scalings, masks, indices, calendar phases, identifiers and names.

All are built-in functions, so they stay inside whole-stage code generation. Missing is NULL; NaN and infinities count as missing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default flag bits, scale factors and bounds of the pixel products.
CLEAR_LAND_BITS = (0, 1, 2, 3, 4, 5, 7)
TEMPERATURE_SCALE, TEMPERATURE_OFFSET = 0.00341802, 149.0 - 273.15
PLAUSIBLE_CELSIUS = (-30.0, 80.0)


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def bits_clear(flags: Column, bits: tuple[int, ...] = CLEAR_LAND_BITS) -> Column:
    """True where none of the listed bits is set."""
    return flags.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0


def bit_set(flags: Column, bit: int) -> Column:
    return F.shiftright(flags, bit).bitwiseAND(F.lit(1)) == 1


def linear(c: Column, scale: float = TEMPERATURE_SCALE, offset: float = TEMPERATURE_OFFSET) -> Column:
    return c.cast("double") * scale + offset


def plausible(c: Column, low: float = PLAUSIBLE_CELSIUS[0], high: float = PLAUSIBLE_CELSIUS[1]) -> Column:
    return F.coalesce(finite(c) & c.between(low, high), F.lit(False))


def in_classes(c: Column, nodata: int, excluded: tuple[int, ...]) -> Column:
    """A class that is neither nodata nor one of the excluded (water) classes."""
    return F.coalesce((c != nodata) & ~c.isin(*excluded), F.lit(False))


def decode_counts(dn: Column, offset: Column, quantification: Column, nodata: int = 0, saturated: int = 65535) -> Column:
    """(dn + offset) / quantification; null at nodata and saturation, negatives kept."""
    return F.when(~dn.isin(nodata, saturated), (dn + offset) / quantification)


def scaled_counts(dn: Column, scale: Column, offset: Column, nodata: int = 0, saturated: int = 65535) -> Column:
    return F.when(~dn.isin(nodata, saturated), dn * scale + offset)


def clear_surface(scene_class: Column, bands: list[Column], accepted: tuple[int, ...] = (4, 5)) -> Column:
    return reduce(lambda a, b: a & finite(b), bands, F.coalesce(scene_class.isin(*accepted), F.lit(False)))


def ratio(numerator: Column, denominator: Column, epsilon: float = 1e-6) -> Column:
    """Null where the denominator is smaller than epsilon or a side is not finite."""
    return F.when(finite(numerator) & finite(denominator) & (F.abs(denominator) >= epsilon), numerator / denominator)


def optical_indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column, weights: dict[str, float], epsilon: float = 1e-6) -> dict[str, Column]:
    """Vegetation, enhanced vegetation, water and built-up index, and the weighted albedo (weights by band name, summing to 1)."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("the albedo weights must sum to 1")
    band = {"blue": blue, "green": green, "red": red, "nir": nir, "swir1": swir1, "swir2": swir2}
    return {
        "ndvi": ratio(nir - red, nir + red, epsilon),
        "evi": ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0, epsilon),
        "ndwi": ratio(green - nir, green + nir, epsilon),
        "ndbi": ratio(swir1 - nir, swir1 + nir, epsilon),
        "albedo": reduce(lambda a, b: a + b, [band[k] * w for k, w in weights.items()]),
    }


def season_phase(day: Column) -> tuple[Column, Column, Column]:
    """Sine and cosine of the date's place in its year, and the year's length."""
    length = F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    angle = (F.dayofyear(day) - 1) * (2 * math.pi) / length
    return F.sin(angle), F.cos(angle), length


def is_civil_midnight(ts: Column) -> Column:
    return F.coalesce(F.date_trunc("day", ts) == ts, F.lit(False))


def is_canonical(text: Column) -> Column:
    """A string that is not null, not empty and has no blanks around it."""
    return F.coalesce((text == F.trim(text)) & (F.length(text) > 0), F.lit(False))


def local_date(ts: Column, zone: str) -> Column:
    """Civil date of a UTC instant in a zone, summer time included."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def utc_bounds(first: Column, last: Column, zone: str) -> tuple[Column, Column]:
    """The UTC instants at which a range of local dates begins and ends (the end exclusive)."""
    return F.to_utc_timestamp(first.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(last, 1).cast("timestamp"), zone)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case; query and fragment dropped."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return F.concat(scheme, F.lit("://"), host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1))


def strip_suffix(text: Column, suffix: str) -> Column:
    """Upper case, trimmed, without a suffix given as a pattern."""
    return F.regexp_replace(F.upper(F.trim(text)), f"(?:{suffix})$", "")


def version_key(text: Column) -> Column:
    """`NN.NN` as a struct of two integers, which orders as numbers do; null for another form."""
    form = r"^(\d\d)\.(\d\d)$"
    return F.when(text.rlike(form), F.struct(F.regexp_extract(text, form, 1).cast("int").alias("major"), F.regexp_extract(text, form, 2).cast("int").alias("minor")))


def alias(text: Column, names: dict[str, str]) -> Column:
    """The canonical name of an alias, compared trimmed and in lower case; null for an unknown one."""
    key = F.lower(F.trim(text))
    first, *rest = sorted(names.items())
    return reduce(lambda c, kv: c.when(key == kv[0], kv[1]), rest, F.when(key == first[0], first[1]))


def zero_pad(text: Column, width: int) -> Column:
    """Trimmed and filled with zeros on the left; null where it is longer than width or not digits."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike(rf"^\d{{1,{width}}}$"), F.lpad(t, width, "0"))


def display_name(kind: Column, number: Column) -> Column:
    return F.when(F.length(F.trim(number)) > 0, F.concat_ws(" ", F.trim(kind), F.trim(number)))


def degree_tile(south: Column, west: Column) -> Column:
    """`N33W119` from the south-west corner in whole degrees."""
    return F.format_string("%s%02d%s%03d", F.when(south >= 0, "N").otherwise("S"), F.abs(south).cast("int"), F.when(west >= 0, "E").otherwise("W"), F.abs(west).cast("int"))


def component_root(text: Column) -> Column:
    """The number before a component suffix: `12-E` is `12`."""
    return F.nullif(F.regexp_extract(text, r"^(\d+)(?:-[A-Z])?$", 1), F.lit(""))


def block_id(x: Column, y: Column, size: float) -> Column:
    return F.format_string("x%+05d_y%+05d", F.floor(x / size).cast("int"), F.floor(y / size).cast("int"))


def parse_block(text: Column) -> tuple[Column, Column]:
    """x and y of a block id; null unless the id is written canonically."""
    form = r"^x([+-]\d{4,})_y([+-]\d{4,})$"
    x, y = F.regexp_extract(text, form, 1).try_cast("int"), F.regexp_extract(text, form, 2).try_cast("int")
    same = F.format_string("x%+05d_y%+05d", x, y) == text
    return F.when(same, x), F.when(same, y)


def interval_label(c: Column, breaks: list[float], decimals: int = 1) -> Column:
    """`[a, b)` of the left-closed bin a value falls into; the last bin is open above; null below the first break."""
    out = None
    for low, high in zip(breaks, [*breaks[1:], math.inf], strict=True):
        name = f"[{low:.{decimals}f}, {'inf' if high == math.inf else f'{high:.{decimals}f}'})"
        test = (c >= low) if high == math.inf else (c >= low) & (c < high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def has_token(name: Column, tokens: list[str]) -> Column:
    """A name in which a forbidden token stands between underscores or ends."""
    return F.lower(name).rlike(rf"(^|_)({'|'.join(tokens)})(_|$)")


def utm_epsg(tile: Column) -> Column:
    """EPSG code of a grid tile such as `11SLT`: its zone, and the hemisphere from its latitude band."""
    zone = F.regexp_extract(tile, r"^(\d{1,2})[C-X]", 1).try_cast("int")
    band = F.regexp_extract(tile, r"^\d{1,2}([C-X])", 1)
    return F.when(zone.between(1, 60), F.when(band >= "N", 32600 + zone).otherwise(32700 + zone))
