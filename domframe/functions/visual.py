"""Geometry, colours and style attributes of rendered nodes as Column expressions."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import font_family, strip_prefix


def safe_log(c: Column) -> Column:
    return F.when(c > 0, F.ln(c)).otherwise(0.0)


def center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + w).alias("x"), y.alias("y")), F.struct(x.alias("x"), (y + h).alias("y")), F.struct((x + w).alias("x"), (y + h).alias("y")))


def is_positive(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Whether (right, bottom) is above (0, 0) in lexicographic order."""
    return ((x + w) > 0) | (((x + w) == 0) & ((y + h) > 0))


def position(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.array(x / width, y / height, safe_log(w / width), safe_log(h / height))


def hex_byte(c: Column, at: int) -> Column:
    return F.conv(F.substring(c, at, 2), 16, 10).cast("int")


def color(c: Column) -> tuple[Column, Column, Column]:
    """Hue, brightness and alpha in 0..1 of #rrggbbaa."""
    r, g, b, a = (hex_byte(c, at) for at in (2, 4, 6, 8))
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif((most - least).cast("double"), F.lit(0.0))
    rc, gc, bc = (most - r) / d, (most - g) / d, (most - b) / d
    turn = F.when(r == most, bc - gc).when(g == most, 2.0 + rc - bc).otherwise(4.0 + gc - rc) / 6.0
    hue = F.coalesce(turn - F.floor(turn), F.lit(0.0))
    return hue, most / 255.0, a / 255.0


def first_word(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def image_kind(c: Column) -> Column:
    return F.when(c.startswith("url"), "url").otherwise(c)


def shadow_kind(c: Column) -> Column:
    return F.when(c.startswith("rgb"), "rgb").otherwise(c)


def z_index_kind(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), "number").otherwise(c)


def pixels(c: Column) -> Column:
    """Number of the first px value; none or nothing is 0."""
    return F.coalesce(F.regexp_extract(c, r"^(-?[0-9.]+)px", 1).try_cast("double"), F.lit(0.0))


def border_widths(attrs: Column, name: str = "border", strict: bool = False) -> Column:
    """Top, right, bottom, left width: the shorthand for all sides, else each side's own key (any case unless strict)."""
    sides = []
    for side in ("top", "right", "bottom", "left"):
        own = attrs[name + side.capitalize()]
        sides.append(pixels(attrs[side] if strict else F.coalesce(own, attrs[side])))
    return F.when(attrs[name].isNotNull(), F.array_repeat(pixels(attrs[name]), 4)).otherwise(F.array(*sides))


def truncated_pixels(c: Column) -> Column:
    """Whole pixels of a computed style, cut off toward zero."""
    return pixels(c).cast("int")


def css_color(c: Column) -> Column:
    """#rrggbbaa of rgb() and rgba()."""
    pattern = r"^rgba?\((\d+), *(\d+), *(\d+)(?:, *([0-9.]+))?\)$"
    parts = [F.lpad(F.lower(F.hex(F.regexp_extract(c, pattern, k).try_cast("bigint"))), 2, "0") for k in (1, 2, 3)]
    alpha = F.coalesce(F.regexp_extract(c, pattern, 4).try_cast("double"), F.lit(1.0))
    return F.concat(F.lit("#"), *parts, F.lpad(F.lower(F.hex(F.round(alpha * 255).cast("bigint"))), 2, "0"))


def is_transparent(c: Column) -> Column:
    return hex_byte(c, 8) == 0


class Attribute(NamedTuple):
    """A style attribute: its key, default, kind (categorical, minmax or raw) and what is done to its text."""

    name: str
    default: str
    kind: str
    parse: object = None


#: Style attributes and their defaults (fixed values).
ATTRIBUTES = (
    Attribute("fontFamily", '"Times New Roman"', "categorical", font_family),
    Attribute("fontSize", "16", "minmax"),
    Attribute("fontWeight", "400", "minmax", lambda c: (c.try_cast("double") / 100).cast("string")),
    Attribute("fontStyle", "normal", "categorical"),
    Attribute("textDecoration", "none", "categorical", first_word),
    Attribute("textAlign", "start", "categorical", strip_prefix),
    Attribute("color", "#000000ff", "raw"),
    Attribute("backgroundColor", "#00000000", "raw"),
    Attribute("backgroundImage", "none", "categorical", image_kind),
    Attribute("border", "none", "minmax"),
    Attribute("boxShadow", "none", "categorical", shadow_kind),
    Attribute("cursor", "auto", "categorical"),
    Attribute("letterSpacing", "0", "minmax"),
    Attribute("lineHeight", "", "minmax"),
    Attribute("opacity", "1", "raw"),
    Attribute("overflow", "auto", "categorical"),
    Attribute("outline", "none", "minmax"),
    Attribute("pointerEvents", "auto", "categorical"),
    Attribute("textShadow", "none", "categorical", shadow_kind),
    Attribute("textOverflow", "clip", "categorical"),
    Attribute("textTransform", "none", "categorical"),
    Attribute("zIndex", "auto", "categorical", z_index_kind),
)


def loaded(attrs: Column, a: Attribute) -> Column:
    """Raw text of an attribute; absent, empty and zero values give the default. Line height defaults to 1.2 font sizes."""
    own = attrs[a.name]
    size = F.coalesce(F.nullif(attrs["fontSize"].try_cast("double"), F.lit(0.0)), F.lit(16.0))
    default = (size * 1.2).cast("string") if a.name == "lineHeight" else F.lit(a.default)
    return F.when(own.isNull() | own.isin("", "0", "false", "null"), default).otherwise(own)


def parsed(attrs: Column, a: Attribute) -> Column:
    raw = loaded(attrs, a)
    return a.parse(raw) if a.parse else raw


def one_hot(id_: Column, n: int) -> Column:
    """Vector of length n for ids from 1; all zero for unseen values (0 or null)."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(F.coalesce(id_, F.lit(0)) == i, 1.0).otherwise(0.0))


def min_max(c: Column, low: Column, high: Column) -> Column:
    return F.coalesce((c - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))


def softmax(v: Column) -> Column:
    most = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - most))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def arg_max(v: Column) -> Column:
    """Index from 0 of the greatest item, the first of equals; null for an empty array."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)).cast("int") - 1)
