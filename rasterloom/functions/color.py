"""Per-pixel color expressions; all arguments and results are Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit gray value."""
    return F.floor((r * 299 + g * 587 + b * 114 + 500) / 1000).cast("int")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def saturation(r: Column, g: Column, b: Column) -> Column:
    """8-bit saturation of HSV."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top == 0, 0).otherwise(F.floor((top - low) * 255 / top + 0.5)).cast("int")


def hue_degrees(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = (top - low).cast("double")
    h = F.when(top == r, (g - b) / d * 60).when(top == g, (b - r) / d * 60 + 120).otherwise((r - g) / d * 60 + 240)
    return F.when(top == low, F.lit(0.0)).otherwise(F.when(h < 0, h + 360).otherwise(h))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", *[F.least(F.lit(255), F.greatest(F.lit(0), F.bround(c))).cast("int") for c in (r, g, b)])


def is_hex_color(value: Column) -> Column:
    return F.coalesce(value.rlike("^#[0-9A-Fa-f]{6}$"), F.lit(False))


def normal_hex(value: Column, default: str = "#808080") -> Column:
    text = F.trim(F.coalesce(value, F.lit("")))
    text = F.when(text.startswith("#"), text).otherwise(F.concat(F.lit("#"), text))
    return F.when(is_hex_color(text), F.upper(text)).otherwise(F.lit(default))


def color_name(r: Column, g: Column, b: Column) -> Column:
    """A plain name: by lightness for nearly gray colors, by a clearly leading channel for others."""
    light = luminance(r, g, b)
    gray = F.when(light > 225, "white").when(light < 45, "black").otherwise("gray")
    lead = F.when(r - F.greatest(g, b) > 45, "red").when(g - F.greatest(r, b) > 45, "green").when(b - F.greatest(r, g) > 45, "blue").otherwise("custom color")
    return F.when(F.greatest(r, g, b) - F.least(r, g, b) < 24, gray).otherwise(lead)


def packed_color(r: Column, g: Column, b: Column) -> Column:
    """Two bits a channel in one number from 0 to 63."""
    return (F.floor(r / 64) * 16 + F.floor(g / 64) * 4 + F.floor(b / 64)).cast("int")


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIE L*a*b* of sRGB under D65."""

    def linear(c: Column) -> Column:
        v = c / 255.0
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def root(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(t * 7.787 + 16.0 / 116.0)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x = root((lr * 0.412453 + lg * 0.357580 + lb * 0.180423) / 0.950456)
    y = root(lr * 0.212671 + lg * 0.715160 + lb * 0.072169)
    z = root((lr * 0.019334 + lg * 0.119193 + lb * 0.950227) / 1.088754)
    return {"l": y * 116 - 16, "a": (x - y) * 500, "b": (y - z) * 200}


def visible(a: Column, threshold: int = 20) -> Column:
    return a > threshold


def dark_detail(gray: Column, seen: Column, threshold: int = 128) -> Column:
    return (gray < threshold) & seen


def saturated(r: Column, g: Column, b: Column, least_s: int = 35, least_v: int = 45) -> Column:
    return (saturation(r, g, b) > least_s) & (F.greatest(r, g, b) > least_v)


def first_of(*choices: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(choices), otherwise)
