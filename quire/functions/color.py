"""Color expressions; components are doubles from 0 to 1."""

from __future__ import annotations

import colorsys
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen basic names and orange.
NAMED = {
    "aqua": "00ffff", "black": "000000", "blue": "0000ff", "fuchsia": "ff00ff", "gray": "808080", "green": "008000", "lime": "00ff00", "maroon": "800000", "navy": "000080",
    "olive": "808000", "orange": "ffa500", "purple": "800080", "red": "ff0000", "silver": "c0c0c0", "teal": "008080", "white": "ffffff", "yellow": "ffff00",
}
BLEND_MODES = ("normal", "multiply", "screen", "overlay", "darken", "lighten", "color-dodge", "color-burn", "hard-light", "soft-light", "difference", "exclusion")


def _pair(hexes: Column, i: int) -> Column:
    return F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("double") / 255


def parse_color(token: Column) -> Column:
    """struct(r, g, b, alpha) of ``#rgb``, ``#rgba``, ``#rrggbb``, ``#rrggbbaa`` or a basic name; null for
    anything else. For functional notations see ``parse_css_color``."""
    t = F.lower(F.trim(token))
    names = F.create_map(*[x for k, v in NAMED.items() for x in (F.lit(k), F.lit(v))])
    short = F.regexp_replace(F.substring(t, 2, 4), "(.)", "$1$1")
    hexes = F.when(t.rlike("^#[0-9a-f]{3,4}$"), short).when(t.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), F.substring(t, 2, 8)).otherwise(F.try_element_at(names, t))
    made = lambda h: F.when(h.isNotNull(), F.struct(_pair(h, 0).alias("r"), _pair(h, 1).alias("g"), _pair(h, 2).alias("b"), F.when(F.length(h) == 8, _pair(h, 3)).otherwise(1.0).alias("alpha")))
    return F.get(F.transform(F.array(hexes), made), F.lit(0))


_NUMBER = r"\s*([+-]?[0-9]*\.?[0-9]+)(%|deg)?\s*"
_FUNCTION = re.compile(rf"(rgba?|hsla?)\({_NUMBER}[,\s]{_NUMBER}[,\s]{_NUMBER}(?:[,/]{_NUMBER})?\)")


def _functional(token: str | None) -> dict[str, float] | None:
    m = _FUNCTION.fullmatch((token or "").strip().lower())
    if not m:
        return None
    number = lambda i, full: float(m[i]) / (100 if m[i + 1] == "%" else full)
    clip = lambda v: min(max(v, 0.0), 1.0)
    alpha = clip(number(8, 1)) if m[8] else 1.0
    if m[1].startswith("rgb"):
        r, g, b = (clip(number(i, 255)) for i in (2, 4, 6))
    else:
        r, g, b = colorsys.hls_to_rgb(float(m[2]) % 360 / 360, clip(number(6, 100)), clip(number(4, 100)))
    return {"r": r, "g": g, "b": b, "alpha": alpha}


def parse_css_color(token: Column) -> Column:
    """As ``parse_color``, and ``rgb()``, ``rgba()``, ``hsl()``, ``hsla()`` by an Arrow kernel."""
    kind = pa.struct([(c, pa.float64()) for c in ("r", "g", "b", "alpha")])

    def run(tokens: pa.Array) -> pa.Array:
        return pa.array([_functional(t) for t in tokens.to_pylist()], kind)

    return F.coalesce(parse_color(token), F.arrow_udf(run, "struct<r: double, g: double, b: double, alpha: double>")(token))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    one = lambda v: F.lpad(F.lower(F.hex(F.bround(v * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), one(r), one(g), one(b))


def rgb_to_hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (high + low) / 2, high - low
    s = F.when(span == 0, 0.0).when(light <= 0.5, span / (high + low)).otherwise(span / (2 - high - low))
    hue = F.when(r == high, (g - b) / span).when(g == high, 2 + (b - r) / span).otherwise(4 + (r - g) / span)
    return F.when(span == 0, 0.0).otherwise(F.pmod(hue / 6, F.lit(1.0))), light, s


def hls_to_rgb(h: Column, light: Column, s: Column) -> tuple[Column, Column, Column]:
    top = F.when(light <= 0.5, light * (1 + s)).otherwise(light + s - light * s)
    low = 2 * light - top

    def one(x: Column) -> Column:
        x = F.pmod(x, F.lit(1.0))
        return F.when(x < 1 / 6, low + (top - low) * x * 6).when(x < 0.5, top).when(x < 2 / 3, low + (top - low) * (2 / 3 - x) * 6).otherwise(low)

    return one(h + 1 / 3), one(h), one(h - 1 / 3)


def _linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _encoded(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def tint(v: Column, share: Column) -> Column:
    """Towards white in linear light; ``share`` of the color stays."""
    return _encoded(_linear(v) * share + (1 - share))


def shade(v: Column, share: Column) -> Column:
    """Towards black in linear light."""
    return _encoded(_linear(v) * share)


def with_luminance(r: Column, g: Column, b: Column, factor: Column, offset: Column) -> tuple[Column, Column, Column]:
    """Lightness times ``factor`` plus ``offset``, within 0 to 1."""
    h, light, s = rgb_to_hls(r, g, b)
    return hls_to_rgb(h, F.least(F.greatest(light * factor + offset, F.lit(0.0)), F.lit(1.0)), s)


def scale_hex(color: Column, factor: float) -> Column:
    """Each component of ``#rrggbb`` times a factor, at most 255."""
    one = lambda i: F.lpad(F.lower(F.hex(F.least(F.floor(F.conv(F.substring(color, i, 2), 16, 10).cast("double") * factor), F.lit(255)).cast("long"))), 2, "0")
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), F.concat(F.lit("#"), one(2), one(4), one(6)))


def blend(mode: Column, below: Column, above: Column) -> Column:
    """The separable blend functions of the PDF and CSS compositing models; null for an unknown mode."""
    b, s = below, above
    multiply, screen = b * s, b + s - b * s
    hard = lambda x, y: F.when(y <= 0.5, x * 2 * y).otherwise(x + (2 * y - 1) - x * (2 * y - 1))
    d = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    soft = F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (d - b))
    dodge = F.when(b == 0, 0.0).when(s >= 1, 1.0).otherwise(F.least(F.lit(1.0), b / (1 - s)))
    burn = F.when(b >= 1, 1.0).when(s <= 0, 0.0).otherwise(1 - F.least(F.lit(1.0), (1 - b) / s))
    made = (s, multiply, screen, hard(s, b), F.least(b, s), F.greatest(b, s), dodge, burn, hard(b, s), soft, F.abs(b - s), b + s - 2 * b * s)
    out = F.lit(None).cast("double")
    for name, value in zip(BLEND_MODES, made, strict=True):
        out = F.when(mode == name, value).otherwise(out)
    return out


def over(mode: Column, below: Column, below_alpha: Column, above: Column, above_alpha: Column) -> tuple[Column, Column]:
    """(component, alpha) of source-over with a blend mode; 0 where nothing covers."""
    alpha = above_alpha + below_alpha - above_alpha * below_alpha
    mixed = (1 - below_alpha) * above + below_alpha * blend(mode, below, above)
    value = (1 - above_alpha) * below_alpha * below + above_alpha * mixed
    return F.when(alpha > 0, value / alpha).otherwise(0.0), alpha
