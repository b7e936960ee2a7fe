"""Colour text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_col

# Kelly's published palette of maximum contrast, in its published order.
KELLY_PALETTE = [
    "#F3C300", "#875692", "#F38400", "#A1CAF1", "#BE0032", "#C2B280", "#008856", "#E68FAC", "#0067A5",
    "#F99379", "#604E97", "#F6A600", "#B3446C", "#DCD300", "#882D17", "#8DB600", "#654522", "#E25822",
    "#2B3D26", "#F2F3F4", "#222222",
]
MISSING_COLOR = "#C0C0C0"
PINNED_MISSING_COLOR = "#DDDDDD"


def hex_to_rgba(color: Column | str, alpha: float = 0.8) -> Column:
    """``#RRGGBB`` -> ``rgba(r, g, b, alpha)``; other text passes through."""
    color = as_col(color)
    channel = [F.conv(F.substring(color, p, 2), 16, 10) for p in (2, 4, 6)]
    text = F.concat(F.lit("rgba("), F.concat_ws(", ", *channel, F.lit(str(alpha))), F.lit(")"))
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}"), text).otherwise(color)


def rgba_to_hex(color: Column | str) -> Column:
    color = as_col(color)
    pattern = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    channel = [
        F.lpad(F.hex(F.regexp_extract(color, pattern, g).try_cast("int")), 2, "0") for g in (1, 2, 3)
    ]
    return F.when(color.rlike(pattern), F.concat(F.lit("#"), *channel)).otherwise(color)


def default_color(index: Column | str, total: Column | str) -> Column:
    """Evenly spaced hues at saturation and value 0.8."""
    hue = as_col(index).cast("double") / as_col(total).cast("double") * F.lit(6.0)
    sextant = F.floor(hue)
    part = hue - sextant
    v = F.lit(0.8)
    p = v * F.lit(1.0 - 0.8)
    q = v * (F.lit(1.0) - F.lit(0.8) * part)
    t = v * (F.lit(1.0) - F.lit(0.8) * (F.lit(1.0) - part))
    wheel = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]

    def channel(c: int) -> Column:
        out = F.lit(None).cast("double")
        for s, trio in enumerate(wheel):
            out = F.when(sextant % 6 == s, trio[c]).otherwise(out)
        return F.floor(out * 255).cast("string")

    return F.concat(F.lit("rgba("), F.concat_ws(", ", channel(0), channel(1), channel(2), F.lit("0.8")), F.lit(")"))
