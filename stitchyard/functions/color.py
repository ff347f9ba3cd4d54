"""Colour functions as column expressions: hex, CMYK, Lab, CIE76 and CIEDE2000."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(hex_color: Column, i: int) -> Column:
    """0-based channel of ``#rrggbb``."""
    return F.conv(F.substring(hex_color, 2 + 2 * i, 2), 16, 10).cast("int")


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *[F.lpad(F.hex(c), 2, "0") for c in (r, g, b)]))


def cmyk(r: Column, g: Column, b: Column) -> list[Column]:
    """Percentages; black from 0.999 on is 0, 0, 0, 100."""
    k = 1 - F.greatest(r, g, b) / 255.0
    part = lambda c: F.when(k >= 0.999, F.lit(0.0)).otherwise(F.floor((1 - c / 255.0 - k) / (1 - k) * 100 + 0.5).cast("double"))
    return [part(r), part(g), part(b), F.when(k >= 0.999, F.lit(100.0)).otherwise(F.floor(k * 100 + 0.5).cast("double"))]


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB to CIE Lab under D65."""
    lin = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    xyz = [(lin[0] * a + lin[1] * m + lin[2] * z) / w for a, m, z, w in ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))]
    f = [F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116) for t in xyz]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def de76_squared(p: tuple, q: tuple) -> Column:
    return sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:], strict=True)), (p[0] - q[0]) * (p[0] - q[0]))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def de2000(p: tuple, q: tuple) -> Column:
    """CIEDE2000 with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    deg = math.pi / 180
    cbar = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2
    g = 0.5 * (1 - F.sqrt(F.pow(cbar, F.lit(7.0)) / (F.pow(cbar, F.lit(7.0)) + 25.0**7)))
    x1, x2 = (1 + g) * a1, (1 + g) * a2
    c1, c2 = F.sqrt(x1 * x1 + b1 * b1), F.sqrt(x2 * x2 + b2 * b2)
    turn = lambda b, a: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.when(F.atan2(b, a) < 0, F.degrees(F.atan2(b, a)) + 360).otherwise(F.degrees(F.atan2(b, a))))
    h1, h2 = turn(b1, x1), turn(b2, x2)
    grey = (c1 * c2) == 0
    dh = F.when(grey, F.lit(0.0)).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
    big = 2 * F.sqrt(c1 * c2) * F.sin(dh / 2 * deg)
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    hm = F.when(grey, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
    t = 1 - 0.17 * F.cos((hm - 30) * deg) + 0.24 * F.cos(2 * hm * deg) + 0.32 * F.cos((3 * hm + 6) * deg) - 0.20 * F.cos((4 * hm - 63) * deg)
    sl = 1 + 0.015 * (lm - 50) * (lm - 50) / F.sqrt(20 + (lm - 50) * (lm - 50))
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    rt = -F.sin(60 * F.exp(-((hm - 275) / 25) * ((hm - 275) / 25)) * deg) * 2 * F.sqrt(F.pow(cm, F.lit(7.0)) / (F.pow(cm, F.lit(7.0)) + 25.0**7))
    dl, dc, dhh = (l2 - l1) / sl, (c2 - c1) / sc, big / sh
    return F.sqrt(F.pow(dl, F.lit(2.0)) + F.pow(dc, F.lit(2.0)) + F.pow(dhh, F.lit(2.0)) + rt * dc * dhh)
