"""Colour spaces and differences as column arithmetic; formulas are the published sRGB, OKLab, CIELAB and CIEDE2000 ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published matrices and the D65 white point.
OKLAB_LMS = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
OKLAB_LAB = [(0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)]
SRGB_XYZ = [(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)]
WHITE = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)


def _dot(row, v):
    return row[0] * v[0] + row[1] * v[1] + row[2] * v[2]


def linear(c: Column) -> Column:
    """sRGB channel in [0, 1] to linear light."""
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def gamma(c: Column) -> Column:
    return F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, 1 / 2.4) - 0.055)


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = (linear(r), linear(g), linear(b))
    lms = [F.cbrt(_dot(m, rgb)) for m in OKLAB_LMS]
    return tuple(_dot(m, lms) for m in OKLAB_LAB)


def cielab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = (linear(r), linear(g), linear(b))
    f = []
    for row, white in zip(SRGB_XYZ, WHITE, strict=True):
        t = _dot(row, rgb) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def luma(r: Column, g: Column, b: Column) -> Column:
    return _dot(LUMA, (r, g, b))


def ciede2000(df: DataFrame, lab1: tuple[str, str, str], lab2: tuple[str, str, str], out: str) -> DataFrame:
    """df with the CIEDE2000 difference of two Lab triples of columns.

    Built in stages of columns: as one expression its shared parts would be repeated without end.
    """
    c = F.col
    l1, a1, b1, l2, a2, b2 = (c(x) for x in (*lab1, *lab2))
    hyp = lambda x, y: F.sqrt(x * x + y * y)
    angle = lambda y, x: F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))
    cos = lambda x: F.cos(F.radians(x))
    stages = [
        {"_m7": F.pow((hyp(a1, b1) + hyp(a2, b2)) / 2, 7)},
        {"_g": 1.5 - 0.5 * F.sqrt(c("_m7") / (c("_m7") + 25.0**7))},
        {"_x1": a1 * c("_g"), "_x2": a2 * c("_g")},
        {"_c1": hyp(c("_x1"), b1), "_c2": hyp(c("_x2"), b2), "_h1": angle(b1, c("_x1")), "_h2": angle(b2, c("_x2"))},
        {"_turn": c("_h2") - c("_h1"), "_sum": c("_h1") + c("_h2"), "_lm": (l1 + l2) / 2, "_cm": (c("_c1") + c("_c2")) / 2, "_grey": c("_c1") * c("_c2") == 0},
        {
            "_dh": F.when(c("_grey"), 0.0).when(c("_turn") > 180, c("_turn") - 360).when(c("_turn") < -180, c("_turn") + 360).otherwise(c("_turn")),
            "_hm": F.when(c("_grey"), c("_sum")).when(F.abs(c("_turn")) <= 180, c("_sum") / 2).when(c("_sum") < 360, (c("_sum") + 360) / 2).otherwise((c("_sum") - 360) / 2),
            "_cm7": F.pow(c("_cm"), 7),
        },
        {
            "_t": 1 - 0.17 * cos(c("_hm") - 30) + 0.24 * cos(2 * c("_hm")) + 0.32 * cos(3 * c("_hm") + 6) - 0.20 * cos(4 * c("_hm") - 63),
            "_rt": -2 * F.sqrt(c("_cm7") / (c("_cm7") + 25.0**7)) * F.sin(F.radians(60 * F.exp(-F.pow((c("_hm") - 275) / 25, 2)))),
            "_dl": (l2 - l1) / (1 + 0.015 * F.pow(c("_lm") - 50, 2) / F.sqrt(20 + F.pow(c("_lm") - 50, 2))),
            "_dc": (c("_c2") - c("_c1")) / (1 + 0.045 * c("_cm")),
        },
        {"_dhue": 2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_dh") / 2)) / (1 + 0.015 * c("_cm") * c("_t"))},
        {out: F.sqrt(c("_dl") * c("_dl") + c("_dc") * c("_dc") + c("_dhue") * c("_dhue") + c("_rt") * c("_dc") * c("_dhue"))},
    ]
    own = [x for stage in stages for x in stage if x != out]
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*own)
