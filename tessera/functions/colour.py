"""Colour as column expressions: luma, sRGB and Oklab, packed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public Oklab matrices (linear sRGB to LMS, LMS' to Lab) and their inverses.
RGB_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# Integer luma weights of 256.
LUMA = (77, 150, 29)


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * LUMA[0] + g * LUMA[1] + b * LUMA[2]) / 256).cast("bigint")


def linear(v: Column) -> Column:
    """A byte of sRGB as linear light."""
    c = v / F.lit(255.0)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def companded(c: Column) -> Column:
    """Linear light as a byte of sRGB, clipped to the gamut, halves to even."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.rint(255 * F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)).cast("bigint")


def times(matrix: tuple, v: list[Column]) -> list[Column]:
    return [sum((F.lit(m) * c for m, c in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in matrix]


def oklab(r: Column, g: Column, b: Column) -> list[Column]:
    lms = times(RGB_LMS, [linear(r), linear(g), linear(b)])
    return times(LMS_LAB, [F.cbrt(c) for c in lms])


def from_oklab(rows: DataFrame, lab: tuple[str, str, str], rgb: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Adds the bytes of sRGB of three Oklab columns, step by step so that no step is computed twice."""
    others = rows.columns
    out = rows.select("*", *[c.alias(f"{n}_") for c, n in zip(times(LAB_LMS, [F.col(c) for c in lab]), "lms", strict=True)])
    out = out.select(*others, *[F.pow(F.col(f"{n}_"), 3).alias(f"{n}_") for n in "lms"])
    out = out.select(*others, *[c.alias(f"{n}_") for c, n in zip(times(LMS_RGB, [F.col(f"{n}_") for n in "lms"]), rgb, strict=True)])
    return out.select(*others, *[companded(F.col(f"{n}_")).alias(n) for n in rgb])


def key24(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("bigint")


def key15(r: Column, g: Column, b: Column) -> Column:
    return (F.floor(r / 8) * 1024 + F.floor(g / 8) * 32 + F.floor(b / 8)).cast("bigint")


def sql_linear(c: str) -> str:
    return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


def sql_oklab() -> str:
    """L, a and b of r, g and b, for DuckDB."""
    lms = [" + ".join(f"{m}::DOUBLE * {sql_linear(c)}" for m, c in zip(row, "rgb", strict=True)) for row in RGB_LMS]
    return ", ".join("(" + " + ".join(f"({m}::DOUBLE) * cbrt({c})" for m, c in zip(row, lms, strict=True)) + f") AS {n}" for row, n in zip(LMS_LAB, ("ok_l", "ok_a", "ok_b"), strict=True))


def linear_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """Linear light of an Oklab colour, in or out of the gamut."""
    return times(LMS_RGB, [c * c * c for c in times(LAB_LMS, [l, a, b])])


def gamut_factor(rows: DataFrame, lab: tuple[str, str, str], steps: int = 16) -> DataFrame:
    """Adds `fits` and `factor`, the share of the chroma that keeps a colour in sRGB, by halving `steps` times."""
    l, a, b = (F.col(c) for c in lab)  # noqa: E741
    inside = lambda k: F.forall(F.array(*linear_rgb(l, a * k, b * k)), lambda c: (c >= 0) & (c <= 1))

    def half(at: Column, _: Column) -> Column:
        mid = (at["lo"] + at["hi"]) * 0.5
        good = inside(mid)
        return F.struct(F.when(good, mid).otherwise(at["lo"]).alias("lo"), F.when(good, at["hi"]).otherwise(mid).alias("hi"))

    out = rows.withColumn("fits", inside(F.lit(1.0)))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), half)["lo"]
    return out.withColumn("factor", F.when(F.col("fits"), 1.0).otherwise(low))


def sql_linear_of(l: str, a: str, b: str) -> list[str]:  # noqa: E741
    """Linear r, g and b of an Oklab colour, for DuckDB."""
    lms = ["pow(" + " + ".join(f"{m}::DOUBLE * ({c})" for m, c in zip(row, (l, a, b), strict=True)) + ", 3)" for row in LAB_LMS]
    return ["(" + " + ".join(f"({m}::DOUBLE) * {c}" for m, c in zip(row, lms, strict=True)) + ")" for row in LMS_RGB]


def once(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, each computed once: a generator of one row, which no projection above is merged with."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_oklab(rows: DataFrame, keep: list[str], names: tuple[str, str, str] = ("l", "a", "b")) -> DataFrame:
    """The kept columns and the Oklab colour of r, g and b, step by step."""
    out = once(rows, keep, r_=linear(F.col("r")), g_=linear(F.col("g")), b_=linear(F.col("b")))
    out = once(out, keep, **{n: F.cbrt(c) for n, c in zip(("l_", "m_", "s_"), times(RGB_LMS, [F.col(f"{c}_") for c in "rgb"]), strict=True)})
    return once(out, keep, **dict(zip(names, times(LMS_LAB, [F.col(f"{c}_") for c in "lms"]), strict=True)))


#: Weights of red and blue in luma.
KR, KB = 0.2126, 0.0722


def from_yuv(y: Column, cb: Column, cr: Column) -> list[Column]:
    """Bytes of colour of limited-range planes."""
    luma, u, v = (y - 16) * 255 / F.lit(219.0), (cb - 128) * 255 / F.lit(224.0), (cr - 128) * 255 / F.lit(224.0)
    kg = 1 - KR - KB
    light = (luma + 2 * (1 - KR) * v, luma - 2 * KB * (1 - KB) / kg * u - 2 * KR * (1 - KR) / kg * v, luma + 2 * (1 - KB) * u)
    return [F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c).cast("bigint"))) for c in light]
