"""Spectral indices as column expressions; a zero denominator gives null, or is avoided by an epsilon in the eps forms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def normalized(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def ndvi(nir, red):
    return normalized(nir, red)


def nbr(nir, swir2):
    return normalized(nir, swir2)


def ndmi(nir, swir1):
    return normalized(nir, swir1)


def evi(nir, red, blue):
    return F.try_divide(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)


def evi2(nir, red):
    return F.try_divide(2.5 * (nir - red), nir + 2.4 * red + 1.0)


def eps_indices(b2, b3, b4, b8, b11) -> dict[str, Column]:
    """The five indices of a label's patch, each denominator plus 1e-6."""
    return {
        "ndvi": (b8 - b4) / (b8 + b4 + EPS),
        "evi": 2.5 * (b8 - b4) / (b8 + 6.0 * b4 - 7.5 * b2 + 1.0 + EPS),
        "evi2": 2.5 * (b8 - b4) / (b8 + 2.4 * b4 + 1.0 + EPS),
        "ndwi": (b3 - b8) / (b3 + b8 + EPS),
        "nbr_s": (b8 - b11) / (b8 + b11 + EPS),
    }


def stretch(x: Column, low: Column, high: Column) -> Column:
    """Display stretch to whole numbers from 0 to 255."""
    return F.least(F.greatest(F.floor((x - low) / (high - low + 1e-5) * 255), F.lit(0)), F.lit(255)).cast("int")


def ndvi_floor(ts: Column) -> Column:
    """Lowest NDVI of crops by month: 0.2 from March to June, 0.3 from August to October, else and unknown 0.25."""
    m = F.month(ts)
    return F.when(m.between(3, 6), 0.2).when(m.between(8, 10), 0.3).otherwise(0.25)


def with_formula(rows: DataFrame, name: str, text: str, **operands: Column) -> DataFrame:
    """Rows with a column from a formula in SQL over named operands, as ``"2.5 * (NIR - RED)", NIR=col, RED=col``."""
    return rows.withColumns({n: c.cast("double") for n, c in operands.items()}).withColumn(name, F.expr(text)).drop(*operands)


def rgb_bands(descriptions: list[str | None], strict: bool = True) -> list[int]:
    """1-based bands of red, green and blue by a name that holds B4, B3 and B2; else the first three, or the first thrice."""
    found = []
    for wanted in ("B4", "B3", "B2"):
        found += [i + 1 for i, d in enumerate(descriptions) if d and wanted.lower() in d.lower()][:1]
    if len(found) == 3:
        return found
    return [1, 2, 3] if strict or len(descriptions) >= 3 else [1, 1, 1]


def rgb_band_numbers(descriptions: Column, strict: bool = True) -> Column:
    """``rgb_bands`` of a column of arrays."""
    named = lambda wanted: F.array_position(F.transform(descriptions, lambda d: F.coalesce(F.lower(d).contains(wanted), F.lit(False))), True)
    found = F.array(*[named(w).cast("int") for w in ("b4", "b3", "b2")])
    first = F.array(F.lit(1), F.lit(2), F.lit(3))
    rest = first if strict else F.when(F.size(descriptions) >= 3, first).otherwise(F.array(F.lit(1), F.lit(1), F.lit(1)))
    return F.when(F.array_min(found) > 0, found).otherwise(rest)


def elapsed(seconds: Column) -> Column:
    """Whole seconds as ``h:mm:ss``, with days in front of a day or more."""
    s = F.floor(seconds).cast("bigint")
    days = F.floor(s / 86400).cast("bigint")
    clock = F.format_string("%d:%02d:%02d", F.floor(s % 86400 / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)
    return F.concat(F.when(days == 1, "1 day, ").when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise(""), clock)
