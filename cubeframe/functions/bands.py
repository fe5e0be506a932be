"""Band arithmetic as column expressions; null stands for nodata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOIL = 0.48


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


#: Each index, the bands that it needs and its formula.
INDICES = {
    "NDVI": (("B04", "B08"), lambda r, n: _ratio(n, r)),
    "NDWI_green": (("B03", "B08"), lambda g, n: _ratio(g, n)),
    "NDWI_blue": (("B02", "B08"), lambda b, n: _ratio(b, n)),
    "NDRE": (("B05", "B08"), lambda e, n: _ratio(n, e)),
    "LSWI_B11": (("B08", "B11"), _ratio),
    "LSWI_B12": (("B08", "B12"), _ratio),
    "GCVI": (("B08", "B03"), lambda n, g: F.try_divide(n, g) - 1),
    "SAVI": (("B08", "B04"), lambda n, r: F.try_divide((n - r) * (1 + SOIL), n + r + SOIL)),
    "BSI": (("B02", "B04", "B08", "B11"), lambda b, r, n, s: _ratio(s + r, n + b)),
    "PSRI": (("B04", "B02", "B06"), lambda r, b, e: F.try_divide(r - b, e)),
    "NDTI_tillage": (("B11", "B12"), _ratio),
}


def spectral_indices(df: DataFrame, names: list[str]) -> DataFrame:
    """Append indices; an unknown one or a missing band is an error."""
    for name in names:
        if name not in INDICES:
            raise NotImplementedError(name)
        if lost := [b for b in INDICES[name][0] if b not in df.columns]:
            raise ValueError(f"{name} needs {lost}")
    return df.withColumns({n: INDICES[n][1](*[F.col(b).cast("double") for b in INDICES[n][0]]) for n in names})


def scaled(df: DataFrame, names: list[str], mean: float = 0.0, std: float = 1.0) -> DataFrame:
    return df.withColumns({n: (F.col(n) - F.lit(mean)) / F.lit(std) for n in names})


def with_offset(dn: Column, offset: Column) -> Column:
    """Radiometric offset, held within 16 bits; it is applied before any masking."""
    return F.least(F.greatest(dn + offset, F.lit(0)), F.lit(65535))


def is_reflectance(band: Column) -> Column:
    return band.rlike("^B[0-9]")


def masked(value: Column, mask: Column, classes: list[int]) -> Column:
    """Null where the mask band shows one of the classes."""
    return F.when(~F.coalesce(mask.isin(classes), F.lit(False)), value)


def offset_of_baseline(baseline: Column) -> Column:
    """-1000 from processing baseline 04.00 on, else 0; reading it fails where there is none."""
    part = F.split(baseline, r"\.")
    after = F.struct(part[0].cast("int"), part[1].cast("int")) >= F.struct(F.lit(4), F.lit(0))
    return F.when(baseline.isNull(), F.raise_error(F.lit("no processing baseline")).cast("int")).when(after, -1000).otherwise(0)


def mgrs_epsg(item: Column) -> Column:
    """EPSG code of the grid zone in an item name, null if there is none."""
    zone, letter = F.regexp_extract(item, r"_T(\d{2})([A-Z])[A-Z]{2}", 1), F.regexp_extract(item, r"_T(\d{2})([A-Z])[A-Z]{2}", 2)
    return F.when(zone != "", F.concat(F.when(letter >= "N", "326").otherwise("327"), zone).cast("int"))


def band_role(band: Column, reference: str = "B08") -> Column:
    return F.when(band == "SCL", "mask").when(band == reference, "reference").when(is_reflectance(band), "reflectance").otherwise("data")


def window_key(*parts: Column) -> Column:
    """Eight hex digits that name a set of parameters; their order counts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8)
