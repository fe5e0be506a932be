"""Paths, names, labels and small rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeframe.functions.bands import offset_of_baseline

#: Properties that may hold the processing baseline, in the order in which they are asked.
BASELINE_PROPERTIES = ("s2:processing_baseline", "processing:version")


def baseline_offset(properties: Column) -> Column:
    """Offset by the first baseline that the properties (a map of strings) have; reading it fails if they have none."""
    return offset_of_baseline(F.coalesce(*[F.element_at(properties, p) for p in BASELINE_PROPERTIES]))


def offset_of_id(item: Column) -> Column:
    """Offset by the baseline in an id ("_N0400_"), null if there is none."""
    code = F.regexp_extract(item, r"_N(\d{4})_", 1)
    return F.when(code != "", F.when(code.cast("int") >= 400, -1000).otherwise(0))


def offset_and_source(declared: Column, item: Column) -> Column:
    """(offset, source): what is declared, else what the id tells, else nothing."""
    return F.struct(F.coalesce(declared, offset_of_id(item)).alias("offset"), F.when(declared.isNotNull(), "declared").when(offset_of_id(item).isNotNull(), "derived").otherwise("missing").alias("source"))


def utc(text: Column) -> Column:
    """A time from text; one without a zone is UTC, one that is none is null."""
    return F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))))


def source_path(url: Column) -> tuple[Column, Column]:
    """(path below the bucket without ".SAFE" names' endings, name of the parent folder)."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z0-9]+://[^/]+/", ""), r"\.SAFE(/|$)", "$1")
    return path, F.regexp_extract(path, "([^/]+)/[^/]*$", 1)


def vsi_path(url: Column) -> Column:
    """abfss://container@account.host/path and az://container/path as a virtual path; reading anything else fails."""
    long, short = r"^abfss?://([^@/]+)@([^/]+)/(.+)$", r"^az://([^/]+)/(.+)$"
    made = F.when(url.rlike(long), F.concat(F.lit("/vsiaz/"), F.regexp_extract(url, long, 1), F.lit("/"), F.regexp_extract(url, long, 3)))
    made = made.when(url.rlike(short), F.concat(F.lit("/vsiaz/"), F.regexp_extract(url, short, 1), F.lit("/"), F.regexp_extract(url, short, 2)))
    return made.otherwise(F.raise_error(F.concat(F.lit("no such address: "), url)))


def moved(files: Column, old: str, new: str) -> Column:
    """A comma list of paths under another root, with .tif in the place of .jp2."""
    one = lambda f: F.regexp_replace(F.when(f.startswith(old), F.concat(F.lit(new), F.substring(f, F.lit(len(old) + 1), F.length(f)))).otherwise(f), r"\.jp2$", ".tif")
    return F.array_join(F.transform(F.split(files, ","), one), ",")


def error_label(message: Column, codes: list[str], other: Column) -> Column:
    """The first of the codes that the message holds, else ``other``."""
    return F.coalesce(*[F.when(message.contains(c), F.lit(c)) for c in codes], other)


def media_type(file: Column) -> Column:
    ends = lambda *e: reduce(lambda a, b: a | b, [F.lower(file).endswith(x) for x in e])
    return F.when(ends(".tif", ".tiff"), "image/tiff; application=geotiff; profile=cloud-optimized").when(ends(".jp2"), "image/jp2").when(ends(".xml"), "application/xml").otherwise("application/octet-stream")


def shard(i: Column, n: Column, most: int) -> Column:
    """Round robin over as many shards as there are rows, ``most`` at the most, so that none is empty."""
    return i % F.least(n, F.lit(most))


def shortened(name: Column, most: int) -> Column:
    """A file name cut to ``most`` characters; its ending stays."""
    end = F.regexp_extract(name, r"(\.[^./]+)$", 1)
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.substring(name, F.lit(1), F.lit(most) - F.length(end)), end))


def guarded_ndvi(red: Column, nir: Column) -> Column:
    """Null unless both together are positive."""
    return F.when(nir + red > 0, (nir - red) / (nir + red))


def timeout_seconds(gigabytes: Column) -> Column:
    """Time for a transfer at 10 MB a second, half an hour at least."""
    return F.greatest(gigabytes * 1024 / 10, F.lit(1800.0))


def remaining(done: Column, total: Column, seconds: Column) -> Column:
    """Progress as text: share done and the time that the rest will take at the pace so far."""
    rest = F.round(seconds / F.nullif(done, F.lit(0)) * (total - done)).cast("long")
    return F.concat(F.round(100.0 * done / total, 1).cast("decimal(5,1)").cast("string"), F.lit("% left "), F.coalesce(rest.cast("string"), F.lit("?")), F.lit("s"))
