"""Work lists, registries, run reports: what is there, what is missing, what ran how long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.operators.catalog import upsert


def build_shortfall(shapes: DataFrame, cubes: DataFrame, empty: DataFrame, window: Column) -> DataFrame:
    """Shapes (id) without a complete cube (id, window, complete) for the window; ids known to be empty (id, window) are left out."""
    have = cubes.where((F.col("window") == window) & F.col("complete")).select("id")
    return shapes.join(have.union(empty.where(F.col("window") == window).select("id")), "id", "left_anti")


def known_empty(now: DataFrame, add: DataFrame, subtract: DataFrame) -> DataFrame:
    """(id, window): the registry after additions and removals; adding nothing and subtracting itself clears it."""
    keys = ["id", "window"]
    return now.select(*keys).union(add.select(*keys)).distinct().join(subtract.select(*keys), keys, "left_anti")


def current(rows: DataFrame, window: Column, classes: Column) -> DataFrame:
    """Rows of this window and these mask classes; no classes may be written as null, NaN or an empty text."""
    plain = lambda c: F.when(F.lower(F.trim(c)).isin("", "nan", "[]"), F.lit("")).otherwise(F.coalesce(F.trim(c), F.lit("")))
    return rows.where((F.col("window") == window) & (plain(F.col("classes")) == plain(classes)))


def present(cubes: DataFrame, listing: DataFrame, names: list[str]) -> DataFrame:
    """``cubes`` (folder, ...) with ``present``: all of the named files are in the listing (path, length) and not empty."""
    found = listing.where("length > 0").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    full = found.where(F.col("name").isin(names)).groupBy("folder").agg((F.count_distinct("name") == len(names)).alias("present"))
    return cubes.join(full, "folder", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def by_suffix(candidates: DataFrame, have: DataFrame, parts: int = 3) -> DataFrame:
    """Candidates (path) whose last parts are also the last parts of a path in ``have``."""
    key = lambda c: F.substring_index(c, "/", -parts)
    return candidates.join(have.select(key("path").alias("suffix")).distinct(), key(candidates["path"]) == F.col("suffix"), "left_semi")


def required(outputs: DataFrame, footprints: DataFrame, key: str) -> DataFrame:
    """The inner join; reading an output without a footprint fails."""
    marked = outputs.join(footprints.withColumn("has", F.lit(True)), key, "left")
    return marked.where(F.when(F.col("has"), True).otherwise(F.raise_error(F.concat(F.lit("no footprint of "), F.col(key).cast("string"))))).drop("has")


def at_most(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df``; reading it fails where it has more rows: a guard does not cut."""
    n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.when(F.col("rows") > most, F.raise_error(F.concat(F.lit(f"more than {most} {what}: "), F.col("rows").cast("string")))).otherwise(F.lit(True)).alias("fine"))
    return df.crossJoin(F.broadcast(n)).where("fine").drop("fine")  # one row


def last_ids(tiles: DataFrame) -> DataFrame:
    """ts, id: of the tiles (seq, ts, id) of one time the last counts."""
    return tiles.groupBy("ts").agg(F.max_by("id", "seq").alias("id"))


def best_cell(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the cell (id, coverage) of the greatest coverage, the least id of equals."""
    best = F.min_by(F.struct("id", "coverage"), F.struct(-F.col("coverage"), F.col("id")))
    return cells.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.id", "b.coverage")


def merge_shards(stored: DataFrame, shards: list[DataFrame], key: str, files: str, others: list[str]) -> DataFrame:
    """A stored catalog with shards merged into it one after another, in a single upsert: later ones are newer."""
    cols = [key, files, *others]
    every = stored.select(*cols, F.lit(0).alias("seq"))
    for k, s in enumerate(shards, 1):
        every = every.unionByName(s.select(*cols, F.lit(k).alias("seq")))
    return upsert(every, key, "seq", files, others)


def schema_consistent(cubes: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether all cubes agree in the columns, and how many kinds there are."""
    return cubes.select(F.struct(*columns).alias("s")).distinct().agg(F.count(F.lit(1)).alias("kinds")).select("kinds", (F.col("kinds") <= 1).alias("consistent"))


def duplicate_ids(df: DataFrame, key: str, worst: int = 5) -> DataFrame:
    """Ids that stand more than once, the worst first, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), key).limit(worst)


def coverage(obs: DataFrame, keys: list[str], ts: str, gap_days: int, start: Column, end: Column) -> DataFrame:
    """Per key: range of times, longest gap in days, and the flags that a build would stop or warn for."""
    w = Window.partitionBy(*keys).orderBy(ts)
    days = obs.select(*keys, ts).distinct().withColumn("gap", F.date_diff(ts, F.lag(ts).over(w)))
    out = days.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("gap").alias("max_gap"), F.count(F.lit(1)).alias("n"))
    return out.withColumns({
        "gap_too_long": F.coalesce(F.col("max_gap") > gap_days, F.lit(False)),
        "leading_gap": F.date_diff("first", start) > gap_days,
        "trailing_gap": F.date_diff(end, "last") > gap_days,
    })


def missing_bands(rows: DataFrame, keys: list[str], band: str, unit: str, bands: list[str]) -> DataFrame:
    """Per key and asked band: how many of the key's units (times) have it; none, some or all."""
    units = rows.groupBy(*keys).agg(F.count_distinct(unit).alias("units"))
    have = rows.where(F.col(band).isin(bands)).groupBy(*keys, band).agg(F.count_distinct(unit).alias("have"))
    every = units.select("*", F.explode(F.array(*map(F.lit, bands))).alias(band)).join(have, [*keys, band], "left")
    n = F.coalesce("have", F.lit(0))
    return every.select(*keys, band, n.alias("have"), F.when(n == 0, "missing").when(n < F.col("units"), "partial").otherwise("complete").alias("state"))


def totals(passes: DataFrame, counters: list[str], flags: list[str], reason: str) -> DataFrame:
    """One row over all passes: counters added, flags or-ed, counts of each reason."""
    by = passes.groupBy(reason).agg(*[F.sum(c).alias(c) for c in counters], *[F.bool_or(f).alias(f) for f in flags], F.count(F.lit(1)).alias("n"))
    return by.agg(*[F.sum(c).alias(c) for c in counters], *[F.bool_or(f).alias(f) for f in flags], F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", reason, "n"))), ",").alias("reasons"))


def legs(runs: DataFrame, stamps: list[str]) -> DataFrame:
    """Seconds between each stamp and the next, and from the first to the last; negative ones stay."""
    second = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b))
    steps = [second(a, b).alias(f"{a}_to_{b}") for a, b in zip(stamps, stamps[1:], strict=False)]
    return runs.select("*", *steps, second(stamps[0], stamps[-1]).alias("whole"))


def digest(files: DataFrame) -> DataFrame:
    """(path, content) of one bundle as a SHA-256 over sorted (path, NUL, bytes); a bundle has few, small files."""
    one = F.concat(F.encode("path", "UTF-8"), F.unhex(F.lit("00")), F.col("content"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("path", one.alias("b")))), lambda s: F.hex(s["b"]))
    return files.groupBy("bundle").agg(F.sha2(F.unhex(F.array_join(parts, "")), 256).alias("digest"))


def provenance(rows: DataFrame, category: str, lists: str) -> DataFrame:
    """Rows of each category, and the distinct members of its comma lists."""
    some = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    members = rows.select(category, F.explode(F.split(lists, ",")).alias("m")).distinct().groupBy(category).agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("members"))
    return some.join(members, category, "left")


def drop_bands(df: DataFrame, bands: list[str]) -> DataFrame:
    """Without the bands; one that is not there is an error."""
    if lost := [b for b in bands if b not in df.columns]:
        raise ValueError(f"no bands {lost}")
    return df.drop(*bands)


def choose_assets(items: DataFrame, bands: list[str]) -> DataFrame:
    """id, band, key, href: of each band the lexically least asset key ("B02_10m" before "B02_20m"); absent bands are left out."""
    one = items.select("id", F.explode("assets").alias("key", "href")).withColumn("band", F.regexp_extract("key", r"^([^_]+)", 1))
    best = one.where(F.col("band").isin(bands)).groupBy("id", "band").agg(F.min(F.struct("key", "href")).alias("a"))
    return best.select("id", "band", "a.key", "a.href")


def needs_resample(rasters: DataFrame, reference: DataFrame) -> DataFrame:
    """Rasters (crs, height, width) with ``resample``: whether they differ from the one-row reference."""
    ref = reference.select(F.struct("crs", "height", "width").alias("ref"))
    return rasters.crossJoin(F.broadcast(ref)).withColumn("resample", ~F.struct("crs", "height", "width").eqNullSafe(F.col("ref"))).drop("ref")


def concurrency(runs: DataFrame, lo: str, hi: str, bucket: Column) -> DataFrame:
    """Per number of runs begun in the same bucket of time: how many runs, their mean and median length."""
    w = Window.partitionBy(bucket)
    some = runs.select((F.col(hi) - F.col(lo)).alias("length"), F.count(F.lit(1)).over(w).alias("peak"))
    return some.groupBy("peak").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("length"), 6).alias("mean"), F.median("length").alias("median"))
