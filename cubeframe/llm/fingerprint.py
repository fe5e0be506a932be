"""Document fingerprints with DataFrame functions only: one-permutation MinHash.

Every five-word shingle is hashed once and falls into one of BINS bins by its top bits; a bin keeps its least hash.
An empty bin takes the value of a non-empty one, found by probing in an order fixed for that bin (optimal
densification). The low BITS bits of each bin's value are packed; likeness counts equal cells and corrects for cells
that are equal by chance.

Defined results: null text counts as empty; a text of fewer than five words is one shingle; a text without words has
the fingerprint "" and is like another such text (1.0) and unlike any other (0.0); equal texts have equal
fingerprints; rows with equal doc_id follow one another by text; a null doc_id comes last; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubeframe.llm.common import let

BIN_BITS, BITS, SHINGLE = 7, 8, 5
BINS, CELLS = 1 << BIN_BITS, 64 // BITS
#: Of a hash, what stands below its bin.
LOW = (1 << (64 - BIN_BITS)) - 1
#: Ranges of ids: so many, or one for each ROWS rows where that is more, up to MOST.
BUCKETS, ROWS, MOST = 4096, 1 << 20, 1 << 16


def _probes() -> Column:
    """For each bin all other bins in the order in which it asks them, end to end as one constant (folded once)."""
    order = [np.random.default_rng(7919 * (b + 1)).permutation(BINS) for b in range(BINS)]
    text = ",".join(",".join(str(x) for x in row if x != b) for b, row in enumerate(order))
    return F.split(F.lit(text), ",").cast("array<int>")


def packed(text: Column, probes: Column) -> Column:
    """The fingerprint as an array of BINS * BITS / 64 longs; empty for a text without words."""
    spaces = r"[\x20\x09-\x0D]+"
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    shingles = let(
        F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, spaces), lambda w: F.xxhash64(w))),
        lambda h: F.when(
            F.size(h) >= SHINGLE,
            F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(SHINGLE)), lambda i: F.xxhash64(*[F.get(h, i + F.lit(j)) for j in range(SHINGLE)])),
        ).otherwise(F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))),
    )
    #: Each bin's greatest value, so that every bin has one; where it is the least, the bin is empty.
    ends = F.split(F.lit(",".join(str(((b - BINS // 2) << (64 - BIN_BITS)) | LOW) for b in range(BINS))), ",").cast("array<bigint>")
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    least = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    empty = lambda v: v.bitwiseAND(F.lit(LOW)) == F.lit(LOW)

    def borrowed(v: Column, b: Column) -> Column:
        def asked(a: int, n: int) -> Column:
            some = F.transform(F.sequence(F.lit(a), F.lit(n - 1)), lambda j: F.get(v, F.get(probes, b * F.lit(BINS - 1) + j)))
            return F.get(F.filter(some, lambda x: ~empty(x)), F.lit(0))

        return F.coalesce(asked(0, 6), asked(6, 40), asked(40, BINS - 1))

    def pack(v: Column) -> Column:
        filled = F.transform(v, lambda x, b: F.when(empty(x), borrowed(v, b)).otherwise(x).bitwiseAND(F.lit((1 << BITS) - 1)))
        word = lambda c, k: F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, BITS).bitwiseOR(F.get(c, k * F.lit(CELLS) + i)))
        return let(filled, lambda c: F.transform(F.sequence(F.lit(0), F.lit(BINS // CELLS - 1)), lambda k: word(c, k)))

    return let(shingles, lambda s: F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(let(F.sort_array(F.concat(s, ends)), lambda t: let(least(t), pack))))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, from 0 to 1."""
    ones = int(("0" * (BITS // 4 - 1) + "1") * CELLS, 16)

    def differing(x: Column) -> Column:
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), differing)), F.lit(0), lambda s, x: s + x.cast("int"))
    equal = F.lit(1.0) - unlike / F.lit(float(BINS))
    chance = 1.0 / (1 << BITS)
    measured = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(measured)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (packed longs), fingerprint_text: one row for each document."""
    out = documents.select("doc_id", packed(F.col("text"), _probes()).alias("fingerprint"))
    return out.withColumn("fingerprint_text", as_text(F.col("fingerprint")))


def with_next(documents: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """doc_id, ``columns`` and ``next_<column>`` of the document that follows by descending doc_id; the first after the last.

    The ids' quantiles cut the rows into ranges, so rows move once and no window spans the table. The first row of a
    range also goes to the range before it, as a guest that ends it. The driver sees at most ``buckets`` or MOST bounds.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = documents.select("doc_id", *columns).withColumn("_k", key)
    n = rows.count()
    parts = max(1, min(buckets, n // 128), min(MOST, n // ROWS))
    bounds = [] if parts == 1 else rows.select(F.percentile_approx("_k", [i / parts for i in range(1, parts)], parts * 20)).first()[0]
    bounds = sorted(set(bounds or []))
    depth = max(1, len(bounds)).bit_length()
    filled = bounds + [(1 << 63) - 1] * ((1 << depth) - 1 - len(bounds))
    table = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")
    #: How many bounds are below the key, by bisection.
    at = F.aggregate(F.sequence(F.lit(depth - 1), F.lit(0)), F.lit(0), lambda s, j: let(F.pow(F.lit(2.0), j).cast("int"), lambda w: F.when(F.get(table, s + w - 1) < F.col("_k"), s + w).otherwise(s)))
    rows = rows.withColumn("_b", at)
    heads = sorted((r[0], r[1]) for r in rows.groupBy("_b").agg(F.max("_k")).collect())
    above = {b: heads[(i + 1) % len(heads)][0] for i, (b, _) in enumerate(heads)}
    to = F.split(F.lit(",".join(str(above.get(b, 0)) for b in range(len(filled) + 1))), ",").cast("array<int>")
    head = F.split(F.lit(",".join(str(dict(heads).get(b, 0)) for b in range(len(filled) + 1))), ",").cast("array<bigint>")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(to, F.col("_b")).alias("b"), F.lit(1).alias("guest"))
    rows = rows.withColumn("_p", F.explode(F.when(F.col("_k") == F.get(head, F.col("_b")), F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("_p.b").orderBy(F.col("_p.guest"), F.col("_k").desc(), *[F.col(c).asc_nulls_first() for c in columns[:1]])
    nexts = F.lead(F.struct(*columns)).over(order)
    return rows.withColumn("_n", nexts).where("_p.guest = 0").select("doc_id", *columns, *[F.col(f"_n.{c}").alias(f"next_{c}") for c in columns])


def op1_fingerprint(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents; the only document is its own next one."""
    probes = _probes()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("fp", packed(F.col("text"), probes))
    both = with_next(docs, ["text", "fp"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fp",
        "next_fp",
        let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), packed(e, probes).alias("fp"))).alias("e"),
    )
    return out.select(
        "doc_id",
        "n_chars",
        F.col("e.sha").alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("e.fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("e.fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
