"""MinHash near-duplicates: universal hash minima in bands, verified links, components by alternating stars.

Documents with one shingle set form a class; only classes go on. Classes that share a band with the least class of
the band's bucket are joined into candidate groups (supersets of the true components). Within a group, pairs that
share a band are compared: first on their signatures, then on their full shingle sets. Pairs whose ends are already
connected need no comparison, so a group of thousands of copies costs about one comparison for each copy. Large
groups are cut into chunks; each pair of chunks is a task of its own.

Defined results: null or blank texts have empty sets and are linked with nothing; rows with equal doc_id are documents
of their own, each compared by its own text; a null doc_id takes part like any other and is a component's id only where
no row of it has another; other columns are ignored by :func:`near_duplicates` and kept by :func:`keep_one`, which keeps
one row of each group: of the least doc_id, then the least hash of the text, then of all columns; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeframe.llm.common import WordHash, discard, join_on, materialise, shingle_hashes, unused
from cubeframe.llm.components import connected_components

BANDS, ROWS = 40, 6
#: A link of likeness 0.8 has this signature agreement or more but for one case in 10**7 (5 standard deviations).
SLACK = 0.13
CHUNK = 256

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of BANDS * ROWS universal hashes."""
    out = np.full(BANDS * ROWS, ~np.uint64(0))
    step = 2048
    for at in range(0, len(shingles), step):
        x = shingles[at : at + step]
        for k in range(0, len(_A), 48):
            np.minimum(out[k : k + 48], (x * _A[k : k + 48, None] + _B[k : k + 48, None]).min(1), out=out[k : k + 48])
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    from cubeframe.llm.common import mix

    rows, out = sig.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out + rows[:, k])
    return out


def shingle_sets(texts, size: int, seen: WordHash):
    for text in texts:
        yield shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), size, seen)
        seen.trim()


def classes(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), bands (packed 64-bit keys), hashed (a hash of the text)."""

    def of(batches):
        seen = WordHash()
        for pdf in batches:
            out = []
            for s in shingle_sets(pdf["text"], size, seen):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                out.append((len(s), digest, bands(signature(s)).tobytes() if len(s) else None))
            yield pd.concat([pdf[["doc_id", "hashed"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_shingles", "digest", "bands"])], axis=1)

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("hashed"), "text")
    out = rows.mapInPandas(of, "doc_id string, hashed long, n_shingles long, digest binary, bands binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def _exact(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def compare(ids: list, shingles, sizes: np.ndarray, keys: np.ndarray, labels: list, left: np.ndarray, share: int) -> list[tuple]:
    """Links that connect what ``labels`` does not connect yet, between items with ``left`` and all others.

    ``shingles(k)`` gives the set of item k; only items that share a band with an item not connected to them are asked for.
    """
    order = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    tops, links = np.array([order[x] for x in labels]), []
    sigs, have = np.zeros((len(ids), BANDS * ROWS), np.uint32), np.zeros(len(ids), bool)

    for i in range(len(ids)):
        other = np.flatnonzero((tops[:i] != tops[i]) & (left[:i] | left[i]))
        lo, hi = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[100 * lo >= share * hi]
        other = other[(keys[other] == keys[i]).any(1)]
        if not len(other):
            continue
        for k in (i, *other[~have[other]]):
            if not have[k]:
                sigs[k], have[k] = signature(shingles(k)).astype(np.uint32), True
        like = (sigs[other] == sigs[i]).mean(1)
        for j in other[np.argsort(-like)][: int((like >= share / 100 - SLACK).sum())]:
            if tops[i] != tops[j] and _exact(shingles(i), shingles(j), share):
                links.append((ids[i], ids[j]))
                tops[tops == tops[j]] = tops[i]
    return links


def _verified(tasks: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """(u, v) links within the tasks' groups of classes; tasks: node, comp, label, main, a, b.

    Two classes are compared unless both are ``main``.
    """
    rows = tasks.join(texts, "node").select("node", "text", "n_shingles", "bands", "comp", "label", "main", "a", "b")
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        seen, sets, of = WordHash(), {}, pdf["text"].tolist()

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = next(shingle_sets([of[k]], size, seen))
            return sets[k]

        keys = np.frombuffer(b"".join(pdf["bands"]), np.uint64).reshape(-1, BANDS)
        links = compare(pdf["node"].tolist(), shingles, pdf["n_shingles"].to_numpy(), keys, pdf["label"].tolist(), ~pdf["main"].to_numpy(bool), share)
        return pd.DataFrame(stars(links), columns=["u", "v"])

    return rows.repartition(parts, "comp", "a", "b").groupBy("comp", "a", "b").applyInPandas(block, "u long, v long")


def stars(links: list[tuple]) -> list[tuple]:
    """The links of one task as (item, least item that it is connected with)."""
    root: dict = {}

    def find(x):
        while x in root:
            x = root[x]
        return x

    for u, v in links:
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
    return [(x, find(x)) for x in root]


def _met(groups: DataFrame) -> DataFrame:
    """A task for each pair of a group's chunks of which one has a row that is not ``main``."""
    cols = ["node", "comp", "label", "main"]
    odd = groups.where("NOT main").select("comp", F.col("chunk").alias("odd")).distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("odd")
    hosts = groups.where("NOT main").select(*cols, "chunk", every)
    guests = groups.join(odd, "comp").select(*cols, "chunk", "odd")
    return guests.union(hosts).select(*cols, F.least("chunk", "odd").alias("a"), F.greatest("chunk", "odd").alias("b")).distinct()


def _classed(documents: DataFrame, shingle: int, share: int) -> tuple[DataFrame, DataFrame]:
    """The documents' rows (doc_id, hashed, n_shingles, digest), and digest, component_id, chosen for each class.

    ``chosen``: least (doc_id, hashed) of the component, of a doc_id if it has one.
    """
    docs = documents.select("doc_id", "text")
    rows = materialise(classes(docs, shingle), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "hashed"))
    whole = rows.where("digest IS NOT NULL").groupBy("digest").agg(first.alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"))
    whole = materialise(whole.withColumn("node", F.monotonically_increasing_id()), "reps")  # numbers that stay: they are in the files
    longs = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.conv(F.hex(F.substring(F.col("bands"), k * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    keys = whole.select("node", F.explode(longs).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "v")
    near = keys.join(buckets, "key").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    comps = connected_components(near, "candidates")
    comps = comps.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(comps.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    size = comps.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    groups = comps.join(size, "comp").select("node", "comp", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"))
    groups = materialise(groups, "groups")
    wanted = whole.join(groups.select("node"), "node").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.hashed").alias("hashed"), "n_shingles", "bands")
    texts = join_on(docs.withColumn("hashed", F.xxhash64("text")), wanted, ["doc_id", "hashed"])
    texts = materialise(texts.dropDuplicates(["node"]).select("node", "text", "n_shingles", "bands"), "texts")
    own = groups.select("node", "comp", F.col("node").alias("label"), F.lit(False).alias("main"), F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    links = materialise(_verified(own, texts, shingle, share), "links")
    large = groups.where("chunks > 1")
    if not large.isEmpty():
        labelled = large.join(links.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = links.union(materialise(_join_chunks(labelled, texts, shingle, share), "across"))
    discard(texts)
    found = connected_components(links, "links")
    found = found.union(found.select(F.col("v").alias("u"), "v").distinct())  # whoever is linked, with its component
    reps = whole.select("node", "digest", "rep")
    linked = materialise(reps.join(found.select(F.col("u").alias("node"), F.col("v").alias("comp")), "node"), "linked")
    least = materialise(linked.groupBy("comp").agg(F.min("rep").alias("chosen")), "least")
    to = linked.join(least, "comp").select("digest", "chosen").union(reps.join(linked, "node", "left_anti").select("digest", F.col("rep").alias("chosen")))
    return rows, to.select("digest", F.col("chosen.doc_id").alias("component_id"), "chosen")


def near_duplicates(documents: DataFrame, shingle: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and digest: one row for each document.

    Linked: 100 * common shingles >= ``share`` * all shingles of both.
    """
    rows, to = _classed(documents, shingle, share)
    out = rows.select("doc_id", "n_shingles", "digest").join(to.select("digest", "component_id"), "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "digest")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _join_chunks(labelled: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Links between chunks of large groups; labelled: node, comp, chunks, chunk, label (the least it is linked with).

    First each chunk meets a member of the largest label of each other chunk of its group, which connects most of a
    dense group; then whatever is outside the group's largest label meets every chunk.
    """
    counted = labelled.groupBy("comp", "label", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    pivots = counted.groupBy("comp", "chunk").agg(F.max_by("node", F.struct("n", "node")).alias("node")).select("comp", "node")
    heads = labelled.join(pivots, ["comp", "node"], "left_semi")
    meet = heads.select("node", "comp", "label", F.lit(False).alias("main"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("a"))
    stay = labelled.join(pivots, ["comp", "node"], "left_anti").select("node", "comp", "label", F.lit(True).alias("main"), F.col("chunk").alias("a"))
    first = materialise(_verified(meet.union(stay).withColumn("b", F.col("a")), texts, size, share), "pivots")
    merged = connected_components(first.union(labelled.select(F.col("node").alias("u"), F.col("label").alias("v"))), "pivoted")
    now = labelled.drop("label").join(merged.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    now = materialise(now, "labelled")
    most = now.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("top"))
    last = _verified(_met(now.join(most, "comp").withColumn("main", F.col("label") == F.col("top"))), texts, size, share)
    return first.union(last)


def keep_one(documents: DataFrame, shingle: int = 5, share: int = 80) -> DataFrame:
    """The documents, all columns, one row for each group of near-duplicates; texts with empty sets all stay."""
    rows, to = _classed(documents, shingle, share)
    at, n = unused(documents, "hashed"), unused(documents, "rows")
    own = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "hashed")
    of = rows.join(to.select("digest", "chosen"), "digest", "left").where(F.col("digest").isNull() | (own == F.col("chosen")))
    # rows that are equal in doc_id and text are told apart by their other columns: of a chosen one, one stays
    some = of.groupBy("doc_id", F.col("hashed").alias(at)).agg(F.when(F.max("digest").isNull(), 1).otherwise(F.count(F.lit(1))).alias(n))
    kept = join_on(documents.withColumn(at, F.xxhash64("text")), some, ["doc_id", at])
    several = kept.where(F.col(n) > 1)
    order = unused(kept, "order")
    first = Window.partitionBy("doc_id", at).orderBy(F.xxhash64(*[F.col(c).cast("string") for c in documents.columns]))
    one = several.withColumn(order, F.row_number().over(first)).where(F.col(order) == 1)
    return kept.where(F.col(n) == 1).select(*documents.columns).union(one.select(*documents.columns))


def op5_near_copies(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents: two-word shingles."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
