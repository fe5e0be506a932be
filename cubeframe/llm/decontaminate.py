"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows form a hash set; each training document's windows are looked up in it, each hit is
confirmed on the words themselves, and the hit words' spans or the whole documents go.

Defined results: a null text has no words, is never hit and is kept; an item without words occurs nowhere; an item
of fewer words than a window is one window; repeated document rows each get their own row; repeated items count once
by ``item_id``; other columns are ignored by :func:`scan` and kept by :func:`remove_documents`; empty tables give no
rows, or rows without hits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import LOWER, UPPER, join_on, let, materialise, unused

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window's beginning that the bitmap knows.
PREFIX = 3
#: Windows that may be broadcast (about 150 bytes each); beyond that the join shuffles.
MOST_BROADCAST = 200_000


def _edge(words: Column, at: Column) -> Column:
    """1 if a separator stands at that end of the text, else 0."""
    return F.when(F.get(words, at) == "", 1).otherwise(0)


def _words(text: Column) -> Column:
    """The words as they stand; lower-casing does not move their limits."""
    return let(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: F.slice(w, _edge(w, F.lit(0)) + 1, F.greatest(F.size(w) - _edge(w, F.lit(0)) - F.when(F.size(w) > 1, _edge(w, F.size(w) - 1)).otherwise(0), F.lit(0))))


def _text_of(words: Column, pos: Column, size: Column) -> Column:
    return F.translate(F.array_join(F.transform(F.sequence(pos, pos + size - F.lit(1)), lambda i: F.get(words, i - 1)), " "), UPPER, LOWER)


def _hash(h: Column, at: Column, size: int) -> Column:
    """Of the ``size`` words whose hashes stand from ``at`` (from 0)."""
    return F.xxhash64(*[F.get(h, at + F.lit(j)) for j in range(size)])


def _windows(h: Column, sizes: list[int], bits: dict[int, Column] | None = None) -> Column:
    """(pos from 1, size, hash) of every window of each of the sizes.

    ``bits``: for each size a bitmap (array of longs) of the first words' hashes; other windows are left out.
    """

    def of(size: int) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - F.lit(size))
        if bits:
            known, cells = bits[size]
            first = min(size, PREFIX)
            at = F.filter(at, lambda i: let(_hash(h, i, first).bitwiseAND(F.lit(cells * 64 - 1)), lambda x: F.getbit(F.get(known, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1))
        found = F.transform(at, lambda i: F.struct((i + 1).alias("pos"), F.lit(size).alias("size"), _hash(h, i, size).alias("hash")))
        return F.when(F.size(h) >= size, found).otherwise(F.array().cast("array<struct<pos:int,size:int,hash:bigint>>"))

    return F.concat(*[of(n) for n in sizes])


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bitmaps(found: DataFrame) -> dict[int, Column]:
    """Bitmaps of what the windows begin with; ``found`` has at most MOST_BROADCAST rows."""
    rows = found.select("size", "first").distinct().collect()
    cells = 1 << max(4, (len(rows) // 4).bit_length())
    out = {}
    for size in {r["size"] for r in rows}:
        known = np.zeros(cells, np.uint64)
        x = np.array([r["first"] for r in rows if r["size"] == size], np.int64) & (cells * 64 - 1)
        np.bitwise_or.at(known, x >> 6, np.uint64(1) << (x & 63).astype(np.uint64))
        out[size] = (F.split(F.lit(",".join(map(str, known.view(np.int64)))), ",").cast("array<bigint>"), cells)
    return out


def benchmark_windows(benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(size, hash, wtext, item_id): the distinct windows of each item."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words"), _words(F.translate("text", UPPER, LOWER)).alias("low"))
    items = items.where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    items = items.withColumn("h", _hashes(F.col("low")))
    cut = F.coalesce(*[F.when(F.col("n") == size, _windows(F.col("h"), [size])) for size in range(1, window + 1)])
    out = items.select("item_id", "words", "h", F.explode(cut).alias("w"))
    at = F.col("w.pos") - 1
    first = F.coalesce(*[F.when(F.col("w.size") == size, _hash(F.col("h"), at, size)) for size in range(1, PREFIX)], _hash(F.col("h"), at, PREFIX))
    return out.select("w.size", "w.hash", first.alias("first"), _text_of(F.col("words"), F.col("w.pos"), F.col("w.size")).alias("wtext"), "item_id").distinct()


def scan(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``contaminated``: some word is hit and ``share * n_hit >= n_words``. ``spans``: merged (first word, last word + 1).
    """
    documents = documents.select("doc_id", "text")
    found = materialise(benchmark_windows(benchmark, window), "windows")
    sizes = sorted(r[0] for r in found.select("size").distinct().collect())  # at most `window` of them
    texts, bits = found.select("size", "hash", "wtext").distinct(), None
    if found.count() <= MOST_BROADCAST:
        texts, bits = F.broadcast(texts), _bitmaps(found)
    key = [F.col("doc_id"), F.xxhash64("text").alias("_text")]
    seen = let(_hashes(_words(F.translate("text", UPPER, LOWER))), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _windows(h, sizes, bits).alias("at") if sizes else F.array().cast("array<struct<pos:int,size:int,hash:bigint>>").alias("at")))
    if bits is None:  # every window meets the benchmark in a shuffle; only the count is kept
        base = documents.select(*key, F.size(_words(F.col("text"))).cast("long").alias("n_words"))
        wins = documents.select(*key, F.explode(seen["at"]).alias("w"))
    else:
        base = materialise(documents.select(*key, seen.alias("x")), "scan")
        wins = base.select("doc_id", "_text", F.explode("x.at").alias("w"))
        base = base.select("doc_id", "_text", "x.n_words")
    found_at = wins.select("doc_id", "_text", F.col("w.pos").alias("pos"), F.col("w.size").alias("size"), F.col("w.hash").alias("hash")).join(texts, ["size", "hash"])
    maybe = materialise(found_at.groupBy("doc_id", "_text").agg(F.collect_set(F.struct("pos", "size", "wtext")).alias("at")), "maybe")
    read = documents.select(*key, "text")
    if maybe.count() <= MOST_BROADCAST:  # else all texts move to meet their candidates
        read = join_on(read, F.broadcast(maybe.select("doc_id", "_text")), ["doc_id", "_text"], "left_semi")
    both = join_on(read.dropDuplicates(["doc_id", "_text"]), maybe, ["doc_id", "_text"]).select("doc_id", "_text", "at", _words(F.col("text")).alias("words"))
    sure = let(
        F.struct("at", "words"),
        lambda x: F.filter(x["at"], lambda c: _text_of(x["words"], c["pos"], c["size"]) == c["wtext"]),
    )
    spans = both.select("doc_id", "_text", sure.alias("sure")).where(F.size("sure") > 0)
    spans = spans.select(
        "doc_id",
        "_text",
        F.array_sort(F.transform("sure", lambda c: F.struct(c["pos"].alias("pos"), c["size"].alias("size")))).alias("at"),
        F.array_distinct(F.transform("sure", lambda c: c["wtext"])).alias("wtexts"),
    )
    spans = materialise(spans, "hits")
    items = (
        spans.select("doc_id", "_text", F.explode("wtexts").alias("wtext"))
        .join(found.select("wtext", "item_id").distinct(), "wtext")
        .groupBy("doc_id", "_text")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    start = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate(
        "at",
        start,
        lambda out, x: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["b"] >= x["pos"]),
            F.concat(
                F.slice(out, F.lit(1), F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["b"], x["pos"] + x["size"]).alias("b"))),
            ),
        ).otherwise(F.concat(out, F.array(F.struct(x["pos"].alias("a"), (x["pos"] + x["size"]).alias("b"))))),
    )
    per = join_on(spans.select("doc_id", "_text", merged.alias("spans")), items, ["doc_id", "_text"])
    out = join_on(base, per, ["doc_id", "_text"], "left")
    items_c = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    spans_c = F.coalesce(F.col("spans"), start)
    n_hit = F.aggregate(spans_c, F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_c).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_c, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        spans_c.alias("spans"),
        "_text",
    )


def remove_documents(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents, all columns, without those that are contaminated."""
    at = unused(documents, "_text")
    bad = scan(documents, benchmark, window, share).where("contaminated").select("doc_id", F.col("_text").alias(at)).distinct()
    return join_on(documents.withColumn(at, F.xxhash64("text")), bad, ["doc_id", at], "left_anti").select(*documents.columns)


def remove_spans(documents: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The documents, all columns, ``text`` rebuilt from the words that are not hit where a document has hits."""
    at, cut = unused(documents, "_text"), unused(documents, "_spans")
    hit = scan(documents, benchmark, window).where("n_hit > 0").select("doc_id", F.col("_text").alias(at), F.col("spans").alias(cut)).dropDuplicates(["doc_id", at])
    joined = join_on(documents.withColumn(at, F.xxhash64("text")), hit, ["doc_id", at], "left")
    words = _words(F.col("text"))
    kept = F.array_join(F.filter(words, lambda w, i: ~F.exists(F.col(cut), lambda s: (s["a"] <= i + 1) & (i + 1 < s["b"]))), " ")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).select(*documents.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents and all benchmark items."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, w[i : i + least(len(w), 13) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
pos AS (
  SELECT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'i': i, 'win': w[i : i + k - 1]})) AS x
  FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k),
hit AS (
  SELECT doc_id, x.i AS i, pos.k, item_id FROM pos JOIN bw ON pos.k = bw.k AND pos.x.win = bw.win),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
