"""Repeated-passage removal over a parse of the corpus into phrases with content-defined triggers.

A rolling hash picks trigger strings: the least of those within any ``match`` bytes, so no window is without one (hashes
of a fixed residue, the usual triggers, leave windows without any in text of low entropy). The triggers cut each text
into overlapping phrases, each with the windows that its trigger stands for. Phrases whose trigger occurs in one
document only are done. The rest form, by trigger, a dictionary of distinct phrases and a parse (document and place of
each occurrence). The dictionary's suffixes are sorted by their first ``match`` bytes; equal neighbours are equal
windows, and the parse gives the least document of each. A suffix array of the parse itself is left out: it would order
suffixes beyond a phrase's end, and no window of ``match`` bytes reaches beyond its phrase.

The texts move once, into a table bucketed by text digest; only triggers, shared phrases and removal marks move after
that. Files are few: many buckets share one, and triggers and marks are gathered first (on local paths without Hadoop's
native library an executor starts two processes for each file that it creates). Triggers that many documents share are
salted: each salted group settles its own windows and hands on one document for each window. Texts of which there are
very many copies are stored once.

Defined results: null counts as empty; texts shorter than ``match`` bytes lose nothing; of equal texts all but the
least doc_id are removed whole; rows with equal doc_id do not match each other, whatever their texts; a null doc_id
counts as the greatest; other columns are kept by :func:`remove_repeats` and ignored by :func:`repeats`; an empty table
gives no rows.
"""

from __future__ import annotations

import atexit
import hashlib
import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import materialise, mix, unused

MATCH, TRIGGER = 50, 24
BUCKET_BYTES = 2 << 20
#: Bytes of text in a file of the stored table, on average; fewer where a core would have less than four files.
FILE_BYTES = 24 << 20
#: Documents of one trigger that one group settles.
CROWD = 1500
#: Of texts with more copies, at most COPIES and one for each COPIES in all, only the first is stored.
COPIES = 10_000
#: Triggers that a bucket sends in one row, at least, on average.
TOGETHER = 64
_BASE, _WORDS = 0x9E3779B97F4A7C15, -(-MATCH // 8)


def _rolling(a: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every ``k`` bytes, by doubling."""
    cur = mix(a.astype(np.uint64) + np.uint64(1))
    out, have, width, left = None, 0, 1, k
    n = len(a)
    while True:
        if left & 1:
            if out is None:
                out, have = cur, width
            else:
                m = n - (have + width) + 1
                out = out[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + cur[have : have + m]
                have += width
        left >>= 1
        if not left:
            return mix(out)
        m = n - 2 * width + 1
        cur = cur[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + cur[width : width + m]
        width *= 2


def phrases(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger key, first window, number of windows) of every phrase; nothing for a text shorter than MATCH."""
    n = len(text) - MATCH + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _rolling(np.frombuffer(text, np.uint8), TRIGGER)
    low = np.uint64(0xFFFFFFFF)
    key, span, have = (h & ~low) | np.arange(len(h), dtype=np.uint64), MATCH - TRIGGER + 1, 1
    while have * 2 <= span:
        key = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    at = (key & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]] >> np.uint64(16), first, np.diff(np.append(first, n))


def _pack(*parts) -> bytes:
    import zstandard

    return zstandard.compress(pickle.dumps(parts, 5), 1)


def _unpack(blob: bytes):
    import zstandard

    return pickle.loads(zstandard.decompress(blob))


def _split(key: np.ndarray, parts: int):
    """(part, where it stands) for rows by ``key`` modulo ``parts``."""
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


def _stored(pdf: pd.DataFrame):
    """(number, doc_id, digest, text) of the distinct texts of a bucket, each with its least doc_id, in a fixed order."""
    import zstandard

    pdf = pdf.sort_values(["doc_id", "digest"]).drop_duplicates("digest")
    for k, (doc_id, digest, z) in enumerate(zip(pdf["doc_id"].tolist(), pdf["digest"], pdf["z"], strict=True)):
        yield k, doc_id, digest, zstandard.decompress(z)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def _store(documents: DataFrame) -> tuple[DataFrame, int]:
    """The texts, once for each digest and task, in a table whose files each hold some buckets ``src``; and the number of buckets."""
    spark = documents.sparkSession
    digest = F.unhex(F.md5("text"))
    copies = documents.where("text IS NOT NULL").groupBy(digest.alias("same")).agg(F.count(F.lit(1)).alias("n"), F.min(_key()).alias("least"), F.max(F.octet_length("text")).alias("size"))
    copies = materialise(copies, "copies")
    n, total = copies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = copies.where(F.col("n") > max(COPIES, n // COPIES)).select("same", "least")  # at most COPIES rows
    parts = int(max(8, total / (BUCKET_BYTES * max(1.0, (total / (1 << 30)) ** (1 / 3)))))
    files = min(parts, max(4 * spark.sparkContext.defaultParallelism, total // FILE_BYTES))
    most = "spark.sql.sources.bucketing.maxBuckets"
    if files > int(spark.conf.get(most, "100000")):
        spark.conf.set(most, str(files))

    def of(batches):
        import zstandard

        seen: dict[bytes, int] = {}
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"], strict=True):
                text = text.encode("utf-8", "surrogatepass")
                digest = hashlib.md5(text).digest()
                if doc_id < seen.get(digest, 1 << 63):
                    seen[digest] = doc_id
                    out.append((int.from_bytes(digest[:6], "big") % parts, doc_id, digest, zstandard.compress(text, 1)))
            yield pd.DataFrame(out, columns=["src", "doc_id", "digest", "z"])

    rows = documents.where("text IS NOT NULL").select(_key().alias("doc_id"), "text")
    rows = rows.join(F.broadcast(hot), digest == F.col("same"), "left").where("least IS NULL OR least = doc_id").select("doc_id", "text")
    rows = rows.mapInPandas(of, "src int, doc_id long, digest binary, z binary")
    name = f"passages_{uuid.uuid4().hex}"
    rows.repartition(files, "src").write.bucketBy(files, "src").format("parquet").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name), parts


def _drop(spark, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _shared_triggers(texts: DataFrame, buckets: int) -> DataFrame:
    """(src, blob): the keys of the bucket's triggers that several texts have, with the number of texts."""
    parts = min(buckets, max(8, int(BUCKET_BYTES * max(1.0, buckets / 512) ** 0.5 / 14 / TOGETHER)))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [np.unique(phrases(text)[0]) for *_, text in _stored(pdf)]
        key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, int))
        out = []
        for part, rows in _split(key, parts):
            rest, many = key[rows] // np.uint64(parts), np.flatnonzero(n[rows] > 1)
            out.append((part, int(pdf["src"].iloc[0]), _pack((rest & np.uint64(0xFFFFFFFF)).astype("<u4"), (rest >> np.uint64(32)).astype("<u2"), many.astype("<u4"), n[rows][many].astype("<u4"))))
        return pd.DataFrame(out, columns=["part", "src", "blob"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts, src = [], [], []
        for s, blob in zip(pdf["src"], pdf["blob"], strict=True):
            low, high, many, n = _unpack(blob)
            keys.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
            c = np.ones(len(low), np.int64)
            c[many] = n
            counts.append(c)
            src.append(np.full(len(low), s))
        key, src = np.concatenate(keys), np.concatenate(src)
        uniq, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, np.concatenate(counts)).astype(np.int64)[back]
        keep = np.flatnonzero(total > 1)
        keep = keep[np.argsort(src[keep], kind="stable")]
        out = []
        for rows in np.split(keep, np.flatnonzero(np.diff(src[keep])) + 1):
            if len(rows):
                out.append((int(src[rows[0]]), _pack(key[rows] * np.uint64(parts) + np.uint64(pdf["part"].iloc[0]), total[rows].astype("<u4"))))
        return pd.DataFrame(out, columns=["src", "blob"])

    sent = texts.groupBy("src").applyInPandas(gather, "part int, src int, blob binary")
    return sent.groupBy("part").applyInPandas(settle, "src int, blob binary")


def _windows_of(buf: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, start in ``buf``) of every window of phrases that begin at ``begin``."""
    owner = np.repeat(np.arange(len(begin)), count)
    return owner, np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(owner))


def _corpus_order(buf: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary's suffixes in order of their first MATCH bytes, and a number for each run of equal ones."""
    padded = np.concatenate([buf, np.zeros(8 * _WORDS, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = []
    for k in range(_WORDS):
        w = np.ascontiguousarray(wide[start + 8 * k]).view(">u8").ravel().astype(np.uint64)
        if 8 * (k + 1) > MATCH:
            w &= ~np.uint64(0) << np.uint64(8 * (8 * (k + 1) - MATCH))
        words.append(w)
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    return order, np.cumsum(new) - 1


def _marks(texts: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    """(src, blob): (number of the text, first byte, end) of what is to go, by bucket."""

    def send(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(pdf):
            return pd.DataFrame({k: [] for k in ("part", "src", "blob")})
        got = [_unpack(b) for b in known["blob"]]
        keys, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        cols, bufs = [], []
        for k, doc_id, _, text in _stored(pdf):
            key, first, count = phrases(text)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            use = np.flatnonzero(keys[at] == key)
            if len(use):
                salts = -(-n[at[use]] // CROWD)
                salt = int(mix(np.array([doc_id], np.int64).view(np.uint64))[0] >> np.uint64(8)) % salts
                cols.append((key[use], salt, salts > 1, np.full(len(use), doc_id), np.full(len(use), k), first[use], count[use]))
                bufs += [text[a : a + c + MATCH - 1] for a, c in zip(first[use].tolist(), count[use].tolist(), strict=True)]
        if not cols:
            return pd.DataFrame({k: [] for k in ("part", "src", "blob")})
        key, salt, hot, doc, who, first, count = (np.concatenate(c) for c in zip(*cols, strict=True))
        out = []
        for part, rows in _split(mix(key + salt.astype(np.uint64) * np.uint64(_BASE)), parts):
            rows = rows[np.argsort(key[rows], kind="stable")]
            out.append((part, int(pdf["src"].iloc[0]), _pack(key[rows], salt[rows].astype("<u4"), hot[rows], doc[rows], who[rows].astype("<u4"), first[rows].astype("<u4"), count[rows].astype("u1"), b"".join(bufs[i] for i in rows))))
        return pd.DataFrame(out, columns=["part", "src", "blob"])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(b) for b in pdf["blob"]]
        src = np.repeat(pdf["src"].to_numpy(), [len(g[0]) for g in got])
        key, salt, hot, doc, who, first, count = (np.concatenate([g[i] for g in got]) for i in range(7))
        first, count = first.astype(np.int64), count.astype(np.int64)
        text = b"".join(g[7] for g in got)
        size = count + MATCH - 1
        begin = np.cumsum(size) - size
        # the dictionary: distinct phrases, each with the least document that has it
        names: dict = {}
        phrase = np.fromiter((names.setdefault((k, s, text[b : b + z]), len(names)) for k, s, b, z in zip(key.tolist(), salt.tolist(), begin.tolist(), size.tolist(), strict=True)), np.int64, len(key))
        where = np.zeros(len(names), np.int64)
        where[phrase[::-1]] = np.arange(len(key))[::-1]
        least = np.full(len(names), (1 << 63) - 1)
        np.minimum.at(least, phrase, doc)
        buf = np.frombuffer(text, np.uint8)
        owner, start = _windows_of(buf, begin[where], count[where])
        order, run = _corpus_order(buf, start)
        # windows of one text have one trigger; those of other salts are other groups
        group = np.empty(len(order), np.int64)
        group[order] = run
        _, group = np.unique(group * (int(salt.max()) + 1) + salt[where][owner], return_inverse=True)
        lowest = np.full(group.max() + 1, (1 << 63) - 1)
        np.minimum.at(lowest, group, least[owner])
        lowest = lowest[group]
        shift = np.cumsum(count[where]) - count[where]
        occ, place = _windows_of(buf, shift[phrase], count)
        byte = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(occ))
        gone = lowest[place] < doc[occ]
        out = []
        o = occ[gone]
        b = byte[gone]
        if len(o):
            cut = np.concatenate([[True], (o[1:] != o[:-1]) | (b[1:] != b[:-1] + 1)])
            s = np.flatnonzero(cut)
            e = np.append(s[1:], len(o)) - 1
            which, lo, hi = o[s], b[s], b[e] + MATCH
            by = np.argsort(src[which], kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(src[which][by])) + 1):
                out.append((int(src[which[rows[0]]]), _pack(who[which[rows]], lo[rows], hi[rows]), None))
        # of a crowded trigger one document stands for each window here; it meets those of the other salted groups
        open_ = np.flatnonzero(~gone & hot[occ] & (lowest[place] == doc[occ]))
        if len(open_):
            windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, MATCH)[start[place[open_]]]).view(f"V{MATCH}").ravel()
            name = np.array([hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in windows], "V16")
            for to, rows in _split(name.view("<u8")[::2].copy(), parts):
                out.append((to, None, _pack(name[rows], doc[occ[open_[rows]]], who[occ[open_[rows]]], byte[open_[rows]], src[occ[open_[rows]]])))
        return pd.DataFrame(out, columns=["src", "blob", "open"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        name, doc, who, byte, src = (np.concatenate(c) for c in zip(*(_unpack(b) for b in pdf["open"]), strict=True))
        group = np.unique(name, return_inverse=True)[1]
        least = np.full(group.max() + 1, (1 << 63) - 1)
        np.minimum.at(least, group, doc)
        late = np.flatnonzero(least[group] < doc)
        late = late[np.argsort(src[late], kind="stable")]
        out = [(int(src[rows[0]]), _pack(who[rows], byte[rows], byte[rows] + MATCH)) for rows in np.split(late, np.flatnonzero(np.diff(src[late])) + 1) if len(rows)]
        return pd.DataFrame(out, columns=["src", "blob"])

    sent = texts.groupBy("src").cogroup(shared.groupBy("src")).applyInPandas(send, "part int, src int, blob binary")
    found = sent.groupBy("part").applyInPandas(settle, "src int, blob binary, open binary")
    found = materialise(found.hint("rebalance"), "marks")
    late = found.where("open IS NOT NULL").groupBy("src").applyInPandas(meet, "src int, blob binary")
    return found.where("blob IS NOT NULL").select("src", "blob").union(late)


def whole(text: bytes, gone: np.ndarray) -> str:
    """What is left, without the characters of which a part is gone."""
    begin = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # of each character
    torn = np.add.reduceat(gone, begin) > 0 if len(begin) else gone
    gone = np.repeat(torn, np.diff(np.append(begin, len(text))))
    return np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "replace")


def _cut(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """digest, least doc_id, n_removed, n_spans, kept_sha256, kept (text, null if whole) of every distinct text."""

    def cut(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        who, lo, hi = [], [], []
        for blob in known["blob"] if len(known) else []:
            w, a, b = _unpack(blob)
            who.append(w), lo.append(a), hi.append(b)
        who, lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (who, lo, hi))
        order = np.argsort(who, kind="stable")
        who, lo, hi = who[order], lo[order], hi[order]
        out = []
        for k, doc_id, digest, text in _stored(pdf):
            a, b = np.searchsorted(who, k, "left"), np.searchsorted(who, k, "right")
            gone = np.zeros(len(text) + 1, np.int64)
            np.add.at(gone, lo[a:b], 1)
            np.add.at(gone, hi[a:b], -1)
            gone = np.cumsum(gone)[:-1] > 0
            spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            out.append((digest, doc_id, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), whole(text, gone) if spans else None))
        return pd.DataFrame(out, columns=["digest", "least", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.groupBy("src").cogroup(marks.groupBy("src")).applyInPandas(cut, "digest binary, least long, n_removed long, n_spans long, kept_sha256 string, kept string")


def _results(documents: DataFrame) -> DataFrame:
    texts, parts = _store(documents)
    shared = materialise(_shared_triggers(texts, parts).hint("rebalance"), "triggers")
    return _cut(texts, _marks(texts, shared, parts))


def repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each document."""
    found = _results(documents).drop("kept")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.md5("text")).alias("digest"))
    out = rows.join(found, "digest", "left")
    copy = (_key() > F.col("least")) & (F.col("n_bytes") >= MATCH)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.sha2(F.lit(""), 256))).alias("kept_sha256"),
    )


def remove_repeats(documents: DataFrame, count_column: str = "n_chars") -> DataFrame:
    """The documents, all columns, ``text`` without repeated passages; torn characters at a cut go, too."""
    same, least, kept = (unused(documents, c) for c in ("same", "least", "kept"))
    found = _results(documents).select(F.col("digest").alias(same), F.col("least").alias(least), F.col("kept").alias(kept))
    out = documents.withColumn(same, F.unhex(F.md5("text"))).join(found, same, "left")
    copy = (_key() > F.col(least)) & (F.octet_length("text") >= MATCH)
    out = out.withColumn("text", F.when(copy, F.lit("")).otherwise(F.coalesce(kept, "text")))
    if count_column in documents.columns:
        out = out.withColumn(count_column, F.char_length("text").cast(documents.schema[count_column].dataType))
    return out.select(*documents.columns)


def op6_passages(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
