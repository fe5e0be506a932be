"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Executors tokenize and cut; only the number of pieces of each length (at most ``capacity`` rows) reaches the driver,
which plans bins for lengths, not for documents: sets that provably dominate all others are fixed first, the rest goes
best-fit by falling length. Each piece then finds its place from its rank among the pieces of its length. Ranks are
counted within salted groups, so that a hot length is no hot task.

Defined results: null text counts as empty (one piece: the end id); rows with equal doc_id are packed each for
itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import codecs
import os
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cubeframe.llm.common import materialise

CAPACITY, END_ID = 4096, 1
#: Text for which the word cache does not promise the library's own result: it goes through the library whole.
UNUSUAL = "[\x1c-\x1f\x85ɐ-‏ -₫₭-\U0010ffff]|<\\|"
CONTROLS = "\x1c\x1d\x1e\x1f\x85"
#: Marks that end many a word; a run of them is a pre-token of its own after letters (with apostrophes some are not).
TAILS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The character that stands for each byte in the vocabulary; a space stays one.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = "".join(" " if b == 32 else chr(b if b in _OWN else 256 + b - sum(k < b for k in _OWN)) for b in range(256))
#: Words encoded in one call, and characters of text whose new words are learnt together.
CHUNK, STRETCH = 200, 100_000
#: Words that a Python worker keeps (about 200 bytes each, long after its task is over), and their characters for each.
KNOWN, WIDTH = 200_000, 32


class Encoder:
    """Texts to little-endian 32-bit ids; stretches between white space that were seen before are not encoded again.

    When too many are kept, those stay that came up again since the last time.

    A new word of letters only is one pre-token, so that many of them are encoded in one call, set apart by spaces:
    a word's last token, and no other, has the vocabulary's word-end mark.
    """

    def __init__(self, path: str, most: int = KNOWN):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.known, self.most, self.characters = Tokenizer.from_file(path), {}, most, 0
        self.again: set[str] = set()
        self.unusual = regex.compile(UNUSUAL).search
        self.letters = Tokenizer.from_file(path)  # for lower-case words of letters
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # what stands for each byte is put in by ``learn``
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def odd(self, text: str) -> bool:
        if "<|" in text or any(c in text for c in CONTROLS):
            return True
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return bool(self.unusual(text))

    def learn(self, words: set[str]) -> None:
        known, bases, tailed, odd = self.known, set(), [], []
        for w in words:
            b = w.rstrip(TAILS)
            if not b.isalpha():
                odd.append(w)
                continue
            bases.add(b)
            if b is not w:
                tailed.append((w, b, w[len(b) :]))
        odd += {tail for _, _, tail in tailed}.difference(known)
        new = list(bases.difference(known))
        for at in range(0, len(new), CHUNK):
            some = new[at : at + CHUNK]
            spelt = codecs.charmap_decode(" ".join(some).encode(), "strict", BYTES)[0]
            ids = np.frombuffer(array("I", self.letters.encode_batch_fast([spelt], add_special_tokens=False)[0].ids), "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(some) or stops[-1] != len(ids):
                odd += some
                continue
            stops = [4 * k for k in stops]
            known.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *stops], stops)), strict=True))
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()
        for w, b, tail in tailed:
            known[w] = known[b] + known[tail]

    def __call__(self, text: str) -> bytes:
        return next(self.many([text]))

    def many(self, texts):
        """The ids of each text; the new words of about ``STRETCH`` characters are learnt together."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > STRETCH:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def forget(self) -> None:
        """Keep the words that came up again, or none where they are too many themselves."""
        self.characters = sum(map(len, self.again))
        if 4 * len(self.again) > 3 * self.most or 4 * self.characters > 3 * WIDTH * self.most:
            self.again, self.characters = set(), 0
        self.known, self.again = {w: self.known[w] for w in self.again}, set()

    def _some(self, texts: list[str]):
        if len(self.known) > self.most or self.characters > WIDTH * self.most:
            self.forget()
        parts = [None if self.odd(t) else t.lower().split() for t in texts]
        words: set[str] = set()
        for p in parts:
            words.update(p or ())
        rest = words.difference(self.again)
        new = rest.difference(self.known)
        self.again |= rest - new
        self.learn(new)
        self.characters += sum(map(len, new))
        get = self.known.__getitem__
        for text, p in zip(texts, parts, strict=True):
            if p is None:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join(map(get, p))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that its later tasks find the words of its earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and ``end_id``, cut where longer than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        from cubeframe.llm import packing  # the module itself: what is sent with the function would be a copy

        encode = packing.encoder(tokenizer)
        for pdf in batches:
            out = []
            for doc_id, ids in zip(pdf["doc_id"].tolist(), encode.many(t or "" for t in pdf["text"]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long").withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of bins, [(length, how many of it in each bin)]) for ``counts`` items of each length."""
    left = {s: n for s, n in counts.items() if n}
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def fix(n: int, *sizes: int) -> None:
        done.append((n, [(s, 1) for s in sizes]))
        for s in sizes:
            left[s] -= n
            if not left[s]:
                del left[s]

    changed = True
    while changed and left:
        changed = False
        for j in sorted(left, reverse=True):
            if j not in left:
                continue
            room, sizes = capacity - j, np.array(sorted(left))
            if not room:
                fix(left[j], j)
                changed = True
                continue
            fits = sizes[(sizes <= room) & ((sizes != j) | (left[j] > 1))]
            if not len(fits):
                fix(left[j], j)
                changed = True
                continue
            k = int(fits[-1])
            few: list[int] = []
            for s in sizes[:3].tolist():  # the three least items besides one of length j
                few += [s] * min(3, left[s] - (s == j))
            few = few[:3]
            pair_only = len(few) < 2 or sum(few[:2]) > room
            if k != room and not pair_only:
                if len(few) > 2 and sum(few) <= room:
                    continue
                at = np.searchsorted(sizes, room - sizes, "right") - 1
                best = max((int(a + sizes[b]) for a, b in zip(sizes, at, strict=True) if b >= 0), default=0)
                if k < best:
                    continue
            fix(left[j] // 2 if j == k else min(left[j], left[k]), j, k)
            changed = True

    open_: dict[int, list[list]] = {}  # room -> classes of bins [n, [(length, k)]]
    rooms: list[int] = []

    def put(room: int, n: int, items: list) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([n, items])

    for s in sorted(left, reverse=True):
        n = left[s]
        while n and (at := bisect.bisect_left(rooms, s)) < len(rooms):
            room = rooms[at]
            bins, items = open_[room].pop()
            if not open_[room]:
                del open_[room]
                del rooms[at]
            each = room // s
            full = min(bins, n // each)
            if full:
                put(room - each * s, full, [*items, (s, each)])
                n -= full * each
            if bins > full and n and n < each:
                put(room - n * s, 1, [*items, (s, n)])
                n, full = 0, full + 1
            if bins > full:
                put(room, bins - full, items)
        if n:
            each = capacity // s
            if n // each:
                put(capacity - each * s, n // each, [(s, each)])
            if n % each:
                put(capacity - n % each * s, 1, [(s, n % each)])
    return done + [(n, items) for classes in open_.values() for n, items in classes]


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks within a length: from rank ``lo`` on, sequence ``seq`` + rank // k, at offset ``at``."""
    taken: dict[int, int] = {}
    rows, seq = [], 0
    for n, items in bins:
        at = 0
        for s, k in items:
            rows.append((s, taken.get(s, 0), seq, k, at))
            taken[s] = taken.get(s, 0) + n * k
            at += s * k
        seq += n
    rows.sort()
    return dict(zip(("size", "lo", "seq", "k", "at"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(documents, tokenizer, capacity, end_id), "pieces")
    salts = int(min(1 << 16, max(64, cut.count() // 2000)))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)))
    counted = materialise(cut.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("n")).collect()}  # one row for each length
    found = slots(plan(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("_rank", rank).join(offsets, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    #: Ranges are found by one key that holds length and rank.
    wide = np.int64(1) << 48
    keys = found["size"] * wide + found["lo"] if len(found["size"]) else np.zeros(0, np.int64)

    def place(batches):
        for pdf in batches:
            i = np.searchsorted(keys, pdf["length"].to_numpy() * wide + pdf["_rank"].to_numpy(), "right") - 1
            r = pdf.pop("_rank").to_numpy() - found["lo"][i]
            pdf["sequence_id"] = found["seq"][i] + r // found["k"][i]
            pdf["offset"] = found["at"][i] + r % found["k"][i] * found["size"][i]
            yield pdf

    kind = documents.schema["doc_id"].dataType.simpleString()
    out = ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op4_pack(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("word_bpe_49k.json")))
