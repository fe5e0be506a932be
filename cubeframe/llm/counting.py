"""Edit-aware token counts.

A document is a row of pre-tokens with a segment tree over their characters and tokens. An edit descends the tree to
the pre-tokens it touches, re-cuts these with their neighbours until the old cut is met again, encodes only pre-tokens
that are new, and updates the sums above them: new pre-tokens are dealt to the leaves that held the old ones, so the
tree keeps its shape; it is built anew (sums only, nothing is encoded) when a leaf has grown to ``FULL``. The count then
is the tree's root.

:func:`trees` gives each document's tree as a column (compressed lengths and counts of the leaves' pre-tokens) that can
be stored; :func:`edited` applies edits to stored trees and gives the new trees, so that later edits start from there.

Defined results: null counts as empty, with no tokens; edits are clipped to the text, null bounds are 0 and the end;
rows with equal doc_id are counted each for itself; other columns are ignored by :func:`counted` and kept by
:func:`trees` and :func:`edited`; an empty table gives no rows.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import unused

#: Pre-tokens in a leaf of a new tree, and in one that is too full.
LEAF, FULL = 32, 256


class Vocabulary:
    """Numbers of tokens of pre-tokens; those seen before are not encoded again."""

    def __init__(self, path: str, most: int = 1_000_000):
        import public_tokenizers
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pattern, self.known, self.most = Tokenizer.from_file(path), regex.compile(public_tokenizers.PATTERN), {}, most
        self.tokenizer.encode_special_tokens = True

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def counts(self, parts: list[str]) -> list[int]:
        if len(self.known) > self.most:
            self.known.clear()
        found = list(map(self.known.get, parts))
        if None not in found:
            return found
        new = list({p for p, n in zip(parts, found, strict=True) if n is None})
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.known[p] = len(e)
        return [self.known[p] for p in parts]


class Counted:
    """A text's pre-tokens in leaves, and sums (characters, tokens) over a binary tree of the leaves."""

    def __init__(self, text: str, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        parts = vocabulary.cut(text)
        self.recounted = len(parts)
        self._deal(parts, vocabulary.counts(parts))

    def _deal(self, parts: list[str], counts: list[int]) -> None:
        self.leaves = [(parts[a : a + LEAF], counts[a : a + LEAF]) for a in range(0, len(parts), LEAF)] or [([], [])]
        self._build()

    def stored(self) -> bytes:
        """The tree without its text."""
        sizes = np.array([len(p) for p, _ in self.leaves], "<u4")
        lengths = np.array([len(x) for p, _ in self.leaves for x in p], "<u4")
        return _packed(sizes, lengths, np.array([n for _, c in self.leaves for n in c], "<u4"))

    @classmethod
    def restored(cls, text: str, tree: bytes, vocabulary: Vocabulary) -> Counted:
        """The tree of ``text`` as it was stored; nothing is cut or encoded."""
        import zstandard

        self = cls.__new__(cls)
        self.vocabulary, self.recounted = vocabulary, 0
        data = np.frombuffer(zstandard.decompress(tree), np.uint8)
        n = int(data[:4].view("<u4")[0])
        sizes = data[4 : 4 + 4 * n].view("<u4").tolist()
        planes = data[4 + 4 * n :].reshape(2, 4, -1)
        lengths, counts = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
        stops, bounds = np.cumsum(lengths, dtype=np.int64), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.leaves = _Leaves(text, np.concatenate([[0], stops]), counts, bounds)
        chars, tokens = (np.concatenate([[0], np.cumsum(v, dtype=np.int64)])[bounds] for v in (lengths, counts))
        self._build(list(zip(np.diff(chars).tolist(), np.diff(tokens).tolist(), strict=True)))
        return self

    def _build(self, sums: list[tuple[int, int]] | None = None) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = [(0, 0)] * (2 * self.width)
        self.sums[self.width : self.width + len(self.leaves)] = list(map(self._sum, self.leaves)) if sums is None else sums
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self._above(k)

    @staticmethod
    def _sum(leaf) -> tuple[int, int]:
        return sum(map(len, leaf[0])), sum(leaf[1])

    def _above(self, k: int) -> tuple[int, int]:
        (a, b), (c, d) = self.sums[2 * k], self.sums[2 * k + 1]
        return a + c, b + d

    @property
    def length(self) -> int:
        return self.sums[1][0]

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def text(self) -> str:
        return "".join("".join(parts) for parts, _ in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds that character, and the character at which it begins."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            if place >= before + self.sums[k][0]:
                before += self.sums[k][0]
                k += 1
        return min(k - self.width, len(self.leaves) - 1), before if k - self.width < len(self.leaves) else before - self.sums[self.width + len(self.leaves) - 1][0]

    def edit(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` up to ``end``."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, begin = self._leaf_at(max(start - 1, 0))
        last, at = self._leaf_at(end)
        if first:  # a cut may depend on the leaf before: it is taken as context
            first -= 1
            begin -= self.sums[self.width + first][0]
        stop = at + self.sums[self.width + last][0]
        head = "".join("".join(p) for p, _ in self.leaves[first : last + 1])
        body = head[: start - begin] + new + head[end - begin :]
        while True:  # go on until the new cut ends where the old one does
            known = sum(map(len, self.leaves[last][0]))
            after = self.leaves[last + 1] if last + 1 < len(self.leaves) else None
            follow = "".join(after[0]) if after else ""
            parts, size, keep = self.vocabulary.cut(body + follow), 0, 0
            while keep < len(parts) and size < len(body):
                size += len(parts[keep])
                keep += 1
            if size == len(body) and (after is None or parts[keep:] [: len(after[0]) - 2] == after[0][: max(0, len(after[0]) - 2)]):
                parts = parts[:keep]
                break
            if after is None:
                break
            last, body, stop = last + 1, body + follow, stop + known
        counts = self.vocabulary.counts(parts)
        self.recounted += len(parts)
        here = last - first + 1
        each = -(-len(parts) // here)
        for k in range(here):
            self.leaves[first + k] = (parts[k * each : (k + 1) * each], counts[k * each : (k + 1) * each])
        if each >= FULL:
            self._deal([x for p, _ in self.leaves for x in p], [n for _, c in self.leaves for n in c])
            return
        above = set()
        for k in range(first, last + 1):
            self.sums[self.width + k] = self._sum(self.leaves[k])
            above.add((self.width + k) // 2)
        while above and above != {0}:
            for k in above:
                self.sums[k] = self._above(k)
            above = {k // 2 for k in above}


class _Leaves(list):
    """Leaves of a stored tree; one is cut from the text when it is asked for."""

    def __init__(self, text: str, at: np.ndarray, counts: np.ndarray, bounds: np.ndarray):
        super().__init__([None] * (len(bounds) - 1))
        self.of = text, at, counts, bounds

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(len(self)))]
        leaf = super().__getitem__(k)
        if leaf is None:
            text, at, counts, bounds = self.of
            a, b = int(bounds[k]), int(bounds[k + 1])
            stops = at[a : b + 1].tolist()
            leaf = self[k] = ([text[p:q] for p, q in zip(stops, stops[1:], strict=False)], counts[a:b].tolist())
        return leaf

    def __iter__(self):
        return (self[k] for k in range(len(self)))


def _bytes_of(values: np.ndarray) -> np.ndarray:
    """The first bytes of all values, then the second ones and so on: three of four are nearly always 0."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T)


def _packed(sizes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(b"".join(x.tobytes() for x in (np.array([len(sizes)], "<u4"), sizes, _bytes_of(lengths), _bytes_of(counts))), 1)


def new_tree(text: str, words: Vocabulary) -> tuple[bytes, int]:
    """The stored tree of a text and its number of tokens, as of ``Counted``; sums follow when it is restored."""
    parts = words.cut(text)
    lengths, counts = np.fromiter(map(len, parts), "<u4", len(parts)), np.array(words.counts(parts), "<u4")
    full, rest = divmod(len(parts), LEAF)
    sizes = np.array([LEAF] * full + [rest] * (rest > 0 or not full), "<u4")
    return _packed(sizes, lengths, counts), int(counts.sum(dtype=np.int64))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, so that its later tasks find the words of its earlier ones."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


EDITS = "array<struct<start int, end int, new string>>"


def _changed(doc: Counted, changes) -> None:
    for e in changes if changes is not None else []:
        doc.edit(e["start"] or 0, doc.length if e["end"] is None else e["end"], e["new"] or "")


def trees(documents: DataFrame, tokenizer: str) -> DataFrame:
    """The documents, all columns, with tree (binary) and n_tokens."""
    tree = unused(documents, "made")

    @F.pandas_udf("tree binary, n_tokens long")
    def of(text: pd.Series) -> pd.DataFrame:
        from cubeframe.llm import counting  # the module itself: what is sent with the function would be a copy

        words = counting.vocabulary(tokenizer)
        return pd.DataFrame([counting.new_tree(t or "", words) for t in text], columns=["tree", "n_tokens"])

    keep = [c for c in documents.columns if c.lower() not in ("tree", "n_tokens")]
    return documents.withColumn(tree, of("text")).select(*keep, f"{tree}.tree", f"{tree}.n_tokens")


def edited(stored: DataFrame, tokenizer: str, counts_only: bool = False) -> DataFrame:
    """``stored`` (text, tree, n_tokens and others as of :func:`trees`, edits) with text, tree and n_tokens as the edits leave them, and ``recounted``.

    ``counts_only``: ``edited_chars`` in the place of the text and the tree.
    """
    found = unused(stored, "found")

    names = ["edited_chars", "n_tokens", "recounted"] if counts_only else ["text", "tree", "n_tokens", "recounted"]

    @F.pandas_udf("edited_chars long, n_tokens long, recounted long" if counts_only else "text string, tree binary, n_tokens long, recounted long")
    def of(text: pd.Series, tree: pd.Series, edits: pd.Series) -> pd.DataFrame:
        from cubeframe.llm import counting

        out = []
        for t, blob, changes in zip(text, tree, edits, strict=True):
            doc = counting.Counted.restored(t or "", blob, counting.vocabulary(tokenizer))
            counting._changed(doc, changes)
            out.append((doc.length, doc.tokens, doc.recounted) if counts_only else (doc.text(), doc.stored(), doc.tokens, doc.recounted))
        return pd.DataFrame(out, columns=names)

    keep = [c for c in stored.columns if c.lower() not in ("text", "tree", "edits", *names)]
    return stored.withColumn(found, of("text", "tree", "edits")).select(*keep, f"{found}.*")


def counted(documents: DataFrame, edits: DataFrame | None, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, edited_tokens, edited_chars, recounted (pre-tokens cut again by the edits).

    ``documents``: doc_id, text, edits array<struct<start int, end int, new string>> in the order in which they apply,
    or ``edits`` apart: doc_id, edits.
    """
    rows = documents if edits is None else documents.select("doc_id", "text").join(edits.select("doc_id", "edits"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "edits")

    def of(batches):
        from cubeframe.llm import counting  # the module itself: what is sent with the function would be a copy

        words = counting.vocabulary(tokenizer)
        for pdf in batches:
            out = []
            for doc_id, text, changes in zip(pdf["doc_id"], pdf["text"], pdf["edits"], strict=True):
                doc = counting.Counted(text, words)
                before, parts = doc.tokens, doc.recounted
                counting._changed(doc, changes)
                out.append((doc_id, before, parts, doc.tokens, doc.length, doc.recounted - parts))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_pretokens", "edited_tokens", "edited_chars", "recounted"])

    out = rows.mapInPandas(of, "doc_id string, n_tokens long, n_pretokens long, edited_tokens long, edited_chars long, recounted long")
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Trees of all documents, each with three edits: a word put in the middle, a stretch cut out at a quarter, an end added."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.char_length("text"), F.lit(0))
    edit = lambda a, b, new: F.struct(F.floor(a).cast("int").alias("start"), F.floor(b).cast("int").alias("end"), F.lit(new).alias("new"))
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    made = trees(docs, path).withColumn("before", F.col("n_tokens"))
    edits = F.array(edit(n / 2, n / 2, " inserted"), edit(n / 4, n / 4 + 12, ""), edit(n + 9, n + 9, " The end."))
    out = edited(made.withColumn("edits", edits), path, counts_only=True)
    return out.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("edited_tokens"), "edited_chars", "recounted")
