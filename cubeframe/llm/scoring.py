"""Masked pseudo-likelihood scores from a bidirectional window network, trained in numpy.

A token is predicted from the two tokens on each side of it: their embeddings, weighted by place, are added and
squashed, and two softmax layers give the token's group and its place in the group. The vocabulary is a table of all
distinct words (as 64-bit hashes) and their counts in the shared folder. The network has about as many tokens as the
square root of the distinct words: one for each of the most frequent, and classes that all other words share by hash.
A word's probability is its token's times its share of the token's occurrences, so over all words it adds up to 1.
Training passes once over all tokens of all documents, in ``ROUNDS`` rounds that each take their share of the documents
by a hash of the text: every round trains a copy of the network on each partition and averages the copies, weighted by
tokens, in a shuffle. A document's score is the sum of its words' conditional log-probabilities.

Defined results: null texts and texts without words have no tokens, log-probability 0 and a null mean; rows with equal
doc_id are scored each for itself; a word that the vocabulary lacks counts as seen once; other columns are ignored; on
an empty table the network stays as it began.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import materialise

GROUPS, DIM, SIDE = 32, 16, 2
VOCABULARY = GROUPS * GROUPS
#: So many of the tokens, as a part of all, are classes of the words that have none of their own.
RARE = 16
#: The counts of so many of the most frequent words, at most, are broadcast; those of all others are joined.
KNOWN = 1 << 21
BATCH, RATE, ROUNDS = 2048, 0.08, 2
#: Characters of text that are taken together.
STRETCH = 1_000_000


class Words(dict):
    """word -> a number; ``hashes`` has the words' 64-bit hashes by number. Cleared between texts when it grows large."""

    def __init__(self, most: int = 600_000):
        self.most, self.fresh, self.hashes = most, [], np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self.fresh.append(h - (1 << 64) if h >> 63 else h)
        self[word] = n = len(self)
        return n

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of the texts, end to end, and each text's number of words."""
        if len(self) > self.most:
            self.clear()
            self.hashes = self.hashes[:0]
        parts = [(t or "").lower().split() for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        self.hashes = np.concatenate([self.hashes, np.array(self.fresh, np.int64)])
        self.fresh.clear()
        return out, sizes

    def hashed(self, text: str | None) -> np.ndarray:
        numbers, _ = self.of([text])
        return self.hashes[numbers]


def stretches(batches):
    """Lists of rows (tuples, the text last) of about STRETCH characters."""
    held, size = [], 0
    for pdf in batches:
        for row in zip(*(pdf[c].tolist() for c in pdf.columns), strict=True):
            held.append(row)
            size += len(row[-1] or "")
            if size > STRETCH:
                yield held
                held, size = [], 0
    if held:
        yield held


class Vocabulary:
    """Word hash -> token, and a word's share of its token; ``counts`` has every distinct word, ``known`` the frequent."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        words, self.least = 0, None  # known are the words counted ``least`` times or more
        several = sorted(((r[0], r[1]) for r in counts.groupBy("n").agg(F.count(F.lit(1))).collect()), reverse=True)
        distinct = sum(k for _, k in several)
        self.groups = max(GROUPS, int(np.ceil(distinct**0.25)))
        self.rare = self.groups**2 // RARE
        for n, k in several:
            if (words := words + k) > KNOWN:
                break
            self.least = n
        known = counts.where(F.col("n") >= self.least if self.least else F.lit(False)).toArrow().sort_by("hash")
        self.known, n = known["hash"].to_numpy(), known["n"].to_numpy()
        first = np.lexsort((self.known, -n))[: self.groups**2 - self.rare]
        self.token = self.groups**2 - self.rare + self.known % self.rare
        self.token[first] = np.arange(len(first))
        self.head = self.known[np.sort(first)]
        self.head_token = self.token[np.sort(first)]
        self.totals = np.zeros(self.rare, np.int64)
        for r in counts.groupBy(F.pmod("hash", F.lit(self.rare)).alias("class")).agg(F.sum("n").alias("n")).collect():  # a row for each class
            self.totals[r["class"]] = r["n"]
        np.subtract.at(self.totals, self.known[first] % self.rare, n[first])
        self.share = np.log(n / np.maximum(1, self.totals)[self.known % self.rare]).astype(np.float32)
        self.share[first] = 0
        self.once = -np.log(np.maximum(1, self.totals))
        #: Words that are not known were all counted once, so that nothing need be joined.
        self.settled = not distinct or (self.least is not None and self.least <= 2)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "counts"}

    @staticmethod
    def _find(table: np.ndarray, hashes: np.ndarray):
        at = np.searchsorted(table, hashes)
        at[at == len(table)] = 0
        return at, table[at] == hashes if len(table) else np.zeros(len(hashes), bool)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        out = self.groups**2 - self.rare + hashes % self.rare
        at, own = self._find(self.head, hashes)
        out[own] = self.head_token[at[own]]
        return out

    def log_shares(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each word's share of its token, taken as seen once where it is not known; and which are known."""
        at, known = self._find(self.known, hashes)
        out = self.once[hashes % self.rare]
        out[known] = self.share[at[known]]
        return out, known

    def others(self) -> DataFrame:
        """hash, more: the words that are not known, with what their share's logarithm has over that of a word seen once."""
        rest = self.counts.where(F.col("n") < self.least) if self.least else self.counts
        return rest.select("hash", F.log("n").alias("more"))


def vocabulary(documents: DataFrame) -> Vocabulary:
    """The counts of all words of all documents, in the shared folder, and the tokens they give."""

    def count(batches):
        words, held, size = Words(), [], 0
        seen, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merge():
            nonlocal seen, n
            seen, at = np.unique(np.concatenate([seen, *(h for h, _ in held)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, *(k for _, k in held)]), len(seen)).astype(np.int64)
            held.clear()

        for rows in stretches(batches):
            got = np.bincount(words.of([r[-1] for r in rows])[0])
            at = np.flatnonzero(got)
            held.append((words.hashes[at], got[at]))
            size += len(at)
            if size > 1_000_000:
                merge()
                size = 0
                if len(seen) > 2_000_000:
                    yield pd.DataFrame({"hash": seen, "n": n})
                    seen, n = seen[:0], n[:0]
        merge()
        yield pd.DataFrame({"hash": seen, "n": n})

    rows = documents.select("text").mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return Vocabulary(materialise(rows, "vocabulary"))


def start(groups: int = GROUPS) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(17)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return {
        "embed": small(groups * groups + 1, DIM),  # the last token stands for "outside the text"
        "place": 1 + small(2 * SIDE, DIM),
        "hidden": np.zeros(DIM, np.float32),
        "out": small(2 * groups, DIM),  # a row for each group, then for each place in a group
        "group_bias": np.zeros(groups, np.float32),
        "member_bias": np.zeros((groups, groups), np.float32),
    }


def streams(tokens: np.ndarray, sizes: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' tokens end to end, with SIDE tokens "outside" around each, and where the tokens stand."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(tokens)) + SIDE * (owner + 1)
    flat = np.full(len(tokens) + SIDE * (len(sizes) + 1), outside, np.int64)
    flat[at] = tokens
    return flat, at


def forward(net: dict, flat: np.ndarray):
    """(embeddings, hidden layer, softmax numerators, their sums, log-probabilities) for all of ``flat`` but its ends.

    The layers have a row for each unit and a column for each token.
    """
    n, groups = len(flat) - 2 * SIDE, len(net["group_bias"])
    e, t = net["embed"][flat], flat[SIDE:-SIDE] % (groups * groups)  # what is outside a text predicts nothing of use
    pre = np.broadcast_to(net["hidden"], (n, DIM)).copy()
    for k, shift in enumerate(s for s in range(2 * SIDE + 1) if s != SIDE):
        pre += e[shift : shift + n] * net["place"][k]
    h = np.tanh(pre, out=pre)
    z = net["out"] @ h.T
    z[:groups] += net["group_bias"][:, None]
    z[groups:] += net["member_bias"][t // groups].T
    z = z.reshape(2, groups, n)
    if np.abs(net["out"]).sum(1).max() + max(net["group_bias"].max(), net["member_bias"].max()) > 80:  # else no exponential can overflow
        z -= z.max(1, keepdims=True)
    rows = np.arange(n)
    own = z[0, t // groups, rows] + z[1, t % groups, rows]
    np.exp(z, out=z)
    sums = z.sum(1)
    return e, h, z, sums, own - np.log(sums[0]) - np.log(sums[1])


def log_probabilities(net: dict, tokens: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """Of every token, given those beside it in its text."""
    sizes = np.array([len(tokens)]) if sizes is None else sizes
    flat, at = streams(tokens, sizes, len(net["embed"]) - 1)
    out = [forward(net, flat[a : a + BATCH + 2 * SIDE])[-1] for a in range(0, len(flat) - 2 * SIDE, BATCH)]
    return np.concatenate([*out, np.zeros(0)])[at - SIDE]


def step(net: dict, past: dict, flat: np.ndarray) -> None:
    """One AdaGrad step on the tokens of a stretch; its ends are context only."""
    n, groups = len(flat) - 2 * SIDE, len(net["group_bias"])
    e, h, z, sums, _ = forward(net, flat)
    t, rows = flat[SIDE:-SIDE], np.arange(n)
    inside = t < groups * groups
    if not inside.any():
        return
    t = t % (groups * groups)
    z *= (inside / np.float32(inside.sum()) / sums)[:, None].astype(np.float32)
    one = (inside / np.float32(inside.sum())).astype(np.float32)
    z[0, t // groups, rows] -= one
    z[1, t % groups, rows] -= one
    dz = z.reshape(2 * groups, n)
    dh = (dz.T @ net["out"]) * (1 - h * h)
    place, de = np.empty_like(net["place"]), np.zeros((len(flat), DIM), np.float32)
    for k, shift in enumerate(s for s in range(2 * SIDE + 1) if s != SIDE):
        place[k] = np.einsum("ij,ij->j", dh, e[shift : shift + n])
        de[shift : shift + n] += dh * net["place"][k]
    of = np.zeros((groups, n), np.float32)
    of[t // groups, rows] = 1
    for name, g in (("out", dz @ h), ("group_bias", z[0].sum(1)), ("member_bias", of @ z[1].T), ("hidden", dh.sum(0)), ("place", place)):
        past[name] += g * g
        net[name] -= np.float32(RATE) * g / np.sqrt(past[name])
    order = np.argsort(flat.astype(np.uint16) if groups < 256 else flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    g, at = np.add.reduceat(de[order], first, axis=0), flat[order[first]]
    past["embed"][at] += g * g
    net["embed"][at] -= np.float32(RATE) * g / np.sqrt(past["embed"][at])


def train(documents: DataFrame, token: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The network after one pass over all tokens of all documents, averaged ``rounds`` times."""
    spark, net = documents.sparkSession, start(token.groups)
    names = list(net)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((net, token))  # the known words, and parameters as the root of the distinct words

        def local(batches, shared=shared):
            own, token = shared.value
            own = {k: v.copy() for k, v in own.items()}
            past = {k: np.full(v.shape, 1e-6, np.float32) for k, v in own.items()}
            words, of, total = Words(), np.zeros(0, np.int64), 0
            for rows in stretches(batches):
                numbers, sizes = words.of([r[-1] for r in rows])
                if len(of) > len(words.hashes):
                    of = of[:0]
                of = np.concatenate([of, token[words.hashes[len(of) :]]])
                flat, _ = streams(of[numbers], sizes, len(own["embed"]) - 1)
                for at in range(0, len(flat) - 2 * SIDE, BATCH):
                    step(own, past, flat[at : at + BATCH + 2 * SIDE])
                total += len(numbers)
            if total:  # a row for each stretch of 1024 parameters
                flat = np.concatenate([own[k].ravel() for k in names]).astype(np.float64) * total
                yield pd.DataFrame({"copy": TaskContext.get().partitionId(), "part": np.arange(-(-len(flat) // 1024)), "n": float(total), "sums": [flat[a : a + 1024] for a in range(0, len(flat), 1024)]})

        turn = documents.select("text").where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k)
        sent = turn.mapInPandas(local, "copy int, part int, n double, sums array<double>")

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("copy", kind="stable")
            return pd.DataFrame({"copy": pdf["copy"].iloc[:1], "part": pdf["part"].iloc[:1], "n": [pdf["n"].sum()], "sums": [np.sum(np.stack(pdf["sums"]), 0)]})

        kind = sent.schema
        some = sent.groupBy("part", F.pmod("copy", F.lit(1024))).applyInPandas(add, kind)  # no group holds all copies
        got = some.groupBy("part").applyInPandas(add, kind).collect()  # the parameters
        if got:
            flat, at = np.concatenate([np.array(r["sums"]) / r["n"] for r in sorted(got, key=lambda r: r["part"])]), 0
            for name in names:
                net[name] = flat[at : at + net[name].size].reshape(net[name].shape).astype(np.float32)
                at += net[name].size
    return net


def scores(documents: DataFrame, net: dict, token: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood: one row for each document."""
    shared = documents.sparkSession.sparkContext.broadcast((net, token))

    def of(batches):
        net, token = shared.value
        words, row = Words(), TaskContext.get().partitionId() << 40
        tokens, shares, known = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        for rows in stretches(batches):
            numbers, sizes = words.of([r[-1] for r in rows])
            if len(tokens) > len(words.hashes):
                tokens, shares, known = tokens[:0], shares[:0], known[:0]
            new = words.hashes[len(tokens) :]
            share, seen = token.log_shares(new)
            tokens, shares, known = np.concatenate([tokens, token[new]]), np.concatenate([shares, share]), np.concatenate([known, seen])
            found = log_probabilities(net, tokens[numbers], sizes) + shares[numbers]
            owner = np.repeat(np.arange(len(rows)), sizes)
            yield pd.DataFrame({"row": row + np.arange(len(rows)), "doc_id": [r[0] for r in rows], "n_tokens": sizes, "log_likelihood": np.bincount(owner, found, len(rows)), "hash": row, "n": 0})
            if not token.settled and (out := ~known[numbers]).any():
                # a row for each word of a document that is to be joined; the document's own row has a key that no word need have
                pairs, n = np.unique(np.stack([owner[out], words.hashes[numbers[out]]]), axis=1, return_counts=True)
                yield pd.DataFrame({"row": row + pairs[0], "doc_id": None, "n_tokens": 0, "log_likelihood": 0.0, "hash": pairs[1], "n": n})
            row += len(rows)

    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = rows.mapInPandas(of, "row long, doc_id string, n_tokens long, log_likelihood double, hash long, n long")
    if not token.settled:
        out = out.join(token.others(), "hash", "left")
        total = F.sum(F.col("log_likelihood") + F.col("n") * F.coalesce("more", F.lit(0.0)))
        out = out.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), total.alias("log_likelihood"))
    out = out.select("doc_id", "n_tokens", "log_likelihood", F.expr("log_likelihood / nullif(n_tokens, 0)").alias("mean_log_likelihood"))
    return out.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def op2_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a network trained on all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token = vocabulary(docs)
    return scores(docs, train(docs, token), token)
