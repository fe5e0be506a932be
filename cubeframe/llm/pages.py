"""Main text of web pages: page structure plus a suffix array of each host's token streams.

All blocks of a host's pages, those of articles too, are set end to end, page after page; the suffix array of these
streams shows on how many pages each run of ``RUN`` tokens stands. A host's pages are taken in groups of about
``CROWD``, dealt by a hash, so that no host is one task. Groups of one host exchange the page counts of their runs, so
runs are counted over the whole host; a group keeps to itself what does not matter there, runs within articles on a
single one of its pages (a run on half of a host's pages stands on a single one of 256 once in 2**247 times). Blocks in menus, footers, adverts and the like go. Runs on half of a host's pages, and on
``COMMON`` at least, go everywhere, in articles too. Blocks outside articles also go where runs that stand outside the
articles of two pages cover half of them. What is left is the text.

Texts move once, compressed; those of hosts with several groups once more.

Defined results: null or empty html gives an empty text; broken mark-up is read as far as it goes; a null or odd url
is a host of its own name; repeated rows each get a row, and copies of one page (equal page_id, url and html) count
as one page; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import pickle
import re
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import WordHash, materialise, mix

CROWD, RUN, COMMON = 256, 6, 4
#: Groups of so many pages tell the others all of their runs.
FEW = 8
COLUMNS = ["page_id", "url", "text", "copies", "crowd", "host", "pages", "blob", "run", "n", "out"]
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select|title|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>|<[/!?]?[a-zA-Z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[/!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(.*?)/?>\Z", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = BLOCK - {"p"}
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form menu button dialog head".split())
MAIN = frozenset("article main".split())
#: Words that mark what is no part of an article, as any part of a class, id or role name ("site-footer").
BAD = frozenset(
    "advert adverts advertisement sponsored promo banner sidebar widget menu nav navbar navigation breadcrumb breadcrumbs masthead topbar footer cookie cookies consent gdpr popup modal newsletter subscribe signup comments comment commentlist respond replies disqus pagination pager toolbar".split()
)
#: Words that do so as a whole name only: as parts they name much else ("social-history", "ad-hoc").
BAD_ALONE = frozenset("ad ads adbox adslot header notice notices share sharing login copyright sponsor related recommended".split())
GOOD = frozenset("article main content post entry story".split())
INLINE = frozenset("html body b i em strong span a u s small sub sup code font abbr cite q mark time".split())


def names_of(attributes: str) -> list[str]:
    return [n.lower() for a in NAMES.findall(attributes) for n in "".join(a).split()]


def marked(names: list[str], words: frozenset, alone: frozenset = frozenset()) -> bool:
    return any(n in alone or not words.isdisjoint(re.split("[-_]+", n)) for n in names)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of each block in page order; kind 2: in an article, 1: undecided, 0: marked as something else."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []  # open elements, and what they make of what is in them: 0 out, 1 nothing, 2 main
    text: list[str] = []

    def kind() -> int:
        marks = [m for _, m in stack]
        return 0 if 0 in marks else 2 if 2 in marks else 1

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((joined, kind()))

    for m in TOKEN.finditer(page or ""):
        t = m[0]
        if t[0] != "<" or t == "<":
            text.append(t)
            continue
        tag = TAG.match(t) if m[1] is None else None
        if t.startswith("<![CDATA["):
            text.append(html.escape(t[9:-3]))
            continue
        if tag is None:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name == "br":
            text.append(" ")
        if name in BLOCK:
            flush()
        if closing:
            if stack and stack[-1][0] == name:
                stack.pop()
            elif any(n == name for n, _ in stack):
                while stack and stack.pop()[0] != name:
                    pass
        elif name not in VOID:
            if name == "p":
                while stack and stack[-1][0] not in HOLDERS and any(n == "p" for n, _ in stack):
                    stack.pop()
            names = names_of(tag[3]) if tag[3] else []
            mark = 1
            if name in MAIN:
                mark = 2
                stack[:] = [(n, 1 if k == 0 and n in OUT else k) for n, k in stack]  # an article ends a menu left open
            elif name in OUT or (name == "header" and all(m != 2 for _, m in stack)):
                mark = 0
            elif names and name not in INLINE and marked(names, BAD, BAD_ALONE):
                mark = 0
            elif names and name in ("div", "section", "td") and marked(names, GOOD):
                mark = 2
            stack.append((name, mark))
    flush()
    return out


class Runs:
    """The suffix array of all blocks of the pages, end to end, sorted by the first ``run`` tokens.

    Ranks of ever longer beginnings are sorted, as many in one key as it holds: at least two, as in prefix doubling.
    Suffixes that begin alike are one run: ``pages`` has the number of pages it stands on, ``out`` of those where it
    begins outside articles. A block shorter than ``run`` counts whole. ``pages``: (texts, kinds).

    A word is a number from 3 on; 1 and 2 are the marks before and after a block, 0 is what lies beyond its end.
    """

    def __init__(self, pages: list[tuple[list[str], list[int]]], run: int = RUN):
        split = [" ".join(texts).split(" ") for texts, _ in pages if texts]
        self.words, self.run = list(set().union(*split)), run
        number = dict(zip(self.words, count(3)))
        self.sizes = np.array([t.count(" ") + 3 for texts, _ in pages for t in texts], np.int64)  # each between marks, so that short blocks are whole runs
        stops = np.cumsum(self.sizes)
        self.begin, self.n = stops - self.sizes, int(self.sizes.sum())
        self.flat = flat = np.zeros(self.n, np.int64)
        flat[self.begin], flat[stops - 1] = 1, 2
        flat[flat == 0] = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, self.n - 2 * len(self.sizes))
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.end = end = stops[owner]
        rank, have, at, key = flat, 1, np.arange(self.n), flat
        while have < run:
            bits = int(rank.max(initial=1)).bit_length()
            key, reach = rank, have
            for _ in range(max(2, 63 // bits) - 1):
                nxt = min(reach, run - have)
                if reach < run:
                    key = (key << bits) | np.where(at + nxt < end, rank[np.minimum(at + nxt, self.n - 1)], 0)
                    reach = nxt + have
            if reach < run:
                rank = np.unique(key, return_inverse=True)[1] + 1
            have = reach
        starts = np.flatnonzero((at + run <= end) | (at == self.begin[owner]))
        starts = starts[np.argsort(key[starts], kind="stable")]  # the suffix array
        fresh = np.diff(key[starts], prepend=-1) != 0
        page = np.repeat(np.arange(len(pages)), np.array([len(texts) for texts, _ in pages], np.int64))[owner[starts]]
        kind = np.array([k for _, kinds in pages for k in kinds], np.int64)[owner[starts]]
        self.of, self.outside = np.cumsum(fresh) - 1, kind < 2
        self.first, self.starts, self.stops = starts[fresh], starts, np.minimum(starts + run, end[starts])
        self.pages, self.out = (self._counts(self.of[some], page[some]) for some in (slice(None), self.outside))

    def _counts(self, of: np.ndarray, page: np.ndarray) -> np.ndarray:
        """Of each run, on how many pages; a run's pages are in order."""
        other = (np.diff(of, prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0)
        return np.bincount(of[other], minlength=len(self.first))

    def keys(self) -> np.ndarray:
        """The runs' hashes, equal in all groups."""
        import xxhash

        hashes = np.array([0, 1, 2, *(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.words)], np.uint64)
        keys = np.zeros(len(self.first), np.uint64)
        end = self.end[self.first]
        for k in range(self.run):
            token = np.where(self.first + k < end, self.flat[np.minimum(self.first + k, self.n - 1)], 0)
            keys = mix(keys + hashes[token] + np.uint64(k))
        return keys

    def covered(self, starts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Which tokens lie in one of the runs that begin at ``starts`` (a mask), and how many of each block."""
        on = np.bincount(self.starts[starts], minlength=self.n + 1) - np.bincount(self.stops[starts], minlength=self.n + 1)
        on = np.cumsum(on)[: self.n] > 0
        total = np.cumsum(on)
        return on, (total[self.begin + self.sizes - 2] - total[self.begin]).tolist()


def kept(pages: list[tuple[list[str], list[int]]], runs: Runs, size: int) -> list[str]:
    """The text of each page of a host of ``size`` pages."""
    gone, often = runs.covered((runs.pages >= max(COMMON, -(-size // 2)))[runs.of])
    _, twice = runs.covered((runs.out >= 2)[runs.of] & runs.outside)
    blocks = zip(often, twice, runs.begin.tolist(), runs.sizes.tolist(), strict=True)
    out = []
    for texts, kinds in pages:
        some = []
        for t, kind, (many, again, begin, n) in zip(texts, kinds, blocks):
            if kind == 2 or (kind == 1 and 2 * again < n - 2):
                some.append(" ".join(w for w, g in zip(t.split(" "), gone[begin + 1 : begin + n - 1].tolist(), strict=True) if not g) if many else t)
        out.append("\n\n".join(t for t in some if t))
    return out


def _pack(some: dict) -> bytes:
    import zstandard

    return zstandard.compress(pickle.dumps(some, 5), 5)


def _unpack(blobs) -> dict:
    """Pages by key: (page_id, url, texts, kinds, how many copies), in an order that no shuffle changes."""
    import zstandard

    out: dict = {}
    for blob in blobs:
        for key, page in pickle.loads(zstandard.decompress(blob)).items():
            out[key] = (*page[:4], page[4] + out[key][4]) if key in out else page
    return dict(sorted(out.items()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page."""
    key = F.xxhash64("page_id", "url", "html").alias("key")
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")), F.lower("url"), F.lit("")).alias("host")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host, key)
    hosts = rows.groupBy("host").agg(F.countDistinct("key").alias("pages")).where(F.col("pages") > CROWD)  # at most a CROWD-th of the pages
    crowds = F.coalesce(F.ceil(F.col("pages") / CROWD), F.lit(1))
    crowd = F.xxhash64("host", F.pmod(F.xxhash64("key"), crowds)).alias("crowd")
    dealt = rows.join(F.broadcast(hosts), "host", "left").select("page_id", "url", "html", "host", "pages", "key", crowd)

    def parse(batches):
        """A row for each group of a batch's pages; of copies there is one."""
        for pdf in batches:
            for (crowd, host), some in pdf.groupby(["crowd", "host"], sort=False):
                copies = some["key"].value_counts()
                one = some.drop_duplicates("key")
                held = {}
                for page_id, url, page, k in zip(one["page_id"], one["url"], one["html"], one["key"].tolist(), strict=True):
                    b = blocks(page)
                    held[k] = (page_id, url, [t for t, _ in b], [m for _, m in b], int(copies[k]))
                yield pd.DataFrame({"crowd": [crowd], "host": [host], "pages": some["pages"].iloc[:1].to_numpy(), "blob": [_pack(held)]})

    def named(runs: Runs, host: str) -> np.ndarray:
        return mix(runs.keys() ^ np.uint64(WordHash()[host.encode("utf-8", "surrogatepass")])).view(np.int64)

    def result(found: dict, texts: list[str]) -> dict:
        return {"page_id": [p[0] for p in found.values()], "url": [p[1] for p in found.values()], "text": texts, "copies": [p[4] for p in found.values()]}

    def frame(columns: dict) -> pd.DataFrame:
        n = max(map(len, columns.values()), default=0)
        return pd.DataFrame({c: pd.Series(columns.get(c, [None] * n), dtype=object) for c in COLUMNS})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a host of one group the texts; else the pages as they are and the counts of the group's runs."""
        found, host, size = _unpack(pdf["blob"]), pdf["host"].iloc[0], pdf["pages"].iloc[0]
        read = [(p[2], p[3]) for p in found.values()]
        runs = Runs(read)
        if pd.isna(size):
            return frame(result(found, kept(read, runs, len(read))))
        told = (runs.pages > 1) | (runs.out > 0) | (len(read) <= FEW)
        n = runs.pages[told]
        rows = {"run": [None, *named(runs, host)[told].tolist()], "n": [None, *n.tolist()], "out": [None, *runs.out[told].tolist()]}
        return frame(rows | {"crowd": [int(pdf["crowd"].iloc[0])] * (len(n) + 1), "host": [host] + [None] * len(n), "pages": [int(size)] + [None] * len(n), "blob": [_pack(found)] + [None] * len(n)})

    def finish(pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"page_id": [], "url": [], "text": [], "copies": []})
        found, host = _unpack(pdf["blob"]), pdf["host"].iloc[0]
        read = [(p[2], p[3]) for p in found.values()]
        runs = Runs(read)
        at = pd.Index(shared["run"].to_numpy(np.int64)).get_indexer(named(runs, host))
        known = at >= 0
        for counts, column in ((runs.pages, "n"), (runs.out, "out")):
            counts[known] = shared[column].to_numpy(np.int64)[at[known]]
        return pd.DataFrame(result(found, kept(read, runs, int(pdf["pages"].iloc[0]))))

    parsed = dealt.mapInPandas(parse, "crowd long, host string, pages long, blob binary")
    done = materialise(parsed.groupBy("crowd").applyInPandas(settle, "page_id string, url string, text string, copies long, crowd long, host string, pages long, blob binary, run long, n int, out int"), "crowds")
    counts = done.where("run IS NOT NULL").select("crowd", "run", "n", "out")
    totals = counts.groupBy("run").agg(F.sum("n").alias("n"), F.sum("out").alias("out"), F.count(F.lit(1)).alias("crowds")).where("crowds > 1")
    shared = counts.select(F.col("crowd").alias("to"), "run").join(totals.select("run", "n", "out"), "run")
    open_ = done.where("blob IS NOT NULL").select("crowd", "host", "pages", "blob")
    found = open_.groupBy("crowd").cogroup(shared.groupBy("to")).applyInPandas(finish, "page_id string, url string, text string, copies long")
    out = done.where("text IS NOT NULL").select("page_id", "url", "text", "copies").union(found)
    out = out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.drop("copy")


def op9_main_text(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
