"""Each operator against brute force on small fixtures, and on nulls, empty and repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeframe.llm import components, counting, decontaminate, fingerprint, langid, near_copies, packing, pages, passages, quality, scoring

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, score int"
R = random.Random(8)
WORDS = ["".join(R.choice("abcdefgé") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(30, 99)
    out = [(k, prose(60, k), "en" if k % 2 else "de", k) for k in range(40)]
    out += [(50 + k, out[k][1], None, 0) for k in range(5)]  # exact copies
    out += [(60 + k, out[10][1].replace(" ", " ", 1).rsplit(" ", 2 + k)[0], "en", 0) for k in range(4)]  # near copies
    out += [(70 + k, f"{prose(20, 700 + k)} {shared} {prose(20, 800 + k)}", "en", 0) for k in range(4)]
    return [*out, (80, None, None, None), (81, "", "en", 1), (82, " \t", "en", 1), (83, "one", "en", 1), (83, "one", "en", 1), (None, "no id here", "en", 1), (84, prose(9000, 5), "en", 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_fingerprints(spark, docs, rows):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert got[0]["fingerprint_text"] == got[50]["fingerprint_text"] and got[80]["fingerprint_text"] == got[82]["fingerprint_text"] == ""
    pairs = docs.where("doc_id = 10").crossJoin(docs.where("doc_id IN (60, 20)").select(F.col("doc_id").alias("other"), F.col("text").alias("t")))
    near = {r[0]: r[1] for r in pairs.select("other", fingerprint.likeness(fingerprint.packed(F.col("text"), fingerprint._probes()), fingerprint.packed(F.col("t"), fingerprint._probes()))).collect()}
    assert near[60] > 0.8 and near[20] < 0.15
    nexts = [(r["doc_id"], r["text"], r["next_text"]) for r in fingerprint.with_next(docs, ["text"], buckets=4).collect()]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = [(r[0], r[1], order[(k + 1) % len(order)][1]) for k, r in enumerate(order)]
    assert sorted(map(str, nexts)) == sorted(map(str, want))
    assert fingerprint.with_next(docs.limit(0), ["text"]).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_copies(docs, rows, size, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs, size).collect()}
    sets = {}
    for i, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(k for k in sets if k is not None)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in got.items() if k is not None} == root
    assert near_copies.keep_one(docs, size).columns == docs.columns
    assert near_copies.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_of_repeated_and_null_ids(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    table = [(1, a), (2, b), (2, a + " tail"), (3, b + " more"), (None, a + " x"), (None, c), (None, c + " y"), (7, "z"), (7, "z"), (8, None), (8, None), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(table)], "doc_id long, text string, hashed int")
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in near_copies.near_duplicates(docs, 2).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (2, 1), (3, 2), (0, 1), (0, None), (0, None), (7, 7), (7, 7), (8, 8), (8, 8), (0, None)], key=str)
    kept = near_copies.keep_one(docs, 2)
    assert kept.columns == docs.columns
    rows = {(r["doc_id"], r["text"]): r["hashed"] for r in kept.collect()}
    assert set(rows) - {(None, c), (None, c + " y")} == {(1, a), (2, b), (7, "z"), (8, None), (None, None)} and rows[(1, a)] == 0
    assert kept.count() == 7 and len({(None, c), (None, c + " y")} & set(rows)) == 1


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["u"]: x["v"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


@pytest.mark.parametrize("crowd", [2, 1500])
def test_passages(docs, rows, crowd, monkeypatch):
    monkeypatch.setattr(passages, "CROWD", crowd)
    monkeypatch.setattr(passages, "BUCKET_BYTES", 4000)
    known = [r for r in rows if r[0] is not None]
    first = {}
    for i, text, *_ in sorted(known, key=lambda r: r[0]):
        b = (text or "").encode()
        for s in range(len(b) - 49):
            first.setdefault(b[s : s + 50], i)
    want = {}
    for i, text, *_ in known:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in passages.repeats(docs).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want
    assert sum(v[1] for v in want.values()) > 500
    kept = passages.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert passages.repeats(docs.limit(0)).count() == 0


def test_passages_write_few_files(spark, monkeypatch):
    """Each file that an executor creates may start two processes: buckets share files, and marks are joined without being stored again."""
    monkeypatch.setattr(passages, "BUCKET_BYTES", 500)
    docs = spark.createDataFrame([(k, f"{prose(40, k)} {prose(20, 1000 + k % 30)}") for k in range(150)], "doc_id long, text string")
    folders = [Path(spark.conf.get(f"spark.{k}.dir").removeprefix("file:")) for k in ("sql.warehouse", "checkpoint")]
    old = {p for d in folders for p in d.rglob("part-*")}
    removed = [r["n_removed"] for r in passages.repeats(docs).orderBy("doc_id").collect()]
    assert not any(removed[:30]) and all(removed[30:])
    new = [p.parent.name.split("-")[0].split("_")[0] for d in folders for p in d.rglob("part-*") if p not in old]
    assert set(new) == {"copies", "passages", "triggers", "marks"}
    assert max(map(new.count, set(new))) <= 4 * spark.sparkContext.defaultParallelism


def test_passages_of_repeated_and_null_ids(spark, monkeypatch):
    """Texts that share an id do not share their marks, and do not match each other; a genuine U+FFFD stays."""
    monkeypatch.setattr(passages, "BUCKET_BYTES", 1 << 20)
    common, other = prose(20, 1), prose(20, 2)
    table = [(1, common), (2, f"{prose(30, 3)} {common}"), (2, prose(40, 4)), (2, f"{prose(50, 5)}"), (3, f"{other} \ufffd é"), (4, other + " x"), (4, f"y {other}"), (None, f"q {other}"), (None, prose(30, 6)), (5, common), (5, common)]
    docs = spark.createDataFrame([(*r, "a", "b", "c", k) for k, r in enumerate(table)], "doc_id long, text string, same string, least string, kept string, n_chars int")
    far = 1 << 62
    owner: dict = {}
    for i, text in table:
        for s in range(len(text.encode()) - 49):
            w = text.encode()[s : s + 50]
            owner[w] = min(owner.get(w, far), far if i is None else i)
    want = []
    for i, text in table:
        b, gone = text.encode(), np.zeros(len(text.encode()), bool)
        for s in range(len(b) - 49):
            if owner[b[s : s + 50]] < (far if i is None else i):
                gone[s : s + 50] = True
        want.append((i, len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in passages.repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = passages.remove_repeats(docs)
    assert left.columns == docs.columns and left.where("same = 'a' AND least = 'b' AND kept = 'c'").count() == len(table)
    assert {r["text"] for r in left.where("doc_id = 3").collect()} == {f"{other} \ufffd é"}
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect())
    assert passages.whole("aé\ufffdb".encode(), np.array([0, 0, 1, 0, 0, 0, 0], bool)) == "a\ufffdb"


def test_decontaminate(spark, docs):
    long = " ".join(prose(9000, 5).split()[100:125])
    items = spark.createDataFrame([(1, long, 0), (2, "one", 0), (3, None, 0), (4, "", 0), (1, long, 0), (5, prose(13, 0), 0)], "item_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, items).collect()}
    assert got[84]["n_hit"] == 25 and not got[84]["contaminated"] and got[84]["n_items"] == 1
    assert got[83]["contaminated"] and got[0]["n_hit"] == 13 and got[0]["contaminated"]
    assert got[80]["n_words"] == 0 and got[80]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    left = {r["doc_id"] for r in decontaminate.remove_documents(docs, items).collect()}
    assert 83 not in left and 84 in left and 80 in left and None in left
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert len(cut[84].split()) == 9000 - 25 and cut[1] == prose(60, 1)
    clash = docs.withColumn("_text", F.lit("t")).withColumn("_spans", F.lit("s"))
    for kept in (decontaminate.remove_documents(clash, items), decontaminate.remove_spans(clash, items)):
        assert kept.columns == clash.columns and {(r["_text"], r["_spans"]) for r in kept.collect()} == {("t", "s")}
    assert decontaminate.scan(docs.limit(0), items.limit(0)).count() == 0 and decontaminate.scan(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontaminate_without_broadcast(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, prose(60, 3)), (2, "one")], "item_id long, text string")
    want = sorted(map(str, decontaminate.scan(docs, items).drop("spans").collect()))
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert sorted(map(str, decontaminate.scan(docs, items).drop("spans").collect())) == want


def test_packing(docs, rows):
    path = str(tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(docs, path).toPandas()
    whole = packing.Encoder(path).tokenizer
    ids = {84: [*whole.encode(rows[-1][1], add_special_tokens=False).ids, 1]}
    part = got[got.doc_id == 84].sort_values("piece")
    assert part.length.sum() == len(ids[84]) and part.ids_crc32.tolist() == [zlib.crc32(np.array(ids[84][a : a + 4096], "<u4").tobytes()) for a in range(0, len(ids[84]), 4096)]
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and (s.groupby("sequence_id").length.sum() <= 4096).all()
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096) and (got.piece == 0).sum() == len(rows)
    assert packing.pack(docs.limit(0), path).count() == 0
    encode = packing.Encoder(path)
    for text in ("It's Σας ΟΔΟΣ “q” — naïve 12,345 x\x1cy <|endoftext|> İ ﬁ é", "don't a'sb !!'s \t\n x", "ÀÉÎ Ǆ ß", ""):
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_plan():
    def fewest(items, capacity):
        best = [len(items)]

        def go(left, bins):
            if len(bins) >= best[0]:
                return
            if not left:
                best[0] = len(bins)
                return
            for k in {b: k for k, b in enumerate(bins)}.values():
                if bins[k] + left[0] <= capacity:
                    go(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]])
            go(left[1:], [*bins, left[0]])

        go(sorted(items, reverse=True), [])
        return best[0]

    r, over = random.Random(1), 0
    for _ in range(60):
        items = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        counts = {s: items.count(s) for s in items}
        bins = packing.plan(counts, 30)
        got = {}
        for n, parts in bins:
            assert n > 0 and sum(s * k for s, k in parts) <= 30
            for s, k in parts:
                got[s] = got.get(s, 0) + n * k
        assert got == counts
        over += sum(n for n, _ in bins) - fewest(items, 30)
    assert over <= 2


def test_counting(docs):
    path = str(tokenizers.path("byte_bpe_50k.json"))
    words = counting.Vocabulary(path)
    r = random.Random(3)
    for seed in range(25):
        text = prose(r.choice([0, 3, 400]), seed)
        doc, now = counting.Counted(text, words), text
        for _ in range(6):
            a = r.randint(0, len(now))
            b = min(len(now), a + r.choice([0, 1, 7, 900]))
            new = r.choice(["", " ", "x", "'s", "   ", "\n\n ", " hello world", "12 é"])
            doc.edit(a, b, new)
            now = now[:a] + new + now[b:]
            if r.random() < 0.3:
                doc = counting.Counted.restored(now, doc.stored(), words)
        assert doc.text() == now and doc.length == len(now) and doc.tokens == len(words.tokenizer.encode(now, add_special_tokens=False).ids)
    edits = F.array(F.struct(F.lit(5).alias("start"), F.lit(9).alias("end"), F.lit(None).cast("string").alias("new")))
    got = {x["doc_id"]: x for x in counting.counted(docs.withColumn("edits", edits), None, path).collect()}
    assert got[84]["recounted"] < 120 and got[80]["n_tokens"] == 0
    # stored trees, edited twice, as whole texts are counted
    one = lambda a, b, new: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new")))
    first = counting.edited(counting.trees(docs.withColumn("found", F.lit(1)), path).withColumn("edits", one(3, 5, " big x")), path)
    second = counting.edited(first.withColumn("edits", one(9, 12, "")), path)
    assert set(second.columns) == {"doc_id", "lang", "score", "found", "text", "tree", "n_tokens", "recounted"}
    for x in second.collect():
        assert x["n_tokens"] == len(words.tokenizer.encode(x["text"], add_special_tokens=False).ids) and x["recounted"] < 120
    big = counting.Counted("", words)
    for k in range(40):
        big.edit(big.length, big.length, prose(30, k) + " ")
    assert big.tokens == len(words.tokenizer.encode(big.text(), add_special_tokens=False).ids) and len(big.leaves) > 1


def test_language(spark, docs, rows):
    words = {"xx": "aeiou", "yy": "bcdfg"}
    r = random.Random(4)
    many = [(k, " ".join("".join(r.choice(words[g]) for _ in range(5)) for _ in range(20)), g, 0) for k, g in enumerate(["xx", "yy"] * 60)]
    table = spark.createDataFrame([*many, (500, None, "xx", 0), (501, "123 !!", "xx", 0), (502, "½ ② ³", "xx", 0), (503, "aeiou " * 30000, None, 0), (503, "bcdfg", None, 0), (None, "aeiou", None, 0)], DOCS)
    got = {x["doc_id"]: x for x in langid.predict(table, langid.learnt(table), F.col("doc_id")).collect()}
    assert all(got[k]["lang_pred"] == g and got[k]["score"] > 0.9 for k, _, g, _ in many) and got[500]["lang_pred"] == got[501]["lang_pred"] == got[502]["lang_pred"] == "und"
    clash = table.withColumn("predicted", F.lit("p"))
    left = langid.accepted(clash, langid.learnt(table))
    assert left.columns == clash.columns and {r["predicted"] for r in left.collect()} == {"p"}
    nothing = langid.learnt(table.limit(0))
    assert {x["lang_pred"] for x in langid.predict(table, nothing, F.col("doc_id")).collect()} == {"und"}


def test_quality(spark, docs):
    r = random.Random(4)
    many = [(k, (prose(20, k).upper() + "!!" if k % 2 else prose(20, k)), None, 0) for k in range(150)]
    table = spark.createDataFrame([*many, (500, None, "xx", 0), (None, "aeiou", None, 0)], DOCS)
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(150)] + [(900, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["score"] for x in quality.score(table, quality.learnt(table, labels), F.col("doc_id")).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 2 == 0) for k in range(150)]) > 0.97 and 0 <= got[500] <= 1
    none = quality.learnt(table, labels.limit(0))
    assert {x["score"] for x in quality.score(table, none, F.col("doc_id")).collect()} == {0.5}


def test_pages(spark):
    boiler = "<div>Home News About Contact us today</div>{}<div>All rights reserved by us forever and ever</div>"
    table = [(k, f"http://h.org/{k}", boiler.format(f"<p>unique{k} words{k} stand{k} here{k}</p>")) for k in range(4)]
    table += [
        (10, "http://h.org/a", '<html><title>t</title><script>var t="</p>";</script><nav><ul><li>menu</nav><div class="ad">buy</div><article><h1>A &amp; b</h1><p><b>one<br>two <!-- no --> three<p>four&nbsp;<i>five</i></p><div class="comments">me too</div></article><footer>&copy;'),
        (11, None, None),
        (12, "::bad::", ""),
        (12, "::bad::", ""),
        (13, "http://x.org/a", '<div id="search">We searched far and wide.</div><div class="social-history">It was long ago.</div><p class="ad">Buy now a thing</p><div class="site-footer">us</div>'),
        (14, None, "<article><p>" + prose(9000, 4) + "</p></article>"),
    ]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    assert got[13] == "We searched far and wide.\n\nIt was long ago." and got[14] == prose(9000, 4)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string, key int, host int")).count() == 0
    assert got[10] == "A & b\n\none two three\n\nfour five" and got[11] == got[12] == ""
    assert all(got[k] == f"unique{k} words{k} stand{k} here{k}" for k in range(4))


def test_scoring_gradients():
    """The step's direction against differences of the loss."""
    net = {k: v.astype(np.float64) for k, v in scoring.start(3).items()}
    flat, at = scoring.streams(np.array([1, 4, 4, 8, 0, 2, 7]), np.array([4, 3]), 9)
    loss = lambda n: -scoring.forward(n, flat)[-1][at - scoring.SIDE].mean()
    now, past = {k: v.copy() for k, v in net.items()}, {k: np.zeros(v.shape) + 1e-12 for k, v in net.items()}
    scoring.step(now, past, flat)
    for name, v in net.items():
        for i in list(np.ndindex(v.shape))[:: max(1, v.size // 9)]:
            up, down = ({k: w.copy() for k, w in net.items()} for _ in range(2))
            up[name][i] += 1e-5
            down[name][i] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert abs(np.sqrt(max(0, past[name][i] - 1e-12)) - abs(slope)) < 1e-4
            assert abs(slope) < 1e-4 or (now[name][i] - v[i]) * slope < 0


def test_scoring(docs, rows):
    token = scoring.vocabulary(docs)
    net = scoring.train(docs, token, rounds=1)
    got = {r["doc_id"]: r for r in scoring.scores(docs, net, token).collect()}
    assert got[80]["n_tokens"] == 0 and got[80]["mean_log_likelihood"] is None and got[84]["n_tokens"] == 9000
    untrained = scoring.log_probabilities(scoring.start(), token[scoring.Words().hashed(prose(60, 1))]).mean()
    assert got[1]["mean_log_likelihood"] > untrained
    whole = [np.exp(scoring.log_probabilities(net, np.array([5, 7, t, 9, 2]))[2]) for t in range(token.groups**2)]
    assert abs(sum(whole) - 1) < 1e-4
    texts = [prose(60, 1), "", prose(9, 2)]
    words = [token[scoring.Words().hashed(t)] for t in texts]
    together = scoring.log_probabilities(net, np.concatenate(words), np.array([len(w) for w in words]))
    assert np.allclose(together, np.concatenate([scoring.log_probabilities(net, w) for w in words]), atol=1e-4)
    assert scoring.scores(docs.limit(0), scoring.train(docs.limit(0), token), token).count() == 0


@pytest.mark.parametrize("known", [1300, 1 << 21])
def test_scoring_tells_rare_words_apart(spark, monkeypatch, known):
    """Every word of the corpus has a probability of its own, they add up to 1, and joined words score as known ones."""
    monkeypatch.setattr(scoring, "KNOWN", known)
    n = {f"w{k}": 1 + (k < 1400) + (k < 1200) * 9 + (k == 5000) * 4 for k in range(6000)}
    words = [w for w, k in n.items() for _ in range(k)]
    random.Random(1).shuffle(words)
    table = spark.createDataFrame([(k, " ".join(words[k::50])) for k in range(50)] + [(None, None)], "doc_id long, text string").repartition(3)
    token = scoring.vocabulary(table)
    assert token.counts.count() == len(n)
    net = scoring.train(table, token, rounds=1)
    one = spark.createDataFrame([(k, f"w{k}") for k in range(6000)], "doc_id long, text string")
    got = {r["doc_id"]: r["log_likelihood"] for r in scoring.scores(one, net, token).collect()}
    assert abs(sum(np.exp(v) for v in got.values()) - 1) < 1e-4
    own = {k: token[scoring.Words().hashed(f"w{k}")][0] for k in range(5000, 6000)}
    mates = [k for k in range(5001, 6000) if own[k] == own[5000]]
    assert mates and all(abs(got[5000] - got[k] - np.log(5)) < 1e-5 for k in mates)
    whole = {r["doc_id"]: r for r in scoring.scores(table, net, token).collect()}
    assert len(whole) == 51 and whole[None]["n_tokens"] == 0 and whole[None]["mean_log_likelihood"] is None
    h = scoring.Words().hashed(" ".join(words[7::50]))
    count = [n[w] for w in words[7::50]]
    heads = token[h] < token.groups**2 - token.rare
    share = np.where(heads, 0, np.log(np.array(count) / token.totals[h % token.rare]))
    assert abs(whole[7]["log_likelihood"] - (scoring.log_probabilities(net, token[h]) + share).sum()) < 1e-3


@pytest.mark.parametrize("crowd", [1, 3, 256])
def test_pages_across_crowds(spark, monkeypatch, crowd):
    """Runs are counted over the whole host, however its pages are dealt, and decide on pages with an article too."""
    monkeypatch.setattr(pages, "CROWD", crowd)
    own = [f"<p>own{k} text{k} of{k} page{k} number{k} here{k} now{k}</p>" for k in range(12)]
    often, twice = "<p>Read all of our many other stories over here</p>", "<p>these words stand on just two of all pages</p>"
    table = [(k, f"http://h.org/{k}", f"<article>{own[k]}{often}{twice if k in (1, 8) else ''}</article>") for k in range(10)]
    table += [(k, f"http://h.org/{k}", f"<div>{own[k]}{twice}</div>") for k in (10, 11)]
    table += [(12, "http://h.org/12", f"<div>body{own[0][3:-4]}s outside</div><article><p>a small one</p></article>"), (0, *table[0][1:])]
    got = [(r["page_id"], r["text"]) for r in pages.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()]
    want = [(k, own[k][3:-4] + (f"\n\n{twice[3:-4]}" if k in (1, 8) else "")) for k in range(12)]
    want += [(0, own[0][3:-4]), (12, f"body{own[0][3:-4]}s outside\n\na small one")]
    assert sorted(got) == sorted(want)


def test_decontaminate_capital_sigma(spark):
    """Words are lower-cased by A-Z only, so what follows a word does not change it."""
    tail = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{tail} ΟΔΟΣ.ΑΒ")], "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{tail} ΟΔΟΣ")], "item_id long, text string")
    assert decontaminate.scan(docs, items).collect()[0]["n_hit"] == 13


def test_new_tree_is_the_counted_one():
    import public_tokenizers

    from cubeframe.llm import counting

    words = counting.Vocabulary(str(public_tokenizers.path("byte_bpe_50k.json")))
    for text in ("", "a", " b" * 32, " b" * 33, "Words, of 3 kinds;\n\n and ½ é " * 400, "x" * 100_000):
        doc = counting.Counted(text, words)
        assert counting.new_tree(text, words) == (doc.stored(), doc.tokens)


def test_runs_by_brute_force(monkeypatch):
    """A group's runs are sorted once, in articles and outside together, and each is counted on the right pages."""
    r = random.Random(5)
    table = [([" ".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 5))], []) for _ in range(40)]
    table = [(texts, [r.randint(0, 2) for _ in texts]) for texts, _ in table]
    on, out = {}, {}
    for k, (texts, kinds) in enumerate(table):
        for t, kind in zip(texts, kinds, strict=True):
            block = ["<", *t.split(" "), ">"]
            for at in range(max(1, len(block) - pages.RUN + 1)):
                on.setdefault(tuple(block[at : at + pages.RUN]), set()).add(k)
                if kind < 2:
                    out.setdefault(tuple(block[at : at + pages.RUN]), set()).add(k)
    sorts, sort = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **b: (sorts.append(len(a[0])), sort(*a, **b))[1])
    runs = pages.Runs(table)
    assert len(sorts) <= 1
    assert sorted(zip(runs.pages.tolist(), runs.out.tolist(), strict=True)) == sorted((len(s), len(out.get(w, ()))) for w, s in on.items())
    again = pages.Runs(table[::-1])
    assert dict(zip(runs.keys().tolist(), runs.pages.tolist(), strict=True)) == dict(zip(again.keys().tolist(), again.pages.tolist(), strict=True))
    many = [" ".join(f"w{r.randint(0, 9000)}" for _ in range(20_000)) + " a b c d e f"] * 2
    runs = pages.Runs([([t], [2]) for t in many] + [(["a b c d e f"], [1]), ([], [])])
    assert runs.pages.max() == 3 and runs.out.sum() == 3 and pages.kept([(["a b c d e f"], [2])] * 4, pages.Runs([(["a b c d e f"], [2])] * 4), 4) == [""] * 4
    assert pages.kept([([], [])], pages.Runs([([], [])]), 1) == [""] and not len(pages.Runs([]).keys())
