"""The pipeline's stages over a small table, each against brute force on what the stage before it kept."""

import random

import pytest

from cubeframe.llm import packing

pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("public_tokenizers")


def words(n, seed, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(4, 7))) for _ in range(n))


def test_stages(spark, tmp_path):
    letters = {"xx": "aeioulmn", "yy": "bcdfgrst"}
    test, common = words(20, 900, letters["xx"]), words(30, 901, letters["yy"])
    rows = [(k, words(60, k, letters[g]), g, "s", 0) for k, g in enumerate(["xx", "yy"] * 40)]
    rows += [(100, rows[3][1], "yy", "s", 0), (101, rows[4][1] + " end", "xx", "s", 0), (102, rows[5][1], "yy", "s", 0), (102, rows[5][1], "yy", "s", 0)]
    rows += [(110, words(30, 110, letters["yy"]) + " " + common, "yy", "s", 0), (111, common + " " + words(30, 111, letters["yy"]), "yy", "s", 0)]
    rows += [(120, words(5, 120, letters["xx"]) + " " + test, "xx", "s", 0), (130, None, "xx", "s", 0), (131, "12 34", None, "s", 0), (None, words(60, 132, letters["xx"]), None, "s", 0)]
    rows = [(i, t, g, s, len(t or "")) for i, t, g, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", test), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t, *_ in rows if t and t != "12 34"]

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    near = []
    for i, t in sorted(kept, key=lambda r: (r[0] is None, r[0])):
        s = shingles(t)
        if not any(5 * len(s & shingles(u)) >= 4 * len(s | shingles(u)) for _, u in near):
            near.append((i, t))
    seen, cut = set(), []
    for i, t in near:
        b = t.encode()
        gone = {k + j for k in range(len(b) - 49) if b[k : k + 50] in seen for j in range(50)}
        seen |= {b[k : k + 50] for k in range(len(b) - 49)}
        cut.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode()))
    clean = [(i, t) for i, t in cut if i != 120]
    assert [names for names, _ in pipeline.STAGES] == ["language", "near-copies", "passages", "benchmark", "packing"]
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for (name, stage), want in zip(pipeline.STAGES[:-1], (kept, near, cut, clean), strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str), name
        assert all(r["n_chars"] == len(r["text"]) for r in got), name
    encode = packing.Encoder(str(tokenizers.path("word_bpe_49k.json")))
    got = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == sorted((str(i), len(encode(t)) // 4 + 1) for i, t in clean)
    assert max(r["offset"] + r["length"] for r in got) <= 4096


def test_workers_keep_few_words():
    """A worker's words stay in memory through all later stages, so neither many words nor long ones may pile up."""
    import itertools

    import numpy as np

    path = str(tokenizers.path("word_bpe_49k.json"))
    encode = packing.Encoder(path)
    words = ["".join(w) for w in itertools.product("abcdefgh", repeat=6)]  # 262144
    texts = [" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)]
    most, made = 0, []
    for ids in encode.many([*texts, *texts[:2]]):
        most, made = max(most, len(encode.known)), [*made, ids]
    assert most < 230_000 and made[-2:] == made[:2]
    assert np.frombuffer(made[0], "<u4").tolist() == encode.tokenizer.encode(texts[0], add_special_tokens=False).ids
    for k in range(150):
        encode(f"{k}" + "7q" * 50_000)
    assert sum(map(len, encode.known)) < 10_000_000


def test_words_that_come_up_again_are_kept():
    """When a worker has too many words, those in use are not encoded anew."""
    import itertools

    import numpy as np

    path = str(tokenizers.path("word_bpe_49k.json"))
    encode = packing.Encoder(path, 3000)
    words = ["".join(w) for w in itertools.product("abcdefgh", repeat=5)][::4]
    common, learnt, learn = words[:500], [], encode.learn
    encode.learn = lambda some: (learnt.extend(some), learn(some))[1]
    for k in range(500, len(words), 500):
        text = " ".join([*common, *words[k : k + 500]])
        assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encode.known) < 4000
    assert len(learnt) == len(words)


def test_words_with_marks_after_them():
    import numpy as np

    encode = packing.Encoder(str(tokenizers.path("word_bpe_49k.json")))
    for text in ("one*** two### one... two*** three&&&", "it's*** o'!! a!'s b''' c'*", '½*** x_y__ 12,5. é$$$ ß." *** ÿ~~ İ&& Ǆ\\|'):
        assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
