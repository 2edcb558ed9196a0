"""The operators against brute force, round trips and held-out rows, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import ann, chat, contamination, language, licenses, neardup, packing, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, score string"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))


def frame(spark, rows, schema=DOCS):
    n = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (n - len(r)) for r in rows], schema)


def some_text(rng, n, vocab=60):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_neardup(spark):
    rng = random.Random(3)
    rows = [(i, some_text(rng, rng.randint(20, 60))) for i in range(25)]
    base = some_text(rng, 120, 5000).split()
    for i in range(100, 130):  # a group that is far larger than what a posting expands into pairs
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "  \n"), (203, "One Two"), (204, "one\ttwo"), (205, rows[0][1].upper()), (206, some_text(rng, 30_000, 9000))]
    got = {r["doc_id"]: r for r in neardup.classes(frame(spark, rows), neardup.Config(small=4, block=8)).collect()}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for _ in ids:
        moved = False
        for a in ids:
            for b in ids:
                x = len(sets[a] & sets[b])
                if a < b and x and 100 * x >= 85 * (len(sets[a]) + len(sets[b]) - x) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    moved = True
        if not moved:
            break
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in ids}


def test_neardup_large_group(spark):
    """Production sizes of postings and blocks: 2,000 near copies, and 800 that share a part with them; links by SQL over all pairs."""
    import duckdb
    import pandas as pd

    rng = random.Random(8)
    base = some_text(rng, 50, 5000).split()
    rows = []
    for i in range(2800):
        w = list(base)
        if i >= 2000:
            w[20 + i % 10 :] = some_text(random.Random(i // 3), 30, 50_000).split()
        w[rng.randrange(20)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(frame(spark, rows)).select("doc_id", "component_id").collect()}
    s = pd.DataFrame([(i, " ".join(x)) for i, t in rows for w in [t.split()] for x in {tuple(w[k : k + 3]) for k in range(len(w) - 2)}], columns=["i", "x"])
    links = duckdb.sql("""WITH n AS (SELECT i, count(*) AS n FROM s GROUP BY i), p AS (SELECT a.i AS i, b.i AS j, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.i < b.i GROUP BY 1, 2)
      SELECT p.i, j FROM p JOIN n ON n.i = p.i JOIN n m ON m.i = j WHERE 100 * c >= 85 * (n.n + m.n - c)""").fetchall()
    comp = list(range(2800))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in sorted(links):
        if (a := root(i)) != (b := root(j)):
            comp[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(2800)} and len(set(got.values())) > 100


def test_neardup_divided(spark):
    """Blocks so small that postings are divided again and again."""
    rng = random.Random(21)
    base = some_text(rng, 40, 5000).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 9, 12, 15])):
            w[rng.randrange(40)] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(w)))
    cfg = neardup.Config(small=3, block=4, wide=4, shingle=1, percent=80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(frame(spark, rows), cfg).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    comp = dict(zip(sets, sets))
    for _ in range(30):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp


def test_neardup_empty(spark):
    assert neardup.classes(frame(spark, [])).count() == 0


def test_neardup_keep_one_repeated(spark):
    rng = random.Random(12)
    a, b, c, d, e = (some_text(rng, 60, 5000) for _ in range(5))
    near = lambda t: t + " tail"
    rows = [
        (1, a, "x"), (1, a, "x"), (1, a, "y"),  # one row stays
        (2, near(a), "x"),  # near 1
        (3, b, "x"), (3, near(a), "x"),  # equal ids: b stays, the near copy of 1 goes
        (4, near(b), "x"),  # near 3's b
        (5, c, "x"), (5, d, "x"),  # both texts are clean
        (6, near(d), "x"),  # near 5's second text
        (7, "", "x"), (7, "", "x"), (8, "", "x"), (9, None, "x"), (9, None, "x"),
        (None, e, "x"), (None, near(e), "x"), (10, e, "x"),
    ]
    docs = frame(spark, [(i, t, s) for i, t, s in rows])
    got = neardup.keep_one(docs, neardup.Config(shingle=3, percent=80, match=14))
    assert got.columns == docs.columns
    key = lambda r: tuple(str(x) for x in r)
    out = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key)
    assert out == sorted([(1, a), (3, b), (5, c), (5, d), (7, ""), (8, ""), (9, None), (None, e), (None, near(e)), (10, e)], key=key)
    again = neardup.keep_one(docs.orderBy(F.rand(3)).repartition(3), neardup.Config(shingle=3, percent=80, match=14))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def toxic_rows(n):
    rng = random.Random(4)
    pool = ["".join(rng.choice(["an", "er", "ti", "on", "sh", "le", "wo", "ri"]) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        w = [rng.choice(pool) for _ in range(80)]
        if bad:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["villainous", "rottenheart", "scoundrel"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(300)
    docs = frame(spark, rows + [(900, None), (901, ""), (902, rows[0][1] * 50)])
    held = zlib.crc32
    y = {i: v for i, v in labels}
    train = frame(spark, [(i, v) for i, v in labels if held(str(i).encode()) % 5], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.sample(docs, train))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    fold = [i for i in y if held(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == y[i] for i in fold]) > 0.95
    assert got[900]["predicted"] == got[901]["predicted"] == 0 and got[902]["predicted"] == 1
    assert toxicity.score(docs, toxicity.Model()).filter("predicted = 1").count() == 0
    # both dictionaries hold text of their class, and the toxic one shortens a toxic window
    s = toxicity.Scorer(model, toxicity.Config())
    own = model.toxic[len(model.ordinary.rstrip(b"\0")) :]
    assert b"scoundrel" in own and b"scoundrel" not in model.ordinary and len(model.ordinary.strip(b"\0")) > 200
    assert s.savings("wo ri villainous le sh").tolist()[0] > 3 >= s.savings("wo ri anwo le sh").tolist()[0]
    assert b"".join(toxicity.windows("é" * 1000 + " b", toxicity.Config())).decode().split() == ["é" * 1000, "b"]


def test_toxicity_edges(spark):
    rows, labels = toxic_rows(120)
    repeated = [(700, rows[0][1]), (700, rows[0][1]), (701, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in rows + repeated], "doc_id long, text string, score double, predicted int, toxic string")
    model = toxicity.fit(toxicity.sample(docs, frame(spark, labels, "doc_id long, toxic int")))
    got = toxicity.score(docs, model)
    assert sorted(got.columns) == ["doc_id", "predicted", "score", "text", "toxic"] and got.count() == 123
    assert got.filter("doc_id in (0, 700, 701)").select("score").distinct().count() == 1 and got.filter("doc_id = 700").count() == 2
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(toxicity.sample(empty, frame(spark, [], "doc_id long, toxic int")))).count() == 0
    one = toxicity.fit(toxicity.sample(docs, frame(spark, [x for x in labels if x[1] == 0], "doc_id long, toxic int")))
    assert toxicity.score(docs, one).filter("score > 0.01").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_toxicity_held_out_fold(spark):
    from textmill.llm.queries import op2_toxicity

    d = "/root/testdata/sf0.1"
    held = op2_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    share = {r["toxic"]: r["p"] for r in held.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert share[1] >= 0.75 and share[0] <= 0.05


def test_language(spark):
    rng = random.Random(5)
    lexicon = {"aa": ["kala", "malak", "tarak", "lakar"], "bb": ["öwen", "örten", "über", "wöten"], "cc": ["xiquo", "quixo", "zoqui", "ixoz"]}
    text = lambda l, n: " ".join(rng.choice(lexicon[l]) for _ in range(n))
    rows = [(i, text(l := "abc"[i % 3] * 2, 30), l) for i in range(120)]
    docs = frame(spark, rows + [(500, None, None), (501, "123 !?", "aa"), (502, text("aa", 60) + " " + text("bb", 20), None), (503, text("cc", 20_000), None)])
    model = language.fit(language.sample(docs.filter("doc_id < 60")))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l in rows)
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[503]["lang_pred"] == "cc"
    assert got[502]["langs"] == ["aa", "bb"] and abs(got[502]["score"] - 0.75) < 0.1
    assert language.identify(docs, language.Model([], np.zeros((2, 0)))).filter("lang_pred <> 'und'").count() == 0


def test_language_sets_of_any_size(spark):
    rng = random.Random(11)
    lexicon = {"aa": ["kala", "malak", "tarak", "lakar"], "bb": ["öwen", "örten", "über", "wöten"], "cc": ["xiquo", "quixo", "zoqui", "ixoz"], "dd": ["ffej", "jeff", "pejf", "fjep"], "ee": ["gnid", "dingn", "ndigi", "igdin"]}
    text = lambda l, n: " ".join(rng.choice(lexicon[l]) for _ in range(n))
    rows = [(i, text(l := "abcde"[i % 5] * 2, 30), l) for i in range(100)]
    mixed = {200: "abcd", 201: "abcde", 202: "ab", 203: "e"}
    docs = frame(spark, rows + [(i, " ".join(text(c * 2, 100) for c in s), None) for i, s in mixed.items()])
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(language.sample(docs))).filter("doc_id >= 200").collect()}
    for i, s in mixed.items():
        assert sorted(got[i]["langs"]) == [c * 2 for c in s] and abs(got[i]["score"] - 1 / len(s)) < 0.03


def test_contamination(spark):
    rng = random.Random(6)
    items = [(1, some_text(rng, 30, 500)), (2, some_text(rng, 10, 500)), (3, "short item Here"), (4, None), (5, "?!"), (6, some_text(rng, 30, 500))]
    a, b = items[0][1].split(), items[1][1].split()
    rows = [(1, some_text(rng, 50)), (2, "x y " + " ".join(a[3:13]) + " z"), (3, " ".join(a[3:12])), (4, some_text(rng, 5) + "\n" + " ".join(b).upper() + "; a SHORT, item—here"), (5, None), (6, ""), (7, "short item here"), (7, "short item here"), (8, some_text(rng, 20_000, 300) + " " + " ".join(a))]
    it = [(i, t) for i, t in items]
    got = sorted(tuple(r) for r in contamination.mark(frame(spark, rows), spark.createDataFrame(it, "item_id long, text string")).select("doc_id", "n_words", "n_hit", "n_items", "ids").collect())
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        want.append((i, len(w), len(hit), len(found), sorted(found)))
    assert got == sorted(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination.mark(frame(spark, rows), empty).filter("contaminated").count() == 0
    assert contamination.clean(frame(spark, rows), spark.createDataFrame(it, "item_id long, text string")).columns == ["doc_id", "text", "lang", "score"]


def test_licenses(spark):
    rows = [(1, "Released Under the MIT License. under the mit license"), (2, None), (3, ""), (4, "a\nThis work is licensed under the GNU General Public License, version 3.\nb"), (5, "Licensed under CC-BY NC 4.0"), (6, "mit license"), (7, "apache license version 2 " * 3000)]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 1, 5, "mit")
    assert (got[2]["n_words"], got[3]["n_words"], got[2]["labels"], got[2]["score"]) == (0, 0, "", 0.0)
    assert (got[4]["base_labels"], got[4]["labels"]) == ("", "gpl") and got[5]["base_labels"] == "cc-by-nc" and got[6]["labels"] == "" and got[7]["n_base"] == 3000
    # words of a statement that stand apart, in any order, are none
    apart = [w for x in random.Random(4).sample(licenses.TEMPLATES[9][1].split(), 70) for w in (x, "fill", "more", "words")]
    assert license_labels(spark, [(1, " ".join(apart))]) == brute_labels([(1, " ".join(apart))]) == set()
    assert licenses.scan(frame(spark, [])).count() == 0


def license_labels(spark, rows):
    docs = frame(spark, rows).select("doc_id", "text")
    return {(r["doc_id"], tuple(r["labels"]), round(r["containment"], 9)) for r in licenses.template_labels(docs, licenses.scanned(docs, licenses.PHRASES, licenses.TEMPLATES)).collect()}


def brute_labels(rows):
    out = set()
    for i, t in rows:
        w, c = words(t), []
        for label, x in licenses.TEMPLATES:
            n, own = len(x.split()) + -(-len(x.split()) // 4), set(x.split())
            c.append((label, max(len(own & set(w[k : k + n])) for k in range(max(len(w) - n, 0) + 1)) / len(own)))
        if c := [(label, v) for label, v in c if v >= 0.8 - 1e-9]:
            out.add((i, tuple(sorted({label for label, _ in c})), round(max(v for _, v in c), 9)))
    return out


def test_licenses_wrapped(spark):
    rng = random.Random(10)
    fill = lambda n: "\n".join(some_text(rng, 9) for _ in range(n))
    rows, want = [], {}
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        for j, (width, mark) in enumerate([(70, ""), (70, "# "), (30, " * ")]):
            rows.append((i := 10 * k + j, fill(3) + "\n" + "\n".join(mark + x for x in textwrap.wrap(t, width)) + "\n" + fill(300 * (j == 0))))
            want[i] = label
    rows.append((900, "\n".join(x + "\n" + fill(4) for x in licenses.TEMPLATES[8][1].split())))  # its words far apart
    rows.append((901, "Permission is hereby granted, free of charge, to any person\r\nobtaining a copy of this software and associated documentation files"))
    for k in range(60):  # parts of templates, some over the threshold and some under
        x = rng.choice(licenses.TEMPLATES)[1].split()
        rows.append((1000 + k, some_text(rng, 20) + " " + " ".join(w if rng.random() < 0.85 else "zz" for w in x) + " " + some_text(rng, 20)))
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, rows + rows[:1])).collect()}
    assert all(want[i] in got[i]["labels"].split(",") and got[i]["score"] == 1.0 for i in want)
    assert (got[900]["labels"], got[900]["score"]) == ("", 0.0) and (got[901]["labels"], got[901]["score"]) == ("mit", 1.0)
    assert license_labels(spark, rows) == brute_labels(rows)
    clash = frame(spark, rows[:3]).withColumn("labels", F.lit(1)).withColumn("_t", F.lit(2)).withColumn("hits", F.lit(3)).withColumn("n_words", F.lit(4))
    assert sorted(map(str, licenses.scan(clash).collect())) == sorted(map(str, licenses.scan(frame(spark, rows[:3])).collect()))
    assert licenses.scan(frame(spark, [rows[0], rows[0], (None, rows[3][1])])).count() == 3


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    odd = ["Don't STOP it's 123 abc—def ... ÉCOLE İstanbul naïve", "<|endoftext|> a<|startoftext|>b", "a\x1cb c\x85d", "ﬁ é 日本語 текст", "x" * 500, "", "  ", "'s'll 'Ve", "ẞ ſ ª² ¼", "á é"]
    return odd + [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(1, 14))) for _ in range(60)) for _ in range(60)]


def test_tokens(spark, texts):
    v = tokens.WordVocabulary("word_bpe_49k.json")
    assert list(v.ids(texts)) == v.encode(texts)
    # beyond U+017F only the runs between spaces that hold such a character are left to the library
    assert tokens.units("Don’t stop") == [" Don’t", "stop"]
    assert all(v.encode([s]) == [i] for s, i in list(v.alone.items())[:500])
    got = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, list(enumerate(texts)) + [(9999, None)])).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(b) // 4 for b in v.encode(texts)]
    assert (got[9999]["n_tokens"], got[9999]["n_bytes"], got[9999]["over_limit"]) == (0, 0, False)
    small = tokens.WordVocabulary("word_bpe_49k.json", memo=700)
    assert list(small.ids(texts, run=500)) == v.encode(texts)


def test_tokens_are_found_in_numpy_as_by_the_pattern(monkeypatch):
    rng = random.Random(5)
    some = "'''stmdrevl  ,.!\n\tab19\0é\xa0\x85²ßœŁ"
    made = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    made += ["a" + c + "b'" + c + "s " + 9 * c for c in tokens.LATIN if c not in tokens.ODD and c != "İ"]
    made += ["!!!!!!!", "!!!!!!!\0", "x" * 35 + " " + "x" * 36, "ab" * 50 + " " + "ab" * 50 + "c", "'re've'll'd're", "'"]
    want = [tokens.PRE_TOKENS.findall(x.lower()) for x in made]

    def found(x):
        x = x.lower() + " " * 6
        c = np.frombuffer(x.encode("utf-16-le"), dtype="<u2")
        number, different = tokens.group(x, c, *tokens.spans(c))
        assert len(set(different)) == len(different)
        return [different[i] for i in number]

    assert [found(x) for x in made] == want and found("\n".join(made)) == sum(want, [])
    v = tokens.WordVocabulary("word_bpe_49k.json")
    ids = v.encode(made)
    assert list(v.ids(made)) == ids
    # a long text goes in parts, cut at spaces
    long = [" ".join(made), None, "x " * 40 + "y" * 90]
    assert list(v.ids(long, run=70)) == v.encode([x or "" for x in long])
    monkeypatch.setattr(tokens, "WIDEST", 10)
    assert list(v.ids(made)) == ids and list(v.ids(["", None])) == [b"", b""] and list(v.ids([])) == []
    monkeypatch.undo()
    monkeypatch.setattr(tokens, "MIX", 0)  # hashes that keep only the last characters: strings that share one still stay apart
    assert list(v.ids(made)) == ids and found("\n".join(made)) == sum(want, [])


def test_memo_keeps_what_is_met_again():
    v = tokens.WordVocabulary("word_bpe_49k.json", memo=120)
    merged = []
    learn = v.learn
    v.learn = lambda new: merged.extend(new) or learn(new)
    often = [[f"zq{a}{b}{c}" for b in "xwvkj" for c in "qzxw"] for a in "ab"]  # every other run has the same 20 units
    runs = [" ".join(often[i % 2] + [f"qx{chr(97 + i)}{b}zz" for b in "abcdefghijklmnopqrstuvwxyz"]) for i in range(26)]
    assert list(v.ids(runs, run=1)) == v.encode(runs)
    assert max(merged.count(x) for x in often[0] + often[1]) <= 2


def test_packing(spark, texts):
    rows = list(enumerate(texts)) + [(500, None), (501, "a b c " * 3000), (502, texts[20]), (502, texts[20])]
    got = packing.pack(frame(spark, rows), capacity=256).collect()
    v = tokens.WordVocabulary("word_bpe_49k.json")
    want = []
    for i, t in rows:
        ids = v.encode([t or ""])[0] + b"\0\0\0\0"
        for k, s in enumerate(range(0, len(ids) // 4, 256)):
            part = ids[4 * s : 4 * (s + 256)]
            want.append((i, k, s, len(part) // 4, zlib.crc32(part)))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len(seqs) <= -(-sum(w[3] for w in want) // 256) + 2
    assert packing.pack(frame(spark, [])).count() == 0


def test_plan_uses_every_length():
    rng = np.random.default_rng(8)
    for n in (1, 5, 500, 20_000):
        hist = np.bincount(rng.integers(1, 257, n), minlength=257)
        used = np.zeros(257, dtype=int)
        for p, k in packing.make_plan(hist, 256):
            assert sum(p) <= 256
            for x in p:
                used[x] += k
        assert (used == hist).all()


def test_warc(spark):
    pages = [(1, "http://a", "one\r\n\r\nWARC/1.1 trap"), (2, "http://b", "ünï"), (3, None, "ünï"), (4, "http://d", None), (5, "http://e", ""), (-6, "http://f", "z" * 100_000), (None, "http://g", "none")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -99), i if i is not None else -99)
    assert set(got) == {p[0] for p in pages}
    for i, u, h in pages:
        b = (h or "").encode()
        r = got[i]
        again = i is not None and last[h or ""] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(b), warc.sha1_base32(b))
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[h or ""]) if again else ("response", None))
        assert r["request"] and r["metadata"] and r["target_uri"] == (u or "") and (again or bytes(r["payload"]) == b)
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_warc_repeated_rows(spark):
    pages = [(1, "http://a", "one")] * 3 + [(1, "http://a", "two"), (1, "http://b", "one"), (2, "http://c", "one"), (None, "http://d", "none"), (None, "http://d", "none"), (3, "http://e", None), (3, "http://e", None)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["target_uri"], r["payload_bytes"], r["payload_digest"]) for r in got), key=key) == sorted(((i, u, len(h or ""), warc.sha1_base32((h or "").encode())) for i, u, h in pages), key=key)
    assert len({r["capture_id"] for r in got}) == len(pages) and all(r["request"] and r["metadata"] for r in got)
    assert sum(r["record_type"] == "response" for r in got) == len({h for _, _, h in pages})


def test_warc_malformed(spark, tmp_path):
    import gzip

    rec = lambda rid, body, n=None: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: " + rid + b"\r\nContent-Length: " + (b"%d" % len(body) if n is None else n) + b"\r\n\r\n" + body
    end = b"\r\n\r\n"
    files = {
        "a.gz": [gzip.compress(rec(b"<1>", b"x\r\n\r\n\r\ny\r\n\r\n") + end + rec(b"<2>", b"") + end), gzip.compress(rec(b"<3>", b"abc", b"x") + end + rec(b"<4>", b"ok") + end)],
        "b.gz": [gzip.compress(b"junk" + end + rec(b"<5>", b"good\r\n\r") + end + rec(b"<6>", b"abc", b"10"))],
        "c.gz": [gzip.compress(rec(b"<7>", b"toolong", b"3") + end + rec(b"<8>", b"") + end)],
    }
    for name, members in files.items():
        (tmp_path / name).write_bytes(b"".join(members))
    got = {r["record_id"]: (bytes(r["payload"]), r["error"]) for r in warc.read(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if v[1] is None} == {"<1>": (b"x\r\n\r\n\r\ny\r\n\r\n", None), "<2>": (b"", None), "<4>": (b"ok", None), "<5>": (b"good\r\n\r", None), "<8>": (b"", None)}
    assert {k: v[1] for k, v in got.items() if v[1]} == {"<3>": "no valid Content-Length", None: "no record", "<6>": "cut off", "<7>": "longer than Content-Length"}


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "u", "a", "x", 5)], "page_id long, url string, html string, payload string, digest long")
    assert [r["page_id"] for r in warc.round_trip(pages).collect()] == [1]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)) + rng.normal(size=(6, 16))[rng.integers(0, 6, 1500)] * 2
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None] + [0.0] * 14), (5200, [1.0])]
    df = spark.createDataFrame(rows + odd + [(1501, rows[0][1]), (1502, rows[0][1])], "vec_id long, embedding array<float>")
    got = ann.search(ann.usable(df), F.col("vec_id") % 50 == 0, 5, ann.Config(list_size=100)).collect()
    v = np.vstack([x.astype(np.float32), x[:1].astype(np.float32), x[:1].astype(np.float32)]).astype(float)
    ids = np.array([*range(1500), 1501, 1502])
    n = np.sqrt((v * v).sum(1))
    hits = total = 0
    for q in range(0, 1500, 50):
        s = v @ v[q] / (n * n[q])
        s[q] = -9
        best = set(ids[np.lexsort((ids, -s))[:5]])
        mine = {r["vec_id"] for r in got if r["query_id"] == q}
        hits += len(best & mine)
        total += 5
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 1500, 50))
    first = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert first[:2] == [(1, 1501), (2, 1502)]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert ann.search(ann.usable(few), F.col("vec_id") == 0).count() == 2
    assert ann.search(ann.usable(spark.createDataFrame([], "vec_id long, embedding array<float>")), F.col("vec_id") == 0).count() == 0


def test_ann_repeated_and_split(spark):
    """Repeated ids near a query cost no results; all lists probed and small parts give brute force exactly."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(160, 8)).astype(np.float32)
    x[1:12] = x[0] + 0.001 * rng.normal(size=(11, 8))
    rows = [(50, x[0])] + [(1, x[1])] * 6 + [(1, x[2])] * 6 + [(i, x[i]) for i in range(3, 160) if i != 50] + [(100, x[100])] * 3
    df = spark.createDataFrame([(i, [float(v) for v in r], 0.5, 1) for i, r in rows], "vec_id long, embedding array<float>, score double, rank int")
    cfg = ann.Config(list_size=20, probe=9.0, part=16, query_part=1)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 12)) for r in ann.search(ann.usable(df), F.col("vec_id") % 50 == 0, 5, cfg).collect())
    want = []
    for q in (50, 100, 150):
        qv = min(tuple(map(float, r)) for i, r in rows if i == q)
        best = {}
        for i, r in rows:
            if i != q:
                v = np.array(r, dtype=float)
                c = float((np.array(qv) * v).sum() / (np.sqrt((np.array(qv) ** 2).sum()) * np.sqrt((v * v).sum())))
                best[i] = max(best.get(i, -9), c)
        want += [(q, n + 1, i, round(c, 12)) for n, (i, c) in enumerate(sorted(best.items(), key=lambda b: (-b[1], b[0]))[:5])]
    assert got == sorted(want)


def brute(roles, cfg):
    """Least cost of a legal conversation, by a search over single edits: independent of the operator's tables."""
    import heapq

    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, 0, "")], set()
    while heap:
        cost, i, at = heapq.heappop(heap)
        if (i, at) in done:
            continue
        done.add((i, at))
        if i == len(roles) and at == "a":
            return cost
        for r in legal[at]:  # an empty turn
            heapq.heappush(heap, (cost + cfg.insert, i, r))
        if i < len(roles):
            for r in "sua":
                own = cost + (0 if roles[i] == {"s": "system", "u": "user", "a": "assistant"}[r] else cfg.relabel)
                if r in legal[at]:
                    heapq.heappush(heap, (own, i + 1, r))
                if r == at:
                    heapq.heappush(heap, (own + cfg.merge, i + 1, r))


@pytest.mark.parametrize("cfg", [chat.Config(), chat.Config(merge=5, relabel=5, insert=1), chat.Config(segment=2), chat.Config(merge=4, relabel=3, insert=2, segment=3)])
def test_chat(spark, cfg):
    rng = random.Random(10)
    rows = []
    for c in range(40):
        rows += [(c, t, rng.choice(["system", "user", "assistant", "tool", None]), rng.choice(["hi", "", None])) for t in range(rng.randint(1, 6))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(400)] + [(None, 0, "user", "q")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), cfg).collect()
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["pos"])
        cost = sum(cfg.relabel * ("relabel" in r["action"]) + cfg.merge * ("merge" in r["action"]) + cfg.insert * (len(r["inserted_before"]) + len(r["inserted_after"])) for r in mine)
        if len(mine) <= 6:
            assert cost == brute([r["role"] for r in mine], cfg)
        else:
            assert cost == 0
        text = "".join(r["rendered"] for r in mine)
        order = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert re.fullmatch(r"(s)?(ua)+", "".join(x[0] for x in order)) and text.count("<|im_end|>") == len(order)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a", "x")] * 5 + [(2, 0, None, None, "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = chat.format_chats(turns, chat.Config(segment=2)).orderBy("conv_id", "pos").collect()
    assert len(got) == 6 and [r["action"] for r in got] == ["keep", "merge", "merge", "merge", "relabel", "relabel"]
    assert "".join(r["rendered"] for r in got[:5]) == "<|im_start|>user\na\na\na\na<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert chat.format_chats(turns.limit(0)).count() == 0


def pipeline_tables(spark, d):
    rows, labels = toxic_rows(90)
    rng = random.Random(31)
    bench = " ".join(f"bench{k}" for k in range(14))
    near = rows[4][1].split()
    near[40] = "changed"
    docs = [(i, t, "en", "s", 7) for i, t in rows] + [
        (100, rows[1][1], "en", "s", 7), (101, "123 !", "en", "s", 7), (102, None, None, None, None), (103, rows[2][1] + " " + bench, "en", "s", 7), (104, " ".join(near), "en", "s", 7),
        (105, rows[5][1], "en", "s", 7), (105, rows[5][1], "en", "s", 7), (106, some_text(rng, 3000, 4000), "en", "s", 7), (107, "", "en", "s", 7), (None, rows[7][1] + " of no id", "en", "s", 7),
    ]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, _d long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return docs, labels, bench


def test_pipeline_brute_force(spark, tmp_path):
    """Every stage's rows against a plain version of it, on what the stage before left."""
    import corpus_pipeline as cp

    d = str(tmp_path)
    docs, labels, bench = pipeline_tables(spark, d)
    df = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    left = sorted([x[:2] for x in docs], key=key)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns
        out.write.parquet(f"{d}/{name}")
        df = spark.read.parquet(f"{d}/{name}")
        if name == "toxicity":
            held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
            model = toxicity.fit(toxicity.sample(spark.read.parquet(f"{d}/documents.parquet"), frame(spark, [x for x in labels if x[0] not in held], "doc_id long, toxic int")))
            s = toxicity.Scorer(model, toxicity.Config())
            left = [x for x in left if s.score(x[1]) < 0.5]
            assert not any(w in (t or "") for _, t in left for w in ("villainous", "rottenheart", "scoundrel")) and len(left) >= 65
        elif name == "language":
            left = [x for x in left if any(c.isalpha() for c in x[1] or "")]
        elif name == "near_duplicates":
            kept, sets = [], []
            for i, t in left:  # no chains of links here: each group is one row and its copies
                w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
                own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
                if i is None or not any(5 * len(own & o) >= 4 * len(own | o) for o in sets):
                    kept.append((i, t))
                    sets += [own] if i is not None else []
            left = kept
        elif name == "decontamination":
            left = [x for x in left if bench not in x[1]]
        assert sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=key) == left, name
    assert not {100, 101, 102, 103, 104, 107} & {i for i, _ in left} and [i for i, _ in left].count(105) <= 1
    v = tokens.WordVocabulary("word_bpe_49k.json")
    got = cp.run(spark, d).collect()
    want = []
    for i, t in left:
        ids = v.encode([t])[0] + b"\0\0\0\0"
        want += [(i, k, s, len(ids[4 * s : 4 * (s + 2048)]) // 4, zlib.crc32(ids[4 * s : 4 * (s + 2048)])) for k, s in enumerate(range(0, len(ids) // 4, 2048))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline as cp

    d = str(tmp_path)
    pipeline_tables(spark, d)
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    assert [stage(spark, empty, d).count() for _, stage in cp.STAGES] == [0] * 5
    unlabelled = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert [r["doc_id"] for r in cp.identified(spark, unlabelled, d).collect()] == [1]


def test_contamination_edges(spark):
    items = spark.createDataFrame([(1, "short item here")], "item_id long, text string")
    clash = frame(spark, [(1, "a short item here", "x", "y"), (1, "a short item here", "x", "y"), (2, "b", "x", "y")]).withColumns({"_d": F.lit(1), "_x": F.lit(2), "_t": F.lit(3), "n_hit": F.lit(4), "_w": F.lit(5)})
    assert [r["doc_id"] for r in contamination.clean(clash, items).collect()] == [2] and contamination.clean(clash, items).columns == clash.columns
    assert contamination.mark(clash, items).filter("n_hit = 3").count() == 2
    assert contamination.mark(clash.limit(0), items).count() == 0 and contamination.clean(clash.limit(0), items).count() == 0


def test_language_and_tokens_edges(spark):
    rows = [(i, ("kala malak " if i % 2 else "xiquo zoqui ") * 20, "aa" if i % 2 else "cc") for i in range(40)]
    docs = frame(spark, rows + rows[:1]).withColumns({"lang_pred": F.lit("x"), "n_tokens": F.lit("y"), "over_limit": F.lit(1)})
    model = language.fit(language.sample(docs))
    got = language.identify(docs, model)
    assert got.filter("doc_id = 0").select("lang_pred", F.col("score").cast("double")).distinct().count() == 1 and got.filter("doc_id = 0").count() == 2
    assert language.identify(docs.limit(0), model).count() == 0 and language.fit(language.sample(docs.limit(0))).langs == []
    # ties of the mixture go to the language whose name sorts first
    same = language.Model(["aa", "bb"], np.repeat(model.logp[:, :1], 2, axis=1))
    assert language.infer(["kala malak"], same, language.Config())[0][0] == "aa"
    t = tokens.count_tokens(docs)
    assert t.count() == 41 and t.schema["n_tokens"].dataType.simpleString() == "bigint" and tokens.count_tokens(docs.limit(0)).count() == 0


def test_language_mixture_brute_force():
    """Expectation-maximisation and the choice of the set, word by word in plain Python."""
    import itertools
    import math

    rng = np.random.default_rng(3)
    cfg = language.Config(bits=10)
    logp = np.log(rng.dirichlet(np.full(1 << 10, 0.3), size=3).T).astype(np.float32)
    model = language.Model(["aa", "bb", "cc"], logp)
    for n in (1, 4, 30):
        text = " ".join("".join(rng.choice(list("abcdef"), size=rng.integers(1, 6))) for _ in range(n))
        like = []
        for w in text.split():
            h = language.trigrams([w], 10)[0]
            ll = [float(sum(logp[x, k] for x in h)) for k in range(3)]
            like.append([math.exp(max(x - max(ll), -60)) for x in ll])

        def em(pi, steps):
            for _ in range(steps):
                new = [0.0] * 3
                for r in like:
                    z = sum(r[k] * pi[k] for k in range(3))
                    for k in range(3):
                        new[k] += r[k] * pi[k] / max(z, 1e-30) / len(like)
                pi = new
            return pi, sum(math.log(max(sum(r[k] * pi[k] for k in range(3)), 1e-30)) for r in like)

        full, _ = em([1 / 3] * 3, cfg.rounds)
        order = sorted(range(3), key=lambda k: -full[k])
        best = None
        for size in (1, 2, 3):
            own = order[:size]
            if size == 1:
                pi, ll = em([1.0 if k in own else 0.0 for k in range(3)], 0)
            else:
                z = sum(full[k] + 1e-6 for k in own)
                pi, ll = em([(full[k] + 1e-6) / z if k in own else 0.0 for k in range(3)], cfg.rounds // 2)
            score = ll - 0.5 * math.log(len(like) + 1) * (size - 1)
            if best is None or score > best[0] + 1e-4:
                best = (score, pi)
        got = language.infer([text], model, cfg)[0]
        top = max(range(3), key=lambda k: best[1][k])
        assert got[0] == model.langs[top] and abs(got[1] - best[1][top]) < 1e-3
        assert set(got[2]) == {model.langs[k] for k in range(3) if best[1][k] > 1e-4}, list(itertools.chain(got[2]))
