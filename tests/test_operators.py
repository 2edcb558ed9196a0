"""Golden values and restatements of the operators on small inputs."""

import hashlib
import io
import random
import re
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from textmill.operators import chunking, clean, dedup, quality
from textmill.plans.pipeline import Pipeline, default_pipeline
from textmill.sources import files, sinks, web


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("<p>This is <b>HTML</b> content</p>", "This is HTML content"),
    ("Visit https://example.com or http://test.org for more", "Visit or for more"),
    ("Contact us at test@example.com or admin@site.org", "Contact us at or"),
    ("Too    many     spaces\n\n\nand lines", "Too many spaces and lines"),
    ("", ""), (None, ""),
])
def test_clean(spark, text, want):
    assert one(spark, text, clean.clean(F.col("text"))) == want


def test_redact(spark):
    r = lambda t, **k: one(spark, t, clean.redact(F.col("text"), **k))
    assert r("Call me at 555-123-4567 or 555.987.6543") == "Call me at [PHONE] or [PHONE]"
    assert r("id 1234567890") == "id [PHONE]"
    assert r("SSN: 123-45-6789") == "SSN: [SSN]"
    assert r("Card: 4111-1111-1111-1111") == "Card: [CREDIT_CARD]"
    assert r("Server IP: 192.168.1.1", method="remove") == "Server IP: "
    assert r("mail a@b.org", method="hash").startswith("mail [EMAIL_") and len(r("mail a@b.org", method="hash")) == len("mail [EMAIL_12345678]")
    assert r("code X1", custom=[(r"X\d", "$1")]) == "code $1"
    # a match is hashed where it stands, not where its letters stand inside others
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()[:8]
    assert r("id 5551234567 and ref 95551234567 or 555-123-4567", method="hash") == f"id [PHONE_{h('5551234567')}] and ref 95551234567 or [PHONE_{h('555-123-4567')}]"
    assert r(None, method="hash") == "" and r("x", method="hash", custom=[("x", "[R]")]) == "[R]"
    with pytest.raises(ValueError):
        clean.redact(F.col("text"), "other")


def test_redact_entities(spark):
    names = lambda texts: [[(m.start(), m.end(), "PERSON") for m in re.finditer("Ann|Bob Lee|Bob", t)] for t in texts]
    df = spark.createDataFrame([(1, "Ann met Bob Lee."), (2, None)], "id long, text string")
    one = lambda **k: [r["text"] for r in clean.redact_entities(df, names, **k).orderBy("id").collect()]
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()[:8]
    assert one() == ["[PERSON] met [PERSON].", ""] and one(method="remove") == [" met .", ""]
    assert one(method="hash") == [f"[PERSON_{h('Ann')}] met [PERSON_{h('Bob Lee')}].", ""]


def test_clean_chunks_and_options(spark):
    df = spark.createDataFrame([(1, "ﬁne <b>x</b>", ["<i>ﬁ</i>  y", None])], "id long, text string, c array<string>").withColumn("chunks", F.transform("c", lambda x: F.struct(x.alias("text"), F.lit(1).alias("k"))))
    r = clean.clean_documents(df).first()
    assert r["text"] == "fine x" and [(c["text"], c["k"]) for c in r["chunks"]] == [("fi y", 1), ("", 1)]
    r = clean.clean_documents(df, clean.CleanConfig(fix_unicode=False)).first()
    assert r["text"] == "ﬁne x" and r["chunks"][0]["text"] == "ﬁ y"
    assert one(spark, "Hello! @#$ World?", clean.clean(F.col("text"), clean.CleanConfig(remove_special_chars=True, lowercase=True))) == "hello world"


def test_dedup_keeps_one_null(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "a"), (5, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in dedup.dedup_documents(df, ["doc_id"]).collect()} == {1, 2, 5}
    assert {r["doc_id"] for r in dedup.dedup_documents(df, ["doc_id"], dedup.seen_hashes(df.filter("doc_id < 3"))).collect()} == {5}


def test_basic_quality(spark):
    want = {
        "": 0.0, "Too short": 0.8, "Only five words here now": 0.8, "This is normal text with proper punctuation.": 0.790909091, "THIS IS ALL UPPERCASE TEXT": 0.7,
        "###!!!@@@###!!!@@@" * 10: 0.6, " ".join(["word"] * 50): 0.812765957, " ".join(["repeat"] * 100): 0.806185567, " ".join(f"word{i}" for i in range(50)): 1.0,
    }
    got = {r["text"]: r["quality_score"] for r in quality.score(spark.createDataFrame([(t,) for t in want], "text string")).collect()}
    assert {k: round(float(v), 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert quality.basic_score(None) == (0.0, 0.0)


def test_repetition():
    """Against the definition, word by word."""

    def plain(t):
        w = t.lower().split()
        return 0.0 if len(w) < 10 else sum(" ".join(w[i : i + 3]) in " ".join(w[i + 3 :]) for i in range(len(w) - 6)) / max(len(w) - 3, 1)

    rng = random.Random(5)
    for n, letters in ((0, "a"), (9, "ab"), (12, "a"), (60, "ab"), (200, "abc"), (300, "ab")):
        for _ in range(20):
            t = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n))
            assert quality.repetition(t) == plain(t)
    assert quality.repetition(" ".join(f"w{i % 7919}" for i in range(120_000))) > 0.9


def test_language_and_chunk_filters(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "der Hund und die Katze"), (3, "zzz qqq"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in df.select("doc_id", quality.detect_language(F.col("text")).alias("x")).collect()}
    assert got == {1: "en", 2: "de", 3: "unknown", 4: "unknown"}
    good = " ".join(f"word{i}" for i in range(50)) + "."
    rows = spark.createDataFrame([(1, good, [good, "bad"]), (2, "bad", [good]), (3, good, None)], "doc_id long, text string, c array<string>").withColumn("chunks", F.transform("c", lambda x: F.struct(x.alias("text")))).drop("c")
    out = {r["doc_id"]: r["chunks"] for r in quality.quality_filter(rows, 0.9).collect()}
    assert set(out) == {1, 3} and [c["text"] for c in out[1]] == [good] and out[3] is None
    assert quality.quality_filter(rows.drop("chunks"), 0.0, scorer="semantic").count() == 3
    assert {r["doc_id"] for r in quality.quality_filter(df, 0.0, ["de"]).collect()} == {2}
    with pytest.raises(ValueError):
        quality.quality_filter(df, scorer="other")


def test_chunk_counts(spark):
    t = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    n = lambda *a: len(chunking.explode_chunks(chunking.chunk(df, *a)).collect())
    assert n("fixed", 10) == 0
    assert n("sliding_window", 20, 5) == 3
    assert [r["word_count"] for r in chunking.explode_chunks(chunking.chunk(df, "sliding_window", 30, 5)).orderBy("chunk_ix").collect()] == [30, 25]
    with pytest.raises(ValueError):
        chunking.chunk(df, "sliding_window", 5, 5)


def test_empty_texts_have_no_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    for s in ("fixed", "sliding_window", "sentence", "paragraph", "sections"):
        assert chunking.explode_chunks(chunking.chunk(df, s, 10, 2)).count() == 0


def test_dedup(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, "c")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dedup.dedup_documents(df, ["doc_id"]).collect()) == [1, 2, 4]
    seen = dedup.seen_hashes(df.filter("doc_id = 4"))
    assert sorted(r["doc_id"] for r in dedup.dedup_documents(df, ["doc_id"], seen).collect()) == [1, 2]


def test_dedup_similar(spark):
    base = "The quick brown fox jumps over the lazy dog near the river bank today"
    df = spark.createDataFrame([(1, base), (2, base + "."), (3, "Something else entirely, with other words in it"), (4, base + "!")], "k long, text string")
    assert sorted(r["k"] for r in dedup.dedup_similar(df, "k", 0.9).collect()) == [1, 3]


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_similar_pairs(spark, threshold):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n))
    rows = []
    for n in [1, 2, 5, 12, 24, 24, 40, 40, 100, 100, 150, 400] * 3:
        t = text(n)
        rows.append(t)
        for every in (20, 21, 30):  # edits spread evenly: replaced, then deleted and inserted
            rows.append("".join("Z" if i % every == every // 2 else c for i, c in enumerate(t)))
            rows.append("".join(("" if i % (2 * every) == 7 else c + "Y" * (i % (2 * every) == 27)) for i, c in enumerate(t)))
    rows += [rows[0], rows[40], rows[40], None, "", "ünï" * 30, "ünï" * 29 + "x"]
    rng.shuffle(rows)
    got = {(r["a"], r["b"]): r["ratio"] for r in dedup.similar_pairs(spark.createDataFrame(list(enumerate(rows)), "k long, text string"), "k", threshold).collect()}
    want = {(i, j): r for i, u in enumerate(rows) for j, v in enumerate(rows) if i < j and u and v and (r := SequenceMatcher(None, u, v).ratio()) >= threshold}
    assert got == want and len(want) > 60


def test_similar_pairs_writes_rows_by_text(spark, monkeypatch):
    # unrelated texts of common parts: what is written between steps has a row for a text, not for a character, and few pairs are compared in full
    rng, rows, cut, parts = random.Random(5), {}, dedup.cut, "the |er|on|th|an|re |tion |ing |ou|ea|st|nd |in|wh|ble |ly |of |sh".split("|")
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([60, 200]) if i else 30)) for i in range(300)]
    texts.append("x" + texts[0])

    def counted(df, name):
        out = cut(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(dedup, "cut", counted)
    assert [(r["a"], r["b"]) for r in dedup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()] == [(0, 300)]
    assert max(rows.values()) <= len(texts)


def test_similar_blocks():
    # classes over the limit are divided, small neighbours share a block, and every pair of lengths within the ratio is in one pair of blocks
    blocks, pairs = dedup.blocks_of({10: 5, 11: 5, 300: 25, 302: 3, 900: 1}, 10, 0.95)
    assert [b for b in blocks if b[1] == 300] == [(1, 300, 3, 0), (2, 300, 3, 1), (3, 300, 3, 2)]
    assert blocks[:2] == [(0, 10, 1, 0), (0, 11, 1, 0)] and len(set(pairs)) == len(pairs)
    assert {(1, 1), (1, 2), (1, 3), (2, 3), (3, 4), (4, 4)} <= set(pairs) and (0, 1) not in pairs


def test_dedup_similar_chain(spark):
    # each text is similar to its neighbours only, so that a round decides two rows
    n, width = 70, 40
    chars = "".join(chr(0x4E00 + i) for i in range(n * 2 + width))
    rows = [(i, chars[2 * i : 2 * i + width]) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, text string")
    kept = []
    for i, t in rows:
        if not any(SequenceMatcher(None, u, t).ratio() >= 0.94 for _, u in kept):
            kept.append((i, t))
    assert len(kept) == n // 2
    assert sorted(tuple(r) for r in dedup.dedup_similar(df, "k", 0.94).collect()) == kept


def test_web(spark):
    html = '<html lang="en"><head><title>T &amp; x</title><meta property="og:description" content="d"><script>bad()</script></head><body><nav>no</nav><p>Hello <b>you</b></p><a href="/a#f">l</a><a href="mailto:x@y">m</a></body></html>'
    pages = spark.createDataFrame([(1, "http://h/x", html), (2, "http://h/a", None), (3, "http://h/b", '<a href="http://h/a">z</a>')], "page_id long, url string, html string")
    r = {x["page_id"]: x for x in web.parse_pages(pages).collect()}
    assert r[1]["text"] == "T & x\nHello\nyou\nl\nm" and r[1]["description"] == "d" and r[1]["links"] == ["http://h/a"] and r[1]["language"] == "en"
    assert r[2]["text"] == "" and r[2]["links"] == []
    assert sorted((x["url"], x["depth"]) for x in web.crawl(pages, ["http://h/x"]).collect()) == [("http://h/a", 1), ("http://h/x", 0)]
    rules = spark.createDataFrame([("h", "*", "/a")], "host string, user_agent string, disallow string")
    assert sorted(x["page_id"] for x in web.robots_allowed(pages, rules).collect()) == [1, 3]
    assert web.domain_filter(pages, blocked=["h"]).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo".encode("latin-1"))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b.getvalue())
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.bin").write_bytes(b"?")
    r = {x["file_name"]: x for x in files.extract(spark, str(tmp_path)).collect()}
    assert set(r) == {"a.txt", "b.docx", "c.docx"}
    assert r["a.txt"]["text"] == "héllo" and r["a.txt"]["metadata"]["encoding"] == "latin-1"
    assert r["b.docx"]["text"] == "One\nx\ty" and r["b.docx"]["error"] is None and r["c.docx"]["error"]


def test_sinks_and_pipeline(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>Some</b> words here, mail a@b.org and more of them to pass the filter now"), (2, "x")], "doc_id long, text string")
    out = default_pipeline(chunking_strategy="sliding_window", quality_threshold=0.7, add_metacognitive_annotations=True, enable_adversarial_testing=True).process(df)
    assert {"chunks", "metacognition", "requires_review", "issues", "quality_score"} <= set(out.columns)
    sinks.to_jsonl(out, str(tmp_path / "j"), compress=True)
    assert spark.read.json(str(tmp_path / "j")).count() == out.count()
    sinks.to_csv(out, str(tmp_path / "c"))
    sinks.to_parquet(out, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == out.count()
    p = Pipeline().add_step(lambda d, n: d.withColumn("n", F.lit(n)), n=3)
    assert p.process(df).first()["n"] == 3


def test_sections(spark):
    """Sections and rule-based sections against a restatement."""
    rng = random.Random(17)
    line = lambda: rng.choice(["Topic one: words follow", "# head", "* item", "- dash", "1. first", "ALL CAPS", "plain text. More text! End", "because it is so", "", "Über alles"]) + " " + " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(40)))
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 14))) for _ in range(60)] + ["", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def sentence_chunks(t, size, least):
        out, cur, n = [], [], 0
        for x in re.split("[.!?]+", t):
            k = len(x.split())
            if n + k > size and cur:
                out.append(" ".join(cur))
                cur, n = [], 0
            cur.append(x)
            n += k
        return out + [t for t in [" ".join(cur)] if cur and len(t) >= least]

    def plain(t, size=64, least=100):
        out = []
        for x in re.split(r"\n(?=[A-Z#*-])", t):
            out += sentence_chunks(x, size, least) if len(x.split()) > size else [x] if len(x) >= least else []
        return out

    got = {}
    for r in chunking.explode_chunks(chunking.chunk(df, "sections", 64)).orderBy("doc_id", "chunk_ix").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: c for i, t in enumerate(texts) if (c := plain(t))}

    def rules(t):
        parts = [t]
        for p in chunking.SECTION_STARTS:
            parts = [y for x in parts for y in re.split(p, x)]
        return [x for x in map(str.strip, parts) if x and len(x.split()) >= 25] or [t]

    got = {r["doc_id"]: [c["text"] for c in r["chunks"]] for r in chunking.chunk(df, "semantic").collect()}
    assert got == {i: rules(t) for i, t in enumerate(texts)}


def test_page_texts(spark):
    """Pages made of known parts: what is dropped, what is kept, and links."""
    rng = random.Random(19)
    rows, want = [], {}
    for i in range(40):
        body, text, links = [], [], set()
        for _ in range(rng.randrange(8)):
            w = f"word{rng.randrange(1000)}"
            kind = rng.choice(["p", "nav", "script", "footer", "a", "br", "entity"])
            if kind == "a":
                body.append(f"<a href='/x{w}#frag'>{w}</a><a href='mailto:a@b.c'> </a>")
                text.append(w)
                links.add(f"http://h{i}.org/x{w}")
            elif kind == "br":
                body.append(f"{w}<br>")
                text.append(w)
            elif kind == "entity":
                body.append(f"<div>{w} &amp; &eacute;</div>")
                text.append(f"{w} & é")
            else:
                body.append(f"<{kind}>{w}</{kind}>")
                text += [w] if kind == "p" else []
        rows.append((i, f"http://h{i}.org/", f"<html lang='de'><head><title>T {i}</title><meta property='og:description' content='d{i}'></head><body>{''.join(body)}</body></html>"))
        want[i] = (f"T {i}", "de", f"d{i}", sorted(links), "\n".join([f"T {i}", *text]))
    rows += [(100, None, None)]
    want[100] = ("", "", "", [], "")
    got = {r["page_id"]: (r["title"], r["language"], r["description"], r["links"], r["text"]) for r in web.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_hash_uses_the_text_once(spark):
    # each kind used the text of the kind before twice, so that the last pattern stood 32 times in the plan
    df = spark.createDataFrame([("a.b@c.org, 555-123-4567, 123-45-6789",), (None,)], "text string").select(clean.redact(F.col("text"), "hash").alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("@[A-Za-z0-9.-]+") <= 2
    assert [r["t"].count("[") for r in df.collect()] == [3, 0]


@pytest.mark.parametrize("name", ["clean", "quality", "chunks", "opposites", "indicators"])
def test_python_holds_slices_of_batches(spark, monkeypatch, name):
    # before, all rows of an Arrow batch were Python objects at once
    import inspect

    from textmill.operators import adversarial, semantic_chunks

    f = {"clean": clean.nfkc, "quality": quality.basic_quality, "chunks": semantic_chunks.semantic_chunks, "opposites": adversarial.opposed_pairs, "indicators": adversarial.indicators}[name]
    assert "slices(" in inspect.getsource(f) and "mapInPandas" not in inspect.getsource(f) and "pandas_udf" not in inspect.getsource(f)
    df = spark.createDataFrame([(i, f"Text ｎumber {i} is true. It is not true; all of it is false." * (i % 3)) for i in range(450)] + [(450, None)], "doc_id long, text string").repartition(1)
    if name == "clean":
        assert sorted(r[0] for r in df.select(clean.clean(F.col("text"))).collect()) == sorted(" ".join(((f"Text number {i} is true. It is not true; all of it is false." * (i % 3)) if i < 450 else "").split()) for i in range(451))
    elif name == "quality":
        assert {r["doc_id"]: (r["repetition_ratio"], r["quality_score"]) for r in quality.score(df).collect()} == {r["doc_id"]: quality.basic_score(r["text"]) for r in df.collect()}
    elif name == "opposites":
        assert adversarial.opposed_pairs(df).groupBy("doc_id").count().count() == 300
    elif name == "chunks":
        assert semantic_chunks.semantic_chunks(df, semantic_chunks.hashed_words()).groupBy("doc_id").count().count() == 300


def test_quality_filter_scores_once(spark, tmp_path):
    # the filter was moved before the cleaning and the spreading, and the score computed on either side
    spark.createDataFrame([(i, "word " * 30) for i in range(8)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    d = quality.quality_filter(clean.clean_documents(spark.read.parquet(str(tmp_path / "t")).repartition(4), clean.CleanConfig(fix_unicode=False)), 0.5).select("doc_id", clean.redact(F.col("text")).alias("text"), "quality_score")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Repartition")
