"""Semantic chunks, the knowledge graph, screening details, builder and sinks, on small inputs worked out by hand."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.functions.dialect import prepare
from textmill.operators import adversarial, chunking, knowledge, metacognition, semantic_chunks, stats
from textmill.plans.builder import DatasetBuilder
from textmill.sources import sinks

S = ["Cats sleep.", "They rest because they are tired.", "Hence they dream.", "Ships sail on seas.", "However storms come.", "Fish swim."]
V = np.array([[1, 0], [1, 0.1], [1, 0.2], [0, 1], [0, 1], [1, 0]], dtype=float)


def test_chains_and_arguments():
    v = semantic_chunks.unit(V)
    got = semantic_chunks.chains(S, v, 0.7)
    assert [(k, at) for k, at, _ in got] == [("causal", [0, 1, 2]), ("contrast", [3, 4])]
    assert got[1][2] == pytest.approx(1.0) and got[0][2] == pytest.approx(np.mean([v[0] @ v[1], v[1] @ v[2]]))
    a = semantic_chunks.arguments(["I claim it is so.", "Studies show it.", "Therefore it is.", "Clearly more.", "Nothing here.", "I claim again.", "According to all, yes."])
    assert a == [{"claim": [0], "evidence": [1], "conclusion": [2]}, {"claim": [5], "evidence": [6], "conclusion": []}]
    assert semantic_chunks.arguments(["Therefore."]) == []


def test_boundaries():
    cfg = semantic_chunks.Config(least=1, target=4, most=6)
    v = semantic_chunks.unit(V)
    ends = semantic_chunks.boundaries(S, v, cfg)
    assert ends[-1] == 6 and 3 not in ends  # the dip between sentence 3 and 4 comes when the chunk has more words than allowed
    assert semantic_chunks.boundaries(S, v, semantic_chunks.Config(least=1, target=4, most=50)) == [3, 5, 6]
    assert semantic_chunks.boundaries(S[:2], v[:2], cfg) == [2]
    long = ["one two three four five."] * 5
    same = semantic_chunks.unit(np.ones((5, 2)))
    assert semantic_chunks.boundaries(long, same, semantic_chunks.Config(least=100, target=8, most=10)) == [2, 5]
    assert semantic_chunks.keep_chains([2, 5, 6], [("causal", [0, 1, 2], 0.9)]) == [3, 5, 6]
    assert semantic_chunks.keep_chains([1, 6], [("causal", [0, 1, 2, 3], 0.9)]) == [1, 6]
    assert semantic_chunks.keep_chains([2, 6], [("causal", [1, 2, 3, 4], 0.9)]) == [1, 6]
    assert semantic_chunks.keep_chains([2, 6], [("causal", [0, 1, 2], 0.5)]) == [2, 6]


def test_semantic_chunks(spark):
    at = {s: v for s, v in zip(S, V)}
    df = spark.createDataFrame([(1, " ".join(S)), (2, None), (3, "One sentence only")], "doc_id long, text string")
    cfg = semantic_chunks.Config(least=1, target=4, most=50)
    out = semantic_chunks.semantic_chunks(df, lambda s: np.array([at.get(x, [1.0, 0.0]) for x in s]), cfg)
    rows = out.orderBy("doc_id", "chunk_ix").collect()
    assert [(r["doc_id"], r["start_sentence"], r["end_sentence"]) for r in rows] == [(1, 0, 2), (1, 3, 4), (1, 5, 5), (3, 0, 0)]
    assert rows[0]["text"] == " ".join(S[:3]) and rows[0]["semantic_type"] == "reasoning" and rows[0]["chains"][0]["sentence_count"] == 3 and rows[2]["coherence"] == 0.5
    d = {r["doc_id"]: r for r in semantic_chunks.document_coherence(out).collect()}
    assert d[1]["chunks"] == 3 and d[1]["semantic_coherence"] == pytest.approx(np.mean([r["coherence"] for r in rows[:3]]))
    assert [r["s"] for r in df.select(F.explode(semantic_chunks.sentences(F.col("text"))).alias("s")).collect()] == [*S, "One sentence only"]
    assert semantic_chunks.complexity_of("because it rains. it pours") == pytest.approx(0.4 * 5 / 2 / 20 + 0.4 * 4 / 5 + 0.2 * 0.1)


def test_knowledge_graph(spark):
    names = {"Dr. Ann Lee": "PERSON", "Acme corp": "ORG", "Paris": "GPE"}
    found = lambda texts: [[(k, v, 0.9 if k == "Paris" else 0.8) for k, v in names.items() if k in t] + [(k.upper(), v, 0.95) for k, v in names.items() if k.upper() in t] for t in texts]
    df = spark.createDataFrame([(1, "Ann met. Dr. Ann Lee runs Acme corp in Paris! PARIS is in a study because data was used in 1999"), (2, "nothing")], "doc_id long, text string")
    g = {r["doc_id"]: r for r in knowledge.knowledge_graph(df, found).collect()}
    e = {x["entity"]: x for x in g[1]["entities"]}
    assert set(e) == {"Dr. Ann Lee", "Acme corp", "Paris"} and e["Paris"]["confidence"] == 0.95
    assert (e["Dr. Ann Lee"]["canonical_form"], e["Dr. Ann Lee"]["entity_type"], e["Dr. Ann Lee"]["properties"]) == ("Dr. Ann Lee", "person", ["has_title"])
    assert e["Acme corp"]["canonical_form"] == "Acme Corp" and e["Acme corp"]["properties"] == ["company"] and e["Paris"]["entity_type"] == "location"
    assert [(r["subject"], r["object"], r["predicate"]) for r in g[1]["relations"]] == [("Acme corp", "Paris", "co_occurs_with")]
    fact = g[1]["facts"][0]
    assert fact["fact_type"] == "causal" and fact["entities"] == ["Paris"] and fact["confidence"] == pytest.approx(0.9)
    assert g[1]["confidence_score"] == pytest.approx(np.mean([np.mean([0.8, 0.8, 0.95]), 0.3, 0.9]))
    assert g[2]["confidence_score"] == 0.5 and g[2]["entities"] == [] and g[2]["facts"] == []
    t = spark.createDataFrame([("o'neil mc-DONALD x2y",)], "t string")
    assert t.select(knowledge.title_case(F.col("t")).alias("x")).first()["x"] == "o'neil mc-DONALD x2y".title()


def test_indicators_and_opposites(spark):
    text = "Old people are slow, and some old people are STUBBORN. It is always right to be here. It is never wrong to go."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    rows = adversarial.indicators(df, {"age_bias": adversarial.BIAS["age_bias"]}, 5).orderBy("start").collect()
    assert [(r["match"], text[r["start"] : r["end"]].lower(), r["context"]) for r in rows] == [("old people are slow",) * 2 + ("Old people are slow, and",), ("old people are stubborn",) * 2 + ("some old people are STUBBORN. It ",)]
    assert [(r["first"], r["second"]) for r in adversarial.opposed_pairs(df).collect()] == [(1, 2)]
    assert adversarial.opposed_pairs(df, lambda s: np.eye(len(s))).first()["similarity"] == 0.0
    assert adversarial.opposed_pairs(df, lambda s: np.ones((len(s), 2))).count() == 0
    got = adversarial.classify_windows(spark.createDataFrame([(1, "x" * 900 + "bad"), (2, None)], "doc_id long, text string"), lambda w: [float("bad" in x) for x in w])
    assert {r["doc_id"]: (r["toxicity"], r["windows"]) for r in got.collect()} == {1: (1.0, 3), 2: (0.0, 1)}


def test_metacognition_golden(spark):
    """Worked out by hand from the definitions."""
    from textmill.functions.dialect import SPARK, evaluate, prepare

    df = spark.createDataFrame([(1, "It must clearly work. It is quite odd, rather odd."), (2, "")], "doc_id long, text string")
    f = {**metacognition.implicit_confidence(SPARK), **metacognition.factors(SPARK)}
    got = {r["doc_id"]: r for r in evaluate(prepare(df), f).collect()}
    assert got[1]["implicit_confidence"] == 0.5 and got[2]["implicit_confidence"] == 0.5
    assert float(got[1]["avg_sentence_length"]) == 5.0 and float(got[1]["lexical_diversity"]) == pytest.approx(0.9) and float(got[2]["avg_word_length"]) == 0.0
    pre = metacognition.prerequisites(SPARK)
    out = evaluate(evaluate(prepare(spark.createDataFrame([(1, "theorem proof algorithm software")], "doc_id long, text string")), pre), metacognition.ranked_prerequisites(SPARK)).first()["prerequisites"]
    assert out.split(",")[0].startswith(("mathematics:1000", "computer_science:1000")) and out.endswith("technical_literacy:700")
    d = spark.createDataFrame([("history",), ("other",)], "d string").select(metacognition.described(F.col("d")).alias("x")).collect()
    assert d[0]["x"].startswith("Historical") and d[1]["x"] == "other knowledge and concepts"
    o = metacognition.objectives_table(spark.createDataFrame([(1, "define and list, then design")], "doc_id long, text string")).collect()
    assert {r["level"]: r["bloom"] for r in o}.items() <= metacognition.BLOOM_NUMBERS.items() and {"remember", "create"} <= {r["level"] for r in o}


def test_builder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    good = " ".join(f"word{i}" for i in range(60)) + " by mail a@b.org or 555-123-4567."
    (src / "a.txt").write_text(good)
    (src / "b.txt").write_bytes("caf\xe9 ".encode("latin-1") * 20)
    (src / "c.docx").write_bytes(b"broken")
    table = spark.createDataFrame([("t1", good + " more")], "id string, text string")
    pages = spark.createDataFrame([(1, "http://x/", "<p>home</p><a href='/b'>b</a>"), (2, "http://x/b", "<p>second</p>"), (3, "http://y/", "no")], "page_id long, url string, html string")
    told = []
    b = DatasetBuilder(spark, {"quality_threshold": None}).add_directory(str(src)).add_table(table).add_website("http://x/", pages)
    b.register_extractor("lines", lambda s, path, **k: s.read.text(path).withColumnRenamed("value", "text")).add("lines", str(src / "a.txt"))
    with pytest.raises(ValueError):
        b.add("unknown", "x")
    raw = b.rows().collect()
    assert {r["source_kind"] for r in raw} == {"file", "table", "website", "lines"} and sum(r["error"] is not None for r in raw) == 1
    out = b.process(progress=lambda share, what: told.append(share), chunking_strategy="fixed", chunk_size=20)
    rows = out.collect()
    assert told == [0.0, 0.6, 1.0] and len(rows) == 6 and not any("555-123" in r["text"] for r in rows)
    b.export(str(tmp_path / "out"), "jsonl")
    back = sinks.from_jsonl(spark, str(tmp_path / "out"))
    assert back.count() == 6 and sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in rows)
    b.export(str(tmp_path / "folder"), "folder")
    assert spark.read.parquet(str(tmp_path / "folder" / "data")).count() == 6 and "text: string" in (tmp_path / "folder" / "README.md").read_text()
    b.export(str(tmp_path / "csv"), "csv", columns=["id", "text"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == 6
    with pytest.raises(ValueError):
        b.export(str(tmp_path / "z"), "xml")
    b.save_config(str(tmp_path / "c.json"))
    assert DatasetBuilder(spark, str(tmp_path / "c.json")).config == b.config
    b.clear()
    with pytest.raises(ValueError):
        b.rows()


def test_stats_and_udtf(spark):
    df = spark.createDataFrame([(1, "x" * 30, [1, 2], "a"), (2, None, None, "b")], "doc_id long, text string, chunks array<int>, source string")
    assert stats.summary(df).first()["total_chunks"] == 2
    r = stats.recommendations(stats.preview_metrics(df), has_labels=True).first()["recommendations"]
    assert len(r) == 2 and stats.recommendations(stats.preview_metrics(df)).first()["recommendations"][-1].startswith("There are no labels")
    assert "<td>total_documents</td><td>2</td>" in stats.report(df)
    assert {x["bucket"]: x["n"] for x in stats.distribution(spark.createDataFrame([(0.1,), (0.6,), (0.9,), (None,)], "v double"), "v", [0.5, 0.8]).collect()} == {0: 1, 1: 1, 2: 1}
    spark.udtf.register("chunks_of", chunking.udtf_chunks(20, 5))
    words = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(50)))], "doc_id long, text string")
    words.createOrReplaceTempView("udtf_words")
    got = [tuple(x) for x in spark.sql("SELECT c.text, c.start_index, c.end_index, c.word_count FROM udtf_words, LATERAL chunks_of(text) c ORDER BY 2").collect()]
    want = [(r["text"], r["start_index"], r["end_index"], r["word_count"]) for r in chunking.explode_chunks(chunking.chunk(words, "sliding_window", 20, 5)).orderBy("chunk_ix").collect()]
    assert got == want
    with pytest.warns(UserWarning):
        chunking.chunk(words, "unheard of")


def test_streams(spark, tmp_path):
    """The same columns on a stream: cleaned and redacted rows, repeated texts once, counts by window."""
    from textmill.streaming import stream

    rows = [("2024-01-01 00:01:00", "a", "mail <b>x</b> 555-123-4567"), ("2024-01-01 00:02:00", "a", "mail <b>x</b> 555-123-4567"), ("2024-01-01 00:12:00", "b", "other")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts string, kind string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "kind", "text").write.parquet(src)

    def run(make, name, mode="append"):
        q = make(spark.readStream.schema("ts timestamp, kind string, text string").parquet(src)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [r.asDict() for r in spark.table(name).collect()]

    assert sorted(r["text"] for r in run(stream.clean_stream, "cleaned_rows")) == ["mail x [PHONE]", "mail x [PHONE]", "other"]
    assert len(run(lambda d: stream.dedup_stream(d, "ts"), "distinct_rows")) == 2
    counts = run(lambda d: stream.windowed_counts(d, "ts", "kind"), "counted_rows", "complete")
    assert sorted((r["kind"], r["n"]) for r in counts) == [("a", 2), ("b", 1)]
    assert re.match("2024-01-01 00:00", str(min(r["window"]["start"] for r in counts)))


def test_facts_are_measured_once(spark):
    # each cue was a regular expression of the plan, once for the filter and once for the column
    df = prepare(spark.createDataFrame([(1, "According to research the river is 1200 miles long. I think it is not. Short.")], "doc_id long, text string"))
    out = knowledge.facts(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 0 and plan.count("ArrowEvalPython") == 1
    assert [(r["statement"], round(r["confidence"], 6), r["fact_type"]) for r in out.collect()] == [("According to research the river is 1200 miles long", 0.9, "empirical")]
