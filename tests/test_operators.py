import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, matching, pages, retrieval, verification, views
from quarry.functions import text as T
from quarry.plans import catalog, hybrid
from quarry.sources import corpus, files, store
from quarry.streaming import ingest

CHUNKS = [("c1", "d1", "Deterministic guardrails prevent LLM hallucinations."), ("c2", "d2", "Cooking Italian pasta requires boiling salted water."), ("c3", "d3", "Zero hallucination guarantees are achieved via strict context grounding.")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_matches_whole_words_only(spark):
    q = frame(spark, [("q", "hallucinations guardrails"), ("n", None), ("e", "")], "query_id string, query string")
    w = retrieval.chunk_words(frame(spark, CHUNKS, "chunk_id string, doc_id string, content string"))
    got = retrieval.bm25(q, retrieval.postings(w), retrieval.corpus_stats(w), 2).collect()
    assert [(r.query_id, r.chunk_id, r.score, r.rank) for r in got] == [("q", "c1", 2.251084, 1)]


def test_dense_hash_search(spark):
    c = frame(spark, [("c1", "Quantum computing algorithms for cryptography."), ("c2", "Baking chocolate chip cookies at home."), ("c3", "")], "chunk_id string, content string")
    v = retrieval.hash_embeddings(retrieval.chunk_words(c))
    q = retrieval.embedded_queries(frame(spark, [("q", "quantum cryptographic algorithms")], "query_id string, query string"))
    got = retrieval.dense(q, v, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c1", 0.565559), ("c2", 0.153533)]


def test_fusion_and_ties(spark):
    rows = [("q", 0, 1.0, "A", 1), ("q", 0, 1.0, "B", 2), ("q", 1, 1.0, "B", 1), ("q", 1, 1.0, "C", 2), ("t", 0, 1.0, "Z", 1), ("t", 1, 1.0, "A", 1)]
    got = retrieval.fuse(frame(spark, rows, "query_id string, list_no int, weight double, chunk_id string, rank int")).orderBy("query_id", "rank").collect()
    assert [r.chunk_id for r in got] == ["B", "A", "C", "Z", "A"]
    assert round(got[0].score, 7) == 0.0325225
    with pytest.raises(ValueError):
        retrieval.fuse(frame(spark, rows, "query_id string, list_no int, weight double, chunk_id string, rank int"), k=0)


def test_rerank_drops_noise(spark):
    c = frame(spark, [("r", "Strict Pydantic JSON schema enforcers eliminate parsing crashes."), ("n", "The weather in Seattle is rainy in November."), ("e", "")], "chunk_id string, content string")
    q = frame(spark, [("q", "JSON schema enforcer crash elimination")], "query_id string, query string")
    cand = frame(spark, [("q", "r", 1), ("q", "n", 2), ("q", "e", 3)], "query_id string, chunk_id string, rank int")
    assert [(r.chunk_id, r.score) for r in retrieval.rerank(cand, q, retrieval.chunk_words(c), 0.0, 5).orderBy("rank").collect()] == [("r", 0.655), ("n", 0.1)]
    assert [r.chunk_id for r in retrieval.rerank(cand, q, retrieval.chunk_words(c), 0.3, 5).collect()] == ["r"]


def test_upsert_keeps_ordinals(spark):
    old = frame(spark, [("a", 1, 0), ("b", 2, 1)], "id string, v int, ordinal long")
    new = frame(spark, [("b", 9), ("c", 3)], "id string, v int")
    assert sorted(map(tuple, retrieval.upsert(old, new, "id").select("id", "v", "ordinal").collect())) == [("a", 1, 0), ("b", 9, 1), ("c", 3, 2)]


def test_verdicts(spark):
    c = frame(spark, CHUNKS, "chunk_id string, doc_id string, content string")
    ctx = frame(spark, [("q", "c1", 1), ("q", "c3", 2)], "query_id string, chunk_id string, rank int")
    a = frame(spark, [("q", 1, "Deterministic guardrails prevent hallucinations with strict grounding."), ("q", 1, "Deterministic guardrails prevent hallucinations with strict grounding."), ("q", 2, "Kubernetes clusters require etcd, Redis caches and PostgreSQL storage engines everywhere."), ("q", 3, None), ("x", 1, "Nothing known about this particular subject whatsoever.")], "query_id string, attempt int, response string")
    got = {(r.query_id, r.attempt): r for r in verification.verdicts(a, ctx, c).collect()}
    assert len(got) == 4
    assert got["q", 1].is_valid and got["q", 1].faithfulness == 1.0
    assert got["q", 2].reason == "UngroundedClaim" and not got["q", 2].is_valid
    assert got["q", 3].reason == "UngroundedClaim"
    assert got["x", 1].reason == "ContextDeficit"
    out = {r.query_id: r for r in verification.supervise(frame(spark, [("q",), ("x",)], "query_id string"), verification.verdicts(a, ctx, c), ctx).collect()}
    assert (out["q"].state, out["q"].attempts) == ("Completed", 1)
    assert (out["x"].state, out["x"].reason, out["x"].attempts) == ("FallbackDispatched", "ContextDeficit", 0)
    trips = {(r.query_id, r.attempt): r.trips for r in verification.breaker(verification.verdicts(a, ctx, c)).collect()}
    assert trips == {("q", 1): False, ("q", 2): False, ("q", 3): True, ("x", 1): True}


def _shuffled(spark):
    """Bytes of shuffle files written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_evidence_moves_pairs_not_words(spark):
    texts = [". ".join(f"regimen {' '.join(f'factor{(7 * i + 3 * n + w) % 40:02d}' for w in range(12))}" for n in range(12)) for i in range(40)]
    c = frame(spark, [(f"c{i}", f"d{i}", x) for i, x in enumerate(texts)], "chunk_id string, doc_id string, content string")
    ctx = frame(spark, [(f"q{q}", f"c{(q + r) % 40}", r) for q in range(200) for r in range(1, 6)], "query_id string, chunk_id string, rank int")
    a = frame(spark, [(f"q{q}", 1, texts[q % 40] + ".") for q in range(200)], "query_id string, attempt int, response string")
    before = _shuffled(spark)
    got = verification.evidence(a, ctx, c).collect()
    assert len(got) == 2400 and all(r.support_ratio == 1.0 and r.line_matches == 13 for r in got)
    assert _shuffled(spark) - before < 500_000  # words of pairs exploded took 1.6 MB


@pytest.mark.parametrize("hot", [store.HOT_ROWS, 1])
def test_evidence(spark, monkeypatch, hot):
    monkeypatch.setattr(store, "HOT_ROWS", hot)
    c = frame(spark, [("c1", "d1", "Alpha.\nBeta guardrails prevented it - guardrails prevent hallucinations"), ("c2", "d2", "guardrails prevent hallucination. Guardrails; prevent hallucination"), ("c3", None, None), (None, "d4", "guardrails prevent hallucinations")], "chunk_id string, doc_id string, content string")
    ctx = frame(spark, [("q", "c3", 1), ("q", "c1", 2), ("q", "c2", 3), ("q", "gone", 4), ("q", None, 5), ("r", "c2", 1)], "query_id string, chunk_id string, rank int")
    a = frame(spark, [("q", 1, "Guardrails prevent preventing hallucinations. Alpha alphabets alphas unknown words. Right?"), ("q", 2, None), ("r", 1, "Some guardrails prevent hallucinations entirely."), ("x", 1, "Nothing known about guardrails."), (None, 1, "Guardrails without any query.")], "query_id string, attempt int, response string")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in verification.evidence(a, ctx, c).collect()}
    assert got == {
        ("q", 1, 1): (True, 1.0, 4, "d1", "guardrails prevent hallucinations"),  # of equal lines that of the first rank
        ("q", 1, 2): (True, 0.6, None, None, None),  # the line is too short to be evidence
        ("q", 1, 3): (True, 1.0, None, None, None),
        ("r", 1, 1): (True, 0.6, 3, "d2", "guardrails prevent hallucination"),
        ("x", 1, 1): (False, 0.0, None, None, None),
        (None, 1, 1): (False, 0.0, None, None, None),
    }


def test_lines_of_kernels(spark, small):
    odd = ["", None, "-", "a-b c--dd e-ff-g. gg -hh- ii-\nşş-İİ • x_y‿z.é́-é́é", " \t\x0b lead-ing\r\n.. trail \f.\n-\n", "one line without any end", "𝒜𝒜-𝒜. 𝒜b"]
    c = spark.read.parquet(f"{small}/corpus_chunks.parquet").select("content").union(frame(spark, [(x,) for x in odd], "content string"))
    lines = F.transform(T.evidence_lines(F.col("content")), lambda x: F.struct(x.alias("line"), T.tokens(x).alias("words")))
    n = 0
    for r in c.select("content", lines.alias("lines"), T.tokens(F.col("content")).alias("words"), F.array_join(T.tokens_and_ends(F.col("content")), " ").alias("both")).collect():
        parts = [(x.strip(matching.SPACE), [w for w in y.split() if len(w) > 1]) for x, y in zip(matching._PARTS.split(r.content or ""), matching._PARTS.split(r.both), strict=True)]
        assert [(x, y) for x, y in parts if x] == [(x.line, x.words) for x in r.lines or []]
        assert [w for w in r.both.split() if len(w) > 1] == r.words
        n += len(parts)
    assert n > 300


def test_stems_and_keys_of_kernels(spark, small):
    odd = ["ies", "aies", "glasses", "asses", "boss", "as", "running", "ing", "red", "seed", "evlerinin", "kalemlerdir", "İstanbul", "strasse-haus", "x_y", "naïves", "işleri", "mektedir", "𝒜bcdes"]
    w = spark.read.parquet(f"{small}/corpus_chunks.parquet").select(F.explode(T.tokens(F.col("content"))).alias("w")).union(frame(spark, [(x,) for x in odd], "w string")).distinct()
    stems = {r.w: r.s for r in w.select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert len(stems) > 300 and {x: matching.stem(x) for x in stems} == stems
    some = [*sorted(set(stems.values()))[::7], "abc", "abcd", "abcde", "abcdef", "abcdxy", "ab"]
    match = lambda a, b: a == b or (min(len(a), len(b)) >= 4 and a[: min(len(a), len(b), 5)] == b[: min(len(a), len(b), 5)])
    assert all(match(a, b) == bool({*matching.probe_keys(a)} & {*matching.build_keys(b)}) for a in some for b in some)


def test_ranking_metrics(spark):
    r = frame(spark, [("q", "x", 1), ("q", "a", 2), ("q", "b", 3)] + [("f", str(i), i) for i in range(1, 5)] + [("f", "a", 5)], "query_id string, chunk_id string, rank int")
    rel = frame(spark, [("q", "a"), ("q", "b"), ("q", "c"), ("q", "a"), ("f", "a")], "query_id string, chunk_id string")
    got = {x.query_id: x for x in verification.ranking_metrics(r, rel, 3).collect()}
    assert [round(v, 3) for v in got["q"][1:]] == [0.667, 0.667, 0.5, 0.531]
    assert [round(v, 3) for v in got["f"][1:]] == [0.0, 0.0, 0.2, 0.0]


TEXT = "Deterministic guardrails are critical for LLM reliability. They eliminate hallucinations in production. Clean Architecture ensures maintainability."


def test_chunks(spark):
    assert chunking.chunk_spans(TEXT, 15, 2) == [(0, 58), (50, 103), (95, 147)]
    with pytest.raises(ValueError):
        chunking.chunk_spans(TEXT, 5, 5)
    d = frame(spark, [("d", TEXT, {"k": "v"}), ("e", "", None), ("n", None, None), ("w", " \n ", None)], "doc_id string, content string, meta map<string,string>")
    got = chunking.chunk_documents(d, metadata="meta", max_tokens=15, overlap=2).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in got] == ["d_c0", "d_c1", "d_c2"]
    assert got[1].content.startswith("ability.") and got[0].metadata["k"] == "v" and got[2].metadata["chunk_index"] == "2"


def test_chunks_keep_decimals_and_abbreviations():
    text = "The groups differed (mean 4.1 vs. 5.2, P = 0.002) at once. " * 30
    for s, e in chunking.chunk_spans(text, 20, 4):
        assert e - s <= 81 and not text[s:e].rstrip().endswith(("P = 0.", "vs."))


def test_page_cleaning(spark):
    p = frame(spark, [("x Cite this article as: A B. Title here. Some Journal. 2020\n45;1\nABSTRACT text 10.1234/ab.c.;", "C oronary A patient", "12  Running head - 3")], "p string, d string, h string")
    cite = pages.citation(F.col("p"))
    a, j = pages.citation_parts(cite)
    r = p.select(cite.alias("c"), a.alias("a"), j.alias("j"), pages.doi(F.col("p")).alias("doi"), pages.drop_caps(F.col("d")).alias("d"), pages.header_line(F.col("h")).alias("h"), pages.body_start(F.col("p")).alias("b")).first()
    assert (r.a, r.j, r.doi, r.d, r.h) == ("A B", "Some Journal", "10.1234/ab.c", "Coronary Apatient", "Running head")
    assert r.b.startswith("ABSTRACT text")


def test_headers(spark):
    rows = [("f", i, f"{i} The running head of it\nbody {i}\nfoot") for i in (1, 2, 3)] + [("g", 1, "other page\nbody"), ("g", 2, None)]
    got = {(r.file, r.page_no): r.removed for r in pages.strip_headers(frame(spark, rows, "file string, page_no int, text string")).collect()}
    assert got == {("f", 1): 1, ("f", 2): 1, ("f", 3): 1, ("g", 1): 0, ("g", 2): 0}


def test_views(spark):
    pts = frame(spark, [("q", "a", "a1", 0.10), ("q", "a", "a2", 0.12), ("q", "b", "b1", 0.15), ("q", "b", "b2", 0.30), ("q", "c", "c1", 0.33)], "query_id string, doc string, chunk_id string, distance double")
    assert sorted((r.a, r.b) for r in views.bridges(pts).collect()) == [("a1", "b1"), ("a2", "b1"), ("b2", "c1")]
    assert [r.chunk_id for r in views.nearest(pts, 2).orderBy("rank").collect()] == ["a1", "a2"]
    assert views.polar(pts).count() == 5


def test_line_locator(spark):
    t = frame(spark, [("d", "alpha beta gamma\nsecond line with some words\nthird")], "doc_id string, content string")
    q = frame(spark, [("1", "d", "nothing", "1. second LINE with"), ("2", "d", "alpha and gamma meet", None), ("3", "d", "none here", "zz")], "row_id string, doc_id string, sentence string, snippet string")
    assert sorted(map(tuple, views.locate_lines(q, t).collect())) == [("1", 1), ("2", 0), ("3", -1)]


def test_corpus_round_trip(spark, tmp_path):
    d = frame(spark, [("a", "x", 1), ("b", "y", 2)], "id string, content string, size int")
    c = frame(spark, [("a_c0", "a"), ("b_c0", "b"), ("b_c1", "b")], "chunk_id string, doc_id string")
    nd, nc = corpus.save(d, c, frame(spark, [("b", "z", 3)], "id string, content string, size int"), frame(spark, [("b_c0", "b")], "chunk_id string, doc_id string"))
    assert sorted(r.content for r in nd.collect()) == ["x", "z"] and nc.count() == 2
    left, gone = corpus.delete(nd, nc, frame(spark, [("b",)], "id string"))
    assert [r.id for r in left.collect()] == ["a"] and [r.chunk_id for r in gone.collect()] == ["a_c0"]
    path = str(tmp_path / "docs")
    corpus.write(spark, d, path)
    corpus.write(spark, spark.read.parquet(path).where("id = 'a'"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == ["a"]
    corpus.clear(spark, spark.read.parquet(path), path)
    assert spark.read.parquet(path).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿  Parasetamol içerir \n", encoding="utf-8")
    (tmp_path / "b.png").write_text("no")
    (tmp_path / "c.pdf").write_bytes(b"page one is long enough|x")
    (tmp_path / "d.pdf").write_bytes(b"broken")
    r = files.read_text(spark, str(tmp_path / "*.*")).collect()
    assert [(x.doc_id, x.content, x.metadata["FileType"]) for x in r] == [("a.md", "Parasetamol içerir", "MD")]

    def extract(data):
        if data == b"broken":
            raise ValueError("encrypted")
        return data.decode().split("|")

    p = {x.doc_id: x for x in files.read_pages(spark, str(tmp_path / "*"), extract).collect()}
    assert p["c.pdf#Sayfa_2"].metadata["IsScannedOrImageOnly"] == "True" and p["c.pdf#Sayfa_1"].content == "page one is long enough"
    assert p["d.pdf#Sayfa_0"].metadata["Error"] == "encrypted"
    s = files.split_inline(frame(spark, [("Doküman 1: a\n\nDoküman 2: b",)], "content string")).collect()
    assert [tuple(x) for x in s] == [("doc_1", "Doküman 1: a"), ("doc_2", "Doküman 2: b")]


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "chunk_id string, content string, arrived_at timestamp"
    for rows in ([("a", "1", "2024-01-01 00:00:00"), ("b", "1", "2024-01-01 00:00:00")], [("a", "2", "2024-01-01 01:00:00")]):
        spark.createDataFrame(rows, "chunk_id string, content string, at string").selectExpr("chunk_id", "content", "cast(at as timestamp) AS arrived_at").write.mode("append").parquet(src)
        ingest.upsert_stream(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination(120)
    assert sorted((r.chunk_id, r.content) for r in spark.read.parquet(out).collect()) == [("a", "2"), ("b", "1")]


def test_no_cartesian_product(spark, small):
    from quarry.plans import catalog

    for name in ("bm25_topk", "grounding_sentences"):
        assert "CartesianProduct" not in catalog.queries()[name](spark, small)._jdf.queryExecution().toString()


def test_upsert_numbers_rows_in_ranges_of_keys(spark):
    keys = [f"k{i:04}" for i in range(3000)]
    df = spark.createDataFrame([(k, 0) for k in reversed(keys)], "id string, v int")
    old = retrieval.ordinals(df.where("id < 'k2000'"), "id")
    assert [r.ordinal for r in old.orderBy("id").collect()] == list(range(2000))
    out = retrieval.upsert(old, df.where("id >= 'k1990'").withColumn("v", F.lit(1)), "id")
    assert [(r.id, r.ordinal, r.v) for r in out.orderBy("id").collect()] == [(k, i, int(i >= 1990)) for i, k in enumerate(keys)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_bucket#" in plan and "row_number() windowspecdefinition(id#" not in plan
    assert retrieval.ordinals(df.limit(0), "id").count() == 0
    some = spark.createDataFrame([(None,), (5,), (3,)], "id int")
    assert [(r.id, r.ordinal) for r in retrieval.ordinals(some, "id").orderBy("ordinal").collect()] == [(None, 0), (3, 1), (5, 2)]


def test_mrr_looks_at_the_whole_fused_list(spark, tmp_path):
    hits = [("q", f"c{i:05}", "BM25_Sparse", i) for i in range(1, 1501)]
    frame(spark, hits, "query_id string, chunk_id string, retrieval_type string, rank int").write.parquet(f"{tmp_path}/hits.parquet")
    frame(spark, [("q", "x", ["c01200"])], "query_id string, query string, expected_chunk_ids array<string>").write.parquet(f"{tmp_path}/queries.parquet")
    assert [tuple(r) for r in catalog.ranking_metrics(spark, str(tmp_path)).collect()] == [("q", 0.0, 0.0, round(1 / 1200, 6), 0.0)]


def test_ties_go_by_chunk_order(spark, monkeypatch):
    c = frame(spark, [(f"d_c{i}", "d", i, "same words here") for i in (10, 2, 0)] + [("a_c0", "a", 0, "other")], "chunk_id string, doc_id string, chunk_index int, content string")
    i = hybrid.build(c)
    q = frame(spark, [("q", "same words")], "query_id string, query string")
    want = ["d_c0", "d_c2", "d_c10"]
    assert [r.chunk_id for r in retrieval.bm25(q, i.postings, i.stats, 5).orderBy("rank").collect()] == want
    assert [r.chunk_id for r in retrieval.dense(retrieval.embedded_queries(q), i.vectors, 3).orderBy("rank").collect()] == want
    many = frame(spark, [(f"q{k}", "same words") for k in range(9)], "query_id string, query string")
    plain = sorted(map(tuple, retrieval.dense(retrieval.embedded_queries(many), i.vectors, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.dense(retrieval.embedded_queries(many), i.vectors, 3).collect())) == plain
    assert [r.chunk_id for r in retrieval.bm25(many, i.postings, i.stats, 3).where("query_id = 'q4'").orderBy("rank").collect()] == want


def _no_pairs(monkeypatch, k, queries):
    """Fails where words of chunks are stored, or more rows than the best of each partition are ranked."""
    stored, top = store.stored, retrieval.top

    def small_top(df, by, order, n):
        if by == ["query_id"]:
            assert df.count() <= k * queries * df.rdd.getNumPartitions()
        return top(df, by, order, n)

    def no_words(df):
        assert "w" not in df.columns
        return stored(df)

    monkeypatch.setattr(store, "stored", no_words)
    monkeypatch.setattr(retrieval, "top", small_top)


def _many(spark, n=400):
    c = spark.range(n).selectExpr("concat('d_c', id) AS chunk_id", "concat('d', id % 7) AS doc_id", "cast(id AS int) AS chunk_index", "concat_ws(' ', 'same words', concat('n', id % 5), concat('m', id % 11)) AS content")
    return c, frame(spark, [(f"q{i}", f"same n{i % 5} m{i % 11}") for i in range(30)], "query_id string, query string")


def test_bm25_stores_no_pairs(spark, tmp_path, monkeypatch):
    c, q = _many(spark)
    c.write.parquet(f"{tmp_path}/corpus_chunks.parquet")
    q.selectExpr("concat('q', cast(substr(query_id, 2) AS int) * 50) AS query_id", "query").write.parquet(f"{tmp_path}/queries.parquet")
    _no_pairs(monkeypatch, 5, 30)
    got = catalog.bm25_topk(spark, str(tmp_path)).where("query_id = 'q150'").orderBy("rank").collect()
    # chunks with both words first, in the order of document and index; then those with the rarer word
    assert [r.chunk_id for r in got] == ["d_c168", "d_c113", "d_c58", "d_c3", "d_c388"] and len({r.score for r in got}) == 1


def test_dense_stores_no_pairs(spark, tmp_path, monkeypatch):
    c, q = _many(spark)
    c.write.parquet(f"{tmp_path}/corpus_chunks.parquet")
    q.selectExpr("concat('q', cast(substr(query_id, 2) AS int) * 50) AS query_id", "query").write.parquet(f"{tmp_path}/queries.parquet")
    _no_pairs(monkeypatch, 5, 30)
    got = catalog.dense_topk_hash(spark, str(tmp_path)).where("query_id = 'q150'").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["d_c168", "d_c113", "d_c58", "d_c3", "d_c388"] and len({r.score for r in got}) == 1


def test_hybrid_stores_no_words_and_stems_candidates_only(spark, monkeypatch):
    c, q = _many(spark)
    _no_pairs(monkeypatch, 6, 30)
    got = hybrid.retrieve(q, hybrid.build(c), k=3)
    assert [r.chunk_id for r in got.where("query_id = 'q3'").orderBy("rank").collect()] == ["d_c168", "d_c113", "d_c58"]
    plan = retrieval.chunk_stems(retrieval.chunk_words(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan


def test_parameters(spark):
    c = frame(spark, CHUNKS, "chunk_id string, doc_id string, content string")
    i, q = hybrid.build(c, dims=128), frame(spark, [("q", "hallucinations guardrails")], "query_id string, query string")
    assert retrieval.bm25(q, i.postings, i.stats, 2, k1=0.0).first().score != retrieval.bm25(q, i.postings, i.stats, 2).first().score
    v = i.vectors.where("chunk_id = 'c1'").first().vec
    assert len(v) == 128 and v[:32] == v[32:64] and abs(sum(x * x for x in v) - 1) < 1e-9
    got = hybrid.retrieve(frame(spark, [("q", "strict context grounding"), ("b", " ")], "query_id string, query string"), i, k=2, cutoff=0.1, dims=128).collect()
    assert {r.query_id for r in got} == {"q"} and got[0].chunk_id == "c3"


def test_index_is_written_and_upserted(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "chunk_id string, doc_id string, chunk_index int, content string"
    assert hybrid.write_index(spark, frame(spark, [("a", "d", 0, "alpha beta"), ("b", "d", 1, "gamma")], schema), path)
    assert not hybrid.write_index(spark, frame(spark, [], schema), path)
    assert hybrid.write_index(spark, frame(spark, [("b", "d", 1, "delta"), ("c", "d", 2, "alpha")], schema), path)
    i = hybrid.read_index(spark, path)
    assert {r.chunk_id for r in i.postings.collect()} == {"b", "c"} and i.stats.first().n == 2
    assert [(r.chunk_id, r.ordinal) for r in i.vectors.orderBy("ordinal").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    got = hybrid.retrieve(frame(spark, [("q", "alpha")], "query_id string, query string"), i, k=1)
    assert [r.chunk_id for r in got.collect()] == ["c"]


def test_dosages_run_over_chunks(spark):
    c = frame(spark, [("c1", "the dose is 500"), ("c2", "mg daily"), ("c3", "5 KAPSÜL")], "chunk_id string, content string")
    ctx = frame(spark, [("q", "c1", 1), ("q", "c2", 2), ("r", "c2", 1), ("r", "c1", 2), ("s", "c3", 1)], "query_id string, chunk_id string, rank int")
    a = frame(spark, [("q", 1, "Take 500mg or 2 ml."), ("r", 1, "500 mg"), ("s", 1, "5 Kapsül"), ("t", 1, "7 mg"), ("u", 1, None)], "query_id string, attempt int, response string")
    got = {r.query_id: (r.extracted, r.missing, r.is_valid, r.lost) for r in verification.dosage_check(a, ctx, c).collect()}
    assert got == {"q": (2, 1, False, ["2ml"]), "r": (1, 1, False, ["500mg"]), "s": (1, 0, True, []), "t": (1, 1, False, ["7mg"]), "u": (0, 0, True, [])}


def test_headings_in_any_case(spark):
    rows = [("Başlık\nözet burada", "özet burada"), ("x\nÖzet\ny", "Özet\ny"), ("KLİNİK x\ncite THIS article AS: a\nrest", "rest"), ("none", "none")]
    got = frame(spark, [(i, a) for i, (a, _) in enumerate(rows)], "i int, p string").select("i", pages.body_start(F.col("p")).alias("b"), pages.without_badges(F.lit("klinik çalışma\nx Review Article y")).alias("w")).orderBy("i").collect()
    assert [r.b for r in got] == [b for _, b in rows] and got[0].w == "x y"


def test_page_metadata_wins(spark):
    m = pages.page_metadata(F.create_map(F.lit("FileType"), F.lit("MD"), F.lit("k"), F.lit("v")), F.lit("f"), F.lit(2), F.lit(3), F.lit(True))
    assert spark.range(1).select(m.alias("m")).first().m == {"k": "v", "SourceFile": "f", "PageNumber": "2", "TotalPages": "3", "FileType": "PDF", "IsScannedOrImageOnly": "True"}
    none = pages.page_metadata(F.lit(None).cast("map<string,string>"), F.lit("f"), F.lit(1), F.lit(1), F.lit(False))
    assert len(spark.range(1).select(none.alias("m")).first().m) == 5


def test_messages_and_prompts(spark):
    c = frame(spark, CHUNKS, "chunk_id string, doc_id string, content string")
    ctx = frame(spark, [("q", "c1", 2), ("q", "c3", 1)], "query_id string, chunk_id string, rank int")
    a = frame(spark, [("q", 1, "Kubernetes clusters require etcd, Redis caches and guardrails everywhere."), ("q", 2, "Strict context grounding prevents hallucinations."), ("q", 3, None), ("x", 1, "Nothing known.")], "query_id string, attempt int, response string")
    v = verification.verdicts(a, ctx, c)
    m = {(r.query_id, r.attempt): r.messages for r in v.collect()}
    assert m["q", 1] == ['Ungrounded claim detected at sentence 1 (Support: 12.5 %): "Kubernetes clusters require etcd, Redis caches and guardrails everywhere."']
    assert m["q", 2] == [] and m["q", 3] == [verification.EMPTY_ANSWER] and m["x", 1] == [verification.NO_CONTEXT]
    p = {(r.query_id, r.attempt): r.prompt for r in verification.prompts(frame(spark, [("q", "Why?"), ("x", None)], "query_id string, query string"), v, ctx, c).collect()}
    assert p["q", 1].startswith("### SOURCE CONTEXT DOCUMENTS:\n[DOC_1]: Zero") and "FEEDBACK" not in p["q", 1] and p["q", 1].endswith("### USER QUERY:\nWhy?\n\n### FACTUAL ANSWER (Ground directly in DOCs):\n")
    assert "- Ungrounded claim" in p["q", 2] and "FEEDBACK" not in p["q", 3]


def test_typed_json_codes(spark):
    raws = ['{"ID": "a", "n": 1}', "```json\n{'id': 'a', 'n': 2,\n```", '{"id": 5}', "null", " ", None, "no json", '{"id": "a", "n": "1"}', "[1]", '{"n": 3} // note', "4.8 for"]
    df = frame(spark, list(enumerate(raws)), "i int, raw string")
    got = [(r.x.code, r.x.value and tuple(r.x.value)) for r in df.select("i", T.typed_json(F.col("raw"), {"id": "string", "n": "bigint"}).alias("x")).orderBy("i").collect()]
    bad = ("SchemaViolation", None)
    assert got == [(None, ("a", 1)), (None, ("a", 2)), bad, ("NullParsedObject", None), ("EmptyOutput", None), ("EmptyOutput", None), bad, bad, bad, (None, (None, 3)), bad]
    raw = [r.c for r in df.select("i", T.raw_json_code(F.col("raw")).alias("c")).orderBy("i").collect()]
    assert raw == [None, "InvalidJson", None, None, "EmptyOutput", "EmptyOutput", "InvalidJson", None, None, "InvalidJson", "InvalidJson"]


def test_hot_keys_are_spread(spark, monkeypatch):
    left = store.stored(spark.range(3000).selectExpr("if(id < 2900, 'hot', concat('k', id)) AS key", "id"))
    right = frame(spark, [("hot", 1)] + [(f"k{i}", i) for i in range(2900, 3100)], "key string, v long")
    plain = sorted(map(tuple, left.join(right, "key").collect()))
    monkeypatch.setattr(store, "HOT_ROWS", 500)
    assert sorted(map(tuple, store.skew_join(left, right, "key").collect())) == plain
    monkeypatch.setattr(store, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, store.skew_join(left, right, "key").collect())) == plain


def test_hot_chunk_gives_the_same_verdicts(spark, small, monkeypatch):
    plain = sorted(map(tuple, catalog.grounding_verdicts(spark, small).collect()))
    monkeypatch.setattr(store, "HOT_ROWS", 2)
    assert sorted(map(tuple, catalog.grounding_verdicts(spark, small).collect())) == plain


def test_a_cut_off_replacement_is_ended(spark, tmp_path):
    path = str(tmp_path / "t")
    assert corpus.read(spark, path) is None
    spark.range(3).write.parquet(f"{path}.new")
    spark.range(2).write.parquet(f"{path}.old")
    assert corpus.read(spark, path).count() == 3
    corpus.write(spark, spark.range(5), path)
    assert corpus.read(spark, path).count() == 5 and not (tmp_path / "t.new").exists() and not (tmp_path / "t.old").exists()


def test_ingest(spark):
    p = frame(spark, [("f", 1, "One sentence here."), ("f", 2, "  "), ("f", 3, "Another one. " * 200), ("g", 1, None)], "file string, page_no int, text string")
    d, c = corpus.ingest(p)
    r = d.first()
    assert d.count() == 1 and (r.file, r.total_pages, r.total_characters) == ("f", 2, 18 + 2 + 2600) and r.total_chunks == c.count() > 2
    assert {x.chunk_id for x in c.collect()} >= {"f#Sayfa_1_c0", "f#Sayfa_3_c0"} and {x.doc_id for x in c.collect()} == {"f"}


def test_bridge_counts_are_counts_of_bridges(spark, small):
    pts = catalog._points(spark, small)
    want = {(r.query_id, r.a): r.n for r in views.bridges(pts, near=0.9).groupBy("query_id", "a").agg(F.count("*").alias("n")).collect()}
    assert {(r.query_id, r.a): r.n_bridges for r in views.bridge_counts(pts, near=0.9).collect()} == want and want


def test_streamed_buckets(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.range(40).selectExpr("concat('c', id) AS chunk_id", f"'{k}' AS content", f"timestamp'2024-01-0{k + 1}' AS arrived_at").where("id < 40" if k == 0 else "id < 1").write.mode("append").parquet(src)
        ingest.upsert_stream(spark.readStream.schema("chunk_id string, content string, arrived_at timestamp").parquet(src), out, str(tmp_path / "cp"), buckets=8).awaitTermination(120)
    got = {r.chunk_id: r.content for r in spark.read.parquet(out).collect()}
    assert len(got) == 40 and got["c0"] == "1" and got["c1"] == "0"
