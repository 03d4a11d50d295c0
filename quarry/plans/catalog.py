"""Registered queries of the core: each takes (spark, sf_dir) and runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, pages, retrieval, verification, views
from quarry.plans import hybrid
from quarry.sources import corpus, files, store

#: Tables whose rows take long to work on. Smaller than one input split, a table would be one task; it is spread over the cores first.
_TEXTS = ("corpus_documents", "corpus_chunks", "attempts", "queries")
SPLIT_BYTES = 128 << 20


def _t(s: SparkSession, sf: str, name: str) -> DataFrame:
    df = s.read.parquet(f"{sf}/{name}.parquet")
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) if name in _TEXTS else SPLIT_BYTES
    return df.repartition(s.sparkContext.defaultParallelism) if size < SPLIT_BYTES else df


def _long(c: str):
    return F.col(c).cast("long").alias(c)


def _asked(s: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: every query whose number is divisible by 50."""
    return _t(s, sf, "queries").where(F.expr("cast(substr(query_id, 2) AS bigint) % 50 = 0"))


def _lists(s: SparkSession, sf: str) -> DataFrame:
    """Sparse and dense hits as ranked lists; a repeated chunk counts at its best rank."""
    h = _t(s, sf, "hits").where("retrieval_type IN ('BM25_Sparse', 'Dense_Cosine')")
    d = h.groupBy("query_id", "retrieval_type", "chunk_id").agg(F.min("rank").alias("r"))
    w = Window.partitionBy("query_id", "retrieval_type").orderBy("r", "chunk_id")
    return d.select("query_id", "chunk_id", F.when(F.col("retrieval_type") == "BM25_Sparse", 0).otherwise(1).alias("list_no"), F.lit(1.0).alias("weight"), F.row_number().over(w).alias("rank"))


def _context(s: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """The fused context of each query, computed once for all its readers."""
    return store.stored(retrieval.fuse(_lists(s, sf), limit=k))


def _verdicts(s: SparkSession, sf: str, context: DataFrame | None = None) -> DataFrame:
    return verification.verdicts(_answers(s, sf), _context(s, sf) if context is None else context, _t(s, sf, "corpus_chunks"))


def _answers(s: SparkSession, sf: str) -> DataFrame:
    return store.stored(_t(s, sf, "attempts").groupBy("query_id", "attempt").agg(F.max("response").alias("response")))


def _words(s: SparkSession, sf: str) -> DataFrame:
    return retrieval.chunk_words(_t(s, sf, "corpus_chunks"))


def _pages(s: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of stored documents as the pages of a file."""
    d = _t(s, sf, "corpus_documents").select(F.col("id").alias("file"), F.posexplode(F.split("content", "\n\n")).alias("page_no", "text"))
    return d.select("file", (F.col("page_no") + 1).alias("page_no"), "text")


def _points(s: SparkSession, sf: str) -> DataFrame:
    """Distances of the stated query vectors to all vectors; the label stands for the document."""
    e = _t(s, sf, "embeddings")
    q = store.small(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")))
    d = F.round(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(T.cosine(F.col("qv"), F.col("embedding")), F.lit(0.0)))), 4)
    return e.join(q, how="cross").select("query_id", F.col("label").alias("doc"), F.col("vec_id").alias("chunk_id"), d.alias("distance"))


def tokenize_stats(s, sf):
    t = _t(s, sf, "corpus_documents").select("id", T.tokens(F.col("content")).alias("w"))
    return t.select("id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def stem_vocab(s, sf):
    terms = _t(s, sf, "corpus_chunks").select(F.explode(T.tokens(F.col("content"))).alias("term")).distinct()
    return terms.select("term", T.stem(F.col("term")).alias("stem"))


def content_tokens(s, sf):
    q = _t(s, sf, "queries").select("query_id", T.tokens(F.col("query")).alias("w"))
    return q.select("query_id", *[F.size(T.without(F.col("w"), stop)).cast("long").alias(n) for n, stop in (("rerank_n", T.RERANK_STOP), ("guard_n", T.GUARD_STOP), ("triad_n", T.TRIAD_STOP))])


def sentence_stats(s, sf):
    t = _t(s, sf, "corpus_documents").select("id", T.sentences(F.col("content")).alias("x"))
    return t.select("id", F.size("x").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("x", F.length)), F.lit(0)).cast("long").alias("longest"))


def evidence_line_stats(s, sf):
    t = _t(s, sf, "corpus_chunks").select("chunk_id", T.evidence_lines(F.col("content")).alias("x"))
    return t.select("chunk_id", F.size("x").cast("long").alias("n_lines"), F.size(F.filter("x", lambda l: F.length(l) >= 10)).cast("long").alias("n_usable"))


def bigram_counts(s, sf):
    t = _t(s, sf, "queries").select("query_id", T.bigrams(T.stems(T.tokens(F.col("query")))).alias("b"))
    return t.select("query_id", F.size("b").cast("long").alias("n_bigrams"), F.size(F.array_distinct("b")).cast("long").alias("n_distinct"))


def conversational_sentences(s, sf):
    x = verification.answer_sentences(_answers(s, sf), T.GUARD_STOP)
    return x.groupBy("query_id", "attempt").agg(F.count("*").alias("n_sentences"), F.count_if("free").alias("n_free"))


def fuzzy_match_counts(s, sf):
    """How many words of the chunk vocabulary match each query word."""
    vocab = _t(s, sf, "corpus_chunks").select(F.explode(T.tokens(F.col("content"))).alias("term")).distinct()
    asked = _t(s, sf, "queries").select(F.explode(T.tokens(F.col("query"))).alias("asked")).distinct()
    b = vocab.select("term", F.explode(T.build_keys(T.stem(F.col("term")))).alias("key"))
    p = asked.select("asked", F.explode(T.probe_keys(T.stem(F.col("asked")))).alias("key"))
    hit = p.join(b, "key").select("asked", "term").distinct().groupBy("asked").agg(F.count("*").alias("n"))
    return asked.join(hit, "asked", "left").select("asked", F.coalesce("n", F.lit(0)).alias("n_matches"))


def postings_tf(s, sf):
    return retrieval.postings(_words(s, sf)).select("chunk_id", "term", "tf", "dl")


def term_df(s, sf):
    return retrieval.term_stats(retrieval.postings(_words(s, sf)))


def corpus_stats(s, sf):
    return retrieval.corpus_stats(_words(s, sf)).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(s, sf):
    words = _words(s, sf)
    return retrieval.bm25(store.stored(_asked(s, sf)), retrieval.postings(words), retrieval.corpus_stats(words), 5)


def hash_embed(s, sf):
    v = retrieval.embedded_queries(_t(s, sf, "queries"))
    return v.select("query_id", F.posexplode("vec").alias("slot", "value")).select("query_id", "slot", (F.round("value", 6) + 0.0).alias("value"))


def hybrid_index(s, sf):
    """What the index holds of each chunk: its words, distinct words, and the length of its vector."""
    i = hybrid.build(_t(s, sf, "corpus_chunks"))
    terms = i.postings.groupBy("chunk_id").agg(F.count("*").alias("n_terms"))
    length = i.vectors.select("chunk_id", F.round(T.norm(F.col("vec")), 6).alias("length"))
    return i.words.select("chunk_id", F.size("w").cast("long").alias("n_words")).join(terms, "chunk_id", "left").join(length, "chunk_id").select("chunk_id", "n_words", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "length")


def dense_topk_hash(s, sf):
    return retrieval.dense(retrieval.embedded_queries(store.stored(_asked(s, sf))), retrieval.hash_embeddings(_words(s, sf)), 5)


def dense_topk_vectors(s, sf):
    e = _t(s, sf, "embeddings")
    return retrieval.dense(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), 5)


def vector_distances(s, sf):
    e = _t(s, sf, "embeddings")
    q = store.small(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(T.cosine(F.col("qv"), F.col("embedding")), F.lit(0.0))))
    return e.join(q, how="cross").select("query_id", "vec_id", (F.round(c, 6) + 0.0).alias("cosine"), F.round(T.euclidean(F.col("qv"), F.col("embedding")), 6).alias("euclidean"))


def vector_upsert(s, sf):
    """All vectors as the store, counts of users' events as new ones: which row stands at which ordinal."""
    old = retrieval.ordinals(_t(s, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")
    new = _t(s, sf, "events").groupBy((F.col("user_id") * 7).alias("vec_id")).agg(F.count("*").alias("label"))
    return retrieval.upsert(old, new, "vec_id").select("vec_id", "label", _long("ordinal"))


def rrf_fusion(s, sf):
    return retrieval.fuse(_lists(s, sf))


def rerank_scores(s, sf):
    return retrieval.rerank(_lists(s, sf).where("list_no = 0").select("query_id", "chunk_id", "rank"), _t(s, sf, "queries"), _words(s, sf), 0.25, 3)


def hybrid_topk(s, sf):
    return hybrid.retrieve(_asked(s, sf), hybrid.build(_t(s, sf, "corpus_chunks")), k=3)


def grounding_sentences(s, sf):
    x = verification.support(verification.answer_sentences(_answers(s, sf), T.GUARD_STOP), _context(s, sf), _t(s, sf, "corpus_chunks"), T.GUARD_STOP)
    return x.select("query_id", "attempt", "sentence_index", "matched", "total", "grounded")


def grounding_verdicts(s, sf):
    return _verdicts(s, sf).drop("messages")


def violation_messages(s, sf):
    """The messages of each rejected answer, one a line."""
    return _verdicts(s, sf).where("violations > 0").select("query_id", "attempt", F.array_join("messages", "\n").alias("messages"))


def supervisor_prompts(s, sf):
    """What a generator is asked at each attempt."""
    c = _context(s, sf)
    p = verification.prompts(_t(s, sf, "queries"), store.stored(_verdicts(s, sf, c)), c, _t(s, sf, "corpus_chunks"))
    return p.select("query_id", "attempt", F.length("prompt").cast("long").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def chat_gate(s, sf):
    """Whether each answer may go out, by its faithfulness and dosages."""
    c, a = _context(s, sf), _answers(s, sf)
    x = _faithfulness(s, sf, a, c).join(verification.dosage_check(a, c, _t(s, sf, "corpus_chunks")), ["query_id", "attempt"])
    return x.select("query_id", "attempt", verification.chat_gate(F.col("faithfulness"), F.col("is_valid")).alias("status"))


def retrieval_lift(s, sf):
    """Score of the best reranked chunk of each query, and by how many points it lies above that of the best dense one."""
    first = lambda kind: F.min_by("score", F.when(F.col("retrieval_type") == kind, F.struct("rank", "chunk_id", -F.col("score")))).alias(kind)
    h = _t(s, sf, "hits").where("retrieval_type IN ('CrossEncoder_Reranked', 'Dense_Cosine')").select("query_id", "retrieval_type", "chunk_id", "rank", F.coalesce("score", F.lit(0.0)).alias("score"))
    x = h.groupBy("query_id").agg(first("CrossEncoder_Reranked"), first("Dense_Cosine"))
    return x.select("query_id", F.coalesce(F.bround("CrossEncoder_Reranked", 2), F.lit(0.0)).alias("confidence"), (F.coalesce(F.bround((F.col("CrossEncoder_Reranked") - F.col("Dense_Cosine")) * 100, 1), F.lit(0.0)) + 0.0).alias("lift"))


def faithfulness_evidence(s, sf):
    answers = s.read.parquet(f"{sf}/attempts.parquet").repartition("query_id").groupBy("query_id", "attempt").agg(F.max("response").alias("response"))
    x = verification.evidence(answers, _context(s, sf), s.read.parquet(f"{sf}/corpus_chunks.parquet"))
    return x.select("query_id", "attempt", "sentence_index", "support_ratio", "line_matches", "best_doc_id", "best_snippet")


def context_relevancy(s, sf):
    return verification.context_relevancy(_t(s, sf, "queries"), _context(s, sf), _t(s, sf, "corpus_chunks"))


def answer_relevancy(s, sf):
    return verification.answer_relevancy(_t(s, sf, "queries"), _answers(s, sf))


def _faithfulness(s, sf, answers, context):
    """query_id, attempt, faithfulness (0 for a blank answer or without context) of each answer."""
    x = verification.support(verification.answer_sentences(answers, T.TRIAD_STOP), context, _t(s, sf, "corpus_chunks"), T.TRIAD_STOP)
    f = x.groupBy("query_id", "attempt").agg(F.bround(F.count_if("grounded") / F.count("*"), 3).alias("f"))
    has = context.select("query_id").distinct().withColumn("has", F.lit(True))
    return answers.select("query_id", "attempt").join(f, ["query_id", "attempt"], "left").join(has, "query_id", "left").select("query_id", "attempt", F.coalesce(F.when(F.col("has"), F.col("f")), F.lit(0.0)).alias("faithfulness"))


def triad_scores(s, sf):
    a, c = _answers(s, sf), _context(s, sf)
    r = verification.context_relevancy(_t(s, sf, "queries"), c, _t(s, sf, "corpus_chunks"))
    return verification.answer_relevancy(_t(s, sf, "queries"), a).join(_faithfulness(s, sf, a, c), ["query_id", "attempt"]).join(r, "query_id", "left").select("query_id", "attempt", "context_relevancy", "faithfulness", "answer_relevancy")


def ranking_metrics(s, sf):
    rel = _t(s, sf, "queries").select("query_id", F.explode("expected_chunk_ids").alias("chunk_id")).where("chunk_id IS NOT NULL")
    return verification.ranking_metrics(retrieval.fuse(_lists(s, sf), limit=None), rel, 5)


def auto_labels(s, sf):
    return verification.auto_labels(_t(s, sf, "queries"), _context(s, sf), _t(s, sf, "corpus_chunks"))


def dosage_guard(s, sf):
    """Half of the answers are taken with their white space doubled, so dosages stand in other spellings than in the context."""
    a = _answers(s, sf).withColumn("response", F.when(F.col("attempt") > 1, F.replace("response", F.lit(" "), F.lit("  "))).otherwise(F.col("response")))
    return verification.dosage_check(a, _context(s, sf), _t(s, sf, "corpus_chunks")).select("query_id", "attempt", "extracted", "missing", "is_valid", F.array_join("lost", ",").alias("lost"))


def breaker_fallback(s, sf):
    return verification.breaker(_verdicts(s, sf))


def supervisor_outcomes(s, sf):
    c = _context(s, sf)
    return verification.supervise(_t(s, sf, "queries"), store.stored(_verdicts(s, sf, c)), c)


def _evaluated(s, sf):
    """Outcomes of all requests and their evaluation; the events of a user stand for the steps of the query of that number."""
    c, a, q, n = _context(s, sf), _answers(s, sf), _t(s, sf, "queries"), _t(s, sf, "corpus_chunks")
    v = store.stored(verification.verdicts(a, c, n))
    o = store.stored(verification.supervise(q, v, c))
    t = trace_durations(s, sf).select(F.concat(F.lit("q"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("query_id"), "step_no", "elapsed_ms")
    return o, verification.evaluate(o, q, a, v, c, n, t)


def exec_evaluation(s, sf):
    return _evaluated(s, sf)[1]


def run_summary(s, sf):
    """The run as cases: a query without expected chunks should end in its fallback, any other pass its gate."""
    o, e = _evaluated(s, sf)
    expects = _t(s, sf, "queries").select("query_id", (F.coalesce(F.size(F.filter("expected_chunk_ids", lambda x: x.isNotNull())), F.lit(0)) <= 0).alias("expects_fallback"))
    return verification.scorecard(e, o.select("query_id", "state").join(expects, "query_id"))


def _raw_json(s, sf):
    """Sentences as the careless JSON of five kinds of answers: fenced with single quotes and open brackets, right, of a wrong type, no JSON at all, blank."""
    d = _t(s, sf, "sentence_details").groupBy("query_id", "sentence_index").agg(F.max("sentence").alias("t")).where("t IS NOT NULL")
    i = F.col("sentence_index").cast("string")
    quoted = F.replace(F.replace(F.replace(F.col("t"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    kinds = [
        F.concat(F.lit("Result:\n```json\n{'id': '"), "query_id", F.lit("', 'index': "), i, F.lit(", 'text': '"), "t", F.lit("', 'parts': ['a', 'b',]\n```")),
        F.concat(F.lit('{"id": "'), "query_id", F.lit('", "Index": '), i, F.lit(', "text": "'), quoted, F.lit('", "parts": ["a"],}')),
        F.concat(F.lit('{"id": '), i, F.lit(', "index": '), i, F.lit("}")),
        F.concat("t", F.lit(" ")),
        F.lit("  "),
    ]
    return d.select("query_id", "sentence_index", F.element_at(F.array(*kinds), (F.pmod(F.col("sentence_index") + F.length("t"), F.lit(5)) + 1).cast("int")).alias("raw"))


def json_repair(s, sf):
    """Careless JSON repaired, and whether the repaired and the raw text are JSON."""
    fixed = T.repaired_json(T.fenced(F.col("raw")))
    return _raw_json(s, sf).select("query_id", "sentence_index", fixed.alias("fixed"), T.is_json(fixed).alias("is_json"), F.coalesce(T.raw_json_code(F.col("raw")), F.lit("None")).alias("raw_code"))


def json_typed(s, sf):
    """Careless JSON read as an object of fixed fields, with the code of the fault where that fails."""
    x = _raw_json(s, sf).select("query_id", "sentence_index", T.typed_json(F.col("raw"), {"id": "string", "index": "bigint", "text": "string"}).alias("x"))
    return x.select("query_id", "sentence_index", F.coalesce("x.code", F.lit("None")).alias("code"), F.col("x.value.id").alias("id"), F.col("x.value.index").alias("index"), F.md5("x.value.text").alias("text_md5"))


def trace_durations(s, sf):
    """Steps of each user's events: milliseconds since the first, and since the one before."""
    e = _t(s, sf, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    w = Window.partitionBy("user_id").orderBy("ms", "event_id")
    x = e.select("user_id", "event_id", F.row_number().over(w).alias("step_no"), (F.col("ms") - F.first("ms").over(w)).alias("elapsed_ms"))
    return x.select("user_id", "event_id", "step_no", "elapsed_ms", (F.col("elapsed_ms") - F.coalesce(F.lag("elapsed_ms").over(Window.partitionBy("user_id").orderBy("step_no")), F.lit(0))).alias("step_ms"))


def corpus_summaries(s, sf):
    d = _t(s, sf, "corpus_documents")
    w = Window.partitionBy(F.year("uploaded_at")).orderBy(F.desc("uploaded_at"), F.asc("id"))
    return corpus.summaries(d).select("id", "file_name", "file_size_bytes", "total_pages", "total_characters", "total_chunks", F.row_number().over(w).alias("place_in_year"))


def document_order(s, sf):
    """All documents in the order of their upload, numbered by day."""
    w = Window.partitionBy(F.to_date("uploaded_at")).orderBy(F.asc("uploaded_at"), F.asc("id"))
    return corpus.all_documents(_t(s, sf, "corpus_documents")).select("id", F.row_number().over(w).alias("place_in_day"))


def document_lookup(s, sf):
    """The longest document and its chunks, each looked up by its id."""
    d, c = _t(s, sf, "corpus_documents"), _t(s, sf, "corpus_chunks")
    longest = d.agg(F.max_by("id", F.struct(F.coalesce("total_characters", F.lit(0)), "id")).alias("id")).first().id
    name = corpus.document(d, longest).select("id", "file_name")
    return corpus.chunks_of(c, longest).join(name, F.col("doc_id") == F.col("id")).select("doc_id", "file_name", "chunk_id", "chunk_index")


def file_routes(s, sf):
    """Which loader takes the stored files, by extension."""
    x = _t(s, sf, "corpus_documents").select(files.extension(F.col("file_name")).alias("extension"), F.coalesce(files.route(F.col("file_name")), F.lit("none")).alias("route"))
    return x.groupBy("extension", "route").agg(F.count("*").alias("n"))


def chunk_order(s, sf):
    return corpus.all_chunks(_t(s, sf, "corpus_chunks")).select("doc_id", "chunk_id", "chunk_index", "ordinal")


def corpus_totals(s, sf):
    return corpus.totals(_t(s, sf, "corpus_documents"))


def corpus_upload(s, sf):
    c = _t(s, sf, "corpus_chunks").select(F.col("doc_id").alias("file"), "chunk_id")
    return corpus.upload(_pages(s, sf), c).select("file", "total_pages", "total_characters", "total_chunks", F.md5("content").alias("content_md5"))


def corpus_ingest(s, sf):
    """Pages of stored documents uploaded anew: chunked page by page, joined, with totals."""
    d, c = corpus.ingest(_pages(s, sf))
    n = c.groupBy(F.col("doc_id").alias("file")).agg(F.count_if(F.col("end_offset") - F.col("start_offset") > 1025).alias("too_long"))
    return d.join(n, "file", "left").select("file", "total_pages", "total_characters", (F.col("total_chunks") > 0).alias("chunked"), F.coalesce("too_long", F.lit(0)).alias("too_long"), F.md5("content").alias("content_md5"))


def inline_split(s, sf):
    """Contents as inline corpora; those of documents of several pages carry a mark and fall into lines."""
    d = _t(s, sf, "corpus_documents").where("content IS NOT NULL").select("id", F.concat(F.when(F.col("total_pages") > 1, "Doküman 1: ").otherwise(""), "content").alias("content"))
    return files.split_inline(d, keep=("id",)).select("id", "doc_id", F.md5("content").alias("content_md5"))


def base_names(s, sf):
    """Chunks by the document that their id names."""
    return _t(s, sf, "hits").select(T.base_name(F.concat_ws("", F.regexp_replace("chunk_id", "_c", "#Sayfa_1_c"))).alias("base")).groupBy("base").agg(F.count("*").alias("n_hits"))


def page_metadata(s, sf):
    """Metadata of documents merged with the keys of their pages."""
    p = _pages(s, sf).join(_t(s, sf, "corpus_documents").select(F.col("id").alias("file"), "file_name", "total_pages", "metadata"), "file")
    m = pages.page_metadata(F.col("metadata"), F.col("file_name"), F.col("page_no"), F.col("total_pages"), F.length(T.squeezed(F.col("text"))) < 10)
    told = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))), "\n")
    return p.select("file", "page_no", F.size(m).cast("long").alias("n_keys"), F.md5(told).alias("metadata_md5"))


def corpus_upsert(s, sf):
    """Documents of pages saved again under a new name, with their first chunk: what the tables hold then."""
    d, c = _t(s, sf, "corpus_documents"), _t(s, sf, "corpus_chunks")
    again = d.where("file_name LIKE '%.pdf'").withColumn("file_name", F.concat(F.lit("new_"), "file_name"))
    first = c.join(again.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").where("chunk_index = 0").select(*c.columns)
    nd, nc = corpus.save(d, c, again, first)
    n = nc.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return nd.select("id", "file_name").join(n.withColumnRenamed("doc_id", "id"), "id", "left").select("id", "file_name", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def corpus_delete(s, sf):
    """Documents without chunks in the index of hits are deleted with their chunks: what is left of each kind."""
    d, c = _t(s, sf, "corpus_documents"), _t(s, sf, "corpus_chunks")
    used = c.join(_t(s, sf, "hits").select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    nd, nc = corpus.delete(d, c, d.select("id").join(used, "id", "left_anti"))
    return nd.select("id").join(nc.groupBy("doc_id").agg(F.count("*").alias("n_chunks")).withColumnRenamed("doc_id", "id"), "id")


def header_fingerprints(s, sf):
    return pages.fingerprints(_pages(s, sf))


def header_strip(s, sf):
    x = pages.strip_headers(_pages(s, sf))
    return x.select("file", "page_no", "removed", F.md5("text").alias("text_md5"))


def page_cleaning(s, sf):
    """DOI, citation, authors, journal and the journal of the banner from a first page made of the metadata, and the cleaned body. Badge, citation mark and heading come in several spellings."""
    m = F.col("metadata")
    z = lambda k: F.coalesce(m[k], F.lit(""))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.coalesce("total_characters", F.lit(0)), F.lit(len(xs))) + 1).cast("int"))
    badge, cite, head = pick("CASE REPORT", "KLİNİK ÇALIŞMA", "klinik calisma", "Review article", ""), pick("Cite this article as:", "CITE THIS ARTICLE AS:", "cite this article as:"), pick("ABSTRACT", "özet", "Özet", "GİRİŞ", "introduction", "Summary", "Results")
    page = F.concat(badge, F.lit("\n"), z("Journal"), F.lit("\n"), cite, F.lit(" "), z("Authors"), F.lit(". "), "file_name", F.lit(". "), z("Journal"), F.lit(". 2020\nDOI: "), z("Doi"), F.lit(".\n"), head, F.lit(" C oronary "), F.coalesce("content", F.lit("")))
    p = _t(s, sf, "corpus_documents").select("id", page.alias("page"))
    c = pages.citation(F.col("page"))
    authors, journal = pages.citation_parts(c)
    return p.select("id", pages.doi(F.col("page")).alias("doi"), c.alias("citation"), authors.alias("authors"), journal.alias("journal"), pages.banner_journal(F.col("page")).alias("banner"), F.md5(pages.drop_caps(pages.without_badges(F.col("page")))).alias("clean_md5"), F.length(pages.body_start(F.col("page"))).alias("body_length"))


def chunk_documents(s, sf):
    return chunking.chunk_documents(_t(s, sf, "corpus_documents"), "id", "content", "metadata").drop("metadata")


def chunk_invariants(s, sf):
    """Whether the chunks of each document are numbered without gaps, start ever later, fit, and lie within the text."""
    d = _t(s, sf, "corpus_documents")
    c = chunking.chunk_documents(d, "id")
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    x = c.select("doc_id", "chunk_index", "start_offset", "end_offset", (F.col("start_offset") > F.coalesce(F.lag("start_offset").over(w), F.lit(-1))).alias("grows"))
    y = x.groupBy("doc_id").agg((F.max("chunk_index") + 1 == F.count("*")).alias("dense"), F.bool_and("grows").alias("grows"), (F.max(F.col("end_offset") - F.col("start_offset")) <= 1025).alias("fits"), F.max("end_offset").alias("last"))
    return y.join(d.select(F.col("id").alias("doc_id"), F.length("content").alias("n")), "doc_id").select("doc_id", "dense", "grows", "fits", (F.col("last") <= F.col("n")).alias("within"))


def nearest_five(s, sf):
    return views.nearest(_points(s, sf))


def polar_projection(s, sf):
    x = views.polar(_points(s, sf))
    return x.select("query_id", "chunk_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))


def cross_doc_bridges(s, sf):
    return views.bridge_counts(_points(s, sf), near=0.9)


def chunk_links(s, sf):
    return views.chunk_links(_t(s, sf, "corpus_chunks"))


def line_locator(s, sf):
    d = _t(s, sf, "sentence_details").where("best_doc_id IS NOT NULL").groupBy("query_id", "sentence_index").agg(F.max(F.struct("best_doc_id", "sentence", "best_snippet")).alias("x"))
    asked = d.select(F.concat_ws("#", "query_id", "sentence_index").alias("row_id"), F.col("x.best_doc_id").alias("doc_id"), F.col("x.sentence").alias("sentence"), F.col("x.best_snippet").alias("snippet"))
    return views.locate_lines(asked, _t(s, sf, "corpus_documents").select(F.col("id").alias("doc_id"), "content"))


def answer_flags(s, sf):
    """Grounded and ungrounded sentences of each answer, and whether any is ungrounded."""
    d = _t(s, sf, "sentence_details").distinct()
    return d.groupBy("query_id").agg(F.count_if("is_grounded").alias("grounded"), F.count_if(~F.col("is_grounded")).alias("ungrounded"), F.coalesce(F.bool_or(~F.col("is_grounded")), F.lit(False)).alias("has_ungrounded"))


NAMES = """tokenize_stats stem_vocab content_tokens sentence_stats evidence_line_stats bigram_counts conversational_sentences fuzzy_match_counts
postings_tf term_df corpus_stats bm25_topk hybrid_index hash_embed dense_topk_hash dense_topk_vectors vector_distances vector_upsert rrf_fusion rerank_scores hybrid_topk
grounding_sentences grounding_verdicts violation_messages supervisor_prompts chat_gate retrieval_lift faithfulness_evidence context_relevancy answer_relevancy triad_scores ranking_metrics auto_labels dosage_guard breaker_fallback
supervisor_outcomes exec_evaluation run_summary json_repair json_typed trace_durations corpus_summaries document_order document_lookup file_routes chunk_order corpus_totals corpus_upload corpus_ingest inline_split base_names page_metadata corpus_upsert corpus_delete
header_fingerprints header_strip page_cleaning chunk_documents chunk_invariants nearest_five polar_projection cross_doc_bridges chunk_links line_locator answer_flags""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}
