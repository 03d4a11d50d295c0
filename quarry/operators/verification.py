"""Checks of answers against context, and quality metrics, over whole tables.

Fuzzy word matching is an equi-join on keys (functions.text.build_keys), never
a comparison of all words with all words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.functions import text as T
from quarry.operators import matching
from quarry.sources import store

# Messages by reason, parts of the feedback and of the prompt, states of the gate.
FALLBACK = {
    "ContextDeficit": "I cannot answer this query because the retrieved knowledge base lacks sufficient factual context to ground the response reliably.",
    "UngroundedClaim": "I am unable to provide a verified answer. Candidate responses failed factual grounding checks against verified source documents.",
    "EntityHallucination": "I am unable to provide a verified answer. Candidate responses failed factual grounding checks against verified source documents.",
    "SchemaViolation": '{"status": "error", "message": "Deterministic guardrail rejected response due to schema non-compliance."}',
}
EMPTY_ANSWER, NO_CONTEXT = "Generated response is empty.", "No source context chunks provided for grounding verification."
FEEDBACK = ("PREVIOUS RESPONSE FAILED FACTUAL VALIDATION:", "Strictly remove all ungrounded claims and stick strictly to verified facts.")
PROMPT = ("### SOURCE CONTEXT DOCUMENTS:", "### CRITIC FEEDBACK FROM PREVIOUS ATTEMPT:", "### USER QUERY:", "### FACTUAL ANSWER (Ground directly in DOCs):")
GATE = ("SUCCESS / PASSED", "BLOCKED / WARNING")
FALLBACK_ELSE = "Verification gate failed. Safe deterministic fallback dispatched to prevent hallucination."


def answer_sentences(answers: DataFrame, stop: list[str]) -> DataFrame:
    """query_id, attempt, sentence_index (from 1), sentence, content, free: one row per sentence; free needs no evidence."""
    s = answers.select("query_id", "attempt", F.posexplode(T.sentences(F.col("response"))).alias("i", "sentence"))
    s = s.select("query_id", "attempt", (F.col("i") + 1).alias("sentence_index"), "sentence", T.without(T.tokens(F.col("sentence")), stop).alias("content"))
    return s.withColumn("free", T.conversational(F.col("sentence"), F.col("content")) | (F.size("content") == 0))


def _keys(words: Column, keys) -> Column:
    """Distinct match keys of words, each stemmed once."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(T.stems(F.array_distinct(words))), keys)))


def _pairs(context: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, chunk_id of the context, with what the query asks; stored, since its hot chunks are counted."""
    return store.stored(context.select("query_id", "chunk_id").distinct().join(asked, "query_id"))


def supported_keys(sentences: DataFrame, context: DataFrame, chunks: DataFrame, stop: list[str]) -> DataFrame:
    """query_id, hit: those match keys of the words of the sentences that the context (query_id, chunk_id) holds.

    It starts from the words of the answers: their keys go to the few chunks
    of the context, and what both have comes back. The words of the chunks
    stay where they are.
    """
    asked = sentences.where("NOT free").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(_keys(F.col("content"), T.probe_keys)))).alias("keys"))
    held = chunks.select("chunk_id", _keys(T.without(T.tokens(F.col("content")), stop), T.build_keys).alias("own"))
    met = store.skew_join(_pairs(context, asked), held, "chunk_id").select("query_id", F.array_intersect("keys", "own").alias("hit"))
    return met.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"))


def support(sentences: DataFrame, context: DataFrame, chunks: DataFrame, stop: list[str]) -> DataFrame:
    """The sentences and how many of their content words (repeats count) the context supports: matched, total, grounded."""
    sentences = store.stored(sentences)
    hit = supported_keys(sentences, context, chunks, stop)
    matched = F.size(F.filter(T.stems(F.col("content")), lambda s: F.arrays_overlap(T.probe_keys(s), F.col("hit"))))
    out = sentences.join(hit, "query_id", "left").withColumn("matched", F.when(F.col("free") | F.col("hit").isNull(), 0).otherwise(matched).cast("long")).withColumn("total", F.size("content").cast("long")).drop("hit")
    return out.withColumn("grounded", F.col("free") | (5 * F.col("matched") >= 2 * F.col("total")))


def violation(index: Column, matched: Column, total: Column, sentence: Column) -> Column:
    """The message of an ungrounded sentence; its support in per cent with one decimal."""
    share = F.format_string("%.1f %%", F.round(100.0 * matched / total, 1))
    return F.concat(F.lit("Ungrounded claim detected at sentence "), index.cast("string"), F.lit(" (Support: "), share, F.lit('): "'), sentence, F.lit('"'))


def verdicts(answers: DataFrame, context: DataFrame, chunks: DataFrame, minimum: float = 0.80) -> DataFrame:
    """query_id, attempt, is_valid, faithfulness, violations, reason, messages (of the violations, in order): one row per distinct answer."""
    a = answers.select("query_id", "attempt", "response").distinct().groupBy("query_id", "attempt").agg(F.max("response").alias("response"))
    rated = support(answer_sentences(a, T.GUARD_STOP), context, chunks, T.GUARD_STOP)
    told = F.when(~F.col("grounded"), F.struct("sentence_index", violation(F.col("sentence_index"), F.col("matched"), F.col("total"), F.col("sentence")).alias("m")))
    by = rated.groupBy("query_id", "attempt").agg(F.count("*").alias("n"), F.count_if("grounded").alias("g"), F.transform(F.array_sort(F.collect_list(told)), lambda x: x["m"]).alias("told"))
    has = context.select("query_id").distinct().withColumn("has", F.lit(True))
    j = a.join(by, ["query_id", "attempt"], "left").join(has, "query_id", "left")
    blank, bare = F.coalesce(T.squeezed(F.col("response")), F.lit("")) == "", F.col("has").isNull()
    score = F.when(blank | bare, 0.0).when(F.col("n").isNull(), 1.0).otherwise(F.col("g") / F.col("n"))
    messages = F.when(blank, F.array(F.lit(EMPTY_ANSWER))).when(bare, F.array(F.lit(NO_CONTEXT))).otherwise(F.coalesce("told", F.array().cast("array<string>")))
    out = j.select("query_id", "attempt", F.round(score, 6).alias("faithfulness"), F.size(messages).cast("long").alias("violations"), blank.alias("blank"), bare.alias("bare"), messages.alias("messages"))
    valid = (F.col("violations") == 0) & (F.col("faithfulness") >= minimum)
    reason = F.when(F.col("blank"), "UngroundedClaim").when(F.col("bare"), "ContextDeficit").when(valid, "None").when(F.col("violations") > 0, "UngroundedClaim").otherwise("ConfidenceBelowThreshold")
    return out.select("query_id", "attempt", valid.alias("is_valid"), "faithfulness", "violations", reason.alias("reason"), "messages")


def feedback(messages: Column) -> Column:
    """What the next attempt is told of the violations of the one before."""
    lines = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("- "), m)), "\n")
    return F.concat(F.lit(FEEDBACK[0]), F.lit("\n"), lines, F.lit("\n"), F.lit(FEEDBACK[1]))


def prompts(requests: DataFrame, v: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, attempt, prompt: what a generator is asked at each attempt of the verdicts: context in rank order, feedback on the attempt before, query."""
    texts = store.skew_join(store.stored(context.select("query_id", "chunk_id", "rank")), chunks.select("chunk_id", "content"), "chunk_id")
    docs = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("d"))
    listed = F.array_join(F.transform("d", lambda x, i: F.concat(F.lit("[DOC_"), (i + 1).cast("string"), F.lit("]: "), F.coalesce(x["content"], F.lit("")), F.lit("\n"))), "")
    before = v.select("query_id", (F.col("attempt") + 1).alias("attempt"), F.when(~F.col("is_valid"), feedback(F.col("messages"))).alias("told"))
    j = v.select("query_id", "attempt").join(before, ["query_id", "attempt"], "left").join(requests.select("query_id", "query"), "query_id").join(docs.select("query_id", listed.alias("docs")), "query_id", "left")
    told = F.when(F.col("told").isNotNull(), F.concat(F.lit(PROMPT[1] + "\n"), F.col("told"), F.lit("\n\n"))).otherwise("")
    text = F.concat(F.lit(PROMPT[0] + "\n"), F.coalesce("docs", F.lit("")), F.lit("\n"), told, F.lit(PROMPT[2] + "\n"), F.coalesce("query", F.lit("")), F.lit("\n\n" + PROMPT[3] + "\n"))
    return j.select("query_id", "attempt", text.alias("prompt"))


def _mapped(df: DataFrame, kernel, columns: str) -> DataFrame:
    """The frame that a kernel, told the schema of its columns, makes of batches."""
    return df.mapInArrow(kernel(to_arrow_schema(StructType.fromDDL(columns))), columns)


def evidence(answers: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, attempt, sentence_index, grounded, support_ratio, line_matches, best_doc_id, best_snippet: the line of the context that supports a sentence best.

    context: query_id, chunk_id, rank, read twice; the first line in rank and
    line order wins a tie. The stems of a query's sentences go to the chunks
    of its context, and what they find there comes back as one row a pair.
    """
    kinds = dict(answers.dtypes) | {"doc_id": dict(chunks.dtypes)["doc_id"]}
    line = lambda s: F.concat(F.when(s.endswith("?") | (F.length(s) < 35), "1").otherwise("0"), F.array_join(T.tokens(s), " "))
    sentences = F.array_join(F.transform(T.sentences(F.col("response")), line), "\n")
    by = answers.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("attempt", sentences.alias("sentences")))).alias("a")).select("query_id", "a.attempt", "a.sentences")
    asked = store.stored(_mapped(by, matching.asked(T.TRIAD_STOP), f"query_id {kinds['query_id']}, stems string, told binary"))
    pairs = context.select("query_id", "chunk_id", "rank").where("chunk_id IS NOT NULL").join(asked.select("query_id", "stems"), "query_id")
    pairs, texts = store.spread(pairs, chunks.select("chunk_id", "doc_id", "content"), "chunk_id", "query_id", context)
    both = texts.unionByName(pairs, allowMissingColumns=True).repartition("chunk_id", "_salt").sortWithinPartitions("chunk_id", "_salt", F.col("stems").isNotNull())
    rows = both.select("chunk_id", "doc_id", "content", F.array_join(T.tokens_and_ends(F.col("content")), " ").alias("words"), "query_id", "rank", "stems")
    found = _mapped(rows, matching.met(T.TRIAD_STOP), f"query_id {kinds['query_id']}, found binary")
    each = asked.select("query_id", "told").unionByName(found, allowMissingColumns=True).repartition("query_id").sortWithinPartitions("query_id", F.col("told").isNull())
    rated = _mapped(each, matching.best, f"query_id {kinds['query_id']}, attempt {kinds['attempt']}, sentence_index int, free boolean, matched bigint, total bigint, line_matches bigint, best_doc_id {kinds['doc_id']}, best_snippet string")
    ratio = F.when(F.col("free"), 1.0).otherwise(F.bround(F.col("matched") / F.col("total"), 2))
    grounded = F.col("free") | (5 * F.col("matched") >= 2 * F.col("total"))
    return rated.select("query_id", "attempt", "sentence_index", grounded.alias("grounded"), ratio.alias("support_ratio"), "line_matches", "best_doc_id", "best_snippet")


def context_relevancy(queries: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context_relevancy: the share of context sentences that share a word with the query."""
    q = queries.select("query_id", T.without(T.tokens(F.col("query")), T.TRIAD_STOP).alias("qt"), (F.coalesce(T.squeezed(F.col("query")), F.lit("")) == "").alias("blank"))
    own = chunks.select("chunk_id", F.transform(T.sentences(F.col("content")), lambda s: _keys(T.without(T.tokens(s), T.TRIAD_STOP), T.probe_keys)).alias("own"))
    asked = q.select("query_id", _keys(F.col("qt"), T.build_keys).alias("keys"))
    met = store.skew_join(_pairs(context, asked), own, "chunk_id").select("query_id", F.size("own").alias("total"), F.size(F.filter("own", lambda k: F.arrays_overlap(k, F.col("keys")))).alias("hit"))
    j = q.join(met.groupBy("query_id").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit")), "query_id", "left")
    score = F.when(F.col("total").isNull() | F.col("blank"), 0.0).when(F.size("qt") == 0, 1.0).when(F.col("total") > 0, F.col("hit") / F.col("total")).otherwise(0.0)
    return j.select("query_id", F.bround(score, 3).alias("context_relevancy"))


def answer_relevancy(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, attempt, answer_relevancy: Jaccard similarity of the content stems of query and answer."""
    stems = lambda c: F.array_distinct(T.stems(T.without(T.tokens(F.col(c)), T.TRIAD_STOP)))
    j = queries.select("query_id", stems("query").alias("q")).join(answers.select("query_id", "attempt", stems("response").alias("a")), "query_id")
    both = F.size(F.array_intersect("q", "a"))
    return j.select("query_id", "attempt", F.bround(F.when((F.size("q") > 0) & (F.size("a") > 0), both / F.size(F.array_union("q", "a"))).otherwise(0.0), 3).alias("answer_relevancy"))


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, precision_at_k, recall_at_k, mrr, ndcg_at_k of ranked (query_id, chunk_id, rank) against relevant (query_id, chunk_id); zeros without either."""
    rel = relevant.select("query_id", "chunk_id").distinct()
    size = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    hit = ranked.join(rel, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = ranked.select("query_id").unionByName(rel.select("query_id")).distinct().join(size, "query_id", "left").join(hit, "query_id", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return j.select("query_id", z(F.col("hits") / F.lit(float(k))).alias("precision_at_k"), z(F.col("hits") / F.col("n_rel")).alias("recall_at_k"), z(1 / F.col("first")).alias("mrr"), z(F.when(F.col("n_rel") > 0, F.col("dcg") / ideal)).alias("ndcg_at_k"))


def auto_labels(queries: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id: context chunks that share a stem of a query word of three characters or more; without any the first chunk."""
    q = queries.select("query_id", F.array_distinct(T.stems(F.filter(T.tokens(F.col("query")), lambda t: F.length(t) > 2))).alias("asked"))
    c = chunks.select("chunk_id", F.array_distinct(T.stems(F.array_distinct(T.tokens(F.col("content"))))).alias("own"))
    hit = store.skew_join(_pairs(context, q), c, "chunk_id").where(F.arrays_overlap("asked", "own")).select("query_id", "chunk_id")
    first = context.groupBy("query_id").agg(F.min_by("chunk_id", F.struct("rank", "chunk_id")).alias("chunk_id"))
    return hit.unionByName(first.join(hit.select("query_id").distinct(), "query_id", "left_anti"))


def dosage_check(answers: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, attempt, extracted, missing, is_valid, lost: dosages of the answer that the context nowhere holds as text.

    The texts of the context (query_id, chunk_id, rank) are put together in
    rank order and lose their white space, so a dosage may run over the end of
    one chunk. Only the context of answers with a dosage is read.
    """
    d = store.stored(answers.select("query_id", "attempt", T.dosages(F.col("response")).alias("found")))
    flat = chunks.select("chunk_id", F.regexp_replace(T.lowered(F.col("content")), r"\s+", "").alias("flat"))
    used = store.stored(context.select("query_id", "chunk_id", "rank").join(d.where(F.size("found") > 0).select("query_id").distinct(), "query_id", "left_semi"))
    whole = store.skew_join(used, flat, "chunk_id").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "flat"))), lambda x: x["flat"]), "").alias("flat"))
    lost = F.filter("found", lambda x: ~F.coalesce(F.contains("flat", x), F.lit(False)))
    return d.join(whole, "query_id", "left").withColumn("lost", lost).select("query_id", "attempt", F.size("found").cast("long").alias("extracted"), F.size("lost").cast("long").alias("missing"), (F.size("lost") == 0).alias("is_valid"), "lost")


def chat_gate(faithfulness: Column, dosages_valid: Column, minimum: float = 0.70) -> Column:
    """Whether an answer may go out, as its status."""
    return F.when((faithfulness >= minimum) & dosages_valid, GATE[0]).otherwise(GATE[1])


def fallback_text(reason: Column) -> Column:
    out = F
    for r, text in FALLBACK.items():
        out = out.when(reason == r, text)
    return out.otherwise(FALLBACK_ELSE)


def breaker(v: DataFrame, failures: int = 2) -> DataFrame:
    """query_id, attempt, trips, fallback: whether a verdict trips the breaker after so many failures in the order of attempts."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("is_valid"), 0).otherwise(1)).over(w)
    trips = ~F.col("is_valid") & ((n >= max(1, failures)) | (F.col("reason") == "ContextDeficit"))
    return v.select("query_id", "attempt", trips.alias("trips"), F.when(trips, fallback_text(F.col("reason"))).alias("fallback"))


def supervise(requests: DataFrame, v: DataFrame, context: DataFrame, max_attempts: int = 3, failures: int = 2) -> DataFrame:
    """query_id, state, attempts, reason: the outcome of each request, all at once.

    The first valid attempt within min(max_attempts, failures) is accepted;
    else the fallback goes out with the last reason; without context at once.
    """
    limit = min(max_attempts, max(1, failures))
    has = context.select("query_id").distinct().withColumn("has", F.lit(True))
    ok = v.where(F.col("is_valid") & (F.col("attempt") <= limit)).groupBy("query_id").agg(F.min("attempt").alias("accepted"))
    bad = v.where(F.col("attempt") <= limit).groupBy("query_id").agg(F.max("attempt").alias("last"), F.max_by("reason", "attempt").alias("why"))
    j = requests.select("query_id").join(has, "query_id", "left").join(ok, "query_id", "left").join(bad, "query_id", "left")
    state = F.when(F.col("has").isNull(), "FallbackDispatched").when(F.col("accepted").isNotNull(), "Completed").otherwise("FallbackDispatched")
    attempts = F.when(F.col("has").isNull(), 0).otherwise(F.coalesce("accepted", "last", F.lit(0)))
    reason = F.when(F.col("has").isNull(), "ContextDeficit").when(F.col("accepted").isNotNull(), "None").otherwise(F.coalesce("why", F.lit("None")))
    return j.select("query_id", state.alias("state"), attempts.cast("int").alias("attempts"), reason.alias("reason"))


def evaluate(outcomes: DataFrame, queries: DataFrame, answers: DataFrame, v: DataFrame, context: DataFrame, chunks: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """query_id, faithfulness, context_recall, context_precision, noise_rejection, latency_ms, total_tokens, passed of each outcome.

    Faithfulness is that of the attempt that decided, 0 without one.
    traces: query_id, step_no, elapsed_ms; the latency is that of the last
    step, 0 without any. Several rows of one attempt count as the greatest.
    """
    ctx = store.stored(context.select("query_id", "chunk_id").distinct().join(queries.select("query_id", F.filter(F.array_distinct("expected_chunk_ids"), lambda x: x.isNotNull()).alias("expected")), "query_id"))
    met = store.skew_join(ctx, chunks.select("chunk_id", F.length("content").alias("len")), "chunk_id").groupBy("query_id").agg(F.count("*").alias("n_ctx"), F.sum("len").alias("ctx_len"), F.count_if(F.array_contains("expected", F.col("chunk_id"))).alias("n_hit"))
    own = outcomes.select("query_id", F.col("attempts").alias("attempt"))
    last = v.join(own, ["query_id", "attempt"]).groupBy("query_id").agg(F.max("faithfulness").alias("faithfulness"))
    out = answers.join(own, ["query_id", "attempt"]).groupBy("query_id").agg(F.length(F.max("response")).alias("out_len"))
    asked = queries.select("query_id", F.length("query").alias("q_len"), F.coalesce(F.size(F.filter(F.array_distinct("expected_chunk_ids"), lambda x: x.isNotNull())), F.lit(0)).alias("n_exp"))
    sides = [asked, met, last, out]
    if traces is not None:
        sides.append(traces.groupBy("query_id").agg(F.max_by("elapsed_ms", "step_no").alias("latency_ms")))
    j = outcomes
    for side in sides:
        j = j.join(side, "query_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_exp = F.greatest(z("n_exp"), F.lit(0))
    recall = F.when(n_exp == 0, 1.0).otherwise(z("n_hit") / n_exp)
    precision = F.when((n_exp == 0) | (z("n_ctx") == 0), 1.0).otherwise(z("n_hit") / F.col("n_ctx"))
    done = F.col("state") == "Completed"
    total = F.floor((z("q_len") + F.when(done, z("out_len")).otherwise(F.length(fallback_text(F.col("reason")))) + z("ctx_len")) / 4)
    faith = F.coalesce("faithfulness", F.lit(0.0))
    latency = F.coalesce("latency_ms", F.lit(0)).cast("long") if traces is not None else F.lit(0).cast("long")
    return j.select("query_id", faith.alias("faithfulness"), F.round(recall, 6).alias("context_recall"), F.round(precision, 6).alias("context_precision"), F.round(F.when(z("n_ctx") == 0, 1.0).otherwise(precision), 6).alias("noise_rejection"), latency.alias("latency_ms"), total.alias("total_tokens"), (done & (faith >= 0.85)).alias("passed"))


def scorecard(evaluated: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for a run over cases (query_id, state, expects_fallback): cases, as_expected, pass_rate, mean_faithfulness, total_ms. A case is as expected when its fallback, or else its gate, is."""
    j = evaluated.join(cases, "query_id")
    ok = F.when(F.col("expects_fallback"), F.col("state") == "FallbackDispatched").otherwise(F.col("passed"))
    return j.agg(F.count("*").alias("cases"), F.count_if(ok).alias("as_expected"), F.round(F.avg(ok.cast("double")), 6).alias("pass_rate"), F.round(F.avg("faithfulness"), 6).alias("mean_faithfulness"), F.sum("latency_ms").alias("total_ms"))
