"""The SQL that checks the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from quarry.functions.text import GUARD_STOP, RERANK_STOP, SUFFIXES, TRIAD_STOP
from quarry.operators.pages import BADGES, JOURNALS, LINE_BADGES
from quarry.operators.verification import FALLBACK, FALLBACK_ELSE

_W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tok(c: str) -> str:
    return rf"coalesce(regexp_extract_all(lower(replace({c}, 'İ', 'i')), '{_W}(?:{_W}|-)*{_W}'), [])"


def _no(words: str, stop: list[str]) -> str:
    return f"list_filter({words}, lambda z: NOT list_contains([{', '.join(map(_q, stop))}], z))"


def _stem(c: str) -> str:
    cut = " ".join(f"WHEN ends_with({c}, '{s}') AND length({c}) >= {len(s) + 3} THEN left({c}, length({c}) - {len(s)})" for s in SUFFIXES)
    return f"CASE WHEN length({c}) <= 3 THEN {c} {cut} ELSE {c} END"


def _english(w: str, c: str) -> str:
    return f"""CASE WHEN length({c}) <= 3 THEN {c} WHEN ends_with({w}, 'sses') THEN left({w}, length({w}) - 2) WHEN ends_with({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y'
        WHEN ends_with({w}, 'ing') AND length({w}) > 5 THEN left({w}, length({w}) - 3) WHEN ends_with({w}, 'ed') AND length({w}) > 4 THEN left({w}, length({w}) - 2)
        WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"""


def _vocab(source: str) -> str:
    """CTEs: vocab(term, stem) of the words of a query with a column w of word lists."""
    return f"v0 AS (SELECT DISTINCT unnest(w) AS term FROM ({source})), v1 AS (SELECT term, {_stem('term')} AS cut FROM v0), vocab AS (SELECT term, {_english('cut', 'term')} AS stem FROM v1)"


_SENT = lambda c: rf"list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: regexp_replace(z, '^\s+|\s+$', '', 'g')), lambda z: z <> '')"
_ALL_WORDS = f"SELECT {_tok('content')} AS w FROM corpus_chunks UNION ALL SELECT {_tok('query')} FROM queries UNION ALL SELECT {_tok('response')} FROM attempts"
_ASKED = "(SELECT * FROM queries WHERE CAST(substr(query_id, 2) AS BIGINT) % 50 = 0)"
_MATCH = "(a.stem = b.stem OR (length(a.stem) >= 4 AND length(b.stem) >= 4 AND left(a.stem, least(5, least(length(a.stem), length(b.stem)))) = left(b.stem, least(5, least(length(a.stem), length(b.stem)))) AND least(length(a.stem), length(b.stem)) >= 4))"
_LISTS = """l0 AS (SELECT query_id, retrieval_type, chunk_id, min(rank) AS r FROM hits WHERE retrieval_type IN ('BM25_Sparse', 'Dense_Cosine') GROUP BY ALL),
lists AS (SELECT query_id, chunk_id, CASE WHEN retrieval_type = 'BM25_Sparse' THEN 0 ELSE 1 END AS list_no, row_number() OVER (PARTITION BY query_id, retrieval_type ORDER BY r, chunk_id) AS rank FROM l0)"""
_FUSED = (
    _LISTS
    + """, f0 AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 1000000 + rank) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS INT) AS rank FROM f0)"""
)
_CTX = _FUSED + ", ctx AS (SELECT query_id, chunk_id, rank FROM fused WHERE rank <= 5)"
_ANSWERS = "answers AS (SELECT query_id, attempt, max(response) AS response FROM attempts GROUP BY ALL)"


def _support(stop: list[str]) -> str:
    """CTEs up to sup(query_id, attempt, sentence_index, content, free, matched, total, grounded)."""
    return f"""{_CTX}, {_ANSWERS}, {_vocab(_ALL_WORDS)},
s0 AS (SELECT query_id, attempt, {_SENT('response')} AS x FROM answers), s1 AS (SELECT query_id, attempt, unnest(x) AS sentence, unnest(range(1, len(x) + 1)) AS sentence_index FROM s0),
sents AS (SELECT *, {_no(_tok('sentence'), stop)} AS content FROM s1), flagged AS (SELECT *, (len(content) <= 2 AND (ends_with(sentence, '?') OR length(sentence) < 35)) OR len(content) = 0 AS free FROM sents),
cw AS (SELECT DISTINCT ctx.query_id, v.stem FROM ctx JOIN (SELECT chunk_id, unnest({_no(_tok('content'), stop)}) AS term FROM corpus_chunks) c USING (chunk_id) JOIN vocab v USING (term)),
ww AS (SELECT query_id, attempt, sentence_index, unnest(content) AS term, unnest(range(len(content))) AS i FROM flagged WHERE NOT free), aw AS (SELECT ww.*, v.stem FROM ww JOIN vocab v USING (term)),
uq AS (SELECT DISTINCT query_id, stem FROM aw), good AS (SELECT DISTINCT a.query_id, a.stem FROM uq a JOIN cw b ON a.query_id = b.query_id AND {_MATCH}),
hit AS (SELECT query_id, attempt, sentence_index, count(*) AS m FROM aw JOIN good USING (query_id, stem) GROUP BY ALL),
sup AS (SELECT f.query_id, f.attempt, f.sentence_index, f.content, f.free, coalesce(h.m, 0) AS matched, len(f.content) AS total, f.free OR 5 * coalesce(h.m, 0) >= 2 * len(f.content) AS grounded FROM flagged f LEFT JOIN hit h USING (query_id, attempt, sentence_index))"""


_VERDICTS = (
    _support(GUARD_STOP)
    + """, by_ AS (SELECT query_id, attempt, count(*) AS n, count_if(grounded) AS g FROM sup GROUP BY ALL), hq AS (SELECT DISTINCT query_id, true AS has FROM ctx),
r0 AS (SELECT a.query_id, a.attempt, coalesce(regexp_replace(a.response, '^\\s+|\\s+$', '', 'g'), '') = '' AS blank, has IS NULL AS bare, n, g FROM answers a LEFT JOIN by_ USING (query_id, attempt) LEFT JOIN hq USING (query_id)),
r1 AS (SELECT *, round(CASE WHEN blank OR bare THEN 0.0 WHEN n IS NULL THEN 1.0 ELSE g / n END, 6)::DOUBLE AS faithfulness, CAST(CASE WHEN blank OR bare THEN 1 ELSE coalesce(n - g, 0) END AS BIGINT) AS violations FROM r0),
verdicts AS (SELECT query_id, attempt, violations = 0 AND faithfulness >= 0.8 AS is_valid, faithfulness, violations, CASE WHEN blank THEN 'UngroundedClaim' WHEN bare THEN 'ContextDeficit' WHEN violations = 0 AND faithfulness >= 0.8 THEN 'None' WHEN violations > 0 THEN 'UngroundedClaim' ELSE 'ConfidenceBelowThreshold' END AS reason FROM r1)"""
)
_MESSAGES = (
    _VERDICTS
    + """, said AS (SELECT f.query_id, f.attempt, list('Ungrounded claim detected at sentence ' || f.sentence_index || ' (Support: ' || printf('%.1f', round(100.0::DOUBLE * matched / total, 1)) || ' %): "' || f.sentence || '"' ORDER BY f.sentence_index) AS m FROM sup JOIN flagged f USING (query_id, attempt, sentence_index) WHERE NOT sup.grounded GROUP BY ALL),
msgs AS (SELECT v.query_id, v.attempt, v.is_valid, CASE WHEN blank THEN ['Generated response is empty.'] WHEN bare THEN ['No source context chunks provided for grounding verification.'] ELSE coalesce(m, []) END AS m FROM verdicts v JOIN r1 USING (query_id, attempt) LEFT JOIN said USING (query_id, attempt))"""
)
_OUTCOMES = (
    _VERDICTS
    + """, ok AS (SELECT query_id, min(attempt) AS accepted FROM verdicts WHERE is_valid AND attempt <= 2 GROUP BY ALL), bad AS (SELECT query_id, max(attempt) AS last, arg_max(reason, attempt) AS why FROM verdicts WHERE attempt <= 2 GROUP BY ALL),
outcomes AS (SELECT q.query_id, CASE WHEN has IS NULL THEN 'FallbackDispatched' WHEN accepted IS NOT NULL THEN 'Completed' ELSE 'FallbackDispatched' END AS state, CAST(CASE WHEN has IS NULL THEN 0 ELSE coalesce(accepted, last, 0) END AS INT) AS attempts,
CASE WHEN has IS NULL THEN 'ContextDeficit' WHEN accepted IS NOT NULL THEN 'None' ELSE coalesce(why, 'None') END AS reason FROM queries q LEFT JOIN hq USING (query_id) LEFT JOIN ok USING (query_id) LEFT JOIN bad USING (query_id))"""
)
_FALLBACK = lambda r: "CASE " + " ".join(f"WHEN {r} = '{k}' THEN {_q(t)}" for k, t in FALLBACK.items()) + f" ELSE {_q(FALLBACK_ELSE)} END"
_REL = f"""{_CTX}, {_vocab(_ALL_WORDS)}, q0 AS (SELECT query_id, {_no(_tok('query'), TRIAD_STOP)} AS qt, coalesce(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '') = '' AS blank FROM queries),
qs AS (SELECT DISTINCT query_id, v.stem FROM (SELECT query_id, unnest(qt) AS term FROM q0) JOIN vocab v USING (term)), c0 AS (SELECT chunk_id, {_SENT('content')} AS x FROM corpus_chunks),
c1 AS (SELECT chunk_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM c0), tot AS (SELECT chunk_id, count(*) AS total FROM c1 GROUP BY ALL),
cs AS (SELECT DISTINCT chunk_id, i, v.stem FROM (SELECT chunk_id, i, unnest({_no(_tok('s'), TRIAD_STOP)}) AS term FROM c1) JOIN vocab v USING (term)),
pair AS (SELECT DISTINCT a.stem AS qa, b.stem AS cb FROM (SELECT DISTINCT stem FROM qs) a JOIN (SELECT DISTINCT stem FROM cs) b ON {_MATCH}),
h0 AS (SELECT DISTINCT ctx.query_id, cs.chunk_id, cs.i FROM ctx JOIN qs USING (query_id) JOIN pair ON pair.qa = qs.stem JOIN cs ON cs.chunk_id = ctx.chunk_id AND cs.stem = pair.cb), h1 AS (SELECT query_id, count(*) AS hit FROM h0 GROUP BY ALL),
t1 AS (SELECT query_id, sum(coalesce(total, 0)) AS total FROM ctx LEFT JOIN tot USING (chunk_id) GROUP BY ALL),
relevancy AS (SELECT q0.query_id, round_even((CASE WHEN total IS NULL OR blank THEN 0.0 WHEN len(qt) = 0 THEN 1.0 WHEN total > 0 THEN coalesce(hit, 0) / total ELSE 0.0 END)::DOUBLE, 3) AS context_relevancy FROM q0 LEFT JOIN t1 USING (query_id) LEFT JOIN h1 USING (query_id))"""
_ARE = f"""{_ANSWERS}, {_vocab(_ALL_WORDS)}, qq AS (SELECT query_id, list(DISTINCT v.stem) AS q FROM (SELECT query_id, unnest({_no(_tok('query'), TRIAD_STOP)}) AS term FROM queries) JOIN vocab v USING (term) GROUP BY ALL),
aa AS (SELECT query_id, attempt, list(DISTINCT v.stem) AS a FROM (SELECT query_id, attempt, unnest({_no(_tok('response'), TRIAD_STOP)}) AS term FROM answers) JOIN vocab v USING (term) GROUP BY ALL),
are AS (SELECT n.query_id, n.attempt, round_even(coalesce(len(list_intersect(q, a)) / (len(q) + len(a) - len(list_intersect(q, a))), 0.0)::DOUBLE, 3) AS answer_relevancy FROM answers n JOIN queries USING (query_id) LEFT JOIN qq USING (query_id) LEFT JOIN aa USING (query_id, attempt))"""
_POST = f"post AS (SELECT chunk_id, term, count(*) AS tf, dl FROM (SELECT chunk_id, len({_tok('content')}) AS dl, unnest({_tok('content')}) AS term FROM corpus_chunks) GROUP BY chunk_id, term, dl)"


def _bm25(k: int) -> str:
    return f"""{_POST}, st AS (SELECT count(*) AS n, avg(len({_tok('content')})) AS avgdl FROM corpus_chunks), df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL), qt AS (SELECT DISTINCT query_id, unnest({_tok('query')}) AS term FROM {_ASKED}),
bs AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1.0, avgdl))))), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL),
bm25 AS (SELECT query_id, chunk_id, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index, chunk_id) AS INT) AS rank FROM bs JOIN corpus_chunks USING (chunk_id) WHERE score > 0 QUALIFY rank <= {k})"""


def _embed(name: str, key: str, source: str, text: str) -> str:
    slots = ", ".join(f"sum(tf * CASE WHEN (b[{i + 1}] & {1 << (i % 8)}) <> 0 THEN 1 + b[{i + 1}] / 255.0::DOUBLE ELSE -(1 + b[{i + 1}] / 255.0::DOUBLE) END)" for i in range(32))
    hexes = ", ".join(f"CAST('0x' || substr(h, {2 * i + 1}, 2) AS INT)" for i in range(32))
    return f"""{name}0 AS (SELECT {key}, unnest({_tok(text)}) AS term FROM {source}), {name}1 AS (SELECT {key}, term, count(*) AS tf FROM {name}0 GROUP BY ALL), {name}2 AS (SELECT term, sha256(term) AS h FROM (SELECT DISTINCT term FROM {name}1)),
{name}3 AS (SELECT term, [{hexes}] AS b FROM {name}2), {name}4 AS (SELECT {key}, [{slots}] AS v FROM {name}1 JOIN {name}3 USING (term) GROUP BY {key}),
{name} AS (SELECT s.{key}, CASE WHEN v IS NULL THEN list_transform(range(32), lambda z: 0.0::DOUBLE) WHEN sqrt(list_sum(list_transform(v, lambda z: z * z))) > 1e-6 THEN list_transform(v, lambda z: z / sqrt(list_sum(list_transform(v, lambda y: y * y)))) ELSE v END AS vec FROM {source} s LEFT JOIN {name}4 USING ({key}))"""


_COS = lambda a, b: f"(CASE WHEN list_sum(list_transform({a}, lambda z: z::DOUBLE * z)) > 0 AND list_sum(list_transform({b}, lambda z: z::DOUBLE * z)) > 0 THEN list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda z: z::DOUBLE * z::DOUBLE)))) END)"


def _dense(k: int, place: str = "doc_id, chunk_index, chunk_id", source: str = "ds JOIN corpus_chunks USING (chunk_id)") -> str:
    return f"""ds AS (SELECT q.query_id, c.chunk_id, round({_COS('q.vec', 'c.vec')}, 6) AS score FROM qe q CROSS JOIN ce c), dense AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {place}) AS INT) AS rank FROM {source} WHERE score IS NOT NULL QUALIFY rank <= {k})"""


def _rerank(cand: str, threshold: float, k: int) -> str:
    grams = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    listed = lambda key, src, text: f"(SELECT {key}, list(v.stem ORDER BY i) AS st FROM (SELECT {key}, unnest({_tok(text)}) AS term, unnest(range(len({_tok(text)}))) AS i FROM {src}) JOIN vocab v USING (term) GROUP BY {key})"
    return f"""{_vocab(_ALL_WORDS)}, rq0 AS (SELECT query_id, {_tok('query')} AS raw FROM queries), rq1 AS (SELECT query_id, CASE WHEN len({_no('raw', RERANK_STOP)}) > 0 THEN {_no('raw', RERANK_STOP)} ELSE raw END AS cw FROM rq0),
rq2 AS (SELECT query_id, list(v.stem) AS qs FROM (SELECT query_id, unnest(cw) AS term FROM rq1) JOIN vocab v USING (term) GROUP BY ALL), rq3 AS (SELECT query_id, list_distinct({grams('st')}) AS qb FROM {listed('query_id', 'queries', 'query')}),
rc AS (SELECT chunk_id, st AS cs, {grams('st')} AS cb FROM {listed('chunk_id', 'corpus_chunks', 'content')}),
rr AS (SELECT k.query_id, k.chunk_id, k.rank AS prior, coalesce(len(list_filter(qs, lambda z: list_contains(cs, z))) / len(qs), 0.0)::DOUBLE AS coverage, CASE WHEN len(qb) > 0 AND len(cb) > 0 THEN least(1.0, len(list_filter(cb, lambda z: list_contains(qb, z))) / len(qb))::DOUBLE ELSE 0.0::DOUBLE END AS affinity
FROM {cand} k JOIN rc USING (chunk_id) LEFT JOIN rq2 USING (query_id) LEFT JOIN rq3 USING (query_id)), rs AS (SELECT *, round(0.55::DOUBLE * coverage + 0.25::DOUBLE * affinity + 0.2::DOUBLE * (1.0::DOUBLE / prior), 6) AS score FROM rr)
SELECT query_id, chunk_id, round(coverage, 6) AS coverage, round(affinity, 6) AS affinity, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior, chunk_id) AS INT) AS rank FROM rs WHERE score >= {threshold} QUALIFY rank <= {k}"""


_POINTS = f"pts AS (SELECT q.vec_id AS query_id, e.label AS doc, e.vec_id AS chunk_id, round(1 - greatest(0.0, least(1.0, coalesce({_COS('q.embedding', 'e.embedding')}, 0.0)))::DOUBLE, 4) AS distance FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"
_TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_PAGES = "pages AS (SELECT id AS file, unnest(string_split(content, chr(10) || chr(10))) AS text, CAST(unnest(range(1, len(string_split(content, chr(10) || chr(10))) + 1)) AS INT) AS page_no FROM corpus_documents)"
_NORM = lambda c: rf"regexp_replace({_TRIM(f'regexp_replace({_TRIM(c)}, ' + chr(39) + r'(^\s*\d+[\s\-–]*|[\s\-–]*\d+\s*$)' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\s+', ' ', 'g')"
_HEADS = rf"""{_PAGES}, pl AS (SELECT file, list_filter(string_split(text, chr(10)), lambda z: z <> '') AS l FROM pages WHERE coalesce({_TRIM('text')}, '') <> ''),
cand AS (SELECT file, unnest(list_concat(l[1:2], CASE WHEN len(l) > 2 THEN l[len(l):len(l)] ELSE [] END)) AS line FROM pl), heads AS (SELECT file, header, count(*) AS n FROM (SELECT file, lower({_NORM('line')}) AS header FROM cand) WHERE length(header) >= 10 GROUP BY file, header HAVING count(*) >= 2)"""


_LETTER = r"[\p{L}\p{M}\p{N}\p{Pc}]"
_NOT = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
_RESPACED = "CASE WHEN attempt > 1 THEN replace(response, ' ', '  ') ELSE response END"
_BLANK = lambda c: f"coalesce({_TRIM(c)}, '') = ''"


def _DOSES(response: str) -> str:
    """CTEs up to doses(query_id, attempt, found, lost). Signs between words are doubled, so each can bound the word on either side."""
    units = "mg|g|mcg|ml|cc|gr|mg/kg|IU|iu|x[0-9]+|tab|tablet|kapsül"
    found = rf"regexp_extract_all(regexp_replace({response}, '([^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}.])', '\1\1', 'g'), '(?i)(?:^|{_NOT})(\p{{Nd}}+(?:\.\p{{Nd}}+)?\s*(?:{units}))(?:{_NOT}|$)', 1)"
    return rf"""{_CTX}, {_ANSWERS}, d0 AS (SELECT query_id, attempt, list_transform(coalesce({found}, []), lambda z: regexp_replace(lower(z), '\s+', '', 'g')) AS l FROM answers),
d1 AS (SELECT query_id, attempt, list_filter(l, lambda z, i: list_position(l, z) = i) AS found FROM d0), fl AS (SELECT query_id, string_agg(regexp_replace(lower(replace(content, 'İ', 'i')), '\s+', '', 'g'), '' ORDER BY rank) AS flat FROM ctx JOIN corpus_chunks USING (chunk_id) GROUP BY ALL),
doses AS (SELECT query_id, attempt, found, list_filter(found, lambda z: NOT contains(coalesce(flat, ''), z)) AS lost FROM d1 LEFT JOIN fl USING (query_id))"""


_FAITH = f"""{_support(TRIAD_STOP)}, fa AS (SELECT query_id, attempt, round_even((count_if(grounded) / count(*))::DOUBLE, 3) AS f FROM sup GROUP BY ALL),
faith AS (SELECT query_id, attempt, coalesce(CASE WHEN query_id IN (SELECT query_id FROM ctx) THEN f END, 0.0)::DOUBLE AS faithfulness FROM answers LEFT JOIN fa USING (query_id, attempt))"""
_TRACES = "tr0 AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS INT) AS step_no FROM events), traces AS (SELECT user_id, event_id, step_no, ms - first_value(ms) OVER (PARTITION BY user_id ORDER BY step_no) AS elapsed_ms FROM tr0)"
_EVALUATED = f"""{_OUTCOMES}, ex AS (SELECT DISTINCT query_id, c AS chunk_id FROM (SELECT query_id, unnest(expected_chunk_ids) AS c FROM queries) WHERE c IS NOT NULL), ne AS (SELECT query_id, count(*) AS n_exp FROM ex GROUP BY ALL),
cx AS (SELECT DISTINCT ctx.query_id, ctx.chunk_id, length(content) AS len FROM ctx JOIN corpus_chunks USING (chunk_id)), nc AS (SELECT query_id, count(*) AS n_ctx, sum(len) AS ctx_len FROM cx GROUP BY ALL), nh AS (SELECT query_id, count(*) AS n_hit FROM cx SEMI JOIN ex USING (query_id, chunk_id) GROUP BY ALL),
{_TRACES}, late AS (SELECT 'q' || lpad(user_id::VARCHAR, 8, '0') AS query_id, arg_max(elapsed_ms, step_no) AS ms FROM traces GROUP BY ALL),
z AS (SELECT o.*, length(q.query) AS q_len, coalesce(n_exp, 0) AS e, coalesce(n_ctx, 0) AS c, coalesce(n_hit, 0) AS h, coalesce(ctx_len, 0) AS cl, coalesce(v.faithfulness, 0.0)::DOUBLE AS faithfulness, length(a.response) AS ol, coalesce(late.ms, 0) AS ms FROM outcomes o JOIN queries q USING (query_id) LEFT JOIN ne USING (query_id) LEFT JOIN nc USING (query_id) LEFT JOIN nh USING (query_id) LEFT JOIN late USING (query_id) LEFT JOIN verdicts v ON v.query_id = o.query_id AND v.attempt = o.attempts LEFT JOIN answers a ON o.state = 'Completed' AND a.query_id = o.query_id AND a.attempt = o.attempts),
y AS (SELECT *, CASE WHEN e = 0 OR c = 0 THEN 1.0 ELSE h / c END AS p FROM z), evaluated AS (SELECT query_id, state, e, faithfulness, round(CASE WHEN e = 0 THEN 1.0 ELSE h / e END, 6)::DOUBLE AS context_recall, round(p, 6)::DOUBLE AS context_precision, round(CASE WHEN c = 0 THEN 1.0 ELSE p END, 6)::DOUBLE AS noise_rejection, ms::BIGINT AS latency_ms, CAST(floor((coalesce(q_len, 0) + CASE WHEN state = 'Completed' THEN coalesce(ol, 0) ELSE length({_FALLBACK('reason')}) END + cl) / 4) AS BIGINT) AS total_tokens, state = 'Completed' AND faithfulness >= 0.85 AS passed FROM y)"""
# The five kinds of careless JSON by row, what is left of each out of its fence, and what a repair makes of it.
_RAW = r"""j0 AS (SELECT query_id, sentence_index, max(sentence) AS t FROM sentence_details WHERE sentence IS NOT NULL GROUP BY ALL), j1 AS (SELECT *, (sentence_index + length(t)) % 5 AS kind, replace(replace(replace(t, '\', '\\'), '"', '\"'), chr(10), '\n') AS qt FROM j0),
raws AS (SELECT *, CASE kind WHEN 0 THEN 'Result:' || chr(10) || '```json' || chr(10) || replace('{~id~: ~', '~', chr(39)) || query_id || replace('~, ~index~: ', '~', chr(39)) || sentence_index || replace(', ~text~: ~', '~', chr(39)) || t || replace('~, ~parts~: [~a~, ~b~,]', '~', chr(39)) || chr(10) || '```' WHEN 1 THEN '{"id": "' || query_id || '", "Index": ' || sentence_index || ', "text": "' || qt || '", "parts": ["a"],}' WHEN 2 THEN '{"id": ' || sentence_index || ', "index": ' || sentence_index || '}' WHEN 3 THEN t || ' ' ELSE '  ' END AS raw FROM j1),
cl AS (SELECT *, CASE WHEN regexp_matches(raw, '(?is)```(?:json)?\s*(.*?)\s*```') THEN regexp_replace(regexp_extract(raw, '(?is)```(?:json)?\s*(.*?)\s*```', 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace(raw, '^\s+|\s+$', '', 'g') END AS clean FROM raws),
q1 AS (SELECT *, regexp_replace(regexp_replace(clean, '([{\[,:])\s*''([^'']*)''\s*([}\],:])', '\1"\2"\3', 'g'), '([{\[,:])\s*''([^'']*)''\s*([}\],:])', '\1"\2"\3', 'g') AS u FROM cl), q2 AS (SELECT *, regexp_replace(u, ',\s*(\]|\})', '\1', 'g') AS w FROM q1),
js AS (SELECT *, CASE WHEN clean = '' THEN '{}' ELSE w || repeat(']', greatest(0, length(w) - length(replace(w, '[', '')) - length(w) + length(replace(w, ']', '')))) || repeat('}', greatest(0, length(w) - length(replace(w, '{', '')) - length(w) + length(replace(w, '}', '')))) END AS fixed FROM q2)"""
_STRICT = lambda c: rf"(json_valid({c}) AND NOT regexp_matches({c}, ',\s*[\]}}]'))"
# Case is ignored; dotted capital I and dotless i count as forms of i there.
_FORMS = lambda x: x.replace("İ", "[İi]").replace("A-Za-z", "A-Za-zıİ")
_HEADS_CI = _FORMS("ABSTRACT|ÖZET|SUMMARY|GİRİŞ|INTRODUCTION")


def _pick(*xs: str) -> str:
    return f"([{', '.join(map(_q, xs))}])[coalesce(total_characters, 0) % {len(xs)} + 1]"


def oracle_sql() -> dict[str, str]:
    tok, no = _tok, _no
    return {
        "tokenize_stats": f"SELECT id, len({tok('content')}) AS n_tokens, len(list_distinct({tok('content')})) AS n_distinct FROM corpus_documents",
        "stem_vocab": f"WITH {_vocab('SELECT ' + tok('content') + ' AS w FROM corpus_chunks')} SELECT term, stem FROM vocab",
        "content_tokens": f"SELECT query_id, len({no(tok('query'), RERANK_STOP)}) AS rerank_n, len({no(tok('query'), GUARD_STOP)}) AS guard_n, len({no(tok('query'), TRIAD_STOP)}) AS triad_n FROM queries",
        "sentence_stats": f"SELECT id, len({_SENT('content')}) AS n_sentences, coalesce(list_max(list_transform({_SENT('content')}, lambda z: length(z))), 0)::BIGINT AS longest FROM corpus_documents",
        "evidence_line_stats": rf"WITH x AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(content, '[\n.•\-]'), lambda z: {_TRIM('z')}), lambda z: z <> '') AS l FROM corpus_chunks) SELECT chunk_id, len(l) AS n_lines, len(list_filter(l, lambda z: length(z) >= 10)) AS n_usable FROM x",
        "bigram_counts": f"WITH {_vocab(_ALL_WORDS)}, x AS (SELECT query_id, unnest({tok('query')}) AS term, unnest(range(len({tok('query')}))) AS i FROM queries), y AS (SELECT query_id, list(stem ORDER BY i) AS s FROM x JOIN vocab USING (term) GROUP BY ALL), z AS (SELECT query_id, list_transform(range(1, len(s)), lambda i: s[i] || ' ' || s[i + 1]) AS b FROM y) SELECT q.query_id, coalesce(len(b), 0) AS n_bigrams, coalesce(len(list_distinct(b)), 0) AS n_distinct FROM queries q LEFT JOIN z USING (query_id)",
        "conversational_sentences": f"WITH {_ANSWERS}, s0 AS (SELECT query_id, attempt, unnest({_SENT('response')}) AS s FROM answers), s1 AS (SELECT *, {no(tok('s'), GUARD_STOP)} AS c FROM s0) SELECT query_id, attempt, count(*) AS n_sentences, count_if((len(c) <= 2 AND (ends_with(s, '?') OR length(s) < 35)) OR len(c) = 0)::BIGINT AS n_free FROM s1 GROUP BY ALL",
        "fuzzy_match_counts": f"WITH {_vocab(_ALL_WORDS)}, a AS (SELECT DISTINCT unnest({tok('query')}) AS term FROM queries), b AS (SELECT DISTINCT unnest({tok('content')}) AS term FROM corpus_chunks), aa AS (SELECT term, stem FROM a JOIN vocab USING (term)), bb AS (SELECT term, stem FROM b JOIN vocab USING (term)) SELECT a.term AS asked, count(b.term) AS n_matches FROM aa a LEFT JOIN bb b ON {_MATCH} GROUP BY ALL",
        "postings_tf": f"WITH {_POST} SELECT * FROM post",
        "term_df": f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term",
        "corpus_stats": f"SELECT count(*) AS n, round(avg(len({tok('content')})), 6) AS avgdl FROM corpus_chunks",
        "bm25_topk": f"WITH {_bm25(5)} SELECT * FROM bm25",
        "hash_embed": f"WITH {_embed('qe', 'query_id', 'queries', 'query')} SELECT query_id, CAST(unnest(range(32)) AS INT) AS slot, round(unnest(vec), 6) + 0.0::DOUBLE AS value FROM qe",
        "dense_topk_hash": f"WITH {_embed('qe', 'query_id', _ASKED, 'query')}, {_embed('ce', 'chunk_id', 'corpus_chunks', 'content')}, {_dense(5)} SELECT * FROM dense",
        "dense_topk_vectors": f"WITH qe AS (SELECT vec_id AS query_id, embedding AS vec FROM embeddings WHERE vec_id % 50 = 0), ce AS (SELECT vec_id AS chunk_id, embedding AS vec FROM embeddings), {_dense(5, 'chunk_id', 'ds')} SELECT * FROM dense",
        "vector_distances": f"SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0.0, least(1.0, coalesce({_COS('q.embedding', 'e.embedding')}, 0.0)))::DOUBLE, 6) + 0.0::DOUBLE AS cosine, round(sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)))), 6) AS euclidean FROM embeddings e CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q",
        "vector_upsert": "WITH o AS (SELECT vec_id, label::BIGINT AS label, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal FROM embeddings), n AS (SELECT user_id * 7 AS vec_id, count(*) AS label FROM events GROUP BY ALL) SELECT o.vec_id, coalesce(n.label, o.label) AS label, o.ordinal FROM o LEFT JOIN n USING (vec_id) UNION ALL SELECT vec_id, label, (SELECT max(ordinal) FROM o) + row_number() OVER (ORDER BY vec_id) FROM n WHERE vec_id NOT IN (SELECT vec_id FROM o)",
        "rrf_fusion": f"WITH {_FUSED} SELECT query_id, chunk_id, score::DOUBLE AS score, rank FROM fused WHERE rank <= 10",
        "rerank_scores": f"WITH {_LISTS}, cand AS (SELECT query_id, chunk_id, rank FROM lists WHERE list_no = 0), {_rerank('cand', 0.25, 3)}",
        "hybrid_topk": f"WITH {_bm25(6)}, {_embed('qe', 'query_id', _ASKED, 'query')}, {_embed('ce', 'chunk_id', 'corpus_chunks', 'content')}, {_dense(6)}, lists AS (SELECT query_id, chunk_id, 0 AS list_no, rank FROM bm25 UNION ALL SELECT query_id, chunk_id, 1, rank FROM dense), {_FUSED[_FUSED.index('f0 AS'):]}, cand AS (SELECT query_id, chunk_id, rank FROM fused WHERE rank <= 6), {_rerank('cand', 0.2, 3)}",
        "grounding_sentences": f"WITH {_support(GUARD_STOP)} SELECT query_id, attempt, CAST(sentence_index AS INT) AS sentence_index, matched, total, grounded FROM sup",
        "grounding_verdicts": f"WITH {_VERDICTS} SELECT * FROM verdicts",
        "faithfulness_evidence": rf"""WITH {_support(TRIAD_STOP)}, e0 AS (SELECT chunk_id, doc_id, list_filter(list_transform(regexp_split_to_array(content, '[\n.•\-]'), lambda z: {_TRIM('z')}), lambda z: z <> '') AS l FROM corpus_chunks),
e1 AS (SELECT chunk_id, doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM e0), e2 AS (SELECT DISTINCT chunk_id, line_no, v.stem FROM (SELECT chunk_id, line_no, unnest({no(tok('line'), TRIAD_STOP)}) AS term FROM e1 WHERE length(line) >= 10) JOIN vocab v USING (term)),
pair AS (SELECT a.stem AS sa, b.stem AS sb FROM (SELECT DISTINCT stem FROM aw) a JOIN (SELECT DISTINCT stem FROM e2) b ON {_MATCH}),
e3 AS (SELECT aw.query_id, aw.attempt, aw.sentence_index, ctx.rank, e2.chunk_id, e2.line_no, count(DISTINCT aw.i) AS m FROM aw JOIN pair ON pair.sa = aw.stem JOIN ctx ON ctx.query_id = aw.query_id JOIN e2 ON e2.chunk_id = ctx.chunk_id AND e2.stem = pair.sb GROUP BY ALL),
e4 AS (SELECT * FROM e3 QUALIFY row_number() OVER (PARTITION BY query_id, attempt, sentence_index ORDER BY m DESC, rank, line_no) = 1)
SELECT s.query_id, s.attempt, CAST(s.sentence_index AS INT) AS sentence_index, CASE WHEN free THEN 1.0::DOUBLE ELSE round_even((matched / total)::DOUBLE, 2) END AS support_ratio, e4.m AS line_matches, e1.doc_id AS best_doc_id, e1.line AS best_snippet FROM sup s LEFT JOIN e4 USING (query_id, attempt, sentence_index) LEFT JOIN e1 ON e1.chunk_id = e4.chunk_id AND e1.line_no = e4.line_no""",
        "context_relevancy": f"WITH {_REL} SELECT * FROM relevancy",
        "answer_relevancy": f"WITH {_ARE} SELECT * FROM are",
        "triad_scores": f"WITH a AS (WITH {_ARE} SELECT * FROM are), r AS (WITH {_REL} SELECT * FROM relevancy), s AS (WITH {_FAITH} SELECT * FROM faith) SELECT query_id, attempt, context_relevancy, faithfulness, answer_relevancy FROM a JOIN s USING (query_id, attempt) LEFT JOIN r USING (query_id)",
        "violation_messages": f"WITH {_MESSAGES} SELECT query_id, attempt, array_to_string(m, chr(10)) AS messages FROM msgs WHERE len(m) > 0",
        "supervisor_prompts": f"""WITH {_MESSAGES}, dc AS (SELECT query_id, string_agg('[DOC_' || rank || ']: ' || coalesce(content, '') || chr(10), '' ORDER BY rank) AS docs FROM ctx JOIN corpus_chunks USING (chunk_id) GROUP BY ALL),
fb AS (SELECT query_id, attempt + 1 AS attempt, 'PREVIOUS RESPONSE FAILED FACTUAL VALIDATION:' || chr(10) || array_to_string(list_transform(m, lambda z: '- ' || z), chr(10)) || chr(10) || 'Strictly remove all ungrounded claims and stick strictly to verified facts.' AS told FROM msgs WHERE NOT is_valid),
pr AS (SELECT v.query_id, v.attempt, '### SOURCE CONTEXT DOCUMENTS:' || chr(10) || coalesce(docs, '') || chr(10) || CASE WHEN told IS NULL THEN '' ELSE '### CRITIC FEEDBACK FROM PREVIOUS ATTEMPT:' || chr(10) || told || chr(10) || chr(10) END || '### USER QUERY:' || chr(10) || coalesce(query, '') || chr(10) || chr(10) || '### FACTUAL ANSWER (Ground directly in DOCs):' || chr(10) AS prompt FROM msgs v JOIN queries USING (query_id) LEFT JOIN fb USING (query_id, attempt) LEFT JOIN dc USING (query_id))
SELECT query_id, attempt, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM pr""",
        "chat_gate": f"WITH f AS (WITH {_FAITH} SELECT * FROM faith), d AS (WITH {_DOSES('response')} SELECT * FROM doses) SELECT query_id, attempt, CASE WHEN faithfulness >= 0.7 AND len(lost) = 0 THEN 'SUCCESS / PASSED' ELSE 'BLOCKED / WARNING' END AS status FROM f JOIN d USING (query_id, attempt)",
        "retrieval_lift": "WITH h AS (SELECT query_id, retrieval_type AS k, coalesce(score, 0.0)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id, retrieval_type ORDER BY rank, chunk_id, coalesce(score, 0.0) DESC) AS n FROM hits WHERE retrieval_type IN ('CrossEncoder_Reranked', 'Dense_Cosine')), x AS (SELECT query_id, max(score) FILTER (k = 'CrossEncoder_Reranked') AS r, max(score) FILTER (k = 'Dense_Cosine') AS d FROM h WHERE n = 1 GROUP BY ALL) SELECT query_id, coalesce(round_even(r, 2), 0.0)::DOUBLE AS confidence, coalesce(round_even((r - d) * 100, 1), 0.0)::DOUBLE + 0.0::DOUBLE AS lift FROM x",
        "hybrid_index": f"SELECT chunk_id, len({tok('content')}) AS n_words, len(list_distinct({tok('content')})) AS n_terms, CASE WHEN len({tok('content')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM corpus_chunks",
        "ranking_metrics": f"""WITH {_FUSED}, rel AS (SELECT DISTINCT query_id, c AS chunk_id FROM (SELECT query_id, unnest(expected_chunk_ids) AS c FROM queries) WHERE c IS NOT NULL), nr AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL),
h AS (SELECT query_id, count_if(rank <= 5) AS hits, min(rank) AS f, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM fused JOIN rel USING (query_id, chunk_id) GROUP BY ALL), ids AS (SELECT query_id FROM fused UNION SELECT query_id FROM rel)
SELECT query_id, round(coalesce(hits / 5.0, 0.0)::DOUBLE, 6) AS precision_at_k, round(coalesce(hits / n_rel, 0.0)::DOUBLE, 6) AS recall_at_k, round(coalesce(1 / f, 0.0)::DOUBLE, 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(5, n_rel) + 1), lambda i: 1 / log2(i + 1))), 0.0)::DOUBLE, 6) AS ndcg_at_k FROM ids LEFT JOIN nr USING (query_id) LEFT JOIN h USING (query_id)""",
        "auto_labels": f"""WITH {_CTX}, {_vocab(_ALL_WORDS)}, q AS (SELECT DISTINCT query_id, v.stem FROM (SELECT query_id, unnest({tok('query')}) AS term FROM queries) JOIN vocab v USING (term) WHERE length(term) > 2), c AS (SELECT DISTINCT chunk_id, v.stem FROM (SELECT chunk_id, unnest({tok('content')}) AS term FROM corpus_chunks) JOIN vocab v USING (term)),
hit AS (SELECT DISTINCT ctx.query_id, ctx.chunk_id FROM ctx JOIN q USING (query_id) JOIN c ON c.chunk_id = ctx.chunk_id AND c.stem = q.stem) SELECT * FROM hit UNION ALL SELECT query_id, arg_min(chunk_id, rank) FROM ctx WHERE query_id NOT IN (SELECT query_id FROM hit) GROUP BY ALL""",
        "dosage_guard": f"WITH {_DOSES(_RESPACED)} SELECT query_id, attempt, len(found) AS extracted, len(lost) AS missing, len(lost) = 0 AS is_valid, array_to_string(lost, ',') AS lost FROM doses",
        "breaker_fallback": f"WITH {_VERDICTS}, x AS (SELECT *, sum(CASE WHEN is_valid THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY attempt) AS n FROM verdicts), y AS (SELECT *, NOT is_valid AND (n >= 2 OR reason = 'ContextDeficit') AS trips FROM x) SELECT query_id, attempt, trips, CASE WHEN trips THEN {_FALLBACK('reason')} END AS fallback FROM y",
        "supervisor_outcomes": f"WITH {_OUTCOMES} SELECT * FROM outcomes",
        "exec_evaluation": f"WITH {_EVALUATED} SELECT query_id, faithfulness, context_recall, context_precision, noise_rejection, latency_ms, total_tokens, passed FROM evaluated",
        "run_summary": f"WITH {_EVALUATED}, k AS (SELECT *, CASE WHEN coalesce(len(list_filter(expected_chunk_ids, lambda z: z IS NOT NULL)), 0) = 0 THEN state = 'FallbackDispatched' ELSE passed END AS ok FROM evaluated JOIN queries USING (query_id)) SELECT count(*) AS cases, count_if(ok)::BIGINT AS as_expected, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS pass_rate, round(avg(faithfulness), 6) AS mean_faithfulness, sum(latency_ms)::BIGINT AS total_ms FROM k",
        "json_repair": f"WITH {_RAW} SELECT query_id, sentence_index, fixed, {_STRICT('fixed')} AS is_json, CASE WHEN clean = '' THEN 'EmptyOutput' WHEN {_STRICT('clean')} THEN 'None' ELSE 'InvalidJson' END AS raw_code FROM js",
        "json_typed": rf"""WITH {_RAW}, a AS (SELECT *, regexp_replace(clean, ',\s*(\]|\}})', '\1', 'g') AS c1, regexp_replace(fixed, ',\s*(\]|\}})', '\1', 'g') AS c2 FROM js),
b AS (SELECT *, CASE WHEN {_STRICT('c1')} THEN c1 WHEN {_STRICT('c2')} THEN c2 END AS c FROM a), f AS (SELECT *, CASE WHEN json_type(c) = 'OBJECT' THEN c END AS o FROM b),
g AS (SELECT *, coalesce(json_type(o, '$.id'), 'NULL') AS ti, coalesce(json_type(o, '$.index'), json_type(o, '$.Index'), 'NULL') AS tx, coalesce(json_type(o, '$.text'), 'NULL') AS tt FROM f), h AS (SELECT *, o IS NOT NULL AND ti IN ('VARCHAR', 'NULL') AND tx IN ('UBIGINT', 'BIGINT', 'NULL') AND tt IN ('VARCHAR', 'NULL') AS ok FROM g)
SELECT query_id, sentence_index, CASE WHEN clean = '' THEN 'EmptyOutput' WHEN clean = 'null' THEN 'NullParsedObject' WHEN ok THEN 'None' ELSE 'SchemaViolation' END AS code, CASE WHEN ok AND clean <> '' THEN json_extract_string(o, '$.id') END AS id, CASE WHEN ok AND clean <> '' THEN coalesce(json_extract_string(o, '$.index'), json_extract_string(o, '$.Index'))::BIGINT END AS index, CASE WHEN ok AND clean <> '' THEN md5(json_extract_string(o, '$.text')) END AS text_md5 FROM h""",
        "trace_durations": f"WITH {_TRACES} SELECT *, elapsed_ms - coalesce(lag(elapsed_ms) OVER (PARTITION BY user_id ORDER BY step_no), 0) AS step_ms FROM traces",
        "corpus_summaries": "SELECT id, file_name, file_size_bytes, total_pages, total_characters, total_chunks, CAST(row_number() OVER (PARTITION BY year(uploaded_at AT TIME ZONE 'UTC') ORDER BY uploaded_at DESC, id) AS INT) AS place_in_year FROM corpus_documents",
        "document_order": "SELECT id, CAST(row_number() OVER (PARTITION BY CAST(uploaded_at AT TIME ZONE 'UTC' AS DATE) ORDER BY uploaded_at, id) AS INT) AS place_in_day FROM corpus_documents",
        "document_lookup": "SELECT doc_id, file_name, chunk_id, chunk_index FROM corpus_chunks JOIN corpus_documents ON id = doc_id WHERE doc_id = (SELECT id FROM corpus_documents ORDER BY coalesce(total_characters, 0) DESC, id DESC LIMIT 1)",
        "file_routes": "SELECT lower(regexp_extract(file_name, '\\.([^./]+)$', 1)) AS extension, CASE WHEN extension = 'pdf' THEN 'pages' WHEN extension IN ('txt', 'md', 'json', 'csv', 'log') THEN 'text' ELSE 'none' END AS route, count(*) AS n FROM corpus_documents GROUP BY ALL",
        "chunk_order": "SELECT doc_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS ordinal FROM corpus_chunks",
        "corpus_totals": "SELECT count(*) AS documents, sum(total_characters)::BIGINT AS characters, sum(total_chunks)::BIGINT AS chunks, sum(file_size_bytes)::BIGINT AS bytes FROM corpus_documents",
        "corpus_upload": "SELECT id AS file, CAST(len(string_split(content, chr(10) || chr(10))) AS INT) AS total_pages, length(content)::BIGINT AS total_characters, (SELECT count(*) FROM corpus_chunks c WHERE c.doc_id = d.id) AS total_chunks, md5(content) AS content_md5 FROM corpus_documents d",
        "corpus_upsert": "SELECT id, CASE WHEN file_name LIKE '%.pdf' THEN 'new_' || file_name ELSE file_name END AS file_name, (SELECT count(*) FROM corpus_chunks c WHERE c.doc_id = d.id AND (d.file_name NOT LIKE '%.pdf' OR c.chunk_index = 0)) AS n_chunks FROM corpus_documents d",
        "corpus_delete": "WITH u AS (SELECT DISTINCT doc_id FROM corpus_chunks SEMI JOIN hits USING (chunk_id)) SELECT d.id, count(*) AS n_chunks FROM corpus_documents d JOIN u ON u.doc_id = d.id JOIN corpus_chunks c ON c.doc_id = d.id GROUP BY ALL",
        "header_fingerprints": f"WITH {_HEADS} SELECT file, header, n FROM heads",
        "header_strip": rf"""WITH {_HEADS}, h1 AS (SELECT file, list(header) AS hs FROM heads GROUP BY ALL), x AS (SELECT p.file, page_no, text, string_split(text, chr(10)) AS l, coalesce(hs, []) AS hs FROM pages p LEFT JOIN h1 USING (file)), y AS (SELECT *, lower({_NORM('l[1]')}) AS n1, lower({_NORM('coalesce(l[2], ' + chr(39) * 2 + ')')}) AS n2 FROM x),
z AS (SELECT *, CASE WHEN n2 <> '' AND len(list_filter(hs, lambda h: h = n2 OR (length(n2) >= 15 AND (contains(n2, h) OR contains(h, n2))))) > 0 THEN 2 WHEN n1 <> '' AND len(list_filter(hs, lambda h: h = n1 OR (length(n1) >= 15 AND (contains(n1, h) OR contains(h, n1))))) > 0 THEN 1 ELSE 0 END AS removed FROM y)
SELECT file, page_no, CAST(removed AS INT) AS removed, md5(CASE WHEN removed > 0 THEN coalesce(array_to_string(l[removed + 1:], chr(10)), '') ELSE text END) AS text_md5 FROM z""",
        "page_cleaning": rf"""WITH p AS (SELECT id, {_pick('CASE REPORT', 'KLİNİK ÇALIŞMA', 'klinik calisma', 'Review article', '')} || chr(10) || coalesce(metadata['Journal'], '') || chr(10) || {_pick('Cite this article as:', 'CITE THIS ARTICLE AS:', 'cite this article as:')} || ' ' || coalesce(metadata['Authors'], '') || '. ' || file_name || '. ' || coalesce(metadata['Journal'], '') || '. 2020' || chr(10) || 'DOI: ' || coalesce(metadata['Doi'], '') || '.' || chr(10) || {_pick('ABSTRACT', 'özet', 'Özet', 'GİRİŞ', 'introduction', 'Summary', 'Results')} || ' C oronary ' || coalesce(content, '') AS page FROM corpus_documents),
c AS (SELECT *, {_TRIM(r"regexp_replace(regexp_extract(page, '(?i)Cite this article as:\s*([^\r\n]+)', 1), '\s+', ' ', 'g')")} AS cite, list_filter(string_split(page, chr(10)), lambda z: z <> '')[1:4] AS first4, (?1) AS at0 FROM p), k AS (SELECT *, list_filter(list_transform(string_split(cite, '.'), lambda z: {_TRIM('z')}), lambda z: z <> '') AS parts, strpos(lower(replace(page, 'İ', 'I')), 'cite this article as:') AS cp FROM c),
n AS (SELECT *, CASE WHEN regexp_matches(page, '(?i)(?:^|[\n\r])\s*(?:{_HEADS_CI})(?:{_NOT}|$)') THEN length(regexp_extract(page, '(?is)^(.*?)(?:^|[\n\r])\s*(?:{_HEADS_CI})(?:{_NOT}|$)', 1)) + 1 ELSE 0 END AS hp, strpos(substr(page, cp), chr(10)) AS feed FROM k)
SELECT id, nullif(regexp_replace(regexp_extract(page, '10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+'), '[.;,]+$', ''), '') AS doi, cite AS citation, parts[1] AS authors, CASE WHEN len(parts) >= 3 THEN parts[3] WHEN len(parts) = 2 AND length(parts[2]) > 3 THEN parts[2] END AS journal,
nullif({_TRIM(rf"regexp_replace(regexp_extract(array_to_string(first4, ' '), '(?i)({_FORMS(JOURNALS)})', 1), '\s+', ' ', 'g')")}, '') AS banner,
md5(regexp_replace({_TRIM(rf"regexp_replace(regexp_replace(regexp_replace(page, '(?i)(^|\n|\r)\s*({_FORMS(LINE_BADGES)})\s*($|\n|\r)', chr(10), 'g'), '(?i)(^|{_NOT})({_FORMS(BADGES)})({_NOT}|$)', '\1\3', 'g'), '[ \t]+', ' ', 'g')")}, '\b([A-Z])\s+([a-z]{{2,}})\b', '\1\2', 'g')) AS clean_md5,
CAST(length(CASE WHEN hp > 1 THEN {_TRIM("substr(page, hp)")} WHEN cp > 0 AND feed > 0 THEN {_TRIM("substr(page, cp + feed - 1)")} ELSE page END) AS INT) AS body_length FROM n""".replace(", (?1) AS at0", ""),
        "corpus_ingest": rf"WITH {_PAGES}, f AS (SELECT file, page_no, text FROM pages WHERE NOT ({_BLANK('text')})), w AS (SELECT file, count(*)::INT AS total_pages, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS content FROM f GROUP BY ALL) SELECT file, total_pages, length(content)::BIGINT AS total_characters, true AS chunked, 0::BIGINT AS too_long, md5(content) AS content_md5 FROM w",
        "inline_split": f"WITH x AS (SELECT id, total_pages > 1 AS marked, CASE WHEN total_pages > 1 THEN 'Doküman 1: ' ELSE '' END || content AS content FROM corpus_documents WHERE content IS NOT NULL), y AS (SELECT id, CASE WHEN marked THEN list_filter(list_transform(string_split(content, chr(10)), lambda z: {_TRIM('z')}), lambda z: z <> '') ELSE [{_TRIM('content')}] END AS l FROM x) SELECT id, 'doc_' || unnest(range(1, len(l) + 1)) AS doc_id, md5(unnest(l)) AS content_md5 FROM y",
        "base_names": "SELECT regexp_replace(chunk_id, '_c[0-9]+$', '') AS base, count(*) AS n_hits FROM hits GROUP BY ALL",
        "page_metadata": f"""WITH {_PAGES}, x AS (SELECT p.file, p.page_no, list_concat(list_filter(coalesce(map_entries(metadata), []), lambda e: e.key NOT IN ('SourceFile', 'PageNumber', 'TotalPages', 'FileType', 'IsScannedOrImageOnly')), map_entries(MAP {{'SourceFile': file_name, 'PageNumber': p.page_no::VARCHAR, 'TotalPages': total_pages::VARCHAR, 'FileType': 'PDF', 'IsScannedOrImageOnly': CASE WHEN length({_TRIM('text')}) < 10 THEN 'True' ELSE 'False' END}})) AS m FROM pages p JOIN corpus_documents d ON d.id = p.file)
SELECT file, page_no, len(m) AS n_keys, md5(array_to_string(list_transform(list_sort(m), lambda e: e.key || '=' || coalesce(e.value, '')), chr(10))) AS metadata_md5 FROM x""",
        "chunk_invariants": f"SELECT id AS doc_id, true AS dense, true AS grows, true AS fits, true AS within FROM corpus_documents WHERE NOT ({_BLANK('content')})",
        "nearest_five": f"WITH {_POINTS} SELECT query_id, chunk_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS rank FROM pts QUALIFY rank <= 5",
        "polar_projection": f"WITH {_POINTS}, p AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY doc) - 1 AS sector, row_number() OVER (PARTITION BY query_id, doc ORDER BY chunk_id) - 1 AS i, count(*) OVER (PARTITION BY query_id, doc) AS n FROM pts), m AS (SELECT *, max(sector) OVER (PARTITION BY query_id) + 1 AS k FROM p), g AS (SELECT *, least(2 * pi() / k * 0.85, n * 0.25) AS span FROM m), a AS (SELECT *, -pi() / 2 + sector * 2 * pi() / k + CASE WHEN n > 1 THEN i / (n - 1) * span ELSE span / 2 END AS angle, greatest(0.12, least(1.0, distance * 1.1)) AS r FROM g) SELECT query_id, chunk_id, round((r * cos(angle))::DOUBLE, 3) + 0.0::DOUBLE AS x, round((r * sin(angle))::DOUBLE, 3) + 0.0::DOUBLE AS y FROM a",
        "cross_doc_bridges": f"WITH {_POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc, chunk_id) AS o FROM pts) SELECT a.query_id, a.chunk_id AS a, count(*) AS n_bridges FROM o a JOIN o b ON a.query_id = b.query_id AND a.o < b.o AND a.doc <> b.doc AND abs(a.distance - b.distance) < 0.06 AND a.distance < 0.9 GROUP BY ALL",
        "chunk_links": "SELECT doc_id, chunk_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id) AS next_id FROM corpus_chunks QUALIFY next_id IS NOT NULL",
        "line_locator": r"""WITH d AS (SELECT query_id, sentence_index, max({'d': best_doc_id, 's': coalesce(sentence, ''), 'p': coalesce(best_snippet, '')}) AS x FROM sentence_details WHERE best_doc_id IS NOT NULL GROUP BY ALL), q AS (SELECT query_id || '#' || sentence_index AS row_id, x.d AS doc_id, lower(trim(regexp_replace(x.p, '^[0-9]\.\s*', ''))) AS snip, list_filter(regexp_split_to_array(regexp_replace(lower(x.s), '[.,\/#!$%\^&\*;:{}=\-_`~()?"''0-9]', ' ', 'g'), '\s+'), lambda z: length(z) >= 4) AS words FROM d),
l AS (SELECT id AS doc_id, lower(unnest(string_split(content, chr(10)))) AS line, unnest(range(len(string_split(content, chr(10))))) AS line_no FROM corpus_documents), j AS (SELECT row_id, line_no, length(snip) > 6 AND contains(line, left(snip, 30)) AS holds, len(list_filter(words, lambda z: contains(line, z))) AS n FROM q JOIN l USING (doc_id)),
b AS (SELECT row_id, min(CASE WHEN holds THEN line_no END) AS f, max(n) AS top, arg_max(line_no, n * 100000 - line_no) AS most FROM j GROUP BY ALL) SELECT row_id, CAST(coalesce(f, CASE WHEN top >= 2 THEN most END, -1) AS INT) AS line_no FROM q LEFT JOIN b USING (row_id)""",
        "answer_flags": "SELECT query_id, count_if(is_grounded)::BIGINT AS grounded, count_if(NOT is_grounded)::BIGINT AS ungrounded, coalesce(bool_or(NOT is_grounded), false) AS has_ungrounded FROM (SELECT DISTINCT * FROM sentence_details) GROUP BY ALL",
    }
