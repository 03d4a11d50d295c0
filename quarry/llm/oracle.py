"""The SQL that checks those queries of the numbered problems whose results are exact, written for DuckDB.

The consistent form of problem 2 is written out here a second time, in SQL, so
the operators are compared with a rule of their own and not with themselves.
"""

from __future__ import annotations

from quarry.llm.visual_form import CYRILLIC, CYRILLIC_LATIN, GREEK, GREEK_LATIN, HYPHENS, SPACES

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# Joined letters, and signs that stand for several.
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "№": "No", "™": "TM"}
_IGNORABLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean(c: str) -> str:
    """The text without what cannot be seen, in composed plain characters."""
    x = f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '{_IGNORABLE}', '', 'g')"
    x = f"translate({x}, {_q(_WIDE + HYPHENS + SPACES)}, {_q(_PLAIN + '-' * len(HYPHENS) + ' ' * len(SPACES))})"
    for a, b in _LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize({x})"


_FOREIGN = r"[\x{0370}-\x{052F}]"
_LETTERS = r"[\p{L}\p{M}\p{Nl}\p{No}]"
_TO = {"latin": (CYRILLIC + GREEK, CYRILLIC_LATIN + GREEK_LATIN), "cyr": (CYRILLIC_LATIN, CYRILLIC), "gr": (GREEK_LATIN, GREEK)}


def forms(name: str, key: str, source: str, text: str) -> str:
    """CTEs up to {name}({key}, raw, form): the consistent form of each text. A word with letters of two alphabets takes the one that fits all its letters."""
    twins = "[" + CYRILLIC + GREEK + "]"
    mixed = f"""CASE WHEN NOT regexp_matches(w, '{_FOREIGN}') THEN w
        WHEN regexp_replace(regexp_replace(w, '[^\\x{{0370}}-\\x{{052F}}]', '', 'g'), '{twins}', '', 'g') = '' AND (latin OR regexp_matches(w, '[^\\x{{0370}}-\\x{{052F}}]')) THEN translate(w, {_q(_TO['latin'][0])}, {_q(_TO['latin'][1])})
        WHEN regexp_replace(regexp_replace(w, '[^\\x{{0370}}-\\x{{052F}}]', '', 'g'), '{twins}', '', 'g') <> '' AND regexp_matches(w, '[^\\x{{0370}}-\\x{{052F}}]') THEN
            CASE WHEN regexp_matches(regexp_replace(w, '{twins}', '', 'g'), '^[^\\x{{0370}}-\\x{{052F}}]*[\\x{{0400}}-\\x{{052F}}]') THEN translate(w, {_q(_TO['cyr'][0])}, {_q(_TO['cyr'][1])}) ELSE translate(w, {_q(_TO['gr'][0])}, {_q(_TO['gr'][1])}) END
        ELSE w END"""
    return f"""{name}0 AS (SELECT {key}, {text} AS raw, {_clean(text)} AS t FROM {source} WHERE {text} IS NOT NULL),
{name}1 AS (SELECT *, regexp_matches(t, '{_FOREIGN}') AS odd, CASE WHEN regexp_matches(t, '{_FOREIGN}') THEN list_sum(list_transform(list_filter(regexp_extract_all(t, '{_LETTERS}+'), lambda w: regexp_matches(w, '{_FOREIGN}')), lambda w: length(w))) ELSE 0 END AS foreign_, length(regexp_replace(t, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latins FROM {name}0),
{name}2 AS (SELECT {key}, raw, t, odd, 2 * foreign_ < latins + foreign_ AS latin FROM {name}1),
{name} AS (SELECT {key}, raw, CASE WHEN odd THEN array_to_string(list_transform(regexp_extract_all(t, '{_LETTERS}+|[^\\p{{L}}\\p{{M}}\\p{{Nl}}\\p{{No}}]+'), lambda w: {mixed}), '') ELSE t END AS form FROM {name}2)"""


_LOOK = lambda c: f"translate({c}, {_q(_TO['latin'][0])}, {_q(_TO['latin'][1])})"
_WORDS = lambda c: rf"regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+')"
_FOLD = lambda c: f"replace(replace(lower(replace({c}, 'İ', 'i̇')), 'ß', 'ss'), 'ς', 'σ')"


def _pairs(table: str, key: str, text: str) -> str:
    """Pairs of one table that share at least 0.7 of their distinct sequences of three words, each of at least 30."""
    return f"""SELECT '{table}' AS tbl, a AS row_id_1, b AS row_id_2 FROM (WITH {forms('f', key, table, text)}, w AS (SELECT {key}::VARCHAR AS id, {_WORDS('form')} AS l FROM f),
g AS (SELECT DISTINCT id, hash(unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]))) AS g FROM w WHERE len(l) >= 30), n AS (SELECT id, count(*) AS n FROM g GROUP BY ALL), x AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a, b FROM x JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE m >= 0.7 * (na.n + nb.n - m))"""


def _same_look(table: str, key: str) -> str:
    return f"SELECT '{table}' AS tbl, x.a AS row_id_1, x.b AS row_id_2 FROM (WITH {forms('f', key, table, 'content')}, s AS (SELECT {key} AS id, raw, {_LOOK('form')} AS seen FROM f) SELECT p.id AS a, q.id AS b FROM s p JOIN s q ON p.seen = q.seen AND p.raw <> q.raw AND p.id < q.id) x"


def _all_forms(table: str, key: str) -> str:
    return f"SELECT '{table}' AS tbl, row_id, form, folded FROM (WITH {forms('f', key, table, 'content')} SELECT t.{key} AS row_id, form, {_FOLD('form')} AS folded FROM {table} t LEFT JOIN f USING ({key}))"


def oracle_sql() -> dict[str, str]:
    tables = (("documents", "doc_id", "text"), ("corpus_documents", "id", "content"), ("corpus_chunks", "chunk_id", "content"))
    fold = lambda c: f"lower(translate({_LOOK(c)}, 'İIı', 'iii'))"
    runs = lambda l: f"list_transform(range(1, len({l}) - 10), lambda i: array_to_string({l}[i:i + 11], ' '))"
    return {
        "p2_forms": " UNION ALL ".join(_all_forms(t, k) for t, k, _ in tables[1:]),
        "p2_found": " UNION ALL ".join(_same_look(t, k) for t, k, _ in tables[1:]),
        "p6_found": " UNION ALL ".join(_pairs(t, k, c) for t, k, c in tables),
        "p7_whole": "SELECT budget_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n_docs, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS needless_splits FROM pack_budgets WHERE capacity_tokens > 0",
        "p8_found": f"""WITH {forms('d', 'doc_id', 'documents', 'text')}, {forms('e', 'item_id', 'eval_items', 'passage')}, dw AS (SELECT doc_id, {_WORDS(fold('form'))} AS l FROM d), ew AS (SELECT item_id, {_WORDS(fold('form'))} AS l FROM e),
er AS (SELECT DISTINCT item_id, unnest({runs('l')}) AS r FROM ew WHERE len(l) >= 12), dr AS (SELECT doc_id, unnest({runs('l')}) AS r FROM dw WHERE len(l) >= 12) SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r)""",
    }
