"""Problem 3: true sentences of answers whose cells were cut at the wrong places.

Segmentation rules are tables of (break?, before, after) regular-expression
pairs. A line's language selects a cascade of tables: signs that lie open, the
rules of that language, those of its neighbours for borrowed words, and what
all share; at each possible end the pairs are tried in order and the first that
matches decides. The text before a position starts with a sign where that lies
in a quotation or bracket that is closed again, so the tables see this, too.

The cells of an answer are put together in order of their index. No sentence
goes over a line break, so answers of indices beyond ``STRETCH`` are taken line
by line, each line whole; others are one unit. Null cells are skipped; repeated
rows count once; of different cells with one index the greatest text is taken.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 256  #: cells of an answer that is one unit

_OPEN = "([{\"“„«‹「『‘'¿¡"
_UPPER = r"[\"“„«‹‘(\[¿¡]*\s?[A-ZÀ-ÖØ-ÞĞİŞŒА-ЯЁ]"
_LOWER = r"[\"“„«‹‘(\[]*\s?[a-zß-öø-ÿğışœа-яё]"


def _words(*words: str) -> str:
    """The text ends in one of these, as a word of its own."""
    return r"(?:^|[^\w.])(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")$"


# Abbreviations by language. The first list never ends a sentence, the second may when a capital or figure follows,
# the third never ends one before a figure.
ABBREVIATIONS = {
    "tr": (["Dr.", "Prof.", "Doç.", "Yrd.", "Uzm.", "Op.", "Av.", "Arş.", "Gör.", "Öğr.", "bkz.", "Bkz.", "örn.", "Örn.", "yak.", "Sn.", "Hz."], ["vb.", "vd.", "ark."], ["s.", "no.", "No.", "cilt.", "sf."]),
    "en": (["Dr.", "Prof.", "Mr.", "Mrs.", "Ms.", "St.", "Jr.", "i.e.", "e.g.", "cf.", "vs.", "approx.", "ca.", "viz.", "resp."], ["etc.", "a.m.", "p.m.", "i.v.", "i.m.", "p.o.", "al.", "Inc.", "Ltd.", "Co."], ["Fig.", "fig.", "Figs.", "Sec.", "sec.", "Eq.", "Tab.", "No.", "no.", "p.", "pp.", "vol.", "Vol.", "ch.", "Ch.", "Ref.", "App."]),
    "de": (["Dr.", "Prof.", "Hr.", "Fr.", "Frl.", "ca.", "bzw.", "z.", "z. B.", "z.B.", "d. h.", "d.h.", "u. a.", "u.a.", "vgl.", "sog.", "inkl.", "ggf.", "evtl.", "max.", "min.", "St.", "Abb.", "Siehe Abb.", "o. g."], ["usw.", "etc.", "u. Ä.", "usf."], ["Tab.", "Nr.", "S.", "Bd.", "Kap.", "Abs.", "Art."]),
    "fr": (["Dr.", "Pr.", "M.", "MM.", "Mme.", "Mlle.", "env.", "cf.", "p. ex.", "p.ex.", "c.-à-d.", "av.", "St."], ["etc."], ["p.", "pp.", "fig.", "Fig.", "tabl.", "chap.", "art.", "no.", "vol."]),
    "es": (["Dr.", "Dra.", "Sr.", "Sra.", "Srta.", "Prof.", "aprox.", "p. ej.", "p.ej.", "Ud.", "Uds.", "cf.", "D.", "Dña."], ["etc."], ["pág.", "págs.", "p.", "fig.", "Fig.", "núm.", "cap.", "art.", "vol."]),
    "pt": (["Dr.", "Dra.", "Sr.", "Sra.", "Prof.", "Profa.", "aprox.", "p. ex.", "p.ex.", "cf."], ["etc."], ["pág.", "págs.", "p.", "fig.", "Fig.", "núm.", "cap.", "art.", "vol."]),
    "ru": (["г-н.", "проф.", "д-р.", "ул.", "см.", "ср.", "напр.", "т. е.", "т.е.", "т. к.", "им.", "св."], ["и т. д.", "и т.д.", "и т. п.", "и т.п.", "др.", "пр.", "г.", "гг."], ["рис.", "табл.", "стр.", "с.", "гл.", "№."]),
    "hi": (["डॉ.", "श्री.", "प्रो."], [], []),
    "ar": (["د.", "أ.", "م."], [], []),
}
# Names of months that follow a German ordinal.
_MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def _table(lang: str) -> list[tuple[bool, str, str]]:
    never, maybe, before_figure = ABBREVIATIONS[lang]
    rules = [(False, _words(*never), r"")]
    if lang == "de":
        rules += [(False, r"\b(?:am|vom|zum|bis|ab|seit|dem|den|der) \d{1,2}\.$", r"[A-ZÄÖÜ]"), (False, r"\b\d{1,2}\.$", _MONTHS_DE)]
    if before_figure:
        rules.append((False, _words(*before_figure), r"[\d(§]|[IVXLC]+\b"))
    if maybe:
        rules += [(True, _words(*maybe), rf"{_UPPER}|\d|$"), (False, _words(*maybe), r"")]
    return rules


#: Signs that stand before the text of a position: it lies within a quotation or bracket, or ends one that begins the sentence.
INSIDE, SAID = "\ue000", "\ue001"
_OPENED = [(False, f"^{INSIDE}", r""), (False, f"^{SAID}", r"\S")]  # a quotation that begins the sentence, the speaker follows
_THAI = [(True, r"[\u0e00-\u0e7f]$", r"[\u0e00-\u0e7f]")]  # a space between letters of a script without end marks
_SHARED = [
    (False, r"[=<>≤≥~] ?\d+[.,]$", r"\d"),  # a decimal with a stray space
    (False, r"(?:^|[^\w])[A-ZÀ-ÖØ-ÞĞİŞА-ЯЁ]\.$", _UPPER),  # initials
    (False, r"(?:^|\s)[IVXLC]+\.$", _LOWER),
    (False, r"", _LOWER + r"|[,;:–—-]"),  # whatever goes on in lower case
    (True, r"", r""),
]
_LATIN = ["tr", "en", "de", "fr", "es", "pt"]
# Frequent words by which a Latin language is told from the others.
FREQUENT = {
    "tr": "ve bir bu için ile olarak daha ancak göre sonra olan çok", "en": "the of and was were is with that for not this by", "de": "der die das und nicht mit wurde war ein eine den von",
    "fr": "le la les des une est dans pour pas été par qui", "es": "el los las una del fue con para por que se como", "pt": "o os as uma do da foi com não para por em",
}


def _cascade(lang: str) -> list[tuple[bool, str, str]]:
    """The tables of a language: what lies open, its own rules, those of the other languages for words it borrows, what all share."""
    if lang == "han":
        return [*_OPENED, *_THAI, (False, r"[」』”）)]$", r"[とっ、。，]"), (False, r"", r"[、，,：:]"), (True, r"", r"")]
    others = [x for x in _LATIN if x != lang] if lang in _LATIN else []
    titles = [r for x in _LATIN for r in _table(x)[:1]] if lang == "hi" else []
    return [*_OPENED, *_THAI, *(_table(lang) if lang in ABBREVIATIONS else []), *(r for x in others for r in _table(x)), *titles, *_SHARED]


#: By language (a script where it has one language here; "latin" where none of the Latin ones is told): the cascade of rule tables.
CASCADES = {x: _cascade(x) for x in [*_LATIN, "ru", "hi", "ar", "han"]} | {"latin": [*_OPENED, *_THAI, *(r for x in _LATIN for r in _table(x)), *_SHARED]}
_RULES = {s: [(yes, re.compile(b), re.compile(a)) for yes, b, a in t] for s, t in CASCADES.items()}
_CANDIDATE = re.compile("[.!?…]+(?:[ \\u00a0\\u202f]?[»›]|[\"”’“)\\]}」』）】])*|(?:[。！？｡]+|।+|؟+|۔+)[\"”’»)\\]}」』）】]*|(?<=[\u0e00-\u0e7f])(?=\\s+[\u0e00-\u0e7f])")
_WIDE = re.compile(r"[。！？｡」』）】]")
_QUOTE = re.compile(r"[\"“”„«»「」『』‹›()（）\[\]]")
_CLOSERS = "»›\"”’“)]}」』）】 \u00a0\u202f"
_PAIRS = {"「": "」", "『": "』", "«": "»", "‹": "›", "(": ")", "（": "）", "[": "]"}
_CLOSING = set(_PAIRS.values())
_SCRIPTS = [("han", re.compile(r"[぀-ヿ㐀-鿿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("ru", re.compile(r"[А-яЁё]"))]
_TELLING = {w: [x for x in _LATIN if w in FREQUENT[x].split()] for words in FREQUENT.values() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")


def _enclosed(text: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets that are closed again: positions of the opening and the closing sign."""
    out, stack = [], []
    for m in _QUOTE.finditer(text):
        c, i = m[0], m.start()
        before = text[i - 1] if i else " "
        if c in _PAIRS:
            stack.append((_PAIRS[c], i))
        elif c in _CLOSING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c:
                    out.append((stack[k][1], i))
                    del stack[k:]
                    break
        else:
            within = any(x[0] == "quote" for x in stack)
            if c == "„" or (not within and (c == "“" or before.isspace() or before in "([：:¡¿")):
                stack.append(("quote", i))
            elif within:
                k = max(k for k, x in enumerate(stack) if x[0] == "quote")
                out.append((stack[k][1], i))
                del stack[k:]
        # any other sign is an apostrophe or a closing sign without an opening one
    return out


def _language(text: str) -> str:
    """The cascade for a line: its script's, of the Latin ones that of the language whose frequent words it has most of."""
    count = {name: len(rx.findall(text)) for name, rx in _SCRIPTS}
    best = max(count, key=count.get)
    if 2 * count[best] > sum(c.isalpha() for c in text) * 0.5:
        return best
    votes = Counter(x for w in _WORD.findall(text) for x in _TELLING.get(w.lower(), ()))
    two = votes.most_common(2)
    return two[0][0] if two and (len(two) == 1 or two[0][1] > two[1][1]) else "latin"


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Outermost spans as sorted openings and closings."""
    opens: list[int] = []
    closes: list[int] = []
    for o, c in sorted(spans):
        if not closes or o > closes[-1]:
            opens.append(o)
            closes.append(c)
        elif c > closes[-1]:  # crossing ones count as one
            closes[-1] = c
    return opens, closes


def _words_before(s: str, begin: int, a: int) -> int:
    """Where the fourth word before a position begins, not before the sentence; no abbreviation has more words."""
    i = a
    for _ in range(4):
        i = max(s.rfind(" ", begin, i), s.rfind("\u00a0", begin, i), s.rfind("\t", begin, i))
        if i < 0:
            return begin
    return i + 1


def ends(text: str) -> list[int]:
    """Ends of the sentences of a text, as code-point offsets; line breaks end units, too."""
    out: list[int] = []
    for line in re.finditer(r"[^\n]+", text):
        s = line[0]
        stop = len(s.rstrip())
        if not s.strip():
            continue
        rules = _RULES[_language(s)]
        spans = _enclosed(s)
        opens, closes = _union(spans)
        closed = {c: o for o, c in spans}
        found = {stop}
        begin = len(s) - len(s.lstrip())
        for m in _CANDIDATE.finditer(s):
            a, e = m.span()
            if e >= stop or e <= begin:
                continue
            wide = bool(_WIDE.search(m[0]))
            if not (wide or s[e].isspace() or m[0][0] in "।؟۔"):
                continue
            k = bisect_left(opens, a) - 1
            inside = k >= 0 and a > opens[k] and closes[k] >= e
            said = wide and m[0][-1] in "」』”" and closed.get(e - 1) == begin
            mark = INSIDE if inside and m[0] else SAID if said else ""
            before = mark + s[_words_before(s, begin, a) : e if wide else a + len(m[0].rstrip(_CLOSERS))]
            at = e
            while s[at].isspace():
                at += 1
            for yes, b, f in rules:
                if f.match(s, at) and b.search(before):
                    if yes:
                        found.add(e)
                        begin = at
                    break
        out += sorted(line.start() + x for x in found)
    return out


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            pieces: dict[tuple[int, int], str] = {}
            for c in r.cells:
                at = c["i"], c["shift"]
                pieces[at] = max(pieces.get(at, ""), c["t"])
            order = sorted(pieces)
            starts, pos = [], 0
            for at in order:
                starts.append(pos)
                pos += len(pieces[at]) + 1
            text = " ".join(pieces[at] for at in order)
            last = 0
            for e in ends(text):
                k = bisect_left(starts, e) - 1
                rows.append((r.query_id, order[k][0], e - starts[k] + order[k][1], text[last:e].strip()))
                last = e
        yield pd.DataFrame(rows, columns=["query_id", "sentence_index", "end_offset", "sentence"])


def _lines(cells: DataFrame) -> DataFrame:
    """query_id, cells: the lines of answers (query_id, i, t; one row a cell). Breaks are counted by stretch first, so no task numbers a whole answer."""
    part = F.floor(F.col("i") / STRETCH).alias("stretch")
    x = cells.select("*", part, (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).alias("breaks"))
    ahead = Window.partitionBy("query_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("query_id", "stretch").agg(F.sum("breaks").alias("n")).select("query_id", "stretch", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    own = Window.partitionBy("query_id", "stretch").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("line", F.coalesce(F.sum("breaks").over(own), F.lit(0))).join(base, ["query_id", "stretch"])
    piece = x.select("query_id", "i", "t", (F.col("base") + F.col("line")).alias("line"), F.posexplode(F.split("t", "\n")).alias("k", "piece"))
    shift = F.aggregate(F.slice(F.split("t", "\n"), F.lit(1), F.col("k")), F.lit(0), lambda s, p: s + F.length(p) + 1)
    return piece.groupBy("query_id", (F.col("line") + F.col("k")).alias("line")).agg(F.collect_list(F.struct("i", shift.alias("shift"), F.col("piece").alias("t"))).alias("cells")).select("query_id", "cells")


def true_sentences(cells: DataFrame, query_id: str = "query_id", index: str = "sentence_index", text: str = "sentence") -> DataFrame:
    """query_id, sentence_index, end_offset, sentence: a row for each true sentence, at the cell in which it ends."""
    src = cells.select(F.col(query_id).alias("query_id"), F.col(index).cast("int").alias("i"), F.col(text).alias("t")).where("query_id IS NOT NULL AND i IS NOT NULL AND t IS NOT NULL")
    schema = "query_id string, sentence_index int, end_offset int, sentence string"
    far = src.where((F.col("i") < 0) | (F.col("i") >= STRETCH)).select("query_id").distinct()
    few, units = src, None
    if far.limit(1).count():
        few = src.join(far, "query_id", "left_anti")
        units = _lines(src.join(far, "query_id", "left_semi").groupBy("query_id", "i").agg(F.max("t").alias("t")))
    whole = few.groupBy("query_id").agg(F.collect_set(F.struct("i", F.lit(0).alias("shift"), "t")).alias("cells"))
    return (whole.unionByName(units) if units is not None else whole).mapInPandas(_answers, schema)
