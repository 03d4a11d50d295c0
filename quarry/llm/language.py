"""Problem 5: language of documents and of their parts by cross-parsing entropy.

A suffix automaton per language is built over labelled text. A sentence is
parsed greedily into the longest pieces found in the automaton; the language
that needs fewest pieces for the length wins, and how much the runner-up needs
more is the confidence; where a script has one language only, the runner-up is
its own text with the letters shuffled. A sentence that needs nearly as many
pieces as shuffled letters is in no known language (``und``). Sentences of a
block of texts are parsed side by side, one array operation for each character
position and language.

Labels are dirty, so the labelled sample is first parsed with automata of its
other half, and sentences that another language explains better are left out.
The sample is bounded by ``TRAIN_DOCS`` and ``TRAIN_CHARS`` per language.

Null, empty and sentence-free texts get no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm.visual_form import form

TRAIN_DOCS = 80  #: labelled documents of a language that are read
TRAIN_CHARS = 14_000  #: of them in the automaton of a language
MIN_LETTERS = 20  #: of a whole sentence
MIN_PER_LINE = 12  #: letters a line on average; fewer are headers and footers of pages
SURE = 0.15  #: confidence of a sentence that counts
UNKNOWN = 0.85  #: pieces of a sentence, as a share of those of shuffled letters, from which it is in no known language
#: Spellings of language labels, lower case; a region after "-" or "_" is cut first.
LABELS = {
    "tr": ["tr", "tur", "turkish", "türkçe", "turkce"],
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
}
_CODE = {name: code for code, names in LABELS.items() for name in names}


def label_code(label: Column) -> Column:
    """Two-letter code that a label names; null where it names none (missing, empty, undetermined)."""
    base = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    pairs = [F.lit(x) for kv in _CODE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), base)


def automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions (state, symbol) -> state of the suffix automaton; 0 is the start, and as a target means none."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.zeros((len(nxt), alphabet), np.uint16 if len(nxt) < 1 << 16 else np.int32)
    for s, d in enumerate(nxt):
        for c, to in d.items():
            table[s, c] = to
    return table


class Models:
    """Automata by language, over one alphabet; symbol 0 stands for everything that is no letter."""

    def __init__(self, texts: dict[str, list[str]]):
        sample = {lang: " ".join(s)[:TRAIN_CHARS] for lang, s in texts.items()}
        letters = sorted({c for t in sample.values() for c in t.lower() if c.isalpha()})
        self.letters = "".join(letters)
        self.langs = sorted(sample)
        self.cyrillic = np.array([sum("Ѐ" <= c <= "ӿ" for c in sample[x]) * 2 > sum(map(str.isalpha, sample[x])) for x in self.langs])
        self._map = None
        tables = [automaton(self.symbols(code_points(sample[x]))[0], len(letters) + 2) for x in self.langs]
        self.base = np.cumsum([0, *(t.size for t in tables[:-1])])
        self.table = np.concatenate([t.ravel() for t in tables])
        self._map = None
        self.null = np.array([self._shuffled(sample[x], i) for i, x in enumerate(self.langs)])  #: pieces a letter of shuffled text

    def _shuffled(self, text: str, lang: int) -> float:
        sym = self.symbols(code_points(text))[0].copy()
        np.random.default_rng(5).shuffle(sym)
        start = np.arange(0, len(sym), 200)  # in pieces, parsed side by side
        pieces = self.parse(sym, start, np.minimum(200, len(sym) - start), np.array([lang]))
        return float(pieces.sum()) / max(int((sym != 0).sum()), 1)

    @property
    def width(self) -> int:
        return len(self.letters) + 2

    def symbols(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without repeated 0, and the position of each in cp. Letters unknown to all languages share one symbol."""
        if self._map is None:
            m = np.zeros(0x10000, np.uint16)
            for i in range(0x10000):
                if chr(i).isalpha():
                    m[i] = self.width - 1
            for i, c in enumerate(self.letters):
                m[ord(c)] = i + 1
                if len(c.upper()) == 1:
                    m[ord(c.upper())] = i + 1
            m[ord("İ")] = m[ord("i")]
            m[ord("I")] = m[ord("i")]
            self._map = m
        sym = self._map[np.minimum(cp, 0xFFFF)]
        cut = np.isin(cp[:-1], _BREAKS) & (cp[1:] == 10)
        keep = (sym != 0) | (np.concatenate(([1], sym[:-1])) != 0)
        keep[:-1] &= ~cut
        keep[1:] &= ~cut
        at = np.flatnonzero(keep)
        return sym[at], at

    def parse(self, sym: np.ndarray, start: np.ndarray, length: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Pieces that each of the languages needs for each of the runs of symbols."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.zeros((len(langs), len(start)), np.int64)
        count = np.zeros((len(langs), len(start)), np.int32)
        base = self.base[langs][:, None]
        root = self.table[base + np.arange(self.width)]
        alive = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
        for pos, n in enumerate(alive):
            c = sym[start[:n] + pos]
            to = self.table[base + state[:, :n] * self.width + c]
            miss = to == 0
            count[:, :n] += miss
            state[:, :n] = np.where(miss, root[:, c], to)
        out = np.empty_like(count)
        out[:, order] = count
        return out


_BREAKS = np.array([0x2D, 0xAC, 0xAD, 0x2010], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def detect(models: Models, texts: list[str]) -> pd.DataFrame:
    """doc, start, stop, lang, confidence, whole: a row for each sentence; whole: it is long enough and has an end mark.

    lang is an index into models.langs, or their number where a sentence is in no known language.
    """
    cp, begin = K.code_points(texts)
    stop = np.append(begin[1:], len(cp))
    sym, at = models.symbols(cp)
    bounds, end = K.sentence_bounds(cp, begin)
    s, e = bounds[:-1], bounds[1:]
    doc = np.searchsorted(begin, s, side="right") - 1
    lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
    letter = np.concatenate(([0], np.cumsum(sym != 0)))
    n_letters = letter[hi] - letter[lo]
    cyr = np.concatenate(([0], np.cumsum((cp[at] >= 0x400) & (cp[at] < 0x530))))
    is_cyr = 2 * (cyr[hi] - cyr[lo]) > n_letters
    feeds = np.concatenate(([0], np.cumsum(cp == 10)))
    running = n_letters >= MIN_PER_LINE * (feeds[e] - feeds[s] + 1)
    lang = np.full(len(s), -1)
    conf = np.zeros(len(s))
    for script in (False, True):
        among = np.flatnonzero(models.cyrillic == script)
        rows = np.flatnonzero((is_cyr == script) & (n_letters > 0))
        if not len(rows) or not len(among):
            continue
        pieces = models.parse(sym, lo[rows], hi[rows] - lo[rows], among)
        best = pieces.argmin(axis=0)
        none = models.null[among[best]] * n_letters[rows]
        two = np.partition(pieces, 1, axis=0)[:2] if len(among) > 1 else np.stack([pieces[0], np.maximum(none, pieces[0])])
        known = (n_letters[rows] < MIN_LETTERS) | (two[0] < UNKNOWN * none)
        lang[rows] = np.where(known, among[best], len(models.langs))
        conf[rows] = np.where(known, (two[1] - two[0]) / np.maximum(two[1], 1), 0.0)
    # The last character of a sentence is its end mark, unless the text stops without one.
    last = np.minimum(e, stop[doc] - 1) - 1
    out = pd.DataFrame({"doc": doc, "start": s - begin[doc], "stop": last + 1 - begin[doc], "lang": lang, "confidence": conf, "letters": n_letters, "whole": running & (n_letters >= MIN_LETTERS) & (conf >= SURE) & end[np.maximum(last, 0)]})
    return out[out.lang >= 0]


_SPLIT = re.compile(r"(?<=[.!?…])\s+")


def train(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, label: Column) -> Models:
    """Models from a bounded sample of labelled documents: the TRAIN_DOCS of each language that come first in a hash order."""
    known = docs.select(F.col(doc_id).alias("id"), label_code(label).alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL")
    order = Window.partitionBy("lang").orderBy("h", "id")
    top = known.withColumn("h", F.xxhash64("id")).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= TRAIN_DOCS).drop("rn")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(top), "id").where("text IS NOT NULL").orderBy("h").select("lang", "text").toPandas()
    if not len(rows):
        raise ValueError("no labelled document to learn languages from")
    half: list[dict[str, list[str]]] = [{}, {}]
    for i, r in enumerate(rows.itertuples(index=False)):
        half[i % 2].setdefault(r.lang, []).extend(x for x in _SPLIT.split(form(r.text)) if len(x) >= MIN_LETTERS)
    kept: dict[str, list[str]] = {}
    for mine, other in ((0, 1), (1, 0)):
        if not half[other]:
            kept |= half[mine]
            continue
        m = Models(half[other])
        for lang, sentences in half[mine].items():
            if lang not in m.langs or not sentences:
                kept.setdefault(lang, []).extend(sentences)
                continue
            got = detect(m, [x.replace("\n", " ") for x in sentences])
            main = got.sort_values("letters").groupby("doc").lang.last()
            kept.setdefault(lang, []).extend(sentences[d] for d, x in main.items() if x < len(m.langs) and m.langs[x] == lang)
    return Models({lang: s for lang, s in kept.items() if s})


_SCHEMA = "row_id string, label string, segments array<struct<start:int,stop:int,lang:string,confidence:double,sentences:int,letters:int>>"


def segments(spark: SparkSession, models: Models, df: DataFrame, row_id: str, text: str, label: Column) -> DataFrame:
    """row_id, label (a code or null) and segments: runs of sentences in one language, with offsets and confidence.

    Sentences that two languages explain equally well go to the main language
    of the text, that is the one with most letters; sentences in no known
    language are segments of their own (und). Texts without a whole sentence
    have no segments.
    """
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            ids, labels, texts = b.row_id.to_numpy(), b.label.to_numpy(), [form(t) for t in b.text]
            for first, some in K.blocks(texts):
                d = detect(m, some)
                if d.empty:
                    continue
                doc, lang, conf, letters = (d[c].to_numpy().copy() for c in ("doc", "lang", "confidence", "letters"))
                size = np.zeros((len(some), len(names)))
                np.add.at(size, (doc, lang), letters * (conf > 0))
                tie = (conf == 0) & (lang < len(m.langs))
                lang[tie] = np.where(size[doc[tie]].max(axis=1) > 0, size[doc[tie]].argmax(axis=1), lang[tie])
                new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(lang, prepend=-1) != 0))
                last = np.append(new[1:], len(doc)) - 1
                total = np.add.reduceat(letters, new)
                mean = np.add.reduceat(conf * letters, new) / np.maximum(total, 1)
                whole = np.add.reduceat(d.whole.to_numpy().astype(np.int64), new)
                has = np.bincount(doc, weights=d.whole.to_numpy(), minlength=len(some)) > 0
                start, stop = d.start.to_numpy()[new], d["stop"].to_numpy()[last]
                rows: dict[int, list] = {}
                for x in zip(doc[new].tolist(), start.tolist(), stop.tolist(), names[lang[new]].tolist(), np.round(mean, 4).tolist(), whole.tolist(), total.tolist(), strict=True):
                    if has[x[0]]:
                        rows.setdefault(x[0], []).append(dict(zip(("start", "stop", "lang", "confidence", "sentences", "letters"), x[1:], strict=True)))
                if not rows:
                    continue
                yield pd.DataFrame({"row_id": [ids[first + i] for i in rows], "label": [labels[first + i] for i in rows], "segments": list(rows.values())})

    src = df.select(F.col(row_id).cast("string").alias("row_id"), label_code(label).alias("label"), F.col(text).alias("text")).where("row_id IS NOT NULL AND text IS NOT NULL")
    return src.mapInPandas(run, _SCHEMA)


def languages(found: DataFrame, min_sentences: int = 2) -> DataFrame:
    """row_id, label, lang, is_main, sentences, confidence: the main language of each text and others with enough whole sentences; und is none."""
    found = found.withColumn("segments", F.filter("segments", lambda s: s["lang"] != "und"))
    each = found.select("row_id", "label", F.expr("transform(array_distinct(segments.lang), l -> struct(l AS lang, aggregate(filter(segments, s -> s.lang = l), 0, (a, s) -> a + s.letters) AS letters, aggregate(filter(segments, s -> s.lang = l), 0, (a, s) -> a + s.sentences) AS sentences, aggregate(filter(segments, s -> s.lang = l), 0D, (a, s) -> a + s.letters * s.confidence) AS mass))").alias("x"))
    main = each.withColumn("main", F.expr("array_max(transform(x, y -> struct(y.letters AS letters, y.lang AS lang))).lang"))
    flat = main.select("row_id", "label", "main", F.explode("x").alias("x"))
    return flat.select("row_id", "label", F.col("x.lang").alias("lang"), (F.col("x.lang") == F.col("main")).alias("is_main"), F.col("x.sentences").alias("sentences"), F.round(F.col("x.mass") / F.col("x.letters"), 4).alias("confidence")).where((F.col("is_main")) | (F.col("sentences") >= min_sentences))
