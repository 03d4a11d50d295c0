"""Problem 1: text from scanned pages, repaired into continuous paragraphs.

Lines of scanned contents are sorted into text and page furniture; words that
break across lines are joined; misread words are replaced. Corrections come
from a corpus frequency lexicon over all contents: suspects (words that occur
almost only in scans) and lexicon words meet in a symmetric-delete join (the
part of a word that can be misread is left out on both sides), the weighted
edit distance with confusion pairs says how likely the misreading is, and
neighbouring words decide between several candidates. An edit that is no
confusion pair (one character for, or beside, one or two others, in words of
letters) is believed only where the word that was meant is known beside both
neighbours; once that has confirmed an edit for many words, it counts as a
confusion of these texts and is believed like a listed one.

Running headers are found by their repetition: a short line that no sentence
end precedes, in several documents. Null and empty contents and contents that
are no scans give no rows; lines are counted from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import kernel as K
from quarry.llm.visual_form import form
from quarry.sources import store

#: A misreading is at most so frequent beside the word that was meant (CLEAN: in clean texts), and a suspect there beside its own occurrences in scans.
RARER, CLEAN, SUSPECT = 0.05, 0.01, 0.2
MIN_COUNT = 2  #: of a lexicon word that corrects others
MIN_DOCS, MIN_INTERRUPTS = 2, 0.3  #: of a running line
SIMILAR_LINE = 0.72
PAGE_WIDTH, WIDE_LINES = 110, 0.1  #: characters of a line of a page, and the share of lines that may be longer (tables, lines run together)
EDGES = ".,;:()\"'«»“”„[]"
# What is read for what stands there, and how unlikely that is (an edit that is no such pair costs OTHER a character and needs its neighbours).
CONFUSIONS = {
    ("c", "e"): 0.2, ("!", "i"): 0.1, ("f", "t"): 0.2, ("1", "l"): 0.1, ("0", "o"): 0.1, ("cl", "d"): 0.2, ("v", "u"): 0.25, ("l", "ı"): 0.25, ("rn", "m"): 0.2, ("b", "h"): 0.25,
    ("m", "in"): 0.25, ("ii", "ü"): 0.2, ("h", "li"): 0.25, ("6", "ö"): 0.1, ("m", "rn"): 0.25, ("e", "c"): 0.35, ("t", "f"): 0.35, ("u", "v"): 0.35, ("h", "b"): 0.35, ("d", "cl"): 0.35,
    ("in", "m"): 0.35, ("li", "h"): 0.35, ("ü", "ii"): 0.35, ("l", "1"): 0.3, ("o", "0"): 0.3, ("O", "0"): 0.2, ("l", "i"): 0.35, ("i", "l"): 0.35, ("1", "i"): 0.25, ("1", "I"): 0.25,
    ("1", "ı"): 0.25, ("!", "l"): 0.25, ("!", "ı"): 0.2, ("I", "l"): 0.25, ("l", "I"): 0.25, ("vv", "w"): 0.2, ("w", "vv"): 0.35, ("5", "S"): 0.2, ("S", "5"): 0.2, ("8", "B"): 0.2, ("B", "8"): 0.2, ("0", "O"): 0.2,
    ("6", "o"): 0.25, ("6", "b"): 0.3, ("9", "g"): 0.3, ("ri", "n"): 0.35, ("n", "ri"): 0.35, ("ı", "l"): 0.35, ("nn", "m"): 0.35, ("5", "s"): 0.25, ("3", "з"): 0.3,
}
OTHER, MAX_COST = 1.0, 0.4
MIN_TWO_PLACES = 6  #: letters of a word that may be misread in two places apart
#: An unlisted edit is a confusion of these texts where so many misread words, and this share of those that it would explain, are confirmed by both neighbours.
MIN_CONFIRMED, CONFIRMED, LEARNT = 4, 0.25, 0.38
MIN_BESIDE = 2  #: how often the word that was meant stands beside each neighbour, for an edit above MAX_COST
#: Words whose neighbours are counted are sent to the texts up to so many, else joined by a shuffle.
BROADCAST_WORDS = 200_000
SALTS = 16  #: parts of the occurrences of a word where corrections are too many to be sent
# Digits as they are misread.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2"}

_HYPHEN = re.compile(r"(\S*[^\W_])[-\u00ac\u00ad\u2010\u2011]$")
_HYPHENS = "-\u00ac\u00ad\u2010\u2011"
_LETTERS = re.compile(r"[^\W\d_]+")
_TERMINAL = re.compile(r"[.!?:;…][\"”’»)\]]*$")
_NUMBER = re.compile(r"^\W*(?:(?:s|sayfa|seite|page|p|pág|pag|página|стр|с)\W*)?[\dOolISB]{1,4}(?:\s*(?:/|von|of|de)\s*[\dOolISB]{1,4})?[^\w.]*$", re.I)
_ISSUE = re.compile(r"(?=(?:\w*\d){2})\b\w{4};\s?\w{1,3}\W?\w{1,3}\b")
_ET_AL = re.compile(r"(?:^|\s)(?:[e1c][t1f]\s+[a-z1!]{0,2}l|v[ec1]\s+ar[kK1]|u\.\s?a|e\s+cols?)\.?(?:\W*[\dOolISB]*\W*)?$")
_NUMERIC = r"^(?=.*\d)[\dOolISBZz!|]+(?:[.,][\dOolISBZz!|]+)*%?$|^[\dOolISBZz!|]+(?:[.,][\dOolISBZz!|]+)+%?$"


def is_scan(content: Column) -> Column:
    """Whether many lines of a content break within a sentence and nearly all are of page width."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.length(F.trim(x)) > 0)
    broken = F.filter(lines, lambda x: (F.length(x) >= 30) & ~F.rtrim(x).rlike("[.!?:;…][\"”’»)]*$"))
    wide = F.size(F.filter(lines, lambda x: F.length(x) > PAGE_WIDTH))
    return F.coalesce((F.size(lines) >= 3) & (wide <= WIDE_LINES * F.size(lines)) & (F.size(broken) >= F.greatest(F.lit(2), F.ceil(F.size(lines) * 0.25))), F.lit(False))


def _issue(line: str) -> bool:
    return ";" in line and _ISSUE.search(line) is not None


def _broken(line: str) -> re.Match | None:
    """The line ends in a hyphen behind a word."""
    return _HYPHEN.search(line) if line[-1:] in _HYPHENS and line else None


def line_key(line: str) -> str:
    """Letters of a line without figures and signs, for comparing running lines."""
    return " ".join(_LETTERS.findall((_ISSUE.sub(" ", line) if ";" in line else line).replace("İ", "i").lower().replace("ı", "i")))


def _authors(line: str) -> bool:
    """The line is a name with "et al." or the like, one character of which may be misread."""
    if _ET_AL.search(line):
        return True
    x = re.sub(r"[\W\d]+$", "", re.sub(r"^[\W\d]+", "", line))
    near = lambda t: len(x) > len(t) + 2 and sum(a != b for a, b in zip(x[-len(t) :], t, strict=True)) <= 1
    return len(x.split()) <= 4 and x[:1].isupper() and (near(" et al") or near(" ve ark"))


class Page:
    """Lines of one content: which are certainly furniture, which might be."""

    def __init__(self, content: str):
        self.lines = [x.rstrip() for x in content.split("\n")]
        self.filled = [i for i, x in enumerate(self.lines) if x.strip()]
        plain = [len(self.lines[i]) for i in self.filled if len(self.lines[i]) <= PAGE_WIDTH and not _issue(self.lines[i])]
        self.width = max(plain, default=0)
        self.sure = {i for i in self.filled if self._sure(self.lines[i].strip())}
        self.short = {i for k, i in enumerate(self.filled) if i not in self.sure and self._short(k)}

    @staticmethod
    def _sure(x: str) -> bool:
        if _issue(x) or (_NUMBER.match(x) and any(c.isdigit() for c in x) and not re.match(r"^[(]?\d+(?:[.,]\d+)?[)]?[.,;:]$|^\d+[.,]\d+$", x)):
            return True
        return len(x.split()) <= 6 and _authors(x)

    def _short(self, k: int) -> bool:
        """The line was ended on purpose (the next word had fitted), not by the end of a sentence."""
        i = self.filled[k]
        x = self.lines[i]
        if _TERMINAL.search(x) or x.endswith(",") or _broken(x) or len(x.split()) > 9 or not any(c.isalpha() for c in x):
            return False
        nxt = next((self.lines[j].split()[0] for j in self.filled[k + 1 :] if j not in self.sure), "")
        return len(x) + 1 + len(nxt) < self.width - 1 and len(x) < 0.78 * self.width

    def interrupts(self, i: int) -> bool:
        """The last line of text before it doesn't end a sentence."""
        for j in range(i - 1, -1, -1):
            x = self.lines[j]
            if x.strip() and j not in self.sure and j not in self.short:
                return not _TERMINAL.search(x)
        return False

    def furniture(self, known: set[str]) -> set[int]:
        """Indices of the lines of furniture; known: keys of running lines."""
        out = set(self.sure)
        out |= {i for i in self.filled if i not in out and line_key(self.lines[i]) in known and not _broken(self.lines[i])}
        keys = known | {line_key(self.lines[i]) for i in out}
        at = {i: k for k, i in enumerate(self.filled)}
        grew = True
        while grew:  # lines beside furniture that resemble it or break a sentence
            grew = False
            for i in sorted(self.short - out):
                k = at[i]
                beside = (k and self.filled[k - 1] in out) or (k + 1 < len(self.filled) and self.filled[k + 1] in out)
                if not beside:
                    continue
                key = line_key(self.lines[i])
                first = self.lines[i].lstrip()[:1]
                if any(len(key) > 5 and SequenceMatcher(None, key, x).ratio() >= SIMILAR_LINE for x in keys if x) or (self.interrupts(i) and not first.islower() and not re.search(r"[.,;] ", self.lines[i].strip()) and len(key.split()) <= 5):
                    out.add(i)
                    grew = True
        return out


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            p = Page(form(r.content))
            seen: dict[str, bool] = {}
            for i in p.short:
                if key := line_key(p.lines[i]):
                    seen[key] = seen.get(key, False) or p.interrupts(i)
            for i in p.sure:  # a running line with a page number or issue
                if (key := line_key(p.lines[i])) and not _authors(p.lines[i]) and len(key) > 6:
                    seen[key] = True
            rows += [(r.id, k, v) for k, v in seen.items()]
        yield pd.DataFrame(rows, columns=["id", "key", "interrupts"])


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            p = Page(form_keeping_breaks(r.content))
            gone = p.furniture(set(r.keys) if r.keys is not None else set())
            rows += [(r.id, i + 1, -1, "furniture", "", "", "", "") for i in sorted(gone)]
            text = [i for i in p.filled if i not in gone]
            words: list[tuple[int, str, str, str]] = []
            carried = 0
            for k, i in enumerate(text):
                parts = p.lines[i].split()[carried:]
                carried = 0
                m = _broken(p.lines[i])
                nxt = p.lines[text[k + 1]].split() if k + 1 < len(text) else []
                if m and nxt and parts and (nxt[0][:1].isalpha() or (nxt[0][:1].isdigit() and not parts[-1][-2:-1].islower())):
                    head, rest = parts.pop()[:-1], nxt[0]
                    words += [(i, "word", w, "") for w in parts]
                    words.append((i, "hyphen", head + rest, f"{head}-{rest}"))
                    carried = 1
                else:
                    words += [(i, "word", w, "") for w in parts]
            bare = [w.strip(EDGES) for _, _, w, _ in words]
            for n, (i, kind, _, alt) in enumerate(words):
                if bare[n]:
                    rows.append((r.id, i + 1, n, kind, bare[n], alt.strip(EDGES), bare[n - 1] if n else "", bare[n + 1] if n + 1 < len(bare) else ""))
        yield pd.DataFrame(rows, columns=["id", "line_no", "word_no", "kind", "word", "alt", "before", "after"])


def form_keeping_breaks(content: str) -> str:
    """The form of problem 2, with soft hyphens at line ends kept as hyphens."""
    return form(re.sub("[\u00ad\u2010\u2011](?=\\s*(?:\n|$))", "-", content))


_UNIT = "id string, line_no int, word_no int, kind string, word string, alt string, before string, after string"


def lower_first(w: Column) -> Column:
    return F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))


def _deletes(w: Column) -> Column:
    """The word, and the word without one and without two characters (in words below MIN_TWO_PLACES neighbouring ones only)."""
    n = F.length(w)
    none = F.array().cast("array<string>")
    left_out = lambda x, i, k: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + k, n))
    one = F.transform(F.sequence(F.lit(1), n), lambda i: left_out(w, i, 1))
    beside = F.when(n > 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: left_out(w, i, 2))).otherwise(none)
    apart = F.when(n >= MIN_TWO_PLACES, F.flatten(F.transform(F.slice(one, F.lit(1), n - 1), lambda x, k: F.transform(F.sequence(k + 1, n - 1), lambda i: left_out(x, i, 1))))).otherwise(beside)
    return F.array_distinct(F.concat(F.array(w), one, apart))


def _differing(read: str, meant: str) -> tuple[Column, Column]:
    """What is read and what is meant between the beginning and the end that two words share, as a and b."""
    r, m = F.col(read), F.col(meant)
    n = F.least(F.length(r), F.length(m))
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    i = F.size(F.filter(upto(n), lambda k: F.left(r, k) == F.left(m, k)))
    j = F.size(F.filter(upto(n - i), lambda k: F.right(r, k) == F.right(m, k)))
    return F.substring(r, i + 1, F.length(r) - i - j).alias("a"), F.substring(m, i + 1, F.length(m) - i - j).alias("b")


_IDS = {c: i for i, c in enumerate(sorted({c for pair in CONFUSIONS for c in pair[0] + pair[1]}), 1)}
_PACKED = sorted((_pack, cost) for (x, y), cost in CONFUSIONS.items() for _pack in [sum(_IDS[c] << (6 * k) for k, c in zip((3, 2) if len(x) == 2 else (2,), x)) + sum(_IDS[c] << (6 * k) for k, c in zip((1, 0) if len(y) == 2 else (0,), y))])
_PAIR, _PAIR_COST = np.array([k for k, _ in _PACKED]), np.array([c for _, c in _PACKED])


def misreading_costs(read: list[str], meant: list[str]) -> np.ndarray:
    """Weighted edit distances, all pairs side by side: a confusion pair has its cost, any other character put in, left out or for another costs OTHER."""
    out = np.zeros(len(read))
    longest = np.array([max(len(x), len(y)) for x, y in zip(read, meant, strict=True)], np.int64)
    below = 0
    for top in (8, 12, 20, 40, int(longest.max(initial=0))):
        rows = np.flatnonzero((longest > below) & (longest <= top))
        below = max(below, top)
        if len(rows):
            out[rows] = _distances([read[i] for i in rows], [meant[i] for i in rows])
    return out


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points by word (0 beyond the end), their places in the confusion pairs (0: in none), lengths."""
    n = np.array([len(w) for w in words])
    cp = np.zeros((len(words), int(n.max(initial=0)) + 1), np.int64)
    cp[np.arange(cp.shape[1]) < n[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    chars, back = np.unique(cp, return_inverse=True)
    return cp, np.array([_IDS.get(chr(c), 0) for c in chars], np.int64)[back].reshape(cp.shape), n


def _distances(read: list[str], meant: list[str]) -> np.ndarray:
    (a, ia, na), (b, ib, nb) = _matrix(read), _matrix(meant)
    out = np.full(len(read), np.inf)

    def pair(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
        key = sum(v << (6 * k) for k, v in zip((3, 2) if len(x) == 2 else (2,), x, strict=True)) + sum(v << (6 * k) for k, v in zip((1, 0) if len(y) == 2 else (0,), y, strict=True))
        at = np.minimum(np.searchsorted(_PAIR, key), len(_PAIR) - 1)
        known = (_PAIR[at] == key) & np.all([v > 0 for v in (*x, *y)], axis=0)
        return np.where(known, _PAIR_COST[at], np.inf)

    d: dict[tuple[int, int], np.ndarray] = {(0, 0): np.zeros(len(read))}
    for i in range(int(na.max(initial=0)) + 1):
        for j in range(max(0, i - 3), min(int(nb.max(initial=0)), i + 3) + 1):  # more characters apart are no misreading
            if i or j:
                best = np.full(len(read), np.inf)
                if i and (i - 1, j) in d:
                    best = np.minimum(best, d[i - 1, j] + OTHER)
                if j and (i, j - 1) in d:
                    best = np.minimum(best, d[i, j - 1] + OTHER)
                for x, y in ((1, 1), (1, 2), (2, 1), (2, 2)):
                    if i >= x and j >= y and (i - x, j - y) in d:
                        step = pair([ia[:, i - k] for k in range(x, 0, -1)], [ib[:, j - k] for k in range(y, 0, -1)])
                        if x == y == 1:
                            step = np.where(a[:, i - 1] == b[:, j - 1], 0.0, np.minimum(step, OTHER))
                        best = np.minimum(best, d[i - x, j - y] + step)
                d[i, j] = best
            out = np.where((na == i) & (nb == j), d[i, j], out)
    return out


def _costs(read: pd.Series, meant: pd.Series) -> pd.Series:
    return pd.Series(misreading_costs(read.tolist(), meant.tolist()))


def number_of(word: Column) -> Column:
    """The number that a misread number should be; null where the word is none or right."""
    plain = word.rlike(r"^[\d.,]+%?$")
    figures = F.length(F.regexp_replace(word, r"[^\d.,]", ""))
    return F.when(~plain & word.rlike(_NUMERIC) & (figures * 2 >= F.length(word)), F.translate(word, "".join(DIGITS), "".join(DIGITS.values())))


class Scans:
    """Frames of one run: units (words of text and lines of furniture), words (lexicon), repairs (what a word should be)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, row_id: str = "id", content: str = "content"):
        src = docs.select(F.col(row_id).cast("string").alias("id"), F.col(content).alias("content")).where("id IS NOT NULL AND content IS NOT NULL").withColumn("scan", is_scan(F.col("content")))
        self.pages = src.where("scan").select("id", "content")
        short = K.checkpointed(spark, self.pages.mapInPandas(_candidates, "id string, key string, interrupts boolean"))
        running = short.groupBy("key").agg(F.count("*").alias("n"), F.count_if("interrupts").alias("m")).where((F.col("n") >= MIN_DOCS) & (F.col("m") >= MIN_INTERRUPTS * F.col("n")) & (F.col("m") >= 2))
        own = short.join(running.select("key"), "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
        self.units = K.checkpointed(spark, self.pages.join(own, "id", "left").select("id", "content", "keys").mapInPandas(_units, _UNIT))
        said = self.units.where("kind = 'word' OR (kind = 'hyphen' AND word <> '')").select("word", F.lit(0).alias("c"), F.lit(1).alias("s"))
        bare = lambda w: F.btrim(w, F.lit(EDGES))
        clean = src.where("NOT scan").select(F.explode(F.split("content", r"\s+")).alias("w")).select(bare(F.col("w")).alias("word"), F.lit(1).alias("c"), F.lit(0).alias("s"))
        self.clean_words = src.where("NOT scan").select(F.transform(F.split("content", r"\s+"), bare).alias("w"))
        counts = clean.unionByName(said).where("word <> ''").groupBy("word").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
        self.words = K.checkpointed(spark, counts.groupBy(lower_first(F.col("word")).alias("key")).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max_by("word", F.struct(F.col("c") + F.col("s"), F.col("word"))).alias("surface")))
        suspect = self.words.where((F.col("s") > 0) & (F.col("c") <= SUSPECT * F.col("s")) & (F.length("key") > 1) & F.col("key").rlike(r"\p{L}") & ~F.col("key").rlike(r"^\P{L}*\p{Lu}?\p{L}?-?[\d.,/-]+$") & ~(F.col("key").rlike(r"\d.*\d") & number_of(F.col("key")).isNotNull()))
        meant = self.words.where((F.col("c") >= MIN_COUNT) | ((F.col("c") == 0) & (F.col("s") > MIN_COUNT))).where(F.length("key") > 1)
        left = suspect.select(F.col("key").alias("read"), (F.col("c") + F.col("s")).alias("n_read"), F.col("c").alias("c_read"), F.explode(_deletes(F.col("key"))).alias("rest"))
        right = meant.select(F.col("key").alias("meant"), "surface", (F.col("c") + F.col("s")).alias("n_meant"), F.col("c").alias("c_meant"), F.explode(_deletes(F.col("key"))).alias("rest"))
        near = left.join(right, "rest").where(f"read <> meant AND abs(length(read) - length(meant)) <= 1 AND levenshtein(read, meant, 2) >= 0 AND n_read <= 1 + n_meant * {RARER} AND (c_read = 0 OR c_read <= {CLEAN} * c_meant)").drop("rest").distinct()
        # No misreading: another case, a hyphen more or less, two for two characters, a code or number of its own.
        other = F.col("meant").rlike(r"^[\p{L}\p{M}'’-]+$") & (F.lower("read") != F.lower("meant")) & (F.translate("read", "-", "") != F.translate("meant", "-", "")) & ((F.col("cost") <= OTHER) | (F.length("read") != F.length("meant")))
        scored = near.withColumn("cost", F.pandas_udf(_costs, "double")("read", "meant")).where((F.col("cost") <= MAX_COST) | other)
        self.repairs = K.checkpointed(spark, scored.select("read", "meant", "surface", "n_meant", "cost", *_differing("read", "meant")).withColumn("choices", F.count("*").over(Window.partitionBy("read"))))

    def corrections(self) -> DataFrame:
        """read, before, after, meant, surface: the best correction of a word, where several compete beside its neighbours.

        Costs are learnt on the way: edits that are in no list but that the
        neighbours confirm for many words cost no more than listed ones then.
        """
        words = self.units.where("kind <> 'furniture'").select(lower_first(F.col("word")).alias("key"), "before", "after")
        listed = (F.col("choices") == 1) & (F.col("cost") <= MAX_COST)
        unsure = K.checkpointed(self.units.sparkSession, self.repairs.where(~listed))
        asked = unsure.select(F.col("meant").alias("key")).distinct()
        few = asked.count() <= BROADCAST_WORDS
        beside = self.clean_words.select(F.explode(F.transform("w", lambda x, i: F.struct(lower_first(x).alias("key"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("before"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("after")))).alias("x")).select("x.*")
        known = words.unionByName(beside).join(F.broadcast(asked) if few else asked, "key", "left_semi")
        known = K.checkpointed(self.units.sparkSession, known.groupBy("key", "before", "after").agg(F.count("*").alias("n")))
        pairs = known.groupBy("key", "before").agg(F.sum("n").alias("n"))
        nexts = known.groupBy("key", "after").agg(F.sum("n").alias("n"))
        some = words.withColumnRenamed("key", "read").join(unsure, "read").distinct()
        scored = some.join(pairs.select(F.col("key").alias("meant"), "before", F.col("n").alias("n_before")), ["meant", "before"], "left").join(nexts.select(F.col("key").alias("meant"), "after", F.col("n").alias("n_after")), ["meant", "after"], "left")
        told = ((F.col("before") == "") | (F.col("n_before") >= MIN_BESIDE)) & ((F.col("after") == "") | (F.col("n_after") >= MIN_BESIDE)) & (F.concat("before", "after") != "")
        scored = K.checkpointed(self.units.sparkSession, scored.withColumn("told", F.coalesce(told, F.lit(False))))
        by_word = scored.where(F.col("cost") > MAX_COST).groupBy("a", "b", "read").agg(F.max("told").alias("told"))
        learnt = by_word.groupBy("a", "b").agg(F.count_if("told").alias("m"), F.count("*").alias("n")).where((F.col("m") >= MIN_CONFIRMED) & (F.col("m") >= CONFIRMED * F.col("n"))).select("a", "b", F.lit(LEARNT).alias("learnt"))
        cheaper = lambda df: df.join(store.small(learnt), ["a", "b"], "left").withColumn("cost", F.least("cost", F.coalesce("learnt", F.lit(OTHER * 9)))).drop("learnt")
        alone = cheaper(self.repairs).where((F.col("choices") == 1) & (F.col("cost") <= MAX_COST))
        one = alone.select("read", F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), "meant", "surface")
        believed = (F.col("cost") <= MAX_COST) | F.col("told")
        score = 2 * F.log1p(F.coalesce("n_before", F.lit(0))) + 2 * F.log1p(F.coalesce("n_after", F.lit(0))) + F.log("n_meant") - 20 * F.col("cost")
        best = cheaper(scored).where(believed & ~((F.col("choices") == 1) & (F.col("cost") <= MAX_COST))).groupBy("read", "before", "after").agg(F.max_by(F.struct("meant", "surface"), F.struct(score, F.col("meant"))).alias("x"))
        return one.unionByName(best.select("read", "before", "after", "x.meant", "x.surface"))

    def found(self) -> DataFrame:
        """id, line_no, word_no, kind, word, repaired: furniture, hyphen and ocr."""
        furniture = self.units.where("kind = 'furniture'").select("id", "line_no", "word_no", "kind", "word", F.lit("").alias("repaired"))
        u = self.units.where("kind <> 'furniture'").withColumn("key", lower_first(F.col("word"))).withColumn("alt_key", F.when(F.col("kind") == "hyphen", lower_first(F.col("alt"))))
        c = K.checkpointed(self.units.sparkSession, self.corrections())
        few = c.count() <= BROADCAST_WORDS
        single, several = c.where("before IS NULL").select(F.col("read").alias("key"), F.col("meant").alias("m1"), F.col("surface").alias("f1")), c.where("before IS NOT NULL").select(F.col("read").alias("key"), "before", "after", F.col("meant").alias("m2"), F.col("surface").alias("f2"))
        if few:
            j = u.join(F.broadcast(single), "key", "left").join(F.broadcast(several), ["key", "before", "after"], "left")
        else:  # frequent words are spread over SALTS parts
            salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
            j = u.withColumn("salt", F.pmod(F.xxhash64("id", "word_no"), F.lit(SALTS)))
            j = j.join(single.select("*", salts), ["key", "salt"], "left").join(several.select("*", salts), ["key", "before", "after", "salt"], "left").drop("salt")
        # The case of the first letter stays where that letter is right; else the usual spelling has it.
        meant, usual = F.coalesce("m1", "m2"), F.coalesce("f1", "f2")
        same_first = F.substring(meant, 1, 1) == F.substring("key", 1, 1)
        cased = F.when(same_first & (F.substring("word", 1, 1) != F.substring("key", 1, 1)), F.concat(F.substring("word", 1, 1), F.substring(meant, 2, 1_000_000))).when(same_first, meant).otherwise(usual)
        j = j.withColumn("fixed", cased)
        ocr = j.where("kind = 'word'").withColumn("repaired", F.coalesce("fixed", number_of(F.col("word")))).where("repaired IS NOT NULL AND repaired <> word").select("id", "line_no", "word_no", F.lit("ocr").alias("kind"), "word", "repaired")
        h = j.where("kind = 'hyphen'")
        count = self.words.select(F.col("key"), (F.col("c") + F.col("s")).alias("n"), F.col("c"))
        h = h.join(count.select("key", F.col("c").alias("c_joined"), F.col("n").alias("n_joined")), "key", "left").join(count.select(F.col("key").alias("alt_key"), F.col("n").alias("n_alt")), "alt_key", "left")
        keeps = (F.coalesce("n_alt", F.lit(0)) > F.greatest(F.coalesce("c_joined", F.lit(0)), F.lit(1))) | F.col("alt").rlike(r"^\p{Lu}[\p{Lu}\d]*-\d") | (F.col("alt").rlike(r"^\p{Lu}+-") & ~F.col("alt").rlike(r"^\p{Lu}\p{Ll}"))
        number_or_word = F.coalesce(number_of(F.col("word")), F.col("fixed"), F.col("word"))
        hyphen = h.select("id", "line_no", "word_no", F.lit("hyphen").alias("kind"), "word", F.when(keeps, F.col("alt")).otherwise(number_or_word).alias("repaired"))
        return furniture.unionByName(hyphen).unionByName(ocr)

    def paragraphs(self) -> DataFrame:
        """id, text: continuous paragraphs of every scanned content."""
        fixes = self.found().groupBy("id").agg(F.collect_list(F.struct("line_no", "kind", "word", "repaired")).alias("fixes"))
        return self.pages.join(fixes, "id", "left").mapInPandas(_paragraphs, "id string, text string")


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            gone, joins, words = set(), {}, {}
            for f in r.fixes if r.fixes is not None else ():
                if f["kind"] == "furniture":
                    gone.add(f["line_no"])
                elif f["kind"] == "hyphen":
                    joins[f["line_no"]] = (f["word"], f["repaired"])
                else:
                    words[f["line_no"], f["word"]] = f["repaired"]
            lines = [x.rstrip() for x in form_keeping_breaks(r.content).split("\n")]
            paragraphs: list[list[str]] = [[]]
            pending = ""
            cut = False  # a page break came in between
            width = max((len(x) for x in lines if len(x) <= PAGE_WIDTH), default=0)
            for no, line in enumerate(lines, 1):
                if no in gone:
                    cut = True
                    continue
                if not line.strip():
                    if not cut and paragraphs[-1] and not pending:
                        paragraphs.append([])
                    continue
                parts = line.split()
                body = paragraphs[-1]
                starts = line[0] in " \t"
                if starts and body and not pending and _TERMINAL.search(body[-1]):
                    paragraphs.append(body := [])
                cut = False
                if pending:
                    head, pending = pending, ""
                    tail = parts[0]
                    stem = tail.rstrip(EDGES)
                    body.append(head + tail[len(stem) :])
                    parts = parts[1:]
                if no in joins and parts:
                    word, repaired = joins[no]
                    lead = parts[-1][: len(parts[-1]) - len(parts[-1].lstrip(EDGES))]
                    pending = lead + repaired
                    parts = parts[:-1]
                for p in parts:
                    bare = p.strip(EDGES)
                    body.append(p.replace(bare, words[no, bare]) if bare and (no, bare) in words else p)
                if body and not pending and len(line) < 0.6 * width and not _TERMINAL.search(line):
                    paragraphs.append([])  # a heading
            if pending:
                paragraphs[-1].append(pending)
            out.append((r.id, "\n\n".join(" ".join(p) for p in paragraphs if p)))
        yield pd.DataFrame(out, columns=["id", "text"])
