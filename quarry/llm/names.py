"""Problem 4: names as typed by people, linked to the entities of a registry.

Distinct name strings are cut into folded tokens. Tokens of strings and of
registry names meet in a prefix-filtered set-similarity join on their q-grams
(rare q-grams first); the strings that share a distinguishing token with an
entity are verified by a soft token similarity in which rare tokens count
more: a token agrees in full, by nickname, by a typing error, as an initial or
abbreviation, or in another language.

Nicknames, and words of institutions in other languages or shortened, come from
short lists of general forms and from the strings themselves: an unexplained
given name that stands beside the last names of many bearers of one given name
is taken for a form of it; which words of institutions stand for which is
estimated over the strings whose own word names one institution only (a word
alignment, re-estimated EM_ROUNDS times).

A misspelling is only believed while it is much rarer than the name it would
be a misspelling of, so a neighbouring real name is not taken for one. Of the
entities that a string fits equally well all are kept. Null values, empty
values and values without a known name give no row.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import kernel as K

Q = 2  #: length of q-grams
GRAM_SIMILARITY = 0.35  #: Jaccard of the q-grams of two tokens that may be one word
RARER = 0.2  #: how often a misspelling may occur beside what it misspells, as a share
ACCEPT = 0.6  #: soft similarity from which a string names an entity
#: A word of this share of the organisations, and of so many, says of what kind they are and is no name.
KIND_SHARE, MIN_KIND = 0.05, 4
#: A given name is another form of one where so many last names, and this share of those it stands beside, have a bearer of that one.
MIN_BEARERS, BEARERS = 3, 0.6
#: A word stands for a word of the registry with at least this probability, seen in so many strings.
STANDS_FOR, MIN_STRINGS, EM_ROUNDS = 0.2, 3, 3

# Forms of address and titles, folded.
TITLES = frozenset("dr prof doc yrd uzm op av mr mrs ms md phd sn bay bayan herr frau hr fr ass arş gor ogr".split())
# Familiar forms of given names, folded.
NICKNAMES = {
    "alexander": "alex sascha sasha xander sandy", "ayse": "aysos aysus ays", "deniz": "dado deno", "elizabeth": "liz beth ilse lizzy betty eliza elisabeth lisa",
    "fatma": "fatos fati fatus", "friedrich": "fritz fred freddy fiete", "gulseren": "gulo gul guls", "hatice": "hatce hatca hatos", "joachim": "achim jochen jo",
    "johannes": "hannes johann hans john", "katherine": "kate kathy katie kat cathy", "leonie": "leo loni leni", "margaret": "peggy maggie meg marge greta",
    "mehmet": "memo memet memis", "mustafa": "mistik musti mustik", "nilufer": "nil nilu nilus", "robert": "rob bob bobby robbie bert", "suleyman": "sulo suli",
    "theodore": "theo ted teddy", "umut": "umo", "vildan": "vildo vili", "william": "will bill billy willy liam", "yasemin": "yase yaso yas", "zeynep": "zeyno zeyn",
    "cagri": "cago", "omer": "omo omus", "ibrahim": "ibo ibi ibis",
}
# Words of institutions that mean the same, folded; the first names the meaning.
MEANINGS = [
    "hospital hastanesi hastane hst hosp krankenhaus", "state devlet", "general genel gen gn allgemeines", "cardiology kardiyoloji kard kardiologie card", "society dernegi dernek der soc gesellschaft",
    "university universitesi universite univ uni", "faculty fakultesi fakulte fak fac fakultat", "medicine tip med medizin", "pharmacy eczacilik ecz pharm pharmazie",
    "research arastirma aras res ar forschung", "centre merkezi merkez mrk mer ctr center cent zentrum", "institute enstitusu enstitu inst ens enst institut", "clinical klinik clin klin kln", "informatics bilisim inform bil inf informatik",
]
_STOP = frozenset("of ve and the und fur icin".split())
_MEANING = {w: line.split()[0] for line in MEANINGS for w in line.split()}
_FULL = {n: full for full, line in NICKNAMES.items() for n in line.split()}
_FOLD = str.maketrans("ıİşŞçÇğĞøØłŁ", "iIsScCgGoOlL")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).translate(_FOLD))
    return "".join(c for c in t if not unicodedata.combining(c)).casefold().replace("ß", "ss")


def tokens(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def edits(a: str, b: str) -> int:
    """Edit distance in which swapping neighbours counts once; above 1 exact values don't matter (2 is returned)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:] and len(x) > 1):
        return 1
    return 2


def _believed(typed: str, meant: str, df: dict[str, int]) -> bool:
    return len(meant) >= 4 and edits(typed, meant) == 1 and df.get(typed, 1) <= 1 + RARER * df.get(meant, 1)


def _given(typed: str, meant: str, df: dict[str, int], learned: dict[str, frozenset[str]]) -> float:
    """Agreement of a typed given name with a registered one."""
    if typed == meant:
        return 1.0
    if meant in learned.get(typed, ()) or _FULL.get(typed) == meant or (meant in NICKNAMES and typed in NICKNAMES[meant].split()):
        return 0.9
    if len(typed) == 1:
        return 0.7 if meant[0] == typed else 0.0
    if _believed(typed, meant, df) or any(len(n) > 3 and _believed(typed, n, df) for n in NICKNAMES.get(meant, "").split()):
        return 0.8
    return 0.0


def _person(typed: list[str], name: list[str], df: dict[str, int], weight: dict[str, float], learned: dict[str, frozenset[str]]) -> float:
    typed = [t for t in typed if t not in TITLES]
    if not 2 <= len(typed) <= len(name):
        return 0.0
    first, *middle, last = name
    best = 0.0
    for i, s in enumerate(typed):
        own = 1.0 if s == last else 0.85 if _believed(s, last, df) else 0.0
        if not own:
            continue
        rest = typed[:i] + typed[i + 1 :]
        for j, f in enumerate(rest):
            given = _given(f, first, df, learned)
            left = rest[:j] + rest[j + 1 :]
            if not given or len(left) > len(middle):
                continue
            agree = [_given(x, m, df, learned) for x, m in zip(left, middle, strict=False)]
            if not all(agree):
                continue
            w = [weight.get(last, 1.0), weight.get(first, 1.0), *(weight.get(m, 1.0) for m in middle)]
            got = [own, given, *agree, *[0.5] * (len(middle) - len(left))]
            best = max(best, sum(x * y for x, y in zip(w, got, strict=True)) / sum(w))
    return best


def _meaning(t: str) -> str | None:
    if t in _MEANING:
        return _MEANING[t]
    near = {m for w, m in _MEANING.items() if len(w) >= 5 and (edits(t, w) == 1 or (len(t) >= 3 and w.startswith(t)))}
    return near.pop() if len(near) == 1 else None


def _same_words(typed: list[str], meant: list[str], df: dict[str, int]) -> float:
    """1 where the own words are the same in any order, less where some are misspelt, 0 where they are not the same."""
    if not typed or len(typed) != len(meant):
        return 0.0
    left, misspelt = list(meant), []
    for t in typed:
        if t in left:
            left.remove(t)
        else:
            misspelt.append(t)
    for t in misspelt:
        m = next((m for m in left if _believed(t, m, df)), None)
        if m is None:
            return 0.0
        left.remove(m)
    return 0.85 if misspelt else 1.0


def _shortened(typed: str, meant: str) -> bool:
    """The first letters of a word, or some of its letters in order from the first on."""
    if not 3 <= len(typed) < len(meant) or typed[0] != meant[0]:
        return False
    rest = iter(meant)
    return all(c in rest for c in typed)


def _stands_for(typed: str, meant: str, learned: dict[str, frozenset[str]]) -> bool:
    m = _meaning(typed)
    return typed == meant or (m is not None and m == _meaning(meant)) or meant in learned.get(typed, ()) or _shortened(typed, meant) or (len(meant) >= 6 and edits(typed, meant) == 1)


def _organisation(typed: list[str], name: list[str], kinds: set[str], df: dict[str, int], weight: dict[str, float], learned: dict[str, frozenset[str]]) -> float:
    """kinds: the words of the name that say of what kind the organisation is."""
    words = [t for t in typed if t not in _STOP]
    of_kind = [x for x in name if x in kinds]
    pb = [x for x in name if x not in kinds and x not in _STOP]
    told = [t for t in words if t not in pb and (_meaning(t) or t in kinds or learned.get(t) or any(_stands_for(t, x, learned) for x in of_kind))]
    pa = list(words)
    for t in told:
        pa.remove(t)
    if not pa and len(typed) == 1:
        return 0.0
    own = _same_words(pa, pb, df)
    if not own or not told or not of_kind:
        return 0.0
    a, b = {_meaning(t) or t for t in told}, {_meaning(x) or x for x in of_kind}
    fits = sum(any(_stands_for(t, x, learned) for x in of_kind) for t in told) + sum(any(_stands_for(t, x, learned) for t in told) for x in of_kind)
    same = max(len(a & b) / len(a | b), fits / (len(told) + len(of_kind)))
    w = max(weight.get(x, 1.0) for x in pb)
    return (w * own + 2 * same) / (w + 2) if same >= 0.6 else 0.0


def name_forms(cand: DataFrame) -> DataFrame:
    """kind, token, means: given names that stand for others, by the last names beside which they stand.

    cand: kind, tokens, name of strings and the entities whose last name they
    may hold. Given names of the registry stand for themselves only.
    """
    p = cand.where("kind = 'person'").select("tokens", "name", F.element_at("name", -1).alias("last"), F.element_at("name", 1).alias("given")).where(F.array_contains("tokens", F.col("last")))
    titles = F.array(*[F.lit(t) for t in sorted(TITLES)])
    free = F.filter("tokens", lambda t: (F.length(t) >= 3) & ~F.array_contains("name", t) & ~F.array_contains(titles, t))
    seen = p.select("given", "last", F.array_contains("tokens", F.col("given")).alias("named"), F.explode(free).alias("token")).distinct()
    beside = seen.groupBy("token").agg(F.countDistinct("last").alias("n"))
    known = p.select(F.explode(F.slice("name", F.lit(1), F.size("name") - 1)).alias("token")).distinct()
    bearers = seen.where("NOT named").groupBy("token", "given").agg(F.countDistinct("last").alias("m")).where(F.col("m") >= MIN_BEARERS)
    forms = bearers.join(beside, "token").where(F.col("m") >= BEARERS * F.col("n")).join(known, "token", "left_anti")
    return forms.groupBy("token").agg(F.collect_set("given").alias("means")).select(F.lit("person").alias("kind"), "token", "means")


def kind_forms(cand: DataFrame, kinds: DataFrame) -> DataFrame:
    """kind, token, means: typed words of institutions and the words of the registry that they stand for.

    cand: kind, typed, entity_id, tokens, name; kinds: entity_id, of_kind. Only
    strings that hold all own words of exactly one institution are looked at.
    """
    stop = F.array(*[F.lit(x) for x in sorted(_STOP)])
    o = cand.where("kind <> 'person'").join(kinds, "entity_id").withColumn("own", F.filter("name", lambda t: ~F.array_contains("of_kind", t) & ~F.array_contains(stop, t)))
    o = o.where((F.size("own") > 0) & (F.size(F.array_except("own", "tokens")) == 0)).withColumn("m", F.count("*").over(Window.partitionBy("kind", "typed"))).where("m = 1")
    left = F.array_distinct(F.filter("tokens", lambda t: ~F.array_contains("own", t) & ~F.array_contains(stop, t)))
    pairs = o.select("kind", "typed", left.alias("u"), "of_kind").select("kind", "typed", F.explode("u").alias("u"), "of_kind").select("kind", "typed", "u", F.explode("of_kind").alias("v"))
    pairs = K.checkpointed(cand.sparkSession, pairs)
    p = pairs.withColumn("p", F.lit(1.0))
    for _ in range(EM_ROUNDS):
        share = p.withColumn("c", F.col("p") / F.sum("p").over(Window.partitionBy("kind", "typed", "v")))
        t = share.groupBy("kind", "u", "v").agg(F.sum("c").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("kind", "u")))
        p = pairs.join(t.select("kind", "u", "v", "p"), ["kind", "u", "v"])
    strings = pairs.groupBy("kind", "u").agg(F.countDistinct("typed").alias("n")).where(F.col("n") >= MIN_STRINGS)
    good = p.where(F.col("p") >= STANDS_FOR).select("kind", "u", "v").distinct().join(strings, ["kind", "u"])
    return good.groupBy("kind", F.col("u").alias("token")).agg(F.collect_set("v").alias("means"))


def _strings(df: DataFrame, row_id: str, metadata: str, fields: dict[str, tuple[str, str | None]]) -> DataFrame:
    """id, field_name, kind, typed: a row for each name string of the fields."""
    def part(field: str, kind: str, separator: str | None) -> Column:
        value = F.col(metadata)[field]
        many = F.split(value, separator) if separator else F.array(value)
        return F.transform(many, lambda x: F.struct(F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), F.trim(x).alias("typed")))

    parts = [part(f, kind, separator) for f, (kind, separator) in fields.items()]
    whole = F.filter(F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull())), lambda x: F.length(x["typed"]) > 0)
    return df.select(F.col(row_id).cast("string").alias("id"), F.explode(whole).alias("x")).where("id IS NOT NULL").select("id", "x.*")


def _grams(col: Column) -> Column:
    padded = F.concat(F.lit("^"), col, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.substring(padded, i, F.lit(Q))))


def gram_share(token: Column) -> Column:
    """The least Jaccard similarity asked of a token: what two neighbours swapped leave of the q-grams of one letter fewer, at most GRAM_SIMILARITY."""
    n = F.greatest(F.length(token) - 1, F.lit(3))
    return F.least(F.lit(GRAM_SIMILARITY), (n - 2) / (n + 4))


def similar_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: tokens of the two frames (column token, distinct) that may be one word.

    Tokens of three letters and more whose q-grams are similar, by a
    prefix-filtered join on the rare ones; shorter ones where they are equal.
    """

    def prefixes(df: DataFrame, name: str, rank: DataFrame) -> DataFrame:
        long = df.where(F.length("token") > 2)
        g = long.select(F.col("token").alias(name), _grams(F.col("token")).alias("all")).select(name, "all", F.explode("all").alias("gram")).join(rank, "gram")
        ordered = g.groupBy(name, "all").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("o"))
        keep = F.size("all") - F.ceil(gram_share(F.col(name)) * F.size("all")) + 1
        return ordered.select(name, F.col("all").alias(f"all_{name}"), F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("x")).select(name, f"all_{name}", F.col("x.gram").alias("gram"))

    rank = left.unionByName(right).select(F.explode(_grams(F.col("token"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    both = prefixes(left, "a", rank).join(prefixes(right, "b", rank), "gram").select("a", "b", "all_a", "all_b").distinct()
    common = F.size(F.array_intersect("all_a", "all_b"))
    near = both.where(common >= F.least(gram_share(F.col("a")), gram_share(F.col("b"))) * (F.size("all_a") + F.size("all_b") - common)).select("a", "b")
    short = left.where(F.length("token") <= 2).select(F.col("token").alias("a"), F.col("token").alias("b")).join(right.select(F.col("token").alias("b")), "b").select("a", "b")
    return near.unionByName(short)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cut = {t: tokens(t) for t in b.typed.unique()}
        yield b.assign(tokens=b.typed.map(cut))


def link_names(df: DataFrame, registry: DataFrame, row_id: str = "id", metadata: str = "metadata", fields: dict[str, tuple[str, str | None]] | None = None) -> DataFrame:
    """id, field_name, entity_id, typed, similarity: the entities that each value names.

    fields: key of the metadata map -> (entity type, separator of several names
    or None). Rows of the registry without id, type or name are skipped. Each
    distinct string is cut into tokens once; frames that several steps read are
    stored.
    """
    fields = fields or {"Authors": ("person", ";"), "Institution": ("organisation", None), "UploadedBy": ("person", None)}
    spark = df.sparkSession
    strings = _strings(df, row_id, metadata, fields)
    distinct = K.checkpointed(spark, strings.groupBy("kind", "typed").agg(F.count("*").alias("n")).mapInPandas(_cut, "kind string, typed string, n long, tokens array<string>"))
    count = distinct.select(F.explode(F.array_distinct("tokens")).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("df"))
    known = registry.select(F.col("entity_id").cast("long").alias("n"), F.col("entity_type").alias("kind"), F.col("full_name").alias("typed")).where("n IS NOT NULL AND kind IS NOT NULL AND typed IS NOT NULL").select("kind", "typed", "n")
    known = known.mapInPandas(_cut, "kind string, typed string, n long, tokens array<string>").where(F.size("tokens") > 0)
    stop = F.array(*[F.lit(x) for x in sorted(_STOP)])
    initials = F.array_join(F.transform(F.filter("tokens", lambda t: ~F.array_contains(stop, t)), lambda t: F.substring(t, 1, 1)), "")
    known = K.checkpointed(spark, known.select(F.col("n").alias("entity_id"), "kind", F.col("tokens").alias("name"), initials.alias("initials")))
    words = known.select("entity_id", "kind", "name", F.explode(F.array_distinct("name")).alias("token"))
    often = words.groupBy("token").agg(F.count("*").alias("names"))
    listed = [*_MEANING, *_STOP]
    total = known.groupBy("kind").agg(F.count("*").alias("all"))
    common = words.where("kind <> 'person'").groupBy("kind", "token").agg(F.count("*").alias("n")).join(total, "kind").where((F.col("n") >= MIN_KIND) & (F.col("n") >= KIND_SHARE * F.col("all"))).select("kind", "token", F.lit(True).alias("common"))
    words = K.checkpointed(spark, words.join(common, ["kind", "token"], "left").withColumn("of_kind", (F.col("kind") != "person") & (F.coalesce("common", F.lit(False)) | (F.col("token").isin(*_MEANING) if _MEANING else F.lit(False)))))
    kinds = words.groupBy("entity_id").agg(F.collect_set(F.when(F.col("of_kind"), F.col("token"))).alias("of_kind"))
    # The distinguishing words of an entity: what says nothing of its kind; of a person the last name.
    telling = words.where(F.when(F.col("kind") == "person", F.col("token") == F.element_at("name", -1)).otherwise(~F.col("of_kind") & ~F.col("token").isin(*listed))).select("entity_id", "kind", "token")
    near = similar_tokens(distinct.select(F.explode("tokens").alias("token")).distinct(), telling.select("token").distinct())
    by_token = distinct.select("kind", "typed", F.explode(F.array_distinct("tokens")).alias("a")).join(near, "a").join(telling.withColumnRenamed("token", "b"), ["kind", "b"]).select("kind", "typed", "entity_id").distinct()
    short = distinct.where("kind <> 'person' AND size(tokens) = 1 AND length(tokens[0]) > 1 AND typed = upper(typed)").select("kind", "typed", F.col("tokens")[0].alias("initials"))
    by_initials = short.join(known.select("kind", "entity_id", "initials"), ["kind", "initials"]).select("kind", "typed", "entity_id")
    cand = by_token.unionByName(by_initials).join(distinct.select("kind", "typed", "tokens"), ["kind", "typed"]).join(known, ["entity_id", "kind"])
    cand = K.checkpointed(spark, cand)
    learned = K.checkpointed(spark, name_forms(cand).unionByName(kind_forms(cand, kinds)))
    cand = cand.join(kinds, "entity_id")
    # What a verification needs to know of the tokens comes along.
    need = cand.select("kind", "typed", "entity_id", F.explode(F.array_distinct(F.concat("tokens", "name"))).alias("token")).join(count, "token", "left").join(often, "token", "left").join(learned, ["kind", "token"], "left").groupBy("kind", "typed", "entity_id").agg(F.collect_list(F.struct("token", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("names", F.lit(1)).alias("names"), "means")).alias("counts"))
    verified = cand.join(need, ["kind", "typed", "entity_id"]).mapInPandas(_verify, "kind string, typed string, entity_id long, similarity double")
    best = F.max("similarity").over(Window.partitionBy("kind", "typed"))
    fits = verified.withColumn("best", best).where("similarity >= best - 1e-9").select("kind", "typed", "entity_id", "similarity")
    return strings.join(fits, ["kind", "typed"]).groupBy("id", "field_name", "entity_id").agg(F.min("typed").alias("typed"), F.max("similarity").alias("similarity"))


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            df, names = {c["token"]: c["df"] for c in r.counts}, {c["token"]: c["names"] for c in r.counts}
            weight = {t: 1 / math.log2(1 + n) for t, n in names.items()}
            learned = {c["token"]: frozenset(c["means"]) for c in r.counts if c["means"] is not None}
            typed, name = list(r.tokens), list(r.name)
            if r.kind == "person":
                s = _person(typed, name, df, weight, learned)
            elif len(typed) == 1 and typed[0] == r.initials:
                s = ACCEPT
            else:
                s = _organisation(typed, name, set(r.of_kind), df, weight, learned)
            if s >= ACCEPT:
                rows.append((r.kind, r.typed, r.entity_id, round(s, 6)))
        yield pd.DataFrame(rows, columns=["kind", "typed", "entity_id", "similarity"])
