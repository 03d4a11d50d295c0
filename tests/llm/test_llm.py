"""Each operator against brute force or held-out truth, and on awkward rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language, leak, names, near_dup, packing, scans, sentences, subjects
from quarry.llm import kernel as K
from quarry.llm import visual_form as V

EXTRA = ", row_id string, text2 string, rep string, label string, words string, form string, kind string"
NONE = (None,) * 7


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame([(*r, *NONE) for r in rows], schema + EXTRA)


# kernel


def test_words_are_runs_of_letters_and_digits():
    texts = ["A-b c3 ünlü", "", "  ", "é", "x" * 70_000 + " y", "a_b", "A-b c3 ünlü"]
    h, doc, s, e = K.words(texts)
    got = [[t[a:b] for d, a, b in zip(doc, s, e, strict=True) if d == i] for i, t in enumerate(texts)]
    assert got == [re.findall(r"[^\W_]+", t) for t in texts]
    by = {}
    for d, a, b, x in zip(doc, s, e, h, strict=True):
        assert by.setdefault(texts[d][a:b], x) == x
    assert len(set(by.values())) == len(by)


# problem 2


@pytest.mark.parametrize(
    ("a", "b"),
    [("Ａｂｃ １２", "Abc 12"), ("ét", "ét"), ("na​me", "name"), ("a b", "a b"), ("ﬁne", "fine"), ("pаss", "pass"), ("x‑y", "x-y"), ("so­ft", "soft"), ("а", "a"), ("привeт", "привет"), ("a\r\nb", "a\nb")],
)
def test_same_look(a, b):
    assert a != b and V.look(a) == V.look(b)


@pytest.mark.parametrize(("a", "b"), [("10²", "102"), ("ılık", "ilik"), ("schon", "schön"), ("a\nb", "a b"), ("Abc", "abc"), ("½", "1⁄2"), ("①", "1")])
def test_other_look(a, b):
    assert V.look(a) != V.look(b)


def test_look_alikes_match_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/corpus_documents.parquet")
    rows = [(r.id, r.content) for r in d.collect() if r.content is not None]
    rows += [("x1", "na​me"), ("x2", "name"), ("x3", "name"), ("x4", None), ("x5", ""), ("x6", "​"), ("x2", "name")]
    df = spark.createDataFrame([(a, b, *NONE) for a, b in rows], "id string, content string" + EXTRA)
    got = {tuple(r) for r in V.look_alikes(df, "id", "content").collect()}
    seen = sorted({(a, b) for a, b in rows if b is not None})
    want = {(a, c) for (a, b), (c, d) in itertools.combinations(seen, 2) if b != d and a < c and V.look(b) == V.look(d)}
    assert got == want and ("x1", "x2") in got and ("x5", "x6") in got and ("x2", "x3") not in got
    assert V.look_alikes(df.limit(0), "id", "content").count() == 0
    assert V.with_form(df, "content").where("id = 'x4'").first().form is None


# problem 6


def grams(text, n):
    w = re.findall(r"[^\W_]+", V.form(text))
    return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_pairs(rows, n, t, least):
    own = {i: grams(x, n) for i, x in rows if x is not None}
    out = set()
    for a, b in itertools.combinations(sorted(own), 2):
        (wa, ga), (wb, gb) = own[a], own[b]
        if len(wa) >= least and len(wb) >= least and len(ga & gb) >= t * len(ga | gb):
            out.add((a, b))
    return out


def edited(rng, words, share):
    w = list(words)
    for _ in range(int(share * len(w))):
        w[rng.randrange(len(w))] = f"v{rng.randrange(999)}"
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 200))]
        rows += [(f"d{k}_0", " ".join(base)), (f"d{k}_1", edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05, 0.1]))), (f"d{k}_2", edited(rng, base, 0.02))]
    rows += [("n", None), ("e", ""), ("s", "too short"), ("long", "word " * 40_000), ("long2", "word " * 40_000)]
    df = spark.createDataFrame([(a, b, *NONE) for a, b in rows], "id string, content string" + EXTRA)
    want = brute_pairs(rows, 3, 0.7, 30)
    got = {(r.row_id_1, r.row_id_2) for r in near_dup.near_duplicate_pairs(spark, {"t": (df, "id", "content")}).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and ("long", "long2") in got
    groups = {r.row_id: r for r in near_dup.near_duplicate_groups(spark, {"t": (df, "id", "content")}, 3, 0.7).collect()}
    assert set(groups) == {i for i, x in rows if x is not None and len(grams(x, 3)[0]) >= 30}
    assert all(groups[a].class_id == groups[b].class_id for a, b in got)
    assert groups["long"].n_copies == 2 and groups["long"].n_links == 0
    assert near_dup.near_duplicate_pairs(spark, {"t": (df.limit(0), "id", "content")}).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    rng = random.Random(8)
    rows = []
    for k in range(1000):  # 56 of 80 sequences of three words in common
        w = [f"w{rng.randrange(10**9)}" for _ in range(70)]
        rows += [(f"d{k}_0", " ".join(w)), (f"d{k}_1", " ".join(f"v{k}" if i in (10, 25, 40, 55) else x for i, x in enumerate(w)))]
    df = spark.createDataFrame([(a, b, *NONE) for a, b in rows], "id string, content string" + EXTRA)
    got = {(r.row_id_1, r.row_id_2) for r in near_dup.near_duplicate_pairs(spark, {"t": (df, "id", "content")}).collect()}
    assert got <= {(f"d{k}_0", f"d{k}_1") for k in range(1000)} and len(got) >= 995


def test_hamming_code_covers():
    assert len(near_dup._CODEWORDS) == 16
    assert all(d.min() <= near_dup.RADIUS for d in near_dup._DISTANCE)
    for x in range(128):
        for bit in [0, *(1 << i for i in range(7))]:
            assert near_dup.ANCHORS[x][0] in near_dup.ANCHORS[x ^ bit]


# problem 8


def test_leaks_match_brute_force(spark, small):
    items = spark.read.parquet(f"{small}/eval_items.parquet")
    passages = {r.item_id: r.passage for r in items.collect()}
    some = sorted(passages)[:6]
    cut = lambda i, a, b: " ".join(passages[i].split()[a:b])
    rows = [(1, "before " + cut(some[0], 3, 20) + " after"), (2, cut(some[1], 0, 14).upper().replace(" ", "\n")), (3, cut(some[2], 0, 9)), (4, None), (5, ""), (6, cut(some[3], 2, 9) + " OTHER " + cut(some[3], 10, 22) + " x"), (7, "filler " * 30_000 + cut(some[4], 1, 18)), (7, "filler " * 30_000 + cut(some[4], 1, 18)), (None, cut(some[0], 0, 20))]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    df = docs(spark, rows)
    fold = lambda t: re.findall(r"[^\W_]+", V.look(t or "").translate(leak._FOLD).casefold())
    index = {}
    for i, p in passages.items():
        w = fold(p)
        for k in range(len(w) - 11):
            index.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in rows:
        w = fold(t)
        for k in range(len(w) - 11):
            want |= {(d, i) for i in index.get(tuple(w[k : k + 12]), ()) if d is not None}
    got = leak.leaks(spark, df, items).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.exact_words >= 12} == want and (7, some[4]) in want
    assert any(r.doc_id == 6 and r.item_id == some[3] and r.same_words >= 17 for r in got)
    assert leak.leaks(spark, df.limit(0), items).count() == 0 and leak.leaks(spark, df, items.limit(0)).count() == 0


def test_every_position_is_in_a_mask():
    assert all(any(m[i] == "1" for m in leak.MASKS) for i in range(leak.SPAN))


# problem 7


def test_hilbert_steps_by_one():
    p = np.array(list(itertools.product(range(8), repeat=3)))
    k = packing.hilbert(p, 3)
    assert sorted(k) == list(range(512))
    assert set(np.abs(np.diff(p[np.argsort(k)], axis=0)).sum(axis=1)) == {1}


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(0, 300)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "word " * 20_000), (None, "x")]
    sized = packing.sized(docs(spark, rows))
    budgets = spark.createDataFrame([(1, 256), (2, 2048), (3, None), (4, 0)], "budget_id int, capacity_tokens int")
    out = packing.pack(sized, budgets).toPandas()
    size = {r.doc_id: r.n_tokens for r in sized.collect()}
    for b, cap in ((1, 256), (2, 2048)):
        x = out[out.budget_id == b]
        assert x.groupby("doc_id").n_tokens.sum().to_dict() == size
        assert x.groupby("container_id").n_tokens.sum().max() <= cap
        pieces = x.groupby("doc_id").size()
        assert all((pieces[d] > 1) == (n > cap) for d, n in size.items())
        x = x.sort_values(["doc_id", "piece_no"])
        assert (x.start_token == x.groupby("doc_id").n_tokens.cumsum() - x.n_tokens).all()
    assert set(out.budget_id) == {1, 2}
    assert packing.fit(packing.pack(sized, budgets), budgets).where("budget_id = 1").first().filled > 0.95
    assert packing.pack(sized.limit(0), budgets).count() == 0


# problem 5


TEXTS = {
    "en": "The report describes the blood pressure of the patient. Nobody had linked the heart rate to the biopsy result. A mean value was noted for wound healing in the northern centre.",
    "de": "Der Bericht beschreibt den Blutdruck des Patienten. Niemand hatte die Herzfrequenz mit dem Befund verbunden. Für die Wundheilung ergab sich ein mittlerer Wert im Norden.",
    "tr": "Bu bölümde hastanın tansiyon ölçümü ele alınmaktadır. Kalp hızı ile biyopsi sonucu hiç karşılaştırılmamıştı. Yara iyileşmesi için ortalama bir değer bulundu.",
}


def test_labels(spark):
    df = spark.createDataFrame([("English",), ("en-GB",), ("TUR",), ("Français",), ("xx",), ("",), (None,), ("und",), (" de ",)], "l string")
    assert [r.c for r in df.select(language.label_code(F.col("l")).alias("c")).collect()] == ["en", "en", "tr", "fr", None, None, None, None, "de"]


def test_automaton_finds_exactly_the_substrings():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 4, 60)
    t = language.automaton(s, 4)
    text = "".join(map(str, s))
    for _ in range(300):
        q = "".join(map(str, rng.integers(1, 4, rng.integers(1, 7))))
        state, ok = 0, True
        for c in q:
            state = int(t[state, int(c)])
            if not state:
                ok = False
                break
        assert ok == (q in text)


def test_languages(spark):
    train = docs(spark, [(i, (TEXTS[x] + " ") * 3) for i, x in enumerate(list(TEXTS) * 4)], "doc_id long, text string").withColumn("lang", F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("doc_id") % 3 + 1).cast("int")))
    m = language.train(spark, train, "doc_id", "text", F.col("lang"))
    rows = [(1, TEXTS["de"], "de"), (2, TEXTS["en"] + " " + TEXTS["tr"], "German"), (3, None, "en"), (4, "", "en"), (5, "n/a", None), (6, TEXTS["tr"] * 500, None), (7, TEXTS["en"] + " “Kalp hızı ile biyopsi sonucu hiç karşılaştırılmamıştı.” " + TEXTS["en"], "xx")]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], "doc_id long, text string, lang string" + EXTRA)
    seg = language.segments(spark, m, df, "doc_id", "text", F.col("lang"))
    got = {(r.row_id, r.lang): r for r in language.languages(seg).collect()}
    assert set(got) == {("1", "de"), ("2", "en"), ("2", "tr"), ("6", "tr"), ("7", "en")}
    assert got["2", "tr"].label == "de" and all(0 < r.confidence <= 1 for r in got.values())
    assert language.segments(spark, m, df.limit(0), "doc_id", "text", F.col("lang")).count() == 0
    with pytest.raises(ValueError):
        language.train(spark, train.limit(0), "doc_id", "text", F.col("lang"))


def test_languages_of_held_out_labels(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    m = language.train(spark, d, "doc_id", "text", F.col("lang"))
    x = language.languages(language.segments(spark, m, d, "doc_id", "text", F.col("lang"))).where("is_main AND label IS NOT NULL").toPandas()
    assert (x.lang == x.label).mean() > 0.8  # some labels are wrong on purpose


# problem 9


def test_subjects_of_hand_labels():
    texts, labels = [], []
    rng = random.Random(4)
    own = {0: "heart biopsy fever dose".split(), 1: "court ruling appeal licence".split()}
    for _ in range(80):
        k = rng.randrange(2)
        texts.append(". ".join("the note on " + rng.choice(own[k]) + " was kept" for _ in range(6)) + ". Nothing else was noted on page 3.")
        labels.append(k)
    w = subjects.fit(texts[:60], np.array(labels[:60]), 2)
    s = subjects.Sentences(texts[60:])
    z = s.scores(w)
    sure = np.abs(z[:, 0] - z[:, 1]) > 1
    assert (z.argmax(axis=1) == np.array(labels[60:])[s.doc])[sure].mean() > 0.98
    assert subjects.Sentences(["", "  "]).scores(w).shape == (0, 2)


def test_classify(spark, small="/root/testdata/sf0.01"):
    t = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, "…")], "doc_id long, text string")
    d = t("documents").select("doc_id", "text").unionByName(extra)
    got = subjects.classify(spark, d, t("corpus_documents"), t("subject_labels"), t("subjects"))
    rows = got.toPandas()
    assert not set(rows.doc_id) & {900001, 900002, 900003}
    hand = {(r.doc_id, r.subject) for r in t("subject_labels").distinct().collect()}
    said = {(r.doc_id, r.subject) for r in rows.itertuples() if r.sentences >= 0.25 * r.n_sentences}
    known = {x for x in said if x[0] in {h[0] for h in hand}}
    assert len(known & hand) >= 0.75 * len(hand)
    c = subjects.composition(got).toPandas()
    assert abs(c.share.sum() - 1) < 1e-3
    assert subjects.classify(spark, d.limit(0), t("corpus_documents"), t("subject_labels"), t("subjects")).count() == 0


# problem 3


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Dorva bu dozu 8,7 mg olarak önerdi.", "Başağrısı, bulantı vb. yakınmalar 35. haftada azaldı."],
        ["Yakınmalar şunlardı: bulantı, kusma vb.", "87 örnekte görüldü."],
        ["Mrs. Kar asked, “Is this safe? Can I stop?” and left.", "The trend was clear... but not for group 40.", "(Experts expect it after 1990.)", "The p value was 0.41 (i.e. not significant)."],
        ["“It explains only 54.1 percent!”", "It was given i.v. at 8 a.m. on day 11.", "J. R. Nor wrote notes.v2.txt in 2010."],
        ["Voir p. 43 et fig. 60.", "« Arrêtez tout ! » a crié M. Kar.", "On a noté fièvre, toux, etc.", "En outre."],
        ["Dr. Os empfahl z. B. 7,4 mg am 3. Tag.", "Der Wert stieg am 12. Mai.", "„Nicht absetzen!“, rief Frau Kar.", "Siehe Abb. 25 bzw. Tab. 58."],
        ["फिर से देखा।", "डॉ. Kar ने बदल दिया?", "नर्स ने देखा।"],
        ["هل فحص د. سالم بعد الخروج؟", "سجل الطبيب في اليوم 4."],
        ["ผู้ป่วยทบทวน 5.9 ในวันถัดไป", "พยาบาลตรวจ"],
    ],
)
def test_sentence_ends(parts):
    text = " ".join(parts)
    want = list(itertools.accumulate(parts, lambda n, p: n + 1 + len(p), initial=-1))[1:]
    assert sentences.ends(text) == want


def test_sentence_ends_without_spaces():
    parts = ["医生说：“请每天服用2.3毫克。”", "“不要停药！”药剂师提醒说。", "家属昨天。"]
    assert sentences.ends("".join(parts)) == list(itertools.accumulate(map(len, parts)))


def test_cells(spark):
    rows = [("q", 0, "Uyarı\nDr."), ("q", 1, "Kar geldi."), ("q", 1, "Kar geldi."), ("q", 2, None), ("q", 3, "Sonra"), ("q", 5, "gitti. Bitti"), (None, 0, "x"), ("e", 0, ""), ("long", 0, "Bir cümle daha. " * 4000)]
    rows += [("many", i, f"Cümle {i} burada") if i % 2 else ("many", i, f"ve {i} orada. Yeni") for i in range(700)]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], "query_id string, sentence_index int, sentence string" + EXTRA)
    got = sentences.true_sentences(df).toPandas()
    q = got[got.query_id == "q"].sort_values(["sentence_index", "end_offset"])
    assert list(zip(q.sentence_index, q.end_offset, strict=True)) == [(0, 5), (1, 10), (5, 6), (5, 12)]
    assert (got.query_id == "long").sum() == 4000 and "e" not in set(got.query_id)
    many = got[got.query_id == "many"]
    assert set(many.sentence_index) == {*range(0, 700, 2), 699} and not many.duplicated(["sentence_index", "end_offset"]).any()
    assert sentences.true_sentences(df.limit(0)).count() == 0


# problem 4


def test_names(spark):
    reg = spark.createDataFrame([(1, "person", "William Derya Tammiyurt"), (2, "person", "Robert Dorsoşan"), (3, "person", "Ayşe Dorzetekin"), (4, "organisation", "Peldotekin Üniversitesi Tıp Fakültesi"), (5, "organisation", "Dortramor Devlet Hastanesi"), (6, "organisation", "Dortramor General Hospital"), (7, None, "x"), (8, "person", None)], "entity_id long, entity_type string, full_name string")
    meta = [
        ("a", {"Authors": "Prof. Dr. Bill D. Tamiyurt; DORSOSAN Rob; Nobody Known", "Institution": "Tıp Fak., Peldotekin Univ."}),
        ("b", {"Authors": "Dorzetekin,  Ayse", "UploadedBy": "R. Dorsoşan", "Institution": "PÜTF"}),
        ("c", {"Institution": "Dortramor State Hospital"}),
        ("d", {"Institution": "Dortramor Gen. Hosp.", "UploadedBy": "William Faye Tammiyurt"}),
        ("e", None),
        ("f", {}),
        ("g", {"Authors": " ; ;", "UploadedBy": "Margaret Dorsoşan"}),
        ("h", {"Authors": "; ".join(["Robert Dorsoşan"] * 3000)}),
    ]
    df = spark.createDataFrame([(i, m, *NONE) for i, m in meta], "id string, metadata map<string,string>" + EXTRA)
    got = {(r.id, r.field_name, r.entity_id) for r in names.link_names(df, reg).collect()}
    assert got == {("a", "Authors", 1), ("a", "Authors", 2), ("a", "Institution", 4), ("b", "Authors", 3), ("b", "UploadedBy", 2), ("b", "Institution", 4), ("c", "Institution", 5), ("d", "Institution", 6), ("h", "Authors", 2)}
    assert names.link_names(df.limit(0), reg).count() == 0 and names.link_names(df, reg.limit(0)).count() == 0


def test_edits():
    assert [names.edits("abcd", x) for x in ("abcd", "abdc", "abd", "abcde", "abxd", "badc", "x")] == [0, 1, 1, 1, 1, 2, 2]


# problem 1


def test_costs_and_numbers(spark):
    pairs = [("saklarna", "saklama", 0.2), ("b1r", "bir", 0.25), ("table", "cable", 1.0), ("same", "same", 0.0), ("xn0rthem", "northern", 1.35), ("ab", "", 2.0)]
    assert np.allclose(scans.misreading_costs([p[0] for p in pairs], [p[1] for p in pairs]), [p[2] for p in pairs])
    words = ["S,9", "2O18", "12", "l", "so", "8B.6", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", scans.number_of(F.col("w")).alias("n"))
    assert {r.w: r.n for r in df.collect()} == dict(zip(words, ["5,9", "2018", None, None, None, "88.6", None], strict=True))


def plain_distance(a, b):
    d = {(0, 0): 0.0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i or j:
                steps = [d[i - 1, j] + 1] if i else []
                steps += [d[i, j - 1] + 1] if j else []
                steps += [d[i - x, j - y] + (0.0 if a[i - x : i] == b[j - y : j] else 1.0 if x == y == 1 and (a[i - 1], b[j - 1]) not in scans.CONFUSIONS else scans.CONFUSIONS.get((a[i - x : i], b[j - y : j]), 9.0)) for x in (1, 2) for y in (1, 2) if i >= x and j >= y]
                d[i, j] = min(steps)
    return d[len(a), len(b)]


def test_distances_are_those_of_the_plain_rule():
    rng = random.Random(11)
    words = ["".join(rng.choice("rnmcl1ieo0du") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    near = [w[: (k := rng.randrange(len(w)))] + rng.choice(["", "m", "rn", "cl", "1", "x"]) + w[k + rng.randrange(2) :] for w in words]
    assert np.allclose(scans.misreading_costs(words, near), [plain_distance(a, b) for a, b in zip(words, near, strict=True)])


def test_scans(spark):
    body = "The report describes the northern centre and the blood pressure of many patients in detail. "
    clean = [(f"c{i}", body * 6 + "A beta-blocker was given. Nothing was noted.") for i in range(8)]
    page = "\n".join(
        [
            "The report describes the northem centre and the blo-",
            "od pressure of many patients in detail. The report de-",
            "scribes the n0rthern centre and a beta-",
            "- 12 -",
            "",
            "The Running Journal 2014;35(6)",
            "blocker of many patients in detail. Nothing was notcd",
            "by the northern centre and the blood pressure of many –",
            "patients in detail. The report describes 2O18 patients.",
        ]
    )
    rows = [*clean, ("s", page), ("n", None), ("e", ""), ("long", body * 3000)]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], "id string, content string" + EXTRA)
    s = scans.Scans(spark, df)
    got = {(r.id, r.line_no, r.kind, r.repaired) for r in s.found().collect()}
    assert got == {("s", 1, "ocr", "northern"), ("s", 1, "hyphen", "blood"), ("s", 2, "hyphen", "describes"), ("s", 3, "ocr", "northern"), ("s", 3, "hyphen", "beta-blocker"), ("s", 4, "furniture", ""), ("s", 6, "furniture", ""), ("s", 7, "ocr", "noted"), ("s", 9, "ocr", "2018")}
    text = s.paragraphs().first().text
    assert "a beta-blocker of many patients" in text and "Journal" not in text and "blood pressure of many – patients" in text
    assert scans.Scans(spark, df.limit(0)).found().count() == 0


def test_scans_repair_misreadings_that_no_list_names(spark):
    body = "The doctor saw a normal pulse in the morning and a strong signal before the operation. "
    clean = [(f"c{i}", body * 6 + "Codes AB-12 and AB-12 were kept.") for i in range(8)]
    page = "\n".join(
        [
            "The doctor saw a normol pulse in the morning and a strong siqnal",
            "before the operation. The doctr saw a normal pulse in the morninng",
            "and a strong signal before the operation. The doctor saw a normal",
            "pulze near the operation, and codes AB-17 were kept.",
        ]
    )
    df = spark.createDataFrame([(*r, *NONE) for r in [*clean, ("s", page)]], "id string, content string" + EXTRA)
    got = {(r.line_no, r.kind, r.repaired) for r in scans.Scans(spark, df).found().collect()}
    # Beside "near", "pulse" is not known; a code is no misreading of another.
    assert got == {(1, "ocr", "normal"), (1, "ocr", "signal"), (2, "ocr", "doctor"), (2, "ocr", "morning")}


def test_scans_with_wide_lines_and_two_places(spark, monkeypatch):
    body = "The report describes the northern centre and the blood pressure of many patients in detail. "
    wide = "The report describes the northern centre and the blood pressure of many patients in detail. " + "Table 4 and 5 and six."
    lines = ["The report describes the n0rthcrn centre and the blood", "pressure of many patients in detail. The report", "describes the northern centre and the blood pressure"] * 4
    lines[3:] = [x.replace("n0rthcrn", "northern") for x in lines[3:]]
    clean = [(f"c{i}", body * 6) for i in range(8)]
    df = spark.createDataFrame([(*r, *NONE) for r in [*clean, ("s", "\n".join([*lines, wide]))]], "id string, content string" + EXTRA)
    assert len(wide) > 110
    found = lambda: sorted(tuple(r) for r in scans.Scans(spark, df).found().select("id", "line_no", "kind", "repaired").collect())
    got = found()
    assert [g for g in got if g[2] == "ocr"] == [("s", 1, "ocr", "northern")]
    monkeypatch.setattr(scans, "BROADCAST_WORDS", 0)
    assert found() == got


def test_long_answers_are_whole(spark):
    cells = [(i, f"word{i} goes on") for i in range(300)]
    cells[240] = (240, "She said “this begins.")
    cells[241:275] = [(i, f"Part {i} is said.") for i in range(241, 275)]
    cells[275] = (275, "It ends”.")
    cells[290] = (290, "A line\nand another.\n Third")
    cells += [(600, "After a gap."), (5000, "Far. Away")]
    short = [(i if i < 300 else i - 599 + 299, t) for i, t in cells if i < 600]
    text = " ".join(t for _, t in cells)
    starts, pos = [], 0
    for _, t in cells:
        starts.append(pos)
        pos += len(t) + 1
    want = set()
    for e in sentences.ends(text):
        k = max(i for i, x in enumerate(starts) if x < e)
        want.add((cells[k][0], e - starts[k]))
    rows = [("q", i, t) for i, t in cells] + [("s", i, t) for i, t in short if i < 250]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], "query_id string, sentence_index int, sentence string" + EXTRA)
    got = sentences.true_sentences(df).collect()
    assert {(r.sentence_index, r.end_offset) for r in got if r.query_id == "q"} == want
    assert not any(240 <= i < 275 for i, _ in want) and any(r.query_id == "s" for r in got)


def test_languages_choose_their_rules():
    assert sentences._language("The dose was given to the patient and the trial") == "en"
    assert sentences._language("Der Wert stieg am 12. Mai und die Dosis wurde") == "de"
    assert sentences._language("Xyz 12") == "latin" and sentences._language("Он пришёл") == "ru"


def test_hot_anchors_and_other_sides_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    rows = [(f"d{k}", edited(rng, base, 0.03)) for k in range(60)] + [(f"e{k}", edited(rng, [f"x{k}_{i % 40}" for i in range(60)], 0.02)) for k in range(30)] + [(f"f{k}", edited(rng, [f"x{k}_{i % 40}" for i in range(60)], 0.02)) for k in range(30)]
    df = spark.createDataFrame([(*r, *NONE) for r in rows], "id string, content string" + EXTRA)
    pairs = lambda: {tuple(r) for r in near_dup.near_duplicate_pairs(spark, {"t": (df, "id", "content")}).collect()}
    plain = pairs()
    monkeypatch.setattr(near_dup, "HOT", 2)
    assert pairs() == plain and len(plain) > 1000
    monkeypatch.setattr(near_dup, "BROADCAST_HOT", 0)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    assert pairs() == plain


def test_leaks_by_shuffle_give_the_same(spark, small, monkeypatch):
    items, d = spark.read.parquet(f"{small}/eval_items.parquet"), spark.read.parquet(f"{small}/documents.parquet")
    plain = {tuple(r) for r in leak.leaks(spark, d, items).collect()}
    monkeypatch.setattr(leak, "BROADCAST_HASHES", 0)
    assert {tuple(r) for r in leak.leaks(spark, d, items).collect()} == plain and plain


def test_many_copies_and_one_look_alike(spark):
    df = spark.range(100_000).selectExpr("cast(id as string) AS id", "'same name' AS content").unionByName(spark.createDataFrame([("x", "s\u0430me name"), ("y", "other")], "id string, content string"))
    got = V.look_alikes(df, "id", "content")
    assert got.count() == 100_000 and got.where("row_id_2 = 'x'").count() == 100_000


def test_case_folding_is_a_form_of_its_own(spark):
    df = spark.createDataFrame([("Ｓtraße",), ("STRASSE",), (None,)], "content string")
    assert [tuple(r) for r in V.with_form(df, "content", "form", "folded").select("form", "folded").collect()] == [("Straße", "strasse"), ("STRASSE", "strasse"), (None, None)]


def test_more_subjects_than_labels(spark, small="/root/testdata/sf0.01"):
    t = lambda n: spark.read.parquet(f"{small}/{n}.parquet")
    many = t("subjects").select("subject").unionByName(spark.range(992).selectExpr("concat('a', id) AS subject"))
    few = subjects.classify(spark, t("documents"), t("corpus_documents"), t("subject_labels"), t("subjects"))
    assert many.count() == 1001
    got = subjects.classify(spark, t("documents"), t("corpus_documents"), t("subject_labels"), many)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in few.collect()}


def test_sections_name_subjects(spark):
    rows = [(i, f"law_{i}.txt", "Court News") for i in range(25)] + [(100 + i, f"sport_{i}.txt", "Mixed") for i in range(15)] + [(200 + i, f"law_{i}.txt", "Mixed") for i in range(15)] + [(300, "x.txt", "Court News"), (301, "x.txt", "Mixed"), (302, "sport_9.txt", "Court News"), (303, None, None)]
    df = spark.createDataFrame(rows, "id long, file_name string, section string")
    got = {r.id: r.subject for r in subjects.weak_labels(df, "id", F.col("file_name"), F.col("section"), ["law", "sport"]).collect()}
    assert got[300] == "law" and 301 not in got and got[302] == "sport" and 303 not in got and len(got) == 57


def test_more_budgets_than_a_block(spark):
    sized = packing.sized(docs(spark, [(i, "alpha beta " * (i % 7)) for i in range(50)]))
    budgets = spark.createDataFrame([(i, 10 + i % 5) for i in range(packing.BUDGET_BLOCK * 2 + 1)], "budget_id int, capacity_tokens int")
    w = packing.whole(packing.pack(sized, budgets, rows_per_task=3000), budgets).collect()
    assert len(w) == budgets.count() and all((r.n_docs, r.overfull, r.gaps, r.needless_splits) == (50, 0, 0, 0) for r in w)


def test_packer_holds_its_window_only():
    p = packing.Packer(10, window=4)
    rng, out = random.Random(1), []
    for i in range(500):
        out += p.put(n := rng.randrange(0, 11), (i, n))
        assert len(p.pool) <= 4 and len(p.items) <= 4
    out += p.rest()
    assert sorted(x[1] for x in out) == list(range(500))
    used = {}
    for box, _, n in out:
        used[box] = used.get(box, 0) + n
    assert max(used.values()) <= 10


def test_alphabets_and_unknown_languages(spark):
    many = "".join(chr(0x4E00 + i) for i in range(300))
    m = language.Models({"zz": [many], **{k: [t * 20] for k, t in TEXTS.items()}})
    assert m.width > 300
    got = language.detect(m, [TEXTS["de"], "Qzxv jklwp bnmpt rtyyq zxcvw qwrtk plkjz hgfdx sdfgq mnbvc."])
    assert [m.langs[x] for x in got[got.doc == 0].lang] == ["de"] * 3 and set(got[got.doc == 1].lang) == {len(m.langs)}


def test_short_names(spark):
    reg = spark.createDataFrame([(1, "person", "Mina Oz"), (2, "person", "Ayla Demir"), (3, "organisation", "Alda Berk Devlet Hastanesi")], "entity_id long, entity_type string, full_name string")
    meta = [("a", {"Authors": "Mina Oz; Ayla Dmeir"}), ("b", {"Institution": "Alda Brek State Hosp."}), ("c", {"Authors": "Mina Az"})] + [(f"x{i}", {"Authors": "Ayla Demir", "Institution": "Alda Berk Devlet Hastanesi"}) for i in range(6)]
    df = spark.createDataFrame([(i, m, *NONE) for i, m in meta], "id string, metadata map<string,string>" + EXTRA)
    got = {(r.id, r.entity_id) for r in names.link_names(df, reg).collect() if r.id[0] != "x"}
    assert got == {("a", 1), ("a", 2), ("b", 3)}


def test_checkpoints_need_a_shared_folder_on_clusters():
    class Context:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context
        conf = {}

    class Frame:
        sparkSession = Session

    with pytest.raises(RuntimeError):
        K.checkpointed(Session, Frame)


def test_name_forms_are_learnt(spark):
    people = [("william", f"lastname{k}oglu") for k in range(6)] + [("robert", f"other{k}dag") for k in range(6)]
    cand = [("person", ["wilk", last], [given, last]) for given, last in people[:5]] + [("person", ["robert", last], [given, last]) for given, last in people[:3]] + [("person", ["stray", people[k][1]], list(people[k])) for k in (0, 7, 9)]
    got = {r.token: set(r.means) for r in names.name_forms(spark.createDataFrame(cand, "kind string, tokens array<string>, name array<string>")).collect()}
    assert got == {"wilk": {"william"}}
    assert names.name_forms(spark.createDataFrame([], "kind string, tokens array<string>, name array<string>")).count() == 0


def test_words_of_institutions_are_learnt(spark):
    orgs = [(k, [f"own{k}ville", "state", "clinic"] if k % 2 else [f"own{k}ville", "law", "school"]) for k in range(12)]
    typed = [("organisation", f"{n[0]} {w}", k, [n[0], *w.split()], n) for k, n in orgs for w in (("devlet klinik", "devlet cl") if k % 2 else ("hukuk okul", "hukuk school"))]
    cand = spark.createDataFrame(typed, "kind string, typed string, entity_id long, tokens array<string>, name array<string>")
    kinds = spark.createDataFrame([(k, n[1:]) for k, n in orgs], "entity_id long, of_kind array<string>")
    got = {r.token: set(r.means) for r in names.kind_forms(cand, kinds).collect()}
    assert "law" in got["hukuk"] and "state" in got["devlet"] and not got["hukuk"] & {"state", "clinic"} and not got["devlet"] & {"law", "school"}


def test_confusions_are_learnt(spark):
    told = ["garden", "market", "captain", "hammer", "paper", "tractor"]
    body = " ".join(f"They saw a {w} beside the old river yesterday." for w in told) + " "
    clean = [(f"c{i}", body * 3 + "A narrow salad was kept.") for i in range(6)]
    lines = [f"they saw a {w.replace('a', 'q', 1)} beside the old river yesterday and" for w in told] + ["nobody knew why the sqlad was warm or cold in the long"]
    df = spark.createDataFrame([(*r, *NONE) for r in [*clean, ("s", "\n".join(lines))]], "id string, content string" + EXTRA)
    got = {(r.line_no, r.repaired) for r in scans.Scans(spark, df).found().where("kind = 'ocr'").collect()}
    assert got == {(i + 1, w) for i, w in enumerate(told)} | {(7, "salad")}  # the last one has unknown neighbours


def test_misread_numbers_are_no_words(spark):
    body = "El sol brilla sobre las montañas del norte todos los días. "
    clean = [(f"c{i}", body * 6) for i in range(6)]
    page = "\n".join(["El sol brilla sobre las montañas del norte y las", "50l casas del norte brillan todos los días del sol", "sobre las montañas del norte todos los días. El"])
    df = spark.createDataFrame([(*r, *NONE) for r in [*clean, ("s", page)]], "id string, content string" + EXTRA)
    assert {(r.line_no, r.repaired) for r in scans.Scans(spark, df).found().where("kind = 'ocr'").collect()} == {(2, "501")}
