import random

from pyspark.sql import functions as F

from quarry.functions import text as T


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "x string").select(*cols).first()


def test_tokens_and_stop_words(spark):
    r = one(spark, "The p-value of İzmir's 12 kısa mg a", T.tokens(F.col("x")).alias("t"), T.without(T.tokens(F.col("x")), T.GUARD_STOP).alias("c"))
    assert r.t == ["the", "p-value", "of", "izmir", "12", "kısa", "mg"]
    assert r.c == ["p-value", "izmir", "12", "kısa", "mg"]
    assert one(spark, None, T.tokens(F.col("x")).alias("t")).t == []


def plain_stem(w):
    if len(w) <= 3:
        return w
    for s in T.SUFFIXES:
        if w.endswith(s) and len(w) - len(s) >= 3:
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith("ing") and len(w) > 5:
        return w[:-3]
    if w.endswith("ed") and len(w) > 4:
        return w[:-2]
    if w.endswith("s") and not w.endswith("ss"):
        return w[:-1]
    return w


def words(spark, small):
    rows = spark.read.parquet(f"{small}/corpus_chunks.parquet").select(F.explode(T.tokens(F.col("content"))).alias("w")).distinct()
    made = [a + b for a in ("has", "kontrol", "re", "abcd") for b in (*T.SUFFIXES, "ing", "ed", "s", "ss", "sses", "ies", "mamaktadır", "memektedir")]
    return rows.unionByName(spark.createDataFrame([(x,) for x in made], "w string")).distinct()


def test_stem_is_the_rule_applied_one_by_one(spark, small):
    rows = words(spark, small).select("w", T.stem(F.col("w")).alias("s")).collect()
    assert len(rows) > 300
    assert [(r.w, r.s) for r in rows if r.s != plain_stem(r.w)] == []


def test_keys_meet_exactly_when_stems_match(spark, small):
    rng = random.Random(1)
    stems = sorted({plain_stem(r.w) for r in words(spark, small).collect()})
    pairs = [(rng.choice(stems), rng.choice(stems)) for _ in range(3000)]
    pairs += [(s, s[:k] + x) for s in rng.sample(stems, 60) for k in (3, 4, 5) for x in ("", "x", "yz")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.arrays_overlap(T.probe_keys(F.col("a")), T.build_keys(F.col("b"))).alias("m")).collect()
    for r in got:
        n = min(5, len(r.a), len(r.b))
        assert r.m == (r.a == r.b or (n >= 4 and r.a[:n] == r.b[:n])), r


def test_sentences_lines_bigrams(spark):
    r = one(spark, "One. Two!  Three?\nend", T.sentences(F.col("x")).alias("s"), T.evidence_lines(F.col("x")).alias("l"), T.bigrams(F.split("x", " ")).alias("b"))
    assert r.s == ["One.", "Two!", "Three?", "end"]
    assert r.l == ["One", "Two!  Three?", "end"]
    assert one(spark, "a", T.bigrams(F.split("x", " ")).alias("b")).b == []
    assert one(spark, None, T.sentences(F.col("x")).alias("s")).s == []


def test_dosages(spark):
    d = lambda x: one(spark, x, T.dosages(F.col("x")).alias("d")).d
    assert d("500 mg and 500MG, 2x1") == ["500mg", "2x1"]
    assert d("5 mg/kg") == ["5mg"]
    assert d("2,5 mg; 39 gün") == ["5mg"]
    assert d(None) == []


def test_json_repair(spark):
    j = lambda x: one(spark, x, T.repaired_json(T.fenced(F.col("x"))).alias("j")).j
    assert j("{'a': 1,}") == '{"a": 1}'
    assert j('{"a":[1,2') == '{"a":[1,2]}'
    assert j('[{"a":1') == '[{"a":1]}'
    assert j("") == "{}"
    assert j("Here:\n```json\n{'Title': 'X', 'n': 100,}\n```") == '{"Title":"X","n": 100}'


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    r = df.select(T.cosine(F.col("a"), F.col("b")).alias("ab"), T.cosine(F.col("a"), F.col("z")).alias("az"), T.cosine(F.col("a"), F.col("s")).alias("s"), T.euclidean(F.col("a"), F.col("b")).alias("e")).first()
    assert (r.ab, r.az, r.s, r.e) == (1.0, None, None, 1.0)
