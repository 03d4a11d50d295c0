"""Text scalars as column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character: letters, combining marks, digits, connecting punctuation.
WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
TOKEN = rf"{WORD}[{WORD}-]*{WORD}"  # one class, not a group: a loop without steps back
LINE_ENDS = r"[\n.•\-]"

# Stop words of the rerank, grounding and triad steps.
ENGLISH = "the is at which on a an and or in with to for of as by that this it from be are was were been has have had".split()
QUESTION = "how what where when why who does do did".split()
TURKISH = (
    "bu bir ve ile için olan olarak veya ya da de ki ancak fakat ise gibi göre kadar çok daha en her tüm bazı mı mi "
    "mu mü var yok hakkında başka durum olduğu olduğunu yani tarafından"
).split()
RERANK_STOP = [*ENGLISH, *QUESTION]
GUARD_STOP = [*ENGLISH, *TURKISH]
TRIAD_STOP = [*GUARD_STOP, "belirten", "belirtmektedir", "belirtmemektedir"]

# Turkish suffixes in the order in which they are tried.
SUFFIXES = (
    "lerinin larının lerinden larından lerindeki larındaki mektedir maktadır memektedir mamaktadır kontrendikedir kontrendike "
    "leri ları inde ında kten ktan nden ndan den dan ten tan dir dır dur dür tir tır tur tür miş mış muş müş nin nın nun nün "
    "siz sız suz süz lik lık luk lük ler lar de da te ta ye ya le la in ın un ün si sı su sü yi yı yu yü li lı lu lü ci cı cu cü ce ca"
).split()

# A dosage, and abbreviations before a full stop that ends no sentence.
DOSAGE = r"(?iU)\b\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|cc|gr|mg\/kg|IU|iu|x\d+|tab|tablet|kapsül)\b"
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"


def lowered(text: Column) -> Column:
    """Lower case; dotted capital I becomes i in one character."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def squeezed(text: Column) -> Column:
    """Trimmed of all white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Words of at least two characters, hyphens inside allowed; none for null."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def without(words: Column, stop: list[str]) -> Column:
    """The words that are no stop words, repeats kept."""
    listed = F.array(*[F.lit(s) for s in stop])
    return F.filter(words, lambda x: ~F.array_contains(listed, x))


def _longest_first() -> str:
    """One pattern for the suffixes, by first letter. Of two that fit, the one tried first is the longer, but for two that a shorter one precedes and hides."""
    by: dict[str, list[str]] = {}
    for i, x in enumerate(SUFFIXES):
        if not any(x.endswith(y) for y in SUFFIXES[:i]):
            by.setdefault(x[0], []).append(x[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


# The shortest stem of three or more characters that a suffix follows.
_CUT = f"^(.{{3,}}?)(?:{_longest_first()})$"


def stem(word: Column) -> Column:
    """Light stem: the first Turkish suffix that leaves three characters, then English endings; short words stay."""
    w = F.regexp_replace(F.regexp_replace(word, _CUT, "$1"), "ies$", "y")
    return F.when(F.length(word) <= 3, word).otherwise(F.regexp_replace(w, "^(?:(.*ss)es|(.{3,})ing|(.{3,})ed|(.*[^s])s)$", "$1$2$3$4"))


def stems(words: Column) -> Column:
    return F.transform(words, stem)


def build_keys(s: Column) -> Column:
    """Keys of a stem on the searched side; see probe_keys."""
    n = F.length(s)
    return F.when(n >= 5, F.array(F.concat(F.lit("S:"), s), F.concat(F.lit("5:"), F.substring(s, 1, 5)), F.concat(F.lit("4:"), F.substring(s, 1, 4)))).when(n == 4, F.array(F.concat(F.lit("S:"), s), F.concat(F.lit("4:"), s), F.concat(F.lit("4x:"), s))).otherwise(F.array(F.concat(F.lit("S:"), s)))


def probe_keys(s: Column) -> Column:
    """Keys of a stem on the asking side. Two stems match (equal, or equal first min(length, 5) of at least 4 characters) when a key is shared."""
    n = F.length(s)
    return F.when(n >= 5, F.array(F.concat(F.lit("S:"), s), F.concat(F.lit("5:"), F.substring(s, 1, 5)), F.concat(F.lit("4x:"), F.substring(s, 1, 4)))).when(n == 4, F.array(F.concat(F.lit("S:"), s), F.concat(F.lit("4:"), s))).otherwise(F.array(F.concat(F.lit("S:"), s)))


def sentences(text: Column) -> Column:
    """Pieces between end marks followed by white space, trimmed, no blank ones; none for null."""
    return F.coalesce(F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), squeezed), lambda x: x != ""), F.array().cast("array<string>"))


def evidence_lines(text: Column) -> Column:
    """Pieces between line feeds, full stops, bullets and hyphens, trimmed, no empty ones."""
    return F.filter(F.transform(F.split(text, LINE_ENDS), squeezed), lambda x: x != "")


def tokens_and_ends(text: Column) -> Column:
    """The words of tokens() and, between them, the ends of evidence lines that stand outside words, in order."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(f"{TOKEN}|{LINE_ENDS}"), F.lit(0)), F.array().cast("array<string>"))


def bigrams(stemmed: Column) -> Column:
    """Neighbouring pairs, repeats kept; none below two words."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(stemmed) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(stemmed, i), F.try_element_at(stemmed, i + 1)))
    return F.when(F.size(stemmed) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def conversational(sentence: Column, content: Column) -> Column:
    """A question or very short remark that needs no evidence."""
    return (F.size(content) <= 2) & (sentence.endswith("?") | (F.length(sentence) < 35))


def dosages(text: Column) -> Column:
    """Distinct dosages, lower case without white space, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(DOSAGE), F.lit(0))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.lower(x), r"\s+", "")))


def fenced(text: Column) -> Column:
    """Body of the first code fence, else the trimmed text."""
    body = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", squeezed(body)).otherwise(squeezed(text))


def json_fields(text: Column) -> Column:
    """Values of the outermost JSON object by name in lower case; null where the text is no JSON object. Trailing commas and comments are no fault."""
    return F.transform_keys(F.from_json(F.regexp_replace(text, r",\s*(\]|\})", "$1"), "map<string,variant>", {"allowSingleQuotes": "false", "allowComments": "true"}), lambda k, _: F.lower(k))


def typed_json(raw: Column, fields: dict[str, str]) -> Column:
    """code (null, EmptyOutput, NullParsedObject or SchemaViolation) and value: an object with these fields (name -> SQL type), parsed as it is or, failing that, after repair.

    A field that is missing is null; one of another kind violates the schema.
    """
    kinds = {"string": "STRING", "bigint": "BIGINT", "double": "DOUBLE|DECIMAL.*|BIGINT", "boolean": "BOOLEAN"}
    clean = fenced(raw)

    def read(text: Column) -> tuple[Column, Column]:
        m = json_fields(text)
        wrong, parts = m.isNull(), []
        for name, kind in fields.items():
            x = F.try_element_at(m, F.lit(name.lower()))
            of = F.schema_of_variant(x)
            fits = of.rlike(f"^({kinds.get(kind, 'ARRAY.*')}|VOID)$")
            wrong = wrong | (x.isNotNull() & ~fits)
            parts.append(F.try_variant_get(x, "$", kind).alias(name))
        return F.coalesce(wrong, F.lit(True)), F.struct(*parts)

    wrong_as_is, as_is = read(clean)
    wrong_again, again = read(repaired_json(clean))
    blank = F.coalesce(squeezed(raw), F.lit("")) == ""
    code = F.when(blank, "EmptyOutput").when(squeezed(clean) == "null", "NullParsedObject").when(wrong_as_is & wrong_again, "SchemaViolation")
    return F.struct(code.alias("code"), F.when(code.isNull(), F.when(wrong_as_is, again).otherwise(as_is)).alias("value"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else: it stays one when it stands in a list and in an object."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.coalesce(F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull() & held.isNotNull(), F.lit(False))


def raw_json_code(raw: Column) -> Column:
    """null where the text, out of its code fence, is JSON as it stands (never repaired), else EmptyOutput or InvalidJson."""
    return F.when(F.coalesce(squeezed(raw), F.lit("")) == "", "EmptyOutput").when(~is_json(fenced(raw)), "InvalidJson")


def repaired_json(text: Column) -> Column:
    """Single quotes to double ones, trailing commas dropped, missing brackets and then braces appended."""
    t = F.regexp_replace(squeezed(text), r"(?<=[\{\[,:])\s*'([^']*)'\s*(?=[\}\],:])", '"$1"')
    t = F.regexp_replace(t, r",\s*(\]|\})", "$1")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    missing = lambda a, b: F.greatest(count(a) - count(b), F.lit(0)).cast("int")
    return F.when(squeezed(text) == "", F.lit("{}")).otherwise(F.concat(t, F.repeat(F.lit("]"), missing("[", "]")), F.repeat(F.lit("}"), missing("{", "}"))))


def base_name(chunk_or_page: Column) -> Column:
    """Name of the document without chunk and page suffixes."""
    return F.regexp_replace(F.regexp_replace(chunk_or_page, r"_c\d+$", ""), r"#Sayfa_\d+$", "")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null for a zero vector or different lengths."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v))
