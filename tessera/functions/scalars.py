"""Scalar functions of the engine as Column expressions; all stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First words that make a question type.
INTERROGATIVES = ("what", "who", "when", "where", "why", "how", "which")
#: Property names that mean personal data.
PII_WORDS = ("name", "email", "phone", "address", "ssn", "birth")


def clamp01(x: Column) -> Column:
    """Undefined and infinite values become 0, others are clipped to [0, 1]."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def text_value(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    """Without the white space of any script at both ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def nonempty(x: Column) -> Column:
    return F.length(strip(text_value(x))) > 0


def words(x: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text_value(x)), F.lit(r"(?U)\w+"), F.lit(0))


def bind(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(x), use), 0)


def bigrams(tokens: Column) -> Column:
    """Pairs of neighbouring tokens, in order."""
    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))

    return bind(tokens, pairs)


def bigram_overlap(a: Column, b: Column) -> Column:
    """Share of the first text's different bigrams that the second has; 0 if it has none."""
    share = lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, bigrams(words(b)))) / F.size(x))
    return bind(F.array_distinct(bigrams(words(a))), share)


def tokenize_label(x: Column) -> Column:
    """Lower-case parts of a label, cut at case changes and at what is neither letter nor digit."""
    spaced = F.regexp_replace(F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(spaced), " "), lambda t: F.length(t) > 0)


def lexical_score(a: Column, b: Column) -> Column:
    """1 for labels of equal parts; else half the Jaccard share of the parts and half the edit similarity of their joined forms."""
    x, y = tokenize_label(a), tokenize_label(b)
    p, q = F.array_join(x, " "), F.array_join(y, " ")
    union = F.size(F.array_union(x, y))
    jaccard = F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / union)
    longest = F.greatest(F.length(p), F.length(q))
    near = F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(p, q) / longest)
    return F.when(p == q, F.lit(1.0)).otherwise(0.5 * jaccard + 0.5 * near)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot / size)


def embedding_score(a: Column, b: Column) -> Column:
    """Cosine moved to [0, 1]; 0 where one has no length."""
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when((size(a) == 0) | (size(b) == 0), F.lit(0.0)).otherwise((cosine(a, b) + 1) / 2)


def predicate_for_score(score: Column) -> Column:
    return F.when(score >= 0.95, "exactMatch").when(score >= 0.8, "closeMatch").otherwise("relatedMatch")


def question_type(x: Column) -> Column:
    """The first run of letters if it is an interrogative, else ``other``."""
    first = F.regexp_extract(F.lower(text_value(x)), r"[a-z]+", 0)
    return F.when(first.isin(*INTERROGATIVES), first).otherwise("other")


def strip_json_fence(x: Column) -> Column:
    """What stands inside a fenced block, or the text itself."""
    inner = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(x.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(inner)).otherwise(strip(x))


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_")


def local_name(x: Column) -> Column:
    """A name for use at the end of an IRI: letters, digits, underscore and hyphen."""
    return F.regexp_replace(x, r"[^A-Za-z0-9_-]", "_")


def cypher_escape(x: Column) -> Column:
    out = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for raw, named in (("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return out


def coerce_datatype(x: Column, datatype: str) -> Column:
    """The value as text after a cast to the datatype; as it was where the cast fails."""
    kind = {"integer": "bigint", "float": "double", "boolean": "boolean"}.get(datatype)
    return x if kind is None else F.coalesce(x.try_cast(kind).cast("string"), x)


def is_pii(name: str, flagged: bool = False) -> bool:
    return flagged or any(w in name.lower() for w in PII_WORDS)


def rel_phrase(x: Column) -> Column:
    """An edge type as words: ``WORKS_AT`` becomes ``works at``."""
    return F.lower(F.replace(x, F.lit("_"), F.lit(" ")))


def difficulty(hops: Column) -> Column:
    return F.when(hops <= 2, "easy").when(hops == 3, "medium").otherwise("hard")


def mask_words(x: Column, rate: float, draw) -> Column:
    """Each space-separated word becomes ``[MASK]`` where ``draw(i)`` is below the rate; null becomes empty."""
    return F.array_join(F.transform(F.split(text_value(x), " "), lambda w, i: F.when(draw(i) < rate, "[MASK]").otherwise(w)), " ")


def char_typos(x: Column, rate: Column | float, draw, kind, letter) -> Column:
    """Each character, where ``draw(i)`` is below the rate, is left out, preceded by a letter, or replaced by it, by thirds of ``kind(i)``."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    chars = F.filter(F.split(text_value(x), ""), lambda c: F.length(c) > 0)

    def one(c: Column, i: Column) -> Column:
        a = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), 1, 26)
        new = F.substr(a, F.floor(letter(i) * 26).cast("int") + 1, F.lit(1))
        return F.when(draw(i) >= rate, c).when(kind(i) < 1 / 3, "").when(kind(i) < 2 / 3, F.concat(new, c)).otherwise(new)

    return F.array_join(F.transform(chars, one), "")


def datatype_ok(kind: str, value: Column) -> Column:
    """Whether a JSON value (variant) has a property datatype; a boolean is no integer, dates are strings, unknown datatypes pass."""
    found = F.schema_of_variant(value)
    want = {"string": found == "STRING", "integer": found == "BIGINT", "float": found.isin("BIGINT", "DOUBLE") | found.startswith("DECIMAL"), "boolean": found == "BOOLEAN", "datetime": found == "STRING"}
    return want.get(kind, F.lit(True))


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
