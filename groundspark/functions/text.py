"""Text scalars as Column expressions: tokenizers, sentence rules, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, sentence rules and word lists that results depend on.
WORD = r"\b[a-zA-Z0-9_\-\.]+\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
CHUNK_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9])"
CLAIM_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9\-\*•])"
PLAIN_SENTENCE = r"(?<=[.!?])\s+"
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "if", "because", "as", "what",
    "which", "this", "that", "these", "those", "then", "just", "so", "than",
    "such", "both", "through", "about", "for", "is", "of", "while", "during",
    "to", "from", "in", "out", "on", "off", "again", "further", "once",
]
NEGATIONS = ["not", "never", "no", "cannot", "neither", "nor", "fails", "without"]
NEGATED = r"\b(not|never|cannot|no longer|fails to)\b"
CLAIM_PREFIXES = [
    r"^here\s+is\s+.*?:",
    r"^in\s+summary.*?:",
    r"^based\s+on\s+the\s+provided\s+context.*?:",
    r"^in\s+conclusion.*?:",
    r"^to\s+answer\s+your\s+question.*?:",
]
COMPARISON = r"\b(vs|versus|compared\s+to|difference\s+between|compare)\b"
MULTI_HOP = r"\b(how\s+does|why\s+does|prevent|avoid|lead\s+to|cause|rely\s+on)\b"
ARCHITECTURE = r"\b(architecture|overview|design|components|structure|layers)\b"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, even inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uni(pattern: str) -> str:
    """``pattern`` with the white space, digits and boundaries of all scripts, as the surveyed service has them; ``\\s`` may not be in brackets."""
    return "(?U)" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(uni(pattern)), F.lit(group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, uni(r"^\s+|\s+$"), "")


def ascii_only(text: Column) -> Column:
    """Every character beyond ASCII becomes a space, so that word boundaries agree between engines."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def word_count(text: Column) -> Column:
    clean = strip(text)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, uni(r"\s+"))))


def token_estimate(text: Column) -> Column:
    """Larger of white-space words and a quarter of the characters."""
    return F.greatest(word_count(text), F.floor(F.length(text) / 4).cast("int"))


def sentences(text: Column, rule: str = CHUNK_SENTENCE) -> Column:
    return F.filter(F.transform(F.split(text, uni(rule)), strip), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    return matches(F.lower(text), WORD)


def content_tokens(text: Column) -> Column:
    """Set of tokens of three characters or more."""
    return F.array_distinct(F.filter(word_tokens(text), lambda t: F.length(t) > 2))


def stem(word: Column) -> Column:
    out = F.when(word.endswith("ing") & (F.length(word) > 5), F.substring(word, F.lit(1), F.length(word) - 3))
    for suffix in ("ed", "es", "s"):
        n = len(suffix)
        out = out.when(word.endswith(suffix) & (F.length(word) > n + 2), F.substring(word, F.lit(1), F.length(word) - n))
    return out.otherwise(word)


def stem_tokens(text: Column) -> Column:
    """Set of stems of words longer than two characters that negate nothing."""
    words = matches(F.lower(F.regexp_replace(text, "[-_]", " ")), WORD)
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(NEGATIONS)), stem))


def numbers(text: Column) -> Column:
    return F.array_distinct(matches(text, NUMBER))


def canonicalize(name: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(name, "[-_]", " "), r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]", "")
    return F.regexp_replace(F.lower(strip(kept)), uni(r"\s+"), "_")


def title_case(text: Column) -> Column:
    """First letter of every run of letters in capitals, the rest small."""
    return F.array_join(F.transform(F.split(text, r"(?<![\p{L}])(?=\p{L})"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def claims(text: Column, min_words: int = 4, strict: bool = False) -> Column:
    """Declarative statements of an answer, in order.

    The bullet rule takes one character (a digit included) off a line's and then a sentence's start, as the surveyed
    service does; ``strict`` takes whole bullets only.
    """
    bullet = uni(r"^\s*(?:[-*•]|\d+\.)\s+" if strict else r"^\s*[-*•\d+\.]\s*")
    lines = F.split(F.regexp_replace(text, uni(r"\s+[-*•]\s+"), "\n"), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")

    def clean(line: Column) -> Column:
        out = F.regexp_replace(strip(F.regexp_replace(strip(line), bullet, "")), "[*_`]", "")
        for prefix in CLAIM_PREFIXES:
            out = strip(F.regexp_replace(out, uni(f"(?i){prefix}"), ""))
        return F.split(out, uni(CLAIM_SENTENCE))

    parts = F.flatten(F.transform(F.filter(F.transform(lines, strip), lambda x: x != ""), clean))
    parts = F.transform(parts, lambda s: F.regexp_replace(strip(F.regexp_replace(s, bullet, "")), "[.,;:]+$", ""))
    return F.filter(parts, lambda s: (s != "") & ~s.endswith("?") & (word_count(s) >= min_words))


def strategy(query: Column) -> Column:
    q = strip(query)
    rule = lambda p: q.rlike(uni(f"(?i){p}"))
    return F.when(rule(COMPARISON), "comparison").when(rule(MULTI_HOP), "multi_hop").when(rule(ARCHITECTURE), "architecture").otherwise("factual")


def subqueries(query: Column) -> Column:
    """Parts of a comparison, delimiters included, of more than three characters; else the query itself."""
    q = strip(query)
    gaps, marks = F.split(q, uni(f"(?i){COMPARISON}")), matches(q, f"(?i){COMPARISON}", 1)
    mixed = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), marks.alias("m")), lambda z: F.array(z["g"], z["m"])))
    parts = F.filter(F.transform(F.filter(mixed, lambda x: x.isNotNull()), strip), lambda x: F.length(x) > 3)
    return F.when((strategy(query) == "comparison") & (F.size(parts) > 0), parts).otherwise(F.array(q))
