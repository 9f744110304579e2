"""Secret scans through a trigram index, with DataFrame functions alone.

Each rule's regex is turned, on the driver, into a Boolean query over the trigrams that any match must
contain (case folded). Postings (trigram, document) are made for those trigrams only; grouping them
by document intersects them and evaluates the queries. Only ids are shuffled: the candidates of each rule come back to
the texts as bits of a hashed set of bounded size, and rules are then run on their candidates' whole texts. Documents that
share a bit are verified in vain, never missed. A rule that no trigram is mandatory for has no query and scans every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``measured`` group has ``min_length`` characters.

    ``precheck``, if given, is a cheaper regex found in every text with a match that counts.
    """

    kind: str
    regex: str
    measured: int
    min_length: int
    precheck: str | None = None


RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
]
#: Literal strings that a regex part may stand for before its trigrams are taken.
MAX_STRINGS = 64

Query = tuple | str | bool


def _both(kind: str, parts: list[Query]) -> Query:
    """``and``/``or`` of queries, True being no condition."""
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, *parts)


def _of_string(s: str) -> Query:
    return _both("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else True


def _sequence(items) -> tuple[set[str] | None, Query]:
    """Strings that the items spell exactly (None: too many or unknown) and the query of their matches."""
    strings: set[str] = {""}
    whole, clauses = True, []

    def flush() -> None:
        clauses.append(_both("or", [_of_string(s) for s in sorted(strings)]))

    for op, arg in items:
        exact, query = _item(op, arg)
        if exact is not None and len(strings) * len(exact) <= MAX_STRINGS:
            strings = {a + b for a in strings for b in exact}
        else:
            flush()
            clauses.append(query if exact is None else _both("or", [_of_string(s) for s in sorted(exact)]))
            strings, whole = {""}, False
    flush()
    return (strings if whole else None), _both("and", clauses)


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg) and len(arg) <= 4:
        return {chr(c).lower() for _, c in arg}, True
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
        return exact, _both("or", [p[1] if p[0] is None else _both("or", [_of_string(s) for s in sorted(p[0])]) for p in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body)
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, True
        return None, True if low == 0 else query if exact is None else _both("or", [_of_string(s) for s in sorted(exact)])
    if op is sre.AT:
        return {""}, True
    return None, True


def trigram_query(regex: str) -> Query:
    """Boolean query over lower-case trigrams that every text with a match satisfies; True: no condition."""
    exact, query = _sequence(sre_parser.parse(regex))
    return _both("or", [_of_string(s) for s in sorted(exact)]) if exact is not None else query


def trigrams_of(query: Query) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else sorted({t for part in query[1:] for t in trigrams_of(part)})


def _holds(query: Query, has: dict[str, Column]) -> Column:
    if isinstance(query, str):
        return has[query]
    out = _holds(query[1], has)
    for part in query[2:]:
        out = (out & _holds(part, has)) if query[0] == "and" else (out | _holds(part, has))
    return out


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(trigram, id)`` for those of the trigrams that a row's lower-cased text holds."""
    low = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(held).alias("trigram"), "id")


def candidates(docs: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """One row per id that some query holds for: ``id`` and a boolean column for each rule."""
    names = sorted({t for q in queries.values() for t in trigrams_of(q)})
    has = {t: F.col(f"t{i}") for i, t in enumerate(names)}
    met = postings(docs, names).groupBy("id").agg(*[F.bool_or(F.col("trigram") == t).alias(f"t{i}") for i, t in enumerate(names)])
    flags = met.select("id", *[_holds(q, has).alias(kind) for kind, q in queries.items()])
    return flags.where(" or ".join(f"`{k}`" for k in queries))


#: Words of 64 bits in the hashed set of candidates, at most; each is a row that is broadcast.
SET_WORDS = 1 << 18


def candidate_bits(chosen: DataFrame, kinds: list[str], words: int) -> DataFrame:
    """``(slot, a word for each of kinds)``: bit ``hash(id)`` is set for the ids that are candidates; ``words`` rows at most."""
    slot, bit = _slot(F.col("id"), words)
    marked = chosen.select(slot.alias("slot"), bit.alias("bit"), *kinds)
    return marked.groupBy("slot").agg(*[F.bit_or(F.when(F.col(k), F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))).alias(k) for k in kinds])


def _slot(id_col: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(5), id_col)
    return F.pmod(F.shiftright(h, 6), F.lit(words)), h.bitwiseAND(63).cast("int")


#: Lengths that are summed in one step when matches are placed.
STEP = 64


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """Array of (start, kind, end) of the rule's matches in code points.

    The matches and what lies between them alternate, so a start is a sum of lengths before it, taken as
    sums of whole steps and of the rest of one, which keeps texts with very many matches cheap.
    """
    regex = F.lit(rule.regex)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    found = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"), F.regexp_extract_all(text, regex, F.lit(rule.measured)).alias("part")
    )
    sized = lambda rows: F.transform(
        F.slice(rows, 1, F.size(rows) - 1),
        lambda r: F.struct(F.length(r["gap"]).cast("long").alias("gap"), F.length(r["hit"]).cast("long").alias("hit"), F.length(r["part"]).alias("part")),
    )

    def placed(rows: Column) -> Column:
        lengths = F.transform(rows, lambda r: r["gap"] + r["hit"])
        steps = lambda ls: F.transform(F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / STEP).cast("int")), lambda s: total(F.slice(ls, s * STEP + 1, STEP)))

        def spans(both: Column) -> Column:
            def one(r: Column, i: Column) -> Column:
                at = F.floor(i / STEP).cast("int")
                start = total(F.slice(both["steps"], F.lit(1), at)) + total(F.slice(both["lengths"], at * STEP + 1, i - at * STEP)) + r["gap"]
                return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + r["hit"]).alias("end"), r["part"].alias("part"))

            return F.transform(both["rows"], one)

        return _bind(lengths, lambda ls: _bind(F.struct(rows.alias("rows"), ls.alias("lengths"), steps(ls).alias("steps")), spans))

    every = _bind(found, lambda z: _bind(sized(z), lambda rows: F.when(F.size(rows) > 0, placed(rows))))
    long = F.filter(every, lambda s: s["part"] >= rule.min_length)
    return F.transform(long, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", set_words: int = SET_WORDS) -> DataFrame:
    """``(id_col, spans)`` for every row of ``docs``.

    ``spans`` is an array of ``(start, kind, end)``, by start, then rule: code points, end exclusive,
    ``kind`` the place of the rule in ``rules``. Per rule the leftmost non-overlapping matches are taken, then those
    whose measured group is too short dropped. Null texts have no spans; rows with a null id are scanned like
    others, as a group; repeated rows each give a row.
    """
    rules = RULES if rules is None else rules
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) is not True}
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    held, slot = slim, _slot(F.col("id"), set_words)
    if queries:
        bits = candidate_bits(candidates(slim, queries), list(queries), set_words)
        held = slim.withColumn("slot", slot[0]).join(F.broadcast(bits), "slot", "left")
    parts = []
    for k, rule in enumerate(rules):
        worth = F.coalesce(F.getbit(F.col(rule.kind), slot[1]) == 1, F.lit(False)) if rule.kind in queries else F.lit(True)
        worth = worth & F.col("text").rlike(rule.precheck or rule.regex)
        parts.append(F.when(worth, F.coalesce(_spans(F.col("text"), rule, k), none)).otherwise(none))
    return held.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))
