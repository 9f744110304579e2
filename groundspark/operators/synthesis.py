"""Deterministic answers: graph facts, salient sentences, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.functions.text import PLAIN_SENTENCE, matches, strip, title_case, uni

# Texts of prompts and answers.
PROMPT_QUERY, PROMPT_CONTEXT = "User Query: ", "\n\n=== VERIFIED SOURCE CONTEXT ==="
PROMPT_RELATIONS, PROMPT_EXCERPTS = "\n[Knowledge Graph Relationships]:", "\n[Document Excerpts]:"
PROMPT_INSTRUCTIONS = (
    "\n\n=== INSTRUCTIONS ===\nSynthesize a clear, direct, and factual answer based ONLY on the evidence above. "
    "Organize your thoughts into distinct declarative statements so they can be verified."
)
FACT_START, FACT_JOINT, FACT_END = "According to the knowledge graph, ", ", while ", "."
EXCERPT_SOURCE, EXCERPT_SECTION, EXCERPT_END, EXCERPT_ROOT = "\n[Source #", " | Section: ", "]:\n", "Root"
NOTHING_BEFORE, NOTHING_AFTER = "No verified information regarding '", "' was found in the indexed corpus. Please ingest relevant documents to query this topic."

_WORDS = r"(?U)\b\w+\b"
_FOLD = "struct<kept: array<string>, context: int, stopped: boolean>"


def _spaced(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def graph_fact_sentence(edges: DataFrame, order_col: str, k: int = 5, id_col: str = "query_id") -> DataFrame:
    """``(id_col, fact)``: the first ``k`` edges as one sentence."""
    part = F.concat_ws(" ", title_case(_spaced(F.col("source_id"))), F.lower(_spaced(F.col("relation"))), title_case(_spaced(F.col("target_id"))))
    parts = edges.groupBy(id_col).agg(F.slice(F.array_sort(F.collect_list(F.struct(order_col, part.alias("s")))), 1, k).alias("p"))
    return parts.select(id_col, F.concat(F.lit(FACT_START), F.array_join(F.transform("p", lambda x: x["s"]), FACT_JOINT), F.lit(FACT_END)).alias("fact"))


def salient(query: Column, contexts: Column, facts: Column, k_contexts: int = 3, enough: int = 5) -> Column:
    """Statements of an answer: ``facts`` first, then sentences of the first contexts (array of strings, in rank order).

    A sentence of 25 characters or more, not met before, is taken if it shares a word of over two letters with the
    query or there are under three statements. At ``enough`` the context at hand ends, but later contexts
    still add one each.
    """
    asked = F.array_distinct(F.filter(matches(F.lower(query), _WORDS), lambda w: F.length(w) > 2))
    flat = F.flatten(
        F.transform(F.slice(contexts, 1, k_contexts), lambda c, i: F.transform(F.split(c, uni(PLAIN_SENTENCE)), lambda s: F.struct(i.alias("context"), strip(s).alias("s"))))
    )

    def step(st: Column, x: Column) -> Column:
        stopped = st["stopped"] & (st["context"] == x["context"])
        fits = (F.length(x["s"]) >= 25) & ~F.array_contains(st["kept"], x["s"])
        near = F.arrays_overlap(asked, matches(F.lower(x["s"]), _WORDS))
        take = ~stopped & fits & (near | (F.size(st["kept"]) < 3))
        kept = F.when(take, F.concat(st["kept"], F.array(x["s"]))).otherwise(st["kept"])
        return F.struct(kept.alias("kept"), x["context"].alias("context"), (stopped | (take & (F.size(st["kept"]) + 1 >= enough))).alias("stopped"))

    start = F.struct(facts.alias("kept"), F.lit(-1).alias("context"), F.lit(False).alias("stopped")).cast(_FOLD)
    return F.aggregate(flat, start, step, lambda st: st["kept"])


def synthesize(queries: DataFrame, contexts: DataFrame, facts: DataFrame | None = None, id_col: str = "query_id") -> DataFrame:
    """``(id_col, query, answer)``; ``contexts`` has ``rank`` and ``content``, ``facts`` has ``fact``."""
    ranked = contexts.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    joined = queries.join(ranked, id_col, "left")
    joined = joined.join(facts, id_col, "left") if facts is not None else joined.withColumn("fact", F.lit(None).cast("string"))
    first = F.when(F.col("fact").isNotNull(), F.array("fact")).otherwise(F.expr("cast(array() as array<string>)"))
    found = salient(F.col("query"), F.col("contexts"), first)
    fallback = F.concat(strip(F.substring(F.element_at("contexts", 1), 1, 400)), F.lit("..."))
    nothing = F.concat(F.lit(NOTHING_BEFORE), "query", F.lit(NOTHING_AFTER))
    made = joined.withColumn("_s", F.when(F.col("contexts").isNotNull(), found))
    answer = F.when(F.col("contexts").isNull(), nothing).when(F.size("_s") == 0, fallback).otherwise(F.array_join("_s", " "))
    return made.select(id_col, "query", answer.alias("answer"))


def context_prompt(queries: DataFrame, contexts: DataFrame, edges: DataFrame | None = None, id_col: str = "query_id", max_edges: int = 12) -> DataFrame:
    """``(id_col, prompt)`` for a remote model: query, relations, numbered excerpts, instructions."""
    crumbs = F.when(F.size("breadcrumbs") > 0, F.array_join("breadcrumbs", " > ")).otherwise(EXCERPT_ROOT)
    excerpt = contexts.select(id_col, "rank", F.concat(F.lit(EXCERPT_SOURCE), F.col("rank").cast("string"), F.lit(": "), "title", F.lit(EXCERPT_SECTION), crumbs, F.lit(EXCERPT_END), strip(F.col("content"))).alias("s"))
    parts = excerpt.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]).alias("excerpts"))
    joined = queries.join(parts, id_col, "left")
    none = F.expr("cast(array() as array<string>)")
    if edges is None:
        joined = joined.withColumn("relations", none)
    else:
        one = F.concat(F.lit("• ("), "source_id", F.lit(") -["), "relation", F.lit("]-> ("), "target_id", F.lit(")"))
        lines = edges.groupBy(id_col).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("triple_id", one.alias("s")))), 1, max_edges), lambda x: x["s"]).alias("relations"))
        joined = joined.join(lines, id_col, "left")
    head = F.array(F.concat(F.lit(PROMPT_QUERY), "query", F.lit(PROMPT_CONTEXT)))
    listed = lambda c, title: F.when(F.size(F.coalesce(c, none)) > 0, F.concat(F.array(F.lit(title)), F.col(c))).otherwise(none)
    body = F.concat(head, listed("relations", PROMPT_RELATIONS), listed("excerpts", PROMPT_EXCERPTS), F.array(F.lit(PROMPT_INSTRUCTIONS)))
    return joined.select(id_col, F.array_join(body, "\n").alias("prompt"))

