"""Documents to sections to chunks, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.functions.text import bind, sentences, strip, token_estimate, uni, word_count

_STACK = "array<struct<level: int, title: string>>"
_CRUMBS = "array<array<string>>"
#: Headings whose breadcrumbs are gathered in one array before the next is begun, so that no array is copied for every heading of a text.
BLOCK = 64


def _breadcrumbs(headings: Column) -> Column:
    """For each heading the titles above it and its own, outermost first."""

    def push(st: Column, h: Column) -> Column:
        above = F.filter(st["stack"], lambda x: x["level"] < h["level"])
        stack = F.concat(above, F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        return bind(stack, lambda s: F.struct(s.alias("stack"), F.concat(st["out"], F.array(F.transform(s, lambda x: x["title"]))).alias("out")))

    def step(st: Column, block: Column) -> Column:
        opened = F.struct(st["stack"].alias("stack"), F.expr(f"cast(array() as {_CRUMBS})").alias("out"))
        return bind(F.aggregate(block, opened, push), lambda x: F.struct(x["stack"].alias("stack"), F.concat(st["out"], F.array(x["out"])).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(headings) / BLOCK).cast("int") - 1), lambda b: F.slice(headings, b * BLOCK + 1, BLOCK))
    start = F.expr(f"cast(struct(array(), array()) as struct<stack: {_STACK}, out: array<{_CRUMBS}>>)")
    made = F.aggregate(blocks, start, step, lambda st: F.flatten(st["out"]))
    return F.when(F.size(headings) > 0, made).otherwise(F.expr(f"cast(array() as {_CRUMBS})"))


def section_array(content: Column) -> Column:
    """Sections of Markdown text as an array of (text, breadcrumbs); null text has none.

    Headings are located first, and each section's text is one slice of the lines between two of them.
    """
    heading = uni(r"^(#{1,6})\s+(.+)$")

    def cut_up(lines: Column) -> Column:
        marked = F.transform(
            lines,
            lambda x, i: F.struct(
                i.alias("at"), F.length(F.regexp_extract(strip(x), heading, 1)).alias("level"), strip(F.regexp_extract(strip(x), heading, 2)).alias("title")
            ),
        )
        return bind(F.filter(marked, lambda h: h["level"] > 0), lambda headings: bind(_breadcrumbs(headings), lambda crumbs: texts(lines, headings, crumbs)))

    def texts(lines: Column, headings: Column, crumbs: Column) -> Column:
        def one(k: Column) -> Column:
            first = F.when(k == 0, 0).otherwise(F.get(headings, k - 1)["at"] + 1)
            stop = F.when(k == F.size(headings), F.size(lines)).otherwise(F.get(headings, k)["at"])
            text = strip(F.array_join(F.slice(lines, first + 1, stop - first), "\n"))
            return F.struct(text.alias("text"), F.when(k == 0, F.expr("cast(array() as array<string>)")).otherwise(F.get(crumbs, k - 1)).alias("crumbs"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(headings)), one), lambda s: s["text"] != "")

    found = bind(F.split(content, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), cut_up)
    fallback = F.array(F.struct(strip(content).alias("text"), F.array(F.lit("Document Root")).alias("crumbs")))
    made = bind(found, lambda s: F.when((F.size(s) == 0) & (strip(content) != ""), fallback).otherwise(s))
    return F.when(content.isNotNull(), made)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, section_index, text, breadcrumbs)``."""
    return docs.select(id_col, F.posexplode(section_array(F.col(text_col))).alias("section_index", "s")).select(
        id_col, "section_index", F.col("s.text").alias("text"), F.col("s.crumbs").alias("breadcrumbs")
    )


def chunk_ranges(sizes: Column, cfg: Config) -> Column:
    """Greedy chunks over sentence sizes: array of (first, last, tokens), 1-based, with carried tails."""
    ranges = "array<struct<first: int, last: int, tokens: int>>"

    def fold(n: Column) -> Column:
        def step(st: Column, j: Column) -> Column:
            own = F.element_at(n, j)
            tail = F.aggregate(
                F.reverse(F.slice(n, st["first"], j - st["first"])),
                F.struct(F.lit(0).alias("k"), F.lit(0).alias("sum"), F.lit(True).alias("go")),
                lambda a, x: F.when(a["go"] & (a["sum"] + x <= cfg.chunk_overlap), F.struct((a["k"] + 1).alias("k"), (a["sum"] + x).alias("sum"), F.lit(True).alias("go"))).otherwise(
                    F.struct(a["k"].alias("k"), a["sum"].alias("sum"), F.lit(False).alias("go"))
                ),
            )
            done = F.array(F.struct(st["first"].alias("first"), (j - 1).alias("last"), st["size"].alias("tokens")))
            flushed = bind(tail, lambda t: F.struct((j - t["k"]).alias("first"), (t["sum"] + own).alias("size"), F.concat(st["out"], done).alias("out")))
            grown = F.struct(st["first"].alias("first"), (st["size"] + own).alias("size"), st["out"].alias("out"))
            return F.when((st["size"] + own > cfg.chunk_target) & (st["size"] >= cfg.chunk_min), flushed).otherwise(grown)

        start = F.expr(f"cast(struct(1, 0, array()) as struct<first: int, size: int, out: {ranges}>)")
        last = lambda st: F.concat(st["out"], F.array(F.struct(st["first"].alias("first"), F.size(n).alias("last"), st["size"].alias("tokens"))))
        return F.when(F.size(n) > 0, F.aggregate(F.sequence(F.lit(1), F.size(n)), start, step, last)).otherwise(F.expr(f"cast(array() as {ranges})"))

    return bind(sizes, fold)


def chunks(parts: DataFrame, cfg: Config = Config(), id_col: str = "doc_id") -> DataFrame:
    """Chunks of sections: ``(id_col, chunk_index, chunk_id, content, token_count, breadcrumbs)``.

    ``parts`` has ``section_index``, ``text`` and ``breadcrumbs``. A chunk never spans sections; the last chunk of a
    section needs four words; ``chunk_index`` counts over the whole document.
    """
    cut = parts.withColumn("sents", sentences(F.col("text"))).withColumn("sizes", F.transform("sents", token_estimate))
    ranged = cut.select(id_col, "section_index", "breadcrumbs", "sents", F.posexplode(chunk_ranges(F.col("sizes"), cfg)).alias("k", "r"))
    content = F.array_join(F.slice("sents", F.col("r.first"), F.col("r.last") - F.col("r.first") + 1), " ")
    made = ranged.withColumn("content", content).where((F.col("r.last") < F.size("sents")) | (word_count(F.col("content")) >= 4))
    order = Window.partitionBy(id_col).orderBy("section_index", "k")
    return made.select(id_col, (F.row_number().over(order) - 1).alias("chunk_index"), "content", F.col("r.tokens").alias("token_count"), "breadcrumbs").select(
        id_col, "chunk_index", F.concat_ws("#", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"), "content", "token_count", "breadcrumbs"
    )
