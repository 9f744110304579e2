"""Façade over the operators: ingest, answer, inspect, delete."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.functions.providers import Embedder, Generator, PdfPages, guarded
from groundspark.functions.text import canonicalize, strategy, subqueries
from groundspark.operators import graph, retrieval, synthesis, verification
from groundspark.operators.chunking import chunks as make_chunks
from groundspark.operators.embedding import LOCAL, embed, embed_once
from groundspark.operators.lexical_index import IndexSearch, build_postings, in_term_order, number_texts
from groundspark.operators.vectors import dense_topk_in_space
from groundspark.runtime import cut
from groundspark.sources.files import dedupe, parse, registry
from groundspark.sources.store import Conflict, State, Store

#: Attempts at a change while other writers commit first.
COMMIT_TRIES = 8


class Engine:
    """All state is in the store; every method returns a DataFrame and takes batches of rows."""

    def __init__(self, spark: SparkSession, root: str, cfg: Config = Config(), embedder: Embedder | None = None, generator: Generator | None = None, pdf_pages: PdfPages | None = None, space: str = "remote") -> None:
        self.spark, self.cfg, self.store = spark, cfg, Store(spark, root)
        #: Providers for remote embedding and generation (``mapInPandas`` functions); both default to the deterministic ones.
        self.embedder, self.generator, self.pdf_pages = embedder, generator, pdf_pages
        #: Name of the vector space that queries and chunks are embedded in; a model of another kind needs another name.
        self.space = LOCAL if embedder is None else space

    def ingest(self, files: DataFrame, done: tuple[str, int] | None = None) -> DataFrame:
        """Ingest ``(path, content, title)``; returns the new registry rows. Known contents are skipped.

        Files that cannot be read are not registered, so a later ingest takes them; until then they are in ``quarantine()``. ``done``, a
        writer's name and the number of its batch, is settled by the same commit: when the batch is given again, nothing happens. If another writer
        commits first, all is done again on what the store then holds.
        """
        for _ in range(COMMIT_TRIES):
            state = self.store.state()
            if self.store.settled(state, done):
                return self.store.read("documents", state, [])
            try:
                return self._ingest(files, state, done)
            except Conflict:
                continue
        raise Conflict("other writers kept coming first")

    def _ingest(self, files: DataFrame, state: State, done: tuple[str, int] | None) -> DataFrame:
        given = files.select("path", "content", "title")
        parts, bad = parse(given, self.pdf_pages)
        bad = cut(bad.distinct())
        new = cut(dedupe(registry(given.where("content is not null").join(bad, "path", "left_anti")), self.store.read("documents", state)))
        made = make_chunks(parts.join(new.select("doc_id"), "doc_id", "left_semi"), self.cfg)
        titled = cut(made.join(new.select("doc_id", "title"), "doc_id").select("chunk_id", "doc_id", "title", "chunk_index", "content", "token_count", "breadcrumbs"))
        counts = titled.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("chunk_count"))
        rows = new.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))
        tables = {} if new.isEmpty() else {"documents": rows} | self._derived(titled, state.version + 1)
        held = self.store.read("quarantine", state)
        waiting = held.join(given.select("path").distinct(), "path", "left_anti").unionByName(bad)
        single = {} if bad.isEmpty() and held.isEmpty() else {"quarantine": waiting}
        if tables or single or done is not None:
            self.store.compact(self.store.publish(state, titled.count(), done, single, **tables))
        return rows

    def _derived(self, titled: DataFrame, number: int) -> dict[str, DataFrame]:
        """Chunks and all that is made from them, for a batch with a number of its own."""
        vectors = self._vectors(titled)
        mentions = cut(graph.entity_candidates(titled))
        numbered = cut(number_texts(titled.select("chunk_id", retrieval.lexical_text().alias("text")), number))
        triples = graph.relation_triples(titled, mentions)
        return {"chunks": titled, "vectors": vectors, "mentions": mentions, "entities": graph.entity_counts(mentions), "triples": triples, "numbers": numbered, "postings": in_term_order(build_postings(numbered), 1 + titled.count() // 100_000)}

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        """``(chunk_id, embedding, space, text_key)``. A provider is asked only for texts that no stored vector of its space has."""
        texts = chunks.select("chunk_id", F.concat_ws(": ", "title", "content").alias("text"))
        if self.embedder is None:
            return embed(texts, self.cfg.embedding_dim, "chunk_id", space=LOCAL).withColumn("text_key", F.lit(None).cast("string"))
        return embed_once(texts, self.store.read("vectors"), self.cfg.embedding_dim, "chunk_id", self.embedder, self.space)

    def refresh_vectors(self) -> int:
        """Embed chunks again whose vectors are of another space than the engine's, for instance local stand-ins of an outage; returns how many are left."""
        for name in list(self.store.state().batches):
            for _ in range(COMMIT_TRIES):
                state = self.store.state()
                if name not in state.batches or self.store.read("vectors", state, [name]).where(F.col("space") != self.space).isEmpty():
                    break
                try:
                    self.store.replace(state, name, vectors=self._vectors(self.store.read("chunks", state, [name])))
                    break
                except Conflict:
                    continue
        return self.store.read("vectors").where(F.col("space") != self.space).count()

    def dense_topk(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, chunk_id, score, rank)`` among the stored vectors of each question's own space."""
        asked = embed(queries.select("query_id", F.col("query").alias("text")), self.cfg.embedding_dim, "query_id", provider=self.embedder, space=self.space)
        return dense_topk_in_space(self.store.read("vectors"), cut(asked), k, (self.space, LOCAL))

    def documents(self) -> DataFrame:
        return self.store.read("documents")

    def quarantine(self) -> DataFrame:
        """``(path, reason)`` of files that no ingest could read yet."""
        return self.store.read("quarantine")

    def chunks(self, doc_id: str) -> DataFrame:
        return self.store.read("chunks").where(F.col("doc_id") == doc_id).orderBy("chunk_index")

    def delete_document(self, doc_id: str) -> bool:
        """Delete a document and all that came from it by one small commit; False if there is none."""
        for _ in range(COMMIT_TRIES):
            state = self.store.state()
            batch = self.store.batch_of(doc_id, state)
            if batch is None:
                return False
            try:
                self.store.compact(self.store.commit(state, gone=[[batch, doc_id]]))
                return True
            except Conflict:
                continue
        raise Conflict("other writers kept coming first")

    def lexical_topk(self, queries: DataFrame, k: int) -> DataFrame:
        """``(query_id, chunk_id, score, rank)`` from the stored index, whose statistics are those of the live chunks."""
        state = self.store.state()
        numbers = self.store.read("numbers", state)
        worn = [name for name, b in state.batches.items() if b.gone]
        dead = cut(self.store.read("numbers", state, worn, gone=True).join(numbers, "number", "left_anti").select("number")) if worn else None
        return IndexSearch(self.store.read("postings", state), numbers, queries, k, self.cfg, dead).topk()

    def _graph(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        state = self.store.state()
        mentions, triples = self.store.read("mentions", state), self.store.read("triples", state)
        try:
            nodes, edges, scores = graph.search(queries, mentions, triples, self.cfg, self.store.entities(state))
            return nodes, edges, cut(scores)
        except Exception as error:
            logging.getLogger(__name__).warning("graph channel failed: %s", error)
            none = graph.search(queries.limit(0), mentions.limit(0), triples.limit(0), self.cfg)
            return none

    def retrieve(self, queries: DataFrame, top_k: int | None = None, channels: tuple[str, ...] = retrieval.CHANNELS) -> tuple[DataFrame, DataFrame]:
        """Contexts ``(query_id, rank, chunk_id, title, content, ...)`` and subgraph edges of ``queries (query_id, query)``.

        A channel that fails counts as one that finds nothing, with a warning in the log; so does a failing graph, which has no edges then.
        """
        _, edges, scores = self._graph(queries)
        stored = {"lexical": lambda q, k: self.lexical_topk(q, k), "nearest": lambda q, k: self.dense_topk(q, k)}
        found = retrieval.hybrid_search(self.store.read("chunks"), queries, self.cfg, scores, top_k, channels=channels, guard=True, **stored)
        # Answers, prompts and checks all start from these few rows a query, so they are made once.
        return cut(found), edges

    def answer(self, queries: DataFrame, top_k: int | None = None, enable_graph: bool = True, channels: tuple[str, ...] = retrieval.CHANNELS) -> DataFrame:
        """One row a query: strategy, attributed response, faithfulness, relevance, contexts, claims and cited sources.

        ``enable_graph=False`` leaves the subgraph out of the answer only; ``channels`` says which rankings take part.
        """
        contexts, edges = self.retrieve(queries, top_k, channels)
        return self._answer(queries, contexts, edges, enable_graph)

    def _answer(self, queries: DataFrame, contexts: DataFrame, edges: DataFrame, enable_graph: bool) -> DataFrame:
        facts = synthesis.graph_fact_sentence(edges, "triple_id") if enable_graph else None
        answers = synthesis.synthesize(queries, contexts, facts)
        if self.generator is not None:
            # Queries that the generator fails on, or leaves out, keep the deterministic answer.
            prompts = synthesis.context_prompt(queries, contexts, edges if enable_graph else None)
            generator = self.generator
            nothing = lambda batch: batch[["query_id"]].assign(said=None)
            id_type = queries.schema["query_id"].dataType.simpleString()
            ask = guarded(lambda batches: (b.rename(columns={"answer": "said"}) for b in generator(batches)), nothing, ["query_id", "prompt"])
            answers = answers.join(prompts.mapInPandas(ask, f"query_id {id_type}, said string"), "query_id", "left").withColumn("answer", F.coalesce("said", "answer")).drop("said")
        answers, verified = self._verify(answers, contexts)
        listed = verified.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim_ord", "claim", "status", "confidence", "cited_chunk_id", "reasoning", "citation_badge"))).alias("claims"))
        records = verification.source_records(verification.citation_numbers(verified), contexts)
        cited = records.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("number", "cited_chunk_id", "document_title", "breadcrumbs", "excerpt"))).alias("sources"))
        shown = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "title", "score"))).alias("chunks"))
        return (
            queries.select("query_id", "query", strategy(F.col("query")).alias("strategy"), subqueries(F.col("query")).alias("subqueries"))
            .join(verification.attributed_answer(answers, verified), "query_id")
            .join(verification.faithfulness(answers, verified).drop("n_claims"), "query_id")
            .join(verification.relevance(answers, self.cfg, provider=self.embedder), "query_id")
            .join(shown, "query_id", "left")
            .join(listed, "query_id", "left")
            .join(cited, "query_id", "left")
            .join(answers.select("query_id", "answer"), "query_id")
        )

    def _verify(self, answers: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Answers and the status of their claims, each made once."""
        answers = cut(answers)
        claim_rows = verification.claim_table(answers, cfg=self.cfg)
        aligned = cut(verification.align(claim_rows, contexts, self.cfg, provider=self.embedder))
        return answers, cut(verification.explained(verification.claim_status(claim_rows, aligned, self.cfg), aligned, contexts))

    def answer_events(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """``(query_id, seq, event, data)``: routing, subgraph, sources, tokens, verification, done."""
        contexts, edges = self.retrieve(queries, top_k)
        full = self._answer(queries, contexts, edges, True)
        drawn = edges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("triple_id", "source_id", "relation", "target_id"))).alias("edges"))
        rows = full.join(drawn, "query_id", "left")
        events = F.concat(
            F.array(
                F.struct(F.lit("routing").alias("event"), F.to_json(F.struct("strategy", "subqueries")).alias("data")),
                F.struct(F.lit("subgraph").alias("event"), F.to_json(F.struct("edges")).alias("data")),
                F.struct(F.lit("sources").alias("event"), F.to_json(F.struct("chunks")).alias("data")),
            ),
            F.transform(F.split("answer", " "), lambda t: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(t.alias("text"))).alias("data"))),
            F.array(
                F.struct(F.lit("verification").alias("event"), F.to_json(F.struct("claims", "faithfulness")).alias("data")),
                F.struct(F.lit("done").alias("event"), F.to_json(F.struct("query_id")).alias("data")),
            ),
        )
        return rows.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.event", "e.data")

    def _entities(self) -> DataFrame:
        """``(canonical_id, name, entity_type)`` of all entities and ends of triples."""
        state = self.store.state()
        return graph.add_endpoints(self.store.entities(state), self.store.read("triples", state))

    def _nodes(self) -> DataFrame:
        return self._entities().select(F.col("canonical_id").alias("node"))

    def graph_stats(self, top_k: int = 10) -> DataFrame:
        """One row: counts, density, components and the most central entities ``(canonical_id, name, type, score)``, best first."""
        best = graph.central(self._entities(), self.store.read("triples"), top_k)
        listed = F.array_sort(F.collect_list(F.struct("place", "canonical_id", "name", "type", "score")))
        central = best.agg(F.transform(listed, lambda x: x.dropFields("place")).alias("central_entities"))
        return graph.graph_stats(self._nodes(), self.store.read("triples")).join(central)

    def central_entities(self, top_k: int = 8) -> DataFrame:
        """``(canonical_id, name, type, score)`` by PageRank, best first, ties to the smaller id."""
        return graph.central(self._entities(), self.store.read("triples"), top_k).orderBy("place").drop("place")

    def subgraph(self, max_nodes: int = 35) -> tuple[DataFrame, DataFrame]:
        """Nodes ``(query_id, node, depth, is_seed, degree, name, type, chunk_ids)`` and edges around the eight most central entities; without such, around the first five."""
        entities, triples = self._entities(), self.store.read("triples")
        central = self.central_entities(8).select("canonical_id")
        if central.isEmpty():
            central = entities.select("canonical_id").orderBy("canonical_id").limit(5)
        seeds = central.select(F.lit(0).alias("query_id"), F.col("canonical_id").alias("node"))
        nodes = graph.k_hop_nodes(seeds, triples, 2, max(5, min(100, max_nodes)))
        edges = graph.induced_edges(nodes, triples)
        return graph.described(graph.subgraph_degrees(nodes, edges), entities, self.store.read("mentions")), edges

    def path(self, source: str, target: str, canonical: bool = True) -> DataFrame:
        """Steps between two entities; without a path no rows."""
        pair = self.spark.createDataFrame([(source, target)], "source string, target string")
        if canonical:
            pair = pair.select(canonicalize(F.col("source")).alias("source"), canonicalize(F.col("target")).alias("target"))
        triples = self.store.read("triples")
        steps = graph.label_paths(graph.shortest_paths(pair, triples), triples)
        return graph.named_steps(steps, self._entities())

    def health(self) -> DataFrame:
        """One row ``(status, documents, entities, triples)``; an empty store has zeros."""
        docs = self.documents().agg(F.count(F.lit(1)).alias("documents"))
        nodes = self._nodes().agg(F.countDistinct("node").alias("entities"))
        edges = self.store.read("triples").agg(F.count(F.lit(1)).alias("triples"))
        return docs.join(nodes).join(edges).select(F.lit("healthy").alias("status"), "documents", "entities", "triples")

    def evaluate(self, samples: DataFrame) -> DataFrame:
        """Raw metrics of ``samples (query_id, query, truth array<string>)`` by arm: dense only, dense then BM25, full.

        ``latency_ms`` is the time that the arm took for all queries together, over their number.
        """
        queries = cut(samples.select("query_id", "query"))
        n = max(1, queries.count())
        arms = {"naive": (("dense",), 3), "hybrid": (("dense", "bm25"), 5), "full": (retrieval.CHANNELS, 5)}
        parts = None
        for arm, (channels, k) in arms.items():
            began = time.perf_counter()
            measured = cut(self._measured(queries, arm, channels, k))
            took = F.lit((time.perf_counter() - began) * 1000 / n)
            one = measured.join(samples.select("query_id", "truth"), "query_id").select(
                F.lit(arm).alias("arm"), "query_id", "faithfulness", "relevance", entity_recall(F.col("truth"), F.col("answer")).alias("entity_recall"), took.alias("latency_ms")
            )
            parts = one if parts is None else parts.unionByName(one)
        return parts

    def benchmark(self, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Means of the arms with their latency, and the full arm's gains over the naive one."""
        summary = cut(benchmark_summary(self.evaluate(samples)))
        return summary, gains(summary)

    def _measured(self, queries: DataFrame, arm: str, channels: tuple[str, ...], k: int) -> DataFrame:
        """``(query_id, answer, faithfulness, relevance)`` of an arm."""
        if arm == "full":
            return self.answer(queries).select("query_id", "answer", "faithfulness", "relevance")
        contexts = self._arm(queries, channels, k)
        answers, verified = self._verify(synthesis.synthesize(queries, contexts), contexts)
        scored = answers.join(verification.faithfulness(answers, verified).drop("n_claims"), "query_id")
        return scored.join(verification.relevance(answers, self.cfg, provider=self.embedder), "query_id").select("query_id", "answer", "faithfulness", "relevance")

    def _arm(self, queries: DataFrame, channels: tuple[str, ...], k: int) -> DataFrame:
        """First ``k`` distinct chunks of the channels in turn, each channel's best ``k`` in order."""
        ranked = self.dense_topk(queries, k).select("query_id", "chunk_id", F.col("rank").alias("o"))
        if "bm25" in channels:
            ranked = ranked.unionByName(self.lexical_topk(queries, k).select("query_id", "chunk_id", (F.col("rank") + k).alias("o")))
        first = ranked.groupBy("query_id", "chunk_id").agg(F.min("o").alias("o"))
        order = Window.partitionBy("query_id").orderBy("o")
        return cut(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(self.store.read("chunks"), "chunk_id"))


def entity_recall(truth, answer):
    """Share of ground-truth ids whose spaced form is in the lower-cased answer; without any 0."""
    held = F.size(F.filter(truth, lambda t: F.contains(F.lower(answer), F.replace(t, F.lit("_"), F.lit(" ")))))
    return F.when(F.size(truth) > 0, held / F.size(truth)).otherwise(0.0)


def benchmark_summary(measured: DataFrame) -> DataFrame:
    """Mean of each metric by arm, to three places, and of the latency in whole milliseconds where it was measured."""
    timed = [F.avg("latency_ms").cast("int").alias("avg_latency_ms")] if "latency_ms" in measured.columns else []
    return measured.groupBy("arm").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("faithfulness", "relevance", "entity_recall")], *timed)


def gains(summary: DataFrame, base: str = "naive", arm: str = "full") -> DataFrame:
    """One row: gains in per cent, to one place, of ``arm`` over ``base`` in faithfulness and entity recall (a base under 0.01 counts as 0.01)."""
    of = lambda name, c: F.max(F.when(F.col("arm") == name, F.col(c)))
    gain = lambda c: F.round((of(arm, c) - of(base, c)) / F.greatest(of(base, c), F.lit(0.01)) * 100, 1).alias(f"{c}_gain_percent")
    return summary.agg(gain("faithfulness"), gain("entity_recall"))
