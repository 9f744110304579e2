"""Operators on inline fixtures, the engine end to end, and incremental ingest."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.engine import Engine, benchmark_summary
from groundspark.functions import text as T
from groundspark.operators import graph, retrieval, synthesis, vectors, verification
from groundspark.operators.chunking import chunk_ranges, chunks, sections
from groundspark.operators.components import connected_components
from groundspark.operators.embedding import embed
from groundspark.operators.lexical import bm25_topk
from groundspark.sources.files import dedupe, parse, pdf_sections, registry, texts_as_files
from groundspark.streaming.ingest import file_stream, ingest_stream

NOTES = """# Consensus
Raft is a protocol. Raft prevents Split Brain by majority quorum.

## Roles
The Leader replicates log entries to every Follower. A `Candidate Node` requires votes from peers.

# Security
Access uses mTLS in 3 layers. Zero Trust enforces identity checks for every request that arrives.
"""


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_sections_keep_heading_stack(spark):
    docs = spark.createDataFrame([(1, NOTES), (2, "plain"), (3, "# only\n## heads"), (4, ""), (5, None), (6, "pre\n### deep\n```\n# code\n```\n## up\nx")], "doc_id long, text string")
    rows = {}
    for r in sections(docs).orderBy("doc_id", "section_index").collect():
        rows.setdefault(r["doc_id"], []).append((r["breadcrumbs"], r["text"].split("\n")[0]))
    assert [c for c, _ in rows[1]] == [["Consensus"], ["Consensus", "Roles"], ["Security"]]
    assert rows[2] == [([], "plain")] and rows[3] == [(["Document Root"], "# only")]
    assert [c for c, _ in rows[6]] == [[], ["deep"], ["code"], ["code", "up"]]
    assert 4 not in rows and 5 not in rows


def test_chunk_ranges_equal_a_plain_fold(spark):
    rng, cases = random.Random(1), []
    for k in range(200):
        cases.append((k, [rng.randint(1, rng.choice([5, 40])) for _ in range(rng.randint(0, 30))]))
    for cfg in (Config(chunk_target=50, chunk_overlap=15, chunk_min=5), Config(chunk_target=15, chunk_overlap=8, chunk_min=3), Config(chunk_target=8, chunk_overlap=20, chunk_min=1)):
        df = spark.createDataFrame(cases, "k int, n array<int>").select("k", chunk_ranges(F.col("n"), cfg).alias("r"))
        for k, found in ((r["k"], [tuple(x) for x in r["r"]]) for r in df.collect()):
            n, want, cur, size = cases[k][1], [], [], 0
            for j, x in enumerate(n, start=1):
                if size + x > cfg.chunk_target and size >= cfg.chunk_min:
                    want.append((cur[0], cur[-1], size))
                    tail, total = [], 0
                    for i in reversed(cur):
                        if total + n[i - 1] > cfg.chunk_overlap:
                            break
                        tail.insert(0, i)
                        total += n[i - 1]
                    cur, size = tail, total
                cur.append(j)
                size += x
            assert found == want + ([(cur[0], cur[-1], size)] if cur else [])


def test_chunks_count_over_sections(spark):
    text = "# A\n" + " ".join(f"Sentence number {i} has seven words here." for i in range(20)) + "\n# B\nToo short.\n# C\nThis one has four words."
    made = chunks(sections(spark.createDataFrame([("d", text)], "doc_id string, text string")), Config(chunk_target=30, chunk_overlap=10, chunk_min=5)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in made] == list(range(len(made))) and made[0]["chunk_id"] == "d#0"
    assert made[-1]["breadcrumbs"] == ["C"] and not any(r["breadcrumbs"] == ["B"] for r in made)
    assert made[0]["content"].startswith("Sentence number 0") and any("number 19" in r["content"] for r in made)


def test_text_scalars(spark):
    assert one(spark, T.stem_tokens, "Running tested boxes cats, is not a high-speed as") == ["runn", "test", "box", "cat", "high", "spe"]
    assert one(spark, T.numbers, "3 nodes, 4.5 and 3 x12") == ["3", "4.5"]
    assert one(spark, T.canonicalize, " Multi-Paxos (v2)_log ") == "multi_paxos_v2_log"
    assert one(spark, T.strategy, "Raft vs Paxos") == "comparison" and one(spark, T.strategy, "how does it prevent loss?") == "multi_hop"
    assert one(spark, T.strategy, "Layers overview") == "architecture" and one(spark, T.strategy, "what is raft") == "factual"
    assert one(spark, T.subqueries, "Compare Raft versus Paxos") == ["Compare", "Raft", "versus", "Paxos"]
    assert one(spark, T.subqueries, " plain ") == ["plain"]
    assert one(spark, T.token_estimate, "a b c") == 3 and one(spark, T.token_estimate, "") == 0 and one(spark, T.token_estimate, "x" * 41) == 10
    assert one(spark, T.title_case, "split-brain o'neil x2y") == "split-brain o'neil x2y".title()


def test_claims(spark):
    raw = "Here is the answer: - Raft elects one leader per term. - **Paxos** is older than that one! Is it true for all of them?\n150ms is the usual timeout value; Short one."
    assert one(spark, T.claims, raw) == ["Raft elects one leader per term", "Paxos is older than that one!", "0ms is the usual timeout value; Short one"]
    assert one(spark, lambda c: T.claims(c, strict=True), raw)[-1].startswith("150ms")
    assert one(spark, T.claims, "") == []


def test_hash_embedding_equals_plain_python(spark):
    import hashlib
    import math

    texts = [(0, "The raft leader and the follower of raft_log a-b"), (1, ""), (2, "the of"), (3, "x")]
    dim = 64

    def plain(text):
        v = [0.0] * dim
        ws = re.findall(T.WORD, text.lower())
        add = lambda f, s, w: v.__setitem__(h % dim, v[h % dim] + (w if h >> 31 & 1 else -w)) if (h := int(hashlib.md5(f"{f}:{s}".encode()).hexdigest(), 16)) is not None else None
        for i, w in enumerate(ws):
            stop = w in T.STOP_WORDS
            add(w, 1, (0.2 if stop else 1.0) * (1 + 1 / (i + 1)))
            for n in (3, 4) if len(w) >= 3 and not stop else ():
                for k in range(len(w) - n + 1):
                    add(w[k : k + n], n, 0.35)
            if i + 1 < len(ws) and not (stop and ws[i + 1] in T.STOP_WORDS):
                add(f"{w}_{ws[i + 1]}", 7, 0.75)
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm > 1e-9 else [dim**-0.5] * dim

    made = {r["id"]: r["embedding"] for r in embed(spark.createDataFrame(texts, "id int, text string"), dim).collect()}
    for i, t in texts:
        assert made[i] == pytest.approx(plain(t), abs=1e-9)


def test_embedding_provider_and_dimension(spark):
    def provider(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(embedding=[[1.0, 0.0]] * len(pdf))

    texts = spark.createDataFrame([(1, "a")], "id int, text string")
    assert embed(texts, 2, provider=provider).first()["embedding"] == [1.0, 0.0]
    with pytest.raises(Exception, match="embedding length"):
        embed(texts, 3, provider=provider).collect()


def test_bm25_and_dense_find_the_chunk(spark):
    rows = [("c1", "Raft is a consensus algorithm with a leader election"), ("c2", "mTLS gives zero-trust service identity"), ("c3", "zzz")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "zero-trust mTLS"), (2, "leader"), (3, "??"), (4, "unknownword")], "query_id long, query string")
    top = {(r["query_id"], r["rank"]): r["chunk_id"] for r in bm25_topk(df, asked, 2).collect()}
    assert top == {(1, 1): "c2", (2, 1): "c1"}
    vec = embed(df, 128, "chunk_id")
    q = embed(asked.select("query_id", F.col("query").alias("text")), 128, "query_id")
    best = {r["query_id"]: r["chunk_id"] for r in vectors.dense_topk(vec, q, 1).collect()}
    assert best[1] == "c2" and best[2] == "c1"
    assert bm25_topk(df.limit(0), asked, 2).count() == 0
    only = vectors.dense_topk(vec, q, 5, where=F.col("chunk_id") != "c2")
    assert only.where("query_id = 1").count() == 2 and only.where("chunk_id = 'c2'").count() == 0


def test_upsert_last_wins(spark):
    store = spark.createDataFrame([("a", [1.0], 0), ("b", [2.0], 0)], "id string, v array<double>, o int")
    new = spark.createDataFrame([("b", [3.0], 1), ("b", [4.0], 2), ("c", [5.0], 1)], store.schema)
    assert [r["v"] for r in vectors.get(store, new, "id").collect()] == [[2.0]]
    assert sorted((r["id"], r["v"][0]) for r in vectors.upsert(store, new, "id", "o").collect()) == [("a", 1.0), ("b", 4.0), ("c", 5.0)]


def test_fusion(spark):
    ranks = [(1, "dense", "c1", 1), (1, "dense", "c2", 2), (1, "bm25", "c2", 1), (1, "bm25", "c3", 2), (1, "graph", "c2", 1)]
    fused = {r["chunk_id"]: r for r in retrieval.rrf_fuse(spark.createDataFrame(ranks, "query_id long, modality string, chunk_id string, rank int"), Config(graph_weight=1.0)).collect()}
    assert fused["c2"]["rrf_score"] == pytest.approx(1 / 62 + 2 / 61) and fused["c1"]["rrf_score"] == pytest.approx(1 / 61)
    assert (fused["c2"]["dense_rank"], fused["c2"]["bm25_rank"], fused["c2"]["graph_rank"]) == (2, 1, 1) and fused["c3"]["dense_rank"] is None


def test_rerank_prefers_crumbs_and_words(spark):
    schema = "query_id long, query string, chunk_id string, content string, breadcrumbs array<string>, rrf_score double, dense_rank int, bm25_rank int, graph_rank int"
    rows = [(1, "raft leader election", "a", "nothing here", ["Other"], 0.02, 1, None, None), (1, "raft leader election", "b", "raft leader election steps", ["Raft", "Leader"], 0.018, 2, 1, None), (2, "a", "a", "x", [], 0.1, 1, None, None)]
    out = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.rerank(spark.createDataFrame(rows, schema), 5).collect()}
    assert out[1, 1][0] == "b" and out[1, 1][1] == pytest.approx(0.18 + 0.4 + 0.3 + 0.25)
    assert out[2, 1] == ("a", 0.1)


TRIPLES = "triple_id string, source_id string, source_name string, target_id string, target_name string, relation string, weight double, chunk_id string"


def test_graph_operators(spark):
    chunk = spark.createDataFrame([("c1", "Raft prevents Split-Brain in clusters. The Leader replicates entries to the Follower."), ("c2", "`zk` is used by Kafka")], "chunk_id string, content string")
    mentions = graph.entity_candidates(chunk)
    ids = {r["canonical_id"]: r["entity_type"] for r in mentions.collect()}
    assert ids["raft"] == "ALGORITHM" and ids["split_brain"] == "VULNERABILITY" and ids["leader"] == "ROLE" and ids["zk"] == "CONCEPT"
    made = {(r["source_id"], r["relation"], r["target_id"]) for r in graph.relation_triples(chunk, mentions).collect()}
    assert ("raft", "PREVENTS", "split_brain") in made and any(r == "REPLICATES_TO" and t == "follower" for _, r, t in made)
    rows = [("t1", "raft", "Raft", "split_brain", "Split Brain", "PREVENTS", 1.0, "c1"), ("t2", "raft", "Raft", "leader", "Leader", "ELECTS", 1.0, "c1"), ("t3", "x", "X", "y", "Y", "IS_A", 1.0, None)]
    triples = spark.createDataFrame(rows, TRIPLES)
    seeds = spark.createDataFrame([(1, "raft")], "query_id long, node string")
    nodes = graph.k_hop_nodes(seeds, triples, 1)
    edges = graph.induced_edges(nodes, triples)
    assert nodes.count() == 3 and edges.count() == 2
    assert {r["node"]: r["degree"] for r in graph.subgraph_degrees(nodes, edges).collect()} == {"raft": 2, "split_brain": 1, "leader": 1}
    assert graph.k_hop_nodes(spark.createDataFrame([(1, "raft"), (1, "x"), (1, "y")], seeds.schema), triples, 2, 2).count() == 3
    pairs = spark.createDataFrame([("leader", "Split_Brain"), ("raft", "raft"), ("raft", "x"), ("nope", "raft")], "source string, target string")
    found = {(r["source"], r["target"]): r for r in graph.shortest_paths(pairs, triples).collect()}
    assert found["leader", "split_brain"]["path"] == ["leader", "raft", "split_brain"] and found["raft", "raft"]["hops"] == 0 and len(found) == 2
    steps = graph.label_paths(graph.shortest_paths(pairs, triples), triples).orderBy("hop").collect()
    assert [r["relation"] for r in steps] == ["ELECTS", "PREVENTS"]
    everyone = spark.createDataFrame([(x,) for x in ("raft", "split_brain", "leader", "x", "y", "alone")], "node string")
    ranks = {r["node"]: r["score"] for r in graph.pagerank(everyone, triples).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-4) and ranks["split_brain"] > ranks["raft"]
    assert graph.graph_stats(everyone, triples).first().asDict() == {"n_nodes": 6, "n_edges": 3, "density": 0.1, "n_components": 3}
    scores = graph.graph_chunk_scores(nodes, edges, spark.createDataFrame([("raft", "c1"), ("leader", "c9")], "canonical_id string, chunk_id string")).collect()
    assert {r["chunk_id"]: r["score"] for r in scores} == {"c1": 5.0, "c9": 1.0}


def test_seed_match(spark):
    entities = spark.createDataFrame([("split_brain", "Split Brain"), ("raft", "Raft"), ("ab", "Ab"), ("leader_node", "The Leader")], "canonical_id string, name string")
    asked = spark.createDataFrame([(1, "about split brain?"), (2, "raft?"), (3, "what of leader things"), (4, "leader_node cabin"), (5, "")], "query_id long, query string")
    found = {(r["query_id"], r["canonical_id"]) for r in graph.seed_match(asked, entities).collect()}
    assert found == {(1, "split_brain"), (1, "ab"), (2, "raft"), (3, "leader_node"), (4, "leader_node"), (4, "ab")}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(60)] + [(5, 5), (300, 300), (None, 1)]
    parent = list(range(400))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in edges:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    touched = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert out == {x: root(x) for x in touched}


def test_verification(spark):
    cfg = Config(embedding_dim=64)
    answers = spark.createDataFrame([(1, "Raft elects a single leader in each term. Raft never elects a single leader in each term. Bananas grow in warm tropical places."), (2, "Fine.")], "query_id long, answer string")
    contexts = spark.createDataFrame([(1, 1, "c0", "Other words entirely different."), (1, 2, "c1", "Raft elects a single leader in each term")], "query_id long, rank int, chunk_id string, content string")
    claims = verification.claim_table(answers)
    out = verification.claim_status(claims, verification.align(claims, contexts, cfg), cfg)
    rows = {r["claim_ord"]: r for r in out.collect()}
    assert rows[0]["status"] == "ENTAILED" and rows[0]["cited_chunk_id"] == "c1" and rows[0]["confidence"] == 0.99
    assert rows[1]["status"] == "CONTRADICTION" and rows[1]["confidence"] == 0.88
    assert rows[2]["status"] == "NEUTRAL"
    assert {r["query_id"]: r["faithfulness"] for r in verification.faithfulness(answers, out).collect()} == {1: 0.333, 2: 1.0}
    text = {r["query_id"]: r["response"] for r in verification.attributed_answer(answers, out).collect()}
    assert text[1].startswith("Raft elects a single leader in each term [1] ✓ Raft never") and text[2] == ""
    source = verification.source_records(verification.citation_numbers(out), contexts.where("false").withColumn("title", F.lit("t")).withColumn("breadcrumbs", F.array(F.lit("b")))).first()
    assert source["document_title"] == "Unknown Document"
    numbers = spark.createDataFrame([(1, "The cluster timeout value is 150 seconds", "The cluster timeout value is 300 seconds")], "i int, a string, b string")
    stems = F.size(F.array_intersect(T.stem_tokens(F.col("a")), T.stem_tokens(F.col("b"))))
    assert numbers.select(verification.contradicts(F.col("a"), T.numbers(F.col("b")), stems).alias("x")).first()["x"]


def plain_salient(query, contexts, facts):
    out, seen = list(facts), set()
    asked = {w.lower() for w in re.findall(r"\b\w+\b", query) if len(w) > 2}
    for c in contexts[:3]:
        for s in map(str.strip, re.split(r"(?<=[.!?])\s+", c)):
            if len(s) < 25 or s in seen:
                continue
            if asked & {w.lower() for w in re.findall(r"\b\w+\b", s)} or len(out) < 3:
                seen.add(s)
                out.append(s)
                if len(out) >= 5:
                    break
    return out


def test_salient_sentences_equal_a_plain_fold(spark):
    rng, words = random.Random(3), ["raft", "leader", "Élan", "quorum", "the", "of", "many", "words", "node"]
    rows = []
    for k in range(80):
        contexts = [". ".join(" ".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(rng.randint(0, 8))) + "." for _ in range(rng.randint(0, 5))]
        rows.append((k, " ".join(rng.choices(words, k=3)), contexts, ["fact"] if k % 2 else []))
    df = spark.createDataFrame(rows, "k int, q string, c array<string>, f array<string>")
    for r in df.select("k", synthesis.salient(F.col("q"), F.col("c"), F.col("f")).alias("s")).collect():
        assert r["s"] == plain_salient(*rows[r["k"]][1:])


def test_sources(spark):
    files = texts_as_files(spark.createDataFrame([("My Note", "body one"), ("my note", "body two"), ("Other", "x")], "title string, content string"))
    assert sorted((r["path"], bytes(r["content"])) for r in files.collect()) == [("my_note.md", b"body two"), ("other.md", b"x")]
    raw = spark.createDataFrame([("/a/b_c.md", bytearray(b"# H\nt\xff"), None), ("/a/x.PDF", bytearray(b"%PDF"), None), ("/a/none.md", None, None), ("/a/z.md", bytearray(b"# H\nt\xff"), "T")], "path string, content binary, title string")
    reg = {r["filename"]: r for r in registry(raw).collect()}
    assert reg["b_c.md"]["title"] == "B C" and reg["x.PDF"]["mime_type"] == "application/pdf" and reg["z.md"]["title"] == "T"
    assert sorted(r["filename"] for r in dedupe(registry(raw.where("content is not null")), None).collect()) == ["b_c.md", "x.PDF"]
    parts, bad = parse(raw)
    assert parts.where("breadcrumbs[0] = 'H'").first()["text"] == "t�"
    assert sorted(tuple(r) for r in bad.collect()) == [("/a/none.md", "unreadable"), ("/a/x.PDF", "no PDF extractor")]

    def pages(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(page_no=2, text="one\n\n two ")

    assert sorted((r["text"], r["breadcrumbs"][0]) for r in parse(raw, pages)[0].where("page_number = 2").collect()) == [("one", "Page 2"), ("two", "Page 2")]
    assert pdf_sections(spark.createDataFrame([("d", 1, None)], "doc_id string, page_no int, text string")).count() == 0


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine(spark, str(tmp_path_factory.mktemp("store")), Config(chunk_target=40, chunk_overlap=10, chunk_min=5, embedding_dim=64))
    rows = [("Consensus Notes", NOTES), ("Fruit", "# Fruit\nBananas grow in warm places with much rain. Apples keep well in winter cellars.")]
    new = made.ingest(texts_as_files(spark.createDataFrame(rows, "title string, content string")))
    assert sorted(r["title"] for r in new.collect()) == ["Consensus Notes", "Fruit"]
    return made


def test_engine_answers(spark, engine):
    again = engine.ingest(texts_as_files(spark.createDataFrame([("Renamed", NOTES)], "title string, content string")))
    assert again.count() == 0 and engine.documents().count() == 2
    asked = spark.createDataFrame([(1, "How does Raft prevent split brain?"), (2, "Where do bananas grow?")], "query_id long, query string")
    rows = {r["query_id"]: r for r in engine.answer(asked).collect()}
    assert rows[1]["strategy"] == "multi_hop" and "Raft" in rows[1]["response"] and 0 <= rows[1]["faithfulness"] <= 1 and 0 < rows[1]["relevance"] <= 1
    assert "Bananas grow in warm places" in rows[2]["answer"] and rows[2]["chunks"][0]["title"] == "Fruit"
    assert rows[1]["answer"].startswith("According to the knowledge graph, ")
    plain = {r["query_id"]: r for r in engine.answer(asked, enable_graph=False, channels=("bm25",)).collect()}
    assert not plain[1]["answer"].startswith("According")
    events = [r["event"] for r in engine.answer_events(asked.where("query_id = 2")).orderBy("seq").collect()]
    assert events[:3] == ["routing", "subgraph", "sources"] and events[-2:] == ["verification", "done"] and set(events[3:-2]) == {"token"}


def test_engine_graph_and_evaluation(spark, engine):
    stats = engine.graph_stats().first()
    assert stats["n_nodes"] > 3 and stats["n_edges"] >= 1
    assert engine.central_entities(3).count() == 3
    nodes, _ = engine.subgraph()
    assert nodes.count() >= 3
    assert engine.path("Raft", "Split Brain").first()["relation"] == "PREVENTS" and engine.path("raft", "nothing").count() == 0
    assert engine.health().first()["documents"] == 2
    samples = spark.createDataFrame([(1, "How does Raft prevent split brain?", ["raft", "split_brain"])], "query_id long, query string, truth array<string>")
    measured = engine.evaluate(samples)
    arms = {r["arm"]: r for r in benchmark_summary(measured).collect()}
    assert set(arms) == {"naive", "hybrid", "full"} and arms["full"]["entity_recall"] == 1.0


def test_engine_delete_cascades(spark, tmp_path):
    eng = Engine(spark, str(tmp_path / "s"), Config(embedding_dim=16, chunk_target=40, chunk_min=5))
    eng.ingest(texts_as_files(spark.createDataFrame([("A", NOTES), ("B", "Paxos is a family of protocols for it.")], "title string, content string")))
    doc = eng.documents().where("title = 'A'").first()["doc_id"]
    assert eng.chunks(doc).count() >= 3
    assert eng.delete_document(doc) and not eng.delete_document(doc)
    assert eng.documents().count() == 1 and eng.chunks(doc).count() == 0 and eng.store.read("triples").count() == 0
    assert eng.store.read("vectors").count() == eng.store.read("chunks").count() == 1
    assert "raft" not in {r["node"] for r in eng._nodes().collect()}


def test_failing_providers_fall_back(spark, engine):
    def broken(batches):
        for pdf in batches:
            if pdf["text" if "text" in pdf else "prompt"].str.contains("bananas").any():
                raise OSError("no route")
            yield pdf.iloc[:, :1].assign(**({"embedding": [[0.0, 3.0, 4.0, 0.0]] * len(pdf)} if "text" in pdf else {"answer": "Said remotely, and at some length."}))

    texts = spark.createDataFrame([(1, "bananas grow"), (2, None), (3, "other")], "id long, text string").repartition(3, "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        made = {r["id"]: r["embedding"] for r in embed(texts, 4, provider=broken).collect()}
        asked = spark.createDataFrame([(1, "How does Raft prevent split brain?"), (2, "Where do bananas grow?")], "query_id long, query string")
        local = {r["query_id"]: r["answer"] for r in engine.answer(asked).collect()}
        engine.generator = broken
        said = {r["query_id"]: r["answer"] for r in engine.answer(asked).collect()}
    finally:
        engine.generator = None
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r["id"]: r["embedding"] for r in embed(texts, 4).collect()}
    assert made[3] == [0.0, 0.6, 0.8, 0.0] and made[1] == pytest.approx(want[1], abs=1e-12) and made[2] is not None
    assert said == {1: "Said remotely, and at some length.", 2: local[2]}


def test_changes_write_only_their_batch(spark, tmp_path):
    import os

    eng = Engine(spark, str(tmp_path / "s"), Config(embedding_dim=16, chunk_target=40, chunk_min=5))
    give = lambda *rows: eng.ingest(texts_as_files(spark.createDataFrame(rows, "title string, content string"))).count()
    folders = lambda: {(t, v) for t in ("documents", "chunks", "vectors", "mentions", "triples") for v in os.listdir(tmp_path / "s" / t)}
    give(("A", NOTES))
    first = folders()
    assert give(("B", "Paxos is a family of protocols for it."), ("C", "Zab is a protocol as well, and older.")) == 2
    second = folders() - first
    assert first < folders() and len(second) == 5 and eng.documents().count() == 3
    assert give(("A again", NOTES)) == 0 and folders() == first | second
    ids = {r["title"]: r["doc_id"] for r in eng.documents().collect()}
    before = sorted(map(str, eng.chunks(ids["A"]).collect()))
    assert eng.delete_document(ids["B"]) and len(folders()) == 15
    assert sorted(r["title"] for r in eng.documents().collect()) == ["A", "C"] and sorted(map(str, eng.chunks(ids["A"]).collect())) == before
    assert give(("B", "Paxos is a family of protocols for it.")) == 1 and eng.chunks(ids["B"]).count() == 1
    held = eng.store.read("vectors").count()
    assert held == eng.store.read("chunks").count()
    assert eng.store.vacuum() >= 5 and not second & folders() and eng.store.read("vectors").count() == held


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# A\nRaft is a protocol that many use.")
    (src / "copy.md").write_text("# A\nRaft is a protocol that many use.")
    eng = Engine(spark, str(tmp_path / "store"), Config(embedding_dim=16, chunk_min=5))
    for _ in range(2):
        ingest_stream(file_stream(spark, str(src)), eng.ingest, str(tmp_path / "ckpt")).awaitTermination(120)
        assert eng.documents().count() == 1
    (src / "b.md").write_text("Paxos is another one of those protocols.")
    ingest_stream(file_stream(spark, str(src)), eng.ingest, str(tmp_path / "ckpt")).awaitTermination(120)
    assert eng.documents().count() == 2


def test_samples_and_report_as_json(spark, tmp_path):
    import json

    from groundspark.engine import gains
    from groundspark.sources.samples import read_samples, write_report

    given = [{"id": "a", "query": "Who?", "type": "fact", "ground_truth_entities": ["x_y"], "ground_truth_claim": "c"}, {"id": "b", "query": "What?"}, {"id": "c"}]
    (tmp_path / "s.json").write_text(json.dumps(given))
    rows = {r["sample_id"]: r for r in read_samples(spark, str(tmp_path / "s.json")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["truth"] == ["x_y"] and rows["b"]["truth"] == [] and rows["b"]["claim"] is None
    summary = spark.createDataFrame([("naive", 0.5, 0.6, 0.0), ("full", 0.75, 0.7, 0.5)], "arm string, faithfulness double, relevance double, entity_recall double")
    write_report(gains(summary), str(tmp_path / "out"))
    write_report(gains(summary), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("faithfulness_gain_percent", "entity_recall_gain_percent").collect()] == [(50.0, 5000.0)]


def test_dense_search_in_blocks_and_pages_of_any_number(spark, monkeypatch):
    from groundspark.operators import vectors
    from groundspark.sources.files import pdf_sections

    rows = spark.createDataFrame([(f"c{i}", [float(i % 7), 1.0]) for i in range(60)], "chunk_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "query_id long, embedding array<double>")
    get = lambda: sorted(tuple(r) for r in vectors.dense_topk(rows, asked, 4).select("query_id", "rank", "chunk_id").collect())
    whole = get()
    monkeypatch.setattr(vectors, "MAX_QUERY_BYTES", 50)
    assert get() == whole and len(whole) == 36
    pages = spark.createDataFrame([("d", 30000, "a\n\nb")], "doc_id string, page_no int, text string")
    assert [r["section_index"] for r in pdf_sections(pages).collect()] == [3000000000, 3000000001]


def test_entities_for_triples_are_sought_in_related_texts_only(spark, monkeypatch):
    texts = ["Raft prevents Split. Nothing here.", "Redis Verify this. Disagree ever.", "The Leader is an Actor. Île REQUIRES Étage and Log.", "Éleads to Paxos. Raft", "Paxos depends \n on Raft", "", None, "Unneeded Preventsome causer"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    slow = F.exists(F.array(*[F.lower("content").rlike(graph.uni(p)) for p, _ in graph.RELATIONS]), lambda x: x)
    assert [r[0] for r in chunks.where(graph.related(F.col("content"))).orderBy("chunk_id").collect()] == [r[0] for r in chunks.where(slow).orderBy("chunk_id").collect()] == [0, 2, 4]
    for p, name in graph.RELATIONS:
        for way in p.removeprefix(r"\b(").removesuffix(r")\b").replace("?", "").replace(r"\s+", " ").split("|"):
            assert spark.range(1).select(graph.related(F.lit(f"X {way.upper()} Y"))).first()[0], (name, way)
    seen, plain = [], graph.entity_candidates
    monkeypatch.setattr(graph, "entity_candidates", lambda df, *a: (seen.extend(r[0] for r in df.select("chunk_id").collect()), plain(df, *a))[1])
    made = graph.text_triples(chunks)
    assert sorted(seen) == [0, 2, 4]
    assert sorted(made.collect()) == sorted(graph.relation_triples(chunks, plain(chunks)).collect()) and made.count() >= 3


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_chunks_are_scored_in_tasks_as_by_joins(spark, monkeypatch, most):
    rng = random.Random(8)
    nodes = [(q, f"é{n}", n % 3, n % 3 == 0) for q in range(12) for n in rng.sample(range(25), rng.randint(0, 9))]
    edges = [(q, f"c{rng.randrange(60)}" if rng.random() < 0.9 else None) for q in range(14) for _ in range(rng.randint(0, 6))]
    mentions = [(f"é{rng.randrange(30)}", f"c{rng.randrange(50)}") for _ in range(400)]
    nodes = spark.createDataFrame(nodes, "query_id long, node string, depth int, is_seed boolean")
    edges, mentions = spark.createDataFrame(edges, "query_id long, chunk_id string"), spark.createDataFrame(mentions, "canonical_id string, chunk_id string")
    monkeypatch.setattr(graph, "MOST_WORDS", most)
    made, want = (f(nodes, edges, mentions, 4).select("query_id", "chunk_id", "score", "rank") for f in (graph.best_chunks, graph.graph_chunk_scores))
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(made.collect()) == sorted(want.collect()) and made.count() > 30
    assert graph.best_chunks(nodes.limit(0), edges.limit(0), mentions, 4).count() == 0
