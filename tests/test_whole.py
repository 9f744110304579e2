"""The queries that do the engine's whole job, against plain Python on a small fixture."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from groundspark.config import Config
from groundspark.engine import Engine
from groundspark.functions import text as T
from groundspark.operators import graph, verification
from groundspark.plans import registry
from groundspark.sources.files import texts_as_files
from tests import brute_whole as brute

WORDS = "raft leader follower quorum banana garden river winter cellar copper signal market lantern harbour timber".split()
NAMES = ["Raft", "Split Brain", "Leader Node", "Copper Gate", "Harbour Master", "Lantern Guild", "Old Mill"]
VERBS = ["prevents", "requires", "contains", "leads to", "is a", "elects"]


def write(spark, folder, docs, bench, turns=()):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(turns), "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def prose(rng, words=WORDS, names=NAMES):
    parts = []
    for _ in range(rng.randint(1, 4)):
        fill = lambda: " ".join(rng.choices(words, k=rng.randint(1, 4)))
        parts.append(f"{fill()} {rng.choice(names)} {fill()} {rng.choice(VERBS)} {fill()} {rng.choice(names)}.")
    return " ".join(parts)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    rng = random.Random(7)
    docs = [(i, prose(rng), rng.choice(["en", "de"]), rng.choice(["web", "news"])) for i in range(40)]
    bench = [(i, " ".join(rng.choices(WORDS, k=3) + [rng.choice(NAMES)])) for i in range(8)]
    return docs, bench, write(spark, tmp_path_factory.mktemp("plain"), docs, bench)


def same_retrieval(spark, docs, bench, folder):
    cfg = registry.queries.WHOLE.cfg
    ranks = {q: brute.channel_ranks(text, docs, cfg) for q, text in bench}
    have = {(r["query_id"], r["doc_id"]): r for r in registry.WHOLE["rrf_fuse_whole"](spark, folder).collect()}
    assert set(have) == {(q, d) for q in ranks for d in ranks[q]}
    for (q, d), r in have.items():
        assert {m: r[f"{m}_rank"] for m in ("dense", "bm25", "graph") if r[f"{m}_rank"]} == ranks[q][d]
        assert r["rrf_score"] == pytest.approx(brute.fused(ranks[q], cfg)[d], abs=1e-8)
    want = {(q, k): x for q, text in bench for k, x in enumerate(brute.reranked(text, docs, ranks[q], cfg), start=1)}
    for name in ("hybrid_search_whole", "rerank_whole"):
        found = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in registry.WHOLE[name](spark, folder).collect()}
        assert {k: d for k, (d, _) in found.items()} == {k: d for k, (d, _) in want.items()}
        assert all(s == pytest.approx(want[k][1], abs=1e-5) for k, (_, s) in found.items())
    return ranks


def test_retrieval_has_the_three_channels(spark, plain):
    ranks = same_retrieval(spark, *plain)
    # Some documents are reached by the graph alone.
    assert any(set(x) == {"graph"} for of_query in ranks.values() for x in of_query.values())


def test_flagship_and_entry_have_the_whole_job(spark, plain):
    import __spark_entry__ as entry

    assert set(registry.WHOLE) <= set(entry.queries())
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(registry.flagship(spark, plain[2])) == rows(registry.WHOLE["hybrid_search_whole"](spark, plain[2]))


CLAIMS = [
    (1, 0, "user", "Copper lantern signals guide every harbour boat in winter. The garden has 3 rivers and many stones."),
    (1, 1, "assistant", "Copper lantern signals guide each harbour boat during winter. The garden has 7 rivers and many stones. Bananas never ripen in that cold cellar."),
    (1, 2, "user", "Timber markets open early on cold winter mornings near the quorum hall."),
    (1, 3, "assistant", "Timber markets open early on mornings. Leaders follow a quorum in every market hall."),
]


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("talks")
    return write(spark, folder, [(0, "x", "en", "web")], [(0, "Copper lantern in the old harbour"), (1, "")], CLAIMS)


def same_claims(spark, folder, turns):
    users = {c: [(f"{c}#{t}", x) for cc, t, r, x in sorted(turns) if cc == c and r == "user"] for c, *_ in turns}
    claims = {(r["query_id"], r["claim_ord"]): r["claim"] for r in registry.queries.claim_split(spark, folder, registry.queries.WHOLE).collect()}
    assert claims
    found = {(r["query_id"], r["claim_ord"], r["chunk_id"]): r for r in registry.WHOLE["claim_alignment_whole"](spark, folder).collect()}
    want = {(q, k, c): brute.alignment(claim, x) for (q, k), claim in claims.items() for c, x in users[int(q.split("-")[0])]}
    assert set(found) == set(want)
    for key, (recall, cosine, score, _) in want.items():
        assert tuple(found[key][c] for c in ("recall", "cosine", "score")) == pytest.approx((recall, cosine, score), abs=2e-6)
    made = {(r["query_id"], r["claim_ord"]): (r["status"], r["cited_chunk_id"]) for r in registry.WHOLE["claim_status_whole"](spark, folder).collect()}
    assert made == {(q, k): brute.status(claim, users[int(q.split("-")[0])]) for (q, k), claim in claims.items()}


def test_what_is_left_of_a_cancelled_sum_is_no_evidence(spark):
    rows = [("a", 0, 1, "x", 1e-17), ("a", 1, 1, "x", -1e-17), ("a", 1, 2, "y", 1e-9), ("b", 0, 1, "x", 0.5 + 1e-12), ("b", 0, 2, "y", 0.5 + 2e-12)]
    aligned = spark.createDataFrame(rows, "query_id string, claim_ord int, rank int, chunk_id string, score double")
    assert sorted((r["query_id"], r["claim_ord"], r["chunk_id"]) for r in verification.best_evidence(aligned).collect()) == [("a", 1, "y"), ("b", 0, "x")]


def test_vectors_have_the_operators_length(spark, talks):
    made = {(r["item_id"], r["bucket"]): r["value"] for r in registry.WHOLE["hash_embedding_whole"](spark, talks).collect()}
    want = {(i, b): v for i, text in ((0, "Copper lantern in the old harbour"), (1, "")) for b, v in enumerate(brute.embedding(text, 384)) if abs(v) > 1e-9}
    assert made == pytest.approx(want, abs=1e-6) and max(b for _, b in made) == 383


def test_claims_use_the_operators_vectors(spark, talks):
    same_claims(spark, talks, CLAIMS)


def test_pagerank_goes_on_to_its_tolerance(spark, tmp_path):
    spark.createDataFrame([(i, i % 5, "s") for i in range(30)], "c_custkey long, c_nationkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, i % 3) for i in range(4)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(5)], "n_nationkey long, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    edges = [(f"c{i}", f"n{i % 5}") for i in range(30)] + [(f"s{i}", f"n{i % 3}") for i in range(4)] + [(f"n{i}", f"r{i % 2}") for i in range(5)]
    want = brute.pagerank(edges)
    apart = lambda q: sum(abs(r["score"] - want[r["node"]]) for r in q(spark, str(tmp_path)).collect())
    # The stopping rule allows a change of nodes times the tolerance; what is left is under 1 / (1 - 0.85) times that.
    assert apart(registry.WHOLE["pagerank_whole"]) < len(want) * 1e-6 / 0.15 + len(want) * 1e-9 < apart(registry.QUERIES["pagerank"])


FOREIGN = ["größe", "über", "café", "niño", "forêt", "straße", "жук", "улица", "図書館", "٣٤"]
FOREIGN_NAMES = ["Raft", "Zoë Müller", "Élan Vital", "Münster Gate", "São Paulo", "Harbour Master"]


@pytest.fixture(scope="module")
def foreign(spark, tmp_path_factory):
    rng = random.Random(11)
    docs = [(i, prose(rng, WORDS[:6] + FOREIGN, FOREIGN_NAMES), "de", "web") for i in range(30)]
    docs += [(30, "Жук ест лист! Улица пуста, и город спит спокойно. 7 лет прошло.", "ru", "web"), (31, "Ends here. Next starts there. Tab\x1cseparated words.", "fr", "web"), (32, "", "xx", "web")]
    bench = [(i, " ".join(rng.choices(WORDS[:6] + FOREIGN, k=4) + [rng.choice(FOREIGN_NAMES)])) for i in range(5)]
    turns = [(c, t, r, x.replace("signals", "größere Signäle").replace("garden", "jardín")) for c, t, r, x in CLAIMS]
    return docs, bench, turns, write(spark, tmp_path_factory.mktemp("foreign"), docs, bench, turns)


def test_retrieval_of_original_texts(spark, foreign):
    docs, bench, _, folder = foreign
    same_retrieval(spark, docs, bench, folder)


def test_claims_of_original_texts(spark, foreign):
    same_claims(spark, foreign[3], foreign[2])


def test_original_texts_stay_whole(spark, foreign):
    docs, _, _, folder = foreign
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = lambda name: sorted(tuple(r) for r in registry.WHOLE[name](spark, folder).collect())
    split = {d: [s.strip() for s in re.split(T.CHUNK_SENTENCE, x) if s.strip()] for d, x, *_ in docs}
    assert rows("sentence_split_whole") == [(d, len(s), sha("\x01".join(s))) for d, s in sorted(split.items())]
    stems = {d: sorted(brute.stems(x)) for d, x, *_ in docs}
    assert rows("stem_tokens_whole") == [(d, len(s), sha(" ".join(s))) for d, s in sorted(stems.items())]
    estimate = lambda x: max(len(x.split()), len(x) // 4)
    assert rows("token_estimate_whole") == [(d, estimate(x)) for d, x, *_ in docs]
    # Sections join lines anew, and a file separator ends a line.
    lines = {d: [x.replace("\x1c", "\n") for x in s] for d, s in split.items()}
    assert rows("semantic_chunks_whole") == [(d, 0, sum(map(estimate, s)), sha(" ".join(s))) for d, s in sorted(lines.items()) if s]
    assert {r[:3] for r in rows("entity_candidates_whole")} == {(d, c, n) for d, x, *_ in docs for c, n in brute.entities(x).items()}
    # A text in another script keeps its sentences.
    assert len(split[30]) == 2 and len(split[31]) == 3


def test_paths_have_no_bound(spark):
    chain = [(f"t{i:02}", f"n{i:02}", f"n{i + 1:02}", "IS_A") for i in range(10)] + [("u", "x", "y", "IS_A")]
    triples = spark.createDataFrame(chain, "triple_id string, source_id string, target_id string, relation string")
    pairs = spark.createDataFrame([("n00", "n10"), ("n02", "n03"), ("n00", "x")], "source string, target string")
    found = {(r["source"], r["target"]): r["path"] for r in graph.shortest_paths(pairs, triples).collect()}
    assert found == {("n00", "n10"): [f"n{i:02}" for i in range(11)], ("n02", "n03"): ["n02", "n03"]}
    assert graph.shortest_paths(pairs, triples, 6).count() == 1


def by_topic(batches):
    """Remote vectors: fruit one way, all else the other."""
    for pdf in batches:
        fruit = pdf.iloc[:, 1].str.contains("anana|ellow|weet")
        yield pdf[[pdf.columns[0]]].assign(embedding=[[3.0, 0.0] if f else [0.0, 3.0] for f in fruit])


def test_engine_uses_its_embedder_for_all_texts(spark, tmp_path):
    eng = Engine(spark, str(tmp_path / "s"), Config(embedding_dim=2, chunk_min=5), embedder=by_topic)
    eng.ingest(texts_as_files(spark.createDataFrame([("Fruit", "Bananas grow in warm places with much rain."), ("Raft", "The leader replicates entries to its followers.")], "title string, content string")))
    texts = ["yellow", "sweet thing", "log", "quorum", "term of office"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    first = {r["query_id"]: r["title"] for r in eng.retrieve(asked, 1, ("dense",))[0].collect()}
    assert first == {0: "Fruit", 1: "Fruit", 2: "Raft", 3: "Raft", 4: "Raft"}
    answers = asked.select("query_id", "query", F.lit("Sweet bananas ripen on every tall tree.").alias("answer"))
    contexts = spark.createDataFrame([(i, 1, "c", "All yellow and soft.") for i in range(5)], "query_id long, rank int, chunk_id string, content string")
    claims = verification.claim_table(answers)
    assert {r["cosine"] for r in verification.align(claims, contexts, eng.cfg, provider=by_topic).collect()} == {1.0}
    assert {r["query_id"]: r["relevance"] for r in verification.relevance(answers, eng.cfg, provider=by_topic).collect()} == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.5, 4: 0.5}


def test_unreadable_files_wait_in_quarantine(spark, tmp_path):
    def pages(batches):
        for pdf in batches:
            yield pdf[["doc_id"]].assign(page_no=1, text="Raft is a protocol that many people use.")

    raw = spark.createDataFrame([("/in/a.pdf", bytearray(b"%PDF a"), None), ("/in/n.md", None, None), ("/in/b.md", bytearray(b"Paxos is one of those protocols."), None)], "path string, content binary, title string")
    root = str(tmp_path / "s")
    eng = Engine(spark, root, Config(embedding_dim=16, chunk_min=5))
    assert [r["filename"] for r in eng.ingest(raw).collect()] == ["b.md"]
    assert sorted(tuple(r) for r in eng.quarantine().collect()) == [("/in/a.pdf", "no PDF extractor"), ("/in/n.md", "unreadable")]
    able = Engine(spark, root, Config(embedding_dim=16, chunk_min=5), pdf_pages=pages)
    assert [(r["filename"], r["chunk_count"]) for r in able.ingest(raw).collect()] == [("a.pdf", 1)]
    assert [tuple(r) for r in able.quarantine().collect()] == [("/in/n.md", "unreadable")] and able.documents().count() == 2
