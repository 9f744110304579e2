"""Registered queries over the smallest tables, and the pipeline against a brute-force version."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from groundspark.llm import queries, sharding
from groundspark.llm.sql import OP5, ORACLES
from tests.conftest import TINY
from tests.llm import brute
from tests.test_queries import compare


def columns(name, *cols):
    t = pq.read_table(f"{TINY}/{name}.parquet")
    return list(zip(*[t[c].to_pylist() for c in cols], strict=True))


def got(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def test_all_are_registered():
    assert {n for q in entry.queries() for n in [q.split("_")[0]] if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], ORACLES[name])


def test_language_accuracy_on_held_out(spark):
    truth = dict(columns("documents", "doc_id", "lang"))
    rows = [r for r in queries.op1_language_id(spark, TINY).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.97


def test_languages_equal_dictionaries(spark):
    rows = columns("documents", "doc_id", "text", "lang")
    want = {d: (x, s) for d, x, s in brute.languages([(d, t) for d, t, _ in rows], [(t, x) for d, t, x in rows if brute.fold(d)])}
    for r in queries.op1_language_id(spark, TINY).collect():
        lang, score = want[r["doc_id"]]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4 and r["held_out"] == (brute.fold(r["doc_id"]) == 0)


def test_quality_equals_refit(spark):
    rows, labels = columns("documents", "doc_id", "text"), columns("labels", "doc_id", "quality")
    want = dict(brute.quality(rows, [(d, q) for d, q in labels if brute.fold(d)]))
    for r in queries.op4_quality(spark, TINY).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["held_out"] == (brute.fold(r["doc_id"]) == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_accuracy_on_held_out(spark):
    truth = dict(columns("labels", "doc_id", "quality"))
    rows = [r for r in queries.op4_quality(spark, TINY).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.85


def test_neighbours(spark):
    want = brute.nearest(columns("embeddings", "vec_id", "embedding"))
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in queries.op2_nearest_neighbours(spark, TINY).collect()} == want


def test_simhash(spark):
    want = brute.components([(d, brute.fingerprint(t)) for d, t in columns("documents", "doc_id", "text")])
    assert got(queries.op3_simhash(spark, TINY), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


def test_sharding_equals_sql(spark):
    compare(spark, queries.op5_sharding, OP5)


def test_sharding(spark):
    want = brute.interleave(columns("documents", "doc_id", "source", "text"), 16, sharding.SEED)
    out = queries.op5_sharding(spark, TINY)
    assert got(out, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(want, key=str)
    assert {(r["law"], r["grown_shard"]) for r in out.collect()} == {("rows", None)}


def test_bpe(spark):
    want = brute.tiktoken_rows(columns("documents", "doc_id", "text"))
    assert got(queries.op9_byte_bpe(spark, TINY), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def pipeline_by_hand(rows, bench):
    """The stages one after another in memory."""
    scored = brute.languages([(d, t) for d, t, _ in rows], [(t, x) for d, t, x in rows if brute.fold(d)])
    docs = [(d, t) for (d, t, _), (_, lang, s) in zip(rows, scored, strict=True) if lang != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    lost = {}
    for d, t in docs:
        for x in {brute.lower(x.strip(brute.WS)) for x in (t or "").split("\n")}:
            if len(x) >= 40:
                lost.setdefault(x, []).append(d)
    drop = lambda d, x: len(lost.get(k := brute.lower(x.strip(brute.WS)), ())) >= 5 and max(lost[k]) != d
    docs = [(d, "\n".join(x for x in t.split("\n") if not drop(d, x))) for d, t in docs]
    docs = [(d, t) for (d, t), (_, _, c) in zip(docs, brute.components([(d, brute.fingerprint(t)) for d, t in docs]), strict=True) if d == c]
    docs = [(d, t) for (d, t), r in zip(docs, brute.decontam(docs, bench), strict=True) if not r[-1]]
    return sorted(brute.tiktoken_rows(docs), key=str)


def test_pipeline(spark):
    want = pipeline_by_hand(columns("documents", "doc_id", "text", "lang"), columns("benchmark", "item_id", "text"))
    out = corpus_pipeline.run(spark, TINY)
    assert got(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert 0 < len(want) < len(columns("documents", "doc_id"))


def test_stages_keep_columns_and_survive_hostile_rows(spark):
    schema = spark.read.parquet(f"{TINY}/documents.parquet").schema
    text = "a text with enough words to be told apart from all others in here"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, "en", None, 3), (3, text, None, "s", 3), (3, text, None, "s", 3), (4, "12 34", "en", "s", 5)]
    rows += [(5, "long " * 200_000, "en", "s", 1), (6, "tie of two", "en", "s", 1), (6, "another text under the same id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    clash = docs.drop("n_chars")
    for k, c in enumerate(["score", "lang_pred", "n_lines", "n_dropped", "spans", "items", "n_words", "n_hit", "contaminated", "fp", "component_id", "tokens", "_text", "id"]):
        clash = clash.withColumn(c, F.lit(-7 - k))
    for frame in (docs, docs.limit(0), clash):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, TINY)
            assert out.columns == frame.columns, name
            for r in out.collect():
                assert "score" not in frame.columns or [r[c] for c in frame.columns[4:]] == [-7 - k for k in range(14)]
        assert corpus_pipeline.STAGES[-1][1](spark, frame, TINY).count() == frame.count()
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, TINY)
    assert sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == [-1, 1, 2, 4, 5, 6, 6]
    assert got(corpus_pipeline.language_stage(spark, docs.where("lang is null"), TINY).select(F.count("*").alias("n")), "n") == [(3,)]


def test_stages_leave_one_folder(spark):
    import glob

    out = corpus_pipeline.run(spark, TINY)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert out.count() > 0
    newest = max(glob.glob(f"{root}/pipeline-*"), key=lambda p: __import__("os").path.getmtime(p))
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{newest}/*")] == ["3-decontamination"]
