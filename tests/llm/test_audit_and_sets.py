"""Filter audit, importance resampling and MinHash groups against brute force, on hostile small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from groundspark.llm import filteraudit, importance, minhash, ngrams, queries
from tests.conftest import TINY
from tests.llm import brute
from tests.llm.test_operators import docs_of, got, hostile_texts

AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def columns(name, *cols):
    t = pq.read_table(f"{TINY}/{name}.parquet")
    return list(zip(*[t[c].to_pylist() for c in cols], strict=True))


def same(found, want):
    assert sorted(found, key=str) == sorted(want, key=str)


# ---- runs of words


@pytest.mark.parametrize("limit", [1, 9, 100, 1 << 20])
@pytest.mark.parametrize("longest", [1, 2, 3])
def test_pieces_hold_every_run_once(limit, longest):
    rng = random.Random(limit)
    long = "".join(rng.choice(["aa", "b", "Ünd ", ",", " ", "d" * 40]) for _ in range(900))
    texts = [None, "", " ,", "one", long, "x y", long[:50]]
    found = []
    for piece in ngrams.pieces([t and t.encode() for t in texts], ngrams.ALPHANUMERIC, longest, limit):
        for n in range(1, longest + 1):
            found += [(int(i), n, piece.text[a : a + m].tobytes()) for i, a, m in zip(*piece.runs(n), strict=True)]
    words = [(t or "").encode().translate(ngrams.ALPHANUMERIC).split() for t in texts]
    want = [(i, n, b" ".join(w[k : k + n])) for i, w in enumerate(words) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    same(found, want)


def test_hashes_equal_the_libraries():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcé1") for _ in range(rng.randint(1, 90))) for _ in range(800))
    piece = next(ngrams.pieces([text.encode()], ngrams.ALPHANUMERIC, 3))
    for n in (1, 2, 3):
        _, start, size = piece.runs(n)
        parts = [piece.text[a : a + m].tobytes() for a, m in zip(start, size, strict=True)]
        for seed in (0, 42):
            assert piece.hashes(start, size, seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]
        assert piece.crc32(start, size).tolist() == [zlib.crc32(p) for p in parts]


# ---- filter audit


@pytest.mark.parametrize("most_bytes", [filteraudit.PREFIX_BYTES, 200, 1])
def test_audit_equals_every_order_played_through(spark, most_bytes):
    rng = random.Random(7)
    common = "the same beginning of many texts, longer than any first prefix is, " * 12
    texts = hostile_texts(5, 25) + [common + str(k % 7) for k in range(30)] + ["", None, "AB# " * 90, "word " * 120, common] * 2
    texts += [" ".join(f"w{k}" for k in range(120)) + tail for tail in ("", "#", " A" * 60, "")]
    rows = [(rng.choice([k, k, k, 3, None]), t, rng.choice(["en", "de", None, ""])) for k, t in enumerate(texts)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, len(texts), 2)] + [(3, 0, 0), (3, 1, None), (None, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, mask int, part string, n int")
    frame = spark.createDataFrame([(d, q, int(t or 0)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    want = brute.filter_audit(rows, [(d, q, int(t or 0)) for d, q, t in labels])
    same([tuple(r) for r in filteraudit.audit(docs, frame, most_bytes=most_bytes).select(*AUDIT).collect()], want)
    assert filteraudit.audit(docs.limit(0), frame).count() == 0
    unlabelled = filteraudit.audit(docs, frame.limit(0), most_bytes=most_bytes)
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_string_ids(spark):
    rows = [("b", "same"), ("a", "same"), ("c", "same"), ("a", "other"), (None, "same")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id string, text string, lang string")
    masks = {(r["id"], r["mask"] >> filteraudit.DUPLICATE): r["n"] for r in filteraudit.filter_masks(docs).collect()}
    assert masks == {("b", 1): 1, ("a", 0): 2, ("c", 1): 1, (None, 0): 1}


def test_heavy_prefixes_are_lengthened(spark):
    common = "x" * 700
    docs = spark.createDataFrame([(k, common + f"{k:04d}" * 20) for k in range(300)] + [(k, "one text of many copies " * 40) for k in range(300, 600)], "id long, text string")
    plan, total = filteraudit.plan_prefixes(docs.withColumn("mark", F.xxhash64("text")), 2000)
    assert [n for n, _ in plan] == [8, 64, 512, 4096] and [len(h) for _, h in plan] == [1, 1, 1, 0]
    assert total == 300 * 780 + 960


def test_trie_holds_least_ids_of_whole_texts():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    trie, least = filteraudit.TextTrie(), {}
    for k, t in enumerate(texts):
        own = rng.randint(0, 1000)
        assert trie.insert(t, own, k) == (t not in least)
        least[t] = min(least.get(t, own), own)
    assert {t: own for t, own, _ in trie.terminals()} == least


# ---- importance resampling


def test_importance_equals_brute_force(spark):
    rows, target = columns("documents", "doc_id", "text"), [t for (t,) in columns("benchmark", "text")]
    found = queries.op12_importance(spark, TINY)
    same([tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()], brute.importance(rows, target))


def test_importance_of_hostile_rows(spark):
    rows = list(enumerate(hostile_texts(8, 40)))
    target = ["alpha beta gamma", None, "", "the of", "Ωmega délta " * 30]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, weight int")
    found = importance.resample(docs_of(spark, rows), frame)
    same([tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()], brute.importance(rows, target))
    none = importance.resample(docs_of(spark, rows), frame.limit(0))
    same([tuple(r) for r in none.select("doc_id", "n_features", "weight", "score", "rank").collect()], brute.importance(rows, []))
    assert importance.resample(docs_of(spark, []), frame).count() == 0
    # Null and repeated ids and whole repeats: every rank once, equal scores by id, a null id last.
    odd = [(None, "word " * 30), (4, "word " * 30), (4, "word " * 30), (5, "few words"), (4, "other text " * 15)] + [(9, "word " * 30)] * 20
    out = importance.resample(docs_of(spark, odd), frame, percent=100).collect()
    drawn = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 25)) and len(out) == 25
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"]) for r in drawn]
    assert keys == sorted(keys, key=lambda k: (k[0], k[1], k[2] or 0))


def test_table_tells_ngrams_with_equal_keys_apart(monkeypatch):
    piece = next(ngrams.pieces([b"aa bb aa cc bb aa bb"], ngrams.ALPHANUMERIC, 2))
    monkeypatch.setattr(ngrams.Piece, "hashes", lambda self, start, size, seed=0: np.full(len(start), 5, dtype=np.uint64))
    _, start, size = (np.concatenate(x) for x in zip(piece.runs(1), piece.runs(2), strict=True))
    table = importance.NgramTable(piece, start, size, 10_000)
    names = [piece.text[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    assert len({(s, n) for s, n in zip(table.slots.tolist(), names, strict=True)}) == len(set(names)) == len(table.used)
    assert sorted(table.count[table.used].tolist()) == sorted(names.count(n) for n in set(names))


# ---- MinHash


def test_minhash_equals_brute_force(spark):
    rows = columns("documents", "doc_id", "text")
    same([tuple(r) for r in queries.op13_minhash(spark, TINY).select("doc_id", "n_shingles", "component_id", "kept").collect()], brute.shingle_components(rows))


def test_minhash_of_hostile_and_near_texts(spark):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = hostile_texts(6, 30)
    for _ in range(120):  # around the threshold, in chains
        own = list(base)
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
        base = own if rng.random() < 0.3 else base
        texts.append(" ".join(own).upper() if rng.random() < 0.2 else "  ".join(own))
    texts += ["two words", "TWO  words", "two", "three words here", None, "", " \n"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-10]), (None, "alone with a null id"), (7, "another text of id seven")]
    found = minhash.near_duplicates(docs_of(spark, rows))
    want = brute.shingle_components(rows)
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()], [r[:3] for r in want])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_chunks_leave_one_with_one_error():
    d = minhash.distance_threshold(0.85)
    places = minhash.chunks(d)
    assert [k for c in places for k in c] == list(range(minhash.SYMBOLS))
    rng = random.Random(1)
    for _ in range(200):
        wrong = set(rng.sample(range(minhash.SYMBOLS), d))
        assert any(len(wrong & set(c)) <= 1 for c in places)


def test_signatures_differ_as_sets_do():
    rng = np.random.default_rng(6)
    gaps = []
    for _ in range(60):
        one = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        two = np.concatenate([one[:918], rng.integers(0, 1 << 63, 82, dtype=np.uint64)])  # 918 of 1082 are shared
        gaps.append(int((minhash.signature(one) != minhash.signature(two)).sum()))
    assert abs(np.mean(gaps) / minhash.SYMBOLS - (1 - 918 / 1082)) < 0.02 and max(gaps) <= minhash.distance_threshold(0.85)
