"""The ten operators against brute force, on hostile small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import ann, bpe, decontam, langid, linededup, quality, queries, secrets, sharding, simhash, urlfilter
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, n_words string, component_id int, shard string"


def docs_of(spark, rows):
    """Rows of (doc_id, text) with clashing extra columns."""
    full = [(i, t, "en", "s" if k % 3 else None, None, "x", 7, "y", 1, None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOC)


def got(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def hostile_texts(seed=3, n=60):
    """Nulls, blanks, long texts, repeats and near repeats."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "x1", "Ωmega", "the", "of", "end.", "ﬁn"]
    texts = [None, "", " \t\n\x0b\f\r ", "\n\n", "one", "A", "Ａ", " "]
    base = [rng.choice(words) for _ in range(400)]
    for k in range(n):
        own = base[: rng.randint(3, 400)]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own) if k % 3 else "\n".join(" ".join(own[i : i + 12]) for i in range(0, len(own), 12)))
    texts += [texts[-1]] * 9 + [" ".join(rng.choice(words) for _ in range(20000))]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = hostile_texts()
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, None), (5, texts[5])]


def test_repetitive_texts_take_linear_time():
    import time

    phrases = decontam.Phrases([(1, b"ha " * 400), (2, b"ha " * 12 + b"ho"), (3, b"oh")], 13)
    began = time.perf_counter()
    n, spans, items = decontam.find_hits([b"ha " * 160_000, b"x oh x"], phrases)
    assert time.perf_counter() - began < 10
    assert n == [160_000, 3] and spans == [[(0, 160_000)], [(1, 2)]] and items == [{"1"}, {"3"}]


def test_simhash_equals_brute_force(spark, rows):
    found = simhash.near_duplicates(docs_of(spark, rows)).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    want = brute.components([(d, brute.fingerprint(t)) for d, t in rows])
    assert got(found, "doc_id", "f", "component_id") == sorted(want, key=str)


def test_simhash_hot_halves_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    df = spark.createDataFrame(signed, "fp long")
    from groundspark.operators.components import connected_components

    want = {f: c for f, _, c in brute.components([(f, f) for f in fps])}
    groups = {}
    for f, c in want.items():
        groups.setdefault(c, set()).add(f)
    for hot in (3, 10_000):
        links = simhash.near_links(df, 3, hot_half=hot)
        for a, b in links.collect():
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
        member = {}
        for r in connected_components(links).collect():
            member.setdefault(r["component"], set()).add(r["node"] % (1 << 64))
        assert sorted(map(sorted, member.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("hot", [3, 10_000])
def test_simhash_broadcasts_no_variants(spark, hot):
    halves = random.Random(6).sample(range(1 << 31), 40)
    fps = spark.createDataFrame([(h << 32 | x,) for h in halves for x in range(8)], "fp long")
    links = simhash.near_links(fps, 3, hot_half=hot)
    assert links.count() > 0
    plan = links._jdf.queryExecution()
    links._jdf.collectToPython()
    inside = None
    for line in plan.executedPlan().toString().split("Initial Plan")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if "BroadcastExchange" in line:
            inside = depth
        # Few hot halves may be broadcast, which are counted before; variants may not.
        assert inside is None or "Generate" not in line


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


WAYS = [{}, {"broadcast_keys": 0}, {"broadcast_keys": 0, "group_probes": 7}]


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("shard_keys", [2, 50_000])
def test_line_dedup_equals_brute_force(spark, way, shard_keys):
    rng = random.Random(9)
    lines = [f"{k} a line that is surely long enough to be counted é {k * k}" for k in range(30)] + ["short", "", "x" * 39, "y" * 40, "é" * 39, "é" * 40]
    texts = [None, ""] + ["\n".join(rng.choice([" ", "\t", ""]) + rng.choice([s, s.upper(), s]) + rng.choice(["", "\r", "\x0b "]) for s in rng.choices(lines, k=rng.randint(1, 12))) for _ in range(80)]
    rows = [(i % 70 if i != 17 else None, t) for i, t in enumerate(texts)]
    kept = linededup.drop_repeated_lines(docs_of(spark, rows), shard_keys=shard_keys, **way)
    assert "lang" in kept.columns and kept.columns.count("text") == 1
    assert got(kept.withColumn("sha", queries._hex(F.col("text"))), "doc_id", "n_lines", "n_dropped", "sha") == sorted(brute.line_dedup(rows), key=str)
    assert kept.where("text is null").count() == 1
    assert linededup.drop_repeated_lines(docs_of(spark, []), **way).count() == 0


def test_line_dedup_keeps_lines_of_one_document(spark):
    """Of 600,000 distinct lines beside a hundred repeated ones none goes, whichever way the lines are looked up."""
    shared = [f"{k} a line that all of the documents share with each other" for k in range(100)]
    own = F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda k: F.concat(k.cast("string"), F.lit(" of "), F.col("id").cast("string"), F.lit(", a line that only one document has"))))
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.concat(F.lit("\n".join(shared) + "\n"), own).alias("text"))
    for way in ({}, {"broadcast_keys": 0, "group_probes": 20_000}):
        kept = linededup.drop_repeated_lines(docs, **way)
        assert got(kept, "doc_id", "n_dropped") == sorted([(i, 100 if i < 11 else 0) for i in range(12)], key=str)


@pytest.mark.parametrize("way", WAYS)
def test_line_dedup_counts_ids_not_rows(spark, way):
    line = "a line of over forty characters that five rows but two ids hold"
    wide = "another line of over forty characters that five different ids hold"
    rows = [(1, f"{line}\n{wide}")] * 4 + [(2, f"{wide}\n{line}")] + [(i, wide + "\n" + "z" * 100_000) for i in (3, 4, 5)]
    frame = docs_of(spark, rows)
    for as_text in (False, True):
        own = frame.withColumn("doc_id", F.col("doc_id").cast("string")) if as_text else frame
        kept = linededup.drop_repeated_lines(own, **way)
        out = got(kept.withColumn("sha", queries._hex(F.col("text"))), "doc_id", "n_lines", "n_dropped", "sha")
        assert out == sorted([(str(d) if as_text else d, *x) for d, *x in brute.line_dedup(rows)], key=str)
        assert sum(n for _, _, n, _ in out) == 7


def test_minimal_hash_finds_members_only():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    h1[10] = h1[11]  # keys that share the first hash
    counts = np.arange(5000) % 7
    index = linededup.LineIndex(h1, h2, counts, np.arange(5000), 5)
    place = index.find(h1, h2)
    assert sorted(place.tolist()) == list(range(5000)) and (index.counts[place] == np.minimum(counts, 5)).all()
    assert (index.gone(h1, h2, np.full(5000, -1)) == (counts >= 5)).all() and not index.gone(h1, h2, np.arange(5000)).any()
    assert (index.find(h1, h2 + np.uint64(1)) == -1).all()
    whole = linededup.LineIndex(h1, h2, counts, np.arange(5000), 5, whole=True)
    assert sorted(whole.find(h1, h2).tolist()) == list(range(5000))
    for _ in range(20):
        strangers = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
        assert (whole.find(strangers, rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)) == -1).all()
    assert (whole.find(rng.permutation(h1), h2) >= 0).sum() <= 2


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.Example.ORG", "x.com", "com", "xexample.org", "", "a..org", "deep.a.b.c.d.example.org", "EXAMPLE.org:80", "é.org", "o.rg"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/?q", "/fr/#x", "//es/", "?a=/es/", "#/", "/en/1://z"]
    rows = [(i, rng.choice(["http://", "https://", "x:", "", "://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(400)] + [(None, None), (7, None), (8, "a" * 5000 + "://" + "b." * 3000 + "org/")]
    rules = queries.URL_RULES + [("d.example.org", "/e", "block"), ("example.org", "/en/1", "allow"), ("", "/", "block"), (None, "/", "block"), ("org", "", "allow")]
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, None, "z") for i, u in rows], "page_id long, url string, host string, rule string")
    want = brute.judge(rows, [r for r in rules if None not in r])
    for range_rows in (1, 40, 10_000):
        assert got(urlfilter.judge(pages, frame, range_rows=range_rows), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=str)
    assert urlfilter.judge(pages, frame.limit(0)).where("rule is null and verdict = 'allow'").count() == len(rows)
    assert urlfilter.judge(pages.limit(0), frame).count() == 0


def test_url_ranges_split_a_hot_host(spark):
    """Nested hosts and paths at random; most pages belong to one host, and every task gets a share of them."""
    rng = random.Random(11)
    name = lambda k: ".".join(rng.choices(["a", "b", "a-b", "ab"], k=k))
    step = lambda: "".join(rng.choices(["/", "/x", "/xy", "z"], k=rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(name(rng.randint(1, 3)), step()) for _ in range(150)]}.values())
    rows = [(i, f"http://{name(rng.randint(1, 5)) if i % 3 else 'hot.a.b'}{step()}?q") for i in range(1500)]
    pages, frame = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    judged = urlfilter.judge(pages, frame, range_rows=100)
    assert got(judged, "page_id", "host", "path", "rule", "verdict") == sorted(brute.judge(rows, rules), key=str)
    shares = judged.where("host = 'hot.a.b'").groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) >= 5 and max(r["count"] for r in shares) < 200


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 400])
def test_decontamination_equals_brute_force(spark, rows, block_bytes):
    rng = random.Random(4)
    texts = [t for _, t in rows if t]
    items = [(1, None), (2, ""), (None, "alpha Beta gamma"), (3, "x1"), (4, "!!"), (4, "of the end")]
    for k in range(25):
        ws = rng.choice(texts).split()
        at = rng.randrange(max(1, len(ws) - 5))
        items.append((10 + k, " ".join(ws[at : at + rng.randint(2, 30)])))
    items += [items[-1], (99, items[-1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.decontaminate(docs_of(spark, rows), bench, block_bytes=block_bytes)
    digest = found.select("doc_id", F.col("n_words"), "n_hit", F.size("items").alias("n"), queries._hex(F.array_join("items", ",")).alias("sha"), "contaminated")
    assert got(digest, *digest.columns) == sorted(brute.decontam(rows, items), key=str)
    spans = found.where("n_hit > 0").select("spans").first()["spans"]
    assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))
    assert decontam.decontaminate(docs_of(spark, rows), bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontam.decontaminate(docs_of(spark, []), bench).count() == 0


def test_fm_index_locates_every_occurrence():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, 500)
    index = decontam.FMIndex(s)
    for size in (1, 2, 5):
        phrases = np.unique(np.lib.stride_tricks.sliding_window_view(s, size), axis=0)[1:]
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(s) - size + 1) if (s[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    assert index.search(np.array([[9, 9]]))[0] == index.search(np.array([[9, 9]]))[1]


def test_bpe_equals_library(spark, rows):
    import public_tokenizers as p

    more = [(1000 + i, t) for i, t in enumerate([" " * 3000, "a" * 2000, "\x1c\x85᠎  x", "😀" * 50, "don't  stop\n\n 123abc", "<|endoftext|>", "\x00\x00"])]
    path = p.path("byte_bpe_multi_50k.tiktoken")
    frame = docs_of(spark, rows + more).withColumn("tokens", F.lit("clash"))
    both = bpe.decode(bpe.encode(frame, path, p.PATTERN), path)
    assert got(queries.token_digests(both), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(brute.tiktoken_rows(rows + more), key=str)
    assert both.where("decode(decoded, 'UTF-8') <> coalesce(text, '')").count() == 0
    at_once = bpe.encode(frame, path, p.PATTERN, bytes_col="decoded").withColumnRenamed("decoded", "d")
    assert at_once.count() == at_once.where("decode(d, 'UTF-8') = coalesce(text, '')").count() == len(rows + more)
    assert bpe.encode(docs_of(spark, []), path, p.PATTERN).count() == 0


def test_bpe_appends_and_edits_are_exact():
    import public_tokenizers as p

    v = bpe.Vocabulary.from_file_bytes(bpe.read_vocabulary(p.path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(6)
    state = bpe.Prefixes(v)
    for _ in range(60):
        new = bytes(rng.choice(b"abcdefgh theing\xc3\xa9") for _ in range(rng.randint(0, 80)))
        if rng.random() < 0.4:
            state.append(new)
        else:
            a = rng.randint(0, len(state.text))
            b = rng.randint(a, min(len(state.text), a + 30))
            whole, cost = state.text[:a] + new + state.text[b:], state.edit(a, b, new)
            assert state.text == whole and cost <= len(whole) - a
        assert state.tokens() == bpe.Prefixes(v, state.text).tokens() == v.merge(state.text)
    with pytest.raises(ValueError):
        bpe.Prefixes(bpe.Vocabulary({b"a": 0}), b"ab")
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}).encode_all([b"a", b"ab"])
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4})


@pytest.mark.parametrize("seed", range(4))
def test_bpe_together_equals_merging(seed, monkeypatch):
    """Random small vocabularies: bytes with high ranks, tokens of repeats, tokens that merging never makes."""
    rng = random.Random(seed)
    tokens = {bytes([c]) for c in b"abc"} | {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(60)}
    order = sorted(tokens, key=lambda t: (len(t) == 1 if seed % 2 else False, len(t)))
    v = bpe.Vocabulary({t: i for i, t in enumerate(order)})
    texts = [bytes(rng.choices(b"abc", k=rng.randint(1, 70))) for _ in range(300)]
    row, counts = v.encode_all(texts)
    want = [[v.ranks[t]] if t in v.ranks else v.merge(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and row.tolist() == sum(want, [])
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    pieces = bpe.Pieces(v)
    for at in range(0, 300, 30):
        lot = [t.decode() for t in rng.choices(texts, k=30)]
        row, counts = pieces.encode(lot)
        assert row.tolist() == sum((want[texts.index(t.encode())] for t in lot), []) and len(counts) == 30


def test_bpe_very_long_texts_go_in_blocks(monkeypatch):
    import public_tokenizers as p

    v = bpe.Vocabulary.from_file_bytes(bpe.read_vocabulary(p.path("byte_bpe_multi_50k.tiktoken")))
    texts = ["some words, more words " * 50, None, "", "\u00e9t\u00e9 12 " * 40, "x"]
    whole = bpe.encode_texts(v, texts, bpe.splitter(p.PATTERN))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    blocks = bpe.encode_texts(v, texts, bpe.splitter(p.PATTERN))
    assert all((a == b).all() for a, b in zip(whole, blocks, strict=True)) and whole[1].tolist()[1:3] == [0, 0]


def test_secret_scan_equals_brute_force(spark):
    rng = random.Random(8)
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, "deadbeef", "é", "😀", "\n", "x/y+z=="]
    texts = [None, "", "secret=token=abcdefghij", 'secret: "token: abcdefghijk', "\x0bK"] + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(300)]
    texts.append("token=abcdefgh1 😀 " * 2000)  # very many matches in one text
    rows = list(enumerate(texts)) + [(None, "token=abcdefghi"), (3, "nothing")]
    frame = docs_of(spark, rows)
    spans = secrets.scan(frame)
    shown = spans.select("doc_id", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("s"))
    kinds = {"assign": "0", "access": "1", "hex": "2"}
    want = [(d, [":".join([kinds[x.split(":")[0]], *x.split(":")[1:]]) for x in s.split(",") if x]) for d, *_, s in brute.secrets(rows)]
    assert got(shown, "doc_id", "s") == sorted(want, key=str)
    again = secrets.scan(frame, set_words=1).select("doc_id", F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("s"))
    assert got(again, "doc_id", "s") == sorted(want, key=str)
    assert secrets.scan(docs_of(spark, [])).count() == 0
    plan = spans._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Python" not in plan and "MapInArrow" not in plan


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.regex) for r in secrets.RULES}
    assert q["hex"] is True and q["access"] == ("and", "aki", "kia")
    assert {"pas", "ord", "sec", "ret", "tok", "pi_", "pik"} <= set(secrets.trigrams_of(q["assign"]))
    assert secrets.trigram_query("ab?c|xyz+") is True
    assert secrets.trigram_query("x(abc|def)+y") == ("or", "abc", "def")
    assert secrets.trigram_query("(abcd)?efg") == ("or", ("and", "abc", "bcd", "cde", "def", "efg"), "efg")


def test_sharding_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"own{i}"])) for i in range(500)]
    frame = spark.createDataFrame([(i, s, None if i % 9 == 0 else "é" * i, "clash") for i, s in rows], "doc_id long, source string, text string, shard string")
    for bucket_rows in (7, 20_000):
        placed = sharding.interleave(frame, 16, bucket_rows=bucket_rows)
        out = placed.select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert sorted(map(tuple, out)) == sorted(brute.interleave([(i, s, None if i % 9 == 0 else "é" * i) for i, s in rows], 16, sharding.SEED))
    mixed = placed.where("source = 'a'").groupBy("shard").count().toPandas()["count"]
    assert mixed.max() - mixed.min() <= 6
    same = spark.createDataFrame([(1, "a", "x", "")] * 40, frame.schema)
    assert sorted(r["count"] for r in sharding.interleave(same, 16, bucket_rows=7).groupBy("shard").count().collect()) == [2] * 8 + [3] * 8
    odd = [(None, "a", "x"), (None, "a", None), (3, "a", "x"), (3, "a", "y"), (3, "b", "y"), (4, None, "")]
    held = sharding.interleave(spark.createDataFrame(odd, "doc_id long, source string, text string"), 4, bucket_rows=1)
    assert got(held, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(brute.interleave(odd, 4, sharding.SEED), key=str)
    assert sharding.interleave(frame.limit(0)).count() == 0


def test_many_whole_repeats_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 7)
    rows = [(None, "hot", None)] * 200 + [(k, "hot" if k % 2 else "cold", "text " * (k % 5)) for k in range(60)] + [(3, "hot", "text " * 3)] * 8
    held = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string, text string"), 4, bucket_rows=10)
    assert got(held, "doc_id", "size", "text_crc32", "shard", "slot") == sorted(brute.interleave(rows, 4, sharding.SEED), key=str)


def test_cosines_of_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e-200, 2.1e-200]), (2, [2e-200, -1e-200]), (3, [3e150, 6e150]), (4, [5e-324, 1e-323]), (5, [-1.0, -2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(frame, F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert {r["vec_id"] for r in found[:2]} == {3, 4} and [r["vec_id"] for r in found[2:]] == [1, 2, 5]
    for r, want in zip(found, [1, 1, 0.999875, 0, -1], strict=True):
        assert abs(r["score"] - want) < 1e-4


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[50:200] = base[50]  # a very common vector
    base[210] = base[209] * 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0] * 7 + [None]), (1004, [1.0] * 7 + [float("nan")]), (1050, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (250, rows[250][1])]
    frame = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = {(q, r, i) for q, r, i, _ in brute.nearest(rows)}
    near = {q: [s for _, _, _, s in sorted(x for x in brute.nearest(rows) if x[0] == q)] for q, _, _ in want}
    for cells in (1 << 19, 256 * 8):
        found = ann.nearest(frame, F.col("vec_id") % 50 == 0, stripe_cells=cells).collect()
        assert len(found) == len(want)
        for r in found:
            assert abs(r["score"] - near[r["query_id"]][r["rank"] - 1]) < 1e-9
        hot = [(r["query_id"], r["rank"], r["vec_id"]) for r in found if r["query_id"] in (50, 100, 150)]
        assert set(hot) == {x for x in want if x[0] in (50, 100, 150)}
    tied = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 2.0]) for i in range(40)] + [(7, [5.0, 5.0]), (7, [0.5, 9.0]), (7, [0.5, 1.0])], "vec_id long, embedding array<double>")
    top = [(r["rank"], r["vec_id"]) for r in ann.nearest(tied, F.col("vec_id") == 0, k=4).collect()]
    assert sorted(top) == [(1, 2), (2, 4), (3, 6), (4, 8)]  # ties to the smaller id
    seven = {r["vec_id"]: r["score"] for r in ann.nearest(tied, F.col("vec_id") == 0, k=30).collect()}[7]
    assert abs(seven - 1 / 1.25**0.5) < 1e-12  # of a repeated id the least vector counts
    few = frame.where("vec_id in (0, 1, 2)")
    assert sorted((r["rank"], r["vec_id"]) for r in ann.nearest(few, F.col("vec_id") == 0).collect()) in ([(1, 1), (2, 2)], [(1, 2), (2, 1)])
    assert ann.nearest(frame.limit(0), F.col("vec_id") == 0).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(0)
    for dim in (2, 64, 300):
        x = ann._unit(rng.normal(size=(40, dim)) * rng.lognormal(size=(1, dim)) ** 3)
        code, scale, lost = ann._codes(x)
        exact = x @ x.T
        near = (code.astype(float) * scale[:, None]) @ (code.astype(float) * scale[:, None]).T
        assert (np.abs(exact - near) <= lost[:, None] * (1 + lost) + lost * (1 + lost[:, None]) + lost[:, None] * lost + 1e-12).all()


def test_language_id(spark):
    rng = random.Random(3)
    vocab = {"en": ["the", "with", "and", "thing", "of"], "fr": ["le", "été", "qui", "que", "eaux"], "de": ["der", "und", "ß", "nicht", "ich"]}
    rows = [(i, " ".join(rng.choices(vocab[x], k=rng.randint(2, 60))), x) for i, x in enumerate(rng.choices(list(vocab), k=300))]
    frame = spark.createDataFrame(rows + [(900, None, "en"), (901, "", "fr"), (902, "12 34 !", "de"), (903, "the " * 200_000, None), (None, "été", "fr")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.train(frame.where("doc_id % 2 = 0"))
    out = {r["doc_id"]: r for r in langid.predict(frame, model).collect()}
    assert all(out[i]["lang_pred"] == x for i, _, x in rows)
    assert {out[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and out[902]["score"] == 0
    assert out[903]["lang_pred"] == "en" and out[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    empty = langid.train(frame.limit(0))
    assert {r["lang_pred"] for r in langid.predict(frame, empty).collect()} == {"und"}
    assert langid.predict(frame.limit(0), model).count() == 0


def test_language_id_equals_dictionaries(spark):
    """Ties, repeated rows and ids, one language a slice."""
    rng = random.Random(5)
    rows = [(i % 90, " ".join(rng.choices(["le", "été", "der", "und", "the", "of", "x1"], k=rng.randint(1, 80))), rng.choice(["fr", "de", "en", "it"])) for i in range(120)]
    rows += [(7, "twice", "en")] * 3 + [(200, None, "en"), (201, "", "fr"), (202, "12", "de"), (203, "no label", None), (None, "Ünd", "de"), (204, "a" * 3000, "it")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = brute.languages([(d, t) for d, t, _ in rows], [(t, x) for _, t, x in rows])
    model = langid.train(frame)
    rounded = lambda out: sorted([(d, x, round(s, 5)) for d, x, s in out], key=str)
    for size in (langid.MAX_MATRIX_BYTES, 4 << 16):
        out = [tuple(r) for r in langid.predict(frame, model, max_bytes=size).select("doc_id", "lang_pred", "score").collect()]
        assert rounded(out) == rounded(want)
    # The bound on the sample holds where one id fills it.
    many = spark.createDataFrame([(1, f"text {i}", "en") for i in range(40)] + [(2, "texte", "fr")], frame.schema)
    assert round(float(np.exp(langid.train(many, max_rows=10).log_prior).sum()), 6) == 1.0
    few = langid.train(many, max_rows=10)
    assert len(few.langs) <= 2 and few.langs[0] == "en"


def test_language_blocks_count_each_gram_once(monkeypatch):
    codes = langid._codes("some words in a row, été " * 40)
    whole = [np.sort(np.concatenate(x)) for x in [list(langid.gram_blocks(codes, 12))]][0]
    table = np.random.default_rng(2).random((1 << 12, 3)).astype(np.float32)
    texts = [codes, codes[:1], codes[:2], codes[5:9], codes[3:80]]
    together = langid.totals(texts, table, 12)
    alone = [langid.totals([t], table, 12) for t in texts]
    assert np.allclose(together[0], np.concatenate([a for a, _ in alone])) and (together[1] == np.concatenate([b for _, b in alone])).all()
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert (np.sort(np.concatenate(list(langid.gram_blocks(codes, 12)))) == whole).all()


def test_quality(spark):
    rng = random.Random(4)
    good = lambda: ". ".join(" ".join(rng.choices(["words", "of", "sound", "prose", "that", "runs", "on"], k=rng.randint(5, 12))).capitalize() for _ in range(rng.randint(3, 9))) + "."
    junk = lambda: " | ".join(rng.choices(["BUY", "now", "$$$", "click", "here!!!"], k=rng.randint(5, 60)))
    rows = [(i, good() if i % 4 else junk(), int(bool(i % 4))) for i in range(400)]
    frame = docs_of(spark, [(i, t) for i, t, _ in rows] + [(800, None), (801, ""), (None, "x"), (802, "w " * 100_000)])
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(5, 1, 0), (800, None, 1), (9999, 1, 0), (None, 0, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.classify(frame, labels, train_on=lambda c: c % 2 == 1).collect()}
    held = [out[i]["predicted"] == q for i, _, q in rows if i % 2 == 0]
    # Junk has even ids only here, so class 0 is unknown: scores still are defined.
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    out = {r["doc_id"]: r for r in quality.classify(frame, labels, train_on=lambda c: c % 3 == 1).collect()}
    held = [out[i]["predicted"] == q for i, _, q in rows if i % 3 != 1]
    assert sum(held) / len(held) > 0.98
    assert len(out) == 404 and out[800]["score"] == out[801]["score"]
    want = dict(brute.quality([(r["doc_id"], r["text"]) for r in frame.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] % 3 == 1]))
    assert all(abs(out[d]["score"] - s) < 1e-6 for d, s in want.items())
    again = frame.unionByName(frame.where("doc_id in (4, 5)"))  # repeated rows teach again and are scored again
    twice = quality.classify(again, labels, train_on=lambda c: c % 3 == 1)
    want = dict(brute.quality([(r["doc_id"], r["text"]) for r in again.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] % 3 == 1]))
    assert twice.count() == 406 and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in twice.collect())
    assert quality.classify(frame.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.classify(frame, labels.limit(0)).collect()} == {0.5}
