"""Every registered query of the engine against its DuckDB equivalent."""

from __future__ import annotations

import duckdb
import pytest

from groundspark.plans import registry
from tests.conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, cols):
    return sorted(frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    have, want = query(spark, TINY).toPandas(), con.execute(sql).df()
    cols = sorted(have.columns)
    assert sorted(want.columns) == cols
    assert rows_of(have, cols) == rows_of(want, cols)


#: Whole jobs that test_whole.py compares with plain Python.
ELSEWHERE = {f"{n}_whole" for n in ("hybrid_search", "rrf_fuse", "rerank", "hash_embedding", "claim_alignment", "claim_status", "pagerank", "sentence_split", "stem_tokens", "token_estimate", "semantic_chunks", "entity_candidates")}


@pytest.mark.parametrize("name", sorted(set(registry.ORACLES) - ELSEWHERE))
def test_equals_sql(spark, name):
    compare(spark, (registry.QUERIES | registry.WHOLE)[name], registry.ORACLES[name])


def test_all_queries_have_sql():
    assert set(registry.QUERIES | registry.WHOLE) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["semantic_chunks", "semantic_chunks_whole"])
def test_chunks_end_at_headings_in_sql_too(spark, tmp_path, name):
    long = " ".join(f"Sentence {i} tells of rivers and of stones in them." for i in range(60))
    texts = [f"{long}\n## Next part\n{long}\nfew left", f"ж### folded ж\n{long}", "# Only\r\n## headings here and there", f"Before it all ends.\n \t# A\n# B\n\n### C d\nAfter it all begins anew.\n#none\n####### nor this one", "###\n\u2028# x\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    have, want = (registry.QUERIES | registry.WHOLE)[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert rows_of(have, sorted(have.columns)) == rows_of(want, sorted(have.columns)) and len(have) > 10


@pytest.mark.parametrize("name", ["markdown_sections", "markdown_sections_whole"])
def test_sections_of_blank_texts_and_odd_titles_in_sql_too(spark, tmp_path, name):
    texts = ["Plain words.", "", None, " \n", "###", "ж", "\u3000", "Two\r\nlines # here."]
    rows = [(t, "en", "web") for t in texts] + [("Body.", lang, source) for lang in ("en", "", None, "e\nn", "# x", "\u2028") for source in ("web", "", " w ", "a#b ", "## y", None)]
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    have, want = (registry.QUERIES | registry.WHOLE)[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert rows_of(have, sorted(have.columns)) == rows_of(want, sorted(have.columns)) and len(have) > 72
