"""Every query against its SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from verdictlake.plans import catalog, evaluation  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, data, name):
    frame = catalog.QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in frame.collect()], key=repr)
    if name not in catalog.SQL:
        assert got
        return
    db = duckdb.connect()
    db.sql("set timezone = 'UTC'")
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = db.sql(catalog.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in rel.fetchall()], key=repr)


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cjk_spans_of_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 30 + "中文 b 漢"), (4, "a" * 30 + "中")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["cjk_spans"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.spans) for r in got) == [(1, 2), (4, 2)]


def test_divergence_of_all_languages(spark, tmp_path):
    spark.createDataFrame([(1, "en", "s", 2), (2, "de", "s", 4)], "doc_id long, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (got,) = catalog.QUERIES["divergence"](spark, str(tmp_path)).collect()
    assert (got.complete_delta_pp, got.denial_delta_pp, got.evasive_delta_pp, got.total_abs_delta_pp) == (-50.0, 50.0, 0.0, 100.0)


def test_preference_pairs_round_half_to_even_and_put_nulls_last(spark, tmp_path):
    # 2.5 is 2 as in SQL, so it ties with 2.4 and the smaller id wins; a null is never the shortest
    rows = [(0, 0, 2.5), (3, 0, 2.4), (1, 0, None), (4, 0, 7.0), (2, 0, 0.5), (5, 0, 0.4), (6, 3, None), (7, 3, None), (10, 3, 1.0)]
    where = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(where)
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{where}/*.parquet'")
    columns = "id, expected, chosen, rejected_label, rejected, n_wrong, boundary"
    want = sorted(db.sql(f"select {columns} from ({catalog.SQL['preference_pairs']})").fetchall())
    got = sorted(map(tuple, catalog.QUERIES["preference_pairs"](spark, str(tmp_path)).select(*columns.split(", ")).collect()))
    assert got == want
    assert (0, "COMPLETE", "0", "DENIAL", "4", 2, "COMPLETE->DENIAL") in got
