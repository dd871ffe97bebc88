import math
from collections import Counter

from verdictlake.llm.mixing import mix_sources
from verdictlake.llm.queries import OP10_SQL, op10_mixing


def docs(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else "small" if i % 2 else None) for i in range(6000)] + [(9999, "x", "tiny")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_sources_take_their_target_shares(spark):
    frame, rows = docs(spark)
    out = mix_sources(frame, {"big": 0.2, "small": 0.6, "tiny": 0.2}, epochs=2.0).collect()
    got = Counter(r.source for r in out)
    total = 2 * len(rows)
    for name, share in (("big", 0.2), ("small", 0.6), ("tiny", 0.2)):
        assert abs(got[name] - share * total) < 5 * math.sqrt(share * total) + 1, (name, got)
    assert None not in got


def test_counts_are_poisson_and_stable(spark):
    frame, _ = docs(spark)
    one = Counter(r.doc_id for r in mix_sources(frame, alpha=1.0).collect())
    two = Counter(r.doc_id for r in mix_sources(frame.repartition(7), alpha=1.0).collect())
    assert one == two
    zero = 6001 - len(one)
    assert abs(zero / 6001 - math.exp(-1)) < 0.03
    assert abs(sum(one.values()) / 6001 - 1) < 0.06


def test_copies_repeated_rows_nulls_and_clashes(spark):
    rows = [(1, None, "a", 5), (1, None, "a", 5), (None, "x", "a", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, Copy int")
    out = mix_sources(frame, epochs=30.0, copy_column="copy")
    assert out.columns == ["doc_id", "text", "source", "copy"]
    got = Counter((r.doc_id, r["copy"]) for r in out.collect())
    assert set(got[k] for k in got if k[0] == 1) == {2} and any(k[0] is None for k in got)
    assert mix_sources(frame.limit(0)).count() == 0


def test_order_is_shuffled(spark):
    frame, _ = docs(spark)
    ids = [r.doc_id for r in mix_sources(frame, alpha=1.0).collect()]
    rising = sum(a <= b for a, b in zip(ids, ids[1:], strict=False)) / len(ids)
    assert 0.45 < rising < 0.75


def test_query_matches_sql(spark, data):
    import duckdb

    got = sorted((r.doc_id, r["copy"]) for r in op10_mixing(spark, data).collect())
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{data}/documents.parquet'")
    assert got == sorted(db.sql(f'select doc_id, "copy" from ({OP10_SQL})').fetchall())
