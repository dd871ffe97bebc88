import numpy as np
import pytest
from brute import components, line_dedup

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decisions_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "source mixing", "packing"]
    good = pipeline.materialize(stages["quality rules"](spark, docs, data), "t")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and not any(labels.get(i) == 0 for i in kept)
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())
    deduped = pipeline.materialize(stages["line dedup"](spark, good, data), "t")
    want = {i: t for i, _, n, t in line_dedup([(r.doc_id, r.text) for r in good.collect()]) if not n or t.strip(" \t\n\x0b\x0c\r")}
    assert deduped.columns == columns and {r.doc_id: r.text for r in deduped.collect()} == want
    single = pipeline.materialize(stages["near dedup"](spark, deduped, data), "t")
    roots = components(list(want.items()), 5, 80, 100)
    assert sorted(single.columns) == sorted(columns) and {r.doc_id for r in single.collect()} == {i for i, c in roots.items() if i == c}
    mixed = pipeline.materialize(stages["source mixing"](spark, single, data), "t")
    assert {r.doc_id for r in mixed.collect()} <= set(roots)
    packed = stages["packing"](spark, mixed, data).collect()
    assert sum(p.length for p in packed) == sum(p.doc_tokens for p in packed if p.start == 0)
    assert all(len(np.frombuffer(p.ids, np.uint32)) == p.length for p in packed)


def test_a_document_left_with_white_space_only_goes(spark, data):
    line = "a line that both have, whole"
    docs = spark.createDataFrame([(1, line), (2, f"{line}\n\t"), (3, "\t"), (4, None)], "doc_id long, text string").withColumn("n_chars", pipeline.F.length("text").cast("long"))
    out = {r.doc_id: r.n_chars for r in pipeline.lines(spark, docs, data).collect()}
    assert out == {1: len(line), 3: 1, 4: 0}


def test_run_equals_the_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, data)
        if i < 4:
            docs = pipeline.materialize(docs, "t")
    key = lambda rows: sorted((r.doc_id, r.start, r.length, bytes(r.ids)) for r in rows)
    assert key(pipeline.run(spark, data).collect()) == key(docs.collect())


def odd_documents(spark, data):
    """Clean texts among nulls, empty and long ones, repeated rows and ids, equal texts, and columns that stages add."""
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").filter("quality = 1").collect()}
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect() if r.doc_id in good]
    text = texts[0]
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, text), (None, text), (None, None), (5, "\n".join(texts[1:])), (6, texts[1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rejected_by string, n_lines int, N_DROPPED int"
    return rows, spark.createDataFrame([(i, t, "en", "web" if i != 4 else None, len(t or ""), f"r{n}", n, n) for n, (i, t) in enumerate(rows)], schema)


def test_stages_take_nulls_repeated_ids_long_texts_and_clashing_names(spark, data):
    rows, docs = odd_documents(spark, data)
    left = {}
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, data)
        assert sorted(out.columns) == sorted(docs.columns), name
        got = out.collect()
        left[name] = {r.n_lines: r.text for r in got}
        for r in got:
            assert (r.rejected_by, r.N_DROPPED, r.doc_id) == (f"r{r.n_lines}", r.n_lines, rows[r.n_lines][0]), name
            assert name == "line dedup" or r.text == rows[r.n_lines][1], name
    assert left["quality rules"].keys() >= {0, 1, 4, 5, 8} and not left["quality rules"].keys() & {2, 3, 6}
    assert left["line dedup"] == {n: t for n, (_, _, d, t) in enumerate(line_dedup(rows)) if not d or t.strip(" \t\n\x0b\x0c\r")}
    assert left["near dedup"].keys() == {0, 1, 2, 3, 5, 6, 7, 8}
    packed = pipeline.packing(spark, docs, data).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows}


def test_stages_take_an_empty_table(spark, data):
    docs = odd_documents(spark, data)[1].limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0, name
