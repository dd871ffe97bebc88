import itertools
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.operators import brackets, report, sampling, scores, surveys
from verdictlake.sources import numbered

LABELS = ["COMPLETE", "DENIAL", "EVASIVE", "OTHER", None]


def score_rows(seed, n):
    r = random.Random(seed)
    score = lambda: r.choice([r.random(), r.randint(0, 8) / 8])  # noqa: E731  (many ties with the grid)
    return [(r.choice("ab"), r.choice(LABELS), *[score() for _ in range(3)]) for _ in range(n)]


def test_bias_search_equals_the_search_that_scores_every_row(spark):
    frame = spark.createDataFrame(score_rows(1, 300), "g string, expected string, c double, d double, e double")
    three = [F.col(x) for x in "cde"]
    complete, evasive = [-0.5, -0.25, 0.0, 0.25, 0.5], [-0.25, -0.125, 0.0, 0.125]
    params = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(itertools.product(complete, evasive))], "n long, complete_bias double, evasive_bias double")
    predicted = scores.argmax([F.col("c") + F.col("complete_bias"), F.col("d") + 0.125, F.col("e") + F.col("evasive_bias")])
    for objective in ("total", "complete", "complete_low_fp"):
        old = scores.search(frame, params, ["complete_bias", "evasive_bias"], predicted, "expected", objective, ["g"]).orderBy("g").collect()
        new = scores.bias_search(frame, three, "expected", complete, evasive, 0.125, group=["g"], objective=objective).drop("weight").orderBy("g").collect()
        assert [r.asDict() for r in new] == [r.asDict() for r in old]
    folds = scores.biases_out_of_fold(frame, three, "expected", complete, evasive, "g", 0.125).orderBy("g").collect()
    for row, other in zip(folds, "ba", strict=True):
        own = scores.search(frame.filter(F.col("g") == other), params, ["complete_bias", "evasive_bias"], predicted, "expected").first()
        assert (row.n, row.correct, row.fp) == (own.n, own.correct, own.fp)


def test_bias_search_of_blends_null_groups_and_nulls(spark):
    rows = [(None if i % 3 else "x", e, c, None if i == 5 else d, s) for i, (_, e, c, d, s) in enumerate(score_rows(2, 60))]
    frame = spark.createDataFrame(rows, "g string, expected string, c double, d double, e double")
    first, second = [F.col(x) for x in "cde"], [F.col(x) for x in "ecd"]
    got = {(r.g, r.n): r for r in scores.bias_counts(frame, first, "expected", [0.0, 0.3], [-0.3, 0.0, 0.3], second=second, weights=[0.0, 0.5, 1.0], group=["g"]).collect()}
    assert len(got) == 2 * 3 * 6
    for (g, n), r in got.items():
        w, i = divmod(n, 6)
        weight, cb, eb = w / 2, [0.0, 0.3][i // 3], [-0.3, 0.0, 0.3][i % 3]
        assert (r.weight, r.complete_bias, r.evasive_bias) == (weight, cb, eb)
        seen = Counter()
        for own, expected, c, d, e in rows:
            if own == g and expected is not None and d is not None:
                s = [weight * c + (1 - weight) * e + cb, weight * d + (1 - weight) * c, weight * e + (1 - weight) * d + eb]
                best = next(k for k in range(3) if s[k] >= max(s) - 1e-9)
                seen[expected, LABELS[best]] += 1
        assert r.correct == sum(v for (a, b), v in seen.items() if a == b)
        assert r.fp == sum(v for (a, b), v in seen.items() if a != "COMPLETE" and b == "COMPLETE")
        assert r.binary == sum(v for (a, b), v in seen.items() if (a == "COMPLETE") == (b == "COMPLETE"))
    with pytest.raises(ValueError, match="bias_search"):
        scores.search(frame, spark.range(3000).withColumnRenamed("id", "n"), [], F.lit("COMPLETE"), "expected")


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *"abcdefgh"]), r.choice("xyz"), r.choice([r.random(), 0.5])) for i in range(400)]
    caps, target = [({"q": 3, "m": 9}, 200), ({"q": 1, "m": 40}, 9), ({"q": 50, "m": 60}, 150), ({"q": 2}, 5)][seed]
    want, used = [], {c: Counter() for c in caps}
    for row in sorted(rows, key=lambda x: (x[3], x[0])):
        values = dict(zip(("q", "m"), row[1:3], strict=True))
        if len(want) < target and all(used[c][values[c]] < cap for c, cap in caps.items()):
            want.append(row[0])
            for c in caps:
                used[c][values[c]] += 1
    frame = spark.createDataFrame(rows, "id int, q string, m string, o double")
    got = sampling.select_capped(frame, [F.col("o")], caps, target, "id").orderBy("pick").collect()
    assert [x.id for x in got] == want


def test_single_elimination(spark):
    r = random.Random(3)
    rows = [(q, i, r.randint(0, 99)) for q, n in (("a", 13), ("b", 1), (None, 6), ("c", 64)) for i in range(n)]
    wins = lambda left, right: (left * 7 + right * 3) % 5 < 3

    def champion(seats):
        while len(seats) > 1:
            seats = [s[0] if len(s) == 1 else s[0] if wins(s[0][1], s[1][1]) else s[1] for s in (seats[i : i + 2] for i in range(0, len(seats), 2))]
        return seats[0][0]

    frame = spark.createDataFrame(rows, "q string, i int, v int").repartition(5)
    got = {x.q: x for x in brackets.single_elimination(frame, "q", ["i"], lambda a, b: wins(a["v"], b["v"])).collect()}
    assert {q: x.i for q, x in got.items()} == {q: champion([(i, v) for p, i, v in rows if p == q]) for q in ("a", "b", None, "c")}
    assert (got["c"].matches_won, got["c"].byes, got["b"].matches_won, got["b"].byes, got["a"].candidates) == (6, 0, 0, 0, 13)
    assert got["a"].matches_won + got["a"].byes == 4
    assert brackets.single_elimination(frame.limit(0), "q", ["i"], lambda a, b: F.lit(True)).count() == 0
    ties = brackets.single_elimination(frame, "q", ["i"], lambda a, b: F.lit(None)).collect()
    assert {x.i for x in ties} == {0}


def test_survey_scores(spark):
    items = [("i1", "x", False), ("i2", "x", True), ("i3", None, None), ("i4", "x", False)]
    made = spark.createDataFrame([("s", (1, 5), items)], "name string, scale struct<min:int,max:int>, items array<struct<id:string,category:string,inversion:boolean>>")
    answers = spark.createDataFrame([(1, "s", {"i1": 4, "i2": 1, "i3": 3}), (2, "s", {"i1": 9, "i2": 2, "other": 1}), (3, "t", {"i1": 1}), (4, "s", None), (5, "s", {"i3": 1})], "respondent int, survey string, answers map<string,int>")
    got = {(r.respondent, r.category): (r["items"], r.answered, r.score) for r in surveys.survey_scores(answers, made).collect()}
    assert got == {(1, "x"): (3, 2, 4.5), (1, ""): (1, 1, 3.0), (2, "x"): (3, 1, None), (2, ""): (1, 0, None), (4, "x"): (3, 0, None), (4, ""): (1, 0, None), (5, "x"): (3, 0, None), (5, ""): (1, 1, 1.0)}


def test_lemmas(spark):
    cases = {"dogs": "dog", "classes": "class", "class": "class", "bus": "bus", "analysis": "analysis", "boxes": "box", "churches": "church", "wishes": "wish", "cities": "city", "ties": "tie", "wolves": "wolf", "women": "woman", "children": "child", "is": "is", "as": "as", "heroes": "hero", "physics": "physics", "a": "a", "s": "s"}
    frame = spark.createDataFrame(list(cases.items()), "w string, want string")
    assert [(r.w, r.got) for r in frame.select("w", "want", X.lemma(F.col("w")).alias("got")).filter("got <> want").collect()] == []
    row = spark.createDataFrame([("The Dogs' 3 cities, don't x2 Étoiles",), (None,), ("",)], "t string").select(X.lemmas(F.col("t"), ["the"]).alias("w")).collect()
    assert [r.w for r in row] == [["city", "étoile"], None, []]


def test_cross_table_and_matrix(spark):
    frame = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 8.0), (None, None, 4.0)], "r string, c string, v double")
    got = {x.r: x.asDict() for x in report.cross_table(frame, "r", "c", F.avg("v")).collect()}
    assert got == {"a": {"r": "a", "x": 1.0, "y": 3.0, "none": None, "total": 2.0}, "b": {"r": "b", "x": 8.0, "y": None, "none": None, "total": 8.0}, "none": {"r": "none", "x": None, "y": None, "none": 4.0, "total": 4.0}, "total": {"r": "total", "x": 4.5, "y": 3.0, "none": 4.0, "total": 4.0}}
    with pytest.raises(ValueError, match="over 1 values"):
        report.cross_table(frame, "r", "c", F.avg("v"), most=1)
    with pytest.raises(ValueError, match="over 2 rows"):
        report.markdown(frame, ["r"], most=2)
    labels = spark.createDataFrame([(1, "a", "X"), (1, "b", "X"), (2, "a", "X"), (2, "b", "Y"), (3, "a", "X")], "i int, j string, l string")
    assert sorted(tuple(r) for r in report.agreement_matrix(labels, "i", "j", "l").collect()) == [("a", 100.0, 50.0), ("b", 50.0, 100.0)]


def lines_of(spark, path, size):
    return sorted((r.line_number, r.line) for r in numbered.read_numbered(spark, path, size).collect())


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_are_numbered_whatever_the_ranges(spark, tmp_path, size):
    lines = ["", "a", "é" * 9, "{}", "x" * 40, "", "last without an end"]
    path = tmp_path / "one.jsonl"
    path.write_bytes("\n".join(lines).encode())
    assert lines_of(spark, str(path), size) == [(i + 1, x) for i, x in enumerate(lines)]
    bad = numbered.malformed(numbered.read_numbered(spark, str(path), size))
    assert sorted(r.line_number for r in bad.collect()) == [2, 3, 5, 7]


def test_replacing_lines_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda lines: spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)
    numbered.replace_lines(frame(["1", "2", "3", "4"]), path)
    assert sorted(x for _, x in lines_of(spark, path, 1 << 20)) == ["1", "2", "3", "4"]
    with pytest.raises(Exception, match="line break"):
        numbered.replace_lines(frame(["5", "6", "7", "8\n9"]), path)
    assert sorted(x for _, x in lines_of(spark, path, 1 << 20)) == ["1", "2", "3", "4"]
    assert os.listdir(tmp_path) == ["table"]  # nothing staged is left
    open(f"{path}.lock", "w").close()
    with pytest.raises(Exception, match="another writer"):
        numbered.replace_lines(frame(["5"]), path)
    assert sorted(os.listdir(tmp_path)) == ["table", "table.lock"]
    os.remove(f"{path}.lock")
    numbered.replace_lines(frame(["5"]), path)
    assert sorted(x for _, x in lines_of(spark, path, 1 << 20)) == ["5"]


def test_survey_scoring_deals_more_parts_as_lines_grow(spark, data, monkeypatch):
    from verdictlake.plans import extras

    want = sorted(map(tuple, extras.survey_scoring(spark, data).collect()), key=repr)
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(extras, "_LINES_A_TASK", lines // 16)
    out = extras.survey_scoring(spark, data)
    assert "hashpartitioning(l_orderkey#" in out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect()), key=repr) == want
