import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdictlake.operators import metrics, rank, recon, sampling, scores, votes
from verdictlake.sources import jsonl


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_qualification_example(spark):
    pairs = [("COMPLETE", "COMPLETE"), ("DENIAL", "COMPLETE"), ("EVASIVE", "ERROR_JUDGE_CONTENT_FILTER"), ("COMPLETE", "DENIAL"), ("DENIAL", "ERROR_JUDGE_FORMAT")]
    r = metrics.qualification(spark.createDataFrame(pairs, "expected string, observed string")).first()
    assert (r.total_correct, r.complete_binary_correct, r.complete_recall_pct, r.false_complete, r.missed_complete, r.net_complete_bias) == (1, 3, 50.0, 1, 1, 0)
    assert (r.unparseable, r.error_count, r.content_filter) == (1, 2, 1)


def test_exclusions_by_question_or_hash_with_contact(spark):
    rows = spark.createDataFrame([("a::1", "1", "alpha"), ("b::1", "1", "beta"), ("c::2", "2", "alpha"), ("d::3", "3", "delta")], "key string, question_id string, response_hash string")
    gold = spark.createDataFrame([("1", "alpha")], "question_id string, response_hash string")
    artifacts = spark.createDataFrame([("3", None, "t1"), (None, "delta", "t0"), ("1", None, "t1")], "question_id string, response_hash string, tag string")
    got = {r.key: (r.excluded_by, r.contact) for r in recon.apply_exclusions(rows, gold, artifacts).collect()}
    assert got == {"a::1": ("question_id", ["t1"]), "b::1": ("question_id", ["t1"]), "c::2": ("response_hash", []), "d::3": (None, ["t0", "t1"])}


def test_strict_alignment_raises(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, label string")
    assert recon.align_strictly(a, a, "id", "label").count() == 2
    for other in ([(1, "x")], [(1, "x"), (2, "z")], [(1, "x"), (2, "y"), (3, "y")]):
        with pytest.raises(ValueError):
            recon.align_strictly(a, spark.createDataFrame(other, "id int, label string"), "id", "label")
    with pytest.raises(ValueError):
        recon.assert_same_keys(a, a.filter("id = 1"), "id")


def test_votes_ties_and_flags(spark):
    r = [(1, "COMPLETE", x, False) for x in ("COMPLETE", "DENIAL", "DENIAL", "COMPLETE")] + [(2, "DENIAL", x, True) for x in ("EVASIVE", "EVASIVE", "UNPARSED")]
    got = {x.id: x for x in votes.votes(spark.createDataFrame(r, "id int, expected string, observed string, is_truncated boolean")).collect()}
    assert got[1].plurality is None and got[1].mixed_reward and got[1].votes == {"COMPLETE": 2, "DENIAL": 2} and got[1].entropy == 1.0
    assert (got[2].plurality, got[2].parseable, got[2].all_wrong_reward, got[2].all_binary_wrong_reward, got[2].truncated_rollouts) == ("EVASIVE", 2, True, False, 3)
    v = votes.votes(spark.createDataFrame(r, "id int, expected string, observed string, is_truncated boolean"))
    assert [x.id for x in v.filter(votes.countable("mixed")).collect()] == [1]


def test_kappa_and_jaccard_edges(spark):
    f = lambda rows: spark.createDataFrame(rows, "a boolean, b boolean").agg(metrics.kappa(F.col("a"), F.col("b")).alias("k"), metrics.refusal_jaccard(F.col("a"), F.col("b")).alias("j")).first()
    assert tuple(f([(True, True), (True, True)])) == (None, 1.0)
    assert tuple(f([(False, False)])) == (None, 1.0)
    assert f([]).k is None
    r = f([(True, True), (True, False), (False, False), (False, False)])
    assert math.isclose(r.k, 0.5) and r.j == 0.5


@pytest.mark.parametrize("values", [[1, 1, 2, 5, 5, 5, 9], [3.5], [0.0, -1.5, 2.5, 2.5], [random.Random(1).randint(0, 500) for _ in range(700)]])
def test_midrank_and_index_percentiles(spark, values):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.p for r in rank.midrank_percentile(frame, "v", "p").collect()}
    for i, v in enumerate(values):
        assert math.isclose(got[i], (sum(x < v for x in values) + 0.5 * sum(x == v for x in values)) / len(values))
    r = rank.index_percentile(frame, "v", (0.5, 0.9)).first()
    assert tuple(r) == tuple(sorted(values)[int((len(values) - 1) * q)] for q in (0.5, 0.9))


def test_allocation_and_caps(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n long")
    assert {r.k: r.allocated for r in sampling.allocate(counts, "k", F.col("n").cast("double"), 10).collect()} == {"a": 3, "b": 3, "c": 4}
    assert {r.k: r.allocated for r in sampling.split_evenly(counts, "k", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    models = spark.createDataFrame([("m1", 10), ("m2", 3), ("m3", 1)], "m string, n long")
    assert sampling.relaxed_cap(models, "n", 8, 2).first().cap == 4
    assert sampling.relaxed_cap(models, "n", 99, 2).first().cap == 99


def test_greedy_selection_matches_a_loop(spark):
    r = random.Random(2)
    rows = [(i, f"q{r.randint(0, 9)}", f"m{r.randint(0, 4)}", r.random()) for i in range(300)]
    want, q, m = [], Counter(), Counter()
    for i, a, b, _ in sorted(rows, key=lambda x: x[3]):
        if len(want) < 25 and q[a] < 3 and m[b] < 6:
            want.append(i)
            q[a] += 1
            m[b] += 1
    frame = spark.createDataFrame(rows, "id int, q string, m string, o double")
    got = sampling.select_capped(frame, [F.col("o")], {"q": 3, "m": 6}, 25, "id").orderBy("pick").collect()
    assert [x.id for x in got] == want


def test_samples_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(i, f"s{i % 3}", f"l{i % 2}") for i in range(120)], "id int, s string, l string")
    for f in (lambda d: sampling.stratified_sample(d, ["s"], 20, "x", "id"), lambda d: sampling.balanced(d, ["s", "l"], "x", "id", 5), lambda d: sampling.disjoint_splits(d, ["s"], {"a": 5, "b": 9}, "x", "id"), lambda d: sampling.weighted_sample(d, F.col("id") + 1.0, 15, "x", "id"), lambda d: sampling.select_with_leftovers(d, ["s"], 50, "x", "id")):
        assert rows_of(f(frame)) == rows_of(f(frame.repartition(7)))
    splits = sampling.disjoint_splits(frame, ["s"], {"a": 5, "b": 9}, "x", "id")
    assert sampling.overlap_report(splits, "split", "id").count() == 0 and splits.count() == 42


def test_ratio_mix_and_batches(spark):
    frame = spark.createDataFrame([(i, "EVASIVE") for i in range(9)] + [(10 + i, "COMPLETE") for i in range(3)] + [(20 + i, "DENIAL") for i in range(5)], "id int, l string")
    got = Counter((r.round, r.l) for r in sampling.mix_by_ratio(frame, "l", {"EVASIVE": 2, "COMPLETE": 1, "DENIAL": 1}, "x", "id").collect())
    assert got == {(k, name): n for k in range(3) for name, n in (("EVASIVE", 2), ("COMPLETE", 1), ("DENIAL", 1))}
    assert sampling.mix_by_ratio(frame.filter("l <> 'DENIAL'"), "l", {"EVASIVE": 2, "COMPLETE": 1, "DENIAL": 1}, "x", "id").count() == 0
    items = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 5, 9, 1, 1, 1, 30])], "p int, i int, tokens int")
    batches = {r.i: r.batch for r in sampling.padded_batches(items, ["p"], [F.col("i")], "tokens", 3, 18).collect()}
    assert [batches[i] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3]


def test_scores(spark):
    frame = spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 0.0, 0.0)], "a double, b double, c double")
    cols = [F.col(x) for x in "abc"]
    assert [r.x for r in frame.select(scores.argmax(cols).alias("x")).collect()] == ["COMPLETE", "COMPLETE"]
    assert [round(r.z, 6) for r in frame.select(scores.normalize(cols, "z")[0].alias("z")).collect()] == [0.707107, 0.0]
    p = frame.select(scores.softmax(F.array(F.lit(0.0), F.lit(None), F.log(F.lit(3.0)))).alias("p")).first().p
    assert p[1] is None and math.isclose(p[2], 0.75)
    assert [r.x for r in scores.grid(spark, "x", -0.2, 0.2, 0.1).orderBy("x").collect()] == [-0.2, -0.1, 0.0, 0.1, 0.2]


def test_choose_wrong_label(spark):
    rows = [(1, "DENIAL", "COMPLETE", 2), (1, "DENIAL", "EVASIVE", 2), (2, "COMPLETE", "DENIAL", 2), (2, "COMPLETE", "EVASIVE", 2), (3, "DENIAL", "EVASIVE", 3), (3, "DENIAL", "COMPLETE", 1)]
    got = {r.id: (r.rejected_label, r.reason) for r in sampling.choose_wrong_label(spark.createDataFrame(rows, "id int, adjudicated string, label string, n int"), "id", "adjudicated", "label", "n").collect()}
    assert got == {1: ("COMPLETE", "tie_prefer_complete_boundary"), 2: ("EVASIVE", "tie_complete_canonical_prefer_evasive_boundary"), 3: ("EVASIVE", "policy_frequency")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","question":"x","more":5}\n\nnot json\n{"id":"2"}\n{"id":"1","question":"y"}\n')
    path = str(tmp_path / "a.jsonl")
    got = jsonl.read_jsonl(spark, path, "id string, question string", ("id", "question"), with_position=True)
    assert sorted((r.id, r.question, r._line) for r in got.collect()) == [("1", "x", 1), ("1", "y", 5)]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0
    assert [r._line for r in jsonl.malformed_lines(spark, path).collect()] == [3]
    with pytest.raises(ValueError, match="malformed"):
        jsonl.assert_decodes(spark, path)
    assert [jsonl.load(got, ["id"], p).first().question for p in ("first", "last")] == ["x", "y"]
    with pytest.raises(ValueError, match="duplicate"):
        jsonl.load(got, ["id"], "error")
    timed = spark.createDataFrame([("1", "2024", 3), ("1", "2025", 1), ("1", "2025", 2)], "id string, timestamp string, _line int")
    r = jsonl.load(timed, ["id"], "latest", ["_line"]).first()
    assert (r.timestamp, r._line) == ("2025", 1)
    out = str(tmp_path / "out")
    jsonl.write_jsonl(got.select("id", "question"), out)
    assert jsonl.round_trip(got.select("id", "question"), jsonl.read_jsonl(spark, out, "id string, question string")).first() == (0, 0, 0)


def test_reasons_and_files(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "ok")], "id int, t string")
    kept, counts = jsonl.scan_with_reasons(frame, [("null", F.col("t").isNull()), ("empty", F.col("t") == "")])
    assert [r.id for r in kept.collect()] == [3] and rows_of(counts) == [("empty", 1), ("null", 1)]
    files = spark.createDataFrame([("f1", "us_hard_x.jsonl")], "file string, name string")
    sets = spark.createDataFrame([("us",), ("us_hard",), ("uk",)], "stem string")
    assert jsonl.infer_question_set(files, sets).first().stem == "us_hard"
    catalog = spark.createDataFrame([("m", [("p1", "a", 1), ("p2", "b", 5)])], "canonical_name string, providers array<struct<provider_name:string,provider_model_id:string,priority:int>>")
    assert jsonl.resolve_model(catalog, F.lit("m")).first().provider_model_id == "b"
    assert jsonl.resolve_model(catalog, F.lit("m"), F.lit("p1")).first().provider_model_id == "a"


def test_follow_judges_only_what_is_new(spark, tmp_path):
    from verdictlake.streaming.follow import follow

    source, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    schema = "id string, ts string, text string"
    run = lambda: follow(spark.readStream.schema(schema).json(source), sink, lambda b: b.withColumn("label", F.upper("text")), ["id"], "ts", str(tmp_path / "state")).awaitTermination()
    spark.createDataFrame([("1", "a", "x"), ("2", "a", "y")], schema).write.json(source)
    run()
    spark.createDataFrame([("1", "a", "x"), ("2", "b", "z"), ("3", "a", "w")], schema).write.mode("append").json(source)
    run()
    got = sorted((r.id, r.ts, r.label) for r in spark.read.parquet(sink).collect())
    assert got == [("1", "a", "X"), ("2", "a", "Y"), ("2", "b", "Z"), ("3", "a", "W")]


def test_staged_sample_keeps_caps_and_strata_apart(spark):
    r = random.Random(5)
    rows = [(f"k{i}", f"q{r.randint(0, 39)}", f"m{r.randint(0, 9)}", ("COMPLETE", "DENIAL", "EVASIVE")[r.randint(0, 2)], r.random()) for i in range(600)]
    frame = spark.createDataFrame(rows, "key string, question string, model string, label string, w double")
    stages = [sampling.Stage("random", x, F.col("label") == x, F.lit(1.0), 20) for x in ("COMPLETE", "DENIAL", "EVASIVE")] + [sampling.Stage("tail", "heavy", F.col("w") > 0.5, F.col("w"), 30)]
    got = sampling.staged_sample(frame, stages, key="key", question="question", model="model", question_cap=3, model_fraction=0.1).collect()
    assert Counter((x.stratum, x.component) for x in got) == {("random", "COMPLETE"): 20, ("random", "DENIAL"): 20, ("random", "EVASIVE"): 20, ("tail", "heavy"): 30}
    assert len({x.key for x in got}) == 90 and max(Counter(x.question for x in got).values()) <= 3
    assert max(Counter(x.model for x in got if x.stratum == "random").values()) <= 8
    for x in got:
        assert math.isclose(x.sampling_weight, x.frame / (30 if x.stratum == "tail" else 20))
    again = sampling.staged_sample(frame.repartition(5), stages, key="key", question="question", model="model", question_cap=3, model_fraction=0.1).collect()
    assert {x.key for x in again} == {x.key for x in got}


def test_greedy_selection_where_one_cap_blocks_another(spark):
    rows = [(i, "q0", "m0", float(i)) for i in range(50)] + [(50 + i, "q1", f"m{i % 2}", 50.0 + i) for i in range(10)]
    got = sampling.select_capped(spark.createDataFrame(rows, "id int, q string, m string, o double"), [F.col("o")], {"m": 4, "q": 2}, 6, "id").orderBy("pick").collect()
    assert [x.id for x in got] == [0, 1, 50, 51]


def test_theta_first_is_theta_best_and_meets_no_offer_with_all_profiles(spark):
    offers = spark.range(400).selectExpr("id AS offer", "concat('b', id % 3) AS text", "nullif(id * 7 % 11, 4) AS need", "1.0 + id % 5 AS price")
    profiles = spark.range(200).selectExpr("id AS tie", "concat('^b[', id % 4, id % 2, ']$') AS pattern", "cast(nullif(id * 5 % 13, 6) AS double) AS have", "id % 6 AS kind")
    cost = F.col("price") * (F.col("kind") % 3)
    got = recon.theta_first(offers, profiles, "text", "pattern", F.col("need"), F.col("have"), ["kind"], cost, "tie", "offer")
    want = recon.theta_best(offers, profiles, "text", "pattern", F.col("have") >= F.col("need"), [cost, F.col("tie")], "offer")
    rows = sorted((r.offer, r.tie, r.kind) for r in got.collect())
    assert rows == sorted((r.offer, r.tie, r.kind) for r in want.collect()) and len(rows) > 200
    # 20 times the profiles, which would be 20 times the pairs: the rows that reach an offer stay
    many = profiles.crossJoin(spark.range(20).toDF("copy")).withColumn("tie", F.col("tie") + 1000 * F.col("copy")).drop("copy")
    again = recon.theta_first(offers, many, "text", "pattern", F.col("need"), F.col("have"), ["kind"], cost, "tie", "offer")
    assert sorted((r.offer, r.tie, r.kind) for r in again.collect()) == rows
    plan = again._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan and "Window" in plan
