import random

from brute import quality
from pyspark.sql import functions as F

from verdictlake.llm.quality import STATISTICS, Rule, order_rules, quality_cascade, rules, statistics


def texts():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)] + ["É|x", "#a*", "日本"]
    out = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n \n", "a\x0bb\x0cc\rd", "a a a a a", " a b"]
    out += [" ".join(r.choices(vocabulary, k=r.randint(1, 200))) for _ in range(40)]
    out.append("\n".join(["same line here"] * 30))
    out.append(" ".join(r.choices(vocabulary, k=40_000)))
    return out


def test_statistics_match_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    got = statistics(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality(rows[r.doc_id][1]), r.doc_id


def test_cascade_gives_the_same_verdict_by_text_and_by_columns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    lazy, full = ({r.doc_id: r.rejected_by is None for r in quality_cascade(docs, report=x).collect()} for x in ((), tuple(STATISTICS)))
    assert lazy == full
    assert not lazy[0] and not lazy[1]
    part = {r.doc_id: r.rejected_by for r in quality_cascade(docs, report=("n_words",), already=F.col("n_words") < 5).collect()}
    assert {i for i, x in part.items() if x is None} == {i for i, kept in lazy.items() if kept} and part[0] == "base"


def test_what_no_rule_reaches_is_not_made(spark):
    """A statistic that raises is made only for the row that passes the rules before it."""
    from verdictlake.llm import quality

    made = {"text": F.col("text"), "n_words": F.col("n")}
    stop = Rule("stop", "n_words > 5", ("n_words",))
    late = Rule("late", "n_symbols > 9", ("n_symbols",))
    former = quality.STATISTICS["n_symbols"]
    quality.STATISTICS["n_symbols"] = ("text", lambda t: F.when(t == "boom", F.raise_error(F.lit("made")).cast("int")).otherwise(0))
    try:
        docs = spark.createDataFrame([("boom", 9), ("fine", 1)], "text string, n long").repartition(1)
        assert [r[0] for r in docs.select(quality.cascade([stop, late], made)).collect()].count("stop") == 1
    finally:
        quality.STATISTICS["n_symbols"] = former


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "a b c " * 30) for i in range(50)], "doc_id long, text string")
    never, always = Rule("never", "n_words < 0", ("n_words",)), Rule("always", "n_words >= 0", ("n_words",))
    ordered = order_rules(docs, [never, always])
    assert [m[0].name for m in ordered] == ["always", "never"]
    assert [m[1] for m in ordered] == [1.0, 0.0]


def test_empty_table_repeated_rows_and_clash(spark):
    schema = "doc_id long, text string, rejected_by long"
    assert quality_cascade(spark.createDataFrame([], schema)).count() == 0
    twice = quality_cascade(spark.createDataFrame([(1, "a", 7), (1, "a", 7), (None, None, None)], schema))
    assert twice.count() == 3 and dict(twice.dtypes)["rejected_by"] == "string"


def test_junk_goes_and_clean_text_stays(spark):
    clean = "The quick brown fox went over the hill to see what the other animals had found there. "
    prose = " ".join(f"{clean.split()[i % 17]}{i}" for i in range(80))
    rows = [(1, prose), (2, " ".join(f"w{i}###" for i in range(80))), (3, " ".join(f"WORD{i}ABC!!" for i in range(80))), (4, "buy now " * 60)]
    got = {r.doc_id for r in quality_cascade(spark.createDataFrame(rows, "doc_id long, text string"), rules(3)).filter(F.col("rejected_by").isNull()).collect()}
    assert got == {1}
