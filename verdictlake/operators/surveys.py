"""Scores of Likert surveys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def survey_scores(answers: DataFrame, surveys: DataFrame, *, most_gaps: float = 0.5) -> DataFrame:
    """Section 2.15: respondent, survey, category, items, answered, score: the mean of a category's items for each respondent.

    answers has respondent, survey and a map from item id to value; surveys has name, scale (min, max) and items (id,
    category, inversion).  An item counts where the answer lies on the scale; an inverted one counts min + max - value.
    Items without a category are the category ''.  The score is null where more than `most_gaps` of the items are gaps.  Answers to
    items that the survey doesn't have, and to surveys that aren't there, have no part; a null map is all gaps.
    """
    items = surveys.select(F.col("name").alias("survey"), F.col("scale.min").alias("_low"), F.col("scale.max").alias("_high"), F.explode("items").alias("_item"))
    per_survey = items.groupBy("survey", "_low", "_high").agg(F.collect_list("_item").alias("_items"))  # as long as the survey
    each = answers.join(per_survey, "survey").select("respondent", "survey", "_low", "_high", "answers", F.explode("_items").alias("_item"))
    given = F.try_element_at("answers", F.col("_item.id"))
    value = F.when(given.between(F.col("_low"), F.col("_high")), F.when(F.coalesce("_item.inversion", F.lit(False)), F.col("_low") + F.col("_high") - given).otherwise(given))
    grouped = each.select("respondent", "survey", F.coalesce("_item.category", F.lit("")).alias("category"), value.alias("_v")).groupBy("respondent", "survey", "category")
    out = grouped.agg(F.count(F.lit(1)).alias("items"), F.count("_v").alias("answered"), F.avg("_v").alias("_mean"))
    return out.select("respondent", "survey", "category", "items", "answered", F.when((F.col("answered") > 0) & (F.col("items") - F.col("answered") <= most_gaps * F.col("items")), F.col("_mean")).alias("score"))
