"""Generated answers as rows: claims cut out, refined and judged for completeness; rewards from replayed judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import claims as K
from threadloom.functions import scoring as C
from threadloom.functions import text as X


def with_refined(df: DataFrame, claims: Column, name: str) -> DataFrame:
    """Adds the claims as first sentences, alike ones represented by the most specific, two at most, numbered anew. Null claims give none."""
    steps = df.withColumn("__ranked", K.ranked(F.coalesce(claims, F.array().cast("array<string>"))))
    steps = steps.withColumn("__kept", K.representatives(F.col("__ranked")))
    return steps.withColumn(name, K.numbered(F.transform(K.fewest(F.col("__kept")), lambda c: c["text"]))).drop("__ranked", "__kept")


def with_claims_state(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds whether an answer of claims is complete, or the first thing that is wrong with it."""
    steps = df.withColumn("__lines", K.claim_lines(text)).withColumn("__words", F.transform("__lines", lambda x: K.concepts(x["body"])))
    return steps.withColumn(name, K.claims_state(text, F.col("__lines"), F.col("__words"))).drop("__lines", "__words")


def with_claims_answer(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the claims of a generated text: None for none, else the first block of claim lines refined, else the text before it goes astray. Null stays null."""
    steps = df.withColumn("__t", K.before_stop(X.strip(text), "claims")).withColumn("__block", K.claim_block(F.col("__t")))
    steps = with_refined(steps, F.transform("__block", lambda x: F.regexp_extract(x, K.CLAIM_LINE, 2)), "__refined")
    some = F.when(F.size("__refined") > 0, F.col("__refined")).otherwise(F.col("__block"))
    told = F.when(F.lower("__t") == "none", "None").when(F.size("__block") > 0, F.array_join(some, "\n")).otherwise(F.col("__t"))
    return steps.withColumn(name, told).drop("__t", "__block", "__refined")


def judged(scores: DataFrame, key: str, weight: Column, every: bool) -> DataFrame:
    """scores (key, score of 1 to 5 or null where the judge failed): weighted mean of the known ones as 0 to 1, and whether it counts.

    every: only if all are known; else one is enough. Weights of 0 in sum give 0.5 and count.
    """
    known = F.col("score").isNotNull()
    sums = scores.groupBy(key).agg(F.count("*").alias("n"), F.count("score").alias("k"), F.sum(F.when(known, weight)).alias("w"), F.sum(F.col("score") * weight).alias("sw"))
    mean = F.when(F.col("k") == 0, 0.0).when(F.col("w") == 0, 0.5).otherwise(C.clamp(C.unit(F.col("sw") / F.nullif(F.col("w"), F.lit(0)))))
    ok = (F.col("k") > 0) & ((F.col("w") == 0) | (F.col("k") == F.col("n")) | F.lit(not every))
    return sums.select(key, mean.alias("value"), ok.alias("ok"))


def reward_claims(answers: DataFrame, soft: DataFrame, cover: DataFrame, alpha: float = 0.8) -> DataFrame:
    """Rewards of answers of claims.

    answers (id, solution, truth), soft (id, weight, score), cover (id, score), one row per claim of the truth; scores 1 to 5,
    null where the judge failed. Thinking is stripped, a failed gate gives 0, a degenerate answer its base score; else the
    blend of soft score and coverage times prior, penalty and form. Without soft scores only coverage counts, without truth
    or coverage only the soft score, without both the reward is 0.
    """
    raw = F.col("raw")
    a = answers.select("id", C.without_thinking(F.coalesce("solution", F.lit(""))).alias("raw"), F.lower(X.strip(F.coalesce("truth", F.lit("")))).alias("truth"))
    a = a.withColumn("text", C.cut_claims(raw)).withColumn("bodies", C.claim_bodies(F.col("text"))).withColumn("all_bodies", C.claim_bodies(X.strip(raw)))
    a = a.withColumns({"gate": C.gate_of_claims(raw, F.col("all_bodies")), "base": C.base_score(F.col("text")), "n": C.claim_count(F.col("text"))})
    a = a.withColumns({"prior": C.count_prior(F.col("n")), "penalty": C.repetition_penalty(raw, 2), "form": C.form_of_claims(F.col("bodies"))})
    s = judged(soft, "id", F.col("weight"), True).select("id", F.col("value").alias("soft"), F.col("ok").alias("soft_ok"))
    g = judged(cover, "id", F.lit(1.0), True).select("id", F.col("value").alias("cover"), F.col("ok").alias("cover_ok"))
    a = a.join(s, "id", "left").join(g, "id", "left").fillna({"soft": 0.0, "cover": 0.0, "soft_ok": False, "cover_ok": False})
    has_truth = ~F.col("truth").isin("", "none")
    a = a.withColumn("alpha", F.when(~F.col("soft_ok") & ~F.col("cover_ok"), None).when(~F.col("soft_ok"), 0.0).when(~has_truth | ~F.col("cover_ok"), 1.0).otherwise(alpha))
    blend = F.col("alpha") * F.col("soft") + (1 - F.col("alpha")) * F.col("cover")
    total = F.when(~F.col("gate"), 0.0).when(F.col("base").isNotNull(), F.col("base")).otherwise(F.coalesce(C.clamp(blend * F.col("prior") * F.col("penalty") * F.col("form")), F.lit(0.0)))
    return a.select("id", "gate", "base", "n", "soft", "soft_ok", "cover", "cover_ok", "alpha", "prior", "penalty", "form", total.alias("reward"))


def reward_analyses(answers: DataFrame, soft: DataFrame) -> DataFrame:
    """answers (id, solution), soft (id, weight, score): soft score times penalty times form; a failed gate and a judge that failed everywhere give 0."""
    a = answers.select("id", C.without_thinking(F.coalesce("solution", F.lit(""))).alias("raw"))
    a = a.withColumn("text", C.cut_analysis(F.col("raw")))
    a = a.withColumns({"gate": C.hard_gate_analysis(F.col("raw")), "penalty": C.repetition_penalty(F.col("text"), 1), "form": C.format_analysis(F.col("text"))})
    s = judged(soft, "id", F.col("weight"), False).select("id", F.col("value").alias("soft"), F.col("ok").alias("soft_ok"))
    a = a.join(s, "id", "left").fillna({"soft": 0.0, "soft_ok": False})
    total = F.when(F.col("gate") & F.col("soft_ok"), C.clamp(F.col("soft") * F.col("penalty") * F.col("form"))).otherwise(0.0)
    return a.select("id", F.length("text").alias("n_chars"), "gate", "soft", "soft_ok", "penalty", "form", total.alias("reward"))
