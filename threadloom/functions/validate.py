"""Validators of enhanced reviews, records, rubrics and candidates: all failures or the first one, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import rules
from threadloom.functions import text as X

# Limits and patterns below are fixed values.
SHORTEST = {"claim": 20, "evidence": 30, "what": 15, "where": 5, "how": 20, "expected_outcome": 15}
SECTION_REF = r"(?i)\b(?:Section|Sec\.?|Table|Tab\.?|Figure|Fig\.?|Appendix|App\.?)\s*[A-Za-z]?\d+(?:\.\d+)*\b"
VAGUE_PLACES = [r"(?i)\bin the paper\b", r"(?i)\brelevant section\b", r"(?i)\bappropriate section\b", r"(?i)\bsomewhere\b"]
PRIORITIES, SEVERITIES = ["critical", "high", "medium"], ["critical", "major", "moderate", "minor"]


def size(c: Column) -> Column:
    return F.length(X.strip(F.coalesce(c, F.lit(""))))


def review_issues(review: Column, sections: Column) -> Column:
    """Codes of everything wrong with a review struct; suggestions are numbered from 0."""
    s = F.coalesce(review["actionable_suggestions"], F.array())
    leaked = rules.leaks(F.concat_ws("\n", review["claim"], review["evidence"], F.to_json(review["actionable_suggestions"]), F.to_json(review["citations"])), "generation")

    def of_suggestion(x: Column, i: Column) -> Column:
        tag = lambda name: F.concat(F.lit("suggestion["), i.cast("string"), F.lit(f"].{name}"))
        short = [F.when(size(x[f]) < SHORTEST[f], tag(f)) for f in ("what", "where", "how", "expected_outcome")]
        vague = F.when(rules.column(("any", *VAGUE_PLACES), F.coalesce(x["where"], F.lit(""))), tag("where_banned_phrase"))
        return F.when(x.isNull(), F.array(tag("missing"))).otherwise(F.array(*short, F.when(~F.coalesce(x["priority"], F.lit("")).isin(PRIORITIES), tag("priority")), vague))

    own = F.array(
        F.when(size(review["claim"]) < SHORTEST["claim"], "claim"),
        F.when(review["evidence"].isNotNull() & (size(review["evidence"]) < SHORTEST["evidence"]), "evidence"),
        F.when(F.size(s) == 0, "actionable_suggestions"),
        F.when((F.coalesce(F.size(sections), F.lit(0)) <= 0) & F.coalesce(review["evidence"], F.lit("")).rlike(SECTION_REF), "evidence_hallucination"),
        F.when(leaked, "rebuttal_leakage"),
        F.when(~F.coalesce(review["severity"], F.lit("")).isin(SEVERITIES), "severity"),
        F.when(review["citations"].isNull(), "citations"),
    )
    return F.when(review.isNull(), F.array(F.lit("enhanced_review"))).otherwise(F.array_compact(F.concat(own, F.flatten(F.transform(s, of_suggestion)))))


#: Keys of a review and of its suggestions. Fixed values.
REVIEW_KEYS = ["claim", "evidence", "actionable_suggestions", "citations", "severity"]


def key_issues(keys: Column, allowed: list[str]) -> Column:
    """Keys that shouldn't be there and keys that should, each sorted; null keys mean none."""
    have, want = F.coalesce(keys, F.array().cast("array<string>")), F.lit(allowed)
    return F.struct(F.array_sort(F.array_except(have, want)).alias("extra"), F.array_sort(F.array_except(want, have)).alias("missing"))


def record_failure(review: Column, weakness: Column, category: Column, least: float) -> Column:
    """The first reason against a record, or null."""
    s = F.coalesce(review["actionable_suggestions"], F.array())
    missing = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), F.array_compact(F.array(*[F.when(X.blank(x[f]), F.lit(f)) for f in ("what", "where", "how", "expected_outcome", "priority")])).alias("f"))), lambda y: F.size(y["f"]) > 0)
    worst = F.try_element_at(missing, F.lit(1))
    told = F.lower(F.concat_ws("\n", review["claim"], review["evidence"], F.to_json(s)))
    return F.coalesce(
        F.when(review.isNull(), "missing enhanced_review"),
        F.when(X.blank(review["claim"]), "empty claim"),
        F.when(F.size(s) == 0, "no suggestions"),
        F.when(worst.isNotNull(), F.concat(F.lit("suggestion["), worst["i"].cast("string"), F.lit("] missing "), worst["f"][0])),
        F.when(X.blank(weakness), "empty original_weakness"),
        F.when(F.coalesce(category["l2_id"], F.lit("UNKNOWN")) == "UNKNOWN", "unclassified"),
        F.when(F.coalesce(category["confidence"], F.lit(0.0)) < least, "low confidence"),
        F.when(rules.leaks(told, "chat"), "rebuttal leakage"),
    )


def rubric_valid(soft: Column, hard: Column) -> Column:
    """Five or six soft requirements of known type with all fields, and two hard constraints with theirs."""
    full = lambda x, names: ~F.exists(F.array(*[x[n].isNull() for n in names]), lambda b: b)
    ok = F.size(soft).between(5, 6) & (F.size(hard) == 2)
    ok = ok & F.forall(soft, lambda x: full(x, ["requirement", "weight", "type", "rationale"]) & x["type"].isin("semantic", "format"))
    return F.coalesce(ok & F.forall(hard, lambda x: full(x, ["requirement", "rationale"])), F.lit(False))


def candidates_valid(candidates: Column) -> Column:
    """Exactly three, each with a text and a temperature."""
    return F.coalesce((F.size(candidates) == 3) & F.forall(candidates, lambda x: ~X.blank(x["text"]) & x["temperature"].isNotNull()), F.lit(False))


def item_valid(review: Column) -> Column:
    """A claim, suggestions with every field, and no talk of the rebuttal."""
    s = F.coalesce(review["actionable_suggestions"], F.array())
    whole = F.forall(s, lambda x: ~X.blank(x["what"]) & ~X.blank(x["where"]) & ~X.blank(x["how"]) & ~X.blank(x["expected_outcome"]) & ~X.blank(x["priority"]))
    told = F.concat_ws("\n", review["claim"], review["evidence"], F.to_json(review))
    return F.coalesce(~X.blank(review["claim"]) & (F.size(s) > 0) & whole & ~rules.leaks(told, "chat"), F.lit(False))


def analysis_state(c: Column) -> Column:
    """"Complete", or the first thing that is wrong with an analysis under headings."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)###\s*Suggestion\s+\d+.*?(?=###\s*Suggestion|##\s*Severity|\z)"), F.lit(0))
    lacking = lambda b, i: F.array_compact(F.array(*[F.when(~b.rlike(rf"(?i)(?:\*\*{f}\*\*|{f})\s*[:：]"), F.concat(F.lit("Suggestion "), (i + 1).cast("string"), F.lit(f" missing field: {f}"))) for f in ("What", "Where", "How", "Expected Outcome", "Priority")]))
    sections = [(r"(?i)##\s*Claim", "## Claim"), (r"(?i)##\s*Evidence", "## Evidence"), (r"(?i)###\s*Suggestion\s+\d+", "### Suggestion"), (r"(?i)##\s*Severity", "## Severity")]
    return F.coalesce(
        *[F.when(~F.coalesce(c, F.lit("")).rlike(p), f"Missing section: {name}") for p, name in sections],
        F.when(c.rlike(r"(?im)^\s*(?:user|assistant|system)\s*$"), "Contains stray role marker"),
        F.when(c.rlike(r"(?i)\[\s*TASK\s*[12]\s*\]"), "Contains stray task header"),
        F.try_element_at(F.flatten(F.transform(blocks, lacking)), F.lit(1)),
        F.when(~c.rlike(r"(?i)##\s*Severity\s*\n\s*(critical|major|moderate|minor)\b"), "Severity section missing a valid value"),
        F.lit("Complete"),
    )
