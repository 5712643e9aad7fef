"""Parts of the reward formula as column expressions; what needs pairs or positions of lines works on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import rules
from threadloom.functions import text as X

CLAIM = r"(?im)^\s*Claim\s+\d+\s*:"


def without_thinking(c: Column) -> Column:
    return X.strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: X.strip(x)), lambda x: x != "")


def _counts(found: Column) -> Column:
    """How often each of the distinct lines occurs, from the lengths of runs in sorted order; linear but for the sort."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"].eqNullSafe(x)
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1).otherwise(1).alias("run"), F.when(same | (acc["run"] == 0), acc["runs"]).otherwise(F.array_append(acc["runs"], acc["run"])).alias("runs"))

    return F.aggregate(F.array_sort(found), start, step, lambda acc: F.when(acc["run"] > 0, F.array_append(acc["runs"], acc["run"])).otherwise(acc["runs"]))


def repetition_penalty(c: Column, more_than: int) -> Column:
    """1 for under four lines, else 1 less twice the share of lines that occur more than so many times, 0 at least."""
    found = lines(c)
    repeated = F.aggregate(_counts(found), F.lit(0), lambda acc, n: acc + F.when(n > more_than, n).otherwise(0))
    return F.when(F.size(found) < 4, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - 2 * repeated / F.size(found)))


def repetition_gate(c: Column) -> Column:
    """False for texts of more than five lines with one more than three times."""
    found = lines(c)
    return ~((F.size(found) > 5) & (F.coalesce(F.array_max(_counts(found)), F.lit(0)) > 3))


def claim_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CLAIM))


def claim_bodies(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit(r"(?ims)^\s*Claim\s+\d+\s*:\s*(.+?)(?=\s*Claim\s+\d+\s*:|$)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: X.strip(x)), lambda x: x != "")


def near_pairs(bodies: Column, threshold: float) -> Column:
    """Pairs of claims whose word sets are at least so similar."""
    words = lambda b: F.array_distinct(F.regexp_extract_all(F.lower(b), F.lit("[a-z]+"), F.lit(0)))
    none = F.struct(F.array().cast("array<array<string>>").alias("seen"), F.lit(0).alias("n"))

    def step(acc: Column, b: Column) -> Column:
        # a struct of its own, so that the words are worked out once
        own = F.transform(F.array(words(b)), lambda w: F.struct(F.array_append(acc["seen"], w).alias("seen"), (acc["n"] + F.size(F.filter(acc["seen"], lambda s: (F.size(w) > 0) & (F.size(s) > 0) & (X.jaccard(s, w) >= threshold)))).alias("n")))
        return own[0]

    return F.aggregate(bodies, none, step, lambda acc: acc["n"])


def gate_of_claims(c: Column, bodies: Column) -> Column:
    """True where an answer of claims passes: no rebuttal talk, no loops, numbered claims or none, not mostly the same claim.

    bodies: its claim_bodies. Give them a column of their own: every claim is held against the others.
    """
    n = F.size(bodies)
    doubles = (n >= 3) & (near_pairs(bodies, 0.7) / F.greatest(n * (n - 1) / 2, F.lit(1.0)) > 0.5)
    return ~rules.leaks(c, "reward") & repetition_gate(c) & ((F.lower(X.strip(c)) == "none") | (c.rlike(CLAIM) & ~doubles))


SUGGESTION = r"(?is)###\s*Suggestion\s*\d+.*?(?=\n\s*###\s*Suggestion\s*\d+|\n\s*##\s*Severity|\z)"


def hard_gate_analysis(c: Column) -> Column:
    """True where an analysis passes: no rebuttal talk, no loops, evidence, and a suggestion with a usable field."""
    evidence = X.strip(F.regexp_extract(c, r"(?is)##\s*Evidence\s*(.*?)(?=\n\s*###\s*Suggestion\s*\d+|\z)", 1))
    blocks = F.regexp_extract_all(c, F.lit(SUGGESTION), F.lit(0))
    usable = F.exists(blocks, lambda b: b.rlike(r"(?i)-\s*\*\*(What|Where|How)\*\*:"))
    return ~rules.leaks(c, "reward") & repetition_gate(c) & (evidence != "") & usable


def cut_claims(c: Column) -> Column:
    """Only the claims of an answer."""
    t = X.strip(c)
    found = F.transform(F.regexp_extract_all(t, F.lit(r"(?is)(Claim\s+\d+\s*:.*?)(?=\s*Claim\s+\d+\s*:|\z)"), F.lit(1)), lambda x: X.strip(x))
    return F.when(F.lower(t) == "none", "None").when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(t)


LEAKED_PROMPT = r"(?im)^\s*assistant\s*$|^\s*user\s*$|\[TASK 2\] Actionable Analysis|\*\*Weakness label\*\*:|\*\*Abstract\*\*:"


def cut_analysis(c: Column) -> Column:
    """The first whole answer: up to what repeats the prompt, from the first heading, to the severity or the last priority."""
    at = F.regexp_instr(c, F.lit(LEAKED_PROMPT))
    head = F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)
    start = F.regexp_instr(head, F.lit(r"(?i)##\s*(Claim|Evidence)\b"))
    bare = F.regexp_instr(head, F.lit(r"(?im)^Claim\s*:"))
    from_ = F.when(start > 0, start).when(bare > 0, bare)
    body = F.when(from_.isNotNull(), F.substring(head, from_, F.length(head)))
    whole = F.regexp_extract(body, r"(?is)\A(.*?##\s*Severity\s*\n\s*(?:critical|major|moderate|minor)\b)", 1)
    last = F.regexp_extract(body, r"(?is)\A(.*-\s*\*\*Priority\*\*:\s*(?:critical|high|medium|low|major|moderate|minor)\b)", 1)
    return X.strip(F.when(body.isNull(), head).when(whole != "", whole).when(last != "", last).otherwise(body))


def base_score(c: Column) -> Column:
    """0.1 for "none", 0 without a claim, else null."""
    t = X.strip(c)
    return F.when(F.lower(t) == "none", 0.10).when(claim_count(t) == 0, 0.0)


def count_prior(n: Column) -> Column:
    return F.when(n <= 1, 1.0).when(n == 2, 0.90).otherwise(F.greatest(F.lit(0.60), 0.90 - 0.15 * (n - 2)))


def form_of_claims(bodies: Column) -> Column:
    """Discount for claims of several sentences and for claims said twice; bodies in a column of their own."""
    many = F.size(F.filter(bodies, lambda b: F.regexp_count(b, F.lit(r"[.!?](?=\s|$)")) > 1))
    twice = near_pairs(bodies, 0.65)
    return F.when(F.size(bodies) == 0, 1.0).otherwise(F.when(many > 0, F.greatest(F.lit(0.75), 1 - 0.12 * many)).otherwise(1.0) * F.when(twice > 0, F.greatest(F.lit(0.70), 1 - 0.15 * twice)).otherwise(1.0))


def format_analysis(c: Column) -> Column:
    blocks = F.regexp_extract_all(c, F.lit(SUGGESTION), F.lit(0))
    has = lambda b, name: b.rlike(rf"(?i)-\s*\*\*{name}\*\*:\s*\S")
    whole = F.exists(blocks, lambda b: has(b, "What") & has(b, "Where") & has(b, "How") & has(b, "Expected Outcome"))
    part = lambda cond, d: F.when(cond, 1.0).otherwise(d)
    return part(c.rlike(r"(?i)##\s*Claim\b"), 0.90) * part(c.rlike(r"(?i)##\s*Severity\b"), 0.90) * part(whole, 0.85)


def parsed_score(c: Column) -> Column:
    """The first standalone digit from 1 to 5."""
    return F.regexp_extract(c, r"\b([1-5])\b", 1).try_cast("int")


def unit(mean: Column) -> Column:
    """A mean of 1 to 5 as 0 to 1."""
    return (mean - 1) / 4


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
