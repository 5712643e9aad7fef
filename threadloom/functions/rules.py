"""Rule classifiers as ordered lists of conditions, compiled to Spark columns or to SQL.

A condition is a pattern, or ("not", c), ("all", c, ...), ("any", c, ...); a rule is (result, condition), first match wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = str | tuple


def column(cond: Condition, text: Column) -> Column:
    if isinstance(cond, str):
        return text.rlike(cond)
    kind, *rest = cond
    if kind == "not":
        return ~column(rest[0], text)
    out = column(rest[0], text)
    for c in rest[1:]:
        out = (out & column(c, text)) if kind == "all" else (out | column(c, text))
    return out


def sql(cond: Condition, text: str) -> str:
    if isinstance(cond, str):
        return f"regexp_matches({text}, '{cond.replace(chr(39), chr(39) * 2)}')"
    kind, *rest = cond
    if kind == "not":
        return f"NOT {sql(rest[0], text)}"
    return "(" + (" AND " if kind == "all" else " OR ").join(sql(c, text) for c in rest) + ")"


def first(rules: list[tuple[str, Condition]], text: Column, default: str) -> Column:
    out = F.lit(default)
    for result, cond in reversed(rules):
        out = F.when(column(cond, text), result).otherwise(out)
    return out


def first_sql(rules: list[tuple[str, Condition]], text: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql(c, text)} THEN '{r}'" for r, c in rules) + f" ELSE '{default}' END"


# The patterns below are fixed values; texts are lower-cased before.
PAST_RAISE = r"\bhave\s+(raised|increased|updated)\s+(my\s+)?score\b"
RAISE = r"\b(willing|happy|glad)\s+to\s+(increase|raise|update|change)\s+(my\s+)?(score|rating)\b|\bi\s+(will|would|am\s+going\s+to)\s+(raise|increase|update|change)\s+(my\s+)?(score|rating)\b|\braise\s+my\s+score\s+(to|from)\b|\bscore\s+(of|to)\s+\d\b|\b(increase|raise)\s+(the\s+)?score\b"
NEGATIVE = r"\b(still|however|but|unfortunately|remains?|not\s+(convinced|clear|addressed|resolved|sufficient)|concern\s+remains?|disagree)\b"
SATISFIED = (
    r"\b(authors?\s+have\s+(addressed|answered|resolved|clarified))|\b(my\s+)?(concern|question|issue)s?\s+(have\s+been|has\s+been)\s+(addressed|resolved)|\bsatisfied\s+with\s+the\s+(response|rebuttal)"
    r"|\bno\s+(further|more|additional)\s+(concern|question|issue|comment)s?\b|\bi\s+(will\s+)?(accept|support)\s+(the\s+)?(paper|submission)|\b(happy|glad|willing)\s+to\s+(accept|support)\b"
    r"|\b(response|rebuttal|clarification)\s+is\s+(clear|satisfactory|convincing|adequate)\b|\bthank\s+you[,\.]?\s+(the\s+)?(response|clarification)\s+is\b|\bi\s+have\s+(raised|increased|updated)\s+(my\s+)?score\b"
    r"|\bmy\s+(concern|question|issue)s?\s+(have\s+been|are\s+(now\s+)?)addressed\b"
)
REJECTS = [
    r"\b(this|the)\s+(response|rebuttal|answer)\s+(does\s+not|didn't|doesn't|failed\s+to)\s+(address|resolve|answer|convince)\b", r"\bthis\s+does\s+not\s+address\b", r"\bdoes\s+not\s+(address|resolve|answer|clarify)\s+(my|the|this)\b",
    r"\bfail(s|ed)\s+to\s+(address|resolve|answer|clarify)\b", r"\b(concern|issue|question|problem)\s+remains?\s+(unaddressed|open|unresolved)\b", r"\bremains?\s+unaddressed\b", r"\b(primary|main|key|major)\s+concern\s+remains?\b",
    r"\bi\s+am\s+not\s+convinced\s+by\b", r"\bnot\s+convinced\s+by\s+(the|this|your)\b", r"\bi\s+maintain\s+(my|that)\b", r"\bi\s+still\s+disagree\b", r"\bstill\s+not\s+(convinced|addressed|resolved|clear|adequate|satisfied)\b",
    r"\bi\s+still\s+(do\s+not|don't)\s+(agree|accept|believe)\b",
]
THANKS, CONTRAST = r"\bthank(s|\s+you)\b", r"\b(unfortunately|however|yet|nonetheless|that said)\b"
POLITE_REJECT = r"\b(concern|issue|question)\s+remains?|remains?\s+(unaddressed|unconvincing|problematic)|not\s+(addressed|resolved|answered|convinced)|not\s+all\s+of\s+(my\s+)?(concern|question|issue)|some\s+but\s+not\s+all|does\s+not\s+(address|resolve)|fail(s|ed)?\s+to\s+(address|resolve)"
MORE_WANTED = r"\bcould\s+you\s+(also|please)|\bplease\s+(also|consider|add|include)|\badditionally[,\s]|\bit\s+would\s+(be|also)\s+(nice|good|better|helpful)|\bone\s+more\s+(suggestion|request|question)|\bfurther(more)?\b|\bin\s+addition\b"
NEEDED = r"\b(needed|required|necessary|should\s+be|must\s+be|need\s+to|have\s+to|are\s+needed|is\s+needed|would\s+be\s+(helpful|useful|necessary|important))\b"
DOUBTS = [r"\bi\s+still\s+think\b", r"\bi\s+still\s+believe\b", r"\bstill\s+think\s+(this|that|the)\b", r"\bnot\s+fully\s+(convinced|addressed|resolved)\b", r"\bit\s+is\s+still\s+(unclear|not\s+clear)\b", r"\bremains?\s+(unclear|unconvincing)\b"]
REFINES = [
    r"\bthank\s+you\b.*\b(address|fix|clarif|revis)", r"\badditionally,?\s+(it\s+would|please|could\s+you)", r"\bone\s+more\s+(suggestion|question|request|concern)\b", r"\bfinal\s+suggestion\b", r"\bminor\s+(point|comment|suggestion)\b",
    r"\bit\s+would\s+(be|also)\s+(nice|good|better|helpful)", r"\bcould\s+you\s+(also|please)", r"\bplease\s+(also|consider|add|include)", r"\b(furthermore|moreover|in\s+addition)\b", r"\balso,?\s+(could|would|please)", r"\bsome\s+(final|more|additional)\s+(suggestion|comment|point)",
]
SAME_TOPIC = r"\bthis\s+(issue|concern|problem|point)\b|\bmy\s+(original|initial|previous|earlier)\s+(concern|question|point)\b|\bas\s+(mentioned|stated|noted)\s+(earlier|above|before)\b"
SHIFTS = [r"\banother\s+(concern|issue|problem|question)\b", r"\bseparately[,\s]", r"\bon\s+a\s+(completely\s+)?different\s+(note|topic|point)\b", r"\bnew\s+(concern|issue|question)\b", r"\bunrelated\s+to\s+(the\s+above|this|my\s+previous)\b", r"\bmoving\s+(on\s+)?to\s+(a\s+)?(different|new|separate|another)\b"]
GRATITUDE, PRONOUN = r"\bthank|\bappreciate|\bgrateful", r"\b(this|that|it|these|those)\b"
#: label/tier/score of a follow-up by its text alone; the rest is decided with the first statement.
FOLLOW_UP = [
    ("score_update/high/0.95", ("all", ("not", PAST_RAISE), RAISE)),
    ("acknowledgment/high/0.95", ("all", ("not", NEGATIVE), SATISFIED)),
    ("debate/high/0.92", ("any", *REJECTS)),
    ("debate/high/0.9", ("all", THANKS, CONTRAST, POLITE_REJECT)),
    ("debate/medium/0.75", ("all", ("not", MORE_WANTED), ("not", NEEDED), NEGATIVE, ("any", *DOUBTS))),
    ("same_issue/high/0.88", ("any", *REFINES)),
    ("new_issue/high/0.85", ("all", ("any", *SHIFTS), ("not", SAME_TOPIC))),
]
#: Words that don't count as keywords of follow-ups, and of rebuttals. Fixed values.
LABEL_STOPWORDS = [
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "but", "is", "are", "was", "were", "be", "this", "that", "with", "from", "by", "as", "it", "thank",
    "you", "your", "please", "would", "could", "have", "has", "not", "do", "does", "did", "can", "will", "may", "also", "very", "more",
]
QUOTE_STOPWORDS = [
    "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "but", "is", "are", "was", "were", "be", "this", "that", "with", "from", "by", "as", "it", "i", "we",
    "our", "my", "your", "their", "not", "no", "do", "does", "can", "will", "may", "have", "has", "had", "been", "would", "could", "should", "if", "so", "than", "then",
    "also", "more", "most", "very", "about", "which", "who", "what", "when", "where", "how", "why", "all", "any", "such", "these", "those", "its", "they", "them", "their",
    "there",
]
#: Type of a reply by its invitation (and signature): by venue rules. Fixed values.
REPLY_TYPES = {
    "first": [("decision", r"decision$"), ("review", r"official_review$"), ("meta_review", r"meta_?review"), ("rebuttal", r"/authors/-/official_comment|/authors/-/rebuttal|author_response|authors_official_comment|/authors.*(comment|rebuttal)|(comment|rebuttal).*/authors")],
    "wide": [("decision", r"decision$|/decision"), ("review", r"official_review|/review$"), ("meta_review", r"meta_?review"), ("rebuttal", r"/authors/-/official_comment|author_response|authors_official_comment|rebuttal|/authors.*(comment|response)|(comment|response).*/authors")],
    "meta_first": [("decision", r"decision"), ("meta_review", r"meta_?review"), ("review", r"official_review|/review$"), ("rebuttal", r"author.*(response|rebuttal|comment)|(response|rebuttal|comment).*author")],
}
#: Words at the end of a cut title. Fixed values.
TRAILING = [
    "the", "a", "an", "of", "in", "is", "to", "for", "and", "or", "that", "with", "on", "by", "from", "as", "are", "was", "be",
]
#: Words that make a claim specific. Fixed values.
SPECIFIC = [
    "ablation", "baseline", "table", "figure", "fig", "section", "appendix", "dataset", "benchmark", "metric", "error", "failure", "case", "counterexample", "latency",
    "throughput", "runtime", "complexity", "memory", "robustness", "ood", "hyperparameter", "seed", "variance", "significance", "confidence", "calibration", "leakage",
    "prompt", "instruction", "retrieval", "evidence", "citation", "hallucination", "equation", "formula", "algorithm", "procedure", "definition",
]
#: Phrases of the three theory categories. Fixed values.
TIE_PHRASES = {
    "L2.3.1": ["incorrect proof", "theorem wrong", "theorem is wrong", "proof is wrong", "proof is incorrect", "derivation invalid", "invalid derivation", "not shown", "missing proof", "does not follow", "not proven", "proof missing", "proof is missing", "no proof", "without proof", "lack of proof", "unproven", "proof error", "proof flawed"],
    "L2.3.2": ["assumption unrealistic", "unrealistic assumption", "too strong assumption", "assumption too strong", "overly strong assumption", "assumption violated", "violated in practice", "non-differentiability ignored", "differentiability assumption", "assumption does not hold", "unjustified assumption", "assumption is not realistic", "strong assumption", "questionable assumption", "invalid assumption"],
    "L2.3.3": ["theory and experiment", "theoretical and empirical", "theory does not match", "theory-practice gap", "theory practice gap", "disconnect between theory", "gap between theory", "theoretical results do not match", "theory vs experiment", "inconsistent with theory", "not reflected in experiment"],
}
#: Signs that a text speaks of the rebuttal: in generated reviews, in chat data, in rewards. Fixed values.
LEAKS = {
    "generation": [r"(?i)\brebuttal\b", r"(?i)\bauthors?\s+(?:mentioned|showed|added|stated|clarified|revised)\b", r"(?i)\bin (?:their|the) response\b", r"(?i)\bas shown in the response\b", r"(?i)\bauthors?\s+later\b", r"(?i)\bafter rebuttal\b"],
    "chat": [r"(?i)as the authors", r"(?i)in their response", r"(?i)the rebuttal", r"(?i)authors mentioned", r"(?i)authors showed", r"(?i)authors added", r"(?i)in response to"],
    "reward": [r"(?i)\brebuttal\b", r"(?i)\bpost.submission\b", r"(?i)\bauthors?.respond", r"(?i)\bin their response\b", r"(?i)\bauthor response\b"],
}


def keyword_set(c: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    return F.array_except(found, F.lit(stop))


def follow_up(initial: Column, text: Column) -> Column:
    """label, tier and score of a follow-up against the first statement; both in lower case, in columns of their own."""
    t = text
    ik, fk = keyword_set(initial, LABEL_STOPWORDS), keyword_set(text, LABEL_STOPWORDS)
    ratio = F.size(F.array_intersect(ik, fk)) / F.size(ik)
    both = (F.size(ik) > 0) & (F.size(fk) > 0)
    by_text = first(FOLLOW_UP, t, "")
    parts = F.split(by_text, "/")
    weak = F.when(both & (ratio > 0.35), F.struct(F.lit("same_issue").alias("label"), F.lit("medium").alias("tier"), F.least(0.5 + ratio * 0.3, F.lit(0.82)).alias("score")))
    weak = weak.when(F.size(F.regexp_extract_all(t, F.lit(PRONOUN), F.lit(0))) >= 3, F.struct(F.lit("same_issue").alias("label"), F.lit("low").alias("tier"), F.lit(0.55).alias("score")))
    thanks = t.rlike(GRATITUDE) & ~t.rlike(NEGATIVE)
    weak = weak.otherwise(F.struct(F.lit("same_issue").alias("label"), F.lit("medium").alias("tier"), F.when(thanks, 0.68).otherwise(0.60).alias("score")))
    return F.when(by_text != "", F.struct(parts[0].alias("label"), parts[1].alias("tier"), parts[2].cast("double").alias("score"))).otherwise(weak)


def needs_check(label: Column, text: Column) -> Column:
    """True where a follow-up's label should be verified; label is the struct of follow_up."""
    return (label["tier"].isin("low", "medium") & (F.length(text) > 150)) | (label["score"] < 0.65) | ((label["label"] == "debate") & (label["tier"] != "high")) | ((label["label"] == "new_issue") & (label["score"] < 0.80))


def quote_only(weakness: Column, rebuttal: Column) -> Column:
    """True where a rebuttal only repeats the weakness."""
    w, r = keyword_set(weakness, QUOTE_STOPWORDS), keyword_set(rebuttal, QUOTE_STOPWORDS)
    common = F.size(F.array_intersect(w, r))
    return (F.size(w) > 0) & (F.size(r) > 0) & (common / F.size(w) > 0.55) & (common / F.size(r) > 0.45)


def reply_type(invitation: Column, signature: Column, rules: str) -> Column:
    by_invitation = first(REPLY_TYPES[rules], F.lower(F.coalesce(invitation, F.lit(""))), "")
    authors = F.lower(F.coalesce(signature, F.lit(""))).rlike("/authors$")
    return F.when(by_invitation != "", by_invitation).when(authors, "rebuttal").otherwise("comment")


def role_of(kind: Column, signature: Column) -> Column:
    s = F.lower(signature)
    by_sign = F.when(F.contains(s, F.lit("area_chair")), "area_chair").when(F.contains(s, F.lit("reviewer")), "reviewer").when(s.rlike("/authors$"), "author").otherwise("unknown")
    return F.when(signature.isNull(), "unknown").when(kind == "rebuttal", "author").when(kind == "decision", "program_chair").when(kind == "meta_review", "area_chair").otherwise(by_sign)


def tie_break(text: Column, l2: Column) -> Column:
    """The theory category that the phrases of a text in lower case favour, else the given one."""
    hits = {k: sum((F.contains(text, F.lit(p)).cast("int") for p in phrases), F.lit(0)) for k, phrases in TIE_PHRASES.items()}
    h1, h2, h3 = hits.values()
    better = F.when((h3 > 0) & (h3 >= h1) & (h3 >= h2), "L2.3.3").when((h1 > 0) & (h1 > h2), "L2.3.1").when((h2 > 0) & (h2 > h1), "L2.3.2").otherwise(l2)
    return F.when(l2.isin(*TIE_PHRASES), better).otherwise(l2)


def noisy_title(title: Column) -> Column:
    """True for extraction noise instead of a section heading."""
    t = F.btrim(title)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.size(words)
    last = F.lower(F.btrim(F.element_at(words, -1), F.lit(".,;:\"'")))
    numbered = t.rlike(r"^[A-Z]?\d+(?:\.\d+)*\.\s")
    lower = F.regexp_extract(t, r"\p{L}", 0).rlike(r"^\p{Ll}")
    noise = (n > 8) | last.isin(TRAILING) | (t.rlike(r"\.\s+[A-Za-z]") & ~numbered) | t.rlike(r"[(\"'.]$") | lower | (t.rlike(r":\s+[A-Z]") & (n > 5))
    return F.when(F.coalesce(t, F.lit("")) == "", True).otherwise(noise)


def specificity(t: Column) -> Column:
    """Of a trimmed text in lower case, in a column of its own."""
    named = sum((t.rlike(rf"\b{w}\b").cast("int") for w in SPECIFIC), F.lit(0))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when(t.rlike(r"\d"), 2).otherwise(0) + F.when(t.rlike(r"\b(section|sec\.|table|figure|fig\.|appendix|app\.)\b"), 2).otherwise(0) + named + F.when(t.rlike(r"\b(because|therefore|which|leading to|causing|so that)\b"), 1).otherwise(0) + F.least(F.floor(words / 10), F.lit(3))


def leaks(text: Column, kind: str) -> Column:
    return column(("any", *LEAKS[kind]), text)
