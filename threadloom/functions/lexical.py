"""Tokens, overlap and markers for lexical retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as X

#: Words that carry no topic. Fixed values.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "at", "by", "with", "from", "is", "are", "was", "were", "be", "been", "being", "that",
    "this", "these", "those", "it", "its", "their", "them", "as", "if", "then", "than", "into", "about", "around", "under", "over", "after", "before",
    "paper", "new", "add", "include", "provide", "clarify", "using", "used", "use", "show", "shows", "shown", "based", "section", "table", "figure",
]
#: Marker lists of the chunk types, first match wins. Fixed values.
CHUNK_TYPES = {
    "table_result": ["table ", "table:", "tab.", "apbox", "apmask", "aa (%)", "sa (%)"],
    "method": ["algorithm ", "proposition", "lemma", "theorem", "proof", "eq.", "equation", "kl("],
    "implementation": ["implementation details", "batch size", "optimizer", "epochs", "learning rate"],
    "protocol": ["evaluation protocols", "protocol", "test accuracy", "autoattack", "robustbench"],
    "analysis": ["experiments", "results", "ablation", "analysis", "appendix c.", "appendix b."],
}
#: Marker lists of the cases a weakness may belong to. Fixed values.
CASES = {
    "novelty": ["novelty", "originality", "incremental", "overstated novelty", "weak novelty", "positioning", "prior work", "existing theorem", "existing invariant", "relative to prior", "lack of originality", "contribution seem", "contribution appears"],
    "theory": ["theoretical", "theory", "theorem", "lemma", "proposition", "proof", "decomposition", "assumption", "generalization guarantees", "justification", "theoretical soundness"],
    "method_clarity": ["unclear", "incomplete method", "methodological clarity", "reproduce", "reproducibility", "notation", "definition", "inputs", "input types", "kl divergence", "equation", "algorithm", "implementation detail"],
    "empirical": ["baseline", "comparison", "accuracy", "results", "empirical", "significance", "p-value", "variance", "small gains", "robustness", "corruption", "evaluation", "protocol", "fine-tuning", "finetuning", "source and correctness", "baseline results"],
    "ablation": ["ablation", "sir-only", "air-only", "sir+air", "combining sir and air", "why both", "why not solely", "why not only", "necessary to employ both", "joint contributions", "individual and joint contributions", "isolate the contributions", "variants", "lambda1", "lambda2", "λ1", "λ2"],
    "mechanism": ["why the proposed method", "why models trained", "mechanism", "translate into", "generalize well to common corruption", "common corruption benchmarks", "why enforcing", "why this should", "clear justification", "mechanistic"],
}
#: Patterns of structural anchors. Fixed values.
ANCHORS = [
    r"\bequation\s*\(?\d+(?:\.\d+)?\)?", r"\beqn?\.?\s*\(?\d+(?:\.\d+)?\)?", r"\beq\.\s*\(?\d+(?:\.\d+)?\)?", r"\bfigure\s*\d+", r"\bfig\.\s*\d+", r"\btable\s*\d+", r"\btab\.\s*\d+",
    r"\bsection\s*\d+(?:\.\d+)*", r"\bsec\.\s*\d+(?:\.\d+)*", r"\balgorithm\s*\d+", r"\bappendix\s*[a-z](?:\.\d+)?", r"\bproposition\s*\d+", r"\blemma\s*\d+", r"\btheorem\s*\d+",
    r"\bablation\b", r"\brelated work\b", r"\bkl\b", r"\bautoattack\b", r"\brobustbench\b", r"\bclip\b", r"\bvit-b\b", r"\bvit-l\b", r"\bsir\b", r"\bair\b",
    r"\bλ1\b", r"\bλ2\b", r"\blambda1\b", r"\blambda2\b", r"\bp-value\b", r"\bt-test\b",
]
PUNCTUATION = ".,:;!?()[]{}\"'"


def norm(c: Column) -> Column:
    return X.collapse(F.lower(F.coalesce(c, F.lit(""))))


def tokens(c: Column) -> Column:
    """Distinct content tokens in order of first use."""
    kept = F.regexp_replace(norm(c), r"[^a-z0-9\s\-.()/%λ]", " ")
    cut = F.transform(F.split(kept, r"\s+"), lambda t: F.btrim(t, F.lit(PUNCTUATION)))
    return F.array_except(F.filter(cut, lambda t: F.length(t) >= 2), listed(STOPWORDS))


def overlap(query: Column, chunk: Column) -> Column:
    """Share of the query's distinct tokens that the chunk has; 0 without any."""
    n = F.size(query)
    return F.when(n > 0, F.size(F.array_intersect(query, chunk)) / n).otherwise(F.lit(0.0))


def phrases(c: Column) -> Column:
    """The first 18 phrases of 2 to 18 words and at most 120 characters."""
    parts = F.transform(F.split(norm(c), r"[.;:\n]"), lambda p: X.strip(p))
    words = lambda p: F.size(F.split(p, r"\s+"))
    return F.slice(F.filter(parts, lambda p: (words(p) >= 2) & (words(p) <= 18) & (F.length(p) <= 120)), 1, 18)


def phrase_overlap(phrase: Column, chunk: Column) -> Column:
    hits = F.size(F.filter(phrase, lambda p: F.contains(chunk, p)))
    return F.least(F.lit(0.30), hits * F.lit(0.05))


def listed(texts: list[str]) -> Column:
    """A constant array; one expression however long the list is."""
    return F.split(F.lit("\x01".join(texts)), "\x01")


def has_any(c: Column, markers: list[str]) -> Column:
    return F.exists(listed(markers), lambda m: F.contains(c, m))


def chunk_type(t: Column) -> Column:
    """Type of a normalised text. Give it a column of its own: every marker reads it."""
    out = F.lit("generic")
    for name, markers in reversed(CHUNK_TYPES.items()):
        out = F.when(has_any(t, markers), name).otherwise(out)
    return out


def anchors(t: Column) -> Column:
    """Distinct structural anchors of a normalised text, pattern by pattern. Give it a column of its own."""
    found = F.flatten(F.transform(listed(ANCHORS), lambda p: F.regexp_extract_all(t, p, F.lit(0))))
    return F.array_distinct(F.transform(found, lambda a: X.strip(a)))


def prefix_key(t: Column, n: int = 350) -> Column:
    """What two normalised texts must share to count as one."""
    return F.substring(t, 1, n)
