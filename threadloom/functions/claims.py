"""Lists inside one record whose entries depend on those before them: claims, segments, mappings, routes. Columns only.

Each step is a filter, a sort or a fold over an array. Folds keep what has been accepted so far; nothing leaves the JVM.
Null texts and lists count as empty unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import rules
from threadloom.functions import text as X

NO_ANSWER = "No Response"
#: Words that don't make claims alike. Fixed values.
CLAIM_STOPWORDS = [
    "the", "a", "an", "of", "in", "is", "to", "for", "and", "or", "that", "with", "on", "by", "from", "as", "are", "was", "be", "this", "paper", "work", "method", "approach", "model",
    "it", "its", "their", "there", "has", "have", "had", "at", "under", "into", "than", "then", "very", "more", "less", "not",
]
CLAIM_LINE = r"(?i)^Claim\s+(\d+)\s*:\s*(.*)"
POINT = r"(?is)Point\s+(\d+):\s*(.*?)(?=Point\s+\d+:|\z)"
MAPPING = r"(?is)W(\d+)\s*->\s*(.*?)\s*\(Confidence:\s*([\d.]+)\)"
ROUTE = r"(?i)F(\d+)\s*->\s*([\w,\s]+?)\s*\(Confidence:\s*([\d.]+)\)"
SAME_AS = r"^[Ss]ame\s+(?:segment|rebuttal|response|text)\s+as\s+W(\d+)"


def concepts(claim: Column) -> Column:
    """Distinct words of a claim of four letters or digits and more that aren't stop words; marks separate words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(X.strip(claim)), r"^claim\s+\d+\s*:\s*", ""), r"[^a-z0-9\s]+", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(F.lit(CLAIM_STOPWORDS), w)))


def contained(a: Column, b: Column) -> Column:
    """Share of the smaller set that lies in the other; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def first_sentence(claim: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(X.strip(claim), r"^\s*[-*]\s*", ""), r"(?i)^Claim\s+\d+\s*:\s*", "")
    return X.strip(F.split(X.collapse(body), r"(?<=[.!?])\s+")[0])


def ranked(claims: Column) -> Column:
    """The claims' first sentences as array<struct<rank, place, text, words>>, the most specific first; empty ones are left out."""
    short = F.filter(F.transform(claims, first_sentence), lambda c: F.coalesce(c, F.lit("")) != "")
    one = lambda c, i: F.struct((-rules.specificity(F.lower(X.strip(c)))).cast("int").alias("rank"), i.alias("place"), c.alias("text"), concepts(c).alias("words"))
    return F.array_sort(F.transform(short, one))


def representatives(claims: Column, threshold: float = 0.5) -> Column:
    """Of ranked claims those that no earlier representative resembles. As the most specific come first, each stands for its group."""
    none = F.slice(claims, 1, 0)
    return F.aggregate(claims, none, lambda kept, c: F.when(F.exists(kept, lambda k: contained(k["words"], c["words"]) >= threshold), kept).otherwise(F.array_append(kept, c)))


def fewest(claims: Column, most: int = 2) -> Column:
    """At most so many of ranked claims: of the two most alike that are both still there the less specific one goes, until few enough remain."""
    n = F.size(claims)
    places = F.transform(claims, lambda c, i: i)
    words = lambda i: F.get(claims, i)["words"]
    later = lambda i: F.transform(F.filter(places, lambda j: (j > i) & (F.size(words(i)) > 0) & (F.size(words(j)) > 0)), lambda j: F.struct((-contained(words(i), words(j))).alias("far"), i.alias("i"), j.alias("j")))
    pairs = F.array_sort(F.flatten(F.transform(places, later)))
    there = lambda left, p: F.array_contains(left, p["i"]) & F.array_contains(left, p["j"])
    left = F.aggregate(pairs, places, lambda left, p: F.when((F.size(left) > most) & there(left, p), F.array_remove(left, p["j"])).otherwise(left))
    return F.when(n <= most, claims).otherwise(F.transform(F.slice(left, 1, most), lambda i: F.get(claims, i)))


def numbered(texts: Column) -> Column:
    return F.transform(texts, lambda c, i: F.concat(F.lit("Claim "), (i + 1).cast("string"), F.lit(": "), c))


def claim_lines(text: Column) -> Column:
    """Lines that aren't empty, stripped: array<struct<is_claim, no, body>>."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"), lambda x: X.strip(x)), lambda x: x != "")
    return F.transform(found, lambda x: F.struct(x.rlike(CLAIM_LINE).alias("is_claim"), F.regexp_extract(x, CLAIM_LINE, 1).try_cast("int").alias("no"), X.strip(F.regexp_extract(x, CLAIM_LINE, 2)).alias("body")))


def claims_state(text: Column, lines: Column, words: Column) -> Column:
    """"Complete", or the first thing that is wrong with an answer of claims.

    lines: claim_lines of the text; words: concepts of their bodies. Give both columns of their own: every line reads those before.
    """
    t = X.strip(F.coalesce(text, F.lit("")))
    plain = lambda c: F.lower(X.collapse(c))

    def wrong(line: Column, i: Column) -> Column:
        no = line["no"].cast("string")
        return F.when(line["body"] == "", "Malformed claim line").when(line["no"] != i + 1, F.concat(F.lit("Claim numbering not sequential at Claim "), no)).when(
            F.exists(F.slice(lines, 1, i), lambda b: plain(b["body"]) == plain(line["body"])), F.concat(F.lit("Duplicate claim detected at Claim "), no)
        ).when(F.exists(F.slice(words, 1, i), lambda w: contained(w, F.get(words, i)) >= 0.60), F.concat(F.lit("Near-duplicate claim detected at Claim "), no))

    return F.coalesce(
        F.when(t == "", "Empty output"),
        F.when(F.lower(t) == "none", "Complete (no weaknesses)"),
        F.when(t.rlike(r"(?im)^\s*(?:user|assistant|system)\s*$"), "Contains stray role marker"),
        F.when(t.rlike(r"(?i)\[\s*TASK\s*[12]\s*\]"), "Contains stray task header"),
        F.when(~F.exists(lines, lambda x: x["is_claim"]), "Missing numbered claims"),
        F.when(F.exists(lines, lambda x: ~x["is_claim"]), "Contains non-claim trailing content"),
        F.try_element_at(F.array_compact(F.transform(lines, wrong)), F.lit(1)),
        F.lit("Complete"),
    )


#: What ends an answer of claims, and one of an analysis. Fixed values.
STOPS = {
    "claims": [r"(?:\n|\A)\s*(?:user|assistant|system)\s*(?:\n|$)", r"\[\s*TASK\s*[12]\s*\]", r"\n\s*Claim\s+\d+\s*:\s*.+\n\s*\n"],
    "analysis": [r"(?:\n|\A)\s*(?:user|assistant|system)\s*(?:\n|$)", r"\[\s*TASK\s*[12]\s*\]"],
}
SEVERITY_END = r"(?is)\A(.*?##\s*Severity\s*\n\s*(?:critical|major|moderate|minor)\s*(?:\n|$))"


def before_stop(text: Column, kind: str) -> Column:
    at = F.regexp_instr(text, F.lit("(?i)" + "|".join(STOPS[kind])))
    return X.strip(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text))


def analysis_answer(text: Column) -> Column:
    """An analysis up to its severity, else up to what no longer belongs to it."""
    t = X.strip(text)
    whole = F.regexp_extract(t, SEVERITY_END, 1)
    return F.when(whole != "", X.strip(whole)).otherwise(before_stop(t, "analysis"))


def claim_block(text: Column) -> Column:
    """The lines of the first block of claim lines of a text."""
    found = F.transform(F.split(text, "\n"), lambda x: X.strip(x))
    first = F.array_position(F.transform(found, lambda x: x.rlike(CLAIM_LINE)), True)
    rest = F.slice(found, F.greatest(first, F.lit(1)).cast("int"), F.size(found))
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(CLAIM_LINE)), False)
    return F.when(first > 0, F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)).otherwise(F.slice(found, 1, 0))


#: A section named by its quoted title; the mark \q is the number of the group of the opening quote.
_QUOTED = r"(?:\bthe\s+)?[Ss]ec(?:tion|\.)?\s+(['\"])([^\n]*?)\q(\s*\(p(?:age)?\.?\s*\d+\))?"
#: Bare places and what stands for them where no sections are known. Fixed values.
BARE = [
    (r"(?i)\b(?:Appendix|App\.?)\s+[A-Z]?\d+(?:\.\d+)*\b", "the appendix"), (r"(?i)\b(?:Section|Sec\.?)\s+[A-Z]?\d+(?:\.\d+)*\b", "the relevant section"),
    (r"(?i)\bTable\s+\d+[a-zA-Z]?\b", "the results table"), (r"(?i)\b(?:Figure|Fig\.?)\s+\d+[a-zA-Z]?\b", "the figure"),
]


def general_places(text: Column, has_sections: Column) -> Column:
    """Places that can't be trusted in general words: noisy quoted titles always, bare numbers where no sections are known. Null stays null."""
    one, two = _QUOTED.replace(r"\q", r"\1"), _QUOTED.replace(r"\q", r"\4")
    parts = F.regexp_extract_all(text, F.lit(rf"{one}|[\s\S]+?(?={two}|\z)"), F.lit(0))

    def general(part: Column) -> Column:
        title, page = F.regexp_extract(part, f"^{one}$", 2), X.strip(F.regexp_extract(part, f"^{one}$", 3))
        return F.when(part.rlike(f"^{one}$") & rules.noisy_title(title), F.rtrim(F.concat(F.lit("the relevant section "), page))).otherwise(part)

    named = F.array_join(F.transform(parts, general), "")
    bare = named
    for pattern, word in BARE:
        bare = F.regexp_replace(bare, pattern, word)
    return F.when(has_sections, named).otherwise(bare)


def points(text: Column) -> Column:
    """Numbered points of a segmentation: array<struct<key, text>>, keys W1, W2, ..."""
    part = lambda i: F.regexp_extract_all(text, F.lit(POINT), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("t")), lambda x: F.struct(F.concat(F.lit("W"), x["n"]).alias("key"), X.strip(x["t"]).alias("text")))


def mapped(text: Column, weaknesses: Column) -> Column:
    """The mapping of rebuttals to weaknesses (array of points), cleaned in order: array<struct<key, rebuttal, confidence>>.

    Entries without a response are read first; of a weakness named twice the first counts; unknown weaknesses are left out.
    A rebuttal that only repeats its weakness, or stands at an earlier weakness, becomes NO_ANSWER; one that points to an
    earlier weakness takes over that one's rebuttal.
    """
    part = lambda i: F.regexp_extract_all(text, F.lit(MAPPING), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("n"), part(2).alias("b"), part(3).alias("c"))
    entries = F.transform(zipped, lambda x: F.struct(F.concat(F.lit("W"), x["n"]).alias("key"), X.strip(x["b"]).alias("rebuttal"), x["c"].try_cast("double").alias("confidence")))
    silent = lambda x: F.lower(x["rebuttal"]) == NO_ANSWER.lower()
    ordered = F.concat(F.filter(entries, silent), F.filter(entries, lambda x: ~silent(x)))

    def take(done: Column, x: Column) -> Column:
        weakness = F.try_element_at(F.filter(weaknesses, lambda w: w["key"] == x["key"]), F.lit(1))["text"]
        other = F.concat(F.lit("W"), F.regexp_extract(x["rebuttal"], SAME_AS, 1))
        earlier = F.try_element_at(F.filter(done, lambda y: y["key"] == other), F.lit(1))["rebuttal"]
        told = (
            F.when(silent(x) | F.coalesce(rules.quote_only(weakness, x["rebuttal"]), F.lit(False)), NO_ANSWER)
            .when(x["rebuttal"].rlike(SAME_AS), F.coalesce(earlier, F.lit(NO_ANSWER)))
            .when(F.exists(done, lambda y: y["rebuttal"] == x["rebuttal"]), NO_ANSWER)
            .otherwise(x["rebuttal"])
        )
        one = F.struct(x["key"].alias("key"), told.alias("rebuttal"), x["confidence"].alias("confidence"))
        return F.when(weakness.isNull() | F.exists(done, lambda y: y["key"] == x["key"]), done).otherwise(F.array_append(done, one))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), take)


def routed(text: Column, n_followups: Column, weaknesses: Column) -> Column:
    """Where each follow-up (from 0) goes: array<struct<follow_up, weakness>>.

    A single weakness takes all; unknown targets are UNRELATED; where the text names no route at all, every follow-up goes to
    every weakness.
    """
    part = lambda i: F.regexp_extract_all(text, F.lit(ROUTE), F.lit(i))
    found = F.arrays_zip(part(1).try_cast("array<int>").alias("n"), part(2).alias("t"))
    goes = lambda n, w: F.struct(n.cast("int").alias("follow_up"), w.alias("weakness"))
    target = lambda t: F.when(F.array_contains(weaknesses, F.upper(X.strip(t))), F.upper(X.strip(t))).otherwise("UNRELATED")
    each = F.flatten(F.transform(F.filter(found, lambda x: x["n"].between(1, n_followups)), lambda x: F.transform(F.split(x["t"], ","), lambda t: goes(x["n"] - 1, target(t)))))
    all_ = F.when(n_followups > 0, F.sequence(F.lit(0), n_followups - 1)).otherwise(F.array().cast("array<int>"))
    every = F.flatten(F.transform(all_, lambda i: F.transform(weaknesses, lambda w: goes(i, w))))
    return F.when((F.size(weaknesses) == 1) | text.isNull() | (F.size(found) == 0), every).otherwise(each)
