"""Snippet retrieval: records against the chunks of their own paper, scored, ranked, widened, freed of doubles and merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import lexical as L
from threadloom.runtime import cut

#: Weights of the overlap scores by mode. Fixed values.
WEIGHTS = {
    "task1": {"claim": 0.48, "evidence": 0.20, "weakness": 0.18, "followups": 0.08, "meta": 0.06},
    "task2_evidence": {"claim": 0.38, "evidence": 0.28, "weakness": 0.16, "followups": 0.07, "rebuttals": 0.06, "meta": 0.05},
    "task2_support": {"claim": 0.18, "evidence": 0.14, "what": 0.20, "where": 0.12, "how": 0.16, "outcome": 0.10, "meta": 0.10},
}
#: Marker lists of the score terms. Fixed values.
TERMS = {
    "formal": ["lemma", "proposition", "theorem", "proof", "decomposition"],
    "prior": ["related work", "prior work", "previous works", "mitrovic", "sir"],
    "proofs": ["appendix b", "appendix c", "proof of proposition", "proof of lemma"],
    "style": ["style-independent", "style-independence", "common corruption", "corruption", "downstream tasks"],
    "ablation": ["ablation", "variants", "acl variants", "appendix c.2", "appendix c.3", "lambda1", "lambda2", "λ1", "λ2"],
    "statistics": ["standard deviation", "median results", "repeated", "3 times", "p-value", "t-test"],
    "models": ["clip", "vit-b", "vit-l", "baseline", "fine-tuning", "finetuning"],
    "method": ["equation", "eq.", "algorithm", "kl", "pdo", "input", "augmented", "adversarial variant"],
    "irrelevant": ["possible negative societal impacts", "negative societal impacts", "acknowledgements", "references"],
    "generic": ["to the best of our knowledge", "our experimental results show", "our proposed method", "we demonstrate that", "we propose", "state-of-the-art", "significantly improves"],
    "structural": ["lemma", "proposition", "theorem", "proof", "decomposition", "related work", "appendix", "equation", "eq.", "algorithm", "sir", "air", "ablation", "λ1", "λ2", "lambda1", "lambda2"],
    "novel_prior": ["mitrovic", "prior", "existing", "previous works", "related work"],
    "clarity_keep": ["kl", "equation", "proposition", "lemma", "theorem", "algorithm", "pdo", "augmented", "adversarial variant"],
    "empirical_keep": ["clip", "vit-b", "vit-l", "table", "fine-tune", "implementation", "standard deviation", "p-value", "t-test"],
    "theory_keep": ["related work", "sir", "air", "proposition", "lemma", "theory", "decomposition", "proof"],
    "limits_keep": ["appendix", "table", "implementation", "protocol"],
    "limits": ["limitations"],
}
#: In support mode: what a suggestion speaks of, the chunk types that then gain, and by how much. Fixed values.
SUPPORT_TYPES = [
    (["implementation", "training", "protocol", "hyperparameter", "fine-tuning", "finetuning"], ["implementation", "protocol"], 0.08),
    (["table", "results", "comparison", "benchmark", "appendix", "ablation", "variants"], ["table_result", "analysis"], 0.08),
    (["methodology", "equation", "algorithm", "proposition", "theorem", "lemma"], ["method"], 0.07),
]
#: Section words that hint at a place. Fixed values.
HINT_WORDS = [
    "abstract", "introduction", "background", "method", "methods", "methodology", "approach", "model", "algorithm", "training", "experiment", "experiments", "evaluation", "results", "discussion", "conclusion", "appendix",
    "implementation", "setup", "hyperparameter", "ablation", "analysis", "related work", "limitation", "limitations", "proof", "theory", "theoretical", "table", "protocol", "fine-tuning", "finetuning", "baseline",
    "decoder", "architecture", "pipeline", "novelty", "contribution", "value", "robustness", "accuracy", "corruption", "significance", "kl", "divergence", "lemma", "proposition", "theorem", "equation", "eq", "variance", "comparison",
    "supplementary", "calibration", "reproducibility", "statistical",
]
#: Preferred section names by case, those of the support mode, and discouraged ones. Fixed values.
PREFERRED_SECTIONS = {
    "method_clarity": ["methodology", "method", "methods", "analysis", "proof", "appendix", "implementation"],
    "empirical": ["experiments", "results", "evaluation", "analysis", "implementation", "protocol", "appendix"],
    "novelty": ["related work", "methodology", "analysis", "proof", "appendix"],
    "theory": ["methodology", "analysis", "proof", "appendix", "related work"],
    "ablation": ["experiments", "analysis", "appendix", "ablation", "implementation"],
    "mechanism": ["methodology", "analysis", "experiments", "appendix", "related work"],
}
SUPPORT_SECTIONS = ["implementation", "experiments", "results", "appendix", "methodology", "analysis"]
DISCOURAGED_SECTIONS = ["acknowledgements", "references", "possible negative societal impacts", "negative societal impacts", "societal impacts", "environment"]


def lexical_topk(queries: DataFrame, chunks: DataFrame, on: str, query_id: str, chunk_id: str, k: int = 3) -> DataFrame:
    """queries (on, query_id, q_tokens) and chunks (on, chunk_id, c_tokens, prefix, e.g. its digest): the k best chunks of each query's own group.

    Score: share of the query's tokens in the chunk, to six digits; ties by chunk_id; of equal prefixes the best counts.
    """
    scored = queries.join(chunks, on).withColumn("score", F.round(L.overlap(F.col("q_tokens"), F.col("c_tokens")), 6)).where("score > 0")
    best = [F.desc("score"), F.asc(chunk_id)]
    once = scored.select(query_id, chunk_id, "score", "prefix").withColumn("__r", F.row_number().over(Window.partitionBy(query_id, "prefix").orderBy(*best))).where("__r = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*best))).where(F.col("rank") <= k).select(query_id, "rank", chunk_id, "score")


def open_topk(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, k: int = 3) -> DataFrame:
    """The same without a common group, through an inverted index: tokens of both sides meet, matches are counted per pair."""
    q = queries.select(query_id, F.size("q_tokens").alias("__n"), F.explode("q_tokens").alias("__t"))
    c = chunks.select(chunk_id, F.explode("c_tokens").alias("__t"))
    pairs = q.join(c, "__t").groupBy(query_id, chunk_id).agg(F.count("*").alias("__m"), F.first("__n").alias("__n"))
    scored = pairs.withColumn("score", F.round(F.col("__m") / F.col("__n"), 6))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(chunk_id))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", chunk_id, "score")


def neighbourhood(scored: DataFrame, query_id: str, doc: str, chunk_no: str, score: str, anchor: str, seeds: int, width: int, near: float = 0.10) -> DataFrame:
    """The rows whose chunk is one of the best `seeds` of its query, or lies within `width` places of such a one that matches an anchor or scores within `near` of the best.

    One shuffle by query serves all windows. Ties of the score by document and place.
    """
    mine = Window.partitionBy(query_id)
    around = Window.partitionBy(query_id, doc).orderBy(chunk_no).rangeBetween(-width, width)
    seed = F.row_number().over(mine.orderBy(F.desc(score), doc, chunk_no)) <= seeds
    rows = scored.withColumn("__seed", seed).withColumn("__wide", F.col("__seed") & (F.col(anchor) | (F.col(score) >= F.max(score).over(mine) - near)))
    return rows.withColumn("__near", F.max("__wide").over(around)).where("__seed or __near").drop("__seed", "__wide", "__near")


def merge_ranked(first: DataFrame, second: DataFrame, query_id: str, id_: str, take_first: int = 3, take_second: int = 2, k: int = 5) -> DataFrame:
    """Two ranked lists (query_id, rank, id_, score, prefix): the best of each, then the rest by score, no prefix twice, k in all."""
    both = first.withColumn("channel", F.lit("evidence")).withColumn("__take", F.lit(take_first)).unionByName(second.withColumn("channel", F.lit("support")).withColumn("__take", F.lit(take_second)))
    chosen = F.col("rank") <= F.col("__take")
    both = both.withColumn("__tier", F.when(chosen & (F.col("channel") == "evidence"), 0).when(chosen, 1).otherwise(2))
    order = [F.asc("__tier"), F.when(F.col("__tier") < 2, F.col("rank")).otherwise(0), F.desc("score"), F.asc("channel"), F.asc(id_)]
    once = both.withColumn("__r", F.row_number().over(Window.partitionBy(query_id, "prefix").orderBy(*order))).where("__r = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).where(F.col("place") <= k).select(query_id, "place", id_, "channel", "score")


def case_flags(blob: Column, with_suggestions: Column) -> dict[str, Column]:
    return {name: L.has_any(with_suggestions if name == "ablation" else blob, markers) for name, markers in L.CASES.items()}


def markers(text: Column) -> Column:
    """Which of the TERMS a normalised chunk has, as a struct of flags; once per chunk, not per pair."""
    return F.struct(*[L.has_any(text, words).alias(name) for name, words in TERMS.items()])


def support_gains(blob: Column) -> Column:
    """Which of the SUPPORT_TYPES a normalised suggestion speaks of."""
    return F.array(*[L.has_any(blob, words) for words, _, _ in SUPPORT_TYPES])


def term_scores(mode: str, case: dict[str, Column], has: Column, gains: Column, kind: Column, page: Column) -> Column:
    """Sum of the biases and penalties of a mode; has: the chunk's markers, gains: the record's support_gains."""
    add = lambda cond, points: F.when(cond, F.lit(points)).otherwise(F.lit(0.0))
    evidence, support = mode == "task2_evidence", mode == "task2_support"
    formal_case = case["novelty"] | case["theory"]
    terms = [add(has["irrelevant"], -0.35)]
    if not support:
        terms += [add(case["method_clarity"] & (kind == "method"), 0.08), add(case["method_clarity"] & has["method"], 0.12)]
        terms += [add(case["empirical"] & kind.isin("table_result", "protocol", "implementation"), 0.06), add(case["empirical"] & has["statistics"], 0.10), add(case["empirical"] & has["models"], 0.08)]
    if evidence or support:
        terms += [add(case["ablation"] & has["ablation"], 0.14), add(case["ablation"] & kind.isin("analysis", "implementation", "table_result"), 0.06)]
    if evidence:
        terms += [add(formal_case & (kind == "method"), 0.12), add(formal_case & has["formal"], 0.14), add(formal_case & has["prior"], 0.12), add(formal_case & has["proofs"], 0.08)]
        terms += [add(case["mechanism"] & has["style"], 0.08), add(case["mechanism"] & kind.isin("method", "analysis"), 0.05)]
        early = page <= 2
        any_case = formal_case | case["mechanism"] | case["ablation"]
        terms += [add(any_case & early & kind.isin("generic", "analysis") & has["generic"] & ~has["structural"], -0.18), add(case["novelty"] & early & (kind == "generic") & ~has["novel_prior"], -0.10)]
        terms += [add(case["method_clarity"] & kind.isin("table_result", "protocol") & ~has["clarity_keep"], -0.12), add(case["empirical"] & (kind == "method") & ~has["empirical_keep"], -0.10), add(formal_case & kind.isin("protocol", "table_result") & ~has["theory_keep"], -0.12)]
    if support:
        terms += [add(has["limits"] & ~has["limits_keep"], -0.10)]
        terms += [add(gains[i] & kind.isin(*kinds), points) for i, (_, kinds, points) in enumerate(SUPPORT_TYPES)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def page_hint(distance: Column) -> Column:
    """Points for the distance in pages to the nearest hinted one."""
    return F.when(distance == 0, 0.18).when(distance == 1, 0.10).when(distance == 2, 0.05).otherwise(0.0)


def hinted_pages(named_in: Column, blob: Column, sections: Column) -> Column:
    """Pages named in a text, and those of named sections that share a content token with the blob; distinct, rising."""
    named = F.transform(F.regexp_extract_all(named_in, F.lit(r"(?i)\bp(?:age)?\.?\s*(\d{1,6})\b"), F.lit(1)), lambda p: p.cast("int"))
    hit = F.filter(sections, lambda s: s["page"].isNotNull() & (s["page"] != 0) & F.exists(s["words"], lambda w: F.contains(blob, w)))
    return F.array_sort(F.array_union(named, F.transform(hit, lambda s: s["page"])))


def page_distance(page: Column, pages: Column) -> Column:
    return F.array_min(F.transform(pages, lambda p: F.abs(p - page)))


def section_hints(blob: Column) -> Column:
    """The hint words that the blob has as words."""
    return F.filter(L.listed(HINT_WORDS), lambda w: F.regexp_like(blob, F.concat(F.lit(r"\b"), w, F.lit(r"\b"))))


def hint_score(hints: Column, text: Column) -> Column:
    return F.least(F.lit(0.20), F.size(F.filter(hints, lambda h: F.contains(text, h))) * F.lit(0.03))


def named_sections(sections: Column) -> Column:
    """Sections with their normalised name and its content tokens."""
    return F.transform(sections, lambda s: F.struct(L.norm(s["name"]).alias("name"), L.tokens(s["name"]).alias("words"), s["page"].alias("page")))


def section_leanings(mode: str, case: dict[str, Column], sections: Column) -> Column:
    """Of each named section with a page whether its name is preferred or discouraged; once per record."""
    if mode == "task2_support":
        wanted = lambda name: L.has_any(name, SUPPORT_SECTIONS)
    else:
        wanted = lambda name: reduce(lambda a, b: a | b, [case[c] & L.has_any(name, names) for c, names in PREFERRED_SECTIONS.items()])
    named = F.filter(sections, lambda s: s["page"].isNotNull() & (s["name"] != ""))
    return F.transform(named, lambda s: F.struct(s["page"].alias("page"), wanted(s["name"]).alias("good"), L.has_any(s["name"], DISCOURAGED_SECTIONS).alias("bad")))


def section_bias(leanings: Column, page: Column) -> Column:
    """Sum over the sections near the chunk's page: preferred names add, discouraged ones take away and win."""
    def points(s: Column) -> Column:
        apart = F.abs(page - s["page"])
        good = F.when(s["good"], F.when(apart == 0, 0.18).when(apart == 1, 0.10).otherwise(0.0)).otherwise(0.0)
        return F.when(s["bad"] & (apart <= 1), F.when(apart == 0, -0.18).otherwise(-0.08)).otherwise(good)

    return F.aggregate(leanings, F.lit(0.0), lambda acc, s: acc + points(s))


def anchor_score(found: Column, text: Column, mode: str) -> Column:
    each = 0.12 if mode == "task2_support" else 0.20
    return F.least(F.lit(0.45), F.size(F.filter(found, lambda a: F.contains(text, a))) * F.lit(each))


#: Fields whose anchors score, and those whose anchors make a match, by mode. Fixed values.
ANCHOR_FIELDS = {"task1": ["claim", "evidence", "weakness", "followups"], "task2_evidence": ["claim", "evidence", "weakness", "followups", "rebuttals"], "task2_support": ["claim", "what", "where", "how"]}
MATCH_FIELDS = ANCHOR_FIELDS | {"task2_support": ["claim", "evidence", "what", "where", "how"]}
#: Fields whose phrases count, by mode. Fixed values.
PHRASE_FIELDS = {"task1": ["claim", "evidence", "weakness", "followups"], "task2_evidence": ["claim", "evidence", "weakness", "followups", "rebuttals"], "task2_support": ["claim", "what", "where", "how"]}
FIELDS = ["claim", "evidence", "weakness", "followups", "rebuttals", "meta", "what", "where", "how", "outcome"]
#: Seeds and width of the neighbourhood, and how many snippets remain, by mode. Fixed values.
SEEDS, WIDTH, KEPT = {"task1": 10, "task2_evidence": 12, "task2_support": 12}, {"task1": 2, "task2_evidence": 2, "task2_support": 3}, {"task1": 3, "task2_evidence": 4, "task2_support": 4}


def prepare_records(records: DataFrame) -> DataFrame:
    """records (weakness_id, group, the FIELDS, sections): token arrays, cases, hints and anchors, once per record."""
    text = lambda names: F.concat_ws(" ", *[F.col(n) for n in names])
    blob = L.norm(text(["meta", "weakness", "claim", "evidence", "followups", "rebuttals"]))
    out = records.withColumns({"sections": named_sections(F.col("sections")), "blob": blob, "blob_how": L.norm(text(["where", "how", "what"]))}).withColumn("blob_all", L.norm(F.concat_ws(" ", "blob", "what", "where", "how")))
    out = out.withColumns({f"src_{m}": L.norm(F.concat_ws("\n", *fields)) for m, fields in ANCHOR_FIELDS.items()} | {"src_match": L.norm(F.concat_ws("\n", *MATCH_FIELDS["task2_support"]))})
    out = out.withColumns({f"t_{f}": L.tokens(F.col(f)) for f in FIELDS} | {f"p_{f}": L.phrases(F.col(f)) for f in FIELDS})
    out = out.withColumns(
        {"t_all": F.array_distinct(F.concat(*[F.col(f"t_{f}") for f in FIELDS])), "gains": support_gains(F.col("blob_how"))}
        | {f"case_{n}": c for n, c in case_flags(F.col("blob"), F.col("blob_all")).items()}
        | {"hints": section_hints(F.col("blob")), "hints_all": section_hints(F.col("blob_all"))}
        | {"pages": hinted_pages(text(["claim", "evidence", "weakness", "followups"]), F.col("blob"), F.col("sections")), "pages_all": hinted_pages(text(["claim", "evidence", "weakness", "followups", "where"]), F.col("blob_all"), F.col("sections"))}
        | {f"anchors_{m}": L.anchors(F.col(f"src_{m}")) for m in ANCHOR_FIELDS} | {"anchors_match": L.anchors(F.col("src_match"))}
    )
    case = {n: F.col(f"case_{n}") for n in L.CASES}
    out = out.withColumns({f"leanings_{m}": section_leanings(m, case, F.col("sections")) for m in WEIGHTS})
    return out.drop(*FIELDS, "sections", "blob", "blob_all", "blob_how", "src_match", *[f"src_{m}" for m in ANCHOR_FIELDS])


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """chunks (group, doc, chunk_no, page, text): normalised text, tokens, type, markers and the digest of the prefix, once per chunk."""
    chunks = chunks.withColumn("norm", L.norm(F.col("text"))).drop("text")
    return chunks.withColumns({"c_tokens": L.tokens(F.col("norm")), "kind": L.chunk_type(F.col("norm")), "has": markers(F.col("norm")), "prefix": F.md5(L.prefix_key(F.col("norm")))})


def score_pairs(records: DataFrame, chunks: DataFrame, modes: list[str]) -> DataFrame:
    """Prepared records and chunks of one group each: (weakness_id, doc, chunk_no, prefix, and score_ and anchor_ of each mode)."""
    both = records.join(chunks, "group")
    # words of the record that the chunk has; every field is then held against these few
    both = both.withColumn("met", F.array_intersect("t_all", "c_tokens"))
    case = {n: F.col(f"case_{n}") for n in L.CASES}
    text, kind, page = F.col("norm"), F.col("kind"), F.col("page")
    out = []
    for mode in modes:
        support = mode == "task2_support"
        terms = [F.lit(w) * L.overlap(F.col(f"t_{f}"), F.col("met")) for f, w in WEIGHTS[mode].items()]
        terms += [L.phrase_overlap(F.col(f"p_{f}"), text) for f in PHRASE_FIELDS[mode]]
        pages = F.col("pages_all" if support else "pages")
        terms += [hint_score(F.col("hints_all" if support else "hints"), text), page_hint(page_distance(page, pages)), anchor_score(F.col(f"anchors_{mode}"), text, mode)]
        terms += [section_bias(F.col(f"leanings_{mode}"), page), term_scores(mode, case, F.col("has"), F.col("gains"), kind, page)]
        score = terms[0]
        for t in terms[1:]:
            score = score + t
        anchors = F.col("anchors_match" if support else f"anchors_{mode}")
        out += [F.round(score, 6).alias(f"score_{mode}"), F.exists(anchors, lambda a: F.contains(text, a)).alias(f"anchor_{mode}")]
    return both.select("weakness_id", "doc", "chunk_no", "prefix", *out)


def best_of(pairs: DataFrame, mode: str) -> DataFrame:
    """(weakness_id, rank, id, doc, chunk_no, score, prefix): the best chunks of each record among seeds and neighbourhood, each prefix once."""
    scored = pairs.select("weakness_id", "doc", "chunk_no", "prefix", F.col(f"score_{mode}").alias("score"), F.col(f"anchor_{mode}").alias("anchor"))
    pool = neighbourhood(scored, "weakness_id", "doc", "chunk_no", "score", "anchor", SEEDS[mode], WIDTH[mode])
    best = [F.desc("score"), F.asc("doc"), F.asc("chunk_no")]
    once = pool.withColumn("__r", F.row_number().over(Window.partitionBy("weakness_id", "prefix").orderBy(*best))).where("__r = 1")
    top = once.withColumn("rank", F.row_number().over(Window.partitionBy("weakness_id").orderBy(*best))).where(F.col("rank") <= KEPT[mode])
    return top.select("weakness_id", "rank", F.concat_ws(":", "doc", "chunk_no").alias("id"), "doc", "chunk_no", "score", "prefix")


def align(records: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Both second-task channels scored in one join, widened, freed of doubles and merged: (weakness_id, place, id, channel, score)."""
    pairs = cut(score_pairs(records, chunks, ["task2_evidence", "task2_support"]).repartition("weakness_id"), "pairs")
    channel = lambda mode: best_of(pairs, mode).select("weakness_id", "rank", "id", "score", "prefix")
    return merge_ranked(channel("task2_evidence"), channel("task2_support"), "weakness_id", "id", k=k)


def align_task1(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(weakness_id, rank, id, doc, chunk_no, score): the first task's snippets."""
    return best_of(score_pairs(records, chunks, ["task1"]), "task1").drop("prefix")


def status(records: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """records (weakness_id, group, pdf_url): what became of each: no_pdf_url, no_text_extracted, no_snippet_found or ok."""
    some = chunks.select("group").distinct().withColumn("__text", F.lit(True))
    hit = found.select("weakness_id").distinct().withColumn("__hit", F.lit(True))
    rows = records.select("weakness_id", "group", "pdf_url").join(some, "group", "left").join(hit, "weakness_id", "left")
    name = F.when(F.coalesce(F.col("pdf_url"), F.lit("")) == "", "no_pdf_url").when(F.col("__text").isNull(), "no_text_extracted").when(F.col("__hit").isNull(), "no_snippet_found").otherwise("ok")
    return rows.select("weakness_id", name.alias("status"))


def prompt_block(best: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, top: int = 3, chars: int = 1200) -> DataFrame:
    """One text per query: its best chunks with page and score."""
    shown = best.where(F.col("rank") <= top).join(chunks, chunk_id)
    line = F.concat(F.lit("(p."), F.col("page").cast("string"), F.lit(", score="), F.format_string("%.4f", F.round("score", 4)), F.lit(") "), F.substring("text", 1, chars))
    lines = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return shown.groupBy(query_id).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("block"))
