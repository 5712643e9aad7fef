"""Source, sink and projection queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import times, validate
from threadloom.plans import sql as S
from threadloom.runtime import latest, scratch_path, table
from threadloom.sources import enhanced, forum, lines


def tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines: sound or not, with the first 1,000 characters of damaged ones."""
    raw = table(spark, d, "enhanced_raw")
    sound = F.coalesce(enhanced.kind(enhanced.whole_json(F.col("raw"))) == "OBJECT", F.lit(False))
    return raw.select("line_no", sound.alias("sound"), F.when(~sound, F.substring("raw", 1, 1000)).alias("damaged"))


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, read again and aggregated."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    path = scratch_path(spark, "lines")
    lines.write_lines(docs, path)
    back = lines.read_strict(spark, path, docs.schema)
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.sum(F.length("text")).alias("text_chars"))


def control_char_scrub(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(lines.scrub(F.col("text"))).alias("digest"))


def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(forum.page_text(F.col("text"))).alias("digest"))


def page_url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Host, path and id of the papers' pages, the key of their file in the cache and the URLs to try."""
    p = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "pdf_url", "web_url"), ["submission_id"], "fetched_at", ["submission_id", "pdf_url", "web_url"])
    url = F.col("web_url")
    tries = forum.pdf_candidates(forum.pdf_url(F.col("pdf_url"), "https://papers.example"), url)
    return p.select("submission_id", F.try_parse_url(url, F.lit("HOST")).alias("host"), F.try_parse_url(url, F.lit("PATH")).alias("path"), F.try_parse_url(url, F.lit("QUERY"), F.lit("id")).alias("id"), F.md5("pdf_url").alias("cache_key"), F.size(tries).alias("n_tries"))


def safe_lists(spark: SparkSession, d: str) -> DataFrame:
    """Keywords trimmed and without blanks, null where none is left."""
    p = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "keywords"), ["submission_id"], "fetched_at", ["submission_id", "keywords"])
    return p.select("submission_id", F.array_join(forum.safe_list(F.col("keywords")), "|").alias("keywords"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions spelled in several ways, by plain name."""
    p = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "decision"), ["submission_id"], "fetched_at", ["submission_id", "decision"])
    return p.groupBy(forum.decision_name(F.col("decision")).alias("decision")).agg(F.count("*").alias("n"))


def fallback_weakness(spark: SparkSession, d: str) -> DataFrame:
    """The weakness, else the claim with its evidence, else a placeholder; and the paper inferred from ids or page."""
    rows = table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", "submission_id", "original_weakness", F.col("enhanced_review.claim").alias("claim"), F.col("enhanced_review.evidence").alias("evidence"), F.col("paper_context.web_url").alias("web_url"))
    r = latest(rows, ["weakness_id"], "enhanced_at", ["weakness_id", "submission_id", "original_weakness", "claim", "evidence", "web_url"])
    said = F.coalesce(forum.safe_text(F.col("original_weakness")), F.when(~X.blank(F.col("claim")), F.concat_ws(" ", forum.safe_text(F.col("claim")), forum.safe_text(F.col("evidence")))), F.lit("(no text)"))
    prefix = F.regexp_extract("weakness_id", r"^(.*?)_Reviewer_", 1)
    paper = F.coalesce(forum.safe_text(F.col("submission_id")), F.nullif(prefix, F.lit("")), F.regexp_extract("web_url", r"[?&]id=([^&#]+)", 1))
    return r.select("weakness_id", paper.alias("paper"), F.md5(said).alias("digest"))


#: Shape of one line of a batch's results.
RESULT = "custom_id string, response struct<body: struct<choices: array<struct<text: string>>>>, error string"


def batch_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a batch written as lines; a service, here one that echoes and fails now and then, writes its results as lines; both joined by custom id."""
    r = latest(table(spark, d, "enhanced_reviews").select("weakness_id", "enhanced_at", F.col("enhanced_review.claim").alias("claim")), ["weakness_id"], "enhanced_at", ["weakness_id", "claim"]).where("claim is not null")
    requests = r.select(F.concat_ws("::", F.lit("claim"), "weakness_id", F.lit("0")).alias("custom_id"), F.lit("POST").alias("method"), F.struct("claim").alias("body"))
    asked, told = scratch_path(spark, "requests"), scratch_path(spark, "results")
    requests.write.json(asked)
    lines_ = spark.read.schema(requests.schema).json(asked)
    fails = F.startswith(F.md5("custom_id"), F.lit("0"))
    results = lines_.select("custom_id", F.when(~fails, F.struct(F.struct(F.array(F.struct(F.col("body.claim").alias("text"))).alias("choices")).alias("body"))).alias("response"), F.when(fails, "no answer").alias("error"))
    results.write.json(told)
    parts = F.split("custom_id", "::")
    both = lines_.select("custom_id").join(spark.read.schema(RESULT).json(told), "custom_id")
    return both.select(parts[0].alias("kind"), parts[1].alias("weakness_id"), parts[2].cast("int").alias("idx"), F.md5(F.get("response.body.choices", F.lit(0))["text"]).alias("digest"), "error")


def review_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each sound raw line's review that shouldn't be there, and those that should."""
    v = enhanced.whole_json(F.col("raw"))
    rows = table(spark, d, "enhanced_raw").select("line_no", v.alias("v")).where(enhanced.kind(F.col("v")) == "OBJECT")
    review = rows.select("line_no", enhanced.as_object(F.variant_get("v", "$.enhanced_review", "variant")).alias("r")).where("r is not null")
    found = review.select("line_no", validate.key_issues(F.json_object_keys(F.to_json("r")), validate.REVIEW_KEYS).alias("k"))
    return found.select("line_no", F.array_join("k.extra", ",").alias("extra"), F.array_join("k.missing", ",").alias("missing"))


def section_index(spark: SparkSession, d: str) -> DataFrame:
    """Sections found again in the papers' pages: three spans of body text and the section names in larger type."""
    p = latest(table(spark, d, "paper_context").select("submission_id", "fetched_at", "sections_index"), ["submission_id"], "fetched_at", ["submission_id", "sections_index"])
    body = F.transform(F.sequence(F.lit(0), F.greatest(F.size("sections_index"), F.lit(0)) + 2), lambda i: F.struct(i.alias("no"), F.lit(10.0).alias("size"), F.lit("body").alias("text"), F.lit(1).alias("page")))
    heads = F.transform(F.coalesce("sections_index", F.array().cast(p.schema["sections_index"].dataType)), lambda x, i: F.struct((i + 1000).alias("no"), (12.04 + i / 1000).alias("size"), x["name"].alias("text"), x["page"].cast("int").alias("page")))
    spans = p.select(F.col("submission_id").alias("paper"), F.explode(F.concat(body, heads)).alias("s")).select("paper", "s.*")
    return forum.section_index(spans)


def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """Event times in all their spellings as microseconds."""
    return table(spark, d, "thread_events").select("timestamp").distinct().select("timestamp", times.usable_time(F.col("timestamp")).alias("micros"))


QUERIES = {f.__name__: f for f in [tolerant_scan, json_round_trip, control_char_scrub, page_text, page_url_parts, safe_lists, decisions, fallback_weakness, batch_requests, review_keys, section_index, iso_times]}
_PAPER = lambda **c: S.latest("paper_context", "submission_id", "fetched_at", c)
SQL = {
    "tolerant_scan": """SELECT line_no, coalesce(json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'OBJECT', false) AS sound,
        CASE WHEN NOT coalesce(json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) = 'OBJECT', false) THEN substring(raw, 1, 1000) END AS damaged FROM enhanced_raw""",
    "json_round_trip": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(length(text)) AS BIGINT) AS text_chars FROM documents GROUP BY 1",
    "control_char_scrub": f"SELECT doc_id, md5(regexp_replace(text, '{lines.CONTROLS}', ' ', 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "page_text": r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest FROM documents WHERE text IS NOT NULL",
    "page_url_parts": rf"""WITH p AS (SELECT submission_id, p, w, nullif(regexp_extract(w, '^https?://([^/?#]+)', 1), '') AS host, nullif(regexp_extract(w, '[?&]id=([^&#]+)', 1), '') AS id, regexp_extract(w, '^(https?://[^/]+)', 1) || '/pdf?id=' || regexp_extract(w, '[?&]id=([^&#]+)', 1) AS built FROM {_PAPER(p='pdf_url', w='web_url')})
        SELECT submission_id, host, regexp_extract(w, '^https?://[^/]+([^?#]*)', 1) AS path, id, md5(p) AS cache_key, CAST(length(list_distinct(list_filter([CASE WHEN NOT {S.blank('p')} THEN p END, CASE WHEN NOT {S.blank('p')} THEN regexp_replace(p, '^http:', 'https:') END, CASE WHEN id IS NOT NULL AND host IS NOT NULL THEN built END], lambda x: x IS NOT NULL))) AS INTEGER) AS n_tries FROM p""",
    "safe_lists": f"""WITH k AS (SELECT submission_id, list_filter(list_transform(k, lambda x: {S.strip('x')}), lambda x: x IS NOT NULL AND x <> '') AS k FROM {_PAPER(k='keywords')})
        SELECT submission_id, CASE WHEN length(k) > 0 THEN array_to_string(k, '|') END AS keywords FROM k""",
    "decisions": rf"""WITH l AS (SELECT lower(CASE WHEN regexp_matches(split_part({S.strip('d')}, chr(10), 1), '(?i)accept|reject') THEN split_part({S.strip('d')}, chr(10), 1) ELSE d END) AS s FROM {_PAPER(d='decision')})
        SELECT CASE WHEN regexp_matches(s, 'reject') THEN 'reject' WHEN regexp_matches(s, 'withdraw') THEN 'withdrawn' WHEN regexp_matches(s, 'accept|poster|oral|spotlight') THEN 'accept' END AS decision, count(*) AS n FROM l GROUP BY 1""",
    "batch_requests": f"""SELECT 'claim' AS kind, weakness_id, 0 AS idx, CASE WHEN NOT starts_with(md5('claim::' || weakness_id || '::0'), '0') THEN md5(c) END AS digest, CASE WHEN starts_with(md5('claim::' || weakness_id || '::0'), '0') THEN 'no answer' END AS error
        FROM {S.latest('enhanced_reviews', 'weakness_id', 'enhanced_at', {'c': 'enhanced_review.claim'})} WHERE c IS NOT NULL""",
    "review_keys": f"""WITH j AS (SELECT line_no, CAST(raw AS JSON) AS j FROM enhanced_raw WHERE json_valid(raw)), r AS (SELECT line_no, json_keys({S.json_object("(j->'enhanced_review')")}) AS k FROM j WHERE json_type(j) = 'OBJECT')
        SELECT line_no, array_to_string(list_sort(list_filter(k, lambda x: NOT list_contains({validate.REVIEW_KEYS}, x))), ',') AS extra, array_to_string(list_sort(list_filter({validate.REVIEW_KEYS}, lambda x: NOT list_contains(k, x))), ',') AS missing FROM r WHERE k IS NOT NULL""",
    "section_index": rf"""WITH x AS (SELECT submission_id AS paper, unnest(s).name AS n, unnest(s).page AS page, generate_subscripts(s, 1) AS i FROM {_PAPER(s='sections_index')}),
        h AS (SELECT paper, {S.strip('n')} AS name, page, i FROM x WHERE n IS NOT NULL), k AS (SELECT * FROM h WHERE length(name) BETWEEN 3 AND 80 AND regexp_matches(name, {S.quote(forum.HEADING)})),
        o AS (SELECT paper, min(i) AS i, arg_min(name, i) AS name, arg_min(struct_pack(p := page), i).p AS page FROM k GROUP BY paper, lower(name))
        SELECT paper, 's' || row_number() OVER (PARTITION BY paper ORDER BY i) AS section_id, name, CAST(page AS INTEGER) AS page FROM o""",
    "fallback_weakness": rf"""WITH r AS {S.latest("enhanced_reviews", "weakness_id", "enhanced_at", {"s": "submission_id", "w": "original_weakness", "c": "enhanced_review.claim", "e": "enhanced_review.evidence", "u": "paper_context.web_url"})}
        SELECT weakness_id, coalesce(CASE WHEN NOT {S.blank('s')} THEN {S.strip('s')} END, nullif(regexp_extract(weakness_id, '^(.*?)_Reviewer_', 1), ''), regexp_extract(u, '[?&]id=([^&#]+)', 1)) AS paper,
            md5(coalesce(CASE WHEN NOT {S.blank('w')} THEN {S.strip('w')} END, CASE WHEN NOT {S.blank('c')} THEN {S.strip('c')} || CASE WHEN NOT {S.blank('e')} THEN ' ' || {S.strip('e')} ELSE '' END END, '(no text)')) AS digest FROM r""",
    "iso_times": "SELECT DISTINCT timestamp, epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ)) AS micros FROM thread_events",
}
