"""Problem 6: broken prompt and response pairs, by ordered rules that each look at one kind of defect.

Rules in order: empty (nothing, or only a placeholder), copied (the question, or what it quotes, given back with little
change), refusal (declines, in five languages), language (script or function words differ from the question's), truncated
(unclosed brackets, dangling hyphens or commas, endings after which sentences don't end; see endings). Every rule that
fires is emitted; `defect` is the first of them.

The ending model is fitted on all distinct answers of 40 characters or more that end with a full stop, each once: tasks
count, and only counts above the support threshold that an answer without a full stop asks for go to the driver. All else
looks at every pair by itself. Edges: a null question only lets rules on the answer alone fire; a null or blank answer is empty;
very long texts are judged whole; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import endings

WORD = re.compile(r"[^\W_]+")
BLANK = re.compile(r"[\s᠎​-‏⁠﻿]+")
#: Placeholders, in lower case without punctuation at the ends. Fixed values.
PLACEHOLDERS = {
    "", "na", "n/a", "n.a", "none", "null", "nil", "nan", "tbd", "tba", "todo", "to do", "to be done", "to be added", "no response", "no answer", "no comment", "no reply",
    "empty", "blank", "unknown", "not available", "not applicable", "not provided", "placeholder", "pending", "missing", "answer", "response", "text", "content", "undefined", "xxx", "lorem ipsum", "see above", "claim", "evidence",
}
FIRST_WORDS = {m[0] for p in PLACEHOLDERS if (m := WORD.search(p))}
#: Phrases that decline a task. They say who declines what, so that "the authors cannot exclude" isn't one.
REFUSALS = [
    r"\bI(?: am|'m|’m)? (?:cannot|can't|can’t|can not|won't|won’t|will not|unable to|not able to|not allowed to|not permitted to|must decline|have to decline|must refuse)(?: to)? ?(?:help|assist|judge|assess|comment|provide|produce|write|review|answer|comply|do|fulfil|fulfill|evaluate|offer|give|discuss|complete|continue|criticise|criticize|say|respond|take part|share|generate|create|carry out|be of)\b",
    r"\b(?:something|what) I (?:have to|must) decline\b", r"\bI (?:have to|must|need to|respectfully) (?:decline|refuse)\b", r"\bI(?:'d| would)(?: much)? rather not\b", r"\bI prefer not to\b",
    r"\bnot be (?:appropriate|right|proper|suitable) for me\b", r"\b(?:instructions|guidelines|rules|policy|policies|principles) (?:do|does) not (?:allow|permit|let) me\b", r"\b(?:outside|against|beyond) my (?:guidelines|instructions|rules|policy|policies|scope)\b",
    r"\bno (?:opinion|answer|comment|assessment) (?:is|can be|will be) (?:given|offered) here\b", r"\b(?:falls under|is) restricted content\b", r"\bas an? (?:AI|automated|artificial|language|virtual)\b[\w ]{0,30}\bI\b", r"\bI (?:am|'m) (?:just|only) an? (?:AI|assistant|language model)",
    r"\b(?:ich kann|kann ich)(?: \w+){0,3} nicht (?:helfen|beurteilen|bewerten|beantworten|kommentieren|schreiben|erstellen|weiterhelfen)", r"\bes tut mir leid, (?:aber|doch)", r"\bals (?:KI|Sprachmodell|automatischer|automatisierter)", r"\bmöchte (?:ich )?(?:mich )?(?:lieber )?nicht (?:äußern|kommentieren|dazu)", r"\bablehnen muss\b|\bmuss ich ablehnen\b",
    r"\bje (?:ne peux|ne suis) pas (?:en mesure|aider|vous aider|juger|évaluer|répondre|commenter|écrire|autorisé)", r"\bje (?:suis )?désolée?,? mais\b", r"\ben tant qu[e'’] ?(?:IA|assistant|modèle)", r"\bje préfère ne pas\b", r"\bje dois (?:décliner|refuser)",
    r"\b(?:no puedo|no podemos) (?:ayudar|evaluar|juzgar|responder|comentar|escribir|opinar)", r"\blo siento,? (?:pero )?(?:no|debo|prefiero|tengo que|me)\b", r"\bcomo (?:IA|asistente|modelo de lenguaje)", r"\bprefiero no\b", r"\bdebo (?:rechazar|declinar)",
    r"\bя не (?:могу|в состоянии|буду) (?:помочь|оценить|судить|ответить|комментировать|написать|оценивать)", r"\b(?:извините|простите), но\b", r"\bкак (?:ИИ|языковая модель|автоматический помощник|искусственный)", r"\bвынужден[ао]? отказаться\b",
]
REFUSAL = re.compile(r"\b(?:" + "|".join(r.removeprefix(r"\b") for r in REFUSALS) + ")", re.IGNORECASE)
#: The same for ASCII texts in lower case: without the flag most places are passed over at their first letter.
PLAIN_REFUSAL = re.compile(REFUSAL.pattern.lower())
#: Frequent function words. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as are was this be by not or which a an from at but have has we were its because".split(),
    "de": "der die das und ist nicht mit auf von zu den des dem ein eine einer wird sich auch für bei nach wenn dass wir nur als aus zum zur im".split(),
    "fr": "le la les et est des du une un dans pour que qui sur pas ne avec au aux par plus nous cette ce il alors".split(),
    "es": "el la los las y es de del una un en por que con no se para como al lo su más cuando aunque esta este pero".split(),
}
SCRIPTS = [("cyrillic", "Ѐ", "ԯ"), ("greek", "Ͱ", "Ͽ"), ("arabic", "؀", "ۿ"), ("hebrew", "֐", "׿"), ("cjk", "぀", "鿿"), ("hangul", "가", "힯"), ("devanagari", "ऀ", "ॿ"), ("thai", "฀", "๿")]
LETTER_RUNS = {name: re.compile(f"[{a}-{b}]+") for name, a, b in SCRIPTS}
OTHER_LETTER = re.compile("[" + "".join(f"{a}-{b}" for _, a, b in SCRIPTS) + "]")
LATIN = re.compile("[A-Za-zÀ-ɏ]+")
#: ASCII in lower case, with blanks for all but letters and digits.
PLAIN = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
ORDER = ["empty", "copied", "refusal", "language", "truncated"]
#: Share of an answer's runs of three words that the question must hold for a copy.
COPIED = 0.6
_OWNERS: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _OWNERS.setdefault(_w, []).append(_lang)


def words(text: str) -> list[str]:
    """The words of a text in lower case."""
    return text.translate(PLAIN).split() if text.isascii() else WORD.findall(text.lower())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if (first := WORD.search(answer)) and first[0].lower() not in FIRST_WORDS:
        return False
    s = BLANK.sub(" ", answer).strip()
    core = re.sub(r"^[\W_]+|[\W_]+$", "", s).lower()
    return core in PLACEHOLDERS


def language(text: str, of: list[str]) -> str | None:
    """Of the script most letters are in, for Latin the language of most function words; None if that is unclear. of: the words of the text."""
    if not text.isascii() and OTHER_LETTER.search(text):
        latin = sum(map(len, LATIN.findall(text)))
        by = {name: sum(map(len, run.findall(text))) for name, run in LETTER_RUNS.items()}
        # names stay in Latin letters whatever the language
        best = max(by, key=by.get)
        if by[best] * 2 > latin * 0.6 and by[best] >= 12:
            return best
    count = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in of:
        if w in _OWNERS:
            owners = _OWNERS[w]
            for lang in owners:
                count[lang] += 1 / len(owners)
    top, second = sorted(count.values(), reverse=True)[:2]
    if top < 3 or top < 1.6 * second:
        return None
    return max(count, key=count.get)


def quoted(question: str) -> str:
    """What a prompt quotes: its last block headed by a label, else the whole."""
    blocks = [b for b in re.split(r"\n\s*\n", question) if b.strip()]
    headed = [m[1] for b in blocks if (m := re.match(r"(?:[A-Z][\w ]{0,30}:)\s*(.*)\Z", b, re.DOTALL))]
    return headed[-1] if headed else question


def shingles(of: list[str]) -> set[tuple[str, str, str]]:
    return set(zip(of, of[1:], of[2:], strict=False))


def copied(q: list[str], a: list[str], body: list[str]) -> bool:
    """By the words of question, answer and what the question quotes."""
    if len(a) < 8:
        return bool(a) and len(a) >= 4 and " ".join(a) in " ".join(q)
    own = shingles(a)
    if len(own & shingles(q)) >= COPIED * len(own):
        return True
    # words dropped or misspelt: nearly all words of one are words of the other, whichever is the whole
    mine, theirs = set(a), set(body)
    common = len(mine & theirs)
    return common >= 0.7 * (len(mine) + len(theirs) - common)


def refuses(answer: str) -> bool:
    return bool(PLAIN_REFUSAL.search(answer.lower()) if answer.isascii() else REFUSAL.search(answer))


def defects(question: str | None, answer: str | None, model: endings.EndModel) -> list[str]:
    if is_empty(answer):
        return ["empty"]
    out, other = [], False
    if question:
        part = quoted(question)
        q, a = words(question), words(answer)
        body = q if part == question else words(part)
        if copied(q, a, body):
            out.append("copied")
        other = (to := language(answer, a)) is not None and (of := language(part, body)) is not None and of != to
    if refuses(answer):
        out.append("refusal")
    if other:
        out.append("language")
    if model.truncated(answer):
        out.append("truncated")
    return out


#: Different keys a task counts before it hands them on.
KEYS = 300_000


def ending_counts(pairs: DataFrame) -> DataFrame:
    """(key, seen, also): endings.tally over all distinct answers, as far as the model uses it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, also, runs, ends, wanted = Counter(), Counter(), Counter(), Counter(), set()

        def rows() -> pa.RecordBatch:
            endings.spell(runs, ends, seen, also)
            keys = list({*seen, *wanted})
            columns = [pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([also[k] for k in keys], pa.int64()), pa.array([k in wanted for k in keys], pa.bool_())]
            for x in (seen, also, wanted):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=["key", "seen", "also", "wanted"])

        for batch in it:
            for text in batch.column("answer").to_pylist():
                if len(text) >= 40:
                    endings.tally(text, seen, also, runs, ends)
                wanted.update(endings.asked(text))
                if len(runs) > KEYS // 10:
                    endings.spell(runs, ends, seen, also)
                if len(seen) + len(wanted) > KEYS:
                    yield rows()
        yield rows()

    texts = pairs.where("answer is not null").select("answer").distinct()
    counts = texts.mapInArrow(run, "key string, seen long, also long, wanted boolean").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("also").alias("also"), F.max("wanted").alias("wanted"))
    kind, word = F.substring("key", 1, 1), ~F.col("key").contains(endings.SEP)
    used = (kind == "c") & F.col("wanted") & ((F.col("seen") >= endings.LEAST_SEEN) | word & (F.col("seen") > 0))
    used |= (kind == "l") & (F.col("seen") >= endings.LEAST_SEEN) | (kind == "t") & (F.col("seen") >= endings.LEAST_TAIL)
    return counts.where(used).select("key", "seen", "also")


def fit(pairs: DataFrame) -> endings.EndModel:
    """The ending model of all answers."""
    rows = ending_counts(pairs).toArrow()
    return endings.EndModel.of(zip(*(rows.column(c).to_pylist() for c in ("key", "seen", "also")), strict=True))


def judge(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, question, answer) that have a defect, with defects (all that fired) and defect (the first)."""
    model = pairs.sparkSession.sparkContext.broadcast(fit(pairs))
    at = pairs.select(*keys, "question", "answer")
    schema = ", ".join(f"`{k}` {at.schema[k].dataType.simpleString()}" for k in keys) + ", defects array<string>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            q, a = batch.column("question").to_pylist(), batch.column("answer").to_pylist()
            found = [defects(x, y, model.value) for x, y in zip(q, a, strict=True)]
            hit = [i for i, f in enumerate(found) if f]
            if hit:
                rows = batch.select(keys).take(pa.array(hit, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([found[i] for i in hit], pa.list_(pa.string()))], names=[*keys, "defects"])

    return at.mapInArrow(run, schema).withColumn("defect", F.col("defects")[0])
