"""Problem 5: oversized texts cut at natural boundaries by one regex with bounded quantifiers.

Beside the text stands a row of marks, one for each character: at the last character of a run of white space the kind of
boundary it is, whatever the run's length (blank line, line end, end of a sentence, of a clause, mere space), likewise in
place of a full stop that needs no space behind it, and x elsewhere. The alternatives of the pattern run over the marks in the
order of boundary strength: the rest of the text if it fits, then for each kind as much as fits up to one, and at last any
character. Each consumes up to the limit less the overlap, the strong ones at least a part of it, so that pieces don't get
tiny. The consumed parts' lengths summed up are the offsets in the text, and each piece but the first looks back by the
overlap. Every character of the text is in a piece, in order; no piece has more than the limit.

Edges: null, empty and fitting texts are not cut; lengths count Unicode code points; an overlap of half the limit or more
is cut back to half; rows equal in key and place are told apart by nothing and give the same pieces; null limits mean no
limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of white space, as a regex class body.
SPACE = r"\s\x1C-\x1F\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Boundaries by falling strength (blank line, line, sentence, clause, space): mark, and the least share of the room a piece that ends there must use.
BOUNDARIES = [("\x01", 2), ("\x02", 2), ("\x03", 4), ("\x04", 4), ("\x05", 8)]
#: A run of more characters than the limit without these has no natural boundary.
NATURAL = SPACE + ".!?;,。"


def marks(text: Column) -> Column:
    """One mark for each character: every step puts the mark of one kind in the place of the last character of a run of white space that has none yet."""
    out = F.regexp_replace(text, f"[{SPACE}&&[^ \\n]]", " ")
    out = F.regexp_replace(out, r"[^ \n.!?\"')\];,:。]", "x")
    w, end = r"[ \n]", r"(?![ \n\x01-\x05])"
    out = F.regexp_replace(out, f"(?<!{w})(?= *+\\n *+\\n)({w}*){w}{end}", "$1\x01")
    out = F.regexp_replace(out, f"(?<!{w})(?= *+\\n)({w}*){w}{end}", "$1\x02")
    out = F.regexp_replace(F.regexp_replace(out, f"([.!?][\"')\\]]*+{w}*){w}{end}", "$1\x03"), "。", "\x03")
    out = F.regexp_replace(out, f"([;,:]{w}*){w}{end}", "$1\x04")
    out = F.regexp_replace(out, f"(?<!{w})({w}*){w}{end}", "$1\x05")
    return F.regexp_replace(out, r"[^\x01-\x05]", "x")


def pattern(room: Column) -> Column:
    """The pattern that consumes pieces of at most `room` marks."""
    parts = [F.concat(F.lit(r"[\x01-\x05x]{1,"), room.cast("string"), F.lit(r"}\z"))]
    for mark, share in BOUNDARIES:
        least = F.least(F.greatest(F.floor(room / share), F.lit(1)), room) - 1
        parts.append(F.concat(F.lit("[\x01-\x05x]{"), least.cast("string"), F.lit(","), (room - 1).cast("string"), F.lit("}" + mark)))
    parts.append(F.concat(F.lit("[\x01-\x05x]{1,"), room.cast("string"), F.lit("}")))
    return F.concat_ws("|", *parts)


def unbroken(text: Column, limit: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(f"[^{NATURAL}]{{"), (limit + 1).cast("string"), F.lit(",}")))


def split_oversize(items: DataFrame, limits: DataFrame, keys: list[str], limit_key: str) -> DataFrame:
    """items (keys, limit_key, text) joined with limits (limit_key, max_chars, overlap_chars); the oversized ones only.

    Returns keys, limit_key, max_chars, cut_kind and pieces: array of (piece_no, start, text), start counting from 0.
    """
    small = F.broadcast(limits.select(limit_key, "max_chars", "overlap_chars").where("max_chars > 0").dropDuplicates([limit_key]))
    big = items.select(*keys, limit_key, "text").join(small, limit_key).where(F.length("text") > F.col("max_chars"))
    overlap = F.least(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)), F.floor(F.col("max_chars") / 2).cast("int"))
    big = big.withColumn("__over", overlap).withColumn("__room", F.col("max_chars") - F.col("__over")).withColumn("__marks", marks(F.col("text")))
    parts = F.transform(F.regexp_extract_all("__marks", pattern(F.col("__room")), F.lit(0)), lambda p: F.length(p))

    def add(acc: Column, part: Column) -> Column:
        back = F.least(acc["end"], F.col("__over"))
        one = F.struct((F.size(acc["cuts"]) + 1).alias("no"), (acc["end"] - back).alias("start"), (back + part).alias("chars"))
        return F.struct((acc["end"] + part).alias("end"), F.array_append(acc["cuts"], one).alias("cuts"))

    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<no:int,start:int,chars:int>>").alias("cuts"))
    cuts = F.aggregate(parts, none, add, lambda acc: acc["cuts"])
    pieces = F.transform(cuts, lambda c: F.struct(c["no"].alias("piece_no"), c["start"].alias("start"), F.substring(F.col("text"), c["start"] + 1, c["chars"]).alias("text")))
    kind = F.when(unbroken(F.col("text"), F.col("max_chars")), "unbroken").otherwise("breakable")
    return big.select(*keys, limit_key, "max_chars", kind.alias("cut_kind"), pieces.alias("pieces"))
