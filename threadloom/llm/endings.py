"""Does a text stop before it is complete? A model of how sentences end, fitted on counts over all finished texts.

Tokens are words (names and numbers by class); the model counts, for contexts of one to four tokens, how often a
sentence ended there. A text without a full stop is complete if sentences do end after such a context.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

SEP = "\x1f"
LEAST_SEEN = 8
LEAST_SHARE = 0.04
LEAST_TAIL = 3
TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]")
LABEL = re.compile(r"^([A-Z][\w ]{0,24}?)(?: ?\d+)?:")
STOP = re.compile(r"[.!?。…][\"'”’»)\]]*$")
#: What a finished text may carry after its last sentence: a reference, a table number, a remark in brackets.
TRAILER = re.compile(r"\s*(?:\[[^\[\]]{1,60}\]|\([^()]{1,60}\))$")
NAME = re.compile(r"\b[A-Z][a-z]+(?=\W|$)")
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}


#: Tokens whose classes are kept.
KEPT = 50_000


class Kinds(dict):
    """By token: its class inside a sentence, its class at the start of one, and whether a sentence starts behind it."""

    def __missing__(self, t: str) -> tuple[str, str, bool]:
        if not t[0].isalnum():
            kind = t, t, t in ".!?:"
        elif t.isdigit() or re.fullmatch(r"[\d.,]+", t):
            kind = "0", "0", False
        elif any(c.isdigit() for c in t):
            kind = "N", "N", False
        else:
            kind = "N" if any(c.isupper() for c in t) else t.lower(), t.lower(), False
        if len(self) >= KEPT:
            self.clear()
        if len(t) <= 40:
            self[t] = kind
        return kind


KINDS = Kinds()


def classes(text: str) -> list[str]:
    out, start = [], True
    for t in TOKEN.findall(text):
        kind = KINDS[t]
        out.append(kind[start])
        start = kind[2]
    return out


def contexts(tokens: list[str], i: int) -> list[tuple[str, ...]]:
    """The contexts of one to four tokens that end at token i; never across a sentence."""
    out = []
    for n in range(1, 5):
        if i - n + 1 < 0 or tokens[i - n + 1] in (".", "!", "?"):
            break
        out.append(tuple(tokens[i - n + 1 : i + 1]))
    return out


def shape(tokens: list[str], i: int) -> tuple[str, ...]:
    """For rare words: the last letter, and the word two before."""
    return ("~", tokens[i - 2] if i >= 2 else "", tokens[i][-1])


def tally(text: str, seen: Counter, also: Counter, runs: Counter, ends: Counter) -> None:
    """Adds what a text holds: labels (l) and those that came last, tails of names (t); and its runs of four tokens, and those that ended a sentence, for spell."""
    found = [m[1] for line in text.split("\n") if (m := LABEL.match(line))]
    for x in set(found):
        seen[f"l{x}"] += 1
    if found:
        also[f"l{found[-1]}"] += 1
    if not STOP.search(text.strip()):
        return
    tokens = classes(text)
    whole = list(zip(["", "", "", *tokens], ["", "", *tokens], ["", *tokens], tokens[:-1], strict=False))
    runs.update(whole)
    # 12.5 is one number and no end of a sentence
    for i, t in enumerate(tokens):
        if i and t in ".!?" and not (i + 1 < len(tokens) and tokens[i - 1] == "0" and tokens[i + 1] == "0"):
            ends[whole[i - 1]] += 1
    if n := tokens[:-1].count("N"):
        seen["tN"] += n
    for w in NAME.findall(text):
        seen[f"t{w[-3:]}"] += 1


def spell(runs: Counter, ends: Counter, seen: Counter, also: Counter) -> None:
    """Moves runs to the contexts (c) that end with their last token, and ends to how many of these ended a sentence."""
    for counts, into in ((runs, seen), (ends, also)):
        for (*before, t), n in counts.items():
            if t[0].isalnum():
                c = f"c{t}"
                into[c] += n
                into[f"c~{SEP}{before[1]}{SEP}{t[-1]}"] += n
                for b in reversed(before):
                    if b in ("", ".", "!", "?"):
                        break
                    c = f"c{b}{SEP}{c[1:]}"
                    into[c] += n
        counts.clear()


def asked(text: str) -> list[str]:
    """The contexts that the verdict on a text may rest on: none if it ends with a full stop."""
    s = text.rstrip()
    if not s or STOP.search(s):
        return []
    tokens = classes(last_sentence(s))
    if not tokens or not tokens[-1][0].isalnum():
        return []
    i, last = len(tokens) - 1, tokens[-1]
    return [f"c{SEP.join(c)}" for c in [*contexts(tokens, i), shape(tokens, i), (last.removesuffix("s"),), (last.removesuffix("es"),)]]


def last_sentence(s: str) -> str:
    return re.split(r"(?<=[.!?])\s+", s)[-1]


class EndModel:
    def __init__(self, texts: Iterable[str]) -> None:
        seen: Counter = Counter()
        also: Counter = Counter()
        runs: Counter = Counter()
        ends: Counter = Counter()
        for text in texts:
            tally(text, seen, also, runs, ends)
        spell(runs, ends, seen, also)
        self._take((k, n, also[k]) for k, n in seen.items())

    @classmethod
    def of(cls, counts: Iterable[tuple[str, int, int]]) -> EndModel:
        """From (key, seen, also), the sums of tally over the texts."""
        model = cls([])
        model._take(counts)
        return model

    def _take(self, counts: Iterable[tuple[str, int, int]]) -> None:
        by: dict[str, list[tuple[str, int, int]]] = {"c": [], "l": [], "t": []}
        for k, n, m in counts:
            by[k[0]].append((k[1:], n, m))
        some = [(tuple(k.split(SEP)), n, m) for k, n, m in by["c"] if n >= LEAST_SEEN or SEP not in k]
        self.seen = {c: n for c, n, _ in some}
        self.ended = {c: m for c, _, m in some if m}
        self.closing = {x for x, n, m in by["l"] if n >= LEAST_SEEN and m >= 0.5 * n}
        self.inner = {x for x, n, _ in by["l"] if n >= LEAST_SEEN} - self.closing
        self.tails = {t for t, n, _ in by["t"] if n >= LEAST_TAIL}

    def truncated(self, text: str) -> bool:
        s = text.rstrip()
        if not s:
            return False
        found = [m[1] for line in s.split("\n") if (m := LABEL.match(line))]
        if any(x in self.inner for x in found) and self.closing:  # fields: complete only if the closing one is there
            return found[-1] not in self.closing or not re.search(r":\s*\S", s.split("\n")[-1])
        if s[-1] in "])" and (m := TRAILER.search(s)) and m.start() > 0:
            # a bare number in brackets that goes on counting, as in "(1) the data, (2)", closes nothing
            return bool(re.fullmatch(r"\s*\(\d{1,2}\)", m[0]) and re.search(r"\(1\)", s[: m.start()]))
        if STOP.search(s):
            return bool(re.search(r"(\.\.\.|…)$", s))
        return self._cut(s)

    def _cut(self, s: str) -> bool:
        if not s[-1].isalnum() and s[-1] not in "])}\"'”’»%*_`$":
            return True
        sentence = last_sentence(s)
        for a, b in PAIRS.items():
            if sentence.count(a) > sentence.count(b):
                return True
        if sentence.count('"') % 2:
            return True
        tokens = classes(sentence)
        if not tokens or not tokens[-1][0].isalnum():
            return False
        word = re.search(r"[^\W\d_]+$", s)
        if tokens[-1] == "N" and word and len(word[0]) > 2 and word[0].islower() is False and word[0][-3:] not in self.tails:
            return True
        rare = lambda c: self.ended.get(c, 0) < LEAST_SHARE * self.seen[c]
        last, found = tokens[-1], contexts(tokens, len(tokens) - 1)
        for c in reversed(found[1:]):
            if self.seen.get(c, 0) >= LEAST_SEEN:
                return rare(c)
        own = (last,)
        if last in ("N", "0"):
            return self.seen.get(own, 0) >= LEAST_SEEN and rare(own)
        if not any((w,) in self.seen for w in (last, last.removesuffix("s"), last.removesuffix("es"))):
            return True  # no word, so part of one
        for c in (shape(tokens, len(tokens) - 1), own):
            if self.seen.get(c, 0) >= LEAST_SEEN:
                return rare(c)
        return not self.ended.get(own)
