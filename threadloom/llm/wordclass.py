"""Texts as sequences of word classes: function words by kind, other words by whether they are new or stand where function words are missing, names, numbers, links, marks."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa

#: Function words of the five languages by kind. Fixed values.
KINDS = {
    "det": "the a an this that these those each every some any all no both either neither der die das den dem des ein eine einen einem einer eines dieser diese dieses jede jeder le la les un une des l ce cette ces chaque tout toute el los las una unos unas este esta estos estas cada todo этот эта это эти каждый все весь",
    "prep": "of in to on with for by from at as over under between into through about than without within across after before per against during near up out via von zu mit auf bei nach für aus über unter ohne zwischen durch gegen um im am zum zur beim vom de du dans pour avec sur par sans sous entre vers chez à au aux en con por sobre sin para desde hasta del al в на с о для из по к от без при между под над у до через об после перед вокруг против около nach vor gegen hinter après avant contre después antes contra",
    "conj": "and or but nor yet so because since although though while when whereas if hence therefore thus unless once und oder aber denn weil obwohl wenn während dass sondern also daher et ou mais donc car parce puisque lorsque quand alors si y o u pero porque aunque cuando mientras pues и или но а что чтобы если хотя потому когда как то",
    "pron": "i we you he she it they them us me my our your his her its their there who which what where how why whose one wir ich sie er es ihr uns man sich wer was wo wie je nous vous il elle ils elles on qui que dont où quoi se nos notre leur yo nosotros usted ella ellos lo su sus nuestro nuestra мы я вы он она они оно его её их мне нас нам который которая где почему наш наша наше нашему нашего нашей warum unser unsere unserer unserem pourquoi notre qué porqué",
    "aux": "is are was were be been being am has have had do does did can could may might must should would will shall cannot ist sind war waren wird werden wurde hat haben kann können soll sollen sollte muss sein est sont était a ont été peut doit faut serait es son fue ha han puede debe debería está están быть был была было есть может должен должна",
    "adv": "not only never still also very more most less too already just even then here now however rather nicht nur auch sehr mehr noch immer schon hier nun klar pas ne plus aussi très moins toujours encore bien no sí más muy también solo ya aún menos не только также очень более ещё уже здесь нет лишь слишком лучше хуже вместе точнее zu besser schlechter zusammen gemeinsam genauer trop mieux meilleur meilleure ensemble demasiado mejor peor juntos better worse together",
}
NAMES = ["start", "new", "again", "near", "loop", "name", "number", "code", "link", "tag", "comma", "stop", "colon", "open", "close", "dash", "slash", "bar", "quote", "mark", "line", "long", "letter", "foreign", "bare", *KINDS]
ID = {n: i for i, n in enumerate(NAMES)}
K = len(NAMES)
OF = {w: ID[k] for k, words in KINDS.items() for w in words.split()}
MARKS = {",": "comma", ".": "stop", "!": "stop", "?": "stop", "…": "stop", "。": "stop", ":": "colon", ";": "colon", "(": "open", "[": "open", "{": "open", "<": "open", ")": "close", "]": "close", "}": "close", ">": "close", "-": "dash", "–": "dash", "—": "dash", "/": "slash", "\\": "slash", "+": "slash", "*": "slash", "|": "bar", '"': "quote", "'": "quote", "“": "quote", "”": "quote", "\n": "line"}
MARK_ID = {m: ID[n] for m, n in MARKS.items()}
TOKEN = re.compile(r"(?:https?|hxxps?|ftp)://[^\s\"'<>)\]]+|www\.[^\s\"'<>)\]]+|#[^\W_]\w[\w-]*|\d+(?:[.,]\d+)*%?|[^\W\d_]+(?:['’-][^\W_]+)*\d*|\n+|[^\w\s]|\w+")
#: A repeat is near within so many content words, else it is one at any distance; a loop repeats the word before it as well.
NEAR, LOOP = 6, 12
#: So many words in a row with at most so many function words among them aren't sentences: their content words are bare.
RUN, FEW = 16, 2
CONTENT = np.array([n in ("new", "again", "near", "loop", "name", "letter") for n in NAMES])


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The tokens of all texts one after another, and how many each text has."""
    found = [TOKEN.findall(t or "") for t in texts.to_pylist()]
    return pa.array(chain.from_iterable(found), pa.string()).dictionary_encode(), np.array([len(x) for x in found], np.int64)


def single(t: str) -> tuple[int, str]:
    """Class of a token by itself; of a content word its class where it is new in the middle of a sentence, and the word."""
    c = t[0]
    if c.isalpha():
        if "://" in t or (len(t) > 5 and t[:4].lower() == "www."):
            return ID["link"], ""
        low = t.lower()
        if low in OF:
            return OF[low], ""
        return (ID["name"] if c.isupper() else ID["letter"] if len(t) == 1 else ID["new"]), low
    if c.isdigit():
        return (ID["number"] if t[-1].isdigit() or t[-1] == "%" else ID["code"]), ""
    if c == "#" and len(t) > 1:
        return ID["tag"], ""
    return (ID["line"] if c == "\n" else MARK_ID.get(c, ID["mark"])), ""


def since_last(key: np.ndarray) -> np.ndarray:
    """How far back the same key stood, or a very large number."""
    order = np.argsort(key, kind="stable")
    out = np.full(len(key), 1 << 40)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    out[order[same + 1]] = order[same + 1] - order[same]
    return out


def bare(seq: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where the content words stand that are in a run of RUN words with at most FEW function words, wherever in the page.

    Words of table rows, lines with as many numbers as words, don't count.
    """
    function = seq >= ID["det"]
    word = function | CONTENT[seq]
    line = np.cumsum((seq == ID["line"]) | np.r_[True, of[1:] != of[:-1]]) if len(seq) else seq
    row = np.bincount(line, weights=seq == ID["number"]) >= np.bincount(line, weights=word)
    at = np.flatnonzero(word & ~row[line])
    if len(at) < RUN:
        return at[:0]
    some = np.r_[0, np.cumsum(function[at])]
    first = (some[RUN:] - some[:-RUN] <= FEW) & (of[at[RUN - 1 :]] == of[at[: len(at) - RUN + 1]])
    within = np.cumsum(np.r_[first, np.zeros(RUN - 1, bool)].astype(np.int64) - np.r_[np.zeros(RUN, bool), first[: len(at) - RUN]]) > 0
    return at[within & ~function[at]]


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Class ids of all texts one after another, and how many each has. Each distinct token is looked at once."""
    found, lengths = tokens(texts)
    words = found.dictionary.to_pylist()
    alone = [single(t) for t in words]
    ids: dict[str, int] = {}
    at = found.indices.to_numpy()
    seq = np.array([k for k, _ in alone], np.int8)[at]
    low = np.array([ids.setdefault(w, len(ids)) if w else -1 for _, w in alone], np.int64)[at]
    of = np.repeat(np.arange(len(lengths)), lengths)
    # a sentence starts at the start, behind a line end and behind . ! ? : if no word or number came since
    opens = np.array([t[:1] in (".", "!", "?", ":", "\n") for t in words], bool)[at]
    closes = np.array([t[:1].isalpha() or t[:1].isdigit() for t in words], bool)[at]
    place = np.arange(len(seq))
    last = np.r_[-1, np.maximum.accumulate(np.where(opens | closes, place, -1))[:-1]] if len(seq) else place
    begin = (np.cumsum(lengths) - lengths)[of]
    start = (last < begin) | (opens[last] if len(seq) else opens)
    content = np.flatnonzero(low >= 0)
    w, d = low[content], of[content]
    before = np.where(np.r_[True, d[1:] != d[:-1]], len(ids), np.r_[0, w[:-1]]) if len(w) else w
    many = len(ids) + 1
    alike = since_last(d * many + w)
    _, pair = np.unique(before * many + w, return_inverse=True)
    again = since_last(d * (len(w) + 1) + pair)
    digits = np.array([any(c.isdigit() for c in t) for t in words], bool)[at][content]
    short = np.array([len(t) == 1 for t in words], bool)[at][content]
    k = seq[content]
    k = np.where((k == ID["name"]) & start[content] & ~digits, np.where(short, ID["letter"], ID["new"]), k)
    k = np.where(alike <= NEAR, ID["near"], np.where(alike < 1 << 40, ID["again"], k))
    seq[content] = np.where(again <= LOOP, ID["loop"], k)
    seq[bare(seq, of)] = ID["bare"]
    return seq, lengths
