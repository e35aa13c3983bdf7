"""Tokenizers and token filters of text indices, and the English stemmer."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tesserae.plans import ir
from tesserae.plans.ir import EngineError
from tesserae.plans.parser import constant

ALNUM = re.compile(r"[^\W_]+")
#: Common words left out by Stopwords (fixed values, by language code; others are given as lists).
STOPWORDS = {
    "en": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with i me my we our you your he him his she her its them what which who whom am were been being have has had having do does did doing because until while about against between through during before after above below from up down out off over under again further once here when where why how all any both each few more most other some nor only own same so than too very can just should now".split(),
    "fr": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y".split(),
    "de": "aber alle als also am an auch auf aus bei bin bis bist da dann das dass dein den der des dem die dies doch dort du durch ein eine einem einen einer eines er es euer für hatte hatten hier hinter ich ihr ihre im in ist ja jede jeder jedes kann mein mit nach nicht noch nun nur ob oder ohne sehr sein sich sie sind so und uns unter vom von vor war was weil wenn wer wie wir wird zu zum zur über".split(),
    "es": "a al algo como con de del desde donde el ella ellas ellos en entre era es esa ese eso esta este esto la las le les lo los me mi mis mucho muy más ni no nos o para pero por porque que quien se ser si sin sobre son su sus también te tu un una uno y ya yo".split(),
}


class Token(NamedTuple):
    text: str
    start: int
    end: int
    position: int


def call_of(e) -> tuple[str, list]:
    """Name and constant arguments of an analyzer expression."""
    if isinstance(e, ir.Var):
        return e.name, []
    if isinstance(e, ir.Call):
        return e.name, [constant(a) for a in e.args]
    if isinstance(e, ir.Lit) and isinstance(e.value, str):
        return e.value, []
    if isinstance(e, (tuple, list)):
        return e[0], list(e[1:])
    raise EngineError("parser::analyzer", f"not a tokenizer or filter: {e}")


def tokenizer(e):
    name, args = call_of(e)
    if name == "Raw":
        return lambda text: [Token(text, 0, len(text), 0)]
    if name == "Simple":
        return lambda text: [Token(m.group(), m.start(), m.end(), i) for i, m in enumerate(ALNUM.finditer(text))]
    if name == "Whitespace":
        return lambda text: [Token(m.group(), m.start(), m.end(), i) for i, m in enumerate(re.finditer(r"\S+", text))]
    if name == "NGram":
        least, most, prefix = (*args, *[1, None, False][len(args) :])
        most = most or least
        if not 0 < least <= most:
            raise EngineError("parser::analyzer", "NGram takes 0 < min <= max")
        return lambda text: [Token(text[i : i + n], i, i + n, 0) for i in range(1 if prefix else len(text)) for n in range(least, most + 1) if i + n <= len(text)]
    raise EngineError("parser::analyzer", f"no tokenizer {name} here")


def fold(text: str) -> str:
    special = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ı": "i", "þ": "th", "Þ": "TH"}
    return "".join(special.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in text)


def compounds(words: list[str]):
    known = sorted(set(words), key=len, reverse=True)

    def split(text: str) -> list[str] | None:
        if not text:
            return []
        for w in known:
            if text.startswith(w) and (rest := split(text[len(w) :])) is not None:
                return [w, *rest]
        return None

    return split


def token_filter(e):
    """A function from a word to the words that it becomes: none, one or several."""
    name, args = call_of(e)
    change = lambda f: lambda w: [f(w)]
    keep = lambda f: lambda w: [w] if f(w) else []
    if name in ("Lowercase", "LowerCase"):
        return change(str.lower)
    if name == "AlphaNumOnly":
        return keep(lambda w: w.isascii() and w.isalnum())
    if name == "AsciiFolding":
        return change(fold)
    if name == "RemoveLong":
        return keep(lambda w: len(w.encode()) < args[0])
    if name == "SplitCompoundWords":
        split = compounds(args[0])
        return lambda w: split(w) or [w]
    if name == "Stemmer":
        if args[0].lower() not in ("english", "en"):
            raise EngineError("parser::analyzer", f"no stemmer for {args[0]} here: english only")
        return change(stem)
    if name == "Stopwords":
        if isinstance(args[0], str) and args[0] not in STOPWORDS:
            raise EngineError("parser::analyzer", f"no stop words for {args[0]} here: give a list")
        words = frozenset(STOPWORDS[args[0]] if isinstance(args[0], str) else args[0])
        return keep(lambda w: w not in words)
    raise EngineError("parser::analyzer", f"no filter {name} here")


#: Tokenizers whose tokens are runs of characters of one class: the pattern, and the test for a character.
RUNS = {"Simple": (ALNUM, str.isalnum), "Whitespace": (re.compile(r"\S+"), lambda c: not c.isspace())}


@functools.cache
def characters(name: str) -> np.ndarray:
    """For each code point, whether it is of the tokenizer's class."""
    test = RUNS[name][1]
    return np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)


def runs(name: str, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, and for each its text's number, start, end and position: the same as the tokenizer's tokens."""
    words, *rest = arrow_runs(name, texts)
    return words.to_pylist(), *rest


def arrow_runs(name: str, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """runs(), with the words as an array that is cut out of the texts' bytes: no word becomes an object."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = characters(name)[code]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    places = edge
    if not joined.isascii():  # where characters begin among the bytes
        places = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])[edge]
    # what lies between words is an element too: so they share one list of places
    both = pa.StringArray.from_buffers(len(edge), pa.py_buffer(np.concatenate([[0], places]).astype(np.int32)), pa.py_buffer(joined.encode()))
    words = both.take(pa.array(np.arange(1, len(edge), 2)))
    doc = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(doc, np.arange(len(texts)))
    return words, doc, starts - at[doc], ends - at[doc], np.arange(len(starts)) - first[doc]


MOST_WORDS = 1 << 18  # words whose terms are remembered


def terms_of(filters: list):
    """From a word to the terms that all filters make of it; each distinct word goes through them once."""
    rest, known = [token_filter(f) for f in filters], {}

    def terms(word: str) -> list[str]:
        found = known.get(word)
        if found is None:
            found = [word]
            for f in rest:
                found = [y for x in found for y in f(x)]
            if len(known) >= MOST_WORDS:
                known.clear()
            known[word] = found
        return found

    return terms


def analyzer(tokenizer_expr, filters: list):
    first, terms = tokenizer(tokenizer_expr), terms_of(filters)
    return lambda text: [Token(x, t.start, t.end, t.position) for t in first(text) for x in terms(t.text)]


# --- the Porter2 algorithm for English, from its published description -------------------------------

VOWEL = "[aeiouy]"
DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Exceptional forms of the published description (fixed values).
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
WHOLE_1A = frozenset(["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(at: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, at)
        return m.end() if m else len(w)

    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def short_end(w: str) -> bool:
    return bool(re.search("(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$", w)) and bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in IRREGULAR:
        return IRREGULAR[w]
    w = w.lstrip("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = regions(w)
    w = re.sub("'s'$|'s$|'$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in WHOLE_1A:
        return w
    # 1b: -ed, -ing
    m = re.search("(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search("(ingly|edly|ing|ed)$", w)
        if m and re.search(VOWEL, w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLE):
                w = w[:-1]
            elif len(w) <= r1 and short_end(w):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2 and 3: longer suffixes give way to shorter ones
    for table, also in ((STEP2, 2), (STEP3, 3)):
        hit = next((s for s in sorted(table, key=len, reverse=True) if w.endswith(s)), None)
        if hit:
            if len(w) - len(hit) >= r1:
                w = w[: -len(hit)] + table[hit]
        elif also == 2 and w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif also == 2 and w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
        elif also == 3 and w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    hit = next((s for s in STEP4 if w.endswith(s)), None)
    if hit:
        if len(w) - len(hit) >= r2:
            w = w[: -len(hit)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
