"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback encodes each text. Three measures follow: characters per
token (letters and digits count: symbols cost tokens and earn nothing), the share of
tokens that are single bytes for want of a piece, and the entropy of the document's tokens. Text
that the language's texts do not resemble (symbol runs, tables, keyboard noise, one word over and
over) leaves the band that its language, or else its script, is given. Beside them stand simple
counts (words, symbols, repeated lines, repeated 5-word windows) and the rules on those.

The bands of listed languages are fitted, by fit_bands(), on a bounded sample of labelled good texts,
half of the labels by a hash of their ids; tests hold them against the other half. Texts in other
languages have their script's loose band, set from short public texts in fifteen languages. Measures of
short texts vary more, so a limit on characters widens with one over the square root of the tokens.

Nulls: a null text has no words and fails for it. A null or unlisted lang takes its script's band.
Texts of any length are measured whole: a long one is encoded piece by piece, cut only before a
space or between characters without one, in constant memory. Repeated rows give equal rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import hash_words, mix, small_batches, split_words, windows

PIECE = 1 << 18
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("chars_per_token", T.DoubleType()), ("byte_share", T.DoubleType()), ("token_entropy", T.DoubleType()), ("n_tokens", T.LongType()), ("kept", T.BooleanType())]
ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64()}


@dataclass(frozen=True)
class Band:
    """A text is rejected when a measure leaves these limits."""

    least_chars: float  # letters and digits per token
    most_chars: float
    most_bytes: float
    least_entropy: float  # bits of entropy, as a share of the most that so many tokens can have

    def holds(self, chars: float, byte: float, entropy: float, tokens: int) -> bool:
        if not tokens:
            return True
        least = self.least_chars * (1 - WIDER / math.sqrt(tokens))
        return least <= chars <= self.most_chars and byte <= self.most_bytes and entropy >= self.least_entropy * math.log2(tokens + 1) - 1


#: Three times the deviation of one token's characters, as a share of the least mean.
WIDER = 2.1


@dataclass(frozen=True)
class Bands:
    #: What fit_bands() gives on sf0.1: of some 3,500 labelled good texts, the half that it may see.
    by_lang: dict = field(default_factory=lambda: {"en": Band(2.05, 8.0, 0.12, 0.61), "fr": Band(1.77, 8.0, 0.12, 0.56), "de": Band(2.07, 8.0, 0.12, 0.59), "es": Band(1.79, 8.0, 0.12, 0.60)})
    #: Four fifths of the least that a language of the script measured, for an article of the declaration of human rights;
    #: scripts that none of them is written in are "other", and only entropy can reject their texts.
    by_script: dict = field(default_factory=lambda: {"latin": Band(0.7, 9.0, 0.25, 0.35), "cyrillic": Band(0.8, 9.0, 0.3, 0.35), "greek": Band(0.65, 9.0, 0.3, 0.35), "arabic": Band(0.65, 9.0, 0.3, 0.35), "hebrew": Band(0.65, 9.0, 0.3, 0.35), "devanagari": Band(0.37, 9.0, 0.3, 0.35), "thai": Band(0.6, 9.0, 0.3, 0.35), "cjk": Band(0.5, 9.0, 0.6, 0.35), "other": Band(0.05, 12.0, 1.0, 0.3)})


#: Characters of the blocks that tell scripts apart (fixed values of the Unicode standard).
SCRIPTS = (("latin", re.compile("[A-Za-zÀ-ɏ\u1e00-\u1eff]")), ("cyrillic", re.compile("[\u0400-\u052f]")), ("greek", re.compile("[\u0370-\u03ff\u1f00-\u1fff]")), ("arabic", re.compile("[\u0600-\u06ff\u0750-\u077f]")), ("hebrew", re.compile("[\u0590-\u05ff]")), ("devanagari", re.compile("[\u0900-\u097f]")), ("thai", re.compile("[\u0e00-\u0e7f]")), ("cjk", re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")))


def script(text: str) -> str:
    counts = [(len(find.findall(text)), name) for name, find in SCRIPTS]
    most, name = max(counts, key=lambda c: c[0])
    return name if most else "other"


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in runs of about `most` characters, cut before a space where there is one."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        cut = cut if cut > at else at + most
        yield text[at:cut]
        at = cut
    yield text[at:]


class Fertility:
    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n = self.sp.get_piece_size()
        self.byte = np.array([self.sp.is_byte(i) for i in range(self.n)])

    def of(self, text: str) -> tuple[float, float, float, int]:
        """Letters and digits per token, byte share, entropy in bits, tokens."""
        counts, letters = np.zeros(self.n, np.int64), 0
        for piece in pieces(text):
            ids = self.sp.encode(piece, num_threads=1)
            letters += sum(map(str.isalnum, piece))
            if ids:
                got = np.bincount(ids)
                counts[: len(got)] += got
        n = int(counts.sum())
        if not n:
            return 0.0, 0.0, 0.0, 0
        p = counts[counts > 0] / n
        return letters / n, float(counts[self.byte].sum() / n), float(-(p * np.log2(p)).sum()), n


def repeats(offsets: np.ndarray, words: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """For each text: its words in windows of k words that it holds twice or more."""
    n, total = len(offsets) - 1, len(words)
    if total < k:
        return np.zeros(n, np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    starts = np.arange(total - k + 1)
    starts = starts[doc[starts] == doc[starts + k - 1]]
    keys = mix(windows(words, k)[starts] ^ mix(doc[starts].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, starts[twice], 1)
    np.add.at(marks, starts[twice] + k, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(doc[covered], minlength=n).astype(np.int64)


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, langs: list, fertility: Fertility, bands: Bands) -> dict[str, list]:
    offsets, flat = split_words(texts, lower=False)
    n_words = np.diff(offsets)
    lengths = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False))]).astype(np.int64)
    word_chars = lengths[offsets[1:]] - lengths[offsets[:-1]]
    repeat = repeats(offsets, hash_words(flat))
    out: dict[str, list] = {name: [] for name, _ in MEASURES}
    for i, text in enumerate(texts.to_pylist()):
        text = text or ""
        failed = bool(n_words[i] < 10 or 100 * repeat[i] > 20 * n_words[i])
        chars, byte, entropy, tokens = fertility.of(text)
        band = bands.by_lang.get(langs[i]) or bands.by_script[script(text)]
        fine = band.holds(chars, byte, entropy, tokens)
        row = (int(n_words[i]), int(word_chars[i]), len(SYMBOLS.findall(text)), dup_lines(text), int(repeat[i]), failed, chars, byte, entropy, tokens, bool(fine and not failed))
        for (name, _), value in zip(MEASURES, row, strict=True):
            out[name].append(value)
    return out


def rate(docs: DataFrame, model: str, bands: Bands | None = None, prefix: str = "", keep_columns: bool = False) -> DataFrame:
    """Adds the measures to docs(doc_id, text, lang); without keep_columns, to doc_id alone.

    A column of docs whose name is a measure's makes the call fail unless `prefix` sets them apart.
    """
    bands = bands or Bands()
    fields = [f for f in docs.schema.fields if keep_columns or f.name == "doc_id"]
    names = {f.name for f in fields}
    if clash := names & {prefix + name for name, _ in MEASURES}:
        raise ValueError(f"columns {sorted(clash)} are there already; give a prefix")
    schema = T.StructType([*fields, *[T.StructField(prefix + name, kind) for name, kind in MEASURES]])
    own = [f.name for f in fields]
    columns = list(dict.fromkeys([*own, "text", "lang"]))

    def run(batches):
        fertility = Fertility(model)
        for batch in small_batches(batches, "text", 1 << 20):
            found = measure(batch.column("text"), batch.column("lang").to_pylist(), fertility, bands)
            arrays = [batch.column(name) for name in own] + [pa.array(found[name], ARROW[kind]) for name, kind in MEASURES]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.select(*columns).mapInArrow(run, schema)


def fit_bands(docs: DataFrame, labels: DataFrame, model: str, most: int = 4000, margin: float = 0.06, fold: int = 0) -> Bands:
    """Bands by language around labelled good texts (quality 1) whose crc32 of the id is `fold` modulo 2, `most` texts in all.

    Characters per token and entropy may fall short of what all but one in two hundred of the texts have, each by
    its own length, by the margin; the byte share may be twice the greatest. Languages with fewer than 20 texts are left out.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).where(F.crc32(F.col("_id").cast("string")) % 2 == fold).distinct()
    sample = docs.join(good, F.col("doc_id") == F.col("_id")).drop("_id").orderBy(F.xxhash64("doc_id")).limit(most)
    rated = rate(sample.select("doc_id", "text", "lang"), model, prefix="_q_", keep_columns=True)
    found: dict[str, list] = {}
    for r in rated.where("not _q_base_failed and _q_n_tokens > 9").select("lang", "_q_chars_per_token", "_q_byte_share", "_q_token_entropy", "_q_n_tokens").collect():  # `most` rows at most
        found.setdefault(r[0], []).append((r[1] / (1 - WIDER / math.sqrt(r[4])), r[2], (r[3] + 1) / math.log2(r[4] + 1)))
    out = {}
    for lang, rows in found.items():
        if lang is not None and len(rows) >= 20:
            chars, byte, share = np.array(rows).T
            out[lang] = Band(round(float(np.quantile(chars, 0.005)) * (1 - margin), 2), 8.0, round(max(0.12, 2 * float(byte.max())), 2), round(float(np.quantile(share, 0.005)) * (1 - margin), 2))
    return Bands(by_lang=out)
