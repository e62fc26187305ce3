"""Language of texts: scripts narrow the candidates, a Viterbi path labels spans."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from prepwright.llm.common import free_names, map_batches, texts_of

BUCKETS = 1 << 16
# Labelled documents a language is learned from, about: a hash of the id picks them.
TRAIN_DOCS = 2_000
# What a change of language costs, in nats. An ordinary word tells two languages apart by 2 to 10.
SWITCH = 20.0
# A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.01
NEVER = -1e4
# Code points scored together.
PIECE = 1 << 20
UNDETERMINED = "und"

# First code points of ranges, and the script from there on ("" is any other).
SCRIPTS = [
    (0x0000, "Latin"), (0x0250, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, ""), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, ""), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, ""), (0x31F0, "Katakana"), (0x3200, ""),
    (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"),
    (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, ""), (0xFF21, "Latin"), (0xFF66, "Katakana"),
    (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
NUMBER = np.array([NAMES.index(n) for _, n in SCRIPTS])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@dataclass(frozen=True)
class Words:
    """Words (runs of letters) of a text: where they start and end, and their letters' features."""

    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray   # of every letter
    first: np.ndarray      # where a word's features start
    scripts: np.ndarray


def words_of(text: str) -> Words:
    """Each letter's feature is a bucket of itself and its neighbours, where a word's edge is a neighbour too."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letter = np.concatenate([[False], _letters()[points], [False]])
    x = np.zeros(len(points) + 2, np.uint64)
    x[1:-1] = points
    x[~letter] = 0
    at = np.flatnonzero(letter)
    mixed = x[at - 1] * np.uint64(0x9E3779B97F4A7C15) + x[at] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 1] * np.uint64(0x165667B19E3779F9)
    features = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    starts = np.flatnonzero(letter[1:] & ~letter[:-1])
    ends = np.flatnonzero(letter[:-1] & ~letter[1:])
    scripts = NUMBER[np.searchsorted(STARTS, points[starts], "right") - 1]
    return Words(starts, ends, features, np.searchsorted(at, starts + 1), scripts)


def _pieces(text: str):
    """The lower-cased text in pieces of about PIECE characters that end between words, with their places."""
    low = text.lower()
    if len(low) != len(text):   # a few characters grow in lower case; places are those of the text
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    at = 0
    while at < len(low):
        end = min(at + PIECE, len(low))
        while end < len(low) and low[end - 1].isalpha():
            end += 1
        yield at, low[at:end]
        at = end


@dataclass(frozen=True)
class Model:
    """Log chance of each feature by language, and what a script allows. BUCKETS rows, a column per language.

    ``known`` tells for each script whether a language has it."""

    languages: list[str]
    features: np.ndarray
    scripts: np.ndarray
    known: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Score of each word in each language."""
        if not len(words.starts):
            return np.zeros((0, len(self.languages)))
        return np.add.reduceat(self.features[words.features], words.first, axis=0, dtype=np.float64) + self.scripts[words.scripts]


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path, where a change of language costs ``switch``.

    If no stretch of words gains more than half a switch by leaving the language that is best in total,
    a path of that language alone is best: two changes cost more than they gain.
    """
    best = int(scores.sum(axis=0).argmax())
    gains = np.cumsum(scores - scores[:, best:best + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gains, axis=0), 0)
    gain = np.maximum(gains[0], 0)
    if len(gains) > 1:
        gain = np.maximum(gain, (gains[1:] - low[:-1]).max(axis=0))
    if gain.max() <= switch / 2:
        return np.full(len(scores), best)
    total = scores[0].copy()
    came = np.empty(len(scores), np.int64)
    moved = np.zeros(scores.shape, bool)
    for t in range(1, len(scores)):
        came[t] = top = int(total.argmax())
        change = total[top] - switch
        moved[t] = total < change
        total = np.maximum(total, change) + scores[t]
    path = np.empty(len(scores), np.int64)
    now = int(total.argmax())
    for t in range(len(scores) - 1, -1, -1):
        path[t] = now
        if t and moved[t, now]:
            now = int(came[t])
    return path


def labelled(text: str, model: Model, switch: float = SWITCH) -> tuple[str, float, list[dict]]:
    """Language, the share of letters in its spans, and all spans as (start, end, lang) in characters.

    Words in scripts that no learned language has are in spans like others, but their letters count for no language.
    """
    starts, ends, scores, known = [], [], [], []
    for at, piece in _pieces(text):
        words = words_of(piece)
        starts.append(words.starts + at)
        ends.append(words.ends + at)
        scores.append(model.emissions(words))
        known.append(model.known[words.scripts])
    if not model.languages or not sum(map(len, starts)):
        return UNDETERMINED, 0.0, []
    begin, end = np.concatenate(starts), np.concatenate(ends)
    path = viterbi(np.concatenate(scores), switch)
    letters = np.bincount(path, weights=end - begin, minlength=len(model.languages))
    best = int(letters.argmax())
    own = ((end - begin) * ((path == best) & np.concatenate(known))).sum()
    change = np.flatnonzero(np.diff(path)) + 1
    spans = [{"start": int(begin[i]), "end": int(end[j - 1]), "lang": model.languages[path[i]]}
             for i, j in zip([0, *change], [*change, len(path)])]
    return model.languages[best], float(own / letters.sum()), spans


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from text and lang of labelled documents that are not held out, about ``train_docs`` a language.

    The driver gets BUCKETS counts a language at most, and one row a language before.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(NAMES), 0)), np.zeros(len(NAMES), bool))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1 << 32)) / float(1 << 32) < share

    def count(batches):
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                own = counts.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                for _, piece in _pieces(text):
                    words = words_of(piece)
                    own[:BUCKETS] += np.bincount(words.features, minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(words.scripts, weights=words.ends - words.starts, minlength=len(NAMES)).astype(np.int64)
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                yield {"lang": [lang] * len(at), "feature": at.astype(np.int32), "n": own[at]}
    found = (map_batches(rows.filter(drawn), count, "lang string, feature int, n bigint")
             .groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    counts[found["feature"], found["lang"].map({k: i for i, k in enumerate(languages)})] = found["n"]
    features, scripts = counts[:BUCKETS], counts[BUCKETS:]
    chances = np.log((features + 0.1) / (features.sum(axis=0) + 0.1 * BUCKETS))
    share_of = scripts / np.maximum(scripts.sum(axis=0), 1)
    allowed = share_of >= SCRIPT_SHARE
    barred = np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, NEVER)
    return Model(languages, chances.astype(np.float32), barred, allowed.any(axis=1))


def predicted(docs: DataFrame, model: Model, switch: float = SWITCH, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns to ``carry``, held_out, lang_pred, score, spans.

    ``lang_pred`` is the language of most letters and ``score`` their share, where letters of words in scripts
    that no learned language has add to the whole only; spans label the whole text.
    A text that is missing or has no letter is ``und`` with score 0, as is any text if nothing was learned.
    Of languages level in letters the first by name wins. Repeated rows give a row each. Nothing but text is
    looked at; carried columns of the names above are replaced. A text of any length is scored in pieces and
    labelled as a whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = ("held_out", "lang_pred", "score", "spans")
    carry = [c for c in carry if c.lower() not in made]
    (key,) = free_names(docs, "held_out")

    def run(batches):
        for batch in batches:
            found = [labelled(t, shared.value, switch) for t in texts_of(batch)]
            yield {c: batch.column(c) for c in carry} | {
                "held_out": batch.column(key), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "spans": [f[2] for f in found]}
    rows = docs.select(*dict.fromkeys([*carry, "text"]), held_out(F.col("doc_id")).alias(key))
    schema = StructType([*docs.select(*carry).schema.fields, *StructType.fromDDL(
        "held_out boolean, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>").fields])
    return map_batches(rows, run, schema)
