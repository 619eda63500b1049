"""Language identification of mixed-language text.

Script ranges narrow each word's candidate languages; per-word scores come from character n-grams of
the word; Viterbi with a penalty for each switch labels the words of a text. The document's language
is that of most letters. Neighbouring words of one label form a span.

Null text, an empty one and one without letters: `und`, score 0, no spans. Digits, marks and other
signs of numbers (superscripts, fractions, Roman numerals) belong to no word of their own. Words in
scripts that no learned language uses count for no language; a text of such words alone gets the
language learned from most text with score 0. Spans run over such words. Ties go to the language that
is first by name. Equal texts get equal results; an empty table gives none. A model is learned from the
rows of the smallest hashes of id and text, whatever the order of rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, slices

UND = "und"
#: Documents that a model learns from at most, those of the smallest hashed ids; it bounds what reaches the driver.
FIT_DOCUMENTS = 3000
SWITCH = 14.0
#: Steps of a sequence that a piece has, and steps before it that it begins with.
PIECE, WARM = 256, 48
_BITS = 17
#: First code point of a script's main ranges, and the script; "" where no script begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1380, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1C80, "Cyrillic"),
    (0x1C90, "Georgian"), (0x1CC0, ""), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""),
    (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""),
    (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xA720, "Latin"),
    (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, ""), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, ""), (0x20000, "Han"), (0x323B0, ""),
]
_STARTS = [a for a, _ in SCRIPTS]
_NAMES = sorted({b for _, b in SCRIPTS})
_KIND = np.array([_NAMES.index(b) for _, b in SCRIPTS])
_words = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case; signs of numbers count where a letter is next to them."""
    found = _words.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between two spaces, and the word that each belongs to."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams (1 to 4, and the whole word) of words, and the word of each."""
    points, of = _letters(words)
    out, owners = [], []
    h = np.zeros(len(points), np.uint32)
    for n in range(1, 5):
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n)
        whole = of[: len(h)] == of[n - 1 :]
        out.append(h[whole])
        owners.append(of[: len(h)][whole])
        h = h[:-1] if n < 4 else h
    begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    place = (np.arange(len(points)) - begins[of]).astype(np.uint32)
    out.append(np.add.reduceat((points + np.uint32(7)) * (place * np.uint32(0x9E3779B1) | np.uint32(1)), begins).astype(np.uint32))
    owners.append(np.arange(len(words)))
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - _BITS)).astype(np.int64), np.concatenate(owners)


def scripts(words: list[str]) -> np.ndarray:
    """For each word the number, in _NAMES, of the script that most of its letters have."""
    points, of = _letters(words)
    kind = _KIND[np.searchsorted(_STARTS, points, side="right") - 1]
    kind[points == 32] = len(_NAMES)
    return np.bincount(of * (len(_NAMES) + 1) + kind, minlength=len(words) * (len(_NAMES) + 1)).reshape(len(words), -1)[:, :-1].argmax(axis=1)


@dataclass
class LanguageModel:
    """languages; scores[gram, language]: log probabilities less their mean; by script, which
    languages are candidates; which language was learned from most letters."""

    languages: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    default: int

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's score for each language, 0 for all if no language uses the word's script, and
        whether one does."""
        h, of = grams(words)
        total = np.stack([np.bincount(of, self.scores[h, k], len(words)) for k in range(len(self.languages))], axis=1)
        able = self.candidates[scripts(words)]
        best = np.where(able, total, -np.inf).max(axis=1, keepdims=True)
        out = np.where(able, total - np.where(np.isfinite(best), best, 0), -60.0)
        known = able.any(axis=1)
        return np.where(known[:, None], out, 0.0).astype(np.float32), known


def fit(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", limit: int = FIT_DOCUMENTS, by: str = "doc_id") -> LanguageModel:
    """Learns from at most `limit` of the rows with text and language for which `where` holds: those
    whose hashed `by` is smallest. Every language has the same prior; counts are smoothed by 0.5."""
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull())
    h = F.xxhash64(F.xxhash64(by), F.xxhash64(text))
    last = rows.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    fitted = [] if last is None else rows.where(h <= F.lit(last)).select(lang, text, h.alias("h")).orderBy("h").limit(limit).collect()
    counts: dict[str, Counter] = {}
    for name, t, _ in fitted:
        counts.setdefault(name, Counter()).update(words_of(t))
    languages = sorted(counts)
    table = np.zeros((1 << _BITS, len(languages)))
    letters = np.zeros((len(_NAMES), len(languages)))
    for k, name in enumerate(languages):
        words, times = list(counts[name]), np.fromiter(counts[name].values(), float, len(counts[name]))
        for i in range(0, len(words), 50_000):
            part, n = words[i : i + 50_000], times[i : i + 50_000]
            g, of = grams(part)
            table[:, k] += np.bincount(g, n[of], 1 << _BITS)
            letters[:, k] += np.bincount(scripts(part), n * np.fromiter(map(len, part), float, len(part)), len(_NAMES))
    seen = table.any(axis=1)
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * seen.sum() + 1e-9))
    scores = np.where(seen[:, None], logs - logs.mean(axis=1, keepdims=True), 0.0) if languages else logs
    able = (letters / np.maximum(letters.sum(axis=0), 1) >= 0.01) & (np.array(_NAMES) != "")[:, None]
    return LanguageModel(languages, scores.astype(np.float32), able, int(letters.sum(axis=0).argmax()) if languages else 0)


def viterbi(steps: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of each step of each sequence (arrays of steps x labels). A switch between any
    two labels costs `penalty`, so one maximum over all labels is enough for each step. Sequences are
    cut into pieces that run side by side, each begun WARM steps early. A lead of `penalty` wipes out
    what was before, so most pieces begin in the state, to the bit, in which the one before ends; the
    others run again from that one."""
    sizes = np.fromiter(map(len, steps), np.int64, len(steps))
    if not sizes.any():
        return [np.zeros(0, np.int8) for _ in steps]
    scores = np.ascontiguousarray(np.concatenate([s for s in steps if len(s)]).T, np.float32)
    labels, pieces = np.arange(len(scores), dtype=np.int8)[:, None], -(-sizes // PIECE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * PIECE
    length = np.minimum(np.repeat(sizes, pieces) - nth * PIECE, PIECE)
    came = np.empty(scores.shape, np.int8)  # for each step and label the best label of the step before

    def forward(v: np.ndarray, at: np.ndarray, n: np.ndarray, note: bool = True) -> np.ndarray:
        """The states after n steps (n falls) from the states v before the steps `at`."""
        v = v.copy()
        for t in range(n[0] if len(n) else 0):
            k = len(n) - np.searchsorted(n[::-1], t, side="right")
            now, i = v[:, :k], at[:k] + t
            m = now.max(axis=0) - np.float32(penalty)
            if note:
                came[:, i] = np.where(now >= m, labels, now.argmax(axis=0).astype(np.int8))
            now = np.maximum(now, m) + scores.take(i, axis=1)
            v[:, :k] = now - now.max(axis=0)
        return v

    first = np.zeros((len(scores), len(nth)), np.float32)
    later = np.flatnonzero(nth)
    first[:, later] = forward(first[:, later], begin[later] - WARM, np.full(len(later), WARM), note=False)
    last, again = np.empty_like(first), np.arange(len(nth))
    while len(again):
        again = again[np.argsort(-length[again], kind="stable")]
        last[:, again] = forward(first[:, again], begin[again], length[again])
        odd = np.zeros(len(nth), bool)
        odd[later] = (first[:, later] != last[:, later - 1]).any(axis=0)
        again = np.flatnonzero(odd & ~np.roll(odd, 1))
        first[:, again] = last[:, again - 1]
    # back from each label that a piece may end with, then from the one that it does end with
    order = np.argsort(-length, kind="stable")
    n, end = length[order], (begin + length - 1)[order]
    path, now = np.empty(scores.shape, np.int8), np.repeat(labels, len(order), axis=1)
    for t in range(n[0]):
        k = len(n) - np.searchsorted(n[::-1], t, side="right")
        i = end[:k] - t
        path[:, i] = now[:, :k]
        now[:, :k] = came[now[:, :k], i]
    before = np.empty_like(now)
    before[:, order] = now
    ends = last.argmax(axis=0)
    for p in later[::-1].tolist():
        ends[p - 1] = before[ends[p], p]
    found = path[np.repeat(ends, length), np.arange(len(came[0]))]
    return np.split(found, np.cumsum(sizes)[:-1])


class Labeller:
    """Labels texts by a model; word scores are kept between texts."""

    def __init__(self, model: LanguageModel, penalty: float = SWITCH, limit: int = 150_000):
        self.model, self.penalty, self.limit = model, penalty, limit
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)), np.float32)
        self.known = np.zeros(0, bool)

    def __call__(self, texts: list[str | None], spans: bool = False) -> tuple[list[str], list[float], list[list[dict]] | None]:
        """Language, score (share of the letters that have it) and spans of each text."""
        m = self.model
        if len(self.at) > self.limit:
            self._empty()
        words = [words_of(text or "") for text in texts]
        lengths = [np.fromiter(map(len, w), np.int32, len(w)) for w in words]
        if m.languages and (new := list(set().union(*words).difference(self.at))):
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            rows, known = m.words(new)
            self.rows, self.known = np.concatenate([self.rows, rows]), np.concatenate([self.known, known])
        at = [np.fromiter(map(self.at.__getitem__, w), np.int64, len(w)) if m.languages else np.zeros(0, np.int64) for w in words]
        paths = viterbi([self.rows[i] for i in at], self.penalty)
        langs, scores = [], []
        for path, n, i in zip(paths, lengths, at, strict=True):
            if not len(path):
                langs.append(UND)
                scores.append(0.0)
                continue
            share = np.bincount(path, n * self.known[i], len(m.languages))
            known = share.sum()
            k = int(share.argmax()) if known else m.default
            langs.append(m.languages[k])
            scores.append(float(share[k] / known) if known else 0.0)
        return langs, scores, [self._spans(t, p) for t, p in zip(texts, paths, strict=True)] if spans else None

    def _spans(self, text: str | None, path: np.ndarray) -> list[dict]:
        if not len(path):
            return []
        names = self.model.languages
        if (path == path[0]).all():
            # one language: from the first labelled word to the last
            first = next(w.start() for w in _words.finditer(text) if words_of(w[0]))
            last = next(w.start() for w in _words.finditer(text[::-1]) if words_of(w[0][::-1]))
            return [{"start": first, "end": len(text) - last, "lang": names[path[0]]}]
        if len(text.lower()) == len(text) and len(at := [w.span() for w in _words.finditer(text)]) == len(path):
            # lowering cut no word, and each has a label
            turns = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(at)]
            return [{"start": at[i][0], "end": at[j - 1][1], "lang": names[path[i]]} for i, j in zip(turns, turns[1:])]  # noqa: B905
        out: list[dict] = []
        # labels belong to the words of the lower-case text; lowering can cut a word (the dot of an I with one is no letter)
        at = 0
        for w in _words.finditer(text):
            n = 1 if w[0].isascii() and any(map(str.isalpha, w[0])) else len(words_of(w[0]))
            if not n:
                continue
            name, at = names[path[at]], at + n
            if out and out[-1]["lang"] == name:
                out[-1]["end"] = w.end()
            else:
                out.append({"start": w.start(), "end": w.end(), "lang": name})
        return out


def span_text(spans: str = "spans") -> Column:
    """Spans as text: start-end:language, by spaces."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["lang"])), " ")


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", spans: bool = True, penalty: float = SWITCH) -> DataFrame:
    """The columns in `keep`, lang_pred, score and, if wanted, spans (start, end in code points, lang)."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "spans")]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())] + [T.StructField("spans", kind)] * spans)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by the n-gram table and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(sent.value, penalty)
        for batch in batches:
            for part, texts in slices(batch, "__text"):
                langs, scores, found = label(texts, spans)
                arrays = [part.column(i) for i in range(len(keep))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())] + ([pa.array(found, arrow)] if spans else [])
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return mapped(docs.select(*keep, docs[text].alias("__text")), run, schema)
