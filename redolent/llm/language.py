"""Document and segment languages by multilingual mixture inference.

Every language has a character n-gram model (hashed 2- to 5-grams of words, fitted on a bounded sample of labelled documents
and purged of wrong labels by two rounds of relabelling). A document is cut into sentences; their n-gram likelihoods under
all languages feed an expectation-maximisation that estimates in which proportions the document mixes the languages. The
language set is grown from one: a further language is taken if the mixture's likelihood grows by more than a penalty.
With the set and proportions fixed, the sentences get their languages by the most likely path with a cost for switching,
and neighbours of one language join to stretches. Confidence is the posterior of the language over the sentences of a
stretch, with the document's proportions as prior and a small rest for the languages outside its set.

N-grams don't run over words, so a sentence's likelihood is the sum of its words', and a word is scored once for each task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redolent.session import materialize, spread

#: Hash slots of an n-gram model, and the n-gram lengths.
SLOTS = 1 << 16
LENGTHS = (2, 3, 4, 5)
#: Log likelihoods of overlapping n-grams count one character several times; divided by this they are about honest.
TEMPER = 6.0
#: Nats of tempered likelihood that one word can tell at most: names and runs of letters tell as little as any word.
WORD = 4.0
#: Nats of tempered likelihood that a further language must win, and that a switch between sentences costs.
PENALTY, SWITCH = 6.0, 1.0
#: Prior of all languages outside a document's set together, for the confidence.
OUTSIDE = 0.01
#: Words a task keeps the likelihoods of (36 bytes each beside the word), and characters it takes at a time.
KNOWN, CHARS = 200_000, 2_000_000

_MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-z]{2,6};|https?://\S+|\bwww\.\S+", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?…。])[\"'”’»)\]]*\s+|\s*\n+\s*|(?<=[.!?])(?=[^\W\d_]{2})")
_LETTERS = re.compile(r"[^\W\d_]+")
_LIST = re.compile(r"^\W*(?:\w+(?: \w+)?\s*:\s*)?(?:[^,.;:]{1,30},\s*){2,}[^,.;:]{1,30}\W*$")
_NOTES = re.compile(r"^\W*notes?\s*:", re.IGNORECASE)


class Segment(NamedTuple):
    lang: str
    chars: int
    confidence: float


def normal(text: str) -> str:
    """Compatibility composition and markup out; case and white space are kept, as they tell names and lines apart."""
    return unicodedata.normalize("NFKC", _MARKUP.sub(" ", text))


def sentences(text: str) -> list[str]:
    """The sentences of a normalised text, however long."""
    return [" ".join(s.split()) for s in _SENTENCE.split(text) if s and not s.isspace()]


def words(sentence: str) -> list[str]:
    return _LETTERS.findall(sentence.lower())


def tells(sentence: str) -> bool:
    """Whether a sentence can be of a language: names (two or three words, all with a capital), single words and lists of notes can't."""
    found = _LETTERS.findall(sentence)
    if len(found) < 2 or (len(found) < 4 and all(w[0].isupper() for w in found) and (len(found) < 3 or not sentence.isupper())):
        return False
    if "," in sentence and (m := _LIST.match(sentence)):
        items = [x.split() for x in m[0].split(":")[-1].split(",")]
        return sum(map(len, items)) > 2.5 * len(items)
    return not _NOTES.match(sentence)


def grams(own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of the hashed n-grams of words, a space on either side; each length has slots of its own."""
    padded = [f" {w} " for w in own]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(own)), [len(t) for t in padded])
    slots, whose = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, min(max(LENGTHS), len(codes)) + 1):
        k = len(codes) - n + 1
        h = (h[:k] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in LENGTHS:
            inside = of[:k] == of[n - 1 :]
            slots.append((((h >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64) + LENGTHS.index(n) * SLOTS)[inside])
            whose.append(of[:k][inside])
    return np.concatenate(slots), np.concatenate(whose)


class Model:
    """Log likelihood tables: (n-gram slots x languages)."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)), dtype=np.float32)

    def _learn(self, new: list[str]) -> None:
        slots, whose = grams(new)
        rows = np.zeros((len(new), len(self.langs)), dtype=np.float64)
        for k in range(len(self.langs)):
            rows[:, k] = np.bincount(whose, self.table[slots, k], len(new))
        self.ids.update((w, len(self.rows) + i) for i, w in enumerate(new))
        rows /= TEMPER
        rows = np.maximum(rows, rows.max(axis=1, keepdims=True) - WORD)
        self.rows = np.concatenate([self.rows, rows.astype(np.float32)])

    def scores(self, units: list[list[str]]) -> np.ndarray:
        """(units x languages) tempered log likelihoods of units, each a list of words and none empty."""
        flat = [w for u in units for w in u]
        if not flat:
            return np.zeros((0, len(self.langs)))
        if len(self.ids) > KNOWN:
            self.ids, self.rows = {}, self.rows[:0]
        new = list(set(flat) - self.ids.keys())
        if new:
            self._learn(new)
        at = np.fromiter(map(self.ids.__getitem__, flat), dtype=np.int64, count=len(flat))
        starts = np.cumsum([0, *map(len, units[:-1])])
        return np.add.reduceat(self.rows[at].astype(np.float64), starts, axis=0)

    @classmethod
    def from_counts(cls, c: np.ndarray, langs: list[str]) -> Model:
        """From (languages x slots) n-gram counts."""
        table = np.zeros(c.shape, dtype=np.float64)
        for i in range(len(LENGTHS)):
            part = c[:, i * SLOTS : (i + 1) * SLOTS]
            back = part.sum(axis=0) + 0.5  # all languages together as the ground they are smoothed with
            back /= back.sum()
            strength = 400.0
            table[:, i * SLOTS : (i + 1) * SLOTS] = np.log((part + strength * back) / (part.sum(axis=1, keepdims=True) + strength))
        return cls(langs, np.ascontiguousarray(table.T.astype(np.float32)))


def mixture(scores: np.ndarray, weights: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(language set, proportions) of a document from its sentences' likelihoods: EM within a set, sets by penalised likelihood."""

    def em(chosen: list[int]) -> tuple[float, np.ndarray]:
        s = scores[:, chosen]
        top = s.max(axis=1, keepdims=True)
        p = np.exp(s - top)
        mix = np.full(len(chosen), 1 / len(chosen))
        for _ in range(30):
            r = p * mix
            r /= r.sum(axis=1, keepdims=True)
            new = np.maximum((r * weights[:, None]).sum(axis=0) / weights.sum(), 1e-6)
            done = np.abs(new - mix).max() < 1e-4
            mix = new / new.sum()
            if done:
                break
        return float((np.log((p * mix).sum(axis=1)) + top[:, 0]).sum()), mix

    chosen = [int(np.argmax(scores.sum(axis=0)))]
    candidates = sorted(set(np.argmax(scores, axis=1).tolist()) - set(chosen))
    if not candidates:
        return chosen, np.ones(1)
    best, mix = em(chosen)
    while candidates:
        tried = [(em([*chosen, k]), k) for k in candidates]
        (value, new), k = max(tried, key=lambda t: t[0][0])
        if value - best <= PENALTY:
            break
        chosen, best, mix = [*chosen, k], value, new
        candidates.remove(k)
    return chosen, mix


def units(text: str | None) -> list[str]:
    """The sentences of a text that can be of a language; where there is none, all of it if it has a letter."""
    if not text:
        return []
    found = sentences(normal(text))
    own = [u for u in found if tells(u)]
    if not own and (whole := " ".join(found)) and _LETTERS.search(whole):
        own = [whole]
    return own


def stretches(sizes: np.ndarray, scores: np.ndarray, langs: list[str]) -> list[Segment]:
    """The stretches of a text in order, from the lengths and the likelihoods of its sentences."""
    chosen, mix = mixture(scores, sizes)
    if len(chosen) == 1:
        order = [0] * len(sizes)
    else:  # the most likely path with a cost for each switch
        s = scores[:, chosen] + np.log(mix)
        path, back = s[0], []
        for row in s[1:]:
            stay, jump = path, path.max() - SWITCH
            back.append(np.where(stay >= jump, np.arange(len(chosen)), int(np.argmax(path))))
            path = np.maximum(stay, jump) + row
        k = int(np.argmax(path))
        order = [k]
        for b in reversed(back):
            k = int(b[k])
            order.append(k)
        order.reverse()
    prior = np.full(scores.shape[1], OUTSIDE / max(1, scores.shape[1] - len(chosen)))
    prior[chosen] = mix * (1 - OUTSIDE)
    sure = scores + np.log(prior)
    sure = np.exp(sure - sure.max(axis=1, keepdims=True))
    sure /= sure.sum(axis=1, keepdims=True)
    out: list[Segment] = []
    for i, k in enumerate(order):
        lang, c = langs[chosen[k]], float(sure[i, chosen[k]])
        if out and out[-1].lang == lang:
            last = out[-1]
            out[-1] = Segment(lang, last.chars + int(sizes[i]), (last.confidence * last.chars + c * sizes[i]) / (last.chars + sizes[i]))
        else:
            out.append(Segment(lang, int(sizes[i]), c))
    return out


def segments_of(texts: list[str | None], model: Model) -> Iterator[list[Segment]]:
    """The stretches of each text; none for null, empty and wordless texts. Texts are scored together, about CHARS at a time."""
    at = 0
    while at < len(texts):
        upto, chars = at, 0
        while upto < len(texts) and (upto == at or chars < CHARS):
            chars += len(texts[upto] or "")
            upto += 1
        own = [units(t) for t in texts[at:upto]]
        scores = model.scores([words(u) for us in own for u in us])
        start = 0
        for us in own:
            end = start + len(us)
            yield stretches(np.array([len(u) for u in us], dtype=np.float64), scores[start:end], model.langs) if us else []
            start = end
        at = upto


def segments(text: str | None, model: Model) -> list[Segment]:
    """The stretches of one text."""
    return next(segments_of([text], model))


def main_language(found: list[Segment]) -> tuple[str, float]:
    """The language of most of the text, and the share of the text it has times its confidence."""
    share: dict[str, float] = {}
    sure: dict[str, float] = {}
    for s in found:
        share[s.lang] = share.get(s.lang, 0) + s.chars
        sure[s.lang] = sure.get(s.lang, 0) + s.chars * s.confidence
    lang = max(share, key=lambda k: share[k])
    return lang, sure[lang] / sum(share.values())


def label_codes(languages: DataFrame) -> dict[str, str]:
    """What a label may say (folded to lower case): codes of two and three letters, names in English and in the language."""
    out = {}
    for r in languages.select("lang", "lang3", "english_name", "own_name").collect():
        out |= {x.strip().casefold(): r.lang for x in r if x}
    return out


def read_label(label: str | None, codes: dict[str, str]) -> str | None:
    """The language a label names, with or without a region; null if none."""
    if not label:
        return None
    text = unicodedata.normalize("NFKC", label).strip().casefold()
    return codes.get(text) or codes.get(re.split(r"[-_ ]", text)[0] if re.fullmatch(r"[a-z]{2,3}[-_ ][a-z0-9]{2,8}([-_ ][a-z0-9]+)*", text) else "")


def ngram_counts(sample: DataFrame, langs: list[str], model: Model | None = None) -> np.ndarray:
    """(languages x slots) n-gram counts of labelled texts (l, text); with a model, of the sentences it takes for the label's language.

    Counted on the executors: what comes back has at most languages * slots * lengths rows, whatever the texts."""
    shared = sample.sparkSession.sparkContext.broadcast((model.langs, model.table) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        counts = [Counter() for _ in langs]
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [w for u in units(text) if (w := words(u))]
                if own and found:
                    best = np.argmax(own.scores(found), axis=1)
                    found = [w for w, k in zip(found, best.tolist(), strict=True) if own.langs[k] == label]
                for w in found:
                    counts[langs.index(label)].update(w)
        for k, by in enumerate(counts):
            total = np.zeros(SLOTS * len(LENGTHS), dtype=np.int64)
            if by:
                slots, whose = grams(list(by))
                np.add.at(total, slots, np.fromiter(by.values(), dtype=np.int64, count=len(by))[whose])
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), k, dtype=np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["k", "slot", "n"])

    out = np.zeros((len(langs), SLOTS * len(LENGTHS)))
    got = sample.mapInArrow(run, "k int, slot int, n long").groupBy("k", "slot").agg(F.sum("n").alias("n")).toArrow()
    out[got["k"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def fit(docs: DataFrame, languages: DataFrame, rows_per_language: int = 400, rounds: int = 2) -> Model:
    """The model from labelled documents: of each language at most about rows_per_language, chosen by hash, whole texts.

    Labels may be wrong in part: each round drops the sentences that the model so far takes for another language. A language
    without labelled text is none of the model's. Only n-gram counts come to the driver."""
    codes = label_codes(languages)
    langs = sorted(set(codes.values()))
    label: Column = F.lower(F.trim(F.col("lang")))
    exact = docs.where("text IS NOT NULL").select(label.alias("l"), "text", F.xxhash64("doc_id").alias("h")).where(F.col("l").isin(langs))
    counts = {r.l: r.n for r in exact.groupBy("l").agg(F.count("*").alias("n")).collect()}
    low, span = -(2**63), 2**64
    rule = F.lit(False)
    for lang, n in counts.items():
        upto = low + int(span * min(1.0, rows_per_language / max(n, 1)))
        rule = rule | ((F.col("l") == lang) & (F.col("h") <= min(upto, 2**63 - 1)))
    sample = materialize(spread(exact.where(rule).select("l", "text"), 1), "labelled")
    seen = [x for x in langs if x in counts] or langs
    model = Model.from_counts(ngram_counts(sample, seen), seen)
    for _ in range(rounds):
        model = Model.from_counts(ngram_counts(sample, seen, model), seen)
    return model


def languages_of(docs: DataFrame, languages: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, chars, label, parts): seg_no 0 for each text with words, and its stretches from 1.

    label: the language its label names (null: missing or none); parts: how many languages the text is in. Null, empty
    and wordless texts have no rows; repeated rows are answered each; null doc_ids are kept; a text of one language
    has one stretch. The model is small (4 * 2^16 slots x 9 languages) and goes to every worker.
    """
    codes = label_codes(languages)
    model = model or fit(docs, languages)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            docs_, labels, texts = (c.to_pylist() for c in batch.columns)
            for doc, label, found in zip(docs_, labels, segments_of(texts, own), strict=True):
                if not found:
                    continue
                lang, sure = main_language(found)
                named, parts = read_label(label, codes), len({s.lang for s in found})
                out.append((doc, 0, lang, sure, sum(s.chars for s in found), named, parts))
                out += [(doc, i, s.lang, s.confidence, s.chars, named, parts) for i, s in enumerate(found, 1)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "seg_no", "lang", "confidence", "chars", "label", "parts"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")).mapInArrow(run, "doc_id long, seg_no int, lang string, confidence double, chars long, label string, parts int")


def missing_or_wrong(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang, confidence): seg_no 0 where the label is missing or names another language, and all stretches of mixed texts."""
    wrong = (F.col("seg_no") == 0) & (F.col("label").isNull() | (F.col("label") != F.col("lang")))
    return found.where(wrong | ((F.col("seg_no") > 0) & (F.col("parts") > 1))).select("doc_id", "seg_no", "lang", "confidence")
