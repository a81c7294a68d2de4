"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips accents of Latin letters and of their look-alikes,
maps homoglyphs and, inside words, digits and signs to the letters they stand
for, and turns everything else into single spaces, so every term starts at a
word's start.  Accents may be a disguise or the spelling: texts are read both
with and without them, and terms are mined from both.  A term ending in a space is a whole word, one without is a stem.
Stems of inflected or invented terms are mined from labelled rows: what begins
many toxic texts' words and next to no clean ones'.  Matches inside an
exception phrase do not count.  The score is a logistic function of the
matches' weight per text and per word.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common
from fluxgrid.llm.quality import sampled_labels

THRESHOLD, FOLDS = 0.7, 3
#: Bound of the labelled sample per class, which one task gets.
SAMPLE_PER_CLASS = 3_000
#: A mined term begins at least this share of the toxic sample's words' texts, and is so many times rarer in clean ones.
LEAST_SHARE, LEAST_TEXTS, LEAST_RATIO = 0.01, 5, 16.0
#: Letters of the shortest and the longest stem.
STEM, LONGEST = 4, 16

#: Terms with a prior weight, and phrases in which they are harmless.
BASE_TERMS = {
    "idiot": 3.0, "idiots": 3.0, "moron": 3.0, "morons": 3.0, "stupid": 2.0, "scum": 3.0, "loser": 2.0, "losers": 2.0,
    "worthless": 2.0, "disgusting": 2.0, "pathetic": 2.0, "trash": 1.5, "clown": 1.5, "imbecile": 3.0, "dumbass": 3.0, "vermin": 2.0,
}
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "take out the trash", "clown fish", "circus clown", "sore loser", "idiot proof", "vermin control")

#: Look-alike letters, and the digits and signs used for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()}
_SUB = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[^\W\d_][0-9@$]|[0-9@$][^\W\d_]")
_WORD = re.compile(r"[^\W_][\w@$]*|[@$][\w@$]+")
_GAP = re.compile(r"[\W_]+")
_LOOKS = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_UNSEEN = re.compile("[\u200b-\u200d\ufeff\u00ad]")
_ODD = re.compile(r"[^\x00-\x7f]")
_ACCENTED = re.compile("[\u00df-\u00f6\u00f8-\u024f]")
_MARKS = re.compile("[\u0300-\u036f]")
_ACCENTS = re.compile("(?<=[a-z" + "".join(HOMOGLYPHS) + "])[\u0300-\u036f]+")


def _untwist(match: re.Match) -> str:
    word = match.group(0)
    return word.translate(_SUB) if _MIXED.search(word) and sum(c.isalpha() for c in word) * 3 >= len(word) else word


def _unveiled(text: str) -> str:
    text = unicodedata.normalize("NFKD", _UNSEEN.sub("", text)).lower()
    if _MARKS.search(text):
        text = _MARKS.sub("", unicodedata.normalize("NFC", _ACCENTS.sub("", text)))
    else:
        text = unicodedata.normalize("NFC", text)
    return text.translate(_TABLE) if _LOOKS.search(text) else text


@lru_cache(maxsize=1 << 16)
def _plain(char: str) -> str | None:
    """What stands for a character wherever it is, None if that depends on its neighbours."""
    return None if unicodedata.combining(char) or "\u1100" <= char <= "\u11ff" else _unveiled(char)


def unveil(text: str, accents: bool = False) -> str:
    """The text lower-cased, without invisible characters, widths, homoglyphs and, unless they are kept, accents of Latin letters."""
    low = text.lower()
    if low.isascii():
        return low
    for char in set(_ODD.findall(low)):
        if accents and _ACCENTED.match(char):
            continue
        plain = _plain(char)
        if plain is None:
            return _unveiled(low)
        if plain != char:
            low = low.replace(char, plain)
    return low


def fold(text: str, accents: bool = False) -> str:
    """The text as lower-case words between single spaces, disguises undone."""
    text = unveil(text, accents)
    if _MIXED.search(text):
        text = _WORD.sub(_untwist, text)
    return " " + _GAP.sub(" ", text) + " "


@dataclass
class Lexicon:
    """Terms with weights (a term without a trailing space is a stem), exceptions, and the logistic's coefficients."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-4.0, 2.5, 0.5)
    _automaton: object = field(default=None, repr=False)
    _bare: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None, "_bare": None}

    def absent(self, text: str) -> bool:
        """Whether no term occurs even inside a word and no digit or sign may stand for a letter: then folding is needless."""
        import ahocorasick

        if self._bare is None:
            self._bare = ahocorasick.Automaton()
            for term in self.terms:
                self._bare.add_word(unveil(term.strip()), 1)
            if len(self._bare):
                self._bare.make_automaton()
        low = unveil(text)
        if _MIXED.search(low):
            return False
        return not len(self._bare) or next(self._bare.iter(low), None) is None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                made.add_word(" " + term, (len(term), weight))
            for phrase in self.exceptions:
                if " " + phrase + " " not in made:
                    made.add_word(" " + phrase + " ", (len(phrase) + 1, None))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def matched(self, text: str) -> tuple[float, int, int]:
        """(weight of the counted matches, their number, words); one match, the heaviest, per word."""
        low, made = fold(text), self.automaton()
        if not len(made):
            return 0.0, 0, max(low.count(" ") - 1, 0)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for read in {low} if text.isascii() else {low, fold(text, accents=True)}:
            for end, (size, weight) in made.iter(read):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        if spared and best:
            best = {k: w for k, w in best.items() if not any(a <= k < b for a, b in spared)}
        return sum(best.values()), len(best), max(low.count(" ") - 1, 0)

    def inputs(self, text: str) -> tuple[float, float]:
        """Weight in all, and weight per square root of the length: both damped."""
        if self.absent(text):
            return 0.0, 0.0
        weight, _, n = self.matched(text)
        return math.log1p(weight), math.log1p(10.0 * weight / math.sqrt(max(n, 1)))

    def score(self, text: str) -> float:
        a, b, c = self.coefficients
        x, y = self.inputs(text)
        return 1.0 / (1.0 + math.exp(-max(min(a + b * x + c * y, 30.0), -30.0)))


def _mine(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Words and stems that mark toxic texts; texts that are copies of each other count once."""
    kept: dict[tuple[tuple, int], set[str]] = {}
    for text, label in zip(texts, labels, strict=True):
        words = set(fold(text).split())
        if not text.isascii():
            words |= set(fold(text, accents=True).split())
        if words:
            kept.setdefault((tuple(nsmallest(4, map(hash_word, words))), label), words)
    toxic = [words for (_, label), words in kept.items() if label]
    n1, n0 = len(toxic), max(len(kept) - len(toxic), 1)
    least = max(LEAST_TEXTS, LEAST_SHARE * n1)
    # texts in which a stem begins a word: letter by letter, since a frequent stem has frequent beginnings only
    seen: dict[str, int] = {}
    for n in range(STEM, LONGEST + 1):
        here: Counter[str] = Counter()
        for words in toxic:
            here.update({w[:n] for w in words if len(w) >= n and (n == STEM or w[: n - 1] in seen)})
        seen |= {t: k for t, k in here.items() if k >= least}
    whole: Counter[str] = Counter()
    for words in toxic:
        whole.update(w + " " for w in words if len(w) < STEM or w[:LONGEST] in seen)
    seen |= {t: k for t, k in whole.items() if k >= least}
    clean: Counter[str] = Counter()
    for (_, label), words in kept.items():
        if not label:
            clean.update(t for t in {w[:n] for w in words for n in range(STEM, min(len(w), LONGEST) + 1)} | {w + " " for w in words} if t in seen)
    good = {}
    for term, n in seen.items():
        ratio = ((n + 0.5) / (n1 + 1)) / ((clean[term] + 0.5) / (n0 + 1))
        if ratio >= LEAST_RATIO:
            good[term] = (n, math.log(ratio))
    wider: dict[str, int] = {}
    for term, (n, _) in good.items():
        wider[term[:-1]] = max(wider.get(term[:-1], 0), n)
    out = {}
    for term, (n, weight) in good.items():
        # the longest of the forms that cover about the same texts, and none within a wider form that is as telling
        if wider.get(term, 0) < 0.9 * n and not any(term[:k] in good and good[term[:k]][0] > n / 0.9 for k in range(STEM, len(term))):
            out[term] = weight
    return out


def hash_word(word: str) -> int:
    """A hash that does not depend on the process."""
    h = 1469598103934665603
    for b in word.encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def _calibrate(lexicon: Lexicon, texts: list[str], labels: list[int], share: float) -> tuple[float, float, float]:
    """Logistic regression on the two inputs, slopes kept non-negative, moved to the share of label 1."""
    x = np.array([[1.0, *lexicon.inputs(t)] for t in texts])
    y = np.array(labels, float)
    there = min(max(y.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(y > 0, share / there, (1 - share) / (1 - there))
    b = np.array([-3.0, 1.0, 0.5])
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + np.array([0, 1e-3, 1e-3]) * b
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + np.diag([1e-6, 1e-3, 1e-3])
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -1, 1)
        b[1:] = np.maximum(b[1:], 0.05)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = 1, per_class: int = SAMPLE_PER_CLASS) -> Lexicon:
    """A lexicon from the base terms and, in one task, a bounded sample of the labelled rows outside the held-out fold.

    Without rows of both labels the base terms and default coefficients stand.
    """
    some, n0, n1 = sampled_labels(labels, label, common.crc_fold("doc_id", folds) != held_out, per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))  # at most 2 * per_class
    share = n1 / max(n0 + n1, 1)

    def learn(table: pa.Table) -> Lexicon:
        sample = sorted(zip(table["label"].to_pylist(), table["text"].to_pylist(), strict=True))
        labels_, texts = [r[0] for r in sample], [r[1] for r in sample]
        lexicon = Lexicon({f"{t} ": w for t, w in BASE_TERMS.items()})
        if len(set(labels_)) == 2:
            lexicon = Lexicon(lexicon.terms | _mine(texts, labels_))
            lexicon.coefficients = _calibrate(lexicon, texts, labels_, share)
        return lexicon

    return common.fitted(rows, learn)


def _scores(batch: pa.RecordBatch, lexicon: Lexicon) -> np.ndarray:
    text = common.as_string(batch, "text")
    return np.fromiter((lexicon.score(t.as_py()) for t in text), float, len(text))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score in [0, 1] and predicted (score >= threshold).

    A null text scores as an empty one; a null id is not held out.  Only doc_id
    and text are read.  Repeated rows are scored each.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample: at most 1 / LEAST_SHARE terms a word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(batch, held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(common.trimmed(run), f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(common.crc_fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, whole and unchanged, whose score stays below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, held.value) < threshold))

    return docs.mapInArrow(common.trimmed(run), docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels outside fold 1 of 3."""
    docs = common.table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, common.table(spark, sf_dir, "labels")))
