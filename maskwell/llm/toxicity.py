"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, normalised by length.

Folding undoes case, look-alike letters of other scripts and digits or signs that stand for letters. The
lexicon holds whole words and beginnings of words with weights; those not given are learned from labelled rows: terms
far more frequent in toxic documents, chosen one after another by the toxic documents that they still help to cover.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices
from .labelled import held_out, training_rows

#: Insults with a weight of their own where too few labels are known.
SEED_WORDS = ("idiot", "moron", "imbecile", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "bastard", "asshole", "bitch", "retard")
SEED_WEIGHT = 2.0
#: Labelled rows that are learned from, at most: toxic ones and others.
TOXIC_ROWS, OTHER_ROWS = 4_000, 8_000
#: Lengths of word beginnings that may enter the lexicon; least log odds; times that terms may cover a document.
BEGINNINGS, LEAST_ODDS, COVERS = range(4, 8), 2.0, 3
#: Characters of folded text that hits are related to: a stretch of about a hundred words, of at least twenty.
STRETCH, LEAST_STRETCH = 600, 120

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "i", "м": "m", "н": "h", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
    "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ø": "o", "ł": "l", "đ": "d", "ħ": "h",
}
#: Digits and signs that stand for letters inside a word.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

_DIGITS = re.compile(r"(?<=[^\W\d_])[01345789]+(?=[^\W\d_])|(?<!\w)[01345789]+(?=[^\W\d_])|(?<=[^\W\d_])[013457](?!\w)")
_SIGNS = re.compile(r"(?<=\w)[@$!|]+(?=\w)|(?<![\w@$!|])[@$](?=[^\W\d_])")
_ANY_DIGIT = re.compile(r"\d")
_LETTERS = str.maketrans(LOOKALIKES | {c: None for c in INVISIBLE})
_MARKS = {c: None for c in range(0x300, 0x370)}
_STAND_INS = str.maketrans(STAND_INS)
#: in the end, signs part words, and l is written i, as the digit 1 may stand for both
_PARTS = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c«»“”„‘’…–—¿¡"} | {"l": "i"})


def fold(text: str | None) -> str:
    """The words of a text, folded, with one space before and after each text and at least one between words."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_LETTERS)
    if _ANY_DIGIT.search(text):
        text = _DIGITS.sub(lambda m: m[0].translate(_STAND_INS), text)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGNS.sub(lambda m: m[0].translate(_STAND_INS), text)
    return f" {text.translate(_PARTS)} "


def without_accents(folded: str) -> str:
    """Folded text with letters as they are without marks."""
    return unicodedata.normalize("NFKD", folded).translate(_MARKS)


@dataclass
class Lexicon:
    """Terms (" word " or " beginning", folded) with weights, phrases in which they don't count, and the calibration."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-4.0, 2.0, 0.5)
    _found: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_found": None}

    def automaton(self):
        if self._found is None:
            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight, False))
            for phrase in self.exceptions:
                phrase = " ".join(fold(phrase).split())
                made.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
            if len(made):
                made.make_automaton()
            self._found = made
        return self._found

    def measure(self, text: str | None) -> tuple[float, float]:
        """The weight of hits for a stretch of text, as logarithms: in the stretch that has most, and in the whole text.

        Neither grows with the length of a text: what is repeated with its surroundings counts the same.
        """
        folded = fold(text)
        made = self.automaton()
        if not len(made):
            return 0.0, 0.0
        hits = self._hits(made, folded)
        if not folded.isascii():  # accents may hide a plain word: what it adds without them counts too
            plain = without_accents(folded)
            if plain != folded:
                same = len(plain) == len(folded)  # else places have moved, and terms are matched by how often they are there
                shown = Counter((h[0] if same else 0, h[3]) for h in self._hits(made, folded, whole=True))
                for h in self._hits(made, plain, whole=True):
                    at = (h[0] if same else 0, h[3])
                    if shown[at]:
                        shown[at] -= 1
                    else:
                        hits.append(h)
        if not hits:
            return 0.0, 0.0
        hits.sort()
        most, held, first = 0.0, 0.0, 0
        for at, _, weight, _ in hits:
            held += weight
            while hits[first][0] <= at - STRETCH:
                held -= hits[first][2]
                first += 1
            most = max(most, held)
        size = max(LEAST_STRETCH, len(folded))
        return math.log1p(STRETCH * most / min(size, STRETCH)), math.log1p(STRETCH * sum(h[2] for h in hits) / size)

    @staticmethod
    def _hits(made, folded: str, whole: bool = False) -> list[tuple[int, int, float, str]]:
        """Start, end, weight and term of all hits outside exception phrases. whole: of whole words without accents only."""
        hits, spared = [], []
        for end, (size, weight, exception) in made.iter(folded):
            if exception:
                spared.append((end - size + 1, end))
            elif not whole or (folded[end] == " " and folded[end - size + 1 : end].isascii()):
                hits.append((end - size + 1, end, weight, folded[end - size + 1 : end + 1]))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b + 1 for a, b in spared)]
        return hits

    def score(self, text: str | None) -> float:
        a, b = self.measure(text)
        at = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))


def terms(text: str | None) -> set[str]:
    """All that a document could give the lexicon: its folded words, and their beginnings."""
    words = set(fold(text).split())
    found = {f" {w} " for w in words if len(w) > 2}
    for size in BEGINNINGS:
        found.update(f" {w[:size]}" for w in words if len(w) > size)
    return found


def _count(wanted: set[str] | None):
    """Documents of the task that each term is in; each row's terms too where wanted is given and the row is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        rows: list[tuple[str, int, int, list[str]]] = []
        for part in slices(batches, 64):
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found = terms(text) if wanted is None else terms(text) & wanted
                counts.update((t, label) for t in found)
                if wanted is not None and label == 1 and found:
                    rows.append(("", 1, 1, sorted(found)))
        rows += [(t, label, n, []) for (t, label), n in counts.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))],
            ["term", "label", "n", "found"],
        )

    return run


_COUNTS = "term string, label int, n long, found array<string>"


def _choose(documents: list[set[str]], toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> dict[str, float]:
    """Terms that mark toxic documents, each for the documents that others cover too little."""
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((other[t] + 0.5) / (n_other + 1)) for t, n in toxic.items()}
    least = max(3, n_toxic // 200)
    good = {t for t, x in odds.items() if x >= LEAST_ODDS and toxic[t] >= least}
    # a beginning gives way to a word that makes up most of it, a longer beginning to a shorter one as good
    by_start: dict[str, int] = {}
    for t in toxic:
        if t.endswith(" "):
            for size in BEGINNINGS:
                by_start[t[: size + 1]] = max(by_start.get(t[: size + 1], 0), toxic[t])
    good = {t for t in good if t.endswith(" ") or by_start.get(t, 0) < 0.8 * toxic[t]}
    holds: dict[str, list[int]] = {}
    for i, d in enumerate(documents):
        for t in d & good:
            holds.setdefault(t, []).append(i)
    room = np.full(len(documents), COVERS)
    chosen: dict[str, float] = {}
    while holds:
        gain = {t: int((room[at] > 0).sum()) for t, at in holds.items()}
        holds = {t: at for t, at in holds.items() if gain[t] >= least}
        if not holds:
            break
        best = max(holds, key=lambda t: (gain[t] * odds[t], -len(t), t))
        chosen[best] = odds[best]
        room[holds.pop(best)] -= 1
        if not best.endswith(" "):  # what begins with it is found already
            holds = {t: at for t, at in holds.items() if not t.startswith(best)}
    return chosen


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + 0.1 * beta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + 0.1 * np.eye(3)
        beta -= np.clip(np.linalg.solve(curve, slope), -4, 4)
    return tuple(float(b) for b in beta)


def learn_lexicon(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> Lexicon:
    """The lexicon of SEED_WORDS and of terms learned from a bounded number of labelled rows outside the held-out fold."""
    rows = training_rows(docs, labels, "toxic", {1: toxic_rows, 0: other_rows}).select("label", "text")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    weights = {" ".join(fold(w).split()).join("  "): SEED_WEIGHT for w in SEED_WORDS}
    if not n_toxic or not n_other:
        return Lexicon(weights, exceptions)
    seen = rows.filter("label = 1").mapInArrow(_count(None), _COUNTS).groupBy("term").agg(F.sum("n").alias("n"))
    # a term of a bounded number of documents each, so many in all that it marks half a percent of them
    toxic = Counter({r["term"]: r["n"] for r in seen.filter(F.col("n") >= max(3, n_toxic // 200)).collect()})
    context = rows.sparkSession.sparkContext
    wanted = context.broadcast(set(toxic))
    counted = rows.filter("label = 0").mapInArrow(lambda it: _count(wanted.value)(it), _COUNTS).groupBy("term").agg(F.sum("n").alias("n"))
    other = Counter({r["term"]: r["n"] for r in counted.collect()})
    # only terms that may be chosen come back with their documents: far fewer than all
    marks = {t for t, n in toxic.items() if math.log((n + 0.5) / (n_toxic + 1)) - math.log((other[t] + 0.5) / (n_other + 1)) >= LEAST_ODDS}
    marking = context.broadcast(marks)
    found = rows.filter("label = 1").mapInArrow(lambda it: _count(marking.value)(it), _COUNTS).filter("term = ''")
    documents = [set(r["found"]) for r in found.select("found").toLocalIterator()]
    learned = _choose(documents, toxic, other, n_toxic, n_other)
    for term in weights.keys() - learned.keys():  # what labels show to be harmless isn't kept
        if other[term] > 2 and math.log((toxic[term] + 0.5) / (n_toxic + 1)) < math.log((other[term] + 0.5) / (n_other + 1)) + 1:
            learned[term] = 0.0
    made = Lexicon({t: w for t, w in (weights | learned).items() if w > 0}, exceptions)
    made.exceptions = (*exceptions, *_benign_phrases(rows, made, n_other))
    points = np.array([(r["label"], r["a"], r["b"]) for r in rows.mapInArrow(_measured(made), "label int, a double, b double").collect()])
    # the sample has more toxic rows than all labels have; each class counts as in the sample's own balance of two to one
    made.curve = _fit_curve(points[:, 1:], points[:, 0], np.where(points[:, 0] == 1, 1.0, max(0.25, 2 * n_toxic / n_other)))
    return made


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            found = [lexicon.measure(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], ["label", "a", "b"])

    return run


def _benign_phrases(rows: DataFrame, lexicon: Lexicon, n_other: int) -> list[str]:
    """Two-word phrases around a term that several harmless training documents have and no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, counts = lexicon.automaton(), Counter()
        for part in slices(batches, 64):
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                folded, found = fold(text), set()
                for end, (size, _, exception) in made.iter(folded):
                    if not exception:
                        before, after = folded[max(0, end - size - 60) : end - size + 1].split()[-1:], folded[end - size + 1 : end + 60].split()[:2]
                        found.update({" ".join(before + after[:1]), " ".join(after)})
                counts.update((p, label) for p in found if " " in p)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in counts], pa.string()), pa.array([x for _, x in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["phrase", "label", "n"])

    found = rows.mapInArrow(run, "phrase string, label int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic")
    )
    return sorted(r["phrase"] for r in found.filter((F.col("other") >= max(3, n_other // 2000)) & (F.col("toxic") == 0)).collect())


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every text.

    One scan, no shuffle. Null and empty texts have no hits and get the score of such texts; long texts are read whole,
    and what they hold counts by stretch. Repeated rows, repeated ids and null ids (which are held out) are scored each
    by itself; other columns are dropped, whatever their names, and never read. A score equal to the threshold is over
    it. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = [lexicon.score(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, learn_lexicon(docs, read(spark, sf_dir, "labels")))
