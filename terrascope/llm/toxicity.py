"""Toxicity by a weighted lexicon.

Texts are folded: case and width, letters of other scripts that look Latin, and digits or signs that stand for letters
inside words. The lexicon holds stems, each with the log odds of its texts being toxic, learned from labelled rows, in
which a group of copies or near copies counts as one text; the best stem of a word enters (of equal ones the longest),
and no other stem of the same word. Nothing but the documented sample bounds the lexicon. An Aho-Corasick automaton finds
stems at word starts and exception phrases anywhere; a stem inside an exception phrase does not count. The weights found,
as a sum and per word, give the score by a logistic curve fitted to the same rows.

Defined results: a null or empty text has no words and gets the score of a text without finds; labels that are null are
left out; without toxic and clean labels the lexicon is empty and all scores are 0; equal texts get equal scores; a
column named like the result is replaced; a long text is folded and scanned whole in one task.
"""

from __future__ import annotations

import dataclasses
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, signed, staged, text_chunks
from .jaccard import SHINGLE, shingle_sets

# Letters that look like Latin ones, and what digits and signs stand for inside words.
HOMOGLYPHS = str.maketrans(
    "авеікмнорстухѕјԁһӏ" "αβεικνορτυχ" "ıℓ",
    "abeikmhopctyxsjdhl" "abeikvoptux" "il")
DIGITS = str.maketrans("01345789", "oieastbg")
SIGNS = str.maketrans("@$!|", "asil")  # only before a letter or digit: elsewhere they are punctuation

FIT_ROWS = 20_000  # labelled rows the model is fitted on, in the mean; the rows are chosen by a hash of their id
STEM = (3, 12)  # letters in a stem
LEAST_TEXTS, LEAST_ODDS = 4, 3.0  # different toxic texts with a stem, and its log odds
WHOLE = 1 << 20  # the weight of a text without copies: weights are whole, so that their sums have no order
EXCEPTIONS: tuple[str, ...] = ()  # phrases in which a stem is harmless, beside the learned ones
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    T.StructField("stems", T.ArrayType(T.StringType()))])
_ARROW = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("stems", pa.list_(pa.string()))])
_SIGN = re.compile(r"[@$!|](?=[^\W_])")
_MIXED = re.compile(r"\w*[0-9]\w*")
_LETTER = re.compile(r"[^\W\d_]")
_BREAKS = re.compile(r"[\W_]+")


def _letters_for_digits(match: re.Match) -> str:
    word = match.group()
    return word.translate(DIGITS) if _LETTER.search(word) else word


def folded(text: str | None) -> str:
    """Words of plain letters, each with one space before it and one at the end."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(HOMOGLYPHS)
    text = _SIGN.sub(lambda m: m.group().translate(SIGNS), text)
    text = _MIXED.sub(_letters_for_digits, text)
    return f" {_BREAKS.sub(' ', text).strip()} "


@dataclasses.dataclass(frozen=True)
class Model:
    """A fitted lexicon: stems with weights, exception phrases, and (intercept, sum, per word) of the curve."""

    stems: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(f" {stem}", (len(stem), stem, weight))
        for phrase in self.exceptions:
            found.add_word(folded(phrase), (len(folded(phrase)) - 2, None, 0.0))
        if not len(found):
            return None
        found.make_automaton()
        return found

    def score(self, total: float, words: int) -> float:
        if not self.stems:
            return 0.0
        a, b, c = self.curve
        x = a + b * np.log1p(total) + c * np.log1p(100 * total / max(words, 1))
        return float(1 / (1 + np.exp(-x)))


def finds(automaton: ahocorasick.Automaton | None, text: str) -> list[tuple[int, str, float]]:
    """(start of the word, stem, weight) of every stem outside exception phrases, in folded text."""
    if automaton is None:
        return []
    hits, excused = [], []
    for end, (size, stem, weight) in automaton.iter(text):
        if stem is None:
            excused.append((end - size, end))
        else:
            hits.append((end - size + 1, stem, weight))
    return [h for h in hits if not any(a <= h[0] < b for a, b in excused)] if excused else hits


def _words(text: str) -> int:
    return text.count(" ") - 1 if text.strip() else 0


def fit(
    docs: DataFrame, labels: DataFrame, training: Column | None = None, fit_rows: int = FIT_ROWS,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """Learn a model from labelled rows. `training` chooses them; of these about `fit_rows` are read, by hash of id.

    Tasks count stems per text before anything is shuffled; the driver gets the stems that qualify, their neighbours
    and two sums per row of the sample.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic"))
    if training is not None:
        known = known.filter(training)
    total = known.count()
    part = min(1.0, fit_rows / max(total, 1))
    picked = F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(1 << 20)) < int(part * (1 << 20))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(picked)
    rows = _weighed(staged(texts.join(known.filter(picked), "id").select("toxic", "text"), "toxicity-rows"))
    counts = {r["toxic"]: r["texts"] / WHOLE for r in rows.groupBy("toxic").agg(F.sum("weight").alias("texts")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Model({}, exceptions, (0.0, 0.0, 0.0))

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for mark, doc, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counted = set(folded(doc).split()), seen[mark == 1]
                for stem in {w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)}:
                    counted[stem] += weight
        names = [s for s in seen[1]]
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([seen[1][s] for s in names], pa.int64()),
            pa.array([seen[0][s] for s in names], pa.int64())], ["stem", "bad", "good"])
        # clean texts only weigh on stems that are in toxic ones somewhere; those of other tasks count too
        names = [s for s in seen[0] if s not in seen[1]]
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()),
            pa.array([seen[0][s] for s in names], pa.int64())], ["stem", "bad", "good"])

    odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    counted = rows.mapInArrow(stems, "stem string, bad long, good long").groupBy("stem").agg(
        (F.sum("bad") / WHOLE).alias("bad"), (F.sum("good") / WHOLE).alias("good"))
    chosen = counted.filter(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    lexicon: dict[str, float] = {}
    starts: set[str] = set()
    # what the bounded sample has: no table of the corpus grows into this
    for row in sorted(chosen.collect(), key=lambda r: (-r["odds"], -len(r["stem"]), r["stem"])):
        stem = row["stem"]
        parts = [stem[:n] for n in range(STEM[0], len(stem) + 1)]
        if stem not in starts and not any(p in lexicon for p in parts):
            lexicon[stem] = float(row["odds"])
            starts.update(parts)

    plain = Model(lexicon, exceptions, (0.0, 0.0, 0.0))
    excused = _learned_exceptions(rows, plain)
    model = Model(lexicon, (*exceptions, *excused), (0.0, 0.0, 0.0))
    return dataclasses.replace(model, curve=_curve(rows, model))


def _weighed(rows: DataFrame) -> DataFrame:
    """toxic, text and `weight`: `WHOLE` shared by the rows of one label whose texts are copies or near copies, known by
    the least hash of their five-word shingles, so that a group of copies counts as one text."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.zeros(batch.num_rows, np.uint64)
            for row, data, offsets in text_chunks(batch.column(1)):
                tokens, limits = shingle_sets(data, offsets, SHINGLE)
                some = np.flatnonzero(np.diff(limits))
                signs[row + some] = tokens[limits[:-1][some]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(signed(signs))], ["toxic", "text", "sign"])

    told = rows.mapInArrow(sign, "toxic int, text string, sign long")
    shares = staged(told.groupBy("toxic", "sign").agg(F.count(F.lit(1)).alias("n")), "toxicity-copies")
    return staged(told.join(shares, ["toxic", "sign"]).select(
        "toxic", "text", F.ceil(F.lit(float(WHOLE)) / F.col("n")).cast("bigint").alias("weight")),
        "toxicity-weighed")


def _learned_exceptions(rows: DataFrame, model: Model) -> list[str]:
    """Pairs of neighbouring words around a stem that are in clean texts three times or more, and there more often."""
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = model.automaton(), (Counter(), Counter())
        for batch in batches:
            for mark, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = folded(doc)
                for start, _, _ in finds(automaton, text):
                    end = text.index(" ", start)
                    before = text.rfind(" ", 0, start - 1)
                    after = text.find(" ", end + 1)
                    if before >= 0:
                        seen[mark == 1][text[before + 1:end]] += 1
                    if after > 0:
                        seen[mark == 1][text[start:after]] += 1
        names = sorted(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()), pa.array([seen[1][p] for p in names], pa.int64()),
            pa.array([seen[0][p] for p in names], pa.int64())], ["pair", "bad", "good"])

    counted = rows.mapInArrow(pairs, "pair string, bad long, good long").groupBy("pair").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return sorted(r["pair"] for r in counted.filter("good >= 3 AND good > bad").collect())


def _curve(rows: DataFrame, model: Model, ridge: float = 1.0) -> tuple[float, float, float]:
    """A logistic curve over the sum of weights and the sum per word, by Newton steps."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            texts = [folded(doc) for doc in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([sum(f[2] for f in finds(automaton, t)) for t in texts], pa.float64()),
                pa.array([_words(t) for t in texts], pa.int64())], ["toxic", "total", "words"])

    got = sorted(rows.mapInArrow(sums, "toxic int, total double, words long").collect())  # one row each of the sample
    total = np.array([r["total"] for r in got])
    words = np.maximum(np.array([r["words"] for r in got], float), 1)
    y = np.array([r["toxic"] for r in got], float)
    x = np.column_stack([np.ones(len(got)), np.log1p(total), np.log1p(100 * total / words)])
    beta, keep = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", result: str = "toxicity") -> DataFrame:
    """The documents with a struct `result`: score, predicted (1 from 0.5 on) and the stems found, sorted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(result)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, automaton = sent.value, sent.value.automaton()
        for batch in batches:
            rows = []
            for doc in batch.column(batch.schema.names.index(text)):
                plain = folded(doc.as_py())
                found = finds(automaton, plain)
                score = model.score(sum(f[2] for f in found), _words(plain))
                rows.append({"score": score, "predicted": int(score >= 0.5), "stems": sorted({f[1] for f in found})})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], [*batch.schema.names, result])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(result, RESULT)]))


def remove_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model does not call toxic, with their own columns."""
    result = free_name(docs, "_toxicity")
    scored = score_toxicity(docs, model, text, result)
    return scored.filter(F.col(f"`{result}`.predicted") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
