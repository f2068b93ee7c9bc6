"""Language identification by a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression.

A text is lower-cased; runs of anything but letters are one space. It is cut evenly into pieces of ``PIECE``
characters at most; the kernel of two pieces is the cosine of their sets of n-grams of 1 to ``ORDER``
characters (each n-gram counts once, however often it is there), and that of two texts the mean over
their pieces, so a text of any length is taken whole and weighs as much as a short one.

1. ``chosen``: a sample of the training rows, as many of each language, in the order of their texts' hashes:
   ``MAX_SAMPLE`` in all at most, the first ``MAX_LANDMARKS`` of which (in turn from each language) give one
   piece each as a landmark. That sample is what the model is fitted on; everything else covers all texts.
2. ``fit``: one-versus-rest ridge regression in the span of the landmarks. Tasks compare the sample with
   the landmarks; the driver gets a row of ``MAX_LANDMARKS`` numbers of each sampled text and solves for all languages at once.
3. ``predict``: the presence matrix of a batch of pieces times the landmarks' n-gram weights; the
   kernel is linear in n-grams, so landmarks and coefficients are multiplied beforehand.

The training rows are those whose crc32(doc_id) modulo 4 isn't 2; language, source and id are never inputs of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; repeated training texts of one language count
once; equal texts get equal rows; of equal scores the language of the least name is taken; without any
labelled text every row is ``und`` with score 0; rows without an id are predicted, never learnt from and not held
out; other columns, whatever their names, are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bound_batches, cut

ORDER = 4
PIECE = 2000
MAX_SAMPLE, MAX_LANDMARKS = 6000, 128
RIDGE = 1e-3
HELD_OUT = 2
UNKNOWN = "und"
#: Cells of the presence matrix that is made at once, of 4 bytes each, and its most rows.
CELLS, TOGETHER = 1 << 22, 64
_LETTERS = re.compile(r"[^\W\d_]+")
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def normalized(text: str | None) -> str:
    """Letters in lower case, with one space for anything between; empty without a letter."""
    found = _LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(found)} " if any(c.isalpha() for w in found for c in w) else ""


def pieces(text: str) -> list[str]:
    n = -(-len(text) // PIECE)
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


def grams(piece: str) -> np.ndarray:
    """The different n-grams of 1 to ORDER characters as hashes in order."""
    codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    rolling, out = codes, [codes * _BASE]
    for _ in range(1, min(ORDER, len(codes))):
        rolling = rolling[:-1] * _BASE + codes[len(codes) - len(rolling) + 1 :]
        out.append(rolling * _BASE)
    h = np.concatenate(out)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


@dataclass
class Weights:
    """n-grams (hashes in order) and a column of weights each: the landmarks' own or those of the languages."""

    keys: np.ndarray
    columns: np.ndarray

    def of(self, texts: list[str]) -> np.ndarray:
        """A row for each text: the mean over its pieces of presence times weights over the root of the piece's size; zeros without a letter."""
        out, block, rows = np.zeros((len(texts), self.columns.shape[1])), [], []
        most = min(TOGETHER, max(1, CELLS // max(1, len(self.keys))))

        def flush() -> None:
            present = np.zeros((len(block), len(self.keys)), np.float32)
            for i, g in enumerate(block):
                at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
                present[i, at[self.keys[at] == g]] = 1
            size = np.sqrt(np.array([len(g) for g in block], float))
            got = (present @ self.columns).astype(float) / size[:, None]
            np.add.at(out, np.array([i for i, _ in rows]), got / np.array([n for _, n in rows], float)[:, None])
            block.clear()
            rows.clear()

        for i, text in enumerate(texts):
            parts = pieces(t) if (t := normalized(text)) else []
            for p in parts:
                block.append(grams(p))
                rows.append((i, len(parts)))
                if len(block) >= most:
                    flush()
        if block:
            flush()
        return out


@dataclass
class Model:
    langs: list[str]
    weights: Weights | None
    bias: np.ndarray


def part(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def chosen(docs: DataFrame, sample: int = MAX_SAMPLE) -> tuple[DataFrame, list[str]]:
    """text, lang, h, place (from 1 in its language, by the hash of the text) of the sample, and the languages in order."""
    labelled = docs.filter((part(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    marks = cut(labelled.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id")), "marks")
    counts = {r["lang"]: r["count"] for r in marks.groupBy("lang").count().collect()}
    langs = sorted(counts)
    k = max(1, sample // max(1, len(langs)))
    # The k smallest hashes of a language are, but for chance, below twice the share that k is of it: only those are put in order.
    share = F.lit(1.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, min(1.0, (2.0 * k + 100) / counts[lang])).otherwise(share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    few = cut(marks.filter(F.col("h") <= share * 2.0**64 - 2.0**63).withColumn("place", place).filter(F.col("place") <= k), "sample")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    # An id that is there more than once can have the text twice; the sample is MAX_SAMPLE rows, or one a language.
    found = own.join(F.broadcast(few), ["doc_id", "h"]).dropDuplicates(["lang", "h"]).select("text", "lang", "h", "place")
    return cut(found, "texts"), langs


def landmark_weights(rows: list[tuple[str, int]]) -> Weights:
    """The landmarks' n-grams against landmarks (text, h): presence over the root of the landmark's size, of the piece that the hash points to."""
    sets = []
    for text, h in rows:
        parts = pieces(normalized(text))
        sets.append(grams(parts[h % len(parts)]))
    keys = np.unique(np.concatenate(sets))
    columns = np.zeros((len(keys), len(sets)), np.float32)
    for j, g in enumerate(sets):
        columns[np.searchsorted(keys, g), j] = 1 / np.sqrt(len(g))
    return Weights(keys, columns)


def fit(docs: DataFrame, sample: int = MAX_SAMPLE, landmarks: int = MAX_LANDMARKS) -> Model:
    """The model of the labelled rows of ``docs`` (doc_id, text, lang)."""
    rows, langs = chosen(bound_batches(docs), sample)
    first = rows.filter(F.col("place") <= max(1, landmarks // max(1, len(langs)))).select("text", "h", "place", "lang").collect()
    first = sorted((r for r in first if normalized(r["text"])), key=lambda r: (r["place"], r["lang"]))
    if not first:
        return Model([], None, np.zeros(0))
    own = landmark_weights([(r["text"], r["h"]) for r in first])
    between = np.zeros((len(first), len(first)))
    for j in range(len(first)):  # the kernel of the landmarks: their weights against each other
        between[j] = own.columns[:, j].astype(float) @ own.columns.astype(float)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = own.of(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(list(got), pa.list_(pa.float64()))], names=["lang", "h", "k"])

    table = rows.select("text", "lang", "h").repartition(32, "h").mapInArrow(compared, "lang string, h long, k array<double>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    k = np.array(table["k"].to_pylist(), float).reshape(table.num_rows, len(first))
    at = np.searchsorted(np.array(langs), np.array(table["lang"].to_pylist()))
    # Languages weigh alike, however many texts of each the sample has; the bias is the mean of the targets.
    weight = 1.0 / np.bincount(at, minlength=len(langs))[at] / len(langs)
    y = (at[:, None] == np.arange(len(langs))).astype(float)
    mean_k, mean_y = weight @ k, weight @ y
    kc, yc = k - mean_k, y - mean_y
    inner = (kc * weight[:, None]).T @ kc + RIDGE * between
    alpha = np.linalg.solve(inner + 1e-9 * np.trace(inner) / len(inner) * np.eye(len(inner)), (kc * weight[:, None]).T @ yc)
    return Model(langs, Weights(own.keys, (own.columns.astype(float) @ alpha).astype(np.float32)), mean_y - mean_k @ alpha)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if model.weights is not None and lettered.any():
                got = model.weights.of(texts) + model.bias
                best = got.argmax(axis=1)
                names[lettered] = np.array(model.langs, object)[best[lettered]]
                score[lettered] = np.clip(got.max(axis=1), 0, 1)[lettered]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bound_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang), learnt from its own labelled rows."""
    docs = docs.select("doc_id", "text", "lang")
    held_out = F.coalesce(part(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
