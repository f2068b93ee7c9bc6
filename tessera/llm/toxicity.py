"""Toxic passages by maximum-scoring segments over token log-odds.

1. ``node_counts``: how many different labelled texts of either class hold a word, over all
   labelled training rows, about ``MAX_TRAINING`` of them at most; those of the counting part alone are what is calibrated with. A word's counts also count for its
   prefixes, so an inflected form that was never seen is scored by its stem.
2. ``log_odds``: Dirichlet priors along the chain root, 3 to 8 letters, word: each node's
   toxic share has its parent's share as prior, of ``PRIOR`` observations. Only nodes that
   differ from their parent are kept, and all of these; that is what tasks get, as a sorted
   array of hashes and one of scores, 12 bytes a node.
3. ``segments``: a word scores its log-odds less ``DRIFT``; one pass over a text finds all
   maximal scoring segments (Ruzzo and Tompa).
4. ``calibrate``: extreme-value parameters from the best segments of clean rows of the
   calibration part, and a logistic link from (best and second E-value, number of
   significant segments) to the label, over about ``MAX_SAMPLE`` rows at most.
5. ``score``: every whole text by 3 and 4.

The training rows are dealt by crc32(doc_id): remainder 2 of 4 is held out, 3 calibrates,
0 and 1 count. Labels, language, source and id are never inputs of a score.

Defined cases: a null text is empty; an empty text has no segment and gets the score that
the link gives for none; repeated rows get equal scores; repeated training texts count
once; of several labels of one id the highest holds, null labels are left out; without
labels of both classes every score is the smoothed share of toxic labels; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bound_batches, cut

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 8)
PRIOR = 4.0
DRIFT = 1.0
MAX_SAMPLE = 20_000
#: Labelled training rows that are counted at most, a sample by the hash of their texts beyond: about 8 kept nodes a row, so some 100 MB of nodes in each task.
MAX_TRAINING = 1_000_000
#: Labelled rows that are broadcast, of about 30 bytes each; beyond, both sides are shuffled.
MAX_LABELS = 1_000_000
SIGNIFICANT = 0.05
THRESHOLD = 0.3


PARTS = ("first", "all")
COUNTS = [f"{kind}_{p}" for p in PARTS for kind in ("toxic", "clean")]


@dataclass
class Nodes:
    """Kept nodes: hashes in order, and their log-odds against the root."""

    keys: np.ndarray
    scores: np.ndarray

    @staticmethod
    def of(keys, scores) -> Nodes:
        keys = np.asarray(keys, np.int64)
        order = np.argsort(keys)
        return Nodes(keys[order], np.asarray(scores, np.float32)[order])


def node_key(node: str) -> int:
    """Spark's xxhash64 of a node: a word, or a prefix with ``*`` after it."""
    h = xxhash.xxh64_intdigest(node.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class Model:
    nodes: Nodes
    lam: float = 1.0
    log_k: float = 0.0
    link: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def part(doc_id) -> F.Column:
    """The remainder of crc32 of the id as text by 4; null ids have none."""
    return F.crc32(doc_id.cast("string")) % 4


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), toxic, part of the labelled training rows."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(part(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(known, "labels")
    own = docs.select("doc_id", F.xxhash64("text").alias("h"))
    return cut(own.join(bounded(known), "doc_id").select("doc_id", "h", "toxic", part(F.col("doc_id")).alias("part")).distinct(), "marks")


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` (written already), marked for a broadcast while they are MAX_LABELS at most."""
    return F.broadcast(rows) if rows.limit(MAX_LABELS + 1).count() <= MAX_LABELS else rows


def at_most(marks: DataFrame, most: int) -> DataFrame:
    """``marks``, or about ``most`` of them by the hash of the text: what tasks hold of a model grows with them."""
    n = marks.count()
    return marks if n <= most else cut(marks.filter(F.pmod(F.xxhash64("h", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * most / n)), "some-marks")


def texts_of(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks`` (doc_id, h and others) with the texts."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    return own.join(bounded(marks), ["doc_id", "h"]).drop("h")


def node_counts(rows: DataFrame) -> DataFrame:
    """word and COUNTS: in how many of ``rows`` (text, toxic, counts) of either class the word is; of those that count before the calibration, and of all."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {(c, t): Counter() for c in (False, True) for t in (0, 1)}

        def out():
            found = list(set().union(*of.values()))
            at = {k: np.fromiter((x[w] for w in found), np.int64, len(found)) for k, x in of.items()}
            for x in of.values():
                x.clear()
            if found:
                yield pd.DataFrame({"word": found, "toxic_first": at[True, 1], "clean_first": at[True, 0], "toxic_all": at[True, 1] + at[False, 1], "clean_all": at[True, 0] + at[False, 0]})

        for batch in batches:
            for text, toxic, c in zip(batch["text"], batch["toxic"], batch["counts"], strict=True):
                of[bool(c), int(toxic > 0)].update(set(words(text)))
            if sum(map(len, of.values())) > 200_000:
                yield from out()
        yield from out()

    made = rows.select("text", "toxic", "counts").mapInPandas(counted, "word string, toxic_first long, clean_first long, toxic_all long, clean_all long")
    return made.groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS))


def log_odds(counts: DataFrame, prior: float = PRIOR) -> dict[str, Nodes]:
    """Kept nodes of ``counts`` (word, COUNTS) for each of PARTS; none of a part that lacks a class.

    All prefixes are summed at once. Then each length takes its priors from the one before, and words from their longest prefix; both parts go together.
    """
    whole = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    root = {p: whole[f"toxic_{p}"] / max(1, whole[f"toxic_{p}"] + whole[f"clean_{p}"]) for p in PARTS}
    use = [p for p in PARTS if 0 < root[p] < 1]
    if not use:
        return {p: Nodes.of([], []) for p in PARTS}
    length = F.char_length("word")
    heads = F.array_compact(F.array(*(F.when(length >= n, F.substring("word", 1, n)) for n in PREFIXES)))
    prefixes = cut(counts.select(F.explode(heads).alias("node"), *COUNTS).groupBy("node").agg(*(F.sum(c).alias(c) for c in COUNTS)), "prefixes")

    held = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))  # noqa: E731  long chains of one class come to 0 or 1
    logit = lambda p: F.log(held(p) / (1 - held(p)))

    def shared(rows: DataFrame) -> DataFrame:
        """node, key, and of each part prior_, share_ and score_ (null if it isn't kept); ``rows``: node, key, COUNTS, prior_."""
        n = {p: F.col(f"toxic_{p}") + F.col(f"clean_{p}") for p in use}
        rows = rows.withColumns({f"share_{p}": (F.col(f"toxic_{p}") + prior * F.col(f"prior_{p}")) / (n[p] + prior) for p in use})
        moved = {p: (F.abs(logit(F.col(f"share_{p}")) - logit(F.col(f"prior_{p}"))) > 0.7) & ((n[p] >= 3) | (F.col(f"share_{p}") < F.col(f"prior_{p}"))) for p in use}
        scores = [F.when(moved[p], logit(F.col(f"share_{p}")) - math.log(root[p] / (1 - root[p]))).cast("float").alias(f"score_{p}") for p in use]
        return rows.select("node", F.xxhash64("key").alias("key"), *(f"share_{p}" for p in use), *scores)

    def under(rows: DataFrame, up: DataFrame) -> DataFrame:
        return rows.join(up.select(F.col("node").alias("up"), *(F.col(f"share_{p}").alias(f"prior_{p}") for p in use)), "up")

    from_root = [F.lit(root[p]).alias(f"prior_{p}") for p in use]
    star = F.concat("node", F.lit("*")).alias("key")
    levels = []
    for k, n in enumerate(PREFIXES):
        rows = prefixes.filter(F.char_length("node") == n).select("*", star)
        rows = under(rows.withColumn("up", F.substring("node", 1, PREFIXES[k - 1])), levels[-1]) if k else rows.select("*", *from_root)
        levels.append(cut(shared(rows), "level"))
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    nearest = F.coalesce(*(F.when(length >= n, F.substring("word", 1, n)) for n in reversed(PREFIXES)))
    own = counts.select(F.col("word").alias("node"), F.col("word").alias("key"), nearest.alias("up"), *COUNTS)
    own = under(own.filter("up IS NOT NULL"), every).unionByName(own.filter("up IS NULL").select("*", *from_root))
    scores = [f"score_{p}" for p in use]
    kept = every.unionByName(shared(own)).select("key", *scores).filter(F.coalesce(*scores).isNotNull()).toArrow()
    keys, out = kept["key"].to_numpy(), {p: Nodes.of([], []) for p in PARTS}
    for p in use:
        of = kept[f"score_{p}"].to_numpy()
        out[p] = Nodes.of(keys[~np.isnan(of)], of[~np.isnan(of)])
    return out


def scorer(nodes: Nodes):
    """A function from words to their scores, which remembers words. A word that is no node has the score of its longest prefix that is one."""
    memo: dict[str, float] = {}

    def look_up(new: list[str]) -> None:
        keys = np.zeros((len(new), len(PREFIXES) + 1), np.int64)
        known = np.zeros(keys.shape, bool)
        for i, w in enumerate(new):
            keys[i, 0], known[i, 0] = node_key(w), True
            for k, n in enumerate(reversed(PREFIXES), 1):
                if len(w) >= n:
                    keys[i, k], known[i, k] = node_key(w[:n] + "*"), True
        at = np.minimum(np.searchsorted(nodes.keys, keys), len(nodes.keys) - 1)
        known &= nodes.keys[at] == keys
        first = known.argmax(axis=1)
        score = np.where(known.any(axis=1), nodes.scores[at[np.arange(len(new)), first]], 0.0) - DRIFT
        memo.update(zip(new, score.tolist(), strict=True))

    def of(found: list[str]) -> np.ndarray:
        if not len(nodes.keys):
            return np.full(len(found), -DRIFT)
        if len(memo) > 200_000:
            memo.clear()
        if new := [w for w in set(found) if w not in memo]:
            look_up(new)
        return np.fromiter((memo[w] for w in found), float, len(found))

    return of


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end): Ruzzo and Tompa's scan, which only stops at runs of positive scores."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    positive = np.concatenate(([False], scores > 0, [False]))
    turns = np.flatnonzero(positive[1:] != positive[:-1])
    held: list[list] = []  # start, end, sum before the start, sum at the end
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        now = [a, b, total[a], total[b]]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= now[2]:
                j -= 1
            if j < 0 or held[j][3] >= now[3]:
                held.append(now)
                break
            now = [held[j][0], now[1], held[j][2], now[3]]
            del held[j:]
    return [(r - l, a, b) for a, b, l, r in held]


def features(found: list[tuple[float, int, int]], n: int, model: Model) -> tuple[float, float, float, float]:
    """Intercept, minus the log E-values of the best two segments (0 at least), and the logged number of significant ones."""
    space = model.log_k + math.log(max(n, 1))
    bits = sorted((model.lam * s - space for s, _, _ in found), reverse=True)
    best = [max(0.0, min(x, 30.0)) for x in bits[:2]] + [0.0, 0.0]
    return 1.0, best[0], best[1], math.log1p(sum(x > -math.log(SIGNIFICANT) for x in bits))


def fit_link(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0
        return tuple(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w)


def calibrate(sample: DataFrame, nodes: Nodes) -> Model:
    """Extreme-value parameters and the link from ``sample`` (text, toxic), which is read twice; the driver gets four numbers, and four of each row."""
    model = Model(nodes)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(nodes)
        for batch in batches:
            found = [(segments(of(w)), len(w)) for w in map(words, batch["text"])]
            yield pd.DataFrame({"n": [n for _, n in found], "top": [float(max((s for s, _, _ in f), default=0.0)) for f, _ in found]})

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(nodes)
        for batch in batches:
            x = np.array([features(segments(of(w)), len(w), model) for w in map(words, batch["text"])], float).reshape(-1, 4)
            yield pd.DataFrame({"toxic": (batch["toxic"] > 0).astype(float), "best": x[:, 1], "second": x[:, 2], "count": x[:, 3]})

    best = sample.filter("toxic = 0").mapInPandas(tops, "n long, top double").filter("n > 0")
    n, spread, top, log_n = best.agg(F.count("*"), F.stddev_pop("top"), F.avg("top"), F.avg(F.log("n"))).first()
    if n > 1:
        model.lam = min(5.0, max(0.2, math.pi / math.sqrt(6) / max(spread, 1e-6)))
        model.log_k = model.lam * top - log_n - 0.5772156649
    got = sample.mapInPandas(described, "toxic double, best double, second double, count double").toArrow()
    x = np.column_stack([np.ones(len(got)), *(got[c].to_numpy() for c in ("best", "second", "count"))])
    order = np.lexsort((*x.T, y := got["toxic"].to_numpy()))  # sums in one order, however the tasks end
    model.link = fit_link(x[order], y[order])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE, training: int = MAX_TRAINING) -> Model:
    """The model of the labelled training rows, about ``training`` of them at most, calibrated with about ``most`` of them, chosen by a hash of the id."""
    marks = at_most(labelled(docs, labels), training)
    one = F.max(F.struct((F.col("part") <= 1).alias("counts"), "toxic", "doc_id")).alias("r")
    counts = cut(node_counts(texts_of(docs, cut(marks.groupBy("h").agg(one).select("h", "r.*"), "chosen"))), "words")
    nodes = log_odds(counts)
    third = marks.filter("part = 3").select("doc_id", "h", "toxic")
    total = third.count()
    if total > most:
        third = third.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / total))
    model = calibrate(cut(texts_of(docs, cut(third, "third")).select("text", "toxic"), "sample"), nodes["first"])
    model.nodes = nodes["all"]
    return model


def probability(found: list[tuple[float, int, int]], n: int, model: Model) -> float:
    z = float(np.dot(features(found, n, model), model.link))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score, passages (start and end word, minus the log E-value) of the significant segments."""

    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model.nodes)
        for batch in batches:
            out, passages = [], []
            for text in batch.column(1).to_pylist():
                w = words(text)
                found = segments(of(w))
                out.append(probability(found, len(w), model))
                space = model.log_k + math.log(max(len(w), 1))
                passages.append([{"start": a, "end": b, "evidence": float(model.lam * s - space)} for s, a, b in found if model.lam * s - space > -math.log(SIGNIFICANT)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(passages, passage)], names=["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bound_batches(docs).select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,evidence:double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents scored at ``threshold`` or above, with its own columns."""
    model, at = train(docs, labels), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model.nodes)
        for batch in batches:
            found = [(segments(of(w)), len(w)) for w in map(words, batch.column(at).to_pylist())]
            yield batch.filter(pa.array([probability(f, n, model) < threshold for f, n in found], pa.bool_()))

    return bound_batches(docs).mapInArrow(kept, docs.schema)
