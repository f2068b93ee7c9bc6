"""Segments of videos: doc_id, video_id, topic, seconds, summary, text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .funnel import map_scores
from .numbering import numbered

#: Seconds that are put in order together.
STRETCH = 3600


def summary_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """The default model, which is deterministic: relevance by the length of the summary."""
    n = batch["summary"].fillna("").str.len()
    return pd.DataFrame({"doc_id": batch["doc_id"], "relevance": pd.Series("LOW", index=batch.index).mask(n >= 120, "MEDIUM").mask(n >= 400, "HIGH"), "reason": "summary"})


def mapped(segments: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame] = summary_scorer) -> DataFrame:
    """``segments`` with ``relevance``; what the model says nothing of is LOW."""
    scores = written(map_scores(segments.select("doc_id", "topic", "summary"), scorer).select("doc_id", "relevance"), "scores")  # a model is asked once
    return segments.join(scores, "doc_id", "left").withColumn("relevance", F.coalesce("relevance", F.lit("LOW")))


def resolved(segments: DataFrame) -> DataFrame:
    """video_id, place, doc_id, relevance, content: HIGH ones with their text, MEDIUM ones and those of a topic of a HIGH one of the video with their summary (as MEDIUM), in order of time."""
    high = F.col("relevance") == "HIGH"
    topics = segments.filter(high).select("video_id", "topic", F.lit(True).alias("won")).distinct()
    rows = segments.join(topics, ["video_id", "topic"], "left").filter(high | (F.col("relevance") == "MEDIUM") | F.col("won"))
    # Places are found without the texts, a stretch of a video at a time.
    placed = numbered(rows.select("video_id", "doc_id", "seconds"), "video_id", [F.col("seconds"), F.col("doc_id")], F.floor(F.col("seconds") / STRETCH), "place").select("doc_id", F.col("place").cast("int").alias("place"))
    rows = rows.join(placed, "doc_id")
    return rows.select("video_id", "place", "doc_id", F.when(high, "HIGH").otherwise("MEDIUM").alias("relevance"), F.when(high, F.col("text")).otherwise(F.col("summary")).alias("content"))
