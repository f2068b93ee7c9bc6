"""Changes of several tables at once, through a ``Store``: pruning with what hangs on it, replicas, new sources. All of one change, or nothing of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.store import Store
from . import maintenance as M

#: The tables that hang on documents, with their columns that name one.
DEPENDENT = {"comments": ["doc_id"], "links": ["src", "dst"], "topics": ["doc_id"], "labels": ["doc_id"], "embeddings": ["doc_id"], "vectors": ["doc_id"]}


class Refused(ValueError):
    """What was asked for can't be done as the tables are."""


def without(rows: DataFrame, keys: list[str], gone: DataFrame) -> DataFrame:
    """``rows`` that don't name any of ``gone`` (doc_id)."""
    for key in keys:
        rows = rows.join(gone.select(F.col("doc_id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")
    return rows


def delete_documents(store: Store, gone: DataFrame, dependent: dict[str, list[str]] | None = None) -> int:
    """Take ``gone`` (doc_id) out of documents and of every table that hangs on them, vectors too: those tables are written anew without them. Before they are published no row of them may name one of ``gone``."""
    tables = store.manifest()["tables"]
    keys = {"documents": ["doc_id"]} | {k: v for k, v in (dependent or DEPENDENT).items() if k in tables}
    gone = written(gone.select("doc_id").distinct(), "gone")

    def verify(made: dict[str, DataFrame]) -> None:
        for name, rows in made.items():
            for key in keys[name]:
                if not rows.join(gone.select(F.col("doc_id").alias("__gone")), F.col(key) == F.col("__gone"), "left_semi").isEmpty():
                    raise Refused(f"{name}.{key} still names documents that went")

    return store.publish(replace={name: without(store.read(name), own, gone) for name, own in keys.items()}, verify=verify)


def prune(store: Store, cutoff: str, dependent: dict[str, list[str]] | None = None) -> dict[str, int]:
    """Delete the documents before ``cutoff`` that no link ties to a newer one, with what hangs on them; how many rows of each table went."""
    old = store.manifest()["version"]
    buckets = M.prune_buckets(store.read("documents"), store.read("links"), cutoff)
    gone = written(buckets.filter("bucket = 'delete'").select("doc_id"), "gone")
    if gone.isEmpty():
        return {}
    new = delete_documents(store, gone, dependent)
    names = [n for n in store.manifest(new)["tables"] if store.segments(n, new) != store.segments(n, old)]
    return {n: store.read(n, old).count() - store.read(n, new).count() for n in names}


def canonical_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with JSON texts of ``columns`` in one form; empty ones, empty objects, arrays and texts, zero, false and null are null. A text that isn't JSON is an error."""
    for c in columns:
        text = F.to_json(F.parse_json(F.col(c)))
        rows = rows.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", None).when(text.isin("{}", "[]", '""', "0", "false", "null"), None).otherwise(text))
    return rows


def replicate(tables: dict[str, DataFrame], store: Store, json: dict[str, list[str]] | None = None, parents: dict[str, tuple[str, str, str]] | None = None) -> int:
    """Whole copies of ``tables``, parents before what refers to them, as one version of ``store``; a table that fails leaves the replica as it was.

    ``json``: columns of JSON texts by table. ``parents``: by table its column, the table that it refers to and that one's column; rows without a parent are an error.
    """

    def verify(made: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            if made[name].count() != rows.count():
                raise Refused(f"{name} was not copied whole")
        for name, (key, parent, parent_key) in (parents or {}).items():
            if not M.orphans(made[name].filter(F.col(key).isNotNull()), key, made[parent], parent_key).isEmpty():
                raise Refused(f"{name}.{key} has rows without a {parent}")

    return store.publish(replace={name: canonical_json(rows, (json or {}).get(name, [])) for name, rows in tables.items()}, verify=verify)


def add_source(store: Store, source_id: str, display_name: str, channel: str, import_documents: Callable[[], DataFrame]) -> dict:
    """Register a source, import its documents (doc_id, source_id and the others of the store's), fill in its channel and its mark, as one version.

    Refused: an id other than of lower-case letters, digits and underscores, an id or channel that another source has, an import without documents,
    or with ids that are there. Whatever the import raises is raised; then nothing of the source is there.
    """
    import re

    if not re.fullmatch("[a-z0-9_]+", source_id):
        raise Refused(f"{source_id!r} is no id of a source")
    spark = store.spark
    row = spark.createDataFrame([(source_id, display_name, channel)], "source_id string, display_name string, channel string")
    if store.has("sources"):
        same = store.read("sources").filter((F.col("source_id") == source_id) | (F.col("channel") == channel)).first()
        if same:
            raise Refused(f"source {source_id} exists" if same["source_id"] == source_id else f"channel {channel} is another source's")
    base = store.manifest()["version"]
    docs = import_documents().withColumn("source_id", F.lit(source_id))
    docs = written(docs.withColumn("channel", F.coalesce("channel", F.lit(channel)) if "channel" in docs.columns else F.lit(channel)), "import")
    n, last = docs.agg(F.count("*"), F.max("doc_id")).first()
    if not n:
        raise Refused(f"source {source_id} has no documents")
    if store.has("documents") and not docs.join(store.read("documents").select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise Refused("the import has ids that are there")
    marks = spark.createDataFrame([(source_id, last, n, 0)], "source_id string, mark long, documents long, comments long")
    if store.has("documents"):
        docs = docs.select(store.read("documents").columns)
    version = store.publish(append={"documents": docs, "marks": marks, "sources": row}, base=base)
    return {"version": version, "documents": n, "mark": last}
