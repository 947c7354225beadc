"""The containment graph of a repository: repository, folders, files, symbols, and upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, text
from ..sources.files import modules

SYMBOLS = ("Class", "Method", "Interface", "Enum", "Variable")


def documents(files: DataFrame, symbols: DataFrame, repo: str) -> DataFrame:
    """collection, key, name, module_type, content_hash of every row; symbols: file_path, kind, parent_name, name, content."""
    none = F.lit(None).cast("string")
    row = lambda df, kind, path, name, kind2=none, digest=none: df.select(
        kind.alias("collection"), ids.path_key(path).alias("key"), name.alias("name"), kind2.alias("module_type"), digest.alias("content_hash"))
    one = files.sparkSession.range(1)
    symbol = ids.entity_key("kind", "file_path", "parent_name", "name")
    return (
        row(one, F.lit("Repository"), F.lit(repo), F.lit(repo))
        .unionByName(row(modules(files), F.lit("Module"), F.col("path"), F.col("path"), text.module_type("path")))
        .unionByName(row(files, F.lit("File"), F.col("file_path"), F.col("file_path"), none, ids.content_hash("content")))
        .unionByName(row(symbols.where(F.col("kind").isin(*SYMBOLS)), F.col("kind"), symbol, F.col("name"), none, ids.content_hash("content")))
    )


def contains(files: DataFrame, symbols: DataFrame, repo: str) -> DataFrame:
    """source_key, target_key: repository to top folders and files, folders to folders and files, files or parent symbols
    to symbols.  A symbol whose parent is unknown hangs on its file."""
    root = ids.path_key(F.lit(repo))
    folder = F.when(F.contains("file_path", F.lit("/")), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise("")
    up = lambda parent: F.when(parent == "", root).otherwise(ids.path_key(parent))
    tree = modules(files).select(up(F.col("parent")).alias("source_key"), ids.path_key("path").alias("target_key"))
    held = files.select(up(folder).alias("source_key"), ids.path_key("file_path").alias("target_key"))
    own = symbols.where(F.col("kind").isin(*SYMBOLS)).withColumn("qualified", F.concat_ws("/", F.nullif("parent_name", F.lit("")), "name"))
    own = own.withColumn("key", ids.path_key(ids.entity_key("kind", "file_path", "parent_name", "name")))
    parents = own.where("kind in ('Class', 'Method')").groupBy("file_path", F.col("qualified").alias("parent_name")).agg(F.min("key").alias("p"))
    symbol = own.join(parents, ["file_path", "parent_name"], "left").select(F.coalesce("p", ids.path_key("file_path")).alias("source_key"), F.col("key").alias("target_key"))
    return tree.unionByName(held).unionByName(symbol).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows of both by key, the highest order winning; an aggregation with map-side partials."""
    rows = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order)).select(*keys, "r.*", order)


def semantic(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations whose two ends are stored; one a (type, from, to)."""
    known = documents.select("key").distinct()
    ok = relations.join(known.withColumnRenamed("key", "source_key"), "source_key", "left_semi")
    return ok.join(known.withColumnRenamed("key", "target_key"), "target_key", "left_semi").dropDuplicates(["relation_type", "source_key", "target_key"])
