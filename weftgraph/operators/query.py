"""The query API over one snapshot's frames: filtered pages in canonical order, totals, single relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .traverse import query_context, where_all

# Default page size and hops.
PAGE, HOPS = 50, 1
EDGE_ORDER = ("source_id", "relation_type", "target_id", "id")


def page(df: DataFrame, order: tuple[str, ...], cursor: int = 0, limit: int = PAGE) -> DataFrame:
    """Rows [cursor, cursor + limit) in order.  limit + offset is a distributed top-k up to the page's end."""
    if cursor < 0 or limit < 0:
        raise ValueError("cursor and limit must not be negative")
    return df.orderBy(*order).offset(cursor).limit(limit)


def after(df: DataFrame, key: str, last: str | None, limit: int = PAGE) -> DataFrame:
    """Keyset form of page() for deep pages: rows behind the last key seen, so that the filter reaches the scan."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(limit)


def envelope(df: DataFrame, cursor: int = 0, limit: int = PAGE) -> DataFrame:
    """total, next_cursor of a filtered result."""
    end = F.lit(cursor + limit).cast("long")
    return df.agg(F.count("*").alias("total")).select("total", F.when(end < F.col("total"), end).alias("next_cursor"))


def find_entities(nodes: DataFrame, entity_kind=None, file_path=None, cursor: int = 0, limit: int = PAGE) -> DataFrame:
    return page(where_all(nodes, entity_kind=entity_kind, file_path=file_path), ("id",), cursor, limit)


def find_relations(edges: DataFrame, relation_type=None, source_id=None, target_id=None, cursor: int = 0, limit: int = PAGE) -> DataFrame:
    return page(where_all(edges, relation_type=relation_type, source_id=source_id, target_id=target_id), EDGE_ORDER, cursor, limit)


def explain_relation(edges: DataFrame, edge_id: str) -> DataFrame:
    return edges.where(F.col("id") == edge_id).limit(1)


def subgraph(nodes: DataFrame, edges: DataFrame, cursor: int = 0, limit: int = PAGE, **filters) -> dict:
    """nodes (paged), edges (all), total, next_cursor of the context of the matching nodes."""
    found, touched = query_context(nodes, edges, **filters)
    head = envelope(found, cursor, limit).first()
    return {
        "nodes": page(found, ("id",), cursor, limit), "edges": touched.orderBy(*EDGE_ORDER),
        "total": head.total, "next_cursor": head.next_cursor,
    }
