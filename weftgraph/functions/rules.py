"""The relation rules: a small dimension that gives an edge its provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

# Relation type, rule, pass, priority, confidence.  A super call's rule overrides its type's.
RULES = (
    ("INHERITS", "inherits.class.base", "relation_extraction", 10, 0.99),
    ("INSTANTIATES", "instantiates.class.call", "relation_extraction", 20, 0.97),
    ("super", "calls.super.method", "relation_extraction", 25, 0.94),
    ("CALLS", "calls.function.dispatch", "relation_extraction", 30, 0.90),
    ("USES", "uses.type.reference", "type_inference", 40, 0.88),
    ("MODIFIES", "modifies.global.variable", "relation_extraction", 50, 0.90),
    ("IMPORTS", "imports.module.symbol", "import_resolution", 60, 0.98),
)
UNKNOWN = ("relation.unknown", "relation_extraction", 999, 0.5)


def with_rule(relations: DataFrame, super_call=None) -> DataFrame:
    """relations (relation_type) with rule_id, extractor_pass, priority and confidence.  Seven rows, so a chain of
    conditions in generated code beats a join."""
    key = F.col("relation_type") if super_call is None else F.when(F.coalesce(super_call, F.lit(False)), "super").otherwise(F.col("relation_type"))

    def pick(k: int):
        out = F.when(key == RULES[0][0], RULES[0][k])
        for r in RULES[1:]:
            out = out.when(key == r[0], r[k])
        return out.otherwise(UNKNOWN[k - 1])

    return relations.withColumns({"rule_id": pick(1), "extractor_pass": pick(2), "priority": pick(3), "confidence": pick(4)})


def best_rule(relations: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the least priority, then the first in order."""
    w = W.partitionBy(*keys).orderBy("priority", *order)
    return relations.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def one_per_pair(relations: DataFrame, phase: str = "phase", seq: str = "seq") -> DataFrame:
    """One relation a (source, target): the first, but an INSTANTIATES of a Class replaces CALLS that came before it.

    relations: source_key, target_key, relation_type, target_kind, phase, seq.
    """
    w = W.partitionBy("source_key", "target_key").orderBy(phase, seq)
    first = F.first("relation_type").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    makes = (F.col("relation_type") == "INSTANTIATES") & (F.col("target_kind") == "Class")
    rank = F.when((first == "CALLS") & makes, 0).otherwise(1)
    ranked = relations.withColumn("_rank", rank)
    again = W.partitionBy("source_key", "target_key").orderBy("_rank", phase, seq)
    return ranked.withColumn("_place", F.row_number().over(again)).where("_place = 1").drop("_rank", "_place")
