"""Stored snapshots and logs as Parquet, partitioned by tenant, repo and commit so that a snapshot is a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids
from ..functions.rules import UNKNOWN

KEY = ["tenant_id", "repo_id", "commit_sha"]
NODE_META = "struct<description:string,size:bigint,file_type:string,complexity:int,is_exported:boolean,modifiers:array<string>>"
EDGE_META = (
    "struct<import_symbol:string,is_method:boolean,resolution_path:array<string>,is_chain_call:boolean,"
    "chain_object_type:string,is_super_call:boolean,parent_class:string,is_param_type:boolean>"
)
PROVENANCE = "struct<extractor_pass:string,rule_id:string,source_span:array<int>,confidence:double>"
SCHEMAS = {
    "nodes": f"id string, tenant_id string, repo_id string, commit_sha string, entity_kind string, symbol_path string, file_path string, name string, parent_name string, metadata {NODE_META}",
    "edges": f"id string, tenant_id string, repo_id string, commit_sha string, source_id string, target_id string, relation_type string, provenance {PROVENANCE}, metadata {EDGE_META}",
    "job_status": "job_id string, tenant_id string, repo_id string, commit_sha string, status string, attempts int, error string, created_at string, updated_at string",
    "deliveries": "tenant_id string, delivery_id string",
    "audit_log": "tenant_id string, principal_id string, action string, metadata string, created_at string",
}
UNIQUE = {"nodes": [*KEY, "id"], "edges": [*KEY, "id"], "job_status": ["tenant_id", "job_id"], "deliveries": ["tenant_id", "delivery_id"]}


class SnapshotStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def _exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def bootstrap(self, reset: bool = False) -> list[str]:
        """Create the tables that are missing, and say which; with reset, all of them, empty."""
        made = [t for t in SCHEMAS if reset or not self._exists(t)]
        for t in made:
            writer = self.spark.createDataFrame([], SCHEMAS[t]).write.mode("overwrite")
            (writer.partitionBy(*KEY) if t in ("nodes", "edges") else writer).parquet(self._path(t))
        return made

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table))

    def save_snapshot(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Replace whole snapshots; others stay.  Rows are sorted by id in their files, for their statistics."""
        for name, df in (("nodes", nodes), ("edges", edges)):
            (
                df.repartition(*KEY, F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("id").write
                .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(self._path(name))
            )

    def snapshot(self, tenant: str, repo: str, commit: str) -> tuple[DataFrame, DataFrame]:
        """Frames of one snapshot, empty if there is none; missing provenance gets its defaults."""
        own = (F.col("tenant_id") == tenant) & (F.col("repo_id") == repo) & (F.col("commit_sha") == commit)
        p = F.col("provenance")
        filled = F.struct(
            F.coalesce(p["extractor_pass"], F.lit(UNKNOWN[1])).alias("extractor_pass"), F.coalesce(p["rule_id"], F.lit(UNKNOWN[0])).alias("rule_id"),
            F.coalesce(p["source_span"], F.array(F.lit(0), F.lit(0))).alias("source_span"), F.coalesce(p["confidence"], F.lit(UNKNOWN[3])).alias("confidence"),
        )
        return self.read("nodes").where(own), self.read("edges").where(own).withColumn("provenance", filled)

    def merge(self, nodes: DataFrame, order: str = "seq") -> DataFrame:
        """Upsert form: stored rows and new ones by key, the new ones winning; nothing is deleted."""
        old = self.read("nodes").withColumn(order, F.lit(-1))
        rows = old.unionByName(nodes, allowMissingColumns=True).withColumn("_key", ids.document_key("id"))
        rest = [c for c in rows.columns if c not in ("_key", order)]
        return rows.groupBy("_key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("r.*")

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path(table))

    def job(self, tenant: str, job_id: str) -> DataFrame:
        """Latest status row of a job, with the time of its first."""
        rows = self.read("job_status").where((F.col("tenant_id") == tenant) & (F.col("job_id") == job_id))
        last = F.max_by(F.struct("repo_id", "commit_sha", "status", "attempts", "error"), F.struct("updated_at", "attempts"))
        return rows.groupBy("tenant_id", "job_id").agg(last.alias("r"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")).select(
            "tenant_id", "job_id", "r.*", "created_at", "updated_at"
        )

    def audit(self, tenant: str) -> DataFrame:
        return self.read("audit_log").where(F.col("tenant_id") == tenant).orderBy("created_at")

    def broken_keys(self) -> DataFrame:
        """table, rows: keys that occur more than once."""
        out = None
        for t, key in UNIQUE.items():
            n = self.read(t).groupBy(*key).count().where("count > 1").agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
            out = n if out is None else out.unionByName(n)
        return out.where("rows > 0")
