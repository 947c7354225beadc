"""Ingestion: webhooks, job queue, worker, retries; as streams over files and as a service for single requests."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from collections import deque
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import extract, query as Q
from ..operators.govern import Audit, Authorizer, Quotas

# Statuses, most retries and the longest wait in seconds.
QUEUED, RUNNING, COMPLETED, RETRYING, FAILED, SKIPPED = "QUEUED", "RUNNING", "COMPLETED", "RETRYING", "FAILED", "SKIPPED"
MAX_RETRIES, LONGEST_WAIT = 3, 8
WEBHOOK_EVENT = "tenant_id string, installation_id string, repo_full_name string, event_type string, delivery_id string, commit_sha string, payload string, error string"


def backoff(attempts: int) -> int:
    return min(2**attempts, LONGEST_WAIT)


# --- webhooks ---------------------------------------------------------------------------------------------------


def read_webhook(headers: dict, body: bytes, secret: str, tenant_of) -> dict:
    """A checked event, or its error.  Signature, then headers, then body."""
    low = {k.lower(): v for k, v in headers.items()}
    out = dict.fromkeys((c.split()[0] for c in WEBHOOK_EVENT.split(", ")))
    wanted = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    if not hmac.compare_digest(wanted, low.get("x-hub-signature-256", "")):
        return out | {"error": "invalid signature"}
    kind, delivery = low.get("x-github-event", ""), low.get("x-github-delivery", "")
    if not kind or not delivery:
        return out | {"error": "missing event headers"}
    try:
        payload = json.loads(body)
    except ValueError:
        return out | {"error": "invalid body"}
    installation = str((payload.get("installation") or {}).get("id") or "")
    repo = (payload.get("repository") or {}).get("full_name") or ""
    if not installation or not repo:
        return out | {"error": "missing installation or repository"}
    commit = payload.get("after") or (payload.get("head_commit") or {}).get("id") or ""
    return out | {
        "tenant_id": tenant_of(installation), "installation_id": installation, "repo_full_name": repo, "event_type": kind,
        "delivery_id": delivery, "commit_sha": commit, "payload": json.dumps(payload, sort_keys=True),
    }


def webhooks(raw: DataFrame, secret: str, tenant_of) -> DataFrame:
    """raw: headers map, body binary; batch or stream.  Rows with an error are for the dead-letter table."""

    def run(frames):
        for frame in frames:
            rows = [read_webhook(dict(h), bytes(b), secret, tenant_of) for h, b in zip(frame["headers"], frame["body"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in WEBHOOK_EVENT.split(", ")])

    return raw.mapInPandas(run, WEBHOOK_EVENT)


# --- streams ----------------------------------------------------------------------------------------------------


def new_deliveries(events: DataFrame, time_column: str, delay: str = "1 day") -> DataFrame:
    """First event of each (tenant, delivery) within the delay: the state is bounded, unlike a set of all deliveries."""
    return events.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["tenant_id", "delivery_id"])


def drain(stream: DataFrame, each, checkpoint: str):
    """Run each(batch, number) on all there is and stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def status_log(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Jobs of a batch with their first status: SKIPPED where (tenant, job) is completed already, else RUNNING."""
    done = seen.where(F.col("status") == COMPLETED).select("tenant_id", "job_id").distinct().withColumn("_done", F.lit(True))
    unique = jobs.dropDuplicates(["tenant_id", "job_id"])
    return unique.join(done, ["tenant_id", "job_id"], "left").withColumn("status", F.when(F.col("_done"), SKIPPED).otherwise(RUNNING)).drop("_done")


def after_attempt(log: DataFrame, failed) -> DataFrame:
    """Next status and wait of running jobs, by whether the attempt failed."""
    tries = F.col("attempts") + 1
    status = F.when(~failed, COMPLETED).when(tries < F.coalesce("max_retries", F.lit(MAX_RETRIES)), RETRYING).otherwise(FAILED)
    wait = F.when(status == RETRYING, F.least(F.pow(F.lit(2), tries), F.lit(LONGEST_WAIT))).cast("int")
    return log.withColumns({"attempts": tries, "status": status, "wait_seconds": wait})


# --- the service ------------------------------------------------------------------------------------------------


@dataclass
class Job:
    job_id: str
    tenant_id: str
    repo_id: str
    commit_sha: str
    files: dict
    delivery_id: str = ""
    attempts: int = 0
    max_retries: int = MAX_RETRIES


@dataclass
class Engine:
    """One tenant-aware service over a snapshot store: admit, index, query, audit."""

    spark: SparkSession
    store: object
    authorizer: Authorizer
    quotas: Quotas
    audit: Audit = field(default_factory=Audit)
    queue: deque = field(default_factory=deque)
    deliveries: set = field(default_factory=set)
    status: dict = field(default_factory=dict)
    completed: set = field(default_factory=set)
    sleep: object = time.sleep
    build: object = None

    def index_repository(self, key: str, tenant: str, repo: str, commit: str, files: dict, delivery: str = "") -> dict:
        """Access, repo quota, slot, then duplicates: in this order, so a duplicate has registered its repo."""
        who = self.authorizer.authorize(key, tenant, "indexer")
        self.quotas.register_repo(tenant, repo)
        self.quotas.acquire(tenant)
        if delivery and (tenant, delivery) in self.deliveries:
            self.quotas.release(tenant)
            return {"status": "duplicate", "delivery_id": delivery}
        self.deliveries.add((tenant, delivery))
        job = Job(hashlib.sha256(f"{tenant}|{repo}|{commit}|{delivery}".encode()).hexdigest()[:24], tenant, repo, commit, files, delivery)
        self.queue.append(job)
        self.audit.record(tenant, who.principal_id, "index_repository", {"repo_id": repo, "commit_sha": commit, "job_id": job.job_id})
        return {"status": "queued", "job_id": job.job_id}

    index_commit = index_repository

    def _note(self, job: Job, status: str, error: str = "", attempts: int | None = None) -> dict:
        now = datetime.now(timezone.utc).isoformat()
        before = self.status.get((job.tenant_id, job.job_id), {})
        row = {"job_id": job.job_id, "tenant_id": job.tenant_id, "repo_id": job.repo_id, "commit_sha": job.commit_sha, "status": status,
               "attempts": job.attempts if attempts is None else attempts, "error": error, "created_at": before.get("created_at", now), "updated_at": now}
        self.status[job.tenant_id, job.job_id] = row
        return row

    def process_once(self) -> dict | None:
        """The next job: completed, retried after a wait, failed, or skipped; None on an empty queue."""
        if not self.queue:
            return None
        job = self.queue.popleft()
        if (job.tenant_id, job.job_id) in self.completed:
            return self._note(job, SKIPPED)  # its slot stays taken
        self._note(job, RUNNING)
        try:
            files = self.spark.createDataFrame(list(job.files.items()), "file_path string, content string")
            nodes, edges = (self.build or extract.snapshot)(files, job.tenant_id, job.repo_id, job.commit_sha)
            self.quotas.check_graph(job.tenant_id, nodes.count())
            self.store.save_snapshot(nodes, edges)
        except Exception as e:  # any failure of a job is its result
            job.attempts += 1
            if job.attempts < job.max_retries:
                noted = self._note(job, RETRYING, str(e))
                self.sleep(backoff(job.attempts))
                self.queue.append(job)
                return noted
            self.quotas.release(job.tenant_id)
            return self._note(job, FAILED, str(e))
        self.completed.add((job.tenant_id, job.job_id))
        done = self._note(job, COMPLETED, attempts=job.attempts + 1)
        self.quotas.release(job.tenant_id)
        return done

    def get_graph(self, key: str, tenant: str, repo: str, commit: str) -> tuple[DataFrame, DataFrame]:
        who = self.authorizer.authorize(key, tenant, "viewer")
        nodes, edges = self.store.snapshot(tenant, repo, commit)
        self.quotas.check_graph(tenant, nodes.count())
        self.audit.record(tenant, who.principal_id, "get_graph", {"repo_id": repo, "commit_sha": commit})
        return nodes.orderBy("id"), edges.orderBy(*Q.EDGE_ORDER)

    def query_context(self, key: str, tenant: str, repo: str, commit: str, cursor: int = 0, limit: int = Q.PAGE, **filters) -> dict:
        who = self.authorizer.authorize(key, tenant, "viewer")
        nodes, edges = self.store.snapshot(tenant, repo, commit)
        result = Q.subgraph(nodes, edges, cursor, limit, **filters)
        self.audit.record(tenant, who.principal_id, "query_context", {"repo_id": repo, "commit_sha": commit, **filters})
        return result

    def get_job(self, key: str, tenant: str, job_id: str) -> dict:
        who = self.authorizer.authorize(key, tenant, "viewer")
        row = self.status.get((tenant, job_id))
        if row is None:
            return {"status": "not_found", "job_id": job_id}
        self.audit.record(tenant, who.principal_id, "get_job", {"job_id": job_id})
        return row

    def handle(self, method: str, path: str, headers: dict, body: dict | None = None) -> tuple[int, object]:
        """REST routes as (status code, result); every error is a 400, a missing key too."""
        try:
            key = headers["X-API-Key"]
            parts, body = path.split("?")[0].strip("/").split("/"), body or {}
            args = dict(x.split("=") for x in path.partition("?")[2].split("&") if x)
            if method == "POST" and parts in (["v2", "index", "repository"], ["v2", "index", "commit"]):
                return 200, self.index_repository(key, body["tenant_id"], body["repo_id"], body["commit_sha"], body["files"], body.get("delivery_id", ""))
            if method == "GET" and parts[:2] == ["v2", "graph"]:
                return 200, self.get_graph(key, parts[2], "/".join(parts[3:-1]), parts[-1])
            if method == "POST" and parts == ["v2", "query", "context"]:
                own = {k: body.pop(k) for k in ("tenant_id", "repo_id", "commit_sha")}
                return 200, self.query_context(key, own["tenant_id"], own["repo_id"], own["commit_sha"], **body)
            if method == "GET" and parts[:2] == ["v2", "jobs"]:
                return 200, self.get_job(key, args["tenant_id"], parts[2])
            raise ValueError(f"no such route: {method} {path}")
        except Exception as e:
            return 400, {"detail": str(e)}
