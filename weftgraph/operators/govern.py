"""Access, quotas and audit: driver-side checks for requests, DataFrame forms for whole logs."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F


class AccessDenied(PermissionError):
    pass


class QuotaExceeded(RuntimeError):
    pass


@dataclass(frozen=True)
class Principal:
    principal_id: str
    tenant_ids: frozenset
    roles: frozenset


@dataclass(frozen=True)
class QuotaPolicy:
    max_repos: int
    max_concurrent_jobs: int
    max_graph_nodes: int


class Authorizer:
    """Key, then tenant, then role; the first that fails is the error."""

    def __init__(self, keys: dict[str, Principal]):
        self.keys = keys

    def authorize(self, key: str, tenant: str, role: str) -> Principal:
        who = self.keys.get(key)
        if who is None:
            raise AccessDenied("invalid api key")
        if tenant not in who.tenant_ids:
            raise AccessDenied("tenant access denied")
        if role not in who.roles:
            raise AccessDenied("role denied")
        return who


@dataclass
class Quotas:
    policies: dict[str, QuotaPolicy]
    repos: dict[str, set] = field(default_factory=dict)
    slots: dict[str, int] = field(default_factory=dict)

    def _policy(self, tenant: str) -> QuotaPolicy:
        if tenant not in self.policies:
            raise QuotaExceeded(f"no quota policy for {tenant}")
        return self.policies[tenant]

    def register_repo(self, tenant: str, repo: str) -> None:
        """A repo stays registered even where the check then fails."""
        known = self.repos.setdefault(tenant, set())
        known.add(repo)
        if len(known) > self._policy(tenant).max_repos:
            raise QuotaExceeded("repository quota exceeded")

    def acquire(self, tenant: str) -> None:
        if self.slots.get(tenant, 0) >= self._policy(tenant).max_concurrent_jobs:
            raise QuotaExceeded("concurrent job quota exceeded")
        self.slots[tenant] = self.slots.get(tenant, 0) + 1

    def release(self, tenant: str) -> None:
        self.slots[tenant] = max(0, self.slots.get(tenant, 0) - 1)

    def check_graph(self, tenant: str, n: int) -> None:
        if n > self._policy(tenant).max_graph_nodes:
            raise QuotaExceeded("graph node quota exceeded")


@dataclass
class Audit:
    """Events in the order of their recording."""

    rows: list = field(default_factory=list)

    def record(self, tenant: str, principal: str, action: str, metadata: dict) -> None:
        self.rows.append((tenant, principal, action, metadata, datetime.now(timezone.utc).isoformat()))

    def of_tenant(self, tenant: str) -> list:
        return [r for r in self.rows if r[0] == tenant]


def verdicts(requests: DataFrame, principals: DataFrame) -> DataFrame:
    """requests (api_key, tenant_id, role) with `verdict`: ok or the first failed check, for whole logs.  principals has
    one row a key and is joined by it."""
    joined = requests.join(principals, "api_key", "left")
    verdict = (
        F.when(F.col("principal_id").isNull(), "invalid_key")
        .when(~F.array_contains("tenant_ids", F.col("tenant_id")), "tenant_denied")
        .when(~F.array_contains("roles", F.col("role")), "role_denied").otherwise("ok")
    )
    return joined.select(*requests.columns, verdict.alias("verdict"))


def repo_usage(registrations: DataFrame, policies: DataFrame) -> DataFrame:
    """tenant_id, repos, allowed: distinct repos against each tenant's quota; without a policy nothing is allowed."""
    used = registrations.groupBy("tenant_id").agg(F.countDistinct("repo_id").alias("repos"))
    limits = policies.select("tenant_id", "max_repos")
    return used.join(limits, "tenant_id", "left").select("tenant_id", "repos", (F.col("repos") <= F.coalesce("max_repos", F.lit(-1))).alias("allowed"))
