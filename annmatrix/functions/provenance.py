"""The append-only log of changes to a store."""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import Files


def fingerprint(rows: DataFrame | None) -> str:
    """A change detector over all rows and columns: order-free, one small aggregation."""
    if rows is None:
        return "null"
    hashed = rows.select(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).alias("h")) if rows.columns else rows.select(F.lit(0).cast("long").alias("h"))
    n, a, b = hashed.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor("h"), F.lit(0)), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0))).first()
    return f"{(a ^ (b * 0x9E3779B97F4A7C15) ^ n) & 0xFFFFFFFFFFFF:012x}"


class ProvenanceLogger:
    """Entries as files of one JSON line each, named by time, so that an append never rewrites what is there."""

    def __init__(self, files: Files, folder: str = "provenance"):
        self.files, self.folder = files, folder

    def log(self, operation: str, target: str, key: str | None = None, params: dict | None = None, old_hash: str | None = None, new_hash: str | None = None, actor: str = "annmatrix") -> dict[str, Any]:
        now = time.time()
        entry = {"timestamp": now, "timestamp_iso": time.strftime("%Y-%m-%dT%H:%M:%S", time.localtime(now)), "actor": actor, "operation": operation, "target": target, "key": key, "old_hash": old_hash, "new_hash": new_hash, "params": params or {}}
        self.files.make(self.folder)
        self.files.write(f"{self.folder}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.jsonl", json.dumps(entry, default=str) + "\n")
        return entry

    def read_log(self) -> list[dict[str, Any]]:
        names = [n for n in self.files.names(self.folder) if n.endswith(".jsonl")]
        return [json.loads(line) for n in names for line in self.files.read(f"{self.folder}/{n}").splitlines() if line.strip()]

    def query(self, key: str | None = None, operation: str | None = None) -> list[dict[str, Any]]:
        """The entries that agree with every filter given."""
        return [e for e in self.read_log() if (not key or e["key"] == key) and (not operation or e["operation"] == operation)]

    def table(self, spark) -> DataFrame:
        """The log as a table, for SQL."""
        schema = "timestamp double, timestamp_iso string, actor string, operation string, target string, key string, old_hash string, new_hash string, params string"
        rows = [tuple(e[k] if k != "params" else json.dumps(e[k], sort_keys=True) for k in ("timestamp", "timestamp_iso", "actor", "operation", "target", "key", "old_hash", "new_hash", "params")) for e in self.read_log()]
        return spark.createDataFrame(rows, schema)
