"""Immutable generations of tables and the pointer to the active one.

A generation is a folder of Parquet tables. It becomes visible when the pointer, one small row in a Parquet folder of its
own that is written last, names it; readers pin the generation that they began with. All through Spark's writers, so any
store will do.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.operators import snapshots

STATES = ("building", "ready", "failed", "retired")
#: Seconds after which a reader that gave no word counts as gone.
LEASE = 3600


class Store:
    def __init__(self, spark: SparkSession, root: str, clock=time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("seq long, generation string, state string, digest string, tables string").json(f"{self.root}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _write(self, seq: int, generation: str, state: str, digest: str, tables: list[str]) -> None:
        row = self.spark.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(generation).alias("generation"), F.lit(state).alias("state"), F.lit(digest).alias("digest"), F.lit(json.dumps(tables)).alias("tables"))
        row.coalesce(1).write.mode("append").json(f"{self.root}/log")

    def active(self) -> dict | None:
        """The generation that was made ready last. Two writers may have taken one number; then the later name counts, for every
        reader alike."""
        log = self._log()
        row = None if log is None else log.where("state = 'ready'").agg(F.max(F.struct("seq", "generation", "state", "digest", "tables")).alias("r")).first()["r"]
        return None if row is None else row.asDict() | {"tables": json.loads(row["tables"])}

    def collectable(self, pinned: set[str] = frozenset()) -> list[str]:
        """Generations that are neither active nor pinned, by the caller or by a lease of any process: their folders may be
        deleted. A few rows of the log a generation."""
        now, log = self.active(), self._log()
        names = set() if log is None else {r["generation"] for r in log.select("generation").distinct().collect()}
        return sorted(names - set(pinned) - self.leased() - ({now["generation"]} if now else set()))

    def _lease(self, lease: str, generation: str, until: float) -> None:
        row = self.spark.range(1).select(F.lit(lease).alias("lease"), F.lit(generation).alias("generation"), F.lit(float(until)).alias("until"), F.lit(self.clock()).alias("at"))
        row.coalesce(1).write.mode("append").json(f"{self.root}/leases")

    def leased(self) -> set[str]:
        """Generations that some reader of any process holds just now: the last word of a lease counts."""
        try:
            rows = self.spark.read.schema("lease string, generation string, until double, at double").json(f"{self.root}/leases")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return set()
            raise
        # a release has no end, so it is the last word even if clocks disagree
        last = rows.groupBy("lease", "generation").agg(F.max("until").alias("until"), F.min("until").alias("least"))
        return {r["generation"] for r in last.where((F.col("least") > 0) & (F.col("until") > self.clock())).select("generation").distinct().collect()}

    def _retired(self) -> set[str]:
        log = self._log()
        return set() if log is None else {r["generation"] for r in log.where("state = 'retired'").select("generation").distinct().collect()}

    @contextmanager
    def reading(self, seconds: float = LEASE, attempts: int = 3):
        """The active generation and its tables under a lease that every process sees: no collection takes them before the
        lease is given back or ends.

        A reader writes its lease and then looks whether the generation was retired meanwhile; a collection retires it and
        then looks for leases. So one of the two sees the other, whoever comes first.
        """
        for _ in range(attempts):
            now = self.active()
            if now is None:
                raise LookupError("nothing is published")
            lease, name = uuid.uuid4().hex, now["generation"]
            self._lease(lease, name, self.clock() + seconds)
            if name in self._retired():
                self._lease(lease, name, 0)
                continue
            try:
                yield name, self.pin(name)
            finally:
                self._lease(lease, name, 0)
            return
        raise LookupError("nothing could be pinned")

    def collect(self, pinned: set[str] = frozenset()) -> list[str]:
        """Delete the generations that nothing holds; those that a reader leased just now are left for the next time, and
        take no further readers. The generations that went."""
        wanted = self.collectable(pinned)
        retired, gone = self._retired(), []
        for name in wanted:
            if name not in retired:
                self._write(0, name, "retired", "", [])
        held = self.leased()
        now = self.active()
        for name in wanted:
            if name in held or (now and now["generation"] == name):
                continue
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/generation={name}")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True):
                gone.append(name)
        return gone

    def unchanged(self, generation: str) -> bool:
        """Whether a generation that a query pinned is still the active one; if not, its findings are to be discarded."""
        now = self.active()
        return now is not None and now["generation"] == generation

    def pinned(self, attempts: int = 3) -> tuple[str, dict[str, DataFrame]]:
        """The active generation and its tables; tried again if it was collected while it was being opened."""
        for k in range(attempts):
            now = self.active()
            if now is None:
                raise LookupError("nothing is published")
            try:
                return now["generation"], self.pin(now["generation"])
            except AnalysisException:
                if k == attempts - 1:
                    raise
        raise LookupError("nothing could be pinned")

    def pin(self, generation: str | None = None) -> dict[str, DataFrame]:
        """The tables of the active generation, or of the one named; later publications don't touch them."""
        now = self.active()
        if now is None:
            raise LookupError("nothing is published")
        name = generation or now["generation"]
        return {t: self.spark.read.parquet(f"{self.root}/generation={name}/{t}") for t in now["tables"]}

    def publish(self, tables: dict[str, DataFrame], digest: str, audits=None) -> tuple[str, bool]:
        """Write a generation and make it active; (generation, False) without a write if the digest is the active one's.
        A failed audit or write leaves the active generation as it is."""
        now = self.active()
        if now and now["digest"] == digest:
            return now["generation"], False
        seq, name = (now["seq"] if now else 0) + 1, uuid.uuid4().hex
        self._write(seq, name, "building", digest, list(tables))
        try:
            for t, df in tables.items():
                df.write.parquet(f"{self.root}/generation={name}/{t}")
            written = {t: self.spark.read.parquet(f"{self.root}/generation={name}/{t}") for t in tables}
            if audits and not (bad := snapshots.audit(audits(written)).where("violations > 0")).isEmpty():
                raise ValueError(f"audit failed: {[r['check'] for r in bad.collect()]}")
        except Exception:
            self._write(seq, name, "failed", digest, list(tables))
            raise
        self._write(seq, name, "ready", digest, list(tables))
        return name, True
