"""Named corpora: an append-only event log folded to the live registry, and the caller's session.

Parquet has no row delete, so creating and deleting append events; the registry is the latest
event of each resource. The log is as small as the number of corpora ever made.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions import scalars
from heronry.schemas import CORPORA, EVENTS


@dataclass
class Session:
    """What a caller has seen: the current corpus, and names known to exist with their resource."""

    current: str | None = None
    known: dict[str, str] = field(default_factory=dict)

    def forget(self, resource: str) -> None:
        self.known = {k: v for k, v in self.known.items() if v != resource}
        if self.current == resource:
            self.current = None


def fold(events: DataFrame) -> DataFrame:
    """The live registry: of each resource the last event, unless it is a deletion."""
    last = F.max_by(F.struct("display_name", "event", "at"), F.struct("at", "seq"))
    made = F.min(F.when(F.col("event") == "create", F.col("at")))
    rows = events.groupBy("resource_name").agg(last.alias("l"), made.alias("create_time"))
    live = rows.where(F.col("l.event") != "delete")
    return live.select("resource_name", "l.display_name", "create_time", F.col("l.at").alias("update_time"))


def listing(registry: DataFrame) -> DataFrame:
    return registry.select("resource_name", "display_name", scalars.time_text(F.col("create_time")).alias("create_time"), scalars.time_text(F.col("update_time")).alias("update_time"))


def resolve(names: DataFrame, registry: DataFrame, prefix: str) -> DataFrame:
    """(name, resource_name) of names: a full resource name as it is; else the first corpus with
    that display name, raw before sanitised; else a path made of the sanitised last segment.

    The first of several corpora is the oldest, then the least resource name.
    """
    rank = F.row_number().over(Window.partitionBy("display_name").orderBy(F.col("create_time").asc_nulls_last(), "resource_name"))
    first = registry.withColumn("rk", rank).where("rk = 1").select("display_name", F.col("resource_name").alias("found"))
    raw, clean = first.select(F.col("display_name").alias("raw_name"), F.col("found").alias("raw_found")), first.select(F.col("display_name").alias("clean_name"), F.col("found").alias("clean_found"))
    joined = names.join(raw, F.col("name") == F.col("raw_name"), "left").join(clean, scalars.sanitize(F.col("name")) == F.col("clean_name"), "left")
    made = scalars.resource_name(prefix, scalars.sanitize(scalars.last_segment(F.col("name"))))
    out = F.when(scalars.is_resource_name(F.col("name")), F.col("name")).otherwise(F.coalesce("raw_found", "clean_found", made))
    return joined.select(*names.columns, out.alias("resource_name"))


def exists(names: DataFrame, registry: DataFrame, prefix: str) -> DataFrame:
    """(name, corpus_exists): its resource or its display name is in the registry."""
    resolved = resolve(names, registry, prefix)
    by_path = registry.select(F.col("resource_name").alias("path")).distinct().withColumn("has_path", F.lit(True))
    by_name = registry.select(F.col("display_name").alias("shown")).distinct().withColumn("has_name", F.lit(True))
    joined = resolved.join(by_path, F.col("resource_name") == F.col("path"), "left").join(by_name, F.col("name") == F.col("shown"), "left")
    return joined.select("name", (F.coalesce("has_path", F.lit(False)) | F.coalesce("has_name", F.lit(False))).alias("corpus_exists"))


class Catalog:
    def __init__(self, spark: SparkSession, root: str, prefix: str = "projects/local/locations/local/ragCorpora"):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix
        self.log = f"{self.root}/_registry"

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none if it does not exist."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in fs.listStatus(target) if f.isDirectory()] if fs.exists(target) else []

    def events(self) -> DataFrame:
        if not self._exists(self.log):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(self.log)

    def registry(self) -> DataFrame:
        return fold(self.events()) if self._exists(self.log) else self.spark.createDataFrame([], CORPORA)

    def _append(self, resource: str, shown: str, event: str) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        seq = time.time_ns()  # of two writers neither has to know the other's events
        self.spark.createDataFrame([(resource, shown, event, now, seq)], EVENTS).coalesce(1).write.mode("append").parquet(self.log)

    def create(self, name: str, session: Session) -> tuple[str, str]:
        """Resource and display name of a new corpus, which becomes current; names may repeat."""
        shown = self.spark.range(1).select(scalars.sanitize(F.lit(name)).alias("n")).first()["n"]
        resource = f"{self.prefix}/{uuid.uuid4().hex}"
        self._append(resource, shown, "create")
        session.known |= {name: resource, shown: resource}
        session.current = resource
        return resource, shown

    def find(self, name: str, session: Session) -> str | None:
        """The resource of an existing corpus; the empty name is the current one."""
        if not name:
            return session.current
        if name in session.known:
            return session.known[name]
        names = self.spark.createDataFrame([(name,)], "name string")
        path = resolve(names, self.registry(), self.prefix).first()["resource_name"]
        if not self.registry().where(F.col("resource_name") == path).limit(1).count():
            return None
        session.known[name] = path
        session.current = session.current or path
        return path

    def path(self, resource: str) -> str:
        return f"{self.root}/corpus_id={resource.rsplit('/', 1)[-1]}"

    def drop(self, resource: str, session: Session) -> None:
        self._append(resource, "", "delete")
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(resource))
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        session.forget(resource)
