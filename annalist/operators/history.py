"""Problem 3: the full history of changing entity attributes, kept under late and corrected updates.

Raw changes are the source of truth; the chain of an entity is the list of its versions.  An update, however late,
rebuilds whole chains: the touched entities are the distinct ids of the batch, a semi-join fetches all their raw
changes (old and new), their intervals are computed anew, and the new chains replace the old ones in one step.  The
store keeps chains in immutable generations; a generation becomes visible when its manifest is renamed into place, so
readers see either all replaced chains of a batch or none.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annalist.functions.ids import clean_id, clean_str
from annalist.functions.timestamps import format_us
from annalist.operators import chunked
from annalist.operators.instants import event_instants
from annalist.operators.skew import join_unique
from annalist.session import cut

CHAIN = "id string, from_us bigint, until_us bigint, status string, superseded_by string"


def assertions(events: DataFrame, source_formats: DataFrame) -> DataFrame:
    """Raw changes of the event log: ``id``, ``at_us``, ``event_id``, ``status``, ``superseded_by``, ``seen_at``.

    An event with an instant asserts every given status of its derived entities, and ``superseded`` (by its first
    derived entity, '' if it has none) for every id it supersedes.  Null or empty statuses and ids assert nothing.
    """
    derived = F.transform("derived_entities", lambda e: F.struct(clean_id(e["id"]).alias("id"), clean_str(e["status"]).alias("status"), F.lit("").alias("superseded_by")))
    first = F.coalesce(clean_id(F.get(F.col("derived_entities"), F.lit(0))["id"]), F.lit(""))
    gone = F.transform("supersedes", lambda s: F.struct(clean_id(s).alias("id"), F.lit("superseded").alias("status"), first.alias("superseded_by")))
    none = F.from_json(F.lit("[]"), "array<struct<id:string,status:string,superseded_by:string>>")
    d = events.select("id", "ts", "source", "seen_at", F.filter(F.concat(F.coalesce(derived, none), F.coalesce(gone, none)), lambda x: x["id"].isNotNull() & x["status"].isNotNull()).alias("said")).where(F.size("said") > 0)
    d = event_instants(d, source_formats, ["id", "seen_at", "said"]).where(F.col("instant_us").isNotNull())
    return d.select(clean_id(F.col("id")).alias("event_id"), F.col("instant_us").alias("at_us"), "seen_at", F.inline("said"))


def chains(changes: DataFrame, width_days: int = chunked.WIDTH_DAYS) -> DataFrame:
    """The versions of every entity in ``changes``: ``id``, ``from_us``, ``until_us`` (null: still valid), ``status``,
    ``superseded_by``.

    Of assertions at one instant the largest event id holds (then the larger status); an assertion equal to the one
    before it makes no new version.  Keys with very many changes are scanned in time chunks.
    """
    held = changes.groupBy("id", "at_us").agg(F.max(F.struct("event_id", "status", "superseded_by")).alias("held"))
    # Both tables are read several times below, to count, to scan and to carry.
    held = cut(held.select("id", "at_us", F.struct("held.status", "held.superseded_by").alias("state")), "held")
    d = chunked.with_chunk(held, chunked.split_factors(held, "id"), "id", "at_us", width_days)
    d = chunked.lag_across(d, "id", ["at_us"], "state", "before")
    versions = cut(d.where(F.col("before").isNull() | (F.col("before") != F.col("state"))).drop("before"), "versions", drop=held)
    d = chunked.lead_across(versions, "id", ["at_us"], "at_us", "until_us")
    return d.select("id", F.col("at_us").alias("from_us"), "until_us", "state.status", "state.superseded_by")


class HistoryStore:
    """Raw changes and chains in one folder, updated by affected-chain rebuild.

    Every update writes ``parts/<name>/raw``, ``touched`` and ``chains`` under a name of its own, and becomes visible when
    its manifest ``manifests/<n>.json``, which names the part, is renamed into place.  Of two writers that build on the
    same state one finds that manifest there already and fails; it has replaced nothing and may ``apply`` again.  Files
    without a manifest are never read.

    Raw changes are partitioned by a hash of their id, so an update reads the partitions of the ids it touches and no
    others.  A chain is read from the newest generation that touched its entity.  ``compact`` folds all generations into
    one.  ``buckets`` is fixed when the store is made; one per 128 MB of raw changes that are expected is about right.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None, buckets: int = 32):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifests(self) -> list[dict]:
        """Committed generations in order, from the last compaction on."""
        if not self._fs.exists(self._p("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("manifests"))]
        done: list[dict] = []
        for g in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True):
            stream = self._fs.open(self._p(f"manifests/{g}.json"))
            try:
                done.insert(0, json.loads(bytes(stream.readAllBytes())))
            finally:
                stream.close()
            if done[0]["base"]:
                break
        return done

    def generations(self) -> list[int]:
        return [m["generation"] for m in self.manifests()]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _raw_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])

    def _raw(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        d = self.spark.read.schema(self._raw_schema()).parquet(f"{self.path}/parts/{m['part']}/raw")
        return (d if buckets is None else d.where(F.col("bucket").isin(buckets))).drop("bucket")

    def raw(self, buckets: list[int] | None = None) -> DataFrame:
        """All raw changes, or those of some partitions, whose files alone are read then."""
        return reduce(DataFrame.unionByName, [self._raw(m, buckets) for m in self.manifests()])

    def _read(self, m: dict, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/parts/{m['part']}/{what}")

    def read(self) -> DataFrame:
        """Chains as of the last committed generation."""
        done = self.manifests()
        if not done:
            return self.spark.createDataFrame([], CHAIN)
        if len(done) == 1:
            return self._read(done[0], "chains", CHAIN)
        marked = lambda what, schema: reduce(DataFrame.unionByName, [self._read(m, what, schema).withColumn("g", F.lit(m["generation"])) for m in done])
        owner = marked("touched", "id string").groupBy("id").agg(F.max("g").alias("owner"))
        return join_unique(marked("chains", CHAIN), owner, "id").where("g = owner").drop("g", "owner")

    def _write(self, changes: DataFrame, part: str) -> None:
        # Rebalancing gives a partition that is large, as that of a hot id, to several tasks.
        changes.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/parts/{part}/raw")

    def apply(self, changes: DataFrame) -> int:
        """Add a batch of raw changes and replace the chains of all entities it touches; returns the generation."""
        if self.schema is None:
            self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in changes.schema])
        done, part = self.manifests(), uuid.uuid4().hex
        here = f"{self.path}/parts/{part}"
        self._write(changes, part)
        batch = self._raw({"part": part})
        batch.select("id").distinct().write.parquet(f"{here}/touched")
        if done:
            ids = self.spark.read.schema("id string").parquet(f"{here}/touched")
            hit = [r["b"] for r in ids.select(self._bucket().alias("b")).distinct().collect()]
            batch = batch.unionByName(self.raw(hit).join(ids, "id", "left_semi"))
        chains(batch).write.parquet(f"{here}/chains")
        return self._commit(done, part)

    def compact(self) -> int:
        """Fold all generations into one, which replaces them for readers from then on."""
        done, part = self.manifests(), uuid.uuid4().hex
        here = f"{self.path}/parts/{part}"
        self._write(self.raw(), part)
        self.read().write.parquet(f"{here}/chains")
        self._read({"part": part}, "chains", CHAIN).select("id").distinct().write.parquet(f"{here}/touched")
        return self._commit(done, part, base=True)

    def vacuum(self) -> None:
        """Delete parts that no readable generation names; only while nobody writes and no older reader is left."""
        kept = {m["part"] for m in self.manifests()}
        for s in self._fs.listStatus(self._p("parts")):
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)

    def _commit(self, done: list[dict], part: str, base: bool = False) -> int:
        g = done[-1]["generation"] + 1 if done else 0
        self._fs.mkdirs(self._p("manifests"))
        draft, final = self._p(f"manifests/.{uuid.uuid4().hex}"), self._p(f"manifests/{g}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"generation": g, "part": part, "base": base or not done}).encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            # This rename never replaces a file that is there.
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), never)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise RuntimeError(f"generation {g} was committed by another writer") from e
            raise
        return g


def found(store: HistoryStore, events: DataFrame, source_formats: DataFrame, late_share: float = 0.1) -> DataFrame:
    """p3_found through the store: the rows that arrived first build the chains, the later rest is applied as updates.

    The split is by arrival (``seen_at``), at the quantile that leaves about ``late_share`` of the rows for the update;
    where it lies never changes the result.  Empty tables give no rows.
    """
    raw = cut(assertions(events, source_formats), "assertions")
    bound = raw.where("seen_at IS NOT NULL").agg(F.percentile_approx(F.unix_micros(F.col("seen_at").cast("timestamp")), 1.0 - late_share, 1000).alias("b")).first()[0]
    at = F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(0))
    store.apply(raw.where(at <= F.lit(bound or 0)))
    store.apply(raw.where(at > F.lit(bound or 0)))
    until = F.coalesce(format_us("until_us"), F.lit(""))
    return store.read().select("id", format_us("from_us").alias("valid_from"), until.alias("valid_to"), "status", "superseded_by")
