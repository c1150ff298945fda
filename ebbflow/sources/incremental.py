"""Feature table that grows by days (S5, J4): appended days are computed alone, and two writers cannot both append them.

A version is a folder with the features of its new rows and the state of every fund after
them (``operators.recursion``: the last values and running sums, of fixed size), written under a name
of its own.  It becomes part of the table when a manifest file with the next number is created;
creating a file that exists fails, so of two writers that start from one version
one commits, and the other begins again from what the first has left.  Rows on or before a
fund's last date are in the table already and are not computed again.

Days are taken in order, each with one pass over the states and the day's rows, whatever
the history's length.  Readers see whole versions only; a folder without a manifest is
the rest of an attempt that failed.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.operators import recursion as RE
from ebbflow.schema import D, K, TARGETS, FlowConfig
from ebbflow.session import cut_lineage

ATTEMPTS = 5


class IncrementalFeatures:
    """The features known before each day (``add_model_features``) of all rows appended so far."""

    def __init__(self, spark: SparkSession, path: str, targets=TARGETS, cfg: FlowConfig = FlowConfig()):
        self.spark, self.path, self.targets, self.cfg = spark, path.rstrip("/"), list(targets), cfg

    # -------------------------------------------------------------- manifests
    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def version(self) -> int:
        """The number of the last committed version, 0 before the first."""
        fs, folder = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _manifest(self, number: int) -> dict:
        if not number:
            return {"features": [], "state": None}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{number:08d}.json", wholetext=True).first()[0])

    def _commit(self, number: int, held: dict) -> bool:
        """Whether this writer made version ``number``."""
        fs, target = self._fs(f"{self.path}/manifest/{number:08d}.json")
        try:
            out = fs.create(target, False)
        except Py4JJavaError:
            if fs.exists(target):
                return False
            raise
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        return True

    # ------------------------------------------------------------------ reads
    def read(self) -> DataFrame | None:
        """All rows with their features; None before the first version."""
        held = self._manifest(self.version())
        return self.spark.read.parquet(*held["features"]) if held["features"] else None

    def missing(self, flows: DataFrame) -> DataFrame:
        """The rows that come after their fund's last date in the table."""
        return self._after(flows, self._state(self._manifest(self.version())))

    def covers(self, flows: DataFrame) -> bool:
        return self.missing(flows).isEmpty()

    def _state(self, held: dict) -> DataFrame | None:
        return self.spark.read.parquet(held["state"]) if held["state"] else None

    def _after(self, flows: DataFrame, state: DataFrame | None) -> DataFrame:
        rows = flows.select(K, D, *self.targets).na.drop("any")
        if state is None:
            return rows
        return rows.join(state.select(K, "last_date"), K, "left").where(
            F.col("last_date").isNull() | (F.col(D) > F.col("last_date"))
        ).drop("last_date")

    # ----------------------------------------------------------------- writes
    def append(self, flows: DataFrame) -> int:
        """Adds the rows that the table lacks, in order of their days; returns the number of the version that holds them."""
        for _ in range(ATTEMPTS):
            base = self.version()
            held = self._manifest(base)
            folder = self._written(flows, self._state(held))
            if folder is None:
                return base
            new = {"features": [*held["features"], f"{folder}/features"], "state": f"{folder}/state"}
            if self._commit(base + 1, new):
                return base + 1
        raise RuntimeError(f"{ATTEMPTS} other writers were faster at {self.path}")

    def _written(self, flows: DataFrame, state: DataFrame | None) -> str | None:
        """The folder of a version with the new rows; None without new rows."""
        new = cut_lineage(self._after(flows, state))
        folder = f"{self.path}/version-{uuid.uuid4().hex}"
        if state is None:
            if new.isEmpty():
                return None
            # the first rows of all: by windows over the history
            RE.add_model_features(new, self.targets, self.cfg).write.parquet(f"{folder}/features")
            RE.initial_state(new, self.targets, self.cfg).write.parquet(f"{folder}/state")
            return folder
        days = [r[0] for r in new.select(D).distinct().orderBy(D).collect()]  # one for each appended day
        for day in days:
            features, state = self._day(new.where(F.col(D) == F.lit(day)), state, day)
            features.write.mode("append").parquet(f"{folder}/features")
        if not days:
            return None
        state.write.parquet(f"{folder}/state")
        return folder

    def _day(self, rows: DataFrame, state: DataFrame, day) -> tuple[DataFrame, DataFrame]:
        """(the day's rows with their features, the states after the day)."""
        names = state.columns
        values = rows.select(K, *[F.col(t).cast("double").alias(f"{t}_pred") for t in self.targets])
        known = RE.state_features(state.join(values, K), day, self.targets, self.cfg)
        columns = RE.feature_names(self.targets, self.cfg)
        old = known.select(K, F.lit(day).cast("date").alias(D), *[F.col(f"{t}_pred").alias(t) for t in self.targets], *columns)
        fresh = rows.join(state.select(K), K, "left_anti")
        first = RE.add_model_features(fresh, self.targets, self.cfg)
        moved = RE.advanced(state.join(values, K), day, self.targets, self.cfg).select(*names)
        idle = state.join(values.select(K), K, "left_anti").select(*names)
        begun = RE.initial_state(fresh, self.targets, self.cfg).select(*names)
        return old.unionByName(first.select(*old.columns)), cut_lineage(moved.unionByName(idle).unionByName(begun))
