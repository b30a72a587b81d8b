"""Deliveries as a stream of files: each is screened against the version that the one before left, and moves all tables to the next in one step."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import components
from veldmark.operators import issues, prices
from veldmark.operators.baseline import Baseline, Kept, touched
from veldmark.operators.delta import STATE_COLUMNS
from veldmark.operators.screening import Profile, Screened, screen
from veldmark.sources.delimited import DeliveryBlocked

STATE = "identity_hash string, article_fingerprint string, price_fingerprint string, combined_fingerprint string, base_price decimal(24,0), currency string, components " + components.TYPE
#: What a library keeps.
TABLES = {
    "state": Kept(STATE, ("identity_hash",), ("identity_hash", "article_fingerprint", "price_fingerprint", "combined_fingerprint")),
    "latest": Kept(f"identity_hash string, component_code string, values {prices.VALUES}", ("identity_hash", "component_code"), ("identity_hash",)),
    "references": Kept("reference_type string, value string, identity_hash string, since int", ("reference_type", "value", "identity_hash"), added=True),
    "cases": Kept("code string, signature string, status string, revision string, event string", ("code", "signature")),
    "tallies": Kept("code string, signature string, severity string, occurrences bigint, first_row bigint, first_at date, last_at date", ("code", "signature")),
    "mutations": Kept("idempotency_key string, identity_hash string, action string, status string, reason string, before_price decimal(24,0), after_price decimal(24,0), mask string", ("idempotency_key",), added=True),  # a key tells its version
    "deliveries": Kept("delivery string, name string, day date, outcome string, accepted boolean, raw bigint, valid bigint, n_mutations bigint", ("delivery",)),
}


class DeliveryChanged(RuntimeError):
    """A file that was written to while it was screened; nothing of it was taken."""


@dataclass
class Library:
    """The accepted offers of one link, and how its deliveries are screened.

    accepts: verdicts with which a delivery becomes the baseline. What it doesn't accept leaves its outcome, cases and tallies only.
    """

    spark: SparkSession
    root: str
    profile: Profile
    link: str = "1"
    revision: str = "1"
    accepts: tuple[str, ...] = ("VALID", "VALID_WITH_WARNINGS", "REVIEW_REQUIRED")
    most_values: int = 200
    baseline: Baseline = field(init=False)

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        self.baseline = Baseline(self.spark, f"{self.root}/baseline", TABLES)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.baseline.read(table, version)

    def _seen(self, path: str) -> tuple:
        """Length and time of a file, as Spark sees them."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        status = files.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(files)
        return status.getLen(), status.getModificationTime()

    def advance(self, path: str, day, delivery: str | None = None, name: str | None = None) -> int | None:
        """Screen one file and publish the version that it leads to; None if the delivery (by default the file's path, time and size) is in a version already."""
        seen = self._seen(path)
        delivery = delivery or ":".join(map(str, (path, *seen)))
        version = self.baseline.last()
        if self.read("deliveries", version).where(F.col("delivery") == delivery).head(1):
            return None
        folder = f"{self.root}/runs/{hashlib.sha256(delivery.encode()).hexdigest()[:32]}/{version:08d}"
        at = F.lit(day).cast("date")
        told = {"delivery": delivery, "name": name or path.rpartition("/")[2]}
        try:
            run = screen(self.spark, path, self.profile, self.read("state", version), self.read("latest", version), folder, self.read("references", version).drop("since"), prefix=f"{self.link}:{version + 1}")
        except DeliveryBlocked as e:
            return self.baseline.publish(version, {"deliveries": self._told(told | {"outcome": e.code, "accepted": False}, at)})
        outcome = run.judgement.head()
        accepted = outcome["verdict"] in self.accepts
        changes = self._accepted(run, version, at) if accepted else {}
        changes |= self._observed(run, version, at)
        n = changes["mutations"].count() if accepted else 0
        changes["deliveries"] = self._told(told | {"outcome": outcome["verdict"], "accepted": accepted, "raw": outcome["raw"], "valid": outcome["valid"], "n_mutations": n}, at)
        if self._seen(path) != seen:
            raise DeliveryChanged(path)
        return self.baseline.publish(version, changes)

    def _told(self, values: dict, at) -> DataFrame:
        names = {"delivery": "string", "name": "string", "outcome": "string", "accepted": "boolean", "raw": "bigint", "valid": "bigint", "n_mutations": "bigint"}
        row = tuple(values.get(c) for c in names)
        return self.spark.createDataFrame([row], ", ".join(f"{c} {t}" for c, t in names.items())).withColumn("day", at)

    def _accepted(self, run: Screened, version: int, at) -> dict[str, DataFrame]:
        """What acceptance changes: offers that are new or changed, their values of the day, their references, and the plan itself."""
        changed = run.staged.where(F.col("classification").isin("NEW", "CHANGED"))
        today = prices.values_of(changed).select("identity_hash", "component_code", at.alias("observation_date"), "amount")
        old = touched(self.read("latest", version), today, prices.KEY)
        refs = None
        for kind in self.profile.reference_types:
            rows = changed.select(F.lit(kind).alias("reference_type"), F.col(kind).alias("value"), "identity_hash")
            refs = rows if refs is None else refs.unionByName(rows)
        nested = F.col("components") if "components" in changed.columns else F.lit(None).cast(components.TYPE)
        out = {"state": changed.select("identity_hash", *STATE_COLUMNS, nested.alias("components")), "latest": prices.with_observations(old, today, self.most_values), "mutations": run.mutations}
        if refs is not None:  # references are only added; one that somebody holds stays with its holder
            known = self.read("references", version).select("reference_type", "value")
            new = refs.where("value is not null and value <> ''").distinct().join(known, ["reference_type", "value"], "left_anti")
            out["references"] = new.withColumn("since", F.lit(version + 1))
        return out

    def _observed(self, run: Screened, version: int, at) -> dict[str, DataFrame]:
        """Tallies with this delivery's added, and cases of its groups; those of other signatures stay as they are."""
        own = issues.timed_tally(run.issues, at)
        keys = ["code", "signature"]
        tallies = issues.merged_tallies(touched(self.read("tallies", version), own, keys), own)
        observed = run.groups.select(*keys, F.lit(self.revision).alias("revision")).distinct()
        return {"tallies": tallies, "cases": issues.sync_cases(touched(self.read("cases", version), observed, keys).drop("event"), observed)}


def follow_deliveries(files: DataFrame, library: Library, checkpoint: str, day=None):
    """A query that takes all files which are there, in order of time and name. files: a stream of name, path, mtime and size (``sources.directory``).

    A batch that comes again finds its deliveries in the versions and publishes none twice. day(row) tells a delivery's day; by default that of mtime.
    """
    day = day or (lambda row: library.spark.sql(f"select to_date(timestamp_seconds({row['mtime']}))").head()[0])

    def take(rows: DataFrame, batch: int) -> None:
        for row in rows.orderBy("mtime", "name").collect():  # the files of one listing, at most maxFiles
            library.advance(row["path"], day(row), f"{row['name']}:{row['mtime']}:{row['size']}", row["name"])

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
