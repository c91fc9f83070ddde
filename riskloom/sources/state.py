"""Stored state: saved scans, suppressions and profiles."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import severity_rank
from ..storage import children, delete, exists, materialize, new_folder, release, shared_folder

SUPPRESSION_SCHEMA = "array<struct<fingerprint:string,reason:string,reviewer:string,date:string>>"
PROFILE_SCHEMA = (
    "name string, description string, min_severity string, "
    "severity_overrides map<string,string>, enabled_rule_prefixes array<string>"
)

_ALL_PREFIXES = ["SEC", "GIT", "CFG", "CRY", "DAT", "AUTH", "INJ", "DEP", "AI", "PRI"]

# The profiles that come with the engine, as the JSON a user would write.
BUILT_IN_PROFILES = [
    {"name": "hobby", "min_severity": "HIGH", "severity_overrides": {}, "enabled_rule_prefixes": _ALL_PREFIXES},
    {
        "name": "saas",
        "min_severity": "LOW",
        "severity_overrides": {"CFG003": "CRITICAL", "CRY001": "CRITICAL", "CRY002": "CRITICAL"},
        "enabled_rule_prefixes": _ALL_PREFIXES,
    },
    {
        "name": "enterprise",
        "min_severity": "LOW",
        "severity_overrides": {
            "DEP002": "CRITICAL",
            "DEP101": "CRITICAL",
            "DEP105": "CRITICAL",
            "PRI001": "CRITICAL",
            "PRI003": "CRITICAL",
            "PRI005": "CRITICAL",
        },
        "enabled_rule_prefixes": _ALL_PREFIXES,
    },
]


# ---- history ----------------------------------------------------------------------------


HISTORY_BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("scan_id"), F.lit(HISTORY_BUCKETS)).cast("int").alias("bucket")


def save_scans(scans: DataFrame, findings: DataFrame, path: str) -> None:
    """Append scans and their findings to a history folder.

    Findings lie in a fixed number of folders by a hash of their scan, cut to even files. They are
    written first and the scans last, under the id of this save, so a save that broke off shows
    nothing. Saving a scan again replaces it: the newest save of a scan counts.
    """
    _append(scans.withColumn("written_at", F.current_timestamp()), findings, path)


def _append(scans: DataFrame, findings: DataFrame, path: str) -> None:
    save = F.lit(uuid.uuid4().hex).alias("save_id")
    # Sorted files: row groups tell by their first and last scan whether they hold one of a few scans.
    rows = findings.select("*", save, _bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "scan_id")
    rows.write.mode("append").partitionBy("bucket").parquet(f"{path}/findings")
    scans.select("*", save).write.mode("append").parquet(f"{path}/scans")


def _valid_scans(saves: DataFrame) -> DataFrame:
    """The newest save of each scan, with its ``save_id`` and ``written_at``."""
    last = saves.groupBy("scan_id").agg(F.max(F.struct("written_at", "save_id")).alias("_last"))
    same = (F.col("written_at") == F.col("_last.written_at")) & (F.col("save_id") == F.col("_last.save_id"))
    return saves.join(last, "scan_id").filter(same).drop("_last")


def load_history(spark: SparkSession, path: str, newest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scans and findings of a history folder, all or of the newest scans of each project only.

    For the newest the scans are chosen first and stored; where they are few enough for Spark to send
    them to all tasks, only the folders of findings that hold one of them are opened.
    """
    from ..operators.history import latest_scans

    scans = _valid_scans(spark.read.parquet(f"{path}/scans")).drop("written_at")
    findings = spark.read.parquet(f"{path}/findings")
    keys = ["bucket", "scan_id", "save_id"]
    if newest is not None:
        scans = materialize(latest_scans(scans, newest).withColumn("bucket", _bucket()), "newest")
        chosen = scans.filter(F.col("recency") <= newest).select(*keys)
        scans = scans.drop("bucket")
    else:
        chosen = scans.select(_bucket(), "scan_id", "save_id")
    held = findings.join(chosen, keys, "left_semi")
    return scans.drop("save_id"), held.drop("save_id", "bucket")


def compact_history(spark: SparkSession, path: str) -> int:
    """Rewrite a history without replaced or broken saves; the number of files that went.

    What counts is written again as one save under its own times, findings first, and then the files that were
    there before are deleted, scans first. Broken off at any point, it shows the same history: until the old scans
    are gone both saves hold the same rows and one of them counts. Scans that others save meanwhile stay.
    Run it when nobody reads the folder: a reader that has listed the old files fails.
    """
    old = {name: spark.read.parquet(f"{path}/{name}").inputFiles() for name in ("scans", "findings")}
    scans = materialize(_valid_scans(spark.read.parquet(*old["scans"])).dropDuplicates(["scan_id"]), "scans")
    findings = spark.read.parquet(f"{path}/findings").join(
        scans.select(_bucket(), "scan_id", "save_id"), ["bucket", "scan_id", "save_id"], "left_semi"
    )
    _append(scans.drop("save_id"), findings.drop("save_id", "bucket"), path)
    release(scans)
    for name in ("scans", "findings"):
        for file in old[name]:
            delete(spark, file)
    return sum(map(len, old.values()))


# Fields of a saved scan document that a history needs.
SCAN_DOCUMENT = (
    "target string, profile string, files_scanned long, score string, "
    "findings array<struct<fingerprint:string>>, _meta struct<saved_at:string,fingerprints:array<string>>"
)


def parse_scan_documents(documents: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Scans and their distinct fingerprints from saved scan documents, one JSON object per row.

    ``documents`` names them by ``scan_id``. The list in the document's own notes counts; where it
    is absent or empty the fingerprints of the findings do. A damaged document is a scan without any.
    The score may be a number or an object with a value.
    """
    doc = documents.select("scan_id", F.from_json(text, SCAN_DOCUMENT).alias("doc")).select("scan_id", "doc.*")
    value = F.coalesce(F.get_json_object("score", "$.value"), F.col("score")).try_cast("int")
    saved = F.try_to_timestamp(F.col("_meta.saved_at"), F.lit("yyyy-MM-dd_HHmmss_SSSSSS"))
    scans = doc.select("scan_id", "target", "profile", "files_scanned", value.alias("score"), saved.alias("saved_at"))
    noted = F.col("_meta.fingerprints")
    prints = F.when(F.size(noted) > 0, noted).otherwise(F.col("findings.fingerprint"))
    held = doc.select("scan_id", F.explode(prints).alias("fingerprint")).filter("fingerprint <> ''")
    return scans, held.distinct()


def load_scan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`parse_scan_documents` for files; the file name without its ending is the scan."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1)
    return parse_scan_documents(spark.read.text(path, wholetext=True).select(name.alias("scan_id"), "value"))


# ---- suppressions -----------------------------------------------------------------------


def parse_suppressions(documents: DataFrame, text: str = "value") -> DataFrame:
    """Entries of suppression documents, one JSON array each. A damaged document counts as empty."""
    parsed = F.from_json(text, SUPPRESSION_SCHEMA)
    return (
        documents.select(*[c for c in documents.columns if c != text], F.explode(parsed).alias("entry"))
        .select(*[c for c in documents.columns if c != text], "entry.*")
        .filter(F.col("fingerprint").isNotNull())
        .withColumn("date", F.to_date("date"))
    )


def load_suppressions(spark: SparkSession, path: str) -> DataFrame:
    return parse_suppressions(spark.read.text(path, wholetext=True))


_SAVED_SUPPRESSIONS = "fingerprint string, reason string, reviewer string, date date"


def save_suppressions(suppressions: DataFrame, path: str) -> str:
    """Write all entries as a new version of a suppression folder; the name of the version.

    Entries are written first and the row that names the version last, so a save that broke off shows
    nothing and readers see a whole version. Older versions stay until :func:`prune_suppressions`.
    """
    version = uuid.uuid4().hex
    columns = ["fingerprint", "reason", "reviewer", F.col("date").cast("date").alias("date")]
    suppressions.select(*columns, F.lit(version).alias("version")).write.mode("append").partitionBy("version").parquet(f"{path}/entries")
    named = suppressions.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written_at"))
    named.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def _versions(spark: SparkSession, path: str, n: int) -> list[str]:
    """The newest ``n`` versions, newest first."""
    if not exists(spark, f"{path}/versions"):
        return []
    rows = spark.read.schema("version string, written_at timestamp").parquet(f"{path}/versions")
    return [r.version for r in rows.orderBy(F.desc("written_at"), "version").limit(n).collect()]


def load_saved_suppressions(spark: SparkSession, path: str) -> DataFrame:
    """Entries of the newest version; none if nothing was saved yet. Only the folder of that version is read."""
    newest = _versions(spark, path, 1)
    if not newest:
        return spark.createDataFrame([], _SAVED_SUPPRESSIONS)
    entries = spark.read.schema(f"{_SAVED_SUPPRESSIONS}, version string").parquet(f"{path}/entries")
    return entries.filter(F.col("version") == newest[0]).drop("version")


def change_suppressions(
    spark: SparkSession, path: str, add: DataFrame | None = None, remove: DataFrame | None = None
) -> DataFrame:
    """Add entries, then remove fingerprints, as one new version; per fingerprint to remove whether there was an entry.

    Fails without a new version if somebody else saved one since this call began to read, so no
    change of theirs is lost; two calls that end within the same moment are not told apart.
    """
    from ..operators.suppress import add_suppressions, remove_suppressions, removed_any

    before = _versions(spark, path, 1)
    entries = load_saved_suppressions(spark, path)
    if add is not None:
        entries = add_suppressions(entries, add)
    gone = spark.createDataFrame([], "fingerprint string") if remove is None else remove
    removed = materialize(removed_any(entries, gone), "removed")
    entries = materialize(entries if remove is None else remove_suppressions(entries, gone), "entries")
    if _versions(spark, path, 1) != before:
        raise RuntimeError(f"the suppressions in {path} were changed meanwhile; run the change again")
    save_suppressions(entries, path)
    release(entries)
    return removed


def prune_suppressions(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Delete the entries of all but the newest ``keep`` versions and of broken saves; how many folders went."""
    kept = _versions(spark, path, max(keep, 1))
    if not kept:
        return 0
    old = [folder for folder in children(spark, f"{path}/entries") if folder.startswith("version=") and folder[8:] not in kept]
    for folder in old:
        delete(spark, f"{path}/entries/{folder}")
    return len(old)


# ---- profiles ---------------------------------------------------------------------------


def parse_profiles(documents: DataFrame, text: str = "value") -> DataFrame:
    """Profiles with severities as ranks. Unknown names drop out; the minimum defaults to LOW."""
    doc = F.from_json(text, PROFILE_SCHEMA)
    ranked = F.transform_values(
        F.coalesce(F.col("doc.severity_overrides"), F.create_map().cast("map<string,string>")),
        lambda _, name: severity_rank(name),
    )
    none = F.array().cast("array<string>")
    return documents.select(doc.alias("doc")).select(
        F.col("doc.name").alias("name"),
        F.coalesce(F.col("doc.description"), F.lit("")).alias("description"),
        F.coalesce(severity_rank(F.col("doc.min_severity")), F.lit(1)).alias("min_severity"),
        F.map_filter(ranked, lambda _, rank: rank.isNotNull()).alias("severity_overrides"),
        F.coalesce(F.col("doc.enabled_rule_prefixes"), none).alias("enabled_rule_prefixes"),
    )


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return parse_profiles(spark.read.text(path, wholetext=True))


def profiles_of(spark: SparkSession, profiles: list[dict]) -> DataFrame:
    return parse_profiles(spark.createDataFrame([(json.dumps(profile),) for profile in profiles], "value string"))


def built_in_profiles(spark: SparkSession) -> DataFrame:
    return profiles_of(spark, BUILT_IN_PROFILES)
