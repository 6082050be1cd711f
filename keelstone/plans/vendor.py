"""Vendor rows -> enriched securities; the daily snapshot true-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean
from ..operators.delta import Retained, delta, index_of, retained_index
from ..operators.merge import merge
from ..operators.resolve import identifier_map, resolve_small, with_vendor_candidates
from ..registry import VENDOR_FIELDS
from ..tables import fixed

#: Three generations of the vendor's status words.
STATUS = {"ACTIVE": ("A", "ACT", "ACTIVE"), "MATURED": ("M", "MAT", "MATURED", "MAT'D"), "DELISTED": ("D", "DEL", "DELISTED", "INACTIVE", "I")}


def map_status(c: Column) -> Column:
    """The status enum, or null for words that are not known."""
    t = F.upper(clean(c))
    out = None
    for value, words in STATUS.items():
        out = F.when(t.isin(*words), value) if out is None else out.when(t.isin(*words), value)
    return out


def resolved(raw: DataFrame, securities: DataFrame) -> DataFrame:
    """Raw vendor rows with ``securityId`` (null where nothing matches)."""
    x, candidates = with_vendor_candidates(raw)
    return resolve_small(x, identifier_map(securities), candidates, ["Vendor_Ref"])


def enrich(raw: DataFrame, securities: DataFrame) -> DataFrame:
    """Securities with issuer and status from the vendor.

    Each column takes its latest non-empty value among rows newer than the security's own
    stamp (undated rows count only for securities never stamped); none is created.
    """
    x = resolved(raw, securities).filter("securityId IS NOT NULL").withColumn("issuer_new", clean(F.col("Issuer_Name"))).withColumn("status_new", map_status(F.col("ISSUE_STATUS")))
    own = securities.select(F.col("securityId").alias("_s"), F.col("vendorUpdatedAt").alias("_own"))
    x = x.join(own, F.col("securityId") == F.col("_s")).filter("_own IS NULL OR SRC_UPDATED_AT > _own")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.coalesce("SRC_UPDATED_AT", F.lit("")), F.col("Vendor_Ref")))
    new = x.groupBy(F.col("securityId").alias("_k")).agg(F.max_by("issuer_new", rank("issuer_new")).alias("_i"), F.max_by("status_new", rank("status_new")).alias("_st"), F.max("SRC_UPDATED_AT").alias("_t"))
    y = securities.join(new, F.col("securityId") == F.col("_k"), "left")
    return y.withColumns({"issuer": F.coalesce("_i", "issuer"), "status": F.coalesce("_st", "status"), "vendorUpdatedAt": F.coalesce("_t", "vendorUpdatedAt")}).drop("_k", "_i", "_st", "_t")


def true_up(previous: DataFrame, incoming: DataFrame, now_iso: Column) -> DataFrame:
    """The records that a snapshot delta emits: added and changed ones as delivered, removed ones as DELISTED, stamped now.

    ``previous`` keeps the last records, so a removed one still carries its identifiers; where
    it has stored hashes (``Retained``), those are compared.
    """
    key = "Vendor_Ref"
    changes = delta(retained_index(previous, key, "SRC_UPDATED_AT"), index_of(incoming, key, "SRC_UPDATED_AT"), retained="content_hash" in previous.columns).filter("change <> 'UNCHANGED'")
    up = incoming.join(changes.filter("change <> 'REMOVED'").select(F.col("key").alias(key), "change"), key)
    down = previous.join(changes.filter("change = 'REMOVED'").select(F.col("key").alias(key), "change"), key)
    down = down.withColumn("ISSUE_STATUS", F.lit("DELISTED")).withColumn("SRC_UPDATED_AT", now_iso)
    cols = [*VENDOR_FIELDS, "SRC_UPDATED_AT", "change"]
    return up.select(*cols).unionByName(down.select(*cols))


def apply_true_up(index: Retained, incoming: DataFrame, now_iso: Column, write, dry_run: bool = False) -> DataFrame:
    """One snapshot cycle: the emitted records, written by ``write``; only then is the retained snapshot replaced.

    A dry run writes nothing and keeps the retained snapshot.  A cycle that fails after
    the write emits the same records again, which the guarded landing ignores.
    """
    emitted = fixed(true_up(index.read(incoming.schema), incoming, now_iso))
    if not dry_run:
        write(emitted)
        index.replace(incoming)
    return emitted


def land(current: DataFrame, emitted: DataFrame) -> DataFrame:
    """Ordering-guarded landing of either channel into the raw vendor table."""
    return merge(current, emitted, ["Vendor_Ref"], "SRC_UPDATED_AT")
