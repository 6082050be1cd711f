"""CRM change log -> accounts with embedded clients, rebuilt from the logs, so any order of arrival gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import code, crm_date, epoch_millis
from ..operators.merge import latest, lsn_order
from ..registry import CLIENT

#: The source's code lists.
CLASSIFICATION = {"retail": "RETAIL", "professional": "PROFESSIONAL", "eligible_counterparty": "ELIGIBLE_COUNTERPARTY"}
KYC_STATUS = {"approved": "APPROVED", "pending_review": "PENDING_REVIEW", "expired": "EXPIRED"}
RISK_RATING = {"low": "LOW", "medium": "MEDIUM", "high": "HIGH"}
LEGAL_ENTITY_TYPE = {"corporation": "CORPORATION", "partnership": "PARTNERSHIP", "fund": "FUND", "trust": "TRUST", "government": "GOVERNMENT", "individual": "INDIVIDUAL"}
ACCOUNT_TYPE = {"custody": "CUSTODY", "proprietary": "PROPRIETARY", "omnibus": "OMNIBUS"}
ACCOUNT_STATUS = {"active": "ACTIVE", "suspended": "SUSPENDED", "closed": "CLOSED"}

#: Outcomes of ``event_outcomes``.
OUTCOMES = ("MISSING_PK", "NO_AFTER_IMAGE", "MISSING_CLIENT", "CURATED")

CLIENT_TYPE = f"struct<{CLIENT.replace(' ', ': ').replace(',:', ',')}>"


def _or(c: Column, other: Column) -> Column:
    """``c`` unless it is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)


def client_master(image: str) -> Column:
    """A client image (struct column) -> the embedded client."""
    at = lambda n: F.col(f"{image}.{n}")
    domicile = F.upper(F.coalesce(at("country_domicile"), F.lit("")))
    parts = F.filter(F.transform(F.split(F.coalesce(at("tax_residencies"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    homes = F.when((domicile != "") & ~F.array_contains(parts, domicile), F.concat(F.array(domicile), parts)).otherwise(parts)
    homes = F.when(F.size(homes) > 0, homes).otherwise(F.array(domicile))
    return F.struct(
        at("client_id").alias("clientId"), _or(at("client_name"), at("client_id")).alias("clientName"), F.coalesce(at("lei"), F.lit("")).alias("lei"), domicile.alias("countryOfDomicile"),
        F.upper(_or(at("country_incorp"), domicile)).alias("countryOfIncorporation"), homes.alias("taxResidencies"), code(at("classification"), CLASSIFICATION, "RETAIL").alias("classification"),
        code(at("kyc_status"), KYC_STATUS, "PENDING_REVIEW").alias("kycStatus"), code(at("risk_rating"), RISK_RATING, "MEDIUM").alias("riskRating"),
        code(at("legal_entity_type"), LEGAL_ENTITY_TYPE, "CORPORATION").alias("legalEntityType"), at("parent_client_id").alias("parentClientId"),
    ).cast(CLIENT_TYPE)


def placeholder(client_id: Column) -> Column:
    """A valid, visibly incomplete client for an account whose client has not arrived."""
    e = F.lit("")
    return F.struct(client_id, client_id, e, e, e, F.array().cast("array<string>"), F.lit("RETAIL"), F.lit("PENDING_REVIEW"), F.lit("MEDIUM"), F.lit("CORPORATION"), F.lit(None).cast("string")).cast(CLIENT_TYPE)


def latest_clients(events: DataFrame) -> DataFrame:
    """PK, AFTER of the newest event with an after image."""
    return latest(events.filter("AFTER IS NOT NULL"), ["PK"], lsn_order(), ["AFTER"])


def latest_accounts(events: DataFrame) -> DataFrame:
    return latest(events, ["PK"], lsn_order(), ["EVENT_ID", "OP", "LSN", "TS_MS", "AFTER"])


def last_names(events: DataFrame) -> DataFrame:
    """PK, client_name: the newest that is not empty."""
    x = events.filter("AFTER.client_name <> ''").select("PK", "LSN", "EVENT_ID", F.col("AFTER.client_name").alias("client_name"))
    return latest(x, ["PK"], lsn_order(), ["client_name"])


def event_outcomes(events: DataFrame, table: str) -> DataFrame:
    """Every event with ``outcome``: CURATED or the reason for skipping it."""
    o = F.when(F.coalesce("PK", F.lit("")) == "", "MISSING_PK").when(F.col("OP") == "d", "CURATED").when(F.col("AFTER").isNull(), "NO_AFTER_IMAGE")
    if table == "accounts":
        o = o.when(F.coalesce("AFTER.client_id", F.lit("")) == "", "MISSING_CLIENT")
    return events.withColumn("outcome", o.otherwise("CURATED"))


def accounts(account_events: DataFrame, client_events: DataFrame, now: Column) -> DataFrame:
    """The accounts table as of both logs.

    An account's fields come from its newest upsert, its status from the newest of its
    own upsert, its delete and its client's delete.  Deletes never create an account.  Each
    log is read by one aggregate.
    """
    ok = event_outcomes(account_events, "accounts").filter("outcome = 'CURATED'").withColumn("_o", lsn_order())
    up, gone = F.when(F.col("OP") != "d", F.col("_o")), F.when(F.col("OP") == "d", F.col("_o"))  # rows without an order do not compete
    own = ok.groupBy("PK").agg(F.max_by(F.struct("AFTER", "_o"), up).alias("_u"), F.max(gone).alias("_d"), F.max_by("TS_MS", gone).alias("_d_ts"))
    own = own.filter("_u IS NOT NULL").select("PK", "_u.*", "_d", "_d_ts")
    c = client_events.withColumn("_o", lsn_order())
    clients = c.groupBy(F.col("PK").alias("_c")).agg(F.max_by("AFTER", F.when(F.col("AFTER").isNotNull(), F.col("_o"))).alias("_image"), F.max(gone).alias("_cd"), F.max_by("TS_MS", gone).alias("_cd_ts"))
    x = own.join(clients.filter("_c <> ''"), F.col("AFTER.client_id") == F.col("_c"), "left")
    place = lambda c: F.struct(c["col1"], c["col2"])
    own = F.col("_d").isNotNull() & (place(F.col("_d")) > place(F.col("_o")))
    by_client = F.col("_cd").isNotNull() & (place(F.col("_cd")) > place(F.col("_o")))
    a = lambda n: F.col(f"AFTER.{n}")
    closed_at = F.when(own & by_client, F.greatest(epoch_millis(F.col("_d_ts")), epoch_millis(F.col("_cd_ts")))).when(own, epoch_millis(F.col("_d_ts"))).when(by_client, epoch_millis(F.col("_cd_ts")))
    return x.select(
        F.col("PK").alias("accountId"), _or(a("account_name"), F.col("PK")).alias("accountName"), code(a("account_type"), ACCOUNT_TYPE, "CUSTODY").alias("accountType"),
        F.when(F.col("_image").isNotNull(), client_master("_image")).otherwise(placeholder(a("client_id"))).alias("client"), _or(a("base_ccy"), F.lit("USD")).alias("baseCurrency"),
        F.when(own | by_client, "CLOSED").otherwise(code(a("status"), ACCOUNT_STATUS, "ACTIVE")).alias("status"), F.coalesce(crm_date(a("open_date")), now).alias("openDate"),
        F.when(own | by_client, closed_at).otherwise(crm_date(a("close_date"))).alias("closeDate"), F.coalesce(a("branch"), F.lit("")).alias("custodianBranch"), now.alias("createdAt"), now.alias("updatedAt"),
    )
