"""Entities: declared schemas, natural keys, default order and tier.  Schemas are never inferred."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Fixed values, here and in all schemas, field lists and images below: the names, types, keys and orders of the entities.
CLIENT = "clientId string, clientName string, lei string, countryOfDomicile string, countryOfIncorporation string, taxResidencies array<string>, classification string, kycStatus string, riskRating string, legalEntityType string, parentClientId string"
LISTING = "sedol string, micCode string, operatingMic string, exchangeName string, tradedCurrency string, countryOfListing string, settlementLocation string, localCode string, primaryListing boolean, status string"
_STAMPS = "createdAt timestamp, updatedAt timestamp"


@dataclass(frozen=True)
class EntitySpec:
    name: str
    ddl: str
    key: tuple[str, ...]
    sort: tuple[tuple[str, bool], ...]  # (column, ascending)
    tier: str
    ordering: str | None = None
    required: tuple[str, ...] = ()
    topic: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def total_order(self) -> tuple[tuple[str, bool], ...]:
        """The default sort with the natural key as tie-break."""
        return self.sort + tuple((k, True) for k in self.key if k not in {c for c, _ in self.sort})


def _strings(*names: str) -> str:
    return ", ".join(f"{n} string" for n in names)


#: The fields of the feeds and of the change images.
CUSTODY_FIELDS = (
    "POS_REC_TYPE", "POS_BUS_DATE", "POS_BANK_NBR", "POS_BRANCH_CD", "POS_ACCT_NBR", "POS_ACCT_TYPE_CD", "POS_CUSIP_NBR", "POS_ISIN_NBR",
    "POS_SEC_DESC", "POS_ASSET_CLS_CD", "POS_REG_TYPE_CD", "POS_LOC_CD", "POS_SHR_QTY", "POS_SHR_QTY_PEND", "POS_MKT_PRICE", "POS_MKT_VALUE",
    "POS_ACCR_INT", "POS_PRICE_DT", "POS_LAST_ACTVY_DT", "POS_PLEDGE_IND", "POS_CCY_CD", "POS_SRC_SYS_ID",
)
VENDOR_FIELDS = (
    "Vendor_Ref", "Cusip", "ISIN_CODE", "sedol", "TICKER", "SecurityDesc", "Issuer_Name", "ASSET_CLS", "CPN_RATE", "MATURITY_DT", "CCY", "CNTRY_DOM",
    "CALLABLE_FLG", "ISSUE_STATUS", "EXCH_CD", "LAST_UPD_TS",
)
CASH_FIELDS = ("MOV_ACCT_NBR", "MOV_CCY_CD", "MOV_AMT", "MOV_TYPE_CD", "MOV_VALUE_TS", "MOV_NARRATIVE", "MOV_SRC_SYS_ID")
CLIENT_IMAGE = (
    "client_id", "client_name", "lei", "country_domicile", "country_incorp", "tax_residencies", "classification", "kyc_status", "risk_rating",
    "legal_entity_type", "parent_client_id", "updated_at",
)
ACCOUNT_IMAGE = ("account_nbr", "client_id", "account_name", "account_type", "base_ccy", "status", "open_date", "close_date", "branch", "updated_at")
_EVENT = "EVENT_ID string, OP string, PK string, LSN string, TS_MS string, SOURCE_TABLE string, BEFORE struct<{0}>, AFTER struct<{0}>"


def _image(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n}: string" for n in names)


#: Schema, natural key and default order of every entity.
ENTITIES = {
    e.name: e
    for e in (
        EntitySpec("accounts", f"accountId string, accountName string, accountType string, client struct<{CLIENT.replace(' ', ': ').replace(',:', ',')}>, baseCurrency string, status string, openDate timestamp, closeDate timestamp, custodianBranch string, {_STAMPS}", ("accountId",), (("accountId", True),), "semantic"),
        EntitySpec("securities", f"securityId string, vendorUpdatedAt string, isin string, cusip string, ticker string, figi string, description string, assetClass string, subType string, currency string, exchange string, issuer string, country string, maturityDate timestamp, couponRate decimal(9,4), status string, listings array<struct<{LISTING.replace(' ', ': ').replace(',:', ',')}>>, {_STAMPS}", ("securityId",), (("securityId", True),), "semantic"),
        EntitySpec("transactions", f"transactionId string, transactionType string, tradeDate timestamp, settlementDate timestamp, accountId string, securityId string, quantity decimal(18,4), price decimal(18,6), currency string, grossAmount decimal(18,2), fees decimal(18,2), netAmount decimal(18,2), fxRate decimal(12,6), counterpartyId string, status string, settlementRef string, sourceSystem string, internalRef string, {_STAMPS}", ("transactionId",), (("tradeDate", False),), "semantic"),
        EntitySpec("positions", f"positionId string, accountId string, securityId string, asOfDate timestamp, quantity decimal(18,4), currency string, costBasis decimal(18,2), marketPrice decimal(18,12), marketValue decimal(18,2), unrealizedPnL decimal(18,2), positionType string, snapshotType string, {_STAMPS}", ("accountId", "securityId", "asOfDate"), (("securityId", True),), "semantic"),
        EntitySpec("settlements", f"settlementId string, transactionId string, accountId string, securityId string, settlementDate timestamp, deliveryType string, quantity decimal(18,4), currency string, settlementAmount decimal(18,2), counterpartyId string, counterpartyAccount string, custodianAccount string, status string, statusHistory array<struct<status: string, timestamp: timestamp>>, failReason string, csdRef string, swiftRef string, {_STAMPS}", ("settlementId",), (("settlementDate", False),), "semantic"),
        EntitySpec("cash_balances", f"balanceId string, accountId string, currency string, asOfDate timestamp, openingBalance decimal(18,2), credits decimal(18,2), debits decimal(18,2), closingBalance decimal(18,2), pendingCredits decimal(18,2), pendingDebits decimal(18,2), projectedBalance decimal(18,2), snapshotType string, {_STAMPS}", ("accountId", "currency", "asOfDate"), (("currency", True),), "semantic"),
        EntitySpec("raw_custody_positions", _strings("REC_ID", *CUSTODY_FIELDS), ("REC_ID",), (("POS_BUS_DATE", False),), "raw", required=("REC_ID", "POS_BUS_DATE", "POS_ACCT_NBR"), topic="raw.custody.positions"),
        EntitySpec("raw_vendor_securities", _strings("Vendor_Ref", "SRC_UPDATED_AT", *VENDOR_FIELDS[1:]), ("Vendor_Ref",), (("Vendor_Ref", True),), "raw", ordering="SRC_UPDATED_AT", required=("Vendor_Ref",), topic="raw.vendorsec.securities"),
        EntitySpec("raw_cash_movements", _strings("MOVEMENT_ID", "MOV_FILE_DATE", "MOV_FILE_TIME", *CASH_FIELDS), ("MOVEMENT_ID",), (("MOV_FILE_DATE", False),), "raw", required=("MOVEMENT_ID", "MOV_FILE_DATE", "MOV_ACCT_NBR", "MOV_CCY_CD"), topic="raw.cash.movements"),
        EntitySpec("raw_crm_client_events", _EVENT.format(_image(CLIENT_IMAGE)), ("EVENT_ID",), (("LSN", False),), "raw", required=("EVENT_ID", "OP", "PK", "LSN"), topic="raw.crm.clients"),
        EntitySpec("raw_crm_account_events", _EVENT.format(_image(ACCOUNT_IMAGE)), ("EVENT_ID",), (("LSN", False),), "raw", required=("EVENT_ID", "OP", "PK", "LSN"), topic="raw.crm.accounts"),
    )
}

#: Hours after which a feed is stale, per its cadence (fixed values).
FEED_HOURS = {"raw.custody.positions": 30, "raw.custody.batches": 30, "raw.cash.movements": 8, "raw.vendorsec.securities": 26, "raw.crm.clients": 26, "raw.crm.accounts": 26}


def by_topic() -> dict[str, EntitySpec]:
    return {e.topic: e for e in ENTITIES.values() if e.topic}


def entity(name: str, tier: str | None = None) -> EntitySpec:
    """The registered entity; an unknown name or another tier is an error."""
    spec = ENTITIES.get(name)
    if spec is None:
        raise ValueError(f"UNKNOWN_TABLE: {name}")
    if tier and spec.tier != tier:
        raise ValueError(f"NOT_A_{tier.upper()}_TABLE: {name}")
    return spec
