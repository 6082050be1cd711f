"""Reference-data audits over the stand-in securities and accounts."""

from __future__ import annotations

from ..plans import quality as Q
from . import standins as S
from .standins import sql

QUERIES = {
    "d1_sedol_audit": lambda s, d: Q.bad_sedols(S.securities(s, d)),
    "d2_lei_audit": lambda s, d: Q.bad_leis(S.accounts(s, d)),
    "d3_isin_audit": lambda s, d: Q.bad_isins(S.securities(s, d)),
    "d4_repeated_sedols": lambda s, d: Q.repeated_sedols(S.securities(s, d)),
    "d5_primary_listings": lambda s, d: Q.primary_listings(S.securities(s, d)),
    "d6_listing_fields": lambda s, d: Q.listing_fields(S.securities(s, d)),
    "d7_client_snapshots": lambda s, d: Q.inconsistent_clients(S.accounts(s, d)),
    "d8_residencies": lambda s, d: Q.residencies(S.accounts(s, d)),
    "d9_parents": lambda s, d: Q.orphan_parents(S.accounts(s, d)),
    "d10_multi_listed": lambda s, d: Q.multi_listed(S.securities(s, d)),
}

SQL = {
    "d1_sedol_audit": sql("SELECT securityId, sedol FROM (SELECT *, substr(sedol, 1, 6) AS s6 FROM lst) WHERE (11 + CAST(substr(s6, 2, 1) AS INT) * 3 + CAST(substr(s6, 3, 1) AS INT) + CAST(substr(s6, 4, 1) AS INT) * 7 + CAST(substr(s6, 5, 1) AS INT) * 3 + CAST(substr(s6, 6, 1) AS INT) * 9 + CAST(substr(sedol, 7, 1) AS INT)) % 10 <> 0", "lst"),
    "d2_lei_audit": sql("SELECT accountId, lei FROM acct WHERE CAST(replace(lei, 'A', '10') AS HUGEINT) % 97 <> 1", "acct"),
    "d3_isin_audit": sql("SELECT securityId, isin FROM sec WHERE isin IS NOT NULL AND NOT regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]')", "sec"),
    "d4_repeated_sedols": sql("SELECT sedol, count(*) AS n FROM lst GROUP BY sedol HAVING count(*) > 1", "lst"),
    "d5_primary_listings": sql("SELECT securityId, CAST(count(*) AS INTEGER) AS n_listings, CAST(count(*) FILTER (WHERE primaryListing) AS INTEGER) AS n_primary FROM lst GROUP BY securityId, assetClass HAVING assetClass IN ('GOVT_BOND', 'CORP_BOND') OR count(*) FILTER (WHERE primaryListing) <> 1", "lst"),
    "d6_listing_fields": sql("SELECT securityId, sedol, micCode, countryOfListing, tradedCurrency FROM lst WHERE tradedCurrency = 'gbp' OR settlementLocation = ''", "lst"),
    "d7_client_snapshots": sql("SELECT clientId, count(*) AS n FROM acct GROUP BY clientId HAVING count(DISTINCT (clientName, lei, domicile, homes)) > 1", "acct"),
    "d8_residencies": sql("SELECT accountId, domicile FROM acct WHERE NOT list_contains(homes, domicile)", "acct"),
    "d9_parents": sql("SELECT DISTINCT clientId, parentClientId FROM acct WHERE parentClientId IS NOT NULL AND parentClientId NOT IN (SELECT clientId FROM acct)", "acct"),
    "d10_multi_listed": sql("SELECT securityId, micCode, count(DISTINCT tradedCurrency) AS n FROM lst GROUP BY ALL HAVING count(DISTINCT tradedCurrency) > 1", "lst"),
}
