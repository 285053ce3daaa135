"""All queries of the engine's operators, with their SQL."""

from __future__ import annotations

from quillstream.plans import cleaned, curated, filed, located, relational, replied, segmented, spanned, stored, textual


def queries() -> dict:
    return relational.queries() | textual.queries() | curated.queries() | spanned.queries() | cleaned.queries() | stored.queries() | segmented.queries() | replied.queries() | filed.queries() | located.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | textual.oracle_sql() | curated.oracle_sql() | spanned.oracle_sql() | cleaned.oracle_sql() | stored.oracle_sql() | segmented.oracle_sql() | replied.oracle_sql() | filed.oracle_sql() | located.oracle_sql()
