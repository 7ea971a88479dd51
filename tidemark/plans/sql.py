"""SQL fragments that the oracle statements share."""

from __future__ import annotations

import string


def norm(col: str) -> str:
    """normalize_text() in a dialect without back references: repeats are collapsed letter by letter, as others are blanked later."""
    e = f"lower(coalesce({col}, ''))"
    e = rf"regexp_replace({e}, 'https?://\S+|www\.\S+|\b\w+\.(?:com|co\.id|id|net|org|io)\S*', ' ', 'g')"
    e = rf"regexp_replace({e}, '[:;=8][\-o\*'']?[\)\]\(\[dDpPvV/\\:\}}\{{@\|]|<3|\^[_\-\.]?\^|xD|XD', ' ', 'g')"
    e = rf"regexp_replace({e}, '\d+', ' ', 'g')"
    for c in string.ascii_lowercase:
        e = f"regexp_replace({e}, '{c}{{3,}}', '{c}{c}', 'g')"
    e = rf"regexp_replace({e}, '[^a-z\s]', ' ', 'g')"
    e = rf"regexp_replace({e}, '\b[a-z]\b', ' ', 'g')"
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def tokens(col: str) -> str:
    return f"list_filter(string_split({col}, ' '), lambda x: x <> '')"


def month(day: str, launch: str) -> str:
    """relative_month() for days since launch."""
    d, at = f"CAST({day} AS DATE)", f"DATE '{launch}'"
    m = f"((year({d}) - year({at})) * 12 + month({d}) - month({at}))"
    return f"CAST({m} + CASE WHEN {d} >= {at} AND {d} < {at} + to_months(CAST({m} AS INTEGER)) THEN -1 WHEN {d} < {at} AND {d} > {at} + to_months(CAST({m} AS INTEGER)) THEN 1 ELSE 0 END + 1 AS INTEGER)"


def week(day: str, launch: str) -> str:
    return f"CAST(floor((CAST({day} AS DATE) - DATE '{launch}') / 7) + 1 AS INTEGER)"
