"""SQL text of the shared views, for the queries that another engine checks."""

from __future__ import annotations

from ..functions import index as ix
from ..operators.series import GAS_COLUMNS
from ..sources.adapters import AIR_SQL, WEATHER_SQL

_SUBS = ", ".join(f"{ix.sub_index_sql(k, k)} AS s_{k}" for k in GAS_COLUMNS)
_ALL = ", ".join(f"s_{k}" for k in GAS_COLUMNS)
_TIE = " ".join(f"WHEN abs(s_{k} - instant) < 1e-9 THEN '{k}'" for k in ix.TIE_ORDER if k in GAS_COLUMNS)
_MISSING = ", ".join(f"CASE WHEN s_{k} IS NULL THEN '{k}' END" for k in GAS_COLUMNS)
INDEX_SQL = f"""{AIR_SQL},
sub AS (SELECT *, {_SUBS} FROM air),
ins AS (SELECT *, greatest({_ALL}) AS instant FROM sub),
idx AS (SELECT *, CASE {_TIE} END AS dominant, concat_ws(',', {_MISSING}) AS missing, {ix.ordinal_sql('instant')} AS band_i FROM ins)"""

_FRAME = {k: f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {ix.AVERAGING_HOURS[k] - 1} PRECEDING AND CURRENT ROW)" for k in GAS_COLUMNS}
_MEANS = ", ".join(f"avg(CASE WHEN {k} >= 0 THEN {k} END) {_FRAME[k]} AS m_{k}, count(CASE WHEN {k} >= 0 THEN {k} END) {_FRAME[k]} AS n_{k}" for k in GAS_COLUMNS)
_TSUBS = ", ".join(f"CASE WHEN n_{k} >= 3 THEN {ix.sub_index_sql(k, f'm_{k}')} END AS ts_{k}" for k in GAS_COLUMNS)
_TALL = ", ".join(f"ts_{k}" for k in GAS_COLUMNS)
_HOURS = " ".join(f"WHEN abs(ts_{k} - trail) < 1e-9 THEN n_{k}" for k in ix.TIE_ORDER if k in GAS_COLUMNS)
TRAILING_SQL = f"""{INDEX_SQL},
tm AS (SELECT *, {_MEANS} FROM idx),
tsub AS (SELECT *, {_TSUBS} FROM tm),
tt AS (SELECT *, greatest({_TALL}) AS trail FROM tsub),
te AS (SELECT *, CASE {_HOURS} END AS trailing_hours, greatest(instant, trail) AS effective FROM tt),
tr AS (SELECT *, {ix.ordinal_sql('effective')} AS band_e FROM te)"""

#: Air hours with their weather, as the product joins them: hours without weather keep NULLs.
SLOTS_SQL = f"""{TRAILING_SQL},
{WEATHER_SQL},
slots AS (SELECT tr.*, temp_c, apparent_c, precip_mm, precip_prob, humidity, wind_kmh, weather_code, is_day, uv_index FROM tr LEFT JOIN wx USING (series, t))"""

#: Rows labelled with the instantaneous band six rows on, and the persistence forecast.
LABELLED_SQL = f"""{SLOTS_SQL},
fut AS (SELECT *, lead(band_i, 6) OVER (PARTITION BY series ORDER BY t) AS label, lead(instant, 6) OVER (PARTITION BY series ORDER BY t) AS target, lead(t, 6) OVER (PARTITION BY series ORDER BY t) AS target_t FROM slots),
lab AS (SELECT *, band_i AS pred FROM fut WHERE label IS NOT NULL AND band_i IS NOT NULL AND band_e IS NOT NULL),
ev AS (SELECT CAST(user_id % 4 AS INTEGER) AS series, date_trunc('hour', ts) AS t, count(*) AS n_events FROM events GROUP BY 1, 2),
pre AS (SELECT lab.*, (n_events % 101)::DOUBLE / 100.0::DOUBLE AS prob FROM lab JOIN ev USING (series, t))"""


def with_views(views: str, select: str) -> str:
    return f"WITH {views}\n{select}"
