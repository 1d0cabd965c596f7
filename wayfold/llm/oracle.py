"""Plain SQL that must give the rows of the queries, for another engine."""

_PER_MILLE = (10, 50, 250, 500, 750, 950, 990)


def _percentiles(group: str, names: str) -> str:
    picks = ", ".join(
        f"min(v) FILTER (cum >= greatest(1, (total * {p} + 999) // 1000)) AS p{p // 10:02d}" for p in _PER_MILLE
    )
    return f"""
WITH r AS (SELECT DISTINCT obs_id, category, node_idx, obs_date, "values" + 0.0 AS v FROM initialize_acc_var
           WHERE "values" IS NOT NULL AND NOT isnan("values")),
c AS (SELECT {group}, v, count(*) AS n FROM r GROUP BY ALL),
k AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {names} ORDER BY v) AS BIGINT) AS cum,
             CAST(sum(n) OVER (PARTITION BY {names}) AS BIGINT) AS total FROM c)
SELECT {names}, max(total) AS values_n, {picks} FROM k GROUP BY {names}"""


_TERMS = """
WITH r AS (SELECT id, any_value(tags) AS tags FROM nodes WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT id, unnest(map_entries(tags)) AS e FROM r),
p AS (SELECT id, lower(trim(e.key)) AS k, lower(trim(unnest(string_split(e.value, ';')))) AS v FROM e),
t AS (SELECT k || '=' || v AS term, count(*) AS occurrences, count(DISTINCT id) AS records FROM p WHERE v <> '' GROUP BY 1),
m AS (SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.2 * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM t)
"""

ORACLE_SQL = {
    "p1_category_node": _percentiles("category, node_idx", "category, node_idx"),
    "p1_category_day": _percentiles("category, obs_date", "category, obs_date"),
    "p1_category": _percentiles("category", "category"),
    "p1_category_sliced": _percentiles("category", "category"),
    "p1_category_rounded": """
SELECT category, count(*) AS values_n, true AS within
FROM (SELECT DISTINCT obs_id, category, node_idx, obs_date, "values" FROM initialize_acc_var WHERE "values" IS NOT NULL AND NOT isnan("values")) GROUP BY category""",
    "p6_checks": """
SELECT pack_name AS pack, (SELECT count(*) FROM documents WHERE text <> '') AS items, 0 AS repeated, 0 AS overfull, 0 AS miscut, false AS wasteful FROM pack_sizes""",
    "p7_checks": "SELECT source, true AS within_repeats, true AS on_budget, true AS share_or_all FROM mix_targets",
    "p1_month_from_days": _percentiles("category, CAST(date_trunc('month', obs_date) AS DATE) AS month", "category, month"),
    "p4_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": _TERMS + "SELECT term, occurrences, records, mark FROM m",
    "p5_found": """
WITH b AS (
  SELECT node_idx, lower(trim(category)) AS category, poi_id, max(num_of_pois) AS n, min(distance) AS d
  FROM find_all_nearest_pois WHERE distance IS NOT NULL AND NOT isnan(distance) AND distance >= 0 GROUP BY ALL
), o AS (SELECT *, row_number() OVER (PARTITION BY node_idx, category ORDER BY d, poi_id) AS k FROM b)
SELECT node_idx, category, poi_id FROM o WHERE k <= n""",
}
