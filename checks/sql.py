"""Checking queries: a chain of common table expressions per case, and the select on top of them."""

from __future__ import annotations

from checks.cases import Case

BINS = 10
EPS = "CAST(1e-6 AS DOUBLE)"


def r(expression: str) -> str:
    """Rounded as on the Spark side; adding zero turns -0.0 into 0.0."""
    return f"(round({expression}, 6) + CAST(0 AS DOUBLE))"


def chain(case: Case, select: str, extra: str = "") -> str:
    return f"WITH {', '.join(_tables(case))}{', ' + extra if extra else ''} {select}"


def long(features, source: str, as_type: str, name: str) -> str:
    if not features:
        return f"SELECT '' AS feature, CAST(NULL AS {as_type}) AS {name} WHERE false"
    return " UNION ALL ".join(
        f"SELECT '{x}' AS feature, CAST({x} AS {as_type}) AS {name} FROM {source}" for x in features
    )


def quantile_tables(source: str) -> list[str]:
    """ranked numbers, the quantiles q(feature, i, v), and the inner edges made of them."""
    return [
        f"""ranked AS (
            SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS rn,
                   count(*) OVER (PARTITION BY feature) AS n
            FROM {source} WHERE v IS NOT NULL AND NOT isnan(v))""",
        f"""q AS (
            SELECT feature, i, v FROM ranked JOIN range(0, {BINS + 1}) AS t(i)
            ON rn = greatest(1, (i * n + {BINS - 1}) // {BINS}))""",
        """placed AS (
            SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS k,
                   count(*) OVER (PARTITION BY feature) AS m
            FROM (SELECT DISTINCT feature, v FROM q))""",
        """inner_edges AS (
            SELECT feature, coalesce(list(v ORDER BY v) FILTER (WHERE k > 1 AND k < m), []) AS es
            FROM placed GROUP BY feature)""",
    ]


def binned(name: str, source: str) -> str:
    return f"""{name} AS (
        SELECT s.feature, s.v, CAST(CASE WHEN s.v IS NULL OR isnan(s.v) THEN -1
               ELSE len(list_filter(es, lambda x: x <= s.v)) END AS INTEGER) AS ord
        FROM {source} s JOIN inner_edges USING (feature))"""


def _tables(case: Case) -> list[str]:
    replaced = ", ".join(f"{sql} AS {name}" for name, sql in case.shifted.items())
    return [
        f"ref AS (SELECT * FROM {case.table} WHERE {case.reference})",
        f"cur AS (SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM {case.table} WHERE {case.current})",
        f"ref_numbers AS ({long(case.numeric, 'ref', 'DOUBLE', 'v')})",
        f"cur_numbers AS ({long(case.numeric, 'cur', 'DOUBLE', 'v')})",
        *quantile_tables("ref_numbers"),
        binned("ref_bins", "ref_numbers"),
        binned("cur_bins", "cur_numbers"),
        f"ref_values AS ({long(case.categorical, 'ref', 'VARCHAR', 'key')})",
        f"cur_values AS ({long(case.categorical, 'cur', 'VARCHAR', 'key')})",
        "ref_counts AS (SELECT feature, key, count(*) AS n FROM ref_values GROUP BY feature, key)",
        "cur_counts AS (SELECT feature, key, count(*) AS n FROM cur_values GROUP BY feature, key)",
        """ref_ranked AS (
            SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, key NULLS FIRST) AS position
            FROM ref_counts)""",
        f"known AS (SELECT feature, key, true AS listed FROM ref_ranked WHERE position <= {case.top_k})",
        *[
            f"""{side}_categories AS (
                SELECT c.feature,
                       CASE WHEN k.listed IS NULL THEN '__OTHER__' ELSE coalesce(c.key, '__MISSING__') END AS key,
                       CAST(sum(c.n) AS BIGINT) AS n
                FROM {side}_counts c LEFT JOIN known k
                ON c.feature = k.feature AND c.key IS NOT DISTINCT FROM k.key GROUP BY ALL)"""
            for side in ("ref", "cur")
        ],
        """cells AS (
            SELECT feature, 'numeric' AS feature_type, ord, CAST(ord AS VARCHAR) AS key, 1 AS n_ref, 0 AS n_cur
            FROM ref_bins
            UNION ALL SELECT feature, 'numeric', ord, CAST(ord AS VARCHAR), 0, 1 FROM cur_bins
            UNION ALL SELECT feature, 'categorical', NULL, key, n, 0 FROM ref_categories
            UNION ALL SELECT feature, 'categorical', NULL, key, 0, n FROM cur_categories)""",
        """paired AS (
            SELECT feature, feature_type, ord, key, CAST(sum(n_ref) AS BIGINT) AS n_ref,
                   CAST(sum(n_cur) AS BIGINT) AS n_cur
            FROM cells GROUP BY ALL)""",
        f"""floored AS (
            SELECT *, greatest(n_ref / sum(n_ref) OVER (PARTITION BY feature), {EPS}) AS f_ref,
                   greatest(n_cur / sum(n_cur) OVER (PARTITION BY feature), {EPS}) AS f_cur
            FROM paired)""",
        """scaled AS (
            SELECT *, f_ref / sum(f_ref) OVER (PARTITION BY feature) AS p,
                   f_cur / sum(f_cur) OVER (PARTITION BY feature) AS q
            FROM floored)""",
        """running AS (
            SELECT *, sum(p) OVER w - sum(q) OVER w AS gap FROM scaled
            WINDOW w AS (PARTITION BY feature ORDER BY ord, key ROWS UNBOUNDED PRECEDING))""",
        f"""refloored AS (SELECT *, greatest(p, {EPS}) AS pe, greatest(q, {EPS}) AS qe FROM running)""",
        """distances AS (
            SELECT feature, feature_type,
                   sum((qe - pe) * ln(qe / pe)) AS psi,
                   0.5 * sum(pe * ln(2 * pe / (pe + qe)) + qe * ln(2 * qe / (pe + qe))) AS js,
                   sqrt(0.5 * sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)))) AS hellinger,
                   max(abs(gap)) AS ks_approx,
                   sum((q - pe) * (q - pe) / pe) AS chi_square,
                   max(abs(q - p)) AS linf,
                   CASE WHEN feature_type = 'numeric' THEN 0
                        ELSE count(*) FILTER (WHERE n_ref = 0 AND n_cur > 0) / count(*) FILTER (WHERE n_cur > 0)
                   END AS new_category_share,
                   sum(CASE WHEN n_ref = 0 THEN n_cur ELSE 0 END) / sum(n_cur) AS new_category_row_share
            FROM refloored GROUP BY feature, feature_type)""",
        """nulls AS (
            SELECT feature, avg(CASE WHEN r THEN x END) AS missing_ref, avg(CASE WHEN NOT r THEN x END) AS missing_cur
            FROM (SELECT feature, true AS r, CAST(v IS NULL AS DOUBLE) AS x FROM ref_numbers
                  UNION ALL SELECT feature, false, CAST(v IS NULL AS DOUBLE) FROM cur_numbers
                  UNION ALL SELECT feature, true, CAST(key IS NULL AS DOUBLE) FROM ref_values
                  UNION ALL SELECT feature, false, CAST(key IS NULL AS DOUBLE) FROM cur_values)
            GROUP BY feature)""",
        f"""levels AS (
            SELECT *, {psi_level('psi')} AS psi_level, {bounded_level('js')} AS js_level,
                   {bounded_level('hellinger')} AS hellinger_level,
                   CASE WHEN feature_type = 'numeric' THEN {bounded_level('ks_approx')} ELSE 0 END AS ks_level
            FROM distances)""",
        """votes AS (
            SELECT *, list_sum(list_transform([psi_level, js_level, hellinger_level, ks_level],
                                              lambda x: CAST(x >= 3 AS INTEGER))) AS high_votes,
                   list_sum(list_transform([psi_level, js_level, hellinger_level, ks_level],
                                           lambda x: CAST(x >= 2 AS INTEGER))) AS medium_votes
            FROM levels)""",
        """agreed AS (
            SELECT *, CASE WHEN high_votes >= 2 THEN 3 WHEN medium_votes >= 2 THEN greatest(psi_level, 2)
                      ELSE psi_level END AS consensus_level FROM votes)""",
        """scored AS (
            SELECT *, CAST(CASE WHEN new_category_share >= 0.2 THEN 4
                                WHEN new_category_share >= 0.1 THEN greatest(consensus_level, 3)
                                ELSE consensus_level END AS INTEGER) AS severity_score
            FROM agreed)""",
        """reported AS (
            SELECT feature AS feature_name, s.* EXCLUDE (feature), missing_ref, missing_cur,
                   missing_cur - missing_ref AS missing_delta,
                   ['none', 'low', 'medium', 'high', 'critical'][severity_score + 1] AS severity,
                   CAST(severity_score AS DOUBLE) * (1 + medium_votes / 4) AS rank_score
            FROM scored s JOIN nulls USING (feature))""",
        """ordered AS (
            SELECT *, CAST(row_number() OVER (ORDER BY severity_score DESC, rank_score DESC, feature_name)
                           AS INTEGER) AS rank,
                   CASE severity WHEN 'critical' THEN 'act_now' WHEN 'high' THEN 'find_cause'
                        WHEN 'medium' THEN 'monitor' WHEN 'low' THEN 'keep_history'
                        ELSE CASE WHEN abs(missing_delta) > 0.05 THEN 'check_missing'
                                  WHEN new_category_share > 0 THEN 'check_new_categories'
                                  ELSE 'nothing' END END AS advice
            FROM reported)""",
    ]


def psi_level(x: str) -> str:
    return f"CASE WHEN {x} >= 0.25 THEN 3 WHEN {x} >= 0.1 THEN 2 ELSE 0 END"


def bounded_level(x: str) -> str:
    return f"CASE WHEN {x} >= 0.2 THEN 3 WHEN {x} >= 0.1 THEN 2 WHEN {x} >= 0.05 THEN 1 ELSE 0 END"


FEATURE_METRICS = f"""
    SELECT feature_name, feature_type, 'psi' AS primary_metric, {r('psi')} AS primary_value, {r('psi')} AS psi,
           {r('js')} AS js, {r('hellinger')} AS hellinger,
           CASE WHEN feature_type = 'numeric' THEN {r('ks_approx')} END AS ks_approx,
           CASE WHEN feature_type = 'categorical' THEN {r('chi_square')} END AS chi_square,
           severity, severity_score, severity_score > 0 AS drift_detected, {r('rank_score')} AS rank_score,
           {r('missing_ref')} AS missing_ref, {r('missing_cur')} AS missing_cur, {r('missing_delta')} AS missing_delta,
           {r('new_category_share')} AS new_category_share, advice, rank
    FROM ordered"""

DATASET_SUMMARY = f"""
    SELECT *, CASE WHEN high_or_critical_features > 0 THEN 'high' WHEN dataset_drift THEN 'medium'
                   WHEN drift_share > 0 THEN 'low' ELSE 'none' END AS dataset_severity
    FROM (SELECT *, drift_share >= 0.3 AS dataset_drift
          FROM (SELECT count(*) AS total_features, count(*) FILTER (WHERE severity_score > 0) AS drifted_features,
                       count(*) FILTER (WHERE severity_score >= 3) AS high_or_critical_features,
                       {r('avg(CAST(severity_score > 0 AS DOUBLE))')} AS drift_share FROM ordered))"""
