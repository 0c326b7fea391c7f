"""SQL that states each registered query independently, for comparison in DuckDB."""

from __future__ import annotations

import re

SEGMENT_VALUES = ", ".join(
    f"({rank}, '{name}')"
    for rank, name in enumerate(
        ["Champions", "Loyal Customers", "Potential Loyalists", "At Risk", "Lost / Churned"], 1
    )
)
FILTER = (
    "segment IN ('Champions', 'Loyal Customers', 'At Risk') AND rfm_score BETWEEN 6 AND 12 "
    "AND monetary BETWEEN 100000 AND 900000"
)

# Named steps, each using only earlier ones.
STEPS = {
    "tx": """
        SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR)
                 AS invoice_no,
               o_orderdate AS invoice_ts,
               CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               CAST(CASE WHEN l_linenumber = 7 AND l_quantity < 5 THEN -l_quantity
                         ELSE l_quantity END AS INTEGER) AS quantity,
               CASE WHEN l_linenumber = 6 AND l_quantity < 5 THEN CAST(0 AS DECIMAL(18, 2))
                    ELSE CAST(p_retailprice AS DECIMAL(18, 2)) END AS unit_price
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "clean": """
        SELECT *, CAST(quantity * unit_price AS DECIMAL(18, 2)) AS revenue
        FROM tx
        WHERE customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0
          AND substr(coalesce(invoice_no, ''), 1, 1) NOT IN ('C', 'D', 'M', 'S')""",
    "base": """
        SELECT customer_id,
               date_sub('day', max(invoice_ts),
                        (SELECT max(invoice_ts) + INTERVAL 1 DAY FROM clean)) AS recency,
               count(DISTINCT invoice_no) AS frequency,
               CAST(sum(revenue) AS DOUBLE) AS monetary
        FROM clean GROUP BY customer_id""",
    "ranks": """
        SELECT customer_id,
               row_number() OVER (ORDER BY recency, customer_id) AS recency_rank,
               row_number() OVER (ORDER BY frequency, customer_id) AS frequency_rank,
               row_number() OVER (ORDER BY monetary, customer_id) AS monetary_rank
        FROM base""",
    "scored": """
        SELECT *, r_score + f_score + m_score AS rfm_score
        FROM (SELECT base.*,
                     CAST(6 - greatest(1, ceil(5.0 * (recency_rank - 1) / (n - 1))) AS INTEGER)
                       AS r_score,
                     CAST(greatest(1, ceil(5.0 * (frequency_rank - 1) / (n - 1))) AS INTEGER)
                       AS f_score,
                     CAST(greatest(1, ceil(5.0 * (monetary_rank - 1) / (n - 1))) AS INTEGER)
                       AS m_score
              FROM base JOIN ranks USING (customer_id),
                   (SELECT count(*) AS n FROM base))""",
    "caps": """
        SELECT quantile_cont(CAST(recency AS DOUBLE), 0.99) AS recency_cap,
               quantile_cont(CAST(frequency AS DOUBLE), 0.99) AS frequency_cap,
               quantile_cont(monetary, 0.99) AS monetary_cap
        FROM base""",
    "capped": """
        SELECT customer_id,
               least(CAST(recency AS DOUBLE), recency_cap) AS recency_capped,
               least(CAST(frequency AS DOUBLE), frequency_cap) AS frequency_capped,
               least(monetary, monetary_cap) AS monetary_capped
        FROM base, caps""",
    "feat": """
        SELECT customer_id,
               (recency_capped - rm) / rs AS z_recency,
               (frequency_capped - fm) / fs AS z_frequency,
               (monetary_capped - mm) / ms AS z_monetary
        FROM capped,
             (SELECT avg(recency_capped) AS rm, stddev_pop(recency_capped) AS rs,
                     avg(frequency_capped) AS fm, stddev_pop(frequency_capped) AS fs,
                     avg(monetary_capped) AS mm, stddev_pop(monetary_capped) AS ms
              FROM capped)""",
    "centers": """
        SELECT * FROM (VALUES (0, -0.6, 1.5, 1.5), (1, -0.4, 0.5, 0.5), (2, 0.0, -0.1, -0.1),
                              (3, 0.3, -0.9, -0.9), (4, 2.4, -1.2, -1.2)) AS v(cluster, cr, cf, cm)""",
    "assigned": """
        SELECT customer_id, cluster, dist2
        FROM (SELECT customer_id, cluster,
                     pow(z_recency - cr, 2) + pow(z_frequency - cf, 2) + pow(z_monetary - cm, 2)
                       AS dist2
              FROM feat, centers)
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY dist2, cluster) = 1""",
    "ranking": """
        SELECT cluster, med_rfm, med_monetary,
               CAST(row_number() OVER (ORDER BY med_rfm DESC, med_monetary DESC, cluster) AS INTEGER)
                 AS rank
        FROM (SELECT cluster, median(rfm_score) AS med_rfm, median(monetary) AS med_monetary
              FROM scored JOIN assigned USING (customer_id) GROUP BY cluster)""",
    "lab": f"""
        SELECT scored.*, cluster, segment
        FROM scored JOIN assigned USING (customer_id) JOIN ranking USING (cluster)
             LEFT JOIN (VALUES {SEGMENT_VALUES}) AS names(rank, segment) USING (rank)""",
    "summary": """
        SELECT *, round_even(total_revenue * 1000
                             / CAST(sum(CAST(total_revenue AS DECIMAL(20, 1))) OVER () AS DOUBLE),
                             0) / 10 AS revenue_pct
        FROM (SELECT segment, count(*) AS customers,
                     round_even(avg(recency) * 10, 0) / 10 AS avg_recency,
                     round_even(avg(frequency) * 10, 0) / 10 AS avg_frequency,
                     round_even(CAST(sum(CAST(monetary AS DECIMAL(18, 2))) AS DOUBLE)
                                / count(*) * 10, 0) / 10 AS avg_monetary,
                     round_even(CAST(sum(CAST(monetary AS DECIMAL(18, 2))) AS DOUBLE) * 10, 0) / 10
                       AS total_revenue
              FROM lab GROUP BY segment)""",
}


def earlier(last: str) -> str:
    """All steps up to ``last`` over sales before 2000, as further steps with names in ``_early``."""
    names = list(STEPS)[: list(STEPS).index(last) + 1]
    pattern = r"\b(" + "|".join(n for n in names if n != "centers") + r")\b"
    texts = {n: STEPS[n] for n in names if n != "centers"}
    texts["tx"] = "SELECT * FROM whole WHERE invoice_ts < TIMESTAMP '2000-01-01'"
    steps = [f"{n}_early AS ({re.sub(pattern, lambda m: m[0] + '_early', t)})" for n, t in texts.items()]
    return ", " + ",\n".join(steps).replace("FROM whole", "FROM tx")


def sql(last: str, query: str) -> str:
    """``query`` preceded by all steps up to ``last``."""
    names = list(STEPS)
    needed = names[: names.index(last) + 1]
    steps = ",\n".join(f"{name} AS ({STEPS[name]})" for name in needed)
    return f"WITH {steps}\n{query}"


def six(expression: str) -> str:
    return f"round_even(({expression}) * 1000000, 0) / 1000000"


def long_form(columns: str, table: str, where: str = "TRUE") -> str:
    parts = [
        f"SELECT {columns}, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM {table} WHERE {where}"
        for m in ("recency", "frequency", "monetary")
    ]
    return " UNION ALL ".join(parts)


def box(group: str, long: str, extra: str = "") -> str:
    return f"""
        SELECT {group}, metric, {six('q1')} AS q1, {six('median')} AS median, {six('q3')} AS q3,
               {six('''coalesce(least(q1, min(value)
                      FILTER (value >= q1 - 1.5 * (q3 - q1))), q1)''')} AS whisker_lo,
               {six('''coalesce(greatest(q3, max(value)
                      FILTER (value <= q3 + 1.5 * (q3 - q1))), q3)''')} AS whisker_hi,
               count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
                 AS n_outliers{extra}
        FROM ({long}) JOIN
             (SELECT {group}, metric, quantile_cont(value, 0.25) AS q1,
                     quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
              FROM ({long}) GROUP BY ALL) USING ({group}, metric)
        GROUP BY {group}, metric, q1, median, q3"""


BAND_R = """CASE WHEN recency > 270 THEN '271+' WHEN recency > 210 THEN '211-270'
            WHEN recency > 150 THEN '151-210' WHEN recency > 90 THEN '91-150'
            WHEN recency > 30 THEN '31-90' WHEN recency > 0 THEN '0-30' END"""
BAND_M = """CASE WHEN monetary > 1000000 THEN '1M+' WHEN monetary > 600000 THEN '600k-1M'
            WHEN monetary > 400000 THEN '400k-600k' WHEN monetary > 200000 THEN '200k-400k'
            WHEN monetary > 0 THEN '0-200k' END"""
SCORED = "customer_id, recency, frequency, monetary, r_score, f_score, m_score, rfm_score"
# Training from given centres: the same for each cluster count, of which k takes the first k.
SWEEP_STARTS = (
    (-0.6, 1.5, 1.5),
    (2.4, -1.2, -1.2),
    (0.0, -0.1, -0.1),
    (-0.4, 0.5, 0.5),
    (0.3, -0.9, -0.9),
    (1.2, -0.6, -0.6),
    (-0.7, 0.9, 0.2),
    (-0.5, 0.2, 0.9),
)
PASSES = 4
PLAYS = "segment, customers, priority, action_no, action, target"


# A playbook to test with: uneven numbers of actions, one segment without any, one not listed.
TEST_PLAYBOOK = (
    ("Champions", "p1", ["action a", "action b", "action c"], "t1"),
    ("Loyal Customers", "p2", ["action d"], "t2"),
    ("Potential Loyalists", "p3", [], "t3"),
    ("Lost / Churned", "p4", ["action e", "action f"], "t4"),
)


def playbook_values() -> str:
    return ", ".join(
        f"('{name}', '{priority}', {number}, '{action}', '{target}')"
        for name, priority, actions, target in TEST_PLAYBOOK
        for number, action in enumerate(actions, 1)
    )


def lloyd(ks: range | tuple[int, ...]) -> str:
    """Steps of ``PASSES`` passes for each k, ending in ``found``: (k, customer_id, cluster, dist2)."""
    starts = ", ".join(
        f"({k}, {i}, {r}, {f}, {m})"
        for k in ks
        for i, (r, f, m) in enumerate(SWEEP_STARTS[:k])
    )
    steps = [f"centers0 AS (SELECT * FROM (VALUES {starts}) AS v(k, cluster, cr, cf, cm))"]
    for turn in range(PASSES + 1):
        name = "found" if turn == PASSES else f"near{turn}"
        steps.append(
            f"""{name} AS MATERIALIZED (
            SELECT k, customer_id, cluster, z_recency, z_frequency, z_monetary,
                   pow(z_recency - cr, 2) + pow(z_frequency - cf, 2) + pow(z_monetary - cm, 2)
                     AS dist2
            FROM feat, centers{turn}
            QUALIFY row_number() OVER (PARTITION BY k, customer_id ORDER BY dist2, cluster) = 1)"""
        )
        if turn < PASSES:
            steps.append(
                f"""centers{turn + 1} AS MATERIALIZED (
                SELECT k, cluster, avg(z_recency) AS cr, avg(z_frequency) AS cf,
                       avg(z_monetary) AS cm
                FROM near{turn} GROUP BY k, cluster)"""
            )
    return ", " + ",\n".join(steps)


def all_checks() -> dict[str, str]:
    return {
        "clean_transactions": sql(
            "clean",
            """SELECT invoice_no, CAST(invoice_ts AS VARCHAR) AS invoice_ts, customer_id, quantity,
                      CAST(unit_price AS DOUBLE) AS unit_price, CAST(revenue AS DOUBLE) AS revenue
               FROM clean""",
        ),
        "load_stats": sql(
            "clean",
            "SELECT count(*) AS n_records, count(DISTINCT customer_id) AS n_customers FROM clean",
        ),
        "rfm_base": sql("base", "SELECT * FROM base"),
        "rfm_base_events": """
            WITH sales AS (SELECT * FROM events WHERE event_type = 'purchase'
                           AND user_id IS NOT NULL AND CAST(value AS DECIMAL(18, 2)) > 0)
            SELECT user_id AS customer_id,
                   date_sub('day', max(ts), (SELECT max(ts) + INTERVAL 1 DAY FROM sales)) AS recency,
                   count(DISTINCT event_id) AS frequency,
                   CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS monetary
            FROM sales GROUP BY user_id""",
        "rfm_ranks": sql("ranks", "SELECT * FROM ranks"),
        "rfm_scores": sql("scored", f"SELECT {SCORED} FROM scored"),
        "score_range": sql(
            "scored",
            "SELECT min(rfm_score) AS min_score, max(rfm_score) AS max_score FROM scored",
        ),
        "outlier_caps": sql(
            "caps",
            f"""SELECT {six('recency_cap')} AS recency_cap, {six('frequency_cap')} AS frequency_cap,
                       {six('monetary_cap')} AS monetary_cap FROM caps""",
        ),
        "capped_features": sql(
            "capped",
            f"""SELECT customer_id, {six('recency_capped')} AS recency_capped,
                       {six('frequency_capped')} AS frequency_capped,
                       {six('monetary_capped')} AS monetary_capped FROM capped""",
        ),
        "scaled_features": sql(
            "feat",
            f"""SELECT customer_id, {six('z_recency')} AS z_recency,
                       {six('z_frequency')} AS z_frequency, {six('z_monetary')} AS z_monetary
                FROM feat""",
        ),
        "assign_centroid": sql(
            "assigned", f"SELECT customer_id, cluster, {six('dist2')} AS dist2 FROM assigned"
        ),
        "inertia_fixed": sql("assigned", f"SELECT {six('sum(dist2)')} AS inertia FROM assigned"),
        "kmeans_segments": sql("feat", f"{lloyd((5,))} SELECT customer_id, cluster FROM found"),
        "k_sweep": sql(
            "feat",
            f"""
            {lloyd(range(2, 9))},
            pts AS (
                SELECT *, pow(z_recency, 2) + pow(z_frequency, 2) + pow(z_monetary, 2) AS norm
                FROM found),
            tot AS (
                SELECT k, cluster AS other, count(*) AS n, sum(z_recency) AS sx,
                       sum(z_frequency) AS sy, sum(z_monetary) AS sz, sum(norm) AS sn
                FROM pts GROUP BY k, cluster),
            sums AS (
                SELECT k, customer_id, dist2, cluster AS own, other, n,
                       n * norm - 2 * (z_recency * sx + z_frequency * sy + z_monetary * sz) + sn
                         AS total
                FROM pts JOIN tot USING (k)),
            gaps AS (
                SELECT k, customer_id, any_value(dist2) AS dist2,
                       max(n) FILTER (own = other) AS size,
                       max(total / (n - 1)) FILTER (own = other AND n > 1) AS inner_mean,
                       min(total / n) FILTER (own <> other) AS outer_mean
                FROM sums GROUP BY k, customer_id)
            SELECT k, {six('sum(dist2)')} AS inertia,
                   {six('''avg(CASE WHEN size = 1 THEN 0 ELSE (outer_mean - inner_mean)
                     / greatest(outer_mean, inner_mean) END)''')} AS silhouette,
                   'squared_euclidean' AS measure
            FROM gaps GROUP BY k""",
        ),
        "silhouette_exact": sql(
            "assigned",
            f"""
            , sums AS (
                SELECT a.customer_id, p.cluster AS own, q.cluster AS other, count(*) AS n,
                       sum(sqrt(pow(a.z_recency - b.z_recency, 2)
                                + pow(a.z_frequency - b.z_frequency, 2)
                                + pow(a.z_monetary - b.z_monetary, 2))) AS total
                FROM feat a JOIN assigned p ON a.customer_id = p.customer_id,
                     feat b JOIN assigned q ON b.customer_id = q.customer_id
                GROUP BY ALL),
            gaps AS (
                SELECT customer_id, max(n) FILTER (own = other) AS size,
                       max(total / (n - 1)) FILTER (own = other AND n > 1) AS inner_mean,
                       min(total / n) FILTER (own <> other) AS outer_mean
                FROM sums GROUP BY customer_id)
            SELECT {six('''avg(CASE WHEN size = 1 THEN 0 ELSE (outer_mean - inner_mean)
                     / greatest(outer_mean, inner_mean) END)''')} AS silhouette,
                   'euclidean' AS measure
            FROM gaps""",
        ),
        "silhouette_sampled": sql(
            "assigned",
            f"""
            , sums AS (
                SELECT a.customer_id, p.cluster AS own, q.cluster AS other, count(*) AS n,
                       sum(sqrt(pow(a.z_recency - b.z_recency, 2)
                                + pow(a.z_frequency - b.z_frequency, 2)
                                + pow(a.z_monetary - b.z_monetary, 2))) AS total
                FROM feat a JOIN assigned p ON a.customer_id = p.customer_id,
                     feat b JOIN assigned q ON b.customer_id = q.customer_id
                WHERE a.customer_id % 10 = 0
                GROUP BY ALL),
            gaps AS (
                SELECT customer_id, max(n) FILTER (own = other) AS size,
                       max(total / (n - 1)) FILTER (own = other AND n > 1) AS inner_mean,
                       min(total / n) FILTER (own <> other) AS outer_mean
                FROM sums GROUP BY customer_id),
            gains AS (
                SELECT CASE WHEN size = 1 THEN 0 ELSE (outer_mean - inner_mean)
                         / greatest(outer_mean, inner_mean) END AS gain FROM gaps)
            SELECT {six('avg(gain)')} AS silhouette,
                   {six('stddev_samp(gain) / sqrt(count(*))')} AS std_error, count(*) AS sampled
            FROM gains""",
        ),
        "silhouette_squared": sql(
            "assigned",
            f"""
            , pts AS (
                SELECT customer_id, cluster, z_recency AS x, z_frequency AS y, z_monetary AS z,
                       pow(z_recency, 2) + pow(z_frequency, 2) + pow(z_monetary, 2) AS norm
                FROM feat JOIN assigned USING (customer_id)),
            tot AS (
                SELECT cluster AS other, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz,
                       sum(norm) AS sn FROM pts GROUP BY cluster),
            sums AS (
                SELECT customer_id, cluster AS own, other, n,
                       n * norm - 2 * (x * sx + y * sy + z * sz) + sn AS total FROM pts, tot),
            gaps AS (
                SELECT customer_id, max(n) FILTER (own = other) AS size,
                       max(total / (n - 1)) FILTER (own = other AND n > 1) AS inner_mean,
                       min(total / n) FILTER (own <> other) AS outer_mean
                FROM sums GROUP BY customer_id)
            SELECT {six('''avg(CASE WHEN size = 1 THEN 0 ELSE (outer_mean - inner_mean)
                     / greatest(outer_mean, inner_mean) END)''')} AS silhouette,
                   'squared_euclidean' AS measure
            FROM gaps""",
        ),
        "cluster_ranking": sql("ranking", "SELECT * FROM ranking"),
        "segment_labels": sql("lab", f"SELECT {SCORED}, cluster, segment FROM lab"),
        "empty_segments": sql(
            "centers",
            f"""SELECT segment FROM (VALUES {SEGMENT_VALUES}) AS names(rank, segment)
                WHERE rank > (
                  SELECT count(DISTINCT nearest) FROM (
                    SELECT arg_min(cluster, (pow(z_recency - cr, 2) + pow(z_frequency - cf, 2)
                                             + pow(z_monetary - cm, 2), cluster)) AS nearest
                    FROM feat, centers WHERE cluster < 3 GROUP BY customer_id))""",
        ),
        "cluster_segment_mean": sql(
            "lab",
            """SELECT cluster, segment, round_even(avg(rfm_score) * 10, 0) / 10 AS avg_rfm_score
               FROM lab GROUP BY cluster, segment""",
        ),
        "segment_counts": sql(
            "lab", "SELECT segment, count(*) AS customers FROM lab GROUP BY segment"
        ),
        "segment_summary": sql("summary", "SELECT * FROM summary"),
        "segment_share": sql(
            "summary",
            """SELECT segment, customers,
                      round_even(customers / CAST(sum(customers) OVER () AS DOUBLE) * 1000, 0) / 10
                        AS customer_pct,
                      total_revenue,
                      round_even(total_revenue / CAST(sum(CAST(total_revenue AS DECIMAL(20, 1)))
                                 OVER () AS DOUBLE) * 1000, 0) / 10 AS revenue_pct_selected
               FROM summary WHERE segment IN ('Champions', 'Loyal Customers', 'At Risk')""",
        ),
        "segment_kpis": sql("summary", "SELECT * FROM summary WHERE segment = 'At Risk'"),
        "filter_bounds": sql(
            "lab",
            """SELECT min(rfm_score) AS score_min, max(rfm_score) AS score_max,
                      CAST(trunc(max(monetary)) AS BIGINT) AS monetary_max_int FROM lab""",
        ),
        "filtered_customers": sql(
            "lab", f"SELECT {SCORED}, cluster, segment FROM lab WHERE {FILTER}"
        ),
        "portfolio_kpis": sql(
            "lab",
            f"""SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS customers,
                       CAST(sum(CAST(monetary AS DECIMAL(18, 2))) AS DOUBLE) AS total_revenue,
                       {six('avg(monetary)')} AS avg_monetary, {six('avg(recency)')} AS avg_recency,
                       {six('avg(frequency)')} AS avg_frequency
                FROM lab WHERE {FILTER}""",
        ),
        "rfm_heatmap": sql(
            "lab",
            f"""SELECT monetary_band, recency_band, coalesce(customers, 0) AS customers
                FROM (SELECT unnest(['0-200k', '200k-400k', '400k-600k', '600k-1M', '1M+'])
                        AS monetary_band)
                CROSS JOIN (SELECT unnest(['0-30', '31-90', '91-150', '151-210', '211-270', '271+'])
                        AS recency_band)
                LEFT JOIN (SELECT {BAND_M} AS monetary_band, {BAND_R} AS recency_band,
                                  count(*) AS customers
                           FROM lab WHERE {FILTER} GROUP BY ALL)
                  USING (monetary_band, recency_band)""",
        ),
        "score_histogram": sql(
            "lab",
            f"""SELECT segment, rfm_score, count(*) AS customers FROM lab WHERE {FILTER}
                GROUP BY segment, rfm_score""",
        ),
        "segment_box_stats": sql("lab", box("segment", long_form("segment", "lab"))),
        "segment_vs_portfolio": sql(
            "lab",
            box(
                "grp",
                long_form("'All Customers' AS grp", "lab")
                + " UNION ALL "
                + long_form("segment AS grp", "lab", f"segment = 'At Risk' AND {FILTER}"),
                f", {six('avg(value)')} AS mean",
            ),
        ),
        "segment_radar": sql(
            "lab",
            f"""SELECT segment,
                       {six('avg(1 - (recency - rl) / (rh - rl))')} AS recency_inv,
                       {six('avg((frequency - fl) / (fh - fl))')} AS frequency,
                       {six('avg((monetary - ml) / (mh - ml))')} AS monetary
                FROM lab,
                     (SELECT min(recency) AS rl, max(recency) AS rh, min(frequency) AS fl,
                             max(frequency) AS fh, min(monetary) AS ml, max(monetary) AS mh
                      FROM lab)
                GROUP BY segment""",
        ),
        "scatter_points": sql("lab", "SELECT customer_id, segment, recency, monetary FROM lab"),
        "customer_profile": sql(
            "lab",
            """SELECT customer_id, segment, recency, frequency, monetary, rfm_score,
                      'R' || r_score || ' F' || f_score || ' M' || m_score AS profile
               FROM lab WHERE customer_id = 101""",
        ),
        "explorer_table": sql(
            "lab",
            f"""SELECT customer_id AS "Customer ID", segment AS "Segment", recency AS "Recency",
                       frequency AS "Frequency", round_even(monetary * 100, 0) / 100 AS "Monetary",
                       r_score AS "R", f_score AS "F", m_score AS "M", rfm_score AS "RFM Score"
                FROM lab WHERE {FILTER}
                ORDER BY monetary DESC, customer_id""",
        ),
        "segment_playbook": sql(
            "lab",
            f"""SELECT {PLAYS}
                FROM (SELECT segment, count(*) AS customers FROM lab GROUP BY segment)
                JOIN (VALUES {playbook_values()})
                     AS plays(segment, priority, action_no, action, target) USING (segment)""",
        ),
        "scored_roundtrip": sql("lab", f"SELECT {SCORED}, cluster, segment FROM lab"),
        "summary_roundtrip": sql("summary", "SELECT * FROM summary"),
        "explorer_export": sql(
            "lab",
            f"""SELECT customer_id AS "Customer ID", segment AS "Segment", recency AS "Recency",
                       frequency AS "Frequency", round_even(monetary * 100, 0) / 100 AS "Monetary",
                       r_score AS "R", f_score AS "F", m_score AS "M", rfm_score AS "RFM Score"
                FROM lab WHERE {FILTER}""",
        ),
        "rfm_incremental": sql("base", "SELECT * FROM base"),
        "transactions_between": sql(
            "tx",
            """SELECT invoice_no, CAST(invoice_ts AS VARCHAR) AS invoice_ts, customer_id, quantity,
                      CAST(unit_price AS DOUBLE) AS unit_price
               FROM tx WHERE invoice_ts >= TIMESTAMP '1997-03-09'
                 AND invoice_ts < TIMESTAMP '1998-02-17'""",
        ),
        "brand_scores": """
            WITH sales AS (
                SELECT p_brand AS brand, o_custkey AS customer_id, o_orderkey AS invoice_no,
                       o_orderdate AS sold,
                       CAST(l_quantity AS INTEGER) * CAST(p_retailprice AS DECIMAL(18, 2)) AS revenue
                FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                     JOIN part ON l_partkey = p_partkey
                WHERE l_returnflag <> 'R' AND o_custkey % 97 <> 0 AND p_retailprice > 0
                  AND l_quantity > 0 AND NOT (l_linenumber IN (6, 7) AND l_quantity < 5)),
            sums AS (
                SELECT brand, customer_id,
                       date_sub('day', max(sold), (SELECT max(sold) + INTERVAL 1 DAY FROM sales))
                         AS recency,
                       count(DISTINCT invoice_no) AS frequency,
                       round(CAST(sum(revenue) AS DOUBLE), 2) AS monetary
                FROM sales GROUP BY brand, customer_id),
            placed AS (
                SELECT *, count(*) OVER (PARTITION BY brand) - 1 AS last,
                       row_number() OVER (PARTITION BY brand ORDER BY recency, customer_id) - 1
                         AS r,
                       row_number() OVER (PARTITION BY brand ORDER BY frequency, customer_id) - 1
                         AS f,
                       row_number() OVER (PARTITION BY brand ORDER BY monetary, customer_id) - 1
                         AS m
                FROM sums),
            edged AS (
                SELECT brand, customer_id, recency, frequency, monetary,
                       CAST(6 - greatest(1, ceil(5.0 * r / last)) AS INTEGER) AS r_score,
                       CAST(greatest(1, ceil(5.0 * f / last)) AS INTEGER) AS f_score,
                       CAST(greatest(1, ceil(5.0 * m / last)) AS INTEGER) AS m_score
                FROM placed)
            SELECT *, r_score + f_score + m_score AS rfm_score FROM edged""",
        "segment_migration": sql(
            "lab",
            f"""{earlier("lab")}
            SELECT from_segment, to_segment, count(*) AS customers,
                   round_even(count(*) * 1000.0 / sum(count(*)) OVER (PARTITION BY from_segment), 0)
                     / 10 AS pct_of_from
            FROM (SELECT CASE WHEN a.customer_id IS NULL THEN 'entered' ELSE a.segment END
                           AS from_segment,
                         CASE WHEN b.customer_id IS NULL THEN 'left' ELSE b.segment END
                           AS to_segment
                  FROM lab_early a FULL JOIN lab b ON a.customer_id = b.customer_id)
            GROUP BY from_segment, to_segment""",
        ),
        "segment_drift": sql(
            "lab",
            f"""{earlier("lab")},
            cells AS (
                SELECT segment,
                       (SELECT count(*) FROM lab_early l WHERE l.segment = names.segment) AS nb,
                       (SELECT count(*) FROM lab l WHERE l.segment = names.segment) AS na
                FROM (VALUES {SEGMENT_VALUES}) AS names(rank, segment)),
            shares AS (
                SELECT *, nb / sum(nb) OVER () AS sb, na / sum(na) OVER () AS sa,
                       greatest(nb, 0.5) / sum(nb) OVER () AS p,
                       greatest(na, 0.5) / sum(na) OVER () AS q FROM cells),
            terms AS (SELECT *, (q - p) * ln(q / p) AS term FROM shares)
            SELECT segment, nb AS n_before, na AS n_after, {six("sb")} AS share_before,
                   {six("sa")} AS share_after, {six("sa - sb")} AS change, {six("term")} AS psi,
                   {six("sum(term) OVER ()")} AS psi_total, sum(term) OVER () >= 0.2 AS shifted
            FROM terms""",
        ),
    }
