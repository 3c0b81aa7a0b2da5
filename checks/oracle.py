"""The oracle SQL, one text per registered query."""

from __future__ import annotations

from checks.tables import with_tables

# Money columns of the models: exact decimals inside, doubles in every result.
_MONEY = {
    "stg_order_items": ["price", "freight_value", "total_item_value"],
    "stg_order_payments": ["total_payment_value"],
    "int_orders_enriched": ["total_payment_value"],
    "int_customer_orders": ["total_spent"],
    "fct_orders": ["total_payment_value", "items_revenue", "total_freight"],
    "fct_order_items": ["price", "freight_value", "total_item_value"],
    "dim_customers": ["monetary"],
    "seller_performance": ["total_revenue", "total_freight_collected"],
    "repeat_training": ["monetary"],
    "repeat_training_dated": ["monetary"],
}


def _table(name: str) -> str:
    money = _MONEY.get(name, [])
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in money)
    columns = f"* REPLACE ({casts})" if money else "*"
    return with_tables(f"SELECT {columns} FROM {name}", name)


def _histogram(source: str, value: str, bins: int, reads: tuple[str, ...], cap: float | None = None) -> str:
    limit = f" AND v <= {cap}" if cap is not None else ""
    above = "" if cap is None else f"""
        UNION ALL SELECT {bins}, CAST({cap} AS DOUBLE), max(v), count(*)
        FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source}) WHERE v > {cap}"""
    return with_tables(
        f"""SELECT CAST(g.bin AS INTEGER) AS bin, s.lo + g.bin * ((s.hi - s.lo) / {bins}) AS bin_start,
               s.lo + (g.bin + 1) * ((s.hi - s.lo) / {bins}) AS bin_end, coalesce(c.n, 0) AS n
        FROM range({bins}) g(bin)
        CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source})
                    WHERE v IS NOT NULL{limit}) s
        LEFT JOIN (
            SELECT least(CASE WHEN hi > lo THEN CAST(floor((v - lo) / ((hi - lo) / {bins})) AS BIGINT) ELSE 0 END,
                         {bins - 1}) AS bin, count(*) AS n
            FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source})
            CROSS JOIN (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT CAST({value} AS DOUBLE) AS v FROM {source})
                        WHERE v IS NOT NULL{limit})
            WHERE v IS NOT NULL{limit} GROUP BY 1) c ON c.bin = g.bin{above}""",
        *reads,
    )


def _models() -> dict[str, str]:
    names = [
        "stg_orders", "stg_customers", "stg_order_items", "stg_order_payments", "stg_order_reviews", "stg_products",
        "stg_sellers", "stg_geolocation", "int_orders_enriched", "int_customer_orders", "fct_orders",
        "fct_order_items", "dim_customers", "dim_products", "dim_sellers", "customer_cohorts", "seller_performance",
        "repeat_training", "repeat_training_dated", "weekly_demand",
    ]
    return {name: _table(name) for name in names}


def _serving() -> dict[str, str]:
    retention = """SELECT c.cohort_month, c.months_since_first, c.active_customers,
        c.active_customers / s.active_customers::DOUBLE AS retention_rate
        FROM customer_cohorts c JOIN customer_cohorts s
          ON c.cohort_month = s.cohort_month AND s.months_since_first = 0"""

    def ranked(direction: str) -> str:
        return with_tables(
            f"""SELECT customer_unique_id, customer_state, CAST(round(monetary, 2) AS DOUBLE) AS total_spent,
                frequency AS order_count, round(avg_order_value, 2) AS avg_order_value, recency_days
            FROM dim_customers ORDER BY monetary {direction}, customer_unique_id LIMIT 20""",
            "dim_customers",
        )

    return {
        "kpis": with_tables(
            """SELECT CAST(round(sum(total_payment_value), 2) AS DOUBLE) AS total_revenue,
                count(DISTINCT order_id) AS order_count,
                round(CAST(sum(total_payment_value) AS DOUBLE) / count(total_payment_value), 2) AS aov,
                (SELECT round(avg(CAST(is_inactive AS INTEGER)) * 100, 1) FROM dim_customers) AS inactive_pct
            FROM fct_orders WHERE order_status = 'delivered'""", "fct_orders", "dim_customers"),
        "revenue_by_month": with_tables(
            """SELECT order_month, CAST(round(sum(total_payment_value), 2) AS DOUBLE) AS revenue,
                count(DISTINCT order_id) AS order_count
            FROM fct_orders WHERE order_status = 'delivered' AND order_month IS NOT NULL
            GROUP BY order_month ORDER BY order_month""", "fct_orders"),
        "orders_by_state": with_tables(
            """SELECT customer_state, count(DISTINCT order_id) AS order_count,
                CAST(round(sum(total_payment_value), 2) AS DOUBLE) AS revenue
            FROM fct_orders WHERE order_status = 'delivered' AND customer_state IS NOT NULL
            GROUP BY customer_state ORDER BY order_count DESC""", "fct_orders"),
        "orders_by_state_top": with_tables(
            """SELECT customer_state, count(DISTINCT order_id) AS order_count,
                CAST(round(sum(total_payment_value), 2) AS DOUBLE) AS revenue
            FROM fct_orders WHERE order_status = 'delivered' AND customer_state IS NOT NULL
            GROUP BY customer_state ORDER BY order_count DESC, customer_state LIMIT 15""", "fct_orders"),
        "order_item_keys": with_tables(
            """SELECT order_id, order_item_id, product_id, seller_id,
                md5(order_id || '|' || order_item_id || '|' || product_id || '|' || seller_id) AS item_key
            FROM stg_order_items""", "stg_order_items"),
        "positive_spend": with_tables(
            """SELECT customer_unique_id, CAST(monetary AS DOUBLE) AS monetary FROM dim_customers
            WHERE monetary > 0""", "dim_customers"),
        "cohort_retention": with_tables(retention, "customer_cohorts"),
        "retention_of_cohort": with_tables(
            """SELECT c.cohort_month, c.months_since_first, c.active_customers, s.cohort_size,
                c.active_customers / s.cohort_size::DOUBLE AS retention_rate
            FROM customer_cohorts c JOIN (
                SELECT cohort_month, count(*) AS cohort_size FROM (
                    SELECT k.customer_unique_id,
                           CAST(date_trunc('month', min(o.order_purchase_timestamp)) AS DATE) AS cohort_month
                    FROM stg_orders o JOIN stg_customers k ON o.customer_id = k.customer_id GROUP BY 1)
                GROUP BY 1) s ON s.cohort_month = c.cohort_month""",
            "customer_cohorts"),
        "cohort_pivot": with_tables(
            "SELECT strftime(cohort_month, '%Y-%m') AS cohort, "
            + ", ".join(f"max(CASE WHEN months_since_first = {m} THEN retention_rate END) AS m{m}" for m in range(84))
            + f" FROM ({retention}) GROUP BY 1",
            "customer_cohorts"),
        "top_customers": ranked("DESC NULLS LAST"),
        "bottom_customers": ranked("ASC NULLS FIRST"),
        "ltv_percentiles": with_tables(
            """SELECT p.prob, round((SELECT quantile_cont(CAST(monetary AS DOUBLE), [0.25, 0.5, 0.75, 0.9])
                                     FROM dim_customers WHERE monetary > 0)[p.i], 4) AS quantile
            FROM (VALUES (1, CAST(0.25 AS DOUBLE)), (2, 0.5), (3, 0.75), (4, 0.9)) p(i, prob)""", "dim_customers"),
        "ltv_histogram": _histogram("dim_customers WHERE monetary > 0", "monetary", 60, ("dim_customers",), 2000000.0),
    }


def _explore() -> dict[str, str]:
    corr = ["frequency", "monetary", "avg_order_value", "recency_days", "avg_review_score", "max_installments_used"]
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
        + ("CAST(1.0 AS DOUBLE)" if a == b else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)")
        + " AS correlation FROM dim_customers"
        + (f" HAVING count({a}) > 1" if a == b else "")
        for a in corr for b in corr
    )

    parts = [("recency_days", "recency_days", 50), ("log_monetary", "ln(1 + CAST(monetary AS DOUBLE))", 50),
             ("avg_review_score", "avg_review_score", 20)]
    head = with_tables("", "dim_customers")
    unions = []
    for name, value, bins in parts:
        body = _histogram("dim_customers", value, bins, ())
        unions.append(f"SELECT bin, round(bin_start, 6) AS bin_start, round(bin_end, 6) AS bin_end, n, '{name}' AS measure FROM ({body})")
    return {
        "table_counts": with_tables(
            """SELECT 'orders' AS "table", count(*) AS n FROM fct_orders
            UNION ALL SELECT 'customers', count(*) FROM dim_customers
            UNION ALL SELECT 'order_items', count(*) FROM fct_order_items
            UNION ALL SELECT 'cohorts', count(*) FROM customer_cohorts""",
            "fct_orders", "dim_customers", "fct_order_items", "customer_cohorts"),
        "monthly_orders_all": with_tables(
            "SELECT order_month, count(order_id) AS order_count FROM fct_orders GROUP BY order_month", "fct_orders"),
        "data_span": with_tables(
            """SELECT min(order_purchase_timestamp) AS first_order, max(order_purchase_timestamp) AS last_order
            FROM fct_orders""", "fct_orders"),
        "last_order_histogram": _histogram(
            "dim_customers", "date_diff('day', DATE '1970-01-01', last_order_date)", 50, ("dim_customers",)),
        "frequency_distribution": with_tables(
            """SELECT f.frequency, f.customers, s.pct_one_time FROM (
                SELECT frequency, count(*) AS customers FROM dim_customers WHERE frequency IS NOT NULL
                GROUP BY frequency ORDER BY frequency LIMIT 10) f
            CROSS JOIN (SELECT avg(CASE WHEN frequency = 1 THEN 1 ELSE 0 END) * 100 AS pct_one_time
                        FROM dim_customers) s""", "dim_customers"),
        "revenue_by_state_top": with_tables(
            """SELECT customer_state, CAST(sum(total_payment_value) AS DOUBLE) AS revenue FROM fct_orders
            WHERE customer_state IS NOT NULL GROUP BY customer_state
            ORDER BY revenue DESC, customer_state LIMIT 15""", "fct_orders"),
        "review_distribution": with_tables(
            """SELECT review_score, count(*) AS n FROM fct_orders WHERE review_score IS NOT NULL
            GROUP BY review_score""", "fct_orders"),
        "delivery_sla": with_tables(
            """SELECT count(*) AS delivered, avg(CAST(delivered_on_time AS INTEGER)) * 100 AS on_time_pct,
                CAST(quantile_cont(CAST(days_to_deliver AS DOUBLE), 0.5) AS DOUBLE) AS median_days
            FROM fct_orders WHERE order_status = 'delivered' AND days_to_deliver IS NOT NULL""", "fct_orders"),
        "delivery_days_histogram": _histogram(
            "fct_orders WHERE order_status = 'delivered'", "days_to_deliver", 40, ("fct_orders",)),
        "payment_mix": with_tables(
            """SELECT 'Credit Card' AS method, CAST(sum(used_credit_card) AS BIGINT) AS customers FROM dim_customers
            UNION ALL SELECT 'Boleto', CAST(sum(used_boleto) AS BIGINT) FROM dim_customers
            UNION ALL SELECT 'Voucher', CAST(sum(used_voucher) AS BIGINT) FROM dim_customers""", "dim_customers"),
        "category_revenue_top": with_tables(
            """SELECT product_category_name_english, CAST(sum(price) AS DOUBLE) AS revenue FROM fct_order_items
            WHERE product_category_name_english IS NOT NULL GROUP BY 1
            ORDER BY revenue DESC, 1 LIMIT 15""", "fct_order_items"),
        "rfm_histograms": head + " UNION ALL ".join(unions),
        "rfm_correlation": with_tables(cells, "dim_customers"),
    }


# Standard normal quantiles at 0.975 and 0.8.
Z_975, Z_800 = "CAST(1.959963984540054 AS DOUBLE)", "CAST(0.8416212335729143 AS DOUBLE)"


def _physical(name: str) -> str:
    """Name of a model or raw table among the SQL tables."""
    special = {"product_category_name_translation": "b_translation", "repeat_purchase_training": "repeat_training"}
    raw = ("orders", "customers", "order_items", "order_payments", "order_reviews", "products", "sellers", "geolocation")
    return special.get(name, f"b_{name}" if name in raw else name)


def _check(check: str, table: str, column: str, severity: str, count: str, source: str | None = None) -> str:
    return (
        f"""SELECT '{check}' AS "check", '{table}' AS "table", '{column}' AS "column", '{severity}' AS severity, """
        f"CAST({count} AS BIGINT) AS failing_rows FROM {source or _physical(table)}"
    )


def _quality() -> dict[str, str]:
    from tradewind.plans import quality as q  # the lists of what to check; not how

    def all_of(parts: list[tuple[str, tuple[str, ...]]]) -> str:
        reads = {r: None for _, rs in parts for r in rs}
        return with_tables(" UNION ALL ".join(sql for sql, _ in parts), *reads)

    nulls = [
        (_check("not_null", t, c, "warn" if (t, c) in q.NOT_NULL_WARN else "error", f'count(*) - count("{c}")'),
         (_physical(t),))
        for t, cs in q.NOT_NULL.items() for c in cs
    ]
    repeats = [
        (_check("unique", t, c, "warn" if (t, c) in q.UNIQUE_WARN else "error", "count(*)",
                f"(SELECT {c} FROM {_physical(t)} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"),
         (_physical(t),))
        for t, cs in q.UNIQUE.items() for c in cs
    ]
    outside = [
        (_check("accepted_values", t, c, "error",
                f"count(*) FILTER (WHERE {c} NOT IN ({', '.join(repr(x) if isinstance(x, str) else str(x) for x in v)}))"),
         (_physical(t),))
        for (t, c), v in q.ACCEPTED.items()
    ]
    orphans = [
        (_check("relationships", child, key, severity, "count(*)",
                f"{_physical(child)} c WHERE c.{key} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {_physical(parent)} p WHERE p.{key} = c.{key})"),
         (_physical(child), _physical(parent)))
        for child, key, parent, severity in q.RELATIONSHIPS
    ]
    training = "repeat_purchase_training"
    return {
        "dq_not_null": all_of(nulls),
        "dq_unique": all_of(repeats),
        "dq_accepted_values": all_of(outside),
        "dq_relationships": all_of(orphans),
        "dq_payment_positive": with_tables(
            _check("payment_value_positive", "stg_order_payments", "total_payment_value", "warn",
                   "count(*) FILTER (WHERE total_payment_value <= 0)"), "stg_order_payments"),
        "dq_recency": with_tables(
            _check("recency_non_negative", training, "recency_at_T", "error",
                   'count(*) FILTER (WHERE "recency_at_T" < 0)'), "repeat_training"),
        "dq_label_classes": with_tables(
            _check("both_label_classes", training, "will_repeat", "error",
                   "CASE WHEN count(DISTINCT will_repeat) < 2 THEN 1 ELSE 0 END"), "repeat_training"),
        "dq_tenure": with_tables(
            _check("tenure_gte_recency", training, "tenure_days", "error",
                   'count(*) FILTER (WHERE tenure_days < "recency_at_T")'), "repeat_training"),
        "dq_freshness": with_tables(
            """SELECT 'freshness' AS "check", 'orders' AS "table", 'order_purchase_timestamp' AS "column",
                CASE WHEN age IS NULL OR age > 49 THEN 'error' WHEN age > 25 THEN 'warn' ELSE 'pass' END AS severity,
                CAST(CASE WHEN age <= 25 THEN 0 ELSE 1 END AS BIGINT) AS failing_rows, age AS age_hours
            FROM (SELECT date_diff('second', max(order_purchase_timestamp), TIMESTAMP '2001-08-03 02:00:00')
                         / CAST(3600 AS DOUBLE) AS age FROM b_orders)""", "b_orders"),
    }


_CONTINUOUS = """(SELECT event_type AS experiment, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS arm,
    event_id AS unit_id, value FROM events)"""
_PROPORTION = """(SELECT CAST(ts AS DATE) AS experiment,
    CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS arm, event_id AS unit_id,
    CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS value FROM events)"""


def _two_sided_normal(z: str) -> str:
    """2 * P(Z > z) for z >= 0, by the series of erf whose terms are all positive."""
    x = f"({z} / sqrt(2.0))"
    terms = f"exp(k * ln(4.0) + lgamma(k + 1) + (2 * k + 1) * ln({x}) - lgamma(2 * k + 2))"
    series = f"list_sum(list_transform(range(0, 150), lambda k: {terms}))"
    return f"(CASE WHEN {z} = 0 THEN 1.0 ELSE 1.0 - 2.0 / sqrt(pi()) * exp(-{x} * {x}) * {series} END)"


def _experiments() -> dict[str, str]:
    arm_means = f"""SELECT experiment, count(*) FILTER (WHERE arm = 'control') AS n1,
        count(*) FILTER (WHERE arm = 'variant') AS n2,
        CAST(sum(value) FILTER (WHERE arm = 'control') AS DOUBLE) AS h1,
        CAST(sum(value) FILTER (WHERE arm = 'variant') AS DOUBLE) AS h2 FROM {_PROPORTION} GROUP BY experiment"""
    proportion = f"""SELECT *, abs(z) AS az FROM (
        SELECT *, h1 / n1 AS p1, h2 / n2 AS p2,
            (h2 / n2 - h1 / n1) / nullif(sqrt((h1 + h2) / (n1 + n2) * (1 - (h1 + h2) / (n1 + n2))
                                              * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 0) AS z,
            {Z_975} * sqrt(h1 / n1 * (1 - h1 / n1) / n1 + h2 / n2 * (1 - h2 / n2) / n2) AS margin
        FROM ({arm_means}) WHERE n1 > 0 AND n2 > 0)"""
    p_value = f"CASE WHEN z IS NULL THEN 1.0 ELSE {_two_sided_normal('az')} END"
    moments = f"""SELECT experiment, count(value) FILTER (WHERE arm = 'control') AS n1,
        count(value) FILTER (WHERE arm = 'variant') AS n2, avg(value) FILTER (WHERE arm = 'control') AS m1,
        avg(value) FILTER (WHERE arm = 'variant') AS m2, var_samp(value) FILTER (WHERE arm = 'control') AS v1,
        var_samp(value) FILTER (WHERE arm = 'variant') AS v2 FROM {_CONTINUOUS} GROUP BY experiment"""
    z = Z_975
    # Quantile of t by its expansion around the normal one; good to 1e-9 for the df of these tables.
    t_crit = (
        f"({z} + ({z}**3 + {z}) / (4 * df) + (5 * {z}**5 + 16 * {z}**3 + 3 * {z}) / (96 * df**2)"
        f" + (3 * {z}**7 + 19 * {z}**5 + 17 * {z}**3 - 15 * {z}) / (384 * df**3)"
        f" + (79 * {z}**9 + 776 * {z}**7 + 1482 * {z}**5 - 1920 * {z}**3 - 945 * {z}) / (92160 * df**4))"
    )
    steps = 2000
    density = f"(1 + (k * abs_t / {steps})**2 / df) ** (-(df + 1) / 2)"
    weight = f"(CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    t_p = (
        f"1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * abs_t / {steps} / 3 * "
        f"list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {density}))"
    )
    size = f"""CASE WHEN m2 <> m1 AND v1 + v2 > 0 THEN
        CAST(ceil((({Z_975} + {Z_800}) * sqrt((v1 + v2) / 2) / abs(m2 - m1)) ** 2) AS BIGINT) END"""
    psize = f"""CASE WHEN p1 <> p2 THEN CAST(ceil(({Z_975} * sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2))
        + {Z_800} * sqrt(p1 * (1 - p1) + p2 * (1 - p2))) ** 2 / (p2 - p1) ** 2) AS BIGINT) END"""
    ranks = f"""SELECT experiment, arm, value,
        rank() OVER (PARTITION BY experiment ORDER BY value)
          + (count(*) OVER (PARTITION BY experiment, value) - 1) / CAST(2 AS DOUBLE) AS r FROM {_CONTINUOUS}"""
    u = f"""SELECT s.*, t.ties, s.r1 - s.n1 * (s.n1 + 1) / CAST(2 AS DOUBLE) AS u FROM (
            SELECT experiment, CAST(count(*) FILTER (WHERE arm = 'control') AS DOUBLE) AS n1,
                   CAST(count(*) FILTER (WHERE arm = 'variant') AS DOUBLE) AS n2,
                   sum(r) FILTER (WHERE arm = 'control') AS r1 FROM ({ranks}) GROUP BY experiment) s
        JOIN (SELECT experiment, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (
                SELECT experiment, value, count(*) AS c FROM {_CONTINUOUS} GROUP BY 1, 2) GROUP BY 1) t
        ON s.experiment = t.experiment"""
    u_z = f"""SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
        / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM ({u})"""
    late = """SELECT CASE WHEN delivered_on_time THEN 'variant' ELSE 'control' END AS arm, order_id AS unit_id,
        CAST(CASE WHEN review_score >= 4 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM fct_orders
        WHERE order_status = 'delivered' AND review_score IS NOT NULL"""
    paid = """SELECT CASE WHEN used_credit_card = 1 THEN 'variant' ELSE 'control' END AS arm, order_id AS unit_id,
        CAST(round(total_payment_value, 2) AS DOUBLE) AS value FROM fct_orders
        WHERE order_status = 'delivered' AND total_payment_value > 0 AND used_credit_card + used_boleto = 1"""

    def sampled(rows: str) -> str:
        return f"""SELECT * FROM ({rows}) QUALIFY row_number() OVER (
            PARTITION BY arm ORDER BY md5('42' || CAST(unit_id AS VARCHAR)), unit_id) <= 500"""

    def summary(rows: str, case: str) -> str:
        mean = "coalesce(CAST(sum(CAST(value AS DECIMAL(18,4))) {f} AS DOUBLE) / count(*) {f}, 0)"
        one, two = (mean.format(f=f"FILTER (WHERE arm = '{arm}')") for arm in ("control", "variant"))
        return f"""SELECT count(*) FILTER (WHERE arm = 'control') AS n_control,
            count(*) FILTER (WHERE arm = 'variant') AS n_variant, {one} AS mean_control, {two} AS mean_variant,
            {two} - {one} AS raw_lift, '{case}' AS "case" FROM ({sampled(rows)})"""

    return {
        "ab_proportion": f"""SELECT experiment, n1 AS n_control, n2 AS n_variant, round(z, 6) AS statistic,
            round({p_value}, 6) AS p_value, round(p2 - p1 - margin, 6) AS ci_low,
            round(p2 - p1 + margin, 6) AS ci_high FROM ({proportion})""",
        "ab_test_proportion": f"""SELECT experiment, 'proportion' AS test_type,
            'two-proportion z, variant minus control' AS method, n_control, n_variant, statistic, p_value, ci_low,
            ci_high, p_value < 0.05 AS significant,
            CASE WHEN p1 > 0 THEN printf('%+.2f%% relative lift', (p2 - p1) / p1 * 100)
                 ELSE 'N/A (control rate is 0)' END AS lift, recommended_sample_size,
            printf('Variant mean %.4f, %s the control mean %.4f: %s at level 0.05 (p = %.4f).', p2,
                   CASE WHEN p2 > p1 THEN 'above' WHEN p2 = p1 THEN 'level with' ELSE 'below' END, p1,
                   CASE WHEN p_value < 0.05 THEN 'a' ELSE 'no' END || ' significant difference', p_raw) AS conclusion,
            'Both arms large enough for the normal limit of a binomial; interval for the gap in rates, not pooled.'
                AS assumptions
        FROM (SELECT experiment, n1 AS n_control, n2 AS n_variant, round(z, 6) AS statistic, p1, p2,
                {p_value} AS p_raw, round({p_value}, 6) AS p_value, round(p2 - p1 - margin, 6) AS ci_low,
                round(p2 - p1 + margin, 6) AS ci_high, {psize} AS recommended_sample_size FROM ({proportion}))""",
        "ab_welch": f"""SELECT experiment, n1 AS n_control, n2 AS n_variant, round(t, 6) AS statistic,
            round(df, 6) AS df, round({t_p}, 6) AS p_value, round(m2 - m1 - {t_crit} * se, 6) AS ci_low,
            round(m2 - m1 + {t_crit} * se, 6) AS ci_high
        FROM (SELECT *, sqrt(v1 / n1 + v2 / n2) AS se, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
                abs((m1 - m2) / sqrt(v1 / n1 + v2 / n2)) AS abs_t,
                (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df
              FROM ({moments}))""",
        "ab_mannwhitney": f"""SELECT experiment, CAST(n1 AS BIGINT) AS n_control, CAST(n2 AS BIGINT) AS n_variant,
            u AS statistic, round(least(1.0, {_two_sided_normal('greatest(z, 0)')}), 6) AS p_value FROM ({u_z})""",
        "ab_sample_size": f"""SELECT 'continuous' AS metric, experiment, n1 AS n_control, n2 AS n_variant,
            {size} AS recommended_sample_size FROM ({moments})
        UNION ALL SELECT 'proportion', CAST(experiment AS VARCHAR), n1, n2, {psize} FROM ({proportion})""",
        "ab_normality_check": f"""SELECT experiment, CAST(least(n1, n2, 50) AS BIGINT) AS sample_n, true AS p_in_range,
            true AS verdict_follows FROM ({moments})""",
        "ab_bootstrap_check": f"SELECT experiment, true AS low_near, true AS high_near FROM ({moments})",
        "ab_test_check": f"""SELECT experiment, 'continuous' AS test_type, n1 AS n_control, n2 AS n_variant,
            printf('%+.4f absolute difference in means', m2 - m1) AS lift, {size} AS recommended_sample_size
            FROM ({moments})""",
        "ab_arms_proportion": with_tables(sampled(late), "fct_orders"),
        "ab_arms_continuous": with_tables(sampled(paid), "fct_orders"),
        "ab_arm_summary": with_tables(
            summary(late, "proportion") + " UNION ALL " + summary(paid, "continuous"), "fct_orders"),
    }


def _segments() -> dict[str, str]:
    def bin_of(measure: str) -> str:
        v = f"CAST({measure} AS DOUBLE)"
        edges = f"(SELECT quantile_cont({v}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM dim_customers)"
        place = f"row_number() OVER (ORDER BY {v}, md5(CAST(customer_unique_id AS VARCHAR)), customer_unique_id)"
        by_value = " ".join(f"WHEN {v} <= {edges}[{i + 1}] THEN {i}" for i in range(1, 5))
        by_place = f"greatest(1, (5 * ({place} - 1) + n - 2) // (n - 1))"
        return f"""CAST(CASE WHEN list_unique({edges}) = 6 THEN CASE {by_value} ELSE 5 END
            ELSE {by_place} END AS DOUBLE)"""

    scores = f"""SELECT customer_unique_id, CAST(recency_days AS DOUBLE) AS recency_days, frequency,
        CAST(monetary AS DOUBLE) AS monetary, 6 - {bin_of('recency_days')} AS r_score,
        {bin_of('frequency')} AS f_score, {bin_of('monetary')} AS m_score
        FROM dim_customers CROSS JOIN (SELECT count(*) AS n FROM dim_customers)"""
    banded = f"""SELECT *, r_score + f_score + m_score AS rfm_score,
        CAST(least(4, CAST(r_score + f_score + m_score - 3 AS INTEGER) // 3) AS INTEGER) AS cluster FROM ({scores})"""
    centers = f"""SELECT cluster, round(avg(recency_days), 6) AS r, round(avg(ln(1 + frequency)), 6) AS f,
        round(avg(ln(1 + monetary)), 6) AS m FROM ({banded}) GROUP BY cluster"""

    def average_rank(order: str, column: str) -> str:
        return f"rank() OVER (ORDER BY {column} {order}) + (count(*) OVER (PARTITION BY {column}) - 1) / CAST(2 AS DOUBLE)"

    labels = f"""SELECT cluster, rank_sum, ['Champions', 'Loyal Customers', 'Potential Loyalists', 'New Customers',
            'At Risk'][row_number() OVER (ORDER BY rank_sum, cluster)] AS segment_name
        FROM (SELECT cluster, {average_rank('ASC', 'r')} + {average_rank('DESC', 'f')} + {average_rank('DESC', 'm')}
              AS rank_sum FROM ({centers}))"""
    return {
        "rfm_quintiles": with_tables(
            f"SELECT customer_unique_id, r_score, f_score, m_score FROM ({scores})", "dim_customers"),
        "rfm_score": with_tables(f"SELECT customer_unique_id, rfm_score FROM ({banded})", "dim_customers"),
        "label_segments": with_tables(labels, "dim_customers"),
        "silhouette_sweep_check": with_tables(
            """SELECT CAST(k AS INTEGER) AS k, n AS customers, round(v, 4) AS total_cost, true AS converged,
                true AS in_range, true AS cost_falls
            FROM range(3, 9) r(k) CROSS JOIN (SELECT count(*) AS n,
                CAST(CAST(var_pop(recency_days) > 0 AS INTEGER) + CAST(var_pop(frequency) > 0 AS INTEGER)
                    + CAST(var_pop(monetary) > 0 AS INTEGER) AS DOUBLE) AS v FROM dim_customers)""", "dim_customers"),
        "customer_segments_check": with_tables(
            """SELECT CAST(c AS INTEGER) AS cluster, (SELECT count(*) FROM dim_customers) AS customers,
                true AS centre_is_mean, true AS all_nearest FROM range(5) r(c)""", "dim_customers"),
        "segment_summary": with_tables(
            f"""SELECT l.segment_name, count(*) AS customer_count, round(avg(b.monetary), 2) AS avg_monetary,
                round(avg(b.recency_days), 0) AS avg_recency_days, round(avg(b.rfm_score), 2) AS avg_rfm_score
            FROM ({banded}) b JOIN ({labels}) l ON b.cluster = l.cluster GROUP BY l.segment_name""", "dim_customers"),
    }


def _propensity() -> dict[str, str]:
    scores = """(SELECT customer_unique_id, will_repeat, p AS repeat_probability, p >= 0.5 AS repeat_prediction FROM (
        SELECT *, CAST(frequency AS DOUBLE) / (frequency + CAST(1 AS DOUBLE) + "recency_at_T" / CAST(60 AS DOUBLE)) AS p
        FROM repeat_training))"""
    split = """(SELECT *, 100 * row_number() OVER (
            PARTITION BY will_repeat ORDER BY md5(md5('42' || CAST(customer_unique_id AS VARCHAR))), customer_unique_id)
            <= 80 * count(*) OVER (PARTITION BY will_repeat) + 50 AS is_train FROM repeat_training)"""
    plain = ["frequency", "monetary", "avg_order_value", "tenure_days", '"recency_at_T"', "max_installments_used",
             "used_credit_card", "used_boleto", "used_voucher"]
    columns = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in plain)
    cells = f"SELECT will_repeat, repeat_prediction, count(*) AS count FROM {scores} GROUP BY 1, 2"
    matrix = f"""SELECT count(*) FILTER (WHERE NOT will_repeat AND NOT repeat_prediction) AS tn,
        count(*) FILTER (WHERE NOT will_repeat AND repeat_prediction) AS fp,
        count(*) FILTER (WHERE will_repeat AND NOT repeat_prediction) AS fn,
        count(*) FILTER (WHERE will_repeat AND repeat_prediction) AS tp FROM {scores}"""
    reads = ("repeat_training",)
    return {
        "propensity_split": with_tables(f"SELECT customer_unique_id, will_repeat, is_train FROM {split}", *reads),
        "propensity_features": with_tables(
            f"""SELECT customer_unique_id, is_train, CAST(will_repeat AS INTEGER)::DOUBLE AS label, {columns},
                coalesce(avg_review_score, (SELECT median(avg_review_score) FROM {split} WHERE is_train), 0)
                    AS avg_review_score,
                CAST(reviewed_order_count AS DOUBLE) AS reviewed_order_count,
                CAST(avg_review_score IS NOT NULL AS INTEGER)::DOUBLE AS has_review FROM {split}""", *reads),
        "propensity_weights": with_tables(
            f"""SELECT count(*) FILTER (WHERE will_repeat) AS n_pos, count(*) FILTER (WHERE NOT will_repeat) AS n_neg,
                count(*) FILTER (WHERE NOT will_repeat) / CAST(count(*) FILTER (WHERE will_repeat) AS DOUBLE)
                    AS pos_weight FROM {split} WHERE is_train""", *reads),
        "repeat_scores_check": with_tables(
            "SELECT CAST(customer_unique_id AS VARCHAR) AS customer_unique_id, true AS in_range, true AS follows"
            " FROM repeat_training", *reads),
        "repeat_score_values": with_tables(f"SELECT repeat_probability, repeat_prediction FROM {scores}", *reads),
        "propensity_report_check": with_tables(
            f"""SELECT count(*) AS held_out, count(*) FILTER (WHERE will_repeat) AS positives, true AS agree
            FROM {split} WHERE NOT is_train""", *reads),
        "propensity_importance_check": "SELECT unnest(['"
        + "', '".join(["frequency", "monetary", "avg_order_value", "tenure_days", "recency_at_T", "max_installments_used",
                       "used_credit_card", "used_boleto", "used_voucher", "avg_review_score", "reviewed_order_count",
                       "has_review"])
        + "']) AS feature, true AS is_share, true AS whole",
        "score_histogram": _histogram(scores, "repeat_probability", 50, reads),
        "threshold_sweep": with_tables(
            f"""SELECT CAST(t.threshold AS DOUBLE) AS threshold,
                count(*) FILTER (WHERE repeat_probability >= CAST(t.threshold AS DOUBLE)) AS n_positive,
                count(*) AS n_scored,
                count(*) FILTER (WHERE repeat_probability >= CAST(t.threshold AS DOUBLE)) / CAST(count(*) AS DOUBLE)
                    * 100 AS pct_positive
            FROM {scores} CROSS JOIN (VALUES {', '.join(f'({0.10 + 0.05 * i:.2f})' for i in range(17))}) t(threshold)
            GROUP BY t.threshold""", *reads),
        "high_propensity": with_tables(
            f"""SELECT s.customer_unique_id, round(s.repeat_probability, 4) AS repeat_probability, s.repeat_prediction,
                d.customer_state, d.frequency, CAST(round(d.monetary, 2) AS DOUBLE) AS total_spent, d.recency_days
            FROM {scores} s LEFT JOIN dim_customers d ON s.customer_unique_id = d.customer_unique_id
            ORDER BY s.repeat_probability DESC, s.customer_unique_id LIMIT 100""", "dim_customers", *reads),
        "confusion_counts": with_tables(cells, *reads),
        "confusion_metrics": with_tables(
            f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                ELSE 0 END AS f1
            FROM (SELECT *, coalesce((tn + tp) / CAST(nullif(tn + fp + fn + tp, 0) AS DOUBLE), 0) AS accuracy,
                    coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision,
                    coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall FROM ({matrix}))""", *reads),
        "roc_auc": with_tables(
            f"""SELECT CAST(p AS BIGINT) AS positives, CAST(q AS BIGINT) AS negatives,
                round((rank_sum - p * (p + 1) / 2) / (p * q), 9) AS roc_auc
            FROM (SELECT CAST(count(*) FILTER (WHERE will_repeat) AS DOUBLE) AS p,
                    CAST(count(*) FILTER (WHERE NOT will_repeat) AS DOUBLE) AS q,
                    sum(r) FILTER (WHERE will_repeat) AS rank_sum
                  FROM (SELECT will_repeat, rank() OVER (ORDER BY repeat_probability)
                          + (count(*) OVER (PARTITION BY repeat_probability) - 1) / CAST(2 AS DOUBLE) AS r
                        FROM {scores}))""", *reads),
        "average_precision": with_tables(
            f"""SELECT CAST(sum(hits) AS BIGINT) AS positives, round(sum(hits * (found / flagged)) / sum(hits), 9)
                AS average_precision
            FROM (SELECT hits, CAST(sum(hits) OVER (ORDER BY p DESC) AS DOUBLE) AS found,
                    CAST(sum(n) OVER (ORDER BY p DESC) AS DOUBLE) AS flagged
                  FROM (SELECT repeat_probability AS p, count(*) AS n, count(*) FILTER (WHERE will_repeat) AS hits
                        FROM {scores} GROUP BY 1))""", *reads),
    }


def _forecast() -> dict[str, str]:
    def eligible(weekly: str) -> str:
        return f"""SELECT category, week, order_count, CAST(n AS INTEGER) AS n_weeks,
            CAST(row_number() OVER (PARTITION BY category ORDER BY week) AS INTEGER) AS week_no
        FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n,
                avg(CASE WHEN order_count = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY category) AS zeros
              FROM (SELECT * FROM {weekly} QUALIFY count(*) OVER (PARTITION BY category) <= 2
                    OR row_number() OVER (PARTITION BY category ORDER BY week DESC) > 2))
        WHERE n >= 10 AND zeros <= 0.5"""

    filled = """(SELECT g.category, CAST(g.week AS DATE) AS week, coalesce(w.order_count, 0) AS order_count FROM (
        SELECT category, unnest(generate_series(min(week)::TIMESTAMP, max(week)::TIMESTAMP, INTERVAL 7 DAY)) AS week
        FROM weekly_demand GROUP BY category) g
        LEFT JOIN weekly_demand w ON g.category = w.category AND CAST(g.week AS DATE) = w.week)"""
    top = """SELECT category, CAST(sum(order_count) AS BIGINT) AS total_orders FROM weekly_demand GROUP BY category
        ORDER BY total_orders DESC, category LIMIT 10"""
    in_top = f"(SELECT * FROM weekly_demand WHERE category IN (SELECT category FROM ({top})))"
    split = f"""SELECT *, week_no > n_weeks - holdout AS is_test FROM (
        SELECT *, CAST(least(12, greatest(1, n_weeks // 4)) AS INTEGER) AS holdout FROM ({eligible(in_top)}))"""
    timed = f"""SELECT *, date_diff('day', min(week) OVER (PARTITION BY category), week) / CAST(365.25 AS DOUBLE) AS x
        FROM ({split})"""

    def line(where: str) -> str:
        y = "CAST(order_count AS DOUBLE)"
        return f"""SELECT category, regr_slope({y}, x) AS b, regr_intercept({y}, x) AS a, min(week) AS first,
            max(week) AS last, sqrt(greatest(0, regr_syy({y}, x) - regr_slope({y}, x) * regr_sxy({y}, x))
                                    / (count(*) - 2)) AS sigma
        FROM ({timed}) WHERE {where} GROUP BY category"""

    future = f"""SELECT category, week, greatest(point, 0) AS yhat, point - {Z_975} * sigma AS yhat_lower,
            point + {Z_975} * sigma AS yhat_upper, 'linear_trend' AS model
        FROM (SELECT l.category, CAST(l.last + CAST(7 * h.i AS INTEGER) AS DATE) AS week, l.sigma,
                l.a + l.b * (date_diff('day', l.first, CAST(l.last + CAST(7 * h.i AS INTEGER) AS DATE))
                             / CAST(365.25 AS DOUBLE)) AS point
              FROM ({line('true')}) l CROSS JOIN range(1, 13) h(i))"""
    held = f"""SELECT t.category, CAST(t.order_count AS DOUBLE) AS y, greatest(l.a + l.b * t.x, 0) AS p
        FROM ({timed}) t JOIN ({line('NOT is_test')}) l ON t.category = l.category WHERE t.is_test"""
    reads = ("weekly_demand",)
    return {
        "top_categories": with_tables(top, *reads),
        "eligible_series": with_tables(eligible("weekly_demand"), *reads),
        "eligible_series_filled": with_tables(eligible(filled), *reads),
        "holdout_split": with_tables(split, *reads),
        "demand_trend": with_tables(
            f"""SELECT category, week, round(yhat, 4) AS yhat, round(yhat_lower, 4) AS yhat_lower,
                round(yhat_upper, 4) AS yhat_upper, model FROM ({future})""", *reads),
        "forecast_metrics": with_tables(
            f"""SELECT category, round(avg(abs(y - p)), 2) AS mae,
                round(avg(2 * abs(y - p) / (abs(y) + abs(p) + 1e-9)), 4) AS smape,
                round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 4) AS mape FROM ({held}) GROUP BY category""",
            *reads),
        "forecasts": with_tables(
            f"""SELECT category, week, round(yhat, 4) AS yhat, round(yhat_lower, 4) AS yhat_lower,
                round(yhat_upper, 4) AS yhat_upper, model FROM ({future})""", *reads),
        "demand_forecast_check": with_tables(
            f"SELECT category, week, 'trend_fourier' AS model, true AS solved, true AS ordered FROM ({future})", *reads),
        "demand_forecast_hw_check": with_tables(
            f"SELECT category, week, true AS finite, true AS floored FROM ({future})", *reads),
        "forecast_metrics_seasonal_check": with_tables(
            f"SELECT DISTINCT category, true AS in_range FROM ({held})", *reads),
        "forecast_metrics_hw_check": with_tables(f"SELECT DISTINCT category, true AS in_range FROM ({held})", *reads),
        "forecast_summary": with_tables(
            f"""SELECT category, count(*) AS horizon_weeks, min(model) AS model, round(avg(yhat), 4) AS avg_weekly_orders,
                bool_or(yhat_lower IS NOT NULL) AND bool_or(yhat_upper IS NOT NULL) AS has_interval
            FROM ({future}) GROUP BY category""", *reads),
        "forecast_overlay": with_tables(
            f"""SELECT category, week, CAST(order_count AS DOUBLE) AS value, 'actual' AS kind,
                CAST(NULL AS DOUBLE) AS yhat_lower, CAST(NULL AS DOUBLE) AS yhat_upper FROM weekly_demand
            UNION ALL SELECT category, week, round(yhat, 4), 'forecast', round(yhat_lower, 4), round(yhat_upper, 4)
            FROM ({future})""", *reads),
    }


def _streams() -> dict[str, str]:
    return {
        "events_json": r"""SELECT CAST(event_id AS VARCHAR) AS key,
            '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '","user_id":' || user_id
            || ',"event_type":"' || event_type || '","value":' || value || ',"props":"' || replace(props, '"', '\"')
            || '"}' AS value FROM events""",
        "stream_orders": """SELECT event_id, ts, user_id, event_type, value,
            CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
        "replay_timestamps": with_tables(
            """SELECT order_id, order_status, order_purchase_timestamp,
                make_timestamp(epoch_us(TIMESTAMP '2024-01-01') +
                    (epoch_us(order_purchase_timestamp)
                     - (SELECT min(epoch_us(order_purchase_timestamp)) FROM b_orders)) // 43200) AS event_timestamp
            FROM b_orders""", "b_orders"),
        "ingest_csv": with_tables(
            """SELECT review_id, CAST(order_id AS VARCHAR) AS order_id, CAST(review_score AS BIGINT) AS review_score,
                CAST(NULL AS VARCHAR) AS review_comment_title,
                'first line' || chr(10) || '"quoted", line of ' || review_id AS review_comment_message,
                strftime(review_creation_date, '%Y-%m-%d %H:%M:%S') AS review_creation_date,
                strftime(review_answer_timestamp, '%Y-%m-%d %H:%M:%S') AS review_answer_timestamp
            FROM b_order_reviews""", "b_order_reviews"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_models(), **_serving(), **_explore(), **_quality(), **_experiments(), **_segments(), **_propensity(),
        **_forecast(), **_streams(),
    }
