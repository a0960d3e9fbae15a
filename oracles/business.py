"""DuckDB statements for the business pipelines."""

MONEY = "DECIMAL(15,2)"

RAW = f"""
raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date, o_orderstatus AS status,
         o_totalprice::{MONEY} AS total_amount, NULL::VARCHAR AS currency
  FROM orders),
raw_accounts AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN c_acctbal >= 0 THEN ' ' || replace(c_name, '#', '.') || '@Example.com ' END AS email,
         split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         nullif(c_mktsegment, 'FURNITURE') AS acquisition_channel, signup_date
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS signup_date FROM orders GROUP BY o_custkey) f
    ON c_custkey = f.o_custkey),
stg_orders AS (
  SELECT order_id, customer_id, order_date::DATE AS order_date, upper(trim(status)) AS status,
         coalesce(total_amount, 0)::{MONEY} AS total_amount, coalesce(currency, 'USD') AS currency,
         TIMESTAMP '2001-08-01' AS processed_at
  FROM raw_orders WHERE order_id IS NOT NULL),
stg_customers AS (
  SELECT customer_id, lower(trim(email)) AS email, trim(first_name || ' ' || last_name) AS full_name,
         coalesce(acquisition_channel, 'unknown') AS acquisition_channel, signup_date::DATE AS signup_date,
         TIMESTAMP '2001-08-01' AS processed_at
  FROM raw_accounts WHERE customer_id IS NOT NULL AND email IS NOT NULL)
"""

CUSTOMER_TXN = f"""
customer_txn AS (
  SELECT o_custkey AS customer_id, sum(o_totalprice::{MONEY}) AS total_amount, count(*) AS txn_count
  FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY 1),
customer_summary AS (
  SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, total_amount, txn_count
  FROM customer_txn t JOIN customer c ON t.customer_id = c.c_custkey WHERE total_amount > 100)
"""

DAILY = """
SELECT so.order_date AS report_date, count(DISTINCT so.order_id) AS total_orders,
       sum(so.total_amount)::DOUBLE AS total_revenue,
       sum(so.total_amount)::DOUBLE / count(so.total_amount) AS avg_order_value,
       count(DISTINCT so.customer_id) AS unique_customers,
       count(DISTINCT CASE WHEN sc.signup_date = so.order_date THEN so.customer_id END) AS new_customers,
       count(DISTINCT CASE WHEN sc.signup_date < so.order_date THEN so.customer_id END) AS returning_customers
FROM stg_orders so LEFT JOIN stg_customers sc ON so.customer_id = sc.customer_id
"""


def _ltv(as_of: str, where: str) -> str:
    return f"""
SELECT sc.customer_id, sc.email, sc.acquisition_channel, min(so.order_date) AS first_order_date,
       max(so.order_date) AS last_order_date, count(DISTINCT so.order_id) AS total_orders,
       sum(so.total_amount)::DOUBLE AS total_revenue,
       sum(so.total_amount)::DOUBLE / count(so.total_amount) AS avg_order_value,
       DATE '{as_of}' - max(so.order_date) AS days_since_last_order,
       CASE WHEN sum(so.total_amount) >= 4000000 THEN 'platinum' WHEN sum(so.total_amount) >= 2000000 THEN 'gold'
            WHEN sum(so.total_amount) >= 1000000 THEN 'silver' ELSE 'bronze' END AS ltv_segment,
       TIMESTAMP '{as_of}' AS updated_at
FROM stg_customers sc JOIN stg_orders so ON sc.customer_id = so.customer_id AND so.status NOT IN ('P')
WHERE {where} GROUP BY sc.customer_id, sc.email, sc.acquisition_channel"""


_EMPLOYEES = f"""
employees AS (
  SELECT c_custkey AS employee_id, CASE WHEN c_custkey > 0 THEN c_custkey // 10 END AS manager_id,
         c_mktsegment AS dept, c_acctbal::{MONEY} AS salary FROM customer)
"""

SQL = {
    "customer_txn": f"WITH {CUSTOMER_TXN} SELECT customer_id, total_amount::DOUBLE AS total_amount, txn_count FROM customer_txn",
    "customer_summary": f"""WITH {CUSTOMER_TXN}
        SELECT customer_id, name, segment, total_amount::DOUBLE AS total_amount, txn_count FROM customer_summary""",
    "high_value_customers": f"""WITH {CUSTOMER_TXN}
        SELECT customer_id, name, total_amount::DOUBLE AS total_amount FROM customer_summary
        WHERE total_amount > 500000""",
    "stg_orders": f"""WITH {RAW} SELECT * REPLACE (total_amount::DOUBLE AS total_amount) FROM stg_orders
        WHERE order_date >= DATE '2001-08-01' - INTERVAL 365 DAY""",
    "stg_customers": f"WITH {RAW} SELECT * FROM stg_customers",
    "sales_daily": f"WITH {RAW} {DAILY} GROUP BY so.order_date",
    "sales_daily_one_day": f"WITH {RAW} {DAILY} WHERE so.order_date = DATE '1999-03-01' GROUP BY so.order_date",
    "customer_ltv": f"WITH {RAW} {_ltv('2001-08-01', 'true')}",
    "upsert_sales_daily": f"""WITH {RAW}, daily AS ({DAILY} GROUP BY so.order_date)
        SELECT report_date, total_orders,
               CASE WHEN report_date >= DATE '2000-01-01' THEN total_revenue ELSE 0 END AS total_revenue,
               CASE WHEN report_date >= DATE '2000-01-01' THEN avg_order_value ELSE 0 END AS avg_order_value,
               unique_customers, new_customers, returning_customers FROM daily""",
    "upsert_partitioned": f"""WITH {RAW}, daily AS ({DAILY} GROUP BY so.order_date),
        again AS (SELECT report_date FROM daily WHERE report_date = DATE '1999-03-01')
        SELECT report_date, total_orders * CASE WHEN report_date IN (FROM again) THEN 2 ELSE 1 END AS total_orders,
               CASE WHEN report_date >= DATE '2000-01-01' THEN total_revenue ELSE 0 END AS total_revenue,
               CASE WHEN report_date >= DATE '2000-01-01' THEN avg_order_value ELSE 0 END AS avg_order_value,
               unique_customers, new_customers, returning_customers,
               CASE WHEN report_date >= DATE '2000-01-01' THEN 2
                    WHEN date_trunc('month', report_date) IN (SELECT date_trunc('month', report_date) FROM again) THEN 3
                    ELSE 1 END::BIGINT AS since FROM daily""",
    "upsert_customer_ltv": f"""WITH {RAW},
        o AS ({_ltv('2000-06-30', "so.order_date <= DATE '2000-06-30'")}),
        n AS ({_ltv('2001-08-01', "so.order_date >= DATE '2000-01-01'")})
        SELECT coalesce(o.customer_id, n.customer_id) AS customer_id,
               CASE WHEN o.customer_id IS NULL THEN n.email ELSE o.email END AS email,
               CASE WHEN o.customer_id IS NULL THEN n.acquisition_channel ELSE o.acquisition_channel END
                 AS acquisition_channel,
               CASE WHEN o.customer_id IS NULL THEN n.first_order_date ELSE o.first_order_date END AS first_order_date,
               {', '.join(
                   f'CASE WHEN n.customer_id IS NULL THEN o.{c} ELSE n.{c} END AS {c}'
                   for c in ('last_order_date', 'total_orders', 'total_revenue', 'avg_order_value',
                             'days_since_last_order', 'ltv_segment', 'updated_at'))}
        FROM o FULL OUTER JOIN n ON o.customer_id = n.customer_id""",
    "merge_balances": f"""WITH t AS (SELECT c_custkey, c_acctbal::DECIMAL(18,2) AS balance FROM customer
                                  WHERE c_mktsegment <> 'BUILDING'),
        s AS (SELECT o_custkey, sum(o_totalprice::{MONEY}) AS charge FROM orders GROUP BY 1)
        SELECT coalesce(c_custkey, o_custkey) AS customer_id,
               (coalesce(balance, 0) - coalesce(charge, 0))::DOUBLE AS balance,
               CASE WHEN c_custkey IS NULL THEN 'new' ELSE 'known' END AS origin
        FROM t FULL OUTER JOIN s ON c_custkey = o_custkey""",
    "incremental_events": """
        SELECT event_id, ts, user_id, event_type,
               CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'first' ELSE 'second' END AS load FROM events""",
    "replace_vs_insert": """
        SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, 'appended' AS target
        FROM customer
        UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'replaced' FROM customer WHERE c_mktsegment >= 'FURNITURE'""",
    "truncate_load_orders": """
        SELECT o_orderkey AS order_id, CASE WHEN o_orderdate >= DATE '2000-01-01' THEN 'R' ELSE o_orderstatus END AS status,
               o_orderdate::DATE AS order_date, year(o_orderdate) AS order_year FROM orders""",
    "insert_values": "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (90, 'ARCTIC'), (91, 'ANTARCTIC')",
    "row_count_gate": f"""WITH {RAW}
        SELECT 'staging.stg_orders' AS "table", count(*) AS row_count, count(*) > 0 AS ok FROM stg_orders
        UNION ALL SELECT 'staging.stg_customers', count(*), count(*) > 0 FROM stg_customers""",
    "materialization_policies": """
        SELECT event_type, count(*) AS events, policy FROM events,
               (VALUES ('view'), ('table'), ('incremental'), ('ephemeral')) p(policy) GROUP BY event_type, policy""",
    "monthly_revenue": f"""
        WITH raw_o AS (SELECT o_orderkey, o_custkey, o_totalprice::{MONEY} AS amount, o_orderdate FROM orders
                       WHERE o_orderdate >= DATE '1996-01-01'),
        enriched AS (SELECT o.*, c_mktsegment AS segment, r_name AS region,
                            date_trunc('month', o_orderdate)::DATE AS month
                     FROM raw_o o JOIN customer ON o_custkey = c_custkey
                     JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        agg AS (SELECT month, segment, region, sum(amount)::DOUBLE AS revenue,
                       count(DISTINCT o_custkey) AS unique_customers, count(o_orderkey) AS order_count
                FROM enriched GROUP BY month, segment, region)
        SELECT *, revenue / nullif(unique_customers, 0) AS revenue_per_customer FROM agg ORDER BY month DESC""",
    "all_events_union": """
        SELECT event_id, user_id, 'click' AS event_type FROM events WHERE event_type = 'click'
        UNION ALL SELECT event_id, user_id, 'view' FROM events WHERE event_type = 'view'""",
    "rank_customers": f"""
        SELECT o_custkey AS customer_id, sum(o_totalprice::{MONEY})::DOUBLE AS total_amount,
               rank() OVER (ORDER BY sum(o_totalprice::{MONEY}) DESC) AS rank_by_spend FROM orders GROUP BY o_custkey""",
    "rank_in_segment": """
        SELECT c_custkey AS customer_id, c_mktsegment AS segment, floor(c_acctbal)::BIGINT AS balance,
               rank() OVER (PARTITION BY c_mktsegment ORDER BY floor(c_acctbal)) AS place FROM customer""",
    "row_number_orders": """
        SELECT o_custkey AS customer_id, o_orderkey AS order_id, o_orderdate::DATE AS order_date,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS order_no FROM orders""",
    "running_total": f"""
        SELECT event_id, event_type,
               (sum(value::{MONEY}) OVER (PARTITION BY event_type ORDER BY ts, event_id
                                          ROWS UNBOUNDED PRECEDING))::DOUBLE AS running_value FROM events""",
    "segment_share": f"""
        SELECT c_custkey AS customer_id, c_mktsegment AS segment, c_acctbal::{MONEY}::DOUBLE AS balance,
               (sum(c_acctbal::{MONEY}) OVER (PARTITION BY c_mktsegment))::DOUBLE AS segment_balance FROM customer""",
    "agg_family": f"""
        SELECT o_orderstatus AS status, sum(a)::DOUBLE AS sum_amount, count(*) AS row_count, count(a) AS amount_count,
               sum(a)::DOUBLE / count(a) AS avg_amount, min(a)::DOUBLE AS min_amount, max(a)::DOUBLE AS max_amount,
               round(stddev_samp(a::DOUBLE), 2) AS stddev_amount, round(var_samp(a::DOUBLE), 0) AS variance_amount,
               count(DISTINCT o_custkey) AS customers,
               string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities,
               round(median(a::DOUBLE), 3) AS median_amount
        FROM (SELECT *, o_totalprice::{MONEY} AS a FROM orders) GROUP BY o_orderstatus""",
    "listagg_lines": """
        SELECT l_orderkey AS order_id, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS return_flags,
               count(l_returnflag) AS flag_count FROM lineitem GROUP BY l_orderkey""",
    "pivot_status": f"""
        SELECT year(o_orderdate) AS year,
               {', '.join(f"(sum(o_totalprice::{MONEY}) FILTER (o_orderstatus = '{s}'))::DOUBLE AS status_{s.lower()}"
                          for s in 'FOP')},
               (sum(o_totalprice::{MONEY}) FILTER (coalesce(o_orderstatus NOT IN ('F', 'O', 'P'), true)))::DOUBLE AS status_rest
        FROM orders GROUP BY 1""",
    "unpivot_measures": " UNION ALL ".join(
        f"""SELECT l_returnflag AS return_flag, l_linestatus AS line_status, '{m}' AS measure,
                   sum(l_{m}::{MONEY})::DOUBLE AS total FROM lineitem GROUP BY 1, 2"""
        for m in ("quantity", "extendedprice", "discount", "tax")
    ),
    "cross_apply_top_orders": """
        SELECT c_custkey AS customer_id, c_name AS name, order_id, amount, place FROM customer,
        LATERAL (SELECT o_orderkey AS order_id, o_totalprice AS amount,
                        row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place
                 FROM orders WHERE o_custkey = c_custkey) t WHERE place <= 2""",
    "outer_apply_top_order": """
        SELECT c_custkey AS customer_id, c_name AS name, order_id, amount, place FROM customer LEFT JOIN
        (SELECT o_custkey, o_orderkey AS order_id, o_totalprice AS amount,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
         FROM orders) t ON o_custkey = c_custkey AND place = 1""",
    "lateral_totals": """
        SELECT c_custkey AS customer_id, order_count, largest_order FROM customer,
        LATERAL (SELECT count(*) AS order_count, max(o_totalprice) AS largest_order FROM orders
                 WHERE o_custkey = c_custkey) t""",
    "nested_subquery": f"""
        SELECT c_mktsegment AS segment, count(*) AS customers, sum(revenue)::DOUBLE AS revenue FROM (
          SELECT o_custkey, sum(revenue) AS revenue FROM (
            SELECT l_orderkey, sum(l_extendedprice::{MONEY} * (1 - l_discount::DECIMAL(4,2))) AS revenue FROM (
              SELECT * FROM lineitem) GROUP BY l_orderkey)
          JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
        JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "scalar_subquery_filter": f"""
        SELECT o_orderkey AS order_id, o_totalprice AS amount FROM orders
        WHERE o_totalprice > (SELECT sum(o_totalprice::{MONEY})::DOUBLE / count(*) FROM orders)""",
    "self_join_managers": f"""WITH {_EMPLOYEES}
        SELECT e.employee_id, m.employee_id AS manager_id, m.dept AS manager_dept, m.salary < e.salary AS earns_more
        FROM employees e JOIN employees m ON e.manager_id = m.employee_id""",
    "hierarchy_levels": f"""WITH RECURSIVE {_EMPLOYEES},
        h AS (SELECT employee_id, manager_id, 1::BIGINT AS level FROM employees WHERE manager_id IS NULL
              UNION ALL SELECT e.employee_id, e.manager_id, h.level + 1 FROM employees e
              JOIN h ON e.manager_id = h.employee_id)
        SELECT * FROM h""",
    "recursive_reports": f"""WITH RECURSIVE {_EMPLOYEES},
        h AS (SELECT employee_id, employee_id::VARCHAR AS path FROM employees WHERE manager_id IS NULL
              UNION ALL SELECT e.employee_id, h.path || '/' || e.employee_id FROM employees e
              JOIN h ON e.manager_id = h.employee_id)
        SELECT * FROM h""",
    "hierarchy_marks": """
        WITH o AS (SELECT o_custkey AS c, o_orderkey AS id, count(*) OVER w AS place, lag(o_orderkey) OVER w AS prior,
                          max(o_orderkey) OVER (PARTITION BY o_custkey) AS last,
                          min(o_orderkey) OVER (PARTITION BY o_custkey) AS first
                   FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
        SELECT id AS order_id, CASE WHEN prior IS NULL AND c % 5 = 0 THEN last ELSE prior END AS prior_id,
               CASE WHEN c % 5 <> 0 THEN first END AS root, CASE WHEN c % 5 <> 0 THEN place END AS level, c % 5 = 0 AS on_cycle
        FROM o""",
    "gross_margin": """
        SELECT l_orderkey AS order_id, l_linenumber::BIGINT AS line_no, l_partkey AS part_id,
               l_shipdate::DATE AS ship_date, l_extendedprice * (1 - l_discount) AS net,
               l_extendedprice / nullif(l_quantity, 0) AS unit_price,
               coalesce(nullif(l_returnflag, 'N'), '-') AS returned,
               CASE WHEN l_tax > 0.05::DOUBLE THEN 'high' WHEN l_tax > 0.02::DOUBLE THEN 'mid' ELSE 'low' END AS tax_band
        FROM lineitem""",
}
