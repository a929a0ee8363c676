"""Shared table expressions and helpers for the DuckDB statements."""

from __future__ import annotations

import re

from platter.functions.sqlcompat import WHITE_SPACE
from platter.sources.sample import QUESTIONS, REVIEW_PHRASES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def chars(value: str) -> str:
    """A string literal spelled by code points."""
    return " || ".join(f"chr({ord(c)})" for c in value)


TRIM = chars(WHITE_SPACE)


def half_up(num: str, den: str, digits: int) -> str:
    """round(num / den, digits) for integers, half away from zero, exact; NULL when den is 0 or NULL."""
    p = 10**digits
    return (
        f"CAST(sign({num}) * ((2 * abs(CAST({num} AS HUGEINT)) * {p} + nullif({den}, 0)) // (2 * nullif({den}, 0)))"
        f" AS DOUBLE) / {float(p)}"
    )


def cents(expr: str) -> str:
    return f"CAST(({expr}) * 100 AS HUGEINT)"


def last_part(col: str) -> str:
    return f"trim(coalesce(nullif(regexp_extract({col}, '[^,]+$', 0), ''), {col}), {TRIM})"


def as_int(col: str) -> str:
    """String to integer, NULL unless it is one."""
    return f"CASE WHEN regexp_full_match(trim({col}), '[+-]?[0-9]+') THEN CAST(trim({col}) AS BIGINT) END"


NOT_BLANK = r"regexp_matches({}, '[^\x09-\x0d\x20\x{{85}}\p{{Z}}]')"


def not_blank(col: str) -> str:
    return f"({col} IS NOT NULL AND {NOT_BLANK.format(col)})"


CTES: dict[str, str] = {
    "raw_restaurant": """
SELECT CAST(s.s_suppkey AS VARCHAR) AS id, s.s_name AS name,
  CASE WHEN s.s_suppkey % 10 = 0 THEN n.n_name ELSE concat('Zone ', CAST(s.s_suppkey % 7 AS VARCHAR), ',', n.n_name) END AS city,
  CASE WHEN s.s_suppkey % 9 = 0 THEN '--' ELSE concat(CAST(1 + s.s_suppkey % 4 AS VARCHAR), '.', CAST(s.s_suppkey % 10 AS VARCHAR)) END AS rating,
  CASE WHEN s.s_suppkey % 6 = 0 THEN 'Too Few Ratings' ELSE concat(CAST(10 * (1 + s.s_suppkey % 20) AS VARCHAR), '+ ratings') END AS rating_count,
  CAST(100 + 50 * (s.s_suppkey % 8) AS VARCHAR) AS cost,
  concat('Cuisine ', CAST(s.s_suppkey % 6 AS VARCHAR)) AS cuisine,
  concat('LIC', CAST(s.s_suppkey AS VARCHAR)) AS lic_no
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "raw_users": """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS name, concat(upper(c_name), '@MAIL.TEST') AS email,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE CAST(18 + c_custkey % 60 AS VARCHAR) END AS "Age",
  CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS "Gender",
  CASE WHEN c_custkey % 3 = 0 THEN 'Married' ELSE 'Single' END AS "Marital Status",
  c_mktsegment AS "Occupation",
  CASE WHEN c_acctbal < 0 THEN 'No Income' WHEN c_acctbal < 5000 THEN 'Below 5000' ELSE 'More than 5000' END AS "Monthly Income",
  'Graduate' AS "Educational Qualifications",
  CAST(1 + c_custkey % 6 AS VARCHAR) AS "Family size"
FROM customer""",
    "raw_food": """
SELECT concat('fd', CAST(p_partkey AS VARCHAR)) AS f_id, p_name AS item,
  CASE WHEN p_size % 2 = 0 THEN 'veg' ELSE 'non-veg' END AS veg_or_non_veg
FROM part""",
    "raw_menu": """
SELECT DISTINCT concat('mn', CAST(l_suppkey AS VARCHAR), '_', CAST(l_partkey AS VARCHAR)) AS menu_id,
  CAST(l_suppkey AS VARCHAR) AS r_id, concat('fd', CAST(l_partkey AS VARCHAR)) AS f_id,
  concat('Cuisine ', CAST(l_suppkey % 6 AS VARCHAR)) AS cuisine,
  CASE WHEN p_partkey % 11 = 0 THEN '0' WHEN p_partkey % 17 = 0 THEN 'n/a'
       ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) END AS price
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "raw_orders": """
SELECT o.o_orderkey AS order_id,
  CAST(o.o_orderdate AS TIMESTAMP) + (o.o_orderkey % 24) * INTERVAL '1' HOUR AS order_timestamp,
  CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS user_id, i.r_id,
  r.city AS restaurant_city, r.cuisine, i.items_count, i.sales_qty,
  CAST(o.o_totalprice AS DECIMAL(18,2)) AS subtotal, CAST(o.o_orderkey % 50 AS DECIMAL(18,2)) AS discount,
  CAST(30 AS DECIMAL(18,2)) AS delivery_fee, CAST(5 AS DECIMAL(18,2)) AS gst,
  CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) - o.o_orderkey % 50 + 35 AS DECIMAL(18,2)) AS sales_amount, 'INR' AS currency,
  CASE WHEN o.o_orderkey % 29 = 0 THEN ' ' ELSE o.o_orderpriority END AS payment_method,
  CASE o.o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'Cancelled' ELSE 'Refunded' END AS order_status,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 7 <> 0 THEN 1 + o.o_orderkey % 5 END AS customer_rating,
  CASE WHEN o.o_orderstatus = 'F' THEN 15 + (o.o_orderkey * 7) % 61 END AS delivery_time_min
FROM orders o
LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS r_id, count(*) AS items_count, CAST(sum(l_quantity) AS BIGINT) AS sales_qty
           FROM lineitem GROUP BY l_orderkey) i ON o.o_orderkey = i.l_orderkey
LEFT JOIN raw_restaurant r ON CAST(i.r_id AS VARCHAR) = r.id""",
    "raw_order_items": """
SELECT (l_orderkey % 2147483647 * 8 + l_linenumber) % 2147483647 * 2147483647
    + (l_partkey % 2147483647 * 65537 + l_suppkey % 2147483647 * 257 + CAST(l_quantity AS BIGINT)) % 2147483647 AS order_item_id,
  CASE WHEN l_orderkey % 101 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END AS order_id, l_suppkey AS r_id,
  concat('fd', CAST(l_partkey AS VARCHAR)) AS f_id,
  CAST(50 + l_partkey % 450 AS DECIMAL(18,2)) AS price,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_amount
FROM lineitem""",
    "raw_reviews": f"""
SELECT d.doc_id AS review_id, d.doc_id AS order_id, d.doc_id % 150 AS user_id, d.doc_id % 100 AS restaurant_id,
  1 + d.doc_id % 5 AS rating,
  CASE WHEN d.doc_id % 97 = 0 THEN NULL WHEN d.doc_id % 89 = 0 THEN '   '
       ELSE d.text || ' ' || ({text_list(REVIEW_PHRASES)})[CAST(d.n_chars % {len(REVIEW_PHRASES)} AS INT) + 1] END AS comment,
  CAST(DATE '2024-01-01' + CAST(d.doc_id % 366 AS INT) AS DATE) AS review_date
FROM documents d""",
    "review_enriched": """
SELECT CAST(l.doc_id AS VARCHAR) AS review_id,
  CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment_label,
  CASE WHEN l.toxic = 1 THEN -75 WHEN l.quality = 1 THEN 50 ELSE 0 END AS score_100,
  CASE l.doc_id % 4 WHEN 0 THEN 'food_quality' WHEN 1 THEN 'delivery' WHEN 2 THEN 'service' ELSE 'other' END AS topic,
  CASE WHEN l.toxic = 1 THEN concat('issue ', CAST(l.doc_id % 3 AS VARCHAR)) END AS key_issue,
  TIMESTAMP '2024-06-01 00:00:00' + v.k * INTERVAL '1' HOUR AS processed_at, concat('model', CAST(v.k AS VARCHAR)) AS model_used
FROM labels l JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) v ON v.k = 0 OR l.doc_id % 5 = 0""",
    "latest_enrichment": """
SELECT * FROM review_enriched QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY processed_at DESC, model_used) = 1""",
    "stg_users": f"""
SELECT {as_int('user_id')} AS customer_id, name AS customer_name, lower(email) AS email, {as_int('"Age"')} AS age,
  "Gender" AS gender, "Marital Status" AS marital_status, "Occupation" AS occupation, "Monthly Income" AS income_band,
  "Educational Qualifications" AS education, {as_int('"Family size"')} AS family_size
FROM raw_users WHERE {as_int('user_id')} IS NOT NULL""",
    "stg_food": """
SELECT f_id, item AS food_name, CASE veg_or_non_veg WHEN 'veg' THEN 'Veg' ELSE 'Non-Veg' END AS veg_or_non_veg
FROM raw_food WHERE f_id IS NOT NULL""",
    "stg_menu": f"""
SELECT menu_id, {as_int('r_id')} AS restaurant_id, f_id, cuisine, TRY_CAST(price AS DECIMAL(18,2)) AS price
FROM raw_menu WHERE {as_int('r_id')} IS NOT NULL AND TRY_CAST(price AS DECIMAL(18,2)) > 0""",
    "stg_orders": f"""
SELECT order_id, order_timestamp, order_date, user_id AS customer_id, r_id AS restaurant_id,
  {last_part('restaurant_city')} AS city, cuisine, items_count, sales_qty, subtotal, discount, delivery_fee, gst,
  sales_amount, currency, payment_method, order_status, order_status = 'Delivered' AS is_delivered, customer_rating,
  delivery_time_min
FROM raw_orders""",
    "stg_order_items": """
SELECT order_item_id, order_id, r_id AS restaurant_id, f_id, price, quantity, line_amount FROM raw_order_items""",
    "stg_restaurant": f"""
SELECT {as_int('id')} AS restaurant_id, name AS restaurant_name, {last_part('city')} AS city,
  TRY_CAST(nullif(rating, '--') AS DECIMAL(18,2)) AS rating,
  TRY_CAST(nullif(regexp_extract(rating_count, '[0-9]+', 0), '') AS BIGINT) AS rating_count,
  {as_int('cost')} AS cost_for_two, cuisine, lic_no AS license_no
FROM raw_restaurant WHERE {as_int('id')} IS NOT NULL""",
    "stg_reviews": """
SELECT r.review_id, r.order_id, r.user_id AS customer_id, CAST(r.restaurant_id AS VARCHAR) AS restaurant_id, r.rating,
  r.comment, r.review_date, s.city
FROM raw_reviews r LEFT JOIN stg_restaurant s ON CAST(r.restaurant_id AS VARCHAR) = CAST(s.restaurant_id AS VARCHAR)
WHERE r.comment IS NOT NULL""",
    "usable": f"""
SELECT * FROM raw_reviews WHERE {not_blank('comment')}""",
    "dim_customer": """
SELECT customer_id, customer_name, email, age,
  CASE WHEN age < 25 THEN 'Gen Z' WHEN age < 40 THEN 'Millennial' WHEN age < 55 THEN 'Gen X' WHEN age IS NULL THEN 'Unknown'
       ELSE 'Boomer' END AS age_segment,
  gender, marital_status, occupation, income_band, education, family_size
FROM stg_users""",
    "fact_order_items": """
SELECT i.order_item_id, i.order_id, i.restaurant_id, i.f_id, o.order_timestamp AS order_ts, o.order_date, o.city, i.price,
  i.quantity, i.line_amount
FROM stg_order_items i JOIN stg_orders o ON i.order_id = o.order_id""",
    "mart_daily_city_revenue": f"""
SELECT order_date, city, count(*) AS orders, count(*) FILTER (is_delivered) AS delivered_orders,
  {half_up("count(*) FILTER (order_status = 'Cancelled')", 'count(*)', 4)} AS cancel_rate,
  CAST(sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END) AS DOUBLE) AS gmv,
  {half_up(cents('sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END)'), '(100 * count(*) FILTER (is_delivered))', 2)} AS aov
FROM stg_orders GROUP BY order_date, city""",
    "mart_restaurant_performance": f"""
SELECT f.restaurant_id, r.restaurant_name, r.city, r.cuisine, count(*) AS orders,
  CAST(sum(CASE WHEN f.is_delivered THEN f.sales_amount ELSE 0 END) AS DOUBLE) AS revenue,
  {half_up('sum(f.customer_rating)', 'count(f.customer_rating)', 2)} AS avg_customer_rating,
  {half_up('sum(f.delivery_time_min)', 'count(f.delivery_time_min)', 1)} AS avg_delivery_min
FROM stg_orders f LEFT JOIN stg_restaurant r ON f.restaurant_id = r.restaurant_id
GROUP BY f.restaurant_id, r.restaurant_name, r.city, r.cuisine""",
    "customer_orders": f"""
SELECT customer_id, count(*) AS total_orders, count(*) FILTER (lower(order_status) = 'delivered') AS delivered_orders,
  count(*) FILTER (lower(order_status) = 'cancelled') AS cancelled_orders,
  sum(CASE WHEN lower(order_status) = 'delivered' THEN sales_amount ELSE 0 END) AS total_spend,
  {half_up(cents("sum(sales_amount) FILTER (lower(order_status) = 'delivered')"), "(100 * count(sales_amount) FILTER (lower(order_status) = 'delivered'))", 2)} AS average_order_value,
  {half_up("sum(customer_rating) FILTER (lower(order_status) = 'delivered')", "count(customer_rating) FILTER (lower(order_status) = 'delivered')", 2)} AS average_rating_given,
  min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM stg_orders GROUP BY customer_id""",
    "customer_city": """
SELECT customer_id, city AS latest_city FROM stg_orders WHERE city IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC, order_timestamp DESC, order_id DESC) = 1""",
    "mart_customer_performance": f"""
SELECT c.*, cc.latest_city AS city, coalesce(o.total_orders, 0) AS total_orders,
  coalesce(o.delivered_orders, 0) AS delivered_orders, coalesce(o.cancelled_orders, 0) AS cancelled_orders,
  CAST(coalesce(o.total_spend, 0) AS DOUBLE) AS total_spend,
  coalesce(o.average_order_value, 0) AS average_order_value, coalesce(o.average_rating_given, 0) AS average_rating_given,
  {half_up('(100 * coalesce(o.cancelled_orders, 0))', 'o.total_orders', 2)} AS cancel_rate, o.first_order_date, o.last_order_date
FROM dim_customer c LEFT JOIN customer_orders o ON c.customer_id = o.customer_id
LEFT JOIN customer_city cc ON c.customer_id = cc.customer_id""",
    "review_embeddings": "SELECT vec_id AS review_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "query_parts": """
SELECT CAST(label AS BIGINT) AS query_id, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(pos) GROUP BY label, pos""",
    "query_embeddings": "SELECT query_id, list(x ORDER BY pos) AS embedding FROM query_parts GROUP BY query_id",
    "scored": """
SELECT q.query_id, e.review_id,
  round(coalesce(CASE WHEN list_dot_product(q.embedding, q.embedding) * list_dot_product(e.embedding, e.embedding) > 0
        THEN list_dot_product(q.embedding, e.embedding)
           / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding))) END, 0.0), 9) AS score
FROM query_embeddings q, review_embeddings e""",
    "questions": f"""
SELECT DISTINCT CAST(label AS BIGINT) AS query_id,
  ({text_list(QUESTIONS)})[CAST(label % {len(QUESTIONS)} AS INT) + 1] AS question FROM embeddings""",
    "question_log": f"""
SELECT conv_id, turn, concat_ws(' ', ({text_list(QUESTIONS)})[CAST((conv_id + turn) % {len(QUESTIONS)} AS INT) + 1], text) AS question
FROM conversations WHERE role = 'user'""",
}


def needed(sql: str, extra: dict[str, str]) -> list[str]:
    """Names of the table expressions a statement uses, dependencies first."""
    known = {**CTES, **extra}
    order: list[str] = []

    def visit(body: str) -> None:
        code = re.sub(r"'(?:[^']|'')*'", "''", body)  # names inside text literals do not count
        for name in known:
            if name not in order and body != known[name] and re.search(rf"\b{name}\b", code):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_ctes(sql: str, **extra: str) -> str:
    """Prefix a statement with every table expression it needs."""
    known = {**CTES, **extra}
    names = needed(sql, extra)
    if not names:
        return sql.strip()
    def defined(name: str) -> str:
        recursive = re.search(rf"\b{name}\b", known[name])
        return f"{name} AS {'' if recursive else 'MATERIALIZED '}({known[name].strip()})"

    body = ",\n".join(defined(n) for n in names)
    return f"WITH RECURSIVE {body}\n{sql.strip()}"
