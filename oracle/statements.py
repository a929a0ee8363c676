"""One DuckDB statement per registered query that SQL can express."""

from __future__ import annotations

from oracle.base import cents, half_up, not_blank, with_ctes

SQL: dict[str, str] = {}


def add(name: str, sql: str, **extra: str) -> None:
    SQL[name] = with_ctes(sql, **extra)


# ------------------------------------------------------------------ warehouse tables
add("stg_users", "SELECT * FROM stg_users")
add("stg_food", "SELECT * FROM stg_food")
add("stg_menu", "SELECT menu_id, restaurant_id, f_id, cuisine, CAST(price AS DOUBLE) AS price FROM stg_menu")

_ORDER_MONEY = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in ("subtotal", "discount", "delivery_fee", "gst", "sales_amount")
)
add(
    "stg_orders",
    f"""SELECT order_id, order_timestamp, order_date, customer_id, restaurant_id, city, cuisine, items_count, sales_qty,
  {_ORDER_MONEY}, currency, payment_method, order_status, is_delivered, customer_rating, delivery_time_min FROM stg_orders""",
)
add(
    "fct_orders",
    f"""SELECT order_id, order_timestamp, order_date, customer_id, restaurant_id, city, cuisine, payment_method,
  order_status, is_delivered, items_count, sales_qty, {_ORDER_MONEY}, customer_rating, delivery_time_min FROM stg_orders""",
)
_ITEM_MONEY = "CAST(price AS DOUBLE) AS price, quantity, CAST(line_amount AS DOUBLE) AS line_amount"
add("stg_order_items", f"SELECT order_item_id, order_id, restaurant_id, f_id, {_ITEM_MONEY} FROM stg_order_items")
add(
    "fact_order_items",
    f"""SELECT order_item_id, order_id, restaurant_id, f_id, order_ts, order_date, city, {_ITEM_MONEY}
FROM fact_order_items""",
)
_PLACE = "CAST(rating AS DOUBLE) AS rating, rating_count, cost_for_two"
add(
    "stg_restaurant",
    f"SELECT restaurant_id, restaurant_name, city, {_PLACE}, cuisine, license_no FROM stg_restaurant",
)
add("dim_restaurant", f"SELECT restaurant_id, restaurant_name, city, cuisine, {_PLACE} FROM stg_restaurant")
add("stg_reviews", "SELECT * FROM stg_reviews")
add("dim_customer", "SELECT * FROM dim_customer")
add("dim_food", "SELECT f_id, food_name, veg_or_non_veg FROM stg_food")
add(
    "dim_date",
    """SELECT CAST(d AS DATE) AS date_day, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month,
  strftime(d, '%B') AS month_name, strftime(d, '%A') AS day_name, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series(CAST(min(order_date) AS TIMESTAMP), CAST(max(order_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
      FROM stg_orders)""",
)
add("usable_reviews", "SELECT review_id, rating, comment FROM usable")

# -------------------------------------------------------------------------- marts
add("mart_daily_city_revenue", "SELECT * FROM mart_daily_city_revenue")
add("mart_restaurant_performance", "SELECT * FROM mart_restaurant_performance")
add("mart_customer_performance", "SELECT * FROM mart_customer_performance")
add("customer_latest_city", """SELECT c.customer_id, l.latest_city FROM (SELECT DISTINCT customer_id FROM stg_orders) c
LEFT JOIN customer_city l ON c.customer_id IS NOT DISTINCT FROM l.customer_id""")

_SLA = """SELECT city, CAST(hour(order_timestamp) AS INT) AS order_hour, count(*) AS delivered_orders,
  CAST(quantile_disc(delivery_time_min, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(delivery_time_min, 0.9) AS DOUBLE) AS p90
FROM stg_orders WHERE is_delivered GROUP BY ALL"""
add("mart_delivery_sla", _SLA)
add("mart_delivery_sla_sketch", _SLA)

_SHARED = f"""count(*) FILTER (lower(order_status) = 'delivered') AS delivered_orders,
  count(*) FILTER (lower(order_status) = 'cancelled') AS cancelled_orders,
  count(*) FILTER (is_delivered) AS successful_deliveries,
  CAST(sum(CASE WHEN is_delivered THEN sales_qty ELSE 0 END) AS BIGINT) AS total_items_sold,
  CAST(sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END) AS DOUBLE) AS total_revenue,
  {half_up(cents('sum(sales_amount) FILTER (is_delivered)'), '(100 * count(sales_amount) FILTER (is_delivered))', 2)} AS average_order_value,
  {half_up('sum(customer_rating)', 'count(customer_rating)', 2)} AS average_customer_rating,
  {half_up('sum(delivery_time_min) FILTER (is_delivered)', 'count(delivery_time_min) FILTER (is_delivered)', 2)} AS average_delivery_time_min,
  {half_up("(100 * count(*) FILTER (lower(order_status) = 'cancelled'))", 'count(*)', 2)} AS cancel_rate,
  {half_up("(100 * count(*) FILTER (lower(order_status) = 'delivered'))", 'count(*)', 2)} AS delivery_success_rate"""
_CUISINE = f"""SELECT cuisine, count(*) AS total_orders, count(DISTINCT restaurant_id) AS restaurants_count,
  count(DISTINCT city) AS cities_count, {_SHARED}, min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM stg_orders WHERE {not_blank('cuisine')} GROUP BY cuisine"""
_PAYMENT = f"""SELECT payment_method, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers,
  count(DISTINCT restaurant_id) AS unique_restaurants, count(DISTINCT city) AS cities_count, {_SHARED}
FROM stg_orders WHERE {not_blank('payment_method')} GROUP BY payment_method"""
add("mart_cuisine_performance", _CUISINE)
add("mart_payment_performance", _PAYMENT)
add(
    "mart_food_performance",
    """SELECT f.f_id, f.food_name, f.veg_or_non_veg, coalesce(total_orders, 0) AS total_orders,
  coalesce(total_order_items, 0) AS total_order_items, coalesce(total_quantity_sold, 0) AS total_quantity_sold,
  coalesce(total_revenue, 0) AS total_revenue, coalesce(average_item_price, 0) AS average_item_price,
  coalesce(average_line_amount, 0) AS average_line_amount, coalesce(restaurants_selling, 0) AS restaurants_selling,
  coalesce(cities_selling, 0) AS cities_selling, first_order_date, last_order_date
FROM stg_food f LEFT JOIN sold s ON f.f_id = s.f_id""",
    sold=f"""SELECT f_id, count(DISTINCT order_id) AS total_orders, count(*) AS total_order_items,
  CAST(sum(quantity) AS BIGINT) AS total_quantity_sold, CAST(sum(line_amount) AS DOUBLE) AS total_revenue,
  {half_up(cents('sum(price)'), '(100 * count(price))', 2)} AS average_item_price,
  {half_up(cents('sum(line_amount)'), '(100 * count(line_amount))', 2)} AS average_line_amount,
  count(DISTINCT restaurant_id) AS restaurants_selling, count(DISTINCT city) AS cities_selling,
  min(order_date) AS first_order_date, max(order_date) AS last_order_date
FROM fact_order_items GROUP BY f_id""",
)
_INSIGHTS = f"""SELECT r.city, e.topic, e.sentiment_label, count(*) AS reviews,
  {half_up('sum(e.score_100)', '(100 * count(*))', 3)} AS avg_sentiment_score,
  {half_up('sum(r.rating)', 'count(r.rating)', 2)} AS avg_star_rating, count(e.key_issue) AS flagged_issues
FROM review_enriched e JOIN stg_reviews r ON e.review_id = CAST(r.review_id AS VARCHAR) GROUP BY ALL"""
add("mart_review_insights", _INSIGHTS)
add(
    "multi_distinct",
    """SELECT cuisine, count(DISTINCT customer_id) AS customers, count(DISTINCT restaurant_id) AS restaurants,
  count(DISTINCT city) AS cities, count(DISTINCT payment_method) AS payment_methods FROM stg_orders GROUP BY cuisine""",
)
add(
    "multi_distinct_approx",
    """SELECT cuisine, count(DISTINCT customer_id) AS customers, count(DISTINCT restaurant_id) AS restaurants,
  count(DISTINCT city) AS cities, count(DISTINCT payment_method) AS payment_methods, true AS customers_within, true AS restaurants_within,
  true AS cities_within, true AS payment_methods_within FROM stg_orders GROUP BY cuisine""",
)
for _period in ("month", "year"):
    add(
        f"sketch_roll_up_{_period}",
        f"""SELECT CAST(date_trunc('{_period}', order_date) AS DATE) AS period, cuisine, count(*) AS orders, count(DISTINCT customer_id) AS customers,
  count(DISTINCT restaurant_id) AS restaurants, count(delivery_time_min) FILTER (is_delivered) AS timed_orders, true AS customers_within,
  true AS restaurants_within, true AS p50_within, true AS p90_within FROM stg_orders GROUP BY ALL""",
    )
add(
    "kpi_overall",
    f"""SELECT count(*) AS total_orders, count(*) FILTER (is_delivered) AS delivered_orders,
  CAST(sum(CASE WHEN is_delivered THEN sales_amount ELSE 0 END) AS DOUBLE) AS gmv,
  {half_up(cents('sum(sales_amount) FILTER (is_delivered)'), '(100 * count(*) FILTER (is_delivered))', 2)} AS aov,
  {half_up("(100 * count(*) FILTER (lower(order_status) = 'cancelled'))", 'count(*)', 2)} AS cancel_rate FROM stg_orders""",
)
add(
    "table_row_counts",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM raw_{t}"
        for t in ("food", "menu", "order_items", "orders", "restaurant", "reviews", "users")
    )
    + " ORDER BY table_name",
)
add(
    "latest_enrichment",
    """SELECT review_id, sentiment_label, score_100 / 100.0 AS sentiment_score, topic, key_issue, processed_at, model_used
FROM latest_enrichment""",
)

# ------------------------------------------------------------------------ quality
add(
    "dq_unique",
    "SELECT order_id AS value, count(*) AS copies FROM stg_order_items GROUP BY order_id HAVING count(*) > 1",
)
add("dq_not_null", "SELECT order_id, restaurant_id FROM stg_orders WHERE restaurant_id IS NULL")
add(
    "dq_relationships",
    """SELECT order_id AS value, count(*) AS occurrences FROM stg_order_items i
WHERE order_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stg_orders o WHERE o.order_id = i.order_id) GROUP BY order_id""",
)
add(
    "dq_accepted_values",
    """SELECT order_status AS value, count(*) AS occurrences FROM stg_orders
WHERE order_status NOT IN ('Delivered', 'Cancelled') GROUP BY order_status""",
)
add(
    "dq_order_fact",
    """SELECT 'accepted_values_order_status' AS check_name, count(DISTINCT order_status) AS failures FROM stg_orders
  WHERE order_status NOT IN ('Delivered', 'Cancelled', 'Refunded')
UNION ALL SELECT 'not_null_order_id', count(*) FROM stg_orders WHERE order_id IS NULL
UNION ALL SELECT 'relationships_customer_id', count(DISTINCT customer_id) FROM stg_orders
  WHERE customer_id NOT IN (SELECT customer_id FROM dim_customer)
UNION ALL SELECT 'unique_order_id', count(*) FROM (SELECT order_id FROM stg_orders WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""",
)
add(
    "id_set_diff",
    """SELECT id, 'missing' AS side FROM (SELECT CAST(review_id AS VARCHAR) AS id FROM raw_reviews EXCEPT SELECT review_id FROM review_enriched)
UNION ALL SELECT id, 'extra' FROM (SELECT review_id AS id FROM review_enriched EXCEPT SELECT CAST(review_id AS VARCHAR) FROM raw_reviews)""",
)

# ---------------------------------------------------------------------- catalogue
add(
    "cities_by_gmv",
    """SELECT city, round(sum(gmv), 2) AS gmv, CAST(sum(orders) AS BIGINT) AS orders FROM mart_daily_city_revenue GROUP BY city
ORDER BY sum(gmv) DESC NULLS LAST, city LIMIT 10""",
)
add(
    "cuisines_by_orders",
    "SELECT cuisine, total_orders, total_revenue FROM m ORDER BY total_orders DESC, cuisine LIMIT 10",
    m=_CUISINE,
)
for _name, _measure in (("revenue", "revenue"), ("orders", "orders"), ("rating", "avg_customer_rating")):
    add(
        f"restaurants_by_{_name}",
        f"""SELECT * FROM mart_restaurant_performance WHERE restaurant_name IS NOT NULL
ORDER BY {_measure} DESC NULLS LAST, restaurant_id LIMIT 10""",
    )
add(
    "best_restaurant_per_city",
    """SELECT city, restaurant_id, restaurant_name, orders, revenue, avg_customer_rating FROM mart_restaurant_performance
WHERE restaurant_name IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY city ORDER BY revenue DESC NULLS LAST, restaurant_id) = 1""",
)
_CITY_TIME = f"""SELECT city, count(*) AS delivered_orders, {half_up('sum(delivery_time_min)', 'count(delivery_time_min)', 2)} AS avg_delivery_min,
  CAST(quantile_disc(delivery_time_min, 0.5) AS DOUBLE) AS median_delivery_min FROM stg_orders WHERE is_delivered GROUP BY city"""
add("delivery_time_by_city", _CITY_TIME)
add("fastest_cities", "SELECT * FROM t ORDER BY avg_delivery_min NULLS LAST, city NULLS LAST LIMIT 10", t=_CITY_TIME)
add(
    "cities_by_cancellation",
    f"""SELECT * FROM (SELECT city, count(*) AS orders, count(*) FILTER (lower(order_status) = 'cancelled') AS cancelled_orders,
  {half_up("(100 * count(*) FILTER (lower(order_status) = 'cancelled'))", 'count(*)', 2)} AS cancel_rate FROM stg_orders GROUP BY city)
ORDER BY cancel_rate DESC NULLS LAST, city NULLS LAST LIMIT 10""",
)
for _name, _column in (("negative_topics", "topic"), ("common_complaints", "key_issue")):
    add(
        _name,
        f"""SELECT {_column}, count(*) AS reviews FROM latest_enrichment
WHERE sentiment_label = 'negative' AND {_column} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    )
add(
    "sentiment_summary",
    f"""SELECT count(*) AS enriched_reviews, {half_up('sum(score_100)', '(100 * count(*))', 3)} AS avg_sentiment_score,
  count(*) FILTER (sentiment_label = 'positive') AS positive_reviews, count(*) FILTER (sentiment_label = 'neutral') AS neutral_reviews,
  count(*) FILTER (sentiment_label = 'negative') AS negative_reviews FROM latest_enrichment""",
)
add(
    "highest_spending_customers",
    """SELECT customer_id, customer_name, city, total_orders, total_spend FROM mart_customer_performance
ORDER BY total_spend DESC NULLS LAST, customer_id LIMIT 10""",
)
add(
    "payment_methods_by_orders",
    "SELECT payment_method, total_orders, total_revenue FROM m ORDER BY total_orders DESC, payment_method LIMIT 10",
    m=_PAYMENT,
)
add(
    "reviews_with_enrichment",
    """SELECT CAST(r.review_id AS VARCHAR) AS review_id, r.rating, r.comment, r.review_date, e.sentiment_label,
  e.score_100 / 100.0 AS sentiment_score, e.topic, e.key_issue
FROM raw_reviews r LEFT JOIN latest_enrichment e ON e.review_id = CAST(r.review_id AS VARCHAR)""",
)
add(
    "top_restaurant_reviews",
    """SELECT w.restaurant_name, r.review_id, r.rating, r.comment FROM usable r JOIN
  (SELECT * FROM mart_restaurant_performance WHERE restaurant_name IS NOT NULL ORDER BY revenue DESC NULLS LAST, restaurant_id LIMIT 1) w
ON r.restaurant_id = w.restaurant_id""",
)
_TOPICS = """SELECT i.city, i.topic, i.sentiment_label, CAST(sum(i.reviews) AS BIGINT) AS reviews, CAST(sum(i.flagged_issues) AS BIGINT) AS flagged_issues
FROM insights i JOIN w ON i.city = w.city GROUP BY ALL"""
add(
    "top_city_topics",
    _TOPICS,
    insights=_INSIGHTS,
    w="SELECT city FROM mart_daily_city_revenue GROUP BY city ORDER BY sum(gmv) DESC NULLS LAST, city LIMIT 1",
)
add(
    "slowest_city_topics",
    _TOPICS,
    insights=_INSIGHTS,
    t=_CITY_TIME,
    w="SELECT city FROM t ORDER BY avg_delivery_min DESC NULLS LAST, city NULLS LAST LIMIT 1",
)
add(
    "most_cancelled_city_topics",
    _TOPICS,
    insights=_INSIGHTS,
    w=f"""SELECT city FROM (SELECT city, {half_up("(100 * count(*) FILTER (lower(order_status) = 'cancelled'))", 'count(*)', 2)} AS cancel_rate
FROM stg_orders GROUP BY city) ORDER BY cancel_rate DESC NULLS LAST, city NULLS LAST LIMIT 1""",
)
add(
    "best_cuisine_reviews",
    """SELECT o.cuisine, r.review_id, r.order_id, r.rating, r.comment FROM usable r JOIN stg_orders o ON r.order_id = o.order_id
JOIN (SELECT cuisine FROM m ORDER BY total_orders DESC, cuisine LIMIT 1) w ON o.cuisine = w.cuisine""",
    m=_CUISINE,
)
