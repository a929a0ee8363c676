"""Registered queries: every operator run over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.functions import text as X
from platter.functions import vector as V
from platter.operators import batching, dedupe, inverted_lists, ranking, similarity, vector_search
from platter.plans import catalogue, enrichment, evaluation, index, marts, quality, retrieval, sketches, staging
from platter.plans.warehouse import Warehouse, build_all, current_build, publish_build
from platter.session import prepare, scratch_path, settle
from platter.sources import sample, tables
from platter.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Types both engines print the same way: DECIMAL as DOUBLE, TIMESTAMP without zone."""
    shown = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        shown.append(col.alias(f.name))
    return df.select(*shown)


def query(name: str):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return present(build(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        return build

    return register


def house(spark: SparkSession, sf_dir: str) -> Warehouse:
    return Warehouse(spark, sample.Landing(spark, sf_dir), lambda: sample.review_enriched(spark, sf_dir))


# ------------------------------------------------------------- warehouse tables
def _register_tables() -> None:
    names = (
        "stg_users", "stg_food", "stg_menu", "stg_orders", "stg_order_items", "stg_restaurant", "dim_customer",
        "dim_food", "dim_restaurant", "fct_orders", "fact_order_items", "mart_daily_city_revenue",
        "mart_delivery_sla", "mart_restaurant_performance", "mart_food_performance", "mart_customer_performance",
        "mart_cuisine_performance", "mart_payment_performance", "mart_review_insights",
    )
    for name in names:
        query(name)(lambda spark, sf_dir, name=name: getattr(house(spark, sf_dir), name))


_register_tables()


@query("stg_reviews")
def _stg_reviews(spark, sf_dir):
    return house(spark, sf_dir).stg_reviews


@query("dim_date")
def _dim_date(spark, sf_dir):
    return marts.dim_date_covering(house(spark, sf_dir).fct_orders, "order_date")


@query("mart_delivery_sla_sketch")
def _sla_sketch(spark, sf_dir):
    return marts.mart_delivery_sla(house(spark, sf_dir).fct_orders, exact=False)


@query("usable_reviews")
def _usable(spark, sf_dir):
    return staging.usable_reviews(house(spark, sf_dir).raw["reviews"]).select("review_id", "rating", "comment")


@query("multi_distinct")
def _multi_distinct(spark, sf_dir):
    return marts.multi_distinct(house(spark, sf_dir).fct_orders)


# The default relative standard error of Spark's approximate distinct count is 5 %.
_APPROX_BOUND = 0.15


@query("multi_distinct_approx")
def _multi_distinct_approx(spark, sf_dir):
    """Exact distinct counts and whether the approximate ones are within three standard errors."""
    fact = house(spark, sf_dir).fct_orders
    told = marts.multi_distinct(fact, exact=False)
    names = [c for c in told.columns if c != "cuisine"]
    told = told.select(F.col("cuisine").alias("_cuisine"), *[F.col(c).alias(f"_{c}") for c in names])
    both = marts.multi_distinct(fact).join(told, F.col("cuisine").eqNullSafe(F.col("_cuisine")), "left")
    checks = [sketches.within_bound(F.col(f"_{c}"), F.col(c), _APPROX_BOUND).alias(f"{c}_within") for c in names]
    return both.select("cuisine", *names, *checks)


def _sketch_roll_up(period: str):
    def build(spark, sf_dir):
        """Daily sketches are written once; the roll-up reads these, the check the fact."""
        fact, path = house(spark, sf_dir).fct_orders, scratch_path(spark, "daily-sketches")
        tables.replace_table(sketches.daily_sketches(fact, ["cuisine", "city"]), path)
        rolled = sketches.roll_up(spark.read.parquet(path), period, ["cuisine"])
        return sketches.roll_up_check(fact, rolled, period, ["cuisine"])

    return build


for _period in ("month", "year"):
    query(f"sketch_roll_up_{_period}")(_sketch_roll_up(_period))


@query("customer_latest_city")
def _customer_city(spark, sf_dir):
    return marts.customer_latest_city(house(spark, sf_dir).fct_orders)


@query("kpi_overall")
def _kpi(spark, sf_dir):
    return marts.kpi_overall(house(spark, sf_dir).fct_orders)


@query("table_row_counts")
def _row_counts(spark, sf_dir):
    return tables.row_counts(house(spark, sf_dir).raw)


@query("latest_enrichment")
def _latest(spark, sf_dir):
    return ranking.latest_enrichment(sample.review_enriched(spark, sf_dir))


# ---------------------------------------------------------------------- quality
@query("dq_unique")
def _dq_unique(spark, sf_dir):
    items = house(spark, sf_dir).stg_order_items
    return quality.unique_failures(items, "order_id").select("value", "copies")


@query("dq_not_null")
def _dq_not_null(spark, sf_dir):
    return quality.not_null_failures(house(spark, sf_dir).fct_orders, "restaurant_id").select("order_id", "restaurant_id")


@query("dq_relationships")
def _dq_relationships(spark, sf_dir):
    wh = house(spark, sf_dir)
    return quality.relationship_failures(wh.stg_order_items, "order_id", wh.stg_orders, "order_id")


@query("dq_accepted_values")
def _dq_accepted(spark, sf_dir):
    return quality.accepted_value_failures(house(spark, sf_dir).fct_orders, "order_status", ("Delivered", "Cancelled"))


@query("dq_order_fact")
def _dq_order_fact(spark, sf_dir):
    wh = house(spark, sf_dir)
    return quality.order_fact_violations(wh.fct_orders, wh.dim_customer)


@query("id_set_diff")
def _id_set_diff(spark, sf_dir):
    wh = house(spark, sf_dir)
    reviews = wh.raw["reviews"].select(F.col("review_id").cast("string").alias("review_id"))
    return quality.id_set_diff(reviews, wh.review_enriched, "review_id")


# -------------------------------------------------------------------- catalogue
@query("cities_by_gmv")
def _c1(spark, sf_dir):
    return catalogue.cities_by_gmv(house(spark, sf_dir).mart_daily_city_revenue)


@query("cuisines_by_orders")
def _c2(spark, sf_dir):
    return catalogue.cuisines_by_orders(house(spark, sf_dir).mart_cuisine_performance)


@query("restaurants_by_revenue")
def _c3a(spark, sf_dir):
    return catalogue.restaurants_by(house(spark, sf_dir).mart_restaurant_performance, "revenue")


@query("restaurants_by_orders")
def _c3b(spark, sf_dir):
    return catalogue.restaurants_by(house(spark, sf_dir).mart_restaurant_performance, "orders")


@query("restaurants_by_rating")
def _c3c(spark, sf_dir):
    return catalogue.restaurants_by(house(spark, sf_dir).mart_restaurant_performance, "rating")


@query("best_restaurant_per_city")
def _c4(spark, sf_dir):
    return catalogue.best_restaurant_per_city(house(spark, sf_dir).mart_restaurant_performance)


@query("delivery_time_by_city")
def _c5(spark, sf_dir):
    return catalogue.delivery_time_by_city(house(spark, sf_dir).fct_orders)


@query("fastest_cities")
def _c5b(spark, sf_dir):
    return catalogue.fastest_cities(house(spark, sf_dir).fct_orders)


@query("cities_by_cancellation")
def _c6(spark, sf_dir):
    return catalogue.cities_by_cancellation(house(spark, sf_dir).fct_orders)


@query("negative_topics")
def _c7a(spark, sf_dir):
    return catalogue.negative_topics(ranking.latest_enrichment(sample.review_enriched(spark, sf_dir)))


@query("common_complaints")
def _c7b(spark, sf_dir):
    return catalogue.common_complaints(ranking.latest_enrichment(sample.review_enriched(spark, sf_dir)))


@query("sentiment_summary")
def _c8(spark, sf_dir):
    return catalogue.sentiment_summary(ranking.latest_enrichment(sample.review_enriched(spark, sf_dir)))


@query("highest_spending_customers")
def _c9(spark, sf_dir):
    return catalogue.highest_spending_customers(house(spark, sf_dir).mart_customer_performance)


@query("payment_methods_by_orders")
def _c11(spark, sf_dir):
    return catalogue.payment_methods_by_orders(house(spark, sf_dir).mart_payment_performance)


@query("reviews_with_enrichment")
def _c12(spark, sf_dir):
    wh = house(spark, sf_dir)
    return catalogue.reviews_with_enrichment(wh.raw["reviews"], ranking.latest_enrichment(wh.review_enriched))


@query("top_restaurant_reviews")
def _h1(spark, sf_dir):
    wh = house(spark, sf_dir)
    found = catalogue.reviews_of_top_restaurant(wh.mart_restaurant_performance, wh.raw["reviews"], "revenue")
    return found.select("restaurant_name", "review_id", "rating", "comment")


@query("top_city_topics")
def _h2(spark, sf_dir):
    wh = house(spark, sf_dir)
    return catalogue.topics_in_city(catalogue.cities_by_gmv(wh.mart_daily_city_revenue, 1), wh.mart_review_insights)


@query("slowest_city_topics")
def _h2b(spark, sf_dir):
    wh = house(spark, sf_dir)
    slowest = catalogue.top(catalogue.delivery_time_by_city(wh.fct_orders), "avg_delivery_min", ["city"], 1)
    return catalogue.topics_in_city(slowest, wh.mart_review_insights)


@query("most_cancelled_city_topics")
def _h2c(spark, sf_dir):
    wh = house(spark, sf_dir)
    return catalogue.topics_in_city(catalogue.cities_by_cancellation(wh.fct_orders, 1), wh.mart_review_insights)


@query("best_cuisine_reviews")
def _h3(spark, sf_dir):
    wh = house(spark, sf_dir)
    return catalogue.reviews_of_best_cuisine(wh.mart_cuisine_performance, wh.fct_orders, wh.raw["reviews"])


# ------------------------------------------------------------- loads and copies
@query("load_csv_roundtrip")
def _load_csv(spark, sf_dir):
    orders = house(spark, sf_dir).raw["orders"]
    csv, out = scratch_path(spark, "orders-csv"), scratch_path(spark, "orders")
    tables.write_csv(orders, csv)
    return tables.load_csv(spark, csv, out, orders.schema)


@query("load_csv_texts")
def _load_csv_texts(spark, sf_dir):
    """Texts with quotes and line breaks survive the load."""
    reviews = house(spark, sf_dir).raw["reviews"].select("review_id", "rating", "comment")
    csv, out = scratch_path(spark, "reviews-csv"), scratch_path(spark, "reviews")
    tables.write_csv(reviews, csv)
    return tables.load_csv(spark, csv, out, reviews.schema, multi_line=True)


@query("load_menu_coerced")
def _load_menu(spark, sf_dir):
    """Two runs over the same directory; the second finds nothing new."""
    menu = house(spark, sf_dir).raw["menu"]
    csv, out, checkpoint = (scratch_path(spark, n) for n in ("menu-csv", "menu", "menu-checkpoint"))
    tables.write_csv(menu, csv)
    tables.append_csv_once(spark, csv, out, checkpoint, menu.schema)
    return tables.append_csv_once(spark, csv, out, checkpoint, menu.schema)


@query("bronze_copy")
def _bronze_copy(spark, sf_dir):
    """Every landing table copied, then counted from the copies."""
    copies = {}
    for name, df in house(spark, sf_dir).raw.items():
        path = scratch_path(spark, f"raw-{name}")
        tables.replace_table(df, path)
        copies[name] = spark.read.parquet(path)
    return tables.row_counts(copies)


@query("build_all")
def _build_all(spark, sf_dir):
    """The whole warehouse build; row counts of everything written."""
    return build_all(house(spark, sf_dir), scratch_path(spark, "warehouse"))


@query("published_build")
def _published_build(spark, sf_dir):
    """A mart as readers of the current build see it."""
    root = scratch_path(spark, "published")
    publish_build(house(spark, sf_dir), root)
    return spark.read.parquet(f"{current_build(spark, root)}/marts/mart_daily_city_revenue")


@query("lookup_by_ids")
def _lookup(spark, sf_dir):
    """Reviews whose id, as a string, occurs in the enrichment table."""
    wh = house(spark, sf_dir)
    found = tables.lookup_by_ids(wh.raw["reviews"], "review_id", wh.review_enriched.select("review_id"))
    return found.select("review_id", "rating", "review_date")


@query("review_dates")
def _review_dates(spark, sf_dir):
    """Dates as text, some of them broken, parsed leniently."""
    key = F.col("review_id")
    text = (
        F.when(key % 11 == 0, F.lit("not a date"))
        .when(key % 13 == 0, F.lit("2024-02-30"))
        .otherwise(F.date_format("review_date", "yyyy-MM-dd"))
    )
    reviews = house(spark, sf_dir).raw["reviews"].select("review_id", text.alias("review_date"))
    return tables.parse_review_dates(reviews)


@query("embedding_batch_scan")
def _batch_scan(spark, sf_dir):
    """Batches written in files of bounded size, read back without their vectors."""
    path = scratch_path(spark, "batches")
    reviews = house(spark, sf_dir).raw["reviews"].select("review_id", "rating", "comment", "review_date")
    tables.write_embedding_batches(reviews.join(sample.review_embeddings(spark, sf_dir), "review_id"), path, 100)
    return tables.embedding_batch_scan(tables.read_embedding_batches(spark, path))


# -------------------------------------------------------------- ordering, batches
@query("first_n_reviews")
def _first_n(spark, sf_dir):
    return batching.first_n(staging.usable_reviews(house(spark, sf_dir).raw["reviews"]), 100, as_text=True).select(
        F.col("review_id").cast("string").alias("review_id"), "rating", "comment"
    )


@query("keyset_page")
def _keyset(spark, sf_dir):
    """The third page of 50 usable reviews, found by the last id of the page before."""
    usable = staging.usable_reviews(house(spark, sf_dir).raw["reviews"]).select("review_id", "rating", "comment")
    last = None
    for _ in range(2):
        last = batching.keyset_page(usable.select("review_id"), "review_id", last, 50).agg(F.max("review_id")).first()[0]
    return batching.keyset_page(usable, "review_id", last, 50)


@query("stratified_sample")
def _stratified(spark, sf_dir):
    usable = staging.usable_reviews(house(spark, sf_dir).raw["reviews"])
    return batching.stratified_sample(usable, seed=7).select("stratum", "review_id", "rating", "comment")


@query("shard_reviews")
def _shards(spark, sf_dir):
    usable = staging.usable_reviews(house(spark, sf_dir).raw["reviews"])
    return batching.with_worker(usable, "review_id", 4).groupBy("worker").agg(
        F.count(F.lit(1)).alias("reviews"), F.min("review_id").alias("first_id"), F.max("review_id").alias("last_id")
    )


@query("batch_reviews")
def _batches(spark, sf_dir):
    usable = staging.usable_reviews(house(spark, sf_dir).raw["reviews"]).select("review_id", "rating", "comment")
    batches = batching.request_payloads(batching.with_batch(usable, "review_id", 15, workers=3))
    parsed = F.from_json("payload", "array<struct<review_id:bigint,rating:bigint,comment:string>>")
    return batches.select(
        "worker",
        "batch_no",
        "reviews",
        F.array_join(F.transform("review_ids", lambda i: i.cast("string")), ",").alias("review_ids"),
        F.md5(
            F.array_join(F.transform(parsed, lambda i: F.concat_ws("|", i["review_id"], i["rating"], i["comment"])), "\n")
        ).alias("contents"),
    )


# --------------------------------------------------------------------- enrichment
def _parsed(spark, sf_dir):
    return enrichment.response_parse(sample.model_responses(spark, sf_dir))


def _validated(spark, sf_dir):
    return enrichment.response_validate(_parsed(spark, sf_dir), sample.request_batches(spark, sf_dir))


@query("unprocessed_reviews")
def _unprocessed(spark, sf_dir):
    wh = house(spark, sf_dir)
    return enrichment.unprocessed_reviews(wh.raw["reviews"], wh.review_enriched)


@query("enrich_coverage")
def _coverage(spark, sf_dir):
    wh = house(spark, sf_dir)
    return enrichment.enrich_coverage(staging.usable_reviews(wh.raw["reviews"]), wh.review_enriched)


@query("response_parse")
def _response_parse(spark, sf_dir):
    return enrichment.response_items(_parsed(spark, sf_dir)).drop("seconds", "priority")


@query("response_validate")
def _response_validate(spark, sf_dir):
    return _validated(spark, sf_dir).drop("raw", "items", "seconds")


@query("response_scorecard")
def _scorecard(spark, sf_dir):
    responses = sample.model_responses(spark, sf_dir).drop("seconds")
    return enrichment.response_scorecard(responses, sample.request_batches(spark, sf_dir))


@query("first_valid_model")
def _first_valid(spark, sf_dir):
    return enrichment.first_valid_model(_validated(spark, sf_dir)).select("batch_id", "model", "priority")


@query("attempts_used")
def _attempts(spark, sf_dir):
    tries = _validated(spark, sf_dir).select("batch_id", "priority", F.lit(1).alias("attempt"), enrichment.attempt_status().alias("status"))
    return enrichment.attempts_used(tries)


def _tries(spark, sf_dir) -> DataFrame:
    """The log of one run over all open reviews with a model that recovers and one that stays bad for some."""
    path, log, wh = scratch_path(spark, "enriched"), scratch_path(spark, "attempts"), house(spark, sf_dir)
    tables.replace_table(wh.review_enriched, path)
    models = {"recovering": sample.recovering_model, "spare": sample.spare_model}
    enrichment.run_enrichment(spark, wh.raw["reviews"], path, models, "2024-07-01 00:00:00", log_path=log)
    return spark.read.schema(enrichment.ATTEMPT_SCHEMA).parquet(log)


@query("enrichment_attempts")
def _enrichment_attempts(spark, sf_dir):
    """Every try of a run: one row per batch, model and attempt."""
    return _tries(spark, sf_dir).select("batch_id", "model", "attempt", "status", "reviews")


@query("enrichment_attempts_used")
def _enrichment_attempts_used(spark, sf_dir):
    return enrichment.attempts_used(_tries(spark, sf_dir))


@query("enrichment_run_log")
def _enrichment_run_log(spark, sf_dir):
    return enrichment.run_log(_tries(spark, sf_dir))


@query("model_run_stats")
def _run_stats(spark, sf_dir):
    return enrichment.model_run_stats(_validated(spark, sf_dir))


@query("response_time_summary")
def _times(spark, sf_dir):
    return enrichment.response_time_summary(sample.model_responses(spark, sf_dir))


def _comparison(spark, sf_dir):
    items = enrichment.response_items(_validated(spark, sf_dir).filter("valid").select("batch_id", "model", "items"))
    return enrichment.model_compare(
        items.filter(F.col("model") == sample.MODELS[0]), items.filter(F.col("model") == sample.MODELS[2])
    )


@query("model_compare")
def _model_compare(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query("model_agreement")
def _agreement(spark, sf_dir):
    return enrichment.model_agreement(_comparison(spark, sf_dir))


def _clean_rows(spark, sf_dir):
    accepted = enrichment.first_valid_model(_validated(spark, sf_dir)).select("batch_id", "model", "items")
    return enrichment.enrich_clean(
        enrichment.response_items(accepted), F.col("model"), F.lit("2024-07-01 00:00:00")
    )


@query("enrich_clean")
def _enrich_clean(spark, sf_dir):
    return _clean_rows(spark, sf_dir)


@query("enrich_append")
def _enrich_append(spark, sf_dir):
    """Valid answers appended to the stored enrichment, twice; the second time adds nothing."""
    path = scratch_path(spark, "enriched")
    stored = sample.review_enriched(spark, sf_dir)
    tables.replace_table(stored, path)
    for _ in range(2):
        target = spark.read.schema(stored.schema).parquet(path)
        tables.append_table(enrichment.not_yet_written(_clean_rows(spark, sf_dir), target), path)
    return spark.read.schema(stored.schema).parquet(path)


@query("enrichment_run")
def _enrichment_run(spark, sf_dir):
    """One whole run over all open reviews with two stand-in models, of which one fails and one answers
    badly now and then; the rows it stored."""
    path, wh = scratch_path(spark, "enriched"), house(spark, sf_dir)
    tables.replace_table(wh.review_enriched, path)
    models = {"steady": sample.steady_model, "spare": sample.spare_model}
    enrichment.run_enrichment(spark, wh.raw["reviews"], path, models, "2024-07-01 00:00:00")
    stored = spark.read.schema(wh.review_enriched.schema).parquet(path)
    return stored.filter(F.col("model_used").isin(*models))


@query("stream_enrich")
def _stream_enrich(spark, sf_dir):
    """Reviews arrive in two loads; two shards enrich what came with each load, in turns."""
    wh = house(spark, sf_dir)
    source, root, reviews = scratch_path(spark, "review-files"), scratch_path(spark, "enriched-stream"), wh.raw["reviews"]
    late = F.pmod(F.xxhash64("review_id"), F.lit(3)) == 0
    for load, turns in ((reviews.filter(~late), (0, 1)), (reviews.filter(late), (1, 0))):
        tables.append_table(load, source)
        for shard in turns:
            jobs.stream_enrich(
                spark, source, reviews.schema, root, {"plain": sample.plain_model}, "2024-07-01 00:00:00", wh.review_enriched, shard, 2
            )
    return jobs.stream_enriched(spark, root)


@query("response_validate_strict")
def _strict(spark, sf_dir):
    """Answers whose topics must come from the fixed list."""
    checked = enrichment.response_validate(
        _parsed(spark, sf_dir), sample.request_batches(spark, sf_dir), topics=enrichment.TOPICS
    )
    return checked.select("batch_id", "model", "priority", "valid")


# ------------------------------------------------------------- questions and routes
@query("query_intents")
def _intents(spark, sf_dir):
    return retrieval.query_intents(sample.question_log(spark, sf_dir)).drop("question")


@query("question_category")
def _category(spark, sf_dir):
    return evaluation.question_category(sample.full_question_log(spark, sf_dir)).drop("question")


@query("domain_flag")
def _domain(spark, sf_dir):
    return evaluation.domain_flag(sample.full_question_log(spark, sf_dir)).drop("question")


@query("sql_audit")
def _sql_audit(spark, sf_dir):
    return evaluation.sql_audit(sample.sql_log(spark, sf_dir))


@query("route_validate")
def _route_validate(spark, sf_dir):
    return evaluation.route_validate(sample.route_responses(spark, sf_dir))


@query("route_confusion")
def _route_confusion(spark, sf_dir):
    return evaluation.route_confusion(sample.route_cases(spark, sf_dir))


@query("route_accuracy")
def _route_accuracy(spark, sf_dir):
    return evaluation.route_accuracy(sample.route_cases(spark, sf_dir))


# ----------------------------------------------------------------- text operators
def _featured(spark, sf_dir):
    reviews = house(spark, sf_dir).raw["reviews"].select("review_id", "comment")
    return dedupe.with_text_features(reviews)


@query("normalize_text")
def _normalize(spark, sf_dir):
    return _featured(spark, sf_dir).select("review_id", "normalized", F.size("tokens").alias("token_count"))


@query("token_jaccard")
def _jaccard(spark, sf_dir):
    """Similarity of every review to the one before it."""
    rows = _featured(spark, sf_dir).select("review_id", "tokens")
    before = rows.select((F.col("review_id") + 1).alias("review_id"), F.col("tokens").alias("before"))
    return rows.join(before, "review_id").select(
        "review_id", X.jaccard(F.col("tokens"), F.col("before")).alias("similarity")
    )


@query("term_match")
def _term_match(spark, sf_dir):
    return _featured(spark, sf_dir).select(
        "review_id", *[X.matches_terms(F.col("tokens"), terms).alias(name) for name, terms in X.TERM_FAMILIES.items()]
    )


@query("review_pattern")
def _pattern(spark, sf_dir):
    return _featured(spark, sf_dir).select("review_id", "pattern")


@query("pattern_distribution")
def _distribution(spark, sf_dir):
    return retrieval.pattern_distribution(house(spark, sf_dir).raw["reviews"].select("review_id", "comment"))


@query("duplicate_comment_stats")
def _duplicates(spark, sf_dir):
    return retrieval.duplicate_comment_stats(house(spark, sf_dir).raw["reviews"])


# -------------------------------------------------------------- embedding table
DIMENSION = 64


def _with_broken(spark, sf_dir):
    """The vectors, some replaced by each kind of broken one."""
    vector, key = F.col("embedding"), F.col("review_id")
    return sample.review_embeddings(spark, sf_dir).withColumn(
        "embedding",
        F.when(key % 50 == 1, F.lit(None))
        .when(key % 50 == 2, F.slice(vector, 1, 10))
        .when(key % 50 == 3, F.transform(vector, lambda x: F.lit(float("nan")).cast("float")))
        .when(key % 50 == 4, F.transform(vector, lambda x: F.lit(0.0).cast("float")))
        .otherwise(vector),
    )


def _embedding_batches(spark, sf_dir):
    """All vectors as batch 0 and those of one label again, reversed, as batch 1."""
    rows = sample.table(spark, sf_dir, "embeddings")
    first = rows.select(F.col("vec_id").alias("review_id"), "embedding", F.lit(0).alias("batch"))
    again = rows.filter("label = 0").select(
        F.col("vec_id").alias("review_id"), F.reverse("embedding").alias("embedding"), F.lit(1).alias("batch")
    )
    return first.unionByName(again)


def _vector_digest(df: DataFrame, *keys: str) -> DataFrame:
    """Numbers that identify a vector: size, ends, sum and length."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return df.select(
        *keys,
        F.size("embedding").alias("dimension"),
        F.round(F.element_at(vector, 1), 6).alias("first_value"),
        F.round(F.element_at(vector, -1), 6).alias("last_value"),
        F.round(total, 6).alias("total"),
        F.round(V.norm(F.col("embedding")), 6).alias("length"),
    )


@query("embedding_quality")
def _embedding_quality(spark, sf_dir):
    return index.embedding_quality(_with_broken(spark, sf_dir), DIMENSION)


@query("embedding_quarantine")
def _quarantine(spark, sf_dir):
    _, bad = index.split_embeddings(_with_broken(spark, sf_dir), DIMENSION)
    return bad.select("review_id", F.array_join("problems", "|").alias("problems"))


@query("embedding_normalize")
def _embedding_normalize(spark, sf_dir):
    doubled = sample.review_embeddings(spark, sf_dir).withColumn(
        "embedding", F.transform("embedding", lambda x: x * F.lit(3.0))
    )
    return _vector_digest(index.embedding_normalize(doubled), "review_id")


@query("index_dedupe")
def _index_dedupe(spark, sf_dir):
    return _vector_digest(index.index_dedupe(_embedding_batches(spark, sf_dir), ["batch"]), "review_id", "batch")


@query("index_first_in_file")
def _index_first_in_file(spark, sf_dir):
    """Vectors of label 0 stand twice in the batch files, reversed at first; the first row in file and row order stays."""
    rows, path = sample.table(spark, sf_dir, "embeddings"), scratch_path(spark, "vector-files")
    all_rows = rows.select(F.col("vec_id").alias("review_id"), "embedding", F.lit(1).alias("copy"))
    turned = rows.filter("label = 0").select(
        F.col("vec_id").alias("review_id"), F.reverse("embedding").alias("embedding"), F.lit(0).alias("copy")
    )
    in_order = all_rows.unionByName(turned).repartitionByRange("review_id").sortWithinPartitions("review_id", "copy")
    tables.write_embedding_batches(in_order, path)
    batches = tables.read_embedding_batches(spark, path)
    return _vector_digest(index.index_dedupe(batches, ["batch_file", "batch_position"]), "review_id", "copy")


@query("index_metadata")
def _index_metadata(spark, sf_dir):
    path = scratch_path(spark, "index")
    return index.build_index(spark, _embedding_batches(spark, sf_dir), ["batch"], DIMENSION, path)


@query("index_validation")
def _index_validation(spark, sf_dir):
    path = scratch_path(spark, "index")
    vectors = sample.review_embeddings(spark, sf_dir)
    tables.replace_table(index.embedding_normalize(vectors), path)
    return index.index_validation(spark.read.parquet(path), vectors.count(), DIMENSION)


@query("vector_upsert")
def _upsert(spark, sf_dir):
    batches = _embedding_batches(spark, sf_dir).withColumnRenamed("batch", "version")
    current, incoming = batches.filter("version = 0"), batches.filter("version = 1")
    root = scratch_path(spark, "snapshots")
    for batch in (current, incoming, incoming):  # repeating an upsert changes nothing
        index.publish_upsert(spark, root, batch)
    return _vector_digest(index.current_vectors(spark, root), "review_id", "version")


@query("ingest_violations")
def _violations(spark, sf_dir):
    reviews = house(spark, sf_dir).raw["reviews"].select(
        F.floor(F.col("review_id") / 100).alias("batch"), "review_id", "comment"
    )
    broken = reviews.filter("batch = 1").select(
        "batch", F.when(F.col("review_id") % 3 != 0, F.col("review_id")).alias("review_id"), "comment"
    )
    return index.ingest_violations(reviews.unionByName(broken))


@query("index_coverage")
def _index_coverage(spark, sf_dir):
    wh = house(spark, sf_dir)
    usable = staging.usable_reviews(wh.raw["reviews"])
    return index.index_coverage(usable, sample.review_embeddings(spark, sf_dir), wh.review_enriched)


# ------------------------------------------------------------------------ retrieval
WIDEST = dedupe.LEVELS[-1]


def _queries(spark, sf_dir) -> tuple[DataFrame, int]:
    """The query vectors, computed once, and how many there are."""
    vectors = settle(sample.query_embeddings(spark, sf_dir))
    return vectors, vectors.count()


def _ranked(spark, sf_dir, k=WIDEST, min_score=None) -> tuple[DataFrame, int]:
    """Top-k candidates, written once because several steps read them, and their proven row bound.

    Steps that drop all below the relevance floor pass it on, so that such rows never leave the scan.
    """
    queries, n = _queries(spark, sf_dir)
    return settle(vector_search.vector_topk(queries, sample.review_embeddings(spark, sf_dir), k, min_score)), n * k


def _hydrated(spark, sf_dir, text_features=False):
    wh = house(spark, sf_dir)
    ranked, bound = _ranked(spark, sf_dir, min_score=retrieval.MIN_RELEVANCE)
    relevant = settle(retrieval.adaptive_threshold(ranked))
    return retrieval.hydrate_candidates(relevant, wh.raw["reviews"], wh.review_enriched, bound, text_features)


def _steps(spark, sf_dir) -> retrieval.Evidence:
    wh = house(spark, sf_dir)
    queries, n = _queries(spark, sf_dir)
    return retrieval.evidence_steps(
        sample.questions(spark, sf_dir), queries, sample.review_embeddings(spark, sf_dir), wh.raw["reviews"],
        wh.review_enriched, n,
    )


def _pool(spark, sf_dir):
    return _steps(spark, sf_dir).pool


@query("vector_topk")
def _vector_topk(spark, sf_dir):
    queries, _ = _queries(spark, sf_dir)
    return vector_search.vector_topk(queries, sample.review_embeddings(spark, sf_dir), 5)


@query("vector_topk_lsh")
def _vector_topk_lsh(spark, sf_dir):
    """Approximate top-5 over each query's probed cells: rows scored, and the overlap with the exact result."""
    queries, _ = _queries(spark, sf_dir)
    corpus, cells = sample.review_embeddings(spark, sf_dir), scratch_path(spark, "cells")
    bits = vector_search.cell_bits(corpus.count())
    vector_search.write_cells(corpus, cells, bits)
    found = vector_search.vector_topk_lsh(queries, cells, 5, bits)
    hits = vector_search.recall(found, vector_search.vector_topk(queries, corpus, 5))
    return hits.join(vector_search.rows_scored(queries, cells, bits), "query_id")


@query("vector_topk_all_cells")
def _vector_topk_all_cells(spark, sf_dir):
    """The partitioned search with every cell probed, which is exact."""
    queries, _ = _queries(spark, sf_dir)
    cells = scratch_path(spark, "cells")
    corpus = sample.review_embeddings(spark, sf_dir)
    bits = vector_search.cell_bits(corpus.count())
    vector_search.write_cells(corpus, cells, bits)
    return vector_search.vector_topk_lsh(queries, cells, 5, bits, probes=1 << bits)


@query("vector_topk_lists")
def _vector_topk_lists(spark, sf_dir):
    """Inverted lists asked for the ten nearest of every row whose id 50 divides: does the search hold its recall, and at what cost?"""
    corpus = sample.review_embeddings(spark, sf_dir)
    asked = corpus.filter("review_id % 50 = 0").select(F.col("review_id").alias("query_id"), "embedding")
    report = inverted_lists.recall_report(asked, corpus, 10)
    return report.select(
        "queries", "expected", "table_rows", "indexed_rows",
        F.expr("found >= 0.9 * expected").alias("recall_reached"),
        F.expr("rows_scored < 0.5 * queries * table_rows").alias("under_half"),
    )


@query("vector_topk_all_lists")
def _vector_topk_all_lists(spark, sf_dir):
    """The search with every list probed, which is exact."""
    queries, _ = _queries(spark, sf_dir)
    path, corpus = scratch_path(spark, "inverted-lists"), sample.review_embeddings(spark, sf_dir)
    inverted_lists.build_lists(corpus, path, 5)
    return inverted_lists.search_lists(queries, path, 5, probes=inverted_lists.MOST_LISTS)


@query("adaptive_threshold")
def _adaptive(spark, sf_dir):
    return retrieval.adaptive_threshold(_ranked(spark, sf_dir, min_score=retrieval.MIN_RELEVANCE)[0])


@query("hydrate_candidates")
def _hydrate(spark, sf_dir):
    return _hydrated(spark, sf_dir).drop("threshold")


@query("hydrate_left_ranked")
def _hydrate_left(spark, sf_dir):
    ranked, bound = _ranked(spark, sf_dir, 20)
    return retrieval.hydrate_left_ranked(ranked, house(spark, sf_dir).raw["reviews"], bound)


@query("retrieval_diagnostics")
def _diagnostics(spark, sf_dir):
    return retrieval.retrieval_diagnostics(_hydrate_left(spark, sf_dir))


@query("evidence_validity")
def _validity(spark, sf_dir):
    return retrieval.evidence_validity(_hydrate_left(spark, sf_dir))


@query("intent_rating_filter")
def _rating_filter(spark, sf_dir):
    intents = retrieval.query_intents(sample.questions(spark, sf_dir))
    return retrieval.intent_rating_filter(_hydrated(spark, sf_dir), intents).select("query_id", "review_id", "rating")


@query("intent_term_filter")
def _term_filter(spark, sf_dir):
    intents = retrieval.query_intents(sample.questions(spark, sf_dir))
    featured = _hydrated(spark, sf_dir, text_features=True)
    return retrieval.intent_term_filter(featured, intents).select("query_id", "review_id", "pattern")


@query("exact_dedupe")
def _exact(spark, sf_dir):
    featured = _hydrated(spark, sf_dir, text_features=True)
    return dedupe.exact_dedupe(featured).select("query_id", "review_id", "score")


@query("near_dedupe")
def _near(spark, sf_dir):
    return dedupe.near_dedupe(dedupe.exact_dedupe(_hydrated(spark, sf_dir, text_features=True)))


def _all_near_duplicates(spark, sf_dir):
    return similarity.near_duplicates(staging.usable_reviews(house(spark, sf_dir).raw["reviews"]))


@query("near_duplicate_classes")
def _near_classes(spark, sf_dir):
    """Every usable review with its class of equal token sets and the number of similar classes."""
    return _all_near_duplicates(spark, sf_dir)[0]


@query("near_duplicate_pairs")
def _near_pairs(spark, sf_dir):
    """All pairs of similar classes of usable reviews."""
    return _all_near_duplicates(spark, sf_dir)[1]


def _wide_pool(spark, sf_dir):
    """The WIDEST best reviews with text of every query: the largest pools of the retrieval.

    WIDEST is the last retrieval level, 5,000; smaller tables are candidates as a whole.
    """
    wh = house(spark, sf_dir)
    corpus = sample.review_embeddings(spark, sf_dir)
    ranked, bound = _ranked(spark, sf_dir)
    rows = retrieval.hydrate_candidates(
        ranked, wh.raw["reviews"], wh.review_enriched, bound, text_features=True
    )
    return settle(retrieval.with_vectors(dedupe.exact_dedupe(rows), corpus, bound))


@query("near_dedupe_wide")
def _near_wide(spark, sf_dir):
    return dedupe.near_dedupe(_wide_pool(spark, sf_dir))


@query("diverse_select_wide")
def _diverse_wide(spark, sf_dir):
    return dedupe.diverse_select(_wide_pool(spark, sf_dir))


@query("diverse_select_strict")
def _diverse_strict(spark, sf_dir):
    """A low vector threshold, a pattern cap of one and 40 picks make every rule of the selection bite."""
    strict = dedupe.Selection(vector_duplicate=0.2, dominant_share=0.1, max_same_pattern=1, final_k=40)
    return dedupe.diverse_select(_wide_pool(spark, sf_dir), strict)


@query("progressive_retrieve_wide")
def _progressive_wide(spark, sf_dir):
    """Small levels and more picks than the first ones hold, so that the retrieval widens."""
    wide = dedupe.Selection(vector_duplicate=0.12, levels=(5, 20, 60, 150, WIDEST), final_k=12)
    return _stages(dedupe.progressive_select(_wide_pool(spark, sf_dir), sample.questions(spark, sf_dir), wide))


@query("diverse_select")
def _diverse(spark, sf_dir):
    return dedupe.diverse_select(_pool(spark, sf_dir))


@query("progressive_retrieve")
def _progressive(spark, sf_dir):
    return _stages(dedupe.progressive_select(_pool(spark, sf_dir), sample.questions(spark, sf_dir)))


def _stages(stages: DataFrame) -> DataFrame:
    return stages.select(
        "query_id", "level", "stopped_early", "distinct_texts", "near_duplicates_removed",
        F.array_join(F.transform("selected", lambda r: r.cast("string")), ",").alias("selected"),
        F.size("selected").alias("selected_count"),
        F.array_join("dominant_patterns", ",").alias("dominant_patterns"),
        F.array_join(
            F.transform(F.array_sort(F.map_entries("distribution")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
        ).alias("distribution"),
    )


@query("retrieval_steps")
def _retrieval_steps(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return retrieval.step_counts(steps, dedupe.progressive_select(steps.pool, sample.questions(spark, sf_dir)))


def _restaurant_evidence(measure: str) -> Query:
    """Evidence for every question from the reviews of the best restaurant only."""

    def build(spark, sf_dir):
        wh = house(spark, sf_dir)
        queries, n = _queries(spark, sf_dir)
        corpus = catalogue.corpus_of_top_restaurant(
            wh.mart_restaurant_performance, wh.raw["reviews"], sample.review_embeddings(spark, sf_dir), measure
        )
        asked = sample.questions(spark, sf_dir)
        # One restaurant has few reviews: a lower floor and a wider window than for the whole corpus.
        steps = retrieval.evidence_steps(
            asked, queries, settle(corpus), wh.raw["reviews"], wh.review_enriched, n, min_relevance=0.1, window=0.3
        )
        evidence = retrieval.selected_evidence(dedupe.progressive_select(steps.pool, asked), steps.pool)
        return retrieval.format_evidence(asked, evidence)

    return build


for _measure in catalogue.RESTAURANT_MEASURES:
    query(f"top_restaurant_evidence_{_measure}")(_restaurant_evidence(_measure))


@query("mmr_rerank")
def _mmr(spark, sf_dir):
    ranked, bound = _ranked(spark, sf_dir, 40)
    return dedupe.mmr_rerank(retrieval.with_vectors(ranked, sample.review_embeddings(spark, sf_dir), bound))


@query("format_evidence")
def _format_evidence(spark, sf_dir):
    pool = _pool(spark, sf_dir)
    asked = sample.questions(spark, sf_dir)
    evidence = retrieval.selected_evidence(dedupe.progressive_select(pool, asked), pool)
    return retrieval.format_evidence(asked, evidence)


@query("format_context")
def _format_context(spark, sf_dir):
    ranked, bound = _ranked(spark, sf_dir, 5)
    wh = house(spark, sf_dir)
    return retrieval.format_context(
        retrieval.hydrate_candidates(ranked, wh.raw["reviews"], wh.review_enriched, bound)
    )


# ------------------------------------------------------------------------ streaming
def _review_batches(spark, sf_dir):
    reviews = staging.usable_reviews(house(spark, sf_dir).raw["reviews"])
    return reviews.select(F.floor(F.col("review_id") / 250).alias("batch"), "review_id", "comment")


def _letters(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, *[F.col("embedding")[i].cast("bigint").alias(f"count_{c}") for i, c in enumerate(sample.LETTERS)]
    )


@query("stream_embed")
def _stream_embed(spark, sf_dir):
    """Reviews arrive in two loads; the embedding stream runs after each and once more at the end."""
    source, out, checkpoint = (scratch_path(spark, n) for n in ("arrivals", "embedded", "embed-checkpoint"))
    reviews = _review_batches(spark, sf_dir)
    for load in (reviews.filter("batch = 0"), reviews.filter("batch > 0"), None):
        if load is not None:
            tables.append_table(load, source)
        jobs.stream_embed(
            spark, source, reviews.schema, out, checkpoint, sample.letter_embedding, len(sample.LETTERS)
        )
    return _letters(spark.read.parquet(out), "review_id")


def _ingest_source(spark, sf_dir) -> tuple[str, T.StructType]:
    source = scratch_path(spark, "ingest")
    reviews = _review_batches(spark, sf_dir)
    reviews.repartition("batch").write.partitionBy("batch").parquet(source)
    return source, reviews.schema


# Files of a micro-batch: a batch file has some 250 reviews, far too few to be worth the jobs of a micro-batch.
INGEST_BYTES = 256 << 20


@query("stream_ingest")
def _stream_ingest(spark, sf_dir):
    source, schema = _ingest_source(spark, sf_dir)
    points = jobs.stream_ingest(
        spark, source, schema, scratch_path(spark, "points"), sample.letter_embedding, len(sample.LETTERS),
        "reviews", "letters", bytes_per_batch=INGEST_BYTES,
    )
    return _letters(points, "review_id", "batch")


@query("ingest_plan")
def _ingest_plan(spark, sf_dir):
    """Batches found against the batches of an earlier, shorter run."""
    source, schema = _ingest_source(spark, sf_dir)
    found = spark.read.schema(schema).parquet(source)
    done = found.filter(F.col("batch") < 2).select("batch")
    return jobs.ingest_plan(found, done)
