"""Scans, filters, lists, windows and paging on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconlink import scale
from reconlink.functions import text as X
from reconlink.operators import relops as R
from reconlink.operators.dictmatch import filter_with_fallback as with_fallback
from reconlink.plans import results as RS
from reconlink.queries.registry import Tables, query
from reconlink.sources.registry import DEFAULT_BOOK, NAMED, QueryBook, Registry


def registry_of(t: Tables) -> Registry:
    """Regions as orgs, nations as units, orders as events, customers as the orders' persons."""
    orders = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return Registry(
        org=t.region.select(F.col("r_regionkey").alias("org_id"), F.lower("r_name").alias("short_name"), F.col("r_name").alias("full_name")),
        unit=t.nation.select(F.col("n_nationkey").alias("unit_id"), F.col("n_name").alias("name"), F.lit("").alias("short_name"), F.col("n_regionkey").alias("org_id")),
        event=orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("event_ts"), F.col("c_nationkey").alias("unit_id"),
                            F.col("o_orderstatus").alias("event_type"), F.col("o_orderpriority").alias("article")),
        person=t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("event_id"), F.col("c_name").alias("last"),
            F.lit("").alias("first"), F.lit("").alias("middle"), F.col("o_orderdate").cast("date").alias("birth")))


@query("scan_org_sorted", "SELECT r_regionkey AS org_id, lower(r_name) AS short_name, r_name AS full_name FROM region ORDER BY 2, 3")
def scan_org_sorted(t: Tables) -> DataFrame:
    return registry_of(t).orgs()


@query("scan_unit_optional_filter", """
SELECT 'all' AS asked, n_nationkey AS unit_id, n_name AS name, n_regionkey AS org_id FROM nation
UNION ALL SELECT 'one', n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1
""")
def scan_unit_optional_filter(t: Tables) -> DataFrame:
    r = registry_of(t)
    return r.units().withColumn("asked", F.lit("all")).unionByName(r.units(1).withColumn("asked", F.lit("one"))).drop("short_name")


@query("event_by_id", "SELECT event_id, user_id, event_type, value, props FROM events WHERE event_id = 42")
def event_by_id(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_id") == 42).select("event_id", "user_id", "event_type", "value", "props")


@query("events_in_window_newest_n", """
SELECT event_id, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
ORDER BY ts DESC, event_id LIMIT 500
""")
def events_in_window_newest_n(t: Tables) -> DataFrame:
    import datetime as dt

    rows = R.between(t.events, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
    return R.newest(rows, "ts", "event_id", 500).select("event_id", "user_id", "event_type")


@query("folded_name_lookup", """
SELECT o_orderkey AS event_id, o_orderstatus AS event_type FROM orders WHERE EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = o_custkey AND replace(lower(c_name), 'ё', 'е') = replace(lower('CUSTOMER#000000007'), 'ё', 'е'))

""")
def folded_name_lookup(t: Tables) -> DataFrame:
    return registry_of(t).events_by_person("CUSTOMER#000000007").select("event_id", "event_type")


@query("name_year_lookup", """
SELECT o_orderkey AS event_id, o_orderstatus AS event_type FROM orders WHERE year(o_orderdate) = 1997 AND EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = o_custkey AND lower(c_name) = 'customer#000000007')

""")
def name_year_lookup(t: Tables) -> DataFrame:
    return registry_of(t).events_by_person("Customer#000000007", birth_year=1997).select("event_id", "event_type")


@query("name_unit_lookup", """
SELECT o_orderkey AS event_id, c_nationkey AS unit_id FROM orders JOIN customer ON c_custkey = o_custkey
WHERE lower(c_name) = 'customer#000000007' AND c_nationkey = (SELECT c_nationkey FROM customer WHERE c_name = 'Customer#000000007')

""")
def name_unit_lookup(t: Tables) -> DataFrame:
    unit = t.customer.filter("c_name = 'Customer#000000007'").select("c_nationkey").scalar()
    return registry_of(t).events_by_person("Customer#000000007", unit_id=unit).select("event_id", "unit_id")


@query("semi_key_list", """
SELECT l_orderkey, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY l_orderkey
""")
def semi_key_list(t: Tables) -> DataFrame:
    keys = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(keys, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("exclude_null_or_empty", """
SELECT event_type, count(*) AS rows FROM events
WHERE NOT (nullif(CASE WHEN value < 10 THEN '' ELSE event_type END, 'view') IS NULL OR nullif(CASE WHEN value < 10 THEN '' ELSE event_type END, 'view') = '')
GROUP BY event_type
""")
def exclude_null_or_empty(t: Tables) -> DataFrame:
    rows = t.events.withColumn("note", F.nullif(F.when(F.col("value") < 10, "").otherwise(F.col("event_type")), F.lit("view")))
    return rows.filter(R.not_blank("note")).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("multi_column_search", """
SELECT DISTINCT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE contains(lower(s_name), 'n_1') OR contains(lower(n_name), 'n_1')
""")
def multi_column_search(t: Tables) -> DataFrame:
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return R.search(rows, ["s_name", "n_name"], "N_1", ["s_suppkey"])


@query("filter_with_fallback", """
SELECT 'found' AS scope, s_suppkey, (SELECT count(*) FROM supplier) AS total, (SELECT count(*) FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier)) AS after_filter, false AS fallback
FROM supplier WHERE s_nationkey = (SELECT min(s_nationkey) FROM supplier)
UNION ALL
SELECT 'none', s_suppkey, (SELECT count(*) FROM supplier), 0, true FROM supplier
""")
def filter_with_fallback(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_nationkey")
    smallest = rows.agg(F.min("s_nationkey")).first()[0]
    return with_fallback(rows, "s_nationkey", smallest).withColumn("scope", F.lit("found")).unionByName(
        with_fallback(rows, "s_nationkey", -1).withColumn("scope", F.lit("none"))).drop("s_nationkey")


@query("hydrate_children", """
SELECT o_orderkey, coalesce((SELECT string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS items
FROM orders
""")
def hydrate_children(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = R.children_list(t.orders.select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_partkey"], "list")
    text = F.array_join(F.transform("list", lambda i: F.concat(i["l_linenumber"].cast("string"), F.lit(":"), i["l_partkey"].cast("string"))), " ")
    return rows.select("o_orderkey", text.alias("items"))


@query("top_n_by_recency_column", """
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey)
  <= CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 5 END
""")
def top_n_by_recency_column(t: Tables) -> DataFrame:
    n = F.when(F.col("o_orderstatus") == "P", 2).otherwise(5)
    return R.top_per(t.orders, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.asc("o_orderkey")], n).select("o_custkey", "o_orderkey")


@query("best_score_default", """
SELECT c_custkey, coalesce(max(o_totalprice), 0) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def best_score_default(t: Tables) -> DataFrame:
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return t.customer.select("c_custkey").join(best, "c_custkey", "left").na.fill(0.0, ["best"])


@query("all_agree", """
SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS returned, count(*) FILTER (l_linestatus = 'F') AS filled,
       bool_and(l_linestatus = 'F') AS all_filled, round(coalesce(count(*) FILTER (l_linestatus = 'F') * 100.0 / nullif(count(*), 0), 0), 2) AS percent
FROM lineitem GROUP BY l_orderkey
""")
def all_agree(t: Tables) -> DataFrame:
    filled = F.count_if(F.col("l_linestatus") == "F")
    return t.lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("returned"), filled.alias("filled"),
        F.bool_and(F.col("l_linestatus") == "F").alias("all_filled"),
        F.round(F.coalesce(F.try_divide(filled * 100.0, F.count(F.lit(1))), F.lit(0.0)), 2).alias("percent"))


@query("fill_down", """
SELECT o_orderkey, last_value(nullif(trim(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus ELSE ' ' END), '') IGNORE NULLS)
  OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS carried FROM orders
""")
def fill_down(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("mark", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).otherwise(" "))
    return R.fill_down(rows, ["o_custkey"], ["o_orderkey"], "mark", "carried").select("o_orderkey", "carried")


@query("sequential_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events")
def sequential_index(t: Tables) -> DataFrame:
    return R.numbered(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], "idx").drop("user_id")


@query("latest_per_scope", """
SELECT o_custkey, o_orderstatus, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def latest_per_scope(t: Tables) -> DataFrame:
    return R.latest_per(t.orders, ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderstatus", "o_orderkey")


@query("one_active_per_scope", """
SELECT o_orderkey, o_totalprice > 200000 AND row_number() OVER (PARTITION BY o_custkey, o_totalprice > 200000 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS active
FROM orders
""")
def one_active_per_scope(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("active", F.col("o_totalprice") > 200000)
    return R.only_latest_active(rows, ["o_custkey"], "o_orderdate", "o_orderkey", "active").select("o_orderkey", "active")


def batches(t: Tables) -> DataFrame:
    """Orders as batches: the customer owns them, the status letter tells their state."""
    return t.orders.select(
        F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"),
        F.when(F.col("o_totalprice") > 100000, "stored").otherwise("").alias("package"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("finished_at"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("queued_at"),
        F.col("o_orderdate").alias("started_at"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("progress_done"),
        F.lit(300).alias("progress_total"))


@query("retain_n", """
SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC) > 2
""")
def retain_n(t: Tables) -> DataFrame:
    return RS.stale_packages(batches(t), keep=2).select("batch_id")


@query("queue_position", """
WITH o AS (SELECT o_orderkey AS batch_id, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status FROM orders),
u AS (SELECT batch_id, status, rank() OVER (ORDER BY o_orderdate) AS position FROM o WHERE status <> 'done')
SELECT o.batch_id, o.status, CASE o.status WHEN 'running' THEN 0 WHEN 'queued' THEN u.position END AS position FROM o LEFT JOIN u USING (batch_id)
""")
def queue_position(t: Tables) -> DataFrame:
    return RS.queue_position(batches(t)).select("batch_id", "status", "position")


@query("status_owner_filter", "SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey = 7")
def status_owner_filter(t: Tables) -> DataFrame:
    return RS.owned_queue(batches(t), 7).select("batch_id")


@query("progress_elapsed", """
SELECT o_orderkey AS batch_id,
  CAST(round_even(100.0 * greatest(least(CASE WHEN o_orderstatus = 'F' THEN 300 ELSE floor(o_totalprice / 1000) END, 300), 0) / 300, 0) AS INT) AS percent,
  greatest(CAST(epoch(coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END, TIMESTAMP '2000-01-01')) - epoch(o_orderdate) AS BIGINT), 0) AS elapsed_seconds
FROM orders
""")
def progress_elapsed(t: Tables) -> DataFrame:
    return RS.progress(batches(t), "2000-01-01 00:00:00").select("batch_id", "percent", "elapsed_seconds")


@query("paging", """
SELECT event_id, event_type, (SELECT count(*) FROM events) AS total, 3 AS page, 50 AS page_size, true AS has_next
FROM events ORDER BY event_id LIMIT 50 OFFSET 100
""")
def paging(t: Tables) -> DataFrame:
    return R.page(t.events.select("event_id", "event_type"), "event_id", 3, 50).drop("row_no")


@query("paging_clamped", """
WITH n AS (SELECT count(*) AS total FROM orders)
SELECT o_orderkey, total, CAST(ceil(total / 100) AS INT) AS page, 100 AS page_size, false AS has_next
FROM orders, n QUALIFY row_number() OVER (ORDER BY o_orderkey) > (ceil(total / 100) - 1) * 100
""")
def paging_clamped(t: Tables) -> DataFrame:
    return R.page(t.orders.select("o_orderkey"), "o_orderkey", 10**9, 5000).drop("row_no")


@query("merge_ranges", """
WITH r AS (SELECT l_orderkey, l_linenumber AS first, l_linenumber + CAST(floor(l_quantity / 25) AS INT) AS last FROM lineitem),
g AS (SELECT *, max(last) OVER (PARTITION BY l_orderkey ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT l_orderkey, min(first) AS first, max(last) AS last, count(*) AS parts FROM i GROUP BY l_orderkey, island
""")
def merge_ranges(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("first"),
                             (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 25).cast("int")).alias("last"))
    return R.merge_ranges(rows, ["l_orderkey"], "first", "last")


@query("merge_time_ranges", """
WITH r AS (SELECT user_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS first, CAST(epoch_us(ts) // 1000000 AS BIGINT) + 7200 AS last FROM events),
g AS (SELECT *, max(last) OVER (PARTITION BY user_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR first > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, min(first) AS first, max(last) AS last, count(*) AS parts FROM i GROUP BY user_id, island
""")
def merge_time_ranges(t: Tables) -> DataFrame:
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    rows = t.events.select("user_id", second.alias("first"), (second + 7200).alias("last"))
    return R.merge_ranges(rows, ["user_id"], "first", "last")


@query("best_record_dedupe", """
SELECT c_nationkey, c_mktsegment, c_custkey FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CASE WHEN c_acctbal > 5000 THEN 2 WHEN c_acctbal > 0 THEN 1 ELSE 0 END DESC, length(c_name) DESC, c_custkey) = 1
""")
def best_record_dedupe(t: Tables) -> DataFrame:
    rank = F.when(F.col("c_acctbal") > 5000, 2).when(F.col("c_acctbal") > 0, 1).otherwise(0)
    return R.best_record(t.customer, ["c_nationkey", "c_mktsegment"], [F.desc(rank), F.desc(F.length("c_name")), F.asc("c_custkey")]).select(
        "c_nationkey", "c_mktsegment", "c_custkey")


@query("first_non_empty", """
SELECT o_custkey AS batch_id, (SELECT count(*) FROM orders b WHERE b.o_custkey = a.o_custkey) AS items,
       first(o_orderpriority ORDER BY o_orderkey) FILTER (o_orderstatus = 'P' ) AS template_info FROM orders a GROUP BY o_custkey
""")
def first_non_empty(t: Tables) -> DataFrame:
    from reconlink.sources.sinks import batch_payload

    items = t.orders.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("idx"),
                            F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise("").alias("template_info"))
    return batch_payload(items.select("batch_id").distinct(), items)


@query("nulls_last", """
SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(value, round(value)) DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn <= 3
""")
def nulls_last(t: Tables) -> DataFrame:
    order = [F.desc_nulls_last(F.nullif(F.col("value"), F.round("value"))), F.asc("event_id")]
    return R.top_per(t.events, ["user_id"], order, 3, "rn").select("event_id", "rn")


@query("stale_children", "SELECT ps.l_orderkey, l_linenumber FROM lineitem ps WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')")
def stale_children(t: Tables) -> DataFrame:
    current = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.keep_current(t.lineitem.select("l_orderkey", "l_linenumber"), current, ["l_orderkey"])


@query("parent_lookup", """
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
""")
def parent_lookup(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("unit_with_parent", """
SELECT n_nationkey AS unit_id, n_name AS name, lower(r_name) AS org_short_name, r_name AS org_full_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey
""")
def unit_with_parent(t: Tables) -> DataFrame:
    r = registry_of(t)
    return r.with_parents(r.units()).select("unit_id", "name", "org_short_name", "org_full_name")


@query("children_per_parent", "SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def children_per_parent(t: Tables) -> DataFrame:
    return R.count_children(t.nation.select("n_nationkey", "n_name"), t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "suppliers")


@query("named_query", """
SELECT o_orderkey AS event_id, CAST(c_nationkey AS INT) AS unit_id, o_orderstatus AS event_type, o_orderpriority AS article
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'
ORDER BY o_orderdate DESC, o_orderkey LIMIT 500
""")
def named_query(t: Tables) -> DataFrame:
    registry_of(t).as_views()
    return DEFAULT_BOOK.run(t.spark, "event/by_time", from_ts="1997-01-01", to_ts="1997-06-30", limit=500).drop("event_ts")


@query("other_schema", """
SELECT DISTINCT o_orderkey AS event_id, CAST(c_nationkey AS INT) AS unit_id FROM orders JOIN customer ON c_custkey = o_custkey
WHERE lower(c_name) = 'customer#000000007' AND year(o_orderdate) = 1998 ORDER BY 1 DESC LIMIT 1000
""")
def other_schema(t: Tables) -> DataFrame:
    """The same texts over views with another prefix, found through the fallback book."""
    registry_of(t).as_views("resource_")
    book = QueryBook({}, schema="resource_", profile="prod", fallback=QueryBook(NAMED))
    return book.run(t.spark, "event/by_person", last="CUSTOMER#000000007", birth=None, birth_year=1998, limit=1000).select("event_id", "unit_id")


@query("optional_window", """
SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND user_id = 7
""")
def optional_window(t: Tables) -> DataFrame:
    import datetime as dt

    events = t.events.select("event_id", F.col("ts").alias("event_ts"), F.col("user_id").alias("unit_id"))
    empty = events.limit(0)
    r = Registry(org=empty, unit=empty, event=events, person=empty)
    return r.candidates(low=dt.datetime(1924, 1, 1), high=dt.datetime(2024, 1, 20), unit_id=7).select("event_id")


@query("within_hours", "SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) <= 24 * 3600000000")
def within_hours(t: Tables) -> DataFrame:
    events = t.events.select("event_id", F.col("ts").alias("event_ts"))
    empty = events.limit(0)
    return Registry(empty, empty, events, empty).close_to("2024-01-10 12:00:00").select("event_id")


@query("iequal_then_exact", """
SELECT p_partkey FROM part WHERE lower(trim(p_name)) = 'red widget' AND trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) = 'red widget'
""")
def iequal_then_exact(t: Tables) -> DataFrame:
    return t.part.filter((F.lower(F.trim("p_name")) == "red widget") & (X.category_fold("p_name") == "red widget")).select("p_partkey")


@query("scope_predicate", """
SELECT o_orderkey, coalesce(lower(trim(CASE o_orderstatus WHEN 'F' THEN ' General ' WHEN 'O' THEN NULL ELSE o_orderpriority END)), '') IN ('', 'general') AS everyone FROM orders
""")
def scope_predicate(t: Tables) -> DataFrame:
    scope = F.when(F.col("o_orderstatus") == "F", " General ").when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", X.is_general_scope(scope).alias("everyone"))


@query("distinct_composite", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_composite(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@query("segmented_running_sum", """
SELECT event_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events
""")
def segmented_running_sum(t: Tables) -> DataFrame:
    """Five keys only: each is cut into ranges so that no task scans a whole key."""
    rows = t.events.select("event_type", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return scale.segmented_scan(rows, ["event_type"], ["event_id"], {"running": ("sum", F.col("k"))}, parts=16).select("event_id", "running")
