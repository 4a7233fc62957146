"""Verdict columns and reference snapshots on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconlink.plans import refsync as RF, verdict as V
from reconlink.queries.registry import Tables, query
from reconlink.sources import sheets as SH


def decided(t: Tables) -> DataFrame:
    """Order lines as decided pairs: every verdict column comes from a field of the line."""
    li = t.lineitem
    f = F.col
    return li.select(
        f("l_orderkey").alias("mention_id"), f("l_linenumber").alias("idx"), f("l_partkey").alias("part"), f("l_suppkey").alias("supp"),
        (f("l_returnflag") != "R").alias("matched"), (f("l_quantity").cast("int") - 1).alias("delta_minutes"),
        F.when(f("l_tax") > 0.01, F.round(f("l_quantity") * 2, 2)).alias("unit_percent"),
        f("l_linenumber").alias("persons_registered"), F.least(f("l_linenumber"), F.lit(2)).alias("persons_matched"),
        F.lit(0).alias("persons_possible"), F.when(f("l_discount") > 0.05, 1).otherwise(0).alias("persons_missing_registry"),
        F.lit(0).alias("persons_missing_report"), F.when(f("l_linestatus") == "F", f("l_tax") > 0.04).alias("category_ok"),
        F.lit(None).cast("string").alias("article_light"), (f("l_discount") < 0.03).alias("article_ok"),
        F.concat_ws(" ", f("l_returnflag"), f("l_linestatus"), F.repeat(F.lit("text "), 20)).alias("text"))


LIGHTS = """
WITH b AS (SELECT l_orderkey AS mention_id, l_linenumber AS idx, l_partkey AS part, l_suppkey AS supp, l_returnflag <> 'R' AS matched, CAST(trunc(l_quantity) AS INT) - 1 AS delta,
  CASE WHEN l_tax > 0.01 THEN round(l_quantity * 2, 2) END AS pct, l_linenumber AS reg, least(l_linenumber, 2) AS hit, l_discount > 0.05 AS issue,
  CASE WHEN l_linestatus = 'F' THEN l_tax > 0.04 END AS cat, l_discount < 0.03 AS art FROM lineitem)
SELECT mention_id, idx, part, supp,
  CASE WHEN NOT matched THEN 'red' WHEN delta = 0 THEN 'green' WHEN abs(delta) <= 30 THEN 'yellow' ELSE 'red' END AS light_time,
  CASE WHEN pct IS NULL THEN 'red' WHEN pct >= 85 THEN 'green' WHEN pct >= 75 THEN 'yellow' ELSE 'red' END AS light_unit,
  CASE WHEN NOT matched THEN 'red' WHEN hit = reg AND NOT issue THEN 'green' WHEN hit = 0 AND (reg > 0 OR issue) THEN 'red' ELSE 'yellow' END AS light_persons,
  CASE WHEN cat THEN 'green' WHEN NOT cat THEN 'red' ELSE 'neutral' END AS light_category, CASE WHEN art THEN 'green' ELSE 'red' END AS light_article,
  'Событие ' || idx || CASE WHEN matched THEN '' ELSE ' — в базе данных не найдено' END AS title
FROM b"""
LIGHT_COLUMNS = ("mention_id", "idx", "part", "supp", "light_time", "light_unit", "light_persons", "light_category", "light_article", "title")


@query("lights", LIGHTS)
def lights(t: Tables) -> DataFrame:
    return V.with_lights(decided(t)).select(*LIGHT_COLUMNS)


@query("backfill_lights", LIGHTS)
def backfill_lights(t: Tables) -> DataFrame:
    """Stored lights of an older rule set are recomputed from the stored values."""
    old = {c: F.lit("stale") for c in ("light_time", "light_unit", "light_persons", "light_category", "light_article", "title", "preview")}
    return V.backfill(decided(t).withColumns(old)).select(*LIGHT_COLUMNS)


def compared(t: Tables) -> DataFrame:
    """Orders as decided pairs with both sides of every compared field."""
    f = F.col
    return t.orders.select(
        f("o_orderkey").alias("mention_id"), (f("o_orderstatus") != "P").alias("matched"), F.lit("type").alias("category"),
        f("o_orderstatus").alias("event_type"), (f("o_orderstatus") == "F").alias("category_ok"), F.lit("18.1 ч. 1").alias("article"),
        F.when(f("o_orderpriority") == "1-URGENT", "18.1 ч. 1").otherwise("20.3").alias("event_article"), F.lit("18.1 ч. 1").alias("rule_article"),
        F.when(f("o_orderpriority") != "5-LOW", f("o_orderpriority")).alias("unit_name"), f("o_orderpriority").alias("event_unit_name"),
        (f("o_orderpriority") != "5-LOW").alias("unit_ok"), (f("o_totalprice") > 250000).alias("persons_agree"), F.lit(2).alias("persons_expected"),
        (f("o_totalprice") < 100000).alias("time_mismatch"), F.floor(f("o_totalprice") / 1000).cast("long").alias("delta_minutes"),
        f("o_orderdate").alias("date_time"), f("o_orderdate").alias("event_ts"), (f("o_totalprice") > 50000).alias("time_found"),
        F.lit(2).alias("persons_matched"), F.lit(3).alias("persons_registered"))


ORDERS = """b AS (SELECT o_orderkey AS mention_id, o_orderstatus <> 'P' AS matched, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price, CAST(floor(o_totalprice / 1000) AS BIGINT) AS delta,
  strftime(o_orderdate, '%d.%m.%Y %H:%M') AS shown FROM orders)"""


@query("diff_struct", f"""
WITH {ORDERS}
SELECT mention_id, CASE WHEN matched AND st <> 'F' THEN st END AS category, CASE WHEN matched AND pr <> '1-URGENT' THEN '20.3' END AS article,
  matched AND pr = '5-LOW' AS unit_differs, matched AND price <= 250000 AS persons_differ, CASE WHEN matched AND price < 100000 THEN delta END AS time_delta FROM b
""")
def diff_struct(t: Tables) -> DataFrame:
    d = V.diffs(V.with_articles(compared(t)))
    return d.select(
        "mention_id", F.col("diffs.category.actual").alias("category"), F.col("diffs.article.actual").alias("article"),
        F.col("diffs.unit").isNotNull().alias("unit_differs"), F.col("diffs.persons").isNotNull().alias("persons_differ"),
        F.col("diffs.time.delta_minutes").alias("time_delta"))


@query("comments", f"""
WITH {ORDERS}, c AS (SELECT mention_id, CASE WHEN NOT matched THEN [
    'Событие не найдено.', CASE WHEN price <= 50000 THEN 'Не определилось время (использована только дата).' END, CASE WHEN pr = '5-LOW' THEN 'Подразделение не определено в сводке.' END]
  ELSE [
    CASE WHEN st = 'F' AND pr = '1-URGENT' AND price > 250000 THEN 'Расхождений не обнаружено.' END,
    CASE WHEN pr = '5-LOW' THEN 'Подразделение не определено в сводке.' END,
    CASE WHEN price <= 250000 THEN 'Нарушители отличаются от данных БД.' END,
    CASE WHEN st <> 'F' THEN 'Тип события отличается от классификации.' END,
    CASE WHEN pr <> '1-URGENT' THEN 'Статья закона отличается от данных БД.' END,
    CASE WHEN price < 100000 THEN 'Событие найдено по подразделению и нарушителям; дата/время отличаются' END,
    CASE WHEN price < 100000 THEN 'Δ времени: ' || delta || ' мин. Извлечено: ' || shown || ', портал: ' || shown || '.' END,
    CASE WHEN delta > 30 THEN 'Ошибка: расхождение даты/времени на ' || delta || ' мин (более 30 мин).' END,
    'Совпало нарушителей: 2 из 3.',
    CASE WHEN price <= 50000 THEN 'Не определилось время (использована только дата).' END] END AS l FROM b)
SELECT mention_id, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ' / ') AS comments FROM c
""")
def comments(t: Tables) -> DataFrame:
    rows = V.comments(V.diffs(V.with_articles(compared(t))))
    return rows.select("mention_id", F.array_join("comments", " / ").alias("comments"))


def plain(c):
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def stored_orgs(t: Tables) -> DataFrame:
    """What was stored before: suppliers in credit, some under an old name, some without a vector."""
    s = t.supplier.filter("s_acctbal > 2000")
    old = F.when(F.col("s_acctbal") > 8000, F.concat("s_name", F.lit(" old"))).otherwise(F.col("s_name"))
    return s.select(
        F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("short_name"), old.alias("full_name"), F.lower("s_name").alias("norm_short"),
        F.lower(old).alias("norm_full"), F.array(F.col("s_acctbal")).alias("short_embedding"),
        F.when(F.col("s_acctbal") > 3000, F.array(F.col("s_acctbal"))).alias("full_embedding"))


@query("snapshot_upsert", """
SELECT s_suppkey AS org_id, s_name AS short_name, s_name AS full_name, lower(s_name) AS norm_short, lower(s_name) AS norm_full,
       s_acctbal <= 3000 OR s_acctbal > 8000 AS needs_embedding, s_acctbal > 2000 AS has_vector FROM supplier WHERE s_acctbal < 9000
UNION ALL
SELECT s_suppkey, s_name, s_name || ' old', lower(s_name), lower(s_name || ' old'), false, true FROM supplier WHERE s_acctbal >= 9000
""")
def snapshot_upsert(t: Tables) -> DataFrame:
    incoming = t.supplier.filter("s_acctbal < 9000").select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("short_name"), F.col("s_name").alias("full_name"))
    out = RF.upsert_orgs(stored_orgs(t), incoming, fold=plain)
    return out.withColumn("has_vector", F.col("short_embedding").isNotNull()).drop("short_embedding", "full_embedding")


def part_units(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("name"), F.col("p_type").alias("short_name"), F.col("p_brand").alias("org_id"))


@query("hash_changed", """
SELECT p_partkey AS unit_id, CASE WHEN p_size <= 10 THEN 'added' WHEN p_size > 40 THEN 'changed' ELSE 'same' END AS state,
       p_size <= 10 OR p_size > 40 AS needs_embedding, p_size BETWEEN 11 AND 40 AS has_vector FROM part
""")
def hash_changed(t: Tables) -> DataFrame:
    described = RF.describe_units(part_units(t), fold=plain).withColumnRenamed("unit_id", "p_partkey").join(t.part.select("p_partkey", "p_size"), "p_partkey")
    stored = described.filter("p_size > 10").withColumnRenamed("p_partkey", "unit_id").withColumns({
        "source_hash": F.when(F.col("p_size") > 40, "old").otherwise(F.col("source_hash")), "embedding": F.array(F.lit(1.0))})
    out = RF.upsert_units(stored.drop("p_size"), part_units(t), encoder=False, fold=plain)
    return out.select("unit_id", "state", "needs_embedding", F.col("embedding").isNotNull().alias("has_vector"))


@query("alias_sync", """
SELECT p_partkey AS unit_id, p_name AS alias, lower(p_name) AS norm_alias FROM part WHERE p_size > 10
UNION ALL SELECT p_partkey, 'kept', 'kept' FROM part WHERE p_size <= 10
""")
def alias_sync(t: Tables) -> DataFrame:
    stored = t.part.select(F.col("p_partkey").alias("unit_id"), F.lit("kept").alias("alias"), F.lit("kept").alias("norm_alias"))
    synced = RF.describe_units(part_units(t).join(t.part.filter("p_size > 10").select(F.col("p_partkey").alias("unit_id")), "unit_id"))
    return RF.sync_aliases(stored, synced)


def sheet_of(t: Tables) -> DataFrame:
    """Parts as an import sheet: the type stands only where it changes to a big size."""
    return t.part.select(
        F.col("p_partkey").alias("row_no"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("type"),
        F.col("p_name").alias("pattern"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" ").alias("article"))


FILLED = """sheet AS (SELECT p_partkey AS row_no, last_value(CASE WHEN p_size > 25 THEN p_type END IGNORE NULLS) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS type,
  p_name AS pattern, CASE WHEN p_size > 10 THEN p_brand END AS article FROM part)"""


@query("rule_sheet", f"WITH {FILLED} SELECT * FROM sheet WHERE type IS NOT NULL")
def rule_sheet(t: Tables) -> DataFrame:
    return SH.rule_rows(sheet_of(t))


@query("rule_import", f"""
WITH {FILLED}, g AS (SELECT * FROM sheet WHERE type IS NOT NULL),
old AS (SELECT p_type AS type, p_name AS pattern, 'old' AS article FROM part WHERE p_size = 50 GROUP BY ALL),
every AS (SELECT -1 AS row_no, type, pattern, article FROM old UNION ALL SELECT row_no, type, pattern, article FROM g)
SELECT type AS category, pattern, last(article ORDER BY row_no) FILTER (article IS NOT NULL) AS article FROM every GROUP BY 1, 2
""")
def rule_import(t: Tables) -> DataFrame:
    old = t.part.filter("p_size = 50").select(F.col("p_type").alias("category"), F.col("p_name").alias("pattern")).distinct().withColumn("article", F.lit("old"))
    return RF.import_rules(old.select("category").distinct(), old, SH.rule_rows(sheet_of(t)))[1]


@query("rule_import_summary", f"""
WITH {FILLED}, g AS (SELECT * FROM sheet WHERE type IS NOT NULL),
old AS (SELECT p_type AS type, p_name AS pattern, 'old' AS article FROM part WHERE p_size = 50 GROUP BY ALL),
every AS (SELECT -1 AS row_no, type, pattern, article FROM old UNION ALL SELECT row_no, type, pattern, article FROM g),
w AS (SELECT *, last_value(article IGNORE NULLS) OVER (PARTITION BY type, pattern ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY type, pattern ORDER BY row_no) AS n FROM every)
SELECT (SELECT count(DISTINCT type) FROM g WHERE type NOT IN (SELECT type FROM old)) AS categories_created,
  (SELECT count(*) FROM (SELECT type, pattern FROM every GROUP BY ALL HAVING min(row_no) >= 0)) AS rules_created,
  (SELECT count(*) FROM w WHERE n > 1 AND article IS NOT NULL AND article <> coalesce(before, '')) AS articles_updated
""")
def rule_import_summary(t: Tables) -> DataFrame:
    old = t.part.filter("p_size = 50").select(F.col("p_type").alias("category"), F.col("p_name").alias("pattern")).distinct().withColumn("article", F.lit("old"))
    return RF.import_rules(old.select("category").distinct(), old, SH.rule_rows(sheet_of(t)))[2]


@query("flat_rules_split", "SELECT p_type AS category, p_name AS pattern, first(p_brand ORDER BY p_partkey) AS article FROM part GROUP BY 1, 2")
def flat_rules_split(t: Tables) -> DataFrame:
    flat = t.part.select(F.col("p_partkey").alias("row_no"), F.col("p_type").alias("category"), F.col("p_name").alias("pattern"), F.col("p_brand").alias("article"))
    return RF.split_flat_rules(flat)[1]


@query("hierarchy_import", """
WITH s AS (SELECT s_suppkey AS row_no, n_name AS org, s_name AS full_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT org, full_name, full_name AS short_name FROM s WHERE NOT EXISTS (
  SELECT 1 FROM supplier s2 JOIN nation ON n_nationkey = s_nationkey WHERE s2.s_acctbal > 5000 AND n_name = org AND s2.s_name = full_name) GROUP BY ALL
""")
def hierarchy_import(t: Tables) -> DataFrame:
    rows = SH.hierarchy_rows(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("Subdivision"), F.col("n_name").alias("PU_name")))
    orgs = t.nation.select(F.col("n_nationkey").alias("org_id"), F.col("n_name").alias("short_name"))
    units = t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("org_id"), F.col("s_name").alias("name"))
    return RF.import_hierarchy(orgs, units, rows)[1]


@query("header_alias_map", "SELECT s_suppkey AS row_no, s_name AS short_name, s_name AS full_name, n_name AS org FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def header_alias_map(t: Tables) -> DataFrame:
    return SH.hierarchy_rows(t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("row_no"), F.col("s_name").alias("Abbr"), F.col("n_name").alias("Parent_PU")))


@query("incremental_refresh", """
SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name || '+' ELSE s_name END AS s_name FROM supplier WHERE s_acctbal >= 1000
""")
def incremental_refresh(t: Tables) -> DataFrame:
    base = t.supplier.select("s_suppkey", "s_name")
    saves = t.supplier.filter("s_acctbal > 5000").select("s_suppkey", F.concat("s_name", F.lit("+")).alias("s_name"), F.lit("save").alias("op"), F.lit(2).alias("seq"))
    early = saves.withColumns({"op": F.lit("delete"), "seq": F.lit(1)})
    gone = t.supplier.filter("s_acctbal < 1000").select("s_suppkey", "s_name", F.lit("delete").alias("op"), F.lit(1).alias("seq"))
    return RF.apply_changes(base, saves.unionByName(early).unionByName(gone), "s_suppkey")


@query("reset_snapshot", "SELECT s_suppkey AS org_id, lower(s_name) AS norm_short, true AS needs_embedding FROM supplier")
def reset_snapshot(t: Tables) -> DataFrame:
    incoming = t.supplier.select(F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("short_name"), F.col("s_name").alias("full_name"))
    return RF.upsert_orgs(RF.reset(stored_orgs(t)), incoming, fold=plain).select("org_id", "norm_short", "needs_embedding")
