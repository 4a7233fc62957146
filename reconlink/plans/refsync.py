"""Reference snapshots: new snapshot = stored rows full-outer-joined with incoming ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from reconlink.functions import units as U
from reconlink.functions.text import source_hash
from reconlink.operators.relops import keep_current, replace_when_found


def _merge(stored: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Stored and incoming side by side: old, new structs and where the row comes from."""
    s = stored.select(F.col(key), F.struct(*stored.columns).alias("old"))
    i = incoming.select(F.col(key), F.struct(*values).alias("new"))
    return s.join(i, key, "full")


def upsert_orgs(stored: DataFrame, incoming: DataFrame, *, force: bool = False, fold=U.unit_fold) -> DataFrame:
    """org_ref snapshot; needs_embedding marks rows that are new, forced, renamed or lack a vector.

    ``stored``: org_id, short_name, full_name, norm_short, norm_full,
    short_embedding, full_embedding. Rows absent from ``incoming`` stay.
    """
    fresh = incoming.select("org_id", "short_name", "full_name").withColumns({
        "norm_short": fold(F.col("short_name")), "norm_full": fold(F.col("full_name"))})
    names = ["short_name", "full_name", "norm_short", "norm_full"]
    both = _merge(stored, fresh, "org_id", names)
    renamed = (F.col("old.norm_short") != F.col("new.norm_short")) | (F.col("old.norm_full") != F.col("new.norm_full"))
    lacking = F.col("old.short_embedding").isNull() | F.col("old.full_embedding").isNull()
    needs = F.col("new").isNotNull() & (F.lit(force) | F.col("old").isNull() | lacking | F.coalesce(renamed, F.lit(True)))
    return both.select(
        "org_id", *[F.when(F.col("new").isNotNull(), F.col(f"new.{n}")).otherwise(F.col(f"old.{n}")).alias(n) for n in names],
        F.col("old.short_embedding").alias("short_embedding"), F.col("old.full_embedding").alias("full_embedding"),
        F.coalesce(needs, F.lit(False)).alias("needs_embedding"))


def describe_units(units: DataFrame, *, alias_limit: int | None = None, fold=U.unit_fold) -> DataFrame:
    """Normal forms, aliases and the source hash of incoming units."""
    short = F.trim(F.coalesce("short_name", F.lit("")))
    name = F.trim("name")
    return units.select("unit_id", "name", "short_name", "org_id").withColumns({
        "norm_short": fold(short), "norm_name": fold(name), "aliases": U.unit_aliases("name", alias_limit)}).withColumn(
        "source_hash", source_hash(fold(F.when(short != "", short).otherwise(name)), "aliases"))


def upsert_units(stored: DataFrame, incoming: DataFrame, *, force: bool = False, encoder: bool = True, fold=U.unit_fold) -> DataFrame:
    """unit_ref snapshot with hash-change detection.

    Without an encoder a row whose source changed loses its vector.
    """
    fresh = describe_units(incoming, fold=fold)
    names = ["name", "short_name", "org_id", "norm_short", "norm_name", "aliases", "source_hash"]
    both = _merge(stored, fresh, "unit_id", names)
    changed = F.col("old.source_hash").isNull() | (F.col("old.source_hash") != F.col("new.source_hash"))
    needs = F.col("new").isNotNull() & (F.lit(force) | F.col("old").isNull() | changed | F.col("old.embedding").isNull())
    vector = F.col("old.embedding") if encoder else F.when(~needs, F.col("old.embedding"))
    state = F.when(F.col("new").isNull(), "kept").when(F.col("old").isNull(), "added").when(changed, "changed").otherwise("same")
    return both.select(
        "unit_id", *[F.when(F.col("new").isNotNull(), F.col(f"new.{n}")).otherwise(F.col(f"old.{n}")).alias(n) for n in names],
        vector.alias("embedding"), F.coalesce(needs, F.lit(False)).alias("needs_embedding"), state.alias("state"))


def sync_aliases(stored: DataFrame, units: DataFrame, fold=U.alias_fold) -> DataFrame:
    """unit_alias snapshot: the first spelling per normal form, stale ones of the synced units gone.

    ``units``: unit_id, aliases. ``stored``: unit_id, alias, norm_alias.
    """
    rows = units.select("unit_id", F.posexplode("aliases").alias("_i", "alias")).withColumn("norm_alias", fold(F.col("alias"))).filter("norm_alias <> ''")
    first = W.partitionBy("unit_id", "norm_alias").orderBy("_i")
    fresh = rows.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").select("unit_id", "alias", "norm_alias")
    # rows of units that were not synced stay as they are
    return replace_when_found(stored.join(units.select("unit_id").distinct(), "unit_id", "left_anti"), fresh, ["unit_id"])


def current_children(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return keep_current(stored, fresh, keys)


def import_rules(categories: DataFrame, rules: DataFrame, sheet: DataFrame, *, clear: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, rules, summary) after importing ``sheet`` (row_no, type, pattern, article).

    A later non-blank article replaces the one a rule had.
    """
    if clear:
        categories, rules = categories.filter("1 = 0"), rules.filter("1 = 0")
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = sheet.select("row_no", F.trim("type").alias("category"), blank("pattern").alias("pattern"), blank("article").alias("article"))
    wanted = rows.select("category").distinct()
    new_categories = wanted.join(categories.select("category"), "category", "left_anti")
    given = rows.filter("pattern IS NOT NULL")
    # the article set last, and how often it changed on the way
    old = rules.select("category", "pattern", F.lit(-1).cast("long").alias("row_no"), F.col("article"), F.lit(True).alias("_old"))
    every = old.unionByName(given.withColumns({"row_no": F.col("row_no").cast("long"), "_old": F.lit(False)}))
    order = W.partitionBy("category", "pattern").orderBy("row_no")
    seen = every.withColumn("_before", F.last("article", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn(
        "_no", F.row_number().over(order))
    flagged = seen.withColumn("_update", F.col("article").isNotNull() & (F.col("_no") > 1) & (F.col("article") != F.coalesce("_before", F.lit(""))))
    merged = flagged.groupBy("category", "pattern").agg(
        F.max_by("article", F.when(F.col("article").isNotNull(), F.col("row_no"))).alias("article"),
        F.bool_and(~F.col("_old")).alias("_new"), F.count_if("_update").alias("_updates"))
    summary = merged.agg(F.count_if("_new").alias("rules_created"), F.coalesce(F.sum("_updates"), F.lit(0)).alias("articles_updated"))
    created = new_categories.agg(F.count(F.lit(1)).alias("categories_created"))
    return (
        categories.select("category").unionByName(new_categories), merged.select("category", "pattern", "article"),
        created.withColumns({c: summary.select(c).scalar() for c in ("rules_created", "articles_updated")}))


def split_flat_rules(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(categories, rules) of a flat table row_no, category, pattern, article; the first article wins."""
    rules = flat.groupBy("category", "pattern").agg(F.min_by("article", "row_no").alias("article"))
    return flat.select("category").distinct(), rules


def import_hierarchy(orgs: DataFrame, units: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new orgs, new units) of sheet rows row_no, short_name, full_name, org: first row per key, existing kept."""
    named = rows.filter("org <> ''")
    new_orgs = named.groupBy("org").agg(F.min("row_no").alias("row_no")).join(
        orgs.select(F.col("short_name").alias("org")), "org", "left_anti")
    first = named.filter("full_name <> ''").groupBy("org", "full_name").agg(F.min_by("short_name", "row_no").alias("short_name"))
    known = units.join(orgs.select("org_id", F.col("short_name").alias("org")), "org_id").select("org", F.col("name").alias("full_name"))
    return new_orgs.select("org", "row_no"), first.join(known, ["org", "full_name"], "left_anti")


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Snapshot after a batch of changes: ``op`` 'save' or 'delete', the last change (``seq``) per key wins."""
    last = W.partitionBy(key).orderBy(F.desc("seq"))
    final = changes.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    rest = snapshot.join(final.select(key), key, "left_anti")
    return rest.unionByName(final.filter("op = 'save'").select(*snapshot.columns))


def reset(snapshot: DataFrame) -> DataFrame:
    """An empty snapshot of the same shape: a full sync starts from it."""
    return snapshot.filter("1 = 0")
