"""Rule and hierarchy sheets given as delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconlink.operators.relops import fill_down

# Header spellings of a hierarchy sheet and the column each one means.
HEADER_ALIASES = {
    "short_name": "short_name",
    "shortname": "short_name",
    "short": "short_name",
    "abbr": "short_name",
    "abbr_name": "short_name",
    "full_name": "full_name",
    "fullname": "full_name",
    "name": "full_name",
    "subdivision": "full_name",
    "subdivision_name": "full_name",
    "pu": "org",
    "pu_name": "org",
    "parent_pu": "org",
}


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text plus the row number inside the sheet (one file, one order)."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), multiLine=True)
    return raw.withColumn("row_no", F.monotonically_increasing_id())


def rule_rows(sheet: DataFrame) -> DataFrame:
    """row_no, type, pattern, article: the type filled down where another cell is present."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    cleaned = sheet.select("row_no", blank("type").alias("type"), blank("pattern").alias("pattern"), blank("article").alias("article"))
    used = cleaned.filter("type IS NOT NULL OR pattern IS NOT NULL OR article IS NOT NULL")
    return fill_down(used, [], ["row_no"], "type", "_type").withColumn("type", F.col("_type")).drop("_type").filter("type IS NOT NULL")


def skipped_rows(sheet: DataFrame) -> DataFrame:
    empty = F.concat_ws("", *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("type", "pattern", "article")]) == ""
    return sheet.agg(F.count_if(empty).alias("skipped"))


def hierarchy_rows(sheet: DataFrame, aliases: dict[str, str] = HEADER_ALIASES) -> DataFrame:
    """short_name, full_name, org of a hierarchy sheet; blank rows dropped, names stand in for each other.

    Columns go by their headers, the first spelling of a meaning wins. Without
    an org header or any name header they go by place: three filled cells are
    short, full, org; two are full, org.
    """
    mapped: dict[str, str] = {}
    for column in sheet.columns:
        meaning = aliases.get(column.strip().lower())
        if meaning and meaning not in mapped:
            mapped[meaning] = column
    cell = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    extra = ["row_no"] if "row_no" in sheet.columns else []
    if "org" in mapped and ("full_name" in mapped or "short_name" in mapped):
        raw = {m: cell(mapped[m]) if m in mapped else F.lit("") for m in ("short_name", "full_name", "org")}
    else:
        first, second, third = [cell(c) for c in [c for c in sheet.columns if c != "row_no"][:3]]
        three = third != ""
        raw = {
            "short_name": first, "full_name": F.when(three, second).otherwise(first),
            "org": F.when(three, third).otherwise(second),
        }
    rows = sheet.select(*extra, *[c.alias(m) for m, c in raw.items()])
    nz = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.filter("short_name <> '' OR full_name <> '' OR org <> ''").select(
        *extra, F.coalesce(nz("short_name"), nz("full_name"), F.lit("")).alias("short_name"),
        F.coalesce(nz("full_name"), nz("short_name"), F.lit("")).alias("full_name"), "org")
