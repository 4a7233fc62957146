"""Cutting the relevant part out of a document: literal markers, template anchors, merged ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconlink import scale
from reconlink.config import DEFAULTS, Thresholds
from reconlink.functions.spans import all_spans
from reconlink.functions.text import anchor_details, anchor_fold, folded_similarity, literal_pattern, squeeze, tokens, truncate_tail, without_markers
from reconlink.operators.relops import merge_ranges, top_per


def marker_state(rows: DataFrame, keys: list[str], order: list[str], begins: Column, ends: Column) -> DataFrame:
    """Adds inside (a row within a segment, both marker rows included) and segment (its number).

    The state before a row is the last marker seen: an end on a begin row
    closes the segment after that row. A begin inside a segment opens no new one.
    """
    after = F.when(ends, 0).when(begins, 1)
    opened = F.coalesce(F.col("_open"), F.lit(0)) == 1
    marked = scale.Ordered.of(rows, keys, order).scan({"_open": ("last", after)}, exclusive=("_open",)).map(
        lambda r: r.withColumns({"inside": opened | begins, "_first": F.when(begins & ~opened, 1).otherwise(0)}))
    return marked.scan({"segment": ("sum", F.col("_first"))}).result.drop("_open", "_first")


def slice_by_markers(elements: DataFrame, begin: str = "[BEGIN]", end: str = "[END]") -> DataFrame:
    """Elements between markers with the markers cut out; blank rests are dropped. Adds segment."""
    lowered = F.lower("text")
    marked = marker_state(elements, ["doc_id"], ["idx"], F.contains(lowered, F.lit(begin.lower())), F.contains(lowered, F.lit(end.lower())))
    return marked.filter("inside").withColumn("text", without_markers("text", begin, end)).filter("text <> ''").drop("inside")


def marker_summary(elements: DataFrame, begin: str = "[BEGIN]", end: str = "[END]") -> DataFrame:
    """doc_id, markers_found, segments_count, kept_elements."""
    lowered = F.lower("text")
    # what is asked of a text is taken before the rows are placed and kept: no text goes along
    rows = elements.select("doc_id", "idx", F.contains(lowered, F.lit(begin.lower())).alias("_begins"), F.contains(lowered, F.lit(end.lower())).alias("_ends"),
                           (without_markers("text", begin, end) != "").alias("_filled"))
    marked = marker_state(rows, ["doc_id"], ["idx"], F.col("_begins"), F.col("_ends"))
    return marked.groupBy("doc_id").agg(
        F.bool_or(F.col("_begins") | F.col("_ends")).alias("markers_found"), F.max("segment").cast("int").alias("segments_count"),
        F.count_if(F.col("inside") & F.col("_filled")).alias("kept_elements"))


def _around(lines: scale.Ordered, text_col: str = "text") -> scale.Ordered:
    value = F.nullif(squeeze(text_col), F.lit(""))
    return lines.scan({"before": ("last", value)}, exclusive=("before",)).scan({"after": ("last", value)}, exclusive=("after",), descending=True)


def nearest_lines(lines: DataFrame, keys: list[str], order: list[str], text_col: str = "text") -> DataFrame:
    """Adds before and after: the nearest non-blank line strictly above and strictly below."""
    return _around(scale.Ordered.of(lines, keys, order), text_col).result


def marker_blocks(lines: DataFrame, begin: str = "[BEGIN]", end: str = "[END]", t: Thresholds = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(blocks, warnings) of template lines ``doc_id, idx, text``.

    A block runs from a begin to the next marker; a begin followed by a begin
    or by nothing is open-ended, an end without a begin is ignored. Blocks
    carry the anchors: the lines around the markers.
    """
    around = _around(scale.Ordered.of(lines.select("doc_id", "idx", "text"), ["doc_id"], ["idx"]))
    pattern = "(?iu)" + literal_pattern(begin) + "|" + literal_pattern(end)
    # markers of a line keep its place, so the same ranges serve all scans
    spots = around.map(lambda r: r.withColumn("_m", F.explode(all_spans("text", pattern))).select(
        "_p", "doc_id", "idx", F.col("_m.start").alias("at"), (F.lower("_m.text") == begin.lower()).alias("is_begin"), "before", "after",
        (F.col("idx").cast("long") * F.lit(1 << 31) + F.col("_m.start")).alias("_pos")), order=["_pos"])
    spot = F.struct(F.col("is_begin").alias("is_begin"), F.col("idx").alias("idx"), F.col("after").alias("after"))
    begun = F.when(F.col("is_begin"), 1).otherwise(0)
    seen = spots.scan({"_prev": ("last", F.col("is_begin")), "_n": ("sum", begun)}, exclusive=("_prev",)).scan(
        {"_next": ("last", spot)}, exclusive=("_next",), descending=True).result
    pre = anchor_details("before", begin, end, t.anchor_min_chars)
    post = anchor_details("_next.after", begin, end, t.anchor_min_chars)
    closed = F.coalesce(~F.col("_next.is_begin"), F.lit(False))
    blocks = seen.filter("is_begin").select(
        "doc_id", (F.col("_n") - 1).cast("int").alias("seg"), F.col("idx").alias("begin_line"),
        F.when(closed, F.col("_next.idx")).alias("end_line"), (~closed).alias("open_ended"),
        pre["text"].alias("start_text"), pre["weak"].alias("weak_start"),
        F.when(closed, post["text"]).alias("end_text"), F.when(closed, post["weak"]).otherwise(F.lit(False)).alias("weak_end"))
    warning = (
        F.when(~F.col("is_begin") & ~F.coalesce(F.col("_prev"), F.lit(False)), "END without BEGIN ignored")
        .when(F.col("is_begin") & F.coalesce(F.col("_next.is_begin"), F.lit(False)),
              "BEGIN without END before next BEGIN; previous block treated as open-ended")
        .when(F.col("is_begin") & F.col("_next").isNull(), "BEGIN without END treated as open-ended"))
    warnings = seen.select("doc_id", "idx", "at", warning.alias("warning")).filter("warning IS NOT NULL")
    return blocks, warnings


def template_for(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, template_id: the newest active template of the document's org, the general one without an org."""
    live = templates.filter("is_active")
    scope = F.when(F.coalesce(F.trim("org_id"), F.lit("")) == "", "general").otherwise(F.trim("org_id"))
    keyed = live.withColumn("_k", F.when(F.col("scope") == "general", "general").otherwise(F.col("org_id")))
    newest = top_per(keyed, ["_k"], [F.desc("updated_at"), F.desc("template_id")], 1, "_rn").select("_k", "template_id")
    return docs.withColumn("_k", scope).join(newest, "_k", "left").select("doc_id", "template_id")


def anchor_scores(elements: DataFrame, doc_templates: DataFrame, anchors: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """doc_id, seg, side, idx, score: lines good enough to be an anchor of the document's template.

    ``anchors``: template_id, seg, start_text, end_text, open_ended,
    weak_start, weak_end, threshold. A line under the limit can never be
    picked, so only the others leave the join.
    """
    limit = lambda weak: F.when(F.col(weak), F.lit(t.anchor_weak_similarity)).otherwise(
        F.coalesce(F.col("threshold"), F.lit(t.anchor_start_similarity)))
    sides = anchors.select("template_id", "seg", F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("start_text").alias("anchor"), limit("weak_start").alias("least")),
        F.struct(F.lit("end").alias("side"), F.col("end_text").alias("anchor"), limit("weak_end").alias("least")))).alias("a"))
    # folded once per line and anchor, not once per pair
    sides = sides.select("template_id", "seg", "a.side", anchor_fold("a.anchor").alias("_a"), "a.least").filter("_a <> ''").withColumn(
        "_at", tokens("_a"))
    lines = elements.join(doc_templates, "doc_id").select("template_id", "doc_id", "idx", anchor_fold("text").alias("_l")).filter("_l <> ''")
    lines = lines.withColumn("_lt", tokens("_l"))
    small, large = F.least(F.size("_at"), F.size("_lt")), F.greatest(F.size("_at"), F.size("_lt"))
    # the sizes alone bound the token similarity
    possible = F.contains(F.col("_l"), F.col("_a")) | F.contains(F.col("_a"), F.col("_l")) | (small >= F.col("least") * large)
    scored = lines.join(sides, "template_id").filter(possible).withColumn("score", folded_similarity("_a", "_l", "_at", "_lt"))
    return scored.filter(F.col("score") >= F.col("least")).select("doc_id", "seg", "side", "idx", "score")


def anchored_ranges(elements: DataFrame, doc_templates: DataFrame, anchors: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per (document, segment): status, first, last, start_idx, end_idx, scores.

    Scores are made set-wise; a fold over a document's few segments keeps the
    cursor: every segment starts after the one before.
    """
    sized = scale.segmented_scan(
        elements.select("doc_id", "idx", F.length("text").alias("_len")), ["doc_id"], ["idx"],
        {"_chars": ("sum", F.col("_len") + 1), "_no": ("count", F.lit(1))})
    totals = sized.groupBy("doc_id").agg(F.max("_no").cast("int").alias("_total"), F.max("_chars").alias("_all_chars"))
    # places are joined to the few lines that are good enough, not to all texts; once more for lines that share an idx
    scores = anchor_scores(elements.select("doc_id", "idx", "text"), doc_templates, anchors, t).join(
        sized.select("doc_id", "idx"), ["doc_id", "idx"]).join(sized, ["doc_id", "idx"])
    hit = F.struct((-F.col("score")).alias("weak"), (F.col("_no") - 1).cast("int").alias("no"), F.col("_chars").alias("chars"),
                   F.col("_len").alias("len"))
    hits = scores.groupBy("doc_id", "seg").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "start", hit))).alias("starts"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "end", hit))).alias("ends"))
    wanted = doc_templates.join(anchors.select("template_id", "seg", "start_text", "end_text", "open_ended"), "template_id")
    none = F.array().cast(hits.schema["starts"].dataType)
    segments = wanted.join(hits, ["doc_id", "seg"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "seg", (F.coalesce("start_text", F.lit("")) != "").alias("has_start"),
        (F.col("open_ended") | (F.coalesce("end_text", F.lit("")) == "")).alias("open_ended"),
        F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends")))).alias("segs")).join(totals, "doc_id")
    row = "array<struct<seg:int,status:string,first:int,last:int,start_idx:int,end_idx:int,start_score:double,end_score:double>>"
    begin = F.struct(F.lit(0).alias("cursor"), F.array().cast(row).alias("out"))

    def step(state: Column, s: Column) -> Column:
        start = F.try_element_at(F.filter(s["starts"], lambda h: h["no"] >= state["cursor"]), F.lit(1))
        stop = F.try_element_at(F.filter(s["ends"], lambda h: h["no"] > start["no"]), F.lit(1))
        # joined by line ends, so one character less than the running sums give
        rest = F.col("_all_chars") - start["chars"] - 1
        inner = stop["chars"] - stop["len"] - 1 - start["chars"] - 1
        status = (
            F.when(~s["has_start"], "no_start_anchor").when(start.isNull(), "start_below_threshold")
            .when(s["open_ended"], F.when(rest < t.min_slice_chars, "slice_too_small").otherwise("open_ended"))
            .when(stop.isNull(), "end_not_found").when(stop["no"] <= start["no"] + 1, "empty_slice")
            .when(inner < t.min_slice_chars, "slice_too_small").otherwise("accepted"))
        to_end = status.isin("open_ended", "end_not_found")
        good = to_end | (status == "accepted")
        cursor = (
            F.when(to_end, F.col("_total"))
            .when(~s["open_ended"] & status.isin("empty_slice", "slice_too_small", "accepted"), stop["no"] + 1)
            .otherwise(state["cursor"]))
        item = F.struct(
            s["seg"].cast("int").alias("seg"), status.alias("status"), F.when(good, start["no"] + 1).alias("first"),
            F.when(to_end, F.col("_total") - 1).when(good, stop["no"] - 1).alias("last"), start["no"].alias("start_idx"),
            F.when(~s["open_ended"], stop["no"]).alias("end_idx"), (-start["weak"]).alias("start_score"),
            F.when(~s["open_ended"], -stop["weak"]).alias("end_score"))
        return F.struct(cursor.alias("cursor"), F.array_append(state["out"], item).alias("out"))

    return segments.select("doc_id", F.explode(F.aggregate("segs", begin, step)["out"]).alias("r")).select("doc_id", "r.*")


def slice_documents(
    elements: DataFrame, doc_templates: DataFrame, anchors: DataFrame, begin: str = "[BEGIN]", end: str = "[END]",
    t: Thresholds = DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """(kept elements, summary per document).

    Literal markers in the document win. Else the anchored ranges are kept;
    when a segment failed the whole document stays, unless it is over the
    element limit and something was cut.
    """
    # read by every step below
    elements = scale.cut(elements)
    summary = scale.cut(marker_summary(elements, begin, end))
    by_marker = summary.filter("markers_found AND kept_elements > 0").select("doc_id")
    marked = slice_by_markers(elements.join(by_marker, "doc_id", "left_semi"), begin, end).drop("segment")
    rest = elements.join(by_marker, "doc_id", "left_anti")
    ranges = scale.cut(anchored_ranges(rest, doc_templates, anchors, t))
    sizes = rest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_elements"))
    verdict = sizes.join(ranges.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("segments_total"), F.count("first").alias("segments_applied")), "doc_id", "left").na.fill(0)
    missing = (F.col("segments_applied") < F.col("segments_total")) | (F.col("segments_total") == 0)
    limited = missing & (F.col("segments_applied") > 0) & (F.lit(False) if t.slice_fallback_elements is None else F.col("total_elements") > t.slice_fallback_elements)
    verdict = verdict.withColumn("strategy", F.when(F.col("segments_total") == 0, "none").when(limited, "anchors-missing-limited")
                                 .when(missing, "anchors-missing").otherwise("anchors"))
    merged = merge_ranges(ranges.filter("first <= last"), ["doc_id"], "first", "last").drop("parts")
    numbered = scale.segmented_scan(rest, ["doc_id"], ["idx"], {"_no": ("count", F.lit(1))}).withColumn("_no", F.col("_no") - 1)
    cutting = verdict.filter("strategy IN ('anchors', 'anchors-missing-limited')").select("doc_id")
    inside = numbered.join(cutting, "doc_id", "left_semi").alias("n").join(
        merged.alias("m"), (F.col("n.doc_id") == F.col("m.doc_id")) & F.col("n._no").between(F.col("m.first"), F.col("m.last")), "left_semi")
    whole = numbered.join(cutting, "doc_id", "left_anti")
    kept = inside.unionByName(whole).drop("_no").unionByName(marked)
    table = summary.join(verdict, "doc_id", "left").withColumn(
        "strategy", F.when(F.col("markers_found") & (F.col("kept_elements") > 0), "report_markers").otherwise(F.col("strategy")))
    return kept, table


def anchor_report(ranges: DataFrame, elements: DataFrame, limit: int | None = None) -> DataFrame:
    """Per segment a short summary with the matched lines, for the slicing status."""
    lines = scale.segmented_scan(elements, ["doc_id"], ["idx"], {"_no": ("count", F.lit(1))}).select(
        "doc_id", (F.col("_no") - 1).alias("_no"), (F.col("text") if limit is None else truncate_tail("text", limit)).alias("_text"))
    out = ranges
    for side in ("start", "end"):
        named = lines.select("doc_id", F.col("_no").alias(f"{side}_idx"), F.col("_text").alias(f"{side}_line"))
        out = out.join(named, ["doc_id", f"{side}_idx"], "left")
    return out.withColumn("accepted", F.col("first").isNotNull())


def slicing_label(summary: DataFrame) -> DataFrame:
    """A status word per document: markers, anchors, partial or whole."""
    return summary.withColumn("label", F.when(F.col("strategy") == "report_markers", "markers").when(
        F.col("strategy") == "anchors", "anchors").when(F.col("strategy") == "anchors-missing-limited", "partial").otherwise("whole"))
