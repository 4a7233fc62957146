"""Text, element, marker and span queries over the given documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reconlink.functions import names as N, spans as S, staff as ST, text as X, units as U
from reconlink.functions.articles import article_key, article_light
from reconlink.functions.dates import date_mention, first_date_or_time_span, with_date_time
from reconlink.functions.windows import windows_by_size, windows_by_start
from reconlink.operators import slicing as SL
from reconlink.queries.registry import Tables, query
from reconlink.sources import elements as E, sinks as K

WS = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
LINES = """l AS (SELECT doc_id, idx - 1 AS idx, line FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents))"""


def raw_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


@query("split_lines_min_len", f"""
WITH {LINES}, e AS (SELECT doc_id, idx, {WS.format(c='line')} AS text FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INT) AS idx, text FROM e WHERE length(text) >= 100
""")
def split_lines_min_len(t: Tables) -> DataFrame:
    return E.mentions_of(E.elements_of_text(t.documents, by="lines")).select("doc_id", "idx", "text")


@query("split_blocks_min_len", f"""
WITH b AS (SELECT doc_id, generate_subscripts(p, 1) AS idx, unnest(p) AS block FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n+') AS p FROM documents)),
e AS (SELECT doc_id, idx, {WS.format(c='block')} AS text FROM b)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INT) AS idx, text FROM e WHERE length(text) >= 100
""")
def split_blocks_min_len(t: Tables) -> DataFrame:
    return E.mentions_of(E.elements_of_text(t.documents)).select("doc_id", "idx", "text")


@query("slice_summary", f"""
WITH {LINES}, e AS (SELECT doc_id, {WS.format(c='line')} AS text FROM l)
SELECT doc_id, count(*) AS total, count(*) FILTER (length(text) >= 100) AS kept, count(*) FILTER (length(text) < 100) AS skipped_short, CAST(0 AS BIGINT) AS skipped_empty_rows
FROM e WHERE text <> '' GROUP BY doc_id
""")
def slice_summary(t: Tables) -> DataFrame:
    return E.slicing_summary(E.elements_of_text(t.documents, by="lines"))


@query("whole_text_fallback", f"""
WITH {LINES}, e AS (SELECT doc_id, idx, {WS.format(c='line')} AS text FROM l),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INT) AS idx, text FROM e WHERE length(text) >= 100)
SELECT * FROM k UNION ALL
SELECT doc_id, 1, {WS.format(c="string_agg(text, ' ' ORDER BY idx)")} FROM e WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM k) GROUP BY doc_id
""")
def whole_text_fallback(t: Tables) -> DataFrame:
    return E.mentions_of(E.elements_of_text(t.documents, by="lines"), whole_text=True).select("doc_id", "idx", "text")


@query("header_rows", f"""
WITH {LINES}, c AS (SELECT doc_id, idx, list_transform(string_split(line, ','), lambda x: {WS.format(c='x')}) AS cells FROM l),
h AS (SELECT a.doc_id, len(list_filter(a.cells, lambda x: length(x) > 40)) = 0 AND len(list_filter(a.cells, lambda x: x <> '')) > 0
        AND length({WS.format(c="array_to_string(b.cells, ' ')")}) >= 100 AS is_header
      FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.idx = 0 AND b.idx = 1)
SELECT c.doc_id, CAST(c.idx AS INT) AS idx, coalesce(is_header AND idx = 0, false) AS is_header, coalesce(is_header AND idx > 0, false) AS has_header
FROM c LEFT JOIN h USING (doc_id)
""")
def header_rows(t: Tables) -> DataFrame:
    """Every document read as one table: lines are rows, commas part the cells."""
    rows = raw_lines(t).select(
        F.col("doc_id").cast("string").alias("doc_id"), "idx", F.lit("table_row").alias("kind"), "text",
        F.transform(F.split("text", ","), X.squeeze).alias("cells"), F.lit(0).alias("table_no"), F.col("idx").alias("row_no"))
    return E.with_headers(rows).select(
        F.col("doc_id").cast("long").alias("doc_id"), "idx", "is_header", F.col("header_cells").isNotNull().alias("has_header"))


@query("head_tail_truncate", """
SELECT doc_id, CASE WHEN strlen(text) <= 4000 THEN length(text) END AS kept_chars, strlen(text) > 4000 AS truncated,
       CASE WHEN length(text) <= 500 THEN text ELSE left(text, 500) || chr(10) || '...[truncated ' || (length(text) - 500) || ' chars]' END AS short
FROM documents
""")
def head_tail_truncate(t: Tables) -> DataFrame:
    both = X.head_tail("text", 4000)
    cut = F.contains(both, F.lit("... [TRUNCATED: original size "))
    return t.documents.select(
        "doc_id", F.when(~cut, F.length(both)).alias("kept_chars"), cut.alias("truncated"), X.truncate_tail("text", 500).alias("short"))


@query("marker_state", """
WITH s AS (SELECT conv_id, turn, role = 'user' AS b, role = 'assistant' AS e,
  coalesce(last_value(CASE WHEN role = 'assistant' THEN 0 WHEN role = 'user' THEN 1 END IGNORE NULLS) OVER w, 0) = 1 AS opened
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, opened OR b AS inside, CAST(sum(CASE WHEN b AND NOT opened THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM s
""")
def marker_state(t: Tables) -> DataFrame:
    return SL.marker_state(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"],
                           F.col("role") == "user", F.col("role") == "assistant").drop("role")


def marked_turns(t: Tables) -> DataFrame:
    """Turns as template lines: a user turn opens with a begin marker, every third letter count ends one."""
    text = F.when(F.col("role") == "user", F.concat(F.lit("[BEGIN] "), "text")).when(
        F.length("text") % 3 == 0, F.concat("text", F.lit(" [end]"))).otherwise(F.col("text"))
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), text.alias("text"))


MARKED = """v AS (SELECT conv_id AS doc_id, turn AS idx, role = 'user' AS b, role <> 'user' AND length(text) % 3 = 0 AS e, text FROM conversations)"""


@query("slice_by_markers", f"""
WITH {MARKED}, s AS (SELECT *, coalesce(last_value(CASE WHEN e THEN 0 WHEN b THEN 1 END IGNORE NULLS)
   OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS opened FROM v)
SELECT doc_id, CAST(idx AS INT) AS idx, {WS.format(c='text')} AS text FROM s WHERE (opened OR b) AND {WS.format(c='text')} <> ''
""")
def slice_by_markers(t: Tables) -> DataFrame:
    return SL.slice_by_markers(marked_turns(t)).drop("segment")


@query("marker_blocks", f"""
WITH {MARKED}, k AS (SELECT doc_id, idx, b FROM v WHERE b OR e),
n AS (SELECT *, lead(b) OVER w AS next_b, lead(idx) OVER w AS next_idx FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INT) AS seg, CAST(idx AS INT) AS begin_line,
       CAST(CASE WHEN NOT next_b THEN next_idx END AS INT) AS end_line, coalesce(next_b, true) AS open_ended FROM n WHERE b
""")
def marker_blocks(t: Tables) -> DataFrame:
    return SL.marker_blocks(marked_turns(t))[0].select("doc_id", "seg", "begin_line", "end_line", "open_ended")


@query("marker_warnings", f"""
WITH {MARKED}, k AS (SELECT doc_id, idx, b FROM v WHERE b OR e),
n AS (SELECT *, lead(b) OVER w AS next_b, lag(b) OVER w AS prev_b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, CAST(idx AS INT) AS idx, CASE WHEN NOT b THEN 'END without BEGIN ignored' WHEN next_b THEN 'BEGIN without END before next BEGIN; previous block treated as open-ended'
  ELSE 'BEGIN without END treated as open-ended' END AS warning FROM n WHERE (NOT b AND NOT coalesce(prev_b, false)) OR (b AND coalesce(next_b, true))
""")
def marker_warnings(t: Tables) -> DataFrame:
    return SL.marker_blocks(marked_turns(t))[1].select("doc_id", "idx", "warning")


@query("nearest_nonblank", f"""
WITH {LINES}, s AS (SELECT doc_id, idx, nullif({WS.format(c='line')}, '') AS v FROM l)
SELECT doc_id, CAST(idx AS INT) AS idx,
  sha256(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS before,
  sha256(coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS after FROM s
""")
def nearest_nonblank(t: Tables) -> DataFrame:
    rows = SL.nearest_lines(raw_lines(t), ["doc_id"], ["idx"])
    return rows.select("doc_id", "idx", *[F.sha2(F.coalesce(c, F.lit("")), 256).alias(c) for c in ("before", "after")])


ANCHOR = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("anchor_lines", f"""
WITH {LINES}, n AS (SELECT doc_id, idx, {ANCHOR.format(c='line')} AS a FROM l),
f AS (SELECT doc_id, a AS anchor FROM n WHERE idx = 0),
p AS (SELECT n.doc_id, idx, anchor, a, list_distinct(list_filter(string_split(anchor, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(a, ' '), lambda x: x <> '')) AS y FROM n JOIN f USING (doc_id))
SELECT doc_id, CAST(idx AS INT) AS idx, round(CASE WHEN a = '' OR anchor = '' THEN 0.0 WHEN instr(a, anchor) > 0 OR instr(anchor, a) > 0 THEN 1.0
  ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS score FROM p
""")
def anchor_lines(t: Tables) -> DataFrame:
    lines = raw_lines(t)
    first = lines.filter("idx = 0").select("doc_id", F.col("text").alias("anchor"))
    return lines.join(first, "doc_id").select("doc_id", "idx", F.round(X.anchor_similarity("anchor", "text"), 6).alias("score"))


@query("anchor_slices")
def anchor_slices(t: Tables) -> DataFrame:
    """A source's template takes its anchors from the line after the first one of each of its documents' first few segments.

    Every source has one template: the first lines of its smallest document
    open and close the segments that are looked for in all its documents.
    """
    elements = E.elements_of_text(t.documents, by="lines").select("doc_id", "idx", "text")
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    model = elements.join(first, "doc_id").filter("idx < 8").withColumn("seg", F.floor(F.col("idx") / 4).cast("int"))
    side = lambda at: F.max(F.when(F.col("idx") % 4 == at, F.col("text")))
    anchors = model.groupBy(F.col("source").alias("template_id"), "seg").agg(side(0).alias("start_text"), side(2).alias("end_text")).select(
        "template_id", "seg", X.anchor_fold("start_text").alias("start_text"), X.anchor_fold("end_text").alias("end_text"),
        F.lit(False).alias("open_ended"), F.lit(False).alias("weak_start"), F.lit(False).alias("weak_end"), F.lit(0.25).alias("threshold"))
    wanted = t.documents.select("doc_id", F.col("source").alias("template_id"))
    kept, summary = SL.slice_documents(elements, wanted, anchors)
    left = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_lines"))
    return summary.select("doc_id", "strategy", "segments_total", "segments_applied", "total_elements").join(left, "doc_id", "left").na.fill(0)


@query("token_windows_small", """
WITH k AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\-№"]+') AS toks FROM conversations),
w AS (SELECT conv_id, turn, s, z, array_to_string(list_slice(toks, s, s + z - 1), ' ') AS words FROM
  (SELECT *, unnest(generate_series(1, len(toks))) AS s FROM k), (SELECT unnest([1, 2, 3, 4, 5, 6]) AS z) WHERE s + z - 1 <= len(toks))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY s, z) - 1 AS INT) AS w, words FROM w
""")
def token_windows_small(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.posexplode(windows_by_start(F.lower("text"), (1, 6))).alias("w", "win"))
    return rows.select("conv_id", "turn", "w", F.col("win.text").alias("words"))


@query("token_windows_large", """
WITH k AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[а-яёa-z0-9]+') AS toks FROM conversations),
w AS (SELECT conv_id, turn, s, z, array_to_string(list_slice(toks, s, s + z - 1), ' ') AS words FROM
  (SELECT *, unnest(generate_series(1, len(toks))) AS s FROM k), (SELECT unnest([4, 5, 6, 7, 8, 9, 10]) AS z) WHERE s + z - 1 <= len(toks))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY z, s) - 1 AS INT) AS w, words FROM w
""")
def token_windows_large(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.posexplode(windows_by_size(F.lower("text"), (4, 10))).alias("w", "win"))
    return rows.select("conv_id", "turn", "w", F.array_join("win.tokens", " ").alias("words"))


TOKENS = f"""
q AS (SELECT doc_id, {WS.format(c='text')} AS body FROM documents),
u AS (SELECT doc_id, generate_subscripts(string_split(body, ' '), 1) AS i, unnest(string_split(body, ' ')) AS tok FROM q),
p AS (SELECT doc_id, tok, CAST(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(tok) - 1 AS INT) AS start_at FROM u)
"""


@query("all_spans", f"WITH {TOKENS} SELECT doc_id, start_at, start_at + length(tok) AS end_at, tok FROM p WHERE length(tok) >= 12")
def all_spans(t: Tables) -> DataFrame:
    spans = t.documents.select("doc_id", F.explode(S.all_spans(X.squeeze("text"), "[^ ]{12,}")).alias("s"))
    return spans.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), F.col("s.text").alias("tok"))


@query("span_overlap_anti", f"""
WITH {TOKENS} SELECT doc_id, start_at, start_at + length(tok) AS end_at FROM p WHERE length(tok) >= 10 AND NOT regexp_matches(tok, '[A-Z]')
""")
def span_overlap_anti(t: Tables) -> DataFrame:
    """Long words give way to words with capitals."""
    body = X.squeeze("text")
    rows = t.documents.select("doc_id", S.all_spans(body, "[^ ]{10,}").alias("weak"), S.all_spans(body, "[^ ]*[A-Z][^ ]*").alias("strong"))
    kept = rows.select("doc_id", F.explode(S.drop_overlapping("weak", "strong")).alias("s"))
    return kept.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query("clip_spans", f"""
WITH {LINES}, c AS (SELECT doc_id, idx, length(line) AS n, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS INT) AS a FROM l),
g AS (SELECT doc_id, unnest(generate_series(0, length(text), 90)) AS s FROM documents)
SELECT c.doc_id, CAST(idx AS INT) AS cell, CAST(greatest(s, a) - a AS INT) AS start_at, CAST(least(s + 90, a + n) - a AS INT) AS end_at
FROM c JOIN g ON c.doc_id = g.doc_id AND s < a + n AND a < s + 90
""")
def clip_spans(t: Tables) -> DataFrame:
    """Stripes of 90 characters cut at the line borders."""
    cells = F.split("text", "\n")
    stripes = F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(90)), lambda s: F.struct(s.alias("start"), (s + 90).alias("end")))
    rows = t.documents.select("doc_id", F.explode(S.clip_to_cells(stripes, cells, "\n")).alias("c"))
    return rows.select("doc_id", "c.cell", F.col("c.start").alias("start_at"), F.col("c.end").alias("end_at"))


PAIRED = f"""
WITH {TOKENS.replace("SELECT doc_id, tok,", "SELECT doc_id, tok, i,")},
w AS (SELECT doc_id, list({{'s': start_at, 'e': start_at + length(tok)}} ORDER BY i) FILTER (length(tok) >= 8) AS long FROM p WHERE tok <> '' GROUP BY doc_id),
d AS (SELECT a.doc_id, list({{'s': a.start_at, 'e': CAST(b.start_at + length(b.tok) AS INT)}} ORDER BY a.i) AS two
      FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.i % 2 = 1 AND a.tok <> '' AND b.tok <> '' GROUP BY a.doc_id)
"""


def span_lists(t: Tables) -> DataFrame:
    """Long words, and words taken two by two."""
    body = X.squeeze("text")
    return t.documents.select("doc_id", S.all_spans(body, "[^ ]{8,}").alias("long"), S.all_spans(body, "[^ ]+ [^ ]+").alias("two"))


@query("greedy_spans", f"""
{PAIRED},
s AS (SELECT doc_id, list_transform(list_sort(list_transform(list_concat(coalesce(long, []), coalesce(two, [])), lambda x: {{'s': x.s, 'n': -x.e}})), lambda x: [{{'s': x.s, 'e': -x.n}}]) AS l
      FROM w FULL JOIN d USING (doc_id)),
k AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN x[1].s >= acc[len(acc)].e THEN list_concat(acc, x) ELSE acc END) AS kept FROM s WHERE len(l) > 0)
SELECT doc_id, CAST(x.s AS INT) AS start_at, CAST(x.e AS INT) AS end_at FROM (SELECT doc_id, unnest(kept) AS x FROM k)
""")
def greedy_spans(t: Tables) -> DataFrame:
    rows = span_lists(t).select("doc_id", F.explode(S.greedy_spans(F.concat("long", "two"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query("merge_extractors")
def merge_extractors(t: Tables) -> DataFrame:
    rows = span_lists(t).select("doc_id", F.explode(S.merge_longer("long", "two")).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@query("lookback_tokens", """
WITH k AS (SELECT conv_id, turn, regexp_extract_all(lower(substr(text, 1, length(text) // 2)), '[а-яёa-z-]+') AS toks FROM conversations)
SELECT conv_id, turn, array_to_string(list_slice(toks, greatest(len(toks) - 2, 1), len(toks)), ' ') AS words FROM k
""")
def lookback_tokens(t: Tables) -> DataFrame:
    half = F.lower(F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    found = ST.last_tokens_before(half, F.length(half))
    return t.conversations.select("conv_id", "turn", F.array_join(found, " ").alias("words"))


@query("date_extract", """
WITH m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\b\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4}\\b'), lambda x:
   TRY_CAST(lpad(CAST(CASE WHEN CAST(regexp_extract(x, '(\\d+)$', 1) AS INT) < 100 THEN 2000 + CAST(regexp_extract(x, '(\\d+)$', 1) AS INT) ELSE CAST(regexp_extract(x, '(\\d+)$', 1) AS INT) END AS VARCHAR), 4, '0')
     || '-' || lpad(regexp_extract(x, '^\\d+[./-](\\d+)', 1), 2, '0') || '-' || lpad(regexp_extract(x, '^(\\d+)', 1), 2, '0') AS DATE)), lambda d: d IS NOT NULL) AS dates FROM documents)
SELECT doc_id, CAST(dates[1] AS VARCHAR) AS found FROM m
""")
def date_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", date_mention("text")["date"].cast("string").alias("found"))


@query("date_time_rows")
def date_time_rows(t: Tables) -> DataFrame:
    rows = with_date_time(t.documents.select("doc_id", "text")).withColumn("first_span", first_date_or_time_span("text"))
    return rows.select("doc_id", F.col("date_time").cast("string").alias("found"), "time_found",
                       F.col("date_span.start").alias("date_at"), F.col("time_span.start").alias("time_at"), F.col("first_span.start").alias("first_at"))


@query("event_date_text", "SELECT event_id, strftime(ts, '%d.%m.%Y') AS shown, CAST(ts AS DATE)::VARCHAR AS found, strftime(ts, '%H:%M') AS clock FROM events")
def event_date_text(t: Tables) -> DataFrame:
    """The events' own times written into a sentence and read back."""
    said = F.concat(F.date_format("ts", "dd.MM.yyyy"), F.lit(" в "), F.date_format("ts", "HH:mm"), F.lit(" пользователь "), F.col("user_id").cast("string"))
    rows = with_date_time(t.events.select("event_id", said.alias("text")))
    return rows.select("event_id", F.date_format("date_time", "dd.MM.yyyy").alias("shown"),
                       F.col("date_time").cast("date").cast("string").alias("found"), F.date_format("date_time", "HH:mm").alias("clock"))


@query("text_normalise", "SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ё', 'е'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def text_normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(X.fold("text"), 256).alias("digest"))


@query("anchor_normalise", f"SELECT page_id, {ANCHOR.format(c='html')} AS folded FROM pages")
def anchor_normalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.anchor_fold("html").alias("folded"))


@query("category_normalise", """
SELECT page_id, trim(regexp_replace(regexp_replace(replace(lower(html), 'ё', 'е'), '[\\t\\r\\n|/\\\\,;]+', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM pages
""")
def category_normalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.category_fold("html").alias("folded"))


@query("sha_key", "SELECT p_partkey, sha256(p_name || '|' || array_to_string(list_sort([p_brand, p_type]), '|')) AS key FROM part")
def sha_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.source_hash("p_name", F.array("p_brand", "p_type")).alias("key"))


@query("edit_le_one", "SELECT p_partkey, levenshtein(string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]) <= 1 AS near, levenshtein(p_type, 'SMALL') <= 1 AS small FROM part")
def edit_le_one(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.select("p_partkey", X.edit_le_one(words[0], words[1]).alias("near"), X.edit_le_one("p_type", F.lit("SMALL")).alias("small"))


@query("jaccard_lines", f"""
WITH {LINES}, k AS (SELECT doc_id, idx, list_distinct(list_filter(string_split(line, ' '), lambda x: x <> '')) AS toks FROM l),
n AS (SELECT doc_id, idx, toks, lag(toks) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM k)
SELECT doc_id, CAST(idx AS INT) AS idx, round(len(list_intersect(toks, prev)) / CAST(nullif(len(list_distinct(list_concat(toks, prev))), 0) AS DOUBLE), 6) AS score FROM n WHERE prev IS NOT NULL
""")
def jaccard_lines(t: Tables) -> DataFrame:
    """Each line against the line before it."""
    rows = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    pairs = rows.select("doc_id", F.explode(F.transform(
        F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: i < F.size("lines")),
        lambda i: F.struct(i.cast("int").alias("idx"), F.expr("lines")[i - 1].alias("a"), F.expr("lines")[i].alias("b")))).alias("p"))
    return pairs.select("doc_id", "p.idx", F.round(X.jaccard(X.tokens("p.b"), X.tokens("p.a")), 6).alias("score"))


@query("key_tokens", """
WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from'))) AS toks FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(toks), ' ') AS words FROM k
""")
def key_tokens(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(X.key_tokens("text")), " ").alias("words"))


@query("rare_tokens_acronyms", """
SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) >= 5))) AS rare FROM documents
""")
def rare_tokens_acronyms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.rare_tokens("text")).cast("long").alias("rare"))


@query("token_overlap", """
WITH k AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[а-яёa-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from')) AS toks FROM conversations),
n AS (SELECT *, lag(toks) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM k)
SELECT conv_id, turn, len(list_intersect(toks, prev)) > 0 AS shared FROM n WHERE prev IS NOT NULL
""")
def token_overlap(t: Tables) -> DataFrame:
    later = t.conversations.select("conv_id", "turn", "text")
    earlier = later.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    return later.join(earlier, ["conv_id", "turn"]).select("conv_id", "turn", X.token_overlap("text", "prev").alias("shared"))


@query("lexical_evidence", """
WITH n AS (SELECT p_partkey, lower(p_type) AS short, lower(p_name) AS full, lower(p_name || ' ' || p_brand) AS body FROM part),
k AS (SELECT *, list_distinct(list_filter(string_split(short, ' '), lambda x: length(x) > 4)) AS keys, string_split(body, ' ') AS words FROM n)
SELECT p_partkey, len(list_filter(keys, lambda x: instr(body, x) > 0)) > 0 AS hit, CAST(len(list_intersect(keys, words)) AS INT) AS overlap FROM k
""")
def lexical_evidence(t: Tables) -> DataFrame:
    body = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return t.part.select("p_partkey", U.lexical_evidence(body, F.lower("p_type"), F.lower("p_name")).alias("e")).select(
        "p_partkey", "e.hit", "e.overlap")


@query("null_literals", """
SELECT o_orderkey, CASE WHEN v IN ('', 'null', 'none', '-', '—') THEN NULL ELSE v END AS kept FROM (
  SELECT o_orderkey, lower(trim(CASE o_orderstatus WHEN 'F' THEN ' None ' WHEN 'P' THEN '—' ELSE o_orderpriority END)) AS v FROM orders)
""")
def null_literals(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", " None ").when(F.col("o_orderstatus") == "P", "—").otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", X.compare_value(raw).alias("kept"))


@query("quoted_name", "SELECT p_partkey, CASE WHEN length(p_name) >= 3 THEN p_name END AS quoted, lower(p_name) AS folded FROM part")
def quoted_name(t: Tables) -> DataFrame:
    said = F.concat(F.lit("на КПП-2 «"), F.col("p_name"), F.lit("» выявлено"))
    return t.part.select("p_partkey", U.quoted_name(said).alias("quoted"), U.quoted_fold(U.quoted_name(said)).alias("folded"))


@query("unit_normalise", "SELECT p_partkey, lower(p_brand) AS brand FROM (SELECT p_partkey, replace(replace(p_brand, '#', '#'), ' ', '-') AS p_brand FROM part)")
def unit_normalise(t: Tables) -> DataFrame:
    """Spelling variants of a numbered name fold to one form."""
    return t.part.select("p_partkey", U.unit_fold(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ; "))).alias("brand"))


@query("article_keys", "SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey + 1) || '.' || l_linenumber || '|' || (l_linenumber + 1) AS key FROM lineitem")
def article_keys(t: Tables) -> DataFrame:
    said = F.concat(F.lit("по ч. "), (F.col("l_linenumber") + 1).cast("string"), F.lit(" ст. "), (F.col("l_suppkey") + 1).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", article_key(said).alias("key"))


@query("article_lights", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'green' ELSE 'yellow' END ELSE 'red' END AS light FROM orders
""")
def article_lights(t: Tables) -> DataFrame:
    own = F.concat(F.lit("ст. 18."), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" ч. 1"))
    registered = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("18."), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" часть 1"))).otherwise("—")
    ruled = F.when(F.col("o_orderpriority") == "1-URGENT", own).otherwise("ст. 1")
    return t.orders.select("o_orderkey", article_light(own, ruled, registered).alias("light"))


@query("name_folds", "SELECT c_custkey, regexp_replace(lower(c_name), '[^а-яa-z0-9]', '', 'g') AS folded FROM customer")
def name_folds(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", N.surname_key("c_name").alias("folded"))


@query("birth_compatible", """
WITH p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CASE o_orderstatus WHEN 'F' THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN 'O' THEN CAST(o_orderdate AS DATE) + 1 END AS b FROM orders)
SELECT o_orderkey, b IS NULL OR a = b OR (year(a) = year(b) AND (dayofyear(a) = 1 OR dayofyear(b) = 1)) AS fits FROM p
""")
def birth_compatible(t: Tables) -> DataFrame:
    a = F.col("o_orderdate").cast("date")
    b = F.when(F.col("o_orderstatus") == "F", F.trunc(a, "year")).when(F.col("o_orderstatus") == "O", F.date_add(a, 1))
    return t.orders.select("o_orderkey", a.alias("a"), b.alias("b")).select("o_orderkey", N.birth_compatible("a", "b").alias("fits"))


@query("json_export", """
SELECT event_id, CAST(json_object('event_id', event_id, 'event_type', event_type, 'ts', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'text', props) AS VARCHAR) AS document FROM events
""")
def json_export(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("props").alias("text"))
    return K.event_documents(rows, ["event_id"])


@query("result_sink_roundtrip", "SELECT event_type AS batch_id, count(*) AS mentions, round(sum(value), 2) AS value FROM events WHERE event_type = 'error' GROUP BY 1")
def result_sink_roundtrip(t: Tables) -> DataFrame:
    """Written by batch, one batch read back: the filter prunes folders."""
    import uuid

    from reconlink.scale import checkpoint_folder

    folder = checkpoint_folder(t.spark)
    path = f"{folder}/sink-{uuid.uuid4().hex}"
    rows = t.events.select(F.col("event_type").alias("batch_id"), "event_id", "value")
    K.write_results(rows.select("batch_id", "event_id"), rows, path)
    mentions, results = K.read_results(t.spark, path, "error")
    return mentions.groupBy("batch_id").agg(F.count(F.lit(1)).alias("mentions")).join(
        results.groupBy("batch_id").agg(F.round(F.sum("value"), 2).alias("value")), "batch_id")
