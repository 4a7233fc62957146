"""Dictionary, vector and rule joins on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconlink.functions import text as X
from reconlink.operators import classify as C, dictmatch as D, vectors as V
from reconlink.operators.relops import replace_when_found
from reconlink.queries.registry import Tables, query
from reconlink.scale import cut


@query("dict_contains", """
SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS INT) AS pos FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0
""")
def dict_contains(t: Tables) -> DataFrame:
    return D.contained_names(t.documents, t.benchmark, text_key="doc_id", text="text", name_key="item_id", name="text")


@query("dict_longest", """
SELECT doc_id, item_id, CAST(instr(d.text, b.text) - 1 AS INT) AS pos, length(b.text) AS size FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(b.text) DESC, instr(d.text, b.text), item_id) = 1
""")
def dict_longest(t: Tables) -> DataFrame:
    hits = D.contained_names(t.documents, t.benchmark, text_key="doc_id", text="text", name_key="item_id", name="text")
    sized = hits.join(t.benchmark.select("item_id", F.length("text").alias("size")), "item_id")
    return D.longest_name(sized, text_key="doc_id", order=[F.col("item_id")])


@query("org_of_text", """
WITH n AS (SELECT n_nationkey AS org_id, 1 AS kind, lower(n_name) AS name FROM nation
           UNION ALL SELECT n_nationkey, 0, lower(regexp_extract(n_name, '[^_ ]+')) FROM nation),
c AS (SELECT lower(c_mktsegment || ' nation_' || c_nationkey) AS title, c_custkey FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(org_id AS VARCHAR) AS org_id,
       CASE kind WHEN 0 THEN 'short_name' ELSE 'full_name' END AS method, 1.0 AS score
FROM c JOIN n ON instr(title, name) > 0
QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(name) DESC, instr(title, name), kind, org_id::VARCHAR) = 1
""")
def org_of_text(t: Tables) -> DataFrame:
    orgs = t.nation.select(F.col("n_nationkey").cast("string").alias("org_id"), F.regexp_extract("n_name", "[^_ ]+", 0).alias("short_name"),
                           F.col("n_name").alias("full_name"))
    titles = t.customer.select(F.col("c_custkey").cast("string").alias("doc_id"),
                               F.concat("c_mktsegment", F.lit(" nation_"), F.col("c_nationkey").cast("string")).alias("text"))
    return D.org_of_text(titles, orgs, fold=F.lower)


@query("token_subset", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part),
words AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS word FROM names)
SELECT word, name FROM words JOIN names ON list_contains(string_split(name, ' '), word)
""")
def token_subset(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("name_tokens", F.split("name", " "))
    words = names.select(F.explode("name_tokens").alias("word")).distinct().withColumn("word_tokens", F.array("word"))
    return D.token_subset(words, names, query_key="word", entry_key="name", query_tokens="word_tokens", entry_tokens="name_tokens")


@query("token_subset_pairs", """
WITH names AS (SELECT DISTINCT p_name AS name FROM part), kinds AS (SELECT DISTINCT p_type || ' ' || p_name AS kind FROM part)
SELECT name, kind FROM names JOIN kinds ON len(list_filter(string_split(name, ' '), lambda x: NOT list_contains(string_split(kind, ' '), x))) = 0
""")
def token_subset_pairs(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("q", F.split("name", " "))
    kinds = t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("kind")).distinct().withColumn("e", F.split("kind", " "))
    return D.token_subset(names, kinds, query_key="name", entry_key="kind", query_tokens="q", entry_tokens="e")


def centroids(t: Tables) -> DataFrame:
    """One mean vector per label."""
    each = t.embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = each.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("embedding"))


CENTROIDS = """
d AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM d GROUP BY label, dim),
c AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label),
s AS (SELECT vec_id, c.label AS near, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, c)
"""


@query("vector_top1", f"""
WITH {CENTROIDS}
SELECT vec_id, near, round(score, 6) AS score FROM s WHERE score >= 0.1
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near) = 1
""")
def vector_top1(t: Tables) -> DataFrame:
    near = centroids(t).withColumnRenamed("label", "near")
    best = V.best_vector(t.embeddings, near, row_key="vec_id", entry_key="near", threshold=0.1)
    return best.withColumn("score", F.round("score", 6))


@query("vector_per_label", f"""
WITH {CENTROIDS}
SELECT near, vec_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY near ORDER BY score DESC, vec_id) = 1
""")
def vector_per_label(t: Tables) -> DataFrame:
    """The best row per dictionary entry, as the best window per unit."""
    near = centroids(t).withColumnRenamed("label", "near")
    pairs = V.vector_matches(t.embeddings, near, row_key="vec_id", entry_key="near", min_score=-1.0)
    return pairs.groupBy("near").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b")).select(
        "near", "b.vec_id", F.round("b.score", 6).alias("score"))


@query("vector_topk", """
SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
FROM embeddings a, embeddings b WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3
""")
def vector_topk(t: Tables) -> DataFrame:
    """Every pair over a threshold; blocks of vectors, never all pairs."""
    other = t.embeddings.select(F.col("vec_id").alias("other"), "embedding")
    return V.vector_matches(t.embeddings, other, row_key="vec_id", entry_key="other", min_score=0.3).withColumn("score", F.round("score", 6))


@query("cosine_expression", f"WITH {CENTROIDS} SELECT vec_id, round(score, 6) AS score FROM s JOIN embeddings USING (vec_id) WHERE near = label")
def cosine_expression(t: Tables) -> DataFrame:
    own = centroids(t).withColumnRenamed("embedding", "centre")
    return t.embeddings.join(own, "label").select("vec_id", F.round(X.cosine("embedding", "centre"), 6).alias("score"))


def word_rules(t: Tables) -> DataFrame:
    """A regex rule per benchmark item: its first two words with a gap between."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return t.benchmark.select(
        F.col("item_id").alias("rule_id"), F.concat(F.lit("c"), (F.col("item_id") % 7).cast("string")).alias("category"),
        F.concat(words[0], F.lit(".{0,20}"), words[1]).alias("pattern"), F.lit(None).cast("string").alias("article"),
        F.lit(True).alias("rule_active"), F.lit(True).alias("category_active"))


FOLD = "trim(regexp_replace(regexp_replace(replace(lower({c}), 'ё', 'е'), '[\\t\\r\\n|/\\\\,;]+', ' ', 'g'), '\\s+', ' ', 'g'))"
RULES = """r AS (SELECT item_id AS rule_id, regexp_extract_all(lower(text), '[a-z]+')[1] || '.{0,20}' || regexp_extract_all(lower(text), '[a-z]+')[2] AS pattern FROM benchmark)"""


@query("regex_rules", f"""
WITH {RULES}, d AS (SELECT doc_id, {FOLD.format(c='text')} AS body FROM documents)
SELECT doc_id, rule_id, regexp_extract(body, '(?i)' || pattern) AS fragment FROM d JOIN r ON regexp_matches(body, '(?i)' || pattern)
""")
def regex_rules(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return C.rule_scores(docs, word_rules(t), text_key="doc_id", patterns_only=True).select("doc_id", "rule_id", "fragment")


def ratio_sql(pairs: str) -> str:
    """CTEs that end in ``ratios`` (a, b, score): the gestalt ratio of the texts in ``pairs`` (a, b), block by longest block."""
    return f"""
    pair AS MATERIALIZED (SELECT DISTINCT a, b, md5(a || chr(31) || b) AS id FROM {pairs}),
    spot AS (SELECT id, a, b, i, unnest(range(0, length(b))) AS j FROM (SELECT *, unnest(range(0, length(a))) AS i FROM pair)),
    cell AS MATERIALIZED (SELECT id, i, j, i - j AS diagonal FROM spot WHERE a[i + 1] = b[j + 1]),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY id, diagonal ORDER BY i) AS run FROM cell),
    block AS MATERIALIZED (SELECT id, i, j, 1 + max(i) OVER (PARTITION BY id, diagonal, run) - i AS k FROM runs),
    piece AS (
        SELECT id, 0 AS alo, CAST(length(a) AS INT) AS ahi, 0 AS blo, CAST(length(b) AS INT) AS bhi, 0 AS m FROM pair
        UNION ALL
        SELECT id, CAST(CASE side WHEN 0 THEN alo ELSE -best.i + best.k END AS INT), CAST(CASE side WHEN 0 THEN -best.i ELSE ahi END AS INT),
               CAST(CASE side WHEN 0 THEN blo ELSE -best.j + best.k END AS INT), CAST(CASE side WHEN 0 THEN -best.j ELSE bhi END AS INT), CASE side WHEN 0 THEN CAST(best.k AS INT) ELSE 0 END
        FROM (SELECT id, alo, ahi, blo, bhi, unnest([0, 1]) AS side, best FROM (
                SELECT p.id, alo, ahi, blo, bhi, max(struct_pack(k := least(k, ahi - i, bhi - j), i := -i, j := -j)) AS best
                FROM piece p JOIN block ON block.id = p.id AND i >= alo AND i < ahi AND j >= blo AND j < bhi GROUP BY ALL))),
    ratios AS (SELECT any_value(a) AS a, any_value(b) AS b, 2.0 * sum(m) / (length(any_value(a)) + length(any_value(b))) AS score FROM piece JOIN pair USING (id) GROUP BY id)"""


RANK_RULES = """known AS (SELECT item_id AS rule_id, 'c' || (item_id % 7) AS category, words[1] || '.{0,20}' || words[2] AS pattern, words[1] || '.{0 20}' || words[2] AS folded
          FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM benchmark))"""


@query("rank_categories", f"""
WITH RECURSIVE {RANK_RULES},
d AS MATERIALIZED (SELECT doc_id, {FOLD.format(c='text')} AS body FROM documents),
hit AS MATERIALIZED (SELECT doc_id, rule_id, folded, regexp_extract(body, '(?i)' || pattern) AS fragment FROM d JOIN known ON regexp_matches(body, '(?i)' || pattern)),
near AS MATERIALIZED (SELECT doc_id, rule_id, folded, body FROM d JOIN known ON body <> '' AND 2.0 * least(length(body), length(folded)) / (length(body) + length(folded)) >= 0.5
         WHERE (doc_id, rule_id) NOT IN (SELECT (doc_id, rule_id) FROM hit)),
asked AS (SELECT folded AS a, {FOLD.format(c='fragment')} AS b FROM hit UNION SELECT folded, body FROM near),
{ratio_sql('asked')},
scored AS (SELECT doc_id, rule_id, score, 'regex_hit' AS method FROM hit JOIN ratios ON a = folded AND b = {FOLD.format(c='fragment')}
           UNION ALL SELECT doc_id, rule_id, score, 'fuzzy' FROM near JOIN ratios ON a = folded AND b = body),
best AS (SELECT doc_id, category, rule_id, score, method FROM scored JOIN known USING (rule_id) WHERE score >= 0.5
         QUALIFY row_number() OVER (PARTITION BY doc_id, category ORDER BY score DESC, rule_id) = 1)
SELECT doc_id, category, rule_id, round(score, 6) AS score, method, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS rank FROM best
""")
def rank_categories(t: Tables) -> DataFrame:
    ranked = C.rank_categories(t.documents.select("doc_id", "text"), word_rules(t), text_key="doc_id")
    return ranked.select("doc_id", "category", "rule_id", F.round("score", 6).alias("score"), "method", "rank")


def part_rules(t: Tables) -> DataFrame:
    """Every distinct (type, name) of the parts is a rule: the type its category, the name its pattern."""
    rows = t.part.select(F.col("p_type").alias("category"), F.col("p_name").alias("pattern"), "p_size").groupBy("category", "pattern").agg(
        F.max("p_size").alias("_size"))
    return rows.select(
        F.concat_ws("/", "category", "pattern").alias("rule_id"), "category", "pattern", F.lit(None).cast("string").alias("article"),
        (F.col("_size") > 10).alias("rule_active"), F.lit(True).alias("category_active"))


PART_RULES = "pr AS (SELECT p_type AS category, p_name AS pattern FROM part GROUP BY ALL HAVING max(p_size) > 10)"


@query("same_pattern_expand", f"""
WITH {PART_RULES}, b AS (SELECT DISTINCT p_name AS mention_id FROM part)
SELECT mention_id, category, pattern, 1.0 AS score, 100.0 AS score_percent FROM b JOIN pr ON lower(pattern) = lower(mention_id)
""")
def same_pattern_expand(t: Tables) -> DataFrame:
    best = t.part.select(F.col("p_name").alias("mention_id")).distinct().select(
        "mention_id", F.upper("mention_id").alias("pattern"), F.lit(None).cast("string").alias("fragment"))
    return C.same_pattern(best, part_rules(t)).select("mention_id", "category", "pattern", "score", "score_percent")


@query("pattern_category_map", f"""
WITH {PART_RULES}
SELECT pattern, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM pr WHERE pattern IN (SELECT p_name FROM part WHERE p_size > 25) GROUP BY pattern
""")
def pattern_category_map(t: Tables) -> DataFrame:
    used = t.part.filter("p_size > 25").select(F.col("p_name").alias("pattern"))
    return C.pattern_categories(used, part_rules(t)).withColumn("categories", F.array_join("categories", ","))


NAMED_RULES = """names AS (SELECT DISTINCT p_name AS name FROM part),
known AS (SELECT p_type || '/' || p_name AS rule_id, p_type AS category, p_name AS pattern FROM part GROUP BY p_type, p_name HAVING max(p_size) > 10),
asked AS (SELECT DISTINCT {a} AS a, {b} AS b FROM names, (SELECT DISTINCT pattern FROM known))"""


@query("fuzzy_rules_ratio", f"""
WITH RECURSIVE {NAMED_RULES.format(a='pattern', b='name')}, {ratio_sql('asked')},
ranked AS (SELECT b AS name, category, rule_id, score FROM ratios JOIN known ON pattern = a WHERE score >= 0.5
           QUALIFY row_number() OVER (PARTITION BY b, category ORDER BY score DESC, rule_id) = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, category) AS rank FROM ranked)
SELECT p_partkey, category, rule_id, round(score, 6) AS score, 'fuzzy' AS method, rank FROM part JOIN top ON name = p_name
""")
def fuzzy_rules_ratio(t: Tables) -> DataFrame:
    """Distinct names are ranked once and joined back to their parts."""
    names = t.part.select(F.col("p_name").alias("mention_id")).distinct().withColumn("text", F.col("mention_id"))
    ranked = C.rank_categories(names, part_rules(t))
    return t.part.select("p_partkey", F.col("p_name").alias("mention_id")).join(ranked, "mention_id").select(
        "p_partkey", "category", "rule_id", F.round("score", 6).alias("score"), "method", "rank")


@query("similar_rules", f"""
WITH RECURSIVE {NAMED_RULES.format(a='name', b='pattern')}, {ratio_sql('asked')},
scored AS (SELECT a, b, CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE score END AS score FROM ratios)
SELECT a AS base_id, rule_id, round(score, 6) AS score, category, pattern, CAST(NULL AS VARCHAR) AS article,
       row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, category, pattern, rule_id) AS rank
FROM scored JOIN known ON pattern = b WHERE score >= 0.5
""")
def similar_rules(t: Tables) -> DataFrame:
    bases = t.part.select(F.col("p_name").alias("base_id")).distinct().withColumn("pattern", F.col("base_id"))
    return C.similar_rules(bases, part_rules(t))


@query("strategy_ladder", """
WITH a AS (SELECT doc_id, item_id, 'whole' AS strategy FROM documents d JOIN benchmark b ON instr(d.text, b.text) > 0),
b AS (SELECT doc_id, item_id, 'folded' AS strategy FROM documents d JOIN benchmark b ON instr(lower(d.text), lower(b.text)) > 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)
""")
def strategy_ladder(t: Tables) -> DataFrame:
    """The first strategy that finds anything in a document answers for it."""
    whole = D.contained_names(t.documents, t.benchmark, text_key="doc_id", text="text", name_key="item_id", name="text")
    low = t.documents.select("doc_id", F.lower("text").alias("text"))
    folded = t.benchmark.select("item_id", F.lower("text").alias("name"))
    part = D.contained_names(low, folded, text_key="doc_id", text="text", name_key="item_id", name="name")
    return replace_when_found(part.select("doc_id", "item_id", F.lit("folded").alias("strategy")),
                              whole.select("doc_id", "item_id", F.lit("whole").alias("strategy")), ["doc_id"])


@query("active_rules", """
SELECT p_type AS category, p_name AS pattern, regexp_matches(p_name, '[.^$*+?{}\\[\\]\\\\|()]') AS is_regex FROM part GROUP BY ALL HAVING max(p_size) > 10
""")
def active_rules(t: Tables) -> DataFrame:
    return C.active(part_rules(t)).select("category", "pattern", "is_regex")



LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(text: Column) -> Column:
    """A stand-in for a sentence encoder: how often each letter stands in the text, letters weighed so that no score is a round number."""
    return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) * F.lit(1 + i / 77) for i, c in enumerate(LETTERS)])


def part_units(t: Tables) -> DataFrame:
    """Units out of the parts' types and names, and a mention per part that spells, quotes, misspells or shortens its unit."""
    units = t.part.select(
        F.concat_ws("/", "p_type", "p_name").alias("unit_id"), F.col("p_type").alias("org_id"), F.col("p_name").alias("name"),
        F.concat_ws(" ", F.lower("p_type"), F.split("p_name", " ")[1]).alias("norm_short"), F.col("p_name").alias("norm_name")).distinct()
    return units.withColumn("embedding", letters(F.col("name")))


def part_mentions(t: Tables) -> DataFrame:
    second, kind, scope = F.split("p_name", " ")[1], F.col("p_partkey") % 4, F.col("p_partkey") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("seen "), "p_name", F.lit(" at the gate")))
        .when(kind == 1, F.concat(F.lit("near кпп «"), second, F.lit("» at night")))
        .when(kind == 2, F.concat(F.lower("p_type"), F.lit(" lot of "), F.expr("left(p_name, length(p_name) - 1)"), F.lit("x here")))
        .otherwise(F.concat(F.lit("by "), F.lower("p_type"), F.lit(" "), second, F.lit(" yard"))))
    return t.part.select(F.col("p_partkey").cast("string").alias("mention_id"), body.alias("text"),
                         F.when(scope == 0, F.lit(None)).when(scope == 1, "ELSEWHERE").otherwise(F.col("p_type")).alias("org_id"))


def letters_sql(of: str) -> str:
    return "[" + ", ".join(f"(length({of}) - length(replace({of}, '{c}', ''))) * CAST({1 + i / 77} AS DOUBLE)" for i, c in enumerate(LETTERS)) + "]"


MATCH_UNITS = f"""
WITH u AS (SELECT DISTINCT p_type || '/' || p_name AS unit_id, p_type AS org, p_name AS name, lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS short FROM part),
m AS (SELECT CAST(p_partkey AS VARCHAR) AS mention_id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_type END AS scope,
      CASE WHEN p_partkey % 4 = 1 THEN split_part(p_name, ' ', 2) END AS quoted,
      CASE p_partkey % 4 WHEN 0 THEN 'seen ' || p_name || ' at the gate' WHEN 1 THEN 'near кпп ' || split_part(p_name, ' ', 2) || ' at night'
        WHEN 2 THEN lower(p_type) || ' lot of ' || left(p_name, length(p_name) - 1) || 'x here' ELSE 'by ' || lower(p_type) || ' ' || split_part(p_name, ' ', 2) || ' yard' END AS folded FROM part),
p AS MATERIALIZED (SELECT m.*, u.*, CASE WHEN contains(folded, short) THEN short WHEN contains(folded, name) THEN name END AS token,
      string_split(folded, ' ') AS words, list_concat([x FOR x IN string_split(short, ' ') IF length(x) >= 4], [x FOR x IN string_split(name, ' ') IF length(x) >= 6]) AS evidence,
      [x FOR x IN string_split(short, ' ') IF length(x) > 4] AS keys FROM m JOIN u ON scope IS NULL OR scope = org),
s1 AS (SELECT *, CASE WHEN len([x FOR x IN evidence IF contains(folded, x)]) > 0 OR contains(folded, short) THEN 'strong'
      WHEN len(list_intersect(words, list_concat(string_split(short, ' '), string_split(name, ' ')))) > 0 THEN 'medium' ELSE 'none' END AS strength FROM p WHERE token IS NOT NULL),
one AS (SELECT *, bool_or(strength = 'strong') OVER (PARTITION BY mention_id) AS best FROM s1 WHERE strength <> 'none'),
first AS (SELECT mention_id, unit_id, name, 1.0 AS score, 'substring' AS method, strength, coalesce(contains(' ' || name || ' ', ' ' || quoted || ' '), false) AS lexical_hit,
      row_number() OVER (PARTITION BY mention_id ORDER BY length(token) DESC, instr(folded, token), unit_id) AS rank, instr(folded, token) - 1 AS span_start, instr(folded, token) - 1 + length(token) AS span_end
      FROM one WHERE NOT best OR strength = 'strong'),
second AS (SELECT mention_id, unit_id, name, 0.9 AS score, 'quoted_name' AS method, 'strong' AS strength, true AS lexical_hit,
      row_number() OVER (PARTITION BY mention_id ORDER BY name, unit_id) AS rank, instr(folded, quoted) AS span_start, instr(folded, quoted) + length(quoted) AS span_end
      FROM p WHERE quoted IS NOT NULL AND (list_contains(string_split(short, ' '), quoted) OR list_contains(string_split(name, ' '), quoted)) AND mention_id NOT IN (SELECT mention_id FROM first)),
w AS MATERIALIZED (SELECT mention_id, array_to_string(string_split(folded, ' ')[a + 1: a + z], ' ') AS win FROM m, range(0, 12) s(a), range(1, 7) t(z)
      WHERE a + z <= len(string_split(folded, ' ')) AND mention_id NOT IN (SELECT mention_id FROM first) AND mention_id NOT IN (SELECT mention_id FROM second)),
near AS (SELECT p.mention_id, unit_id, name, list_cosine_similarity({letters_sql('win')}, {letters_sql('name')}) * CASE WHEN len([x FOR x IN keys IF contains(folded, x)]) > 0 THEN 1.0 ELSE 0.1 END AS conf,
      len(list_intersect(keys, words)) AS overlap FROM p JOIN w ON w.mention_id = p.mention_id),
third AS (SELECT mention_id, unit_id, name, max(conf) AS score, 'semantic_window' AS method, CASE WHEN any_value(overlap) > 0 THEN 'medium' ELSE 'none' END AS strength, false AS lexical_hit,
      CAST(NULL AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS span_start, CAST(NULL AS BIGINT) AS span_end FROM near GROUP BY mention_id, unit_id, name HAVING max(conf) >= 0.6)
SELECT mention_id, unit_id, name, round(score, 6) AS score, method, strength, lexical_hit, rank, span_start, span_end FROM (SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)
"""


@query("match_units", MATCH_UNITS)
def match_units(t: Tables) -> DataFrame:
    """All three ways to a unit; among near vectors of equal score neither the rank nor the window is compared."""
    found = D.match_units(part_mentions(t), part_units(t), encoder=letters)
    exact = lambda c: F.when(F.col("method") != "semantic_window", F.col(c))
    return found.select("mention_id", "unit_id", "name", F.round("score", 6).alias("score"), "method", "strength", "lexical_hit",
                        exact("rank").alias("rank"), exact("span.start").alias("span_start"), exact("span.end").alias("span_end"))


@query("accept_unit", f"""
WITH r AS ({MATCH_UNITS}), b AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY rank) AS n FROM r WHERE method <> 'semantic_window')
SELECT mention_id, CASE WHEN score >= 0.75 OR lexical_hit THEN unit_id END AS unit_id, round(score, 6) AS unit_score,
       CASE WHEN score >= 0.75 THEN 'semantic_threshold' WHEN lexical_hit THEN 'lexical_quoted_hit' END AS unit_reason FROM b WHERE n = 1
UNION ALL SELECT mention_id, CASE WHEN max(score) >= 0.75 THEN '' END, max(score), CASE WHEN max(score) >= 0.75 THEN 'semantic_threshold' END
FROM r WHERE method = 'semantic_window' GROUP BY mention_id
""")
def accept_unit(t: Tables) -> DataFrame:
    """The first candidate where it is good enough; of near vectors only that there is one."""
    mentions = part_mentions(t)
    # read twice below
    found = cut(D.match_units(mentions, part_units(t), encoder=letters).filter("rank = 1"))
    near = found.filter("method = 'semantic_window'").select(F.col("mention_id").alias("_m")).withColumn("_near", F.lit(True))
    taken = D.accept_unit(found, mentions).join(near, F.col("mention_id") == F.col("_m"), "left")
    return taken.select("mention_id", F.when(F.col("_near") & F.col("unit_id").isNotNull(), "").otherwise(F.col("unit_id")).alias("unit_id"),
                        F.round("unit_score", 6).alias("unit_score"), "unit_reason")
