"""Registered queries over the derived dossiers, each with the same rule stated in DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.functions import text as fn
from tagmask.model import CATEGORIES
from tagmask.operators import detect, masking, merging, restore, review, state
from tagmask.plans.derived import register, with_derived
from tagmask.sources import ingest, responses, vault
from tagmask.sources.scratch import kept_by, scratch
from tagmask.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: bool = False):
    """Register a query; `sql` goes on after the derived tables (unless plain)."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql if plain else with_derived(sql)
        return f

    return add


# --- shared SQL: tags, writings, masking ---------------------------------------------------------------------------------
TAGS = """
firsts AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, value ORDER BY arrival, det_seq, category) AS r FROM detections WHERE value <> ''),
fresh AS (SELECT dossier_id, value, category FROM firsts WHERE r = 1),
tags0 AS (SELECT dossier_id, category, value, row_number() OVER (PARTITION BY dossier_id, category ORDER BY length(value) DESC, value) AS idx,
  row_number() OVER (PARTITION BY dossier_id ORDER BY length(value) DESC, value) AS pos FROM fresh),
tags AS MATERIALIZED (SELECT *, '[' || category || '_' || idx || ']' AS tag FROM tags0)"""
HITS = """,
finds AS (SELECT l.dossier_id, l.doc_id, l.text, t.tag, t.value, t.pos FROM letters l JOIN tags t ON l.dossier_id = t.dossier_id AND contains(l.text, t.value)),
lists AS (SELECT dossier_id, doc_id, any_value(text) AS text, list(value || chr(31) || chr(57344) || translate(CAST(pos AS VARCHAR), '0123456789', chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350) || chr(57351) || chr(57352) || chr(57353) || chr(57354)) || chr(57355) ORDER BY pos) AS ws,
  list(chr(57344) || translate(CAST(pos AS VARCHAR), '0123456789', chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350) || chr(57351) || chr(57352) || chr(57353) || chr(57354)) || chr(57355) || chr(31) || tag ORDER BY pos) AS back FROM finds GROUP BY dossier_id, doc_id),
folded AS MATERIALIZED (SELECT dossier_id, doc_id, text, back, list_reduce(list_concat([text], ws), lambda t, w: replace(t, split_part(w, chr(31), 1), split_part(w, chr(31), 2))) AS f FROM lists),
masks AS (SELECT l.dossier_id, l.doc_id, l.arrival, l.filename, l.text, coalesce(list_reduce(list_concat([f.f], f.back), lambda t, w: replace(t, split_part(w, chr(31), 1), split_part(w, chr(31), 2))), l.text) AS masked
  FROM letters l LEFT JOIN folded f ON l.dossier_id = f.dossier_id AND l.doc_id = f.doc_id)"""
REGIONS = """,
cut AS (SELECT dossier_id, doc_id, regexp_split_to_array(f, chr(57344) || '[^' || chr(57355) || ']*' || chr(57355)) AS texts,
  list_transform(regexp_extract_all(f, chr(57344) || '[^' || chr(57355) || ']*' || chr(57355)), lambda s: CAST(translate(s[2:-2], chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349) || chr(57350) || chr(57351) || chr(57352) || chr(57353) || chr(57354), '0123456789') AS BIGINT)) AS places FROM folded),
pieces AS (SELECT dossier_id, doc_id, unnest(places) AS pos, unnest(texts[:-2]) AS gap, generate_subscripts(places, 1) AS i FROM cut),
regions AS MATERIALIZED (SELECT p.dossier_id, p.doc_id, p.i, t.tag, t.category, length(t.value) AS size, CAST(sum(length(gap) + length(t.value)) OVER (PARTITION BY p.dossier_id, p.doc_id ORDER BY i) AS INT) AS stop
  FROM pieces p JOIN tags t ON p.dossier_id = t.dossier_id AND p.pos = t.pos),
counted AS (SELECT t.*, coalesce(n, 0) AS occurrences, CASE WHEN n > 0 THEN 'APPLIED' ELSE 'NOT_FOUND' END AS status
  FROM tags t LEFT JOIN (SELECT dossier_id, tag, count(*) AS n FROM regions GROUP BY ALL) c ON t.dossier_id = c.dossier_id AND t.tag = c.tag)"""
#: The same counts without masking anything, from what letters are made of: every value stands where the letter puts it, and a
#: value inside another (as EUR 12 in EUR 123) is never claimed there, as the longer one is a value of the dossier, too.
FACTS = """,
placed AS (SELECT dossier_id, arrival, c_name AS value, 1 AS n FROM letter_parts UNION ALL SELECT dossier_id, arrival, person, 2 FROM letter_parts
  UNION ALL SELECT dossier_id, arrival, 'EUR ' || amount, 1 FROM letter_parts UNION ALL SELECT dossier_id, arrival, day, 1 FROM letter_parts
  UNION ALL SELECT dossier_id, arrival, 'P/' || number, 1 FROM letter_parts UNION ALL SELECT dossier_id, arrival, 'u' || custkey || '@example.com', 1 FROM letter_parts),
totals AS (SELECT dossier_id, value, CAST(sum(n) AS BIGINT) AS n FROM placed GROUP BY dossier_id, value),
counted AS MATERIALIZED (SELECT t.*, coalesce(n, 0) AS occurrences, CASE WHEN n > 0 THEN 'APPLIED' ELSE 'NOT_FOUND' END AS status
  FROM tags t LEFT JOIN totals c ON t.dossier_id = c.dossier_id AND t.value = c.value)"""
OFF = """,
offs AS (SELECT c.* REPLACE (CASE WHEN category = 'PRATICA' AND idx % 2 = 0 THEN 'DISABLED' ELSE status END AS status) FROM counted c),
activity AS (SELECT o.*, status <> 'DISABLED' AND coalesce(s.enabled, true) AS active FROM offs o LEFT JOIN switches s ON o.dossier_id = s.dossier_id AND o.category = s.category)"""


def _tags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = register(spark, sf, "letters", "detections", keep=True)
    return d["letters"], masking.assign_tags(masking.new_values(d["detections"]))


def _counted(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Letters, counted tags of which some are switched off, and category switches."""
    d = register(spark, sf, "letters", "detections", "switches", keep=True)
    tags = kept_by(masking.analyse(d["letters"], d["detections"]), "dossier_id")
    off = (F.col("category") == "PRATICA") & (F.col("idx") % 2 == 0)
    return d["letters"], tags.withColumn("status", F.when(off, "DISABLED").otherwise(F.col("status"))), d["switches"]


# --- assignment and masking ----------------------------------------------------------------------------------------------
@query("mask_documents", TAGS[1:] + HITS + " SELECT dossier_id, doc_id, masked FROM masks")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return masking.mask_documents(docs, tags).select("dossier_id", "doc_id", "masked")


@query("new_values", TAGS[1:] + " SELECT * FROM fresh")
def _(spark, sf):
    return masking.new_values(register(spark, sf, "detections")["detections"])


@query("assign_tags", TAGS[1:] + " SELECT dossier_id, tag, category, idx, value, pos FROM tags")
def _(spark, sf):
    return _tags(spark, sf)[1].select("dossier_id", "tag", "category", "idx", "value", "pos")


@query("assign_tags_wide", "SELECT 'all' AS dossier_id, category, value, row_number() OVER (PARTITION BY category ORDER BY length(value) DESC, value) AS idx FROM (SELECT DISTINCT category, value FROM detections WHERE value <> '')")
def _(spark, sf):
    values = register(spark, sf, "detections")["detections"].filter("value <> ''").select(F.lit("all").alias("dossier_id"), "category", "value").distinct()
    return masking.assign_tags(values, wide=True).select("dossier_id", "category", "value", "idx")


@query("incremental_tags", """old_first AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, value ORDER BY arrival, det_seq, category) AS r FROM detections WHERE value <> '' AND arrival % 2 = 0),
old AS (SELECT dossier_id, category, value, row_number() OVER (PARTITION BY dossier_id, category ORDER BY length(value) DESC, value) AS idx FROM old_first WHERE r = 1),
new_first AS (SELECT d.*, row_number() OVER (PARTITION BY d.dossier_id, d.value ORDER BY arrival, det_seq, d.category) AS r FROM detections d ANTI JOIN old ON d.dossier_id = old.dossier_id AND d.value = old.value WHERE d.value <> '' AND arrival % 2 = 1),
tops AS (SELECT dossier_id, category, max(idx) AS top FROM old GROUP BY ALL),
fresh AS (SELECT n.dossier_id, n.category, value, coalesce(top, 0) + row_number() OVER (PARTITION BY n.dossier_id, n.category ORDER BY length(value) DESC, value) AS idx FROM new_first n LEFT JOIN tops t ON n.dossier_id = t.dossier_id AND n.category = t.category WHERE r = 1)
SELECT dossier_id, category, value, CAST(idx AS BIGINT) AS idx FROM old UNION ALL SELECT dossier_id, category, value, CAST(idx AS BIGINT) FROM fresh""")
def _(spark, sf):
    dets = register(spark, sf, "detections")["detections"]
    old = masking.assign_tags(masking.new_values(dets.filter("arrival % 2 = 0")))
    counters = masking.advance_counters(spark.createDataFrame([], "dossier_id string, category string, last_idx long"), old)
    fresh = masking.assign_tags(masking.new_values(dets.filter("arrival % 2 = 1"), old), counters, old)
    return old.unionByName(fresh).select("dossier_id", "category", "value", "idx")


@query("counters", TAGS[1:] + " SELECT dossier_id, category, CAST(max(idx) AS BIGINT) AS last_idx FROM tags GROUP BY ALL")
def _(spark, sf):
    empty = spark.createDataFrame([], "dossier_id string, category string, last_idx long")
    return masking.advance_counters(empty, _tags(spark, sf)[1])


@query("writings", TAGS[1:] + " SELECT dossier_id, tag, value AS writing, CAST(pos AS INT) AS rank FROM tags")
def _(spark, sf):
    return masking.writings(_tags(spark, sf)[1])


@query("claimed_regions", TAGS[1:] + HITS + REGIONS + ' SELECT dossier_id, doc_id, CAST(stop - size AS INT) AS start, stop AS "end", tag FROM regions')
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return masking.claimed_regions(docs, masking.writings(tags))


@query("count_occurrences", TAGS[1:] + FACTS + " SELECT dossier_id, tag, occurrences, status FROM counted")
def _(spark, sf):
    d = register(spark, sf, "letters", "detections", keep=True)
    return masking.analyse(d["letters"], d["detections"]).select("dossier_id", "tag", "occurrences", "status")


@query("segments", TAGS[1:] + HITS + REGIONS + OFF + """,
parts AS (SELECT dossier_id, doc_id, 2 * i - 2 AS o, gap AS text, NULL AS tag FROM pieces UNION ALL SELECT p.dossier_id, p.doc_id, 2 * i - 1, t.value, t.tag FROM pieces p JOIN tags t ON p.dossier_id = t.dossier_id AND p.pos = t.pos
  UNION ALL SELECT dossier_id, doc_id, 1000000, texts[-1], NULL FROM cut)
SELECT p.dossier_id, p.doc_id, CAST(row_number() OVER (PARTITION BY p.dossier_id, p.doc_id ORDER BY o) - 1 AS INT) AS seq, text, p.tag, a.category, coalesce(active, false) AS masked
FROM parts p LEFT JOIN activity a ON p.dossier_id = a.dossier_id AND p.tag = a.tag WHERE text <> ''""")
def _(spark, sf):
    return masking.segments(*_counted(spark, sf))


@query("active_tags", TAGS[1:] + FACTS + OFF + " SELECT dossier_id, tag FROM activity WHERE active")
def _(spark, sf):
    _, tags, switches = _counted(spark, sf)
    return masking.active_tags(tags, switches).select("dossier_id", "tag")


@query("mask_active", TAGS[1:] + HITS + REGIONS + OFF + HITS.replace("finds", "finds2").replace("lists", "lists2").replace("folded", "folded2").replace("masks", "masks2").replace("JOIN tags t", "JOIN (SELECT * FROM activity WHERE active) t") + " SELECT dossier_id, doc_id, masked FROM masks2")
def _(spark, sf):
    return masking.mask_documents(*_counted(spark, sf)).select("dossier_id", "doc_id", "masked")


@query("mask_wide", """spelled AS (SELECT DISTINCT c_name AS writing FROM letter_parts)
SELECT doc_id, replace(text, c_name, '[AZIENDA_' || n || ']') AS masked FROM letters l JOIN letter_parts USING (doc_id) JOIN (SELECT writing, row_number() OVER (ORDER BY length(writing) DESC, writing) AS n FROM spelled) s ON s.writing = c_name""")
def _(spark, sf):
    d = register(spark, sf, "letters", "letter_parts")
    names = d["letter_parts"].select(F.lit("all").alias("dossier_id"), F.lit("AZIENDA").alias("category"), F.col("c_name").alias("value")).distinct()
    ranked = masking.writings(masking.assign_tags(names))
    return masking.mask_wide(d["letters"].select("doc_id", "text"), ranked).select("doc_id", "masked")


@query("remove_documents", TAGS[1:] + HITS + REGIONS + """, left_of AS (SELECT dossier_id, tag, count(*) AS n FROM regions WHERE CAST(doc_id[3:] AS BIGINT) % 4 <> 0 GROUP BY ALL)
SELECT dossier_id, tag, n AS occurrences FROM left_of""")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    gone = docs.filter("arrival % 4 = 0").select("dossier_id", "doc_id")
    return masking.remove_documents(docs, tags, gone).select("dossier_id", "tag", "occurrences")


@query("pending_documents", "SELECT dossier_id, doc_id FROM letters WHERE arrival % 3 <> 0")
def _(spark, sf):
    docs = register(spark, sf, "letters")["letters"]
    return masking.pending_documents(docs, docs.filter("arrival % 3 = 0").select("dossier_id", "doc_id")).select("dossier_id", "doc_id")


COMMANDS = "commands AS (SELECT dossier_id, arrival AS seq, tag AS target, arrival % 2 = 0 AS enabled FROM (SELECT dossier_id, arrival, '[PERSONA_' || (arrival % 5 + 1) || ']' AS tag FROM letter_parts))"


def _commands(spark, sf):
    parts = register(spark, sf, "letter_parts")["letter_parts"]
    return parts.select("dossier_id", F.col("arrival").alias("seq"), F.concat(F.lit("[PERSONA_"), (F.col("arrival") % 5 + 1).cast("string"), F.lit("]")).alias("target"), (F.col("arrival") % 2 == 0).alias("enabled"))


@query("set_tag", TAGS[1:] + FACTS + ", " + COMMANDS + """, last AS (SELECT dossier_id, target, arg_max(enabled, seq) AS e FROM commands GROUP BY ALL)
SELECT c.dossier_id, tag, CASE WHEN e IS NULL THEN status WHEN NOT e THEN 'DISABLED' WHEN occurrences > 0 THEN 'APPLIED' ELSE 'NOT_FOUND' END AS status FROM counted c LEFT JOIN last l ON c.dossier_id = l.dossier_id AND c.tag = l.target""")
def _(spark, sf):
    d = register(spark, sf, "letters", "detections", keep=True)
    return masking.set_tag(masking.analyse(d["letters"], d["detections"]), _commands(spark, sf)).select("dossier_id", "tag", "status")


@query("unknown_tags", TAGS[1:] + ", " + COMMANDS + " SELECT dossier_id, target, seq, enabled FROM commands c ANTI JOIN tags t ON c.dossier_id = t.dossier_id AND c.target = t.tag")
def _(spark, sf):
    return masking.unknown_tags(_tags(spark, sf)[1], _commands(spark, sf))


@query("set_category", "cmd AS (SELECT dossier_id, arrival AS seq, CASE WHEN arrival % 2 = 0 THEN 'DATA' ELSE 'EMAIL' END AS category, arrival % 3 = 0 AS enabled FROM letter_parts UNION ALL SELECT dossier_id, -1, category, enabled FROM switches) SELECT dossier_id, category, arg_max(enabled, seq) AS enabled FROM cmd GROUP BY ALL")
def _(spark, sf):
    d = register(spark, sf, "letter_parts", "switches")
    commands = d["letter_parts"].select("dossier_id", F.col("arrival").alias("seq"), F.when(F.col("arrival") % 2 == 0, "DATA").otherwise("EMAIL").alias("target"), (F.col("arrival") % 3 == 0).alias("enabled"))
    return masking.set_category(d["switches"], commands)


@query("manual_values", TAGS[1:].replace("FROM detections", "FROM (SELECT * FROM detections UNION ALL SELECT dossier_id, NULL, 4611686018427387903, 0, filename, 'PERSONA' FROM letters WHERE arrival % 9 = 0)") + " SELECT dossier_id, category, value, idx FROM tags")
def _(spark, sf):
    d = register(spark, sf, "letters", "detections")
    manual = d["letters"].filter("arrival % 9 = 0").select("dossier_id", F.col("filename").alias("value"), F.lit("PERSONA").alias("category"))
    both = detect.with_manual_values(d["detections"], manual)
    return masking.assign_tags(masking.new_values(both)).select("dossier_id", "category", "value", "idx")


# --- restore -------------------------------------------------------------------------------------------------------------
ANSWERS = """, answers AS (SELECT CASE WHEN arrival % 17 = 0 THEN 'nobody' ELSE dossier_id END AS dossier_id, doc_id AS answer_id, CASE WHEN arrival % 10 = 0 THEN replace(masked, ']', '') WHEN arrival % 11 = 0 THEN masked || ' [PERSONA_999999]' WHEN arrival % 13 = 0 THEN lower(masked) WHEN arrival % 19 = 0 THEN '  ' ELSE masked END AS text FROM masks),
broken AS (SELECT *, list_filter(regexp_extract_all(text, '\\[[A-Za-z]+[_\\-\\s]?[0-9]*\\]?'), lambda x: NOT regexp_full_match(x, '\\[[A-Z]+_[0-9]+\\]')) AS bad, list_distinct(regexp_extract_all(text, '\\[[A-Z]+_[0-9]+\\]')) AS found FROM answers),
keys AS (SELECT dossier_id, list(tag) AS tags FROM tags GROUP BY dossier_id),
judged AS (SELECT b.*, k.tags IS NULL AS nobody, list_sort(list_filter(found, lambda x: NOT list_contains(k.tags, x))) AS strange FROM broken b LEFT JOIN keys k ON b.dossier_id = k.dossier_id),
verdicts AS (SELECT *, CASE WHEN nobody THEN 'DOSSIER_NOT_FOUND' WHEN trim(text) = '' THEN 'EMPTY' WHEN len(bad) > 0 THEN 'MALFORMED' WHEN len(strange) > 0 THEN 'UNKNOWN' ELSE 'OK' END AS verdict FROM judged)"""


def _answers(spark, sf):
    docs, tags = _tags(spark, sf)
    masked = masking.mask_documents(docs, tags)
    arrival, text = F.col("arrival"), F.col("masked")
    broken = F.when(arrival % 10 == 0, F.replace(text, F.lit("]"), F.lit(""))).when(arrival % 11 == 0, F.concat(text, F.lit(" [PERSONA_999999]"))).when(arrival % 13 == 0, F.lower(text)).when(arrival % 19 == 0, "  ").otherwise(text)
    return masked.select(F.when(arrival % 17 == 0, "nobody").otherwise(F.col("dossier_id")).alias("dossier_id"), F.col("doc_id").alias("answer_id"), broken.alias("text")), tags


@query("restore_verdicts", TAGS[1:] + HITS + ANSWERS + " SELECT dossier_id, answer_id, verdict, CASE verdict WHEN 'MALFORMED' THEN bad WHEN 'UNKNOWN' THEN strange ELSE [] END AS fragments FROM verdicts")
def _(spark, sf):
    answers, tags = _answers(spark, sf)
    return restore.restore(answers, masking.restore_dictionary(tags)).select("dossier_id", "answer_id", "verdict", "fragments")


@query("restore_texts", TAGS[1:] + HITS + ANSWERS + """, used AS (SELECT v.dossier_id, v.answer_id, any_value(v.text) AS text, list(t.tag || chr(31) || t.value ORDER BY -length(t.tag), pos) AS ws FROM verdicts v JOIN tags t ON v.dossier_id = t.dossier_id AND list_contains(v.found, t.tag) WHERE verdict = 'OK' GROUP BY v.dossier_id, v.answer_id)
SELECT v.dossier_id, v.answer_id, CASE WHEN verdict = 'OK' THEN coalesce(list_reduce(list_concat([u.text], ws), lambda t, w: replace(t, split_part(w, chr(31), 1), split_part(w, chr(31), 2))), v.text) END AS restored FROM verdicts v LEFT JOIN used u ON v.dossier_id = u.dossier_id AND v.answer_id = u.answer_id""")
def _(spark, sf):
    answers, tags = _answers(spark, sf)
    return restore.restore(answers, masking.restore_dictionary(tags)).select("dossier_id", "answer_id", "restored")


@query("fragment_fixes", TAGS[1:] + """ SELECT dossier_id, doc_id AS answer_id, CASE WHEN arrival % 7 = 0 THEN 'UNKNOWN' ELSE 'OK' END AS verdict, CASE WHEN arrival % 7 <> 0 THEN text END AS restored FROM letters""")
def _(spark, sf):
    """Every masked letter with altered placeholders; the fixes of each seventh name a tag that the dossier has not."""
    docs, tags = _tags(spark, sf)
    masked = masking.mask_documents(docs, tags).select("dossier_id", "arrival", F.col("doc_id").alias("answer_id"), F.regexp_replace("masked", r"\[PERSONA_(\d+)\]", "[Persona $1]").alias("text"))
    bad = masked.select("dossier_id", "answer_id", "arrival", F.posexplode(F.array_distinct(fn.altered(F.col("text")))).alias("seq", "fragment"))
    right = F.regexp_replace(F.upper("fragment"), " ", "_")
    fixes = bad.withColumn("tag", F.when(F.col("arrival") % 7 == 0, F.lit("[PERSONA_999999999]")).otherwise(right)).drop("arrival")
    fixed = restore.apply_fragment_fixes(masked.drop("arrival"), fixes)
    return restore.restore(fixed, masking.restore_dictionary(tags)).select("dossier_id", "answer_id", "verdict", "restored")


@query("missing_values", TAGS[1:] + HITS + """, said AS (SELECT dossier_id, doc_id, unnest(list_distinct(regexp_extract_all(masked, '\\[[A-Z]+_[0-9]+\\]'))) AS tag FROM masks)
SELECT m.dossier_id, m.doc_id AS answer_id, t.tag FROM masks m JOIN tags t ON m.dossier_id = t.dossier_id ANTI JOIN said s ON m.dossier_id = s.dossier_id AND m.doc_id = s.doc_id AND t.tag = s.tag""")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return restore.missing_values(masking.mask_documents(docs, tags).select("dossier_id", F.col("doc_id").alias("answer_id"), F.col("masked").alias("text")), tags)


@query("missing_bitmaps", TAGS[1:] + HITS + """, said AS (SELECT dossier_id, doc_id, unnest(list_distinct(regexp_extract_all(masked, '\\[[A-Z]+_[0-9]+\\]'))) AS tag FROM masks)
SELECT m.dossier_id, m.doc_id AS answer_id, t.tag FROM masks m JOIN tags t ON m.dossier_id = t.dossier_id ANTI JOIN said s ON m.dossier_id = s.dossier_id AND m.doc_id = s.doc_id AND t.tag = s.tag""")
def _(spark, sf):
    """A bitmap per masked letter, expanded again."""
    docs, tags = _tags(spark, sf)
    answers = masking.mask_documents(docs, tags).select("dossier_id", F.col("doc_id").alias("answer_id"), F.col("masked").alias("text"))
    return restore.expand_missing(restore.missing_bitmaps(answers, tags), tags)


@query("approval_digest_hot", TAGS[1:] + HITS + " SELECT 'all' AS dossier_id, sha256(string_agg(filename || chr(10) || length(masked) || chr(10) || masked, '' ORDER BY filename, doc_id)) AS digest FROM masks")
def _(spark, sf):
    """All masked letters as the documents of one dossier."""
    docs, tags = _tags(spark, sf)
    return review.approval_digest(masking.mask_documents(docs, tags).withColumn("dossier_id", F.lit("all")))


# --- review --------------------------------------------------------------------------------------------------------------
@query("exposure", TAGS[1:] + HITS + REGIONS + OFF + " SELECT dossier_id, CAST(sum(CASE WHEN NOT active THEN occurrences ELSE 0 END) AS BIGINT) AS in_clear, CAST(sum(CASE WHEN active THEN occurrences ELSE 0 END) AS BIGINT) AS masked FROM activity GROUP BY dossier_id")
def _(spark, sf):
    _, tags, switches = _counted(spark, sf)
    return review.exposure(tags, switches)


@query("exposure_by_category", TAGS[1:] + HITS + REGIONS + OFF + ", g AS (SELECT dossier_id, category, CAST(sum(occurrences) AS BIGINT) AS in_clear FROM activity WHERE NOT active AND occurrences > 0 GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY dossier_id ORDER BY in_clear DESC, category) AS INT) AS place FROM g")
def _(spark, sf):
    _, tags, switches = _counted(spark, sf)
    return review.exposure_by_category(tags, switches)


@query("category_summary", TAGS[1:] + f", g AS (SELECT dossier_id, category, count(*) AS tags FROM tags GROUP BY ALL) SELECT g.dossier_id, g.category, tags, coalesce(enabled, true) AS enabled, CAST(list_position({list(CATEGORIES)}, g.category) AS INT) AS place FROM g LEFT JOIN switches s ON g.dossier_id = s.dossier_id AND g.category = s.category")
def _(spark, sf):
    return review.category_summary(_tags(spark, sf)[1], register(spark, sf, "switches")["switches"])


@query("dossier_totals", "t AS (SELECT * FROM letters) SELECT dossier_id, count(*) AS documents, CAST(count(*) AS BIGINT) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS warnings FROM t GROUP BY dossier_id")
def _(spark, sf):
    return review.dossier_totals(register(spark, sf, "letters")["letters"].withColumn("page_offsets", F.array(F.lit(0))))


@query("usage_cost", "s AS (SELECT session_id, CAST(sum(token_in) AS BIGINT) AS token_in, CAST(sum(token_out) AS BIGINT) AS token_out, count(*) AS calls FROM usage GROUP BY GROUPING SETS ((session_id), ())) SELECT *, round((token_in * 0.3 + token_out * 2.5) / 1e6, 9) AS cost, true AS priced FROM s")
def _(spark, sf):
    return review.usage_cost(register(spark, sf, "usage")["usage"], 0.3, 2.5).withColumn("cost", F.round("cost", 9))


@query("approval_digest", TAGS[1:] + HITS + " SELECT dossier_id, sha256(string_agg(filename || chr(10) || length(masked) || chr(10) || masked, '' ORDER BY filename, doc_id)) AS digest FROM masks GROUP BY dossier_id")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return review.approval_digest(masking.mask_documents(docs, tags))


@query("approval_digest_wide", TAGS[1:] + HITS + " SELECT dossier_id, sha256(string_agg(sha256(filename || chr(10) || length(masked) || chr(10) || masked), '' ORDER BY filename, doc_id)) AS digest_of_digests FROM masks GROUP BY dossier_id")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return review.approval_digest_wide(masking.mask_documents(docs, tags))


@query("review", TAGS[1:] + HITS + REGIONS + OFF + f""", e AS (SELECT dossier_id, CAST(sum(CASE WHEN NOT active THEN occurrences ELSE 0 END) AS BIGINT) AS in_clear, CAST(sum(CASE WHEN active THEN occurrences ELSE 0 END) AS BIGINT) AS masked FROM activity GROUP BY dossier_id),
k AS (SELECT dossier_id, list(DISTINCT category ORDER BY list_position({list(CATEGORIES)}, category)) AS categories FROM tags GROUP BY dossier_id), t AS (SELECT dossier_id, count(*) AS documents, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS warnings FROM letters GROUP BY dossier_id)
, x AS (SELECT dossier_id, list(category || ':' || n ORDER BY n DESC, category) AS exposed
  FROM (SELECT dossier_id, category, CAST(sum(occurrences) AS BIGINT) AS n FROM activity WHERE NOT active AND occurrences > 0 GROUP BY ALL) GROUP BY dossier_id)
SELECT t.dossier_id, 'PENDING_REVIEW' AS state, documents, pages, characters, warnings, in_clear, masked, exposed, categories
FROM t LEFT JOIN e USING (dossier_id) LEFT JOIN x USING (dossier_id) LEFT JOIN k USING (dossier_id)""")
def _(spark, sf):
    docs, tags, switches = _counted(spark, sf)
    dossiers = docs.select("dossier_id").distinct().withColumn("state", F.lit("PENDING_REVIEW"))
    return review.review(docs.withColumn("page_offsets", F.array(F.lit(0))), tags, switches, dossiers)


@query("existing_placeholders", TAGS[1:] + HITS + """, f AS (SELECT dossier_id, doc_id, regexp_extract_all(masked, '\\[[A-Z]+_[0-9]+\\]') AS p, regexp_split_to_array(masked, '\\[[A-Z]+_[0-9]+\\]') AS t FROM masks),
u AS (SELECT dossier_id, doc_id, unnest(p) AS placeholder, unnest(t[:-2]) AS gap, generate_subscripts(p, 1) AS i FROM f)
SELECT dossier_id, doc_id, CAST(i - 1 AS INT) AS seq, CAST(sum(length(gap) + length(placeholder)) OVER (PARTITION BY dossier_id, doc_id ORDER BY i) - length(placeholder) AS INT) AS position, placeholder FROM u""")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return review.existing_placeholders(masking.mask_documents(docs, tags).select("dossier_id", "doc_id", F.col("masked").alias("text")))


@query("top_warnings", TAGS[1:] + HITS + """, f AS (SELECT dossier_id, doc_id, regexp_extract_all(masked, '\\[[A-Z]+_[0-9]+\\]') AS p FROM masks) SELECT dossier_id, doc_id, p[:3] AS shown, CAST(greatest(len(p) - 3, 0) AS INT) AS more FROM f WHERE len(p) > 0""")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return review.top_warnings(masking.mask_documents(docs, tags).select("dossier_id", "doc_id", F.col("masked").alias("text")), 3)


@query("excerpt", "SELECT doc_id, CASE WHEN t = '' THEN NULL WHEN length(t) <= 140 THEN t ELSE t[:140] || '…' END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)", plain=True)
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", fn.excerpt(F.col("text")).alias("excerpt"))


@query("leak_audit", TAGS[1:] + HITS + REGIONS + OFF + " SELECT dossier_id, CAST(0 AS BIGINT) AS leaks FROM letters GROUP BY dossier_id")
def _(spark, sf):
    docs, tags, switches = _counted(spark, sf)
    leaks = review.leak_audit(masking.mask_documents(docs, tags, switches), tags, switches).groupBy("dossier_id").agg(F.count("*").alias("leaks"))
    return docs.select("dossier_id").distinct().join(leaks, "dossier_id", "left").fillna(0, ["leaks"])


@query("round_trip_audit", "SELECT dossier_id, CAST(0 AS BIGINT) AS broken FROM letters GROUP BY dossier_id")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    broken = review.round_trip_audit(docs, tags).groupBy("dossier_id").agg(F.count("*").alias("broken"))
    return docs.select("dossier_id").distinct().join(broken, "dossier_id", "left").fillna(0, ["broken"])


@query("segments_audit", "SELECT dossier_id, CAST(0 AS BIGINT) AS broken FROM letters GROUP BY dossier_id")
def _(spark, sf):
    docs, tags, switches = _counted(spark, sf)
    broken = review.segments_audit(docs, tags, switches).groupBy("dossier_id").agg(F.count("*").alias("broken"))
    return docs.select("dossier_id").distinct().join(broken, "dossier_id", "left").fillna(0, ["broken"])


@query("recall_audit", """j AS (SELECT t.doc_id, t.value, f.value IS NOT NULL AS hit FROM (SELECT DISTINCT doc_id, value FROM detections) t LEFT JOIN (SELECT DISTINCT doc_id, value FROM detections WHERE category <> 'PERSONA') f ON t.doc_id = f.doc_id AND t.value = f.value)
SELECT doc_id, count(*) AS planned, count(*) FILTER (hit) AS found, coalesce(list(value ORDER BY value) FILTER (NOT hit), []) AS missing, count(*) FILTER (hit) >= count(*) // 2 AS passed FROM j GROUP BY doc_id""")
def _(spark, sf):
    dets = register(spark, sf, "detections")["detections"]
    return review.recall_audit(dets, dets.filter("category <> 'PERSONA'"))


@query("not_found_report", TAGS[1:] + FACTS + " SELECT dossier_id, tag, category, value FROM counted WHERE status = 'NOT_FOUND'")
def _(spark, sf):
    d = register(spark, sf, "letters", "detections")
    return review.not_found_report(masking.analyse(d["letters"], d["detections"]))


# --- names and merges ----------------------------------------------------------------------------------------------------
TITLES_SQL = "^((" + "|".join(t.replace(".", r"\.") for t in fn.TITLES) + ")( |$))+"
_NORM = f"trim(regexp_replace(trim(regexp_replace(lower(value), '\\s+', ' ', 'g')), '{TITLES_SQL}', ''))"
MERGE = f"""fresh AS (SELECT DISTINCT dossier_id, person AS value FROM persons),
names AS (SELECT *, row_number() OVER (PARTITION BY dossier_id ORDER BY length(value) DESC, value) AS idx, list_filter(regexp_split_to_array({_NORM}, '[\\s,]+'), lambda t: t <> '') AS t FROM fresh),
pairs AS (SELECT a.dossier_id, a.idx AS i, b.idx AS j, a.t AS t, b.t AS u FROM names a JOIN names b ON a.dossier_id = b.dossier_id AND a.idx < b.idx AND len(a.t) = len(b.t) AND len(a.t) > 0),
two AS (SELECT *, list_sort(t) = list_sort(u) AS same, CASE WHEN len(t) = 2 THEN [fits(t[1], u[1]), fits(t[1], u[2]), fits(t[2], u[1]), fits(t[2], u[2])] END AS m FROM pairs)"""


def _fits(a: str, b: str) -> str:
    x, y = f"rtrim({a}, '.')", f"rtrim({b}, '.')"
    return f"({a} = {b} OR (length({x}) = 1 AND length({y}) > 1 AND starts_with({y}, {x})) OR (length({y}) = 1 AND length({x}) > 1 AND starts_with({x}, {y})))"


for _a in ("t[1]", "t[2]"):
    for _b in ("u[1]", "u[2]"):
        MERGE = MERGE.replace(f"fits({_a}, {_b})", _fits(_a, _b))
# Greedy over two tokens: the first token takes the first fitting one, the second must fit what is left. Names of other
# lengths have no initials here, so they are equivalent only as multisets.
MERGE += """,
suggested AS (SELECT dossier_id, '[PERSONA_' || i || ']' AS tag_a, '[PERSONA_' || j || ']' AS tag_b FROM two WHERE same OR CASE WHEN m[1] THEN m[4] WHEN m[2] THEN m[3] ELSE false END)"""


def _person_tags(spark, sf):
    persons = register(spark, sf, "persons")["persons"].select("dossier_id", F.lit("PERSONA").alias("category"), F.col("person").alias("value")).distinct()
    return masking.assign_tags(persons)


@query("normalise_name", f"SELECT p_partkey, {_NORM.replace('value', 'person')} AS name FROM persons")
def _(spark, sf):
    return register(spark, sf, "persons")["persons"].select("p_partkey", fn.normalised_name(F.col("person")).alias("name"))


@query("suggest_merges", MERGE + " SELECT dossier_id, tag_a || '+' || tag_b AS merge_id, tag_a, tag_b FROM suggested")
def _(spark, sf):
    return merging.suggest_merges(_person_tags(spark, sf)).select("dossier_id", "merge_id", "tag_a", "tag_b")


@query("extend_queue", MERGE + " SELECT dossier_id, tag_a || '+' || tag_b AS merge_id FROM suggested")
def _(spark, sf):
    found = merging.suggest_merges(_person_tags(spark, sf), ascii_only=True)
    old = found.filter(F.crc32("merge_id") % 3 == 0)
    return merging.extend_queue(old, found).select("dossier_id", "merge_id")


SINGLE = """, once AS (SELECT dossier_id, min(tag_b) AS tag_b, tag_a FROM suggested GROUP BY dossier_id, tag_a),
free AS (SELECT dossier_id, tag_a, tag_b FROM once o WHERE NOT EXISTS (SELECT 1 FROM once p WHERE p.dossier_id = o.dossier_id AND (p.tag_b = o.tag_a OR (p.tag_b = o.tag_b AND p.tag_a <> o.tag_a))))"""


def _single(spark, sf):
    tags = _person_tags(spark, sf)
    found = merging.suggest_merges(tags, ascii_only=True).groupBy("dossier_id", "tag_a").agg(F.min("tag_b").alias("tag_b"))
    as_b = found.select("dossier_id", F.col("tag_b").alias("tag_a")).distinct()
    twice = found.groupBy("dossier_id", "tag_b").count().filter("count > 1").drop("count")
    return tags, found.join(as_b, ["dossier_id", "tag_a"], "left_anti").join(twice, ["dossier_id", "tag_b"], "left_anti")


@query("apply_merges", MERGE + SINGLE + """ SELECT n.dossier_id, '[PERSONA_' || n.idx || ']' AS tag, n.value, CASE WHEN g.value IS NULL THEN [] ELSE [g.value] END AS variants FROM names n LEFT JOIN free f ON n.dossier_id = f.dossier_id AND f.tag_a = '[PERSONA_' || n.idx || ']'
LEFT JOIN names g ON g.dossier_id = f.dossier_id AND f.tag_b = '[PERSONA_' || g.idx || ']' WHERE NOT EXISTS (SELECT 1 FROM free x WHERE x.dossier_id = n.dossier_id AND x.tag_b = '[PERSONA_' || n.idx || ']')""")
def _(spark, sf):
    return merging.apply_merges(*_single(spark, sf)).select("dossier_id", "tag", "value", "variants")


@query("apply_merges_in_order")
def _(spark, sf):
    tags = _person_tags(spark, sf)
    steps = merging.suggest_merges(tags, ascii_only=True).select("dossier_id", fn.placeholder_index(F.col("tag_a")).alias("seq"), "tag_a", "tag_b")
    return merging.apply_merges_in_order(tags, steps.withColumn("seq", F.col("seq") * 100_000 + fn.placeholder_index(F.col("tag_b")))).select("dossier_id", "tag", "value", "variants")


@query("decide_merges", MERGE + """ SELECT dossier_id, tag_a || '+' || tag_b AS merge_id, CASE WHEN crc % 2 = 0 THEN 'merge' ELSE 'separate' END AS decision, CASE WHEN crc % 5 = 0 THEN 'ALREADY_RESOLVED' WHEN crc % 2 = 0 THEN 'MERGED' ELSE 'SEPARATED' END AS verdict
FROM (SELECT *, length(tag_a) * 7 + CAST(split_part(split_part(tag_b, '_', 2), ']', 1) AS BIGINT) AS crc FROM suggested)""")
def _(spark, sf):
    tags = _person_tags(spark, sf)
    n = F.length("tag_a") * 7 + fn.placeholder_index(F.col("tag_b"))
    queue = merging.suggest_merges(tags, ascii_only=True).withColumn("resolved", n % 5 == 0)
    decisions = queue.select("dossier_id", F.lit(1).alias("seq"), "merge_id", F.when(n % 2 == 0, "merge").otherwise("separate").alias("decision"))
    return merging.decide_merges(queue, tags, decisions).select("dossier_id", "merge_id", "decision", "verdict")


@query("merge_queue_view", MERGE + " SELECT s.dossier_id, tag_a, tag_b, a.value AS value_a, b.value AS value_b FROM suggested s JOIN names a ON a.dossier_id = s.dossier_id AND tag_a = '[PERSONA_' || a.idx || ']' JOIN names b ON b.dossier_id = s.dossier_id AND tag_b = '[PERSONA_' || b.idx || ']'")
def _(spark, sf):
    tags = _person_tags(spark, sf)
    return merging.merge_queue_view(merging.suggest_merges(tags, ascii_only=True), tags).select("dossier_id", "tag_a", "tag_b", "value_a", "value_b")


@query("homonyms", f"s AS (SELECT dossier_id, doc_id, doc_id AS span_id, person AS value FROM letter_parts), n AS (SELECT *, {_NORM} AS name FROM s) SELECT dossier_id, name, count(DISTINCT doc_id) AS documents, list(span_id ORDER BY span_id) AS span_ids FROM n WHERE name <> '' GROUP BY dossier_id, name HAVING count(DISTINCT doc_id) >= 2")
def _(spark, sf):
    spans = register(spark, sf, "letter_parts")["letter_parts"].select("dossier_id", "doc_id", F.col("doc_id").alias("span_id"), F.lit("PERSONA").alias("category"), F.col("person").alias("value"))
    return merging.homonyms(spans).select("dossier_id", "name", "documents", "span_ids")


@query("entity_groups", f"f AS (SELECT DISTINCT dossier_id, person AS value FROM persons), n AS (SELECT *, {_NORM} AS name FROM f) SELECT dossier_id, name, list(value ORDER BY value) AS spellings FROM n GROUP BY dossier_id, name")
def _(spark, sf):
    return merging.entity_groups(_person_tags(spark, sf)).select("dossier_id", "name", "spellings")


# --- ingest --------------------------------------------------------------------------------------------------------------
SCAN = "v AS (SELECT *, CASE WHEN length(trim(text)) = 0 THEN image_area / page_area > 0 ELSE length(trim(text)) < 40 AND image_area / page_area > 0.5 END AS scan FROM page_stats)"


@query("page_verdicts", SCAN + " SELECT dossier_id, doc_id, page_no, scan FROM v")
def _(spark, sf):
    return ingest.page_verdicts(register(spark, sf, "page_stats")["page_stats"]).select("dossier_id", "doc_id", "page_no", "scan")


@query("rejected_scans", SCAN + " SELECT dossier_id, doc_id, min(page_no) FILTER (scan) AS page FROM v GROUP BY ALL HAVING count(*) FILTER (scan) > 0")
def _(spark, sf):
    return ingest.rejected_scans(register(spark, sf, "page_stats")["page_stats"])


@query("assemble_pages", SCAN + ", o AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY dossier_id, doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS begins, bool_or(scan) OVER (PARTITION BY dossier_id, doc_id) AS any_scan FROM v) SELECT dossier_id, doc_id, string_agg(text, '' ORDER BY page_no) AS text, list(begins ORDER BY page_no) AS page_offsets FROM o WHERE NOT any_scan GROUP BY ALL")
def _(spark, sf):
    return ingest.assemble_pages(register(spark, sf, "page_stats")["page_stats"])


@query("admit_documents", """o AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, filename ORDER BY arrival) = 1 AS first FROM letters),
p AS (SELECT *, coalesce(sum(first::INT) OVER (PARTITION BY dossier_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM o) SELECT dossier_id, doc_id, CASE WHEN prior >= 5 THEN 'DossierFull' WHEN NOT first THEN 'DuplicateFilename' ELSE 'OK' END AS verdict FROM p""")
def _(spark, sf):
    return ingest.admit_documents(register(spark, sf, "letters")["letters"], cap=5).select("dossier_id", "doc_id", "verdict")


@query("reject_empty", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' || chr(10) ELSE text END AS text FROM documents) WHERE NOT regexp_full_match(text, '\\s*')", plain=True)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text", F.when(F.col("doc_id") % 7 == 0, "  \n").otherwise(F.col("text")))
    return ingest.reject_empty(docs).select("doc_id")


@query("fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents", plain=True)
def _(spark, sf):
    return ingest.fingerprint(spark.read.parquet(f"{sf}/documents.parquet").withColumn("content", F.col("text").cast("binary"))).select("doc_id", "sha256")


@query("reject_oversize", "SELECT doc_id FROM documents WHERE n_chars <= 2000", plain=True)
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("n_chars").alias("length"))
    return ingest.reject_oversize(docs, 2000).select("doc_id")


@query("filenames", "f AS (SELECT doc_id, CASE WHEN arrival % 3 = 0 THEN 'a/b/' || filename WHEN arrival % 3 = 1 THEN 'c:' || chr(92) || 'x' || chr(92) || filename ELSE filename END AS n, filename FROM letters) SELECT doc_id, filename AS clean, replace(filename, '.txt', '-mascherato.txt') AS masked_name, replace(filename, '.txt', '-ripristinato.txt') AS restored_name FROM f")
def _(spark, sf):
    docs = register(spark, sf, "letters")["letters"]
    name = F.when(F.col("arrival") % 3 == 0, F.concat(F.lit("a/b/"), "filename")).when(F.col("arrival") % 3 == 1, F.concat(F.lit("c:\\x\\"), "filename")).otherwise(F.col("filename"))
    clean = fn.clean_filename(name)
    return docs.select("doc_id", clean.alias("clean"), fn.masked_filename(clean).alias("masked_name"), fn.restored_filename(fn.masked_filename(clean)).alias("restored_name"))


VALID = """r AS (SELECT *, CASE WHEN json_valid(raw) THEN json(raw) END AS j FROM responses), e AS (SELECT dossier_id, doc_id, arrival, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [] END) AS x FROM r),
good AS (SELECT r.dossier_id, r.doc_id, json_valid(raw) AND json_type(j) = 'ARRAY' AND coalesce(ok, true) AS valid FROM r LEFT JOIN (SELECT doc_id, bool_and(json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.valore') = 'VARCHAR', false) AND coalesce(json_type(x, '$.categoria') = 'VARCHAR', false) AND (x ->> '$.categoria') IN ('PERSONA', 'DATA')) AS ok FROM e GROUP BY doc_id) b ON r.doc_id = b.doc_id)"""


@query("response_verdicts", VALID + " SELECT dossier_id, doc_id, coalesce(valid, false) AS valid FROM good")
def _(spark, sf):
    return responses.response_verdicts(register(spark, sf, "responses")["responses"]).select("dossier_id", "doc_id", "valid")


@query("parse_responses", """ok AS (SELECT * FROM persons WHERE NOT (p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 23 = 0 OR p_partkey % 29 = 0 OR p_partkey % 31 = 0 OR p_partkey % 37 = 0))
SELECT dossier_id, CAST(p_partkey AS VARCHAR) AS doc_id, CAST(0 AS INT) AS det_seq, person AS value, 'PERSONA' AS category FROM ok UNION ALL SELECT dossier_id, CAST(p_partkey AS VARCHAR), 1, '2024-01-0' || (p_partkey % 9 + 1), 'DATA' FROM ok""")
def _(spark, sf):
    return responses.parse_responses(register(spark, sf, "responses")["responses"]).drop("arrival")


@query("drop_failed_dossiers", """d AS (SELECT *, 'C' || (p_partkey // 8) AS d FROM persons), f AS (SELECT DISTINCT d FROM d WHERE p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR (p_partkey % 23 <> 0 AND (p_partkey % 29 = 0 OR p_partkey % 31 = 0 OR p_partkey % 37 = 0))),
ok AS (SELECT * FROM d WHERE p_partkey % 23 <> 0 AND d NOT IN (SELECT d FROM f))
SELECT d AS dossier_id, CAST(p_partkey AS VARCHAR) AS doc_id, CAST(0 AS INT) AS det_seq, person AS value, 'PERSONA' AS category FROM ok UNION ALL SELECT d, CAST(p_partkey AS VARCHAR), 1, '2024-01-0' || (p_partkey % 9 + 1), 'DATA' FROM ok""")
def _(spark, sf):
    """All responses, eight to a dossier, so that some dossiers are left at every size."""
    raw = register(spark, sf, "responses")["responses"].withColumn("dossier_id", F.concat(F.lit("C"), F.floor(F.col("arrival") / 8).cast("string")))
    return responses.drop_failed_dossiers(responses.parse_responses(raw), responses.response_verdicts(raw)).drop("arrival")


@query("find_vault", """i AS (SELECT sha256('lettera_' || number) AS h, 'V' || number AS vault_id FROM letter_parts WHERE number % 7 < 5 UNION ALL SELECT sha256('lettera_' || number), 'W' || number FROM letter_parts WHERE number % 11 = 0)
SELECT 'lettera_' || number || '.mascherato.txt' AS filename, CASE WHEN count(DISTINCT vault_id) = 1 THEN any_value(vault_id) END AS vault_id, coalesce(list(DISTINCT vault_id ORDER BY vault_id) FILTER (vault_id IS NOT NULL), []) AS candidates FROM letter_parts LEFT JOIN i ON sha256('lettera_' || number) = h GROUP BY number""")
def _(spark, sf):
    """Every letter has a name of its own and is looked up; some names are in no vault, some in two."""
    parts = register(spark, sf, "letter_parts")["letter_parts"]
    name, digit = F.concat(F.lit("lettera_"), F.col("number").cast("string")), F.col("number").cast("string")
    entry = lambda kind, some: parts.filter(some).select(F.sha2(name, 256).alias("name_sha256"), F.concat(F.lit(kind), digit).alias("vault_id"))
    index = entry("V", "number % 7 < 5").unionByName(entry("W", "number % 11 = 0"))
    return ingest.find_vault(parts.select(F.concat(name, F.lit(".mascherato.txt")).alias("filename")), index)


# --- checks and detectors ------------------------------------------------------------------------------------------------
_ODD = "[" + ",".join(map(str, fn.CF_ODD)) + "]"
_NUM = "(ascii(c) - CASE WHEN ascii(c) < 65 THEN 48 ELSE 55 END)"


CODE_CHECKS = f"""d AS (SELECT *, CASE WHEN starts_with(vat, 'IT') THEN vat[3:] ELSE vat END AS digits, iban[5:] || iban[:4] AS moved FROM codes),
checks AS (SELECT k, list_sum(list_transform(range(1, 12), lambda i: CASE WHEN i % 2 = 1 THEN CAST(digits[i] AS INT) WHEN CAST(digits[i] AS INT) > 4 THEN 2 * CAST(digits[i] AS INT) - 9 ELSE 2 * CAST(digits[i] AS INT) END)) % 10 = 0 AS vat_ok,
CAST(string_agg_moved AS HUGEINT) % 97 = 1 AS iban_ok, chr(CAST(65 + cf_sum % 26 AS INT)) = cf[16] AS cf_ok, try_strptime(day, '%d/%m/%Y') IS NOT NULL AS day_ok,
length(regexp_replace(regexp_replace(phone, '^(\\+39|0039)', ''), '[^0-9]', '', 'g')) BETWEEN 9 AND 11 AS phone_ok
FROM (SELECT *, array_to_string(list_transform(string_split(moved, ''), lambda c: CAST({_NUM} AS VARCHAR)), '') AS string_agg_moved,
list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN {_ODD}[CAST(CASE WHEN ascii(cf[i]) < 65 THEN ascii(cf[i]) - 47 ELSE ascii(cf[i]) - 54 END AS INT)] WHEN ascii(cf[i]) < 65 THEN ascii(cf[i]) - 48 ELSE ascii(cf[i]) - 65 END)) AS cf_sum FROM d))"""


@query("code_checks", CODE_CHECKS + " SELECT * FROM checks")
def _(spark, sf):
    c = register(spark, sf, "codes")["codes"]
    return c.select("k", fn.vat_number_valid(F.col("vat")).alias("vat_ok"), fn.iban_valid(F.col("iban")).alias("iban_ok"), fn.tax_code_valid(F.col("cf")).alias("cf_ok"), fn.date_exists(F.col("day")).alias("day_ok"), fn.phone_plausible(F.col("phone")).alias("phone_ok"))


#: A text for every client with a value of each category that has no other query with SQL; some numbers are announced, some not.
@query("rule_spans_planted", CODE_CHECKS + """, n AS (SELECT c.k, vat, iban, cf, vat_ok, iban_ok, cf_ok, lpad(CAST(c.k % 10000000 AS VARCHAR), 7, '1') AS line FROM codes c JOIN checks USING (k))
SELECT k, 'CF' AS category, cf AS value FROM n WHERE cf_ok UNION ALL SELECT k, 'PIVA', vat FROM n WHERE vat_ok AND (k % 3 = 0 OR starts_with(vat, 'IT'))
UNION ALL SELECT k, 'IBAN', iban FROM n WHERE iban_ok UNION ALL SELECT k, 'TELEFONO', '06 ' || line FROM n WHERE k % 2 = 0
UNION ALL SELECT k, 'INDIRIZZO', 'piazzale Roma ' || (k % 300 + 1) FROM n UNION ALL SELECT k, 'CATASTO', 'foglio ' || (k % 90 + 1) || ' particella ' || (k % 500 + 1) FROM n
UNION ALL SELECT k, 'AZIENDA', 'Verdi & Neri S.r.l.' FROM n WHERE k % 5 = 0""")
def _(spark, sf):
    c, k = register(spark, sf, "codes")["codes"], F.col("k")
    text = F.concat(
        F.lit("Dati: "), "cf", F.lit("; "), F.when(k % 3 == 0, "P.IVA ").otherwise("numero "), "vat", F.lit("; conto "), "iban", F.lit("; presso la sede; "), F.when(k % 2 == 0, "tel. ").otherwise("cod. "),
        F.lit("06 "), F.lpad((k % 10_000_000).cast("string"), 7, "1"), F.lit("; abita in piazzale Roma "), (k % 300 + 1).cast("string"), F.lit("; foglio "), (k % 90 + 1).cast("string"),
        F.lit(" particella "), (k % 500 + 1).cast("string"), F.when(k % 5 == 0, "; per Verdi & Neri S.r.l.; fine").otherwise("; fine"),
    )
    docs = c.select(F.lit("d").alias("dossier_id"), F.col("k").cast("string").alias("doc_id"), k.alias("arrival"), text.alias("text"))
    found = detect.rule_spans(docs, ("CF", "PIVA", "IBAN", "TELEFONO", "INDIRIZZO", "CATASTO", "AZIENDA"))
    return found.select(F.col("doc_id").cast("long").alias("k"), "category", "value")


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("dossier_id"), "doc_id", F.col("doc_id").alias("arrival"), "text")


@query("email_spans", """h AS (SELECT doc_id, regexp_extract_all(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b') AS p, regexp_split_to_array(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}\\b') AS t FROM documents),
u AS (SELECT doc_id, unnest(p) AS value, unnest(t[:-2]) AS gap, generate_subscripts(p, 1) AS i FROM h) SELECT doc_id, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS stop, value FROM u""".replace("h AS", "WITH h AS", 1), plain=True)
def _(spark, sf):
    return detect.rule_spans(_documents(spark, sf), ("EMAIL",)).select("doc_id", F.col("end").alias("stop"), "value")


@query("letter_spans", """s AS (SELECT doc_id, 'EMAIL' AS category, 'u' || custkey || '@example.com' AS value FROM letter_parts UNION ALL SELECT doc_id, 'DATA', day FROM letter_parts UNION ALL SELECT doc_id, 'IMPORTO', 'EUR ' || amount FROM letter_parts UNION ALL SELECT doc_id, 'PRATICA', 'Pratica n. P/' || number FROM letter_parts)
SELECT s.doc_id, category, CAST(instr(text, value) - 1 AS INT) AS start, CAST(instr(text, value) - 1 + length(value) AS INT) AS stop, value FROM s JOIN letters l ON s.doc_id = l.doc_id""")
def _(spark, sf):
    docs = register(spark, sf, "letters")["letters"]
    return detect.resolve_spans(detect.rule_spans(docs, ("EMAIL", "DATA", "IMPORTO", "PRATICA"))).select("doc_id", "category", "start", F.col("end").alias("stop"), "value")


@query("all_rule_spans")
def _(spark, sf):
    docs = register(spark, sf, "letters")["letters"]
    return detect.rule_spans(docs.unionByName(_documents(spark, sf).select("dossier_id", F.col("doc_id").cast("string").alias("doc_id"), "arrival", F.lit("d.txt").alias("filename"), "text")))


@query("span_overlaps", "s AS (SELECT dossier_id, doc_id, span_id, pos AS a, pos + len AS b FROM made) SELECT x.doc_id, x.span_id AS span_a, y.span_id AS span_b FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.span_id < y.span_id AND x.a < y.b AND y.a < x.b".replace("s AS", "made AS (SELECT 'x' AS dossier_id, l_orderkey AS doc_id, l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber AS span_id, CAST(l_quantity AS INT) AS pos, CAST(l_discount * 100 AS INT) + 1 AS len FROM lineitem), s AS", 1))
def _(spark, sf):
    return detect.span_overlaps(_made_spans(spark, sf)).select("doc_id", "span_a", "span_b")


def _made_spans(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    span_id = F.concat_ws(":", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    start = F.col("l_quantity").cast("int")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("l_partkey") % 12 + 1).cast("int"))
    return line.select(F.lit("x").alias("dossier_id"), F.col("l_orderkey").alias("doc_id"), span_id.alias("span_id"), start.alias("start"), (start + (F.col("l_discount") * 100).cast("int") + 1).alias("end"), category.alias("category"), F.lit("v").alias("value"))


@query("resolve_spans", f"""m AS (SELECT l_orderkey AS doc_id, l_orderkey || ':' || l_partkey || ':' || l_suppkey || ':' || l_linenumber AS span_id, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + CAST(trunc(l_discount * 100) AS INT) + 1 AS b, {list(CATEGORIES)}[l_partkey % 12 + 1] AS category FROM lineitem),
p AS (SELECT *, CASE WHEN category IN ('CF', 'IBAN', 'PIVA') THEN 1 WHEN category IN ('EMAIL', 'TELEFONO', 'CATASTO', 'PRATICA') THEN 2 WHEN category IN ('DATA', 'IMPORTO') THEN 3 ELSE 4 END AS prio FROM m),
l AS (SELECT doc_id, list([{{'s': span_id, 'a': a, 'b': b, 'c': category}}] ORDER BY prio, a - b, a, span_id) AS e FROM p GROUP BY doc_id),
r AS (SELECT doc_id, unnest(list_reduce(e, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].a < y.b AND y.a < x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS w FROM l)
SELECT doc_id, w.s AS span_id, w.a AS start, w.b AS "end", w.c AS category FROM r""")
def _(spark, sf):
    return detect.resolve_spans(_made_spans(spark, sf)).select("doc_id", "span_id", "start", "end", "category")


@query("lookup_detector", "v AS (SELECT DISTINCT dossier_id, value FROM detections WHERE category = 'EMAIL') SELECT l.doc_id, v.value FROM letters l JOIN v ON l.dossier_id = v.dossier_id AND contains(l.text, v.value)")
def _(spark, sf):
    d = register(spark, sf, "letters", "detections")
    return detect.lookup_detector(d["detections"].filter("category = 'EMAIL'").select("dossier_id", "value", "category"))(d["letters"]).select("doc_id", "value")


@query("union_detections", "SELECT doc_id, 'EMAIL' AS category, 'u' || custkey || '@example.com' AS value FROM letter_parts UNION ALL SELECT doc_id, 'DATA', day FROM letter_parts")
def _(spark, sf):
    docs = register(spark, sf, "letters")["letters"]
    return detect.union_detections(docs, detect.rule_detector(("EMAIL",)), detect.rule_detector(("DATA",))).select("doc_id", "category", "value")


@query("manual_spans", "m AS (SELECT doc_id, CAST(arrival % 250 - 3 AS INT) AS a, CAST(arrival % 250 - 3 + arrival % 9 AS INT) AS b, text FROM letters) SELECT m.doc_id, CASE WHEN NOT (a >= 0 AND a < b AND b <= length(m.text)) THEN 'RANGE' WHEN a < instr(m.text, p.day) - 1 + 10 AND instr(m.text, p.day) - 1 < b THEN 'OVERLAP' ELSE 'OK' END AS verdict FROM m JOIN letter_parts p ON m.doc_id = p.doc_id")
def _(spark, sf):
    docs = register(spark, sf, "letters")["letters"]
    start = (F.col("arrival") % 250 - 3).cast("int")
    manual = docs.select("dossier_id", "doc_id", F.col("doc_id").alias("span_id"), start.alias("start"), (start + F.col("arrival") % 9).cast("int").alias("end"))
    return detect.validate_manual_spans(manual, docs, detect.rule_spans(docs, ("DATA",))).select("doc_id", "verdict")


# --- state ---------------------------------------------------------------------------------------------------------------
def _step(state: str, hash_: str, rejected: str) -> str:
    return f"{{'event': '', 'digest': '', 'state': {state}, 'hash': CAST({hash_} AS VARCHAR), 'rej': {rejected}}}"


@query("replay_state", f"""l AS (SELECT dossier_id, list({{'event': event, 'digest': digest, 'state': 'DRAFT', 'hash': CAST(NULL AS VARCHAR), 'rej': 0}} ORDER BY seq) AS e FROM state_events GROUP BY dossier_id),
r AS (SELECT dossier_id, list_reduce(list_concat([{_step("'DRAFT'", "NULL", "0")}], e), lambda a, x: CASE WHEN x.event = 'analysed' THEN {_step("'PENDING_REVIEW'", "a.hash", "a.rej")}
WHEN x.event = 'approve' AND a.state = 'PENDING_REVIEW' THEN {_step("'APPROVED'", "x.digest", "a.rej")} WHEN x.event = 'approve' THEN {_step("a.state", "a.hash", "a.rej + 1")}
WHEN x.event = 'mutation' AND a.state = 'APPROVED' THEN {_step("'PENDING_REVIEW'", "NULL", "a.rej")} WHEN x.event = 'clear' THEN {_step("'DRAFT'", "NULL", "0")} ELSE a END) AS s FROM l)
SELECT dossier_id, s.state AS state, s.hash AS approval_hash, CAST(s.rej AS INT) AS rejected FROM r""")
def _(spark, sf):
    return state.replay_state(register(spark, sf, "state_events")["state_events"])


@query("export_gate", TAGS[1:] + """ SELECT dossier_id, CASE WHEN k % 5 = 0 THEN 'NOT_FOUND' WHEN k % 3 = 0 THEN 'NOT_ALLOWED' WHEN k % 7 = 0 THEN 'INTEGRITY' ELSE 'OK' END AS verdict FROM (SELECT DISTINCT dossier_id, custkey AS k FROM letter_parts)""")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    digests = review.approval_digest(masking.mask_documents(docs, tags))
    k = F.substring("dossier_id", 2, 20).cast("long")
    pending = digests.filter(k % 5 != 0).select("dossier_id", F.when(k % 3 == 0, "DRAFT").otherwise("PENDING_REVIEW").alias("state"), F.lit(None).cast("string").alias("approval_hash"))
    approved = state.approve(pending, digests)
    now = digests.withColumn("digest", F.when(k % 7 == 0, F.lit("changed")).otherwise(F.col("digest")))
    return state.export_gate(digests, approved, now)


@query("export_masked", TAGS[1:] + HITS + " SELECT dossier_id, replace(filename, '.txt', '-mascherato.txt') AS filename, masked FROM masks WHERE CAST(dossier_id[2:] AS BIGINT) % 2 = 0")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    gate = docs.select("dossier_id").distinct().withColumn("verdict", F.when(F.substring("dossier_id", 2, 20).cast("long") % 2 == 0, "OK").otherwise("NOT_ALLOWED"))
    return ingest.export_masked(masking.mask_documents(docs, tags), gate)


@query("mutations", "SELECT dossier_id, arrival AS seq, 'mutation' AS event FROM letters WHERE arrival % 2 = 0 UNION ALL SELECT dossier_id, arrival, 'mutation' FROM letters WHERE arrival % 3 = 0 UNION ALL SELECT dossier_id, arrival, 'mutation' FROM letters WHERE arrival % 5 = 0")
def _(spark, sf):
    moves = register(spark, sf, "letters")["letters"].withColumnRenamed("arrival", "seq")
    return state.mutations(moves.filter("seq % 2 = 0"), moves.filter("seq % 3 = 0"), moves.filter("seq % 5 = 0")).select("dossier_id", "seq", "event")


# --- files, vault, streams -----------------------------------------------------------------------------------------------
def _round_trip(spark: SparkSession, sf: str, rounds: int) -> DataFrame:
    """Every dossier sealed, written, read and opened."""
    d = register(spark, sf, "letters", "detections", "switches")
    docs, found, switches = d["letters"], d["detections"], d["switches"]
    tags = masking.assign_tags(masking.new_values(found))
    dossiers = docs.select("dossier_id").distinct().withColumn("state", F.lit("PENDING_REVIEW")).withColumn("approval_hash", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "dossier_id string, merge_id string, category string, tag_a string, tag_b string, resolved boolean")
    counters = masking.advance_counters(spark.createDataFrame([], "dossier_id string, category string, last_idx long"), tags)
    texts = docs.withColumn("page_offsets", F.array(F.lit(0))).withColumn("sha256", F.sha2("text", 256))
    jsons = vault.dossier_json(dossiers, texts, tags, none, docs.select("dossier_id", "doc_id"), switches, counters)
    path = scratch(spark)
    vault.write_vault(jsons, "prova", rounds=rounds).write.parquet(path)
    return vault.read_vault(spark.read.parquet(path), "prova")


@query("vault_round_trip", TAGS[1:] + " SELECT dossier_id, CAST(NULL AS VARCHAR) AS error, count(*) AS tags FROM tags GROUP BY dossier_id")
def _(spark, sf):
    return _round_trip(spark, sf, 100).select("dossier_id", "error", F.size("data.tags").cast("long").alias("tags"))


@query("vault_round_trip_whole", TAGS[1:] + """, texts AS (SELECT dossier_id, string_agg(doc_id || chr(31) || filename || chr(31) || text || chr(31) || sha256(text), chr(30) ORDER BY doc_id) AS t FROM letters GROUP BY dossier_id),
named AS (SELECT dossier_id, string_agg(tag || chr(31) || category || chr(31) || value, chr(30) ORDER BY pos) AS n FROM tags GROUP BY dossier_id)
SELECT t.dossier_id, CAST(NULL AS VARCHAR) AS error, sha256(t) AS texts, sha256(n) AS tags FROM texts t JOIN named n ON t.dossier_id = n.dossier_id""")
def _(spark, sf):
    """With the rounds that vaults are sealed with, and digests of all texts and tags that come back."""
    joined = lambda rows, *fields: F.sha2(F.array_join(F.transform(rows, lambda x: F.concat_ws("\x1f", *[x[f] for f in fields])), "\x1e"), 256)
    texts, tags = joined("data.documents", "doc_id", "filename", "text", "sha256"), joined("data.tags", "tag", "categoria", "valore")
    return _round_trip(spark, sf, vault.ROUNDS).select("dossier_id", "error", texts.alias("texts"), tags.alias("tags"))


@query("stream_analyse", TAGS[1:] + " SELECT dossier_id, category, value FROM tags")
def _(spark, sf):
    d = register(spark, sf, "letters", "detections", keep=True)
    path = scratch(spark)
    found, incoming = d["detections"], jobs.incoming(spark, d["letters"], path)
    detector = lambda docs: found.join(docs.select("dossier_id", "doc_id"), ["dossier_id", "doc_id"], "left_semi")
    jobs.stream_analyse(incoming, detector, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/state/tags").select("dossier_id", "category", "value")


def _run_stream(spark, rows: DataFrame, transform, mode: str, path: str) -> DataFrame:
    rows.repartition(2).write.parquet(f"{path}/in")
    out = transform(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
    if mode == "append":
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{path}/out")
    # Update mode: a batch writes the rows that it changes, the last batch of each key counts.
    save = lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}")
    out.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    key, rest = out.columns[0], out.columns[1:]
    return spark.read.parquet(f"{path}/out").groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


@query("stream_mask", TAGS[1:] + HITS + " SELECT dossier_id, doc_id, masked FROM masks")
def _(spark, sf):
    docs, tags = _tags(spark, sf)
    return _run_stream(spark, docs, lambda s: jobs.stream_mask(s, tags), "append", scratch(spark)).select("dossier_id", "doc_id", "masked")


@query("stream_restore", TAGS[1:] + HITS + ANSWERS + " SELECT dossier_id, answer_id, verdict FROM verdicts")
def _(spark, sf):
    answers, tags = _answers(spark, sf)
    return _run_stream(spark, answers, lambda s: jobs.stream_restore(s, tags), "append", scratch(spark)).select("dossier_id", "answer_id", "verdict")


@query("stream_usage", "SELECT session_id, CAST(sum(token_in) AS BIGINT) AS token_in, CAST(sum(token_out) AS BIGINT) AS token_out, count(*) AS calls FROM usage GROUP BY session_id")
def _(spark, sf):
    return _run_stream(spark, register(spark, sf, "usage")["usage"], jobs.stream_usage, "update", scratch(spark))
