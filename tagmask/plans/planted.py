"""Queries over planted faults: audits must find them, file sources and vaults must give each its verdict."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.functions.numbers import SMALL, TENS, number_in_words
from tagmask.functions.text import MONTHS, has_context
from tagmask.model import MAX_BYTES, PENDING
from tagmask.operators import detect, masking, merging, registry, restore, review
from tagmask.plans.derived import register
from tagmask.plans.queries import FACTS, HITS, OFF, REGIONS, TAGS, _counted, _tags, query
from tagmask.sources import ingest, vault
from tagmask.sources.scratch import kept, scratch
from tagmask.streaming import jobs, keyed


@query("leak_audit_planted", "SELECT dossier_id, doc_id, c_name AS value FROM letter_parts WHERE arrival % 13 = 0")
def _(spark, sf):
    """The client's name left in each thirteenth masked letter."""
    docs, tags, switches = _counted(spark, sf)
    names = spark.table("letter_parts").select("dossier_id", "doc_id", "c_name")
    masked = masking.mask_documents(docs, tags, switches).join(names, ["dossier_id", "doc_id"])
    leaking = masked.withColumn("masked", F.when(F.col("arrival") % 13 == 0, F.concat_ws(" ", "masked", "c_name")).otherwise(F.col("masked")))
    return review.leak_audit(leaking, tags, switches).filter("value like 'Customer%'").select("dossier_id", "doc_id", "value")


@query("round_trip_planted", """SELECT dossier_id, doc_id, CASE WHEN arrival % 19 = 0 THEN 'MALFORMED' ELSE 'OK' END AS verdict
FROM letters WHERE arrival % 17 = 0 OR arrival % 19 = 0""")
def _(spark, sf):
    """Letters that hold a placeholder, or something like one, before they are masked."""
    docs, tags = _tags(spark, sf)
    arrival = F.col("arrival")
    held = F.concat("text", F.when(arrival % 17 == 0, " [PERSONA_1]").otherwise(""), F.when(arrival % 19 == 0, " [Nota]").otherwise(""))
    return review.round_trip_audit(docs.withColumn("text", held), tags)


@query("segments_planted", "SELECT dossier_id, doc_id FROM letters WHERE arrival % 11 = 0")
def _(spark, sf):
    """One segment of each eleventh letter is lost."""
    docs, tags, switches = _counted(spark, sf)
    parts = masking.segments(docs, tags, switches)
    lost = docs.filter("arrival % 11 = 0").select("dossier_id", "doc_id", F.lit(1).alias("seq"))
    return review.audit_parts(docs, parts.join(lost, ["dossier_id", "doc_id", "seq"], "left_anti"))


@query("dossier_totals_planted", """SELECT dossier_id, count(*) AS documents, CAST(sum(arrival % 4) AS BIGINT) AS pages,
CAST(sum(length(text) + 9 * (arrival % 3)) AS BIGINT) AS characters, CAST(sum(arrival % 3) AS BIGINT) AS warnings FROM letters GROUP BY dossier_id""")
def _(spark, sf):
    """Letters of none to three pages, with none to two placeholders of their own."""
    docs = register(spark, sf, "letters")["letters"]
    texts = docs.withColumn("text", F.concat("text", F.repeat(F.lit(" [IBAN_7]"), (F.col("arrival") % 3).cast("int"))))
    return review.dossier_totals(texts.withColumn("page_offsets", F.array_repeat(F.lit(0), (F.col("arrival") % 4).cast("int"))))


@query("counters_kept", TAGS[1:] + """, old AS (SELECT DISTINCT dossier_id, 'PERSONA' AS category, CASE WHEN custkey % 2 = 0 THEN 1000 ELSE 1 END AS last_idx FROM letter_parts
UNION ALL SELECT DISTINCT dossier_id, 'IBAN', custkey FROM letter_parts)
SELECT dossier_id, category, CAST(max(last_idx) AS BIGINT) AS last_idx FROM (SELECT * FROM old UNION ALL SELECT dossier_id, category, idx FROM tags) GROUP BY ALL""")
def _(spark, sf):
    """Counters that were higher before, or of categories without tags now, never fall."""
    parts = register(spark, sf, "letter_parts")["letter_parts"]
    old = parts.select("dossier_id", F.lit("PERSONA").alias("category"), F.when(F.col("custkey") % 2 == 0, 1000).otherwise(1).cast("long").alias("last_idx")).distinct()
    old = old.unionByName(parts.select("dossier_id", F.lit("IBAN").alias("category"), F.col("custkey").cast("long").alias("last_idx")).distinct())
    return masking.advance_counters(old, _tags(spark, sf)[1])


@query("writings_with_variants", TAGS[1:] + """, forms AS (SELECT dossier_id, tag, pos, unnest([value, upper(value), '', value || ' bis']) AS writing, unnest([0, 1, 2, 3]) AS v FROM tags)
SELECT dossier_id, tag, writing, CAST(row_number() OVER (PARTITION BY dossier_id ORDER BY length(writing) DESC, writing, pos, v) AS INT) AS rank FROM forms WHERE writing <> ''""")
def _(spark, sf):
    """Every tag with three variants, of which one is empty and some equal the value."""
    tags = _tags(spark, sf)[1].withColumn("variants", F.array(F.upper("value"), F.lit(""), F.concat("value", F.lit(" bis"))))
    return masking.writings(tags)


@query("assign_tags_hot", """old_first AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY arrival, det_seq, category) AS r FROM detections WHERE value <> '' AND arrival % 2 = 0),
old AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY length(value) DESC, value) AS idx, row_number() OVER (ORDER BY length(value) DESC, value) AS pos FROM old_first WHERE r = 1),
new_first AS (SELECT d.*, row_number() OVER (PARTITION BY d.value ORDER BY arrival, det_seq, d.category) AS r FROM detections d ANTI JOIN old ON d.value = old.value WHERE d.value <> '' AND arrival % 2 = 1),
tops AS (SELECT category, max(idx) AS top FROM old GROUP BY ALL),
fresh AS (SELECT n.category, value, coalesce(top, 0) + row_number() OVER (PARTITION BY n.category ORDER BY length(value) DESC, value) AS idx,
  (SELECT coalesce(max(pos), 0) FROM old) + row_number() OVER (ORDER BY length(value) DESC, value) AS pos FROM new_first n LEFT JOIN tops t ON n.category = t.category WHERE r = 1)
SELECT category, value, CAST(idx AS BIGINT) AS idx, CAST(pos AS BIGINT) AS pos FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)""")
def _(spark, sf):
    """All letters in one dossier, odd arrivals after even ones: numbers and places of the second run go on from the first."""
    found = register(spark, sf, "detections")["detections"].withColumn("dossier_id", F.lit("all"))
    old = kept(masking.assign_tags(masking.new_values(found.filter("arrival % 2 = 0")), wide=True))
    counters = masking.advance_counters(spark.createDataFrame([], "dossier_id string, category string, last_idx long"), old)
    fresh = masking.assign_tags(masking.new_values(found.filter("arrival % 2 = 1"), old), counters, old, wide=True)
    return old.unionByName(fresh).select("category", "value", "idx", "pos")


@query("writings_hot", """firsts AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY arrival, det_seq, category) AS r FROM detections WHERE value <> ''),
forms AS (SELECT unnest([value, upper(value)]) AS writing, unnest([0, 1]) AS v, row_number() OVER (ORDER BY length(value) DESC, value) AS pos FROM firsts WHERE r = 1)
SELECT writing, CAST(row_number() OVER (ORDER BY length(writing) DESC, writing, pos, v) AS INT) AS rank FROM forms""")
def _(spark, sf):
    """All values of one dossier and their capitals, ranked over many tasks."""
    found = register(spark, sf, "detections")["detections"].withColumn("dossier_id", F.lit("all"))
    tags = masking.assign_tags(masking.new_values(found), wide=True).withColumn("variants", F.array(F.upper("value")))
    return masking.writings(tags, wide=True).select("writing", "rank")


@query("analyse_dossiers", TAGS[1:] + FACTS + " SELECT dossier_id, category, value, occurrences, status FROM counted")
def _(spark, sf):
    """Letters in two runs, odd arrivals after even ones: values and counts are those of one run over all."""
    d = register(spark, sf, "letters", "detections")
    docs, found = d["letters"], d["detections"]
    detector = lambda fresh: found.join(fresh.select("dossier_id", "doc_id"), ["dossier_id", "doc_id"], "left_semi")
    dossiers = docs.select("dossier_id").distinct().withColumns({"state": F.lit("DRAFT"), "approval_hash": F.lit(None).cast("string")})
    none = masking.assign_tags(masking.new_values(found.limit(0)))
    counters = masking.advance_counters(none.select("dossier_id", "category", F.col("idx").alias("last_idx")), none)
    seen = docs.limit(0).select("dossier_id", "doc_id")
    first = masking.analyse_dossiers(dossiers, docs.filter("arrival % 2 = 0"), detector, none, counters, seen)
    first = masking.Analysis(*[kept(table) for table in first])
    second = masking.analyse_dossiers(first.dossiers, docs, detector, first.tags, first.counters, first.analysed)
    return second.tags.select("dossier_id", "category", "value", "occurrences", "status")


@query("removal_verdicts", """SELECT dossier_id, doc_id, 'REMOVED' AS verdict FROM letters WHERE arrival % 4 = 0
UNION ALL SELECT DISTINCT dossier_id, 'none', 'UNKNOWN_DOCUMENT' FROM letters""")
def _(spark, sf):
    """Each fourth letter is removed, and one that no dossier has."""
    return _removal(spark, sf).verdicts


@query("removal_states", """SELECT dossier_id, CASE WHEN bool_or(arrival % 4 = 0) THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS state,
CASE WHEN NOT bool_or(arrival % 4 = 0) THEN 'h' END AS approval_hash FROM letters GROUP BY dossier_id""")
def _(spark, sf):
    """Approved dossiers that lose a letter lose the approval."""
    return _removal(spark, sf).dossiers


@query("removal_counts", TAGS[1:] + FACTS + """, touched AS (SELECT DISTINCT dossier_id FROM letters WHERE arrival % 4 = 0),
left_of AS (SELECT p.dossier_id, tag, CAST(sum(n) AS BIGINT) AS n FROM placed p JOIN tags t ON p.dossier_id = t.dossier_id AND p.value = t.value WHERE arrival % 4 <> 0 GROUP BY ALL)
SELECT c.dossier_id, c.tag, CASE WHEN t.dossier_id IS NULL THEN c.occurrences ELSE n END AS occurrences
FROM counted c LEFT JOIN touched t ON c.dossier_id = t.dossier_id LEFT JOIN left_of l ON c.dossier_id = l.dossier_id AND c.tag = l.tag WHERE t.dossier_id IS NULL OR n IS NOT NULL""")
def _(spark, sf):
    """Tags are counted again only where a letter went; those without occurrences go there."""
    return _removal(spark, sf).tags.select("dossier_id", "tag", "occurrences")


def _removal(spark, sf) -> masking.Removal:
    d = register(spark, sf, "letters", "detections")
    docs = d["letters"]
    tags = kept(masking.analyse(docs, d["detections"]))
    dossiers = docs.select("dossier_id").distinct().withColumns({"state": F.lit("APPROVED"), "approval_hash": F.lit("h")})
    gone = docs.filter("arrival % 4 = 0").select("dossier_id", "doc_id").unionByName(docs.select("dossier_id", F.lit("none").alias("doc_id")).distinct())
    return masking.remove_from_dossiers(dossiers, docs, tags, docs.select("dossier_id", "doc_id"), gone)


PEOPLE = """, people AS (SELECT dossier_id, bool_or(idx = 2) AS has2 FROM tags WHERE category = 'PERSONA' GROUP BY dossier_id)"""


@query("settle_merges", TAGS[1:] + PEOPLE + """
SELECT dossier_id, seq, CASE seq WHEN 1 THEN CASE WHEN has2 THEN 'MERGED' ELSE 'FAILED' END WHEN 2 THEN 'FAILED' WHEN 4 THEN 'ALREADY_RESOLVED' WHEN 5 THEN 'UNKNOWN' ELSE 'SEPARATED' END AS verdict
FROM people, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS seq)""")
def _(spark, sf):
    return _settled(spark, sf).verdicts.select("dossier_id", "seq", "verdict")


@query("settle_queue", TAGS[1:] + PEOPLE + """
SELECT dossier_id, merge_id, has2 OR merge_id <> '[PERSONA_1]+[PERSONA_2]' AS resolved FROM people, (SELECT unnest(['[PERSONA_1]+[PERSONA_2]', '[PERSONA_2]+[PERSONA_3]', '[PERSONA_1]+[PERSONA_3]']) AS merge_id)""")
def _(spark, sf):
    return _settled(spark, sf).queue.select("dossier_id", "merge_id", "resolved")


@query("settle_dossiers", TAGS[1:] + PEOPLE + """
SELECT dossier_id, CASE WHEN has2 THEN 'PENDING_REVIEW' ELSE 'APPROVED' END AS state, CASE WHEN NOT has2 THEN 'h' END AS approval_hash FROM people""")
def _(spark, sf):
    return _settled(spark, sf).dossiers


@query("settle_tags", TAGS[1:] + FACTS + PEOPLE + """, gone AS (SELECT * FROM counted WHERE category = 'PERSONA' AND idx = 2)
SELECT c.dossier_id, c.tag, c.value, CASE WHEN g.value IS NULL THEN [] ELSE [g.value] END AS variants, CASE WHEN has2 THEN c.occurrences + coalesce(g.occurrences, 0) ELSE 0 END AS occurrences
FROM counted c JOIN people p ON p.dossier_id = c.dossier_id LEFT JOIN gone g ON g.dossier_id = c.dossier_id AND c.category = 'PERSONA' AND c.idx = 1 WHERE NOT (c.category = 'PERSONA' AND c.idx = 2)""")
def _(spark, sf):
    """Only dossiers with an accepted merge are counted; the others' tags come back as they were."""
    return _settled(spark, sf).tags.select("dossier_id", "tag", "value", "variants", "occurrences")


def _settled(spark, sf) -> merging.Settlement:
    """Per dossier: 2 into 1; then 2 and 3, which fails as 2 is gone; 1 and 3 kept apart, again, and an unknown pair; at last the
    failed one, which is open still, kept apart."""
    docs, tags = _tags(spark, sf)
    tags = kept(tags)
    dossiers = docs.select("dossier_id").distinct().withColumns({"state": F.lit("APPROVED"), "approval_hash": F.lit("h")})
    pair = lambda a, b: F.struct(F.lit(f"[PERSONA_{a}]+[PERSONA_{b}]").alias("merge_id"), F.lit(f"[PERSONA_{a}]").alias("tag_a"), F.lit(f"[PERSONA_{b}]").alias("tag_b"))
    people = tags.filter("category = 'PERSONA'").select("dossier_id").distinct()
    queue = people.select("dossier_id", F.explode(F.array(pair(1, 2), pair(2, 3), pair(1, 3))).alias("p")).select("dossier_id", "p.*").withColumns({"category": F.lit("PERSONA"), "resolved": F.lit(False)})
    step = lambda seq, a, b, what: F.struct(F.lit(seq).alias("seq"), F.lit(f"[PERSONA_{a}]+[PERSONA_{b}]").alias("merge_id"), F.lit(what).alias("decision"))
    steps = [step(1, 1, 2, "merge"), step(2, 2, 3, "merge"), step(3, 1, 3, "separate"), step(4, 1, 3, "merge"), step(5, 8, 9, "merge"), step(6, 2, 3, "separate")]
    decisions = people.select("dossier_id", F.explode(F.array(*steps)).alias("s")).select("dossier_id", "s.*")
    return merging.settle_merges(queue, tags, decisions, docs, dossiers)


@query("review_documents", TAGS[1:] + HITS + REGIONS + OFF + """,
parts AS (SELECT dossier_id, doc_id, 2 * i - 2 AS o, gap AS text, NULL AS tag FROM pieces UNION ALL SELECT p.dossier_id, p.doc_id, 2 * i - 1, t.value, t.tag FROM pieces p JOIN tags t ON p.dossier_id = t.dossier_id AND p.pos = t.pos
  UNION ALL SELECT dossier_id, doc_id, 1000000, texts[-1], NULL FROM cut)
SELECT p.dossier_id, p.doc_id, string_agg(text || chr(31) || coalesce(p.tag, '') || chr(31) || CASE WHEN active THEN 'm' ELSE 'c' END, chr(30) ORDER BY o) AS segments
FROM parts p LEFT JOIN activity a ON p.dossier_id = a.dossier_id AND p.tag = a.tag WHERE text <> '' GROUP BY p.dossier_id, p.doc_id""")
def _(spark, sf):
    rows = review.review_documents(*_counted(spark, sf))
    said = F.transform("segments", lambda s: F.concat_ws("\x1f", s["text"], F.coalesce(s["tag"], F.lit("")), F.when(s["masked"], "m").otherwise("c")))
    return rows.select("dossier_id", "doc_id", F.array_join(said, "\x1e").alias("segments"))


@query("file_documents", """SELECT 'D' || (c_custkey % 97) AS dossier_id, 'c' || c_custkey || '.txt' AS filename, CASE WHEN c_custkey % 10 <> 0 THEN c_name || ' è ' || c_mktsegment END AS text,
CASE WHEN c_custkey % 10 = 0 THEN 'InvalidEncoding' END AS error, CASE WHEN c_custkey % 10 = 0 THEN CAST(length(c_name) AS VARCHAR) END AS error_detail FROM customer""")
def _(spark, sf):
    """A file for every customer, in a directory for each dossier; each tenth has a byte that is no UTF-8."""
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    bad = F.concat(F.encode("c_name", "UTF-8"), F.unhex(F.lit("FF")), F.encode("c_mktsegment", "UTF-8"))
    good = F.encode(F.concat("c_name", F.lit(" è "), "c_mktsegment"), "UTF-8")
    content = F.when(F.col("c_custkey") % 10 == 0, bad).otherwise(good)
    files = rows.select(F.concat(F.lit("D"), (F.col("c_custkey") % 97).cast("string")).alias("dossier_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("filename"), content.alias("content"))
    path = scratch(spark)
    ingest.write_files(files, path)
    return ingest.decode_text(ingest.reject_oversize(ingest.read_raw_documents(spark, path, cap=MAX_BYTES))).select("dossier_id", "filename", "text", "error", "error_detail")


@query("file_answers", """SELECT 'S' || (s_suppkey % 7) AS dossier_id, 'a' || s_suppkey || '.txt' AS answer_id, CASE WHEN s_suppkey % 5 = 0 THEN ' ' || chr(10) ELSE s_name || chr(10) || s_suppkey END AS text,
CASE WHEN s_suppkey % 5 = 0 THEN 'EMPTY' END AS verdict FROM supplier""")
def _(spark, sf):
    """A returned text for every supplier; each fifth is blank."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    text = F.when(F.col("s_suppkey") % 5 == 0, " \n").otherwise(F.concat_ws("\n", "s_name", key))
    files = rows.select(F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string")).alias("dossier_id"), F.concat(F.lit("a"), key, F.lit(".txt")).alias("filename"), F.encode(text, "UTF-8").alias("content"))
    path = scratch(spark)
    ingest.write_files(files, path)
    return ingest.read_answers(spark, path)


@query("vault_faults", "SELECT DISTINCT dossier_id, CASE custkey % 9 WHEN 0 THEN NULL WHEN 6 THEN 'VAULT_VERSION' ELSE 'VAULT_UNREADABLE' END AS error FROM letter_parts")
def _(spark, sf):
    """Sealed dossiers of which most are spoiled: cut, wrong mark, rounds of nonsense or none, a changed byte, another
    version, a version that is no number, an unknown status word. Few rounds: the faults are the point here."""
    docs, tags = _tags(spark, sf)
    dossiers = docs.select("dossier_id").distinct().withColumns({"state": F.lit(PENDING), "approval_hash": F.lit(None).cast("string")})
    none = spark.createDataFrame([], "dossier_id string, merge_id string, category string, tag_a string, tag_b string, resolved boolean")
    d = register(spark, sf, "switches")
    counters = tags.groupBy("dossier_id", "category").agg(F.max("idx").alias("last_idx"))
    texts = docs.withColumns({"page_offsets": F.array(F.lit(0)), "sha256": F.sha2("text", 256)})
    jsons = vault.dossier_json(dossiers, texts, tags, none, docs.select("dossier_id", "doc_id"), d["switches"], counters)
    kind = F.substring("dossier_id", 2, 20).cast("long") % 9
    version = F.lit('"vault_version":4')
    json = F.when(kind == 6, F.replace("json", version, F.lit('"vault_version":5'))).when(kind == 7, F.replace("json", version, F.lit('"vault_version":true')))
    json = json.when(kind == 8, F.replace("json", F.lit("NON_TROVATO"), F.lit("NOT_FOUND"))).otherwise(F.col("json"))
    sealed = vault.write_vault(jsons.withColumn("json", json), "prova", rounds=100)
    path = scratch(spark)
    rest = lambda at: F.expr(f"substring(blob, {at})")
    spoiled = F.when(kind == 1, F.substring("blob", 1, 30)).when(kind == 2, F.concat(F.encode(F.lit("CCV2"), "UTF-8"), rest(5)))
    spoiled = spoiled.when(kind == 3, F.concat(F.substring("blob", 1, 4), F.unhex(F.lit("FFFFFFFF")), rest(9))).when(kind == 4, F.concat(F.substring("blob", 1, 4), F.unhex(F.lit("00000000")), rest(9)))
    other = F.unhex(F.lpad(F.hex(255 - F.conv(F.hex(F.substring("blob", 41, 1)), 16, 10).cast("int")), 2, "0"))
    spoiled = spoiled.when(kind == 5, F.concat(F.substring("blob", 1, 40), other, rest(42))).otherwise(F.col("blob"))
    sealed.withColumn("blob", spoiled).write.parquet(path)
    return vault.read_vault(spark.read.parquet(path), "prova").select("dossier_id", "error")


@query("vault_tags", TAGS[1:] + FACTS + OFF + " SELECT dossier_id, tag, category, idx, value, occurrences, status, pos FROM offs")
def _(spark, sf):
    """Counted tags, sealed and opened again: the format's words for a status come back as the library's."""
    docs, tags, switches = _counted(spark, sf)
    dossiers = docs.select("dossier_id").distinct().withColumns({"state": F.lit(PENDING), "approval_hash": F.lit(None).cast("string")})
    none = spark.createDataFrame([], "dossier_id string, merge_id string, category string, tag_a string, tag_b string, resolved boolean")
    counters = tags.groupBy("dossier_id", "category").agg(F.max("idx").alias("last_idx"))
    texts = docs.withColumns({"page_offsets": F.array(F.lit(0)), "sha256": F.sha2("text", 256)})
    # Letters and tags lie by dossier: each vault is sealed, and opened again, where its dossier is; vaults, which no codec
    # makes smaller, are neither shuffled nor written (vault_round_trip and vault_faults read written ones).
    vaults = vault.write_vault(vault.dossier_json(dossiers, texts, tags, none, docs.select("dossier_id", "doc_id"), switches, counters), "prova", rounds=100, spread=False)
    return vault.opened_tags(vault.read_vault(vaults, "prova", spread=False)).select("dossier_id", "tag", "category", "idx", "value", "occurrences", "status", "pos")


@query("stream_counts", TAGS[1:] + FACTS + " SELECT dossier_id, category, value, occurrences, status FROM counted")
def _(spark, sf):
    """Letters in three micro-batches: after the last, values, counts and status are those of one run over all."""
    d = register(spark, sf, "letters", "detections", keep=True)
    path, found = scratch(spark), d["detections"]
    incoming = jobs.incoming(spark, d["letters"], path)
    detector = lambda docs: found.join(docs.select("dossier_id", "doc_id"), ["dossier_id", "doc_id"], "left_semi")
    jobs.stream_analyse(incoming, detector, f"{path}/state", f"{path}/checkpoint").awaitTermination()
    return jobs.stream_tags(spark, f"{path}/state").select("dossier_id", "category", "value", "occurrences", "status")


def _one_dossier(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All letters in one dossier, with its tags: far more writings than a list takes."""
    d = register(spark, sf, "letters", "detections", keep=True)
    docs, found = (d[n].withColumn("dossier_id", F.lit("all")) for n in ("letters", "detections"))
    return docs, kept(masking.assign_tags(masking.new_values(found.filter("category in ('AZIENDA', 'EMAIL', 'PRATICA')")), wide=True))


@query("stream_keyed_counts", TAGS[1:] + FACTS + " SELECT dossier_id, category, value, occurrences, status FROM counted")
def _(spark, sf):
    """Letters in three micro-batches with state per dossier: after the last, values and counts are those of one run over all."""
    d = register(spark, sf, "letters", "detections", keep=True)
    path = scratch(spark)
    found = d["detections"].groupBy("dossier_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("det_seq", "value", "category"))).alias("found"))
    docs = jobs.incoming(spark, d["letters"].join(found, ["dossier_id", "doc_id"], "left").select(*d["letters"].columns, "found"), path)
    changes = keyed.stream_changes(docs)
    changes.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return keyed.newest(spark.read.parquet(f"{path}/out")).select("dossier_id", "category", "value", "occurrences", "status")


@query("stream_mask_hot", """firsts AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY arrival, det_seq, category) AS r FROM detections WHERE category IN ('AZIENDA', 'EMAIL', 'PRATICA')),
tags AS MATERIALIZED (SELECT category, value, '[' || category || '_' || row_number() OVER (PARTITION BY category ORDER BY length(value) DESC, value) || ']' AS tag FROM firsts WHERE r = 1)
SELECT l.doc_id, replace(replace(replace(text, a.value, a.tag), e.value, e.tag), p.value || ',', p.tag || ',') AS masked FROM letters l JOIN letter_parts q ON l.doc_id = q.doc_id
JOIN tags a ON a.value = c_name JOIN tags e ON e.value = 'u' || custkey || '@example.com' JOIN tags p ON p.value = 'P/' || number""")
def _(spark, sf):
    """A stream into one dossier of all letters: texts meet tags by keys, and the result is that of a batch."""
    docs, tags = _one_dossier(spark, sf)
    path = scratch(spark)
    keyed.stream_mask_batches(jobs.incoming(spark, docs, path), lambda version: tags, lambda: 0, f"{path}/out", f"{path}/checkpoint", wide=True).awaitTermination()
    return spark.read.parquet(f"{path}/out/rows").select("doc_id", "masked")


@query("stream_restore_hot", "SELECT doc_id AS answer_id, 'OK' AS verdict, text AS restored FROM letters")
def _(spark, sf):
    docs, tags = _one_dossier(spark, sf)
    path = scratch(spark)
    masked = masking.mask_documents(docs, tags, wide=True).select("dossier_id", F.col("doc_id").alias("answer_id"), F.col("masked").alias("text"))
    dictionary = masking.restore_dictionary(tags)
    keyed.stream_restore_batches(jobs.incoming(spark, masked, path), lambda version: dictionary, lambda: 0, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/rows").select("answer_id", "verdict", "restored")


@query("mask_hot_dossier", """firsts AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY arrival, det_seq, category) AS r FROM detections WHERE category IN ('AZIENDA', 'EMAIL', 'PRATICA')),
tags AS MATERIALIZED (SELECT category, value, '[' || category || '_' || row_number() OVER (PARTITION BY category ORDER BY length(value) DESC, value) || ']' AS tag FROM firsts WHERE r = 1)
SELECT l.doc_id, replace(replace(replace(text, a.value, a.tag), e.value, e.tag), p.value || ',', p.tag || ',') AS masked FROM letters l JOIN letter_parts q ON l.doc_id = q.doc_id
JOIN tags a ON a.value = c_name JOIN tags e ON e.value = 'u' || custkey || '@example.com' JOIN tags p ON p.value = 'P/' || number""")
def _(spark, sf):
    docs, tags = _one_dossier(spark, sf)
    return masking.mask_documents(docs, tags, wide=True).select("doc_id", "masked")


@query("restore_hot_dossier", "SELECT doc_id AS answer_id, 'OK' AS verdict, text AS restored FROM letters")
def _(spark, sf):
    docs, tags = _one_dossier(spark, sf)
    masked = kept(masking.mask_documents(docs, tags, wide=True).select("dossier_id", F.col("doc_id").alias("answer_id"), F.col("masked").alias("text")))
    return restore.restore(masked, masking.restore_dictionary(tags)).select("answer_id", "verdict", "restored")


#: Words of a number below a thousand in SQL, from lists; `n` is the number.
_SMALL_SQL = str([""] + list(SMALL[1:]))
_BELOW = """CASE WHEN {n} < 100 THEN '' WHEN {n} < 200 THEN '' ELSE {small}[{n} // 100 + 1] END || CASE WHEN {n} < 100 THEN '' WHEN {n} % 100 = 8 OR ({n} % 100) // 10 = 8 THEN 'cent' ELSE 'cento' END
|| CASE WHEN {n} % 100 < 20 THEN {small}[{n} % 100 + 1] WHEN {n} % 10 IN (1, 8) THEN left({tens}[({n} % 100) // 10 - 1], -1) || {small}[{n} % 10 + 1] ELSE {tens}[({n} % 100) // 10 - 1] || {small}[{n} % 10 + 1] END"""


def _words_sql(n: str) -> str:
    below = lambda x: _BELOW.format(n=f"({x})", small=_SMALL_SQL, tens=str(list(TENS)))
    plain = f"(CASE ({n}) // 1000 WHEN 0 THEN '' WHEN 1 THEN 'mille' ELSE {below(f'({n}) // 1000')} || 'mila' END || {below(f'({n}) % 1000')})"
    return f"CASE WHEN ({n}) % 10 = 3 AND ({n}) % 100 <> 13 AND ({n}) > 20 THEN left({plain}, -1) || 'é' ELSE {plain} END"


WORDED = f"""worded AS (SELECT dossier_id, doc_id, arrival, 'EUR ' || amount AS amount, {_words_sql("amount")} || '/00' AS amount_words, day,
{_words_sql("CAST(day[9:10] AS BIGINT)")} || ' ' || {list(MONTHS)}[CAST(day[6:7] AS INT)] || ' ' || {_words_sql("CAST(day[1:4] AS BIGINT)")} AS day_words FROM letter_parts)"""


def _worded(spark, sf) -> DataFrame:
    """Letters that say amount and day in digits and in words."""
    parts = register(spark, sf, "letter_parts")["letter_parts"]
    number = lambda at, size: F.substring("day", at, size).cast("long")
    month = F.element_at(F.array(*map(F.lit, MONTHS)), number(6, 2).cast("int"))
    text = F.concat(F.lit("Pagano EUR "), F.col("amount").cast("string"), F.lit(" ("), number_in_words(F.col("amount")), F.lit("/00) il "), "day", F.lit(", ossia "), number_in_words(number(9, 2)), F.lit(" "), month, F.lit(" "), number_in_words(number(1, 4)), F.lit("."))
    return parts.select("dossier_id", "doc_id", "arrival", text.alias("text"))


@query("word_spans", WORDED + " SELECT doc_id, 'IMPORTO' AS category, amount_words AS value FROM worded UNION ALL SELECT doc_id, 'DATA', day_words FROM worded")
def _(spark, sf):
    """Amounts and dates in words, from the text; the words themselves are stated once more in SQL."""
    return detect.word_spans(_worded(spark, sf)).select("doc_id", "category", "value")


@query("two_forms", WORDED + """, forms AS (SELECT dossier_id, 'IMPORTO' AS category, CAST(CAST(amount[5:] AS BIGINT) * 100 AS VARCHAR) AS key, unnest([amount, amount_words]) AS form FROM worded
UNION ALL SELECT dossier_id, 'DATA', day, unnest([day, day_words]) FROM worded) SELECT dossier_id, category, key, list_sort(list_distinct(list(form))) AS forms FROM forms GROUP BY ALL""")
def _(spark, sf):
    """Both forms of a value meet under one key."""
    docs = _worded(spark, sf)
    spans = detect.rule_spans(docs, ("IMPORTO", "DATA")).unionByName(detect.word_spans(docs))
    return detect.two_forms(detect.resolve_spans(spans))


EMAILS = re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", re.ASCII)


@query("udtf_emails", "SELECT doc_id, CAST(0 AS INT) AS det_seq, 'u' || custkey || '@example.com' AS value, 'EMAIL' AS category FROM letter_parts")
def _(spark, sf):
    """A detector in Python, called from SQL for every letter."""
    registry.register_detector(spark, "find_emails", lambda text: [(m.group(), "EMAIL") for m in EMAILS.finditer(text)])
    return registry.detector(spark, "find_emails")(register(spark, sf, "letters")["letters"]).select("doc_id", "det_seq", "value", "category")


@query("udtf_lookup", "v AS (SELECT DISTINCT dossier_id, value FROM detections WHERE category = 'EMAIL') SELECT l.doc_id, v.value FROM letters l JOIN v ON l.dossier_id = v.dossier_id AND contains(l.text, v.value)")
def _(spark, sf):
    """The lookup detector as a table function: what lookup_detector finds."""
    d = register(spark, sf, "letters", "detections")
    registry.register_detector(spark, "find_listed", registry.contained, listed=True)
    values = d["detections"].filter("category = 'EMAIL'").select("dossier_id", "value", "category")
    return registry.detector(spark, "find_listed", values)(d["letters"]).select("doc_id", "value")


@query("detected_exposure", """d AS (SELECT dossier_id, arrival, doc_id, 'EMAIL' AS category, 'u' || custkey || '@example.com' AS value FROM letter_parts UNION ALL SELECT dossier_id, arrival, doc_id, 'IMPORTO', 'EUR ' || amount FROM letter_parts
UNION ALL SELECT dossier_id, arrival, doc_id, 'DATA', day FROM letter_parts UNION ALL SELECT dossier_id, arrival, doc_id, 'PRATICA', 'Pratica n. P/' || number FROM letter_parts)
SELECT dossier_id, category, count(DISTINCT value) AS tags FROM d GROUP BY ALL""")
def _(spark, sf):
    """The rules themselves as detector, from the text to the tags of each category."""
    docs = register(spark, sf, "letters")["letters"]
    found = detect.rule_detector(("EMAIL", "IMPORTO", "DATA", "PRATICA"))(docs)
    return masking.assign_tags(masking.new_values(found)).groupBy("dossier_id", "category").agg(F.count("*").alias("tags"))


#: Numbers of the customers' codes behind nine leads: keywords near and far, whole words and parts of words, and none.
ANNOUNCED = """SELECT k, category, value, concat(lead, value) AS text, length(lead) AS start FROM (
  SELECT k, category, value, CASE k % 9 WHEN 0 THEN 'Ditta con P. IVA ' WHEN 1 THEN 'partita iva: ' WHEN 2 THEN 'un privat ' WHEN 3 THEN 'tel. ' WHEN 4 THEN 'hotel '
    WHEN 5 THEN 'Cellulare aziendale n. ' WHEN 6 THEN 'VAT e fax, poi una lunga descrizione della ditta ' WHEN 7 THEN '' ELSE 'fax/mobile ' END AS lead
  FROM (SELECT k, 'PIVA' AS category, vat AS value FROM codes UNION ALL SELECT k, 'TELEFONO', phone FROM codes UNION ALL SELECT k, 'PRATICA', iban FROM codes) n) l"""


@query("announced_numbers", f"""announced AS ({ANNOUNCED}),
looked AS (SELECT *, lower(substr(text, CAST(greatest(start - 30, 0) + 1 AS BIGINT), CAST(least(start, 30) AS BIGINT))) AS lead FROM announced)
SELECT k, category, CASE category
  WHEN 'PIVA' THEN regexp_matches(lead, '(^|[^\\w])(p\\. iva|p\\.iva|partita iva|p\\.i\\.|vat)([^\\w]|$)') OR starts_with(value, 'IT')
  WHEN 'TELEFONO' THEN regexp_matches(lead, '(^|[^\\w])(tel|telefono|cell|cellulare|fax|mobile)([^\\w]|$)') OR starts_with(value, '+39') OR regexp_full_match(value, '0039([^0-9]?[0-9]){{9,10}}')
  ELSE true END AS announced FROM looked""")
def _(spark, sf):
    """Whether VAT and telephone numbers are announced; other categories need nothing."""
    register(spark, sf, "codes")
    text = spark.sql(ANNOUNCED)
    return text.select("k", "category", has_context(F.col("text"), F.col("start"), F.col("value"), F.col("category")).alias("announced"))


#: A sentence per customer, with the span that a rule must find there (null: none) between what stands around it.
RULED = """SELECT k, category, value, lead, concat(lead, coalesce(value, other), tail) AS text FROM (
  SELECT k, CASE k % 8 WHEN 0 THEN 'CATASTO' WHEN 1 THEN 'INDIRIZZO' WHEN 2 THEN 'INDIRIZZO' WHEN 4 THEN 'IMPORTO' WHEN 5 THEN 'IMPORTO' ELSE 'TELEFONO' END AS category,
    CASE k % 8 WHEN 0 THEN 'Immobile al ' WHEN 1 THEN 'Abita in ' WHEN 2 THEN 'Sede: ' WHEN 3 THEN 'codice X' WHEN 6 THEN 'tel. ' WHEN 7 THEN 'tel. ' ELSE 'Paga ' END AS lead,
    CASE k % 8 WHEN 0 THEN concat('fg. ', cast(k % 1000 + 1 AS string), ' part. ', cast(k % 9000 + 1 AS string)) WHEN 1 THEN concat('via Roma ', cast(k % 9000 + 1 AS string), ', ', cast(10000 + k % 90000 AS string))
      WHEN 2 THEN concat('piazza della Pace ', cast(10000 + k % 90000 AS string)) WHEN 4 THEN concat(cast(k AS string), ' €')
      WHEN 5 THEN concat('EUR ', cast(k % 100 AS string), ',', cast(100000 + k AS string)) WHEN 6 THEN concat('340', cast(1000000 + k % 1000000 AS string)) END AS value,
    CASE k % 8 WHEN 3 THEN concat(cast(k AS string), ' euro') ELSE concat('340', cast(1000000 + k % 1000000 AS string), '99') END AS other,
    CASE k % 8 WHEN 0 THEN ' del comune' WHEN 1 THEN ' Milano' WHEN 2 THEN ' Torino' WHEN 4 THEN '.' ELSE ' subito' END AS tail FROM codes) r"""


@query("rule_fixes", f"ruled AS ({RULED}) SELECT k, category, value, CAST(length(lead) AS INT) AS start FROM ruled WHERE value IS NOT NULL")
def _(spark, sf):
    """Short keywords of the land register, postal codes left whole, links in names, amounts with a left border, a sign behind
    and any number of decimals, telephone numbers that are not the beginning of a longer one."""
    register(spark, sf, "codes")
    docs = spark.sql(RULED).select(F.lit("all").alias("dossier_id"), F.col("k").alias("doc_id"), "text")
    return detect.rule_spans(docs, ("CATASTO", "INDIRIZZO", "IMPORTO", "TELEFONO")).select(F.col("doc_id").alias("k"), "category", "value", F.col("start").cast("int").alias("start"))
