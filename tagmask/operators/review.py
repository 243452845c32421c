"""What a reviewer sees: exposure, totals, digests, and audits over whole corpora."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.model import CATEGORIES, STRICT
from tagmask.operators.masking import active_tags, claimed_regions, mask_documents, segment_lists, segments, spellings, with_writings, writings
from tagmask.operators.restore import restore


def existing_placeholders(docs: DataFrame) -> DataFrame:
    """dossier_id, doc_id, seq, position (from 0), placeholder: placeholders that incoming texts already have."""
    parts = F.zip_with(F.split("text", STRICT), F.regexp_extract_all("text", F.lit(f"({STRICT})"), 1), lambda g, p: F.struct(F.length(g).alias("g"), p.alias("p")))
    step = lambda acc, z: F.struct((acc["at"] + z["g"] + F.length(z["p"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + z["g"]).alias("position"), z["p"].alias("placeholder")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<position:int,placeholder:string>>").alias("out"))
    placed = docs.select("dossier_id", "doc_id", parts.alias("_z")).select("dossier_id", "doc_id", F.posexplode_outer(F.aggregate(F.filter("_z", lambda z: z["p"].isNotNull()), zero, step)["out"]).alias("seq", "w")).filter("w is not null")
    return placed.select("dossier_id", "doc_id", "seq", F.col("w.position").alias("position"), F.col("w.placeholder").alias("placeholder"))


def top_warnings(docs: DataFrame, n: int = 5) -> DataFrame:
    """The first n existing placeholders of each document, and how many more there are."""
    found = F.regexp_extract_all("text", F.lit(f"({STRICT})"), 1)
    return docs.withColumn("_p", found).filter(F.size("_p") > 0).select("dossier_id", "doc_id", F.slice("_p", 1, n).alias("shown"), F.greatest(F.size("_p") - n, F.lit(0)).alias("more"))


def _clear_or_masked(tags: DataFrame, switches: DataFrame) -> DataFrame:
    active = active_tags(tags, switches).select("dossier_id", "tag", F.lit(True).alias("_a"))
    return tags.filter("occurrences > 0").join(active, ["dossier_id", "tag"], "left").withColumn("_a", F.coalesce("_a", F.lit(False)))


def exposure(tags: DataFrame, switches: DataFrame) -> DataFrame:
    """Occurrences per dossier that leave in clear and that are masked."""
    n = F.col("occurrences")
    sums = _clear_or_masked(tags, switches).groupBy("dossier_id").agg(F.sum(F.when(~F.col("_a"), n).otherwise(0)).alias("in_clear"), F.sum(F.when(F.col("_a"), n).otherwise(0)).alias("masked"))
    return tags.select("dossier_id").distinct().join(sums, "dossier_id", "left").fillna(0, ["in_clear", "masked"])


def exposure_by_category(tags: DataFrame, switches: DataFrame) -> DataFrame:
    """Occurrences in clear per category, the most exposed first (place from 1)."""
    sums = _clear_or_masked(tags, switches).filter(~F.col("_a")).groupBy("dossier_id", "category").agg(F.sum("occurrences").alias("in_clear"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("dossier_id").orderBy(F.col("in_clear").desc(), "category")))


def dossier_totals(docs: DataFrame) -> DataFrame:
    """Documents, pages, characters and existing placeholders per dossier."""
    return docs.groupBy("dossier_id").agg(F.count("*").alias("documents"), F.sum(F.size("page_offsets")).alias("pages"), F.sum(F.length("text")).alias("characters"), F.sum(F.regexp_count("text", F.lit(STRICT))).alias("warnings"))


def category_summary(tags: DataFrame, switches: DataFrame) -> DataFrame:
    """Categories with at least one tag: tags, whether they are on, and their place in the order of categories."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    counts = tags.groupBy("dossier_id", "category").agg(F.count("*").alias("tags"))
    return counts.join(switches.select("dossier_id", "category", "enabled"), ["dossier_id", "category"], "left").select("dossier_id", "category", "tags", F.coalesce("enabled", F.lit(True)).alias("enabled"), place.cast("int").alias("place"))


def usage_cost(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Tokens and calls per session and overall (session null), with the cost of the sums."""
    sums = usage.groupingSets([["session_id"], []], "session_id").agg(F.sum("token_in").alias("token_in"), F.sum("token_out").alias("token_out"), F.count("*").alias("calls"))
    return sums.withColumn("cost", (F.col("token_in") * price_in + F.col("token_out") * price_out) / 1e6).withColumn("priced", F.lit(price_in > 0 or price_out > 0))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each dossier's blocks, which come in order; the state goes on from batch to batch."""
    current, state, done = None, None, []
    for batch in batches:
        for dossier, block in zip(batch.column("dossier_id").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if state is None or dossier != current:
                if state is not None:
                    done.append((current, state.hexdigest()))
                current, state = dossier, hashlib.sha256()
            state.update((block or "").encode())
        yield pa.RecordBatch.from_pylist([{"dossier_id": d, "digest": h} for d, h in done], schema=_DIGESTS)
        done = []
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"dossier_id": current, "digest": state.hexdigest()}], schema=_DIGESTS)


_DIGESTS = pa.schema([("dossier_id", pa.string()), ("digest", pa.string())])


def approval_digest(masked: DataFrame) -> DataFrame:
    """SHA-256 per dossier over `filename, length, text` of its masked documents, by file name and id.

    Documents come sorted out of a shuffle by dossier and are hashed one after another, so a dossier may be of any size: no
    row holds more than one document. The digest itself can only be taken in order.
    """
    block = F.concat_ws("\n", "filename", F.length("masked").cast("string"), "masked")
    ordered = masked.select("dossier_id", "filename", "doc_id", block.alias("block")).repartition("dossier_id").sortWithinPartitions("dossier_id", "filename", "doc_id", "block")
    return ordered.select("dossier_id", "block").mapInArrow(_digests, "dossier_id string, digest string")


def approval_digest_wide(masked: DataFrame) -> DataFrame:
    """A digest for dossiers too large for one row: SHA-256 over the documents' own digests, in the same order."""
    block = F.sha2(F.concat_ws("\n", "filename", F.length("masked").cast("string"), "masked"), 256)
    ordered = F.array_sort(F.collect_list(F.struct("filename", "doc_id", block.alias("block"))))
    return masked.groupBy("dossier_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["block"]), ""), 256).alias("digest_of_digests"))


def review(docs: DataFrame, tags: DataFrame, switches: DataFrame, dossiers: DataFrame) -> DataFrame:
    """One row per dossier: state, totals, exposure, exposure by category (the most exposed first) and categories."""
    in_order = lambda df, order, value: df.groupBy("dossier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]))
    kinds = in_order(category_summary(tags, switches), F.col("place"), F.col("category")).toDF("dossier_id", "categories")
    exposed = in_order(exposure_by_category(tags, switches), F.col("place"), F.concat_ws(":", "category", F.col("in_clear").cast("string"))).toDF("dossier_id", "exposed")
    whole = dossiers.select("dossier_id", "state")
    for part in (dossier_totals(docs), exposure(tags, switches), exposed, kinds):
        whole = whole.join(part, "dossier_id", "left")
    return whole


def review_documents(docs: DataFrame, tags: DataFrame, switches: DataFrame) -> DataFrame:
    """One row per document: its segments in order (text, tag, category, masked), as a reviewer reads them."""
    named = docs.withColumn("doc_id", F.struct("doc_id", "filename"))
    return segment_lists(named, tags, switches).select("dossier_id", "doc_id.*", "segments")


def leak_audit(masked: DataFrame, tags: DataFrame, switches: DataFrame) -> DataFrame:
    """Values of applied active tags that a masked text still holds; to be empty. Placeholders are not searched. Texts meet
    values as they meet writings (see masking.with_writings)."""
    values = active_tags(tags, switches).filter("status = 'APPLIED'").withColumn("variants", F.array().cast("array<string>"))
    left = masked.select("dossier_id", "doc_id", F.col("masked").alias("text"))
    held = with_writings(left, spellings(values)).withColumn("_o", F.split("text", STRICT))
    kept = F.filter("_ws", lambda v: F.exists("_o", lambda s: F.contains(s, v["writing"])))
    return held.select("dossier_id", "doc_id", F.explode_outer(kept).alias("v")).filter("v is not null").select("dossier_id", "doc_id", "v.tag", F.col("v.writing").alias("value"))


def round_trip_audit(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents that masking and restoring does not give back."""
    masked = mask_documents(docs.withColumn("original", F.col("text")), tags).drop("text").withColumnRenamed("masked", "text").withColumn("answer_id", F.col("doc_id"))
    back = restore(masked, tags.select("dossier_id", "tag", "value", "pos"))
    return back.filter(F.coalesce(F.col("restored") != F.col("original"), F.lit(True)) & (F.col("verdict") != "DOSSIER_NOT_FOUND")).select("dossier_id", "doc_id", "verdict")


def recall_audit(truth: DataFrame, detections: DataFrame) -> DataFrame:
    """Per document (doc_id, value planned): found, planned, missing values, passed (at least half, rounded down)."""
    found = detections.select("doc_id", "value", F.lit(True).alias("_f")).distinct()
    joined = truth.select("doc_id", "value").distinct().join(found, ["doc_id", "value"], "left")
    counts = joined.groupBy("doc_id").agg(F.count("*").alias("planned"), F.count("_f").alias("found"), F.array_sort(F.collect_list(F.when(F.col("_f").isNull(), F.col("value")))).alias("missing"))
    return counts.withColumn("passed", F.col("found") >= F.floor(F.col("planned") / 2))


def segments_audit(docs: DataFrame, tags: DataFrame, switches: DataFrame) -> DataFrame:
    """Documents whose segments do not add up to the text; to be empty."""
    return audit_parts(docs, segments(docs, tags, switches))


def audit_parts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents that their segments (dossier_id, doc_id, seq, text) do not give back."""
    whole = parts.groupBy("dossier_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "").alias("joined"))
    return docs.join(whole, ["dossier_id", "doc_id"], "left").filter(F.coalesce("joined", F.lit("")) != F.col("text")).select("dossier_id", "doc_id")


def not_found_report(tags: DataFrame) -> DataFrame:
    """Detections that no text holds literally."""
    return tags.filter("status = 'NOT_FOUND'").select("dossier_id", "tag", "category", "value")


def regions_of(docs: DataFrame, tags: DataFrame) -> DataFrame:
    return claimed_regions(docs, writings(tags))
