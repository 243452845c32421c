"""Detections from raw JSON answers of a model: whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmask.model import CATEGORIES


def _entries(raw: DataFrame) -> DataFrame:
    listed = F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")
    return raw.withColumn("_e", listed)


def response_verdicts(raw: DataFrame) -> DataFrame:
    """Responses (dossier_id, doc_id, raw) plus `valid`: a JSON list of objects with text `valore` and a known `categoria`.

    An empty list is valid, other keys are ignored; a repeated key or NaN is invalid JSON here.
    """
    text = lambda e, k: F.try_variant_get(e, f"$.{k}", "string")
    kind = lambda e, k: F.schema_of_variant(F.try_variant_get(e, f"$.{k}", "variant"))
    fits = lambda e: F.schema_of_variant(e).startswith("OBJECT") & (kind(e, "valore") == "STRING") & (kind(e, "categoria") == "STRING") & text(e, "categoria").isin(*CATEGORIES)
    return _entries(raw).withColumn("valid", F.coalesce(F.forall("_e", lambda e: F.coalesce(fits(e), F.lit(False))), F.lit(False))).drop("_e")


def parse_responses(raw: DataFrame) -> DataFrame:
    """Detections of valid responses: dossier_id, doc_id, arrival, det_seq, value, category."""
    good = _entries(response_verdicts(raw).filter("valid"))
    rows = good.select("dossier_id", "doc_id", "arrival", F.posexplode("_e").alias("det_seq", "e"))
    return rows.select("dossier_id", "doc_id", "arrival", "det_seq", F.try_variant_get("e", "$.valore", "string").alias("value"), F.try_variant_get("e", "$.categoria", "string").alias("category"))


def drop_failed_dossiers(detections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Detections of dossiers of which no response failed."""
    return detections.join(verdicts.filter(~F.col("valid")).select("dossier_id").distinct(), "dossier_id", "left_anti")
