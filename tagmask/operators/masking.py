"""Assigning placeholders and masking texts.

Longest-first claiming is a fold of literal replacements: the n-th writing is replaced by a sentinel of private-use
characters that no later writing can match, so shorter writings get only what longer ones left. Sentinels become
placeholders at the end, or give the regions. Where a text holds such characters itself, they are escaped before, in
the text and in the writings alike.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tagmask.functions.text import placeholder
from tagmask.model import APPLIED, APPROVED, DISABLED, NOT_FOUND, PENDING
from tagmask.operators.anchors import SHORTEST, candidates
from tagmask.operators.numbering import numbered
from tagmask.sources.scratch import kept, kept_by

#: Writings of a dossier up to which each of its documents meets the list of all; in larger dossiers candidates come by a join.
LISTED = 500
#: Sentinels are an opening character, shifted digits and a closing one; an escaped character is ESCAPE and two of six symbols.
OPEN, DIGITS, CLOSE, ESCAPE = "\ue000", "".join(chr(0xE001 + i) for i in range(10)), "\ue00b", "\ue00c"
SPECIAL = "".join(chr(0xE000 + i) for i in range(19))
#: The same as a range: a class of single characters beyond Latin takes Java many times longer.
_SPECIALS = f"[{SPECIAL[0]}-{SPECIAL[-1]}]"
_CODES = {c: ESCAPE + SPECIAL[13 + i // 6] + SPECIAL[13 + i % 6] for i, c in enumerate(SPECIAL)}


def new_values(detections: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Detected values that have no tag yet: one row per (dossier_id, value), the first named gives the category.

    Empty values go, blank ones stay. A value that is a tag's value already goes, whatever its category.
    """
    named = detections.filter(F.col("value") != "")
    order = Window.partitionBy("dossier_id", "value").orderBy("arrival", "det_seq", "category")
    first = named.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("dossier_id", "value", "category")
    return first if tags is None else first.join(tags.select("dossier_id", "value"), ["dossier_id", "value"], "left_anti")


def assign_tags(new: DataFrame, counters: DataFrame | None = None, tags: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """Tags for new values: per category by length descending, then value; numbers go on from the counters, places (pos) from the
    tags. `wide` is for dossiers too large for one task (see numbering.py)."""
    order = [F.length("value").desc(), F.col("value")]
    placed = numbered(numbered(new, ["dossier_id", "category"], order, "_i", wide), ["dossier_id"], order, "_pos", wide)
    if counters is not None:
        placed = placed.join(counters, ["dossier_id", "category"], "left").withColumn("_i", F.col("_i") + F.coalesce("last_idx", F.lit(0))).drop("last_idx")
    if tags is not None:
        last = tags.groupBy("dossier_id").agg(F.max("pos").alias("_last"))
        placed = placed.join(last, "dossier_id", "left").withColumn("_pos", F.col("_pos") + F.coalesce("_last", F.lit(0)))
    return placed.select("dossier_id", placeholder(F.col("category"), F.col("_i")).alias("tag"), "category", F.col("_i").alias("idx"), "value", F.lit(0).cast("long").alias("occurrences"), F.lit(NOT_FOUND).alias("status"), F.array().cast("array<string>").alias("variants"), F.col("_pos").alias("pos"))


def advance_counters(counters: DataFrame, tags: DataFrame) -> DataFrame:
    """The highest number ever given per category; it never falls."""
    given = tags.select("dossier_id", "category", F.col("idx").cast("long").alias("last_idx"))
    return counters.select("dossier_id", "category", F.col("last_idx").cast("long")).unionByName(given).groupBy("dossier_id", "category").agg(F.max("last_idx").alias("last_idx"))


def active_tags(tags: DataFrame, switches: DataFrame) -> DataFrame:
    """Tags that mask: not disabled, in a category that is not switched off (no row: on)."""
    on = switches.select("dossier_id", "category", F.col("enabled").alias("_on"))
    joined = tags.join(on, ["dossier_id", "category"], "left").filter((F.col("status") != DISABLED) & F.coalesce("_on", F.lit(True)))
    return joined.select(*tags.columns)


def writings(tags: DataFrame, wide: bool = False) -> DataFrame:
    """Every value and variant with its rank in the dossier: longer first, then text, then the older tag. `wide` is for dossiers
    too large for one task (see numbering.py)."""
    spelled = spellings(tags)
    ranked = numbered(spelled, ["dossier_id"], [F.length("writing").desc(), F.col("writing"), F.col("pos"), F.col("_v")], "rank", wide)
    return ranked.select("dossier_id", "tag", "writing", F.col("rank").cast("int").alias("rank"))


def spellings(tags: DataFrame, *more: str) -> DataFrame:
    """Every value and variant with what ranks it (see writings), but no rank: a text needs only the order of those that it
    holds. `more` names columns of the tag that come along."""
    forms = F.concat(F.array("value"), F.coalesce("variants", F.array().cast("array<string>")))
    return tags.select("dossier_id", "tag", "pos", *more, F.posexplode(forms).alias("_v", "writing")).filter("writing <> ''")


def _sentinel(rank: Column) -> Column:
    return F.concat(F.lit(OPEN), F.translate(rank.cast("string"), "0123456789", DIGITS), F.lit(CLOSE))


def _escaped(text: Column) -> Column:
    """The text without characters of sentinels. Literal matches are those of the unescaped texts: an escaped character
    begins with ESCAPE, which occurs nowhere else, so no match begins or ends inside one."""
    special = _SPECIALS
    code = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    sides = F.zip_with(F.split(text, special), F.regexp_extract_all(text, F.lit(f"({special})"), 1), lambda part, c: F.concat(part, F.coalesce(F.element_at(code, c), F.lit(""))))
    return F.when(text.rlike(special), F.array_join(sides, "")).otherwise(text)


def _unescaped(text: Column) -> Column:
    plain = text
    for c, escaped in _CODES.items():
        if c != ESCAPE:
            plain = F.replace(plain, F.lit(escaped), F.lit(c))
    # ESCAPE itself comes last, so that it never meets what follows an escaped one.
    return F.when(F.contains(text, F.lit(ESCAPE)), F.replace(plain, F.lit(_CODES[ESCAPE]), F.lit(ESCAPE))).otherwise(text)


def _entry(spelled: DataFrame) -> Column:
    """A writing as the fold needs it: what ranks it first, then how it stands in escaped text (null: as it is), and the rest."""
    order = ["rank", "writing"] if "rank" in spelled.columns else ["_l", "writing", "pos", "_v"]
    rest = [c for c in spelled.columns if c not in ("dossier_id", *order)]
    return F.struct(*[(-F.length("writing")).alias(c) if c == "_l" else c for c in order], F.when(F.col("writing").rlike(_SPECIALS), _escaped(F.col("writing"))).alias("escaped"), *rest)


def with_writings(docs: DataFrame, spelled: DataFrame, wide: bool = False) -> DataFrame:
    """`docs` plus `_ws`: those of the dossier's writings that the text holds (writing, tag, escaped, ...), by rank.

    `spelled` (from writings or spellings) is written once and read where it is needed; by dossier, so that texts that are kept
    by dossier, too, meet their lists where they are, or (`wide`) as it comes, where one dossier is too large for one task.
    In dossiers of more than LISTED writings the candidates come from a join of keys (see anchors.py), so that no row carries
    them all and each text is shuffled once; only writings of less than three bytes are listed there. Streams, which
    cannot be grouped, meet the whole list.
    """
    entry = _entry(spelled)
    held = lambda ws: F.filter(ws, lambda w: F.contains(F.col("text"), w["writing"]))
    if docs.isStreaming:
        lists = spelled.groupBy("dossier_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
        return docs.join(lists, "dossier_id", "left").withColumn("_ws", held(_or_none("_all", lists))).drop("_all")
    spelled = kept(spelled) if wide else kept_by(spelled, "dossier_id")
    large = kept(spelled.groupBy("dossier_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > LISTED).select("dossier_id"))
    some = not large.isEmpty()
    brief = F.octet_length("writing") < SHORTEST
    listed = spelled.join(large.withColumn("_large", F.lit(True)), "dossier_id", "left").filter(F.col("_large").isNull() | brief) if some else spelled
    lists = listed.groupBy("dossier_id").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    if not some:
        return docs.join(lists, "dossier_id", "left").withColumn("_ws", held(_or_none("_all", lists))).drop("_all")
    near = docs.join(large.withColumn("_large", F.lit(True)), "dossier_id", "left")
    small = near.filter(F.col("_large").isNull()).join(lists, "dossier_id", "left").withColumn("_ws", held(_or_none("_all", lists))).drop("_all", "_large")

    hot = spelled.join(large, "dossier_id", "left_semi").filter(~brief)
    texts = near.filter("_large").drop("_large")
    found = candidates(texts, hot, "writing", "dossier_id", entry)
    found = found.select(F.col("dossier_id").alias("_k"), F.col("doc_id").alias("_d"), "_found")
    joined = texts.join(found, (F.col("dossier_id") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    if spelled.join(large, "dossier_id", "left_semi").filter(brief).isEmpty():
        both = _or_none("_found", found)
    else:
        joined, both = joined.join(lists, "dossier_id", "left"), F.concat(_or_none("_all", lists), _or_none("_found", found))
    return small.unionByName(joined.withColumn("_ws", F.array_sort(held(both))).drop("_k", "_d", "_found", "_all"))


def _or_none(column: str, of: DataFrame) -> Column:
    return F.coalesce(column, F.array().cast(of.schema[column].dataType))


def claim(docs: DataFrame, spelled: DataFrame, wide: bool = False) -> DataFrame:
    """`docs` plus `_ws` (the dossier's writings in the text, by rank, each with the sentinel that stands for it) and `_folded`
    (escaped text with sentinels)."""
    marked = F.transform("_ws", lambda w, i: w.withField("mark", _sentinel(i)))
    folded = F.aggregate("_ws", _escaped(F.col("text")), lambda t, w: F.replace(t, F.coalesce(w["escaped"], w["writing"]), w["mark"]))
    return with_writings(docs, spelled, wide).withColumn("_ws", marked).withColumn("_folded", folded)


def mask_text(docs: DataFrame, spelled: DataFrame, wide: bool = False) -> DataFrame:
    """`docs` plus `masked`. Null texts stay null."""
    masked = F.aggregate("_ws", F.col("_folded"), lambda t, w: F.replace(t, w["mark"], w["tag"]))
    return claim(docs, spelled, wide).withColumn("_masked", masked).withColumn("masked", _unescaped(F.col("_masked"))).drop("_ws", "_folded", "_masked")


_MARK = f"{OPEN}([^{CLOSE}]*){CLOSE}"


def _claims() -> Column:
    """The claimed writings (of `_ws`) in the order of the text."""
    at = lambda h: F.translate(h, DIGITS, "0123456789").try_cast("int")
    return F.transform(F.regexp_extract_all("_folded", F.lit(_MARK), 1), lambda h: F.get("_ws", at(h)))


def _pieces(claimed: DataFrame) -> DataFrame:
    """_texts: what lies between claims; _claims: the claimed writings in order."""
    return claimed.withColumn("_texts", F.transform(F.split("_folded", _MARK), _unescaped)).withColumn("_claims", _claims())


def claimed_tags(docs: DataFrame, spelled: DataFrame) -> DataFrame:
    """dossier_id, doc_id, tag: a row per claim, as claimed_regions without the places."""
    # Outer, and then filtered: of an inner explode Spark infers a filter that works out the whole list again, twice.
    claimed = claim(docs, spelled).select("dossier_id", "doc_id", F.transform(_claims(), lambda w: w["tag"]).alias("_t"))
    return claimed.select("dossier_id", "doc_id", F.explode_outer("_t").alias("tag")).filter("tag is not null")


def claimed_regions(docs: DataFrame, spelled: DataFrame) -> DataFrame:
    """dossier_id, doc_id, start, end, tag: claims in the original text, in code points."""
    # Gaps and claims side by side as one column, so that no expression over the folded text is evaluated per element.
    cut = _pieces(claim(docs, spelled))
    sized = cut.select("dossier_id", "doc_id", F.zip_with("_texts", "_claims", lambda g, w: F.struct(F.length(g).alias("g"), F.length(w["writing"]).alias("n"), w["tag"].alias("t"))).alias("_z"))
    step = lambda acc, z: F.struct((acc["at"] + z["g"] + z["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + z["g"]).alias("start"), (acc["at"] + z["g"] + z["n"]).alias("end"), z["t"].alias("tag")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,tag:string>>").alias("out"))
    claimed = F.filter("_z", lambda z: z["t"].isNotNull())
    rows = sized.select("dossier_id", "doc_id", F.explode_outer(F.aggregate(claimed, zero, step)["out"]).alias("r"))
    return rows.filter("r is not null").select("dossier_id", "doc_id", "r.*")


def segment_lists(docs: DataFrame, tags: DataFrame, switches: DataFrame) -> DataFrame:
    """dossier_id, doc_id, segments: the original text cut at the claims of all tags, a list of (text, tag, category, masked: is
    the tag active); null for texts without any."""
    on = switches.select("dossier_id", "category", F.col("enabled").alias("_on"))
    judged = tags.join(on, ["dossier_id", "category"], "left").withColumn("_active", (F.col("status") != DISABLED) & F.coalesce("_on", F.lit(True)))
    cut = _pieces(claim(docs, spellings(judged, "category", "_active")))
    gap = lambda g: F.struct(g.alias("text"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("masked"))
    claimed = lambda w: F.struct(w["writing"].alias("text"), w["tag"].alias("tag"), w["category"].alias("category"), F.coalesce(w["_active"], F.lit(False)).alias("masked"))
    parts = F.flatten(F.zip_with("_texts", "_claims", lambda g, w: F.array(gap(g), claimed(w))))
    rows = cut.select("dossier_id", "doc_id", F.filter(parts, lambda s: s["text"].isNotNull() & (s["text"] != "")).alias("segments"))
    return rows.withColumn("segments", F.when(F.size("segments") > 0, F.col("segments")))


def segments(docs: DataFrame, tags: DataFrame, switches: DataFrame) -> DataFrame:
    """The original text cut at the claims of all tags: seq, text, tag, category, masked (is the tag active)."""
    rows = segment_lists(docs, tags, switches).select("dossier_id", "doc_id", F.posexplode_outer("segments").alias("seq", "s"))
    return rows.filter("s is not null").select("dossier_id", "doc_id", "seq", "s.*")


def mask_documents(docs: DataFrame, tags: DataFrame, switches: DataFrame | None = None, wide: bool = False) -> DataFrame:
    """`docs` plus `masked`, by the active tags. `wide` is for dossiers too large for one task."""
    return mask_text(docs, spellings(tags if switches is None else active_tags(tags, switches)), wide)


def mask_wide(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) plus `masked`, by writings (rank, writing, tag) that hold for all documents: one dossier of any size."""
    one = F.lit("all").alias("dossier_id")
    texts = docs.select(one, "doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return mask_text(texts, ranked.select(one, "rank", "writing", "tag"), wide=True).select("_row.*", "masked")


def count_occurrences(tags: DataFrame, regions: DataFrame) -> DataFrame:
    """Tags with their counts over the dossier and status; disabled tags keep status and count."""
    totals = regions.groupBy("dossier_id", "tag").agg(F.count("*").alias("_n"))
    joined = tags.join(totals, ["dossier_id", "tag"], "left")
    n, off = F.coalesce("_n", F.lit(0)), F.col("status") == DISABLED
    counted = joined.withColumn("occurrences", F.when(off, F.col("occurrences")).otherwise(n)).withColumn("status", F.when(off, F.col("status")).when(n > 0, APPLIED).otherwise(NOT_FOUND))
    return counted.select(*tags.columns)


def restore_dictionary(tags: DataFrame) -> DataFrame:
    """dossier_id, tag, value of all tags, disabled ones too; variants are not part of it."""
    return tags.select("dossier_id", "tag", "value", "pos")


def pending_documents(docs: DataFrame, analysed: DataFrame) -> DataFrame:
    """Documents that no detector has seen."""
    return docs.join(analysed, ["dossier_id", "doc_id"], "left_anti")


def analyse(docs: DataFrame, detections: DataFrame, tags: DataFrame | None = None, counters: DataFrame | None = None) -> DataFrame:
    """All tags of the dossiers after new detections, counted over all documents."""
    fresh = assign_tags(new_values(detections, tags), counters, tags)
    table = fresh if tags is None else tags.unionByName(fresh)
    return count_occurrences(table, claimed_tags(docs, spellings(table)))


class Analysis(NamedTuple):
    """The tables after an analysis; `verdicts` has OK or EMPTY_DOSSIER for every dossier."""

    tags: DataFrame
    counters: DataFrame
    analysed: DataFrame
    dossiers: DataFrame
    verdicts: DataFrame


def analyse_dossiers(dossiers: DataFrame, docs: DataFrame, detector: Callable[[DataFrame], DataFrame], tags: DataFrame, counters: DataFrame, analysed: DataFrame) -> Analysis:
    """Detect in documents not analysed before, number what is new, count over all documents.

    A dossier (dossier_id, state, approval_hash) with documents becomes pending and keeps a stored hash; one without any is
    refused and stays as it is. Tags and counters of all dossiers come back, `analysed` names all documents.
    """
    filled = docs.select("dossier_id").distinct().withColumn("_filled", F.lit(True))
    fresh = pending_documents(docs, analysed)
    table = tags.unionByName(assign_tags(new_values(detector(fresh), tags), counters, tags))
    marked = dossiers.join(filled, "dossier_id", "left").withColumn("_filled", F.coalesce("_filled", F.lit(False)))
    return Analysis(
        count_occurrences(table, claimed_tags(docs, spellings(table))),
        advance_counters(counters, table),
        analysed.select("dossier_id", "doc_id").unionByName(fresh.select("dossier_id", "doc_id")).distinct(),
        marked.withColumn("state", F.when(F.col("_filled"), PENDING).otherwise(F.col("state"))).select(*dossiers.columns),
        marked.select("dossier_id", F.when(F.col("_filled"), "OK").otherwise("EMPTY_DOSSIER").alias("verdict")),
    )


def take_back_approval(dossiers: DataFrame, changed: DataFrame) -> DataFrame:
    """Dossiers of which the changed ones (dossier_id) lose an approval and its hash."""
    touched = changed.select("dossier_id").distinct().withColumn("_touched", F.lit(True))
    undone = (F.col("state") == APPROVED) & F.col("_touched").isNotNull()
    joined = dossiers.join(touched, "dossier_id", "left")
    return joined.withColumns({"state": F.when(undone, PENDING).otherwise(F.col("state")), "approval_hash": F.when(~undone, F.col("approval_hash"))}).select(*dossiers.columns)


def remove_documents(docs: DataFrame, tags: DataFrame, gone: DataFrame) -> DataFrame:
    """Tags after documents (dossier_id, doc_id) are removed: counted again, and without those that no longer occur
    unless they are disabled."""
    left = docs.join(gone, ["dossier_id", "doc_id"], "left_anti")
    return count_occurrences(tags, claimed_tags(left, spellings(tags))).filter((F.col("occurrences") > 0) | (F.col("status") == DISABLED))


class Removal(NamedTuple):
    """The tables after a removal; `verdicts` has REMOVED or UNKNOWN_DOCUMENT for every request."""

    docs: DataFrame
    tags: DataFrame
    analysed: DataFrame
    dossiers: DataFrame
    verdicts: DataFrame


def remove_from_dossiers(dossiers: DataFrame, docs: DataFrame, tags: DataFrame, analysed: DataFrame, gone: DataFrame) -> Removal:
    """Remove documents (dossier_id, doc_id) without asking a detector again. Only dossiers that lose a document are counted
    anew and lose an approval; the removed documents are no longer analysed."""
    key = ["dossier_id", "doc_id"]
    known = docs.select(*key).distinct().withColumn("_known", F.lit(True))
    asked = gone.select(*key).distinct().join(known, key, "left")
    verdicts = asked.select(*key, F.when(F.col("_known"), "REMOVED").otherwise("UNKNOWN_DOCUMENT").alias("verdict"))
    removed = asked.filter("_known").select(*key)
    touched = removed.select("dossier_id").distinct()
    counted = remove_documents(docs.join(touched, "dossier_id", "left_semi"), tags.join(touched, "dossier_id", "left_semi"), removed)
    return Removal(
        docs.join(removed, key, "left_anti"),
        tags.join(touched, "dossier_id", "left_anti").unionByName(counted),
        analysed.join(removed, key, "left_anti"),
        take_back_approval(dossiers, removed),
        verdicts,
    )


def set_category(switches: DataFrame, commands: DataFrame) -> DataFrame:
    """Switches after commands (dossier_id, seq, target, enabled): the last one per category wins."""
    all_of = switches.select("dossier_id", "category", "enabled", F.lit(-1).cast("long").alias("seq")).unionByName(commands.select("dossier_id", F.col("target").alias("category"), "enabled", F.col("seq").cast("long")))
    return all_of.groupBy("dossier_id", "category").agg(F.max_by("enabled", "seq").alias("enabled"))


def set_tag(tags: DataFrame, commands: DataFrame) -> DataFrame:
    """Tags after commands (dossier_id, seq, target, enabled); `error` rows for unknown tags come from unknown_tags."""
    last = commands.groupBy("dossier_id", F.col("target").alias("tag")).agg(F.max_by("enabled", "seq").alias("_on"))
    status = F.when(F.col("_on").isNull(), F.col("status")).when(~F.col("_on"), DISABLED).when(F.col("occurrences") > 0, APPLIED).otherwise(NOT_FOUND)
    return tags.join(last, ["dossier_id", "tag"], "left").withColumn("status", status).select(*tags.columns)


def unknown_tags(tags: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands that name no tag of their dossier."""
    return commands.join(tags.select("dossier_id", F.col("tag").alias("target")), ["dossier_id", "target"], "left_anti")
