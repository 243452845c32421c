"""Suggesting and applying merges of tags that are two writings of one name."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tagmask.functions.text import name_tokens, normalised_name, tokens_equivalent
from tagmask.model import NAMED
from tagmask.operators.masking import claimed_tags, count_occurrences, spellings, take_back_approval
from tagmask.sources.scratch import kept


#: Tokens up to which a name goes by all its keys (two to the power of its tokens); longer names meet by their first letters.
KEYED_TOKENS = 6


def _pair_keys(tokens: str, later: bool) -> Column:
    """Keys under which an older name meets later ones: every token stands for itself, or as its first letter with the side
    that has the initial. So names share a key exactly if their tokens can be paired, each equal or one the other's initial."""
    bare = lambda t: F.regexp_replace(t, r"\.+$", "")

    def options(token: Column) -> Column:
        short, first = F.length(bare(token)) == 1, F.substring(bare(token), 1, 1)
        wild = F.concat(F.lit("~"), first, F.when(short != F.lit(later), "I").otherwise("L"))
        own = F.array(F.concat(F.lit("="), token))
        return F.when(F.length(bare(token)) > 0, F.concat(own, F.array(wild))).otherwise(own)

    none = F.array(F.array().cast("array<string>"))
    lists = F.aggregate(tokens, none, lambda keys, token: F.flatten(F.transform(keys, lambda key: F.transform(options(token), lambda o: F.concat(key, F.array(o))))))
    letters = F.array(F.concat(F.lit("#"), F.array_join(F.array_sort(F.transform(tokens, lambda t: F.substring(t, 1, 1))), " ")))
    marked = F.array_distinct(F.transform(lists, lambda key: F.array_join(F.array_sort(key), " ")))
    return F.when(F.size(tokens) <= KEYED_TOKENS, marked).otherwise(letters)


def suggest_merges(tags: DataFrame, seen: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """Pairs of equivalent names of a dossier and category: merge_id, tag_a (the older), tag_b, resolved false.

    Candidates meet by keys that say which tokens are equal and which are initials, so names that only begin alike never
    meet; names of more than KEYED_TOKENS tokens meet by number of tokens and sorted first letters.
    """
    named = tags.filter(F.col("category").isin(*NAMED)).select("dossier_id", "category", "tag", "idx", name_tokens(normalised_name(F.col("value"), ascii_only)).alias("t")).filter(F.size("t") > 0)
    older = named.withColumn("k", F.explode(_pair_keys("t", False))).withColumn("n", F.size("t"))
    later = named.select("dossier_id", "category", F.col("tag").alias("tag_b"), F.col("idx").alias("idx_b"), F.col("t").alias("u"))
    later = later.withColumn("k", F.explode(_pair_keys("u", True))).withColumn("n", F.size("u"))
    pairs = older.join(later, ["dossier_id", "category", "n", "k"]).filter((F.col("idx") < F.col("idx_b")) & tokens_equivalent(F.col("t"), F.col("u")))
    out = pairs.select("dossier_id", F.concat("tag", F.lit("+"), "tag_b").alias("merge_id"), "category", F.col("tag").alias("tag_a"), "tag_b", F.lit(False).alias("resolved")).distinct()
    return out if seen is None else out.join(seen.select("dossier_id", "merge_id"), ["dossier_id", "merge_id"], "left_anti")


def extend_queue(queue: DataFrame, suggested: DataFrame) -> DataFrame:
    """The queue and what is new in it."""
    return queue.unionByName(suggested.join(queue.select("dossier_id", "merge_id"), ["dossier_id", "merge_id"], "left_anti"))


def apply_merges(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tags after merges (dossier_id, tag_a, tag_b) of which no tag takes part in two: the lower number survives and gets
    the other's value and variants. Pairs of one tag, of unknown tags or of two categories change nothing."""
    side = lambda c: tags.select("dossier_id", F.col("tag").alias(f"tag_{c}"), F.col("category").alias(f"cat_{c}"), F.col("idx").alias(f"idx_{c}"), F.col("value").alias(f"value_{c}"), F.col("variants").alias(f"variants_{c}"))
    both = pairs.select("dossier_id", "tag_a", "tag_b").join(side("a"), ["dossier_id", "tag_a"]).join(side("b"), ["dossier_id", "tag_b"]).filter("tag_a <> tag_b and cat_a = cat_b")
    older = F.col("idx_a") <= F.col("idx_b")
    pick = lambda n: F.when(older, F.col(f"{n}_a")).otherwise(F.col(f"{n}_b"))
    other = lambda n: F.when(older, F.col(f"{n}_b")).otherwise(F.col(f"{n}_a"))
    merged = both.select("dossier_id", pick("tag").alias("tag"), other("tag").alias("_gone"), F.array_distinct(F.concat(pick("variants"), F.array(other("value")), other("variants"))).alias("_variants"))
    left = tags.join(merged.select("dossier_id", F.col("_gone").alias("tag")), ["dossier_id", "tag"], "left_anti")
    return left.join(merged.select("dossier_id", "tag", "_variants"), ["dossier_id", "tag"], "left").withColumn("variants", F.coalesce("_variants", "variants")).select(*tags.columns)


def _step(rows: dict, a_tag: str, b_tag: str) -> bool:
    """One merge in a table of tags by name; False if it is refused."""
    a, b = rows.get(a_tag), rows.get(b_tag)
    if a is None or b is None or a is b or a["category"] != b["category"]:
        return False
    keep, gone = (a, b) if a["idx"] <= b["idx"] else (b, a)
    keep["variants"] = list(dict.fromkeys([*keep["variants"], gone["value"], *gone["variants"]]))
    del rows[gone["tag"]]
    return True


def components(pairs: DataFrame) -> DataFrame:
    """(dossier_id, tag, component) of all tags in pairs (dossier_id, tag_a, tag_b): the least tag that pairs lead to.

    Labels go along the pairs and then to their labels' labels, so that long chains take few rounds; every round is written.
    """
    both = kept(pairs.select("dossier_id", "tag_a", "tag_b").unionByName(pairs.select("dossier_id", F.col("tag_b").alias("tag_a"), F.col("tag_a").alias("tag_b"))).distinct())
    labels = kept(both.groupBy("dossier_id", F.col("tag_a").alias("tag")).agg(F.min("tag_b").alias("_l")).select("dossier_id", "tag", F.least("tag", "_l").alias("component")))
    while True:
        beside = both.join(labels.withColumnRenamed("tag", "tag_b"), ["dossier_id", "tag_b"]).groupBy("dossier_id", F.col("tag_a").alias("tag")).agg(F.min("component").alias("_l"))
        least = labels.join(beside, ["dossier_id", "tag"]).select("dossier_id", "tag", F.least("component", "_l").alias("_c"), F.col("component").alias("_old"))
        further = labels.select("dossier_id", F.col("tag").alias("_c"), F.col("component").alias("_cc"))
        moved = kept(least.join(further, ["dossier_id", "_c"], "left").select("dossier_id", "tag", F.least("_c", F.coalesce("_cc", "_c")).alias("component"), "_old"))
        labels = moved.select("dossier_id", "tag", "component")
        if moved.filter("component <> _old").isEmpty():
            return labels


def _carried_out(tags: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict per step, tags afterwards) of steps (dossier_id, seq, merge_id, decision, tag_a, tag_b, resolved) in order.

    Only tags that merges lead to each other depend on each other: each such component is one group, and one pass over it
    gives its verdicts and its tags. A failed merge leaves its suggestion open for later steps.
    """
    steps = steps.select("dossier_id", "seq", "merge_id", "decision", "tag_a", "tag_b", "resolved")
    parts = components(steps.filter("decision = 'merge' and not resolved"))
    of_a = parts.select("dossier_id", F.col("tag").alias("tag_a"), "component")
    placed = steps.join(of_a, ["dossier_id", "tag_a"], "left").withColumn("component", F.coalesce("component", "merge_id"))
    placed = placed.select(*[F.col(c).alias(c) for c in placed.columns])  # columns of their own: both sides may come from one table
    involved = tags.join(parts, ["dossier_id", "tag"]).select("dossier_id", "component", F.struct(*tags.columns).alias("row"))
    seq = steps.schema["seq"]
    out = T.StructType([T.StructField("dossier_id", T.StringType()), T.StructField("seq", seq.dataType), T.StructField("merge_id", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("row", tags.select(F.struct(*tags.columns).alias("row")).schema["row"].dataType)])
    arrow = to_arrow_schema(out)

    def fold(table: pa.Table, asked: pa.Table) -> pa.Table:
        rows, closed, done = {r["tag"]: r for r in table.column("row").to_pylist()}, set(), []
        for step in sorted(asked.to_pylist(), key=lambda s: s["seq"]):
            if step["resolved"] or step["merge_id"] in closed:
                verdict = "ALREADY_RESOLVED"
            elif step["decision"] == "separate":
                verdict = "SEPARATED"
            else:
                verdict = "MERGED" if _step(rows, step["tag_a"], step["tag_b"]) else "FAILED"
            if verdict in ("SEPARATED", "MERGED"):
                closed.add(step["merge_id"])
            done.append({"dossier_id": step["dossier_id"], "seq": step["seq"], "merge_id": step["merge_id"], "decision": step["decision"], "verdict": verdict})
        return pa.Table.from_pylist([*done, *({"dossier_id": r["dossier_id"], "row": r} for r in rows.values())], schema=arrow)

    key = ["dossier_id", "component"]
    both = kept(involved.groupBy(*key).cogroup(placed.groupBy(*key)).applyInArrow(fold, out))
    merged = both.filter("verdict is null").select("row.*").select(*tags.columns)
    others = tags.join(parts, ["dossier_id", "tag"], "left_anti").select(*tags.columns)
    return both.filter("verdict is not null").select("dossier_id", "seq", "merge_id", "decision", "verdict"), others.unionByName(merged)


def _plain_steps(decisions: DataFrame) -> DataFrame:
    """Ordered pairs (dossier_id, seq, tag_a, tag_b) as merges of suggestions of their own."""
    return decisions.select("dossier_id", "seq", F.col("seq").cast("string").alias("merge_id"), F.lit("merge").alias("decision"), "tag_a", "tag_b", F.lit(False).alias("resolved"))


def apply_merges_in_order(tags: DataFrame, decisions: DataFrame) -> DataFrame:
    """As apply_merges for decisions (dossier_id, seq, tag_a, tag_b) that depend on each other: one after another per
    dossier; a pair that names a tag absorbed before is refused, not followed."""
    return _carried_out(tags, _plain_steps(decisions))[1]


def merges_done(tags: DataFrame, decisions: DataFrame) -> DataFrame:
    """(dossier_id, seq, done) for decisions in order: whether each merge takes place."""
    return _carried_out(tags, _plain_steps(decisions))[0].select("dossier_id", "seq", (F.col("verdict") == "MERGED").alias("done"))


def decide_merges(queue: DataFrame, tags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Verdict per decision (dossier_id, seq, merge_id, decision): MERGED, SEPARATED, UNKNOWN, ALREADY_RESOLVED or FAILED
    (a tag is gone; the suggestion stays open for the next decision), if no decision changed the tags. See settle_merges for
    decisions that depend on each other."""
    joined = decisions.join(queue.select("dossier_id", "merge_id", "tag_a", "tag_b", "resolved"), ["dossier_id", "merge_id"], "left")
    for c in ("a", "b"):
        joined = joined.join(tags.select("dossier_id", F.col("tag").alias(f"tag_{c}"), F.lit(True).alias(f"_{c}")), ["dossier_id", f"tag_{c}"], "left")
    closes = (F.col("decision") == "separate") | (F.col("_a").isNotNull() & F.col("_b").isNotNull())
    earlier = Window.partitionBy("dossier_id", "merge_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.max(closes).over(earlier), F.lit(False))
    verdict = F.when(F.col("resolved").isNull(), "UNKNOWN").when(F.col("resolved") | closed, "ALREADY_RESOLVED").when(F.col("decision") == "separate", "SEPARATED").when(~closes, "FAILED").otherwise("MERGED")
    return joined.select("dossier_id", "seq", "merge_id", "decision", verdict.alias("verdict"))


class Settlement(NamedTuple):
    """The tables after decisions on the merge queue, and a verdict per decision."""

    verdicts: DataFrame
    queue: DataFrame
    tags: DataFrame
    dossiers: DataFrame


def settle_merges(queue: DataFrame, tags: DataFrame, decisions: DataFrame, docs: DataFrame, dossiers: DataFrame) -> Settlement:
    """Carry out decisions (dossier_id, seq, merge_id, decision): verdicts as decide_merges, one after another.

    Accepted merges are applied in their order and the dossiers concerned counted again and an approval taken back;
    `separate` only resolves the suggestion; a merge of which a tag is gone (an earlier one may have absorbed it) fails and
    stays open.
    """
    named = decisions.select("dossier_id", "seq", "merge_id", "decision").join(queue.select("dossier_id", "merge_id", "tag_a", "tag_b", "resolved"), ["dossier_id", "merge_id"], "left")
    known, after_all = _carried_out(tags, named.filter(F.col("resolved").isNotNull()))
    verdicts = known.unionByName(named.filter(F.col("resolved").isNull()).select("dossier_id", "seq", "merge_id", "decision", F.lit("UNKNOWN").alias("verdict")))
    closed = known.filter(F.col("verdict").isin("MERGED", "SEPARATED")).select("dossier_id", "merge_id", F.lit(True).alias("_closed")).distinct()
    after = queue.join(closed, ["dossier_id", "merge_id"], "left").withColumn("resolved", F.col("resolved") | F.coalesce("_closed", F.lit(False))).select(*queue.columns)
    touched = known.filter("verdict = 'MERGED'").select("dossier_id").distinct()
    merged = after_all.join(touched, "dossier_id", "left_semi").select(*tags.columns)
    counted = count_occurrences(merged, claimed_tags(docs.join(touched, "dossier_id", "left_semi"), spellings(merged)))
    return Settlement(verdicts, after, tags.join(touched, "dossier_id", "left_anti").select(*tags.columns).unionByName(counted), take_back_approval(dossiers, touched))


def merge_queue_view(queue: DataFrame, tags: DataFrame) -> DataFrame:
    """The queue with both values; null where a tag is gone."""
    value = lambda c: tags.select("dossier_id", F.col("tag").alias(f"tag_{c}"), F.col("value").alias(f"value_{c}"))
    return queue.join(value("a"), ["dossier_id", "tag_a"], "left").join(value("b"), ["dossier_id", "tag_b"], "left").select(*queue.columns, "value_a", "value_b")


def homonyms(spans: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Names (dossier_id, doc_id, span_id, category, value) that occur in two documents or more of a dossier."""
    keyed = spans.filter(F.col("category").isin(*NAMED)).withColumn("name", normalised_name(F.col("value"), ascii_only)).filter("name <> ''")
    groups = keyed.groupBy("dossier_id", "category", "name").agg(F.countDistinct("doc_id").alias("documents"), F.array_sort(F.collect_list("span_id")).alias("span_ids"))
    return groups.filter("documents >= 2")


def entity_groups(tags: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Values of a dossier and category with one normalised name: their sorted writings."""
    keyed = tags.withColumn("name", normalised_name(F.col("value"), ascii_only))
    return keyed.groupBy("dossier_id", "category", "name").agg(F.array_sort(F.collect_set("value")).alias("spellings"))
