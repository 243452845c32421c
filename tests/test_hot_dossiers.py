"""Dossiers of any size: merges by component, name keys, streamed digests, composed states, bitmaps, anchors, keyed streams."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagmask.operators import detect, masking, merging, registry, restore, review, state
from tagmask.sources.scratch import kept, scratch
from tagmask.streaming import keyed

TAG = "dossier_id string, tag string, category string, idx long, value string, occurrences long, status string, variants array<string>, pos long"


def tag_rows(n, dossier="d", category="PERSONA"):
    return [(dossier, f"[{category}_{i}]", category, i, f"v{i}", 0, "NOT_FOUND", [], i) for i in range(1, n + 1)]


# --- merges --------------------------------------------------------------------------------------------------------------------
def brute_settle(queue, tags, decisions):
    """Verdicts and tables of one dossier, decision by decision."""
    queue, rows, out = {q[0]: list(q) for q in queue}, {t[1]: list(t) for t in tags}, []
    for seq, merge_id, what in sorted(decisions):
        q = queue.get(merge_id)
        if q is None:
            out.append((seq, "UNKNOWN"))
            continue
        if q[3]:
            out.append((seq, "ALREADY_RESOLVED"))
            continue
        if what == "merge":
            a, b = rows.get(q[1]), rows.get(q[2])
            if a is None or b is None or q[1] == q[2] or a[2] != b[2]:
                out.append((seq, "FAILED"))
                continue
            keep, gone = (a, b) if a[3] <= b[3] else (b, a)
            keep[7] = list(dict.fromkeys([*keep[7], gone[4], *gone[7]]))
            del rows[gone[1]]
        q[3] = True
        out.append((seq, "MERGED" if what == "merge" else "SEPARATED"))
    return out, {t: tuple(r[7]) for t, r in rows.items()}, {m: q[3] for m, q in queue.items()}


def test_settle_merges_brute_force(spark):
    random.seed(11)
    tags, queue, decisions, want = [], [], [], {}
    for k in range(25):
        dossier = f"k{k}"
        own = tag_rows(random.randrange(2, 9), dossier) + tag_rows(2, dossier, "AZIENDA")
        names = [t[1] for t in own] + ["[PERSONA_99]"]
        suggested = {f"{a}+{b}": (f"{a}+{b}", a, b, random.random() < 0.15) for a, b in ((random.choice(names), random.choice(names)) for _ in range(8))}
        asked = [(seq, random.choice([*suggested, "nobody"]), random.choice(["merge", "merge", "separate"])) for seq in random.sample(range(100), 14)]
        want[dossier] = brute_settle(suggested.values(), own, asked)
        tags += own
        queue += [(dossier, m, "PERSONA", a, b, r) for m, a, b, r in suggested.values()]
        decisions += [(dossier, *d) for d in asked]
    tags = spark.createDataFrame(tags, TAG)
    queue = spark.createDataFrame(queue, "dossier_id string, merge_id string, category string, tag_a string, tag_b string, resolved boolean")
    decisions = spark.createDataFrame(decisions, "dossier_id string, seq int, merge_id string, decision string").repartition(5)
    dossiers = spark.createDataFrame([(k, "APPROVED", "h") for k in want], "dossier_id string, state string, approval_hash string")
    docs = spark.createDataFrame([], "dossier_id string, doc_id string, text string")
    done = merging.settle_merges(queue, tags, decisions, docs, dossiers)
    verdicts, tables, resolved = defaultdict(list), defaultdict(dict), defaultdict(dict)
    for r in done.verdicts.collect():
        verdicts[r.dossier_id].append((r.seq, r.verdict))
    for r in done.tags.collect():
        tables[r.dossier_id][r.tag] = tuple(r.variants)
    for r in done.queue.collect():
        resolved[r.dossier_id][r.merge_id] = r.resolved
    for k, (v, t, q) in want.items():
        assert sorted(verdicts[k]) == v and tables[k] == t and resolved[k] == q
    states = {r.dossier_id: r.state for r in done.dossiers.collect()}
    assert states == {k: "PENDING_REVIEW" if any(x == "MERGED" for _, x in v) else "APPROVED" for k, (v, _, _) in want.items()}


def test_a_failed_merge_stays_open(spark):
    tags = spark.createDataFrame(tag_rows(1), TAG)
    queue = spark.createDataFrame([("d", "m", "PERSONA", "[PERSONA_1]", "[PERSONA_2]", False)], "dossier_id string, merge_id string, category string, tag_a string, tag_b string, resolved boolean")
    decisions = spark.createDataFrame([("d", 1, "m", "merge"), ("d", 2, "m", "separate"), ("d", 3, "m", "merge")], "dossier_id string, seq int, merge_id string, decision string")
    assert [r.verdict for r in merging.decide_merges(queue, tags, decisions).orderBy("seq").collect()] == ["FAILED", "SEPARATED", "ALREADY_RESOLVED"]


def test_components(spark):
    """A chain, a star and a ring in one dossier."""
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("s0", f"s{i}") for i in range(1, 30)] + [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)] + [("x", "x")]
    table = spark.createDataFrame([("d", *random.sample(p, 2)) for p in pairs] + [("e", "c0", "s0")], "dossier_id string, tag_a string, tag_b string")
    got = {(r.dossier_id, r.tag): r.component for r in merging.components(table).collect()}
    assert {c for (k, t), c in got.items() if k == "d" and t[0] == "c"} == {"c0"} and {c for (k, t), c in got.items() if k == "d" and t[0] == "s"} == {"s0"}
    assert {c for (k, t), c in got.items() if k == "d" and t[0] == "r"} == {"r0"} and got["d", "x"] == "x" and got["e", "s0"] == "c0"


def brute_equivalent(a, b):
    free, bare = list(b), lambda t: t.rstrip(".")
    fits = lambda x, y: x == y or (len(bare(x)) == 1 and len(bare(y)) > 1 and bare(y).startswith(bare(x))) or (len(bare(y)) == 1 and len(bare(x)) > 1 and bare(x).startswith(bare(y)))
    if len(a) != len(b) or not a:
        return False
    if sorted(a) == sorted(b):
        return True
    for x in a:
        found = next((y for y in free if fits(x, y)), None)
        if found is None:
            return False
        free.remove(found)
    return True


def test_name_keys_lose_no_pair(spark):
    random.seed(12)
    words = ["mario", "marco", "m.", "m", "rossi", "r.", "rosa", "anna", "a", "...", "de"]
    names = [" ".join(random.choices(words, k=random.choice([1, 2, 2, 3, 3, 4, 7, 8]))) for _ in range(160)]
    tags = spark.createDataFrame([("d", f"[PERSONA_{i}]", "PERSONA", i, n, 0, "NOT_FOUND", [], i) for i, n in enumerate(names)], TAG)
    got = {(r.tag_a, r.tag_b) for r in merging.suggest_merges(tags).collect()}
    want = {(f"[PERSONA_{i}]", f"[PERSONA_{j}]") for i, a in enumerate(names) for j, b in enumerate(names) if i < j and brute_equivalent(a.split(), b.split())}
    assert got == want and merging.suggest_merges(tags).count() == len(want)


def test_names_that_only_begin_alike_do_not_meet(spark):
    """One dossier of 100 000 names `m... r...`, which would be five billion pairs by first letters."""
    name = F.when(F.col("id") % 10_000 == 0, F.concat(F.lit("M. r"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(" r"), F.col("id").cast("string")))
    names = spark.range(100_000).select(F.lit("d").alias("dossier_id"), F.concat(F.lit("[PERSONA_"), F.col("id").cast("string"), F.lit("]")).alias("tag"), F.lit("PERSONA").alias("category"), F.col("id").alias("idx"), name.alias("value"))
    extra = spark.createDataFrame([("d", "[PERSONA_200000]", "PERSONA", 200_000, "r10000 Maria")], names.schema)
    assert [(r.tag_a, r.tag_b) for r in merging.suggest_merges(names.unionByName(extra)).collect()] == [("[PERSONA_10000]", "[PERSONA_200000]")]


# --- digests, states, bitmaps ----------------------------------------------------------------------------------------------------
def test_digest_is_carried_across_batches(spark):
    random.seed(13)
    rows = [(random.choice(["a", "b", "hot", "hot", "hot"]), f"x{i}", f"f{random.randrange(40)}", random.choice(["", "testo 🙂", f"t{i}"])) for i in range(500)]
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))
        want[k] = hashlib.sha256("".join(f"{f}\n{len(t)}\n{t}" for _, _, f, t in mine).encode()).hexdigest()
    table = spark.createDataFrame(rows, "dossier_id string, doc_id string, filename string, masked string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.dossier_id: r.digest for r in review.approval_digest(table).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and review.approval_digest(table.limit(0)).count() == 0


def brute_state(events):
    now, hash_, refused = "DRAFT", None, 0
    for _, event, digest in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if event == "analysed":
            now = "PENDING_REVIEW"
        elif event == "approve" and now == "PENDING_REVIEW":
            now, hash_ = "APPROVED", digest
        elif event == "approve":
            refused += 1
        elif event == "mutation" and now == "APPROVED":
            now, hash_ = "PENDING_REVIEW", None
        elif event == "clear":
            now, hash_, refused = "DRAFT", None, 0
    return now, hash_, refused


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_states_put_together_from_ranges(spark, parts):
    """One dossier has most events; they are dealt over all tasks."""
    random.seed(14)
    rows = [(random.choice(["a", "b", "hot", "hot", "hot", "hot"]), seq // 2, random.choice(["analysed", "approve", "mutation", "mutation", "other", "clear" if seq % 50 == 0 else "approve"]), f"h{seq}") for seq in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.dossier_id: (r.state, r.approval_hash, r.rejected) for r in state.replay_state(spark.createDataFrame(rows, "dossier_id string, seq long, event string, digest string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {k: brute_state([r[1:] for r in rows if r[0] == k]) for k in ("a", "b", "hot")}


def test_missing_bitmaps(spark):
    random.seed(15)
    tags = [r for k, n in (("a", 1), ("b", 63), ("c", 64), ("d", 65), ("e", 200)) for r in tag_rows(n, k)]
    answers = [(k, f"x{i}", " ".join(f"[PERSONA_{random.randrange(1, 210)}]" for _ in range(random.randrange(300)))) for k in "abcdez" for i in range(4)] + [("e", "none", None)]
    table, said = spark.createDataFrame(tags, TAG), spark.createDataFrame(answers, "dossier_id string, answer_id string, text string")
    maps = restore.missing_bitmaps(said, table)
    assert maps.count() == 21 and all(len(r.missing) == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 4}[r.dossier_id] for r in maps.collect())
    rows = lambda df: sorted(map(tuple, df.select("dossier_id", "answer_id", "tag").collect()))
    assert rows(restore.expand_missing(maps, table)) == rows(restore.missing_values(said, table))


# --- masking -----------------------------------------------------------------------------------------------------------------------
def brute_mask(text, values):
    pieces = [(text, False)]
    for value, tag in sorted(values, key=lambda v: (-len(v[0]), v[0])):
        out = []
        for piece, done in pieces:
            parts = [piece] if done else piece.split(value)
            for i, part in enumerate(parts):
                out += ([(tag, True)] if i else []) + [(part, done)]
        pieces = out
    return "".join(p for p, _ in pieces)


@pytest.mark.parametrize("listed", [500, 5, 0])
def test_masking_by_lists_and_by_rare_grams(spark, monkeypatch, listed):
    monkeypatch.setattr(masking, "LISTED", listed)
    random.seed(16)
    alphabet = ["a", "b", "ab", "é", "中", "", "🙂", "12", " "]
    word = lambda most: "".join(random.choices(alphabet, k=random.randrange(1, most)))
    values, docs = {k: sorted({word(9) for _ in range(20)}) for k in ("x", "y")}, []
    for i in range(120):
        k = random.choice(["x", "x", "y", "nobody"])
        docs.append((k, None if i == 7 else f"d{i}", None if i == 9 else "".join(random.choice([word(6), random.choice(values.get(k, ["z"]))]) for _ in range(random.randrange(12)))))
    tags = [(k, f"[IBAN_{i}]", "IBAN", i, v, 0, "NOT_FOUND", [], i) for k, vs in values.items() for i, v in enumerate(vs)]
    got = {(r.dossier_id, r.doc_id): r.masked for r in masking.mask_documents(spark.createDataFrame(docs, "dossier_id string, doc_id string, text string"), spark.createDataFrame(tags, TAG)).collect()}
    assert len(got) == len(docs)
    for k, doc_id, text in docs:
        assert got[k, doc_id] == (None if text is None else brute_mask(text, [(v, f"[IBAN_{i}]") for i, v in enumerate(values.get(k, []))]))


# --- streams -----------------------------------------------------------------------------------------------------------------------
def test_keyed_state_over_restarts(spark):
    """Documents in four runs from one checkpoint; values that claim parts of earlier texts; repeated ids; untouched dossiers."""
    random.seed(17)
    rows = []
    for i in range(60):
        k = f"k{i % 5}" if i < 40 else "k0"
        found = [random.choice(["ab", "a", "bab", "aa", "b", "", "zz"]) for _ in range(3)]
        rows.append((k, f"d{i if i % 9 else 0}", i, "".join(random.choices("ab ", k=30)), [(j, v, random.choice(["PERSONA", "AZIENDA"])) for j, v in enumerate(found)]))
    schema = "dossier_id string, doc_id string, arrival long, text string, found array<struct<det_seq:int,value:string,category:string>>"
    path = scratch(spark)
    spark.createDataFrame(rows[:0], schema).write.parquet(f"{path}/in")
    seen = []
    for i in range(0, 60, 15):
        spark.createDataFrame(rows[i : i + 15], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        docs = spark.readStream.schema(schema).parquet(f"{path}/in")
        keyed.stream_changes(docs).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
        seen.append(keyed.newest(spark.read.parquet(f"{path}/out")).count())
    got = {(r.dossier_id, r.value): (r.tag, r.idx, r.pos, r.occurrences, r.status) for r in keyed.newest(spark.read.parquet(f"{path}/out")).collect()}
    first = {}
    for r in rows:
        first.setdefault((r[0], r[1]), r)
    docs = spark.createDataFrame([r[:4] for r in first.values()], "dossier_id string, doc_id string, arrival long, text string")
    tags = spark.createDataFrame([(k, t, t[1:].split("_")[0], i, v, 0, "NOT_FOUND", [], p) for (k, v), (t, i, p, _, _) in got.items()], TAG)
    want = {(r.dossier_id, r.value): (r.occurrences, r.status) for r in masking.count_occurrences(tags, masking.claimed_regions(docs, masking.writings(tags))).collect()}
    assert {key: (n, s) for key, (_, _, _, n, s) in got.items()} == want and seen == sorted(seen)
    # Numbers of a dossier and category, and places of a dossier, are 1, 2, ... without a gap.
    numbers, places = defaultdict(list), defaultdict(list)
    for (k, _), (tag, idx, pos, _, _) in got.items():
        numbers[k, tag.split("_")[0]].append(idx)
        places[k].append(pos)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in [*numbers.values(), *places.values()])


def test_streams_meet_the_table_of_their_batch(spark):
    """A tag that comes between two batches masks in the second only; a restart repeats nothing."""
    path, now = scratch(spark), [1]
    table = spark.createDataFrame(tag_rows(2), TAG)
    snapshot = lambda version: kept(table.filter(F.col("idx") <= version))
    schema = "dossier_id string, doc_id string, text string"
    for i in range(2):
        spark.createDataFrame([("d", f"x{i}", "v1 e v2")], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        docs = spark.readStream.schema(schema).parquet(f"{path}/in")
        keyed.stream_mask_batches(docs, snapshot, lambda: now[0], f"{path}/out", f"{path}/cp").awaitTermination()
        now[0] += 1
    rows = {r.doc_id: r.masked for r in spark.read.parquet(f"{path}/out/rows").collect()}
    assert rows == {"x0": "[PERSONA_1] e v2", "x1": "[PERSONA_1] e [PERSONA_2]"}
    answers = spark.createDataFrame([("d", "a", "[PERSONA_2] e [PERSONA_1]"), ("d", "b", "[PERSONA_3]")], "dossier_id string, answer_id string, text string")
    answers.write.parquet(f"{path}/answers")
    stream = spark.readStream.schema(answers.schema).parquet(f"{path}/answers")
    keyed.stream_restore_batches(stream, snapshot, lambda: now[0], f"{path}/back", f"{path}/cp2").awaitTermination()
    assert {r.answer_id: r.restored or r.verdict for r in spark.read.parquet(f"{path}/back/rows").collect()} == {"a": "v2 e v1", "b": "UNKNOWN"}


# --- detectors by name ---------------------------------------------------------------------------------------------------------------
def test_table_functions_are_detectors(spark):
    docs = spark.createDataFrame([("d", "1", 1, "ciao Anna, Bo"), ("d", "2", 2, None), ("e", "3", 3, "Anna"), ("d", "4", 4, "")], "dossier_id string, doc_id string, arrival long, text string")
    values = spark.createDataFrame([("d", "Bo", "PERSONA"), ("d", "Anna", "PERSONA"), ("d", "Anna", "AZIENDA")], "dossier_id string, value string, category string")
    registry.register_detector(spark, "t_listed", registry.contained, listed=True)
    rows = lambda df: sorted(map(tuple, df.select("dossier_id", "doc_id", "arrival", "det_seq", "value", "category").collect()))
    assert rows(registry.detector(spark, "t_listed", values)(docs)) == rows(detect.lookup_detector(values)(docs)) and rows(detect.lookup_detector(values)(docs))
    registry.register_detector(spark, "t_words", lambda text: [(w, "PERSONA") for w in text.split()])
    docs.createOrReplaceTempView("t_docs")
    assert spark.sql("SELECT doc_id, value FROM t_docs, LATERAL t_words(text) WHERE det_seq = 0").count() == 2
    registry.register_detector(spark, "t_wrong", lambda text: [(text, "NOBODY")])
    with pytest.raises(Exception, match="no category"):
        spark.sql("SELECT * FROM t_docs, LATERAL t_wrong(text)").collect()
    with pytest.raises(Exception, match="takes a text"):
        spark.sql("SELECT * FROM t_docs, LATERAL t_words(arrival)").collect()
    with pytest.raises(KeyError):
        registry.detector(spark, "t_none")
