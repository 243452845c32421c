import random

from pyspark.sql import functions as F

from tagmask.operators import masking

TAGS = "dossier_id string, tag string, category string, idx long, value string, occurrences long, status string, variants array<string>, pos long"


def docs_of(spark, *texts):
    return spark.createDataFrame([("k", f"d{i}", i, t) for i, t in enumerate(texts)], "dossier_id string, doc_id string, arrival long, text string")


def tags_of(spark, *values):
    rows = [("k", f"d{i}", i, 0, v, "PERSONA") for i, v in enumerate(values)]
    return masking.assign_tags(masking.new_values(spark.createDataFrame(rows, "dossier_id string, doc_id string, arrival long, det_seq int, value string, category string")))


def masked(spark, values, *texts):
    out = masking.mask_documents(docs_of(spark, *texts), tags_of(spark, *values)).orderBy("doc_id").collect()
    return [r.masked for r in out]


def test_numbering(spark):
    tags = {r.value: r.tag for r in tags_of(spark, "Bianchi", "Azzurri", "Mario Rossi", "Mario Rossi", "").collect()}
    assert tags == {"Mario Rossi": "[PERSONA_1]", "Azzurri": "[PERSONA_2]", "Bianchi": "[PERSONA_3]"}


def test_numbering_goes_on(spark):
    counters = spark.createDataFrame([("k", "PERSONA", 1)], "dossier_id string, category string, last_idx long")
    new = spark.createDataFrame([("k", "Mario", "PERSONA")], "dossier_id string, value string, category string")
    assert masking.assign_tags(new, counters).first().tag == "[PERSONA_2]"


def test_masks(spark):
    assert masked(spark, ["Mario Rossi"], "Il sig. Mario Rossi paga.", "ROSSI MARIO paga.", "") == ["Il sig. [PERSONA_1] paga.", "ROSSI MARIO paga.", ""]
    assert masked(spark, ["Mario Rossi", "Rossi"], "Mario Rossi e il dott. Rossi.") == ["[PERSONA_1] e il dott. [PERSONA_2]."]
    assert masked(spark, ["Rossi"], "Rossini canta.") == ["[PERSONA_1]ni canta."]
    assert masked(spark, ["bcde", "abc"], "abcde") == ["a[PERSONA_1]"]
    assert masked(spark, ["Mario", "PERSONA", "1"], "Mario 1") == ["[PERSONA_2] [PERSONA_3]"]


def test_variants(spark):
    tags = spark.createDataFrame([("k", "[PERSONA_1]", "PERSONA", 1, "Mario Rossi", 0, "NOT_FOUND", ["M. Rossi"], 1), ("k", "[PERSONA_2]", "PERSONA", 2, "Anna Neri", 0, "NOT_FOUND", ["Rossi"], 2)], TAGS)
    out = masking.mask_documents(docs_of(spark, "Mario Rossi e M. Rossi firmano."), tags).first().masked
    assert out == "[PERSONA_1] e [PERSONA_1] firmano."


def test_private_use_characters(spark):
    assert masked(spark, ["Rossi"], "Rossi", "Rossi") == ["[PERSONA_1]", "[PERSONA_1]"]


def brute(text, ranked):
    hits = []
    for rank, w in enumerate(ranked):
        at = text.find(w)
        while at >= 0:
            hits.append((rank, at, at + len(w)))
            at = text.find(w, at + 1)
    # Stronger hits first (a lower rank, then what begins earlier); a hit that meets a taken place goes.
    taken = []
    for rank, start, end in sorted(hits):
        if all(end <= s or e <= start for s, e, _ in taken):
            taken.append((start, end, rank))
    return sorted(taken)


def test_random_texts(spark):
    rng = random.Random(3)
    for _ in range(3):
        values = list({"".join(rng.choice("ab1[é") for _ in range(rng.randint(1, 4))) for _ in range(25)})
        texts = ["".join(rng.choice("ab1[é") for _ in range(rng.randint(0, 30))) for _ in range(200)]
        docs, tags = docs_of(spark, *texts), tags_of(spark, *values)
        ranked = [(r.writing, r.tag) for r in masking.writings(tags).orderBy("rank").collect()]
        regions = {}
        for r in masking.claimed_regions(docs, masking.writings(tags)).collect():
            regions.setdefault(r.doc_id, []).append((r.start, r.end, r.tag))
        for i, text in enumerate(texts):
            want = [(a, b, ranked[k][1]) for a, b, k in brute(text, [w for w, _ in ranked])]
            assert sorted(regions.get(f"d{i}", [])) == want, (text, values)
        table = masking.writings(tags).select("rank", "writing", "tag")
        assert [r.masked for r in masking.mask_wide(docs, table).orderBy("doc_id").collect()] == [r.masked for r in masking.mask_documents(docs, tags).orderBy("doc_id").collect()]


def test_texts_with_sentinel_characters(spark):
    """Texts and writings that hold any of the private-use characters are masked like others, never to null."""
    rng = random.Random(4)
    alphabet = [*masking.SPECIAL, "a", "b", "\ue100", "\uf8ff", "1"]
    values = list({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(40)})
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [masking.SPECIAL * 3, "".join(map(chr, range(0xE000, 0xF900)))]
    docs, tags = docs_of(spark, *texts), tags_of(spark, *values)
    ranked = [(r.writing, r.tag) for r in masking.writings(tags).orderBy("rank").collect()]
    regions = {}
    for r in masking.claimed_regions(docs, masking.writings(tags)).collect():
        regions.setdefault(r.doc_id, []).append((r.start, r.end, r.tag))
    out = {r.doc_id: r.masked for r in masking.mask_documents(docs, tags).collect()}
    for i, text in enumerate(texts):
        want = [(a, b, ranked[k][1]) for a, b, k in brute(text, [w for w, _ in ranked])]
        assert sorted(regions.get(f"d{i}", [])) == want
        parts, at = [], 0
        for a, b, tag in want:
            parts += [text[at:a], tag]
            at = b
        assert out[f"d{i}"] == "".join([*parts, text[at:]])
    parts = {}
    for r in masking.segments(docs, tags, spark.createDataFrame([], "dossier_id string, category string, enabled boolean")).collect():
        parts.setdefault(r.doc_id, []).append((r.seq, r.text))
    assert all("".join(t for _, t in sorted(parts.get(f"d{i}", []))) == text for i, text in enumerate(texts))


def test_large_dossiers_give_the_same(spark, monkeypatch):
    """A dossier with more writings than a list takes, beside one with few; texts of one id, null texts, short writings."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé中🙂") for _ in range(n))
    values = list({word(rng.randint(1, 12)) for _ in range(60)})
    rows = [("k", f"d{i % 50}", i, "".join(rng.choice([word(3), rng.choice(values), " "]) for _ in range(12))) for i in range(80)] + [("k", "none", 99, None), ("few", "d1", 100, "abc abc"), ("no", "d1", 101, "abc")]
    docs = spark.createDataFrame(rows, "dossier_id string, doc_id string, arrival long, text string")
    few = spark.createDataFrame([("few", "d1", 1, 0, "abc", "PERSONA")], "dossier_id string, doc_id string, arrival long, det_seq int, value string, category string")
    tags = tags_of(spark, *values).unionByName(masking.assign_tags(masking.new_values(few))).cache()
    results = []
    for listed in (1000, 5, 0):
        monkeypatch.setattr(masking, "LISTED", listed)
        results.append(sorted((r.dossier_id, r.arrival, r.masked) for r in masking.mask_documents(docs, tags).collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)


def test_wide_numbering_is_that_of_one_window(spark):
    rng = random.Random(6)
    rows = list({("k" if rng.random() < 0.8 else "l", f"v{rng.randrange(10 ** rng.randint(1, 6))}", rng.choice(["CF", "DATA"])) for _ in range(3000)})
    new = spark.createDataFrame(rows, "dossier_id string, value string, category string")
    counters = spark.createDataFrame([("k", "CF", 40), ("l", "IBAN", 7)], "dossier_id string, category string, last_idx long")
    old = spark.createDataFrame([("k", 3), ("k", 9)], "dossier_id string, pos long")
    rows_of = lambda df: sorted(map(tuple, df.drop("variants").collect()))
    for given in ((), (counters, old)):
        assert rows_of(masking.assign_tags(new.repartition(7), *given, wide=True)) == rows_of(masking.assign_tags(new, *given))
    assert masking.assign_tags(new.limit(0), wide=True).count() == 0
    tags = masking.assign_tags(new).withColumn("variants", F.array(F.upper("value"), F.lit(""), F.lit("same")))
    assert rows_of(masking.writings(tags.repartition(5), wide=True)) == rows_of(masking.writings(tags))


def test_wide_numbering_of_null_groups_and_single_rows(spark):
    from tagmask.operators.numbering import numbered

    rows = spark.createDataFrame([(None, i) for i in range(500)] + [("a", 1), ("b", 7), ("b", 3)], "g string, x int")
    got = {(r.g, r.x): r.n for r in numbered(rows.repartition(6), ["g"], [F.col("x")], "n", wide=True).collect()}
    assert got == {**{(None, i): i + 1 for i in range(500)}, ("a", 1): 1, ("b", 3): 1, ("b", 7): 2}


def test_workflows(spark):
    """Analysis, removal and merges change states as they must: empty dossiers are refused, approvals taken back."""
    from tagmask.operators import merging

    docs = spark.createDataFrame([("a", "1", 1, "Mario Rossi e M. Rossi"), ("a", "2", 2, "Anna Neri"), ("b", "1", 3, "Anna Neri")], "dossier_id string, doc_id string, arrival long, text string")
    dossiers = spark.createDataFrame([("a", "APPROVED", "h"), ("b", "APPROVED", "h"), ("c", "DRAFT", None)], "dossier_id string, state string, approval_hash string")
    table = spark.createDataFrame([(k, v, "PERSONA") for k in "ab" for v in ("Mario Rossi", "M. Rossi", "Anna Neri")], "dossier_id string, value string, category string")
    none = tags_of(spark, "x").limit(0)
    counters = spark.createDataFrame([("b", "PERSONA", 7)], "dossier_id string, category string, last_idx long")
    from tagmask.operators.detect import lookup_detector

    kept = lambda tables: type(tables)(*[spark.createDataFrame(t.collect(), t.schema) for t in tables])
    done = kept(masking.analyse_dossiers(dossiers, docs, lookup_detector(table), none, counters, docs.filter("dossier_id = 'a' and doc_id = '2'").select("dossier_id", "doc_id")))
    assert {(r.dossier_id, r.value): (r.tag, r.occurrences) for r in done.tags.collect()} == {("a", "Mario Rossi"): ("[PERSONA_1]", 1), ("a", "M. Rossi"): ("[PERSONA_2]", 1), ("b", "Anna Neri"): ("[PERSONA_8]", 1)}
    assert {tuple(r) for r in done.dossiers.collect()} == {("a", "PENDING_REVIEW", "h"), ("b", "PENDING_REVIEW", "h"), ("c", "DRAFT", None)}
    assert dict(done.verdicts.collect()) == {"a": "OK", "b": "OK", "c": "EMPTY_DOSSIER"} and done.analysed.count() == 3
    assert {(r.dossier_id, r.last_idx) for r in done.counters.collect()} == {("a", 2), ("b", 8)}

    gone = spark.createDataFrame([("b", "1"), ("b", "9")], "dossier_id string, doc_id string")
    left = kept(masking.remove_from_dossiers(dossiers, docs, done.tags, done.analysed, gone))
    assert {tuple(r) for r in left.dossiers.collect()} == {("a", "APPROVED", "h"), ("b", "PENDING_REVIEW", None), ("c", "DRAFT", None)}
    assert {(r.doc_id, r.verdict) for r in left.verdicts.collect()} == {("1", "REMOVED"), ("9", "UNKNOWN_DOCUMENT")}
    assert left.docs.count() == 2 and left.analysed.count() == 2 and {r.dossier_id for r in left.tags.collect()} == {"a"}

    found = merging.suggest_merges(done.tags)
    queue = spark.createDataFrame(found.collect(), found.schema)
    steps = spark.createDataFrame([("a", 1, "[PERSONA_1]+[PERSONA_2]", "merge")], "dossier_id string, seq int, merge_id string, decision string")
    settled = kept(merging.settle_merges(queue, done.tags, steps, docs, dossiers))
    assert [r.verdict for r in settled.verdicts.collect()] == ["MERGED"] and [r.resolved for r in settled.queue.collect()] == [True]
    assert {(r.tag, r.occurrences, tuple(r.variants)) for r in settled.tags.filter("dossier_id = 'a'").collect()} == {("[PERSONA_1]", 2, ("M. Rossi",))}
    assert {tuple(r) for r in settled.dossiers.collect()} == {("a", "PENDING_REVIEW", None), ("b", "APPROVED", "h"), ("c", "DRAFT", None)}


def test_partitions_do_not_matter(spark):
    texts = [f"Mario Rossi {i} e Rossi" for i in range(40)]
    tags = tags_of(spark, "Mario Rossi", "Rossi", "7")
    results = [sorted((r.doc_id, r.masked) for r in masking.mask_documents(docs_of(spark, *texts).repartition(n), tags.repartition(n)).collect()) for n in (1, 4, 37)]
    assert results[0] == results[1] == results[2]


def test_counts_switches_and_removal(spark):
    docs = docs_of(spark, "Mario Rossi, Rossi", "Rossi")
    tags = masking.count_occurrences(tags_of(spark, "Mario Rossi", "Rossi", "Verdi"), masking.claimed_regions(docs, masking.writings(tags_of(spark, "Mario Rossi", "Rossi", "Verdi"))))
    assert {r.value: (r.occurrences, r.status) for r in tags.collect()} == {"Mario Rossi": (1, "APPLIED"), "Rossi": (2, "APPLIED"), "Verdi": (0, "NOT_FOUND")}
    switches = spark.createDataFrame([("k", "PERSONA", False)], "dossier_id string, category string, enabled boolean")
    assert masking.active_tags(tags, switches).count() == 0
    gone = spark.createDataFrame([("k", "d0")], "dossier_id string, doc_id string")
    assert {r.value: r.occurrences for r in masking.remove_documents(docs, tags, gone).collect()} == {"Rossi": 1}
    commands = spark.createDataFrame([("k", 1, "[PERSONA_1]", False), ("k", 2, "[PERSONA_9]", True)], "dossier_id string, seq long, target string, enabled boolean")
    assert {r.tag: r.status for r in masking.set_tag(tags, commands).collect()}["[PERSONA_1]"] == "DISABLED"
    assert masking.unknown_tags(tags, commands).first().target == "[PERSONA_9]"


def test_empty_tables(spark):
    none = docs_of(spark).limit(0) if False else spark.createDataFrame([], "dossier_id string, doc_id string, arrival long, text string")
    assert masking.mask_documents(none, tags_of(spark, "x")).count() == 0
    assert masking.mask_documents(docs_of(spark, "x", None), tags_of(spark, "y").limit(0)).orderBy("doc_id").first().masked == "x"


def test_wide_table_by_lists_and_by_rare_grams(spark, monkeypatch):
    rng = random.Random(4)
    values = list({"".join(rng.choice("ab1[é") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    texts = ["".join(rng.choice("ab1[é") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", None]
    docs, table = docs_of(spark, *texts), masking.writings(tags_of(spark, *values)).select("rank", "writing", "tag")
    got = []
    for listed in (500, 3):
        monkeypatch.setattr(masking, "LISTED", listed)
        got.append([(r.doc_id, r.masked) for r in masking.mask_wide(docs, table).orderBy("doc_id").collect()])
    assert got[0] == got[1] and any("PERSONA" in (m or "") for _, m in got[1])
    assert masking.mask_wide(docs, table).columns == [*docs.columns, "masked"]
