import pytest
from pyspark.sql import functions as F

from tagmask.functions import text as fn
from tagmask.operators import detect, merging, restore, review, state
from tagmask.sources import ingest, responses, vault


def one(spark, column_of, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", column_of(F.col("v")).alias("x")).orderBy("i").collect()]


def test_restore(spark):
    words = spark.createDataFrame([("k", "[PERSONA_1]", "Mario Rossi", 1), ("k", "[PERSONA_10]", "Luisa Bianchi", 2), ("k", "[IBAN_1]", "IT60X0542811101000000123456", 3)], "dossier_id string, tag string, value string, pos long")
    texts = ["[PERSONA_10] firma.", "Il contratto è di [PERSONA_99].", "Firmato da [PERSON_1].", "Firmato da [PERSONA_1 oggi.", "[persona_1] e [PERSONA_99]", "[PERSONA_1] firma. [Nota] a margine.", "  \n", "niente"]
    answers = spark.createDataFrame([("k", i, t) for i, t in enumerate(texts)] + [("x", 99, "[PERSONA_1]")], "dossier_id string, answer_id int, text string")
    rows = restore.restore(answers, words).orderBy("answer_id").collect()
    assert [r.verdict for r in rows] == ["OK", "UNKNOWN", "UNKNOWN", "MALFORMED", "MALFORMED", "MALFORMED", "EMPTY", "OK", "DOSSIER_NOT_FOUND"]
    assert rows[0].restored == "Luisa Bianchi firma." and rows[1].fragments == ["[PERSONA_99]"] and rows[5].fragments == ["[Nota]"] and rows[3].restored is None


def test_names(spark):
    assert one(spark, fn.normalised_name, "Spett.le Sig. Rossi", "Sig.", "  MARIO　 Rossi", "Straße", *fn.TITLES) == ["rossi", "", "mario rossi", "strasse", *[""] * len(fn.TITLES)]
    pairs = [("Rossi Mario", "Mario Rossi", True), ("M. Rossi", "Mario Rossi", True), ("G. Rossi", "Mario Rossi", False), ("Mario Rossi Bianchi", "Mario Rossi", False), ("Sig.", "Dott.", False), ("M. M. Rossi", "Mario Maria Rossi", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    tokens = lambda c: fn.name_tokens(fn.normalised_name(F.col(c)))
    assert [r.x for r in rows.select("i", fn.tokens_equivalent(tokens("a"), tokens("b")).alias("x")).orderBy("i").collect()] == [p[2] for p in pairs]


def test_checks(spark):
    assert one(spark, fn.tax_code_valid, "RSSMRA85M01H501Q", "RSSMRA85M01H501Z", "x", None) == [True, False, False, False]
    assert one(spark, fn.vat_number_valid, "12345678903", "IT12345678903", "12345678900", "1") == [True, True, False, False]
    assert one(spark, fn.iban_valid, "IT60X0542811101000000123456", "IT60 X054 2811 1010 0000 0123 456", "IT60X0542811101000000123457") == [True, True, False]
    assert one(spark, fn.date_exists, "31/02/2024", "29/02/2024", "2024-13-01", "3 marzo 2024", "1.1.2020", "x") == [False, True, False, True, True, False]
    assert one(spark, fn.placeholder_index, "[PERSONA_12]", "[PERSONA_1]\n", "x") == [12, None, None]
    assert one(spark, lambda c: fn.excerpt(c, 5), " a  b ", "abcdefg", " \n") == ["a b", "abcde…", None]


def test_detection(spark):
    docs = spark.createDataFrame([("k", "d", 1, "Scrivi a a.b@c.it, IBAN IT60X0542811101000000123456 entro il 31/02/2024 o 01/03/2024. P.IVA 12345678903, tel. 333 1234567. Paga € 1.200,50.")], "dossier_id string, doc_id string, arrival long, text string")
    found = {(r.category, r.value) for r in detect.resolve_spans(detect.rule_spans(docs)).collect()}
    assert {("EMAIL", "a.b@c.it"), ("IBAN", "IT60X0542811101000000123456"), ("DATA", "01/03/2024"), ("PIVA", "12345678903"), ("TELEFONO", "333 1234567"), ("IMPORTO", "€ 1.200,50")} <= found
    assert ("DATA", "31/02/2024") not in found
    for r in detect.spans_to_detections(detect.rule_spans(docs), docs).collect():
        assert r.value in docs.first().text


SPANS = [
    ("TELEFONO", "Tel. +39 340 123456 14/03/2024", ["+39 340 123456"]),
    ("TELEFONO", "Tel. 02 12 34 56 78 e cell. 333-1234567", ["02 12 34 56 78", "333-1234567"]),
    ("TELEFONO", "tel 01123456 o tel 012312345678", []),
    ("TELEFONO", "hotel 0112345678", []),
    ("TELEFONO", "Ordine 00391234567 spedito, particella 3331234567", []),
    ("TELEFONO", "chiama 0039 06 1234567 oppure +393401234567.", ["0039 06 1234567", "+393401234567"]),
    ("PIVA", "IT12345678903 e P. IVA: 12345678903, mai 12345678903" + " " * 40 + "12345678903", ["IT12345678903", "12345678903", "12345678903"]),
    ("CATASTO", "al foglio n. 12, particella 345, sub 6 e fg 12 mappale 345", ["foglio n. 12, particella 345, sub 6", "fg 12 mappale 345"]),
    ("CATASTO", "foglio 12 " + "x" * 50 + " particella 3", []),
    ("PRATICA", "Pratica n. P/123, prot. 2024-55.b; fascicolo numero 7/A. Riferimento alla nota; pratica chiusa", ["Pratica n. P/123", "prot. 2024-55.b", "fascicolo numero 7/A"]),
    ("IMPORTO", "paga 1.250,00 € o € 0,505 o Totale 12345 EUR, € 1,2.3", ["1.250,00 €", "€ 0,505", "12345 EUR"]),
    ("INDIRIZZO", "in Via dei Mille 5, 10121 Torino", ["Via dei Mille 5, 10121"]),
    ("INDIRIZZO", "Piazza del Popolo 12 e VIA GARIBALDI 42, Corso della Repubblica 3", ["Piazza del Popolo 12", "VIA GARIBALDI 42", "Corso della Repubblica 3"]),
    ("INDIRIZZO", "via email dal cliente, Via Roma 10121 Torino", ["Via Roma 10121"]),
    ("INDIRIZZO", "viale dell'Arte 3/b; Via G. Verdi, n. 7. Poi", ["viale dell'Arte 3/b", "Via G. Verdi, n. 7"]),
    ("AZIENDA", "la Banca di Roma S.p.A. e Cooperativa alle Ginestre S.r.l, Neri & Figli snc", ["Banca di Roma S.p.A.", "Cooperativa alle Ginestre S.r.l", "Neri & Figli snc"]),
    ("AZIENDA", "il nuovo centro benessere spa", []),
    ("IBAN", "IBAN IT60 X054 2811 1010 0000 0123 456 AGENZIA", ["IT60 X054 2811 1010 0000 0123 456"]),
    ("DATA", "il 3 marzo 2024, il 31/02/2024, il 2024-02-29 o 1.1.2020", ["3 marzo 2024", "2024-02-29", "1.1.2020"]),
]


def test_each_rule(spark):
    docs = spark.createDataFrame([("k", f"{i:02}", 1, text) for i, (_, text, _) in enumerate(SPANS)], "dossier_id string, doc_id string, arrival long, text string")
    found = {}
    for r in detect.rule_spans(docs).collect():
        found.setdefault((int(r.doc_id), r.category), []).append((r.start, r.value))
        text = SPANS[int(r.doc_id)][1]
        assert text[r.start : r.end] == r.value
    for i, (category, _, want) in enumerate(SPANS):
        assert [v for _, v in sorted(found.get((i, category), []))] == want, (category, i)


def test_adversarial_texts_end(spark):
    import time

    texts = ["Via " + "A " * 3000, "Tel. " + "0 " * 4000, "foglio 1 " * 800, "pratica " + "a/" * 4000, "A" * 8000, "Rossi di " * 900, "1." * 4000, "a@" * 3000]
    docs = spark.createDataFrame([("k", str(i), 1, t) for i, t in enumerate(texts)], "dossier_id string, doc_id string, arrival long, text string")
    begin = time.time()
    detect.rule_spans(docs).count()
    assert time.time() - begin < 30


def test_span_resolution_by_brute_force(spark):
    import random

    rng = random.Random(11)
    rows, want, pairs = [], set(), set()
    for d in range(40):
        mine = []
        for i in range(rng.randrange(0, 15)):
            start = rng.randrange(60)
            mine.append((start, start + rng.randrange(1, 9), rng.choice(["CF", "EMAIL", "DATA", "PERSONA"]), f"{d}:{i:02}"))
        rows += [("k", str(d), s, a, b, c, "v") for a, b, c, s in mine]
        kept = []
        for a, b, c, s in sorted(mine, key=lambda x: (detect.PRIORITY[x[2]], x[0] - x[1], x[0], x[3])):
            if all(b <= x or y <= a for x, y in kept):
                kept.append((a, b))
                want.add(s)
        pairs |= {(x[3], y[3]) for x in mine for y in mine if x[3] < y[3] and x[0] < y[1] and y[0] < x[1]}
    spans = spark.createDataFrame(rows, "dossier_id string, doc_id string, span_id string, start int, end int, category string, value string")
    assert {r.span_id for r in detect.resolve_spans(spans).collect()} == want
    assert {(r.span_a, r.span_b) for r in detect.span_overlaps(spans).collect()} == pairs


def test_span_resolution_is_greedy(spark):
    spans = spark.createDataFrame([("k", "d", "a", 0, 10, "AZIENDA", "v"), ("k", "d", "b", 5, 8, "CF", "v"), ("k", "d", "c", 8, 12, "PERSONA", "v"), ("k", "d", "e", 10, 12, "PERSONA", "v")], "dossier_id string, doc_id string, span_id string, start int, end int, category string, value string")
    assert sorted(r.span_id for r in detect.resolve_spans(spans).collect()) == ["b", "c"]


def test_merges_in_order(spark):
    tags = spark.createDataFrame([("k", f"[PERSONA_{i}]", "PERSONA", i, f"v{i}", 0, "NOT_FOUND", [], i) for i in (1, 2, 3)], "dossier_id string, tag string, category string, idx long, value string, occurrences long, status string, variants array<string>, pos long")
    steps = spark.createDataFrame([("k", 1, "[PERSONA_2]", "[PERSONA_1]"), ("k", 2, "[PERSONA_2]", "[PERSONA_3]"), ("k", 3, "[PERSONA_1]", "[PERSONA_3]")], "dossier_id string, seq long, tag_a string, tag_b string")
    assert [(r.tag, r.variants) for r in merging.apply_merges_in_order(tags, steps).collect()] == [("[PERSONA_1]", ["v2", "v3"])]
    assert {r.tag: r.variants for r in merging.apply_merges(tags, steps.filter("seq = 1")).collect()} == {"[PERSONA_1]": ["v2"], "[PERSONA_3]": []}


def test_exposure(spark):
    kinds = [("[PERSONA_1]", "PERSONA", 2), ("[IMPORTO_1]", "IMPORTO", 3), ("[CF_1]", "CF", 1), ("[DATA_1]", "DATA", 0)]
    tags = spark.createDataFrame([("k", t, c, 1, "v", n, "APPLIED" if n else "NOT_FOUND", [], 1) for t, c, n in kinds], "dossier_id string, tag string, category string, idx long, value string, occurrences long, status string, variants array<string>, pos long")
    off = spark.createDataFrame([("k", c, False) for c in ("PERSONA", "IMPORTO", "CF")], "dossier_id string, category string, enabled boolean")
    assert review.exposure(tags, off).first()[1:] == (6, 0)
    assert [r.category for r in review.exposure_by_category(tags, off).orderBy("place").collect()] == ["IMPORTO", "PERSONA", "CF"]
    assert review.exposure(tags, off.filter("category = 'IMPORTO'")).first()[1:] == (3, 3)


def test_existing_placeholders(spark):
    docs = spark.createDataFrame([("k", "d", "[IBAN_2] e poi [PERSONA_10]"), ("k", "e", "[persona_1] e [PERSONA] e [1_PERSONA]")], "dossier_id string, doc_id string, text string")
    assert [(r.position, r.placeholder) for r in review.existing_placeholders(docs).orderBy("seq").collect()] == [(0, "[IBAN_2]"), (15, "[PERSONA_10]")]


def test_digest(spark):
    import hashlib

    rows = [("k", "b.txt", "d1", "zwei"), ("k", "a.txt", "d3", "ü"), ("k", "a.txt", "d2", "x")]
    want = hashlib.sha256("a.txt\n1\nxa.txt\n1\nüb.txt\n4\nzwei".encode()).hexdigest()
    assert review.approval_digest(spark.createDataFrame(rows, "dossier_id string, filename string, doc_id string, masked string")).first().digest == want


def test_state(spark):
    def run(*events):
        rows = [("k", i, e, f"h{i}") for i, e in enumerate(events)]
        return tuple(state.replay_state(spark.createDataFrame(rows, "dossier_id string, seq long, event string, digest string")).first()[1:])

    assert run("approve") == ("DRAFT", None, 1)
    assert run("analysed", "approve") == ("APPROVED", "h1", 0)
    assert run("analysed", "approve", "mutation") == ("PENDING_REVIEW", None, 0)
    assert run("analysed", "approve", "analysed") == ("PENDING_REVIEW", "h1", 0)
    assert run("analysed", "approve", "approve", "clear") == ("DRAFT", None, 0)


def test_admission(spark):
    rows = [("k", f"d{i}", i, f"f{i % 11 if i != 3 else 2}") for i in range(13)]
    docs = spark.createDataFrame(rows, "dossier_id string, doc_id string, arrival long, filename string")
    got = {r.doc_id: r.verdict for r in ingest.admit_documents(docs).collect()}
    assert got["d3"] == "DuplicateFilename" and got["d10"] == "OK" and got["d11"] == "DossierFull" and got["d12"] == "DossierFull"


def test_files(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "good.txt").write_bytes("è".encode())
    (tmp_path / "k" / "bad.txt").write_bytes(b"ab\xe8")
    rows = {r.filename: r for r in ingest.decode_text(ingest.fingerprint(ingest.read_raw_documents(spark, str(tmp_path)))).collect()}
    assert rows["good.txt"].text == "è" and rows["good.txt"].dossier_id == "k"
    assert rows["bad.txt"].error == "InvalidEncoding" and rows["bad.txt"].error_detail == "2"
    (tmp_path / "k" / "bad.txt").write_bytes(b" \n")
    assert {r.answer_id: r.verdict for r in ingest.read_answers(spark, str(tmp_path)).collect()} == {"good.txt": None, "bad.txt": "EMPTY"}


def test_responses(spark):
    good = '[{"valore": "Mario", "categoria": "PERSONA", "x": 1}]'
    raws = ["[]", "no", "3", "{}", '["ciao"]', '[{"valore": "a", "categoria": "PERSONE"}]', '[{"categoria": "PERSONA"}]', '[{"valore": 42, "categoria": "PERSONA"}]', good]
    raw = spark.createDataFrame([("k", str(i), i, r) for i, r in enumerate(raws)], "dossier_id string, doc_id string, arrival long, raw string")
    assert [r.valid for r in responses.response_verdicts(raw).orderBy("arrival").collect()] == [True, *[False] * 7, True]
    assert [(r.value, r.category) for r in responses.parse_responses(raw).collect()] == [("Mario", "PERSONA")]


WHOLE = {"vault_version": 4, "fascicolo_id": "k", "documents": [], "tags": [{"tag": "[CF_1]", "categoria": "CF", "valore": "x", "occorrenze": 2, "stato": "APPLICATO", "varianti": []}], "fusioni": [], "analizzati": [], "category_enabled": {"CF": True}, "state": "DRAFT", "approval_hash": None, "counters": {"CF": 1}}


def test_vault(spark):
    import json

    without = lambda key: {k: v for k, v in WHOLE.items() if k != key}
    tag = lambda **more: WHOLE | {"tags": [WHOLE["tags"][0] | more]}
    cases = {"k": (WHOLE, None), "old": (WHOLE | {"vault_version": 3}, "VAULT_VERSION"), "new": (WHOLE | {"vault_version": 5}, "VAULT_VERSION")}
    spoiled = [WHOLE | {"vault_version": True}, WHOLE | {"vault_version": "4"}, WHOLE | {"state": "OPEN"}, tag(stato="APPLIED"), tag(categoria="PERSONE"), WHOLE | {"counters": {"X": 1}}, tag(occorrenze=None), [], "x"]
    cases |= {f"s{i}": (x, "VAULT_UNREADABLE") for i, x in enumerate([*spoiled, *map(without, WHOLE)])}
    jsons = spark.createDataFrame([(k, json.dumps(x)) for k, (x, _) in cases.items()] + [("no", "not json")], "dossier_id string, json string")
    blobs = vault.write_vault(jsons, "prova", rounds=10).cache()
    opened = vault.read_vault(blobs, "prova")
    assert {r.dossier_id: r.error for r in opened.collect()} == {k: e for k, (_, e) in cases.items()} | {"no": "VAULT_UNREADABLE"}
    assert [tuple(r) for r in vault.opened_tags(opened).collect()] == [("k", "[CF_1]", "CF", 1, "x", 2, "APPLIED", [], 1)]
    assert {r.error for r in vault.read_vault(blobs, "falsa").collect()} == {"VAULT_UNREADABLE"}
    good = blobs.filter("dossier_id = 'k'")
    part = lambda a, n=None: f"substring(blob, {a}{'' if n is None else f', {n}'})"
    for blob in (part(1, 36), part(1, 3), "cast('' as binary)", "cast(null as binary)", f"concat({part(1, 4)}, unhex('FFFFFFFF'), {part(9)})", f"concat({part(1, 4)}, unhex('00000000'), {part(9)})", f"concat(unhex('00'), {part(2)})", "substring(blob, 1, length(blob) - 1)"):
        assert [r.error for r in vault.read_vault(good.withColumn("blob", F.expr(blob)), "prova").collect()] == ["VAULT_UNREADABLE"], blob


@pytest.mark.parametrize("text,image,verdict", [("x" * 50, 1.0, False), ("", 1.0, True), ("", 0.0, False), ("x" * 6, 0.9, True), ("x" * 6, 0.09, False)])
def test_page_verdict(spark, text, image, verdict):
    pages = spark.createDataFrame([("k", "d", 1, text, image, 1.0)], "dossier_id string, doc_id string, page_no int, text string, image_area double, page_area double")
    assert ingest.page_verdicts(pages).first().scan is verdict


def test_every_street_word_begins_an_address(spark):
    docs = spark.createDataFrame([("d", str(i), i, f"Abita in {w} Roma 3, dal 2020.") for i, w in enumerate(detect.STREETS)], "dossier_id string, doc_id string, arrival long, text string")
    found = {r.doc_id: r.value for r in detect.rule_spans(docs, ("INDIRIZZO",)).collect()}
    assert found == {str(i): f"{w} Roma 3" for i, w in enumerate(detect.STREETS)}
    assert {"piazzale", "localita", "località"} <= set(detect.STREETS)


def test_texts_with_the_scanner_s_marks(spark):
    """Places are those of the pattern run by itself, whether or not a text holds the characters that mark matches."""
    texts = ["a@b.it \ue100 c@d.it", "\ue101x@y.it\ue100", "x@y.it", "", "no", "🙂 a@b.it,c@d.it"]
    docs = spark.createDataFrame([("d", str(i), i, t) for i, t in enumerate(texts)], "dossier_id string, doc_id string, arrival long, text string")
    for r in detect.rule_spans(docs, ("EMAIL",)).collect():
        assert texts[int(r.doc_id)][r.start : r.end] == r.value
    assert detect.rule_spans(docs, ("EMAIL",)).count() == 6


def test_guards_lose_no_match(spark):
    """Every match of a category's pattern in the rule tests' texts passes its guard."""
    docs = spark.createDataFrame([("d", str(i), i, t) for i, t in enumerate([
        "Foglio 12 part. 3 sub 4; fg. 1 mapp. 22", "pratica n. A/12 prot 9 Rif. 7", "tel. 06 1234567, cell 333 1234567, +39 02-12345678", "P.IVA 12345678903", "IT60X0542811101000000123456",
        "12/03/2024, 2024-01-02, 3 maggio 1990", "€ 12,50 e EUR 1.000 e 30 euro", "RSSMRA85M01H501Q", "Rossi s.r.l., Bianchi & Figli SPA, Neri S.n.c. Verdi sas Blu s.c.a.r.l."])], "dossier_id string, doc_id string, arrival long, text string")
    guarded = {(r.doc_id, r.start, r.category) for r in detect.rule_spans(docs).collect()}
    before = dict(detect.GUARDS)
    detect.GUARDS.clear()
    try:
        plain = {(r.doc_id, r.start, r.category) for r in detect.rule_spans(docs).collect()}
    finally:
        detect.GUARDS.update(before)
    assert guarded == plain and {c for _, _, c in plain} >= {"CATASTO", "PRATICA", "TELEFONO", "PIVA", "IBAN", "DATA", "IMPORTO", "CF", "AZIENDA"}


def test_many_overlapping_spans_of_one_document(spark):
    spans = spark.range(100_000).select(F.lit("d").alias("dossier_id"), F.lit("x").alias("doc_id"), F.col("id").cast("string").alias("span_id"), F.col("id").cast("int").alias("start"), (F.col("id") + 10).cast("int").alias("end"), F.lit("DATA").alias("category"), F.lit("v").alias("value"))
    assert {r.start for r in detect.resolve_spans(spans).collect()} == set(range(0, 100_000, 10))
