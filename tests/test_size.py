"""What a job leaves on disk and works out twice: plans of dossiers that are kept, and their rows."""

import json
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tagmask.operators import anchors, masking
from tagmask.plans import derived, queries
from tagmask.sources import ingest, vault
from tagmask.sources.scratch import kept, scratch
from tagmask.streaming import jobs, keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detections_in_one_pass_are_those_of_the_sql(spark):
    found = derived.register(spark, entry.SMOKE_DIR, "detections")["detections"]
    stated = spark.sql(derived.SQL["detections"])
    assert found.schema == stated.schema and plan(found).count("orders.parquet") == 1 < plan(stated).count("orders.parquet")
    assert found.exceptAll(stated).isEmpty() and stated.exceptAll(found).isEmpty() and not found.isEmpty()


def test_kept_dossiers_are_not_shuffled_again(spark):
    """analysis, masking and segments of letters that are kept by dossier join and group where they are."""
    docs, tags, switches = queries._counted(spark, entry.SMOKE_DIR)
    found = derived.register(spark, entry.SMOKE_DIR, "letters", "detections", keep=True)
    for df in (masking.mask_documents(docs, tags), masking.segments(docs, tags, switches), masking.analyse(found["letters"], found["detections"])):
        assert "Exchange" not in plan(df).replace("BroadcastExchange", "")


def test_claims_are_worked_out_once(spark):
    """no filter that Spark infers of an explode works out the claims again."""
    docs, tags, switches = queries._counted(spark, entry.SMOKE_DIR)
    for df in (masking.claimed_tags(docs, masking.spellings(tags)), masking.claimed_regions(docs, masking.writings(tags)), masking.segments(docs, tags, switches)):
        assert not [line for line in plan(df).splitlines() if "Filter" in line and "aggregate(" in line]


class Store(dict):
    """A state store that counts its calls."""

    calls = 0

    def getValueState(self, name, schema):
        return One(self, name)

    def getMapState(self, name, key, value):
        return One(self, name)


class One:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def get(self):
        return self.getValue("")

    def update(self, value):
        self.updateValue("", value)

    def getValue(self, key):
        self.store.calls += 1
        return self.store.get((self.name, key))

    def updateValue(self, key, value):
        self.store.calls += 1
        self.store[self.name, key] = value


def test_a_small_dossier_is_read_and_written_once(spark):
    """two calls of the state store a batch, however many values; larger dossiers lie in pieces of bounded size."""
    store, state = Store(), keyed.DossierState()
    state.init(store)
    row = lambda i, text, *values: Row(doc_id=f"d{i}", arrival=i, text=text, found=[{"det_seq": j, "category": "PERSONA", "value": v} for j, v in enumerate(values)])
    rows = {}
    for batch in range(3):
        for r in state.handleInputRows(("k",), iter([row(batch, "ab a b v1 v12", "a", "ab", f"v{batch}")]), None):
            rows[r[4]] = (r[1], r[5])
    assert store.calls == 6 and rows["ab"] == ("[PERSONA_1]", 3) and rows["a"] == ("[PERSONA_3]", 3) and rows["v1"] == ("[PERSONA_4]", 6) and rows["v2"] == ("[PERSONA_5]", 0)
    n = 2 * keyed.PIECE + 5
    for i in range(n):
        rows |= {r[4]: (r[1], r[5]) for r in state.handleInputRows(("k",), iter([row(1000 + i, f"x{i:06d} ab", f"x{i:06d}")]), None)}
    assert rows["ab"][1] == n + 3 and all(rows[f"x{i:06d}"][1] == 1 for i in range(n))
    assert all(len(v) <= keyed.PIECE for (name, _), (said,) in store.items() for v in ([json.loads(said)] if name == "pieces" else [d[1] for d in json.loads(said).values() if isinstance(d, list)]))
    before = store.calls
    assert not list(state.handleInputRows(("k",), iter([row(1000, "ab", "zz")]), None)) and store.calls > before


def test_batches_leave_nothing_kept(spark):
    """F7, F8, F12: what a batch of a stream keeps for itself goes with it; each batch has as many files as there are cores."""
    path = scratch(spark)
    folder = path.removeprefix("file://").rsplit("/", 1)[0]
    rows = spark.range(40).select(F.lit("d").alias("dossier_id"), F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("v1 e v2 "), F.col("id").cast("string")).alias("text"))
    tags = kept(spark.createDataFrame([("d", f"[IBAN_{i}]", "IBAN", i, f"v{i}", 0, "NOT_FOUND", [], i) for i in (1, 2)], "dossier_id string, tag string, category string, idx long, value string, occurrences long, status string, variants array<string>, pos long"))
    stream = jobs.incoming(spark, rows, path)
    before = set(os.listdir(folder))
    keyed.stream_mask_batches(stream, lambda version: tags, lambda: 0, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    assert set(os.listdir(folder)) == before and len(os.listdir(f"{path.removeprefix('file://')}/out/rows")) == 3
    assert {r.masked for r in spark.read.parquet(f"{path}/out/rows").collect()} == {f"[IBAN_1] e [IBAN_2] {i}" for i in range(40)}


def test_whole_strings_are_found_by_key(spark):
    """of texts that share every short run with other strings, only the strings that they hold are candidates."""
    strings = spark.range(3000).select(F.lit("d").alias("dossier_id"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0"), F.when(F.col("id") % 3 == 0, "x" * 300).otherwise("")).alias("writing"))
    strings = strings.unionByName(spark.createDataFrame([("d", "éa"), ("e", "Customer#000000002")], "dossier_id string, writing string"))
    docs = spark.createDataFrame([("d", "1", "Customer#000000001 e Customer#000000003" + "x" * 300), ("d", "2", "éa"), ("d", "3", None), ("e", "4", "Customer#000000001"), ("d", "5", "")], "dossier_id string, doc_id string, text string")
    got = {r.doc_id: set(r._found) for r in anchors.candidates(docs, kept(strings), "writing", "dossier_id", F.col("writing")).collect()}
    assert got == {"1": {"Customer#000000001", "Customer#000000003" + "x" * 300}, "2": {"éa"}}


def test_rare_lengths_go_by_the_next_shorter_one(spark, monkeypatch):
    monkeypatch.setattr(anchors, "LENGTHS", 3)
    words = ["abc", *(f"ab{i:03d}" for i in range(40)), *(f"abc{i:05d}" for i in range(30)), "abc0000", "abcdefghij", "abcd"]
    strings = kept(spark.createDataFrame([("d", w) for w in words], "dossier_id string, writing string"))
    assert anchors.lengths_of(strings, "writing") == [3, 5, 8]
    docs = spark.createDataFrame([("d", w, f"-{w}-") for w in words], "dossier_id string, doc_id string, text string")
    got = {r.doc_id: set(r._found) for r in anchors.candidates(docs, strings, "writing", "dossier_id", F.col("writing")).collect()}
    assert all(v in got[w] for w in words for v in words if v in w)


def test_files_are_listed_and_read_in_tasks(spark, tmp_path):
    """no plan holds the names of the files; folders of any depth, hidden files, files over the cap, blanks in names."""
    for name, data in {"k/a.txt": b"uno", "k/_hidden": b"x", "k/.crc": b"x", "k/l/b c.txt": b"\xff", "k/l/big": b"x" * 100, "empty/none": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        raw = ingest.read_raw_documents(spark, path, cap=50)
        assert "FileScan" not in plan(raw)
        assert {(r.dossier_id, r.filename, r.length, bytes(r.content)) for r in raw.collect()} == {("k", "a.txt", 3, b"uno"), ("l", "b c.txt", 1, b"\xff"), ("empty", "none", 0, b"")}
    assert ingest.read_raw_documents(spark, str(tmp_path)).count() == 4


def test_vaults_are_sealed_where_their_dossier_is(spark):
    """without `spread` neither texts nor vaults are shuffled."""
    jsons = kept(spark.createDataFrame([("d", "{}")], "dossier_id string, json string"))
    sealed = vault.write_vault(jsons, "x", rounds=1, spread=False)
    assert "Exchange" not in plan(vault.read_vault(sealed, "x", spread=False)) and "Exchange" in plan(vault.write_vault(jsons, "x", rounds=1))
    assert vault.read_vault(sealed, "x", spread=False).first().error == "VAULT_UNREADABLE"
