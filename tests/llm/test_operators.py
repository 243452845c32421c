"""Training-data operators on small tables: odd rows, brute force, round trips."""

import base64
import hashlib
import random
import signal
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagmask.llm import language_id, media, mixing, near_dup, packing, search, token_store, tokenise, toxicity, url_reputation, warc
from tagmask.llm.common import attach, new_path, read

DIR = "/root/testdata/sf0.001"
ALONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]&&\p{L}"
WORDS = regex.compile(rf"[{ALONE}]|[[\p{{L}}\p{{M}}\p{{N}}]--[{ALONE}]]+", regex.V1)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


def table(spark, *texts):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", 0, 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_rows(spark):
    """Null, empty and very long texts, ties, repeated rows, null ids and columns with names that clash."""
    docs = table(spark, None, "", "a b c", "a b c", "The cat and the dog " * 3000, "!!! ???", "ünï çödé 中文 🙂", "loser idiot", "\n\t")
    repeated = docs.filter("doc_id = 2").unionByName(spark.createDataFrame([(None, "no id here at all today", None, None, None, None, None)], SCHEMA))
    return docs.unionByName(repeated)


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, DIR, "documents").cache()


# --- mixing --------------------------------------------------------------------------------------------------------------
def test_mix_reaches_targets(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        per[r.source] = [per[r.source][0] + r.taken, r.target, max(per[r.source][2], r.size)]
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken - target) <= longest for taken, target, longest in per.values())
    assert abs(sum(t for _, t, _ in per.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()))


def test_mix_odd_rows(spark):
    rows = mixing.mix_sources(odd_rows(spark)).collect()
    assert len(rows) == 11 and {r.size for r in rows if r.doc_id in (0, 1, 8)} == {0}
    assert mixing.mix_sources(odd_rows(spark).limit(0)).count() == 0
    taken = mixing.take_mix(odd_rows(spark))
    assert taken.columns == odd_rows(spark).columns and taken.count() == sum(r.copies for r in rows)


def test_mix_keeps_columns_and_rows_without_id(spark):
    """Columns under the names that the operator uses inside stay; a third of rows without an id still meets its target."""
    rows = [(None if i % 3 == 0 else i, f"{'w ' * (i % 7 + 1)}t{i}", "s" if i % 3 == 0 else "t", i, -i, i * 2, 7, 8, 9) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _h long, _n long, h long, whole long, threshold long, c0 long")
    taken = mixing.take_mix(docs, weights=(1,), share=0.8)
    assert taken.columns == docs.columns
    assert {tuple(r) for r in taken.collect()} <= set(rows)
    sums = mixing.mix_sources(docs, weights=(1,), share=0.8).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("size").alias("most")).collect()
    assert len(sums) == 2 and all(abs(r.n - r.t) <= r.most for r in sums)


def test_smaller_budgets_are_nested(spark, docs):
    picked = [{r.doc_id for r in mixing.mix_sources(docs, share=s).collect() if r.copies >= 1} for s in (0.3, 0.5, 0.8)]
    assert picked[0] <= picked[1] <= picked[2]


def test_attach_salts_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("tagmask.llm.common.BROADCAST_ROWS", 3)
    left = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("k"), "id")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(8)] + [(None, "none")], "k long, v string")
    got = attach(left, right, ["k"], "id").groupBy("v").count().collect()
    want = Counter("none" if i % 3 == 0 else (f"v{i % 10}" if i % 10 < 8 else None) for i in range(20_000))
    assert {r.v: r["count"] for r in got} == dict(want)


# --- urls ----------------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?q", "https://example.com/en/", "http://a.net/es/1", "http://b.org/x", "http://x.com", "nothing", None, "http://sub.example.com/en/a#b", "http://co.com/é"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    none = spark.createDataFrame([], "page_id long, good int")
    rows = {r.page_id: r for r in url_reputation.filter_urls(pages, none).collect()}
    assert [rows[i].rule for i in range(9)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, "example.com/en/", "com/"]
    assert [rows[i].verdict for i in (0, 1, 2, 7, 8)] == ["allow", "block", "block", "block", "allow"]
    assert (rows[5].host, rows[5].path, rows[6].host) == ("", "", "") and (rows[0].host, rows[0].path) == ("www.example.com", "/en/x")
    assert url_reputation.filter_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 4}.good.org/") for i in range(40)] + [(100 + i, f"http://h{i % 4}.bad.org/") for i in range(40)] + [(200, "http://new.good.org/"), (201, "http://new.bad.org/")], "page_id long, url string")
    good = spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 140)]], "page_id long, good int")
    rows = {r.page_id: r for r in url_reputation.filter_urls(pages, good).collect()}
    assert rows[200].verdict == "allow" and rows[201].verdict == "block" and rows[0].reputation >= rows[200].reputation


def test_suffix_table(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.y.pref.jp:80",), ("y.org",), ("",)], "host string")
    table = spark.createDataFrame([("co.uk",), ("pref.jp",), ("y.pref.jp",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in url_reputation.with_domains(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.pref.jp:80": ("x.y.pref.jp", "y.pref.jp"), "y.org": ("y.org", "org"), "": ("", "")}


# --- language and toxicity -----------------------------------------------------------------------------------------------
def test_language(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    model = language_id.train_languages(docs)
    odd = {(r.doc_id, r.text): r for r in language_id.identify(odd_rows(spark).withColumn("lang_pred", F.lit(1)), model).collect()}
    assert len(odd) == 10 and all(odd[k].lang_pred == "und" and odd[k].lang_score == 0 for k in [(0, None), (1, ""), (5, "!!! ???"), (8, "\n\t")])
    nothing = language_id.train_languages(docs.limit(0))
    assert language_id.identify(odd_rows(spark), nothing).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(docs.limit(0), model).count() == 0


def test_language_filter_has_no_false_negatives():
    codes = np.arange(5000, dtype=np.uint64) * 7919
    language = np.arange(5000) % 70
    model = language_id.LanguageFilter.of([f"l{i:02}" for i in range(70)], codes, language, slots=1 << 15)
    slots = [(language_id.mix(codes, k) % np.uint64(len(model.masks))).astype(int) for k in range(model.hashes)]
    for word in (0, 1):
        mask = np.bitwise_and.reduce([model.masks[s, word] for s in slots])
        own = language // 64 == word
        assert ((mask[own] >> (language[own] % 64).astype(np.uint64)) & np.uint64(1)).all()


def test_language_by_brute_force(spark, docs):
    """Corrected counts gram by gram, each language's bit looked up by itself."""
    model = language_id.train_languages(docs, kept=200)
    texts = [r.text for r in docs.select("text").limit(40).collect()] + ["", None, "le 5 “mot”", "x", "中文"]
    lang, score, known = model.judge(toxicity.as_text(pa.array(texts, pa.string()), lower=True))
    for i, text in enumerate(texts):
        data = regex.sub(r"[^\p{L}\p{M}]+", lambda m: " " if m.start() else "", (text or "").lower()).encode()
        hits, total = [0] * len(model.languages), 0
        for size in model.sizes:
            for at in range(len(data) - size + 1):
                code, total = np.array([int.from_bytes(bytes([size]) + data[at : at + size])], np.uint64), total + 1
                slots = [int(language_id.mix(code, k)[0] % np.uint64(len(model.masks))) for k in range(model.hashes)]
                for one in range(len(model.languages)):
                    hits[one] += all(int(model.masks[slot, one // 64]) >> one % 64 & 1 for slot in slots)
        right = [max(0, (h - total * f) / (1 - f)) for h, f in zip(hits, model.false_rate, strict=True)]
        assert np.isclose(known[i], max(right) / total if total else 0)
        assert np.isclose(score[i], max(right) / sum(right) if sum(right) else 0)
        assert not sum(right) or right[model.languages.index(lang[i])] == max(right)


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr("tagmask.llm.common.BROADCAST_ROWS", 20)
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * 5, f"l{i:03}") for i in range(300)]
    model = language_id.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:03}" for i in range(300)]


def test_toxicity(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    scored = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    rows = scored.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted for r in rows if not r.toxic) == 0
    assert sum(r.predicted for r in rows if r.toxic) >= 0.5 * sum(r.toxic for r in rows)
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    odd = model.score(odd_rows(spark))
    assert odd.count() == 11 and odd.filter("toxicity < 0 or toxicity > 1").count() == 0
    one_class = toxicity.fit_toxicity(docs, labels.withColumn("toxic", F.lit(0)))
    assert one_class.score(docs).filter("predicted = 1").count() == 0


def plain_features(lexicon, text):
    """The twelve features of one text, word by word."""
    low = (text or "").lower()
    words, original = WORDS.findall(low), text or ""
    hashes = [toxicity._word_hash((w,))[0] for w in words]
    begin = []
    for w in words:
        data = w.encode()
        block = toxicity.Hashes(np.frombuffer(data, np.uint8))
        begin.append(any(len(data) > n and block.of(np.array([0]), np.array([n]), seed=n)[0] in lexicon.begins for n in toxicity.BEGINNINGS))
    is_word = [h in lexicon.words for h in hashes]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    hits = [i for i in range(len(words)) if is_word[i] or begin[i]]
    letter = [bool(regex.match(r"[\p{L}\p{M}]", c)) for c in low]
    masked = sum(c in "*@$#%0123456789" and 0 < i < len(low) - 1 and letter[i - 1] and letter[i + 1] for i, c in enumerate(low))
    upper = ["A" <= c <= "Z" for c in original]
    letters = max(1, sum(bool(regex.match(r"[\p{L}\p{M}]", c)) for c in original))
    total, size = max(1, len(words)), max(1, len(low.encode()))
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in hits)
    punctuation = sum(33 <= ord(c) < 127 and not c.isalnum() for c in low)
    return [len(hits), sum(is_word) / total, sum(begin) / total, len(you) / total, near, sum(upper) / letters, sum(a and b for a, b in zip(upper, upper[1:], strict=False)) / letters, punctuation / size, sum(c in "!?" for c in low) / total, masked / total, sum(c in "0123456789" for c in low) / size, np.log1p(len(words))]


ENDS = ["some words w5", "xyz more words here", "hello W", "Xyz", "5", "", None, "i*", "*diot", "YOU ID1OT!?", "“Loser” — é5é", "A", "BCD", "中文 you 文", "u" * 50 + " l0ser 9"]


def test_features_by_brute_force():
    """All features, beside any neighbours: texts that begin and end in digits, capitals and signs."""
    lexicon = toxicity.Lexicon(toxicity._word_hash(("loser", "diot", "文")), toxicity.Hashes(np.frombuffer(b"id1o", np.uint8)).of(np.array([0]), np.array([4]), seed=4))
    rng = random.Random(3)
    texts = [rng.choice(ENDS) for _ in range(300)]
    got = lexicon.features(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_features(lexicon, t) for t in texts])


def test_scores_do_not_depend_on_neighbours(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit_toxicity(docs, labels)
    rng = random.Random(4)
    rows = [(i, rng.choice(ENDS), 0.5, 1.0, 2, 3) for i in range(400)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, prediction double, rawPrediction double, _features int, _f_hits int")
    seen = [sorted((r.doc_id, r.toxicity, r.prediction, r._features) for r in model.score(odd.repartition(n)).collect()) for n in (1, 4, 37)]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 400 and {x[2:] for x in seen[0]} == {(0.5, 2)}
    of_text = {}
    for (i, toxic, *_), row in zip(seen[0], rows, strict=True):
        assert of_text.setdefault(row[1] or "", toxic) == toxic


def test_features_see_whole_texts():
    lexicon = toxicity.Lexicon(toxicity._word_hash(("loser",)), np.zeros(0, np.uint64))
    text = pa.array(["word " * 500_000 + "you are a LOSER", "", None])
    hits = dict(zip(toxicity.FEATURES, lexicon.features(text)[0], strict=True))
    assert hits["hits"] == 1 and hits["second_near"] == 1 and hits["shouted"] > 0
    assert lexicon.features(text)[1:].sum() == 0


# --- near duplicates -----------------------------------------------------------------------------------------------------
def brute_classes(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        words = WORDS.findall((t or "").lower())
        n = min(5, len(words))
        sets[d] = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((sets[a] & sets[b]).values())
            every = sum((sets[a] | sets[b]).values())
            if both >= threshold * every - 1e-9:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.random()}"
    return " ".join(out)


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randrange(0, 8)) for _ in range(120)] + [" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(60)]
    texts += [texts[0].upper(), "a, b", "A B", "", None, "! !", "one"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "PICKED_IDS", 3)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate(edited(rng, base, rng.randrange(1, 8)) for _ in range(90)))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_odd_rows(spark):
    rows = near_dup.near_duplicates(odd_rows(spark)).collect()
    assert len(rows) == 11
    left = near_dup.drop_near_duplicates(odd_rows(spark))
    assert left.columns == odd_rows(spark).columns and left.count() == 6
    assert near_dup.near_duplicates(odd_rows(spark).limit(0)).count() == 0


def test_near_duplicates_of_rows_with_one_id(spark):
    """Rows that share an id, or have none, but differ in text: each belongs to the class of its own text."""
    rng = random.Random(8)
    base = [[f"t{k}w{rng.randrange(300)}" for _ in range(60)] for k in range(6)]
    texts = [edited(rng, base[i % 6], rng.randrange(0, 3)) for i in range(36)] + [f"alone {i} among all of them" for i in range(12)]
    ids = [None if i % 3 == 0 else i % 10 for i in range(len(texts))]
    rows = [*zip(ids, texts, strict=True), (ids[7], texts[7]), (None, texts[0]), (2, None), (None, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute_classes(enumerate(t for _, t in rows)).values())
    got = near_dup.near_duplicates(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert sorted(Counter(r.class_id for r in got).values()) == sorted(want.values())
    left = [(r.doc_id, r.text) for r in near_dup.drop_near_duplicates(docs).collect()]
    classes = brute_classes(enumerate(t for _, t in rows))
    of_text = {t: classes[i] for i, (_, t) in enumerate(rows)}
    assert set(left) <= set(rows) and sorted(of_text[t] for _, t in left) == sorted(want)


def test_near_duplicates_beyond_ascii(spark):
    """Quotes and dashes are no words; of scripts without blanks every character is one."""
    words = "the quick brown fox jumps over a lazy dog and then it runs far away from here to the sea".split()
    quoted = "“" + " ".join(words[:9]) + "” — " + " … ".join(words[9:])
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈"
    rows = list(enumerate([" ".join(words), quoted, chinese, chinese + "剑", chinese[::-1], "ünï “çödé” 中文"]))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}


def test_near_duplicates_weigh_repeats(spark):
    """How often a shingle occurs counts: long runs of one line against texts with few of them."""
    line = "one line that comes again and again "
    rows = list(enumerate([line * 40, line * 45, line * 10, line * 11, line * 44 + "end", "other words than those of the line above it " * 3]))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and got[1] == got[4] == 0 and got[2] == got[3] == 2


def test_strips_estimate_the_similarity_of_counts():
    rng = np.random.default_rng(3)
    sets = []
    times = rng.integers(1, 12, 200)
    for t in (times, np.where(rng.random(200) < 0.6, times, rng.integers(1, 12, 200))):
        region, doc, low, width, weight = near_dup.strips(np.repeat(np.arange(200, dtype=np.uint64), t), np.zeros(t.sum(), int))
        assert (np.minimum(width, weight - low).sum(), len(region)) == (t.sum(), (1 + np.ceil(np.log2(t))).sum())
        sets.append((t, near_dup.dart_signature(region, doc, 1, 2000, low, width, weight)[0]))
    true = np.minimum(sets[0][0], sets[1][0]).sum() / np.maximum(sets[0][0], sets[1][0]).sum()
    assert abs((sets[0][1] == sets[1][1]).mean() - true) < 0.05


def test_dart_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    element = np.arange(400, dtype=np.uint64)
    weights = [rng.uniform(0.1, 5, 400), None]
    weights[1] = np.where(rng.random(400) < 0.7, weights[0], rng.uniform(0.1, 5, 400))
    true = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    signs = []
    for w in weights:
        level = np.concatenate([[0], 2.0 ** np.arange(0, 3)])  # strips 0-1, 1-2, 2-4, 4-8
        low, width = np.tile(level, 400), np.tile(np.array([1, 1, 2, 4.0]), 400)
        weight, region = np.repeat(w, 4), near_dup.mix(np.repeat(element, 4) ^ near_dup.mix(np.tile(np.arange(4), 400), 3), 4)
        on = low < weight
        signs.append(near_dup.dart_signature(region[on], np.zeros(on.sum(), int), 1, 2000, low[on], width[on], weight[on])[0])
    assert abs((signs[0] == signs[1]).mean() - true) < 0.05


# --- tokens --------------------------------------------------------------------------------------------------------------
PARTS = ["'s", "'re", "'", "''", " ", "  ", "\n", "a", "b", "é", "É", "1", "22", "!", "'ll", " '", "'t", " ", "é", "İ", "Σ", "ΑΣ", "中", "🙂", "'S", "\t", "<|endoftext|>", "ﬁ", "½", "_", "\x85", "\x00", "abcdefghijklmnopqrstu", "<|startoftext|>", "<|end", "\u00a0"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_library(name, docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [r.text for r in docs.select("text").collect()]
    texts += ["a <|endoftext|> b", "A<|startoftext|>B", "<|endoftext|>" * 3, "ÀB <|endoftext|>\n c"]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    encode, got = tokenise.Encoder(public_tokenizers.path(name)), []
    for _, ids, offsets in encode.encode([*texts, None]):
        got += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] + [[]]


def test_more_pieces_than_are_remembered(monkeypatch):
    monkeypatch.setattr(tokenise.Remembered, "SLOTS", 64)

    def late(*_):
        raise TimeoutError("the table of pieces never takes them all")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(20)
    try:
        path = public_tokenizers.path("byte_bpe_50k.json")
        texts = [" ".join(map(str, range(3000))), "1 2 3", " ".join(map(str, range(2000, 4000)))] * 2
        encode, got = tokenise.Encoder(path), []
        for text in texts:
            got += [ids.tolist() for _, ids, _ in encode.encode([text])]
        assert encode.known.used <= 32
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 300_001):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.int64)
        shard = token_store.WaveletMatrix(token_store.encode_shard(ids, np.arange(1), np.array([n])))
        assert (shard.decode() == ids).all()
        for at in rng.integers(0, n, 20) if n else []:
            assert shard.access(int(at)) == ids[at]
            places = np.flatnonzero(ids == ids[at])
            assert shard.count(int(ids[at])) == len(places) and shard.count(int(ids[at]), 0, int(at)) == (places < at).sum()
            assert shard.occurrence(int(ids[at]), len(places) // 2) == places[len(places) // 2]
            assert shard.occurrence(int(ids[at]), len(places)) == -1
    broken = bytearray(token_store.encode_shard(np.arange(10), np.arange(1), np.array([10])))
    broken[30] ^= 1
    with pytest.raises(ValueError):
        token_store.WaveletMatrix(bytes(broken))


def test_token_store_round_trip(spark):
    path = new_path(spark, "tokens")
    files = token_store.write_shards(odd_rows(spark), path, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=50)
    rows = token_store.read_shards(files, path).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in odd_rows(spark).collect()), key=lambda r: (r[0], r[1] or 0))
    start = 0
    for row, (_, doc_id, text) in zip(rows, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc_id, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = token_store.write_shards(odd_rows(spark).limit(0), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_store.read_shards(empty, path).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------------
def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_fullest_combination_by_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        room = rng.randint(1, 30)
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
        table = [counts.get(i, 0) for i in range(31)]
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.fullest(table, sorted(counts, reverse=True), room)
        assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= room)
        assert all(v <= counts[k] for k, v in chosen.items())


def test_packing(spark):
    rng = random.Random(8)
    lengths = [rng.choice([64, 64, 64, *range(1, 65)]) for _ in range(2000)]
    pieces = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)], "doc_id long, piece int, length long").withColumn("start", F.lit(0))
    rows = packing.pack(pieces, 64).collect()
    bins = []  # best fit decreasing, for comparison
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, used in enumerate(bins) if used + n <= 64]
        if fitting:
            bins[max(fitting, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    assert len(rows) == 2000 and check_packing(rows, 64) <= len(bins)


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(odd_rows(spark), public_tokenizers.path("word_bpe_49k.json"), 1000).collect()
    check_packing(rows, 1000)
    assert Counter(r.doc_id for r in rows)[4] == 16 and [r.length for r in rows if r.doc_id in (0, 1, 8)] == [1, 1, 1]
    assert packing.pack_documents(odd_rows(spark).limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_pieces_are_those_of_the_library(spark, docs):
    """start, length and ids_crc32 of every piece, on whole texts with special strings among them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    some = docs.select("doc_id", "text").unionByName(odd_rows(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    some = some.unionByName(spark.createDataFrame([(-1, "a <|endoftext|> b"), (-2, "<|startoftext|>" * 5000)], "doc_id long, text string"))
    library, want = Tokenizer.from_file(path), Counter()
    for r in some.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r.doc_id, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = packing.pack_documents(some, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 4096)


# --- media and archives --------------------------------------------------------------------------------------------------
def test_interleaving():
    html = "<p>One &amp; two<img src='a.png' alt='A'>three</p><script>x<img src=no></script><figure><img src='b'><video src='c'></video><figcaption>cap <b>tion</b></figcaption></figure>end"
    got = [(s["kind"], s["text"] or s["source"], s["caption"]) for s in media.interleave(html)]
    assert got == [("text", "One & two", None), ("media", "a.png", "A"), ("text", "three", None), ("media", "b", "cap tion"), ("media", "c", "cap tion"), ("text", "end", None)]
    short = lambda html: [(s["kind"], s["text"] or s["source"], s["caption"]) for s in media.interleave(html)]
    assert short("<html><head><title>x</title><body><p>hello") == [("text", "hello", None)]
    assert short("<head><title>x</title><noscript><img src=n></noscript><p>a<noscript><img src=m>t</noscript><template><img src=o></template>b") == [("text", "ab", None)]
    assert short("<figure><figcaption>first</figcaption><img src=a></figure>t") == [("media", "a", "first"), ("text", "t", None)]
    assert short("a<figure>x<figcaption>alone</figcaption></figure>b") == [("text", "a", None), ("text", "x", None), ("text", "alone", None), ("text", "b", None)]
    assert short("<figure><img src=a alt=k><figcaption>open <p>caption</figure>then") == [("media", "a", "open caption"), ("text", "then", None)]
    assert short("<figure><img src=a><figcaption>never closed") == [("media", "a", "never closed")]
    assert short("<head>words</head>") == [("text", "words", None)] and short("<p>a</noscript>b</figure></figcaption>c") == [("text", "ab", None), ("text", "c", None)]
    assert short("<picture><source srcset='a 1x, b 2x'><img srcset=' ,c.png, d 2x'></picture><img srcset=' '>") == [("media", "a", None), ("media", "c.png", None)]
    assert media.interleave(None) == [] and [s["position"] for s in media.interleave(html)] == list(range(6))


def test_media_round_trip(spark):
    for payload in (b"", b"a", bytes(64), "é\n# 5\n".encode() * 99):
        n, padded = media.samples(media.graymap(payload))
        assert padded[:n] == payload and len(padded) % 64 == 0 and padded and not any(padded[n:])
    stored = media.store_media(odd_rows(spark), new_path(spark, "media"))
    pages = stored.select("doc_id", F.concat(F.lit('<img src="sha256:'), "media_sha256", F.lit('"><img src="sha256:none">')).alias("html"))
    rows = media.resolve_media(media.parse_sequences(pages), media.media_features(stored)).collect()
    assert len(rows) == 22 and sum(r.feature is None for r in rows) == 11
    sizes = {r.doc_id: r.n_bytes for r in rows if r.position == 0}
    assert sizes[0] == 0 and sizes[6] == len("ünï çödé 中文 🙂".encode())
    assert len({r.feature for r in rows if r.position == 0 and r.doc_id in (2, 3)}) == 1


def test_media_query_by_brute_force(spark, docs):
    rows = {r.doc_id: r for r in media.op3_media_columns(spark, DIR).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        data = (text or "").encode()
        padded = data + bytes(64 - len(data) % 64 if len(data) % 64 or not data else 0)
        columns = [sum(padded[i::64]) for i in range(64)]
        mean = sum(padded) / len(padded)
        spread = (sum((x - mean) ** 2 for x in padded) / len(padded)) ** 0.5
        r = rows[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.graymap(data)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        above = "".join("1" if c * 64 > sum(columns) else "0" for c in columns)
        name, got_mean, got_spread = r.feature.split(":")
        assert f"{int(name, 16):064b}" == above and abs(float(got_mean) - mean) < 1e-3 and abs(float(got_spread) - spread) < 1e-3


def test_loser_tree():
    rng = random.Random(9)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_run_files(tmp_path):
    from pyarrow import fs

    rng, store = random.Random(10), fs.LocalFileSystem()
    rows = sorted((f"k{rng.randrange(40):02}", "t", "a", i, None if i % 7 == 0 else i, "response") for i in range(3000))
    for n in (0, 1, 256, 257, 3000):
        assert warc.write_run(store, f"{tmp_path}/{n}", rows[:n]) == n and list(warc.read_run(store, f"{tmp_path}/{n}")) == rows[:n]
        for low, high in [((), ("k20",)), (("k20",), ("k21",)), (rows[999][:4], rows[1500][:4]), (("k99",), None), (("k05", "t", "a", 3), None)]:
            assert list(warc.read_run(store, f"{tmp_path}/{n}", low, high)) == [r for r in rows[:n] if r[:4] >= low and (high is None or r[:4] < high)]


def test_merging_in_passes(spark, monkeypatch):
    """More runs than a tree takes at once, several ranges, one URL with a third of all captures."""
    for name, value in (("ARCHIVE_ENTRIES", 20), ("FAN_IN", 3), ("RUN_BLOCK", 4)):
        monkeypatch.setattr(warc, name, value)
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97)).alias("url"), F.lit("x").alias("html"))
    path = new_path(spark, "warc")
    runs = warc.write_archives(pages.repartition(5), path)
    assert runs.count() >= 30
    rows = warc.merge_runs(runs, path, entries=100).orderBy("capture_order").collect()
    keys = [(r.url_key, r.time, r.archive, r.offset) for r in rows]
    assert keys == sorted(keys) and [r.capture_order for r in rows] == list(range(600)) and sorted(r.page_id for r in rows) == list(range(600))


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20)
    monkeypatch.setattr(warc, "MERGED_TOGETHER", 3)
    pages = [(5, "http://b.org/x", "same é"), (2, "http://a.org/y", "same é"), (2, "http://a.org/y", "same é"), (7, None, None), (8, "x y", ""), (None, "http://a.org/", "same é"), (9, "http://a.org/z?q#f", "other\r\n\r\nWARC/1.1")]
    rows = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).drop("refers_to"), new_path(spark, "warc")).collect()
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert got == Counter({(5, "revisit", 2, 7): 1, (2, "response", None, 7): 2, (7, "response", None, 0): 1, (8, "revisit", 7, 0): 1, (None, "response", None, 7): 1, (9, "response", None, 17): 1})
    assert {r.payload_digest for r in rows if r.page_id == 9} == {base64.b32encode(hashlib.sha1(b"other\r\n\r\nWARC/1.1").digest()).decode()}
    order = sorted(rows, key=lambda r: r.capture_order)
    assert [r.capture_order for r in order] == list(range(7)) and [r.url_key for r in order] == sorted(r.url_key for r in order)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), new_path(spark, "warc")).count() == 0


def test_index_of_the_given_pages_by_brute_force(spark, monkeypatch):
    """All pages and some of their copies, in many archives, against digests and a dictionary."""
    for name, value in (("ARCHIVE_ENTRIES", 40), ("FAN_IN", 4), ("RUN_BLOCK", 8), ("MERGED_TOGETHER", 100)):
        monkeypatch.setattr(warc, name, value)
    pages = read(spark, DIR, "pages").select("page_id", "url", "html")
    copies = pages.filter("page_id % 7 = 0").select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")
    pages = pages.unionByName(copies)
    given = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for page_id, _, payload in sorted(given):
        first.setdefault(payload, page_id)
    want = {}
    for page_id, _, payload in given:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        original = first[payload]
        want[page_id] = (len(payload), digest, "response" if original == page_id else "revisit", None if original == page_id else original)
    rows = warc.archive(pages.repartition(6), new_path(spark, "warc")).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want and len(rows) == len(given)
    assert any(kind == "revisit" for _, _, kind, _ in want.values())
    rows.sort(key=lambda r: r.capture_order)
    assert [r.capture_order for r in rows] == list(range(len(given)))
    keys = [(r.url_key, r.page_id) for r in rows]
    assert keys == sorted((warc.url_key(url), page_id) for page_id, url, _ in given)


def test_records_of_repeated_pages_have_ids_of_their_own():
    a, b = (next(warc.records(warc.record(3, "http://a.org/", b"x", None, place)))[1] for place in ("f:0", "f:9"))
    assert a["WARC-Record-ID"] != b["WARC-Record-ID"]
    _, headers, block = next(warc.records(warc.record(9, "http://a.org/", b"x", 3, "f:20")))
    assert headers["WARC-Type"] == "revisit" and headers["WARC-Refers-To-Date"] == a["WARC-Date"] and block.endswith(b"\r\n\r\n")


# --- search --------------------------------------------------------------------------------------------------------------
def brute_bm25(docs, query, k):
    counts = {d: Counter(WORDS.findall((t or "").lower())) for d, t in docs}
    size = {d: sum(c.values()) for d, c in counts.items()}
    average = max(1.0, sum(size.values()) / len(size))
    asked = Counter(WORDS.findall(query.lower()))
    score = Counter()
    for w, n in asked.items():
        df = sum(w in c for c in counts.values())
        for d, c in counts.items():
            if c[w]:
                score[d] += n * np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / average))
    return sorted((round(-s, 6), d) for d, s in score.items())[:k]


def test_search_by_brute_force(spark, docs, monkeypatch):
    for name, value in (("BLOCK_DOCS", 4), ("SHARD_DOCS", 30), ("LEAST_TERMS", 500), ("MOST_TERMS", 500), ("SHARD_GROUP", 3), ("FREQUENT", 20), ("SCORED", 300)):
        monkeypatch.setattr(search, name, value)
    rows = docs.select("doc_id", "text").collect()
    asked = [r for r in rows if r.doc_id % 20 == 0]
    got = defaultdict(list)
    for r in search.search(docs.repartition(3), docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((round(-r.score, 6), r.doc_id))
    for r in asked:
        want = brute_bm25([tuple(x) for x in rows], r.text, 10)
        assert len(got[r.doc_id]) == len(want) and np.allclose([s for s, _ in got[r.doc_id]], [s for s, _ in want], rtol=1e-9, atol=2e-6)
        # Ids too, but for the order of scores that differ by less than the rounding.
        near = lambda rows, s: {d for x, d in rows if abs(x - s) < 3e-6}
        last = want[-1][0]
        assert all(near(got[r.doc_id], s) == near(want, s) for s, _ in want if abs(s - last) >= 3e-6)


def test_search_prunes_and_stays_exact():
    """One shard with many documents: fewer documents are scored than hold a term, and none of the best is missed."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(5, 80)) if x < 4000) for _ in range(3000)]
    parts = list(search.term_counts(pa.array(texts, pa.large_string())))
    doc, term, times = (np.concatenate([p[i] + (p[0] if i == 1 else 0) for p in parts]) for i in (1, 2, 3))
    lengths, sizes = np.concatenate([p[4] for p in parts]), np.bincount(doc, minlength=3000)
    shard = search.Shard(search.invert_shard(search.unpack_arrays(search.gather_shard(np.arange(3000), lengths, sizes, term, times)), lengths.mean()))
    df = {t: n for t, n in zip(*np.unique(term, return_counts=True), strict=True)}
    scored = []
    whole = shard.scores
    shard.scores = lambda docs: scored.append(len(docs)) or whole(docs)
    asked = [np.flatnonzero(doc == q) for q in range(0, 3000, 100)]
    asked = [mine for mine in asked if len(mine)]
    weights = [times[mine] * np.log(1 + (3000 - np.array([df[t] for t in term[mine]]) + 0.5) / (np.array([df[t] for t in term[mine]]) + 0.5)) for mine in asked]
    terms, which = np.unique(np.concatenate([term[mine] for mine in asked]), return_inverse=True)
    lists = shard.lists(terms, which, np.cumsum([len(mine) for mine in asked]), np.concatenate(weights))
    for i, mine in enumerate(asked):
        want = np.zeros(3000)
        of = dict(zip(term[mine].tolist(), weights[i].tolist(), strict=True))
        use = np.flatnonzero(np.isin(term, term[mine]))
        norm = 1.2 * (0.25 + 0.75 * lengths / lengths.mean())
        np.add.at(want, doc[use], np.array([of[t] for t in term[use].tolist()]) * times[use] * 2.2 / (times[use] + norm[doc[use]]))
        order = np.lexsort((np.arange(3000), -np.round(want, 9)))[:10]
        order = order[want[order] > 0]
        # Nothing known before, and a bound known from documents searched before.
        for ids, best in ((np.zeros(0, np.int64), np.zeros(0)), (np.full(10, -1), np.full(10, np.sort(want)[-10] * 0.999))):
            ids, best = shard.search(lists, i, 10, ids, best)
            assert ids[: len(order)].tolist() == order.tolist() and np.allclose(best[: len(order)], want[order])
    assert np.mean(scored) < 100


@pytest.mark.parametrize("seed", range(4))
def test_search_with_ties_at_the_border_of_frequent_lists(seed, monkeypatch):
    """Families of near copies, so that lists tie in length where the frequent ones end, and queries' terms in any order."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(100):
        words = rng.integers(0, 1000, 100)
        texts += [" ".join(f"w{x}" for x in np.where(rng.random(100) < 0.02, rng.integers(0, 1000, 100), words)) for _ in range(12)]
    n = len(texts)
    parts = list(search.term_counts(pa.array(texts, pa.large_string())))
    doc, term, times = (np.concatenate([p[i] + (p[0] if i == 1 else 0) for p in parts]) for i in (1, 2, 3))
    lengths, sizes = np.concatenate([p[4] for p in parts]), np.bincount(doc, minlength=n)
    terms, code = np.unique(term, return_inverse=True)
    df = np.bincount(code)
    falling = np.sort(df)[::-1]
    monkeypatch.setattr(search, "FREQUENT", next(f for f in range(256, len(falling)) if falling[f - 1] == falling[f]))
    shard = search.Shard(search.invert_shard(search.unpack_arrays(search.gather_shard(np.arange(n), lengths, sizes, term, times)), lengths.mean()))
    gain = np.zeros((n, len(terms)))
    gain[doc, code] = times * 2.2 / (times + 1.2 * (0.25 + 0.75 * lengths / lengths.mean())[doc])
    asked = [rng.permutation(np.flatnonzero(doc == q)) for q in range(0, n, 7)]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = [times[mine] * idf[code[mine]] for mine in asked]
    distinct, which = np.unique(np.concatenate([term[mine] for mine in asked]), return_inverse=True)
    lists = shard.lists(distinct, which, np.cumsum([len(mine) for mine in asked]), np.concatenate(weights))
    for i, mine in enumerate(asked):
        want = gain[:, code[mine]] @ weights[i]
        order = np.lexsort((np.arange(n), -np.round(want, 9)))[:10]
        for ids, best in ((np.zeros(0, np.int64), np.zeros(0)), (np.full(10, -1), np.full(10, np.sort(want)[-10] * 0.999))):
            ids, best = shard.search(lists, i, 10, ids, best)
            # Scores that are equal but for the order of summing may change places.
            assert len(set(ids.tolist())) == 10 and np.allclose(best, want[order], rtol=1e-12) and np.allclose(want[ids], want[order], rtol=1e-12)


def test_search_by_slices_and_by_gathering(monkeypatch):
    """Whether lists and documents' terms are copied as slices or gathered, the same documents have the very same scores."""
    rng = np.random.default_rng(3)
    texts = ["", *(" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 2000) for _ in range(600))]
    parts = list(search.term_counts(pa.array(texts, pa.large_string())))
    doc, term, times = (np.concatenate([p[i] + (p[0] if i == 1 else 0) for p in parts]) for i in (1, 2, 3))
    lengths, n = np.concatenate([p[4] for p in parts]), len(texts)
    data = search.invert_shard(search.unpack_arrays(search.gather_shard(np.arange(n), lengths, np.bincount(doc, minlength=n), term, times)), lengths.mean())
    asked = [rng.permutation(np.flatnonzero(doc == q)) for q in range(0, n, 5)]
    distinct, which = np.unique(np.concatenate([term[mine] for mine in asked]), return_inverse=True)
    monkeypatch.setattr(search, "FREQUENT", 30)
    found = []
    for kept, few, scored in ((0, 0, 1_000_000), (20, 3, 300), (200, 10_000, 1_000_000), (4096, 64, 1_000_000)):
        for name, value in (("KEPT", kept), ("FEW", few), ("SCORED", scored)):
            monkeypatch.setattr(search, name, value)
        shard = search.Shard(data)
        lists = shard.lists(distinct, which, np.cumsum([len(mine) for mine in asked]), np.concatenate([times[mine] * 1.5 for mine in asked]))
        assert all((np.diff(lists.counts[a:b]) <= 0).all() for a, b in zip(lists.starts, lists.starts[1:]))
        first = [shard.search(lists, i, 10, np.zeros(0, np.int64), np.zeros(0)) for i in range(len(asked))]
        # Again under a bound known before, where the pivot leaves lists out.
        again = [shard.search(lists, i, 10, np.full(10, -1), np.full(10, best.min(initial=np.inf))) for i, (_, best) in enumerate(first)]
        assert not shard.asked.any() and not shard.weight.any()
        found.append([(ids.tolist(), best.tolist()) for ids, best in first + again])
    assert all(x == found[0] for x in found[1:]) and any(len(ids) == 10 for ids, _ in found[0])


def test_blocks_of_more_texts_than_a_shard_numbers(spark):
    """Very short texts: one block of bytes holds more of them than 16 bits number."""
    docs = spark.range(70_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 69_999, "needle x").otherwise("x").alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        hits = search.search(docs, spark.createDataFrame([(1, "needle x")], "query_id long, text string"), 3).orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r.doc_id for r in hits] == [69_999, 0, 1]


def test_search_odd_rows(spark):
    odd = odd_rows(spark).drop("score", "label")
    hits = search.search(odd, odd.filter("doc_id is not null").select(F.col("doc_id").alias("query_id"), "text")).collect()
    assert {r.query_id for r in hits} == {2, 3, 4, 6, 7}
    assert [r.doc_id for r in sorted(hits, key=lambda r: (r.query_id, r.rank)) if r.query_id == 3] == [2, 2, 3]
    assert search.search(odd.limit(0), odd.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
