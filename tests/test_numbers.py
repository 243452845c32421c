"""Numbers and dates in words against an independent generator."""

import random

from pyspark.sql import functions as F

from tagmask.functions import numbers
from tagmask.operators import detect

UNITS = "zero uno due tre quattro cinque sei sette otto nove dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove".split()


def spoken(n):
    """Italian words by recursion, without accents and elision of cento."""
    if n < 20:
        return UNITS[n]
    if n < 100:
        ten = "venti trenta quaranta cinquanta sessanta settanta ottanta novanta".split()[n // 10 - 2]
        return ten if n % 10 == 0 else (ten[:-1] if n % 10 in (1, 8) else ten) + UNITS[n % 10]
    for size, one, many in ((1_000_000, "un milione", " milioni"), (1000, "mille", "mila"), (100, "cento", "cento")):
        if n >= size:
            head = one if n // size == 1 else spoken(n // size) + many
            rest = "" if n % size == 0 else (" " if size > 1000 else "") + spoken(n % size)
            return head + rest


def test_numbers_both_ways(spark):
    random.seed(9)
    values = [*range(3000), *(random.randrange(10 ** random.randint(3, 9)) for _ in range(6000)), *(a * 1000 + b for a in (1, 8, 21, 80, 100, 101, 108, 880, 999) for b in (0, 1, 8, 80, 180, 999)), 999_999_999, 1_000_000, 1_000_001, 21_000_000]
    table = spark.createDataFrame([(n, spoken(n)) for n in values], "n long, words string").repartition(4)
    own = numbers.number_in_words(F.col("n"))
    rows = table.select("n", "words", own.alias("own"), numbers.words_to_number(F.col("words")).alias("a"), numbers.words_to_number(own).alias("b"), numbers.words_to_number(F.upper(F.regexp_replace(own, " ", ""))).alias("c")).collect()
    assert all(r.n == r.a == r.b == r.c for r in rows)
    assert all(r.own.replace("é", "e").replace("centott", "centoott") == r.words for r in rows)


def test_words_that_say_no_number(spark):
    bad = ["", "e", "unodue", "ventitrenta", "centocento", "milamila", "mila", "milione", "duemille", "zerouno", "uno zero", "dieciuno", "trecentoduecento", "duemilatremila", "rossi", "duex", "mille mille", None]
    rows = spark.createDataFrame([(w,) for w in bad], "w string").select(numbers.words_to_number(F.col("w")).alias("n")).collect()
    assert [r.n for r in rows] == [None] * len(bad)
    good = {"mille e uno": 1001, "Duemila e trecento": 2300, "ventunmila": 21_000, "centootto": 108, "centotto": 108, "un milione e duecentomila": 1_200_000, "ventitré": 23, "VENTITRE": 23}
    rows = spark.createDataFrame(list(good.items()), "w string, n long").select("n", numbers.words_to_number(F.col("w")).alias("m")).collect()
    assert all(r.n == r.m for r in rows)


def spans_of(spark, text):
    docs = spark.createDataFrame([("d", "x", 1, text)], "dossier_id string, doc_id string, arrival long, text string")
    return docs, sorted((r.start, r.category, r.value) for r in detect.word_spans(docs).collect())


def test_word_spans(spark):
    text = "Canone di € 14.400,00 (quattordicimilaquattrocento/00), nato il 14/05/1980, quattordici maggio millenovecentottanta; euro duecento; tre amici, sei case, mille euro; dal primo marzo 2020; 3 giugno duemilauno; trentuno febbraio duemila; 500 (cinquecento)"
    docs, found = spans_of(spark, text)
    assert [(c, v) for _, c, v in found] == [
        ("IMPORTO", "quattordicimilaquattrocento/00"), ("DATA", "quattordici maggio millenovecentottanta"), ("IMPORTO", "euro duecento"), ("IMPORTO", "mille euro"),
        ("DATA", "primo marzo 2020"), ("DATA", "3 giugno duemilauno"), ("IMPORTO", "cinquecento")]
    assert all(text[s : s + len(v)] == v for s, _, v in found)
    both = {(r.category, r.key): r.forms for r in detect.two_forms(detect.rule_spans(docs, ("IMPORTO", "DATA")).unionByName(detect.word_spans(docs))).collect()}
    assert both == {("IMPORTO", "1440000"): ["quattordicimilaquattrocento/00", "€ 14.400,00"], ("DATA", "1980-05-14"): ["14/05/1980", "quattordici maggio millenovecentottanta"]}
    values = {(r.category, r.value) for r in detect.rule_detector()(docs).collect()}
    assert {(c, v) for _, c, v in found} <= values and ("IMPORTO", "€ 14.400,00") in values


def test_words_without_a_sign_of_an_amount_stay(spark):
    assert spans_of(spark, "due amici e tre case, venti maggio, mille grazie")[1] == []
    assert spans_of(spark, None)[1] == [] and spans_of(spark, "")[1] == []
