"""Detectors: text to (value, category), and spans from rules.

A detector is a function DataFrame -> DataFrame: (dossier_id, doc_id, arrival, text) to (dossier_id, doc_id, arrival,
det_seq, value, category). Every value is a literal part of the text; one that is not becomes NOT_FOUND later.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tagmask.functions.numbers import AMOUNT_WORDS, DATE_WORDS, form_key
from tagmask.functions.text import CF_SHAPE, MONTHS, date_exists, has_context, iban_valid, phone_plausible, tax_code_valid, vat_number_valid
from tagmask.model import PRIORITY
from tagmask.operators.masking import with_writings


def _any(*words: str) -> str:
    return "(?:" + "|".join(words) + ")"


# --- the parts that the rules name, put together to patterns in Java's syntax -----------------------------------------------
#: Kinds of streets and their usual short forms, initials of company forms.
STREETS = ("via", "viale", "piazza", "piazzale", "corso", "largo", "vicolo", "strada", "contrada", "località", "localita", "borgo", "salita", "lungomare", "v.le", "p.zza", "p.za", "c.so", "l.go", "str.", "loc.")
COMPANY_FORMS = ("srl", "spa", "snc", "sas", "scarl")
#: What may stand between the capitalised words of a name (articles and prepositions), and the prepositions and
#: articles that grow together (da + lla).
LINKS, ROOTS, ENDINGS = ("di", "da", "e", "ed", "il", "lo", "la", "le", "l'", "d'"), ("a", "da", "de", "su"), ("l", "i", "gli", "llo", "lla", "lle", "ll'")

#: A link with what separates it from the next word: blanks, or nothing after an apostrophe.
_LINK = _any(*(w if w.endswith("'") else w + r"\s+" for w in (*LINKS, *(root + end for root in ROOTS for end in ENDINGS))))
#: A capitalised word (or a capital and a full stop), and a run of them with links before and between.
_CAPITAL = r"\p{Lu}(?:[\p{L}'’]+|\.)?"
_RUN = rf"(?:{_LINK}){{0,2}}{_CAPITAL}(?:\s+(?:{_LINK}){{0,2}}{_CAPITAL}){{0,4}}"
_FIRM = r"\p{Lu}[\p{L}\d'’&.]*"
_FIRM_RUN = rf"{_FIRM}(?:\s+(?:&\s+|{_LINK}){{0,2}}{_FIRM}){{0,4}}?"
#: A house number never begins a longer number, so it leaves a postal code whole.
_HOUSE = r"(?:,?\s*(?:n[.°]?\s*)?\d{1,4}(?!\d)(?:/?[A-Za-z]\b)?)?"
_POSTAL = r"(?:\s*[,-]?\s*\d{5}(?!\d))?"
#: What may stand between a keyword and its number: blanks, full stop or colon, and a word for "number".
_LABEL = r"[\s.:]*(?:n(?:umero|r|ro)?\b[\s.°:]*)?"
_SHEET, _PARCEL = _any("foglio", "fogl", "fg"), _any("particella", "part", "mappale", "mapp")
_FILE = _any("pratica", "fascicolo", "protocollo", "prot", "riferimento", "rif")
#: Digits after a prefix, each with at most one separator before it, never cut inside a longer number.
_digits_of = lambda least, most: rf"(?:[ ./-]?\d){{{least},{most}}}(?!\d)"
_MONTH = _any(*MONTHS)
_DAY, _CURRENCY = r"\d{1,2}", "(?i:eur|euro)"
_AMOUNT = r"(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?"

#: The pattern of each category; a match is the whole span.
PATTERNS = {
    "CF": rf"\b{CF_SHAPE}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}(?:\s?[0-9A-Z]){11,30}\b",
    "PIVA": r"\b(?:IT)?\d{11}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "TELEFONO": _any(r"(?:\+|\b00)39" + _digits_of(9, 10), r"\b3\d\d" + _digits_of(6, 7), r"\b0\d{1,3}" + _digits_of(6, 8)),
    "CATASTO": rf"(?is)\b{_SHEET}\b{_LABEL}\d{{1,4}}\b.{{0,40}}?\b{_PARCEL}\b{_LABEL}\d{{1,5}}\b(?:[\s,;]*\bsub(?:alterno)?\b{_LABEL}\d{{1,4}}\b)?",
    "PRATICA": rf"(?i)\b{_FILE}\b{_LABEL}(?=[a-z/._-]*\d)[a-z0-9]{{1,20}}(?:[/._-][a-z0-9]{{1,20}}){{0,5}}",
    "DATA": rf"(?i)\b(?:{_DAY}[/.-]{_DAY}[/.-]\d{{4}}|\d{{4}}-\d\d-\d\d|{_DAY}\s+{_MONTH}\s+\d{{4}})\b",
    "IMPORTO": _any(rf"(?<!\w)(?:€|{_CURRENCY}\b)\s?{_AMOUNT}(?![.,]?\d)", rf"(?<![\w.,]){_AMOUNT}\s?(?:€|{_CURRENCY}\b)"),
    "INDIRIZZO": rf"\b(?i:{_any(*(w.replace('.', chr(92) + '.') for w in STREETS))})\s+{_RUN}{_HOUSE}{_POSTAL}",
    "AZIENDA": rf"\b{_FIRM_RUN}\s+(?i:{_any(*(''.join(c + '[.]?' for c in form) for form in COMPANY_FORMS))})(?!\w)",
}


#: What a text must have for a category's pattern to be tried: cheap to find, and part of every match.
GUARDS = {
    "EMAIL": "@", "CATASTO": "(?i)f(?:oglio|ogl|g)", "PRATICA": rf"(?i){_FILE}", "TELEFONO": r"\d[ ./-]?\d[ ./-]?\d", "PIVA": r"\d{11}", "IBAN": r"[A-Z]{2}\d{2}",
    "DATA": r"\d{4}", "IMPORTO": rf"€|{_CURRENCY}", "CF": r"[A-Z]{6}", "AZIENDA": "(?i)s[.]?(?:r[.]?l|p[.]?a|n[.]?c|a[.]?s|c[.]?a[.]?r)",
}
#: Marks of a match's start and end in a scanned text.
_START, _STOP = "\ue100", "\ue101"


def _with_places(pattern: str) -> Column:
    """All matches in `text` as structs of start (in code points) and value. The pattern runs once: it puts a mark around every
    match, and the marked text is cut there. Texts that hold a mark themselves are split and searched."""
    split = F.zip_with(F.split("text", pattern), F.regexp_extract_all("text", F.lit(f"({pattern})"), 1), lambda gap, value: F.struct(gap.alias("g"), value.alias("v")))
    marked = F.split(F.regexp_replace("text", f"({pattern})", f"{_STOP}$1{_START}"), _START)
    # Each part is a gap, and but for the last the match behind it.
    cut = F.transform(marked, lambda part: F.struct(F.substring_index(part, _STOP, 1).alias("g"), F.when(F.contains(part, F.lit(_STOP)), F.substring_index(part, _STOP, -1)).alias("v")))
    sides = F.when(F.col("text").rlike(f"[{_START}-{_STOP}]"), split).otherwise(cut)

    def step(acc: Column, side: Column) -> Column:
        start = acc["at"] + F.length(side["g"])
        return F.struct((start + F.length(side["v"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), side["v"].alias("value")))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))
    return F.aggregate(F.filter(sides, lambda side: side["v"].isNotNull()), zero, step)["out"]


@F.pandas_udf(T.StringType())
def _iban_part(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The longest beginning, cut at a blank, that is an IBAN; null if none is."""

    def valid(code: str) -> bool:
        code = "".join(code.split()).upper()
        if not 15 <= len(code) <= 34:
            return False
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1

    def longest(text: str | None) -> str | None:
        while text:
            if valid(text):
                return text
            text = text.rstrip()
            cut = max((i for i, c in enumerate(text) if c.isspace()), default=0)
            text = text[:cut]
        return None

    for series in values:
        yield series.map(longest)


def rule_spans(docs: DataFrame, categories=tuple(PATTERNS)) -> DataFrame:
    """Spans of all rule categories, checked: dossier_id, doc_id, span_id, start, end, category, value.

    Overlaps stay (see resolve_spans). A PRATICA needs a digit behind its keyword and covers the keyword. The text is scanned
    in one projection; numbers that need an announcement are tested there, so no text goes on with a span.
    """

    def spans_of(category: str) -> Column:
        found = _with_places(PATTERNS[category])
        if category in ("PIVA", "TELEFONO"):
            found = F.filter(found, lambda s: has_context(F.col("text"), s["start"], s["value"], F.lit(category)))
        found = F.transform(found, lambda s: F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["value"].alias("value")))
        return F.when(F.col("text").rlike(GUARDS[category]), found) if category in GUARDS else found

    spans = docs.select("dossier_id", "doc_id", F.explode(F.flatten(F.array_compact(F.array(*map(spans_of, categories))))).alias("s")).select("dossier_id", "doc_id", "s.*")
    value = F.col("value")
    if "IBAN" in categories:
        spans = spans.withColumn("_iban", _iban_part(F.when(F.col("category") == "IBAN", value)))
        spans = spans.withColumn("value", F.when(F.col("category") == "IBAN", F.col("_iban")).otherwise(value)).drop("_iban")
    valid = F.when(F.col("category") == "CF", tax_code_valid(value)).when(F.col("category") == "PIVA", vat_number_valid(value))
    valid = valid.when(F.col("category") == "DATA", date_exists(value)).when(F.col("category") == "TELEFONO", phone_plausible(value)).otherwise(value.isNotNull())
    end = F.col("start") + F.length("value")
    span_id = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), "category")
    return spans.filter(valid).select("dossier_id", "doc_id", span_id.alias("span_id"), "start", end.alias("end"), "category", "value")


def word_spans(docs: DataFrame) -> DataFrame:
    """Spans of amounts and dates written in words, as rule_spans has those in digits; a text often says both, and each is a
    value of its own. Words that say no number, and days that there never were, go."""
    one = lambda pattern, category: F.transform(_with_places(pattern), lambda s: F.struct(F.lit(category).alias("category"), s["start"].alias("start"), s["value"].alias("value")))
    both = F.concat(one(AMOUNT_WORDS, "IMPORTO"), F.coalesce(F.when(F.col("text").rlike(f"(?i){_MONTH}"), one(DATE_WORDS, "DATA")), F.array().cast("array<struct<category:string,start:int,value:string>>")))
    spans = docs.select("dossier_id", "doc_id", F.explode(both).alias("s")).select("dossier_id", "doc_id", "s.*")
    end = F.col("start") + F.length("value")
    span_id = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), "category")
    return spans.filter(form_key(F.col("category"), F.col("value")).isNotNull()).select("dossier_id", "doc_id", span_id.alias("span_id"), "start", end.alias("end"), "category", "value")


def two_forms(spans: DataFrame) -> DataFrame:
    """Amounts and dates that a dossier writes in more than one way: dossier_id, category, key (cents, or the ISO day), forms.
    Masking one form only would leave the value to be read from the other."""
    keyed = spans.withColumn("key", form_key(F.col("category"), F.col("value"))).filter(F.col("key").isNotNull())
    return keyed.groupBy("dossier_id", "category", "key").agg(F.array_sort(F.collect_set("value")).alias("forms")).filter(F.size("forms") > 1)


def valid_ibans(values: DataFrame) -> DataFrame:
    return values.withColumn("valid", iban_valid(F.col("value")))


def _islands(spans: DataFrame) -> DataFrame:
    """Spans with `_island`: numbers, per document, of stretches that no span crosses. Overlaps lie inside one."""
    by_start = Window.partitionBy("dossier_id", "doc_id").orderBy("start", "end", "span_id")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col("start") < reached, 0).otherwise(1))
    return opened.withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


_CHOSEN = T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "end") else T.StringType()) for n in ("span_id", "start", "end", "category", "value")])


@F.pandas_udf(T.ArrayType(_CHOSEN))
def _strongest(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of spans in order of strength those that overlap no stronger one: the taken intervals stay sorted, so each span meets
    only its two neighbours."""

    def choose(spans: list[dict]) -> list[dict]:
        starts, ends, chosen = [], [], []
        for span in spans:
            start, end = span["start"], span["end"]
            at = bisect_left(ends, start + 1)  # the first taken interval that ends behind the start
            if at < len(starts) and starts[at] < end:
                continue
            starts.insert(at, start)
            ends.insert(at, end)
            chosen.append({k: span[k] for k in _CHOSEN.names})
        return chosen

    for series in lists:
        yield series.map(choose)


def resolve_spans(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of a document the stronger: priority of the category, then longer, earlier, span_id."""
    rank = F.element_at(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))]), F.col("category"))
    entry = F.struct(rank.alias("p"), (F.col("start") - F.col("end")).alias("l"), F.col("start").cast("int").alias("start"), F.col("span_id").cast("string").alias("span_id"), F.col("end").cast("int").alias("end"), "category", "value")
    lists = spans.groupBy("dossier_id", "doc_id").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return lists.select("dossier_id", "doc_id", F.explode(_strongest("s")).alias("x")).select("dossier_id", "doc_id", "x.*")


def span_overlaps(spans: DataFrame) -> DataFrame:
    """Pairs of spans of one document that share a character: doc_id, span_a, span_b (the earlier id first)."""
    # Empty spans share no character and do not count for the stretches.
    placed = _islands(spans.filter("start < end"))
    other = placed.select("dossier_id", "doc_id", "_island", F.col("span_id").alias("span_b"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    joined = placed.join(other, ["dossier_id", "doc_id", "_island"]).filter((F.col("span_id") < F.col("span_b")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")))
    return joined.select("dossier_id", "doc_id", F.col("span_id").alias("span_a"), "span_b")


def spans_to_detections(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans as detections, in order of their start."""
    placed = spans.drop("value").join(docs.select("dossier_id", "doc_id", "arrival", "text"), ["dossier_id", "doc_id"])
    seq = F.row_number().over(Window.partitionBy("dossier_id", "doc_id").orderBy("start", "end")) - 1
    return placed.select("dossier_id", "doc_id", "arrival", seq.alias("det_seq"), F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("value"), "category")


def validate_manual_spans(manual: DataFrame, docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Manual spans (dossier_id, doc_id, span_id, start, end) with verdict OK, NO_DOCUMENT, RANGE or OVERLAP."""
    sized = manual.join(docs.select("dossier_id", "doc_id", F.length("text").alias("_n")), ["dossier_id", "doc_id"], "left")
    taken = spans.groupBy("dossier_id", "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_o"))
    joined = sized.join(taken, ["dossier_id", "doc_id"], "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n"))
    clash = F.coalesce(F.exists("_o", lambda o: (F.col("start") < o["end"]) & (o["start"] < F.col("end"))), F.lit(False))
    verdict = F.when(F.col("_n").isNull(), "NO_DOCUMENT").when(~inside, "RANGE").when(clash, "OVERLAP").otherwise("OK")
    return joined.select(*manual.columns, verdict.alias("verdict"))


def rule_detector(categories=tuple(PATTERNS)) -> Callable[[DataFrame], DataFrame]:
    """A detector of resolved rule spans; amounts and dates in words are among them where their categories are."""

    def detect(docs: DataFrame) -> DataFrame:
        spans, worded = rule_spans(docs, categories), [c for c in ("IMPORTO", "DATA") if c in categories]
        if worded:
            spans = spans.unionByName(word_spans(docs).filter(F.col("category").isin(*worded)))
        return spans_to_detections(resolve_spans(spans), docs)

    return detect


def lookup_detector(values: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A detector that answers from a table (dossier_id, value, category): what the text contains literally, by value and
    category. Texts meet values as they meet writings (see masking.with_writings)."""

    def detect(docs: DataFrame) -> DataFrame:
        order = Window.partitionBy("dossier_id").orderBy("value", "category")
        known = values.select("dossier_id", "value", "category").filter(F.col("value").isNotNull()).distinct()
        listed = known.select("dossier_id", F.row_number().over(order).alias("rank"), F.col("value").alias("writing"), F.col("category").alias("tag"))
        found = with_writings(docs, listed)
        return found.select("dossier_id", "doc_id", "arrival", F.posexplode_outer("_ws").alias("det_seq", "v")).filter("v is not null").select("dossier_id", "doc_id", "arrival", "det_seq", F.col("v.writing").alias("value"), F.col("v.tag").alias("category"))

    return detect


def union_detections(docs: DataFrame, *detectors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All detectors' findings; of one document those of earlier detectors come first."""
    out = None
    for i, detector in enumerate(detectors):
        found = detector(docs).withColumn("det_seq", F.col("det_seq").cast("long") + F.lit(i) * (1 << 32))
        out = found if out is None else out.unionByName(found)
    return out


def with_manual_values(detections: DataFrame, manual: DataFrame) -> DataFrame:
    """Reviewers' values (dossier_id, value, category) as detections that come after all others."""
    late = manual.select("dossier_id", F.lit(None).cast(detections.schema["doc_id"].dataType).alias("doc_id"), F.lit((1 << 62) - 1).alias("arrival"), F.lit(0).cast("long").alias("det_seq"), "value", "category")
    return detections.select("dossier_id", "doc_id", F.col("arrival").cast("long"), F.col("det_seq").cast("long"), "value", "category").unionByName(late)
