"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

The items' words become the alphabet of one automaton. Documents are streamed through it word by word: the automaton keeps
the longest suffix read so far that occurs in an item, and wherever that is at least a window long, the window's words are
hit. States know the items that hold their window, so a hit names its items without another search.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import read
from tagmask.llm.vector_text import as_text, light

#: What lies between words of lower-cased text, as a class of ASCII characters; words are runs of all others.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text that is not lower-cased yet.
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window, and words of items that one automaton holds (its size bound: at most two states a word).
WINDOW, SHARD_WORDS = 10, 100_000
_FOUND = ("n_words", "spans", "items", "longest")
_SPANS = "array<struct<start:int,end:int>>"


class SuffixAutomaton:
    """All substrings of several word sequences; `marks` says which item's window a state's substring of a length is."""

    def __init__(self, items: Sequence[tuple[str, list[str]]], window: int):
        self.window, self.words = window, {}
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        n = np.uint64(max(1, len(self.words)))
        pairs = [np.array(c[:-1], np.uint64) * n + np.array(c[1:], np.uint64) for _, c in coded if len(c) > 1]
        #: Neighbouring words of items as first * number of words + second, sorted.
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.least = min((min(len(c), window) for _, c in coded), default=window)
        self._mark(coded)

    def _state(self, follow: dict[int, int], link: int, length: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, before: int, code: int) -> int:
        """The state of exactly `before` and `code`: that which follows, or a copy of it for the shorter substrings."""
        after = self.follow[before][code]
        if self.length[after] == self.length[before] + 1:
            return after
        copy = self._state(dict(self.follow[after]), self.link[after], self.length[before] + 1)
        self.link[after] = copy
        while before >= 0 and self.follow[before].get(code) == after:
            self.follow[before][code] = copy
            before = self.link[before]
        return copy

    def _extend(self, last: int, code: int) -> int:
        if code in self.follow[last]:
            return self._split(last, code)
        new = self._state({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and code not in self.follow[at]:
            self.follow[at][code] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, code)
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """`whole[state]`: items with the window that ends a match in the state; `short[state]`: (length, item) of items
        shorter than a window that end it."""
        window, whole, short = self.window, {}, {}
        for name, codes in coded:
            size, at = min(len(codes), window), 0
            for i, code in enumerate(codes):
                at = self.follow[at][code]
                while self.length[self.link[at]] >= size:
                    at = self.link[at]
                if i + 1 >= size:
                    (whole.setdefault(at, set()) if size == window else short.setdefault(at, set())).add((size, name))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: The state of a match's last `window` words, and the short items that end it, handed on along the links.
        self.anchor, self.short, none = [-1] * len(self.link), [()] * len(self.link), ()
        for state in order:
            above = self.link[state]
            if self.length[state] >= window:
                self.anchor[state] = state if self.length[above] < window else self.anchor[above]
            own = short.get(state)
            self.short[state] = tuple(sorted(own)) + self.short[above] if own else self.short[above] or none
        self.whole = {state: tuple(sorted(name for _, name in names)) for state, names in whole.items()}

    def search(self, codes: list[int]) -> Iterator[tuple[int, int, int, tuple[str, ...]]]:
        """(place, longest match that ends there, longest window that ends there, its items) wherever a window ends."""
        follow, link, length, window = self.follow, self.link, self.length, self.window
        state = matched = 0
        for place, code in enumerate(codes):
            while state and code not in follow[state]:
                state = link[state]
                matched = length[state]
            state = follow[state].get(code, 0)
            matched = matched + 1 if state else 0
            names, size = (), 0
            for n, name in self.short[state]:
                if n <= matched:
                    names, size = (*names, name), max(n, size)
            if matched >= window:
                names, size = (*self.whole[self.anchor[state]], *names), window
            if size:
                yield place, matched, size, names

    def runs(self, codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Start and end of stretches of words of one document that may hold a window: each pair of neighbours occurs in an item."""
        if not len(codes):
            return
        code = codes[:-1].astype(np.uint64) * np.uint64(max(1, len(self.words))) + codes[1:].astype(np.uint64)
        place = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        linked = (codes[:-1] >= 0) & (codes[1:] >= 0) & (doc[:-1] == doc[1:]) & ((self.pairs[place] == code) if len(self.pairs) else False)
        starts = np.flatnonzero(np.concatenate([[True], ~linked]))
        ends = np.concatenate([starts[1:], [len(codes)]])
        good = (ends - starts >= self.least) & (codes[starts] >= 0)
        yield from zip(starts[good].tolist(), ends[good].tolist(), strict=True)


def split_words(column: pa.Array, between: str) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (A-Z lower-cased) and the row of each. Lower-casing comes before the cast: Arrow's ASCII kernels
    give zero bytes for a slice that was cast."""
    parts = pc.split_pattern_regex(as_text(pc.ascii_lower(column)), between)
    words, rows = parts.flatten(), pc.list_parent_indices(parts)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), np.asarray(rows.filter(full))


def _searching(shared, keep: list[str], names: list[str]) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: SuffixAutomaton = shared.value
        known = pa.array(list(automaton.words), pa.large_string())
        for batch in light(batches):
            words, rows = split_words(batch.column("text"), BETWEEN)
            codes = np.asarray(pc.fill_null(pc.index_in(words, known), -1), np.int64)
            firsts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            longest = [0] * batch.num_rows
            for start, end in automaton.runs(codes, rows):
                row = int(rows[start])
                base = start - int(firsts[row])
                for place, matched, size, found in automaton.search(codes[start:end].tolist()):
                    longest[row] = max(longest[row], matched)
                    items[row].update(found)
                    first, last, own = base + place - size + 1, base + place + 1, spans[row]
                    while own and own[-1]["end"] >= first:
                        first = min(first, own.pop()["start"])
                    own.append({"start": first, "end": last})
            arrays = [
                pa.array(np.diff(firsts), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(s) for s in items], pa.list_(pa.string())), pa.array(longest, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *names])

    return search


def item_pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item, words) of distinct items, cut where they have over `most` windows; pieces overlap, so windows stay whole."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({WORD})"), 1)
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("_w")).filter(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)), F.lit(most))
    return named.select("item", F.explode(F.transform(starts, lambda i: F.slice("_w", i + 1, most + window - 1))).alias("words")).distinct()


def find_overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: list[str] | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Columns `keep` of `docs` (all by default) plus n_words, spans (stretches of hit words), items (sorted ids) and longest
    (words of the longest match of at least a window).

    `items` is (item_id, text). A window is `window` consecutive words of an item, or all of a shorter one. Words are runs
    of characters other than ASCII signs and blanks; A-Z are lower-cased. Null texts have no words; repeated rows and ids
    each get their own result, equal for equal texts; items of equal id (or all without id, named '') count as one. Columns
    of `docs` under the four names are replaced.

    One automaton holds at most about `shard_words` words of items, which bounds what the driver builds and each task gets;
    more items make several automata, through which the documents pass one after another.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in _FOUND]
    pieces = item_pieces(items, window, shard_words)
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    # Twice as many shards as words need, and pieces of at most half a shard: what hashing puts together stays near the bound.
    shards = 1 if total <= shard_words else -(-2 * total // shard_words)
    pieces = item_pieces(items, window, max(1, shard_words // 2)).withColumn("_s", F.pmod(F.xxhash64("item", "words"), F.lit(shards))) if shards > 1 else pieces.withColumn("_s", F.lit(0))
    context, out = docs.sparkSession.sparkContext, docs.select(*dict.fromkeys([*keep, "text"]))
    types = {f.name: f.dataType.simpleString() for f in out.schema}
    added: list[list[str]] = []
    for shard in range(shards):
        automaton = SuffixAutomaton([(r.item, r.words) for r in pieces.filter(F.col("_s") == shard).select("item", "words").collect()], window)
        names = [f"_{n}_{shard}" for n in _FOUND]
        own = [*(keep if shard + 1 == shards else dict.fromkeys([*keep, "text"])), *(n for a in added for n in a)]
        types |= dict(zip(names, ("long", _SPANS, "array<string>", "int"), strict=True))
        out = out.mapInArrow(_searching(context.broadcast(automaton), own, names), ", ".join(f"`{n}` {types[n]}" for n in [*own, *names]))
        added.append(names)
    n_words, spans, found, longest = zip(*added, strict=True)
    together = lambda cols: F.flatten(F.array(*cols))
    greatest = F.greatest(*longest) if shards > 1 else F.col(longest[0])
    return out.select(*keep, F.col(n_words[0]).alias("n_words"), (merged_spans(together(spans)) if shards > 1 else F.col(spans[0])).alias("spans"), F.array_sort(F.array_distinct(together(found))).alias("items"), greatest.alias("longest"))


def merged_spans(spans: Column) -> Column:
    """Spans in order, those that meet made one."""
    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), step)


def hit_words(spans: str = "spans") -> Column:
    """Number of words in spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_span: int = WINDOW, most_covered: float = 0.5) -> DataFrame:
    """`docs` without passages of the items: spans of at least `least_span` words are cut out of the text; documents of which
    more than the share `most_covered` of all words is hit go whole. Columns stay as they are; clean texts are not touched."""
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text"))
    found = find_overlaps(plain, items, window).filter(hit_words() <= F.col("n_words") * most_covered)
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(batches):
            texts = batch.column("text").to_pylist()
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                wide = [s for s in spans if s["end"] - s["start"] >= least_span]
                if wide:
                    places, parts, at = [m.span() for m in _RAW_WORD.finditer(texts[row])], [], 0
                    for s in wide:
                        parts.append(texts[row][at : places[s["start"]][0]])
                        at = places[s["end"] - 1][1]
                    texts[row] = "".join(parts) + texts[row][at:]
            columns = [batch.column(n) for n in names]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.select(*names, "text", "spans").mapInArrow(cut, fields).toDF(*docs.columns)


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those inside a window of a benchmark item, and the items."""
    found = find_overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places JOIN lengths ON i + n - 1 <= len(w)),
found AS MATERIALIZED (SELECT r, i, g.n, item FROM grams g JOIN windows USING (n, gram)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""
