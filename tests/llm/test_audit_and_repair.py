"""Decontamination, source divergence and conversation repair against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest

from tagmask.llm import decontaminate, divergence, repair
from tagmask.llm.common import read

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- decontamination -----------------------------------------------------------------------------------------------------------
def brute_overlaps(texts, items, window=10):
    """(n_words, hit places, item names) per text, from all windows as tuples."""
    grams = defaultdict(set)
    for name, text in items:
        words = WORD.findall(lower(text))
        size = min(len(words), window)
        for i in range(len(words) - size + 1 if words else 0):
            grams[tuple(words[i : i + size])].add("" if name is None else str(name))
    out = []
    for text in texts:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(words) - size + 1):
                if found := grams.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    names |= found
        out.append((len(words), len(hit), sorted(names)))
    return out


def overlaps(spark, texts, items, **more):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, longest int")
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_overlaps(docs, table, **more).orderBy("doc_id").collect()
    for r in rows:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) and all(s.start < s.end for s in r.spans)
    return [(r.n_words, sum(s.end - s.start for s in r.spans), r["items"]) for r in rows]


def test_overlaps_brute_force(spark):
    random.seed(5)
    text = lambda n, alphabet: " ".join(random.choice(alphabet) for _ in range(n))
    for alphabet in (["a", "b"], ["a", "B", "c1", "é"], [f"w{i}" for i in range(30)]):
        items = [(random.choice([1, 2, 33, None, 500]), text(random.choice([0, 1, 2, 4, 5, 6, 9, 30]), alphabet)) for _ in range(12)]
        texts = [text(random.randrange(60), [*alphabet, "zz"]) for _ in range(80)] + [None, "", "!?", "a" * 40_000, *[t for _, t in items], items[-1][1]]
        want = brute_overlaps(texts, items, 5)
        assert overlaps(spark, texts, items, window=5) == want
        assert overlaps(spark, texts, items, window=5, shard_words=40) == want


def test_overlaps_of_sliced_batches(spark):
    """Texts of several MB, which are looked at in slices of an Arrow batch."""
    texts = [f"x{i} " + "word " * 200_000 + "one TWO three four five six seven eight nine ten" for i in range(6)]
    items = [(1, "One two three four five six seven eight nine ten")]
    assert overlaps(spark, texts, items) == [(200_011, 10, ["1"])] * 6


def test_overlaps_odd_tables(spark):
    assert overlaps(spark, ["a b", None], []) == [(2, 0, []), (0, 0, [])]
    assert overlaps(spark, ["a b", None], [(1, None), (2, "...")]) == [(2, 0, []), (0, 0, [])]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find_overlaps(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_op11_given_tables(spark):
    docs, items = read(spark, DIR, "documents").collect(), [(r.item_id, r.text) for r in read(spark, DIR, "benchmark").collect()]
    want = dict(zip((r.doc_id for r in docs), brute_overlaps([r.text for r in docs], items), strict=True))
    rows = decontaminate.op11_benchmark_decontamination(spark, DIR).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()


def test_decontaminate_cuts_spans(spark):
    passage = "One two three four five six seven eight nine ten eleven."
    texts = ["Before it: " + passage + " And much more text follows here, so that little of it is hit at all, sir.", passage, "clean Text\n", None]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, c0 int")
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {0: "Before it: . And much more text follows here, so that little of it is hit at all, sir.", 2: "clean Text\n", 3: None}


# --- divergence ----------------------------------------------------------------------------------------------------------------
def brute_divergence(rows, least=30, ranks=50):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})
        prob = lambda c: (lambda n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept})(sum(c[t] for t in kept))
        q, p = prob(total), {s: prob(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def test_divergence_brute_force(spark):
    random.seed(6)
    words = ["a", "B", "b", "é", "中文", "zz", "x9y", "rare"] + [f"t{chr(97 + i)}" for i in range(12)]
    rows = [(" ".join(random.choices(words, k=random.randrange(12))), random.choice(["en", "de", None, ""]), random.choice(["s1", "s2", "é", None])) for _ in range(150)]
    rows += [(None, "fr", "only"), ("12 34", "it", "s1"), ("", "it", "s2"), ("lonely word", "pt", None), ("a " * 30_000, "en", "s1")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n long, bucket int").repartition(7)
    want = brute_divergence(rows, 3, 4)
    for cells in (1_000_000, 5):
        got = [tuple(r) for r in divergence.source_divergence(docs, least_docs=3, ranks=4, cells=cells).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_partial_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 3)
    rows = [(f"w{chr(97 + i % 20)} x", "en", f"s{i % 3}") for i in range(200)]
    got = {tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string")).collect()}
    assert {(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got} == brute_divergence(rows)


# --- conversation repair ---------------------------------------------------------------------------------------------------------
def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (turn, role, text) in order, by plain recursion."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    forced = {"": "u", "s": "u", "a": "u", "u": "a"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        step = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
        if inserted < 3:
            step(3, "I", best(i, forced[state], inserted + 1))
        if i < len(rows):
            step(4, "D", best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                stays = 3 if faults[i] == "truncated" else 0
                if (state, initials[i]) in after:
                    step(stays, "K", best(i + 1, after[state, initials[i]], 0))
                step(3 + stays, "R", best(i + 1, forced[state], 0))
        return min(found) if found else None

    cost, audit = best(0, "", 0)
    lines, state, at = [], "", iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(at)
        if letter == "K":
            state = row[1][:1]
            lines.append(f"{row[1]}:{row[2]}")
        elif letter in "RI":
            state = forced[state]
            lines.append(("user:" if state == "u" else "assistant:") + (row[2] if row else ""))
    turns = {t for t, _, _ in rows if t is not None}
    count = lambda f: sum(x == f for x in faults)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    """Conversations of damaged rows in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        of = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{of(conv)}:{of(turn)}".encode()) % 20
        role, text, own = of(role), of(text), out[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own.extend([] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for conv, own in out.items()}


def check_repair(frame, rows):
    got = {r.conv_id: tuple(r)[1:] for r in frame.collect()}
    want = {conv: brute_repair(own) for conv, own in brute_damage(rows).items()}
    assert frame.count() == len(want) and got == want


ROLES, TEXTS = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Cut off", " \t", "", None, "Ünïcode 中?", "a. ", "Why\n"]


def made_conversations(n, most, seed):
    random.seed(seed)
    ids = [None, *range(n)]
    rows = []
    for conv in ids:
        for turn in range(random.randrange(1, most)):
            rows.append((conv, random.choice([turn, turn, turn, turn + 3, None, -turn]), random.choice(ROLES), random.choice(TEXTS)))
    return rows


@pytest.mark.parametrize("long", [repair.LONG, 6, 0])
def test_repair_brute_force(spark, long):
    rows = made_conversations(120, 40, long)
    random.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, _k string")
    check_repair(repair.repair_conversations(frame, long=long), rows)


def test_repair_given_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, DIR, "conversations").collect()]
    check_repair(repair.op13_conversation_repair(spark, DIR), rows)


def test_repair_long_conversation(spark):
    """One conversation of thousands of rows, over tasks and in one piece, with repeated texts everywhere."""
    random.seed(3)
    rows = [(1, i, random.choice(ROLES), random.choice([*TEXTS, f"t{i}.", f"u{i % 700}!", f"v{i}"])) for i in range(6000)] + [(2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = {tuple(r) for r in repair.repair_conversations(frame).collect()}
    dealt = {tuple(r) for r in repair.repair_conversations(frame, long=1000).collect()}
    assert whole == dealt and len(dealt) == 2


def test_checkpoints_equal_plain_costs():
    random.seed(4)
    for _ in range(300):
        symbols = "".join(repair.symbol(random.choice("suax"), random.randrange(4)) for _ in range(random.randrange(60)))
        cost, audit = repair.cheapest(symbols)
        prices = {"K": 0, "R": 3, "D": 4, "I": 3}
        used = [letter for letter in audit if letter != "I"]
        kept = sum((ord(s) - 65) // 4 == repair.TRUNCATED and letter != "D" for s, letter in zip(symbols, used, strict=True))
        assert cost == sum(prices[letter] for letter in audit) + 3 * kept


def test_repair_empty_table(spark):
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
