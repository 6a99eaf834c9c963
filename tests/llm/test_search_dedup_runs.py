"""Lexical search, exact deduplication and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fogline.llm import exact_dedup, lexical_search, periodic_runs
from fogline.llm.queries import QUERIES
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, source string, score string, `row` string, runs string, name string, best string, n string, `a.b` string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *["clash"] * 8) for i, t in rows], SCHEMA)


def awkward():
    rng = random.Random(3)
    long = " ".join(f"x{rng.randrange(10**4)}" for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t\x0b "), (4, long), (5, long + " "), (6, "one two"), (7, "One TWO"), (8, "b b b"), (8, "b b b"), (8, "b b b "), (None, "one two"), (None, None),
        (9, "été 東京 ÀB été"), (10, "onetwo"), (2**62, "one one two"), (-5, "two one one"), (11, "a\x00b one"), (12, " one"),
    ]


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def ranked(docs, queries, k):
    """The contract, one document at a time."""
    held = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for item, text in queries:
        asked[item].update(TERM.findall(lower(text or "")))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, total)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in terms.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("window, block", [(8192, 1 << 20), (3, 4)])
def test_search_equals_scoring_every_document(spark, window, block):
    rng = random.Random(5)
    docs = awkward() + [(100 + i, " ".join(rng.choice("one two three four five Six seven x17 été".split()) for _ in range(rng.randrange(1, 30)))) for i in range(200)]
    queries = [(1, "one TWO two"), (2, None), (3, ""), (4, "nowhere"), (5, "été x17 b"), (6, " ".join("one two three".split() * 9)), (6, "seven"), (7, "東京 a b")]
    items = spark.createDataFrame([(i, t, "clash") for i, t in queries], "item_id long, text string, doc_id string")
    found = lexical_search.search(frame(spark, docs).repartition(5), items, k=7, window=window, block_terms=block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:2]) == sorted(ranked(docs, queries, 7), key=lambda r: r[:2])


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, awkward()), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs, spark.createDataFrame([(None, "one")], "item_id long, text string")).count() == 0


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_duplicates_of_awkward_rows(spark):
    rng = random.Random(7)
    base = "".join(rng.choice("ab") for _ in range(100))
    close = [(200 + i, base[:i] + ("a" if base[i] == "b" else "b") + base[i + 1 :]) for i in range(0, 100, 9)]  # every block of these has copies
    swapped = [(300, "ab" * 40 + "cd" * 40), (301, "cd" * 40 + "ab" * 40), (302, "ab" * 40 + " " + "cd" * 40), (303, "ab" * 80), (304, "ab" * 79), (305, "ab" * 81)]
    docs = awkward() + close + swapped + [(400 + i, "same text\n" * 30 + " " * (i % 3)) for i in range(60)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for text, rows in groups.items():
        rows.sort()
        for k, r in enumerate(rows):
            want[r[3], rows[0][3], len(rows), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    for size, parts in ((1024, 3), (8, 7)):
        found = exact_dedup.exact_duplicates(frame(spark, docs).repartition(parts), block_bytes=size)
        assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(map(tuple, found.collect())) == want
    assert exact_dedup.exact_duplicates(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_names_are_ranks_wherever_tasks_are_cut(spark, parts):
    rng = random.Random(parts)
    rows = [(r, p, bytes([rng.choice(b"aaaaaaab"), rng.choice(b"ab")])) for r in range(120) for p in range(4)] + [(500, p, b"zz") for p in range(50)] + [(501, 0, b""), (502, 0, b"q")]
    want = {k: n for n, k in enumerate(sorted({k for *_, k in rows}))}
    holders = defaultdict(set)
    for r, _, k in rows:
        holders[k].add(r)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        keyed = spark.createDataFrame(rows, "row long, pos long, key binary")
        named = exact_dedup.dense_names(keyed, exact_dedup.Scratch(spark, "names"), "n").collect()
    finally:
        for k, v in zip(("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"), before, strict=True):
            spark.conf.set(k, v)
    keys = {(r, p): k for r, p, k in rows}
    assert len(named) == len(rows)
    for n in named:
        key = keys[n.row, n.pos]
        assert n.name == want[key]
        assert not n.own or len(holders[key]) == 1
    assert parts > 1 or all(n.own == (len(holders[keys[n.row, n.pos]]) == 1) for n in named)


def brute_runs(words, least=24, periods=3):
    """Every stretch of equal words q apart, whose smallest period is q."""
    out = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, periods * q):
                part = words[start : start + length]
                if all(part[d:] != part[:-d] for d in range(1, q)):
                    out.append((start, length, q))
            i += i == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples(rng, count):
    for _ in range(count):
        k, n = rng.choice([1, 2, 2, 3, 4]), rng.randrange(0, 80)
        words = []
        while len(words) < n:
            block = [rng.choice("abcd"[:k]) for _ in range(rng.randrange(1, 7))]
            words += block * rng.randrange(1, 7)
        yield words * rng.randrange(1, 4) if rng.random() < 0.3 else words


@pytest.mark.parametrize("least", [1, 6, 24])
def test_runs_equal_brute_force(least):
    for words in samples(random.Random(least), 1200):
        assert periodic_runs.runs(words, least) == brute_runs(words, least)


def test_lyndon_arrays_and_agreements_are_exact():
    for words in samples(random.Random(2), 400):
        t = [ord(w) for w in words]
        smaller, shared = periodic_runs.next_smaller_suffixes([*t, -1])
        for i in range(len(t)):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            same = next((k for k in range(len(t) - j) if t[i + k] != t[j + k]), len(t) - j)
            assert (smaller[i], shared[i]) == (j, same)


def test_words_compared_grow_with_the_text_alone(monkeypatch):
    rng, spent = random.Random(9), 0
    agree = periodic_runs._agree

    def counted(t, a, b):
        nonlocal spent
        same = agree(t, a, b)
        spent += same + 1
        return same

    monkeypatch.setattr(periodic_runs, "_agree", counted)
    fib, other = [0], [0, 1]
    while len(other) < 40_000:
        fib, other = other, other + fib
    shapes = {
        "one": [0] * 40_000, "two": [0, 1] * 20_000, "fibonacci": other, "thue": [bin(i).count("1") & 1 for i in range(40_000)], "random": [rng.randrange(2) for _ in range(40_000)],
        "long loop": [rng.randrange(500) for _ in range(8_000)] * 5, "nested": (([0, 1] * 20 + [2]) * 20 + [3]) * 48, "stairs": sum(([0] * k + [1] for k in range(1, 280)), []), "down": sum(([0] * k + [1] for k in range(280, 0, -1)), []),
    }
    for name, words in shapes.items():
        for t in ([*words, -1], [*[-w for w in words], -1000]):
            spent = 0
            periodic_runs.next_smaller_suffixes(t)
            assert spent <= 3 * len(words), name


def test_collapsed_texts_of_awkward_rows(spark):
    docs = [*awkward(), (20, "x " + "a b c " * 9 + "y"), (21, "z " * 24), (22, "z " * 23), (23, " ".join(f"w{i // 8}" for i in range(400)) + " t" * 30), (24, "a b " * 30)]
    found = periodic_runs.collapse_runs(frame(spark, docs).repartition(3))
    assert set(found.columns) == {*frame(spark, []).columns, "collapsed"}
    got = Counter((r.doc_id, r.text, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect())
    want = Counter()
    for i, t in docs:
        words = WORD.findall(t or "")
        runs = brute_runs(words) if len(words) < 1000 else []
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want[i, t, tuple(runs), " ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    assert got == want
    assert found.where("`a.b` = 'clash' and name = 'clash'").count() == len(docs)
    assert periodic_runs.collapse_runs(frame(spark, docs).limit(0)).count() == 0


def test_runs_query_equals_brute_force_on_short_documents(spark):
    """All documents of up to 1500 words; the query itself runs over the whole table."""
    rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("text")).collect()
    assert len(rows) == len(docs)
    checked = 0
    for d in docs:
        words, h = WORD.findall(d.text or ""), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        if len(words) > 1500:
            continue
        checked += 1
        runs, r = brute_runs(words), rows[d.doc_id]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        milli = None if not runs else 1000 * best[1] // best[2]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert checked > 150 and any(r.n_runs for r in rows.values())
