"""Line deduplication against exact similarities, and its lists by themselves."""

import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from fogline.llm import _lists, line_dedup
from tests.conftest import MEDIUM


def tidy(line):
    return re.sub(r"[ \t\x0b\x0c\r]+", " ", line).strip().translate({c: c + 32 for c in range(65, 91)})


def exact_repeats(texts, k=line_dedup.SHINGLE_CHARS):
    """Places to drop, and how many of them repeat no equal line: every pair that shares a shingle is counted."""
    places = sorted((i, n, tidy(x)) for i, t in texts for n, x in enumerate((t or "").split("\n")) if tidy(x))
    lines = sorted({x for _, _, x in places})
    holds, sizes, label = defaultdict(list), [], list(range(len(lines)))
    number = {x: i for i, x in enumerate(lines)}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, x in enumerate(lines):
        mine = {x[j : j + k] for j in range(max(1, len(x) - k + 1))}
        sizes.append(len(mine))
        met = [holds[s] for s in mine]
        shared = np.bincount(np.concatenate([np.array(m, dtype=np.int64) for m in met]), minlength=1) if any(met) else np.zeros(1, dtype=np.int64)
        for j in np.flatnonzero(shared):
            if 100 * shared[j] >= 75 * (sizes[i] + sizes[j] - shared[j]):
                label[root(i)] = root(int(j))
        for s in mine:
            holds[s].append(i)
    first, drop = {}, set()
    for i, n, x in places:
        if first.setdefault(root(number[x]), (i, n)) != (i, n):
            drop.add((i, n))
    return drop


def dropped(docs, **options):
    return {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs, **options).collect()}


def test_recall_on_documents_against_exact_similarity(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    want = exact_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = dropped(docs.repartition(1))
    assert got <= want and len(got) >= 0.998 * len(want) and len(want) > 1500
    assert dropped(docs.repartition(64)) == got


def variants(rng, groups, each, words, edits):
    texts = []
    for g in range(groups):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(words)]
        for _ in range(each):
            one = list(base)
            for _ in range(rng.randrange(edits + 1)):
                one[rng.randrange(words)] = f"x{rng.randrange(10**5)}"
            texts.append(" ".join(one))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("whole, parts", [(4096, 3), (4, 1), (4, 5)])
def test_dense_groups_at_the_similarity_lose_no_link(spark, whole, parts):
    """Groups whose members lie on both sides of the similarity; with a short ``whole_list``, under longer keys."""
    texts = variants(random.Random(31), 5, 60, 30, 6)
    docs = spark.createDataFrame(pd.DataFrame(texts, columns=["doc_id", "text"])).repartition(parts)
    want = exact_repeats(texts)
    got = dropped(docs, whole_list=whole)
    assert got <= want and len(got) >= 0.99 * len(want) and 100 < len(want) < 295


def lists_of(rows, batch, small=8, whole=4096):
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    table = pa.RecordBatch.from_arrays(columns, names=["token", "doc", "sketch", "lead"])
    pairs, dense = set(), set()
    for out in _lists.meet(small, whole)(table.slice(i, batch) for i in range(0, len(rows), batch)):
        for r in out.to_pylist():
            pairs.add((r["a"], r["b"])) if r["a"] is not None else dense.add((r["token"], r["doc"]))
    return pairs, dense


def close(x, y):
    return 64 - ((x ^ y) & (2**64 - 1)).bit_count() >= _lists.ENOUGH


@pytest.mark.parametrize("batch", [1, 7, 1000])
@pytest.mark.parametrize("whole", [10, 4096])
def test_every_close_pair_of_a_list_is_made_or_left_dense(batch, whole):
    rng = random.Random(41)
    bases = [rng.getrandbits(63) for _ in range(6)]
    rows = []
    for token in range(40):
        docs = rng.sample(range(1000), rng.choice([1, 2, 3, 8, 9, 30]))
        spread = rng.choice([1, 3, 6])
        for d in docs:
            bits = rng.choice(bases[: rng.choice([1, 6])]) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4 * spread)))
            rows += [(token, d, bits, rng.choice([None, None, None, d]) if token % 5 == 0 else None)] * rng.choice([1, 1, 2])
    rows.sort(key=lambda r: r[:2])
    pairs, dense = lists_of(rows, batch, whole=whole)
    assert all(a < b for a, b in pairs)
    for token in range(40):
        of = {r[1]: r[2] for r in rows if r[0] == token}
        for a in of:
            for b in of:
                if a < b and close(of[a], of[b]):
                    assert (a, b) in pairs or {(token, a), (token, b)} <= dense
        centre = [d for d in of if (token, d) in dense]
        assert not centre or len(of) > 8 or token % 5 == 0


def test_lists_longer_than_a_task_holds(monkeypatch):
    monkeypatch.setattr(_lists, "HELD", 50)
    rng = random.Random(43)
    base = rng.getrandbits(63)
    rows = [(3, d, base ^ (1 << (d % 5)), None) for d in range(400)] + [(4, 7, base, None), (4, 9, base, None), (5, 1, base, 1), (5, 2, base, 1)]
    pairs, dense = lists_of(rows, 20)
    assert dense >= {(3, d) for d in range(400)} and {(7, 9), (1, 2)} <= pairs and len(pairs) < 400 + 28 * 12
    assert lists_of([], 5) == (set(), set())


def test_across_meets_all_close_items_of_other_components():
    rng = random.Random(47)
    base = rng.getrandbits(63)
    items = [(d, base ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(14))), rng.choice([1, 1, 1, d])) for d in range(300)]
    rows = [(9, 0, 0, *x) for x in items if x[2] != 1] + [(9, 0, 1, *x) for x in items] + [(10, 0, 1, *x) for x in items[:3]]
    table = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=list("tsrdkc"))

    def met(closest):
        return {(r["a"], r["b"]) for n in (17,) for out in _lists.across(closest)(table.slice(i, n) for i in range(0, len(rows), n)) for r in out.to_pylist()}

    want = {(x[0], y[0]) for x in items for y in items if x[0] < y[0] and x[2] != y[2] and close(x[1], y[1])}
    assert met(None) == want and met(2) < want and {x for p in met(2) for x in p} >= {x[0] for x in items if x[2] != 1 and any(x[0] in p for p in want)}


@pytest.mark.parametrize("similarity, least", [(0.75, 0.999), (0.9, 1.0)])
def test_sketches_keep_pairs_at_the_similarity(similarity, least):
    rng = np.random.default_rng(53)
    x = rng.integers(0, 2**32, (20000, 80), dtype=np.uint32)
    y = np.where(rng.random(x.shape) < similarity, x, rng.integers(0, 2**32, x.shape, dtype=np.uint32))
    assert (_lists.agreement(_lists.sketches(x), _lists.sketches(y)) >= _lists.ENOUGH).mean() >= least
    far = _lists.agreement(_lists.sketches(x), _lists.sketches(x[::-1].copy())) >= _lists.ENOUGH
    assert far.mean() < 0.002 and (_lists.agreement(_lists.sketches(x[:, :20]), _lists.sketches(x[:, :20])) == 64).all()
