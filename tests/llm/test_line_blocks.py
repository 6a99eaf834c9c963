"""Line deduplication: postings in blocks, and members of a large group that are linked with nothing."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from fogline.llm import _lists, line_dedup
from fogline.llm._scratch import Scratch
from tests.llm.test_line_lists import close, dropped, exact_repeats, lists_of


def group(rng, members, loners):
    """Near copies of one line, and lines that share half of their shingles with it and less than the similarity with any other."""
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(40)]
    texts = []
    for n in range(members + loners):
        one = list(base)
        for at in rng.sample(range(40), 1 if n < members else 9):
            one[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(one))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_members_linked_with_nothing_make_no_row_for_every_other(spark, monkeypatch):
    texts, rows, write = group(random.Random(61), 600, 150), [], Scratch.write

    def counted(self, df, table):
        out = write(self, df, table)
        if table == "close" or table.endswith("_links"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    want = exact_repeats(texts)
    assert dropped(spark.createDataFrame(pd.DataFrame(texts, columns=["doc_id", "text"])).repartition(3)) == want
    assert 590 < len(want) < 640 and sum(rows) <= 16 * len(texts)


def blocks_of(rows, posts, batch, per_band, small=8, whole=4096):
    """The rows (token, doc, sketch, lead) posted in several goes under keys of two bytes, and met again."""
    out = []
    for k in range(posts):
        part = rows[k::posts]
        sig = np.array([[[r[0] & 255, r[0] >> 8]] for r in part], dtype=np.uint8).reshape(-1, 1, 2)
        doc, sketch = (np.array([r[i] for r in part], dtype=np.int64) for i in (1, 2))
        led = np.array([[r[3] is not None] for r in part], dtype=bool).reshape(-1, 1)
        apart = np.array([[r[3] is not None and r[3] != r[1]] for r in part], dtype=bool).reshape(-1, 1)
        out += list(_lists.post(sig, doc, sketch, apart, led, per_band))
    table = pa.Table.from_batches(out).sort_by("bucket").combine_chunks().to_batches()[0]
    pairs, dense = set(), set()
    for got in _lists.meet_blocks(small, whole, 2, per_band, 48)(table.slice(i, batch) for i in range(0, len(table), batch)):
        for r in got.to_pylist():
            pairs.add((r["a"], r["b"])) if r["a"] is not None else dense.add((r["token"], r["doc"]))
    return pairs, dense


@pytest.mark.parametrize("posts, batch, per_band", [(1, 100, 1), (5, 1, 3), (7, 4, 50)])
def test_lists_in_blocks_are_those_of_single_postings(posts, batch, per_band):
    rng = random.Random(67)
    bases, rows = [rng.getrandbits(63) for _ in range(4)], []
    for token in range(60):
        for d in rng.sample(range(1000), rng.choice([1, 1, 2, 3, 8, 9, 40])):
            bits = rng.choice(bases[: rng.choice([1, 4])]) ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(8)))
            rows += [(token, d, bits, d if token % 7 == 0 and d % 3 == 0 else None)] * rng.choice([1, 1, 2])
    assert blocks_of(rows, posts, batch, per_band) == lists_of(sorted(rows, key=lambda r: r[:2]), 1000)


def test_a_bucket_that_is_not_held_loses_no_pair(monkeypatch):
    monkeypatch.setattr(_lists, "BUCKET", 100)
    monkeypatch.setattr(_lists, "HELD", 50)
    rng = random.Random(71)
    base = rng.getrandbits(63)
    rows = [(3, d, base ^ (1 << (d % 5)), None) for d in range(400)] + [(t, t + k, base, None) for t in range(10, 200) for k in range(2)]
    rng.shuffle(rows)
    pairs, dense = blocks_of(rows, 20, 3, 1)
    assert dense == {(3, d) for d in range(400)} and {(t, t + 1) for t in range(10, 200)} <= pairs and len(pairs) < 190 + 20 * 28 + 400


def test_across_gives_links_by_whole_sets_one_for_each_component():
    rng, row = random.Random(73), 0
    base = list(range(60))
    sets = {}
    for d in range(200):
        one = [v if rng.random() < 0.9 else rng.randrange(10**6) for v in base]
        sets[d] = np.unique(np.array(one + [10**7 + d] * (d % 2), dtype=np.uint64))
    kind = {d: rng.choice([1, 1, 2, d]) for d in sets}
    bits = rng.getrandbits(63)
    rows = [(9, 0, r, d, bits, kind[d], str(d)) for r in (0, 1) for d in sets if r or kind[d] != 1]
    table = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(7)], names=list("tsrdkcx"))
    run = _lists.across(None, lambda x: [sets[int(v)] for v in x.to_pylist()], 75)
    got = {(r["a"], r["b"]) for out in run(table.slice(i, 64) for i in range(0, len(table), 64)) for r in out.to_pylist()}

    def link(a, b):
        n = len(np.intersect1d(sets[a], sets[b]))
        return 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)

    want = {(a, kind[b]) for a in sets for b in sets if kind[a] != 1 and kind[a] != kind[b] and link(a, b)}
    assert all(link(a, b) and kind[a] != kind[b] and close(bits, bits) for a, b in got)
    assert want == {(x, kind[y]) for a, b in got for x, y in ((a, b), (b, a)) if kind[x] != 1} and 0 < len(want)


@pytest.mark.parametrize("cells", [1, 300, 1 << 23])
def test_reach_is_exact_in_parts_of_any_size(monkeypatch, cells):
    monkeypatch.setattr(_lists, "CELLS", cells)
    rng = np.random.default_rng(79)
    made = np.empty(50, dtype=object)
    made[:] = [np.unique(rng.integers(0, 40, rng.integers(1, 60))).astype(np.uint64) for _ in range(50)]
    marked = rng.random((30, 50)) < 0.5
    got = _lists.reach(marked, made[:30], made, 75)
    for i in range(30):
        for j in range(50):
            n = len(np.intersect1d(made[i], made[j]))
            assert got[i, j] == (marked[i, j] and 100 * n >= 75 * (len(made[i]) + len(made[j]) - n))


def test_lines_counted_as_they_are_split(spark):
    texts = [(1, None), (2, ""), (3, "\n"), (4, "a\nb"), (5, "é\r\nü\n\n"), (6, "one")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.n_lines for r in line_dedup.line_verdicts(docs).collect()} == {i: len((t or "").split("\n")) if t is not None else 0 for i, t in texts}
