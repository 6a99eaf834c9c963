"""Language identification by cross-parsing entropy.

For every language, labelled text gives a suffix automaton. A text is parsed greedily against it: each phrase is the
longest run of symbols that occurs somewhere in the language's sample. A phrase costs log2(sample length) bits, so phrases
times that, per symbol, estimates the cross entropy; the language with the fewest normalised phrases wins.

Symbols are lower-cased letters; a run of other characters is one separator. Automata are stored as transition tables in
which a missing transition already leads to the start of the next phrase, so many stretches of text are parsed in step by
array operations. The phrases are those of one parse from the first symbol of a text to its last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.llm import _text as X

#: The fit: this many documents of a language give a window of so many characters each.
SAMPLE_DOCS, SAMPLE_CHARS = 96, 400
STRETCH, CHUNK_CHARS = 128, 1 << 19
#: The most frequent letters of a sample have codes of their own; its other letters share the rest.
OWN_CODES, SHARED_CODES = 200, 8
SEPARATOR, PAD, ABSENT, FIRST = range(4)
#: Share of a bit of code length by which odds between languages move.
TEMPER = 0.25
UNKNOWN = "und"


@dataclass(frozen=True)
class CrossParser:
    """Labelled samples, by language in code-point order. Small enough to travel with each task; tables are built there."""

    samples: tuple[tuple[str, str], ...]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> CrossParser:
    """Take the sample of every language: ``docs`` distinct texts with the smallest hash, one window of ``chars`` each.

    Copies of a text count once, whatever their number. Equality of texts is equality of 64-bit hashes. Rows whose language or text is null teach nothing. The sample is bounded by languages x docs x chars; it does not depend
    on the order or number of partitions.
    """
    key = F.xxhash64("text")
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    hashed = rows.select("lang", key.alias("key")).distinct()  # keys alone are shuffled, not texts
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= docs)
    start = 1 + F.pmod(key, F.greatest(F.length("text") - chars + 1, F.lit(1)).cast("long"))
    chosen = rows.withColumn("key", key).join(F.broadcast(ranked), ["lang", "key"])
    cut = chosen.select("lang", "rank", F.substring("text", start.cast("int"), F.lit(chars)).alias("part")).groupBy("lang", "rank").agg(F.min("part").alias("part"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in cut.collect():
        parts.setdefault(r["lang"], []).append((r["rank"], r["part"]))
    return CrossParser(tuple((lang, " ".join(p for _, p in sorted(parts[lang]))) for lang in sorted(parts)))


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in go[at]:
            go[at][c] = new
            at = link[at]
        if at >= 0:
            to = go[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(go)
                go.append(dict(go[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and go[at].get(c) == to:
                    go[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return go


_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters (general category L)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Tables:
    """What the parse reads, per language: a code for every code point, the next state and how many phrases ended.

    Every language has an alphabet of its own. A letter that its sample lacks has the code ``ABSENT`` there; of the letters that
    it has, the most frequent have codes of their own and the rest share some.
    """

    def __init__(self, model: CrossParser):
        self.langs = [lang for lang, _ in model.samples]
        self.code, self.next, self.cost, self.width = [], [], [], []
        for _, sample in model.samples:
            seen = Counter(c for c in sample.lower() if c.isalpha())
            ranked = sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))
            code = np.full(0x110000, SEPARATOR, dtype=np.uint8)
            code[letter_table()] = ABSENT
            for k, (c, _) in enumerate(ranked):
                code[ord(c)] = FIRST + (k if k < OWN_CODES else OWN_CODES + ord(c) % SHARED_CODES)
            width = FIRST + min(len(ranked), OWN_CODES + SHARED_CODES)
            points, _ = symbols([sample])
            go = automaton(code[points].tolist())
            table = np.zeros((len(go), width), dtype=np.int32)
            for c in range(width):
                table[:, c] = 4 * go[0].get(c, 0) + 1  # the phrase ends before this symbol, the next one starts with it
            table[0] -= 1  # no phrase is open at the start
            for c in range(width):
                if c not in go[0]:
                    table[:, c] = 2  # a symbol that the sample lacks is a phrase of its own, and ends the one before
                    table[0, c] = 1
            for state, edges in enumerate(go):
                for c, to in edges.items():
                    table[state, c] = 4 * to
            table[:, PAD] = 4 * np.arange(len(go), dtype=np.int32)
            self.code.append(code)
            self.next.append(table.ravel())
            self.width.append(width)
            self.cost.append(np.log2(max(2, len(points))))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text under every language (texts x languages), and symbols per text.

        Texts are parsed in stretches side by side. A stretch begins in the state in which the one before it ended: that is not
        known at first, so all begin anew, and those whose beginning proves wrong are parsed again until none is.
        """
        points, sizes = symbols(texts)
        per = -(-sizes // STRETCH)
        total = int(per.sum())
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        if not total:
            return out, sizes
        owner = np.repeat(np.arange(len(texts)), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        rank = np.arange(total) - first[owner]
        start = begin[owner] + rank * STRETCH
        length = np.minimum(STRETCH, sizes[owner] - rank * STRETCH)
        places = np.minimum(start + np.arange(STRETCH)[:, None], len(points) - 1)
        beyond = np.arange(STRETCH)[:, None] >= length
        last = np.append(owner[1:] != owner[:-1], True)
        for k, table in enumerate(self.next):
            grid = self.code[k][points][places].astype(np.int32)
            grid[beyond] = PAD
            state, count, ends = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
            todo = np.arange(total)
            while len(todo):
                ends[todo], count[todo] = self._parse(table, self.width[k], grid[:, todo], state[todo])
                after = np.append(0, np.where(last, 0, ends)[:-1]).astype(np.int32)
                todo = np.flatnonzero(after != state)
                state = after
            count += last & (ends != 0)  # the phrase still open at the end of a text
            out[:, k] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return out, sizes

    @staticmethod
    def _parse(table: np.ndarray, width: int, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after the stretches (columns of ``grid``), and the phrases that ended in them."""
        count = np.zeros(len(state), dtype=np.int32)
        for row in grid:
            step = table[state * np.int32(width) + row]
            count += step & 3
            state = step >> 2
        return state, count


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, lower-cased, a run of other characters than letters as its first one; and
    the number of symbols of each."""
    lowered = [t.lower() for t in texts]
    points = code_points("".join(lowered))
    letter = letter_table()[points]
    ends = np.cumsum([len(t) for t in lowered], dtype=np.int64)
    before = np.ones(len(points), dtype=bool)
    before[1:] = letter[:-1]
    at = np.concatenate([[0], ends[:-1]])
    before[at[at < len(points)]] = True
    keep = letter | before
    kept = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], np.diff(kept[np.concatenate([[0], ends])])


_built: dict[CrossParser, Tables] = {}


def tables(model: CrossParser) -> Tables:
    if model not in _built:
        _built.clear()
        _built[model] = Tables(model)
    return _built[model]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    first, held, chars = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        chars += len(held[-1])
        if chars >= CHUNK_CHARS:
            yield first, held
            first, held, chars = i + 1, [], 0
    if held:
        yield first, held


def predict(model: CrossParser, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per symbol of every text.

    The score is the share of the winner in the odds of all languages. Bits per symbol leave out the first phrase, which any
    text needs, so one short word is not taken for an unknown language. Ties go to the first language by code point. Without
    a letter, or without any learned language, the language is ``und`` and both numbers are 0.
    """
    t = tables(model)
    langs: list[str] = [UNKNOWN] * len(texts)
    score, bits = np.zeros(len(texts)), np.zeros(len(texts))
    if not t.langs:
        return langs, score, bits
    for first, part in _batches(texts):
        counts, sizes = t.phrases(part)
        spelled = np.array([any(map(str.isalpha, x)) for x in part])
        cost = counts * np.array(t.cost)
        best = cost.argmin(axis=1)
        odds = np.exp(-TEMPER * (cost - cost.min(axis=1, keepdims=True)))
        for i in np.flatnonzero(spelled):
            langs[first + i] = t.langs[best[i]]
            score[first + i] = odds[i, best[i]] / odds[i].sum()
            bits[first + i] = (cost[i, best[i]] - t.cost[best[i]]) / sizes[i]
    return langs, score, bits


FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_symbol", pa.float64())])


def predict_column(model: CrossParser, texts: pa.Array) -> pa.Array:
    """``predict`` for an Arrow column. Its texts become Python strings in parts of about ``CHUNK_CHARS`` bytes, or one text, so
    what a worker holds beside the batch does not grow with the rows of the batch; a worker keeps what it has once held."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // CHUNK_CHARS)) + 1).tolist(), len(texts)]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        langs, score, bits = predict(model, texts.slice(a, b - a).to_pylist())
        parts.append(pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score), pa.array(bits)], fields=list(FOUND)))
    return pa.concat_arrays(parts)


def language(model: CrossParser, text: Column) -> Column:
    """Struct of lang_pred, score and bits_per_symbol for a text column."""

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_symbol: double>")
    def run(column: pa.Array) -> pa.Array:
        return predict_column(model, column)

    return run(text)


def identify_languages(docs: DataFrame, model: CrossParser, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and lang_pred, score and bits_per_symbol; columns of these names are replaced.

    Null and empty texts and texts without letters are ``und`` with score 0. Texts of any length are parsed whole. Equal texts
    get equal results. An empty table gives an empty result.
    """
    X.batches_by_bytes(docs.sparkSession)
    new = ["lang_pred", "score", "bits_per_symbol"]
    names = [c for c in docs.columns if c not in new]
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.lit(None).alias("row"), language(model, F.col(f"`{text_col}`").cast("string")).alias("found"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names], "found.*")
