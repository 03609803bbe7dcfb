"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: words in lower case, numbers (with their decimal and thousands marks) as
<number>, a unit after a number as <unit>, names as <name>. There are three such sequences: SENTENCE has a capitalised word
inside a sentence as <name>; WORD has a word as <name> that the benchmark never holds in lower case or not at all, whatever
its case and place; PLAIN has no placeholders. Windows of `width` tokens are hashed and joined with the windows of the
benchmark items. Matching windows of one alignment (place in the document less
place in the item) are one passage, and what stands in its placeholders is compared: a value of the item must always meet
the same value in the passage. So a question with new numbers and names is found wherever it stands and however often,
and a chance agreement of templates with jumbled slots is not. Exact wording is found in any case and line breaks. A
document is reported for the share of an item's windows, or for a run of RUN neighbouring windows of one passage.

The benchmark's windows are broadcast in blocks of BLOCK windows at most, each block against all documents (as the
stated query set); documents are scanned once for each block and never shuffled. Matches of one document and item are
summed at the end. The benchmark's distinct words are broadcast too, as hashes.

Defined results: null and empty texts match nothing. An item with fewer tokens than `width` is one window of its own
length. Windows of templates with fewer than half literal words are not used, as they say nothing. Items with null ids or texts are
left out, and repeated rows count once each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, small
from .textops import MARKS, U64, Words, batches, mix, string_bytes

WIDTH = 8
COVERAGE = 0.5
RUN = 13  # neighbouring windows: 20 tokens of the usual width
BLOCK = 1_000_000

LITERAL, NUMBER, UNIT, NAME = range(4)
SENTENCE, WORD, PLAIN = range(3)
_HOLDERS = mix(np.arange(101, 105, dtype=U64))

# Unit words, as they follow a number.
UNITS = """mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec secs min mins h hr hrs ms hz khz mhz ghz b kb mb gb tb
w kw mw v a k c f pa kpa bar mph kmh kph percent pct usd eur gbp dollar dollars euro euros cent cents pound pounds inch
inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers gram grams
kilogram kilograms ton tons tonne tonnes litre litres liter liters second seconds minute minutes hour hours day days
week weeks month months year years degree degrees""".split()


def _hash_words(words: list[str]) -> np.ndarray:
    return Words(pa.array(words, pa.large_string()), MARKS).hashes()


UNIT_HASHES = np.sort(_hash_words(UNITS))
_SENTENCE = np.zeros(256, dtype=bool)
_SENTENCE[[10, 33, 46, 63]] = True


class Templates:
    """Canonical tokens of a batch: row and value hash of each token; kinds and template hashes of each sequence.

    vocabulary: the benchmark's words (sorted hashes), and whether each occurs in lower case.
    """

    def __init__(self, texts: pa.Array, vocabulary: tuple[np.ndarray, np.ndarray]):
        w = Words(texts, MARKS)
        low = pc.utf8_lower(texts)
        same = pc.equal(pc.binary_length(low), pc.binary_length(texts))
        w.bytes = string_bytes(pc.if_else(same, low, texts))[0]
        value = w.hashes()
        raw, start, end, row = w.raw, w.start, w.end, w.row
        n = len(start)
        digit = (raw >= 48) & (raw <= 57)
        seen = np.concatenate([[0], np.cumsum(~digit)])
        number = seen[end] == seen[start] if n else np.zeros(0, bool)
        same_row = np.zeros(n, bool)
        same_row[1:] = row[1:] == row[:-1]
        # 1,234.50 is one number: a piece that follows a mark goes with the piece before
        piece = np.zeros(n, bool)
        if n > 1:
            mark = raw[np.minimum(end[:-1], max(len(raw) - 1, 0))]
            piece[1:] = number[1:] & number[:-1] & same_row[1:] & (start[1:] - end[:-1] == 1) & ((mark == 44) | (mark == 46))
        keep = np.flatnonzero(~piece)
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(value + piece.astype(U64)), keep) if n else value
        value = np.where(number[keep], total, value[keep]) if n else value
        self.row, self.start, self.end = row[keep], start[keep], end[keep]
        number = number[keep]
        k = len(keep)
        first = np.ones(k, bool)
        if k > 1:
            ends = np.concatenate([[0], np.cumsum(_SENTENCE[raw])])
            first[1:] = (self.row[1:] != self.row[:-1]) | (ends[self.start[1:]] > ends[self.end[:-1]])
        capital = np.zeros(k, bool)
        if k:
            after = np.minimum(self.start + 1, len(raw) - 1)
            wide = raw[self.start] >= 0x80
            capital = (raw[self.start] != w.bytes[self.start]) | (wide & (raw[after] != w.bytes[after]))
        unit = np.zeros(k, bool)
        if k > 1:
            known = UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, value), len(UNIT_HASHES) - 1)] == value
            unit[1:] = known[1:] & number[:-1] & (self.row[1:] == self.row[:-1])
        common = np.zeros(k, bool)
        if len(vocabulary[0]):
            at = np.minimum(np.searchsorted(vocabulary[0], value), len(vocabulary[0]) - 1)
            common = (vocabulary[0][at] == value) & vocabulary[1][at]
        names = [capital & ~first, ~common, np.zeros(k, bool)]
        self.kinds = [np.select([number, unit, name], [NUMBER, UNIT, NAME], LITERAL).astype(np.int8) for name in names[:2]]
        self.kinds.append(np.zeros(k, np.int8))
        self.value = value
        self.tokens = [np.where(kind == LITERAL, value, _HOLDERS[kind]) for kind in self.kinds]
        self.lower = ~number & ~capital
        self.rows = w.rows

    def windows(self, width: int, sequence: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first token, hash) of all windows of this width within one row."""
        token = self.tokens[sequence]
        n = len(token) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        with np.errstate(over="ignore"):
            h = np.full(len(at), width, dtype=U64)
            for k in range(width):
                h = mix(h * U64(0x2545F4914F6CDD1D) + token[at + k])
        return at, h


class Index:
    """Windows of a block of benchmark items, sorted by hash, for each sequence."""

    def __init__(self, ids: list[int], texts: list[str], width: int, vocabulary: tuple[np.ndarray, np.ndarray]):
        t = Templates(pa.array(texts, pa.large_string()), vocabulary)
        self.ids = np.asarray(ids, dtype=np.int64)
        self.value = t.value
        self.slot = (t.kinds[SENTENCE] != LITERAL, t.kinds[WORD] != LITERAL, t.kinds[PLAIN] != LITERAL)
        length = np.bincount(t.row, minlength=len(ids))
        self.sizes = sorted({width, *length[(length > 0) & (length < width)].tolist()})
        self.at, self.hash, self.size, self.told, self.windows = [], [], [], [], []
        for sequence in (SENTENCE, WORD, PLAIN):
            literal = np.concatenate([[0], np.cumsum(~self.slot[sequence])])
            at, h, size = [], [], []
            for w in self.sizes:
                a, x = t.windows(w, sequence)
                if w < width:
                    whole = length[t.row[a]] == w
                    a, x = a[whole], x[whole]
                told = 2 * (literal[a + w] - literal[a]) >= w
                at.append(a[told])
                h.append(x[told])
                size.append(np.full(int(told.sum()), w))
            at, h, size = (np.concatenate(x) for x in (at, h, size))
            order = np.argsort(h, kind="stable")
            self.at.append(at[order])
            self.hash.append(h[order])
            self.size.append(size[order])
            told = np.zeros(len(t.row), bool)
            told[at] = True
            self.told.append(told)  # by the first token
            self.windows.append(np.bincount(t.row[at], minlength=len(ids)))
        self.row = t.row


def matches(index: Index, docs: Templates, coverage: float) -> list[tuple[int, int, int, int, int, int, bool]]:
    """(row, item, matched windows, windows of the item, slots, slots with a new value, whether these are enough)."""
    found = []
    for sequence in (SENTENCE, WORD, PLAIN):
        hashes, sizes, starts = index.hash[sequence], index.size[sequence], index.at[sequence]
        for w in index.sizes:
            at, h = docs.windows(w, sequence)
            low = np.searchsorted(hashes, h, side="left")
            some = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == h) if len(hashes) else []
            if len(some):
                low = low[some]
                n = np.searchsorted(hashes, h[some], side="right") - low
                ref = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                keep = sizes[ref] == w
                at, ref = np.repeat(at[some], n)[keep], ref[keep]
                found.append((at, starts[ref], sizes[ref], np.full(len(at), sequence)))
    if not found:
        return []
    at, start, size, sequence = (np.concatenate(x) for x in zip(*found, strict=True))
    row, item, shift = docs.row[at], index.row[start], at - start
    order = np.lexsort((start, shift, item, row))
    at, start, size, sequence, row, item, shift = (x[order] for x in (at, start, size, sequence, row, item, shift))
    changed = np.zeros(len(at), bool)
    for k in range(max(index.sizes)):
        within = np.flatnonzero(size > k)
        changed[within] |= index.value[start[within] + k] != docs.value[at[within] + k]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])])) if len(row) else []
    out = []
    for i, j in zip(new, [*new[1:], len(row)], strict=True):
        hits = Hits(start[i:j], size[i:j], sequence[i:j], shift[i:j])
        out.append((int(row[i]), int(item[i]), *_best(index, docs, int(item[i]), hits, changed[i:j], coverage)))
    return out


class Hits(NamedTuple):
    """Matching windows of one document and item: first token in the item, size, sequence, alignment."""

    start: np.ndarray
    size: np.ndarray
    sequence: np.ndarray
    shift: np.ndarray

    def where(self, chosen) -> Hits:
        return Hits(*[x[chosen] for x in self])

    def run(self) -> int:
        """The most neighbouring windows of one alignment; the hits are in order."""
        if not len(self.start):
            return 0
        step, turn = np.diff(self.start), np.diff(self.shift)
        once = np.concatenate([[True], (step != 0) | (turn != 0)])
        start, shift = self.start[once], self.shift[once]
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(shift) != 0), [True]]))
        return int(np.diff(edge).max())


def _slots(index: Index, hits: Hits) -> np.ndarray:
    """The item's tokens in these windows that are placeholders."""
    windows = {*zip(hits.start.tolist(), hits.size.tolist(), hits.sequence.tolist(), strict=True)}
    tokens = [s + np.flatnonzero(index.slot[q][s : s + n]) for s, n, q in windows]
    return np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.int64)


def _share(index: Index, item: int, starts: set[int], exact: set[int]) -> tuple[int, int]:
    """(matched, all) windows of the item in the sequence with the greatest share; placeholders only where not exact."""
    all_starts = np.fromiter(starts, np.int64, len(starts))
    counts = [(len(exact), int(index.windows[PLAIN][item]))]
    counts += [(int(index.told[q][all_starts].sum()), int(index.windows[q][item])) for q in (SENTENCE, WORD)]
    return max(counts, key=lambda c: c[0] / c[1] if c[1] else 0.0)


def _best(index: Index, docs: Templates, item: int, hits: Hits, changed: np.ndarray, coverage: float) -> tuple[int, int, int, int, bool]:
    """(matched windows, windows, slots, changed slots, enough) of one document and item, from hits in order of alignment.

    Hits of one alignment (place in the document less place in the item) are one passage. Passages without a new value
    count together. A passage with new values counts if each value of the item meets one value there; passages that
    agree on the new values, as those around an inserted word do, count together. Of a passage that doesn't count, only a
    run of exact wording does.
    """
    edge = np.flatnonzero(np.concatenate([[True], np.diff(hits.shift) != 0]))
    altered = np.repeat(np.logical_or.reduceat(changed, edge), np.diff([*edge, len(changed)]))
    same = hits.where(~altered)
    exact = set(same.start.tolist())
    matched, windows = _share(index, item, exact, exact)
    long = hits.where(hits.sequence == PLAIN).run() >= RUN
    best = (matched, windows, len(_slots(index, same)), 0, bool(exact) and matched >= coverage * windows or long)
    if best[-1] or not altered.any():
        return best
    passages = []
    for i, j in zip(edge, [*edge[1:], len(changed)], strict=True):
        if not altered[i]:
            continue
        own = hits.where(slice(i, j))
        places = _slots(index, own)
        pairs = list(zip(index.value[places].tolist(), docs.value[places + hits.shift[i]].tolist(), strict=True))
        new = dict(pairs)
        if all(new[x] == y for x, y in pairs):
            plain = set(own.start[own.sequence == PLAIN].tolist())
            passages.append((set(own.start.tolist()), plain, new, set(places.tolist()), own.run() >= RUN))
    kept: list[tuple[set, set, dict, set, bool]] = []
    for own in sorted(passages, key=lambda p: -len(p[0])):
        for group in kept:
            if all(group[2].get(x, y) == y for x, y in own[2].items()):
                for into, more in zip(group[:4], own[:4], strict=True):
                    into.update(more)
                break
        else:
            group = own
            kept.append(own)
        matched, windows = _share(index, item, group[0] | exact, group[1] | exact)
        enough = matched >= coverage * windows or own[4]
        if enough or matched * best[1] > best[0] * windows:
            n_changed = sum(group[2][x] != x for x in index.value[sorted(group[3])].tolist())
            best = (matched, windows, len(group[3]), n_changed, enough)
        if enough:
            break
    return best


def _vocabulary(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The benchmark's words as sorted hashes, and whether each occurs in lower case."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, U64), np.zeros(0, bool)
        for batch in batches("text", stream):
            t = Templates(batch.column(0).cast(pa.large_string()), nothing)
            word, at = np.unique(t.value, return_inverse=True)
            lower = np.bincount(at, t.lower, len(word)) > 0
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(lower)], ["word", "lower"])

    words = items.select("text").mapInArrow(run, "word long, lower boolean").groupBy("word").agg(F.max("lower").alias("lower"))
    rows = words.collect()
    word = np.array([r.word for r in rows], np.int64).view(U64)
    order = np.argsort(word)
    return word[order], np.array([r.lower for r in rows], bool)[order]


def find_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, item_id, n_matched, n_windows, coverage, n_slots, n_changed): documents that hold an item's wording.

    A row for each document and item of which at least `coverage` of the item's windows stand in passages of the document
    that agree on the slots, or RUN neighbouring windows in one of them.
    """
    spark = docs.sparkSession
    ship(spark)
    items = materialize(
        benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull())
        .select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
        .withColumn("chars", F.length("text").cast("long")),
        "items",
    )
    chars = items.select(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK))  # a window begins at a character, so a block has about BLOCK windows at most
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"`{id_col}` {kind}, item_id long, n_matched long, n_windows long, n_slots long, n_changed long, enough boolean"
    vocabulary = spark.sparkContext.broadcast(_vocabulary(items))
    parts = []
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if held:
            block = spark.sparkContext.broadcast(([r.item_id for r in held], [r.text for r in held]))
            parts.append(docs.select(id_col, text_col).mapInArrow(_matcher(block, vocabulary, width, coverage, text_col), columns))
    if not parts:
        return docs.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, item_id long, n_matched long, n_windows long, coverage double, n_slots long, n_changed long"
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    share = F.col("n_matched") / F.col("n_windows")
    return (
        found.where("enough")
        .select(id_col, "item_id", "n_matched", "n_windows", share.alias("coverage"), "n_slots", "n_changed")
    )


def _matcher(block, vocabulary, width: int, coverage: float, text_col: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*block.value, width, vocabulary.value)
        for batch in batches(text_col, stream):
            found = matches(index, Templates(batch.column(1).cast(pa.large_string()), vocabulary.value), coverage)
            rows = [f[0] for f in found]
            items = [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(index.ids[items] if items else [], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    *[pa.array([f[k] for f in found], pa.int64()) for k in (3, 4, 5)],
                    pa.array([f[6] for f in found], pa.bool_()),
                ],
                [batch.schema.names[0], "item_id", "n_matched", "n_windows", "n_slots", "n_changed", "enough"],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold an item's wording; rows without an id stay if they are clean by themselves."""
    flagged = materialize(find_contaminated(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "leaks")
    return docs.join(small(flagged), docs[id_col].eqNullSafe(flagged[id_col]), "left_anti")
