"""Near-duplicate documents by MinHash bands, odd sketches and a check on whole sets.

1. One pass over the texts gives each document its set size, a 128-bit signature of its shingle set, `samples` MinHash
   values as `bands` keys of `rows` values each, and two odd sketches: bitmaps in which every element flips the bit that it
   hashes to. One is of the (place, MinHash value) samples, with `bits` bits; the other is of the whole set, with two to
   four bits a shingle. Documents with equal sets collapse to the smallest id.
2. What two sets have in common cancels in the XOR of their sketches. The XOR of the sample sketches estimates how many
   samples differ, best where that is few: pairs with more bits than a pair at the threshold has, by five standard
   deviations, are dropped. The XOR of the set sketches never has more bits than the sets have elements apart, so pairs
   with more than a link allows are dropped for certain. Pairs that stay are verified once on their whole sets.
3. Documents meet under equal band keys. The keys of the FIRST bands pair their documents with a leader, the first by a hash
   of the ids, which is the same one for most keys of a group, so a group of copies and variants takes few pairs a document.
   Links form components. Then, in all keys that hold several components, the documents outside the key's largest one meet
   LEADERS leaders, LED times with others, and at last all documents of the key that are of other components, under the
   same tests. Where that is many pairs, the documents of all such keys meet by the prefixes of their whole sets instead:
   with their shingles in order, rare ones first, sets that link have one in common among the first n - ceil(t n) + 1.
   That loses nothing, so these pairs skip the sample sketch, and it splits a key by what few of its documents share.
4. Components of all links.

What can be lost: a pair that links meets under no key with a probability of (1 - s^rows)^bands, 5e-7 at a similarity of
0.8 and with the defaults, and is over the sample sketch's bound with one of 3e-7. Nothing is capped: any number of
documents may meet under a key, and among the documents of large keys no link is lost.

Defined results: words are runs of non-blank characters, A-Z lower-cased. Fewer words than the width: the whole sequence
is the only shingle. No words, or a null text: an empty set, linked with nothing. Rows without an id keep a null
component and size. Of rows that repeat an id the greatest text stands for all. An empty table gives an empty result.
Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, ship
from .ngram_join import _set_table, _sets, _signed, _verified
from .textops import U64, batches, mix
from .vector_codes import join_by_weight

BANDS, ROWS, BITS = 48, 6, 1024
FIRST = 8  # bands whose leaders are met first
HEAVY = 1 << 20  # pairs to look at under one key from which on its documents meet by prefixes
LED = 2  # times that this is done, with other leaders
LEADERS = 4  # of a key's largest component, which the key's other documents meet before one another


def bits_at(similarity: float, samples: int, bits: int, sigmas: float = 0.0) -> float:
    """Expected bits in the XOR of the sketches of two sets of this similarity, and so many standard deviations more."""
    differ = samples * (1 - similarity)
    flips = 2 * differ
    stay, both = (1 - 2 / bits) ** flips, (1 - 4 / bits) ** flips
    odd = (1 - stay) / 2
    spread = bits * odd + bits * (bits - 1) * (1 - 2 * stay + both) / 4 - (bits * odd) ** 2
    slope = 2 * stay  # bits more for one sample more that differs
    return bits * odd + sigmas * math.sqrt(max(spread, 0) + slope**2 * differ * similarity)


def odd_similarity(xor_bits: np.ndarray | float, samples: int, bits: int) -> np.ndarray:
    """The similarity that so many bits in the XOR of two sketches tell; 0 where the sketches are as good as unrelated."""
    left = np.maximum(1 - 2 * np.asarray(xor_bits, dtype=float) / bits, 1e-9)
    return np.clip(1 + bits / (4 * samples) * np.log(left), 0, 1)


class Sampler:
    """MinHash values, band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int, bits: int):
        self.bands, self.rows, self.bits = bands, rows, bits
        self.samples = bands * rows
        seeds = mix(np.arange(1, 2 * self.samples + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        self.salt, self.odd = seeds[: self.samples], seeds[self.samples :] | U64(1)

    def minima(self, gram: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(samples, sets) for sets of hashes that begin at these places, none of them empty."""
        out = np.empty((self.samples, len(begin)), U64)
        for k in range(self.samples):
            with np.errstate(over="ignore"):
                np.minimum.reduceat((gram ^ self.salt[k]) * self.odd[k], begin, out=out[k])
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """(sets, bands): one hash for each band of values."""
        out = np.empty((minima.shape[1], self.bands), U64)
        for b in range(self.bands):
            with np.errstate(over="ignore"):
                x = np.full(minima.shape[1], b + 1, U64)
                for k in range(b * self.rows, (b + 1) * self.rows):
                    x = mix(x * U64(0x2545F4914F6CDD1D) + minima[k])
            out[:, b] = x
        return out

    def sketches(self, minima: np.ndarray) -> np.ndarray:
        """(sets, bits / 64): the parity of the samples that hash to each bit."""
        out = np.zeros((minima.shape[1], self.bits // 64), U64)
        every = np.arange(minima.shape[1])
        for k in range(self.samples):
            with np.errstate(over="ignore"):
                at = mix(minima[k] + self.salt[k]) % U64(self.bits)
            out[every, (at >> U64(6)).astype(np.int64)] ^= U64(1) << (at & U64(63))
        return out


def parities(gram: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each set): for sets of these sizes, the parity of the elements that hash to each bit.

    A set has a power of two of bits, two to four for each element and 64 at least; folding a sketch's upper half onto its
    lower one gives the sketch of half as many bits.
    """
    words = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes / 32, 1))).astype(np.int64), 0)
    begin = np.cumsum(words) - words
    bit = mix(gram ^ U64(0xD6E8FEB86659FD93)) & np.repeat(64 * words - 1, sizes).astype(U64)
    at = np.repeat(64 * begin, sizes) + bit.astype(np.int64)
    odd = (np.bincount(at, minlength=64 * int(words.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U64), words


_PROFILE = "doc long, n long, s long, t long, keys array<long>, sketch array<long>, parity array<long>"


def _profiles(width: int, sampler: Sampler):
    def lists(x: np.ndarray, of: np.ndarray, rows: int) -> pa.ListArray:
        """Rows of x for the documents of; the others have empty lists."""
        n = np.zeros(rows, np.int32)
        n[of] = x.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(_signed(x.ravel())))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches("text", stream):
            ids, row, gram = _sets(batch, width)
            n = np.bincount(row, minlength=len(ids))
            at = np.concatenate([[0], np.cumsum(n)])
            sums = []
            for salt in (0x5851F42D4C957F2D, 0xDA942042E4DD58B5):
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(gram ^ U64(salt)), dtype=U64)])
                    sums.append(_signed(total[at[1:]] - total[at[:-1]]))
            full = np.flatnonzero(n)
            parity, n_words = parities(gram, n)
            at_word = pa.array(np.concatenate([[0], np.cumsum(n_words)]).astype(np.int32))
            minima = sampler.minima(gram, at[full]) if len(full) else np.zeros((sampler.samples, 0), U64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
                 lists(sampler.keys(minima), full, len(ids)), lists(sampler.sketches(minima), full, len(ids)),
                 pa.ListArray.from_arrays(at_word, pa.array(_signed(parity)))],
                ["doc", "n", "s", "t", "keys", "sketch", "parity"],
            )

    return run


def xor_bits(one: Column, other: Column) -> Column:
    """Number of bits in which two sketches differ."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _folded(x: Column) -> Column:
    half = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))


def _fits(percent: int, most: int | None, a: str, b: str) -> Column:
    """Set sizes and both sketches (without `most` that of the whole set) of two sides allow a link. Sets that may link have set sketches of a size or neighbouring ones."""
    sizes = F.expr(f"100 * least(n_{a}, n_{b}) >= {percent} * greatest(n_{a}, n_{b})")
    samples = F.lit(True) if most is None else xor_bits(F.col(f"sketch_{a}"), F.col(f"sketch_{b}")) <= most
    one, other = F.col(f"parity_{a}"), F.col(f"parity_{b}")
    apart = F.when(F.size(one) > F.size(other), xor_bits(_folded(one), other))
    apart = apart.when(F.size(one) < F.size(other), xor_bits(one, _folded(other))).otherwise(xor_bits(one, other))
    # with J >= t at most (1 - t) / (1 + t) of both sizes together is apart
    return sizes & samples & ((100 + percent) * apart <= (100 - percent) * (F.col(f"n_{a}") + F.col(f"n_{b}")))


def _side(of: DataFrame, x: str, *others: str) -> DataFrame:
    return of.select(*others, *[F.col(c).alias(f"{c}_{x}") for c in of.columns if c not in others])


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _first(x: str = "doc", salt: int | None = None) -> Column:
    r = F.xxhash64(x) if salt is None else F.xxhash64(x, F.lit(salt))
    return F.min(F.struct(r.alias("r"), F.col(x).alias("doc")))["doc"]


def _leader_pairs(entries: DataFrame) -> DataFrame:
    """Distinct (a, b) of each document with the leader of each of its keys."""
    led = entries.groupBy("band", "key").agg(_first().alias("lead"), F.count("*").alias("k")).where("k > 1")
    pairs = entries.join(led.select("band", "key", "lead"), ["band", "key"]).where("doc <> lead")
    return pairs.select(*_pair("doc", "lead")).distinct()


def _strays(entries: DataFrame, component: DataFrame, leaders: range = range(1)) -> DataFrame:
    """Entries of keys that hold several components: stray (not in the key's largest), leads (of the largest), pairs to look at.

    A component has a leader for each of these salts, the same for most keys of a group.
    """
    placed = entries.join(component, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    of = placed.groupBy("band", "key", "component").agg(
        F.count("*").alias("k"), F.array(*[_first(salt=k) for k in leaders]).alias("leads")
    )
    per_key = of.groupBy("band", "key").agg(
        F.sum("k").alias("all"), F.count("*").alias("different"), F.max(F.struct("k", "component", "leads")).alias("top")
    )
    mixed = per_key.where("different > 1").select(
        "band", "key", F.col("top.component").alias("home"), F.col("top.leads").alias("leads"),
        ((F.col("all") - F.col("top.k")) * F.col("all")).alias("pairs"),
    )
    found = placed.join(mixed, ["band", "key"])
    return found.select("band", "key", "doc", "component", (F.col("component") != F.col("home")).alias("stray"), "leads", "pairs")


def _across(mixed: DataFrame, marks: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Distinct (a, b) of documents of different components that meet under a key and may link."""
    full = mixed.join(marks, "doc")
    columns = ["band", "key", "doc", "component", "stray", "n", "sketch", "parity"]
    one = _side(full.where("stray").select(*columns), "a", "band", "key")
    other = _side(full.select(*columns), "b", "band", "key")
    # of two strays each would meet the other twice
    apart = F.expr("component_a <> component_b and (not stray_b or doc_a < doc_b)")
    met = one.join(other, ["band", "key"]).where(apart & _fits(percent, most, "a", "b"))
    return met.select(*_pair("doc_a", "doc_b")).distinct()


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Entries (band, key, doc) under the shingles of each set's prefix that other sets have too."""
    grams = sets.select("doc", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("key"))
    many = grams.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    order = F.array_sort(F.collect_list(F.struct("k", "key")))
    shared = grams.join(many, "key").groupBy("doc", "n").agg(order.alias("order"))
    # the n - size(order) shingles that no other set has come before these
    left = f"size(order) + 1 - int(({percent} * n + 99) div 100)"
    prefix = F.expr(f"slice(order, 1, greatest(0, {left}))")
    return shared.select(F.lit(0).alias("band"), F.explode(prefix["key"]).alias("key"), "doc")


def _allowed(pairs: DataFrame, marks: DataFrame, percent: int, most: int | None) -> DataFrame:
    for x in ("a", "b"):
        pairs = pairs.join(_side(marks.withColumnRenamed("doc", x), x, x), x)
    return pairs.where(_fits(percent, most, "a", "b")).select("a", "b")


class _Links:
    """Pairs verified so far, the whole sets of their documents, and the components of the links."""

    def __init__(self, texts: DataFrame, width: int, percent: int):
        self.texts, self.width, self.percent = texts, width, percent
        self.tried = self.docs = self.sets = self.links = self._label = None

    def whole(self, docs: DataFrame) -> DataFrame:
        """(doc, grams) of these documents, among others."""
        docs = materialize(docs if self.docs is None else docs.join(self.docs, "doc", "left_anti"), "wanted")
        sets = materialize(_set_table(self.texts, docs, self.width), "sets")
        both = lambda x, y: y if x is None else x.unionByName(y)
        self.docs, self.sets = both(self.docs, docs), both(self.sets, sets)
        return self.sets

    def add(self, pairs: DataFrame) -> None:
        """Verifies the pairs (a, b) that haven't been."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "candidates")
        if self.tried is not None and pairs.isEmpty():
            return
        sets = self.whole(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
        links = materialize(_verified(pairs, sets, self.percent), "links")
        both = lambda x, y: y if x is None else x.unionByName(y)
        self.tried, self.links = both(self.tried, pairs), both(self.links, links)
        self._label = components(self.links).withColumnsRenamed({"node": "doc"})

    def lead(self, entries: DataFrame, marks: DataFrame, most: int | None) -> None:
        """Verifies the documents outside each key's largest component with leaders of it."""
        for k in range(LED):
            mixed = _strays(entries, self.label(), range(k * LEADERS, (k + 1) * LEADERS)).where("stray")
            mixed = mixed.select("doc", F.explode(F.array_distinct("leads")).alias("lead")).select(*_pair("doc", "lead")).distinct()
            self.add(_allowed(mixed, marks, self.percent, most))

    def label(self) -> DataFrame:
        """(doc, component) of the documents that aren't the smallest of their component."""
        return self._label


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    bits: int = BITS,
    heavy: int = HEAVY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) for every row: component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    ship(spark)
    sampler = Sampler(bands, rows, bits)
    most = math.ceil(bits_at(percent / 100, sampler.samples, bits, sigmas=5))
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = given.where("doc is not null")
    if not texts.groupBy("doc").count().where("count > 1").isEmpty():
        texts = materialize(texts.groupBy("doc").agg(F.max("text").alias("text")), "unique")

    profile = materialize(texts.mapInArrow(_profiles(width, sampler), _PROFILE), "profiles")
    full = profile.where("n > 0")
    copies = full.groupBy("s", "t", "n").agg(F.min("doc").alias("same"), F.count("*").alias("weight"))
    n_docs = profile.count()
    to_rep = join_by_weight(full.select("doc", "n", "s", "t"), copies, ["s", "t", "n"], n_docs).select("doc", "same")
    to_rep = materialize(to_rep, "reps")
    chosen = materialize(
        full.join(to_rep.where("doc = same").select("doc"), "doc", "left_semi").select("doc", "n", "keys", "sketch", "parity"), "chosen"
    )
    marks = chosen.select("doc", "n", "sketch", "parity")
    every = chosen.select("doc", F.posexplode("keys").alias("band", "key"))
    shared = every.groupBy("band", "key").agg(F.count("*").alias("k")).where("k > 1").select("band", "key")
    entries = materialize(every.join(shared, ["band", "key"], "left_semi"), "entries")

    found = _Links(texts, width, percent)
    found.add(_allowed(_leader_pairs(entries.where(F.col("band") < FIRST)), marks, percent, most))
    found.lead(entries, marks, most)
    mixed = materialize(_strays(entries, found.label()), "mixed")
    found.add(_across(mixed.where(F.col("pairs") <= heavy), marks, percent, most))
    large = materialize(mixed.where(F.col("pairs") > heavy).select("doc").distinct(), "large")
    if not large.isEmpty():
        finer = materialize(_prefixes(found.whole(large).join(large, "doc", "left_semi"), percent), "finer")
        found.lead(finer, marks, None)
        found.add(_across(_strays(finer, found.label()), marks, percent, None))
    label = found.label()

    of_rep = label.withColumnsRenamed({"doc": "same"})
    result = (
        profile.select("doc", "n")
        .join(to_rep, "doc", "left")
        .join(of_rep, "same", "left")
        .select("doc", "n", F.coalesce("component", "same", "doc").alias("component_id"))
    )
    return given.select("doc").join(result, "doc", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )
