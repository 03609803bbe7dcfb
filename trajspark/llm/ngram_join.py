"""Jaccard self-join on word n-grams by rare-first prefix filtering.

Two documents link when their sets of distinct word shingles have a Jaccard similarity of at least `percent` / 100. In any
order of all shingles that is the same for all documents, linked documents share a shingle within their prefixes (the
first n - ceil(t n) + 1 shingles). The order here is rare first, so a document's prefix starts with the shingles that no
other document has, and only what remains of the prefix is joined. The steps:

1. One pass over the texts gives each document's set size and a 128-bit signature of its set, and finds the *frequent*
   shingles (at least 2**-18 of all shingles, so 2**18 of them at most). Documents with equal sets collapse to the
   smallest id.
2. Document frequencies: shingles that aren't frequent are dealt by value over the cluster as packed arrays of (shingle,
   document); those that two documents share return to their documents with their frequency. Frequent ones never travel;
   they come last in the order, by their counts. So no shingle, however common, gathers in one task.
3. Prefix join. First every prefix entry is paired with the leader of its shingle (the document that has it earliest in
   its order): copies and variants of one text all meet the same few leaders, which takes linear work. Verified links
   form components. Then entries of shingles that still lie in several components are joined with each other, pairs
   within a component being skipped, as they can't change the result; they meet by shingle and class of set size, so
   that one shingle's entries are split by length. Pairs pass the length filter, the positional filter (at their first
   common prefix shingle, what remains must suffice for the overlap needed) and the suffix filter (an entry has the
   counts, in PARTS hash classes, of the shingles from its place on that other documents have; the smaller counts bound
   the overlap from above) and are made distinct, so that each is verified once, on its whole sets.
4. Components of all links.

Defined results: words are runs of non-blank characters, A-Z lower-cased. Fewer words than the width: the whole sequence
is the only shingle. No words, or a null text: an empty set, linked with nothing. Rows without an id keep a null
component and size. Of rows that repeat an id the greatest text stands for all. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, ship, small
from .textops import U64, Words, batches, mix, shingles

PARTS = 16
FREQUENT = 1 << 18
UNIT = 500_000  # shingles held by a task before they are written out
PER_BUCKET = 500_000
LEAST_BUCKETS = 128

_PROFILE = "kind int, a long, b long, c long, d long"
_PROFILE_ARROW = pa.schema([("kind", pa.int32()), *[(x, pa.int64()) for x in "abcd"]])
_PACKED = "bucket int, kind int, x binary, y binary, z binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "xyz"]])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """8-byte numbers by byte plane: planes that hardly vary shrink to nothing when the shuffle compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=U64(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(_unplanes(b, U64), dtype=U64)


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, and (row, shingle) of the distinct shingles of each row."""
    row, gram = shingles(Words(batch.column(1)), width)
    return batch.column(0).to_numpy(zero_copy_only=False), row, gram


def _profiles(width: int):
    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        gram, count = np.unique(np.concatenate(held), return_counts=True)
        keep = count >= max(2, int(count.sum()) // (2 * FREQUENT))
        gram, count = gram[keep], count[keep]
        none = pa.nulls(len(gram), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(gram), np.int32)), pa.array(_signed(gram)), pa.array(count.astype(np.int64)), none, none],
            schema=_PROFILE_ARROW,
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches("text", stream):
            ids, row, gram = _sets(batch, width)
            n = np.bincount(row, minlength=len(ids))
            at = np.concatenate([[0], np.cumsum(n)])
            sums = []
            for salt in (0x5851F42D4C957F2D, 0xDA942042E4DD58B5):
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(gram ^ U64(salt)), dtype=U64)])
                    sums.append(_signed(total[at[1:]] - total[at[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(ids), np.int32)), pa.array(ids.astype(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(sums[0]), pa.array(sums[1])],
                schema=_PROFILE_ARROW,
            )
            held.append(gram)
            n_held += len(gram)
            if n_held >= UNIT:
                yield frequent(held)
                held, n_held = [], 0
        if n_held:
            yield frequent(held)

    return run


def _lookup(common: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is in the sorted `common`, index there)."""
    if not len(common):
        return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
    at = np.minimum(np.searchsorted(common, gram), len(common) - 1)
    return common[at] == gram, at


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs in a sorted array."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for i, j in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
        if j > i:
            yield int(bucket[i]), int(i), int(j)


def _postings(width: int, frequent, buckets: int):
    """Packed (shingle, document) by ranges of the shingle, without the frequent ones."""

    def out(grams: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        gram, doc = np.concatenate(grams), np.concatenate(ids)
        order = np.argsort(gram)
        gram, doc = gram[order], doc[order]
        bucket = ((gram >> U64(32)) * U64(buckets)) >> U64(32)
        rows = [(b, 0, _pack_sorted(gram[i:j]), _planes(doc[i:j]), b"") for b, i, j in _slices(bucket)]
        return pa.RecordBatch.from_pylist(
            [dict(zip(_PACKED_ARROW.names, r, strict=True)) for r in rows], schema=_PACKED_ARROW
        )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value[0]
        grams, ids, n = [], [], 0
        for batch in batches("text", stream):
            doc, row, gram = _sets(batch, width)
            rare = ~_lookup(common, gram)[0]
            grams.append(gram[rare])
            ids.append(doc.astype(np.int64)[row[rare]])
            n += len(grams[-1])
            if n >= UNIT:
                yield out(grams, ids)
                grams, ids, n = [], [], 0
        if n:
            yield out(grams, ids)

    return run


def _deal(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(U64)) % U64(buckets)).astype(np.int64)


def _shared(doc_buckets: int):
    """Of a range of shingles, those in two documents or more go back, with their frequency, to their documents."""

    def run(rows: pa.Table) -> pa.Table:
        gram = np.concatenate([_unpack_sorted(b) for b in rows.column("x").to_pylist()])
        doc = np.concatenate([_unplanes(b) for b in rows.column("y").to_pylist()])
        order = np.argsort(gram)
        gram, doc = gram[order], doc[order]
        first = np.concatenate([[True], gram[1:] != gram[:-1]])
        size = np.diff(np.concatenate([np.flatnonzero(first), [len(gram)]]))
        frequency = np.repeat(size, size)
        many = frequency > 1
        gram, doc, frequency = gram[many], doc[many], frequency[many].astype(np.int64)
        bucket = _deal(doc, doc_buckets)
        order = np.argsort(bucket, kind="stable")
        gram, doc, frequency, bucket = gram[order], doc[order], frequency[order], bucket[order]
        out = [
            (b, 1, _planes(doc[i:j]), _planes(gram[i:j]), _planes(frequency[i:j])) for b, i, j in _slices(bucket)
        ]
        return pa.Table.from_pylist(
            [dict(zip(_PACKED_ARROW.names, r, strict=True)) for r in out], schema=_PACKED_ARROW
        )

    return run


def _own(width: int, frequent, doc_buckets: int):
    """Set sizes and frequent shingles of the documents, packed for their document's bucket."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value[0]
        for batch in batches("text", stream):
            ids, row, gram = _sets(batch, width)
            doc = ids.astype(np.int64)
            n = np.bincount(row, minlength=len(doc)).astype(np.int64)
            hit, at = _lookup(common, gram)
            row, at = row[hit], at[hit].astype(np.int64)
            rows = []
            for kind, who, what in ((2, np.arange(len(doc)), n), (3, row, at)):
                bucket = _deal(doc[who], doc_buckets)
                order = np.argsort(bucket, kind="stable")
                for b, i, j in _slices(bucket[order]):
                    rows.append((b, kind, _planes(doc[who][order[i:j]]), _planes(what[order[i:j]]), b""))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(_PACKED_ARROW.names, r, strict=True)) for r in rows], schema=_PACKED_ARROW
            )

    return run


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n // 100) + 1


_ENTRY = "doc long, n long, gram long, pos long, rest array<int>"
_ENTRY_ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc", "n", "gram", "pos")], ("rest", pa.list_(pa.int32()))])


def _prefixes(frequent, percent: int):
    """(doc, n, gram, pos, rest) of the prefix entries that another document may have, rare first.

    rest: how many of the shingles from here on that other documents have are in each of PARTS hash classes.
    """

    def stacked(rows: pa.Table, kind: int, *columns: str) -> list[np.ndarray]:
        of = np.array(rows.column("kind").to_pylist()) == kind
        of = np.flatnonzero(of)
        out = []
        for c in columns:
            cells = rows.column(c).take(pa.array(of)).to_pylist()
            out.append(np.concatenate([_unplanes(b) for b in cells]) if cells else np.zeros(0, np.int64))
        return out

    def run(rows: pa.Table) -> pa.Table:
        common, counts = frequent.value
        docs, sizes = stacked(rows, 2, "x", "y")
        order = np.argsort(docs)
        docs, sizes = docs[order], sizes[order]
        r_doc, r_gram, r_count = stacked(rows, 1, "x", "y", "z")
        f_doc, f_at = stacked(rows, 3, "x", "y")
        doc = np.searchsorted(docs, np.concatenate([r_doc, f_doc]))
        gram = np.concatenate([r_gram, _signed(common)[f_at]])
        late = np.concatenate([np.zeros(len(r_doc), np.int8), np.ones(len(f_doc), np.int8)])
        count = np.concatenate([r_count, counts[f_at]])
        known = np.bincount(doc, minlength=len(docs))
        alone = sizes - known  # shingles that no other document has: first in the order
        want = prefix_length(sizes, percent)
        open_doc = alone < want
        keep = open_doc[doc]
        doc, gram, late, count = doc[keep], gram[keep], late[keep], count[keep]
        order = np.lexsort((gram, count, late, doc))
        doc, gram = doc[order], gram[order]
        begin = np.searchsorted(doc, np.arange(len(docs)))
        pos = np.arange(len(doc)) - begin[doc] + alone[doc]
        until = np.searchsorted(doc, np.arange(len(docs)), side="right")
        kept = np.flatnonzero(pos < want[doc])
        part = (gram.view(U64) % U64(PARTS)).astype(np.int64)
        rest = np.empty((len(kept), PARTS), np.int32)
        for p in range(PARTS):
            upto = np.concatenate([[0], np.cumsum(part == p)])
            rest[:, p] = upto[until[doc[kept]]] - upto[kept]
        doc, gram, pos = doc[kept], gram[kept], pos[kept]
        rests = pa.ListArray.from_arrays(pa.array(np.arange(0, rest.size + 1, PARTS, dtype=np.int32)), pa.array(rest.ravel()))
        return pa.Table.from_arrays(
            [pa.array(docs[doc]), pa.array(sizes[doc]), pa.array(gram), pa.array(pos), rests], schema=_ENTRY_ARROW
        )

    return run


def _passes(percent: int, n: str, m: str, i: str, j: str, rest: str, other: str) -> Column:
    """Length, positional and suffix filter for sets of n and m shingles that share those at positions i and j."""
    least = F.ceil(F.expr(f"{percent} * ({n} + {m}) / {100 + percent}D"))
    length = F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})")
    position = F.expr(f"1 + least({n} - {i} - 1, {m} - {j} - 1)") >= least
    both = F.aggregate(F.zip_with(rest, other, lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return length & position & (both >= least)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    side = lambda x: sets.select(F.col("doc").alias(x), F.col("grams").alias(f"grams_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - shared
    return both.where(F.lit(100) * shared >= F.lit(percent) * union).select("a", "b")


def _set_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches("text", stream):
            doc, row, gram = _sets(batch, width)
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(doc)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc.astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(_signed(gram)))],
                ["doc", "grams"],
            )

    return docs.join(small(ids), "doc", "left_semi").mapInArrow(run, "doc long, grams array<long>")


def similar_documents(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) for every row: component_id is the smallest id reachable by links."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    texts = rows.where("doc is not null")
    if not texts.groupBy("doc").count().where("count > 1").isEmpty():
        texts = materialize(texts.groupBy("doc").agg(F.max("text").alias("text")), "unique")

    profile = materialize(texts.mapInArrow(_profiles(width), _PROFILE), "profiles")
    meta = profile.where("kind = 0").select(
        F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("s"), F.col("d").alias("t")
    )
    n_docs, n_grams = meta.select(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    copies = materialize(
        meta.where("n > 0").groupBy("s", "t", "n").agg(F.min("doc").alias("same")).where("same is not null"), "copies"
    )
    to_rep = materialize(
        meta.where("n > 0").select("doc", "n", "s", "t").join(copies, ["s", "t", "n"]).select("doc", "same"), "reps"
    )

    frequent = (
        profile.where("kind = 1")
        .groupBy(F.col("a").alias("gram"))
        .agg(F.sum("b").alias("count"))
        .where(F.col("count") >= max(2, n_grams // FREQUENT))
        .toPandas()  # FREQUENT rows at most: each has that share of all shingles
    )
    order = np.argsort(frequent["gram"].to_numpy(np.int64).view(U64))
    held = spark.sparkContext.broadcast(
        (frequent["gram"].to_numpy(np.int64).view(U64)[order], frequent["count"].to_numpy(np.int64)[order])
    )
    gram_buckets = max(LEAST_BUCKETS, n_grams // PER_BUCKET)
    doc_buckets = max(LEAST_BUCKETS, n_docs // 1000)
    shared = (
        texts.mapInArrow(_postings(width, held, gram_buckets), _PACKED)
        .groupBy("bucket")
        .applyInArrow(_shared(doc_buckets), _PACKED)
    )
    own = texts.mapInArrow(_own(width, held, doc_buckets), _PACKED)
    entries = (
        shared.unionByName(own)
        .groupBy("bucket")
        .applyInArrow(_prefixes(held, percent), _ENTRY)
    )
    entries = materialize(entries.join(to_rep.where("doc = same").select("doc"), "doc", "left_semi"), "entries")

    met = entries.groupBy("gram").agg(F.min(F.struct("pos", "doc", "n", "rest")).alias("lead"), F.count("*").alias("k"))
    leaders = met.where("k > 1").select("gram", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("pos", "doc", "n", "rest")])
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    starred = materialize(
        entries.join(leaders, "gram")
        .where("doc <> lead_doc")
        .where(_passes(percent, "n", "lead_n", "pos", "lead_pos", "rest", "lead_rest"))
        .select(*pair("doc", "lead_doc"))
        .distinct(),
        "starred",
    )
    wanted = materialize(starred.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
    sets = materialize(_set_table(texts, wanted, width), "sets")
    links = materialize(_verified(starred, sets, percent), "links")
    label = components(links).withColumnsRenamed({"node": "doc"})

    placed = materialize(
        entries.join(label, "doc", "left").withColumn("component", F.coalesce("component", "doc")), "placed"
    )
    mixed = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rest = placed.join(mixed.select("gram"), "gram")
    # sets that may link are of neighbouring classes of size
    step = max(-math.log(percent / 100), 1e-9) * 1.001
    rest = rest.withColumn("band", F.floor(F.log("n") / step))
    columns = ("doc", "n", "pos", "rest", "component")
    left = rest.select("gram", "band", *[F.col(c).alias(f"{c}_a") for c in columns])
    bands = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    right = rest.select("gram", bands, *[F.col(c).alias(f"{c}_b") for c in columns])
    met_again = (
        left.join(
            right,
            (left.gram == right.gram)
            & (left.band == right.band)
            & F.expr("doc_a < doc_b and component_a <> component_b")
            & _passes(percent, "n_a", "n_b", "pos_a", "pos_b", "rest_a", "rest_b"),
        )
        .select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
        .distinct()
    )
    more = materialize(met_again.join(starred, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        needed = materialize(more.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "wanted")
        new = materialize(needed.join(wanted, "doc", "left_anti"), "new")
        sets = sets.unionByName(materialize(_set_table(texts, new, width), "sets"))
        links = links.unionByName(materialize(_verified(more, sets, percent), "links"))
        label = components(links).withColumnsRenamed({"node": "doc"})

    of_rep = label.withColumnsRenamed({"doc": "same"})
    found = (
        meta.select("doc", "n")
        .join(to_rep, "doc", "left")
        .join(of_rep, "same", "left")
        .select("doc", "n", F.coalesce("component", "same", "doc").alias("component_id"))
    )
    return rows.select("doc").join(found, "doc", "left").select(
        F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


def one_of_each(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that are the smallest id of their component; rows without an id stay.

    Of rows that repeat an id one with the greatest text stays.
    """
    ids = materialize(
        similar_documents(docs, width, percent, id_col, text_col)
        .where(F.col(id_col) != F.col("component_id"))
        .select(id_col)
        .distinct(),
        "dropped",
    )
    kept = docs.join(small(ids), id_col, "left_anti").select(*docs.columns)
    if docs.groupBy(id_col).count().where(F.col("count") > 1).where(F.col(id_col).isNotNull()).isEmpty():
        return kept
    whole = kept.where(F.col(id_col).isNotNull())
    row = F.struct(*docs.columns)
    first = whole.groupBy(id_col).agg(F.max_by(row, F.coalesce(text_col, F.lit(""))).alias("r"))
    return first.select("r.*").select(*docs.columns).unionByName(kept.where(F.col(id_col).isNull()))
