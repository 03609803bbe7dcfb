"""Vector compression by product codes with integer arithmetic.

A vector's components become integers floor(scale * x), and each vector is cut into consecutive parts. The work is done
on the *distinct* parts of each position with the number of vectors that have them:

1. Equal parts of a position are counted (with partial sums before the shuffle, so a part that a third of all vectors
   have is one row for each task).
2. Lloyd's rounds over the distinct rows: a task finds the nearest codebook entry of its rows and adds up weight and
   weighted components for each entry; the sums of all tasks give the new entries. The codebooks (parts x entries rows)
   are all that goes through the driver; they are the same size whatever the number of vectors.
3. Codes and errors return to the vectors by a join on position and part. Parts that a 1024th of all vectors or more
   have, at most 1024 in a position, are broadcast; the others are joined by a shuffle, where no key is larger than that.

All of it is exact: distances are whole numbers, computed in double precision where they stay below 2**53 and in 64-bit
integers otherwise.

Defined results: rows whose vector is null, or has a null, NaN or infinite component, are dropped, as are rows whose vector
has another length than the one of the smallest id. A length that parts doesn't divide makes the first parts longer by one;
empty vectors have empty parts, code 0 and no error. Ids may be null (they come last in the order that the first entries
are taken in) or repeated (then the smaller vector is first); each row has its own result row. With fewer vectors than
entries the codebooks have as many entries as there are vectors. An integer of 2**26 or more in size ends the query with an
error, as squared distances might not fit 64 bits. An empty table gives an empty result and empty codebooks. Columns other
than the id are kept if named in `keep`, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, unused

LARGEST = 1 << 26
#: a part (or a group) that one in so many rows has is common
COMMON = 1024


@dataclass(frozen=True)
class Compressed:
    """rows: id, kept columns, codes array<int>, error long; codebooks: one array (entries x width) for each part."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position, as decimal numbers with commas between them."""
        text = ",".join(str(x) for book in self.codebooks for x in book.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()


def whole_vector(v: Column) -> Column:
    """Whether a vector isn't null and all its components are finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & finite, F.lit(False))


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """(begin, end) of the parts of a vector; the first ones are longer by one where parts doesn't divide the length."""
    at = [k * (length // parts) + min(k, length % parts) for k in range(parts + 1)]
    return list(zip(at[:-1], at[1:], strict=True))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the first of several; squared distance) for each row of points; all integers."""
    peak = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = np.float64 if 4 * peak * peak * max(points.shape[1], 1) < 1 << 53 else np.int64
    p, b = points.astype(exact), book.astype(exact)
    distance = (b * b).sum(axis=1)[None, :] - 2 * (p @ b.T)
    code = distance.argmin(axis=1)
    return code, (distance[np.arange(len(p)), code] + (p * p).sum(axis=1)).astype(np.int64)


def _matrix(cells: pa.Array, width: int) -> np.ndarray:
    return cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(cells), width)


def _by_position(batch: pa.RecordBatch, books: list[np.ndarray], slice_rows: int = 8192) -> Iterator[tuple]:
    """(position, rows of the batch, their points, codes, errors), a slice at a time."""
    position = batch.column(0).to_numpy(zero_copy_only=False)
    for k in np.unique(position).tolist():
        of = np.flatnonzero(position == k)
        for i in range(0, len(of), slice_rows):
            at = of[i : i + slice_rows]
            points = _matrix(batch.column(1).take(pa.array(at)), books[k].shape[1])
            yield k, at, points, *nearest(points, books[k])


def _sums(held):
    """One row for each position and entry with the weight and the weighted sum of its parts in this task."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in stream:
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            for k, at, points, code, _ in _by_position(batch, books):
                np.add.at(total[k], code, points * weight[at, None])
                np.add.at(count[k], code, weight[at])
        for k, (t, c) in enumerate(zip(total, count, strict=True)):
            used = np.flatnonzero(c)
            if len(used):
                cells = [row.tolist() for row in t[used]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)),
                     pa.array(c[used]), pa.array(cells, pa.list_(pa.int64()))],
                    ["position", "entry", "weight", "total"],
                )

    return run


def _assigned(held):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for _, at, _, c, e in _by_position(batch, held.value):
                code[at], error[at] = c, e
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(code), pa.array(error)], ["position", "part", "weight", "code", "error"]
            )

    return run


def join_by_weight(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with found (one row a key, with the number `weight` of the rows that have it); each row has its key.

    Keys of a 1024th of the total or more are broadcast, which are few, and the others shuffled.
    """
    common = F.col("weight") * COMMON >= total
    added = [c for c in found.columns if c not in keys and c != "weight"]
    mark = unused(rows, "hot")
    hot = F.broadcast(found.where(common).select(*keys, F.lit(True).alias(mark), *added))
    cold = found.where(~common).select(*keys, *added)
    tried = rows.join(hot, keys, "left")
    columns = [*rows.columns, *added]
    near = tried.where(F.col(mark)).select(*columns)
    return near.unionByName(tried.where(F.col(mark).isNull()).drop(mark, *added).join(cold, keys).select(*columns))


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    keep: Sequence[str] = (),
) -> Compressed:
    """Codes of all vectors, with codebooks that start as the parts of the vectors with the smallest ids."""
    spark = vectors.sparkSession
    ship(spark)
    keep = [c for c in keep if c not in (id_col, "codes", "error")]
    v = F.col(vec_col)
    integer = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    kept = vectors.where(whole_vector(v)).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.struct(*[F.col(c) for c in keep], F.lit(0).alias("_")).alias("kept"),
        F.transform(
            integer,
            lambda x: F.when(F.abs(x) < LARGEST, x.cast("long")).otherwise(
                F.raise_error(F.lit(f"a component is {LARGEST} or more in size after scaling")).cast("long")
            ),
        ).alias("vec"),
    )
    kept = materialize(kept, "vectors")
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(1).collect()
    length = len(first[0].vec) if first else 0
    cuts = bounds(length, parts)
    same = kept.where(F.size("vec") == length)
    firsts = same.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    start = np.array([r.vec for r in firsts], np.int64).reshape(len(firsts), length)
    books = [start[:, i:j].copy() for i, j in cuts]

    pieces = F.explode(
        F.array(*[F.struct(F.lit(k).alias("position"), F.slice("vec", i + 1, j - i).alias("part")) for k, (i, j) in enumerate(cuts)])
    )
    pieced = same.select("row", "id", "kept", pieces.alias("p")).select("row", "id", "kept", "p.position", "p.part")
    distinct = pieced.groupBy("position", "part").agg(F.count("*").alias("weight"))
    distinct = materialize(distinct, "distinct")
    width = max(j - i for i, j in cuts)
    for _ in range(rounds if first else 0):
        held = spark.sparkContext.broadcast(books)
        sums = distinct.mapInArrow(_sums(held), "position int, entry int, weight long, total array<long>")
        found = sums.groupBy("position", "entry").agg(
            F.sum("weight").alias("weight"), *[F.sum(F.get("total", F.lit(c))).alias(f"t{c}") for c in range(width)]
        )
        for r in found.collect():  # parts x entries rows at most
            total = np.array([r[f"t{c}"] for c in range(books[r.position].shape[1])], np.int64)
            books[r.position][r.entry] = total // r.weight
        held.unpersist()
    held = spark.sparkContext.broadcast(books)
    schema = "position int, part array<long>, weight long, code int, error long"
    coded = materialize(distinct.mapInArrow(_assigned(held), schema), "codes")
    n = same.count()
    by_row = (
        join_by_weight(pieced, coded, ["position", "part"], n)
        .groupBy("row")
        .agg(
            F.first("id").alias("id"),
            F.first("kept").alias("kept"),
            F.transform(F.sort_array(F.collect_list(F.struct("position", "code"))), lambda s: s["code"]).alias("codes"),
            F.sum("error").alias("error"),
        )
    )
    own = F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col)
    others = [F.col(f"kept.{c}").alias(c) for c in keep]
    return Compressed(by_row.select(own, *others, "codes", "error"), books)


def with_error_by(rows: DataFrame, column: str, name: str = "label_error") -> DataFrame:
    """rows with the sum of the error over all rows of an equal value of this column; nulls are equal."""
    key = unused(rows, "key")
    rows = materialize(rows.drop(name).withColumn(key, F.struct(F.col(column).alias("v"))), "coded")
    sums = materialize(rows.groupBy(key).agg(F.sum("error").alias(name), F.count("*").alias("weight")), "sums")
    total = sums.agg(F.sum("weight")).first()[0] or 0
    return join_by_weight(rows, sums, [key], total).drop(key)


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, length: int = 64) -> str:
    """The query op11_vector_codes for DuckDB (for vectors of this length)."""
    width = length // parts

    def nearest_sql(book: str) -> str:
        return f"""select d.position, d.part, d.weight, min(b.entry) as code, any_value(d.best) as error from (
          select d.position, d.part, d.weight,
            min(list_inner_product(d.part, d.part) - 2 * list_inner_product(d.part, b.part) + list_inner_product(b.part, b.part)) as best
          from distinct_parts d join {book} b using (position) group by all) d
          join {book} b on b.position = d.position
            and list_inner_product(d.part, d.part) - 2 * list_inner_product(d.part, b.part) + list_inner_product(b.part, b.part) = d.best
          group by d.position, d.part, d.weight"""

    steps = []
    for r in range(rounds):
        steps.append(f"near{r} as materialized ({nearest_sql(f'book{r}')})")
        steps.append(f"""book{r + 1} as materialized (select b.position, b.entry, coalesce(m.part, b.part) as part from book{r} b
          left join (select position, code, list(s order by place) as part from (
            select n.position, n.code, i.place, floor(sum(n.weight * n.part[i.place]) / sum(n.weight)) as s
            from near{r} n, (select unnest(range(1, {width + 1})) as place) i group by all) group by position, code) m
          on m.position = b.position and m.code = b.entry)""")
    finite = "len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    return f"""
    with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({scale}e0 * x::double)) as vec
        from embeddings where embedding is not null and {finite}),
    parts as materialized (select vec_id, label, k as position, vec[k * {width} + 1:(k + 1) * {width}] as part
        from kept, (select unnest(range({parts})) as k)),
    distinct_parts as materialized (select position, part, count(*)::double as weight from parts group by all),
    book0 as materialized (select position, row_number() over (partition by position order by vec_id) - 1 as entry, part
        from parts qualify entry < {entries}),
    {", ".join(steps)},
    final as materialized ({nearest_sql(f'book{rounds}')}),
    digest as (select sha256(string_agg(x::bigint::varchar, ',' order by position, entry, place)) as codebooks_sha256 from (
        select position, entry, unnest(part) as x, generate_subscripts(part, 1) as place from book{rounds})),
    coded as (select p.vec_id, p.label, string_agg(format('{{:02x}}', f.code::bigint), '' order by p.position) as code,
        sum(f.error)::bigint as error from parts p join final f on f.position = p.position and f.part = p.part
        group by p.vec_id, p.label)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
    from coded, digest"""
