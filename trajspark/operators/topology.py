"""The lane graph: links, reachable lanes, paths, flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import edge_of
from ..functions.numbering import dense_numbers
from ..functions.session import cut_lineage


def lane_links(connections: DataFrame) -> DataFrame:
    """(lane_id, next_lane_id) from connections (from, to, fromLane, toLane, via): a via lane makes two links."""
    start, end = F.concat_ws("_", "from", "fromLane"), F.concat_ws("_", "to", "toLane")
    direct = F.array(F.struct(start.alias("lane_id"), end.alias("next_lane_id")))
    by_way = F.array(
        F.struct(start.alias("lane_id"), F.col("via").alias("next_lane_id")),
        F.struct(F.col("via").alias("lane_id"), end.alias("next_lane_id")),
    )
    return connections.select(F.inline(F.when(F.col("via").isNull(), direct).otherwise(by_way))).distinct()


def lanes_without_successor(links: DataFrame, lanes: DataFrame) -> DataFrame:
    """Lanes that no link starts from, as links to nowhere."""
    return lanes.select("lane_id").distinct().join(links.select("lane_id"), "lane_id", "left_anti").withColumn(
        "next_lane_id", F.lit(None).cast("string")
    )


def link_lengths(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """Links with the lengths of both lanes."""
    after = lengths.select(F.col("lane_id").alias("next_lane_id"), F.col("length").alias("next_lane_length"))
    return links.join(lengths.select("lane_id", F.col("length").alias("lane_length")), "lane_id", "left").join(
        after, "next_lane_id", "left"
    )


def degrees(links: DataFrame) -> DataFrame:
    """(lane_id, n_in, n_out) of all lanes in links."""
    ends = links.where("next_lane_id is not null").select(F.col("next_lane_id").alias("lane_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    starts = links.select("lane_id", F.lit(0).alias("i"), F.col("next_lane_id").isNotNull().cast("int").alias("o"))
    return ends.unionByName(starts).groupBy("lane_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def lane_candidates(links: DataFrame, lengths: DataFrame, hops: int = 2) -> DataFrame:
    """(lane_id, candidate, offset, ahead): lanes within hops, with the least distance between the lanes' starts.

    ahead: the candidate lies downstream, at +offset; else upstream, at -offset. The lane itself is both, at 0.
    """
    size = lengths.select("lane_id", F.coalesce("length", F.lit(0.0)).alias("length"))
    own = lengths.select("lane_id", F.col("lane_id").alias("candidate"), F.lit(0.0).alias("offset")).distinct()
    links = links.where("next_lane_id is not null").select("lane_id", "next_lane_id").distinct()
    out = []
    for ahead in (True, False):
        near, far = ("lane_id", "next_lane_id") if ahead else ("next_lane_id", "lane_id")
        # stepping on adds the length of the upstream lane of the link, in either direction
        step = links.join(size, "lane_id", "left").select(
            F.col(near).alias("candidate"), F.col(far).alias("_to"), F.coalesce("length", F.lit(0.0)).alias("_add")
        )
        reach, all_reached = own, own
        for _ in range(hops):
            reach = (
                reach.join(step, "candidate")
                .groupBy("lane_id", F.col("_to").alias("candidate"))
                .agg(F.min(F.col("offset") + F.col("_add")).alias("offset"))
            )
            all_reached = all_reached.unionByName(reach)
        best = all_reached.groupBy("lane_id", "candidate").agg(F.min("offset").alias("offset"))
        out.append(best.withColumn("ahead", F.lit(ahead)))
    return out[0].unionByName(out[1])


def most_candidates(links: DataFrame, lengths: DataFrame, hops: int = 2) -> int:
    """A bound on the rows of lane_candidates, from the number of lanes and the most links that a lane has on a side."""
    known = degrees(links).agg(F.max("n_in"), F.max("n_out")).first()
    each = sum((d or 0) ** h for d in known for h in range(hops + 1))
    return lengths.count() * max(2, each)


def lane_paths(links: DataFrame, max_paths: int = 10_000_000, hops: int = 4) -> DataFrame:
    """(path array<string>, cut): ways through the lane graph that don't pass a lane twice.

    They start at lanes without predecessor; without such a lane at those that aren't one-in-one-out, and if all are, at
    every lane. A way ends where no link goes on, and also where one would go back to a lane of its own (it is a path as
    far as it came, and the other links go on). The open ways are a table that is extended by some hops at a time and then
    kept, so neither the length of paths nor their number is held in one plan. Once there are more than max_paths ways, the
    search ends, and those that were still open are marked as cut.
    """
    edges = links.where("next_lane_id is not null").select("lane_id", "next_lane_id").distinct()
    rank = F.expr("case when n_in = 0 then 0 when n_in <> 1 or n_out <> 1 then 1 else 2 end")
    ranks = degrees(edges).select("lane_id", rank.alias("rank"))
    least = ranks.agg(F.min("rank")).first()[0]
    # links of a lane: as many as meet at a junction
    ways = edges.groupBy("lane_id").agg(F.sort_array(F.collect_list("next_lane_id")).alias("ways"))
    ways = cut_lineage(ways.withColumnRenamed("lane_id", "lane"))
    found = ranks.where(F.col("rank") == F.lit(least)).select(F.array("lane_id").alias("path"), F.col("lane_id").alias("lane"))
    done: list[DataFrame] = []
    finished = 0
    while True:
        for _ in range(hops):
            found = _one_hop(found, ways)
        found = cut_lineage(found)
        total, left = found.agg(F.count("*"), F.count("lane")).first()
        done.append(found.where("lane is null").select("path", F.lit(False).alias("cut")))
        finished += total - left
        found = found.where("lane is not null")
        if not left:
            break
        if finished + left > max_paths:
            done.append(found.select("path", F.lit(True).alias("cut")))
            break
    return reduce(lambda a, b: a.unionByName(b), done)


def _one_hop(found: DataFrame, ways: DataFrame) -> DataFrame:
    """Each open way (lane: where it is) goes on by every link that leads to a lane it hasn't passed; lane null: at its end."""
    at = found.join(ways, "lane", "left")
    new = F.filter("ways", lambda n: ~F.array_contains("path", n))
    ends = F.col("ways").isNull() | (F.size(new) < F.size("ways"))
    end = F.when(ends, F.array(F.struct(F.col("path"), F.lit(None).cast("string").alias("lane"))))
    on = F.transform(new, lambda n: F.struct(F.array_append("path", n).alias("path"), n.alias("lane")))
    both = F.concat(*[F.coalesce(x, F.array().cast("array<struct<path:array<string>,lane:string>>")) for x in (end, on)])
    return at.select(F.inline(both))


def lane_table(links: DataFrame, lengths: DataFrame) -> DataFrame:
    """All lanes with their links and both lengths, lanes without a link with nulls, in order of the lanes, nulls last."""
    every = links.select("lane_id", "next_lane_id").unionByName(lanes_without_successor(links, lengths)).distinct()
    return link_lengths(every, lengths).select("lane_id", "next_lane_id", "lane_length", "next_lane_length").orderBy(
        F.asc_nulls_last("lane_id"), F.asc_nulls_last("next_lane_id")
    )


def compact_paths(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(path_key, seq, edge_id, length, cumulative): paths by edges, neighbouring lanes of one edge taken together."""
    steps = paths.select(F.array_join("path", ">").alias("path_key"), F.posexplode("path").alias("i", "lane_id"))
    steps = steps.join(lengths.select("lane_id", "length"), "lane_id", "left")
    w = Window.partitionBy("path_key").orderBy("i")
    steps = steps.withColumn("edge_id", edge_of(F.col("lane_id")))
    new = F.coalesce((F.col("edge_id") != F.lag("edge_id").over(w)).cast("int"), F.lit(1))
    steps = steps.withColumn("_n", new).withColumn("seq", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edges = steps.groupBy("path_key", "seq", "edge_id").agg(F.sum("length").alias("length"))
    along = Window.partitionBy("path_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("cumulative", F.sum("length").over(along))


def path_table(compact: DataFrame, links: DataFrame, flows: DataFrame) -> DataFrame:
    """One row for each sequence of edges of compact_paths: its id, length, ends, and the largest flow between them.

    Of lane paths with one sequence of edges the smallest path_key gives the length. from_edge and to_edge are the first
    and last edges that aren't internal (:...); strict_start and strict_end tell whether no link of the graph leads to
    the first or from the last edge. path_id is a hash of the signature, path_no its dense number in order of signatures,
    from 0.
    """
    edges = F.transform(F.array_sort(F.collect_list(F.struct("seq", "edge_id"))), lambda e: e["edge_id"])
    paths = compact.groupBy("path_key").agg(edges.alias("edges"), F.sum("length").alias("path_len"))
    paths = paths.withColumn("signature", F.array_join("edges", ">")).groupBy("signature").agg(
        F.min_by(F.struct("edges", "path_len"), "path_key").alias("p")
    )
    outer = F.filter("p.edges", lambda e: ~e.startswith(":"))
    paths = paths.select(
        F.xxhash64("signature").alias("path_id"), "signature", "p.path_len", F.size("p.edges").cast("long").alias("n_edges"),
        F.get("p.edges", F.lit(0)).alias("start_edge"), F.element_at("p.edges", -1).alias("end_edge"),
        F.get(outer, F.lit(0)).alias("from_edge"), F.try_element_at(outer, F.lit(-1)).alias("to_edge"),
    )
    between = links.where("next_lane_id is not null").select(
        edge_of(F.col("lane_id")).alias("start"), edge_of(F.col("next_lane_id")).alias("end")
    ).where("start <> end")
    entered, left = between.select(F.col("end").alias("start_edge")), between.select(F.col("start").alias("end_edge"))
    for name, key, met in (("strict_start", "start_edge", entered), ("strict_end", "end_edge", left)):
        paths = paths.join(met.distinct().withColumn("_met", F.lit(True)), key, "left").withColumn(name, F.col("_met").isNull()).drop("_met")
    numbers = dense_numbers(paths.select("signature"), "signature").select("signature", (F.col("number") - 1).alias("path_no"))
    paths = paths.join(numbers, "signature")
    return paths.join(largest_flow(flows).drop("vehs_per_hour"), ["from_edge", "to_edge"], "left")


def largest_flow(flows: DataFrame) -> DataFrame:
    """(from_edge, to_edge, flow_id): the flow of most vehicles for each pair of edges, ties to the smaller id."""
    best = F.min(F.struct((-F.col("vehs_per_hour")).alias("v"), F.col("flow_id").alias("f")))
    return flows.groupBy("from_edge", "to_edge").agg(best.alias("b")).select(
        "from_edge", "to_edge", F.col("b.f").alias("flow_id"), (-F.col("b.v")).alias("vehs_per_hour")
    )
