"""Communities by modularity: local moves in rounds, then the same on the graph of communities, until nothing gains.

With m edges, a community's inner edges E and the sum S of its members' degrees, modularity is the sum of
E / m - (S / 2m)^2. All comparisons are made on whole numbers (decimals of 38 digits), so results do not depend
on partitioning. A node without edges stays alone; edges with an unknown or null end, and loops, do not count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder
from .graph import adjacency, communities, pairs_of


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def _written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written to ``folder`` and read back.

    A checkpoint hands on the planner's size estimates; joined with itself turn after turn, the estimate squares
    each time and soon takes longer to multiply than the data to read. Files have their true size.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between two of ``nodes``."""
    known = nodes.select("node").where("node is not null").distinct()
    e = pairs_of(edges)
    return e.join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def modularity(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community: size, inner edges, sum of degrees, and its share of the modularity of ``groups`` (node, community).

    Shares are parts of all edges; in a graph without any they are not a number.
    """
    adj = adjacency(_inside(groups, edges)).join(groups.select("node", "community"), "node")
    other = groups.select(F.col("node").alias("nb"), F.col("community").alias("_nc"))
    sums = adj.join(other, "nb").groupBy("community").agg(
        F.count(F.lit(1)).alias("volume"), F.sum(F.when(F.col("community") == F.col("_nc"), 1).otherwise(0)).alias("_twice")
    )
    size = groups.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    out = size.join(sums, "community", "left").fillna(0, ["volume", "_twice"])
    m2 = sums.agg(F.coalesce(F.sum("volume"), F.lit(0)).alias("m")).first()["m"]
    part = F.col("volume") / float(m2 or 1)
    share = F.col("_twice") / float(m2 or 1) - part * part if m2 else F.lit(float("nan"))
    return out.select("community", "size", F.expr("_twice div 2").alias("internal"), "volume", share.alias("modularity"))


def _candidates(adj: DataFrame, state: DataFrame, m: int, turn: int) -> DataFrame:
    """Nodes that gain by moving: (node, deg, old, any_new, new, gain, rank, level).

    Every turn deals the communities into those that give and those that take. ``any_new`` is the best community
    of all; ``new`` and ``gain`` are set where the node's own gives and a community that takes is a gain: the best
    of them in even turns, a drawn one in odd turns, so that not all nodes of a dense part want the same. ``rank``
    is a drawing that orders the nodes; ``level`` is its binary magnitude, so each level holds about as many
    nodes as all levels before it.
    """
    volume = state.groupBy("community").agg(F.sum("deg").alias("vol"))
    own = state.join(volume, "community").select("node", "deg", F.col("community").alias("old"), F.col("vol").alias("old_vol"))
    links = adj.join(state.select(F.col("node").alias("nb"), "community"), "nb").groupBy("node", "community").agg(F.sum("w").alias("w"))
    x = links.join(volume, "community").join(own, "node")
    mine = F.col("community") == F.col("old")
    x = x.withColumn("worth", _wide(F.col("w")) * _wide(F.lit(2 * m)) - _wide(F.col("deg")) * _wide(F.col("vol")))
    w_old = F.max(F.when(mine, F.col("w")).otherwise(0)).over(Window.partitionBy("node"))
    stay = _wide(F.col("w_old")) * _wide(F.lit(2 * m)) - _wide(F.col("deg")) * _wide(F.col("old_vol") - F.col("deg"))
    x = x.withColumn("w_old", w_old).withColumn("gain", F.col("worth") - stay).where(~mine & (F.col("gain") > 0))
    takes = lambda c: F.xxhash64(c, F.lit(turn)) % 2 == 0
    draw = F.xxhash64("node", "community", F.lit(turn))
    pick = F.struct("gain", draw.alias("draw"), "community") if turn % 2 == 0 else F.struct(draw.alias("draw"), "gain", "community")
    x = x.groupBy("node", "deg", "old").agg(
        F.max(F.struct("gain", draw.alias("draw"), "community"))["community"].alias("any_new"),
        F.max(F.when(~takes(F.col("old")) & takes(F.col("community")), pick)).alias("pick"),
    )
    rank = F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 1)
    return x.select("node", "deg", "old", "any_new", F.col("pick.community").alias("new"), F.col("pick.gain").alias("gain"), rank.alias("rank"), F.length(F.bin(rank)).alias("level"))


def _before(moves: DataFrame, side: str, name: str) -> DataFrame:
    """Degrees that moves of earlier or equal levels bring to (or take from) a community, and its first move.

    Sums per community and level come from an aggregate, so a community that everyone wants to join is no hot
    spot; the window sees at most 64 rows a community.
    """
    per = moves.groupBy(side, "level").agg(F.sum("deg").alias("_s"), F.min(F.struct("rank", "node")).alias("_f"))
    w = Window.partitionBy(side).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(side, "level", F.sum("_s").over(w).alias(f"{name}_sum"), F.min("_f").over(w).alias(f"{name}_first"))


def _allowed(moves: DataFrame) -> DataFrame:
    """Moves of one turn that may be made together: (node, new).

    No community gives and takes in one turn, so a neighbour that moves too never lowers what a move gains by its
    edges. Moves touch each other only through the sums of degrees: a move after others loses at most its degree
    times what they brought to its new community and took from its old one. It is allowed if its gain covers
    that, or if it is the first at both; so modularity grows with every move made, and the candidate of the
    lowest rank of all is always made.
    """
    x = moves.where("new is not null")
    x = x.join(_before(x, "new", "in"), ["new", "level"]).join(_before(x, "old", "out"), ["old", "level"])
    inflow = F.when(F.col("in_first.node") == F.col("node"), 0).otherwise(F.col("in_sum") - F.col("deg"))
    outflow = F.when(F.col("out_first.node") == F.col("node"), 0).otherwise(F.col("out_sum") - F.col("deg"))
    return x.where(F.col("gain") > _wide(F.col("deg")) * _wide(inflow + outflow)).select("node", "new")


def _local_moves(adj: DataFrame, state: DataFrame, m: int, turn: int, folder: str) -> tuple[DataFrame, int, bool]:
    """``state`` (node, deg, community) after moves until none gains, the next turn, and whether anything moved.

    All moves of a turn are made if the score then is higher; neighbours who join the same community often make
    it so. Else only those are made that are sure to gain together. If the deal of a turn leaves no move at
    all, the first candidate alone goes where it likes best.
    """
    moved, score = False, _score(state, adj, m)
    while True:
        moves = _written(_candidates(adj, state, m, turn), folder)
        turn += 1
        found = moves.agg(F.count("new").alias("usable"), F.min(F.struct("rank", "node")).alias("first")).first()
        if found["first"] is None:
            return state, turn, moved
        moved = True
        alone = moves.where(F.col("node") == found["first"]["node"]).select("node", F.col("any_new").alias("new"))
        trial = _after(state, moves.where("new is not null").select("node", "new") if found["usable"] else alone, folder)
        reached = _score(trial, adj, m)
        if reached <= score:
            trial = _after(state, _allowed(moves), folder)
            reached = _score(trial, adj, m)
        state, score = trial, reached


def _after(state: DataFrame, moves: DataFrame, folder: str) -> DataFrame:
    return _written(state.join(moves, "node", "left").select("node", "deg", F.coalesce("new", "community").alias("community")), folder)


def _climb(adj: DataFrame, state: DataFrame, m: int, folder: str) -> DataFrame:
    """Communities (node, deg, community) from which neither a node's move nor a merger of two communities gains."""
    turn, merged_any = 0, True
    while merged_any:
        state, turn, _ = _local_moves(adj, state, m, turn, folder)
        merged_any, level_adj, level = False, adj, state
        while True:  # communities become the nodes of the next level
            ends = level_adj.join(level.select("node", F.col("community").alias("_a")), "node").join(level.select(F.col("node").alias("nb"), F.col("community").alias("_b")), "nb")
            level_adj = _written(ends.where("_a <> _b").groupBy(F.col("_a").alias("node"), F.col("_b").alias("nb")).agg(F.sum("w").alias("w")), folder)
            whole = level.groupBy("community").agg(F.sum("deg").alias("deg"))
            level, turn, merged = _local_moves(level_adj, _written(whole.select(F.col("community").alias("node"), "deg", "community"), folder), m, turn, folder)
            if not merged:
                break
            merged_any = True
            up = level.select(F.col("node").alias("community"), F.col("community").alias("_to"))
            state = _written(state.join(up, "community").select("node", "deg", F.col("_to").alias("community")), folder)
    return state


def modularity_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community), named by the smallest member, for ``nodes`` (node long) and ``edges`` (src, dst).

    Starts from single nodes; should label propagation's communities be better in the end, the climb goes on
    from those, so the result is never below them. Empty tables give empty communities; repeated nodes count once.
    """
    nodes = nodes.select("node").where("node is not null").distinct()
    adj = cut_lineage(adjacency(_inside(nodes, edges)).withColumn("w", F.lit(1).cast("long")))
    m = adj.count() // 2
    if m == 0:
        return nodes.select("node", F.col("node").alias("community"))
    folder = f"{shared_folder(nodes.sparkSession)}/communities-{uuid.uuid4().hex}"
    best = cut_lineage(_best(_written(adj, folder), m, folder))
    _remove(nodes.sparkSession, folder)
    name = best.groupBy("community").agg(F.min("node").alias("_name"))
    named = best.join(name, "community").select("node", F.col("_name").alias("community"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("community", "node").alias("community"))


def _best(adj: DataFrame, m: int, folder: str) -> DataFrame:
    """Communities climbed to from single nodes, or from label propagation's where these are better."""
    deg = adj.groupBy("node").agg(F.sum("w").alias("deg"))
    state = _written(deg.select("node", "deg", F.col("node").alias("community")), folder)
    best = _climb(adj, state, m, folder)
    spread = communities(deg, adj.select(F.col("node").alias("src"), F.col("nb").alias("dst")))
    spread = _written(deg.join(spread, "node").select("node", "deg", "community"), folder)
    if _score(spread, adj, m) > _score(best, adj, m):
        best = _climb(adj, spread, m, folder)
    return best


def _score(state: DataFrame, adj: DataFrame, m: int) -> int:
    """4m * edges of ``adj`` inside communities - sum of squared degree sums, a whole number that grows with modularity."""
    ends = adj.join(state.select("node", "community"), "node").join(state.select(F.col("node").alias("nb"), "community"), ["nb", "community"])
    twice = ends.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("t")).first()["t"]
    vol = _wide(F.col("vol"))
    square = state.groupBy("community").agg(F.sum("deg").alias("vol")).agg(F.sum(vol * vol).alias("s")).first()["s"]
    return 2 * m * int(twice) - int(square)
