"""Version ancestry as an edge table; graph walks are bounded join loops.

Unary chains, which long histories are made of, are found by pointer doubling and passed in
one step, so rounds grow with the branching between chains, not with the length of a history.
Each round is written to the checkpoint folder; a lost executor repeats one round only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.scale import cut, running_position, skew_join, small_side

# Tables of a walk's rounds that are kept apart.
PIECES = 8


def known_edges(nodes: DataFrame) -> DataFrame:
    """``parent, child, pos`` of links whose parent was stored before the child."""
    links = nodes.select(
        F.col("fragment_id").alias("child"),
        F.col("seq").alias("child_seq"),
        F.posexplode("parents").alias("pos", "parent"),
    )
    parents = nodes.select(F.col("fragment_id").alias("parent"), F.col("seq").alias("parent_seq"))
    joined = skew_join(links, parents, ["parent"], "inner", ["child", "pos"])
    return cut(
        joined.where(F.col("parent_seq") < F.col("child_seq")).select("parent", "child", "pos")
    )


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size("parents") == 0).select("fragment_id")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(
        edges.select(F.col("parent").alias("fragment_id")).distinct(), "fragment_id", "left_anti"
    ).select("fragment_id")


def chains(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unary chains: (``fragment_id, chain, place``) and the edges between chains.

    A link goes from a parent with one child to a child with one parent. Pointers double
    along links until they reach the head of the chain, so a chain of n nodes takes about
    log2(n) rounds, and a round touches only nodes that are not there yet; no two of them
    point to one node. Links on a cycle never get there: their nodes count as chains of their
    own, and the links as edges between them.
    """
    plain = cut(edges.select("parent", "child").distinct())
    one_child = plain.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("parent")
    one_parent = plain.groupBy("child").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("child")
    links = plain.join(one_child, "parent", "left_semi").join(one_parent, "child", "left_semi")
    links = cut(links.select(F.col("child").alias("v"), F.col("parent").alias("to")))
    inner = links.select(F.col("v").alias("to"), F.lit(True).alias("inner"))
    state = cut(links.join(inner, "to", "left").select("v", "to", F.lit(1).cast("long").alias("far"), F.col("inner").isNull().alias("there")))
    n, step = links.count(), 1
    while step <= 2 * n:
        waiting = state.where(~F.col("there"))
        if waiting.isEmpty():
            break
        on = state.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("there").alias("now"))
        moved = waiting.join(on, "to").select("v", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("now").alias("there"))
        state = cut(state.where("there").unionByName(moved))
        step *= 2
    placed = state.where("there").select(F.col("v").alias("fragment_id"), F.col("to").alias("chain"), F.col("far").alias("place"))
    members = cut(
        ids.select("fragment_id").distinct().join(placed, "fragment_id", "left")
        .select("fragment_id", F.coalesce("chain", "fragment_id").alias("chain"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))
    )
    between = cut(plain.join(placed.select(F.col("fragment_id").alias("child")), "child", "left_anti"))
    return members, between


def peel(ids: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest-path depth by peeling layers of chains: (``fragment_id, depth``, left-over edges).

    Chains without open incoming edges form the next layer; their outgoing edges close and
    count down what the chains behind them still wait for. Every edge is closed once. An edge
    knows how many its target waits for, so a round only reads the edges and writes the chains
    that wait for some of theirs, not all that are left.
    Left-over edges exist only on, or behind, a cycle.
    """
    members, between = chains(ids, edges)
    tails = members.select(F.col("fragment_id").alias("parent"), F.col("chain").alias("src"), (F.col("place") + 1).alias("len"))
    needs = between.groupBy(F.col("child").alias("chain")).agg(F.count(F.lit(1)).alias("need"))
    open_edges = cut(
        skew_join(between, tails, ["parent"], "inner", ["child"]).withColumnRenamed("child", "chain")
        .join(needs, "chain").select("src", "chain", "len", "need")
    )
    zero = F.lit(0).cast("long")
    heads = members.where("place = 0").select("chain").join(needs, "chain", "left_anti")
    layer = cut(heads.select("chain", zero.alias("depth")))
    done, waiting = [layer], None
    while (size := layer.count()) > 0:
        marks = small_side(layer.select(F.col("chain").alias("src"), F.col("depth").alias("from")), size)
        sent = open_edges.join(marks, "src").select("chain", "need", F.lit(1).cast("long").alias("closed"), (F.col("from") + F.col("len")).alias("depth"))
        met = sent if waiting is None else sent.unionByName(waiting)
        state = cut(met.groupBy("chain").agg(F.max("need").alias("need"), F.sum("closed").alias("closed"), F.max("depth").alias("depth")))
        layer, waiting = state.where("closed = need").select("chain", "depth"), state.where("closed < need")
        done.append(layer)
    found = cut(
        skew_join(members, cut(reduce(DataFrame.unionByName, done)), ["chain"], "inner", ["fragment_id"])
        .select("fragment_id", (F.col("depth") + F.col("place")).cast("int").alias("depth"))
    )
    closed = found.select(F.col("fragment_id").alias("parent"))
    return found, edges.select("parent", "child").distinct().join(closed, "parent", "left_anti")


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return peel(nodes, edges)[0]


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    """A cycle has a link against the numbers (``seq``) of its nodes, so edges are only peeled
    if there is such a link, or if some end has no number."""
    if "seq" in nodes.columns:
        number = lambda end: nodes.select(F.col("fragment_id").alias(end), F.col("seq").alias(f"{end}_seq"))
        numbered = skew_join(edges.select("parent", "child"), number("parent"), ["parent"], "left", ["child"])
        numbered = skew_join(numbered, number("child"), ["child"], "left", ["parent"])
        if numbered.where(~F.coalesce(F.col("parent_seq") < F.col("child_seq"), F.lit(False))).isEmpty():
            return False
    return not peel(nodes, edges)[1].isEmpty()


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle or between cycles: peeled from both ends."""
    _, behind = peel(nodes, edges)
    turned = behind.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    ends = turned.select(F.explode(F.array("parent", "child")).alias("fragment_id")).distinct()
    _, core = peel(ends, turned)
    return core.select(F.explode(F.array("parent", "child")).alias("fragment_id")).distinct()


def _walk(
    starts: DataFrame, ids: DataFrame, edges: DataFrame, up: bool, max_depth: int | None,
    parts: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Nodes reachable from each start: ``start, fragment_id, distance, path, step``.

    Chains are passed in one step: a round goes from chains to the chains next to them, with
    the least distance and the least path (positions of the edges between chains) of each, and
    repeats only where one of them got smaller. The nodes of all chains follow at the end.
    Depth-first order visits a node by its least path, and the nodes of one chain by ``step``.
    What rounds found stays in the pieces they wrote, and a round looks up only what it meets.
    ``parts``: the ``chains`` of these edges, if they are known.
    """
    members, between = parts or chains(ids, edges)
    first = edges.groupBy("parent", "child").agg(F.min("pos").alias("pos"))
    place = lambda name: members.select(F.col("fragment_id").alias(name), F.col("chain").alias(f"{name}_chain"), F.col("place").alias(f"{name}_at"))
    joined = between.join(first, ["parent", "child"]).join(place("parent"), "parent").join(place("child"), "child")
    near, far = ("child", "parent") if up else ("parent", "child")
    steps = cut(joined.select(
        F.col(f"{near}_chain").alias("chain"), F.col(f"{near}_at").alias("leave"),
        F.col(f"{far}_chain").alias("to_chain"), F.col(f"{far}_at").alias("to_at"), "pos",
    ))
    key = ["start", "chain", "at"]
    empty = F.array().cast("array<int>")
    frontier = cut(
        starts.select("start").distinct().join(members.withColumnRenamed("fragment_id", "start"), "start")
        .select("start", "chain", F.col("place").alias("at"), F.lit(0).cast("long").alias("distance"), empty.alias("path"))
    )
    pieces = [frontier]
    smaller = [F.min("distance").alias("distance"), F.min("path").alias("path")]
    while (size := frontier.count()) > 0:
        moved = (
            steps.join(small_side(frontier, size), "chain")
            .withColumn("distance", F.col("distance") + F.abs(F.col("at") - F.col("leave")) + 1)
            .select("start", F.col("to_chain").alias("chain"), F.col("to_at").alias("at"), "distance", F.concat("path", F.array(F.col("pos").cast("int"))).alias("path"))
        )
        if max_depth is not None:
            moved = moved.where(F.col("distance") <= max_depth)
        # the least of all pieces, and whether this round made it smaller
        fresh = moved.withColumn("new", F.lit(True)).unionByName(reduce(DataFrame.unionByName, pieces).withColumn("new", F.lit(False)))
        of = lambda name, new: F.min(F.when(F.col("new") == new, F.col(name)))
        both = fresh.groupBy(*key).agg(
            *smaller, of("distance", True).alias("d1"), of("path", True).alias("p1"), of("distance", False).alias("d0"), of("path", False).alias("p0")
        )
        better = F.col("d0").isNull() | (F.col("d1") < F.col("d0")) | (F.col("p1") < F.col("p0"))
        frontier = cut(both.where(better).select(*key, "distance", "path"))
        pieces.append(frontier)
        if len(pieces) > PIECES:
            pieces = [cut(reduce(DataFrame.unionByName, pieces).groupBy(*key).agg(*smaller))]
    reached = cut(reduce(DataFrame.unionByName, pieces).groupBy(*key).agg(*smaller))
    inside = F.col("place") <= F.col("at") if up else F.col("place") >= F.col("at")
    step = F.abs(F.col("at") - F.col("place"))
    out = skew_join(members, reached, ["chain"], "inner", ["fragment_id"]).where(inside).select(
        "start", "fragment_id", (F.col("distance") + step).cast("int").alias("distance"), "path", step.alias("step")
    )
    if max_depth is not None:
        out = out.where(F.col("distance") <= max_depth)
    order = F.struct("path", "step")
    return out.groupBy("start", "fragment_id").agg(F.min("distance").alias("distance"), F.min(order).alias("o")).select(
        "start", "fragment_id", "distance", F.col("o.path").alias("path"), F.col("o.step").alias("step")
    )


def ancestors(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``start, fragment_id, distance`` for every start (column ``start``), itself included."""
    return _walk(_known(starts, nodes), nodes, edges, True, max_depth).select("start", "fragment_id", "distance")


def descendants(starts: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    return _walk(_known(starts, nodes), nodes, edges, False, max_depth).select("start", "fragment_id", "distance")


def _known(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    return starts.join(
        nodes.select(F.col("fragment_id").alias("start")), "start", "left_semi"
    ).select("start")


def lineage(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ancestors of each start from far to near: ``start, fragment_id, distance, number``.

    The order is that of a depth-first walk over the parents, turned round, so the start comes
    last. An unknown start is its own lineage. A start's ancestors are numbered in one task, so
    ``number`` is meant for lineages that fit one, whatever the size of the graph.
    """
    found = _walk(_known(starts, nodes), nodes, edges, True, None)
    back = Window.partitionBy("start").orderBy(F.col("path").desc(), F.col("step").desc())
    known = found.select("start", "fragment_id", "distance", F.row_number().over(back).alias("number"))
    unknown = starts.join(nodes.select(F.col("fragment_id").alias("start")), "start", "left_anti").select(
        "start", F.col("start").alias("fragment_id"), F.lit(0).alias("distance"), F.lit(1).alias("number")
    )
    return known.unionByName(unknown)


def remove_node(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop nodes; links of neighbours stay as they are."""
    return nodes.join(ids.select("fragment_id"), "fragment_id", "left_anti")


def model_statistics(nodes: DataFrame) -> DataFrame:
    """``field, value, n`` for models, evaluators and quality sources, plus the total."""
    long = nodes.select(
        F.explode(
            F.array(
                F.struct(F.lit("model").alias("field"), F.col("model_id").alias("value")),
                F.struct(F.lit("evaluator").alias("field"), F.col("evaluator_model_id").alias("value")),
                F.struct(F.lit("quality_source").alias("field"), F.col("quality_source").alias("value")),
                F.struct(F.lit("total").alias("field"), F.lit("all").alias("value")),
            )
        ).alias("e")
    ).select("e.*")
    return long.where(F.col("value") != "").groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def version_history(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per start: depth and the sizes of its ancestor and descendant sets."""
    full = version_records(starts, nodes, edges)
    size = lambda name: F.size(name).cast("long").alias(name)
    return full.select("start", size("ancestors"), size("descendants"), "depth", size("children"), F.size("parents").alias("parents"))


def version_records(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per known start its whole history: ``depth``, ``ancestors`` and ``descendants`` in
    depth-first order, both with the start first, ``parents`` as recorded and ``children``
    by their numbers."""
    known = cut(_known(starts, nodes).distinct())
    numbers = nodes.select(F.col("fragment_id").alias("child"), F.col("seq").alias("child_seq"))
    born = cut(edges.select("parent", "child").distinct().join(numbers, "child").select("parent", "child", F.col("child_seq").alias("pos")))
    parts = chains(nodes, edges)

    def listed(walk: DataFrame, name: str) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("path", "step", "fragment_id")))
        return walk.groupBy("start").agg(F.transform(rows, lambda x: x["fragment_id"]).alias(name))

    walked = cut(_walk(known, nodes, edges, True, None, parts))
    up = listed(walked, "ancestors")
    down = listed(_walk(known, nodes, _by_rank(born), False, None, parts), "descendants")
    own = born.join(small_side(known.withColumnRenamed("start", "parent")), "parent").groupBy(F.col("parent").alias("start")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))), lambda x: x["child"]).alias("children")
    )
    # a depth follows from the ancestors alone
    seen = cut(walked.select("fragment_id").distinct())
    above = edges.join(small_side(seen.select(F.col("fragment_id").alias("child"))), "child", "left_semi")
    depth = depths(seen, cut(above)).withColumnRenamed("fragment_id", "start")
    return (
        known.join(up, "start").join(down, "start").join(depth, "start").join(own, "start", "left")
        .join(nodes.select(F.col("fragment_id").alias("start"), "parents"), "start")
        .select("start", "depth", "ancestors", "descendants", "parents", F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    )


def _by_rank(born: DataFrame) -> DataFrame:
    """Children in the order of their numbers, as edge positions that fit an int."""
    return running_position(born.withColumnRenamed("pos", "order"), ["parent"], ["order", "child"], "pos").select("parent", "child", "pos")
