"""Rounds over version graphs write what they reach, not what is left."""

from pyspark.sql import functions as F

from tessella.operators import genealogy as GE


def tree(spark, n):
    """Node i hangs under (i - 1) / 2, and every fifth under i - 1 too."""
    rows = [(f"n{i}", i, sorted({f"n{(i - 1) // 2}"} | ({f"n{i - 1}"} if i % 5 == 0 else set())) if i else []) for i in range(n)]
    return spark.createDataFrame(rows, "fragment_id string, seq long, parents array<string>")


def test_layers_write_each_chain_about_once(spark, monkeypatch):
    n = 600
    nodes = tree(spark, n)
    edges = GE.known_edges(nodes)
    written, plain = [], GE.cut
    monkeypatch.setattr(GE, "cut", lambda df: _counted(plain, df, written))
    depth = {r[0]: r[1] for r in GE.depths(nodes, edges).collect()}
    want = {}
    for r in nodes.orderBy("seq").collect():
        want[r["fragment_id"]] = max((want[p] + 1 for p in r["parents"]), default=0)
    assert depth == want
    assert sum(written) < 12 * n


def _counted(plain, df, written):
    out = plain(df)
    written.append(out.count())
    return out


def test_ascending_numbers_prove_that_there_is_no_cycle(spark, monkeypatch):
    nodes = tree(spark, 40)
    edges = GE.known_edges(nodes)
    peeled, plain = [], GE.peel
    monkeypatch.setattr(GE, "peel", lambda *a: peeled.append(1) or plain(*a))
    assert not GE.has_cycle(nodes, edges) and not peeled
    back = edges.select("parent", "child").unionByName(spark.createDataFrame([("n39", "n0")], "parent string, child string"))
    assert GE.has_cycle(nodes, back) and peeled
    assert not GE.has_cycle(nodes.withColumn("seq", -F.col("seq")), edges)
    assert GE.has_cycle(nodes.where("seq > 3"), edges) == (not plain(nodes.where("seq > 3"), edges)[1].isEmpty())


def test_depths_of_few_starts_peel_their_ancestors_only(spark, monkeypatch):
    nodes = tree(spark, 300)
    edges = GE.known_edges(nodes)
    sizes, plain = [], GE.depths
    monkeypatch.setattr(GE, "depths", lambda ids, links: sizes.append(ids.count()) or plain(ids, links))
    starts = spark.createDataFrame([("n299",), ("n250",)], "start string")
    got = {r["start"]: (r["depth"], r["ancestors"]) for r in GE.version_records(starts, nodes, edges).collect()}
    whole = {r[0]: r[1] for r in plain(nodes, edges).collect()}
    assert {s: d for s, (d, _) in got.items()} == {s: whole[s] for s in got} and len(got) == 2
    assert sizes == [len(set().union(*(a for _, a in got.values())))]
