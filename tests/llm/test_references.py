from fleetlens.llm import jaccard


def test_the_reference_of_a_cluster_is_a_hub_that_its_nodes_link_with(spark, monkeypatch):
    """Not one from outside that more of them were compared with."""
    base = [f"w{i}" for i in range(150)]

    def edited(at, mark):
        return [f"{mark}{i}" if i in at else w for i, w in enumerate(base)]

    centre, outside = 0, 1
    near, far = range(10, 20), range(30, 36)
    texts = {centre: base, outside: base[:60] + [f"o{i}" for i in range(90)]}
    texts |= {i: edited({7 * (i - 9)}, f"n{i}_") for i in near}
    texts |= {i: edited({20 * m + i - 25 for m in range(7)}, f"f{i}_") for i in far}
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in texts.items()], "doc_id bigint, text string")
    join = jaccard._Join(docs, 5, 80)
    node = {r.label: (r.node, r.n) for r in join.nodes.collect()}
    entries = spark.createDataFrame(
        [(1, *node[i], node[centre if i == centre or i in near else i][0]) for i in texts], "sig bigint, node bigint, n bigint, comp bigint"
    )
    linked = [(node[i][0], node[centre][0]) for i in near]
    links = spark.createDataFrame(linked, "a bigint, b bigint")
    pairs = links.union(spark.createDataFrame([(node[i][0], node[outside][0]) for i in texts if i != outside], "a bigint, b bigint"))
    used, beside = [], jaccard._Join._beside
    monkeypatch.setattr(jaccard._Join, "_beside", lambda self, of, lists: used.append(of) or beside(self, of, lists))
    found = join.beyond_hubs(entries, pairs, links)
    assert {r.b for r in used[0].collect()} == {node[centre][0]}
    assert {r.a for r in used[0].collect()} == {n for n, _ in node.values()}
    assert {(r.a, r.b) for r in found.collect()} == set(linked)
