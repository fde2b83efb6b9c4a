"""Rounds of page_rank move nodes, not links."""

from fleetfold.operators import jobs as J


def plan_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_page_rank_moves_nodes_and_not_links(spark, monkeypatch):
    edges = spark.createDataFrame(
        [(f"s{i % 3}", f"p{i}") for i in range(40)] + [(f"p{i}", f"s{i % 3}") for i in range(40)] + [("s0", "p0"), (None, "p1"), ("p2", None)],
        "src string, dst string",
    )
    plans, write = [], J.materialize
    monkeypatch.setattr(J, "materialize", lambda df, purpose: (plans.append(plan_of(df)), write(df, purpose))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tables = {t.name for t in spark.catalog.listTables()}
    try:
        small = {r.node: r.rank for r in J.page_rank(edges, 2).collect()}
        plans.clear()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = {r.node: r.rank for r in J.page_rank(edges, 2).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert large == small
    # by hand: distinct links, null targets count and are ranked, null sources give nothing
    links = {(r.src, r.dst) for r in edges.collect()}
    n = {}
    for s, _ in links:
        n[s] = n.get(s, 0) + 1
    rank = {s: J.RANK_UNIT for s in n}
    for _ in range(2):
        total = {}
        for s, d in links:
            if s is not None and rank.get(s) is not None:
                total[d] = total.get(d, 0) + rank[s] // n[s]
        rank = {d: J.RANK_UNIT * 15 // 100 + t * 85 // 100 for d, t in total.items()}
    assert {k: v for k, v in small.items()} == rank
    rounds = [p for p in plans if "Bucketed: true" in p and "Join" in p]
    assert len(rounds) == 2
    assert {t.name for t in spark.catalog.listTables()} == tables
