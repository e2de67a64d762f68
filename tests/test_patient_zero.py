from flowquarry.operators import graph
from flowquarry.plans import catalog
from flowquarry.sources.alerts import alert_view
from tests.test_analytics import alert_rows, flows


def test_chain_of_eight_hops(spark):
    """Also with a loop back to the end of the chain, which must not keep the walk going."""
    names = [f"10.0.0.{i}" for i in range(10, 19)]
    steps = [*zip(names, names[1:], strict=False), (names[-1], names[0])]
    f = flows(spark, [(k, a, b, 1, 445, 6, 24, 9, 900) for k, (a, b) in enumerate(steps)])
    a = alert_rows(spark, [(k, "HIGH", "LATERAL_MOVEMENT", a, b) for k, (a, b) in enumerate(steps)])
    zero = graph.patient_zero(graph.marked_edges(graph.edges(f), a), graph.compromised(a), spark.createDataFrame([(names[-1],)], "target_ip string")).first()
    assert (zero.patient_zero, zero.hops, zero.path) == (names[0], 8, " -> ".join(names))


def test_compromised_hosts_are_worked_out_once(spark, sf, monkeypatch):
    """And from one scan of the alerts, not one for their sources and one for what lateral movement reached."""
    alerts = alert_view(spark, sf)
    plan = graph.compromised(alerts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
    seen = []
    walk = graph.patient_zero
    monkeypatch.setattr(graph, "patient_zero", lambda edge_rows, hit, targets: seen.append(hit) or walk(edge_rows, hit, targets))
    catalog.QUERIES["g4_patient_zero"](spark, sf)
    assert "Aggregate" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
