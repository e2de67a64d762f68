"""Queries on alerts read one alert for every flow; those that compare alerts with flows read the odd flows' alone."""

from flowquarry.plans import catalog, detection_queries, report_queries
from flowquarry.sources.alerts import ODD, alert_view, odd_alert_view
from flowquarry.sources.flows import flow_view


def test_every_flow_has_an_alert(spark, sf):
    flows = flow_view(spark, sf).count()
    assert alert_view(spark, sf).count() == flows
    assert 0 < odd_alert_view(spark, sf).count() < flows
    for name in ("j8_techniques", "k5_cef", "r4_flowspec", "j11_evidence"):
        assert catalog.QUERIES[name](spark, sf).count() == flows


def test_only_comparisons_leave_flows_out():
    assert {name for name, sql in catalog.ORACLE_SQL.items() if ODD in sql} == {
        "a17_confusion",
        "a13_posture_by_hour",
        "a15_executive_by_hour",
        "e2_score_history",
        "k12_signatures",
    }


def test_queries_on_alerts_leave_no_flow_out():
    whole = (
        "w23_kill_chain g2_compromised g3_blast_radius k9_captures r5_policies e3_ranking f4_alert_page a11_severity_counts a11_category_counts a12_heat_map a13_posture a15_executive "
        "j8_techniques j9_controls k8_navigator k5_cef k6_syslog r1_playbooks r2_containments r3_deliveries r4_flowspec j12_first_matches a18_campaign_metrics"
    )
    for name in whole.split():
        assert "vector_id from flows)" in catalog.ORACLE_SQL[name], name


def test_code_on_alerts_leaves_no_flow_out(spark, sf, monkeypatch):
    """Queries whose SQL reads one alert for every flow are not built on the odd ones alone."""

    def cut(*_):
        raise AssertionError("a query on all alerts reads the odd ones alone")

    for plans in (detection_queries, report_queries):
        monkeypatch.setattr(plans, "odd_alert_view", cut)
    whole = [name for name, sql in catalog.ORACLE_SQL.items() if "vector_id from flows)" in sql]
    assert len(whole) >= 26
    for name in whole:
        catalog.QUERIES[name](spark, sf)
