"""Application messages projected from the flow view, for queries on decoded messages. The same SQL in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowquarry.sources.flows import flow_view

_FLOW = "flow_id, t_us, src_ip, dst_ip, dst_port, protocol"
VIEWS = {
    "requests": f"select {_FLOW}, method, path, concat(path, query) as uri, host, user_agent, body, tenant from (select {_FLOW}, case when flow_id % 3 = 0 then 'POST' else 'GET' end as method, "
    "case flow_id % 10 when 0 then '/login' when 3 then '/api/v1/auth/x' when 2 then concat('/tenants/t', cast(flow_id % 7 as {text}), '/items') when 7 then '/.env' else concat('/page/', cast(flow_id % 50 as {text})) end as path, "
    "case flow_id % 31 when 0 then '?q=%2527%20or%201=1--' when 5 then '?q=union+select' when 7 then '?q=100%' else '' end as query, "
    "case when flow_id % 101 = 0 then '169.254.169.254' else 'shop.example.com' end as host, "
    "case flow_id % 13 when 0 then 'sqlmap/1.7' when 1 then 'curl/8.0' when 2 then 'python-requests/2' else 'Mozilla/5.0' end as user_agent, "
    "case when flow_id % 37 = 0 then '(UNION SELECT 1)' else '' end as body, case when flow_id % 11 = 0 then concat('x', cast(flow_id % 5 as {text})) end as tenant from {flows}) q",
    "tickets": f"select {_FLOW}, case when flow_id % 3 = 0 then 'AS-REQ' else 'TGS-REQ' end as message, flow_id % 4 <> 0 as preauth, flow_id % 5 = 1 as rc4, "
    "case flow_id % 7 when 0 then {array}'MSSQLSvc', 'db01'{end} when 1 then cast({array}{end} as {strings}) else {array}'cifs', concat('host', cast(flow_id % 3 as {text})){end} end as services from {flows}",
    "calls": f"select {_FLOW}, case flow_id % 9 when 0 then 'drsuapi' when 1 then 'svcctl' when 2 then 'samr' end as interface from {{flows}}",
    "answers": "select concat('site', cast(flow_id % 40 as {text}), '.example.com.') as domain, t_us, case when flow_id % 40 < 5 then 60 + flow_id % 200 else 3600 end as ttl, "
    "case when flow_id % 4 = 0 then {array}src_ip, dst_ip{end} when flow_id % 4 = 1 then {array}concat('203.0.', cast(flow_id % 30 as {text}), '.9'){end} else {array}src_ip{end} end as ips from {flows}",
}


def view_sql(name: str) -> str:
    """The view for the oracle, as a further common table expression behind the flows'."""
    return f", {name} as (" + VIEWS[name].format(text="varchar", array="[", end="]", strings="varchar[]", flows="flows") + ")"


def message_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(VIEWS[name].format(text="string", array="array(", end=")", strings="array<string>", flows="{flows}"), flows=flow_view(spark, sf_dir))
