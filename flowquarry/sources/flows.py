"""The flow table: its schema, and the flow view that the driver's events are projected to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("flow_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("packets", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("ja4", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
    ]
)

#: The same projection for any SQL engine; ``{us}`` is microseconds since 1970 of an event and ``{stamp}`` makes
#: a time of ``t_us``. Time runs 40,000 times as fast as the events', so that windows of seconds fill.
#: Three events are one conversation, the middle one its answer, so ports and addresses come back reversed; every
#: tenth event is a scanner's, and some are a steady beacon's, a flood's, large uploads, and small TLS messages.
PROJECTION = """
select flow_id, {stamp} as ts, t_us,
  case when back then far else near end as src_ip, case when back then near else far end as dst_ip,
  case when back then far_port else near_port end as src_port, case when back then near_port else far_port end as dst_port,
  protocol, tcp_flags, packets, bytes, domain, ja4, tenant_id
from (
  select event_id as flow_id, tenant_id, kind = 'talk' and event_id % 3 = 1 as back,
    case kind when 'beacon' then 1700100000000000 + n * 60000000 + (event_id % 7) * 500000 when 'flood' then 1700150000000000 + n * 60000
      when 'upload' then 1700110000000000 + n * 20000000
      when 'hop' then 1700120000000000 + n * (case when n % 100 < 50 then 12000000 else 5000000 end) else us end as t_us,
    case kind when 'scan' then '10.0.9.9' when 'beacon' then '10.0.7.7' when 'flood' then concat('10.0.5.', cast(event_id % 61 as {text})) when 'upload' then '10.0.6.6'
      when 'small' then '10.0.8.8' when 'hop' then '10.0.4.4' else concat('10.0.', cast(c % 4 as {text}), '.', cast(c % 25 as {text})) end as near,
    case when kind = 'beacon' then '45.33.32.156' when kind = 'flood' then '10.1.0.80' when kind = 'upload' then '198.51.100.9' when kind = 'small' then '198.51.100.20'
      when kind = 'hop' then concat('10.1.0.', cast(n % 9 as {text}))
      when c % 97 = 0 then '198.51.100.77' when c % 89 = 0 then '198.51.100.200' when c % 20 = 16 then '10.1.0.80' when kind = 'talk' and c % 5 = 0 and c % 2 = 0 then '8.8.8.8'
      when c % 3 = 0 then concat('198.51.100.', cast(c % 50 as {text})) else concat('10.1.0.', cast(c % 50 as {text})) end as far,
    cast(1024 + (c * 7919) % 60000 as int) as near_port,
    cast(case kind when 'scan' then 1000 + event_id % 500 when 'beacon' then 4444 when 'flood' then 80 when 'upload' then 443 when 'small' then 8443 when 'hop' then (case when n % 20 < 10 then 22 when n % 2 = 0 then 445 else 3389 end)
      else case c % 5 when 0 then 53 when 1 then 80 when 2 then 443 when 3 then 445 else 22 end end as int) as far_port,
    cast(case when kind = 'talk' and c % 5 = 0 then 17 else 6 end as int) as protocol,
    cast(case when kind in ('scan', 'flood') then 2 when kind <> 'talk' then 24 when c % 5 = 0 then 0 when event_id % 3 = 0 then 2 when event_id % 3 = 1 then 18
      when c % 6 = 1 then 4 when c % 6 = 2 then 17 else 24 end as int) as tcp_flags,
    case kind when 'upload' then 20000 + event_id % 100 when 'small' then 6 + event_id % 9 when 'flood' then 1 else 1 + event_id % 9 end as packets,
    case kind when 'upload' then (20000 + event_id % 100) * 1200 when 'small' then (6 + event_id % 9) * 300 else amount * (case when event_id % 11 = 0 then 50 else 1 end) end as bytes,
    case when event_id % 5 = 0 then concat(substr(md5(cast(event_id as {text})), 1, cast(5 + event_id % 14 as int)),
      case when event_id % 2 = 0 then '.example.com' else '.net' end) end as domain,
    case event_id % 6 when 0 then 't13d1516h2_8daaf6152771_e562703ab855' when 1 then 't13d1715h2_000000000000_111111111111' end as ja4
  from (
    select event_id, {us} as us, cast(floor(value * 1000) as bigint) as amount, cast(floor(event_id / 3.0) as bigint) as c, cast(floor(event_id / 40.0) as bigint) as n,
      case when user_id % 10 = 0 then 'acme' else 'default' end as tenant_id,
      case when event_id % 40 = 7 then 'beacon' when event_id % 40 = 13 then 'flood' when event_id % 40 = 24 then 'upload' when event_id % 40 = 31 then 'small' when event_id % 40 = 37 then 'hop'
        when user_id % 10 = 0 then 'scan' else 'talk' end as kind
    from {events}
  ) e
) f
"""

#: The largest method that the JVM compiles, in bytes.
JVM_METHOD_BYTES = 8000
_DUCK_MICROS = "((epoch_us(ts) - 1700000000000000) // 40000 + 1700000000000000)"
#: The flow view for the oracle, as a common table expression to put other expressions behind.
FLOWS_SQL = "with flows as (" + PROJECTION.format(stamp="make_timestamp(t_us)", us=_DUCK_MICROS, text="varchar", events="events").replace("\n", " ") + ")"


def compiled_methods(spark: SparkSession) -> None:
    """Generates code in methods of a size that the JVM compiles.

    A stage with the flow view's projection is one method of over 8,000 bytes, which the JVM only interprets. With this limit
    such a stage is worked out by operators whose expressions are split into small methods instead; others stay as they are.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JVM_METHOD_BYTES)


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the test tables: ``PROJECTION`` over their events.

    A filter on flows would be pushed below the projection, with a copy of its cases for each mention of a column; such code is too
    large for the JVM to compile. Spark pushes none below a value that it takes for non-deterministic, as the added zero is.
    """
    compiled_methods(spark)
    micros = "((unix_micros(cast(ts as timestamp)) - 1700000000000000) div 40000 + 1700000000000000)"
    query = PROJECTION.format(stamp="timestamp_micros(t_us)", us=micros, text="string", events="{events}")
    flows = spark.sql(query, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return flows.withColumn("flow_id", F.col("flow_id") + F.monotonically_increasing_id() * 0)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Rows from a JSON hook as flows, with the hook's defaults for what is missing or null."""
    #: The defaults of the telemetry hook.
    defaults = {"src_port": 45000, "protocol": 6, "bytes": 1500, "packets": 10, "tcp_flags": 24}
    kinds = {f.name: f.dataType for f in FLOW_SCHEMA}
    columns = []
    for name, kind in kinds.items():
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        columns.append((F.coalesce(value, F.lit(defaults[name]).cast(kind)) if name in defaults else value).alias(name))
    return rows.select(*columns)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """A flow table written by :func:`write_flows`; partition filters on ``month`` prune files."""
    return spark.read.parquet(path)


def write_flows(flows: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """Flows by month, sorted within files so that row-group statistics prune by time, port and address."""
    month = F.date_format("ts", "yyyyMM").alias("month")
    (
        flows.select("*", month)
        .repartition("month", F.floor(F.col("t_us") / 3_600_000_000))
        .sortWithinPartitions("month", "t_us", "dst_port")
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .option("parquet.bloom.filter.enabled#src_ip", "true")
        .option("parquet.bloom.filter.enabled#dst_ip", "true")
        .partitionBy("month")
        .parquet(path)
    )
