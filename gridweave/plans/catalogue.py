"""Queries over the test tables, each through the library's operators, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave import schema as S
from gridweave.functions import scalars as X
from gridweave.operators import diagnostics as D
from gridweave.operators.flow import Flow, flow, map_rows
from gridweave.operators.grids import combine_grids, describe_grid, lhs_grid, param_grid, with_metadata
from gridweave.operators.ordinals import numbered
from gridweave.operators.partitioning import Dist, balance_by_weight, balance_longest_first, balance_round_robin, chunk_by, chunk_plan, resolve_layout, waves
from gridweave.operators.runs import run as run_kept
from gridweave.operators.runs import results_of, runs_of, write_result
from gridweave.operators.timeline import as_of
from gridweave.operators.timeline import run_timeline as timeline
from gridweave.plans.flow_plan import dry_run, flow_fingerprint, flow_plan, pending_groups, plan_decision
from gridweave.plans.flow_plan import resource_envelope as envelope
from gridweave.sources import catalog as C
from gridweave.sources import run_store as R
from gridweave.sources.logs import with_context
from gridweave.sources.shared import shared_dir
from gridweave.streaming.registry import append, registry
from gridweave.streaming.watch import windowed_counts
from gridweave.streaming.workers import chunk_marks, progress, worker_alerts

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _region_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by market segments, regions fastest."""
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("region"), F.col("r_regionkey").cast("long").alias("_r"))
    # Segments are a handful; their positions come from their order.
    segments = numbered(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct().withColumn("_o", F.ascii("segment").cast("long")), "_o", name="_s")
    return regions.crossJoin(F.broadcast(segments)).select("region", "segment", (F.col("_r") + (F.col("_s") - 1) * 5).alias("ordinal"))


_GRID_SQL = "select r_name region, segment, r_regionkey + (rank - 1) * 5 as ordinal from region, (select segment, row_number() over (order by ascii(segment)) rank from (select distinct c_mktsegment segment from customer))"


@query(f"select region, segment, row_number() over (order by ordinal) as grid_id, substr(md5(concat_ws(chr(30), region, segment, row_number() over (order by ordinal)::varchar)), 1, 8) as grid_hash from ({_GRID_SQL})")
def grid_cross(spark, sf_dir):
    out = with_metadata(_region_grid(spark, sf_dir), ["region", "segment"])
    return out.select("region", "segment", F.col("`.grid_id`").alias("grid_id"), F.col("`.grid_hash`").alias("grid_hash"))


@query(f"select region, segment, row_number() over (order by ordinal) as grid_id from ({_GRID_SQL}) where region < segment")
def grid_filter(spark, sf_dir):
    out = with_metadata(_region_grid(spark, sf_dir).where("region < segment"), ["region", "segment"])
    return out.select("region", "segment", F.col("`.grid_id`").alias("grid_id"))


@query("select 'nations' as source, n_nationkey as key, n_name as name from nation union all select 'regions', r_regionkey, r_name from region")
def combine_grid_sources(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return combine_grids("source", nations=nations, regions=regions)


@query()
def latin_hypercube(spark, sf_dir):
    return lhs_grid(spark, 200, alpha=(0.0, 1.0), beta=(10.0, 20.0))


@query("select p.parameter, s.stratum, 1::bigint as n from (values ('alpha'), ('beta')) p(parameter), (select unnest(range(200)) as stratum) s")
def latin_hypercube_strata(spark, sf_dir):
    """Each parameter has one point in each stratum."""
    points = lhs_grid(spark, 200, alpha=(0.0, 1.0), beta=(10.0, 20.0)).select(F.inline(F.array(F.struct(F.lit("alpha").alias("parameter"), F.floor(F.col("alpha") * 200).alias("stratum")), F.struct(F.lit("beta").alias("parameter"), F.floor((F.col("beta") - 10) * 20).alias("stratum")))))
    return points.groupBy("parameter", "stratum").agg(F.count("*").alias("n"))


@query("""select 'p_size' as parameter, count(*) as rows, count(distinct p_size) as n_distinct, min(p_size)::varchar as low, max(p_size)::varchar as high from part
union all select 'p_brand', count(*), count(distinct p_brand), min(p_brand), max(p_brand) from part""")
def grid_description(spark, sf_dir):
    return describe_grid(table(spark, sf_dir, "part").select("p_size", "p_brand")).select("parameter", "rows", "n_distinct", F.col("min").alias("low"), F.col("max").alias("high"))


@query("""select chunk, count(*) as n, min(o_orderkey) as first_key, max(o_orderkey) as last_key, o_orderstatus as status from (
select *, ceil(row_number() over (partition by o_orderstatus order by o_orderkey) / 500.0)::bigint as chunk from orders) group by all""")
def chunk_by_group(spark, sf_dir):
    rows = chunk_by(table(spark, sf_dir, "orders"), "o_orderkey", size=500, by=("o_orderstatus",))
    return rows.groupBy(F.col("o_orderstatus").alias("status"), "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""select chunk, count(*) as n, min(p_partkey) as first_key from (
select p_partkey, ceil(row_number() over (order by p_partkey) / ceil(count(*) over () / 7.0))::bigint as chunk from part) group by chunk""")
def chunk_into(spark, sf_dir):
    return chunk_by(table(spark, sf_dir, "part"), "p_partkey", n_chunks=7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("select s_suppkey, ((row_number() over (order by s_suppkey)) - 1) % 7 + 1 as grp from supplier")
def balance_in_turn(spark, sf_dir):
    return balance_round_robin(table(spark, sf_dir, "supplier"), "s_suppkey", 7, "grp").select("s_suppkey", "grp")


@query("""with c as (select *, case when o_totalprice is null then -10001 when o_totalprice = 0 then -10000 when o_totalprice > 0 then floor(log2(o_totalprice::double) * 4) else -20000 - floor(log2(abs(o_totalprice::double)) * 4) end::bigint as class from orders),
r as (select *, row_number() over (order by class desc, o_orderkey) - 1 as place from c)
select (place % 8 + 1)::bigint as "group", count(*) as n, round(sum(o_totalprice), 2) as weight from r group by 1""")
def balance_weights(spark, sf_dir):
    rows = balance_by_weight(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 8)
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("weight"))


@query("""with g as (select *, ceil(o_orderkey_rn / 2000.0)::bigint as chunk from (select *, row_number() over (order by o_orderkey) o_orderkey_rn from orders)),
l as (select chunk, o_orderstatus label, count(*) n, min(o_orderkey) f from g group by all)
select chunk as chunk_id, count(*) as group_count, sum(n)::bigint as row_count, min(f) as first_row, arg_min(label, f) as label from l group by chunk""")
def chunk_plan_table(spark, sf_dir):
    return chunk_plan(chunk_by(table(spark, sf_dir, "orders"), "o_orderkey", size=2000), "chunk", ("o_orderstatus",), "o_orderkey")


@query("select wave, count(*) as n from (select ceil(row_number() over (order by c_custkey) / 300.0)::bigint wave from customer) group by wave")
def wave_sizes(spark, sf_dir):
    return waves(table(spark, sf_dir, "customer"), "c_custkey", 300).groupBy("wave").agg(F.count("*").alias("n"))


@query("""with g as (select c_nationkey, c_mktsegment, count(*) n from customer group by all), t as (select sum(n)::bigint n_rows, count(*) n_groups, ceil(count(*) / 10.0)::bigint groups_per_job from g)
select *, ceil(n_groups / groups_per_job::double)::bigint as n_jobs from t""")
def layout(spark, sf_dir):
    return resolve_layout(table(spark, sf_dir, "customer"), Dist(("c_nationkey", "c_mktsegment"), target_jobs=10))


def _priced(spark, sf_dir) -> Flow:
    grid = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return (
        flow(grid)
        .stage("price", {"net": "l_extendedprice * (1 - l_discount)"}, S.returns(net=S.dbl(), _contract=(S.ctr_field("net", min=0, max=60000),)), skip_when="l_quantity > 45")
        .stage("total", {"gross": "`price.net` * (1 + l_tax)"}, S.returns(gross=S.dbl()), needs=("price",))
    )


_PRICED_SQL = """select l_orderkey, l_linenumber, l_quantity > 45 as skipped, coalesce(l_extendedprice * (1 - l_discount) > 60000, false) and l_quantity <= 45 as broken,
l_extendedprice * (1 - l_discount) as net, l_extendedprice * (1 - l_discount) * (1 + l_tax) as gross from lineitem"""


@query(f"select l_orderkey, l_linenumber, case when not skipped and not broken then net end as net, case when not skipped and not broken then gross end as gross, not broken and not skipped as ok from ({_PRICED_SQL})")
def stage_chain(spark, sf_dir):
    out = _priced(spark, sf_dir).collect()
    return out.select("l_orderkey", "l_linenumber", F.col("`price.net`").alias("net"), F.col("`total.gross`").alias("gross"), F.col("`.ok`").alias("ok"))


@query(f"""with p as ({_PRICED_SQL}), a as (
select 'price' as stage, case when skipped then 'skipped' when broken then 'failed' else 'completed' end as status from p
union all select 'total', case when skipped or broken then 'cancelled' else 'completed' end from p)
select stage, count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
count(*) filter (status = 'cancelled') as cancelled, count(*) filter (status = 'skipped') as skipped from a group by stage""")
def flow_summary(spark, sf_dir):
    return D.stage_summary(D.attempts(_priced(spark, sf_dir).collect(), "run")).drop("median_ms")


@query(f"select l_orderkey, l_linenumber from ({_PRICED_SQL}) where skipped or broken")
def flow_failed_rows(spark, sf_dir):
    return D.failed(_priced(spark, sf_dir).collect()).select("l_orderkey", "l_linenumber")


@query(f"select l_orderkey, l_linenumber, case when not skipped then gross end as gross from ({_PRICED_SQL}) where not broken")
def flow_omit(spark, sf_dir):
    f = _priced(spark, sf_dir)
    return Flow(f.grid, f.stages, error="omit").collect().select("l_orderkey", "l_linenumber", F.col("`total.gross`").alias("gross"))


@query("select o_orderkey, case when o_orderstatus <> 'P' then floor(o_totalprice)::bigint % 7 end as rest, o_orderstatus <> 'P' as ok from orders")
def flow_functions(spark, sf_dir):
    def split(o_totalprice, o_orderstatus):
        if o_orderstatus == "P":
            raise ValueError("pending")
        return round(o_totalprice) % 7

    grid = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("o_totalprice"), "o_orderstatus")
    out = flow(grid, error="keep").stage("part", split, S.returns(rest=S.dbl())).collect()
    return out.select("o_orderkey", F.col("`part.rest`").cast("long").alias("rest"), F.col("`.ok`").alias("ok"))


@query("""with r as (select o_orderkey, o_orderkey % 4 as d, error, kind from orders, (values ('propagate'), ('keep'), ('omit')) e(error), (values ('columns'), ('function')) k(kind))
select o_orderkey, error, kind, (case when d > 0 then 12 // d end)::int as share, (case when d > 0 then 12 // d + 1 when error = 'keep' then 0 end)::int as next, d > 0 as ok, case when d > 0 then 'completed' else 'failed' end as status
from r where d > 0 or error <> 'omit'""")
def flow_error_modes(spark, sf_dir):
    """Stages that raise, of columns and of functions, under each policy that returns rows."""
    grid = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("d"))
    kinds = {"columns": ({"share": "12 div d"}, {"next": "coalesce(`s.share`, -1) + 1"}), "function": (lambda d: 12 // d, lambda share: (-1 if share is None else share) + 1)}
    out = None
    for error in ("propagate", "keep", "omit"):
        for kind, (first, second) in kinds.items():
            f = flow(grid, error=error).stage("s", first, S.returns(share=S.int_())).stage("t", second, S.returns(next=S.int_()), needs=("s",))
            rows = f.collect().select("o_orderkey", F.lit(error).alias("error"), F.lit(kind).alias("kind"), F.col("`s.share`").alias("share"), F.col("`t.next`").alias("next"), F.col("`.ok`").alias("ok"), F.element_at("`.diag`", 1)["status"].alias("status"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("""select o_orderkey, kind, (case when o_orderkey % 2 = 0 then o_orderkey // 2 end)::int as half, (case when round(o_totalprice) = o_totalprice then o_totalprice end)::int as whole, o_orderkey::double as number, null::varchar as text,
(case when o_orderkey % 3 < 2 then o_orderkey % 3 = 1 end) as flag, o_orderstatus as status from orders, (values ('columns'), ('function')) k(kind)""")
def flow_casts(spark, sf_dir):
    """Declared types hold without loss for either kind of stage."""
    grid = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), "o_orderstatus")
    shape = S.returns(half=S.int_(), whole=S.int_(), number=S.dbl(), text=S.chr_(), flag=S.lgl(), status=S.chr_())
    columns = {"half": "o_orderkey / 2", "whole": "price", "number": "o_orderkey", "text": "o_orderkey", "flag": "o_orderkey % 3", "status": "o_orderstatus"}
    function = lambda o_orderkey, price, o_orderstatus: {"half": o_orderkey / 2, "whole": price, "number": o_orderkey, "text": o_orderkey, "flag": o_orderkey % 3, "status": o_orderstatus}
    out = None
    for kind, does in (("columns", columns), ("function", function)):
        rows = flow(grid).stage("s", does, shape).collect().select("o_orderkey", F.lit(kind).alias("kind"), *[F.col(f"`s.{n}`").alias(n) for n, _ in shape.fields])
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""with r as (select p_partkey, p_size, kind, case when p_size is null then 'size: missing' when p_size < 5 then 'size: min' when p_size > 45 then 'size: max' when p_size % 7 = 0 then 'size: predicate' end as broken
from part, (values ('columns'), ('function')) k(kind)) select p_partkey, kind, case when broken is null then p_size end::int as size, broken, broken is null as ok from r""")
def flow_contracts(spark, sf_dir):
    """Every part of a rule is enforced for either kind of stage."""
    rule = S.ctr_field("size", min=5, max=45, allow_na=False, type=S.int_(), predicate=lambda c: c % 7 != 0)
    grid, out = table(spark, sf_dir, "part").select("p_partkey", "p_size"), None
    for kind, does in (("columns", {"size": "p_size"}), ("function", lambda p_size: p_size)):
        made = flow(grid, error="keep").stage("s", does, S.returns(size=S.int_(), _contract=(rule,))).collect()
        rows = made.select("p_partkey", F.lit(kind).alias("kind"), F.col("`s.size`").alias("size"), F.element_at("`.diag`", 1)["error_message"].alias("broken"), F.col("`.ok`").alias("ok"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'completed' else 'failed' end as status, case when o_orderkey % 2 = 1 then 'missing_output: b' end as message from orders""")
def flow_missing_outputs(spark, sf_dir):
    """A declared output that is not returned is an error where the stage says so."""
    does = lambda o_orderkey: {"a": 1, "b": 2} if o_orderkey % 2 == 0 else {"a": 1}
    made = flow(table(spark, sf_dir, "orders").select("o_orderkey")).stage("s", does, S.returns(a=S.int_(), b=S.int_()), io_mode="error").collect()
    return made.select("o_orderkey", F.element_at("`.diag`", 1)["status"].alias("status"), F.element_at("`.diag`", 1)["error_message"].alias("message"))


@query("""select o_orderkey, o_orderkey % 5 in (0, 1) as ok, case when o_orderkey % 5 not in (0, 1) then 'validation' end as error_class from orders""")
def flow_flexible_types(spark, sf_dir):
    """Union and predicate types, checked value by value."""
    values = [3, "text", 3.5, [1], None]
    kind = S.one_of(S.pred(lambda v: isinstance(v, int) and v > 2), S.isa("str"))
    made = flow(table(spark, sf_dir, "orders").select("o_orderkey")).stage("s", lambda o_orderkey: {"v": values[o_orderkey % 5]}, S.returns(v=kind)).collect()
    return made.select("o_orderkey", F.col("`.ok`").alias("ok"), F.element_at("`.diag`", 1)["error_class"].alias("error_class"))


@query("select o_orderkey, case when round(o_totalprice) = o_totalprice then o_totalprice::int end as whole, case when o_orderkey % 4 = 0 then (o_orderkey // 4)::int end as quarter from orders")
def lossless_cast(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.lossless_int(F.col("o_totalprice")).alias("whole"), X.lossless_int(F.col("o_orderkey") / 4).alias("quarter"))


@query("select doc_id, lang || '#' || length(text) as tag, len(string_split(text, ' ')) as n from documents")
def map_elements(spark, sf_dir):
    def tag(text, lang):
        return {"tag": f"{lang}#{len(text)}", "n": len(text.split(" "))}

    return map_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), tag, "doc_id long, tag string, n long")


_PLAN_SQL = "select o_orderkey, s.stage, o_orderstatus = 'P' as dep, o_orderkey % 3 = 0 as have, s.over from orders, (values ('fit', 'skip'), ('save', 'overwrite'), ('send', 'error')) s(stage, over)"


@query(f"""select action, reason_code, count(*) as n from (select
case when dep and stage <> 'fit' then 'blocked' when have and over = 'error' then 'blocked' when have and over = 'skip' then 'reuse' else 'execute' end as action,
case when dep and stage <> 'fit' then 'missing_dependency' when have and over = 'error' then 'artifact_conflict' when have and over = 'skip' then 'artifact_exists' when have then 'overwrite_policy' else 'artifact_missing' end as reason_code
from ({_PLAN_SQL})) group by all""")
def plan_actions(spark, sf_dir):
    stages = spark.createDataFrame([("fit", "skip"), ("save", "overwrite"), ("send", "error")], "stage string, over string")
    rows = table(spark, sf_dir, "orders").crossJoin(F.broadcast(stages))
    no = F.lit(False)
    d = plan_decision((F.col("o_orderstatus") == "P") & (F.col("stage") != "fit"), no, no, F.lit("off"), F.lit(True), F.col("o_orderkey") % 3 == 0, F.col("over"))
    return dry_run(rows.select(F.inline(F.array(d))))


@query("select 'total' as stage, 'execute' as action, 'no_sink' as reason_code, count(*) as n from lineitem union all select 'price', case when o_orderkey is not null then 'reuse' else 'execute' end, case when o_orderkey is not null then 'artifact_exists' else 'artifact_missing' end, count(*) from lineitem left join (select o_orderkey from orders where o_orderstatus = 'F') on l_orderkey = o_orderkey group by 1, 2, 3")
def plan_of_flow(spark, sf_dir):
    named = lambda key: F.concat(F.lit("/a/"), F.col(key).cast("string"))
    where, files = named("l_orderkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(named("o_orderkey").alias("path"))
    return flow_plan(_priced(spark, sf_dir), files, {"price": where}).groupBy("stage", "action", "reason_code").agg(F.count("*").alias("n"))


@query()
def plan_fingerprint(spark, sf_dir):
    return flow_fingerprint(_priced(spark, sf_dir))


@query("select 'same rows in other partitions' as change, true as same union all select 'one row less', false union all select 'another stage', false")
def plan_fingerprint_changes(spark, sf_dir):
    """What changes a flow's fingerprint and what does not."""
    f = _priced(spark, sf_dir)
    least = f.grid.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))
    others = {
        "same rows in other partitions": Flow(f.grid.repartition(7), f.stages),
        "one row less": Flow(f.grid.join(F.broadcast(least), F.struct("l_orderkey", "l_linenumber") == F.col("m"), "left_anti"), f.stages),
        "another stage": f.stage("more", {"z": "1"}, S.returns(z=S.int_())),
    }
    own, out = flow_fingerprint(f).select(F.col("fingerprint").alias("own")), None
    for change, other in others.items():
        row = flow_fingerprint(other).crossJoin(F.broadcast(own)).select(F.lit(change).alias("change"), (F.col("own") == F.col("fingerprint")).alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


@query("select c_nationkey, c_mktsegment from customer group by all having not bool_and(c_acctbal > 0)")
def prune_groups(spark, sf_dir):
    return pending_groups(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], F.col("c_acctbal") > 0)


@query("select event_type, count(*) as n from events group by event_type")
def event_counts(spark, sf_dir):
    return R.event_counts(table(spark, sf_dir, "events"))


@query("select event_id, user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def events_last_n(spark, sf_dir):
    return R.last_n_by_key(table(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 3).select("event_id", "user_id", "event_type")


@query("select event_id from events where event_type in ('error') order by event_id desc limit 50")
def events_read(spark, sf_dir):
    return R.read_events(table(spark, sf_dir, "events"), types=["error"], last_n=50, order="event_id").select("event_id")


@query("""select user_id, arg_max(case when value > 100 then value end, event_id) filter (value > 100) as value, arg_max(event_type, event_id) as event_type, min(event_id) as first_seq from events group by user_id""")
def registry_compact(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 100, F.col("value")))
    return R.compact(rows, "user_id", "event_id", ["value", "event_type"])


@query("""with o as (select c_custkey k, c_acctbal bal, c_mktsegment seg from customer where c_mktsegment <> 'BUILDING'), n as (select c_custkey k, case when c_acctbal > 7000 then -1.0 end bal, 'new' seg from customer where c_acctbal > 4000)
select coalesce(o.k, n.k) as k, coalesce(n.bal, o.bal) as bal, coalesce(n.seg, o.seg) as seg from o full join n on o.k = n.k""")
def status_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    new = c.where("c_acctbal > 4000").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 7000, F.lit(-1.0)).alias("bal"), F.lit("new").alias("seg"))
    return R.merged(old, new, "k")


@query("select md5(o_custkey::varchar) as param_hash, max(o_orderkey) as o_orderkey from orders where o_orderstatus <> 'P' and o_custkey in (select o_custkey from orders where o_orderpriority like '1%') group by o_custkey")
def manifest_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"param_hash": F.md5(F.col("o_custkey").cast("string")), "output_names": F.array(F.col("o_orderstatus") != "P").cast("array<string>")})
    wanted = o.where("o_orderpriority like '1%'").select("param_hash", F.array(F.lit("true")).alias("output_names")).distinct()
    return R.manifest_latest(o, wanted, "o_orderkey").select("param_hash", "o_orderkey")


@query("""with p as (select n_nationkey id, map_from_entries([('a', (n_nationkey % 2)::varchar), ('b', (n_nationkey % 3)::varchar)]) m, 2 n from nation
), q as (select n_nationkey id, 'a' k, (n_nationkey % 2)::varchar v from nation where n_regionkey = 1 union all select n_nationkey, 'b', (n_nationkey % 3)::varchar from nation where n_regionkey = 2)
select p.id as wanted_id, q.id as record_id from p join q on p.m[q.k] = q.v""")
def manifest_subset(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 2).cast("string").alias("a"), (F.col("n_nationkey") % 3).cast("string").alias("b"))
    own = n.select("id", F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b")).alias("params"))
    one = n.where("n_regionkey = 1").select("id", F.create_map(F.lit("a"), F.col("a")).alias("params")).unionByName(n.where("n_regionkey = 2").select("id", F.create_map(F.lit("b"), F.col("b")).alias("params")))
    return R.manifest_subset(one, own)


@query("select page_id from pages where regexp_matches(coalesce(url, ''), '(?i)[0-9]7')")
def catalog_search(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return C.catalog_search(rows, "[0-9]7", fields=("path",)).select("page_id")


@query("select page_id, page_id % 3 = 0 as held, case when page_id % 3 = 0 then 'fit' end as stage from pages")
def sidecar_semi(spark, sf_dir):
    """Files with the sidecars of those that have one."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/a/"), F.col("page_id").cast("string")).alias("path"))
    sides = p.where("page_id % 3 = 0").select("path", F.lit('{"stage": "fit", "bytes": 7}').alias("value"))
    return C.with_sidecars(p, sides).select("page_id", F.col("_s").isNotNull().alias("held"), F.col("_s.stage").alias("stage"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def missing_index(spark, sf_dir):
    jobs = table(spark, sf_dir, "customer").select("c_custkey", F.lit("FAILED").alias("state"))
    return D.missing_results(jobs, table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey")


@query("""select user_id, n, event_type, is_match from (select *, max(is_match) over (partition by user_id order by n rows between 3 preceding and 3 following) near from (
select user_id, row_number() over (partition by user_id order by event_id) n, event_type, event_type = 'error' as is_match from events)) where near""")
def log_context(spark, sf_dir):
    lines = numbered(table(spark, sf_dir, "events"), "event_id", ("user_id",), name="n")
    return with_context(lines, F.col("event_type") == "error", "user_id", "n", 3, 3, block=32).select("user_id", "n", "event_type", "is_match")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def props_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return R.parsed_lines(rows, S.record("k string")).select("event_id", "k")


@query("""select event_id, md5(regexp_replace(trim(regexp_replace('Error at line ' || event_id || ' in /tmp/run' || user_id || '/model.R: bad ' || event_type, '\\bat\\s+line\\s+\\d+', 'at line <N>', 'gi').replace('/tmp/run' || user_id || '/model.R:', '<path>/model.R:')), '\\s+', ' ', 'g')) as fp from events""".replace("regexp_replace('Error", "regexp_replace('Error").replace(".replace('/tmp/run' || user_id || '/model.R:', '<path>/model.R:')", ""))
def message_fingerprints(spark, sf_dir):
    message = F.concat(F.lit("Error at line "), F.col("event_id").cast("string"), F.lit(" in /tmp/run"), F.col("user_id").cast("string"), F.lit("/model.R: bad "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.message_fingerprint(message).alias("fp"))


ORACLE_SQL["message_fingerprints"] = "select event_id, md5('Error at line <N> in <path>/model.R: bad ' || event_type) as fp from events"


@query("""with e as (select event_type || ' ' || user_id as message, day(ts) as run from events),
t as (select message, min(run) first_seen, max(run) last_seen, count(distinct run) n_runs from e group by message)
select md5(message) as fingerprint, message, split_part(message, ' ', 1) as class, first_seen, last_seen, n_runs, case when n_runs = (select max(run) from e) then 'persistent' when first_seen = (select max(run) from e) then 'new' when last_seen < (select max(run) from e) then 'resolved' else 'flaky' end as pattern from t""")
def failure_patterns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("message"), F.dayofmonth("ts").cast("long").alias("run_idx"), F.col("event_type").alias("class"))
    return D.failure_patterns(e)


@query("""select event_id, date_diff('second', date_trunc('second', s), date_trunc('second', ts)) - case when (epoch_us(ts) % 1000000) < (epoch_us(s) % 1000000) then 1 else 0 end as offset_s from (select *, min(ts) over (partition by user_id) s from events)""")
def failure_timeline(spark, sf_dir):
    return D.failure_timeline(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "offset_s")


_STATES = "case event_id % 6 when 0 then 'OUT_OF_MEMORY' when 1 then 'TIMEOUT' when 2 then 'CANCELLED' when 3 then 'NODE_FAIL' when 4 then 'FAILED' else 'COMPLETED' end"


@query(f"""select class, count(*) as n from (select case when s = 'OUT_OF_MEMORY' or event_id % 10 = 9 then 'oom' when s = 'TIMEOUT' then 'timeout' when s in ('CANCELLED', 'NODE_FAIL') then 'slurm_infra'
when event_type = 'view' then 'dependency' when event_type = 'click' then 'validation' when event_type = 'error' then 'r_error' when s = 'FAILED' then 'r_crash' else 'unknown' end as class from (select *, {_STATES} s from events)) group by class""")
def failure_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", F.expr(_STATES))
    kind = F.when(F.col("event_type") == "click", "contract")
    status = F.when(F.col("event_type") == "view", "cancelled").when(F.col("event_type") == "error", "failed").otherwise("completed")
    return D.failure_report(e.select(D.classify_failure(F.col("s"), F.when(F.col("event_id") % 10 == 9, 9), kind, status).alias("class")))


@query("""select event_id, case event_id % 4 when 0 then 'oom' when 1 then 'timeout' when 2 then 'r_error' else 'slurm_infra' end as class, case event_id % 4 when 0 then 'OOM' when 1 then 'TIMEOUT' when 2 then 'ERROR' else 'NODE_FAIL' end as label,
case event_id % 4 when 0 then 'killed for memory at 3.0G against 2G' when 1 then 'out of time after 1:00:' || lpad((event_id % 60)::varchar, 2, '0') when 2 then event_type else 'a node failed' end as detail,
case event_id % 4 when 0 then 'ask for 3G of memory' when 1 then 'ask for 3:00:00 of time' when 3 then 'run it again' end as suggestion from events""")
def failure_details(spark, sf_dir):
    k = F.col("event_id") % 4
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(k == 0, "OUT_OF_MEMORY").when(k == 1, "TIMEOUT").when(k == 3, "NODE_FAIL").alias("state"), F.lit(None).cast("int").alias("signal"), F.when(k == 2, "ValueError").alias("error_class"), F.col("event_type").alias("error_message"),
        F.when(k == 2, "failed").alias("status"), F.lit(3 * 1024**3).cast("long").alias("max_rss"), F.lit("2G").alias("requested_memory"), (3600 + F.col("event_id") % 60).alias("elapsed_seconds"),
    )
    return D.failure_details(e).select("event_id", "class", "label", "detail", "suggestion")


@query("select event_type as stage, count(*) as total, count(*) filter (user_id % 3 = 0) as completed, count(*) filter (user_id % 3 = 1) as failed, count(*) filter (user_id % 3 = 2) as cancelled, 0::bigint as skipped, round(median(value), 4) as median_ms from events group by event_type union all select 'idle', 0, 0, 0, 0, 0, null")
def attempt_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), F.element_at(F.array(*map(F.lit, ("completed", "failed", "cancelled"))), (F.col("user_id") % 3 + 1).cast("int")).alias("status"))
    stages = spark.createDataFrame([(s,) for s in ("signup", "purchase", "error", "view", "click", "idle")], "stage string")
    return D.stage_summary(e, stages).withColumn("median_ms", F.round("median_ms", 4))


@query("select user_id as chunk_id, count(*) as n_elements, count(*) filter (event_type = 'error') as n_errors, coalesce(sum(event_id) filter (event_type = 'error'), 0)::bigint as error_sum from events group by user_id")
def packed_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("index"), (F.col("event_type") == "error").alias("is_error"))
    # Users have errors in several blocks of indices.
    rows = D.packed_errors(e).withColumn("own", F.aggregate("error_indices", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.groupBy("chunk_id").agg(F.sum("n_elements").alias("n_elements"), F.sum("n_errors").alias("n_errors"), F.sum("own").alias("error_sum"))


@query("select o_orderkey, (o_orderkey // 3600)::varchar || ':' || lpad(((o_orderkey % 3600) // 60)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') as t, '+' || (o_orderkey // 3600)::varchar || ':' || lpad(((o_orderkey % 3600) // 60)::varchar, 2, '0') || ':' || lpad((o_orderkey % 60)::varchar, 2, '0') as off, o_orderkey::double as back from orders")
def hms_format(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.hms(k).alias("t"), X.offset(k).alias("off"), X.parse_hms(F.concat(F.lpad(F.floor(k / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(k % 3600 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))).alias("back"))


@query("""select p_partkey, p_size * case p_partkey % 4 when 0 then 1024::double when 1 then 1048576::double when 2 then 1073741824::double else 1::double end as bytes,
case when p_partkey % 4 = 3 then p_size::varchar || 'B' else p_size::varchar || '.0' || case p_partkey % 4 when 0 then 'K' when 1 then 'M' else 'G' end end as shown from part""")
def parse_memory(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("K", "m", "G", ""))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", X.parse_memory(text).alias("bytes")).withColumn("shown", X.format_bytes(F.col("bytes")))


@query("""select p_partkey, case p_partkey % 3 when 0 then p_size::varchar || ':00:00' when 1 then (p_size // 60)::varchar || ':' || lpad((p_size % 60)::varchar, 2, '0') || ':00' else p_size::varchar || ':05:00' end as t from part""")
def normal_time(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit(" Hours"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("min"))).otherwise(F.concat(size, F.lit(":05")))
    return table(spark, sf_dir, "part").select("p_partkey", X.normal_time(text).alias("t"))


@query("select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(p_name || ' /' || p_type, '\\s+', '-', 'g'), '[^A-Za-z0-9_.+-]', '-', 'g'), '-{2,}', '-', 'g'), '-') as name, 'job-' || lpad(p_partkey::varchar, 5, '0') as idx, 'job-' || left(md5(p_name), 8) as dig from part")
def job_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_name(F.concat(F.col("p_name"), F.lit(" /"), F.col("p_type"))).alias("name"), X.indexed_name(F.col("p_partkey"), "job", 5).alias("idx"), X.digest_name(F.col("p_name")).alias("dig"))


@query("select page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\\.[^.]*$', '\\1') as stem from pages")
def path_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.stem(F.col("url")).alias("stem"))


@query("""select p_brand, max(p_size) as cpus, max(floor(p_retailprice)::bigint)::varchar || 'M' as memory, (max(p_size) // 60)::varchar || ':' || lpad((max(p_size) % 60)::varchar, 2, '0') || ':00' as time from part group by p_brand""")
def resource_envelope(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asks = p.select("p_brand", F.col("p_size").alias("cpus"), F.concat(F.floor("p_retailprice").cast("long").cast("string"), F.lit("M")).alias("memory"), F.concat(F.col("p_size").cast("string"), F.lit("min")).alias("time"))
    return envelope(asks, "p_brand")


@query("""with j as (select c_custkey, case c_custkey % 4 when 0 then 'FAILED' when 1 then 'TIMEOUT' when 2 then 'COMPLETED' else 'RUNNING' end as state from customer), h as (select distinct o_custkey from orders)
select o_custkey as chunk_id, o_orderkey::varchar as row_id, 'fit' as stage, 'late' as error_msg, 'index' as source, case when state = 'TIMEOUT' then 'timeout' else 'r_error' end as class from orders left join j on c_custkey = o_custkey where o_orderstatus = 'P'
union all select c_custkey, null, null, lower(state) || ' without a result', 'missing', case state when 'TIMEOUT' then 'timeout' else 'r_crash' end from j where state <> 'RUNNING' and c_custkey not in (select o_custkey from h)""")
def error_table(spark, sf_dir):
    """Errors in results, joined to their chunks' states, under those of chunks without a result."""
    o = table(spark, sf_dir, "orders")
    bad = F.col("o_orderstatus") == "P"
    one = F.struct(F.lit("fit").alias("stage"), (~bad).alias("ok"), F.lit(False).alias("skipped"), F.when(bad, "failed").otherwise("completed").alias("status"), F.when(bad, "ValueError").alias("error_class"), F.when(bad, "late").alias("error_message"))
    results = o.select(F.col("o_custkey").alias("chunk_id"), F.col("o_orderkey").cast("string").alias("row_id"), F.array(one).alias(".diag"))
    state = F.element_at(F.array(*map(F.lit, ("FAILED", "TIMEOUT", "COMPLETED", "RUNNING"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), state.alias("state"))
    return D.run_errors(results, jobs).drop("context")


@query("""select n_nationkey, sha1('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as row_key from nation""")
def row_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", X.row_key("n_nationkey", "n_name", "n_regionkey").alias("row_key"))


@query("select time_bucket(interval '1 day', ts) as window_start, event_type, count(*) as n from events group by all")
def event_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "ts", "1 day").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""select user_id, case when user_id % 4 = 0 then 'submission_failed after ' || (user_id % 5) || '/9 jobs: quota' when user_id % 5 < 4 and user_id % 4 = 1 then 'submission incomplete; ' || (user_id % 5) || ' submitted, ' || (4 - user_id % 5) || ' unsubmitted'
when user_id % 3 = 0 then '1/' || (user_id % 5) || ' submitted jobs failed' when user_id % 5 > 0 then 'all ' || (user_id % 5) || ' submitted jobs finished' else 'run recorded' end as line from (select distinct user_id from events)""")
def run_diagnosis(spark, sf_dir):
    u = F.col("user_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    expected = F.when(u % 4 == 0, 9).when(u % 4 == 1, 4)
    return users.select("user_id", D.run_diagnosis(expected, u % 5, u % 5, F.when(u % 3 == 0, 1).otherwise(0), F.when(u % 4 == 0, "failed"), F.lit("quota")).alias("line"))


@query("""select o_orderkey, ceil(row_number() over (partition by p order by o_orderkey) / ceil(count(*) over (partition by p) / 7.0))::bigint as chunk
from (select o_orderkey, nullif(o_orderpriority, '5-LOW') p from orders)""")
def chunk_null_groups(spark, sf_dir):
    """Chunks within groups, of which one has no name."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return chunk_by(rows, "o_orderkey", n_chunks=7, by=("p",)).select("o_orderkey", "chunk")


@query("""select user_id, n, is_match from (select *, max(is_match) over (partition by user_id order by n rows between 70 preceding and 40 following) near from (
select user_id, row_number() over (partition by user_id order by event_id) n, event_id % 97 = 3 as is_match from events)) where near""")
def context_beyond_block(spark, sf_dir):
    """Context longer than the blocks that lines are handled in."""
    lines = numbered(table(spark, sf_dir, "events"), "event_id", ("user_id",), name="n")
    return with_context(lines, F.col("event_id") % 97 == 3, "user_id", "n", before=40, after=70, block=16).select("user_id", "n", "is_match")


@query("select true as fits, count(*) as n from lineitem")
def flow_random_columns(spark, sf_dir):
    """A stage whose expression draws at random whether it raises: each row is either whole or a failure."""
    out = flow(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), error="keep").stage("draw", {"v": "if(rand() < 0.5, 1 div 0, l_linenumber)"}, S.returns(v=S.int_()))
    value, ok = F.col("`draw.v`"), F.col("`.ok`")
    return out.collect().groupBy(((ok & (value == F.col("l_linenumber"))) | (~ok & value.isNull())).alias("fits")).agg(F.count("*").alias("n"))


@query("""with b as (select distinct user_id::varchar as run_id, user_id % 3 as chunk_id, ts from events where event_type in ('view', 'click', 'signup')),
g as (select *, lag(ts) over (partition by run_id, chunk_id order by ts) as last from b)
select run_id, chunk_id, 'silent' as alert, last + interval 6 hour as at, last from g where ts - last > interval 6 hour
union all select run_id, chunk_id, 'returned', ts, last from g where ts - last > interval 6 hour""")
def worker_silences(spark, sf_dir):
    """Times in which nothing was heard of a worker and its return, from keyed state."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "worker_heartbeat").when(F.col("event_type") == "signup", "stage_started").otherwise("user_log")
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), (F.col("user_id") % 3).alias("chunk_id"), kind.alias("event_type"), "ts")
    out = worker_alerts(rows, gap_s=6 * 3600)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "last")})


@query("select event_type as run_id, count(distinct user_id) as chunks_done from events group by event_type")
def chunk_progress(spark, sf_dir):
    """Chunks done of each run, each once however often it is told."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), F.col("user_id").alias("chunk_id"), F.lit("chunk_completed").alias("event_type"), "ts")
    return progress(chunk_marks(rows)).select("run_id", "chunks_done")


@query("""with c as (select count(*) as n, sum(c_nationkey * 3 + 1)::bigint as one, sum(c_nationkey * 3 + 2)::bigint as two, sum(c_nationkey * 3)::bigint as three from customer)
select '1' as run_id, 'scale' as stage, n as executed, 0 as reused, three as total from c union all select '1', 'shift', n, 0, one from c
union all select '2', 'scale', 0, n, three from c union all select '2', 'shift', 0, n, one from c
union all select '3', 'scale', 0, n, three from c union all select '3', 'shift', n, 0, two from c""")
def flow_resume(spark, sf_dir):
    """A flow run three times over one store: whole, again with no call, and with its second stage changed. For how many
    rows each stage was called, how many were read, and the sum of its results."""
    grid = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    store = f"{shared_dir(spark)}/flows/{uuid.uuid4().hex}"
    sums = None
    for run_id, by in (("1", 1), ("2", 1), ("3", 2)):
        f = flow(grid, run_id=run_id).stage("scale", lambda c_nationkey: {"y": c_nationkey * 3}, S.returns(y=S.int_()))
        out = run_kept(f.stage("shift", lambda y, by: {"z": y + by}, S.returns(z=S.int_()), needs=("scale",), constants={"by": by}), store)
        totals = out.agg(F.sum("`scale.y`").alias("scale"), F.sum("`shift.z`").alias("shift")).unpivot([], ["scale", "shift"], "stage", "total").withColumn("run_id", F.lit(run_id))
        sums = totals if sums is None else sums.unionByName(totals)
    told = runs_of(spark, store).select("run_id", "stage", "executed", "reused")
    return told.join(sums, ["run_id", "stage"])


@query("""select n_nationkey, '.json' as words_as, '.csv' as sizes_as, length(n_name)::double * 1.5 + n_regionkey as y, 2::bigint as files from nation""")
def sink_fields(spark, sf_dir):
    """Two fields of a stage as files of different formats, written once all rows are done and loaded again by the next stage."""
    sink = C.Sink(("words", "sizes"), f"{shared_dir(spark)}/files/{uuid.uuid4().hex}", formats={"words": "json", "sizes": "csv"}, autoload=True)
    f = (
        flow(table(spark, sf_dir, "nation"))
        .stage("save", lambda n_name, n_regionkey: {"words": {"name": n_name, "region": n_regionkey}, "sizes": [{"v": len(n_name) * 1.5}]}, S.returns(words=S.file_ref(), sizes=S.file_ref()), sink=sink)
        .stage("load", lambda words, save_sizes: {"y": float(save_sizes["v"].iloc[0]) + words["region"]}, S.returns(y=S.dbl()), needs=("save",))
    )
    out = run_kept(f, f"{shared_dir(spark)}/flows/{uuid.uuid4().hex}")
    there = C.artifact_catalog(spark, sink.base).groupBy(F.element_at(F.col("params"), "n_nationkey").cast("int").alias("n_nationkey")).agg(F.count("*").alias("files"))
    end = lambda c: F.regexp_extract(c, r"\.\w+$", 0)
    return out.select("n_nationkey", end("`save.words`.path").alias("words_as"), end("`save.sizes`.path").alias("sizes_as"), F.col("`load.y`").alias("y")).join(there, "n_nationkey")


@query("""with recursive w as (select c_nationkey as k, count(*)::double as c, row_number() over (order by count(*) desc, c_nationkey) as i from customer group by c_nationkey),
r as (select 0::bigint as i, [0.0, 0.0, 0.0, 0.0]::double[] as loads, null::bigint as k, null::bigint as g
union all select w.i, list_transform(range(1, 5), lambda j: r.loads[j] + case when j = list_position(r.loads, list_min(r.loads)) then w.c else 0 end), w.k, list_position(r.loads, list_min(r.loads))::bigint from r join w on w.i = r.i + 1)
select k::int as c_nationkey, g as "group" from r where i > 0""")
def balance_heavy(spark, sf_dir):
    """Nations dealt to four groups, those with most customers first: all are heavy, so as by placing one after another."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("n"))
    return balance_longest_first(rows, "c_nationkey", "n", 4, parts=64).select("c_nationkey", "group")


@query("""select true as fits, count(*) as n, round(sum(o_totalprice), 2) as weight from orders""")
def balance_bound(spark, sf_dir):
    """Orders dealt to 8 groups by price: no group is above its fair share by more than a sixteenth of it."""
    rows = balance_longest_first(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 8)
    loads = rows.groupBy("group").agg(F.sum("o_totalprice").alias("w"), F.count("*").alias("n"))
    fair = F.sum("w") / 8
    return loads.agg((F.max("w") <= fair * (1 + 1 / 16)).alias("fits"), F.sum("n").alias("n"), F.round(F.sum("w"), 2).alias("weight"))


@query("""select o_orderkey as wanted_id, c_custkey as record_id from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'""")
def subset_shared(spark, sf_dir):
    """Orders' parameters with customers' records in them; all records share an entry that a third of the orders have."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    entries = lambda **e: F.create_map(*[x for k, v in e.items() for x in (F.lit(k), v.cast("string"))])
    wanted = o.select(F.col("o_orderkey").alias("id"), entries(status=F.col("o_orderstatus"), owner=F.col("o_custkey"), priority=F.col("o_orderpriority")).alias("params"))
    return R.manifest_subset(c.select(F.col("c_custkey").alias("id"), entries(owner=F.col("c_custkey"), status=F.lit("F")).alias("params")), wanted)


@query("""select e.event_id, v.event_id as last_view from (select * from events where event_type = 'error') e
asof left join (select user_id % 7 as u, max(event_id) as event_id, ts from events where event_type = 'view' group by user_id % 7, ts) v on e.user_id % 7 = v.u and e.ts >= v.ts""")
def last_before(spark, sf_dir):
    """Each error with the last view of its group before it."""
    e = table(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 7)
    views = e.where("event_type = 'view'").select("u", "ts", F.col("event_id").alias("view"))
    return as_of(e.where("event_type = 'error'").select("event_id", "u", "ts"), views, "ts", ("u",), "view", "last_view").select("event_id", "last_view")


@query("""with e as (select *, (user_id % 5)::varchar as run_id, case event_type when 'view' then 'worker_heartbeat' when 'click' then 'user_log' when 'error' then 'chunk_failed' else 'other' end as kind from events),
r as (select run_id, min(ts) as s, count(distinct user_id) as n from e group by run_id),
lines as (
select run_id, ts as happened, case kind when 'worker_heartbeat' then '[HEARTBEAT] chunk ' || user_id || ': ' || substr(props, 1, 60) when 'user_log' then '[LOG] ' || props else '[FAIL] chunk ' || user_id || ' failed: bad ' || event_id end as event, user_id as chunk_id, kind = 'chunk_failed' as bad, 'events' as source from e where kind <> 'other'
union all select run_id, ts, '[FAIL] chunk ' || user_id || ', stage ''pay'': value ' || event_id, user_id, true, 'attempts' from e where event_type = 'purchase' and value > 400
union all select run_id, s + to_seconds(user_id * 60), '[TIMEOUT] chunk ' || user_id || ': job TIMEOUT', user_id, true, 'jobs' from (select distinct run_id, user_id from e where user_id % 3 = 0) join r using (run_id)
union all select run_id, s + interval 30 day, '[DONE] ' || (n - 1) || '/' || n || ' ok, 1 failed', null, false, 'runs' from r),
logs as (select run_id, user_id as chunk_id, ts, max(props) as said from e where kind = 'user_log' group by all),
t as (select l.*, g.said from lines l asof left join logs g on l.run_id = g.run_id and l.chunk_id = g.chunk_id and l.happened >= g.ts)
select run_id, event, source, chunk_id, case when bad then said end as last_log, (epoch_us(happened) - epoch_us(s)) / 1000000.0 as offset_s from t join r using (run_id)""")
def run_timeline(spark, sf_dir):
    """Lines about five runs from events, failed attempts, jobs and ends, failures with the last log line of their chunk."""
    e = table(spark, sf_dir, "events").withColumns({"run_id": (F.col("user_id") % 5).cast("string"), "chunk_id": F.col("user_id")})
    kind = F.when(F.col("event_type") == "view", "worker_heartbeat").when(F.col("event_type") == "click", "user_log").when(F.col("event_type") == "error", "chunk_failed").otherwise("other")
    severity = F.when(F.col("event_type") == "error", "error")
    events = e.select("run_id", "ts", kind.alias("event_type"), "chunk_id", F.lit(None).cast("string").alias("stage"), F.col("props").alias("message"), F.concat(F.lit("bad "), F.col("event_id")).alias("error"), severity.alias("severity"))
    attempts = e.where("event_type = 'purchase' and value > 400").select("run_id", "chunk_id", F.lit("pay").alias("stage"), F.lit(False).alias("ok"), F.lit(False).alias("skipped"), F.lit("failed").alias("status"), F.col("ts").alias("ended_at"), F.lit("ValueError").alias("error_class"), F.concat(F.lit("value "), F.col("event_id")).alias("error_message"))
    jobs = e.where("user_id % 3 = 0").select("run_id", "chunk_id").distinct().withColumns({"state": F.lit("TIMEOUT"), "signal": F.lit(0), "elapsed_s": F.col("chunk_id") * 60.0})
    start = e.groupBy("run_id").agg(F.min("ts").alias("submitted_at"), F.count_distinct("user_id").alias("n_chunks"))
    runs = start.withColumns({"finished_at": F.col("submitted_at") + F.expr("interval 30 day"), "n_failed": F.lit(1)})
    return timeline(events, attempts, jobs, runs).select("run_id", "event", "source", "chunk_id", "last_log", "offset_s")


@query("""select r_name as region, level, tag, r_regionkey + 5 * (level - 1) + 15 * (case tag when 'p' then 0 else 1 end) as ordinal
from region, range(1, 4) l(level), (values ('p'), ('q')) t(tag) where r_regionkey >= 1 and level <> r_regionkey""")
def grid_expand(spark, sf_dir):
    """A grid of regions, levels and tags; regions and levels are cut before tags are expanded."""
    regions = table(spark, sf_dir, "region").select("r_name", "r_regionkey")
    out = param_grid(spark, cut={"region": "ordinal >= 1", "level": "level <> ordinal % 5"}, region=regions, level=[1, 2, 3], tag=["p", "q"])
    return out


@query("""select user_id, min(event_id) as first_seq, arg_max(value, event_id) filter (value is not null) as value, arg_max(event_type, event_id) filter (event_type is not null) as event_type from events group by user_id""")
def registry_segments(spark, sf_dir):
    """Records that came in ten batches, in an order of their own, as compacted segments."""
    rows, store = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type"), f"{shared_dir(spark)}/registry/{uuid.uuid4().hex}"
    for number, part in enumerate((7, 2, 9, 0, 5, 1, 8, 3, 6, 4)):
        append(rows.where(F.col("event_id") % 10 == part), number, store, "user_id", "event_id", ["value", "event_type"], fan=3)
    return registry(spark, store, "user_id", "user_id long, first_seq long, value double, event_type string")


@query("""select 'keep' as run_id, 'completed' as status, count(*) as n_rows, count(*) filter (l_quantity > 45) as failed, count(*) filter (l_quantity > 45) as at_net, 0::bigint as at_gross from lineitem
union all select 'omit', 'completed', count(*) filter (l_quantity <= 45), 0, 0, 0 from lineitem""")
def run_records(spark, sf_dir):
    """What is kept of two results, counted while they were written."""
    store = f"{shared_dir(spark)}/flows/{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    for policy in ("keep", "omit"):
        f = flow(rows, error=policy, run_id=policy).stage("net", {"v": "if(l_quantity > 45, 1 div 0, l_quantity)"}, S.returns(v=S.dbl())).stage("gross", {"w": "l_extendedprice"}, S.returns(w=S.dbl()))
        write_result(f, f"{store}/{policy}", store)
    stage = lambda s: F.element_at("failed_by_stage", s).alias(f"at_{s}")
    return results_of(spark, store).select("run_id", "status", "n_rows", "failed", stage("net"), stage("gross"))


@query("""select c_custkey::varchar as param_hash, bool_and(o_orderstatus <> 'P') as outputs_current from customer join orders on o_custkey = c_custkey group by c_custkey
union all select c_custkey::varchar, false from customer where c_custkey not in (select o_custkey from orders)""")
def manifest_current(spark, sf_dir):
    """Customers' records with their orders as outputs: whether all files of those that are not pending exist."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    path = F.concat(F.lit("/out/"), F.col("o_orderkey").cast("string"))
    outputs = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("k"), path.alias("v")))).alias("output_paths"))
    text = lambda v: F.lit(v).cast("string")
    records = c.select("c_custkey").join(outputs, "c_custkey", "left").select(text("fit").alias("stage_id"), F.col("c_custkey").cast("string").alias("param_hash"), F.create_map(F.lit("c"), F.col("c_custkey").cast("string")).alias("params"), "output_paths", text("t").alias("completed_at"))
    files = o.where("o_orderstatus <> 'P'").select(path.alias("path"))
    return R.completion_manifest(records, "fit", files).select("param_hash", "outputs_current")


@query("""select o_orderkey, 'logs/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderstatus || '_' || strftime(o_orderdate, '%H%M%S') || '.log' as log,
'experiments/' || o_custkey || '/' || o_orderstatus || '/run_' || lpad((o_orderkey % 1000)::varchar, 3, '0') as run from orders""")
def path_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select("o_orderkey", X.path_patterns.daily_log(status, F.col("o_orderdate")).alias("log"), X.path_patterns.experiment(F.col("o_custkey").cast("string"), status, F.col("o_orderkey") % 1000).alias("run"))


@query("""select p_partkey, case when p_size % 2 = 0 then p_size::varchar else '"' || p_size || '"' end as made, p_size + 1 as next, p_size % 3 <> 0 as ok, case when p_size % 3 <> 0 then '{"size":' || p_size || '}' end as boxed from part""")
def flow_variants(spark, sf_dir):
    """Values of several types as variants: made by a function, read by a function, and made by columns under a rule."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    either = S.one_of(S.int_(), S.chr_(), stored=S.variant())
    rule = S.ctr_field("v", predicate=lambda v: F.variant_get(v, "$.size", "int") % 3 != 0)
    f = (
        flow(p, error="keep")
        .stage("make", lambda p_size: {"v": p_size if p_size % 2 == 0 else str(p_size)}, S.returns(v=either))
        .stage("read", lambda make_v: {"n": int(make_v) + 1}, S.returns(n=S.int_()), needs=("make",))
        .stage("box", {"v": "struct(p_size as size)"}, S.returns(v=S.variant(), _contract=(rule,)), needs=("make",))
    )
    text = lambda c: F.to_json(F.col(f"`{c}`"))
    return f.collect().select("p_partkey", text("make.v").alias("made"), F.col("`read.n`").alias("next"), F.col("`.ok`").alias("ok"), text("box.v").alias("boxed"))
