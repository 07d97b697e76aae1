"""Map-like views over the benchmark tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "f_nodes": "select p_partkey as id, cast((p_partkey*7919)%360000 as double)/1000.0-180.0 as lon, cast((p_partkey*104729)%160000 as double)/1000.0-80.0 as lat from {part}",
    "f_nodes_partial": "select * from {f_nodes} where id%50<>0",
    "f_way_open": "select l_orderkey as way_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as seq, l_partkey as node_id from {lineitem}",
    "f_way_nodes": "select way_id, seq, node_id from {f_way_open} union all select way_id, cast(1000 as bigint) as seq, node_id from {f_way_open} where seq=1 and way_id%3=0",
    "f_local": "select way_id, seq, node_id, cast((way_id*7919)%350000 as double)/1000.0-180.0+cast((node_id*31)%200 as double)/1000.0 as lon, cast((way_id*104729)%150000 as double)/1000.0-75.0+cast((node_id*17)%200 as double)/1000.0 as lat from {f_way_nodes}",
    "f_ways": "select o_orderkey as id, case o_orderpriority when '1-URGENT' then 'highway' when '2-HIGH' then 'railway' when '3-MEDIUM' then 'waterway' when '4-NOT SPECIFIED' then 'landuse' else 'building' end as k,"
    " case o_orderpriority when '1-URGENT' then (case o_orderkey%3 when 0 then 'motorway' when 1 then 'residential' else 'footway' end) when '2-HIGH' then 'rail' when '3-MEDIUM' then 'river' when '4-NOT SPECIFIED' then 'forest' else 'yes' end as v from {orders}",
    "f_members": "select distinct l_suppkey as rel_id, l_orderkey as way_id, case when l_returnflag='R' then 'inner' else 'outer' end as role from {lineitem}",
    "f_points": "select c_custkey as id, c_name as name, cast(((c_custkey*7919+c_nationkey*1301)%360000) as double)/1000.0-180.0 as lon, cast(((c_custkey*104729)%160000) as double)/1000.0-80.0 as lat,"
    " case c_mktsegment when 'BUILDING' then 'building' when 'AUTOMOBILE' then 'shop' when 'MACHINERY' then 'craft' when 'HOUSEHOLD' then 'amenity' else 'tourism' end as k,"
    " case c_custkey%4 when 0 then 'restaurant' when 1 then 'hotel' when 2 then 'supermarket' else 'zzz_unknown' end as v from {customer}",
    "f_regions": "select n_nationkey as id, n_name as name, -180.0+cast((n_nationkey*37)%300 as double) as min_lon, -80.0+cast((n_nationkey*53)%120 as double) as min_lat,"
    " -180.0+cast((n_nationkey*37)%300 as double)+cast(20+n_nationkey%5*10 as double) as max_lon, -80.0+cast((n_nationkey*53)%120 as double)+cast(20+n_nationkey%3*10 as double) as max_lat from {nation}",
    "f_changes": "select cast(floor(event_id/50.0) as bigint) as seq, event_id as ordinal, case event_type when 'signup' then 'create' when 'error' then 'delete' else 'modify' end as action, user_id as id,"
    " cast(((user_id*7919+event_id*31)%360000) as double)/1000.0-180.0 as lon, cast(((user_id*104729+event_id*17)%160000) as double)/1000.0-80.0 as lat, case event_type when 'view' then 'note' else 'amenity' end as k from {events}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table where no view has the name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in needs})


def sql_with(*names: str, **more: str) -> str:
    """A WITH clause for DuckDB that defines the views (and ``more``) by name."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(n)
            out[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for name in names:
        add(name)
    out |= more
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in out.items()) + "\n"
