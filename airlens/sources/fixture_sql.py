"""Fixture views over the driver's TPC-H-style tables, as SQL text.

These define the reference's three data tables (readings, states, funding)
and the evaluation ``samples`` table in terms of the generated test tables.
The text is shared by the DuckDB oracle (as CTEs); the Spark side builds the
same relations with the DataFrame API in ``airlens.sources.tables``.
"""

READINGS = """
select l_shipdate as ts,
       c_name as station,
       concat(n_name, '/', c_mktsegment) as city,
       n_name as state,
       case when l_linenumber = 7 then null else l_quantity end as pm25,
       l_extendedprice / 1000 as pm10
from lineitem
join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
"""

STATES = """
select n_name as state,
       cast(count(*) * 1000000 + max(n_nationkey) as bigint) as population,
       cast(case when max(n_regionkey) = 4 then (max(n_nationkey) + 1) * 100
                 else (max(n_nationkey) + 1) * 4000 end as bigint) as area_km2,
       max(n_regionkey) = 4 as is_ut
from customer join nation on c_nationkey = n_nationkey
where n_nationkey <> 23
group by n_name
"""

FUNDING = """
select n_name as state,
       concat(n_name, '/', c_mktsegment) as city,
       coalesce(sum(case when o_orderdate >= date '1996-04-01' and o_orderdate < date '1997-04-01' then o_totalprice end), 0) as rel_fy1,
       coalesce(sum(case when o_orderdate >= date '1997-04-01' and o_orderdate < date '1998-04-01' then o_totalprice end), 0) as rel_fy2,
       coalesce(sum(case when o_orderdate >= date '1998-04-01' and o_orderdate < date '1999-04-01' then o_totalprice end), 0) as rel_fy3,
       coalesce(sum(case when o_orderdate >= date '1996-04-01' and o_orderdate < date '1999-04-01' then o_totalprice end), 0) as total_released,
       coalesce(sum(case when o_orderdate >= date '1996-04-01' and o_orderdate < date '1999-04-01' and o_orderstatus = 'F' then o_totalprice end), 0) as utilised
from orders
join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey
where n_nationkey % 4 <> 0 and c_mktsegment <> 'MACHINERY'
group by n_name, c_mktsegment
"""

SAMPLES = """
select cast(floor(event_id / 5) as bigint) as question_id,
       event_id % 5 as sample_idx,
       case when cast(floor(event_id / 5) as bigint) % 2 = 0 then 'base' else 'tuned' end as model,
       concat('cat_', cast(cast(floor(event_id / 5) as bigint) % 7 as varchar(10))) as category,
       event_type <> 'error' as executed,
       event_type <> 'error' and value >= 20 as passed,
       case when event_type <> 'error' and value >= 20 then null
            when event_type <> 'error' then 'AssertionError'
            when user_id % 4 = 0 then 'KeyError'
            when user_id % 4 = 1 then 'SyntaxError'
            when user_id % 4 = 2 then 'NameError'
            else 'TimeoutError' end as error_type
from events
"""

VIEWS = {"readings": READINGS, "states": STATES, "funding": FUNDING, "samples": SAMPLES}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the named fixture views."""
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    return f"with {ctes}\n{body.strip()}"

# Captured run logs of the samples (derived from events, like ``samples``):
# exit code, timeout flag, combined stdout/stderr text and the gold answer.
RUNS = """
select cast(floor(event_id / 5) as bigint) as question_id,
       event_id % 5 as sample_idx,
       case when event_type <> 'error' and value >= 20 then 0
            when event_type = 'error' and user_id % 4 = 3 then null
            else 1 end as exit_code,
       event_type = 'error' and user_id % 4 = 3 as timed_out,
       case when event_type <> 'error' and value >= 20 and user_id % 10 = 9
                 then cast(cast(round(value * 100) as bigint) as varchar)
            when event_type <> 'error' and value >= 20
                 then 'EXEC_OK: ' || cast(cast(round(value * 100) as bigint) as varchar)
            when event_type <> 'error'
                 then 'EXEC_OK: ' || cast(cast(round(value * 100) as bigint) as varchar) || chr(10)
                      || 'Traceback (most recent call last):' || chr(10)
                      || '  File "<string>", line 9, in <module>' || chr(10) || 'AssertionError'
            when user_id % 4 = 0
                 then 'Traceback (most recent call last):' || chr(10)
                      || '  File "<string>", line 4, in get_response' || chr(10)
                      || 'KeyError: ''PM25'''
            when user_id % 4 = 1
                 then '  File "<string>", line 2' || chr(10) || 'SyntaxError: invalid syntax'
            when user_id % 4 = 2 and value < 5 then ''
            when user_id % 4 = 2
                 then 'Traceback (most recent call last):' || chr(10)
                      || 'NameError: name ''pd'' is not defined'
            else '' end as log,
       case when event_id % 3 = 0 then cast(cast(round(value * 100) as bigint) as varchar)
            when event_id % 3 = 1 then cast(cast(round(value * 100) as bigint) as varchar) || '.0000001'
            else 'NATION_' || cast(user_id % 25 as varchar) end as answer
from events
"""

VIEWS["runs"] = RUNS
