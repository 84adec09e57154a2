"""Named queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The views of driftgrid.sources.tables in SQL.
_VIEWS = {
    "points": """
        select event_id pid, user_id oid, ts, value x,
               cast(json_extract_string(props, '$.k') as double) y from events""",
    "tweets": """
        select p.pid id, p.ts, p.x lat, p.y lng, p.oid user_id, d.text
        from points p join documents d on d.doc_id = p.pid""",
    "boxes": """
        select s_suppkey qid, cast(s_suppkey*37%300 as double) x_min,
               cast(s_suppkey*13%80 as double) y_min,
               cast(s_suppkey*37%300+40 as double) x_max, cast(s_suppkey*13%80+15 as double) y_max,
               timestamp '2024-01-01' + cast(s_suppkey*7%720 as int) * interval '1' hour ts
        from supplier""",
    "query_versions": """
        select oid qid, ts, x-5 x_min, y-5 y_min, x+5 x_max, y+5 y_max from points""",
    "knn_queries": """
        select cast(s_suppkey as int) qid, cast(s_suppkey*17%200 as int) fx,
               cast(s_suppkey*11%100 as int) fy, cast(1+s_suppkey%5 as int) k from supplier""",
    "segments": """
        select qid sid, x_min x1, y_min y1,
               case when qid%5=0 then x_min else x_max end x2, y_max y2 from boxes""",
    "corners": """
        select qid, 0 pos, x_max x, y_max y from boxes
        union all select qid, 1, x_min, y_min from boxes
        union all select qid, 2, x_min, y_max from boxes
        union all select qid, 3, x_max, y_min from boxes""",
    "trips": """
        select o_custkey moid, o_orderkey tripid, o_orderdate tstart,
               case when o_orderstatus <> 'P' then o_orderdate + interval '2' hour end tend,
               o_totalprice xstart, cast(floor(o_totalprice/2) as double) ystart,
               o_totalprice*2 xend, cast(floor(o_totalprice/4) as double) yend from orders""",
    "triples": """
        select concat('n/', n_nationkey) s, 'label' p, n_name o, 'en' lang from nation
        union all select concat('n/', n_nationkey), 'type',
               case when n_nationkey%2=0 then 'Settlement' else 'Region' end, null from nation""",
    "entities": "select c_custkey eid, concat('n/', c_nationkey) uri from customer",
    "tweet_lines": """
        select concat_ws(' ', id, strftime(ts, '%Y-%m-%d %H:%M:%S'), lat, lng,
                         replace(text, chr(10), ' ')) line from tweets
        union all select unnest(string_split(text, chr(10))) from documents""",
    "latest": """
        select * from points qualify row_number() over (partition by oid order by ts desc) = 1""",
    "hits": """
        select b.qid, p.pid, p.oid, p.ts, p.x, p.y from points p join boxes b
        on p.x between b.x_min and b.x_max and p.y between b.y_min and b.y_max""",
}


def with_views(sql: str) -> str:
    """Put the views a query names in front of it, those they need first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _VIEWS:
            if re.search(rf"\b(from|join)\s+{name}\b", text) and name not in needed:
                visit(_VIEWS[name])
                needed.append(name)

    visit(sql)
    ctes = ",\n".join(f"{n} as ({_VIEWS[n].strip()})" for n in needed)
    if not ctes:
        return sql
    head, rest = ("with ", sql)
    if sql.lstrip().startswith("with "):
        rest = sql.lstrip()[5:]
        return f"{head}{ctes},\n{rest}"
    return f"{head}{ctes}\n{rest}"


def number(text: str) -> str:
    """SQL for a text field as a number, null when it is none."""
    return (
        f"case when regexp_matches({text}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') "
        f"then try_cast({text} as double) end"
    )


def integer(text: str) -> str:
    return f"case when regexp_matches({text}, '^[+-]?[0-9]+$') then try_cast({text} as bigint) end"


def query(
    name: str, sql: str | None = None, same_as: str | None = None
) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL or the query whose rows it gives."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if same_as is not None:
            ORACLES[name] = ORACLES[same_as]
        elif sql is not None:
            ORACLES[name] = with_views(sql.strip())
        return fn

    return add


# The planar map of trip starts to degrees.
PLANAR_LAT = """((xstart + cast(780761.760862528 as double)) * cast(1214.24447469596 as double)
 - (ystart + cast(5844741.03397902 as double)) * cast(67978.2421158527 as double))
 / (cast(-2285.59137120724 as double) * cast(1214.24447469596 as double)
    - cast(67978.2421158527 as double) * cast(111217.945663725 as double))"""
PLANAR_LNG = """((xstart + cast(780761.760862528 as double)) * cast(111217.945663725 as double)
 - (ystart + cast(5844741.03397902 as double)) * cast(-2285.59137120724 as double))
 / (cast(67978.2421158527 as double) * cast(111217.945663725 as double)
    - cast(1214.24447469596 as double) * cast(-2285.59137120724 as double))"""
