"""Registered queries of alternating paths and settled links, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _LINKS, query
from .operators import components, matching, tracking
from .plans.adapters import voxels

_FALL = "row_number() OVER (PARTITION BY t,c,{} ORDER BY total DESC,n DESC,{})"


def _paths_sql(name: str, links: str, similarity: float = 0.2) -> str:
    """CTEs that end in ``name``: start by start, each link's path takes the first component that is still free."""
    return f"""{name}near AS (SELECT t,c,v1,v2,total,{_FALL.format('v1', 'v2')} k FROM {links}),
{name}back AS (SELECT t,c,v2,v1 AS far,total AS beyond,{_FALL.format('v2', 'v1')} o FROM {links}),
{name}opt AS (SELECT a.t,a.c,a.v1,a.k,any_value(a.v2) v2,any_value(a.total) total,list(struct_pack(far := far, beyond := beyond) ORDER BY o) FILTER (WHERE far IS NOT NULL) AS opts
  FROM {name}near a LEFT JOIN {name}back b ON b.t=a.t AND b.c=a.c AND b.v2=a.v2 AND b.far<>a.v1 GROUP BY 1,2,3,4),
{name}walk(t,c,v1,k,seen,p) AS (SELECT t,c,v1,0::BIGINT,CAST([] AS BIGINT[]),CAST(NULL AS STRUCT(far BIGINT, beyond BIGINT)) FROM (SELECT DISTINCT t,c,v1 FROM {name}near) UNION ALL
  SELECT t,c,v1,k,CASE WHEN p IS NULL THEN seen ELSE list_append(seen,p.far) END,p FROM (SELECT w.t,w.c,w.v1,x.k,w.seen,CAST(list_filter(coalesce(x.opts,[]),lambda q: NOT list_contains(w.seen,q.far))[1] AS STRUCT(far BIGINT, beyond BIGINT)) AS p
    FROM {name}walk w JOIN {name}opt x ON x.t=w.t AND x.c=w.c AND x.v1=w.v1 AND x.k=w.k+1)),
{name}one AS (SELECT x.t,x.c,x.v1,x.v2,w.p.far AS far,x.total,coalesce(w.p.beyond,0) AS beyond,x.k FROM {name}walk w JOIN {name}opt x ON x.t=w.t AND x.c=w.c AND x.v1=w.v1 AND x.k=w.k),
{name}wgt AS (SELECT *,CAST(total+sum(beyond) OVER (PARTITION BY t,c,v1)-beyond AS BIGINT) AS weight FROM {name}one),
{name} AS (SELECT t,c,v1,v2,far,total,beyond,weight,row_number() OVER (PARTITION BY t,c,v1 ORDER BY weight DESC,k) AS rank,
  max(weight) OVER (PARTITION BY t,c,v1)-weight >= {similarity}::DOUBLE*max(weight) OVER (PARTITION BY t,c,v1) AND weight < max(weight) OVER (PARTITION BY t,c,v1) AS dissimilar FROM {name}wgt)"""


def _half_sql(name: str, edges: str, paths: str, near: str, far: str, similarity: float = 0.2) -> str:
    flags = f"""{name}f AS (SELECT e.*,dissimilar,sum(link) OVER a AS valence,sum(link) OVER b - link AS others,max(total) FILTER (WHERE link=1) OVER a AS top,max(total) OVER a AS most
  FROM {edges} e JOIN (SELECT t AS pt,c AS pc,v1 AS p1,v2 AS p2,dissimilar FROM {paths}) p ON pt=e.t AND pc=e.c AND p1=e.{near} AND p2=e.{far} WINDOW a AS (PARTITION BY e.t,e.c,e.{near}), b AS (PARTITION BY e.t,e.c,e.{far}))"""
    rules = f"""{name}r AS (SELECT *,link=1 AND top-total>={similarity}::DOUBLE*top AS r0,link=1 AND dissimilar AS r1,link=1 AND others>0 AS r2 FROM {name}f),
{name}s AS (SELECT *,count(*) FILTER (WHERE r0) OVER w AS f0,count(*) FILTER (WHERE r1) OVER w AS f1,count(*) FILTER (WHERE r2) OVER w AS f2 FROM {name}r WINDOW w AS (PARTITION BY t,c,{near}))"""
    to = f"CASE WHEN valence>1 AND (CASE WHEN f0>0 THEN r0 WHEN f1>0 THEN r1 ELSE r2 AND f2<valence END) THEN 0 WHEN valence=0 THEN CASE WHEN most-total>={similarity}::DOUBLE*most THEN 0 ELSE 1 END ELSE link END"
    return f"{flags}, {rules}, {name} AS MATERIALIZED (SELECT t,c,v1,v2,total,n,CAST({to} AS INT) AS link,CAST(count+CASE WHEN {to}<>link THEN 1 ELSE 0 END AS INT) AS count FROM {name}s)"


_PATHS = f"{_LINKS.replace('WITH', 'WITH RECURSIVE', 1)}, {_paths_sql('pa', 'links')}"


@query(f"{_PATHS} SELECT * FROM pa")
def r11_alternating_paths(spark, sf_dir):
    return matching.alternating_paths(tracking.frame_links(voxels(spark, sf_dir)))


_SETTLED = f"""{_PATHS}, flip AS (SELECT t,c,v2 AS v1,v1 AS v2,n,total FROM links), {_paths_sql('pb', 'flip')},
e0 AS (SELECT t,c,v1,v2,total,n,1 AS link,0 AS count FROM links), {_half_sql('e1', 'e0', 'pa', 'v1', 'v2')}, {_half_sql('e2', 'e1', 'pb', 'v2', 'v1')}, {_half_sql('e3', 'e2', 'pa', 'v1', 'v2')}, {_half_sql('e4', 'e3', 'pb', 'v2', 'v1')}"""


@query(f"{_SETTLED} SELECT * FROM e4")
def r07_r11_settled_links(spark, sf_dir):
    return matching.settled_links(tracking.frame_links(voxels(spark, sf_dir)))


@query(f"""{_SETTLED}, o AS (SELECT t,c,v1 AS label,sum(count) k FROM e4 GROUP BY 1,2,3), b AS (SELECT t+1 AS t,c,v2 AS label,sum(count) k FROM e4 GROUP BY 1,2,3)
SELECT m.t,m.c,m.label,CAST(coalesce(b.k,0) AS BIGINT) AS n_in,CAST(coalesce(o.k,0) AS BIGINT) AS n_out FROM m LEFT JOIN b ON b.t=m.t AND b.c=m.c AND b.label=m.label LEFT JOIN o ON o.t=m.t AND o.c=m.c AND o.label=m.label""")
def r21_a24_settling_changes(spark, sf_dir):
    """How often each component's links have changed while they settled: its uncertainty."""
    v = voxels(spark, sf_dir)
    return tracking.change_counts(components.component_stats(v), matching.settled_links(tracking.frame_links(v)))


@query(f"""{_PATHS} SELECT t,c,v1 AS label,count(*) AS paths,string_agg(v1||'-'||v2||CASE WHEN far IS NULL THEN '' ELSE '-'||far END||' ('||weight||')','; ' ORDER BY rank) AS text FROM pa WHERE v1%3=0 GROUP BY 1,2,3""")
def r22_path_report(spark, sf_dir):
    links = tracking.frame_links(voxels(spark, sf_dir))
    return matching.path_report(matching.alternating_paths(links), links.where("v1 % 3 = 0").select("t", "c", F.col("v1").alias("label")))
