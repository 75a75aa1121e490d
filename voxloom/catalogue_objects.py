"""Registered queries of bricks, selections, rulers, meshes, clusters, tracks and gait, beside those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _C, _LINKS, _STATS, _TRACKS, _stencil, _stencil_sql, _trim_sql, query, rounded, runs_sql
from .operators import bricks, clustering, components, mesh, resample, rulers, segmentation, selection, stats, stencil, timeseries, tracking
from .operators.graph import cut
from .plans import adapters
from .plans.adapters import DIMS, POINTS, ROI, RULERS, VOX, voxels
from .sources import export, volumes

# 2.5 and 2.7 components of a bricked volume
SIZE = (4, 16, 25)
_CELLS = f"""WITH RECURSIVE {VOX}, r AS (SELECT t,c,z,y,x,v,label,CAST(((z//4)*2+(y//16))*2+(x//25) AS INT) AS brick FROM vox), l AS (SELECT * FROM r WHERE label<>0 AND v>0),
o(dz,dy,dx) AS (VALUES (1,0,0),(0,1,0),(0,0,1)), seam AS (SELECT a.t,a.c,a.brick,a.label,b.brick AS brick2,b.label AS label2,count(*) AS n FROM l a CROSS JOIN o JOIN l b ON b.t=a.t AND b.c=a.c AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx WHERE a.brick<>b.brick GROUP BY 1,2,3,4,5,6)"""
_ROOTS = f"""{_CELLS}, e AS (SELECT t,c,(CAST(brick AS BIGINT)<<32)|label a,(CAST(brick2 AS BIGINT)<<32)|label2 b FROM seam WHERE n>=12), u AS (SELECT t,c,a,b FROM e UNION SELECT t,c,b,a FROM e),
w(t,c,k,m) AS (SELECT DISTINCT t,c,a,a FROM u UNION SELECT w.t,w.c,u.b,w.m FROM w JOIN u ON u.t=w.t AND u.c=w.c AND u.a=w.k), root AS (SELECT t,c,k,min(m) m FROM w GROUP BY 1,2,3),
cells AS (SELECT t,c,brick,label,(CAST(brick AS BIGINT)<<32)|label AS k,count(*) n,sum(v) total,sum(v*v) squares,min(v) least,max(v) most FROM l GROUP BY 1,2,3,4),
named AS (SELECT cells.*,coalesce(root.m,cells.k) AS m FROM cells LEFT JOIN root USING (t,c,k))"""


def _linked(v):
    return bricks.linked_components(bricks.seams(v, DIMS, SIZE), 12)


@query(f"{_CELLS} SELECT * FROM seam")
def j13_seams(spark, sf_dir):
    return bricks.seams(voxels(spark, sf_dir), DIMS, SIZE)


@query(f"""{_ROOTS}, g AS (SELECT t,c,m,CAST(sum(n) AS BIGINT) AS n,CAST(sum(total) AS BIGINT) AS total,sum(squares) q,min(least) AS least,max(most) AS most FROM named GROUP BY 1,2,3)
SELECT t,c,brick,label,CAST(m>>32 AS INT) AS root_brick,m&4294967295 AS root_label,g.n,g.total,g.least,g.most,round(g.total/g.n,6) AS mean,round(sqrt(greatest(0.0,(q-g.total*g.total/g.n)/g.n)),6) AS sigma FROM named JOIN g USING (t,c,m)""")
def c08_c09_linked_stats(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return rounded(bricks.merged_stats(v, _linked(v), DIMS, SIZE), "mean", "sigma")


@query(f"""{_ROOTS}, q AS (SELECT t,c,brick,label,m&4294967295 AS base,(m&4294967295)%253 AS colour,m FROM named), ch AS (SELECT *,row_number() OVER (PARTITION BY t,c,brick,colour ORDER BY base,m>>32,label) nth FROM q WHERE (label-base)%253<>0),
ca AS (SELECT t,c,brick,colour,min(base)+253*unnest(range(0,200)) AS new FROM ch GROUP BY 1,2,3,4), fr AS (SELECT *,row_number() OVER (PARTITION BY t,c,brick,colour ORDER BY new) nth FROM ca WHERE NOT EXISTS (FROM q WHERE q.t=ca.t AND q.c=ca.c AND q.brick=ca.brick AND q.label=ca.new))
SELECT r.t,r.c,r.z,r.y,r.x,coalesce(fr.new,r.label) AS id FROM r LEFT JOIN ch USING (t,c,brick,label) LEFT JOIN fr ON fr.t=ch.t AND fr.c=ch.c AND fr.brick=ch.brick AND fr.colour=ch.colour AND fr.nth=ch.nth""")
def c10_consistent_ids(spark, sf_dir):
    v = voxels(spark, sf_dir).where("label = 0 or v > 0")
    return bricks.consistent_ids(v, _linked(v), DIMS, SIZE)


@query(f"{_ROOTS} SELECT t,c,count(DISTINCT m) AS comps FROM named GROUP BY 1,2")
def c13_component_count(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return bricks.component_count(v, _linked(v), DIMS, SIZE)


# 2.4 selection
_AT = ["t", "c", "z", "y", "x"]
_SIZES = f"WITH {VOX}, s AS (SELECT t,c,label,count(*) n FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3)"


@query(f"{_SIZES} SELECT t,c,z,y,x,CASE WHEN n>20 AND n<200 THEN 255 ELSE 0 END AS mask FROM vox LEFT JOIN s USING (t,c,label)")
def f04_select_sized(spark, sf_dir):
    return selection.select_sized(voxels(spark, sf_dir), 20, 200).select(*_AT, "mask")


def _listed(v):
    return v.where("label in (9, 10) and t > 1").select("t", "c", "label").distinct()


@query(f"WITH {VOX} SELECT t,c,z,y,x,CASE WHEN label IN (9,10) AND t>1 THEN 255 ELSE 0 END AS mask FROM vox")
def f09_select_list(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return selection.select_cells(v, _listed(v)).select(*_AT, "mask")


@query(f"WITH {VOX} SELECT t,c,z,y,x,CASE WHEN label IN (9,10) AND t>1 THEN 0 ELSE mask END AS mask FROM vox")
def f09_erase_list(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return selection.erase_cells(v, _listed(v)).select(*_AT, "mask")


@query(f"WITH {VOX} SELECT t,c,z,y,x,255 AS mask FROM vox")
def f07_select_all(spark, sf_dir):
    return selection.select_all(voxels(spark, sf_dir)).select(*_AT, "mask")


@query(f"""WITH {VOX}, {RULERS}, p AS (SELECT ruler,t AS n,t%7 AS t,CAST(ruler%3 AS INT) c,(z%7)+0.3::DOUBLE z,(y%32)-0.4::DOUBLE y,(x%50)+0.5::DOUBLE x FROM rul)
SELECT p.ruler,p.n,coalesce(v.label,0) AS label FROM p LEFT JOIN vox v ON v.t=p.t AND v.c=p.c AND v.z=CAST(floor(p.z+0.5) AS INT) AND v.y=CAST(floor(p.y+0.5) AS INT) AND v.x=CAST(floor(p.x+0.5) AS INT)""")
def f10_component_at(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir)
    p = p.select("ruler", F.col("t").alias("n"), (F.col("t") % 7).alias("t"), (F.col("ruler") % 3).cast("int").alias("c"), (F.col("z") % 7 + 0.3).alias("z"), (F.col("y") % 32 - 0.4).alias("y"), (F.col("x") % 50 + 0.5).alias("x"))
    return selection.component_at(voxels(spark, sf_dir), p).select("ruler", "n", "label")


@query(f"WITH {VOX} SELECT t,c,z,y,x,v FROM vox WHERE c<>1")
def f16_channels(spark, sf_dir):
    shown = spark.createDataFrame([(0, True), (1, False), (2, True)], "c int, visible boolean")
    return selection.channels(voxels(spark, sf_dir), shown, 2).select(*_AT, "v")


@query(f"WITH RECURSIVE {VOX}, {runs_sql('SELECT * FROM vox WHERE v>128')}, sm AS (SELECT t,c,label FROM grown GROUP BY 1,2,3 HAVING count(*)<10) SELECT t,c,z,y,x,v FROM vox WHERE NOT EXISTS (FROM grown g JOIN sm USING (t,c,label) WHERE g.t=vox.t AND g.c=vox.c AND g.z=vox.z AND g.y=vox.y AND g.x=vox.x)")
def f18_noise(spark, sf_dir):
    return selection.without_noise(voxels(spark, sf_dir), 128, 10).select(*_AT, "v")


@query(f"{_LINKS} SELECT t,c,v1 AS label FROM links WHERE n>=8 UNION SELECT t+1,c,v2 FROM links WHERE n>=8")
def f20_uncertain(spark, sf_dir):
    return selection.changed_cells(tracking.frame_links(voxels(spark, sf_dir)), F.col("n"), 8)


def _rays(spark):
    """One ray along z for each position of the grid, in every frame and channel."""
    ids = spark.range(7 * 3 * 32 * 50).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(6))))
    part = lambda by, n: (F.floor(F.col("id") / by) % n).cast("int")
    return ids.select(part(1, 7).alias("t"), part(7, 3).alias("c"), part(21, 1600).alias("ray"), "step", F.col("step").alias("z"), part(21 * 50, 32).alias("y"), part(21, 50).alias("x"))


@query(f"WITH {VOX} SELECT t,c,y*50+x AS ray,arg_max(z,v*100-z) AS step,max(v) AS v FROM vox WHERE v>0 GROUP BY ALL")
def f21_ray_peak(spark, sf_dir):
    return selection.ray_peak(_rays(spark), voxels(spark, sf_dir))


@query(f"""WITH {VOX}, a AS (SELECT t,c,y*50+x AS ray,z AS step,v/255.0::DOUBLE*0.5 AS a FROM vox WHERE v>0), b AS (SELECT *,exp(coalesce(sum(ln(1-a)) OVER (PARTITION BY t,c,ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))*a AS d FROM a),
s AS (SELECT *,round(sum(d) OVER (PARTITION BY t,c,ray ORDER BY step),9) AS acc FROM b) SELECT t,c,ray,min(step) AS step FROM s WHERE acc>0.4::DOUBLE GROUP BY 1,2,3""")
def f21_ray_front(spark, sf_dir):
    return selection.ray_front(_rays(spark), voxels(spark, sf_dir), 0.5, 0.4)


# 2.6 background, records
_stencil("a11_background", stencil.background(0.01, 0.5), f"round(CASE WHEN stddev_pop(w)<0.01 OR {_C}-avg(w)<stddev_pop(w)*0.5 THEN {_C} ELSE 0 END,9)", "dz=0")


@query(_stencil_sql(f"round(CASE WHEN stddev_pop(w)<0.01 OR {_C}-avg(w)<stddev_pop(w)*0.5 THEN {_C} ELSE 0 END,9)", "dz=0").replace("SELECT * FROM f WHERE v<>0", """, bg AS (SELECT * FROM f WHERE v<>0),
h AS (SELECT t,c,v,count(*) n FROM bg GROUP BY 1,2,3), k AS (SELECT *,sum(n) OVER (PARTITION BY t,c ORDER BY v) b,sum(n) OVER (PARTITION BY t,c) a,max(n) OVER (PARTITION BY t,c) m FROM h),
om AS (SELECT t,c,min(CASE WHEN b>=floor(a/2) THEN v END) AS median,min(CASE WHEN n=m THEN v END) AS mode FROM k GROUP BY 1,2)
SELECT t,c,count(*) AS n,round(avg(v),6) AS mean,min(v) AS least,max(v) AS most,any_value(median) AS median,any_value(mode) AS mode FROM bg JOIN om USING (t,c) GROUP BY 1,2"""))
def t07_background_statistic(spark, sf_dir):
    b = stencil.apply(voxels(spark, sf_dir), DIMS, 1, stencil.background(0.01, 0.5))
    sums = b.groupBy("t", "c").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))
    return sums.join(stats.order_statistics(b, ["t", "c"]), ["t", "c"])


@query("SELECT p.key,max(p.value) AS most,(SELECT round(avg(floor(value)),6) FROM events) AS population FROM (SELECT 'age' AS key,CAST(event_id%97 AS DOUBLE) AS value FROM events UNION ALL SELECT 'gain',CAST(user_id%13 AS DOUBLE) FROM events) p GROUP BY 1")
def a26_record_summary(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    params = F.create_map(F.lit("age"), (F.col("event_id") % 97).cast("double"), F.lit("gain"), (F.col("user_id") % 13).cast("double"))
    return rounded(stats.record_summary(e.select(F.floor("value").alias("population"), params.alias("params"))), "population")


# 2.5 joins of components
@query(f"""WITH {VOX}, l AS (SELECT * FROM vox WHERE label<>0 AND v>0), o AS (SELECT dz,dy,dx,dz*dz+dy*dy+dx*dx AS d2 FROM range(-2,3) i(dz),range(-2,3) j(dy),range(-2,3) k(dx) WHERE dz*dz+dy*dy+dx*dx BETWEEN 1 AND 4)
SELECT a.t,a.c,a.label AS a,b.label AS b,round(sqrt(min(d2)),6) AS dist FROM l a CROSS JOIN o JOIN l b ON b.t=a.t AND b.c=a.c AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx WHERE a.label<b.label GROUP BY 1,2,3,4""")
def j07_neighbours_in_reach(spark, sf_dir):
    return rounded(components.near_neighbours(voxels(spark, sf_dir), 2), "dist")


_NEAR = f"""{_STATS}, p AS (SELECT a.t,a.c,a.label a,b.label b,round(sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)+pow(a.cz-b.cz,2)),6) AS dist FROM s a JOIN s b ON a.t=b.t AND a.c=b.c AND a.label<>b.label)"""


@query(f"{_NEAR} SELECT t,c,a,b,dist,a%2=b%2 AS same FROM p")
def o02_distance_groups(spark, sf_dir):
    s = components.component_stats(voxels(spark, sf_dir))
    groups = s.select("t", "c", "label", (F.col("label") % 2).alias("grp"))
    return components.distance_groups(components.component_pairs(s), groups)


@query(f"{_NEAR}, q AS (SELECT * FROM p UNION ALL SELECT DISTINCT t,c,a,a,0.0 FROM p) SELECT t,c,a,string_agg(printf('%.6f',dist),chr(9) ORDER BY b) AS line FROM q GROUP BY 1,2,3")
def k07_distance_lines(spark, sf_dir):
    return export.distance_lines(components.component_pairs(components.component_stats(voxels(spark, sf_dir))))


@query(f"WITH {VOX} SELECT t,c,CAST(dense_rank() OVER (PARTITION BY t,c ORDER BY label)-1 AS INT) AS channel,z,y,x,v FROM vox WHERE label<>0 AND v>0")
def k08_component_channels(spark, sf_dir):
    return export.component_channels(voxels(spark, sf_dir))


@query(f"""WITH {VOX}, h AS (SELECT *,(label%253)/45.0::DOUBLE AS hue FROM vox WHERE label<>0 AND v>0), i AS (SELECT *,CAST(floor(hue) AS INT) i,hue-floor(hue) f FROM h),
k AS (SELECT *,[CASE i WHEN 0 THEN 1 WHEN 1 THEN 1-f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f WHEN 5 THEN 1 ELSE 0 END,CASE i WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1-f ELSE 0 END,CASE i WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1-f ELSE 0 END] AS rgb FROM i),
m AS (SELECT t,c,z,y,x,q AS channel,CAST(floor(rgb[q+1]*v+0.5+1e-9) AS INT) AS shade FROM k,range(0,3) j(q)) SELECT t,c,z,y,x,CAST(channel AS INT) AS channel,shade FROM m WHERE shade>0""")
def k09_rgb_channels(spark, sf_dir):
    return export.rgb_channels(voxels(spark, sf_dir))


@query(f"{_STATS} SELECT t,c,label,'ID'||label AS text,round(cx,6) AS x,round(cy,6) AS y,round(cz,6) AS z FROM s")
def k10_annotations(spark, sf_dir):
    return rounded(export.annotation_rows(components.component_stats(voxels(spark, sf_dir))), "x", "y", "z")


@query(f"WITH {RULERS}, l AS (SELECT ruler,unnest(['t','x','y','z']) AS axis,unnest([string_agg(t,',' ORDER BY t),string_agg(x,',' ORDER BY t),string_agg(y,',' ORDER BY t),string_agg(z,',' ORDER BY t)]) AS line FROM rul GROUP BY ruler) SELECT * FROM l")
def k14_coordinate_lines(spark, sf_dir):
    return export.coordinate_lines(adapters.ruler_points(spark, sf_dir))


# 2.5, 2.6, 2.12 and 2.16 rulers
_LINE = [(0.0, 0.0, 0.0), (20.0, 10.0, 3.0), (49.0, 31.0, 6.0)]
_PLACES = [(10.0, 10.0, 10.0), (400.0, 50.0, 20.0), (250.0, 0.0, 30.0)]


@query(f"""WITH {RULERS}, p(place,px,py,pz) AS (VALUES {','.join(f'({i},{a},{b},{c})' for i, (a, b, c) in enumerate(_PLACES))}), d AS (SELECT place,ruler,t,round(sqrt(pow(x-px::DOUBLE,2)+pow(y-py::DOUBLE,2)+pow(z-pz::DOUBLE,2)),9) AS dist FROM rul,p)
SELECT place,ruler,t,dist FROM (SELECT *,row_number() OVER (PARTITION BY place ORDER BY dist,ruler DESC,t DESC) k FROM d) WHERE k=1""")
def j10_nearest_point(spark, sf_dir):
    return rulers.nearest_points(adapters.ruler_points(spark, sf_dir), _PLACES)


@query(f"""{_STATS}, {RULERS}, m AS (SELECT ruler,avg(x) mx,avg(y) my,avg(z) mz FROM rul WHERE ruler IN (1,2,3) GROUP BY 1)
SELECT t,c,label,ruler,round(sqrt(pow(cx-mx,2)+pow(cy-my,2)+pow(cz-mz,2)),6) AS dist FROM s,m""")
def j11_ruler_distance(spark, sf_dir):
    s = components.component_stats(voxels(spark, sf_dir))
    return rounded(rulers.component_distances(s, adapters.ruler_points(spark, sf_dir), [1, 2, 3]), "dist")


@query(f"""{_STATS}, g(segment,ax,ay,az,bx,b_y,bz) AS (VALUES {','.join(f'({i},{",".join(map(str, a + b))})' for i, (a, b) in enumerate(zip(_LINE, _LINE[1:], strict=False)))}),
h AS (SELECT segment,ax::DOUBLE ax,ay::DOUBLE ay,az::DOUBLE az,bx::DOUBLE bx,b_y::DOUBLE b_y,bz::DOUBLE bz,sqrt(pow(bx-ax,2)+pow(b_y-ay,2)+pow(bz-az,2)) len FROM g), i AS (SELECT *,coalesce(sum(len) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS start FROM h),
d AS (SELECT t,c,label,segment,round(sqrt(pow(cx-(ax+bx)/2,2)+pow(cy-(ay+b_y)/2,2)+pow(cz-(az+bz)/2,2)),9) far,((cx-ax)*(bx-ax)+(cy-ay)*(b_y-ay)+(cz-az)*(bz-az))/len dot,pow(cx-ax,2)+pow(cy-ay,2)+pow(cz-az,2) l2,start FROM s,i)
SELECT t,c,label,round(dot+start,6) AS along,round(sqrt(greatest(0.0,l2-dot*dot)),5) AS across,segment FROM (SELECT *,row_number() OVER (PARTITION BY t,c,label ORDER BY far,segment) k FROM d) WHERE k=1""")
def j12_projection(spark, sf_dir):
    s = components.component_stats(voxels(spark, sf_dir)).select("t", "c", "label", *[F.col(f"c{k}").alias(k) for k in "xyz"])
    return rounded(rounded(rulers.projected(s, _LINE).drop("x", "y", "z"), "along"), "across", digits=5)


@query(f"WITH {RULERS}, m AS (SELECT ruler,avg(x) x,avg(y) y,avg(z) z FROM rul GROUP BY 1) SELECT round(avg(x),6) AS x,round(avg(y),6) AS y,round(avg(z),6) AS z FROM m")
def a25_average_ruler(spark, sf_dir):
    return rounded(rulers.average(adapters.ruler_points(spark, sf_dir)), "x", "y", "z")


@query(f"""WITH {RULERS}, f AS (SELECT min(ruler) r FROM (SELECT ruler FROM rul GROUP BY 1 HAVING count(*)>1)), o AS (SELECT x::DOUBLE ox,y::DOUBLE oy,z::DOUBLE oz FROM rul,f WHERE ruler=r AND t=0),
q AS (SELECT o.*,(x-ox) dx,(y-oy) dy,(z-oz) dz FROM rul,f,o WHERE ruler=r AND t=1), u AS (SELECT *,sqrt(dx*dx+dy*dy+dz*dz) far FROM q), a AS (SELECT ox,oy,oz,far,dx/far ax,dy/far ay,dz/far az FROM u),
b AS (SELECT *,ay*az bx,0.0::DOUBLE b_y,-ay*ax bz FROM a), n AS (SELECT *,sqrt(bx*bx+bz*bz) nl FROM b), e AS (SELECT *,CASE WHEN nl=0 THEN 1 ELSE nl END k FROM n), g AS (SELECT ox,oy,oz,2.5/far s,ax,ay,az,bx/k zx,0.0 zy,bz/k zz FROM e)
SELECT ruler,t,round(ox+s*(ax*x+(zy*az-zz*ay)*y+zx*z),6) AS x,round(oy+s*(ay*x+(zz*ax-zx*az)*y+zy*z),6) AS y,round(oz+s*(az*x+(zx*ay-zy*ax)*y+zz*z),6) AS z FROM rul,g""")
def v17_ruler_frame(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir)
    first = p.groupBy("ruler").count().where("count > 1").agg(F.min("ruler")).first()[0]
    return rounded(rulers.transformed(p, first, 2.5), "x", "y", "z")


@query(f"WITH {RULERS}, b AS (SELECT *,t//4%3 AS branch FROM rul), n AS (SELECT *,count(*) OVER (PARTITION BY ruler,branch) k FROM b) SELECT ruler,t,branch FROM n WHERE branch=0 OR k>5")
def x09_pruned(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir).withColumn("branch", F.floor(F.col("t") / 4) % 3)
    return rulers.pruned(p, 4).select("ruler", "t", "branch")


@query(f"WITH {RULERS} SELECT ruler,CAST(row_number() OVER (PARTITION BY ruler ORDER BY t DESC)-1 AS INT) AS t,round(x*2.0::DOUBLE,6) AS x,round(y*1.0::DOUBLE,6) AS y,round(z*3.0::DOUBLE,6) AS z FROM rul")
def x09_scaled_reversed(spark, sf_dir):
    return rulers.scaled(rulers.reversed_points(adapters.ruler_points(spark, sf_dir)), (2.0, 1.0, 3.0))


@query(f"WITH {RULERS} SELECT ruler,string_agg(x||chr(9)||y||chr(9)||z,chr(9) ORDER BY t) AS line FROM rul GROUP BY 1")
def x17_point_text(spark, sf_dir):
    return rulers.point_text(adapters.ruler_points(spark, sf_dir))


@query(f"{_STATS} SELECT t,c,CAST(row_number() OVER (PARTITION BY t,c ORDER BY label)-1 AS INT) AS point,round(cx,6) AS x,round(cy,6) AS y,round(cz,6) AS z FROM s QUALIFY count(*) OVER (PARTITION BY t,c)>=3")
def c16_component_ruler(spark, sf_dir):
    return rounded(rulers.through_components(components.component_stats(voxels(spark, sf_dir))), "x", "y", "z")


@query(f"WITH {RULERS} SELECT ruler,max(x) AS x,arg_max(t,x*100000-t) AS t FROM rul GROUP BY 1")
def o04_profile_peak(spark, sf_dir):
    return rulers.profile_peak(adapters.ruler_points(spark, sf_dir), "x", "t")


# 2.13 growth
@query(f"WITH RECURSIVE {VOX}, {runs_sql('SELECT * FROM vox WHERE v>128 AND mask>0')} SELECT * FROM grown")
def g02_masked_grow(spark, sf_dir):
    return segmentation.masked_grow(voxels(spark, sf_dir), 128)


@query(f"WITH RECURSIVE {VOX}, {runs_sql('SELECT * FROM vox WHERE v>160')}, sd AS (SELECT DISTINCT t,c,label FROM grown JOIN vox q USING (t,c,z,y,x) WHERE q.v>=250) SELECT t,c,z,y,x FROM grown g WHERE EXISTS (FROM sd WHERE sd.t=g.t AND sd.c=g.c AND sd.label=g.label)".replace("SELECT DISTINCT t,c,label FROM grown JOIN vox q USING (t,c,z,y,x)", "SELECT DISTINCT grown.t,grown.c,grown.label FROM grown JOIN vox q USING (t,c,z,y,x)"))
def g09_diffused(spark, sf_dir):
    return segmentation.diffused(voxels(spark, sf_dir), 250, 160)


@query()
def g07_replay(spark, sf_dir):
    commands = [{"type": "generate", "thresh": "0.7"}, {"type": "fixate", "size": "50"}, {"type": "generate", "thresh": "0.5", "cleanb": "1", "clean_size_vl": "6"}]
    return segmentation.replay(voxels(spark, sf_dir), commands).select(*_AT, "label")


# 2.14 clusters
@query()
def m04_noise(spark, sf_dir):
    p = adapters.points(spark, sf_dir)
    return clustering.without_noise(p, clustering.dbscan(p, 120.0, 6), 200.0)


@query()
def m09_m10_shares(spark, sf_dir):
    p = adapters.points(spark, sf_dir)
    return clustering.share_histogram(clustering.memberships(p, clustering.gaussian_mixture(p, 2)), 2, 10)


@query(f"WITH {POINTS}, k AS (SELECT DISTINCT grp AS cluster FROM pts), n AS (SELECT cluster,row_number() OVER (ORDER BY cluster) i FROM k), f AS (SELECT l AS label,row_number() OVER (ORDER BY l) i FROM range(3,300,10) r(l) WHERE l NOT IN (13,43,53)) SELECT CAST(cluster AS BIGINT) AS cluster,label FROM n JOIN f USING (i)")
def m11_fresh_ids(spark, sf_dir):
    p = adapters.points(spark, sf_dir).select("id", F.col("grp").cast("long").alias("cluster"))
    used = spark.createDataFrame([(13,), (43,), (53,), (44,)], "label long")
    return clustering.fresh_ids(p, used, 3, 10)


@query(f"WITH {POINTS} SELECT id,x,y,z FROM pts WHERE x>0 OR y>0")
def u05_joined_clusters(spark, sf_dir):
    p = adapters.points(spark, sf_dir).select("id", "x", "y", "z")
    return clustering.joined_clusters(p.where("x > 0"), p.where("y > 0"))


@query(f"WITH {POINTS}, k AS (SELECT *,CASE WHEN id%3=0 THEN min(CASE WHEN id%3=0 THEN id END) OVER (PARTITION BY id//10) ELSE id END AS root FROM pts) SELECT root,count(*) AS size,CAST(sum(x) AS BIGINT) AS x,CAST(sum(y) AS BIGINT) AS y,CAST(sum(z) AS BIGINT) AS z FROM k GROUP BY 1")
def u06_merged_points(spark, sf_dir):
    p = adapters.points(spark, sf_dir)
    return clustering.merged_points(p, p.where("id % 3 = 0").select(F.floor(F.col("id") / 10).alias("set"), "id"))


# 2.15 tracking
@query(f"{_LINKS} SELECT DISTINCT t+1 AS t,c,v2 AS label FROM links WHERE v1 IN (9,10) AND t>1")
def j14_mapped_cells(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.mapped_cells(tracking.frame_links(v), _listed(v))


@query(f"{_LINKS} SELECT t+1 AS t,c,v2 AS label,v1 AS tracked FROM (SELECT *,row_number() OVER (PARTITION BY t,c,v2 ORDER BY total DESC,n DESC,v1) k FROM links) WHERE k=1")
def r16_tracked_ids(spark, sf_dir):
    return tracking.tracked_ids(tracking.frame_links(voxels(spark, sf_dir)))


_COUNTS = f"{_LINKS}, cnt AS (SELECT t,c,label,CAST(coalesce((SELECT sum(n%5) FROM links WHERE links.t=m.t-1 AND links.c=m.c AND v2=label),0) AS BIGINT) AS n_in,CAST(coalesce((SELECT sum(n%5) FROM links WHERE links.t=m.t AND links.c=m.c AND v1=label),0) AS BIGINT) AS n_out FROM m)"


def _counts(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.change_counts(components.component_stats(v), tracking.frame_links(v).withColumn("count", F.col("n") % 5))


@query(f"{_COUNTS} SELECT * FROM cnt")
def r21_change_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"{_COUNTS}, h AS (SELECT n_out AS level,count(*) n FROM cnt GROUP BY 1) SELECT l AS level,coalesce(n,0) AS n FROM range(0,(SELECT max(n_out)+1 FROM cnt)) r(l) LEFT JOIN h ON level=l")
def a24_change_histogram(spark, sf_dir):
    return tracking.change_histogram(_counts(spark, sf_dir), "n_out")


@query(f"{_TRACKS}, sn AS (SELECT DISTINCT track FROM trk WHERE t=3) SELECT track,trk.t,round(avg(m.mx),6) AS x,round(avg(m.my),6) AS y,round(avg(m.mz),6) AS z FROM trk JOIN m ON m.t=trk.t AND m.c=trk.c AND m.label=trk.label WHERE track IN (FROM sn) AND trk.t BETWEEN 1 AND 5 GROUP BY 1,2")
def r24_track_lines(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return rounded(tracking.track_lines(tracking.tracks(tracking.frame_links(v)), components.component_stats(v), 3, 2, 2), "x", "y", "z")


@query(f"{_LINKS}, p AS (SELECT DISTINCT k.c,k.v2 FROM links k JOIN m ON m.t=k.t AND m.c=k.c AND m.label=k.v1 WHERE k.t=2 AND size>20) SELECT t,vox.c,z,y,x FROM vox JOIN p ON p.c=vox.c AND p.v2=vox.label WHERE t=3")
def r26_carried_selection(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.carried_selection(v, tracking.frame_links(v), 2, 20)


# 2.9 gait and baselines
def _walk(spark, sf_dir):
    """Two rows a series: users' positions in time order."""
    p = adapters.ruler_points(spark, sf_dir)
    rows = F.array(F.struct(F.lit(0).alias("dim"), F.col("x").cast("double").alias("value")), F.struct(F.lit(1).alias("dim"), F.col("y").cast("double").alias("value")))
    return p.select(F.col("ruler").cast("string").alias("series"), F.col("t").alias("frame"), F.inline(rows))


_CYCLE = [[1.0, 3.0, 2.0, -1.0, -2.0, 0.0, 1.0], [0.0, 1.0, 1.0, 0.0, -1.0, -1.0, 0.0]]


def _resampled(v: str, start: str, width: str, n: str) -> str:
    """SQL of ``n`` values between those of the list ``v`` from ``start`` (0-based), ``width`` of them."""
    at = f"(j*({width}-1)/({n}-1)::DOUBLE)"
    low = f"CAST(floor({at}) AS INT)"
    return f"list_transform(range(0,{n}),lambda j:{v}[{start}+1+{low}]+({at}-{low})*({v}[{start}+1+least({width}-1,{low}+1)]-{v}[{start}+1+{low}]))"


def _inner(a: str, b: str, n: str) -> str:
    return f"list_sum(list_transform(range(1,{n}+1),lambda i:{a}[i]*{b}[i]))"


#: Every window's score, the best one from each start (scores rounded to 9 decimals; the shortest of equal ones), and the chain of windows of each walk.
_GAIT = f"""WITH RECURSIVE {RULERS}, wl AS (SELECT CAST(ruler AS VARCHAR) AS series,list(x::DOUBLE ORDER BY t) v0,list(y::DOUBLE ORDER BY t) v1,CAST(count(*) AS INT) n FROM rul GROUP BY 1), cy AS (SELECT {_CYCLE[0]}::DOUBLE[] w0,{_CYCLE[1]}::DOUBLE[] w1),
st AS (SELECT *,unnest(range(0,n-1)) AS s FROM wl WHERE n>=2), sw AS (SELECT *,unnest(range(3,least(10,n-s)+1)) AS w FROM st WHERE n-s>=3), rs AS (SELECT series,s,w,{_resampled('v0', 's', 'w', '7')} r0,{_resampled('v1', 's', 'w', '7')} r1 FROM sw),
sc AS MATERIALIZED (SELECT series,s,w,{_inner('r0', 'w0', '7')}+{_inner('r1', 'w1', '7')} AS corr FROM rs,cy),
bw AS MATERIALIZED (SELECT series,s,coalesce(min(w) FILTER (WHERE q>0 AND q=most),3) AS w,greatest(max(q),0) AS corr FROM (SELECT *,max(q) OVER (PARTITION BY series,s) AS most FROM (SELECT series,s,w,round(corr,9) AS q FROM sc)) GROUP BY 1,2),
ch AS (SELECT wl.*,0 AS k,bw.s,bw.w,bw.corr FROM wl JOIN bw ON bw.series=wl.series AND bw.s=0 WHERE n>=7 UNION ALL SELECT ch.series,v0,v1,n,k+1,bw.s,bw.w,bw.corr FROM ch JOIN bw ON bw.series=ch.series AND bw.s=ch.s+greatest(1,ch.w-1) WHERE bw.s+7<=n)"""


@query(f"{_GAIT} SELECT series,CAST(s AS INT) AS start,CAST(w AS INT) AS width,round(corr,6)+0.0 AS corr FROM sc")
def t11_t12_window_scores(spark, sf_dir):
    # Adding 0 leaves no negative zero.
    return rounded(timeseries.window_scores(_walk(spark, sf_dir), _CYCLE), "corr").withColumn("corr", F.col("corr") + 0.0)


@query(f"""{_GAIT}, p AS (SELECT series,corr,{_resampled('v0', 's', 'w', '7')} r0,{_resampled('v1', 's', 'w', '7')} r1 FROM ch), q AS (SELECT wl.series,d.dim,e.phase FROM wl,range(0,2) d(dim),range(0,7) e(phase))
SELECT q.series,CAST(q.dim AS INT) AS dim,CAST(q.phase AS INT) AS phase,round(coalesce(sum(corr*CASE WHEN dim=0 THEN r0[phase+1] ELSE r1[phase+1] END)/nullif(sum(corr),0),0),6) AS value FROM q LEFT JOIN p USING (series) GROUP BY 1,2,3""")
def t13_gait_cycle(spark, sf_dir):
    return rounded(timeseries.gait_cycle(_walk(spark, sf_dir), _CYCLE), "value")


@query(f"""{_GAIT}, p AS (SELECT series,dim,s,w,CASE WHEN dim=0 THEN v0 ELSE v1 END v,CASE WHEN dim=0 THEN w0 ELSE w1 END c FROM ch,cy,range(0,2) d(dim)), r AS (SELECT *,{_resampled('c', '0', '7', 'w').replace('(7-1)', '6')} AS m FROM p),
x AS (SELECT series,dim,s,w,list_sum(list_transform(range(0,w),lambda i:v[s+1+i]*m[i+1]))/{_inner('c', 'c', '7')} AS q FROM r) SELECT series,CAST(dim AS INT) AS dim,CAST(s AS INT) AS start,CAST(w AS INT) AS width,round(sign(q)*log2(1+abs(q)),6)+0.0 AS score FROM x""")
def t14_gait_compared(spark, sf_dir):
    return rounded(timeseries.gait_compared(_walk(spark, sf_dir), _CYCLE), "score").withColumn("score", F.col("score") + 0.0)


@query(f"""{_GAIT}, p AS (SELECT series,k,dim,CASE WHEN dim=0 THEN v0 ELSE v1 END v,s,w FROM ch,range(0,2) d(dim)), r AS (SELECT series,k,dim,{_resampled('v', 's', 'w', '7')} AS m FROM p),
f AS (SELECT series,dim,k*6+j AS frame,arg_max(m[j+1],k) AS value FROM r,range(0,7) e(j) GROUP BY 1,2,3) SELECT series,CAST(dim AS INT) AS dim,CAST(frame AS INT) AS frame,round(value,6) AS value FROM f""")
def t15_gait_aligned(spark, sf_dir):
    return rounded(timeseries.gait_aligned(_walk(spark, sf_dir), _CYCLE), "value")


@query(f"""{_GAIT}, p AS (SELECT series,s,w,dim,CASE WHEN dim=0 THEN v0 ELSE v1 END v,CASE WHEN dim=0 THEN w0 ELSE w1 END c FROM ch,cy,range(0,2) d(dim)), r AS (SELECT *,{_resampled('c', '0', '7', 'w').replace('(7-1)', '6')} AS m FROM p),
x AS (SELECT series,s,sum(list_sum(list_transform(range(0,w),lambda i:v[s+1+i]-m[i+1]))) AS q FROM r GROUP BY 1,2) SELECT wl.series,CAST(count(x.s) AS INT) AS cycles,round(coalesce(sum(q*q),0),3) AS diff2 FROM wl LEFT JOIN x USING (series) GROUP BY 1""")
def t16_gait_variance(spark, sf_dir):
    return rounded(timeseries.gait_variance(_walk(spark, sf_dir), _CYCLE), "diff2", digits=3)


@query(f"{_GAIT}, x AS (SELECT series,s,w,abs(list_avg(v0[s+1:s+w])) AS q FROM ch) SELECT wl.series,CAST(count(x.s) AS INT) AS cycles,CAST(coalesce(sum(w-1),0) AS BIGINT) AS frames FROM wl LEFT JOIN x ON x.series=wl.series AND q>100.123::DOUBLE GROUP BY 1")
def t16_gait_frames(spark, sf_dir):
    return timeseries.gait_frames(_walk(spark, sf_dir), _CYCLE, 100.123, 1)


@query("WITH f AS (SELECT CAST(t AS INT) AS t,(t-1)%4 AS phase FROM range(1,1001) r(t)), v AS (SELECT t,sum([0.5,2.0,-1.0,0.25][phase+1]::DOUBLE) OVER (ORDER BY t) AS s FROM f) SELECT t,round(s*1.0,6) AS x,round(s*-2.0,6) AS y,round(s*0.5,6) AS z FROM v")
def t18_synthetic_walk(spark, sf_dir):
    cycle = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, -1.0), (3, 0.25)], "phase int, value double")
    return rounded(timeseries.synthetic_walk(cycle, 1000, (1.0, -2.0, 0.5)), "x", "y", "z")


@query(f"""WITH {RULERS}, w AS (SELECT CAST(ruler AS VARCHAR) AS series,0 AS dim,t AS frame,x AS value FROM rul UNION ALL SELECT CAST(ruler AS VARCHAR),1,t,y FROM rul),
s AS (SELECT series,sum(value) total FROM w WHERE dim=0 GROUP BY 1) SELECT series,dim,frame,round(CASE WHEN dim=0 THEN CASE WHEN total<>0 THEN value/total ELSE value END ELSE value-avg(value) OVER (PARTITION BY series,dim) END,9) AS value FROM w JOIN s USING (series)""")
def t17_axis_corrected(spark, sf_dir):
    return rounded(timeseries.axis_corrected(_walk(spark, sf_dir), 2), "value", digits=9)


_LINE_FIT = "SELECT *,list_avg(list_transform(range(0,len(v)),lambda i:pow(v[i+1]-slope*i-base,2))) s FROM (SELECT *,m-slope*mi AS base FROM (SELECT *,coalesce(list_sum(list_transform(range(0,len(v)),lambda i:(i-mi)*(v[i+1]-m)))/nullif(list_sum(list_transform(range(0,len(v)),lambda i:(i-mi)*(i-mi))),0),0) AS slope FROM (SELECT roi,v,least,list_avg(v) m,(len(v)-1)/2.0::DOUBLE mi FROM tr WHERE NOT done)))"


@query(f"WITH RECURSIVE {ROI}, series AS (SELECT roi,list(v::DOUBLE ORDER BY t) v FROM roi GROUP BY 1), {_trim_sql(_LINE_FIT, 'slope,base')} SELECT roi,round(slope,6) AS slope,round(base,6) AS base FROM tr WHERE done")
def t04_line_baseline(spark, sf_dir):
    return rounded(timeseries.line_baseline(adapters.roi_series(spark, sf_dir)), "slope", "base")


@query(f"""WITH {VOX}, {RULERS}, r AS (SELECT ruler,t,(x%50)::DOUBLE x,(y%32)::DOUBLE y,(z%7)::DOUBLE z FROM rul), s AS (SELECT *,lead(x) OVER w nx,lead(y) OVER w ny,lead(z) OVER w nz FROM r WINDOW w AS (PARTITION BY ruler ORDER BY t)),
l AS (SELECT *,sqrt(pow(nx-x,2)+pow(ny-y,2)+pow(nz-z,2)) len FROM s WHERE nx IS NOT NULL), b AS (SELECT *,coalesce(sum(len) OVER (PARTITION BY ruler ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) bef FROM l),
e AS (SELECT *,unnest(range(CAST(ceil(bef/4.0-1e-9) AS BIGINT),CAST(ceil((bef+len)/4.0-1e-9) AS BIGINT))) AS bin FROM b), h AS (SELECT *,(bin*4.0::DOUBLE-bef)/len f FROM e),
p AS (SELECT ruler,bin,CAST(floor(z+f*(nz-z)+1e-9) AS INT) z,CAST(floor(y+f*(ny-y)+1e-9) AS INT) y,CAST(floor(x+f*(nx-x)+1e-9) AS INT) x FROM h), k AS (SELECT DISTINCT t,c FROM vox)
SELECT k.t,ruler,k.c,bin,count(*) AS n,round(avg(coalesce(v.v,0)),6) AS mean FROM p CROSS JOIN k LEFT JOIN vox v ON v.t=k.t AND v.c=k.c AND v.z=p.z AND v.y=p.y AND v.x=p.x GROUP BY 1,2,3,4""")
def t08_profile_by_frame(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir).select("ruler", "t", *[(F.col(k) % n).alias(k) for k, n in zip("zyx", DIMS, strict=True)])
    return rounded(resample.profiles(p, voxels(spark, sf_dir), 4.0), "mean")


# 2.16 meshes
_TRIANGLES = [(case, nth, [p for edge in tri for p in edge]) for case in range(1, 255) for nth, tri in enumerate(mesh.cell_triangles(case))]


def _corner(i: int, axis: int) -> str:
    a, b = f"e[{2 * i + 1}]", f"e[{2 * i + 2}]"
    return f"(c{'xyz'[axis]}+(({a}>>{axis})&1)+(128.0::DOUBLE-w[{a}+1])/(w[{b}+1]-w[{a}+1])*((({b}>>{axis})&1)-(({a}>>{axis})&1))+0.5)"


def _dot(a: list[str], b: list[str]) -> str:
    return "+".join(f"({p})*({q})" for p, q in zip(a, b, strict=True))


def _times(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]})*({b[j]})-({a[j]})*({b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


_NORMAL = _times([f"{k}1-{k}0" for k in "xyz"], [f"{k}2-{k}0" for k in "xyz"])
_MESH = f"""WITH {VOX}, o AS (SELECT k,k&1 dx,(k>>1)&1 dy,(k>>2)&1 dz FROM range(0,8) r(k)), d AS (SELECT t,c,z-dz cz,y-dy cy,x-dx cx,k,v FROM vox CROSS JOIN o WHERE v>0),
w AS (SELECT t,c,cz,cy,cx,[{','.join(f'coalesce(max(CASE WHEN k={k} THEN v END),0)::DOUBLE' for k in range(8))}] w FROM d GROUP BY 1,2,3,4,5), n AS (SELECT *,{'+'.join(f'CASE WHEN w[{k + 1}]<128 THEN {1 << k} ELSE 0 END' for k in range(8))} AS cs FROM w),
tri(cs,nth,e) AS (VALUES {','.join(f'({c},{n},{e})' for c, n, e in _TRIANGLES)}), q AS (SELECT t,c,cz,cy,cx,nth,{','.join(f'{_corner(i, a)} AS {"xyz"[a]}{i}' for i in range(3) for a in range(3))} FROM n JOIN tri USING (cs))"""


@query(f"""{_MESH} SELECT t,c,count(*) AS triangles,round(sum(sqrt({_dot(_NORMAL, _NORMAL)})/2),4) AS area,round(sum(({_dot([f'{k}0' for k in 'xyz'], _times([f'{k}1' for k in 'xyz'], [f'{k}2' for k in 'xyz']))})/6),4) AS volume FROM q GROUP BY 1,2""")
def v07_a21_mesh_measures(spark, sf_dir):
    return rounded(mesh.measures(mesh.surface(voxels(spark, sf_dir), 128), ["t", "c"]), "area", "volume", digits=4)


#: Keeps the meshes of frames and channels apart while they are welded together.
_APART = 4096


def _mesh(spark, sf_dir):
    """The volume, and vertices (t, c, id, x, y, z) and triangles of the surfaces of all frames and channels, welded."""
    v = voxels(spark, sf_dir)
    tri = mesh.surface(v, 128)
    frame = F.col("t").cast("long") * 16 + F.col("c")
    key = (((frame * 64 + F.col("cz") + 1) * 64 + F.col("cy") + 1) * 64 + F.col("cx") + 1) * 8 + F.col("nth")
    apart = tri.withColumns({f"x{i}": F.col(f"x{i}") + frame * _APART for i in range(3)})
    points = cut(mesh.corners(apart, key))
    first = cut(mesh.welded(points, 1e-3))
    vertices = points.join(first.select(F.col("first").alias("id")).distinct().hint("merge"), "id", "left_semi")
    # A key of a triangle has its frame above 21 bits of the cell and its number.
    frame = F.shiftright(F.floor(F.col("id") / 3), 21)
    vertices = vertices.select(F.floor(frame / 16).cast("int").alias("t"), (frame % 16).cast("int").alias("c"), "id", (F.col("x") - frame * _APART).alias("x"), "y", "z")
    place = [F.max(F.when(F.col("id") % 3 == k, F.col("first"))).alias(q) for k, q in enumerate("abc")]
    return v, cut(vertices), cut(first.groupBy(F.floor(F.col("id") / 3)).agg(*place).select("a", "b", "c"))


# 2.1 reduced levels
@query(f"WITH {VOX} SELECT t,c,z>>1 AS z,y>>1 AS y,x>>1 AS x,CAST(floor(avg(v)) AS INT) AS v FROM vox GROUP BY 1,2,3,4,5")
def s16_reduced_level(spark, sf_dir):
    return volumes.level(voxels(spark, sf_dir), 1)
