"""Registered queries of the reference's operators and their DuckDB SQL.

Names begin with the operator's identity in the survey.  Doubles are rounded
where engines may add in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry
from .operators import algebra, clustering, components, density, records, resample, segmentation, stats, stencil, timeseries, tracking
from .plans import adapters
from .plans.adapters import DIMS, POINTS, RECORDS, ROI, RULERS, VOX, voxels
from .sources import export
from .streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def channel(spark: SparkSession, sf_dir: str, c: int) -> DataFrame:
    return voxels(spark, sf_dir).where(F.col("c") == c)


# 2.3 voxel algebra
_AB = f"""WITH {VOX}, j AS (SELECT t, z, y, x, coalesce(a.v/255.0::DOUBLE,0) va, coalesce(b.v/255.0::DOUBLE,0) vb, coalesce(a.mask/255.0::DOUBLE,0) ma, coalesce(b.mask/255.0::DOUBLE,0) mb
 FROM (SELECT * FROM vox WHERE c=0) a FULL JOIN (SELECT * FROM vox WHERE c=1) b USING (t,z,y,x))"""


@query(f"""{_AB} SELECT t, z, y, x, round(greatest(va-vb,0),6) AS subtract, round(least(va+vb,1),6) AS "add",
 round(CASE WHEN va>1e-5 AND vb>1e-5 THEN least(va/vb,1) ELSE 0 END,6) AS divide, round(least(va,vb),6) AS intersect, round(least(va*ma,vb*mb),6) AS intersect_masked FROM j""")
def p01_p05_combine(spark, sf_dir):
    return rounded(algebra.combine(channel(spark, sf_dir, 0), channel(spark, sf_dir, 1)), "subtract", "add", "divide", "intersect", "intersect_masked")


@query(f"WITH {VOX} SELECT t, c, z, y, x, CAST(floor(v*(mask/255.0)+0.5) AS INT) AS v FROM vox")
def p06_extract(spark, sf_dir):
    return algebra.extract(voxels(spark, sf_dir)).select("t", "c", "z", "y", "x", "v")


@query(f"WITH {VOX} SELECT t, c, z, y, x, CAST(floor(v*(1-mask/255.0)+0.5) AS INT) AS v FROM vox")
def p07_delete(spark, sf_dir):
    return algebra.extract(voxels(spark, sf_dir), inverse=True).select("t", "c", "z", "y", "x", "v")


@query(f"""WITH {VOX}, f AS (SELECT t,c,z,y,x FROM vox WHERE v>60),
b AS (SELECT t,c,min(z) lz,max(z) hz,min(y) ly,max(y) hy,min(x) lx,max(x) hx FROM f GROUP BY 1,2),
g AS (SELECT b.*, z.z, y.y, x.x FROM b, range(0,7) z(z), range(0,32) y(y), range(0,50) x(x) WHERE z.z BETWEEN lz AND hz AND y.y BETWEEN ly AND hy AND x.x BETWEEN lx AND hx),
m AS (SELECT g.*, f.t IS NOT NULL AS o FROM g LEFT JOIN f ON g.t=f.t AND g.c=f.c AND g.z=f.z AND g.y=f.y AND g.x=f.x),
k AS (SELECT *, max(CASE WHEN o THEN x END) OVER (PARTITION BY t,c,z,y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) xa,
 min(CASE WHEN o THEN x END) OVER (PARTITION BY t,c,z,y ORDER BY x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) xb,
 max(CASE WHEN o THEN y END) OVER (PARTITION BY t,c,z,x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ya,
 min(CASE WHEN o THEN y END) OVER (PARTITION BY t,c,z,x ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) yb,
 max(CASE WHEN o THEN z END) OVER (PARTITION BY t,c,y,x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) za,
 min(CASE WHEN o THEN z END) OVER (PARTITION BY t,c,y,x ORDER BY z ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) zb FROM m)
SELECT t, c, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 255 AS v FROM k WHERE o OR (x-xa<=floor((hx-lx+1)/2) AND xb-x<=floor((hx-lx+1)/2)
 AND y-ya<=floor((hy-ly+1)/2) AND yb-y<=floor((hy-ly+1)/2) AND z-za<=hz-lz+1 AND zb-z<=hz-lz+1)""")
def p08_fill_holes(spark, sf_dir):
    return algebra.fill_holes(voxels(spark, sf_dir), 60)


@query(f"""WITH {VOX}, k AS (SELECT * FROM (VALUES (0,1.0,0.25,0.0),(1,0.0,1.0,0.5),(2,0.5,0.0,1.0)) q(c,r,g,b))
SELECT t, z, y, x, CAST(least(sum(floor(r*v+0.5)),255) AS INT) AS r, CAST(least(sum(floor(g*v+0.5)),255) AS INT) AS g, CAST(least(sum(floor(b*v+0.5)),255) AS INT) AS b FROM vox JOIN k USING (c) GROUP BY 1,2,3,4""")
def p09_rgb(spark, sf_dir):
    colours = spark.createDataFrame([(0, 1.0, 0.25, 0.0), (1, 0.0, 1.0, 0.5), (2, 0.5, 0.0, 1.0)], "c int, r double, g double, b double")
    return algebra.rgb(voxels(spark, sf_dir), colours)


@query(f"WITH {VOX} SELECT t, z, y, x, round(sum(v)*0.25::DOUBLE,6) AS v FROM vox GROUP BY 1,2,3,4")
def p11_average(spark, sf_dir):
    return rounded(algebra.average_channels(voxels(spark, sf_dir), 0.25), "v")


@query(f"""WITH {VOX}, u AS (SELECT t,c,z,y,x, v/255.0::DOUBLE w FROM vox)
SELECT t,c,z,y,x, round(CASE WHEN w<0.3 THEN CASE WHEN w>0.2 THEN 1-(0.3-w)/0.1 ELSE 0 END WHEN w>0.8 THEN CASE WHEN w<0.9 THEN 1-(w-0.8)/0.1 ELSE 0 END ELSE 1 END * pow(least(greatest(w/0.9,0),1),1/1.5),6) AS v FROM u""")
def p10_x01_transfer(spark, sf_dir):
    return voxels(spark, sf_dir).select("t", "c", "z", "y", "x", F.round(geometry.transferred(algebra.unit(), 0.3, 0.8, 0.1, 0.9, 1.5), 6).alias("v"))


@query(f"""WITH {VOX}, j AS (SELECT t,z,y,x, coalesce(a.mask,0) a, coalesce(b.mask,0) b FROM (SELECT * FROM vox WHERE c=0) a FULL JOIN (SELECT * FROM vox WHERE c=1) b USING (t,z,y,x))
SELECT t,z,y,x, b AS m_replace, greatest(a,b) AS m_union, CASE WHEN a>0 AND b>0 THEN 0 ELSE a END AS m_exclude, least(a,b) AS m_intersect FROM j""")
def u01_masks(spark, sf_dir):
    a, b = channel(spark, sf_dir, 0), channel(spark, sf_dir, 1)
    out = None
    for how in ("replace", "union", "exclude", "intersect"):
        part = algebra.mask_union(a, b, how).withColumnRenamed("mask", f"m_{how}")
        out = part if out is None else out.join(part, algebra.POSITION)
    return out


# 2.4 selection
@query(f"WITH {VOX}, h AS (SELECT DISTINCT t,c,label FROM vox WHERE mask>0 AND label<>0) SELECT t,c,z,y,x,label, CASE WHEN h.label IS NOT NULL THEN 255 ELSE 0 END AS mask FROM vox LEFT JOIN h USING (t,c,label)")
def f05_touched(spark, sf_dir):
    return components.touched(voxels(spark, sf_dir)).select("t", "c", "z", "y", "x", "label", "mask")


@query(f"WITH {VOX} SELECT t,c,label,count(*) AS n FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3 HAVING count(*)>20 AND count(*)<200")
def f03_size(spark, sf_dir):
    return components.size_filter(components.component_stats(voxels(spark, sf_dir)), 20, 200).select("t", "c", "label", "n")


@query(f"WITH {VOX} SELECT t,c,z,y,x,v FROM vox WHERE (x+0.5)/50>=0.2 AND (y+0.5)/32<=0.75 AND ((x+0.5)/50+(y+0.5)/32+(z+0.5)/7)>=1")
def f11_clip_planes(spark, sf_dir):
    v = voxels(spark, sf_dir)
    planes = [(1.0, 0.0, 0.0, -0.2), (0.0, -1.0, 0.0, 0.75), (1.0, 1.0, 1.0, -1.0)]
    return v.where(geometry.inside_planes((F.col("x") + 0.5) / 50, (F.col("y") + 0.5) / 32, (F.col("z") + 0.5) / 7, planes)).select("t", "c", "z", "y", "x", "v")


@query(f"WITH {VOX} SELECT t,c,count_if(mask>0 AND x IN (10,40)) AS n FROM vox GROUP BY 1,2")
def f13_box_faces(spark, sf_dir):
    return stats.box_face_counts(voxels(spark, sf_dir), ["t", "c"], 10, 40)


@query(f"WITH {VOX} SELECT t,c,z,y,x, CASE WHEN label=9 THEN 255 ELSE 0 END AS mask FROM vox")
def f08_mask_only_id(spark, sf_dir):
    return segmentation.mask_only_id(voxels(spark, sf_dir), 9).select("t", "c", "z", "y", "x", "mask")


# 2.6 aggregations
@query(f"""WITH {VOX} SELECT t,c,count_if(v>0) AS n, CAST(sum(CASE WHEN v>0 THEN v ELSE 0 END) AS BIGINT) AS total, count_if(v>0 AND mask>0) AS n_masked,
 CAST(sum(CASE WHEN v>0 AND mask>0 THEN v ELSE 0 END) AS BIGINT) AS total_masked, min(CASE WHEN v>0 THEN v END) AS least, max(v) AS most, count_if(mask>0) AS mask_voxels,
 CAST(sum(CASE WHEN mask>0 THEN v ELSE 0 END) AS BIGINT) AS mask_total FROM vox GROUP BY 1,2""")
def a01_a03_a07_basic(spark, sf_dir):
    return stats.basic(voxels(spark, sf_dir), ["t", "c"])


@query(f"WITH {VOX} SELECT t,c,v,count(*) AS n FROM vox WHERE v>0 GROUP BY 1,2,3")
def a04_histogram(spark, sf_dir):
    return stats.integer_histogram(voxels(spark, sf_dir), ["t", "c"])


@query(f"""WITH {VOX}, h AS (SELECT t,c,v,count(*) n FROM vox WHERE v>0 GROUP BY 1,2,3),
k AS (SELECT *, sum(n) OVER (PARTITION BY t,c ORDER BY v) b, sum(n) OVER (PARTITION BY t,c) a, max(n) OVER (PARTITION BY t,c) m FROM h)
SELECT t,c,min(CASE WHEN b>=floor(a/2) THEN v END) AS median, min(CASE WHEN n=m THEN v END) AS mode FROM k GROUP BY 1,2""")
def a05_median_mode(spark, sf_dir):
    return stats.order_statistics(voxels(spark, sf_dir), ["t", "c"])


@query(f"WITH {VOX}, h AS (SELECT t,c,CAST(floor(v*14/255) AS INT) AS bin,count(*) AS n FROM vox GROUP BY 1,2,3) SELECT t,c,bin,n,round(n/sum(n) OVER (PARTITION BY t,c),6) AS share FROM h")
def a08_a09_bins(spark, sf_dir):
    return rounded(stats.binned_histogram(voxels(spark, sf_dir), ["t", "c"], 15), "share")


@query(f"WITH {VOX}, h AS (SELECT t,c,CAST(floor(v*127/255) AS INT) AS bin,count(*) AS n FROM vox GROUP BY 1,2,3) SELECT t,c,bin,n,round(n/sum(n) OVER (PARTITION BY t,c),6) AS share FROM h")
def a10_display_bins(spark, sf_dir):
    return rounded(stats.binned_histogram(voxels(spark, sf_dir), ["t", "c"], 128), "share")


@query(f"""WITH {VOX} SELECT t,c,count(*) AS n,CAST(sum(v) AS BIGINT) AS total FROM vox
 WHERE v>0 AND pow(((x+0.5-25)*12+(y+0.5-16)*0)/144.0,2)+pow(((x+0.5-25)*0+(y+0.5-16)*8)/64.0,2)<=1 GROUP BY 1,2""")
def a13_t06_roi(spark, sf_dir):
    return stats.ellipse_mean(voxels(spark, sf_dir), ["t", "c"], (25.0, 16.0), (12.0, 0.0), (0.0, 8.0))


_PAIRS = f"""WITH {VOX}, p AS (SELECT a.t,a.c c1,b.c c2,CAST(sum(a.v*b.v) AS BIGINT) AS dot,count(*) AS n,CAST(sum(least(a.v,b.v)) AS BIGINT) AS least_sum,
 count_if(a.v>64 AND a.v<=255 AND b.v>64 AND b.v<=255) AS inside, CAST(sum(CASE WHEN a.v>64 AND a.v<=255 AND b.v>64 AND b.v<=255 THEN a.v ELSE 0 END) AS BIGINT) AS inside_sum,
 count_if(a.mask>0 AND b.mask>0) AS n_masked, CAST(sum(CASE WHEN a.mask>0 AND b.mask>0 THEN a.v*b.v ELSE 0 END) AS BIGINT) AS dot_masked
 FROM vox a JOIN vox b ON a.t=b.t AND a.z=b.z AND a.y=b.y AND a.x=b.x WHERE a.v>0 AND b.v>0 GROUP BY 1,2,3)"""


@query(f"{_PAIRS} SELECT * FROM p")
def a14_a19_colocalization(spark, sf_dir):
    return stats.colocalization(voxels(spark, sf_dir))


@query(f"""{_PAIRS} SELECT p.t,p.c1,p.c2,round(CASE WHEN coalesce(j.dot,0)<>0 AND coalesce(i.dot,0)<>0 THEN 100.0::DOUBLE*p.dot/i.dot ELSE 0 END,6) AS ratio FROM p
 LEFT JOIN p i ON i.t=p.t AND i.c1=p.c1 AND i.c2=p.c1 LEFT JOIN p j ON j.t=p.t AND j.c1=p.c2 AND j.c2=p.c2""")
def a20_ratio(spark, sf_dir):
    return rounded(stats.ratio_matrix(stats.colocalization(voxels(spark, sf_dir)), "dot"), "ratio")


@query(f"""WITH {VOX} SELECT t,c,count(*) AS n,round(avg(x),6) AS mx,round(avg(y),6) AS my,round(avg(z),6) AS mz,round(covar_pop(x,x)*count(*),4) AS sxx,round(covar_pop(x,y)*count(*),4) AS sxy,
 round(covar_pop(x,z)*count(*),4) AS sxz,round(covar_pop(y,y)*count(*),4) AS syy,round(covar_pop(y,z)*count(*),4) AS syz,round(covar_pop(z,z)*count(*),4) AS szz FROM vox WHERE mask>=1 GROUP BY 1,2""")
def a22_scatter(spark, sf_dir):
    s = stats.scatter(voxels(spark, sf_dir), ["t", "c"])
    return rounded(rounded(s, "mx", "my", "mz"), "sxx", "sxy", "sxz", "syy", "syz", "szz", digits=4)


@query(f"WITH {VOX}, s AS (SELECT t,c,label,count(*) n FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3) SELECT t,c,count(*) AS comps,CAST(sum(n) AS BIGINT) AS voxels,round(sum(n)*3.0::DOUBLE,6) AS phys FROM s WHERE n>20 GROUP BY 1,2")
def a23_component_count(spark, sf_dir):
    s = components.size_filter(components.component_stats(voxels(spark, sf_dir)), 20)
    return s.groupBy("t", "c").agg(F.count("*").alias("comps"), F.sum("n").alias("voxels"), F.round(F.sum("n") * 3.0, 6).alias("phys"))


@query(f"WITH {VOX} SELECT t,c,min(x) AS lo_x,max(x) AS hi_x,min(y) AS lo_y,max(y) AS hi_y,min(z) AS lo_z,max(z) AS hi_z FROM vox WHERE mask>0 GROUP BY 1,2")
def a28_bounds(spark, sf_dir):
    return stats.bounds(voxels(spark, sf_dir), ["t", "c"])


# 2.7 components
_STATS = f"""WITH {VOX}, s AS (SELECT t,c,label,count(*) AS n,CAST(sum(v) AS BIGINT) AS total,min(v) AS least,max(v) AS most,min(x) AS lo_x,max(x) AS hi_x,min(y) AS lo_y,max(y) AS hi_y,
 min(z) AS lo_z,max(z) AS hi_z,avg(v) AS mean,sqrt(greatest(0.0,(sum(v*v)-sum(v)*sum(v)/count(*))/count(*))) AS sigma,avg(x) AS cx,avg(y) AS cy,avg(z) AS cz FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3)"""


@query(f"{_STATS} SELECT * REPLACE (round(mean,6) AS mean, round(sigma,6) AS sigma, round(cx,6) AS cx, round(cy,6) AS cy, round(cz,6) AS cz) FROM s")
def c01_component_stats(spark, sf_dir):
    return rounded(components.component_stats(voxels(spark, sf_dir)), "mean", "sigma", "cx", "cy", "cz")


@query(f"{_STATS} SELECT t,c,label,round(n*3.0::DOUBLE,6) AS phys_size,round(total*0.5::DOUBLE,6) AS phys_total,round(cx,6) AS px,round(cy,6) AS py,round(cz*3,6) AS pz FROM s")
def c05_scaled(spark, sf_dir):
    return rounded(components.scaled(components.component_stats(voxels(spark, sf_dir)), (1.0, 1.0, 3.0), 0.5), "phys_size", "phys_total", "px", "py", "pz")


_OFF6 = "o(dz,dy,dx) AS (VALUES (0,0,1),(0,0,-1),(0,1,0),(0,-1,0),(1,0,0),(-1,0,0)), l AS (SELECT * FROM vox WHERE label<>0 AND v>0)"


@query(f"""WITH {VOX}, {_OFF6}, n AS (SELECT a.t,a.c,a.z,a.y,a.x,count(*) AS same FROM l a CROSS JOIN o JOIN l b ON b.t=a.t AND b.c=a.c AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx AND b.label=a.label GROUP BY 1,2,3,4,5)
SELECT l.t,l.c,l.label,count(*) FILTER (WHERE coalesce(same,0)<6) AS n_surface,CAST(coalesce(sum(l.v) FILTER (WHERE coalesce(same,0)<6),0) AS BIGINT) AS total_surface FROM l LEFT JOIN n ON n.t=l.t AND n.c=l.c AND n.z=l.z AND n.y=l.y AND n.x=l.x GROUP BY 1,2,3""")
def c06_surface(spark, sf_dir):
    return components.surface(voxels(spark, sf_dir))


@query(f"""WITH {VOX}, m AS (SELECT t,c,label,count(*) n,covar_pop(x,x)*count(*) a,covar_pop(x,y)*count(*) b,covar_pop(x,z)*3*count(*) e,covar_pop(y,y)*count(*) d,covar_pop(y,z)*3*count(*) f,covar_pop(z,z)*9*count(*) g FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3 HAVING count(*)>=2),
q AS (SELECT *,(a+d+g)/3 AS o,sqrt((pow(a-(a+d+g)/3,2)+pow(d-(a+d+g)/3,2)+pow(g-(a+d+g)/3,2)+2*(b*b+e*e+f*f))/6) AS p FROM m),
r AS (SELECT *,CASE WHEN p=0 THEN 0 ELSE acos(greatest(-1,least(1,((a-o)*((d-o)*(g-o)-f*f)-b*(b*(g-o)-f*e)+e*(b*f-(d-o)*e))/(2*p*p*p))))/3 END AS u FROM q)
SELECT t,c,label,n,round(o+2*p*cos(u)+2e-5,3) AS e1,round(o+2*p*cos(u+4*pi()/3)+2e-5,3) AS e2,round(o+2*p*cos(u+2*pi()/3)+2e-5,3) AS e3 FROM r""")
def c07_principal_lengths(spark, sf_dir):
    v = voxels(spark, sf_dir).where("label <> 0 and v > 0").withColumn("mask", F.lit(255))
    e = stats.principal_lengths(stats.scatter(v, ["t", "c", "label"]).where("n >= 2"), (1.0, 1.0, 3.0))
    # A little above the middle between two decimals, where engines that add up in another order may differ.
    return e.select("t", "c", "label", "n", *[F.round(F.col(f"e{i}") + 2e-5, 3).alias(f"e{i}") for i in (1, 2, 3)])


@query(f"WITH {VOX} SELECT a.t,a.c,a.label,b.c AS other,count(*) AS n,CAST(sum(b.v) AS BIGINT) AS total FROM vox a JOIN vox b ON a.t=b.t AND a.z=b.z AND a.y=b.y AND a.x=b.x WHERE a.label<>0 AND a.v>0 AND b.v>0 AND a.c<>b.c GROUP BY 1,2,3,4")
def c12_j16_channel_overlap(spark, sf_dir):
    return components.channel_overlap(voxels(spark, sf_dir))


@query(f"WITH {VOX}, s AS (SELECT t,c,label,count(*) n FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3) SELECT t,c,label,round((n-min(n) OVER ())/(max(n) OVER ()-min(n) OVER ()),6) AS shade FROM s")
def c17_size_colour(spark, sf_dir):
    return rounded(components.size_colour(components.component_stats(voxels(spark, sf_dir))), "shade")


@query(f"WITH {VOX} SELECT DISTINCT t,c,label,(CAST(t AS BIGINT)<<32)|label AS ext,CASE WHEN label>20 THEN label|2147483648 ELSE label END AS fixed FROM vox WHERE label<>0")
def c14_x15_ids(spark, sf_dir):
    v = voxels(spark, sf_dir).where("label <> 0").select("t", "c", "label").distinct()
    return v.select("t", "c", "label", geometry.extended_id(F.col("t"), F.col("label")).alias("ext"), geometry.fixed(F.col("label"), F.col("label"), 21).alias("fixed"))


# 2.5 joins, 2.10 top-k
_LINKS = f"""WITH {VOX}, l AS (SELECT * FROM vox WHERE label<>0 AND v>0), m AS (SELECT t,c,label,count(*) AS size,avg(x) mx,avg(y) my,avg(z) mz FROM l GROUP BY 1,2,3),
k AS (SELECT a.t,a.c,a.label v1,b.label v2,count(*) AS n,CAST(sum(least(a.v,b.v)) AS BIGINT) AS total FROM l a JOIN l b ON b.t=a.t+1 AND b.c=a.c AND b.z=a.z AND b.y=a.y AND b.x=a.x GROUP BY 1,2,3,4),
links AS (SELECT k.t,k.c,v1,v2,n,total,round(sqrt(pow(p.mx-q.mx,2)+pow(p.my-q.my,2)+pow(p.mz-q.mz,2)),6) AS dist FROM k JOIN m p ON p.t=k.t AND p.c=k.c AND p.label=v1 JOIN m q ON q.t=k.t+1 AND q.c=k.c AND q.label=v2)"""


@query(f"{_LINKS} SELECT * FROM links")
def j04_r02_frame_links(spark, sf_dir):
    return tracking.frame_links(voxels(spark, sf_dir))


@query(f"{_LINKS} SELECT *, row_number() OVER (PARTITION BY t,c,v1 ORDER BY total DESC,n DESC,v2) AS rank FROM links")
def o03_ranked_links(spark, sf_dir):
    return tracking.ranked_links(tracking.frame_links(voxels(spark, sf_dir)))


@query(f"{_LINKS} SELECT *, max(total) OVER (PARTITION BY t,c,v1)-total < 0.2::DOUBLE*max(total) OVER (PARTITION BY t,c,v1) AS linked FROM links")
def r08_r10_best_links(spark, sf_dir):
    return tracking.best_links(tracking.frame_links(voxels(spark, sf_dir)))


@query(f"""{_LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY t,c,v1 ORDER BY total DESC,n DESC,v2) AS rank, max(total) OVER (PARTITION BY t,c,v1) m FROM links),
f AS (SELECT *, min(CASE WHEN NOT (m-total<0.2::DOUBLE*m) THEN rank END) OVER (PARTITION BY t,c,v1) g FROM r) SELECT t,c,v1,v2,n,total,dist,rank,(g IS NULL OR rank<g) AS kept FROM f""")
def r09_trimmed_links(spark, sf_dir):
    return tracking.trimmed_links(tracking.frame_links(voxels(spark, sf_dir)))


_VALENCE = f"{_LINKS}, val AS (SELECT t,c,label,size,(SELECT count(*) FROM links WHERE links.t=m.t AND links.c=m.c AND v1=label) AS n_out,(SELECT count(*) FROM links WHERE links.t=m.t-1 AND links.c=m.c AND v2=label) AS n_in FROM m WHERE size>=25)"


@query(f"{_VALENCE} SELECT * FROM val")
def r06_valence(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.valences(v, tracking.frame_links(v))


@query(f"""{_VALENCE} SELECT t,c,count_if(t>(SELECT min(t) FROM val) AND n_in=0) AS orphans_in,count_if(t>(SELECT min(t) FROM val) AND n_in>1) AS multi_in,
 count_if(t<(SELECT max(t) FROM val) AND n_out=0) AS orphans_out,count_if(t<(SELECT max(t) FROM val) AND n_out>1) AS multi_out FROM val GROUP BY 1,2""")
def u07_r20_link_report(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.link_report(tracking.valences(v, tracking.frame_links(v)))


_CONTACTS = f"""con AS (SELECT a.t,a.c,least(a.label,b.label) a,greatest(a.label,b.label) b,count(*) AS n,CAST(sum(least(a.v,b.v)) AS BIGINT) AS total FROM l a CROSS JOIN o JOIN l b ON b.t=a.t AND b.c=a.c AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx
 WHERE a.label<>b.label AND least(a.v,b.v)>153 GROUP BY 1,2,3,4)"""


@query(f"WITH {VOX}, {_OFF6}, {_CONTACTS} SELECT * FROM con")
def j05_contacts(spark, sf_dir):
    return components.contacts(voxels(spark, sf_dir))


@query(f"""{_LINKS}, o(dz,dy,dx) AS (VALUES (0,0,1),(0,0,-1),(0,1,0),(0,-1,0),(1,0,0),(-1,0,0)), {_CONTACTS},
p AS (SELECT DISTINCT x.t+1 AS t,x.c,x.v2 a,y.v2 b FROM links x JOIN links y ON x.t=y.t AND x.c=y.c AND x.v1=y.v1 WHERE x.v2<y.v2)
SELECT p.t,p.c,p.a,p.b,con.n AS faces FROM p JOIN con ON con.t=p.t AND con.c=p.c AND con.a=p.a AND con.b=p.b JOIN m i ON i.t=p.t AND i.c=p.c AND i.label=p.a JOIN m j ON j.t=p.t AND j.c=p.c AND j.label=p.b
WHERE con.n/least(i.size,j.size)>0.05""")
def r04_merge_candidates(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.merge_candidates(tracking.frame_links(v), components.contacts(v), components.component_stats(v), 0.05)


@query(f"""{_STATS}, p AS (SELECT a.t,a.c,a.label a,b.label b,round(sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)+pow(a.cz-b.cz,2)),6) AS dist FROM s a JOIN s b ON a.t=b.t AND a.c=b.c AND a.label<>b.label)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t,c,a ORDER BY dist,b) AS rank FROM p) WHERE rank<=3""")
def j06_o01_nearest(spark, sf_dir):
    return components.nearest_components(components.component_stats(voxels(spark, sf_dir)), 3)


@query(f"""WITH {RECORDS}, q AS (SELECT rec_id q_id,hist q_hist FROM rec WHERE rec_id%100=0), p AS (SELECT q_id,rec_id,list_sum(list_transform(range(1,9), lambda i: (hist[i]-q_hist[i])*(hist[i]-q_hist[i])::DOUBLE)) AS dist FROM rec, q)
SELECT q_id,rec_id,dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist,rec_id DESC) k FROM p) WHERE k=1""")
def j09_nearest_record(spark, sf_dir):
    r = adapters.records(spark, sf_dir).select("rec_id", "hist")
    return records.nearest(r, r.where("rec_id % 100 = 0").select(F.col("rec_id").alias("q_id"), F.col("hist").alias("q_hist")))


# 2.8 stencils; each oracle gathers clamped neighbours
#: A volume with a sample at nearly every place: blocks of the other one by their largest.
COARSE = f"{VOX.replace('vox AS (', 'vox2 AS (')}, vox AS (SELECT t,c,z,y//4 AS y,x//5 AS x,max(v) AS v FROM vox2 GROUP BY 1,2,3,4,5)"


def coarse(spark, sf_dir):
    return voxels(spark, sf_dir).groupBy("t", "c", "z", F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 5).cast("int").alias("x")).agg(F.max("v").alias("v"))


def _stencil_sql(value: str, offsets: str, final: str = "CAST(floor(least(greatest(r,0),1)*255+1e-6) AS INT)", small: bool = False) -> str:
    if small:
        out = _stencil_sql(value, offsets, final).replace(VOX, COARSE)
        return out.replace("range(0,32)", "range(0,8)").replace("range(0,50)", "range(0,10)").replace(",31)", ",7)").replace(",49)", ",9)")
    return f"""WITH {VOX}, s AS (SELECT DISTINCT t,c FROM vox), g AS (SELECT t,c,CAST(z AS INT) z,CAST(y AS INT) y,CAST(x AS INT) x FROM s,range(0,7) a(z),range(0,32) b(y),range(0,50) d(x)),
o AS (SELECT * FROM range(-1,2) i(dz),range(-1,2) j(dy),range(-1,2) k(dx) WHERE {offsets}),
q AS (SELECT g.t,g.c,g.z,g.y,g.x,dz,dy,dx,coalesce(v.v,0)/255.0::DOUBLE AS w FROM g CROSS JOIN o LEFT JOIN vox v ON v.t=g.t AND v.c=g.c AND v.z=least(greatest(g.z+dz,0),6) AND v.y=least(greatest(g.y+dy,0),31) AND v.x=least(greatest(g.x+dx,0),49)),
e AS (SELECT t,c,z,y,x,{value} AS r FROM q GROUP BY 1,2,3,4,5), f AS (SELECT t,c,z,y,x,{final} AS v FROM e) SELECT * FROM f WHERE v<>0"""


def _stencil(name: str, fn, value: str, offsets: str = "true", small: bool = False) -> None:
    def run(spark, sf_dir):
        return stencil.apply(coarse(spark, sf_dir), (7, 8, 10), 1, fn) if small else stencil.apply(voxels(spark, sf_dir), DIMS, 1, fn)

    run.__name__ = name
    query(_stencil_sql(value, offsets, small=small))(run)


_C = "sum(CASE WHEN dz=0 AND dy=0 AND dx=0 THEN w ELSE 0 END)"
_stencil("w01_box", stencil.box_mean, "round(sum(w)/27,9)")
_stencil("w02_max", stencil.dilate, "max(w)")
_stencil("w03_min", stencil.erode, "min(w)", small=True)
_stencil("w04_median", stencil.median, "list_sort(list(w))[13]")
_stencil("w05_gradient", stencil.gradient, f"round(max(w)-{_C},9)")
_stencil("w13_laplacian", stencil.laplacian, f"round(sum(w)-27*{_C},9)")
_stencil("w14_sharpen", stencil.kernel(lambda dz, dy, dx: 2.0 if dz == dy == dx == 0 else (-1 / 26)), f"round(2*{_C}-(sum(w)-{_C})/26,9)")
_stencil("w12_convolution", stencil.kernel(lambda dz, dy, dx: (dz + 2 * dy + 3 * dx + 7) / 189), "round(sum(w*(dz+2*dy+3*dx+7))/189,9)")
_stencil("w10_gauss_2d", stencil.gaussian(1.0, True), "round(sum(w*exp(-(dz*dz+dy*dy+dx*dx)/2.0))/sum(exp(-(dz*dz+dy*dy+dx*dx)/2.0)),9)", "dz=0")
_stencil("w11_gauss_3d", stencil.gaussian(1.0), "round(sum(w*exp(-(dz*dz+dy*dy+dx*dx)/2.0))/sum(exp(-(dz*dz+dy*dy+dx*dx)/2.0)),9)")
_stencil("w09_gauss_2d_fixed", stencil.kernel(lambda dz, dy, dx: (2 - abs(dy)) * (2 - abs(dx)) / 16, True), "round(sum(w*(2-abs(dy))*(2-abs(dx)))/16,9)", "dz=0")
_stencil("w08_gauss_3d_fixed", stencil.kernel(lambda dz, dy, dx: (2 - abs(dz)) * (2 - abs(dy)) * (2 - abs(dx)) / 64), "round(sum(w*(2-abs(dz))*(2-abs(dy))*(2-abs(dx)))/64,9)")
_stencil("w15_sobel", stencil.sobel, "round(sqrt(pow(sum(w*dz*(2-abs(dy))*(2-abs(dx))),2)+pow(sum(w*dy*(2-abs(dz))*(2-abs(dx))),2)+pow(sum(w*dx*(2-abs(dz))*(2-abs(dy))),2)),9)")
_stencil("w25_gradient_magnitude", stencil.central_gradient, "round(sqrt(pow(sum(w*dz)/2,2)+pow(sum(w*dy)/2,2)+pow(sum(w*dx)/2,2)),9)", "abs(dz)+abs(dy)+abs(dx)=1")
_stencil("w06_erode_3d", stencil.direction_erode(False), "min(w)", small=True)
_stencil("w06b_erode_2d", stencil.direction_erode(True), "min(w)", "dz=0", small=True)
_stencil("w07b_background_2d", stencil.remove_background(0.01, 0.5, 1.5, True),
         f"round(CASE WHEN stddev_pop(w)<0.01 OR {_C}-avg(w)<stddev_pop(w)*0.5 THEN 0 WHEN {_C}-avg(w)>stddev_pop(w)*1.5 THEN {_C}-avg(w) ELSE {_C} END,9)", "dz=0")
_stencil("w07_background_3d", stencil.remove_background(0.01, 0.5, 1.5),
         f"round(CASE WHEN stddev_pop(w)<0.01 OR {_C}-avg(w)<stddev_pop(w)*0.5 THEN 0 WHEN {_C}-avg(w)>stddev_pop(w)*1.5 THEN {_C}-avg(w) ELSE {_C} END,9)")
_G = "(sum(w*exp(-(dz*dz+dy*dy+dx*dx)/2.0))/sum(exp(-(dz*dz+dy*dy+dx*dx)/2.0)))"
_stencil("w16_wiener", stencil.wiener(1.0, 0.1), f"round({_C}*least(greatest({_G}/({_G}*{_G}+0.1),0),2),9)")


@query(f"WITH {VOX} SELECT t,c,z,y,x,CASE WHEN v>=128 THEN 255 ELSE 0 END AS v FROM vox")
def w18_binarize(spark, sf_dir):
    return stencil.binarize(voxels(spark, sf_dir), 128).select("t", "c", "z", "y", "x", "v")


@query(f"WITH {VOX} SELECT t,c,CAST(floor(z/4) AS INT) AS bz,CAST(floor(y/8) AS INT) AS by,CAST(floor(x/8) AS INT) AS bx,round(avg(v),6) AS mean,round(stddev_pop(v),6) AS sigma FROM vox GROUP BY 1,2,3,4,5")
def w23_tiles(spark, sf_dir):
    return rounded(stencil.tile_stats(voxels(spark, sf_dir), (4, 8, 8)), "mean", "sigma")


# 2.9 time
@query(f"WITH {RULERS}, s AS (SELECT ruler,t,x-lag(x) OVER w AS a,y-lag(y) OVER w AS b,z-lag(z) OVER w AS d FROM rul WINDOW w AS (PARTITION BY ruler ORDER BY t)) SELECT ruler,t,round(a/0.5::DOUBLE,6) AS vx,round(b/0.5::DOUBLE,6) AS vy,round(d/0.5::DOUBLE,6) AS vz FROM s WHERE a IS NOT NULL")
def t01_speed(spark, sf_dir):
    return rounded(timeseries.speeds(adapters.ruler_points(spark, sf_dir), 0.5), "vx", "vy", "vz")


@query(f"WITH {ROI}, b AS (SELECT t,v FROM roi WHERE roi='click') SELECT roi,roi.t,round(CASE WHEN b.v>0 THEN roi.v/b.v::DOUBLE ELSE roi.v END,6) AS ratio FROM roi LEFT JOIN b ON roi.t=b.t WHERE roi<>'click'")
def t05_ratio(spark, sf_dir):
    return rounded(timeseries.over_background(adapters.roi_series(spark, sf_dir), "click"), "ratio")


def _trim_sql(fits: str, names: str) -> str:
    """A keyed series (roi, v: list) trimmed round by round; ``fits`` gives m, the variance s and the results named in ``names`` from v."""
    return f"""tr(roi,v,least,done,{names}) AS (SELECT roi,v,greatest(1,len(v)//10),false,{','.join('NULL::DOUBLE' for _ in names.split(','))} FROM series
 UNION ALL SELECT roi,CASE WHEN z IS NULL THEN v ELSE list_filter(v,lambda x:(x-m)/s<=z) END,least,z IS NULL OR len(list_filter(v,lambda x:(x-m)/s<=z))<=least,{names}
 FROM (SELECT *,CASE WHEN s<0.001 THEN NULL ELSE list_filter([1.0,0.5,0.25,0.125,0.0625,0.03125,0.015625],lambda z:(list_max(v)-m)/s>z)[1]::DOUBLE END z FROM ({fits})))"""


_MEAN = "SELECT *,m AS mean FROM (SELECT roi,v,least,list_avg(v) m,list_avg(list_transform(v,lambda x:pow(x-list_avg(v),2))) s FROM tr WHERE NOT done)"


@query(f"""WITH RECURSIVE {ROI}, b AS (SELECT t,v::DOUBLE bg FROM roi WHERE roi='click'), j AS (SELECT roi,t,v::DOUBLE v,bg FROM roi JOIN b USING (t) WHERE roi<>'click'),
series AS (SELECT roi,list(CASE WHEN bg>0 THEN v/bg ELSE v END ORDER BY t) v FROM j GROUP BY 1), {_trim_sql(_MEAN, "mean")}
SELECT roi,t,round(CASE WHEN mean*bg>0 THEN (j.v-mean*bg)/(mean*bg) ELSE j.v END,6) AS dff FROM j JOIN tr USING (roi) WHERE done""")
def t02_t03_dff(spark, sf_dir):
    return rounded(timeseries.dff(adapters.roi_series(spark, sf_dir), "click"), "dff")


@query(f"""WITH {RULERS}, k AS (SELECT * FROM rul WHERE t%3=0), p AS (SELECT r.ruler,r.t,max(k.t) a FROM rul r JOIN k ON k.ruler=r.ruler AND k.t<=r.t GROUP BY 1,2), n AS (SELECT r.ruler,r.t,min(k.t) b FROM rul r LEFT JOIN k ON k.ruler=r.ruler AND k.t>=r.t GROUP BY 1,2),
j AS (SELECT p.ruler,p.t,CASE WHEN b>a THEN (p.t-a)/(b-a)::DOUBLE ELSE 0 END f,i.x ix,i.y iy,i.z iz,coalesce(q.x,i.x) qx,coalesce(q.y,i.y) qy,coalesce(q.z,i.z) qz FROM p JOIN n ON n.ruler=p.ruler AND n.t=p.t JOIN k i ON i.ruler=p.ruler AND i.t=a LEFT JOIN k q ON q.ruler=p.ruler AND q.t=b)
SELECT ruler,t,round(ix+f*(qx-ix),6) AS x,round(iy+f*(qy-iy),6) AS y,round(iz+f*(qz-iz),6) AS z FROM j""")
def t09_t10_key_frames(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir)
    return rounded(timeseries.at_frames(p.where("t % 3 = 0"), p.select("ruler", "t")), "x", "y", "z")


# 2.12 functions
@query(f"WITH {RULERS}, s AS (SELECT ruler,sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)+pow((z-lag(z) OVER w)/3.0::DOUBLE,2)) AS d FROM rul WINDOW w AS (PARTITION BY ruler ORDER BY t)) SELECT ruler,count(*) AS n,round(sum(coalesce(d,0)),4) AS length FROM s GROUP BY 1")
def x04_x05_length(spark, sf_dir):
    return rounded(geometry.ruler_lengths(adapters.ruler_points(spark, sf_dir), (1.0, 1.0, 3.0)), "length", digits=4)


@query(f"WITH {RULERS}, a AS (SELECT ruler,t,x,y,z,degrees(atan2(-y::DOUBLE,sqrt(x*x+z*z))) g FROM rul) SELECT ruler,t,round(CASE WHEN x=0 AND y=0 AND z=0 THEN 0 WHEN g<0 THEN g+180 ELSE g END,6) AS angle FROM a")
def x06_angle(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir)
    return p.select("ruler", "t", F.round(geometry.elevation(F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")), 6).alias("angle"))


@query(f"""WITH {VOX}, h AS (SELECT DISTINCT label,(label%253)/45.0::DOUBLE AS hue FROM vox), i AS (SELECT label,CAST(floor(hue) AS INT) i,hue-floor(hue) f FROM h)
SELECT label,round(CASE i WHEN 0 THEN 1 WHEN 1 THEN 1-f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f WHEN 5 THEN 1 ELSE 0 END,6)::DOUBLE AS r,round(CASE i WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1-f ELSE 0 END,6)::DOUBLE AS g,
round(CASE i WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1-f ELSE 0 END,6)::DOUBLE AS b FROM i""")
def x12_colour(spark, sf_dir):
    v = voxels(spark, sf_dir).select("label").distinct()
    r, g, b = geometry.label_colour(F.col("label"))
    return rounded(v.select("label", r.alias("r"), g.alias("g"), b.alias("b")), "r", "g", "b")


@query(f"""WITH {VOX}, p AS (SELECT DISTINCT z,y,x FROM vox) SELECT z,y,x,CAST(1+list_sum(list_transform(range(0,6), lambda k: (((x>>k)&1)<<(2*(5-k)))+(((y>>k)&1)<<(2*(5-k)+1))))+list_sum(list_transform(range(0,3), lambda k: ((z>>k)&1)<<(12+2-k))) AS BIGINT) AS id FROM p""")
def x13_seed_ids(spark, sf_dir):
    p = voxels(spark, sf_dir).select("z", "y", "x").distinct()
    return p.select("z", "y", "x", geometry.interleaved_id(F.col("x"), F.col("y"), F.col("z"), 6, 3).alias("id"))


@query("SELECT s_suppkey AS k,CASE WHEN regexp_matches(s_name,'\\d+\\D+\\d+') THEN CAST(regexp_extract(s_name,'(\\d+)',1) AS BIGINT) END AS brick,CAST(CASE WHEN regexp_matches(s_name,'\\d+\\D+\\d+') THEN regexp_extract(s_name,'\\d+\\D+(\\d+)',1) ELSE nullif(regexp_extract(s_name,'(\\d+)',1),'') END AS BIGINT) AS id FROM supplier")
def x16_parse_id(spark, sf_dir):
    brick, label = geometry.parsed_id(F.col("s_name"))
    return adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), brick.alias("brick"), label.alias("id"))


# 2.13 segmentation
@query(f"WITH {VOX} SELECT t,c,z,y,x,CASE WHEN mask=0 THEN 0 ELSE label END AS label FROM vox")
def g11_clean_outside(spark, sf_dir):
    return segmentation.clean_outside(voxels(spark, sf_dir)).select("t", "c", "z", "y", "x", "label")


@query(f"WITH {VOX}, m AS (SELECT t,c,max(label)+10 f FROM vox GROUP BY 1,2) SELECT t,c,z,y,x,CASE WHEN mask>0 THEN f ELSE label END AS label FROM vox JOIN m USING (t,c)")
def g12_new_id(spark, sf_dir):
    return segmentation.new_id(voxels(spark, sf_dir)).select("t", "c", "z", "y", "x", "label")


@query(f"WITH {VOX} SELECT t,c,z,y,x,CASE WHEN mask>0 AND label<>0 THEN 77 ELSE label END AS label FROM vox")
def g13_replace_id(spark, sf_dir):
    return segmentation.replace_id(voxels(spark, sf_dir), 77).select("t", "c", "z", "y", "x", "label")


@query(f"WITH {VOX}, f AS (SELECT t,c,arg_min(label,z*10000+y*100+x) f FROM vox WHERE mask>0 AND label<>0 GROUP BY 1,2) SELECT t,c,z,y,x,CASE WHEN mask>0 AND label<>0 THEN f ELSE label END AS label FROM vox LEFT JOIN f USING (t,c)")
def g14_combine_ids(spark, sf_dir):
    return segmentation.combine_ids(voxels(spark, sf_dir)).select("t", "c", "z", "y", "x", "label")


def runs_sql(on: str) -> str:
    """Common tables that end in grown(t, c, z, y, x, label): the runs over 26 neighbours of the rows (t, c, z, y, x) of ``on``."""
    return f"""gr AS MATERIALIZED (SELECT t,c,z,y,x,t*16+c AS f,(CAST(z AS BIGINT)<<40)|(CAST(y AS BIGINT)<<20)|CAST(x AS BIGINT) AS k FROM ({on})),
o26 AS (SELECT * FROM range(-1,2) i(dz),range(-1,2) j(dy),range(-1,2) k(dx) WHERE NOT (dz=0 AND dy=0 AND dx=0)),
ed AS MATERIALIZED (SELECT a.f,a.k AS a,b.k AS b FROM gr a CROSS JOIN o26 JOIN gr b ON b.f=a.f AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx),
cc(f,k,root) USING KEY (f,k) AS (SELECT f,k,k FROM gr UNION (SELECT ed.f,ed.b,min(cc.root) FROM cc JOIN ed ON ed.f=cc.f AND ed.a=cc.k JOIN recurring.cc n ON n.f=ed.f AND n.k=ed.b WHERE cc.root<n.root GROUP BY 1,2)),
grown AS (SELECT gr.t,gr.c,gr.z,gr.y,gr.x,cc.root+1 AS label FROM gr JOIN cc USING (f,k))"""


_STOP_G = "sqrt(pow(sum(w*dz)/2,2)+pow(sum(w*dy)/2,2)+pow(sum(w*dx)/2,2))"
_STOP = f"""CASE WHEN {_STOP_G}>sqrt(0.05)*2.12 THEN 0 ELSE exp(-pow({_STOP_G},2)/0.05) END*CASE WHEN {_C}>0.6 THEN 1 WHEN {_C}<0.6-sqrt(0.02)*2.12 THEN 0 ELSE exp(-pow({_C}-0.6,2)/0.02) END"""
_stencil("x02_stop", stencil.stop(0.6, 0.02, 0.05), f"round({_STOP},9)", "abs(dz)+abs(dy)+abs(dx)<=1")


@query(f"""{_stencil_sql(f"round({_STOP},9)", "abs(dz)+abs(dy)+abs(dx)<=1", "r").replace("WITH", "WITH RECURSIVE", 1).replace("SELECT * FROM f WHERE v<>0", "").rstrip()},
{runs_sql("SELECT t,c,z,y,x FROM vox JOIN (SELECT t,c,z,y,x,v AS stop FROM f) USING (t,c,z,y,x) WHERE v>0 AND stop>=1e-4")} SELECT * FROM grown""")
def g01_f14_stop_grow(spark, sf_dir):
    return segmentation.stop_grow(voxels(spark, sf_dir), DIMS, 0.6, 0.02, 0.05)


@query(f"WITH RECURSIVE {VOX}, {runs_sql('SELECT * FROM vox WHERE v>200')} SELECT * FROM grown")
def g01_grow(spark, sf_dir):
    return segmentation.grow(voxels(spark, sf_dir), 200)


@query(f"""WITH {VOX}, r AS (SELECT *, count(*) OVER (PARTITION BY t,c,label) size FROM vox WHERE label<>0 AND v>0), o AS (SELECT *, row_number() OVER (ORDER BY dz,dy,dx) ord FROM range(-1,2) i(dz),range(-1,2) j(dy),range(-1,2) k(dx) WHERE NOT (dz=0 AND dy=0 AND dx=0)),
n AS (SELECT a.t,a.c,a.z,a.y,a.x,arg_min(b.label,(abs(dz)+abs(dy)+abs(dx))*100+ord) nl FROM r a CROSS JOIN o JOIN r b ON b.t=a.t AND b.c=a.c AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx WHERE a.size<60 AND b.size>=60 AND b.v>=a.v GROUP BY 1,2,3,4,5)
SELECT t,c,z,y,x,coalesce(nl,label) AS label FROM r LEFT JOIN n USING (t,c,z,y,x)""")
def g06_clean_noise(spark, sf_dir):
    return segmentation.clean_noise(voxels(spark, sf_dir), 60).select("t", "c", "z", "y", "x", "label")


# 2.14 clustering
def dbscan_sql(eps: float, least: int, weight: float = 0.0) -> str:
    """Common tables over pts that end in found(id, cluster)."""
    return f"""pr AS MATERIALIZED (SELECT a.id a,b.id b FROM pts a JOIN pts b ON sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)+pow(a.z-b.z,2))+{weight}::DOUBLE*abs(a.w-b.w)<{eps}),
co AS MATERIALIZED (SELECT a AS id FROM pr GROUP BY 1 HAVING count(*)>={least}), ce AS MATERIALIZED (SELECT * FROM pr WHERE a IN (FROM co) AND b IN (FROM co)),
cl(id,root) USING KEY (id) AS (SELECT id,id FROM co UNION (SELECT ce.b,min(cl.root) FROM cl JOIN ce ON ce.a=cl.id JOIN recurring.cl n ON n.id=ce.b WHERE cl.root<n.root GROUP BY 1)),
found AS (SELECT pts.id,coalesce(cl.root,(SELECT min(q.root) FROM pr JOIN cl q ON q.id=pr.b WHERE pr.a=pts.id)) AS cluster FROM pts LEFT JOIN cl ON cl.id=pts.id)"""


@query(f"WITH RECURSIVE {POINTS}, {dbscan_sql(120, 6)} SELECT * FROM found")
def m02_dbscan(spark, sf_dir):
    return clustering.dbscan(adapters.points(spark, sf_dir), 120.0, 6)


@query(f"WITH RECURSIVE {POINTS}, {dbscan_sql(150, 6, 0.5)} SELECT * FROM found")
def x23_dbscan_by_intensity(spark, sf_dir):
    return clustering.dbscan(adapters.points(spark, sf_dir), 150.0, 6, 0.5)


@query()
def m05_kmeans(spark, sf_dir):
    return clustering.kmeans(adapters.points(spark, sf_dir), 4)[0]


@query()
def m06_mixture(spark, sf_dir):
    parts = clustering.gaussian_mixture(adapters.points(spark, sf_dir), 2)
    return spark.createDataFrame([(i, float(p["tau"]), *map(float, p["mean"])) for i, p in enumerate(parts)], "part int, tau double, x double, y double, z double")


_TRACKS = f"""{_LINKS.replace('WITH', 'WITH RECURSIVE', 1)}, rk AS (SELECT *,row_number() OVER (PARTITION BY t,c,v1 ORDER BY total DESC,n DESC,v2) k FROM links),
te AS MATERIALIZED (SELECT c||'/'||lpad(t::VARCHAR,6,'0')||'/'||lpad(v1::VARCHAR,12,'0') a,c||'/'||lpad((t+1)::VARCHAR,6,'0')||'/'||lpad(v2::VARCHAR,12,'0') b FROM rk WHERE k=1),
tb AS MATERIALIZED (SELECT a,b FROM te UNION SELECT b,a FROM te), tk(a,root) USING KEY (a) AS (SELECT DISTINCT a,a FROM tb UNION (SELECT tb.b,min(tk.root) FROM tk JOIN tb ON tb.a=tk.a JOIN recurring.tk n ON n.a=tb.b WHERE tk.root<n.root GROUP BY 1)),
trk AS (SELECT CAST(split_part(a,'/',2) AS INT) AS t,CAST(split_part(a,'/',1) AS INT) AS c,CAST(split_part(a,'/',3) AS BIGINT) AS label,root AS track FROM tk)"""


@query(f"{_TRACKS} SELECT * FROM trk")
def r15_tracks(spark, sf_dir):
    return tracking.tracks(tracking.frame_links(voxels(spark, sf_dir)))


_FULL = f"""{_STATS}, l AS (SELECT * FROM vox WHERE label<>0 AND v>0), lk AS (SELECT a.t,a.c,a.label v1,b.label v2,count(*) n,sum(least(a.v,b.v)) total FROM l a JOIN l b ON b.t=a.t+1 AND b.c=a.c AND b.z=a.z AND b.y=a.y AND b.x=a.x GROUP BY 1,2,3,4 HAVING count(*)>=10)"""
_ORPHANS = """fr AS (SELECT * FROM s WHERE NOT EXISTS (FROM lk WHERE lk.t=s.t AND lk.c=s.c AND lk.v1=s.label)), bk AS (SELECT * FROM s WHERE NOT EXISTS (FROM lk WHERE lk.t+1=s.t AND lk.c=s.c AND lk.v2=s.label)),
op AS (SELECT a.t,a.c,a.label v1,b.label v2,round(sqrt(pow(a.cx-b.cx,2)+pow(a.cy-b.cy,2)+pow(a.cz-b.cz,2)),6) dist,a.n an,b.n bn,
 a.lo_x<=b.hi_x+1 AND b.lo_x<=a.hi_x+1 AND a.lo_y<=b.hi_y+1 AND b.lo_y<=a.hi_y+1 AND a.lo_z<=b.hi_z+1 AND b.lo_z<=a.hi_z+1 AS touch FROM fr a JOIN bk b ON b.t=a.t+1 AND b.c=a.c),
orphans AS (SELECT t,c,v1,v2,dist FROM (SELECT *,row_number() OVER (PARTITION BY t,c,v1 ORDER BY dist,v2) k FROM op) WHERE k=1 AND touch AND abs(an-bn)/greatest(an,bn)::DOUBLE<0.5)"""


@query(f"{_FULL}, {_ORPHANS} SELECT * FROM orphans")
def j08_orphan_links(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.orphan_links(components.component_stats(v), tracking.frame_links(v).where("n >= 10"), 0.5)


@query(f"""{_FULL}, {_ORPHANS}, r AS (SELECT *,row_number() OVER (PARTITION BY t,c,v1 ORDER BY total DESC,n DESC,v2) AS rank,max(total) OVER (PARTITION BY t,c,v1) m FROM lk),
f AS (SELECT *,min(CASE WHEN NOT (m-total<0.5::DOUBLE*m) THEN rank END) OVER (PARTITION BY t,c,v1) g FROM r) SELECT t,c,v1,v2,'size' AS rule FROM f WHERE g IS NULL OR rank<g UNION ALL SELECT t,c,v1,v2,'orphan' FROM orphans""")
def r07_vertex_links(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.vertex_links(components.component_stats(v), tracking.frame_links(v).where("n >= 10"), 0.5)


# 2.17 records
@query(f"WITH {RECORDS}, b AS (SELECT * FROM rec UNION ALL SELECT rec_id+1000000,hist,param+1 FROM rec WHERE rec_id%5=0) SELECT array_to_string(hist,',') AS hist,max(rec_id) AS rec_id,arg_max(param,rec_id) AS param FROM b GROUP BY ALL")
def d01_upsert(spark, sf_dir):
    r = adapters.records(spark, sf_dir)
    new = r.where("rec_id % 5 = 0").select((F.col("rec_id") + 1000000).alias("rec_id"), "hist", (F.col("param") + 1).alias("param"))
    return records.upserted(r, new).select(F.array_join("hist", ",").alias("hist"), "rec_id", "param")


@query(f"WITH {RECORDS} SELECT rec_id,param FROM rec WHERE rec_id%7<>0")
def d03_delete(spark, sf_dir):
    r = adapters.records(spark, sf_dir)
    return records.deleted(r, r.where("rec_id % 7 = 0")).select("rec_id", "param")


# 2.2 exports, 2.18 windows
@query(f"""{_STATS} SELECT t,c,label,concat_ws(chr(9),label,n,total,least,most,lo_x,hi_x,lo_y,hi_y,lo_z,hi_z) AS line FROM s""")
def k06_component_lines(spark, sf_dir):
    return export.component_lines(components.component_stats(voxels(spark, sf_dir)))


@query(f"""WITH {ROI}, b AS (SELECT t,v AS bg FROM roi WHERE roi='click'), o AS (SELECT roi AS obj,t,v FROM roi WHERE roi<>'click' AND t%2=0), g AS (SELECT obj,b.t,bg FROM (SELECT DISTINCT obj FROM o),b)
SELECT obj,g.t,coalesce(o.v,bg,0) AS value FROM g LEFT JOIN o USING (obj,t)""")
def k12_report_values(spark, sf_dir):
    s = adapters.roi_series(spark, sf_dir)
    local = s.where("roi <> 'click' and t % 2 = 0").select(F.col("roi").alias("obj"), "t", "v")
    return export.report_values(local, s.where("roi = 'click'").select("t", F.col("v").alias("bg")))


@query(f"WITH {ROI} SELECT roi,string_agg(v,', ' ORDER BY t) AS line FROM roi GROUP BY 1")
def k13_series_lines(spark, sf_dir):
    return export.series_lines(adapters.roi_series(spark, sf_dir))


@query("SELECT date_trunc('day',ts)::TIMESTAMP AS start,event_type,count(*) AS n,CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1,2")
def z_windows(spark, sf_dir):
    return frames.windowed(adapters.table(spark, sf_dir, "events"))


# 2.8 and 2.13 deconvolution, thinning, density and distance
_stencil("w17_richardson_lucy", stencil.richardson_lucy(stencil.kernel(lambda dz, dy, dx: (2 - abs(dz)) * (2 - abs(dy)) * (2 - abs(dx)) / 64), 0.01), f"round({_C}*{_C}/(sum(w*(2-abs(dz))*(2-abs(dy))*(2-abs(dx)))/64+0.01),9)")
_stencil("w22_density", lambda a, r: 0.8 * np.round(stencil.kernel(lambda dz, dy, dx: 1.0, True, True)(a, r), 12), "round(0.8*avg(w),9)", "dz=0")


def _ring(p: tuple, q: tuple) -> str:
    """SQL of one ring's test: 3 to 7 of eight neighbours, in one run."""
    at = [tuple(i * u + j * w for u, w in zip(p, q, strict=True)) for i, j in [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]]
    on = [f"max(CASE WHEN dz={z} AND dy={y} AND dx={x} AND w>=0.5 THEN 1 ELSE 0 END)" for z, y, x in at]
    starts = "+".join(f"(1-{on[k - 1]})*{on[k]}" for k in range(8))
    return f"({'+'.join(on)} BETWEEN 3 AND 7 AND {starts}=1)"


_stencil("w20_thin", stencil.thin(0.5), f"CASE WHEN {_C}<0.5 OR ({' AND '.join(_ring(p, q) for p, q in stencil.RINGS)}) THEN 0 ELSE {_C} END")


@query(f"""WITH {VOX}, w AS (SELECT * FROM vox WHERE v>0), t0 AS (SELECT t,c,CAST(floor(z/4) AS INT) bz,CAST(floor(y/8) AS INT) by_,CAST(floor(x/8) AS INT) bx,sum(v)/256.0::DOUBLE m,sum(v*v)/256.0::DOUBLE q FROM w GROUP BY 1,2,3,4,5),
tl AS (SELECT t,c,bz,by_,bx,floor(m) AS mean,floor(least(sqrt(greatest(q-m*m,0)),255)) AS sigma FROM t0),
p AS (SELECT *, CAST(floor(z/4.0-0.5) AS INT) gz,CAST(floor(y/8.0-0.5) AS INT) gy,CAST(floor(x/8.0-0.5) AS INT) gx FROM w),
k AS (SELECT p.*,(CASE WHEN i=1 THEN z/4.0-0.5-gz ELSE 1-(z/4.0-0.5-gz) END)*(CASE WHEN j=1 THEN y/8.0-0.5-gy ELSE 1-(y/8.0-0.5-gy) END)*(CASE WHEN h=1 THEN x/8.0-0.5-gx ELSE 1-(x/8.0-0.5-gx) END) AS f,
 least(greatest(gz+i,0),1) bz,least(greatest(gy+j,0),3) by_,least(greatest(gx+h,0),6) bx FROM p,range(0,2) a(i),range(0,2) b(j),range(0,2) d(h))
SELECT k.t,k.c,k.z,k.y,k.x,CAST(floor(sum(f::DOUBLE*coalesce(mean,0))+1e-6) AS INT) AS mean,CAST(floor(sum(f::DOUBLE*coalesce(sigma,0))+1e-6) AS INT) AS sigma
FROM k LEFT JOIN tl ON tl.t=k.t AND tl.c=k.c AND tl.bz=k.bz AND tl.by_=k.by_ AND tl.bx=k.bx GROUP BY 1,2,3,4,5""")
def w24_tile_interpolation(spark, sf_dir):
    v = voxels(spark, sf_dir).where("v > 0").select("t", "c", "z", "y", "x", "v")
    return density.interpolated(v, density.tile_field(v, DIMS, (4, 8, 8)), DIMS, (4, 8, 8)).drop("v")


@query(f"""WITH {VOX}, i AS (SELECT t,c,z,y,x FROM vox WHERE v>100 AND z BETWEEN 1 AND 5 AND y BETWEEN 1 AND 30 AND x BETWEEN 1 AND 48),
o AS (SELECT *,abs(dz)+abs(dy)+abs(dx) l FROM range(-3,4) a(dz),range(-3,4) b(dy),range(-3,4) d(dx) WHERE abs(dz)+abs(dy)+abs(dx) BETWEEN 1 AND 3)
SELECT i.t,i.c,i.z,i.y,i.x,CAST(min(l) AS INT) AS dist FROM i CROSS JOIN o LEFT JOIN i n ON n.t=i.t AND n.c=i.c AND n.z=i.z+dz AND n.y=i.y+dy AND n.x=i.x+dx WHERE n.t IS NULL GROUP BY 1,2,3,4,5""")
def w26_distance(spark, sf_dir):
    return density.distance(voxels(spark, sf_dir).where("v > 100"), DIMS)


def _gate_sql(source: str) -> str:
    """Common tables that end in gate(t, c, z, y, x): where ``source``'s density reaches its tiles' mean and their sigma 0.01 of full scale."""
    return f"""ds AS (SELECT DISTINCT t,c FROM {source} WHERE v>0), dg AS (SELECT t,c,CAST(z AS INT) z,CAST(y AS INT) y,CAST(x AS INT) x FROM ds,range(0,7) a(z),range(0,32) b(y),range(0,50) d(x)),
dq AS (SELECT g.t,g.c,g.z,g.y,g.x,round(avg(coalesce(v.v,0)/255.0::DOUBLE),9) AS r FROM dg g CROSS JOIN range(-1,2) j(dy) CROSS JOIN range(-1,2) k(dx)
  LEFT JOIN {source} v ON v.t=g.t AND v.c=g.c AND v.z=g.z AND v.y=least(greatest(g.y+dy,0),31) AND v.x=least(greatest(g.x+dx,0),49) GROUP BY 1,2,3,4,5),
df AS MATERIALIZED (SELECT * FROM (SELECT t,c,z,y,x,CAST(floor(r*255+1e-6) AS INT) AS v FROM dq) WHERE v<>0),
dt AS (SELECT t,c,CAST(floor(z/4) AS INT) bz,CAST(floor(y/8) AS INT) by_,CAST(floor(x/8) AS INT) bx,sum(v)/256.0::DOUBLE m,sum(v*v)/256.0::DOUBLE q FROM df GROUP BY 1,2,3,4,5),
dl AS (SELECT t,c,bz,by_,bx,floor(m) AS mean,floor(least(sqrt(greatest(q-m*m,0)),255)) AS sigma FROM dt),
dp AS (SELECT *,z/4.0-0.5 uz,y/8.0-0.5 uy,x/8.0-0.5 ux FROM df),
dk AS (SELECT t,c,z,y,x,v,(CASE WHEN i=1 THEN uz-floor(uz) ELSE 1-uz+floor(uz) END)*(CASE WHEN j=1 THEN uy-floor(uy) ELSE 1-uy+floor(uy) END)*(CASE WHEN h=1 THEN ux-floor(ux) ELSE 1-ux+floor(ux) END) AS f,
  least(greatest(floor(uz)+i,0),1) bz,least(greatest(floor(uy)+j,0),3) by_,least(greatest(floor(ux)+h,0),6) bx FROM dp,range(0,2) a(i),range(0,2) b(j),range(0,2) d(h)),
gate AS (SELECT k.t,k.c,k.z,k.y,k.x FROM dk k LEFT JOIN dl ON dl.t=k.t AND dl.c=k.c AND dl.bz=k.bz AND dl.by_=k.by_ AND dl.bx=k.bx GROUP BY 1,2,3,4,5,k.v
  HAVING floor(sum(f::DOUBLE*coalesce(sigma,0))+1e-6)>=2.55 AND k.v>=floor(sum(f::DOUBLE*coalesce(mean,0))+1e-6))"""


@query(f"WITH RECURSIVE {VOX}, {_gate_sql('vox')}, {runs_sql('SELECT t,c,z,y,x FROM vox JOIN gate USING (t,c,z,y,x) WHERE v>200')} SELECT * FROM grown")
def g03_density_grow(spark, sf_dir):
    return density.density_grow(voxels(spark, sf_dir), DIMS, 200)


_DIST = """i AS (SELECT t,c,z,y,x FROM vox WHERE v>100 AND z BETWEEN 1 AND 5 AND y BETWEEN 1 AND 30 AND x BETWEEN 1 AND 48),
o AS (SELECT *,abs(dz)+abs(dy)+abs(dx) l FROM range(-3,4) a(dz),range(-3,4) b(dy),range(-3,4) d(dx) WHERE abs(dz)+abs(dy)+abs(dx) BETWEEN 1 AND 3),
di AS (SELECT i.t,i.c,i.z,i.y,i.x,CAST(min(l) AS INT) AS dist FROM i CROSS JOIN o LEFT JOIN i n ON n.t=i.t AND n.c=i.c AND n.z=i.z+dz AND n.y=i.y+dy AND n.x=i.x+dx WHERE n.t IS NULL GROUP BY 1,2,3,4,5),
dw AS MATERIALIZED (SELECT t,c,z,y,x,CAST(floor(v*0.5::DOUBLE+least(coalesce(dist,0)*5.0::DOUBLE/6,1)*255*0.5+1e-6) AS INT) AS v FROM vox LEFT JOIN di USING (t,c,z,y,x))"""


@query(f"WITH RECURSIVE {VOX}, {_DIST}, {runs_sql('SELECT * FROM dw WHERE v>100')} SELECT * FROM grown")
def g04_distance_grow(spark, sf_dir):
    return density.distance_grow(voxels(spark, sf_dir), DIMS, 100, most=6)


@query(f"WITH RECURSIVE {VOX}, {_DIST}, {_gate_sql('dw')}, {runs_sql('SELECT t,c,z,y,x FROM dw JOIN gate USING (t,c,z,y,x) WHERE v>100')} SELECT * FROM grown")
def g05_distance_density_grow(spark, sf_dir):
    return density.distance_density_grow(voxels(spark, sf_dir), DIMS, 100, most=6)


# 2.15 track edits
_EDIT = f"{_LINKS}, pairs AS (SELECT DISTINCT t,c,v1,v2+1 AS v2 FROM links WHERE v1%5=0), cells AS (SELECT t,c,label FROM m WHERE label%7=0)"


def _links(spark, sf_dir):
    return tracking.frame_links(voxels(spark, sf_dir))


def _cells(spark, sf_dir):
    return voxels(spark, sf_dir).where("label <> 0 and v > 0 and label % 7 = 0").select("t", "c", "label").distinct()


def _pairs(links):
    return links.where("v1 % 5 = 0").select("t", "c", "v1", (F.col("v2") + 1).alias("v2"))


@query(f"{_EDIT} SELECT coalesce(l.t,p.t) AS t,coalesce(l.c,p.c) AS c,coalesce(l.v1,p.v1) AS v1,coalesce(l.v2,p.v2) AS v2,coalesce(n,1) AS n,coalesce(total,1) AS total,p.t IS NOT NULL AS forced FROM links l FULL JOIN pairs p ON l.t=p.t AND l.c=p.c AND l.v1=p.v1 AND l.v2=p.v2")
def r17_link(spark, sf_dir):
    links = _links(spark, sf_dir)
    return tracking.linked(links, _pairs(links))


@query(f"""{_EDIT}, kept AS (SELECT * FROM links l WHERE NOT EXISTS (FROM pairs p WHERE p.t=l.t AND p.c=l.c AND p.v1=l.v1) AND NOT EXISTS (FROM pairs p WHERE p.t=l.t AND p.c=l.c AND p.v2=l.v2))
SELECT t,c,v1,v2,n,total,false AS forced FROM kept UNION ALL SELECT t,c,v1,v2,1,1,true FROM pairs""")
def r17_link_exclusive(spark, sf_dir):
    links = _links(spark, sf_dir)
    return tracking.linked(links, _pairs(links), exclusive=True)


@query(f"{_EDIT} SELECT l.* FROM links l ANTI JOIN pairs p ON p.t=l.t AND p.c=l.c AND p.v1=l.v1 AND p.v2=l.v2")
def r17_unlink(spark, sf_dir):
    links = _links(spark, sf_dir)
    return tracking.unlinked(links, _pairs(links))


@query(f"{_EDIT} SELECT l.* FROM links l WHERE NOT EXISTS (FROM cells d WHERE d.t=l.t AND d.c=l.c AND d.label=l.v1) AND NOT EXISTS (FROM cells d WHERE d.t=l.t+1 AND d.c=l.c AND d.label=l.v2)")
def r17_isolate(spark, sf_dir):
    return tracking.isolated(_links(spark, sf_dir), _cells(spark, sf_dir))


@query(f"{_LINKS} SELECT t,c,CASE WHEN v1%7=0 THEN v1-1 ELSE v1 END AS v1,CASE WHEN v2%7=0 THEN v2-1 ELSE v2 END AS v2,CAST(sum(n) AS BIGINT) AS n,CAST(sum(total) AS BIGINT) AS total FROM links GROUP BY ALL")
def r18_combine_cells(spark, sf_dir):
    return tracking.combined_cells(_links(spark, sf_dir), _cells(spark, sf_dir).withColumn("into", F.col("label") - 1))


# 2.12 and 2.16 sampling and registration
def _resize_sql(how: str, border: int, out: tuple[int, int, int] = (5, 40, 33)) -> str:
    along = {"trilinear": ["linear"] * 3, "bilinear": ["floor", "linear", "linear"]}.get(how, [how] * 3)
    tables = []
    for k, name, n in zip(along, "zyx", DIMS, strict=True):
        m = out["zyx".index(name)]
        u = f"((i+0.5::DOUBLE)/{m}*{n})"
        low = f"CAST(floor({u}-0.5) AS INT)"
        near = {
            "nearest": f"SELECT i,CAST(floor({u}) AS INT) j,1.0::DOUBLE f FROM range(0,{m}) r(i)",
            "floor": f"SELECT i,{low} j,1.0::DOUBLE f FROM range(0,{m}) r(i)",
            "linear": f"SELECT i,{low} j,1-({u}-0.5-{low}) f FROM range(0,{m}) r(i) UNION ALL SELECT i,{low}+1,{u}-0.5-{low} FROM range(0,{m}) r(i)",
            "box": f"SELECT i,CAST(floor({u}) AS INT)+s j,1/3.0::DOUBLE f FROM range(0,{m}) r(i),range(-1,2) q(s)",
        }[k]
        at = {0: "j", 1: f"least(greatest(j,0),{n - 1})", 2: f"CASE WHEN j<0 THEN -1-j WHEN j>={n} THEN 2*{n}-j-1 ELSE j END"}[border]
        tables.append(f"t{name} AS (SELECT i,{at} AS j,f FROM ({near}))")
    return f"""WITH {VOX}, {','.join(tables)} SELECT t,c,CAST(tz.i AS INT) AS z,CAST(ty.i AS INT) AS y,CAST(tx.i AS INT) AS x,round(sum(v*tz.f*ty.f*tx.f),6) AS v
FROM vox JOIN tz ON tz.j=z JOIN ty ON ty.j=y JOIN tx ON tx.j=x WHERE v>0 AND tz.f*ty.f*tx.f<>0 GROUP BY 1,2,3,4,5"""


def _resized(how: str, border: int) -> None:
    def run(spark, sf_dir):
        return rounded(resample.resize(voxels(spark, sf_dir), DIMS, (5, 40, 33), how, border), "v")

    run.__name__ = f"v01_v03_{how}_border{border}"
    query(_resize_sql(how, border))(run)


for _how, _border in (("nearest", 0), ("bilinear", 1), ("trilinear", 0), ("trilinear", 2), ("box", 1)):
    _resized(_how, _border)


@query(f"""WITH {VOX}, p AS (SELECT i.z,j.y,k.x,CAST(floor((i.z+0.5)/5.0*7) AS INT) a,CAST(floor((j.y+0.5)/40.0*32) AS INT) b,CAST(floor((k.x+0.5)/33.0*50) AS INT) d FROM range(0,5) i(z),range(0,40) j(y),range(0,33) k(x))
SELECT t,c,CAST(p.z AS INT) AS z,CAST(p.y AS INT) AS y,CAST(p.x AS INT) AS x,label FROM vox JOIN p ON vox.z=p.a AND vox.y=p.b AND vox.x=p.d WHERE label<>0""")
def v03_labels(spark, sf_dir):
    return resample.resize_labels(voxels(spark, sf_dir), DIMS, (5, 40, 33))


@query(f"""WITH {VOX}, s AS (SELECT DISTINCT t,c FROM vox), g AS (SELECT t,c,CAST(z AS INT) z,CAST(y AS INT) y,CAST(x AS INT) x FROM s,range(0,7) i(z),range(0,32) j(y),range(0,50) k(x))
SELECT g.t,g.c,g.z,g.y,g.x,v.v FROM g JOIN vox v ON v.t=g.t AND v.c=g.c AND v.z=g.z AND v.y=floor((g.x+0.5-25)+16+1+1e-9) AND v.x=floor(-(g.y+0.5-16)+25+1e-9) WHERE v.v>0""")
def v03_turned(spark, sf_dir):
    return resample.turned(voxels(spark, sf_dir), DIMS, [[1, 0, 0], [0, 0, 1], [0, -1, 0]], (0, 1, 0))


_SHIFTS = "o AS (SELECT CAST(dz AS INT) dz,CAST(dy AS INT) dy,CAST(dx AS INT) dx FROM range(-1,2) a(dz),range(-1,2) b(dy),range(-1,2) d(dx))"


@query(f"""WITH {VOX}, {_SHIFTS}, w AS (SELECT t,c,z,y,x,v/255.0::DOUBLE v FROM vox WHERE v>0), f AS (SELECT DISTINCT t,c FROM w),
k AS (SELECT a.t,a.c,dz,dy,dx,sum(least(a.v,b.v)*(1-pow(a.v-b.v,2))) q FROM w a CROSS JOIN o JOIN w b ON b.t=a.t+1 AND b.c=a.c AND b.z=a.z+dz AND b.y=a.y+dy AND b.x=a.x+dx GROUP BY 1,2,3,4,5)
SELECT f.t,f.c,o.dz,o.dy,o.dx,round(coalesce(q,0)/((7-abs(o.dz))*(32-abs(o.dy))*(50-abs(o.dx))),9) AS score FROM f CROSS JOIN o LEFT JOIN k ON k.t=f.t AND k.c=f.c AND k.dz=o.dz AND k.dy=o.dy AND k.dx=o.dx""")
def v06_similarity(spark, sf_dir):
    v = voxels(spark, sf_dir)
    each = v.where("v > 0").select("t", "c").distinct()
    for k in "zyx":
        each = each.withColumn(f"d{k}", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    return rounded(resample.similarity(v, DIMS, each, 1), "score", digits=9)


@query()
def v04_v05_register(spark, sf_dir):
    return rounded(resample.register(voxels(spark, sf_dir), DIMS), "score", digits=9)


@query(f"""WITH {VOX}, {RULERS}, r AS (SELECT ruler,t,(x%50)::DOUBLE x,(y%32)::DOUBLE y,(z%7)::DOUBLE z FROM rul), s AS (SELECT *,lead(x) OVER w nx,lead(y) OVER w ny,lead(z) OVER w nz FROM r WINDOW w AS (PARTITION BY ruler ORDER BY t)),
l AS (SELECT *,sqrt(pow(nx-x,2)+pow(ny-y,2)+pow(nz-z,2)) len FROM s WHERE nx IS NOT NULL), b AS (SELECT *,coalesce(sum(len) OVER (PARTITION BY ruler ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) bef FROM l),
e AS (SELECT *,unnest(range(CAST(ceil(bef/2.0-1e-9) AS BIGINT),CAST(ceil((bef+len)/2.0-1e-9) AS BIGINT))) AS bin FROM b), h AS (SELECT *,(bin*2.0::DOUBLE-bef)/len f FROM e),
p AS (SELECT ruler,bin,CAST(floor(z+f*(nz-z)+1e-9) AS INT) z,CAST(floor(y+f*(ny-y)+1e-9) AS INT) y,CAST(floor(x+f*(nx-x)+1e-9) AS INT) x FROM h), k AS (SELECT DISTINCT t,c FROM vox)
SELECT ruler,CAST(k.c*100+k.t AS INT) AS frame,bin,count(*) AS n,round(avg(coalesce(v.v,0)),6) AS mean FROM p CROSS JOIN k LEFT JOIN vox v ON v.t=k.t AND v.c=k.c AND v.z=p.z AND v.y=p.y AND v.x=p.x GROUP BY 1,2,3""")
def x08_profile(spark, sf_dir):
    p = adapters.ruler_points(spark, sf_dir).select("ruler", "t", *[(F.col(k) % n).alias(k) for k, n in zip("zyx", DIMS, strict=True)])
    frames_as_channels = voxels(spark, sf_dir).withColumn("c", F.col("c") * 100 + F.col("t"))
    return rounded(resample.profile(p, frames_as_channels, 2.0), "mean").withColumnRenamed("c", "frame")
