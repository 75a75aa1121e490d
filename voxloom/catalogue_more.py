"""Registered queries of edits, matrices, boxes, parameters, key frames, bins and meshes, beside those of the other catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _CONTACTS, _LINKS, _OFF6, _PAIRS, _STATS, dbscan_sql, query, rounded, runs_sql
from .catalogue_objects import _AT, _MESH, _ROOTS, SIZE, _linked, _listed, _mesh
from .functions import geometry
from .operators import algebra, clustering, components, mesh, records, segmentation, selection, stats, stencil, timeseries, tracking
from .plans import adapters
from .plans.adapters import DIMS, RULERS, VOX, WIDE, WIDE_DIMS, voxels, wide_voxels

# 2.3 algebra and masks
_VISIBLE = [(0, 1, True), (1, 1, False), (2, 1, True)]


@query(f"WITH {VOX} SELECT t,c,z,y,x,CASE WHEN c IN (0,2) THEN CAST(floor(v*(1-mask/255.0)+0.5) AS INT) ELSE v END AS v FROM vox")
def p12_group_delete(spark, sf_dir):
    shown = spark.createDataFrame(_VISIBLE, "c int, grp int, visible boolean")
    return algebra.group_extract(voxels(spark, sf_dir), shown, 1, inverse=True).select(*_AT, "v")


@query("SELECT l_orderkey AS k,l_linenumber AS n,CAST(floor(greatest(0.0,least(1.0,(l_extendedprice-2000.0)/50000.0))*65535) AS INT) AS v FROM lineitem")
def p13_from_float(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("v"))
    return algebra.from_float(li, 2000.0, 52000.0, 16).select("k", "n", "v")


@query(f"""WITH {VOX}, j AS (SELECT t,z,y,x,coalesce(a.mask,0) a,coalesce(CAST(floor(b.v*257*0.00390625) AS INT),0) b FROM (SELECT * FROM vox WHERE c=0) a FULL JOIN (SELECT * FROM vox WHERE c=1) b USING (t,z,y,x))
SELECT t,z,y,x,greatest(a,b) AS mask FROM j""")
def u02_union_16_bit(spark, sf_dir):
    v = voxels(spark, sf_dir)
    wide = v.where("c = 1").withColumn("mask", F.col("v") * 257)
    return algebra.mask_union(v.where("c = 0"), algebra.scaled_mask(wide, 0.00390625), "union")


@query(f"""WITH {VOX}, j AS (SELECT t,z,y,x,coalesce(a.v/255.0::DOUBLE*a.mask/255.0,0) a,coalesce(b.v/255.0::DOUBLE,0) b FROM (SELECT * FROM vox WHERE c=0) a FULL JOIN (SELECT * FROM vox WHERE c=1) b USING (t,z,y,x))
SELECT t,z,y,x,round(least(a,b),6) AS v FROM j""")
def p05_without_mask(spark, sf_dir):
    v = voxels(spark, sf_dir)
    got = algebra.combine(v.where("c = 0"), v.where("c = 1").drop("mask"))
    return got.select("t", "z", "y", "x", F.round("intersect_masked", 6).alias("v"))


# 2.4 selection
@query(f"WITH {VOX}, s AS (SELECT t,c,label FROM vox WHERE label<>0 AND v>0 GROUP BY 1,2,3 HAVING count(*)>50 AND count(*)<150), h AS (SELECT DISTINCT t,c,label FROM vox WHERE mask>0 AND label<>0) SELECT t,c,z,y,x,CASE WHEN label IN (SELECT s.label FROM s JOIN h USING (t,c,label) WHERE s.t=vox.t AND s.c=vox.c) THEN 255 ELSE 0 END AS mask FROM vox")
def f05_touched_sized(spark, sf_dir):
    return components.touched(voxels(spark, sf_dir), 50, 150).select(*_AT, "mask")


@query(f"WITH {VOX} SELECT t,c,z,y,x,0 AS mask FROM vox")
def f09_erase_empty_list(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return selection.erase_cells(v, _listed(v).limit(0)).select(*_AT, "mask")


@query(f"""{_ROOTS}, {RULERS}, p AS (SELECT ruler,t AS n,t%7 AS t,CAST(ruler%3 AS INT) c,CAST(z%7 AS INT) z,CAST(y%32 AS INT) y,CAST(x%50 AS INT) x FROM rul),
f AS (SELECT p.ruler,p.n,p.t,p.c,r.brick,r.label FROM p JOIN r ON r.t=p.t AND r.c=p.c AND r.z=p.z AND r.y=p.y AND r.x=p.x WHERE r.label<>0),
k AS (SELECT f.*,coalesce(root.m,(CAST(brick AS BIGINT)<<32)|label) AS m FROM f LEFT JOIN root ON root.t=f.t AND root.c=f.c AND root.k=(CAST(brick AS BIGINT)<<32)|label)
SELECT k.ruler,k.n,CAST(coalesce(q.k>>32,k.brick) AS INT) AS brick,coalesce(q.k&4294967295,k.label) AS label FROM k LEFT JOIN root q ON q.t=k.t AND q.c=k.c AND q.m=k.m""")
def f10_linked_parts_at(spark, sf_dir):
    v = voxels(spark, sf_dir)
    p = adapters.ruler_points(spark, sf_dir)
    p = p.select("ruler", F.col("t").alias("n"), (F.col("t") % 7).alias("t"), (F.col("ruler") % 3).cast("int").alias("c"), *[(F.col(k) % n).cast("double").alias(k) for k, n in zip("zyx", DIMS, strict=True)])
    return selection.linked_at(v, p, _linked(v), DIMS, SIZE).select("ruler", "n", "brick", "label")


@query(f"WITH {VOX}, h AS (SELECT max(CASE WHEN c_nationkey=0 THEN 180 END) AS auto FROM customer) SELECT t,c,z,y,x,v FROM vox,h WHERE v>=coalesce(auto,128)")
def g15_auto_threshold(spark, sf_dir):
    volume = adapters.table(spark, sf_dir, "customer").agg(F.max(F.when(F.col("c_nationkey") == 0, 180)).alias("auto"))
    return voxels(spark, sf_dir).where(F.col("v") >= selection.auto_threshold(volume, 128)).select(*_AT, "v")


# 2.6 results and matrices
@query(f"WITH {VOX} SELECT t,c,count(*) AS n,CAST(sum(v) AS DOUBLE) AS total_f,CAST(sum(v) AS BIGINT) AS total,avg(v) AS mean_f,CAST(floor(avg(v)+0.5) AS BIGINT) AS mean_i FROM vox WHERE v>0 GROUP BY 1,2")
def a06_results(spark, sf_dir):
    return stats.results(voxels(spark, sf_dir), ["t", "c"])


@query(f"{_PAIRS} SELECT t,c1,c2,round(n*1.5::DOUBLE,6) AS volume FROM p")
def a20_physical(spark, sf_dir):
    return rounded(stats.physical_matrix(stats.colocalization(voxels(spark, sf_dir)), "n", (0.5, 1.0, 3.0)), "volume")


# 2.12 geometry
@query(f"""WITH {RULERS}, s AS (SELECT ruler,t,x-lag(x) OVER w ux,y-lag(y) OVER w uy,z-lag(z) OVER w uz,x-lead(x) OVER w vx,y-lead(y) OVER w vy,z-lead(z) OVER w vz FROM rul WINDOW w AS (PARTITION BY ruler ORDER BY t)),
l AS (SELECT *,sqrt(ux*ux+uy*uy+uz*uz) lu,sqrt(vx*vx+vy*vy+vz*vz) lv FROM s WHERE ux IS NOT NULL AND vx IS NOT NULL)
SELECT ruler,t,round(CASE WHEN lu>1e-10 AND lv>1e-10 THEN degrees(acos(greatest(-1.0::DOUBLE,least(1.0::DOUBLE,(ux*vx+uy*vy+uz*vz)/(lu*lv))))) ELSE 0 END,4) AS angle FROM l""")
def x06_protractor(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("ruler").orderBy("t")
    rows = adapters.ruler_points(spark, sf_dir).select("ruler", "t", *[f(k).over(w).alias(f"{n}{k}") for k in "xyz" for f, n in ((F.lag, "a"), (F.lead, "b"))], "x", "y", "z").where("ax is not null and bx is not null")
    at = lambda n: tuple(F.col(f"{n}{k}").cast("double") for k in "xyz")
    return rows.select("ruler", "t", F.round(geometry.protractor(at("a"), at(""), at("b")), 4).alias("angle"))


@query(f"""WITH {RULERS}, e AS (SELECT a.ruler,a.x::DOUBLE ax,a.y::DOUBLE ay,a.z::DOUBLE az,b.x::DOUBLE bx,b.y::DOUBLE b_y,b.z::DOUBLE bz FROM rul a JOIN rul b ON a.ruler=b.ruler AND a.t=0 AND b.t=1),
h AS (SELECT ruler,(ax+bx)/2 mx,(ay+b_y)/2 my,(az+bz)/2 mz,sqrt(pow(ax-bx,2)+pow(ay-b_y,2)+pow(az-bz,2))/2 AS far FROM e) SELECT ruler,round(mx,6) AS mx,round(my,6) AS my,round(mz,6) AS mz,round(far,6) AS far,round(far,6) AS far2,0.0::DOUBLE AS along_axis,0.0::DOUBLE AS along_view FROM h""")
def x07_ellipse(spark, sf_dir):
    # What the two added vertices must fulfil: as far from the centre as the given ones, at right angles to the axis and to the view.
    view = (0.2, 0.3, -0.9)
    p = adapters.ruler_points(spark, sf_dir).where("t < 2")
    ends = p.groupBy("ruler").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("t") == i, F.col(k))).cast("double").alias(f"{n}{k}") for i, n in enumerate("ab") for k in "xyz"]).where("n = 2")
    a, b = (tuple(F.col(f"{n}{k}") for k in "xyz") for n in "ab")
    p2, p3 = geometry.ellipse_ends(a, b, view)
    rows = ends.select("*", *[q.alias(f"p{k}") for q, k in zip(p2, "xyz", strict=True)], *[q.alias(f"q{k}") for q, k in zip(p3, "xyz", strict=True)])
    total = lambda parts: sum(parts, F.lit(0.0))
    mid = {k: (F.col(f"p{k}") + F.col(f"q{k}")) / 2 for k in "xyz"}
    far = lambda n: F.sqrt(total(F.pow(F.col(f"{n}{k}") - (F.col(f"a{k}") + F.col(f"b{k}")) / 2, 2) for k in "xyz"))
    axis = total((F.col(f"p{k}") - F.col(f"q{k}")) * (F.col(f"a{k}") - F.col(f"b{k}")) for k in "xyz")
    seen = total((F.col(f"p{k}") - F.col(f"q{k}")) * v for k, v in zip("xyz", view, strict=True))
    out = rows.select("ruler", *[mid[k].alias(f"m{k}") for k in "xyz"], far("p").alias("far"), far("q").alias("far2"), F.abs(axis).alias("along_axis"), F.abs(seen).alias("along_view"))
    return rounded(out, "mx", "my", "mz", "far", "far2", "along_axis", "along_view")


_BOX = [f"{n}_{k}" for k in "xyz" for n in ("lo", "hi")]


@query(f"""{_STATS}, p AS (SELECT a.t,a.c,a.label a,b.label b,{','.join(f"greatest(a.lo_{k},b.lo_{k}) AS lo_{k},least(a.hi_{k},b.hi_{k}) AS hi_{k}" for k in "xyz")},
 {','.join(f"greatest(a.hi_{k},b.hi_{k})-least(a.lo_{k},b.lo_{k}) AS w{k}" for k in "xyz")} FROM s a JOIN s b ON b.t=a.t+1 AND b.c=a.c AND b.label<=a.label+1 AND b.label>=a.label)
SELECT t,c,a,b,{','.join(_BOX)},round(wx*1.5::DOUBLE*wy*1.5*wz*1.5,6) AS grown FROM p WHERE lo_x<=hi_x AND lo_y<=hi_y AND lo_z<=hi_z""")
def x11_boxes(spark, sf_dir):
    s = components.component_stats(voxels(spark, sf_dir))
    a = s.select("t", "c", F.col("label").alias("a"), *[F.col(k).alias(f"a_{k}") for k in _BOX])
    b = s.select((F.col("t") - 1).alias("t"), "c", F.col("label").alias("b"), F.explode(F.array("label", F.col("label") - 1)).alias("a"), *[F.col(k).alias(f"b_{k}") for k in _BOX])
    left, right = geometry.box("a_"), geometry.box("b_")
    whole = geometry.grown_box(geometry.joined_box(left, right), 0.25)
    size = (whole["hi_x"] - whole["lo_x"]) * (whole["hi_y"] - whole["lo_y"]) * (whole["hi_z"] - whole["lo_z"])
    both = a.join(b, ["t", "c", "a"]).where(geometry.boxes_meet(left, right))
    return both.select("t", "c", "a", "b", *[q.alias(k) for k, q in geometry.common_box(left, right).items()], F.round(size, 6).alias("grown"))


# 2.17 parameters
@query("SELECT event_id,CAST(event_id%97 AS DOUBLE) AS age,0.5::DOUBLE AS gain,-1.0::DOUBLE AS none FROM events")
def d05_parameters(spark, sf_dir):
    e = adapters.table(spark, sf_dir, "events")
    params = F.create_map(F.lit("age"), (F.col("event_id") % 97).cast("double"), F.lit("gain"), F.col("user_id").cast("double"))
    rows = records.with_parameters(e.select("event_id", params.alias("params")), {"gain": 0.5, "new": 2.0})
    return rows.select("event_id", records.parameter("age").alias("age"), records.parameter("gain").alias("gain"), records.parameter("none", -1.0).alias("none"))


# 2.9 key frames and walks
def _key_frames(mode: str, ease: str) -> None:
    sql = f"""WITH {RULERS}, k AS (SELECT * FROM rul WHERE t%3=1), n AS (SELECT ruler,count(*) n,min(t) lo,max(t) hi FROM k GROUP BY 1), r AS (SELECT rul.ruler,rul.t,n,lo,hi FROM rul JOIN n USING (ruler)),
g AS (SELECT *,CASE WHEN n=1 THEN lo WHEN t<lo THEN lo WHEN t>=hi THEN hi-3 ELSE lo+(t-lo)//3*3 END AS a FROM r), q AS (SELECT g.ruler,g.t,n,i.x ix,i.y iy,i.z iz,coalesce(j.x,i.x) jx,coalesce(j.y,i.y) jy,coalesce(j.z,i.z) jz,CASE WHEN n=1 THEN 0 ELSE (g.t-a)/3.0::DOUBLE END f
 FROM g JOIN k i ON i.ruler=g.ruler AND i.t=a LEFT JOIN k j ON j.ruler=g.ruler AND j.t=a+3), s AS (SELECT *,{ease} AS s FROM q)
SELECT ruler,t,round(ix+s*(jx-ix),5) AS x,round(iy+s*(jy-iy),5) AS y,round(iz+s*(jz-iz),5) AS z FROM s"""

    def run(spark, sf_dir):
        p = adapters.ruler_points(spark, sf_dir)
        known = p.where("t % 3 = 1")
        asked = p.join(known.select("ruler").distinct(), "ruler", "left_semi").select("ruler", "t")
        return rounded(timeseries.at_frames(known, asked, mode, "extend"), "x", "y", "z", digits=5)

    run.__name__ = f"t10_{mode}_extended"
    query(sql)(run)


_key_frames("linear", "f")
_key_frames("start", "2*f*f-f*f*f")
_key_frames("end", "f+f*f-f*f*f")
_key_frames("smooth", "3*f*f-2*f*f*f")


# 2.15 bins and edges
@query(f"""{_LINKS.replace('WITH', 'WITH RECURSIVE', 1)}, o(dz,dy,dx) AS (VALUES (0,0,1),(0,0,-1),(0,1,0),(0,-1,0),(1,0,0),(-1,0,0)), {_CONTACTS},
p AS (SELECT DISTINCT x.t+1 AS t,x.c,x.v2 a,y.v2 b FROM links x JOIN links y ON x.t=y.t AND x.c=y.c AND x.v1=y.v1 WHERE x.v2<y.v2),
mc AS (SELECT p.t,p.c,p.a,p.b FROM p JOIN con ON con.t=p.t AND con.c=p.c AND con.a=p.a AND con.b=p.b JOIN m i ON i.t=p.t AND i.c=p.c AND i.label=p.a JOIN m j ON j.t=p.t AND j.c=p.c AND j.label=p.b WHERE con.n/least(i.size,j.size)>0.05),
mb AS MATERIALIZED (SELECT t,c,a,b FROM mc UNION SELECT t,c,b,a FROM mc), bn(t,c,a,root) USING KEY (t,c,a) AS (SELECT DISTINCT t,c,a,a FROM mb UNION (SELECT mb.t,mb.c,mb.b,min(bn.root) FROM bn JOIN mb ON mb.t=bn.t AND mb.c=bn.c AND mb.a=bn.a JOIN recurring.bn n ON n.t=mb.t AND n.c=mb.c AND n.a=mb.b WHERE bn.root<n.root GROUP BY 1,2,3))
SELECT t,c,a AS label,root AS bin FROM bn""")
def r05_contact_bins(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return tracking.contact_bins(tracking.merge_candidates(tracking.frame_links(v), components.contacts(v), components.component_stats(v), 0.05))


@query(f"{_LINKS} SELECT * FROM links WHERE v1 IN (9,10) AND t>1 AND v2%2=0")
def r25_mapped_edges(spark, sf_dir):
    v = voxels(spark, sf_dir)
    now = v.where("label % 2 = 0 and label <> 0").select("t", "c", "label").distinct()
    return tracking.mapped_edges(tracking.frame_links(v), _listed(v), now)


# 2.14 labels from clusters
@query(f"""WITH RECURSIVE {VOX}, here AS (SELECT * FROM vox WHERE t=3 AND c=1), pts AS (SELECT (CAST(z AS BIGINT)<<40)|(CAST(y AS BIGINT)<<20)|CAST(x AS BIGINT) AS id,x::DOUBLE x,y::DOUBLE y,z*2.0::DOUBLE z,v::DOUBLE w FROM here WHERE mask>0 AND v>128), {dbscan_sql(2.5, 5)},
k AS (SELECT cluster,row_number() OVER (ORDER BY cluster) i FROM (SELECT DISTINCT cluster FROM found WHERE cluster IS NOT NULL)), fr AS (SELECT l AS label,row_number() OVER (ORDER BY l) i FROM range(3,20000,2) r(l) WHERE l NOT IN (SELECT label FROM here WHERE label<>0))
SELECT here.z,here.y,here.x,coalesce(fr.label,here.label) AS label FROM here LEFT JOIN found ON found.id=(CAST(here.z AS BIGINT)<<40)|(CAST(here.y AS BIGINT)<<20)|CAST(here.x AS BIGINT) LEFT JOIN k USING (cluster) LEFT JOIN fr USING (i)""")
def m01_cluster_labels(spark, sf_dir):
    v = voxels(spark, sf_dir).withColumn("mask", F.when(F.col("v") > 128, F.col("mask")).otherwise(0))
    return clustering.cluster_labels(v, 3, 1, "dbscan", eps=2.5, least=5, first=3, step=2, spacing=(1.0, 1.0, 2.0)).select("z", "y", "x", "label")


# 2.16 meshes of all frames and channels
_POINTS = f"""{_MESH}, co AS (SELECT t,c,((((((CAST(t AS BIGINT)*16+c)*64+cz+1)*64+cy+1)*64+cx+1)*8+nth)*3+i) AS id,CASE i WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END x,CASE i WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END y,CASE i WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END z FROM q,range(0,3) r(i)),
fi AS MATERIALIZED (SELECT *,min(id) OVER (PARTITION BY t,c,round(x,4),round(y,4),round(z,4)) AS first FROM co), ve AS MATERIALIZED (SELECT t,c,id,x,y,z FROM fi WHERE id=first),
tr3 AS MATERIALIZED (SELECT id//3 AS k,max(CASE WHEN id%3=0 THEN first END) a,max(CASE WHEN id%3=1 THEN first END) b,max(CASE WHEN id%3=2 THEN first END) c3 FROM fi GROUP BY 1),
ne AS MATERIALIZED (SELECT DISTINCT p,q FROM (SELECT a p,b q FROM tr3 UNION ALL SELECT b,a FROM tr3 UNION ALL SELECT b,c3 FROM tr3 UNION ALL SELECT c3,b FROM tr3 UNION ALL SELECT a,c3 FROM tr3 UNION ALL SELECT c3,a FROM tr3) WHERE p<>q),
me AS MATERIALIZED (SELECT p AS id,avg(x) mx,avg(y) my,avg(z) mz FROM ne JOIN ve ON ve.id=q GROUP BY 1), pu AS MATERIALIZED (SELECT ve.*,coalesce(mx,x) mx,coalesce(my,y) my,coalesce(mz,z) mz FROM ve LEFT JOIN me USING (id))"""


def _placed(vertices):
    """Places rounded, a little above the middle between two decimals, where engines may differ."""
    return vertices.withColumns({k: F.round(F.col(k) + 1e-7, 5) for k in "xyz"})


@query(f"{_POINTS} SELECT t,c,id,round(x+1e-7,5) AS x,round(y+1e-7,5) AS y,round(z+1e-7,5) AS z FROM ve")
def v09_welded(spark, sf_dir):
    return _placed(_mesh(spark, sf_dir)[1])


@query(f"""{_POINTS}, di AS (SELECT *,sqrt(pow((mx-x)*0.5,2)+pow((my-y)*0.5,2)+pow((mz-z)*0.5,2)) l FROM pu), sc AS (SELECT *,CASE WHEN l>0.5 THEN 0.5/l ELSE 1 END f FROM di)
SELECT id,round(x+(mx-x)*0.5*f+1e-7,5) AS x,round(y+(my-y)*0.5*f+1e-7,5) AS y,round(z+(mz-z)*0.5*f+1e-7,5) AS z FROM sc""")
def v12_smoothed(spark, sf_dir):
    _, vertices, triangles = _mesh(spark, sf_dir)
    return _placed(mesh.smoothed(vertices, triangles))


@query(f"""{_POINTS}, mv AS MATERIALIZED (SELECT id,CASE WHEN near THEN mx ELSE x END x,CASE WHEN near THEN my ELSE y END y,CASE WHEN near THEN mz ELSE z END z FROM (SELECT *,sqrt(pow(mx-x,2)+pow(my-y,2)+pow(mz-z,2))<=0.2037 AS near FROM pu)),
j AS MATERIALIZED (SELECT t.a,t.b,t.c3,pow(p.x-q.x,2)+pow(p.y-q.y,2)+pow(p.z-q.z,2) ab,pow(r.x-q.x,2)+pow(r.y-q.y,2)+pow(r.z-q.z,2) bc,pow(p.x-r.x,2)+pow(p.y-r.y,2)+pow(p.z-r.z,2) ca FROM tr3 t JOIN mv p ON p.id=t.a JOIN mv q ON q.id=t.b JOIN mv r ON r.id=t.c3)
SELECT a,b,c3 AS c FROM j WHERE ab>=1e-12 AND bc>=1e-12 AND ca>=1e-12""")
def v11_simplified(spark, sf_dir):
    _, vertices, triangles = _mesh(spark, sf_dir)
    return mesh.simplified(vertices, triangles, 0.2037)[1]


@query(f"""{_POINTS}, h AS (SELECT ve.id,vox.v,coalesce(label,0) AS label FROM ve LEFT JOIN vox ON vox.t=ve.t AND vox.c=ve.c AND vox.z=floor(ve.z+1e-9) AND vox.y=floor(ve.y+1e-9) AND vox.x=floor(ve.x+1e-9))
SELECT id,label=0 AS plain,round(coalesce(v,0)/255.0::DOUBLE,6) AS alpha FROM h""")
def v13_coloured(spark, sf_dir):
    v, vertices, _ = _mesh(spark, sf_dir)
    # Corners lie on grid lines up to rounding.
    near = vertices.withColumns({k: F.col(k) + 1e-9 for k in "xyz"})
    out = mesh.coloured(near, v)
    plain = (F.abs(F.col("r") - 0.2) < 1e-12) & (F.abs(F.col("g") - 0.4) < 1e-12) & (F.abs(F.col("b") - 0.4) < 1e-12)
    return out.select("id", plain.alias("plain"), F.round("alpha", 6).alias("alpha"))


# The headline operators over a volume that grows with the tables
@query(f"{_STATS.replace(VOX, WIDE)} SELECT t,c,label,n,total,round(sigma,6) AS sigma,round(cx,6) AS cx FROM s")
def c01_wide(spark, sf_dir):
    return rounded(components.component_stats(wide_voxels(spark, sf_dir)).select("t", "c", "label", "n", "total", "sigma", "cx"), "sigma", "cx")


@query(f"WITH {WIDE}, {_OFF6}, {_CONTACTS} SELECT * FROM con")
def j05_wide(spark, sf_dir):
    return components.contacts(wide_voxels(spark, sf_dir))


@query(f"WITH RECURSIVE {WIDE}, {runs_sql('SELECT * FROM vox WHERE v>32')} SELECT * FROM grown")
def g01_wide(spark, sf_dir):
    return segmentation.grow(wide_voxels(spark, sf_dir), 32)


@query(f"""WITH {WIDE}, o AS (SELECT * FROM range(-1,2) i(dz),range(-1,2) j(dy),range(-1,2) k(dx)), e AS (SELECT t,c,z+dz AS z,y+dy AS y,x+dx AS x,v*CASE WHEN (z+dz IN (0,6) AND dz=0) THEN 2 ELSE 1 END*CASE WHEN (y+dy IN (0,2047) AND dy=0) THEN 2 ELSE 1 END*CASE WHEN (x+dx IN (0,2047) AND dx=0) THEN 2 ELSE 1 END AS v FROM vox CROSS JOIN o WHERE z+dz BETWEEN 0 AND 6 AND y+dy BETWEEN 0 AND 2047 AND x+dx BETWEEN 0 AND 2047),
f AS (SELECT t,c,CAST(z AS INT) z,CAST(y AS INT) y,CAST(x AS INT) x,CAST(floor(round(sum(v)/255.0::DOUBLE/27,9)*255+1e-6) AS INT) AS v FROM e GROUP BY ALL) SELECT * FROM f WHERE v<>0""")
def w01_wide(spark, sf_dir):
    return stencil.apply(wide_voxels(spark, sf_dir), WIDE_DIMS, 1, stencil.box_mean)
