"""Registered queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, embedding_dedup, exact_dedup, fill_middle, language, media, mixing, near_dedup, packing, quality, substring_dedup, warc
from .storage import stored, tidy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media(table(spark, sf_dir, "documents"), "pgm")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(5, 0))
    return language.identify(docs, language.learn_dictionaries(docs.where("not held_out")), reject=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unpacked(packing.batches(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(3, 1))
    net = quality.train(quality.labelled_sample(docs.where("not held_out"), table(spark, sf_dir, "labels")))
    scored = quality.score(docs, net, {"doc_id": "long", "held_out": "boolean", "text": "string"})
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@tidy
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    found = chat.read_back(stored(chat.format_conversations(turns.unionByName(extra)), "formatted"))
    return stored(found.drop("n_tokens", "n_loss_tokens"), "conversations")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup,
        op2_media,
        op3_language,
        op4_mixing,
        op5_warc,
        op6_exact_dedup,
        op7_substring_dedup,
        op8_packing,
        op9_quality,
        op10_chat,
        op11_fill_middle,
        op12_embedding_dedup,
        op13_centroids,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_KEY = "md5('{}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')))"

SQL: dict[str, str] = {}

SQL["op1_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT b.b, r.c FROM r JOIN both_ways b ON b.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN m USING (doc_id)
"""

SQL["op4_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, {_KEY.format('mix')} AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
n AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / w AS ratio FROM n),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT arg_min(level, ratio) FROM v WHERE level <= ratio), cap)) AS target FROM v),
k AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""

_B32 = " || ".join(
    f"list_aggregate(list_transform([35, 30, 25, 20, 15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT) >> s) & 31 AS INT), 1)), 'string_agg', '')"
    for k in range(4)
)
SQL["op5_warc"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS r FROM h)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> r THEN r END AS refers_to FROM g
"""

SQL["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""

SQL["op7_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM x) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, 35) AS k(k)),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
a AS (SELECT u.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY u.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.i = c.i GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

# best[j + 1] is the least padding of the first j lengths, and a cut the smallest i that gives it.
_COSTS = "list_transform(range(0, n + 1), lambda j: list_transform(range(0, j), lambda i: p.best[i + 1] + ls[j] * (cs[j + 1] - cs[i + 1]) - (ws[j + 1] - ws[i + 1])))"
SQL["op8_packing"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS tokens, {_KEY.format('pack')} AS key FROM documents),
h AS (SELECT len(tokens) AS x, count(*) AS m FROM d GROUP BY 1),
a AS (SELECT x, sum(m) OVER (ORDER BY x) AS c, sum(m * x) OVER (ORDER BY x) AS w FROM h),
v AS (SELECT CAST(count(*) AS INT) AS n, list(CAST(x AS HUGEINT) ORDER BY x) AS ls, list_prepend(0::HUGEINT, list(CAST(c AS HUGEINT) ORDER BY x)) AS cs, list_prepend(0::HUGEINT, list(CAST(w AS HUGEINT) ORDER BY x)) AS ws FROM a),
dp(k, best, cut) AS (
  SELECT 1, list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 0::HUGEINT ELSE ls[j] * cs[j + 1] - ws[j + 1] END), list_transform(range(0, n + 1), lambda j: 0) FROM v
  UNION ALL
  SELECT k + 1, list_transform(costs, lambda l: coalesce(list_min(l), 0::HUGEINT)), list_transform(costs, lambda l: coalesce(list_position(l, list_min(l)) - 1, 0))
  FROM (SELECT p.k, {_COSTS} AS costs, n FROM dp p, v WHERE p.k < least(16, n)) q),
back(k, j, bound) AS (
  SELECT k, n, ls[n] FROM dp, v WHERE k = least(16, n)
  UNION ALL
  SELECT k - 1, j2, ls[j2] FROM (SELECT b.k, CAST(dp.cut[b.j + 1] AS INT) AS j2 FROM back b JOIN dp ON dp.k = b.k WHERE b.k > 1) z, v),
b AS (SELECT bound, row_number() OVER (ORDER BY bound) - 1 AS bucket FROM back),
r AS (SELECT doc_id, key, tokens, len(tokens) AS n_tokens, (SELECT min(bucket) FROM b WHERE bound >= len(d.tokens)) AS bucket, (SELECT min(bound) FROM b WHERE bound >= len(d.tokens)) AS bucket_length FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS before, greatest(1, 16384 // greatest(1, bucket_length)) AS room FROM r)
SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(bucket AS INT) AS bucket, CAST(bucket_length AS BIGINT) AS bucket_length, CAST(before // room AS BIGINT) AS batch,
       CAST(before % room AS BIGINT) AS slot, CAST(bucket_length - n_tokens AS BIGINT) AS padding, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM o
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
SQL["op10_chat"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        CAST(sum(length('<|turn|><|text|><|end|>') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

SQL["op11_fill_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, length(t) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, CAST(k AS INT), 8) AS BIGINT)) AS hs FROM d),
c AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR hs[3] % 100 >= 90 THEN 'plain'
             WHEN hs[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""

_FINITE = "coalesce(len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0, false)"

SQL["op12_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x, len(embedding) AS n, {_FINITE} AND list_max(list_transform(embedding, lambda c: abs(c))) > 0 AS fit FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id
      WHERE CASE WHEN a.fit AND b.fit THEN list_cosine_similarity(a.x, b.x) >= 0.93 ELSE false END),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""


def _centroid_sql(clusters: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """Rounds one after the other: distances, the nearest centroid, and the floor of each component's mean."""
    far = "list_sum(list_transform(list_zip(e.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {dims} AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM (SELECT x, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM e ORDER BY h LIMIT {clusters}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, min(struct_pack(d := d, j := j)) AS b FROM (SELECT e.id, c.j, CAST({far} AS BIGINT) AS d FROM e, c{r} c) GROUP BY 1)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT j, i, sum(v) AS s, count(*) AS n FROM (SELECT a.b.j AS j, unnest(e.x) AS v, unnest(range(1, {dims + 1})) AS i FROM e JOIN a{r} a USING (id)) GROUP BY 1, 2)")
            steps.append(f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY 1)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))")
    return f"""
WITH {", ".join(steps)}
SELECT e.vec_id, CAST(a.b.j AS INT) AS cluster, a.b.d AS distance, CAST(sum(a.b.d) OVER (PARTITION BY a.b.j) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM e JOIN a{rounds} a USING (id) JOIN c{rounds} c ON c.j = a.b.j
"""


SQL["op13_centroids"] = _centroid_sql()
