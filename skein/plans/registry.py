"""The threading queries by name, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import kernels as K
from skein.operators import community, entity_graph, metrics, pairs, text, threads, tuning
from skein.plans import validation
from skein.plans.articles import Settings, articles, entities, table, tokens, with_positions
from skein.session import cut_lineage
from skein.sources import files

P = Settings()
FLAT = Settings(td=False, w=0.7)
WITH_ENTITIES = Settings(ent=True)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# Common table expressions of the oracle, each with what it needs.
_CTE = {
    "a": ("", """k AS (SELECT (SELECT count(*) FROM events) // (SELECT count(*) FROM embeddings) AS stride, (SELECT count(*) FROM documents) AS nd),
a0 AS (SELECT e.vec_id AS doc_id, CAST(e.embedding AS DOUBLE[]) AS emb, e.label AS story_id, v.ts AS ts, e.vec_id % k.nd AS text_id FROM embeddings e CROSS JOIN k JOIN events v ON v.event_id = e.vec_id * k.stride),
a AS (SELECT *, row_number() OVER (ORDER BY ts, doc_id) - 1 AS doc_pos, epoch_us(ts) / 1e6 AS sec FROM a0)"""),
    "ent": ("a", """ent AS (SELECT DISTINCT * FROM (SELECT event_id // k.stride AS doc_id, 'who' AS q, 'u' || user_id AS entity FROM events, k WHERE event_id % k.stride < 2 AND event_id // k.stride < (SELECT count(*) FROM embeddings)
UNION ALL SELECT event_id // k.stride, 'where', 'k' || json_extract_string(props, '$.k') FROM events, k WHERE event_id % k.stride < 2 AND event_id // k.stride < (SELECT count(*) FROM embeddings)))"""),
    "tok": ("", r"""tok AS (SELECT doc_id AS text_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS tokens FROM documents)"""),
    "flat": ("a", "flat AS (SELECT s.doc_id AS src, t.doc_id AS dst, s.doc_pos AS src_pos, t.doc_pos AS dst_pos, 1 - list_dot_product(s.emb, t.emb) / sqrt(list_dot_product(s.emb, s.emb) * list_dot_product(t.emb, t.emb)) AS distance FROM a s JOIN a t ON s.doc_pos < t.doc_pos)"),
    "edges": ("flat", "edges AS (SELECT * FROM (SELECT f.src, f.dst, f.src_pos, f.dst_pos, 1 - (1 - f.distance) * exp(-3.0 * abs(s.sec - t.sec) / (SELECT max(sec) - min(sec) FROM a)) AS distance FROM flat f JOIN a s ON s.doc_id = f.src JOIN a t ON t.doc_id = f.dst) WHERE distance < 0.8)"),
    "parents": ("edges", "parents AS (SELECT dst AS node, arg_min(src, (distance, src_pos, src)) AS parent, min(distance) AS weight FROM edges WHERE distance <> 0 GROUP BY dst)"),
    "nodes": ("edges", "nodes AS (SELECT node, min(seen) AS seen FROM (SELECT src AS node, (src_pos, dst_pos, 0) AS seen FROM edges UNION ALL SELECT dst, (src_pos, dst_pos, 1) FROM edges) GROUP BY node)"),
    "roots": ("parents nodes", "up AS (SELECT n.node AS root, n.node FROM nodes n WHERE n.node NOT IN (SELECT node FROM parents) UNION ALL SELECT up.root, p.node FROM up JOIN parents p ON p.parent = up.node), roots AS (SELECT node, root FROM up)"),
    "cut": ("roots", """pw AS (SELECT p.node, p.parent, round(p.weight, 12) AS weight, r.root FROM parents p JOIN roots r ON r.node = p.node),
th AS (SELECT 1.5 * (q[2] - q[1]) * q[2] AS th FROM (SELECT root, quantile_cont(weight, [0.25, 0.75]) AS q FROM pw GROUP BY root) JOIN (SELECT r.root, min(n.seen) AS seen FROM roots r JOIN nodes n ON n.node = r.node GROUP BY r.root) USING (root) ORDER BY seen LIMIT 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY weight) - 1 AS i, (SELECT least(greatest(th, 0), 100) FROM th) / 100 * (count(*) OVER (PARTITION BY root) - 1) AS kk FROM pw),
lim AS (SELECT root, round(max(weight) FILTER (i = floor(kk)) + max(kk - floor(kk)) * (max(weight) FILTER (i = ceil(kk)) - max(weight) FILTER (i = floor(kk))), 12) AS cut FROM ranked GROUP BY root),
deg AS (SELECT parent, count(*) AS children FROM parents GROUP BY parent),
cut AS (SELECT pw.node, pw.parent, pw.weight FROM pw JOIN lim USING (root) LEFT JOIN deg ON deg.parent = pw.node WHERE NOT (pw.weight > lim.cut AND coalesce(deg.children, 0) > 1))"""),
    "members": ("cut", "up2 AS (SELECT n.node AS thread_id, n.node FROM nodes n WHERE n.node NOT IN (SELECT node FROM cut) UNION ALL SELECT up2.thread_id, c.node FROM up2 JOIN cut c ON c.parent = up2.node), members AS (SELECT node AS doc_id, thread_id FROM up2)"),
    "ordered": ("members", "o1 AS (SELECT m.thread_id, a.doc_id, a.ts, a.story_id, a.emb, row_number() OVER w AS seq, lag(a.emb) OVER w AS before FROM members m JOIN a ON a.doc_id = m.doc_id WINDOW w AS (PARTITION BY m.thread_id ORDER BY a.ts, a.doc_id)), ordered AS (SELECT thread_id, doc_id, ts, story_id, seq, CASE WHEN before IS NOT NULL THEN list_dot_product(emb, before) / sqrt(list_dot_product(emb, emb) * list_dot_product(before, before)) END AS step FROM o1)"),
    "threads": ("ordered", "threads AS (SELECT thread_id, count(*) AS length, min(ts) AS first_ts, max(ts) AS last_ts, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) / 86400.0 AS span_days, coalesce(avg(step), 'nan'::DOUBLE) AS similarity FROM ordered GROUP BY thread_id)"),
    "shared": ("edges ent", "be AS (SELECT DISTINCT doc_id, entity FROM ent), cnt AS (SELECT e.src, e.dst, count(*) AS shared FROM edges e JOIN be x ON x.doc_id = e.src JOIN be y ON y.doc_id = e.dst AND y.entity = x.entity GROUP BY e.src, e.dst), shared AS (SELECT e.src, e.dst, e.distance, coalesce(c.shared, 0) AS shared FROM edges e LEFT JOIN cnt c ON c.src = e.src AND c.dst = e.dst)"),
    "paths": ("shared", "hop AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM be x JOIN be y ON x.entity = y.entity AND x.doc_id <> y.doc_id), s0 AS (SELECT DISTINCT src FROM shared WHERE shared = 0), h1 AS (SELECT src, b, 1 AS h FROM s0 JOIN hop ON a = src), h2 AS (SELECT DISTINCT h1.src, hop.b, 2 AS h FROM h1 JOIN hop ON hop.a = h1.b), d0 AS (SELECT DISTINCT dst FROM shared WHERE shared = 0), g1 AS (SELECT dst, b, 1 AS h FROM d0 JOIN hop ON a = dst), g2 AS (SELECT DISTINCT g1.dst, hop.b, 2 AS h FROM g1 JOIN hop ON hop.a = g1.b), hs AS (SELECT src, b, min(h) AS h FROM (SELECT src, src AS b, 0 AS h FROM s0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY src, b), gs AS (SELECT dst, b, min(h) AS h FROM (SELECT dst, dst AS b, 0 AS h FROM d0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY dst, b), met AS (SELECT s.src, s.dst, min(2 * (hs.h + gs.h)) AS edges FROM shared s JOIN hs ON hs.src = s.src JOIN gs ON gs.dst = s.dst AND gs.b = hs.b WHERE s.shared = 0 GROUP BY s.src, s.dst), paths AS (SELECT s.src, s.dst, s.distance, s.shared, m.edges FROM shared s LEFT JOIN met m ON m.src = s.src AND m.dst = s.dst)"),
    "ftok": ("tok", r"""ftok AS (SELECT text_id, list_filter(list_transform(tokens, lambda x: regexp_replace(strip_accents(x), '[^\x00-\x7F]', '', 'g')), lambda x: x <> '') AS tokens FROM tok)"""),
    "tfidf": ("ftok", "tc AS (SELECT text_id, term, count(*) AS tf FROM (SELECT text_id, unnest(tokens) AS term FROM ftok) GROUP BY ALL), nn AS (SELECT count(*) AS n FROM tok), tdf AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tc GROUP BY term HAVING count(*) <= 0.9 * (SELECT n FROM nn) ORDER BY cf DESC, term LIMIT 100000), tx AS (SELECT text_id, term, tf * (ln((1 + (SELECT n FROM nn))::DOUBLE / (1 + df)) + 1) AS x FROM tc JOIN tdf USING (term)), tfidf AS (SELECT text_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY text_id)) AS tfidf FROM tx)"),
    "grams": ("ftok", "grams AS (SELECT text_id, gram, count(*) AS n FROM (SELECT text_id, unnest(flatten([list_transform(range(1, len(tokens) - m + 2), lambda i: array_to_string(tokens[i:i + m - 1], ' ')) for m in [1, 2, 3]])) AS gram FROM ftok) GROUP BY ALL)"),
    "keywords": ("members tfidf", """sz AS (SELECT thread_id, count(*) AS docs FROM members GROUP BY thread_id),
r0 AS (SELECT m.thread_id, t.term, count(*) AS df, sum(t.tfidf) AS s FROM members m JOIN a USING (doc_id) JOIN tfidf t USING (text_id) GROUP BY ALL),
r AS (SELECT thread_id, term, CASE WHEN df::DOUBLE / docs >= 0.9 THEN 0.0 ELSE df::DOUBLE / docs END AS x, s / docs AS y FROM r0 JOIN sz USING (thread_id)),
l AS (SELECT thread_id, ln(sum(exp(x)) + (SELECT count(DISTINCT term) FROM tfidf) - count(*)) AS lx, ln(sum(exp(y)) + (SELECT count(DISTINCT term) FROM tfidf) - count(*)) AS ly FROM r GROUP BY thread_id),
sc AS (SELECT thread_id, term, round(x - lx + y - ly, 9) AS score FROM r JOIN l USING (thread_id)),
keywords AS (SELECT thread_id, CAST(rank AS INTEGER) AS rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY score DESC, term DESC) AS rank FROM sc) WHERE rank <= 3)"""),
    "diversity": ("members grams", """own AS (SELECT m.thread_id, m.doc_id, g.gram, g.n FROM members m JOIN a USING (doc_id) JOIN grams g USING (text_id)), tot AS (SELECT thread_id, gram, sum(n) AS all_n FROM own GROUP BY ALL),
e AS (SELECT m.thread_id, m.doc_id, coalesce(o.n, 0) AS n, t.all_n - coalesce(o.n, 0) AS q FROM members m JOIN tot t USING (thread_id) LEFT JOIN own o ON o.thread_id = m.thread_id AND o.doc_id = m.doc_id AND o.gram = t.gram WHERE t.all_n - coalesce(o.n, 0) > 0),
z AS (SELECT thread_id, doc_id, sum(n) AS sp, sum(q) AS sq, sum(CASE WHEN n > 0 THEN n * ln(n / CAST(q AS DOUBLE)) END) AS s FROM e GROUP BY ALL),
kl AS (SELECT m.thread_id, CASE WHEN sp > 0 THEN s / sp + ln(sq / CAST(sp AS DOUBLE)) ELSE 'nan'::DOUBLE END AS kl FROM members m LEFT JOIN z USING (thread_id, doc_id)),
diversity AS (SELECT thread_id, avg(kl) AS diversity FROM kl GROUP BY thread_id)"""),
    "coherence": ("keywords ftok", """cw AS (SELECT DISTINCT thread_id, term FROM keywords),
ct AS (SELECT m.doc_id, t.tokens, greatest(len(t.tokens) - 110, 0) AS last FROM members m JOIN a USING (doc_id) JOIN ftok t USING (text_id) WHERE len(t.tokens) > 0),
cp AS (SELECT doc_id, last, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS p FROM ct),
win AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(p - 109, 0), least(p, last) + 1)) AS s FROM cp WHERE term IN (SELECT term FROM cw)),
nw AS (SELECT sum(last + 1)::DOUBLE AS w FROM ct), one AS (SELECT term, count(*) AS n FROM win GROUP BY term),
tp AS (SELECT DISTINCT x.term AS a, y.term AS b FROM cw x JOIN cw y USING (thread_id)),
two AS (SELECT tp.a, tp.b, count(*) AS n FROM tp JOIN win x ON x.term = tp.a JOIN win y ON y.term = tp.b AND y.doc_id = x.doc_id AND y.s = x.s GROUP BY ALL),
cell AS (SELECT x.thread_id, x.term AS a, y.term AS b, ln((coalesce(t.n, 0) / w + 1e-12) / (oa.n / w * (ob.n / w))) / -ln(coalesce(t.n, 0) / w + 1e-12) AS v FROM cw x JOIN cw y USING (thread_id) JOIN one oa ON oa.term = x.term JOIN one ob ON ob.term = y.term LEFT JOIN two t ON t.a = x.term AND t.b = y.term, nw),
tot_v AS (SELECT thread_id, b, sum(v) AS s FROM cell GROUP BY ALL), tot_n AS (SELECT thread_id, sqrt(sum(s * s)) AS n FROM tot_v GROUP BY thread_id),
coherence AS (SELECT thread_id, avg(r) AS coherence FROM (SELECT c.thread_id, c.a, sum(c.v * t.s) / sqrt(sum(c.v * c.v)) / any_value(n.n) AS r FROM cell c JOIN tot_v t ON t.thread_id = c.thread_id AND t.b = c.b JOIN tot_n n ON n.thread_id = c.thread_id GROUP BY c.thread_id, c.a) GROUP BY thread_id)"""),
}


def _with(needs: str, final: str) -> str:
    done: list[str] = []

    def add(name: str) -> None:
        before, body = _CTE[name]
        for b in before.split():
            add(b)
        if body not in done:
            done.append(body)

    for n in needs.split():
        add(n)
    return f"WITH RECURSIVE {', '.join(done)}{'' if final.startswith(',') else ' '}{final}" if done else final


def query(name: str, needs: str = "", sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = _with(needs, sql)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c: str, places: int = 6):
    return F.round(c, places).alias(c)


def _edges(spark, sf_dir, p=P, forest=False):
    """Weighted edges of the article graph; with ``forest`` and no entities only those that communities can take."""
    found = pairs.similar_pairs(articles(spark, sf_dir), p, forest=forest and not p.ent)
    return entity_graph.entity_weighted(found, entities(spark, sf_dir), p) if p.ent else found.withColumn("weight", F.col("distance"))


def _ordered(spark, sf_dir, p=P):
    return threads.ordered(community.communities(_edges(spark, sf_dir, p, forest=True), p), articles(spark, sf_dir))


def _members(spark, sf_dir, p=P):
    """``thread_id, doc_id, text_id`` of the threads."""
    found = community.communities(_edges(spark, sf_dir, p, forest=True), p).withColumnRenamed("node", "doc_id")
    return found.join(articles(spark, sf_dir).select("doc_id", "text_id"), "doc_id")


def _measured(spark, sf_dir, p=P):
    """The threads' summaries with ``coherence``, ``diversity`` and the keywords' weight."""
    return validation.measured(articles(spark, sf_dir), _edges(spark, sf_dir, p, forest=True), tokens(spark, sf_dir), p)


# Order, dates, slices


@query("p4_article_order", "a", "SELECT doc_id, doc_pos, text_id, story_id, round(sec, 6) AS sec FROM a")
def p4(spark, d):
    return articles(spark, d).select("doc_id", "doc_pos", "text_id", "story_id", _r("sec"))


@query("p7_part_slice", "a", "SELECT doc_id, doc_pos - 100 AS pos FROM a WHERE doc_pos >= 100 AND doc_pos < 300")
def p7(spark, d):
    return articles(spark, d).where("doc_pos >= 100 and doc_pos < 300").select("doc_id", (F.col("doc_pos") - 100).alias("pos"))


@query("p1_membership_split", "", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'train' ELSE 'test' END AS split FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p1(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    train = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").withColumn("split", F.lit("train"))
    rest = docs.join(labels.where("quality = 1"), "doc_id", "left_anti").join(labels, "doc_id", "left_semi")
    return train.unionByName(rest.withColumn("split", F.lit("test")))


@query("p3_semi_join_rekey", "", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p3(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("p14_docs_until_day", "a", "SELECT doc_id, ts FROM a WHERE ts < (SELECT CAST(min(ts) AS DATE) FROM a) + INTERVAL 10 DAY")
def p14(spark, d):
    rows = articles(spark, d)
    start = rows.agg(F.to_date(F.min("ts")).alias("d0"))
    return rows.crossJoin(F.broadcast(start)).where(F.col("ts") < F.date_add("d0", 10)).select("doc_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("a1_daily_counts", "a", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM a GROUP BY 1")
def a1(spark, d):
    return articles(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("o10_cumulative_counts", "a", "SELECT day, n, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS up_to FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM a GROUP BY 1)")
def o10(spark, d):
    return a1(spark, d).withColumn("up_to", F.sum("n").over(Window.orderBy("day")))


@query("o11_next_day", "a", "SELECT b AS dt_en, coalesce((SELECT min(CAST(ts AS DATE)) FROM a WHERE doc_pos >= b), (SELECT max(CAST(ts AS DATE)) FROM a)) AS next_day FROM (VALUES (0), (100), (499), (100000)) v(b)")
def o11(spark, d):
    rows, ends = articles(spark, d), spark.createDataFrame([(0,), (100,), (499,), (100000,)], "dt_en int")
    last = rows.agg(F.to_date(F.max("ts")).alias("last"))
    met = F.broadcast(ends).crossJoin(rows.select("doc_pos", "ts")).groupBy("dt_en").agg(F.min(F.when(F.col("doc_pos") >= F.col("dt_en"), F.to_date("ts"))).alias("d"))
    return met.crossJoin(F.broadcast(last)).select("dt_en", F.coalesce("d", "last").alias("next_day"))


@query("s6_key_value_text", "", "SELECT trim(split_part(v, '~|~', 1)) AS key, trim(split_part(v, '~|~', 2)) AS value FROM (SELECT n_nationkey || ' ~|~ ' || n_name AS v FROM nation)")
def s6(spark, d):
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(" ~|~ "), "n_name")
    return table(spark, d, "nation").select(*files.key_values(line))


@query("s7_part_ranges", "", r"SELECT CAST(regexp_extract(v, '^(\d+)', 1) AS INTEGER) AS part_id, CAST(regexp_extract(v, '\((\d+)', 1) AS BIGINT) AS st, CAST(regexp_extract(v, ',\s*(\d+)\)', 1) AS BIGINT) AS en FROM (SELECT r_regionkey || '~|~(' || r_regionkey * 250 || ', ' || (r_regionkey + 1) * 250 || ')' AS v FROM region)")
def s7(spark, d):
    v = table(spark, d, "region").selectExpr("concat(r_regionkey, '~|~(', r_regionkey * 250, ', ', (r_regionkey + 1) * 250, ')') as v")
    return files.part_ranges(v.select(*files.key_values(F.col("v"))))


# Weights and pairs


@query("w1_normalised_rows", "a", "SELECT doc_id, round(list_sum(list_transform(emb, lambda x: x / sqrt(list_dot_product(emb, emb)))), 6) AS s FROM a")
def w1(spark, d):
    return articles(spark, d).select("doc_id", F.round(F.aggregate(K.normalised(F.col("emb")), F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("w3_time_decay", "a", "SELECT doc_id, round(exp(-10.0 * abs(sec - (SELECT min(sec) FROM a)) / (SELECT max(sec) - min(sec) FROM a)), 6) AS decay FROM a")
def w3(spark, d):
    rows = articles(spark, d)
    ends = rows.agg(F.min("sec").alias("lo"), (F.max("sec") - F.min("sec")).alias("span"))
    return rows.crossJoin(F.broadcast(ends)).select("doc_id", F.round(K.time_decay(F.col("sec"), F.col("lo"), F.col("span"), 10.0), 6).alias("decay"))


@query("j1_cosine_pair_join", "flat", "SELECT src, dst, round(distance, 6) AS distance FROM flat WHERE distance < 0.7")
def j1(spark, d):
    return pairs.similar_pairs(articles(spark, d), FLAT).select("src", "dst", _r("distance"))


@query("j2_decayed_pair_join", "edges", "SELECT src, dst, round(distance, 6) AS distance FROM edges")
def j2(spark, d):
    return pairs.similar_pairs(articles(spark, d), P).select("src", "dst", _r("distance"))


@query("j3_new_pair_join", "edges", "SELECT src, dst, round(distance, 6) AS distance FROM edges JOIN a s ON s.doc_id = src JOIN a t ON t.doc_id = dst WHERE s.doc_pos >= 400 OR t.doc_pos >= 400")
def j3(spark, d):
    rows = articles(spark, d)
    return pairs.similar_pairs(rows, P, sources=rows.where("doc_pos >= 400")).select("src", "dst", _r("distance"))


@query("w10_clustering_affinity", "flat", "SELECT src, dst, CASE WHEN distance > 0.8 THEN 0.0 ELSE round(1 - distance, 6) END AS similarity FROM flat")
def w10(spark, d):
    found = pairs.similar_pairs(articles(spark, d), Settings(td=False, w=3.0))
    return found.select("src", "dst", F.when(F.col("distance") > 0.8, 0.0).otherwise(F.round(1 - F.col("distance"), 6)).alias("similarity"))


@query("g4_entity_graph", "ent", "SELECT DISTINCT doc_id, entity FROM ent")
def g4(spark, d):
    return entity_graph.bipartite(entities(spark, d))


@query("g5_graph_counts", "ent", "SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT entity) AS entities, count(DISTINCT (doc_id, entity)) AS edges FROM ent")
def g5(spark, d):
    return g4(spark, d).agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("entity").alias("entities"), F.count("*").alias("edges"))


@query("j4_shared_entities", "shared", "SELECT src, dst, shared FROM shared")
def j4(spark, d):
    return entity_graph.shared_counts(pairs.similar_pairs(articles(spark, d), P), g4(spark, d))


@query("j5_entity_paths", "paths", "SELECT src, dst, CAST(edges AS INTEGER) AS edges FROM paths WHERE shared = 0")
def j5(spark, d):
    found = entity_graph.entity_weighted(pairs.similar_pairs(articles(spark, d), P), entities(spark, d), P)
    return found.where("shared = 0").select("src", "dst", "edges")


@query("w8_entity_weight", "paths", "SELECT src, dst, round(1 - (1 - distance) * CASE WHEN shared > 0 THEN 0.5 * (1 + (1 - exp(-0.1 * shared / 5.0))) ELSE 0.5 * exp(-0.1 * (coalesce(edges, 10) / 2.0) / 5.0) END, 6) AS weight FROM paths")
def w8(spark, d):
    return _edges(spark, d, WITH_ENTITIES).select("src", "dst", _r("weight"))


# Communities and threads


@query("g8_best_parent", "parents", "SELECT node, parent, round(weight, 6) AS weight FROM parents")
def g8(spark, d):
    return community.best_parents(_edges(spark, d, forest=True)).select("node", "parent", _r("weight"))


@query("g13_out_degree", "parents", "SELECT parent, count(*) AS children FROM parents GROUP BY parent")
def g13(spark, d):
    return community.best_parents(_edges(spark, d, forest=True)).groupBy("parent").agg(F.count("*").alias("children"))


@query("g14_components", "roots", "SELECT node, root FROM roots")
def g14(spark, d):
    edges = cut_lineage(_edges(spark, d, forest=True))
    return community.forest_roots(community.first_seen(edges), community.best_parents(edges))


@query("g10_weak_link_cut", "cut", "SELECT node, parent, round(weight, 6) AS weight FROM cut")
def g10(spark, d):
    edges = cut_lineage(_edges(spark, d, forest=True))
    seen, parents = community.first_seen(edges), community.best_parents(edges)
    return community.weak_link_cut(parents, community.forest_roots(seen, parents), seen, P).select("node", "parent", _r("weight"))


@query("a13_component_percentiles", "roots", "SELECT root, round(quantile_cont(weight, 0.25), 6) AS p25, round(quantile_cont(weight, 0.75), 6) AS p75 FROM parents JOIN roots USING (node) GROUP BY root")
def a13(spark, d):
    edges = cut_lineage(_edges(spark, d, forest=True))
    parents = community.best_parents(edges)
    rows = parents.join(community.forest_roots(community.first_seen(edges), parents), "node")
    return rows.groupBy("root").agg(F.round(F.percentile("weight", 0.25), 6).alias("p25"), F.round(F.percentile("weight", 0.75), 6).alias("p75"))


@query("d1_threads", "threads", "SELECT thread_id, length, first_ts, last_ts, round(span_days, 6) AS span_days, round(similarity, 6) AS similarity FROM threads")
def d1(spark, d):
    found = threads.summary(_ordered(spark, d))
    return found.select("thread_id", "length", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), _r("span_days"), _r("similarity"))


@query("o1_thread_order", "ordered", "SELECT thread_id, doc_id, CAST(seq AS INTEGER) AS seq FROM ordered")
def o1(spark, d):
    return _ordered(spark, d).select("thread_id", "doc_id", "seq")


@query("o3_lag_cosine", "ordered", "SELECT doc_id, round(step, 6) AS step FROM ordered")
def o3(spark, d):
    return _ordered(spark, d).select("doc_id", _r("step"))


@query("p12_selected_threads", "threads", "SELECT thread_id, length FROM threads WHERE length BETWEEN 2 AND 100 AND span_days BETWEEN 0 AND 120 AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1")
def p12(spark, d):
    return threads.select(threads.summary(_ordered(spark, d)), P).select("thread_id", "length")


@query("a9_run_summary", "threads", "SELECT count(*) AS n, round(avg(length), 6) AS mean_length, round(avg(similarity) FILTER (NOT isnan(similarity)), 6) AS mean_similarity FROM threads")
def a9(spark, d):
    return threads.summary(_ordered(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("length"), 6).alias("mean_length"), F.round(F.avg(F.when(~F.isnan("similarity"), F.col("similarity"))), 6).alias("mean_similarity"))


@query("a7_mean_span", "threads", "SELECT round(avg(span_days), 6) AS mean_span FROM threads")
def a7(spark, d):
    return threads.summary(_ordered(spark, d)).agg(F.round(F.avg("span_days"), 6).alias("mean_span"))


# Measures


@query("j8_doc_thread", "members", "SELECT a.doc_id, coalesce(m.thread_id, -1) AS thread_id FROM a LEFT JOIN members m ON m.doc_id = a.doc_id")
def j8(spark, d):
    return articles(spark, d).select("doc_id").join(_members(spark, d).select("doc_id", "thread_id"), "doc_id", "left").select("doc_id", F.coalesce("thread_id", F.lit(-1)).alias("thread_id"))


@query("a2_contingency", "members", "SELECT story_id AS t, thread_id AS p, count(*) AS n FROM members JOIN a USING (doc_id) GROUP BY ALL")
def a2(spark, d):
    return metrics.contingency(_ordered(spark, d), "story_id", "thread_id")


_AGREE = """c AS (SELECT t, p, count(*) AS n FROM x GROUP BY t, p), s AS (SELECT CAST(sum(n) AS DOUBLE) AS m FROM c),
ct AS (SELECT t, sum(n) AS n FROM c GROUP BY t), cp AS (SELECT p, sum(n) AS n FROM c GROUP BY p),
mi AS (SELECT sum(c.n / m * ln(c.n * m / (ct.n * cp.n))) AS mi FROM c JOIN ct USING (t) JOIN cp USING (p), s),
h AS (SELECT (SELECT -sum(n / m * ln(n / m)) FROM ct, s) AS ht, (SELECT -sum(n / m * ln(n / m)) FROM cp, s) AS hp)
SELECT round(mi / ht, 6) AS homogeneity, round(2 * mi / (ht + hp), 6) AS nmi FROM mi, h"""


@query("a3_agreement_selected", "members", ", x AS (SELECT story_id AS t, thread_id AS p FROM members JOIN a USING (doc_id)), " + _AGREE)
def a3(spark, d):
    return metrics.agreement(_ordered(spark, d), "story_id", "thread_id").select(_r("homogeneity"), _r("nmi"))


@query("a5_agreement_all", "members", ", x AS (SELECT story_id AS t, coalesce(thread_id, -1) AS p FROM a LEFT JOIN members USING (doc_id)), " + _AGREE)
def a5(spark, d):
    rows = j8(spark, d).join(articles(spark, d).select("doc_id", "story_id"), "doc_id")
    return metrics.agreement(rows, "story_id", "thread_id").select(_r("homogeneity"), _r("nmi"))


@query("a6_counts", "members", "SELECT count(*) AS sel_docs, count(DISTINCT thread_id) AS sel_pred, count(DISTINCT story_id) AS sel_true, (SELECT count(*) FROM a) AS all_docs, (SELECT count(DISTINCT story_id) FROM a) AS all_true FROM members JOIN a USING (doc_id)")
def a6(spark, d):
    sel = _ordered(spark, d).agg(F.count("*").alias("sel_docs"), F.count_distinct("thread_id").alias("sel_pred"), F.count_distinct("story_id").alias("sel_true"))
    return sel.crossJoin(articles(spark, d).agg(F.count("*").alias("all_docs"), F.count_distinct("story_id").alias("all_true")))


@query("a12_labels_per_part", "a", "SELECT 0 AS part_id, count(DISTINCT story_id) AS k FROM a")
def a12(spark, d):
    return articles(spark, d).groupBy("part_id").agg(F.count_distinct("story_id").alias("k"))


@query("j7_story_docs", "a", "SELECT story_id, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM a GROUP BY story_id HAVING count(*) > 2")
def j7(spark, d):
    return articles(spark, d).groupBy("story_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("docs")).where("n > 2")


_P_VALUE = "exp(-statistic / 2) * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))"


@query("a16_mcnemar", "", f"SELECT only_a, only_b, round(statistic, 6) AS statistic, round({_P_VALUE}, 6) AS p_value, statistic >= 3.841458820694124 AS significant FROM (SELECT *, 1 / (1 + 0.3275911 * sqrt(statistic / 2)) AS t FROM (SELECT only_a, only_b, pow(greatest(abs(only_a - only_b) - 1, 0), 2) / nullif(CAST(only_a + only_b AS DOUBLE), 0) AS statistic FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM labels)))")
def a16(spark, d):
    return metrics.mcnemar(table(spark, d, "labels"), "quality", "toxic").select("only_a", "only_b", _r("statistic"), _r("p_value"), "significant")


@query("a16_transitions", "", "SELECT CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN toxic = 1 THEN 'FP' ELSE 'TN' END END AS before, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 2 = 1 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN doc_id % 2 = 1 THEN 'FP' ELSE 'TN' END END AS after, count(*) AS n FROM labels GROUP BY ALL")
def a16_transitions(spark, d):
    return metrics.label_transitions(table(spark, d, "labels").withColumn("odd", F.col("doc_id") % 2), "quality", "toxic", "odd")


@query("a17_classifier_measures", "", "SELECT round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS bac, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn FROM labels)")
def a17(spark, d):
    return metrics.classifier_measures(table(spark, d, "labels"), "quality", "toxic").select(*[_r(c) for c in ("bac", "precision", "recall", "f1")])


# Text


@query("t1_token_join", "tok", "SELECT text_id, len(tokens) AS n, array_to_string(tokens, '~|~') AS joined FROM tok")
def t1(spark, d):
    return tokens(spark, d).select("text_id", F.size("tokens").cast("long").alias("n"), F.array_join("tokens", "~|~").alias("joined"))


@query("t2_tfidf", "tfidf", "SELECT text_id, term, round(tfidf, 6) AS tfidf FROM tfidf")
def t2(spark, d):
    return text.tfidf(tokens(spark, d), "text_id").select("text_id", "term", _r("tfidf"))


@query("t12_ngrams", "grams", "SELECT text_id, gram, n FROM grams")
def t12(spark, d):
    return text.ngrams(tokens(spark, d), "text_id")


@query("t20_vocabulary", "tok", "SELECT term, CAST(row_number() OVER (ORDER BY term) AS INTEGER) AS id FROM (SELECT DISTINCT unnest(tokens) AS term FROM tok)")
def t20(spark, d):
    terms = tokens(spark, d).select(F.explode("tokens").alias("term")).distinct()
    return with_positions(terms, "term").select("term", (F.col("doc_pos") + 1).cast("int").alias("id"))


@query("t13_thread_diversity", "diversity", "SELECT thread_id, round(diversity, 6) AS diversity FROM diversity")
def t13(spark, d):
    return text.diversity(_members(spark, d), tokens(spark, d)).select("thread_id", _r("diversity"))


@query("t8_thread_keywords", "keywords", "SELECT thread_id, rank, term, round(score, 6) AS score FROM keywords")
def t8(spark, d):
    return text.keywords(_members(spark, d), tokens(spark, d)).select("thread_id", "rank", "term", _r("score"))


@query("t10_keyword_weight", "keywords", "SELECT thread_id, round(sum(score) / 3, 6) AS keyword_weight, string_agg(term, ' ' ORDER BY term) AS keywords FROM keywords GROUP BY thread_id")
def t10(spark, d):
    frame = text.keywords(_members(spark, d), tokens(spark, d)).groupBy("thread_id")
    return frame.agg(F.round(F.sum("score") / 3, 6).alias("keyword_weight"), F.array_join(F.array_sort(F.collect_list("term")), " ").alias("keywords"))


# Tuning


@query("a11_grid", "", "SELECT l[1] AS l_lo, l[2] AS l_hi, s[1] AS s_lo, s[2] AS s_hi, 0 AS d_lo, d AS d_hi FROM (SELECT unnest([[3, 5], [3, 10], [3, 20], [3, 30], [3, 40], [3, 50], [3, 60], [3, 70], [3, 80], [3, 90], [3, 100]]) AS l), (SELECT unnest([[0::DOUBLE, 1], [0.1, 0.9], [0.2, 0.8], [0.3, 0.7], [0.4, 0.6]]) AS s), (SELECT unnest([30, 60, 90, 120, 180, 365]) AS d)")
def a11(spark, d):
    return tuning.grid(spark)


#: Ranges, measured threads and the result of each range.
GRID_SQL = """, g AS (SELECT l[1] AS l_lo, l[2] AS l_hi, s[1] AS s_lo, s[2] AS s_hi, 0 AS d_lo, d AS d_hi FROM (SELECT unnest([[3, 5], [3, 10], [3, 20], [3, 30], [3, 40], [3, 50], [3, 60], [3, 70], [3, 80], [3, 90], [3, 100]]) AS l), (SELECT unnest([[0::DOUBLE, 1], [0.1, 0.9], [0.2, 0.8], [0.3, 0.7], [0.4, 0.6]]) AS s), (SELECT unnest([30, 60, 90, 120, 180, 365]) AS d)),
m AS (SELECT t.*, c.coherence, CASE WHEN isfinite(v.diversity) THEN v.diversity END AS diversity FROM threads t LEFT JOIN coherence c USING (thread_id) LEFT JOIN diversity v USING (thread_id)),
res AS (SELECT l_lo, l_hi, s_lo, s_hi, d_lo, d_hi, count(*) AS n_threads, round(avg(coherence), 6) AS coherence, count(*) - count(coherence) AS bad_coherence, round(avg(diversity), 6) AS diversity, count(*) - count(diversity) AS bad_diversity FROM m JOIN g ON length BETWEEN l_lo AND l_hi AND span_days BETWEEN d_lo AND d_hi AND NOT isnan(similarity) AND similarity BETWEEN s_lo AND s_hi GROUP BY ALL)"""


@query("a10_grid_search", "threads coherence diversity", GRID_SQL + " SELECT * FROM res")
def a10(spark, d):
    found = tuning.grid_search(_measured(spark, d), tuning.grid(spark))
    return found.select("l_lo", "l_hi", "s_lo", "s_hi", "d_lo", "d_hi", "n_threads", _r("coherence"), "bad_coherence", _r("diversity"), "bad_diversity")


@query("t21_story_sample", "", None)
def t21(spark, d):
    return tuning.sample_stories(articles(spark, d).select("doc_id", "story_id"), 50)


from skein.plans import inventory  # noqa: E402, F401  registers the queries of single operators
