"""Queries of single operators, sources and runs."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import kernels as K
from skein.operators import clustering, coherence, community, evaluation, features, modularity, resolution, text, threads, tuning
from skein.plans import registry as R
from skein.plans.articles import Settings, articles, entities, table, tokens
from skein.plans.registry import P, query
from skein.session import cut_lineage, shared_folder
from skein.sources import files
from skein.streaming.daily import DailyThreads

_r = R._r


def _folder(spark) -> str:
    """A new folder under the one that executors share."""
    return f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"


# Sources and sinks: each writes a table in a format and reads it again


@query("s1_lines", "", "SELECT trim(n_name) AS line FROM nation")
def s1(spark, d):
    path = _folder(spark)
    files.write_lines(table(spark, d, "nation").withColumn("v", F.concat(F.lit("  "), "n_name", F.lit(" "))), path, "v")
    return files.read_lines(spark, path)


@query("s3_json_lines", "", "SELECT n_nationkey, n_name FROM nation")
def s3(spark, d):
    path = _folder(spark)
    files.write_json_lines(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return files.read_json_lines(spark, path, "n_nationkey int, n_name string")


@query("s4_json_lines_gz", "", "SELECT doc_id, text FROM documents")
def s4(spark, d):
    path = _folder(spark)
    files.write_json_lines(table(spark, d, "documents").select("doc_id", "text"), path, compress=True)
    return files.read_json_lines(spark, path, "doc_id long, text string")


@query("s5_map", "", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def s5(spark, d):
    path = _folder(spark)
    files.write_map(table(spark, d, "nation"), path, "n_nationkey", "n_name")
    return files.read_map_lines(spark, path)


@query("k5_key_values", "", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation")
def k5(spark, d):
    path = _folder(spark)
    files.write_key_values(table(spark, d, "nation"), path, "n_nationkey", "n_name")
    return files.read_key_values(spark, path)


@query("s9_matrix", "", "SELECT vec_id AS doc_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS s FROM embeddings")
def s9(spark, d):
    path = _folder(spark)
    files.write_matrix(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("values")), path)
    return files.read_matrix(spark, path).select("doc_id", F.round(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), 6).alias("s"))


@query("s2_whole_json", "", "SELECT r_regionkey, r_name FROM region")
def s2(spark, d):
    """A file for each region, read as one document each."""
    path, rows = _folder(spark), table(spark, d, "region").select("r_regionkey", "r_name")
    rows.withColumn("p", F.col("r_regionkey")).write.partitionBy("p").json(path)
    return files.read_json(spark, f"{path}/p=*", "r_regionkey int, r_name string")


@query("s10_sparse_matrix", "tok", "SELECT text_id AS doc_id, term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT text_id, unnest(tokens) AS term FROM tok) GROUP BY ALL")
def s10(spark, d):
    path = _folder(spark)
    counts = text.term_counts(tokens(spark, d), "text_id")
    files.write_matrix(counts.select(F.col("text_id").alias("doc_id"), "term", F.col("tf").cast("double").alias("weight")), path)
    return files.read_sparse(spark, path)


@query("s13_articles", "", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS description, text FROM documents")
def s13(spark, d):
    """Texts that are missing or empty, in two of three rows, come from the main text."""
    own = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("text"))
    body = F.to_json(F.struct(F.col("source").alias("title"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("description"), own.alias("text"), F.col("text").alias("maintext")))
    found = files.articles_of(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), body.alias("body")), "doc_id", "body")
    return found.select("doc_id", "title", "description", "text")


@query("k7_thread_sink", "threads", "SELECT thread_id, length, round(similarity, 6) AS similarity FROM threads")
def k7(spark, d):
    path = _folder(spark)
    found = threads.summary(R._ordered(spark, d))
    files.write_threads(found.limit(0), path, "another")
    files.write_threads(found, path, "a3_w0.8")
    return spark.read.parquet(path).where("run = 'a3_w0.8'").select("thread_id", "length", _r("similarity"))


@query("k8_stored_graph", "edges", "SELECT src, dst, round(distance, 6) AS weight FROM edges")
def k8(spark, d):
    """The second reading takes the stored graph: its builder would fail."""
    path = _folder(spark)
    files.stored(spark, path, lambda: R._edges(spark, d).select("src", "dst", "weight"))

    def never():
        raise AssertionError("built again")

    return files.stored(spark, path, never).select("src", "dst", _r("weight"))


# Annotated articles made of the documents' words: a word's type follows from its length

_TYPE = "CASE length(w) % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'O' ELSE 'ORGANIZATION' END"
_RUNS = f"""tk AS (SELECT text_id AS doc_id, w, i, {_TYPE} AS ner FROM (SELECT text_id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS i FROM tok)),
tq AS (SELECT tk.*, q FROM tk, (VALUES ('who'), ('where')) v(q) WHERE ner <> 'O' AND (q = 'who' OR ner = 'LOCATION')),
ti AS (SELECT *, CASE WHEN lag(ner) OVER x = ner AND lag(i) OVER x = i - 1 THEN 0 ELSE 1 END AS f FROM tq WINDOW x AS (PARTITION BY q, doc_id ORDER BY i)),
tr AS (SELECT *, sum(f) OVER (PARTITION BY q, doc_id ORDER BY i) AS run FROM ti),
ents AS (SELECT doc_id, q, string_agg(w, ' ' ORDER BY i) AS entity FROM tr GROUP BY doc_id, q, run)"""


def _annotated(spark, d) -> DataFrame:
    token = lambda w, i: F.to_json(F.struct(F.struct((i + 1).alias("index"), w.alias("word"), F.lit(" ").alias("after"), F.expr(_TYPE.replace("(w)", "(_w)")).alias("ner")).alias("nlpToken")))
    words = tokens(spark, d).select("text_id", F.posexplode("tokens").alias("i", "_w"))
    made = words.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("i", token(F.col("_w"), F.col("i")).alias("j")))).alias("t"))
    parts = F.array(F.concat(F.array(F.lit("NP")), F.col("t.j")))
    return made.select(F.col("text_id").alias("doc_id"), F.create_map(F.lit("who"), parts, F.lit("where"), parts).alias("answers"))


@query("g1_entity_runs", "tok", f", {_RUNS} SELECT doc_id, q, entity, count(*) AS n FROM ents GROUP BY ALL")
def g1(spark, d):
    return resolution.resolve(_annotated(spark, d)).groupBy("doc_id", "q", "entity").agg(F.count("*").alias("n"))


@query("g2_when", "", "SELECT doc_id, CAST(epoch(DATE '2020-01-01' + CAST(doc_id % 900 + i AS INTEGER)) AS BIGINT) AS day FROM documents, (VALUES (0), (2)) v(i) WHERE i <= doc_id % 4")
def g2(spark, d):
    """Dates of one to four tokens in a row: every second one starts an entity."""
    day = lambda i: F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900 + i).cast("int")).cast("string")
    token = lambda i: F.to_json(F.struct(F.struct((i + 5).alias("index"), F.lit("d").alias("word"), F.lit(" ").alias("after"), F.lit("DATE").alias("ner"), F.struct(day(i).alias("value")).alias("timex")).alias("nlpToken")))
    parts = F.array(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int")), token))
    made = table(spark, d, "documents").select("doc_id", F.create_map(F.lit("when"), parts).alias("answers"))
    return resolution.resolve(made, ("when",)).select("doc_id", F.col("entity").cast("double").cast("long").alias("day"))


@query("p16_valid_answers", "tok", f"SELECT text_id AS doc_id, len(list_filter(tokens, lambda w: {_TYPE} <> 'O')) > 0 AS valid FROM tok WHERE len(tokens) > 0")
def p16(spark, d):
    return _annotated(spark, d).select("doc_id", resolution.valid_answer(resolution.answer_tokens(F.col("answers")["who"])).alias("valid"))


# Expressions and filters


def _from_first(spark, d):
    rows = articles(spark, d)
    one = rows.agg(F.min_by("emb", "doc_pos").alias("emb0"), F.min_by("sec", "doc_pos").alias("sec0"), (F.max("sec") - F.min("sec")).alias("span"))
    return rows.crossJoin(F.broadcast(one))  # one row


_FIRST = "z AS (SELECT a.doc_id, list_dot_product(a.emb, f.emb) / sqrt(list_dot_product(a.emb, a.emb) * list_dot_product(f.emb, f.emb)) AS c, exp(-3.0 * abs(a.sec - f.sec) / (SELECT max(sec) - min(sec) FROM a)) AS d FROM a, (SELECT * FROM a WHERE doc_pos = 0) f)"


@query("w2_cosine", "a", f", {_FIRST} SELECT doc_id, round(c, 6) AS cosine FROM z")
def w2(spark, d):
    return _from_first(spark, d).select("doc_id", F.round(K.cosine(F.col("emb"), F.col("emb0")), 6).alias("cosine"))


@query("w5_decayed_distance", "a", f", {_FIRST} SELECT doc_id, round(1 - c * d, 6) AS distance FROM z")
def w5(spark, d):
    decay = K.time_decay(F.col("sec"), F.col("sec0"), F.col("span"), 3.0)
    return _from_first(spark, d).select("doc_id", F.round(1 - K.cosine(F.col("emb"), F.col("emb0")) * decay, 6).alias("distance"))


@query("w6_shared_factor", "shared", "SELECT src, dst, round(0.5 * (1 + (1 - exp(-0.1 * shared / 5.0))), 6) AS factor FROM shared WHERE shared > 0")
def w6(spark, d):
    return R.j4(spark, d).where("shared > 0").select("src", "dst", F.round(K.shared_factor(F.col("shared"), 0.1, 5), 6).alias("factor"))


@query("w7_path_factor", "paths", "SELECT src, dst, round(0.5 * exp(-0.1 * (coalesce(edges, 10) / 2.0) / 5.0), 6) AS factor FROM paths WHERE shared = 0")
def w7(spark, d):
    return R.j5(spark, d).select("src", "dst", F.round(K.path_factor(F.col("edges"), 0.1, 5), 6).alias("factor"))


@query("w11_entity_affinity", "paths", "SELECT src, dst, round((1 - distance) * CASE WHEN shared > 0 THEN 0.5 * (1 + (1 - exp(-0.1 * shared / 5.0))) ELSE 0.5 * exp(-0.1 * (coalesce(edges, 10) / 2.0) / 5.0) END, 6) AS similarity FROM paths")
def w11(spark, d):
    """Similarity with decay and entities, of the pairs that clustering takes."""
    found = clustering.affinities(articles(spark, d), R.WITH_ENTITIES, entities(spark, d))
    return found.select("src", "dst", F.round(1 - F.col("weight"), 6).alias("similarity"))


@query("p2_gather", "", "SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id)")
def p2(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("p13_min_length", "members", "SELECT thread_id, count(*) AS n FROM members GROUP BY thread_id HAVING count(*) >= 3")
def p13(spark, d):
    return R._members(spark, d).groupBy("thread_id").agg(F.count("*").alias("n")).where("n >= 3")


@query("p15_edge_clamp", "edges", "SELECT src, dst, round(greatest(distance - 0.7, 0), 6) AS weight FROM edges")
def p15(spark, d):
    return R._edges(spark, d).select("src", "dst", F.round(F.greatest(F.col("distance") - 0.7, F.lit(0.0)), 6).alias("weight"))


# Graphs


@query("g12_numeric_threshold", "roots", """, pw AS (SELECT p.node, p.parent, round(p.weight, 12) AS weight, r.root FROM parents p JOIN roots r ON r.node = p.node), lim AS (SELECT root, round(quantile_cont(weight, 0.7), 12) AS cut FROM pw GROUP BY root), deg AS (SELECT parent, count(*) AS children FROM parents GROUP BY parent)
SELECT pw.node, pw.parent FROM pw JOIN lim USING (root) LEFT JOIN deg ON deg.parent = pw.node WHERE NOT (pw.weight > lim.cut AND coalesce(deg.children, 0) > 1)""")
def g12(spark, d):
    return community.prune(R._edges(spark, d, forest=True), dataclasses.replace(P, th=70.0))[1].select("node", "parent")


@query("g17_modularity", "", None)
def g17(spark, d):
    return modularity.modularity_communities(R._edges(spark, d))


@query("g17_leiden", "", None)
def g17_leiden(spark, d):
    return modularity.modularity_communities(R._edges(spark, d), method="leiden")


@query("g18_induced_edges", "edges", "SELECT src, dst FROM edges WHERE src IN (SELECT doc_id FROM a WHERE story_id < 5) AND dst IN (SELECT doc_id FROM a WHERE story_id < 5)")
def g18(spark, d):
    nodes = articles(spark, d).where("story_id < 5").select(F.col("doc_id").alias("node"))
    return community.induced(R._edges(spark, d).select("src", "dst"), nodes)


@query("j11_compose", "edges", "SELECT src, dst, round(CASE WHEN src % 2 = 0 THEN distance / 2 ELSE distance END, 6) AS weight FROM edges")
def j11(spark, d):
    edges = cut_lineage(R._edges(spark, d).select("src", "dst", "weight"))
    newer = edges.where("src % 2 = 0").withColumn("weight", F.col("weight") / 2)
    return community.compose([edges, newer]).select("src", "dst", _r("weight"))


# Order and aggregates


@query("o5_thread_span", "threads", "SELECT thread_id, round(span_days, 6) AS span_days FROM threads")
def o5(spark, d):
    return threads.summary(R._ordered(spark, d)).select("thread_id", _r("span_days"))


@query("o7_threads_by_keywords", "keywords", "SELECT thread_id, CAST(row_number() OVER (ORDER BY w DESC, thread_id) AS BIGINT) AS place FROM (SELECT thread_id, round(sum(score) / 3, 9) AS w FROM keywords GROUP BY thread_id)")
def o7(spark, d):
    frame = text.keywords(R._members(spark, d), tokens(spark, d)).groupBy("thread_id").agg((-F.round(F.sum("score") / 3, 9)).alias("w"))
    return R.with_positions(frame, "w", "thread_id").select("thread_id", (F.col("doc_pos") + 1).alias("place"))


@query("o9_stories", "a", "SELECT story_id, count(*) AS n FROM a GROUP BY story_id HAVING count(*) > 2")
def o9(spark, d):
    return articles(spark, d).groupBy("story_id").agg(F.count("*").alias("n")).where("n > 2")


@query("a8_mean_cosine", "threads", "SELECT round(avg(similarity), 6) AS cos FROM threads WHERE length BETWEEN 2 AND 100 AND span_days BETWEEN 0 AND 120 AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1")
def a8(spark, d):
    return threads.select(threads.summary(R._ordered(spark, d)), P).agg(F.round(F.avg("similarity"), 6).alias("cos"))


@query("a14_mean_tfidf", "members tfidf", ", sz AS (SELECT thread_id, count(*) AS docs FROM members GROUP BY thread_id) SELECT m.thread_id, t.term, round(sum(t.tfidf) / any_value(sz.docs), 6) AS mean, count(*) AS df FROM members m JOIN a USING (doc_id) JOIN tfidf t USING (text_id) JOIN sz ON sz.thread_id = m.thread_id GROUP BY m.thread_id, t.term")
def a14(spark, d):
    rows = text.thread_terms(R._members(spark, d), *text.fitted(tokens(spark, d), "text_id"))
    return rows.select("thread_id", "term", F.round(F.col("s") / F.col("docs"), 6).alias("mean"), "df")


# Text and features


@query("t3_strip_accents", "", r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS text FROM documents")
def t3(spark, d):
    return table(spark, d, "documents").select("doc_id", features.strip_accents("text").alias("text"))


@query("t19_tokenisers", "", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '([0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\x0b\f\r])'), ' ') AS words, len(string_split(text, ' ')) AS by_space FROM documents")
def t19(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(features.words(F.col("text")), " ").alias("words"), F.size(features.words_by_space(F.col("text"))).cast("long").alias("by_space"))


@query("t4_latent_vectors", "", None)
def t4(spark, d):
    weights = cut_lineage(text.tfidf(tokens(spark, d), "text_id"))
    return features.lsa(weights, features.fit_lsa(weights, "text_id"), "text_id")


@query("o8_best_range", "threads coherence diversity", R.GRID_SQL + " SELECT * FROM res ORDER BY diversity DESC NULLS LAST, coherence DESC NULLS LAST, l_lo, l_hi, s_lo, s_hi, d_lo, d_hi LIMIT 1")
def o8(spark, d):
    return tuning.best_range(R.a10(spark, d))


@query("t15_coherence", "coherence", "SELECT thread_id, round(coherence, 6) AS coherence FROM coherence")
def t15(spark, d):
    members, docs = cut_lineage(R._members(spark, d)), tokens(spark, d)
    words = cut_lineage(text.keywords(members, docs))
    texts = text.member_tokens(members, docs).select("doc_id", "tokens")
    return coherence.coherence(words, texts).select("thread_id", _r("coherence"))


@query("t16_bag_of_words", "tok", "SELECT text_id, term, count(*) AS tf FROM (SELECT text_id, unnest(tokens) AS term FROM tok) GROUP BY ALL")
def t16(spark, d):
    return text.term_counts(tokens(spark, d), "text_id")


def _clusters(spark, d, p=P):
    rows = articles(spark, d)
    return clustering.agglomerative(rows, p, rows.groupBy("part_id").agg(F.count_distinct("story_id").alias("k")), entities(spark, d) if p.ent else None)


@query("t17_clusters", "", None)
def t17(spark, d):
    return _clusters(spark, d)


@query("t17_clusters_ward", "", None)
def t17_ward(spark, d):
    return _clusters(spark, d, Settings(td=False))


@query("d2_clustering_run", "", None)
def d2(spark, d):
    return threads.summary(threads.ordered(clustering.label_threads(_clusters(spark, d)), articles(spark, d)))


# Runs


def _history(sql: str) -> str:
    """The oracle of a history run: a fixed span of 120 days and documents of the first 20 days."""
    return sql.replace("exp(-3.0 * abs(s.sec - t.sec) / (SELECT max(sec) - min(sec) FROM a))", "exp(-3.0 * abs(s.sec - t.sec) / 10368000.0)").replace("WHERE distance < 0.8", "WHERE distance < 0.8 AND dst_pos < (SELECT count(*) FROM a WHERE ts < (SELECT CAST(min(ts) AS DATE) FROM a) + INTERVAL 20 DAY)")


@query("d3_history_run", "", _history(R._with("members", "SELECT doc_id AS node, thread_id FROM members")))
def d3(spark, d):
    rows = articles(spark, d)
    low = rows.agg(F.to_date(F.min("ts"))).first()[0]
    daily = DailyThreads(_folder(spark), P)
    daily.run(rows.where(F.col("ts") < F.date_add(F.lit(low), 20).cast("timestamp")), history_days=20, evaluate=False)
    return daily.members(spark)


@query("d4_incremental_run", "", None)
def d4(spark, d):
    daily = DailyThreads(_folder(spark), P)
    daily.run(cut_lineage(articles(spark, d)), history_days=20, step_days=5, evaluate=False)
    return threads.summary(daily.ordered(spark))


@query("d5_evaluation_log", "", None)
def d5(spark, d):
    daily = DailyThreads(_folder(spark), P)
    daily.run(cut_lineage(articles(spark, d)), history_days=20, step_days=10)
    return files.read_json_lines(spark, f"{daily.path}/metrics")


@query("d7_validation_run", "threads coherence diversity", "SELECT t.thread_id, length, round(similarity, 6) AS similarity, round(coherence, 6) AS coherence, round(diversity, 6) AS diversity FROM threads t LEFT JOIN coherence USING (thread_id) LEFT JOIN diversity USING (thread_id)")
def d7(spark, d):
    return R._measured(spark, d).select("thread_id", "length", _r("similarity"), _r("coherence"), _r("diversity"))


@query("d1_evaluation", "threads members", """, c0 AS (SELECT * FROM threads WHERE length BETWEEN 2 AND 100 AND span_days BETWEEN 0 AND 120 AND NOT isnan(similarity) AND similarity BETWEEN -1 AND 1), sd AS (SELECT m.doc_id, m.thread_id, a.story_id FROM members m JOIN a USING (doc_id) WHERE m.thread_id IN (SELECT thread_id FROM c0))
SELECT (SELECT count(*) FROM sd) AS sel_docs, (SELECT count(DISTINCT thread_id) FROM sd) AS sel_pred, (SELECT count(DISTINCT story_id) FROM sd) AS sel_true, (SELECT count(*) FROM a) AS all_docs, (SELECT count(DISTINCT story_id) FROM a) AS all_true, (SELECT round(avg(length), 6) FROM c0) AS mean_pred, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM sd GROUP BY story_id)) AS mean_true""")
def d1_evaluation(spark, d):
    found = evaluation.evaluate(R._ordered(spark, d), articles(spark, d), P)
    return found.select("sel_docs", "sel_pred", "sel_true", "all_docs", "all_true", _r("mean_pred"), _r("mean_true"))
