"""Queries over samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import sampling as S
from rasterloom.plans.registry import Registry, table

query = Registry()


@query("ids_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT vec_id FROM embeddings)")
def ids_semi(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return S.in_every_layer([table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), vectors], "doc_id")


@query("ids_by_count", "SELECT doc_id FROM (SELECT doc_id, 'a' AS k FROM documents UNION ALL SELECT doc_id, 'b' FROM labels UNION ALL SELECT vec_id, 'c' FROM embeddings) GROUP BY doc_id HAVING count(DISTINCT k) = 3")
def ids_by_count(spark, sf_dir):
    of = lambda name, key, layer: table(spark, sf_dir, name).select(F.col(key).alias("doc_id"), F.lit(layer).alias("layer"))
    return S.in_all_of(of("documents", "doc_id", "a").union(of("labels", "doc_id", "b")).union(of("embeddings", "vec_id", "c")), "doc_id", "layer", 3)


@query("sample_join", "SELECT d.doc_id, d.lang, l.quality, len(e.embedding)::INTEGER AS dims FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id")
def sample_join(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims"))
    return S.complete_samples(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), vectors, "doc_id")


@query("sample_left", "SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def sample_left(spark, sf_dir):
    return S.with_optional(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("allowlist", "SELECT replace(s_name, '.', '_') AS name, s_suppkey FROM supplier WHERE s_suppkey IN (SELECT ps FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem WHERE l_quantity >= 50))")
def allowlist(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return S.allowed(table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("."), F.lit("_")).alias("name"), "s_suppkey"), names, "s_suppkey")


@query("project_pairs", "SELECT r_regionkey, n_nationkey FROM region, nation WHERE n_regionkey = r_regionkey AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
def project_pairs(spark, sf_dir):
    catalog = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return S.existing_pairs(table(spark, sf_dir, "region"), suppliers, catalog, ["r_regionkey", "n_nationkey"])


@query("resume_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5)")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber >= 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.not_done(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


_PLACES = "n AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{seed}', doc_id::VARCHAR)), doc_id) AS n, count(*) OVER () AS c FROM documents)"


@query("split", f"WITH {_PLACES.format(seed=7)} SELECT doc_id, CASE WHEN n <= ceil(0.2 * c) THEN 'test' ELSE 'train' END AS part FROM n")
def split(spark, sf_dir):
    return S.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.2, 7)


@query("thin_out", f"WITH {_PLACES.format(seed=8)} SELECT doc_id FROM n WHERE n <= floor(c * 0.35)")
def thin_out(spark, sf_dir):
    return S.thin_out(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.35, 8)


@query("sample_n", f"WITH {_PLACES.format(seed=9)} SELECT doc_id FROM n WHERE n <= 100")
def sample_n(spark, sf_dir):
    return S.sample_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 9)


@query("epoch_shuffle", f"WITH {_PLACES.format(seed=5 + 3 * 1_000_003)} SELECT doc_id, n - 1 AS place FROM n")
def epoch_shuffle(spark, sf_dir):
    return S.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 5, 3)


@query("batches", f"WITH {_PLACES.format(seed=11)} SELECT doc_id, ((n - 1) // 32)::BIGINT AS batch FROM n WHERE n <= (c // 32) * 32")
def batches(spark, sf_dir):
    return S.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 32, 11)


@query("worst_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")
def worst_first(spark, sf_dir):
    return S.worst_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50)


@query("worst_first_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def worst_first_desc(spark, sf_dir):
    return S.worst_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 50, True)


@query("best_epoch", "SELECT event_type, arg_min(event_id, struct_pack(a := -value, b := event_id)) AS event_id, max(value) AS value FROM events GROUP BY event_type")
def best_epoch(spark, sf_dir):
    return S.best_by(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "event_id", "value")


@query("nearest_window", "SELECT p_partkey, (SELECT c FROM (VALUES (64, 0), (128, 1), (256, 2), (512, 3), (1024, 4)) t(c, i) ORDER BY abs(p_size * 20 - c), i LIMIT 1) AS win FROM part")
def nearest_window(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.nearest(F.col("p_size") * 20, [64, 128, 256, 512, 1024]).alias("win"))


@query("scale_lookup", "SELECT p_brand, arg_min(p_partkey, p_partkey) AS p_partkey FROM part WHERE CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE 0.25 END = 1.0 GROUP BY p_brand")
def scale_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 4 == 0, 1.0).otherwise(0.25).alias("scale"), F.col("p_partkey").alias("seq"))
    return S.at_scale(rows, "p_brand", "scale", "seq", "p_partkey")
