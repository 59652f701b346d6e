"""Queries over the test tables, one or more for each operator, and the same in SQL where SQL can express it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S
from ..operators import cliques, degree, metrics, orient, patterns, peel, prepare, relabel, sequential, triangles
from ..sources import edge_files, tables
from .storage import fresh_path, global_rank, materialize

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

RAW = {
    "ps": "raw AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)",
    "co": "raw AS (SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)",
}
CTE = {
    "e": "e AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM raw WHERE src <> dst)",
    "vv": "vv AS (SELECT unnest(range(CAST((SELECT max(greatest(src, dst)) + 1 FROM e) AS BIGINT))) AS v)",
    "d": "d AS (SELECT v, count(*) AS deg FROM (SELECT src AS v FROM e UNION ALL SELECT dst FROM e) GROUP BY v)",
    "da": "da AS MATERIALIZED (SELECT vv.v, coalesce(deg, 0) AS deg FROM vv LEFT JOIN d USING (v))",
    "o": "o AS MATERIALIZED (SELECT CASE WHEN a.deg < b.deg OR (a.deg = b.deg AND e.src < e.dst) THEN e.src ELSE e.dst END AS src, CASE WHEN a.deg < b.deg OR (a.deg = b.deg AND e.src < e.dst) THEN e.dst ELSE e.src END AS dst FROM e JOIN d a ON a.v = e.src JOIN d b ON b.v = e.dst)",
    "ol": "ol AS (SELECT CASE WHEN a.deg < b.deg OR (a.deg = b.deg AND e.src > e.dst) THEN e.src ELSE e.dst END AS src, CASE WHEN a.deg < b.deg OR (a.deg = b.deg AND e.src > e.dst) THEN e.dst ELSE e.src END AS dst FROM e JOIN d a ON a.v = e.src JOIN d b ON b.v = e.dst)",
    "od": "od AS (SELECT vv.v, coalesce(c, 0) AS out_deg FROM vv LEFT JOIN (SELECT src AS v, count(*) AS c FROM o GROUP BY src) USING (v))",
    "io": "io AS (SELECT vv.v, coalesce(a.c, 0) AS out_deg, coalesce(b.c, 0) AS in_deg FROM vv LEFT JOIN (SELECT src AS v, count(*) AS c FROM e GROUP BY 1) a USING (v) LEFT JOIN (SELECT dst AS v, count(*) AS c FROM e GROUP BY 1) b USING (v))",
    "sy": "sy AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)",
    "lb": "lb AS (SELECT p_partkey AS v, CAST(p_size % 3 AS INTEGER) AS label FROM part)",
    "s": "s AS (SELECT DISTINCT l_suppkey AS set_id, l_partkey AS elem FROM lineitem)",
    "pr": "pr AS (SELECT x.set_id AS a, y.set_id AS b FROM (SELECT DISTINCT set_id FROM s) x JOIN (SELECT DISTINCT set_id FROM s) y ON y.set_id = x.set_id + 1)",
    "pk": "pk AS (SELECT set_id, elem // 32 AS base, bit_or(1::BIGINT << CAST(elem % 32 AS INTEGER)) AS state FROM s GROUP BY 1, 2)",
}


def sql(body: str, *ctes: str, graph: str | None = "ps") -> str:
    parts = ([RAW[graph], CTE["e"]] if graph else []) + [CTE[c] for c in ctes]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return put


def _ps(spark, d) -> DataFrame:
    return prepare.canonical_edges(tables.partsupp_raw(spark, d))


def _co(spark, d) -> DataFrame:
    return prepare.canonical_table(tables.copart_raw(spark, d))


def _text(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


# sources and sinks: what was written is read back

def _binary(order):
    def run(spark, d):
        path = fresh_path(spark, "edges") + ".bin"
        edge_files.write_binary_edges(_ps(spark, d), path, order)
        return edge_files.read_binary_edges(spark, path, order)

    return run


query("io_binary_src_first", sql("SELECT src, dst FROM e"))(_binary("src_first"))
query("io_binary_hi_first", sql("SELECT src, dst FROM e"))(_binary("hi_first"))


@query("io_text_edges", sql("SELECT src, dst FROM e"))
def _(spark, d):
    path = fresh_path(spark, "text")
    edge_files.write_text_edges(_ps(spark, d), path)
    return edge_files.read_text_edges(spark, path)


@query("io_text_to_binary_to_text", sql("SELECT src, dst FROM e"))
def _(spark, d):
    a, b, c = (fresh_path(spark, "conv") for _ in range(3))
    edge_files.write_text_edges(_ps(spark, d), a)
    edge_files.text_to_binary(spark, a, b)
    edge_files.binary_to_text(spark, b, c)
    return edge_files.read_text_edges(spark, c)


@query("io_id_map", sql("SELECT v AS old_id, row_number() OVER (ORDER BY v) - 1 AS new_id FROM d", "d"))
def _(spark, d):
    path = fresh_path(spark, "map")
    edge_files.write_id_map(relabel.compact_ids(_ps(spark, d)), path)
    return edge_files.read_id_map(spark, path)


def _random_sets(spark):
    return edge_files.random_set_pair(spark, 2000, 2.0, 0.1, 0.05, 3)


query("io_random_sets_sizes", "SELECT * FROM (VALUES ('a', 2000::BIGINT), ('b', 1000::BIGINT)) t(set_id, n)")(lambda s, d: _random_sets(s).groupBy("set_id").agg(F.count("*").alias("n")))


@query("io_random_sets_shape", "SELECT 2800::BIGINT AS members, 200::BIGINT AS in_both, 2800::BIGINT AS strata, true AS in_range")
def _(spark, d):
    """2800 different numbers, one in each of as many strata of 20 (a density of 0.05), 200 of them in both sets."""
    each = _random_sets(spark).groupBy("elem").agg(F.count("*").alias("sets"))
    return each.agg(F.count("*").alias("members"), F.sum((F.col("sets") == 2).cast("long")).alias("in_both"), F.count_distinct(F.floor(F.col("elem") / 20)).alias("strata"), ((F.min("elem") >= 0) & (F.max("elem") < 56_000)).alias("in_range"))


@query("gen_power_law", "SELECT i AS src, CAST('0x' || substr(md5(i || '-' || j || '-5'), 1, 8) AS BIGINT) % 1000 AS dst FROM range(1000) t(i), LATERAL (SELECT unnest(range(1, CAST(floor(500.0 * pow(i + 1, -1.1)) AS BIGINT) + 1)) AS j) k")
def _(spark, d):
    return edge_files.power_law_edges(spark, 1000, 1.1, 500.0, 5)


# preparation

query("canonical_edges", sql("SELECT src, dst FROM e"))(_ps)
query("canonical_edges_copart", sql("SELECT src, dst FROM e", graph="co"))(_co)
query("vertex_count", sql("SELECT max(greatest(src, dst)) + 1 AS n FROM e"))(lambda s, d: prepare.vertex_count(_ps(s, d)))
query("drop_loops", sql("SELECT src, dst, count(*) AS n FROM raw WHERE src <> dst GROUP BY 1, 2"))(lambda s, d: prepare.drop_loops(tables.partsupp_raw(s, d)).groupBy("src", "dst").agg(F.count("*").alias("n")))
query("symmetric_edges", sql("SELECT src, dst FROM sy", "sy"))(lambda s, d: prepare.symmetrize(_ps(s, d)))
query("upper_triangle", sql("SELECT src, dst FROM sy WHERE src < dst", "sy"))(lambda s, d: prepare.upper(prepare.symmetrize(_ps(s, d))))
query("lower_triangle", sql("SELECT src, dst FROM sy WHERE src > dst", "sy"))(lambda s, d: prepare.lower(prepare.symmetrize(_ps(s, d))))
query("nonempty_vertices", sql("SELECT DISTINCT src AS v FROM e"))(lambda s, d: prepare.nonempty(_ps(s, d)))
query("csr_offsets", sql("SELECT v, out_deg AS deg, CAST(coalesce(sum(out_deg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM od", "vv", "d", "o", "od"))(lambda s, d: degree.csr_offsets(triangles.directed(_ps(s, d))))
query("adjacency", sql("SELECT src AS v, string_agg(dst, ' ' ORDER BY dst) AS nbrs, count(*) AS deg FROM e GROUP BY src"))(lambda s, d: prepare.adjacency(_ps(s, d)).select("v", _text("nbrs").alias("nbrs"), "deg"))
query("adjacency_explode", sql("SELECT src, dst FROM e"))(lambda s, d: prepare.adjacency_edges(prepare.adjacency(_ps(s, d))))
query("edge_rank", sql("SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS rank FROM e"))(lambda s, d: global_rank(_ps(s, d), "src", "dst"))
query("partition_split", sql("SELECT src, dst, src % 2 = 0 AS side FROM e"))(lambda s, d: (lambda ab: ab[0].withColumn("side", F.lit(True)).unionByName(ab[1].withColumn("side", F.lit(False))))(prepare.split_by(_ps(s, d), F.col("src") % 2 == 0)))
query("packed_adjacency", sql("SELECT src AS set_id, dst // 32 AS base, bit_or(1::BIGINT << CAST(dst % 32 AS INTEGER)) AS state FROM e GROUP BY 1, 2"))(lambda s, d: prepare.pack(_ps(s, d)))
query("in_out_index", sql("SELECT coalesce(a.v, b.v) AS v, coalesce(outs, '') AS outs, coalesce(ins, '') AS ins FROM (SELECT src AS v, string_agg(dst, ' ' ORDER BY dst) AS outs FROM e GROUP BY 1) a FULL JOIN (SELECT dst AS v, string_agg(src, ' ' ORDER BY src) AS ins FROM e GROUP BY 1) b ON a.v = b.v"))(lambda s, d: prepare.in_out_index(_ps(s, d)).select("v", _text("outs").alias("outs"), _text("ins").alias("ins")))
query("prune_low_degree", sql("SELECT src, dst FROM e WHERE src IN (SELECT v FROM d WHERE deg >= 2) AND dst IN (SELECT v FROM d WHERE deg >= 2)", "d", graph="co"))(lambda s, d: (lambda e: prepare.prune_low_degree(e, degree.degrees(e)))(_co(s, d)))
query("label_index", "WITH " + CTE["lb"] + " SELECT label, count(*) AS n, string_agg(v, ' ' ORDER BY v) AS members FROM lb GROUP BY label")(lambda s, d: prepare.label_index(tables.part_labels(s, d)).select("label", "n", _text("members").alias("members")))

# aggregates

query("degrees", sql("SELECT v, deg FROM d", "d"))(lambda s, d: degree.degrees(_ps(s, d)))
query("raw_degrees", "WITH " + RAW["ps"] + " SELECT v, count(*) AS deg FROM (SELECT src AS v FROM raw UNION ALL SELECT dst FROM raw) GROUP BY v")(lambda s, d: degree.degrees(tables.partsupp_raw(s, d)))
query("out_degrees", sql("SELECT v, out_deg FROM od", "vv", "d", "o", "od"))(lambda s, d: degree.out_degrees_all(triangles.directed(_ps(s, d))))
query("max_degree", sql("SELECT max(deg) AS max_deg FROM d", "d"))(lambda s, d: degree.max_degree(_ps(s, d)))
query("degree_histogram", sql("SELECT deg, count(*) AS n FROM da GROUP BY deg", "vv", "d", "da", graph="co"))(lambda s, d: degree.degree_histogram(_co(s, d)))
query("in_out_degrees", sql("SELECT v, out_deg, in_deg FROM io", "vv", "io"))(lambda s, d: degree.in_out_degrees(_ps(s, d)))
query("leaf_ratio", sql("SELECT CAST(sum(CASE WHEN out_deg = 1 OR in_deg = 1 THEN 1 ELSE 0 END) AS BIGINT) AS leaves, count(*) AS n, round(sum(CASE WHEN out_deg = 1 OR in_deg = 1 THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM io", "vv", "io", graph="co"))(lambda s, d: degree.leaf_ratio(_co(s, d)))
_BIG = "b AS (SELECT v, deg, coalesce(sum(deg) OVER (ORDER BY deg DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM da), big AS (SELECT v, deg FROM b WHERE before < (SELECT floor(count(*) * 0.1 * 2) FROM e))"
query("big_vertices", sql("SELECT v, deg FROM big", "vv", "d", "da").replace(" SELECT v, deg FROM big", ", " + _BIG + " SELECT v, deg FROM big"))(lambda s, d: degree.big_vertices(_ps(s, d), 0.1))
query("big_vertex_report", sql("SELECT v, deg FROM big", "vv", "d", "da").replace(" SELECT v, deg FROM big", ", " + _BIG + " SELECT count(*) AS n, round(avg(deg), 6) AS mean_deg, round(var_pop(deg), 6) AS var_deg, max(deg) AS max_deg, min(deg) AS min_deg FROM big"))(lambda s, d: degree.big_vertex_report(_ps(s, d), 0.1))
query("label_frequency", "WITH " + CTE["lb"] + " SELECT label, count(*) AS n FROM lb GROUP BY label")(lambda s, d: degree.label_frequency(tables.part_labels(s, d)))

# directions

query("direct_by_id", sql("SELECT dst AS src, src AS dst FROM e"))(lambda s, d: orient.by_id(_ps(s, d)))
query("direct_by_degree", sql("SELECT src, dst FROM o", "d", "o"))(lambda s, d: orient.by_degree(_ps(s, d)))
query("direct_by_degree_larger_tie", sql("SELECT src, dst FROM ol", "d", "ol"))(lambda s, d: orient.by_degree(_ps(s, d), "larger_id_first"))
_RANKED = "r AS (SELECT v, row_number() OVER (ORDER BY deg DESC, v DESC) - 1 AS nv FROM da)"
query("degree_relabel_edges", sql("X", "vv", "d", "da").replace(" X", ", " + _RANKED + " SELECT a.nv AS src, b.nv AS dst FROM e JOIN r a ON a.v = e.src JOIN r b ON b.v = e.dst"))(lambda s, d: (lambda e: relabel.apply(e, relabel.degree_relabel(e)))(_ps(s, d)))
query("degree_relabel_direct", sql("X", "vv", "d", "da").replace(" X", ", " + _RANKED + " SELECT greatest(a.nv, b.nv) AS src, least(a.nv, b.nv) AS dst FROM e JOIN r a ON a.v = e.src JOIN r b ON b.v = e.dst"))(lambda s, d: relabel.degree_relabel_orient(_ps(s, d)))


def _state_sql(state: str, body: str, *ctes: str, graph: str = "co") -> str:
    """A recursive query whose rows of the last step are the result's."""
    return sql("X", *ctes, graph=graph).replace("WITH ", "WITH RECURSIVE ", 1).replace(" X", f", {state} {body}")


#: peeling waves: the wave before lowers its neighbours; an empty wave raises the threshold
_PEEL = """p(step, v, res, prio, thr, cur, fresh) AS (
    SELECT 0, v, deg, CASE WHEN deg <= t THEN 0 END, t, 1, deg <= t FROM da, (SELECT count(*) / (SELECT count(*) FROM vv) + 0.5 AS t FROM e)
    UNION ALL
    SELECT step + 1, v, res2, CASE WHEN prio IS NULL AND res2 <= thr2 THEN cur ELSE prio END, thr2, cur + 1, prio IS NULL AND res2 <= thr2
    FROM (
        SELECT p.*, CASE WHEN prio IS NULL THEN res - coalesce(loss, 0) ELSE res END AS res2, thr + CASE WHEN waved THEN 0 ELSE grow END AS thr2
        FROM p LEFT JOIN (SELECT sy.dst AS v, count(*) AS loss FROM sy JOIN p q ON q.v = sy.src AND q.fresh GROUP BY 1) l USING (v),
             (SELECT bool_or(fresh) AS waved, bool_or(prio IS NULL) AS more FROM p), (SELECT greatest(0.5, floor(2 * count(*) / (SELECT count(*) FROM vv) + 1) / 2) AS grow FROM e)
        WHERE more
    )
), pp AS (SELECT v, prio, res FROM p WHERE step = (SELECT max(step) FROM p))"""
_PEEL_CTES = ("vv", "d", "da", "sy")
#: a scan or a wave a step; what waits is told at the next threshold
_TRUNCATED = """p(step, v, res, prio, told, thr, cur, wave) AS (
    SELECT 0, v, deg, CASE WHEN deg <= t THEN 0 END, false, t, 1, 0 FROM da, (SELECT 2 * count(*) / (SELECT count(*) FROM vv) AS t FROM e)
    UNION ALL
    SELECT step + 1, v, res2, CASE WHEN prio IS NULL AND res2 <= thr2 THEN cur ELSE prio END, told OR (waves AND prio IS NOT NULL), thr2, cur + 1, CASE WHEN waves THEN wave + 1 ELSE 0 END
    FROM (
        SELECT p.*, waves, CASE WHEN waves AND prio IS NULL THEN res - coalesce(loss, 0) ELSE res END AS res2, thr + CASE WHEN waves THEN 0 ELSE grow END AS thr2
        FROM p LEFT JOIN (SELECT sy.dst AS v, count(*) AS loss FROM sy JOIN p q ON q.v = sy.src AND q.prio IS NOT NULL AND NOT q.told GROUP BY 1) l USING (v),
             (SELECT sum(CASE WHEN prio IS NOT NULL AND NOT told THEN 1 ELSE 0 END) > greatest(200, count(*) // 5000) AND max(wave) < 6 AS waves, bool_or(prio IS NULL) AS more FROM p),
             (SELECT greatest(0.5, floor(2 * count(*) / (SELECT count(*) FROM vv))) AS grow FROM e)
        WHERE more
    )
), pp AS (SELECT v, prio, res FROM p WHERE step = (SELECT max(step) FROM p))"""
#: frontiers whose thresholds deepen when they are small
_DEPTH = """p(step, v, res, prio, deg, depth, seen) AS (
    SELECT 0, v, deg, CAST(NULL AS INTEGER), deg, 1, 0 FROM da
    UNION ALL
    SELECT step, v, res - CASE WHEN prio IS NULL THEN coalesce(loss, 0) ELSE 0 END, prio, deg, depth, seen
    FROM (
        SELECT *, seen0 + sum(CASE WHEN prio = step THEN 1 ELSE 0 END) OVER () AS seen, depth0 + CASE WHEN sum(CASE WHEN prio = step THEN 1 ELSE 0 END) OVER () <= n / 500 THEN 1 ELSE 0 END AS depth
        FROM (SELECT step + 1 AS step, v, res, CASE WHEN prio IS NULL AND res <= t * deeper THEN step + 1 ELSE prio END AS prio, deg, deeper AS depth0, seen AS seen0, n FROM p, (@MORE@))
    ) LEFT JOIN (SELECT sy.dst AS v, count(*) AS loss FROM sy JOIN (SELECT v FROM p, (@MORE@) WHERE prio IS NULL AND res <= t * deeper) q ON q.v = sy.src GROUP BY 1) l USING (v)
), dp AS (SELECT v, coalesce(prio, 4294967295) AS major, CASE WHEN prio IS NULL THEN deg ELSE res END AS minor FROM p WHERE step = (SELECT max(step) FROM p))""".replace(
    "@MORE@",
    """SELECT greatest(any_value(depth), CASE WHEN any_value(t) > 0 THEN ceil(min(CASE WHEN prio IS NULL THEN res END) / any_value(t)) ELSE 0 END) AS deeper, any_value(t) AS t, count(*) AS n
            FROM p, (SELECT count(*) // (SELECT count(*) FROM vv) AS t FROM e)
            HAVING any_value(seen) < 0.9 * count(*) AND max(step) < 50 AND bool_or(prio IS NULL) AND NOT (min(CASE WHEN prio IS NULL THEN res END) > 0 AND any_value(t) = 0)
               AND greatest(any_value(depth), CASE WHEN any_value(t) > 0 THEN ceil(min(CASE WHEN prio IS NULL THEN res END) / any_value(t)) ELSE 0 END) <= 255""",
)
#: h-indexes of neighbours' numbers, from degrees down until none moves
_CORES = """h(step, v, c, moved) AS (
    SELECT 0, v, deg, true FROM da
    UNION ALL
    SELECT step + 1, v, c2, bool_or(c2 <> c) OVER ()
    FROM (
        SELECT h.step, h.v, h.c, coalesce(x.c2, 0) AS c2
        FROM h LEFT JOIN (
            SELECT src, max(CASE WHEN c >= r THEN r ELSE 0 END) AS c2
            FROM (SELECT sy.src, n.c, row_number() OVER (PARTITION BY sy.src ORDER BY n.c DESC) AS r FROM sy JOIN h n ON n.v = sy.dst) GROUP BY src
        ) x ON x.src = h.v
        WHERE h.moved
    )
), cores AS (SELECT v, c AS core FROM h WHERE step = (SELECT max(step) FROM h))"""


def _directed_sql(table: str, *cols: str) -> str:
    less = f"({', '.join(f'a.{c}' for c in cols)}) < ({', '.join(f'b.{c}' for c in cols)})"
    return f"SELECT CASE WHEN {less} THEN e.src ELSE e.dst END AS src, CASE WHEN {less} THEN e.dst ELSE e.src END AS dst FROM e JOIN {table} a ON a.v = e.src JOIN {table} b ON b.v = e.dst"


query("direct_by_peeling", _state_sql(_PEEL, _directed_sql("pp", "prio", "v"), *_PEEL_CTES))(lambda s, d: peel.peel_direction(_co(s, d)))
query("peel_priority", _state_sql(_PEEL, "SELECT v, prio AS priority, res AS residual FROM pp", *_PEEL_CTES))(lambda s, d: peel.peel_priority(_co(s, d)))
query("peel_priority_truncated", _state_sql(_TRUNCATED, "SELECT v, prio AS priority, res AS residual FROM pp", *_PEEL_CTES))(lambda s, d: peel.truncated_priority(_co(s, d)))
query("direct_by_depth", _state_sql(_DEPTH, _directed_sql("dp", "major", "minor", "v"), *_PEEL_CTES))(lambda s, d: peel.depth_direction(_co(s, d)))
query("peel_relabel", _state_sql(_PEEL + ", r AS (SELECT v, row_number() OVER (ORDER BY prio DESC, res DESC, v DESC) - 1 AS nv FROM pp)", "SELECT a.nv AS src, b.nv AS dst FROM sy JOIN r a ON a.v = sy.src JOIN r b ON b.v = sy.dst", *_PEEL_CTES))(lambda s, d: peel.peel_relabel(_co(s, d)))
query("core_numbers", _state_sql(_CORES, "SELECT v, core FROM cores", *_PEEL_CTES))(lambda s, d: peel.core_numbers(_co(s, d), rounds=False).select("v", "core"))
query("direct_by_core", _state_sql(_CORES, _directed_sql("cores", "core", "v"), *_PEEL_CTES))(lambda s, d: peel.core_direction(_co(s, d)))
query("degeneracy", _state_sql(_CORES, "SELECT max(core) AS degeneracy FROM cores", *_PEEL_CTES))(lambda s, d: peel.degeneracy(peel.core_numbers(_co(s, d), rounds=False)))

# orders

_OD = "r AS (SELECT v, row_number() OVER (ORDER BY out_deg DESC, v DESC) - 1 AS rk, count(*) OVER () AS n FROM od)"
query("order_out_degree", sql("X", "vv", "d", "o", "od").replace(" X", ", " + _OD + " SELECT v AS old_id, rk AS new_id FROM r"))(lambda s, d: relabel.out_degree_descending(triangles.directed(_ps(s, d))))
query("order_dealt", sql("X", "vv", "d", "o", "od").replace(" X", ", " + _OD + " SELECT v AS old_id, CASE WHEN rk < 40 * (n // 40) THEN (rk % (n // 40)) * 40 + rk // (n // 40) ELSE rk END AS new_id FROM r"))(lambda s, d: relabel.dealt_order(triangles.directed(_ps(s, d))))
query("order_snake", sql("X", "vv", "d", "o", "od").replace(" X", ", " + _OD + " SELECT v AS old_id, CASE WHEN rk < 64 * (n // 64) THEN (CASE WHEN (rk // (n // 64)) % 2 = 1 THEN (n // 64) - 1 - rk % (n // 64) ELSE rk % (n // 64) END) * 64 + rk // (n // 64) ELSE rk END AS new_id FROM r"))(lambda s, d: relabel.snake_order(triangles.directed(_ps(s, d))))
query("order_snake_directed", sql("X", "vv").replace(" X", ", od AS (SELECT vv.v, coalesce(c, 0) AS out_deg FROM vv LEFT JOIN (SELECT src AS v, count(*) AS c FROM e GROUP BY src) USING (v)), " + _OD + " SELECT v AS old_id, CASE WHEN rk < 40 * (n // 40) THEN (CASE WHEN (rk // (n // 40)) % 2 = 1 THEN (n // 40) - 1 - rk % (n // 40) ELSE rk % (n // 40) END) * 40 + rk // (n // 40) ELSE rk END AS new_id FROM r"))(lambda s, d: relabel.snake_order(_ps(s, d), 40))
query("order_snake_shuffled", sql("X", "vv", "d", "o", "od").replace(" X", ", " + _OD + ", q AS (SELECT v, CASE WHEN rk < 64 * (n // 64) THEN CASE WHEN (rk // (n // 64)) % 2 = 1 THEN (n // 64) - 1 - rk % (n // 64) ELSE rk % (n // 64) END ELSE -1 - rk END AS g, rk FROM r) SELECT v AS old_id, CASE WHEN g >= 0 THEN g * 64 + row_number() OVER (PARTITION BY g ORDER BY md5(v || '-7'), v) - 1 ELSE rk END AS new_id FROM q"))(lambda s, d: relabel.snake_order(triangles.directed(_ps(s, d)), 64, seed=7))
query("order_degree_ascending", sql("SELECT v AS old_id, row_number() OVER (ORDER BY deg, v) - 1 AS new_id FROM da", "vv", "d", "da"))(lambda s, d: relabel.degree_ascending(_ps(s, d)))
query("order_degree_descending", sql("SELECT v AS old_id, row_number() OVER (ORDER BY deg DESC, v) - 1 AS new_id FROM da", "vv", "d", "da"))(lambda s, d: relabel.degree_descending(_ps(s, d)))
query("order_random", sql("SELECT v AS old_id, row_number() OVER (ORDER BY md5(v || '-3'), v) - 1 AS new_id FROM vv", "vv"))(lambda s, d: relabel.random_order(_ps(s, d), 3))
query("order_buckets")(lambda s, d: sequential.bucket_balance(orient.by_degree(_ps(s, d), "larger_id_first")))
query("cost_model", "SELECT i AS deg, round(CASE WHEN i < 10 THEN [0, 0, 271, 310, 399, 419, 458, 478, 524, 539][i + 1] ELSE 384.1 * pow(i, 0.1491) END, 6) AS bandwidth, round(CASE WHEN i < 10 THEN [0, 0, 145.51, 121.98, 53.26, 23.92, 16, 14, 12.94, 10.24][i + 1] ELSE 12 * sqrt(384.1 * pow(i, 0.1491)) / sqrt(i) END, 6) AS balance FROM range(100) t(i)")(lambda s, d: metrics.cost_model(s.range(100).withColumnRenamed("id", "deg")).select("deg", F.round("bandwidth", 6).alias("bandwidth"), F.round("balance", 6).alias("balance")))
query("alpha", sql("SELECT v, round(sqrt(deg) / (SELECT sum(sqrt(deg)) FROM da), 9) AS alpha FROM da", "vv", "d", "da", graph="co"))(lambda s, d: relabel.alpha(_co(s, d)))
query("neighbour_order", sql("SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.src ORDER BY deg DESC, e.dst) AS place FROM e JOIN d ON d.v = e.dst", "d"))(lambda s, d: relabel.neighbour_order(_ps(s, d)))
query("compact_ids", sql("SELECT v AS old_id, row_number() OVER (ORDER BY v) - 1 AS new_id FROM d", "d", graph="co"))(lambda s, d: relabel.compact_ids(_co(s, d)))
query("first_seen_ids", sql("SELECT v AS old_id, row_number() OVER (ORDER BY pos NULLS LAST, v) - 1 AS new_id FROM vv LEFT JOIN (SELECT dst AS v, min(dst * 7919 % 1009 * 1000000 + src) AS pos FROM e GROUP BY 1) p USING (v)", "vv"))(lambda s, d: relabel.first_seen(_ps(s, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("dst") * 7919 % 1009 * 1000000 + F.col("src")).alias("pos"))))


def _walk_sql(root: str, near: str) -> str:
    """Positions of a breadth-first walk along edges: a level a step, by the first parent and ``near``; where nothing
    follows, the next root in the order of ``root``."""
    return f"""k AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY {root}) AS root, row_number() OVER (ORDER BY {near}) AS near FROM io),
    w(step, v, pos, last) AS (
        SELECT 0, v, CASE WHEN root = 1 THEN 0 END, root = 1 FROM k
        UNION ALL
        SELECT step + 1, w.v, coalesce(w.pos, x.pos), x.pos IS NOT NULL
        FROM w LEFT JOIN (
            SELECT v, (SELECT count(pos) FROM w) + row_number() OVER (ORDER BY parent, near) - 1 AS pos
            FROM (
                SELECT v, parent, near, max(parent) OVER () AS latest
                FROM (
                    SELECT t.v, min(f.pos) AS parent, any_value(k.near) AS near FROM w f JOIN e ON e.src = f.v JOIN w t ON t.v = e.dst AND t.pos IS NULL JOIN k ON k.v = t.v WHERE f.last GROUP BY t.v
                    UNION ALL
                    (SELECT w.v, -1, 0 FROM w JOIN k USING (v) WHERE w.pos IS NULL ORDER BY k.root LIMIT 1)
                )
            ) WHERE parent >= 0 OR latest = -1
        ) x ON x.v = w.v
        WHERE (SELECT bool_or(pos IS NULL) FROM w)
    ), walk AS (SELECT v, pos FROM w WHERE step = (SELECT max(step) FROM w))"""


_BFS, _CUTHILL = _walk_sql("out_deg DESC, v", "v"), _walk_sql("out_deg + in_deg, v", "out_deg + in_deg, v")
#: a vertex a step: the first successor not yet met of the path's end, or a step back, or a new root
_DFS = """nb AS MATERIALIZED (SELECT src AS v, list(dst ORDER BY dst) AS outs FROM e GROUP BY 1),
    w(step, path, met) AS (
        SELECT 0, [0::BIGINT], [0::BIGINT]
        UNION ALL
        SELECT step + 1, CASE WHEN nxt IS NOT NULL THEN list_append(path, nxt) WHEN len(path) > 1 THEN path[:-2] WHEN root IS NOT NULL THEN [root] END,
               CASE WHEN coalesce(nxt, CASE WHEN len(path) <= 1 THEN root END) IS NOT NULL THEN list_append(met, coalesce(nxt, root)) ELSE met END
        FROM (
            SELECT step, path, met, list_filter(outs, lambda x: NOT list_contains(met, x))[1] AS nxt, (SELECT min(vv.v) FROM vv WHERE NOT list_contains(w.met, vv.v)) AS root
            FROM w LEFT JOIN nb ON nb.v = w.path[-1]
            WHERE len(met) < (SELECT count(*) FROM vv)
        )
    ), walk AS (SELECT unnest(met) AS v, generate_subscripts(met, 1) - 1 AS pos FROM w WHERE step = (SELECT max(step) FROM w))"""
_WALKS = {
    "dfs": (_DFS, "SELECT v AS old_id, pos AS new_id FROM walk"),
    "bfs": (_BFS, "SELECT v AS old_id, pos AS new_id FROM walk"),
    "rcm": (_CUTHILL, "SELECT v AS old_id, (SELECT count(*) FROM vv) - 1 - pos AS new_id FROM walk"),
    "hybrid": (_BFS, "SELECT v AS old_id, row_number() OVER (ORDER BY out_deg + in_deg DESC, pos) - 1 AS new_id FROM walk JOIN io USING (v)"),
    "greedy_naive": (
        _CUTHILL,
        """SELECT io.v AS old_id, row_number() OVER (ORDER BY t.place NULLS LAST, io.v) - 1 AS new_id
        FROM io LEFT JOIN (
            SELECT v, min(place) AS place FROM (
                SELECT e.dst AS v, row_number() OVER (ORDER BY -walk.pos, i.out_deg + i.in_deg DESC, e.dst) AS place FROM e JOIN walk ON walk.v = e.src JOIN io i ON i.v = e.dst
            ) GROUP BY 1
        ) t ON t.v = io.v""",
    ),
}
for _m in sequential.METHODS:
    query(f"order_{_m}", _state_sql(*_WALKS[_m], "vv", "io") if _m in _WALKS else None)(lambda s, d, m=_m: sequential.reorder(_co(s, d), m))

# triangles, cliques, patterns

_TRI = "SELECT count(*) AS triangles FROM o x JOIN o y ON y.src = x.dst JOIN o z ON z.src = x.src AND z.dst = y.dst"
for _g, _edges in (("partsupp", _ps), ("copart", _co)):
    for _p in triangles.PLANS:
        query(f"tri_count_{_p}_{_g}", sql(_TRI, "d", "o", graph="ps" if _g == "partsupp" else "co"))(lambda s, d, p=_p, e=_edges: triangles.count_triangles(triangles.directed(e(s, d)), p))
_SUP = "SELECT x.src, x.dst, count(*) AS support FROM o x JOIN o y ON y.src = x.src JOIN o z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1, 2"
query("edge_support", sql(_SUP, "d", "o"))(lambda s, d: triangles.support(triangles.directed(_ps(s, d))))
query("edge_support_packed", sql(_SUP, "d", "o"))(lambda s, d: triangles.packed_support(triangles.directed(_ps(s, d))))
query("triangle_partials", sql(f"SELECT src // w AS m, dst // w AS k, CAST(sum(support) AS BIGINT) AS triangles FROM ({_SUP}), (SELECT (max(greatest(src, dst)) + 4) // 4 AS w FROM e) GROUP BY 1, 2", "d", "o"))(lambda s, d: (lambda e: triangles.partial_counts(triangles.directed(e), prepare.n_of(e), 4).select(F.col("m"), F.col("k"), "triangles"))(_ps(s, d)))
query("triangle_list", sql("SELECT x.src AS a, x.dst AS b, y.dst AS c FROM o x JOIN o y ON y.src = x.dst JOIN o z ON z.src = x.src AND z.dst = y.dst", "d", "o", graph="co"))(lambda s, d: triangles.triangles(triangles.directed(_co(s, d))))
query("wedges", sql("SELECT x.src AS u, x.dst AS v, y.dst AS w FROM o x JOIN o y ON y.src = x.src AND x.dst < y.dst", "d", "o", graph="co"))(lambda s, d: triangles.wedges(triangles.directed(_co(s, d))))


def _clique_sql(k):
    froms = "o e12"
    for i in range(3, k + 1):
        for j in range(i - 1, 0, -1):
            froms += f" JOIN o e{j}{i} ON " + (f"e{j}{i}.src = e{j - 1}{j}.dst" if j == i - 1 else f"e{j}{i}.dst = e{i - 1}{i}.dst AND e{j}{i}.src = e{j}{j + 1}.src")
    return froms


def _clique_count_sql(k):
    """Common successors of all so far, a list a row; the last level is counted, not made."""
    rows = "SELECT list_intersect(x.outs, y.outs) AS cand FROM o JOIN nb x ON x.v = o.src JOIN nb y ON y.v = o.dst"
    for _ in range(3, k):
        rows = f"SELECT list_intersect(cand, outs) AS cand FROM (SELECT cand, unnest(cand) AS u FROM ({rows})) JOIN nb ON nb.v = u"
    return f", nb AS MATERIALIZED (SELECT src AS v, list(dst) AS outs FROM o GROUP BY 1) SELECT CAST(coalesce(sum(len(cand)), 0) AS BIGINT) AS cliques FROM ({rows})"


for _k in (3, 4, 5):
    query(f"kclique_count_{_k}", sql("X", "d", "o", graph="ps" if _k < 5 else "co").replace(" X", _clique_count_sql(_k)))(lambda s, d, k=_k: cliques.count_k_cliques(triangles.directed((_ps if k < 5 else _co)(s, d)), k))
query("kclique_list_4", sql(f"SELECT e12.src AS v1, e12.dst AS v2, e23.dst AS v3, e34.dst AS v4 FROM {_clique_sql(4)}", "d", "o", graph="co"))(lambda s, d: cliques.k_cliques(triangles.directed(_co(s, d)), 4))

PATTERNS = {
    "edge": patterns.Pattern((0, 1), ((0, 1),)),
    "path3": patterns.Pattern((0, 1, 0), ((0, 1), (1, 2))),
    "triangle": patterns.Pattern((0, 1, 2), ((0, 1), (1, 2), (0, 2))),
    "cycle4": patterns.Pattern((0, 1, 0, 2), ((0, 1), (1, 2), (2, 3), (0, 3))),
    "diamond": patterns.Pattern((0, 1, 2, 1), ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3))),
    "k4": patterns.Pattern((0, 1, 2, 0), ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))),
}


def _pattern_sql(p, body="SELECT {cols} FROM {tables} WHERE {conditions}"):
    n = len(p.labels)
    where = [f"l{i}.label = {p.labels[i]}" for i in range(n)] + [f"x{i}.src = l{a}.v AND x{i}.dst = l{b}.v" for i, (a, b) in enumerate(p.edges)]
    where += [f"l{i}.v <> l{j}.v" for i in range(n) for j in range(i)]
    names = ", ".join([f"lb l{i}" for i in range(n)] + [f"sy x{i}" for i in range(len(p.edges))])
    return body.format(cols=", ".join(f"l{i}.v AS q{i}" for i in range(n)), tables=names, conditions=" AND ".join(where))


for _n, _p in PATTERNS.items():
    query(f"match_{_n}", sql(_pattern_sql(_p), "sy", "lb", graph="co"))(lambda s, d, p=_p: patterns.match(prepare.both_directions(tables.copart_raw(s, d)), tables.part_labels(s, d), p))
query("match_disconnected", "SELECT 0::BIGINT AS q0, 0::BIGINT AS q1 WHERE false")(lambda s, d: patterns.match(_co(s, d), tables.part_labels(s, d), patterns.Pattern((0, 1), ())))
query("match_counts", sql("SELECT 0 AS query_id, count(*) AS n FROM (" + _pattern_sql(PATTERNS["edge"]) + ") UNION ALL SELECT 1, count(*) FROM (" + _pattern_sql(PATTERNS["triangle"]) + ")", "sy", "lb", graph="co"))(lambda s, d: patterns.count_matches(prepare.both_directions(_co(s, d)), tables.part_labels(s, d), [PATTERNS["edge"], PATTERNS["triangle"]]))


def _maximal(spark, d):
    e = _co(spark, d)
    return cliques.maximal_cliques(e, degree.with_isolated(degree.degrees(e), prepare.vertices(e), "deg").select("v", F.struct("deg", "v").alias("rank")))


#: every clique once, by rising ids, with all vertices that extend it
_MAXIMAL = """nb AS MATERIALIZED (SELECT src AS v, list(dst ORDER BY dst) AS near FROM sy GROUP BY 1),
    q(members, ext) AS (
        SELECT [vv.v], coalesce(near, []) FROM vv LEFT JOIN nb USING (v)
        UNION ALL
        SELECT list_append(members, u), list_intersect(ext, near)
        FROM (SELECT members, ext, unnest(list_filter(ext, lambda x: x > members[-1])) AS u FROM q) JOIN nb ON nb.v = u
    ), mx AS (SELECT members FROM q WHERE len(ext) = 0)"""
_MEMBERS = "SELECT array_to_string(members, ' ') AS members FROM mx"
query("maximal_cliques", _state_sql(_MAXIMAL, _MEMBERS, "vv", "sy"))(lambda s, d: _maximal(s, d).select(_text("members").alias("members")))
query("maximal_clique_report", _state_sql(_MAXIMAL, "SELECT count(*) AS cliques, max(len(members)) AS largest FROM mx", "vv", "sy"))(lambda s, d: cliques.clique_report(_maximal(s, d)))
query("maximal_cliques_degeneracy", _state_sql(_MAXIMAL, _MEMBERS, "vv", "sy"))(lambda s, d: (lambda e: cliques.maximal_cliques(e, peel.degeneracy_order(peel.core_numbers(e))).select(_text("members").alias("members")))(_co(s, d)))

# sets: each supplier's parts against the next supplier's

def _sets(spark, d):
    return tables.supplier_sets(spark, d)


def _pairs(s: DataFrame) -> DataFrame:
    ids = s.select("set_id").distinct()
    return ids.select(F.col("set_id").alias("a"), (F.col("set_id") + 1).alias("b")).join(ids.select(F.col("set_id").alias("b")), "b", "left_semi").select("a", "b")


def _array_pairs(spark, d) -> DataFrame:
    s = _sets(spark, d)
    arrays = s.groupBy("set_id").agg(F.sort_array(F.collect_list("elem")).alias("x"))
    return _pairs(s).join(arrays.select(F.col("set_id").alias("a"), F.col("x").alias("sa")), "a").join(arrays.select(F.col("set_id").alias("b"), F.col("x").alias("sb")), "b")


_LISTS = "la AS (SELECT set_id, list(elem ORDER BY elem) AS x FROM s GROUP BY 1), ab AS (SELECT pr.a, pr.b, p.x AS sa, q.x AS sb FROM pr JOIN la p ON p.set_id = pr.a JOIN la q ON q.set_id = pr.b)"


def _set_sql(expression: str, name: str) -> str:
    return "WITH " + ", ".join([CTE["s"], CTE["pr"], _LISTS]) + f" SELECT a, b, {expression} AS {name} FROM ab"


def _listed(expr):
    return f"array_to_string(list_sort({expr}), ' ')"


_SET_OPS = {
    "intersect": (lambda a, b: _text(S.intersect(a, b)), _listed("list_intersect(sa, sb)")),
    "merge": (lambda a, b: _text(S.merge(a, b)), _listed("list_concat(sa, sb)")),
    "subtract": (lambda a, b: _text(S.subtract(a, b)), _listed("list_filter(sa, lambda x: NOT list_contains(sb, x))")),
    "union": (lambda a, b: _text(S.union(a, b)), _listed("list_distinct(list_concat(sa, sb))")),
    "xor": (lambda a, b: _text(S.symmetric_difference(a, b)), _listed("list_concat(list_filter(sa, lambda x: NOT list_contains(sb, x)), list_filter(sb, lambda x: NOT list_contains(sa, x)))")),
    "intersect_count": (lambda a, b: S.intersect_count(a, b), "CAST(len(list_intersect(sa, sb)) AS BIGINT)"),
    "union_count": (lambda a, b: S.union_count(a, b), "CAST(len(list_distinct(list_concat(sa, sb))) AS BIGINT)"),
    "difference_count": (lambda a, b: S.difference_count(a, b), "CAST(len(list_filter(sa, lambda x: NOT list_contains(sb, x))) AS BIGINT)"),
    "jaccard": (lambda a, b: F.round(S.jaccard(a, b), 9), "round(len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))), 9)"),
    "overlaps": (lambda a, b: S.overlaps(a, b), "list_has_any(sa, sb)"),
    "subset": (lambda a, b: S.is_subset(F.slice(a, 1, 2), b), "list_has_all(sb, sa[:2])"),
    "equal": (lambda a, b: S.is_equal(F.slice(a, 1, 1), F.slice(b, 1, 1)), "sa[:1] = sb[:1]"),
    "empty": (lambda a, b: S.is_empty(S.intersect(a, b)), "len(list_intersect(sa, sb)) = 0"),
    "strict_subset": (lambda a, b: S.is_strict_subset(a, b), "list_has_all(sb, sa) AND len(sa) < len(sb)"),
    "minimum": (lambda a, b: S.minimum(a), "list_min(sa)"),
    "maximum": (lambda a, b: S.maximum(b), "list_max(sb)"),
    "flip": (lambda a, b: _text(S.flip(a, 50, 150)), _listed("list_concat(list_filter(range(50, 150), lambda x: NOT list_contains(sa, x)), list_filter(sa, lambda x: x < 50 OR x >= 150))")),
    "rank": (lambda a, b: S.rank(a, F.lit(100)), "CAST(len(list_filter(sa, lambda x: x <= 100)) AS BIGINT)"),
    "select": (lambda a, b: S.select(a, 2), "sa[3]"),
    "add": (lambda a, b: _text(S.add(a, F.lit(77).cast("long"))), _listed("list_distinct(list_append(sa, 77))")),
    "remove": (lambda a, b: _text(S.remove(a, S.minimum(a))), _listed("sa[2:]")),
    "contains": (lambda a, b: S.contains(a, S.minimum(b)), "list_contains(sa, sb[1])"),
    "text": (lambda a, b: S.to_text(a), "'{' || array_to_string(sa, ',') || '}'"),
}
for _n, (_f, _q) in _SET_OPS.items():
    query(f"set_{_n}", _set_sql(_q, _n))(lambda s, d, f=_f, n=_n: _array_pairs(s, d).select("a", "b", f(F.col("sa"), F.col("sb")).alias(n)))


def _packed(spark, d):
    s = _sets(spark, d)
    return prepare.pack(s, "set_id", "elem"), _pairs(s)


def _set_cte(*names, body):
    return "WITH " + ", ".join(CTE[n] for n in names) + " " + body


_BOTH = "FROM pr JOIN pk x ON x.set_id = pr.a JOIN pk y ON y.set_id = pr.b AND y.base = x.base"
query("packed_encode", _set_cte("s", "pk", body="SELECT set_id, base, state FROM pk"))(lambda s, d: _packed(s, d)[0])
query("packed_decode", _set_cte("s", body="SELECT set_id, elem FROM s"))(lambda s, d: prepare.unpack(_packed(s, d)[0]))
query("packed_intersect", _set_cte("s", "pr", "pk", body=f"SELECT a, b, x.base, x.state & y.state AS state {_BOTH} WHERE x.state & y.state <> 0"))(lambda s, d: S.packed_intersect(*_packed(s, d)))
query("packed_intersect_count", _set_cte("s", "pr", body="SELECT pr.a, pr.b, count(y.elem) AS n FROM pr JOIN s x ON x.set_id = pr.a LEFT JOIN s y ON y.set_id = pr.b AND y.elem = x.elem GROUP BY 1, 2"))(lambda s, d: S.packed_intersect_count(*_packed(s, d)))
query("packed_subtract", _set_cte("s", "pr", "pk", body="SELECT a, b, x.base, x.state & ~coalesce(y.state, 0) AS state FROM pr JOIN pk x ON x.set_id = pr.a LEFT JOIN pk y ON y.set_id = pr.b AND y.base = x.base WHERE x.state & ~coalesce(y.state, 0) <> 0"))(lambda s, d: S.packed_subtract(*_packed(s, d)))
query("packed_insert", _set_cte("s", body="SELECT set_id, elem // 32 AS base, bit_or(1::BIGINT << CAST(elem % 32 AS INTEGER)) AS state FROM (SELECT set_id, elem FROM s UNION SELECT set_id, set_id FROM s) GROUP BY 1, 2"))(lambda s, d: S.packed_insert(_packed(s, d)[0], _sets(s, d).select("set_id", F.col("set_id").alias("elem")).distinct()))
query("bucketed_intersect", _set_cte("s", "pr", body="SELECT pr.a, pr.b, x.elem FROM pr JOIN s x ON x.set_id = pr.a JOIN s y ON y.set_id = pr.b AND y.elem = x.elem"))(lambda s, d: (lambda e: S.bucketed_intersect(e, _pairs(e)))(_sets(s, d)))
query("bitmap_cardinality", _set_cte("s", body="SELECT set_id, count(*) AS n FROM s GROUP BY 1"))(lambda s, d: S.bitmap_cardinality(S.bitmaps(_sets(s, d))))
query("bitmap_union_count", _set_cte("s", body="SELECT count(DISTINCT elem) AS n FROM s"))(lambda s, d: S.bitmap_union(S.bitmaps(_sets(s, d))).agg(F.sum(F.bitmap_count("bits")).alias("n")))
query("bitmap_intersect_count", ORACLE_SQL["packed_intersect_count"])(lambda s, d: (lambda e: S.bitmap_intersect_count(S.bitmaps(e), _pairs(e)))(_sets(s, d)))
query("odd_members", _set_cte("s", body="SELECT elem FROM s GROUP BY elem HAVING count(*) % 2 = 1"))(lambda s, d: S.odd_members(_sets(s, d)))

# metrics

_VW = "vw AS (SELECT vv.v, coalesce(CAST(t.two * floor(log2(t.own)) AS BIGINT), 0) AS work FROM vv LEFT JOIN (SELECT o.src AS v, count(*) AS own, sum(od.out_deg) AS two FROM o JOIN od ON od.v = o.dst GROUP BY 1) t USING (v))"
_EW = "ew AS (SELECT o.src, o.dst, CAST(floor(least(a.out_deg, b.out_deg) * log2(greatest(a.out_deg, b.out_deg) + 2) + 1e-9) AS BIGINT) AS work, greatest(a.out_deg, b.out_deg) AS longer FROM o JOIN od a ON a.v = o.src JOIN od b ON b.v = o.dst)"
_CHAIN = ("vv", "d", "o", "od")


def _more(extra, body, graph="ps", chain=_CHAIN):
    return sql("X", *chain, graph=graph).replace(" X", f", {extra} {body}")


query("vertex_workload", _more(_VW, "SELECT v, work FROM vw"))(lambda s, d: metrics.vertex_workload(triangles.directed(_ps(s, d))))
query("balanced_blocks", _more(_VW, "SELECT v, work, CAST(greatest(0, floor((sum(work) OVER (ORDER BY v) - 1) / (SELECT ceil(sum(work) / 300) FROM vw))) AS BIGINT) AS block FROM vw"))(lambda s, d: metrics.balanced_blocks(metrics.vertex_workload(triangles.directed(_ps(s, d))), 300))
query("edge_workload", _more(_EW, "SELECT src, dst, work, longer FROM ew"))(lambda s, d: metrics.edge_workload(triangles.directed(_ps(s, d))))
_BIN = "mw AS (SELECT ln(max(work)) / ln(8) AS p FROM ew), eb AS (SELECT src, dst, work, longer, CAST(CASE " + " ".join(f"WHEN work >= floor(pow(8, (p - 1) * ({i} - 1) / 32 + 1)) THEN {i}" for i in (32, 16, 8, 4, 2)) + " ELSE 1 END AS BIGINT) AS bin FROM ew, mw)"
query("edge_bins", _more(_EW + ", " + _BIN, "SELECT src, dst, work, longer, bin FROM eb"))(lambda s, d: metrics.edge_bins(metrics.edge_workload(triangles.directed(_ps(s, d)))))
_SLOTS = """rk AS (SELECT src, dst, bin, 1024 // bin AS block, row_number() OVER (PARTITION BY bin ORDER BY longer, src, dst) - 1 AS r, count(*) OVER (PARTITION BY bin) AS size FROM eb),
    st AS (SELECT *, size % block AS extra, greatest(size // block, 1) AS blocks, greatest(1, block // 32) AS per FROM rk), sl AS (SELECT *, r - extra AS i FROM st)"""


@query("edge_rearranged", _more(_EW + ", " + _BIN + ", " + _SLOTS, "SELECT src, dst, bin, CASE WHEN r < extra THEN size - extra + r ELSE ((i // 32) % blocks * per + i // 32 // blocks) * 32 + i % 32 END AS slot FROM sl"))
def _(spark, d):
    binned = materialize(metrics.edge_bins(metrics.edge_workload(triangles.directed(_ps(spark, d)))), "binned")
    return reduce(DataFrame.unionByName, (metrics.rearranged(binned, i).withColumn("bin", F.lit(i).cast("long")) for i in (1, 2, 4, 8, 16, 32)))


query("partition_ranges", sql("SELECT lo, least(n, lo + width) AS hi FROM (SELECT n, unnest(range(0, n, width)) AS lo, width FROM (SELECT n, CAST(ceil(n / greatest(1, ceil(2 * (8 * m + 8 * n) / 200000))) AS BIGINT) AS width FROM (SELECT (SELECT count(*) FROM vv) AS n, (SELECT count(*) FROM e) AS m)))", "vv"))(lambda s, d: (lambda e: s.createDataFrame(metrics.partition_ranges(prepare.n_of(e), e.count(), 200_000), "lo long, hi long"))(_ps(s, d)))
_WAYS = "wy AS (SELECT 'id' AS direction, src FROM e UNION ALL SELECT 'degree', src FROM o UNION ALL SELECT 'given', src FROM e), mn AS (SELECT (SELECT count(*) FROM e) / (SELECT count(*) FROM vv) AS mean), cnt AS (SELECT n.direction, vv.v, count(wy.src) AS c FROM vv CROSS JOIN (SELECT DISTINCT direction FROM wy) n LEFT JOIN wy ON wy.src = vv.v AND wy.direction = n.direction GROUP BY 1, 2)"
query("direction_cost", _more(_WAYS, "SELECT direction, round(coalesce(sum(CASE WHEN c - mean > mean THEN abs(c - mean) END), 0.0), 4) AS cost FROM cnt, mn GROUP BY 1", chain=("vv", "d", "o")))(lambda s, d: metrics.direction_cost(_ps(s, d)))
query("direction_deviation", _more("mn AS (SELECT (SELECT count(*) FROM e) / (SELECT count(*) FROM vv) AS mean)", "SELECT round(sum(abs(mean - coalesce(a.c, 0))), 4) AS given, round(sum(abs(mean - coalesce(b.c, 0))), 4) AS by_degree FROM vv LEFT JOIN (SELECT src AS v, count(*) AS c FROM e GROUP BY 1) a USING (v) LEFT JOIN (SELECT src AS v, count(*) AS c FROM o GROUP BY 1) b USING (v), mn", chain=("vv", "d", "o")))(lambda s, d: metrics.direction_deviation(_ps(s, d)))
_AR = """h AS (SELECT deg, count(*) AS c FROM da GROUP BY deg), m AS (SELECT (SELECT count(*) FROM e) / (SELECT count(*) FROM vv) AS a),
t AS (SELECT any_value(a) AS a, coalesce(sum(CASE WHEN deg <= a THEN deg * c END), 0) AS low, coalesce(sum(CASE WHEN deg > a THEN deg * c END), 0) AS high, coalesce(sum(CASE WHEN deg > a THEN c END), 0) AS nh, coalesce(sum(CASE WHEN deg >= 1 AND deg <= a THEN c * (a - deg) END), 0) AS lb1, coalesce(sum(CASE WHEN deg > floor(a) THEN (c * deg) // 2 END), 0) AS rem FROM h, m),
w AS (SELECT deg, c, coalesce(sum(deg * c) OVER (ORDER BY deg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h, m WHERE deg > floor(a)),
u AS (SELECT sum(CASE WHEN rem - before > deg * c THEN a * c ELSE a * (rem - before) / deg END) AS ub FROM w, t WHERE rem - before > 0)"""
query("approximation_ratio", _more(_AR, "SELECT round(1 + ub / (lb1 + CASE WHEN high / nh / 2 >= a THEN greatest(0, (high - low) / 2 - a * nh) ELSE a * nh - high / 2 END), 6) AS ratio FROM t, u", chain=("vv", "d", "da")))(lambda s, d: metrics.approximation_ratio(_ps(s, d)))
_PR = "f AS (SELECT src AS v, count(*) AS len, count(DISTINCT dst // 32) AS words FROM e GROUP BY 1), g AS (SELECT dst AS v, count(*) AS len, count(DISTINCT src // 32) AS words FROM e GROUP BY 1), z AS (SELECT (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM vv) AS n, (SELECT sum(words) FROM f) AS ow, (SELECT sum(words) FROM g) AS iw, (SELECT sum(words * sqrt(len)) FROM f) AS os, (SELECT sum(words * sqrt(len)) FROM g) AS i2, (SELECT sum(sqrt(len)) FROM f) AS sq)"
query("pack_ratio", _more(_PR, "SELECT round(ow / m, 6) AS out_ratio, round(iw / m, 6) AS in_ratio, round((ow / m + iw / m) / 2, 6) AS ratio, round((os + i2) / sq, 6) AS score, round((ow + iw) / (2.0 * n), 6) AS norm, round((2 * m + 4 * n) * 4.0 / 1048576, 6) AS plain_mb, round((1.5 * (ow + iw) + 4 * n) * 4.0 / 1048576, 6) AS packed_mb FROM z", chain=("vv",)))(lambda s, d: metrics.pack_ratio(_ps(s, d)))
