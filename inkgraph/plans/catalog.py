"""Every set operator bound to the star-schema tables, with the same in SQL.

The bindings are analogues that exercise the operators on tables which hold no images: suppliers stand for documents, line
numbers for pages, and so on. Floats are rounded, aliases agree, and ranking orders by all that is shown, so results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import agents, claims, ensemble, evaluate, graph, labels, outline, segment, select, spatial, stats, strokes, tidy
from ..sources import dictionary, images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, page_no, res_iter, dpi, confidence, avg_bond from lineitem."""
    li = table(spark, sf, "lineitem")
    out = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), (F.col("l_partkey") % 5).cast("int").alias("res_iter"), F.round(F.col("l_discount") * 10 - F.col("l_tax"), 6).alias("confidence"), F.col("l_quantity").alias("avg_bond"))
    return out.withColumn("dpi", select.dpi_of(F.col("res_iter")))


REC = """rec AS (SELECT l_suppkey AS doc_id, l_linenumber AS page_no, (l_partkey % 5)::INT AS res_iter, round(l_discount * 10 - l_tax, 6) AS confidence,
 l_quantity AS avg_bond, [72, 150, 300, 300, 500][(l_partkey % 5)::INT + 1] AS dpi FROM lineitem)"""


@query(f"""WITH {REC},
m AS (SELECT doc_id, res_iter, dpi, round(sum(confidence) / count(*), 9) AS mean FROM rec GROUP BY ALL),
b AS (SELECT doc_id, res_iter FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mean DESC, dpi = 300 DESC, res_iter) AS k FROM m) WHERE k = 1)
SELECT rec.* FROM rec JOIN b USING (doc_id, res_iter)""")
def resolution_selection(spark, sf):
    return select.select_resolution(records(spark, sf))


@query(f"""WITH {REC} SELECT doc_id, confidence, page_no, res_iter, avg_bond FROM
(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, page_no, res_iter, avg_bond) AS k FROM rec) WHERE k = 1""")
def best_record(spark, sf):
    return select.best_record(records(spark, sf), ["doc_id"], "confidence", ["page_no", "res_iter", "avg_bond"])


@query(f"WITH {REC} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY res_iter, page_no, confidence DESC, avg_bond) AS ord FROM rec")
def learning_listing(spark, sf):
    c = F.col
    return select.learning_listing(records(spark, sf), "doc_id", [c("res_iter"), c("page_no"), c("confidence").desc(), c("avg_bond")])


@query("SELECT p_partkey, p_size AS width, (p_partkey % 50)::INT AS height FROM part WHERE p_size > 21 AND p_partkey % 50 > 22 AND (p_size > 42 OR p_partkey % 50 > 44)")
def box_filter(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("width"), (F.col("p_partkey") % 50).cast("int").alias("height"))
    return select.large_boxes(part, F.col("width"), F.col("height"))


@query("""SELECT l_returnflag, l_linestatus, CASE WHEN count(*) > 1 THEN list_sort(list(l_quantity))[3 * (count(*) - 1) // 4 + 1] ELSE 10.0 END AS p75
FROM lineitem GROUP BY ALL""")
def percentile75_index(spark, sf):
    return stats.ordered_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "3 * (n - 1) div 4", "p75")


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[(count(*) - 1) // 2 + 1] AS median FROM orders GROUP BY ALL")
def lower_median(spark, sf):
    return stats.ordered_values(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "(n - 1) div 2", "median")


@query(f"""WITH {REC}, n AS (SELECT count(*) AS n FROM rec),
t AS (SELECT avg_bond, row_number() OVER (ORDER BY confidence DESC, avg_bond, doc_id, page_no, res_iter) AS k FROM rec),
s AS (SELECT round(avg(avg_bond), 9) AS m, round(stddev_samp(avg_bond), 9) AS d FROM t, n WHERE k <= least(n, greatest(10, (n - 1) // 10) + 1))
SELECT rec.* FROM rec, s WHERE avg_bond > m - 2 * d AND avg_bond < m + 2 * d""")
def avg_bond_band(spark, sf):
    return ensemble.bond_length_band(records(spark, sf), "confidence", "avg_bond", ["avg_bond", "doc_id", "page_no", "res_iter"])


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 OR coalesce(text, '') = ''")
def unique_by_key(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.when(F.coalesce("text", F.lit("")) == "", "").otherwise(F.sha2("text", 256)).alias("key"))
    return ensemble.unique_by_key(docs, "key", ["doc_id"]).select("doc_id", "lang", "source")


@query("SELECT p_brand AS key, p_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1")
def dictionary_last_wins(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"), F.col("p_partkey").alias("n"))
    return dictionary.last_wins(part)


@query("""SELECT nth, key, value FROM (SELECT nth, trim(l[1:pos - 1]) AS key, trim(l[pos + 1:]) AS value FROM
(SELECT nth, l, instr(l, ' ') AS pos FROM (SELECT o_orderkey AS nth, CASE WHEN o_orderkey % 7 = 0 THEN '#' ELSE '' END || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '  ' || o_orderstatus ELSE '' END AS l FROM orders))
WHERE pos > 0 AND l[1:1] <> '#')""")
def dictionary_lines(spark, sf):
    line = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "#").otherwise(""), "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\t "), "o_orderstatus")).otherwise(""))
    return dictionary.parse_lines(table(spark, sf, "orders").select(line.alias("line"), F.col("o_orderkey").alias("nth")), order="nth")


def brand_types(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    return dictionary.last_wins(part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"), F.col("p_partkey").alias("n")))


BRANDS = "dict AS (SELECT key, value FROM (SELECT p_brand AS key, p_type AS value, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM part) WHERE k = 1)"
#: A label for each part: its brand, one of two letters, or H.
LABEL = "CASE p_partkey % 4 WHEN 0 THEN 'h' WHEN 1 THEN 'H' ELSE p_brand END"


@query(f"""WITH {BRANDS} SELECT p_partkey, l AS label, coalesce(value, CASE WHEN l = 'H' AND p_size > 1 THEN 'N' WHEN length(l) = 1 THEN upper(l) ELSE l END) AS corrected
FROM (SELECT p_partkey, p_size % 4 AS p_size, {LABEL} AS l FROM part) LEFT JOIN dict ON l = key""")
def label_correction(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 4).alias("n"), F.expr(LABEL).alias("label"))
    return labels.correct_labels(part, brand_types(spark, sf), "label", F.col("n")).drop("n")


SYMBOL = "CASE p_partkey % 5 WHEN 0 THEN 'Cl' WHEN 1 THEN ' ' WHEN 2 THEN 'Qq' WHEN 3 THEN 'N' ELSE p_brand END"


@query(f"""WITH {BRANDS} SELECT p_partkey, l AS label, CASE WHEN l <> ' ' THEN value END AS smiles,
CASE WHEN l = ' ' THEN 6 WHEN value IS NOT NULL THEN NULL WHEN l = 'Cl' THEN 17 WHEN l = 'N' THEN 7 ELSE 0 END AS anum
FROM (SELECT p_partkey, {SYMBOL} AS l FROM part) LEFT JOIN dict ON l = key""")
def superatom_resolution(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.expr(SYMBOL).alias("label"))
    return labels.resolve_labels(part, brand_types(spark, sf), "label")


@query(f"WITH {BRANDS} SELECT p_partkey, l AS label FROM (SELECT p_partkey, {SYMBOL} AS l FROM part) WHERE l NOT IN ('Cl', 'N') AND l NOT IN (SELECT key FROM dict)")
def unresolved_labels(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.expr(SYMBOL).alias("label"))
    return labels.unresolved(part, brand_types(spark, sf), "label")


@query("SELECT doc_id, length(regexp_replace(text, '[^oOcCNHsSBMeEXYZRPp23456789AF]', '', 'g'))::INT AS n FROM documents")
def char_filter_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.readable_count(F.col("text")).alias("n"))


@query("SELECT doc_id, md5(trim(text, ' ' || chr(10) || chr(9) || chr(11) || chr(13) || chr(12))) AS digest FROM documents")
def trim_normalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.trim(F.col("text"))).alias("digest"))


def value_histogram(spark, sf) -> DataFrame:
    return stats.histogram(table(spark, sf, "events"), F.col("value"), 20, 25.0)


HIST = "h AS (SELECT b.bin, count(v) AS n FROM (SELECT unnest(range(20))::INT AS bin) b LEFT JOIN (SELECT greatest(least(floor(value / 25.0), 19), 0)::INT AS v FROM events) e ON e.v = b.bin GROUP BY b.bin)"


@query(f"""WITH {HIST},
c AS (SELECT *, sum(n) OVER () AS total, sum(bin * n) OVER () AS moment, sum(n) OVER u AS w, sum(bin * n) OVER u AS m FROM h WINDOW u AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN w > 0 AND w < total THEN round((w / total) * (1 - w / total) * (m / w - (moment - m) / (total - w)) ** 2, 9) END AS sigma FROM c),
b AS (SELECT bin AS split FROM s WHERE sigma IS NOT NULL ORDER BY sigma DESC, bin LIMIT 1)
SELECT split, (SELECT bin FROM h WHERE bin <= split ORDER BY n DESC, bin LIMIT 1) AS peak1, (SELECT bin FROM h WHERE bin > split ORDER BY n DESC, bin LIMIT 1) AS peak2,
(SELECT max(n) FROM h WHERE bin <= split) AS max1, (SELECT max(n) FROM h WHERE bin > split) AS max2 FROM b""")
def otsu_threshold(spark, sf):
    return stats.otsu(value_histogram(spark, sf))


@query(f"""WITH {HIST}, g AS (SELECT *, lag(n) OVER (ORDER BY bin) AS p, lead(n) OVER (ORDER BY bin) AS q FROM h),
t AS (SELECT min(bin) AS top FROM g WHERE bin >= 3 AND n > p AND n > q)
SELECT coalesce(min(bin), 1) AS bin FROM g, t WHERE bin > top AND n < p AND n < q""")
def first_local_min(spark, sf):
    return stats.first_local_min(value_histogram(spark, sf))


@query("""WITH u AS (SELECT (l_quantity::INT) AS ratio, count(DISTINCT l_extendedprice::BIGINT // 1000) AS used FROM lineitem GROUP BY 1)
SELECT ratio, round((120 - used) / 120.0, 9) AS empty, round(CASE WHEN used < 120 THEN -((120 - used) / 120.0) * ln((120 - used) / 120.0) ELSE 0 END, 9) AS entropy FROM u""")
def entropy_rows(spark, sf):
    cells = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("ratio"), F.expr("cast(round(l_extendedprice) AS BIGINT) div 1000").alias("cell"))
    got = stats.empty_share_entropy(cells, "ratio", "cell", 120)
    return got.select("ratio", F.round("empty", 9).alias("empty"), F.round("entropy", 9).alias("entropy"))


@query("""WITH o AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT event_type, count(*) AS length FROM o GROUP BY user_id, event_type, g)
SELECT event_type, length, count(*) AS n FROM r GROUP BY ALL""")
def run_length_histogram(spark, sf):
    runs = stats.run_lengths(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("event_type", "length").agg(F.count("*").alias("n"))


def points(spark, sf, scale: float = 100.0) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.expr("vec_id div 100").alias("page_no"), F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double") * scale, 3).alias("x"), F.round(F.col("embedding")[1].cast("double") * scale, 3).alias("y"), "label")


PTS = "pts AS (SELECT vec_id // 100 AS page_no, vec_id AS id, round(embedding[1]::DOUBLE * 100, 3) AS x, round(embedding[2]::DOUBLE * 100, 3) AS y, label FROM embeddings)"


@query(f"WITH {PTS} SELECT ((floor((atan2(y, x) + pi()) / (2 * pi()) * 50)::INT % 50 + 50) % 50)::INT AS bin, count(*) AS n FROM pts GROUP BY 1")
def polar_histogram(spark, sf):
    p = points(spark, sf)
    return p.groupBy(stats.polar_bin(F.col("x"), F.col("y")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {PTS} SELECT page_no, a.id AS id1, b.id AS id2, round(greatest(abs(a.x - b.x), abs(a.y - b.y)), 6) AS d FROM pts a JOIN pts b USING (page_no)
WHERE a.id < b.id AND greatest(abs(a.x - b.x), abs(a.y - b.y)) < 1.0""")
def grid_neighbours(spark, sf):
    p = points(spark, sf)
    return spatial.near_pairs(p, p, 1.0, keys=["page_no"], ordered=True).select("page_no", "id1", "id2", F.round("d", 6).alias("d"))


@query(f"""WITH RECURSIVE {PTS}, e AS (SELECT a.page_no, a.id AS a, b.id AS b FROM pts a JOIN pts b USING (page_no) WHERE a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) < 1.5),
r AS (SELECT page_no, id, id AS seen FROM pts UNION SELECT r.page_no, r.id, e.b FROM r JOIN e ON r.page_no = e.page_no AND r.seen = e.a),
g AS (SELECT page_no, id, min(seen) AS low FROM r GROUP BY ALL)
SELECT page_no, low AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM g JOIN pts USING (page_no, id) GROUP BY ALL""")
def point_collapse(spark, sf):
    got = graph.collapsed(points(spark, sf), 1.5, ["page_no"])
    return got.select("page_no", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


def part_edges(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b"))  # equal ones are left out by components


CC = """RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem),
f AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM f UNION
(SELECT DISTINCT ON (u.node) u.node, v.component FROM recurring.cc AS u, cc AS v, f WHERE f.a = u.node AND f.b = v.node AND v.component < u.component ORDER BY u.node, v.component))"""


@query(f"WITH {CC} SELECT node, component FROM cc")
def connected_components(spark, sf):
    return graph.components(part_edges(spark, sf))


def order_lines(spark, sf) -> DataFrame:
    """A graph an order: its lines as bonds between part and supplier, atoms numbered small."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("bond_idx"), (F.col("l_partkey") % 6).alias("a"), (F.col("l_suppkey") % 6).alias("b"), F.when(F.col("l_tax") > 0.04, 2).otherwise(1).alias("type"), (F.col("l_discount") > 0.08).alias("arom"))


def order_bonds(spark, sf) -> DataFrame:
    return graph.distinct_rows(order_lines(spark, sf))


BONDS = "bonds AS (SELECT DISTINCT l_orderkey, l_linenumber AS bond_idx, l_partkey % 6 AS a, l_suppkey % 6 AS b, CASE WHEN l_tax > 0.04 THEN 2 ELSE 1 END AS type, l_discount > 0.08 AS arom FROM lineitem)"


@query(f"""WITH RECURSIVE {BONDS}, n AS (SELECT l_orderkey, a, b FROM bonds UNION SELECT l_orderkey, b, a FROM bonds),
r AS (SELECT l_orderkey, a AS node, a AS seen FROM n UNION SELECT r.l_orderkey, r.node, n.b FROM r JOIN n ON r.l_orderkey = n.l_orderkey AND r.seen = n.a),
c AS (SELECT l_orderkey, node, min(seen) AS component FROM r GROUP BY ALL)
SELECT l_orderkey, component, min((l_orderkey * 31 + node * 37) % 97) AS x1, min((l_orderkey * 17 + node * 53) % 89) AS y1, max((l_orderkey * 31 + node * 37) % 97) AS x2, max((l_orderkey * 17 + node * 53) % 89) AS y2, count(*) AS n FROM c GROUP BY ALL""")
def fragment_bbox(spark, sf):
    """Fragments of a graph an order, several in many of them."""
    k, n = F.col("l_orderkey"), F.col("node")
    nodes = graph.components(order_lines(spark, sf), ["l_orderkey"]).withColumn("x", (k * 31 + n * 37) % 97).withColumn("y", (k * 17 + n * 53) % 89)
    return graph.component_boxes(nodes, ["l_orderkey"])


@query(f"""WITH {BONDS}, e AS (SELECT l_orderkey, a AS atom_idx, type, arom FROM bonds UNION ALL SELECT l_orderkey, b, type, arom FROM bonds)
SELECT l_orderkey, atom_idx FROM e GROUP BY ALL HAVING count(*) = 1 AND max(type) = 1 AND NOT bool_or(arom)""")
def degree_terminal(spark, sf):
    return graph.terminal_atoms(order_bonds(spark, sf), ["l_orderkey"])


@query(f"""WITH {BONDS}, e AS (SELECT l_orderkey, a AS atom_idx, type FROM bonds UNION ALL SELECT l_orderkey, b, type FROM bonds)
SELECT l_orderkey, atom_idx, count(*) AS degree, sum(type)::BIGINT AS bond_sum FROM e GROUP BY ALL""")
def atom_degrees(spark, sf):
    return graph.degrees(order_bonds(spark, sf), ["l_orderkey"])


@query(f"""WITH {BONDS} SELECT l_orderkey, bond_idx, type, a, b, arom FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, least(a, b), greatest(a, b) ORDER BY bond_idx, type, a, b, arom) AS k FROM bonds WHERE a <> b) WHERE k = 1""")
def duplicate_edges(spark, sf):
    b = order_bonds(spark, sf).select("l_orderkey", "bond_idx", "type", "a", "b", "arom")
    return graph.distinct_bonds(b, ["l_orderkey"])


@query(f"""WITH {BONDS}, k AS (SELECT l_orderkey, bond_idx, least(a, b) AS a, greatest(a, b) AS b, type, row_number() OVER (PARTITION BY l_orderkey, least(a, b), greatest(a, b) ORDER BY bond_idx, type) AS k,
count(*) OVER (PARTITION BY l_orderkey, least(a, b), greatest(a, b)) AS n FROM bonds WHERE a <> b) SELECT l_orderkey, bond_idx, a, b, type + n - 1 AS type FROM k WHERE k = 1""")
def multi_edge_order(spark, sf):
    return graph.merged_bonds(order_bonds(spark, sf), ["l_orderkey"])


@query(f"""WITH {BONDS}, a AS (SELECT DISTINCT l_orderkey, unnest(range(6)) AS atom_idx FROM lineitem)
SELECT l_orderkey, atom_idx FROM a WHERE NOT EXISTS (SELECT 1 FROM bonds b WHERE b.l_orderkey = a.l_orderkey AND (b.a = atom_idx OR b.b = atom_idx))""")
def disconnected_nodes(spark, sf):
    """Of six atoms an order those on none of its bonds."""
    atoms = table(spark, sf, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<long>")).alias("atom_idx"))
    return graph.disconnected_atoms(atoms, order_bonds(spark, sf), ["l_orderkey"])


@query(f"""WITH {PTS}, p AS (SELECT page_no, a.id AS id1, b.id AS id2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pts a JOIN pts b USING (page_no) WHERE a.label % 2 = 0 AND b.label % 2 = 1)
SELECT page_no, id1, id2, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY d, id2) AS k FROM p WHERE d < 5) WHERE k = 1""")
def nearest_label(spark, sf):
    p = points(spark, sf)
    return spatial.nearest(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 5.0, G.distance, ["page_no"]).select("page_no", "id1", "id2", F.round("d", 6).alias("d"))


def part_boxes(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "part").select(F.expr("p_partkey div 400").alias("page_no"), c("p_partkey").alias("id"), (c("p_partkey") * 37 % 300).alias("x1"), (c("p_partkey") * 53 % 200).alias("y1"), (c("p_partkey") * 37 % 300 + 20 + c("p_size")).alias("x2"), (c("p_partkey") * 53 % 200 + 30 + c("p_size")).alias("y2"), (c("p_partkey") % 3).cast("int").alias("run_id"), F.round(c("p_retailprice") / 1000, 6).alias("confidence"))


BOX = "box AS (SELECT p_partkey // 400 AS page_no, p_partkey AS id, p_partkey * 37 % 300 AS x1, p_partkey * 53 % 200 AS y1, p_partkey * 37 % 300 + 20 + p_size AS x2, p_partkey * 53 % 200 + 30 + p_size AS y2 FROM part)"


@query(f"""WITH {BOX}, p AS (SELECT page_no, a.id AS id1, b.id AS id2, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS w, (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS h,
(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM box a JOIN box b USING (page_no) WHERE a.id < b.id)
SELECT page_no, id1, id2, round(w * h / (s - w * h)::DOUBLE, 9) AS iou FROM p WHERE w > 0 AND h > 0 AND w * h / (s - w * h)::DOUBLE > 0.5""")
def iou_pairs(spark, sf):
    return spatial.overlapping(part_boxes(spark, sf), 0.5, ["page_no"]).select("page_no", "id1", "id2", F.round("iou", 9).alias("iou"))


#: Weights of our own for the example; trained ones come from train_weights.
WEIGHTS = [round(((i * 7) % 11 - 5) / 10, 1) for i in range(26)]


@query(f"SELECT vec_id, round(list_dot_product(list_transform(embedding[1:26], lambda x: x::DOUBLE), {WEIGHTS}::DOUBLE[]), 6) AS score FROM embeddings")
def linear_confidence(spark, sf):
    values = F.transform(F.slice("embedding", 1, 26), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(graph.linear_score(values, WEIGHTS), 6).alias("score"))


@query("""SELECT (SELECT count(*) FROM documents WHERE (doc_id, md5(text)) IN (SELECT l.doc_id, md5(d.text) FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1)) AS identical,
(SELECT count(*) FROM labels WHERE quality = 1) AS total""")
def recall_eval(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("identity_key"))
    truth = table(spark, sf, "labels").where("quality = 1").join(docs, "doc_id").select("doc_id", "identity_key")
    return evaluate.matched(docs, truth, ["doc_id"])


@query(f"""WITH {REC}, m AS (SELECT doc_id, res_iter, round(avg(confidence), 9) AS m FROM rec GROUP BY ALL),
b AS (SELECT doc_id, coalesce((list(res_iter ORDER BY m DESC, res_iter IN (2, 3) DESC, res_iter) FILTER (WHERE m > 0))[1], min(res_iter) FILTER (WHERE m = 0 AND res_iter IN (2, 3)), 0) AS res_iter FROM m GROUP BY doc_id)
SELECT count(DISTINCT (doc_id, page_no)) / (SELECT count(DISTINCT (doc_id, page_no)) FROM rec WHERE avg_bond > 49)::DOUBLE AS recall
FROM rec JOIN b USING (doc_id, res_iter) WHERE avg_bond > 49""")
def trained_recall(spark, sf):
    rec = records(spark, sf).select("doc_id", "res_iter", F.col("confidence").alias("score"), (F.col("avg_bond") > 49).cast("int").alias("target"), "page_no")
    total = rec.where("target = 1").select("doc_id", "page_no").distinct().count()
    return evaluate.model_recall(rec, total, doc="doc_id", key="page_no")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem GROUP BY ALL")
def regression_slope(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(stats.slope("l_extendedprice", "l_quantity"), 6).alias("slope"))


@query("""SELECT r_regionkey, (row_number() OVER (PARTITION BY r_regionkey ORDER BY jaggy, unpaper, resolution) - 1)::INT AS run_id, jaggy, unpaper, resolution
FROM region, (SELECT unnest([false, true]) AS jaggy), (SELECT unnest([0, 1, 2]::INT[]) AS unpaper), (SELECT unnest([0, 150]::INT[]) AS resolution)""")
def option_grid(spark, sf):
    return table(spark, sf, "region").select("r_regionkey").crossJoin(F.broadcast(ensemble.option_grid(spark)))


@query(f"""WITH RECURSIVE {BOX}, n AS (SELECT box.*, row_number() OVER (PARTITION BY page_no ORDER BY p_partkey % 3, id) AS k, (p_partkey % 3)::INT AS run_id, round(p_retailprice / 1000, 6) AS confidence FROM box JOIN part ON id = p_partkey),
p AS (SELECT a.page_no, a.k AS early, b.k AS late FROM n a JOIN n b ON a.page_no = b.page_no AND a.run_id < b.run_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
      WHERE (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0.3 * ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))
      AND abs((a.x2 - a.x1) - (b.x2 - b.x1)) < 0.5 * least(a.x2 - a.x1, b.x2 - b.x1) AND abs((a.y2 - a.y1) - (b.y2 - b.y1)) < 0.5 * least(a.y2 - a.y1, b.y2 - b.y1)),
l AS (SELECT n.page_no, n.k, coalesce(list(early) FILTER (WHERE early IS NOT NULL), []) AS rivals FROM n LEFT JOIN p ON p.page_no = n.page_no AND p.late = n.k GROUP BY ALL),
h AS (SELECT page_no, 1::BIGINT AS k, [1::BIGINT] AS heads FROM l WHERE k = 1 UNION ALL SELECT h.page_no, l.k, CASE WHEN list_has_any(heads, rivals) THEN heads ELSE list_append(heads, l.k) END FROM h JOIN l ON l.page_no = h.page_no AND l.k = h.k + 1),
f AS (SELECT page_no, arg_max(heads, k) AS heads FROM h GROUP BY page_no),
o AS (SELECT l.page_no, l.k, coalesce(list_min(list_intersect(heads, rivals)), l.k) AS head FROM l JOIN f USING (page_no))
SELECT page_no, id, x1, y1, x2, y2, run_id, confidence, record_ord FROM (SELECT n.*, id AS record_ord, row_number() OVER (PARTITION BY o.page_no, head ORDER BY confidence DESC, n.k) AS nth FROM o JOIN n USING (page_no, k)) WHERE nth = 1""")
def greedy_claim(spark, sf):
    boxes = part_boxes(spark, sf).withColumn("record_ord", F.col("id"))
    return ensemble.claim(boxes, ["page_no"], least=0.3, differ=0.5)


@query(f"""WITH {PTS} SELECT id, round(sqrt(greatest(10 - x, 0, x - 20) ** 2 + greatest(-5 - y, 0, y - 5) ** 2), 6) AS d,
round(CASE WHEN x <> 0 OR y <> 0 THEN (y * 3 - x * 4) / sqrt(x * x + y * y) END, 6) AS off FROM pts""")
def geometry_offsets(spark, sf):
    c, v = F.col, F.lit
    p = points(spark, sf)
    d = G.point_box_distance(c("x"), c("y"), v(10.0), v(-5.0), v(20.0), v(5.0))
    off = G.offset_from_line(v(0.0), v(0.0), c("x"), c("y"), v(3.0), v(4.0))
    return p.select("id", F.round(d, 6).alias("d"), F.round(off, 6).alias("off"))


#: Signs before and after an element's letters: up to two minus, then one plus in front, up to two plus or minus behind; or none but signs.
CHARGED = "substr('--', 1, p_size % 3) || CASE WHEN p_partkey % 4 = 0 THEN '+' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE upper(substr(p_name, 1, 1)) END || substr(CASE WHEN p_partkey % 2 = 0 THEN '++' ELSE '--' END, 1, CAST(p_partkey % 3 AS INT))"


@query(f"""WITH l AS (SELECT p_partkey, {CHARGED} AS label FROM part), s AS (SELECT *, replace(replace(label, '-', ''), '+', '') AS bare, replace(label, '-', '') AS no_minus, length(label) - length(replace(label, '-', '')) AS minus, length(label) - length(replace(label, '+', '')) AS plus FROM l)
SELECT p_partkey, label, bare, (CASE WHEN bare = '' THEN 0 ELSE plus - greatest(length(no_minus) - length(ltrim(no_minus, '+')) - 1, 0) END
 - CASE WHEN bare = '' OR no_minus[1:1] = '+' THEN 0 ELSE minus - greatest(length(label) - length(ltrim(label, '-')) - 1, 0) END)::INT AS charge FROM s""")
def label_charge(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.expr(CHARGED).alias("label"))
    bare, charge = labels.signed_charge(F.col("label"))
    return part.select("p_partkey", "label", bare.alias("bare"), charge.alias("charge"))


@query("""SELECT l_orderkey, CASE WHEN count(*) > 1 THEN list_sort(list(l_quantity))[3 * (count(*) - 1) // 4 + 1] ELSE 10.0 END AS p75,
list_sort(list(l_extendedprice))[(count(*) - 1) // 2 + 1] AS median FROM lineitem GROUP BY ALL""")
def drawing_bond_length(spark, sf):
    """The forms for small groups, a drawing's bonds: an order's lines."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(stats.percentile75("l_quantity").alias("p75"), stats.lower_median("l_extendedprice").alias("median"))


def page_cells(spark, sf) -> DataFrame:
    """Pages of 32 by 32 cells, one an event; those of a large value are ink."""
    e = F.col("event_id")
    return table(spark, sf, "events").where("value > 40").select(F.expr("event_id div 1024").alias("page_no"), (e % 32).cast("int").alias("x"), F.expr("cast(event_id div 32 % 32 AS int)").alias("y"))


#: Rings by closure over successors; what encloses a ring by the parity of crossings to the left of its first upright side.
CURVES = """RECURSIVE ink AS (SELECT event_id // 1024 AS page_no, (event_id % 32)::INT AS x, (event_id // 32 % 32)::INT AS y FROM events WHERE value > 40),
s AS (SELECT i.page_no, i.x + sx AS x, i.y + sy AS y, side, i.x + sx + dx AS ex, i.y + sy + dy AS ey FROM ink i, (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 1, 0, 0, 1, 1, 0), (2, 1, 1, -1, 0, 0, 1), (3, 0, 1, 0, -1, -1, 0)) v(side, sx, sy, dx, dy, ox, oy)
      WHERE NOT EXISTS (SELECT 1 FROM ink j WHERE j.page_no = i.page_no AND j.x = i.x + ox AND j.y = i.y + oy)),
e AS (SELECT *, y::BIGINT * 67108864 + x * 4 + side AS id FROM s),
f AS (SELECT a.page_no, a.id, arg_min(b.id, (b.side - a.side + 5) % 4) AS nxt FROM e a JOIN e b ON a.page_no = b.page_no AND a.ex = b.x AND a.ey = b.y GROUP BY ALL),
r AS (SELECT page_no, id, nxt AS far FROM f UNION SELECT r.page_no, r.id, f.nxt FROM r JOIN f ON r.page_no = f.page_no AND r.far = f.id),
k AS (SELECT page_no, id, min(far) AS curve_id FROM r GROUP BY ALL),
own AS (SELECT page_no, curve_id, sum(x * ey - ex * y) / 2.0 AS area, count(*) AS length, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM k JOIN e USING (page_no, id) GROUP BY ALL),
u AS (SELECT page_no, curve_id, least(y, ey) AS line, x FROM k JOIN e USING (page_no, id) WHERE side % 2 = 1),
b AS (SELECT page_no, curve_id, line, x FROM u QUALIFY row_number() OVER (PARTITION BY page_no, curve_id ORDER BY line, x) = 1),
w AS (SELECT b.page_no, b.curve_id, u.curve_id AS parent_id FROM b JOIN u ON b.page_no = u.page_no AND b.line = u.line AND u.x < b.x AND u.curve_id <> b.curve_id GROUP BY ALL HAVING count(*) % 2 = 1),
p AS (SELECT w.page_no, w.curve_id, arg_min(w.parent_id, abs(own.area)) AS parent_id FROM w JOIN own ON own.page_no = w.page_no AND own.curve_id = w.parent_id GROUP BY ALL),
curves AS (SELECT own.page_no, own.curve_id, parent_id, area, length, x1, y1, x2, y2 FROM own LEFT JOIN p USING (page_no, curve_id))"""


@query(f"WITH {CURVES} SELECT * FROM curves")
def outline_tree(spark, sf):
    return outline.curves(outline.rings(page_cells(spark, sf), ["page_no"]), ["page_no"])


@query(f"""WITH {CURVES}, gone AS (SELECT page_no, curve_id FROM curves WHERE area > 12), more AS (FROM gone UNION SELECT c.page_no, c.curve_id FROM curves c JOIN gone g ON c.page_no = g.page_no AND c.parent_id = g.curve_id)
SELECT page_no, curve_id, length FROM curves ANTI JOIN more USING (page_no, curve_id)""")
def deleted_curves(spark, sf):
    tree = outline.curves(outline.rings(page_cells(spark, sf), ["page_no"]), ["page_no"]).withColumn("drop", F.col("area") > 12)
    return graph.without_curves(tree, tree, ["page_no"], children=True).select("page_no", "curve_id", "length")


#: What of a page's cells is ink: over a third of them, or most along lines eight cells apart.
DENSE, LINES = "value > 50", "value > 10 AND (event_id % 32 - event_id DIV 32 % 32) % 8 = 0"


def cell_segments(spark, sf, ink: str = DENSE) -> DataFrame:
    """Segments of pages drawn from cells, by the kernel that reads scans."""
    cells = table(spark, sf, "events").where(ink).select(F.lit(0).alias("doc_id"), F.expr("event_id div 1024").alias("page_no"), (F.col("event_id") % 32).alias("x"), F.expr("event_id div 32 % 32").alias("y"))
    return segment.measured(segment.find_segments(images.pages_of_cells(cells, 32, 32)))


#: Segments by closure over the eight neighbours, named in the order of their first cells; every second cell at a corner of which is no ink makes the margin.
SEGMENTS_OF = """RECURSIVE ink AS (SELECT (event_id // 1024)::INT AS page_no, (event_id % 32)::INT AS x, (event_id // 32 % 32)::INT AS y, event_id % 1024 AS id FROM events WHERE INK),
near AS (SELECT a.page_no, a.id, b.id AS far FROM ink a JOIN ink b ON a.page_no = b.page_no AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (FROM near UNION SELECT r.page_no, r.id, n.far FROM r JOIN near n ON r.page_no = n.page_no AND r.far = n.id),
low AS (SELECT page_no, id, min(far) AS root FROM r GROUP BY ALL),
big AS (SELECT page_no, root, (row_number() OVER (PARTITION BY page_no ORDER BY root) - 1)::INT AS segment_id FROM low GROUP BY page_no, root HAVING count(*) > 2),
seg AS (SELECT i.*, segment_id FROM ink i JOIN low USING (page_no, id) JOIN big USING (page_no, root)),
corner AS (SELECT a.page_no, a.id FROM ink a JOIN ink b ON a.page_no = b.page_no AND abs(a.x - b.x) = 1 AND abs(a.y - b.y) = 1 GROUP BY ALL HAVING count(*) = 4),
margin AS (SELECT page_no, segment_id, x, y FROM seg ANTI JOIN corner USING (page_no, id) QUALIFY row_number() OVER (PARTITION BY page_no, segment_id ORDER BY id) % 2 = 1)"""
SEGS, LINE_SEGS = (SEGMENTS_OF.replace("INK", i.replace("DIV", "//")) for i in (DENSE, LINES))


@query(f"""WITH {SEGS}, m AS (SELECT page_no, segment_id, count(*)::INT AS margin_points, sum(y * 32 + x) AS margin_sum FROM margin GROUP BY ALL),
b AS (SELECT page_no, segment_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*)::INT AS area FROM seg GROUP BY ALL)
SELECT b.*, CASE WHEN x2 = x1 THEN 0.0 ELSE round((y2 - y1) / (x2 - x1)::DOUBLE, 6) END::DOUBLE AS aspect, round(area / ((x2 - x1 + 1) * (y2 - y1 + 1))::DOUBLE, 6) AS fill, margin_points, margin_sum::BIGINT AS margin_sum FROM b JOIN m USING (page_no, segment_id)""")
def page_segments(spark, sf):
    digest = F.aggregate("margin", F.lit(0).cast("long"), lambda s, p: s + p["y"] * 32 + p["x"])
    return cell_segments(spark, sf).select("page_no", "segment_id", "x1", "y1", "x2", "y2", "area", F.round("aspect", 6).alias("aspect"), F.round("fill", 6).alias("fill"), F.size("margin").alias("margin_points"), digest.alias("margin_sum"))


@query(f"""WITH {SEGS}, n AS (SELECT page_no, segment_id, count(*) AS area FROM seg GROUP BY ALL),
g AS (SELECT a.page_no, a.segment_id AS id1, b.segment_id AS id2, min(greatest(abs(a.x - b.x), abs(a.y - b.y))) AS d FROM margin a JOIN margin b ON a.page_no = b.page_no AND a.segment_id < b.segment_id WHERE abs(a.x - b.x) < 4 AND abs(a.y - b.y) < 4 GROUP BY ALL)
SELECT g.*, (greatest(a.area, b.area) // least(a.area, b.area))::INT AS ratio FROM g JOIN n a ON a.page_no = g.page_no AND a.segment_id = id1 JOIN n b ON b.page_no = g.page_no AND b.segment_id = id2""")
def segment_gaps(spark, sf):
    return segment.distances(cell_segments(spark, sf), 4).select("page_no", "id1", "id2", "d", "ratio")


@query(f"""WITH {LINE_SEGS}, e AS (SELECT DISTINCT a.page_no, a.segment_id AS a, b.segment_id AS b FROM margin a JOIN margin b ON a.page_no = b.page_no AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3),
c AS (FROM e UNION SELECT c.page_no, c.a, e.b FROM c JOIN e ON c.page_no = e.page_no AND c.b = e.a),
k AS (SELECT page_no, a AS segment_id, min(b) AS cluster FROM c GROUP BY ALL),
s AS (SELECT page_no, segment_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS n FROM seg GROUP BY ALL),
f AS (SELECT *, n / ((x2 - x1 + 1) * (y2 - y1 + 1))::DOUBLE AS fill, CASE WHEN x2 = x1 THEN 0.0 ELSE (y2 - y1) / (x2 - x1)::DOUBLE END AS aspect FROM s),
b AS (SELECT page_no, cluster, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum(n)::BIGINT AS n FROM f JOIN k USING (page_no, segment_id) GROUP BY ALL HAVING bool_or(fill < 0.2 AND aspect > 0.1 AND aspect < 10))
SELECT page_no, x1, y1, x2, y2, n, (row_number() OVER (PARTITION BY page_no ORDER BY y1, x1, y2, x2, cluster) - 1)::INT AS box_id FROM b""")
def drawing_boxes(spark, sf):
    """Segments nearer than 3 cells as drawings, those of them that hold a sparse segment."""
    m = cell_segments(spark, sf, LINES)
    return segment.drawing_boxes(segment.clusters(m, segment.distances(m, 4), 3)).drop("doc_id")


def page_glyphs(spark, sf) -> DataFrame:
    """A character a part, 200 a page."""
    k = F.col("p_partkey")
    box = [(k * 37 % 600).alias("x1"), (k * 53 % 450).alias("y1"), (k * 37 % 600 + 5 + F.col("p_size") % 3).alias("x2"), (k * 53 % 450 + 9 + F.col("p_size") % 4).alias("y2")]
    return table(spark, sf, "part").select(F.expr("p_partkey div 200").alias("page_no"), k.alias("glyph_id"), F.substring("p_name", 1, 1).alias("a"), *box)


@query("""WITH RECURSIVE g AS (SELECT p_partkey // 200 AS page_no, p_partkey AS id, p_name[1:1] AS a, p_partkey * 37 % 600 AS x1, p_partkey * 53 % 450 AS y1, p_partkey * 37 % 600 + 5 + p_size % 3 AS x2, p_partkey * 53 % 450 + 9 + p_size % 4 AS y2 FROM part),
w AS (SELECT s_suppkey // 10 AS page_no, s_suppkey AS arrow_id, s_suppkey * 71 % 600 AS tx, s_suppkey * 29 % 450 AS ty, (s_suppkey * 131 + 90) % 600 AS hx, s_suppkey * 89 % 450 AS hy FROM supplier),
e AS (SELECT a.page_no, a.id AS a, b.id AS b FROM g a JOIN g b USING (page_no) WHERE a.id <> b.id AND greatest(a.x1, b.x1) < least(a.x2, b.x2) + 11 AND greatest(a.y1, b.y1) < least(a.y2, b.y2) + 11),
r AS (SELECT page_no, id, id AS seen FROM g UNION SELECT r.page_no, r.id, e.b FROM r JOIN e ON r.page_no = e.page_no AND r.seen = e.a),
c AS (SELECT page_no, id, min(seen) AS component FROM r GROUP BY ALL),
m AS (SELECT g.*, component, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM g JOIN c USING (page_no, id)),
s AS (SELECT m.page_no, component, m.id, arrow_id, ((hy - ty) * (x - tx) - (hx - tx) * (y - ty)) / l AS off, ((hx - tx) * (x - tx) + (hy - ty) * (y - ty)) / l AS along, l
      FROM m JOIN (SELECT *, sqrt((hx - tx) ** 2 + (hy - ty) ** 2) AS l FROM w) w ON m.page_no = w.page_no WHERE l > 0),
b AS (SELECT page_no, component, arrow_id FROM s WHERE abs(off) < 22 AND along >= 0 AND along <= l QUALIFY row_number() OVER (PARTITION BY page_no, component ORDER BY abs(off), arrow_id, id) = 1),
n AS (SELECT m.*, arrow_id, hx < tx OR (hx = tx AND hy < ty) AS back, tx, ty, hx, hy FROM m JOIN b USING (page_no, component) JOIN w USING (page_no, arrow_id)),
o AS (SELECT page_no, id, a, x, y, arrow_id, x2 - x1 + 1 AS gw, y2 - y1 + 1 AS gh, CASE WHEN back THEN hx ELSE tx END::DOUBLE AS ax, CASE WHEN back THEN hy ELSE ty END::DOUBLE AS ay, CASE WHEN back THEN tx ELSE hx END::DOUBLE AS bx, CASE WHEN back THEN ty ELSE hy END::DOUBLE AS b_y FROM n),
q AS (SELECT *, sqrt((bx - ax) ** 2 + (b_y - ay) ** 2) AS l FROM o),
t AS (SELECT *, round(((bx - ax) * (x - ax) + (b_y - ay) * (y - ay)) / l, 6) AS along, round(-(((b_y - ay) * (x - ax) - (bx - ax) * (y - ay)) / l), 6) AS across,
      round(gw * (abs(bx - ax) / l) + gh * (abs(b_y - ay) / l), 6) AS tw, round(gw * (abs(b_y - ay) / l) + gh * (abs(bx - ax) / l), 6) AS th FROM q),
v AS (SELECT *, avg(tw) OVER a AS mean_w, avg(th) OVER a AS mean_h, coalesce(lag(across) OVER d + avg(th) OVER a / 2 < across, false)::INT AS fresh FROM t
      WINDOW a AS (PARTITION BY page_no, arrow_id), d AS (PARTITION BY page_no, arrow_id ORDER BY across, along, id)),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY page_no, arrow_id ORDER BY across, along, id) AS line FROM v),
y AS (SELECT *, CASE WHEN (along - tw / 2) - (lag(along) OVER l + lag(tw) OVER l / 2) > mean_w / 2 THEN ' ' || a ELSE a END AS part FROM z WINDOW l AS (PARTITION BY page_no, arrow_id, line ORDER BY along, id))
SELECT page_no, arrow_id, line::BIGINT AS line, string_agg(part, '' ORDER BY along, id) AS agent FROM y GROUP BY ALL""")
def agent_lines(spark, sf):
    k = F.col("s_suppkey")
    arrows = table(spark, sf, "supplier").select(F.expr("s_suppkey div 10").alias("page_no"), k.alias("arrow_id"), (k * 71 % 600).alias("tail_x"), (k * 29 % 450).alias("tail_y"), ((k * 131 + 90) % 600).alias("head_x"), (k * 89 % 450).alias("head_y"))
    return agents.agent_strings(page_glyphs(spark, sf), arrows, ["page_no"])


@query("""WITH d AS (SELECT p_partkey // 100 AS page_no, p_partkey AS id, (p_partkey * 37 % 60)::DOUBLE AS x1, (p_partkey * 53 % 60)::DOUBLE AS y1, p_partkey % 7 - 3 AS ux, p_partkey % 5 - 2 AS uy, 1 + p_size / 10.0 AS k FROM part),
s AS (SELECT page_no, id, x1, y1, x1 + ux * k AS x2, y1 + uy * k AS y2, round(sqrt((ux * k) ** 2 + (uy * k) ** 2), 6) AS size FROM d),
ink AS (SELECT DISTINCT l_partkey // 100 AS page_no, round(l_extendedprice)::BIGINT % 60 AS x, (l_orderkey * 7 + l_linenumber) % 60 AS y FROM lineitem),
f AS (SELECT s.page_no, s.id AS short, t.id AS long, s.size AS short_size, s.x1 AS sx1, s.y1 AS sy1, s.x2 AS sx2, s.y2 AS sy2, t.x1, t.y1, t.x2, t.y2, sqrt((t.x2 - t.x1) ** 2 + (t.y2 - t.y1) ** 2) AS l,
      ((t.y2 - t.y1) * ((s.x1 + s.x2) / 2 - t.x1) - (t.x2 - t.x1) * ((s.y1 + s.y2) / 2 - t.y1)) / l AS off, ((t.x2 - t.x1) * ((s.x1 + s.x2) / 2 - t.x1) + (t.y2 - t.y1) * ((s.y1 + s.y2) / 2 - t.y1)) / l AS along,
      round(greatest(abs((t.y2 - t.y1) * (s.x1 - t.x1) - (t.x2 - t.x1) * (s.y1 - t.y1)), abs((t.y2 - t.y1) * (s.x2 - t.x1) - (t.x2 - t.x1) * (s.y2 - t.y1))) / l, 6) AS gap
      FROM s JOIN s t ON s.page_no = t.page_no AND s.id <> t.id AND s.size > 0 AND t.size > 0 AND (t.size > s.size OR (t.size = s.size AND t.id < s.id))
      WHERE ((s.x2 - s.x1) * (t.x2 - t.x1) + (s.y2 - s.y1) * (t.y2 - t.y1)) / (s.size * t.size) < -0.95),
n AS (SELECT *, unnest([0.0625, 0.1875, 0.3125, 0.4375, 0.5625, 0.6875, 0.8125, 0.9375]::DOUBLE[]) AS at_ FROM f WHERE off < 0 AND off > -8.3 AND along >= 0 AND along <= l AND gap < 8.3),
o AS (SELECT *, sx1 + (sx2 - sx1) * at_ AS px, sy1 + (sy2 - sy1) * at_ AS py FROM n),
q AS (SELECT *, ((x2 - x1) * (px - x1) + (y2 - y1) * (py - y1)) / l / l AS part FROM o),
h AS (SELECT page_no, short, long, floor(round((px + x1 + (x2 - x1) * part) / 2, 6))::BIGINT AS x, floor(round((py + y1 + (y2 - y1) * part) / 2, 6))::BIGINT AS y FROM q),
i AS (SELECT page_no, short, long FROM h SEMI JOIN ink USING (page_no, x, y) GROUP BY ALL HAVING count(*) >= 4),
b AS (SELECT f.page_no, short, f.long, gap, short_size, (x2 - x1) * (sx2 - x1) + (y2 - y1) * (sy2 - y1) AS first, (x2 - x1) * (sx1 - x1) + (y2 - y1) * (sy1 - y1) AS last, l, x1, y1, x2, y2 FROM f SEMI JOIN i USING (page_no, short, long) QUALIFY row_number() OVER (PARTITION BY page_no, short ORDER BY gap, f.long) = 1),
r AS (SELECT *, count(*) OVER (PARTITION BY page_no, long) AS members FROM b ANTI JOIN (SELECT page_no, short AS long FROM b) z USING (page_no, long) QUALIFY row_number() OVER (PARTITION BY page_no, long ORDER BY short_size DESC, gap, short) = 1),
a AS (SELECT *, least(0, first / l) AS lo, greatest(l, last / l) AS hi, (x2 - x1) / l AS ux, (y2 - y1) / l AS uy FROM r)
SELECT page_no, long AS id, round(x1 + ux * lo - uy * gap / 2, 5) AS x1, round(y1 + uy * lo + ux * gap / 2, 5) AS y1, round(x1 + ux * hi - uy * gap / 2, 5) AS x2, round(y1 + uy * hi + ux * gap / 2, 5) AS y2, gap AS width, members FROM a""")
def stroke_bonds(spark, sf):
    k, n = F.col("p_partkey"), 1 + F.col("p_size") / 10.0
    x, y = (k * 37 % 60).cast("double"), (k * 53 % 60).cast("double")
    sides = table(spark, sf, "part").select(F.expr("p_partkey div 100").alias("page_no"), k.alias("id"), x.alias("x1"), y.alias("y1"), (x + (k % 7 - 3) * n).alias("x2"), (y + (k % 5 - 2) * n).alias("y2"))
    cells = table(spark, sf, "lineitem").select(F.expr("l_partkey div 100").alias("page_no"), (F.round("l_extendedprice").cast("long") % 60).alias("x"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 60).alias("y")).distinct()
    got = strokes.strokes(sides, cells, 8.3, ["page_no"])
    return got.select("page_no", "id", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")], "width", "members")


@query("""WITH p AS (SELECT l_orderkey AS curve_id, l_quantity AS x, (l_suppkey % 12)::DOUBLE AS y FROM lineitem), c AS (SELECT o_orderkey AS curve_id, o_custkey AS page_no, o_totalprice / 1000 - 50 AS area FROM orders),
g AS (SELECT page_no, curve_id, area, max(x) - min(x) > max(y) - min(y) AS wide FROM p JOIN c USING (curve_id) WHERE area > 0 AND area <= 300 GROUP BY ALL HAVING count(*) > 2),
m AS (SELECT g.*, x, y FROM g JOIN p USING (curve_id)),
e AS (SELECT page_no, curve_id, area, CASE WHEN wide THEN arg_min(x, (x, y)) ELSE arg_min(x, (y, x)) END AS x1, CASE WHEN wide THEN arg_min(y, (x, y)) ELSE arg_min(y, (y, x)) END AS y1,
      CASE WHEN wide THEN arg_max(x, (x, -y)) ELSE arg_max(x, (y, -x)) END AS x2, CASE WHEN wide THEN arg_max(y, (x, -y)) ELSE arg_max(y, (y, -x)) END AS y2 FROM m GROUP BY page_no, curve_id, area, wide),
o AS (SELECT e.*, max(CASE WHEN x1 <> x2 OR y1 <> y2 THEN abs((y2 - y1) * (x - x1) - (x2 - x1) * (y - y1)) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) END) AS off FROM e JOIN p USING (curve_id) GROUP BY ALL)
SELECT page_no, curve_id, x1, y1, x2, y2 FROM o WHERE area < 40 OR off < 2.5""")
def small_straight_curves(spark, sf):
    points = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("curve_id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_suppkey") % 12).cast("double").alias("y"))
    curves = table(spark, sf, "orders").select(F.col("o_orderkey").alias("curve_id"), F.col("o_custkey").alias("page_no"), (F.col("o_totalprice") / 1000 - 50).alias("area"))
    points = points.join(curves.select("curve_id", "page_no"), "curve_id")
    return strokes.small_bonds(points, curves, ["page_no"], 300.0, 40.0, 2.5)


def upright_strokes(spark, sf) -> DataFrame:
    """A stroke a part, 100 a page: upright, slanted or level by its number."""
    k, n = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 37 % 240).cast("double"), (k * 53 % 180).cast("double")
    return table(spark, sf, "part").select(F.expr("p_partkey div 100").alias("page_no"), k.alias("bond_idx"), x.alias("x1"), y.alias("y1"), (x + k % 5 * 2).alias("x2"), (y + 6 + n % 20).alias("y2"), (1 + F.floor(n / 45)).cast("int").alias("type"), (k % 7 != 0).alias("alone"))


STROKES = """b AS (SELECT p_partkey // 100 AS page_no, p_partkey AS bond_idx, (p_partkey * 37 % 240)::DOUBLE AS x1, (p_partkey * 53 % 180)::DOUBLE AS y1, p_partkey * 37 % 240 + p_partkey % 5 * 2 AS x2, p_partkey * 53 % 180 + 6 + p_size % 20 AS y2, (1 + p_size // 45)::INT AS type, p_partkey % 7 <> 0 AS alone FROM part),
l AS (SELECT s_suppkey // 5 AS page_no, s_suppkey AS letter_idx, (s_suppkey * 71 % 240)::DOUBLE AS x, (s_suppkey * 29 % 180)::DOUBLE AS y, 6.0::DOUBLE + s_suppkey % 4 AS r FROM supplier)"""


@query(f"""WITH RECURSIVE {STROKES}, t AS (SELECT page_no, bond_idx AS id, (x1 + x2) / 2 AS sx, (y1 + y2) / 2 AS sy, x1, y1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS size FROM b WHERE type = 1 AND alone AND abs(x1 - x2) < abs(y1 - y2)),
s AS (SELECT * FROM t WHERE size > 7 AND size < 22),
m AS (SELECT s.*, letter_idx, x, y, r, sqrt((sx - x) ** 2 + (sy - y) ** 2) AS d FROM s JOIN l USING (page_no)),
p AS (SELECT page_no, id, letter_idx, row_number() OVER (PARTITION BY page_no ORDER BY round(d, 6), id, letter_idx) AS k FROM m WHERE d < 44 AND d < size / 2 + r AND abs(sy - y) < least(size / 2, r)),
g AS (SELECT page_no, 0::BIGINT AS k, []::BIGINT[] AS ids, []::BIGINT[] AS letters, NULL::BIGINT AS id FROM (SELECT DISTINCT page_no FROM p)
      UNION ALL SELECT g.page_no, p.k, CASE WHEN free THEN list_append(ids, p.id) ELSE ids END, CASE WHEN free THEN list_append(letters, letter_idx) ELSE letters END, CASE WHEN free THEN p.id END
      FROM g JOIN p ON p.page_no = g.page_no AND p.k = g.k + 1, LATERAL (SELECT NOT list_contains(ids, p.id) AND NOT list_contains(letters, letter_idx) AS free)),
c AS (SELECT page_no, id FROM g WHERE id IS NOT NULL),
i AS (SELECT DISTINCT page_no, id FROM m WHERE d < 44 AND least(abs(((x2 - x1) * (x - x1) + (y2 - y1) * (y - y1)) / size), abs(((x2 - x1) * (x - x2) + (y2 - y1) * (y - y2)) / size)) - r <= size / 2 AND abs(((y2 - y1) * (x - x1) - (x2 - x1) * (y - y1)) / size) <= r / 2),
u AS (SELECT page_no, id FROM s ANTI JOIN i USING (page_no, id) WHERE abs(x1 - x2) < 3 AND abs(y1 - y2) > 7)
SELECT page_no, id AS bond_idx, a, sx AS x, sy AS y, round(size / 2, 6) AS r FROM (SELECT page_no, id, 'l' AS a FROM c UNION ALL SELECT page_no, id, 'I' FROM u ANTI JOIN c USING (page_no, id)) JOIN s USING (page_no, id)""")
def stroke_characters(spark, sf):
    k = F.col("s_suppkey")
    letters = table(spark, sf, "supplier").select(F.expr("s_suppkey div 5").alias("page_no"), k.alias("letter_idx"), (k * 71 % 240).cast("double").alias("x"), (k * 29 % 180).cast("double").alias("y"), (6.0 + k % 4).alias("r"))
    return claims.stroke_letters(upright_strokes(spark, sf), letters, ["page_no"], 7.0, 22.0).withColumn("r", F.round("r", 6))


@query(f"""WITH {STROKES}, x AS (SELECT page_no, letter_idx AS box, x - 9 AS bx1, y - 12 AS by1, x + 9 AS bx2, y + 12 AS by2 FROM l)
SELECT page_no, bond_idx, x1, y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.page_no = b.page_no AND x1 BETWEEN bx1 AND bx2 AND y1 BETWEEN by1 AND by2 AND x2 BETWEEN bx1 AND bx2 AND y2 BETWEEN by1 AND by2)""")
def bonds_outside_glyphs(spark, sf):
    k = F.col("s_suppkey")
    x, y = k * 71 % 240, k * 29 % 180
    boxes = table(spark, sf, "supplier").select(F.expr("s_suppkey div 5").alias("page_no"), k.alias("box"), (x - 9).alias("x1"), (y - 12).alias("y1"), (x + 9).alias("x2"), (y + 12).alias("y2"))
    return claims.bonds_outside_glyphs(upright_strokes(spark, sf), boxes, ["page_no"]).select("page_no", "bond_idx", "x1", "y1", "x2", "y2")


@query("""WITH RECURSIVE e AS (SELECT l_orderkey, l_linenumber AS bond_idx, l_partkey % 9 AS a, l_suppkey % 9 AS b, l_quantity::DOUBLE AS x1, (l_partkey % 30)::DOUBLE AS y1, l_quantity + l_linenumber AS x2, l_partkey % 30 + l_suppkey % 7 AS y2 FROM lineitem WHERE l_partkey % 9 <> l_suppkey % 9),
n AS (SELECT l_orderkey, a, b FROM e UNION SELECT l_orderkey, b, a FROM e),
r AS (SELECT l_orderkey, a AS node, a AS seen FROM n UNION SELECT r.l_orderkey, r.node, n.b FROM r JOIN n ON r.l_orderkey = n.l_orderkey AND r.seen = n.a),
c AS (SELECT l_orderkey, node, min(seen) AS component FROM r GROUP BY ALL),
g AS (SELECT e.l_orderkey, component, min(least(x1, x2)) AS x1, min(least(y1, y2)) AS y1, max(greatest(x1, x2)) AS x2, max(greatest(y1, y2)) AS y2, count(*) AS n FROM e JOIN c ON c.l_orderkey = e.l_orderkey AND c.node = e.a GROUP BY ALL)
SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 2, 6) AS r FROM g WHERE x2 - x1 < 30 AND y2 - y1 < 25 AND n > 1""")
def unread_characters(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem").where("l_partkey % 9 <> l_suppkey % 9")
    x, y = c("l_quantity").cast("double"), (c("l_partkey") % 30).cast("double")
    bonds = li.select("l_orderkey", c("l_linenumber").alias("bond_idx"), (c("l_partkey") % 9).alias("a"), (c("l_suppkey") % 9).alias("b"), x.alias("x1"), y.alias("y1"), (x + c("l_linenumber")).alias("x2"), (y + c("l_suppkey") % 7).alias("y2"))
    return claims.unread_groups(bonds, ["l_orderkey"], 30.0, 25.0, 1).withColumn("r", F.round("r", 6))


@query("""WITH g AS (SELECT p_partkey // 200 AS page_no, p_partkey AS id, p_partkey * 37 % 151 AS x1, p_partkey * 53 % 127 AS y1, p_partkey * 37 % 151 + 5 + p_size % 3 AS x2, p_partkey * 53 % 127 + 9 + p_size % 4 AS y2, p_size % 3 = 0 AS digit FROM part),
m AS (SELECT d.page_no, d.id AS mark, l.id AS glyph, abs(d.x1 - l.x2) AS gap FROM g d JOIN g l ON d.page_no = l.page_no AND d.digit AND NOT l.digit
      WHERE d.x1 BETWEEN l.x2 - (l.x2 - l.x1 + 1) * 0.25 AND l.x2 + (l.x2 - l.x1 + 1) AND (d.y1 + d.y2) / 2 BETWEEN (l.y1 + l.y2) / 2 AND l.y2 + (l.y2 - l.y1 + 1) * 0.5)
SELECT page_no, mark, glyph FROM m QUALIFY row_number() OVER (PARTITION BY page_no, mark ORDER BY gap, glyph) = 1""")
def subscript_letters(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    x, y = k * 37 % 151, k * 53 % 127
    g = table(spark, sf, "part").select(F.expr("p_partkey div 200").alias("page_no"), k.alias("glyph_idx"), x.alias("x1"), y.alias("y1"), (x + 5 + n % 3).alias("x2"), (y + 9 + n % 4).alias("y2"), (n % 3 == 0).alias("digit"))
    return claims.subscripts(g.where("not digit"), g.where("digit"), ["page_no"])


@query("""WITH p AS (SELECT DISTINCT l_orderkey, round(l_extendedprice / 10000, 2) AS gap, 16.0::DOUBLE AS average FROM lineitem WHERE l_extendedprice / 10000 < 8),
s AS (SELECT *, coalesce(lead(gap) OVER (PARTITION BY l_orderkey ORDER BY gap), average / 2) - gap AS step FROM p WHERE gap < average / 2)
SELECT l_orderkey, round(gap + least(step / 2, average / 16), 6) AS reach FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY step DESC, gap DESC) = 1""")
def double_bond_gaps(spark, sf):
    """Gaps of parallel lines of a drawing: an order's prices."""
    li = table(spark, sf, "lineitem")
    pairs = li.select("l_orderkey", F.round(F.col("l_extendedprice") / 10000, 2).alias("gap"), F.lit(16.0).alias("average")).where(li["l_extendedprice"] / 10000 < 8)
    return tidy.double_gaps(pairs, ["l_orderkey"]).withColumn("reach", F.round("reach", 6))


@query("""WITH b AS (SELECT DISTINCT l_orderkey, (l_partkey % 6 * 6 + l_suppkey % 6)::INT AS bond_idx, (l_partkey % 6)::INT AS a, (l_suppkey % 6)::INT AS b FROM lineitem WHERE l_partkey % 6 <> l_suppkey % 6),
p AS (SELECT DISTINCT l_orderkey, n AS atom_idx, ((l_orderkey * 31 + n * 37) % 97)::DOUBLE AS x, ((l_orderkey * 17 + n * 53) % 89)::DOUBLE AS y FROM lineitem, (SELECT unnest(range(6))::INT AS n)),
l AS (SELECT b.*, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2) AS len FROM b JOIN p ON p.l_orderkey = b.l_orderkey AND p.atom_idx = a JOIN p q ON q.l_orderkey = b.l_orderkey AND q.atom_idx = b),
o AS (SELECT p.* FROM p WHERE EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = p.l_orderkey AND (b.a = p.atom_idx OR b.b = p.atom_idx))),
m AS (SELECT l.l_orderkey, bond_idx, atom_idx, ((x2 - x1) * (x - x1) + (y2 - y1) * (y - y1)) / len AS along, ((y2 - y1) * (x - x1) - (x2 - x1) * (y - y1)) / len AS off, len FROM l JOIN o ON o.l_orderkey = l.l_orderkey AND atom_idx <> a AND atom_idx <> b WHERE len > 0),
j AS (SELECT l_orderkey, bond_idx, list(atom_idx ORDER BY along, atom_idx) AS joints FROM m WHERE abs(off) < 6 AND along > 6 AND along < len - 6 GROUP BY ALL),
e AS (SELECT b.*, list_concat([a], coalesce(joints, []), [b]) AS ends FROM b LEFT JOIN j USING (l_orderkey, bond_idx)),
k AS (SELECT l_orderkey, bond_idx, ends, unnest(range(1, len(ends))) AS k FROM e)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY bond_idx, k) - 1)::INT AS bond_idx, ends[k] AS a, ends[k + 1] AS b, 1 AS type FROM k""")
def bonds_split_at_joints(spark, sf):
    """A graph an order of six atoms, its bonds between those that its lines name."""
    c, li = F.col, table(spark, sf, "lineitem")
    a, b = (c("l_partkey") % 6).cast("int"), (c("l_suppkey") % 6).cast("int")
    bonds = li.where("l_partkey % 6 <> l_suppkey % 6").select("l_orderkey", (a * 6 + b).alias("bond_idx"), a.alias("a"), b.alias("b"), F.lit(1).alias("type")).distinct()
    atoms = li.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("atom_idx"))
    atoms = atoms.select("*", ((c("l_orderkey") * 31 + c("atom_idx") * 37) % 97).cast("double").alias("x"), ((c("l_orderkey") * 17 + c("atom_idx") * 53) % 89).cast("double").alias("y"))
    return tidy.split_at_joints(atoms, bonds, 6.0, ["l_orderkey"])
