"""Registered queries of the catalog library, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalume.functions import units
from catalume.operators import graphs as g
from catalume.operators import hierarchy as h
from catalume.operators import nodes as p
from catalume.operators import similarity as j
from catalume.operators import strength as a
from catalume.operators import threshold as th
from catalume.sources import catalog
from catalume.sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_tables = {"part": "part", "lineitem": "lineitem"}
UNITS = "(VALUES " + ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in units.PER_ML.items()) + ")"
ABV = "(VALUES " + ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in units.DEFAULT_ABV.items()) + ")"
WITH = f"""WITH RECURSIVE nodes AS ({catalog.NODES_SQL.format(**_tables)}), lines AS ({catalog.LINES_SQL.format(**_tables)}),
paths AS (SELECT node_id, [node_id] AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, list_append(q.path, n.node_id) FROM nodes n JOIN paths q ON n.parent_id = q.node_id),
closure AS (SELECT node_id, path[i] AS ancestor_id, CAST(i AS INT) AS depth FROM (SELECT node_id, path, unnest(range(1, len(path) + 1)) AS i FROM paths)),
rated AS (SELECT nodes.*, CASE WHEN d.abv IS NOT NULL THEN coalesce(abv_stated, d.abv) END AS abv FROM nodes LEFT JOIN {ABV} d(k, abv) ON kind = d.k),
priced AS (SELECT *, CASE WHEN kind IN ('Bottle','Liquor','AperitifDigestif','Liqueur','Syrup','Bitters') THEN unit_cost / (volume_ml / 1.0 * (1/29.57::DOUBLE)) WHEN kind = 'Juice' THEN unit_cost / unit_count / (volume_ml / 1.0 * (1/29.57::DOUBLE)) END AS cost_oz,
  CASE WHEN kind IN ('Fruit','Garnish') THEN unit_cost / unit_count END AS cost_count FROM nodes),
guess AS (SELECT ancestor_id AS node_id, round(median(cost_oz), 2) AS cost_oz_guess FROM closure c JOIN priced n USING (node_id) WHERE node_id <> ancestor_id AND cost_oz IS NOT NULL GROUP BY 1),
strength AS (SELECT recipe_id, sum(CASE WHEN abv IS NOT NULL THEN amount / per_ml * (1/29.57::DOUBLE) * abv END) / sum(CASE WHEN abv IS NOT NULL THEN amount / per_ml * (1/29.57::DOUBLE) END) AS abv FROM lines LEFT JOIN rated USING (node_id) LEFT JOIN {UNITS} u(unit, per_ml) USING (unit) GROUP BY 1),
edges1 AS (SELECT recipe_id, path[i] AS src, path[i+1] AS dst FROM (SELECT recipe_id, path, unnest(range(1, len(path))) AS i FROM lines JOIN nodes USING (node_id) JOIN paths USING (node_id) WHERE kind <> 'Garnish')
  UNION ALL SELECT recipe_id, node_id, 'R:' || recipe_id FROM lines JOIN nodes USING (node_id) WHERE kind <> 'Garnish'),
edges2 AS (SELECT DISTINCT * FROM edges1 WHERE src <> 'root' AND dst <> 'root'),
pairs AS (SELECT * FROM (SELECT CAST(o_orderkey AS STRING) AS r1, lead(CAST(o_orderkey AS STRING)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r2 FROM orders) WHERE r2 IS NOT NULL),
edges3 AS (SELECT DISTINCT r1 || '+' || r2 AS pair_id, src, dst FROM pairs JOIN edges2 ON recipe_id IN (r1, r2)),
scorable AS (SELECT lines.* FROM lines JOIN nodes USING (node_id) WHERE kind NOT IN ('Garnish','Bitters'))
"""


def _scores(lines: str, pairs: str = "") -> str:
    """Pair scores by definition: the best over the other's lines, then the mean. ``pairs``: a join with the pairs to score."""
    return f"""
kept AS MATERIALIZED (SELECT DISTINCT recipe_id, node_id FROM {lines}),
held AS MATERIALIZED (SELECT DISTINCT recipe_id AS r2, ancestor_id FROM kept JOIN closure USING (node_id)),
best AS (SELECT r1, r2, node1, CASE WHEN k.node_id IS NOT NULL THEN 1.0 ELSE 1.0 - pow(0.5::DOUBLE, d - 1) END AS score FROM (
  SELECT x.recipe_id AS r1, h.r2, x.node_id AS node1, max(c.depth) AS d FROM kept x JOIN closure c USING (node_id) {pairs} JOIN held h ON h.ancestor_id = c.ancestor_id{' AND h.r2 = cand.r2' if pairs else ''} GROUP BY 1, 2, 3)
  LEFT JOIN kept k ON k.recipe_id = r2 AND k.node_id = node1),
sizes AS (SELECT recipe_id, count(*) AS n FROM {lines} GROUP BY 1),
weights AS (SELECT recipe_id AS r1, node_id AS node1, count(*) AS n FROM {lines} GROUP BY 1, 2),
directed AS (SELECT r1, r2, sum(b.score * w.n) / max(sizes.n) AS score FROM best b JOIN weights w USING (r1, node1) JOIN sizes ON sizes.recipe_id = r1 GROUP BY 1, 2),
mutual AS (SELECT x.r1, x.r2, x.score AS k12, y.score AS k21, (x.score + y.score) / 2 AS score FROM directed x JOIN directed y ON x.r1 = y.r2 AND x.r2 = y.r1)
"""


#: What each recipe's lines come to at every ancestor and at the node itself; scores follow from what two recipes share.
_OWN = """counted AS MATERIALIZED (SELECT recipe_id, node_id, count(*) AS n FROM scorable GROUP BY 1, 2),
own AS MATERIALIZED (SELECT recipe_id, key, max(gain) AS gain, sum(n) AS n FROM (
  SELECT recipe_id, 'a:' || ancestor_id AS key, pow(0.5::DOUBLE, depth - 1) AS gain, n FROM counted JOIN closure USING (node_id)
  UNION ALL SELECT recipe_id, 'n:' || node_id, pow(0.5::DOUBLE, len(path) - 1), n FROM counted JOIN paths USING (node_id)) GROUP BY 1, 2),
sizes AS MATERIALIZED (SELECT recipe_id, sum(n) AS size FROM counted GROUP BY 1)"""


class Tables(catalog.OrderCatalog):
    """The order catalog with what many queries need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self._paths = None
        #: Every customer's orders, each with the next.
        from pyspark.sql import Window

        following = F.lead("recipe_id").over(Window.partitionBy("o_custkey").orderBy("ord"))
        self.pairs = self.recipes.select(F.col("recipe_id").alias("r1"), following.alias("r2")).where("r2 IS NOT NULL").withColumn("pair_id", F.concat_ws("+", "r1", "r2"))

    @property
    def paths(self) -> DataFrame:
        if self._paths is None:
            self._paths = h.lineage_paths(self.nodes)
        return self._paths


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else WITH + sql
        return f

    return register


#: What the order tables mean as a catalog, written apart from the text that both sides of the other queries share.
_STATED_NODES = """WITH named AS (SELECT *, format('{}/{}', p_type, p_brand) AS brand_path, format('{}/{}/{}', p_type, p_brand, p_name) AS name_path FROM part),
above AS (SELECT DISTINCT unnest([{'id': 'N:' || name_path, 'up': 'B:' || brand_path}, {'id': 'B:' || brand_path, 'up': 'T:' || p_type}, {'id': 'T:' || p_type, 'up': 'root'}, {'id': 'root', 'up': NULL}]) AS x FROM named)
SELECT format('P:{}', p_partkey) AS node_id, 'N:' || name_path AS parent_id, p_name AS name, list_extract(['Garnish', 'Bitters', 'Fruit', 'Juice', 'Liquor', 'Liquor', 'Liqueur', 'Liqueur', 'Syrup', 'AperitifDigestif'], CAST(p_partkey % 10 + 1 AS INT)) AS kind,
  p_partkey AS ord, CASE p_size % 3 WHEN 0 THEN p_size / 100 END AS abv_stated, p_retailprice AS unit_cost, p_size * 10::DOUBLE AS volume_ml, p_size::BIGINT AS unit_count FROM named
UNION ALL SELECT x.id, x.up, x.id, 'Ingredient', 0, NULL, NULL, NULL, NULL FROM above"""
_STATED_LINES = """WITH packed AS (SELECT l_orderkey, list({'key': l_partkey, 'path': format('{}/{}/{}', p_type, p_brand, p_name), 'supplier': l_suppkey, 'number': l_linenumber, 'quantity': l_quantity}
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS ls FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY l_orderkey),
each AS (SELECT l_orderkey, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM packed)
SELECT l_orderkey::VARCHAR AS recipe_id, i::INT AS pos, CASE l.supplier % 5 WHEN 0 THEN 'N:' || l.path ELSE format('P:{}', l.key) END AS node_id, l.quantity::DOUBLE AS amount,
  CASE WHEN l.supplier % 5 > 0 AND (l.key % 10 = 0 OR l.key % 10 = 2) THEN 'count' ELSE coalesce(list_extract(['oz', 'oz', 'dash', 'drop', 'splash', 'mL'], l.number), 'barspoon') END AS unit FROM each"""


@query(_STATED_NODES)
def s1_nodes(t: Tables) -> DataFrame:
    return t.nodes.select("node_id", "parent_id", "name", "kind", "ord", "abv_stated", "unit_cost", F.col("unit_volume.amount").alias("volume_ml"), "unit_count")


@query(_STATED_LINES)
def s2_s3_lines(t: Tables) -> DataFrame:
    """Lines packed into nested recipe documents and exploded again."""
    item = F.struct("pos", F.col("node_id").alias("node"), F.struct("amount", "unit").alias("amount_unit"))
    nested = t.lines.groupBy("recipe_id").agg(F.array_sort(F.collect_list(item)).alias("ingredients"))
    return catalog.explode_lines(nested).select("recipe_id", "pos", "node_id", "amount", "unit")


@query("SELECT recipe_id, pos, node_id, amount, unit, parent_id, kind FROM lines JOIN nodes USING (node_id)")
def s4_written_and_loaded(t: Tables) -> DataFrame:
    """Nodes as Parquet by kind and nested recipes as JSON lines, written, loaded again and joined."""
    folder = new_folder(t.lines.sparkSession, "catalog")
    catalog.write_result(t.nodes, f"{folder}/nodes", ["kind"])
    item = F.struct("pos", F.struct(F.col("node_id").alias("node"), F.struct("amount", "unit").alias("amount_unit")).alias("x"))
    nested = t.lines.groupBy("recipe_id").agg(F.array_sort(F.collect_list(item)).alias("i")).select("recipe_id", F.col("i.x").alias("ingredients"))
    nested.write.json(f"{folder}/recipes.jsonl")
    nodes, recipes = catalog.load_nodes(t.lines.sparkSession, f"{folder}/nodes"), catalog.load_recipes(t.lines.sparkSession, f"{folder}/recipes.jsonl")
    return catalog.explode_lines(recipes).join(nodes, "node_id").select("recipe_id", "pos", "node_id", "amount", "unit", "parent_id", "kind")


@query("SELECT node_id, abv FROM rated")
def p1_kind_defaults(t: Tables) -> DataFrame:
    return p.with_kind_defaults(t.nodes).select("node_id", "abv")


@query("SELECT node_id, name, ord FROM nodes QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC, node_id DESC) = 1")
def p2_node_registry(t: Tables) -> DataFrame:
    return p.node_registry(t.nodes).select("node_id", "name", "ord")


@query(f"SELECT recipe_id, pos, unit, CASE WHEN per_ml IS NULL THEN -1.0 ELSE round(amount / per_ml * (1/29.57::DOUBLE), 6) END::DOUBLE AS oz FROM lines LEFT JOIN {UNITS} u(unit, per_ml) USING (unit)")
def p3_convert_volume(t: Tables) -> DataFrame:
    """All lines; an unknown unit gives NaN, shown as -1 here."""
    oz = t.lines.withColumn("oz", F.round(units.convert_volume("amount", "unit", F.lit("oz")), 6))
    return oz.select("recipe_id", "pos", "unit", F.when(F.isnan("oz"), -1.0).otherwise(F.col("oz")).alias("oz"))


@query("SELECT node_id, round(cost_oz, 6) AS cost_oz, round(cost_count, 6) AS cost_count FROM priced")
def p4_p5_p6_costs(t: Tables) -> DataFrame:
    return p.with_costs(t.nodes).select("node_id", F.round("cost_oz", 6).alias("cost_oz"), F.round("cost_count", 6).alias("cost_count"))


@query("SELECT recipe_id, pos, node_id FROM scorable")
def p7_scorable_lines(t: Tables) -> DataFrame:
    return p.scorable_lines(t.lines, t.nodes).select("recipe_id", "pos", "node_id")


@query("SELECT recipe_id, pos, node_id FROM lines JOIN nodes USING (node_id) WHERE kind <> 'Garnish'")
def p8_graph_lines(t: Tables) -> DataFrame:
    return p.graph_lines(t.lines, t.nodes).select("recipe_id", "pos", "node_id")


@query("SELECT recipe_id, string_agg(name, '|' ORDER BY pos) AS names FROM lines JOIN nodes USING (node_id) GROUP BY 1")
def p9_recipe_ingredients(t: Tables) -> DataFrame:
    return p.recipe_ingredients(t.lines, t.nodes).select("recipe_id", F.array_join("names", "|").alias("names"))


@query("SELECT recipe_id, pos, coalesce(s.name, 'unknown') AS name FROM (SELECT recipe_id, pos, node_id AS key FROM lines) LEFT JOIN (SELECT node_id AS key, name FROM nodes WHERE kind = 'Liquor') s USING (key)")
def p10_names_from_keys(t: Tables) -> DataFrame:
    dim = t.nodes.where("kind = 'Liquor'").select(F.col("node_id").alias("key"), "name")
    return p.names_from_keys(t.lines.select("recipe_id", "pos", F.col("node_id").alias("key")), dim, "unknown").select("recipe_id", "pos", "name")


@query("SELECT node_id, round(0.5 * e / (0.5 + 0.5 * e), 6) AS weight FROM (SELECT node_id, exp((ord % 101 / 100.0::DOUBLE - 0.7) * (ln(2) / 0.03)) AS e FROM nodes)")
def p11_score_to_weight(t: Tables) -> DataFrame:
    return t.nodes.select("node_id", F.round(units.score_to_weight(F.col("ord") % 101 / 100.0), 6).alias("weight"))


@query("""SELECT recipe_id, pos, CAST(CAST(amount AS BIGINT) AS STRING) || ' ' || CASE unit WHEN 'dash' THEN CASE WHEN amount = 1 THEN 'dash' ELSE 'dashes' END WHEN 'splash' THEN CASE WHEN amount = 1 THEN 'splash' ELSE 'splashes' END
  WHEN 'drop' THEN CASE WHEN amount = 1 THEN 'drop' ELSE 'drops' END WHEN 'oz' THEN 'oz' ELSE '' END AS label FROM lines""")
def p12_measure_label(t: Tables) -> DataFrame:
    return t.lines.select("recipe_id", "pos", units.measure_label("amount", "unit").alias("label"))


@query("""SELECT recipe_id, 'Order ' || recipe_id AS title, string_agg(CAST(CAST(amount AS BIGINT) AS STRING) || ' ' || CASE unit WHEN 'dash' THEN CASE WHEN amount = 1 THEN 'dash' ELSE 'dashes' END WHEN 'splash' THEN CASE WHEN amount = 1 THEN 'splash' ELSE 'splashes' END
  WHEN 'drop' THEN CASE WHEN amount = 1 THEN 'drop' ELSE 'drops' END WHEN 'oz' THEN 'oz' ELSE '' END || ':' || name, '|' ORDER BY pos) AS card FROM lines JOIN nodes USING (node_id) WHERE recipe_id IN (SELECT CAST(o_orderkey AS STRING) FROM orders) GROUP BY 1""")
def p13_recipe_card(t: Tables) -> DataFrame:
    cards = p.recipe_card(t.recipes, t.lines, t.nodes)
    return cards.select("recipe_id", "title", F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["measure"], x["ingredient"])), "|").alias("card"))


@query("SELECT node_id, printf('%.1f', round(abv * 100, 1)) || '%' AS label FROM rated WHERE abv IS NOT NULL")
def p14_percent_label(t: Tables) -> DataFrame:
    return p.with_kind_defaults(t.nodes).where("abv IS NOT NULL").select("node_id", units.percent_label("abv", 1).alias("label"))


@query("SELECT node_id, ancestor_id, depth FROM closure")
def h1_lineage(t: Tables) -> DataFrame:
    return h.closure(t.paths)


@query("SELECT parent_id AS src, node_id AS dst FROM nodes WHERE parent_id = 'root'")
def h2_child_edges(t: Tables) -> DataFrame:
    return h.child_edges(t.nodes, "root")


@query("SELECT ancestor_id, parent_id AS src, node_id AS dst FROM closure JOIN nodes USING (node_id) WHERE node_id <> ancestor_id")
def h3_subtree_edges(t: Tables) -> DataFrame:
    return h.subtree_edges(t.paths)


@query("SELECT ancestor_id, node_id FROM closure WHERE node_id <> ancestor_id")
def h4_descendants(t: Tables) -> DataFrame:
    return h.descendants(t.paths)


@query("SELECT CAST(len(path) - 1 AS INT) AS layer, parent_id AS src, node_id AS dst FROM paths JOIN nodes USING (node_id) WHERE parent_id IS NOT NULL")
def h5_layered_edges(t: Tables) -> DataFrame:
    return h.layered_edges(t.paths, "root")


def _neighbours(t: Tables) -> DataFrame:
    """Each line's node with the next one's, in every recipe."""
    one, two = t.lines.select("recipe_id", "pos", F.col("node_id").alias("a")), t.lines.select("recipe_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("b"))
    return h.with_paths(one.join(two, ["recipe_id", "pos"]), t.paths)


_NEXT = "FROM lines x JOIN lines y ON x.recipe_id = y.recipe_id AND y.pos = x.pos + 1 JOIN paths p ON p.node_id = x.node_id JOIN paths q ON q.node_id = y.node_id"


@query(f"SELECT x.recipe_id, x.pos, CAST(len(list_intersect(p.path, q.path)) AS INT) AS shared {_NEXT}")
def h6_shared_depth(t: Tables) -> DataFrame:
    return _neighbours(t).select("recipe_id", "pos", h.shared_depth("path_a", "path_b").alias("shared"))


@query(f"SELECT x.recipe_id, x.pos, CAST(len(p.path) + len(q.path) - 2 * len(list_intersect(p.path, q.path)) AS INT) AS distance {_NEXT}")
def h7_tree_distance(t: Tables) -> DataFrame:
    return _neighbours(t).select("recipe_id", "pos", h.tree_distance("path_a", "path_b").alias("distance"))


@query("SELECT node_id, cost_oz_guess FROM guess JOIN priced USING (node_id) WHERE cost_oz IS NULL")
def h8_cost_guess(t: Tables) -> DataFrame:
    return h.cost_guess(p.with_costs(t.nodes), t.paths)


@query("SELECT recipe_id, round(abv, 6) AS abv FROM strength")
def a1_recipe_abv(t: Tables) -> DataFrame:
    return a.recipe_abv(t.lines, p.with_kind_defaults(t.nodes)).select("recipe_id", F.round("abv", 6).alias("abv"))


@query("SELECT CAST(o_orderkey AS STRING) AS recipe_id, 'Order ' || CAST(o_orderkey AS STRING) AS name, printf('%.1f', round(abv * 100, 1)) || '%' AS abv_label FROM orders LEFT JOIN strength ON recipe_id = CAST(o_orderkey AS STRING) WHERE o_orderpriority = '1-URGENT'")
def a2_list_abv(t: Tables) -> DataFrame:
    urgent = t.recipes.where("source = '1-URGENT'")
    return a.list_abv(urgent, t.recipes, t.lines, p.with_kind_defaults(t.nodes))


@query("SELECT kind, round(avg(cost_oz), 6) AS mean FROM priced GROUP BY 1")
def a3_mean(t: Tables) -> DataFrame:
    return a.mean(p.with_costs(t.nodes), "cost_oz", ["kind"]).select("kind", F.round("mean", 6).alias("mean"))


@query(f"SELECT x.recipe_id, x.pos, CASE WHEN x.node_id = y.node_id THEN 1.0 ELSE 1.0 - pow(0.5::DOUBLE, len(list_intersect(p.path, q.path)) - 1) END::DOUBLE AS score {_NEXT}")
def j1_pair_score(t: Tables) -> DataFrame:
    return _neighbours(t).select("recipe_id", "pos", j.pair_score(F.col("a") == F.col("b"), h.shared_depth("path_a", "path_b")).alias("score"))


_SUPPLIER = "supplied AS (SELECT 'S' || CAST(supplier AS STRING) AS recipe_id, node_id FROM scorable), "


@query(WITH + "," + _SUPPLIER + _scores("supplied") + "SELECT r1, r2, round(score, 12) AS score FROM directed")
def j2_directed_similarity(t: Tables) -> DataFrame:
    return j.directed_similarity(t.supplier_lines, t.nodes, t.paths).select("r1", "r2", F.round("score", 12).alias("score"))


@query(WITH + """, m AS (SELECT r1, r2, x.pos AS pos1, x.node_id AS node1, y.pos AS pos2, y.node_id AS node2, len(list_intersect(p.path, q.path)) AS d FROM pairs JOIN scorable x ON x.recipe_id = r1 JOIN scorable y ON y.recipe_id = r2 JOIN paths p ON p.node_id = x.node_id JOIN paths q ON q.node_id = y.node_id),
s AS (SELECT *, CASE WHEN node1 = node2 THEN 1.0 ELSE 1.0 - pow(0.5::DOUBLE, d - 1) END::DOUBLE AS score FROM m)
SELECT r1, r2, pos1, node1, pos2, node2, CAST(d AS INT) AS n_shared, score FROM s QUALIFY row_number() OVER (PARTITION BY r1, r2, pos1 ORDER BY score DESC, pos2) = 1""")
def j3_best_match(t: Tables) -> DataFrame:
    found = j.best_match(t.pairs, t.lines, t.nodes, t.paths)
    return found.select("r1", "r2", "pos1", "node1", "pos2", "node2", F.size("shared").alias("n_shared"), "score")


@query(WITH + "," + _SUPPLIER + _scores("supplied") + "SELECT r1, r2, round(k12, 12) AS k12, round(k21, 12) AS k21, round(score, 12) AS score FROM mutual")
def j4_similarity(t: Tables) -> DataFrame:
    found = j.similarity_of_all(t.supplier_lines, t.nodes, t.paths)
    return found.select("r1", "r2", *[F.round(c, 12).alias(c) for c in ("k12", "k21", "score")])


_HALF = "floor({0} * 10000.0::DOUBLE + 0.50000001::DOUBLE) / 10000.0::DOUBLE AS {0}"


@query(WITH + "," + _SUPPLIER + _scores("supplied") + f"SELECT r1, r2, {', '.join(_HALF.format(c) for c in ('k12', 'k21', 'score'))} FROM mutual")
def j5_score_all(t: Tables) -> DataFrame:
    """Suppliers are the recipes."""
    return j.score_all(t.supplier_lines, t.nodes, t.paths)


@query(WITH + """, asked AS (SELECT CAST(o_orderkey AS STRING) AS q FROM orders WHERE o_orderkey % 100 = 0), sizes AS (SELECT recipe_id, count(*) AS size FROM scorable GROUP BY 1),
weights AS MATERIALIZED (SELECT recipe_id, node_id, count(*) AS n FROM scorable GROUP BY 1, 2), held AS MATERIALIZED (SELECT DISTINCT recipe_id, ancestor_id FROM weights JOIN closure USING (node_id)),
ahead AS (SELECT w.recipe_id AS r1, h.recipe_id AS r2, w.node_id, w.n, max(c.depth) AS d FROM weights w JOIN asked ON q = w.recipe_id JOIN closure c USING (node_id) JOIN held h USING (ancestor_id) GROUP BY 1, 2, 3, 4),
back AS (SELECT h.recipe_id AS r1, w.recipe_id AS r2, w.node_id, w.n, max(c.depth) AS d FROM held h JOIN asked ON q = h.recipe_id JOIN closure c USING (ancestor_id) JOIN weights w ON w.node_id = c.node_id GROUP BY 1, 2, 3, 4),
k12 AS (SELECT r1, r2, sum(a.n * CASE WHEN o.node_id IS NULL THEN 1 - pow(0.5::DOUBLE, d - 1) ELSE 1 END) / max(size) AS k FROM ahead a JOIN sizes s ON s.recipe_id = r1 LEFT JOIN weights o ON o.recipe_id = r2 AND o.node_id = a.node_id GROUP BY 1, 2),
k21 AS (SELECT r1, r2, sum(b.n * CASE WHEN o.node_id IS NULL THEN 1 - pow(0.5::DOUBLE, d - 1) ELSE 1 END) / max(size) AS k FROM back b JOIN sizes s ON s.recipe_id = r2 LEFT JOIN weights o ON o.recipe_id = r1 AND o.node_id = b.node_id GROUP BY 1, 2),
scored AS (SELECT r1, r2, round((x.k + y.k) / 2, 12) AS score FROM k12 x JOIN k21 y USING (r1, r2) WHERE r1 <> r2)
SELECT r1, r2, score, CAST(rank AS INT) AS rank FROM (SELECT r1, r2, score, row_number() OVER (PARTITION BY r1 ORDER BY score DESC, CAST(r2 AS BIGINT)) AS rank FROM scored) WHERE rank <= 10""")
def j6_find_similar(t: Tables) -> DataFrame:
    """Every hundredth order's ten most similar among all orders, each line scored by definition in the SQL."""
    return th.nearest(t.recipes.where("ord % 100 = 0"), t.recipes, t.lines, t.nodes, t.paths, k=10)


@query("SELECT 'S' || CAST(x.s_suppkey AS STRING) AS r1, 'S' || CAST(y.s_suppkey AS STRING) AS r2 FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey")
def j7_recipe_pairs(t: Tables) -> DataFrame:
    return j.recipe_pairs(t.suppliers)


@query(WITH + f""", {_OWN}, held AS (SELECT DISTINCT recipe_id, path[4] AS key FROM scorable JOIN paths USING (node_id) WHERE len(path) >= 4),
cand AS MATERIALIZED (SELECT DISTINCT x.recipe_id AS r1, y.recipe_id AS r2 FROM held x JOIN held y USING (key) WHERE x.recipe_id < y.recipe_id),
worth AS MATERIALIZED (SELECT recipe_id, hash(key) AS key, gain * n AS w FROM own), one AS MATERIALIZED (SELECT r1, r2, key, w AS w1 FROM cand JOIN worth ON recipe_id = r1),
met AS MATERIALIZED (SELECT r1, r2, sum(w1) AS w1, sum(w) AS w2 FROM one JOIN worth ON worth.recipe_id = one.r2 AND worth.key = one.key GROUP BY 1, 2),
m AS (SELECT r1, r2, (w1 / x.size + w2 / y.size) / 2 - 1 AS score FROM met JOIN sizes x ON x.recipe_id = r1 JOIN sizes y ON y.recipe_id = r2)
SELECT r1, r2, round(score, 12) AS score, round(0.5 * e / (0.5 + 0.5 * e), 6) AS weight FROM (SELECT *, exp((score - 0.7) * (ln(2) / 0.03)) AS e FROM m)""")
def j8_similarity_edges(t: Tables) -> DataFrame:
    """Orders that share a part's name, scored exactly."""
    return j.shared_edges(t.lines, t.nodes, t.paths, 4).select("r1", "r2", F.round("score", 12).alias("score"), F.round("weight", 6).alias("weight"))


@query(WITH + """, near AS (SELECT DISTINCT recipe_id, CASE WHEN len(path) < 3 THEN node_id ELSE path[3] END AS key FROM scorable JOIN paths USING (node_id)),
cand AS MATERIALIZED (SELECT DISTINCT x.recipe_id AS r1, y.recipe_id AS r2 FROM near x JOIN near y USING (key) WHERE x.recipe_id <> y.recipe_id),""" + _scores("scorable", "JOIN cand ON cand.r1 = x.recipe_id") + """SELECT r1, r2, round(score, 12) AS score, round(weight, 6) AS weight FROM (SELECT r1, r2, score, 0.5 * e / (0.5 + 0.5 * e) AS weight FROM
  (SELECT *, exp((score - 0.7) * (ln(2) / 0.03)) AS e FROM mutual WHERE r1 < r2)) WHERE weight >= 0.6""")
def j8_strong_edges(t: Tables) -> DataFrame:
    """All pairs of orders whose weight is at least 0.6. The SQL scores each line by definition, of the pairs that share a brand: a score over 0.5 takes a line that matches better than that."""
    found = th.strong_edges(t.lines, t.nodes, t.paths, min_weight=0.6)
    return found.select("r1", "r2", F.round("score", 12).alias("score"), F.round("weight", 6).alias("weight"))


@query("SELECT o AS recipe_id, coalesce(n, 0) AS matched FROM (SELECT CAST(o_orderkey AS STRING) AS o FROM orders) LEFT JOIN (SELECT recipe_id, count(DISTINCT ancestor_id) AS n FROM lines JOIN closure USING (node_id) WHERE ancestor_id LIKE 'T:%' AND ancestor_id LIKE '%STEEL' GROUP BY 1) ON o = recipe_id WHERE coalesce(n, 0) <= 1")
def j9_ingredients_match(t: Tables) -> DataFrame:
    picked = t.nodes.where("node_id LIKE 'T:%' AND node_id LIKE '%STEEL'")
    return j.ingredients_match(t.recipes, t.lines, t.paths, picked, 1, "lte")


@query("SELECT recipe_id, src, dst FROM edges1")
def g1_recipe_edges(t: Tables) -> DataFrame:
    return g.recipe_edges(t.lines, t.nodes, t.paths)


@query("SELECT recipe_id, src, dst FROM edges2")
def g2_recipe_graph(t: Tables) -> DataFrame:
    return g.recipe_graph(t.lines, t.nodes, t.paths)


def _unions(t: Tables) -> DataFrame:
    return g.union_packed(t.pairs, g.packed_graphs(t.lines, t.nodes, t.paths)).select("pair_id", "walks")


@query("SELECT pair_id, src, dst FROM edges3")
def g3_union_graph(t: Tables) -> DataFrame:
    return g.union_graph(t.pairs, g.packed_graphs(t.lines, t.nodes, t.paths))


@query("SELECT pair_id, src, dst FROM edges3 UNION SELECT pair_id, dst, src FROM edges3")
def g4_undirected(t: Tables) -> DataFrame:
    return g.undirected_graphs(_unions(t), "pair_id")


@query("""SELECT pair_id, node, out_degree, n_neighbors FROM (SELECT pair_id, src AS node, count(*) AS n_neighbors FROM (SELECT pair_id, src, dst FROM edges3 UNION SELECT pair_id, dst, src FROM edges3) GROUP BY 1, 2)
  JOIN (SELECT pair_id, node, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT pair_id, src AS node, 1 AS o FROM edges3 UNION ALL SELECT pair_id, dst, 0 FROM edges3) GROUP BY 1, 2) USING (pair_id, node)""")
def g5_degrees(t: Tables) -> DataFrame:
    return g.degrees(_unions(t), "pair_id")


def _tops() -> Column:
    """The top categories among the nodes that a recipe's edges begin at."""
    return F.array_distinct(F.filter(F.flatten(F.transform("walks", lambda w: F.slice(w, 1, F.size(w) - 1))), lambda x: x.startswith("T:")))


@query(WITH + ", walk AS (SELECT DISTINCT recipe_id, src AS start, src AS node FROM edges2 WHERE src LIKE 'T:%' UNION SELECT w.recipe_id, w.start, e.dst FROM walk w JOIN edges2 e ON e.recipe_id = w.recipe_id AND e.src = w.node) SELECT recipe_id, start, node FROM walk")
def g6_reachable(t: Tables) -> DataFrame:
    """What each recipe's top categories reach."""
    return g.reachable_in_graphs(g.packed_graphs(t.lines, t.nodes, t.paths).withColumn("starts", _tops()), "recipe_id")


@query(WITH + """, ways AS (SELECT recipe_id, src AS a, dst AS b FROM edges2 UNION SELECT recipe_id, dst, src FROM edges2),
walk AS (SELECT recipe_id, min(src) AS start, min(src) AS node FROM edges2 WHERE src LIKE 'T:%' GROUP BY 1 UNION SELECT w.recipe_id, w.start, e.b FROM walk w JOIN ways e ON e.recipe_id = w.recipe_id AND e.a = w.node) SELECT recipe_id, start, node FROM walk""")
def g6_reachable_either_way(t: Tables) -> DataFrame:
    """What each recipe's first top category reaches in either direction: all of its graph, as every line leads to the recipe."""
    first = F.array_compact(F.array(F.array_min(_tops())))
    return g.reachable_in_graphs(g.packed_graphs(t.lines, t.nodes, t.paths).withColumn("starts", first), "recipe_id", directed=False)


def _overlaps(t: Tables, **options) -> DataFrame:
    return g.overlap_graph(t.pairs, g.packed_graphs(t.lines, t.nodes, t.paths), p.line_lists(t.lines), **options)


#: Passes that the SQL of the prunings unrolls. One more must change nothing, or the SQL gives no rows.
ISOLATED, TAILS = 4, 14
_ENDS = "named AS MATERIALIZED (SELECT r1 || '+' || r2 AS pair_id, r1, r2, 'R:' || r1 AS one, 'R:' || r2 AS two FROM pairs), e0 AS MATERIALIZED (SELECT * FROM edges3)"


def _without_gone(old: str, new: str, gone: str) -> str:
    return f"{new} AS MATERIALIZED (SELECT e.* FROM {old} e LEFT JOIN {gone} x ON x.pair_id = e.pair_id AND x.node = e.src LEFT JOIN {gone} y ON y.pair_id = e.pair_id AND y.node = e.dst WHERE x.node IS NULL AND y.node IS NULL)"


def _isolated(old: str, new: str) -> str:
    """One pass of G7: nodes with several ways out must reach either recipe while the other is closed."""

    def walk(name: str, start: str, shut: str) -> str:
        return f"{name} AS (SELECT pair_id, {start} AS node FROM named UNION SELECT u.pair_id, u.y FROM {name} t JOIN both_{new} u ON u.pair_id = t.pair_id AND u.x = t.node JOIN named p ON p.pair_id = u.pair_id WHERE u.y <> p.{shut})"

    return f"""both_{new} AS MATERIALIZED (SELECT pair_id, src AS x, dst AS y FROM {old} UNION SELECT pair_id, dst, src FROM {old}),
{walk(f'to1_{new}', 'one', 'two')}, {walk(f'to2_{new}', 'two', 'one')},
gone_{new} AS MATERIALIZED (SELECT pair_id, src AS node FROM {old} GROUP BY 1, 2 HAVING count(*) > 1 EXCEPT (SELECT pair_id, node FROM to1_{new} INTERSECT SELECT pair_id, node FROM to2_{new})), {_without_gone(old, new, f'gone_{new}')}"""


def _tails(old: str, new: str) -> str:
    """One pass of G8: nodes with one neighbour that is neither recipe."""
    return f"""both_{new} AS MATERIALIZED (SELECT pair_id, src AS x, dst AS y FROM {old} UNION SELECT pair_id, dst, src FROM {old}),
gone_{new} AS MATERIALIZED (SELECT pair_id, x AS node FROM both_{new} JOIN named USING (pair_id) GROUP BY 1, 2 HAVING count(*) = 1 AND NOT bool_or(y = one OR y = two)), {_without_gone(old, new, f'gone_{new}')}"""


def _settled(n: int) -> str:
    return f"(SELECT count(*) FROM e{n}) = (SELECT count(*) FROM e{n + 1})"


def _passes(isolated: int, tails: int) -> str:
    names = [f"e{i}" for i in range(isolated + tails + 1)]
    return WITH + ", " + ", ".join([_ENDS, *[(_isolated if i < isolated else _tails)(names[i], names[i + 1]) for i in range(isolated + tails)]])


@query(_passes(ISOLATED + 1, 0) + f"SELECT pair_id, src, dst FROM e{ISOLATED} WHERE {_settled(ISOLATED)}")
def g7_remove_isolated(t: Tables) -> DataFrame:
    return _overlaps(t, tails=False).select("pair_id", "src", "dst")


@query(_passes(0, TAILS + 1) + f"SELECT pair_id, src, dst FROM e{TAILS} WHERE {_settled(TAILS)}")
def g8_remove_tails(t: Tables) -> DataFrame:
    return _overlaps(t, isolated=False).select("pair_id", "src", "dst")


_LAST = f"e{ISOLATED + TAILS + 1}"


@query(_passes(ISOLATED + 1, TAILS) + f""", back1 AS (SELECT pair_id, one AS node FROM named UNION SELECT e.pair_id, e.src FROM back1 t JOIN {_LAST} e ON e.pair_id = t.pair_id AND e.dst = t.node),
back2 AS (SELECT pair_id, two AS node FROM named UNION SELECT e.pair_id, e.src FROM back2 t JOIN {_LAST} e ON e.pair_id = t.pair_id AND e.dst = t.node),
outs AS (SELECT pair_id, src AS node, count(*) AS o FROM {_LAST} GROUP BY 1, 2), lists AS (SELECT recipe_id, string_agg(node_id, '|' ORDER BY pos) AS l FROM lines GROUP BY 1), used AS (SELECT DISTINCT recipe_id, node_id AS node FROM lines),
ends AS (SELECT DISTINCT pair_id, node FROM (SELECT pair_id, src AS node FROM {_LAST} UNION ALL SELECT pair_id, dst FROM {_LAST})),
roles AS MATERIALIZED (SELECT e.pair_id, e.node, CASE WHEN coalesce(o, 0) >= 2 AND u1.node IS NULL AND u2.node IS NULL AND b1.node IS NOT NULL AND b2.node IS NOT NULL THEN 'top' WHEN e.node = n.one THEN 'recipe1' WHEN e.node = n.two THEN 'recipe2'
    WHEN u1.node IS NOT NULL AND u2.node IS NOT NULL AND coalesce(l1.l, '') <> coalesce(l2.l, '') THEN 'common' WHEN u1.node IS NOT NULL THEN 'recipe1_ingredient' WHEN u2.node IS NOT NULL THEN 'recipe2_ingredient' ELSE 'other' END AS role
  FROM ends e JOIN named n USING (pair_id) LEFT JOIN outs ON outs.pair_id = e.pair_id AND outs.node = e.node LEFT JOIN used u1 ON u1.recipe_id = n.r1 AND u1.node = e.node LEFT JOIN used u2 ON u2.recipe_id = n.r2 AND u2.node = e.node
  LEFT JOIN back1 b1 ON b1.pair_id = e.pair_id AND b1.node = e.node LEFT JOIN back2 b2 ON b2.pair_id = e.pair_id AND b2.node = e.node LEFT JOIN lists l1 ON l1.recipe_id = n.r1 LEFT JOIN lists l2 ON l2.recipe_id = n.r2)
SELECT e.pair_id, n.r1, n.r2, e.src, e.dst, s.role AS src_role, d.role AS dst_role FROM {_LAST} e JOIN named n USING (pair_id) JOIN roles s ON s.pair_id = e.pair_id AND s.node = e.src JOIN roles d ON d.pair_id = e.pair_id AND d.node = e.dst""")
def g9_overlap_graph(t: Tables) -> DataFrame:
    return _overlaps(t)


@query(WITH + """, ends AS (SELECT DISTINCT pair_id, node FROM (SELECT pair_id, src AS node FROM edges3 UNION ALL SELECT pair_id, dst FROM edges3)), outs AS (SELECT pair_id, src AS node, count(*) AS o FROM edges3 GROUP BY 1, 2),
lists AS (SELECT recipe_id, string_agg(node_id, '|' ORDER BY pos) AS l FROM lines GROUP BY 1), named AS (SELECT r1 || '+' || r2 AS pair_id, r1, r2, coalesce(x.l, '') <> coalesce(y.l, '') AS differ FROM pairs LEFT JOIN lists x ON x.recipe_id = r1 LEFT JOIN lists y ON y.recipe_id = r2),
used AS (SELECT DISTINCT recipe_id, node_id FROM lines), above AS (SELECT DISTINCT recipe_id, ancestor_id AS node FROM lines JOIN nodes n USING (node_id) JOIN closure USING (node_id) WHERE n.kind <> 'Garnish')
SELECT e.pair_id, e.node, CASE WHEN coalesce(o, 0) >= 2 AND u1.node_id IS NULL AND u2.node_id IS NULL AND a1.node IS NOT NULL AND a2.node IS NOT NULL THEN 'top' WHEN e.node = 'R:' || r1 THEN 'recipe1' WHEN e.node = 'R:' || r2 THEN 'recipe2'
  WHEN u1.node_id IS NOT NULL AND u2.node_id IS NOT NULL AND differ THEN 'common' WHEN u1.node_id IS NOT NULL THEN 'recipe1_ingredient' WHEN u2.node_id IS NOT NULL THEN 'recipe2_ingredient' ELSE 'other' END AS role
FROM ends e JOIN named USING (pair_id) LEFT JOIN outs ON outs.pair_id = e.pair_id AND outs.node = e.node LEFT JOIN used u1 ON u1.recipe_id = r1 AND u1.node_id = e.node LEFT JOIN used u2 ON u2.recipe_id = r2 AND u2.node_id = e.node
LEFT JOIN above a1 ON a1.recipe_id = r1 AND a1.node = e.node LEFT JOIN above a2 ON a2.recipe_id = r2 AND a2.node = e.node""")
def g10_node_roles(t: Tables) -> DataFrame:
    """Roles on the unpruned union graphs."""
    return g.union_roles(t.pairs, g.packed_graphs(t.lines, t.nodes, t.paths), p.line_lists(t.lines))


_TOP = "(SELECT min(node_id) FROM nodes WHERE parent_id = 'root')"


@query(f"SELECT parent_id AS src, node_id AS dst FROM nodes WHERE parent_id = 'root' OR parent_id = {_TOP}")
def g11_visible_tree(t: Tables) -> DataFrame:
    """The first category opened, shut with all below it, and opened again."""
    top = t.nodes.where("parent_id = 'root'").agg(F.min("node_id")).first()[0]
    return g.visible_tree(t.nodes, t.paths, "root", [top, top, top])


@query("SELECT id, count(*) AS n_links FROM (SELECT DISTINCT id, l FROM (SELECT src AS id, recipe_id || src || dst AS l FROM edges2 UNION ALL SELECT dst, recipe_id || src || dst FROM edges2)) GROUP BY 1")
def g12_graph_dataset(t: Tables) -> DataFrame:
    edges = g.recipe_graph(t.lines, t.nodes, t.paths)
    ends, links = g.graph_dataset(edges, "recipe")
    at = links.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.select("id").join(at, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))


@query("SELECT node_id AS id, CASE WHEN kind = 'Liquor' THEN 'old 1' ELSE kind END AS label, CASE WHEN kind = 'Liquor' THEN 1 - ord ELSE ord END AS x FROM nodes")
def g13_carry_forward(t: Tables) -> DataFrame:
    """Two old records of every liquor, of which the later wins."""
    new = t.nodes.select(F.col("node_id").alias("id"), F.col("kind").alias("label"), F.col("ord").alias("x"))
    at = F.explode(F.array(F.lit(1), F.lit(0))).alias("at")
    old = t.nodes.where("kind = 'Liquor'").select(F.col("node_id").alias("id"), "ord", at).select("id", F.concat(F.lit("old "), "at").alias("label"), (F.col("at") - F.col("ord")).alias("x"), "at")
    return g.carry_forward(new, old, order="at")
