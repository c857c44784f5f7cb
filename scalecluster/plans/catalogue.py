"""The registered queries of the clustering engine and their SQL.

Doubles are returned as integers of fixed scaling where two engines may differ
in the last bit.  The SQL is independent of the operators: it has its own
generator of the hash constants and finds components by recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_family
from ..functions.vectors import dot, log1p_vector, normalise, parse_vector, slice_columns
from ..operators import evaluate, minhash, sdcode, stats
from ..operators.components import grouped_components
from ..scratch import materialise
from ..sources.io import read_columns
from . import engine
from .config import ClusterConfig

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NANO = 1_000_000_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(x, by: int = NANO):
    return F.round(x * by).cast("long")


# --- scalar preparation ------------------------------------------------------


@query("SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part")
def parse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(", ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), parse_vector(text).alias("vec"))
    return rows.select("item_id", F.get("vec", F.lit(0)).alias("x0"), F.get("vec", F.lit(1)).alias("x1"))


LINE_XY = """SELECT l_quantity / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice) AS x0,
       l_extendedprice / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice) AS x1 FROM lineitem"""


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").withColumn("_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return read_columns(rows, "_id", ["l_quantity", "l_extendedprice"])


@query(f"SELECT CAST(round(x0 * 1e9) AS BIGINT) AS x0, CAST(round(x1 * 1e9) AS BIGINT) AS x1, count(*) AS n FROM ({LINE_XY}) GROUP BY ALL")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise(_lineitem(spark, sf_dir))
    return rows.groupBy(_scaled(F.get("vec", F.lit(0))).alias("x0"), _scaled(F.get("vec", F.lit(1))).alias("x1")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 0 AS dim, min(l_quantity) AS "min", max(l_quantity) AS "max", max(l_quantity) - min(l_quantity) AS diff, min(l_quantity) + (max(l_quantity) - min(l_quantity)) / 2 AS mid FROM lineitem
UNION ALL SELECT 1, min(l_extendedprice), max(l_extendedprice), max(l_extendedprice) - min(l_extendedprice), min(l_extendedprice) + (max(l_extendedprice) - min(l_extendedprice)) / 2 FROM lineitem""")
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(_lineitem(spark, sf_dir), 2)


@query("SELECT 0 AS dim, CAST(max(length(string_split(CAST(c_acctbal AS VARCHAR), '.')[2])) AS INTEGER) AS digits FROM customer")
def precision_per_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(F.array(F.col("c_acctbal").cast("string")).alias("tokens"))
    return stats.precision(rows, 1)


@query("""SELECT CAST(floor(log2((max(c_acctbal) - min(c_acctbal)) * pow(10, max(length(string_split(CAST(c_acctbal AS VARCHAR), '.')[2]))))) AS INTEGER) - 1 AS max_scale FROM customer""")
def max_sd_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    rows = _table(spark, sf_dir, "customer").select(F.array(balance).alias("vec"), F.array(balance.cast("string")).alias("tokens"))
    found = stats.grid_stats(rows, 1)
    return spark.createDataFrame([(stats.max_sd_scale(found, {r["dim"]: r["digits"] for r in found}),)], "max_scale int")


@query("""SELECT growth, CAST(s AS INTEGER) AS scale, CAST(round(least(1.0, pow(1 + growth, s - 1) / 64) * 1e6) AS BIGINT) AS threshold
FROM (VALUES (0.02::DOUBLE), (0.1::DOUBLE)) AS g(growth), generate_series(1, 300) AS t(s) WHERE s <= floor(ln(64) / ln(1 + growth)) - 1""")
def jaccard_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(g, s, round(t * 1_000_000)) for g in (0.02, 0.1) for s, t in stats.threshold_ladder(64, g, 1, stats.max_jaccard_scale(64, g))]
    return spark.createDataFrame(rows, "growth double, scale int, threshold long")


@query("""WITH b AS (SELECT CAST(floor(ln(max(len(embedding))) / ln(1.1::DOUBLE)) AS INTEGER) - 1 AS most FROM embeddings)
SELECT CAST(e AS INTEGER) AS requested, CAST(CASE WHEN e = 0 THEN most ELSE least(e, most) END AS INTEGER) AS end_scale FROM b, (VALUES (0), (10), (42), (100)) AS t(e)""")
def clamp_end_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = stats.max_jaccard_scale(stats.dimension_count(_embeddings(spark, sf_dir)), 0.1)
    return spark.createDataFrame([(e, stats.clamp_end_scale(e, most)) for e in (0, 10, 42, 100)], "requested int, end_scale int")


@query("""SELECT 'embeddings' AS source, CASE WHEN count(*) > pow(3, max(len(embedding))) THEN 'SD' ELSE 'MIN' END AS model FROM embeddings
UNION ALL SELECT 'lineitem', CASE WHEN count(*) > pow(3, 2) THEN 'SD' ELSE 'MIN' END FROM lineitem
UNION ALL SELECT 'region', CASE WHEN count(*) > pow(3, 2) THEN 'SD' ELSE 'MIN' END FROM region""")
def model_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"embeddings": _embeddings(spark, sf_dir), "lineitem": _lineitem(spark, sf_dir), "region": read_columns(_table(spark, sf_dir, "region"), "r_regionkey", ["r_regionkey", "r_regionkey"])}
    config = ClusterConfig(model="by_rows")
    rows = [(name, engine.resolve_model(config, stats.dimension_count(t), t.count())) for name, t in tables.items()]
    return spark.createDataFrame(rows, "source string, model string")


@query("SELECT vec_id, CAST(i AS INTEGER) AS dim, CAST(round(ln(1 + CAST(embedding[6 + i] AS DOUBLE)) * 1e9) AS BIGINT) AS x FROM embeddings, generate_series(0, 4) AS t(i)")
def log1p_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = log1p_vector(slice_columns(F.col("embedding").cast("array<double>"), 5, 10))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vec).alias("dim", "x")).withColumn("x", _scaled(F.col("x")))


@query("SELECT min(g) AS gap_value FROM (SELECT value - lag(value) OVER (ORDER BY value) AS g FROM (SELECT DISTINCT value FROM events)) WHERE g > 0")
def min_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_columns(_table(spark, sf_dir, "events"), "event_id", ["value"])
    return stats.min_gap(rows).agg(F.min("gap").alias("gap_value"))


# --- grid codes --------------------------------------------------------------


def _cell_sql(x: str, low: str, high: str, scale: str) -> str:
    last = f"(CAST(1 AS BIGINT) << {scale}) - 1"
    return f"CASE WHEN {x} = {low} THEN 0 WHEN {x} = {high} THEN {last} ELSE least(CAST(floor(({x} - {low}) / ({high} - {low}) * CAST(CAST(1 AS BIGINT) << {scale} AS DOUBLE)) AS BIGINT), {last}) END"


def _cells_sql(source: str, d: int, scale: int, more: str = "") -> str:
    """Cells c0.. of a query with x0.. (and what ``more`` names)."""
    bounds = ", ".join(f"min(x{j}) AS a{j}, max(x{j}) AS b{j}" for j in range(d))
    cells = ", ".join(f"{_cell_sql(f'x{j}', f'a{j}', f'b{j}', str(scale))} AS c{j}" for j in range(d))
    return f"SELECT {more}{cells} FROM ({source}) AS src, (SELECT {bounds} FROM ({source}))"


def _code_sql(d: int, scale: str, cells: str = "c") -> str:
    """The interleaved bits as text."""
    digits = " || ".join(f"substr(lpad(bin({cells}{j}), CAST({scale} AS INTEGER), '0'), CAST(i AS BIGINT), 1)" for j in range(d))
    return f"array_to_string(list_transform(generate_series(1, {scale}), lambda i: {digits}), '')"


def _number_sql(d: int, most: int) -> str:
    """The interleaved bits of c0.. as a number; bits above the scale are 0."""
    return " + ".join(f"(((c{j} >> {i}) & 1) << {i * d + d - 1 - j})" for j in range(d) for i in range(most))


def _graph_sql(source: str, d: int, scales: list[int]) -> str:
    """CTEs nodes (scale, code, c.., items), pairs, and labels (scale, node, label)."""
    top = max(scales)
    shifted = ", ".join(f"c{j} >> ({top} - scale) AS c{j}" for j in range(d))
    names = ", ".join(f"c{j}" for j in range(d))
    near = " AND ".join(f"b.c{j} BETWEEN a.c{j} - 1 AND a.c{j} + 1" for j in range(d))
    values = ", ".join(f"({s})" for s in scales)
    return f"""base AS MATERIALIZED ({_cells_sql(source, d, top)}),
cells AS MATERIALIZED (SELECT scale, {shifted} FROM base, (VALUES {values}) AS t(scale)),
nodes AS MATERIALIZED (SELECT scale, {names}, CAST({_number_sql(d, top)} AS BIGINT) AS code, count(*) AS items FROM cells GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a.scale, a.code AS u, b.code AS v FROM nodes a JOIN nodes b ON a.scale = b.scale AND {near} AND a.code <> b.code),
labels(scale, node, label) USING KEY (scale, node) AS (
  SELECT scale, code, code FROM nodes
  UNION
  SELECT p.scale, p.v, min(l.label) FROM labels l JOIN pairs p ON l.scale = p.scale AND l.node = p.u
    JOIN recurring.labels r ON r.scale = p.scale AND r.node = p.v WHERE l.label < r.label GROUP BY ALL
)"""


def _summary_sql(source: str, d: int, scales: list[int]) -> str:
    return f"""WITH RECURSIVE {_graph_sql(source, d, scales)}
SELECT CAST(n.scale AS INTEGER) AS scale, l.label AS cluster, count(*) AS codes, CAST(sum(n.items) AS BIGINT) AS items
FROM nodes n JOIN labels l ON l.scale = n.scale AND l.node = n.code GROUP BY ALL"""


PART_XY = "SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_columns(_table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


def _part_cells(spark: SparkSession, sf_dir: str, scale: int, grid: str = "per_dim") -> DataFrame:
    rows = _part(spark, sf_dir)
    return sdcode.cell_columns(rows, stats.column_stats(rows, 2).collect(), scale, grid)


@query(_cells_sql(PART_XY, 2, 8, "item_id, "))
def sd_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_cells(spark, sf_dir, 8).select("item_id", "c0", "c1")


@query(f"SELECT item_id, {_code_sql(2, '8')} AS code FROM ({_cells_sql(PART_XY, 2, 8, 'item_id, ')})")
def sd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_cells(spark, sf_dir, 8)
    return rows.select("item_id", sdcode.code_text([F.col("c0"), F.col("c1")], 8).alias("code"))


@query(f"SELECT item_id, CAST(s AS INTEGER) AS scale, substr({_code_sql(2, '8')}, 1, CAST(2 * s AS BIGINT)) AS code FROM ({_cells_sql(PART_XY, 2, 8, 'item_id, ')}), generate_series(1, 8) AS t(s)")
def sd_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part_cells(spark, sf_dir, 8).withColumn("scale", F.explode(F.sequence(F.lit(1), F.lit(8))))
    cells = [F.expr(f"shiftright({c}, 8 - scale)") for c in ("c0", "c1")]
    return rows.select("item_id", "scale", sdcode.number_as_text(sdcode.code_number(cells, 8), 2 * F.col("scale")).alias("code"))


@query(f"""WITH base AS ({_cells_sql(LINE_XY, 2, 10)}), here AS (SELECT s AS scale, c0 >> CAST(10 - s AS BIGINT) AS c0, c1 >> CAST(10 - s AS BIGINT) AS c1 FROM base, generate_series(1, 10) AS t(s))
SELECT CAST(scale AS INTEGER) AS scale, CAST({_number_sql(2, 10)} AS BIGINT) AS code, count(*) AS items FROM here GROUP BY ALL""")
def sd_distinct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise(_lineitem(spark, sf_dir))
    cells = sdcode.cell_columns(rows, stats.column_stats(rows, 2).collect(), 10)
    return sdcode.occupied(cells, 2, 10, list(range(1, 11))).select("scale", "code", "items")


def _part_pairs_sql(scale: int, radius: int) -> str:
    near = " AND ".join(f"b.c{j} BETWEEN a.c{j} - {radius} AND a.c{j} + {radius}" for j in range(2))
    return f"""WITH cells AS (SELECT DISTINCT c0, c1 FROM ({_cells_sql(PART_XY, 2, scale)})),
nodes AS (SELECT c0, c1, CAST({_number_sql(2, scale)} AS BIGINT) AS code FROM cells)
SELECT {scale} AS scale, least(a.code, b.code) AS u, greatest(a.code, b.code) AS v FROM nodes a JOIN nodes b ON a.code < b.code AND {near}"""


def _part_pairs(spark: SparkSession, sf_dir: str, scale: int, radius: int) -> DataFrame:
    nodes = sdcode.occupied(_part_cells(spark, sf_dir, scale), 2, scale, [scale])
    pairs = sdcode.neighbour_pairs(nodes, 2, radius)
    return pairs.select("scale", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


@query(_part_pairs_sql(6, 1))
def sd_neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir, 6, 1)


@query(_part_pairs_sql(6, 2))
def sd_neighbours_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_pairs(spark, sf_dir, 6, 2)


def _sd(items: DataFrame, d: int, scales: tuple[int, ...], standardise: bool) -> engine.SdRun:
    config = ClusterConfig(model="SD", scales=scales, start_scale=min(scales), end_scale=max(scales), standardise=standardise)
    return engine.run_sd(items, config, d)


@query(_summary_sql(LINE_XY, 2, [4, 6, 8, 10]))
def sd_cluster_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sd(_lineitem(spark, sf_dir), 2, (4, 6, 8, 10), True).summary()


@query(f"""WITH RECURSIVE {_graph_sql(LINE_XY, 2, [4, 6, 8, 10])}
SELECT CAST(n.scale AS INTEGER) AS scale, l.label AS cluster, CAST(sum(n.items) AS BIGINT) AS items
FROM nodes n JOIN labels l ON l.scale = n.scale AND l.node = n.code GROUP BY ALL""")
def sd_items_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item is joined with its labels, then they are counted."""
    items = _sd(_lineitem(spark, sf_dir), 2, (4, 6, 8, 10), True).items()
    return items.groupBy("scale", "cluster").agg(F.count("item_id").alias("items"))


EVENTS = "SELECT event_id AS item_id, value AS x0 FROM events"


@query(f"""WITH base AS MATERIALIZED ({_cells_sql(EVENTS, 1, 12, "item_id, ")}),
here AS (SELECT item_id, CAST(s AS INTEGER) AS scale, c0 >> (12 - s) AS c FROM base, (VALUES (4), (6), (8), (10), (12)) AS t(s)),
marked AS (SELECT scale, c, CASE WHEN c - lag(c) OVER (PARTITION BY scale ORDER BY c) = 1 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT scale, c FROM here)),
islands AS (SELECT scale, c, sum(new) OVER (PARTITION BY scale ORDER BY c) AS island FROM marked),
labels AS (SELECT scale, c, min(c) OVER (PARTITION BY scale, island) AS cluster FROM islands)
SELECT here.scale, item_id, cluster FROM here JOIN labels USING (scale, c)""")
def sd_cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_columns(_table(spark, sf_dir, "events"), "event_id", ["value"])
    return _sd(rows, 1, (4, 6, 8, 10, 12), False).items()


SUPPLIER = "SELECT s_suppkey AS item_id, CAST(s_nationkey AS DOUBLE) AS x0, s_acctbal AS x1, CAST(s_suppkey % 7 AS DOUBLE) AS x2 FROM supplier"


@query(_summary_sql(SUPPLIER, 3, [2, 3]))
def sd_cluster_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").withColumn("_m", F.col("s_suppkey") % 7)
    return _sd(read_columns(rows, "s_suppkey", ["s_nationkey", "s_acctbal", "_m"]), 3, (2, 3), False).summary()


CUSTOMER = "SELECT c_custkey AS item_id, c_name AS name, CAST(c_nationkey AS DOUBLE) AS x0, c_acctbal AS x1 FROM customer"


def _customer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_columns(_table(spark, sf_dir, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])
    return _sd(rows, 2, (4, 5, 6), False).items()


def _members_sql(what: str) -> str:
    graph = _graph_sql(CUSTOMER, 2, [4, 5, 6])
    return f"""WITH RECURSIVE {graph},
named AS (SELECT scale, name, c0 >> (6 - scale) AS c0, c1 >> (6 - scale) AS c1 FROM ({_cells_sql(CUSTOMER, 2, 6, "name, ")}), (VALUES (4), (5), (6)) AS t(scale)),
clusters AS (SELECT named.scale, named.name, label AS cluster FROM named JOIN nodes USING (scale, c0, c1) JOIN labels l ON l.scale = nodes.scale AND l.node = nodes.code)
SELECT CAST(scale AS INTEGER) AS scale, cluster, {what} FROM clusters GROUP BY ALL"""


@query(_members_sql("count(*) AS size"))
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cluster_sizes(_customer_clusters(spark, sf_dir))


@query(_members_sql("string_agg(name, ',' ORDER BY name) AS members"))
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer")
    return evaluate.cluster_texts(evaluate.cluster_members(_customer_clusters(spark, sf_dir), names, "c_custkey", "c_name"))


@query("""WITH src AS (SELECT p_partkey AS item_id, CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part),
b AS (SELECT min(x0) AS a0, min(x1) AS a1, greatest(max(x0) - min(x0), max(x1) - min(x1)) / 256 AS gap FROM src)
SELECT item_id, greatest(0, least(255, CAST(floor((x0 - a0) / gap) AS BIGINT))) AS c0, greatest(0, least(255, CAST(floor((x1 - a1) / gap) AS BIGINT))) AS c1 FROM src, b""")
def iso_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_cells(spark, sf_dir, 8, "isotropic").select("item_id", "c0", "c1")


@query(f"""WITH src AS ({PART_XY}), b AS (SELECT min(x0) AS a0, min(x1) AS a1, (max(x0) - min(x0)) / 12 AS g0, (max(x1) - min(x1)) / 12 AS g1 FROM src)
SELECT item_id, CAST(floor((x0 - a0) / g0) AS BIGINT) AS level0, CAST(floor((x1 - a1) / g1) AS BIGINT) AS level1 FROM src, b""")
def int_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir)
    out = sdcode.level_codes(rows, stats.column_stats(rows, 2).collect(), 12)
    return out.select("item_id", F.get("levels", F.lit(0)).alias("level0"), F.get("levels", F.lit(1)).alias("level1"))


@query("""WITH b AS (SELECT min(c_acctbal) AS low, max(c_acctbal) - min(c_acctbal) AS span FROM customer),
g AS (SELECT min(gap) AS least FROM (SELECT c_acctbal - lag(c_acctbal) OVER (ORDER BY c_acctbal) AS gap FROM (SELECT DISTINCT c_acctbal FROM customer)) WHERE gap > 0),
grid AS (SELECT low, span, CAST(floor(log2(span / least)) AS INTEGER) AS bits FROM b, g),
here AS MATERIALIZED (SELECT c_custkey AS item_id, greatest(0, least((CAST(1 AS BIGINT) << bits) - 1, CAST(floor((c_acctbal - low) / (span / CAST(CAST(1 AS BIGINT) << bits AS DOUBLE))) AS BIGINT))) AS c, bits FROM customer, grid),
spots AS (SELECT DISTINCT s AS scale, c, CAST(floor(pow(1.5::DOUBLE, bits - s)) AS BIGINT) AS n FROM here, (VALUES (14), (16)) AS t(s)),
marked AS (SELECT scale, c, CASE WHEN c - lag(c) OVER (PARTITION BY scale ORDER BY c) <= n THEN 0 ELSE 1 END AS new FROM spots),
islands AS (SELECT scale, c, sum(new) OVER (PARTITION BY scale ORDER BY c) AS island FROM marked),
labels AS (SELECT scale, c, min(c) OVER (PARTITION BY scale, island) AS cluster FROM islands)
SELECT scale, item_id, cluster FROM here JOIN labels USING (c)""")
def weber_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_columns(_table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])
    return engine.run_weber(rows, 1, 0.5, scales=[14, 16])


# --- signatures --------------------------------------------------------------

MIN_SCALES = (36, 37, 38, 39)
MIN_CONFIG = ClusterConfig(model="MIN", growth=0.1, start_scale=36, end_scale=39)

BITS_SQL = """x AS MATERIALIZED (SELECT vec_id AS item_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings),
u AS MATERIALIZED (SELECT item_id, unnest(generate_series(0, 63)) AS dim, unnest(list_transform(v, lambda e: e / sqrt(list_sum(list_transform(v, lambda f: f * f))))) AS e FROM x),
mid AS MATERIALIZED (SELECT dim, min(e) + (max(e) - min(e)) / 2 AS m FROM u GROUP BY dim),
bits AS MATERIALIZED (SELECT item_id, dim, CASE WHEN e >= m THEN 1 ELSE 0 END AS bit FROM u JOIN mid USING (dim))"""

def _family_sql(functions: int) -> str:
    return f"""draws(i, state) AS (
  SELECT 0, CAST(25214903817 AS HUGEINT)
  UNION ALL SELECT i + 1, (state * 25214903917 + 11) % 281474976710656 FROM draws WHERE i < {2 * functions}
),
ints AS (SELECT i, CASE WHEN w >= 2147483648 THEN w - 4294967296 ELSE w END AS z FROM (SELECT i, CAST(state // 65536 AS BIGINT) AS w FROM draws WHERE i > 0)),
family AS MATERIALIZED (SELECT CAST(p.i // 2 AS INTEGER) AS f, p.z AS a, q.z AS b FROM ints p JOIN ints q ON q.i = p.i + 1 WHERE p.i % 2 = 1)"""


HASHED_SQL = """hashed AS MATERIALIZED (SELECT dim, bit, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (
  SELECT dim, bit, list_reduce(list_transform(string_split(dim || '-' || bit, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda p, c: (31 * p + c) % 4294967296) AS h
  FROM generate_series(0, 63) AS d(dim), (VALUES (0), (1)) AS t(bit)))"""


def _signature_sql(functions: int = 125) -> str:
    return f"""{BITS_SQL}, {_family_sql(functions)}, {HASHED_SQL},
entry AS MATERIALIZED (SELECT item_id, f, min((a * h + b) % 2147483647) AS s FROM bits JOIN hashed USING (dim, bit), family GROUP BY item_id, f),
sig AS MATERIALIZED (SELECT item_id, list(s ORDER BY f) AS sig FROM entry GROUP BY item_id)"""


def _bands_sql(functions: int = 125, bands: int = 25) -> str:
    rows = functions // bands
    return f"""{_signature_sql(functions)},
banded AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS band, sig[i * {rows} + 1 : i * {rows} + {rows}] AS key, item_id FROM sig, generate_series(0, {bands - 1}) AS t(i))"""


def _pairs_sql(limit: int | None, functions: int = 125, bands: int = 25) -> str:
    hubs = "banded" if limit is None else f"(SELECT * FROM banded QUALIFY row_number() OVER (PARTITION BY band, key ORDER BY item_id) <= {limit})"
    return f"""{_bands_sql(functions, bands)},
pairs AS MATERIALIZED (SELECT DISTINCT least(h.item_id, m.item_id) AS u, greatest(h.item_id, m.item_id) AS v FROM {hubs} h JOIN banded m USING (band, key) WHERE h.item_id <> m.item_id)"""


def _scored_sql(functions: int = 125) -> str:
    return f"""scored AS MATERIALIZED (SELECT u, v, len(list_filter(list_zip(a.sig, b.sig), lambda z: z[1] = z[2])) / {functions}.0::DOUBLE AS sim FROM pairs JOIN sig a ON a.item_id = u JOIN sig b ON b.item_id = v)"""


def _labels_sql(scales: tuple[int, ...]) -> str:
    """Labels of the components of ``edges``, the least item id."""
    values = ", ".join(f"({s})" for s in scales)
    return f"""both_ways AS MATERIALIZED (SELECT scale, u, v FROM edges UNION ALL SELECT scale, v, u FROM edges),
labels(scale, node, label) USING KEY (scale, node) AS (
  SELECT CAST(s AS INTEGER), vec_id, vec_id FROM embeddings, (VALUES {values}) AS t(s)
  UNION
  SELECT p.scale, p.v, min(l.label) FROM labels l JOIN both_ways p ON l.scale = p.scale AND l.node = p.u
    JOIN recurring.labels r ON r.scale = p.scale AND r.node = p.v WHERE l.label < r.label GROUP BY ALL
)"""


EDGES_SQL = f"""{_pairs_sql(5)},
{_scored_sql()},
edges AS MATERIALIZED (SELECT CAST(s AS INTEGER) AS scale, u, v FROM scored, generate_series(36, 39) AS t(s) WHERE sim >= pow(1.1::DOUBLE, s - 1) / 64)"""

CLUSTERS_SQL = f"""{EDGES_SQL},
{_labels_sql(MIN_SCALES)}"""

#: Scales of the runs without a hub limit, whose thresholds are 1.1^s / 64.
HIGH_SCALES = (36, 37, 38)
HIGH_EDGES_SQL = f"""{_pairs_sql(None, 128, 32)},
{_scored_sql(128)},
near AS MATERIALIZED (SELECT CAST(s AS INTEGER) AS scale, u, v FROM scored, generate_series({HIGH_SCALES[0]}, {HIGH_SCALES[-1]}) AS t(s) WHERE sim >= pow(1.1::DOUBLE, s) / 64)"""

F1_SQL = """n AS (SELECT l.scale, l.label AS cluster, e.label, count(*) AS n FROM labels l JOIN embeddings e ON e.vec_id = l.node GROUP BY ALL),
top AS (SELECT scale, cluster, label, n, sum(n) OVER (PARTITION BY scale, cluster) AS size FROM n QUALIFY row_number() OVER (PARTITION BY scale, cluster ORDER BY n DESC, label) = 1),
classes AS (SELECT label, count(*) AS class_size FROM embeddings GROUP BY label),
rated AS (SELECT t.*, n / size AS p, n / class_size AS r FROM top t JOIN classes USING (label) WHERE size > 1),
best AS (SELECT *, 2 * p * r / (p + r) AS f1 FROM rated QUALIFY row_number() OVER (PARTITION BY label ORDER BY 2 * p * r / (p + r) DESC, scale, cluster) = 1)
SELECT c.label, class_size, CAST(round(coalesce(f1, 0) * 1e9) AS BIGINT) AS f1, CAST(round(coalesce(p, 0) * 1e9) AS BIGINT) AS "precision", CAST(round(coalesce(r, 0) * 1e9) AS BIGINT) AS recall, CAST(coalesce(size, 0) AS BIGINT) AS cluster_size, coalesce(scale, -1) AS scale, coalesce(cluster, -1) AS cluster
FROM classes c LEFT JOIN best USING (label)"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(minhash.signatures(engine.min_bits(_embeddings(spark, sf_dir), MIN_CONFIG, 64), 64, 125), "signatures")


@query(f"WITH RECURSIVE {BITS_SQL} SELECT item_id, string_agg(dim || '-' || bit, ',' ORDER BY dim) AS shingles FROM bits GROUP BY item_id")
def min_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = engine.min_bits(_embeddings(spark, sf_dir), MIN_CONFIG, 64)
    return bits.select("item_id", F.array_join(minhash.shingles(F.col("bits")), ",").alias("shingles"))


@query(f"WITH RECURSIVE {_family_sql(125)} SELECT f, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM family")
def min_hash_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(hash_family(125))], "f int, a long, b long")


@query(f"WITH RECURSIVE {_signature_sql()} SELECT item_id, array_to_string(sig, ',') AS signature FROM sig")
def min_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("item_id", F.array_join(F.col("sig").cast("array<string>"), ",").alias("signature"))


@query(f"WITH RECURSIVE {_bands_sql()} SELECT band, array_to_string(key, ',') AS key, count(*) AS n, min(item_id) AS first_item FROM banded GROUP BY ALL")
def min_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.bands(_signatures(spark, sf_dir), 125, 25)
    return rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item")).withColumn("key", F.array_join(F.col("key").cast("array<string>"), ","))


@query(f"WITH RECURSIVE {_pairs_sql(5)} SELECT u, v FROM pairs")
def min_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.candidates(minhash.bands(_signatures(spark, sf_dir), 125, 25), 5)


@query(f"WITH RECURSIVE {_pairs_sql(None)} SELECT u, v FROM pairs")
def min_candidates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.candidates(minhash.bands(_signatures(spark, sf_dir), 125, 25), None)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sigs = _signatures(spark, sf_dir)
    scored = minhash.scored_pairs(minhash.candidates(minhash.bands(sigs, 125, 25), 5), sigs, 125)
    return minhash.ladder_edges(scored, engine.min_ladder(MIN_CONFIG, 64))


@query(f"WITH RECURSIVE {EDGES_SQL} SELECT scale, u, v FROM edges")
def min_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@query(f"WITH RECURSIVE {CLUSTERS_SQL} SELECT scale, node AS item_id, label AS cluster FROM labels")
def min_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.cluster(_embeddings(spark, sf_dir), MIN_CONFIG)


@query(f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT scale, u, v FROM edges UNION SELECT scale, v, u FROM edges)
SELECT scale, u AS node, count(*) AS degree FROM both_ways GROUP BY ALL""")
def min_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    ends = edges.select("scale", F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("scale", "node").agg(F.count(F.lit(1)).alias("degree"))


@query(f"""WITH RECURSIVE {CLUSTERS_SQL} SELECT scale, node, label AS component FROM labels SEMI JOIN both_ways e ON e.scale = labels.scale AND e.u = labels.node""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_components(_edges(spark, sf_dir), ["scale"])


def _f1(spark: SparkSession, sf_dir: str, clusters: DataFrame) -> DataFrame:
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    out = evaluate.best_f1(clusters, labels)
    out = out.fillna(0, ["precision", "recall", "cluster_size"]).fillna(-1, ["scale", "cluster"])
    return out.withColumns({c: _scaled(F.col(c)) for c in ("f1", "precision", "recall")})


@query(f"WITH RECURSIVE {CLUSTERS_SQL},\n{F1_SQL}")
def cluster_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, engine.cluster(_embeddings(spark, sf_dir), MIN_CONFIG))


@query(f"""WITH RECURSIVE {CLUSTERS_SQL},
n AS (SELECT l.scale, l.label AS cluster, e.label, count(*) AS n FROM labels l JOIN embeddings e ON e.vec_id = l.node GROUP BY ALL)
SELECT scale, cluster, CAST(sum(n) OVER (PARTITION BY scale, cluster) AS BIGINT) AS size, label, n FROM n QUALIFY sum(n) OVER (PARTITION BY scale, cluster) > 2""")
def cluster_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "label")
    return evaluate.cluster_tags(engine.cluster(_embeddings(spark, sf_dir), MIN_CONFIG), labels)


@query(f"""WITH RECURSIVE {HIGH_EDGES_SQL}, edges AS MATERIALIZED (SELECT * FROM near),
{_labels_sql(HIGH_SCALES)} SELECT scale, node AS item_id, label AS cluster FROM labels""")
def highd_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.run_highd(_embeddings(spark, sf_dir), 64, 0.1, scales=list(HIGH_SCALES))


@query(f"""WITH RECURSIVE {HIGH_EDGES_SQL},
unit AS MATERIALIZED (SELECT item_id, list(e ORDER BY dim) AS v FROM u GROUP BY item_id),
directed AS (SELECT scale, near.u AS src, near.v AS dst FROM near UNION ALL SELECT scale, near.v, near.u FROM near
  UNION ALL SELECT CAST(s AS INTEGER), item_id, item_id FROM unit, generate_series({HIGH_SCALES[0]}, {HIGH_SCALES[-1]}) AS t(s)),
cosine AS MATERIALIZED (SELECT scale, src, dst, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS c FROM directed JOIN unit a ON a.item_id = src JOIN unit b ON b.item_id = dst),
ranked AS (SELECT scale, src, dst, c, sqrt(avg(exp((c - 1) / 0.1::DOUBLE)) OVER (PARTITION BY scale, src)) AS sigma, row_number() OVER (PARTITION BY scale, src ORDER BY c DESC, dst) AS r FROM cosine),
edges AS MATERIALIZED (SELECT DISTINCT scale, least(src, dst) AS u, greatest(src, dst) AS v FROM ranked WHERE src <> dst AND (c - 1 >= -sigma OR r = 2)),
{_labels_sql(HIGH_SCALES)},
{F1_SQL}""")
def gaussian_cluster_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, engine.run_gaussian(_embeddings(spark, sf_dir), 64, 0.1, scales=list(HIGH_SCALES)))


@query(f"""WITH RECURSIVE {_pairs_sql(5)},
unit AS MATERIALIZED (SELECT item_id, list(e ORDER BY dim) AS v FROM u GROUP BY item_id),
directed AS (SELECT pairs.u AS src, pairs.v AS dst FROM pairs UNION ALL SELECT pairs.v, pairs.u FROM pairs UNION ALL SELECT item_id, item_id FROM unit),
cosine AS MATERIALIZED (SELECT src, dst, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS c FROM directed JOIN unit a ON a.item_id = src JOIN unit b ON b.item_id = dst),
ranked AS (SELECT src, dst, c, sqrt(avg(exp((c - 1) / 0.1::DOUBLE)) OVER (PARTITION BY src)) AS sigma, row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) AS r FROM cosine)
SELECT src, dst FROM ranked WHERE c - 1 >= -sigma OR r = 2""")
def gaussian_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = normalise(_embeddings(spark, sf_dir)).select("item_id", "vec")
    pairs = min_candidates(spark, sf_dir)
    directed = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(pairs.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    directed = directed.unionByName(unit.select(F.col("item_id").alias("src"), F.col("item_id").alias("dst")))
    a, b = (unit.select(F.col("item_id").alias(n), F.col("vec").alias(f"_{n}")) for n in ("src", "dst"))
    scored = directed.join(a, "src").join(b, "dst").select("src", "dst", dot(F.col("_src"), F.col("_dst")).alias("cos"))
    return minhash.gaussian_prune(scored)
