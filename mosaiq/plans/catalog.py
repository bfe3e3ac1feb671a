"""The registered queries over the driver's tables, each with the SQL that states its rows.

Roles of the tables: ``embeddings`` is a vector modality (its absolute values where a non-negative one
is needed), ``documents`` a text modality, ``events`` ordered series by user and intervals between a
user's events, ``conversations`` tags and turns, ``lineitem`` a numeric matrix, ``orders`` a second
labelled modality, ``nation`` and ``region`` descriptions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transforms as T
from ..functions import vectors as V
from ..operators import density, evaluation, factorize, information, matrix, pairing, quantize, series, sliding, windows
from ..sources import recordings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def vectors(self, absolute: bool = False) -> DataFrame:
        """``i, v, label`` of the embeddings in double precision."""
        v = F.col("embedding").cast("array<double>")
        return self.embeddings.select(F.col("vec_id").alias("i"), (F.transform(v, F.abs) if absolute else v).alias("v"), "label")

    def cells(self) -> DataFrame:
        return matrix.long_form(self.embeddings, "vec_id", "embedding", F.abs)

    def labelled_cells(self) -> DataFrame:
        """``i, label, j, x`` of the embeddings, without joining the table to itself."""
        return self.embeddings.select(F.col("vec_id").alias("i"), "label", F.posexplode("embedding").alias("j", "x")).select("i", "label", F.col("j").cast("long").alias("j"), F.abs(F.col("x").cast("double")).alias("x"))

    def examples(self, absolute: bool = True) -> DataFrame:
        return evaluation.examples(self.vectors(absolute), "i", "label").select(F.col("i").alias("ex_id"), F.col("v").alias("ev"), F.col("label").alias("ex_label"))

    def codebook(self) -> DataFrame:
        ex = self.examples(False)
        return ex.select(F.col("ex_label").alias("code"), F.col("ev").alias("centroid"))

    def series(self) -> DataFrame:
        """``user_id, t, event_id, value, code`` of events: seconds since the epoch and a code from 0 to 4."""
        codes = self.events.select("event_type").distinct().withColumn("code", F.row_number().over(Window.orderBy("event_type")) - 1)
        return self.events.join(pairing.small(codes), "event_type").select("user_id", F.col("ts"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6).alias("t"), "event_id", "value", "event_type", F.col("code").cast("long").alias("code"))


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    """Rounded, and never negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0)


# Common parts of the SQL.
_V = "v AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_A = "v AS (SELECT vec_id AS i, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS v, label FROM embeddings)"
_EX = "ex AS (SELECT i AS ex_id, v AS ev, label AS ex_label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY i) AS rn FROM v) WHERE rn = 1)"
_CELLS = "m AS (SELECT vec_id AS i, CAST(unnest(range(len(embedding))) AS BIGINT) AS j, abs(CAST(unnest(embedding) AS DOUBLE)) AS x FROM embeddings)"
_SERIES = "s AS (SELECT user_id, ts, epoch_us(ts) / 1e6 AS t, event_id, value, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events)"


def _sum(a: str, b: str, body: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {body}))"


_KL = lambda a, b: _sum(a, b, "z[1] * ln((z[1] + 1e-8) / (z[2] + 1e-8)) - z[1] + z[2]")
_DOT = lambda a, b: _sum(a, b, "z[1] * z[2]")
_FROB = lambda a, b: f"sqrt({_sum(a, b, '(z[1] - z[2]) * (z[1] - z[2])')})"
_COS = lambda a, b: f"({_DOT(a, b)} / (sqrt({_DOT(a, a)} * {_DOT(b, b)}) + CASE WHEN {_DOT(a, b)} = 0 THEN 1 ELSE 0 END))"
_DIST = {"kl": _KL("v", "ev"), "rev_kl": _KL("ev", "v"), "frob": _FROB("v", "ev"), "cosine": f"-{_COS('v', 'ev')}"}
_MEASURE = {"kl": "kl", "rev_kl": "rev_kl", "frob": "frobenius", "cosine": "cosine"}


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


# -- sources, projections, selections

@query("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name, r_name AS description FROM nation JOIN region ON n_regionkey = r_regionkey")
def label_lookup(t: Tables) -> DataFrame:
    return t.nation.join(pairing.small(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("id"), "n_name", F.col("r_name").alias("description"))


@query("SELECT conv_id, role, CAST(count(*) AS BIGINT) AS n, CAST(min(turn) AS BIGINT) AS first_turn FROM conversations GROUP BY ALL")
def nested_explode(t: Tables) -> DataFrame:
    """Nested records by conversation, flattened again."""
    groups = recordings.nested(t.conversations, ("conv_id",), "turn", "turn", "role")
    return recordings.unnested(groups, "conv_id").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").cast("long").alias("first_turn"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def blacklist_anti(t: Tables) -> DataFrame:
    return recordings.without(t.documents.select("doc_id", "source"), t.labels.filter("quality = 0"), ("doc_id",))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def outer_union_records(t: Tables) -> DataFrame:
    return recordings.of_either(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id").select("doc_id", "lang", "quality")


_LINE = "concat(CAST(event_id AS VARCHAR), '_o0', CAST(code AS VARCHAR), '_', CAST(CAST(floor(t) AS BIGINT) AS VARCHAR), '.5 | 10 6 ', CAST(user_id AS VARCHAR), ' 336')"


@query(f"WITH {_SERIES} SELECT event_id, CAST(code AS INTEGER) AS label, CAST(floor(t) AS DOUBLE) + 0.5 AS ts, CAST(user_id AS INTEGER) AS v2 FROM s")
def parse_frame_lines(t: Tables) -> DataFrame:
    """Frame lines made of the events, and parsed."""
    from ..sources.objects import parse_lines

    line = F.format_string("%d_o0%d_%d.5 | 10 6 %d 336", "event_id", "code", F.floor("t"), "user_id")
    parsed = parse_lines(t.series().select("event_id", line.alias("line")), "line")
    return parsed.select("event_id", "label", "ts", F.col("views")[0]["v2"].alias("v2"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def label_in_filter(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang")


@query(f"WITH {_V} SELECT i, {_r('list_sum(v[17:32])', 'total')}, CAST(len(v[17:32]) AS BIGINT) AS dim FROM v")
def modality_slice(t: Tables) -> DataFrame:
    v = t.vectors().withColumn("part", F.slice("v", 17, 16))
    return v.select("i", r6(V.total(F.col("part"))).alias("total"), F.size("part").cast("long").alias("dim"))


@query("SELECT vec_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 THEN 'example' ELSE 'sample' END AS part FROM embeddings")
def examples_split(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "label")
    ex = evaluation.examples(e, "vec_id", "label").select("vec_id")
    return ex.withColumn("part", F.lit("example")).union(e.select("vec_id").join(ex, "vec_id", "left_anti").withColumn("part", F.lit("sample")))


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_extendedprice, 50000.0), 1000.0) AS price FROM lineitem")
def clip_bounds(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", V.clip(F.col("l_extendedprice"), 1000.0, 50000.0).alias("price"))


@query(f"SELECT l_orderkey, l_linenumber, {_r('(l_quantity - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END', 'scaled')} FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)")
def minmax_normalize(t: Tables) -> DataFrame:
    b = t.lineitem.agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity").join(F.broadcast(b)).select("l_orderkey", "l_linenumber", r6(V.minmax(F.col("l_quantity"), F.col("lo"), F.col("hi"))).alias("scaled"))


_INTERVALS = f"{_SERIES}, w AS (SELECT * FROM (SELECT user_id, event_id, code, t AS st, lead(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS en FROM s) WHERE en IS NOT NULL)"


def _intervals(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.series().select("user_id", "event_id", "code", "ts", F.col("t").alias("start"), F.lead("t").over(w).alias("end")).filter("end IS NOT NULL")


@query(f"WITH {_INTERVALS} SELECT user_id, event_id FROM w WHERE (st + en) / 2 BETWEEN 1704500000 AND 1705500000")
def window_mean_filter(t: Tables) -> DataFrame:
    return _intervals(t).filter(((F.col("start") + F.col("end")) / 2).between(1704500000, 1705500000)).select("user_id", "event_id")


@query("SELECT CAST(count(*) FILTER (x < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (isnan(x) OR isinf(x) OR x IS NULL) AS BIGINT) AS not_finite, CAST(count(*) AS BIGINT) AS cells FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)")
def validate_nonneg(t: Tables) -> DataFrame:
    return matrix.violations(matrix.long_form(t.embeddings, "vec_id", "embedding"))


# -- pairing and joins

@query("""WITH e AS (SELECT event_id, li, row_number() OVER (PARTITION BY li ORDER BY event_id) AS rn FROM (SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS li FROM events)),
o AS (SELECT o_orderkey, li, row_number() OVER (PARTITION BY li ORDER BY o_orderkey) AS rn FROM (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS li FROM orders))
SELECT e.li AS label_idx, e.rn, event_id AS event, o_orderkey AS ordered FROM e JOIN o ON e.li = o.li AND e.rn = o.rn""")
def label_pairing(t: Tables) -> DataFrame:
    return pairing.pair({"event": (t.events, "event_id", "event_type"), "ordered": (t.orders, "o_orderkey", "o_orderpriority")})


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS label_idx FROM events")
def label_index(t: Tables) -> DataFrame:
    return pairing.label_index(t.events.select("event_id", "event_type"), "event_type").select("event_id", "label_idx")


@query("WITH r AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS label) SELECT r.label, CAST(coalesce(len(m), 0) AS BIGINT) AS n, coalesce(array_to_string(m, ','), '') AS members FROM r LEFT JOIN (SELECT label, list(vec_id ORDER BY vec_id) AS m FROM embeddings GROUP BY label) e ON r.label = e.label")
def bucket_by_label(t: Tables) -> DataFrame:
    got = pairing.buckets(t.embeddings, "vec_id", "label", t.spark.range(12).select(F.col("id").cast("int").alias("label")))
    return got.select("label", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def distribute_cross(t: Tables) -> DataFrame:
    return pairing.distribute(t.nation.select("n_name"), t.region.select("r_name"))


@query(f"""WITH {_INTERVALS}, f AS (SELECT user_id, min(st) AS first FROM w GROUP BY 1),
p AS (SELECT user_id, event_id AS point, t FROM s)
SELECT p.user_id, p.point, w.event_id AS interval_id FROM p JOIN w ON p.user_id = w.user_id JOIN f ON f.user_id = w.user_id
WHERE t > st AND t <= en OR st = first AND t = st""")
def interval_lookup(t: Tables) -> DataFrame:
    points = t.series().select("user_id", F.col("event_id").alias("point"), "t")
    got = windows.lookup(points, "t", _intervals(t).select("user_id", F.col("event_id").alias("interval_id"), "start", "end"), "user_id", 6 * 3600.0)
    return got.select("user_id", "point", "interval_id")


@query(f"""WITH {_INTERVALS}, l AS (SELECT user_id, event_id, st, st + CASE WHEN event_id % 97 = 0 THEN 315576000.0 ELSE 1.0 END AS en FROM w), f AS (SELECT user_id, min(st) AS first FROM l GROUP BY 1)
SELECT s.user_id, s.event_id AS point, l.event_id AS interval_id FROM s JOIN l ON s.user_id = l.user_id JOIN f ON f.user_id = l.user_id WHERE t > st AND t <= en OR st = first AND t = st""")
def interval_lookup_mixed(t: Tables) -> DataFrame:
    """Points in intervals of one second and of ten years mixed: a long one is a few dyadic cells."""
    points = t.series().select("user_id", F.col("event_id").alias("point"), "t")
    end = F.col("start") + F.when(F.col("event_id") % 97 == 0, 315576000.0).otherwise(1.0)
    got = windows.lookup(points, "t", _intervals(t).select("user_id", F.col("event_id").alias("interval_id"), "start", end.alias("end")), "user_id", 60.0)
    return got.select("user_id", "point", "interval_id")


@query("""WITH a AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
l AS (SELECT *, dense_rank() OVER (ORDER BY o_orderpriority) AS li FROM a),
b AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, dense_rank() OVER (ORDER BY event_type) AS li FROM events)
SELECT o_orderkey, event_id AS frame FROM l LEFT JOIN b ON l.li = b.li AND l.rn = b.rn""")
def frame_association(t: Tables) -> DataFrame:
    a = pairing.label_index(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")
    b = pairing.label_index(t.events.select(F.col("event_id").alias("frame"), "event_type"), "event_type")
    return windows.associate_frames(a, b, "label_idx", "frame", "o_orderkey", "frame").select("o_orderkey", "frame")


@query(f"WITH {_CELLS} SELECT i, j, {_r('x', 'x')} FROM (SELECT i, j, x FROM m UNION ALL SELECT i, j + 64, 2 * x FROM m)")
def feature_hstack(t: Tables) -> DataFrame:
    m = t.cells()
    return matrix.hstack((m, 64), (m.withColumn("x", F.col("x") * 2), 64)).select("i", "j", r6("x").alias("x"))


def _distance_query(key: str, name: str) -> None:
    @query(f"WITH {_A}, {_EX} SELECT i, ex_id, {_r(_DIST[key], 'dist')} FROM v CROSS JOIN ex")
    def all_distances(t: Tables) -> DataFrame:
        return evaluation.distances(t.vectors(True), t.examples(), _MEASURE[key]).select("i", "ex_id", r6("dist").alias("dist"))

    for table in (QUERIES, ORACLES):
        table[f"all_distances_{name}"] = table.pop("all_distances")


for _k, _n in (("kl", "kl"), ("frob", "frobenius"), ("cosine", "cosine")):
    _distance_query(_k, _n)


@query("""WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(r_regionkey AS BIGINT) AS j, CAST((n_nationkey * 7 + r_regionkey * 3) % 11 AS DOUBLE) AS w FROM nation CROSS JOIN region)
SELECT sum(w) AS weight FROM c WHERE j = i % 5""")
def assignment_weight(t: Tables) -> DataFrame:
    from ..operators.assignment import weight

    c = pairing.distribute(t.nation, t.region).select(F.col("n_nationkey").cast("long").alias("i"), F.col("r_regionkey").cast("long").alias("j"), ((F.col("n_nationkey") * 7 + F.col("r_regionkey") * 3) % 11).cast("double").alias("w"))
    return weight(c, t.nation.select(F.col("n_nationkey").cast("long").alias("i"), (F.col("n_nationkey") % 5).cast("long").alias("j")))


_W5 = "c AS (SELECT a.n_regionkey AS g, a.rn AS r, b.rn AS j, CAST((a.n_nationkey * 5 + b.rn * 3) % 7 AS DOUBLE) AS w FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey)"


@query(f"""WITH n AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation), {_W5}
SELECT CAST(c1.g AS BIGINT) AS g, min(c1.w + c2.w + c3.w + c4.w + c5.w) AS weight, CAST(5 AS BIGINT) AS n FROM c c1
JOIN c c2 ON c2.g = c1.g AND c2.r = 2 AND c2.j <> c1.j JOIN c c3 ON c3.g = c1.g AND c3.r = 3 AND c3.j NOT IN (c1.j, c2.j)
JOIN c c4 ON c4.g = c1.g AND c4.r = 4 AND c4.j NOT IN (c1.j, c2.j, c3.j) JOIN c c5 ON c5.g = c1.g AND c5.r = 5 AND c5.j NOT IN (c1.j, c2.j, c3.j, c4.j)
WHERE c1.r = 1 GROUP BY c1.g""")
def min_cost_assignment(t: Tables) -> DataFrame:
    """Assigns each region's nations to as many columns: the total weight, which the SQL seeks among all permutations."""
    from ..operators.assignment import assigned

    n = t.nation.withColumn("rn", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("i")), n.select("n_regionkey", F.col("rn").alias("j"))
    cells = a.join(b, "n_regionkey").select(F.col("n_regionkey").cast("long").alias("g"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), ((F.col("i") * 5 + F.col("j") * 3) % 7).cast("double").alias("w"))
    return assigned(cells, "g").groupBy("g").agg(F.sum("w").alias("weight"), F.countDistinct("j").alias("n"))


# -- aggregations

@query(f"WITH {_CELLS} SELECT i, j, {_r('x / (1e-16 + sum(x) OVER (PARTITION BY i))', 'x')} FROM m")
def normalize_sum_rows(t: Tables) -> DataFrame:
    return matrix.normalize_sum(t.cells(), "i").select("i", "j", r6("x").alias("x"))


@query(f"WITH {_CELLS} SELECT i, j, {_r('x / (1e-16 + sum(x) OVER (PARTITION BY j))', 'x')} FROM m")
def normalize_sum_cols(t: Tables) -> DataFrame:
    return matrix.normalize_sum(t.cells(), "j").select("i", "j", r6("x").alias("x"))


_EVEN = "e AS (SELECT i, j, CASE WHEN j % 3 = 0 THEN 0 ELSE x END AS x FROM m)"


@query(f"WITH {_CELLS}, {_EVEN}, n AS (SELECT i, j, x, sum(x) OVER (PARTITION BY j) AS s FROM e) SELECT i, CAST(dense_rank() OVER (ORDER BY j) - 1 AS BIGINT) AS j, {_r('x / s', 'x')} FROM n WHERE s <> 0")
def normalize_features(t: Tables) -> DataFrame:
    m = t.cells().withColumn("x", F.when(F.col("j") % 3 == 0, 0.0).otherwise(F.col("x")))
    return matrix.normalize_features(m).select("i", "j", r6("x").alias("x"))


@query(f"WITH {_A}, c AS (SELECT doc_id, CAST(len(text) AS DOUBLE) AS s FROM documents) SELECT 'vectors' AS modality, {_r('1 / avg(list_sum(v))', 'coef')} FROM v UNION ALL SELECT 'texts', {_r('1 / avg(s)', 'coef')} FROM c")
def modality_coefs(t: Tables) -> DataFrame:
    a = t.vectors(True).agg(F.avg(V.total(F.col("v"))).alias("s")).select(F.lit("vectors").alias("modality"), "s")
    b = t.documents.agg(F.avg(F.length("text").cast("double")).alias("s")).select(F.lit("texts").alias("modality"), "s")
    return a.union(b).select("modality", r6(1 / F.col("s")).alias("coef"))


@query(f"WITH {_CELLS}, l AS (SELECT vec_id AS i, label FROM embeddings), n AS (SELECT label, count(*) AS n FROM l GROUP BY 1) SELECT l.label, j, {_r('sum(x) / any_value(n.n)', 'x')} FROM m JOIN l ON m.i = l.i JOIN n ON n.label = l.label GROUP BY l.label, j")
def avg_by_group_vector(t: Tables) -> DataFrame:
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    m = t.labelled_cells().groupBy("label", "j").agg(F.sum("x").alias("s"))
    return m.join(n, "label").select("label", "j", r6(F.col("s") / F.col("n")).alias("x"))


_LAG = "SELECT user_id, {b} + lead(code, {lag}) OVER (PARTITION BY user_id ORDER BY ts, event_id) * 5 + code AS code FROM s"


@query(f"WITH {_SERIES}, c AS ({_LAG.format(b=0, lag=2)}) SELECT user_id, CAST(code AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL")
def cooccurrence_lag(t: Tables) -> DataFrame:
    return series.cooccurrences(t.series(), "code", 5, [2], "user_id", "ts", "event_id")


@query(f"WITH {_SERIES}, c AS ({_LAG.format(b=0, lag=5)} UNION ALL {_LAG.format(b=25, lag=2)}) SELECT user_id, CAST(code AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n FROM c WHERE code IS NOT NULL GROUP BY ALL")
def cooccurrence_multi_lag(t: Tables) -> DataFrame:
    return series.cooccurrences(t.series(), "code", 5, [5, 2], "user_id", "ts", "event_id")


_D2 = f"{_V}, {_EX}, d AS (SELECT i, label, ex_label AS code, {_sum('v', 'ev', '(z[1] - z[2]) * (z[1] - z[2])')} AS d2 FROM v CROSS JOIN ex)"
_ASSIGN = f"{_D2}, q AS (SELECT i, any_value(label) AS label, arg_min(code, (d2, code)) AS code FROM d GROUP BY i)"
_SOFT = f"{_D2}, e AS (SELECT i, label, code, exp(-d2 / (1e-9 + min(d2) OVER (PARTITION BY i))) AS e FROM d), q AS (SELECT i, label, code, e / sum(e) OVER (PARTITION BY i) AS weight FROM e)"


@query(f"WITH {_ASSIGN} SELECT label, code, {_r('count(*) / sum(count(*)) OVER (PARTITION BY label)', 'share')} FROM q GROUP BY label, code")
def vq_histogram(t: Tables) -> DataFrame:
    return quantize.histogram(quantize.assign(t.vectors(), t.codebook()), "label").select("label", "code", r6("share").alias("share"))


@query(f"WITH {_SOFT}, h AS (SELECT label, code, sum(weight) AS w FROM q GROUP BY label, code) SELECT label, code, {_r('w / sum(w) OVER (PARTITION BY label)', 'share')} FROM h")
def soft_vq_histogram(t: Tables) -> DataFrame:
    w = quantize.soft_assign(t.vectors(), t.codebook()).join(t.embeddings.select(F.col("vec_id").alias("i"), "label"), "i").groupBy("label", "code").agg(F.sum("weight").alias("w"))
    return w.select("label", "code", r6(F.col("w") / F.sum("w").over(Window.partitionBy("label"))).alias("share"))


# -- kernel densities on events.value (0 to 200 in 40 bins) and lineitem

_STEP, _BINS, _H = 5.0, 40, 8.0
_B1 = """b AS (SELECT bin, sum(w) / (any_value(n) * 5.0) AS density FROM (
SELECT CAST(floor(value / 5.0) AS BIGINT) AS bin, 1 - (value / 5.0 - floor(value / 5.0)) AS w, n FROM events, (SELECT count(*) AS n FROM events)
UNION ALL SELECT CAST(floor(value / 5.0) + 1 AS BIGINT), value / 5.0 - floor(value / 5.0), n FROM events, (SELECT count(*) AS n FROM events)) WHERE bin BETWEEN 0 AND 40 GROUP BY bin HAVING sum(w) <> 0)"""
_REACH = int(4 * _H / _STEP)
_K = f"k AS (SELECT d, e / sum(e) OVER () AS k FROM (SELECT d, exp(-0.5 * (d * {_STEP} / {_H}) * (d * {_STEP} / {_H})) AS e FROM (SELECT unnest(range(-{_REACH}, {_REACH} + 1)) AS d)))"
_S1 = "f AS (SELECT bin + d AS bin, sum(density * k) AS density FROM b CROSS JOIN k WHERE bin + d BETWEEN 0 AND 40 GROUP BY bin + d)"


def _density(t: Tables) -> DataFrame:
    return density.smooth(density.bins1d(t.events, "value", 0.0, 200.0, _BINS), ["bin"], density.kernel(_STEP, _H), _BINS)


@query(f"WITH {_B1} SELECT bin, {_r('density', 'density')} FROM b")
def kde1d_bins(t: Tables) -> DataFrame:
    return density.bins1d(t.events, "value", 0.0, 200.0, _BINS).select("bin", r6("density").alias("density"))


@query(f"WITH {_B1}, {_K}, {_S1} SELECT bin, {_r('density', 'density')} FROM f")
def kde1d(t: Tables) -> DataFrame:
    return _density(t).select("bin", r6("density").alias("density"))


@query(f"WITH {_B1}, {_K}, {_S1} SELECT {_r('sum(-density * ln(density + 1e-14) * CASE WHEN bin IN (0, 40) THEN 0.5 ELSE 1 END) * 5.0', 'entropy')} FROM f")
def kde_entropy_1d(t: Tables) -> DataFrame:
    return density.entropy1d(_density(t), _STEP, _BINS).select(r6("entropy").alias("entropy"))


def _part(letter: str, where: str) -> str:
    return ", ".join(x.replace("FROM events", f"FROM (SELECT * FROM events WHERE {where})").replace("b AS", f"b{letter} AS", 1).replace("f AS", f"f{letter} AS", 1).replace("FROM b ", f"FROM b{letter} ") for x in (_B1, _S1))


@query(f"WITH {_K}, {_part('1', 'user_id % 2 = 0')}, {_part('2', 'user_id % 2 = 1')}, j AS (SELECT coalesce(f1.bin, f2.bin) AS bin, coalesce(f1.density, 0) AS f, coalesce(f2.density, 0) AS g FROM f1 FULL JOIN f2 ON f1.bin = f2.bin) SELECT {_r('sum(f * ln((f + 1e-14) / (g + 1e-14)) * CASE WHEN bin IN (0, 40) THEN 0.5 ELSE 1 END) * -5.0', 'kl')} FROM j")
def kde_kl_1d(t: Tables) -> DataFrame:
    """Between the values of users with even and with odd numbers; all events are in one of the two."""
    parts = [density.smooth(density.bins1d(t.events.filter(F.col("user_id") % 2 == r), "value", 0.0, 200.0, _BINS), ["bin"], density.kernel(_STEP, _H), _BINS) for r in (0, 1)]
    return density.kl1d(*parts, _STEP, _BINS).select(r6("kl").alias("kl"))


_B2 = """p AS (SELECT l_quantity / 5.0 AS x, l_discount / 0.01 AS y FROM lineitem),
c AS (SELECT CAST(floor(x) AS BIGINT) + dx AS bin_x, CAST(floor(y) AS BIGINT) + dy AS bin_y, CASE WHEN dx = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END * CASE WHEN dy = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END AS w
  FROM p, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)),
b AS (SELECT bin_x, bin_y, sum(w) / ((SELECT count(*) FROM lineitem) * 5.0 * 0.01) AS density FROM c WHERE bin_x BETWEEN 0 AND 10 AND bin_y BETWEEN 0 AND 10 GROUP BY bin_x, bin_y HAVING sum(w) > 1e-6)"""


def _bins2(t: Tables) -> DataFrame:
    n = F.lit(t.lineitem.count() * 5.0 * 0.01)
    return density.bins2d(t.lineitem, "l_quantity", "l_discount", (0.0, 50.0, 0.0, 0.1), 10).filter(F.col("density") * n > 1e-6)


@query(f"WITH {_B2} SELECT bin_x, bin_y, {_r('density', 'density')} FROM b")
def kde2d_bins(t: Tables) -> DataFrame:
    return _bins2(t).select("bin_x", "bin_y", r6("density").alias("density"))


@query(f"WITH {_B2}, k AS (SELECT d, e / sum(e) OVER () AS k FROM (SELECT d, exp(-0.5 * d * d) AS e FROM (SELECT unnest(range(-4, 5)) AS d))), g AS (SELECT bin_x + d AS bin_x, bin_y, sum(density * k) AS density FROM b CROSS JOIN k WHERE bin_x + d BETWEEN 0 AND 10 GROUP BY 1, 2), h AS (SELECT bin_x, bin_y + d AS bin_y, sum(density * k) AS density FROM g CROSS JOIN k WHERE bin_y + d BETWEEN 0 AND 10 GROUP BY 1, 2) SELECT bin_x, bin_y, {_r('density', 'density')} FROM h")
def kde2d(t: Tables) -> DataFrame:
    return density.smooth(_bins2(t), ["bin_x", "bin_y"], density.kernel(1.0, 1.0), 10).select("bin_x", "bin_y", r6("density").alias("density"))


# -- counts and information

_TAGS = "g AS (SELECT DISTINCT user_id, event_type AS tag FROM events)"


@query(f"WITH {_TAGS} SELECT x.tag AS a, y.tag AS b, CAST(count(*) AS BIGINT) AS n FROM g x JOIN g y ON x.user_id = y.user_id AND x.tag <> y.tag GROUP BY ALL")
def tag_cooccurrence(t: Tables) -> DataFrame:
    return information.tag_cooccurrence(t.events.withColumn("tag", F.col("event_type")), "user_id", "tag")


@query("SELECT source AS key, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 UNION ALL SELECT lang, CAST(count(*) AS BIGINT) FROM documents GROUP BY 1")
def records_by_group(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("n")).union(t.documents.groupBy("lang").agg(F.count("*").alias("n")))


@query("SELECT DISTINCT label FROM embeddings")
def distinct_labels(t: Tables) -> DataFrame:
    return t.embeddings.select("label").distinct()


@query("SELECT event_type AS tag, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS BIGINT) AS id FROM events GROUP BY event_type")
def tag_dictionary(t: Tables) -> DataFrame:
    first = t.events.groupBy(F.col("event_type").alias("tag")).agg(F.min("event_id").alias("pos"))
    return first.select("tag", (F.row_number().over(Window.orderBy("pos")) - 1).cast("long").alias("id"))


@query(f"SELECT event_type, {_r('avg(value)', 'avg_score')}, {_r('stddev_pop(value)', 'std_score')} FROM events GROUP BY 1")
def score_stats(t: Tables) -> DataFrame:
    return evaluation.stats(t.events.withColumn("score", F.col("value")), "event_type").select("event_type", r6("avg_score").alias("avg_score"), r6("std_score").alias("std_score"))


def _nn(key: str, absolute: str = _A) -> str:
    return f"{absolute}, {_EX}, n AS (SELECT i, any_value(label) AS label, arg_min(ex_label, ({_DIST[key]}, ex_id)) AS found FROM v CROSS JOIN ex GROUP BY i)"


def _found(t: Tables, key: str = "cosine") -> DataFrame:
    return evaluation.classify(t.vectors(True), t.examples(), _MEASURE[key])


@query(f"WITH {_nn('cosine')} SELECT {_r('avg(CASE WHEN label = found THEN 1.0 ELSE 0.0 END)', 'score')} FROM n")
def nn_score(t: Tables) -> DataFrame:
    return evaluation.score(_found(t)).select(r6("score").alias("score"))


@query(f"WITH {_nn('cosine')}, l AS (SELECT DISTINCT label FROM embeddings) SELECT a.label AS truth, b.label AS found, CAST(count(n.i) AS BIGINT) AS n FROM l a CROSS JOIN l b LEFT JOIN n ON n.label = a.label AND n.found = b.label GROUP BY ALL")
def confusion_matrix(t: Tables) -> DataFrame:
    return information.confusion(_found(t), "label", "found")


def _nn_query(key: str) -> None:
    @query(f"WITH {_nn(key)} SELECT i, label, found FROM n")
    def classify_nn(t: Tables) -> DataFrame:
        return _found(t, key)

    for table in (QUERIES, ORACLES):
        table[f"classify_nn_{key}"] = table.pop("classify_nn")


for _k in _DIST:
    _nn_query(_k)

_WORDS = """r AS (SELECT role AS label, list_distinct(list_transform(string_split(lower(text), ' '), lambda w: trim(w, '.?!'))) AS ws FROM conversations),
c AS (SELECT word, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT label, unnest(ws) AS word FROM r) WHERE word <> '' GROUP BY ALL)"""


@query(f"WITH {_WORDS} SELECT word, label, n FROM c")
def word_label_joint(t: Tables) -> DataFrame:
    return information.word_label_counts(t.conversations, "text", "role")


_TERM = "CASE WHEN {n} > 0 THEN {n} / t * ln({n} * t / ({a} * {b})) ELSE 0 END"
_MI = " + ".join(_TERM.format(n=n, a=a, b=b) for n, a, b in (("n", "nw", "nl"), ("(nw - n)", "nw", "(t - nl)"), ("(nl - n)", "(t - nw)", "nl"), ("(t - nw - nl + n)", "(t - nw)", "(t - nl)")))


@query(f"WITH {_WORDS}, x AS (SELECT word, label, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY word) AS DOUBLE) AS nw, CAST(nl AS DOUBLE) AS nl, CAST(t AS DOUBLE) AS t FROM c JOIN (SELECT role AS label, count(*) AS nl FROM conversations GROUP BY 1) USING (label), (SELECT count(*) AS t FROM conversations)) SELECT word, label, {_r(_MI, 'mi')} FROM x")
def word_label_mi(t: Tables) -> DataFrame:
    return information.word_label_information(t.conversations, "text", "role").select("word", "label", r6("mi").alias("mi"))


_HIST = "h AS (SELECT event_type AS label, CAST(least(floor((value - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT label, bin, n FROM h")
def hist_by_label(t: Tables) -> DataFrame:
    return information.histogram_by_label(t.events, "value", "event_type")


@query(f"""WITH {_CELLS}, b AS (SELECT j, min(x) AS lo, max(x) AS hi FROM m GROUP BY j), l AS (SELECT vec_id AS i, label FROM embeddings),
h AS (SELECT m.j, label, least(floor((x - lo) / (hi - lo) * 10), 9) AS bin, CAST(count(*) AS DOUBLE) AS n FROM m JOIN b ON m.j = b.j JOIN l ON m.i = l.i GROUP BY ALL),
c AS (SELECT j, label, bin, n, sum(n) OVER (PARTITION BY j, bin) AS nb, sum(n) OVER (PARTITION BY j) AS t FROM h),
g AS (SELECT a.j, a.label, a.nl, b.bin, b.nb, b.t, coalesce(c.n, 0) AS n FROM (SELECT j, label, sum(n) AS nl FROM h GROUP BY ALL) a JOIN (SELECT DISTINCT j, bin, nb, t FROM c) b ON a.j = b.j LEFT JOIN c ON c.j = a.j AND c.label = a.label AND c.bin = b.bin)
SELECT j, label, {_r('sum(CASE WHEN n > 0 THEN n / t * ln(n * t / (nb * nl)) ELSE 0 END + CASE WHEN nb > n THEN (nb - n) / t * ln((nb - n) * t / (nb * (t - nl))) ELSE 0 END)', 'mi')} FROM g GROUP BY j, label""")
def mi_matrix(t: Tables) -> DataFrame:
    m = t.labelled_cells()
    b = m.groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = information.equal_bin(F.col("x"), F.col("lo"), F.col("hi"), 10)
    h = m.join(b, "j").groupBy("j", "label", at.alias("bin")).agg(F.count("*").alias("n"))
    return information.label_information(h, "j").select("j", "label", r6("mi").alias("mi"))


# -- vector metrics between a vector and its label's example

_PAIRED = f"{_A}, {_EX}, p AS (SELECT i, v, ev FROM v JOIN ex ON label = ex_label)"
_UNIT = lambda a: f"list_transform({a}, lambda x: x / (list_sum({a}) + 1e-16))"


def _paired(t: Tables) -> DataFrame:
    return t.vectors(True).join(pairing.small(t.examples()), F.col("label") == F.col("ex_label"))


def _metric_query(name: str, f, sql: str) -> None:
    @query(f"WITH {_PAIRED} SELECT i, {_r(sql, 'd')} FROM p")
    def metric(t: Tables) -> DataFrame:
        return _paired(t).select("i", r6(f(F.col("v"), F.col("ev"))).alias("d"))

    for table in (QUERIES, ORACLES):
        table[f"metric_{name}"] = table.pop("metric")


for _args in (
    ("kl", V.kl, _KL("v", "ev")),
    ("kl_normalized", lambda a, b: V.kl(a, b, True), _KL(_UNIT("v"), _UNIT("ev"))),
    ("rev_kl", V.rev_kl, _KL("ev", "v")),
    ("sym_kl", V.sym_kl, f"({_KL('v', 'ev')} + {_KL('ev', 'v')}) / 2"),
    ("frobenius", V.frobenius, _FROB("v", "ev")),
    ("cosine", V.cosine_similarity, _COS("v", "ev")),
    ("cosine_diff", V.cosine_diff, f"-{_COS('v', 'ev')}"),
):
    _metric_query(*_args)

_JOINT = "j AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY ALL)"


def _joint(t: Tables) -> DataFrame:
    return information.distribution(t.lineitem, "l_returnflag", "l_linestatus")


@query(f"WITH {_JOINT} SELECT {_r('-sum(p * ln(p))', 'entropy')} FROM j")
def entropy(t: Tables) -> DataFrame:
    return information.entropy(_joint(t)).select(r6("entropy").alias("entropy"))


@query(f"WITH {_JOINT}, m AS (SELECT p, sum(p) OVER (PARTITION BY a) AS pa, sum(p) OVER (PARTITION BY b) AS pb FROM j) SELECT {_r('sum(p * ln(p / (pa * pb)))', 'mi')} FROM m")
def mutual_information(t: Tables) -> DataFrame:
    return information.mutual_information(_joint(t), "l_returnflag", "l_linestatus").select(r6("mi").alias("mi"))


@query(f"WITH {_JOINT}, a AS (SELECT a, sum(p) AS p FROM j GROUP BY a) SELECT {_r('(SELECT -sum(p * ln(p)) FROM j) - (SELECT -sum(p * ln(p)) FROM a)', 'conditional_entropy')}")
def conditional_entropy(t: Tables) -> DataFrame:
    return information.conditional_entropy(_joint(t), "l_returnflag").select(r6("conditional_entropy").alias("conditional_entropy"))


@query(f"WITH {_V} SELECT {_r('(8 - avg((list_sum(list_transform(v, lambda x: abs(x))) + 1e-8) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8))) / 7', 'sparseness')} FROM v")
def hoyer_sparseness(t: Tables) -> DataFrame:
    return t.vectors().agg(r6((8 - F.avg(V.hoyer_ratio(F.col("v")))) / 7).alias("sparseness"))


@query(f"WITH {_CELLS} SELECT {_r('1 - count(*) FILTER (x > 0.1) / count(*)', 'sparsity')} FROM m")
def real_sparsity(t: Tables) -> DataFrame:
    m = t.cells().withColumn("x", F.when(F.col("x") > 0.1, F.col("x")).otherwise(0.0))
    return matrix.sparsity(m, t.embeddings.count(), 64).select(r6("sparsity").alias("sparsity"))


# -- evaluation

@query(f"WITH {_V} SELECT i, CAST(list_position(v[1:10], list_max(v[1:10])) - 1 AS BIGINT) AS found, list_position(v[1:10], list_max(v[1:10])) - 1 = label AS correct FROM v")
def label_reco_argmax(t: Tables) -> DataFrame:
    v = t.vectors().withColumn("scores", F.slice("v", 1, 10))
    return evaluation.recognised(v, "scores", "label").select("i", "found", "correct")


_SCORES = f"{_CELLS}, l AS (SELECT vec_id AS i, label FROM embeddings), sc AS (SELECT m.i AS row, j AS idx, x AS score, j = label OR j = (label + 1) % 10 AS truth FROM m JOIN l ON m.i = l.i WHERE j < 10)"


def _scores(t: Tables) -> DataFrame:
    m = t.labelled_cells().filter("j < 10")
    return m.select(F.col("i").alias("row"), F.col("j").alias("idx"), F.col("x").alias("score"), ((F.col("j") == F.col("label")) | (F.col("j") == (F.col("label") + 1) % 10)).alias("truth"))


@query(f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, idx) <= 2 AS top FROM sc) SELECT row, bool_and(top = truth) AS matched FROM r GROUP BY row")
def topn_label_match(t: Tables) -> DataFrame:
    s = _scores(t)
    return evaluation.top_n_match(s.select("row", "idx", "score"), s.filter("truth").select("row", "idx"))


@query(f"WITH {_SCORES} SELECT row, bool_and((score >= 0.1) = truth) AS matched FROM sc GROUP BY row")
def threshold_label_match(t: Tables) -> DataFrame:
    return evaluation.threshold_match(_scores(t), 0.1)


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 3")
def choose_examples(t: Tables) -> DataFrame:
    return evaluation.examples(t.embeddings.select("vec_id", "label"), "vec_id", "label", 3)


# -- factorization with a fixed starting dictionary of 3 rows

_H0 = "h AS (SELECT k, j, h / sum(h) OVER (PARTITION BY k) AS h FROM (SELECT k, j, CAST(1 + (k * 7 + j * 3) % 11 AS DOUBLE) AS h FROM (SELECT CAST(unnest(range(3)) AS BIGINT) AS k), (SELECT CAST(unnest(range(64)) AS BIGINT) AS j)))"
_W0 = "w AS (SELECT i, k, sum(x * h) AS w FROM m JOIN h ON m.j = h.j GROUP BY i, k)"
_WH = "p AS (SELECT m.i, m.j, any_value(x) AS x, sum(w * h) AS wh FROM m JOIN w ON m.i = w.i JOIN h ON h.k = w.k AND h.j = m.j GROUP BY m.i, m.j)"
_NMF = f"{_CELLS}, {_H0}, {_W0}, {_WH}"


def _nmf(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """X, W and a dictionary of 3 x 64 cells, which is broadcast."""
    x = t.cells()
    k, j = t.spark.range(3).select(F.col("id").alias("k")), t.spark.range(64).select(F.col("id").alias("j"))
    raw = pairing.distribute(k, j).withColumn("h", (1 + (F.col("k") * 7 + F.col("j") * 3) % 11).cast("double"))
    h = raw.join(raw.groupBy("k").agg(F.sum("h").alias("s")), "k").select("k", "j", (F.col("h") / F.col("s")).alias("h"))
    w = x.join(F.broadcast(h), "j").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("h")).alias("w"))
    return x, w, F.broadcast(h)


def _updates(steps: int, fold: str = "", before: str = "") -> str:
    """CTEs of whole updates: w{s}, h{s} and the products p{s} at X's cells; ``fold`` is a condition on rows that train, by f."""
    f, on = ("f, ", "AND a.f = b.f") if fold else ("", "")
    out = [f"h0 AS (SELECT {'f, ' if fold else ''}k, j, h FROM h{', folds' if fold else ''})", f"w0 AS (SELECT {f}i, k, sum(x * h) AS w FROM m JOIN h0 ON m.j = h0.j {fold} GROUP BY {f}i, k)"]
    for s in range(steps + 1):
        out.append(f"p{s} AS (SELECT {'a.f, ' if fold else ''}m.i, m.j, any_value(x) AS x, sum(w * h) AS wh FROM m JOIN w{s} a ON m.i = a.i JOIN h{s} b ON b.k = a.k AND b.j = m.j {on} GROUP BY {'a.f, ' if fold else ''}m.i, m.j)")
        if s < steps:
            out.append(f"w{s + 1} AS (SELECT {'a.f, ' if fold else ''}a.i, a.k, any_value(a.w) * sum((x + 1e-8) / (wh + 1e-8) * h) AS w FROM w{s} a JOIN p{s} p ON p.i = a.i {'AND p.f = a.f' if fold else ''} JOIN h{s} b ON b.k = a.k AND b.j = p.j {on} GROUP BY {'a.f, ' if fold else ''}a.i, a.k)")
            out.append(f"g{s + 1} AS (SELECT {'a.f, ' if fold else ''}b.k, b.j, any_value(h) * sum((x + 1e-8) / (wh + 1e-8) * a.w) AS h FROM h{s} b JOIN p{s} p ON p.j = b.j {'AND p.f = b.f' if fold else ''} JOIN w{s + 1} a ON a.i = p.i AND a.k = b.k {on} GROUP BY {'a.f, ' if fold else ''}b.k, b.j)")
            out.append(f"h{s + 1} AS (SELECT {f}k, j, h / (1e-16 + sum(h) OVER (PARTITION BY {f}k)) AS h FROM g{s + 1})")
    return ", ".join(out)


def _start(d: int = 64) -> np.ndarray:
    """The starting dictionary of ``_NMF``."""
    h = np.array([[1.0 + (k * 7 + j * 3) % 11 for j in range(d)] for k in range(3)])
    return h / h.sum(1, keepdims=True)


def _error_sql(s: int) -> str:
    return f"SELECT {s} AS step, (SELECT sum(x * ln((x + 1e-8) / (wh + 1e-8)) - x) FROM p{s}) + (SELECT sum(a.s * b.s) FROM (SELECT k, sum(w) AS s FROM w{s} GROUP BY k) a JOIN (SELECT k, sum(h) AS s FROM h{s} GROUP BY k) b ON a.k = b.k) AS error"


@query(f"WITH {_CELLS}, {_H0}, {_updates(2)} SELECT k, j, {_r('h', 'h')} FROM h2")
def nmf_fit(t: Tables) -> DataFrame:
    """The dictionary learned in two steps; the data stay in their buckets."""
    h = factorize.fit(t.vectors(True).select("i", "v"), steps=2, tol=0.0, h0=_start()).h
    return t.spark.createDataFrame([(k, j, float(x)) for k, row in enumerate(h) for j, x in enumerate(row)], "k long, j long, x double").select("k", "j", r6("x").alias("h"))


@query(f"WITH {_CELLS}, {_H0}, {_updates(2)} SELECT CAST(step AS BIGINT) AS step, {_r('error', 'error')} FROM ({_error_sql(0)} UNION ALL {_error_sql(1)})")
def nmf_fit_errors(t: Tables) -> DataFrame:
    """The divergence before each of two steps."""
    errors = factorize.fit(t.vectors(True).select("i", "v"), steps=2, tol=0.0, h0=_start()).errors
    return t.spark.createDataFrame(list(enumerate(errors)), "step long, x double").select("step", r6("x").alias("error"))


@query(f"WITH {_CELLS}, {_H0}, {_W0}, p AS (SELECT m.i, m.j, any_value(x) AS x, sum(w * h) AS wh FROM m JOIN w ON m.i = w.i JOIN h ON h.k = w.k AND h.j = m.j GROUP BY m.i, m.j), w1 AS (SELECT w.i, w.k, any_value(w.w) * sum((x + 1e-8) / (wh + 1e-8) * h) AS w FROM w JOIN p ON p.i = w.i JOIN h ON h.k = w.k AND h.j = p.j GROUP BY w.i, w.k), p1 AS (SELECT m.i, m.j, any_value(x) AS x, sum(w * h) AS wh FROM m JOIN w1 ON m.i = w1.i JOIN h ON h.k = w1.k AND h.j = m.j GROUP BY m.i, m.j) SELECT w1.i, w1.k, {_r('any_value(w1.w) * sum((x + 1e-8) / (wh + 1e-8) * h)', 'w')} FROM w1 JOIN p1 ON p1.i = w1.i JOIN h ON h.k = w1.k AND h.j = p1.j GROUP BY w1.i, w1.k")
def nmf_transform(t: Tables) -> DataFrame:
    """Every row's coefficients after two steps under a fixed dictionary."""
    w = factorize.transform(t.vectors(True).select("i", "v"), _start(), 2)
    return w.select("i", F.posexplode("w").alias("k", "x")).select("i", F.col("k").cast("long").alias("k"), r6("x").alias("w"))


@query(f"WITH {_CELLS}, {_H0}, folds AS (SELECT unnest(range(4)) AS f), {_updates(1, 'AND m.i % 4 <> f')} SELECT CAST(f AS BIGINT) AS fold, k, j, {_r('h', 'h')} FROM h1")
def fold_dictionaries(t: Tables) -> DataFrame:
    """Four folds' dictionaries, each learned from the rows of the three others, in the same reading of the data."""
    rows = t.vectors(True).select("i", "v")
    others = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda f: f != F.col("i") % 4)
    found = factorize.fit_models(rows, others, np.repeat(_start()[None], 4, 0), 1, 0.0)
    return t.spark.createDataFrame([(f, k, j, float(x)) for f, m in enumerate(found) for k, row in enumerate(m.h) for j, x in enumerate(row)], "fold long, k long, j long, x double").select("fold", "k", "j", r6("x").alias("h"))


@query(f"WITH {_NMF} SELECT {_r('(SELECT sum(x * ln((x + 1e-8) / (wh + 1e-8)) - x) FROM p) + (SELECT sum(a.s * b.s) FROM (SELECT k, sum(w) AS s FROM w GROUP BY k) a JOIN (SELECT k, sum(h) AS s FROM h GROUP BY k) b ON a.k = b.k)', 'error')}")
def nmf_error(t: Tables) -> DataFrame:
    return factorize.error(*_nmf(t)).select(r6("error").alias("error"))


@query(f"WITH {_NMF}, q AS (SELECT i, j, (x + 1e-8) / (wh + 1e-8) AS q FROM p) SELECT w.i, w.k, {_r('any_value(w.w) * sum(q * h)', 'w')} FROM w JOIN q ON q.i = w.i JOIN h ON h.k = w.k AND h.j = q.j GROUP BY w.i, w.k")
def nmf_update_w(t: Tables) -> DataFrame:
    x, w, h = _nmf(t)
    return factorize.updated_w(factorize.ratios(x, w, h), w, h).select("i", "k", r6("w").alias("w"))


@query(f"WITH {_NMF}, q AS (SELECT i, j, (x + 1e-8) / (wh + 1e-8) AS q FROM p), w2 AS (SELECT w.i, w.k, any_value(w.w) * sum(q * h) AS w FROM w JOIN q ON q.i = w.i JOIN h ON h.k = w.k AND h.j = q.j GROUP BY w.i, w.k), g AS (SELECT h.k, h.j, any_value(h) * sum(q * w2.w) AS h FROM h JOIN q ON q.j = h.j JOIN w2 ON w2.i = q.i AND w2.k = h.k GROUP BY h.k, h.j) SELECT k, j, {_r('h / (1e-16 + sum(h) OVER (PARTITION BY k))', 'h')} FROM g")
def nmf_update_h(t: Tables) -> DataFrame:
    x, w, h = _nmf(t)
    q = factorize.ratios(x, w, h)
    return factorize.updated_h(q, factorize.updated_w(q, w, h), h).select("k", "j", r6("h").alias("h"))


@query(f"WITH {_NMF} SELECT i, j, {_r('wh', 'x')} FROM p WHERE x > 0.1")
def masked_dot(t: Tables) -> DataFrame:
    x, w, h = _nmf(t)
    return matrix.masked_dot(w.select("i", "k", F.col("w").alias("x")), h.select("k", "j", F.col("h").alias("x")), x.filter("x > 0.1")).select("i", "j", r6("x").alias("x"))


@query(f"WITH {_CELLS} SELECT i, j, {_r('x * (1 + i % 3)', 'x')} FROM m")
def scale_rows(t: Tables) -> DataFrame:
    f = t.embeddings.select(F.col("vec_id").alias("i"), (1 + F.col("vec_id") % 3).alias("f"))
    return matrix.scale(t.cells(), f, "i").select("i", "j", r6("x").alias("x"))


@query(f"WITH {_CELLS} SELECT i, j, {_r('x * (1 + j % 3)', 'x')} FROM m")
def scale_cols(t: Tables) -> DataFrame:
    f = t.spark.range(64).select(F.col("id").alias("j"), (1 + F.col("id") % 3).alias("f"))
    return matrix.scale(t.cells(), f, "j").select("i", "j", r6("x").alias("x"))


@query(f"WITH {_NMF} SELECT w.i, h.j, {_r('sum(w * h)', 'x')} FROM w JOIN h ON w.k = h.k GROUP BY w.i, h.j")
def matmul(t: Tables) -> DataFrame:
    _, w, h = _nmf(t)
    return matrix.matmul(w.select("i", "k", F.col("w").alias("x")), h.select("k", "j", F.col("h").alias("x"))).select("i", "j", r6("x").alias("x"))


@query(f"WITH {_CELLS} SELECT i, j, {_r('x * CASE WHEN j < 32 THEN 0.5 ELSE 2 END', 'x')} FROM m")
def stack_modalities(t: Tables) -> DataFrame:
    m = t.cells()
    left = m.filter("j < 32").withColumn("x", F.col("x") * 0.5)
    right = m.filter("j >= 32").select("i", (F.col("j") - 32).alias("j"), (F.col("x") * 2).alias("x"))
    return matrix.hstack((left, 32), (right, 32)).select("i", "j", r6("x").alias("x"))


@query(f"WITH {_NMF} SELECT w.i, h.j - 32 AS j, {_r('sum(w * h)', 'x')} FROM w JOIN h ON w.k = h.k WHERE h.j >= 32 GROUP BY w.i, h.j")
def reconstruct_modality(t: Tables) -> DataFrame:
    _, w, h = _nmf(t)
    part = h.filter("j >= 32").select("k", (F.col("j") - 32).alias("j"), F.col("h").alias("x"))
    return matrix.matmul(w.select("i", "k", F.col("w").alias("x")), part).select("i", "j", r6("x").alias("x"))


# -- vector quantization

@query(f"WITH {_D2} SELECT i, code, {_r('d2', 'd2')} FROM d")
def vq_distances(t: Tables) -> DataFrame:
    return quantize.all_distances(t.vectors(), t.codebook()).select("i", "code", r6("d2").alias("d2"))


@query(f"WITH {_ASSIGN} SELECT i, code FROM q")
def vq_assign(t: Tables) -> DataFrame:
    return quantize.assign(t.vectors(), t.codebook()).select("i", "code")


@query(f"WITH {_SOFT} SELECT i, code, {_r('weight', 'weight')} FROM q")
def soft_vq(t: Tables) -> DataFrame:
    return quantize.soft_assign(t.vectors(), t.codebook()).select("i", "code", r6("weight").alias("weight"))


@query(f"WITH {_ASSIGN}, c AS (SELECT q.code, u.j, avg(u.x) AS x FROM q JOIN (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) u ON u.i = q.i GROUP BY ALL) SELECT code, CAST(j AS BIGINT) AS j, {_r('x', 'x')} FROM c")
def kmeans_step(t: Tables) -> DataFrame:
    return quantize.kmeans_step(t.vectors(), t.codebook()).select("code", F.posexplode("centroid").alias("j", "x")).select("code", F.col("j").cast("long").alias("j"), r6("x").alias("x"))


_STARTS = "b AS (SELECT event_type, s AS start, c AS code, 20.0 + 40 * c + 7 * s AS centroid FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range(3)) AS s), (SELECT unnest(range(4)) AS c))"


@query(f"""WITH {_STARTS}, d AS (SELECT e.event_type, event_id, start, any_value(value) AS value, arg_min(code, ((value - centroid) * (value - centroid), code)) AS code FROM events e JOIN b ON b.event_type = e.event_type GROUP BY e.event_type, event_id, start),
c AS (SELECT b.event_type, b.start, b.code, coalesce(avg(value), any_value(centroid)) AS centroid FROM b LEFT JOIN d ON d.event_type = b.event_type AND d.start = b.start AND d.code = b.code GROUP BY ALL)
SELECT event_type, CAST(start AS BIGINT) AS start, CAST(code AS BIGINT) AS code, {_r('centroid', 'centroid')} FROM c""")
def keyed_kmeans(t: Tables) -> DataFrame:
    """One step of a k-means for each kind of event from three starts each, all in one reading of the events."""
    rows = t.events.select("event_type", F.array(F.col("value").cast("double")).alias("v"))
    kinds = [r["event_type"] for r in rows.select("event_type").distinct().collect()]
    model = quantize.Codebooks({n: np.array([[[20.0 + 40 * c + 7 * s] for c in range(4)] for s in range(3)]) for n in kinds})
    after, _ = quantize.keyed_kmeans_step(rows, "event_type", model)
    return after.frame(t.spark, "event_type", "string").select("event_type", F.col("start").cast("long"), F.col("code").cast("long"), r6(F.col("centroid")[0]).alias("centroid"))


# -- ordered series

_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


_BY = ("user_id", "ts", "event_id")
_EVERY = "list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_N = "count(*) OVER (PARTITION BY user_id)"
for _args in (
    ("velocities_circular", lambda: series.velocities("value", *_BY), f"coalesce(lead(value) {_OVER}, first_value(value) {_OVER}) - value"),
    ("delayed_velocities_zeros", lambda: series.delayed_velocities("value", 3, *_BY), f"value - coalesce(lag(value, 3) {_OVER}, 0)"),
    ("delayed_velocities_circular", None, f"value - ({_EVERY})[CAST((row_number() {_OVER} - 1 - least(3, {_N}) + {_N}) % {_N} + 1 AS BIGINT)]"),
    ("moving_avg3", lambda: series.moving_average3("value", *_BY), f"(coalesce(lag(value) {_OVER}, value) + value + coalesce(lead(value) {_OVER}, value)) / 3"),
):
    def _lazy(args) -> None:
        @query(f"WITH {_SERIES} SELECT event_id, {_r(args[2], 'v')} FROM s")
        def of_series(t: Tables) -> DataFrame:
            x = t.series().select("event_id", args[1]().alias("x")) if args[1] else series.delayed_velocities_circular(t.series(), "value", 3, *_BY, name="x")
            return x.select("event_id", r6("x").alias("v"))

        for table in (QUERIES, ORACLES):
            table[args[0]] = table.pop("of_series")

    _lazy(_args)


@query("WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, (SELECT count(*) FROM events) AS n FROM events) SELECT event_id, CASE WHEN k // CAST(floor(n * 0.1) AS BIGINT) < 10 THEN k // CAST(floor(n * 0.1) AS BIGINT) END AS fold FROM r")
def random_split_folds(t: Tables) -> DataFrame:
    return series.with_folds(t.events.select("event_id"), 0.1, "event_id").select("event_id", "fold")


@query("SELECT CAST(a.n_nationkey AS BIGINT) AS fold, CAST(b.n_nationkey AS BIGINT) AS n_nationkey FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey")
def leave_one_out(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").cast("long"))
    return series.leave_one_out(n, n, "n_nationkey")


@query("SELECT CAST(o_orderkey AS BIGINT) AS pos, CAST(c_custkey AS BIGINT) AS c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def row_gather(t: Tables) -> DataFrame:
    """Customers in the order, and as often, as orders name them."""
    index = t.orders.select(F.col("o_orderkey").cast("long").alias("pos"), "o_custkey")
    return pairing.gathered(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", index, "o_custkey").select("pos", F.col("c_custkey").cast("long"), "c_mktsegment")


# -- time windows, on each user's span of events

_SPAN = f"{_SERIES}, u AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM s GROUP BY 1)"


def _span(t: Tables) -> DataFrame:
    return t.series().groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))


def _slides(t: Tables, partial: bool) -> DataFrame:
    got = windows.slider(_span(t), F.col("t0"), F.col("t1"), F.lit(86400.0), F.lit(36000.0), partial)
    return got.select("user_id", "window", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_FULL = "CASE WHEN abs((t1 - t0 - 86400) / 36000 - round((t1 - t0 - 86400) / 36000)) < 1e-3 THEN round((t1 - t0 - 86400) / 36000) ELSE floor((t1 - t0 - 86400) / 36000) END"
_PART = "CASE WHEN abs((t1 - t0) / {s} - round((t1 - t0) / {s})) < 1e-3 THEN round((t1 - t0) / {s}) ELSE ceil((t1 - t0) / {s}) END"


@query(f"WITH {_SPAN}, k AS (SELECT *, unnest(range(CAST({_FULL} AS BIGINT) + 1)) AS k FROM u) SELECT user_id, CAST(k AS BIGINT) AS \"window\", round(t0 + k * 36000.0, 3) AS start, round(least(t0 + k * 36000.0 + 86400.0, t1), 3) AS \"end\" FROM k")
def sliding_windows(t: Tables) -> DataFrame:
    return _slides(t, False)


@query(f"WITH {_SPAN}, k AS (SELECT *, unnest(range(CAST({_PART.format(s=36000)} AS BIGINT))) AS k FROM u) SELECT user_id, CAST(k AS BIGINT) AS \"window\", round(t0 + k * 36000.0, 3) AS start, round(least(t0 + k * 36000.0 + 86400.0, t1), 3) AS \"end\" FROM k")
def sliding_windows_partial(t: Tables) -> DataFrame:
    return _slides(t, True)


@query(f"WITH {_SPAN}, k AS (SELECT *, unnest(range(CAST({_PART.format(s=86400)} AS BIGINT))) AS k FROM u) SELECT user_id, CAST(k AS BIGINT) AS \"window\", round(t0 + k * 86400.0, 3) AS start, round(least(t0 + (k + 1) * 86400.0, t1), 3) AS \"end\" FROM k")
def tumbling_frames(t: Tables) -> DataFrame:
    got = windows.frames(_span(t), F.col("t0"), F.col("t1"), 1 / 86400.0)
    return got.select("user_id", "window", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN abs(x - round(x)) < 0.1 THEN round(x) ELSE floor(x) END AS BIGINT) AS low, CAST(CASE WHEN abs(x - round(x)) < 0.1 THEN round(x) ELSE ceil(x) END AS BIGINT) AS high FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 997.0 AS x FROM lineitem)")
def tolerant_floor(t: Tables) -> DataFrame:
    x = F.col("l_extendedprice") / 997.0
    return t.lineitem.select("l_orderkey", "l_linenumber", V.tolerant_floor(x, 0.1).alias("low"), V.tolerant_ceil(x, 0.1).alias("high"))


@query(f"WITH {_INTERVALS} SELECT user_id, event_id, round(en - st, 3) AS duration, round((st + en) / 2, 3) AS mean_time, round(st + 100, 3) AS moved FROM w")
def window_arith(t: Tables) -> DataFrame:
    w = windows.moved(windows.measured(_intervals(t)), F.lit(100.0))
    return w.select("user_id", "event_id", F.round("duration", 3).alias("duration"), F.round("mean_time", 3).alias("mean_time"), F.round("start", 3).alias("moved"))


@query(f"WITH {_INTERVALS}, c AS (SELECT user_id, event_id, greatest(st, 1704800000.0) AS st2, en FROM w) SELECT user_id, event_id, round(st2, 3) AS start, round(greatest(st2, least(en, 1705200000.0)), 3) AS \"end\" FROM c")
def interval_crop(t: Tables) -> DataFrame:
    c = windows.crop(F.col("start"), F.col("end"), F.lit(1704800000.0), F.lit(1705200000.0))
    return _intervals(t).select("user_id", "event_id", c.alias("c")).select("user_id", "event_id", F.round("c.start", 3).alias("start"), F.round("c.end", 3).alias("end"))


@query(f"WITH {_V} SELECT i, CAST(j AS BIGINT) AS pos, round(i + (j + 0.5) / 5, 6) AS t FROM (SELECT i, unnest(range(len(v))) AS j FROM v)")
def sample_times(t: Tables) -> DataFrame:
    times = windows.sample_times(F.size("v"), F.col("i").cast("double"), F.lit(5.0))
    return t.vectors().select("i", F.posexplode(times).alias("pos", "t")).select("i", F.col("pos").cast("long").alias("pos"), F.round("t", 6).alias("t"))


@query(f"WITH {_V} SELECT i, round(2.0 + 13 / 5.0, 6) AS start, CAST(len(v[14:27]) AS BIGINT) AS n, {_r('list_sum(v[14:27])', 'total')} FROM v")
def array_subwindow(t: Tables) -> DataFrame:
    c = windows.subwindow(F.col("v"), F.lit(2.0), F.lit(5.0), F.lit(4.5), F.lit(7.5))
    return t.vectors().select("i", c.alias("c")).select("i", F.round("c.start", 6).alias("start"), F.size("c.samples").cast("long").alias("n"), r6(V.total(F.col("c.samples"))).alias("total"))


_CUT = "c AS (SELECT user_id, first + (last - first) * 0.2 AS ts, first + (last - first) * 0.7 AS te FROM (SELECT user_id, min(st) AS first, max(en) AS last FROM w GROUP BY 1))"


@query(f"WITH {_INTERVALS}, {_CUT} SELECT w.user_id, event_id, round(greatest(st, ts), 3) AS start, round(least(en, te), 3) AS \"end\" FROM w JOIN c ON c.user_id = w.user_id WHERE en >= ts AND st < te AND en > st")
def concat_subwindow(t: Tables) -> DataFrame:
    """The part of each user's gap-free timeline from a fifth to seven tenths of it: whole windows, and cropped ends."""
    pieces = _intervals(t).filter("end > start")
    spans = pieces.groupBy("user_id").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cuts = spans.select("user_id", F.lit(0).alias("cut"), (F.col("a") + (F.col("b") - F.col("a")) * 0.2).alias("ts"), (F.col("a") + (F.col("b") - F.col("a")) * 0.7).alias("te"))
    got = windows.cut(pieces.select("user_id", "event_id", "start", "end"), cuts, "user_id", 6 * 3600.0, samples=False)
    return got.select("user_id", "event_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(f"""WITH {_V}, p AS (SELECT label, v, 8.0 * (row_number() OVER (PARTITION BY label ORDER BY i) - 1) AS st, 8.0 * count(*) OVER (PARTITION BY label) AS total FROM v),
x AS (SELECT label, st + (j - 1) / 8.0 AS low, st + j / 8.0 AS high, v[j] AS x, cut, total * ts AS ts, total * te AS te FROM (SELECT *, unnest(range(1, 65)) AS j FROM p), (SELECT unnest([0, 1]) AS cut, unnest([0.13, 0.4]) AS ts, unnest([0.61, 0.41]) AS te))
SELECT label, CAST(cut AS BIGINT) AS cut, round(min(low), 6) AS start, CAST(count(*) AS BIGINT) AS n, {_r('sum(x)', 'total')} FROM x WHERE low >= ts - 1e-4 AND high <= te + 1e-4 GROUP BY label, cut""")
def concat_samples(t: Tables) -> DataFrame:
    """Two cuts of each label's vectors, taken as arrays of 8 samples a second one behind another, as arrays."""
    v = t.vectors().select("i", "label", F.col("v").alias("samples"), F.lit(8.0).alias("duration"), F.lit(8.0).alias("rate"))
    pieces = windows.align(v, "duration", "label", "i").select("label", "start", "end", "rate", "samples")
    total = pieces.groupBy("label").agg(F.max("end").alias("total"))
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("cut"), (F.col("total") * a).alias("ts"), (F.col("total") * b).alias("te")) for n, a, b in ((0, 0.13, 0.61), (1, 0.4, 0.41)))))
    got = windows.cut(pieces, total.select("label", both.alias("c")).select("label", "c.*"), "label", 16.0)
    return got.select("label", F.col("cut").cast("long").alias("cut"), F.round("start", 6).alias("start"), F.size("samples").cast("long").alias("n"), r6(V.total(F.col("samples"))).alias("total")).filter("n > 0")


@query(f"WITH {_INTERVALS}, g AS (SELECT user_id, abs(lead(st + event_id % 2) OVER (PARTITION BY user_id ORDER BY st, event_id) - en) > 1e-8 AS gap FROM w) SELECT user_id, CAST(count(*) FILTER (gap) AS BIGINT) AS n_gaps FROM g GROUP BY 1")
def gap_check(t: Tables) -> DataFrame:
    """Gaps made by moving every start with an odd id."""
    w = _intervals(t).withColumn("base", F.col("start")).withColumn("start", F.col("start") + F.col("event_id") % 2)
    return windows.gaps(w, "user_id", "base", "event_id")


@query("SELECT conv_id, turn, CAST(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) - len(text) AS DOUBLE) AS start, CAST(sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) AS \"end\" FROM conversations")
def align_windows(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", F.length("text").cast("double").alias("duration"))
    return windows.align(c, "duration", "conv_id", "turn").select("conv_id", "turn", "start", "end")


@query(f"WITH {_SPAN}, k AS (SELECT *, unnest(range(CAST({_FULL} AS BIGINT) + 1)) AS k FROM u), w AS (SELECT user_id, k, t0 + k * 36000.0 AS st, least(t0 + k * 36000.0 + 86400.0, t1) AS en FROM k) SELECT w.user_id, CAST(k AS BIGINT) AS \"window\", CAST(code AS BIGINT) AS code, CAST(count(*) AS BIGINT) AS n FROM w JOIN s ON s.user_id = w.user_id AND s.t > st AND s.t <= en GROUP BY ALL")
def sliding_window_features(t: Tables) -> DataFrame:
    """Counts of each kind of event in each sliding window, added up from counts of two hours."""
    w = windows.slider(_span(t), F.col("t0"), F.col("t1"), F.lit(86400.0), F.lit(36000.0)).select("user_id", "window")
    points = t.series().join(_span(t).select("user_id", "t0"), "user_id")
    return windows.pane_counts(points, "t", "t0", 86400, 36000, "user_id", "code").join(w, ["user_id", "window"]).select("user_id", "window", "code", "n")


_K = f"k AS (SELECT *, unnest(range(CAST({_FULL} AS BIGINT) + 1)) AS k FROM u), win AS (SELECT user_id, k, t0 + k * 36000.0 AS st, least(t0 + k * 36000.0 + 86400.0, t1) AS en FROM k)"
_NEXT = "s2 AS (SELECT *, lead(code, 1) OVER o AS c1, lead(t, 1) OVER o AS n1, lead(code, 2) OVER o AS c2, lead(t, 2) OVER o AS n2 FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))"
_PAIRS = "pairs AS (SELECT user_id, t, n1 AS n, c1 * 5 + code AS cell FROM s2 WHERE c1 IS NOT NULL UNION ALL SELECT user_id, t, n2, c2 * 5 + code + 25 FROM s2 WHERE c2 IS NOT NULL)"
_WINDOW_CELLS = f"{_SPAN}, {_K}, {_NEXT}, {_PAIRS}, cells AS (SELECT win.user_id, k, cell, count(*) AS n FROM win JOIN pairs p ON p.user_id = win.user_id AND p.t > st AND p.n <= en GROUP BY ALL)"


def _window_cells(t: Tables) -> DataFrame:
    w = windows.slider(_span(t), F.col("t0"), F.col("t1"), F.lit(86400.0), F.lit(36000.0)).select("user_id", "window")
    points = t.series().join(_span(t).select("user_id", "t0"), "user_id")
    # The pairs' order includes a user's first event, which lies in no window.
    return sliding.pane_cooccurrences(points, "t", "t0", 86400, 36000, "code", 5, [1, 2], "user_id", "ts", "event_id").join(w, ["user_id", "window"])


@query(f"WITH {_WINDOW_CELLS} SELECT user_id, CAST(k AS BIGINT) AS \"window\", CAST(cell AS BIGINT) AS cell, CAST(n AS BIGINT) AS n FROM cells")
def sliding_cooccurrences(t: Tables) -> DataFrame:
    """Which event follows which one and two events later, in each sliding window, added up from panes of two hours."""
    return _window_cells(t).select("user_id", "window", "cell", "n")


def _h114(k: int, j: int) -> float:
    return (1 + (k * 7 + j * 3) % 11) / 100


def _coefs_sql(x: str, h: list[list[float]]) -> str:
    """Coefficients after one step of a list ``x`` under a dictionary."""
    d, dot = len(h[0]), "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    w0 = "[" + ", ".join(dot.format(a=x, b=row) for row in h) + "]"
    columns = [[row[j] for row in h] for j in range(d)]
    wh = f"list_transform({columns}, lambda c: {' + '.join(f'c[{k + 1}] * w0[{k + 1}]' for k in range(len(h)))})"
    q = "list_transform(list_zip(x, wh), lambda z: CASE WHEN z[1] = 0 THEN 0 ELSE (z[1] + 1e-8) / (z[2] + 1e-8) END)"
    w1 = "[" + ", ".join(f"w0[{k + 1}] * {dot.format(a='q', b=row)}" for k, row in enumerate(h)) + "]"
    return f"SELECT * EXCLUDE (x, w0, wh, q), {w1} AS w FROM (SELECT *, {q} AS q FROM (SELECT *, {wh} AS wh FROM (SELECT *, {w0} AS w0 FROM ({{rows}}))))"


_H_EVENTS, _H_VECTORS = ([[_h114(k, j) for j in range(*span)] for k in range(3)] for span in ((0, 50), (50, 114)))
_HISTS = "SELECT user_id, k, list_transform(range(50), lambda c: CAST(coalesce(map_extract(any_value(m), c)[1], 0) AS DOUBLE)) AS x FROM (SELECT user_id, k, map_from_entries(list((cell, n))) AS m FROM cells GROUP BY user_id, k) GROUP BY user_id, k"


@query(f"""WITH {_WINDOW_CELLS}, {_A}, {_EX}, tests AS ({_coefs_sql('x', _H_EVENTS).format(rows=_HISTS)}), found AS ({_coefs_sql('x', _H_VECTORS).format(rows='SELECT ex_id, ex_label, ev AS x FROM ex')})
SELECT user_id, CAST(k AS BIGINT) AS "window", arg_min(ex_label, (-{_COS('t.w', 'e.w')}, ex_id)) AS label FROM tests t, found e GROUP BY user_id, k""")
def sliding_recognition(t: Tables) -> DataFrame:
    """The label recognised in each sliding window: its co-occurrences' coefficients against those of the vectors' examples, by cosine."""
    ex = t.examples()
    coefs = factorize.transform(ex.select(F.col("ex_id").alias("i"), F.col("ev").alias("v")), np.array(_H_VECTORS), 1)
    ex = ex.drop("ev").join(coefs, ex["ex_id"] == coefs["i"]).select("ex_id", "ex_label", F.col("w").alias("ev"))
    return sliding.recognised(_window_cells(t), "user_id", np.array(_H_EVENTS), ex, "cosine", 1)


# -- quaternions made of lineitem's numbers

_Q = "q AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS x, l_discount * 5 AS y, l_tax * 7 AS z, 1 + l_extendedprice / 100000 AS w FROM lineitem)"


def _quaternions(t: Tables) -> DataFrame:
    q = V.quaternion(F.col("l_quantity") / 50, F.col("l_discount") * 5, F.col("l_tax") * 7, 1 + F.col("l_extendedprice") / 100000)
    return t.lineitem.select("l_orderkey", "l_linenumber", q.alias("q"))


def _xyzw(df: DataFrame, c: F.Column) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", c.alias("p")).select("l_orderkey", "l_linenumber", *(r6(f"p.{f}").alias(f) for f in "xyzw"))


def _product(q: str) -> str:
    p = {"x": 0.11373951, "y": -0.22915377, "z": 0.33133971, "w": 0.90711393}
    x, y, z, w = (f"{q}{f}" for f in "xyzw")
    parts = (f"{p['w']} * {x} + {p['x']} * {w} + {p['y']} * {z} - {p['z']} * {y}", f"{p['w']} * {y} - {p['x']} * {z} + {p['y']} * {w} + {p['z']} * {x}", f"{p['w']} * {z} + {p['x']} * {y} - {p['y']} * {x} + {p['z']} * {w}", f"{p['w']} * {w} - {p['x']} * {x} - {p['y']} * {y} - {p['z']} * {z}")
    return ", ".join(_r(e, f) for e, f in zip(parts, "xyzw", strict=True))


@query(f"WITH {_Q} SELECT l_orderkey, l_linenumber, {_product('')} FROM q".replace("+ -0.2", "- 0.2").replace("- -0.2", "+ 0.2"))
def quat_multiply(t: Tables) -> DataFrame:
    p = V.quaternion(F.lit(0.11373951), F.lit(-0.22915377), F.lit(0.33133971), F.lit(0.90711393))
    return _xyzw(_quaternions(t), V.quat_multiply(p, F.col("q")))


@query(f"WITH {_Q} SELECT l_orderkey, l_linenumber, {_r('-x / n', 'x')}, {_r('-y / n', 'y')}, {_r('-z / n', 'z')}, {_r('w / n', 'w')} FROM (SELECT *, x * x + y * y + z * z + w * w AS n FROM q)")
def quat_inverse(t: Tables) -> DataFrame:
    return _xyzw(_quaternions(t), V.quat_inverse(F.col("q")))


_EULER = "atan2({s} * (y * z + x * w), 1 - {s} * (x * x + y * y))", "atan2(-{s} * (x * z - y * w), sqrt((1 - {s} * (y * y + z * z)) * (1 - {s} * (y * y + z * z)) + {s} * (x * y + z * w) * {s} * (x * y + z * w)))", "atan2({s} * (x * y + z * w), 1 - {s} * (y * y + z * z))"


@query(f"WITH {_Q}, n AS (SELECT *, 2 / (x * x + y * y + z * z + w * w) AS s FROM q) SELECT l_orderkey, l_linenumber, " + ", ".join(_r(e.format(s="s"), a) for e, a in zip(_EULER, ("ax", "ay", "az"), strict=True)) + " FROM n")
def quat_euler(t: Tables) -> DataFrame:
    e = _quaternions(t).select("l_orderkey", "l_linenumber", V.quat_euler(F.col("q")).alias("e"))
    return e.select("l_orderkey", "l_linenumber", *(r6(f"e.{a}").alias(a) for a in ("ax", "ay", "az")))


@query(f"WITH {_Q}, p AS (SELECT a.l_orderkey, a.l_linenumber, a.x AS ax, a.y AS ay, a.z AS az, a.w AS aw, b.x AS bx, b.y AS by_, b.z AS bz, b.w AS bw, a.x * a.x + a.y * a.y + a.z * a.z + a.w * a.w AS n FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1), r AS (SELECT l_orderkey, l_linenumber, (aw * bx - ax * bw - ay * bz + az * by_) / n AS x, (aw * by_ + ax * bz - ay * bw - az * bx) / n AS y, (aw * bz - ax * by_ + ay * bx - az * bw) / n AS z, (aw * bw + ax * bx + ay * by_ + az * bz) / n AS w FROM p), n AS (SELECT *, 2 / (x * x + y * y + z * z + w * w) AS s FROM r) SELECT l_orderkey, l_linenumber, " + ", ".join(_r(e.format(s="s"), a) for e, a in zip(_EULER, ("ax", "ay", "az"), strict=True)) + " FROM n")
def joint_angles(t: Tables) -> DataFrame:
    """Angles of the rotation from each line's quaternion to the next line's, as between two joints."""
    q = _quaternions(t)
    after = q.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("q").alias("q2"))
    e = q.join(after, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", V.turn_angles(F.col("q"), F.col("q2")).alias("e"))
    return e.select("l_orderkey", "l_linenumber", *(r6(f"e.{a}").alias(a) for a in ("ax", "ay", "az")))


# -- transforms made of the same numbers, a row of cells each

_UNITS = "u AS (SELECT *, x / l AS n0, y / l AS n1, (z + 0.1) / l AS n2 FROM (SELECT *, sqrt(x * x + y * y + (z + 0.1) * (z + 0.1)) AS l FROM q))"


def _cells_sql(cells: list[list[str]]) -> str:
    return ", ".join(_r(c, f"m{i}{j}") for i, row in enumerate(cells) for j, c in enumerate(row))


def _cells_of(t: Tables, f: Callable[[F.Column, F.Column], F.Column], columns: int) -> DataFrame:
    """The first three rows of a matrix that ``f`` makes of lineitem's axes and quaternions."""
    q = _quaternions(t).withColumn("axis", F.array(F.col("q.x"), F.col("q.y"), F.col("q.z") + 0.1))
    m = q.select("l_orderkey", "l_linenumber", f(F.col("axis"), F.col("q")).alias("m"))
    return m.select("l_orderkey", "l_linenumber", *(r6(F.col("m")[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(columns)))


_CROSS = [["0", "-n2", "n1"], ["n2", "0", "-n0"], ["-n1", "n0", "0"]]
_ROTATION = [[f"{'cos(w)' if i == j else '0'} + (1 - cos(w)) * n{i} * n{j} + sin(w) * ({_CROSS[i][j]})" for j in range(3)] for i in range(3)]
_MIRROR = [[f"{int(i == j)} - 2 * n{i} * n{j}" for j in range(3)] for i in range(3)]
_STRETCH = [[f"{int(i == j)} + (w - 1) * n{i} * n{j}" for j in range(3)] for i in range(3)]
_QUATERNION = [["1 - 2 * (y * y + z * z) / d", "2 * (x * y - z * w) / d", "2 * (x * z + y * w) / d"], ["2 * (x * y + z * w) / d", "1 - 2 * (x * x + z * z) / d", "2 * (y * z - x * w) / d"], ["2 * (x * z - y * w) / d", "2 * (y * z + x * w) / d", "1 - 2 * (x * x + y * y) / d"]]
_EULER = [["cos(y) * cos(z)", "sin(x) * sin(y) * cos(z) - cos(x) * sin(z)", "cos(x) * sin(y) * cos(z) + sin(x) * sin(z)"], ["cos(y) * sin(z)", "sin(x) * sin(y) * sin(z) + cos(x) * cos(z)", "cos(x) * sin(y) * sin(z) - sin(x) * cos(z)"], ["-sin(y)", "sin(x) * cos(y)", "cos(x) * cos(y)"]]


def _moved(linear: list[list[str]]) -> list[list[str]]:
    """A linear map that keeps (1, 2, 3) in place."""
    return [[*row, f"{i + 1} - (({row[0]}) * 1 + ({row[1]}) * 2 + ({row[2]}) * 3)"] for i, row in enumerate(linear)]


_KEYS = "l_orderkey, l_linenumber"
_POINT = (1.0, 2.0, 3.0)


@query(f"WITH {_Q}, {_UNITS} SELECT {_KEYS}, {_cells_sql(_moved(_ROTATION))} FROM u")
def rotation_matrix(t: Tables) -> DataFrame:
    return _cells_of(t, lambda axis, q: T.rotation_matrix(q["w"], axis, T.vector(*_POINT)), 4)


@query(f"WITH {_Q}, {_UNITS} SELECT {_KEYS}, {_cells_sql(_moved(_MIRROR))} FROM u")
def reflection_matrix(t: Tables) -> DataFrame:
    return _cells_of(t, lambda axis, q: T.reflection_matrix(T.vector(*_POINT), axis), 4)


@query(f"WITH {_Q}, {_UNITS} SELECT {_KEYS}, {_cells_sql(_moved(_STRETCH))} FROM u")
def scale_matrix(t: Tables) -> DataFrame:
    return _cells_of(t, lambda axis, q: T.scale_matrix(q["w"], T.vector(*_POINT), axis), 4)


@query(f"WITH {_Q} SELECT {_KEYS}, {_cells_sql(_QUATERNION)} FROM (SELECT *, x * x + y * y + z * z + w * w AS d FROM q)")
def quaternion_matrix(t: Tables) -> DataFrame:
    return _cells_of(t, lambda axis, q: T.quaternion_matrix(q), 3)


@query(f"WITH {_Q} SELECT {_KEYS}, {_cells_sql(_EULER)} FROM q")
def euler_matrix(t: Tables) -> DataFrame:
    return _cells_of(t, lambda axis, q: T.euler_matrix(q["x"], q["y"], q["z"]), 3)


@query(f"WITH {_Q} SELECT {_KEYS}, {_cells_sql([[*row, f'{i + 1}'] for i, row in enumerate([['w * (' + c + ')' for c in row] for row in _EULER])])} FROM q")
def compose_matrix(t: Tables) -> DataFrame:
    return _cells_of(t, lambda axis, q: T.compose_matrix(F.array(q["w"], q["w"], q["w"]), None, F.array(q["x"], q["y"], q["z"]), T.vector(*_POINT)), 4)


@query(f"WITH {_Q} SELECT {_KEYS}, {_cells_sql([['1 / w' if i == j else '0' for j in range(3)] + [f'{-(i + 1)} / w'] for i in range(3)])} FROM q")
def inverse_matrix(t: Tables) -> DataFrame:
    """Of a translation after a scaling."""
    return _cells_of(t, lambda axis, q: T.inverse_matrix(T.product(T.translation_matrix(T.vector(*_POINT)), T.scale_matrix(q["w"]))), 4)


@query(f"""WITH {_Q}, a AS (SELECT *, (x * 0.5 + y * -0.5 + z * 0.5 + w * 0.5) / d AS cosine FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS d FROM q)),
b AS (SELECT *, CASE WHEN cosine < 0 THEN -1 ELSE 1 END AS turn, acos(least(1, abs(cosine))) AS angle FROM a)
SELECT {_KEYS}, {", ".join(_r(f"(sin(0.7 * angle) * {f} / d + sin(0.3 * angle) * turn * ({h})) / sin(angle)", f) for f, h in zip("xyzw", ("0.5", "-0.5", "0.5", "0.5"), strict=True))} FROM b""")
def quaternion_slerp(t: Tables) -> DataFrame:
    other = V.quaternion(*map(F.lit, (0.5, -0.5, 0.5, 0.5)))
    return _xyzw(_quaternions(t), T.quaternion_slerp(F.col("q"), other, F.lit(0.3)))


# -- sets, sorts, maps, reports

@query("SELECT page_id, url, CAST(row_number() OVER (ORDER BY url, page_id) AS BIGINT) AS rn FROM pages")
def sort_records(t: Tables) -> DataFrame:
    return series.ranked(t.pages.select("page_id", "url"), "url", "page_id")


@query("SELECT doc_id AS id, text, 'documents' AS origin FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark")
def union_compatible(t: Tables) -> DataFrame:
    a = t.documents.select(F.col("doc_id").alias("id"), "text", F.lit("documents").alias("origin"))
    return a.unionByName(t.benchmark.select(F.col("item_id").alias("id"), "text", F.lit("benchmark").alias("origin")))


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").intersect(t.labels.select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS width, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)) AS full_width FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def growing_width(t: Tables) -> DataFrame:
    """Rows of different widths; all have the widest one's in the matrix."""
    m = t.lineitem.join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("width"))
    return m.join(F.broadcast(t.lineitem.groupBy("l_orderkey").count().agg(F.max("count").alias("full_width"))))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'machines' ELSE '' END AS description FROM customer")
def map_lookup_default(t: Tables) -> DataFrame:
    m = F.create_map(*(F.lit(x) for x in ("BUILDING", "construction", "MACHINERY", "machines")))
    return t.customer.select("c_custkey", F.coalesce(F.element_at(m, F.col("c_mktsegment")), F.lit("")).alias("description"))


_MODS = "SELECT i, label, mod, x FROM (SELECT i, label, 'left' AS mod, v[1:32] AS x FROM v UNION ALL SELECT i, label, 'right', v[33:64] FROM v)"


@query(f"""WITH {_A}, {_EX}, m AS ({_MODS}), e AS (SELECT ex_id, ex_label, mod AS ex_mod, x AS ev FROM (SELECT ex_id, ex_label, 'left' AS mod, ev[1:32] AS x FROM ex UNION ALL SELECT ex_id, ex_label, 'right', ev[33:64] FROM ex)),
n AS (SELECT mod, ex_mod, i, any_value(label) AS label, arg_min(ex_label, ({_FROB('x', 'ev')}, ex_id)) AS frob, arg_min(ex_label, (-{_COS('x', 'ev')}, ex_id)) AS cosine FROM m CROSS JOIN e GROUP BY ALL)
SELECT mod AS mod_from, ex_mod AS mod_to, {_r('avg(CASE WHEN label = frob THEN 1.0 ELSE 0.0 END)', 'score_frobenius')}, {_r('avg(CASE WHEN label = cosine THEN 1.0 ELSE 0.0 END)', 'score_cosine')} FROM n GROUP BY ALL""")
def cross_modal_scores(t: Tables) -> DataFrame:
    """Recognition from either half of a vector against either half of the examples, all in one aggregation."""
    def halves(df: DataFrame, v: str, name: str, part: str) -> DataFrame:
        both = F.array(*(F.struct(F.lit(n).alias(part), F.slice(v, s, 32).alias(name)) for n, s in (("left", 1), ("right", 33))))
        return df.withColumn("b", F.explode(both)).select(*(c for c in df.columns if c != v), f"b.{part}", f"b.{name}")

    m = halves(t.vectors(True).withColumnRenamed("v", "whole"), "whole", "v", "mod_from")
    e = halves(t.examples().withColumnRenamed("ev", "whole"), "whole", "ev", "mod_to")
    near = evaluation.nearest(m, e, {"frobenius": V.frobenius, "cosine": V.cosine_diff}, ("mod_to",))
    return near.groupBy("mod_from", "mod_to").agg(*(r6(F.avg((F.col("label") == F.col(n)).cast("double"))).alias(f"score_{n}") for n in ("frobenius", "cosine")))


def _dot_sql(v: str, k: int, low: int, high: int) -> str:
    return f"list_sum(list_transform(list_zip({v}, {[_h0(k, j) for j in range(low, high)]}), lambda z: z[1] * z[2]))"


def _h0(k: int, j: int) -> float:
    """The starting dictionary of ``_nmf``."""
    return (1 + (k * 7 + j * 3) % 11) / sum(1 + (k * 7 + i * 3) % 11 for i in range(64))


def _spaces_sql(v: str, keys: str, rows: str) -> str:
    parts = []
    for name, own, other in (("left", 0, 32), ("right", 32, 0)):
        x = f"{v}[{own + 1}:{own + 32}]"
        w = f"[{', '.join(_dot_sql(x, k, own, own + 32) for k in range(3))}]"
        h = [[_h0(k, j) for k in range(3)] for j in range(other, other + 32)]
        r = f"list_transform({h}, lambda g: g[1] * w[1] + g[2] * w[2] + g[3] * w[3])"
        parts.append(f"SELECT {keys}, '{name}' AS mod, unnest(['internal', '{name}', '{'right' if own == 0 else 'left'}']) AS space, unnest([w, x, {r}]) AS p FROM (SELECT {keys}, {x} AS x, {w} AS w FROM {rows})")
    return " UNION ALL ".join(parts)


def _dots_with(columns: F.Column):
    return lambda w: F.transform(columns, lambda g: V.dot(w, g))


_SPACE_DIST = {"kl": _KL("s.p", "e.p"), "rev_kl": _KL("e.p", "s.p"), "frobenius": _FROB("s.p", "e.p"), "cosine": f"-{_COS('s.p', 'e.p')}"}


@query(f"""WITH {_A}, {_EX}, s AS ({_spaces_sql('v', 'i, label', 'v')}), e AS ({_spaces_sql('ev', 'ex_id, ex_label', 'ex')}),
n AS (SELECT s.mod AS source, e.mod AS target, s.space AS space, s.i, any_value(label) AS label, {', '.join(f"arg_min(ex_label, ({d}, ex_id)) AS {n}" for n, d in _SPACE_DIST.items())} FROM s JOIN e ON s.space = e.space GROUP BY ALL)
SELECT source, target, space, {', '.join(_r(f"avg(CASE WHEN label = {n} THEN 1.0 ELSE 0.0 END)", f"score_{n}") for n in _SPACE_DIST)} FROM n GROUP BY ALL""")
def modality_comparisons(t: Tables) -> DataFrame:
    """All 48 scores of two modalities, the halves of the vectors, under the starting dictionary: from each to each, by its coefficients, itself and what is reconstructed of it."""
    from .experiment import compared, scored

    h = np.array([[_h0(k, j) for j in range(64)] for k in range(3)])

    def spaces(df: DataFrame, v: str, *keys: str) -> DataFrame:
        rows = []
        for name, own, other, to in (("left", 0, 32, "right"), ("right", 32, 0, "left")):
            x = F.slice(v, own + 1, 32)
            w = F.array(*(V.dot(x, F.lit(h[k, own : own + 32].tolist())) for k in range(3)))
            columns = F.array(*map(F.lit, h[:, other : other + 32].T.tolist()))
            r = V.bound(w, _dots_with(columns))
            rows.append(F.array(*(F.struct(F.lit(name).alias("mod"), F.lit(s).alias("space"), p.alias("p")) for s, p in (("internal", w), (name, x), (to, r)))))
        return df.select(*keys, F.inline(F.concat(*rows)))

    test = spaces(t.vectors(True), "v", "i", "label").select("i", "label", F.col("mod").alias("source"), "space", F.col("p").alias("v"))
    ex = spaces(t.examples(), "ev", "ex_id", "ex_label").select("ex_id", "ex_label", F.col("mod").alias("target"), "space", F.col("p").alias("ev"))
    return scored(compared(test, ex)).select("source", "target", "space", *(r6(f"score_{n}").alias(f"score_{n}") for n in _SPACE_DIST))


@query("SELECT event_type, " + ", ".join(_r(f"quantile_cont(value, {p})", n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))) + f", min(value) AS low, max(value) AS high, {_r('avg(value)', 'mean')} FROM events GROUP BY 1")
def plot_box_stats(t: Tables) -> DataFrame:
    q = [r6(F.percentile("value", F.lit(p))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return t.events.groupBy("event_type").agg(*q, F.min("value").alias("low"), F.max("value").alias("high"), r6(F.avg("value")).alias("mean"))


@query("SELECT a.lang AS a, b.lang AS b FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b WHERE a.lang <> b.lang")
def modality_pairs(t: Tables) -> DataFrame:
    m = t.documents.select("lang").distinct()
    return m.select(F.col("lang").alias("a")).join(pairing.small(m.select(F.col("lang").alias("b"))), F.col("a") != F.col("b"))
