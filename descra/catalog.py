"""Registered queries over the engine's own operators, each beside the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descra.functions import chemistry as ch
from descra.functions import scalars as sc
from descra.functions.scalars import q6
from descra.operators import columns, folds, joins, residues, selection, spatial, stats, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components of each embedding as a point of its label."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf_dir, "embeddings").select("label", "vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("vec_id") % 7 - 3).cast("double").alias("charge"))


POINTS = "p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (vec_id % 7 - 3)::DOUBLE AS charge FROM embeddings)"
Q6 = lambda x: f"floor(({x})*1e6+0.5)/1e6"
D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"

_METRICS = """n, CASE WHEN good THEN floor(spearman*1e6+0.5)/1e6 END AS spearman, CASE WHEN good THEN floor(pearson*1e6+0.5)/1e6 END AS pearson,
 CASE WHEN good THEN floor((1-sse/(vp*n))*1e6+0.5)/1e6 END AS r2, CASE WHEN good THEN floor(sse/n+0.5) END AS mse"""


def _metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return stats.metrics(df, keys, "y", "yhat").select(*keys, "n", q6(F.col("spearman")).alias("spearman"), q6(F.col("pearson")).alias("pearson"), q6(F.col("r2")).alias("r2"), F.floor(F.col("mse") + F.lit(0.5)).cast("double").alias("mse"))


@query(f"""WITH t AS (SELECT l_returnflag AS flag, l_extendedprice AS y, l_quantity*1500 AS yhat FROM lineitem),
 r AS (SELECT *, rank() OVER (PARTITION BY flag ORDER BY y) + (count(*) OVER (PARTITION BY flag, y) - 1)/2.0 AS ry, rank() OVER (PARTITION BY flag ORDER BY yhat) + (count(*) OVER (PARTITION BY flag, yhat) - 1)/2.0 AS rp FROM t),
 g AS (SELECT flag, count(*) AS n, corr(ry, rp) AS spearman, corr(y, yhat) AS pearson, sum((y-yhat)*(y-yhat)) AS sse, var_pop(y) AS vp, max(y)>min(y) AND max(yhat)>min(yhat) AND count(*)>=2 AS good FROM r GROUP BY flag)
 SELECT flag, {_METRICS} FROM g""")
def metrics_by_group(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("yhat"))
    return _metrics(rows, ["flag"])


@query(f"""WITH t AS (SELECT o_totalprice AS y, (o_custkey % 100)::DOUBLE AS yhat FROM orders),
 r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0 AS ry, rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1)/2.0 AS rp FROM t),
 g AS (SELECT count(*) AS n, corr(ry, rp) AS spearman, corr(y, yhat) AS pearson, sum((y-yhat)*(y-yhat)) AS sse, var_pop(y) AS vp, true AS good FROM r)
 SELECT {_METRICS} FROM g""")
def pooled_metrics(spark, sf_dir):
    return _metrics(read(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_custkey") % 100).cast("double").alias("yhat")), [])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {Q6(f'corr({a}, {b})')} AS r, count(*) AS n FROM lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlation_matrix(spark, sf_dir):
    return stats.correlations(read(spark, sf_dir, "lineitem"), NUMBERS).select("a", "b", q6(F.col("r")).alias("r"), "n")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_tax*2.5 + l_discount*8 + 0.01 AS p FROM lineitem),
 r AS (SELECT *, count(*) OVER (PARTITION BY l_linenumber) AS n, count(*) OVER (PARTITION BY l_linenumber ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t)
 SELECT l_orderkey, l_linenumber, {Q6("least(1.0, min(p*n/k) OVER (PARTITION BY l_linenumber ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")} AS q FROM r""")
def adjusted_p_values(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 2.5 + F.col("l_discount") * 8 + 0.01).alias("p"))
    return stats.benjamini_hochberg(rows, ["l_linenumber"], "p").select("l_orderkey", "l_linenumber", q6(F.col("q")).alias("q"))


@query(f"""WITH s AS (SELECT {", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi, stddev_pop({c}) AS {c}_sd, avg({c}) AS {c}_m" for c in NUMBERS)} FROM lineitem)
 {" UNION ALL ".join(f"SELECT '{c}' AS feature, {Q6(f'({c}_sd/({c}_hi-{c}_lo))/(abs(({c}_m-{c}_lo)/({c}_hi-{c}_lo))+1e-8)')} AS spread, ({c}_sd/({c}_hi-{c}_lo))/(abs(({c}_m-{c}_lo)/({c}_hi-{c}_lo))+1e-8) >= 0.01 AS keep FROM s" for c in NUMBERS)}""")
def low_variance_screen(spark, sf_dir):
    return stats.relative_spread(read(spark, sf_dir, "lineitem"), NUMBERS).select("feature", q6(F.col("spread")).alias("spread"), "keep")


@query(f"""WITH s AS (SELECT min(l_quantity) AS qlo, max(l_quantity) AS qhi, min(l_extendedprice) AS plo, max(l_extendedprice) AS phi FROM lineitem WHERE l_linenumber <= 3)
 SELECT l_orderkey, l_linenumber, {Q6("(l_quantity-qlo)/(qhi-qlo)")} AS l_quantity, {Q6("(l_extendedprice-plo)/(phi-plo)")} AS l_extendedprice FROM lineitem, s""")
def train_scaled(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return stats.min_max(rows, ["l_quantity", "l_extendedprice"], F.col("l_linenumber") <= 3).withColumns({c: q6(F.col(c)) for c in ("l_quantity", "l_extendedprice")})


@query("""WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS k FROM c)
 SELECT l_returnflag, l_quantity AS quantity FROM r WHERE k = 1""")
def mode_smallest_on_ties(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(stats.mode("l_quantity").alias("quantity"))


@query(f"""WITH s AS (SELECT c_nationkey AS nation, o_custkey AS cust, list(DISTINCT o_orderpriority) AS f FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
 p AS (SELECT a.nation, len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(list_concat(a.f, b.f))) AS j FROM s a JOIN s b ON a.nation = b.nation AND a.cust < b.cust)
 SELECT n.nation, {Q6("avg(j)")} AS jaccard FROM (SELECT DISTINCT nation FROM s) n LEFT JOIN p ON p.nation = n.nation GROUP BY 1""")
def mean_pairwise_jaccard(spark, sf_dir):
    sets = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("cust")).agg(F.collect_set("o_orderpriority").alias("f"))
    return stats.mean_jaccard(sets, ["nation"], "cust", "f").select("nation", q6(F.col("jaccard")).alias("jaccard"))


@query("""SELECT event_type AS feature, count(*) AS votes FROM (SELECT DISTINCT user_id, cast(ts AS DATE) AS d, event_type FROM events) GROUP BY 1""")
def feature_votes(spark, sf_dir):
    runs = read(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date")).agg(F.collect_list("event_type").alias("f"))
    return stats.votes(runs, "f")


@query("""WITH c AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) - 1 AS i, count(*) OVER () AS m, max(n) OVER () AS f, min(n) OVER () AS l FROM c),
 d AS (SELECT *, abs((l-f)*i - (m-1)*(n-f)) AS far FROM r), k AS (SELECT i AS cut FROM d ORDER BY far DESC, i LIMIT 1) SELECT name, n FROM d, k WHERE i <= cut OR m < 3""")
def elbow_cut(spark, sf_dir):
    return stats.elbow(read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("n")), "name", "n")


@query(f"""WITH s AS (SELECT p_size, p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1, 2), t AS (SELECT p_size, v / sum(v) OVER (PARTITION BY p_size) AS p FROM s) SELECT p_size, {Q6("-sum(p*ln(p))")} AS entropy FROM t GROUP BY 1""")
def share_entropy(spark, sf_dir):
    from descra.operators.clusters import entropy

    return entropy(read(spark, sf_dir, "part"), ["p_size"], "p_brand", "p_retailprice").select("p_size", q6(F.col("entropy")).alias("entropy"))


@query("""WITH r AS (SELECT s_nationkey, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name DESC) AS k FROM supplier) SELECT s_nationkey, s_acctbal, s_name FROM r WHERE k = 1""")
def best_by_score_then_name(spark, sf_dir):
    return selection.best(read(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal", "s_name"), ["s_nationkey"], ["s_acctbal", "s_name"])


_RESULTS = "SELECT l_linestatus AS target_col, l_returnflag AS technique, l_linenumber AS outer_fold, floor(avg(l_discount)*1e6+0.5)/1e6 AS inner_pooled_spearman FROM lineitem GROUP BY 1, 2, 3"


def _results(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("target_col"), F.col("l_returnflag").alias("technique"), F.col("l_linenumber").alias("outer_fold"))
    return rows.agg(q6(F.avg("l_discount")).alias("inner_pooled_spearman"))


@query(f"""WITH r AS ({_RESULTS}), k AS (SELECT *, row_number() OVER (PARTITION BY target_col, outer_fold ORDER BY inner_pooled_spearman DESC, technique DESC) AS i FROM r), w AS (SELECT target_col, technique, count(*) AS wins FROM k WHERE i = 1 GROUP BY 1, 2)
 SELECT t.target_col, t.technique, coalesce(wins, 0) AS wins FROM (SELECT DISTINCT target_col, technique FROM r) t LEFT JOIN w ON w.target_col = t.target_col AND w.technique = t.technique""")
def technique_wins(spark, sf_dir):
    return selection.wins(_results(spark, sf_dir))


@query(f"""WITH r AS ({_RESULTS}), m AS (SELECT target_col, technique, avg(inner_pooled_spearman) AS v FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY target_col ORDER BY v DESC, technique DESC) AS i FROM m)
 SELECT target_col, technique, {Q6("v")} AS mean_inner FROM k WHERE i = 1""")
def deployed_technique(spark, sf_dir):
    return selection.deployed_technique(_results(spark, sf_dir)).select("target_col", "technique", q6(F.col("mean_inner")).alias("mean_inner"))


@query("""WITH h AS (SELECT DISTINCT user_id, floor(epoch(ts)/3600)::BIGINT AS h FROM events), i AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM h)
 SELECT user_id, min(h) AS first_hour, max(h) AS last_hour, count(*) AS hours FROM i GROUP BY user_id, g""")
def gaps_and_islands(spark, sf_dir):
    hours = read(spark, sf_dir, "events").select("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h")).distinct()
    return residues.islands(hours, ["user_id"], "h").groupBy("user_id", "island").agg(F.min("h").alias("first_hour"), F.max("h").alias("last_hour"), F.count("*").alias("hours")).drop("island")


@query(f"""SELECT n_name, o_orderpriority, count(*) AS n, {Q6("sum(o_totalprice)/1e6")} AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def merged_tables(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), "o_orderpriority", "o_totalprice")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    merged = joins.merge_descriptors(orders, customers, check=False).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return merged.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), q6(F.sum("o_totalprice") / 1e6).alias("total"))


@query("""SELECT doc_id::VARCHAR AS doc_id, source, coalesce(quality::BIGINT, -1) AS quality, coalesce(toxic::BIGINT, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def left_in_order(spark, sf_dir):
    return joins.in_order_of(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("quality", "toxic")])


@query("""WITH r AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END AS code, min(o_orderkey) AS v FROM orders GROUP BY 1, 2),
 u AS (SELECT k, count(DISTINCT code) AS n, max(CASE WHEN code = '' THEN v END) AS plain, max(v) AS only FROM r GROUP BY 1),
 l AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE '' END AS code FROM customer)
 SELECT l.k, l.code, coalesce(r.v, CASE WHEN l.code = '' THEN CASE WHEN u.n = 1 THEN u.only ELSE u.plain END END, -1) AS v FROM l LEFT JOIN r ON r.k = l.k AND r.code = l.code LEFT JOIN u ON u.k = l.k""")
def key_repair(spark, sf_dir):
    right = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("code")).agg(F.min("o_orderkey").alias("v"))
    left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "F").otherwise("").alias("code"))
    return joins.repaired(left, right, ["k"], "code", "v").select("k", "code", F.coalesce("v", F.lit(-1)).alias("v"))


@query(f"WITH {POINTS} SELECT a.label, a.vec_id, b.vec_id AS to_vec_id, {Q6(f'sqrt({D2})')} AS distance FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {D2} <= 0.05*0.05")
def radius_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.radius_join(p, p, ["label"], 0.05).where("vec_id <> to_vec_id").select("label", "vec_id", "to_vec_id", q6(F.col("distance")).alias("distance"))


@query(f"WITH {POINTS}, s AS (SELECT a.vec_id, sum(b.charge) AS t FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {D2} <= 0.01 GROUP BY 1) SELECT label, sum(CASE WHEN t < 0 THEN t ELSE 0 END) AS negative, sum(CASE WHEN t > 0 THEN t ELSE 0 END) AS positive FROM p LEFT JOIN s USING (vec_id) GROUP BY 1")
def neighbour_charge(spark, sf_dir):
    total = spatial.neighbour_sums(points(spark, sf_dir), ["label"], "vec_id", 0.1, "charge")
    return total.groupBy("label").agg(F.sum(F.least(F.col("total"), F.lit(0.0))).alias("negative"), F.sum(F.greatest(F.col("total"), F.lit(0.0))).alias("positive"))


@query(f"WITH {POINTS} SELECT label, vec_id FROM p b WHERE EXISTS (SELECT 1 FROM p a WHERE a.label = b.label AND a.x > 0.2 AND {D2} <= 0.01)")
def vicinity_of_centres(spark, sf_dir):
    return spatial.vicinity(points(spark, sf_dir), ["label"], ["vec_id"], F.col("x") > 0.2, 0.1)


@query(f"WITH {POINTS}, d AS (SELECT a.label, sqrt({D2}) AS d FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {D2} <= 0.0225) SELECT label, 0.05 ::DOUBLE AS shell, count(*) FILTER (d >= 0.05 AND d < 0.1) AS pairs FROM d GROUP BY 1 UNION ALL SELECT label, 0.1 ::DOUBLE, count(*) FILTER (d >= 0.1 AND d < 0.15) FROM d GROUP BY 1")
def distance_shells(spark, sf_dir):
    return spatial.shell_pairs(points(spark, sf_dir), ["label"], "vec_id", [(0.05, 0.05), (0.1, 0.05)])


@query(f"""WITH {POINTS}, m AS (SELECT a.vec_id, count(*) AS n, {", ".join(f"covar_pop(b.{c[0]}, b.{c[1]}) AS {c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM p a JOIN p b ON a.label = b.label WHERE {D2} <= 0.04 GROUP BY 1 HAVING count(*) >= 4)
 SELECT vec_id, n, {Q6("xx*yy*zz + 2*xy*yz*xz - xx*yz*yz - yy*xz*xz - zz*xy*xy")} AS det, {Q6("xx+yy+zz")} AS trace FROM m""")
def local_covariance(spark, sf_dir):
    m = spatial.planarity_moments(points(spark, sf_dir), ["label"], "vec_id", 0.2)
    det = F.expr("xx*yy*zz + 2*xy*yz*xz - xx*yz*yz - yy*xz*xz - zz*xy*xy")
    return m.select("vec_id", "n", q6(det).alias("det"), q6(F.expr("xx+yy+zz")).alias("trace"))


@query(f"SELECT l_linenumber, {Q6('sum(-1.0/(1.0+power(10.0, l_discount*100 - 7.5)))')} AS acid, {Q6('sum(1.0/(1.0+power(10.0, 7.5 - l_discount*100)))')} AS base FROM lineitem GROUP BY 1")
def net_charge(spark, sf_dir):
    pka = F.col("l_discount") * 100
    charge = lambda r: q6(F.sum(ch.fractional_charge(F.lit(r), pka, 7.5)))
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(charge("ASP").alias("acid"), charge("LYS").alias("base"))


@query("SELECT doc_id, len(list_filter(range(1, len(text)), lambda i: substr(text, i, 2) = 'ee')) AS n FROM documents")
def overlapping_motifs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", sc.motif_count(F.col("text"), "ee").cast("long").alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS props_k FROM events")
def flattened_json(spark, sf_dir):
    from descra.sources.results import flatten

    rows = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return flatten(rows)


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS number FROM pages")
def parsed_fields(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)", 1).try_cast("int").alias("number"))


@query("""WITH l AS (SELECT DISTINCT event_type FROM events WHERE user_id % 2 = 0 AND event_type <> 'click') SELECT event_id, """ + ", ".join(f"CASE WHEN event_type = '{v}' AND EXISTS (SELECT 1 FROM l WHERE l.event_type = '{v}') THEN 1.0 ELSE 0.0 END AS is_{v}" for v in ("purchase", "view")) + " FROM events")
def one_hot_from_train_levels(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    coded = folds.one_hot(rows, ["event_type"], (F.col("user_id") % 2 == 0) & (F.col("event_type") != "click"))
    at = lambda v: F.col(f"event_type__{v}") if f"event_type__{v}" in coded.columns else F.lit(0.0)
    return coded.select("event_id", at("purchase").alias("is_purchase"), at("view").alias("is_view"))


@query("""WITH f AS (SELECT o_orderstatus AS target, o_custkey % 5 AS fold, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT target, sum(n) AS al FROM f GROUP BY 1)
 SELECT a.target, a.fold AS outer, b.fold AS inner, (t.al - a.n - b.n)::BIGINT AS n_train, b.n AS n_test FROM f a JOIN f b ON a.target = b.target AND a.fold <> b.fold JOIN t ON t.target = a.target WHERE t.al - a.n - b.n >= 2 AND b.n >= 2""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def nested_folds(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("target"), (F.col("o_custkey") % 5).alias("fold"))
    return folds.nested(rows, ["target"])


@query("""WITH l AS (SELECT DISTINCT source FROM documents), n AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS fold FROM l) SELECT doc_id, source, fold::INTEGER AS fold FROM documents JOIN n USING (source)""")
def label_folds(spark, sf_dir):
    return folds.column_folds(read(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "fold")


@query("""SELECT 'duplicate name' AS rule, trim(text) AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY trim(text) HAVING count(*) > 1""")
def duplicate_names(spark, sf_dir):
    return validate.duplicates(read(spark, sf_dir, "documents"), "text")


@query("""SELECT 'no structure' AS rule, doc_id::VARCHAR AS key, '' AS detail FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'orphan structure', doc_id::VARCHAR, '' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""")
def coverage_both_ways(spark, sf_dir):
    return validate.both_ways(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT source, count(*) AS expected, count(l.doc_id) AS found, count(*) = count(l.doc_id) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def complete_datasets(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("source", "doc_id")
    return validate.complete_groups(documents, documents.join(read(spark, sf_dir, "labels"), "doc_id"), "source", "doc_id")


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey, o_totalprice FROM f JOIN orders USING (o_custkey, o_orderkey)""")
def first_of_each_name(spark, sf_dir):
    return folds.rebuild(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("""WITH n AS (SELECT DISTINCT event_type || '_' || (user_id % 4) AS name FROM events), s AS (SELECT 'click' AS stem UNION ALL SELECT 'click_1' UNION ALL SELECT 'view' UNION ALL SELECT 'vie') SELECT name, arg_max(stem, len(stem)) AS stem FROM n JOIN s ON name = stem OR starts_with(name, stem || '_') GROUP BY 1""")
def longest_stem(spark, sf_dir):
    names = read(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", (F.col("user_id") % 4).cast("string")).alias("name")).distinct()
    return joins.longest_prefix(names, spark.createDataFrame([("click",), ("click_1",), ("view",), ("vie",)], "stem string"))


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_linenumber AS to_l_linenumber, b.l_quantity AS to_l_quantity, o.o AS "offset" FROM lineitem a, (SELECT -1 AS o UNION ALL SELECT 2) o JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + o.o""")
def offset_join(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(0.0).alias("energy")) for o in (-1, 2)])
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", pairs.alias("bonds"))
    return joins.by_offset(rows, ["l_orderkey"], "l_linenumber", "bonds").select("l_orderkey", "l_linenumber", "to_l_linenumber", "to_l_quantity", "offset")


@query("""SELECT p_partkey, trim(regexp_replace(trim(p_name), '[^a-zA-Z0-9_.-]+', '_', 'g'), '_') AS slug, sha256(p_name) AS digest FROM part""")
def name_tokens(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", sc.slug(F.col("p_name")).alias("slug"), F.sha2("p_name", 256).alias("digest"))


@query("""WITH n AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT k, greatest(1, floor(n*0.15))::INTEGER AS budget, floor(greatest(0.4, least(0.8, 1.0/log10(n+5)))*1e6+0.5)/1e6 AS share FROM n""")
def selection_budget(spark, sf_dir):
    n = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return n.select("k", sc.feature_budget(F.col("n")).alias("budget"), q6(sc.subsample_fraction(F.col("n"))).alias("share"))


@query("""SELECT r_name AS region, n_name AS nation, s AS segment FROM region, nation, (SELECT DISTINCT c_mktsegment AS s FROM customer)""")
def task_table(spark, sf_dir):
    r, n = read(spark, sf_dir, "region").select(F.col("r_name").alias("region")), read(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"))
    return joins.tasks(r, n, read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()).drop("task_id")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in groups of 50 at most, as small as a molecule."""
    return points(spark, sf_dir).withColumn("structure_id", F.concat_ws(":", F.col("label").cast("string"), F.floor(F.col("vec_id") / 50).cast("string")))


@query()
def point_clusters(spark, sf_dir):
    from descra.operators import clusters

    found = clusters.cluster(molecules(spark, sf_dir).select("structure_id", "vec_id", "x", "y", "z"), ["structure_id"], 0.12, 2, "vec_id")
    return found.select("structure_id", "vec_id", "cluster")


@query()
def hull_volumes(spark, sf_dir):
    import pandas as pd

    from descra.operators import clusters

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"structure_id": [frame.structure_id.iloc[0]], "volume": [clusters.hull_volume(frame[["x", "y", "z"]].to_numpy())]})

    return molecules(spark, sf_dir).groupBy("structure_id").applyInPandas(run, "structure_id string, volume double").select("structure_id", q6(F.col("volume")).alias("volume"))


@query()
def isoelectric_points(spark, sf_dir):
    from descra.operators import descriptors

    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_returnflag", "l_linestatus", (F.col("l_orderkey") % 200).cast("string")).alias("structure_id"), F.element_at(F.array(*map(F.lit, ("ASP", "GLU", "LYS", "ARG"))), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("resname"), (F.col("l_discount") * 100 + 1).alias("pka"))
    return descriptors.isoelectric(rows).select("structure_id", q6(F.col("protein_pi")).alias("protein_pi"))


@query()
def shuffled_folds(spark, sf_dir):
    names = sorted(r.n_name for r in read(spark, sf_dir, "nation").select("n_name").collect())  # an assay table is small
    return folds.shuffled_folds(spark, names, 5, 42)


@query()
def pruned_features(spark, sf_dir):
    rows = stats.correlations(read(spark, sf_dir, "lineitem"), NUMBERS).collect()  # a row a pair of columns
    with_target = {r.b if r.a == "l_quantity" else r.a: r.r for r in rows if "l_quantity" in (r.a, r.b)}
    kept = stats.prune_pairs([(r.a, r.b, r.r) for r in rows if "l_quantity" not in (r.a, r.b)], with_target)
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query()
def cross_validated_models(spark, sf_dir):
    """Each nation's customers as an assay: their balance from their orders, in folds by key."""
    from descra.operators import crossval

    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("top_price"))
    own = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    nations = [r.n_nationkey for r in read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    targets = [F.when(F.col("c_nationkey") == n, F.col("c_acctbal")).alias(f"target_{n}") for n in nations]
    table = own.select(F.col("c_name").alias("name"), (F.col("c_custkey") % 3).cast("int").alias("fold"), F.col("c_custkey").alias("row_ord"), "n_orders", "mean_price", "top_price", *targets)
    found = crossval.cross_validate(table, [f"target_{n}" for n in nations], ["n_orders", "mean_price", "top_price"])
    return found.select("target_col", "technique", "outer_fold", "eval_model", "n_test", "n_selected_features", *[q6(F.col(c)).alias(c) for c in ("inner_pooled_spearman", "spearman", "pearson", "r2", "mse")], "error")



def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_by_group(spark, sf_dir)
