"""Registered queries of the recommender operators, each with the same computation in plain SQL.

Interactions are customers x parts with the summed quantity; item features are brand, type and size; user features are
segment and nation. Everything runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import biggest_unit, confidence, dot, rank_in, release_year, tokens
from ..operators import evaluate as ev
from ..operators import matrix as mx
from ..operators import recommend as rc
from ..operators import similarity as sm
from ..operators import split as sp
from ..operators import statistics as st
from ..operators.packed import Packed, pack
from ..sources.readers import submission, unpivot_features
from ..sources.store import checkpointed, remove, scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def bought(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "l_quantity")


def urm(spark: SparkSession, d: str) -> DataFrame:
    return mx.build(bought(spark, d), "user_id", "item_id", "l_quantity")


def cells(m: DataFrame) -> DataFrame:
    return m.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), "data")


def icm(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), "p_brand", "p_type", "p_size")
    return unpivot_features(part, "item_id", ["p_brand", "p_type", "p_size"])


def ucm(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    return unpivot_features(who, "user_id", ["c_mktsegment", "c_nationkey"])


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))


def count_of(dimension: DataFrame) -> DataFrame:
    return dimension.agg(F.count("*").alias("n"))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # one shuffle by user serves the sums and the ranks; the split is stored, so that it is computed once
    m = mx.build(bought(spark, d).repartition("user_id"), "user_id", "item_id", "l_quantity")
    s = checkpointed(sp.holdout_user_wise(m))
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def packed_train(spark: SparkSession, d: str) -> Packed:
    """The train cells packed by user; the stored split is gone afterwards."""
    with scratch() as stay:
        return stay(pack(parts(spark, d)[0], "user_id", "item_id"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


# SQL fragments that several oracles share.
URM = "urm AS (SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS data FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"
HASH = "(user_id * 7919 + item_id * 104729 + 42) % 1000003"
SPLIT = f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {HASH}, item_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM urm),
split AS (SELECT user_id, item_id, data, CASE WHEN k <= CASE WHEN round_even(n * 0.8, 0) = n AND n > 1 THEN n - 1 ELSE round_even(n * 0.8, 0) END THEN 'train' ELSE 'test' END AS split FROM ranked),
train AS (SELECT user_id, item_id, data FROM split WHERE split = 'train'), test AS (SELECT user_id, item_id, data FROM split WHERE split = 'test')"""
ICM = "icm AS (SELECT p_partkey AS item_id, 'p_brand_' || p_brand AS feature_id, 1.0 AS data FROM part UNION ALL SELECT p_partkey, 'p_type_' || p_type, 1.0 FROM part UNION ALL SELECT p_partkey, 'p_size_' || p_size, 1.0 FROM part)"
UCM = "ucm AS (SELECT c_custkey AS user_id, 'c_mktsegment_' || c_mktsegment AS feature_id, 1.0 AS data FROM customer UNION ALL SELECT c_custkey, 'c_nationkey_' || c_nationkey, 1.0 FROM customer)"


def sim_sql(weight: str, source: str = "urm", row: str = "user_id", col: str = "item_id", data: str = "data", norm: str = "sqrt(sum(data * data) OVER (PARTITION BY col))", k: int | None = 50, name: str = "sim", product: str = "a.data * b.data") -> str:
    """CTEs ending in `name` (i, j, w); weight is over d, i's norm ni and the target's nj."""
    cut = f"WHERE r <= {k}" if k else ""
    return f"""{name}_m AS (SELECT {row} AS row, {col} AS col, {data} AS data FROM {source}), {name}_n AS (SELECT *, {norm} AS norm FROM {name}_m),
{name}_p AS (SELECT a.col AS i, b.col AS j, sum({product}) AS d, max(a.norm) AS ni, max(b.norm) AS nj FROM {name}_n a JOIN {name}_n b ON a.row = b.row AND a.col <> b.col GROUP BY 1, 2),
{name}_w AS (SELECT i, j, {weight} AS w FROM {name}_p),
{name} AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(w, 9) DESC, i) AS r FROM {name}_w WHERE w <> 0) {cut})"""


COSINE = "d / (ni * nj + 100 + 1e-6)"
OUT = " SELECT i, j, round(w, 6) AS w FROM sim"


def recs_sql(scores: str, seen: str = "train", k: int = 10, name: str = "recs") -> str:
    return f"""{name} AS (SELECT user_id, item_id, rank, score FROM (SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY round(score, 9) DESC, s.item_id) AS rank
FROM ({scores}) s WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.user_id = s.user_id AND x.item_id = s.item_id)) WHERE rank <= {k})"""


ITEM_SCORES = "SELECT t.user_id, w.j AS item_id, sum(t.data * w.w) AS score FROM train t JOIN sim w ON t.item_id = w.i GROUP BY 1, 2"
RECS_OUT = " SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM recs"


def shown(recommendations: DataFrame) -> DataFrame:
    return rounded(recommendations.withColumn("rank", F.col("rank").cast("long")), "score")


# ---- construction, encoding, cleaning


@query(f"WITH {URM} SELECT * FROM urm")
def urm_build(spark, d):
    return urm(spark, d)


@query("WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS original_id, min(event_id) AS p FROM events GROUP BY 1) SELECT original_id, row_number() OVER (ORDER BY p, original_id) - 1 AS idx FROM seen")
def id_mapper(spark, d):
    return mx.id_mapper([(table(spark, d, "events"), "user_id", "event_id")])


@query("""WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS original_id, min(event_id) AS p FROM events GROUP BY 1), m AS (SELECT original_id, row_number() OVER (ORDER BY p, original_id) - 1 AS idx FROM seen)
SELECT original_id, row_number() OVER (ORDER BY idx) - 1 AS idx FROM m WHERE original_id NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 15)""")
def remap_compact(spark, d):
    e = table(spark, d, "events")
    m = mx.id_mapper([(e, "user_id", "event_id")])
    bad = e.where("event_type = 'error'").groupBy(F.col("user_id").cast("string").alias("original_id")).count().where("count > 15")
    return mx.compact_mapper(m, m.join(bad, "original_id", "left_semi").select("idx"))


@query("""WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS original_id, min(event_id) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1), m AS (SELECT original_id, row_number() OVER (ORDER BY p, original_id) - 1 AS idx FROM seen)
SELECT event_id, idx AS user_id, value FROM events JOIN m ON CAST(user_id AS VARCHAR) = original_id""")
def encode_known(spark, d):
    e = table(spark, d, "events")
    return mx.encode(e.select("event_id", "user_id", "value"), mx.id_mapper([(e.where("event_type = 'purchase'"), "user_id", "event_id")]), "user_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS k FROM events) WHERE k = 1")
def dedup_latest(spark, d):
    return mx.dedup_latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query(f"WITH {ICM}, often AS (SELECT feature_id FROM icm GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= (SELECT count(*) FROM part) * 0.1) SELECT icm.item_id, icm.feature_id, CAST(icm.data AS DOUBLE) AS data FROM icm JOIN often USING (feature_id)")
def feature_filter(spark, d):
    return mx.filter_features(icm(spark, d), count_of(items(spark, d)), 5, 0.1).select("item_id", "feature_id", "data")


def _core_sql(rounds: int, k: int) -> str:
    out, last = f"WITH {URM}", "urm"
    for r in range(rounds):
        out += f", u{r} AS (SELECT * FROM {last} WHERE user_id IN (SELECT user_id FROM {last} GROUP BY 1 HAVING count(*) >= {k})), i{r} AS (SELECT * FROM u{r} WHERE item_id IN (SELECT item_id FROM u{r} GROUP BY 1 HAVING count(*) >= {k}))"
        last = f"i{r}"
    return out + f" SELECT * FROM {last}"


@query(_core_sql(3, 25))
def kcore_unrolled3(spark, d):
    return mx.k_core(urm(spark, d), 25, rounds=3).select("user_id", "item_id", "data")


@query(f"WITH {URM} SELECT user_id, item_id, data + 1.5 AS data, CAST(floor(item_id / 100) AS BIGINT) AS slice FROM urm WHERE data >= 20 AND data + 1.5 <> 0")
def threshold_shift_slices(spark, d):
    return mx.column_slices(mx.shift(urm(spark, d).where("data >= 20"), 1.5), "item_id", 100)


@query(f"WITH {URM} SELECT user_id AS row, item_id AS col, data FROM urm UNION ALL SELECT p_partkey + 1000000, p_size, 0.5 FROM part")
def stack_matrices(spark, d):
    second = table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_size").cast("long").alias("col"), F.lit(1.0).alias("data"))
    return mx.stack_rows(cells(urm(spark, d)), second, 1000000, 0.5)


@query("SELECT p_partkey AS item_id, CAST(p_size AS BIGINT) AS feature_id, CAST(1 AS DOUBLE) AS data FROM part UNION ALL SELECT l_partkey, CAST(max(l_linenumber) AS BIGINT) + 51, CAST(1 AS DOUBLE) FROM lineitem GROUP BY 1")
def merge_features(spark, d):
    first = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").cast("long").alias("feature_id"), F.lit(1.0).alias("data"))
    second = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(F.max("l_linenumber").cast("long").alias("feature_id")).withColumn("data", F.lit(1.0))
    return mx.merge_features(first, second, 51)


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def cold_users(spark, d):
    return mx.cold(users(spark, d), table(spark, d, "events").where("event_type = 'purchase'"), "user_id")


@query(f"WITH {URM}, gone AS (SELECT item_id FROM urm GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 20) SELECT user_id, count(*) AS n FROM urm WHERE item_id NOT IN (SELECT item_id FROM gone) GROUP BY 1 HAVING count(*) >= 10")
def remove_items_prune(spark, d):
    m = urm(spark, d)
    pop = m.groupBy("item_id").count().orderBy(F.desc("count"), "item_id").limit(20).select("item_id")
    return ev.prune_users(m, 10, ignore_items=pop).groupBy("user_id").agg(F.count("*").alias("n"))


# ---- statistics and checks


@query(f"""WITH {URM}, per AS (SELECT c_custkey, count(item_id) AS n FROM customer LEFT JOIN urm ON user_id = c_custkey GROUP BY 1)
SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS cells, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS median, (SELECT count(*) FROM part) AS items, round(sum(n) / (count(*) * (SELECT count(*) FROM part)), 6) AS density FROM per""")
def density_stats(spark, d):
    return rounded(st.density(urm(spark, d), items(spark, d), users(spark, d)), "mean", "density")


@query(f"WITH {URM}, n AS (SELECT count(*) + 1e-7 AS x FROM urm GROUP BY user_id), k AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM n) SELECT round(sum((2 * k - (SELECT count(*) FROM n) - 1) * x) / ((SELECT count(*) FROM n) * sum(x)), 6) AS gini FROM k")
def gini_profile(spark, d):
    return rounded(st.gini(urm(spark, d).groupBy("user_id").agg(F.count("*").alias("n")), "n"), "gini")


@query(f"""WITH {URM}, n AS (SELECT item_id, count(*) AS n FROM urm GROUP BY 1), k AS (SELECT n, row_number() OVER (ORDER BY n, item_id) - 1 AS k, (SELECT count(*) FROM n) AS m FROM n),
p AS (SELECT n, CASE WHEN k >= m - floor(m / 10) THEN 'head' WHEN k < floor(m / 10) THEN 'tail' WHEN k >= floor(m * 0.45) AND k < floor(m * 0.55) THEN 'middle' END AS part FROM k)
SELECT part, round(avg(n), 6) AS mean FROM p WHERE part IS NOT NULL GROUP BY 1""")
def popularity_slices(spark, d):
    return rounded(st.popularity_slices(urm(spark, d)), "mean")


@query(f"""WITH {URM}{SPLIT} SELECT 'zero cells' AS "check", count(*) AS bad FROM urm WHERE data = 0 UNION ALL SELECT 'repeated cells', count(*) - count(DISTINCT (user_id, item_id)) FROM urm
UNION ALL SELECT 'unknown items', count(*) FROM urm WHERE item_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'unknown users', count(*) FROM urm WHERE user_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'shared cells 0 1', count(*) FROM train JOIN test USING (user_id, item_id)""")
def consistency_checks(spark, d):
    return st.checks(urm(spark, d), items(spark, d), users(spark, d), list(parts(spark, d)))


@query(f"WITH {URM} SELECT user_id, sum(abs(data)) AS l1, round(sqrt(sum(data * data)), 6) AS l2, max(abs(data)) AS linf, min(abs(data)) AS lmin, arg_max(item_id, data * 100000 - item_id) AS best FROM urm GROUP BY 1")
def profile_norms(spark, d):
    return rounded(urm(spark, d).groupBy("user_id").agg(
        F.sum(F.abs("data")).alias("l1"), F.sqrt(F.sum(F.col("data") * F.col("data"))).alias("l2"), F.max(F.abs("data")).alias("linf"), F.min(F.abs("data")).alias("lmin"), F.max_by("item_id", F.col("data") * 100000 - F.col("item_id")).alias("best")), "l2")


# ---- splits and samples


@query(f"WITH {URM}{SPLIT} SELECT user_id, item_id, data, split FROM split")
def split_userwise(spark, d):
    return sp.holdout_user_wise(urm(spark, d))


@query(f"WITH {URM}, k AS (SELECT *, row_number() OVER (ORDER BY {HASH}, user_id, item_id) AS k FROM urm) SELECT user_id, item_id, data, CASE WHEN k <= (SELECT round_even(count(*) * 0.8, 0) FROM urm) THEN 'train' ELSE 'test' END AS split FROM k")
def split_global(spark, d):
    return sp.holdout_global(urm(spark, d))


@query(f"WITH {URM}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {HASH}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM urm) SELECT user_id, item_id, data, CASE WHEN r <= 2 THEN 'test' WHEN r <= 4 THEN 'validation' ELSE 'train' END AS split FROM k WHERE n >= 5")
def split_leave_k(spark, d):
    return sp.leave_k_out(urm(spark, d), 2)


@query(f"WITH {URM}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY data DESC, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM urm) SELECT user_id, item_id, data, CASE WHEN r <= 1 THEN 'test' ELSE 'train' END AS split FROM k WHERE n >= 2")
def split_leave_last(spark, d):
    return sp.leave_k_out(urm(spark, d), 1, validation=False, order=F.col("data").desc())


@query(f"WITH {URM}, k AS (SELECT item_id, row_number() OVER (ORDER BY (item_id * 104729 + 42) % 1000003, item_id) AS k FROM (SELECT DISTINCT item_id FROM urm)) SELECT user_id, urm.item_id, data, CASE WHEN k <= (SELECT round_even(count(*) * 0.8, 0) FROM k) THEN 'train' ELSE 'test' END AS split FROM urm JOIN k USING (item_id)")
def split_cold_items(spark, d):
    return sp.cold_items(urm(spark, d)).select("user_id", "item_id", "data", "split")


@query(f"WITH {URM}{SPLIT} SELECT split, count(*) AS cells, round(count(*) * 100.0 / (SELECT count(*) FROM split), 6) AS percent FROM split GROUP BY 1")
def split_quotas(spark, d):
    return rounded(sp.quotas(sp.holdout_user_wise(urm(spark, d))), "percent")


@query(f"WITH {URM}{SPLIT} SELECT count(*) AS shared FROM (SELECT user_id, item_id FROM train INTERSECT SELECT user_id, item_id FROM test)")
def split_disjoint(spark, d):
    return sp.overlap(*parts(spark, d))


@query(f"""WITH {URM}, items AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part), n AS (SELECT count(*) AS n FROM part),
t AS (SELECT user_id, item_id AS positive, d, ({HASH} * 31 + d * 15485863) % n AS idx FROM urm, n, (SELECT unnest(range(1, 6)) AS d)),
c AS (SELECT user_id, positive, d, items.item_id AS negative FROM t JOIN items USING (idx))
SELECT user_id, positive, arg_min(negative, d) AS negative FROM c WHERE NOT EXISTS (SELECT 1 FROM urm u WHERE u.user_id = c.user_id AND u.item_id = c.negative) GROUP BY 1, 2""")
def bpr_triples_hash(spark, d):
    dense = mx.dense_index(items(spark, d), "item_id")
    return sp.bpr_triples(urm(spark, d), dense)


# ---- weighting and similarities


@query(f"WITH {URM}, df AS (SELECT item_id, ln((SELECT count(*) FROM customer) / (1 + count(*))) AS idf FROM urm GROUP BY 1) SELECT user_id AS row, item_id AS col, round(sqrt(data) * idf, 6) AS data FROM urm JOIN df USING (item_id)")
def tfidf_urm(spark, d):
    return rounded(sm.tf_idf(cells(urm(spark, d)), count_of(users(spark, d))), "data")


WORDS_SQL = "words AS (SELECT doc_id AS row, w AS col, CAST(count(*) AS DOUBLE) AS data FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^a-zA-Z0-9]', ' ', 'g')), ' +')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)"


def doc_words(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.explode(tokens(F.col("text"))).alias("col")).groupBy("row", "col").agg(F.count("*").cast("double").alias("data"))


@query(f"WITH {WORDS_SQL}, df AS (SELECT col, ln((SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM words GROUP BY 1) SELECT row, col, round(sqrt(data) * idf, 6) AS data FROM words JOIN df USING (col)")
def tfidf_docs(spark, d):
    return rounded(sm.tf_idf(doc_words(spark, d), count_of(table(spark, d, "documents"))), "data")


@query(f"""WITH {URM}, n AS (SELECT count(*) AS n FROM customer), df AS (SELECT item_id, ln((SELECT n FROM n) / (1 + count(*))) AS idf FROM urm GROUP BY 1), len AS (SELECT user_id, sum(data) AS l FROM urm GROUP BY 1)
SELECT user_id AS row, item_id AS col, round(data * 2.2 / (1.2 * (0.25 + 0.75 * l / ((SELECT sum(data) FROM urm) / (SELECT n FROM n))) + data) * idf, 6) AS data FROM urm JOIN df USING (item_id) JOIN len USING (user_id)""")
def bm25_parts(spark, d):
    return rounded(sm.bm25(cells(urm(spark, d)), count_of(users(spark, d))), "data")


@query(f"WITH {URM}, {sim_sql(COSINE)}{OUT}")
def sim_cosine(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), shrink=100), "w")


@query(f"WITH {URM}, {sim_sql('d / 10')}{OUT}")
def sim_dot(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), shrink=10, normalize=False), "w")


@query(f"WITH {URM}, {sim_sql('d / (ni * nj + 10 + 1e-6)', data='data - avg(data) OVER (PARTITION BY user_id)')}{OUT}")
def sim_adjusted(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), "adjusted", 10), "w")


@query(f"WITH {URM}, {sim_sql('d / (ni * nj + 10 + 1e-6)', data='data - avg(data) OVER (PARTITION BY item_id)')}{OUT}")
def sim_pearson(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), "pearson", 10), "w")


@query(f"WITH {URM}, {sim_sql('d / (pow(nj + 1e-6, 0.6) * pow(ni + 1e-6, 1.4) + 100 + 1e-6)')}{OUT}")
def sim_asymmetric(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), "asymmetric", 100, asymmetric_alpha=0.3), "w")


COUNT = {"data": "CAST(1 AS DOUBLE)", "norm": "CAST(count(*) OVER (PARTITION BY col) AS DOUBLE)"}


@query(f"WITH {URM}, {sim_sql('d / (ni + nj - d + 5 + 1e-6)', **COUNT)}{OUT}")
def sim_jaccard(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), "jaccard", 5), "w")


@query(f"WITH {URM}, {sim_sql('d / (ni + nj + 5 + 1e-6)', **COUNT)}{OUT}")
def sim_dice(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), "dice", 5), "w")


@query(f"WITH {URM}, {sim_sql('d / (d + (nj - d) * 0.7 + (ni - d) * 1.3 + 5 + 1e-6)', **COUNT)}{OUT}")
def sim_tversky(spark, d):
    return rounded(sm.similarity(cells(urm(spark, d)), "tversky", 5, tversky_alpha=0.7, tversky_beta=1.3), "w")


@query(f"WITH {URM}, {sim_sql('d / (ni * nj + 100 + 1e-6)', product='a.data * b.data * (a.row % 3 + 1)')}{OUT}")
def sim_rowweighted(spark, d):
    weights = users(spark, d).select(F.col("user_id").alias("row"), (F.col("user_id") % 3 + 1).cast("double").alias("weight"))
    return rounded(sm.similarity(cells(urm(spark, d)), shrink=100, row_weights=weights), "w")


BRAND_SQL = f"WITH {URM}, b AS (SELECT user_id AS row, p_brand AS col, CAST(count(*) AS DOUBLE) AS data FROM urm JOIN part ON p_partkey = item_id GROUP BY 1, 2), n AS (SELECT col, sum(data * data) AS n FROM b GROUP BY 1), p AS (SELECT x.col AS i, y.col AS j, sum(x.data * y.data) AS d FROM b x JOIN b y USING (row) GROUP BY 1, 2), q AS (SELECT a.col AS i, c.col AS j, sqrt(greatest(0.0, a.n + c.n - 2 * coalesce(d, 0.0))) AS x FROM n a JOIN n c ON a.col <> c.col LEFT JOIN p ON p.i = a.col AND p.j = c.col)"


def _brands(spark, d):
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("col"))
    return urm(spark, d).join(brand, "item_id").groupBy(F.col("user_id").alias("row"), "col").agg(F.count("*").cast("double").alias("data"))


for _mode, _x in (("lin", "x"), ("exp", "exp(x / 100)"), ("log", "ln(x + 1)")):

    def _euclid(spark, d, mode=_mode):
        m = _brands(spark, d)
        m = m.withColumn("data", F.col("data") / 100) if mode == "exp" else m
        return rounded(sm.euclidean(m, mode, top_k=None), "w")

    _euclid.__name__ = f"sim_euclid_{_mode}"
    query(f"{BRAND_SQL} SELECT i, j, round(1 / ({_x} + 1e-9), 6) AS w FROM q")(_euclid)


ICM_SIM = sim_sql("d / (ni * nj + 2 + 1e-6)", "icm", "feature_id", "item_id", k=20, name="cbf")


@query(f"WITH {URM}, {ICM}, {sim_sql(COSINE, k=20)}, {ICM_SIM}, mix AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, w * 0.7 AS w FROM sim UNION ALL SELECT i, j, w * (1 - 0.7) FROM cbf) GROUP BY 1, 2 HAVING sum(w) <> 0) SELECT i, j, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(w, 9) DESC, i) AS r FROM mix) WHERE r <= 20")
def sim_hybrid(spark, d):
    a = sm.similarity(cells(urm(spark, d)), shrink=100, top_k=20)
    b = sm.similarity(icm(spark, d).select(F.col("feature_id").alias("row"), F.col("item_id").alias("col"), "data"), shrink=2, top_k=20)
    return rounded(sm.combine(a, b, 0.7, 20), "w")


@query(f"WITH {URM}, {ICM}, {sim_sql(COSINE, k=50)}, {ICM_SIM} SELECT i, j, round(cbf.w - sim.w, 6) AS delta FROM sim JOIN cbf USING (i, j)")
def sim_common_delta(spark, d):
    with scratch() as stay:
        b = stay(sm.similarity(icm(spark, d).select(F.col("feature_id").alias("row"), F.col("item_id").alias("col"), "data"), shrink=2, top_k=20, packed="j"))
    both = sm.similarity(cells(urm(spark, d)), shrink=100, beside=b)
    return rounded(both.select("i", "j", (F.col("v") - F.col("w")).alias("delta")), "delta")


# ---- models and recommendations


@query(f"WITH {URM}{SPLIT}, s AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1), {recs_sql('SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM train), s')}{RECS_OUT}")
def toppop(spark, d):
    return shown(rc.most_popular(parts(spark, d)[0]))


@query(f"""WITH {URM}, mu AS (SELECT avg(data) AS mu FROM urm), b AS (SELECT item_id, sum(data - mu) / (count(*) + 25) AS bias FROM urm, mu GROUP BY 1)
SELECT 'item' AS kind, item_id AS id, round(bias, 6) AS bias FROM b UNION ALL SELECT 'user', user_id, round(sum(data - mu - bias) / (count(*) + 10), 6) FROM urm JOIN b USING (item_id), mu GROUP BY 2""")
def global_effects(spark, d):
    i, u = rc.global_effects(urm(spark, d))
    return rounded(i.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "bias").union(u.select(F.lit("user"), "user_id", "bias")), "bias")


def itemknn(spark, d):
    train, _ = parts(spark, d)
    return train, rc.item_scores(train, sm.similarity(cells(train), shrink=100))


def below(features: DataFrame, m: DataFrame, column: str) -> DataFrame:
    """features with a number `row` in place of feature_id, below all values of a column of m."""
    names = checkpointed(mx.dense_index(features.select("feature_id").distinct(), "feature_id"))
    least = m.agg(F.coalesce(F.least(F.min(column), F.lit(0)), F.lit(0)).alias("least"))
    return features.join(names, "feature_id").crossJoin(F.broadcast(least)).withColumn("row", F.col("least") - 1 - F.col("idx"))


def itemknn_lists(spark, d, train: DataFrame) -> tuple[DataFrame, Packed, Packed]:
    """Lists from an item-item cosine model, the profiles by user and the weights by i."""
    profiles = pack(train, "user_id", "item_id")
    with scratch() as stay:
        w = stay(sm.similarity(profiles, shrink=100, packed=True))
    return rc.item_lists(profiles, w), profiles, w


KNN = f"WITH {URM}{SPLIT}, {sim_sql(COSINE, 'train')}"


@query(f"{KNN}, {recs_sql(ITEM_SCORES)}{RECS_OUT}")
def itemknn_cf(spark, d):
    return shown(itemknn_lists(spark, d, parts(spark, d)[0])[0])


@query(f"WITH {URM}{SPLIT}, {sim_sql(COSINE, 'train', 'item_id', 'user_id')}, {recs_sql('SELECT w.i AS user_id, t.item_id, sum(t.data * w.w) AS score FROM sim w JOIN train t ON t.user_id = w.j GROUP BY 1, 2')}{RECS_OUT}")
def userknn_cf(spark, d):
    train, _ = parts(spark, d)
    w = sm.similarity(pack(train, "item_id", "user_id"), shrink=100)
    return shown(rc.user_lists(pack(train, "user_id", "item_id"), w))


@query(f"WITH {URM}{SPLIT}, {ICM}, {sim_sql('d / (ni * nj + 2 + 1e-6)', 'icm', 'feature_id', 'item_id')}, {recs_sql(ITEM_SCORES)}{RECS_OUT}")
def itemknn_cbf(spark, d):
    train, _ = parts(spark, d)
    w = sm.similarity(icm(spark, d).select(F.col("feature_id").alias("row"), F.col("item_id").alias("col"), "data"), shrink=2)
    return shown(rc.item_lists(pack(train, "user_id", "item_id"), w))


@query(f"WITH {URM}{SPLIT}, {UCM}, {sim_sql('d / (ni * nj + 2 + 1e-6)', 'ucm', 'feature_id', 'user_id')}, {recs_sql('SELECT w.i AS user_id, t.item_id, sum(t.data * w.w) AS score FROM sim w JOIN train t ON t.user_id = w.j GROUP BY 1, 2')}{RECS_OUT}")
def userknn_cbf(spark, d):
    train, _ = parts(spark, d)
    w = sm.similarity(ucm(spark, d).select(F.col("feature_id").alias("row"), F.col("user_id").alias("col"), "data"), shrink=2)
    return shown(rc.recommend(rc.user_scores(train, w), train))


@query(f"WITH {URM}{SPLIT}, {ICM}, joint AS (SELECT CAST(user_id AS VARCHAR) AS f, item_id, data FROM train UNION ALL SELECT 'x' || feature_id, item_id, data * 5.0 FROM icm), {sim_sql(COSINE, 'joint', 'f', 'item_id')}, {recs_sql(ITEM_SCORES)}{RECS_OUT}")
def itemknn_cfcbf(spark, d):
    train, _ = parts(spark, d)
    own = train.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), "data")
    joint = own.union(below(icm(spark, d), train, "user_id").select("row", "item_id", F.col("data") * 5.0))
    with scratch() as stay:
        w = stay(sm.similarity(joint, shrink=100, packed=True))
    return shown(rc.item_lists(pack(train, "user_id", "item_id"), w))


def walk_sql(beta: float, normalise: bool) -> str:
    norm = "w / sum(w) OVER (PARTITION BY i)" if normalise else "w"
    return f"""c AS (SELECT user_id, item_id, data / sum(abs(data)) OVER (PARTITION BY user_id) AS pui, 1.0::DOUBLE / count(*) OVER (PARTITION BY item_id) AS piu, pow(count(*) OVER (PARTITION BY item_id), {-beta}) AS damp FROM train),
w0 AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.piu * b.pui) * max(b.damp) AS w FROM c a JOIN c b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2),
w1 AS (SELECT i, j, {norm} AS w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(w, 9) DESC, j) AS r FROM w0) WHERE r <= 50),
sim AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(w, 9) DESC, i) AS r FROM w1) WHERE r <= 50)"""


@query(f"WITH {URM}{SPLIT}, {walk_sql(0.0, False)} SELECT i, j, round(w, 6) AS w FROM sim")
def p3alpha(spark, d):
    return rounded(rc.graph_walk(parts(spark, d)[0], top_k=50), "w")


@query(f"WITH {URM}{SPLIT}, {walk_sql(0.6, True)} SELECT i, j, round(w, 6) AS w FROM sim")
def rp3beta(spark, d):
    return rounded(rc.graph_walk(parts(spark, d)[0], beta=0.6, normalise=True, top_k=50), "w")


@query(f"""{KNN}, knn AS ({ITEM_SCORES}), {walk_sql(0.0, False).replace('sim AS', 'p3 AS')}, walk AS (SELECT t.user_id, w.j AS item_id, sum(t.data * w.w) AS score FROM train t JOIN p3 w ON t.item_id = w.i GROUP BY 1, 2),
nk AS (SELECT max(s) AS n FROM (SELECT sum(abs(score)) AS s FROM knn GROUP BY item_id)), nw AS (SELECT max(s) AS n FROM (SELECT sum(abs(score)) AS s FROM walk GROUP BY item_id)),
both_ AS (SELECT user_id, item_id, sum(score) AS score FROM (SELECT user_id, item_id, score / n * 0.6 AS score FROM knn, nk UNION ALL SELECT user_id, item_id, score / n * (1 - 0.6) FROM walk, nw) GROUP BY 1, 2), {recs_sql('SELECT * FROM both_')}
SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(score, 9) AS score FROM recs""")
def score_hybrid_l1(spark, d):
    train, knn = itemknn(spark, d)
    walk = rc.item_scores(train, rc.graph_walk(train, top_k=50))
    norms = tuple(sm.matrix_norm(s.select(F.col("user_id").alias("i"), F.col("item_id").alias("j"), F.col("score").alias("w")), "1") for s in (knn, walk))
    out = rc.recommend(rc.combine_scores(knn, walk, 0.6, norms), train)
    return out.select("user_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"{KNN}, {recs_sql(ITEM_SCORES)} SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS items FROM recs GROUP BY 1")
def submission_rows(spark, d):
    return submission(itemknn_lists(spark, d, parts(spark, d)[0])[0])


@query(f"""WITH {URM}{SPLIT}, f AS (SELECT vec_id AS item_id, embedding FROM embeddings), p AS (SELECT user_id, data, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS p FROM train JOIN f USING (item_id))
SELECT user_id, CAST(p AS BIGINT) AS p, round(sum(data * x) / sqrt(count(*)), 4) AS x FROM p GROUP BY 1, 2""")
def asy_user_factors(spark, d):
    f = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double")).alias("factors"))
    out = rc.asymmetric_user_factors(parts(spark, d)[0], f)
    return out.select("user_id", F.posexplode("factors").alias("p", "x")).select("user_id", (F.col("p") + 1).cast("long").alias("p"), F.round("x", 4).alias("x"))


@query("""WITH c AS (SELECT label, list(embedding ORDER BY vec_id)[1] AS c FROM embeddings GROUP BY 1), s AS (SELECT label, vec_id, list_dot_product(embedding::DOUBLE[], c::DOUBLE[]) AS score FROM embeddings JOIN c USING (label))
SELECT label, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank BETWEEN 2 AND 4""")
def similar_tags(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    c = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    s = e.join(c, "label").select("label", "vec_id", dot(F.col("v"), F.col("c")).alias("score"))
    s = s.withColumn("rank", rank_in(["label"], F.round("score", 9).desc(), F.col("vec_id")).cast("long")).where("rank between 2 and 4")
    return rounded(s.select("label", "vec_id", "rank", "score"), "score")


# ---- evaluation

RECS = f"{KNN}, {recs_sql(ITEM_SCORES)}"
CUTS = "cuts AS (SELECT unnest([5, 10]) AS cutoff)"


def evaluated(spark, d):
    train, test = parts(spark, d)
    with scratch() as stay:
        recs = stay(checkpointed(itemknn_lists(spark, d, train)[0]))
    return recs, test, train


@query(f"""{RECS}, {CUTS}, sizes AS (SELECT user_id, count(*) AS t FROM test GROUP BY 1), hits AS (SELECT r.*, t.data AS value, CASE WHEN t.data IS NULL THEN 0 ELSE 1 END AS rel FROM recs r LEFT JOIN test t USING (user_id, item_id)),
line AS (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY rank) AS found FROM hits),
per AS (SELECT cutoff, user_id, count(*) AS l, sum(rel) AS h, sum(rel * found / rank) AS ap, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / rank) AS arhr, sum(CASE WHEN rel = 1 THEN (pow(2.0, value) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM line JOIN cuts ON rank <= cutoff GROUP BY 1, 2),
ideal AS (SELECT cutoff, user_id, sum((pow(2.0, data) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY data DESC, item_id) AS r FROM test) JOIN cuts ON r <= cutoff GROUP BY 1, 2),
u AS (SELECT c.cutoff, s.user_id, t, coalesce(l, 0) AS l, coalesce(h, 0) AS h, coalesce(ap, 0) AS ap, first, coalesce(arhr, 0) AS arhr, coalesce(dcg, 0) AS dcg, idcg FROM sizes s CROSS JOIN cuts c LEFT JOIN per p ON p.cutoff = c.cutoff AND p.user_id = s.user_id LEFT JOIN ideal i ON i.cutoff = c.cutoff AND i.user_id = s.user_id),
m AS (SELECT cutoff, avg(CASE WHEN l = 0 THEN 0 ELSE h / l END) AS precision, avg(CASE WHEN l = 0 THEN 0 ELSE h / least(l, t) END) AS precision_min_den, avg(h / t) AS recall, avg(CASE WHEN l = 0 THEN 0 ELSE ap / l END) AS map, avg(CASE WHEN l = 0 THEN 0 ELSE ap / least(l, t) END) AS map_min_den,
avg(coalesce(1.0 / first, 0)) AS mrr, avg(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END) AS ndcg, avg(CASE WHEN h > 0 THEN 1 ELSE 0 END) AS hit_rate, avg(arhr) AS arhr_all_hits, count(*) AS users FROM u GROUP BY 1)
SELECT CAST(cutoff AS INTEGER) AS cutoff, round(precision, 6) AS precision, round(precision_min_den, 6) AS precision_min_den, round(recall, 6) AS recall, round(map, 6) AS map, round(map_min_den, 6) AS map_min_den, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(hit_rate, 6) AS hit_rate, round(arhr_all_hits, 6) AS arhr_all_hits, users,
round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM m""")
def metrics_accuracy(spark, d):
    recs, test, _ = evaluated(spark, d)
    out = ev.accuracy(recs, test, [5, 10])
    return rounded(out, *[c for c in out.columns if c not in ("cutoff", "users")])


BEYOND = f"""{RECS}, {CUTS}, pop AS (SELECT item_id, count(*) AS p FROM train GROUP BY 1), dims AS (SELECT (SELECT sum(p) FROM pop) AS sum_p, (SELECT max(p) FROM pop) AS max_p, (SELECT count(*) FROM part) AS n_items, (SELECT count(*) FROM customer) AS n_users, (SELECT count(DISTINCT user_id) FROM test) AS e, (SELECT count(DISTINCT item_id) FROM test) AS gt),
listed AS (SELECT cutoff, r.user_id, r.item_id, p, CASE WHEN t.user_id IS NULL THEN 0 ELSE 1 END AS hit FROM recs r JOIN cuts ON rank <= cutoff LEFT JOIN pop USING (item_id) LEFT JOIN test t ON t.user_id = r.user_id AND t.item_id = r.item_id WHERE r.user_id IN (SELECT user_id FROM test)),
pu AS (SELECT cutoff, user_id, sum(coalesce(-log2(p / sum_p), 0) / n_items) AS novelty, avg(coalesce(p, 0) / max_p) AS pop, max(hit) AS hit FROM listed, dims GROUP BY 1, 2), bu AS (SELECT cutoff, sum(novelty) AS novelty, sum(pop) AS pop, count(*) AS u, sum(hit) AS uh FROM pu GROUP BY 1),
cnt AS (SELECT cutoff, item_id, count(*) AS c, max(hit) AS hit FROM listed GROUP BY 1, 2), wz AS (SELECT cu.cutoff, p_partkey AS item_id, coalesce(c, 0) AS c, coalesce(hit, 0) AS hit FROM part CROSS JOIN cuts cu LEFT JOIN cnt ON cnt.cutoff = cu.cutoff AND cnt.item_id = p_partkey),
rk AS (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY c, item_id) AS r, count(*) OVER (PARTITION BY cutoff) AS n, sum(c) OVER (PARTITION BY cutoff) AS s FROM wz),
bi AS (SELECT cutoff, sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS ci, sum(hit) AS cih, 2 * sum((n + 1 - r) / (n + 1) * c / s) AS gini, 1 - sum(c / s * c / s) AS herf, sum(CASE WHEN c > 0 THEN -c / s * log2(c / s) ELSE 0 END) AS ent, sum(c * c) AS sq FROM rk GROUP BY 1),
beyond AS (SELECT cutoff, novelty / e AS novelty, pop / e AS average_popularity, ci / n_items AS coverage_item, cih / n_items AS coverage_item_hit, gt / n_items AS items_in_gt, e / n_users AS users_in_gt, u / n_users AS coverage_user, uh / n_users AS coverage_user_hit, gini AS diversity_gini, herf AS diversity_herfindahl, ent AS shannon_entropy, 1 - ((sq - e * cutoff) / cutoff) / (e * e - e) AS diversity_mean_inter_list FROM bu JOIN bi USING (cutoff), dims)"""
BEYOND_NAMES = ["novelty", "average_popularity", "coverage_item", "coverage_item_hit", "items_in_gt", "users_in_gt", "coverage_user", "coverage_user_hit", "diversity_gini", "diversity_herfindahl", "shannon_entropy", "diversity_mean_inter_list"]


@query(f"{BEYOND} SELECT CAST(cutoff AS INTEGER) AS cutoff, {', '.join(f'round({n}, 6) AS {n}' for n in BEYOND_NAMES)} FROM beyond")
def metrics_beyond(spark, d):
    recs, test, train = evaluated(spark, d)
    return rounded(ev.beyond_accuracy(recs, test, train, items(spark, d), users(spark, d), [5, 10]), *BEYOND_NAMES)


RATIO_NAMES = ["novelty", "average_popularity", "diversity_gini", "diversity_herfindahl", "shannon_entropy"]


@query(f"""{BEYOND}, ru AS (SELECT user_id, sum(-log2(p / sum_p) / n_items) AS novelty, avg(p / max_p) AS pop FROM train JOIN pop USING (item_id), dims GROUP BY 1),
rr AS (SELECT coalesce(p, 0) AS p, row_number() OVER (ORDER BY coalesce(p, 0), p_partkey) AS r FROM part LEFT JOIN pop ON item_id = p_partkey),
ref AS (SELECT (SELECT sum(novelty) FROM ru) / max(n_users) AS novelty, (SELECT sum(pop) FROM ru) / max(n_users) AS average_popularity, 2 * sum((n_items + 1 - r) / (n_items + 1) * p / sum_p) AS diversity_gini, 1 - sum(p / sum_p * p / sum_p) AS diversity_herfindahl, sum(CASE WHEN p > 0 THEN -p / sum_p * log2(p / sum_p) ELSE 0 END) AS shannon_entropy FROM rr, dims)
SELECT CAST(cutoff AS INTEGER) AS cutoff, {', '.join(f'round(beyond.{n} / ref.{n}, 6) AS ratio_{n}' for n in RATIO_NAMES)} FROM beyond, ref""")
def metrics_ratio(spark, d):
    recs, test, train = evaluated(spark, d)
    out = ev.ratios(ev.beyond_accuracy(recs, test, train, items(spark, d), users(spark, d), [5, 10]), ev.train_reference(train, items(spark, d), users(spark, d)))
    return rounded(out, *[c for c in out.columns if c != "cutoff"])


@query(f"""{RECS}, l AS (SELECT user_id, count(*) AS l FROM recs GROUP BY 1), s AS (SELECT a.user_id, sum(coalesce(w.w, 0)) / max(l * (l - 1)) AS diversity FROM recs a JOIN l USING (user_id) JOIN recs b ON a.user_id = b.user_id AND a.item_id <> b.item_id LEFT JOIN sim w ON w.i = a.item_id AND w.j = b.item_id WHERE a.rank < l GROUP BY 1)
SELECT user_id, round(coalesce(diversity, 0), 6) AS diversity FROM l LEFT JOIN s USING (user_id)""")
def metric_list_diversity(spark, d):
    recs, _, w = itemknn_lists(spark, d, parts(spark, d)[0])
    return rounded(ev.list_diversity(checkpointed(recs), w, 10), "diversity")


@query(f"""{KNN}, dense AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part), n AS (SELECT count(*) AS n FROM part),
neg AS (SELECT DISTINCT user_id, dense.item_id FROM (SELECT user_id, (user_id * 7919 + dd * 15485863 + 42) % n AS idx FROM (SELECT DISTINCT user_id FROM urm), n, (SELECT unnest(range(1, 51)) AS dd)) JOIN dense USING (idx)),
neg2 AS (SELECT * FROM neg WHERE (user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM urm)), allowed AS (SELECT user_id, item_id FROM test UNION SELECT user_id, item_id FROM neg2), sc AS ({ITEM_SCORES}),
{recs_sql('SELECT sc.* FROM sc JOIN allowed USING (user_id, item_id)')}{RECS_OUT}""")
def negative_sample_eval(spark, d):
    train, scores = itemknn(spark, d)
    dense = mx.dense_index(items(spark, d), "item_id")
    negatives = sp.sample_negatives(urm(spark, d), dense, 50)
    return shown(rc.recommend(ev.restrict_to(scores, parts(spark, d)[1], negatives), train))


@query(f"""{RECS}, g0 AS (SELECT user_id, row_number() OVER (ORDER BY count(*), user_id) - 1 AS k FROM train GROUP BY 1), g AS (SELECT user_id, CAST(floor(k / (SELECT floor(count(*) / 20) FROM g0)) AS BIGINT) AS grp FROM g0),
h AS (SELECT user_id, rank, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS rel FROM recs r LEFT JOIN test t USING (user_id, item_id)), a AS (SELECT user_id, rank, rel, sum(rel) OVER (PARTITION BY user_id ORDER BY rank) AS f FROM h), p AS (SELECT user_id, sum(rel * f / rank) / count(*) AS ap FROM a GROUP BY 1)
SELECT grp, count(*) AS users, round(avg(coalesce(ap, 0)), 6) AS map FROM g JOIN (SELECT DISTINCT user_id FROM test) USING (user_id) LEFT JOIN p USING (user_id) WHERE grp < 20 GROUP BY 1""")
def user_groups_map(spark, d):
    recs, test, train = evaluated(spark, d)
    h = recs.join(test.select("user_id", "item_id", F.lit(1).alias("hit")), ["user_id", "item_id"], "left").withColumn("rel", F.coalesce("hit", F.lit(0)))
    h = h.withColumn("f", F.sum("rel").over(Window.partitionBy("user_id").orderBy("rank")))
    ap = h.groupBy("user_id").agg((F.sum(F.col("rel") * F.col("f") / F.col("rank")) / F.count("*")).alias("ap"))
    g = rc.user_groups(train).join(test.select("user_id").distinct(), "user_id").join(ap, "user_id", "left")
    return rounded(g.groupBy("grp").agg(F.count("*").alias("users"), F.avg(F.coalesce("ap", F.lit(0.0))).alias("map")), "map")


@query(f"""{RECS}, pop AS (SELECT item_id, CAST(count(*) AS DOUBLE) AS p FROM train GROUP BY 1), len AS (SELECT user_id, count(*) AS n FROM train GROUP BY 1)
SELECT r.user_id, r.item_id, CAST(rank AS BIGINT) AS rank, CAST(CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS label, coalesce(p, 0.0) AS popularity, coalesce(n, 0) AS profile_length FROM recs r LEFT JOIN test t ON t.user_id = r.user_id AND t.item_id = r.item_id LEFT JOIN pop ON pop.item_id = r.item_id LEFT JOIN len ON len.user_id = r.user_id""")
def rerank_feature_table(spark, d):
    recs, test, train = evaluated(spark, d)
    return rc.rerank_table(recs, test, rc.top_pop(train), train).withColumn("rank", F.col("rank").cast("long"))


# ---- scalar functions


@query("""SELECT event_id, round(1 + 40 * ln(1 + value / 0.5), 6) AS confidence, round(1 / (1 + exp(value / 10)), 6) AS gradient, round_even(value, 0) AS whole,
round(CASE WHEN value >= 60 THEN value / 60 ELSE value END, 6) AS amount, CASE WHEN value >= 60 THEN 'minutes' ELSE 'seconds' END AS unit FROM events WHERE value < 3600 AND value >= 0""")
def scalar_functions(spark, d):
    e = table(spark, d, "events").where("value < 3600 and value >= 0")
    unit = biggest_unit(F.col("value"))
    return e.select("event_id", F.round(confidence(F.col("value"), "log", 40.0, 0.5), 6).alias("confidence"), F.round(1 / (1 + F.exp(F.col("value") / 10)), 6).alias("gradient"), F.bround("value").alias("whole"), F.round(unit["value"], 6).alias("amount"), unit["unit"].alias("unit"))


@query(r"""SELECT p_partkey AS item_id, CAST(nullif(regexp_extract(p_name || ' (' || (1950 + p_size) || ')', '\(([0-9]{4})\)$', 1), '') AS INTEGER) AS year, array_to_string(list_distinct(regexp_split_to_array(lower(regexp_replace(p_name, '[^a-zA-Z0-9]', ' ', 'g')), ' +')), ' ') IS NOT NULL AS has_words FROM part""")
def title_features(spark, d):
    p = table(spark, d, "part").withColumn("title", F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")")))
    return p.select(F.col("p_partkey").alias("item_id"), release_year(F.col("title")).alias("year"), F.array_join(tokens(F.col("p_name")), " ").isNotNull().alias("has_words"))


@query("SELECT p_partkey AS item_id, 'p_brand_' || p_brand AS feature_id, CAST(1 AS DOUBLE) AS data FROM part UNION ALL SELECT p_partkey, 'p_type_' || p_type, 1.0 FROM part UNION ALL SELECT p_partkey, 'p_size_' || p_size, 1.0 FROM part")
def item_features(spark, d):
    return icm(spark, d)


# ---- models without an SQL twin (tested against dense controls)


@query()
def ease_r(spark, d):
    train, _ = parts(spark, d)
    from ..operators.factor import ease_r as fit

    return shown(rc.recommend(rc.item_scores(train, fit(train, 500.0, 100)), train))


@query()
def pure_svd(spark, d):
    from ..operators.factor import pure_svd as fit

    train, _ = parts(spark, d)
    u, i = fit(train, 20)
    return shown(rc.recommend(rc.factor_top(u, i, 10, train), train))


@query()
def ials(spark, d):
    from ..operators.factor import ials as fit

    profiles = packed_train(spark, d)
    u, i = fit(profiles, 10, 3)
    return shown(rc.recommend(rc.factor_top(u, i, 10, profiles)))


@query()
def nmf(spark, d):
    from ..operators.factor import nmf as fit

    profiles = packed_train(spark, d)
    u, i = fit(profiles, 8, 5)
    return shown(rc.recommend(rc.factor_top(u, i, 10, profiles)))


@query()
def slim_elasticnet(spark, d):
    from ..operators.factor import slim_elastic_net

    train, _ = parts(spark, d)
    return rounded(slim_elastic_net(train, 0.1, 0.5, top_k=50), "w")


@query()
def cfw_d(spark, d):
    from ..operators.factor import cfw_d as fit

    train, _ = parts(spark, d)
    cf = sm.similarity(cells(train), shrink=100, top_k=20)
    return rounded(fit(cf, icm(spark, d), damp=1.0, top_k=20)[1], "w")


@query(_core_sql(12, 20))
def kcore_fixpoint(spark, d):
    return mx.k_core(urm(spark, d), 20).select("user_id", "item_id", "data")


@query()
def bpr_factors(spark, d):
    from ..operators.factor import bpr_factors as fit

    with scratch() as stay:
        triples = stay(sp.packed_triples(packed_train(spark, d), mx.dense_index(items(spark, d), "item_id")))
    u, _ = fit(triples, 6)
    remove(triples.folder)
    return u.select("user_id", F.transform("factors", lambda x: F.round(x, 6)).alias("factors"))
