"""Further registered queries: weighting, samplers, candidate lists and split checks, each with plain SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import confidence
from ..operators import matrix as mx
from ..operators import recommend as rc
from ..operators import similarity as sm
from ..operators import split as sp
from ..operators import statistics as st
from ..operators.packed import Mixed, pack
from ..sources import readers, store
from ..sources.store import checkpointed, run_folder
from . import queries as q
from .queries import COSINE, HASH, ICM, ITEM_SCORES, KNN, RECS_OUT, SPLIT, UCM, URM, query, recs_sql, rounded, shown, sim_sql

DENSE = "dense AS (SELECT p_partkey AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM part), n AS (SELECT count(*) AS n FROM part)"
CELLS = "cells AS (SELECT *, row_number() OVER (ORDER BY user_id, item_id) - 1 AS idx FROM urm)"
DRAWS = 500
DRAWN = f"drawn AS (SELECT d, user_id, item_id, data FROM (SELECT d, (d * 15485863 + 42 * 7919) % (SELECT count(*) FROM urm) AS idx FROM (SELECT unnest(range(1, {DRAWS + 1})) AS d)) JOIN cells USING (idx))"


def _dense(spark, d):
    return mx.dense_index(q.items(spark, d), "item_id")


# ---- weighting


def _weighted(kind: str, by: str) -> str:
    """CTE `train` replaced by weighted profiles; documents are the `by` side."""
    other = "user_id" if by == "item_id" else "item_id"
    n = f"(SELECT count(*) FROM {'part' if by == 'item_id' else 'customer'})"
    df = f"wdf AS (SELECT {other}, ln({n} / (1 + count(*))) AS idf FROM train GROUP BY 1), wlen AS (SELECT {by}, sum(data) AS l FROM train GROUP BY 1)"
    value = "sqrt(data) * idf" if kind == "TF-IDF" else f"data * 2.2 / (1.2 * (0.25 + 0.75 * l / ((SELECT sum(data) FROM train) / {n})) + data) * idf"
    return f"{df}, weighted AS (SELECT user_id, item_id, {value} AS data FROM train JOIN wdf USING ({other}) JOIN wlen USING ({by}))"


W_SCORES = "SELECT t.user_id, w.j AS item_id, sum(t.data * w.w) AS score FROM weighted t JOIN sim w ON t.item_id = w.i GROUP BY 1, 2"


def _weighted_knn(spark, d, kind):
    train, _ = q.parts(spark, d)
    profiles = pack(checkpointed(sm.weighted_profiles(train, kind, q.count_of(q.items(spark, d)))), "user_id", "item_id")
    return shown(rc.item_lists(profiles, sm.similarity(profiles, shrink=100)))


@query(f"WITH {URM}{SPLIT}, {_weighted('TF-IDF', 'item_id')}, {sim_sql(COSINE, 'weighted')}, {recs_sql(W_SCORES)}{RECS_OUT}")
def itemknn_cf_tfidf(spark, d):
    return _weighted_knn(spark, d, "TF-IDF")


@query(f"WITH {URM}{SPLIT}, {_weighted('BM25', 'item_id')}, {sim_sql(COSINE, 'weighted')}, {recs_sql(W_SCORES)}{RECS_OUT}")
def itemknn_cf_bm25(spark, d):
    return _weighted_knn(spark, d, "BM25")


@query(f"WITH {ICM}, t AS (SELECT feature_id AS col, ln((SELECT count(*) FROM part) / count(*)) AS idf FROM icm GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY round(idf, 9) DESC, col) AS h, row_number() OVER (ORDER BY round(idf, 9), col) AS l FROM t) SELECT 'highest' AS \"end\", h AS rank, col, round(idf, 6) AS idf FROM r WHERE h <= 10 UNION ALL SELECT 'lowest', l, col, round(idf, 6) FROM r WHERE l <= 10")
def extreme_idf_features(spark, d):
    m = q.icm(spark, d).select(F.col("item_id").alias("row"), F.col("feature_id").alias("col"), "data")
    return rounded(sm.extreme_features(m, q.count_of(q.items(spark, d)), 10), "idf")


@query(f"WITH {URM} SELECT user_id, item_id, round(data / sum(abs(data)) OVER (PARTITION BY user_id), 6) AS l1, round(data / sqrt(sum(data * data) OVER (PARTITION BY item_id)), 6) AS l2 FROM urm")
def normalised_profiles(spark, d):
    m = q.urm(spark, d)
    one = sm.normalise(m, "user_id", "1").withColumnRenamed("data", "l1")
    two = sm.normalise(m, "item_id", "2").withColumnRenamed("data", "l2")
    return rounded(one.join(two, ["user_id", "item_id"]), "l1", "l2")


@query(f"WITH {URM}, pop AS (SELECT item_id, count(*) AS p FROM urm GROUP BY 1) SELECT user_id, urm.item_id, round(1 + 2 * data, 6) AS linear, round(ln(p), 6) AS popularity FROM urm JOIN pop USING (item_id)")
def confidence_forms(spark, d):
    m = q.urm(spark, d)
    pop = m.groupBy("item_id").agg(F.count("*").alias("p"))
    return m.join(pop, "item_id").select("user_id", "item_id", F.round(confidence(F.col("data"), "linear", 2.0), 6).alias("linear"), F.round(confidence(F.col("p"), "popularity"), 6).alias("popularity"))


@query(f"WITH {ICM}, w AS (SELECT feature_id, ln((SELECT count(*) FROM part) / (1 + count(*))) - 4 AS weight FROM icm GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY -round(abs(weight), 9), feature_id) - 1 AS k FROM w) SELECT feature_id, round(weight, 6) AS weight FROM r WHERE k < floor(0.4 * (SELECT count(*) FROM w))")
def selected_features(spark, d):
    m = q.icm(spark, d).select(F.col("item_id").alias("row"), F.col("feature_id").alias("col"), "data")
    weights = sm.idf(m, q.count_of(q.items(spark, d))).select(F.col("col").alias("feature_id"), (F.col("idf") - 4).alias("weight"))
    return rounded(sm.select_features(weights, 0.4, absolute=True), "weight")


@query(f"WITH {ICM}, l AS (SELECT item_id, list(feature_id) AS f FROM icm GROUP BY 1) SELECT a.item_id AS i, b.item_id AS j, array_to_string(list_sort(list_intersect(a.f, b.f)), ' ') AS common, array_to_string(list_sort(list_distinct(list_concat(a.f, b.f))), ' ') AS either FROM l a JOIN l b ON b.item_id = a.item_id + 1")
def item_pair_features(spark, d):
    i = q.items(spark, d)
    pairs = i.select(F.col("item_id").alias("i"), (F.col("item_id") + 1).alias("j")).join(i.select(F.col("item_id").alias("j")), "j", "left_semi")
    out = sm.shared_features(q.icm(spark, d), pairs)
    return out.select("i", "j", F.array_join("common", " ").alias("common"), F.array_join("either", " ").alias("either"))


# ---- samplers and splits


@query(f"WITH {URM} SELECT user_id, item_id, data, CASE WHEN {HASH} < 800002 THEN 'train' ELSE 'test' END AS split FROM urm")
def split_bernoulli(spark, d):
    return sp.bernoulli(q.urm(spark, d), 0.8)


@query(f"WITH {URM}, {CELLS}, {DRAWN} SELECT d, user_id, item_id, data FROM drawn")
def sample_interactions(spark, d):
    return sp.sample_interactions(q.urm(spark, d), DRAWS)


@query(f"""WITH {URM}, {DENSE}, {CELLS}, {DRAWN}, o AS (SELECT d, user_id, drawn.item_id AS positive, t, ({HASH} * 31 + d * 104729 + t * 15485863) % n AS idx FROM drawn, n, (SELECT unnest(range(1, 6)) AS t)),
c AS (SELECT d, user_id, positive, t, dense.item_id AS negative FROM o JOIN dense USING (idx))
SELECT d, user_id, positive, arg_min(negative, t) AS negative FROM c WHERE NOT EXISTS (SELECT 1 FROM urm u WHERE u.user_id = c.user_id AND u.item_id = c.negative) GROUP BY 1, 2, 3""")
def sample_pairs(spark, d):
    return sp.sample_pairs(q.urm(spark, d), _dense(spark, d), DRAWS)


NEGATIVE = "neg AS (SELECT DISTINCT user_id, dense.item_id FROM (SELECT user_id, (user_id * 7919 + dd * 15485863 + 42) % n AS idx FROM (SELECT DISTINCT user_id FROM {m}), n, (SELECT unnest(range(1, {k} + 1)) AS dd)) JOIN dense USING (idx)), neg2 AS (SELECT * FROM neg WHERE NOT EXISTS (SELECT 1 FROM {m} m WHERE m.user_id = neg.user_id AND m.item_id = neg.item_id))"


@query(f"WITH {URM}, {DENSE}, {NEGATIVE.format(m='urm', k=10)} SELECT user_id, item_id, data FROM urm UNION ALL SELECT user_id, item_id, 0.0 FROM neg2")
def sample_ratings(spark, d):
    return sp.sample_ratings(q.urm(spark, d), _dense(spark, d), 10)


@query(f"""WITH {URM}{SPLIT}, {DENSE}, {NEGATIVE.format(m='train', k=8)}, inside AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {HASH}, item_id) AS k FROM test)
SELECT 'inside' AS mode, user_id, item_id FROM inside WHERE k <= 3 UNION ALL SELECT 'outside', user_id, item_id FROM neg2 WHERE NOT EXISTS (SELECT 1 FROM urm u WHERE u.user_id = neg2.user_id AND u.item_id = neg2.item_id)""")
def impression_negatives(spark, d):
    train, _ = q.parts(spark, d)
    shown_items, dense = q.urm(spark, d).select("user_id", "item_id"), _dense(spark, d)
    one = sp.impression_negatives(train, shown_items, dense, 3).select(F.lit("inside").alias("mode"), "user_id", "item_id")
    return one.unionByName(sp.impression_negatives(train, shown_items, dense, 8, "outside").select(F.lit("outside").alias("mode"), "user_id", "item_id"))


@query(f"""WITH {URM}{SPLIT}, n AS (SELECT split, count(*) AS cells FROM split GROUP BY 1), w AS (SELECT 'train' AS split, 80.0::DOUBLE AS wanted UNION ALL SELECT 'test', 20.0 UNION ALL SELECT 'validation', 10.0),
p AS (SELECT w.split, coalesce(cells, 0) AS cells, coalesce(cells, 0) * 100.0 / (SELECT count(*) FROM urm) AS percent, wanted FROM w LEFT JOIN n USING (split))
SELECT split, cells, round(percent, 6) AS percent, wanted, cells > 0 AND abs(percent - wanted) <= wanted * 0.2 AS in_quota, CASE WHEN split = 'test' THEN (SELECT count(DISTINCT user_id) FROM test WHERE user_id NOT IN (SELECT user_id FROM train)) ELSE 0 END AS cold_users FROM p""")
def split_report(spark, d):
    m = q.urm(spark, d)
    return rounded(st.split_report(m, sp.holdout_user_wise(m), {"train": 80.0, "test": 20.0, "validation": 10.0}), "percent")


@query("""WITH seen AS (SELECT CAST(user_id AS VARCHAR) AS original_id, min(event_id) AS p FROM events WHERE event_type = 'purchase' GROUP BY 1), m AS (SELECT original_id, row_number() OVER (ORDER BY p, original_id) - 1 AS idx FROM seen)
SELECT 'repeated indices' AS "check", CAST(0 AS BIGINT) AS bad UNION ALL SELECT 'repeated ids', 0 UNION ALL SELECT 'gaps', 0 UNION ALL SELECT 'unmapped cells', (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT idx FROM m))""")
def mapper_checks(spark, d):
    e = q.table(spark, d, "events")
    mapper = mx.id_mapper([(e.where("event_type = 'purchase'"), "user_id", "event_id")])
    return st.mapper_checks(e.select(F.col("user_id").alias("row")), mapper, "row")


# ---- models and lists


@query(f"""WITH {URM}{SPLIT}, {DENSE}, cnt AS (SELECT user_id, count(*) AS c FROM train GROUP BY 1), t AS (SELECT user_id, unnest(range(1, c + 21)) AS d FROM cnt),
o AS (SELECT user_id, dense.item_id, min(d) AS d FROM (SELECT user_id, d, (user_id * 7919 + d * 15485863 + 42) % n AS idx FROM t, n) JOIN dense USING (idx) GROUP BY 1, 2),
r AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY d) AS rank FROM o WHERE NOT EXISTS (SELECT 1 FROM train x WHERE x.user_id = o.user_id AND x.item_id = o.item_id)) SELECT * FROM r WHERE rank <= 10""")
def random_lists(spark, d):
    return rc.random_lists(q.parts(spark, d)[0], _dense(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {URM}{SPLIT}, {UCM}, joint AS (SELECT CAST(item_id AS VARCHAR) AS f, user_id, data FROM train UNION ALL SELECT 'x' || feature_id, user_id, data * 3.0 FROM ucm), {sim_sql(COSINE, 'joint', 'f', 'user_id')}, {recs_sql('SELECT w.i AS user_id, t.item_id, sum(t.data * w.w) AS score FROM sim w JOIN train t ON t.user_id = w.j GROUP BY 1, 2')}{RECS_OUT}")
def userknn_cfcbf(spark, d):
    train, _ = q.parts(spark, d)
    own = train.select(F.col("item_id").alias("row"), F.col("user_id").alias("col"), "data")
    joint = own.union(q.below(q.ucm(spark, d), train, "item_id").select("row", "user_id", F.col("data") * 3.0))
    with store.scratch() as stay:
        w = stay(sm.similarity(joint, shrink=100, packed=True))
    return shown(rc.user_lists(pack(train, "user_id", "item_id"), w))


@query(f"{KNN}, {recs_sql(ITEM_SCORES.replace('FROM train t', 'FROM test t'), 'test')}{RECS_OUT}")
def replaced_profiles(spark, d):
    train, test = q.parts(spark, d)
    return shown(rc.recommend(rc.item_scores(test, sm.similarity(q.cells(train), shrink=100)), test))


POP = "pops AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM train), (SELECT item_id, count(*) AS score FROM train GROUP BY 1)) s WHERE NOT EXISTS (SELECT 1 FROM train x WHERE x.user_id = s.user_id AND x.item_id = s.item_id))"


@query(f"{KNN}, {recs_sql(ITEM_SCORES)}, {POP} SELECT user_id, item_id, count(*) AS sources FROM (SELECT user_id, item_id FROM recs UNION ALL SELECT user_id, item_id FROM pops WHERE rank <= 10) GROUP BY 1, 2")
def candidate_pool(spark, d):
    train, _ = q.parts(spark, d)
    lists = checkpointed(q.itemknn_lists(spark, d, train)[0])
    return rc.candidate_pool(lists, rc.most_popular(train))


@query(f"WITH {URM}{SPLIT}, {POP} SELECT user_id, item_id, rank FROM pops WHERE rank <= least(5, (SELECT count(*) FROM region) - 1)")
def capped_lists(spark, d):
    train, _ = q.parts(spark, d)
    regions = q.table(spark, d, "region").select("r_regionkey")
    return rc.capped(rc.most_popular(train), regions, 5).select("user_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS user_id, b.vec_id AS item_id, list_dot_product(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT user_id, item_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM s) WHERE rank <= 10""")
def factor_top_blocks(spark, d):
    e = q.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("factors"))
    users, own = e.withColumnRenamed("vec_id", "user_id"), e.select(F.col("vec_id").alias("user_id"), F.col("vec_id").alias("item_id"))
    return shown(rc.recommend(rc.factor_top(users, e.withColumnRenamed("vec_id", "item_id"), 10, own, block=100), own))


def _norm_sql(kind: str) -> str:
    norms = {"2": "SELECT sqrt(sum(score * score)) AS n FROM {t}", "inf": "SELECT max(s) AS n FROM (SELECT sum(abs(score)) AS s FROM {t} GROUP BY user_id)"}[kind]
    return f"""{KNN}, knn AS ({ITEM_SCORES}), {q.walk_sql(0.0, False).replace('sim AS', 'p3 AS')}, walk AS (SELECT t.user_id, w.j AS item_id, sum(t.data * w.w) AS score FROM train t JOIN p3 w ON t.item_id = w.i GROUP BY 1, 2),
nk AS ({norms.format(t='knn')}), nw AS ({norms.format(t='walk')}),
both_ AS (SELECT user_id, item_id, sum(score) AS score FROM (SELECT user_id, item_id, score / n * 0.6 AS score FROM knn, nk UNION ALL SELECT user_id, item_id, score / n * (1 - 0.6) FROM walk, nw) GROUP BY 1, 2), {recs_sql('SELECT * FROM both_')}
SELECT user_id, item_id, CAST(rank AS BIGINT) AS rank, round(score, 9) AS score FROM recs"""


@query(_norm_sql("inf"))
def score_hybrid_linf(spark, d):
    profiles = q.packed_train(spark, d)
    with store.scratch() as stay:
        walk = stay(rc.packed_walk(profiles, top_k=50))
        weights = [stay(sm.similarity(profiles, shrink=100, packed=True)), walk]
    norms = [rc.largest_row_sum(profiles, w) for w in weights]
    out = rc.item_lists(profiles, Mixed([(w, a / n if n else 0.0) for w, a, n in zip(weights, (0.6, 1 - 0.6), norms)]))
    return out.select("user_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


# ---- trainers


TRIPLES = f"""t5 AS (SELECT user_id, item_id AS positive, d, ({HASH} * 31 + d * 15485863) % n AS idx FROM train, n, (SELECT unnest(range(1, 6)) AS d)),
c5 AS (SELECT user_id, positive, d, dense.item_id AS negative FROM t5 JOIN dense USING (idx)),
triple AS (SELECT user_id, positive, arg_min(negative, d) AS negative FROM c5 WHERE NOT EXISTS (SELECT 1 FROM train u WHERE u.user_id = c5.user_id AND u.item_id = c5.negative) GROUP BY 1, 2)"""


@query(f"""WITH {URM}{SPLIT}, {DENSE}, {TRIPLES}, touched AS (SELECT triple.*, x.item_id AS l FROM triple JOIN train x USING (user_id)),
sides AS (SELECT user_id, positive, negative, l, positive AS j, 1.0::DOUBLE AS side FROM touched WHERE l <> positive UNION ALL SELECT user_id, positive, negative, l, negative, -1.0 FROM touched WHERE l <> negative),
w1 AS (SELECT l, j, 0.1 * avg(0.5 * side) AS w FROM sides GROUP BY 1, 2),
x AS (SELECT user_id, positive, negative, sum(side * w) AS x FROM sides JOIN w1 USING (l, j) GROUP BY 1, 2, 3),
m2 AS (SELECT l, j, avg(side / (1 + exp(x))) AS m, avg(CASE WHEN side > 0 THEN 0.0025 ELSE 0.00025 END) AS r FROM sides JOIN x USING (user_id, positive, negative) GROUP BY 1, 2),
w2 AS (SELECT l AS i, j, w + 0.1 * (m - r * w) AS w FROM m2 JOIN w1 USING (l, j)),
k AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY round(w, 9) DESC, i) AS r FROM w2 WHERE w <> 0)
SELECT i, j, round(w, 6) AS w FROM k WHERE r <= 30""")
def slim_bpr(spark, d):
    from ..operators.trainers import slim_bpr as fit

    with store.scratch() as stay:
        profiles = stay(q.packed_train(spark, d))
        triples = stay(sp.packed_triples(profiles, _dense(spark, d)))
    out = fit(triples, profiles, epochs=2, rate=0.1, top_k=30)
    store.remove(triples.folder)
    return rounded(out, "w")


@query(f"""WITH {URM}{SPLIT}, g AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.data * b.data) / (SELECT count(DISTINCT user_id) FROM train) AS g FROM train a JOIN train b USING (user_id) GROUP BY 1, 2),
s AS (SELECT sqrt(sum(g * g)) AS size FROM g), k AS (SELECT i, j, 0.5 / size * g AS w, row_number() OVER (PARTITION BY j ORDER BY round(0.5 / size * g, 9) DESC, i) AS r FROM g, s WHERE i <> j)
SELECT i, j, round(w, 6) AS w FROM k WHERE r <= 30""")
def slim_mse_first_step(spark, d):
    from ..operators.trainers import slim_mse as fit

    return rounded(fit(q.parts(spark, d)[0], epochs=1, rate=0.5, top_k=30), "w")


@query()
def mf_mse(spark, d):
    from ..operators.trainers import mf_mse as fit

    train, _ = q.parts(spark, d)
    u, i, _ = fit(train, 8, 3, rate=0.01)
    return shown(rc.recommend(rc.factor_top(u, i, 10, train), train))


@query()
def asy_svd(spark, d):
    from ..operators.trainers import asy_svd as fit

    own, items = fit(q.parts(spark, d)[0], 6, 2, rate=0.001)
    return own.select("item_id", F.transform("factors", lambda x: F.round(x, 6)).alias("factors"))


# ---- files: tables are written in each layout and read back


def _folder(spark) -> str:
    return f"{run_folder(spark)}/files-{uuid.uuid4().hex}"


def _lines(spark, rows, sep: str, columns: list, header: bool = False) -> str:
    path = _folder(spark)
    text = rows.select(F.concat_ws(sep, *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]).alias("value"))
    if header:
        rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{k}") for k, c in enumerate(columns)]).write.option("header", True).option("sep", sep).csv(path)
    else:
        text.write.text(path)
    return path


for _layout in readers.LAYOUTS:

    def _read(spark, d, layout=_layout):
        sep, header = readers.LAYOUTS[layout]
        more = [F.lit(1), F.lit(2)] if layout == "hetrec" else []
        path = _lines(spark, q.table(spark, d, "events"), sep, ["user_id", "event_id", "value", F.unix_timestamp("ts"), *more], header)
        return readers.ratings(spark, path, layout)

    _read.__name__ = f"read_ratings_{_layout}"
    _ts = "CAST(NULL AS BIGINT)" if _layout == "hetrec" else "CAST(floor(epoch(ts)) AS BIGINT)"
    query(f"SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS item_id, value AS data, {_ts} AS ts FROM events")(_read)


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS item_id, value AS data, t AS ts FROM (SELECT *, floor(epoch(ts)) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(epoch(ts)) DESC, value DESC) AS k FROM events) WHERE k = 1")
def read_interactions_latest(spark, d):
    path = _lines(spark, q.table(spark, d, "events"), ";", ["user_id", "event_type", "value", F.unix_timestamp("ts")])
    return readers.interactions(spark, path, ";", timestamp=True, dedup=True)


@query("""WITH t AS (SELECT p_partkey AS k, p_type AS a, p_brand AS b, p_size AS s FROM part)
SELECT 'genre' AS kind, CAST(k AS VARCHAR) AS item_id, a AS feature_id, CAST(1 AS DOUBLE) AS data FROM t UNION ALL SELECT 'genre', CAST(k AS VARCHAR), b, 1.0 FROM t
UNION ALL SELECT 'year', CAST(k AS VARCHAR), CAST(1950 + s AS VARCHAR), 1.0 FROM t WHERE s % 5 > 0""")
def read_movies(spark, d):
    title = F.when(F.col("p_size") % 5 > 0, F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))).otherwise(F.col("p_name"))
    path = _lines(spark, q.table(spark, d, "part"), "::", ["p_partkey", title, F.concat_ws("|", "p_type", "p_brand")])
    genres, years = readers.movies(spark, path, "1m")
    return genres.withColumn("kind", F.lit("genre")).unionByName(years.withColumn("kind", F.lit("year"))).select("kind", "item_id", "feature_id", "data")


@query("""WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS u, c_mktsegment AS g, CAST(c_nationkey AS VARCHAR) AS a FROM customer)
SELECT u AS user_id, 'gender_' || g AS feature_id, CAST(1 AS DOUBLE) AS data FROM t UNION ALL SELECT u, 'age_group_' || a, 1.0 FROM t UNION ALL SELECT u, 'occupation_7', 1.0 FROM t UNION ALL SELECT u, 'zip_code_z' || a, 1.0 FROM t""")
def read_users(spark, d):
    path = _lines(spark, q.table(spark, d, "customer"), "::", ["c_custkey", "c_mktsegment", "c_nationkey", F.lit("7"), F.concat(F.lit("z"), F.col("c_nationkey").cast("string"))])
    return readers.users(spark, path)


@query(f"WITH {URM}{SPLIT} SELECT user_id, item_id, data, split FROM split")
def stored_split(spark, d):
    m, path = q.urm(spark, d), _folder(spark)
    train, test = q.parts(spark, d)
    store.save(spark, path, {"name": "orders", "quota": 0.8, "urm": m, "parts": {"train": train, "test": test}})
    found = store.load(spark, path)
    parts = found["parts"]
    return parts["train"].withColumn("split", F.lit("train")).unionByName(parts["test"].withColumn("split", F.lit("test"))).where(F.lit(found["quota"]) == 0.8)


@query(f"{KNN}, {recs_sql(ITEM_SCORES)}{RECS_OUT}")
def stored_model(spark, d):
    train, _ = q.parts(spark, d)
    model = store.cached(spark, _folder(spark), lambda: {"weights": sm.similarity(q.cells(train), shrink=100), "profiles": train, "shrink": 100})
    return shown(rc.recommend(rc.item_scores(model["profiles"], model["weights"]), model["profiles"]))
