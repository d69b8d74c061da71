"""Mixing sources to target weights by temperature, with DataFrame operations only.

Source i holds T_i tokens and the share p_i. Its weight is p_i ** a over the sum of all; a = 1 leaves the shares, a = 0 makes them equal.
The exponent is bisected: either to the least a in [0, 1] at which no source is read more often than `max_repeats`, or to
the a at which the entropy of the weights reaches `target_entropy` (a share of the greatest possible). The weights times
the budget are each source's quota.

A quota is realised by passes over the source. Each pass is a permutation of blocks of documents by a hash of seed and pass, and in a block of
its documents; full passes take everything, the last one takes whole blocks while they fit and of the next block documents
while their tokens begin before the quota ends. Blocks hold about `block_tokens` tokens, so a source with a third
of all rows is many blocks; running sums go over the blocks of a source and over the documents of one block only.

Documents without a word take no part, and neither do sources without tokens. A null source is a source of its own. Rows
that share an id are dealt alike; rows without an id are dealt by their text. Sources with as many tokens have one weight, so the
bisection sees the different token counts only. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

SEED = 20240229
BLOCK_TOKENS = 1 << 20
MAX_REPEATS = 1.25
STEPS = 60


def _hash(*parts: object) -> F.Column:
    """A number below 2^60 from the md5 of the parts joined by ':'."""
    cols = [p if not isinstance(p, (int, str)) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary")), 1, 15), 16, 10).cast("long")


def weights(sources: DataFrame, budget: F.Column, max_repeats: float | None, target_entropy: float | None) -> DataFrame:
    """sources (source, tokens) with exponent, weight and quota; the bisection is one expression over the array of token counts."""
    one = sources.groupBy("tokens").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("tokens", "n"))).alias("s"), F.sum(F.col("tokens") * F.col("n")).alias("total"), F.sum("n").alias("sources"))
    one = one.withColumn("budget", budget).withColumn("x", F.transform("s", lambda r: F.struct(F.log(r["tokens"] / F.col("total")).alias("x"), r["n"].alias("n"))))

    def norm(a):
        return F.aggregate("x", F.lit(0.0), lambda t, r: t + F.exp(a * r["x"]) * r["n"])

    if target_entropy is None:
        # the least source is read most often: weight * budget / tokens falls as a rises
        def high(a):
            least = F.try_element_at("x", F.lit(1))["x"]
            return F.exp(a * least) / norm(a) * F.col("budget") / F.try_element_at("s", F.lit(1))["tokens"] > F.lit(float(max_repeats))
    else:
        # entropy = ln(norm) - a * mean of x under the weights; it falls as a rises
        def high(a):
            mean = F.aggregate("x", F.lit(0.0), lambda t, r: t + F.exp(a * r["x"]) * r["x"] * r["n"]) / norm(a)
            return F.log(norm(a)) - a * mean > F.lit(float(target_entropy)) * F.log(F.col("sources").cast("double"))

    step = lambda t, _: F.struct(F.when(high((t["lo"] + t["hi"]) / 2), (t["lo"] + t["hi"]) / 2).otherwise(t["lo"]).alias("lo"), F.when(high((t["lo"] + t["hi"]) / 2), t["hi"]).otherwise((t["lo"] + t["hi"]) / 2).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step)
    one = one.withColumn("exponent", F.round(F.when(high(F.lit(0.0)), found["hi"]).otherwise(F.lit(0.0)), 9)).withColumn("norm", norm(F.col("exponent")))
    # one row
    rows = sources.crossJoin(F.broadcast(one.select("exponent", "norm", "budget", "total")))
    rows = rows.select("exponent", "source", "tokens", (F.exp(F.col("exponent") * F.log(F.col("tokens") / F.col("total"))) / F.col("norm")).alias("weight"), "budget")
    return rows.withColumn("quota", F.floor(F.col("weight") * F.col("budget")).cast("long"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_share: float = 1.0,
    max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED,
) -> DataFrame:
    """(id, source, n_tokens, pass, block_rank, rank) of every document reading; the order of training is pass, block_rank, rank in a source."""
    number = F.col(id_col).cast("long")
    rows = docs.select(
        number.alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"),
        F.when(number.isNull(), F.md5(F.col(text_col).cast("string").cast("binary"))).alias("sign"),
    )
    rows = keep(rows.where("n_tokens > 0"), "tokens")
    key = F.coalesce(F.col("id").cast("string"), F.col("sign"))
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = keep(weights(sources, F.col("total") * F.lit(float(budget_share)), max_repeats, target_entropy), "weights")
    plan = plan.withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long")).withColumnRenamed("source", "s")
    dealt = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).withColumn("block", F.pmod(_hash(seed, key), F.col("blocks")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("tokens").alias("tokens"), F.first("quota").alias("quota"))
    passes = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("tokens")).cast("long") - 1))
    blocks = blocks.withColumn("pass", F.explode(passes)).withColumn("key", _hash(seed, F.col("pass"), F.coalesce("source", F.lit("")), F.col("block")))
    line = Window.partitionBy("source", "pass").orderBy("key", "block")
    blocks = blocks.withColumn("block_rank", F.row_number().over(line)).withColumn("before", F.sum("block_tokens").over(line) - F.col("block_tokens"))
    blocks = blocks.withColumn("room", F.col("quota") - F.col("pass") * F.col("tokens") - F.col("before")).where("room > 0")
    blocks = keep(blocks.select(F.col("source").alias("s"), F.col("block").alias("k"), "pass", "block_rank", "room", (F.col("room") >= F.col("block_tokens")).alias("whole")), "blocks")
    cut = dealt.select("id", "sign", "source", "n_tokens", "block").join(blocks, dealt["source"].eqNullSafe(blocks["s"]) & (dealt["block"] == blocks["k"]))
    inner = Window.partitionBy("s", "k", "pass").orderBy("own", "id", "sign", "n_tokens")
    out = cut.withColumn("own", _hash(seed, F.col("pass"), key)).withColumn("rank", F.row_number().over(inner)).withColumn("start", F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    return out.where("whole or start < room").select(F.col("id").alias(id_col), "source", "n_tokens", F.col("pass").cast("long").alias("pass"), F.col("block_rank").cast("long").alias("block_rank"), F.col("rank").cast("long").alias("rank"))


def oracle(seed: int = SEED, block_tokens: int = BLOCK_TOKENS, max_repeats: float = MAX_REPEATS) -> str:
    """DuckDB SQL of mix() over `documents` with its other parameters as they are."""
    h = lambda *p: "('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + ")), 1, 15))::BIGINT"
    high = f"exp(m.a * (SELECT min(x) FROM src)) / (SELECT sum(exp(m.a * x)) FROM src) * (SELECT sum(tokens) FROM src) / (SELECT min(tokens) FROM src) > {max_repeats}"
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(text)) AS sign, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
used AS (SELECT * FROM rows WHERE n_tokens > 0),
src AS (SELECT source, sum(n_tokens)::BIGINT AS tokens, ln(sum(n_tokens) / (SELECT sum(n_tokens) FROM used)) AS x FROM used GROUP BY source),
bis AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN up THEN a ELSE lo END, CASE WHEN up THEN hi ELSE a END
  FROM (SELECT m.*, {high} AS up FROM (SELECT k, lo, hi, (lo + hi) / 2 AS a FROM bis WHERE k < {STEPS}) m) q),
ex AS (
  SELECT round(CASE WHEN {high} THEN (SELECT hi FROM bis WHERE k = {STEPS}) ELSE 0.0 END, 9) AS e FROM (SELECT 0.0::DOUBLE AS a) m),
plan AS (
  SELECT source, tokens, CAST(floor(exp(e * x) / (SELECT sum(exp(e * x)) FROM src, ex) * (SELECT sum(tokens) FROM src)) AS BIGINT) AS quota,
         CAST(ceil(tokens / {float(block_tokens)}) AS BIGINT) AS blocks FROM src, ex),
dealt AS (
  SELECT u.*, p.tokens, p.quota, {h(f"'{seed}'", "u.sign")} % p.blocks AS block
  FROM used u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source),
blk AS (SELECT source, block, sum(n_tokens)::BIGINT AS bt, min(tokens) AS tokens, min(quota) AS quota FROM dealt GROUP BY source, block),
passes AS (SELECT b.*, unnest(range(0, greatest(1, CAST(ceil(quota / tokens::DOUBLE) AS BIGINT)))) AS pass FROM blk b),
keyed AS (SELECT *, {h(f"'{seed}'", "pass::VARCHAR", "coalesce(source, '')", "block::VARCHAR")} AS key FROM passes),
ranked AS (
  SELECT *, row_number() OVER w AS block_rank, quota - pass * tokens - (sum(bt) OVER (PARTITION BY source, pass ORDER BY key, block ROWS UNBOUNDED PRECEDING) - bt) AS room
  FROM keyed WINDOW w AS (PARTITION BY source, pass ORDER BY key, block)),
cut AS (
  SELECT d.doc_id, d.sign, d.source, d.n_tokens, r.pass, r.block_rank, r.room, r.bt, r.block, {h(f"'{seed}'", "r.pass::VARCHAR", "d.sign")} AS own
  FROM dealt d JOIN ranked r ON d.source IS NOT DISTINCT FROM r.source AND d.block = r.block WHERE r.room > 0),
line AS (
  SELECT *, row_number() OVER (PARTITION BY source, block, pass ORDER BY own, doc_id, sign, n_tokens) AS rank,
         sum(n_tokens) OVER (PARTITION BY source, block, pass ORDER BY own, doc_id, sign, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start
  FROM cut)
SELECT doc_id, source, n_tokens, CAST(pass AS BIGINT) AS pass, CAST(block_rank AS BIGINT) AS block_rank, CAST(rank AS BIGINT) AS rank FROM line WHERE room >= bt OR start < room
"""
