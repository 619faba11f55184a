"""Registered queries: the operators over the driver's tables, each with its SQL where SQL can express it.

Events stand for frames (user: camera, ts: time, value: measure), orders and lineitems for albums and subjects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions import times as D
from ..operators import clusters, evaluate, identity, keeper, lineage, linkage, moments, mutations, registry, sequence, views, votes
from ..session import ship
from . import stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GAP = 10_800.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


def frames(t) -> DataFrame:
    e = t("events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("job_id"), F.concat(F.lit("/shoot/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"), F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"), F.col("user_id").cast("string").alias("camera"), D.wall_seconds(F.col("ts")).alias("taken_at"), (F.col("event_id") % 97).alias("burst_key"), F.when(F.col("event_id") % 50 == 0, 1).alias("copy_of"), F.col("event_type").alias("lens"), (F.col("event_id") % 7 * 100).alias("iso"), F.col("value").alias("rating"), F.expr("case when value >= 60 then 'sharp' when value < 20 then 'blurred' else 'soft' end").alias("rating_verdict"), F.expr("case when event_id % 11 = 0 then event_id % 6 end").alias("stars"), F.expr("case when event_id % 13 = 0 then 1 end").alias("rejected"), F.expr("case when event_id % 17 = 0 then 1 end").alias("picked"), F.expr("case when event_id % 5 = 0 then 1 end").alias("burst_pick"), F.lit(None).cast("double").alias("sharpness"))


FRAMES = """frames AS (SELECT event_id AS id, user_id % 20 AS job_id, '/shoot/' || event_id || '.jpg' AS path, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
  CAST(user_id AS VARCHAR) AS camera, epoch_us(ts) / 1e6 AS taken_at, event_id % 97 AS burst_key, CASE WHEN event_id % 50 = 0 THEN 1 END AS copy_of, event_type AS lens, event_id % 7 * 100 AS iso, value AS rating,
  CASE WHEN value >= 60 THEN 'sharp' WHEN value < 20 THEN 'blurred' ELSE 'soft' END AS rating_verdict, CASE WHEN event_id % 11 = 0 THEN event_id % 6 END AS stars, CASE WHEN event_id % 13 = 0 THEN 1 END AS rejected,
  CASE WHEN event_id % 17 = 0 THEN 1 END AS picked, CASE WHEN event_id % 5 = 0 THEN 1 END AS burst_pick FROM events)"""


def subjects(t) -> DataFrame:
    li = t("lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), F.when(F.col("l_linenumber") % 3 == 0, "person").alias("region_type"), (F.col("l_quantity") / 50).alias("rating"), F.expr("case when l_linenumber = 2 then cast(l_quantity as int) % 6 end").alias("stars"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey").cast("string")).alias("number"))


SUBJECTS = """subjects AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, CASE WHEN l_linenumber % 3 = 0 THEN 'person' END AS region_type, l_quantity / 50 AS rating,
  CASE WHEN l_linenumber = 2 THEN CAST(trunc(l_quantity) AS INT) % 6 END AS stars, CASE WHEN l_returnflag <> 'N' THEN CAST(l_partkey AS VARCHAR) END AS number FROM lineitem)"""
SESSIONS = f"""s AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS taken, ts FROM events),
marked AS (SELECT *, CASE WHEN taken - lag(taken) OVER (PARTITION BY user_id ORDER BY taken, event_id) > {GAP} THEN 1 ELSE 0 END AS new FROM s),
sessions AS (SELECT event_id, user_id, taken, sum(new) OVER (PARTITION BY user_id ORDER BY taken, event_id) AS session FROM marked)"""


def sessions(t) -> DataFrame:
    e = t("events").select("event_id", "user_id", D.wall_seconds(F.col("ts")).alias("taken"))
    return sequence.sessionise(e, "user_id", "taken", "event_id", GAP)


@query(f"WITH {SESSIONS} SELECT event_id, user_id, CAST(session AS BIGINT) AS session, CAST(dense_rank() OVER (ORDER BY user_id, session) AS BIGINT) AS burst FROM sessions")
def w2_sessionise(t) -> DataFrame:
    return sequence.number_sessions(sessions(t), "user_id").select("event_id", "user_id", "session", "burst")


@query(f"WITH {SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, min(taken) AS started, max(taken) AS ended, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY taken, event_id) AS frames, count(*) AS n FROM sessions GROUP BY user_id, session")
def w3_bursts(t) -> DataFrame:
    return sequence.bursts(sessions(t), ["user_id", "session"], "taken", "event_id").withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


@query()
def w4_merge_bursts(t) -> DataFrame:
    ends = sequence.bursts(sessions(t), ["user_id", "session"], "taken", "event_id").select("user_id", F.col("session").alias("burst"), "started", "ended", "n")
    return sequence.merge_bursts(ends, "user_id", F.abs(F.col("a.n") - F.col("b.n")) <= 2, span=6 * GAP, gap=3 * GAP)


@query()
def w8_sets(t) -> DataFrame:
    rows = t("lineitem").select((F.col("l_suppkey") % 50).alias("camera"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86_400e6 + F.col("l_linenumber") / 10).alias("taken"), (F.col("l_quantity") / 10).alias("ev"), F.col("l_extendedprice").alias("focus"), F.lit(50.0).alias("focal"))
    return sequence.sets(rows)


@query("SELECT event_id, event_type, pr FROM (SELECT event_id, event_type, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS pr FROM events) WHERE pr >= 0.8")
def w1_percent_rank(t) -> DataFrame:
    return evaluate.percent_ranks(t("events").select("event_id", "event_type", "value"), "event_type", "value", "pr").where("pr >= 0.8D").select("event_id", "event_type", "pr")


@query("WITH f AS (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY k) AS INT) AS dense FROM orders JOIN f USING (o_orderpriority)")
def w7_renumber(t) -> DataFrame:
    return sequence.renumber(t("orders"), "o_orderpriority", ["o_orderkey"]).select("o_orderkey", "dense")


def _candidates(t) -> DataFrame:
    return t("events").select("user_id", F.col("event_id").alias("frame"), F.col("event_id").alias("row"), (F.col("value") / 100).alias("score"), (F.col("event_id") % 4).alias("by_hand"), (F.col("event_id") % 89 / 89).alias("area"), (F.col("event_id") % 3).alias("cut_sides"), (F.col("event_id") % 53 / 53).alias("sharpness"), (F.col("event_id") % 10 / 10).alias("tile"))


CANDIDATES = "c AS (SELECT user_id, event_id AS frame, event_id AS row, value / 100 AS score, event_id % 4 AS by_hand, event_id % 89 / 89 AS area, event_id % 3 AS cut_sides, event_id % 53 / 53 AS sharpness, event_id % 10 / 10 AS tile FROM events)"


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY by_hand DESC, CAST(score >= 0.728 AS INT) DESC, floor(score / 0.03) DESC, -cut_sides DESC, area DESC, sharpness DESC, frame, row) AS n
  FROM c WHERE by_hand >= 3 OR score >= 0.728) SELECT c.user_id, c.row, CASE WHEN r.n = 1 THEN 1 END AS picked FROM c LEFT JOIN r USING (row)""")
def w12_keeper(t) -> DataFrame:
    return keeper.pick_keepers(_candidates(t), ["user_id"], "frame", "row").select("user_id", "row", "picked")


@query(f"WITH {CANDIDATES} SELECT row, CASE WHEN tile < 0.7 * max(tile) OVER (PARTITION BY user_id) AND tile < 0.55 AND area >= 0.02 THEN 0 ELSE 1 END AS soft FROM c")
def w13_soft_flag(t) -> DataFrame:
    return keeper.with_soft_flag(_candidates(t), ["user_id"]).select("row", "soft")


@query(f"WITH {CANDIDATES} SELECT row, user_id FROM (SELECT *, min(cut_sides) OVER (PARTITION BY user_id) AS b FROM c) WHERE b = cut_sides")
def w15_primary_region(t) -> DataFrame:
    return keeper.primary_region(_candidates(t), "user_id", "cut_sides").select("row", "user_id")


@query(f"WITH {CANDIDATES}, p AS (SELECT *, CASE WHEN by_hand = 3 THEN 1 END AS picked, CASE WHEN cut_sides > 0 THEN cut_sides END AS grp FROM c) SELECT row, CASE WHEN max(CASE WHEN picked = 1 AND grp IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AND grp IS NULL THEN NULL ELSE picked END AS picked FROM p")
def w16_drop_spare_picks(t) -> DataFrame:
    rows = _candidates(t).withColumn("picked", F.expr("case when by_hand = 3 then 1 end")).withColumn("grp", F.expr("case when cut_sides > 0 then cut_sides end"))
    return keeper.drop_spare_picks(rows, "user_id", "grp").select("row", "picked")


@query(f"WITH {CANDIDATES} SELECT row, CAST(n AS INT) AS rank FROM (SELECT row, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN by_hand = 3 THEN 1 ELSE 0 END DESC, score DESC, frame) AS n FROM c) WHERE n <= 3")
def w17_top3(t) -> DataFrame:
    return keeper.top_ranks(_candidates(t), ["user_id"], [F.desc("score"), F.col("frame")], F.col("by_hand") == 3).select("row", "rank")


@query(f"WITH {CANDIDATES} SELECT user_id, arg_max(row, n) AS lead FROM (SELECT *, -row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN by_hand = 3 THEN 1 ELSE 0 END DESC, CASE WHEN cut_sides = 2 THEN 1 ELSE 0 END, by_hand * 10 + score * 5 DESC, row) AS n FROM c) GROUP BY user_id")
def w18_stack_lead(t) -> DataFrame:
    rows = _candidates(t).select("user_id", "row", F.col("by_hand").alias("stars"), F.col("score").alias("rating"), (F.col("by_hand") == 3).alias("keeper"), (F.col("cut_sides") == 2).alias("rejected"))
    return keeper.stack_lead(rows, "user_id", "row")


@query("""SELECT user_id, event_id, round(value - avg(value) OVER w + 1e-9, 3) AS value_centred, CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1) / (count(*) OVER w - 1) ELSE 0 END AS value_rank,
  CASE WHEN count(*) OVER w > 1 THEN (row_number() OVER o - 1) / (count(*) OVER w - 1) ELSE 0 END AS position, row_number() OVER o = 1 AS is_first, row_number() OVER o = count(*) OVER w AS is_last, ln(count(*) OVER w) AS log_size
  FROM events WINDOW w AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY event_id)""")
def w19_relative_features(t) -> DataFrame:
    rows = t("events").select("user_id", "event_id", "value")
    return sequence.relative_features(rows, ["user_id"], "value", ["event_id"]).drop("value").withColumn("value_centred", F.round(F.col("value_centred") + 1e-9, 3))


@query()
def w20_rate(t) -> DataFrame:
    e = t("events").select("event_id", "user_id", D.wall_seconds(F.col("ts")).alias("at"))
    total = e.withColumn("total", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id")))
    return sequence.sliding_rate(total, "user_id", "at", "total", 86_400).select("event_id", "rate")


@query("WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, CAST(ceil(count(*) OVER (PARTITION BY user_id) / 8.0) AS BIGINT) AS step FROM events) SELECT event_id, user_id FROM n WHERE place % step = 0 AND place / step < 8")
def w21_spread_sample(t) -> DataFrame:
    return sequence.spread_sample(t("events"), ["user_id"], ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def a1_counts(t) -> DataFrame:
    return stats.counts(t("events"), F.col("event_type"))


@query("SELECT p_brand, mode AS p_size, n FROM (SELECT p_brand, p_size AS mode, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY p_brand, p_size) WHERE k = 1")
def a3_mode(t) -> DataFrame:
    return votes.mode(t("part"), ["p_brand"], "p_size").withColumnRenamed("mode", "p_size")


@query("SELECT user_id, count(*) FILTER (WHERE value >= 50) AS high, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def a4_conditional_counts(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.count_if(F.col("value") >= 50).alias("high"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT count(*) AS pairs FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)")
def a6_distinct_pairs(t) -> DataFrame:
    return t("lineitem").agg(F.count_distinct("l_suppkey", "l_returnflag").alias("pairs"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0)")
def a7_complete_groups(t) -> DataFrame:
    whole = t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n")).where("n = 0")
    return t("orders").join(whole, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query(f"WITH {SESSIONS}, e AS (SELECT max(taken) - min(taken) AS span FROM sessions GROUP BY user_id, session HAVING count(*) >= 2) SELECT count(*) AS bursts, round(sum(span), 1) AS total, round(avg(span), 2) AS mean, round(max(span), 1) AS longest FROM e")
def a10_spans(t) -> DataFrame:
    return stats.spans(sessions(t), ["user_id", "session"], "taken")


@query(f"WITH {SUBJECTS}, b AS (SELECT image_id, max(stars) AS s FROM subjects GROUP BY 1) SELECT coalesce(CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_orderkey % 6 AS INT) END, s, 0) AS stars, count(*) AS n FROM orders LEFT JOIN b ON image_id = o_orderkey GROUP BY 1")
def a11_star_histogram(t) -> DataFrame:
    own = t("orders").select(F.col("o_orderkey").alias("id"), F.expr("case when o_orderkey % 9 = 0 then cast(o_orderkey % 6 as int) end").alias("stars"))
    return stats.star_histogram(own, subjects(t).select("image_id", "stars"))


@query("SELECT l_orderkey, bool_or(l_quantity > 45) AS any_large, bool_and(l_quantity > 5) AS all_over FROM lineitem GROUP BY l_orderkey")
def a12_boolean_folds(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("any_large"), F.bool_and(F.col("l_quantity") > 5).alias("all_over"))


@query(f"WITH {FRAMES} SELECT job_id, count(*) FILTER (WHERE rating_verdict = 'blurred') AS blurred, count(*) FILTER (WHERE rating_verdict = 'soft') AS soft, count(*) FILTER (WHERE rating_verdict = 'sharp') AS sharp FROM frames GROUP BY job_id")
def a13_verdict_pivot(t) -> DataFrame:
    return stats.verdict_counts(frames(t), ["job_id"], "rating_verdict")


@query("""WITH o AS (SELECT o_custkey AS id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, 0 AS failed FROM orders GROUP BY 1), s AS (SELECT o_custkey AS id, count(*) AS subjects, count(*) FILTER (WHERE l_returnflag <> 'N') AS numbers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
  SELECT c_custkey AS id, coalesce(total, 0) AS total, coalesce(done, 0) AS done, 0 AS failed, coalesce(subjects, 0) AS subjects, coalesce(numbers, 0) AS numbers FROM customer LEFT JOIN o ON o.id = c_custkey LEFT JOIN s ON s.id = c_custkey""")
def a15_job_list(t) -> DataFrame:
    images = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"))
    return stats.job_list(t("customer").select(F.col("c_custkey").alias("id")), images, subjects(t).select("image_id", "number"))


@query("SELECT o_custkey, CASE WHEN count(*) > 0 THEN CAST((count(*) FILTER (WHERE o_orderstatus = 'F') * 100 + count(*) // 2) // count(*) AS BIGINT) END AS pct FROM orders GROUP BY o_custkey")
def a16_match_percent(t) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(evaluate.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("pct"))


SHOOT = f"""{FRAMES}, {SUBJECTS}, seen AS (SELECT * FROM frames WHERE status = 'done' AND coalesce(copy_of, 0) = 0),
per AS (SELECT image_id, count(*) AS k FROM subjects WHERE coalesce(region_type, 'vehicle') = 'vehicle' GROUP BY 1),
kept AS (SELECT job_id, count(*) AS keepers FROM seen f WHERE picked = 1 OR (burst_pick = 1 AND coalesce(picked, 0) <> 1 AND NOT EXISTS (SELECT 1 FROM seen h WHERE h.job_id = f.job_id AND h.burst_key = f.burst_key AND h.picked = 1)) GROUP BY job_id),
wide AS (SELECT job_id, count(*) AS frames, count(*) FILTER (WHERE k > 0) AS with_subject, CAST(coalesce(sum(k), 0) AS BIGINT) AS subjects, count(DISTINCT burst_key) AS bursts, count(DISTINCT camera) AS cameras, min(taken_at) AS first_taken, max(taken_at) AS last_taken,
  count(*) FILTER (WHERE rejected = 1) AS rejected, count(*) FILTER (WHERE burst_pick = 1) AS engine_picks, count(*) FILTER (WHERE rating_verdict = 'blurred') AS blurred, count(*) FILTER (WHERE rating_verdict = 'soft') AS soft, count(*) FILTER (WHERE rating_verdict = 'sharp') AS sharp
  FROM seen LEFT JOIN per ON image_id = id GROUP BY job_id),
lens AS (SELECT job_id, lens AS common_lens FROM (SELECT job_id, lens, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, lens) AS n FROM seen GROUP BY job_id, lens) WHERE n = 1),
isos AS (SELECT job_id, iso AS common_iso FROM (SELECT job_id, iso, row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, iso) AS n FROM seen GROUP BY job_id, iso) WHERE n = 1),
shoot AS (SELECT wide.*, common_lens, common_iso, coalesce(keepers, 0) AS keepers FROM wide JOIN lens USING (job_id) JOIN isos USING (job_id) LEFT JOIN kept USING (job_id))"""


@query(f"WITH {SHOOT} SELECT * FROM shoot")
def a17_shoot_stats(t) -> DataFrame:
    return stats.shoot_stats(frames(t), subjects(t))


@query(f"""WITH {SHOOT} SELECT count(*) AS albums, CAST(sum(frames) AS BIGINT) AS frames, CAST(sum(with_subject) AS BIGINT) AS with_subject, CAST(sum(subjects) AS BIGINT) AS subjects, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(engine_picks) AS BIGINT) AS engine_picks,
  CAST(sum(blurred) AS BIGINT) AS blurred, CAST(sum(soft) AS BIGINT) AS soft, CAST(sum(sharp) AS BIGINT) AS sharp, CAST(sum(keepers) AS BIGINT) AS keepers, min(first_taken) AS first_taken, max(last_taken) AS last_taken, (SELECT count(*) FROM (SELECT DISTINCT job_id, burst_key FROM seen)) AS bursts FROM shoot""")
def a18_global_stats(t) -> DataFrame:
    return stats.global_stats(frames(t), subjects(t))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def a20_label_counts(t) -> DataFrame:
    return t("labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


RANKED = """ranked AS (SELECT {g} AS g, lower({v}) AS f, count(*) AS n, min({s}) AS first, arg_min({v}, {s}) AS v FROM {t} WHERE {v} IS NOT NULL GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY g) AS total FROM ranked)"""


@query("WITH " + RANKED.format(g="user_id", v="event_type", s="event_id", t="events") + " SELECT g AS user_id, v AS winner, n AS votes, n / total AS share FROM placed WHERE k = 1")
def a21_vote(t) -> DataFrame:
    return votes.vote(t("events"), "user_id", F.col("event_type"), "event_id")


@query("""WITH pr AS (SELECT p_size, lower(p_brand || chr(31) || p_type) AS f, count(*) AS n, min(p_partkey) AS first, arg_min(p_brand, p_partkey) AS make, arg_min(p_type, p_partkey) AS model FROM part GROUP BY 1, 2),
  b AS (SELECT *, sum(n) OVER (PARTITION BY p_size) AS total, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, first) AS k FROM pr), said AS (SELECT p_size, string_agg(DISTINCT make || ' ' || model, '|' ORDER BY make || ' ' || model) AS said FROM pr GROUP BY 1),
  mk AS (SELECT p_size, lower(p_brand) AS f, count(*) AS n, min(p_partkey) AS first, arg_min(p_brand, p_partkey) AS make FROM part GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, first) AS k FROM mk)
  SELECT b.p_size, CASE WHEN b.n / b.total >= 0.5 THEN b.make WHEN m.n / b.total >= 0.6 THEN m.make END AS make, CASE WHEN b.n / b.total >= 0.5 THEN b.model END AS model, CASE WHEN b.n / b.total < 0.5 AND m.n / b.total >= 0.6 THEN m.n / b.total ELSE b.n / b.total END AS agreement,
  CASE WHEN b.n / b.total >= 0.5 THEN '' ELSE said END AS disputed FROM b JOIN m ON b.p_size = m.p_size AND b.k = 1 AND m.k = 1 JOIN said ON said.p_size = b.p_size""")
def a22_pair_vote(t) -> DataFrame:
    return votes.pair_vote(t("part"), "p_size", "p_brand", "p_type", "p_partkey").withColumn("disputed", F.array_join("disputed", "|"))


@query("""WITH c AS (SELECT p_brand, (p_partkey * 37) % 256 AS r, (p_partkey * 59) % 256 AS g, (p_partkey * 83) % 256 AS b, p_partkey % 7 = 0 AS cut FROM part),
  m AS (SELECT p_brand, list_sort(list(r)) AS r, list_sort(list(g) FILTER (WHERE NOT cut)) AS g, list_sort(list(b) FILTER (WHERE NOT cut)) AS b FROM c GROUP BY p_brand)
  SELECT p_brand, format('#{:02x}{:02x}{:02x}', r[len(r) // 2 + 1], g[len(g) // 2 + 1], b[len(b) // 2 + 1]) AS colour FROM m""")
def a24_median_colour(t) -> DataFrame:
    part = t("part").select("p_brand", F.when(F.col("p_partkey") % 7 == 0, F.format_string("#%02xzz", F.col("p_partkey") * 37 % 256)).otherwise(F.format_string("#%02x%02x%02x", F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 59 % 256, F.col("p_partkey") * 83 % 256)).alias("colour"))
    return votes.median_colour(part, "p_brand", "colour")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value > 0) WHERE n = 1")
def a25_best_by_confidence(t) -> DataFrame:
    return votes.best_by_confidence(t("events"), "user_id", "event_type", "value", "event_id")


@query("WITH " + RANKED.format(g="user_id", v="event_type", s="event_id", t="events") + " SELECT g AS user_id, CASE WHEN count(*) FILTER (WHERE n = top) = 1 THEN arg_max(v, n) END AS winner FROM (SELECT *, max(n) OVER (PARTITION BY g) AS top FROM placed) GROUP BY g")
def a28_plurality(t) -> DataFrame:
    return votes.plurality(t("events"), "user_id", F.col("event_type"), "event_id")


@query("SELECT p_type AS facet, count(*) AS n, arg_min(p_name, p_partkey) AS label, CASE WHEN count(DISTINCT p_brand) > 1 THEN arg_min(p_brand, p_partkey) || ' +' || (count(DISTINCT p_brand) - 1) ELSE arg_min(p_brand, p_partkey) END AS owners FROM part GROUP BY p_type")
def a29_facets(t) -> DataFrame:
    return votes.facets(t("part"), F.col("p_type"), F.col("p_name"), "p_brand", "p_partkey")


@query("WITH c AS (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1), w AS (SELECT sum(n) AS whole, max(n) AS most FROM c) SELECT value, n, CAST(round(100 * n / whole) AS BIGINT) AS share, n / most AS bar FROM c, w ORDER BY n DESC, value LIMIT 3")
def a32_shares(t) -> DataFrame:
    return stats.shares(stats.counts(t("events"), F.col("event_type")), "value", 3)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3_unlabelled(t) -> DataFrame:
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti")


@query(f"WITH {FRAMES} SELECT id, job_id FROM frames f WHERE picked = 1 OR (burst_pick = 1 AND coalesce(picked, 0) <> 1 AND NOT EXISTS (SELECT 1 FROM frames h WHERE h.job_id = f.job_id AND h.burst_key = f.burst_key AND h.picked = 1))")
def j5_keepers(t) -> DataFrame:
    return stats.keepers(frames(t)).select("id", "job_id")


@query("SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def j8_largest(t) -> DataFrame:
    return linkage.largest_of(t("lineitem"), "l_orderkey", "l_extendedprice", "l_linenumber")


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j10_chain(t) -> DataFrame:
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""WITH l AS (SELECT event_id AS id, 'p' || (event_id % 400) AS path, event_type AS name, epoch_us(ts) / 1e6 AS time FROM events WHERE event_id % 2 = 0), r AS (SELECT event_id AS id, 'p' || (event_id % 700) AS path, event_type AS name, epoch_us(ts) / 1e6 AS time FROM events WHERE event_id % 2 = 1),
  x AS (SELECT l.id, count(r.id) AS n, any_value(r.id) AS rid FROM l LEFT JOIN r USING (path) GROUP BY l.id), y AS (SELECT l.id, count(*) AS n, any_value(r.id) AS rid FROM l JOIN x ON x.id = l.id AND x.n = 0 JOIN r ON l.name = r.name AND abs(l.time - r.time) <= 900 GROUP BY l.id)
  SELECT id AS left_id, rid AS right_id, 'path' AS how FROM x WHERE n = 1 UNION ALL SELECT id, rid, 'name' FROM y WHERE n = 1""")
def j11_link_records(t) -> DataFrame:
    side = lambda odd, m: t("events").where(F.col("event_id") % 2 == odd).select(F.col("event_id").alias("id"), F.concat(F.lit("p"), (F.col("event_id") % m).cast("string")).alias("path"), F.col("event_type").alias("name"), D.wall_seconds(F.col("ts")).alias("time"))
    return linkage.link_records(side(0, 400), side(1, 700), slop=900.0)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), k AS (SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS name, e FROM v WHERE vec_id % 10 = 3),
  s AS (SELECT vec_id, name, list_inner_product(v.e, k.e) AS score FROM v, k WHERE list_inner_product(v.e, k.e) >= 0.3) SELECT vec_id, arg_max(name, score) AS name, round(max(score), 3) AS score FROM s GROUP BY vec_id""")
def j13_nearest_known(t) -> DataFrame:
    known = t("embeddings").where("vec_id % 10 = 3").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("name"), "embedding")
    return linkage.nearest_known(t("embeddings"), known, 0.3, "vec_id", "name", bound=1 << 17)


@query("WITH e AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t, user_id FROM events) SELECT a.id AS a, b.id AS b, a.user_id = b.user_id AS same FROM e a JOIN e b ON a.id < b.id AND abs(a.t - b.t) <= 60")
def j14_band_pairs(t) -> DataFrame:
    e = t("events").select(F.col("event_id").alias("id"), D.wall_seconds(F.col("ts")).alias("t"), "user_id")
    return linkage.band_pairs(e, "id", "t", 60.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.col("a.user_id") == F.col("b.user_id")).alias("same"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT count(*) AS n FROM embeddings),
  f AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 5 <> 0 THEN user_id END AS burst, (user_id * 2654435761 % 4096) * 1048576 + CAST(floor(value * 16) AS BIGINT) AS h, event_id % (SELECT n FROM n) AS vec, event_id % 3 <> 0 AS seen FROM events),
  p AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h)) AS bits, a.vec AS va, b.vec AS vb, a.seen AND b.seen AS seen FROM f a JOIN f b ON a.id < b.id AND abs(a.t - b.t) <= 600 AND a.burst IS DISTINCT FROM coalesce(b.burst, -1) AND bit_count(xor(a.h, b.h)) <= 10)
  SELECT a, b, CAST(bits AS INT) AS bits FROM p LEFT JOIN v x ON x.vec_id = p.va AND seen LEFT JOIN v y ON y.vec_id = p.vb AND seen
  WHERE CASE WHEN x.e IS NOT NULL AND y.e IS NOT NULL THEN list_inner_product(x.e, y.e) >= 0.1 ELSE bits <= 4 END""")
def j14_near_frames(t) -> DataFrame:
    n = t("embeddings").count()
    h = (F.col("user_id") * 2654435761 % 4096) * 1048576 + F.floor(F.col("value") * 16)
    e = t("events").select(F.col("event_id").alias("id"), D.wall_seconds(F.col("ts")).alias("taken"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("burst"), h.alias("phash"))
    looks = e.where("id % 3 <> 0").select("id", (F.col("id") % n).alias("vec_id")).join(t("embeddings").select("vec_id", "embedding"), "vec_id").select("id", "embedding")
    return clusters.near_in_time(e, looks, same=0.1)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN s_name ELSE p_name END AS p_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 10 + 1")
def j15_fill_blanks(t) -> DataFrame:
    rows = t("part").select("p_partkey", (F.col("p_partkey") % 10 + 1).alias("s_suppkey"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name")).alias("p_name"))
    return linkage.fill_blanks(rows, t("supplier").select("s_suppkey", F.col("s_name").alias("p_name")), "s_suppkey", ["p_name"]).select("p_partkey", "p_name")


@query("WITH k AS (SELECT DISTINCT left(p_type, 3 + p_partkey % 5) AS k FROM part) SELECT p_partkey, (SELECT max(k) FROM k WHERE starts_with(p_type, k) AND length(k) >= 4) AS matched FROM part")
def j17_longest_prefix(t) -> DataFrame:
    known = t("part").select(F.left(F.col("p_type"), (3 + F.col("p_partkey") % 5).cast("int")).alias("k")).distinct()
    return linkage.longest_prefix(t("part").select("p_partkey", "p_type"), known, "p_type", "k", 4).select("p_partkey", "matched")


@query("SELECT l.event_id, r.value AS value_as_of FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts")
def j19_as_of(t) -> DataFrame:
    e = t("events")
    return linkage.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value_as_of")


@query("SELECT p_partkey, upper(p_name) AS x FROM part ORDER BY p_partkey LIMIT 50 OFFSET 100")
def o11_page(t) -> DataFrame:
    return views.page(t("part"), "p_partkey", 100, 50).select("p_partkey", F.upper("p_name").alias("x"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 20")
def o3_cover_candidates(t) -> DataFrame:
    return t("part").orderBy((F.col("p_retailprice") * F.col("p_size")).desc(), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query("SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT)) AS INT) AS place FROM supplier")
def o6_natural_order(t) -> DataFrame:
    named = t("supplier").select("s_suppkey", X.natural_key(F.col("s_name")).alias("_key"))
    return lineage.numbered(named, [F.col("_key"), F.col("s_suppkey")], "place").select("s_suppkey", F.col("place").cast("int").alias("place"))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def u3_difference(t) -> DataFrame:
    known = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"))
    return t("lineitem").select(F.col("l_partkey").alias("k")).distinct().join(known, "k", "left_anti")


@query("SELECT lower(event_type) AS folded, min(event_id) AS first FROM events GROUP BY 1")
def u2_ordered_distinct(t) -> DataFrame:
    return t("events").groupBy(F.lower("event_type").alias("folded")).agg(F.min("event_id").alias("first"))


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS plate, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS plain, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, least(levenshtein(p_name, p_type), 13) AS distance FROM part")
def f1_text_functions(t) -> DataFrame:
    return t("part").select("p_partkey", X.ascii_plate(F.col("p_name")).alias("plate"), X.plain_key(F.col("p_type")).alias("plain"), X.slug(F.concat_ws(" / ", "p_name", "p_brand"), 200).alias("slug"), X.bounded_levenshtein(F.col("p_name"), F.col("p_type"), 12).cast("long").alias("distance"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def y4_json_field(t) -> DataFrame:
    return t("events").select("event_id", N.lenient_json(F.col("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) / 1e6 AS seconds FROM events")
def d1_parse_stamp(t) -> DataFrame:
    return t("events").select("event_id", D.parse_stamp(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("seconds"))


@query("SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS norm, bit_count(xor(vec_id, 12345)) AS bits FROM embeddings")
def m1_vectors(t) -> DataFrame:
    return t("embeddings").select("vec_id", N.dot(F.col("embedding"), F.col("embedding")).alias("norm"), N.hamming(F.col("vec_id"), F.lit(12345).cast("long")).alias("bits"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.825 THEN 'sharp' WHEN l_quantity / 50 < 0.606 THEN 'blurred' ELSE 'soft' END AS verdict, CASE WHEN l_quantity / 50 >= 0.958 THEN 5 WHEN l_quantity / 50 >= 0.825 THEN 4 WHEN l_quantity / 50 >= 0.728 THEN 3 WHEN l_quantity / 50 >= 0.606 THEN 2 ELSE 1 END AS stars FROM lineitem")
def m10_verdicts(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", N.verdict(F.col("l_quantity") / 50).alias("verdict"), N.stars(F.col("l_quantity") / 50).alias("stars"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS a, l_orderkey + CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE 0 END AS b FROM lineitem), v AS (SELECT a AS v FROM e UNION SELECT b FROM e), linked AS (SELECT DISTINCT a, b FROM e WHERE a <> b),
  c AS (SELECT v, v % 7 AS r, sum(CASE WHEN EXISTS (SELECT 1 FROM linked WHERE a = v - 7 AND b = v) THEN 0 ELSE 1 END) OVER (PARTITION BY v % 7 ORDER BY v) AS k FROM v)
  SELECT v, min(v) OVER (PARTITION BY r, k) AS component FROM c""")
def g1_components(t) -> DataFrame:
    """Every order, joined to the seventh after it where a supplier says so: chains of any length."""
    return clusters.components(t("lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.when(F.col("l_suppkey") % 3 == 0, 7).otherwise(0)).alias("b")))


@query()
def g2_cluster_by_look(t) -> DataFrame:
    rows = t("embeddings").select((F.col("vec_id") % 25).alias("burst"), (F.col("vec_id") % 100).alias("frame"), F.col("vec_id").alias("det"), F.col("label").cast("string").alias("cls"), "embedding")
    return clusters.cluster_by_look(rows, 0.4).select("burst", "det", "grp")


@query()
def g5_cluster_faces(t) -> DataFrame:
    return clusters.cluster_faces(t("embeddings").withColumn("album", F.col("vec_id") % 10), "album", "vec_id", "embedding", 0.3)


@query("WITH d AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS kept FROM documents) SELECT doc_id, CASE WHEN kept <> doc_id THEN kept END AS copy_of FROM d")
def g8_copies(t) -> DataFrame:
    return clusters.collapse_copies(t("documents"), [F.md5("text")], "doc_id", [F.col("n_chars")]).select("doc_id", "copy_of")


@query("""WITH m AS (SELECT avg(l_quantity) AS mx, stddev_pop(l_quantity) AS sx, avg(l_extendedprice) AS my, count(*) AS n, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(my + (l_quantity - mx) / sx * (n * c / sx) / (n + 2), 2) AS predicted FROM lineitem, m""")
def g10_ridge(t) -> DataFrame:
    """With one feature the normal equation is a division: n cov / s over n + penalty."""
    model = evaluate.fit_ridge(t("lineitem"), ["l_quantity"], "l_extendedprice")
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(model.predict(["l_quantity"]), 2).alias("predicted"))


@query("""WITH g AS (SELECT *, sum(CAST(l_linenumber = 2 AS INT)) OVER (PARTITION BY l_orderkey) AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS p FROM lineitem)
  SELECT count(*) AS groups, avg(CAST(p = 1 AS INT)) AS top1, avg(CAST(p <= 3 AS INT)) AS top3, avg(1 / p) AS mrr FROM g WHERE k = 1 AND l_linenumber = 2""")
def g14_ranking(t) -> DataFrame:
    return evaluate.ranking_metrics(t("lineitem").withColumn("true", F.col("l_linenumber") == 2), ["l_orderkey"], "l_quantity", "true", "l_linenumber")


@query("WITH m AS (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) SELECT l_orderkey, avg(CAST(l_linenumber = 2 AS INT)) AS hit FROM m WHERE l_quantity = top GROUP BY l_orderkey")
def g15_tied_hits(t) -> DataFrame:
    return evaluate.tied_hits(t("lineitem").withColumn("true", F.col("l_linenumber") == 2), ["l_orderkey"], "l_quantity", "true")


@query("""WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem)
  SELECT count(*) FILTER (WHERE y) AS positives, count(*) FILTER (WHERE NOT y) AS negatives, (sum(k) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auc FROM r""")
def g20_auc(t) -> DataFrame:
    return evaluate.auc(t("lineitem").withColumn("true", F.col("l_returnflag") == "R"), "l_quantity", "true")


@query("""WITH b AS (SELECT l_quantity AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1),
  c AS (SELECT s, (sum(p) OVER (ORDER BY s DESC) / sum(p) OVER () + 1 - sum(q) OVER (ORDER BY s DESC) / sum(q) OVER ()) / 2 AS b FROM b) SELECT s AS threshold, b AS balanced FROM c ORDER BY b DESC, s LIMIT 1""")
def g21_threshold(t) -> DataFrame:
    return evaluate.best_threshold(t("lineitem").withColumn("true", F.col("l_returnflag") == "R"), "l_quantity", "true")


@query("SELECT l_returnflag, list_sort(list(l_quantity))[CAST(round((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90 FROM lineitem GROUP BY 1")
def g22_percentile(t) -> DataFrame:
    return evaluate.nearest_percentile(t("lineitem"), ["l_returnflag"], "l_quantity", 90).withColumnRenamed("l_quantity", "p90")


@query("""WITH c AS (SELECT user_id, CASE WHEN event_id % 4 > 0 THEN event_type END AS s, CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END END AS t FROM events), k AS (SELECT user_id, count(*) FILTER (WHERE s = t) AS correct, count(*) FILTER (WHERE s <> t) AS wrong, count(*) FILTER (WHERE s IS NULL AND t IS NOT NULL) AS abstained, count(*) FILTER (WHERE s IS NOT NULL AND t IS NULL) AS invented FROM c GROUP BY user_id)
  SELECT *, CASE WHEN correct + wrong + abstained > 0 THEN correct / (correct + wrong + abstained) END AS accuracy FROM k""")
def g23_confusion(t) -> DataFrame:
    rows = t("events").select("user_id", F.expr("case when event_id % 4 > 0 then event_type end").alias("s"), F.expr("case when event_id % 5 > 0 then case when event_id % 3 = 0 then 'view' else event_type end end").alias("t"))
    return evaluate.confusion(rows, ["user_id"], "s", "t")


@query("""SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'X' END AS o_orderstatus, CASE WHEN k IS NULL THEN o_totalprice ELSE coalesce(p, o_totalprice) END AS o_totalprice
  FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders) FULL JOIN (SELECT o_orderkey * 3 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 1.5 END AS p FROM orders) ON o_orderkey = k""")
def s17_upsert(t) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    delta = t("orders").select((F.col("o_orderkey") * 3).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.expr("case when o_orderkey % 2 = 0 then 1.5D end").alias("o_totalprice"))
    return mutations.upsert(o, delta, "o_orderkey", ("o_totalprice",))


@query("SELECT DISTINCT k FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey * 2 FROM orders)")
def s19_insert_ignore(t) -> DataFrame:
    o = t("orders").select(F.col("o_orderkey").alias("k"))
    return mutations.insert_ignore(o, o.select((F.col("k") * 2).alias("k")), ["k"], [F.col("k")])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def s20_replace_latest(t) -> DataFrame:
    return mutations.replace_latest(t("events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query(f"""WITH {FRAMES}, m AS (SELECT id, CASE WHEN id % 2 = 0 THEN 5 END AS s, CASE WHEN id % 3 = 0 THEN 1 END AS r, CASE WHEN id % 4 = 0 THEN 1 END AS p FROM frames WHERE id % 10 < 7)
  SELECT f.id, coalesce(m.s, f.stars) AS stars, CASE WHEN m.p = 1 THEN 0 ELSE coalesce(m.r, f.rejected) END AS rejected, coalesce(m.p, CASE WHEN m.r = 1 THEN 0 ELSE f.picked END) AS picked FROM frames f LEFT JOIN m ON m.id = f.id""")
def e1_marks(t) -> DataFrame:
    f = frames(t)
    marks = f.where("id % 10 < 7").select("id", F.expr("case when id % 2 = 0 then 5 end").alias("stars"), F.expr("case when id % 3 = 0 then 1 end").alias("rejected"), F.expr("case when id % 4 = 0 then 1 end").alias("picked"))
    return mutations.mark(f, marks).select("id", "stars", "rejected", "picked")


REGROUPED = """v AS (SELECT *, CASE WHEN taken_at - lag(taken_at) OVER (PARTITION BY job_id, camera ORDER BY taken_at, path, id) <= 1.5 THEN 0 ELSE 1 END AS new FROM frames WHERE status = 'done' AND coalesce(copy_of, 0) = 0),
  s AS (SELECT *, sum(new) OVER (PARTITION BY job_id, camera ORDER BY taken_at, path, id) AS session FROM v),
  k AS (SELECT *, dense_rank() OVER (PARTITION BY job_id ORDER BY camera, session) AS time_burst FROM s),
  o AS (SELECT job_id, time_burst, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(taken_at, 0), path, id) AS burst_key FROM k WHERE new = 1),
  r AS (SELECT id, row_number() OVER (PARTITION BY job_id, time_burst ORDER BY coalesce(stars, 0) DESC, floor(rating / 0.03) DESC, id) AS n FROM k WHERE coalesce(stars, 0) >= 3 OR rating >= 0.728)"""


@query(f"""WITH {FRAMES}, {REGROUPED}
  SELECT f.id, CAST(o.burst_key AS BIGINT) AS burst_key, CAST(k.time_burst AS BIGINT) AS time_burst, CASE WHEN r.n = 1 THEN 1 END AS burst_pick
  FROM frames f LEFT JOIN k ON k.id = f.id LEFT JOIN o ON o.job_id = k.job_id AND o.time_burst = k.time_burst LEFT JOIN r ON r.id = f.id""")
def e3_regroup(t) -> DataFrame:
    from .regroup import regroup

    return regroup(frames(t)).select("id", "burst_key", "time_burst", "burst_pick")


def looking_frames(t) -> DataFrame:
    """Frames with settings and looks: boxes that wander, scenes and liveries of a few kinds, focus that steps."""
    kind = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(F.pmod(c, F.lit(n)) == k, 200).otherwise(F.lit(55 // (n - 1))).cast("int"))
    x = F.pmod(F.col("id") * 7, F.lit(40)) / 100
    looks = {
        "width": F.lit(6000), "height": F.when(F.col("id") % 41 == 0, 9000).otherwise(4000), "scene": kind(F.floor(F.col("taken_at") / 20_000), 4), "livery": F.when(F.col("id") % 3 != 0, kind(F.col("id"), 5)),
        "box": F.when(F.col("id") % 7 != 0, F.struct(x.alias("x1"), F.lit(0.2).alias("y1"), (x + 0.3).alias("x2"), F.lit(0.6).alias("y2"))), "panning": F.col("id") % 9 == 0,
        "exposure_time": F.pow(F.lit(2.0), (F.col("id") % 4).cast("double")) / 100, "exposure_bias": F.lit(0.0), "focus_distance": (F.col("id") % 5 + 1).cast("double"), "focal_length": F.lit(50.0), "f_number": F.lit(8.0),
    }
    # a thousand times as fast, so that sessions hold several frames and lie near each other
    return frames(t).withColumns({"taken_at": F.col("taken_at") / 1000}).withColumns(looks)


@query()
def e3_moments(t) -> DataFrame:
    from .regroup import regroup

    return regroup(looking_frames(t), gap=15.0).select("id", "burst_key", "time_burst", "burst_pick", "set_id", "set_kind")


@query(f"""WITH {FRAMES}, {REGROUPED},
  d AS (SELECT o_orderkey AS id, o_custkey AS image_id, o_totalprice % 1000 / 1000 AS score, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 5 ELSE 0 END AS stars, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 END AS group_key FROM orders WHERE o_orderkey % 29 <> 0 AND o_orderkey % 23 <> 0),
  m AS (SELECT d.id, k.job_id, o.burst_key, d.group_key, d.score, d.stars, d.image_id FROM d JOIN k ON k.id = d.image_id JOIN o ON o.job_id = k.job_id AND o.time_burst = k.time_burst WHERE coalesce(k.rejected, 0) = 0),
  w AS (SELECT *, row_number() OVER (PARTITION BY job_id, burst_key, group_key ORDER BY stars DESC, floor(score / 0.03) DESC, image_id, id) AS n FROM m WHERE stars >= 3 OR score >= 0.728),
  c AS (SELECT id, group_key IS NOT NULL OR NOT max(CAST(group_key IS NOT NULL AS INT)) OVER (PARTITION BY job_id, burst_key) = 1 AS stays FROM w WHERE n = 1)
  SELECT o_orderkey AS id, CASE WHEN stays THEN 1 END AS burst_pick FROM orders LEFT JOIN c ON c.id = o_orderkey""")
def e3_subject_keepers(t) -> DataFrame:
    from .regroup import regroup, subject_keepers

    e = F.expr
    own = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), e("o_totalprice % 1000 / 1000").alias("rating"), F.lit(None).cast("double").alias("sharpness"), e("case when o_orderkey % 7 = 0 then o_orderkey % 5 end").alias("stars"), e("case when o_orderkey % 2 = 0 then o_orderkey % 3 end").alias("group_key"), e("case when o_orderkey % 29 = 0 then 1 end").alias("rejected"), e("case when o_orderkey % 23 = 0 then 1 end").alias("bystander"))
    return subject_keepers(regroup(frames(t)), own).select("id", "burst_pick")


def _stream(t, spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(t("events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zone


def _landed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """A stream of what is there now, run to its end into Parquet in the shared folder."""
    import uuid

    spark = stream.sparkSession
    place = f"{lineage.work_dir(spark)}/burstlake/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").option("path", f"{place}/rows").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def streaming(sql: str | None = None) -> Callable[[Callable], Query]:
    def register(f: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(_stream(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


@streaming("""WITH h AS (SELECT *, date_trunc('day', ts) AS d FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
  SELECT CAST(epoch(d) AS BIGINT) AS started, event_type, count(*) AS n FROM h, w WHERE d + INTERVAL 1 DAY <= mark GROUP BY d, event_type""")
def t8_tumbling_counts(events) -> DataFrame:
    """Windows that the watermark has passed when the stream ends."""
    from ..streaming.watch import live_counts

    return _landed(live_counts(events, "ts", "1 day", "1 day", "1 hour", ["event_type"])).select(F.unix_seconds(F.col("started").cast("timestamp")).alias("started"), "event_type", "n")


@streaming()
def t4_live_sessions(events) -> DataFrame:
    from ..streaming.watch import live_sessions

    return _landed(live_sessions(events, "user_id", "ts", "3 hours", "1 hour"))


@streaming()
def t1_settled(events) -> DataFrame:
    """Events as sightings of files: user the file, the type its size."""
    from ..streaming.watch import settled

    seen = events.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.length("event_type").cast("long").alias("size"), F.lit(0.0).alias("mtime"), D.wall_seconds(F.col("ts")).alias("seen"))
    return _landed(settled(seen, 3600.0, 36_000.0))


@query(f"WITH {FRAMES} SELECT id, CASE WHEN coalesce(rejected, 0) = 1 THEN 'rejected' WHEN coalesce(picked, 0) = 1 THEN 'picked' WHEN rating_verdict = 'blurred' THEN 'culled' ELSE 'undecided' END AS decision FROM frames")
def p13_decision(t) -> DataFrame:
    return frames(t).withColumn("cull_reason", F.expr("case when rating_verdict = 'blurred' then 'blur' end")).select("id", views.decision().alias("decision"))


@query(f"WITH {FRAMES} SELECT id, CASE WHEN coalesce(rejected, 0) = 1 THEN 'rejected' WHEN coalesce(stars, 0) < 2 THEN 'rating' WHEN lower(lens) <> 'click' THEN 'label' END AS reason FROM frames")
def p10_cull_gate(t) -> DataFrame:
    return frames(t).select("id", views.cull_gate(F.col("stars"), F.col("lens"), F.col("rejected") == 1, True, 2, "Click")["reason"].alias("reason"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'brand#1')")
def p11_search(t) -> DataFrame:
    return views.search(t("part"), ["p_name", "p_brand"], " BRAND#1 ").select("p_partkey")


@query("SELECT l_orderkey, bool_and(l_returnflag = 'R' OR l_linestatus = 'O') AS excluded FROM lineitem GROUP BY 1")
def p14_excluded_frames(t) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).alias("rejected"), F.when(F.col("l_linestatus") == "O", 1).alias("bystander"))
    return views.excluded_frames(rows, "l_orderkey")


@query("SELECT l_orderkey, bool_or(l_returnflag = 'N' OR l_tax * 10 < 0.5) AS needs_look FROM lineitem GROUP BY 1")
def p15_needs_look(t) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", F.when(F.col("l_returnflag") != "N", "7").alias("number"), F.lit(" ").alias("plate"), (F.col("l_tax") * 10).alias("agreement"))
    return views.needs_look(rows, "l_orderkey")


@query(f"WITH {FRAMES} SELECT id, count(*) OVER w AS stack_size, min(id) OVER w AS stack FROM frames WINDOW w AS (PARTITION BY job_id, burst_key) QUALIFY rating_verdict = 'sharp'")
def v2_stacks(t) -> DataFrame:
    return views.stacks(frames(t), F.col("rating_verdict") == "sharp").select("id", "stack_size", "stack")


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def v4_neighbours(t) -> DataFrame:
    return views.neighbours(t("events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "before", "after")


@query("SELECT CASE WHEN vec_id % 3 = 0 THEN 'g:' || label WHEN vec_id % 5 = 0 THEN 'b:' || label || ':c' ELSE 's:' || vec_id END AS grp, count(*) AS items, count(DISTINCT vec_id // 2) AS frames FROM embeddings GROUP BY 1")
def v1_vehicle_groups(t) -> DataFrame:
    rows = t("embeddings").select("vec_id", F.expr("case when vec_id % 3 = 0 then label end").alias("group_key"), F.lit(" ").alias("identity"), F.expr("case when vec_id % 5 = 0 then label end").alias("burst_key"), F.lit("c").alias("cls"), F.floor(F.col("vec_id") / 2).alias("image_id"))
    return views.vehicle_groups(rows, "vec_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber % 3 = 0 AS e, l_quantity > 20 AS s, l_returnflag = 'R' AS p, count(*) OVER w AS n, max(CAST(l_returnflag = 'R' AS INT)) OVER w AS a, l_tax * 50 AS secs, l_linestatus = 'F' AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
  m AS (SELECT avg(1 - CAST(c AS INT)) FILTER (WHERE e) AS kept_share, avg(CAST(s AS INT)) FILTER (WHERE e) AS sharp_share, avg(CAST(e AS INT)) FILTER (WHERE p) AS pick_hits, avg(1 / n) FILTER (WHERE e) AS chance, avg(a) AS burst_has_pick, avg(secs) AS seconds FROM r)
  SELECT *, CASE WHEN pick_hits >= 2 * chance THEN 'PASS' WHEN pick_hits >= chance THEN 'WARN' ELSE 'FAIL' END AS pick_word, CASE WHEN seconds <= 1.5 THEN 'PASS' WHEN seconds <= 3 THEN 'WARN' ELSE 'FAIL' END AS speed_word FROM m""")
def g16_readiness(t) -> DataFrame:
    one = lambda c: c.cast("int")
    rows = t("lineitem").select("l_orderkey", one(F.col("l_linenumber") % 3 == 0).alias("exported"), one(F.col("l_quantity") > 20).alias("sharp"), one(F.col("l_returnflag") == "R").alias("picked"), one(F.col("l_linestatus") == "F").alias("culled"), F.col("l_quantity").alias("score"), (F.col("l_tax") * 50).alias("seconds"))
    return views.readiness(rows, ["l_orderkey"])


@query("""WITH r AS (SELECT p_size AS g, 'AB' || CASE p_partkey % 3 WHEN 0 THEN '0' WHEN 1 THEN 'O' ELSE 'X' END AS v, p_partkey FROM part), c AS (SELECT g, v, count(*) AS n, min(p_partkey) AS f FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, f) AS k FROM c)
  SELECT t.g AS p_size, t.v AS plate, t.n AS votes, coalesce((SELECT max(o.v) FROM k o WHERE o.g = t.g AND o.k > 1 AND o.v <> 'ABX' AND t.v <> 'ABX'), '') AS aliases FROM k t WHERE t.k = 1""")
def a27_agreed(t) -> DataFrame:
    plate = F.concat(F.lit("ab-"), F.when(F.col("p_partkey") % 3 == 0, "0").when(F.col("p_partkey") % 3 == 1, "o").otherwise("x"))
    rows = t("part").withColumns({"plate": plate, "attributes": F.lit("{}")})
    return registry.agreed(rows, ["p_size"], "p_partkey").select("p_size", "plate", "votes", F.array_join("aliases", "|").alias("aliases"))


#: Detections over parts: plates with letters that are read for each other, and attributes of all kinds of values.
DETECTIONS = """detections AS (SELECT p_partkey AS id, p_size % 5 AS job_id, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS group_key,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'AB' || (p_size % 20 + 10) || CASE p_partkey % 6 WHEN 0 THEN 'O' WHEN 1 THEN 'X' WHEN 2 THEN 'D' ELSE '0' END END AS plate,
    CASE WHEN p_partkey % 3 = 0 THEN 'Maker ' || p_partkey % 3 END AS make, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE '' END AS group_make, CASE WHEN p_partkey % 7 < 3 THEN p_type END AS group_model, p_type AS model,
    CASE WHEN p_partkey % 13 <> 0 THEN 'Box ' || p_partkey % 4 END AS body_type, CASE WHEN p_partkey % 2 = 0 THEN '  Maker ' || p_partkey % 3 ELSE '' END AS team, [p_brand, CASE WHEN p_partkey % 3 = 1 THEN 'Box ' || p_partkey % 4 ELSE '' END] AS sponsors, p_partkey % 4 AS race_number,
    CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size AS VARCHAR) END AS number FROM part)"""


def detections(t) -> DataFrame:
    """``DETECTIONS``, with what is said in JSON; colour is a list in one row of two."""
    e = F.expr
    kept = lambda when, value: e(f"case when {when} then {value} end")
    attributes = F.to_json(F.struct(kept("p_partkey % 3 = 0", "concat('Maker ', p_partkey % 3)").alias("make"), e("case when p_partkey % 5 = 0 then p_brand else '' end").alias("group_make"), kept("p_partkey % 7 < 3", "p_type").alias("group_model"), F.col("p_type").alias("model"), kept("p_partkey % 13 <> 0", "concat('Box ', p_partkey % 4)").alias("body_type"), e("case when p_partkey % 2 = 0 then concat('  Maker ', p_partkey % 3) else '' end").alias("team"), e("array(p_brand, case when p_partkey % 3 = 1 then concat('Box ', p_partkey % 4) else '' end)").alias("sponsors"), e("p_partkey % 4").alias("race_number")))
    plate = e("case when p_partkey % 11 = 0 then '' else concat('ab-', p_size % 20 + 10, ' ', case p_partkey % 6 when 0 then 'o' when 1 then 'x' when 2 then 'd' else '0' end) end")
    return t("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("job_id"), kept("p_partkey % 4 <> 0", "p_size").alias("group_key"), plate.alias("plate"), attributes.alias("attributes"), kept("p_partkey % 8 = 0", "cast(p_size as string)").alias("number"))


def _sql_readings() -> str:
    near = "length(a.plate) = length(b.plate) AND (SELECT count(*) FROM range(1, length(a.plate) + 1) r(i) WHERE a.plate[i] <> b.plate[i]) = 1 AND (SELECT bool_or(list_has_all(k, [a.plate[i], b.plate[i]])) FROM range(1, length(a.plate) + 1) r(i), (SELECT unnest([" + ", ".join(f"string_split('{c}', '')" for c in X.CONFUSABLE) + "]) AS k) WHERE a.plate[i] <> b.plate[i])"
    top = lambda f, where: f"(SELECT job_id, group_key, v AS {f} FROM (SELECT job_id, group_key, trim(CAST({f} AS VARCHAR)) AS v, count(*) AS n, min(id) AS m FROM g WHERE {where} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY job_id, group_key ORDER BY n DESC, m) = 1)"
    return f"""
WITH {DETECTIONS}, g AS (SELECT * FROM detections WHERE plate <> '' AND group_key IS NOT NULL),
p AS (SELECT job_id, group_key, plate, count(*) AS n, min(id) AS f FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, group_key ORDER BY n DESC, f) AS place FROM p),
near AS (SELECT a.job_id, a.group_key, list(DISTINCT b.plate ORDER BY b.plate) AS aliases FROM k a JOIN k b ON a.job_id = b.job_id AND a.group_key = b.group_key AND a.place = 1 AND b.place > 1 WHERE {near} GROUP BY ALL),
named AS (SELECT job_id, group_key, v, count(*) AS n, min(id * 1000 + pos) AS f FROM (SELECT job_id, group_key, id, unnest(sponsors) AS v, unnest(range(len(sponsors))) AS pos FROM g) WHERE v <> '' GROUP BY ALL),
sponsors AS (SELECT job_id, group_key, string_agg(v, ', ' ORDER BY n DESC, f) AS sponsors FROM named GROUP BY ALL),
firsts AS (SELECT job_id, group_key, arg_min((group_make, group_model), id) AS own, min(id) AS first_seq FROM g GROUP BY ALL),
agreed AS (
  SELECT k.job_id, k.group_key, k.plate, k.n AS votes, coalesce(near.aliases, []) AS aliases, coalesce(nullif(own[1], ''), m.make) AS make, own[2] AS model, CAST(NULL AS VARCHAR) AS colour, b.body_type, w.team, s.sponsors, r.race_number, first_seq
  FROM k JOIN firsts USING (job_id, group_key) LEFT JOIN near USING (job_id, group_key) LEFT JOIN {top("make", "make IS NOT NULL")} m USING (job_id, group_key) LEFT JOIN {top("body_type", "body_type IS NOT NULL")} b USING (job_id, group_key)
    LEFT JOIN {top("team", "team <> ''")} w USING (job_id, group_key) LEFT JOIN sponsors s USING (job_id, group_key) LEFT JOIN {top("race_number", "race_number <> 0")} r USING (job_id, group_key) WHERE k.place = 1)"""


@query(_sql_readings() + " SELECT job_id, group_key, plate, votes, array_to_string(aliases, '|') AS aliases, make, model, body_type, team, sponsors, race_number FROM agreed")
def a27_readings(t) -> DataFrame:
    found = registry.agreed(detections(t).where("plate <> '' and group_key is not null"), ["job_id", "group_key"], "id")
    return found.select("job_id", "group_key", "plate", "votes", F.array_join("aliases", "|").alias("aliases"), "make", "model", "body_type", "team", F.array_join("sponsors", ", ").alias("sponsors"), "race_number")


_KNOWN = "known AS (SELECT 'AB' || (p_size % 20 + 10) || '0' AS plate, 'ab' || (p_size % 20 + 10) || 'Q, ' AS aliases, min(CASE WHEN p_size % 20 < 8 THEN 'Make ' || p_size % 20 END) AS make, CAST(NULL AS VARCHAR) AS team FROM part GROUP BY p_size % 20, 1, 2 HAVING p_size % 20 < 16)"


@query(_sql_readings() + f""", {_KNOWN},
  every AS (SELECT plate, aliases, make, model, body_type, team, sponsors, race_number, 0 AS loose, first_seq AS id FROM agreed
    UNION ALL SELECT plate, [], make, model, body_type, nullif(team, ''), array_to_string(list_filter(sponsors, lambda x: true), ', '), number, 1, id FROM detections WHERE group_key IS NULL AND plate <> ''),
  folded AS (SELECT plate, arg_min(make, (loose, id)) FILTER (make <> '') AS make, arg_min(model, (loose, id)) FILTER (model <> '') AS model, arg_min(trim(team), (loose, id)) FILTER (trim(team) <> '') AS team, arg_min(race_number, (loose, id)) FILTER (race_number <> '') AS race_number FROM every GROUP BY plate),
  united AS (SELECT plate, string_agg(a, ', ' ORDER BY a) AS aliases FROM (SELECT plate, unnest(aliases) AS a FROM every UNION SELECT plate, upper(nullif(trim(unnest(string_split(aliases, ','))), '')) FROM known WHERE plate IN (SELECT plate FROM every)) WHERE a <> plate GROUP BY plate)
  SELECT coalesce(k.plate, f.plate) AS plate, CASE WHEN f.plate IS NULL THEN k.aliases ELSE coalesce(u.aliases, '') END AS aliases, coalesce(k.make, f.make) AS make, f.model, f.team, f.race_number
  FROM known k FULL JOIN folded f ON k.plate = f.plate LEFT JOIN united u ON u.plate = f.plate""")
def g7_seeded(t) -> DataFrame:
    n = F.col("p_size") % 20
    known = t("part").groupBy(n.alias("n")).agg(F.min(F.when(n < 8, F.concat(F.lit("Make "), n.cast("string")))).alias("make")).where("n < 16")
    known = known.select(F.concat(F.lit("AB"), (F.col("n") + 10).cast("string"), F.lit("0")).alias("plate"), F.concat(F.lit("ab"), (F.col("n") + 10).cast("string"), F.lit("Q, ")).alias("aliases"), "make", *[F.lit(None).cast("string").alias(f) for f in registry.FIELDS if f != "make"])
    return registry.seeded(known, registry.readings(detections(t))).select("plate", "aliases", "make", "model", "team", "race_number")


@query()
def a23_accumulate(t) -> DataFrame:
    rows = t("events").select("user_id", "event_id", F.array("event_type").alias("said"))
    return identity.accumulate(rows, "user_id", "said", "event_id")


@query()
def a26_consensus(t) -> DataFrame:
    rows = t("part").select("p_size", "p_partkey", F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.element_at(F.split("p_name", " "), 1).alias("colour"), F.format_string("#%02x%02x%02x", F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 59 % 256, F.col("p_partkey") * 83 % 256).alias("colour_hex"), F.col("p_name").alias("plate"), (F.col("p_retailprice") / 1000).alias("plate_conf"))
    return identity.consensus(rows, "p_size", "p_partkey")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'found' END END AS s_name FROM supplier""")
def g7_seed_registry(t) -> DataFrame:
    known = t("supplier").select(F.col("s_suppkey").cast("string").alias("plate"), F.expr("case when s_suppkey % 2 = 0 then s_name end").alias("name"))
    found = known.where("cast(plate as int) % 3 = 0").select("plate", F.lit("found").alias("name"))
    return identity.seed_registry(known, found).select(F.col("plate").cast("long").alias("s_suppkey"), F.col("name").alias("s_name"))


@query("WITH p AS (SELECT l_orderkey AS v, l_quantity AS x, sum(exp(l_quantity / 10)) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) SELECT v AS l_orderkey, round(max(exp(x / 10) / s), 6) AS top FROM p GROUP BY v")
def g28_softmax(t) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.array_max(N.softmax(F.collect_list("l_quantity"), 10.0)), 6).alias("top"))


@query(f"WITH {FRAMES} SELECT id, path, CASE WHEN status = 'done' THEN path END AS kept_path FROM frames")
def s23_reset(t) -> DataFrame:
    f = frames(t).select("id", "path", F.col("path").alias("kept_path"), "status")
    return mutations.reset(f, ["id", "path", "status"], F.col("status") != "done").drop("status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def s21_partial_update(t) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return mutations.apply_delta(o, o.select("o_orderkey", F.expr("case when o_orderkey % 4 = 0 then 'Z' end").alias("o_orderstatus")), "o_orderkey", ["o_orderstatus"])


@query("SELECT o_orderkey, 'F' AS o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def s22_changed_only(t) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return mutations.changed_only(o, o.select("o_orderkey", F.lit("F").alias("o_orderstatus")), "o_orderkey", ["o_orderstatus"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a34_cube(t) -> DataFrame:
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query(r"SELECT url, regexp_replace(regexp_replace(replace(lower(url), '/', '\'), '\\+', '\\', 'g'), '\\$', '') AS key FROM pages")
def p16_path_key(t) -> DataFrame:
    return t("pages").select("url", X.path_key(F.col("url")).alias("key"))


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def j9_scalar_aggregates(t) -> DataFrame:
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n"))
    return t("customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["n"])


@query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag IN ('R', 'A') GROUP BY 1")
def j2_left_with_residual(t) -> DataFrame:
    right = t("lineitem").where(F.col("l_returnflag").isin("R", "A")).select("l_orderkey")
    return t("orders").join(right, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("lines"))


@query("SELECT event_id, value, event_type FROM (SELECT *, abs(value / 20 - 3) AS d FROM events) ORDER BY d, event_id LIMIT 400")
def o7_review_order(t) -> DataFrame:
    return t("events").orderBy(F.abs(F.col("value") / 20 - 3), "event_id").limit(400).select("event_id", "value", "event_type")


@query()
def w5_split_moments(t) -> DataFrame:
    e = t("events")
    x = F.col("event_id") % 5 / 10
    box = F.when(F.col("event_id") % 7 > 0, F.struct(x.alias("x1"), x.alias("y1"), (x + 0.3).alias("x2"), (x + 0.2).alias("y2")))
    levels = F.array((F.col("value") * 2).cast("int"), (255 - F.col("value") * 2).cast("int"))
    rows = e.select("event_id", F.col("user_id").alias("burst"), F.struct("ts", "event_id").alias("seq"), D.wall_seconds(F.col("ts")).alias("taken"), box.alias("box"), levels.alias("scene"), levels.alias("livery"), (F.col("event_id") % 3 == 0).alias("panning"))
    return moments.split_moments(rows, moments.Rules(pause=3600.0)).select("event_id", "moment")


@query()
def g3_merge_on_plates(t) -> DataFrame:
    rows = t("part").select(F.col("p_size").alias("album"), F.col("p_partkey").alias("grp"), F.lit("car").alias("cls"), F.array(X.ascii_plate(F.col("p_brand"))).alias("plates"), F.array("p_partkey").alias("frames"))
    return moments.merge_on_plates(rows, "album")


@query("WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 / 255.0 AS r, (p_partkey * 59) % 256 / 255.0 AS g, (p_partkey * 83) % 256 / 255.0 AS b FROM part) SELECT p_partkey, round(CAST(greatest(r, g, b) AS DOUBLE), 6) AS v, round(CAST(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END AS DOUBLE), 6) AS s FROM c")
def m7_hsv(t) -> DataFrame:
    colour = moments.hsv(F.format_string("#%02x%02x%02x", F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 59 % 256, F.col("p_partkey") * 83 % 256))
    return t("part").select("p_partkey", F.round(colour["v"], 6).alias("v"), F.round(colour["s"], 6).alias("s"))


@query("WITH g AS (SELECT *, count(*) OVER w AS n, sum(CAST(l_linenumber = 2 AS INT)) OVER w AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber FROM g WHERE d = 1 AND n BETWEEN 2 AND 30")
def g26_eligible_bursts(t) -> DataFrame:
    return moments.eligible_bursts(t("lineitem").withColumn("true", F.col("l_linenumber") == 2), "l_orderkey", "true").select("l_orderkey", "l_linenumber")


@query("SELECT p_brand, least(count(*), 5) AS n FROM part GROUP BY p_brand")
def g26_stratified_cap(t) -> DataFrame:
    return moments.stratified_cap(t("part"), ["p_brand"], "p_partkey", 5).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT l_orderkey, list(l_discount ORDER BY l_linenumber, l_discount) AS d FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN list_max(d) >= 0.05 AND len(list_filter(d, lambda x: x = list_max(d))) = 1 THEN list_position(d, list_max(d)) - 1 END AS peak FROM l")
def m17_peak(t) -> DataFrame:
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_discount"))), lambda x: x["l_discount"])
    return t("lineitem").groupBy("l_orderkey").agg(in_order.alias("d")).select("l_orderkey", moments.peak_frame(F.col("d"), 0.05).cast("int").alias("peak"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN CAST(user_id AS VARCHAR) END AS o, CASE WHEN event_id % 3 <> 2 THEN CAST(user_id + event_id % 2 AS VARCHAR) END AS m, value / 100 AS c FROM events)
  SELECT event_id, CASE WHEN o = m THEN o WHEN o IS NOT NULL AND (c >= 0.6 OR m IS NULL) THEN o ELSE m END AS number, CASE WHEN o = m THEN 'ocr+vlm' WHEN o IS NOT NULL AND (c >= 0.6 OR m IS NULL) THEN 'ocr' ELSE 'vlm' END AS source,
  round(CASE WHEN o = m THEN least(greatest(c, 0.5, 0.7) + 0.2, 1) WHEN o IS NOT NULL AND (c >= 0.6 OR m IS NULL) THEN c ELSE 0.5 END, 9) AS confidence FROM r""")
def f15_merge_number(t) -> DataFrame:
    ocr = F.when(F.col("event_id") % 3 != 1, F.col("user_id").cast("string"))
    other = F.when(F.col("event_id") % 3 != 2, (F.col("user_id") + F.col("event_id") % 2).cast("string"))
    merged = X.merge_number(ocr, F.col("value") / 100, other, F.lit(0.5), 0.6)
    return t("events").select("event_id", merged["number"].alias("number"), merged["source"].alias("source"), F.round(merged["confidence"], 9).alias("confidence"))
