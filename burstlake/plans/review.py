"""Registered queries of the review list, ratings, geometry, readings, linkage and evaluation, each with its SQL where SQL can express it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extend, framing, vehicles
from ..functions import numeric as N
from ..functions import text as X
from ..functions import times as D
from ..operators import clusters, evaluate, identity, lineage, linkage, moments, mutations, rating, resets, selection, sequence, views, votes
from ..schemas import needs_review
from . import rollups, stats
from .queries import FRAMES, SESSIONS, frames, query, sessions

SEEN = """seen AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, CASE l_linenumber % 4 WHEN 0 THEN 'person' WHEN 3 THEN 'eye' WHEN 2 THEN 'vehicle' END AS region_type, l_quantity / 50 AS rating,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey AS VARCHAR) END AS number, CASE WHEN l_linestatus = 'F' AND l_linenumber = 2 THEN 'P' || l_suppkey END AS plate, CASE WHEN l_tax < 0.03 THEN '{}' WHEN l_tax < 0.05 THEN '{"a":1}' END AS attributes,
  CAST(l_linenumber % 2 AS INT) AS reviewed, CASE WHEN l_discount >= 0.09 THEN 1 END AS rejected, CASE WHEN l_discount < 0.02 THEN 1 END AS bystander, CASE WHEN l_discount < 0.01 THEN 1 END AS af_bystander, CASE WHEN l_quantity < 10 THEN 'blur' END AS cull_reason,
  CASE WHEN l_quantity > 45 THEN 1 END AS burst_pick, CAST(l_linenumber % 2 AS INT) AS panning, CASE WHEN l_linenumber = 5 THEN l_tax * 10 END AS group_agreement, CASE WHEN l_returnflag = 'A' THEN 'ocr' END AS number_source,
  CASE WHEN l_linenumber = 2 THEN CAST(trunc(l_quantity) AS INT) % 6 END AS stars FROM lineitem)"""


def seen(t) -> DataFrame:
    e = F.expr
    return t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), e("case l_linenumber % 4 when 0 then 'person' when 3 then 'eye' when 2 then 'vehicle' end").alias("region_type"), (F.col("l_quantity") / 50).alias("rating"),
        e("case when l_returnflag = 'R' then cast(l_partkey as string) end").alias("number"), e("case when l_linestatus = 'F' and l_linenumber = 2 then concat('P', l_suppkey) end").alias("plate"), e("""case when l_tax < 0.03 then '{}' when l_tax < 0.05 then '{"a":1}' end""").alias("attributes"),
        e("cast(l_linenumber % 2 as int)").alias("reviewed"), e("case when l_discount >= 0.09 then 1 end").alias("rejected"), e("case when l_discount < 0.02 then 1 end").alias("bystander"), e("case when l_discount < 0.01 then 1 end").alias("af_bystander"), e("case when l_quantity < 10 then 'blur' end").alias("cull_reason"),
        e("case when l_quantity > 45 then 1 end").alias("burst_pick"), e("cast(l_linenumber % 2 as int)").alias("panning"), e("case when l_linenumber = 5 then l_tax * 10 end").alias("group_agreement"), e("case when l_returnflag = 'A' then 'ocr' end").alias("number_source"),
        e("case when l_linenumber = 2 then cast(l_quantity as int) % 6 end").alias("stars"),
    )


@query(f"WITH {FRAMES} SELECT id, path FROM frames WHERE job_id = 3 AND status = 'error' ORDER BY id")
def p1_status_filter(t) -> DataFrame:
    return selection.pending(frames(t), 3, "error").select("id", "path")


@query("SELECT p_partkey, upper(p_name) AS x FROM part ORDER BY p_partkey LIMIT 500 OFFSET 100")
def p2_default_page(t) -> DataFrame:
    return views.page(t("part"), "p_partkey", 100).select("p_partkey", F.upper("p_name").alias("x"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id = 77")
def p3_point_lookup(t) -> DataFrame:
    return selection.lookup(t("events"), "event_id", 77).select("event_id", "user_id", "event_type")


@query(f"WITH {FRAMES} SELECT DISTINCT job_id FROM frames f WHERE EXISTS (SELECT 1 FROM frames p WHERE p.job_id = f.job_id AND p.picked = 1 AND p.stars > 3)")
def p4_exists(t) -> DataFrame:
    f = frames(t)
    return f.select("job_id").distinct().join(f.where("picked = 1 and stars > 3").select("job_id").distinct(), "job_id", "left_semi")


@query(f"WITH {SEEN} SELECT id, CASE WHEN reviewed <> 0 THEN false WHEN coalesce(rejected, 0) <> 0 THEN coalesce(bystander, 0) <> 0 ELSE coalesce(rating, 1) < coalesce(nullif(group_agreement, 0), 0.8) END AS ask FROM seen")
def p5_needs_review(t) -> DataFrame:
    return seen(t).select("id", needs_review(F.col("rating"), F.col("reviewed"), F.col("rejected"), F.col("bystander"), F.col("group_agreement")).alias("ask"))


@query(f"""WITH {FRAMES}, b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS k FROM frames WHERE status = 'error' AND coalesce(rejected, 0) = 0 AND coalesce(copy_of, 0) = 0)
  SELECT job_id, count(*) AS n, string_agg(split_part(path, '/', -1) || ': could not be read', ' | ' ORDER BY id) FILTER (WHERE k <= 3) AS samples FROM b GROUP BY job_id""")
def p6_failed_frames(t) -> DataFrame:
    bad = selection.failed(frames(t).withColumn("error", F.lit(None).cast("string")))
    return bad.withColumn("samples", F.array_join("samples", " | "))


@query(f"WITH {FRAMES}, {SEEN} SELECT s.id FROM seen s JOIN frames f ON s.image_id = f.id WHERE number_source IS NULL AND f.job_id = 4")
def p7_unread(t) -> DataFrame:
    return selection.unread(seen(t), frames(t), 4).select("id")


@query(f"WITH {SEEN} SELECT id, coalesce(number, '') <> '' OR coalesce(plate, '') <> '' OR coalesce(attributes, '') NOT IN ('', '{{}}', 'null') AS read FROM seen")
def p8_read_any(t) -> DataFrame:
    return seen(t).select("id", selection.read_any().alias("read"))


@query(f"WITH {FRAMES} SELECT 'all' AS asked, count(*) AS n FROM frames UNION ALL SELECT 'five', count(*) FROM frames WHERE job_id = 5")
def p9_optional_filter(t) -> DataFrame:
    n = lambda name, album: selection.of_album(frames(t), album).agg(F.lit(name).alias("asked"), F.count("*").alias("n"))
    return n("all", None).union(n("five", 5))


FACTS = f"""{FRAMES}, {SEEN}, per AS (SELECT s.image_id AS id, count(*) AS n, bool_and(s.reviewed <> 0) AS reviewed, bool_or(s.panning <> 0) AS panned, bool_or(coalesce(s.burst_pick, 0) <> 0) AS pick,
  bool_and(coalesce(s.rejected, 0) <> 0 OR coalesce(s.bystander, 0) <> 0 OR (coalesce(s.cull_reason, '') <> '' AND s.stars IS NULL AND f.stars IS NULL)) AS all_out,
  bool_or(coalesce(s.region_type, 'vehicle') = 'vehicle' AND ((coalesce(s.number, '') = '' AND coalesce(s.plate, '') = '') OR coalesce(s.group_agreement, 1) < 0.5)) AS needs_look,
  string_agg(DISTINCT s.number, ' ') AS numbers FROM seen s JOIN frames f ON f.id = s.image_id GROUP BY s.image_id),
facts AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(reviewed, false) AS reviewed, coalesce(panned, false) AS panned, coalesce(pick, false) OR coalesce(burst_pick, 0) <> 0 AS pick, coalesce(f.rejected, 0) <> 0 OR coalesce(all_out, false) AS excluded, coalesce(needs_look, false) AS needs_look,
  coalesce(stars, CASE WHEN rating IS NULL THEN 0 WHEN rating >= 0.958 THEN 5 WHEN rating >= 0.825 THEN 4 WHEN rating >= 0.728 THEN 3 WHEN rating >= 0.606 THEN 2 ELSE 1 END) AS level FROM frames f LEFT JOIN per USING (id)),
decided AS (SELECT *, CASE WHEN coalesce(rejected, 0) <> 0 THEN 'rejected' WHEN coalesce(picked, 0) <> 0 THEN 'picked' WHEN excluded THEN 'rejected' ELSE 'undecided' END AS decision FROM facts),
handed AS (SELECT *, max(CASE WHEN decision = 'picked' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, burst_key) AS hand FROM decided),
kept AS (SELECT *, decision = 'picked' OR (hand = 0 AND pick AND decision <> 'rejected') AS keeper FROM handed)"""


def _known(t) -> DataFrame:
    # ratings of the review list are shares, those of the events percents
    return selection.facts(frames(t).withColumn("rating", F.col("rating") / 100), seen(t))


_FACTS = FACTS.replace("value AS rating,", "value / 100 AS rating,")


@query(f"WITH {_FACTS} SELECT id, n, reviewed, panned, pick, excluded, needs_look, CAST(level AS INT) AS level, decision FROM kept")
def j18_facts(t) -> DataFrame:
    return _known(t).select("id", "n", "reviewed", "panned", "pick", "excluded", "needs_look", F.col("level").cast("int").alias("level"), selection.decision().alias("decision"))


@query(f"""WITH {_FACTS}, v AS (SELECT 'keepers' AS shown, id FROM kept WHERE keeper UNION ALL SELECT 'undecided', id FROM kept WHERE decision = 'undecided' AND level >= 2 UNION ALL SELECT 'rejected', id FROM kept WHERE decision = 'rejected'
  UNION ALL SELECT 'review', id FROM kept WHERE NOT excluded AND NOT reviewed UNION ALL SELECT 'needsLook', id FROM kept WHERE NOT excluded AND needs_look UNION ALL SELECT 'top3', id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, burst_key ORDER BY CAST(keeper AS INT) DESC, stars IS NULL, stars DESC NULLS LAST, rating DESC, id) AS k FROM kept WHERE coalesce(rejected, 0) = 0 OR stars IS NOT NULL) WHERE k <= 3)
  SELECT shown, id FROM v""")
def p12_views(t) -> DataFrame:
    return selection.all_views(_known(t), {"undecided": 2}).select("shown", "id")


@query(f"""WITH {_FACTS}, s AS (SELECT job_id, burst_key, count(*) AS size, max(CASE WHEN decision <> 'rejected' THEN level END) AS best, count(*) FILTER (WHERE keeper) AS k FROM kept WHERE burst_key IS NOT NULL GROUP BY 1, 2)
  SELECT 'suggested' AS what, count(*) AS n, sum(s.size) AS total FROM kept JOIN s USING (job_id, burst_key) WHERE keeper AND coalesce(picked, 0) = 0 AND s.size > 1
  UNION ALL SELECT 'single', count(*), count(*) FROM kept JOIN s USING (job_id, burst_key) WHERE s.size = 1 UNION ALL SELECT 'soft', count(*), sum(best) FROM s WHERE size > 1 AND k = 0 AND best < 3""")
def v3_burst_marks(t) -> DataFrame:
    known = _known(t)
    row = lambda df, name, total: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"), total.cast("long").alias("total"))
    return row(selection.suggestion_sizes(known), "suggested", F.sum("size")).union(row(selection.singleton_ids(known), "single", F.count("*"))).union(row(selection.soft_bursts(known), "soft", F.sum("best")))


@query(f"WITH {_FACTS} SELECT id FROM kept WHERE contains(lower(path), '7') AND level >= 2 ORDER BY CAST(keeper AS INT) DESC, level DESC, CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT), id LIMIT 50")
def o7_picks_first(t) -> DataFrame:
    rows = selection.view(_known(t).drop("plates", "numbers").withColumns({"plates": F.array().cast("array<string>"), "numbers": F.array().cast("array<string>")}), "all", 2, None, " 7 ")
    return rows.orderBy(*selection.ordered(rows, "pick")).limit(50).select("id")


@query(f"""WITH {FRAMES}, l AS (SELECT job_id AS id, count(*) AS n, count(*) FILTER (WHERE status = 'error') AS bad FROM frames WHERE status <> 'done' AND coalesce(rejected, 0) = 0 AND coalesce(copy_of, 0) = 0 GROUP BY 1), j AS (SELECT DISTINCT job_id AS id FROM frames)
  SELECT j.id, CASE WHEN j.id = 2 THEN 'stopped' WHEN coalesce(n, 0) > 0 AND n = bad THEN 'done_errors' WHEN coalesce(n, 0) > 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN coalesce(n, 0) = 0 AND j.id % 2 = 0 THEN 'pick' ELSE 'scan' END AS resume FROM j LEFT JOIN l USING (id)""")
def p17_album_states(t) -> DataFrame:
    jobs = frames(t).select(F.col("job_id").alias("id")).distinct().withColumns({"stage": F.when(F.col("id") % 2 == 0, "pick").otherwise("done"), "stopped": F.col("id") == 2, "broken": F.lit(False)})
    return selection.album_states(jobs, frames(t)).select("id", "status", "resume")


@query(f"""WITH {FRAMES}, {SEEN}, r AS (SELECT s.*, f.path FROM seen s JOIN frames f ON f.id = s.image_id WHERE f.job_id = 6 AND coalesce(f.copy_of, 0) = 0 AND (coalesce(number, '') <> '' OR coalesce(plate, '') <> '' OR coalesce(attributes, '') NOT IN ('', '{{}}', 'null')))
  SELECT id, path AS frame_path, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r WHERE reviewed = 0) AS unreviewed FROM r ORDER BY reviewed, coalesce(number, '') = '' AND coalesce(plate, '') = '', image_id, id LIMIT 400""")
def o5_identified(t) -> DataFrame:
    first, total = selection.identified(seen(t), frames(t), 6)
    return first.select("id", "frame_path").join(F.broadcast(total.select("total", "unreviewed")))  # one row


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def o2_latest(t) -> DataFrame:
    return selection.latest(t("orders"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT count(*) AS n, bool_and(n_chars >= 500 AND n_chars < 900 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS fits FROM (SELECT * FROM documents WHERE n_chars >= 500 AND n_chars < 900 AND doc_id NOT IN (SELECT doc_id FROM labels) LIMIT 1)")
def o4_random_unlabelled(t) -> DataFrame:
    one = selection.random_unlabelled(t("documents"), t("labels"), ["doc_id"], "n_chars", 500, 900, 7)
    good = one.join(t("labels").select("doc_id", F.lit(1).alias("known")).distinct(), "doc_id", "left").select((F.col("known").isNull() & (F.col("n_chars") >= 500) & (F.col("n_chars") < 900)).alias("ok"))
    return good.agg(F.count("*").alias("n"), F.bool_and("ok").alias("fits"))


@query(f"WITH {FRAMES} SELECT id FROM frames ORDER BY coalesce(taken_at, 0), path LIMIT 300")
def o8_by_time(t) -> DataFrame:
    return selection.by_time(frames(t)).limit(300).select("id")


@query(f"""WITH {FRAMES}, {SEEN}, v AS (SELECT * FROM frames WHERE status = 'done' AND coalesce(copy_of, 0) = 0), s AS (SELECT job_id, count(*) AS subjects, count(*) FILTER (WHERE coalesce(s.number, '') <> '') AS numbers, count(*) FILTER (WHERE coalesce(s.plate, '') <> '') AS plates, count(*) FILTER (WHERE s.reviewed <> 0) AS reviewed,
  count(*) FILTER (WHERE coalesce(region_type, 'vehicle') = 'vehicle') AS cars, count(*) FILTER (WHERE region_type = 'person') AS people FROM seen s JOIN v ON v.id = s.image_id GROUP BY 1)
  SELECT v.job_id, count(*) AS frames, count(*) FILTER (WHERE stars > 0) AS starred, count(*) FILTER (WHERE picked = 1) AS picked, count(*) FILTER (WHERE rejected = 1) AS rejected, coalesce(any_value(subjects), 0) AS subjects, coalesce(any_value(numbers), 0) AS numbers, coalesce(any_value(plates), 0) AS plates,
  coalesce(any_value(s.reviewed), 0) AS reviewed, nullif(any_value(cars), 0) AS cars, nullif(any_value(people), 0) AS people FROM v LEFT JOIN s USING (job_id) GROUP BY v.job_id""")
def a19_summary(t) -> DataFrame:
    out = selection.summary(frames(t), seen(t))
    return out.withColumns({"cars": F.try_element_at("regions", F.lit("vehicle")), "people": F.try_element_at("regions", F.lit("person"))}).drop("regions")


@query(f"WITH {SEEN} SELECT coalesce(region_type, 'vehicle') AS region, count(*) AS n FROM seen GROUP BY 1")
def a14_region_counts(t) -> DataFrame:
    return selection.region_counts(seen(t), [])


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'fresh' ELSE 'known' END AS state, (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O') AS album FROM supplier""")
def s25_import_plan(t) -> DataFrame:
    found = t("supplier").select("s_suppkey", F.concat(F.lit("/in/"), F.col("s_suppkey").cast("string")).alias("path"))
    held = found.where("s_suppkey % 3 > 0").select("path")
    album, fresh, _ = selection.import_plan(t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/Root/"), "o_orderstatus").alias("root")), held, "/ROOT/o", found)
    marked = fresh.select("s_suppkey", F.lit("fresh").alias("state")).unionByName(found.join(fresh, "s_suppkey", "left_anti").select("s_suppkey", F.lit("known").alias("state")))
    return marked.join(F.broadcast(album))  # one row


@query(f"""WITH {SEEN}, b AS (SELECT image_id AS id, max(rating) FILTER (WHERE coalesce(region_type, 'vehicle') = 'vehicle') AS car, max(rating) FILTER (WHERE region_type = 'person') AS person, min(rating) FILTER (WHERE region_type = 'eye') AS eye, bool_or(panning <> 0) FILTER (WHERE coalesce(region_type, 'vehicle') IN ('vehicle', 'person')) AS pan FROM seen WHERE coalesce(bystander, 0) = 0 GROUP BY 1),
  f AS (SELECT o_orderkey AS id, o_orderkey % 100 / 100 AS sharpness, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 50 / 50 END AS pan_share, CASE WHEN o_orderkey % 9 = 0 THEN 0.9 END AS af FROM orders),
  r AS (SELECT f.*, b.id IS NULL AS bare, coalesce(eye, person, car, sharpness, 0) AS r, coalesce(pan, false) AND pan_share IS NOT NULL AS capped FROM f LEFT JOIN b USING (id)), c AS (SELECT *, CASE WHEN capped THEN least(r, greatest(0.728, least(1, 0.728 + pan_share * 0.28))) ELSE r END AS k FROM r)
  SELECT id, round(CASE WHEN bare THEN 0.1 WHEN af IS NULL THEN k ELSE greatest(k, af) END, 9) AS rating FROM c""")
def a30_frame_ratings(t) -> DataFrame:
    f = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100 / 100).alias("sharpness"), F.expr("case when o_orderkey % 4 = 0 then o_orderkey % 50 / 50D end").alias("pan_share"), F.expr("case when o_orderkey % 9 = 0 then 0.9D end").alias("af_sharpness"), F.lit(0.1).alias("rating"))
    return rating.frame_ratings(f, seen(t)).select("id", F.round("rating", 9).alias("rating"))


@query(f"WITH {SEEN} SELECT image_id AS id, max(rating) AS parked FROM seen WHERE af_bystander = 1 GROUP BY 1")
def a31_parked(t) -> DataFrame:
    return rating.parked_ratings(seen(t))


MISSED = f"""{SEEN}, f AS (SELECT o_orderkey AS id, o_custkey % 50 AS job_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 40 END AS time_burst, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 60 END AS burst_key, CASE WHEN o_orderkey % 31 = 0 THEN 1 END AS copy_of, 'done' AS status, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 100 / 100 END AS sharpness,
  CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 90 / 90 END AS sharpness_whole, CASE WHEN o_orderkey % 17 = 0 THEN 0.5 END AS af_sharpness FROM orders),
  held AS (SELECT DISTINCT image_id AS id FROM seen WHERE coalesce(bystander, 0) = 0 AND coalesce(region_type, 'vehicle') IN ('vehicle', 'person')), mates AS (SELECT f.* FROM f JOIN held USING (id) WHERE coalesce(copy_of, 0) = 0),
  missed AS (SELECT id FROM f WHERE burst_key IS NOT NULL AND sharpness_whole IS NOT NULL AND EXISTS (SELECT 1 FROM mates o WHERE o.job_id = f.job_id AND o.id <> f.id AND CASE WHEN o.time_burst IS NOT NULL AND f.time_burst IS NOT NULL THEN o.time_burst = f.time_burst ELSE o.burst_key = f.burst_key END))"""


def _measured(t) -> DataFrame:
    e = F.expr
    return t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("job_id"), e("case when o_orderkey % 5 > 0 then o_orderkey % 40 end").alias("time_burst"), e("case when o_orderkey % 7 > 0 then o_orderkey % 60 end").alias("burst_key"), e("case when o_orderkey % 31 = 0 then 1 end").alias("copy_of"), F.lit("done").alias("status"), e("case when o_orderkey % 11 > 0 then o_orderkey % 100 / 100D end").alias("sharpness"), e("case when o_orderkey % 13 > 0 then o_orderkey % 90 / 90D end").alias("sharpness_whole"), e("case when o_orderkey % 17 = 0 then 0.5D end").alias("af_sharpness"), F.lit(0.25).alias("rating"))


@query(f"WITH {MISSED} SELECT id FROM missed")
def j6_missed(t) -> DataFrame:
    return rating.missed_ids(_measured(t), seen(t))


@query(f"""WITH {MISSED}, p AS (SELECT image_id AS id, max(rating) AS parked FROM seen WHERE af_bystander = 1 GROUP BY 1), there AS (SELECT DISTINCT image_id AS id FROM seen WHERE coalesce(bystander, 0) = 0)
  SELECT f.id, CASE WHEN coalesce(copy_of, 0) = 0 AND (sharpness IS NOT NULL OR af_sharpness IS NOT NULL) AND there.id IS NULL THEN CASE WHEN af_sharpness IS NOT NULL THEN greatest(af_sharpness, coalesce(parked, CASE WHEN missed.id IS NOT NULL THEN sharpness_whole ELSE sharpness END, 0)) WHEN missed.id IS NOT NULL THEN sharpness_whole ELSE sharpness END ELSE 0.25 END AS rating
  FROM f LEFT JOIN missed USING (id) LEFT JOIN p USING (id) LEFT JOIN there USING (id)""")
def e4_rate_missed(t) -> DataFrame:
    return rating.rate_bare(_measured(t), seen(t)).select("id", "rating")


@query("SELECT event_id, CASE WHEN value / 100 >= 0.825 THEN 'sharp' WHEN value / 100 < 0.606 THEN 'blurred' ELSE 'soft' END AS rating_verdict, CASE WHEN value / 100 >= 0.958 THEN 5 WHEN value / 100 >= 0.825 THEN 4 WHEN value / 100 >= 0.728 THEN 3 WHEN value / 100 >= 0.606 THEN 2 ELSE 1 END AS engine_stars FROM events")
def e5_rerate(t) -> DataFrame:
    return rating.rerated(t("events").select("event_id", (F.col("value") / 100).alias("rating"))).select("event_id", "rating_verdict", "engine_stars")


@query("SELECT event_id, value < 60 AND (event_id % 10 = 0 OR abs(value / 100 - 0.606) < 0.06) AS doubtful, value < 60 AND event_id % 3 > 0 AS cullable, least(1, 0.728 + value / 100 * 0.28) AS cap FROM events")
def m11_doubt_and_caps(t) -> DataFrame:
    word, score = F.when(F.col("value") < 60, "poor").otherwise("good"), F.col("value") / 100
    return t("events").select("event_id", rating.doubtful(word, score, F.col("event_id") % 10 == 0, F.lit(False)).alias("doubtful"), rating.cullable(word, F.col("event_id") % 3 == 0).alias("cullable"), rating.pan_cap(score).alias("cap"))


BOXES = """boxes AS (SELECT l_orderkey AS image_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 17 ELSE 32 END AS cls, CASE WHEN l_linenumber % 3 = 2 THEN NULL ELSE 'vehicle' END AS region_type, CAST(l_partkey % 700 AS DOUBLE) AS x1, CAST(l_suppkey % 90 * 8 AS DOUBLE) AS y1,
  l_partkey % 700 + 20 + l_quantity * 4 AS x2, l_suppkey % 90 * 8 + 30 + l_tax * 3000 AS y2 FROM lineitem)"""
_SHARE = "greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0)"


def boxes(t) -> DataFrame:
    d = lambda c: c.cast("double")
    x1, y1 = d(F.col("l_partkey") % 700), d(F.col("l_suppkey") % 90 * 8)
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 20 + F.col("l_quantity") * 4).alias("x2"), (y1 + 30 + F.col("l_tax") * 3000).alias("y2"))
    return t("lineitem").select(F.col("l_orderkey").alias("image_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("id"), F.expr("case l_linenumber % 3 when 0 then 0 when 1 then 17 else 32 end").alias("cls"), F.expr("case when l_linenumber % 3 = 2 then null else 'vehicle' end").alias("region_type"), box.alias("box"))


@query(f"""WITH {BOXES}, m AS (SELECT p.image_id, p.id AS person, q.id AS ball, sqrt(pow(greatest(greatest(p.x1, q.x1) - least(p.x2, q.x2), 0), 2) + pow(greatest(greatest(p.y1, q.y1) - least(p.y2, q.y2), 0), 2)) / greatest(p.y2 - p.y1, p.x2 - p.x1) AS d FROM boxes p JOIN boxes q USING (image_id) WHERE p.cls = 0 AND q.cls = 32)
  SELECT image_id, person, round(d, 6) AS distance, d <= 1.5 AS in_play FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, person, ball) AS k FROM m) WHERE k = 1""")
def m13_ball(t) -> DataFrame:
    return framing.ball_contexts(boxes(t), "image_id").withColumn("distance", F.round("distance", 6))


_UNIT = "greatest(0, least(1, {}))"


@query(f"""WITH {BOXES}, m AS (SELECT p.image_id, p.id AS person, q.id AS animal, greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y1 + (q.y2 - q.y1) / 2) - greatest(p.y1 + (p.y2 - p.y1) / 2, q.y1), 0) / ((p.x2 - p.x1) * (p.y2 - (p.y1 + (p.y2 - p.y1) / 2))) AS overlap, (p.y1 + p.y2) / 2 < (q.y1 + q.y2) / 2 AS above, (q.y2 - q.y1) / (q.x2 - q.x1) AS aspect,
  ((p.x1 + p.x2) / 2 - (q.x1 + q.x2) / 2) / (q.x2 - q.x1) AS o, (p.y2 - q.y1) / (q.y2 - q.y1) AS feet, (p.y2 - p.y1) / (q.y2 - q.y1) AS share, ((p.y1 + p.y2) / 2 - q.y1) / (q.y2 - q.y1) AS seat FROM boxes p JOIN boxes q USING (image_id) WHERE p.cls = 0 AND q.cls = 17),
  g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY above DESC, overlap DESC, person, animal) AS k FROM m WHERE overlap >= 0.05 AND feet <= 0.8 AND share >= 0.2 AND abs(o) <= 0.5)
  SELECT image_id, person, animal, above, round((0.40 * {_UNIT.format("(aspect - 0.60) / 0.45")} + 0.30 * {_UNIT.format("(0.45 - seat) / 0.30")} + 0.20 * {_UNIT.format("(abs(o) - 0.05) / 0.30")} + 0.10 * {_UNIT.format("overlap")}) * CASE WHEN above THEN 1 ELSE 0.5 END, 6) AS buck FROM g WHERE k = 1""")
def j20_riders(t) -> DataFrame:
    return framing.riders(boxes(t), "image_id").select("image_id", "person", "animal", "above", F.round("buck", 6).alias("buck"))


@query(f"""WITH {BOXES}, b AS (SELECT *, least(x2, 1000) AS u, least(y2, 800) AS v FROM boxes), m AS (SELECT *, (u - x1) * (v - y1) / 800000 AS frac, (x1 + u) / 2000 AS nx, (y1 + v) / 1600 AS ny,
  CAST(x1 <= 20 AS INT) + CAST(y1 <= 16 AS INT) + CAST(x2 >= 980 AS INT) + CAST(y2 >= 784 AS INT) AS cuts, (1000 - u - x1) / 1000 AS lead FROM b),
  g AS (SELECT *, sqrt(least(pow(nx - 1/3, 2), pow(nx - 2/3, 2)) + least(pow(ny - 1/3, 2), pow(ny - 2/3, 2))) / sqrt(2) AS thirds, sqrt(least(pow(nx - 0.382, 2), pow(nx - 0.618, 2)) + least(pow(ny - 0.382, 2), pow(ny - 0.618, 2))) / sqrt(2) AS phi, sqrt(pow(nx - 0.5, 2) + pow(ny - 0.5, 2)) / sqrt(2) <= 0.05 AS centred, (nx - 0.5) * 2 AS bal FROM m),
  s AS (SELECT *, 1 - cuts / 4 AS t1, CASE WHEN frac < 0.02 THEN 1 - {_UNIT.format("(0.02 - frac) / 0.02")} WHEN frac > 0.6 THEN 1 - 0.5 * {_UNIT.format("(frac - 0.6) / 0.4")} ELSE 1 END AS t2, CASE WHEN centred THEN 1 ELSE {_UNIT.format("greatest(1 - thirds * 3, 1 - phi / 0.382)")} END AS t3, CASE WHEN NOT centred THEN {_UNIT.format("1 - greatest(abs(bal) - 0.25, 0) / 0.75")} END AS t5,
  CASE WHEN abs(lead) >= 0.1 THEN {_UNIT.format("1 - abs(lead - 0.34) / 0.66")} END AS t6, 1 - {_UNIT.format("(abs(id % 5 - 2) - 1.0) / 2.0")} AS t7 FROM g)
  SELECT id, cuts AS cut_sides, round(frac, 6) AS frac, round(thirds, 6) AS thirds, round((t1 * 0.3 + t2 * 0.2 + t3 * 0.1 + 1 * 0.1 + coalesce(t5 * 0.05, 0) + coalesce(t6 * 0.25, 0) + t7 * 0.05) / (0.3 + 0.2 + 0.1 + 0.1 + CASE WHEN t5 IS NULL THEN 0 ELSE 0.05 END + CASE WHEN t6 IS NULL THEN 0 ELSE 0.25 END + 0.05), 6) AS score FROM s""")
def m14_framing(t) -> DataFrame:
    """Single subjects that move to the right in a frame of 1000 x 800."""
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    given = dict(zip(framing.GIVEN, (F.lit(1000.0), F.lit(800.0), *[F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2")], F.lit(1.0), F.lit(0.0), F.lit(True), none), strict=True))
    rows = framing.framed(boxes(t).select("id", "box"), given, (F.col("id") % 5 - 2).cast("double"))
    return rows.select("id", "cut_sides", F.round("frac", 6).alias("frac"), F.round("thirds", 6).alias("thirds"), F.round("score", 6).alias("score"))


@query(f"""WITH {BOXES}, f AS (SELECT o_orderkey AS id, CAST(o_custkey % 900 AS DOUBLE) AS ax, CAST(o_orderkey % 700 AS DOUBLE) AS ay, CASE WHEN o_orderkey % 3 = 0 THEN 'grid' ELSE 'point' END AS kind, CASE WHEN o_orderkey % 10 > 0 THEN 0.5 END AS score, CASE WHEN o_orderkey % 8 = 0 THEN 700 ELSE 60 END AS w FROM orders),
  b AS (SELECT f.id, count(x1) AS n, bool_and((x2 - x1) * (y2 - y1) / 800000 < 0.05) AS small, bool_or(ax + w / 2 BETWEEN x1 AND x2 AND ay + w / 2 BETWEEN y1 AND y2) AS held, bool_or(ax + w / 2 BETWEEN x1 - 20 AND x2 + 20 AND ay + w / 2 BETWEEN y1 - 20 AND y2 + 20) AS near FROM f LEFT JOIN boxes ON image_id = f.id AND coalesce(region_type, 'vehicle') = 'vehicle' GROUP BY f.id)
  SELECT f.id, CASE WHEN NOT (w * w / 800000 <= 0.4 AND (kind = 'point' OR (n > 0 AND small))) THEN 'none' WHEN held THEN 'detection' WHEN near THEN 'detection' WHEN score IS NULL THEN 'none' ELSE 'area' END AS call FROM f JOIN b USING (id)""")
def m20_focus_calls(t) -> DataFrame:
    w = F.when(F.col("o_orderkey") % 8 == 0, 700).otherwise(60)
    x, y = (F.col("o_custkey") % 900).cast("double"), (F.col("o_orderkey") % 700).cast("double")
    f = t("orders").select(F.col("o_orderkey").alias("id"), F.lit(1000).alias("width"), F.lit(800).alias("height"), F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + w).alias("y2")).alias("af"), F.when(F.col("o_orderkey") % 3 == 0, "grid").otherwise("point").alias("af_kind"), F.when(F.col("o_orderkey") % 10 > 0, 0.5).alias("af_score"))
    return rating.focus_calls(f, boxes(t))


@query("""WITH p AS (SELECT event_id, value / 100 AS a, (event_id % 100) / 100 AS b, CASE WHEN event_id % 3 = 0 THEN 2 END AS s FROM events), l AS (SELECT *, CASE WHEN a >= 0.85 THEN 0.8 * coalesce(s / 3, 1) END AS la, CASE WHEN b >= 0.85 THEN 0.6 * coalesce(s / 3, 1) END AS lb FROM p)
  SELECT event_id, round(greatest(la, lb), 6) AS amount, CASE WHEN la IS NOT NULL AND (lb IS NULL OR la > lb) THEN 'jump' WHEN lb IS NOT NULL THEN 'smoke' END AS tag, CAST(round(4 * coalesce(greatest(la, lb), 0)) AS INT) AS bucket, CAST(a >= 0.5 AND a < 0.85 AS INT) + CAST(b >= 0.5 AND b < 0.85 AS INT) AS maybe FROM l""")
def m16_moments(t) -> DataFrame:
    """Answers to two questions and a strength, read into a verdict, its lift and its bucket."""
    answer = lambda noul, score: F.struct(noul.cast("double").alias("noul"), score.cast("double").alias("score"))
    none = F.lit(None)
    answers = F.map_from_arrays(F.array(F.lit("m_jump"), F.lit("m_smoke"), F.lit("strength")), F.array(answer(F.col("value") / 100, none), answer(F.col("event_id") % 100 / 100, none), answer(none, F.when(F.col("event_id") % 3 == 0, 2))))
    v = t("events").select("event_id", rating.moment_verdict(answers, ("jump", "smoke")).alias("v"))
    weights = F.create_map(F.lit("jump"), F.lit(0.8), F.lit("smoke"), F.lit(0.6))
    lift = v.withColumn("l", rating.moment_lift(F.col("v.readings"), weights, F.col("v.strength")))
    return lift.select("event_id", F.round("l.amount", 6).alias("amount"), "l.tag", rating.lift_bucket(F.col("l.amount")).alias("bucket"), F.size(rating.maybe_readings(F.col("v.readings"))).alias("maybe"))


@query("SELECT event_id, CASE WHEN c THEN -1 WHEN s IS NOT NULL THEN s WHEN r >= 0.958 THEN 5 WHEN r >= 0.825 THEN 4 WHEN r >= 0.728 THEN 3 WHEN r >= 0.606 THEN 2 ELSE 1 END AS stars, CASE WHEN c OR r < 0.606 THEN 'Red' WHEN r >= 0.825 THEN 'Green' ELSE 'Yellow' END AS label FROM (SELECT event_id, value / 100 AS r, CASE WHEN event_id % 6 = 0 THEN 4 END AS s, event_id % 5 = 0 OR (event_id % 6 > 0 AND event_id % 4 = 0) AS c FROM events)")
def m19_metadata(t) -> DataFrame:
    v = rating.metadata_verdict(F.col("event_id") % 5 == 0, F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 6 == 0, 4), F.col("value") / 100)
    return t("events").select("event_id", v["stars"].alias("stars"), v["label"].alias("label"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS m, l_suppkey % 4 AS d FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN d = 0 THEN 'Ford' WHEN d = 1 THEN CASE WHEN m = 1 THEN 'mazda ' ELSE 'Mazda' END WHEN m = 0 THEN 'Ford' WHEN m = 1 THEN 'mazda ' END AS make FROM v""")
def f10_correct_make(t) -> DataFrame:
    make = F.expr("case l_partkey % 3 when 0 then 'Ford' when 1 then 'mazda ' end")
    model = F.expr("case l_suppkey % 4 when 0 then 'XR6 Falcon' when 1 then 'old RX-7 Falcon' when 2 then 'Unknown' end")
    return t("lineitem").select("l_orderkey", "l_linenumber", vehicles.correct_make(make, model).alias("make"))


@query("""WITH w AS (SELECT p_partkey, upper(regexp_replace(left(p_name, 2), '[^A-Za-z0-9]', '', 'g')) || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || upper(left(p_type, p_partkey % 3)) AS k FROM part)
  SELECT p_partkey, k, regexp_full_match(k, '[A-Z]{3}[0-9]{2}[A-Z]|[A-Z]{3}[0-9]{3}|[0-9]{3}[A-Z]{3}|[A-Z][0-9]{3}[A-Z]{2}|[A-Z]{2}[0-9]{2}[A-Z]{2}|[0-9]{1,3}[A-Z]{1,3}[0-9]{1,3}|[0-9]{4,6}[A-Z]|[A-Z][0-9]{4,6}|[A-Z]{6}') AS plate FROM w""")
def f13_plate_formats(t) -> DataFrame:
    k = F.concat(F.upper(F.regexp_replace(F.left("p_name", F.lit(2)), "[^A-Za-z0-9]", "")), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.upper(F.left(F.col("p_type"), (F.col("p_partkey") % 3).cast("int"))))
    return t("part").select("p_partkey", k.alias("k"), vehicles.looks_like_plate(k).alias("plate"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || '|#' || p_partkey || '|Car ' || p_partkey || '|' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'AB' || p_partkey || '|' ELSE '' END || p_brand || CASE WHEN p_partkey % 5 > 0 THEN '|' || p_type || '|' || p_brand || ' ' || p_type ELSE '' END || '|Motorsport' AS words,
  CASE WHEN p_partkey % 2 = 0 THEN '#' || p_partkey || ' ' ELSE '' END || p_brand || CASE WHEN p_partkey % 5 > 0 THEN ' ' || p_type ELSE '' END AS title FROM part""")
def f16_keywords(t) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    flag = lambda c: c.cast("boolean")
    none = F.lit(None).cast("string")
    v = F.struct(
        F.when(F.col("p_partkey") % 2 == 0, n).alias("race_number"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("AB"), n)).alias("plate"), none.alias("plate_state"), F.col("p_brand").alias("make"), none.alias("colour"), F.lit(" ").alias("body_type"), F.col("p_type").alias("model"), (F.col("p_partkey") % 5 == 0).alias("model_suggested"),
        F.lit("Team").alias("team"), flag(F.lit(False)).alias("team_corroborated"), none.alias("number_source"), F.array(F.lit(" "), F.upper(F.col("p_brand"))).alias("sponsors"), F.lit(True).alias("is_competition"), F.lit(False).alias("is_bike"), F.lit("car").alias("kind"),
    )
    return t("part").select("p_partkey", F.array_join(vehicles.keywords(v, F.lit(None).cast("array<string>")), "|").alias("words"), vehicles.title(v).alias("title"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN 'M S1' WHEN 1 THEN 'M + L' WHEN 2 THEN 'S1' ELSE 'folder' END AS camera, CASE k WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 0 END AS stars, k = 1 AS rejected FROM e""")
def f24_camera_and_cull(t) -> DataFrame:
    k = F.col("event_id") % 4
    tags = F.map_filter(F.create_map(F.lit("Model"), F.when(k < 2, "M").when(k == 2, "-"), F.lit("SerialNumber"), F.when((k == 0) | (k == 2), "S1"), F.lit("LensModel"), F.when(k == 1, "L"), F.lit("Rating"), F.when(k == 0, " 4.9 ").when(k == 1, "-1.5").when(k == 2, "none"), F.lit("XMP:Rating"), F.when(k == 3, "-0.5")), lambda a, b: b.isNotNull())
    cull = vehicles.cull_of(tags)
    return t("events").select("event_id", vehicles.camera_of(tags, F.lit("folder")).alias("camera"), cull["rating"].alias("stars"), cull["rejected"].alias("rejected"))


@query("""WITH k AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS x, lower(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS y FROM part)
  SELECT p_partkey, x AS key, (least(length(x), length(y)) >= 4 AND (contains(x, y) OR contains(y, x))) OR 1 - levenshtein(x, y) / greatest(length(x), length(y)) >= 0.85 AS same FROM k""")
def f23_sponsors(t) -> DataFrame:
    return t("part").select("p_partkey", vehicles.sponsor_key(F.col("p_name")).alias("key"), vehicles.same_sponsor(F.col("p_name"), F.col("p_type")).alias("same"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 19800 AS shifted, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def d4_iso(t) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    seconds = D.epoch_of_iso(F.concat(text, F.lit("Z")))
    return t("events").select("event_id", seconds.alias("seconds"), D.epoch_of_iso(F.concat(text, F.lit(".25+05:30"))).alias("shifted"), D.iso_of_epoch(seconds).alias("iso"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) / 1e6 + CASE event_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 0 END AS taken FROM events")
def d2_taken_at(t) -> DataFrame:
    stamp, k = F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.col("event_id") % 3
    tags = F.map_filter(F.create_map(F.lit("SubSecDateTimeOriginal"), F.when(k == 0, F.concat(stamp, F.lit(".5+10:00"))), F.lit("DateTimeOriginal"), F.when(k > 0, stamp), F.lit("SubSecTimeOriginal"), F.when(k < 2, "25").otherwise("-")), lambda a, b: b.isNotNull())
    return t("events").select("event_id", D.taken_at(tags).alias("taken"))


@query("SELECT p_partkey, bit_count(xor(p_partkey, 5)) AS bits, 36 AS bins FROM part")
def y3_signatures(t) -> DataFrame:
    sig = vehicles.signature_of(F.concat(F.lit("0x"), F.hex("p_partkey"), F.lit(":"), F.array_join(F.array_repeat(F.lit("0.5"), 36), ",")))
    return t("part").select("p_partkey", N.hamming(sig["shape"], F.lit(5).cast("long")).alias("bits"), F.size(sig["colours"]).alias("bins"))


@query("SELECT event_id, 'a' AS first, value / 100 AS p, CAST(2 AS INT) AS n FROM events")
def y9_bars(t) -> DataFrame:
    bars = vehicles.probability_bars(F.concat(F.lit('{"b": 0.5, "c": null, "a": '), (F.col("value") / 100).cast("string"), F.lit("}")))
    return t("events").select("event_id", bars[0]["option"].alias("first"), bars[0]["p"].alias("p"), F.size(bars).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE event_type END AS make, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE event_type END AS own_make FROM events")
def y7_own_readings(t) -> DataFrame:
    cols = {"make": F.col("event_type"), "own_make": F.when(F.col("event_id") % 3 == 0, "own").otherwise(" ")} | {k: F.lit(None).cast("string") for k in ("model", "colour", "own_model", "own_colour")}
    return t("events").select("event_id", vehicles.own_readings(cols)["make"].alias("make"), vehicles.remembered(cols)["own_make"].alias("own_make"))


@query("SELECT event_id, event_id % 5 IN (1, 3) AS something, CASE event_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'True' WHEN 2 THEN '' WHEN 3 THEN '7' ELSE '[]' END AS text FROM events")
def f21_json_truth(t) -> DataFrame:
    raw = F.expr("""case event_id % 5 when 0 then 'null' when 1 then 'true' when 2 then '""' when 3 then '7' else '[]' end""")
    return t("events").select("event_id", vehicles.truthy(raw).alias("something"), vehicles.json_text(raw).alias("text"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j7_without(t) -> DataFrame:
    return linkage.without(t("customer"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", F.col("o_orderstatus") == "F").select("c_custkey")


@query("""WITH g AS (SELECT lower('/shoot/' || (event_id % 300) || '.jpg') AS k, arg_max(event_type, event_id) AS camera FROM events GROUP BY 1) SELECT event_id, coalesce(camera, CAST(user_id AS VARCHAR)) AS camera FROM events LEFT JOIN g ON k = '/shoot/' || event_id || '.jpg'""")
def j12_annotate(t) -> DataFrame:
    given = t("events").select(F.concat(F.lit("\\SHOOT//"), (F.col("event_id") % 300).cast("string"), F.lit(".JPG")).alias("path"), F.col("event_type").alias("camera"), F.col("event_id").alias("seq"))
    return linkage.annotate(frames(t).select(F.col("id").alias("event_id"), "path", "camera"), given, ["camera"]).select("event_id", "camera")


@query("""WITH e AS (SELECT s_suppkey AS n, s_name FROM supplier) SELECT p_partkey, s_name AS entry FROM part LEFT JOIN e ON n = p_partkey % 200""")
def j16_entry_by_number(t) -> DataFrame:
    rows = t("part").select("p_partkey", F.concat(F.lit("#00"), (F.col("p_partkey") % 200).cast("string")).alias("number"))
    entries = t("supplier").select(F.col("s_suppkey").cast("string").alias("number"), "s_name", F.col("s_suppkey").alias("seq"))
    return linkage.entry_of_number(rows, entries, "number", "seq").select("p_partkey", F.col("entry.s_name").alias("entry"))


@query("""WITH p AS (SELECT event_id, user_id, 'p' || (event_id % 500) AS path, CASE WHEN event_id % 7 = 0 THEN 9 ELSE event_id % 5 END AS rating FROM events), ph AS (SELECT 'p' || (event_id % 400) AS path, min(event_id) AS photo FROM events WHERE event_id % 3 > 0 GROUP BY 1)
  SELECT event_id, CASE WHEN rating > 5 THEN 'skipped' WHEN photo IS NULL THEN 'missing' WHEN row_number() OVER (PARTITION BY p.path ORDER BY event_id) > 1 THEN 'skipped' ELSE 'matched' END AS status, photo FROM p LEFT JOIN ph USING (path)""")
def j21_classified(t) -> DataFrame:
    entries = t("events").select("event_id", F.concat(F.lit("P"), (F.col("event_id") % 500).cast("string")).alias("path"), F.when(F.col("event_id") % 7 == 0, 9).otherwise(F.col("event_id") % 5).alias("rating"), F.lit(None).cast("int").alias("pick"))
    photos = t("events").select(F.col("event_id").alias("id"), F.concat(F.lit("p"), (F.col("event_id") % 400).cast("string")).alias("path"), (F.col("event_id") % 3 == 0).alias("virtual"))
    return linkage.classify_entries(entries, photos, "event_id").select("event_id", "status", "photo")


@query("SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN '/a/' || min(event_type) END AS parent FROM events GROUP BY user_id")
def j22_common_parent(t) -> DataFrame:
    paths = t("events").select("user_id", F.concat(F.lit("/a/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("path"))
    return linkage.common_parent(paths, ["user_id"])


@query("""SELECT s_nationkey, count(*) FILTER (WHERE k IS NOT NULL) AS read FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 4 > 0 THEN 1 END AS k FROM supplier) GROUP BY 1""")
def u1_union_of_candidates(t) -> DataFrame:
    some = t("supplier").where("s_suppkey % 4 > 0").select("s_nationkey", F.lit(1).alias("k"))
    rest = t("supplier").where("s_suppkey % 4 = 0").select("s_nationkey", F.lit(None).cast("int").alias("k"))
    return some.unionByName(rest).groupBy("s_nationkey").agg(F.count("k").alias("read"))


@query("WITH s AS (SELECT o_custkey AS c, list(DISTINCT o_orderstatus) AS f FROM orders GROUP BY 1) SELECT a.c AS a, a.c + 1 AS b, NOT list_has_any(a.f, b.f) AS apart FROM s a JOIN s b ON b.c = a.c + 1")
def u4_disjoint(t) -> DataFrame:
    s = t("orders").groupBy(F.col("o_custkey").alias("a")).agg(F.collect_set("o_orderstatus").alias("f"))
    return s.join(s.select((F.col("a") - 1).alias("a"), F.col("f").alias("g")), "a").select("a", (F.col("a") + 1).alias("b"), (~F.arrays_overlap("f", "g")).alias("apart"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def u6_sorted_distinct(t) -> DataFrame:
    return t("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("types"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 100 FROM nation EXCEPT SELECT s_nationkey + 100 FROM supplier WHERE s_nationkey > 3)")
def u7_set_operations(t) -> DataFrame:
    k = lambda name, c, more=0: t(name).select((F.col(c) + more).alias("k"))
    return k("customer", "c_nationkey").intersect(k("supplier", "s_nationkey")).unionAll(k("nation", "n_nationkey", 100).subtract(t("supplier").where("s_nationkey > 3").select((F.col("s_nationkey") + 100).alias("k"))))


@query("SELECT l_linestatus AS model, avg(CASE WHEN l_tax > 0.07 THEN 0 ELSE l_discount END) AS score, coalesce(avg(CASE WHEN l_tax > 0.07 THEN 0 ELSE l_discount END) FILTER (WHERE l_quantity > 25), 0) AS sharp_score, coalesce(avg(CASE WHEN l_tax > 0.07 THEN 0 ELSE l_discount END) FILTER (WHERE l_quantity <= 25), 0) AS blurry_score, avg(l_quantity) FILTER (WHERE l_tax <= 0.07) AS avg_secs, count(*) FILTER (WHERE l_tax > 0.07) AS errors FROM lineitem GROUP BY 1")
def a33_model_benchmark(t) -> DataFrame:
    rows = t("lineitem").select(F.col("l_linestatus").alias("model"), F.expr("case when l_tax <= 0.07 then l_discount end").alias("score"), (F.col("l_quantity") > 25).alias("sharp"), F.col("l_quantity").alias("seconds"))
    return evaluate.model_benchmark(rows)


@query("SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) / 2 AS score FROM events")
def g17_item_scores(t) -> DataFrame:
    make = evaluate.field_score(F.lit("Ford-X"), F.when(F.col("event_id") % 3 == 0, " fordx").otherwise("Opel"), True)
    model = evaluate.field_score(F.lit("Strasse"), F.when(F.col("event_id") % 2 == 0, "straße"))
    return t("events").select("event_id", evaluate.item_score([make, model, evaluate.field_score(F.lit(" "), F.lit("x"))]).alias("score"))


@query("""WITH b AS (SELECT *, count(*) OVER w AS n, max(l_quantity) OVER w AS top, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) OVER w AS mine FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)),
  g AS (SELECT l_orderkey, any_value(n) AS n, any_value(top) AS top, any_value(mine) AS mine, count(*) FILTER (WHERE l_quantity = top) AS at_top, count(*) FILTER (WHERE l_quantity > mine) AS above, count(*) FILTER (WHERE l_quantity = mine) AS same FROM b WHERE mine IS NOT NULL GROUP BY 1),
  s AS (SELECT CASE WHEN mine = top THEN 1 / at_top ELSE 0 END AS hit, 1 / n AS base, CASE WHEN n > 1 THEN (above + (same - 1) / 2) / (n - 1) ELSE 0.5 END AS pct FROM g)
  SELECT 'l_quantity' AS key, count(*) AS groups, round(avg(hit), 9) AS hit, round(avg(base), 9) AS chance, round(avg(pct), 9) AS percentile, round(avg(hit - base) / (stddev_samp(hit - base) / sqrt(count(*))), 6) AS z FROM s""")
def g15_key_report(t) -> DataFrame:
    out = evaluate.key_report(t("lineitem").withColumn("true", F.col("l_linenumber") == 2), ["l_orderkey"], ["l_quantity"], "true")
    return out.select("key", "groups", *[F.round(c, 9).alias(c) for c in ("hit", "chance", "percentile")], F.round("z", 6).alias("z"))


@query()
def g14_bootstrap(t) -> DataFrame:
    hits = t("labels").select("doc_id", F.col("toxic").cast("double").alias("hit"))
    return evaluate.bootstrap_interval(hits, "hit", "doc_id", rounds=500)


@query()
def g13_choice(t) -> DataFrame:
    rows = t("lineitem").withColumn("y", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(F.col("l_quantity") - 100 * F.col("l_discount")), "l_linenumber")) == 1)
    rows = rows.select("l_orderkey", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), "y")
    weights = evaluate.fit_choice(rows, ["l_orderkey"], ["q", "d"], "y", rate=0.2)
    return rows.sparkSession.createDataFrame([(n, float(w)) for n, w in zip(("q", "d"), weights, strict=True)], "name string, weight double")


@query()
def g24_fuzzy(t) -> DataFrame:
    rows = t("part").select("p_partkey", F.split("p_name", " ").alias("said"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("truth"))
    return evaluate.fuzzy_matches(rows, "p_partkey", "said", "truth")


@query()
def g25_merge_sweep(t) -> DataFrame:
    bursts = sequence.bursts(sessions(t), ["user_id", "session"], "taken", "event_id").select("user_id", F.col("session").alias("burst"), "started", "ended", "n")
    members = sessions(t).select("user_id", F.col("session").alias("burst"), (F.col("event_id") % 5 == 0).alias("exported"))
    rules = bursts.sparkSession.createDataFrame([("near", 20_000.0, 60_000.0), ("far", 40_000.0, 200_000.0)], "rule string, gap double, span double")
    return evaluate.merge_sweep(bursts, members, "user_id", rules, F.lit(True))


@query("""WITH b AS (SELECT l_suppkey % 7 AS shoot, l_orderkey AS place, l_orderkey * 10 + l_linenumber AS id, l_discount * 10 AS conf, l_quantity / 60 AS f, row_number() OVER (PARTITION BY l_suppkey % 7, l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM lineitem WHERE l_discount * 10 >= 0.5 AND l_quantity / 60 BETWEEN 0.03 AND 0.6) SELECT shoot, place, id FROM b WHERE k = 1""")
def g27_best_subjects(t) -> DataFrame:
    rows = t("lineitem").select((F.col("l_suppkey") % 7).alias("shoot"), F.col("l_orderkey").alias("place"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_discount") * 10).alias("conf"), (F.col("l_quantity") / 60).alias("box_fraction"), F.lit("vehicle").alias("region"))
    return evaluate.best_subjects(rows, "shoot", "place").select("shoot", "place", "id")


@query("""WITH RECURSIVE c AS (SELECT l_suppkey % 7 AS shoot, l_orderkey AS place FROM lineitem GROUP BY 1, 2), k AS (SELECT shoot, min(place) AS place FROM c GROUP BY 1 UNION ALL SELECT k.shoot, (SELECT min(c.place) FROM c WHERE c.shoot = k.shoot AND c.place >= k.place + 400) FROM k WHERE k.place IS NOT NULL) SELECT shoot, place FROM k WHERE place IS NOT NULL""")
def g27_spaced(t) -> DataFrame:
    places = t("lineitem").select((F.col("l_suppkey") % 7).alias("shoot"), F.col("l_orderkey").alias("place")).distinct()
    return evaluate.spaced(places, "shoot", "place", 400)


@query("WITH c AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_brand, p_partkey FROM c WHERE n <= 3 OR p IN (0, round_even((n - 1) / 2, 0), n - 1)")
def g27_even_sample(t) -> DataFrame:
    return evaluate.even_sample(t("part"), ["p_brand"], ["p_partkey"], 3).select("p_brand", "p_partkey")


@query("SELECT event_id, CAST(CASE WHEN value / 100 > 1 - value / 100 THEN 1 ELSE 0 END AS INT) AS best, round(value / 100, 9) AS expectation, round(greatest(value / 100, 1 - value / 100) * 2 - 1, 9) AS confidence FROM events")
def g28_answers(t) -> DataFrame:
    p = F.col("value") / 100
    s = evaluate.answer_summary(F.array(1 - p, p))
    return t("events").select("event_id", s["best"].alias("best"), F.round(s["expectation"], 9).alias("expectation"), F.round(s["confidence"], 9).alias("confidence"))


@query()
def g4_signatures(t) -> DataFrame:
    e = t("embeddings").where("embedding is not null")
    shape = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), i % 30).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x))
    rows = e.select((F.col("vec_id") % 20).alias("album"), F.col("vec_id").alias("det"), (F.col("vec_id") / 2).cast("long").alias("frame"), (F.col("vec_id") % 100).alias("burst"), shape.alias("shape"), F.array(F.lit(0.5), F.lit(0.5)).alias("colours"), F.col("label").cast("string").alias("cls"), F.lit(None).cast("string").alias("make"), F.when(F.col("vec_id") % 50 < 2, F.lit("AB12")).alias("plate"), F.lit(None).cast("struct<h:double,s:double,v:double>").alias("paint"))
    return clusters.cluster_by_signature(rows, "album", bits=8)


@query()
def g6_consolidate(t) -> DataFrame:
    rows = t("embeddings").where("embedding is not null").select((F.col("vec_id") % 5).alias("album"), (F.col("vec_id") % 50).alias("burst"), F.col("vec_id").alias("frame"), F.col("vec_id").alias("det"), F.lit("car").alias("cls"), "embedding", F.when(F.col("vec_id") % 40 == 0, "XY99").alias("plate"), F.lit(0.5).alias("plate_conf"), F.concat(F.lit("M"), F.col("label").cast("string")).alias("make"), F.lit("Z").alias("model"))
    return identity.consolidate(rows, "album", 0.3).select("album", "det", "group_key", "group_size", "group_agreement", "make", "model", "own_make", "plate")


@query(f"""WITH {SESSIONS}, m AS (SELECT min(taken) OVER (PARTITION BY user_id, session) AS a, event_id, user_id, session FROM sessions) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, max(event_id) AS last FROM m GROUP BY 1, 2 HAVING count(*) >= 2""")
def w3_long_bursts(t) -> DataFrame:
    return sessions(t).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).where("n >= 2")


@query("SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS quarter, round(cume_dist() OVER (PARTITION BY user_id ORDER BY value), 9) AS upto, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY value, event_id) AS second FROM events")
def w22_windows(t) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    return t("events").select("event_id", F.ntile(4).over(w).alias("quarter"), F.round(F.cume_dist().over(Window.partitionBy("user_id").orderBy("value")), 9).alias("upto"), F.nth_value("event_id", 2).over(w).alias("second"))


@query(f"WITH {SEEN} SELECT id, CASE WHEN image_id % 2 = 0 THEN NULL ELSE cull_reason END AS cull_reason, CASE WHEN image_id % 2 = 1 THEN group_agreement END AS group_agreement FROM seen")
def e7_clear(t) -> DataFrame:
    albums = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("job_id"))
    return mutations.clear_groups(mutations.clear_culls(seen(t), albums, 0), albums, 0).select("id", "cull_reason", "group_agreement")


@query(f"WITH {FRAMES} SELECT id, CASE WHEN job_id = 4 THEN NULL ELSE copy_of END AS copy_of FROM frames")
def g9_restore(t) -> DataFrame:
    return clusters.restore_copies(frames(t), 4).select("id", "copy_of")


@query("SELECT p_partkey, p_name || '.xmp' AS sidecar, p_name AS stem, p_partkey % 97 = 0 AS settled, CASE WHEN p_partkey % 3 = 0 THEN 'red' WHEN p_partkey % 3 = 1 THEN 'blue' END AS colour FROM part")
def f19_names(t) -> DataFrame:
    path = F.concat("p_name", F.lit(".cr3"))
    word = F.when(F.col("p_partkey") % 3 == 0, "A RED one").when(F.col("p_partkey") % 3 == 1, "blue, red").otherwise("none")
    return t("part").select("p_partkey", X.sidecar(path).alias("sidecar"), X.file_stem(path).alias("stem"), (F.col("p_partkey") % 97 == 0).alias("settled"), X.colour_label(word).alias("colour"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS near, CASE WHEN p_partkey % 3 = 1 THEN true WHEN p_partkey % 3 = 2 THEN false END AS verdict, p_partkey % 2 = 0 AS same FROM part")
def f3_plates(t) -> DataFrame:
    mine = F.concat(F.lit("AB"), F.col("p_partkey").cast("string"), F.lit("0"))
    other = F.concat(F.when(F.col("p_partkey") % 3 == 2, "XY").otherwise("AB"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "O").otherwise("0"))
    return t("part").select("p_partkey", X.near_plate(mine, other).alias("near"), X.plate_verdict(mine, F.array(other)).alias("verdict"), X.same_make(F.lit("Land-Rover"), F.when(F.col("p_partkey") % 2 == 0, "LAND ROVER").otherwise("Ford")).alias("same"))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 5))), 5) AS total FROM embeddings WHERE embedding IS NOT NULL")
def y1_embedding_text(t) -> DataFrame:
    back = N.embedding_of(N.embedding_text(F.col("embedding")))
    return t("embeddings").where("embedding is not null").select("vec_id", F.size(back).cast("long").alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"""WITH {BOXES} SELECT p.id AS a, q.id AS b, round({_SHARE} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) - {_SHARE}), 9) AS iou, round({_SHARE} / ((p.x2 - p.x1) * (p.y2 - p.y1)), 9) AS covered, round(sqrt(pow(greatest(greatest(p.x1, q.x1) - least(p.x2, q.x2), 0), 2) + pow(greatest(greatest(p.y1, q.y1) - least(p.y2, q.y2), 0), 2)), 6) AS gap FROM boxes p JOIN boxes q USING (image_id) WHERE p.cls = 0 AND q.cls = 17""")
def m5_boxes(t) -> DataFrame:
    b = boxes(t)
    met = b.where("cls = 0").select("image_id", F.col("id").alias("a"), F.col("box").alias("p")).join(b.where("cls = 17").select("image_id", F.col("id").alias("b"), F.col("box").alias("q")), "image_id")
    return met.select("a", "b", F.round(N.iou("p", "q"), 9).alias("iou"), F.round(framing.covered(F.col("p"), F.col("q")), 9).alias("covered"), F.round(framing.box_gap(F.col("p"), F.col("q")), 6).alias("gap"))


@query(f"WITH {BOXES} SELECT id, CAST(x1 <= 0 AS INT) + CAST(y1 <= 0 AS INT) + CAST(x2 >= 800 AS INT) + CAST(y2 >= 700 AS INT) AS sides, round(1 - 0.6 * (CAST(x1 <= 0 AS INT) + CAST(y1 <= 0 AS INT) + CAST(x2 >= 800 AS INT) + CAST(y2 >= 700 AS INT)) / 4, 6) AS factor FROM boxes")
def m6_clipping(t) -> DataFrame:
    c = N.clipping("box", F.lit(800.0), F.lit(700.0))
    return boxes(t).select("id", c["sides"].alias("sides"), F.round(c["factor"], 6).alias("factor"))


@query("SELECT event_id, round(greatest(0, least(1, 1 - (least(CAST(trunc(value * 2) AS INT), 100) + least(255 - CAST(trunc(value * 2) AS INT), 155)) / 255)), 9) AS far, round(greatest(0, least(1, ln(value + 1) / ln(100.0))), 6) AS share FROM events")
def m3_histograms(t) -> DataFrame:
    v = (F.col("value") * 2).cast("int")
    return t("events").select("event_id", F.round(N.histogram_distance(F.array(v, 255 - v), F.array(F.lit(100), F.lit(155))), 9).alias("far"), F.round(N.log_normal(F.col("value") + 1, 1.0, 100.0), 6).alias("share"))


@query(f"WITH {FRAMES} SELECT id FROM frames WHERE status = 'done' AND id NOT IN (SELECT doc_id FROM documents)")
def t6_resumed_pass(t) -> DataFrame:
    from ..streaming.watch import unfinished

    return unfinished(frames(t).where("status = 'done'").select("id"), t("documents").select(F.col("doc_id").alias("id")), "id")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'interrupted' WHEN 'P' THEN 'interrupted' ELSE o_orderstatus END AS status FROM orders")
def e8_reconcile(t) -> DataFrame:
    return mutations.reconcile(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), ("O", "P"))


@query("WITH m AS (SELECT max(event_id) AS m FROM events) SELECT event_id FROM events, m WHERE event_id < m")
def s24_undo(t) -> DataFrame:
    return mutations.undo_last(t("events").select("event_id"), "event_id")


@query("""WITH c AS (SELECT l_orderkey AS image, l_linenumber AS id, l_partkey AS k, l_quantity AS conf FROM lineitem), r AS (SELECT l_suppkey AS k, max(l_orderkey) AS best, bool_or(l_returnflag = 'R') AS sent FROM lineitem GROUP BY 1) SELECT k, best AS l_orderkey, sent FROM r""")
def g18_survivors(t) -> DataFrame:
    rows = t("lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("sent"), F.array("l_linestatus").alias("drives"))
    return clusters.survivors(rows, ["k"], [F.desc("l_orderkey"), F.col("l_linenumber")], ["sent"], ["drives"]).select("k", "l_orderkey", "sent")


@query("SELECT event_id, round(1 / (1 + exp(-(0.02 * value - 0.5 * (event_id % 3) + 0.1))), 9) AS p FROM events")
def g12_linear_head(t) -> DataFrame:
    rows = t("events").withColumn("k", (F.col("event_id") % 3).cast("double"))
    return rows.select("event_id", F.round(evaluate.logistic({"value": 0.02, "k": -0.5}, 0.1), 9).alias("p"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL), l AS (SELECT label, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x FROM v), m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x) AS x FROM l GROUP BY 1, 2) GROUP BY 1)
  SELECT vec_id, round(list_cosine_similarity(e, m), 6) AS similarity FROM v JOIN m USING (label)""")
def w19_similarity_to_mean(t) -> DataFrame:
    return clusters.similarity_to_mean(t("embeddings").where("embedding is not null"), "label", "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT p_size, winner, forms FROM (SELECT p_size, lower(p_brand) AS k, count(*) AS n, min(p_brand) AS winner, count(*) OVER (PARTITION BY p_size) AS forms, sum(count(*)) OVER (PARTITION BY p_size) AS total, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, min(p_partkey)) AS r FROM part GROUP BY p_size, lower(p_brand)) WHERE r = 1 AND n / total >= 0.7 UNION ALL SELECT p_size, NULL, forms FROM (SELECT p_size, count(*) AS n, count(*) OVER (PARTITION BY p_size) AS forms, sum(count(*)) OVER (PARTITION BY p_size) AS total, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, min(p_partkey)) AS r FROM part GROUP BY p_size, p_brand) WHERE r = 1 AND n / total < 0.7")
def a28_settled(t) -> DataFrame:
    return identity.settle_reading(t("part"), "p_size", "p_brand", "p_partkey")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY 1, 2) WHERE k <= 2")
def o9_ranked_values(t) -> DataFrame:
    return votes.ranked_values(t("events"), "user_id", F.col("event_type"), "event_id").where("place <= 2").select("user_id", F.col("value").alias("event_type"), "n")


@query("SELECT p_partkey, round(CASE WHEN wide = 0 THEN 0 WHEN r >= g AND r >= b THEN ((g - b) / wide + 6) / 6 % 1 WHEN g >= b THEN (2 + (b - r) / wide) / 6 ELSE (4 + (r - g) / wide) / 6 END, 6) AS h FROM (SELECT *, greatest(r, g, b) - least(r, g, b) AS wide FROM (SELECT p_partkey, CAST((p_partkey * 37) % 256 AS DOUBLE) AS r, CAST((p_partkey * 59) % 256 AS DOUBLE) AS g, CAST((p_partkey * 83) % 256 AS DOUBLE) AS b FROM part))")
def m7_hue(t) -> DataFrame:
    colour = moments.hsv(F.format_string("#%02x%02x%02x", F.col("p_partkey") * 37 % 256, F.col("p_partkey") * 59 % 256, F.col("p_partkey") * 83 % 256))
    return t("part").select("p_partkey", F.round(colour["h"], 6).alias("h"))


REPORT = f"""{FRAMES}, fr AS (SELECT *, id * 1000 AS file_size, burst_key AS time_burst, CASE WHEN id % 4 > 0 THEN id % 10 / 20 END AS af_x1, id % 7 / 20 AS af_y1, 0.6 AS af_x2, 0.7 AS af_y2, CASE WHEN id % 3 = 0 THEN id % 100 / 100 END AS af_sharpness, 1000 AS width, 800 AS height FROM frames),
  su AS (SELECT l_orderkey AS image_id, CASE l_linenumber % 4 WHEN 0 THEN 'person' WHEN 3 THEN 'eye' END AS region_type, CASE WHEN l_linenumber % 3 = 0 THEN 1 END AS panning, CASE WHEN l_quantity > 48 THEN 1 END AS burst_pick, CASE WHEN l_quantity > 40 THEN 'sharp' WHEN l_quantity < 10 THEN 'blurred' ELSE 'soft' END AS sharpness_verdict,
    CASE WHEN l_linenumber = 2 THEN CAST(trunc(l_quantity) AS INT) % 6 END AS stars, l_partkey % 700 AS x1, l_suppkey % 70 * 10 AS y1, l_partkey % 700 + 300 AS x2, l_suppkey % 70 * 10 + 100 AS y2 FROM lineitem),
  v AS (SELECT * FROM fr WHERE status = 'done' AND coalesce(copy_of, 0) = 0)"""


def _report(t) -> tuple[DataFrame, DataFrame]:
    e = F.expr
    f = frames(t).withColumns({"file_size": F.col("id") * 1000, "time_burst": F.col("burst_key"), "af_x1": e("case when id % 4 > 0 then id % 10 / 20D end"), "af_y1": e("id % 7 / 20D"), "af_x2": F.lit(0.6), "af_y2": F.lit(0.7), "af_sharpness": e("case when id % 3 = 0 then id % 100 / 100D end"), "width": F.lit(1000), "height": F.lit(800)})
    x, y = F.col("l_partkey") % 700, F.col("l_suppkey") % 70 * 10
    s = t("lineitem").select(F.col("l_orderkey").alias("image_id"), e("case l_linenumber % 4 when 0 then 'person' when 3 then 'eye' end").alias("region_type"), e("case when l_linenumber % 3 = 0 then 1 end").alias("panning"), e("case when l_quantity > 48 then 1 end").alias("burst_pick"), e("case when l_quantity > 40 then 'sharp' when l_quantity < 10 then 'blurred' else 'soft' end").alias("sharpness_verdict"), e("case when l_linenumber = 2 then cast(l_quantity as int) % 6 end").alias("stars"), x.alias("x1"), y.alias("y1"), (x + 300).alias("x2"), (y + 100).alias("y2"))
    return f, s


@query(f"""WITH {REPORT}, p AS (SELECT image_id AS id, max(coalesce(panning, 0)) AS pan, max(coalesce(burst_pick, 0)) AS pick, count(*) FILTER (WHERE sharpness_verdict = 'blurred') AS b, count(*) FILTER (WHERE sharpness_verdict = 'soft') AS s, count(*) FILTER (WHERE sharpness_verdict = 'sharp') AS h FROM su GROUP BY 1),
  af AS (SELECT v.id, bool_or(x1 IS NOT NULL) AS d, bool_or(coalesce((af_x1 + af_x2) / 2 * width BETWEEN x1 AND x2 AND (af_y1 + af_y2) / 2 * height BETWEEN y1 AND y2, false)) AS k FROM v LEFT JOIN su ON su.image_id = v.id AND coalesce(region_type, 'vehicle') IN ('vehicle', 'person') WHERE af_x1 IS NOT NULL GROUP BY v.id),
  w AS (SELECT job_id, count(*) AS frames, sum(file_size) AS size_bytes, count(*) FILTER (WHERE pan = 1) AS pans, sum(b) AS blurred, sum(s) AS soft, sum(h) AS sharp, count(*) FILTER (WHERE af_x1 IS NULL) AS af_missing, count(*) FILTER (WHERE d AND NOT k) AS af_off_subject, count(*) FILTER (WHERE NOT d) AS af_no_subject, count(*) FILTER (WHERE af_sharpness < 0.606) AS af_soft,
    count(*) FILTER (WHERE coalesce(burst_pick, 0) = 1 OR coalesce(pick, 0) = 1) AS keepers, count(*) FILTER (WHERE rejected = 1) AS rejected, min(taken_at) AS taken_from, max(taken_at) AS taken_to, count(DISTINCT time_burst) AS bursts FROM v LEFT JOIN p USING (id) LEFT JOIN af USING (id) GROUP BY 1)
  SELECT w.*, (SELECT count(*) FROM fr c WHERE c.job_id = w.job_id AND coalesce(c.copy_of, 0) <> 0) AS copies_hidden FROM w""")
def a17_numbers(t) -> DataFrame:
    return stats.shoot_numbers(*_report(t))


@query(f"""WITH {REPORT}, s AS (SELECT image_id AS id, max(stars) AS best FROM su GROUP BY 1), l AS (SELECT job_id, 'camera' AS list, camera AS value, NULL::DOUBLE AS x FROM v UNION ALL SELECT job_id, 'lens', lens, NULL FROM v UNION ALL SELECT job_id, 'iso', CAST(iso AS VARCHAR), iso FROM v UNION ALL SELECT job_id, 'stars', CAST(coalesce(stars, best, 0) AS VARCHAR), coalesce(stars, best, 0) FROM v LEFT JOIN s USING (id)),
  c AS (SELECT job_id, list, value, x, count(*) AS n FROM l GROUP BY ALL) SELECT job_id, list, value, n, CAST(row_number() OVER (PARTITION BY job_id, list ORDER BY n DESC, x, value) AS INT) AS place FROM c""")
def a17_lists(t) -> DataFrame:
    return stats.shoot_lists(*_report(t))


@query(f"""WITH {REPORT} SELECT count(DISTINCT job_id) AS albums, count(*) AS frames, sum(file_size) AS size_bytes, count(*) FILTER (WHERE rejected = 1) AS rejected, count(*) FILTER (WHERE af_x1 IS NULL) AS af_missing, CAST(count(DISTINCT job_id) FILTER (WHERE job_id % 7 <> 6 AND job_id <> 1) AS INT) AS complete FROM v""")
def a18_library(t) -> DataFrame:
    f, s = _report(t)
    odd = F.col("job_id") % 7 == 6  # two of twenty albums lack a setting
    whole = f.withColumns({"f_number": F.when(~odd, 2.8), "exposure_time": F.lit(0.01), "focal_length": F.lit(50.0), "lens": F.when(F.col("job_id") == 1, "").otherwise(F.col("lens"))})
    total, _ = stats.library_report(whole, s)
    return total.select("albums", "frames", "size_bytes", "rejected", "af_missing", F.col("complete").cast("int").alias("complete"))


ROLLED = f"""{REPORT}, r AS (SELECT v.* REPLACE (CASE WHEN id % 16 = 0 THEN 'kit' WHEN job_id = 1 THEN '' ELSE lens END AS lens), job_id % 7 <> 6 AS known FROM v),
  hand AS (SELECT DISTINCT job_id, burst_key FROM r WHERE picked = 1 AND burst_key IS NOT NULL), keep AS (SELECT * FROM r WHERE coalesce(picked, 0) = 1 OR (burst_pick = 1 AND NOT EXISTS (SELECT 1 FROM hand h WHERE h.job_id = r.job_id AND h.burst_key = r.burst_key))),
  k AS (SELECT job_id, count(*) AS compared, count(*) FILTER (WHERE id % 6 = 0) AS matched FROM keep GROUP BY 1),
  a AS (SELECT job_id, count(*) AS frames, count(*) FILTER (WHERE id % 16 = 0) AS backfilled, count(taken_at) AS timed, max(taken_at) - min(taken_at) AS span, bool_and(known AND coalesce(lens, '') <> '' AND coalesce(camera, '') <> '' AND iso IS NOT NULL) AS whole FROM r GROUP BY 1)"""


def _rolled(t) -> tuple[DataFrame, DataFrame]:
    """Frames and subjects of the reports, where a frame of sixteen got its lens from its header; the catalogue picked one of six."""
    f, s = _report(t)
    settings = {"f_number": F.when(F.col("job_id") % 7 != 6, 2.8), "exposure_time": F.lit(0.01), "focal_length": F.lit(50.0), "catalog_pick": F.when(F.col("id") % 6 == 0, 1)}
    bare = f.withColumns({**settings, "lens": F.when(F.col("job_id") == 1, "").when(F.col("id") % 16 == 0, None).otherwise(F.col("lens"))})
    return rollups.backfilled(bare, f.where("id % 16 = 0").select("path", F.lit("kit").alias("lens"))), s


@query(f"WITH {ROLLED} SELECT job_id, a.frames, backfilled, coalesce(compared, 0) AS compared, coalesce(matched, 0) AS matched, CASE WHEN compared > 0 THEN (matched * 100 + compared // 2) // compared END AS match_percent FROM a LEFT JOIN k USING (job_id)")
def a17_rollup(t) -> DataFrame:
    numbers, _ = rollups.album_reports(rollups.rolled_up(*_rolled(t)))
    return numbers.select("job_id", "frames", "backfilled", "compared", "matched", "match_percent")


@query(f"""WITH {ROLLED} SELECT count(*) AS albums, CAST(sum(a.frames) AS BIGINT) AS frames, CAST(sum(backfilled) AS BIGINT) AS backfilled, CAST(sum(compared) AS BIGINT) AS compared, CAST(sum(matched) AS BIGINT) AS matched, count(*) FILTER (whole) AS complete_albums, CAST(coalesce(sum(a.frames) FILTER (whole), 0) AS BIGINT) AS complete_frames,
  round(sum(span) FILTER (timed >= 2), 3) AS shooting_seconds, round(avg(span) FILTER (timed >= 2), 3) AS mean_seconds, round(max(span) FILTER (timed >= 2), 3) AS longest_seconds, count(*) FILTER (timed >= 2) AS timed_albums FROM a LEFT JOIN k USING (job_id)""")
def a18_rollup(t) -> DataFrame:
    """From what was stored before a third of the albums were edited, made anew for those."""
    f, s = _rolled(t)
    before = f.withColumns({"rejected": F.when(F.col("job_id") % 3 == 0, 1).otherwise(F.col("rejected")), "picked": F.when(F.col("job_id") % 3 == 0, None).otherwise(F.col("picked"))}).where("job_id % 3 <> 0 or id % 2 = 0")
    total, _ = rollups.library_reports(rollups.refreshed(rollups.rolled_up(before, s), f, s, f.where("job_id % 3 = 0").select("job_id")))
    return total.select("albums", "frames", "backfilled", "compared", "matched", "complete_albums", "complete_frames", *[F.round(c, 3).alias(c) for c in ("shooting_seconds", "mean_seconds", "longest_seconds")], "timed_albums")


@query(f"""WITH {ROLLED}, m AS (SELECT image_id AS id, max(stars) AS best FROM su GROUP BY 1), l AS (SELECT job_id, 'lens' AS list, nullif(lens, '') AS value, NULL AS x FROM r UNION ALL SELECT job_id, 'iso', CAST(iso AS VARCHAR), iso FROM r UNION ALL SELECT job_id, 'stars', CAST(coalesce(stars, best, 0) AS VARCHAR), coalesce(stars, best, 0) FROM r LEFT JOIN m USING (id))
  SELECT list, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY list ORDER BY count(*) DESC, x, value) AS INT) AS place FROM l JOIN a USING (job_id) WHERE whole AND value IS NOT NULL GROUP BY list, value, x""")
def a18_lists(t) -> DataFrame:
    _, lists = rollups.library_reports(rollups.rolled_up(*_rolled(t)))
    return lists.where("list in ('lens', 'iso', 'stars')").select("list", "value", "n", "place")


@query("""SELECT album, day, event_type, count(*) AS rows, count(DISTINCT user_id) AS items, CAST(grouping(album, day, event_type) AS INT) AS level FROM (SELECT *, user_id % 20 AS album, CAST(ts AS DATE) AS day FROM events) e
  GROUP BY GROUPING SETS ((album, day, event_type), (album, day), (day), (event_type), ())""")
def a34_grouping_sets(t) -> DataFrame:
    e = t("events").select((F.col("user_id") % 20).alias("album"), F.to_date("ts").alias("day"), "event_type", "user_id")
    a, d, k = F.col("album"), F.col("day"), F.col("event_type")
    return e.groupingSets([[a, d, k], [a, d], [d], [k], []], a, d, k).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("items"), F.grouping_id().cast("int").alias("level"))


@query()
def a34_sketches(t) -> DataFrame:
    """Distinct cameras by album, day and kind, from sketches that are kept by all three."""
    partial = rollups.distinct_rollup(t("events").select((F.col("user_id") % 20).alias("album"), F.to_date("ts").alias("day"), "event_type", "user_id"), ["album", "day", "event_type"], "user_id")
    return rollups.distinct_by_sets(lineage.tabled(partial, "sketches"), [["album", "day", "event_type"], ["album", "day"], ["day"], ["event_type"], []])


@query("""WITH r AS (SELECT user_id, event_type = 'purchase' OR event_id % 3 = 0 AS truth, rank() OVER (PARTITION BY user_id ORDER BY floor(value / 10)) + (count(*) OVER (PARTITION BY user_id, floor(value / 10)) - 1) / 2.0 AS rank FROM events WHERE value IS NOT NULL),
  s AS (SELECT user_id, sum(rank) FILTER (truth) AS ranks, count(*) FILTER (truth) AS n, count(*) AS k FROM r GROUP BY user_id) SELECT user_id, round(CASE WHEN n > 0 AND n < k THEN (ranks - n * (n + 1) / 2.0) / (n * (k - n)) END, 9) AS auc FROM s""")
def x1_sql_aggregate(t) -> DataFrame:
    """An aggregate of ours, called in SQL."""
    e = t("events").where("value is not null").selectExpr("user_id", "floor(value / 10) AS score", "event_type = 'purchase' OR event_id % 3 = 0 AS truth")
    extend.register(e.sparkSession)
    return e.sparkSession.sql("SELECT user_id, round(auc(cast(score AS double), truth), 9) AS auc FROM {e} GROUP BY user_id", e=e)


@query(f"WITH {SESSIONS} SELECT CAST(user_id AS VARCHAR) AS key, CAST(session AS BIGINT) AS session, min(taken) AS started, max(taken) AS ended, count(*) AS n FROM sessions GROUP BY user_id, session")
def x2_sql_table_function(t) -> DataFrame:
    """A table function over a table that is partitioned and ordered, called in SQL."""
    e = t("events").select(F.col("user_id").cast("string").alias("key"), D.wall_seconds(F.col("ts")).alias("taken"))
    extend.register(e.sparkSession)
    return e.sparkSession.sql("SELECT * FROM burst_spans(10800.0D, TABLE(SELECT key, taken FROM {e}) PARTITION BY key ORDER BY taken)", e=e)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN false WHEN event_id % 4 = 0 THEN event_id % 2 = 0 AND event_id % 8 = 0 ELSE coalesce(CASE WHEN event_id % 5 > 0 THEN value / 100 END, 1) < CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0.8 END END AS review FROM events")
def x3_sql_function(t) -> DataFrame:
    """A scalar function of ours in SQL, written into the plan."""
    e = t("events")
    extend.register(e.sparkSession)
    return e.sparkSession.sql("SELECT event_id, needs_review(CASE WHEN event_id % 5 > 0 THEN value / 100 END, CASE WHEN event_id % 3 = 0 THEN 1 END, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN event_id % 8 = 0 THEN 1 END, CASE WHEN event_id % 7 = 0 THEN 0.5D ELSE 0.0D END) AS review FROM {e}", e=e)


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'a%' OR p_partkey % 10 = 0 THEN '' ELSE array_to_string(list_filter(['ee', 'on', 'a'], lambda w: contains(p_name, w)), '|') END AS moments, CASE WHEN p_partkey % 10 > 0 AND p_name LIKE 'a%' THEN 'RuntimeError: no answer' END AS error FROM part""")
def x4_judged(t) -> DataFrame:
    """A judge that fails on some pictures: the others of their batches are answered."""
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, F.encode("p_name", "UTF-8")).alias("image"))
    said = extend.judged(rows, partial(extend.ByteJudge, ord("a")), "p_partkey", "image", "A trial.", ["ee", "on", "a"], 8)
    return said.select("p_partkey", F.coalesce(F.array_join("moments", "|"), F.lit("")).alias("moments"), "error")


@query("""SELECT p_partkey, nullif(upper(regexp_replace(CASE WHEN p_partkey % 9 = 0 THEN ' - ' ELSE p_name || '-' || p_partkey END, '[^A-Za-z0-9]', '', 'g')), '') AS plate,
  coalesce((SELECT bool_or(contains(lower(p_type), w)) FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w) WHERE length(w) >= 4 AND w <> 'blue'), false) AS backed, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda w: trim(w)), lambda w: w <> ''), '|') AS parts,
  CASE p_partkey % 4 WHEN 0 THEN 'gentle' WHEN 1 THEN 'eager' ELSE 'normal' END AS word FROM part""")
def f22_words(t) -> DataFrame:
    """Plates made tidy, claims that a line of evidence backs, lists in a text, and words out of a set."""
    name = F.when(F.col("p_partkey") % 9 == 0, " - ").otherwise(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")))
    word = F.when(F.col("p_partkey") % 4 == 0, " Gentle ").when(F.col("p_partkey") % 4 == 1, "EAGER").otherwise("odd")
    return t("part").select("p_partkey", X.tidy_plate(name).alias("plate"), X.corroborated(F.col("p_name"), F.array("p_type"), ("blue",)).alias("backed"), F.array_join(X.split_list(F.col("p_name"), " "), "|").alias("parts"), X.word_or(word, ("gentle", "normal", "eager"), "normal").alias("word"))


@query("""SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', d) + (o_orderkey % 40) - 1 AS INT) AS days, CAST(d AS DATE) AS back, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey + 978307200.0 END AS foreign_time, greatest(CAST(round(o_custkey - o_orderkey + 0.25) AS BIGINT), 0) AS age
  FROM (SELECT *, date_trunc('month', o_orderdate) AS d FROM orders)""")
def d3_times(t) -> DataFrame:
    """Days of dates that roll over, and back; times of a foreign epoch as text; ages, none under 0."""
    o = t("orders").withColumn("d", F.to_date(F.col("o_orderdate")))
    days = D.days_from_civil(F.year("d"), F.month("d"), (F.col("o_orderkey") % 40).cast("int"))
    back = D.civil_from_days(D.days_from_civil(F.year("d"), F.month("d"), F.lit(1)))
    text = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey").cast("string")).otherwise("soon")
    return o.select("o_orderkey", days.alias("days"), back.alias("back"), D.from_foreign_epoch(text).alias("foreign_time"), D.age_seconds(F.col("o_custkey") + 0.25, F.col("o_orderkey")).alias("age"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(l_quantity, l_linenumber) / least(l_quantity, l_linenumber), 9) AS scale, round(sqrt(pow((l_quantity - l_linenumber) / 2, 2)) / sqrt(2), 9) AS shift, round(coalesce(CASE WHEN l_linenumber > 2 THEN l_discount END, 0) + log2(l_quantity), 9) AS ev,
  CASE WHEN l_linenumber % 3 > 0 THEN greatest(l_tax, l_discount) END AS both_greatest, CAST(round(100 * l_linenumber / 7) AS INT) AS share, CAST(l_linenumber * 16 + 10 AS INT) AS byte FROM lineitem""")
def m4_numbers(t) -> DataFrame:
    """Boxes that follow each other, brightness in stops, the greater of two that are both known, shares in percent, and bytes of hex."""
    box = lambda w: F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), w.cast("double").alias("x2"), F.lit(1.0).alias("y2"))
    rows = t("lineitem").withColumns({"a": box(F.col("l_quantity")), "b": box(F.col("l_linenumber"))})
    step = N.continuity("a", "b")
    byte = F.get(N.bytes_of_hex(F.concat(F.lit("00"), F.hex("l_linenumber"), F.lit("a"))), F.lit(1))
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(step["scale"], 9).alias("scale"), F.round(step["shift"], 9).alias("shift"), F.round(N.brightness(F.col("l_quantity"), F.when(F.col("l_linenumber") > 2, F.col("l_discount"))), 9).alias("ev"),
        N.strict_greatest(F.when(F.col("l_linenumber") % 3 > 0, F.col("l_tax")), F.col("l_discount")).alias("both_greatest"), views.share(F.col("l_linenumber"), F.lit(7)).alias("share"), byte.alias("byte"),
    )


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_brand, p_type, split_part(p_name, ' ', 1), '', p_brand], lambda x: x <> '' AND x <> p_type))), '|') AS aliases FROM part")
def u5_aliases(t) -> DataFrame:
    first = F.element_at(F.split("p_name", " "), 1)
    return t("part").select("p_partkey", F.array_join(identity.aliases_of(F.array("p_brand", "p_type"), F.array(first, F.lit(""), F.col("p_brand")), F.col("p_type")), "|").alias("aliases"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey + 100 FROM customer EXCEPT ALL SELECT s_nationkey + 100 FROM supplier)")
def u7_set_operations_all(t) -> DataFrame:
    k = lambda name, c, more=0: t(name).select((F.col(c) + more).alias("k"))
    return k("customer", "c_nationkey").intersectAll(k("supplier", "s_nationkey")).unionAll(k("customer", "c_nationkey", 100).exceptAll(k("supplier", "s_nationkey", 100)))


LIBRARY_SQL = """jobs AS (SELECT c_custkey AS id, 'done' AS status FROM customer), images AS (SELECT o_orderkey AS id, o_custkey AS job_id, o_orderkey % 6 AS stars, o_orderkey % 2 AS rejected FROM orders),
  detections AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS image_id, l_linenumber % 5 AS stars, l_linenumber % 2 AS rejected, l_linenumber % 3 = 0 AS has_crop FROM lineitem)"""


def _library(t) -> resets.Tables:
    none = F.lit(None).cast("string")
    images = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_id"), F.concat(F.lit("p"), "o_orderkey").alias("path"), (F.col("o_orderkey") % 6).alias("stars"), (F.col("o_orderkey") % 2).alias("rejected"), F.lit("done").alias("status"))
    detections = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 5).cast("long").alias("stars"), (F.col("l_linenumber") % 2).cast("long").alias("rejected"), F.when(F.col("l_linenumber") % 3 == 0, "crop").alias("crop_path"), none.alias("group_key"))
    return {"jobs": t("customer").select(F.col("c_custkey").alias("id"), F.lit("done").alias("status")), "images": images, "detections": detections}


@query(f"""WITH {LIBRARY_SQL}, gone AS (SELECT id FROM images WHERE job_id IN (SELECT id FROM jobs WHERE id % 10 = 3))
  SELECT 'jobs' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM jobs WHERE id % 10 <> 3 UNION ALL SELECT 'images', count(*), CAST(sum(id) AS BIGINT) FROM images WHERE id NOT IN (FROM gone)
  UNION ALL SELECT 'detections', count(*), CAST(sum(id) AS BIGINT) FROM detections WHERE image_id NOT IN (FROM gone)""")
def e6_cascade(t) -> DataFrame:
    """A tenth of the albums goes, with all that depends on them."""
    left = resets.without(_library(t), "jobs", F.col("id") % 10 == 3)
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids")) for name, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {LIBRARY_SQL} SELECT i.id, CAST(CASE WHEN job_id <> 3 THEN stars END AS BIGINT) AS stars, CASE WHEN job_id = 3 THEN 0 ELSE rejected END AS rejected FROM images i")
def e6_ratings(t) -> DataFrame:
    return resets.reset_ratings(_library(t), 3)["images"].select("id", "stars", "rejected")


@query(f"""WITH {LIBRARY_SQL}, f AS (SELECT CASE event_id % 4 WHEN 0 THEN 'thumb' WHEN 1 THEN 'view' WHEN 2 THEN 'crop' ELSE 'notes' END AS kind, event_id * 7 AS id, event_id AS bytes FROM events),
  o AS (SELECT *, CASE WHEN kind = 'crop' THEN id NOT IN (SELECT id FROM detections WHERE has_crop) ELSE id NOT IN (SELECT id FROM images) END AS gone FROM f WHERE kind <> 'notes')
  SELECT CASE WHEN gone THEN 'orphaned' ELSE kind END AS slot, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM o GROUP BY 1 UNION ALL SELECT 'total', count(*), CAST(sum(bytes) AS BIGINT) FROM o""")
def e6_orphans(t) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("thumb", "view", "crop", "notes"))), (F.col("event_id") % 4 + 1).cast("int"))
    files = t("events").select(F.concat(F.lit("/cache/"), kind, F.lit("-"), (F.col("event_id") * 7).cast("string"), F.lit(".jpg")).alias("path"), F.col("event_id").alias("bytes"))
    lib = _library(t)
    return resets.cache_survey(resets.cached(files, lib["images"], lib["detections"]))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'new' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def e2_edit(t) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    given = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 < 2, "o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "o_orderpriority")))
    delta = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 1, "new").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"), given.alias("given"))
    return mutations.edit(o, delta, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'R' AND k.l_orderkey = l.l_orderkey AND k.l_linenumber = l.l_linenumber AND k.l_quantity = l.l_quantity AND k.l_discount = l.l_discount AND k.l_tax = l.l_tax)")
def j3_five_keys(t) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    return t("lineitem").join(t("lineitem").where("l_returnflag = 'R'").select(*keys), keys, "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'touches the frame edge' ELSE 'cut off on ' || (event_id % 4) || ' edges' END AS told FROM events")
def f26_framing_text(t) -> DataFrame:
    return t("events").select("event_id", N.clipping_text(F.col("event_id") % 4).alias("told"))


@query(f"""WITH {FRAMES}, {BOXES}, v AS (SELECT * FROM frames WHERE status = 'done' AND coalesce(copy_of, 0) = 0), c AS (SELECT v.id, path, ((id % 10) / 10) * (x2 - x1) * (y2 - y1) AS worth FROM v JOIN (SELECT image_id, x1, y1, x2, y2, region_type FROM boxes) b ON b.image_id = v.id WHERE coalesce(region_type, 'vehicle') = 'vehicle')
  SELECT id, path FROM (SELECT * FROM c ORDER BY worth DESC, id LIMIT 20) WHERE id % 2 = 1 ORDER BY worth DESC, id LIMIT 1""")
def o3_cover(t) -> DataFrame:
    b = boxes(t).select("image_id", "region_type", "box.*", (F.col("image_id") % 10 / 10).alias("conf"), F.lit(0.0).alias("sharpness"))
    return selection.cover(frames(t), b, F.col("id") % 2 == 1)
