"""Operators 4, 6, 8, 9 and 10, and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.llm import language, packing, shared, topk, toxicity, warc


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(0, 0.2, 8).tolist(), "x") for i in range(1100)]
    rows += [(2000 + i, rows[50][1], "same") for i in range(20)]
    rows += [(3000, None, "n"), (3050, [0.1, None] + [0.0] * 6, "n"), (3100, [float("nan")] * 8, "n"), (3150, [float("inf")] + [0.0] * 7, "n"), (None, rows[1][1], "n"), (3200, [], "n"), rows[7], (4000, [0.5, 0.5], "short"), (4001, [0.25, -1.0], "short")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in topk.top_inner_products(df).select("query_id", "rank", "vec_id", "score").collect()]
    whole = {(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, v in whole:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    assert topk.top_inner_products(df.limit(0)).collect() == []


def test_top_k_over_many_groups_and_huge_components(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("BLOCKS", 3), ("QUERIES", 2), ("EXTREMES", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(int(i), (centres[i // 60] + rng.normal(0, 0.05, 8)).tolist()) for i in range(360)]
    huge = [(50, [1e30, 1e30]), (1, [1e30, 1e30]), (2, [1e300, -1e300]), (3, [-1e30, 5.0]), (100, [1e15, -3e14]), (7, [1e12, 2e12])]
    for data in (rows, huge):
        whole = [(i, [min(max(int(np.floor(min(max(x, -(2.0**54)), 2.0**54) * 256)), -(2**62)), 2**62) for x in v]) for i, v in data]
        want = []
        for q, v in whole:
            if q % 50 == 0:
                scored = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in whole if i != q)[:5]
                want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
        got = topk.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_blocks_below_the_kth_score_are_left_out():
    rng = np.random.default_rng(6)
    vectors = np.concatenate([np.full((128, 4), 10 * k) for k in range(20)]) + rng.integers(0, 5, (2560, 4))
    found, scored = topk.pruned_top(np.arange(2560), vectors, np.array([-1]), np.ones((1, 4), np.int64), 5)
    assert scored < 4 and min(s for _, _, s in found) >= 760
    assert topk.pruned_top(np.arange(2560), vectors, np.array([-1]), np.ones((1, 4), np.int64), 5, np.array([10_000.0])) == ([], 0)


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", None, 0), (-3, "12 34 !", None, "s", 7), (None, "the and of", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    return shared.table(spark, "/root/testdata/sf0.01", "documents").unionByName(extra).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))


def brute_score(text, model):
    """Each window of at most 96 bytes compressed twice; bytes saved become four numbers, and a logistic curve the score."""
    import math

    import zstandard

    raw, parts, i = (text or "").encode().lower(), [], 0
    while i < len(raw):
        j = min(len(raw), i + 96)
        if j < len(raw) and (k := raw.rfind(b" ", i + 48, j)) > 0:
            j = k
        parts.append(raw[i:j])
        i = j
    tools = [zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for c in (model.ordinary, model.toxic + model.ordinary)]
    saved = sorted(len(tools[0].compress(p)) - len(tools[1].compress(p)) for p in parts or [b""])
    root = math.sqrt(len(saved))
    x = [saved[-1], sum(saved[-2:]), sum(v >= toxicity.HIT for v in saved) / root, sum(max(v - 2, 0) for v in saved) / root]
    return 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(12)
    words = [a + b for a in "ka lo mi tu re sa ne po".split() for b in "n r th st mo la ge fi".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad = lambda: f"{text(30)} vile filth wretch {text(20)} you filthy wretches {text(20)}"
    rows = [(k, bad() if k % 3 == 0 else text(80), int(k % 3 == 0)) for k in range(240)]
    docs = spark.createDataFrame([(k, t, 1) for k, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([*((k, y) for k, _, y in rows), (0, 0), (9999, 1), (None, 1), (7, 5)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    odd = [(1000, None), (1001, ""), (1002, "vile filth " * 20_000), (1003, text(30_000)), (1004, "É漢字 " * 50), (None, bad()), (1005, bad()), (1005, bad())]
    asked = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("windows", F.lit("clash"))
    got = toxicity.toxicity(asked, model).collect()
    texts = [r["text"] for r in asked.collect()]
    assert len(got) == len(texts)
    for r, t in zip(got, texts, strict=True):
        assert r["score"] == pytest.approx(brute_score(t, model)) and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], r["doc_id"] % 3 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["held_out"]]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)
    assert toxicity.toxicity(asked, toxicity.learned(docs.limit(0), labels)).where("predicted = 1").count() == 0


def test_what_reaches_the_driver_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_BYTES", 1000)
    monkeypatch.setattr(toxicity, "ORDINARY_BYTES", 5000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, weight: seen.append(rows) or toxicity.Model())
    rows = [(k, ("x" if k % 2 else "y") + str(k) * (400 if k % 20 == 0 else 20)) for k in range(400)]
    toxicity.learned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int"))
    size = lambda y: sum(len(t) for t, x in seen[0] if x == y)
    assert 900 < size(1) <= 1000 and 4000 < size(0) <= 5000


def test_toxicity_on_held_out_rows(spark, docs):
    labels = shared.table(spark, "/root/testdata/sf0.1", "labels")
    big = shared.table(spark, "/root/testdata/sf0.1", "documents")
    model = toxicity.learned(big, labels)
    found = toxicity.toxicity(big, model).join(labels, "doc_id").where("held_out").toPandas()
    assert found.predicted[found.toxic == 1].mean() > 0.5
    assert found.predicted[found.toxic == 0].mean() < 0.03
    scored = toxicity.toxicity(docs, model).toPandas()
    assert len(scored) == docs.count() and scored.score.between(0, 1).all()
    assert (scored.held_out.dropna() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id.dropna().astype(int)]).all()
    kept = toxicity.rejected_out(docs, model)
    assert kept.columns == docs.columns and kept.count() == (scored.predicted == 0).sum()
    assert toxicity.toxicity(docs.limit(0), model).collect() == []
    assert toxicity.learned(docs, labels.limit(0)).weights == ()


def test_language_on_held_out_rows(spark, docs):
    model = language.learned(docs)
    found = language.languages(docs, model).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    by = found.set_index("doc_id").lang_pred
    assert by[-1] == by[-2] == by[-3] == "und"
    truth = docs.where("lang is not null and doc_id >= 0").select("doc_id", "lang").toPandas().merge(found, on="doc_id")
    assert (truth.lang == truth.lang_pred)[truth.held_out].mean() > 0.97
    assert language.languages(docs.limit(0), model).collect() == []
    assert set(language.languages(docs, language.learned(docs.where("lang is null"))).toPandas().lang_pred) == {"und"}


def plain_code_length(texts, fold, asked, least):
    """Prediction by partial matching, a context at a time: orders 0 to 2 count all, order 3 what was seen ``least`` times."""
    counts = {}
    for t in texts:
        sym = [0, 0, 0] + [int(fold[b]) for b in t.encode().lower()]
        for i in range(3, len(sym)):
            for order in range(4):
                of = counts.setdefault(tuple(sym[i - order : i]), {})
                of[sym[i]] = of.get(sym[i], 0) + 1
    counts = {c: {s: n for s, n in of.items() if len(c) < 3 or n >= least} for c, of in counts.items()}
    total, sym = 0.0, [0, 0, 0] + [int(fold[b]) for b in asked.encode().lower()]
    for i in range(3, len(sym)):
        for order in (3, 2, 1, 0, -1):
            if order < 0:
                total += 6
                break
            seen = counts.get(tuple(sym[i - order : i]))
            if seen:
                whole = sum(seen.values()) + len(seen)
                if sym[i] in seen:
                    total -= np.log2(seen[sym[i]] / whole)
                    break
                total -= np.log2(len(seen) / whole)
    return total


def test_what_production_builds_equals_a_plain_model(spark):
    rng = random.Random(4)
    words = {"a": "abcd éß", "b": "aabbx ü漢"}
    rows = [(k, "".join(rng.choice(words[g]) for _ in range(rng.choice([3, 80, 200]))).title(), g) for k, g in enumerate("ab" * 12)]
    rows += [(100, "zq zq", "c"), (101, None, "a"), (102, "", "b"), (103, "never", None), (None, "never", "a")]  # a language with one short text
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "_n": F.lit(2), "gram": F.lit("x")})
    model = language.learned(df)
    taught = {g: [t for i, t, x in rows if x == g and i is not None and t and zlib.crc32(str(i).encode()) % 3 != 1] for g in "abc"}
    assert model.langs == [g for g in "abc" if taught[g]] and len(taught["a"]) > 3
    asked = ["abxd ca badcab éé xx dab" * 3, "", "zz 漢ab", "A" * 700_000 + "x"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in asked]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    got = language._Tables(model).bits(*language.symbols(np.concatenate(data), offsets, model.symbol))
    want = [[plain_code_length(taught[g], model.symbol, t, language.LEAST) for g in model.langs] for t in asked]
    assert got == pytest.approx(np.array(want), rel=1e-4)
    found = language.languages(spark.createDataFrame([(1, asked[3]), (1, asked[3]), (2, asked[0])], "doc_id long, text string"), model).collect()
    assert len(found) == 3 and all(r["lang_pred"] in model.langs for r in found)


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    odd = spark.createDataFrame([(-9, "naïve ＦＵＬＬ Σς İ <|endoftext|> 'S it's\x1c²½ x́ 汉字"), (-10, "A" * 9000), (-11, "a b " * 2047), (-11, "a b " * 2047)], "doc_id long, text string")
    asked = docs.select("doc_id", "text").union(odd)
    rows = packing.packed(asked.withColumn("length", F.lit("clash"))).toPandas()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum().to_numpy()[:-1]])).all() and g.length.sum() <= 2048
    want = []
    for r in asked.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(-99 if r["doc_id"] is None else r["doc_id"], k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = [tuple(map(int, x)) for x in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].fillna(-99).itertuples(index=False)]
    assert sorted(got) == sorted(want)
    assert rows.sequence_id.nunique() <= 1.02 * max(rows.length.sum() / 2048, (rows.length > 1024).sum()) + 1
    assert packing.packed(asked.limit(0)).collect() == []


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(1)
    for size in (16, 64, 200):
        counts = np.zeros(size + 1, int)
        np.add.at(counts, rng.integers(1, size + 1, 500), 1)
        used = np.zeros(size + 1, int)
        for lengths, times in packing.plan(counts, size):
            assert sum(lengths) <= size and times > 0
            np.add.at(used, list(lengths), times)
        assert (used == counts).all()
    halves = np.zeros(2049, int)
    halves[[1000, 600, 400, 48]] = 100, 100, 100, 100
    assert sum(times for _, times in packing.plan(halves)) == 100


def test_warc_round_trip_with_magic_in_payloads(spark):
    rng = random.Random(9)
    magic = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: "
    rows = [(k, f"http://h/{k}", "é" * rng.randint(0, 200) + "".join(magic + rng.choice(["0", "7", "99999", "x"]) + "\r\n\r\n" + "y" * rng.randint(0, 500) + rng.choice(["", "\r\n\r\n", "\r\n\r\nWARC/1."]) for _ in range(rng.choice([0, 1, 3])))) for k in range(80)]
    rows += [(100, None, None), (101, "u", ""), (102, "u\r\nX: y", "short"), (103, "u", "short")] + [(200 + k, "u", "same " * 300) for k in range(6)] + [(None, "u", "same " * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        path = shared.new_path(spark, "warc")
        got = [r.asDict() for r in warc.round_trip(df, path).collect()]
        whole = warc.records(spark, path, with_payload=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == "same " * 300 and i != 205
        want.append((-1 if i is None else i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 205 if again else None))
    assert sorted(map(str, ((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    text = {f"<urn:page:{'' if i is None else i}>": (h or "").encode() for i, _, h in rows}
    assert all(r["payload"] is None if r["type"] == "revisit" else bytes(r["payload"]) == text[r["id"]] for r in whole)
    assert warc.round_trip(df.limit(0)).collect() == []


def _record(version, number, body, length=None):
    head = f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{number}>\r\nContent-Length: {len(body) if length is None else length}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_foreign_and_damaged_archives(spark, tmp_path, split):
    import gzip

    bodies = [b"a" * 5, b"", b"x\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc", b"\r\n\r\nWARC/none", b"z" * 3000]
    whole = {v: b"".join(_record(v, k, b) for k, b in enumerate(bodies)) for v in ("0.18", "1.0", "1.1")}
    files = {f"v{v}.warc": raw for v, raw in whole.items()}
    files["packed.warc.gz"] = b"".join(gzip.compress(_record("1.0", k, b)) for k, b in enumerate(bodies))
    files["mixed.warc"] = _record("1.0", 0, b"one") + _record("1.1", 1, b"two")
    files["long.warc"] = _record("1.0", 0, b"one") + _record("1.0", 1, b"two", 9999)
    files["short.warc"] = _record("1.0", 0, b"one") + _record("1.0", 1, b"two", 1) + _record("1.0", 2, b"lost")
    files["none.warc"] = _record("1.0", 0, b"one") + _record("1.0", 1, b"two", "many") + _record("1.0", 2, b"lost")
    files["empty.warc"] = b""
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = warc.records(spark, str(tmp_path)).collect()
        payloads = warc.records(spark, str(tmp_path), with_payload=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in got:
        by.setdefault(r["file"].rpartition("/")[2], []).append((r["offset"], r["id"], r["bytes"], r["damage"]))
    for name in ("v0.18.warc", "v1.0.warc", "v1.1.warc", "packed.warc.gz"):
        assert [x[1:] for x in sorted(by[name])] == [(f"<urn:page:{k}>", len(b), None) for k, b in enumerate(bodies)]
    assert [x[3] for x in sorted(by["mixed.warc"])] == [None, None]
    assert [(x[1], x[3]) for x in sorted(by["long.warc"])] == [("<urn:page:0>", None), ("<urn:page:1>", warc.BROKEN["next"])]
    assert [(x[1], x[3]) for x in sorted(by["short.warc"])] == [("<urn:page:0>", None), ("<urn:page:1>", warc.BROKEN["next"])]
    assert [(x[1], x[3]) for x in sorted(by["none.warc"])] == [("<urn:page:0>", None), (None, warc.BROKEN["header"])]
    assert "empty.warc" not in by
    raw = {(r["file"].rpartition("/")[2], r["id"]): r["payload"] for r in payloads}
    assert all(bytes(raw["v1.0.warc", f"<urn:page:{k}>"]) == b for k, b in enumerate(bodies))


def test_revisits_are_checked_against_their_responses(spark):
    rows = [("response", "a", None, "d1", 5), ("revisit", "b", "a", "d1", 5), ("revisit", "c", "a", "d2", 5), ("revisit", "d", "zz", "d1", 5), ("revisit", "e", "a", "d1", None), (None, None, None, None, None)]
    found = spark.createDataFrame([(*r, None) for r in rows], "type string, id string, refers_to string, digest string, bytes long, damage string")
    got = {r["id"]: r["damage"] for r in warc.checked(found).collect()}
    assert got == {"a": None, "b": None, "c": warc.BROKEN["digest"], "d": warc.BROKEN["digest"], "e": None, None: None}


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = [a + b for a in "ka lo mi tu re sa".split() for b in "n r th st mo la".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(25)
    docs = [(k, text(60)) for k in range(60)]
    docs += [(100 + k, text(40) + " vile filth wretch " + text(20)) for k in range(40)]
    docs += [(200, docs[5][1]), (201, docs[6][1].replace(" ", "  ")), (300, text(30) + " " + item), (400, None), (401, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in docs if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert left == {*range(60), 400, 401}


def test_pipeline_stages_decide_about_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [a + b for a in "ka lo mi tu re sa".split() for b in "n r th st mo la".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, one, two, three = text(25), text(60), text(60), text(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda stage, rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(rows), str(tmp_path)).collect()), key=repr)
    assert left(corpus_pipeline.benchmark_out, [(None, f"{one} {item}"), (None, two), (7, f"{item} {two}"), (7, three)]) == [(7, three), (None, two)]
    for _, stage in corpus_pipeline.STAGES[1:4]:  # extra columns go, an empty table stays empty
        empty = stage(spark, frame([(1, one)]).withColumn("row", F.lit("x")).limit(0), str(tmp_path))
        assert empty.columns == corpus_pipeline.COLUMNS and empty.count() == 0
    assert corpus_pipeline.packed(spark, frame([(1, one)]).limit(0), str(tmp_path)).count() == 0
    assert left(corpus_pipeline.lines_out, [(7, one), (7, two), (None, one)]) == sorted([(7, one), (7, two), (None, one)], key=repr)
    assert corpus_pipeline.packed(spark, frame([(7, one), (7, two), (None, one)]), str(tmp_path)).count() == 3
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert left(corpus_pipeline.toxic_out, [(7, one), (7, two), (None, one)]) == sorted([(7, one), (7, two), (None, one)], key=repr)
    rows = [(3, one), (9, one), (9, two), (12, two), (5, three), (5, three), (None, one)]
    assert left(corpus_pipeline.near_copies_out, rows) == sorted([(3, one), (9, two), (5, three), (None, one)], key=repr)
