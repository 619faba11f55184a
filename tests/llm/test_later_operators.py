"""Operators 11, 12 and 13 against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from burstlake.llm import importance, merkle, shared, simhash

WORDS = [a + b for a in "ka lo mi tu re sa ne po di va".split() for b in "n r th st mo la ge fi bu xe".split()] + ["été", "ß", "語", "naïve", "A1", "Übermaß"]
CLASHES = "range int, block long, data string, bucket int, part int, pos int, size int, may int, print long, key string, g string, run int, kids string, path string, digest string, leaf string, left int"


def frame(spark, rows):
    """Documents, with columns that are named like what the operators make."""
    extra = [1, 2, "d", 3, 4, 5, 6, 7, 8, "k", "g", 9, "k", "p", "x", "l", 10]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, source string, lang string, n_chars long, text string, {CLASHES}")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd(rng):
    texts = [None, "", "  \n-- ", "one", "one two", "x" * 300 + " " + "y" * 65, sentence(rng, 120_000), "q" * 600_000 + " end of it"]
    return [(900 + k, "s", "en", None, t) for k, t in enumerate(texts)] + [(None, None, None, 4, sentence(rng, 40)), (None, "s", "", 4, None)]


def rows_of(rng, n=150):
    rows = [(k, rng.choice(["a", None, "ü"]), rng.choice(["en", "en", "fr", None, ""]), rng.choice([None, k]), sentence(rng, rng.choice([1, 5, 25, 80]))) for k in range(n)]
    rows += [(3, "a", "en", 1, "same row"), (3, "a", "en", 1, "same row"), rows[5], (7, "z", "fr", 1, rows[7][4])]
    return rows + odd(rng)


# ---- 11


def brute_buckets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_resampled(docs, target, percent=5):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    found = [(i, *brute_buckets(text)) for i, text in docs]
    for _, _, b in found:
        np.add.at(s, b, 1)
    for text in target:
        np.add.at(t, brute_buckets(text)[1], 1)
    gain = [math.floor(1000 * math.log((float(y + 1) * float(s.sum() + 10000)) / (float(x + 1) * float(t.sum() + 10000)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, n, b in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b)
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(may[: percent * len(may) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


def resampled(spark, rows, target, percent=5):
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, data string")
    return sorted((tuple(r) for r in importance.resampled(frame(spark, rows), bench, percent).collect()), key=repr)


def test_resampling_equals_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    rows, target = rows_of(rng), [sentence(rng, 30) for _ in range(20)] + [None, "", "ÜBER Été"]
    want = brute_resampled([(r[0], r[4]) for r in rows], target, 40)
    assert resampled(spark, rows, target, 40) == want
    monkeypatch.setattr(importance, "GROUP", 1 << 12)  # each range of buckets is dealt to many groups
    assert resampled(spark, rows, target, 40) == want


def test_resampling_of_empty_tables(spark):
    rng = random.Random(12)
    rows = rows_of(rng, 30)
    assert resampled(spark, rows[:0], ["a b"]) == []
    assert resampled(spark, rows, [], 50) == brute_resampled([(r[0], r[4]) for r in rows], [], 50)


def test_ties_go_to_the_smaller_doc_id_and_only_the_share_is_drawn(spark):
    rng = random.Random(13)
    text = sentence(rng, 20)
    got = resampled(spark, [(5, "s", "en", 1, text)] * 40 + [(4, "s", "en", 1, sentence(rng, 19))], [text], 10)
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3, 4] and all(r[4] is None for r in got if r[0] == 4)


def test_crc_of_joined_words_of_any_length():
    rng = random.Random(14)
    words = [bytes(rng.choice(b"abcdefz09") for _ in range(n)) for n in [*range(1, 70), 127, 128, 129, 5000, 70_000, 3]]
    data = np.frombuffer(b" ".join(words), np.uint8)
    row, bucket, n, _ = importance.features(data, np.array([0, len(data)]))
    want = [zlib.crc32(b" ".join(words[k : k + g])) % 10000 for g in (1, 2, 3) for k in range(len(words) - g + 1)]
    assert bucket.tolist() == want and n.tolist() == [len(words)] and set(row.tolist()) == {0}


def test_long_texts_in_pieces_have_the_same_features(monkeypatch):
    rng = random.Random(15)
    monkeypatch.setattr(shared, "SEGMENT", 64)
    for text in (sentence(rng, 400), "z" * 500, "a " + "z" * 500 + " b c", ". " * 300, "a" + " ." * 200 + " b c d"):
        data = np.frombuffer(lower(text).encode(), np.uint8)
        pieces = list(importance._long(data))
        n, want = brute_buckets(text)
        assert sorted(np.concatenate([p for p, _ in pieces]).tolist()) == sorted(want) and sum(k for _, k in pieces) == n


def test_packed_values_come_back():
    for values in ([], [0, 254, 255, 256, 10**7], list(range(600))):
        data = importance.packed(np.array(values, np.int64)) + importance.packed(np.array([7]))
        back, at = importance.unpacked(data, 0)
        assert back.tolist() == values and importance.unpacked(data, at)[0].tolist() == [7]


# ---- 12


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_linked(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for i, x in zip(ids, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return sorted(((i, f"{p:016x}", least.get(x)) for i, p, x in zip(ids, prints, label, strict=True)), key=repr)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 3, 0])
def test_simhash_equals_brute_force(spark, monkeypatch, crowded):
    rng = random.Random(16)
    rows = rows_of(rng, 60)
    centre = sentence(rng, 300)
    rows += [(1000 + k, "s", "en", 1, edited(rng, centre, rng.choice([0, 1, 2, 4]))) for k in range(60)]
    rows += [(2000 + k, "s", "en", 1, rows[-1][4].upper().replace("SS", "ß")) for k in range(3)]
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == brute_linked([r[0] for r in rows], [brute_print(r[4]) for r in rows])


def test_links_of_prints_are_found_once_and_all(spark, monkeypatch):
    rng = random.Random(17)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        prints |= {base, *(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40))}
    prints |= {1 << 31, 1 << 32, 1 << 63, 3, 1 << 63 | 1 << 31}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = sorted(tuple(sorted(pair)) for pair in combinations(signed, 2) if ((pair[0] ^ pair[1]) & ((1 << 64) - 1)).bit_count() <= 2)
    table = spark.createDataFrame([(p,) for p in signed], "print long")
    assert sorted(tuple(r) for r in simhash.links(table).collect()) == want
    monkeypatch.setattr(simhash, "CROWDED", 5)
    assert sorted({tuple(r) for r in simhash.links(table).collect()}) == want


def test_long_texts_in_pieces_have_the_same_fingerprint(monkeypatch):
    rng = random.Random(18)
    texts = [sentence(rng, 200), "z" * 400, "a " + "z" * 400, " \t " * 200, "a b", " " * 300 + "a b", "a" + " " * 300 + "b" + "\n" * 300 + "c d"]
    want = [brute_print(t) for t in texts]
    monkeypatch.setattr(shared, "SEGMENT", 32)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


# ---- 13


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(leaves):
    """The last digest, and for each leaf its siblings left and right, level by level."""
    paths, where, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append((run[: at % 8], run[at % 8 + 1 :]))
        level, where = [H("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [at // 8 for at in where]
    return level[0], paths


def brute_verified(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, found = [], []
    for g in order:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        sub, paths = brute_tree([brute_leaf(*r) for r in ordered])
        subs.append(sub)
        found.append((ordered, paths))
    if not subs:
        return []
    root, upper, out = *brute_tree(subs), []
    for sub, above, (ordered, paths) in zip(subs, upper, found, strict=True):
        for r, path in zip(ordered, paths, strict=True):
            path = path + above
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            fold = brute_leaf(*r[:4], lower(r[4])) if tampered else brute_leaf(*r)
            for left, right in path:
                fold = H("".join([*left, fold, *right]))
            out.append((r[0], brute_leaf(*r), sub, root, H("".join("".join(a + b) for a, b in path)), fold, fold == root))
    return sorted(out, key=repr)


def checked(spark, rows):
    docs = frame(spark, rows)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(text=F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    found = merkle.verified(merkle.manifest(docs, {"tampered": tampered}), F.coalesce("tampered", "leaf"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(19)
    rows = rows_of(rng, 700)  # more than two levels for en, runs of one at the end of some
    rows += [(5000 + k, "s", f"l{k}", 1, "Only One") for k in range(12)]
    got = checked(spark, rows)
    assert got == brute_verified(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_manifests_of_small_tables(spark, n):
    rows = [(k, "s", "en", k, f"Text {k}") for k in range(n)]
    assert checked(spark, rows) == brute_verified(rows)


def test_any_changed_value_changes_the_root(spark):
    rows = [(k, "s", "en" if k % 2 else None, k, f"text {k}") for k in range(20)]
    root = merkle.manifest(frame(spark, rows)).root
    assert root == brute_verified(rows)[0][3] and merkle.manifest(frame(spark, rows[::-1])).root == root
    for change in ((3, "t", "en", 3, "text 3"), (3, "s", "en", None, "text 3"), (3, "s", "en", 3, "text 3 "), (3, "s", "fr", 3, "text 3")):
        assert merkle.manifest(frame(spark, [change if r[0] == 3 else r for r in rows])).root != root


def test_batches_of_sliced_arrow_columns():
    column = pa.array(["ab", None, "cd e", "f"]).slice(1, 2)
    data, offsets = shared.utf8(column)
    assert data.tobytes() == b"cd e" and offsets.tolist() == [0, 0, 4]


def test_texts_go_no_further_than_their_leaves(spark):
    rows = [(k, "s", "en", k, f"Text {k} " * 50) for k in range(40)]
    leaves = merkle.manifest(frame(spark, rows)).leaves
    plan = leaves._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan  # they were hashed in the first pass, and are not read again
    assert set(leaves.columns) == {"doc_id", "leaf", "subroot", "path"}
