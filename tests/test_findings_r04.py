"""What the fourth round's findings showed, on small tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from burstlake.operators import evaluate
from burstlake.plans import queries, review  # noqa: F401  registers its queries, too


def learned(x, chosen, groups, rounds, rate, penalty=0.01):
    """Weights by plain steps over all rows, and the gradient that is left; ``groups``: where each begins."""
    sizes = np.diff(np.append(groups, len(chosen)))

    def gradient(w):
        z = x @ w
        e = np.exp(z - np.repeat(np.maximum.reduceat(z, groups), sizes))
        return x.T @ (e / np.repeat(np.add.reduceat(e, groups), sizes) - chosen) / len(groups) + penalty * w

    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, gradient(w)


def test_choice_is_trained_to_its_end(spark, tmp_path):
    """the query stopped after 20 of 400 steps, far from where they lead."""
    rng = np.random.default_rng(5)
    rows = [(g, k, float(q), float(d) / 100) for g in range(40) for k, (q, d) in enumerate(zip(rng.choice(50, 1 + g % 6, replace=False) + 1, rng.integers(0, 11, 6), strict=False))]
    con = duckdb.connect()
    con.execute("CREATE TABLE l (l_orderkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_discount DOUBLE)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY l TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = {r["name"]: r["weight"] for r in queries.QUERIES["g13_choice"](spark, str(tmp_path)).collect()}
    key, line, q, d = (np.array(c) for c in zip(*rows, strict=True))
    groups = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    best = {g: min((-(r[2] - 100 * r[3]), r[1]) for r in rows if r[0] == g)[1] for g in range(40)}
    want, left = learned(np.column_stack([q / 50, d * 10]), np.array([line[i] == best[g] for i, g in enumerate(key)], float), groups, 400, 0.2)
    assert np.abs(left).max() < 1e-6
    assert [got["q"], got["d"]] == pytest.approx(want)


@pytest.mark.parametrize("spread", [1.0, 400.0])
def test_packed_rows_give_the_gradient_of_all(monkeypatch, spread):
    """Blocks hold every row, of few values or many, and groups that blocks cut; products may lie far apart."""
    rng = np.random.default_rng(9)
    sizes = [1, 7, 900, 2, 40, 350]
    groups, n = np.cumsum([0, *sizes[:-1]]), sum(sizes)
    x = np.column_stack([rng.normal(0, spread, n), rng.integers(0, 5, n) / 4])
    new, chosen = np.zeros(n, bool), np.zeros(n, np.int32)
    new[groups] = True
    chosen[groups + np.array(sizes) // 2] = 1
    table = pa.table({"a": x[:, 0], "b": x[:, 1], "_y": chosen, "_new": new})
    w = np.array([1.5, -0.5])
    z = x @ w
    e = np.exp(z - np.repeat(np.maximum.reduceat(z, groups), sizes))
    want = x.T @ (e / np.repeat(np.add.reduceat(e, groups), sizes) - chosen)
    for block in (1, 3000, 1 << 20):
        monkeypatch.setattr(evaluate, "_BLOCK", block)
        packed = list(evaluate._packed(iter([table.to_batches()[0].slice(0, 0), *table.to_batches(max_chunksize=60)])))
        assert [sum(b[c][0].as_py() for b in packed) for c in ("begun", "n")] == [len(sizes), n]
        assert pa.Table.from_batches(evaluate._unpacked(iter(packed))).combine_chunks().equals(table.combine_chunks())
        found = next(evaluate._packed_gradient(w, (b.select(["rows"]) for b in packed)))
        assert [c[0].as_py() for c in found.columns] == pytest.approx(want)
    assert next(evaluate._packed_gradient(w, iter(())), None) is None


def test_a_step_starts_few_tasks(spark, monkeypatch):
    """Each step started a task for every partition of the shuffle, however small: 211 of them for 400 steps did not end."""
    rng = np.random.default_rng(2)
    rows = [(g, float(a), k == 1) for g in range(50) for k, a in enumerate(rng.normal(0, 1, 4))]
    df = spark.createDataFrame(rows, "g long, a double, y boolean")
    before, starts = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}, spark.sparkContext.accumulator(0)
    whole = evaluate._choice_gradient

    def counted(weights):
        def run(batches):
            starts.add(1)
            yield from whole(weights)(batches)

        return run

    monkeypatch.setattr(evaluate, "_packed_gradient", lambda weights, blocks: counted(weights)(evaluate._unpacked(blocks)))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = evaluate.fit_choice(df, ["g"], ["a"], "y", rounds=3, rate=0.2)
        assert starts.value == 3
        monkeypatch.setattr(evaluate, "_TASK", 50)
        assert evaluate.fit_choice(df, ["g"], ["a"], "y", rounds=3, rate=0.2) == pytest.approx(got)
        assert starts.value == 3 + 3 * 4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, _ = learned(np.array([[r[1]] for r in rows]), np.array([r[2] for r in rows], float), np.arange(0, 200, 4), 3, 0.2)
    assert got == pytest.approx(want)
