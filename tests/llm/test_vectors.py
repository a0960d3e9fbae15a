"""The operators over embeddings against plain Python and numpy, with NULLs, ties, repeated rows and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import eigen, hard_negatives, vector_groups, whitening
from millrace.llm.components import components
from millrace.llm.vectors import finite, whole

SCHEMA = "vec_id long, embedding array<double>, label int, x string, node string, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    made = [(i, np.round(rng.standard_normal(4), 1).tolist(), int(rng.integers(3))) for i in range(150)]
    made += [(i, [v * 3 for v in made[i - 150][1]], made[i - 150][2]) for i in range(150, 200)]  # many equal directions
    made += [(200, None, 1), (201, [1.0, None, 2.0, 3.0], 1), (202, [1.0, float("nan"), 2.0, 3.0], 1), (203, [float("inf"), 0.0, 0.0, 0.0], 1)]
    made += [(204, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 4.0], 1), (205, [0.0] * 4, 1), (206, [], 1), (207, [1.0, 2.0], 1)]
    made += [made[0], made[0], made[10], made[17]]  # repeated rows, of an anchor too
    return made


def usable(made):
    return [r for r in made if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]


def mined(made, is_anchor, positives=5, negatives=5):
    rows = [(i, label, [math.floor(256 * v) for v in x]) for i, x, label in usable(made) if i is not None and label is not None]
    out = []
    for a, label, x in {(i, label, tuple(x)) for i, label, x in rows if is_anchor(i)}:
        scored = [(-sum(p * q for p, q in zip(x, y)), i, m) for i, m, y in rows if i != a and len(x) == len(y)]
        for s, p, _ in sorted(t for t in scored if t[2] == label)[:positives]:
            window = sorted(t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s)
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("numbers", [1 << 21, 20])
def test_hard_negatives(spark, rows, numbers):
    table = frame(spark, rows).where(finite(F.col("embedding"))).withColumn("x", whole(F.col("embedding"), 256))
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0, numbers=numbers).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_huge_numbers_and_of_none(spark):
    big = [(i, [1e6 + i, -1e6, 1e20 * (i == 7)], i % 2) for i in range(12)]
    table = frame(spark, big).withColumn("x", whole(F.col("embedding"), 256))
    got = hard_negatives.mine(table, F.col("vec_id") < 5).collect()
    assert sorted(tuple(r) for r in got) == mined(big, lambda i: i < 5)
    assert hard_negatives.mine(table, F.col("vec_id") > 99).count() == 0
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") < 5).count() == 0


def grouped(made, least):
    taking = [k for k, r in enumerate(made) if r[2] is not None and r in usable([r]) and any(r[1])]
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    near = {k: [j for j in taking if j != k and made[j][2] == made[k][2] and len(made[j][1]) == len(made[k][1])
                and cos(made[j][1], made[k][1]) >= least] for k in taking}
    out = []
    for k, r in enumerate(made):
        seen, front = {k}, [k]
        while front:
            front = [j for i in front for j in near.get(i, []) if j not in seen and not seen.add(j)]
        ids = [made[j][0] for j in seen if made[j][0] is not None]
        first = min(ids, default=None)
        out.append((r[0], len(near.get(k, [])), first, r[0] == first))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, tile", [(0.93, 1024), (0.93, 4), (0.8, 7), (0.999, 2)])
def test_vector_groups(spark, rows, least, tile):
    got = vector_groups.near_duplicates(frame(spark, rows), least=least, tile=tile).collect()
    assert sorted((tuple(r) for r in got), key=str) == grouped(rows, least)


def test_a_crowd_with_outsiders_is_counted_whole(spark):
    """One crowd of a third of all rows beside a chain that leads out of it, over several blocks and passes."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    crowd = [centre + rng.standard_normal(16) * 0.05 * np.linalg.norm(centre) / 4 for _ in range(700)]
    away = rng.standard_normal(16)
    chain = [centre * math.cos(t) + away * math.sin(t) * np.linalg.norm(centre) / np.linalg.norm(away) for t in np.linspace(0, 1.2, 40)]
    others = [rng.standard_normal(16) for _ in range(1600)]
    made = [(i, v.tolist(), 3) for i, v in enumerate([*crowd, *chain, *others])]
    x = np.array([r[1] for r in made])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.93
    want, at = near.sum(axis=1) - 1, np.arange(len(x))
    while (at != (up := np.array([at[r].min() for r in near]))).any():
        at = up
    for tile in (1024, 100):
        got = sorted(vector_groups.near_duplicates(frame(spark, made), tile=tile).collect(), key=lambda r: r.vec_id)
        assert [r.n_links for r in got] == want.tolist()
        assert [r.component_id for r in got] == at.tolist()


def test_vector_groups_of_an_empty_table(spark, rows):
    assert vector_groups.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_as_many_passes_as_rows_need():
    assert vector_groups.passes_for(200, 0.93) == 1
    assert vector_groups.passes_for(5_000, 0.93) < vector_groups.passes_for(10**6, 0.93) < vector_groups.passes_for(10**9, 0.93) < 200


@pytest.mark.parametrize("few", [0, 500, 1 << 16])
def test_components_of_rising_chains(spark, few):
    """Chains of 1,000 links whose ids rise along them take rounds by the logarithm; few links are settled at once."""
    chains = spark.range(3).crossJoin(spark.range(1000).withColumnRenamed("id", "k"))
    links = chains.select((F.col("id") * 5000 + F.col("k")).alias("a"), (F.col("id") * 5000 + F.col("k") + 1).alias("b"))
    from millrace.llm import components as module

    tables, stage = [], module.stage
    module.stage = lambda df, tag: tables.append(tag) or stage(df, tag)
    try:
        got = components(links, few).collect()
    finally:
        module.stage = stage
    assert tables.count("goes") <= {0: 20, 500: 12, 1 << 16: 1}[few]
    roots = {}
    for r in got:
        roots.setdefault(r.node // 5000, set()).add(r.root)
    assert len(got) == 3003 and [len(v) for v in roots.values()] == [1, 1, 1]


@pytest.mark.parametrize("n", [1, 2, 3, 20, 64])
def test_leading_eigenpairs(n):
    a = np.random.default_rng(n).standard_normal((n, n))
    for m in (a @ a.T, np.eye(n), np.zeros((n, n)), np.diag(np.arange(n) // 3 * 1.0), a @ a.T * 1e-9, np.outer(a[0], a[0])):
        k = min(8, n)
        values, vectors = eigen.leading(m, k)
        size = max(np.abs(m).max(), 1e-300) * n
        assert np.abs(values - np.linalg.eigvalsh(m)[::-1][:k]).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(m @ vectors - vectors * values).max() <= 1e-12 * size


def test_whitening(spark, rows):
    kept = [r for r in usable(rows) if len(r[1]) == 4]
    table = whitening.usable(frame(spark, rows))
    model = whitening.fit(table)
    got = sorted(whitening.whitened(table, model).collect(), key=lambda r: (r.component, str(r.vec_id), r.deviation, abs(r.whitened)))
    x = np.array([[math.floor(1024 * v) + 100_000 for v in r[1]] for r in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors / np.sqrt(values)
    assert len(got) == 4 * n
    for c in range(4):
        mine = [r for r in got if r.component == c + 1]
        theirs = sorted(zip([str(r[0]) for r in kept], ((n * x - sums) ** 2).sum(axis=1).tolist(), np.abs(want[:, c]).tolist()))
        assert [(str(r.vec_id), r.deviation, r.n) for r in mine] == [(i, d, n) for i, d, _ in theirs]
        assert np.allclose([abs(r.whitened) for r in mine], [w for *_, w in theirs], atol=1e-10)
        signed = {r.vec_id: r.whitened for r in mine if r.vec_id is not None}
        one_way = np.array([signed[r[0]] * want[k, c] for k, r in enumerate(kept) if r[0] is not None])
        assert (one_way > -1e-12).all() or (one_way < 1e-12).all()
        assert abs(mine[0].explained - values[c] / values.sum()) < 1e-12
    assert whitening.identity_error(table, model) < 1e-9


def test_whitening_of_little(spark):
    none = whitening.usable(frame(spark, []))
    assert whitening.fit(none) is None and whitening.whitened(none, None).count() == 0
    alike = whitening.usable(frame(spark, [(i, [1.0, 2.0], 1) for i in range(3)]))
    assert whitening.whitened(alike, model := whitening.fit(alike)).count() == 0 and model.trace == 0.0
    line = whitening.usable(frame(spark, [(i, [float(i), 2.0 * i, 5.0], 1) for i in range(9)]))
    model = whitening.fit(line)
    assert {r.component for r in whitening.whitened(line, model).collect()} == {1} and whitening.identity_error(line, model) < 1e-9
    huge = whitening.usable(frame(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 1.0], 1), (3, [0.0, 2.0], 1)]))
    got = whitening.whitened(huge, whitening.fit(huge)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.deviation for r in got if r.vec_id == 1} == {None}
