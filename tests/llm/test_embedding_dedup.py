import numpy as np
import pytest

from lamella.llm.embedding_dedup import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed=4, dims=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dims))
    out = [(i, base[i], int(i % 3)) for i in range(60)]
    for i in range(60, 200):
        k = int(rng.integers(0, 20))
        out.append((i, base[k] + rng.normal(size=dims) * 0.1, k % 3))
    out += [(300, base[3], 0), (301, base[3], 0), (302, base[3], 1), (303, base[3] * 2, 0), (303, base[3], 0)]
    out = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in out]
    return out + [(400, None, 0), (401, [], 0), (402, [0.0] * dims, 0), (403, [float("nan")] * dims, 0), (404, out[3][1], None), (405, [None, *out[3][1][1:]], 0), (None, out[3][1], 0), (406, out[3][1][:5], 0), (407, out[3][1][:5], 0), (408, [float("inf")] * dims, 0)]


def brute(data, threshold=0.93):
    unit = []
    for _, v, c in data:
        ok = v is not None and len(v) and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)
    n, root = [0] * len(data), list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (v, _, _) in enumerate(data):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    return sorted(((v, n[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _, _) in enumerate(data)), key=repr)


@pytest.mark.parametrize("more", [{}, {"block": 7}, {"probe_from": 0}, {"probe_from": 0, "block": 7}])
def test_against_brute_force(spark, more):
    data = rows()
    got = sorted((tuple(r) for r in embedding_dedup(spark.createDataFrame(data, SCHEMA).repartition(3), **more).collect()), key=repr)
    want = brute(data)
    assert [x[0] for x in got] == [x[0] for x in want]
    found, all_ = sum(x[1] for x in got), sum(x[1] for x in want)
    assert 0.95 * all_ <= found <= all_
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.9 * len(want)


def near_threshold(seed=8, dims=64, pairs=600):
    """Pairs of cosine 0.93 to 0.94 in as many dimensions as the code has bits; no two others come near."""
    rng, out = np.random.default_rng(seed), []
    for i in range(pairs):
        a, b = np.linalg.qr(rng.normal(size=(dims, 2)))[0].T
        cosine = rng.uniform(0.9301, 0.94)
        out += [(2 * i, a, i % 2), (2 * i + 1, cosine * a + np.sqrt(1 - cosine**2) * b, i % 2)]
    return [(i, [float(np.float32(x)) for x in v], c) for i, v, c in out]


def test_recall_near_the_threshold_at_every_size(spark):
    """The rotation is fitted on few of the vectors, as it is on a large table."""
    data = near_threshold()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    small, large = ({r.vec_id: r.n_links for r in embedding_dedup(df, sample=200, probe_from=n).collect()} for n in (4_000_000, 0))
    assert small == large and set(large.values()) <= {0, 1}
    assert sum(large.values()) >= 0.95 * len(data)


def test_empty(spark):
    assert embedding_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    lone = embedding_dedup(spark.createDataFrame([(1, None, 1), (2, [1.0, 0.0], None)], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in lone} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_labels_of_other_types(spark):
    rows = [(1, [1.0, 0.0], "a", 1.2), (2, [1.0, 0.0], "b", 1.7), (3, [2.0, 0.0], "a", 1.2), (4, [1.0, 0.0], None, None)]
    for kind, place in (("string", 2), ("double", 3)):
        df = spark.createDataFrame([(r[0], r[1], r[place]) for r in rows], f"vec_id long, embedding array<double>, label {kind}")
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup(df).collect())
        assert got == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 0, 4)]
