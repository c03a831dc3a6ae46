from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from taleweave.llm import clusters, neighbours
from taleweave.plans import shared
from taleweave.llm.vectors import Lists, pack, unit, unpack, usable

DIMS = 32


def world(seed=0, groups=25, dims=DIMS):
    """Vectors in groups of uneven size around random centres, singles, copies, and unusable ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = unit(rng.normal(size=(1, dims)))[0]
        for _ in range(int(rng.integers(1, 12)) if g else 60):
            v = unit((centre + 0.12 * rng.normal(size=dims) / 1.5)[None, :])[0] * rng.choice([1.0, 7.5])
            rows.append((f"id{len(rows):04}", np.round(v, 4).astype(np.float32).tolist()))
    rows += [(f"id{len(rows) + i:04}", rows[3][1]) for i in range(9)]  # copies: ties
    bad = [None, [], [0.0] * dims, [1.0] * (dims - 1), [float("nan")] * dims, [None] * dims]
    rows += [(f"zz{i}", v) for i, v in enumerate(bad)] + [(None, rows[0][1])]
    return rows + rows[:5]


def matrix(rows):
    good = {i: v for i, v in rows if i and v and len(v) == DIMS and None not in v and not np.isnan(v).any() and any(v)}
    ids = sorted(good)
    x = np.array([good[i] for i in ids], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    return ids, s


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, embedding array<float>").selectExpr("*", "'x' AS vec", "1 AS list", "2 AS score", "cast(null AS string) AS composite_text")


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(50, DIMS)), 4).astype(np.float32)
    assert (unpack(pack(x), DIMS) == x).all() and pack(x).nbytes < x.nbytes
    x[::3] = rng.normal(size=x[::3].shape).astype(np.float32) * 1e6
    p = pack(x)
    assert (unpack(p, DIMS) == x).all() and (unpack(p[7:20], DIMS) == x[7:20]).all()
    assert len(pack(x[:0])) == 0 and unpack(pa.array([], pa.binary()), DIMS).shape == (0, DIMS)


def test_usable_rows():
    a = pa.array([[1.0] * 3, None, [], [0.0] * 3, [1.0, None, 2.0], [float("nan")] * 3, [2.0] * 3, [1.0] * 4], pa.list_(pa.float32()))
    rows, x = usable(a, 3)
    assert rows.tolist() == [0, 6] and x.tolist() == [[1.0] * 3, [2.0] * 3]
    assert usable(a[6:], 3)[0].tolist() == [0]


def test_graph_search_finds_the_nearest_lists(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(Lists, "PIVOTS", 16)
    centres = unit(rng.normal(size=(40, DIMS)))
    x = unit(np.repeat(centres, 60, axis=0) + 0.6 * rng.normal(size=(2400, DIMS)) / np.sqrt(DIMS))
    index = Lists.fit(x, 20, 10_000)
    q = x[::7]
    top, _ = index.search(q, 1)
    assert index.groups and (top[:, 0] == (q @ index.centroids.T).argmax(axis=1)).mean() >= 0.98
    assert sorted(np.concatenate(index.groups)) == list(range(len(index.centroids)))


def test_nearest_against_brute_force(spark):
    rows = world()
    ids, s = matrix(rows)
    want = set()
    for i, a in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5]
        want |= {(a, ids[j], s[i, j]) for j in order if s[i, j] >= 0.7}
    got = {tuple(r) for r in neighbours.nearest(frame(spark, rows), dims=DIMS).collect()}
    assert got == want  # few lists: nothing is lost at this size
    assert neighbours.nearest(frame(spark, rows).limit(0), dims=DIMS).collect() == []


@pytest.mark.parametrize("block", [8_192, 16])
def test_nearest_recall_over_many_lists(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rows = world(3, 120)
    ids, s = matrix(rows)
    want = set()
    for i, a in enumerate(ids):
        want |= {(a, ids[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:5] if s[i, j] >= 0.7}
    got = {(r.id, r.other) for r in neighbours.nearest(frame(spark, rows), dims=DIMS).collect()}
    assert len(got & want) / len(want) >= 0.9


def groups_by_hand(rows, texts, least=0.7, share=0.7):
    ids, s = matrix(rows)
    up = {i: i for i in {*ids, *texts}}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(s >= least)):
        up[find(ids[i])] = find(ids[j])
    words = {i: set(t.lower().split()) for i, t in texts.items()}
    for a in set(words) - set(ids):
        for b in set(words) & set(ids):
            both = len(words[a] & words[b])
            if both and both >= share * len(words[a] | words[b]) - 1e-9:
                up[find(a)] = find(b)
    out = {}
    for i in up:
        out.setdefault(find(i), set()).add(i)
    return {(i, min(g)) for g in out.values() if len(g) >= 3 for i in g}


@pytest.mark.parametrize(("local_rows", "exact"), [(8_192, False), (40, False), (40, True)])
def test_clusters_against_brute_force(spark, local_rows, exact):
    rows = world(4, 60)
    rng = np.random.default_rng(5)
    texts = {}
    for i, v in rows:
        if i and rng.random() < 0.8:
            near = int(i[2:]) // 6 if i[2:].isdigit() else 0
            texts[i] = " ".join(["the"] + [f"W{near}x{k}" for k in range(10)] + [f"own{i}"])
    for k in range(12):
        rows.append((f"t{k:03}", None))
        texts[f"t{k:03}"] = " ".join(["The"] + [f"w{k * 3}X{j}" for j in range(10)] + ([f"extra{j}" for j in range(k)]))
    texts["zz0"] = ""
    df = spark.createDataFrame([(i, v, texts.get(i)) for i, v in rows], "id string, embedding array<float>, composite_text string").selectExpr("*", "1 AS leaf", "2 AS part", "3 AS words")
    texts = {i: t for i, t in texts.items() if t}
    got = clusters.clusters(df, dims=DIMS, local_rows=local_rows, exact=exact)
    found, want = {(r.id, r.cluster_id) for r in got.collect()}, groups_by_hand([(i, v) for i, v in rows], texts)
    if local_rows > len(rows) or exact:
        assert found == want
    else:  # links between nodes are looked for through medoids: what is found is true, and little is missing
        assert found <= want and len(found) >= 0.97 * len(want)
    told = clusters.describe(got, df, dims=DIMS).collect()
    assert {r.cluster_id: r.n_members for r in told} == Counter(c for _, c in found)
    good, x = {i: v for i, v in rows if i and v and len(v) == DIMS and None not in v and not np.isnan(v).any() and any(v)}, {}
    for i, c in found:
        if i in good:
            x.setdefault(c, []).append((i, unit(np.array([good[i]], np.float32))[0]))
    for r in told:
        centre = np.sum([v for _, v in x[r.cluster_id]], axis=0, dtype=np.float64)
        cos = {i: float(v @ centre / np.linalg.norm(centre)) for i, v in x[r.cluster_id]}
        want = sorted(cos.values(), reverse=True)[:3]
        assert np.allclose([cos[i] for i in r.typical.split()], want, atol=1e-6) and r.largest_leaf <= r.n_members
    leaf = clusters.leaves(got).collect()
    assert sum(r.n_members for r in leaf) == sum(i in good for i, _ in found) and all(r.leaf in good for r in leaf)
    assert clusters.clusters(df.limit(0), dims=DIMS).collect() == []


def test_a_third_of_all_rows_as_copies(spark):
    """Copies do not split: their node is cut into blocks, and the blocks' medoids, all alike, meet in one list."""
    rng = np.random.default_rng(8)
    one = unit(rng.normal(size=(1, DIMS)))[0]
    rows = [(f"c{i:03}", one.tolist()) for i in range(100)] + [(f"s{i:03}", unit(rng.normal(size=(1, DIMS)))[0].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").selectExpr("*", "cast(null AS string) AS composite_text")
    tree, counts = clusters.grow(neighbours.packed(df, DIMS), np.array([v for _, v in rows[::9]], np.float32), DIMS, 16)
    assert sum(counts.values()) == len(rows) and sorted(counts.values())[-2] <= 16 and max(counts.values()) >= 100
    got = {(r.id, r.cluster_id) for r in clusters.clusters(df, dims=DIMS, local_rows=16).collect()}
    assert {(i, "c000") for i, _ in rows[:100]} <= got and got == groups_by_hand(rows, {})


def test_few_sample_rows_do_not_stop_the_splits(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{i:03}", unit(rng.normal(size=(1, DIMS)))[0].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    _, counts = clusters.grow(neighbours.packed(df, DIMS), np.array([rows[0][1]], np.float32), DIMS, 32)
    assert sum(counts.values()) == 400 and max(counts.values()) <= 32


def test_leaves_are_compact():
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(300, DIMS)))
    x[50:90] = x[50]
    leaves = clusters.leaves_of(x, 0.7, rng)
    assert sorted(i for at, _, _ in leaves for i in at) == list(range(300))
    assert all((x[at] @ x[m] >= 0.7 - 1e-6).all() for at, m, _ in leaves)
    assert any(len(at) >= 40 for at, _, _ in leaves)


def test_word_sets_in_turns_give_the_same_links(spark):
    rng = np.random.default_rng(3)
    sets = [sorted({int(w) for w in rng.integers(0, 40, 12)}) for _ in range(60)]
    sets += [s[:-1] for s in sets[:20]] + sets[20:30]
    rows = [(f"r{i:03d}", f"part{i % 17}", s) for i, s in enumerate(sets)]
    lacking = spark.createDataFrame([(i, w) for i, _, w in rows[60:]], "id string, words array<long>")
    members = spark.createDataFrame(rows[:60], "id string, part string, words array<long>")
    alike = lambda a, b: len({*a} & {*b}) >= 0.7 * len({*a} | {*b})
    want = {(i, p) for i, _, w in rows[60:] for _, p, v in rows[:60] if alike(w, v)}
    for turn_rows in (5, None):
        before = shared.written()
        got = {tuple(r) for r in clusters.text_links(lacking, members, 0.7, turn_rows).collect()}
        assert got == want and len(want) > 20
        assert any("taleweave-turn-" in path for _, path in shared._written[before:]) == (turn_rows == 5)


def test_few_unlike_word_sets_are_compared_and_in_bounded_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = [sorted(rng.choice(60, 30, replace=False).tolist()) for _ in range(200)]
    lacking = spark.createDataFrame([(f"r{i:03d}", s[1:]) for i, s in enumerate(sets)], "id string, words array<long>")
    members = spark.createDataFrame([(f"m{i:03d}", f"m{i:03d}", s) for i, s in enumerate(sets)], "id string, part string, words array<long>")
    cut, shared_words, rows = clusters.cut, clusters._shared_words, {}

    def counted(df, name):
        out = cut(df, name)
        rows[name] = out.count()
        return out

    def bounded(share):
        go = shared_words(share)

        def checked(key, left, right):
            assert left.num_rows <= 48
            return go(key, left, right)

        return checked

    monkeypatch.setattr(clusters, "ASKERS", 16)
    monkeypatch.setattr(clusters, "PAIRS", 7)
    monkeypatch.setattr(clusters, "cut", counted)
    monkeypatch.setattr(clusters, "_shared_words", bounded)
    got = {tuple(r) for r in clusters.text_links(lacking, members, 0.7).collect()}
    assert got == {(f"r{i:03d}", f"m{j:03d}") for i, a in enumerate(sets) for j, b in enumerate(sets) if len({*a[1:]} & {*b}) >= 0.7 * len({*a[1:]} | {*b})}
    assert 200 <= rows["pairs"] < 2_000  # of 40 000


def test_clusters_leave_only_their_result_behind(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(5, 8)), 4, axis=0) + 0.01 * rng.normal(size=(20, 8))
    rows = spark.createDataFrame([(f"c{i:02d}", v.tolist(), None) for i, v in enumerate(x)], "id string, embedding array<float>, composite_text string")
    before = shared.written()
    out = clusters.clusters(rows, dims=8)
    left = [path.rpartition("/")[2] for _, path in shared._written[before:]]
    assert len(left) == 1 and left[0].startswith("taleweave-grouped-")
    assert {r["id"] for r in out.collect()} == {f"c{i:02d}" for i in range(20)}
