"""The n-gram join, the embedding near-dedup and their shared parts, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import blocks, embed, ngram_join
from veritrail.llm.common import Scratch, WordHashes

RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS, n))


def changed(t, k):
    w = t.split()
    for i in RNG.choice(len(w), k, replace=False):
        w[i] = "x" + str(RNG.integers(10**6))
    return " ".join(w)


def sets(t, n=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def component(linked):
    lab = np.arange(len(linked))
    while True:
        new = np.minimum(lab, np.where(linked, lab[None, :], len(lab)).min(1, initial=len(lab)))
        if (new == lab).all():
            return lab
        lab = new


def brute(rows):
    """(id, text) rows to sorted (id, class, links)."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    s = [sets(t) for _, t in rows]
    n = len(s)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and s[i] and s[j]:
                linked[i, j] = len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])
    lab = component(linked)
    return sorted((rows[i][0], rows[lab[i]][0], int(linked[i].sum())) for i in range(n))


def corpus():
    base = [text(60) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[0]) for i in range(40)]  # exact copies
    rows += [(200 + i, changed(base[1], 1)) for i in range(150)]  # a large group of near copies: several parts
    rows += [(400 + i, changed(base[2], i)) for i in range(1, 9)]
    rows += [(500, "  "), (501, ""), (502, None), (503, "one two"), (504, "ONE\ttwo"), (505, "one two three"), (506, text(20_000))]
    rows += [(507, rows[-1][1] + " more"), (0, base[0]), (0, base[0])]  # very long; repeated rows
    return rows


def test_bands_reach_the_target():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.9999)


def test_overlaps_count_shared_grams():
    h = WordHashes()
    s = [ngram_join.grams(t, h) for t in ("a b c d e f", "b c d e f g", "a b c d e f", "q")]
    own = ngram_join._overlaps(s, None).astype(int)
    np.fill_diagonal(own, 0)  # a set is never compared with itself
    assert own.tolist() == [[0, 1, 2, 0], [1, 0, 1, 0], [2, 1, 0, 0], [0, 0, 0, 0]]
    assert ngram_join._overlaps(s[:2], s[2:]).astype(int).tolist() == [[2, 0], [1, 0]]


@pytest.mark.parametrize("few", [1, 3, 8])
def test_overlaps_equal_sets(few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    s = [np.unique(RNG.integers(0, 60, RNG.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in s] for a in s])
    own = ngram_join._overlaps(s, None).astype(int)
    np.fill_diagonal(own, 0)
    np.fill_diagonal(want, 0)
    assert (own == want).all() and (ngram_join._overlaps(s[:11], s[11:]).astype(int) == want[:11, 11:]).all()


def test_large_groups_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_ROWS", 16)
    rows = corpus()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_one_of_each_has_a_rule_for_every_tie(spark):
    a, b = text(30), text(40)
    rows = [(1, a, "en", 5), (1, a, "de", 5), (1, a, "de", 4), (2, None, "x", 1), (2, "", "fr", 1), (2, "", "fr", 1), (None, b, "b", 1), (7, b, "b", 2), (8, b, "a", 1), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key string, `text.key` int")
    for parts in (1, 3):
        kept = ngram_join.one_of_each(df.repartition(parts))
        assert kept.columns == df.columns
        assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a, "de", 4), (2, None, "x", 1), (2, "", "fr", 1), (2, "", "fr", 1), (7, b, "b", 2), (None, None, None, None)], key=str)


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_links int, key string")  # clashing names
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_texts(df).collect())
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g for g in got if g not in want] == [] and len(got) == len(want)


def test_one_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "a", None) for i, t in rows], "doc_id long, text string, root string, key binary").repartition(5)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    classes = {}
    for i, c, _ in brute(rows):
        classes.setdefault(c, i)
    want = sorted({c for c in classes if c not in (500, 501, 502)} | {500, 501, 502})
    assert got == want


def test_null_ids_and_empty_tables(spark):
    t = text(30)
    df = spark.createDataFrame([(None, t), (None, t), (3, t), (None, text(30))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_texts(df).collect()), key=str)
    assert got == sorted([(None, 3, 2), (None, 3, 2), (3, 3, 2), (None, None, 0)], key=str)
    assert ngram_join.similar_texts(df.limit(0)).count() == 0 and ngram_join.one_of_each(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 200), (200, 300), (400, 400)]
    out = {r.node: r.root for r in blocks.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[100 + i] == 100 for i in range(50)) and out[300] == out[200] == 200 and 400 not in out
    assert blocks.components(spark.createDataFrame([], "u long, v long"), Scratch(spark)).count() == 0


def test_plan_lets_every_two_members_of_a_bucket_meet_once(spark):
    rows = [(k, 1) for k in range(30)] + [(k, 2) for k in range(25, 40)] + [(77, 3), (78, 4), (79, 4)]
    plan = blocks.meeting_plan(spark.createDataFrame(rows, "key long, bucket long"), spark.createDataFrame([(k, 1) for k in {r[0] for r in rows}], "key long, weight long"), Scratch(spark), 6, 100).collect()
    met = {}
    for r in plan:
        for m in r.meetings:
            met.setdefault(m.pair, []).append((r.key, m.side))
    seen = {}
    for members in met.values():
        cross = any(s for _, s in members)
        for i, (a, x) in enumerate(members):
            for b, y in members[i + 1 :]:
                if not cross or x != y:
                    seen[frozenset((a, b))] = seen.get(frozenset((a, b)), 0) + 1
    for b in (1, 2, 4):
        keys = [k for k, x in rows if x == b]
        assert all(seen[frozenset((p, q))] == 1 for i, p in enumerate(keys) for q in keys[i + 1 :])
    assert max(seen.values()) == 1 and 77 not in {r.key for r in plan} and max(map(len, met.values())) <= 30


def vectors():
    v = RNG.normal(size=(300, 64))
    v[20:60] = v[0] + 0.05 * RNG.normal(size=(40, 64))
    v[60:70] = v[1]
    v[70:90] = v[2] + 0.22 * RNG.normal(size=(20, 64))  # around the threshold
    return v.astype(np.float32)


def test_estimates_are_unbiased_and_bounded():
    v = RNG.normal(size=(200, 64))
    v[100:] = v[:100] + RNG.normal(size=(100, 64)) * np.linspace(0, 2, 100)[:, None]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    signs, factor, _ = embed.Coder(4, 8)(u)
    turn = embed.rotations(64, 1)
    assert np.allclose(turn.T @ turn, np.eye(64))
    estimate = ((signs * 2 - 1) / 16) @ (u @ turn.T).T / factor[:, None]
    off = estimate - u @ u.T
    bound = embed.EPSILON * np.sqrt((1 - factor**2) / factor**2) / np.sqrt(255)
    assert abs(off.mean()) < 0.003 and (np.abs(off) < bound[:, None]).all()
    near = embed.possible(signs.astype(np.int8), factor, u, turn.astype(np.float32))
    assert near[u @ u.T >= 0.95].all() and near.mean() < 0.2


def test_tables_reach_the_target():
    for n in (1, 1000, 10**7):
        tables, bits = embed.choose_tables(n)
        assert 1 - (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables >= 0.9999


@pytest.mark.parametrize("part", [2048, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(embed, "PART", part)  # large buckets meet in parts
    monkeypatch.setattr(embed, "ROWS", 7)
    v = vectors()
    extra = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [float("inf")] + [0.0] * 63), (908, [1e-38] * 64), (909, [3.0] * 64)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + extra + [(5, v[5].tolist())]
    df = spark.createDataFrame([(i, x, "n", 1) for i, x in rows], "vec_id long, embedding array<float>, unit string, id int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_vectors(df).collect())
    ids = [i for i, _ in rows]
    u = [embed.unit(None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for _, x in rows]
    n = len(rows)
    linked = np.array([[i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and float(u[i] @ u[j]) >= 0.95 for j in range(n)] for i in range(n)])
    order = np.argsort(ids, kind="stable")
    linked, ids = linked[np.ix_(order, order)], [ids[i] for i in order]
    lab = component(linked)
    want = sorted((ids[i], int(linked[i].sum()), ids[lab[i]], ids[lab[i]] == ids[i]) for i in range(n))
    assert got == want
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_meetings_of_several_tables_and_lengths_are_kept_apart():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    near, far = (np.stack([embed.unit(x) for x in rng.normal(size=(1, d)) + 0.01 * rng.normal(size=(4, d))]) for d in (8, 300))
    rows = []
    for t, units in ((0, near), (0, far), (3, near)):  # one meeting, by a hash that collides
        signs, factor, _ = embed.Coder(4, 8)(units)
        for i, u in enumerate(units):
            scale = np.abs(u).max() / 127
            rows.append((5, t, 0, len(u), f"{len(u)}:{i}".encode(), np.packbits(signs[i]).tobytes(), factor[i], np.rint(u / scale).astype(np.int8).tobytes(), scale))
    names = ["meeting", "table", "side", "dim", "key", "signs", "factor", "query", "scale"]
    got = pa.Table.from_batches(embed._near(4, 8, 0.95)(iter([pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])]))).to_pylist()
    assert sorted((r["table"], r["key"]) for r in got if r["table"] == 0) == sorted((0, f"{d}:{i}".encode()) for d in (8, 300) for i in range(4))


def test_recall_of_links_around_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(400, 64))
    other = base + 0.33 * rng.normal(size=base.shape)  # cosines from about 0.93 to 0.97
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([base, other]))]
    got = {r.vec_id: r.n_links for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = np.concatenate([base, other])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    assert 200 < linked.sum() and [got[i] for i in range(800)] == linked.sum(1).tolist()
