import numpy as np

from foldloom.llm import ann
from foldloom.llm.entry_queries import QUERIES


def exact(ids, vectors, k=20, every=20):
    out = {}
    for q, v in zip(ids, vectors, strict=True):
        if q % every == 0:
            scores = vectors @ v
            order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
            out[int(q)] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def read(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return found


def test_recall_against_brute_force(spark, folder):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 2
    vectors = (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16))).astype(np.float32)
    ids = np.arange(1500)
    rows = QUERIES["op10_kmeans_tree_neighbours"](spark, folder(embeddings=[(int(i), v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)])).collect()
    found, true = read(rows), exact(ids, vectors.astype(np.float64))
    assert set(found) == set(true)
    hits = sum(len({a for a, _ in found[q]} & {a for a, _ in true[q]}) for q in true)
    assert hits / (20 * len(true)) >= 0.9
    for q, pairs in found.items():
        assert len(pairs) == 20 and pairs == sorted(pairs, key=lambda x: (-x[1], x[0]))
        assert np.allclose([s for _, s in pairs], [vectors[a].astype(np.float64) @ vectors[q].astype(np.float64) for a, _ in pairs])


def test_all_leaves_give_the_exact_answer_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (300, 4)).astype(np.float64)
    vectors[50:150] = [1.0, 2.0, 0.0, 1.0]  # a third are equal
    vectors[(vectors == 0).all(axis=1)] = 1.0
    ids = np.arange(300)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")
    for sizes in ({}, {"bin_rows": 16, "group_queries": 4}):
        rows = ann.neighbours(table, recall=1.0, slack=50.0, leaf_rows=10**6, **sizes).collect()
        assert read(rows) == exact(ids, vectors)


def test_fewer_candidates_than_asked(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert read(ann.neighbours(table).collect()) == {0: [(1, 0.5), (2, 0.0)]}


def test_visits_come_best_first():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, 8))
    tree = ann.grow(rows, 4, 10)
    leaves = [n for n, c in enumerate(tree.children) if not c]
    assert sorted(tree.visits(rows[0], len(leaves), 0.5)) == leaves
    assert np.isin(tree.leaf(rows), leaves).all()


def test_vectors_of_varied_length(spark, folder):
    """Under an inner product long vectors come first, and a row is often not its own best."""
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(1500, 16)) * rng.lognormal(0, 0.6, size=(1500, 1))).astype(np.float32)
    rows = QUERIES["op10_kmeans_tree_neighbours"](spark, folder(embeddings=[(k, v.tolist(), 0) for k, v in enumerate(vectors)])).collect()
    found, true = read(rows), exact(np.arange(1500), vectors.astype(np.float64))
    assert sum(len({a for a, _ in found[q]} & {a for a, _ in true[q]}) for q in true) / (20 * len(true)) >= 0.9


def test_calibration_leaves_out_the_row_itself():
    sample = np.array([[1.0, 0.0], [3.0, 0.0], [0.0, 1.0], [0.0, 2.0]])
    tree = ann.grow(sample, 2, 1)
    visits = [tree.visits(sample[0], 9, 0.5).index(leaf) for leaf in tree.leaf(sample[[1]])]
    assert ann.calibrate(tree, sample, np.array([0]), 1, 1.0, 0.5) == visits[0] + 1


def test_rows_that_repeat_an_id_are_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [0.5, 0.5])]
    found = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, recall=1.0).collect()
    lists = {}
    assert len(found) == 9 and sorted(r["rank"] for r in found) == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    for r in found:
        lists.setdefault(r["rank"], []).append((r["vec_id"], r["score"]))
    # both rows of [1, 0] find 7, 7 and each other; [0, 1] finds 7, 7 and 8
    assert sorted(lists[1]) == [(7, 1.0), (7, 2.0), (7, 2.0)] and sorted(lists[2]) == [(7, 1.0), (7, 2.0), (7, 2.0)] and sorted(lists[3]) == [(8, 0.5), (20, 1.0), (20, 1.0)]
