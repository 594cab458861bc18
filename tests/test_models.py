"""Models that SQL can't express, against plain numpy versions of the same objectives on whole small tables."""

import numpy as np
import pytest

from clinspan.plans import catalogue, evaluate, features, lens, model

SF = "/root/testdata/sf0.01"  # with deaths enough among training rows


def optimum(x, y, w=None):
    """Coefficients and intercept that minimise the sum of weighted losses and half the squared coefficients, by Newton."""
    w = np.ones(len(y)) if w is None else w
    rows = np.column_stack([x, np.ones(len(y))])
    scale = np.where(np.abs(rows).max(axis=0) > 0, np.abs(rows).max(axis=0), 1.0)
    rows = rows / scale
    ridge = np.diag(np.append(np.ones(x.shape[1]), 0.0) / scale**2)
    loss = lambda b: np.sum(w * (np.logaddexp(0, rows @ b) - y * (rows @ b))) + 0.5 * b @ ridge @ b
    beta = np.zeros(rows.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-rows @ beta))
        gradient = rows.T @ (w * (p - y)) + ridge @ beta
        step = np.linalg.lstsq(rows.T @ (rows * (w * p * (1 - p))[:, None]) + ridge, gradient, rcond=None)[0]
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-9:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-12:
            break
    return beta / scale


def probability(beta, x):
    return 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))


def split_rows(rows, columns):
    """Ids, imputed features and labels of training and test rows, from collected rows."""
    train, test = ([r for r in rows if (r["subject_id"] % 10 < 7) == side] for side in (True, False))
    cells = lambda part: np.array([[np.nan if r[c] is None else float(r[c]) for c in columns] for r in part])
    x = cells(train)
    means = np.array([np.nanmean(c) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    out = []
    for part in (train, test):
        v = cells(part)
        out.append(([r["subject_id"] for r in part], np.where(np.isnan(v), means, v), np.array([float(r[features.OUTCOME]) for r in part])))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return catalogue._features(spark, SF, "subject").collect()


def held(got, ids, want, within):
    found = {r["subject_id"]: r["score"] for r in got}
    assert len(got) == len(ids) and sorted(found) == sorted(ids)
    assert max(abs(found[i] - p) for i, p in zip(ids, want, strict=True)) < within


def test_logistic_regression_is_the_optimum(spark, table):
    (_, x, y), (ids, x2, y2) = split_rows(table, catalogue._COLUMNS)
    assert 0 < y.sum() < len(y)
    got = catalogue.QUERIES["m2_logistic_regression"](spark, SF).collect()
    held(got, ids, probability(optimum(x, y), x2), 2e-3)
    assert {r["subject_id"]: r["label"] for r in got} == dict(zip(ids, y2, strict=True))


def test_weighted_regression_is_the_optimum(spark, table):
    (_, x, y), (ids, x2, _) = split_rows(table, catalogue._COLUMNS)
    weights = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    held(catalogue.QUERIES["m9_weighted_regression"](spark, SF).collect(), ids, probability(optimum(x, y, weights), x2), 2e-3)


def test_boosted_trees_learn_and_score_each_test_row(spark, table):
    (_, _, y), (ids, _, _) = split_rows(table, catalogue._COLUMNS)
    got = catalogue.QUERIES["m4_boosted_trees"](spark, SF).collect()
    assert sorted(r["subject_id"] for r in got) == sorted(ids) and all(0 <= r["score"] <= 1 for r in got)
    train, _ = catalogue._trained(spark, SF)
    seen = model.scored(model.fit_boosted_trees(train), train, "subject_id").collect()
    positive, negative = ([r["score"] for r in seen if r["label"] == side] for side in (1.0, 0.0))
    assert len(seen) == len(y) and np.mean([(a > b) + (a == b) / 2 for a in positive for b in negative]) > 0.9


def plain_auroc(scores, labels):
    a, b = scores[labels == 1], scores[labels == 0]
    return float(np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b))) if len(a) and len(b) else None


def test_comparison_with_frailty(spark, table):
    frailty = {r["subject_id"]: r["hfrs"] for r in catalogue._frailty(spark, SF).collect()}
    rows = [{**r.asDict(), "hfrs": frailty[r["subject_id"]]} for r in table if r["subject_id"] in frailty]
    got = {(r["frailty"], r["emop"]): r for r in catalogue.QUERIES["m16_with_and_without_frailty"](spark, SF).collect()}
    emop = {r["subject_id"]: int(r["emop"]) for r in rows}
    for name, columns in (("without", catalogue._COLUMNS), ("with", [*catalogue._COLUMNS, "hfrs"])):
        (_, x, y), (ids, x2, y2) = split_rows(rows, columns)
        scores = probability(optimum(x, y), x2)
        for e in {emop[i] for i in ids}:
            at = np.array([emop[i] == e for i in ids])
            want = plain_auroc(scores[at], y2[at])
            found = got[name, e]["auroc"]
            assert (found is None) == (want is None) and (want is None or abs(found - want) < 0.02)


@pytest.fixture(scope="module")
def windows(spark):
    rows = catalogue._window_vectors(spark, SF).select("subject_id", model.vector_to_array("features").alias("v")).collect()
    return np.array([r["subject_id"] for r in rows]), np.array([r["v"] for r in rows])


def components(v, k):
    return np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :k]


def test_window_embeddings_reconstruct_as_principal_components_do(spark, windows):
    subjects, v = windows
    c = components(v, 4)
    errors = ((v - v @ c @ c.T) ** 2).mean(axis=1)
    got = catalogue.QUERIES["m10_window_embeddings"](spark, SF).collect()
    assert sorted(r["subject_id"] for r in got) == sorted(set(subjects.tolist()))
    for r in got:
        own = subjects == r["subject_id"]
        assert r["n_windows"] == own.sum() and abs(r["error"] - errors[own].mean()) < 1e-5
        assert np.allclose(np.abs(r["embedding"]), np.abs((v[own] @ c).mean(axis=0)), atol=1e-4)  # signs are free


def test_classifier_of_embeddings(spark, windows):
    subjects, v = windows
    c = components(v, 4)
    labels = {r["subject_id"]: float(r["label"]) for r in catalogue._labelled(spark, SF).collect()}
    ids = np.array(sorted(i for i in set(subjects.tolist()) if i in labels))
    x, y = np.array([(v[subjects == i] @ c).mean(axis=0) for i in ids]), np.array([labels[i] for i in ids])
    train = ids % 10 < 7
    positives = (y[train] == 1).sum()
    weights = np.where(y[train] == 1, (y[train] == 0).sum() / positives if positives else 1.0, 1.0)
    want = probability(optimum(x[train], y[train], weights), x[~train])
    held(catalogue.QUERIES["m11_embedding_classifier"](spark, SF).collect(), ids[~train].tolist(), want, 5e-3)


def test_embedding_plane(spark):
    rows = lens.read(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    v = np.array([r["embedding"] for r in rows], dtype="float64")
    want = dict(zip((r["vec_id"] for r in rows), v @ components(v, 2), strict=True))
    got = catalogue.QUERIES["m12_embedding_plane"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(np.abs([r["x"], r["y"]]), np.abs(want[r["vec_id"]]), atol=1e-4)


def test_curve_of_skewed_scores_by_group(spark):
    """Distinct scores near 0, one group without positives, null scores left out, a null group kept."""
    rows = [(["a", "b", None][i % 3], None if i % 50 == 0 else 2.0 ** -(i % 97), int(i % 3 != 1 and i % 7 == 0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    got = {(r["g"], r["score"]): r for r in evaluate.curve(df, "s", "y", ["g"]).collect()}
    want = {(g, s) for g, s, _ in rows if s is not None}
    assert set(got) == want
    for (g, s), r in got.items():
        above = [y for g2, s2, y in rows if g2 == g and s2 is not None and s2 >= s]
        own = [y for g2, s2, y in rows if g2 == g and s2 is not None]
        assert (r["seen"], r["tp"], r["positives"], r["negatives"]) == (len(above), sum(above), sum(own), len(own) - sum(own))
