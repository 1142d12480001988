"""Metrics against direct Python formulas (support-weighted, classes seen
only in predictions, undefined ratios -> 0)."""

from plume.operators.metrics import binary_metrics, weighted_metrics


def _weighted(y, p):
    classes = sorted(set(y) | set(p))
    n = len(y)
    prec = rec = f1 = 0.0
    for c in classes:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        sup = sum(1 for a in y if a == c)
        pred = sum(1 for b in p if b == c)
        pc = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * tp / (sup + pred) if sup + pred else 0.0
        prec += sup * pc
        rec += sup * rc
        f1 += sup * fc
    return prec / n, rec / n, f1 / n


def test_weighted_metrics(spark):
    y = ["a", "a", "b", "b", "b", "c", "a", "c"]
    p = ["a", "b", "b", "b", "d", "c", "a", "a"]
    r = weighted_metrics(spark.createDataFrame(list(zip(y, p)), "label string, prediction string")).first()
    ep, er, ef = _weighted(y, p)
    assert abs(r.precision - ep) < 1e-9 and abs(r.recall - er) < 1e-9 and abs(r.f1 - ef) < 1e-9
    assert abs(r.recall - r.accuracy) < 1e-9      # weighted recall equals accuracy


def test_binary_metrics(spark):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)]
    r = binary_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1)
    assert r.accuracy == 0.6 and abs(r.precision - 2 / 3) < 1e-9 and abs(r.f1 - 2 / 3) < 1e-9
    r0 = binary_metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert (r0.precision, r0.recall, r0.f1) == (0.0, 0.0, 0.0)
