"""The numerics that run inside tasks, against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from onefold.operators.newton import CALM_STEPS, CodedDesign, in_the_limit, logistic_sums, newton_fit, pack, unpack
from onefold.operators.shrink import shrink, solution_path


def dense(numeric, codes, widths, intercept):
    cols = [np.ones((len(numeric), 1))] if intercept else []
    cols.append(numeric)
    for c, w in zip(codes, widths):
        cols.append((c[:, None] == np.arange(w)).astype(float))
    return np.hstack(cols)


def random_case(seed, n=400, widths=(3, 2), q=2, intercept=True):
    rng = np.random.default_rng(seed)
    numeric = rng.normal(size=(n, q))
    codes = [rng.integers(0, w + 1, n) for w in widths]
    design = CodedDesign(numeric, codes, list(widths), intercept)
    x = dense(numeric, codes, widths, intercept)
    beta = rng.normal(size=x.shape[1]) * 0.7
    hits = (rng.random(n) < 1 / (1 + np.exp(-x @ beta))).astype(float)
    return design, x, beta, hits


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.booleans())
def test_coded_design_equals_dense(seed, intercept):
    design, x, beta, hits = random_case(seed, intercept=intercept)
    w = np.random.default_rng(seed + 1).random(len(x))
    np.testing.assert_allclose(design.eta(beta), x @ beta, atol=1e-10)
    np.testing.assert_allclose(design.left(w), x.T @ w, atol=1e-10)
    np.testing.assert_allclose(design.gram(w), x.T @ (w[:, None] * x), atol=1e-10)


def test_fit_solves_score_equations():
    design, x, _, hits = random_case(3)
    beta, hess, loglik, _, good = newton_fit(design, hits, np.ones(len(hits)))
    p = 1 / (1 + np.exp(-x @ beta))
    assert good
    np.testing.assert_allclose(x.T @ (hits - p), 0, atol=1e-8)
    np.testing.assert_allclose(hess, x.T @ ((p * (1 - p))[:, None] * x), atol=1e-8)
    assert loglik == pytest.approx(np.sum(hits * np.log(p) + (1 - hits) * np.log(1 - p)))


def test_large_chunk_start_does_not_change_the_optimum():
    design, x, _, hits = random_case(5, n=120_000)
    beta, *_ , good = newton_fit(design, hits, np.ones(len(hits)))
    assert good
    np.testing.assert_allclose(logistic_sums(design, beta, hits, np.ones(len(hits)))[1], 0, atol=1e-6)


def test_weighted_rows_equal_repeated_rows():
    design, x, _, hits = random_case(7, n=200, widths=(3, 2), q=0)
    patterns = {}
    for i in range(len(hits)):
        key = tuple(int(c[i]) for c in design.codes)
        t, h = patterns.get(key, (0.0, 0.0))
        patterns[key] = (t + 1, h + hits[i])
    codes = [np.array([k[j] for k in patterns]) for j in range(2)]
    small = CodedDesign(np.zeros((len(patterns), 0)), codes, [3, 2], True)
    t, h = np.array(list(patterns.values())).T
    np.testing.assert_allclose(newton_fit(small, h, t)[0], newton_fit(design, hits, np.ones(len(hits)))[0], atol=1e-9)


def test_separated_data_is_not_reported_as_converged():
    numeric = np.linspace(-1, 1, 50)[:, None]
    hits = (numeric[:, 0] > 0).astype(float)
    *_, good = newton_fit(CodedDesign(numeric, [], [], True), hits, np.ones(50), max_iter=25)
    assert not good


@pytest.mark.parametrize("kind", ["level", "baseline", "corner", "none"])
def test_limit_of_separated_rows(kind):
    """The fit in the limit equals that of the rows which are not separated."""
    rng = np.random.default_rng(7)
    n = 600
    x, code, other = rng.normal(size=n), rng.integers(0, 4, n), rng.integers(0, 3, n)
    hits = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(float)
    gone = {"level": code == 1, "baseline": code == 3, "corner": (code == 1) & (other == 0), "none": np.zeros(n, bool)}[kind]
    hits[gone] = 0
    if kind == "corner":  # an interaction is no term, so one cell of one class separates nothing
        gone[:] = False
    ones = np.ones(n)
    design = CodedDesign(x[:, None], [code, other], [3, 2], True)
    beta, h, _, steps, good = newton_fit(design, hits, ones)
    assert good and (steps >= CALM_STEPS) == gone.any()
    beta, h, aside = in_the_limit(beta, h, design.gram(ones))
    rest = ~gone
    part = CodedDesign(x[rest][:, None], [code[rest], other[rest]], [3, 2], True)
    want, want_h, *_ = newton_fit(part, hits[rest], ones[rest])
    np.testing.assert_allclose(h, want_h, atol=1e-6)
    np.testing.assert_allclose(h @ beta, want_h @ want, atol=1e-6)
    assert aside.tolist() == {"level": [0, 0, 0, 1, 0, 0, 0], "baseline": [2, 0, 2, 2, 2, 0, 0]}.get(kind, [0] * 7)


@given(st.integers(1, 12), st.integers(0, 1000))
@settings(max_examples=20, deadline=None)
def test_packing(p, seed):
    a = np.random.default_rng(seed).normal(size=(p, p))
    h = a + a.T
    np.testing.assert_array_equal(unpack(pack(h), p), h)


def random_problem(seed, m=6, rows=40):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(rows, m)) @ (np.eye(m) + 0.6 * rng.normal(size=(m, m)))
    return a.T @ a, rng.normal(size=m) * rng.choice([0.1, 1.0, 2.0], m)


def lasso_by_descent(h, target, level, sweeps=20_000):
    """Coordinate descent on (target-b)'h(target-b)/2 + level * |b|_1."""
    b = np.zeros(len(target))
    corr = h @ target
    for _ in range(sweeps):
        before = b.copy()
        for j in range(len(b)):
            r = corr[j] - h[j] @ b + h[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - level, 0) / h[j, j]
        if np.max(np.abs(b - before)) < 1e-14:
            break
    return b


@pytest.mark.parametrize("seed", range(25))
def test_lasso_vertices_are_lasso_solutions(seed):
    h, target = random_problem(seed)
    if np.linalg.cond(h) > 1e4:
        pytest.skip("badly conditioned")
    for b in solution_path(h, target, "lasso")[1:-1]:
        level = np.max(np.abs(h @ (target - b)))
        np.testing.assert_allclose(b, lasso_by_descent(h, target, level), atol=1e-6)


@pytest.mark.parametrize("kind", ["lar", "lasso"])
@pytest.mark.parametrize("seed", range(12))
def test_path_ends_at_the_estimate(kind, seed):
    h, target = random_problem(seed)
    betas, rss, dof, aic, bic = shrink(h, target, 5000, intercept=False, kind=kind)
    np.testing.assert_allclose(betas[0], 0)
    np.testing.assert_allclose(betas[-1], target, atol=1e-7)
    assert np.all(np.diff(rss) <= 1e-8) and rss[-1] == pytest.approx(0, abs=1e-7)
    np.testing.assert_allclose(aic - rss, 2 * dof)
    np.testing.assert_allclose(bic - rss, np.log(5000) * dof)


@pytest.mark.parametrize("seed", range(20))
def test_lar_equals_lasso_without_sign_changes(seed):
    h, target = random_problem(seed)
    lar, lasso = solution_path(h, target, "lar"), solution_path(h, target, "lasso")
    if len(lar) == len(lasso) == len(target) + 1:
        np.testing.assert_allclose(lar, lasso, atol=1e-9)
    else:
        assert len(lasso) > len(lar)


def test_some_path_drops_a_term():
    lengths = [len(solution_path(*random_problem(s), "lasso")) for s in range(60)]
    assert max(lengths) > 7


@pytest.mark.parametrize("seed", range(8))
def test_intercept_is_the_minimiser_at_every_step(seed):
    h, estimate = random_problem(seed, m=5)
    betas, rss, dof, *_ = shrink(h, estimate, 1000, intercept=True, kind="lasso")
    np.testing.assert_allclose(betas[-1], estimate, atol=1e-7)
    assert dof[0] == 0
    for b, r in zip(betas, rss):
        gap = estimate - b
        assert r == pytest.approx(gap @ h @ gap, abs=1e-7)
        for shift in (-1e-3, 1e-3):
            moved = gap + np.array([shift, 0, 0, 0, 0])
            assert moved @ h @ moved >= r - 1e-9


def test_zero_and_collinear_terms_stay_out():
    h, target = random_problem(1, m=4)
    target[2] = 0.0
    betas, *_ = shrink(h, target, 100, intercept=False)
    assert np.all(betas[:, 2] == 0)
    twin = np.zeros((5, 5))
    twin[:4, :4] = h
    twin[4, :4] = twin[:4, 4] = h[0]
    twin[4, 4] = h[0, 0]
    path = solution_path(twin, np.append(target, 0.5))
    assert np.all((path[:, 0] == 0) | (path[:, 4] == 0))


def test_step_limit():
    h, target = random_problem(2)
    assert len(solution_path(h, target, max_steps=3)) == 4
