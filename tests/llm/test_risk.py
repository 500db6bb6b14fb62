"""The non-negative risk: training steps against steps by finite differences of the risk as it is defined."""

import numpy as np
import pytest

from speechloom.llm import quality

HIDDEN = 3


def logits(theta, x):
    w1, b1, w2, b2 = theta
    return np.maximum(x @ w1 + b1, 0) @ w2 + b2


def softplus(z):
    return np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0)


def negative_part(theta, p, u, prior):
    """Unlabelled texts taken for negative, less what their positives add to that."""
    return softplus(logits(theta, u)).mean() - prior * softplus(logits(theta, p)).mean()


def objective(theta, p, u, prior, below):
    """What a step goes down: the unbiased risk, or, where its negative part is below 0, that part upwards."""
    if prior is None:
        return softplus(-logits(theta, p)).mean() + softplus(logits(theta, u)).mean()
    negative = negative_part(theta, p, u, prior)
    return -negative if below else prior * softplus(-logits(theta, p)).mean() + negative


def plain_steps(positive, unlabelled, prior, steps, seed):
    """The same draws as the library's, with gradients from differences."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = p.shape[1]
    theta = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, signs = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], []
    for step in range(1, steps + 1):
        iu, ip = rng.permutation(len(u)), rng.permutation(len(p))
        xu, xp = u[iu], p[np.take(ip, range(256), mode="wrap")]
        below = prior is not None and negative_part(theta, xp, xu, prior) < 0
        signs.append(below)
        grads = []
        for t in theta:
            g = np.zeros_like(t)
            for at in np.ndindex(t.shape):
                old, ends = t[at], []
                for by in (1e-6, -1e-6):
                    t[at] = old + by
                    ends.append(objective(theta, xp, xu, prior, below))
                t[at] = old
                g[at] = (ends[0] - ends[1]) / 2e-6
            grads.append(g)
        for i, g in enumerate(grads):
            g = g + 1e-4 * theta[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return theta, signs


@pytest.mark.parametrize("prior", [None, 0.3, 0.97])
def test_steps_go_down_the_risk(prior):
    rng = np.random.default_rng(5)
    positive = rng.normal(1.0, 1, (40, 4))
    unlabelled = np.concatenate([rng.normal(1.0, 1, (30, 4)), rng.normal(-1.0, 1, (60, 4))])
    got = quality._train(positive, unlabelled, prior, 12, seed=3, hidden=HIDDEN)
    theta, signs = plain_steps(positive, unlabelled, prior, 12, 3)
    for mine, other in zip((got.w1, got.b1, got.w2, np.array([got.b2])), theta, strict=True):
        np.testing.assert_allclose(mine, other, atol=2e-5)
    # A prior that is too high makes the negative part fall below 0 at times; one that fits doesn't.
    assert any(signs) == (prior == 0.97)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(2, 1, 4000)
        unlabelled = np.concatenate([rng.normal(2, 1, int(8000 * share)), rng.normal(-2, 1, int(8000 * (1 - share)))])
        assert abs(quality.class_prior(positive, unlabelled) - share) < 0.08
