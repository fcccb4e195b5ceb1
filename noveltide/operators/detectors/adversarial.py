"""Detectors that train nets against each other or on a neighbour graph, from the published methods, in NumPy on a bounded sample."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from noveltide.operators.detectors.nets import Net, batches
from noveltide.operators.distance import k_nearest

#: The fewest steps of a discriminator.
LEAST_STEPS = 1200

Scorer = Callable[[np.ndarray], np.ndarray]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _away(p: np.ndarray, target: np.ndarray | float) -> np.ndarray:
    """Gradient of the mean binary cross entropy with respect to the logits."""
    return (p - target) / len(p)


def fit_lunar(x: np.ndarray, k: int = 5, epochs: int = 60, batch: int = 128, rate: float = 1e-3, epsilon: float = 0.1, share: float = 0.3, seed: int = 42) -> Scorer:
    """A net over each row's distances to its k nearest training rows, the messages of a neighbour graph's one layer.

    Training rows have target 0. Negative rows have target 1: as many uniform points of the scaled
    range, and as many rows moved by noise in a `share` of the features. The score is the net's output.
    """
    rng = np.random.default_rng(seed)
    low, span = x.min(0), np.ptp(x, axis=0) + 1e-9
    z = (x - low) / span
    k = max(1, min(k, len(z) - 1))
    ids = np.arange(len(z))
    far = rng.uniform(-epsilon, 1 + epsilon, z.shape)
    near = z + (rng.random(z.shape) < share) * rng.normal(0, epsilon, z.shape)
    dist = lambda v, own: k_nearest(v, own, z, ids, k, True)[0]
    inputs = np.vstack([dist(z, ids), dist(far, ids - len(z) - 1), dist(near, ids - len(z) - 1)])
    inputs[~np.isfinite(inputs)] = 0.0
    target = np.r_[np.zeros(len(z)), np.ones(2 * len(z))]
    scale = inputs[: len(z)].mean() + 1e-9
    net = Net([k, 64, 64, 1], ["tanh", "tanh", "sigmoid"], rng)
    for _ in range(epochs):
        for i in batches(len(inputs), batch, rng):
            out = net.forward(inputs[i] / scale)[:, 0]
            net.backward((2 * (out - target[i]) / len(i))[:, None])
            net.step(rate)

    def score(v: np.ndarray) -> np.ndarray:
        own = np.full(len(v), -1) - np.arange(len(v))
        return net(dist((v - low) / span, own) / scale)[:, 0]

    return score


def _discriminator(d: int, n: int, rng: np.random.Generator) -> Net:
    wide = max(64, int(np.ceil(np.sqrt(n))))
    return Net([d, wide, wide, 1], ["tanh", "tanh", "linear"], rng)


def fit_so_gaal(x: np.ndarray, epochs: int = 60, stop: int = 20, batch: int = 128, rate_d: float = 2e-3, rate_g: float = 1e-4, seed: int = 42) -> Scorer:
    """One generator of potential outliers against a discriminator; the generator rests after `stop` epochs. The score is 1 - D(x)."""
    return fit_mo_gaal(x, 1, epochs, stop, batch, rate_d, rate_g, seed)


def fit_mo_gaal(x: np.ndarray, generators: int = 10, epochs: int = 60, stop: int = 20, batch: int = 128, rate_d: float = 2e-3, rate_g: float = 1e-4, seed: int = 42) -> Scorer:
    """Several generators against one discriminator, each aiming at another quantile of its outputs on real rows; one generator aims at 1.

    Together their rows surround the data, which keeps the discriminator from
    falling for one mode. Generators rest after `stop` epochs. Noise fills a cube of twice
    the training range and, stretched, the ball around it, so there are made rows on all sides; rows outside the ball are scored at its edge.
    """
    rng = np.random.default_rng(seed)
    low, span = x.min(0), np.ptp(x, axis=0) + 1e-9
    reach = 0.5 * np.sqrt(x.shape[1])

    def scale(v: np.ndarray) -> np.ndarray:
        v = 0.5 * ((v - low) / span - 0.5)
        return v * np.minimum(1, reach / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12))

    z = scale(x)
    n, d = z.shape
    judge = _discriminator(d, n, rng)
    makers = [Net([d, d, d], ["leaky_relu", "linear"], rng) for _ in range(generators)]
    for g in makers:
        for w in g.w:
            w[:] = np.eye(d) + rng.normal(0, 0.01, w.shape)
        g.b[0] += 2 * reach
        g.b[1] -= 2 * reach
    # Small samples have more epochs, so that the discriminator has steps enough to tell all sides apart.
    more = -(-LEAST_STEPS // max(1, epochs * -(-n // batch)))
    epochs, stop = epochs * more, stop * more
    m = -(-min(n, batch) // generators)
    for epoch in range(epochs):
        for i in batches(n, batch, rng):
            noise = [(rng.random((m, d)) - 0.5) * rng.uniform(1, max(1.0, 2 * reach), (m, 1)) for _ in makers]
            fake = np.vstack([g(v) for g, v in zip(makers, noise, strict=True)])
            both, target = np.vstack([z[i], fake]), np.r_[np.ones(len(i)), np.zeros(len(fake))]
            judge.backward(_away(_sigmoid(judge.forward(both)[:, 0]), target)[:, None])
            judge.step(rate_d, 1e-6)
            if epoch < stop:
                real = _sigmoid(judge(z)[:, 0])
                for k, (g, v) in enumerate(zip(makers, noise, strict=True)):
                    aim = 1.0 if generators == 1 else float(np.quantile(real, k / generators))
                    p = _sigmoid(judge.forward(g.forward(v))[:, 0])
                    g.backward(judge.backward(_away(p, aim)[:, None]))
                    g.step(rate_g, 1e-6)
    return lambda v: 1 - _sigmoid(judge(scale(v))[:, 0])


def fit_alad(x: np.ndarray, latent: int = 4, epochs: int = 60, batch: int = 128, rate: float = 1e-3, seed: int = 42) -> Scorer:
    """Adversarially learned inference: encoder and generator against three discriminators, of pairs (x, z), (x, x') and (z, z').

    The score is the distance of a row and its reconstruction in the features of the second discriminator's hidden layer.
    """
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    rows = (x - mean) / std
    n, d = rows.shape
    enc, gen = Net([d, 32, latent], ["leaky_relu", "linear"], rng), Net([latent, 32, d], ["leaky_relu", "linear"], rng)
    judges = {"xz": Net([d + latent, 64, 1], ["leaky_relu", "linear"], rng), "xx": Net([2 * d, 64, 1], ["leaky_relu", "linear"], rng), "zz": Net([2 * latent, 32, 1], ["leaky_relu", "linear"], rng)}

    def pairs(v: np.ndarray, z: np.ndarray, code: np.ndarray, made: np.ndarray, again: np.ndarray, back: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Real and fake pairs of each discriminator; `again` is the row's reconstruction and `back` the code's."""
        return {"xz": (np.hstack([v, code]), np.hstack([made, z])), "xx": (np.hstack([v, v]), np.hstack([v, again])), "zz": (np.hstack([z, z]), np.hstack([z, back]))}

    for _ in range(epochs):
        for i in batches(n, batch, rng):
            v, z, m = rows[i], rng.normal(size=(len(i), latent)), len(i)
            code, made = enc(v), gen(z)
            for name, (real, fake) in pairs(v, z, code, made, gen(code), enc(made)).items():
                p = _sigmoid(judges[name].forward(np.vstack([real, fake]))[:, 0])
                judges[name].backward(_away(p, np.r_[np.ones(m), np.zeros(m)])[:, None])
                judges[name].step(rate)
            # Encoder and generator aim at the opposite answers. Each runs once over both of its inputs.
            code, made = enc(v), gen(z)
            again, back = gen(code), enc(made)
            grads = {}
            for name, (real, fake) in pairs(v, z, code, made, again, back).items():
                p = _sigmoid(judges[name].forward(np.vstack([real, fake]))[:, 0])
                g = judges[name].backward(_away(p, np.r_[np.zeros(m), np.ones(m)])[:, None])
                grads[name] = g[:m], g[m:]
            to_code, to_made = grads["xz"][0][:, d:], grads["xz"][1][:, :d]
            to_again, to_back = grads["xx"][1][:, d:], grads["zz"][1][:, latent:]
            gen.forward(code)
            to_code = to_code + gen.backward(to_again)
            kept = [g.copy() for g in gen.gw], [g.copy() for g in gen.gb]
            enc.forward(made)
            to_made = to_made + enc.backward(to_back)
            other = [g.copy() for g in enc.gw], [g.copy() for g in enc.gb]
            gen.forward(z)
            gen.backward(to_made)
            enc.forward(v)
            enc.backward(to_code)
            for net, (gw, gb) in ((gen, kept), (enc, other)):
                net.gw = [a + b for a, b in zip(net.gw, gw, strict=True)]
                net.gb = [a + b for a, b in zip(net.gb, gb, strict=True)]
                net.step(rate)

    def hidden(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.hstack([a, b]) @ judges["xx"].w[0] + judges["xx"].b[0]
        return np.where(z > 0, z, 0.01 * z)

    def score(v: np.ndarray) -> np.ndarray:
        v = (v - mean) / std
        return np.abs(hidden(v, v) - hidden(v, gen(enc(v)))).sum(1)

    return score
