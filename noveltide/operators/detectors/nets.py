"""A small multilayer perceptron in NumPy, with Adam, and the detectors that train one.

Models are fitted on the driver over a bounded sample of rows (detectors.common.SAMPLE_ROWS) and score
all rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda z: z, lambda z, a: np.ones_like(z)),
    "relu": (lambda z: np.maximum(z, 0), lambda z, a: (z > 0).astype(float)),
    "leaky_relu": (lambda z: np.where(z > 0, z, 0.01 * z), lambda z, a: np.where(z > 0, 1.0, 0.01)),
    "tanh": (np.tanh, lambda z, a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60))), lambda z, a: a * (1 - a)),
}


class Net:
    """Dense layers; `backward` returns the gradient of the input and steps nothing until `step`."""

    def __init__(self, sizes: list[int], acts: list[str], rng: np.random.Generator, bias: bool = True):
        self.w = [rng.normal(0, np.sqrt(2 / (a + b)), (a, b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.acts, self.bias = acts, bias
        self.m = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        self.t = 0

    def forward(self, x: np.ndarray) -> np.ndarray:
        self.x, self.z, self.a = x, [], []
        for w, b, act in zip(self.w, self.b, self.acts, strict=True):
            self.z.append(x @ w + b)
            x = ACTIVATIONS[act][0](self.z[-1])
            self.a.append(x)
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for w, b, act in zip(self.w, self.b, self.acts, strict=True):
            x = ACTIVATIONS[act][0](x @ w + b)
        return x

    def backward(self, grad: np.ndarray) -> np.ndarray:
        self.gw, self.gb = [None] * len(self.w), [None] * len(self.w)
        for i in reversed(range(len(self.w))):
            grad = grad * ACTIVATIONS[self.acts[i]][1](self.z[i], self.a[i])
            self.gw[i] = (self.a[i - 1] if i else self.x).T @ grad
            self.gb[i] = grad.sum(0) if self.bias else np.zeros_like(self.b[i])
            grad = grad @ self.w[i].T
        return grad

    def step(self, rate: float, decay: float = 0.0) -> None:
        self.t += 1
        for p, g, (m, v) in zip((*self.w, *self.b), (*self.gw, *self.gb), self.m, strict=True):
            g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def batches(n: int, size: int, rng: np.random.Generator):
    order = rng.permutation(n)
    for a in range(0, n, size):
        yield order[a : a + size]


def autoencoder_shape(d: int, code: int) -> list[int]:
    return [d, max(64, d // 2), max(32, d // 4), code]


def fit_autoencoder(x: np.ndarray, code: int = 8, epochs: int = 30, batch: int = 128, rate: float = 1e-3, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Reconstruction error of an autoencoder on standardised rows."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    up = autoencoder_shape(x.shape[1], code)
    net = Net([*up, *up[-2::-1]], ["leaky_relu"] * 2 + ["linear"] + ["leaky_relu"] * 2 + ["linear"], rng)
    for _ in range(epochs):
        for i in batches(len(z), batch, rng):
            out = net.forward(z[i])
            net.backward(2 * (out - z[i]) / out.size)
            net.step(rate)
    return lambda v: ((net((v - mean) / std) - (v - mean) / std) ** 2).mean(1)


def fit_vae(x: np.ndarray, code: int = 4, epochs: int = 30, batch: int = 128, rate: float = 1e-3, beta: float = 0.05, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Reconstruction error, at the code's mean, of a variational autoencoder."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    d = x.shape[1]
    enc = Net([d, 64, 2 * code], ["tanh", "linear"], rng)
    dec = Net([code, 64, d], ["tanh", "linear"], rng)
    for _ in range(epochs):
        for i in batches(len(z), batch, rng):
            h = enc.forward(z[i])
            mu, logvar = h[:, :code], np.clip(h[:, code:], -8, 8)
            noise = rng.normal(size=mu.shape)
            out = dec.forward(mu + np.exp(logvar / 2) * noise)
            g = dec.backward(2 * (out - z[i]) / len(i) / d)
            gmu = g + beta * mu / len(i) / d
            glv = g * noise * np.exp(logvar / 2) / 2 + beta * (np.exp(logvar) - 1) / 2 / len(i) / d
            enc.backward(np.hstack([gmu, glv]))
            enc.step(rate)
            dec.step(rate)
    return lambda v: ((dec(enc((v - mean) / std)[:, :code]) - (v - mean) / std) ** 2).mean(1)


def fit_deep_svdd(x: np.ndarray, out: int = 16, epochs: int = 30, batch: int = 128, rate: float = 1e-3, decay: float = 1e-4, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Squared distance to the center of a bias-free net trained to gather all rows there."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    net = Net([x.shape[1], 64, 32, out], ["leaky_relu", "leaky_relu", "linear"], rng, bias=False)
    center = net(z).mean(0)
    center = np.where(np.abs(center) < 0.1, np.where(center < 0, -0.1, 0.1), center)
    for _ in range(epochs):
        for i in batches(len(z), batch, rng):
            h = net.forward(z[i])
            net.backward(2 * (h - center) / len(i))
            net.step(rate, decay)
    return lambda v: ((net((v - mean) / std) - center) ** 2).sum(1)


def fit_dasvdd(x: np.ndarray, code: int = 32, epochs: int = 30, batch: int = 128, rate: float = 1e-3, share: float = 0.9, trials: int = 10, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Reconstruction error plus gamma times the code's squared distance to a learned center.

    Gamma is the mean over `trials` random nets of the reconstruction error over
    the code's squared length. In each batch the first `share` of the rows train the net
    and the others move the center; a batch with none left for the center leaves it as it is.
    """
    rng = np.random.default_rng(seed)
    lo, span = x.min(0), np.ptp(x, axis=0) + 1e-9
    scale = lambda v: (v - lo) / span
    z = scale(x)
    up = autoencoder_shape(x.shape[1], code)

    def nets() -> tuple[Net, Net]:
        return Net(up, ["leaky_relu", "leaky_relu", "linear"], rng), Net(up[::-1], ["leaky_relu", "leaky_relu", "sigmoid"], rng)

    ratios = []
    for _ in range(trials):
        enc, dec = nets()
        h = enc(z)
        ratios.append((((dec(h) - z) ** 2).sum(1) / ((h * h).sum(1) + 1e-9)).mean())
    gamma = float(np.mean(ratios))
    enc, dec = nets()
    center, squares, steps = np.zeros(code), np.zeros(code), 0
    for _ in range(epochs):
        for i in batches(len(z), batch, rng):
            cut = -(-int(share * 100) * len(i) // 100)
            a, b = z[i[:cut]], z[i[cut:]]
            h = enc.forward(a)
            out = dec.forward(h)
            g = dec.backward(2 * (out - a) / len(a))
            enc.backward(g + gamma * 2 * (h - center) / len(a))
            enc.step(rate)
            dec.step(rate)
            if len(b):
                g = -2 * gamma * (enc(b) - center).mean(0)
                squares += g * g
                center -= 1.0 / (1 + 0.01 * steps) * g / (np.sqrt(squares) + 1e-10)
                steps += 1

    def score(v: np.ndarray) -> np.ndarray:
        s = scale(v)
        h = enc(s)
        return ((dec(h) - s) ** 2).mean(1) + gamma * ((h - center) ** 2).sum(1)

    return score


def contrastive_terms(zs: np.ndarray, z0: np.ndarray, temperature: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Losses per row of K views zs (n, K, e) against the original z0 (n, e), and what their gradient needs."""
    n0 = z0 / (np.linalg.norm(z0, axis=-1, keepdims=True) + 1e-9)
    nk = zs / (np.linalg.norm(zs, axis=-1, keepdims=True) + 1e-9)
    k = zs.shape[1]
    own = np.einsum("nke,ne->nk", nk, n0) / temperature
    cross = np.einsum("nke,nle->nkl", nk, nk) / temperature
    cross[:, np.arange(k), np.arange(k)] = -np.inf
    top = np.maximum(own, cross.max(2))
    total = np.exp(own - top) + np.exp(cross - top[..., None]).sum(2)
    return (np.log(total) + top - own), nk, n0, np.concatenate([np.exp(own - top)[..., None], np.exp(cross - top[..., None])], 2) / total[..., None]


def fit_neutralad(x: np.ndarray, views: int = 11, latent: int = 32, epochs: int = 20, batch: int = 128, rate: float = 1e-3, temperature: float = 0.1, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Learned residual transformations that stay like the row yet unlike each other; the score is the contrastive loss.

    The loss is scaled by 1 / |K log(1 / K)|.
    """
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    d = x.shape[1]
    maps = [Net([d, 32, d], ["relu", "tanh"], rng) for _ in range(views)]
    enc = Net([d, 64, latent], ["relu", "linear"], rng)
    factor = 1 / abs(views * np.log(1 / views))

    def normal_grad(g: np.ndarray, raw: np.ndarray, unit: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(raw, axis=-1, keepdims=True) + 1e-9
        return (g - (g * unit).sum(-1, keepdims=True) * unit) / size

    for _ in range(epochs):
        for i in batches(len(z), batch, rng):
            v, n = z[i], len(i)
            moved = [m.forward(v) for m in maps]
            stack = np.concatenate([v, *(v + t for t in moved)])
            h = enc.forward(stack)
            z0, zs = h[:n], h[n:].reshape(views, n, latent).transpose(1, 0, 2)
            _, nk, n0, p = contrastive_terms(zs, z0, temperature)
            scale = factor / n / temperature
            p0, pc = p[..., 0], p[..., 1:]
            gk = ((p0 - 1)[..., None] * n0[:, None, :] + np.einsum("nkl,nle->nke", pc + pc.transpose(0, 2, 1), nk)) * scale
            g0 = np.einsum("nk,nke->ne", p0 - 1, nk) * scale
            gh = np.concatenate([normal_grad(g0, z0, n0), normal_grad(gk, zs, nk).transpose(1, 0, 2).reshape(views * n, latent)])
            gx = enc.backward(gh)
            for k, m in enumerate(maps):
                m.backward(gx[n * (k + 1) : n * (k + 2)])
                m.step(rate)
            enc.step(rate)

    def score(v: np.ndarray) -> np.ndarray:
        s = (v - mean) / std
        zs = np.stack([enc(s + m(s)) for m in maps], 1)
        return contrastive_terms(zs, enc(s), temperature)[0].sum(1) * factor

    return score


def fit_devnet(x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 1e-3, margin: float = 5.0, reference: int = 5000, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """Deviation network, the supervised one: scores of label 0 near a normal prior's mean, of label 1 `margin` deviations above it."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    prior = rng.normal(size=reference)
    net = Net([x.shape[1], 20, 1], ["relu", "linear"], rng)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(epochs):
        for i in batches(len(z), batch, rng):
            if len(pos) and len(neg):
                i = np.r_[rng.choice(neg, len(i) // 2 + 1), rng.choice(pos, len(i) // 2 + 1)]
            s = net.forward(z[i])[:, 0]
            dev = (s - prior.mean()) / prior.std()
            grad = np.where(y[i] == 1, np.where(dev < margin, -1.0, 0.0), np.sign(dev)) / prior.std() / len(i)
            net.backward(grad[:, None])
            net.step(rate, 1e-2)
    return lambda v: net((v - mean) / std)[:, 0]


def fit_ae1svm(x: np.ndarray, code: int = 8, features: int = 256, nu: float = 0.1, seed: int = 42) -> Callable[[np.ndarray], np.ndarray]:
    """A one-class machine on random Fourier features of an autoencoder's code."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    up = autoencoder_shape(x.shape[1], code)
    net = Net([*up, *up[-2::-1]], ["leaky_relu"] * 2 + ["linear"] + ["leaky_relu"] * 2 + ["linear"], rng)
    for _ in range(20):
        for i in batches(len(z), 128, rng):
            out = net.forward(z[i])
            net.backward(2 * (out - z[i]) / out.size)
            net.step(1e-3)

    def encode(v: np.ndarray) -> np.ndarray:
        for w, b, act in zip(net.w[:3], net.b[:3], net.acts[:3], strict=True):
            v = ACTIVATIONS[act][0](v @ w + b)
        return v

    inner = fit_ocsvm(encode(z), features, nu, seed)
    return lambda v: inner(encode((v - mean) / std))


def fit_ocsvm(x: np.ndarray, features: int = 256, nu: float = 0.5, seed: int = 42, epochs: int = 50) -> Callable[[np.ndarray], np.ndarray]:
    """One-class support vector machine with a Gaussian kernel, by random Fourier features and subgradient steps on its primal."""
    rng = np.random.default_rng(seed)
    gamma = 1 / (x.shape[1] * (x.var() + 1e-12))
    w0, b0 = rng.normal(0, np.sqrt(2 * gamma), (x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    lift = lambda v: np.sqrt(2 / features) * np.cos(v @ w0 + b0)
    phi = lift(x)
    w, rho, t = phi.mean(0), 0.0, 0
    for _ in range(epochs):
        for i in batches(len(phi), 256, rng):
            t += 1
            inside = phi[i] @ w < rho
            rate = 1 / (1 + 0.1 * t)
            w = w - rate * (w - phi[i].T @ inside / (nu * len(i)))
            rho -= rate * (inside.mean() / nu - 1)
    return lambda v: rho - lift(v) @ w
