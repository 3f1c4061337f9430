"""A small causal self-attention model over token classes, in numpy.

Input: windows of class ids. Each position gets a code and a place code, looks
at itself and the positions before it through one masked attention head, goes
through a two-layer network with residuals, and predicts the next class.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]
HIDDEN = 32
BATCH, LEAST_STEPS = 64, 250  # windows a training step; steps of a training run, if there are so many windows or not
ROWS = 384  # of logits at a time, so that they stay in the CPU's cache
LEAST, MOST = 1e-30, 1e30  # sums of exponents within this are exact enough; others are taken again by their maxima


def start(classes: int, shares: np.ndarray, context: int, width: int, seed: int = 1) -> Weights:
    """``classes`` are the ids that occur as inputs; ``shares`` those of the
    predicted ones, which the output starts from."""
    rng = np.random.default_rng(seed)
    shapes = {"E": (classes, width), "P": (context, width), "Q": (width, width), "K": (width, width),
              "V": (width, width), "A": (width, HIDDEN), "B": (HIDDEN, width), "O": (width, len(shares))}
    m = {k: (rng.standard_normal(s) * (0.3 if k in "EP" else 0.7 / np.sqrt(s[0]))).astype(np.float32) for k, s in shapes.items()}
    return m | {"a": np.zeros(HIDDEN, np.float32), "o": np.log(shares).astype(np.float32)}


def _attend(m: Weights, ids: np.ndarray, first: int) -> tuple:
    """States of the places from ``first`` on, and what else the gradient needs; first
    of that the states as rows with a 1 behind each. Rows of all windows go through
    one product for keys and values; the softmax's sum comes with the values."""
    (n, t), d, kind = ids.shape, m["E"].shape[1], m["E"].dtype
    x = m["E"].take(ids, 0)
    x += m["P"][:t]
    late = np.ascontiguousarray(x[:, first:]).reshape(-1, d)
    x = x.reshape(-1, d)
    q = (late @ (m["Q"] * kind.type(1 / np.sqrt(d)))).reshape(n, -1, d)
    both = (x @ _keys_and_values(m)).reshape(n, t, -1)
    both[:, :, 2 * d] = 1
    k, v = both[:, :, :d], both[:, :, d:]
    seen = np.arange(t) <= np.arange(first, t)[:, None]
    with np.errstate(all="ignore"):
        s = q @ k.transpose(0, 2, 1)
        np.exp(s, out=s)
        s *= seen.astype(kind)
        a = s @ v
    if not (LEAST < a[:, :, d].min(initial=1) and a[:, :, d].max(initial=1) < MOST):  # exponents that the type can't hold
        s = np.where(seen, q @ k.transpose(0, 2, 1), kind.type(-np.inf))
        s = np.exp(s - s.max(2, keepdims=True))
        a = s @ v
    a = a.reshape(-1, d + 1)
    total = a[:, d:]
    mean = a[:, :d] / total
    y = late + mean
    u = y @ m["A"]
    u += m["a"]
    u += np.abs(u)  # twice the positive part, in half the time of a maximum
    z = np.empty((len(y), d + 1), kind)
    z[:, d] = 1
    np.add(y, u @ (m["B"] * kind.type(0.5)), out=z[:, :d])
    return z.reshape(n, -1, d + 1)[:, :, :d], (z, x, late, q, k, v, s, total, mean, y, u)


def _keys_and_values(m: Weights) -> np.ndarray:
    """Both weights side by side, and a column for the softmax's sum."""
    return np.hstack([m["K"], m["V"], np.zeros((len(m["K"]), 1), m["K"].dtype)])


def _careful(m: Weights, ids: np.ndarray, nexts: np.ndarray, first: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by row maxima, for windows with very large or small exponents."""
    z, _ = _attend(m, ids, first)
    p = (z @ m["O"] + m["o"]).reshape(-1, len(m["o"]))
    p -= p.max(1, keepdims=True)
    total = np.log(np.exp(p).sum(1))
    own = p[np.arange(len(p)), nexts.reshape(-1)] - total
    return own.reshape(nexts.shape), (np.log(np.exp(p) @ marked + 1e-30) - total).reshape(nexts.shape)


def log_probs(m: Weights, ids: np.ndarray, nexts: np.ndarray, first: int, marked: np.ndarray,
              at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability, from place ``first`` on, of each next class and
    of the next class being one of the ``marked`` (1 or 0 a class)."""
    both = np.empty((2, *nexts.shape), np.float32)
    out, one = np.vstack([m["O"], m["o"]]), np.ones_like(marked)
    kept = np.empty((ROWS, out.shape[1]), out.dtype)
    begin = np.arange(ROWS) * out.shape[1]
    with np.errstate(all="ignore"):
        for a in range(0, len(ids), at_once):
            part = nexts[a:a + at_once]
            z, flat = _attend(m, ids[a:a + at_once], first)[1][0], part.reshape(-1)
            now = np.empty((2, len(flat)), np.float32)
            for i in range(0, len(flat), ROWS):
                own = flat[i:i + ROWS]
                p = np.matmul(z[i:i + ROWS], out, out=kept[:len(own)])
                now[0, i:i + ROWS] = p.reshape(-1).take(begin[:len(own)] + own)
                np.exp(p, out=p)
                total = np.log(p @ one)
                now[0, i:i + ROWS] -= total
                now[1, i:i + ROWS] = np.log(p @ marked) - total
            now = now.reshape(2, *part.shape)
            if not np.isfinite(now).all():
                now = np.stack(_careful(m, ids[a:a + at_once], part, first, marked))
            both[:, a:a + at_once] = now
    return both[0], both[1]


def _output_gradient(z: np.ndarray, out: np.ndarray, nexts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the loss of rows with these shares: that of the rows and of ``out``."""
    d, n = z.shape[1] - 1, out.shape[1]
    dz, dout = np.empty((len(z), d), z.dtype), np.zeros((n, d + 1), z.dtype)
    back = np.ones((n, d + 1), z.dtype)  # the sums come with the rows' gradient
    back[:, :d] = out[:d].T
    kept = np.empty((ROWS, n), z.dtype)
    place = np.arange(len(z)) % ROWS * n + nexts
    with np.errstate(all="ignore"):
        for i in range(0, len(z), ROWS):
            rows = z[i:i + ROWS]
            p = np.matmul(rows, out, out=kept[:len(rows)])
            np.exp(p, out=p)
            b = p @ back
            if not (LEAST < b[:, d].min() and b[:, d].max() < MOST):  # exponents that the type can't hold
                np.matmul(rows, out, out=p)
                p -= p.max(1, keepdims=True)
                np.exp(p, out=p)
                b = p @ back
            total = b[:, d]
            scale = (share[i:i + ROWS] / total)[:, None]
            p.reshape(-1)[place[i:i + ROWS]] -= total
            np.multiply(b[:, :d], scale, out=dz[i:i + ROWS])
            dout += p.T @ (rows * scale)
    dz -= back[:, :d].take(nexts, 0) * share[:, None]
    return dz, dout.T


def gradient(m: Weights, ids: np.ndarray, nexts: np.ndarray, weight: np.ndarray, first: int) -> Weights:
    """Of the mean loss over places of weight 1 (0: padding)."""
    z, x, late, q, k, v, s, total, mean, y, u = _attend(m, ids, first)[1]
    (n, t), d, kind = ids.shape, x.shape[1], z.dtype
    share = (weight.reshape(-1) / max(1.0, float(weight.sum()))).astype(kind)
    dz, dout = _output_gradient(z, np.vstack([m["O"], m["o"]]), nexts.reshape(-1), share)
    du = dz @ m["B"].T
    du *= u > 0
    dy = dz + du @ m["A"].T
    h = np.empty((len(dy), d + 1), kind)  # of the softmax's mean and, behind it, of its sum
    np.divide(dy, total, out=h[:, :d])
    np.negative((h[:, :d] * mean) @ np.ones(d, kind), out=h[:, d])
    h = h.reshape(n, -1, d + 1)
    ds = h @ v.transpose(0, 2, 1)
    ds *= s
    dq = (ds @ k).reshape(-1, d)
    dq *= kind.type(1 / np.sqrt(d))
    dboth = np.empty((n, t, 2 * d + 1), kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=dboth[:, :, :d])
    np.matmul(s.transpose(0, 2, 1), h, out=dboth[:, :, d:])
    dboth = dboth.reshape(-1, 2 * d + 1)
    dx = (dboth @ _keys_and_values(m).T).reshape(n, t, d)
    dx[:, first:] += (dy + dq @ m["Q"].T).reshape(n, -1, d)
    cells = np.arange(m["E"].size).reshape(m["E"].shape).take(ids, 0).reshape(-1)
    de = np.bincount(cells, weights=dx.reshape(-1), minlength=m["E"].size).astype(kind).reshape(m["E"].shape)
    dp = np.zeros_like(m["P"])
    dx.sum(0, out=dp[:t])
    dkv = x.T @ dboth
    return {"E": de, "P": dp, "Q": late.T @ dq, "K": dkv[:, :d], "V": dkv[:, d:2 * d], "A": y.T @ du, "a": np.ones(len(du), kind) @ du,
            "B": u.T @ dz * kind.type(0.5), "O": dout[:-1], "o": dout[-1]}


def train(m: Weights, ids: np.ndarray, nexts: np.ndarray, weight: np.ndarray, first: int, rate: float,
          epochs: int = 2, batch: int = BATCH, least_steps: int = LEAST_STEPS, seed: int = 1) -> Weights:
    """Adam from the given weights over all windows, again and again for
    ``epochs`` or, if they are few, until ``least_steps``."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([m[k].ravel() for k in m])
    ends = np.cumsum([v.size for v in m.values()]).tolist()
    m = {k: flat[e - v.size:e].reshape(v.shape) for (k, v), e in zip(m.items(), ends, strict=True)}  # views
    one, two = np.zeros_like(flat), np.zeros_like(flat)
    rounds = max(1, -(-len(ids) // batch))
    epochs = max(epochs, -(-least_steps // rounds))
    step, steps = 0, epochs * rounds
    for _ in range(epochs if len(ids) else 0):
        for own in np.array_split(rng.permutation(len(ids)), rounds):
            step += 1
            now = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            new = gradient(m, ids[own], nexts[own], weight[own], first)
            g = np.concatenate([new[k].ravel() for k in m])
            one += np.float32(0.1) * (g - one)
            two += np.float32(0.01) * (g * g - two)
            flat -= np.float32(now / (1 - 0.9**step)) * one / (np.sqrt(two / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return m
