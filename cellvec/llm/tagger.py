"""A bidirectional LSTM over characters with CRF transitions, in numpy: training, decoding and marginals of whole batches.

Sequences are rows of character numbers, 0 beyond their end. Arrays go by (place, row, unit).
"""

from __future__ import annotations

import numpy as np

#: Character numbers: 0 beyond the end, 1 white space, 2 a digit, 3 beyond ASCII, 4 to 29 letters, then other ASCII.
CHARS = np.full(129, 3, dtype=np.int32)
CHARS[:33] = 1
CHARS[48:58] = 2
CHARS[97:123] = CHARS[65:91] = np.arange(4, 30)
_others = [c for c in range(33, 128) if not chr(c).isalnum()]
CHARS[_others] = np.arange(30, 30 + len(_others))
N_CHARS = 30 + len(_others)
NEVER = np.float32(-1e4)


def numbers(texts: list[str]) -> np.ndarray:
    """Character numbers of texts, one row each."""
    out = np.zeros((len(texts), max(map(len, texts), default=0)), dtype=np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = CHARS[np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]
    return out


def allowed(kinds: int) -> np.ndarray:
    """Scores of transitions that tags forbid: 0 is outside, 1 + 2k begins a span of kind k, 2 + 2k goes on with it."""
    n = 1 + 2 * kinds
    out = np.zeros((n + 1, n), dtype=np.float32)  # the last row: the start
    for k in range(kinds):
        out[[i for i in range(n + 1) if i not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = NEVER
    return out


def start_weights(kinds: int, rng: np.random.Generator, embed: int = 16, hidden: int = 24) -> dict[str, np.ndarray]:
    def draw(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    w = {"embed": draw(N_CHARS, embed) * np.float32(3), "out": draw(2 * hidden, 1 + 2 * kinds), "out_b": np.zeros(1 + 2 * kinds, np.float32), "move": np.zeros((2 + 2 * kinds, 1 + 2 * kinds), np.float32)}
    for side in ("f", "b"):
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # remember at first
        w |= {f"{side}_x": draw(embed, 4 * hidden), f"{side}_h": draw(hidden, 4 * hidden), f"{side}_b": bias}
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, mask: np.ndarray, w: dict, side: str) -> tuple[np.ndarray, list]:
    """Hidden states by place, and what the way back needs. Side b runs from the end; beyond a row's end states are 0."""
    n, rows, _ = x.shape
    size = w[f"{side}_h"].shape[0]
    z = x @ w[f"{side}_x"] + w[f"{side}_b"]
    h = c = np.zeros((rows, size), np.float32)
    out = np.zeros((n, rows, size), np.float32)
    kept = [None] * n
    for t in range(n) if side == "f" else range(n - 1, -1, -1):
        g = z[t] + h @ w[f"{side}_h"]
        gates = _sigmoid(g[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        new = np.tanh(g[:, 3 * size :])
        before, c = c, (f * c + i * new) * mask[t]
        shown = np.tanh(c)
        kept[t] = (i, f, o, new, before, shown, h)
        h = o * shown * mask[t]
        out[t] = h
    return out, kept


def _lstm_back(x: np.ndarray, mask: np.ndarray, w: dict, side: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
    n, rows, _ = x.shape
    size = w[f"{side}_h"].shape[0]
    dh, dc = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    dz = np.zeros((n, rows, 4 * size), np.float32)
    states = np.zeros((n, rows, size), np.float32)
    for t in range(n - 1, -1, -1) if side == "f" else range(n):
        i, f, o, new, before, shown, h = kept[t]
        dh = (dh + d_out[t]) * mask[t]
        dc = (dc + dh * o * (1 - shown * shown)) * mask[t]
        dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        states[t] = h
        dc = dc * f
        dh = dz[t] @ w[f"{side}_h"].T
    flat = dz.reshape(-1, 4 * size)
    grads[f"{side}_h"] = states.reshape(-1, size).T @ flat
    grads[f"{side}_x"] = x.reshape(-1, x.shape[2]).T @ flat
    grads[f"{side}_b"] = flat.sum(axis=0)
    return dz @ w[f"{side}_x"].T


def _emit(ids: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray, tuple]:
    mask = (ids.T > 0).astype(np.float32)[:, :, None]
    x = w["embed"][ids.T]
    ahead, a = _lstm(x, mask, w, "f")
    back, b = _lstm(x, mask, w, "b")
    both = np.concatenate([ahead, back], axis=2)
    return both @ w["out"] + w["out_b"], mask, (x, a, b, both)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _chances(e: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of the sum over all tag paths, marginal chances by place and expected transitions (over all rows)."""
    n, rows, tags = e.shape
    step, on = move[:-1], mask[:, :, 0] > 0
    a = np.zeros_like(e)
    b = np.zeros_like(e)
    a[0] = move[-1] + e[0]
    for t in range(1, n):
        a[t] = np.where(on[t][:, None], _log_sum(a[t - 1][:, :, None] + step, 1) + e[t], a[t - 1])
    total = _log_sum(a[-1], 1)
    for t in range(n - 2, -1, -1):
        b[t] = np.where(on[t + 1][:, None], _log_sum(step + (b[t + 1] + e[t + 1])[:, None, :], 2), b[t + 1])
    p = np.exp(a + b - total[None, :, None]) * mask
    moved = np.zeros_like(move)
    moved[-1] = p[0].sum(axis=0)
    for t in range(1, n):
        pair = np.exp(a[t - 1][:, :, None] + step + (b[t] + e[t])[:, None, :] - total[:, None, None])
        moved[:-1] += pair[on[t]].sum(axis=0)
    return total, p, moved


def _gradients(ids: np.ndarray, tags: np.ndarray, w: dict, fixed: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood a row, and its gradients."""
    rows = len(ids)
    e, mask, (x, a, b, both) = _emit(ids, w)
    total, p, moved = _chances(e, mask, w["move"] + fixed)
    gold = np.eye(e.shape[2], dtype=np.float32)[tags.T] * mask
    steps = np.zeros_like(moved)
    np.add.at(steps, (len(steps) - 1, tags[:, 0]), 1)
    inner = ids[:, 1:] > 0
    np.add.at(steps, (tags[:, :-1][inner], tags[:, 1:][inner]), 1)
    loss = float(total.sum() - (gold * e).sum() - (steps * (w["move"] + fixed)).sum()) / rows
    de = (p - gold) / np.float32(rows)
    grads = {"move": (moved - steps) / np.float32(rows), "out": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, de.shape[2]), "out_b": de.sum(axis=(0, 1))}
    d = de @ w["out"].T
    half = d.shape[2] // 2
    dx = _lstm_back(x, mask, w, "f", a, d[:, :, :half], grads) + _lstm_back(x, mask, w, "b", b, d[:, :, half:], grads)
    grads["embed"] = np.zeros_like(w["embed"])
    np.add.at(grads["embed"], ids.T, dx)
    return loss, grads


def train(texts: list[str], spans: list[list[tuple[int, int, int]]], kinds: int, epochs: int = 6, rows: int = 64, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights from texts and their labelled spans (kind, start, end), by Adam; the same for the same input."""
    rng = np.random.default_rng(seed)
    w, fixed = start_weights(kinds, rng), allowed(kinds)
    ids = numbers(texts)
    tags = np.zeros_like(ids)
    for k, own in enumerate(spans):
        for kind, start, stop in own:
            tags[k, start] = 1 + 2 * kind
            tags[k, start + 1 : stop] = 2 + 2 * kind
    mean = {k: np.zeros_like(v) for k, v in w.items()}
    square = {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, max(1, epochs * -(-len(texts) // rows))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), rows):
            some = order[i : i + rows]
            some = some[(ids[some] > 0).any(axis=1)]
            if not len(some):
                continue
            width = int((ids[some] > 0).sum(axis=1).max())
            _, grads = _gradients(ids[some, :width], tags[some, :width], w, fixed)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            now = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * np.float32(min(1.0, 5 / (size + 1e-9)))
                mean[k] = np.float32(0.9) * mean[k] + np.float32(0.1) * g
                square[k] = np.float32(0.99) * square[k] + np.float32(0.01) * g * g
                w[k] = w[k] - np.float32(now / (1 - 0.9**step)) * mean[k] / (np.sqrt(square[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return w


def decode(texts: list[str], w: dict[str, np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """Spans (kind, start, end, confidence) on the best tag path of each text; confidence is the mean chance of the
    span's tags."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not texts or not max(map(len, texts)):
        return out
    kinds = (w["out"].shape[1] - 1) // 2
    move = w["move"] + allowed(kinds)
    ids = numbers(texts)
    e, mask, _ = _emit(ids, w)
    _, p, _ = _chances(e, mask, move)
    n, rows, _ = e.shape
    score = move[-1] + e[0]
    came = np.zeros(e.shape, dtype=np.int8)
    stay = np.arange(e.shape[2])
    for t in range(1, n):
        ways = score[:, :, None] + move[:-1]
        on = mask[t] > 0
        came[t] = np.where(on, ways.argmax(axis=1), stay)
        score = np.where(on, ways.max(axis=1) + e[t], score)
    path = np.zeros((n, rows), dtype=np.int64)
    path[-1] = score.argmax(axis=1)
    every = np.arange(rows)
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t][every, path[t]]
    path[mask[:, :, 0] == 0] = 0
    for k in np.flatnonzero((path > 0).any(axis=0)).tolist():
        line = path[:, k]
        for start in np.flatnonzero(line % 2 == 1).tolist():
            stop = start + 1
            while stop < n and line[stop] == line[start] + 1:
                stop += 1
            places = np.arange(start, stop)
            out[k].append(((int(line[start]) - 1) // 2, start, stop, float(p[places, k, line[start:stop]].mean())))
    return out
