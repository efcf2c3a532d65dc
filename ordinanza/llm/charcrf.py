"""Character-level bidirectional LSTM with CRF transitions, in numpy.

The model tags every character with O, B-kind or I-kind.  Inference folds the
embedding and the input projection into one table per direction, so a step is
a row gather, one small matrix product and the gate arithmetic.
"""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "id", "address", "name")
TAGS = ("O",) + tuple(f"{p}-{k}" for k in KINDS for p in "BI")
CHARS = (
    "\x00\n \t"
    + "abcdefghijklmnopqrstuvwxyz"
    + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    + "0123456789"
    + ".,;:!?'\"()[]<>@+-_/#$%&*=|§–—’“”"
    + "áéíóúñüÁÉÍÓÚÑÜ"
)
UNKNOWN = len(CHARS)
OTHER_LETTER = UNKNOWN + 1
N_IDS = UNKNOWN + 2

_TABLE = np.full(0x3000, UNKNOWN, np.int16)
for _cp in range(0x80, 0x3000):
    if chr(_cp).isalpha():
        _TABLE[_cp] = OTHER_LETTER
for _i, _c in enumerate(CHARS):
    _TABLE[ord(_c)] = _i


def encode(text: str) -> np.ndarray:
    """Character ids of a text; characters outside the alphabet share two ids."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(cps, len(_TABLE) - 1)]


def allowed_transitions() -> np.ndarray:
    """0 where tag j may follow tag i, else a large negative score."""
    k = len(TAGS)
    m = np.zeros((k, k), np.float32)
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                if s[1:] != t[1:]:
                    m[i, j] = -1e4
    return m


def init(hidden: int, dim: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    u = lambda *s: (rng.uniform(-1, 1, s) / np.sqrt(s[0])).astype(np.float32)
    p = {"E": (rng.normal(0, 0.3, (N_IDS, dim))).astype(np.float32)}
    for d in "fb":
        p["Wx" + d], p["Wh" + d] = u(dim, 4 * hidden), u(hidden, 4 * hidden)
        p["b" + d] = np.zeros(4 * hidden, np.float32)
        p["b" + d][hidden : 2 * hidden] = 1  # forget gate
    p["Wo"], p["bo"] = u(2 * hidden, len(TAGS)), np.zeros(len(TAGS), np.float32)
    p["A"] = np.zeros((len(TAGS), len(TAGS)), np.float32)
    return p


def _squash(x: np.ndarray) -> np.ndarray:
    """x (27 + x^2) / (27 + 9 x^2) on [-3, 3], in place: close to tanh, and several times cheaper."""
    np.clip(x, -3, 3, out=x)
    q = x * x
    q += 3
    np.divide(np.float32(24 / 9), q, out=q)
    q += np.float32(1 / 9)
    x *= q
    return x


def _gates(z: np.ndarray, h: int, scaled: bool) -> np.ndarray:
    """Gates i, f, o by the hard sigmoid clip(z / 4 + 1/2), the candidate by _squash.
    ``scaled``: the weights already contain the quarter and the half."""
    x = z[:, 3 * h :].copy()
    if not scaled:
        z *= 0.25
        z += 0.5
    np.clip(z, 0, 1, out=z)  # the whole block, contiguous: faster than its gate columns alone
    z[:, 3 * h :] = _squash(x)
    return z


def _run(table: np.ndarray, wh: np.ndarray, ids: np.ndarray, keep: bool, scaled: bool = False):
    """ids: (T, B). The hidden states (T, B, H) and, if asked for, what the backward pass needs."""
    t_max, b = ids.shape
    h = wh.shape[0]
    hs = np.empty((t_max, b, h), np.float32)
    cs = np.empty((t_max, b, h), np.float32) if keep else None
    gs = np.empty((t_max, b, 4 * h), np.float32) if keep else None
    hp, c = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    x, ids = np.empty((b, 4 * h), np.float32), np.ascontiguousarray(ids, np.intp)
    for t in range(t_max):
        z = hp @ wh
        z += np.take(table, ids[t], axis=0, out=x, mode="clip")
        _gates(z, h, scaled)
        c = z[:, h : 2 * h] * c
        c += z[:, :h] * z[:, 3 * h :]
        hp = _squash(c.copy())
        hp *= z[:, 2 * h : 3 * h]
        hs[t] = hp
        if keep:
            cs[t], gs[t] = c, z
    return hs, cs, gs


def emissions(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Tag scores (T, B, K) of windows given as (T, B) ids."""
    out = None
    h = p["Whf"].shape[0]
    for d, x in (("f", ids), ("b", ids[::-1])):
        table, wh = p["E"] @ p["Wx" + d] + p["b" + d], p["Wh" + d].copy()
        table[:, : 3 * h] = table[:, : 3 * h] * 0.25 + 0.5
        wh[:, : 3 * h] *= 0.25
        hs, _, _ = _run(table, wh, x, False, True)
        w = p["Wo"][:h] if d == "f" else p["Wo"][h:]
        e = (hs.reshape(-1, h) @ w).reshape(*ids.shape, -1)
        out = e + p["bo"] if out is None else out + e[::-1]
    return out


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tag sequence (T, B) of emission scores (T, B, K)."""
    t_max, b, k = scores.shape
    back = np.empty((t_max, b, k), np.int8)
    v = scores[0].copy()
    v[:, 2::2] = -1e4
    cols = [np.ascontiguousarray(trans[:, j]) for j in range(k)]
    nxt, r = np.empty_like(v), np.arange(b)
    for t in range(1, t_max):
        for j in range(k):
            if j and j % 2 == 0:  # I-kind follows only B-kind or I-kind
                x, y = v[:, j - 1] + trans[j - 1, j], v[:, j] + trans[j, j]
                up = x > y
                back[t, :, j] = np.where(up, j - 1, j)
                nxt[:, j] = np.where(up, x, y)
            else:
                m = v + cols[j]
                a = m.argmax(1)
                back[t, :, j] = a
                nxt[:, j] = m[r, a]
        v = nxt + scores[t]
    tags = np.empty((t_max, b), np.int8)
    tags[-1] = v.argmax(1)
    for t in range(t_max - 1, 0, -1):
        tags[t - 1] = back[t, r, tags[t]]
    return tags


def decode(p: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Tags (T, B) of windows. Windows whose emissions favour O everywhere by a
    margin no transition can overcome keep O without a Viterbi pass."""
    e = emissions(p, ids)
    e[ids == 0] = np.where(np.arange(len(TAGS)) == 0, 1e3, 0)  # padding is O
    trans = p["A"] + allowed_transitions()
    gain = max(0.0, float(p["A"].max() - p["A"][0, 0]))
    margin = e[:, :, 0] - e[:, :, 1:].max(2)
    # an entity of n characters changes n + 1 transitions, each by at most `gain`
    busy = np.flatnonzero((margin <= 2 * gain).any(0))
    tags = np.zeros(ids.shape, np.int8)
    if len(busy):
        tags[:, busy] = viterbi(e[:, busy], trans)
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def loss_and_grads(p: dict[str, np.ndarray], ids: np.ndarray, gold: np.ndarray, mask: np.ndarray):
    """Negative log likelihood per character and its gradients. All (T, B);
    mask is 1 on real characters, which form a prefix of each window."""
    t_max, b = ids.shape
    h, k = p["Whf"].shape[0], len(TAGS)
    store, es = {}, None
    for d, x in (("f", ids), ("b", ids[::-1])):
        table = p["E"] @ p["Wx" + d] + p["b" + d]
        store[d] = (x, *_run(table, p["Wh" + d], x, True))
        w = p["Wo"][:h] if d == "f" else p["Wo"][h:]
        e = (store[d][1].reshape(-1, h) @ w).reshape(t_max, b, k)
        es = e + p["bo"] if es is None else es + e[::-1]
    trans = p["A"] + allowed_transitions()
    al = np.empty((t_max, b, k), np.float32)
    al[0] = es[0]
    al[0][:, 2::2] = -1e4
    for t in range(1, t_max):
        nx = _lse(al[t - 1][:, :, None] + trans, 1) + es[t]
        al[t] = np.where(mask[t][:, None] > 0, nx, al[t - 1])
    logz = _lse(al[-1], 1)
    be = np.zeros((t_max, b, k), np.float32)
    d_a = np.zeros((k, k), np.float32)
    d_e = np.empty_like(es)
    cur = np.zeros((b, k), np.float32)
    for t in range(t_max - 1, -1, -1):
        be[t] = cur
        if t:
            pair = trans + (es[t] + cur)[:, None, :]
            post = np.exp(al[t - 1][:, :, None] + pair - logz[:, None, None]) * mask[t][:, None, None]
            d_a += post.sum(0)
            cur = np.where(mask[t][:, None] > 0, _lse(pair, 2), cur)
    d_e = np.exp(al + be - logz[:, None]) * mask[:, :, None]
    n = mask.sum()
    bi = np.arange(b)
    score = np.zeros(b, np.float32)
    for t in range(t_max):
        score += es[t][bi, gold[t]] * mask[t]
        d_e[t][bi, gold[t]] -= mask[t]
        if t:
            score += trans[gold[t - 1], gold[t]] * mask[t]
            np.add.at(d_a, (gold[t - 1], gold[t]), -mask[t])
    d_e /= n
    g = {"A": d_a / n, "bo": d_e.sum((0, 1)), "E": np.zeros_like(p["E"]), "Wo": np.empty_like(p["Wo"])}
    for d in "fb":
        x, hs, cs, gs = store[d]
        de = d_e if d == "f" else d_e[::-1]
        w = p["Wo"][:h] if d == "f" else p["Wo"][h:]
        gw = hs.reshape(-1, h).T @ de.reshape(-1, k)
        g["Wo"][slice(0, h) if d == "f" else slice(h, 2 * h)] = gw
        dh_out = (de.reshape(-1, k) @ w.T).reshape(t_max, b, h)
        dz_all = np.empty((t_max, b, 4 * h), np.float32)
        dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        wh_t = p["Wh" + d].T.copy()
        for t in range(t_max - 1, -1, -1):
            z = gs[t]
            i, f, o, c_in = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            dh = dh + dh_out[t]
            tc = _squash(cs[t].copy())
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, 2 * h : 3 * h] = dh * tc
            dz[:, :h] = dc * c_in
            dz[:, h : 2 * h] = dc * (cs[t - 1] if t else 0)
            g3 = z[:, : 3 * h]
            dz[:, : 3 * h] *= 0.25 * ((g3 > 0) & (g3 < 1))
            dz[:, 3 * h :] = dc * i * (1 - c_in * c_in)
            dc = dc * f
            dh = dz @ wh_t
        flat = dz_all.reshape(-1, 4 * h)
        g["Wh" + d] = hs[:-1].reshape(-1, h).T @ dz_all[1:].reshape(-1, 4 * h)
        per_id = np.zeros((N_IDS, 4 * h), np.float32)
        order = np.argsort(x.reshape(-1), kind="stable")
        xs = x.reshape(-1)[order]
        starts = np.flatnonzero(np.r_[True, xs[1:] != xs[:-1]])
        per_id[xs[starts]] = np.add.reduceat(flat[order], starts, axis=0)
        g["b" + d] = per_id.sum(0)
        g["Wx" + d] = p["E"].T @ per_id
        g["E"] += per_id @ p["Wx" + d].T
    return float((logz - score).sum() / n), g


def _worker(rank, workers, p, shared, grads, losses, barrier, windows, tags, batch, seed, epochs):
    """Gradients of every ``workers``-th row of each batch, step by step with the others."""
    import os

    os.nice(1)
    views, at = {}, 0
    for k in sorted(p):
        views[k] = shared[at : at + p[k].size].reshape(p[k].shape)
        at += p[k].size
    for epoch in range(epochs):
        order = np.random.default_rng(seed + epoch).permutation(len(windows))
        for at in range(0, len(order) - batch + 1, batch):
            barrier.wait()
            if losses[-1]:
                return
            pick = order[at : at + batch][rank::workers]
            ids, gold = windows[pick].T, tags[pick].T
            losses[rank], g = loss_and_grads(views, ids, gold, (ids > 0).astype(np.float32))
            grads[rank] = np.concatenate([g[k].ravel() for k in sorted(p)])
            barrier.wait()


def train(windows, tags, *, hidden=32, dim=16, epochs=12, batch=384, rate=6e-3, seed=7, say=None, seconds=1e9, start=None, workers=8):
    """Fit by Adam on equal-length id windows and tags (N, T); 0 pads the end.

    Every batch is shared out over ``workers`` processes, whose gradients are averaged.
    """
    import multiprocessing as mp
    import time

    ctx = mp.get_context("fork")
    p = start or init(hidden, dim, np.random.default_rng(seed))
    keys, n = sorted(p), sum(v.size for v in p.values())
    batch = min(batch, len(windows)) // workers * workers
    shared = np.frombuffer(ctx.RawArray("f", n), np.float32)
    grads = np.frombuffer(ctx.RawArray("f", n * workers), np.float32).reshape(workers, n)
    losses = np.frombuffer(ctx.RawArray("f", workers + 1), np.float32)
    shared[:] = np.concatenate([p[k].ravel() for k in keys])
    barrier = ctx.Barrier(workers + 1)
    crew = [ctx.Process(target=_worker, args=(r, workers, p, shared, grads, losses, barrier, windows, tags, batch, seed, epochs), daemon=True) for r in range(workers)]
    for c in crew:
        c.start()
    m1, m2 = np.zeros(n, np.float32), np.zeros(n, np.float32)
    steps, began = len(windows) // batch, time.time()
    step, total = 0, epochs * steps
    for epoch in range(epochs):
        run = []
        for _ in range(steps):
            late = (time.time() - began) / seconds
            losses[-1] = late > 1
            barrier.wait()
            if late > 1:
                break
            barrier.wait()
            g = grads.mean(0)
            run.append(losses[:-1].mean())
            g *= min(1.0, 1.0 / (float(np.sqrt((g * g).sum())) + 1e-9))
            step += 1
            lr = rate * min(1, step / 50) * max(0.03, 1 - max(step / total, late))
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            shared -= lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        if losses[-1]:
            break
        if say:
            say(f"epoch {epoch} loss {np.mean(run):.5f} after {time.time() - began:.0f} s")
    for c in crew:
        c.join()
    out, at = {}, 0
    for k in keys:
        out[k] = shared[at : at + p[k].size].reshape(p[k].shape).copy()
        at += p[k].size
    return out
