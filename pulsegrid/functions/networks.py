"""Forward passes of small networks in NumPy, for ``models.predictor``: a batch of windows goes in, nothing is trained here.

Weights are a dict of arrays by name; a linear layer ``x`` is ``x.w`` (in, out) and ``x.b`` (out). Masks are arrays of booleans; what they
leave out never reaches a result, whatever number stands there, NaN included.
"""

from __future__ import annotations

import math

import numpy as np

Weights = dict[str, np.ndarray]

_erf = np.vectorize(math.erf, otypes=[float])


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _erf(x / math.sqrt(2)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def linear(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def normed(w: Weights, name: str, x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Layer norm over the last axis."""
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + eps) * w[f"{name}.w"] + w[f"{name}.b"]


def fuse(w: Weights, tokens: np.ndarray, there: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """(..., modality, d) to (..., d): the mean of the tokens that are there, weighted by a gate; ``missing`` where none is."""
    x = np.where(there[..., None], tokens, 0.0)
    gate = np.where(there, sigmoid(linear(w, "gate", x)[..., 0]), 0.0)
    mean = np.einsum("...m,...md->...d", gate, x) / (gate.sum(-1, keepdims=True) + eps)
    return np.where(there.any(-1)[..., None], mean, w["missing"])


def attend(w: Weights, name: str, x: np.ndarray, heads: int, there: np.ndarray | None = None) -> np.ndarray:
    """Attention of all places (..., places, d) to all that are ``there`` (..., places); 0 before the last layer if none is."""
    split = lambda a: np.moveaxis(a.reshape(*a.shape[:-1], heads, -1), -2, -3)
    q, k, v = (split(a) for a in np.split(linear(w, f"{name}.qkv", x), 3, axis=-1))
    near = np.einsum("...qd,...kd->...qk", q, k) / math.sqrt(q.shape[-1])
    if there is not None:
        seen = there[..., None, None, :]
        near, v = np.where(seen, near, -np.inf), np.where(there[..., None, :, None], v, 0.0)
    top = near.max(-1, keepdims=True)
    share = np.exp(near - np.where(np.isfinite(top), top, 0.0))
    share = share / np.maximum(share.sum(-1, keepdims=True), np.finfo(float).tiny)
    mixed = np.moveaxis(np.einsum("...qk,...kd->...qd", share, v), -3, -2)
    return linear(w, f"{name}.out", mixed.reshape(x.shape))


def core(w: Weights, tokens: np.ndarray, there: np.ndarray, kind: np.ndarray, valid: np.ndarray, heads: int, layers: int) -> np.ndarray:
    """Hidden states (batch, time, node, d) of tokens (batch, time, node, modality, d).

    Fusion, then the embeddings of node type and time, then layers of attention over time, over nodes and a feed-forward step, each
    normed before and added after. Nodes that aren't ``valid`` (batch, node) stay 0.
    """
    if kind.min() < 0 or kind.max() >= len(w["type"]):
        raise ValueError("a node type without an embedding")
    if tokens.shape[1] != len(w["time"]):
        raise ValueError("as many minutes as time embeddings")
    alive = valid[:, None, :, None]
    h = fuse(w, tokens, there & alive) + w["type"][kind] + w["time"][:, None, :]
    h = np.where(alive, h, 0.0)
    nodes = np.repeat(valid[:, None, :], tokens.shape[1], axis=1)
    for k in range(layers):
        over_time = normed(w, f"{k}.ln_time", h).swapaxes(1, 2)
        h = h + attend(w, f"{k}.time", over_time, heads).swapaxes(1, 2)
        h = h + attend(w, f"{k}.node", normed(w, f"{k}.ln_node", h), heads, nodes)
        h = h + linear(w, f"{k}.down", gelu(linear(w, f"{k}.up", normed(w, f"{k}.ln_step", h))))
        h = np.where(alive, h, 0.0)
    return np.where(alive, normed(w, "ln", h), 0.0)


def fault_logits(w: Weights, h: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Logits by class from the last minute's hidden states: mean and maximum over valid nodes, both 0 without one, through two layers."""
    last, alive = h[:, -1], valid[..., None]
    mean = np.where(alive, last, 0.0).sum(1) / np.maximum(valid.sum(1, keepdims=True), 1)
    top = np.where(valid.any(1)[:, None], np.where(alive, last, -np.inf).max(1), 0.0)
    return linear(w, "fault.2", gelu(linear(w, "fault.1", np.concatenate([mean, top], axis=-1))))


def next_values(w: Weights, h: np.ndarray, kind: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The next minute's channels of each node, by its type's own linear layer (``next.w`` (type, d, channel)); 0 for nodes that aren't valid."""
    said = np.einsum("bnd,ndc->bnc", h[:, -1], w["next.w"][kind]) + w["next.b"][kind]
    return np.where(valid[..., None], said, 0.0)


def lstm(w: Weights, name: str, x: np.ndarray, layers: int, start: np.ndarray | None = None) -> np.ndarray:
    """Outputs (batch, time, hidden) of stacked LSTM layers over x (batch, time, in); all begin with output ``start`` or 0, and state 0."""
    for k in range(layers):
        into, back, bias = (w[f"{name}.{k}.{part}"] for part in ("in", "back", "b"))
        h = np.zeros((len(x), len(back))) if start is None else start
        state, given, out = np.zeros_like(h), x @ into + bias, []
        for t in range(x.shape[1]):
            enter, forget, value, leave = np.split(given[:, t] + h @ back, 4, axis=-1)
            state = sigmoid(forget) * state + sigmoid(enter) * np.tanh(value)
            h = sigmoid(leave) * np.tanh(state)
            out.append(h)
        x = np.stack(out, axis=1) if out else np.zeros((len(x), 0, len(back)))
    return x


def rebuilt(w: Weights, x: np.ndarray, layers: int) -> np.ndarray:
    """An LSTM autoencoder's reconstruction of x (batch, time, in): the encoder's last output, through ``latent`` and ``context`` if the
    weights have them, is the decoder's input at each step and its first output."""
    code = lstm(w, "encoder", x, layers)[:, -1]
    if "latent.w" in w:
        code = linear(w, "context", linear(w, "latent", code))
    steady = np.repeat(code[:, None, :], x.shape[1], axis=1)
    return linear(w, "output", lstm(w, "decoder", steady, layers, code))


def _linear(rng: np.random.Generator, name: str, into: int, out: int) -> Weights:
    return {f"{name}.w": rng.normal(0, into**-0.5, (into, out)), f"{name}.b": rng.normal(0, 0.1, out)}


def core_weights(seed: int, d: int, steps: int, types: int, classes: int, channels: int, layers: int = 1, wide: int = 8) -> Weights:
    """Random weights for ``core`` and both heads."""
    rng = np.random.default_rng(seed)
    w = _linear(rng, "gate", d, 1) | _linear(rng, "fault.1", 2 * d, d) | _linear(rng, "fault.2", d, classes)
    w |= {"missing": rng.normal(0, 0.02, d), "type": rng.normal(0, 0.02, (types, d)), "time": rng.normal(0, 0.02, (steps, d))}
    w |= {"next.w": rng.normal(0, d**-0.5, (types, d, channels)), "next.b": rng.normal(0, 0.1, (types, channels)), "ln.w": np.ones(d), "ln.b": np.zeros(d)}
    for k in range(layers):
        for part in ("time", "node"):
            w |= _linear(rng, f"{k}.{part}.qkv", d, 3 * d) | _linear(rng, f"{k}.{part}.out", d, d)
        w |= _linear(rng, f"{k}.up", d, wide) | _linear(rng, f"{k}.down", wide, d)
        w |= {f"{k}.{part}.{x}": np.full(d, v) for part in ("ln_time", "ln_node", "ln_step") for x, v in (("w", 1.0), ("b", 0.0))}
    return w


def autoencoder_weights(seed: int, inputs: int, hidden: int, layers: int = 1, latent: int | None = None) -> Weights:
    """Random weights for ``rebuilt``."""
    rng = np.random.default_rng(seed)
    w = _linear(rng, "output", hidden, inputs)
    if latent:
        w |= _linear(rng, "latent", hidden, latent) | _linear(rng, "context", latent, hidden)
    for name, first in (("encoder", inputs), ("decoder", hidden)):
        for k in range(layers):
            size = first if k == 0 else hidden
            w |= {f"{name}.{k}.in": rng.normal(0, size**-0.5, (size, 4 * hidden)), f"{name}.{k}.back": rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), f"{name}.{k}.b": rng.normal(0, 0.1, 4 * hidden)}
    return w
