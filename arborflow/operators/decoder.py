"""A small decoder in numpy with cached keys and values, and the decoding loop over tables of requests.

Weights come from a seed: no trained model belongs to this package.  A subclass of TinyDecoder with other weights, or an
object with its methods, can take its place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rms_norm(x: np.ndarray, weight: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    return weight * x / np.sqrt((x * x).mean(-1, keepdims=True) + eps)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def rope(x: np.ndarray, positions: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """x: (heads, length, size)."""
    half = x.shape[-1] // 2
    angle = positions[:, None] * base ** (-np.arange(half) * 2.0 / x.shape[-1])
    cos, sin = np.tile(np.cos(angle), 2), np.tile(np.sin(angle), 2)
    return x * cos + np.concatenate([-x[..., half:], x[..., :half]], -1) * sin


class Cache:
    """Keys and values of one sequence for each layer: a prefix of ``length`` places is valid.  A shared front, the cache
    of a request's common prefix, is read before the own places and never written."""

    def __init__(self, layers: int, kv_heads: int, size: int, front: Cache | None = None, room: int = 64):
        self.rows = np.zeros((layers, 2, kv_heads, room, size))
        self.length, self.front = 0, front

    @property
    def before(self) -> int:
        return self.front.seen if self.front else 0

    @property
    def seen(self) -> int:
        return self.before + self.length

    def write(self, layer: int, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts rows behind the valid ones, without counting them yet; returns all that is visible."""
        end = self.length + keys.shape[1]
        if end > self.rows.shape[3]:
            grown = np.zeros((*self.rows.shape[:3], 2 * end, self.rows.shape[4]))
            grown[:, :, :, : self.length] = self.rows[:, :, :, : self.length]
            self.rows = grown
        self.rows[layer, 0, :, self.length : end], self.rows[layer, 1, :, self.length : end] = keys, values
        own = self.rows[layer, :, :, :end]
        return tuple(own) if not self.front else tuple(np.concatenate([self.front.valid(layer), own], 2))

    def valid(self, layer: int) -> np.ndarray:
        own = self.rows[layer, :, :, : self.length]
        return own if not self.front else np.concatenate([self.front.valid(layer), own], 2)

    def keep(self, select: np.ndarray) -> None:
        """Of the rows written behind the valid ones, those at ``select`` stay, in that order, and count from now on."""
        end = self.length + len(select)
        self.rows[:, :, :, self.length : end] = self.rows[:, :, :, self.length + np.asarray(select)]
        self.length = end

    def reset(self) -> None:
        self.length = 0


@dataclass
class TinyDecoder:
    """A decoder with grouped heads and extra prediction heads (a residual block and a linear map each).  stages gives
    the number of layers of each stage; only the first stage embeds, only the last one norms and scores."""

    vocab: int = 64
    size: int = 32
    layers: int = 2
    heads: int = 4
    kv_heads: int = 2
    extra: int = 5
    seed: int = 0
    stages: tuple[int, ...] = ()
    w: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        d, kv, mat = self.size, self.size * self.kv_heads // self.heads, lambda *s: rng.normal(0, s[-1] ** -0.5, s)
        self.stages = self.stages or (self.layers,)
        if sum(self.stages) != self.layers:
            raise ValueError(f"the stages have {sum(self.stages)} layers; the model has {self.layers}")
        self.w = {"embed": rng.normal(0, 1, (self.vocab, d)), "norm": np.ones(d), "lm": mat(self.vocab, d)}
        for i in range(self.layers):
            self.w |= {f"{i}.q": mat(d, d), f"{i}.k": mat(kv, d), f"{i}.v": mat(kv, d), f"{i}.o": mat(d, d), f"{i}.gate": mat(2 * d, d), f"{i}.up": mat(2 * d, d), f"{i}.down": mat(d, 2 * d), f"{i}.n1": np.ones(d), f"{i}.n2": np.ones(d)}
        for h in range(self.extra):
            self.w |= {f"h{h}.res": mat(d, d), f"h{h}.b": np.zeros(d), f"h{h}.out": mat(self.vocab, d)}

    def cache(self, front: Cache | None = None, room: int = 64) -> Cache:
        return Cache(self.layers, self.kv_heads, self.size // self.heads, front, room)

    def run_stage(self, rank: int, x: np.ndarray, cache: Cache, positions: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """One stage over token ids (the first) or hidden states; mask (new places, new places)."""
        w, n, hidden = self.w, len(x), np.where(mask, 0.0, -np.inf)
        x = w["embed"][x] if rank == 0 else x
        split = lambda y, h: y.reshape(n, h, -1).transpose(1, 0, 2)
        first = sum(self.stages[:rank])
        for i in range(first, first + self.stages[rank]):
            y = rms_norm(x, w[f"{i}.n1"])
            q, k, v = rope(split(y @ w[f"{i}.q"].T, self.heads), positions), rope(split(y @ w[f"{i}.k"].T, self.kv_heads), positions), split(y @ w[f"{i}.v"].T, self.kv_heads)
            k, v = cache.write(i, k, v)
            s = (q / np.sqrt(q.shape[-1])).reshape(self.kv_heads, -1, q.shape[-1]) @ k.transpose(0, 2, 1)  # a key-value head serves heads / kv_heads query heads
            s = s.reshape(self.heads, n, -1)
            s[:, :, -n:] += hidden  # what came before is seen by all
            s -= s.max(-1, keepdims=True)
            np.exp(s, out=s)
            o = (s.reshape(self.kv_heads, -1, s.shape[-1]) @ v).reshape(self.heads, n, -1) / s.sum(-1, keepdims=True)
            x = x + o.transpose(1, 0, 2).reshape(n, -1) @ w[f"{i}.o"].T
            y = rms_norm(x, w[f"{i}.n2"])
            x = x + (silu(y @ w[f"{i}.gate"].T) * (y @ w[f"{i}.up"].T)) @ w[f"{i}.down"].T
        return rms_norm(x, w["norm"]) if rank == len(self.stages) - 1 else x

    def hidden(self, ids: np.ndarray, positions: np.ndarray | None = None, mask: np.ndarray | None = None, cache: Cache | None = None) -> np.ndarray:
        """Last hidden states of the new places ids; mask (new, new) says which of them see which, causal if None; all of
        them see all that the cache holds.  Their rows are written behind it and count once Cache.keep() names them."""
        n, cache = len(ids), self.cache() if cache is None else cache
        positions = cache.seen + np.arange(n) if positions is None else positions
        mask = np.tril(np.ones((n, n), bool)) if mask is None else mask
        x = np.asarray(ids)
        for rank in range(len(self.stages)):
            x = self.run_stage(rank, x, cache, positions, mask)
        return x

    def scores(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, vocab) and (extra, length, vocab) of hidden states."""
        heads = [(h + silu(h @ self.w[f"h{i}.res"].T + self.w[f"h{i}.b"])) @ self.w[f"h{i}.out"].T for i in range(self.extra)]
        return h @ self.w["lm"].T, np.stack(heads) if heads else np.zeros((0, len(h), self.vocab))

    def logits(self, ids: np.ndarray, positions=None, mask=None, cache: Cache | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.scores(self.hidden(ids, positions, mask, cache))

    def prefill(self, ids, cache: Cache, n_slices: int = 5) -> np.ndarray:
        """Fills the cache from n_slices nearly equal runs of ids, in order, each through all stages; returns the last
        hidden state.  Earlier slices take no heads."""
        last = None
        for part in np.array_split(np.asarray(ids, dtype=np.int64), n_slices):
            if len(part):
                last = self.hidden(part, cache=cache)[-1:]
                cache.keep(np.arange(len(part)))
        return last


@dataclass
class Tree:
    """Arrays of a candidate tree."""

    index: np.ndarray
    depth: np.ndarray
    mask: np.ndarray
    paths: np.ndarray

    @classmethod
    def of(cls, choices: list[list[int]], top_k: int = 10) -> Tree:
        paths = sorted([tuple(p) for p in choices], key=lambda p: (len(p), p))
        number = {(): 0} | {p: i for i, p in enumerate(paths, 1)}
        nodes = list(number)
        mask = np.array([[a == b[: len(a)] for a in nodes] for b in nodes])
        leaves = [p for p in reversed(nodes) if not any(q[:-1] == p for q in nodes if q)]
        width = 1 + max(map(len, nodes))
        rows = [[number[p[:d]] for d in range(len(p) + 1)] + [-1] * (width - len(p) - 1) for p in leaves]
        return cls(np.array([0] + [p[-1] + top_k * (len(p) - 1) + 1 for p in paths]), np.array([len(p) for p in nodes]), mask, np.array(rows))


@dataclass(frozen=True)
class Acceptance:
    """How tokens are taken.  At temperature 0 by argmax; else typical (fast: by the threshold alone, longest path, then
    likelihood; otherwise by draws) or nucleus.  Draws are decided by seed, request, branch and step."""

    temperature: float = 0.0
    sampling: str = "typical"
    fast: bool = True
    top_p: float = 0.8
    threshold: float = 0.09
    alpha: float = 0.3
    seed: int = 0

    def __post_init__(self):
        if self.sampling not in ("typical", "nucleus"):
            raise ValueError(f"sampling must be typical or nucleus, not {self.sampling}")

    @property
    def greedy(self) -> bool:
        return self.temperature == 0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits / self.temperature)

    def limits(self, p: np.ndarray) -> np.ndarray:
        """The typical threshold of each row."""
        return np.minimum(self.threshold, np.exp((p * np.log(p + 1e-5)).sum(-1)) * self.alpha)

    def draw(self, logits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A token for each row of logits, from its nucleus or its typical tokens."""
        p = self.probabilities(logits)
        if self.sampling == "typical":
            p = np.where(p < self.limits(p)[:, None], 0.0, p)
        elif self.top_p < 1:
            order = np.argsort(-p, axis=1, kind="stable")
            ranked = np.take_along_axis(p, order, 1)
            kept = np.where(ranked.cumsum(1) - ranked <= self.top_p, ranked, 0.0)
            np.put_along_axis(p, order, kept, 1)
        run = p.cumsum(1)
        return np.minimum((run <= rng.random((len(p), 1)) * run[:, -1:]).sum(1), p.shape[1] - 1)

    def first(self, logits: np.ndarray, rng: np.random.Generator) -> int:
        return int(logits.argmax()) if self.greedy or self.fast else int(self.draw(logits[None], rng)[0])

    def best(self, base: np.ndarray, tokens: np.ndarray, paths: np.ndarray, rng: np.random.Generator) -> tuple[int, int]:
        """(path, accepted tokens behind its root) for the scores and the tokens of a tree's nodes.  Pads are never taken."""
        at, to = paths[:, :-1], paths[:, 1:]
        want, like = tokens[to], None
        if self.greedy:
            hit = base.argmax(1)[at] == want
        elif self.sampling == "typical" and self.fast:
            p = self.probabilities(base)
            like = np.log(np.maximum(p[at, want], 1e-300))
            hit = p[at, want] > self.limits(p)[at]
        else:
            hit = self.draw(base[at.ravel()], rng).reshape(at.shape) == want
        n = (hit & (to >= 0)).cumprod(1).sum(1)
        top = np.flatnonzero(n == n.max())
        if like is not None and n.max() > 0:
            sums = like[top, : n.max()].sum(1)
            return int(top[sums.argmax()]), int(n.max())
        return int(top[0]) if n.max() else 0, int(n.max())


def decode(model: TinyDecoder, ids, tree: Tree, max_steps: int, eos: int | None = None, top_k: int = 10, how: Acceptance = Acceptance(), cache: Cache | None = None, key: tuple[int, ...] = ()) -> tuple[list[int], int]:
    """Speculative decoding of one sequence: (new ids, steps taken).  Stops at eos if given.  A cache in use holds what
    comes before ids.  Each step scores the tree's nodes alone: rows of accepted ones stay in the cache, others go."""
    cache = model.cache(room=len(ids) + 2 * len(tree.index)) if cache is None else cache
    base, heads = model.scores(model.prefill(ids, cache))
    last, head_last, out, steps = base[-1], heads[:, -1], [], 0
    while steps < max_steps:
        rng = np.random.default_rng([how.seed, *key, steps])
        steps += 1
        flat = np.concatenate([[how.first(last, rng)], *np.argsort(-head_last, axis=1, kind="stable")[:, :top_k]])
        tokens = flat[tree.index]
        h = model.hidden(tokens, cache.seen + tree.depth, tree.mask, cache)
        base = h @ model.w["lm"].T
        best, length = how.best(base, tokens, tree.paths, rng)
        select = tree.paths[best][: length + 1]
        cache.keep(select)
        new = tokens[select].tolist()
        out += new
        last, head_last = base[select[-1]], model.scores(h[select[-1:]])[1][:, 0]
        if eos is not None and eos in new:
            break
    return out, steps


class Batch:
    """Many sequences decoded side by side, by the weights of a TinyDecoder; what is taken is what decode() takes.

    Of a candidate tree only nodes whose parents are accepted can be accepted, so a step scores the roots of all sequences,
    then the accepted ones of their children, and so on: a level of all trees at a time.  Keys and values: (layer, sequence,
    head, place, size); those of a tree's nodes are apart until their path is chosen."""

    #: Numbers in the scores of a slice of a prefill, at most, if a slice has more than one place.
    SCORES = 1 << 21

    def __init__(self, model: TinyDecoder, tree: Tree, ids: list, room: int):
        m, n = model, len(ids)
        self.model, self.tree, self.size = m, tree, m.size // m.heads
        self.keys = np.zeros((m.layers, n, m.kv_heads, room, self.size))
        self.values = np.zeros_like(self.keys)
        self.length = np.array([len(x) for x in ids])
        nodes = len(tree.index)  # one more place takes what fills up rows
        self.node_keys = np.zeros((m.layers, n, m.kv_heads, nodes + 1, self.size))
        self.node_values = np.zeros_like(self.node_keys)
        self.visible = np.zeros((nodes + 1, nodes + 1), bool)
        self.visible[:nodes, :nodes] = tree.mask
        depth = tree.depth
        parent = [next((a for a in np.flatnonzero(tree.mask[b]) if depth[a] == depth[b] - 1), -1) for b in range(nodes)]
        children = [[c for c in range(nodes) if parent[c] == a] for a in range(nodes)]
        self.children = np.full((nodes, max(1, *map(len, children))), -1)
        for a, c in enumerate(children):
            self.children[a, : len(c)] = c
        self.up = np.array([sorted(np.flatnonzero(tree.mask[b]), key=lambda a: depth[a]) + [-1] * (depth.max() - depth[b]) for b in range(nodes)])
        self.first_path = np.array([np.flatnonzero((tree.paths == b).any(1))[0] for b in range(nodes)])

    def keep_rows(self, rows: np.ndarray) -> None:
        for name in ("keys", "values", "node_keys", "node_values"):
            setattr(self, name, getattr(self, name)[:, rows])
        self.length = self.length[rows]

    def _layer(self, i: int, x: np.ndarray, positions: np.ndarray, attend) -> np.ndarray:
        """Layer i over states (sequences, places, size); attend: queries (sequence, key head, group, place, size), keys and
        values (sequence, key head, place, size) to what the places take in, in the queries' form."""
        m, w, (r, n, d) = self.model, self.model.w, x.shape
        split = lambda y, h: y.reshape(r * n, h, -1).transpose(1, 0, 2)
        seated = lambda y: y.reshape(y.shape[0], r, n, -1).transpose(1, 0, 2, 3)
        at = positions.ravel()
        y = rms_norm(x, w[f"{i}.n1"]).reshape(r * n, d)
        q = seated(rope(split(y @ w[f"{i}.q"].T, m.heads), at)) / np.sqrt(self.size)
        k, v = seated(rope(split(y @ w[f"{i}.k"].T, m.kv_heads), at)), seated(split(y @ w[f"{i}.v"].T, m.kv_heads))
        o = attend(q.reshape(r, m.kv_heads, -1, n, self.size), k, v)
        x = x + o.reshape(r, m.heads, n, self.size).transpose(0, 2, 1, 3).reshape(r, n, -1) @ w[f"{i}.o"].T
        y = rms_norm(x, w[f"{i}.n2"])
        return x + (silu(y @ w[f"{i}.gate"].T) * (y @ w[f"{i}.up"].T)) @ w[f"{i}.down"].T

    def prefill(self, ids: list) -> np.ndarray:
        """Fills the caches; the last hidden state of each sequence.  Places behind a sequence's end are seen by none."""
        m, n, longest = self.model, len(ids), int(self.length.max())
        padded = np.zeros((n, longest), np.int64)
        for row, x in zip(padded, ids, strict=True):
            row[: len(x)] = x
        last, step = np.zeros((n, m.size)), max(1, self.SCORES // (n * m.heads * longest))
        for a in range(0, longest, step):
            b = min(longest, a + step)
            hidden = np.where(np.arange(b) <= np.arange(a, b)[:, None], 0.0, -np.inf)
            x = m.w["embed"][padded[:, a:b]]
            for i in range(m.layers):

                def attend(q, k, v, i=i, a=a, b=b, hidden=hidden):
                    self.keys[i, :, :, a:b], self.values[i, :, :, a:b] = k, v
                    s = q.reshape(*q.shape[:2], -1, q.shape[-1]) @ self.keys[i, :, :, :b].transpose(0, 1, 3, 2)
                    p = softmax(s.reshape(*q.shape[:4], b) + hidden)
                    return p.reshape(*s.shape) @ self.values[i, :, :, :b]

                x = self._layer(i, x, np.broadcast_to(np.arange(a, b), (n, b - a)), attend)
            here = np.flatnonzero((self.length > a) & (self.length <= b))
            last[here] = x[here, self.length[here] - 1 - a]
        return rms_norm(last, m.w["norm"])

    def _nodes(self, rows: np.ndarray, nodes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Hidden states of nodes (rows, places) of some sequences' trees; each sees the cache, its ancestors and itself."""
        m, end, every = self.model, int(self.length[rows].max()), len(rows) == len(self.length)
        of = lambda z: z if every else z[rows]
        hidden = np.where(np.arange(end) < self.length[rows][:, None], 0.0, -np.inf)[:, None, None, None]
        trees = np.where(self.visible[nodes], 0.0, -np.inf)[:, None, None]
        depth = np.append(self.tree.depth, 0)[nodes]
        x = m.w["embed"][tokens]
        for i in range(m.layers):

            def attend(q, k, v, i=i):
                self.node_keys[i, rows[:, None], :, nodes], self.node_values[i, rows[:, None], :, nodes] = k.transpose(0, 2, 1, 3), v.transpose(0, 2, 1, 3)
                flat = q.reshape(*q.shape[:2], -1, q.shape[-1])
                s = np.concatenate(
                    [
                        (flat @ of(self.keys[i, :, :, :end]).transpose(0, 1, 3, 2)).reshape(*q.shape[:4], -1) + hidden,
                        (flat @ of(self.node_keys[i]).transpose(0, 1, 3, 2)).reshape(*q.shape[:4], -1) + trees,
                    ],
                    -1,
                )
                p = softmax(s).reshape(*flat.shape[:3], -1)
                return p[..., :end] @ of(self.values[i, :, :, :end]) + p[..., end:] @ of(self.node_values[i])

            x = self._layer(i, x, self.length[rows][:, None] + depth, attend)
        return rms_norm(x, m.w["norm"])

    def _scored(self, rows: np.ndarray, node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden states and scores of a node of each of rows, sorted sequences; those with many nodes apart from others."""
        h, (some, start, count) = np.empty((len(rows), self.model.size)), np.unique(rows, return_index=True, return_counts=True)
        few = count <= np.ceil(count.mean())
        for lot in (few, ~few):
            if lot.any():
                at = np.repeat(np.arange(lot.sum()), count[lot])
                place = np.concatenate([np.arange(c) for c in count[lot]])
                here = np.repeat(start[lot], count[lot]) + place
                grid, words = np.full((lot.sum(), count[lot].max()), len(self.tree.index)), np.zeros((lot.sum(), count[lot].max()), np.int64)
                grid[at, place], words[at, place] = node[here], tokens[rows[here], node[here]]
                h[here] = self._nodes(some[lot], grid, words)[at, place]
        return h, h @ self.model.w["lm"].T

    def step(self, tokens: np.ndarray, how: Acceptance) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the tokens of each sequence's tree: the path taken (sequences, depth; -1 behind its end), and the hidden
        state and scores at its end.  Its rows count from now on."""
        m, n = self.model, len(tokens)
        rows, node, like = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        best, scored, h_end, base_end = np.zeros(n, np.int64), np.full(n, -1), np.zeros((n, m.size)), np.zeros((n, m.vocab))
        while len(rows):
            some, start = np.unique(rows, return_index=True)
            best[some] = node[np.lexsort((self.first_path[node], -like, rows))[start]]  # the likeliest of each sequence's deepest nodes
            open_ = (self.children[node] >= 0).any(1)  # a leaf is scored only if it is a path's end
            rows, node, like = rows[open_], node[open_], like[open_]
            if not len(rows):
                break
            h, base = self._scored(rows, node, tokens)
            end = best[rows] == node
            h_end[rows[end]], base_end[rows[end]], scored[rows[end]] = h[end], base[end], node[end]
            below = self.children[node]
            want = tokens[rows[:, None], below]
            if how.greedy:
                hit, more = base.argmax(1)[:, None] == want, np.zeros(want.shape)
            else:
                p = how.probabilities(base)
                chance = np.take_along_axis(p, want, 1)
                hit, more = chance > how.limits(p)[:, None], np.log(np.maximum(chance, 1e-300))
            k, j = np.nonzero(hit & (below >= 0))
            rows, node, like = rows[k], below[k, j], like[k] + more[k, j]
        rest = np.flatnonzero(scored != best)
        if len(rest):
            h_end[rest], base_end[rest] = self._scored(rest, best[rest], tokens)
        path = self.up[best]
        for d in range(path.shape[1]):
            s = np.flatnonzero(path[:, d] >= 0)
            self.keys[:, s, :, self.length[s]], self.values[:, s, :, self.length[s]] = self.node_keys[:, s, :, path[s, d]], self.node_values[:, s, :, path[s, d]]
            self.length[s] += 1
        return path, h_end, base_end


def alike(model, how: Acceptance) -> bool:
    """Whether decode_many() takes what decode() takes: no method of the model is another's, and nothing is drawn."""
    names = ("cache", "run_stage", "hidden", "scores", "logits", "prefill")
    return isinstance(model, TinyDecoder) and all(getattr(type(model), x) is getattr(TinyDecoder, x) and x not in vars(model) for x in names) and (how.greedy or how.fast and how.sampling == "typical")


def decode_many(model: TinyDecoder, ids: list, tree: Tree, max_steps: list[int], eos: int | None = None, top_k: int = 10, how: Acceptance = Acceptance(), places: int = 1 << 15) -> list[tuple[list[int], int]]:
    """decode() of sequences, none empty, with at most max_steps each, where alike(): those of about the same steps and
    length side by side, as many as have `places` places of cache together."""
    out: list = [([], 0)] * len(ids)
    width = int(tree.depth.max()) + 1
    order = sorted((i for i in range(len(ids)) if max_steps[i] > 0), key=lambda i: (max_steps[i], len(ids[i])))
    while order:
        room, n = 0, 0
        while n < len(order) and (room := max(room, len(ids[order[n]]) + width * max_steps[order[n]])) * (n + 1) <= max(places, room):
            n += 1
        here, order = order[:n], order[n:]
        room = max(len(ids[i]) + width * max_steps[i] for i in here)
        for i, got in zip(here, _side_by_side(model, [ids[i] for i in here], tree, np.array([max_steps[i] for i in here]), eos, top_k, how, room), strict=True):
            out[i] = got
    return out


def _side_by_side(model, ids, tree, most, eos, top_k, how, room) -> list[tuple[list[int], int]]:
    b = Batch(model, tree, ids, room)
    h = b.prefill(ids)
    base, alive, steps = h @ model.w["lm"].T, np.arange(len(ids)), 0
    out: list[tuple[list[int], int]] = [([], 0)] * len(ids)
    taken: list[list[int]] = [[] for _ in ids]
    while len(alive):
        heads = model.scores(h)[1]
        ranked = np.argsort(-heads, axis=2, kind="stable")[:, :, :top_k].transpose(1, 0, 2).reshape(len(alive), -1)
        tokens = np.concatenate([base.argmax(1)[:, None], ranked], 1)[:, tree.index]
        path, h, base = b.step(tokens, how)
        new, n = np.take_along_axis(tokens, path, 1).tolist(), (path >= 0).sum(1)
        steps += 1
        over = most[alive] <= steps
        for s, (i, row, k) in enumerate(zip(alive.tolist(), new, n.tolist(), strict=True)):
            taken[i] += row[:k]
            if eos is not None and eos in row[:k]:
                over[s] = True
        if over.any():
            for i in alive[over].tolist():
                out[i] = taken[i], steps
            rest = np.flatnonzero(~over)
            b.keep_rows(rest)
            alive, h, base = alive[rest], h[rest], base[rest]
    return out


def prefill_requests(requests: DataFrame, n_slices: int = 5, top_k: int = 10, make=TinyDecoder) -> DataFrame:
    """(request_id, branch_id, n, token, heads) for (request_id, branch_id, ids): ids go through the stages in n_slices
    runs; the last place's argmax and each extra head's top_k follow.  No ids: n is 0 and the rest null.  No exchange."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            got = []
            for ids in rows["ids"]:
                h = model.prefill([] if ids is None else ids, model.cache(), n_slices)
                if h is None:
                    got.append((0, None, None))
                else:
                    base, heads = model.scores(h)
                    got.append((len(ids), int(base[0].argmax()), np.argsort(-heads[:, 0], axis=1, kind="stable")[:, :top_k].tolist()))
            n, token, heads = zip(*got, strict=True) if got else ((), (), ())
            yield pd.DataFrame({"request_id": rows["request_id"], "branch_id": rows["branch_id"], "n": n, "token": pd.array(token, "Int64"), "heads": pd.Series(heads, dtype=object, index=rows.index)})

    return requests.select("request_id", "branch_id", "ids").mapInPandas(f, "request_id long, branch_id long, n long, token long, heads array<array<long>>")


def decode_requests(requests: DataFrame, choices: list[list[int]], max_steps: int = 100, eos: int | None = None, make=TinyDecoder, how: Acceptance = Acceptance(), shared: str | None = None) -> DataFrame:
    """requests: (request_id, branch_id, ids array<int>).  Steps go round robin over a request's branches, max_steps in
    all, so each branch gets its share; branches do not see each other, so each share runs at once.
    shared names a column of ids that all branches of a request begin with (equal in its rows); its keys and values are
    computed once for the rows of a request that a batch holds.  An empty sequence counts as the single id 0.  Returns
    (request_id, branch_id, n_steps, ids): the new ids of each branch.  make() builds the model, once a task.  Rows of a
    batch are decoded side by side where that is the same, else one after the other."""
    tree = Tree.of(choices)
    seat = F.row_number().over(Window.partitionBy("request_id").orderBy("branch_id")) - 1
    count = F.count("*").over(Window.partitionBy("request_id"))
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named: rows are small and steps are not, so adaptive merging would leave too few
    rows = requests.repartition(tasks, "request_id").select("request_id", "branch_id", "ids", *([F.col(shared).alias("shared")] if shared else []), seat.alias("seat"), count.alias("n"))
    share = F.floor(F.lit(max_steps) / F.col("n")) + (F.col("seat") < F.lit(max_steps) % F.col("n")).cast("long")
    rows = rows.select(*[c for c in rows.columns if c not in ("seat", "n")], share.alias("share"))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, fronts = make(), {}
        for rows in batches:
            if not shared and alike(model, how):
                ids = [[0] if x is None or not len(x) else x for x in rows["ids"]]
                got = decode_many(model, ids, tree, rows["share"].tolist(), eos, how=how)
                yield pd.DataFrame({"request_id": rows["request_id"], "branch_id": rows["branch_id"], "n_steps": [s for _, s in got], "ids": [i for i, _ in got]})
                continue
            got = []
            for r in rows.itertuples():
                if not r.share:
                    got.append(([], 0))
                    continue
                cache, ids = None, [] if r.ids is None else list(r.ids)
                if shared and r.shared is not None and len(r.shared):
                    if r.request_id not in fronts:
                        fronts = {r.request_id: model.cache(room=len(r.shared))}  # of the last request only
                        model.prefill(r.shared, fronts[r.request_id])
                    cache = model.cache(fronts[r.request_id])
                got.append(decode(model, ids or [0], tree, int(r.share), eos, how=how, cache=cache, key=(r.request_id, r.branch_id)))
            yield pd.DataFrame({"request_id": rows["request_id"], "branch_id": rows["branch_id"], "n_steps": [s for _, s in got], "ids": [i for i, _ in got]})

    return rows.mapInPandas(f, "request_id long, branch_id long, n_steps long, ids array<long>")
