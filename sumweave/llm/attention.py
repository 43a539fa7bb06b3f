"""A small causal self-attention model in numpy over subword ids.

A subword's embedding is its own row plus its class's (subwords are dealt into classes of about
equal frequency, so rare ones start from their class). Queries, keys, values and a residual are
projections of embeddings; one head with relative position biases. The output is factored exactly:
the attention's softmax over the classes, then the subword within its class by how often it was met
there behind the very subword before (rare ones before it share a row), backed off to its share of
the class. So a text's probability depends on every subword of the context and of the output, and
sums to one over the vocabulary. Windows of 24 inputs overlap by 8: the last 16 positions of a window
are its targets, so each token is predicted once, with the 8 to 23 inputs before its own at hand.
"""

from __future__ import annotations

import numpy as np

CLASSES, STRIDE, BACK = 64, 16, 8
#: Frequent subwords with a row of their own when the one behind them is chosen within its class, and
#: frequent subwords that have a column there; the others go by their share.
ROWS, COLUMNS = 1024, 8192
#: Width of embeddings, of queries and keys, and of the state before the output.
WIDE, KEY, DIM = 12, 4, 12
WINDOW = STRIDE + BACK
BOS, PAD = CLASSES, CLASSES + 1
INPUTS = CLASSES + 2
#: Windows to a step of training and to a chunk of scoring; to a step where training begins.
BATCH, FIRST_BATCH = 512, 32
#: States whose output is worked out at once (results don't depend on it).
BLOCK = 1024
RATE, BETA1, BETA2 = 0.03, 0.9, 0.98
#: Adagrad's rate for the subwords' own vectors.
OWN_RATE = 0.3
#: How many counts a class's shares weigh against those behind one subword.
PRIOR = 2.0

SHAPES = {"e": (INPUTS, WIDE), "q": (WIDE, KEY), "k": (WIDE, KEY), "v": (WIDE, DIM), "r": (WIDE, DIM), "b": (WINDOW,), "o": (DIM + 1, CLASSES)}
_SIZES = [int(np.prod(s)) for s in SHAPES.values()]
SIZE = sum(_SIZES)
_CUTS = [slice(sum(_SIZES[:i]), sum(_SIZES[: i + 1])) for i in range(len(_SIZES))]
_OFFSET = (np.arange(STRIDE)[:, None] + BACK) - np.arange(WINDOW)[None, :]
_CAUSAL = _OFFSET >= 0
_OFFSET = np.maximum(_OFFSET, 0)
_SCALE = np.float32(1 / np.sqrt(KEY))
_ONES, _ROW = np.ones(CLASSES, np.float32), np.ones(WINDOW, np.float32)
#: What a residual's last column holds: with the weights' sum beside it, its tanh is the output bias's 1.
_ONE = 19.0


def initial(class_share: np.ndarray, seed: int = 5) -> np.ndarray:
    """Start values: small at random, the output bias at the classes' log frequencies."""
    rng = np.random.default_rng(seed)
    flat = (rng.standard_normal(SIZE) * 0.3).astype(np.float32)
    p = unpack(flat)
    p["b"][:] = -0.2 * np.arange(WINDOW)
    p["o"][DIM] = np.log(np.maximum(class_share, 1e-9))
    return flat


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters."""
    return {name: flat[cut].reshape(shape) for (name, shape), cut in zip(SHAPES.items(), _CUTS, strict=True)}


def classes_of(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each subword: by falling counts, each class about as frequent as the others."""
    order = np.argsort(-counts, kind="stable")
    mass = counts[order] + 0.5
    middle = np.cumsum(mass) - mass / 2
    cls = np.empty(len(counts), np.int64)
    cls[order] = np.minimum(classes - 1, middle / mass.sum() * classes).astype(np.int64)
    return cls


class Vocabulary:
    """Subwords by their counts: their classes, rows and columns."""

    def __init__(self, counts: np.ndarray):
        self.size, self.bos, self.pad = len(counts), len(counts), len(counts) + 1
        own = classes_of(counts)
        self.cls = np.append(own, [BOS, PAD])
        rank = np.empty(self.size, np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(self.size)
        #: Rows 0 to ROWS - 1 are subwords, then the rest, then the beginning of a text.
        self.row = np.append(np.minimum(rank, ROWS), ROWS + 1)
        #: The last column is the rest.
        self.column = np.minimum(rank, COLUMNS)
        total = np.bincount(own, weights=counts + 0.5, minlength=CLASSES)
        self.class_share, self.share = total / total.sum(), (counts + 0.5) / total[own]
        self._of_column = np.full(COLUMNS + 1, -1)
        self._of_column[self.column] = np.arange(self.size)
        self._of_column[COLUMNS] = -1

    #: Number of pair keys.
    PAIRS = (ROWS + 2) * (COLUMNS + 1)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Keys (row, column) of inputs and the targets behind them, padding left out."""
        real = np.flatnonzero(y.ravel() != self.pad)
        return self.row.take(x[:, BACK:].ravel().take(real)) * (COLUMNS + 1) + self.column.take(y.ravel().take(real))

    def within(self, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From pair keys and their counts: log((n + PRIOR * share) / (N + PRIOR)) by key, where N is what the
        row has of the column's class, and -log(N + PRIOR) by row and class for subwords without a
        column of their own (n is 0 there)."""
        n = np.zeros(self.PAIRS, np.float32)
        n[pairs] = counts
        n = n.reshape(ROWS + 2, COLUMNS + 1)
        n[:, COLUMNS] = 0
        has = np.flatnonzero(self._of_column >= 0)
        sub = self._of_column[has]
        total = np.zeros((ROWS + 2, CLASSES), np.float32)
        for c in np.unique(self.cls[sub]).tolist():
            total[:, c] = n[:, has[self.cls[sub] == c]].sum(1)
        total += PRIOR
        out = np.zeros_like(n)
        out[:, has] = np.log((n[:, has] + PRIOR * self.share[sub].astype(np.float32)) / total[:, self.cls[sub]])
        return out.ravel(), -np.log(total)


def _sums(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row number, given column by column [k, m]."""
    return np.array([np.bincount(rows, c, n) for c in columns], np.float32).T


def _outer(a: np.ndarray, b: np.ndarray, block: int = 512) -> np.ndarray:
    """a.T @ b for many rows, block by block (much faster for so few columns)."""
    n = len(a) // block * block
    out = (a[:n].reshape(-1, block, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, block, b.shape[1])).sum(0)
    return out + a[n:].T @ b[n:] if n < len(a) else out


class Model:
    """The model; ``flat`` is what all subwords share, ``own`` each one's embedding beside its class's
    (small at random at first, to tell the subwords of a class apart), ``within`` the choices in the
    classes (needed for scores alone)."""

    def __init__(self, flat: np.ndarray, vocab: Vocabulary, own: np.ndarray | None = None, within: tuple | None = None):
        self.flat = np.array(flat, np.float32)
        self.p = unpack(self.flat)
        self.vocab, self.bos, self.pad = vocab, vocab.bos, vocab.pad
        own = np.random.default_rng(7).standard_normal((vocab.size + 2, WIDE)) * 0.05 if own is None else own
        self.own = np.array(own, np.float32)
        self.within = within
        self._rank = np.zeros(vocab.size + 2, np.int64)
        self._mark = np.zeros(len(self._rank), bool)

    def windows(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs [n, WINDOW], targets [n, STRIDE], padded behind the end, sequence of each window)."""
        counts = [-(-len(s) // STRIDE) for s in seqs]
        n = sum(counts)
        buf = np.full(n * STRIDE + len(seqs) * BACK, self.pad, np.int32)
        tgt = np.full(n * STRIDE, self.pad, np.int32)
        starts = np.empty(n, np.int64)
        at, w = 0, 0
        for s, c in zip(seqs, counts, strict=True):
            buf[at + BACK] = self.bos
            buf[at + BACK + 1 : at + BACK + len(s)] = s[:-1]
            tgt[w * STRIDE : w * STRIDE + len(s)] = s
            starts[w : w + c] = at + STRIDE * np.arange(c)
            at += BACK + STRIDE * c
            w += c
        return np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[starts], tgt.reshape(n, STRIDE), np.repeat(np.arange(len(seqs)), counts)

    def distinct(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct values, places in them)."""
        self._mark[x] = True
        u = np.flatnonzero(self._mark)
        self._mark[u] = False
        self._rank[u] = np.arange(len(u))
        return u, self._rank.take(x)

    def context(self, x: np.ndarray):
        """The state before the output (and a 1) for each target place, and what the gradient needs of
        the way there. Values have a 1 behind them, so that contexts have the weights' sum, 1."""
        used, at = self.distinct(x)
        e = self.p["e"].take(self.vocab.cls[used], axis=0) + self.own.take(used, axis=0)
        project = np.concatenate([self.p["q"] * _SCALE, self.p["k"], self.p["v"], self.p["r"]], axis=1)
        z = np.ones((len(used), 2 * KEY + DIM + 1), np.float32)
        z[:, :-1] = e @ project[:, : 2 * KEY + DIM]
        r = np.full((len(used), DIM + 1), _ONE, np.float32)
        r[:, :DIM] = e @ self.p["r"]
        z = z.take(at, axis=0)
        q, k, v = z[:, BACK:, :KEY], z[:, :, KEY : 2 * KEY], z[:, :, 2 * KEY :]
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -15, 15, out=a)
        np.exp(a, out=a)
        a *= np.where(_CAUSAL, np.exp(np.clip(self.p["b"], -15, 15))[_OFFSET], 0).astype(np.float32)
        if used[-1] == self.pad:
            a *= (x != self.pad)[:, None, :]
        a *= (1 / np.maximum(a.reshape(-1, WINDOW) @ _ROW, np.float32(1e-20))).reshape(-1, STRIDE, 1)
        ctx = (a @ v).reshape(-1, DIM + 1)
        h = r.take(at[:, BACK:].ravel(), axis=0)
        h += ctx
        np.tanh(h, out=h)
        return used, e, at, project, q, k, v, a, ctx, h

    def output(self, h: np.ndarray, t: np.ndarray):
        """Log probabilities of the classes of subwords t after states h (of padding, anything), and
        what the gradient needs."""
        logits = h @ self.p["o"]
        mine = np.arange(0, logits.size, CLASSES) + np.minimum(self.vocab.cls.take(t), CLASSES - 1)
        chosen = logits.ravel().take(mine)
        e = np.exp(logits, out=logits)
        total = e @ _ONES
        return chosen - np.log(total), e, total, mine

    def chosen(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Log probabilities of the targets at ``real`` within their classes."""
        table, rest = self.within
        key, t = self.vocab.pairs(x, y), y.ravel().take(real)
        out = table.take(key)
        if len(rare := np.flatnonzero(self.vocab.column.take(t) == COLUMNS)):
            row = key[rare] // (COLUMNS + 1)
            out[rare] = rest[row, self.vocab.cls[t[rare]]] + np.log(PRIOR * self.vocab.share[t[rare]])
        return out

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, 0 at padding."""
        out = np.zeros(y.size, np.float64)
        for i in range(0, len(x), BATCH):
            xs, ys = x[i : i + BATCH], y[i : i + BATCH]
            real = np.flatnonzero(ys.ravel() != self.pad)
            h, t = self.context(xs)[-1], ys.ravel()
            classes = np.concatenate([self.output(h[j : j + BLOCK], t[j : j + BLOCK])[0] for j in range(0, len(h), BLOCK)])
            out[i * STRIDE + real] = classes.take(real) + self.chosen(xs, ys, real)
        return out.reshape(y.shape)

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """The gradient of the mean loss over one batch: of the shared part, and (subwords, rows)."""
        used, emb, at, project, q, k, v, a, ctx, h = self.context(x)
        t = y.ravel()
        real = t != self.pad
        share = real.astype(np.float32) / np.float32(max(1, np.count_nonzero(real)))
        back = np.ascontiguousarray(self.p["o"].T)
        grad = np.zeros(SIZE, np.float32)
        g = unpack(grad)
        du = np.empty_like(h)
        for i in range(0, len(h), BLOCK):
            some = slice(i, i + BLOCK)
            _, e, total, mine = self.output(h[some], t[some])
            scale = (share[some] / total)[:, None]
            e.ravel()[mine] -= total
            g["o"] += _outer(h[some] * scale, e)
            np.matmul(e, back, out=du[some])
            du[some] *= scale
        h *= h
        du *= np.subtract(1, h, out=h)  # the last column comes to 0
        du[:, DIM] = -np.einsum("ij,ij->i", du, ctx)  # meets the 1 behind the values
        du = du.reshape(len(x), STRIDE, DIM + 1)
        ds = du @ v.transpose(0, 2, 1)
        ds *= a
        g["b"][:] = np.bincount(_OFFSET.ravel(), np.where(_CAUSAL, ds.sum(0), 0).ravel(), WINDOW)
        d = np.empty((len(x), WINDOW, 2 * KEY + 2 * DIM), np.float32)  # of queries, keys, values and residuals
        dq, dk, dv, dr = (d[:, :, i:j] for i, j in ((0, KEY), (KEY, 2 * KEY), (2 * KEY, 2 * KEY + DIM), (2 * KEY + DIM, None)))
        dq[:, :BACK], dr[:, :BACK], dr[:, BACK:] = 0, 0, du[:, :, :DIM]
        np.matmul(ds, k, out=dq[:, BACK:])
        np.matmul(ds.transpose(0, 2, 1), q, out=dk)
        np.matmul(a.transpose(0, 2, 1), du[:, :, :DIM], out=dv)
        at, d = at.ravel(), d.reshape(-1, d.shape[2])
        dp = _outer(emb.take(at, axis=0), d)
        g["q"][:], g["k"][:], g["v"][:], g["r"][:] = dp[:, :KEY] * _SCALE, dp[:, KEY : 2 * KEY], dp[:, 2 * KEY : 2 * KEY + DIM], dp[:, 2 * KEY + DIM :]
        rows = _sums(at, project @ d.T, len(used))
        g["e"][:] = _sums(self.vocab.cls[used], rows.T, INPUTS)
        return grad, used, rows


class Trainer:
    """Adam for the shared part, Adagrad for the rows of subwords a batch holds; ``seen`` counts how
    many batches held each, the weight of its row in a mean over trainers."""

    def __init__(self, model: Model, batch: int = BATCH):
        self.model, self.batch = model, batch
        self.m, self.v, self.n = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0
        self._squares = np.full_like(model.own, 1e-12)
        self.seen = np.zeros(len(model.own), np.int64)

    def learn(self, x: np.ndarray, y: np.ndarray, passes: int = 1) -> None:
        """Train on windows in an order of their own, so that no long text makes up whole batches."""
        own, order = self.model.own, np.random.default_rng(len(x)).permutation(len(x))
        x, y = x[order], y[order]
        for i in [*range(0, len(x), self.batch)] * passes:
            g, used, d = self.model.gradients(x[i : i + self.batch], y[i : i + self.batch])
            self.step(g)
            q = self._squares.take(used, axis=0) + d * d
            self._squares[used] = q
            own[used] -= OWN_RATE * d / np.sqrt(q)
            self.seen[used] += 1

    def step(self, g: np.ndarray) -> None:
        self.n += 1
        self.m += (1 - BETA1) * (g - self.m)
        self.v += (1 - BETA2) * (g * g - self.v)
        rate = RATE / (1 + self.n / 100) ** 0.5
        self.model.flat -= rate * (self.m / (1 - BETA1**self.n)) / (np.sqrt(self.v / (1 - BETA2**self.n)) + 1e-8)
