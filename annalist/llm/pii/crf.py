"""Skip-chain conditional random field over token labels.

Potentials: features of a token, keys of its two neighbours on either side, label transitions, and skip edges between
tokens of one text that are equal in their normal form.  Trained by the likelihood of the chains; decoded by loopy message passing between
the chains and the groups of similar tokens, then the best path of each chain.

Nothing is cut by a fixed margin.  Messages are passed over whole texts, and every repeated word is in its group.  Only
what the model itself rules out is left undecoded (``Model.reach``): a text in which no message could make any token an
item, and tokens that cannot be items under the messages they got; these are O on the best path, so they split it.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from annalist.llm.pii.tokens import BA, BP, IA, ID, IP, LABELS, PHONE, TOKEN, O, features, normal_address

K = len(LABELS)
OFFSETS = (-2, -1, 1, 2)
#: Transitions that can never be: a label that goes on without its beginning.
FORBIDDEN = np.zeros((K, K), dtype=bool)
for _to, _from in ((IP, (BP, IP)), (IA, (BA, IA))):
    FORBIDDEN[:, _to] = True
    FORBIDDEN[list(_from), _to] = False
BIG = np.float32(1e4)
#: Most that the weight of a transition or of a skip edge may be.
CLIP = 6.0
ROUNDS = 2
#: Numbers of at least so many digits may be those of a person; shorter ones are in no group.
GROUP_DIGITS = 6
#: Slack of the two proven cuts, for rounding: of tokens on the best path, and of whole texts.
EXTENT = SEED = 1e-6
#: Texts are labelled in blocks of about this many tokens, which bounds the memory of the messages.
BLOCK = 1 << 17
#: The kind of item of each label: a message gives the labels of one kind the same.
KIND = np.array([0, 1, 2, 3, 4, 4, 5, 5])
#: Labels that a token may have whose training label is open.
OPEN = {-1: [O, PHONE], -2: [O, BP, IP], -3: [O, ID]}



def normal(t: str) -> str:
    """What similar tokens share, empty for those that are in no group: addresses as local part and host however they
    are spelt, words without case, accents, possessives and separators, and the digits and letters of long numbers."""
    t = t.strip()
    if address := normal_address(t):
        return address
    low = re.sub(r"['’]s$", "", t.lower())
    low = "".join(c for c in unicodedata.normalize("NFKD", low) if c.isalnum())
    return low if (low[:1].isalpha() and len(low) > 2) or sum(c.isdigit() for c in low) >= GROUP_DIGITS else ""


class Types:
    """Distinct tokens met so far, with their features; a cache that a worker keeps while it runs."""

    def __init__(self, own: dict[str, int], keys: dict[str, int], given: frozenset[str]):
        self.own, self.keys, self.given = own, keys, given
        self.index: dict[str, int] = {}
        self.rows: list[list[int]] = []
        self.key: list[int] = []
        self.low: dict[str, int] = {}
        self.same: list[int] = []

    def of(self, tokens: list[str]) -> np.ndarray:
        index = self.index
        out = np.empty(len(tokens), dtype=np.int64)
        for i, t in enumerate(tokens):
            k = index.get(t)
            if k is None:
                k = index[t] = self._new(t)
            out[i] = k
        return out

    def _new(self, t: str) -> int:
        f, key = features(t, self.given)
        self.rows.append([self.own[x] for x in f if x in self.own])
        self.key.append(self.keys.get(key, 0))
        low = normal(t)
        self.same.append(self.low.setdefault(low, len(self.low)) if low else -1)
        return len(self.rows) - 1


class Model:
    def __init__(self, own: dict[str, int], keys: dict[str, int], given: frozenset[str]):
        self.own, self.keys, self.given = own, keys, given
        self.w_own = np.zeros((len(own), K), dtype=np.float32)
        self.w_key = np.zeros((len(OFFSETS), len(keys), K), dtype=np.float32)
        self.trans = np.zeros((K, K), dtype=np.float32)
        self.skip = np.float32(0.0)

    # -- scoring ------------------------------------------------------------------------------------------------
    def prepare(self) -> "Model":
        self.types = Types(self.own, self.keys, self.given)
        self.table = np.zeros((0, K), dtype=np.float32)
        self.key_of = np.zeros(0, dtype=np.int64)
        self.same_of = np.zeros(0, dtype=np.int64)
        return self

    def _grow(self) -> None:
        n = len(self.table)
        if n == len(self.types.rows):
            return
        new = np.stack([self.w_own[r].sum(axis=0) if r else np.zeros(K, dtype=np.float32) for r in self.types.rows[n:]])
        self.table = np.concatenate([self.table, new])
        self.key_of = np.array(self.types.key, dtype=np.int64)
        self.same_of = np.array(self.types.same, dtype=np.int64)

    def unary(self, types: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of the labels of each token without transitions; neighbours do not reach over texts."""
        self._grow()
        u = self.table[types].copy()
        key = self.key_of[types]
        for o, w in zip(OFFSETS, self.w_key):
            a, b = (slice(-o, None), slice(None, o)) if o < 0 else (slice(None, -o), slice(o, None))
            near = np.where(doc[a] == doc[b], key[b], 1)
            u[a] += w[near]
            edge = slice(None, -o) if o < 0 else slice(-o, None)
            u[edge] += w[1]
        return u

    def reach(self, u: np.ndarray, doc: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The most by which each label of each token can beat O on any path through the token, without messages.

        Replacing a label by O costs its score and changes two transitions.  Before the token every label may be followed
        by O.  After it the next label stays, except that a label that goes on must become its beginning, which gets the
        same messages and may be followed by the same labels.
        """
        free = ~FORBIDDEN
        left = np.where(free, t - t[:, [O]], -np.inf).max(axis=0)
        after = np.where(free & free[O], t - t[O], -np.inf).max(axis=1)
        right = np.broadcast_to(after, u.shape).copy()
        near = doc[:-1] == doc[1:]
        for begin, inner in ((BP, IP), (BA, IA)):
            on = np.where(free[inner] & free[begin], t[inner] - t[begin], -np.inf).max()
            grow = np.where(near, u[1:, inner] - u[1:, begin], -np.inf) + on - t[O, begin]
            for k in (begin, inner):
                right[:-1, k] = np.maximum(right[:-1, k], t[k, inner] + grow)
        return u - u[:, [O]] + left + right

    def label(self, types: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of each token."""
        n = len(types)
        out = np.zeros(n, dtype=np.int8)
        if not n:
            return out
        ends = np.append(np.flatnonzero(np.diff(doc)) + 1, n)
        at = 0
        while at < n:
            # Whole texts, at least one.
            to = int(ends[max(np.searchsorted(ends, at + BLOCK, "right") - 1, np.searchsorted(ends, at, "right"))])
            out[at:to] = self._label(types[at:to], doc[at:to])
            at = to
        return out

    def _label(self, types: np.ndarray, doc: np.ndarray) -> np.ndarray:
        out = np.zeros(len(types), dtype=np.int8)
        t = (self.trans - BIG * FORBIDDEN).astype(np.float64)
        u = self.unary(types, doc).astype(np.float64)
        reach = self.reach(u, doc, t)
        # A message adds at most the skip weight to an item and never takes from it more than it gives O.
        most = reach[:, 1:].max(axis=1) + np.where(self.same_of[types] >= 0, float(self.skip), 0.0)
        live = np.isin(doc, doc[most > -SEED])
        if not live.any():
            return out
        kept = np.flatnonzero(live)
        u, reach, types, doc = u[kept], reach[kept], types[kept], doc[kept]
        message = np.zeros_like(u)
        groups = self._groups(types, doc)
        if groups is not None:
            # Only texts that hold a group send or get messages.
            at = np.flatnonzero(np.isin(doc, doc[groups[0]]))
            base, first, length = self._chains(u, at, doc, t)
            where = np.searchsorted(at, groups[0]), *groups[1:]
            sent = np.zeros_like(base)
            for _ in range(ROUNDS):
                belief = self._marginals(base + sent, first, length, t) - sent
                sent = self._skip(belief, *where)
            message[at] = sent
        at = np.flatnonzero((reach + message - message[:, [O]])[:, 1:].max(axis=1) > -EXTENT)
        if len(at):
            out[kept[at]] = self._best(*self._chains(u + message, at, doc, t), t)
        return out

    @staticmethod
    def _chains(u: np.ndarray, at: np.ndarray, doc: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the tokens ``at`` and first place and length of each run of them within a text; a run lies between
        tokens that are O (or the ends of its text, which count as O)."""
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(doc[at]) != 0)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at)))
        base = u[at]
        base[first] += t[O]
        base[first + length - 1] += t[:, O]
        return base, first, length

    def _groups(self, types: np.ndarray, doc: np.ndarray):
        """Tokens of one normal form within a text, where there are two or more of them."""
        same = self.same_of[types]
        code = np.where(same >= 0, doc * (len(self.types.low) + 1) + same, -1 - np.arange(len(types)))
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        member = np.flatnonzero(count[inverse] > 1)
        if not len(member):
            return None
        _, g = np.unique(inverse[member], return_inverse=True)
        return member, g, np.bincount(g)

    def _skip(self, belief: np.ndarray, member: np.ndarray, g: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Message of a group to each member: the skip weight times the mean belief of the others per kind of item.

        The mean stands for all pairs of the group, so a token repeated n times costs n, not n^2.
        """
        b = belief[member]
        b = np.exp(b - b.max(axis=1, keepdims=True))
        b /= b.sum(axis=1, keepdims=True)
        kind = np.stack([b[:, O], b[:, 1], b[:, 2], b[:, 3], b[:, BP] + b[:, IP], b[:, BA] + b[:, IA]], axis=1)
        total = np.stack([np.bincount(g, weights=kind[:, k]) for k in range(6)], axis=1)
        others = (total[g] - kind) / (size[g] - 1)[:, None]
        out = np.zeros_like(belief)
        out[member] = float(self.skip) * others[:, KIND]
        return out

    @staticmethod
    def _by_step(first: np.ndarray, length: np.ndarray):
        """Order of the tokens by their step in their chain, longer chains first, with the start of each step and the
        number of chains that reach it: the chains of step i + 1 are the first ones of step i."""
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        size = np.searchsorted(-length[order], -np.arange(length.max()), "left")
        start = np.concatenate([[0], np.cumsum(size)])
        step = np.arange(int(length.sum())) - np.repeat(first, length)
        place = np.empty(len(step), dtype=np.int64)
        place[start[step] + np.repeat(rank, length)] = np.arange(len(step))
        return place, start[:-1].tolist(), size.tolist()

    def _marginals(self, s: np.ndarray, first: np.ndarray, length: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Log marginals (up to a constant per token) by normalised forward and backward messages along each chain."""
        e = np.exp(np.maximum(t, -60.0))
        place, start, size = self._by_step(first, length)
        x = s[place]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        fwd, bwd = np.empty_like(x), np.ones_like(x)
        fwd[: size[0]] = x[: size[0]]
        for i in range(1, len(size)):
            k, a, b = size[i], start[i - 1], start[i]
            f = (fwd[a : a + k] @ e) * x[b : b + k]
            fwd[b : b + k] = f / f.sum(axis=1, keepdims=True)
        back = e.T.copy()
        for i in range(len(size) - 1, 0, -1):
            k, a, b = size[i], start[i - 1], start[i]
            g = (bwd[b : b + k] * x[b : b + k]) @ back
            bwd[a : a + k] = g / g.sum(axis=1, keepdims=True)
        out = np.empty_like(s)
        out[place] = np.log(fwd * bwd + 1e-300)
        return out

    def _best(self, s: np.ndarray, first: np.ndarray, length: np.ndarray, t: np.ndarray) -> np.ndarray:
        place, start, size = self._by_step(first, length)
        score, back = s[place], np.empty((len(s), K), dtype=np.int8)
        for i in range(1, len(size)):
            k, a, b = size[i], start[i - 1], start[i]
            both = score[a : a + k, :, None] + t
            back[b : b + k] = both.argmax(axis=1)
            score[b : b + k] += both.max(axis=1)
        y = score.argmax(axis=1).astype(np.int8)
        for i in range(len(size) - 1, 0, -1):
            k, a, b = size[i], start[i - 1], start[i]
            y[a : a + k] = back[np.arange(b, b + k), y[b : b + k]]
        out = np.empty(len(s), dtype=np.int8)
        out[place] = y
        return out


def tokenize(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens of all texts, the text of each, and the position at which each starts in its text."""
    tokens: list[str] = []
    counts = np.empty(len(texts), dtype=np.int64)
    find = TOKEN.findall
    for i, x in enumerate(texts):
        new = find(x)
        counts[i] = len(new)
        tokens += new
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    starts = ends - np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    base = np.zeros(len(texts), dtype=np.int64)
    has = counts > 0
    base[has] = starts[firsts[has]]
    return tokens, doc, starts - base[doc] if len(tokens) else starts


def _expect(x: np.ndarray, size: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and transition expectations of padded chains: (n, L, K) scores, lengths, exponentiated transitions.

    The forward messages are normalised at each step; the O that stands before and after each chain is step 0 and the
    last one.
    """
    n, length, _ = x.shape
    live = np.arange(length)[None, :] < size[:, None]
    x = np.exp(np.where(live[:, :, None], x - x.max(axis=2, keepdims=True), 0.0))
    fwd, bwd = np.empty_like(x), np.ones_like(x)
    f = x[:, 0] * e[O]
    fwd[:, 0] = f / f.sum(axis=1, keepdims=True)
    for i in range(1, length):
        f = (fwd[:, i - 1] @ e) * x[:, i]
        fwd[:, i] = f / f.sum(axis=1, keepdims=True)
    ends = e[:, O]
    bwd[:] = ends
    for i in range(length - 2, -1, -1):
        b = (bwd[:, i + 1] * x[:, i + 1]) @ e.T
        b /= b.sum(axis=1, keepdims=True)
        bwd[:, i] = np.where((i + 1 < size)[:, None], b, ends)
    p = fwd * bwd
    p /= p.sum(axis=2, keepdims=True)
    p *= live[:, :, None]
    right = bwd[:, 1:] * x[:, 1:]
    z = np.einsum("nla,ab,nlb->nl", fwd[:, :-1], e, right, optimize=True)
    w = np.where(live[:, 1:], 1.0 / np.maximum(z, 1e-300), 0.0)
    pairs = np.einsum("nla,nlb->ab", fwd[:, :-1] * w[:, :, None], right, optimize=True) * e
    pairs[O] += p[:, 0].sum(axis=0)
    pairs[:, O] += p[np.arange(n), size - 1].sum(axis=0)
    return p, pairs


#: Share of the words around tokens, and of the words that tokens are, that training leaves out at random in each pass.
BLIND, MUTE = 0.8, 0.1


def train(texts: list[str], labels: list[np.ndarray], given: frozenset[str], epochs: int = 20, rate: float = 0.3, l2: float = 1e-5, batch: int = 128, seed: int = 7) -> Model:
    """Weights by the likelihood of the chains with Adagrad; skip edges are conditioned on the true labels of the equal
    tokens of a text, which keeps training exact along each chain.

    In each pass many words are left out at random, so that what a token looks like and the kinds of its neighbours have to
    carry its label, and not the sentence it stands in.

    Negative labels leave a token open among those of ``OPEN``: the likelihood is then that of all ways to fill them in.
    """
    order = np.argsort([len(y) for y in labels], kind="stable")
    order = [int(i) for i in order if len(labels[i])]
    texts, labels = [texts[i] for i in order], [labels[i] for i in order]
    tokens, doc, _ = tokenize(texts)
    y = np.concatenate(labels).astype(np.int64)
    # Labels that each token may have.
    may = np.zeros((len(y), K), dtype=bool)
    may[np.flatnonzero(y >= 0), y[y >= 0]] = True
    for sign, kinds in OPEN.items():
        may[np.ix_(y == sign, kinds)] = True
    own: dict[str, int] = {}
    keys: dict[str, int] = {"<rare>": 0, "<edge>": 1}
    seen: dict[str, tuple[list[str], str]] = {}
    counts: dict[str, int] = {}
    key_counts: dict[str, int] = {}
    for t in tokens:
        if t not in seen:
            seen[t] = features(t, given)
        for f in seen[t][0]:
            counts[f] = counts.get(f, 0) + 1
        key_counts[seen[t][1]] = key_counts.get(seen[t][1], 0) + 1
    for f, n in counts.items():
        # Words met once or twice say nothing that their endings and shapes do not say.
        if n >= 3 or not f.startswith(("w=", "groups=", "shape=")):
            own[f] = len(own)
    for k, n in key_counts.items():
        if n >= 3:
            keys.setdefault(k, len(keys))
    m = Model(own, keys, given).prepare()
    types = m.types.of(tokens)
    m._grow()
    width, dummy = max(map(len, m.types.rows)), len(own)
    ids = np.full((len(m.types.rows), width), dummy, dtype=np.int64)
    for i, r in enumerate(m.types.rows):
        ids[i, : len(r)] = r
    n, key = len(tokens), m.key_of[types]
    near = np.ones((len(OFFSETS), n), dtype=np.int64)
    for k, o in enumerate(OFFSETS):
        j = np.arange(n) + o
        ok = (j >= 0) & (j < n)
        ok[ok] &= doc[j[ok]] == doc[np.flatnonzero(ok)]
        near[k][ok] = key[j[ok]]
    # The last row of each table of weights stands for what is left out and stays 0.
    word_key = np.array([k[:1].isalpha() for k in keys] + [False])
    word_own = np.array([f.startswith(("w=", "s3=", "s4=", "p3=", "groups=")) for f in own] + [False])
    others = np.zeros((n, 6))
    if (groups := m._groups(types, doc)) is not None:
        member, g, size = groups
        one = np.where(y[member] >= 0, 1.0, 0.0)[:, None] * np.eye(6)[KIND[np.maximum(y[member], 0)]]
        total = np.stack([np.bincount(g, weights=one[:, k]) for k in range(6)], axis=1)
        others[member] = (total[g] - one) / (size[g] - 1)[:, None]
    mates = others[:, KIND]
    lengths = np.array([len(x) for x in labels])
    firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    w_own = np.zeros((len(own) + 1, K))
    w_key, trans, skip = np.zeros((len(OFFSETS), len(keys) + 1, K)), np.zeros((K, K)), 0.5
    h_own, h_key, h_trans, h_skip = (np.full(x.shape, 1e-2) for x in (w_own, w_key, trans, np.zeros(1)))
    rng = np.random.default_rng(seed)
    blocks = [np.arange(i, min(i + batch, len(labels))) for i in range(0, len(labels), batch)]
    for _ in range(epochs):
        for b in rng.permutation(len(blocks)):
            rows = blocks[b]
            size = lengths[rows]
            length = int(size.max())
            live = np.arange(length)[None, :] < size[:, None]
            at = np.where(live, firsts[rows][:, None] + np.arange(length), 0)
            flat = at[live]
            mine = ids[types[flat]]
            mine = np.where(word_own[mine] & (rng.random(len(flat)) < MUTE)[:, None], dummy, mine)
            s = w_own[mine].sum(axis=1)
            around = near[:, flat]
            around = np.where(word_key[around] & (rng.random(around.shape) < BLIND), len(keys), around)
            for k in range(len(OFFSETS)):
                s += w_key[k][around[k]]
            s += skip * mates[flat]
            x = np.zeros((len(rows), length, K))
            x[live] = s
            p, pairs = _expect(x, size, np.exp(np.where(FORBIDDEN, -60.0, trans)))
            # Expectations under the labels that are given: counts where all are, else those of the ways to fill them in.
            want, true = np.eye(K)[np.maximum(y[flat], 0)], np.zeros((K, K))
            yy = np.where(live, y[at], O)
            shut = (yy >= 0).all(axis=1)
            if not shut.all():
                some = np.flatnonzero(~shut)
                z = x[some] - 60.0 * ~may[at[some]]
                q, true = _expect(z, size[some], np.exp(np.where(FORBIDDEN, -60.0, trans)))
                filled = np.zeros_like(p)
                filled[some] = q
                want = np.where((~shut)[np.nonzero(live)[0]][:, None], filled[live], want)
            both = (live[:, 1:] & live[:, :-1])[shut]
            np.add.at(true, (yy[shut, :-1][both], yy[shut, 1:][both]), 1.0)
            true[O] += np.bincount(yy[shut, 0], minlength=K)
            true[:, O] += np.bincount(yy[shut, (size - 1)[shut]], minlength=K)
            g = (want - p[live]) / len(rows)
            feats = mine.ravel()
            grad = np.stack([np.bincount(feats, weights=np.repeat(g[:, c], width), minlength=len(w_own)) for c in range(K)], axis=1) - l2 * w_own
            grad[dummy] = 0
            h_own += grad**2
            w_own += rate * grad / np.sqrt(h_own)
            for k in range(len(OFFSETS)):
                grad = np.stack([np.bincount(around[k], weights=g[:, c], minlength=len(keys) + 1) for c in range(K)], axis=1) - l2 * w_key[k]
                grad[-1] = 0
                h_key[k] += grad**2
                w_key[k] += rate * grad / np.sqrt(h_key[k])
            grad = np.where(FORBIDDEN, 0.0, (true - pairs) / len(rows))
            h_trans += grad**2
            trans = np.clip(trans + rate * grad / np.sqrt(h_trans), -CLIP, CLIP)
            gs = float((g * mates[flat]).sum())
            h_skip += gs * gs
            skip = float(np.clip(skip + rate * gs / np.sqrt(h_skip[0]), 0.0, CLIP))
    m.w_own, m.w_key, m.trans, m.skip = w_own[:-1].astype(np.float32), w_key[:, :-1].astype(np.float32), trans.astype(np.float32), np.float32(skip)
    return m.prepare()
