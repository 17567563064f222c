"""Language-model scores: a small causal self-attention model over subword ids, trained in numpy."""

from __future__ import annotations

import math
import pickle
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telesift.llm.common import bounded_batches, discard, pick, written
from telesift.llm.packing import encoder
from telesift.llm.words import LOWER, Words, words_of

SINGLE, SHARED = 95, 31  # classes of one token each; classes that tokens share
START, END = 126, 127  # classes of their own
CLASSES = 128
WIDTH = 16  # of the model
PAIRS = 1 << 15  # rows of the table that two consecutive inputs share by hash
CONTEXT, STRIDE = 32, 16  # a window's positions; those of them that it scores
SHARD_TOKENS = 6 << 20  # that a task learns from in one go
ROUNDS = 3  # the training documents are dealt to them: each is learned from once
RATE, TABLE_RATE = 0.03, 0.15  # of Adam for the small weights, of Adagrad for the tables by id and pair
PARTIAL_SUMS = 32  # of weights that the driver adds up
CHUNK_BYTES = 8 << 20
BLOCKS_AT_ONCE = 128  # their arrays stay in the cache
BATCHES_TOLD = 8  # of so many blocks ids are told apart at once


class Vocabulary(NamedTuple):
    """The class of every subword id, the log10 share of an id in its class, and its row in the tables by id.

    Rows are ordered by class; members[c]:members[c + 1] are those of class c. Ids that the training documents do not
    have share the last row, at the end of the last class, and their probability by `share`.
    """

    kind: np.ndarray
    share: np.ndarray
    row: np.ndarray
    members: np.ndarray


@cache
def id_bytes() -> np.ndarray:
    """Number of bytes that each subword id stands for."""
    return np.array([len(encoder().decode_single_token_bytes(i)) if i < encoder().n_vocab else 0 for i in range(encoder().n_vocab)], dtype=np.int64)


def spelled(words: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) for the words at these places, folded to lower case, each with a space before it.

    Many words are cut in one call: no subword reaches over the space between two words.
    """
    low = LOWER[words.data].tobytes()
    starts, ends = words.starts[first].tolist(), words.ends[first].tolist()
    size = words.ends[first] - words.starts[first] + 1
    encode, length = encoder().encode_ordinary, id_bytes()
    ids, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(starts), 4096):
        text = b" " + b" ".join(low[a:b] for a, b in zip(starts[lo : lo + 4096], ends[lo : lo + 4096], strict=True))
        part = np.array(encode(text.decode()), dtype=np.int64)
        at = np.searchsorted(np.cumsum(length[part]), np.cumsum(size[lo : lo + 4096]), side="left") + 1
        ids.append(part)
        count.append(np.diff(at, prepend=0))
    return np.concatenate(ids), np.concatenate(count)


class Spelling:
    """The subwords of the words of many texts; every different word is cut once."""

    def __init__(self, words: Words):
        self.hashes, at, self.word = np.unique(words.hashes, return_index=True, return_inverse=True)
        self.ids, self.count = spelled(words, at)
        self.begin = np.cumsum(self.count) - self.count

    def tokens(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of words lo to hi, number of ids of each)."""
        word = self.word[lo:hi]
        count = self.count[word]
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return self.ids[np.repeat(self.begin[word], count) + place], count


def first_weights(counts: np.ndarray, vocabulary: Vocabulary | None = None) -> dict[str, np.ndarray]:
    """Weights before training. With a vocabulary, inputs are its rows (not classes), pairs of inputs have a table, and ids
    of a class are told apart by `tell`; without, this is a model of classes alone."""
    rng = np.random.default_rng(20)
    n_input = CLASSES if vocabulary is None else int(vocabulary.members[-1]) + 1
    shapes = {"embed": (n_input, WIDTH), "place": (CONTEXT, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "mix": (WIDTH, WIDTH), "last": (WIDTH, WIDTH), "inner": (WIDTH, 2 * WIDTH), "outer": (2 * WIDTH, WIDTH), "read": (WIDTH, CLASSES)}
    weights = {k: (rng.normal(size=s) / np.sqrt(WIDTH)).astype(np.float32) for k, s in shapes.items()}
    if vocabulary is not None:
        # small at first: a rare id begins as its class
        weights["embed"] *= np.float32(0.5)
        weights["pair"] = np.zeros((PAIRS, WIDTH), np.float32)
        weights["tell"] = np.zeros((n_input - 1, WIDTH), np.float32)
        first = np.full(n_input - 1, -3.0, np.float32)
        first[vocabulary.row] = vocabulary.share * np.log(10)
        unseen = np.bincount(vocabulary.row, minlength=n_input - 1) > 1
        first[unseen] += np.log(np.bincount(vocabulary.row, minlength=n_input - 1)[unseen])
        weights["tell_bias"] = first
    weights["inner_bias"] = np.zeros(2 * WIDTH, np.float32)
    weights["bias"] = np.log((counts + 1) / (counts + 1).sum()).astype(np.float32)
    return weights


def blocks_of(classes: np.ndarray, at: np.ndarray, rows: np.ndarray | None = None, start: int = START) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, keep, targets, place): overlapping windows of CONTEXT inputs that score their last STRIDE targets.

    Text i is classes[at[i]:at[i + 1]]; the input for a target is what stands before it, START at first. keep is
    1 for inputs inside the text, place the target's position in classes, -1 for padding. rows, if given, are the inputs
    in place of the classes, and start is what stands before a text.
    """
    rows = classes if rows is None else rows
    size = np.diff(at)
    n = -(-size // STRIDE)
    text = np.repeat(np.arange(len(size)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    position = first[:, None] + np.arange(STRIDE - CONTEXT, STRIDE)[None, :]
    inside = (position >= 0) & (position < size[text][:, None])
    source = at[:-1][text][:, None] + position
    before = np.where(position > 0, rows[np.clip(source - 1, 0, max(0, len(classes) - 1))], start)
    inputs = np.where(inside, before, start)
    place = np.where(inside, source, -1)[:, -STRIDE:]
    return inputs, inside, classes[np.maximum(place, 0)], place


_ORDER = (np.arange(CONTEXT)[None, :] <= np.arange(CONTEXT - STRIDE, CONTEXT)[:, None]).astype(np.float32)


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for a batch, as one flat product."""
    return (np.ascontiguousarray(x).reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _bounded(x: np.ndarray) -> np.ndarray:
    """x, held below the limit of exp if need be."""
    return np.minimum(x, 60, out=x) if x.max(initial=0) > 60 else x


def pairs_of(inputs: np.ndarray) -> np.ndarray:
    """The row of the pair table for each input and the one before it (itself, for the first)."""
    own = inputs.astype(np.uint32)
    before = np.concatenate([own[:, :1], own[:, :-1]], axis=1)
    mixed = (before * np.uint32(0x9E3779B1)) ^ (own * np.uint32(0x85EBCA77))
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE3D) >> np.uint32(17)).astype(np.int64)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _beside_one(x: np.ndarray) -> np.ndarray:
    """The rows of x with a last entry of 1, to which a bias is a weight like others."""
    out = np.empty((len(x), x.shape[1] + 1), x.dtype)
    out[:, :-1] = x
    out[:, -1] = 1
    return out


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product."""
    return (_flat(x) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def forward(w: dict, inputs: np.ndarray, inside: np.ndarray, pairs: np.ndarray | None = None) -> dict:
    """All steps of the model for a batch of windows: masked attention of the last STRIDE positions to all before. pairs: pairs_of(inputs), if at hand."""
    x = w["embed"].take(inputs, axis=0)
    x += w["place"]
    if "pair" in w:
        x += w["pair"].take(pairs_of(inputs) if pairs is None else pairs, axis=0)
    own = np.ascontiguousarray(x[:, -STRIDE:])
    # weights of the same input lie beside each other: one product for both
    kv = _times(x, np.concatenate([w["key"], w["value"]], axis=1))
    q_last = _times(own, np.concatenate([w["query"] * np.float32(1 / np.sqrt(WIDTH)), w["last"]], axis=1))
    k, v, q = kv[:, :, :WIDTH], kv[:, :, WIDTH:], q_last[:, :, :WIDTH]
    attention = q @ k.transpose(0, 2, 1)
    # what must not be seen gets weight 0
    np.exp(_bounded(attention), out=attention)
    attention *= _ORDER[None]
    cut = np.flatnonzero(~inside.all(axis=1))
    if len(cut):
        attention[cut] *= inside[cut][:, None, :]
    attention *= 1 / np.maximum(_row_sums(attention), np.float32(1e-30))[:, :, None]
    seen = attention @ v
    h = _times(seen, w["mix"])
    h += q_last[:, :, WIDTH:]
    m = _times(h, w["inner"])
    m += w["inner_bias"]
    np.maximum(m, 0, out=m)
    g = _times(m, w["outer"])
    g += h
    # the bias as the weight of a constant input
    ready = _beside_one(_flat(g))
    logits = _bounded(ready @ np.concatenate([w["read"], w["bias"][None, :]])).reshape(*g.shape[:2], -1)
    return {"x": x, "own": own, "q": q, "k": k, "v": v, "attention": attention, "seen": seen, "h": h, "m": m, "g": g, "ready": ready, "logits": logits}


def told_apart(w: dict, g: np.ndarray, rows: np.ndarray, classes: np.ndarray, members: np.ndarray, weight: np.ndarray | None = None, into: np.ndarray | None = None):
    """(log probability of each row among those of its class, gradients of the weighted loss or None) for states g.

    Positions are taken class by class, so that each class is one product; what the products give lies in one array, position
    after position, so all else is done once for all classes. into: gradients of the states, to which theirs are added; then positions
    of no weight are passed over.
    """
    out = np.zeros(len(rows), g.dtype)
    size = np.diff(members)
    some = size[classes] > 1
    todo = np.flatnonzero(some if into is None else some & (weight != 0))
    if not len(todo):
        return out, None if weight is None else (np.zeros_like(g) if into is None else into, np.zeros_like(w["tell"]), np.zeros_like(w["tell_bias"]))
    kind = classes[todo].astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    todo, kind = todo[order], kind[order]
    edge = np.searchsorted(kind, np.arange(CLASSES + 1))
    mine, width = _beside_one(g.take(todo, axis=0)), size[kind]
    begin = np.cumsum(width) - width
    logits = np.empty(int(width.sum()), g.dtype)
    tell = np.concatenate([w["tell"], w["tell_bias"][:, None]], axis=1)
    parts = []
    there = np.flatnonzero(np.diff(edge))
    for a, b, lo, hi, at in zip(*(x.tolist() for x in (edge[there], edge[there + 1], members[there], members[there + 1], begin[edge[there]])), strict=True):
        parts.append((a, b, lo, hi, logits[at : at + (b - a) * (hi - lo)].reshape(b - a, hi - lo)))
        np.matmul(mine[a:b], tell[lo:hi].T, out=parts[-1][4])
    _bounded(logits)
    place = begin + rows[todo] - members[kind]
    chosen = logits[place]
    np.exp(logits, out=logits)
    total = np.add.reduceat(logits, begin)
    out[todo] = chosen - np.log(total)
    grad = None
    if weight is not None:
        logits[place] -= total
        scale = (weight[todo] / total)[:, None]
        scaled, back, moved = mine * scale, np.empty((len(todo), g.shape[1]), g.dtype), np.zeros_like(tell)
        for a, b, lo, hi, part in parts:
            np.matmul(part, w["tell"][lo:hi], out=back[a:b])
            np.matmul(part.T, scaled[a:b], out=moved[lo:hi])
        back *= scale
        into = np.zeros_like(g) if into is None else into
        into[todo] += back
        grad = into, moved[:, :-1], moved[:, -1]
    return out, grad


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(different rows of a table of this size, sums of the values of each)."""
    there = np.zeros(size, dtype=bool)
    there[rows] = True
    which = np.flatnonzero(there)
    number, out = np.empty(size, dtype=np.int64), np.empty((values.shape[1], len(which)))
    number[which] = np.arange(len(which))
    at = number.take(rows)
    for j, column in enumerate(np.ascontiguousarray(values.T, dtype=np.float64)):
        out[j] = np.bincount(at, column, len(which))
    return which, out.T


def _summed_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y, by some hundred rows, which stay in the cache."""
    step = math.gcd(len(x), 256)
    return (x.reshape(-1, step, x.shape[1]).transpose(0, 2, 1) @ y.reshape(-1, step, y.shape[1])).sum(axis=0)


def gradients(w: dict, inputs: np.ndarray, inside: np.ndarray, targets: np.ndarray, valid: np.ndarray, rows: np.ndarray | None = None, members: np.ndarray | None = None) -> dict:
    """Gradients of the mean loss; those of tables by id or pair as (rows, values). rows: the target ids' rows, if ids are told apart."""
    pairs = pairs_of(inputs) if "pair" in w else None
    s = forward(w, inputs, inside, pairs)
    p = _flat(s["logits"])
    np.exp(p, out=p)
    share = (valid / np.float32(max(1, valid.sum()))).astype(p.dtype).ravel()
    # each row times its sum; the narrow arrays are scaled in its place
    total = _row_sums(p)
    p[np.arange(len(p)), targets.ravel()] -= total
    scale = (share / total)[:, None]
    read = _summed_products(p, s["ready"] * scale).T
    out = {"bias": read[-1], "read": read[:-1]}
    dg = p @ w["read"].T
    dg *= scale
    if rows is not None:
        _, (dg, out["tell"], out["tell_bias"]) = told_apart(w, _flat(s["g"]), rows.ravel(), targets.ravel(), members, share, dg)
    m, h, seen, own, x = (_flat(s[k]) for k in ("m", "h", "seen", "own", "x"))
    dm = dg @ w["outer"].T
    dm *= m > 0
    out |= {"outer": _summed_products(m, dg), "inner": _summed_products(h, dm), "inner_bias": np.ones(len(dm), dm.dtype) @ dm}
    dq_dh = np.empty((len(dg), 2 * WIDTH), dg.dtype)
    dh = dm @ w["inner"].T
    dh += dg
    out["mix"] = _summed_products(seen, dh)
    dseen = dh @ w["mix"].T
    # what attention spreads over a row is the product of the row's result and its gradient
    mean = _row_sums(dseen * seen).reshape(s["q"].shape[:2])
    dseen = dseen.reshape(s["seen"].shape)
    ds = dseen @ s["v"].transpose(0, 2, 1)
    ds -= mean[:, :, None]
    ds *= s["attention"]
    dkv = np.empty((*inputs.shape, 2 * WIDTH), dg.dtype)
    # q holds the factor 1 / sqrt(WIDTH) already
    dkv[:, :, :WIDTH] = ds.transpose(0, 2, 1) @ s["q"]
    dkv[:, :, WIDTH:] = s["attention"].transpose(0, 2, 1) @ dseen
    dq_dh[:, :WIDTH] = _flat(ds @ s["k"])
    dq_dh[:, :WIDTH] *= np.float32(1 / np.sqrt(WIDTH))
    dq_dh[:, WIDTH:] = dh
    of_own, of_all = _summed_products(own, dq_dh), _summed_products(x, _flat(dkv))
    out |= {"query": of_own[:, :WIDTH], "last": of_own[:, WIDTH:], "key": of_all[:, :WIDTH], "value": of_all[:, WIDTH:]}
    dx = _times(dkv, np.concatenate([w["key"].T, w["value"].T]))
    dx[:, -STRIDE:] += (dq_dh @ np.concatenate([w["query"].T, w["last"].T])).reshape(s["own"].shape)
    out["place"] = dx.sum(axis=0)
    if pairs is not None:
        sums = np.ascontiguousarray(_flat(dx).T, dtype=np.float64).T
        out["embed"], out["pair"] = _scatter(inputs.ravel(), sums, len(w["embed"])), _scatter(pairs.ravel(), sums, PAIRS)
    else:
        out["embed"] = np.zeros_like(w["embed"])
        np.add.at(out["embed"], inputs.ravel(), _flat(dx))
    return out


def train(w: dict, classes: np.ndarray, at: np.ndarray, rate: float, seed: int, batch: int = 128, rows: np.ndarray | None = None, members: np.ndarray | None = None) -> dict:
    """One pass over the windows of some texts: Adam, and Adagrad for the rows of tables that a batch has.

    rows are the rows by id of the tokens (then ids are told apart), members those of each class.
    """
    start = START if rows is None else int(members[-1])
    inputs, inside, targets, place = blocks_of(classes, at, rows, start)
    order = np.random.default_rng(seed).permutation(len(inputs))
    tables = {k: np.full(len(w[k]), 1e-6, np.float32) for k in ("embed", "pair") if "pair" in w}
    # all other weights lie in one array, which a step moves at once
    names = [k for k in w if k not in tables]
    moved = np.concatenate([w[k].ravel() for k in names])
    edge = np.cumsum([0, *(w[k].size for k in names)]).tolist()
    w = {k: w[k].copy() for k in tables} | {k: moved[a:b].reshape(w[k].shape) for k, a, b in zip(names, edge, edge[1:], strict=False)}
    one, two, grad, step = (np.zeros_like(moved) for _ in range(4))
    steps, whole = range(0, len(order), batch), np.dtype((np.void, 4 * WIDTH))
    for t, lo in enumerate(steps, 1):
        at_ = order[lo : lo + batch]
        slow = min(1.0, t / 20) * (1 - 0.8 * t / len(steps))
        here = place[at_]
        told = None if rows is None else rows[np.maximum(here, 0)]
        got = gradients(w, inputs[at_], inside[at_], targets[at_], (here >= 0).astype(np.float32), told, members)
        for k in tables:
            which, g = got[k]
            g = np.ascontiguousarray(g, dtype=np.float32)
            squares = tables[k].take(which) + _row_sums(g * g) / WIDTH
            tables[k][which] = squares
            g *= (np.float32(TABLE_RATE * slow * rate / RATE) / np.sqrt(squares))[:, None]
            np.subtract(w[k].take(which, axis=0), g, out=g)
            # a row is one item of so many bytes: set at once
            w[k].view(whole)[which] = g.view(whole)
        np.concatenate([got[k].ravel() for k in names], out=grad)
        np.subtract(grad, one, out=step)
        step *= 0.1
        one += step
        grad *= grad
        grad -= two
        grad *= 0.01
        two += grad
        np.multiply(two, 1 / (1 - 0.99**t), out=step)
        np.sqrt(step, out=step)
        step += 1e-8
        np.divide(one, step, out=step)
        step *= rate * slow / (1 - 0.9**t)
        moved -= step
    return {k: v.copy() for k, v in w.items()}


def class_scores(w: dict, classes: np.ndarray, at: np.ndarray, rows: np.ndarray | None = None, members: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of every class given what stands before it; with rows, of the id in it too."""
    out = np.zeros(len(classes))
    start = START if rows is None else int(members[-1])
    inputs, inside, targets, place = blocks_of(classes, at, rows, start)
    states, places = [], []

    def tell() -> None:
        if states:
            where = np.concatenate(places)
            out[where] += told_apart(w, np.concatenate(states), rows[where], classes[where], members)[0] / np.log(10)
            states.clear()
            places.clear()

    for lo in range(0, len(inputs), BLOCKS_AT_ONCE):
        hi = lo + BLOCKS_AT_ONCE
        s = forward(w, inputs[lo:hi], inside[lo:hi])
        logits = _flat(s["logits"])
        chosen = logits[np.arange(len(logits)), targets[lo:hi].ravel()]
        np.exp(logits, out=logits)
        score = (chosen - np.log(_row_sums(logits))) * np.float32(1 / np.log(10))
        here = place[lo:hi].ravel()
        ok = np.flatnonzero(here >= 0)
        out[here[ok]] = score[ok]
        if rows is not None:
            states.append(_flat(s["g"]).take(ok, axis=0))
            places.append(here[ok])
            if len(states) == BATCHES_TOLD:
                tell()
    tell()
    return out


def _with_ends(ids: np.ndarray, per_text: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids with `end` after each text; where the texts begin; where the ends stand."""
    at = np.concatenate([[0], np.cumsum(per_text + 1)])
    out = np.full(at[-1], end, dtype=np.int64)
    mask = np.ones(at[-1], dtype=bool)
    mask[at[1:] - 1] = False
    out[mask] = ids
    return out, at, at[1:] - 1


def _text_sequences(texts: pa.Array) -> list[np.ndarray]:
    words = words_of(texts, fold=True)
    spelling = Spelling(words)
    return [spelling.tokens(int(a), int(b))[0] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _packed(size: int) -> np.dtype:
    """The type that ids of a vocabulary are kept in between stages."""
    return np.min_scalar_type(size)


def _sequences(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each) from a column of packed ids."""
    raw = column.to_pylist()
    ids = np.frombuffer(b"".join(raw), dtype=_packed(size)).astype(np.int64)
    return ids, np.array([len(r) for r in raw], dtype=np.int64) // _packed(size).itemsize


SPELLED = "chunk long, doc_id long, turn int, ids binary, numbers binary, words array<long>, learned array<long>"
TABLES = ("embed", "pair")  # of which a shard moves the rows of the ids and pairs that it has


def add_moves(total: dict, moves: dict, tokens: float) -> None:
    """Add what one shard did to the sums of many: of a table the rows that it moved, of other weights all."""
    for k, m in moves.items():
        sums, behind = total.setdefault(k, (np.zeros(m.shape), np.zeros(len(m) if k in TABLES else 1)))
        at = np.flatnonzero((m != 0).any(axis=1)) if k in TABLES else slice(None)
        sums[at] += m[at] * np.float64(tokens)
        behind[at] += tokens


def told_moves(total: dict) -> bytes:
    """Sums of moves as bytes: of tables only the rows that some shard moved, with their numbers."""
    out = {}
    for k, (sums, behind) in total.items():
        at = np.flatnonzero(behind).astype(np.int32) if k in TABLES else None
        out[k] = (len(sums), at, sums.astype(np.float32) if at is None else sums[at].astype(np.float32), behind if at is None else behind[at])
    return pickle.dumps(out)


def add_told(total: dict, raw: bytes) -> None:
    """Add sums that told_moves has made to others."""
    for k, (size, at, part, tokens) in pickle.loads(raw).items():
        sums, behind = total.setdefault(k, (np.zeros((size, *part.shape[1:])), np.zeros(size if at is not None else 1)))
        where = slice(None) if at is None else at
        sums[where] += part
        behind[where] += tokens


def _trainer(start, turn: int, size: int):
    """Training of one shard after the other: what is at hand when SHARD_TOKENS / ROUNDS have come by. A task adds up what its shards
    did and tells it once, so what is written grows with tasks, not with shards."""

    def run(batches):
        vocabulary, weights = pickle.loads(start.value)
        total, part, tokens = {}, [], 0

        def learn() -> None:
            ids, per_text = _sequences(pa.Table.from_batches(part).column("ids"), size)
            classes, rows, at, _ = rows_with_ends(vocabulary, ids, per_text)
            got = train(weights, classes, at, RATE / (turn + 1), turn, rows=rows, members=vocabulary.members)
            add_moves(total, {k: w - weights[k] for k, w in got.items()}, len(classes))

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part.append(batch.slice(lo, 64))
                tokens += part[-1].column(0).nbytes // _packed(size).itemsize
                if tokens > SHARD_TOKENS // ROUNDS:
                    learn()
                    part, tokens = [], 0
        if part:
            learn()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([told_moves(total)], pa.binary())], ["sums"])

    return run


def _summed(batches):
    """One row of the sums of many tasks."""
    total: dict = {}
    for batch in batches:
        for raw in batch.column(0):
            add_told(total, raw.as_py())
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([told_moves(total)], pa.binary())], ["sums"])


def averaged(weights: dict, parts: DataFrame) -> dict:
    """The weights moved by the mean of what the shards did, each counted by its tokens, of tables only the shards that moved a row. The
    sums of tasks (sums) are added up by Spark; the driver adds PARTIAL_SUMS rows at most."""
    total: dict = {}
    for row in parts.coalesce(PARTIAL_SUMS).mapInArrow(_summed, "sums binary").toLocalIterator():
        add_told(total, bytes(row.sums))
    mean = {k: (sums.T / np.maximum(behind, 1)).T.astype(np.float32) for k, (sums, behind) in total.items()}
    return {k: w + mean[k] if k in mean else w for k, w in weights.items()}


def _slices(batches, rows: int = 64):
    """Batches of few rows, so that what is made of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def id_counts(spelled_out: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all training documents (ids)."""

    def count(batches):
        n = np.zeros(size, dtype=np.int64)
        for batch in _slices(batches):
            n += np.bincount(_sequences(batch.column(0), size)[0], minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    got = spelled_out.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def neighbour_counts(spelled_out: DataFrame, kind: np.ndarray) -> np.ndarray:
    """(id, 2 * SINGLE): how often each id stands after, and before, each id that is a class of its own, in all training documents."""
    size, width = len(kind), 2 * SINGLE

    def count(batches):
        n = np.zeros(size * width, dtype=np.int32)
        for batch in _slices(batches):
            ids, per_text = _sequences(batch.column(0), size)
            inner = np.ones(len(ids), dtype=bool)
            inner[(np.cumsum(per_text) - per_text)[per_text > 0]] = False
            right = np.flatnonzero(inner)
            a, b = ids[right - 1], ids[right]
            for side, own, other in ((0, b, a), (1, a, b)):
                ok = (kind[own] >= SINGLE) & (kind[other] < SINGLE)
                cell, times = np.unique(own[ok] * width + kind[other[ok]] + side * SINGLE, return_counts=True)
                n[cell] += times.astype(np.int32)
        at = np.flatnonzero(n)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part].astype(np.int64))], ["cell", "n"])

    got = spelled_out.select("ids").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * width, dtype=np.float32)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, width)


def fit(training: DataFrame, total: int) -> tuple[Vocabulary, dict]:
    """Vocabulary and weights from all of the `total` training documents (doc_id, text).

    Their ids are spelled once, and the documents are dealt to ROUNDS rounds. In a round each task goes through its part of
    the table in shards of about SHARD_TOKENS / ROUNDS, nothing is shuffled; every shard starts from the common weights, and
    the weights moved by the mean of what the shards did are the next round's start. So each document is learned from once.
    A task writes one row for all its shards, of the tables only the rows that they moved.
    """
    texts = training.select("doc_id", "text", F.lit(True).alias("learn"))
    spelled_out = written(spelled_texts(texts))
    fitted = fit_spelled(spelled_out, total)
    discard(spelled_out)
    return fitted


def spelled_texts(texts: DataFrame) -> DataFrame:
    """The texts (doc_id, text, learn) as ids, spelled where they are read, in chunks of about CHUNK_BYTES; all else rests on this table.

    A row for each text: chunk, doc_id, turn (the round it is dealt to, null if it is not learned from), ids and the numbers of its
    words in the chunk, both packed. Then one row a chunk: its different words and the numbers of their training tokens.
    """
    size = encoder().n_vocab

    def spell(batches):
        held: list[pa.RecordBatch] = []
        n_bytes, chunk = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _slices([batch]):
                held.append(part)
                n_bytes += part.column(1).nbytes
                if n_bytes > CHUNK_BYTES:
                    yield from _spelled_chunk(chunk, pa.Table.from_batches(held), size)
                    held, n_bytes, chunk = [], 0, chunk + 1
        if held:
            yield from _spelled_chunk(chunk, pa.Table.from_batches(held), size)

    turn = F.when(F.col("learn"), F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")), F.lit(ROUNDS)).cast("int"))
    return bounded_batches(texts).select("doc_id", "text", "learn", turn.alias("turn")).mapInArrow(spell, SPELLED)


def _spelled_chunk(chunk: int, table: pa.Table, size: int):
    """Rows of the texts of a chunk (doc_id, text, learn, turn), then one of its words."""
    names = ["chunk", "doc_id", "turn", "ids", "numbers", "words", "learned"]
    words = words_of(table.column("text"), fold=True)
    spelling = Spelling(words)
    longs = pa.list_(pa.int64())
    for lo in range(0, table.num_rows, 128):
        part = table.slice(lo, 128)
        first = words.first[lo : lo + 129]
        here = slice(int(first[0]), int(first[-1]))
        n = len(first) - 1
        ids, per_word = spelling.tokens(here.start, here.stop)
        edge = np.concatenate([[0], np.cumsum(per_word)])
        columns = [pa.array(np.full(n, chunk)), part.column("doc_id").combine_chunks(), part.column("turn").combine_chunks()]
        for values, at in ((ids.astype(_packed(size)), edge[first - first[0]]), (spelling.word[here].astype(np.int32), first - first[0])):
            columns.append(pa.array([values[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, longs), pa.nulls(n, longs)], names)
    keep = np.repeat(table.column("learn").to_numpy(), np.diff(words.first))
    learned = np.bincount(spelling.word, weights=keep, minlength=len(spelling.hashes)).astype(np.int64)
    row = [pa.array([chunk]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
    yield pa.RecordBatch.from_arrays([*row, pa.array([spelling.hashes.view(np.int64)], longs), pa.array([learned], longs)], names)


def fit_spelled(spelled_out: DataFrame, total: int) -> tuple[Vocabulary, dict]:
    """What fit does, from the written table of spelled_texts: only texts that are dealt to a round are learned from."""
    spark = spelled_out.sparkSession
    vocabulary_size = encoder().n_vocab
    spelled_out = spelled_out.filter("turn is not null").select("turn", "ids")
    count = id_counts(spelled_out, vocabulary_size)
    vocabulary = make_vocabulary(count, neighbour_counts(spelled_out, own_classes(count)))
    counts = np.bincount(vocabulary.kind, weights=count, minlength=CLASSES)
    counts[END] = max(1, total)
    counts[START] = 0
    weights = first_weights(counts, vocabulary)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(pickle.dumps((vocabulary, weights)))
        mine = spelled_out.filter(F.col("turn") == turn).select("ids")
        # written, so that a lost executor does not train again what is done
        parts = written(mine.mapInArrow(_trainer(start, turn, vocabulary_size), "sums binary"))
        weights = averaged(weights, parts)
        discard(parts)
        start.destroy()
    return vocabulary, weights


def own_classes(count: np.ndarray) -> np.ndarray:
    """The class of every id before the others are grouped: the most frequent ids are classes of their own."""
    size = len(count)
    kind = SINGLE + np.arange(size) % SHARED
    kind[np.lexsort((np.arange(size), -count))[:SINGLE]] = np.arange(SINGLE)
    return kind


def make_vocabulary(count: np.ndarray, near: np.ndarray) -> Vocabulary:
    """Frequent ids are classes of their own; the others are grouped by the frequent ids they stand between (near, a row for each id)."""
    kind = own_classes(count)
    ranked = np.lexsort((np.arange(len(count)), -count))
    rest = ranked[SINGLE:][count[ranked[SINGLE:]] > 0]
    if len(rest) > SHARED:
        near = near[rest]
        near = np.sqrt(near / np.maximum(1, near.sum(axis=1, keepdims=True)))
        centres = near[:SHARED].copy()
        for _ in range(12):
            group = (near @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
            for g in range(SHARED):
                if (group == g).any():
                    centres[g] = near[group == g].mean(axis=0)
        kind[rest] = SINGLE + group
    weight = count + 0.5
    seen = np.flatnonzero(count > 0)
    # ids that were never seen are the last of the last shared class, and START and END have rows that are never told apart
    kind[count == 0] = SINGLE + SHARED - 1
    seen = seen[np.argsort(kind[seen], kind="stable")]
    unseen = int(np.searchsorted(kind[seen], SINGLE + SHARED, side="left"))
    row = np.full(len(count), unseen, dtype=np.int32)
    row[seen] = np.arange(len(seen))
    members = np.searchsorted(kind[seen], np.arange(CLASSES + 1)).astype(np.int64)
    members[SINGLE + SHARED :] = np.arange(unseen + 1, unseen + 1 + CLASSES - SINGLE - SHARED + 1)
    return Vocabulary(kind.astype(np.int16), np.log10(weight / np.bincount(kind, weights=weight)[kind]), row, members)


def rows_with_ends(vocabulary: Vocabulary, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(classes, rows, begin, ends) of the ids of some texts, with an end after each text."""
    classes, begin, ends = _with_ends(vocabulary.kind[ids].astype(np.int64), per_text, END)
    return classes, _with_ends(vocabulary.row[ids].astype(np.int64), per_text, int(vocabulary.members[END]))[0], begin, ends


def score_documents(docs: DataFrame, training: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document (doc_id, text).

    training is a condition on doc_id; documents that meet it are learned from. Tokens are words in lower
    case (A-Z), then one end. base_score is the sum of log10((c + .5) / (N + .5 * (V + 1))) with counts of
    the training tokens. score is the log10 probability of the text's subword ids, then the end, under the attention
    model: the probability of an id's class given the window before it, times that of the id in its class given the
    same window. Ids that no training document has share one place in the model, in equal parts.

    Texts are read and spelled once, in chunks of about CHUNK_BYTES (spelled_texts); learning and scoring go on from their ids, and a
    text from its words' numbers in the chunk. Each chunk gives its different words once, with their numbers of training tokens; these are summed up by
    word over all documents, brought back to the chunks by a join, and added up for each text. Null or empty text is just
    its end; a null doc_id is not learned from; other columns are not read; repeated rows count as often as they occur; an
    empty table gives no rows.
    """
    texts = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("learn", F.coalesce(F.expr(training), F.lit(False)))
    n_docs = texts.agg(F.count_if("learn")).first()[0]
    spelled_out = written(spelled_texts(texts))
    vocabulary, weights = fit_spelled(spelled_out, n_docs)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((vocabulary, weights)))

    def score(batches):
        vocabulary, weights = pickle.loads(shared.value)
        for batch in batches:
            whole = batch.column("words").is_valid()
            lists, texts = batch.filter(whole), batch.filter(pc.invert(whole))
            yield _with_scores(lists, pa.nulls(lists.num_rows, pa.float64()))
            for part in _slices([texts], 128):
                yield _with_scores(part, pa.array(_text_scores(part.column("ids"), vocabulary, weights)))

    parts = written(spelled_out.mapInArrow(score, "chunk long, doc_id long, score double, numbers binary, words array<long>, learned array<long>"))
    discard(spelled_out)
    listed = parts.filter("words is not null").select("chunk", F.posexplode(F.arrays_zip("words", "learned")).alias("number", "x")).select("chunk", "number", F.col("x.words").alias("word"), F.col("x.learned").alias("n"))
    counts = written(listed.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")))
    in_words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the end is a token too
    total, kinds = in_words + n_docs, kinds + (n_docs > 0)
    counted = listed.select("chunk", "number", "word").join(counts, "word", "left").select(F.col("chunk").alias("place"), "number", F.coalesce("n", F.lit(0)).alias("n"))

    def add_up(key, scored, counted):
        count = np.zeros(counted.num_rows, dtype=np.int64)
        count[counted.column("number").to_numpy()] = counted.column("n").to_numpy()
        base_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        raw = scored.column("numbers").to_pylist()
        number = np.frombuffer(b"".join(raw), dtype=np.int32)
        n_words = np.array([len(r) // 4 for r in raw], dtype=np.int64)
        edge = np.concatenate([[0], np.cumsum(n_words)])
        per = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[edge])
        return pa.table(
            {
                "doc_id": scored.column("doc_id"),
                "n_tokens": pa.array(n_words + 1),
                "n_known": pa.array((per(count[number] > 0) + (n_docs > 0)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(raw), total)),
                "base_score": pa.array(per(base_of(count)[number]) + float(base_of(n_docs))),
                "score": scored.column("score"),
            }
        )

    scored = parts.filter("words is null").select("chunk", "doc_id", "score", "numbers")
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.groupBy("chunk").cogroup(counted.groupBy("place")).applyInArrow(add_up, schema)


def _with_scores(batch: pa.RecordBatch, scores: pa.Array) -> pa.RecordBatch:
    names = ["chunk", "doc_id", "score", "numbers", "words", "learned"]
    return pa.RecordBatch.from_arrays([scores if k == "score" else batch.column(k) for k in names], names)


def _text_scores(ids: pa.Array, vocabulary: Vocabulary, weights: dict) -> np.ndarray:
    """The log10 probabilities of some spelled texts."""
    nowhere = int(vocabulary.members[SINGLE + SHARED]) - 1
    n_nowhere = int((vocabulary.row == nowhere).sum())
    ids, per_text = _sequences(ids, len(vocabulary.kind))
    classes, rows, begin, ends = rows_with_ends(vocabulary, ids, per_text)
    scores = class_scores(weights, classes, begin, rows, vocabulary.members)
    inner = np.ones(len(classes), dtype=bool)
    inner[ends] = False
    scores[inner] -= np.where(vocabulary.row[ids] == nowhere, np.log10(max(1, n_nowhere)), 0.0)
    return np.diff(np.concatenate([[0.0], np.cumsum(scores)])[begin])


def scoring_digest(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))  # a null doc_id is not held out, nor learned from
    scored = score_documents(docs, "crc32(cast(doc_id as string)) % 5 <> 1")
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
