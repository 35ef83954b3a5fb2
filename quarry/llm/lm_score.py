"""Language-model scoring: causal self-attention over subword ids, trained in numpy on all texts, with counts of the whole corpus; a word unigram base.

A text's probability is a product over its subword ids. The net gives the class of the next id from the ids before, as a
correction of how often each class follows the last id in the corpus; within its class an id has its share among those
that continue the word so far. At places that the three words before choose (one in ANCHORS), what followed these words
elsewhere in the corpus is mixed in.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Table, expanded, lean, small_batches

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a word is parted before byte pairs are merged; covers every character.
PARTS = r" ?[^\W\d_]+| ?\d+| ?[^\w\s]+|_+|\s+"
_SPACE = re.compile(r"\s")
END = b""  # the end of a text, counted as a word; no word is empty
#: Distinct words that a task remembers.
REMEMBERED = 400_000
#: One place in so many, told by a hash of the words before it, is looked up in the corpus; by so many words before it.
ANCHORS, BEFORE = 16, 3
#: A word's first so many ids are looked up together as what the next one continues.
PREFIX = 8
#: Places whose logits are computed together: a few 100 KB.
LOGITS = 640
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Numbers(dict):
    """A number for each word, in the order in which they come."""

    def __init__(self) -> None:
        self.words: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


_ENCODERS: dict[int, tuple] = {}


def encoder(ranks: bytes) -> tuple:
    """The encoder of a ranks file and which of its ids start with a blank; made once by each process."""
    name = xxhash.xxh64_intdigest(ranks)
    if name not in _ENCODERS:
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
        starts = np.zeros(max(known.values(), default=0) + 1, bool)
        starts[[i for b, i in known.items() if b[:1] == b" "]] = True
        _ENCODERS.clear()
        _ENCODERS[name] = (tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks=known, special_tokens={}), starts)
    return _ENCODERS[name]


class Subwords:
    """Byte-pair ids of words, remembered until there are REMEMBERED of them; id `size` is the end of a text."""

    def __init__(self, ranks: bytes):
        self.ranks, self.size = ranks, sum(1 for line in ranks.splitlines() if line.strip())
        self._enc, self._codes, self.words, self.shares = None, Numbers(), [], None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "size": self.size, "_enc": None, "_codes": Numbers(), "words": [], "shares": self.shares}

    def forget(self) -> None:
        self._codes = Numbers()

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of texts in a row, each text's end (0) included, and how many each text has; they hold until the
        next call, which may start numbering anew."""
        words, which, sizes = words_in(texts)
        return self.numbers(words)[which], sizes

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, as many as wanted."""
        if len(self._codes) > REMEMBERED or not self._codes:
            self._codes = Numbers()
            self._codes[END]  # the end is number 0
            self.words, self._flat, self._at = self._codes.words, np.array([self.size], np.int32), np.arange(2)
            self.within, self.hashes = np.full(1, self.shares.lowest[self.size] if self.shares else 0.0), np.array([word_hash(END)], np.uint64)
        known = len(self.words)
        out = np.fromiter(map(self._codes.__getitem__, words), np.int64, len(words))
        if len(self.words) > known:
            flat, sizes = self.encode(self.words[known:])
            self._flat = np.concatenate([self._flat, flat])
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(sizes)])
            own = self.shares.logs(flat, sizes) if self.shares else np.zeros(len(flat))
            self.within = np.concatenate([self.within, np.bincount(np.repeat(np.arange(len(sizes)), sizes), own, len(sizes))])
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(word_hash, self.words[known:]), np.uint64)])
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a blank in front, in a row, and how many each has. Words are parted together, and each blank starts a
        word anew; where other white space could cling to a blank, one by one."""
        if self._enc is None:
            self._enc, self._starts = encoder(self.ranks)
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        text = (b" " + b" ".join(words)).decode("utf-8", "replace")
        if len(_SPACE.findall(text)) == len(words):
            flat = self._enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
            at = np.flatnonzero(self._starts[flat])
            if len(at) == len(words) and at[0] == 0:
                return flat, np.diff(np.append(at, len(flat)))
        ids = [self._enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode_ends(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, where END may be among the words: it has the one id `size`."""
        flat, sizes = self.encode([w for w in words if w != END])
        if END in words:
            at = words.index(END)
            flat, sizes = np.insert(flat, sizes[:at].sum(), self.size), np.insert(sizes, at, 1)
        return flat, sizes

    def ids(self, codes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Subword ids of each text of so many words."""
        n = self._at[codes + 1] - self._at[codes]
        item, nth = expanded(n)
        return np.split(self._flat[self._at[codes][item] + nth], np.cumsum(n)[np.cumsum(sizes) - 1][:-1])

    def of(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Subword ids of each text, its end included."""
        if not texts:
            return []
        return self.ids(self.numbers([w for words in texts for w in (*words, END)]), np.array([len(words) + 1 for words in texts]))


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 3)


def anchors(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to be looked up among the words of texts (their hashes in a row; first: where each one's text begins), and the
    keys of the BEFORE words before each."""
    at = np.arange(BEFORE, len(hashes))
    at = at[at - first[at] >= BEFORE]
    key = np.zeros(len(at), np.uint64)
    for back in range(1, BEFORE + 1):
        key = (key ^ hashes[at - back]) * _A
        key ^= key >> np.uint64(31)
    chosen = key % np.uint64(ANCHORS) == 0
    return at[chosen], key[chosen].view(np.int64)


def prefix_keys(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each id of words: a key of the id before it in its word, and one of all ids before it; 0: there is none, or for the
    second more than PREFIX or the one id that the first key has."""
    item, nth = expanded(sizes)
    last = np.zeros(len(flat), np.uint64)
    later = np.flatnonzero(nth > 0)
    last[later] = (flat[later - 1].astype(np.uint64) + np.uint64(1)) * _A
    whole = np.zeros(len(flat), np.uint64)
    start, key = np.cumsum(sizes) - sizes, np.full(len(sizes), _B)
    for j in range(1, PREFIX + 1):
        has = np.flatnonzero(sizes > j)
        if not len(has):
            break
        key[has] = (key[has] ^ flat[start[has] + j - 1].astype(np.uint64)) * _A
        key[has] ^= key[has] >> np.uint64(29)
        if j > 1:
            whole[start[has] + j] = key[has]
    return last, whole


def joint(key: np.ndarray, with_: np.ndarray) -> np.ndarray:
    out = (key ^ (with_.astype(np.uint64) + np.uint64(1)) * _B) * _A
    return out ^ (out >> np.uint64(32))


@dataclass
class Shares:
    """P(id | class, the word so far): counts after a key, each order smoothed by the one below by how many different ids
    followed (Witten-Bell), down to the id's share of its class."""

    of_class: np.ndarray
    lowest: np.ndarray  # natural logs
    pairs: np.ndarray  # (key, id), sorted
    times: np.ndarray
    totals: np.ndarray  # (key, class), sorted
    sums: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, of_class: np.ndarray, lowest: np.ndarray, key: np.ndarray, ids: np.ndarray, n: np.ndarray) -> Shares:
        pair = joint(key, ids)
        order = np.argsort(pair)
        total, at = np.unique(joint(key, of_class[ids]), return_inverse=True)
        return cls(of_class, lowest, pair[order], n[order].astype(np.float32), total, np.bincount(at, n, len(total)).astype(np.float32), np.bincount(at, minlength=len(total)).astype(np.float32))

    def logs(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        p = np.exp(self.lowest[flat])
        if not len(self.pairs):
            return np.log(p)
        for key in prefix_keys(flat, sizes):
            at = np.flatnonzero(key)
            wanted = joint(key[at], self.of_class[flat[at]])
            t = np.minimum(np.searchsorted(self.totals, wanted), len(self.totals) - 1)
            known = self.totals[t] == wanted
            at, t = at[known], t[known]
            wanted = joint(key[at], flat[at])
            c = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
            times = np.where(self.pairs[c] == wanted, self.times[c], 0)
            p[at] = (times + self.kinds[t] * p[at]) / (self.sums[t] + self.kinds[t])
        return np.log(p)


@dataclass
class Net:
    """One layer of causal self-attention over embeddings of the ids before, then a softmax over classes of ids, as a
    correction of `after`: for each last id the log share of each class after it."""

    params: dict[str, np.ndarray]
    of_class: np.ndarray
    after: np.ndarray
    context: int
    stride: int
    _tables: tuple | None = None

    def windows(self, sequences: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets (-1: none) and the sequence of each window. A window scores `stride` ids, after `context`
        ids that it shares with the window before; so each id is a target once. Input 0 of a sequence is its start."""
        counts = np.array([-(-len(s) // self.stride) for s in sequences], np.int64)
        which, nth = expanded(counts)
        flat = np.concatenate([np.zeros(0, np.int32), *sequences])
        sizes = np.array([len(s) for s in sequences], np.int64)
        first = np.cumsum(sizes) - sizes
        place = (nth * self.stride - self.context)[:, None] + np.arange(self.context + self.stride)[None, :]
        at = first[which][:, None] + place
        own = (place >= 0) & (place < sizes[which][:, None])
        targets = np.where(own[:, self.context :], flat[np.clip(at[:, self.context :], 0, max(len(flat) - 1, 0))], -1) if len(flat) else np.zeros((0, self.stride), np.int32)
        inputs = np.where(place == 0, size + 1, flat[np.clip(at - 1, 0, max(len(flat) - 1, 0))]) if len(flat) else np.zeros((0, self.context + self.stride), np.int32)
        return np.where((place >= 0) & (place < sizes[which][:, None]), inputs, size + 2), targets, which

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tables": None}

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Keys, values, queries and the rows x (embeddings or places) themselves, side by side."""
        return np.concatenate([x @ np.concatenate([self.params["kv"], self.params["q"]], 1), x], 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By id and by place what is projected of an input, and `after` with the bias. Kept until a Step."""
        if self._tables is None:
            self._tables = (self.projected(self.params["embed"]), self.projected(self.params["place"]), self.after + self.params["bias"])
        return self._tables

    def forward(self, inputs: np.ndarray, keep: bool = False):
        """Logits of the classes of the next id (rows, stride, classes); keep: all that Step needs, logits last, from the parameters
        as they are now."""
        if keep:
            self._tables = None
        *tables, after = self.tables()
        kept = self.hidden(inputs, inputs, *tables)
        z = self.logits(kept[-1], inputs[:, self.context :].reshape(-1), after).reshape(len(inputs), self.stride, -1)
        return (*kept, z) if keep else z

    def hidden(self, inputs: np.ndarray, at: np.ndarray, by_id: np.ndarray, by_place: np.ndarray) -> tuple:
        """What is projected of each input, weights and their sums, values met, and the two sides of `mix`; from the rows `at` of
        by_id. Products go block by block, which BLAS does without copies."""
        p, c = self.params, self.context
        d = p["out"].shape[0]
        first = np.flatnonzero(inputs[:, 0] == len(p["embed"]) - 1)  # padding beyond the end is seen by padding only
        g = by_id.take(at, 0)
        g += by_place
        a = limited(g[:, c:, 2 * d : 3 * d] @ g[..., :d].transpose(0, 2, 1), 30)
        np.exp(a, out=a)
        a *= _causal(c, self.stride)
        a[first, :, :c] *= (inputs[first, :c] != len(p["embed"]) - 1)[:, None, :]
        total = a.reshape(-1, a.shape[2]) @ np.ones((a.shape[2], d), a.dtype)  # as wide as the values: short rows are slow to spread
        total += a.dtype.type(1e-9)
        h = (a @ g[..., d : 2 * d]).reshape(-1, d)
        h /= total
        y0 = g[:, c:, 3 * d :].reshape(-1, d) + h
        pre = (self.blocks(y0) @ p["mix"]).reshape(-1, d)
        y = np.maximum(pre, 0)
        y += y0
        return g, a, total, h, y0, pre, y

    def logits(self, y: np.ndarray, last: np.ndarray, after: np.ndarray) -> np.ndarray:
        z = y @ self.params["out"]
        z += after.take(last, 0)
        return limited(z, 40)

    def blocks(self, x: np.ndarray) -> np.ndarray:
        """Rows in blocks of 16 windows, or of one where windows are not so many."""
        return x.reshape(-1, self.stride * (1 if len(x) % (16 * self.stride) else 16), x.shape[-1])

    def logs(self, sequences: list[np.ndarray], size: int, rows: int = 256) -> np.ndarray:
        """Natural log probability of the class of each id, given all before it in its window; the sequences in a row."""
        inputs, targets, _ = self.windows(sequences, size)
        has = (targets >= 0).reshape(-1)
        own, last = self.of_class.take(np.maximum(targets, 0)).reshape(-1), inputs[:, self.context :].reshape(-1)
        out, ones = np.zeros(len(own)), np.ones(len(self.params["bias"]), np.float32)
        for s in range(0, len(inputs), rows):
            part = inputs[s : s + rows]
            *tables, after = self.tables()
            y = self.hidden(part, part, *tables)[-1]
            for i in range(0, len(y), LOGITS):
                at = slice(s * self.stride + i, s * self.stride + min(i + LOGITS, len(y)))
                z = self.logits(y[i : i + LOGITS], last[at], after)
                mine = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + own[at])
                out[at] = mine - np.log(np.exp(z, out=z) @ ones)
        return out[has]


def limited(x: np.ndarray, most: float) -> np.ndarray:
    """x, changed in place where it is beyond +-most."""
    if x.size and (x.max() > most or x.min() < -most):
        np.clip(x, -most, most, out=x)
    return x


@cache
def _causal(context: int, stride: int) -> np.ndarray:
    """Query at place context + i sees inputs up to its own."""
    return (np.arange(context + stride)[None, :] <= context + np.arange(stride)[:, None]).astype(np.float32)[None]


@dataclass
class Topics:
    """Groups of texts by their frequent ids: spherical k-means of the square roots of these ids' shares."""

    place: np.ndarray  # of each frequent id in a centre; -1: none
    centres: np.ndarray

    @classmethod
    def of(cls, sequences: list[np.ndarray], size: int, topics: int = 6, rounds: int = 12) -> Topics:
        """Each start is the text least like those before; texts of fewer than 20 ids do not count. One topic if there are too few."""
        counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *sequences]), minlength=size)
        used = np.sort(np.argsort(-counts, kind="stable")[:2048])
        place = np.full(size, -1)
        place[used] = np.arange(len(used))
        longer = [s for s in sequences if len(s) >= 20]
        found = cls(place, np.zeros((1, len(used)), np.float32))
        if len(longer) < topics:
            return found
        x = found.shares(longer)
        c = x[:1]
        for _ in range(topics - 1):
            c = np.concatenate([c, x[[int(np.argmin((x @ c.T).max(1)))]]])
        for _ in range(rounds):
            own = np.argmax(x @ c.T, 1)
            total = np.stack([x[own == t].sum(0) if (own == t).any() else c[t] for t in range(topics)])
            c = total / (np.sqrt((total * total).sum(1, keepdims=True)) + 1e-9)
        return cls(place, c)

    def shares(self, sequences: list[np.ndarray]) -> np.ndarray:
        width = self.centres.shape[1]
        text, _ = expanded(np.array([len(s) for s in sequences], np.int64))
        at = self.place[np.concatenate([np.zeros(0, np.int64), *sequences])]
        met = at >= 0
        x = np.sqrt(np.bincount(text[met] * width + at[met], minlength=len(sequences) * width).astype(np.float32)).reshape(-1, width)
        return x / (np.sqrt((x * x).sum(1, keepdims=True)) + 1e-9)

    def counts(self, sequences: list[np.ndarray], rows: int = 512) -> np.ndarray:
        """How often each id stands in texts of each topic (topics, ids)."""
        size, n = len(self.place), len(self.centres)
        out = np.zeros(n * size, np.int64)
        for s in range(0, len(sequences), rows):
            part = sequences[s : s + rows]
            own = np.argmax(self.shares(part) @ self.centres.T, 1)
            out += np.bincount(np.repeat(own, [len(x) for x in part]) * size + np.concatenate(part), minlength=n * size)
        return out.reshape(n, size)


def id_topics(by: np.ndarray) -> np.ndarray:
    """For each id the topic in which it is most at home; as many as there are topics where no text has it."""
    share = (by + 1e-9) / (by.sum(1, keepdims=True) + 1e-6)
    return np.where(by.sum(0) > 0, share.argmax(0), len(by))


def id_classes(counts: np.ndarray, n: int, starts: np.ndarray | None = None, topics: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of nearly equal mass: ids that start words first, then by topic, then in order of frequency; and the natural log
    of each id's share within its class (0.5 added to each count)."""
    mass, none = counts + 0.5, np.zeros(len(counts))
    order = np.lexsort((np.arange(len(mass)), -mass, none if topics is None else topics, none if starts is None else ~starts))
    share = np.cumsum(mass[order]) / mass.sum()
    cls = np.empty(len(mass), np.int64)
    cls[order] = np.minimum(((share - mass[order] / mass.sum() / 2) * n).astype(np.int64), n - 1)
    used, cls = np.unique(cls, return_inverse=True)
    return cls, np.log(mass / np.bincount(cls, mass, len(used))[cls])


def class_after(cls: np.ndarray, counts: np.ndarray, last: np.ndarray, ids: np.ndarray, n: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Natural log share of each class after each id (rows; the last two: a text's start, padding), from how often ids follow
    within words (last, ids, n) and how often each opens a word: what ends a word is followed by what opens one."""
    classes, size = int(cls.max()) + 1, len(counts)
    first = np.bincount(cls, opens, classes) + 0.01
    out = np.zeros((size + 2, classes), np.float32)
    np.add.at(out, (last, cls[ids]), n.astype(np.float32))
    ends = np.maximum(counts - out[:size].sum(1), 0)
    out[:size] += (ends[:, None] * (first / first.sum())[None, :]).astype(np.float32)
    out[size:] = first
    every = np.bincount(cls, counts + 0.5, classes)
    out += (2 * every / every.sum()).astype(np.float32)[None, :]
    return np.log(out / out.sum(1, keepdims=True))


class Step:
    """Adam on the mean cross-entropy of the class of the next id over a batch of windows; gradients by hand."""

    def __init__(self, net: Net):
        self.net, self.n = net, 0
        # the embedding lies beside its two moments, the other parameters in a row, so that they are moved together
        embed = net.params["embed"]
        self.by_id = np.concatenate([embed, np.zeros_like(embed), np.zeros_like(embed)], 1)
        self.rest = [k for k in net.params if k != "embed"]
        self.flat = np.concatenate([net.params[k].reshape(-1) for k in self.rest])
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)
        at = 0
        for k in self.rest:
            shape, size = net.params[k].shape, net.params[k].size
            net.params[k] = self.flat[at : at + size].reshape(shape)
            at += size
        net.params["embed"] = self.by_id[:, : embed.shape[1]]

    def gradients(self, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Ids met, and the gradient of each parameter; of `embed`, its rows of these ids."""
        net, p, c = self.net, self.net.params, self.net.context
        d = p["out"].shape[0]
        # a few hundred ids stand at all places: what depends on an id alone is taken once
        flat = inputs.reshape(-1).astype(np.min_scalar_type(len(self.by_id)))
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        new = np.ones(len(flat), bool)
        np.not_equal(flat[1:], flat[:-1], out=new[1:])
        first = np.flatnonzero(new)
        ids = flat[first].astype(np.int64)
        at = np.empty(len(flat), np.int64)
        at[order] = np.cumsum(new) - 1
        at = at.reshape(inputs.shape)
        g, a, total, h, y0, pre, y = net.hidden(inputs, at, net.projected(self.by_id.take(ids, 0)[:, :d]), net.projected(p["place"]))
        targets, last, after = targets.reshape(-1), at[:, c:].reshape(-1), net.after.take(ids, 0) + p["bias"]
        has, own = targets >= 0, net.of_class.take(np.maximum(targets, 0))
        each, out, ones = (has / max(1, int(has.sum()))).astype(y.dtype), np.ascontiguousarray(p["out"].T), np.ones(len(p["bias"]), y.dtype)
        grad = {"out": np.zeros(p["out"].shape, y.dtype), "bias": np.zeros(len(ones), y.dtype)}
        dy = np.empty_like(y)
        for s in range(0, len(y), LOGITS):
            part = slice(s, s + LOGITS)
            z = net.logits(y[part], last[part], after)
            np.exp(z, out=z)
            # the gradient of the logits is exp(z) / their sum, less 1 at the own class, over the number of targets; narrower rows are scaled instead
            sums = z @ ones
            z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + own[part]] -= sums
            scale = each[part] / sums
            wide = np.repeat(scale, d).reshape(-1, d)
            grad["out"] += (y[part] * wide).T @ z
            grad["bias"] += scale @ z
            np.multiply(z @ out, wide, out=dy[part])
        dpre = net.blocks(dy * (pre > 0))
        grad["mix"] = (net.blocks(y0).transpose(0, 2, 1) @ dpre).sum(0)
        dy += (dpre @ np.ascontiguousarray(p["mix"].T)).reshape(-1, d)
        by = dy / total
        mean = (by * h) @ np.ones((d, a.shape[2]), h.dtype)  # of da under a, as h is that of the values
        by = by.reshape(len(inputs), -1, d)
        ds = by @ g[..., d : 2 * d].transpose(0, 2, 1)
        ds -= mean.reshape(ds.shape)
        ds *= a
        dg = np.empty((*inputs.shape, 3 * d), h.dtype)
        dg[:, :c, 2 * d :] = 0
        np.matmul(ds.transpose(0, 2, 1), g[:, c:, 2 * d : 3 * d], out=dg[..., :d])
        np.matmul(a.transpose(0, 2, 1), by, out=dg[..., d : 2 * d])
        np.matmul(ds, g[..., :d], out=dg[:, c:, 2 * d :])
        some = 1 if len(inputs) % 16 else 16
        each = (g[..., 3 * d :].reshape(-1, some * inputs.shape[1], d).transpose(0, 2, 1) @ dg.reshape(-1, some * inputs.shape[1], 3 * d)).sum(0)
        grad["kv"], grad["q"] = each[:, : 2 * d], each[:, 2 * d :]
        dx = dg @ np.ascontiguousarray(np.concatenate([p["kv"], p["q"]], 1).T)
        dx[:, c:] += dy.reshape(by.shape)
        grad["place"] = dx.sum(0)
        dx = dx.reshape(-1, d).take(order, 0)
        if d % 2 == 0:  # numbers are added two by two
            dx = dx.view(np.result_type(dx.dtype, np.complex64))
        grad["embed"] = np.add.reduceat(dx, first, 0).view(h.dtype)
        return ids, grad

    def __call__(self, inputs: np.ndarray, targets: np.ndarray, rate: float) -> None:
        ids, grad = self.gradients(inputs, targets)
        self.n += 1
        self.net._tables = None
        by_m, by_v = float(rate) / (1 - 0.9**self.n), 1 / (1 - 0.99**self.n)

        def moved(x: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
            return x - by_m * m / (np.sqrt(by_v * v) + 1e-8), m, v

        self.by_id[ids] = np.concatenate(moved(*np.split(self.by_id.take(ids, 0), 3, 1), grad["embed"]), 1)
        self.flat[:], self.m, self.v = moved(self.flat, self.m, self.v, np.concatenate([grad[k].reshape(-1) for k in self.rest]))


def fit(sequences: list[np.ndarray], of_class: np.ndarray, after: np.ndarray, width: int = 16, context: int = 8, stride: int = 16, steps: int = 800, rows: int = 64, rate: float = 0.01, seed: int = 0) -> Net:
    """A net from so many steps of `rows` windows drawn from the sequences."""
    n_cls, size = after.shape[1], len(of_class) - 1
    rng = np.random.default_rng(seed)
    g = lambda *s, k=0.1: rng.normal(0, k, s).astype(np.float32)
    p = {"embed": g(size + 3, width, k=0.3), "place": g(context + stride, width), "q": g(width, width, k=0.25), "kv": g(width, 2 * width, k=0.25), "mix": g(width, width, k=0.25), "out": g(width, n_cls, k=0.05), "bias": np.zeros(n_cls, np.float32)}
    net = Net(p, of_class, after, context, stride)
    inputs, targets, _ = net.windows(sequences, size)
    if not len(inputs):
        return net
    step = Step(net)
    for i in range(1, steps + 1):
        pick = rng.integers(0, len(inputs), rows)
        step(inputs[pick], targets[pick], rate * min(1, i / 30) * (1 - 0.9 * i / steps))
    return net


def trained(learn: DataFrame, net: Net, subwords: Subwords, rows: int = 160, rate: float = 0.003) -> tuple[Net, int]:
    """The net after one pass over all texts of `learn`, and how many ids it learnt from: each task goes on from the given net
    over its own texts, each id a target once; then parameters are averaged by ids, those of an id by how often a task met it."""
    rest = [k for k in net.params if k != "embed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net({k: x.copy() for k, x in net.params.items()}, net.of_class, net.after, net.context, net.stride)
        step, met, n, rng = Step(own), np.zeros(len(own.params["embed"])), 0, np.random.default_rng(0)
        for batch in batches:
            for part in runs_of(batch.column("text")):
                inputs, targets, _ = own.windows(subwords.ids(*subwords.coded(part)), subwords.size)
                met += np.bincount(inputs.reshape(-1), minlength=len(met))
                n += int((targets >= 0).sum())
                order = rng.permutation(len(inputs))
                for pick in np.split(order, range(rows, len(order), rows)):
                    step(inputs[pick], targets[pick], rate / np.sqrt(1 + step.n / 200))
        if n:
            ids = np.flatnonzero(met)
            values = [ids, met[ids], own.params["embed"][ids].astype(float), np.concatenate([own.params[k].reshape(-1) for k in rest]).astype(float) * n]
            values[2] *= values[1][:, None]
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([x.tobytes()], pa.binary()) for x in values)], names=names)

    def added(blobs: Iterator[tuple]) -> tuple | None:
        n, met, embed, others = 0, np.zeros(len(net.params["embed"])), np.zeros(net.params["embed"].shape), 0.0
        for count, *values in blobs:
            ids, times, e, r = np.frombuffer(values[0], np.int64), *(np.frombuffer(x) for x in values[1:])
            n, others = n + count, others + r
            met[ids] += times
            embed[ids] += e.reshape(len(ids), -1)
        ids = np.flatnonzero(met)
        return (n, ids, met[ids], embed[ids], others) if n else None

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if total := added(tuple(r[c] for c in names) for b in batches for r in b.to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(total[:1]), *(pa.array([x.tobytes()], pa.binary()) for x in total[1:])], names=names)

    names = ["n", "ids", "met", "embed", "rest"]
    kinds = "n long, ids binary, met binary, embed binary, rest binary"
    small_batches(learn.sparkSession)
    each = Table(learn.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), kinds))
    some = each.df.coalesce(learn.sparkSession.sparkContext.defaultParallelism).mapInArrow(lean(join), kinds).collect()
    each.drop()
    if (total := added(tuple(r) for r in some)) is None:
        return net, 0
    n, ids, met, embed, others = total
    params, at = {"embed": net.params["embed"].copy()}, 0
    params["embed"][ids] = embed / met[:, None]
    for k in rest:
        x = net.params[k]
        params[k] = (others[at : at + x.size] / n).astype(np.float32).reshape(x.shape)
        at += x.size
    return Net(params, net.of_class, net.after, net.context, net.stride), n


def words_of(text: bytes) -> list[bytes]:
    """Words end at ASCII white space; A-Z are lower-cased."""
    return text.lower().split()


def words_in(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts as words_of parts them, END first; which of these stand in the texts, in a row, END after each
    text; and how many each text has with it. Null is empty."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat, sizes = parts.flatten(), np.diff(parts.offsets.to_numpy()).astype(np.int64)
    filled = pc.binary_length(flat).to_numpy() > 0  # white space at either end leaves an empty part
    if not filled.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled], minlength=len(sizes))
        flat = flat.filter(pa.array(filled))
    coded = flat.dictionary_encode()
    row = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.binary()))
    words = pc.binary_join(row, b" ")[0].as_py().split()
    return [END, *words], np.insert(coded.indices.to_numpy().astype(np.int64) + 1, np.cumsum(sizes), 0), sizes + 1


def corpus_counts(docs: DataFrame, subwords: Subwords | None = None, topics: Topics | None = None) -> DataFrame:
    """word, its hash ctx, and n: how often it occurs in all texts, ends (word '') included; and with a null word: ctx, nxt and
    n, how often the word of hash nxt stands at a place to be looked up after the words of key ctx; with topics also (word and
    ctx null) nxt = topic * 2^32 + id and n, how often an id stands in texts of a topic. Pre-aggregated by each task."""

    def out(words: list[bytes], n: np.ndarray, hashes: np.ndarray, ctx: list[np.ndarray], nxt: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(words), 50_000):
            part = pa.array(words[s : s + 50_000], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part, pa.array(hashes[s : s + 50_000].view(np.int64)), pa.nulls(len(part), pa.int64()), pa.array(n[s : s + 50_000])], names=["word", "ctx", "nxt", "n"])
        if ctx:
            after, which = np.concatenate(ctx), np.concatenate(nxt)
            order = np.lexsort((which, after))
            after, which = after[order], which[order]
            first = np.flatnonzero(np.r_[True, (after[1:] != after[:-1]) | (which[1:] != which[:-1])]) if len(after) else order
            n = np.diff(np.append(first, len(after)))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), pa.array(after[first]), pa.array(which[first]), pa.array(n)], names=["word", "ctx", "nxt", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, hashes, n, ctx, nxt, held = Numbers(), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], [], 0
        by = np.zeros((0, 0), np.int64)
        ids_of, at_of = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            for part in runs_of(batch.column("text"), 4 << 20):
                words, which, sizes = words_in(part)
                codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))[which]
                hashes = np.concatenate([hashes, np.fromiter(map(word_hash, numbers.words[len(hashes) :]), np.uint64)])
                n = np.pad(n, (0, len(hashes) - len(n))) + np.bincount(codes, minlength=len(hashes))
                if topics is not None:
                    ids, m = subwords.encode_ends(numbers.words[len(at_of) - 1 :])
                    ids_of, at_of = np.concatenate([ids_of, ids]), np.concatenate([at_of, at_of[-1] + np.cumsum(m)])
                    item, nth = expanded(at_of[codes + 1] - at_of[codes])
                    flat, last = ids_of[at_of[codes][item] + nth], np.cumsum(at_of[codes + 1] - at_of[codes])[np.cumsum(sizes) - 1]
                    found = topics.counts(np.split(flat, last[:-1]))
                    by = by + found if by.size else found
                h = hashes[codes]
                at, key = anchors(h, np.repeat(np.cumsum(sizes) - sizes, sizes))
                ctx.append(key)
                nxt.append(h[at].view(np.int64))
                held += len(key)
                if len(numbers) > REMEMBERED or held > REMEMBERED:
                    yield from out(numbers.words, n, hashes, ctx, nxt)
                    numbers, hashes, n, ctx, nxt, held = Numbers(), np.zeros(0, np.uint64), np.zeros(0, np.int64), [], [], 0
                    ids_of, at_of = np.zeros(0, np.int32), np.zeros(1, np.int64)
        yield from out(numbers.words, n, hashes, ctx, nxt)
        topic, ids = np.nonzero(by)
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64()), pa.array(topic << 32 | ids), pa.array(by[topic, ids])], names=["word", "ctx", "nxt", "n"])

    small_batches(docs.sparkSession)
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "word string, ctx long, nxt long, n long")
    return counted.groupBy("word", "ctx", "nxt").agg(F.sum("n").alias("n"))


def runs_of(texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """The texts in runs of about `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = min(len(texts), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1)
        yield texts.slice(at, to - at)
        at = to


def subword_counts(words: DataFrame, subwords: Subwords) -> DataFrame:
    """last, id and n: how often an id follows another within words (last -1: it opens one), in the corpus whose word counts
    are given; each different word is parted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {"pair": np.zeros(0, np.int64), "n": np.zeros(0)}

        def added(pair: np.ndarray, n: np.ndarray) -> None:
            found, at = np.unique(np.concatenate([total["pair"], pair]), return_inverse=True)
            total["pair"], total["n"] = found, np.bincount(at, np.concatenate([total["n"], n]), len(found))

        def out() -> pa.RecordBatch:
            pair = total["pair"]
            return pa.RecordBatch.from_arrays([pa.array((pair >> 32).astype(np.int32) - 1), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(total["n"].astype(np.int64))], names=["last", "id", "n"])

        for batch in batches:
            names, n = batch.column("word").cast(pa.binary()).to_pylist(), batch.column("n").to_numpy()
            if END in names:  # a word of one id
                n_end = float(n[names.index(END)])
                added(np.array([subwords.size], np.int64), np.array([n_end]))
                n = np.delete(n, names.index(END))
                names.remove(END)
            flat, sizes = subwords.encode(names)
            flat = flat.astype(np.int64)
            item, nth = expanded(sizes)
            last = np.where(nth > 0, np.roll(flat, 1) + 1, 0)
            added(last << 32 | flat, n[item].astype(float))
            if len(total["pair"]) > 1_000_000:
                yield out()
                total["pair"], total["n"] = np.zeros(0, np.int64), np.zeros(0)
        yield out()

    return words.mapInArrow(lean(run), "last int, id int, n long").groupBy("last", "id").agg(F.sum("n").alias("n"))


def prefix_counts(words: list[bytes], times: np.ndarray, subwords: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, id and n: how often an id follows all ids before it in a word, for the words given and how often each occurs."""
    flat, sizes = subwords.encode([w for w in words if w != END])
    n = np.array([t for w, t in zip(words, times.tolist(), strict=True) if w != END], float)
    key = prefix_keys(flat, sizes)[1]
    at = np.flatnonzero(key)
    both, place = np.unique(np.stack([key[at], flat[at].astype(np.uint64)], 1), axis=0, return_inverse=True)
    return both[:, 0], both[:, 1].astype(np.int64), np.bincount(place.reshape(-1), n[expanded(sizes)[0][at]], len(both))


def learnt(subwords: Subwords, learn: DataFrame, words: DataFrame, total: float, head: list[bytes], head_times: np.ndarray, sequences: list[np.ndarray], by: np.ndarray, share: float, classes: int = 64, **options) -> Net:
    """The net, with subwords.shares set, from all words' counts, ids' counts by topic, and a pass over all texts of `learn`
    that begins with weights fitted to some sequences."""
    pairs = Table(subword_counts(words, subwords), narrow=True).df
    opened = pairs.where("last = -1").toPandas()  # at most one row for each id
    by_id = pairs.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    frequent = pairs.where((F.col("last") >= 0) & (F.col("n") >= max(1.0, share * total))).toPandas()
    counts, opens = np.zeros(subwords.size + 1), np.zeros(subwords.size + 1)
    counts[by_id["id"]], opens[opened["id"]] = by_id["n"], opened["n"]
    starts = opens > 0.5 * counts
    cls, lowest = id_classes(counts, classes, starts, id_topics(by))
    last, ids, n = (frequent[c].to_numpy(np.int64) for c in ("last", "id", "n"))
    after = class_after(cls, counts, last, ids, n, opens)
    key, follows, times = prefix_counts(head, head_times, subwords)
    net = trained(learn, fit(sequences, cls, after, **options), subwords)[0]
    subwords.forget()  # words known so far have no shares
    keys = np.concatenate([(last.astype(np.uint64) + np.uint64(1)) * _A, key])
    subwords.shares = Shares.of(cls, lowest, keys, np.concatenate([ids, follows]), np.concatenate([n.astype(float), times]))
    return net


def score(docs: DataFrame, held_out: Column, ranks_path: str = RANKS_PATH, sample: int = 3000, head_share: float = 2e-6, discount: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text).

    Learns from all rows for which `held_out` is false: counts of words, of ids after ids, of ids by topic and of what follows
    three words, and the attention weights, which every one of these rows trains once. Texts of `sample` of them at most, and
    `steps` drawn from these, only give the weights and the topics' centres that this begins with. base_score: log10 probability under
    add-half smoothed word frequencies, the end included; score: under the model. Where a place is looked up, the word
    that mostly followed there gets its share less `discount` occurrences, the model the rest; a row that is learnt from
    does not count for itself. Words of at least `head_share` of all training tokens, and pairs of ids of as large a
    share (at most 1 / head_share and 2.5 / head_share or so, thus they can be sent to each task), are looked up in place;
    the other words meet their counts by a join on 64-bit hashes, the other pairs of ids are left to the order below.

    A null text counts as empty: only the end is scored. Repeated rows are scored and learned from each. Texts are read
    whole. Without training rows train_tokens is 0 and scores come from untrained weights. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        subwords = Subwords(f.read())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    learn = rows.where(~F.col("held_out"))
    # starting weights and centres; twice as many as wanted, distinct, then the first ones by hash: equal texts, however many, are one
    keep = int(min(1.0, 2 * sample / max(learn.count(), 1)) * 1_000_000)
    order = F.xxhash64("text", F.lit(11))
    some = learn.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < keep).select("text").distinct().orderBy(order, "text").limit(sample).toPandas()["text"].fillna("").sort_values()
    sequences = subwords.of([words_of(t.encode()) for t in some])
    topics = Topics.of(sequences, subwords.size + 1)
    corpus = Table(corpus_counts(learn, subwords, topics)).df
    words = corpus.where("word is not null").select("word", "n", F.col("ctx").alias("_key"))
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    by = np.zeros((len(topics.centres), subwords.size + 1))
    at = corpus.where("word is null and ctx is null").select("nxt", "n").toPandas()  # at most one row for each topic and id
    by[at["nxt"].to_numpy() >> 32, at["nxt"].to_numpy() & 0xFFFFFFFF] = at["n"]
    head_rows = words.where(F.col("n") >= max(1.0, head_share * total)).toPandas().sort_values("word")
    head_words = [w.encode() for w in head_rows["word"]]
    net = learnt(subwords, learn, words, total, head_words, head_rows["n"].to_numpy(), sequences, by, head_share, **options)
    bottom = np.log10(total + 0.5 * (distinct + 1))
    head = dict(zip(head_words, (np.log10(head_rows["n"].to_numpy() + 0.5) - bottom).tolist(), strict=True))
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<long>, ctx array<long>, nxt array<long>, lp array<double>"
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, numbered = np.zeros(0), None  # log10 of each numbered word; NaN: not in the head
        for batch in batches:
            done = 0
            for part in runs_of(batch.column("text")):
                m = len(part)
                cut = slice(done, done + m)
                row, held = batch.column("row").to_numpy()[cut], batch.column("held_out")[cut]
                done += m
                every, sizes = subwords.coded(part)
                if subwords.words is not numbered:
                    numbered, logs = subwords.words, np.zeros(0)
                if len(logs) < len(numbered):
                    logs = np.concatenate([logs, [head.get(w, np.nan) for w in numbered[len(logs) :]]])
                text_of, _ = expanded(sizes)
                # the model: ids are scored in a row, then summed by word; each text has its end as a word of one id
                lp = net.logs(subwords.ids(every, sizes), subwords.size)
                n_ids = subwords._at[every + 1] - subwords._at[every]
                by_word = (np.add.reduceat(lp, np.cumsum(n_ids) - n_ids) + subwords.within[every]) / np.log(10)
                scores = np.bincount(text_of, by_word, m)
                hashes = subwords.hashes[every]
                at, ctx = anchors(hashes, (np.cumsum(sizes) - sizes)[text_of])
                # the base
                own = logs[every]
                rare = np.isnan(own)
                base = np.bincount(text_of[~rare], own[~rare], m).astype(float)  # of nothing it would be whole numbers
                known = np.bincount(text_of[~rare], minlength=m)
                pair, times = np.unique(text_of[rare] * len(numbered) + every[rare], return_counts=True)
                rare_hash = subwords.hashes[pair % len(numbered)].view(np.int64)
                listed = lambda which, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(which, np.arange(m + 1)), pa.int32()), pa.array(values))
                cols = [row, batch.column("doc_id")[cut], held, sizes, known.astype(np.int64), base, scores]
                cols += [listed(pair // len(numbered), x) for x in (rare_hash, times)] + [listed(text_of[at], x) for x in (ctx, hashes[at].view(np.int64), by_word[at])]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    scored = Table(rows.mapInArrow(lean(run), kinds))
    # what followed each key: the most frequent word (of ties the smallest hash), how often, and all together
    rank = F.col("n") + (F.col("nxt") / F.lit(-(2.0**64)) + 0.5)
    memory = corpus.where("word is null and ctx is not null").groupBy(F.col("ctx").alias("_ctx")).agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("nxt", rank).alias("top"))
    met = scored.df.select("row", "held_out", F.explode(F.arrays_zip("ctx", "nxt", "lp")).alias("x")).select("row", "held_out", "x.*").join(memory, F.col("ctx") == F.col("_ctx"))
    itself = F.when(F.col("held_out"), 0).otherwise(1)
    same = F.col("nxt") == F.col("top")
    left = F.col("all") - itself
    mass = F.when(left > 0, F.greatest(F.lit(0.0), F.col("most") - F.when(same, itself).otherwise(0) - discount) / left).otherwise(0.0)
    gain = F.log10(F.when(same, mass).otherwise(0.0) + (1 - mass) * F.pow(F.lit(10.0), "lp")) - F.col("lp")
    tail = scored.df.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", "x.*").join(words.select("_key", "n"), F.col("rare") == F.col("_key"), "left")
    c = F.coalesce("n", F.lit(0))
    none = F.lit(0)
    rest = tail.select("row", (F.col("times") * (F.log10(c + 0.5) - F.lit(float(bottom)))).alias("more"), F.when(c > 0, F.col("times")).otherwise(0).alias("more_known"), none.cast("double").alias("gain"))
    rest = rest.union(met.select("row", none.cast("double"), none, gain)).groupBy(F.col("row").alias("_row")).agg(*(F.sum(x).alias(x) for x in ("more", "more_known", "gain")))
    out = scored.df.join(rest, F.col("row") == F.col("_row"), "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
