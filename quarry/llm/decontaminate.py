"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, shingle votes, exact similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, small_batches, texts_of

#: A word is a run of ASCII letters, digits or non-ASCII characters, in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words that are worked on at once.
STREAM = 16_384
#: Bits of the table that rules out most shingles of texts before the search among the items' shingles.
SIEVE = 22
_BLOCK = np.uint64(0xFFFF)


class WordHashes(dict):
    """XXH64 of words, remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 9)
        return h


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode())


def grid_size(n: int, step: int) -> int:
    """The window size that stands for items of n words: n down to a multiple of `step`, of n/16 beyond 16 steps."""
    step = max(step, 1 << max(0, (n // 16).bit_length() - 1)) if n > 16 * step else step
    return n if n < step else n // step * step


def add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced counters: plane i holds bit i of 64 counts per element."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x, y = (a[i] if i < len(a) else None), (b[i] if i < len(b) else None)
        if x is None or y is None:
            z = y if x is None else x
            if carry is None:
                out.append(z)
            else:
                out.append(z ^ carry)
                carry = z & carry
        else:
            half = x ^ y
            if carry is None:
                out.append(half)
                carry = x & y
            else:
                out.append(half ^ carry)
                carry = (x & y) | (half & carry)
    if carry is not None and carry.any():
        out.append(carry)
    return out


def over(planes: list[np.ndarray], limit: int) -> np.ndarray:
    """Bits whose count is over `limit`."""
    more = np.zeros_like(planes[0])
    same = ~more
    for i in reversed(range(max(len(planes), limit.bit_length()))):
        plane = planes[i] if i < len(planes) else np.zeros_like(planes[0])
        if limit >> i & 1:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return more


def window_prints(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, ascending, the SimHash of each window of so many words: a bit is 1 if over half the words' hashes have it.

    Counts of all windows are held bit-sliced, so one operation serves 64 bits; a window is the sum of power-of-two ones.
    """
    doubled = {0: [hashes]}
    now: list[np.ndarray] = []
    size = 0
    for target in sizes:
        if target > len(hashes):
            return
        more = target - size
        for k in reversed(range(more.bit_length())):
            if not more >> k & 1:
                continue
            for j in range(1, k + 1):
                if j not in doubled:
                    half, far = doubled[j - 1], 1 << (j - 1)
                    n = len(half[0]) - far
                    doubled[j] = add([p[:n] for p in half], [p[far : far + n] for p in half])
            piece = doubled[k]
            n = len(hashes) - size - (1 << k) + 1
            tail = [p[size : size + n] for p in piece]
            now = add([p[:n] for p in now], tail) if size else [p[:n] for p in piece]
            size += 1 << k
        yield target, over(now, target // 2)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` words."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Items:
    """A block of benchmark items, by window size: fingerprints, tables of block values within reach, and word hashes.

    votes: by shingle size, a sieve, the items' different shingle hashes, where each one's items start, and the items.
    """

    radius: int
    shingle: int
    least: float
    words: list[np.ndarray]
    ids: list[int | None]
    sizes: dict[int, list[int]]
    prints: dict[int, np.ndarray]
    near: dict[int, np.ndarray]
    votes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]], radius: int, step: int, shingle: int, least: float) -> Items:
        words, ids, sizes = [], [], {}
        hashes = WordHashes()
        for item, text in rows:
            found = words_of(text)
            if found:
                sizes.setdefault(grid_size(len(found), step), []).append(len(words))
                words.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
                ids.append(item)
        out = cls(radius, shingle, least, words, ids, dict(sorted(sizes.items())), {}, {}, {})
        for k in sorted({min(shingle, len(w)) for w in words}):
            own = [np.unique(shingle_hashes(w, k)) if min(shingle, len(w)) == k else np.zeros(0, np.uint64) for w in words]
            every, item = np.concatenate(own), np.repeat(np.arange(len(words)), list(map(len, own)))
            order = np.argsort(every, kind="stable")
            known, first = np.unique(every[order], return_index=True)
            sieve = np.zeros(1 << SIEVE, bool)
            sieve[(known >> np.uint64(64 - SIEVE)).astype(np.intp)] = True
            out.votes[k] = (sieve, known, np.append(first, len(every)), item[order])
        flips = [np.uint16(0)]
        reach = radius // 4  # the pigeonhole: within the radius, one of four blocks differs in at most so many bits
        for _ in range(reach):
            flips = sorted({np.uint16(f ^ np.uint16(1 << b)) for f in flips for b in range(16)} | set(flips))
        for size, members in out.sizes.items():
            fps = np.array([next(window_prints(words[m][:size], [size]))[1][0] for m in members], np.uint64)
            out.prints[size] = fps
            table = np.zeros((4, 65_536), bool)
            for k in range(4):
                block = ((fps >> np.uint64(16 * k)) & _BLOCK).astype(np.uint16)
                table[k][(block[:, None] ^ np.array(flips, np.uint16)[None, :]).ravel()] = True
            out.near[size] = table
        return out

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(position, item) whose window fingerprints are within the radius; ends: of the text, for each word."""
        out = []
        for size, prints in window_prints(hashes, list(self.sizes)):
            table = self.near[size]
            maybe = table[0][(prints & _BLOCK).astype(np.intp)]
            for k in range(1, 4):
                maybe |= table[k][((prints >> np.uint64(16 * k)) & _BLOCK).astype(np.intp)]
            at = np.flatnonzero(maybe)
            at = at[at + size <= ends[at]]
            for m, fp in zip(self.sizes[size], self.prints[size], strict=True):
                out += [(p, m) for p in at[np.bitwise_count(prints[at] ^ fp) <= self.radius].tolist()]
        return out

    def places(self, hashes: np.ndarray, ends: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, words, item) of the best passage of each text and item with a similarity of at least `least`.

        A passage that similar holds so large a share of the item's shingles, so texts with fewer votes for an item are
        out; of the others all passages are tried that start and end with one of its shingles, as the best one does.
        """
        for k, (sieve, known, first, item) in self.votes.items():
            prints = shingle_hashes(hashes, k)
            at = np.flatnonzero(sieve[(prints >> np.uint64(64 - SIEVE)).astype(np.intp)])
            at = at[at + k <= ends[at]]
            u = np.minimum(np.searchsorted(known, prints[at]), len(known) - 1)
            same = known[u] == prints[at]
            at, u = at[same], u[same]
            n = first[u + 1] - first[u]
            pos = np.repeat(at, n)
            members = item[np.repeat(first[u] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            order = np.lexsort((pos, members, which[pos]))
            pos, members = pos[order], members[order]
            cut = np.flatnonzero(np.diff(members, prepend=-1) | np.diff(which[pos], prepend=-1))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(pos)][: len(cut)], strict=True):
                m = int(members[lo])
                if hi - lo >= self.least * (len(self.words[m]) - k + 1):
                    best = self.best_passage(pos[lo:hi].tolist(), prints[pos[lo:hi]].tolist(), m, k)
                    if best:
                        yield best[0], best[1] + k - 1, m

    def best_passage(self, pos: list[int], prints: list[int], m: int, k: int) -> tuple[int, int] | None:
        """Start and shingles of the passage most similar to item m, the first of equals, given where its shingles stand.

        Shorter items than a shingle are met by passages of their own length only.
        """
        need = Counter(shingle_hashes(self.words[m], k).tolist())
        total = sum(need.values())
        reach = int(total / self.least + 1e-9) if k == self.shingle else 1
        best, found = 0.0, None
        held, inter, j = Counter(), 0, 0
        for i, start in enumerate(pos):
            while j < len(pos) and pos[j] < start + reach:  # what any passage from here can hold at most
                held[prints[j]] += 1
                inter += held[prints[j]] <= need[prints[j]]
                j += 1
            if inter / total > best and inter >= self.least * total - 1e-9:
                seen, common = Counter(), 0
                for q in range(i, j):
                    seen[prints[q]] += 1
                    common += seen[prints[q]] <= need[prints[q]]
                    s = common / (pos[q] - start + 1 + total - common)
                    if s > best:
                        best, found = s, (start, pos[q] - start + 1)
            inter -= held[prints[i]] <= need[prints[i]]
            held[prints[i]] -= 1
        return found if best >= self.least else None

    def similarity(self, window: np.ndarray, m: int) -> float:
        """Weighted Jaccard similarity of the shingles of a window and of item m, weighted by how often each occurs."""
        a, b = self.shingles(window), self.shingles(self.words[m])
        union = sum((a | b).values())
        return sum((a & b).values()) / union if union else 0.0

    def shingles(self, words: np.ndarray) -> Counter:
        k = min(self.shingle, len(words))
        raw = words.tobytes()
        return Counter(raw[8 * i : 8 * (i + k)] for i in range(len(words) - k + 1)) if k else Counter()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 6, step: int = 4, block_items: int = 2048) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity of each document and benchmark item that it holds.

    Each window of an item's size (words, down to a multiple of `step`) gets a SimHash of its words. Four 16-bit blocks
    find all windows within `radius` bits of an item of that size; beside them, texts are tried that hold enough of an
    item's `shingle`-word shingles, whatever the passage's length, also where the text ends within it. The weighted
    Jaccard similarity of the item's and the passage's shingles decides exactly; no passage at `similarity` or more is
    lost. The best passage is returned, the first of equals.

    Items are a query set: they are gathered in blocks of at most `block_items`, and each block is held against all
    documents. Null or empty texts and items without words match nothing; an item shorter than a shingle is held word
    for word; repeated rows each give their rows; item_id may be null or repeat. Texts are read whole. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])
    kinds = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], kinds)
    for items in item_blocks(benchmark, similarity, shingle, radius, step, block_items):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = found_in(items, cache, texts_of(batch.column("text")))
                cols = list(zip(*found, strict=True)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in cols[0]], pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols[1:], list(schema)[1:], strict=True))], schema=schema)

        out = out.union(texts.mapInArrow(lean(run), kinds))
    return out


def matches(items: Items, cache: WordHashes, stream: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, int, int, float]]:
    """(text, item, start word, words, similarity) of the items that a run of texts holds, at the best place of each."""
    sizes = [len(w) for _, w in stream]
    hashes = np.fromiter((cache[x] for _, w in stream for x in w), np.uint64, sum(sizes))
    if not len(hashes):
        return []
    ends = np.cumsum(sizes)
    end_of, which = np.repeat(ends, sizes), np.repeat(np.arange(len(sizes)), sizes)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    spans = [(p, min(len(items.words[m]), int(end_of[p]) - p), m) for p, m in items.candidates(hashes, end_of)]
    for p, n, m in [*spans, *items.places(hashes, end_of, which)]:
        s = items.similarity(hashes[p : p + n], m)
        t = int(which[p])
        start = p - int(ends[t] - sizes[t])
        if s >= items.least and ((t, m) not in best or (s, -start) > (best[t, m][0], -best[t, m][1])):
            best[t, m] = (s, start, n)
    return [(stream[t][0], items.ids[m], start, n, s) for (t, m), (s, start, n) in sorted(best.items())]


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 6, step: int = 4, block_items: int = 2048) -> DataFrame:
    """The rows of docs whose text holds no benchmark item (see contaminated), as they stand, repeated ones too.

    A null or empty text holds none. Texts are held against the items in place, nothing is shuffled; any columns,
    whatever their names, are kept.
    """
    small_batches(docs.sparkSession)
    out = docs
    for items in item_blocks(benchmark, similarity, shingle, radius, step, block_items):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            cache = WordHashes()
            for batch in batches:
                hit = {i for i, *_ in found_in(items, cache, texts_of(batch.column("text")))}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        out = out.mapInArrow(lean(run), docs.schema)
    return out


def item_blocks(benchmark: DataFrame, similarity: float, shingle: int, radius: int, step: int, block_items: int) -> Iterator[Items]:
    """The items in blocks of about `block_items`, dealt by hash."""
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n_blocks = max(1, -(-named.count() // block_items))
    for block in range(n_blocks):
        rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        items = Items.of(sorted(((r["item_id"], r["text"].encode()) for r in rows.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), radius, step, shingle, similarity)
        if items.ids:
            yield items


def found_in(items: Items, cache: WordHashes, texts: list[bytes]) -> list[tuple[int, int, int, int, float]]:
    """What matches() finds in all texts, in streams of about STREAM words."""
    found, stream, n = [], [], 0
    for i, text in enumerate(texts):
        words = words_of(text)
        stream.append((i, words))
        n += len(words)
        if n >= STREAM or i == len(texts) - 1:
            found += matches(items, cache, stream)
            stream, n = [], 0
    return found
