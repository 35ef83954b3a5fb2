"""Subword encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import expanded, lean, small_batches, texts_of, trim

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁".encode()
#: Distinct words that a task remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 300_000, 1 << 24
#: Words of more bytes are cut where no piece reaches over; starts in a long word that are followed at once.
LONG, STARTS = 512, 1 << 18
# Kinds of pieces in the model file, fixed by its format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
# The type of a model without one of its own; field 3 of field 2 has it.
UNIGRAM = 1


def read_pieces(raw: bytes) -> tuple[list[tuple[bytes, float, int]], int]:
    """(piece, score, kind) by id, and the model's type, from the bytes of a SentencePiece model file (a protocol buffer; field
    1 repeats)."""

    def varint(b: bytes, i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if b[i - 1] < 128:
                return out, i

    def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
        i = 0
        while i < len(b):
            tag, i = varint(b, i)
            if tag & 7 == 0:
                value, i = varint(b, i)
            else:
                n, i = varint(b, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
                value, i = b[i : i + n], i + n
            yield tag >> 3, value

    out, model_type = [], UNIGRAM
    for number, value in fields(raw):
        if number == 2:
            model_type = dict(fields(value)).get(3, UNIGRAM)
        elif number == 1:
            piece = dict(fields(value))
            out.append((piece.get(1, b""), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return out, model_type


def log_scores(pieces: list[tuple[bytes, float, int]], model_type: int) -> np.ndarray:
    """Log scores: as they stand in a unigram model, by Zipf's rule, -ln(2 + rank), in one of byte pairs, whose scores are negated
    ranks."""
    raw = np.array([s for _, s, _ in pieces])
    return raw if model_type == UNIGRAM else -np.log(2 + np.maximum(0, -raw))


@dataclass
class Trie:
    """A double array over bytes: from node s byte c leads to t = base[s] + c + 1 if check[t] == s; value[t]: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, entries: dict[bytes, int]) -> Trie:
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, i in entries.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][c]
            ids[node] = i
        size = 2 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        queue, free = [(0, 0)], 1
        for node, slot in queue:  # grows while it is read: breadth first
            codes = sorted(children[node])
            if not codes:
                continue
            while used[free]:
                free += 1
            at, tried = free, 0
            while True:
                start = at - codes[0] - 1
                if start >= 0 and not used[at] and not any(used[start + c + 1] for c in codes):
                    break
                at, tried = at + 1, tried + 1
                if at + 300 >= len(used):
                    more = len(used)
                    used += bytearray(more)
                    base, check, value = (np.concatenate([a, np.full(more, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
            if tried > 64:  # the slots before are nearly all taken; leave the rest of them
                free = at
            base[slot] = start
            for c in codes:
                t = start + c + 1
                used[t], check[t] = 1, slot
                value[t] = ids[children[node][c]]
                queue.append((children[node][c], t))
        return cls(np.pad(base, (0, 300)), np.pad(check, (0, 300), constant_values=-1), np.pad(value, (0, 300), constant_values=-1))


@dataclass
class Codec:
    """Pieces with log scores; a character that no piece covers costs 10 more than the worst piece and becomes byte pieces."""

    pieces: list[bytes]
    scores: np.ndarray
    trie: Trie
    bytes_at: np.ndarray
    control: frozenset[int]
    fallback: float
    _memory: dict[bytes, int] = field(default_factory=dict)
    _held: int = 0

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Codec:
        with open(path, "rb") as f:
            found, model_type = read_pieces(f.read())
        scores = log_scores(found, model_type)
        entries = {p: i for i, (p, _, k) in enumerate(found) if k in (NORMAL, USER) and p}
        bytes_at = np.full(256, next((i for i, x in enumerate(found) if x[2] == UNKNOWN), 0), np.int32)
        pieces = []
        for i, (p, _, k) in enumerate(found):
            if k == BYTE:
                code = int(p[3:5], 16)
                bytes_at[code] = i
                p = bytes([code])
            elif k in (NORMAL, USER):
                p = p.replace(MARKER, b" ")
            pieces.append(p)
        trie = Trie.of(entries)
        trim()  # of the nodes from which the array was made
        control = frozenset(i for i, x in enumerate(found) if x[2] in (CONTROL, UNKNOWN))
        return cls(pieces, scores, trie, bytes_at, control, float(min(scores[i] for i in entries.values())) - 10)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}}

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best piece ids of all words in one array, and how many each word has; all words advance together.

        Of equally good ways the one found first stays: the longer last piece loses against the earlier start.
        """
        ids: list[np.ndarray] = [self._long(w) if len(w) > LONG else np.zeros(0, np.int32) for w in words]
        order = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e - s + 1) * len(words[order[e]]) <= 1 << 20 and len(words[order[e]]) <= 2 * len(words[order[s]]) + 8:
                e += 1
            flat, counts = self._lockstep([words[i] for i in order[s:e]])
            for i, part in zip(order[s:e], np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                ids[i] = part
            s = e
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _matches(self, text: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces that start at lo..hi-1 of a text, by start and then end."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        at, node, k = np.arange(lo, hi), np.zeros(hi - lo, np.int32), 0
        starts, ends, pieces = [], [], []
        while len(at):
            at, node = at[at + k < len(text)], node[at + k < len(text)]
            t = base[node] + text[at + k] + 1
            ok = check[t] == node
            at, node, k = at[ok], t[ok], k + 1
            end = np.flatnonzero(value[node] >= 0)
            starts.append(at[end])
            ends.append(at[end] + k)
            pieces.append(value[node[end]])
        start, stop, piece = map(np.concatenate, (starts, ends, pieces))
        order = np.lexsort((stop, start))
        return start[order], stop[order], piece[order]

    def _long(self, word: bytes) -> np.ndarray:
        """Best piece ids of a long word, cut where no piece reaches over: the ways before and after such a place are independent.

        Short parts advance together as words do; a part without such a place is worked through byte by byte, in time in
        proportion to the pieces that it holds.
        """
        text = np.frombuffer(word, np.uint8)
        first = (text & 0xC0) != 0x80
        reach, out, begin = 0, [], 0
        parts: list[bytes] = []
        for lo in range(0, len(text), STARTS):
            hi = min(len(text), lo + STARTS)
            start, stop, _ = self._matches(text, lo, hi)
            over = np.arange(lo, hi) + 1
            np.maximum.at(over, start - lo, stop)
            before = np.maximum.accumulate(np.concatenate([[reach], over]))  # how far pieces reach that start before each place
            cuts = lo + np.flatnonzero((before[:-1] <= np.arange(lo, hi)) & first[lo:hi])
            reach = int(before[-1])
            for c in cuts.tolist():
                if c > begin:
                    parts.append(word[begin:c])
                    begin = c
        parts.append(word[begin:])
        short = [p for p in parts if len(p) <= LONG]
        flat, counts = self.segment(short)
        ready = iter(np.split(flat, np.cumsum(counts)[:-1]) if short else [])
        for p in parts:
            out.append(next(ready) if len(p) <= LONG else self._bytewise(p))
        return np.concatenate(out)

    def _bytewise(self, word: bytes) -> np.ndarray:
        """Best piece ids of one word, place by place; only what the longest piece reaches over is held besides back pointers."""
        text, size = np.frombuffer(word, np.uint8), len(word)
        best, back, kind = np.full(size + 1, -np.inf).tolist(), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for lo in range(0, size, STARTS):
            hi = min(size, lo + STARTS)
            start, stop, piece = self._matches(text, lo, hi)
            first = np.searchsorted(start, np.arange(lo, hi + 1)).tolist()
            stop, piece, score = stop.tolist(), piece.tolist(), self.scores[piece].tolist()
            for s in range(lo, hi):
                now = best[s]
                if now == -np.inf:
                    continue
                lead = word[s]
                alone = min(s + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), size)
                for m in range(first[s - lo], first[s - lo + 1]):
                    e = stop[m]
                    if e == alone:
                        alone = 0
                    if now + score[m] > best[e]:
                        best[e], back[e], kind[e] = now + score[m], s, piece[m]
                if alone and now + self.fallback > best[alone]:
                    best[alone], back[alone], kind[alone] = now + self.fallback, s, -1
        ids, e = [], size
        while e:
            s = back[e]
            ids += [kind[e]] if kind[e] >= 0 else self.bytes_at[text[s:e][::-1]].tolist()
            e = s
        return np.array(ids[::-1], np.int32)

    def _lockstep(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        size = np.array([len(w) for w in words])
        m, width = len(words), int(size.max()) if len(size) else 0
        text = np.zeros((m, width + 1), np.uint8)
        for i, w in enumerate(words):
            text[i, : len(w)] = np.frombuffer(w, np.uint8)
        best = np.full((m, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((m, width + 1), np.int32), np.full((m, width + 1), -1, np.int32)
        for s in range(width):
            live = np.flatnonzero((size > s) & np.isfinite(best[:, s]))
            if not len(live):
                continue
            lead = text[live, s]
            step = np.minimum(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), size[live] - s)
            alone = np.ones(len(live), bool)
            node, rows, place, k = np.zeros(len(live), np.int32), live, np.arange(len(live)), 0
            while len(rows):
                t = base[node] + text[rows, s + k] + 1
                ok = (check[t] == node) & (size[rows] > s + k)
                rows, node, place, k = rows[ok], t[ok], place[ok], k + 1
                if not len(rows):
                    break
                found = value[node]
                end = np.flatnonzero(found >= 0)
                if len(end):
                    alone[place[end[step[place[end]] == k]]] = False
                    r, score = rows[end], best[rows[end], s] + scores[found[end]]
                    better = score > best[r, s + k]
                    r, end = r[better], end[better]
                    best[r, s + k], start[r, s + k], piece[r, s + k] = score[better], s, found[end]
                if s + k > width:
                    break
            r, to = live[alone], s + step[alone]
            score = best[r, s] + self.fallback
            better = score > best[r, to]
            r, to = r[better], to[better]
            best[r, to], start[r, to], piece[r, to] = score[better], s, -1
        who, begin, stop, kind = [], [], [], []
        at = size.copy()
        rows = np.flatnonzero(at > 0)
        while len(rows):
            who.append(rows)
            stop.append(at[rows])
            kind.append(piece[rows, at[rows]])
            at[rows] = start[rows, at[rows]]
            begin.append(at[rows])
            rows = rows[at[rows] > 0]
        if not who:
            return np.zeros(0, np.int32), np.zeros(m, np.int64)
        who, begin, stop, kind = map(np.concatenate, (who, begin, stop, kind))
        order = np.lexsort((begin, who))
        who, begin, stop, kind = who[order], begin[order], stop[order], kind[order]
        item, nth = expanded(np.where(kind < 0, stop - begin, 1))
        ids = np.where(kind[item] < 0, self.bytes_at[text[who[item], begin[item] + nth]], kind[item])
        return ids.astype(np.int32), np.bincount(who[item], minlength=m)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Piece ids of each text: blanks become markers, one is set in front; pieces hold a marker only at their start,
        so that each run of markers with the word after it is encoded on its own, once."""
        split = []
        for text in texts:
            line = MARKER + text.replace(b" ", MARKER) if text else b""
            parts = line.split(MARKER)
            out, pending = ([parts[0]] if parts[0] else []), b""
            for part in parts[1:]:
                pending += MARKER
                if part:
                    out.append(pending + part)
                    pending = b""
            if pending:
                out.append(pending)
            split.append(out)
        memory = self._memory
        new = list({w: None for words in split for w in words if w not in memory})
        if len(memory) + len(new) > REMEMBERED or self._held + sum(map(len, new)) > REMEMBERED_BYTES:
            memory.clear()
            new = list({w: None for words in split for w in words})
        if not memory:
            self._held = 0
            self._flat, self._at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        if new:
            flat, counts = self.segment(new)
            for w in new:
                memory[w] = len(memory)
            self._held += sum(map(len, new))
            self._flat = np.concatenate([self._flat, flat])
            self._at = np.concatenate([self._at, self._at[-1] + np.cumsum(counts)])
        out = []
        for words in split:
            codes = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
            item, nth = expanded(self._at[codes + 1] - self._at[codes])
            out.append(self._flat[self._at[codes][item] + nth])
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The text of piece ids: bytes of pieces and byte pieces joined, markers as blanks, the blank in front dropped.

        Control and unknown pieces have no text; ids outside the vocabulary are an error.
        """
        joined = b"".join([self.pieces[i] if i not in self.control else b"" for i in ids] if self.control.intersection(ids) else map(self.pieces.__getitem__, ids))
        return joined[1:] if joined[:1] == b" " else joined


_IDS, _TEXT = T.ArrayType(T.IntegerType()), T.StringType()


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """docs with ids array<int>: the pieces of the whole text; null for a null text, empty for an empty one.

    Other columns pass through; a column named ids is replaced.
    """
    return _with_columns(docs, [("text", "ids", _IDS, lambda column: _encoded(column, codec))])


def decode(docs: DataFrame, codec: Codec) -> DataFrame:
    """docs with decoded: the text of ids; null for null ids. A marker character in a text comes back as a blank."""
    return _with_columns(docs, [("ids", "decoded", _TEXT, lambda column: _decoded(column, codec))])


def encode_and_decode(docs: DataFrame, codec: Codec) -> DataFrame:
    """docs with ids and decoded, in one pass over the texts."""
    return _with_columns(docs, [("text", "ids", _IDS, lambda column: _encoded(column, codec)), ("ids", "decoded", _TEXT, lambda column: _decoded(column, codec))])


def _encoded(column: pa.Array, codec: Codec) -> pa.Array:
    out: list = []
    texts = texts_of(column)
    size = np.cumsum([0, *map(len, texts)])
    s = 0
    while s < len(texts):  # runs of about 1 MB, so that what a run adds to memory is bounded
        e = max(s + 1, int(np.searchsorted(size, size[s] + (1 << 20))))
        out += codec.encode(texts[s:e])
        s = e
    flat = np.concatenate([np.zeros(0, np.int32), *out])
    at = np.cumsum([0, *map(len, out)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()), mask=column.is_null())


def _decoded(column: pa.Array, codec: Codec) -> pa.Array:
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return pa.array([None if null else codec.decode(flat[at[i] : at[i + 1]].tolist()).decode("utf-8", "replace") for i, null in enumerate(column.is_null().to_pylist())], pa.string())


def _with_columns(docs: DataFrame, steps: list) -> DataFrame:
    """docs with a column for each (source, target, type, function); later steps may read earlier targets."""
    small_batches(docs.sparkSession)
    targets = [target for _, target, _, _ in steps]
    kept = [f for f in docs.schema.fields if f.name not in targets or f.name in {source for source, *_ in steps[:1]}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {f.name: batch.column(f.name) for f in kept}
            for source, target, _, of in steps:
                made[target] = of(made[source])
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return docs.select(*[f.name for f in kept]).mapInArrow(lean(run), T.StructType([*kept, *(T.StructField(target, kind) for _, target, kind, _ in steps)]))


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_hash and exact (decoding gives the text) of each row; nulls for a null text."""
    bytes_at = sorted({int(i) for i in codec.bytes_at})
    low, high = bytes_at[0], bytes_at[-1]
    done = encode_and_decode(docs.select("doc_id", F.col("text").cast("string").alias("text")), codec)
    n_bytes = F.size(F.filter("ids", lambda i: (i >= low) & (i <= high)))
    return done.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), F.when(F.col("ids").isNotNull(), n_bytes).cast("long").alias("n_byte_pieces"), F.when(F.col("ids").isNotNull(), F.xxhash64("ids")).alias("ids_hash"), (F.col("decoded") == F.col("text")).alias("exact"))

