"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the model can reach across: before a space mark that follows another character, and
around line feeds. Distinct segments are encoded together: one flat numpy array of symbols, the lowest pair rank of
each segment found by a segmented minimum, all leftmost disjoint pairs of that rank merged at once, the array
compacted, until no pair remains. Encoding merges pairs one by one, best first and leftmost on ties, so a segment
merges several pairs in a round only when none of the pairs that this makes would have come before them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import alone, chunks

MARK = "▁"  # fixed value: the model's sign for a space
CACHE_ENTRIES = 200_000
#: A segment with more symbols that can't merge several pairs in a round goes through an agenda instead of rounds.
LONG_SEGMENT = 512
_NONE = np.int64(1) << 40


class Pieces:
    """The tables of one model: symbols of characters, pairs that merge, their ranks, and bytes of pieces."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only byte-fallback BPE models without a normaliser are supported")
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in normal):
            raise ValueError("a piece of this model reaches across words")
        self.size = len(proto.pieces)
        self.eos = next(i for i, p in enumerate(proto.pieces) if p.type == 3 and p.piece == (trainer.eos_piece or "</s>"))
        self.byte0 = next(i for i, p in enumerate(proto.pieces) if p.type == 6)
        self.bytes = [p.piece.replace(MARK, " ").encode() if p.type == 1 else bytes([i - self.byte0]) if p.type == 6 else b"" for i, p in enumerate(proto.pieces)]
        # symbols: a piece's id, or for a character without a piece its code point above all ids
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        scores = np.array([p.score for p in proto.pieces])
        order = np.unique(-scores, return_inverse=True)[1]  # equal scores share a rank
        lefts, rights, made = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                a = normal.get(left, self.size + ord(left) if len(left) == 1 else -1)
                b = normal.get(right, self.size + ord(right) if len(right) == 1 else -1)
                if a >= 0 and b >= 0:
                    lefts.append(a), rights.append(b), made.append(i)
        keys = (np.array(lefts, np.int64) << 22) | np.array(rights, np.int64)
        by = np.argsort(keys)
        self.keys, self.made = keys[by], np.array(made, np.int64)[by]
        self.rank = order.astype(np.int64)[self.made]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; _NONE where it doesn't merge."""
        key = (left << 22) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[at] == key
        return np.where(ok, self.rank[at], _NONE), self.made[at]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Symbols of each word after all merges."""
        out: list = [None] * len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.symbol[code]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(sym):
            rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same], made[same] = self.pairs(sym[same], sym[same + 1])
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(sym)])
            least = np.minimum.reduceat(rank, start)
            done = least == _NONE
            for s, n, w in zip(start[done], size[done], word[start[done]]):
                out[w] = sym[s : s + n]
            least = np.repeat(least, size)
            at = np.flatnonzero((rank == least) & (least < _NONE))
            if not len(at):
                break
            # of overlapping pairs the leftmost, then every other one
            begins = np.r_[True, np.diff(at) != 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            # pairs that each merge makes, with what stands right of it before and left of it after
            merged = made[at]
            sym_after = sym.copy()
            sym_after[at] = merged
            second = np.zeros(len(sym), bool)
            second[at + 1] = True
            right = np.minimum(at + 2, len(sym) - 1)
            made_right = np.where((at + 2 < len(sym)) & (word[right] == word[at]), self.pairs(merged, sym[right])[0], _NONE)
            prev = at - 1
            prev = np.where((prev >= 0) & second[prev], prev - 1, prev)
            made_left = np.where((prev >= 0) & (word[prev] == word[at]), self.pairs(sym_after[prev], merged)[0], _NONE)
            clash = np.minimum(made_right, made_left) <= rank[at]
            if clash.any():
                bad = np.zeros(len(words), bool)
                bad[word[at[clash]]] = True
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                long = np.zeros(len(words), bool)
                long[word[start[size > LONG_SEGMENT]]] = True
                for w in np.flatnonzero(bad & long):
                    out[w] = self.agenda(sym[word == w])
                at = at[~bad[word[at]] | (first & ~long[word[at]])]
                merged = made[at]
                keep = ~(bad & long)[word]
            else:
                keep = np.ones(len(sym), bool)
            sym[at] = merged
            keep[at + 1] = False
            finished = np.repeat(done, size)
            keep &= ~finished
            sym, word = sym[keep], word[keep]
        return out

    def agenda(self, sym: np.ndarray) -> np.ndarray:
        """One long segment, pair by pair: best rank first, leftmost on ties."""
        s, n = sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        heap: list = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < n and (hit := table.get((s[i] << 22) | s[j])):
                heap.append((hit[0], i, j, s[i], s[j], hit[1])) if not ready else heapq.heappush(heap, (hit[0], i, j, s[i], s[j], hit[1]))

        ready = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, j, a, b, made = heapq.heappop(heap)
            if s[i] != a or s[j] != b or after[i] != j:
                continue
            s[i], s[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.array([x for x in s if x >= 0], np.int64)

    def ids(self, symbols: np.ndarray) -> list[int]:
        """Symbols without a piece become the ids of their bytes."""
        out = []
        for x in symbols.tolist():
            if x < self.size:
                out.append(x)
            else:
                out += [self.byte0 + b for b in chr(x - self.size).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes joined, the space in front that encoding adds taken off, control ids silent."""
        text = b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(" ")


_SEGMENT = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def segments(text: str) -> list[str]:
    return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


class Codec(dict):
    """Segment -> (ids as decimals joined by a space, number of ids, bytes of the ids); bounded."""

    def __init__(self, model: bytes):
        super().__init__()
        self.pieces = Pieces(model)

    def learn(self, words: list[str]) -> None:
        if len(self) + len(words) > CACHE_ENTRIES:
            self.clear()
        p = self.pieces
        for w, symbols in zip(words, p.merge(words)):
            ids = p.ids(symbols)
            self[w] = (" ".join(map(str, ids)), len(ids), b"".join([p.bytes[i] for i in ids]))

    def entries(self, texts: list[str]) -> list[list[tuple]]:
        split = [segments(t) for t in texts]
        need = set(chain.from_iterable(split))
        if misses := sorted(need.difference(self)):
            self.learn(misses)
            if not need.issubset(self):
                self.learn(sorted(need.difference(self)))
        get = self.__getitem__
        return [list(map(get, x)) for x in split]


_WORKER: dict[str, Codec] = {}


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array, only with_ids), ids_text (decimals joined by a space), decoded.

    Ids are those of the sentencepiece library with an end id and nothing else added; decoded is the text of the ids.
    Null text counts as empty: the end id alone. Repeated rows give repeated results; other columns are ignored.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # the model file: its size is fixed

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, shared.value)
        for batch in chunks(batches):
            n, ids, text = [], [], []
            for entry in codec.entries([t or "" for t in batch.column(1).to_pylist()]):
                n.append(sum([e[1] for e in entry]) + 1)
                ids.append(" ".join([*[e[0] for e in entry], str(codec.pieces.eos)]))
                text.append(b"".join([e[2] for e in entry]).decode("utf-8", "replace").removeprefix(" "))
            columns = [batch.column(0), pa.array(n, pa.int64())]
            if with_ids:
                columns.append(pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.string()), pa.array(text, pa.string())], names=names)

    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_text", "decoded"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_text string, decoded string")


def _codec(key: str, model: bytes) -> Codec:
    if key not in alone(_WORKER):
        _WORKER.clear()
        _WORKER[key] = Codec(model)
    return _WORKER[key]


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; the digests of encode_decode(), made where the ids are."""
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path, shared.value)
        for batch in chunks(batches):
            n, ids, text = [], [], []
            for entry in codec.entries([t or "" for t in batch.column(1).to_pylist()]):
                n.append(sum([e[1] for e in entry]) + 1)
                ids.append(hashlib.sha256(" ".join([*[e[0] for e in entry], str(codec.pieces.eos)]).encode()).hexdigest())
                decoded = b"".join([e[2] for e in entry]).decode("utf-8", "replace").removeprefix(" ")
                text.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
