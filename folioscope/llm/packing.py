"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts are tokenised and packed in pools of bounded size inside their input partition, so nothing is
shuffled. A segment tree over capacities finds the fullest row that still has room.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textvec import slices

#: Fixed value: the pattern that splits text for the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 2048
POOL_TOKENS = 1 << 21


class Capacities:
    """A segment tree that tells which remaining capacities some row has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = self.size + capacity
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) with the least capacity of at least need."""
        i = self.size + need
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.tree[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of item numbers; every item has at most `length` tokens; ties keep their order."""
    tree, rows = Capacities(length), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.take(size)
        if found is None:
            found = (length, len(rows))
            rows.append([])
        rows[found[1]].append(item)
        tree.add(found[0] - size, found[1])
    return rows


def pack(tokens: list[np.ndarray], length: int, pad: int, kind) -> tuple[np.ndarray, list[list[int]], list[list[int]], list[list[int]]]:
    """The id matrix, and for each row the texts, piece numbers and cumulative segment lengths.

    A text over `length` is cut into full rows and a rest; its pieces are numbered from 0.
    """
    own, piece, data = [], [], []
    for i, t in enumerate(tokens):
        for k in range(0, max(1, -(-len(t) // length))):
            own.append(i)
            piece.append(k)
            data.append(t[k * length : (k + 1) * length])
    rows = best_fit_decreasing(np.array([len(d) for d in data], np.int64), length)
    out = np.full((len(rows), length), pad, kind)
    cum = []
    for r, items in enumerate(rows):
        at = [0]
        for i in items:
            out[r, at[-1] : at[-1] + len(data[i])] = data[i]
            at.append(at[-1] + len(data[i]))
        cum.append(at)
    return out, [[own[i] for i in r] for r in rows], [[piece[i] for i in r] for r in rows], cum


def load_ranks(path: str) -> tuple[str, dict[bytes, int]]:
    """A digest of the rank file, and its ranks."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def tokenizer(digest: str, ranks: dict[bytes, int]):
    """A tiktoken encoder, kept by its file's digest for the life of a Python worker."""
    import tiktoken

    held = vars(tiktoken).setdefault("_encoders_by_digest", {})
    if digest not in held:
        held[digest] = tiktoken.Encoding(digest, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[digest]


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 50256, pad_id: int = 50256, pool_tokens: int = POOL_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pool, row, input_ids, n_tokens, ids, pieces, cu_seqlens, position_resets): the packed rows.

    input_ids: `length` little-endian ids of 2 bytes (4 from 65,536 ids on), filled with pad_id
    after n_tokens. cu_seqlens: cumulative segment lengths from 0; position ids restart at 0 at each
    of position_resets. ids and pieces name each segment's text and which piece of it it is, so
    texts can be put together again without loss. Each text ends with end_id; null and empty texts
    are that token alone. vocabulary: path of a rank file, read on the driver only; its ranks are broadcast,
    and executors need tiktoken. Repeated rows and ids are packed as often as they occur.
    """
    digest, ranks = load_ranks(vocabulary)
    kind = np.dtype("<u2") if max(len(ranks), end_id + 1, pad_id + 1) <= 1 << 16 else np.dtype("<u4")
    sent = docs.sparkSession.sparkContext.broadcast((digest, ranks))

    def run(batches):
        encode = tokenizer(*sent.value).encode_ordinary
        part_id = (TaskContext.get() and TaskContext.get().partitionId()) or 0
        ids, tokens, held, pool = [], [], 0, 0

        def flush():
            matrix, own, pieces, cum = pack(tokens, length, pad_id, kind)
            for a in range(0, len(matrix), 256):
                b = min(len(matrix), a + 256)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part_id << 32 | pool] * (b - a), pa.int64()), pa.array(range(a, b), pa.int32()), pa.array([m.tobytes() for m in matrix[a:b]], pa.binary()), pa.array([c[-1] for c in cum[a:b]], pa.int32()),
                        pa.array([[ids[i] for i in o] for o in own[a:b]], pa.list_(id_type)), pa.array(pieces[a:b], pa.list_(pa.int32())), pa.array(cum[a:b], pa.list_(pa.int32())), pa.array([c[:-1] for c in cum[a:b]], pa.list_(pa.int32())),
                    ],
                    ["pool", "row", "input_ids", "n_tokens", "ids", "pieces", "cu_seqlens", "position_resets"],
                )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch, text_col):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = np.array([*encode(text or ""), end_id], kind)
                    ids.append(i)
                    tokens.append(t)
                    held += len(t)
                    if held >= pool_tokens:
                        yield from flush()
                        ids, tokens, held, pool = [], [], 0, pool + 1
        if tokens:
            yield from flush()

    id_kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"pool long, row int, input_ids binary, n_tokens int, ids array<{id_kind}>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>")
