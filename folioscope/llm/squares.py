"""Token sequences packed by the sum of squares.

Texts are tokenised where they are read; then only piece lengths, with or without the ids, are dealt
evenly into pools of bounded size, and each pool is packed in one task. There every piece, longest
first, goes to the open sequence for which the sum over residual gaps of the squared number of open
sequences with that gap becomes smallest. A new sequence is opened only where no open one has room.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .packing import PATTERN
from .textvec import slices

LENGTH = 2048
#: Pieces a pool is made for.
POOL_ROWS = 16_384


class Gaps:
    """Open sequences by residual gap; place() puts a piece where the sum of squared counts becomes smallest."""

    def __init__(self, length: int):
        self.length, self.opened = length, 0
        self.open: list[list[int]] = [[] for _ in range(length + 1)]
        # twice each gap's count; a full sequence leaves the sum, so gap 0 stands half a sequence lower
        self.twice = np.zeros(length + 1, np.int64)
        self.twice[0] = -1

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to length tokens.

        Moving a sequence from gap g to g - size changes the sum by 2 (n[g - size] - n[g] + 1), or by
        1 - 2 n[g] where it becomes full; of equal changes the smallest gap is taken.
        """
        gain = np.where(self.twice[size:] > 0, self.twice[size:] - self.twice[: self.length + 1 - size], np.iinfo(np.int64).min)
        at = int(gain.argmax())
        if self.twice[size + at] > 0:
            gap = size + at
            sequence = self.open[gap].pop()
            self.twice[gap] -= 2
        else:
            gap, sequence = self.length, self.opened
            self.opened += 1
        if gap > size:
            self.open[gap - size].append(sequence)
            self.twice[gap - size] += 2
        return sequence, self.length - gap


def pack(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces of full length have sequences of their own."""
    gaps, sequence, offset = Gaps(length), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        sequence[i], offset[i] = gaps.place(int(sizes[i]))
    return sequence, offset


def byte_names() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def ranks_of(text: str) -> dict[bytes, int] | None:
    """The ranks of a byte-level vocabulary file, if it splits text by PATTERN and merges in the order of ids."""
    d = json.loads(text)
    model, split = d["model"], d["pre_tokenizer"] or {}
    plain = d["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not model.get("ignore_merges")
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(m, -1) for m in merged]
    names = byte_names()
    if not plain or ids != sorted(set(ids)) or not set(names) <= set(model["vocab"]):
        return None
    return {bytes(names[c] for c in word): model["vocab"][word] for word in [*names, *merged]}


#: Beyond these characters the two libraries may class letters by different editions of Unicode.
LATIN = "[^\\x00-\\u024f]"


def encoder(digest: str, text: str, ranks: dict[bytes, int] | None):
    """A function from a text to its ids, kept by its file's digest for the life of a Python worker.

    Special tokens' strings are ordinary text. Texts of Latin letters take a faster library with the
    same vocabulary and merges, where the file has ranks; others the file's own.
    """
    import tiktoken
    import tokenizers

    held = vars(tokenizers).setdefault("_encoders_by_digest", {})
    if digest not in held:
        exact = tokenizers.Tokenizer.from_str(text)
        exact.encode_special_tokens = True
        fast = ranks and tiktoken.Encoding(digest, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        foreign = re.compile(LATIN)

        def encode(t: str) -> list[int]:
            return exact.encode(t, add_special_tokens=False).ids if not fast or foreign.search(t) else fast.encode_ordinary(t)

        held[digest] = encode
    return held[digest]


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces, and their ids where asked for.

    A document is its text's ids and then end_id; null and empty texts are end_id alone. Only one of
    over `length` ids is cut, into pieces of that length; the first takes what is left over.
    ids_crc32: of the ids as unsigned little-endian 32-bit numbers. vocabulary: path of a file of the
    library tokenizers, read on the driver only and broadcast. No shuffle.
    """
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text, ranks_of(text)))

    def run(batches):
        encode = encoder(*sent.value)
        for batch in batches:
            for part in slices(batch, text_col):
                own, number, start, size, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    tokens = np.array([*encode(t or ""), end_id], "<u4")
                    cut = [0, *range(len(tokens) % length or length, len(tokens) + 1, length)]
                    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                        own.append(i)
                        number.append(k)
                        start.append(a)
                        size.append(b - a)
                        crc.append(zlib.crc32(tokens[a:b].tobytes()))
                        if with_ids:
                            ids.append(tokens[a:b].astype(np.int32))
                columns = [part.column(0).take(pa.array(own, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))] if with_ids else columns, [*names, "ids"] if with_ids else names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def pack_squares(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 0, with_ids: bool = False, pool_rows: int = POOL_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece: see pieces(); with its ids where asked for.

    Pieces of one sequence lie side by side from offset 0 and fill at most `length`. Pools hold about
    pool_rows pieces, so a task's memory is bounded by them; each may leave its last sequences unfilled. Pieces are
    dealt to pools in turn, so neither copies nor rows under one id or none meet in one task; repeated
    rows are packed as often as they occur. An empty table gives an empty result.
    """
    rows = common.cut(pieces(docs, vocabulary, length, end_id, with_ids, id_col, text_col), "pieces")
    n_pools = max(1, math.ceil(rows.count() / pool_rows))

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        sequence, offset = pack(table["length"].to_numpy(), length)
        pool = TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(pool + sequence)).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=4096)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.repartition(n_pools).mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, input_ids, ids, pieces, cu_seqlens): one row a sequence of pack_squares(..., with_ids=True); cu_seqlens from 0."""
    own = F.array_sort(F.collect_list(F.struct("offset", F.col(id_col).alias("id"), "piece", "length", F.col("ids").alias("tokens")))).alias("own")  # at most `length` pieces
    rows = packed.groupBy("sequence_id").agg(own)
    ends = F.transform("own", lambda x: (x["offset"] + x["length"]).cast("int"))
    return rows.select("sequence_id", F.flatten("own.tokens").alias("input_ids"), F.col("own.id").alias("ids"), F.col("own.piece").alias("pieces"), F.concat(F.array(F.lit(0)), ends).alias("cu_seqlens"))
