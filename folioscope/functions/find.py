"""Which of many short texts stand in long ones, by rolling hashes in tasks; what they find is joined by the texts themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Odd numbers; each gives a place in the bit table.
PROBES = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: About so many characters are looked at together; each length that short texts have is a step of its own for them.
AT_ONCE = 1 << 18
#: The bit table has 32 bits a short text, but 2^27 (16 MB) at most: with more texts more of what is found is dropped by the join.
MOST_BITS = 27


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = np.full((2, n), [[BASE], [INVERSE]], np.uint64)
    out[:, :1] = 1
    return tuple(np.cumprod(out, axis=1))


def places(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (h * np.uint64(probe)) >> np.uint64(64 - bits)


class Rolled:
    """Hashes of any window of some texts: of its characters, its length and a number that goes with its text."""

    def __init__(self, texts: list[str], own: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None = None):
        self.text = "".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.owner, self.n = np.repeat(np.arange(len(texts)), sizes), len(codes)
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes
        self.own = own.astype(np.uint64)[self.owner]
        forth, self.back = known or powers(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * forth[: self.n])])

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        """Of the windows from `at`, each of its length or of one; they are within one text."""
        return (self.sums[at + length] - self.sums[at]) * self.back[at] + self.own[at] + np.asarray(length).astype(np.uint64) * np.uint64(PROBES[1])

    def within(self, at: np.ndarray, length: int) -> np.ndarray:
        at = at[at + length <= self.n]
        return at[self.owner[at] == self.owner[at + length - 1]]

    def every(self, length: int) -> np.ndarray:
        """Hashes of the windows from each place, some of which run over a text's end."""
        k = self.n - length + 1
        if k <= 0:
            return np.zeros(0, np.uint64)
        h = self.sums[length:] - self.sums[:k]
        h *= self.back[:k]
        h += self.own[:k]
        h += np.uint64(length * PROBES[1] & MASK)
        return h


#: Lengths that short texts are first looked for with; short ones stand close, since few characters rule out little.
STEMS = (1, 2, 3, 4, 6, 8, 24)


def stem(length: int, most: int) -> int:
    """The length that texts of a length are first looked for with: the next lower one of STEMS, or most."""
    return length if length == most else max(k for k in STEMS if k <= length)


def _numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _bits(needles: DataFrame, most: int, bits: int) -> np.ndarray:
    """The bit table of needles (own, needle): the places of each and of its stem."""

    def run(batches):
        for batch in batches:
            rolled = Rolled(batch.column(1).to_pylist(), _numbers(batch.column(0)))
            some = rolled.sizes > 0
            starts, sizes = rolled.starts[some], rolled.sizes[some]
            stems = np.array([0, *[stem(n, most) for n in range(1, most + 1)]])[sizes]
            h = np.unique(np.concatenate([rolled.hashes(starts, sizes), rolled.hashes(starts, stems)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([places(h, p, bits) for p in PROBES]).astype(np.int64))], ["place"])

    at = needles.mapInArrow(run, "place long")
    words = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("mask")).toArrow()
    out = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def found_in(texts: DataFrame, needles: DataFrame, key: str, most: int) -> DataFrame:
    """texts (key, text, and others) without text but with needle, a row for each of the key's needles that stands in a text, and for few others.

    needles: distinct (key, needle) of at most `most` characters, written before; an empty one is in every text that isn't null. A null
    key has none. Each text is read once, at the few lengths that needles begin with; of
    repeated needles in a text one row comes out. A join on (key, needle) leaves the right rows.
    """
    own = F.xxhash64(key).alias("_own")
    rows = texts.select(*[c for c in texts.columns if c != "text"], own, "text").where(F.col(key).isNotNull() & F.col("text").isNotNull())
    out = rows.drop("text", "_own")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", needle string"
    counted = needles.groupBy(F.length("needle").alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()  # at most `most` + 1 rows
    lengths = sorted(r["n"] for r in counted if r["n"])
    empty = any(r["n"] == 0 for r in counted)
    if not counted:
        return texts.sparkSession.createDataFrame([], fields)
    bits = min(MOST_BITS, max(10, (32 * sum(r["k"] for r in counted)).bit_length()))
    sent = texts.sparkSession.sparkContext.broadcast(_bits(needles.select(own, "needle"), most, bits))
    stems = {k: [n for n in lengths if stem(n, most) == k] for k in {stem(n, most) for n in lengths}}

    def there(h, table, probe):
        place = places(h, probe, bits)
        return (table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def known(at, h, table, probes=PROBES):
        for p in probes:
            kept = there(h, table, p)
            at, h = at[kept], h[kept]
        return at, h

    def pieces(column) -> Iterator[tuple[int, str]]:
        for i, text in enumerate(column.to_pylist()):
            for a in range(0, max(1, len(text)), AT_ONCE):
                yield i, text[a : a + AT_ONCE + most - 1]

    def search(rows: list[int], texts: list[str], own, table, power) -> Iterator[tuple[int, str]]:
        rolled = Rolled(texts, own[rows], power)
        for k, group in stems.items():
            h = rolled.every(k)
            begun = rolled.within(np.flatnonzero(there(h, table, PROBES[0])), k)
            begun, h = known(begun, h[begun], table, PROBES[1:])
            for n in group:
                at, h_n = begun, h
                if n != k:
                    at = rolled.within(begun, n)
                    at, h_n = known(at, rolled.hashes(at, n), table)
                _, first = np.unique(h_n + rolled.owner[at].astype(np.uint64) * np.uint64(BASE), return_index=True)
                for i in at[first].tolist():
                    yield rows[rolled.owner[i]], rolled.text[i : i + n]

    def run(batches):
        table, power = sent.value, powers(2 * AT_ONCE + most)
        for batch in batches:
            numbers = _numbers(batch.column(batch.num_columns - 2))
            hits = [(i, "") for i in range(batch.num_rows)] if empty else []
            at, some, size = [], [], 0
            for i, piece in pieces(batch.column(batch.num_columns - 1)):
                at, some, size = [*at, i], [*some, piece], size + len(piece)
                if size >= AT_ONCE:
                    hits += search(at, some, numbers, table, power)
                    at, some, size = [], [], 0
            if size:
                hits += search(at, some, numbers, table, power)
            who = pa.array([i for i, _ in hits], pa.int32())
            kept = [batch.column(c).take(who) for c in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([t for _, t in hits], pa.string())], [*batch.schema.names[:-2], "needle"])

    return rows.mapInArrow(run, fields)
