"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a re-parameterised question has the template
of the original. A run of words of one type is one slot, so a value may change its length. Windows
of the template are hash-joined with the benchmark's; windows in order at nearby shifts make an
alignment of a row with an item, whose slots must be filled consistently: one original value, one
new value.

What is a name can't be told from a word alone, so there are readings: CASED has capitalised words
inside sentences as names, PLAIN has no names (any change of case), CAPITAL has all capitalised
words as names (renamed sentence openers). EXACT has every word as it is, for items of few literals.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_hash
from .textvec import Words, mix, slices, windows

#: Unit words that become <unit>.
UNITS = frozenset("mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years percent % dollar dollars euro euros cent cents degree degrees kmh mph watt watts volt volts".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
NUM, NAME, UNIT = 1, 2, 3
_NUMBER = re.compile(rb"[-+$\xc2\xa3\xe2\x82\xac#(]*\d[\d.,:/]*[%)]?")
BLOOM_BITS = 22
CASED, PLAIN, CAPITAL, EXACT = range(4)
#: An edit of up to so many tokens keeps the windows over it, if there are windows on both sides.
EDIT = 4


def parse(col: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column, each word's type, its hash, whether it opens a sentence or line, and whether it is capitalised."""
    w = Words(col, lower=False)
    data, start, end = w.data.copy(), w.start.copy(), w.end.copy()
    alnum = np.zeros(256, bool)
    alnum[np.r_[48:58, 65:91, 97:123, 128:256, 37]] = True
    stops = np.zeros(256, bool)
    stops[[46, 33, 63, 58]] = True
    last = data[end - 1] if len(end) else data[:0]
    opens = np.ones(len(start), bool)  # starts a sentence or line
    if len(start) > 1:
        opens[1:] = stops[last[:-1]] | (w.doc[1:] != w.doc[:-1])
        newline = np.concatenate([[0], np.cumsum(data == 10)])
        opens[1:] |= newline[start[1:]] > newline[end[:-1]]
    for _ in range(4):
        live = end - start > 1
        start += live & ~alnum[data[np.minimum(start, len(data) - 1)]]
        live = end - start > 1
        end -= live & ~alnum[data[end - 1]]
    upper = np.zeros(256, bool)
    upper[65:91] = True
    kind = np.zeros(len(start), np.int8)
    head = data[start] if len(start) else data[:0]
    digit = (head >= 48) & (head <= 57)
    capital = upper[head] & (end - start > 1)
    kind[capital & ~opens] = NAME
    kind[digit] = NUM
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    w.data, w.start, w.end = lower[data], start, end
    h = w.hashes()
    known = Words(pa.array([" ".join(sorted(NUMBERS)), " ".join(sorted(UNITS))]))
    kh = known.hashes()
    kind[np.isin(h, kh[: known.first[1]])] = NUM
    kind[np.isin(h, kh[known.first[1] :])] = UNIT
    return w, kind, h, opens, capital


def template_of(kind: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.where(kind > 0, mix(kind.astype(np.uint64) + np.uint64(99)), h)


def canonical(col: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a column, each word's template hash, its type (0 literal) and its own hash.

    Marks at a word's ends do not count. A word is a number if it is one in digits or words, a unit
    if it is in UNITS, a name if it is capitalised and the word before does not end a sentence.
    """
    w, kind, h, _, _ = parse(col)
    return w, template_of(kind, h), kind, h


def tokens(parsed, reading: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, type and value of each token in a reading: a literal, or a run of words of one type within a sentence."""
    w, kind, h, opens, capital = parsed
    if reading == EXACT:
        return w.doc, np.zeros(len(h), np.int8), h
    if reading == PLAIN:
        kind = np.where(kind == NAME, 0, kind).astype(np.int8)
    elif reading == CAPITAL:
        kind = np.where((kind == 0) & capital, NAME, kind).astype(np.int8)
    joins = np.zeros(len(h), bool)
    joins[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & ~opens[1:]
    first = np.flatnonzero(~joins)
    if not len(first):
        return w.doc, kind, h
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return w.doc[first], kind[first], np.add.reduceat(h * (2 * place + 1).astype(np.uint64), first)


def token_windows(doc: np.ndarray, kind: np.ndarray, value: np.ndarray, k: int, min_literals: int, reading: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window of k tokens with enough literals."""
    hashes, at = windows(template_of(kind, value), doc, k)
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    ok = literal[at + k] - literal[at] >= min_literals if len(at) else np.zeros(0, bool)
    return mix(hashes[ok] + np.uint64(16 * reading + k)), at[ok]


def align(item_at, item_no, shift, total: int, k: int, coverage: float) -> list[tuple[float, list[int]]]:
    """(coverage, indices) of the alignments of an item's windows that cover enough, best first.

    Candidates are the windows of each one shift, and those of the best chain that ends in it: in
    order in the item and the row, changing shift by at most EDIT tokens at a time. Windows between
    two of an alignment count too if just an edit of up to EDIT tokens parts the two.
    """
    pure, mixed, top = {}, {}, None  # by shift: covered windows, index, chain before

    def longer(state, i):
        covered, j, _ = state
        near = item_at[i] - item_at[j] <= k + EDIT and abs(shift[i] - shift[j]) <= EDIT
        return (covered + (item_no[i] - item_no[j] if near else 1), i, state)

    order, a = sorted(range(len(item_at)), key=lambda i: (item_at[i], shift[i])), 0
    while a < len(order):
        b = a
        while b < len(order) and item_at[order[b]] == item_at[order[a]]:
            b += 1
        new = {}
        for i in order[a:b]:
            s = shift[i]
            if s in new:
                continue
            new[s] = [longer(pure[s], i) if s in pure else (1, i, None), longer(mixed[s], i) if s in mixed else (1, i, None)]
            if top and shift[top[1]] != s and abs(shift[top[1]] - s) <= EDIT and item_at[top[1]] + shift[top[1]] < item_at[i] + s:
                new[s][1] = max(new[s][1], longer(top, i), key=lambda x: x[0])
        for s, (p, m) in new.items():
            pure[s], mixed[s] = p, m
            if top is None or m[0] > top[0]:
                top = m
        a = b
    out = []
    for covered, i, before in sorted([*pure.values(), *mixed.values()], key=lambda x: -x[0]):
        if covered < coverage * total:
            break
        chain = [i]
        while before:
            _, i, before = before
            chain.append(i)
        out.append((covered / total, chain[::-1]))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 8, min_literals: int = 4, coverage: float = 0.5, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", max_broadcast: int = 4_000_000, any_case: bool = True, with_hash: bool = False) -> DataFrame:
    """(id, item, n_windows, coverage, n_slots, n_changed) of the rows that hold an item.

    A row holds an item if, in one alignment, at least `coverage` of the item's template windows of
    k tokens occur and the slots in them are consistent, that is each of the item's values has one
    value in the row. An alignment may change its shift at words put in or left out; see `align`.
    n_changed counts slots whose value differs: 0 is a copy, more a re-parameterised question. With
    any_case, the readings PLAIN and CAPITAL are tried besides CASED, so copies in another case and
    renamed sentence openers are found; without, only CASED. An item of fewer than k tokens is one window; one with no
    window of min_literals literals must occur word for word; one of fewer than min_literals words
    matches nothing, and null and empty texts hold nothing. Repeated rows and items give what one gives;
    texts that share an id are judged each for itself, and the id gets the best. with_hash adds
    text_hash, so that rows whose id is null or not their own can be told apart. The windows of the benchmark are
    broadcast if they are at most max_broadcast, else joined by a shuffle; rows are pre-filtered by
    a Bloom filter of fixed size either way.
    """
    readings = (CASED, PLAIN, CAPITAL) if any_case else (CASED,)
    benchmark = benchmark.select(item_col, text_col).distinct().select(item_col, text_col, text_hash(text_col).alias("item_hash"))

    def item_rows(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                parsed = parse(part.column(1))
                held = np.zeros(part.num_rows, bool)
                for reading in (*readings, EXACT):
                    doc, kind, value = tokens(parsed, reading)
                    size = np.bincount(doc, minlength=part.num_rows)
                    start, skip = np.cumsum(size) - size, held.copy() if reading == EXACT else np.zeros(len(held), bool)
                    for n in range(min_literals, k + 1):
                        hs, at = token_windows(doc, kind, value, n, min_literals, reading)
                        ok = ~skip[doc[at]] & ((size[doc[at]] == n) | (n == k))
                        hs, at = hs[ok], at[ok]
                        row = doc[at]
                        held[row] = True
                        total = np.bincount(row, minlength=part.num_rows)
                        no = np.arange(len(row)) - (np.cumsum(total) - total)[row]
                        ints = [np.full(len(at), reading), np.full(len(at), n), at - start[row], no, total[row]]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(hs.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in ints), *slot_columns(at, kind, value, n)], [item_col, "item_hash", "hash", "reading", "width", "item_at", "item_no", "item_windows", "item_kinds", "item_values"])

    def slot_columns(at, kind, h, k):
        span = at[:, None] + np.arange(k)
        return [pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(at), [None, pa.py_buffer(np.ascontiguousarray(kind[span]))]).cast(pa.binary()), pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * k), len(at), [None, pa.py_buffer(np.ascontiguousarray(h[span]))]).cast(pa.binary())]

    item_kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.mapInArrow(item_rows, f"`{item_col}` {item_kind}, item_hash long, hash long, reading int, width int, item_at int, item_no int, item_windows int, item_kinds binary, item_values binary")
    shapes = {(r["reading"], r["width"]): r["n"] for r in items.groupBy("reading", "width").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_items = sum(shapes.values())
    spark = docs.sparkSession
    bits = items.select(F.shiftrightunsigned("hash", 64 - BLOOM_BITS).cast("int").alias("b")).distinct().toPandas()["b"].to_numpy()  # at most 2^BLOOM_BITS
    bloom = np.zeros(1 << BLOOM_BITS, bool)
    bloom[bits] = True
    sent = spark.sparkContext.broadcast(np.packbits(bloom))

    def doc_rows(batches):
        has = np.unpackbits(sent.value).view(bool)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                parsed = parse(part.column(1))
                for reading in sorted({r for r, _ in shapes}):
                    doc, kind, value = tokens(parsed, reading)
                    size = np.bincount(doc, minlength=part.num_rows)
                    start = np.cumsum(size) - size
                    for n in sorted(n for r, n in shapes if r == reading):
                        hs, at = token_windows(doc, kind, value, n, min_literals, reading)
                        live = np.flatnonzero(has[(hs >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)])
                        hs, at = hs[live], at[live]
                        row = doc[at]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(2).take(pa.array(row)), pa.array(hs.view(np.int64)), pa.array((at - start[row]).astype(np.int32)), slot_columns(at, kind, value, n)[1]], [id_col, "text_hash", "hash", "doc_at", "doc_values"])

    doc_kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(id_col, text_col, text_hash(text_col).alias("text_hash")).mapInArrow(doc_rows, f"`{id_col}` {doc_kind}, text_hash long, hash long, doc_at int, doc_values binary")
    # distinct: a repeated row is no more evidence than one, and no group grows with its copies
    pairs = found.join(F.broadcast(items) if n_items <= max_broadcast else items, "hash").distinct()
    # alignments stay in one of overlapping ranges of shifts, so a group is bounded by the item's size
    shift = F.col("doc_at") - F.col("item_at")
    span = F.greatest(F.lit(2 * EDIT), F.floor(F.col("item_windows") / 4))
    pairs = pairs.withColumn("shift", shift).withColumn("range", F.explode(F.array(F.floor(F.col("shift") / span), F.floor(F.col("shift") / span) - 1)))
    by = [id_col, "text_hash", item_col, "item_hash", "reading", "width", "range"]

    @F.pandas_udf("struct<coverage:double,windows:int,slots:int,changed:int>")
    def slots(totals: pd.Series, widths: pd.Series, ats: pd.Series, nos: pd.Series, shifts: pd.Series, kinds: pd.Series, item_values: pd.Series, doc_values: pd.Series) -> pd.DataFrame:
        out = []
        for total, width, at, no, sh, ks, a, b in zip(totals, widths, ats, nos, shifts, kinds, item_values, doc_values, strict=True):
            found = (None, None, None, None)
            for covered, chain in align([int(x) for x in at], [int(x) for x in no], [int(x) for x in sh], total, width, coverage):
                kind = np.frombuffer(b"".join(ks[i] for i in chain), np.int8)
                old, new = (np.frombuffer(b"".join(v[i] for i in chain), np.uint64) for v in (a, b))
                # the row's words around the item may lengthen the runs at its ends, so these two decide nothing
                edge = np.zeros(len(kind), bool)
                edge[0], edge[-1] = no[chain[0]] == 0, no[chain[-1]] == total - 1
                there, inner = {}, (kind > 0) & ~edge
                if all(there.setdefault(int(x), int(y)) == int(y) for x, y in zip(old[inner], new[inner], strict=True)):
                    for x, y in zip(old[edge & (kind > 0)], new[edge & (kind > 0)], strict=True):
                        there.setdefault(int(x), int(y))
                    found = (covered, len(chain), len(there), sum(x != y for x, y in there.items()))
                    break
            out.append(found)
        return pd.DataFrame(out, columns=["coverage", "windows", "slots", "changed"]).astype({"coverage": float, "windows": "Int32", "slots": "Int32", "changed": "Int32"})

    packed = F.struct("item_at", "item_no", "shift", "item_kinds", "item_values", "doc_values")
    grouped = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("item_windows").alias("item_windows"), F.collect_list(packed).alias("p"))
    # pre-aggregate: a group with too few windows, even with all edits between them, never reaches the alignment
    grouped = grouped.where(F.col("n") * (k + EDIT) >= F.col("item_windows") * coverage)
    checked = grouped.withColumn("c", slots("item_windows", "width", *(F.col(f"p.{c}") for c in ("item_at", "item_no", "shift", "item_kinds", "item_values", "doc_values")))).where("c.coverage is not null")
    best = F.max(F.struct("c.coverage", F.col("c.windows").alias("n_windows"), F.col("c.slots").alias("n_slots"), F.col("c.changed").alias("n_changed"))).alias("x")
    own = [id_col, *["text_hash"] * with_hash, item_col]
    return checked.groupBy(*own).agg(best).select(*own, F.col("x.n_windows").cast("long").alias("n_windows"), "x.coverage", "x.n_slots", "x.n_changed")
