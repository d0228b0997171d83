"""Language identification with bit-sliced Bloom filters of byte n-grams.

One table of machine words stands for all languages' Bloom filters: bit l of slot s belongs to the
filter of language l, so the AND of an n-gram's slots is the mask of all languages that hold it. A
text's score for a language is the popcount of that bit over its n-grams, less the hits that the
filter's fill makes expect by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, mix, slices

N = 4
ID_BITS = 20
SLOT_BITS = 20
HASHES = 3
UNKNOWN = "und"
#: Text worked on at once; each byte makes an n-gram of 8 bytes and more.
AT_ONCE = 1 << 18


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of all n-grams of N bytes, and the row of each.

    A-Z are lower-cased, white space and ASCII digits and marks become spaces; a row has N / 2 spaces at each end.
    """
    off, data = buffers(col)
    to = np.full(256, 32, np.uint8)
    keep = np.r_[65:91, 97:123, 128:256]
    to[keep] = keep
    to[65:91] += 32
    n = len(off) - 1
    size = np.diff(off)
    padded = np.full(len(data) + N * n, 32, np.uint8)
    row = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + row * N + N // 2] = to[data]
    own = np.repeat(np.arange(n), size + N)
    v = np.zeros(max(0, len(padded) - N + 1), np.uint64)
    for j in range(N):
        v |= padded[j : j + len(v)].astype(np.uint64) << np.uint64(8 * j)
    row = own[: len(v)]
    live = (v != np.uint64(0x20202020)) & (row == own[N - 1 :])  # no window runs into the next row
    return (mix(v[live]) >> np.uint64(64 - ID_BITS)).astype(np.uint32), row[live]


def slots(ids: np.ndarray) -> list[np.ndarray]:
    h = mix(ids.astype(np.uint64) + np.uint64(0x1234567))
    return [((h >> np.uint64(21 * j)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int32) for j in range(HASHES)]


@dataclass
class Model:
    langs: list[str]
    masks: np.ndarray  # planes of 64 languages x slots
    chance: np.ndarray


def parts(total: dict[str, int], rows: int) -> dict[str, float]:
    """Rows of each language: all of a rare one, and equal parts of what is left for the others."""
    out, left = {}, float(rows)
    for i, (k, n) in enumerate(sorted(total.items(), key=lambda x: (x[1], x[0]))):
        out[k] = min(n, left / (len(total) - i))
        left -= out[k]
    return out


def fit(labelled: DataFrame, max_rows: int = 20_000, min_count: int = 3, share: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Filters from a bounded sample of labelled rows: max_rows of them in expectation, by a hash of the id.

    Each language has up to an equal part of the sample, and what rare ones leave goes to the others;
    all rows of a language that has no more than its part are in.

    An n-gram enters a language's filter if it occurs min_count times there and at least `share`
    times as often, relative to size, as in the language where it is most frequent. Languages beyond
    64 go to further planes of masks. Rows with a null language, id or text are left out; a sample
    without any gives a model without languages. Repeated rows count as often as they occur.
    """
    rows = labelled.select(id_col, text_col, lang_col).where(f"`{lang_col}` is not null and `{text_col}` is not null and `{id_col}` is not null")
    total = {r[lang_col]: r["n"] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(total.values()) > max_rows:
        part = parts(total, max_rows)
        cap = F.create_map(*[F.lit(x) for k, n in total.items() for x in (k, int(part[k] / n * (1 << 40)))])
        rows = rows.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 40)) < cap[F.col(lang_col)])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text_col, AT_ONCE):
                ids, row = grams(part.column(0))
                names, lang = np.unique(np.array(part.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    held.setdefault(name, np.zeros(1 << ID_BITS, np.int64))
                    at, n = np.unique(ids[lang[row] == k], return_counts=True)
                    held[name][at] += n
        for name, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "gram", "n"])

    counts = rows.select(text_col, lang_col).mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(f"n >= {min_count}")
    got = counts.toPandas()  # at most 2^ID_BITS n-grams a language
    langs = sorted(got["lang"].unique())
    freq = np.zeros((len(langs), 1 << ID_BITS))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        freq[k, own["gram"]] = own["n"]
    freq /= np.maximum(1, freq.sum(axis=1, keepdims=True))
    masks = np.zeros((max(1, -(-len(langs) // 64)), 1 << SLOT_BITS), np.uint64)
    most = freq.max(axis=0) if langs else np.zeros(1 << ID_BITS)
    chance = np.zeros(len(langs))
    for k in range(len(langs)):
        ids = np.flatnonzero((freq[k] > 0) & (freq[k] >= share * most))
        for s in slots(ids):
            masks[k // 64, s] |= np.uint64(1 << k % 64)
        chance[k] = np.mean((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** HASHES
    return Model(langs, masks, chance)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, lang_pred, score, coverage) of every row.

    score is the best language's share of all languages' corrected popcounts, coverage its share of
    the text's n-grams. A null text, one without a letter, or a model without languages: und, 0, 0.
    A text none of whose n-grams is known goes to the first language with score 0; ties go to the
    first language by name. With carry, the result also has each whole row as the struct `row`.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((np.array(model.masks, np.uint8 if len(model.langs) <= 8 else np.uint64), model.langs, model.chance))

    # carried columns go flat under names of their own: a slice of a nested Arrow column would be sent whole
    names = docs.columns if carry else [id_col, text_col]
    id_at, text_at = names.index(id_col), names.index(text_col)

    def run(batches):
        masks, langs, chance = sent.value
        for batch in batches:
            for part in slices(batch, f"_c{text_at}", AT_ONCE):
                n = part.num_rows
                ids, row = grams(part.column(text_at))
                a, b, c = slots(ids)
                hits = [m[a] & m[b] & m[c] for m in masks]
                ends = np.searchsorted(row, np.arange(n + 1))
                size = np.diff(ends)
                score = np.zeros((max(1, len(langs)), n))
                for k in range(len(langs)):
                    total = np.concatenate([[0], np.cumsum((hits[k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1), dtype=np.int64)])
                    score[k] = np.maximum(0, (total[ends[1:]] - total[ends[:-1]] - size * chance[k]) / (1 - chance[k]))
                best = score.argmax(axis=0)
                top, all_ = score.max(axis=0), score.sum(axis=0)
                letter = np.array(part.column(len(names)).to_pylist(), bool) & bool(langs)
                pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)]
                share = np.where(letter & (all_ > 0), top / np.maximum(all_, 1e-9), 0.0)
                cover = np.where(letter, np.minimum(1, top / np.maximum(size, 1)), 0.0)
                kept = part.columns[: len(names)] if carry else [part.column(id_at)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(share), pa.array(cover)], [*(f"_c{i}" for i in (range(len(names)) if carry else [id_at])), "lang_pred", "score", "coverage"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], letter)
    kinds = ", ".join(f"_c{i} {rows.schema[f'_c{i}'].dataType.simpleString()}" for i in (range(len(names)) if carry else [id_at]))
    out = rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, coverage double")
    whole = [F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)]).alias("row")] if carry else []
    return out.select(F.col(f"_c{id_at}").alias(id_col), "lang_pred", "score", "coverage", *whole)
