"""Tables and the sections that hold them, against brute force."""

import random

from folioscope.functions import find
from folioscope.operators import sections as S


def test_tables_in_sections_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(find, "AT_ONCE", 64)  # so that texts are cut into pieces
    g = random.Random(7)
    word = lambda n: "".join(g.choice("ab é😀") for _ in range(n))
    secs = [(d, i, f"{d}{i}", word(g.choice((0, 1, 5, 70, 130, 400)))) for d in ("d", "e") for i in range(25)] + [("d", 90, "d90", None), (None, 0, "n", "ab"), ("f", 5, "f5", None), ("f", 6, "f6", "x"), ("f", 7, "f7", "")]
    tabs = [("f", 500, ""), ("d", 501, None), (None, 502, "ab"), ("g", 503, "a")]
    for k in range(400):
        d, _, _, text = g.choice(secs[:50])
        a, n = g.randrange(0, 1 + len(text)), g.choice((0, 1, 2, 3, 5, 15, 16, 17, 63, 64, 79, 80, 81, 95))
        tabs.append((d, k, (text[a : a + n] + (word(9) if k % 3 == 0 else "")) if k % 5 else word(n)))
    df = spark.createDataFrame(secs, "document_id string, ord int, id string, text string")
    got = S.associate_tables(spark.createDataFrame(tabs, "document_id string, ord int, text string"), df)
    assert got.columns == ["document_id", "ord", "text", "section_id"]
    want = {}
    for d, o, text in tabs:
        held = [i for e, _, i, t in secs if d is not None and e == d and text is not None and t is not None and text[:80] in t]
        want[o] = held[0] if held else None
    assert {r["ord"]: r["section_id"] for r in got.collect()} == want and len({w for w in want.values()}) > 20


def test_sections_with_a_shared_word_meet_no_table_that_they_do_not_hold(spark, capsys):
    """All sections and tables have one longest word; a join by it would pair each section with each table."""
    secs = spark.range(300).selectExpr("'d' AS document_id", "CAST(id AS INT) AS ord", "concat('s', id) AS id", "concat('x ', id, ' extraordinary y', id, ' z') AS text")
    tabs = spark.range(300).selectExpr("'d' AS document_id", "CAST(id AS INT) AS ord", "concat(id, ' extraordinary y', id, ' z') AS text")
    got = S.associate_tables(tabs, secs)
    got.explain()
    assert "contains" not in capsys.readouterr().out.lower()
    # a head without its first digits stands in a later one as well
    assert all(r["section_id"] == f"s{r['ord']}" for r in got.collect())


def test_without_tables_no_section_is_read(spark):
    """Pages without tables, as in w1_ingestion."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    secs = spark.createDataFrame([("d", k, f"s{k}", "alpha beta") for k in range(9)], "document_id string, ord int, id string, text string")
    got = S.associate_tables(spark.createDataFrame([], "document_id string, ord int, text string"), secs.mapInArrow(count, secs.schema))
    assert got.collect() == [] and seen.value == 0
