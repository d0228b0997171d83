"""Every registered query against its SQL twin on the smallest tables; queries without one must run and keep a stable schema."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioscope.plans import queries_audit, queries_forum, queries_store, queries_streams, queries_text, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


#: Documents without a text, a sentence or a first line; the first ids are cited by facts.
ODD = {0: "", 3: None, 5: "  ", 37: "\nThe loss is on the second line, and it may well grow a lot over time. It could fail to end in any of our markets.", 185: "...", 700: "", 701: None, 702: "\n\n", 703: " \t One may fail. The next one may well fail too, in any of the years to come. "}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = pq.read_table(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.to_pylist()}
    rows |= {i: {"doc_id": i, "text": x, "lang": "en", "source": rows[i % 7]["source"], "n_chars": len(x or "")} for i, x in ODD.items()}
    pq.write_table(pa.Table.from_pylist(list(rows.values()), schema=docs.schema), f"{path}/documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/benchmark.parquet"), f"{path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet'")
    return path, con


@pytest.mark.parametrize("name", ["i9_supporting_sentences", "f3_number_records", "j3_validate_corpus", "p4_verify_quotes"])
def test_same_as_sql_on_odd_texts(spark, odd, name):
    path, con = odd
    got, want = registry.QUERIES[name](spark, path).toPandas(), con.sql(registry.ORACLE[name]).df()
    assert rows(got) == rows(want)


def test_sentences_are_found_once_a_text(spark):
    plan = registry.QUERIES["i9_supporting_sentences"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and "size(element_at(" not in plan


def test_whole_validation_has_more_checks_than_its_query(spark, odd):
    from folioscope.operators import audit

    found = {(r["check"], r["id"]) for r in audit.validate_corpus(*queries_audit.corpus(registry.Tables(spark, odd[0]))).collect()}
    assert {i for check, i in found if check == "empty chunk"} == {f"c{i}" for i in (0, 5, 700, 702)} and ("no main document", None) not in found
    assert {i for check, i in found if check == "weak quote provenance"} == {f"r{i}" for i in (0, 3, 700, 701)}
