"""Benchmark passages in another case, renamed at sentence openers, with values of another length, and short ones."""

from folioscope.llm import templates
from tests.llm.test_llm import ITEM, prose, table

OPENERS = "Tom has 3 apples in his old basket. Tom gives 2 to Ann at the school gate. Ann eats 1 on the way home and asks how many apples are left."
GERMAN = "Der Zug verlässt den Bahnhof am Morgen und fährt mit dem Koch, dem Lehrer und der Tochter über die Brücke in das Dorf, wo ein Hund auf die Rückkehr wartet."
LONG = "the old farmer counts 5 brown hens near the red barn and then sells every white egg to his neighbour Smith today"


def found(spark, texts, items, **kw):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = templates.decontaminate(table(spark, texts), bench, **kw).collect()
    return {(r["doc_id"], r["item_id"]): r for r in rows}


def test_case_and_openers(spark):
    renamed = OPENERS.replace("Tom", "Bob").replace("Ann", "Lisa")
    texts = [ITEM.lower(), ITEM.upper(), GERMAN.lower(), GERMAN.upper(), renamed, *prose(3, 9), None, ""]
    got = found(spark, texts, [ITEM, GERMAN, OPENERS], any_case=True)
    assert sorted(got) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    assert got[0, 0]["coverage"] == 1.0 and got[4, 2]["n_changed"] >= 2


def test_values_of_another_length_and_edits(spark):
    texts = [
        LONG.replace("5", "twenty five"), LONG.replace("Smith", "van Dyke"), LONG.replace("and then", "and slowly then"), LONG.replace("barn and then", "barn then"),
        ITEM.replace("Boston", "New York"), " ".join(LONG.split()[:9]), *prose(3, 9),
    ]
    assert sorted(found(spark, texts, [LONG, ITEM])) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_one_new_value_for_two_old_ones(spark):
    q = "a basket holds 3 apples and 4 pears when the children come home from their long walk"
    assert sorted(found(spark, [q.replace("3", "5").replace("4", "5"), q], [q])) == [(0, 0), (1, 0)]


def test_short_items_and_items_of_few_literals(spark):
    numbers = "7 19 23 41 5 88 12 60 3 9"
    texts = [f"so {numbers} it goes", "people ask what is the capital of France? often", numbers.replace("23", "24"), "too short"]
    assert sorted(found(spark, texts, ["what is the capital of France?", numbers, "too short"])) == [(0, 1), (1, 0)]


def test_two_renamed_copies_in_a_row(spark):
    short = "on the way to town the man met 7 wives with many old sacks"
    texts = [short + " " + short.replace("7", "9")]
    assert found(spark, texts, [short])[0, 0]["coverage"] == 1.0


def test_runs_at_the_ends_of_an_item(spark):
    q = "Boston has a very old red bridge that the mayor of Boston wants to close for repair in May"
    assert sorted(found(spark, ["we asked Mary Boston" + q[6:] + " June or never"], [q], any_case=True)) == [(0, 0)]
