import pytest
from pyspark.sql import functions as F

from geolattice.functions.freetext import lexemes, matches, parse, stem

#: title, description, keywords of five collections
ROWS = [
    (1, "Stranger Tales", "Teenagers leave school and battle scary monsters", None),
    (2, "Bear Kitchen", "One more story of why nobody should open a restaurant", "restaurant,funny,sad,great"),
    (3, "Gojira", "A large lizard has its revenge", "scary,lizard,monster"),
    (4, "Table of Chefs", "Yet another great story of people who go to a restaurant", "restaurant,food"),
    (5, None, "Life in an office", "paper"),
]
CASES = {
    "monsters": [1, 3], "lizard": [3], "scary OR funny": [1, 2, 3], "(scary AND revenge) OR (funny AND sad)": [2, 3], '"great story"': [4], "monster -school": [3], "+restaurant -sad": [4], "+restaurant": [2, 4],
    "bear or stranger": [1, 2], "bear, stranger": [1, 2], "bear AND stranger": [], "bear and stranger": [], '"bear or stranger"': [], "office": [5], "large lizard": [3], "teenagers battle monsters": [], "scary  monsters": [1], "the of": [],
    '"great story" OR "large lizard"': [3, 4],
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, title string, description string, keywords string").cache()


@pytest.mark.parametrize("q", CASES)
def test_queries(table, q):
    got = table.filter(matches([F.col(c) for c in ("description", "title", "keywords")], q)).select("id").collect()
    assert sorted(r[0] for r in got) == CASES[q]


def test_list_is_alternatives(table):
    got = table.filter(matches([F.col(c) for c in ("description", "title", "keywords")], ["bear", "stranger"])).select("id").collect()
    assert sorted(r[0] for r in got) == [1, 2]


@pytest.mark.parametrize("word, want", {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "agreed": "agre", "hopping": "hop", "hoping": "hope", "falling": "fall", "relational": "relat", "generously": "generous", "skies": "sky", "conditional": "condit", "happy": "happi", "enjoy": "enjoy"}.items())
def test_stems(word, want):
    assert stem(word) == want


def test_places_count_stop_words():
    assert lexemes("the cat of cats") == {"cat": [1, 3]}
    assert parse("the") is None
