"""Numbers that texts state, and numbers that they can be traced to."""

import pytest

from tidemark.operators import text as T

STATED = [
    ("Took 5 s, 1,234.5 ms and 12,50; v1.2 x3 #4 a/5 6-7 3/4 (8) 9% $10 11.", {(3.0, 0), (5.0, 0), (6.0, 0), (8.0, 0), (9.0, 0), (10.0, 0), (12.0, 0), (50.0, 0), (1234.5, 1)}),
    ("1,2345 1234,567,890 .5 1.2.3 99,999,999 0.250,", {(0.25, 3), (1.0, 0), (1234.0, 0), (2345.0, 0), (567890.0, 0), (99999999.0, 0)}),
    ("code `12` and `a 13 b` [14](u/2) <b 3>4</b> 1,234abc", {(14.0, 0), (4.0, 0), (1.0, 0)}),
    ("```\n77\n```\n78\n`open 79\n80", {(78.0, 0), (79.0, 0), (80.0, 0)}),
    ("end 7.", set()), ("", set()), (None, set()),
]


def test_numbers_that_texts_state(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STATED)], "k int, t string")
    got = {}
    for r in T.numbers(rows, "k", "t").collect():
        got.setdefault(r.k, set()).add((r.number, r.places))
    assert got == {i: want for i, (_, want) in enumerate(STATED) if want}


def test_numbers_in_json(spark):
    texts = ['{"1":[2,{"3.5":true,"x":"9"}],"-4":null,"a.1":1e3,"1.":0.5}', "bad", None, "[[[-0.25]]]", "7"]
    frame = spark.createDataFrame([(t,) for t in texts], "j string")
    assert sorted(r.number for r in T.json_numbers(frame, "j").collect()) == [-4.0, -0.25, 0.5, 1.0, 2.0, 3.5, 7.0, 1000.0]


@pytest.mark.parametrize("number,places,known,fits", [(12.5, 1, 12.47, True), (12.5, 1, 12.44, False), (12.47, 2, 12.5, False), (2.67, 2, 2.675, True), (2.0, 0, 2.5, True), (3.0, 0, 2.5, False), (0.123457, 6, 0.1234567, True)])
def test_known_numbers_are_rounded_to_the_places_stated(spark, number, places, known, fits):
    stated = spark.createDataFrame([("k", number, places)], "k string, number double, places int")
    sources = spark.createDataFrame([(known,), (None,), (9.0,)], "number double")
    assert (T.untraceable(stated, sources).count() == 0) == fits
    assert T.untraceable(stated, sources, spark.createDataFrame([(number,)], "number double")).count() == 0
