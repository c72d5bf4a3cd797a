"""Scalar operators on literals, quirks included."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import numeric as N
from tallyweave.functions import text as X
from tallyweave.operators import rooms as G


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f("s").alias("r")).first()["r"]


CASES = [
    (X.collapse, " a\t b \n c ", "a b c"),
    (X.collapse, None, ""),
    (X.lower_tokens, "It's 2-PLY", ["it's", "2", "ply"]),
    (X.lower_tokens, None, []),
    (X.profile_tokens, "The the old OLD ab", ["the", "old"]),
    (X.match_tokens, "The the old OLD ab", ["old"]),
    (X.normalized_description, "3) The Door & Slab", "door slab"),
    (X.normalized_description, None, ""),
    (X.description_tokens, "the", []),
    (X.room_tokens, "Main Level Bath 2 bath", ["bath", "2", "bath"]),
    (X.room_numbers, "Room 2 and 12, 2", ["2", "12"]),
    (X.clean_description, " - a:b -: ", "a:b"),
    (X.is_meaningful, "Door", False),
    (X.is_meaningful, "1. Remove tile", True),
    (X.item_number, "12. Tile", 12),
    (X.item_number, "12.Tile", None),
    (X.loose_item_number, "12.Tile", 12),
    (X.loose_item_number, "Tile", 9999),
    (X.item_prefix, "7) x", "[#7] "),
    (X.room_heading, "Continued - Kitchen:", "Kitchen"),
    (X.is_room_heading, "Master Bedroom", True),
    (X.is_room_heading, "Total Price", False),
    (X.is_room_heading, "1. Tile", False),
    (X.section_total, "Totals: Kitchen 187.16 1,449.50", "Kitchen"),
    (X.section_total, "Totals: Bathroom - continued", "Bathroom"),
    (X.section_total, "Total: $1,234.56", None),
    (X.section_total, "totally wet", "ly wet"),
    (X.unit, " Sq Ft ", "sf"),
    (X.unit, "pallet", "pallet"),
    (X.unit, None, ""),
    (X.spec_markers, "one coat", ["1coat"]),
    (X.spec_markers, "2-coat", ["2coat"]),
    (X.spec_markers, "2 gallons primer", ["2ga"]),
    (X.spec_markers, "paint", []),
    (X.spec_markers, '1/2" plywood', ["1/2", "1/2inch"]),
    (X.strict_amount, "$1,234.56", 1234.56),
    (X.strict_amount, "12,345.67", 12345.67),
    (X.strict_amount, "1. tile 2 EA 9.50 19.00", 19.0),
    (X.strict_amount, "ref 1234.56", None),
    (X.strict_amount, "$1234.56", 123.0),
    (X.is_noise, "Date: 1/1 Page: 2", True),
    (X.is_noise, "123", True),
    (X.is_noise, "1234", False),
    (X.is_room_line, "Main Level", True),
    (X.is_room_line, "KITCHEN 2", True),
    (X.is_room_line, "1234", False),
    (X.is_room_line, "DESCRIPTION QTY TAX O&P TOTAL", False),
    (lambda c: X.cut(c, 6), "abcdefgh", "abc..."),
    (lambda c: X.chunks(c, 7), "ab\n\n cd \nefgh\nlonger than that", ["ab\ncd", "efgh", "longer than that"]),
    (lambda c: X.chunks(c, 7), None, []),
    (X.locator_candidates, None, []),
    (X.locator_candidates, "1. Old door", ["1. Old door", "Old door"]),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_text(spark, f, value, want):
    got = one(spark, value, f)
    assert (sorted(got) if isinstance(got, list) and f is X.room_numbers else got) == (sorted(want) if f is X.room_numbers else want)


def test_money(spark):
    row = spark.range(1).select(X.money(F.lit(1234.5)).alias("a"), X.money(F.lit(None).cast("double")).alias("b"), X.money(F.lit(-1.0)).alias("c")).first()
    assert tuple(row) == ("$1,234.50", "-", "$-1.00")


NAMES = [("Kitchen", "Kitchen", 1.0), ("Bedroom", "Bedroom Closet", 0.25), ("Bedroom", "Master Bedroom", 0.92), ("Bedroom 1", "Bedroom 2", 0.0), ("Bedroom", "Bedroom 2", 0.875), ("Main Level", "Main Level", 0.0)]


def test_locator_phrases_are_worked_out_once(spark):
    """The plan holds each phrase's text a few times, not once for each phrase and element: its size is that of the work."""
    plan = spark.range(1).select(X.locator_candidates(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60
    rows = [("1. The blue tile  10 EA $5.00", "1. The blue | 1. The blue tile 10 | 1. The blue tile 10 EA $5.00 | The blue tile 10 EA $5.00 | The blue tile"), ("ab", ""), (None, ""), ("12. abc", "12. abc")]
    got = spark.createDataFrame(rows, "s string, want string").select("want", F.array_join(X.locator_candidates("s"), " | ").alias("got")).collect()
    assert [x["got"] for x in got] == [x["want"] for x in got]


def test_room_names(spark):
    df = spark.createDataFrame(NAMES, "a string, b string, want double")
    ratio = G.sequence_ratio(F.array_join(X.room_tokens("a"), " "), F.array_join(X.room_tokens("b"), " "))
    for r in df.withColumn("ratio", ratio).withColumn("got", G.name_similarity(F.col("a"), F.col("b"), True, F.col("ratio"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-4), r
    same = df.where("a = 'Main Level'").select(G.name_similarity(F.col("a"), F.col("b"), False).alias("g")).first()["g"]
    assert same == 1.0


def test_sequence_ratio_is_difflibs(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("ab c") for _ in range(r.randint(0, 300))), "".join(r.choice("ab c") for _ in range(r.randint(0, 300)))) for _ in range(40)] + [(None, "x")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", G.sequence_ratio("a", "b").alias("r")).collect()
    assert all(x["r"] == difflib.SequenceMatcher(None, x["a"] or "", x["b"] or "").ratio() for x in got)


ITEM = "a_amount double, a_quantity double, a_unit_price double, a_unit string, b_amount double, b_quantity double, b_unit_price double, b_unit string, want double"


def test_alignment(spark):
    rows = [(5.0, None, None, None, 5.0, None, None, None, 0.625), (None, 2.0, None, None, None, 2.0, None, None, 1.0), (4.0, 2.0, 2.0, "EA", 4.0, 2.0, 2.0, "ea", 4 / 4.4), (None, None, None, None, 1.0, 1.0, 1.0, "", 0.0)]
    for r in spark.createDataFrame(rows, ITEM).withColumn("got", N.metadata_alignment("a_", "b_")).collect():
        assert r["got"] == pytest.approx(r["want"])


def test_alignment_is_sqls_to_the_last_bit(spark):
    """SQL sums the weights as decimals; scores that are equal there are equal here, whichever fields are there."""
    import duckdb

    from tallyweave.plans.queries import ALIGN

    r = random.Random(1)
    side = lambda: (r.choice([None, 12.6, 37.8, 33.3]), r.choice([1.0, 2.0, 3.0]), r.choice([None, 12.6, 11.1]), r.choice(["EA", "SF", ""]))
    rows = [(k, *side(), *side()) for k in range(400)]
    own = spark.createDataFrame(rows, "id int, " + ITEM.replace(", want double", "")).select("id", N.metadata_alignment("a_", "b_").alias("got")).collect()
    names = ["amount", "quantity", "unit_price", "unit"]
    con = duckdb.connect()
    con.execute("create table t (id int, " + ", ".join(f"{s}_{n} {'varchar' if n == 'unit' else 'double'}" for s in "ab" for n in names) + ")")
    con.executemany("insert into t values (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    split = ", ".join(f"(select id, {', '.join(f'{s}_{n} {n}' for n in names)} from t) {s}" for s in "ab")
    assert {x["id"]: x["got"] for x in own} == dict(con.execute(f"select a.id, {ALIGN} from {split} where a.id = b.id").fetchall())


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0), (0.0, 0.0, 10.0, 10.0, 20.0, 0.0, 30.0, 10.0), (0.0, 0.0, 10.0, 10.0, 500.0, 90.0, 510.0, 99.0)], "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    got = [tuple(r) for r in df.select(N.overlap_ratio("a_", "b_"), N.rectangle_used("a_", "b_")).collect()]
    assert got == [(0.25, False), (0.0, True), (0.0, False)]
    q = spark.range(1).select(N.quad_points(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("q")).first()["q"]
    assert q == [1, 4, 3, 4, 1, 2, 3, 2]
