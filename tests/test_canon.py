"""Scalar canonicalization over hostile values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyline.functions import canon as C
from tallyline.functions import identifiers, numbers, values
from tallyline.plans.contract import Contract, ContractError, header_gate, occurrence_headers, slugify, slugify_all, spec_version, validate


def tokens(spark, items, contract, side="source", dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {dtype}")
    return [r["t"] for r in df.select("i", C.canon(F.col("v"), contract, side, dtype).alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("raw", "token"),
    [
        ("  a   b ", "s:a b"), ("﻿x​", "s:x"), ("a b", "s:a b"), ("é", "s:é"), ("é", "s:é"), ("㎡", "s:㎡"), ("a\r\nb\rc", "s:a\nb\nc"),
        ("", "z:"), ("   ", "z:"), (None, "z:"), ("it’s", "s:it’s"), ("#N/A", "e:CELL_ERROR"), (" #REF! ", "e:CELL_ERROR"),
    ],
)
def test_text(spark, raw, token):
    assert tokens(spark, [raw], Contract("x")) == [token]


def test_text_fold_and_target(spark):
    assert tokens(spark, ["Straße"], Contract("x", case="fold")) == ["s:strasse"]
    assert tokens(spark, ["#N/A"], Contract("x"), "target") == ["s:#N/A"]
    a, b = C.folded(F.lit("s:It’s — OK… ")), C.folded(F.lit("s:it's - ok..."))
    assert spark.range(1).select((a == b).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "token"),
    [
        ("1,234.50", "n:1234.50"), ("$ 1,234.5", "n:1234.50"), ("(1,234.50)", "n:-1234.50"), ("1234-", "n:-1234.00"), ("+7", "n:7.00"), ("($5)", "n:-5.00"), ("USD 3", "n:3.00"),
        ("2.345", "n:2.35"), ("-2.345", "n:-2.35"), ("-0.001", "n:0.00"), ("1e3", "n:1000.00"), (".5", "n:0.50"), ("5.", "n:5.00"), ("1_0", "e:NOT_A_NUMBER"), ("12%", "e:NOT_A_NUMBER"),
        ("abc", "e:NOT_A_NUMBER"), ("", "z:"), (None, "z:"), ("1e40", "e:NOT_FINITE"), ("1 234", "n:1234.00"), ("--5", "e:NOT_A_NUMBER"),
    ],
)
def test_number_text(spark, raw, token):
    assert tokens(spark, [raw], Contract("x", "number")) == [token]


def test_number_native(spark):
    c = Contract("x", "number")
    assert tokens(spark, [0.1, 12.3, 2.345, -0.0, 1e-7, 1234567.891, float("nan"), None], c, dtype="double") == ["n:0.10", "n:12.30", "n:2.35", "n:0.00", "n:0.00", "n:1234567.89", "e:NOT_FINITE", "z:"]
    assert tokens(spark, ["50%"], Contract("x", "number", percent="divide_100", scale=3)) == ["n:0.500"]
    assert tokens(spark, ["1.234,5"], Contract("x", "number", decimal_sep=",", group_sep=".")) == ["n:1234.50"]
    assert tokens(spark, [7], Contract("x", "text", identifier=True), dtype="bigint") == ["e:IDENTIFIER_NUMERIC"]


def test_bool(spark):
    c = Contract("x", "bool")
    assert tokens(spark, ["TRUE", " yes ", "✓", "1.0", "N", "0", "", None, "maybe"], c) == ["b:1", "b:1", "b:1", "b:1", "b:0", "b:0", "b:0", "b:0", "e:BAD_BOOL"]
    assert tokens(spark, [2, 1, 0], c, dtype="int") == ["e:BAD_BOOL", "b:1", "b:0"]
    assert tokens(spark, [None], Contract("x", "bool", empty_means="null"), dtype="boolean") == ["z:"]


def test_dates(spark):
    c = Contract("x", "date")
    assert tokens(spark, ["2026-07-31", "7/4/2026", "31/12/2026", "soon", None], c) == ["d:2026-07-31", "d:2026-07-04", "e:BAD_DATE", "e:BAD_DATE", "z:"]
    assert tokens(spark, [45000.0, 1.0, 45000.999999], c, dtype="double") == ["d:2023-03-15", "d:1899-12-31", "d:2023-03-16"]
    at = spark.range(1).select(values.serial_timestamp(F.lit(45000.499999999996)).alias("x")).first()["x"]
    assert at == datetime(2023, 3, 15, 12, 0, 0)


def test_datetime_zones(spark):
    c = Contract("x", "datetime", timezone="America/New_York")
    got = tokens(spark, ["2026-07-01 12:00:00", "2026-03-08 02:30:00", "2026-11-01 01:30:00"], c)
    assert got == ["t:2026-07-01T16:00:00Z", "e:NONEXISTENT_LOCAL_TIME", "t:2026-11-01T05:30:00Z"]
    assert tokens(spark, [datetime(2026, 7, 1, 12)], c, "target", "timestamp_ntz") == ["t:2026-07-01T12:00:00Z"]


def test_selection_and_relations(spark):
    c = Contract("x", "selection", value_map={"Draft": "draft", "In Progress": "open"})
    assert tokens(spark, [" DRAFT", "in  progress", "gone", None], c) == ["k:draft", "k:open", "e:UNRESOLVED_SELECTION", "z:"]
    assert tokens(spark, ["draft"], c, "target") == ["k:draft"]
    m = Contract("x", "m2m")
    assert tokens(spark, ["10, 9,2,2", "b,a", " , ", None], m) == ["r:[2,2,9,10]", "r:[a,b]", "z:", "z:"]
    assert tokens(spark, ["7", "x"], Contract("x", "many2one", compare_by="id")) == ["r:7", "e:ORPHAN_REFERENCE"]


def test_error_tokens_equal_nothing(spark):
    pairs = spark.createDataFrame([("s:a", "s:a"), ("e:BAD_DATE", "e:BAD_DATE"), ("z:", "z:")], "a string, b string")
    assert [r[0] for r in pairs.select(C.equal(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_contract_rules():
    with pytest.raises(ContractError):
        validate([Contract("x", "bool", truthy=("a",), falsy=("A",))])
    with pytest.raises(ContractError):
        validate([Contract("x", "datetime")])
    with pytest.raises(ContractError):
        validate([Contract("x"), Contract("x")])
    with pytest.raises(ContractError):
        validate([Contract("x", "money", scale=None)])
    one = spec_version([Contract("a", "selection", value_map={"a": "b,c=d"}), Contract("b")])
    assert one == spec_version([Contract("b"), Contract("a", "selection", value_map={"a": "b,c=d"})])
    assert one != spec_version([Contract("a", "selection", value_map={"a": "b", "c": "d"}), Contract("b")])


def test_headers():
    assert slugify("s:Café No. 1") == "cafe_no_1" and slugify("1st") == "_1st" and slugify("***") == "_"
    assert slugify_all(["Amount", "amount", "Amount 2", "AMOUNT"]) == ["amount", "amount_2", "amount_2_2", "amount_3"]
    assert occurrence_headers(["A", "", None, "A"]) == ["s:A", "s:column#2", "s:column#3", "s:A#2"]
    gate = header_gate([Contract("a", header="A"), Contract("b", header="B")], ["A", "C"])
    assert gate.missing == ("B",) and gate.extra == ("C",) and gate.blocked


def test_identifiers(spark):
    u = identifiers.new_ulid(1_700_000_000_000, bytes(10))
    assert len(u) == 26 and u[0] <= "7"
    row = spark.range(1).select(
        identifiers.is_ulid(F.lit(u)).alias("a"), identifiers.is_ulid(F.lit("8" + u[1:])).alias("b"), identifiers.cell_ref(F.lit("It's"), F.lit(27), F.lit(3)).alias("c"),
        identifiers.derived_ulid(1_700_000_000_000, F.lit("x")).alias("d"), identifiers.redacted(F.lit("password=abc rest")).alias("e"), identifiers.clipped(F.lit("x" * 510)).alias("f"),
        identifiers.age_text(F.lit(7300)).alias("g"), numbers.near_boundary(F.lit("1.005").cast("decimal(38,18)"), 2).alias("h"),
    ).first()
    assert row["a"] and not row["b"] and row["c"] == "'It''s'!AB3" and len(row["d"]) == 26
    assert row["e"] == "password=*** rest" and row["f"].endswith("... (+10)") and row["g"] == "2h" and row["h"]
