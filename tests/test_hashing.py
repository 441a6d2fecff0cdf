"""Published golden vectors of the hash stack."""

import pytest
from pyspark.sql import functions as F

from tallyline import taxonomy as tx
from tallyline.functions import hashing
from tallyline.operators import merkle

SPEC, UID = "SPECV1", "1abcDEF/0"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ({"amount": "n:1234.50", "name": "s:ACME Foods"}, "3830219051a074351eaf44902059fc01"),
        ({"name": "s:ACME Foods", "amount": "n:1234.50"}, "3830219051a074351eaf44902059fc01"),
        ({"amount": "n:1234.50", "due": "d:2026-07-31", "name": "s:ACME Foods"}, "ba43380c0d901252740bb6decccbdb1b"),
        ({"v": "s:1"}, "86fce31b0ee6e5b56592956396b0e4aa"),
        ({"v": "n:1"}, "b24edee0af0d3c173a66d81f70cb33e1"),
        ({"v": "b:1"}, "46345361aa9a318cf48d826e53884332"),
        ({"v": "z:"}, "e89c6a4ea3913a8a9a19798c6cb1b439"),
    ],
)
def test_row_hash(spark, row, expected):
    assert value(spark, hashing.row_hash({k: F.lit(v) for k, v in row.items()}, SPEC)) == expected


@pytest.mark.parametrize(
    ("parts", "key", "bucket"),
    [
        (["s:ACME Foods"], "0000000c733a41434d4520466f6f6473", 23),
        (["s:a|b", "s:c"], "00000005733a617c6200000003733a63", 216),
        (["s:a", "s:b|c"], "00000003733a6100000005733a627c63", 234),
        (["01JBX3T7QK9V2M4N6P8R0S1T2U"], "0000001a30314a4258335437514b3956324d344e36503852305331543255", 17),
    ],
)
def test_identity_and_bucket(spark, parts, key, bucket):
    k = hashing.identity_key(*map(F.lit, parts))
    assert value(spark, F.lower(F.hex(k))) == key
    assert value(spark, hashing.bucket_of(k)) == bucket


def test_header_fingerprint():
    assert hashing.header_fingerprint(["s:Invoice Number", "s:Amount", "s:Due Date"]) == "f35e0b3ff0179c25d00deb4a74c399d7"


def test_varint(spark):
    for n, expected in ((0, "00"), (127, "7f"), (128, "8001"), (300, "ac02"), (16384, "808001"), (2**28, "8080808001")):
        assert value(spark, F.lower(F.hex(hashing.varint(F.lit(n))))) == expected


def test_escapes(spark):
    raw = 'a"b\\c\b\t\n\f\r\x01\x1f/é'
    assert value(spark, hashing.escaped(F.lit(raw))) == 'a\\"b\\\\c\\b\\t\\n\\f\\r\\u0001\\u001f/é'


def test_bucket_and_dataset_digest(spark):
    rows = [({"amount": "n:1234.50", "name": "s:ACME Foods"}, "s:ACME Foods"), ({"amount": "n:0.00", "name": "s:Bettr Bowl"}, "s:Bettr Bowl")]
    parts = [
        spark.range(1).select(F.lit(7).alias("bucket"), hashing.identity_key(F.lit(k)).alias("key"), hashing.row_hash({n: F.lit(t) for n, t in r.items()}, SPEC).alias("h"))
        for r, k in reversed(rows)
    ]
    every = merkle.all_buckets(merkle.bucket_digests(parts[0].unionByName(parts[1])))
    found = {r["bucket"]: r["digest"] for r in every.collect()}
    assert len(found) == tx.BUCKETS
    assert found[7] == "272b8595d58db43eadea1ab472b2b75a"
    assert found[0] == "4680758652c5d246986a923fa30b2fcc"
    empty = merkle.all_buckets(merkle.bucket_digests(parts[0].limit(0)))
    assert {r["bucket"]: r["digest"] for r in empty.collect()}[7] == "cae3965449686a04c97d50150cbe08d8"
    whole = merkle.dataset_digest(every, SPEC, UID).first()
    assert (whole["n"], whole["digest"]) == (2, "485a5101901b8f2ccf4f42f02447320f7714a953ccf367197e6afdddc8d308c4")


def test_one_changed_row_moves_one_bucket(spark):
    def side(changed):
        amount = F.when(F.col("id") == changed, F.lit("n:0.01")).otherwise(F.concat(F.lit("n:"), (F.col("id") * 7 % 991).cast("string"), F.lit(".00")))
        key = hashing.identity_key(F.format_string("s:CUST-%05d", "id"))
        h = hashing.row_hash({"amount": amount, "name": F.format_string("s:Customer %d", "id")}, SPEC)
        return merkle.all_buckets(merkle.bucket_digests(merkle.entries(spark.range(300), key, h)))

    assert merkle.diff_buckets(side(-1), side(17)).count() == 1
    assert merkle.diff_buckets(side(-1), side(-1)).count() == 0
