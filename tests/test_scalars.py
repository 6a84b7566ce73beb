"""Golden cases of identifiers, names, texts and dates."""

import datetime

import pytest
from pyspark.sql import functions as F

from apothecary.functions import names as N
from apothecary.functions.text import normalize_ndc, package_key, recall_key, squash, strip


def values(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[1] for r in sorted(rows.select("i", column(F.col("c")).alias("v")).collect())]


def test_ndc(spark):
    cases = {
        "1234-5678-90": "01234567890", "12345-678-90": "12345067890", "12345-6789-0": "12345678900", "1234-5678": "012345678", "12345-678": "123450678",
        "NDC: 0113-6267-04 ": "00113626704", "ndc#00179-113-02\n": "00179011302", "1234567890": None, "not-an-ndc": None, "": None, None: None, "123456-1-1": None, "00103623803": "00103623803",
    }
    assert values(spark, normalize_ndc, *cases) == list(cases.values())
    assert values(spark, package_key, "1234-5678", "1234-5678-9") == [None, "01234567809"]


def test_keys_and_white_space(spark):
    assert values(spark, recall_key, " d-1-2020\t", "  ", None) == ["D-1-2020", None, None]
    assert values(spark, squash, " Recall_Event: 9 1 ", " ", None) == ["recall_event:91", None, None]
    assert values(spark, strip, "　a b ", "") == ["a b", ""]


def test_names(spark):
    assert values(spark, N.normalize_manufacturer, "Novo Nordisk, Inc.", "NOVO NORDISK INC", "Hospira, Inc., a Pfizer Company", "Gel Co., Ltd.", "Inc.", None) == ["novo nordisk", "novo nordisk", "hospira", "gel", None, None]
    assert values(spark, N.normalize_drug_name, "ACETAMINOPHEN 500-mg", "Café & Thé", "--", None) == ["acetaminophen 500 mg", "cafe and the", None, None]
    assert values(spark, N.display_key, "Inc.") == ["inc"]
    assert values(spark, N.normalize_strength, "10 mg/1") == ["10mg1"]
    assert values(spark, N.normalize_application, "nda 0-12", "") == ["NDA012", None]


def test_reason_texts(spark):
    assert values(spark, N.reason_text, " Lot  A \nfailed ", "  ", None) == ["lot a failed", N.REASON_MISSING, N.REASON_MISSING]
    import hashlib

    (got,) = values(spark, lambda c: N.stable_id("x", c, F.lit(None).cast("string")), "a")
    assert got == "x:" + hashlib.sha256(b"a\x1f").hexdigest()


def test_dates(spark):
    day = datetime.date(2025, 1, 5)
    assert values(spark, N.feed_date, "1/5/2025", "20250105", "2025-1-5", "1-5-2025", "13/45/2025", None) == [day] * 4 + [None, None]


@pytest.mark.parametrize("kind,value,expected", [("string", "", True), ("string", " ", False), ("string", None, True)])
def test_missing(spark, kind, value, expected):
    assert values(spark, lambda c: N.missing(c, kind), value) == [expected]
