"""Vectors of formats: texts, whether they are valid, and their canonical form."""

import pytest
from pyspark.sql import functions as F

from loomtable.functions.formats import FormatError, boolean_format, number_format, number_regex, temporal_format
from loomtable.plans.model import NumericFormat

#: Offsets by pattern letter that are accepted, and how they are written.
OFFSETS = {"X": {"Z": "Z", "-08": "-08", "+0530": "+05:30"}, "XX": {"Z": "Z", "-0800": "-08", "+0530": "+05:30"}, "Z": {"Z": "Z", "-0800": "-08", "+0530": "+05:30"}, "XXX": {"Z": "Z", "-08:00": "-08", "+05:30": "+05:30"}, "x": {"+00": "Z", "-08": "-08", "+0530": "+05:30"}, "xx": {"+0000": "Z", "-0800": "-08", "+0530": "+05:30"}, "xxx": {"+00:00": "Z", "-08:00": "-08", "+05:30": "+05:30"}}
REFUSED = {"XX": ("-08",), "Z": ("-08",), "XXX": ("-08", "-0800", "+0530"), "x": ("Z",), "xx": ("Z", "-08"), "xxx": ("Z", "-08", "-0800", "+0530")}

DATES = [("yyyy-MM-dd", "2015-03-22"), ("yyyyMMdd", "20150322"), ("u-MM-dd", "2015-03-22")] + [(p.replace("-", c), t.replace("-", c)) for c in "-/." for p, t in (("dd-MM-yyyy", "22-03-2015"), ("d-M-yyyy", "22-3-2015"), ("MM-dd-yyyy", "03-22-2015"), ("M-d-yyyy", "3-22-2015"))]
TIMES = [("HH:mm:ss.SSS", "15:02:37.143", "15:02:37.143"), ("HH:mm:ss", "15:02:37", "15:02:37"), ("HH:mm", "15:02", "15:02:00"), ("HH:mm:ss.S", "15:02:37.1", "15:02:37.1"), ("HHmmss", "150237", "15:02:37"), ("HHmm", "1502", "15:02:00")]
DAYS = [("yyyy-MM-ddT", "2015-03-15T"), ("dd-MM-yyyy ", "15-03-2015 "), ("d/M/yyyy ", "15/3/2015 "), ("M/d/yyyy ", "3/15/2015 "), ("dd.MM.yyyy ", "15.03.2015 "), ("M.d.yyyy ", "3.15.2015 ")]


def check(spark, build, vectors):
    """vectors: (text, canonical form or None)."""
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(vectors)], "i int, x string")
    got = {r["i"]: r["v"] for r in frame.select("i", build(F.col("x")).value.alias("v")).collect()}
    assert [got[i] for i in range(len(vectors))] == [v for _, v in vectors]


@pytest.mark.parametrize("pattern,text", DATES)
def test_dates(spark, pattern, text):
    check(spark, lambda x: temporal_format(x, pattern, "date"), [(text, "2015-03-22"), ("no date", None), ("", None)])


@pytest.mark.parametrize("pattern,text,want", TIMES)
def test_times(spark, pattern, text, want):
    check(spark, lambda x: temporal_format(x, pattern, "time"), [(text, want), ("25:61", None)])
    for p, t in DAYS[:3]:
        check(spark, lambda x, p=p: temporal_format(x, p + pattern, "dateTime"), [(t + text, "2015-03-15T" + want)])


@pytest.mark.parametrize("letter", list(OFFSETS))
def test_offsets(spark, letter):
    good = [("15:02:37.143" + o, "15:02:37.143" + w) for o, w in OFFSETS[letter].items()]
    bad = [("15:02:37.143" + o, None) for o in REFUSED.get(letter, ())]
    check(spark, lambda x: temporal_format(x, "HH:mm:ss.SSS" + letter, "time"), good + bad)
    check(spark, lambda x: temporal_format(x, "yyyy-MM-ddTHH:mm:ss.SSS" + letter, "dateTime"), [("2015-03-15T" + t, w and "2015-03-15T" + w) for t, w in good + bad])


def test_single_digit_parts(spark):
    check(spark, lambda x: temporal_format(x, "yyyy-M-dTH:m:sZ", "dateTime"), [("2019-03-16T15:03:23Z", "2019-03-16T15:03:23Z")])


def test_booleans(spark):
    check(spark, lambda x: boolean_format(x, "Y|N"), [("Y", "true"), ("N", "false"), ("y", None), ("true", None)])
    with pytest.raises(FormatError):
        boolean_format(F.lit("x"), "Y")


NUMBERS = [
    (NumericFormat("0.##"), "decimal", [("1.25", "1.25"), ("0.1", "0.1"), ("1", "1"), (".5", None), ("1.255", None)]),
    (NumericFormat("#,##0.00"), "decimal", [("1,234.50", "1234.50"), ("12.00", "12.00"), ("1234.50", None), ("12,34.00", None), ("1.5", None)]),
    (NumericFormat("#.##0,00", ",", "."), "decimal", [("1.234,50", "1234.50"), ("1,234.50", None)]),
    (NumericFormat("#,##,##0"), "integer", [("12,34,567", "1234567"), ("1,234,567", None), ("7", "7")]),
    (NumericFormat("000"), "integer", [("007", "007"), ("7", None), ("1234", "1234"), ("-123", "-123")]),
    (NumericFormat("#0.0#%"), "decimal", [("12.5%", "0.125"), ("12%", None), ("12.5", None)]),
    (NumericFormat("0.0E0"), "double", [("1.5E3", "1.5E3"), ("1.5E-3", "1.5E-3"), ("1.5", None)]),
    (NumericFormat(None), "decimal", [("1,000.5", "1000.5"), ("25%", "0.25"), ("5‰", "0.005"), ("x", None), ("1E5", None)]),
    (NumericFormat("##0"), "byte", [("127", "127"), ("128", None), ("-128", "-128")]),
]


@pytest.mark.parametrize("fmt,base,vectors", NUMBERS)
def test_numbers(spark, fmt, base, vectors):
    check(spark, lambda x: number_format(x, fmt, base), vectors)


@pytest.mark.parametrize("pattern", ["", "abc", "0#", "#.#.#", "#,,0", "0.#0"])
def test_bad_number_patterns(pattern):
    with pytest.raises(FormatError):
        number_regex(NumericFormat(pattern))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_default_dates_do_not_follow_the_session(spark, zone):
    from loomtable.functions.formats import default_temporal

    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check(spark, lambda x: default_temporal(x, "dateTime"), [("2024-3-1", "2024-03-01T00:00:00"), ("2024-03-10 02:30:00", "2024-03-10T02:30:00"), ("2024-03-10 01:30:00+05:30", "2024-03-09T20:00:00"), ("2024-11-03 06:30:00+00:00", "2024-11-03T06:30:00"), ("2024-03-10T12:00:00Z", "2024-03-10T12:00:00Z"), ("x", None)])
        check(spark, lambda x: default_temporal(x, "date"), [("2024-03-10", "2024-03-10"), ("2024-3-1", "2024-03-01"), ("2024-03-10 01:30:00+05:30", "2024-03-09")])
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_registered_formats_and_datatypes(spark):
    from loomtable.functions import datatypes, formats
    from loomtable.plans.model import Datatype

    datatypes.register("colour", "http://example.org/colour", kind="colour")
    formats.register_format("colour", lambda x, d: formats.Formatted(x.startswith(d.format), F.upper(x)))
    try:
        check(spark, lambda x: formats.compile_format(x, Datatype("colour", format="#")), [("#ab", "#AB"), ("ab", None)])
    finally:
        del datatypes.REGISTRY["colour"], formats.BUILDERS["colour"]
