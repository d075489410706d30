from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows, ts
from tidemark.config import StoreConfig
from tidemark.functions.arithmetic import int_avg, int_div, safe_div
from tidemark.functions.plan_xml import is_well_formed, optimization_level, touches_schema
from tidemark.functions.text import fingerprint, utf16_length, utf16_slice
from tidemark.functions.times import at, time_label
from tidemark.functions.versions import at_least, parse_version, version_parts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("a,b,expected", [(7, 2, 3), (-7, 2, -3), (7, -2, -3), (7, 0, 0), (0, 5, 0)])
def test_safe_div_truncates_and_survives_zero(spark, a, b, expected):
    assert one(spark, safe_div(F.lit(a).cast("long"), F.lit(b).cast("long"))) == expected


def test_int_div_gives_null_for_zero(spark):
    assert one(spark, int_div(F.lit(3).cast("long"), F.lit(0).cast("long"))) is None


def test_int_avg_skips_nulls_and_truncates(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v long")
    assert df.agg(int_avg(F.col("v"))).first()[0] == 1
    assert df.filter("v is null").agg(int_avg(F.col("v"))).first()[0] is None


def test_time_label_cuts_fractions_and_ignores_session_zone(spark):
    value = at(datetime(2024, 3, 31, 2, 30, 59, 999999))
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert one(spark, time_label(value)) == "02:30:59"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_as_of_must_be_naive():
    with pytest.raises(ValueError):
        at(datetime(2024, 1, 1, tzinfo=timezone.utc))


SLICES = [
    ("select 1; select 2", 0, 14, "select 1"),
    ("select 1; select 2", 20, -1, "select 2"),
    ("select 1; select 2", 0, -1, "select 1; select 2"),
    ("a😀bc", 2, 5, "😀"),
    ("a😀bc", 6, -1, "bc"),
    ("a😀bc", 4, -1, "�bc"),
    ("a😀bc", 0, 2, "a�"),
    ("abc", 4, 400, "c"),
    ("abc", 40, -1, ""),
    ("", 0, -1, ""),
    (None, 0, -1, None),
]


def test_utf16_slice(spark):
    df = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(SLICES)], "i int, t string, a int, b int")
    got = df.select("i", utf16_slice(F.col("t"), F.col("a"), F.col("b")).alias("s"))
    expected = [(i, s[3]) for i, s in enumerate(SLICES)]
    assert [tuple(r) for r in got.orderBy("i").collect()] == expected


def reference_slice(text, start, end):
    raw = text.encode("utf-16-le")
    last = len(raw) if end == -1 else end
    first, units = start // 2, (last - start) // 2 + 1
    return raw[2 * first : 2 * (first + units)].decode("utf-16-le", errors="replace")


@settings(max_examples=15, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.text(alphabet="abé漢😀𝒳", max_size=12), st.integers(0, 10), st.integers(0, 10), st.booleans()
        ),
        min_size=1,
        max_size=20,
    )
)
def test_utf16_slice_matches_code_units(spark, cases):
    data = []
    for i, (text, first, more, to_end) in enumerate(cases):
        data.append((i, text, 2 * first, -1 if to_end else 2 * (first + more)))
    df = spark.createDataFrame(data, "i int, t string, a int, b int")
    got = df.select("i", utf16_slice(F.col("t"), F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()
    for (_, text, start, end), row in zip(data, got):
        if end == -1 and start > len(text.encode("utf-16-le")):
            assert row["s"] == ""
        else:
            assert row["s"] == reference_slice(text, start, end)


def test_utf16_length_counts_surrogates_twice(spark):
    assert one(spark, utf16_length(F.lit("a😀"))) == 6


def test_fingerprint_is_null_with_a_null_part(spark):
    assert one(spark, fingerprint(F.unhex(F.lit("01")), F.unhex(F.lit("FF")))) == b"\x01\xff"
    assert one(spark, fingerprint(F.unhex(F.lit("01")), F.lit(None).cast("binary"))) is None


@pytest.mark.parametrize(
    "version,parts,has_rows",
    [
        ("9.0.5000.0", (9, 0, 5000), False),
        ("10.0.6000.0", (10, 0, 6000), False),
        ("10.50.2499.0", (10, 50, 2499), False),
        ("10.50.2500.0", (10, 50, 2500), True),
        ("10.51.0.0", (10, 51, 0), True),
        ("11.0.0.0", (11, 0, 0), True),
        ("12.0.123456789.1", (12, 0, 123456789), True),
        ("13.0.x", (13, 0, 0), True),
        ("8.0.5000000000", (8, 0, 5000000000), False),
    ],
)
def test_versions(spark, version, parts, has_rows):
    got = one(spark, version_parts(F.lit(version)))
    assert tuple(got) == parts == parse_version(version)
    assert one(spark, at_least(version_parts(F.lit(version)), (10, 50, 2500))) is has_rows


NS = 'xmlns="urn:example:showplan"'


def doc(*statements):
    inner = "".join(f"<Batch><Statements>{s}</Statements></Batch>" for s in statements)
    return f"<ShowPlanXML {NS}><BatchSequence>{inner}</BatchSequence></ShowPlanXML>"


XML = [
    (doc('<StmtSimple StatementOptmLevel="TRIVIAL"/>'), "Trivial", True, False),
    (doc('<StmtSimple StatementOptmLevel="FULL"/>'), "Full", True, False),
    (doc('<StmtSimple StatementOptmLevel="OTHER"/>'), None, True, False),
    (doc("<StmtSimple/>", '<StmtSimple StatementOptmLevel="FULL"/>'), "Full", True, False),
    (doc('<StmtSimple StatementOptmLevel="FULL"/>', '<StmtSimple StatementOptmLevel="TRIVIAL"/>'), "Full", True, False),
    (doc("<StmtCond/>"), None, True, False),
    (doc('<StmtSimple><Q><ColumnReference Schema="[telemetry]"/></Q></StmtSimple>'), None, True, True),
    (doc('<StmtSimple><ColumnReference Schema="&#91;telemetry&#93;"/></StmtSimple>'), None, True, True),
    (doc('<StmtSimple note="[telemetry]"><ColumnReference Schema="[dbo]"/></StmtSimple>'), None, True, False),
    (doc('<StmtSimple StatementOptmLevel="FULL"><ColumnReference Schema="[telemetry]"/>')[:-15], None, False, False),
    ("<ShowPlanXML/>", None, True, False),
    ("", None, False, False),
    (None, None, False, False),
]


def test_plan_documents(spark):
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(XML)], "i int, x string")
    got = df.select(
        "i",
        optimization_level(F.col("x")).alias("level"),
        is_well_formed(F.col("x")).alias("ok"),
        touches_schema(F.col("x"), "telemetry").alias("own"),
    )
    assert rows(got) == sorted(((i, *x[1:]) for i, x in enumerate(XML)), key=repr)


def test_config_defaults_and_checks():
    config = StoreConfig()
    assert (config.collection_interval, config.execution_threshold, config.maximum_size_mb) == (60, 2, None)
    assert (config.data_cleanup_threshold, config.data_cleanup_throttle) == (30, None)
    assert not config.collection_active and not config.data_cleanup_active
    assert config.trigger() == {"processingTime": "60 seconds"}
    assert StoreConfig(mode="Classic").mode == "classic"
    assert StoreConfig(data_cleanup_threshold=3650).data_cleanup_threshold == 3650
    assert StoreConfig(execution_threshold=None).execution_threshold == 2
    for bad in (dict(mode="other"), dict(collection_active=True), dict(data_cleanup_threshold=-1)):
        with pytest.raises(ValueError):
            StoreConfig(**bad)


def test_labels_merge_days(spark):
    assert one(spark, time_label(at(ts(5, day=1)))) == one(spark, time_label(at(ts(5, day=2)))) == "05:00:00"
