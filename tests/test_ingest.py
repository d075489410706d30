import pytest
from pyspark.sql import functions as F

from tests import builders as b
from tests.conftest import rows, ts
from tidemark.config import StoreConfig
from tidemark.plans.reports import storage_size
from tidemark.schemas import CACHED_PLANS, DATABASES, PLAN_ATTRIBUTES, PLAN_DBID, PLAN_XML, QUERY_STATS, SQL_TEXT
from tidemark.sources import align, catalog, ingest, log

NS = 'xmlns="urn:example:showplan"'


def xml(level="FULL", schema="dbo"):
    return (
        f"<ShowPlanXML {NS}><BatchSequence><Batch><Statements>"
        f'<StmtSimple StatementOptmLevel="{level}"><ColumnReference Schema="[{schema}]"/></StmtSimple>'
        "</Statements></Batch></BatchSequence></ShowPlanXML>"
    )


def cached(spark, *data):
    return spark.createDataFrame([(h, kind, "Adhoc", uses, 1, 8) for h, kind, uses in data], CACHED_PLANS)


def attributes(spark, *data):
    return spark.createDataFrame(data, PLAN_ATTRIBUTES)


def databases(spark):
    return spark.createDataFrame([(1, "one"), (2, "two"), (10, "ten")], DATABASES)


def monitored(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "database_name string")


def stats(spark, *data):
    """``(plan_handle, query_hash, plan_hash, start, end)``; sql handle equals plan handle."""
    return spark.createDataFrame(
        [(h, h, q, p, s, e, ts(1)) for h, q, p, s, e in data],
        "plan_handle binary, sql_handle binary, query_hash binary, query_plan_hash binary, "
        "statement_start_offset int, statement_end_offset int, creation_time timestamp_ntz",
    )


@pytest.fixture(scope="module")
def cache(spark):
    return cached(
        spark,
        (b"p1", "Compiled Plan", 5),
        (b"p2", "Compiled Plan", 1),
        (b"p3", "Parse Tree", 9),
        (b"p4", "Compiled Plan", 2),
        (b"p5", "Compiled Plan", 7),
        (b"p6", "Compiled Plan", 7),
    )


@pytest.fixture(scope="module")
def attrs(spark):
    return attributes(
        spark,
        (b"p1", "dbid", "1"), (b"p1", "sql_handle", "s"), (b"p1", "set_options", "zz"),
        (b"p4", "dbid", "10"), (b"p6", "dbid", "2"), (b"p2", "dbid", "1"), (b"p3", "dbid", "1"),
    )


def test_compiled_plans_need_their_kind_and_enough_uses(cache):
    assert rows(ingest.compiled_plans(cache), "plan_handle") == [(b"p1",), (b"p4",), (b"p5",), (b"p6",)]
    assert rows(ingest.compiled_plans(cache, 7), "plan_handle") == [(b"p5",), (b"p6",)]


def test_pivot_keeps_plans_without_attributes_and_ignores_others(cache, attrs):
    got = ingest.pivot_attributes(ingest.plan_attributes(ingest.compiled_plans(cache), attrs))
    assert got.columns == ["plan_handle", "dbid", "sql_handle"]
    assert rows(got) == [(b"p1", 1, "s"), (b"p4", 10, None), (b"p5", None, None), (b"p6", 2, None)]


def test_new_handles_are_unseen_and_monitored(spark, cache, attrs):
    seen = spark.createDataFrame([(b"p1", 1)], PLAN_DBID)
    got = ingest.new_plan_handles(cache, attrs, seen, monitored(spark, "one", "ten"), databases(spark))
    assert rows(got) == [(b"p4", 10)]
    none_seen = spark.createDataFrame([], PLAN_DBID)
    got = ingest.new_plan_handles(cache, attrs, none_seen, monitored(spark, "one", "ten"), databases(spark))
    assert rows(got) == [(b"p1", 1), (b"p4", 10)]


def test_monitored_list_by_mode(spark):
    kept = monitored(spark, "one", "two")
    assert rows(ingest.monitored_list(StoreConfig(mode="Centralized"), kept)) == [("one",), ("two",)]
    classic = StoreConfig(collection_active=True, classic_database="ten")
    assert rows(ingest.monitored_list(classic, kept)) == [("ten",)]


def plan_inputs(spark):
    handles = spark.createDataFrame([(b"p1", 1), (b"p4", 10), (b"p5", 1)], PLAN_DBID)
    statements = stats(
        spark,
        (b"p1", b"q1", b"x", 0, -1), (b"p1", b"q1", b"x", 8, -1), (b"p1", b"q2", b"x", 0, -1),
        (b"p4", b"q3", b"y", 0, -1), (b"p4", None, b"y", 0, -1), (b"p5", b"q4", b"z", 0, -1),
        (b"p9", b"q9", b"z", 0, -1),
    )
    documents = spark.createDataFrame([(b"p1", xml()), (b"p4", xml()), (b"p5", None)], PLAN_XML)
    return handles, statements, documents


def test_new_plans(spark, cache):
    handles, statements, documents = plan_inputs(spark)
    known = spark.createDataFrame([(b"q2x",), (None,)], "plan_fingerprint binary")
    args = (handles, cache, statements, documents, known, databases(spark), ts(3))
    got = ingest.new_plans(*args)
    # q2 is known, the NULL hash has no fingerprint, p5 has no document; q1 occurs twice.
    shown = ("plan_fingerprint", "plan_handle", "plan_database", "plan_firstfound")
    assert rows(got, *shown) == [
        (b"q1x", b"p1", "one", ts(3)), (b"q1x", b"p1", "one", ts(3)), (b"q3y", b"p4", "ten", ts(3)),
    ]
    once = ingest.new_plans(*args, dedupe_batch=True)
    assert rows(once, "plan_fingerprint") == [(b"q1x",), (b"q3y",)]


def test_new_queries_fan_out_unless_hashes_match(spark):
    owners = spark.createDataFrame(
        [(1, b"p1", b"q1x"), (2, b"p1", b"q2x")], "plan_id long, plan_handle binary, plan_fingerprint binary"
    )
    statements = stats(spark, (b"p1", b"q1", b"x", 0, 4), (b"p1", b"q2", b"x", 6, -1), (b"p1", None, b"x", 0, -1))
    text = spark.createDataFrame([(b"p1", "abcdef")], SQL_TEXT)
    none_known = spark.createDataFrame([(None,)], "query_plan_fingerprint binary")
    got = ingest.new_queries(owners, statements, text, none_known, match_hash=False)
    shown = ("plan_id", "query_plan_fingerprint", "query_statement_text")
    assert rows(got, *shown) == [
        (1, b"q1xq1", "abc"), (1, b"q1xq2", "def"), (2, b"q2xq1", "abc"), (2, b"q2xq2", "def"),
    ]
    known = spark.createDataFrame([(b"q1xq1",)], "query_plan_fingerprint binary")
    assert rows(ingest.new_queries(owners, statements, text, known), *shown) == [
        (2, b"q2xq2", "def")
    ]
    no_text = spark.createDataFrame([], SQL_TEXT)
    assert ingest.new_queries(owners, statements, no_text, none_known).count() == 0


def stored(spark, *data):
    return spark.createDataFrame(
        data, "plan_id long, plan_executionplan string, plan_optimization string, xml_processed int"
    )


def test_annotate_reads_each_plan_once(spark):
    got = ingest.annotate_plans(
        stored(
            spark,
            (1, xml("FULL"), None, 0), (2, xml("TRIVIAL"), None, 0), (3, "<broken", None, 0),
            (4, xml("FULL"), "Trivial", 1), (5, None, None, 0),
        )
    )
    assert rows(got, "plan_id", "plan_optimization", "xml_processed") == [
        (1, "Full", 1), (2, "Trivial", 1), (3, None, 1), (4, "Trivial", 1), (5, None, 0),
    ]


def test_drop_self_removes_queries_and_plans(spark):
    plans = stored(spark, (1, xml(), None, 0), (2, xml(schema="mine"), None, 0), (3, "<broken [mine]", None, 0))
    queries = spark.createDataFrame([(10, 1), (20, 2), (21, 2), (30, 3), (40, 99)], "query_id long, plan_id long")
    left, kept = ingest.drop_self(queries, plans, "mine")
    assert rows(left, "query_id") == [(10,), (30,), (40,)]
    assert rows(kept, "plan_id") == [(1,), (3,)]
    assert rows(ingest.self_plans(plans, "mine")) == [(2,)]


def server_frame(spark, *drop):
    df = spark.range(1).select(*[F.lit(5 if f.dataType.simpleString() == "bigint" else None).cast(f.dataType).alias(f.name) for f in QUERY_STATS.fields])
    return df.drop(*drop)


def test_align_gives_the_full_schema_for_every_version(spark):
    assert len(QUERY_STATS) == 64
    later = [c for c in QUERY_STATS.names if any(c.endswith(x) for x in ("dop", "grant_kb", "threads"))]
    rows_columns = ["total_rows", "last_rows", "min_rows", "max_rows"]
    handle = ["statement_sql_handle", "statement_context_id"]
    old = server_frame(spark, "query_hash", "query_plan_hash", *rows_columns, *handle, *later)
    got = align.align_query_stats(old, "9.0.5000.0")
    assert got.schema.names == QUERY_STATS.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in QUERY_STATS]
    row = got.first()
    assert (row["query_hash"], row["statement_context_id"], row["total_rows"], row["max_dop"]) == (None, None, 0, 0)
    assert row["execution_count"] == 5
    both = align.union_versions([(old, "9.0.5000.0"), (server_frame(spark), "13.0.1601.5")])
    assert sorted(r["total_dop"] for r in both.collect()) == [0, 5]
    with pytest.raises(ValueError):
        align.align_query_stats(old, "13.0.1601.5")
    with pytest.raises(ValueError):
        align.align_query_stats(server_frame(spark, "execution_count"), "9.0.0.0")


def test_catalog_and_budget(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    listed = catalog.table_catalog(spark, {"t": spark.read.parquet(path), "absent": None})
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert rows(listed) == [("absent", 2, "U", None, None), ("t", 1, "U", 100, -(-size // 1024))]
    assert rows(storage_size(listed), "table_name") == [("t",)]
    assert catalog.within_budget(listed, 1).first()["within_budget"] is True
    assert catalog.within_budget(listed, 0).first()["within_budget"] is False
    empty = catalog.table_catalog(spark, {"absent": None})
    assert catalog.within_budget(empty, 100).first()["within_budget"] is False


def test_log_entries(spark):
    entries = b.frame(spark, "activity_log", [(1, 4, ts(), "a")])
    assert log.next_run_id(entries).first()[0] == 5
    assert log.next_run_id(entries.limit(0)).first()[0] == 1
    message = log.count_message(spark.range(3), "captured ", " new plan(s)")
    entry = log.log_event(message, 2, log.next_run_id(entries).scalar(), ts(6))
    assert rows(entry) == [(2, 5, ts(6), "captured 3 new plan(s)")]
    long = log.log_event(log.text_message(spark, "x" * 300), 1, 1, ts()).first()["log_message"]
    assert len(long) == 300
