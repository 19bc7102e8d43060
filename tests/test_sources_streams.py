import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.conftest import rows
from threadlake.plans import lineage
from threadlake.plans.lineage import Stages
from threadlake.sources import api, formats, sinks
from threadlake.sources.tables import latest_units, merged_posts
from threadlake.streaming import readings as st

SCHEMA = StructType([StructField("id", LongType()), StructField("t", StringType())])


def test_json_lines_torn_tail(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t": "y"}\n{"id": 3, "t"')
    assert rows(formats.json_lines(spark, str(tmp_path), SCHEMA)) == [(1, "x"), (2, "y")]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n{"id": 2, "t"\n{"id": 3, "t": "z"}\n')
    with pytest.raises(formats.CorruptLog):
        formats.json_lines(spark, str(tmp_path), SCHEMA)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n2,\n")
    assert rows(formats.csv(spark, str(tmp_path / "a.csv"), SCHEMA).fillna("")) == [(1, "x"), (2, "")]


def test_insight_shapes(spark):
    p = [
        '{"data": [{"name": "views", "values": [{"value": 3, "end_time": "2026-01-02T08:00:00+0000"}, {"value": 4}]}, {"name": "likes", "total_value": {"value": 9}}]}',
        '[{"name": "clicks", "value": 2}]',
        '{"data": [{"name": "age", "total_value": {"breakdowns": [{"results": [{"dimension_values": ["18"], "value": 5}, {"dimension_values": ["25"], "value": 6}]}]}}]}',
    ]
    df = spark.createDataFrame([(x,) for x in p], "payload string")
    assert {r.metric: r.value for r in formats.insight_values(df).collect()} == {"views": 7, "likes": 9, "clicks": 2, "age": 11}
    day = formats.daily_points(df).filter("day is not null").first()
    assert (day.day, day.value, day.off_midnight) == (dt.date(2026, 1, 1), 3, False)


def test_posts_from_pages(spark):
    page = '{"data": [{"id": "1", "text": null, "root_post": {"id": "0"}}, {"id": "1", "text": "x"}, {"id": null}]}'
    r = formats.post_payloads(spark.createDataFrame([(page,)], "payload string")).collect()
    assert [(x.id, x.text, x.root_post_id) for x in r] == [("1", "x", "0")]


def test_bundle_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, v double")
    assert formats.checked_bundle(df, unique=["id"], finite=["v"], required=["id"]) is df
    for bad in ([(1, 1.0), (1, 2.0)], [(1, float("nan"))], [(None, 1.0)]):
        with pytest.raises(ValueError):
            formats.checked_bundle(spark.createDataFrame(bad, "id int, v double"), unique=["id"], finite=["v"], required=["id"])


def test_outputs(spark):
    o = spark.createDataFrame([("a", 1, 'x {"score": 2, "quote": "hi"} y', "say hi"), ("a", 2, '{"score": 9}', "say hi"), ("b", 1, "none", "t")], "id string, version int, output string, passage string")
    v = formats.valid_outputs(o, "score int, quote string", quote_in="passage")
    assert {(r.id, r.version): r.error for r in v.collect()} == {("a", 1): None, ("a", 2): "score out of range", ("b", 1): "no score"}
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r.id: (r.status, r.version) for r in formats.select_outputs(v, req).collect()} == {"a": ("ok", 1), "b": ("invalid", None), "c": ("missing", None)}


def test_keyed_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "id int, at int, t string")
    new = spark.createDataFrame([(2, 5, "c"), (3, 1, "d"), (1, 4, "late")], "id int, at int, t string")
    assert rows(sinks.upsert(old, new, ["id"], "at")) == [(1, 5, "a"), (2, 5, "c"), (3, 1, "d")]
    changed = sinks.update_columns(old, spark.createDataFrame([(1, None)], "id int, t string"), "id")
    assert sorted(changed.collect(), key=str) == sorted([(1, 5, None), (2, 5, "b")], key=str)
    keep, drop = sinks.keep_only(old, spark.createDataFrame([(1,)], "id int"), "id")
    assert (keep.count(), drop.first().id) == (1, 2)
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.replace_partition(old.withColumn("run", F.lit(1)), path, "run")
    sinks.replace_partition(new.withColumn("run", F.lit(2)), path, "run")
    assert spark.read.parquet(path).groupBy("run").count().orderBy("run").collect()[0]["count"] == 2
    h = sinks.missing_by_hash(spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "id string, text string"), spark.range(0).select(F.lit("").alias("text_hash")))
    assert sorted(r.id for r in h.collect()) == ["1", "3"]


def test_publish(spark, tmp_path):
    base = f"file://{tmp_path}"
    a = spark.range(3)
    sinks.publish(a, base)
    d = sinks.content_digest(a)
    assert d == sinks.content_digest(a.repartition(3)) and sinks.published(spark, base, d).count() == 3
    sinks.publish(spark.range(5), base)
    assert sinks.published(spark, base).count() == 5
    with pytest.raises(ValueError):
        sinks.published(spark, base, d)


def test_a_crash_between_data_and_pointer_loses_nothing(spark, tmp_path, monkeypatch):
    t = sinks.KeyedTable(spark, f"file://{tmp_path}/k", ["id"], "at", parts=4)
    row = lambda *r: spark.createDataFrame(list(r), "id int, at int, v string")
    assert t.apply(row((1, 1, "a"), (2, 1, "b"), (3, 1, "c")), 0)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_point", crash)
        with pytest.raises(OSError):
            t.apply(row((1, 2, "new"), (4, 1, "d")), 1)
        assert rows(t.read()) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]
    assert t.apply(row((1, 2, "new"), (4, 1, "d")), 1)  # replayed after the crash
    wanted = [(1, 2, "new"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d")]
    assert rows(t.read()) == wanted and not t.apply(row((1, 9, "again")), 1) and rows(t.read()) == wanted
    t.vacuum()
    assert rows(t.read()) == wanted


def test_a_crash_while_publishing_keeps_the_last_version(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/p"
    sinks.publish(spark.range(3), base)
    held = sinks.published(spark, base)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_write_small", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            sinks.publish(spark.range(9), base)
    assert sinks.published(spark, base).count() == 3
    sinks.publish(spark.range(7), base)
    assert held.count() == 3 and sinks.published(spark, base).count() == 7


def test_refetch_window(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    old = spark.createDataFrame([(day(1), 5, 1), (day(9), 7, 1), (day(10), 8, 1)], "date timestamp, views int, at int")
    new = spark.createDataFrame([(day(9), 9, 2), (day(12), 1, 2), (day(1), 99, 2)], "date timestamp, views int, at int")
    assert rows(st.refetch_window(old, new, "date", ["date"], "at")) == [(day(1), 5, 1), (day(9), 9, 2), (day(12), 1, 2)]
    assert rows(st.refetch_window(old, new.limit(0), "date", ["date"], "at")) == rows(old)


def fetch(account, cursor, limit):
    if limit > 2:
        raise api.ServerError
    k = int(cursor or 0)
    return {"data": [{"id": f"{account}{i}"} for i in range(k, min(k + limit, 5))] + [{"id": f"{account}0"}], "after": str(k + limit) if k + limit < 5 else None}


def test_paged_source(spark):
    assert [x["id"] for x in api.pages(lambda c, n: fetch("a", c, n))] == [f"a{i}" for i in range(5)]
    with pytest.raises(api.CursorLoop):
        list(api.pages(lambda c, n: {"data": [], "after": "x"}))
    with pytest.raises(api.ServerError):
        list(api.pages(lambda c, n: fetch("a", c, 9)))
    spark.dataSource.register(api.PagedSource)
    df = spark.read.format("paged").option("module", "tests.test_sources_streams").option("function", "fetch").option("accounts", "a,b").load()
    assert df.groupBy("account").count().orderBy("account").collect()[1]["count"] == 5


def test_pages_shrink_grow_and_fall_back():
    sizes = []

    def fetch_(cursor, limit):
        k = int(cursor or 0)
        sizes.append(limit)
        if k == 2 and limit >= 1 and k <= 2 < k + limit:
            raise TimeoutError
        return {"data": [{"id": str(i)} for i in range(k, min(k + limit, 40))], "after": str(k + limit) if k + limit < 40 else None}

    lenient = lambda cursor: {"data": [{"id": cursor, "lost": "field"}], "after": str(int(cursor) + 1)}
    got = list(api.pages(lambda c, n: fetch_(c, min(n, 2) if (c or "0") == "0" else n), limit=8, lenient=lenient))
    assert [x["id"] for x in got] == [str(i) for i in range(40)] and got[2] == {"id": "2", "lost": "field"}
    assert 1 in sizes and sizes[-1] > 1  # grown again after the bad item
    with pytest.raises(TimeoutError):
        list(api.pages(fetch_, limit=2))


def test_client_errors_are_typed():
    import io
    import urllib.error

    class Answer(io.BytesIO):
        status = 200

    ok = api.HttpClient("https://api.example", "t", opener=lambda r, timeout: Answer(b'{"data": [1]}'))
    assert ok.get("me", limit=3, after=None) == {"data": [1]}

    def fail(status, body):
        def opener(request, timeout):
            raise urllib.error.HTTPError(request.full_url, status, "", {}, io.BytesIO(body))

        return api.HttpClient("https://api.example", "t", opener=opener)

    with pytest.raises(api.ServerError):
        fail(503, b"<html>").get("x")
    with pytest.raises(api.ApiError) as e:
        fail(400, b'{"error": {"message": "no", "code": 190, "fbtrace_id": "A"}}').get("x")
    assert (e.value.status, e.value.code, e.value.trace) == (400, 190, "A") and not isinstance(e.value, api.ServerError)
    with pytest.raises(api.ServerError):
        api.HttpClient("https://api.example", "t", opener=lambda r, timeout: (_ for _ in ()).throw(TimeoutError())).get("x")
    assert api.cursor_parameters("https://a/b?after=c&limit=5&fields=id") == {"after": "c", "limit": "5"} and api.cursor_parameters(None) is None
    with pytest.raises(api.ApiError):
        api.cursor_parameters("https://a/b?offset=5")


def test_account_answers(spark):
    payload = '{"data": [{"name": "followers", "total_value": {"breakdowns": [{"results": [{"dimension_values": ["FR"], "value": 3}, {"dimension_values": ["VN"], "value": 4}]}]}}]}'
    p = spark.createDataFrame([(payload,), ('{"data": [{"name": "views", "total_value": {"value": 9}}]}',)], "payload string")
    assert rows(formats.demographics(p)) == [("FR", 3), ("VN", 4)] and dict(rows(formats.account_totals(p))) == {"followers": 7, "views": 9}
    with pytest.raises(ValueError):
        formats.demographics(p, breakdown="shoe")
    u = spark.createDataFrame([('{"id": "1", "username": "a", "is_verified": true}',), ("{}",)], "payload string")
    assert rows(formats.user_info(u)) == [("1", "a", None, None, True)]


def test_merged_deliveries(spark):
    p = spark.createDataFrame([("1", None, " 0\t", 1), ("1", "x", None, 2), (None, "y", None, 3), ("2", None, "  ", 4)], "id string, text string, replied_to_id string, extra int")
    assert {r.id: (r.text, r.replied_to_id) for r in merged_posts(p, "id", "text", "replied_to_id").collect()} == {"1": ("x", "0"), "2": (None, None)}
    u = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("1", "none", None), (None, "x", 9)], "id string, full_text string, built_at int")
    assert rows(latest_units(u, "id", "full_text")) == [("1", "new")]


def test_stages(spark):
    s = Stages(spark, "test")
    a = s.keep(spark.range(4))
    assert a.count() == 4
    s.drop(a)
    with Stages(spark, "gone") as t:
        b = t.keep(spark.range(2))
        path = t.base.removeprefix("file://").removeprefix("file:")
        assert b.count() == 2 and os.path.isdir(path)
    assert not os.path.exists(path)
    lineage.release()
    assert not os.path.exists(s.base.removeprefix("file://").removeprefix("file:"))


def test_streams_equal_batch(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([("p", dt.datetime(2026, 1, 1, k), k), ("p", dt.datetime(2026, 1, 1, k), k), ("q", dt.datetime(2026, 1, 1, 9 - k), k)], "post_id string, fetched_at timestamp, views int").coalesce(1).write.mode("append").parquet(src)
    batch = spark.read.parquet(src)
    out = f"file://{tmp_path}"
    for _ in range(2):  # a rerun finds nothing new
        st.append_readings(st.stream(spark, src, batch.schema, 1), f"{out}/log", f"{out}/c1")
    assert rows(spark.read.parquet(f"{out}/log")) == rows(batch.distinct())
    st.run_available(st.latest_state(st.stream(spark, src, batch.schema, 1)).writeStream.outputMode("update").foreachBatch(st.upsert_sink(f"{out}/t", ["post_id"], "fetched_at")), f"{out}/c2")
    assert rows(sinks.KeyedTable(spark, f"{out}/t", ["post_id"], "fetched_at").read()) == rows(st.latest_state(batch))
    for make, name in ((lambda s: st.hourly_totals(s, "fetched_at", "post_id"), "h"), (lambda s: st.sessions(s, "fetched_at", "post_id", "30 minutes"), "s")):
        st.run_available(make(st.stream(spark, src, batch.schema, 1)).writeStream.format("parquet").option("path", f"{out}/{name}").outputMode("append"), f"{out}/c{name}")
        assert {tuple(r) for r in spark.read.parquet(f"{out}/{name}").collect()} <= {tuple(r) for r in make(batch).collect()}
