import pytest
from pyspark.sql import functions as F

from trialgrid.operators import chart, reports, summary
from trialgrid.operators.index import with_index

REPORT = ("codec string, type string, preset string, threads string, ref_type string, outfile_options string, "
          "gop long, has_b_frames long, refs long, fI long, fP long, fB long, fT long, "
          "outfile_size_kbyte double, outfile_bit_rate_kbs double, enc_sec double, comp_ratio_persent double, "
          "enc_speed double, ssim_min double, ssim_mean double, vmaf_min double, vmaf_mean double")


def _row(codec, ref_type, opts, size, comp, ssim, vmaf, has_b=1):
    return (codec, "T", "medium", "4", ref_type, opts, 10, has_b, 2, 5, 10, 20, 35,
            size, size / 15, 10.0, comp, 2.0, ssim - 0.01, ssim, 80.0, vmaf)


def test_gate_bounds_inclusive(spark):
    rows = [_row("c", "A", "o", 1.0, 0.60, 0.99, 93.0), _row("c", "N", "o", 1.0, 0.60, 0.99, 100.0),
            _row("c", "X", "o", 1.0, 0.5999, 0.99, 95.0), _row("c", "Y", "o", 1.0, 0.7, 0.99, 100.01)]
    got = summary.quality_gate(spark.createDataFrame(rows, REPORT)).select("ref_type").collect()
    assert sorted(r.ref_type for r in got) == ["A", "N"]


def test_summary_by_codec_two_level(spark):
    rows = [_row("c", "Anime", "-q 1", 100.0, 0.8, 0.995, 95.0),
            _row("c", "Nature", "-q 1", 300.0, 0.5, 0.995, 95.0),   # fails the compression gate
            _row("d", "Anime", "-q 1", 10.0, 0.8, 0.995, 95.0, has_b=1),
            _row("d", "Nature", "-q 1", 20.0, 0.8, 0.995, 95.0, has_b=3)]
    out = {r.codec: r for r in summary.summary_by_codec(spark.createDataFrame(rows, REPORT)).collect()}
    assert out["c"].outfile_size_kbyte == 100.0          # only the passing ref type is averaged
    assert out["c"].bf == 0.0                            # avg has_b exactly 1 -> 0
    assert out["d"].bf == 3.0                            # avg 2 -> 2 + 1
    assert out["d"].outfile_size_kbyte == 15.0           # mean of the two ref-type means
    assert out["c"]["I/P/B frames"] == "5.0 / 10.0 / 20.0"
    assert out["c"].pt == round((200 - (80 + 95)) + (2 - (0.995 + 0.8)), 3)


def test_summary_by_ref_top8(spark):
    rows = [_row("c", t, f"-q {i}", float(i), 0.8, 0.995, 95.0) for i in range(10) for t in ("A", "N")]
    out = summary.summary_by_ref(spark.createDataFrame(rows, REPORT)).collect()
    assert [(r.outfile_options, r.ref_type) for r in out[:3]] == [("-q 9", "A"), ("-q 9", "N"), ("-q 8", "A")]
    assert len(out) == 8


def test_grouped_reports_row_count_equals_keys(spark, sf_dir):
    from trialgrid.sources.tables import trials_from_tables
    t = trials_from_tables(spark, sf_dir)
    keys = t.select(*reports.TYPE_KEYS).distinct().count()
    rep = reports.report_by_type(t)
    assert rep.count() == keys
    idx = [r["index"] for r in rep.orderBy("index").collect()]
    assert idx == list(range(keys))
    assert reports.report_by_option(t).count() == t.select(*reports.OPTION_KEYS).distinct().count()


def test_with_index_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    out = with_index(df, ["k"]).collect()
    assert sorted((r["index"], r.k) for r in out) == [(i, i) for i in range(1000)]


ROWS = ("codec string, ref_type string, outfile_bit_rate_kbs double, outfile_size_kbyte double, "
        "vmaf_mean double, vmaf_min double, stream_gop long, stream_has_b_frames long, stream_refs long, "
        "stream_frames_i long, stream_frames_p long, stream_frames_b long")


def test_chart_groups_pandas_semantics(spark):
    rows = [("b", "A", 2.0, 1.0, 90.0, 80.0, 10, 1, 2, 5, 6, 7),
            ("a", "A", 4.0, None, 92.0, 82.0, 20, 1, 2, 1, 9, 3),
            ("a", "A", 6.0, 3.0, 94.0, 84.0, 30, 1, 2, 2, 1, 4),
            (None, "A", 100.0, 100.0, 0.0, 0.0, 0, 0, 0, 99, 99, 99)]
    g = chart.chart_groups(spark.createDataFrame(rows, ROWS), ["codec", "ref_type"]).collect()
    assert [r.group for r in g] == ["a_A", "b_A"]                 # NULL key dropped, sorted
    assert g[0].outfile_size_kbyte == 3.0                          # NULL skipped in the mean
    assert g[0].stream_frames_i == 2 and g[0].stream_gop == 25.0
    with pytest.raises(ValueError):
        chart.chart_groups(spark.createDataFrame(rows, ROWS), [])


def test_codec_filter_empty_means_all(spark):
    df = spark.createDataFrame([("a",), ("b",)], "codec string")
    assert chart.codec_filter(df, []).count() == 2
    assert chart.codec_filter(df, ["a"]).count() == 1


def test_chart_axes(spark):
    empty = spark.createDataFrame([], "group string, outfile_bit_rate_kbs double")
    r = chart.chart_axes(empty).first()
    assert r.axis_max == pytest.approx(1.1) and r.initial_window == 10
    assert chart.chart_axes(empty, refreshed=False).first().axis_max == 1.0
    groups = spark.createDataFrame([(f"g{i}", float(i)) for i in range(15)], "group string, outfile_bit_rate_kbs double")
    r = chart.chart_axes(groups).first()
    assert r.axis_max == pytest.approx(14 * 1.1) and r.initial_window == 14


def test_frame_stack_order(spark):
    g = spark.createDataFrame([("g", 1, 2, 3)], "group string, stream_frames_i long, stream_frames_p long, stream_frames_b long")
    out = chart.frame_stack(g).orderBy("layer").collect()
    assert [(r.frame_type, r.frames) for r in out] == [("B-Frame", 3), ("P-Frame", 2), ("I-Frame", 1)]


def _numbered(df, order, nulls_last=False):
    rows = with_index(df, order, nulls_last=nulls_last, carry="v").collect()
    assert [r["index"] for r in sorted(rows, key=lambda r: r["index"])] == list(range(len(rows)))
    return [(r[order[0]], r.v, r.prev_v) for r in sorted(rows, key=lambda r: r["index"])]


@pytest.mark.parametrize("kind", ["hash", "counted", "number", "date", "few", "nulls"])
@pytest.mark.parametrize("nulls_last", [False, True])
def test_index_of_any_order(spark, kind, nulls_last):
    """Labels and the row before, against a plain sort; ranges are balanced where keys differ."""
    import datetime
    import hashlib
    make = {"hash": lambda i: hashlib.sha256(str(i % 700).encode()).hexdigest(), "counted": lambda i: f"trial-{i}",
            "number": lambda i: (i * 37) % 501 - 250.5, "date": lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i % 400),
            "few": lambda i: "ab"[i % 2], "nulls": lambda i: None if i % 3 else f"id{i}"}[kind]
    rows = [(make(i), i) for i in range(1000)]
    types = {"number": "double", "date": "date"}.get(kind, "string")
    df = spark.createDataFrame(rows, f"k {types}, v long").repartition(5)
    want = sorted(rows, key=lambda r: ((r[0] is None) == nulls_last, r[0] if r[0] is not None else 0, r[1]) if r[0] is not None
                  else (nulls_last, 0, r[1])) if kind != "nulls" else sorted(
        rows, key=lambda r: ((r[0] is None) if nulls_last else (r[0] is not None), r[0] or "", r[1]))
    got = _numbered(df, ["k", "v"], nulls_last)
    assert [(k, v) for k, v, _ in got] == want
    assert [p for _, _, p in got] == [None, *[v for _, v in want[:-1]]]


def test_index_ranges_are_balanced(spark):
    from trialgrid.operators import index
    for prefix in ("id", "a-long-prefix-that-all-ids-share/", ""):
        df = spark.range(20000).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"))
        number = index._as_number(df, "id")
        split = index._splitters(df, number)
        sizes = [r["count"] for r in df.groupBy(index._range_of(number, split, False)).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def test_index_of_an_empty_table(spark):
    assert with_index(spark.createDataFrame([], "k string, v long"), ["k"], carry="v").collect() == []


def test_a_rows_number_is_worked_out_once(spark):
    """The search tree of a text index names the number on every level; it must not be made anew on each."""
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("id")).repartition(8)
    plan = with_index(rows, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("conv(") <= 2  # where rows are numbered, and where ranges are counted


def test_texts_with_a_shared_prefix_are_cut_evenly(spark):
    rows = spark.range(4000).select(F.format_string("a-long-shared-prefix-%05d", F.col("id")).alias("id")).repartition(8)
    got = with_index(rows, ["id"]).orderBy("index").collect()
    assert [r.id for r in got] == sorted(r.id for r in got) and [r["index"] for r in got] == list(range(4000))
    per_range = with_index(rows, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in per_range
