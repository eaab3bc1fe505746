import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialgrid.functions import command, ids, paths, timefmt


def one(spark, col, data, schema):
    return spark.createDataFrame(data, schema).select(col.alias("x")).collect()


def test_format_seconds(spark):
    rows = one(spark, timefmt.format_seconds(F.col("s")), [(3661,), (0,), (90061,), (86400 * 3 + 59,)], "s long")
    assert [r.x for r in rows] == ["00d, 01h01m01s", "00d, 00h00m00s", "01d, 01h01m01s", "03d, 00h00m59s"]


def test_hms_truncates_and_wraps(spark):
    rows = one(spark, timefmt.hms(F.col("s")), [(90061.5,), (12.99,), (3599.999,), (0.0,)], "s double")
    assert [r.x for r in rows] == ["01:01:01", "00:00:12", "00:59:59", "00:00:00"]


def test_option_tokens(spark):
    rows = one(spark, command.option_tokens(F.col("o")), [("  -a  1 ",), ("",), ("-crf\t23",), (None,)], "o string")
    assert [r.x for r in rows] == [["-a", "1"], [], ["-crf", "23"], []]


def _command(spark, hw, opt, preset):
    df = spark.createDataFrame(
        [("4", hw, opt, "in.m2ts", "-crf 23  -g 10", "libx264", preset, "out/abc")],
        "threads string, hwaccels string, infile_option string, infile_filename string, "
        "outfile_options string, codec string, preset string, outfile_filename string")
    return df.select(command.command_line().alias("c")).first().c


def test_command_line_parts(spark):
    assert _command(spark, "", "", "none") == "ffmpeg -y -threads 4 -i in.m2ts -crf 23 -g 10 -c:v libx264 out/abc.mkv"
    assert _command(spark, "-hwaccel qsv", "-r 30", "slow") == (
        "ffmpeg -y -threads 4 -hwaccel qsv -r 30 -i in.m2ts -crf 23 -g 10 -c:v libx264 -preset:v slow out/abc.mkv")


def _py_ids(codec, typ, preset, option, threads, hw, inopt, basefile, basehash):
    id_opt = hashlib.sha256(str([f"{codec}{typ}{preset}{option}", f"{threads}{hw}{inopt}"]).encode()).hexdigest()
    return id_opt, hashlib.sha256(f"{basefile}{basehash}{id_opt}".encode()).hexdigest()


def test_trial_ids_match_python(spark):
    vals = ("libx264", "CRF", "medium", "-crf 23", "4", "", "", "./videos/source/A.m2ts", "ff00")
    df = spark.createDataFrame([vals], "c string, t string, p string, o string, th string, hw string, io string, bf string, bh string")
    r = df.select(ids.option_hash(*[F.col(c) for c in ["c", "t", "p", "o", "th", "hw", "io"]]).alias("opt")) \
          .select("opt", ids.trial_id(F.lit(vals[7]), F.lit(vals[8]), F.col("opt")).alias("id")).first()
    assert (r.opt, r.id) == _py_ids(*vals)


def test_trial_ids_refuse_quotes(spark):
    df = spark.createDataFrame([("lib'x", "t", "p", "o", "4", "", "")], "c string, t string, p string, o string, th string, hw string, io string")
    with pytest.raises(Exception, match="unsafe"):
        df.select(ids.option_hash(*[F.col(c) for c in df.columns])).collect()


def test_output_path(spark):
    df = spark.createDataFrame([("cfg/sweep.yml", "abcdef0123456789")], "f string, i string")
    r = df.select(ids.output_path(ids.distdir_of(F.col("f")), F.col("i")).alias("p")).first()
    assert r.p == "./videos/dist/sweep/abcdef012345"


PATH_CASES = ["./videos/source/A.m2ts", "clip", "a.b/c", "dir/.hidden", "x.m2ts/y.m2ts", "a/b.tar.gz", "", "v1.0/clip.mkv"]


def _py_suffix(p):
    from pathlib import PurePosixPath
    return PurePosixPath(p).suffix if p else ""


def test_side_suffix_matches_python(spark):
    df = spark.createDataFrame([(p,) for p in PATH_CASES], "p string")
    got = [r.x for r in df.select(paths.with_side_suffix(F.col("p"), "_ffprobe.json").alias("x")).collect()]
    want = [p.replace(_py_suffix(p), "_ffprobe.json", 1) for p in PATH_CASES]
    assert got == want


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab.json/", max_size=14))
def test_replace_first_matches_python(spark, text):
    df = spark.createDataFrame([(text,)], "p string")
    got = df.select(paths.replace_first(F.col("p"), F.lit(".json"), F.lit("_all.csv")).alias("x")).first().x
    assert got == text.replace(".json", "_all.csv", 1)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_means_and_sums_are_exact_in_any_order(spark, partitions):
    """Against exact fractions: one rounding of the sum, one of the mean, whatever the order and the partitions."""
    import math
    import random
    from fractions import Fraction
    from trialgrid.functions.metrics import exact_avg, exact_sum, sql_round
    rng = random.Random(8)
    values = [rng.choice([rng.uniform(-1e6, 1e6), round(rng.uniform(0, 100), 2), 1e15 + 0.5, -1e15, 0.1, 667.5, None]) for _ in range(3000)]
    real = [v for v in values if v is not None]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)
    total, mean, rounded = df.agg(exact_sum(F.col("x")), exact_avg(F.col("x")), sql_round(exact_avg(F.col("x")), 3)).first()
    want = sum(map(Fraction, real))
    assert abs(Fraction(total) - want) <= Fraction(math.ulp(total)) and mean == total / len(real)
    assert total == float(math.fsum(real)) and rounded == round(mean, 3)
    odd = spark.createDataFrame([(float("nan"),), (1.0,)], "x double").agg(exact_avg(F.col("x"))).first()[0]
    assert math.isnan(odd)
    assert spark.createDataFrame([], "x double").agg(exact_sum(F.col("x")), exact_avg(F.col("x"))).first()[:] == (None, None)
    assert spark.createDataFrame([(1e300,), (1e300,)], "x double").agg(exact_avg(F.col("x"))).first()[0] == 1e300


def test_reports_are_equal_under_three_partitionings(spark, sf_dir):
    """Every rounded mean of the summaries, with rows in other orders and partitions: no digit moves."""
    from trialgrid.operators import reports, summary
    from trialgrid.sources.tables import trials_from_tables
    trials = trials_from_tables(spark, sf_dir)
    found = []
    for n, order in ((1, "id"), (3, "enc_sec"), (7, "outfile_size_kbyte")):
        report = reports.report_by_type(trials.repartition(n).sortWithinPartitions(order), index=False)
        found.append((sorted(map(tuple, report.collect())), sorted(map(str, summary.summary_by_codec(report).collect())),
                      sorted(map(str, summary.summary_by_ref(report).collect()))))
    assert found[0] == found[1] == found[2]


def test_time_texts_are_those_of_a_formatter(spark):
    rows = [(0.0,), (59.999,), (86399.0,), (8640000.5,), (86400.0 * 123456,), (-0.5,), (-3661.0,), (None,)]
    s = F.floor(F.col("s")).cast("bigint")
    part = [F.floor(s / 3600) % 24, F.floor((s % 3600) / 60), s % 60]
    hms = F.format_string("%02d:%02d:%02d", *[p.cast("bigint") for p in part])
    part = [F.floor(s / 86400), F.floor((s % 86400) / 3600), F.floor((s % 3600) / 60), s % 60]
    long = F.format_string("%02dd, %02dh%02dm%02ds", *[p.cast("bigint") for p in part])
    got = spark.createDataFrame(rows, "s double").select(timefmt.hms("s").alias("a"), hms.alias("b"), timefmt.format_seconds("s").alias("c"), long.alias("d"))
    assert all(r.a == r.b and r.c == r.d for r in got.collect())
