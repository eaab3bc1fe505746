"""Hot keys: one group holding most rows must give the same answers."""

from pyspark.sql import functions as F

from trialgrid.operators import frames, grid, select


def test_hot_file_segments_match_sequential(spark):
    # One file holds ~90% of frames, spread over many chunks; others are tiny.
    import random
    random.seed(7)
    seqs = {"hot": [random.choice("IPBBP?") for _ in range(5000)],
            "a": list("IPPB"), "b": list("PBI")}
    rows = [(f, i, t) for f, s in seqs.items() for i, t in enumerate(s)]
    df = spark.createDataFrame(rows, "file string, frame_no long, pict_type string").repartition(6)
    segs = frames.gop_segments(df, ["frame_no"], frames.frame_block(F.col("frame_no"), 97))
    got = {}
    for r in segs.orderBy("file", "seg").collect():
        got.setdefault(r.file, []).append(r.length)

    def sequential(seq):
        out, cur = [], 0
        for t in seq:
            if t == "I" and cur:
                out.append(cur)
                cur = 0
            cur += 1
        return out + ([cur] if cur else [])
    assert got == {f: sequential(s) for f, s in seqs.items()}


def test_hot_group_picks(spark):
    rows = [("c", "T", "A", f"-q {i % 50}", "p", "4", float(3000 - i), 0.8, 80.0, 95.0) for i in range(3000)]
    rows += [("d", "T", "A", "-q 1", "p", "4", 5.0, 0.8, 80.0, 95.0)]
    schema = ("codec string, type string, ref_type string, outfile_options string, preset string, threads string, "
              "outfile_size_kbyte double, comp_ratio_persent double, vmaf_min double, vmaf_mean double")
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = {r.codec: (r.outfile_size_kbyte, r.eligible) for r in select.threshold_candidates(df).collect()}
    assert got == {"c": (1.0, 3000), "d": (5.0, 1)}


def test_hot_id_latest(spark):
    rows = [("hot", i, f"v{i}") for i in range(5000)] + [("cold", 1, "x")]
    df = spark.createDataFrame(rows, "id string, seq long, v string").repartition(7)
    got = {r.id: r.v for r in grid.latest_by_id(df, ["seq"]).collect()}
    assert got == {"hot": "v4999", "cold": "x"}
