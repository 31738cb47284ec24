"""Pairing, one-hot, encoders and file jobs."""

import numpy as np
from pyspark.sql import functions as F

from data_dirs import SF1
from vecsight.operators import encoders as EN
from vecsight.operators import manifest as MF
from vecsight.sources import files as IO


def test_pairing_hand_example(spark):
    files = spark.createDataFrame([
        ("s1", "a__1.2.3__seg.dcm", None, "d/s1/a__1.2.3__seg.dcm"),
        ("s1", "img_1.2.3.dcm", None, "d/s1/img_1.2.3.dcm"),
        ("s1", "other.dcm", None, "d/s1/other.dcm"),
        ("s2", "a__9.9__seg.dcm", None, "d/s2/a__9.9__seg.dcm"),
        ("s2", "x.dcm", None, "d/s2/x.dcm"),
        ("s3", "a__7.7__seg.dcm", None, "d/s3/a__7.7__seg.dcm"),
        ("s3", "x1.dcm", "7.7", "d/s3/x1.dcm"),
        ("s3", "x2.dcm", "7.7", "d/s3/x2.dcm"),
        ("s4", "plain.dcm", None, "d/s4/plain.dcm"),
    ], "series_uid string, fname string, sop_uid string, fpath string")
    got = {r["series_uid"]: (r["fpath"], r["tier"], r["reject_reason"]) for r in MF.pair_files(files).collect()}
    assert got["s1"] == ("d/s1/img_1.2.3.dcm", 1, None)
    assert got["s2"] == ("d/s2/x.dcm", 2, None)
    assert got["s3"] == (None, None, "ambiguous")
    assert got["s4"] == (None, None, "annotation count")


def test_uid_pattern_wildcard_dot(spark):
    df = spark.createDataFrame([("a__1.2__segXdcm",), ("a__1__seg.dcm__2__seg.dcm",)], "fname string")
    got = [r[0] for r in df.select(MF.uid_of("fname")).collect()]
    assert got == ["1.2", None]


def test_one_hot(spark):
    pairs = spark.createDataFrame([(1, "x", "A"), (1, "x", "A"), (1, "x", "B"), (2, "y", "B")],
                                  "s int, i string, label string")
    got = sorted(tuple(r) for r in MF.one_hot(pairs, ["s", "i"], "label", ["A", "B"]).collect())
    assert got == [(1, "x", 1, 1), (2, "y", 0, 1)]


def test_drop_all_repeated_series(spark):
    ann = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "series_uid int, ann_id string")
    img = spark.createDataFrame([(1, "i1"), (2, "i2")], "series_uid int, im_id string")
    assert [r["series_uid"] for r in MF.manifest(ann, img).collect()] == [2]


def test_resize_interpolates_and_counts_every_pixel():
    ramp = np.arange(8, dtype=float)[None, :].repeat(4, 0)
    assert np.allclose(EN.resize_center_crop(ramp, 4), ramp[:, 2:6])  # the same size: only the cut
    wide = EN.resize_center_crop(ramp, 8)  # twice as large: quarters between neighbours, columns 4 to 11 of 16
    assert np.allclose(wide, np.arange(1.75, 5.5, 0.5)[None, :].repeat(8, 0))
    dot = np.zeros((9, 9))
    dot[4, 1] = 9.0  # a pixel that the nearest one would miss
    assert EN.resize_center_crop(dot, 3).sum() > 0.9
    assert np.allclose(EN.resize_weights(9, 3).sum(1), 1) and np.allclose(EN.resize_weights(9, 3)[1], [0, 0, 1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9, 0, 0])
    colour = np.stack([ramp, 2 * ramp], 2)
    assert np.allclose(EN.resize_center_crop(colour, 8)[:, :, 1], 2 * wide) and EN.resize_center_crop(colour, 8).shape == (8, 8, 2)


def test_resize_center_crop():
    img = np.arange(6 * 10).reshape(6, 10)
    out = EN.resize_center_crop(img, 4)
    assert out.shape == (4, 4)


def test_hashing_encoder_unit_and_deterministic():
    enc = EN.hashing_text_encoder(16)()
    a = enc(np.array(["a b c", "a b c", None], dtype=object))
    assert np.allclose(a[0], a[1]) and abs(np.linalg.norm(a[0]) - 1) < 1e-6 and not a[2].any()


def test_materialize_reuses_stage(spark):
    path = IO.scratch_dir(spark, "stage-test")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert IO.materialize(spark, path, build).count() == 5
    assert IO.materialize(spark, path, build).count() == 5
    assert len(calls) == 1


def test_ledger_append(spark):
    path = IO.scratch_dir(spark, "ledger")
    IO.append_ledger(spark.createDataFrame([("a",)], "obj_id string"), path)
    IO.append_ledger(spark.createDataFrame([("b",)], "obj_id string"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_keyed_csv_and_whole_text(spark):
    """A result with a named key column through CSV, read back; whole-file text."""
    from vecsight.operators.prevalence import prevalence_percent
    from vecsight.sources.tables import table
    root = IO.scratch_dir(spark, "keyed")
    prev = prevalence_percent(table(spark, SF1, "labels"), ["quality", "toxic"])
    IO.write_csv(prev.select("Label", "prevalence_pct").coalesce(1), root)
    back = IO.read_csv(spark, root, "Label STRING, prevalence_pct DOUBLE")
    assert sorted(r["Label"] for r in back.collect()) == ["quality", "toxic"]
    text = IO.read_text_whole(spark, root).where(F.col("path").endswith(".csv"))
    lines = text.select(F.explode(F.split("value", "\n")).alias("l")).where(F.col("l") != "").count()
    assert lines == 3


def test_hot_series_is_dropped_without_fan_out(spark):
    """One series holds a third of the annotation rows and many image rows: W1 drops it,
    and the plan joins only series that occur once on each side (no many-to-many join)."""
    ann = spark.range(0, 3000).select((F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id"))).alias("series_uid"),
                                      F.col("id").cast("string").alias("ann_id"))
    img = spark.range(0, 3000).select((F.when(F.col("id") < 500, F.lit(0)).otherwise(F.col("id"))).alias("series_uid"),
                                      F.concat(F.lit("i"), F.col("id").cast("string")).alias("im_id"))
    m = MF.manifest(ann, img)
    assert m.where("series_uid = 0").count() == 0
    assert m.count() == 2000          # series 1000..2999 occur once on both sides
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 2


def test_pairing_with_hot_series(spark):
    rows = [("hot", "a__5.5__seg.dcm", None, "d/hot/a__5.5__seg.dcm")]
    rows += [("hot", f"x{i}.dcm", None, f"d/hot/x{i}.dcm") for i in range(3000)]
    rows += [("hot", "img_5.5.dcm", None, "d/hot/img_5.5.dcm")]
    files = spark.createDataFrame(rows, "series_uid string, fname string, sop_uid string, fpath string")
    r = MF.pair_files(files).first()
    assert (r["fpath"], r["tier"], r["reject_reason"]) == ("d/hot/img_5.5.dcm", 1, None)


def test_explode_segment_labels(spark):
    df = spark.createDataFrame([("s", "u", ["A", "B"]), ("t", "v", ["A"])], "series_uid string, image_uid string, labels array<string>")
    rows = MF.explode_labels(df, ["series_uid", "image_uid"]).collect()
    assert sorted((r["series_uid"], r["label"]) for r in rows) == [("s", "A"), ("s", "B"), ("t", "A")]
