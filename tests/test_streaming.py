"""The scoring operator over a file stream gives the batch result."""

from data_dirs import SF1
from vecsight.plans import inputs as I
from vecsight.sources import files as IO
from vecsight.streaming.scoring import library_stream, start_scoring


def test_stream_scoring_equals_batch(spark):
    src = IO.scratch_dir(spark, "stream-src")
    out = IO.scratch_dir(spark, "stream-out")
    corpus = I.corpus(spark, SF1).select(*I.ID_COLS, "embedding")
    corpus.where("dicom_id % 2 = 0").write.parquet(src + "/a")
    corpus.where("dicom_id % 2 = 1").write.parquet(src + "/b")
    stream = library_stream(spark, src + "/*", corpus.schema)
    q = start_scoring(stream, I.prompts(spark, SF1), I.ID_COLS, out, "test-" + src.rsplit("-", 1)[1],
                      measures=("max_cosine_similarity",), trigger_once=True)
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == corpus.count() * 10


def test_stream_restart_scores_only_new_files(spark):
    src = IO.scratch_dir(spark, "stream-src2")
    out = IO.scratch_dir(spark, "stream-out2")
    name = "restart-" + src.rsplit("-", 1)[1]
    corpus = I.corpus(spark, SF1).select(*I.ID_COLS, "embedding")
    corpus.where("dicom_id % 2 = 0").write.parquet(src + "/a")

    def run():
        q = start_scoring(library_stream(spark, src + "/*", corpus.schema), I.prompts(spark, SF1),
                          I.ID_COLS, out, name, measures=("max_cosine_similarity",), trigger_once=True)
        q.awaitTermination()

    run()
    first = spark.read.parquet(out).count()
    run()                                   # same checkpoint, nothing new: nothing added
    assert spark.read.parquet(out).count() == first
    corpus.where("dicom_id % 2 = 1").write.parquet(src + "/b")
    run()                                   # only the new file is scored
    got = spark.read.parquet(out)
    assert got.count() == corpus.count() * 10
    assert got.groupBy("dicom_id", "label").count().where("count > 1").count() == 0
