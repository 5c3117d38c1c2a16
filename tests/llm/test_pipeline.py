
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atticwork.llm import line_dedup, ngram_join, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(base / str(i)))
        docs = spark.read.parquet(str(base / str(i)))
        out.append(docs)
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing_sources", "best_fit_packing"]
    for df in stages[:-1]:
        assert df.columns == COLUMNS


def test_rejects_go_and_good_texts_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r.quality: r.share for r in rows}
    assert share[1] > 0.97 and share[0] < 0.3


def test_lines_and_copies(stages):
    assert stages[2].count() == stages[1].count()
    assert line_dedup.query(stages[2]).agg(F.sum("n_dropped")).first()[0] == 0
    groups = ngram_join.link_components(stages[2]).where("n_shingles > 0")
    alone = stages[2].count() - groups.count()
    assert stages[3].count() == groups.select("component_id").distinct().count() + alone
    assert stages[3].where("n_chars <> char_length(text)").count() == 0


def test_mix_repeats_rows(stages):
    per = stages[4].groupBy("doc_id").count()
    assert per.agg(F.max("count")).first()[0] <= 3
    assert stages[4].join(stages[3], COLUMNS, "left_anti").count() == 0


def test_packing_holds_every_token(stages):
    places = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert places.where("n <> m OR n > 1024").count() == 0
    lengths = packing.token_pieces(stages[4]).agg(F.sum("length"), F.count("*")).first()
    assert tuple(stages[5].agg(F.sum("length"), F.count("*")).first()) == tuple(lengths)
    assert stages[5].where("piece = 0").count() == stages[4].count()


def test_packed_ids_are_those_of_the_mixed_texts(stages):
    assert stages[5].where("ids IS NULL OR length(ids) <> 4 * length OR crc32(ids) <> ids_crc32").count() == 0
    columns = ["doc_id", "piece", "start", "ids"]
    wanted = packing.token_pieces(stages[4].select("doc_id", "text")).select(columns)
    assert stages[5].select(columns).exceptAll(wanted).count() == 0
    assert wanted.exceptAll(stages[5].select(columns)).count() == 0


def test_run_and_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, "no id here", None, None, None), (10**9, None, "en", "src1", None), (10**9 + 1, "", None, "src1", 0), (10**9 + 1, "", None, "src1", 0), (10**9 + 2, "word " * 60_000, "en", None, 300_000)],
        docs.select(*COLUMNS).schema,
    )
    docs.select(*COLUMNS).unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
