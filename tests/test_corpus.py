import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_module
from millrace.functions.draws import uniform
from millrace.operators import metrics
from millrace.operators.split import head, of_filetypes, of_set, sft_split, shuffled, split_by_filetype
from millrace.operators.stats import report
from millrace.plans.pipelines import Packer, pretrain_corpus, sft_files
from millrace.plans.queries import QUERIES, SQL
from millrace.shared import bounded, cut, looked_up, release, shared_folder, small
from millrace.sources.jsonl import CORPUS, read_jsonl, require_columns, write_jsonl
from millrace.streaming.packing import pack_stream, read_stream

CORPUS_KIND = "id bigint, set string, filetype string, content string, n int, rank int, draw int, slice int, part_start int"


def rows(spark, sizes, set_name="unsupervised"):
    out, k = [], 0
    for ft, n in sizes.items():
        for _ in range(n):
            out.append((k, set_name, None if ft == "null" else ft, f"text {k}", 1, 2, 3, 4, 5))
            k += 1
    return spark.createDataFrame(out, CORPUS_KIND).repartition(3)


def sizes(df, by="filetype"):
    return {(r[by], r["split"]): r["count"] for r in df.groupBy(by, "split").count().collect()}


def test_split_sizes(spark):
    df = rows(spark, {"cry": 83, "saw": 11, "txt": 10, "py": 40, "null": 5})
    out = split_by_filetype(df)
    assert sizes(out) == {("cry", "test"): 9, ("cry", "train"): 74, ("saw", "test"): 2, ("saw", "train"): 9, ("txt", "test"): 1, ("txt", "train"): 9}
    assert set(df.columns) < set(out.columns) and out.select("n").distinct().collect()[0][0] == 1
    again = split_by_filetype(df.repartition(9)).collect()
    assert {(r["id"], r["split"], r["split_draw"]) for r in again} == {(r["id"], r["split"], r["split_draw"]) for r in out.collect()}
    assert {(r["id"]) for r in split_by_filetype(df, seed=1).where("split = 'test'").collect()} != {r["id"] for r in again if r["split"] == "test"}
    twice = split_by_filetype(df, filetypes=("cry", "absent", "cry"))
    assert twice.count() == 166 and {r["place"] for r in twice.collect()} == {0, 2}


def test_repeated_rows_are_split_to_exact_sizes(spark):
    df = rows(spark, {"cry": 3, "saw": 7}).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(9))))
    got = sizes(split_by_filetype(df.drop("again")))
    assert got == {("cry", "test"): 3, ("cry", "train"): 24, ("saw", "test"): 7, ("saw", "train"): 56}


def test_split_guards(spark):
    with pytest.raises(ValueError):
        split_by_filetype(rows(spark, {"py": 4}))
    with pytest.raises(ValueError):
        split_by_filetype(rows(spark, {"cry": 1}))
    with pytest.raises(ValueError):
        of_set(rows(spark, {"cry": 1}).drop("set"), "supervised", strict=True)
    assert of_set(rows(spark, {"cry": 1}).drop("set"), "supervised").count() == 0
    with pytest.raises(ValueError):
        require_columns(rows(spark, {"cry": 1}), ["content", "absent"])
    assert of_filetypes(rows(spark, {"cry": 2, "CRY": 3, "null": 1})).count() == 2


def test_sft_split_sizes(spark):
    df = rows(spark, {"a": 1, "b": 2, "c": 19, "d": 20, "null": 46}, "supervised")
    got = sizes(sft_split(df))
    assert got == {("a", "train"): 1, ("b", "train"): 1, ("b", "val"): 1, ("c", "train"): 18, ("c", "val"): 1, ("d", "train"): 19, ("d", "val"): 1, (None, "train"): 43, (None, "val"): 3}
    order = shuffled(sft_split(df), group="split").collect()
    for s in ("train", "val"):
        assert sorted(r["ord"] for r in order if r["split"] == s) == list(range(sum(r["split"] == s for r in order)))
    assert [r["id"] for r in head(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert sft_split(df.limit(0)).count() == 0


def test_draws_are_even(spark):
    out = spark.range(4000).select(uniform(1, "x", "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= out[0] < 0.01 and 0.99 < out[1] < 1 and abs(out[2] - 0.5) < 0.02


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("ä b", "supervised", None), (None, "x", "cry")], CORPUS)
    write_jsonl(df, str(tmp_path / "out"), 1)
    text = next((tmp_path / "out").glob("part*")).read_text("utf-8")
    assert "ä" in text and json.loads(text.split("\n")[0])["filetype"] is None
    assert sorted(map(str, read_jsonl(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.jsonl").write_text('{"content": "a"}\n\n   \n{"content": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    assert read_jsonl(spark, str(tmp_path / "bad.jsonl"), strict=False).where("content = 'a'").count() == 1
    assert read_jsonl(spark, str(tmp_path / "out"), None).columns == ["content", "filetype", "set"]


def test_metrics(spark):
    data = [("r", 1, 3.0), ("r", 2, 2.0), ("r", 2, 2.5), ("r", 3, float("nan")), ("r", 4, 2.0), ("r", 5, 1.0), ("r", 6, None), ("s", 1, float("nan")), ("s", 2, float("nan")), ("t", 1, 0.0)]
    df = spark.createDataFrame(data, "run_id string, global_step bigint, eval_loss double")
    best = {(r["run_id"], r["place"]): r["global_step"] for r in metrics.best_checkpoints(df).collect()}
    assert best[("r", 1)] == 5 and best[("r", 2)] == 2 and best[("t", 1)] == 1
    stop = {r["run_id"]: (r["best_step"], r["best_loss"], r["stop_step"]) for r in metrics.early_stops(df).collect()}
    assert stop == {"r": (5, 1.0, 4), "s": (None, None, 2), "t": (1, 0.0, None)}
    p = spark.createDataFrame([(0.0,), (19.999,), (20.0,), (float("nan"),), (None,)], "eval_loss double")
    got = [r["perplexity"] for r in metrics.with_perplexity(p).collect()]
    assert got[0] == 1 and got[1] == pytest.approx(math.exp(19.999)) and got[2:] == [math.inf, math.inf]
    named = metrics.metric_rows(df.withColumn("train_epoch", F.lit(1.0)))
    assert named.columns == ["train/global_step", "train/epoch", "eval/loss", "eval/perplexity"] and named.count() == 9


def test_early_stops_of_long_runs_against_a_plain_model(spark):
    rng = random.Random(8)
    data = [(run, s, rng.choice((float("nan"), rng.uniform(0, 9)))) for run, n in (("a", 900), ("b", 40), ("c", 1)) for s in range(n)]
    df = spark.createDataFrame(data + data[:50] + [(None, 1, 1.0)], "run_id string, global_step bigint, eval_loss double").repartition(5)
    got = {r["run_id"]: (r["best_step"], r["best_loss"], r["stop_step"]) for r in metrics.early_stops(df, patience=7, threshold=0.01).collect()}
    for run in "abc":
        best, last, stop, at = math.inf, -1, None, None
        for r, s, x in data:
            if r != run:
                continue
            if not math.isnan(x) and (best == math.inf or x < best - 0.01):
                last = s
            if not math.isnan(x) and x < best:
                best, at = x, s
            if stop is None and s - last >= 7:
                stop = s
        assert got[run] == (at, None if at is None else best, stop)
    assert set(got) == {"a", "b", "c"} and metrics.early_stops(df.limit(0)).count() == 0


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)] + [(None, 5)], "key bigint, n bigint").repartition(4)
    right = spark.createDataFrame([(k, k * 2) for k in range(2000)], "key bigint, twice bigint")
    want = sorted(map(tuple, left.join(right, "key").select("key", "n", "twice").collect()))
    for hot in (None, 100, 10**9):
        assert sorted(map(tuple, looked_up(left, right, "key", hot).select("key", "n", "twice").collect())) == want
    assert bounded(right, "right").count() == 2000 and looked_up(left.limit(0), right, "key").count() == 0


def test_report_and_supervised_files(spark, tmp_path):
    counted = spark.createDataFrame([(10, 4), (None, None), (0, 0)], "c int, t int")
    got = {r["name"]: r["value"] for r in report(counted, "c", "t", 4).collect()}
    assert got == {"rows": 3, "characters": 10, "tokens": 4, "chars_per_token": 2.5, "estimated_windows": 1}
    assert math.isnan({r["name"]: r["value"] for r in report(counted.limit(0), "c", "t", 4).collect()}["chars_per_token"])
    train, val = sft_files(rows(spark, {"a": 40, "null": 5}, "supervised"), str(tmp_path / "sft"))
    assert train.count() == 42 and val.count() == 3 and {r["filetype"] for r in train.union(val).collect()} == {"a", None}


def test_written_tables(spark):
    df = cut(spark.range(5), "five")
    path = df.inputFiles()[0]
    assert shared_folder(spark).removeprefix("file://") in path and shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert small(df).count() == 5 and release(spark) >= 1 and release(spark) == 0
    assert not os.path.exists(path.removeprefix("file://"))


def test_stream(spark, tmp_path):
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType())])
    for k in range(3):
        spark.createDataFrame([(10 * k + j, "some text " * j) for j in range(5)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), kind, "parquet")
    pack_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), Packer(seq_length=32), ["id"]).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() == 3 and out.where("size(input_ids) <> 32").count() == 0


def test_pipeline(spark):
    df = rows(spark, {"cry": 40, "saw": 12})
    train, test = pretrain_corpus(df, seq_length=64, sequences=4)
    assert train.where("size(labels) <> 64").count() == 0 and test.count() > 0
    plan = train._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # tokens are read, not made again
    lists = df.withColumn("tokens", F.array(F.col("id"), F.lit(7)).cast("array<bigint>"))
    once, twice = (pretrain_corpus(lists, 8, 2, fim_rate=0.0, overlap=0.0, content="tokens", already_tokenized=True, epochs=e)[0] for e in (1, 2))
    count = lambda made: made.select(F.sum(F.size(F.filter("input_ids", lambda x: x == 7)))).first()[0]
    assert count(twice) == 2 * count(once) > 0
    with pytest.raises(ValueError):
        pretrain_corpus(df, content="absent")


def test_entry_lists_queries():
    assert set(SQL) <= set(QUERIES) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())
