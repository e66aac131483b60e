import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import budget as B
from millrace.llm import containers as C
from millrace.llm import mixing as M
from millrace.llm import shingles as S
from millrace.llm.tokenizers import VOCABULARY, counter, token_counts

FOLDER = "/opt/tokenizers/"


def texts(n, seed=0):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gammaDelta", "x1", "0x3f", "{", "}", "==", "λx", "検証", "ключ", "กุญแจ", "\n", "    "]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(name):
    n = counter(FOLDER + name)(["", "hello world", "<|endoftext|>"])
    assert n[0] == 0 and 2 <= n[1] <= 3 and n[2] > 1


def test_count_rows(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "t")], "id bigint, text string, source string")
    out = {r["id"]: (r["source"], r["n_tokens"]) for r in token_counts(df, keep=["source"]).collect()}
    assert out == {1: ("s", 2), 2: (None, 0), 3: ("t", 0)}
    with pytest.raises(ValueError):
        counter("a.txt")


def test_features_against_a_plain_count():
    t = [*texts(30), "", "aB", "ab\n\n", "é"]
    for _, _, data, at in S.blocks(pa.array(t)):
        x = B.features(data, at)
        assert x.sum(1).tolist() == [len(s.encode()) for s in t]
        digits = x[:, [B._AT["digit"], B._AT["digit_start"]]].sum(1)
        assert digits.tolist() == [sum(c in "0123456789" for c in s) for s in t]
        assert x[:, B._AT["thai"]].tolist() == [sum("\u0e00" <= c < "\u0e80" for c in s) for s in t]


def test_budget(spark):
    t = texts(1500, 1)
    rows = [(k, ("a", "b", None, "rare%d" % k)[k % 3 if k % 50 else 3], s, 7) for k, s in enumerate(t)] + [(5000, "a", None, 7), (5001, "a", "", 7), (0, "a", t[0], 7)]
    df = spark.createDataFrame(rows, "id bigint, language string, text string, n_tokens int")
    how = B.Budget(fitted=150, held=150, tested=150)
    models = B.models(df, how)
    found = {r["label"]: r for r in models.collect()}
    assert {k for k, r in found.items() if r["own"]} == {"a", "b", None} and len(found) == 33
    assert [found[None][c] for c in ("n_fitted", "n_held", "n_tested")] == [150] * 3 and found["rare50"]["error"] is None
    assert all(0 < found[k]["error"] < 0.1 for k in ("a", "b", None))
    again = {r["label"]: (r["bias"], r["error"]) for r in B.models(df.repartition(7), how).collect()}
    assert again.keys() == found.keys() and math.isclose(again["a"][0], found["a"]["bias"], rel_tol=1e-9)
    out = {r["id"]: (r["n_bytes"], r["n_tokens"]) for r in B.estimates(df, models).collect()}
    true = counter(VOCABULARY)(t)
    assert len(out) == 1502 and out[5000] == (0, 0) == out[5001]
    assert abs(sum(n for _, n in out.values()) / sum(true) - 1) < 0.01
    assert np.mean([abs(out[k][1] - true[k]) for k in range(1500)]) / np.mean(true) < 0.05
    total = B.totals(B.estimates(df, models), df.withColumnRenamed("n_tokens", "n_bytes"), ["language"])
    assert total.agg(F.sum("n_texts")).first()[0] == 1502 and {r["language"] for r in total.collect()} >= {"a", "b", None}
    empty = df.limit(0)
    assert B.estimates(empty, B.models(empty, how)).count() == 0
    few = B.models(df.limit(20), how).collect()
    assert [(r["label"], r["n_held"], r["error"]) for r in few if r["own"]] == [(None, 0, None)]


def test_hilbert_neighbours_touch():
    shift = C.BITS - 2
    grid = np.array(np.meshgrid(*[range(4)] * C.DIMENSIONS)).reshape(C.DIMENSIONS, -1).T << shift
    order = grid[np.argsort(C.hilbert_keys(grid))] >> shift
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def check_containers(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r["container_id"], []).append((r["start_token"], r["piece_tokens"], r["id"]))
    for held in by.values():
        held.sort()
        assert sum(n for _, n, _ in held) <= capacity
        assert [s for s, _, _ in held] == [sum(n for _, n, _ in held[:k]) for k in range(len(held))]
    return by


def test_containers(spark):
    rng = random.Random(3)
    rows = [(k, "word " * rng.choice((0, 1, 5, 20, 60, 90, 300)), 3) for k in range(600)] + [(700, None, 3), (701, "", 3), (1, "word " * 5, 3)]
    df = spark.createDataFrame(rows, "id bigint, text string, key int").repartition(4)
    how = C.Packing(capacity=100)
    out = C.packed(df, how)
    got = out.collect()
    check_containers(got, 100)
    size = counter(VOCABULARY)
    want = {k: 0 for k, _, _ in rows}
    for k, t, _ in rows:
        want[k] += size([t or ""])[0]
    have = {}
    for r in got:
        have[r["id"]] = have.get(r["id"], 0) + r["piece_tokens"]
    assert have == want
    assert all(want[r["id"]] > 100 for r in got if r["piece"] > 0)
    full = C.fill(out, 100).first()
    assert full["n_items"] == len(rows) and full["used_share"] > 0.88, full
    assert tuple(C.broken(out, 100).first()) == (0, 0, 0)
    assert C.packed(df.limit(0), how).count() == 0 and C.fill(C.packed(df.limit(0), how), 100).first()["n_containers"] == 0


def test_containers_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 150)
    rows = [(k, t) for k, t in enumerate(texts(400, 9))]
    results = []
    for parts in (1, 3, 11):
        df = spark.createDataFrame(rows, "id bigint, text string").repartition(parts)
        results.append(sorted(map(tuple, C.packed(df, C.Packing(capacity=700)).collect())))
    assert results[0] == results[1] == results[2] and len({r[3] >> 32 for r in results[0]}) == 3


def test_filled_against_what_must_hold():
    rng = np.random.default_rng(2)
    for capacity in (1, 7, 64):
        sizes = rng.integers(0, 3 * capacity, 500)
        x = C.filled(sizes, C.Packing(capacity=capacity, ahead=12))
        total = np.zeros(500, int)
        np.add.at(total, x[:, 0], x[:, 2])
        assert (total == sizes).all() and x[:, 2].max() <= capacity
        assert np.bincount(x[:, 3], x[:, 2]).max() <= capacity
        assert (np.bincount(x[:, 0]) == np.maximum(1, -(-sizes // capacity))).all()
        first = [x[x[:, 3] == c, 0].min() for c in np.unique(x[:, 3])]
        assert len(first) == x[:, 3].max() + 1
    assert len(C.filled(np.zeros(0, int), C.Packing())) == 0


def test_alike_texts_lie_together(spark):
    df = spark.createDataFrame([(k, ("red apple pie " if k % 2 else "big green car ") * 9) for k in range(200)], "id bigint, text string")
    out = C.packed(df, C.Packing(capacity=300)).withColumn("kind", F.col("id") % 2)
    full = C.fill(out, 300, "kind").first()
    assert full["alike_share"] > 0.95 and abs(full["by_chance"] - 0.5) < 0.01


def test_wanted_tokens():
    got = M.wanted_tokens(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 20.0, "b": 500.0})
    assert got == {"a": 20.0, "b": 80.0, "c": 0.0}
    assert M.wanted_tokens(100, {"a": 1.0}, {"a": 60.0}) == {"a": 60.0} and M.wanted_tokens(0, {"a": 1.0}, {}) == {"a": 0.0}


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(("a", "a", "a", "b", "c", None)), rng.choice((0, 3, 40, 200, 1000)), 1) for k in range(3000)] + [(9000, "d", None, 1), (9001, "d", 50, 1)]
    df = spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint, copies int")
    targets = spark.createDataFrame([("a", 0.3, 2), ("b", 0.5, 8), ("d", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = M.mixed(df, targets)
    r = {x["source"]: x for x in report.collect()}
    total = sum(n or 0 for _, _, n, _ in rows)
    whole = sum(x["mix_tokens"] for x in r.values())
    assert abs(whole / total - 1) < 0.02 and r["none"]["mix_tokens"] == 0 and r["d"]["mix_tokens"] == 150
    assert math.isclose(r["a"]["mix_tokens"] / r["b"]["mix_tokens"], 0.3 / 0.5, rel_tol=0.02)
    limits = {"a": 2, "b": 8, "d": 3}
    got = mix.collect()
    assert all(1 <= x["copies"] <= limits[x["source"]] for x in got) and len({x["id"] for x in got}) == len(got)
    none, empty = M.mixed(df.limit(0), targets)
    assert none.count() == 0 and empty.count() == 4
    with pytest.raises(ValueError):
        M.mixed(df, targets.union(targets))
    with pytest.raises(RuntimeError):
        M.mixed(df, targets, M.Mixing(steps=1))


def test_rounding_comes_as_near_as_one_bin(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k, f"s{k % 40}", rng.randrange(1, 90)) for k in range(8000)], "id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(f"s{k}", 1 / 40, 3) for k in range(40)], "source string, target_share double, max_repeats int")
    _, report = M.mixed(df, targets)
    assert max(abs(r["mix_share"] * 40 - 1) for r in report.collect()) < 0.01
