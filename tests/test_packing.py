import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.tokens import BEYOND, SpecialTokens, codepoints, enclosed, file_special, registry, resolved, vocabulary_file, vocabulary_text
from millrace.operators.buffers import assign_buffers, budget
from millrace.operators.fim import permute, permuted
from millrace.operators.pack import batches, offsets, shuffled_windows, stride, windows
from millrace.operators.stats import actual_length, chars_token_ratio, estimated_length
from millrace.plans.pipelines import Packer, examples
from millrace.sources.jsonl import replayed, with_ordinals

SPECIAL = SpecialTokens(eos=9, pad=0)


def stream(spark, docs, buf=0):
    rows = [(k, d, buf) for k, d in enumerate(docs)]
    return spark.createDataFrame(rows, "ord bigint, tokens array<bigint>, buf bigint")


def packed(spark, docs, size, overlap, special=SPECIAL):
    made = windows(offsets(stream(spark, docs), special), size, special, overlap)
    return [(r["input_ids"], r["labels"]) for r in made.orderBy("win").collect()]


@pytest.mark.parametrize(
    "overlap, ids, last",
    [
        (0.0, [[1, 2, 3, 9], [4, 9, 9, 0]], [4, 9, 9, -100]),
        (0.5, [[1, 2, 3, 9], [3, 9, 4, 9], [4, 9, 9, 0], [9, 0, 0, 0]], [9, -100, -100, -100]),
        (-0.5, [[1, 2, 3, 9], [9, 0, 0, 0]], [9, -100, -100, -100]),
    ],
)
def test_windows_by_hand(spark, overlap, ids, last):
    out = packed(spark, [[1, 2, 3], [4], []], 4, overlap)
    assert [x for x, _ in out] == ids and out[-1][1] == last


def test_full_overlap_moves_by_one(spark):
    out = packed(spark, [[1, 2, 3], [4], None], 4, 1.0)
    assert len(out) == 7 and out[6] == ([9, 0, 0, 0], [9, -100, -100, -100])


def test_pad_that_is_end_of_text_is_masked(spark):
    out = packed(spark, [[1, 2, 3], [4], []], 4, 0.0, SpecialTokens(eos=9))
    assert out == [([1, 2, 3, 9], [1, 2, 3, -100]), ([4, 9, 9, 9], [4, -100, -100, -100])]


def test_windows_against_a_plain_model(spark):
    rng = random.Random(5)
    for size, overlap in ((5, 0.0), (7, 0.3), (4, 1.5), (6, -0.7)):
        docs = [[rng.randrange(10, 99) for _ in range(rng.choice((0, 1, 3, 20)))] for _ in range(30)]
        flat = [t for d in docs for t in [*d, 9]]
        s = stride(size, overlap)
        model = [flat[k : k + size] + [0] * (size - len(flat[k : k + size])) for k in range(0, len(flat), s)]
        assert [x for x, _ in packed(spark, docs, size, overlap)] == model
        placed = offsets(stream(spark, docs), SPECIAL)
        assert actual_length(placed, size, overlap).first()["actual"] == len(model)
        assert estimated_length(stream(spark, docs), size, overlap).first()["estimated"] == max(1, -(-sum(map(len, docs)) // s))


def greedy(sizes, most):
    out, buf, open_ = [], 0, 0
    for x in sizes:
        if open_ >= most:
            buf, open_ = buf + 1, 0
        out.append(buf)
        open_ += x
    return out


def test_greedy_buffers(spark):
    rng = random.Random(1)
    cases = [([9, 9, 9, 9], 10), ([5, 7, 1, 9, 2], 10), ([0, 0, 0], 1), ([100], 3), ([], 4)]
    cases += [([rng.choice((0, 0, 1, 2, 5, 40)) for _ in range(rng.randrange(1, 200))], rng.choice((1, 7, 33.5))) for _ in range(6)]
    for sizes, most in cases:
        df = spark.createDataFrame([(k, x) for k, x in enumerate(sizes)], "k bigint, units bigint").repartition(3)
        out = assign_buffers(with_ordinals(df, ["k"]), most, "units").orderBy("ord").collect()
        assert [r["buf"] for r in out] == greedy(sizes, most), (sizes, most)
    with pytest.raises(ValueError):
        assign_buffers(with_ordinals(df, ["k"]), 0, "units")
    assert {r["buf"] for r in assign_buffers(with_ordinals(df, ["k"]), float("nan"), "units").collect()} == {0}
    with pytest.raises(ValueError):
        budget(0, 3.6, 4)


def test_buffers_of_few_rows_find_the_same(spark, monkeypatch):
    df = with_ordinals(spark.createDataFrame([(k, k % 5) for k in range(300)], "k bigint, units bigint").repartition(3), ["k"])
    want = greedy([k % 5 for k in range(300)], 4)
    for few in (0, 1000):
        monkeypatch.setattr("millrace.operators.buffers.FEW_BOUNDS", few)
        assert [r["buf"] for r in assign_buffers(df, 4, "units").orderBy("ord").collect()] == want


def test_ordinals_and_replay(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(100)], "a int, ord_at bigint").repartition(5).withColumnRenamed("ord_at", "b")
    out = with_ordinals(df, ["a", "b"]).orderBy("ord").collect()
    assert [r["ord"] for r in out] == list(range(100)) and [(r["a"], r["b"]) for r in out] == sorted((k % 7, k) for k in range(100))
    twice = replayed(with_ordinals(df, ["b"]), 2, replicas=3)
    assert twice.count() == 600 and twice.agg(F.max("ord")).first()[0] == 199
    with pytest.raises(ValueError):
        replayed(with_ordinals(df.limit(0), ["b"]), 2)


P, S, M = BEYOND.prefix, BEYOND.suffix, BEYOND.middle


@pytest.mark.parametrize(
    "sample, low, high, spm, cut, out",
    [
        ([1, 2, 3, 4, 5], 1, 3, False, False, [P, 1, S, 4, 5, M, 2, 3]),
        ([1, 2, 3, 4, 5], 1, 3, True, False, [P, S, 4, 5, M, 1, 2, 3]),
        ([1, 2, 3, 4, 5], 1, 3, False, True, [1, 2, 3, 4, 5]),
        ([1, 2, 3, 4, 5, 6, 7, 8], 1, 3, False, True, [P, 1, S, 4, 5, M, 2, 3]),
        ([], 0, 0, False, False, [P, S, M]),
        ([], 0, 0, True, False, [P, S, M]),
    ],
)
def test_permutation_by_hand(spark, sample, low, high, spm, cut, out):
    df = spark.createDataFrame([(sample, low, high)], "t array<bigint>, a int, b int")
    got = df.select(permuted(F.col("t"), F.col("a"), F.col("b"), F.lit(spm), BEYOND, cut)).first()[0]
    assert got == out


def test_permutation_keeps_all_tokens(spark):
    df = spark.createDataFrame([(k, [k] * (k % 5) + [7]) for k in range(400)] + [(None, None)], "id bigint, t array<bigint>")
    out = df.select("id", "t", permute(F.col("t"), "id", BEYOND, 0.5, 0.5, seed=3).alias("o")).collect()
    changed = [r for r in out if r["o"] != r["t"]]
    assert all(sorted(r["o"]) == sorted(r["t"] + [P, S, M]) for r in changed) and 150 < len(changed) < 250
    again = df.repartition(7).select("id", permute(F.col("t"), "id", BEYOND, 0.5, 0.5, seed=3).alias("o")).collect()
    assert {r["id"]: r["o"] for r in again} == {r["id"]: r["o"] for r in out}
    assert df.select(permute(F.col("t"), "id", SpecialTokens(eos=1), 1.0)).collect() == df.select("t").collect()


def test_codepoints_and_ratio(spark):
    df = spark.createDataFrame([("aé😀\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(codepoints(F.col("t"))).collect()] == [[97, 233, 128512, 10], [], []]
    x = spark.createDataFrame([("ab", [1]), ("cde", [1, 2, 3, 4])], "content string, tokens array<bigint>")
    assert chars_token_ratio(x).first()["ratio"] == 1.0
    ratio = chars_token_ratio(x.limit(0)).first()["ratio"]
    assert ratio != ratio
    assert chars_token_ratio(x.select(F.lit("").alias("content"), F.array().cast("array<bigint>").alias("tokens")).limit(1)).first()["ratio"] == 0.0


def test_registry(spark):
    rows = [(1, "eos"), (None, "pad"), (3, "unk"), (3, "prefix")]
    r = registry(spark.createDataFrame(rows, "token_id bigint, token_role string"))
    assert r.padding == 1 and not r.can_permute
    done = r.completed(50)
    assert done.sentinels() == (50, 51, 52, 53) and done.can_permute
    with pytest.raises(ValueError):
        registry(spark.createDataFrame([(None, "eos")], "token_id bigint, token_role string"))


def test_sentinels_by_name():
    given = SpecialTokens(eos=1, unk=3)
    found = resolved(given, {"<|fim_prefix|>": 9, "<|fim_middle|>": 3}.get, 50)
    assert found.sentinels() == (50, 9, 51, 52) and found.eos == 1
    file = file_special("/opt/tokenizers/byte_bpe_50k.json", "<|endoftext|>")
    assert file.eos == file.padding == 50256 and file.sentinels() == (50257, 50258, 50259, 50260)
    with pytest.raises(ValueError):
        file_special("/opt/tokenizers/byte_bpe_50k.json", "absent")


def test_plug_in_tokenizer_there_and_back(spark):
    texts = ["hello <|endoftext|> wörld", "", None, "x " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    there, back = vocabulary_file("/opt/tokenizers/byte_bpe_50k.json", names_are_text=True), vocabulary_text("/opt/tokenizers/byte_bpe_50k.json")
    assert [r[0] for r in df.select(back(there(F.col("t")))).collect()] == [t or "" for t in texts]
    assert [r[0] for r in df.select(enclosed(codepoints, 5, None)(F.col("t"))).collect()][1:3] == [[5], [5]]


def test_examples_do_not_depend_on_partitions(spark):
    rows = [(k, "text %d " % k * (k % 9)) for k in range(60)]
    how = Packer(seq_length=16, num_of_sequences=4, chars_per_token=2.0, overlap_ratio=0.25)
    results = []
    for parts in (1, 4, 40):
        df = with_ordinals(spark.createDataFrame(rows, "id bigint, content string").repartition(parts), ["id"])
        made = examples(df, how)
        results.append(sorted((r["buf"], r["win"], r["input_ids"]) for r in made.collect()))
    assert results[0] == results[1] == results[2]
    a, b = (shuffled_windows(made, 1, epoch).orderBy("buf", "place").collect() for epoch in (0, 1))
    assert sorted(map(str, a)) != sorted(map(str, b)) and len(a) == len(b)
    step = batches(with_ordinals(made.select("buf", "win"), ["buf", "win"]), 5, 2).orderBy("ord").collect()
    assert [(r["batch"], r["step"]) for r in step[:11]] == [(k // 5, k // 10) for k in range(11)]
