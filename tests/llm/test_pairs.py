import random
import re

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import near_copies as N
from millrace.llm import overlap as O
from millrace.llm import shingles as S
from millrace.llm.bitmaps import bitmap, hashed_ids, id_hashes, within
from millrace.llm.near_copies import Digest, all_pairs, groups, near_copies
from millrace.llm.overlap import _meetings as meetings

KIND = "id bigint, content string, a int, b int, key string, runs string, n int, rep int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", "r", 3, 4, "d") for i, t in rows], KIND).repartition(3)


def runs_of(text, length=3, least=20):
    w = re.findall(r"[a-z0-9_]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + length]) for k in range(len(w) - length + 1)} if len(w) >= least else set()


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, texts = [], []
    for _ in range(40):
        texts.append([rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))])
    for t in list(texts):
        for _ in range(rng.randrange(0, 4)):
            u = list(t)
            for _ in range(rng.randrange(0, 8)):
                k = rng.randrange(len(u))
                if rng.random() < 0.5:
                    u[k] = rng.choice(vocabulary)
                else:
                    u.insert(k, rng.choice(vocabulary))
            texts.append(u)
    for k, t in enumerate(texts):
        rows.append((100 + k, rng.choice((" ", ", ", "\n\t")).join(t)))
    same = " ".join(f"same{k}" for k in range(30))
    rows += [(k, same.upper() if k % 2 else same) for k in range(8)]
    rows += [(50, None), (51, ""), (52, "too short"), (53, "é " * 300), (54, "x" * 200_000), (55, " ".join(["word"] * 50)), (56, "Word, " * 60)]
    rows += rows[:5] + rows[-4:]
    return rows


def test_words_and_runs_against_a_plain_reading():
    texts = [t for _, t in corpus()] + ["ÀB_9 c", "a" * 9 + "-" + "b" * 33, "\x00a\x00b", "tail", "head"]
    for r, e, data, at in S.blocks(pa.array(texts)):
        w = S.words(data, at)
        assert (r, e) == (0, len(texts))
        h, first = S.shingles(w, 3)
        u, f = S.distinct(h, first)
        for k, t in enumerate(texts):
            assert w.counts[k] == len(re.findall(r"[A-Za-z0-9_]+", t or ""))
            assert f[k + 1] - f[k] == len(runs_of(t, least=3))
    together = S.words(np.frombuffer(b"tail head", np.uint8), np.array([0, 9]))
    apart = S.words(np.frombuffer(b"tailhead", np.uint8), np.array([0, 4, 8]))
    assert (together.hashes == apart.hashes).all()


def test_long_words_differ():
    a, b = "z" * 5000 + "a", "z" * 5000 + "b"
    data = (a + b + a).encode()
    w = S.words(np.frombuffer(data, np.uint8), np.array([0, 5001, 10002, 15003]))
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]


def test_near_copies_against_all_pairs(spark):
    rows = corpus()
    how = Digest(threshold=0.7, run_words=3, least_words=20)
    found = near_copies(frame(spark, rows), how)
    got = {tuple(r) for r in all_pairs(found).collect()}
    sets = {i: s for i, t in rows if (s := runs_of(t))}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 60
    label = {r["id"]: r["group_id"] for r in groups(found).collect()}
    assert set(label) == set(sets)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in want:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert label == {i: top(i) for i in sets}
    assert found.members.count() == len(sets) and {r["rep"] for r in found.members.collect() if r["id"] < 8} == {0}


def test_long_lists_in_blocks_find_the_same(spark):
    rows = corpus(11)
    plain, blocks = (near_copies(frame(spark, rows), Digest(threshold=0.7, run_words=3, long_list=n, block=3)) for n in (10**6, 1))
    want = {tuple(r) for r in plain.links.collect()}
    assert {tuple(r) for r in blocks.links.collect()} == want and want


def test_a_chain_of_links_is_one_group(spark):
    words = [f"c{k}" for k in range(260)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(90)]
    found = near_copies(frame(spark, rows), Digest(threshold=0.7, run_words=3))
    assert {r["group_id"] for r in groups(found).collect()} == {0}


def test_empty_tables(spark):
    found = near_copies(frame(spark, []), Digest())
    assert all_pairs(found).count() == 0 and groups(found).count() == 0
    assert O.overlaps(frame(spark, []), frame(spark, corpus())).count() == 0
    assert O.overlaps(frame(spark, corpus()), frame(spark, [])).count() == 0


def test_minimum_is_the_binomial_tail():
    how = Digest(threshold=0.7)
    rng = np.random.default_rng(0)
    assert (rng.binomial(how.lists, 0.7**2, 200_000) < how.minimum).mean() < 5e-6 and how.minimum > 3
    assert Digest(threshold=0.9).minimum > Digest(threshold=0.8).minimum > how.minimum


def test_without_room_for_a_bitmap_and_with_split_runs_the_same_is_found(spark, monkeypatch):
    rows = corpus(5)
    df, how = frame(spark, rows), Digest(threshold=0.7, run_words=3)
    want = {tuple(r) for r in all_pairs(near_copies(df, how)).collect()}
    both = {tuple(r) for r in O.overlaps(df, df, O.Containment(0.8, 3, 20)).collect()}
    monkeypatch.setattr("millrace.llm.verify.bitmap", lambda hashes: None)
    monkeypatch.setattr("millrace.llm.overlap.bitmap", lambda hashes: None)
    monkeypatch.setattr("millrace.llm.overlap._meetings", lambda hits, index: meetings(hits, index, 3))
    monkeypatch.setattr("millrace.llm.near_copies.MEMBERS", 2)
    monkeypatch.setattr("millrace.shared.HOT_ROWS", 3)
    assert {tuple(r) for r in all_pairs(near_copies(df, how)).collect()} == want and len(want) > 60
    assert {tuple(r) for r in O.overlaps(df, df, O.Containment(0.8, 3, 20)).collect()} == both and both
    label = {r["id"]: r["group_id"] for r in groups(near_copies(df, how)).collect()}
    assert all(label[a] == label[b] for a, b in want)


def test_bitmaps(spark):
    ids = spark.range(3000).select("id")
    bits = bitmap(hashed_ids(ids))
    inside, outside = (within(bits.value, id_hashes(np.arange(a, a + 3000))) for a in (0, 10**6))
    assert inside.all() and outside.mean() < 0.2 and bitmap(hashed_ids(ids), 10) is None


@pytest.mark.parametrize("share", [0.8, 1.0])
def test_overlaps_against_all_pairs(spark, share):
    rows = corpus(7)
    evaluation, training = rows[::3], rows[1::3] + rows[2::3] + [(rows[0][0], rows[0][1])]
    rng = random.Random(2)
    training = training + [(1000 + k, " ".join(f"n{rng.randrange(999)}" for _ in range(80)) + " " + (t or "")) for k, (_, t) in enumerate(evaluation)]
    got = {tuple(r) for r in O.overlaps(frame(spark, evaluation), frame(spark, training), O.Containment(share, 3, 20)).select("eval_id", "train_id").collect()}
    e, t = ({i: s for i, x in side if (s := runs_of(x))} for side in (evaluation, training))
    want = {(a, b) for a in e for b in t if a != b and 10 * len(e[a] & t[b]) >= 10 * share * len(e[a])}
    assert got == want and len(want) > 30
