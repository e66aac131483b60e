import hashlib
import random

import pytest

from millrace.llm.pieces import broken, cut_places, pieces

KIND = "id bigint, content string, piece int, text string, start_pos int"


def check(text, limit, overlap):
    found, longest = cut_places(text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (s, e, kind), (s2, e2, _) in zip(found, found[1:]):
        assert s2 == e - overlap and e < e2 and text[e - 1 : e + 1] != "\r\n"
    assert all(0 < e - s <= limit for s, e, _ in found)
    return found, longest


def test_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(("word ", "longerword ", "x", "\n", "\r\n", "\r", "\n\n", ". ", "é", "😀", "def f():\n")) for _ in range(rng.randrange(30, 400)))
        limit = rng.randrange(20, 90)
        overlap = rng.randrange(0, limit // 2)
        if len(text) <= limit:
            continue
        found, longest = check(text, limit, overlap)
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert longest == max(map(len, lines))
        if all(len(x) + 2 <= (limit - overlap) for x in lines):
            assert all(text[e - 1] in "\r\n" for _, e, _ in found[:-1])


def test_a_wide_blank_line_is_blank():
    text = "a" * 60 + "\n" + " " * 300 + "\n" + "b" * 100
    found, _ = cut_places(text, 400, 0)
    assert found[0][1] == 362 and found[0][2] >= 5


def test_targets_are_placed_over_the_whole_text():
    lines = "".join(f"line number {k:05d} of the text\n" for k in range(3000))
    found, _ = check(lines, 6000, 300)
    sizes = [e - s for s, e, _ in found]
    assert len(found) == -(-(len(lines) - 300) // 5700) and max(sizes) - min(sizes) < 800
    found, _ = check(("x" * 5650 + "\n") * 40, 6000, 300)
    assert all(kind > 2 for *_, kind in found) and len(found) <= 41


def test_one_long_line_and_balance():
    found, longest = check("x" * 1000, 300, 50)
    sizes = [e - s for s, e, _ in found]
    assert longest == 1000 and len(found) == 4 and max(sizes) - min(sizes) <= 1
    found, _ = check(("one two three " * 40 + "\n\n") * 3, 600, 60)
    assert all(kind != 0 for *_, kind in found)


def test_strongest_break_near_the_target_wins():
    text = "a" * 95 + "\n" + "  b\n" + "c" * 3 + "\n\n" + "def f():\n" + "d" * 90
    found, _ = check(text, 150, 0)
    assert text[found[0][1] :].startswith("def f")


def test_pieces_of_rows(spark):
    rows = [(1, "ab\n" * 100), (1, "ab\n" * 100), (2, None), (3, ""), (4, "x" * 50), (5, "é" * 51)]
    df = spark.createDataFrame([(i, t, 9, "z", 8) for i, t in rows], KIND)
    out = pieces(df, 50, 5).orderBy("id", "piece").collect()
    assert {r["id"] for r in out} == {1, 5} and [r["piece"] for r in out if r["id"] == 5] == [0, 1]
    one = [r for r in out if r["id"] == 1]
    assert len({(r["piece"]) for r in one}) == len(one) == one[0]["n_pieces"]
    joined = "".join(r["text"][(5 if r["piece"] else 0) :] for r in one)
    assert joined == rows[0][1] and one[-1]["end_kind"] == "end"
    assert pieces(df.limit(0), 50, 5).count() == 0
    checked = {r["id"]: tuple(r)[1:] for r in broken(pieces(df, 50, 5), 50, 5).collect()}
    assert checked == {i: (hashlib.md5(t.encode()).hexdigest(), 0, 0, 0, 0) for i, t in rows if t and len(t) > 50}
    assert pieces(df, 50, 5, texts=False).count() == len(out)
    with pytest.raises(ValueError):
        cut_places("x" * 99, 10, 10)
