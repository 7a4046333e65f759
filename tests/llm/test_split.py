"""Problem 1: pieces rebuild the text, obey the limit, end at natural places, whatever the ranges."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.split import cut_segment, halos, range_cuts, split_chunks, split_files, split_items

PARTS = ["word ", "A sentence. ", "para\n\n", "日本語の文。", "xxxxxxxxxxxxxxxxxxxxxxxxx", " ", "é", "\n", "approx. 12 % ", "\U0001f469‍\U0001f680"]


def ranges(text, most, overlap, size, per, least=0):
    """Pieces of a text by ranges of ``per`` segments, from each range's bytes and halos alone."""
    data, out, done = text.encode(), [], 0
    size = max(size, most * 12 + overlap * 4 + 64)
    left, right = halos(most, overlap)
    for k in range(max(1, -(-len(data) // (size * per)))):
        lo, hi = max(0, k * size * per - left), min(len(data), (k + 1) * size * per + right)
        owned, cuts = range_cuts(data[lo:hi], lo, k, per, size, len(data), most, overlap)
        out += [(a + done, b + done, data[c:d].decode()) for a, b, c, d in cuts.tolist()]
        done += owned
    return out


def check(text, pieces, most, overlap):
    done = 0
    for start, end, piece in pieces:
        assert text[start:end] == piece and len(piece) <= most and start <= done < end and done - start <= overlap
        done = end
    assert done == len(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=120), st.integers(1, 80), st.integers(0, 80), st.booleans())
def test_pieces_rebuild_the_text(parts, most, overlap, small):
    text = "".join(parts)
    found = ranges(text, most, overlap, 1 if small else 1 << 20, 1)
    check(text, found, most, overlap)
    assert found == ranges(text, most, overlap, 1 if small else 1 << 20, 3)


@pytest.mark.parametrize("filler", [" ", "\n", "x", "\u0301", "\u3000", "\U0001f469"])
def test_long_runs_over_the_edges_of_ranges(filler):
    for n in (50, 130, 700):
        text = "Begin here. " + filler * n + " then. " + "a b. " * 40 + filler * n + "end"
        found = ranges(text, 7, 3, 1, 1)
        check(text, found, 7, 3)
        assert found == ranges(text, 7, 3, 1, 5)


def test_natural_places():
    text = "First sentence is here. Second one follows it.\n\nNew paragraph begins, with approx. 12 rows in it. End of it."
    assert [text[a:b] for a, b in cut_segment(text, 0, len(text), 0, 55, 0)] == ["First sentence is here. Second one follows it.\n\n", "New paragraph begins, with approx. 12 rows in it. ", "End of it."]
    pieces = cut_segment(text, 0, len(text), 0, 60, 12)
    for (_, end), (start, _) in zip(pieces, pieces[1:]):
        natural = [i for i in range(end - 12, end - 8) if text[i - 1].isspace() and not text[i].isspace()]
        assert start in natural if natural else start == end - 12


def rows(spark, data):
    return spark.createDataFrame([(i, t, x, dt.datetime(2024, 1, 1)) for i, t, x in data], "id string, type string, text string, indexed_at timestamp")


def limits(spark):
    return spark.createDataFrame([("table", 20, 4), ("*", 10, 0)], "type string, max_chars int, overlap_chars int")


def test_types_duplicates_and_empty_texts(spark):
    long = "one two three four five six seven"
    data = [("a", " TABLE", long), ("a", " TABLE", long), ("b", "odd", "  0123456789\r\n"), ("c", None, "01234567890"), ("d", "table", None), ("e", "table", ""), ("f", "table", " \n\t"), (None, "table", long)]
    found = split_chunks(rows(spark, data), limits(spark)).orderBy("id", "piece_no").collect()
    by = {i: [r for r in found if r["id"] == i] for i in "abcdef"}
    assert [len(by[i]) for i in "bcdef"] == [1, 2, 0, 0, 0] and by["b"][0]["piece"] == "0123456789"
    assert len(by["a"]) == by["a"][0]["n_pieces"] and [r["piece_no"] for r in by["a"]] == list(range(len(by["a"])))
    check(long, [(r["start_char"], r["end_char"], r["piece"]) for r in by["a"]], 20, 4)
    assert split_chunks(rows(spark, []), limits(spark)).collect() == []


def test_giant_texts_by_ranges(spark):
    rng = random.Random(6)
    texts = {f"t{i}": "".join(rng.choices(PARTS, k=rng.choice([1, 5, 9000]))).strip(" \t\r\n") for i in range(12)}
    items = spark.createDataFrame([(k, v, 30, 6, "clash") for k, v in texts.items()], "item string, text string, max_chars int, overlap int, data string")
    by_range = {}
    for range_bytes in (1, 20_000, 1 << 20):
        found = by_range[range_bytes] = sorted(map(tuple, split_items(items, range_bytes).collect()))
        for name, text in texts.items():
            mine = [r for r in found if r[0] == name]
            assert [m[1] for m in mine] == list(range(len(mine))) and all(m[2] == len(mine) for m in mine)
            check(text, [m[3:6] for m in mine], 30, 6)
    assert by_range[1] == by_range[20_000] == by_range[1 << 20] and max(map(len, texts.values())) > 40_000


def test_overlaps_as_long_as_the_limit_and_bad_limits(spark):
    items = spark.createDataFrame([("a", "one two three four", 5, 9), ("b", "abc", 0, -1), ("c", "abc", -7, None)], "item string, text string, max_chars int, overlap int")
    found = split_items(items).orderBy("item", "piece_no").collect()
    check("one two three four", [(r["start_char"], r["end_char"], r["piece"]) for r in found if r["item"] == "a"], 5, 4)
    assert [r["piece"] for r in found if r["item"] != "a"] == ["a", "b", "c"] * 2


def test_files_by_ranges(spark, tmp_path):
    rng = random.Random(8)
    text = "".join(rng.choices(PARTS, k=5000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "empty.txt").write_text("")
    found = split_files(spark, [str(tmp_path / "big.txt"), str(tmp_path / "empty.txt")], 100, 10, 4096).orderBy("piece_no").collect()
    check(text, [(r["start_char"], r["end_char"], r["piece"]) for r in found], 100, 10)
    assert len(found) == found[0]["n_pieces"]
    again = split_files(spark, [str(tmp_path / "big.txt")], 100, 10, 1 << 20).orderBy("piece_no").collect()
    assert again == found


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "odd.txt").write_bytes(b"ab\xff\xfe cd \x80\x80\x80\x80 \xe3\x81" * 3000)
    found = split_files(spark, [str(tmp_path / "odd.txt")], 50, 0, 1).orderBy("piece_no").collect()
    assert found[0]["start_char"] == 0 and all(a["end_char"] == b["start_char"] for a, b in zip(found, found[1:])) and all(len(r["piece"]) <= 50 for r in found)
