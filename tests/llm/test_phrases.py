from __future__ import annotations

import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import phrases


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, top, longest=4):
    counts = defaultdict(Counter)
    words = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            words[lang] += len(piece)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(piece[i : i + size]) for i in range(len(piece) - size + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        scored = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in candidates.items())
            if not inside:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, words[lang], -score))
    return sorted(found)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture
def place(tmp_path):
    return lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 5))
def test_intervals_count_every_phrase(middle, longest):
    text = np.array([0, *middle, 0], np.int32)
    index = phrases.Index.of(text, 6, max(1, longest - 1))
    expected = Counter(tuple(text[i : i + k].tolist()) for k in range(1, longest + 1) for i in range(len(text) - k + 1))
    expected = {p: n for p, n in expected.items() if 0 not in p}
    full = [np.full(1 << (phrases.BITS - 6), 2**64 - 1, np.uint64)] * longest
    hashes = np.arange(6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = {}
    for numbers, _, n in phrases.enumerate_phrases(index, hashes, full, longest):
        found |= {tuple(p): c for p, c in zip(numbers.tolist(), n.tolist(), strict=True) if c}
    assert found == expected


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=80), st.integers(1, 9), st.integers(9, 40))
def test_order_sorts_by_the_next_numbers(text, depth, bits):
    text = np.array(text)
    padded = [*text.tolist(), *[0] * depth]
    found = [padded[i : i + depth] for i in phrases.order(text, depth, bits).tolist()]
    assert found == sorted(found)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .", max_size=60), st.integers(4, 12))
def test_chunks_lose_no_phrase(text, limit):
    def counted(lists):
        found = Counter()
        for tokens in lists:
            for piece in b" ".join(tokens).split(phrases.BOUNDARY):
                w = piece.split()
                found.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
        return found

    cut = list(phrases.chunks(text.encode(), limit, 3))
    total = counted(c for c, _ in cut)
    total.subtract(counted(a for _, a in cut))
    assert +total == counted([w.encode() for w in piece] for piece in pieces(text)) and min(total.values(), default=0) >= 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 2**40 - 1), st.integers(-(2**40), 2**62), max_size=50))
def test_packed_sums(sums):
    key = np.array(sorted(sums), np.uint64)
    n = np.array([sums[k] for k in sorted(sums)], np.int64)
    keys, counts = phrases.unpacked(phrases.packed(key, n)) if sums else (key, n)
    assert keys.tolist() == key.tolist() and counts.tolist() == n.tolist()


def corpus(seed, count=400):
    draw = random.Random(seed)
    words = ["the", "of", "New", "York", "new", "straße", "Ä", "ä", "x-y", "...", "it's", "　", "\xa0q", "\U0001f642", "퟿", "zz"]
    rows = []
    for _ in range(count):
        text = ""
        for _ in range(draw.randrange(0, 40)):
            text += draw.choice([*words, "new york city hall", "of the"]) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", ""])
        rows.append((text, draw.choice(["en", "en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", "en"), (None, None), ("only once here", "fr")]


@pytest.mark.parametrize("shard", [phrases.SHARD, 40])
def test_equals_brute_force(session, clashing, place, shard):
    rows = corpus(1)
    table = clashing(session.createDataFrame(rows, "text string, lang string")).withColumn("phrase", F.lit("x")).repartition(3)
    indexes = phrases.build(table, place(), shard=shard)
    for least, top in ((2, 2000), (5, 30)):
        assert got(phrases.best_phrases(indexes, least, top=top)) == brute(rows, least, top)


def test_other_lengths(session, place):
    rows = corpus(2, 80)
    for longest in (2, 6):
        indexes = phrases.build(session.createDataFrame(rows, "text string, lang string"), place(), longest=longest)
        assert got(phrases.best_phrases(indexes, 2, longest)) == brute(rows, 2, 2000, longest)


def test_a_text_longer_than_a_shard(session, place, monkeypatch):
    draw = random.Random(4)
    rows = [(" ".join(draw.choices(["a", "b", "c", "d.", "e f"], k=5000)), "en"), ("word " * 3000, "en"), ("z" * 100_000 + " " + "z z z", None)]
    indexes = phrases.build(session.createDataFrame(rows, "text string, lang string").coalesce(1), place(), shard=700)
    assert indexes.where("sign < 0").count() > 0
    assert got(phrases.best_phrases(indexes, 30)) == brute(rows, 30, 2000)


def test_exact_beyond_64_bits(session):
    big = 9 * 10**18
    counts = session.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big // 3)], "lang string, phrase string, size int, f long")
    (row,) = phrases.scored(counts).collect()
    assert row["score"] == 2_000_000 * (big // 3) // (2 * big - 1)


def test_collisions_of_hashes_and_bitmap_change_nothing(session, place, monkeypatch):
    rows = corpus(3, 100)
    indexes = phrases.build(session.createDataFrame(rows, "text string, lang string"), place())
    expected = brute(rows, 3, 2000)
    monkeypatch.setattr(phrases, "_bitmap", lambda keys: np.full(1 << (phrases.BITS - 6), 2**64 - 1, np.uint64))
    monkeypatch.setattr(phrases, "PART", 50)
    monkeypatch.setattr(phrases, "HELD", 20)
    assert got(phrases.best_phrases(indexes, 3)) == expected


def test_empty_tables(session, place):
    for rows in ([], [(None, None)], [("one two", "en")]):
        indexes = phrases.build(session.createDataFrame(rows, "text string, lang string"), place())
        assert phrases.best_phrases(indexes).collect() == []


def test_a_task_sends_a_phrase_once_however_many_shards_hold_it(session, place):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices("abcd", k=30)), lang) for lang in ("en", "de") for _ in range(60)]
    indexes = phrases.build(session.createDataFrame(rows, "text string, lang string").coalesce(1), place(), shard=100)
    full = [np.full(1 << (phrases.BITS - 6), 2**64 - 1, np.uint64)] * 4
    assert indexes.count() > 20
    sent = phrases._sent(indexes.coalesce(1), full, 5).collect()
    found = [(x["lang"], x["phrase"]) for r in sent for x in pa.ipc.open_stream(r["sums"]).read_all().to_pylist()]
    assert len(sent) <= 5 and len(found) == len(set(found)) and len(found) > 500
    counts = {(r.lang, r.phrase): r.f for r in phrases._named(indexes, full, 1, 5).collect()}
    assert set(counts) == {(lang, phrase.decode()) for lang, phrase in found}
    assert sum(n for (_, p), n in counts.items() if " " not in p) == 120 * 30
