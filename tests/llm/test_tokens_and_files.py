from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import arrow_files, packing, tokens
from seriesloom.llm.tokens import encoder, odd

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t.'sé́Σσ#<|>İſǅ\x1c\x85"), st.characters(blacklist_categories=("Cs",))), max_size=25)


@pytest.mark.parametrize("name", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(text=TEXTS)
def test_ids_equal_the_librarys(name, text):
    assert encoder(name).encode(text).tolist() == encoder(name).whole(text).tolist()


@pytest.mark.parametrize("text", ["a\tb c ", "\ta", "a \tb", "a\t", "a\u00a0b  c", "x\x1cy ", " a\tb", "a\n\tb", "\u3000", "a \u2003"])
def test_white_space_that_cancels_out(text):
    """As many parts at any white space as at spaces, but not the same ones."""
    assert odd(text)
    for name in (BYTE, WORD):
        assert encoder(name).encode(text).tolist() == encoder(name).whole(text).tolist()


def test_special_strings_and_null():
    for name in (BYTE, WORD):
        e = encoder(name)
        for text in ("a <|endoftext|> b", "<|startoftext|>x", " a\n\nb ", ""):
            assert e.encode(text).tolist() == e.whole(text).tolist()
        assert e.encode(None).tolist() == []


@pytest.mark.parametrize("name", [BYTE, WORD])
@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), TEXTS), max_size=6))
def test_texts_encoded_together(name, texts):
    e = encoder(name)
    assert list(e.encode_all(pa.array(texts, pa.string()))) == [e.whole(text or "").tobytes() for text in texts]


def test_a_batch_looks_up_each_word_once(monkeypatch):
    """However often a word occurs and whatever marks follow it; new words are merged many in one call."""
    letters = "abcdefghijklmnopqrstuvwxyzäöü"
    words = [a + b + c for a in letters for b in letters for c in letters[:2]]
    texts = [" ".join(words), ", ".join(reversed(words)), "\n".join(words[:50]) + "!", "don't 12"] * 5
    monkeypatch.setattr(tokens, "GROUP", 100)
    for name in (BYTE, WORD):
        fresh, asked, alone = tokens.Encoder(tokens.public_path(name)), [], []

        class Counted(tokens._Pieces):
            def __getitem__(self, word):
                asked.append(word)
                return super().__getitem__(word)

        fresh.inner = Counted(lambda word, encode=fresh.inner.encode: alone.append(word) or encode(word))
        found = list(fresh.encode_all(pa.array(texts)))
        assert found == [fresh.whole(text).tobytes() for text in texts]
        assert len(asked) == len(set(asked)) and set(words) <= set(asked)
        assert set(alone) <= {"12", "don't"}


def test_a_text_longer_than_a_chunk(monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 10)
    texts = ["a", "", "long " * 20 + "end", None, "b c", "\t", "d" * 30, ""]
    for name in (BYTE, WORD):
        e = encoder(name)
        assert list(e.encode_all(pa.array(texts))) == [e.whole(text or "").tobytes() for text in texts]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CASES = [(7, "one two"), (3, None), (3, "again the same id"), (5, ""), (9, "wort " * 4000), (None, "no id"), (11, "tie"), (11, "tie")]


def test_token_files_round_trip(session, docs, clashing):
    table = clashing(docs(CASES))
    found = arrow_files.token_files(session, table, WORD, 2)
    ordered = sorted(CASES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for doc_id, text in ordered:
        ids = np.append(encoder(WORD).whole(text or ""), 2).astype("<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(r) for r in found.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    assert got == expected


def test_token_files_of_an_empty_table(session, docs):
    assert arrow_files.token_files(session, docs([]), WORD, 2).collect() == []


def test_sequences_are_views(tmp_path):
    path = str(tmp_path / "x.arrow")
    writer = arrow_files.ShardWriter(path, 8, "uint16")
    ids = np.arange(8 * 300 + 3, dtype=np.uint32)
    for k in range(0, len(ids), 7):
        writer.add(k, ids[k : k + 7])
    assert writer.close() == len(ids)
    file = arrow_files.SequenceFile(f"file://{path}")
    assert len(file) == 301
    values, mask = file.sequence(129)
    assert values.tolist() == list(range(129 * 8, 130 * 8)) and not values.flags.owndata and mask.true_count == 8
    values, mask = file.sequence(300)
    assert mask.to_pylist() == [True] * 3 + [False] * 5 and values[3:].tolist() == [0] * 5
    documents = list(file.documents())
    assert [d[0] for d in documents] == list(range(0, len(ids), 7)) and sum(d[2] for d in documents) == len(ids)


def check_plan(counts, capacity):
    steps, total = packing.plan(counts, capacity)
    lookup, used = packing.Lookup(steps), {}
    for size, count in counts.items():
        for sequence, offset in zip(*lookup.place(size, np.arange(count)), strict=True):
            used.setdefault(int(sequence), []).append((int(offset), size))
    assert len(used) == total
    for own in used.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= capacity
    return total


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for space in set(bins):
            if space >= items[k]:
                at = bins.index(space)
                bins[at] -= items[k]
                place(k + 1, bins)
                bins[at] = space
        place(k + 1, [*bins, capacity - items[k]])

    place(0, [])
    return best[0]


def test_dominance_never_costs_a_sequence():
    """Fixing a dominating set first must leave the optimum within reach: packing the rest at best gives the optimum."""
    random.seed(5)
    for _ in range(300):
        capacity = random.randint(3, 18)
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 8))]
        left = np.bincount(items, minlength=capacity + 1)
        for j in sorted(set(items), reverse=True):
            fixed = packing.dominating_set(left.copy(), j, capacity)
            if fixed is not None:
                rest = list(items)
                for size in (j, *fixed):
                    rest.remove(size)
                assert 1 + fewest(rest, capacity) == fewest(items, capacity), (items, capacity, j, fixed)


def test_plan_is_close_to_the_optimum():
    random.seed(1)
    for _ in range(300):
        capacity = random.randint(3, 20)
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        counts = {s: items.count(s) for s in set(items)}
        assert check_plan(counts, capacity) <= fewest(items, capacity) + 1


def test_plan_of_many_equal_sizes():
    assert check_plan({2048: 5, 1000: 100_000, 48: 50_000, 1: 3}, 2048) == 5 + 50_000 + 1
    assert packing.plan({}, 2048) == ([], 0)
    with pytest.raises(ValueError):
        packing.plan({2049: 1}, 2048)


def test_packing_documents(session, docs, clashing):
    found = packing.pack_documents(clashing(docs(CASES)), BYTE, 0, 64).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in CASES:
        ids = np.append(encoder(BYTE).whole(text or ""), 0).astype("<u4")
        copies = sum(1 for d, _ in CASES if d == doc_id)
        if copies > 1:
            continue
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]]))
        assert sum(r.length for r in own) == len(ids) and all(r.length == 64 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert len(by_doc[11]) == 2 and len(by_doc[3]) == 2
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack_documents(docs([]), BYTE, 0).collect() == []


def test_width_of_ids(session, docs, tmp_path):
    writer = arrow_files.ShardWriter(str(tmp_path / "x.arrow"), 8, "uint16")
    with pytest.raises(ValueError, match="70000"):
        writer.add(1, np.array([1, 70_000], np.uint32))
    files = arrow_files.write_shards(docs([(1, "one two")]), f"file://{tmp_path}/wide", WORD, 70_000)
    (row,) = arrow_files.read_shards(files).collect()
    ids = np.append(encoder(WORD).whole("one two"), 70_000).astype("<u4")
    assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
