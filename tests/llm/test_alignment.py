from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesloom.llm import alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))


def decoder():
    """Byte of each character of the byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def brute_groups(text, a, b, table):
    """[(ids a, ids b)] of a text by walking over both token lists, or None."""
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    told = (" " + text).encode()
    if b"".join(bytes_a) != told or b"".join(bytes_b) != told:
        return None
    groups, end_a, end_b = [([], [])], 0, 0
    i = j = 0
    while i < len(ids_a) or j < len(ids_b):
        if end_a <= end_b and i < len(ids_a):
            groups[-1][0].append(ids_a[i])
            end_a += len(bytes_a[i])
            i += 1
        else:
            groups[-1][1].append(ids_b[j])
            end_b += len(bytes_b[j])
            j += 1
        if end_a == end_b and groups[-1][0] and groups[-1][1]:
            groups.append(([], []))
    return groups[:-1]


def brute(rows):
    a, b = libraries()
    table = decoder()
    found = [(doc_id, brute_groups(text, a, b, table) or []) for doc_id, text in rows]
    held = Counter()
    for _, groups in found:
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    result = []
    for doc_id, groups in found:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        result.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
                       sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links),
                       hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(result, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


CASES = [
    (1, "one two three, and four."), (2, None), (3, ""), (3, "one two three, and four."), (None, "no id here"), (4, " leading"), (5, "trailing "),
    (6, "two  spaces\tand\ttabs \n\n lines"), (7, "a▁b"), (8, "<|endoftext|> is <s> plain </s> <unk> <0x41> text"), (9, "Ünïcödé ǅ 漢字かな 🙂👩‍👩‍👧 é  x y"),
    (10, "-" * 500 + " " + "=" * 321 + "ab" * 700), (11, "wort " * 4000 + "ende"), (12, "line one\nline two\n'quoted' don't we'll\nend"), (13, " "),
    (14, "\n"), (15, "x" * 20_000), (16, "\x00\x01 \x7f   ﻿ z"), (17, "1234567890 12:30 3.14 1,000,000 $5 a_b-c/d\\e http://x.y/z?q=1&r=2"),
    (18, "ﬁ ﬂ ½ Å Ω ͅ ι İ ı ß ſ"), (19, " ".join(f"w{k}x" for k in range(3000))), (20, "a ́b 　c"),
]


@pytest.mark.parametrize("lookup", [alignment.LOOKUP, 0])
def test_equals_brute_force(session, docs, clashing, lookup):
    table = clashing(docs(CASES)).withColumnRenamed("key", "pair").repartition(3)
    assert got(alignment.alignment(table, A, B, lookup)) == brute(CASES)


def test_random_texts(session, docs):
    draw = random.Random(3)
    letters = "aaabcdeé ßz漢🙂,.'- \n\n  \t<|>_09ﬁ▁ "
    rows = [(k, "".join(draw.choices(letters, k=draw.randrange(0, 60)))) for k in range(600)]
    words = ["the", "of", "straße,", "naïve.", "don't", "(x)", "10,000", "東京"]
    rows += [(k, draw.choice([" ", "\n"]).join(draw.choices(words, k=draw.randrange(1, 40)))) for k in range(600, 900)]
    assert got(alignment.alignment(docs(rows), A, B)) == brute(rows)


def test_caches_that_start_anew_change_nothing(monkeypatch):
    texts = [t for _, t in CASES] * 2
    whole = alignment.Aligner(alignment.Sides(A, B))
    expected = [(d, *n, p.tolist(), k.tolist()) for d, *n, p, k in whole.documents(texts)]
    monkeypatch.setattr(alignment, "CACHE", 12)
    monkeypatch.setattr(alignment, "TURN", 5)
    small = alignment.Aligner(alignment.Sides(A, B))
    assert [(d, *n, p.tolist(), k.tolist()) for d, *n, p, k in small.documents(texts)] == expected


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 200).flatmap(lambda n: st.tuples(st.just(n), st.sets(st.integers(1, n)), st.sets(st.integers(1, n)))))
def test_labels_are_components_of_overlap(case):
    n, cuts_a, cuts_b = case
    ends_a, ends_b = (np.array(sorted(c | {n})) for c in (cuts_a, cuts_b))
    common = np.array(sorted(set(ends_a.tolist()) & set(ends_b.tolist())))
    group_a, group_b = alignment.labels(ends_a, ends_b)
    assert group_a.tolist() == np.searchsorted(common, ends_a).tolist()
    assert group_b.tolist() == np.searchsorted(common, ends_b).tolist()


def test_long_components_converge_in_few_rounds():
    ends_a, ends_b = np.arange(2, 200_001, 2), np.concatenate([np.arange(1, 200_000, 2), [200_000]])
    group_a, group_b = alignment.labels(ends_a, ends_b)
    assert not group_a.any() and not group_b.any()


def test_spans(session, docs):
    (row,) = alignment.spans(docs([(1, "naïve straße, 東京")]), A, B).collect()
    text = " naïve straße, 東京".encode()
    a, _ = libraries()
    assert row["groups"][0]["start"] == 0 and row["groups"][-1]["end"] == len(text)
    assert [i for g in row["groups"] for i in g["ids_a"]] == a.encode(text.decode(), add_special_tokens=False).ids
    assert all(x["end"] == y["start"] for x, y in zip(row["groups"], row["groups"][1:], strict=False))
    assert alignment.spans(docs([(2, None)]), A, B).first()["groups"] == []


def test_empty_table(session, docs):
    assert alignment.alignment(docs([]), A, B).collect() == []
    assert got(alignment.alignment(docs([(1, None)]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]
