from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import bagminhash, capfilters
from seriesloom.llm.common import components, words
from seriesloom.session import store


def brute_components(ids, linked):
    low = {i: i for i in ids}
    linked = [e for e in linked if e[0] != e[1]]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(2, 1), (1, 2)], [(k, k + 1) for k in range(40)], [(k + 1, k) for k in range(0, 30, 2)],
    [(50, k) for k in range(1, 20)] + [(50, 99), (99, 98)],
])
def test_components(session, edges):
    found = dict(tuple(r) for r in components(session.createDataFrame(edges, "a long, b long")).collect())
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert found == {i: c for i, c in brute_components(ids, edges).items() if i != c} | {i: c for i, c in found.items() if i == c}


def test_signature_estimates_weighted_jaccard():
    random_numbers = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        base = random_numbers.integers(0, 2**63, size=int(random_numbers.integers(3, 50))).astype(np.uint64)
        a, b = (np.sort(np.repeat(base, random_numbers.integers(0, 6, len(base)))) for _ in range(2))
        if len(a) and len(b):
            s = bagminhash.signatures([a, b], 512)
            errors.append((s[0] == s[1]).mean() - bagminhash.overlap(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.035


def test_signature_does_not_depend_on_the_batch():
    bags = [bagminhash.shingles([f"w{k % 7}{j}" for j in range(k)]) for k in (1, 2, 5, 9, 80, 700)]
    together = bagminhash.signatures(bags)
    assert all((bagminhash.signatures([b])[0] == s).all() for b, s in zip(bags, together, strict=True))
    assert (bagminhash.signatures([bags[4], bags[4]])[0] == together[4]).all()


def bag(text):
    found = words(text)
    n = min(5, len(found))
    return Counter(tuple(found[k : k + n]) for k in range(len(found) - n + 1)) if found else Counter()


def brute(rows):
    first = {}
    for doc_id, text in rows:
        first.setdefault(doc_id, text)
    bags = {i: bag(t) for i, t in first.items()}
    linked = [
        (a, b) for a in bags for b in bags
        if a < b and bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()) - 1e-9
    ]
    return brute_components(bags, linked)


def corpus():
    chance = random.Random(4)

    def prose(n):
        return [f"w{chance.randint(0, 400)}" for _ in range(n)]

    rows, base = [], prose(120)
    for k in range(40):  # a chain of near copies and some further off
        own = list(base)
        for _ in range(chance.randint(0, 6)):
            own[chance.randrange(120)] = f"x{chance.randint(0, 999)}"
        rows.append((100 + k, " ".join(own)))
    shared = prose(60)  # one passage that many share, but half of each text only
    rows += [(300 + k, " ".join(shared + prose(60))) for k in range(25)]
    rows += [(400 + k, "Short text. " + ("one" if k % 2 else "two")) for k in range(6)]
    rows += [(500 + k, " ".join(["der"] * (200 + k))) for k in range(4)]
    rows += [(600, None), (601, ""), (602, "..."), (603, "word"), (604, "Word!"), (605, " ".join(prose(30_000)))]
    rows += [(700 + k, " ".join(prose(50))) for k in range(20)]
    return rows + [(50, rows[3][1]), (51, rows[3][1].upper())]


def test_near_duplicates_equal_brute_force(session, docs, clashing):
    rows = corpus()
    found = {r.doc_id: r for r in bagminhash.near_duplicates(clashing(docs(rows))).collect()}
    expected = brute(rows)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in found.items())
    assert found[103].class_id == 50 and found[51].class_id == 51 and found[601].class_id == 601


def test_deduplicated_keeps_one_of_each(session, docs):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "z y x w v u"), (None, "q"), (None, "r")]
    kept = bagminhash.deduplicated(docs(rows))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q"), (0, "r"), (1, "a b c d e f g"), (3, "z y x w v u")]
    assert kept.columns == docs(rows).columns
    assert bagminhash.near_duplicates(docs([])).collect() == []


def family(seed, count, length=120):
    """Texts made of one original by replaced and added words: about as many pairs below the threshold as above."""
    draw = random.Random(seed)
    original = [f"w{draw.randrange(80)}" for _ in range(length)]
    texts = []
    for k in range(count):
        own = list(original)
        for _ in range(draw.choice([0, 1, 2, 4, 6, 9])):
            own[draw.randrange(length)] = f"u{k}x{draw.randrange(9)}"
        texts.append(" ".join(own + [f"a{k}y{n}" for n in range(draw.choice([0, 0, 5, 15, 25, 40]))]))
    return texts


def true_links(texts):
    bags = {i: bagminhash.shingles(t.encode().split()) for i, t in texts.items()}
    ids = sorted(bags)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if bagminhash.overlap(bags[a], bags[b]) >= 0.8}, bags


def test_pairs_that_are_apart_hold_all_that_can_reach_the_threshold(session):
    texts = dict(enumerate(family(1, 150) + family(2, 60, 40)))
    links, bags = true_links(texts)
    stored = session.createDataFrame([(i, b.view(np.int64).tolist()) for i, b in bags.items()], "doc_id long, bag array<long>")
    prefix = bagminhash._prefixes(stored.select("doc_id"), stored, 0.8)
    for groups in (1000, 7):
        joined = session.createDataFrame([(i, i % groups) for i in texts], "id long, component long")
        found = {tuple(r) for r in bagminhash._apart(bagminhash._with_components(prefix, joined)).collect()}
        assert {(a, b) for a, b in links if a % groups != b % groups} <= found
        assert all(a % groups != b % groups and a < b for a, b in found) and len(found) < 0.6 * len(texts) ** 2 / 2
    alone = bagminhash._with_components(prefix, session.createDataFrame([(i, 0) for i in texts], "id long, component long"))
    assert bagminhash._apart(alone).collect() == [] and bagminhash._attempts(alone).collect() == []


def test_attempts_grow_with_the_documents(session):
    texts = dict(enumerate(family(3, 300)))
    _, bags = true_links(dict(list(texts.items())[:2]))
    bags = {i: bagminhash.shingles(t.encode().split()) for i, t in texts.items()}
    stored = session.createDataFrame([(i, b.view(np.int64).tolist()) for i, b in bags.items()], "doc_id long, bag array<long>")
    prefix = bagminhash._prefixes(stored.select("doc_id"), stored, 0.8)
    placed = bagminhash._with_components(prefix, session.createDataFrame([], "id long, component long"))
    assert 100 < bagminhash._attempts(placed).count() <= 3 * 300


def test_a_large_group_of_members_around_the_threshold_equals_brute_force(session, docs):
    texts = dict(enumerate(family(5, 450)))
    links, _ = true_links(texts)
    found = {r.doc_id: r.component_id for r in bagminhash.near_duplicates(docs(list(texts.items()))).collect()}
    assert found == brute_components(list(texts), links) and 20 < len(set(found.values())) < 440


def test_ids_with_different_texts(session, docs):
    x, y, z = ("".join(f"{c}{k} " for k in range(40)) for c in "xyz")
    rows = [(1, x), (5, x), (5, y), (6, y), (7, y + "more"), (8, z), (8, z + "more"), (8, None), (9, z + "more"), (10, "u"), (10, "v"), (10, "v")]
    found = {(r.doc_id, r.key and bytes(r.key)): (r.class_id, r.component_id, r.kept) for r in bagminhash._judged(docs(rows)).collect()}
    of = {(i, t): found[i, hashlib.md5(t.encode()).digest() if t else None] for i, t in rows}
    assert of[1, x] == (1, 1, True) and of[5, x] == (1, 1, False) and of[5, y] == (5, 5, True) and of[6, y] == (5, 5, False)
    assert of[7, y + "more"] == (7, 5, False) and of[8, None] == (8, 8, True) and of[9, z + "more"] == (8, 8, False)
    assert of[8, z][:2] == of[8, z + "more"][:2] == (8, 8) and of[8, z][2] != of[8, z + "more"][2]
    assert of[10, "u"] == of[10, "v"] == (10, 10, True)
    kept = Counter((r.doc_id, r.text) for r in bagminhash.deduplicated(docs(rows)).collect())
    assert kept == Counter(k for k, v in of.items() if v[2])
    assert bagminhash.near_duplicates(docs(rows)).columns == ["doc_id", "class_id", "component_id", "kept"]


def test_all_products_above_the_bound_are_decoded():
    random_numbers = np.random.default_rng(2)
    for _ in range(50):
        scores = [random_numbers.normal(size=int(random_numbers.integers(2, 9))) for _ in range(3)]
        sums = (scores[0][:, None, None] + scores[1][None, :, None] + scores[2][None, None, :]).ravel()
        bound = float(np.quantile(sums, 0.9))
        assert sorted(capfilters.decode(scores, bound).tolist()) == np.flatnonzero(sums >= bound - 1e-12).tolist()


def vectors():
    random_numbers = np.random.default_rng(6)
    rows, vec_id = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            center = random_numbers.normal(size=24)
            for spread in (0.0, 0.0, 0.1, 0.19, 0.21, 0.25):
                v = center + spread * np.linalg.norm(center) / np.sqrt(24) * random_numbers.normal(size=24)
                rows.append((vec_id, [float(x) for x in v.astype(np.float32)], label))
                vec_id += 1
    center = [1.0] * 24
    rows += [(vec_id + k, center, 1) for k in range(30)]  # copies
    rows += [(vec_id + 40, [2.0] * 24, 1), (vec_id + 41, [0.0] * 24, 1), (vec_id + 42, None, 1), (vec_id + 43, [1.0, float("nan")] * 12, 1),
             (vec_id + 44, [None] + [1.0] * 23, 1), (vec_id + 45, [float("inf")] * 24, 1), (vec_id + 46, [1.0, 1.0], 1), (vec_id + 47, [1.0, 1.0], 1),
             (vec_id + 48, [], 1)]
    return rows


def test_near_vectors_equal_brute_force(session):
    rows = vectors()
    table = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as unit", "1 as key", "2 as size")
    found = {r.vec_id: r for r in capfilters.near_vectors(table).collect()}
    usable = {i: np.asarray(v, np.float32).astype(float) for i, v, label in rows
              if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    labels = {i: label for i, _, label in rows}
    links = set()
    for a, x in usable.items():
        for b, y in usable.items():
            if a < b and labels[a] == labels[b] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links.add((a, b))
    total = Counter(i for e in links for i in e)
    recall = sum(r.n_links for r in found.values()) / sum(total.values())
    assert recall > 0.999 and all(r.n_links <= total[i] for i, r in found.items())
    assert {i: r.component_id for i, r in found.items()} == brute_components([r[0] for r in rows], links)
    assert capfilters.near_vectors(table.limit(0)).collect() == []


def test_vectors_by_row_not_by_id(session):
    east, north, near = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 0.1, 0.0]
    rows = [(5, east, 1), (5, north, 1), (1, east, 1), (None, near, 1), (7, north, 1), (None, [0.0, 0.0, 1.0], 1), (None, [0.0, 0.0, 1.0], 1), (9, east, 2), (None, None, 1)]
    table = session.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in capfilters.near_vectors(table).collect())
    assert found == Counter([
        (5, 2, 1, False), (5, 1, 5, True), (1, 2, 1, True), (None, 2, 1, False), (7, 1, 5, False), (None, 1, None, False), (None, 1, None, False),
        (9, 0, 9, True), (None, 0, None, False)])


def test_texts_are_shuffled_once_and_only_for_candidates(session, docs, monkeypatch):
    plans = {}

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().explainString(
            session._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return store(df, name)

    monkeypatch.setattr(bagminhash, "store", watched)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bagminhash.near_duplicates(docs([(k, f"one two three four five six {k // 2}") for k in range(8)]))
    finally:
        session.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = {name: len(re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[[^\]]*\btext#", plan)) for name, plan in plans.items()}
    assert moved["bands"] == 0 and sum(moved.values()) == 1


def test_long_texts_are_measured_a_few_at_a_time():
    sizes = [10, 700, 500, 0, 5000, 3, 3]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in sizes])], ["text"])
    parts = [[len(t.as_py() or "") for t in p.column("text")] for p in bagminhash._portions(batch, 1000)]
    assert parts == [[10, 700], [500, 0], [5000], [3, 3]]
    many = pa.RecordBatch.from_arrays([pa.array(["x"] * 600)], ["text"])
    assert [p.num_rows for p in bagminhash._portions(many)] == [256, 256, 88]
