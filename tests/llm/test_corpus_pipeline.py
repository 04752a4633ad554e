from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from seriesloom.llm import quality
from seriesloom.llm.pseudonyms import Pseudonyms
from seriesloom.llm.queries import PSEUDONYM_KEY
from seriesloom.llm.tokens import encoder
from tests.llm.conftest import DOCS
from tests.llm.test_near import brute as near_brute
from tests.llm.test_text_operators import brute_contamination


def brute_accepted(documents, labels):
    """Regularised discriminant by its formula, one document at a time."""
    x = {d: np.array(quality.statistics(t)) for d, t in documents}
    groups = [np.array([x[d] for d, y in labels.items() if y == k]) for k in (0, 1)]
    pooled = sum(len(g) * ((g - g.mean(axis=0)) ** 2).mean(axis=0) for g in groups) / sum(map(len, groups)) + 1e-4
    parts = []
    for g in groups:
        c = (g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) / len(g)
        shrunk = 0.9 * c
        np.fill_diagonal(shrunk, 0.95 * c.diagonal() + 0.05 * pooled)
        shrunk += 1e-9 * np.eye(len(c))
        parts.append((g.mean(axis=0), np.linalg.inv(shrunk), np.linalg.slogdet(shrunk)[1]))
    prior = np.log((len(groups[1]) + 0.5) / (len(groups[0]) + 0.5))

    def density(v, part):
        mean, inverse, log_det = part
        return -0.5 * ((v - mean) @ inverse @ (v - mean) + log_det)

    odds = {d: density(v, parts[1]) - density(v, parts[0]) + prior for d, v in x.items()}
    return {d for d, o in odds.items() if o >= np.log(0.7 / 0.3)}


def corpus():
    chance = random.Random(8)

    def prose(n):
        return " ".join(f"wo{'abcdefg'[chance.randint(0, 6)] * chance.randint(1, 4)}{chance.randint(0, 90)}" for _ in range(n)) + "."

    passage = prose(40)
    documents = [(k, prose(chance.randint(20, 150))) for k in range(150)]
    documents += [(200 + k, prose(chance.randint(20, 90)).replace(" ", " | ")) for k in range(40)]
    documents += [(300 + k, documents[k][1]) for k in range(10)]  # exact copies
    documents += [(320 + k, documents[20 + k][1] + " tail") for k in range(10)]  # near copies
    documents += [(340 + k, prose(30) + " " + passage + " " + prose(20)) for k in range(5)]
    documents += [(360, prose(30) + " write to some.body@mail.example.com or +1 (974) 555-3436 " + prose(9)), (361, None), (362, ""), (363, prose(3000))]
    labels = {d: int(not 200 <= d < 300) for d, _ in documents if d % 3 and d < 300}
    return documents, labels, [(1, passage), (2, "unrelated words of another item that nobody has copied at all anywhere here")]


def test_pipeline_equals_brute_force(session, folder):
    documents, labels, items = corpus()
    session.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in documents], DOCS).write.parquet(f"{folder}/documents.parquet")
    session.createDataFrame([(d, y, 0) for d, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    session.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(session, folder).collect()

    accepted = brute_accepted(documents, labels)
    rows = [(d, t) for d, t in documents if d in accepted]
    assert len(documents) - 60 < len(rows) < len(documents) - 30
    low = near_brute(rows)
    rows = [(d, t) for d, t in rows if low[d] == d]
    bad = {r[0] for r in brute_contamination(rows, items) if r[5]}
    assert bad == {340, 341, 342, 343, 344}
    change = Pseudonyms(PSEUDONYM_KEY).text
    expected = {}
    for d, t in rows:
        if d not in bad:
            text = change(t) if t else t
            assert d != 360 or ("some.body" not in text and "555-3436" not in text)
            expected[d] = np.append(encoder("byte_bpe_50k.json").whole(text or ""), 0).astype("<u4")
    got: dict[int, list] = {}
    for r in found:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(expected)
    for d, ids in expected.items():
        own = sorted(got[d], key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids)
    used: dict[int, int] = {}
    for r in found:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_stages_keep_the_columns_and_accept_empty_tables(session, folder):
    session.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    session.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = session.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(session, docs, folder)
        assert out.collect() == []
        if name != "packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            docs = out
