"""BagMinHash near-duplicates: weighted-Jaccard signatures, bands, and exact multiset overlap.

A document is the multiset of its five-word shingles (a shorter text is one shingle of all its words). Two
documents are linked when sum(min) / sum(max) of the counts is at least ``threshold``.

Signature (Ertl's BagMinHash, on whole-number weights). Every shingle owns Poisson processes on the
dyadic weight intervals [0,1), [1,2), [2,4), [4,8), ... with rates equal to their lengths, drawn from its hash
alone. A point has a time, a place in its interval and one of ``slots`` components; it counts for a document when its
place lies below the shingle's count there. So a weight is discretised exactly, and a shingle's points in two
documents agree up to the smaller count. A component keeps its earliest point; two documents agree in a component with
probability equal to their weighted Jaccard. Points are drawn in order of time for all processes of a
batch at once, up to a horizon by which every component is expected to be filled; documents with an empty
component go on with a wider one.

Stages: (1) documents with equal texts form classes by a 128-bit hash, and only the smallest
doc_id of a class goes on; texts are signed where they are read; (2) signatures are cut into ``bands``; (3) each band bucket links its members to its smallest
id, and those pairs are verified by exact overlap; (4) the documents of buckets that still hold
several components are joined exactly: their shingles are ordered by how many of them have them, and two
documents can only reach the threshold if they share one of their rarest (1 - threshold) part, at a place that leaves enough
behind it. First every document is compared with up to three such documents of other components, so that large
groups grow together in as many comparisons as documents; what is still apart is joined with all
bounds in the join, so that pairs that cannot reach the threshold are never made; (5) components. Texts are shuffled once, for candidates only. No group is collected into one task.

Null, empty and wordless texts have no shingles and are linked with nothing (equal wordless texts are copies, though). Repeated
doc_ids count as one document each time (their rows get the same ids when the texts agree; the class is decided
by the text; an id with different texts is one document for each). NULL doc_ids are left out. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import byte_words, components, mix, only, shingle_hashes, uniform, unused, word_hashes
from seriesloom.session import store

SHINGLE = 5
# 24 bands of 4 components: a pair at 0.8 is missed with a probability of (1 - 0.8^4)^24 = 3e-6.
SLOTS = 96
BANDS = 24
THRESHOLD = 0.8


def shingles(found: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit shingle hashes with repetitions."""
    if not found:
        return np.empty(0, np.uint64)
    return np.sort(shingle_hashes(word_hashes(found), min(size, len(found))))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two sorted multisets: sum of smaller counts over sum of larger counts."""
    if not len(a) or not len(b):
        return 0.0
    va, ca = np.unique(a, return_counts=True)
    vb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


def _processes(bags: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """One row per document, shingle and dyadic interval below its count: document, seed, start, length, count."""
    docs, values, counts = [], [], []
    for k, bag in enumerate(bags):
        v, c = np.unique(bag, return_counts=True)
        docs.append(np.full(len(v), k))
        values.append(v)
        counts.append(c)
    doc, value, count = np.concatenate(docs), np.concatenate(values), np.concatenate(counts)
    parts = [(doc, value, np.zeros_like(count), np.ones_like(count), count)]
    start = 1
    while len(count) and start < int(count.max()):
        at = np.flatnonzero(count > start)
        parts.append((doc[at], value[at], np.full(len(at), start), np.full(len(at), start), count[at]))
        start *= 2
    doc, value, start, length, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        seed = mix(value ^ mix(start.astype(np.uint64)))
    return doc, seed, start, length.astype(float), count


def signatures(bags: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """64-bit signatures (documents x slots) of non-empty bags."""
    total = np.array([len(b) for b in bags], float)
    chosen = np.zeros((len(bags), slots), np.uint64)
    processes = _processes(bags)
    horizon = slots * (np.log(slots) + 3.0) / total
    done = np.zeros(len(bags), bool)
    while True:
        best = np.full(len(bags) * slots, np.inf)
        marks = np.zeros(len(bags) * slots, np.uint64)
        doc, seed, start, length, count = processes
        now, limit, wide, turn = np.zeros(len(doc)), horizon[doc], length > 1, 0
        any_wide = bool(wide.any())
        while len(doc):
            # Each process has its own clock: the k-th gap comes from its seed and k.
            with np.errstate(over="ignore"):
                h = mix(seed + np.uint64(turn) * np.uint64(0xD1342543DE82EF95))
            gap = np.log(uniform(h))
            now = now - (gap / length if any_wide else gap)
            inside = np.flatnonzero(now <= limit)
            doc, seed, now, limit, h = doc[inside], seed[inside], now[inside], limit[inside], h[inside]
            mark = mix(h ^ np.uint64(0x5A5A5A5A5A))
            cell = doc * slots + (((mark >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)
            time, counted = now, mark
            if any_wide:
                start, length, count, wide = start[inside], length[inside], count[inside], wide[inside]
                # On a wider interval a point has a place, which must lie below the document's count.
                place = start + np.floor(uniform(mix(mark)) * length)
                below = np.flatnonzero(~wide | (place < count))
                cell, time, counted = cell[below], now[below], mark[below]
            np.minimum.at(best, cell, time)
            first = np.flatnonzero(time == best[cell])
            marks[cell[first]] = counted[first]
            turn += 1
        full = ~np.isinf(best.reshape(len(bags), slots)).any(axis=1)
        chosen[full] = marks.reshape(len(bags), slots)[full]
        done |= full
        if done.all():
            return chosen
        # Documents with an empty component start anew with a wider horizon; the others are done.
        horizon = horizon * 2
        keep = ~done[processes[0]]
        processes = tuple(x[keep] for x in processes)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """documents x bands hashes of consecutive signature parts."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mix(keys * np.uint64(31) + parts[:, :, r])
        return mix(keys ^ np.arange(bands, dtype=np.uint64))


def _key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, class_id: the smallest doc_id with the same text; null texts are classes of their own."""
    keyed = store(docs.select("doc_id", _key().alias("key")), "keys")
    # Partial aggregation meets a key of many copies before the shuffle; the join back is a plain equi-join.
    shared = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(shared.select("key", "class_id"), "key", "left").select(
        "doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"))


def _nodes(rows: DataFrame, several: DataFrame | None) -> DataFrame:
    """Add the class's number: its class_id, or a hash for all but one of the classes with the same class_id."""
    if several is None:
        return rows.withColumn("node", F.when(F.col("key").isNotNull(), F.col("class_id")))
    first = several.select(F.col("doc_id").alias("class_id"), "low")
    own = F.col("low").isNull() | (F.col("low") == F.xxhash64("key"))
    return rows.join(first, "class_id", "left").withColumn("node", F.when(F.col("key").isNotNull(), F.when(
        own, F.col("class_id")).otherwise(F.xxhash64("key", "class_id")))).drop("low")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")


def _portions(batch: pa.RecordBatch, characters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of at most 256 texts and about so many characters, so that long texts need no more memory than short ones."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        size = min(256, max(1, int(np.searchsorted(ends, before + characters, "right")) - at))
        yield batch.slice(at, size)
        at += size


def _banded(texts: DataFrame, slots: int, bands: int) -> DataFrame:
    """class_id (smallest doc_id), key and band keys (array) of each text with words, from doc_id, key and text.

    Texts are signed where they are read, copies among each other too, so that signatures are shuffled and not texts.
    """

    def sign(batches) -> Iterator[pa.RecordBatch]:
        only("words")
        for batch in batches:
            for part in _portions(batch):
                # Copies within a part are signed once.
                least: dict[bytes, int] = {}
                bags: dict[bytes, np.ndarray] = {}
                for doc_id, key, text in zip(*(part.column(c) for c in ("doc_id", "key", "text")), strict=True):
                    doc_id, key = doc_id.as_py(), key.as_py()
                    if key not in bags:
                        bags[key] = shingles(byte_words(text.as_py()))
                    least[key] = min(doc_id, least.get(key, doc_id))
                full = [k for k, b in bags.items() if len(b)]
                if not full:
                    continue
                keys = band_keys(signatures([bags[k] for k in full], slots), bands).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([least[k] for k in full], pa.int64()), pa.array(full, pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands).cast(pa.list_(pa.int64()))], ["doc_id", "key", "keys"])

    signed = texts.mapInArrow(sign, "doc_id long, key binary, keys array<long>")
    return signed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("keys").alias("keys"))


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact overlap reaches the threshold."""
    left = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("bag_b"))

    def check(batches):
        only()
        for batch in batches:
            a, b = batch.column("bag_a"), batch.column("bag_b")
            keep = [
                overlap(np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)) >= threshold
                for x, y in zip(a, b, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(check, "a long, b long")


def _prefixes(ids: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Per document and shingle of its prefix: doc_id, shingle, total, before, reach, size.

    Shingles are ordered by how many of the documents have them. Two documents that reach the threshold share a shingle
    of their prefixes, and of the first one they share both have enough left: with ``before`` of ``total`` shingles
    ahead of it, the other document has at most ``reach`` in all. ``size`` groups totals for equi-joins. Shingles that only one
    document has come first in the order and need no row; a document whose prefix has no others can be linked with none.
    """

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(np.asarray(b.values), return_counts=True) for b in part.column("bag")]
                lengths = [len(v) for v, _ in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(part.column("doc_id").to_numpy(), lengths)), pa.array(np.concatenate([v for v, _ in found])),
                    pa.array(np.concatenate([c for _, c in found]).astype(np.int32))], ["doc_id", "shingle", "n"])

    def choose(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, docs, totals, chosen, places = batch.slice(at, 256), [], [], [], []
                for doc_id, total, shared in zip(*(part.column(c) for c in ("doc_id", "total", "shared")), strict=True):
                    df, shingle, n = (shared.values.field(k).to_numpy() for k in range(3))
                    order = np.lexsort((shingle, df))
                    total = total.as_py()
                    alone = total - int(n.sum())
                    before = alone + np.cumsum(n[order]) - n[order]
                    keep = np.flatnonzero(before < total - int(np.ceil(threshold * total - 1e-9)) + 1)
                    docs.append(np.full(len(keep), doc_id.as_py(), np.int64))
                    totals.append(np.full(len(keep), total, np.int64))
                    chosen.append(shingle[order][keep])
                    places.append(before[keep])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, totals, chosen, places)],
                                                 ["doc_id", "total", "shingle", "before"])

    own = bags.join(ids, "doc_id")
    counted = store(own.select("doc_id", "bag").mapInArrow(count, "doc_id long, shingle long, n int"), "shingles")
    common = counted.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = counted.join(common, "shingle").groupBy("doc_id").agg(F.collect_list(F.struct("df", "shingle", "n")).alias("shared"))
    sized = own.select("doc_id", F.size("bag").alias("total"))
    rows = shared.join(sized, "doc_id").select("doc_id", "total", "shared").mapInArrow(
        choose, "doc_id long, total long, shingle long, before long")
    # What is left must be threshold / (1 + threshold) of both totals.
    reach = F.least((F.col("total") - F.col("before")) * ((1 + threshold) / threshold) - F.col("total"), F.col("total") / threshold)
    return store(rows.withColumn("reach", reach + 1e-6).withColumn("size", _size(F.col("total"))), "prefixes")


def _size(total: Column) -> Column:
    return F.floor(F.log(total) * 20).cast("int")


def _with_components(prefix: DataFrame, joined: DataFrame) -> DataFrame:
    return prefix.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))


def _attempts(placed: DataFrame) -> DataFrame:
    """Up to three pairs (a, b) per document, with documents of other components that the bounds allow.

    Each shingle and range of totals has a hub, and a document tries one of its hubs. There are three kinds: narrow ranges
    with a hub drawn by lot, wide ones with the shortest document as hub (texts that others add something to),
    and wide ones, which end at other totals, with a hub drawn by lot.
    """
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.floor(F.log("total") * fineness + shift).alias("cell"), first.alias("first"))
        for kind, fineness, shift, first in ((0, 20, 0.0, F.lit(0)), (1, 4, 0.37, F.col("total").cast("int")), (2, 4, 0.81, F.lit(0)))])
    rows = placed.select("shingle", "doc_id", "component", "total", "reach", F.explode(kinds).alias("k")).select(
        "shingle", "k.kind", "k.cell", "k.first", "doc_id", "component", "total", "reach")
    hub = F.struct("first", F.xxhash64("doc_id", "kind").alias("lot"), F.col("doc_id").alias("hub"), F.col("component").alias("at"),
                   F.col("total").alias("hub_total"), F.col("reach").alias("hub_reach"))
    # Of two documents that can be linked over a shingle, one can be linked with others of its own length.
    cells = rows.groupBy("shingle", "kind", "cell").agg(
        F.min(F.when(F.col("reach") >= F.col("total"), hub)).alias("least"), F.min("component").alias("low"),
        F.max("component").alias("high")).where("low < high and least is not null").select(
        "shingle", "kind", "cell", "least.hub", "least.at", "least.hub_total", "least.hub_reach")
    tried = rows.join(cells, ["shingle", "kind", "cell"]).where("component <> at and total <= hub_reach and hub_total <= reach")
    tried = tried.groupBy("doc_id", "kind").agg(F.min(F.struct(F.xxhash64("hub", "doc_id"), "hub")).alias("one"))
    return tried.select(F.least("doc_id", "one.hub").alias("a"), F.greatest("doc_id", "one.hub").alias("b")).distinct()


def _apart(placed: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that share a shingle of their prefixes with enough left on both sides.

    In every shingle one component has the most documents; a pair holds at least one document of another one, so only
    those are joined with the rest, by shingle and size, and the bounds are part of the join.
    """
    held = placed.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    most = held.groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("kinds")).where(
        "kinds > 1").select("shingle", F.col("most.component").alias("main"))
    rows = placed.join(most, "shingle")
    # Totals from threshold times its own (which the other one's reach bounds) up to its reach.
    sizes = F.sequence(_size(F.col("total") * 0.5), _size(F.greatest("reach", F.col("total") * 0.5)))
    one = rows.where("component <> main").select("shingle", F.col("doc_id").alias("x"), F.col("component").alias("in_x"), F.col("total").alias("n_x"),
                                                 F.col("reach").alias("reach_x"), F.explode(sizes).alias("size"))
    two = rows.select("shingle", "size", F.col("doc_id").alias("y"), F.col("component").alias("in_y"), F.col("total").alias("n_y"),
                      F.col("reach").alias("reach_y"), (F.col("component") == F.col("main")).alias("is_main"))
    bounds = [one["shingle"] == two["shingle"], one["size"] == two["size"], F.col("in_x") != F.col("in_y"),
              F.col("is_main") | (F.col("x") < F.col("y")), F.col("n_y") <= F.col("reach_x"), F.col("n_x") <= F.col("reach_y")]
    return one.join(two, bounds).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, class_id, component_id (smallest id reachable over links), kept."""
    return _judged(docs, threshold, slots, bands).drop("key")


def _judged(docs: DataFrame, threshold: float = THRESHOLD, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """``near_duplicates`` with the key of each row's text."""
    plain = _plain(docs)
    grouped = store(classes(plain), "classes")
    # Ids with several texts; mostly there are none, and a class goes by its class_id.
    several = store(grouped.where("key is not null").groupBy("doc_id").agg(
        F.min(F.xxhash64("key")).alias("low"), F.max(F.xxhash64("key")).alias("high")).where("low < high").select("doc_id", "low"), "several")
    several = None if several.isEmpty() else several
    texts = plain.withColumn("key", _key()).where("key is not null")
    signed = store(_nodes(_banded(texts, slots, bands), several).withColumnRenamed("node", "doc_id"), "bands")
    buckets = signed.select("doc_id", F.posexplode("keys").alias("band", "key"))
    # Buckets of one member need nothing more; two counts and a minimum per key are added up before the shuffle.
    shared = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("n > 1")
    members = store(buckets.join(shared.select("band", "key", "pivot"), ["band", "key"]), "buckets")
    ids = members.select("doc_id").distinct()

    def measure(batches):
        only("words")
        for batch in batches:
            for part in _portions(batch):
                bags = [shingles(byte_words(t.as_py())).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bags, pa.list_(pa.int64()))], ["doc_id", "bag"])

    # The one shuffle of the texts: those of the candidates are picked out by id and text, and rows that repeat both go.
    wanted = signed.join(ids, "doc_id").select(F.col("doc_id").alias("node"), F.col("class_id").alias("doc_id"), "key")
    candidates = texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select(F.col("node").alias("doc_id"), "text")
    bags = store(candidates.mapInArrow(measure, "doc_id long, bag array<long>"), "bags")
    star = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = store(_verified(star, bags, threshold), "star")
    joined = store(components(links, "star-links"), "star-components")
    placed = members.select("doc_id", "band", "key").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    open_buckets = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rest = store(placed.join(open_buckets.select("band", "key"), ["band", "key"]).select("doc_id").distinct(), "open")
    prefix = _prefixes(rest, bags, threshold)
    fresh = store(_verified(_attempts(_with_components(prefix, joined)), bags, threshold), "fresh")
    if not fresh.isEmpty():
        links = links.union(fresh)
        joined = store(components(links, "grown-links"), "grown-components")
    across = _apart(store(_with_components(prefix, joined), "placed"))
    # Those that the stars have compared already are not compared again.
    across = across.join(star, ["a", "b"], "left_anti")
    links = store(links.union(_verified(across, bags, threshold)), "links")
    final = components(links, "near-links")
    reached = final.select(F.col("id").alias("node"), "component")
    placed = _nodes(grouped, several).join(reached, "node", "left").withColumn("component_id", F.coalesce("component", "node", "class_id"))
    kept = F.col("doc_id") == F.col("component_id")
    if several is not None:
        # A component is named by its smallest id, of whose texts it keeps one.
        least = placed.where("node is not null").groupBy("component_id").agg(F.min(F.struct("class_id", "key")).alias("least"))
        placed = placed.join(least, "component_id", "left").withColumn(
            "component_id", F.when(F.col("key").isNotNull(), F.col("least.class_id")).otherwise(F.col("class_id")))
        kept = kept & (F.col("key").isNull() | (F.col("key") == F.col("least.key")))
    return placed.withColumn("kept", kept).select("doc_id", "class_id", "component_id", "kept", "key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with its columns. Rows without an id cannot be judged and stay."""
    key, dropped_id, dropped_key = (unused(docs, name) for name in ("_key", "_dropped_id", "_dropped_key"))
    dropped = _judged(docs).where("not kept").select(F.col("doc_id").alias(dropped_id), F.col("key").alias(dropped_key)).distinct()
    named = docs.where("doc_id is not null").withColumn(key, _key())
    same = (F.col("doc_id").cast("long") == F.col(dropped_id)) & (F.col(key) == F.col(dropped_key))
    kept = named.join(dropped, same, "left_anti")
    return kept.dropDuplicates(["doc_id", key]).drop(key).unionByName(docs.where("doc_id is null"))
