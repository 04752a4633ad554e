"""The registered queries of the text operators, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import alignment, arrow_files, bagminhash, blocks, capfilters, decontaminate, lattice, packing, phrases, pseudonyms, quality, toxicity, warc
from seriesloom.llm.common import table
from seriesloom.llm.shipping import ship

# Only for the tests' tables; a real corpus gets a secret of its own.
PSEUDONYM_KEY = "synthetic corpus"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    """Register a query under its function's name."""

    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(ship(spark), folder)

    QUERIES[function.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored; learnt outside fold 0 of 5."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), parts=5, held=0)


@query
def op2_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the subword lattice; learnt outside fold 2 of 7."""
    return lattice.held_out_scores(table(spark, folder, "documents"), parts=7, held=2)


@query
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items, windows of 13 words."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of a label with a cosine of 0.98 or more."""
    return capfilters.near_vectors(table(spark, folder, "embeddings"))


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored; learnt outside fold 2 of 4."""
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"), parts=4, held=2)


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut and packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), "byte_bpe_50k.json", end_id=0)


@query
def op7_arrow_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' ids written to Arrow files and read back."""
    return arrow_files.token_files(spark, table(spark, folder, "documents"), "word_bpe_49k.json", end_id=2)


@query
def op8_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their personal data under pseudonyms."""
    return pseudonyms.pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY)


@query
def op9_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes and components of all documents: five-word shingles, weighted Jaccard of 0.8 or more."""
    return bagminhash.near_duplicates(table(spark, folder, "documents"))


@query
def op10_block_labeller(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, folder, "pages")
    return blocks.main_text(pages, blocks.train(pages))


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """All documents aligned between two vocabularies, with corpus-wide counts of linked ids."""
    return alignment.alignment(table(spark, folder, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")


@query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(spark, table(spark, folder, "pages"))


@query
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two to four words per language, over all documents."""
    return phrases.collocations(table(spark, folder, "documents"))


SQL: dict[str, str] = {
    "op13_collocations": r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), lists as (
    select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
), grams as (
    select lang, size, array_to_string(list_slice(w, pos, pos + size - 1), ' ') as phrase
    from (select lang, w, unnest(range(1, len(w) + 1)) as pos from lists), (values (1), (2), (3), (4)) sizes(size)
    where pos + size - 1 <= len(w)
), counts as (
    select lang, size, phrase, count(*) as f from grams group by lang, size, phrase
), totals as (
    select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by lang
), candidates as (
    select lang, size, phrase, f as a from counts where size > 1 and f >= 30
), superfluous as (
    select distinct c.lang, c.phrase from candidates c join candidates d
    on c.lang = d.lang and d.size > c.size and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') and 100 * d.a >= 80 * c.a
), cuts as (
    select lang, phrase, size, a, string_split(phrase, ' ') as w, unnest(range(1, size)) as k
    from candidates anti join superfluous using (lang, phrase)
), valued as (
    select c.lang, c.phrase, a, k, x.f as l, y.f as r, cast(2000000::hugeint * a // (x.f + y.f) as bigint) as score
    from cuts c
    join counts x on x.lang = c.lang and x.size = k and x.phrase = array_to_string(list_slice(w, 1, k), ' ')
    join counts y on y.lang = c.lang and y.size = c.size - k and y.phrase = array_to_string(list_slice(w, k + 1, c.size), ' ')
), lowest as (
    select * from valued qualify row_number() over (partition by lang, phrase order by score, k) = 1
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
""",
    "op12_warc": """
with payloads as (
    select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages
), firsts as (
    select digest, min(page_id) as first from payloads where n >= 100 group by digest
)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when first < page_id or page_id is null and first is not null then 'revisit' else 'response' end as record_type,
       case when first < page_id or page_id is null then first end as refers_to
from (select p.*, case when n >= 100 then first end as first from payloads p left join firsts using (digest))
""",
    "op4_cap_filters": """
with recursive vectors as (
    select vec_id, label, cast(embedding as double[]) as e,
           label is not null and embedding is not null and len(embedding) > 0
           and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
           and len(list_filter(embedding, lambda x: x <> 0)) > 0 as usable
    from embeddings
), links as (
    select a.vec_id as a, b.vec_id as b from vectors a join vectors b
    on a.label = b.label and a.vec_id <> b.vec_id and a.usable and b.usable and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98
), reach as (
    select vec_id, vec_id as seen from vectors
    union select r.vec_id, l.b from reach r join links l on l.a = r.seen
), counts as (
    select a as vec_id, count(*) as n from links group by a
)
select vec_id, coalesce(any_value(n), 0) as n_links, min(seen) as component_id, vec_id = min(seen) as kept
from reach left join counts using (vec_id) group by vec_id
""",
    "op3_decontamination": r"""
with cleaned as (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from documents
), items as (
    select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
    from benchmark
), spots as (
    select item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as pos from items where len(w) > 0
), windows as (
    select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, pos + 1, pos + 13), ' ') as words from spots
), lengths as (
    select distinct n from windows
), grams as (
    select doc_id, n, pos, array_to_string(list_slice(w, pos + 1, pos + n), ' ') as words
    from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as pos from cleaned cross join lengths where len(w) >= n)
), found as (
    select doc_id, pos, g.n, item_id from grams g join windows using (n, words)
), hits as (
    select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(range(pos, pos + n)) as p from found) group by doc_id
), named as (
    select doc_id, list_sort(list(distinct cast(item_id as varchar))) as ids from found group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(len(ids), 0) as bigint) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from cleaned left join hits using (doc_id) left join named using (doc_id)
""",
}
