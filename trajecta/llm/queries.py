"""The corpus operators' queries and SQL oracles, by name."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import decontaminate, hmm, html, jaccard, language, licenses, media, mining, packing, pii, quality, substrings, whitening
from trajecta.session import table


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The path of one of the public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: For tables of invented persons alone: who has this module can invert pseudonyms that were made with it.
PUBLIC_KEY = b"a public key for tables of invented persons"


def pii_key(spark: SparkSession) -> bytes:
    """The session's key of pseudonyms, or the public one, with a warning. Either way it is the same in every session, so
    that what one has written stays linked with what another writes."""
    try:
        return pii.secret_key(spark)
    except ValueError:
        warnings.warn(f"{pii.SETTING} isn't set: pseudonyms are made with the public key of the tests", stacklevel=2)
        return PUBLIC_KEY


def op1_hmm(spark: SparkSession, root: str) -> DataFrame:
    """Hidden Markov and unigram log probabilities of every document."""
    return hmm.held_out_scores(table(spark, root, "documents"))


def op2_quality(spark: SparkSession, root: str) -> DataFrame:
    """Quality score of every document."""
    return quality.classify(table(spark, root, "documents"), table(spark, root, "labels"))


def op3_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item and its containment."""
    return decontaminate.contaminated(table(spark, root, "documents"), table(spark, root, "benchmark"))


def op4_main_text(spark: SparkSession, root: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, root, "pages"))


def op5_pii(spark: SparkSession, root: str) -> DataFrame:
    """Every document's text with pseudonyms, how many values moved and of which kinds."""
    return pii.protect(table(spark, root, "documents"), pii_key(spark), report=True)


def op6_language(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document."""
    return language.identify(table(spark, root, "documents"))


def op7_license_scan(spark: SparkSession, root: str) -> DataFrame:
    """License phrases and passages of every document."""
    return licenses.summary(table(spark, root, "documents"))


def op8_packing(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(table(spark, root, "documents"), tokenizer(), with_ids=False)


def op9_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    """Group of every document under links of Jaccard similarity 0.9 on word trigrams."""
    return jaccard.join(table(spark, root, "documents"))


def op10_webp(spark: SparkSession, root: str) -> DataFrame:
    """Every document stored as lossless WebP and read back: sizes, digests and features."""
    return media.describe(media.encode_texts(table(spark, root, "documents")))


def op11_whitening(spark: SparkSession, root: str) -> DataFrame:
    """First components of every embedding, whitened."""
    return whitening.whiten(table(spark, root, "embeddings"))


def op12_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Hard negatives of every anchor (a row whose vec_id is divisible by 100) and each of its positives."""
    return mining.hard_negatives(mining.relabelled(table(spark, root, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_substrings(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the 50-word passages that documents of smaller id have."""
    return substrings.summary(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm": op1_hmm,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_main_text": op4_main_text,
    "op5_pii": op5_pii,
    "op6_language": op6_language,
    "op7_license_scan": op7_license_scan,
    "op8_packing": op8_packing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_webp": op10_webp,
    "op11_whitening": op11_whitening,
    "op12_negatives": op12_negatives,
    "op13_substrings": op13_substrings,
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, least(len(w), 5) AS g, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT g FROM i),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - g + 2), lambda k: array_to_string(w[k:k + g - 1], ' '))) AS s FROM d, sizes),
s0 AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - g + 2), lambda k: array_to_string(w[k:k + g - 1], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_item FROM s0 GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM ds JOIN s0 USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""

_GRAMS = "list_transform(range(1, len({w}) - 1), lambda k: array_to_string({w}[k:k+2], ' '))"
_KNOWN = ", ".join(f"({k}, '{label}', {k < len(licenses.PHRASES)}, '{text}')" for k, (label, text) in enumerate([*licenses.PHRASES, *licenses.TEMPLATES]))

_OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
known AS (SELECT template, label, base, string_split(phrase, ' ') AS words FROM (VALUES {_KNOWN}) AS t(template, label, base, phrase)),
facts AS (SELECT *, len(words) - 2 AS n_grams, len(words) AS n, {_GRAMS.format(w="words")} AS grams FROM known),
kg AS (SELECT template, unnest(grams) AS g, generate_subscripts(grams, 1) - 1 AS at_ FROM facts),
dgl AS (SELECT r, {_GRAMS.format(w="w")} AS l FROM d),
dg AS (SELECT r, unnest(l) AS g, generate_subscripts(l, 1) - 1 AS i FROM dgl),
votes AS (SELECT r, template, i - at_ AS diagonal, count(*) AS votes, min(i) AS lo, max(i) AS hi FROM dg JOIN kg USING (g) GROUP BY ALL),
steps AS (SELECT v.*, f.n_grams, coalesce(diagonal - lag(diagonal) OVER p > {licenses.DRIFT} OR lo - lag(hi) OVER p > f.n, true) AS apart FROM votes v JOIN facts f USING (template) WHERE NOT f.base WINDOW p AS (PARTITION BY r, template ORDER BY diagonal, lo)),
runs AS (SELECT *, sum(apart::INT) OVER (PARTITION BY r, template ORDER BY diagonal, lo) AS run FROM steps),
merged AS (SELECT r, template, min(lo) AS lo, max(hi) AS hi FROM runs GROUP BY r, template, run, n_grams HAVING sum(votes) >= n_grams * {licenses.COVER} - 1e-9),
span AS (SELECT r, template, lo, {_GRAMS.format(w="s")} AS g FROM (SELECT r, template, lo, w[lo + 1:hi + 3] AS s FROM merged JOIN d USING (r))),
found AS (SELECT r, label, false AS base, lo AS start, len(list_distinct(list_intersect(g, grams))) / len(list_distinct(grams)) AS cover FROM span JOIN facts USING (template)
  UNION ALL SELECT r, label, true, diagonal, 1.0 FROM votes JOIN facts USING (template) WHERE base AND votes = n_grams),
sums AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM found WHERE base OR cover >= {licenses.COVER} - 1e-9 GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN sums USING (r)
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, r, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda k: array_to_string(w[k:k + 49], ' '))) AS s FROM d WHERE doc_id IS NOT NULL),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
later AS (SELECT r, list(p) AS starts FROM win JOIN firsts USING (s) WHERE doc_id > first GROUP BY r),
gone AS (SELECT r, list_distinct(flatten(list_transform(starts, lambda p: range(p, p + 50)))) AS at_ FROM later),
kept AS (SELECT doc_id, len(w) AS n, CASE WHEN at_ IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(at_, k))) END AS k FROM d LEFT JOIN gone USING (r))
SELECT doc_id, n AS n_words, n - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id AS anchor_id, label AS own, v AS av FROM e WHERE vec_id % 100 = 0),
s AS (SELECT anchor_id, own = label AS same, vec_id, list_dot_product(av, v)::BIGINT AS score FROM a, e WHERE anchor_id <> vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
h AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM h WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op3_decontamination": _OP3, "op7_license_scan": _OP7, "op12_negatives": _OP12, "op13_substrings": _OP13}
