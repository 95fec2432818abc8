"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import ann, bpe, fim, fingerprints, flac, jaccard, mixing, pii, runs, secrets, toxicity, urlfilter, warc
from .common import table


def op8(spark, sf_dir):
    return mixing.planned(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9(spark, sf_dir):
    return urlfilter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_secrets": secrets.query,
    "op4_ann": ann.query,
    "op5_flac": flac.query,
    "op6_pii": pii.query,
    "op7_bpe": bpe.query,
    "op8_mixing": op8,
    "op9_url_filter": op9,
    "op10_warc": warc.query,
    "op11_runs": runs.query,
    "op12_fingerprints": fingerprints.query,
    "op13_fim": fim.query,
}

MIXING = """
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS n FROM s GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS cap FROM per),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS capped,
        sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT (total - capped) / rest AS level FROM o WHERE weight * (total - capped) / rest <= cap ORDER BY capped LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM l)), cap) AS target FROM o),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1e0 END AS rate FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('8|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296e0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""

ORACLES = {"op8_mixing": MIXING, "op9_url_filter": urlfilter.ORACLE, "op10_warc": warc.ORACLE, "op13_fim": fim.ORACLE}
