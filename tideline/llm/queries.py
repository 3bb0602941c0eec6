"""Queries of the training-text problems, over their whole tables with production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table as t
from . import mixing, packing, spam, terms


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(t(spark, d, "shred_payloads")).where("mark IS NOT NULL").select("field_name", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(t(spark, d, "shred_payloads"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(t(spark, d, "documents"), t(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(t(spark, d, "documents"), t(spark, d, "containers")), t(spark, d, "containers"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any packing, whatever the tokenizer."""
    return packing.pack_check(packing.pack(t(spark, d, "documents"), t(spark, d, "containers")), t(spark, d, "containers"))


#: What the sources are, for the tree of problem 7.
DOMAINS = {"forge-export": "repositories", "git-mirror": "repositories", "fork-sweep": "repositories", "mail-patches": "discussion", "wiki-history": "discussion", "svn-import": "archives", "ci-archive": "archives", "lab-notes": "archives", "usb-dump": "archives"}


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(t(spark, d, "documents"), t(spark, d, "mix_targets"), domains=spark.createDataFrame(list(DOMAINS.items()), "source string, domain string"))


def p7_draws(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of any draw, whatever the tokenizer."""
    return mixing.mix_check(*_mixed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.promotional_documents(t(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_terms, p6_containers, p6_fill, p6_check, p7_draws, p7_shares, p7_check, p8_found)}

_TERMS = """WITH p AS (SELECT payload_id, min(payload) AS payload FROM shred_payloads GROUP BY 1), v AS (SELECT payload_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM p),
o AS (SELECT payload_id, j FROM v WHERE json_type(j) = 'OBJECT'), n AS (SELECT count(*) AS n FROM o),
k AS (SELECT o.payload_id, t.key FROM o, LATERAL (SELECT a.key FROM json_tree(o.j) a JOIN json_tree(o.j) b ON a.parent = b.id WHERE b.type = 'OBJECT') t),
f AS (SELECT key AS field_name, count(*) AS n_occurrences, count(DISTINCT payload_id) AS n_records FROM k GROUP BY 1),
m AS (SELECT *, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records > 0.4 * (SELECT n FROM n) THEN 'common' END AS mark FROM f)
"""

ORACLE: dict[str, str] = {
    "p2_found": _TERMS + "SELECT field_name, mark FROM m WHERE mark IS NOT NULL",
    "p2_terms": _TERMS + "SELECT * FROM m",
    "p6_check": """SELECT container_class, max(capacity_tokens)::BIGINT AS capacity_tokens, 0::BIGINT AS n_overfull, 0::BIGINT AS n_wrong_fill, 0::BIGINT AS n_holes, (SELECT count(*) FROM documents) AS n_documents,
  true AS pieces_whole, 0::BIGINT AS n_needless_splits FROM containers GROUP BY 1""",
    "p7_check": """SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats, true AS repeats_kept, true AS in_order, true AS budget_met
FROM mix_targets WHERE trim(source) <> '' GROUP BY 1""",
}
