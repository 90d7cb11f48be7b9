"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import bpe, classifier, merkle, mixing, packing, quality_rules, sql, templates, whitening
from provena.llm.common import table
from provena.llm.dartminhash import near_duplicates
from provena.llm.quotations import link_quotations
from provena.llm.secrets import scan_secrets
from provena.llm.topk import exact_topk, integer_vectors
from provena.llm.url_filters import Rule, judge_urls

URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_topk(vectors.filter(F.pmod("vec_id", F.lit(50)) == 0), vectors, k=5)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the public tokenizers; PROVENA_TOKENIZERS names another folder that holds them."""
    if folder := os.environ.get("PROVENA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def quoted_turns_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over the conversations with quotations of earlier turns, nested ones and those of others put into them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = lambda t: F.get(F.split(t, "\n"), 0)
    back = lambda k, name: c.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("role").alias(f"{name}_role"), first("text").alias(name))
    begun = c.filter("turn = 0").select((F.col("conv_id") - 1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), first("text").alias("o"))
    rows = c.join(back(1, "b"), ["conv_id", "turn"], "left").join(back(2, "a"), ["conv_id", "turn"], "left").join(begun.filter("conv_id % 5 = 0"), ["conv_id", "turn"], "left")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in (*parts, "\n")))
    nested = F.concat(line("On Monday ", F.col("b_role"), " wrote:"), line(">> ", F.replace("a", F.lit(" "), F.lit("  "))), line("> ", F.col("b")), F.lit("\n"))
    quote = F.when(F.col("b").isNotNull() & F.col("a").isNotNull() & (F.col("turn") % 4 == 2), nested).when(F.col("b").isNotNull(), line("> ", F.col("b"))).when(F.col("o").isNotNull(), line("> > ", F.col("o"))).otherwise("")
    return link_quotations(rows.select("conv_id", "turn", F.concat(quote, "text").alias("text")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = bpe.build_lexicon(docs, tokenizer_path())
    rows = bpe.encode(docs, tokenizer_path(), lexicon)
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def linked_pages_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter over the pages with canonical links and redirects of all kinds added to many of them."""
    pages, n = table(spark, sf_dir, "pages"), F.col("page_id").cast("long")
    rest = lambda k: (n % k).cast("string")
    hub = F.concat(F.lit("http://hub.example.net/de/"), rest(5))
    link = (
        F.when(n % 21 == 0, F.concat(F.lit('<meta http-equiv="refresh" content="0; url='), hub, F.lit('">')))
        .when(n % 15 == 0, F.concat(F.lit('<link rel="canonical" href="//mirror'), rest(4), F.lit(".example.org/fr/x?p="), rest(3), F.lit('">')))
        .when(n % 12 == 0, F.concat(F.lit('<link rel="canonical" href="../fr/./all?p='), rest(7), F.lit('#top">')))
        .when(n % 3 == 0, F.concat(F.lit('<link href="/index?page='), rest(2), F.lit('" rel="canonical">')))
        .when(n % 7 == 0, F.concat(F.lit('<meta http-equiv=refresh content="0; url='), hub, F.lit('">')))
        .otherwise("")
    )
    return judge_urls(pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), link)), URL_RULES)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = mixing.score(docs, ~mixing.held_out(F.col("doc_id")))
    return scored.select("doc_id", mixing.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quotation_links": op4_quotation_links,
    "op5_bpe": op5_bpe,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_url_filter": op7_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_context_mixing": op10_context_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_html_extraction": op13_html_extraction,
    "linked_pages_filter": linked_pages_filter,
    "quoted_turns_links": quoted_turns_links,
}

ORACLE_SQL = {
    "op1_topk": sql.TOPK,
    "op4_quotation_links": sql.QUOTATIONS,
    "op7_url_filter": sql.URL_FILTER,
    "op11_merkle_manifest": sql.MANIFEST,
    "op13_html_extraction": sql.ARTICLES,
    "linked_pages_filter": sql.LINKED_URL_FILTER,
    "quoted_turns_links": sql.QUOTED_LINKS,
}
