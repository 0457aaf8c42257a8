"""Registered queries of the corpus operators; a query without SQL is tested against brute force."""

from panelwright.llm import alignment, decontaminate, hostrules, jaccard, language, lm, packing, pii, quality, topk, toxicity, trie, urls


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.contamination_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_pack(spark, sf_dir):
    return packing.packing_digest(_table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_language(spark, sf_dir):
    return language.language_digest(_table(spark, sf_dir, "documents"))


def op6_lm_score(spark, sf_dir):
    return lm.lm_digest(_table(spark, sf_dir, "documents"))


def op7_topk(spark, sf_dir):
    return topk.top_k_digest(_table(spark, sf_dir, "embeddings"))


def op8_pii(spark, sf_dir):
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op9_urls(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.alignment_digest(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark, sf_dir):
    return trie.trie_digest(_table(spark, sf_dir, "conversations"))


def op13_host_rules(spark, sf_dir):
    return hostrules.host_rules_digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pack, op3_jaccard_join, op4_quality, op5_language, op6_lm_score, op7_topk,
                                     op8_pii, op9_urls, op10_toxicity, op11_alignment, op12_prefix_trie,
                                     op13_host_rules)}
SQL = {"op1_decontaminate": decontaminate.SQL, "op7_topk": topk.SQL, "op12_prefix_trie": trie.SQL, "op13_host_rules": hostrules.SQL}
