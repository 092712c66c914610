"""Registered queries of the operators, with their SQL twins where SQL can express them."""

import public_tokenizers

from pyspark.sql import functions as F

from . import filter_audit, main_text, mixing, near_vectors, ngram_join, packing, pii, quality, simhash, sql, token_codes
from . import toxicity, urls, whitening
from .common import read

QUERIES = {}
ORACLE = {"op3_mixing": sql.MIXING, "op4_near_vectors": sql.NEAR_VECTORS, "op6_ngram_join": sql.NGRAM_JOIN,
          "op11_filter_audit": sql.FILTER_AUDIT}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


@query
def op2_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op3_mixing(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_near_vectors(spark, sf_dir):
    return near_vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op5_token_codes(spark, sf_dir):
    folder = token_codes.new_folder(spark)
    files = token_codes.write_tokens(read(spark, sf_dir, "documents"), folder,
                                     public_tokenizers.path("byte_bpe_50k.json"), end_id=2, spaced=True)
    return token_codes.read_tokens(files, folder)


@query
def op6_ngram_join(spark, sf_dir):
    return ngram_join.similar_groups(read(spark, sf_dir, "documents"))


@query
def op7_simhash(spark, sf_dir):
    return simhash.compare_edits(read(spark, sf_dir, "documents"))


@query
def op8_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1,
                        spaced=False)


@query
def op9_urls(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"))


@query
def op10_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "held_out", "expected_grade", "tail", "kept")


@query
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.cells_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@query
def op13_main_text(spark, sf_dir):
    return main_text.extract(read(spark, sf_dir, "pages"))


@query
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
