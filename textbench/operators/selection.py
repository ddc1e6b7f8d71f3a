"""SEL1, JN1, JN2: the synthetic document-selection dataset.

``range(samples)`` in the reference becomes a DataFrame of sample ids; every
random choice is a P1 hash of (seed, sample id, purpose), so each sample is
independent of all others and of partitioning.  Document texts are fetched
with one equi-join of (sample, position, index) rows against the densely
indexed corpus, then regrouped per sample (at most ``max_docs + 1`` rows
each); phrase checks only look inside that small group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_randint, hash_uniform, with_scalars
from textbench.functions.text import REFUSAL_TEXT, content_query, index_query, phrase_in_docs, sample_phrase
from textbench.operators.ranking import dense_index
from textbench.session import written
from textbench.operators.splits import decoy_index, sample_k_of_n


@dataclass(frozen=True)
class SelectionConfig:
    """Selection knobs; fixed values: the reference's defaults."""

    min_docs: int = 2
    max_docs: int = 8
    train_samples: int = 100000
    eval_samples: int = 2000
    content_query_rate: float = 0.5
    refusal_rate: float = 0.2
    refusal_oob_rate: float = 0.5
    min_phrase_words: int = 3
    max_phrase_words: int = 6
    refusal_text: str = REFUSAL_TEXT


def index_ids(corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, idx): the dense 0-based position of every id, written once to the
    shared folder.  Only ids are ranked; texts and vectors stay where they are."""
    return written(dense_index(corpus.select(id_col), id_col, "idx"), "dense-ids")


def lookup_docs(refs: DataFrame, ids: DataFrame, corpus: DataFrame, key_cols: list[str], idx_array: str,
                out_col: str = "texts", value_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """JN1: ``idx_array`` (array of dense indices) → ordered array of
    ``value_col`` values: ``posexplode``, an equi-join with the ids (longs
    only), one with the corpus, and a regroup per key."""
    x = refs.select(*key_cols, F.posexplode(idx_array).alias("__pos", "idx"))
    j = x.join(ids.select("idx", id_col), "idx").join(corpus.select(id_col, value_col), id_col)
    g = j.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct(F.col("__pos"), F.col(value_col).alias("v")))).alias("__s"))
    return g.select(*key_cols, F.transform("__s", lambda s: s["v"]).alias(out_col))


def gather_embeddings(refs: DataFrame, ids: DataFrame, vectors: DataFrame, key_cols: list[str], idx_array: str,
                      max_docs: int, dim: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """JN2: indices → embeddings zero-padded to ``max_docs`` slots plus a
    boolean ``doc_mask`` (``dim`` defaults to the gathered vectors' size)."""
    g = lookup_docs(refs, ids, vectors, key_cols, idx_array, "__emb", "embedding", id_col)
    width = F.lit(dim) if dim is not None else F.size(F.element_at("__emb", 1))
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    pad = F.greatest(F.lit(0), F.lit(max_docs) - F.size("__emb"))
    return g.select(
        *key_cols,
        F.concat(F.col("__emb"), F.array_repeat(zero, pad)).alias("doc_embeddings"),
        F.concat(F.array_repeat(F.lit(True), F.size("__emb")), F.array_repeat(F.lit(False), pad)).alias("doc_mask"),
        F.size("__emb").alias("doc_count"),
    )


def selection_plan(ids: DataFrame, samples: DataFrame | None = None, cfg: SelectionConfig = SelectionConfig(),
                   seed: int = 42, sample_col: str = "sample_id") -> DataFrame:
    """Everything about the samples that needs no text: ``sample_id, doc_count,
    doc_indices, is_refusal, content, use_decoy, decoy, target_pos``.  ``ids`` as
    of :func:`index_ids`; ``samples`` defaults to one per document.  An empty
    corpus raises at run time, as in the reference."""
    if samples is None:
        samples = ids.select(F.col("idx").alias(sample_col))
    sid = F.col(sample_col)
    n_docs = ids.groupBy().agg(F.count(F.lit(1)).alias("__N"))
    s = with_scalars(samples.select(sample_col), n_docs)
    N = F.when(F.col("__N") > 0, F.col("__N")).otherwise(F.raise_error(F.lit("Selection dataset is empty")).cast("long"))
    k = F.greatest(F.lit(1), F.least(hash_randint(cfg.min_docs, cfg.max_docs, seed, sid, F.lit("count")), N))
    s = s.withColumn("doc_count", k.cast("int"))
    s = s.withColumn("doc_indices", sample_k_of_n(F.col("doc_count").cast("long"), F.col("__N"), seed, sid))
    s = s.withColumn("is_refusal", hash_uniform(seed, sid, F.lit("refusal")) < cfg.refusal_rate)
    s = s.withColumn("content", hash_uniform(seed, sid, F.lit("content")) < cfg.content_query_rate)
    oob_flip = hash_uniform(seed, sid, F.lit("oob")) < cfg.refusal_oob_rate
    s = s.withColumn("use_decoy", F.col("is_refusal") & ~(oob_flip | (F.col("__N") <= F.col("doc_count"))))
    s = s.withColumn("decoy", F.when(F.col("use_decoy"), decoy_index(F.col("__N"), F.col("doc_indices"), seed, sid)))
    return s.withColumn("target_pos", hash_randint(0, F.col("doc_count") - 1, seed, sid, F.lit("target"))).drop("__N")


def split_samples(spark: SparkSession, cfg: SelectionConfig, split: str, seed: int = 42) -> tuple[DataFrame, int]:
    """(samples, seed) of a split with a fixed number of samples: ``train`` has
    ``train_samples`` and the seed, ``eval`` has ``eval_samples`` and seed + 1."""
    n = {"train": cfg.train_samples, "eval": cfg.eval_samples}[split]
    return spark.range(n).withColumnRenamed("id", "sample_id"), seed + (split == "eval")


def selection_dataset(corpus: DataFrame, samples: DataFrame | None = None, cfg: SelectionConfig = SelectionConfig(),
                      seed: int = 42, sample_col: str = "sample_id", id_col: str = "doc_id") -> DataFrame:
    """SEL1: one example per sample id:
    ``sample_id, doc_indices, query, target_text, doc_count, is_refusal, query_kind``.

    ``corpus`` = ``(doc_id, text)``.  Only the ids are ranked (a shuffle of
    longs).  What a sample needs is known before any text is fetched: a content
    query looks at all its documents, a position query at its target alone, a
    refusal with a decoy at its documents and the decoy, any other refusal at
    none.  Those texts move once to meet their (sample, position) references
    and once more to be grouped per sample.  ``samples`` defaults to one per
    document (see :func:`split_samples` for the fixed-size splits)."""
    ids = index_ids(corpus, id_col)
    s = selection_plan(ids, samples, cfg, seed, sample_col)
    sid, kk, tpos = F.col(sample_col), F.col("doc_count"), F.col("target_pos")
    none = F.array().cast("array<bigint>")
    everything = F.concat("doc_indices", F.when(F.col("use_decoy"), F.array("decoy")).otherwise(none))
    wanted = (F.when(F.col("use_decoy") | (~F.col("is_refusal") & F.col("content")), everything)
              .when(~F.col("is_refusal"), F.array(F.element_at("doc_indices", (tpos + 1).cast("int")))).otherwise(none))
    need = s.select(sample_col, F.posexplode(wanted).alias("__pos", "idx"))
    refs = need.join(ids, "idx").join(corpus.select(id_col, "text"), id_col)
    texts = refs.groupBy(sample_col).agg(
        F.array_sort(F.collect_list(F.struct("__pos", "text"))).alias("__t")).select(
        sample_col, F.transform("__t", lambda x: x["text"]).alias("texts"))
    # left join: samples that need no text keep their row
    s = s.join(texts, sample_col, "left")
    docs = F.slice("texts", 1, kk)
    alone = ~F.col("is_refusal") & ~F.col("content")
    target_text = F.when(alone, F.get("texts", F.lit(0))).when(~F.col("is_refusal"), F.get("texts", tpos.cast("int")))
    s = s.withColumn("__tpos", tpos).withColumn("__ttext", target_text)
    phrase_t = sample_phrase(F.col("__ttext"), seed, sid, F.lit("tphrase"),
                             min_words=cfg.min_phrase_words, max_words=cfg.max_phrase_words)
    s = s.withColumn("__pt", F.when(F.col("content"), phrase_t))
    t_ok = (F.col("__pt") != "") & ~phrase_in_docs(F.col("__pt"), docs, F.col("__tpos"))
    decoy_text = F.get("texts", kk.cast("int"))
    phrase_d = sample_phrase(decoy_text, seed, sid, F.lit("dphrase"),
                             min_words=cfg.min_phrase_words, max_words=cfg.max_phrase_words)
    s = s.withColumn("__pd", F.when(F.col("use_decoy"), phrase_d))
    d_ok = F.col("use_decoy") & (F.col("__pd") != "") & ~phrase_in_docs(F.col("__pd"), docs)
    oob = kk + hash_randint(F.lit(1), F.greatest(F.lit(2), F.floor(kk / 2)), seed, sid, F.lit("oobpos"))
    rt = cfg.refusal_text
    kind = (F.when(~F.col("is_refusal") & F.col("content") & t_ok, "content")
            .when(~F.col("is_refusal"), "position")
            .when(d_ok, "refusal_content").otherwise("refusal_position"))
    s = s.withColumn("query_kind", kind)
    query = (F.when(F.col("query_kind") == "content", content_query(kk, F.col("__pt"), rt))
             .when(F.col("query_kind") == "position", index_query(kk, F.col("__tpos") + 1, rt))
             .when(F.col("query_kind") == "refusal_content", content_query(kk, F.col("__pd"), rt))
             .otherwise(index_query(kk, oob, rt)))
    return s.select(
        sid, "doc_indices", query.alias("query"),
        F.when(F.col("is_refusal"), F.lit(rt)).otherwise(F.col("__ttext")).alias("target_text"),
        "doc_count", "is_refusal", "query_kind",
    )
