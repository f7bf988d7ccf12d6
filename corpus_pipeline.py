"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing, token files.

Each stage works on all that its predecessor kept; all but the last return the columns of documents. Every stage's
result is written as Parquet to the shared folder and read again as the next stage's documents.

Defined results: a null, empty or letterless text goes with the language stage; of equal rows (repeated rows included)
near-dedup keeps one, of ties the row with the smallest other columns; rows with a null doc_id or one doc_id and
different texts are documents of their own throughout; a null source is a source; an empty table passes every stage
empty; further columns, whatever their names, stay with their rows up to the last stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.llm import contamination, langid, mixing, simhash, tokenfile
from tessera.llm.common import discard, drop_paths, materialise, read_table, unused, watched

LEAST_LANGUAGE_SCORE = 0.3
LEAST_ITEMS = 1
_SCRATCH: list[str] = []


def stage(f):
    """A stage's result is written before the next stage begins, so that one can drop what this one left in scratch."""
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _SCRATCH)
        with watched() as used:
            out = f(spark, docs, sf_dir)
        _SCRATCH.extend(used)
        return out

    return run_stage


MOST_REPEATS = 1.5
TOKENIZER, END_ID = "word_bpe_49k.json", 1


@stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those whose language the network can't tell.

    The network learns from every labelled text outside the held-out quarter.
    """
    usable = langid.learnable()
    model = langid.learn_all(docs, langid.train(docs, usable=usable), usable=usable)
    label, found = langid.predictor(spark, model), unused("found", docs)
    judged = docs.withColumn(found, label(F.col("text")))
    return judged.where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= LEAST_LANGUAGE_SCORE)).select(*plain(docs))


def plain(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def text_key() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def row_key() -> Column:
    """doc_id and text as one string: sorts by doc_id, null last, then by the text's MD5."""
    ordered = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(ordered, F.lit("null")), text_key())


@stage
def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (null last), then text hash, stays, once.

    Texts link as `simhash.near_duplicates` says: by fingerprint, or by five-word shingles of similarity 0.8 or more.
    """
    key = unused("key", docs)
    keyed = docs.withColumn(key, row_key())
    kept = materialise(simhash.near_duplicates(keyed, id_col=key).select(F.col("component_id").alias(key)).distinct(), "kept")
    # both the join and the choice among equal rows go by the key, so whole texts are shuffled once
    copy = unused("copy", keyed)
    same = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    once = keyed.join(kept, key, "left_semi").withColumn(copy, F.row_number().over(same))
    return once.where(F.col(copy) == 1).select(*plain(docs))


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose own text holds a passage (a window of eight words) of any benchmark item, whatever their doc_id.

    Operator 2's query calls a document contaminated from two items on; a corpus to train on keeps none of either.
    """
    key = unused("key", docs)
    keyed = docs.withColumn(key, text_key())
    index = contamination.build_index(keyed, id_col=key, key_bytes=32)
    marked = contamination.judged(contamination.search(index, read_table(spark, sf_dir, "benchmark"), key_bytes=32), least_items=LEAST_ITEMS)
    bad = materialise(marked.where("contaminated").select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    discard(index)
    return keyed.join(bad, key, "left_anti").select(*plain(docs))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; documents of small sources again, in seeded order, up to the repetition limit."""
    return mixing.mixed(docs, mixing.plan(docs, max_repeats=MOST_REPEATS)).select(*plain(docs))


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokenfile.read_token_files(tokenfile.write_token_files(docs, public_tokenizers.path(TOKENIZER), END_ID))


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: SQL can express neither the network, the components nor the bisection; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, f in STAGES:
        docs = materialise(f(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    drop_paths(spark, _SCRATCH)
    return docs
