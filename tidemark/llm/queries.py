"""The registered queries of this subpackage, one function opN_<name>(spark, sf_dir) each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, mixing, mtree, repair
from ._spark import table
from .bpe import encode_decode_digests
from .chat import format_chats, read_back, with_control_case
from .html_extract import extract_pages
from .jaccard_join import near_duplicates
from .media import media_features, to_media
from .mtree import top_k
from .packing import pack
from .quality import fit, held_out, scored
from .spelling import spelling_variants, words
from .substring_dedup import dedup_substrings


def vocabulary_path() -> str:
    """The public byte-level vocabulary of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    kept = F.coalesce("kept_text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), window=13, digest=True, layout=False)


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(to_media(table(spark, sf_dir, "documents")))
    return found.drop("frame_offsets")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return scored(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_chats(with_control_case(table(spark, sf_dir, "conversations"))))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damage(table(spark, sf_dir, "conversations")))


def op12_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(words(table(spark, sf_dir, "documents")))


_ALL = (
    op1_jaccard_join, op2_line_dedup, op3_substring_dedup, op4_mpeg_audio, op5_html_extract, op6_factorisation_machine, op7_mtree_search,
    op8_hilbert_packing, op9_bpe, op10_chat_format, op11_conversation_repair, op12_fair_queueing, op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL_BY_QUERY: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op7_mtree_search": mtree.ORACLE,
    "op11_conversation_repair": repair.ORACLE,
    "op12_fair_queueing": mixing.ORACLE,
}
