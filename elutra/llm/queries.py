"""The queries of the corpus operators, with production parameters. ``QUERIES`` and ``SQL`` go into the entry file."""

from __future__ import annotations

import importlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elutra.llm.shared import table


def tokenizer_file(name: str) -> str:
    """A vocabulary's path: in the folder of ELUTRA_TOKENIZERS, or in the installed package."""
    folder = os.environ.get("ELUTRA_TOKENIZERS")
    return os.path.join(folder, name) if folder else importlib.import_module("public_tokenizers").path(name)


def op1_html_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import html_text

    return html_text.pages_text(table(spark, sf_dir, "pages"))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from elutra.llm.bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN, keep=True)


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import simhash

    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op4_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import licenses

    found = licenses.licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.to_json("spans"))


def op5_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import token_files

    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op6_embedding_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import embed_dedup

    return embed_dedup.group(table(spark, sf_dir, "embeddings"))


def op7_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return quality.score(docs, quality.fit(docs, labels.where(~held_out))).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_decontam_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import decontam

    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = langid.identify(docs, langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import conversations

    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from elutra.llm import word_bpe

    return word_bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


QUERIES = {
    "op1_html_layout_text": op1_html_layout_text,
    "op2_bpe_transducer": op2_bpe_transducer,
    "op3_simhash_vptree": op3_simhash_vptree,
    "op4_license_templates": op4_license_templates,
    "op5_arrow_token_files": op5_arrow_token_files,
    "op6_embedding_rp_forest": op6_embedding_rp_forest,
    "op7_toxicity_ordinal": op7_toxicity_ordinal,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontam_string_tiling": op9_decontam_string_tiling,
    "op10_hyperdimensional_langid": op10_hyperdimensional_langid,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pair_index_bpe": op13_pair_index_bpe,
}

SQL: dict[str, str] = {
    "op11_phrase_collocations": """
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3), (4)) AS sizes(k)),
f AS (SELECT lang, CAST(k AS BIGINT) AS k, phrase, count(*) AS a FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM f WHERE k >= 2 AND a >= 30),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM frequent s JOIN frequent b ON s.lang = b.lang AND s.k < b.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 80 * s.a),
left_over AS (SELECT * FROM frequent ANTI JOIN covered USING (lang, phrase)),
cuts AS (SELECT lang, k, phrase, a, unnest(range(1, k)) AS j, string_split(phrase, ' ') AS w FROM left_over),
scored AS (SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
 FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1 : ], ' ')),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
best AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN n USING (lang) WHERE rank <= 2000""",
}
