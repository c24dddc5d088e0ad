"""Registered queries of the text operators, over whole tables, and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helioframe.llm import (
    bpe,
    chat,
    decontam,
    infill,
    licenses,
    mixing,
    near_dups,
    placement,
    pseudonyms,
    quality_rules,
    rule_ensemble,
    token_counts,
    variants,
)
from helioframe.llm.common import table

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: The key of the registered queries. A deployment hands in its own secret.
PSEUDONYM_KEY = "key of the registered queries"


def op1_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, key=PSEUDONYM_KEY, count="n_values")


def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, d, "documents"), size=3, percent=85)


def op5_shard_lookup(spark: SparkSession, d: str) -> DataFrame:
    return placement.placed(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id", SHARDS)


def op6_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.log_of_turns(turns.unionByName(chat.control_case(spark)))
    return chat.conversation_digests(chat.formatted_turns(log))


def op7_rule_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return rule_ensemble.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(table(spark, d, "documents"), public_tokenizers.path(WORD_BPE))


def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_matches(table(spark, d, "documents"), templates=licenses.read_templates())


def op10_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.digests(table(spark, d, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op11_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"))


def op12_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    return infill.digests(table(spark, d, "documents"))


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants.document_variants(table(spark, d, "documents"))


REGISTRY = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_pseudonyms,
        op3_quality_rules,
        op4_near_duplicates,
        op5_shard_lookup,
        op6_chat_format,
        op7_rule_ensemble,
        op8_token_counts,
        op9_license_scan,
        op10_byte_bpe,
        op11_source_mix,
        op12_fill_in_middle,
        op13_spelling_variants,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
        items AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
                  FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM items),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, i, n, item_id FROM places JOIN items USING (n, win)),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
                  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_near_duplicates": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
                   FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
                  WHERE 100 * k >= 85 * (p.n + q.n - k)),
        reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
        least AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON x = d.doc_id""",
    "op6_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
        e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS body,
                     replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') AS head FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(text, '') AS t, text,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        k AS (
            SELECT doc_id, source, size,
                   -ln((CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || t), 1, 13) AS BIGINT)
                        + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
                   / CASE WHEN t = '' THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE,
                       length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / length(t)) END AS key
            FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
        w AS (
            SELECT *, source_size * 2.0::DOUBLE AS cap,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM s),
        o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS o FROM w),
        l AS (
            SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                       - coalesce(sum(cap) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM o),
        f AS (SELECT min(o) AS first_open, arg_min(level, o) AS height FROM l WHERE level * weight <= cap),
        t AS (SELECT source, source_size, CASE WHEN o >= first_open THEN height * weight ELSE cap END AS target
              FROM l LEFT JOIN f ON true),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
        r AS (SELECT *, CAST(floor(target) AS BIGINT) - epochs * source_size AS rest FROM e),
        c AS (
            SELECT doc_id, k.source, size, source_size, target, epochs, rest,
                   sum(size) OVER (PARTITION BY k.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
            FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, source, size, source_size, target,
               CAST(epochs * size + greatest(least(size, rest - before), 0) AS BIGINT) AS taken
        FROM c""",
    "op12_fill_in_middle": r"""
        WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
        u AS (
            SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w,
                   CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4
            FROM h),
        c AS (
            SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a,
                   greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM u),
        p AS (
            SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS x, coalesce(array_to_string(w[a + 1:b], ''), '') AS y,
                   coalesce(array_to_string(w[b + 1:n], ''), '') AS z
            FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y
                      ELSE '<P>' || x || '<S>' || z || '<M>' || y END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p""",
}
