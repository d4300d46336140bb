"""The `opN_<name>` queries over the driver's tables, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, digest_index, flac, lang_id, main_text, mixing, near_dup, quality_fm, quality_rules, revisit, spelling, token_pack, word_runs
from lamina.session import ship, table


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of a capture log over all `pages`, resolved; one row per record."""
    out = revisit.resolve(revisit.captures(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", revisit.header_text("headers"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each of all `documents`."""
    return mixing.mix_sources(table(ship(spark), sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication of all `documents`; the largest id of equal texts stays."""
    return digest_index.exact_dedup(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all `documents`, learned from those that aren't held out."""
    return lang_id.language_id(table(ship(spark), sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """The text of a public tokenizer's file, read on the driver."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all `documents` by segment-tree BPE, and their decoding, as digests."""
    return bpe.encode_decode(table(ship(spark), sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` stored as FLAC media, read back, verified and described."""
    return flac.describe(flac.store(table(ship(spark), sf_dir, "documents")))


def op7_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` as bit-packed token ids in doc_id order, described from the files as read back."""
    return token_pack.pack_documents(table(ship(spark), sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all `documents` at similarity 0.85 of 5-word shingles."""
    return near_dup.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all `documents`, learned from the labels that aren't held out."""
    docs = table(ship(spark), sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.learn(docs, table(spark, sf_dir, "labels")))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all `pages`."""
    return main_text.extract(table(ship(spark), sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all `documents`, of which one in 199 loses a letter first."""
    return spelling.variants(spelling.count_words(table(ship(spark), sf_dir, "documents"), change=spelling.planted_typo))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of words of all `documents`, of which every tenth is given a repeated tail first."""
    docs = table(ship(spark), sf_dir, "documents").select("doc_id", word_runs.repeated_tail(F.col("text"), F.col("doc_id")).alias("text"))
    return word_runs.digests(word_runs.periodic_runs(docs))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules on all `documents`."""
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumn("failed", F.array_join("failed", ","))


def _quality_rules_sql() -> str:
    """The twin of `op13_quality_rules`, written out from the same table of thresholds and lists."""
    ratio = {
        "n_words": "n_words", "repeat_words_percent": "CASE WHEN n_words > 0 THEN 100 * n_repeat_words / n_words ELSE 0 END",
        "mean_word_length": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END", "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END",
        "stop_word_share": f"CASE WHEN n_words >= {quality_rules.STOP_WORDS_FROM} THEN n_stop_words / n_words ELSE 1 END",
    } | {f"{x}_line_share": f"CASE WHEN n_lines > 0 THEN n_{x}_lines / n_lines ELSE 0 END" for x in ("dup", "bullet", "ellipsis")}
    broken = {n: " OR ".join([f"({ratio[n]}) < {low}"] * (low is not None) + [f"({ratio[n]}) > {high}"] * (high is not None)) for n, low, high in quality_rules.THRESHOLDS}
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    named = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in broken.items())
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM win, range(5) AS r(k) WHERE n > 1 GROUP BY 1),
        s AS (SELECT *, list_filter(CASE WHEN text IS NULL THEN [] ELSE string_split(t, chr(10)) END, lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
        c AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^{quality_rules.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, len(lines)::BIGINT AS n_lines,
                len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t-\r]*[-*•·‣▪]')))::BIGINT AS n_bullet_lines,
                len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t-\r]*$')))::BIGINT AS n_ellipsis_lines
              FROM s LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, list_filter([{named}], lambda x: x IS NOT NULL) AS failed FROM c)
        SELECT * EXCLUDE (failed), {" OR ".join(broken[n] for n in quality_rules.BASE)} AS base_failed, len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed FROM f"""


QUERIES = {
    "op1_revisits": op1_revisits,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_flac": op6_flac,
    "op7_token_pack": op7_token_pack,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_main_text": op10_main_text,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_word_runs": op12_word_runs,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL = {
    "op1_revisits": r"""
        WITH p AS (
            SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size, 1700000000 + (page_id % 97) * 3600 AS hour,
                   CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 97) END AS lm FROM pages),
        r AS (
            SELECT page_id * 2 AS record_id, url AS uri, hour AS ts, true AS is_full, '"' || digest || '"' AS etag, lm, digest, size FROM p WHERE page_id % 11 <> 0
            UNION ALL
            SELECT page_id * 2 + 1, regexp_replace(CASE WHEN page_id % 5 = 0 THEN replace(url, '/en/', '/x/../%65n/./') ELSE url END, '^https?://', 'HTTPS://WWW.') || '#again',
                   hour + 60 * (1 + page_id % 5), false, CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 7 > 2 THEN 'W/"' || digest || '"' END, lm,
                   CASE WHEN page_id % 13 = 0 THEN digest WHEN page_id % 17 = 0 THEN 'another' END, 0 FROM p),
        s0 AS (SELECT *, string_split(regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '%') AS parts FROM r),
        s AS (SELECT *, parts[1] || array_to_string(list_transform(parts[2:], lambda x: CASE
                WHEN NOT regexp_matches(x, '^[0-9A-Fa-f]{2}') THEN '%' || x
                WHEN regexp_matches(upper(x[1:2]), '^(2D|2E|3[0-9]|4[1-9A-F]|5[0-9A]|5F|6[1-9A-F]|7[0-9A]|7E)$') THEN chr(('0x' || x[1:2])::INTEGER) || x[3:]
                ELSE '%' || upper(x[1:2]) || x[3:] END), '') AS rest FROM s0),
        k AS (
            SELECT *, nullif(
                regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\d*\.', '')
                || regexp_replace(array_to_string(list_reduce(list_transform(string_split(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/'), lambda x: [x]),
                       lambda done, x: CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN done[:greatest(1, len(done) - 1)] ELSE list_concat(done, x) END), '/'), '/+$', '')
                || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END, '') AS url_key
            FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|sid|sessionid|jsessionid|phpsessid)(=|$)'))) AS q FROM s)),
        f AS (SELECT * FROM k WHERE is_full),
        j AS (
            SELECT k.*, b.record_id AS b_id, b.etag AS b_etag, b.lm AS b_lm, b.digest AS b_digest, b.size AS b_size, b.ts AS b_ts,
                   row_number() OVER (PARTITION BY k.record_id ORDER BY b.ts DESC, b.record_id DESC) AS n
            FROM k LEFT JOIN f AS b ON NOT k.is_full AND b.url_key = k.url_key AND b.ts < k.ts),
        o AS (
            SELECT *, CASE WHEN is_full THEN 'full' WHEN b_id IS NULL THEN 'no_base' WHEN digest <> b_digest THEN 'mismatch'
                WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = b_etag THEN 'resolved' ELSE 'mismatch' END
                WHEN lm IS NOT NULL AND b_lm IS NOT NULL THEN CASE WHEN lm = b_lm THEN 'resolved' ELSE 'mismatch' END
                WHEN digest IS NOT NULL THEN 'resolved' ELSE 'unchecked' END AS outcome FROM j WHERE n = 1)
        SELECT record_id, url_key, ts, outcome,
               CASE WHEN is_full THEN record_id WHEN outcome IN ('resolved', 'unchecked') THEN b_id END AS base_id,
               CASE WHEN is_full THEN digest WHEN outcome IN ('resolved', 'unchecked') THEN b_digest END AS digest,
               CASE WHEN is_full THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || etag
                    WHEN outcome IN ('resolved', 'unchecked') THEN 'cache-control: max-age=90' || chr(10) || 'content-length: ' || b_size || chr(10) || 'content-type: text/html' || chr(10)
                         || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(etag, b_etag)
                    ELSE 'cache-control: max-age=90' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || ts || CASE WHEN etag IS NULL THEN '' ELSE chr(10) || 'etag: ' || etag END END AS headers
        FROM o""",
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op13_quality_rules": _quality_rules_sql(),
}
