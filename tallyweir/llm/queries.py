"""The registered queries of the operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm import classifier, decontaminate, embeddings, jaccard, licenses, manifest, pages, periodic, pieces, pii, quality, repeats, token_files
from tallyweir.llm.text import words

Run = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return rows.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS win, len(w[i:i + 12]) AS n
  FROM b, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win
), places AS (
  SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(i) WHERE len(w) >= n
), occ AS (
  SELECT doc_id, item_id, i, n FROM places JOIN win USING (win, n)
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM occ), unnest(generate_series(0, n - 1)) AS u(k) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    rows = licenses.scan(_read(spark, folder, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "n_windows", F.array_join("licenses", ",").alias("licenses"))


_TEMPLATE_ROWS = ", ".join("('{}', '{}', '{}')".format(name, text.replace("'", "''"), required) for name, text, required in licenses.TEMPLATES)
OP2_SQL = r"""
WITH t AS (
  SELECT license, required, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (VALUES TEMPLATE_ROWS) AS v(license, text, required)
), ts AS (
  SELECT DISTINCT license, required, list_aggregate(w, 'string_agg', ' ') AS part, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS s
  FROM t, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS u(i)
), n AS (SELECT license, part, required, count(*) AS n FROM ts GROUP BY ALL
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), ds AS (
  SELECT doc_id, i - 1 AS pos, list_aggregate(w[i:i + 2], 'string_agg', ' ') AS s
  FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS u(i) WHERE len(w) > 0
), inside AS (
  SELECT doc_id, s, b * 24 AS win FROM ds, unnest([pos // 24 - 1, pos // 24]) AS u(b) WHERE b >= 0 AND pos + 3 <= b * 24 + 48
), hit AS (
  SELECT doc_id, win, license, part, required, count(DISTINCT s) AS shared FROM inside JOIN ts USING (s) GROUP BY ALL
), ok AS (
  SELECT hit.* FROM hit JOIN n USING (license, part, required) JOIN d USING (doc_id) WHERE 100 * shared >= 75 * n
    AND (required = '' OR list_bool_and(list_transform(string_split(required, '|'), lambda p: contains(concat(' ', array_to_string(w[win + 1:win + 48], ' '), ' '), concat(' ', p, ' ')))))
)
SELECT d.doc_id, CAST(count(DISTINCT CASE WHEN win IS NOT NULL THEN concat(win, ':', part) END) AS BIGINT) AS n_windows, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
FROM d LEFT JOIN ok USING (doc_id) GROUP BY d.doc_id
""".replace("TEMPLATE_ROWS", _TEMPLATE_ROWS)


def op3_quality_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.ledger(_read(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes("v3").alias("kept"), "n_lines", "n_exclaimed",
        "n_bars", "n_bar_words", "n_latin_runs", "latin_chars", "failed_bits",
    )


def quality_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """For every policy and rule: documents that fail the rule, and that nothing but the rule keeps out."""
    return quality.ablations(quality.ledger(_read(spark, folder, "documents")))


OP3_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', chr(31)) AS win
  FROM texts, unnest(generate_series(1, greatest(len(w) - 4, 0))) AS u(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), repeats AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n
  FROM twice, unnest(generate_series(0, 4)) AS u(k) GROUP BY doc_id
), measured AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(length(list_aggregate(w, 'string_agg', '')), 0) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST((length(body) - length(replace(list_aggregate(list_concat([''], w), 'string_agg', ''), '!!', ''))
               - (length(body) - coalesce(length(list_aggregate(w, 'string_agg', '')), 0))) // 2 AS BIGINT) AS n_exclaimed
  FROM texts t LEFT JOIN repeats r USING (doc_id)
), sum_bars AS (
  SELECT doc_id, CAST(coalesce(list_sum(list_transform(l, lambda x: CASE
      WHEN regexp_matches(x, '^[ \t\n\x0B\f\r]*\|[^\n\r\x{85}\x{2028}\x{2029}]*[^| \t\n\x0B\f\r][^\n\r\x{85}\x{2028}\x{2029}]*\|[ \t\n\x0B\f\r]*$')
      THEN len(list_filter(regexp_extract_all(x, '\|+'), lambda y: y = '|'))
      ELSE len(list_filter(string_split_regex(x, '[ \t\n\x0B\f\r]+'), lambda y: y = '|')) END)), 0) AS BIGINT) AS n_bars,
    CAST(len(list_filter(w, lambda y: y = '|')) AS BIGINT) AS n_bar_words,
    regexp_extract_all(body, '[\x21-\x7E\x{A1}-\x{24F}\x{1E00}-\x{1EFF}]+') AS latin
  FROM texts
), bits AS (
  SELECT m.*, n_bars, n_bar_words, CAST(len(latin) AS BIGINT) AS n_latin_runs,
       CAST(coalesce(list_sum(list_transform(latin, lambda x: length(x))), 0) AS BIGINT) AS latin_chars
  FROM measured m JOIN sum_bars USING (doc_id)
), judged AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_exclaimed > n_words THEN 8 ELSE 0 END)
       + (CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)
       + (CASE WHEN 2 * n_dup_lines > n_lines AND n_lines >= 4 THEN 32 ELSE 0 END)
       + (CASE WHEN 2 * (n_symbols - n_bars) > n_words - n_bar_words THEN 64 ELSE 0 END)
       + (CASE WHEN latin_chars > 40 * n_latin_runs AND 2 * latin_chars > word_chars THEN 128 ELSE 0 END) AS BIGINT) AS failed_bits
  FROM bits
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       (failed_bits & 203) = 0 AS kept, n_lines, n_exclaimed, n_bars, n_bar_words, n_latin_runs, latin_chars, failed_bits
FROM judged
"""
ABLATIONS_SQL = OP3_SQL[: OP3_SQL.rindex("SELECT doc_id, n_words")] + """
SELECT policy, rule, CAST(count(*) FILTER (WHERE failed_bits & (1 << bit) <> 0) AS BIGINT) AS n_failed,
       CAST(count(*) FILTER (WHERE failed_bits & mask = 1 << bit) AS BIGINT) AS n_failed_alone
FROM judged, (VALUES ('base', 3), ('v1', 31), ('v2', 63), ('v3', 203)) AS p(policy, mask),
     (VALUES (0, 'few_words'), (1, 'repeated_words'), (2, 'symbols'), (3, 'exclamation'), (4, 'long_words'), (5, 'repeated_lines'),
             (6, 'symbols_off_tables'), (7, 'long_latin_words')) AS r(bit, rule)
WHERE mask & (1 << bit) <> 0 GROUP BY policy, rule
"""


def op4_pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.spans(_read(spark, folder, "documents"))
    base = tuple(k.name for k in pii.BASE_KINDS)

    def n(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[n(kind) for kind in base],
        F.sha2(pii.listed(F.filter("spans", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda x: F.round(x["score"], 3).cast("string")), ",").alias("scores"),
    )


def op5_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeats.repeat_digests(_read(spark, folder, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256"
    )


def op6_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip_digests(_read(spark, folder, "documents").select("doc_id", "text"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = token_files.shared_folder(spark, "token-files")
    index = token_files.write(_read(spark, folder, "documents"), target, end_id=1)
    return token_files.checksums(spark, target, index)


def op8_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(_read(spark, folder, "pages").select("page_id", "url", "html"))


def op9_gram_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op10_quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents").select("doc_id", "text"), _read(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = classifier.fit(docs, labels.where(~held_out))
    return (
        classifier.score(docs, model)
        .select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^ 	-
]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS gram
  FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 75 * (na.n + nb.n - o)
), reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS m FROM r GROUP BY a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON a = d.doc_id
"""

def repeated_from(doc_id: Column, text: Column) -> Column:
    """The contract's rewriting: in a tenth of the documents every word from a place on repeats the first few words there."""
    h = F.crc32(doc_id.cast("string"))
    items, g = words(text), F.floor(h / 10)

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    changed = F.get(F.transform(F.filter(F.array(items), lambda w: F.size(w) > 0), rewritten), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", repeated_from(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.periodic_runs(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (
        found.withColumn("longest", longest).withColumn("length", -F.col("longest.less"))
        .select(
            "row.doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "length", "longest.period",
            F.floor(1000 * F.col("length") / F.col("longest.period")).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(tampered, manifest.leaf_digest(*others, F.replace("text", F.lit("\n"), F.lit(""))))
    rows, root = manifest.manifest(
        docs, [*others, F.col("text")], F.col("source"), F.col("doc_id"), [F.col("doc_id"), changed.alias("changed")]
    )
    folded = manifest.fold(F.coalesce("row.changed", "leaf"), F.col("path"))
    return rows.select(
        "row.doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# The tree of every source and that of the subroots, level by level; a leaf walks up with its own and its tampered digest.
# crc32 is written as a fold over the bits of the decimal digits.
OP12_SQL = r"""
WITH RECURSIVE enc AS (
  SELECT doc_id, source, text, concat(
           coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
           coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars), '-')) AS head,
         replace(text, chr(10), '') AS flat
  FROM documents
), crc AS (
  SELECT *, xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
             lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) AS h
  FROM enc
), leaves AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
         CASE WHEN h % 2 = 0 THEN sha256(concat(head, coalesce(concat(strlen(flat), ':', flat), '-')))
              ELSE sha256(concat(head, coalesce(concat(strlen(text), ':', text), '-'))) END AS seen
  FROM crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM leaves
), low(lvl, source, idx, n, d) AS (
  SELECT 0, source, idx, n, leaf FROM placed
  UNION ALL
  SELECT lvl + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM low WHERE n > 1
  GROUP BY lvl, source, idx // 3, n
), subs AS (
  SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), up(lvl, idx, n, d) AS (
  SELECT 0, idx, n, subroot FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lvl, idx // 3, n
), low_runs AS (
  SELECT lvl, source, idx // 3 AS parent, list(d ORDER BY idx) AS ds FROM low WHERE n > 1 GROUP BY ALL
), up_runs AS (
  SELECT lvl, idx // 3 AS parent, list(d ORDER BY idx) AS ds FROM up WHERE n > 1 GROUP BY ALL
), walk(lvl, doc_id, source, leaf, place, idx, n, seen, proof) AS (
  SELECT 0, doc_id, source, leaf, idx, idx, n, seen, '' FROM placed
  UNION ALL
  SELECT w.lvl + 1, w.doc_id, w.source, w.leaf, w.place, w.idx // 3, (w.n + 2) // 3,
         sha256(array_to_string(list_concat(r.ds[1:w.idx % 3], [w.seen], r.ds[w.idx % 3 + 2:]), '')),
         concat(w.proof, array_to_string(list_concat(r.ds[1:w.idx % 3], r.ds[w.idx % 3 + 2:]), ''))
  FROM walk w JOIN low_runs r ON w.lvl = r.lvl AND w.source IS NOT DISTINCT FROM r.source AND w.idx // 3 = r.parent WHERE w.n > 1
), stroll(lvl, doc_id, place, source, leaf, subroot, idx, n, seen, proof) AS (
  SELECT 0, w.doc_id, w.place, w.source, w.leaf, s.subroot, s.idx, s.n, w.seen, w.proof
  FROM walk w JOIN subs s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
  UNION ALL
  SELECT w.lvl + 1, w.doc_id, w.place, w.source, w.leaf, w.subroot, w.idx // 3, (w.n + 2) // 3,
         sha256(array_to_string(list_concat(r.ds[1:w.idx % 3], [w.seen], r.ds[w.idx % 3 + 2:]), '')),
         concat(w.proof, array_to_string(list_concat(r.ds[1:w.idx % 3], r.ds[w.idx % 3 + 2:]), ''))
  FROM stroll w JOIN up_runs r ON w.lvl = r.lvl AND w.idx // 3 = r.parent WHERE w.n > 1
)
SELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = root.d AS verified
FROM stroll, (SELECT d FROM up WHERE n = 1) AS root WHERE n = 1
"""


def op13_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    found = embeddings.near_vectors(_read(spark, folder, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


OP13_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS m FROM reach GROUP BY a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

QUERIES: dict[str, Run] = {
    "op1_benchmark_overlap": op1_benchmark_overlap,
    "op2_license_scan": op2_license_scan,
    "op3_quality_ledger": op3_quality_ledger,
    "quality_ablations": quality_ablations,
    "op4_pii_spans": op4_pii_spans,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_piece_round_trip": op6_piece_round_trip,
    "op7_token_files": op7_token_files,
    "op8_page_text": op8_page_text,
    "op9_gram_components": op9_gram_components,
    "op10_quality_score": op10_quality_score,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_near_vectors": op13_near_vectors,
}
ORACLE_SQL: dict[str, str] = {
    "op1_benchmark_overlap": OP1_SQL,
    "op2_license_scan": OP2_SQL,
    "op3_quality_ledger": OP3_SQL,
    "quality_ablations": ABLATIONS_SQL,
    "op9_gram_components": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_near_vectors": OP13_SQL,
}
