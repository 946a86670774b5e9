"""One query per operator, over its whole table, with the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import (
    benchmark_search,
    compression,
    language,
    mixing,
    packing,
    periodic,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    substrings,
    suffix_tree,
    vectors,
)
from tabkit.sources import read_table

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def query(run: Runner) -> Runner:
    QUERIES[run.__name__] = run
    return run


@query
def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of 0.98 within a label."""
    found = vectors.near_vectors(read_table(spark, folder, "embeddings"), cosine=0.98)
    return found.withColumnRenamed("component", "component_id")


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 50 words."""
    return substrings.remove_repeats(read_table(spark, folder, "documents"), size=50, texts=False)


@query
def op3_compression(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from labelled rows of three quarters; 1 from a score of 0.7 on."""
    docs, labels = (read_table(spark, folder, t) for t in ("documents", "labels"))
    held = compression.held_out("doc_id", 4, 2)
    model = compression.fit_compression(docs, labels, learn=~held)
    scored = compression.compression_scores(docs, model)
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2048 tokens; a document ends with id 1."""
    docs = read_table(spark, folder, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(docs, path, size=2048, end_id=1, payload=F.crc32("ids"))
    return packed.withColumnRenamed("ids", "ids_crc32")


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Weights 3, 1, 2 in turn; 150 % of all words; twice a source at most."""
    docs = read_table(spark, folder, "documents")
    return mixing.mix_sources(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, seed=42)


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from two thirds."""
    docs = read_table(spark, folder, "documents")
    held = compression.held_out("doc_id", 3, 1)
    found = language.detect_languages(docs, language.fit_languages(docs, learn=~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All rules of the cascade."""
    return quality.quality_cascade(read_table(spark, folder, "documents"))


@query
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Shingles of three words, radius three."""
    found = simhash.simhash_groups(read_table(spark, folder, "documents"), radius=3, shingle=3, seed=42)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@query
def op9_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Learned from four fifths."""
    docs = read_table(spark, folder, "documents")
    return suffix_tree.suffix_tree_scores(docs, compression.held_out("doc_id", 5, 1))


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the spans that were found."""
    found = secret_scan.find_secrets(read_table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    base = F.filter("spans", lambda s: s["kind"] != "named")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("named").alias("n_named"),
    )


def planted_cycles(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: in a tenth of the texts one stretch of words is repeated to the end.

    With h the crc32 of the id's text, g = h div 10 and n words, a text with h
    divisible by 10 repeats the ``1 + (n - a) div (3 + g % 8)`` words from word
    ``a = g % n`` on.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("chosen"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    counted = chosen.withColumn("words", words).withColumn("n", F.size("words"))
    placed = counted.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    cycled = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    repeated = F.expr(
        "array_join(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p as int))),"
        " slice(words, a + 1, (n - a) % p)), ' ')"
    )
    return cycled.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of four periods and six words, in texts of which some are made to repeat."""
    found = periodic.periodic_runs(planted_cycles(read_table(spark, folder, "documents")), least=6, times=4)
    best = F.reduce(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.try_element_at("runs", F.lit(1)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of each item."""
    docs, items = (read_table(spark, folder, t) for t in ("documents", "benchmark"))
    return ranked_search.ranked_documents(docs, items, top=50)


@query
def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of ten words of any item."""
    docs, items = (read_table(spark, folder, t) for t in ("documents", "benchmark"))
    found = benchmark_search.benchmark_hits(docs, items, size=10)
    hit = F.reduce("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


SQL["op1_embedding_dedup"] = """WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
  reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
  SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links,
    (SELECT min(reach.b) FROM reach WHERE reach.a = e.vec_id) AS component_id,
    (SELECT min(reach.b) FROM reach WHERE reach.a = e.vec_id) = e.vec_id AS kept FROM embeddings AS e"""

SQL["op2_substring_dedup"] = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM w WHERE len(words) >= 50),
  k AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 49), ' ') AS run FROM p),
  f AS (SELECT run, min(doc_id) AS first FROM k GROUP BY run),
  gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM k JOIN f USING (run) WHERE first < doc_id),
  g AS (SELECT doc_id, count(*) AS n, list(pos) AS gone FROM gone GROUP BY doc_id),
  o AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
  s AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM o ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
  SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM w LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)"""

SQL["op5_mixing"] = r"""WITH w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substring(md5('42:' || doc_id || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size,
    [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM w GROUP BY source),
  t AS (SELECT *, source_size * 2.0::DOUBLE AS roof, source_size * 2.0::DOUBLE / weight AS level,
    (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total FROM s),
  f AS (SELECT *, coalesce(sum(roof) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
    sum(weight) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM t),
  r AS (SELECT max((total - filled) / open) AS rate FROM f WHERE level >= (total - filled) / open),
  g AS (SELECT source, source_size, least(roof, (SELECT rate FROM r) * weight)::DOUBLE AS target FROM f),
  e AS (SELECT doc_id, w.source, size, source_size, target, u,
    least(2.0::DOUBLE, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END) AS expected
    FROM w JOIN g ON w.source IS NOT DISTINCT FROM g.source),
  p AS (SELECT *, floor(expected)::BIGINT AS sure, expected - floor(expected) AS p FROM e),
  v AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (u / (1 - u) + p / (1 - p)) END AS rank FROM p),
  c AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS gap,
    coalesce(sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM v),
  d AS (SELECT *, sure + CASE WHEN rank IS NOT NULL AND done + size / 2 <= gap THEN 1 ELSE 0 END AS copies FROM c)
  SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM d"""

SQL["op7_quality_rules"] = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  p AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM w WHERE len(words) >= 8),
  k AS (SELECT doc_id, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') AS run FROM p),
  m AS (SELECT doc_id, run FROM k GROUP BY doc_id, run HAVING count(*) > 1),
  r AS (SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS x FROM k JOIN m USING (doc_id, run)) GROUP BY doc_id),
  l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
  d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM l GROUP BY doc_id),
  c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_excl, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, len(list_distinct(words)) AS kinds, coalesce(n_lines,0) AS n_lines
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN d USING (doc_id)),
  b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_excl <= n_words
    AND word_chars BETWEEN 2 * n_words AND 14 * n_words AND 10 * n_dup_lines <= 3 * greatest(10, n_lines)
    AND NOT (2 * n_upper > n_letters AND n_letters > 0) AND 4 * n_letters >= word_chars
    AND 20 * kinds >= n_words AS kept FROM b"""

SQL["op11_periodic_runs"] = r"""WITH c AS (SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))),
      4294967295::BIGINT) AS h FROM documents),
  e AS (SELECT *, len(words) AS n, h // 10 AS g FROM c),
  f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
  z AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
  w AS (SELECT d, doc_id, n, CASE WHEN a IS NULL THEN words
    ELSE list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS words FROM z),
  k AS (SELECT d, n, pos, array_to_string(list_slice(words, pos + 1, pos + 5), ' ') AS run
    FROM (SELECT d, n, words, unnest(range(0, n - 4)) AS pos FROM w WHERE n >= 6)),
  l AS (SELECT x.d, x.pos, y.pos - x.pos AS q FROM k AS x JOIN k AS y ON x.d = y.d AND x.run = y.run AND y.pos > x.pos AND 4 * (y.pos - x.pos) <= x.n),
  s AS (SELECT d, q, min(pos) AS start, count(*) + 4 + q AS length
    FROM (SELECT *, pos - row_number() OVER (PARTITION BY d, q ORDER BY pos) AS island FROM l) GROUP BY d, q, island),
  t AS (SELECT * FROM s WHERE length >= greatest(6, 4 * q)),
  r AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t AS o WHERE o.d = t.d AND o.q < t.q
    AND o.start <= t.start AND o.start + o.length >= t.start + t.length)),
  b AS (SELECT d, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, q := q), place) AS best,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed
    FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY length::DOUBLE / q DESC, start, q) AS place FROM r) GROUP BY d),
  gone AS (SELECT DISTINCT d, unnest(range(start + q, start + length)) AS pos FROM r),
  u AS (SELECT d, unnest(words) AS word, unnest(range(0, n)) AS pos FROM w),
  v AS (SELECT d, string_agg(word, ' ' ORDER BY pos) AS kept FROM u ANTI JOIN gone USING (d, pos) GROUP BY d)
  SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.q::BIGINT AS period,
    (1000 * best.length // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM w LEFT JOIN b USING (d) LEFT JOIN v USING (d)"""

SQL["op12_ranked_search"] = r"""WITH w AS (SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
  i AS (SELECT r, item_id, unnest(list_distinct(words)) AS term FROM (SELECT row_number() OVER () AS r, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)),
  a AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM w WHERE len(words) > 0),
  t AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(words) AS term FROM w) GROUP BY d, term),
  f AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM a) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t GROUP BY term),
  m AS (SELECT d, doc_id, 50 + (50 * len(words)::BIGINT * (SELECT n_docs FROM a)) // (SELECT n_terms FROM a) AS scale FROM w WHERE len(words) > 0),
  s AS (SELECT r, item_id, d, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * scale)))::BIGINT AS score
    FROM i JOIN t USING (term) JOIN f USING (term) JOIN m USING (d) GROUP BY r, item_id, d, doc_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id NULLS LAST, d)::INTEGER AS rank FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50"""

SQL["op13_decontamination"] = r"""WITH w AS (SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  i AS (SELECT item_id::VARCHAR AS item, words, least(10, len(words)) AS n FROM (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark) WHERE len(words) > 0),
  g AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS run
    FROM (SELECT item, n, words, unnest(range(1, len(words) - n + 2)) AS pos FROM i)),
  p AS (SELECT d, n, pos, array_to_string(list_slice(words, pos, pos + n - 1), ' ') AS run
    FROM (SELECT d, n, words, unnest(range(1, greatest(1, len(words) - n + 2))) AS pos FROM w, (SELECT DISTINCT n FROM g))),
  o AS (SELECT d, pos, n, item FROM p JOIN g USING (n, run)),
  h AS (SELECT d, count(DISTINCT x) AS n_hit FROM (SELECT d, unnest(range(pos, pos + n)) AS x FROM o) GROUP BY d),
  l AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item FROM o WHERE item IS NOT NULL) GROUP BY d)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM w LEFT JOIN h USING (d) LEFT JOIN l USING (d)"""
