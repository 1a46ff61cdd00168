"""Text preparation, classification, chunking and web extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import intent, rules, text
from lodestone.operators import chunking
from lodestone.plans.registry import register, sql_list, sql_tokens, sql_unescape, sql_words
from lodestone.session import table
from lodestone.sources import web

LETTERS = "[^\\p{L}\\p{N}]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)")
def normalize_tokens_count(spark, sf_dir):
    t = _docs(spark, sf_dir).select("doc_id", text.tokens_for_match(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@register("SELECT doc_id, left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 400) AS signature FROM documents")
def dedup_signature(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.dedup_signature(F.col("text")).alias("signature"))


@register(
    """
SELECT min(doc_id) AS doc_id, count(*) AS n_same
FROM (SELECT doc_id, left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 400) AS s FROM documents) GROUP BY s
"""
)
def first_per_signature(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", text.dedup_signature(F.col("text")).alias("s"))
    return rows.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_same")).drop("s")


@register(
    """
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, list_filter(list_transform(string_split_regex(text, '\\n{2,}'),
           lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: len(p) > 80) AS ps FROM documents),
n AS (SELECT *, CASE WHEN len(ps) >= 20 THEN len(ps) WHEN len(t) = 0 THEN 0 WHEN len(t) <= 1200 THEN 1 ELSE ceil((len(t) - 200) / 1000.0)::BIGINT END AS n FROM d),
x AS (SELECT doc_id, t, ps, unnest(range(n)) AS i FROM n)
SELECT doc_id, i::INTEGER AS idx, CASE WHEN len(ps) >= 20 THEN ps[i + 1] ELSE substring(t, 1000 * i + 1, 1200) END AS passage FROM x
"""
)
def passages_sliding(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.passages(F.col("text"))).alias("idx", "passage"))


_ABBREVIATED = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.ABBREVIATIONS.items()) + " ELSE w END"


@register(f"SELECT doc_id, array_to_string(list_transform({sql_words('text')}, lambda w: {_ABBREVIATED}), ' ') AS expanded FROM documents")
def abbreviation_expand(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.expand_abbreviations(F.col("text"), rules.ABBREVIATIONS).alias("expanded"))


@register(
    f"""SELECT doc_id, array_to_string(list_transform({sql_words('text')}, lambda w: CASE WHEN len(w) > 15 AND regexp_full_match(w, '[A-Za-z0-9]+')
THEN array_to_string(regexp_extract_all(w, '[A-Z][a-z]*|[a-z]+|[0-9]+'), ' ') ELSE w END), ' ') AS parts FROM documents"""
)
def split_connected_words(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.split_connected(F.col("text")).alias("parts"))


@register(
    f"""SELECT doc_id, array_to_string(list_filter({sql_words('text')}, lambda w: regexp_full_match(w, '[a-zA-Z0-9.\\-]+')
AND len(list_distinct(string_split(lower(w), ''))) > 2), ' ') AS kept FROM documents"""
)
def nonsense_filter(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.drop_nonsense(F.col("text")).alias("kept"))


@register(
    """
WITH r AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)+\\b'), regexp_extract_all(text, '\\b[Ll]evel\\s\\d+\\b')),
           list_concat(regexp_extract_all(text, '\\b[Pp]art\\s\\d+\\b'), regexp_extract_all(text, '§\\s*\\d+(?:\\.\\d+)*'))) AS r FROM documents)
SELECT doc_id, CASE WHEN len(r) > 0 THEN array_to_string(r, ';') ELSE 'No References Found' END AS refs FROM r
"""
)
def section_references(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.section_references(F.col("text")), ";").alias("refs"))


# Of overlapping matches the earlier pattern's stays: a code of three letters takes those of a flight number after a blank, and one organisation of three.
_KEPT_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g'), '{p}')) AS e FROM documents" for label, p in rules.ENTITY_PATTERNS)


@register(f"SELECT doc_id, label, count(*) AS n FROM ({_KEPT_ENTITIES}) WHERE NOT (label = 'FLIGHT_NUMBER' AND regexp_matches(e, '^[A-Z]{{3}}\\s')) AND NOT (label = 'AVIATION_ORG' AND len(e) = 3) GROUP BY doc_id, label")
def rule_entities(spark, sf_dir):
    from lodestone.seams import annotate

    rows = _docs(spark, sf_dir).select("doc_id", F.explode(annotate(F.col("text"))).alias("e"))
    return rows.groupBy("doc_id", "e.label").agg(F.count("*").alias("n"))


_ENTITY_SQL = " UNION ALL ".join(f"SELECT '{label}' AS label, len(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g'), '{p}')) AS n FROM documents" for label, p in rules.ENTITY_PATTERNS)


@register(f"SELECT label, sum(n)::BIGINT AS n FROM ({_ENTITY_SQL}) GROUP BY label")
def entity_pattern_counts(spark, sf_dir):
    """Matches of each entity pattern on its own, before overlaps are resolved."""
    docs = _docs(spark, sf_dir)
    counts = [F.sum(F.regexp_count("text", F.lit(p))).cast("long").alias(label) for label, p in rules.ENTITY_PATTERNS]
    one = docs.agg(*counts)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in rules.ENTITY_PATTERNS]), F.array(*[F.col(k) for k, _ in rules.ENTITY_PATTERNS]))).alias("label", "n"))


@register(
    f"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, round(CASE WHEN len(t) > 0 THEN 0.7::DOUBLE * least(len(t) / 2000.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * (len(regexp_replace(t, '{LETTERS}', '', 'g')) / len(t)::DOUBLE) ELSE 0 END, 6) AS score,
       CASE WHEN len(t) > 0 THEN 0.7::DOUBLE * least(len(t) / 2000.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * (len(regexp_replace(t, '{LETTERS}', '', 'g')) / len(t)::DOUBLE) ELSE 0 END < 0.2 AS needs_review FROM t
"""
)
def text_quality_flag(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", text.quality_score(F.col("text")).alias("s"))
    return rows.select("doc_id", F.round("s", 6).alias("score"), text.needs_review(F.lit("pdf"), F.col("s")).alias("needs_review"))


_CATEGORY_ROWS = ", ".join(f"({k}, '{c}', {sql_list(p)})" for k, (c, p) in enumerate(rules.CATEGORIES.items()))


@register(
    f"""
WITH c(ord, category, phrases) AS (VALUES {_CATEGORY_ROWS}),
s AS (SELECT doc_id, ord, category, len(list_filter(phrases, lambda p: contains(lower(text), p))) AS n FROM documents, c)
SELECT doc_id, category FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS r FROM s) WHERE r = 1
"""
)
def classify_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", intent.category(F.col("text")).alias("category"))


@register(
    f"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(
  {sql_unescape("regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]+>', chr(10), 'g')")},
  '\\n|  '), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages
"""
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.html_text(F.col("html")).alias("text"))


@register(
    """
WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1) AS hs FROM pages),
x AS (SELECT page_id, base, unnest(hs) AS href, unnest(range(len(hs))) AS i FROM h),
a AS (SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE concat(base, href) END AS absolute FROM x)
SELECT page_id, i::INTEGER AS link_no, href, absolute, regexp_extract(absolute, '[^/]+$', 0) AS name FROM a
"""
)
def page_links(spark, sf_dir):
    return web.links(table(spark, sf_dir, "pages"), "page_id")


@register(
    f"""
SELECT page_id, coalesce(nullif(trim({sql_unescape("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)")}), ''), 'Unknown') AS title,
       trim({sql_unescape("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")}) AS head, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages
"""
)
def metadata_extract(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", web.first_element(html, "h1", "Unknown").alias("title"), web.first_element(html, "title").alias("head"), F.parse_url("url", F.lit("HOST")).alias("host"))


@register(
    f"""
WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(ceil(len(w) / 500.0)::BIGINT)) AS i FROM w)
SELECT concat(doc_id, '_', i) AS chunk_id, doc_id, i::INTEGER AS chunk_no, array_to_string(w[500 * i + 1 : 500 * i + 500], ' ') AS text, len(w[500 * i + 1 : 500 * i + 500]) AS tokens FROM x
"""
)
def chunk_words_fixed(spark, sf_dir):
    return chunking.chunk_words_fixed(_docs(spark, sf_dir), "doc_id", "text", 500)


@register(
    f"""
WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
f AS (SELECT doc_id, w, list_reduce(list_transform(w, lambda x: {{'c': ceil(len(x) / 4.0)::BIGINT, 's': 0::BIGINT, 'n': 0::BIGINT, 'b': [0::BIGINT]}}),
      lambda acc, x: {{'c': x.c, 's': CASE WHEN acc.s + x.c > 500 THEN x.c ELSE acc.s + x.c END, 'n': acc.n + 1,
                       'b': CASE WHEN acc.s + x.c > 500 THEN list_append(acc.b, acc.n) ELSE acc.b END}}, {{'c': 0::BIGINT, 's': 0::BIGINT, 'n': 0::BIGINT, 'b': [0::BIGINT]}}).b AS b FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, w, list_append(b, len(w)) AS b, unnest(range(len(b))) AS i FROM f),
p AS (SELECT doc_id, i, w[b[i + 1] + 1 : b[i + 2]] AS p FROM x)
SELECT concat(doc_id, '_', i) AS chunk_id, doc_id, i::INTEGER AS chunk_no, array_to_string(p, ' ') AS text, coalesce(list_sum(list_transform(p, lambda t: ceil(len(t) / 4.0)::BIGINT)), 0)::BIGINT AS tokens FROM p
"""
)
def chunk_words_greedy(spark, sf_dir):
    return chunking.chunk_words(_docs(spark, sf_dir), "doc_id", "text", 500)


@register(
    f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', concat('\\1', chr(31)), 'g'), chr(31)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
f AS (SELECT doc_id, s, list_reduce(list_transform(s, lambda x: {{'c': len({sql_words('x')})::BIGINT, 's': 0::BIGINT, 'n': 0::BIGINT, 'b': [0::BIGINT]}}),
      lambda acc, x: {{'c': x.c, 's': CASE WHEN acc.s + x.c > 500 AND acc.s > 0 THEN x.c + 50 ELSE acc.s + x.c END, 'n': acc.n + 1,
                       'b': CASE WHEN acc.s + x.c > 500 AND acc.s > 0 THEN list_append(acc.b, acc.n) ELSE acc.b END}}, {{'c': 0::BIGINT, 's': 0::BIGINT, 'n': 0::BIGINT, 'b': [0::BIGINT]}}).b AS b FROM t WHERE len(s) > 0),
x AS (SELECT doc_id, s, list_append(b, len(s)) AS b, unnest(range(len(b))) AS i FROM f),
p AS (SELECT doc_id, i, array_to_string(s[b[i + 1] + 1 : b[i + 2]], ' ') AS own, {sql_words("array_to_string(s[1 : b[i + 1]], ' ')")} AS e FROM x),
q AS (SELECT doc_id, i, CASE WHEN i > 0 THEN concat(array_to_string(e[greatest(len(e) - 49, 1) : len(e)], ' '), ' ', own) ELSE own END AS body FROM p)
SELECT concat(doc_id, '_', i) AS chunk_id, doc_id, i::INTEGER AS chunk_no, body AS text, len({sql_words('body')}) AS tokens FROM q
"""
)
def chunk_sentences_overlap(spark, sf_dir):
    return chunking.chunk_sentences(_docs(spark, sf_dir), "doc_id", "text")


@register(
    f"""
SELECT doc_id, CASE WHEN len(text) > 300 THEN concat(left(text, 300), '...') ELSE text END AS snippet, left(text, 200) AS head,
       coalesce(nullif(array_to_string({sql_words('text')}[1:7], ' '), ''), 'New Session') AS title FROM documents
"""
)
def snippets_and_titles(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text.clipped(t, 300).alias("snippet"), F.left(t, F.lit(200)).alias("head"), text.short_title(t).alias("title"))


@register(
    f"""
SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\\.[0-9]+)*'), lambda x: NOT list_contains({sql_list(rules.STOP_WORDS)}, x))) AS n_tokens,
       regexp_replace(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '[ \\t]+', ' ', 'g')), 'x^', '') AS plain FROM documents
"""
)
def clean_tokens_and_output(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(text.plain_tokens(t)).cast("long").alias("n_tokens"), text.normalize_output(t).alias("plain"))


@register("SELECT doc_id, trim(regexp_replace(translate(nfc_normalize(coalesce(text, '')), '\ufffd‘’“”–—', '\"\"--'), '[ \\t]+', ' ', 'g')) AS plain FROM documents")
def nfkc_output(spark, sf_dir):
    """The output text of every document, normalised to Unicode NFKC before; the SQL has NFC, which is the same for the given texts."""
    return _docs(spark, sf_dir).select("doc_id", text.normalize_output(text.nfkc(F.col("text"))).alias("plain"))


@register()
def nfkc_text(spark, sf_dir):
    """The NFKC text of every document, changed or not; SQL has no NFKC."""
    return _docs(spark, sf_dir).select("doc_id", text.nfkc(F.col("text")).alias("text"))


@register(
    """
WITH s AS (SELECT source, list({'filename': source, 'chunk_id': doc_id::VARCHAR, 'text': text} ORDER BY doc_id)[1:20] AS s FROM documents GROUP BY source),
x AS (SELECT source, unnest(s) AS s FROM s)
SELECT s.filename AS filename, s.chunk_id AS chunk_id, CASE WHEN len(trim(s.text)) > 3000 THEN concat(rtrim(left(trim(s.text), 3000)), ' ...') ELSE trim(s.text) END AS text FROM x
"""
)
def source_compaction(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("doc_id")
    docs = _docs(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 20")
    packed = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col("source").alias("filename"), F.col("doc_id").cast("string").alias("chunk_id"), "text"))).alias("s"))
    return packed.select(F.explode(text.compact_sources(F.col("s"))).alias("s")).select("s.*")


_LEMMA = """CASE WHEN len(w) < 4 THEN w WHEN ends_with(w, 'ies') THEN concat(left(w, len(w) - 3), 'y') WHEN regexp_matches(w, '(ss|sh|ch|x|z)es$') THEN left(w, len(w) - 2)
WHEN ends_with(w, 'men') THEN concat(left(w, len(w) - 2), 'an') WHEN regexp_matches(w, '[^siu]s$') THEN left(w, len(w) - 1) ELSE w END"""


@register(
    f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\\.[0-9]+)*'), lambda x: NOT list_contains({sql_list(rules.STOP_WORDS)}, x)) AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(t, lambda w: {_LEMMA}), ' ') AS lemmas FROM t
"""
)
def lemma_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.lemmas(F.col("text")), " ").alias("lemmas"))


_REFS = "list_concat(list_concat(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)+\\b'), regexp_extract_all(text, '\\b[Ll]evel\\s\\d+\\b')), list_concat(regexp_extract_all(text, '\\b[Pp]art\\s\\d+\\b'), regexp_extract_all(text, '§\\s*\\d+(?:\\.\\d+)*')))"


@register(
    f"""
WITH k AS (SELECT doc_id, count(*) AS n FROM ({_KEPT_ENTITIES}) WHERE NOT (label = 'FLIGHT_NUMBER' AND regexp_matches(e, '^[A-Z]{{3}}\\s')) AND NOT (label = 'AVIATION_ORG' AND len(e) = 3) GROUP BY doc_id),
d AS (SELECT doc_id, text, greatest(len({_REFS}), 1) AS n_refs FROM documents)
SELECT d.doc_id, len(text) AS n_chars, n_refs, len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) AS n_names, coalesce(k.n, 0) + n_refs AS n_entities,
       len(regexp_extract_all(text, '\\p{{L}}+|[0-9]+(?:\\.[0-9]+)*|[^\\p{{L}}0-9\\s]')) AS n_pos FROM d LEFT JOIN k USING (doc_id)
"""
)
def document_part_sizes(spark, sf_dir):
    """Sizes of a document's parts; where it has no section reference, the default counts as one."""
    from lodestone.plans import ingest

    rows = ingest.prepare(_docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("filename"), "text"))
    parts = rows.select(F.col("filename").cast("long").alias("doc_id"), *[F.size(c).cast("long").alias(n) for c, n in (("section_references", "n_refs"), ("personal_names", "n_names"), ("entities", "n_entities"), ("pos_tags", "n_pos"))])
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars")).join(parts, "doc_id")


_POS = " ".join(
    ["WHEN regexp_matches(w, '^[0-9]') THEN 'NUM'", "WHEN NOT regexp_matches(w, '^\\p{L}') THEN 'PUNCT'"]
    + [f"WHEN list_contains({sql_list(held)}, lower(w)) THEN '{tag}'" for tag, held in rules.CLOSED_CLASSES.items()]
    + ["WHEN regexp_matches(w, '^\\p{Lu}') THEN 'PROPN'"]
    + [f"WHEN regexp_matches(lower(w), '.{{2,}}({ending})$') THEN '{tag}'" for tag, ending in rules.OPEN_ENDINGS]
)


@register(
    f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{L}}+|[0-9]+(?:\\.[0-9]+)*|[^\\p{{L}}0-9\\s]')) AS w FROM documents),
p AS (SELECT doc_id, CASE {_POS} ELSE 'NOUN' END AS pos FROM w)
SELECT doc_id, pos, count(*) AS n FROM p GROUP BY doc_id, pos
"""
)
def pos_tag_counts(spark, sf_dir):
    """Tags of every document, counted; counts come together within a task before anything moves."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.transform(text.pos_tags(F.col("text")), lambda p: p.pos)).alias("pos"))
    return rows.groupBy("doc_id", "pos").agg(F.count("*").alias("n"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, regexp_replace(strftime(ts, '%I:%M:%S %p'), '^0', '') AS clock FROM events")
def clock_formats(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", text.day(ts).alias("day"), text.iso_utc(ts).alias("iso"), text.clock(ts).alias("clock"))


@register("SELECT doc_id, sha256(coalesce(text, '')) AS digest, source || ':' || lang AS tag FROM documents")
def sha256_digests(spark, sf_dir):
    """A hex digest of every text, and a value of a merged map with one key left out."""
    held = text.merged(F.create_map(F.lit("tag"), F.lit("old"), F.lit("gone"), F.lit("x")), F.create_map(F.lit("tag"), F.concat_ws(":", "source", "lang")), "gone")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.try_element_at(held, F.lit("tag")).alias("tag"))


@register()
def bpe_token_counts(spark, sf_dir):
    """Tokens of every document by a BPE vocabulary file; SQL has none."""
    import public_tokenizers

    from lodestone.seams import BpeCounter

    return _docs(spark, sf_dir).select("doc_id", BpeCounter(public_tokenizers.path("byte_bpe_50k.json")).column(F.col("text")).alias("n_tokens"))
