"""The queries of this subpackage, one ``opN_`` for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_layout, lcp, lexical, pieces, pii, preference, prefix_trie, quality, sharding, simhash, urlfilter, warc
from .shared import spread, table


def op1_simhash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    return decontaminate.matches(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(documents, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40)


def op6_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the ids of each whole text, and whether they spell it again."""
    spelt = pieces.encode_and_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spelt.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"),
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.MARK), F.lit(" "))).alias("round_trip"),
    )


URL_RULES = [
    urlfilter.Rule("allow", "org/"), urlfilter.Rule("block", "example.org/es/"), urlfilter.Rule("block", "example.org/en/1"),
    urlfilter.Rule("allow", "com/fr/"), urlfilter.Rule("block", "com/de/"),
]


def op7_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_locally_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.compare_with_next(table(spark, sf_dir, "documents"))


def op9_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_layout.extract(spread(table(spark, sf_dir, "pages").select("page_id", "html")))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against its own copy ending in its partner's last reply; the masks' spans as text, ``first-end`` by commas."""
    pairs = preference.format_pairs(*preference.partner_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["first"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.select(
        F.col("pair_id").alias("conv_id"), "prompt", "chosen", "rejected", "prompt_turns", "chosen_turns", "rejected_turns", spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask")
    )


def op11_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return lexical.search(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), k=20)


def op12_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each whole text: numbers and hash of what the rules find, and all spans."""
    found = pii.extract(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt with the heads that they share."""
    nodes = prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {f.__name__: f for f in (op1_simhash_pivot, op2_bm25_wand, op3_warc_salvage, op4_compression_quality, op5_bounded_ring, op6_piece_viterbi, op7_url_automaton, op8_locally_consistent, op9_layout_text, op10_preference_pairs, op11_block_max, op12_bootstrapped_pii, op13_prefix_trie)}

#: Host and path as in the query; each rule's test in order of its length.
_URL_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_PREFERENCE_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
replies AS (SELECT conv_id, turn, text FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC NULLS LAST) = 1),
changed AS (
  SELECT DISTINCT t.conv_id, t.turn, t.role, CASE WHEN coalesce(t.turn = l.turn AND t.role = 'assistant', false) THEN o.text ELSE t.text END AS text
  FROM t LEFT JOIN replies l ON l.conv_id = t.conv_id LEFT JOIN replies o ON o.conv_id = xor(t.conv_id, 1)
  WHERE NOT coalesce(t.turn = l.turn AND t.role = 'assistant', false) OR o.conv_id IS NOT NULL),
sides AS (SELECT 'c' AS side, * FROM t UNION ALL SELECT 'r', * FROM changed),
esc AS (SELECT *, regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\1\\|', 'g') AS who, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS said FROM sides),
n AS (SELECT *, '<|' || who || '|>' || chr(10) || said || chr(10) || '<|end|>' || chr(10) AS piece, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM esc),
sizes AS (SELECT conv_id, count(*) FILTER (WHERE side = 'c') AS nc, count(*) FILTER (WHERE side = 'r') AS nr FROM n GROUP BY 1),
differs AS (SELECT c.conv_id, min(c.k) AS k FROM n c JOIN n r ON r.conv_id = c.conv_id AND r.k = c.k AND c.side = 'c' AND r.side = 'r' WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY 1),
shared AS (SELECT s.*, coalesce(d.k - 1, least(nc, nr)) AS shared FROM sizes s LEFT JOIN differs d USING (conv_id)),
placed AS (SELECT n.*, s.shared, sum(length(piece)) OVER (PARTITION BY n.conv_id, side ORDER BY k) AS upto FROM n JOIN shared s ON s.conv_id = n.conv_id)
SELECT s.conv_id, coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'c' AND k <= s.shared), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'c' AND k > s.shared), '') AS chosen, coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 'r' AND k > s.shared), '') AS rejected,
  CAST(s.shared AS INTEGER) AS prompt_turns, CAST(any_value(s.nc) - s.shared AS INTEGER) AS chosen_turns, CAST(any_value(s.nr) - s.shared AS INTEGER) AS rejected_turns,
  coalesce(string_agg(CAST(upto - length(piece) + length(who) + 5 AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'c' AND k > s.shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(upto - length(piece) + length(who) + 5 AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY k) FILTER (WHERE side = 'r' AND k > s.shared AND role = 'assistant'), '') AS rejected_mask
FROM shared s JOIN placed p ON p.conv_id = s.conv_id GROUP BY s.conv_id, s.shared
"""

_SEARCH_SQL = r"""
WITH said AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, len(terms) AS n FROM said WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY 1),
gains AS (SELECT d, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS gain FROM tf JOIN docs USING (d), whole),
items AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(terms) AS term FROM items) GROUP BY 1, 2),
scored AS (SELECT q, d, CAST(sum(times * w * gain) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN gains USING (term) GROUP BY 1, 2),
ranked AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored JOIN docs USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 20
"""

#: Turns go by digests, prefixes by their joined digests; crc32 by its table, which comes from the polynomial.
_TRIE_SQL = """
WITH entries AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) AS r(i)),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'digest': digest, 'bytes': bytes} ORDER BY turn NULLS FIRST, digest[:32]) AS turns FROM turns GROUP BY 1),
hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM own, entries),
built AS (
  SELECT c.conv_id, list_concat(coalesce(o.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
  FROM hashed c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5),
paths AS (SELECT conv_id, len(turns) AS len, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
keyed AS (SELECT conv_id, len, depth, list_reduce(list_prepend('', list_transform(turns[1:depth], lambda t: t.digest)), lambda a, b: md5(a || b)) AS key,
  CASE WHEN depth > 0 THEN list_reduce(list_prepend('', list_transform(turns[1:depth - 1], lambda t: t.digest)), lambda a, b: md5(a || b)) END AS parent, CASE WHEN depth > 0 THEN turns[depth].bytes ELSE 0 END AS bytes FROM paths),
nodes AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = depth), '')) AS ends_sha256 FROM keyed GROUP BY 1),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
above AS (SELECT DISTINCT n.key AS below, k.key FROM nodes n JOIN keyed o ON o.conv_id = n.conv_id AND o.depth = n.depth JOIN keyed k ON k.conv_id = n.conv_id AND k.depth <= n.depth),
sums AS (SELECT a.key, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, CAST(sum(n.saved) AS BIGINT) AS saved_tokens FROM above a JOIN nodes n ON n.key = a.below LEFT JOIN children c ON c.key = n.key GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.key = n.parent LEFT JOIN children c ON c.key = n.key JOIN sums s ON s.key = n.key
"""

ORACLES: dict[str, str] = {"op13_prefix_trie": _TRIE_SQL, "op11_block_max": _SEARCH_SQL, "op3_warc_salvage": _WARC_SQL, "op7_url_automaton": _URL_SQL, "op10_preference_pairs": _PREFERENCE_SQL}
