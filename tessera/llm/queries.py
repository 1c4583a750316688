"""The operators over the whole tables, with the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.archives import pages_through_archives
from tessera.llm.codes import books_digest, vector_codes, with_label_error
from tessera.llm.decontaminate import contaminated, find_contamination
from tessera.llm.lines import without_common_lines
from tessera.llm.mixture import with_copies
from tessera.llm.neighbours import nearest_neighbours
from tessera.llm.ngram_join import ngram_jaccard_components
from tessera.llm.phrases import collocations
from tessera.llm.quotes import reply_ordered
from tessera.llm.substrings import without_repeats
from tessera.llm.tokens import documents_through_files
from tessera.llm.toxicity import fit_toxicity, is_held_out, score_toxicity
from tessera.llm.url_lists import host_of, listed_captures

#: The weights of the sources of a mix, in turn.
WEIGHTS = [5.0, 2.0, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"), words=4, num=17, den=20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_through_archives(table(spark, sf_dir, "pages"), least_bytes=0, version=2)


# base32 of a SHA-1: its 160 bits by five, each a letter of A-Z2-7
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes,
         array_to_string(list_transform(range(0, 40, 5), lambda i: array_to_string(list_transform(range(4), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(html), i + 1, 5) AS BIGINT) >> (15 - 5 * k)) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def toxicity_model(spark: SparkSession, sf_dir: str):
    return fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~is_held_out("doc_id")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A history of list entries for every host of the pages: on a day by its digest the host is added to a list, 60 days later removed, and
    120 days later added again; its parent domain is added to a second list on another day and stays."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    digit = lambda k: F.ascii(F.substring(F.md5("host"), k, 1))
    day = ((digit(1) * 31 + digit(2) * 7 + digit(3)) % 240).cast("int")
    other = ((digit(4) * 29 + digit(5) * 5) % 360).cast("int")
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    rows = F.array(*(F.struct(F.lit(name).alias("list"), domain.alias("domain"), F.date_add(F.to_date(F.lit("2024-01-01")), when.cast("int")).alias("day"), F.lit(action).alias("action")) for name, domain, when, action in (("spam", F.col("host"), day, "add"), ("spam", F.col("host"), day + 60, "remove"), ("spam", F.col("host"), day + 120, "add"), ("adult", parent, other, "add"))))
    return hosts.select(F.explode(rows).alias("e")).select("e.*")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.withColumn("fetched", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") * 13 % 365).cast("int")))
    found = listed_captures(captures, dated_entries(pages))
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "listed", F.array_join("lists", ",").alias("lists"), "domain", F.col("since").cast("string").alias("since"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 13 % 365 AS INTEGER) AS fetched,
         nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#\\\\]*)', 1), '^[^@]*@', ''), ':[0-9]*$', ''), '\\.$', '')), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS m FROM p WHERE host IS NOT NULL),
d AS (SELECT host, (ascii(substr(m, 1, 1)) * 31 + ascii(substr(m, 2, 1)) * 7 + ascii(substr(m, 3, 1))) % 240 AS k,
             (ascii(substr(m, 4, 1)) * 29 + ascii(substr(m, 5, 1)) * 5) % 360 AS o FROM h),
entries AS (
  SELECT 'spam' AS list, host AS domain, DATE '2024-01-01' + CAST(k AS INTEGER) AS day, 'add' AS action FROM d
  UNION SELECT 'spam', host, DATE '2024-01-01' + CAST(k + 60 AS INTEGER), 'remove' FROM d
  UNION SELECT 'spam', host, DATE '2024-01-01' + CAST(k + 120 AS INTEGER), 'add' FROM d
  UNION SELECT 'adult', regexp_replace(host, '^[^.]*\\.', ''), DATE '2024-01-01' + CAST(o AS INTEGER), 'add' FROM d),
days AS (SELECT list, domain, day, max(action) AS action FROM entries GROUP BY ALL),
intervals AS (SELECT list, domain, day AS since, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until, action FROM days),
hits AS (
  SELECT p.page_id, p.url, i.list, i.domain, i.since FROM p JOIN intervals i
  ON (p.host = i.domain OR ends_with(p.host, '.' || i.domain)) AND i.action = 'add' AND i.since <= p.fetched AND (i.until IS NULL OR p.fetched < i.until))
SELECT p.page_id, any_value(p.host) AS host, CAST(any_value(p.fetched) AS VARCHAR) AS fetched, count(hits.list) > 0 AS listed,
       coalesce(string_agg(DISTINCT hits.list, ',' ORDER BY hits.list), '') AS lists,
       arg_max(hits.domain, length(hits.domain)) AS domain, CAST(min(hits.since) AS VARCHAR) AS since
FROM (SELECT DISTINCT * FROM p) p LEFT JOIN hits ON p.page_id IS NOT DISTINCT FROM hits.page_id AND p.url IS NOT DISTINCT FROM hits.url
GROUP BY p.page_id, p.url
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(table(spark, sf_dir, "documents"), WEIGHTS, most=3)
    return rows.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_through_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def quoting_replies(messages: DataFrame) -> DataFrame:
    """The messages as mails have them: two of three, by conversation and turn, first quote the last line of the message before and, one level deeper, the
    first line of the message before that. Of repeated turns the smallest text is quoted."""
    said = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    lines = F.split("said", r"\r\n|\n|\r")
    one = said.select(F.col("conv_id").alias("conv1"), (F.col("turn") + 1).alias("turn1"), F.element_at(lines, -1).alias("last"))
    two = said.select(F.col("conv_id").alias("conv2"), (F.col("turn") + 2).alias("turn2"), F.element_at(lines, 1).alias("first"))
    rows = messages.join(one, (F.col("conv_id") == F.col("conv1")) & (F.col("turn") == F.col("turn1")), "left")
    rows = rows.join(two, (F.col("conv_id") == F.col("conv2")) & (F.col("turn") == F.col("turn2")), "left")
    quote = lambda marks, line: F.coalesce(F.concat(F.lit(marks), F.col(line), F.lit("\n")), F.lit(""))
    quoting = F.concat(quote("> > ", "first"), quote("> ", "last"), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, quoting).otherwise(F.col("text")).alias("text"))


def op10_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reply_ordered(quoting_replies(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "turn", "role", "content", "reply_to", "thread", "depth", F.array_join("sources", ",").alias("sources"))


OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, string_split_regex(min(text), '\r\n|\n|\r') AS l FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
m AS (
  SELECT c.conv_id, c.turn, c.role, string_split_regex(CASE WHEN (c.conv_id + c.turn) % 3 <> 0
           THEN concat(coalesce('> > ' || p2.l[1] || chr(10), ''), coalesce('> ' || p1.l[-1] || chr(10), ''), c.text) ELSE coalesce(c.text, '') END, '\r\n|\n|\r') AS l
  FROM conversations c LEFT JOIN t p1 ON p1.conv_id = c.conv_id AND p1.turn = c.turn - 1 LEFT JOIN t p2 ON p2.conv_id = c.conv_id AND p2.turn = c.turn - 2),
own AS (
  SELECT conv_id, turn, role, l, regexp_replace(regexp_replace(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^(?:[ \t]*>)+')), chr(10)), '^(?:[ \t]*\n)+', ''), '(?:\n[ \t]*)+$', '') AS content FROM m),
lines AS (SELECT DISTINCT conv_id, turn, md5(array_to_string(l, chr(10))) AS message, unnest(l) AS x, unnest(range(len(l))) AS line FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
quoted AS (
  SELECT conv_id, turn, message, line, length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS depth, regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') AS said
  FROM lines WHERE regexp_matches(x, '^(?:[ \t]*>)+')),
passages AS (
  SELECT conv_id, turn, depth, trim(regexp_replace(lower(string_agg(said, chr(10) ORDER BY line)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
  FROM (SELECT *, line - row_number() OVER (PARTITION BY conv_id, turn, message, depth ORDER BY line) AS run FROM quoted) GROUP BY conv_id, turn, message, depth, run),
parts AS (
  SELECT conv_id, turn, unnest(list_concat([content], string_split_regex(content, '\n[ \t]*\n'), string_split_regex(content, '\r\n|\n|\r'))) AS part FROM own WHERE content <> ''),
first AS (SELECT conv_id, trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, min(turn) AS source FROM parts GROUP BY ALL),
links AS (SELECT p.conv_id, p.turn, p.depth, f.source FROM passages p JOIN first f ON f.conv_id = p.conv_id AND f.key = p.key WHERE p.key <> '' AND f.source < p.turn),
replies AS (
  SELECT conv_id, turn, arg_max(source, -depth * 1000000000 + source) AS reply_to, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM links GROUP BY conv_id, turn),
up(conv_id, turn, above, depth) AS (
  SELECT conv_id, turn, reply_to, 1 FROM replies UNION ALL SELECT u.conv_id, u.turn, r.reply_to, u.depth + 1 FROM up u JOIN replies r ON r.conv_id = u.conv_id AND r.turn = u.above),
threads AS (SELECT conv_id, turn, arg_max(above, depth) AS thread, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT o.conv_id, o.turn, o.role, o.content, r.reply_to, coalesce(h.thread, o.turn) AS thread, CAST(coalesce(h.depth, 0) AS INTEGER) AS depth, coalesce(r.sources, '') AS sources
FROM own o LEFT JOIN replies r ON r.conv_id = o.conv_id AND r.turn = o.turn LEFT JOIN threads h ON h.conv_id = o.conv_id AND h.turn = o.turn
"""


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_common_lines(table(spark, sf_dir, "documents"), least_documents=3, least_chars=20)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS place FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
many AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT k.*, coalesce(k.doc_id <> many.last, false) AS gone FROM k LEFT JOIN many ON k.key = many.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _op12_sql(rounds: int = 6) -> str:
    """The rounds one after the other; floors of negative quotients by a remainder that is never negative."""
    nearest = """d{r} AS (SELECT v.r, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS d FROM v JOIN b{r} b ON v.p = b.p),
a{r} AS MATERIALIZED (SELECT r, p, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM d{r} GROUP BY r, p)"""
    step = """s{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS c FROM (SELECT a.p, a.e, unnest(v.x) AS x, unnest(range(1, len(v.x) + 1)) AS i FROM a{r} a JOIN v ON v.r = a.r AND v.p = a.p) GROUP BY p, e, i),
m{r} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS x FROM s{r} GROUP BY p, e),
b{q} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)"""
    first = """WITH u AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, vec_id, label, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM u, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM v WHERE r <= 16)"""
    last = """e AS (SELECT r, string_agg(lpad(hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{r} GROUP BY r),
k AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b{r})
SELECT u.vec_id, lower(e.code) AS code, e.error, (sum(e.error) OVER (PARTITION BY u.label))::BIGINT AS label_error, k.h AS codebooks_sha256 FROM e JOIN u ON u.r = e.r, k"""
    parts = [first]
    for r in range(rounds):
        parts += [nearest.format(r=r), step.format(r=r, q=r + 1)]
    return ",\n".join([*parts, nearest.format(r=rounds), last.format(r=rounds)])


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=5, least=100, share=100, best=2000)


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
k AS (SELECT lang, w, unnest(range(1, 6)) AS k FROM w),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM k),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f),
cuts AS (SELECT lang, phrase, w, a, unnest(range(1, k)) AS k FROM s WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n.n, 1000 * c.a * n.n // (l.a * r.a) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ') JOIN n ON n.lang = c.lang),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, a, w, unnest(range(2, k)) AS size FROM s WHERE k > 2),
within AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS a FROM (SELECT lang, a, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM longer) GROUP BY ALL),
free AS (SELECT c.* FROM lowest c LEFT JOIN within i ON i.lang = c.lang AND i.phrase = c.phrase WHERE i.a IS NULL OR 100 * i.a < 100 * c.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM free QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ngram_jaccard_join, op2_warc, op3_decontamination, op4_toxicity, op5_url_filters, op6_source_mix, op7_substring_dedup, op8_token_files, op9_nearest_neighbours, op10_chat_quotes, op11_line_dedup, op12_vector_codes, op13_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_url_filters": OP5_SQL, "op10_chat_quotes": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_collocations": OP13_SQL}
