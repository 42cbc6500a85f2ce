"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .conversations import audited, damaged, with_all
from .debruijn import without_repeats
from .fingerprints import compare_neighbours
from .importance import resample
from .jaccard import near_duplicates
from .langid import identify
from .linefreq import judge
from .mixing import mix
from .ordinal import rate
from .packing import pack
from .simhash import near_duplicates as simhash_duplicates
from .toxicity import score
from .urlfilter import judge_urls

#: A dated URL list, as a pipeline would be given: (kind, entry, action, day, seq).
URL_LIST = [
    ("domain", "spam-farm.example.org", "add", "2024-01-10", 1),
    ("domain", "spam-farm.example.org", "remove", "2024-04-01", 2),
    ("domain", "spam-farm.example.org", "add", "2024-06-15", 3),
    ("domain", "example.net", "add", "2024-03-01", 4),
    ("domain", "example.net", "remove", "2024-03-15", 5),
    ("domain", "tionsh.example.net", "add", "2024-09-01", 6),
    ("prefix", "blog.tionble.example.com/en", "add", "2024-02-01", 7),
    ("prefix", "blog.tionble.example.com/en", "remove", "2024-02-01", 8),
    ("prefix", "blog.tionble.example.com/fr", "add", "2024-05-05", 9),
    ("prefix", "m.tiontion.example.com/de", "add", "2024-01-01", 10),
    ("prefix", "m.tiontion.example.com/de", "remove", "2024-12-01", 11),
    ("domain", "blog.ththth.example.org", "remove", "2024-07-01", 12),
    ("domain", "blog.ththth.example.org", "add", "2024-10-01", 13),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def _digits(text):
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def url_events(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the hosts of ``pages``: ``URL_LIST``, and for every host three events, all on days that its
    md5 tells: it is added as a domain, removed, and its part at the first path segment is added as a prefix."""
    spark = pages.sparkSession
    fixed = spark.createDataFrame(URL_LIST, "kind string, entry string, action string, day string, seq int").withColumn("day", F.col("day").cast("date"))
    parts = pages.select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]+)", 1).alias("first")).where("host != ''").distinct()
    day = lambda name, share: F.expr("date '2024-01-01'") + (_digits(F.concat(F.lit(name), "host")) % share).cast("int")
    event = lambda kind, entry, action, when, seq: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"), F.lit(action).alias("action"), when.alias("day"), F.lit(seq).alias("seq"))
    listed = [event("domain", F.col("host"), "add", day("a", 1500), 20), event("domain", F.col("host"), "remove", day("b", 1500), 21), event("prefix", F.concat("host", F.lit("/"), "first", F.lit("/")), "add", day("c", 1500), 22)]
    return fixed.unionByName(parts.select(F.explode(F.array(*listed)).alias("e")).select("e.*").distinct())


def op4_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` has no fetch times: page n counts as fetched n days, modulo 366, into 2024."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(page_id % 366 as int))").alias("fetched"))
    return judge_urls(pages, url_events(pages)).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_read(spark, sf_dir, "documents"))


def op6_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_read(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return rate(docs, _read(spark, sf_dir, "labels")).drop("text")


def op8_marginal_unigram_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(_read(spark, sf_dir, "documents"))


def op11_signature_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    return with_all(rows, audited(damaged(rows)))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_min_bin_slack": op1_min_bin_slack,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_systematic_mix": op3_systematic_mix,
    "op4_temporal_url_list": op4_temporal_url_list,
    "op5_line_frequency": op5_line_frequency,
    "op6_debruijn_dedup": op6_debruijn_dedup,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_marginal_unigram_langid": op8_marginal_unigram_langid,
    "op9_cnn_toxicity": op9_cnn_toxicity,
    "op10_prefix_fingerprints": op10_prefix_fingerprints,
    "op11_signature_repair": op11_signature_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_golay_simhash": op13_golay_simhash,
}

#: Words as the contracts define them.
_W = r"'[^\x20\x09-\x0D]+'"



def _crc32(text: str) -> str:
    """DuckDB SQL for the crc32 of the UTF-8 bytes of ``text``, bit by bit."""
    code = f"('0x' || substr(hex(encode({text})), (2 * i - 1)::INT, 2))::BIGINT"
    codes = f"list_transform(range(1, (length(hex(encode({text}))) // 2)::BIGINT + 1), lambda i: {code})"
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _repair_step() -> dict[str, str]:
    """DuckDB SQL for the best of each state of the pattern before a row (g: without an insert before it, f: with one), from those
    behind it (f0 to f3).  A value is the cost, the audit, chr(1) and the lines, so that the least string is the best."""
    put = lambda cost, edit, line, rest: f"lpad((substr({rest}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || '{edit}' || regexp_extract(substr({rest}, 9), '^[DIKR]*') || chr(1) || {line} || substr({rest}, strpos({rest}, chr(1)) + 1)"
    to, made = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    kept = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    out = {}
    for n in range(4):
        keep = " ".join(f"WHEN initial = '{i}' THEN {put('late', 'K', 'role || chr(58) || text || chr(10)', f'f{k}')}" for i, k in kept[n].items())
        change = put("2 + late", "R", f"'{made[n]}:' || text || chr(10)", f"f{to[n]}")
        out[f"g{n}"] = f"least({put(3, 'D', "''", f'f{n}')}, CASE WHEN NOT gone THEN CASE {keep} END END, CASE WHEN NOT gone THEN {change} END)"
    out["h2"], out["h3"] = (f"least(g{n}, {put(2, 'I', f"'{made[n]}:' || chr(10)", f'g{5 - n}')})" for n in (2, 3))
    out["h0"], out["h1"] = (f"least(g{n}, {put(2, 'I', "'user:' || chr(10)", 'h2')})" for n in (0, 1))
    return out


_REPAIR = _repair_step()

_EVENTS = ", ".join(f"('{k}', '{e}', '{a}', DATE '{d}', {n})" for k, e, a, d, n in URL_LIST)

SQL = {
    "op2_ngram_jaccard": rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_W}) AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id""",
    "op3_systematic_mix": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_W}))::BIGINT AS size FROM documents),
b AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 8))::BIGINT % (SELECT greatest(256, ceil(count(*) / 20000.0)::BIGINT) FROM d) AS bucket FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS n FROM w),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM k),
f AS (SELECT min(n) AS n, arg_min(level, n) AS level FROM l WHERE source_size * 3.0::DOUBLE > level * weight),
t AS (SELECT l.source, l.source_size, CASE WHEN f.n IS NULL OR l.n < f.n THEN l.source_size * 3.0::DOUBLE ELSE least(l.source_size * 3.0::DOUBLE, f.level * l.weight) END AS target FROM l, f),
p AS (SELECT b.*, t.source_size, t.target, row_number() OVER (PARTITION BY b.source ORDER BY bucket, doc_id, size) AS upto,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio,
             ('0x' || substr(md5('7:' || (b.source IS NULL)::INT || ':' || coalesce(b.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, k, any_value(target) AS target, sum(size * least(floor(upto * ratio + (u + k / 32.0::DOUBLE) % 1.0::DOUBLE) - floor((upto - 1) * ratio + (u + k / 32.0::DOUBLE) % 1.0::DOUBLE), 3)) AS total FROM p, range(32) o(k) GROUP BY 1, 2),
o AS (SELECT source, arg_min(k, (abs(total - target), k)) AS k FROM c GROUP BY 1),
q AS (SELECT p.*, least(floor(upto * ratio + (u + k / 32.0::DOUBLE) % 1.0::DOUBLE) - floor((upto - 1) * ratio + (u + k / 32.0::DOUBLE) % 1.0::DOUBLE), 3)::BIGINT AS copies FROM p JOIN o ON p.source IS NOT DISTINCT FROM o.source)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM q""",
    "op4_temporal_url_list": rf"""
WITH hs AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) AS first FROM pages WHERE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) != ''),
ev(kind, entry, action, day, seq) AS (SELECT * FROM (VALUES {_EVENTS})
  UNION ALL SELECT DISTINCT 'domain', lower(host), 'add', DATE '2024-01-01' + (('0x' || substr(md5('a' || host), 1, 8))::BIGINT % 1500)::INT, 20 FROM hs
  UNION ALL SELECT DISTINCT 'domain', lower(host), 'remove', DATE '2024-01-01' + (('0x' || substr(md5('b' || host), 1, 8))::BIGINT % 1500)::INT, 21 FROM hs
  UNION ALL SELECT DISTINCT 'prefix', rtrim(lower(host || '/' || first), '/'), 'add', DATE '2024-01-01' + (('0x' || substr(md5('c' || host), 1, 8))::BIGINT % 1500)::INT, 22 FROM hs),
dl AS (SELECT kind, entry, day, arg_max(action, seq) AS action FROM ev GROUP BY ALL),
tu AS (SELECT *, lag(action) OVER w AS was FROM dl WINDOW w AS (PARTITION BY kind, entry ORDER BY day)),
sp AS (SELECT *, lead(day) OVER (PARTITION BY kind, entry ORDER BY day) AS until FROM tu WHERE (was IS NULL AND action = 'add') OR was != action),
li AS (SELECT kind, entry, day AS since, until FROM sp WHERE action = 'add'),
pg AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched,
       regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') AS host,
       '/' || lower(array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s != ''), '/')) || '/' AS path FROM pages),
hit AS (SELECT page_id, count(*) AS n_active, min(kind || ':' || entry) AS entry FROM pg JOIN li
        ON fetched >= since AND (until IS NULL OR fetched < until) AND host != ''
        AND CASE WHEN kind = 'domain' THEN host = entry OR ends_with(host, '.' || entry) ELSE starts_with(CASE WHEN path = '//' THEN host || '/' ELSE host || path END, entry || '/') END GROUP BY page_id)
SELECT page_id, url, host, strftime(fetched, '%Y-%m-%d') AS fetched, coalesce(n_active, 0)::BIGINT AS n_active, entry, n_active IS NULL AS allowed FROM pg LEFT JOIN hit USING (page_id)""",
    "op5_line_frequency": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
tw AS (SELECT doc_id, g FROM p GROUP BY ALL HAVING count(*) > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM p JOIN tw USING (doc_id, g)) GROUP BY doc_id),
l AS (SELECT *, regexp_extract_all(line, {_W}) AS lw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
h AS (SELECT doc_id, source, text, line, array_to_string(lw, ' ').translate('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm, len(lw) AS n FROM l WHERE len(lw) > 0),
du AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM h GROUP BY doc_id),
fr AS (SELECT source, norm FROM h GROUP BY ALL HAVING count(DISTINCT text) > 20),
lo AS (SELECT doc_id, sum(h.n)::BIGINT AS n FROM h JOIN fr ON h.norm = fr.norm AND h.source IS NOT DISTINCT FROM fr.source GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      coalesce(du.n, 0) AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(lo.n, 0) AS n_frequent_words
      FROM d LEFT JOIN du USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN lo USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_frequent_words <= 50 * n_words AS kept FROM s""",
    "op6_debruijn_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_W}) AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1),
k AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
t AS (SELECT k.doc_id, count(gone.j) AS n_removed, coalesce(string_agg(k.word, ' ' ORDER BY k.j) FILTER (WHERE gone.j IS NULL), '') AS kept
      FROM k LEFT JOIN gone USING (doc_id, j) GROUP BY k.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""",
    "op11_signature_repair": rf"""
WITH RECURSIVE dm AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
      unnest(range(CASE WHEN kind = 3 THEN 2 WHEN kind = 0 THEN 0 ELSE 1 END)) AS copy FROM dm),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS seen FROM x),
e AS (SELECT *, substr(role, 1, 1) AS initial, seen = '' AS blank, seen != '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM o),
b AS (SELECT *, NOT blank AND NOT duplicate AND right(seen, 1) NOT IN ('.', '!', '?') AS truncated, blank OR duplicate AS gone,
      lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM e),
c AS (SELECT *, truncated::INT AS late FROM b),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
       count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM c GROUP BY conv_id),
r AS (SELECT conv_id, n + 1 AS i, '00000000' || chr(1) AS f0, '00000004II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10) AS f1, '00000002I' || chr(1) || 'assistant:' || chr(10) AS f2, '00000000' || chr(1) AS f3 FROM st
  UNION ALL
  SELECT conv_id, i, {_REPAIR["h0"]}, {_REPAIR["h1"]}, h2, h3 FROM (
  SELECT *, {_REPAIR["h2"]} AS h2, {_REPAIR["h3"]} AS h3 FROM (
  SELECT r.conv_id, c.i, {", ".join(f"{_REPAIR[g]} AS {g}" for g in ("g0", "g1", "g2", "g3"))}
  FROM r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = r.i - 1))),
z AS (SELECT conv_id, f0 FROM r WHERE i = 1),
k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(substr(f0, 1, 8)::BIGINT, 0) AS cost, coalesce(regexp_extract(substr(f0, 9), '^[DIKR]*'), '') AS audit,
       sha256(coalesce(substr(f0, strpos(f0, chr(1)) + 1, length(f0) - strpos(f0, chr(1)) - 1), '')) AS repaired_sha256
FROM k LEFT JOIN st ON k.conv_id IS NOT DISTINCT FROM st.conv_id LEFT JOIN z ON k.conv_id IS NOT DISTINCT FROM z.conv_id""",
    "op12_importance_resampling": rf"""
WITH wd AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, w, count(*) AS n FROM (SELECT side, unnest(w) AS w FROM wd) GROUP BY ALL),
v AS (SELECT w, {_crc32("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM f)),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM f JOIN v USING (w) GROUP BY bucket),
a AS (SELECT coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t_all FROM f),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM c, a),
k AS (SELECT w, gain FROM v JOIN g USING (bucket)),
x AS (SELECT doc_id, sum(gain)::BIGINT AS total FROM (SELECT doc_id, unnest(w) AS w FROM wd WHERE side = 0) JOIN k USING (w) GROUP BY doc_id),
d AS (SELECT wd.doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(coalesce(total, 0)::DOUBLE / len(w)) END::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || wd.doc_id), 1, 8))::BIGINT AS h FROM wd LEFT JOIN x USING (doc_id) WHERE side = 0),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= 20)
SELECT s.*, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)""",
}
