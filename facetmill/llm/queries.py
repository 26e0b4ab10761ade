"""The registered query of each operator, with production parameters, over its whole table; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fim, html_text, lm, media, mixing, near, packing, periodic, quality, suffixes, tokens, vector_packing, weak
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(mixing.mix_plan(table(spark, sf_dir, "documents"))).drop("_h", "positions")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).drop("archive", "member_offset")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), near.NearConfig(shingle=2))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_report(table(spark, sf_dir, "documents")).drop("spans")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), change=periodic.planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    exponent = F.expr("1000 * length DIV period")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_html_text": op3_html_text,
    "op4_media_columns": op4_media_columns,
    "op5_language_model": op5_language_model,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_token_counts": op7_token_counts,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_vector_packing": op11_vector_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}

_WORDS = r"[^\x20\x09-\x0D]+"

#: Sources, their fill level in closed form, and cumulative sizes in the order of a hash.
_MIX = rf"""WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(doc_id || '|', '-|') || coalesce(source || '|', '-|') || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
r AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source),
w AS (SELECT *, CAST(1 + rank % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most, CAST([1.5, 1.0, 0.5][rank % 3 + 1] AS DOUBLE) AS a, CAST([0.5, 1.0, 1.5][rank % 3 + 1] AS DOUBLE) AS b FROM r),
v AS (SELECT *, most / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w
  WINDOW before AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(most, weight * (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)) AS target FROM v),
p AS (SELECT s.*, source_size, target, a, b, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(CASE WHEN size > 0 AND target > middle THEN least(ceil((target - middle) / source_size), 3) ELSE 0 END AS INTEGER) AS copies, least(greatest(middle / target, 0.0), 1.0) * (a + b) / 2 AS need FROM p)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken, CASE WHEN copies > 0 THEN 2 * need / (a + sqrt(greatest(0.0, a * a + 2 * (b - a) * need))) END AS position FROM c"""

#: The article of a page, which every page of the tables marks: blocks without tags, the references that occur decoded.
_HTML = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(x, '</?(p|h1|br)\b[^>]*>'), lambda t: replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS t FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(t, lambda v: trim(regexp_replace(v, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda v: v <> ''), ' ') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""

#: Sets of two-word shingles, links by counting common ones, components by spreading ids.
_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s), g AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, min(root) AS component_id, min(root) = n.doc_id AS kept FROM n JOIN c ON c.node = n.doc_id GROUP BY n.doc_id, n"""

#: Every string of 50 bytes (as hexadecimal digits) with the smallest doc_id that has it.
_REPEATS = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(0, length(x) // 2 - 49))) AS p FROM h)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT g.doc_id, g.p FROM g JOIN m USING (s) WHERE g.doc_id > m.first),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS new FROM c)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, k),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
d AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n, max(z) AS last, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, '') || substring(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN d USING (doc_id)"""

#: Units of a text, the draws of its id, and its parts in the order of the form.
_MIDDLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM u),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS z,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

#: The others have no SQL: learned stems and hashes of Spark (1, 8), image compression (4), trained models (5), tokenizers (7, 10, 11);
#: runs by comparing all pairs of words (13) would take hours on whole tables.
SQL: dict[str, str] = {"op2_source_mixing": _MIX, "op3_html_text": _HTML, "op6_near_duplicates": _NEAR, "op9_suffix_dedup": _REPEATS, "op12_fill_in_middle": _MIDDLE}
