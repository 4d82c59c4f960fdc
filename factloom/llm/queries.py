"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package, table
from . import decontam, htmlextract, jaccard, langid, linededup, packing, quality, token_counts, urlfilter, warc


def _over(name: str, apply: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return apply(table(spark, sf_dir, name))

    return run


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": _over("documents", packing.pack),
        "op2_language_id": _over("documents", langid.identify),
        "op3_ngram_jaccard_join": _over("documents", jaccard.similar),
        "op4_decontamination": _decontamination,
        "op5_quality_rules": _over("documents", quality.judge),
        "op6_url_filters": _over("pages", urlfilter.filter_urls),
        "op7_html_extraction": _over("pages", htmlextract.extract),
        "op8_line_dedup": _over("documents", lambda d: linededup.drop_boilerplate(d).select("doc_id", "text", "n_lines", "n_dropped")),
        "op9_warc": _over("pages", warc.archived),
        "op10_token_counts": _over("documents", token_counts.token_counts),
    }


_BLANK = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT DISTINCT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
k AS (SELECT x, min(y) m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, least(d.doc_id, coalesce(k.m, d.doc_id))::BIGINT component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.x = d.doc_id
"""

_DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) size, array_to_string(w[i:i + 12], ' ') g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) i FROM dw, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, size, i, item_id FROM grams JOIN win USING (size, g)),
terms AS (SELECT item_id, v, i, unnest(range(0, len(v))) k, unnest(v) term FROM (
  SELECT DISTINCT item_id, i, w[i:i + 12] v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) i FROM bw WHERE len(w) > 0))),
pos AS (SELECT doc_id, unnest(range(0, len(w))) p, unnest(w) term FROM dw),
df AS (SELECT term, count(*) n FROM pos GROUP BY 1),
rare AS (SELECT item_id, v, arg_min(k, n) k, arg_min(term, n) term FROM terms JOIN df USING (term) GROUP BY 1, 2 HAVING count(*) = len(v)),
start AS (SELECT DISTINCT item_id, v, doc_id, p - k + off s FROM rare JOIN pos USING (term) CROSS JOIN (SELECT unnest([-{near}, 0, {near}]) off)),
near AS (
  SELECT item_id, doc_id, s, v FROM (SELECT item_id, doc_id, s, v, unnest(range(0, len(v))) k, unnest(v) term FROM start) JOIN pos USING (doc_id, term)
  WHERE abs(pos.p - s - k) <= {near} GROUP BY ALL HAVING count(DISTINCT k) = len(v)),
close AS (SELECT doc_id, count(DISTINCT item_id) n FROM near GROUP BY 1),
hit AS (SELECT doc_id, count(DISTINCT k) n FROM (SELECT doc_id, unnest(range(i, i + size)) k FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) n, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR item FROM found) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(hit.n, 0)::BIGINT n_hit, coalesce(items.n, 0)::BIGINT n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) contaminated, coalesce(close.n, 0)::BIGINT n_near_items
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN close USING (doc_id)
""".replace("{near}", str(decontam.NEAR))


def _quality_sql() -> str:
    tests = []
    for _, top, bottom, least, most, words in quality.THRESHOLDS:
        bounds = ([f"{top} >= {least} * {bottom}"] if least is not None else []) + ([f"{top} <= {most} * {bottom}"] if most is not None else [])
        tests.append(f"({bottom} = 0 OR n_words < {words} OR ({' AND '.join(bounds)}))")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
l AS (
  SELECT doc_id, count(*) n, count(*) - count(DISTINCT x) dup, count(*) FILTER (upper(x) = x AND lower(x) <> x) loud
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (
  SELECT doc_id, count(*) FILTER (lower(x) IN ({stop})) stop, sum(length(x)) chars
  FROM (SELECT doc_id, unnest(w) x FROM d) GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM d WHERE len(w) > 4)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) after FROM r) GROUP BY 1),
m AS (
  SELECT doc_id, len(w)::BIGINT n_words, coalesce(chars, 0)::BIGINT word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols,
    coalesce(dup, 0)::BIGINT n_dup_lines, coalesce(c.n, 0)::BIGINT n_repeat_words, coalesce(stop, 0)::BIGINT n_stop_words,
    coalesce(l.n, 0)::BIGINT n_lines, coalesce(loud, 0)::BIGINT n_shouted_lines
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {quality.FEWEST} OR 100 * n_repeat_words > {quality.REPEATED} * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} kept, n_stop_words, n_lines, n_shouted_lines
FROM b
"""


def _url_sql() -> str:
    def fit(s: str) -> str:
        host, path = s[: s.find("/")], s[s.find("/") :]
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))
    which = " ".join(f"WHEN {fit(s)} THEN '{s}'" for _, s in rules)
    verdict = " ".join(f"WHEN rule = '{s}' THEN '{v}'" for v, s in rules)
    words = ", ".join(f"'{w}'" for w in urlfilter.BLOCKED)
    listed = f"list_has_any(string_split_regex(host, '[-_.]'), [{words}])"
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END path
  FROM u),
r AS (SELECT *, CASE {which} END rule FROM h)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END verdict FROM r
"""


_LINE_DEDUP = f"""
WITH x AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents),
t AS (SELECT source, count(*) n FROM documents GROUP BY 1),
b AS (
  SELECT source, line FROM (SELECT DISTINCT doc_id, source, trim(line, {_BLANK}) line FROM x) JOIN t USING (source) WHERE line <> ''
  GROUP BY source, line, n HAVING count(*) >= {linededup.LEAST} AND count(*) > {linededup.RATIO} * n),
k AS (
  SELECT doc_id, string_agg(x.line, chr(10) ORDER BY i) FILTER (b.line IS NULL) kept, count(*) n, count(b.line) dropped
  FROM x LEFT JOIN b ON b.source = x.source AND b.line = trim(x.line, {_BLANK}) GROUP BY 1)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text, coalesce(n, 0)::BIGINT n_lines, coalesce(dropped, 0)::BIGINT n_dropped
FROM documents LEFT JOIN k USING (doc_id)
"""

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') html, strlen(coalesce(html, ''))::BIGINT n FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY html) first FROM p)
SELECT page_id, n payload_bytes, sha1(html) payload_digest,
  CASE WHEN n >= {warc.LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN n >= {warc.LEAST} AND page_id <> first THEN first END refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_jaccard_join": _JACCARD,
        "op4_decontamination": _DECONTAMINATION,
        "op5_quality_rules": _quality_sql(),
        "op6_url_filters": _url_sql(),
        "op8_line_dedup": _LINE_DEDUP,
        "op9_warc": _WARC,
    }
