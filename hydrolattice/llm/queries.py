"""Queries of the operators over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import Query, Tables
from . import decontamination, html_extract, license_scan, lm_scoring, merkle_manifest, near_dups, piece_coding, quality_rules, site_quality, source_audit, token_counts, toxicity, url_filters
from .shared import ascii_lower, remainder

QUERIES: dict[str, Query] = {}

_SPACE = r"\x20\x09-\x0D"
_WORD = f"[^{_SPACE}]+"


def _lower(expression: str) -> str:
    return f"translate({expression}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _reach_sql(edges: str) -> str:
    """CTEs that end in ``reach`` (node, component): the smallest node that each end of ``edges`` (a, b) reaches."""
    return f"""both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
walk AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT walk.node, both_ways.b FROM walk JOIN both_ways ON both_ways.a = walk.seen),
reach AS (SELECT node, min(seen) AS component FROM walk GROUP BY 1)"""


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = Query(lambda spark, folder: build(Tables(spark, folder)), sql)
        return build

    return register


@query()
def op1_lm_scoring(t: Tables) -> DataFrame:
    return lm_scoring.score_texts(t.documents)


@query()
def op2_piece_coding(t: Tables) -> DataFrame:
    coded = piece_coding.encode_decode(t.documents, ["doc_id"], public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


URL_RULES = [
    url_filters.Rule("net", "/", "block"), url_filters.Rule("example.net", "/en/", "allow"),
    url_filters.Rule("example.com", "/de/", "block"), url_filters.Rule("org", "/fr/", "allow"),
]


def _fits_sql(host: str, path: str) -> str:
    return " ".join(
        f"WHEN ({host} = '{u.host}' OR ends_with({host}, '.{u.host}')) AND starts_with({path}, '{u.path}') THEN '{u.text}'"
        for u in sorted(URL_RULES, key=lambda u: (-len(u.text), u.verdict != "allow", u.text))
    )


def _address_sql(url: str) -> str:
    host, rest = _lower(f"regexp_extract({url}, '://([^/?#]*)', 1)"), f"regexp_extract({url}, '://[^/?#]*([^#]*)', 1)"
    return f"CASE WHEN contains({url}, '://') THEN {host} || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END END"


_VERDICTS = " ".join(f"WHEN '{u.text}' THEN '{u.verdict}'" for u in URL_RULES)
_LINK = r"""(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)"""
_REFRESH = r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)"""
_HREF, _TO = r"""(?i)\bhref\s*=\s*["'']?([^"''\s>]+)""", r"""(?i)\burl\s*=\s*[''"]?([^"''\s>;]+)"""
URL_SQL = f"""WITH RECURSIVE found AS (SELECT url AS source, unnest([
    trim(regexp_extract(regexp_extract(coalesce(html, ''), '{_LINK}', 1), '{_HREF}', 1)),
    trim(regexp_extract(regexp_extract(coalesce(html, ''), '{_REFRESH}', 1), '{_TO}', 1))]) AS target FROM pages WHERE url IS NOT NULL),
link AS (SELECT source, replace(target, '&amp;', '&') AS t FROM found WHERE target <> ''),
target AS (SELECT source, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(source, '^([^:]*:)', 1) || t
  WHEN starts_with(t, '/') THEN regexp_extract(source, '^([^:]*://[^/?#]*)', 1) || t ELSE regexp_extract(source, '^([^:]*://[^?#]*/)', 1) || t END AS t FROM link),
edge AS (SELECT * FROM (SELECT {_address_sql("source")} AS a, {_address_sql("t")} AS b FROM target) WHERE a <> b),
{_reach_sql("edge")},
ruled AS (SELECT node, component, CASE {_fits_sql("split_part(node, '/', 1)", "regexp_extract(node, '^[^/?#]*([^?#]*)', 1)")} END AS rule FROM reach),
blocked AS (SELECT component FROM ruled GROUP BY 1 HAVING bool_or(rule IN ('net/', 'example.com/de/')) AND NOT coalesce(bool_or(rule IN ('example.net/en/', 'org/fr/')), false)),
page AS (SELECT page_id, {_address_sql("url")} AS spot, coalesce({_lower("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, CASE {_fits_sql("host", "path")} END AS rule FROM page)
SELECT page_id, host, path, rule, coalesce(CASE rule {_VERDICTS} END,
  CASE WHEN spot IN (SELECT node FROM reach WHERE component IN (SELECT component FROM blocked)) THEN 'block' END, 'allow') AS verdict FROM judged"""


@query(URL_SQL)
def op3_url_filters(t: Tables) -> DataFrame:
    return url_filters.judge_urls(t.pages, ["page_id"], URL_RULES, url_filters.page_links(t.pages))


NEAR_SQL = f"""WITH RECURSIVE doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
shingle AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') AS s FROM (
  SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM doc)),
size AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM shingle GROUP BY 1),
pair AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.rid < y.rid GROUP BY 1, 2),
edge AS (SELECT p.doc_id AS a, q.doc_id AS b FROM pair JOIN size p ON p.rid = a JOIN size q ON q.rid = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_reach_sql("edge")}
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(component, doc.doc_id) AS component_id, coalesce(component, doc.doc_id) = doc.doc_id AS kept
FROM doc LEFT JOIN size USING (rid) LEFT JOIN reach ON reach.node = doc.doc_id"""


@query(NEAR_SQL)
def op4_near_dups(t: Tables) -> DataFrame:
    found = near_dups.near_duplicates(t.documents, linking=near_dups.Linking(percent=85))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op5_site_quality(t: Tables) -> DataFrame:
    """Documents have no address: their source stands for the host and their language for the path."""
    found = site_quality.classify(t.documents, t.labels, usable=remainder("doc_id", 5) != 0)
    return found.withColumn("held_out", remainder("doc_id", 5) == 0)


QUALITY_SQL = f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^{_SPACE}]')) AS lines FROM documents),
word AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM doc),
three AS (SELECT rid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM three WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
repeated AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS spot FROM twice) GROUP BY 1),
fact AS (SELECT rid, doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM doc LEFT JOIN repeated USING (rid)),
rule AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM fact),
always AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM rule),
checked AS (SELECT *, failed OR 100 * n_repeat_words > 20 * n_words OR 100 * n_dup_lines > 10 * n_lines AS strictly FROM always),
h AS (SELECT host, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE strictly))::DOUBLE AS k FROM checked GROUP BY 1),
m AS (SELECT sum(n) AS n, count(*) AS g, sum(n * n) AS nn, sum(k * k / n) AS kk, least(greatest(sum(k) / sum(n), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS mean FROM h),
s AS (SELECT mean, (kk - n * mean * mean) / (mean * (1 - mean)) - (g - 1) AS spread, n - nn / n - (g - 1) AS room FROM m),
prior AS (SELECT mean, 1 / least(greatest(CASE WHEN room > 0 THEN spread / room ELSE 0 END, 1e-4::DOUBLE), 0.99::DOUBLE) - 1 AS strength FROM s),
strict AS (SELECT host FROM h, prior WHERE (k + mean * strength) / (n + strength) > 0.3::DOUBLE)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host IN (FROM strict) AS strict_host,
  NOT CASE WHEN host IN (FROM strict) THEN strictly ELSE failed END AS kept FROM checked"""


@query(QUALITY_SQL)
def op6_quality_rules(t: Tables) -> DataFrame:
    judged = quality_rules.judge(t.documents, ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "strict_host")


@query()
def op7_decontamination(t: Tables) -> DataFrame:
    return decontamination.leaks(t.documents, t.benchmark, ["doc_id"])


@query()
def op8_toxicity(t: Tables) -> DataFrame:
    model = toxicity.learn(t.documents, t.labels, usable=~toxicity.held_out())
    docs = t.documents.withColumn("held_out", toxicity.held_out())
    return toxicity.score(docs, ["doc_id", "held_out"], model)


@query()
def op9_html_extract(t: Tables) -> DataFrame:
    return html_extract.main_text(t.pages, ["page_id", "url"], html_extract.learn(t.pages))


@query()
def op10_token_counts(t: Tables) -> DataFrame:
    return token_counts.token_counts(t.documents, ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))


def _crc_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text."""
    step = "xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, bit: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


MERKLE_HEIGHT = 7  # levels that the SQL writes out: 2,097,152 leaves a language, 512 languages


def _tampered() -> Column:
    """The digest of a row whose text was put in lower case, where 3 divides the crc32 of its key."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle_manifest.row_digest(text=ascii_lower(F.col("text"))))


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(
        f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}), ':', {v}) END" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    ) + "))"


def _tree_sql(name: str, height: int) -> str:
    """CTEs of the levels above ``<name>0`` (g, p, n, h), of the children of each run, and ``<name>end`` (g, h)."""
    parts = []
    for k in range(height):
        parts.append(f"{name}run{k} AS (SELECT g, p // 8 AS q, any_value(n) AS n, list(h ORDER BY p) AS c FROM {name}{k} WHERE n > 1 GROUP BY 1, 2)")
        parts.append(f"{name}{k + 1} AS (SELECT g, q AS p, (n + 7) // 8 AS n, sha256(array_to_string(c, '')) AS h FROM {name}run{k})")
    ends = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(height + 1))
    return ",\n".join([*parts, f"{name}end AS ({ends})"])


def _fold_sql(source: str, name: str, place: str, height: int, out: str) -> str:
    """CTEs that fold ``f`` and gather the siblings ``s`` of ``source`` along the runs of a tree, up to ``<out><height>``."""
    parts, last = [], source
    for k in range(height):
        d = f"(({place} // {8**k}) % 8)"
        left, right = f"array_to_string(c[1:{d}], '')", f"array_to_string(c[{d} + 2:], '')"
        parts.append(f"""{out}{k + 1} AS (SELECT x.* EXCLUDE (f, s), CASE WHEN c IS NULL THEN f ELSE sha256(concat({left}, f, {right})) END AS f,
  CASE WHEN c IS NULL THEN s ELSE concat(s, {left}, {right}) END AS s FROM {last} x LEFT JOIN {name}run{k} r ON r.q = {place} // {8 ** (k + 1)} AND r.g = {'x.g' if name == 'leaf' else '0'})""")
        last = f"{out}{k + 1}"
    return ",\n".join(parts)


MERKLE_SQL = f"""WITH doc AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_lower("text"))} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM doc),
leaf0 AS (SELECT g, p, n, leaf AS h FROM placed),
{_tree_sql("leaf", MERKLE_HEIGHT)},
top0 AS (SELECT 0 AS g, g AS p, count(*) OVER () AS n, h FROM leafend),
{_tree_sql("top", 3)},
a0 AS (SELECT *, coalesce(changed, leaf) AS f, '' AS s FROM placed),
{_fold_sql("a0", "leaf", "p", MERKLE_HEIGHT, "a")},
{_fold_sql(f"a{MERKLE_HEIGHT}", "top", "x.g", 3, "b")}
SELECT doc_id, leaf, e.h AS subroot, (SELECT h FROM topend) AS root, sha256(s) AS proof_sha256, f AS folded_root, f = (SELECT h FROM topend) AS verified
FROM b3 JOIN leafend e ON e.g = b3.g"""


@query(MERKLE_SQL)
def op11_merkle_manifest(t: Tables) -> DataFrame:
    manifest = merkle_manifest.build(t.documents, carried={"changed": _tampered()})
    return merkle_manifest.prove(manifest).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle_manifest.proof_digest().alias("proof_sha256"),
        merkle_manifest.folded(F.coalesce("changed", "leaf")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


AUDIT_SQL = f"""WITH doc AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT rid, lang, source, unnest(regexp_extract_all({_lower("text")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM doc),
kept AS (SELECT lang, t FROM word GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
c AS (SELECT lang, source, t, count(*) AS c FROM word JOIN kept USING (lang, t) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM doc) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang)),
l AS (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY 1),
p AS (SELECT g.lang, g.source, k.t, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (n + 5 * v)::HUGEINT AS p
  FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = k.t),
q AS (SELECT lang, t, 1 + 1000000000::HUGEINT * (sum(c) + 5)::HUGEINT // (any_value(l.n) + 5 * any_value(l.v))::HUGEINT AS q FROM c JOIN l USING (lang) GROUP BY 1, 2),
d AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query(AUDIT_SQL)
def op12_source_audit(t: Tables) -> DataFrame:
    return source_audit.audit(t.documents)


_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    text = lambda value: "'" + value.replace("'", "''") + "'"
    joining = license_scan.Joining()
    templates = ", ".join(f"({i}, {text(t.label)}, {text(t.text)})" for i, t in enumerate(license_scan.TEMPLATES))
    phrases = ", ".join(f"({text(p.text)}, {text(p.label)})" for p in license_scan.PHRASES)
    share = joining.threshold
    return f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '{_PLAIN}') AS w FROM documents),
phrase AS (SELECT string_split(col0, ' ') AS p, col1 AS label FROM (VALUES {phrases})),
place AS (SELECT rid, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS spot FROM doc, phrase WHERE list_contains(w, p[1])),
base AS (SELECT rid, count(*) AS n, min(spot) AS low, max(spot) AS high, list(DISTINCT label) AS labels FROM place GROUP BY 1),
template AS (SELECT col0 AS tid, col1 AS label, list_distinct(regexp_extract_all({_lower("col2")}, '{_PLAIN}')) AS t FROM (VALUES {templates})),
block AS (SELECT rid, list_distinct(w[s + 1 : s + {joining.block_words}]) AS b FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - {joining.block_words - joining.step}, 1), {joining.step})) AS s FROM doc)),
pair AS (SELECT rid, label, len(list_intersect(t, b)) AS c, len(t) AS n FROM block, template),
hit AS (SELECT rid, list(DISTINCT label) AS labels, max(c / n::DOUBLE) AS most FROM pair WHERE {share.denominator} * c >= {share.numerator} * n GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, low AS first_word, high AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, hit.labels))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score FROM doc LEFT JOIN base USING (rid) LEFT JOIN hit USING (rid)"""


@query(_license_sql())
def op13_license_scan(t: Tables) -> DataFrame:
    return license_scan.scan(t.documents, ["doc_id"])
