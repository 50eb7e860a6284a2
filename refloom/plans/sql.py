"""The registered queries' rows in SQL, over the same tables. Written apart from the plans, with RE2 patterns."""

from __future__ import annotations

from ..sources.synth import LONG_NAME, NAMES

_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
TOK = r"(?:\d{4}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)"
HAN = "一-鿿"
Y = r"(?:[12]\d{3}|n\.?d\.?|no\s*date|in\s*press|印刷中|未刊)"


def nm(e: str) -> str:
    return f"{_NAMES}[(({e}) % 25 + 1)::INT]"


BODY = f"""
body AS (
  SELECT doc_id, para_idx, CASE k
    WHEN 0 THEN 'Prior work (' || x || ' et al., ' || y || ') shows an effect.'
    WHEN 1 THEN x || ' (' || y || ') reports an effect.'
    WHEN 2 THEN 'No source is named here, p < 0.05 (see below).'
    WHEN 3 THEN 'Two studies (' || x || ', ' || y || '; ' || z || ', ' || y || 'a, p. 12) agree.'
    WHEN 4 THEN x || ' and ' || z || ' (' || y || ') differ from (' || z || ', n.d.).'
    WHEN 5 THEN '李明（' || y || '）指出此點。'
    WHEN 6 THEN 'As {LONG_NAME} (in press) and others show, this holds.'
    WHEN 7 THEN 'Work by ' || x || ', ' || w || ' and ' || z || ' (' || y || 'a) agrees.'
    ELSE 'More is told elsewhere (the tables of ' || x || ' in ' || y || ' and their notes).' END AS text
  FROM (SELECT o_custkey AS doc_id, o_orderkey AS para_idx, o_orderkey % 9 AS k, {nm("o_custkey * 3 + 1")} AS w, {nm("o_custkey * 7 + o_orderkey")} AS x, {nm("o_custkey * 5 + o_orderkey")} AS z, year(o_orderdate)::VARCHAR AS y FROM orders)
)"""
REFS = f"""
refs AS (
  SELECT doc_id, pos, min(raw) AS raw FROM (
    SELECT doc_id, pos, CASE WHEN k <= 3 THEN x || ', A. (' || y || '). ' || tail WHEN k = 4 THEN x || ', A. (n.d.). ' || tail
      WHEN k = 5 THEN x || ', A., & ' || z || ', B. (' || y || 'a). ' || tail WHEN k = 6 THEN '李明（' || y || '）。' || tail WHEN k = 7 THEN x || ', A. Working notes. ' || tail
      WHEN k = 8 THEN '{LONG_NAME}, A. (in press). ' || tail ELSE '王小明、李華（' || y || '）。' || tail END AS raw
    FROM (SELECT o_custkey AS doc_id, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 10 + l_suppkey % 10 AS pos, (l_orderkey + l_linenumber) % 10 AS k,
        {nm("o_custkey * 7 + o_orderkey + l_linenumber - 1")} AS x, {nm("l_suppkey")} AS z, year(l_shipdate)::VARCHAR AS y, p_name || '. Journal ' || l_suppkey || '.' AS tail
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
  ) GROUP BY doc_id, pos
)"""
LINES = f"""
lines AS (
  SELECT o_custkey AS doc_id, o_orderkey AS line_idx, CASE o_orderkey % 10
    WHEN 0 THEN '12' WHEN 1 THEN 'This content downloaded from 10.0.0.1' WHEN 2 THEN 'Journal Of Finance Studies' WHEN 3 THEN 'Appendix B tables' WHEN 4 THEN 'Table IV results'
    WHEN 5 THEN 'Technical Manuals, Standards and Reports' WHEN 6 THEN {nm("o_orderkey")} || ', A. (' || year(o_orderdate) || '). Study ' || o_orderkey || '.'
    WHEN 7 THEN '45 running head of the journal' WHEN 8 THEN {nm("o_orderkey")} || ' and others in ' || year(o_orderdate) ELSE 'Figure 3 shows p = 0.' || o_orderkey END AS text FROM orders
)"""
PARAS = (
    BODY
    + ","
    + REFS
    + """,
paras AS (
  SELECT *, (1 + floor(para_idx / 10))::INT AS page FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, o) - 1 AS para_idx, text FROM (
      SELECT doc_id, 0 AS s, para_idx AS o, text FROM body
      UNION ALL SELECT DISTINCT doc_id, 1, 0, CASE doc_id % 3 WHEN 0 THEN 'References' WHEN 1 THEN 'R e f e r e n c e s' ELSE 'List of references' END FROM body
      UNION ALL SELECT doc_id, 2, pos, raw FROM refs
      UNION ALL SELECT DISTINCT doc_id, 3, 0, 'Appendix A' FROM body WHERE doc_id % 2 = 0
      UNION ALL SELECT DISTINCT doc_id, 3, 1, 'Other, B. (1999). Not cited.' FROM body WHERE doc_id % 2 = 0))
), starts AS (
  SELECT doc_id, (arg_min(para_idx, kind::BIGINT * 1000000000 + para_idx)) AS start FROM (
    SELECT doc_id, para_idx, CASE WHEN t IN ('references', 'reference', 'bibliography') THEN 1 WHEN replace(t, ' ', '') IN ('references', 'reference', 'bibliography') THEN 2
      WHEN length(t) <= 40 AND (t LIKE '%reference%' OR t LIKE '%bibliography%') THEN 3 END AS kind FROM (SELECT *, lower(text) AS t FROM paras)) WHERE kind IS NOT NULL GROUP BY doc_id
)"""
)
CITES = (
    BODY
    + rf""",
found AS (
  SELECT doc_id, para_idx, raw, 1 AS o, 'parenthetical' AS style FROM (
    SELECT doc_id, para_idx, trim(regexp_replace(translate(unnest(string_split_regex(b, '[;；]')), '（），；。－–—', '(),;.---'), '\s+', ' ', 'g')) AS raw
    FROM (SELECT doc_id, para_idx, unnest(regexp_extract_all(text, '[(（]([^()（）]{{1,240}})[)）]', 1)) AS b FROM body))
  WHERE regexp_matches(raw, '(?i)^.+?[,，]\s*{TOK}(?:\s*[,，]\s*(?:p|pp)\.?\s*\d+(?:\s*[-–—]\s*\d+)?)?\s*$')
  UNION ALL SELECT doc_id, para_idx, trim(p[1]) || ' (' || trim(p[2]) || ')', 2, 'narrative' FROM (SELECT doc_id, para_idx, unnest(list_zip(
      regexp_extract_all(regexp_replace(text, '[À-ÿ]', '_', 'g'), '(?i)\b([A-Z][A-Za-z''’\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z''’\-]+|\s+et\s+al\.)?)\s*[(（]\s*({TOK})\s*[)）]', 1),
      regexp_extract_all(regexp_replace(text, '[À-ÿ]', '_', 'g'), '(?i)\b([A-Z][A-Za-z''’\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z''’\-]+|\s+et\s+al\.)?)\s*[(（]\s*({TOK})\s*[)）]', 2))) AS p FROM body)
  UNION ALL SELECT doc_id, para_idx, p[1] || ' (' || p[2] || ')', 3, 'narrative_zh' FROM (SELECT doc_id, para_idx, unnest(list_zip(
      regexp_extract_all(text, '([{HAN}]{{1,10}})\s*[(（]\s*(\d{{4}})\s*[)）]', 1), regexp_extract_all(text, '([{HAN}]{{1,10}})\s*[(（]\s*(\d{{4}})\s*[)）]', 2))) AS p FROM body)
), once AS (SELECT doc_id, para_idx, min(raw) AS raw, min(o) AS o, arg_min(style, o) AS style FROM found GROUP BY doc_id, para_idx, lower(raw)),
parsed AS (
  SELECT *, regexp_extract(tok, '((?:19|20)\d{{2}})', 1) AS yr, regexp_extract(tok, '\d{{4}}([a-z])', 1) AS suf,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(author, '(?i)\bet\s+al\.\s*$', ''), '(?i)\s+(?:and|&)\s+.*$', ''), '[,，].*$', ''), '[^A-Za-z0-9''’\-\s{HAN}]', '', 'g')) AS surname
  FROM (SELECT *, lower(coalesce(list_extract(regexp_extract_all(raw, '(?i)(?:(?:19|20)\d{{2}}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)'), -1), '')) AS tok,
    coalesce(nullif(trim(regexp_extract(raw, '(?i)^\s*(.+?)\s*[(（]\s*{TOK}\s*[)）]\s*$', 1)), ''), nullif(trim(regexp_extract(raw, '(?i)^\s*(.+?)\s*[,，]\s*{TOK}\s*$', 1)), ''),
      trim(regexp_extract(raw, '(?i)^(.*?)(?:(?:19|20)\d{{2}}|n\s*\.\s*d)', 1), ' ,，(')) AS author FROM once)
), ckeys AS (
  SELECT *, CASE WHEN pk <> '' THEN pk || '_' || CASE WHEN yr <> '' THEN yr || suf WHEN tok LIKE 'n%' THEN 'nd' WHEN tok LIKE 'in%' THEN 'inpress' ELSE 'missing' END END AS key
  FROM (SELECT *, regexp_replace(lower(surname), '[^a-z0-9{HAN}]+', '', 'g') AS pk FROM parsed)
)"""
)
RKEYS = rf"""
rp AS (
  SELECT *, regexp_extract(tok, '((?:19|20)\d{{2}})', 1) AS yr, regexp_extract(tok, '\d{{4}}([a-z])', 1) AS suf,
    CASE WHEN regexp_matches(seen, '(?i)\(\s*(?:(?:19|20)\d{{2}}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)\s*\)') THEN trim(regexp_extract(raw, '(?i)^(.*?)[(（]\s*(?:(?:19|20)\d{{2}}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)\s*[)）]', 1)) ELSE trim(regexp_extract(raw, '^(.*?)[.。]', 1)) END AS authors_raw
  FROM (SELECT *, lower(regexp_extract(seen, '(?i)\(\s*((?:19|20)\d{{2}}[a-z]?|n\s*\.\s*d\s*\.?|in\s+press)\s*\)', 1)) AS tok FROM (SELECT *, translate(raw, '（）．。，', '()..,') AS seen FROM refs))
), rs AS (
  SELECT *, CASE WHEN han <> '' THEN han WHEN authors_raw LIKE '%,%' THEN trim(split_part(authors_raw, ',', 1)) ELSE left(authors_raw, 40) END AS surname, CASE WHEN han <> '' OR authors_raw LIKE '%,%' THEN 'high' ELSE 'low' END AS confidence
  FROM (SELECT *, regexp_extract(raw, '^\s*([{HAN}]{{1,20}})\s*[(（]\s*(?:19|20)\d{{2}}[a-z]?\s*[)）]', 1) AS han FROM rp)
), rkeys AS (
  SELECT *, regexp_replace(lower(surname), '[^a-z0-9{HAN}]+', '', 'g') || '_' || CASE WHEN yr <> '' THEN yr || suf WHEN tok LIKE 'n%' THEN 'nd' WHEN tok LIKE 'in%' THEN 'inpress' ELSE 'missing' END AS key FROM rs
)"""
FOUR = (
    CITES
    + ","
    + REFS
    + ","
    + RKEYS
    + """,
four AS (
  SELECT coalesce(c.doc_id, r.doc_id) AS doc_id, coalesce(c.key, r.key) AS key, CASE WHEN r.n IS NULL THEN 'missing' WHEN c.key IS NULL THEN 'extra' WHEN r.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, coalesce(r.n, 0) AS candidate_count, r.c
  FROM (SELECT DISTINCT doc_id, key FROM ckeys WHERE key IS NOT NULL) c FULL OUTER JOIN (SELECT doc_id, key, count(*) AS n, string_agg(raw, ' | ' ORDER BY pos) AS c FROM rkeys GROUP BY doc_id, key) r ON c.doc_id = r.doc_id AND c.key = r.key
)"""
)
#: The document engine's parse of references with a year in parentheses; the form without year is dropped.
def core(name: str, items: str) -> str:
    return rf"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS item_idx FROM (
    SELECT doc_id, pos, raw, CASE WHEN latin THEN 'en' ELSE 'zh' END AS lang, CASE WHEN latin THEN trim(regexp_extract(pre, '^([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''\-\s.]*?),', 1)) ELSE regexp_extract(pre, '[{HAN}]{{1,10}}') END AS author1,
      CASE WHEN latin THEN nullif(trim(regexp_extract(pre, '(?:&|and)\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''\-\s.]*?)(?:,|$)', 1)), '')
        WHEN len(regexp_extract_all(pre, '[{HAN}]{{1,10}}')) > 1 THEN list_extract(regexp_extract_all(pre, '[{HAN}]{{1,10}}'), -1) END AS author2,
      CASE WHEN tok LIKE 'n%' THEN 'n.d.' ELSE tok END AS year
    FROM (SELECT *, regexp_matches(pre, '[A-Za-zÀ-ÿ]') AS latin FROM (SELECT doc_id, pos, t AS raw, regexp_extract(t, '\(({Y}[a-z]?)\)', 1) AS tok, trim(regexp_extract(t, '^(.*?)\({Y}[a-z]?\)', 1)) AS pre
      FROM (SELECT doc_id, pos, translate(raw, '（）。', '().') AS t FROM {items})) WHERE tok <> '')
  )
)"""


CORE = core("core", "refs")
_NAME = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''\-\s]*?(?:,\s*[A-Za-zÀ-ÿ]\.?)?"
_TOLD = rf"({_NAME})(?:(?:\s*,\s*{_NAME})*\s*(?:&|and|,\s*&|,\s*and)\s*({_NAME})|\s+et\s+al\.?)?\s*\(\s*({Y}[- ]?[a-zA-Z]?)\s*\)"
_LEAD = "(?i)^(?:as |see |in |by |cf |and )"


def found_in(name: str, paras: str, known: str | None) -> str:
    """Citations of paragraphs (doc_id, para_idx, text), told, in parentheses, and by known references."""
    took = lambda k: f"regexp_extract_all(t, '{_TOLD}', {k})"
    by_known = f"""
    UNION ALL SELECT p.doc_id, p.para_idx, t, 3, 0, r.lang, r.author1, NULL, r.year, p.part FROM (SELECT doc_id, para_idx, t, trim(unnest(regexp_extract_all(t, '\\((.+?)\\)', 1))) AS part FROM {name}_t WHERE t LIKE '%(the tables of%') p
      JOIN {known} r ON r.doc_id = p.doc_id AND contains(p.part, r.author1) AND contains(p.part, r.year)""" if known else ""
    return rf"""
{name}_t AS (SELECT doc_id, para_idx, translate(text, '（）。', '().') AS t FROM {paras}),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY kind, n) - 1 AS seq FROM (
  SELECT DISTINCT ON (doc_id, para_idx, lower(replace(author1, ' ', '')), year) * FROM (
    SELECT doc_id, para_idx, t, 0 AS kind, n, 'en' AS lang, trim(regexp_replace(trim(m[2]), '{_LEAD}', '')) AS author1, CASE WHEN regexp_matches(m[1], '(?i)\bet\s+al\.?') THEN NULL ELSE nullif(trim(m[3]), '') END AS author2, m[4] AS year, m[1] AS raw
    FROM (SELECT doc_id, para_idx, t, generate_subscripts(l, 1) AS n, unnest(l) AS m FROM (SELECT doc_id, para_idx, t, list_zip({took(0)}, {took(1)}, {took(2)}, {took(3)}) AS l FROM {name}_t))
    UNION ALL SELECT doc_id, para_idx, t, 1, 1, 'zh', regexp_extract(t, '([{HAN}]{{2,4}})\s*\(({Y}[a-z]?)\)', 1), NULL, regexp_extract(t, '([{HAN}]{{2,4}})\s*\(({Y}[a-z]?)\)', 2), regexp_extract(t, '([{HAN}]{{2,4}})\s*\(({Y}[a-z]?)\)') FROM {name}_t WHERE regexp_matches(t, '[{HAN}]\s*\({Y}')
    UNION ALL SELECT doc_id, para_idx, t, 2, n, 'en', CASE WHEN who LIKE '% et al%' THEN split_part(who, ' ', 1) ELSE who END, NULL, year, part FROM (
      SELECT doc_id, para_idx, t, part, n, trim(regexp_extract(part, '^(.+?)[,，\s]+({Y}[- ]?[a-zA-Z]?)$', 1)) AS who, regexp_extract(part, '^(.+?)[,，\s]+({Y}[- ]?[a-zA-Z]?)$', 2) AS year FROM (
        SELECT doc_id, para_idx, t, generate_subscripts(l, 1) AS n, trim(unnest(l)) AS part FROM (SELECT doc_id, para_idx, t, flatten(list_transform(regexp_extract_all(t, '\((.+?)\)', 1), lambda g: string_split(g, ';'))) AS l FROM {name}_t))) WHERE year <> ''{by_known}
  ) ORDER BY kind, n))"""


ACITES = "numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS para_idx, text FROM body)," + found_in("acites", "numbered", "core")
A = BODY + "," + REFS + "," + CORE + "," + ACITES
EXACT = "EXISTS (SELECT 1 FROM core r WHERE r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year)"
RAWT = ", rawtext AS (SELECT doc_id, lower(string_agg(translate(raw, '（）。', '().'), chr(10))) AS t FROM refs GROUP BY doc_id)"
IN_RAW = "EXISTS (SELECT 1 FROM rawtext t WHERE t.doc_id = c.doc_id AND contains(t.t, lower(c.author1)) AND contains(t.t, c.year))"
#: The whole analysis: lines in full-width parentheses begin no item, so they go to the one before.
ANALYSIS = (
    PARAS
    + """,
sides AS (SELECT p.doc_id, p.para_idx, p.text, p.page, p.para_idx < s.start AS body, s.start FROM paras p JOIN starts s USING (doc_id)),
bodies AS (SELECT * FROM sides WHERE body),
listed AS (SELECT *, sum((text NOT LIKE '%（%' OR para_idx = start + 1)::INT) OVER (PARTITION BY doc_id ORDER BY para_idx) AS g FROM sides WHERE NOT body AND para_idx > start AND text NOT IN ('Appendix A', 'Other, B. (1999). Not cited.')),
ditems AS (SELECT doc_id, g AS pos, string_agg(text, ' ' ORDER BY para_idx) AS raw, arg_min(page, para_idx) AS page FROM listed GROUP BY doc_id, g),"""
    + core("dcore0", "ditems")
    + ", dcore AS (SELECT c.*, i.page FROM dcore0 c JOIN ditems i USING (doc_id, pos)),"
    + found_in("dcites", "bodies", "dcore")
    + """,
dcited AS (SELECT c.*, b.page, c.doc_id || ':' || c.para_idx || ':' || c.seq AS cite_id FROM dcites c JOIN bodies b USING (doc_id, para_idx)),
dtext AS (SELECT doc_id, lower(string_agg(translate(text, '（）。', '().'), chr(10))) AS rt FROM sides WHERE NOT body GROUP BY doc_id),
dex AS (SELECT cite_id, min(item_idx) AS ref_idx FROM dcited c JOIN dcore r ON r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year GROUP BY cite_id),
dcx AS (SELECT cite_id, min(item_idx) AS ref_idx FROM dcited c JOIN dcore r ON r.doc_id = c.doc_id AND r.lang = c.lang AND r.year = c.year AND contains(strip_accents(lower(c.t)), strip_accents(lower(r.author1))) AND (contains(r.raw, c.author1) OR lower(c.author2) = lower(r.author2)) GROUP BY cite_id),
dstage AS (
  SELECT c.*, CASE WHEN dex.cite_id IS NOT NULL THEN 'Exact' WHEN contains(rt, lower(c.author1)) AND contains(rt, c.year) THEN 'Found in Raw Text (Parser Missed)' WHEN dcx.cite_id IS NOT NULL THEN 'Context Recovery' ELSE 'Missing' END AS match_type, dex.ref_idx AS e, dcx.ref_idx AS x
  FROM dcited c LEFT JOIN dtext USING (doc_id) LEFT JOIN dex USING (cite_id) LEFT JOIN dcx USING (cite_id)
), dused AS (
  SELECT DISTINCT r.doc_id, r.item_idx FROM dcore r JOIN dcited c ON r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year
  UNION SELECT doc_id, x FROM dstage WHERE match_type = 'Context Recovery'
)"""
)
DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
W = "WITH "

_FOLD_SPACE = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '{_FOLD_SPACE}+', ' ', 'g'))"


_CORE_TEXT = squeeze(r"translate(regexp_replace(text, '[\x{200B}\x{200E}\x{200F}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '（）＆’‘‐‑–—，‚¸､。', '()&''''----,,,,.')")
_SAFE_LINE = squeeze("x")
for _p, _r in (("\\s+([,.;:])", "\\1"), ("\\(\\s+", "("), ("\\s+\\)", ")"), ("([,.;:])\\s+", "\\1 ")):
    _SAFE_LINE = f"regexp_replace({_SAFE_LINE}, '{_p}', '{_r}', 'g')"
_SAFE_LINE = squeeze(_SAFE_LINE)
_SAFE = f"list_transform(string_split(regexp_replace(translate(text, '（），。：；－–—', '(),.:;---'), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {_SAFE_LINE})"
_REFN = squeeze("text")
for _p, _r in (("\\s+,", ","), (",\\s*", ", "), ("\\s+\\.", "."), ("(\\d)\\s*[-–—]\\s*(\\d)", "\\1–\\2"), ("(\\d)\\s*[-–—]\\s*(\\d)", "\\1–\\2")):
    _REFN = f"regexp_replace({_REFN}, '{_p}', '{_r}', 'g')"
_REFN = squeeze(_REFN)
T = "text"

SQL: dict[str, str] = {
    "match_four_way": W + FOUR + " SELECT doc_id, key, status, CASE WHEN status = 'ambiguous' THEN 'multiple_references_same_key' END AS reason, candidate_count, CASE WHEN status = 'ambiguous' THEN c END AS candidates FROM four",
    "match_counts_per_doc": W + FOUR + " SELECT doc_id, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM four GROUP BY doc_id",
    "citations_extract_all": W + CITES + " SELECT doc_id, para_idx, raw, style FROM once",
    "citations_by_style": W + CITES + " SELECT style, count(*) AS n, count(DISTINCT key) AS keys FROM ckeys GROUP BY style",
    "citation_keys_distinct": W + CITES + " SELECT key, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ckeys WHERE key IS NOT NULL GROUP BY key",
    "citation_parse": W + CITES + " SELECT doc_id, para_idx, raw, surname, nullif(yr, '') AS year, nullif(suf, '') AS year_suffix, CASE WHEN yr <> '' THEN 'year' WHEN tok LIKE 'n%' THEN 'n.d.' WHEN tok LIKE 'in%' THEN 'in_press' ELSE 'missing' END AS year_token_type FROM ckeys",
    "citation_year_token": W + CITES + " SELECT CASE WHEN yr <> '' THEN 'year' WHEN tok LIKE 'n%' THEN 'n.d.' WHEN tok LIKE 'in%' THEN 'in_press' ELSE 'missing' END AS year_token_type, nullif(yr, '') AS year, count(*) AS n FROM ckeys GROUP BY 1, 2",
    "citation_surname": W + CITES + " SELECT surname, count(*) AS n FROM ckeys GROUP BY surname",
    "reference_parse": W + REFS + "," + RKEYS + " SELECT doc_id, pos, authors_raw, surname, confidence, nullif(yr, '') AS year, nullif(suf, '') AS year_suffix, CASE WHEN yr <> '' THEN 'year' WHEN tok LIKE 'n%' THEN 'n.d.' WHEN tok LIKE 'in%' THEN 'in_press' ELSE 'missing' END AS year_token_type FROM rkeys",
    "reference_year_token": W + REFS + "," + RKEYS + " SELECT CASE WHEN yr <> '' THEN 'year' WHEN tok LIKE 'n%' THEN 'n.d.' WHEN tok LIKE 'in%' THEN 'in_press' ELSE 'missing' END AS year_token_type, count(*) AS n FROM rkeys GROUP BY 1",
    "reference_surname_confidence": W + REFS + "," + RKEYS + " SELECT surname, confidence, count(*) AS n FROM rkeys GROUP BY ALL",
    "reference_key": W + REFS + "," + RKEYS + " SELECT doc_id, pos, key FROM rkeys",
    "ambiguous_reference_groups": W + REFS + "," + RKEYS + " SELECT doc_id, key, count(*) AS n FROM rkeys GROUP BY doc_id, key HAVING count(*) > 1",
    "core_reference_parse": W + REFS + "," + CORE + " SELECT doc_id, pos, item_idx, lang, author1, author2, year, raw FROM core",
    "core_reference_key": W + REFS + "," + CORE + " SELECT lang, strip_accents(lower(author1)) AS k_author, year AS k_year, count(*) AS n FROM core GROUP BY ALL",
    "core_citation_key": W + A + " SELECT doc_id, para_idx, lang, strip_accents(lower(author1)) AS k_author, year AS k_year FROM acites",
    "exact_match": W + A + " SELECT doc_id, para_idx, raw, arg_min(ref, item_idx) AS ref_raw, min(item_idx) AS ref_idx FROM (SELECT c.doc_id, c.para_idx, c.seq, c.raw, r.raw AS ref, r.item_idx FROM acites c JOIN core r ON r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year) GROUP BY doc_id, para_idx, seq, raw",
    "cited_references": W + A + " SELECT DISTINCT r.doc_id, r.item_idx FROM core r JOIN acites c ON r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year",
    "raw_text_match": W + A + RAWT + f" SELECT doc_id, para_idx, raw, author1, year FROM acites c WHERE NOT {EXACT} AND {IN_RAW}",
    "missing_citations": W + A + RAWT + f" SELECT doc_id, para_idx, raw, author1, year FROM acites c WHERE NOT {EXACT} AND NOT {IN_RAW}",
    "uncited_references": W + A + " SELECT doc_id, item_idx, lang, author1, year, raw FROM core r WHERE NOT EXISTS (SELECT 1 FROM acites c WHERE r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year)",
    "analysis_summary": W + A + " SELECT d.doc_id, (SELECT count(*) FROM body b WHERE b.doc_id = d.doc_id) AS body_paragraphs, (SELECT count(*) FROM core r WHERE r.doc_id = d.doc_id) AS reference_items, (SELECT count(*) FROM acites c WHERE c.doc_id = d.doc_id) AS citations, "
    + f"(SELECT count(*) FROM acites c WHERE c.doc_id = d.doc_id AND {EXACT}) AS matched FROM (SELECT DISTINCT doc_id FROM body) d",
    "citation_dedupe": W + A + " SELECT doc_id, para_idx, lower(author1) AS author, year, count(*) AS n FROM (SELECT DISTINCT doc_id, para_idx, replace(lower(author1), ' ', '') AS author1, year FROM acites) GROUP BY ALL",
    "reverse_search": W + A + " SELECT doc_id, para_idx, lang, author1, year, raw FROM acites WHERE kind = 3",
    "citation_spans": W + PARAS + "," + "sides AS (SELECT p.* FROM paras p JOIN starts s ON p.doc_id = s.doc_id AND p.para_idx < s.start)," + found_in("spans", "sides", None) + " SELECT s.doc_id, s.para_idx, p.page, lang, author1, author2, year, raw, seq, '...' || CASE WHEN length(t) < 50 THEN t ELSE NULL END || '...' AS context FROM spans s JOIN sides p USING (doc_id, para_idx)",
    "document_summary": W + ANALYSIS + " SELECT d.doc_id, (SELECT count(*) FROM bodies b WHERE b.doc_id = d.doc_id) AS body_paragraphs, (SELECT count(*) FROM dcore r WHERE r.doc_id = d.doc_id) AS reference_items, (SELECT count(*) FROM dstage c WHERE c.doc_id = d.doc_id) AS citations, (SELECT count(*) FROM dstage c WHERE c.doc_id = d.doc_id AND match_type <> 'Missing') AS matched, (SELECT count(*) FROM dstage c WHERE c.doc_id = d.doc_id AND match_type = 'Missing') AS missing, (SELECT count(*) FROM dcore r LEFT JOIN dused u USING (doc_id, item_idx) WHERE r.doc_id = d.doc_id AND u.doc_id IS NULL) AS uncited FROM (SELECT DISTINCT doc_id FROM sides) d",
    "document_matched": W + ANALYSIS + " SELECT c.doc_id, c.raw AS citation_raw, c.lang, c.author1, c.year, c.para_idx, c.page, match_type, CASE WHEN r.raw IS NOT NULL THEN r.raw ELSE '(Located in Reference Section text)' END AS ref_raw, coalesce(r.page, 0)::INT AS ref_page FROM dstage c LEFT JOIN dcore r ON r.doc_id = c.doc_id AND r.item_idx = CASE match_type WHEN 'Exact' THEN e WHEN 'Context Recovery' THEN x END WHERE match_type <> 'Missing'",
    "document_missing": W + ANALYSIS + " SELECT doc_id, raw AS citation_raw, lang, author1, year, para_idx, page FROM dstage WHERE match_type = 'Missing'",
    "document_uncited": W + ANALYSIS + " SELECT r.doc_id, r.item_idx, r.lang, r.author1, r.year, r.raw, r.page FROM dcore r LEFT JOIN dused u USING (doc_id, item_idx) WHERE u.doc_id IS NULL",
    "override_resolution": W + REFS + "," + CORE + ", o AS (SELECT doc_id, count(*) AS n, count(*) FILTER (raw NOT LIKE '%Working notes%') AS parsed FROM refs WHERE doc_id % 3 = 0 AND pos % 5 = 0 GROUP BY doc_id), a AS (SELECT doc_id, count(*) AS auto FROM core GROUP BY doc_id)"
    + " SELECT coalesce(a.doc_id, o.doc_id) AS doc_id, CASE WHEN coalesce(parsed, 0) > 0 THEN 'user_override' ELSE 'auto_extracted' END AS reference_source, CASE WHEN coalesce(parsed, 0) > 0 THEN parsed ELSE coalesce(auto, 0) END AS reference_item_count, coalesce(n, 0) AS override_items_count, coalesce(n, 0) - coalesce(parsed, 0) AS override_parse_failed_count, CASE WHEN coalesce(n, 0) > 0 AND parsed = 0 THEN 'fallback' WHEN parsed > 0 AND parsed < n THEN 'partial' END AS warning FROM a FULL OUTER JOIN o ON a.doc_id = o.doc_id",
    "norm_core": f"SELECT doc_id, sha256({_CORE_TEXT}) AS h, length({_CORE_TEXT}) AS n FROM ({DOCS})",
    "norm_safe": f"SELECT doc_id, sha256(array_to_string(list_filter(l, lambda x, i: x <> '' OR i = 1 OR l[i - 1] <> ''), chr(10))) AS h FROM (SELECT doc_id, {_SAFE} AS l FROM ({DOCS}))",
    "norm_service": f"SELECT doc_id, sha256(array_to_string(list_transform(string_split(regexp_replace(translate(text, '。、；：–—－', '.,;:---'), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\f\\x0B]+', ' ', 'g'))), chr(10))) AS h FROM ({DOCS})",
    "norm_reference": f"SELECT doc_id, sha256({_REFN}) AS h FROM ({DOCS})",
    "fold_accents": f"SELECT doc_id, sha256(strip_accents(text)) AS h FROM ({DOCS})",
    "norm_surname": W + REFS + "," + CORE + " SELECT author1, strip_accents(lower(author1)) AS surname, count(*) AS n FROM core WHERE lang = 'en' GROUP BY author1",
    "norm_year": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y WHEN 1 THEN y || 'b' WHEN 2 THEN 'n.d.' ELSE 'in press' END AS year FROM (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y FROM orders)",
    "person_key": f"SELECT doc_id, sha256(regexp_replace(lower(trim(text)), '[^a-z0-9{HAN}]+', '', 'g')) AS h FROM ({DOCS})",
    "sticky_year": W + REFS + r" SELECT doc_id, pos, regexp_replace(replace(raw, ' (', ''), '([a-zA-Z,，.])([12]\d{3})', '\1 \2', 'g') AS text FROM refs",
    "paren_balance": f"SELECT doc_id, length(regexp_replace(text, '[^(（]', '', 'g')) - length(regexp_replace(text, '[^)）]', '', 'g')) AS open_parens FROM ({DOCS})",
    "preview_text": f"SELECT doc_id, CASE WHEN length(x) > 120 THEN left(x, 120) || '...' ELSE x END AS preview FROM (SELECT doc_id, {squeeze('text')} AS x FROM ({DOCS}))",
    "highlight_ladder": W + REFS + " SELECT doc_id, pos, strpos('List: ' || raw, left(raw, 30)) AS hit FROM refs",
    "filter_noise_lines": W + LINES + r" SELECT doc_id, line_idx, text FROM lines WHERE NOT (regexp_matches(text, '^\d{1,4}$') OR lower(text) LIKE '%this content downloaded from%' OR (regexp_matches(text, '^\d+\s+[A-Za-z][A-Za-z\-\s.]{8,}$') AND NOT regexp_matches(text, '[,()]')) OR (regexp_matches(text, '^(?:[A-Z][A-Za-z''\-]+\s+){2,}[A-Z][A-Za-z''\-]+$') AND NOT regexp_matches(text, '[,()]|(?:19|20)\d{2}')))",
    "filter_tail_headings": W + LINES + r" SELECT doc_id, line_idx, text FROM lines WHERE (length(text) <= 60 AND NOT regexp_matches(text, '(?:19|20)\d{2}') AND contains(regexp_replace(lower(text), '[\W_]+', '', 'g'), 'technicalmanualsstandardsandreports')) OR regexp_matches(text, '(?i)^(?:table\s*[ivx\d]+|appendix)\b')",
    "filter_plausible_year": "SELECT year(o_orderdate) AS y, o_orderkey % 7 AS k, count(*) AS n FROM orders WHERE o_orderkey % 7 IN (0, 2, 4) GROUP BY ALL",
    "filter_non_author": W + LINES + r" SELECT doc_id, line_idx, text FROM lines WHERE regexp_matches(text, '[=%/\\]') OR regexp_matches(lower(text), '^(?:table |figure |fig\. |fig |model |equation |eq\. |eq |chapter |section |appendix |panel |column |row |using )') OR (regexp_matches(text, '\d') AND regexp_matches(lower(text), 'table|figure|fig|model|equation|eq|chapter|section|using|after|before|than'))",
    "filter_numeric_fragment": W + LINES + rf" SELECT doc_id, line_idx, text FROM lines WHERE regexp_matches(text, '[=<>%±]') OR regexp_matches(text, '^[-+]?\d+(?:\.\d*)?$') OR (NOT regexp_matches(text, '[A-Za-z{HAN}]') AND regexp_matches(text, '\d'))",
    "filter_item_starts": W + LINES + r" SELECT doc_id, line_idx, text FROM lines WHERE line_idx % 10 = 6",
    "reference_section_start": W + PARAS + " SELECT doc_id, start FROM starts",
    "body_reference_split": W + PARAS + " SELECT doc_id, count(*) FILTER (para_idx < start) AS body, count(*) FILTER (para_idx >= start) AS refs FROM paras JOIN starts USING (doc_id) GROUP BY doc_id",
    "reference_block_trim": W + PARAS + " SELECT p.doc_id, p.para_idx, p.text, p.page FROM paras p JOIN starts s ON p.doc_id = s.doc_id AND p.para_idx > s.start WHERE NOT EXISTS (SELECT 1 FROM paras q WHERE q.doc_id = p.doc_id AND q.text = 'Appendix A' AND q.para_idx <= p.para_idx)",
    "merge_wrapped_lines": W + REFS + r""", w AS (SELECT doc_id, pos, pos % 3 AS k, raw FROM refs)
SELECT doc_id, pos * 2 AS first, CASE k WHEN 0 THEN 'Notes on ' || raw || ', Second part of it.' WHEN 1 THEN raw || ' knowledge of things.' ELSE raw END AS text FROM w
UNION ALL SELECT doc_id, pos * 2 + 1, 'Second part of it.' FROM w WHERE k = 2""",
    "inline_split": W + REFS + r""" SELECT doc_id, line_idx, generate_subscripts(l, 1) - 1 AS part_idx, unnest(l) AS text FROM (
  SELECT doc_id, pos AS line_idx, list_filter(list_transform(string_split(regexp_replace(regexp_replace('Pages 12-34. ' || raw, '(\d{2,5}[-–]\d{2,5}[.．]?)', '\1' || chr(10), 'g'), '(\d\.)\s+([A-Z][a-zA-Z'' -]+,)', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM refs)""",
    "key_set_metrics": W + FOUR + " SELECT doc_id, hit, actual, expected, round(CASE WHEN actual > 0 THEN hit / actual ELSE 0 END, 6) AS precision, round(CASE WHEN expected > 0 THEN hit / expected ELSE 0 END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / actual) * (hit / expected) / (hit / actual + hit / expected) ELSE 0 END, 6) AS f1, round(hit / either, 6) AS jaccard FROM (SELECT doc_id, count(*) FILTER (status IN ('matched', 'ambiguous')) AS hit, count(*) FILTER (status <> 'extra') AS actual, count(*) FILTER (status <> 'missing') AS expected, count(*) AS either FROM four GROUP BY doc_id)",
    "key_count_metrics": W + CITES + "," + REFS + "," + RKEYS + " SELECT doc_id, hit::BIGINT AS hit, actual::BIGINT AS actual, expected::BIGINT AS expected, round(CASE WHEN actual > 0 THEN hit / actual ELSE 0 END, 6) AS precision, round(CASE WHEN expected > 0 THEN hit / expected ELSE 0 END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / actual) * (hit / expected) / (hit / actual + hit / expected) ELSE 0 END, 6) AS f1 FROM (SELECT coalesce(a.doc_id, e.doc_id) AS doc_id, sum(least(coalesce(a.n, 0), coalesce(e.n, 0))) AS hit, sum(coalesce(a.n, 0)) AS actual, sum(coalesce(e.n, 0)) AS expected FROM (SELECT doc_id, key, count(*) AS n FROM ckeys WHERE key IS NOT NULL GROUP BY ALL) a FULL OUTER JOIN (SELECT doc_id, key, count(*) AS n FROM rkeys GROUP BY ALL) e ON a.doc_id = e.doc_id AND a.key = e.key GROUP BY 1)",
    "content_hash_dedupe": "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "latest_jobs": "SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events) WHERE rank <= 5",
    "localized_columns": W + REFS + "," + CORE + ' SELECT item_idx AS "文獻索引", lang AS "語言", author1 AS "第一作者", year AS "年份", raw AS "參考文獻原文", 0 AS page FROM core',
    "tool1_sort": W + REFS + f" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(raw, '[{HAN}]') THEN 0 WHEN regexp_matches(raw, '^[A-Za-z]') THEN 1 ELSE 2 END, CASE WHEN regexp_matches(raw, '[{HAN}]') THEN 9999 ELSE 0 END, regexp_extract(raw, '[{HAN}]'), lower(raw), pos) - 1 AS ord, pos, raw FROM refs",
    "stroke_lookup": W + REFS + f" SELECT h AS ch, CASE h WHEN '李' THEN 7 ELSE 9999 END AS strokes, count(*) AS n FROM (SELECT regexp_extract(raw, '[{HAN}]') AS h FROM refs) WHERE h <> '' GROUP BY ALL",
    "title_source_split": W + REFS + r" SELECT doc_id, pos, trim(split_part(after, '.', 1)) AS title, trim(substr(after, strpos(after, '.') + 1)) AS source FROM (SELECT doc_id, pos, trim(regexp_replace(trim(regexp_extract(raw, '^.*?\((?:19|20)\d{2}[a-z]?\)(.*)$', 1)), '^\.', '')) AS after FROM refs WHERE regexp_matches(raw, '\((?:19|20)\d{2}[a-z]?\)'))",
    "mutate_spaces": W + REFS + " SELECT doc_id, pos, substr(x, 1, strpos(x, '  ') - 1) || chr(9) || substr(x, strpos(x, '  ') + 2) AS text FROM (SELECT doc_id, pos, replace(raw, ' ', '  ') AS x FROM refs)",
    "mutate_punct": W + REFS + " SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN translate(raw, '(),.', '（），。') ELSE translate(raw, '（），。', '(),.') END AS text FROM refs",
}

_WIDE_FROM, _WIDE_TO = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)) + "　", "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " "
_BOUNDARY = squeeze(f"lower(translate(text, '{_WIDE_FROM}', '{_WIDE_TO}'))")
_ASCII_NAME = "regexp_replace(lower(surname), '[^a-z0-9]', '', 'g')"
_CODES = "['REFERENCE_SECTION_NOT_FOUND', 'CONVERSION_TIMEOUT', 'CONVERSION_ERROR', 'PREVIEW_ERROR', 'PARSE_ERROR']"
SQL |= {
    "filter_valid_author": W + LINES + r" SELECT doc_id, line_idx, text FROM lines WHERE length(regexp_replace(trim(text), '[^ ]', '', 'g')) <= 4 AND regexp_matches(text, '\p{Lu}')",
    "filter_connector": W + BODY + r" SELECT doc_id, para_idx, substr(text, strpos(text, ' ')) AS rest FROM body WHERE text SIMILAR TO '[^ ]+ (and|And|&)\b.*'",
    "filter_open_items": W + REFS + " SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN left(raw, -1) ELSE left(raw, -1) || ' and' END AS text FROM refs WHERE pos % 3 < 2",
    "filter_initials": W + REFS + r" SELECT token, count(*) AS n FROM (SELECT regexp_extract(raw, ', ([^ ]+) ', 1) AS token FROM refs) WHERE regexp_matches(token, '^([A-Za-z]\.)+$') GROUP BY token",
    "filter_cited_segments": W + BODY + rf""" SELECT doc_id, para_idx, segment FROM (SELECT doc_id, para_idx, unnest(string_split(g, ';')) AS segment FROM (SELECT doc_id, para_idx, unnest(regexp_extract_all(text, '\(([^()]+)\)', 1)) AS g FROM body))
  WHERE regexp_matches(trim(segment), '(?i)^.+?,\s*{TOK}(?:,\s*pp?\.?\s*\d+)?$')""",
    "error_codes": f"SELECT o_orderkey, {_CODES}[(o_orderkey % 5 + 1)::INT] AS code FROM orders",
    "reference_key_title": W + REFS + "," + RKEYS + rf""" SELECT doc_id, pos, CASE WHEN name = '' OR yr = '' THEN '' ELSE name || '_' || yr || suf || CASE WHEN title <> '' THEN '_' || title ELSE '' END END AS key FROM (
  SELECT *, {_ASCII_NAME} AS name, left(regexp_replace(lower(regexp_extract(raw, '^[^.]*\.[^.]*\. (.*)$', 1)), '[^a-z0-9]', '', 'g'), 12) AS title FROM rkeys)""",
    "body_extraction": W + PARAS + r""" SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN before ELSE whole END) AS before, sha256(whole) AS whole, left(whole, 40) AS first, length(CASE WHEN doc_id % 2 = 0 THEN left(whole, strpos(whole, 'Appendix') - 1) ELSE whole END) AS n_marked
  FROM (SELECT doc_id, string_agg(text, chr(10) ORDER BY para_idx) AS whole, string_agg(text, chr(10) ORDER BY para_idx) FILTER (para_idx < start) AS before FROM paras JOIN starts USING (doc_id) GROUP BY doc_id)""",
    "lead_strip": f"SELECT o_orderkey, {nm('o_custkey')} AS english, '李明' AS han FROM orders",
    "apply_year": W + REFS + r" SELECT doc_id, pos, CASE WHEN raw LIKE '%（%' THEN regexp_replace(raw, '((?:19|20)\d{2})', '(\1b)') ELSE regexp_replace(raw, '\(((?:19|20)\d{2})[a-z]?\)', '(\1b)') END AS text FROM refs WHERE regexp_matches(raw, '[(（](?:19|20)\d{2}')",
    "context_window": W + BODY + " SELECT doc_id, para_idx, '...' || substr(text, greatest(p - 11, 0) + 1, least(p + 15, length(text)) - greatest(p - 11, 0)) || '...' AS context FROM (SELECT *, strpos(text, '(') AS p FROM body) WHERE p > 0",
    "heading_keys": W + PARAS + " SELECT key, count(*) AS n FROM (SELECT replace(replace(replace(replace(lower(text), ' ', ''), '.', ''), ':', ''), '：', '') AS key FROM paras) WHERE length(key) <= 20 GROUP BY key",
    "boundary_text": f"SELECT doc_id, sha256({_BOUNDARY}) AS h FROM ({DOCS})",
    "metric_averages": f"SELECT count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(jaccard), 6) AS jaccard FROM ({SQL['key_set_metrics']})",
    "key_coverage": W + REFS + "," + RKEYS + " SELECT doc_id, sum(n)::BIGINT AS items, sum(n)::BIGINT AS keyed, count(*) FILTER (n > 1) AS duplicate_keys, 1.0::DOUBLE AS coverage FROM (SELECT doc_id, key, count(*) AS n FROM rkeys GROUP BY doc_id, key) GROUP BY doc_id",
    "key_consistency": W + FOUR + " SELECT doc_id, count(DISTINCT key) AS keys, count(*) - count(DISTINCT key) AS overlapping FROM four GROUP BY doc_id",
    "reference_spans": W + REFS + """ SELECT doc_id, pos, start::INT AS start, (start + length(raw))::INT AS end, CASE WHEN pos % 7 = 0 AND length(raw) >= 40 THEN 'head' ELSE 'exact' END AS found
  FROM (SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM refs)""",
    "report_markdown": f"""SELECT 4::BIGINT AS ord, '| ' || doc_id || ' | ' || matched || ' | ' || missing || ' | ' || extra || ' | ' || ambiguous || ' |' AS value FROM ({SQL['match_counts_per_doc']})
  UNION ALL VALUES (0, '# Matches'), (1, ''), (2, '| doc_id | matched | missing | extra | ambiguous |'), (3, '| --- | --- | --- | --- | --- |')""",
    "mutate_linebreaks": W + REFS + " SELECT doc_id, pos, array_to_string(list_transform(string_split(raw, ' '), lambda w, i: CASE WHEN i = 1 THEN w WHEN (i - 1) % 6 = 0 THEN chr(10) || w ELSE ' ' || w END), '') AS text FROM refs",
    "mutate_no_blank": W + REFS + " SELECT doc_id, pos, replace(raw, '. ', '.' || chr(10)) AS text FROM refs",
}

_NUMBERED = """,
ac AS (SELECT *, doc_id || ':' || para_idx || ':' || seq AS cite_id FROM acites),
ex AS (SELECT cite_id, arg_min(r.raw, item_idx) AS ref_raw FROM ac c JOIN core r ON r.doc_id = c.doc_id AND r.lang = c.lang AND lower(r.author1) = lower(c.author1) AND r.year = c.year GROUP BY cite_id),
cx AS (SELECT cite_id, min(item_idx)::INT AS ref_idx, arg_min(r.raw, item_idx) AS ref_raw FROM ac c JOIN core r ON r.doc_id = c.doc_id AND r.lang = c.lang AND r.year = c.year AND contains(strip_accents(lower(c.t)), strip_accents(lower(r.author1))) AND (contains(r.raw, c.author1) OR lower(c.author2) = lower(r.author2)) GROUP BY cite_id)"""
_BIB = r""",
items AS (
  SELECT doc_id, pos, raw, lower(regexp_extract(raw, '^([A-Za-z]+),', 1)) AS first, CASE WHEN raw LIKE '%, & %' THEN [lower(regexp_extract(raw, ', & ([A-Za-z]+),', 1)), 'b'] ELSE ['a'] END AS more,
    regexp_extract(raw, '\((\d{4})', 1) AS year, regexp_extract(raw, '\(\d{4}([a-z])\)', 1) AS suffix, regexp_replace(lower(split_part(regexp_extract(raw, '\)\. (.*)$', 1), '.', 1)), '[^a-z0-9]', '', 'g') AS title
  FROM refs WHERE regexp_matches(raw, '^[A-Za-z].*\((19|20)\d{2}[a-z]?\)')
), turns AS (
  SELECT *, suffix = '' AND count(*) OVER (PARTITION BY doc_id, year, first, more) > 1 AND row_number() OVER turn <= 26 AS auto, chr((96 + row_number() OVER turn)::INT) AS letter
  FROM items WINDOW turn AS (PARTITION BY doc_id, year, first, more, suffix ORDER BY title, pos)
), bib AS (
  SELECT doc_id, pos, CASE WHEN auto THEN replace(raw, '(' || year || ')', '(' || year || letter || ')') ELSE raw END AS text, first, more, year, CASE WHEN auto THEN letter ELSE suffix END AS suffix, title, auto, NULL AS reason FROM turns
  UNION ALL SELECT doc_id, pos, raw, NULL, NULL, NULL, '', NULL, false, CASE WHEN raw LIKE '%（%' THEN 'author_missing' ELSE 'year_missing' END FROM refs WHERE NOT regexp_matches(raw, '^[A-Za-z].*\((19|20)\d{2}[a-z]?\)')
)"""
SQL |= {
    "context_recovery": W + A + _NUMBERED + " SELECT cite_id, ref_idx, ref_raw FROM cx",
    "match_cascade": W + A + RAWT + _NUMBERED + f""", staged AS (
  SELECT c.doc_id, c.cite_id, CASE WHEN ex.cite_id IS NOT NULL THEN 'Exact' WHEN {IN_RAW} THEN 'Found in Raw Text (Parser Missed)' WHEN cx.cite_id IS NOT NULL THEN 'Context Recovery' ELSE 'Missing' END AS match_type, ex.ref_raw AS e, cx.ref_raw AS x
  FROM ac c LEFT JOIN ex USING (cite_id) LEFT JOIN cx USING (cite_id))
SELECT doc_id, cite_id, match_type, CASE match_type WHEN 'Exact' THEN e WHEN 'Context Recovery' THEN x WHEN 'Found in Raw Text (Parser Missed)' THEN '(Located in Reference Section text)' END AS ref_raw FROM staged""",
    "bibliography_sort": W + REFS + _BIB + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY reason IS NOT NULL, first, more, year, suffix <> '', suffix, title, pos) - 1 AS ord, pos, text,
  CASE WHEN reason IS NULL THEN first || '_' || year || suffix || '_' || left(title, 12) ELSE '' END AS key, reason FROM bib""",
    "auto_suffix": W + REFS + _BIB + " SELECT doc_id, pos, suffix, text FROM bib WHERE auto",
    "normalize_report": W + REFS + _BIB + """ SELECT doc_id, count(*) AS total_items, count(*) FILTER (reason IS NULL) AS parsed_items, count(*) FILTER (reason IS NULL) AS authors_year_parsed_items, count(*) FILTER (auto) AS auto_suffix_applied_items,
  count(*) FILTER (reason = 'year_missing') AS year_missing, count(*) FILTER (reason = 'author_missing') AS author_missing FROM bib GROUP BY doc_id""",
    "authors_list": W + REFS + r""" SELECT doc_id, pos, CASE WHEN names LIKE '%, & %' THEN regexp_replace(names, '^(.*), & (.*), B\.$', '\1|\2|B') ELSE regexp_replace(names, ', A\.$', '|A') END AS authors
  FROM (SELECT doc_id, pos, split_part(raw, ' (', 1) AS names FROM refs WHERE regexp_matches(raw, '^[A-Za-z].*\((19|20)\d{2}[a-z]?\)'))""",
    "page_layout_columns": """WITH words AS (
  SELECT l_orderkey AS doc_id, l_partkey AS idx, l_linenumber AS n, l_linenumber % 2 = 0 AS right_side, l_linenumber % 2 = 0 OR l_orderkey % 3 = 0 AS gutter FROM lineitem
), pages AS (SELECT doc_id, max(n * 50 + 10) FILTER (gutter) AS low FROM words GROUP BY doc_id)
SELECT doc_id, 1::INT AS page, (CASE WHEN two THEN 2 ELSE 1 END)::INT AS columns, string_agg(n::VARCHAR, ' ' ORDER BY region, n, right_side, idx) AS text FROM (
  SELECT *, coalesce(low < 160, true) AS two, CASE WHEN NOT coalesce(low < 160, true) OR n * 50 < coalesce(low + 5, -1) THEN 0 WHEN right_side THEN 2 ELSE 1 END AS region FROM words JOIN pages USING (doc_id)
) GROUP BY doc_id, two""",
}
