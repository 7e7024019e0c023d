"""SQL for another engine that gives the rows of the catalogue's queries, written independently of their plans."""

from __future__ import annotations

from types import SimpleNamespace

# Fixed values, stated here anew so that an error in the engine's own shows: white space, reasons, definition verbs and
# the order of the classes.
WS = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
v = SimpleNamespace(
    UNSUPPORTED="source_text is not supported by the document chunk.",
    NO_NAME="party name does not appear in the document chunk.",
    NO_DESIGNATION="Party was accepted, but its designation was not explicitly supported by source_text. Designation was removed.",
    NO_TERM="defined term does not appear in the document chunk.",
    NO_PATTERN="source_text does not contain an explicit definition pattern such as 'means', 'shall mean', 'refers to', or 'includes'.",
    NO_OBLIGED="obligation has no responsible party.",
    NO_DUTY="obligation has no action.",
    NO_HOLDER="right has no receiving party.",
    NO_RIGHT="right has no action.",
    NO_TARGET="reference target does not appear in source_text.",
    VERBS_COMPAT=["means", "includes", "shallmean", "refersto", "isdefinedas", "shallbedefinedas"],
    VERBS_FIXED=["means", "includes", "shall mean", "refers to", "is defined as", "shall be defined as"],
    TYPE_ORDER={"party": 0, "defined_term": 1, "obligation": 2, "right": 3, "reference": 4},
)
FULL_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FULL_TO = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def compat(x: str) -> str:
    """NFKC as far as the given data need it: full-width forms, ligatures and a few symbols, then composition."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("™", "TM"), ("½", "1⁄2"), ("№", "No"), ("²", "2"), ("³", "3"), ("ª", "a"), ("º", "o")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize(translate({x}, '{FULL_FROM}', '{FULL_TO}'))"


def fold(x: str) -> str:
    return f"lower(trim(regexp_replace({compat(x)}, '[^a-zA-Z0-9]+', ' ', 'g')))"


CTE_LINES = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INT) AS i, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents WHERE text IS NOT NULL))"""

CTE_BLOCKS = (
    CTE_LINES
    + """, blocks AS (
  SELECT doc_id, CAST(i // 10 + 1 AS INT) AS page_number, i AS block_index,
         CASE WHEN i % 17 = 16 THEN 'image' ELSE 'text' END AS block_type,
         CASE WHEN doc_id % 5 = 0 AND i = 0 THEN line
              WHEN doc_id % 7 = 0 AND i = 0 THEN '1.1 ' || line
              WHEN i % 12 = 0 THEN (i // 12 + 1)::VARCHAR || '. ' || line
              WHEN i % 12 = 5 THEN (i // 12 + 1)::VARCHAR || '.1.1 ' || line
              WHEN i % 4 = 0 THEN (i // 12 + 1)::VARCHAR || '.' || ((i % 12) // 4)::VARCHAR || ' ' || line
              WHEN i % 4 = 2 THEN '(a) ' || line
              ELSE line END AS text
  FROM lines)"""
)

BLOCKS = f"WITH {CTE_BLOCKS} SELECT * FROM blocks"

DOC_CACHE_KEY = """SELECT doc_id, sha256('v1' || lower(coalesce(nullif(regexp_extract(source, '[^.]([.][^./]+)$', 1), ''), '.PDF'))
  || coalesce(text, '')) AS cache_key FROM documents"""
SEMANTIC_CACHE_KEY = """SELECT DISTINCT filename, source_chunk_id, model, sha256(filename || ':chunk:' ||
  coalesce(source_chunk_id, -1)::VARCHAR || ':model:' || coalesce(model, 'none') || ':extraction_version:v1') AS semantic_key
  FROM obligations"""
CACHE_HITS = """SELECT DISTINCT filename, chunk_id FROM chunks c WHERE EXISTS
  (SELECT 1 FROM obligations o WHERE o.filename = c.filename AND o.source_chunk_id = c.chunk_id)"""
CACHE_MISSES = CACHE_HITS.replace("WHERE EXISTS", "WHERE NOT EXISTS")
GET_OR_COMPUTE = f"""SELECT filename, origin, count(*) AS n FROM (
  SELECT filename, 'cache' AS origin FROM ({CACHE_HITS}) UNION ALL
  SELECT filename, 'computed' FROM ({CACHE_MISSES})) GROUP BY ALL"""
PAYLOAD_GUARD = """SELECT raw_id, try_cast(json_extract_string(payload, '$.chunk_id') AS BIGINT) AS chunk_id,
  length(json_extract_string(payload, '$.text')) AS n_chars FROM raw_chunks
  WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND json_extract_string(payload, '$.text') IS NOT NULL"""
SUFFIX_FILTER = """SELECT DISTINCT filename, '.pdf' AS suffix FROM chunks WHERE lower(filename) LIKE '_%.pdf'"""
EMPTY_GUARD = """SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'The uploaded file is empty.' END AS error FROM documents"""
NO_CHUNKS = """SELECT doc_id, 'The document produced no chunks.' AS error FROM documents WHERE text IS NULL"""
GEOMETRY = """SELECT dense_id, CAST(i - 1 AS INT) AS nth, g.ref, g.page_no, g.bbox[1] AS x0, g.bbox[2] AS y0, g.bbox[3] AS x1,
  g.bbox[4] AS y1, g.page_width, g.page_height FROM (
  SELECT dense_id, unnest(item_geometry) AS g, generate_subscripts(item_geometry, 1) AS i
  FROM (SELECT DISTINCT dense_id, item_geometry FROM dense_chunks))"""
JSON_SINK = """SELECT DISTINCT filename, section_ord, '{"section_ord":' || coalesce(section_ord::VARCHAR, 'null') || ',"locator":' ||
  coalesce('"' || locator || '"', 'null') || ',"level":' || coalesce(level::VARCHAR, 'null') || '}' AS json FROM document_sections"""
WS_NORMALIZE = f"SELECT doc_id, md5({collapse('text')}) AS md5, length({collapse('text')}) AS n FROM documents"
EVIDENCE = f"SELECT doc_id, md5({fold('text')}) AS md5, length({fold('text')}) AS n FROM documents"

_RAW_SPANS = (
    CTE_BLOCKS
    + """, words AS (
  SELECT *, string_split(text, ' ') AS w FROM blocks),
canon AS (
  SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_index) - 1 AS nth,
         block_index AS i,
         CASE WHEN block_type = 'image' THEN 'image' WHEN block_index % 29 = 28 THEN 'unknown' ELSE 'text' END AS kind,
         w FROM words)"""
)
BLOCK_SCAN = f"""WITH {_RAW_SPANS} SELECT doc_id, page_number, CAST(nth AS INT) AS block_index, kind AS block_type,
  CASE WHEN kind = 'text' THEN {strip("array_to_string(list_transform(w, lambda x, k: CASE WHEN (k - 1) % 7 <> 6 THEN x ELSE '' END), '')")} ELSE '' END AS text,
  CAST(CASE WHEN kind = 'text' THEN len(w) ELSE 0 END AS INT) AS n_spans, 0 AS x0,
  CAST(CASE WHEN i % 11 <> 10 THEN i ELSE 0 END AS INT) AS y0,
  CAST(CASE WHEN i % 11 <> 10 THEN 90 ELSE 0 END AS INT) AS x1,
  CAST(CASE WHEN i % 11 <> 10 THEN i + 1 ELSE 0 END AS INT) AS y1 FROM canon"""
SPAN_FLATTEN = f"""WITH {_RAW_SPANS} SELECT doc_id, page_number, CAST(nth AS INT) AS block_index, CAST(k - 1 AS INT) AS k,
  CASE WHEN (k - 1) % 7 <> 6 THEN word ELSE '' END AS text, 19 AS double_size, 4 AS flags FROM (
  SELECT *, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM canon WHERE kind = 'text')"""
READING_ORDER = f"""WITH {_RAW_SPANS}, y AS (SELECT *, CAST(CASE WHEN i % 11 <> 10 THEN i ELSE 0 END AS INT) AS y0 FROM canon)
  SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, nth) - 1 AS INT) AS block_index, y0,
  kind AS block_type FROM y"""
PAGE_DUMP = f"""WITH b AS ({BLOCK_SCAN}) SELECT doc_id, page_number,
  md5(coalesce(string_agg(text, chr(10) ORDER BY block_index) FILTER (text <> ''), '')) AS md5 FROM b GROUP BY ALL"""
METADATA = """SELECT doc_id, 'lang' AS key, lang AS value FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents WHERE n_chars IS NOT NULL
  UNION ALL SELECT doc_id, 'sha256', sha256(coalesce(text, '')) FROM documents"""

_CLAUSE = r"^(\p{Nd}+(?:\.\p{Nd}+)+)\.? (.+)$"
_SECTION = r"^(\p{Nd}+)\.? (.+)$"
CTE_NORM = (
    CTE_BLOCKS
    + f""", normed AS (SELECT *, {collapse("text")} AS norm FROM blocks),
cls AS (SELECT *, regexp_matches(norm, '{_CLAUSE}') AND length(regexp_extract(norm, '{_CLAUSE}', 2)) <= 500 AS is_c FROM normed),
kinds AS (SELECT *, CASE WHEN is_c THEN 'C' WHEN regexp_matches(norm, '{_SECTION}') THEN 'S' ELSE 'B' END AS kind FROM cls)"""
)
DETECT_CLAUSE = f"""WITH {CTE_NORM} SELECT doc_id, block_index, regexp_extract(norm, '{_CLAUSE}', 1) AS number,
  regexp_extract(norm, '{_CLAUSE}', 2) AS remainder FROM kinds WHERE kind = 'C'"""
DETECT_LETTER = rf"""WITH {CTE_NORM} SELECT doc_id, block_index, lower(regexp_extract(norm, '(?i)^\(([a-z])\) (.+)$', 1)) AS letter
  FROM kinds WHERE regexp_matches(norm, '(?i)^\(([a-z])\) (.+)$')"""
SECTION_MATCH = f"""WITH {CTE_NORM} SELECT doc_id, block_index, regexp_extract(norm, '{_SECTION}', 1) AS number,
  regexp_extract(norm, '{_SECTION}', 2) AS title FROM kinds WHERE kind = 'S'"""
_STRICT = rf"^(\p{{Nd}}+)\.?{WS}+(.+)$"
IS_HEADING = f"""WITH {CTE_BLOCKS}, s AS (SELECT *, {strip("text")} AS t FROM blocks) SELECT doc_id, block_index FROM s
  WHERE block_type = 'text' AND regexp_matches(t, '{_STRICT}') AND length({strip(f"regexp_extract(t, '{_STRICT}', 2)")}) <= 120
  AND length(t) <= 150"""
_HEADING = rf"^(\p{{Nd}}+(?:\.\p{{Nd}}+)*){WS}+(.+)$"


def heading(x: str) -> str:
    s = strip(x)
    hit = f"regexp_matches({s}, '{_HEADING}')"
    loc = f"CASE WHEN {hit} THEN regexp_extract({s}, '{_HEADING}', 1) END"
    return f"""{loc} AS locator, CASE WHEN {hit} THEN {strip(f"regexp_extract({s}, '{_HEADING}', 2)")} ELSE {s} END AS title,
  CAST(length({loc}) - length(replace({loc}, '.', '')) + 1 AS INT) AS level"""


PARSE_HEADING = f"SELECT DISTINCT filename, section_ord, {heading('heading')} FROM document_sections"
BLOCK_KINDS = rf"""WITH {CTE_NORM} SELECT doc_id, kind, count(*) AS n,
  count(*) FILTER (regexp_matches(norm, '(?i)^\(([a-z])\) (.+)$')) AS n_lettered
  FROM kinds WHERE block_type = 'text' AND norm <> '' GROUP BY ALL"""
CTE_SEG = (
    CTE_NORM
    + f""", g AS (
  SELECT *, sum(CASE WHEN kind <> 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number, block_index) AS grp
  FROM kinds WHERE block_type = 'text' AND norm <> ''),
m AS (SELECT *, sum(CASE WHEN kind = 'S' OR (kind = 'C' AND grp = 1) THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY page_number, block_index) AS sec FROM g WHERE grp > 0),
gr AS (SELECT doc_id, sec, grp, arg_min(kind, block_index) AS kind, arg_min(norm, block_index) AS head,
         min(page_number) AS p0, max(page_number) AS p1, string_agg(norm, chr(10) ORDER BY page_number, block_index) AS text
       FROM m GROUP BY ALL)"""
)
BUILD_CLAUSES = f"""WITH {CTE_SEG} SELECT doc_id, CAST(sec - 1 AS INT) AS section_ord, CAST(grp - 1 AS INT) AS clause_ord, number,
  CASE WHEN length(rest) < 120 THEN rest END AS title, text, lvl AS level, p0 AS page_start, p1 AS page_end,
  CASE WHEN lvl > 2 THEN 'subclause' ELSE 'clause' END AS clause_type FROM (
  SELECT *, CAST(len(string_split(number, '.')) AS INT) AS lvl FROM (
  SELECT *, regexp_extract(head, '{_CLAUSE}', 1) AS number, regexp_extract(head, '{_CLAUSE}', 2) AS rest FROM gr WHERE kind = 'C'))"""
BUILD_SECTIONS = f"""WITH {CTE_SEG}, s AS (
  SELECT doc_id, sec, arg_min(kind, grp) AS kind, arg_min(head, grp) AS head, arg_min(p0, grp) AS page_start,
         max(CASE WHEN kind = 'S' THEN p1 ELSE p0 END) AS page_end, CAST(count(*) FILTER (kind = 'C') AS INT) AS n_clauses
  FROM gr GROUP BY doc_id, sec)
SELECT doc_id, CAST(sec - 1 AS INT) AS section_ord,
  CASE WHEN kind = 'S' THEN regexp_extract(head, '{_SECTION}', 1) ELSE string_split(head, '.')[1] END AS number,
  CASE WHEN kind = 'S' THEN regexp_extract(head, '{_SECTION}', 2) ELSE 'Section ' || string_split(head, '.')[1] END AS title,
  1 AS level, page_start, page_end, n_clauses FROM s"""

CHUNK_SCAN = f"""WITH {CTE_LINES}, r AS (
  SELECT *, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1) // 800 AS slot FROM lines)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot) - 1 AS INT) AS chunk_id, text FROM (
  SELECT doc_id, slot, string_agg(line, chr(10) ORDER BY i) AS text FROM r GROUP BY ALL)"""
CTE_CHUNKS = "c AS (SELECT DISTINCT filename AS doc_id, chunk_id, text, headings, pages, provenance FROM chunks)"
CONTEXTUALIZE = f"""WITH {CTE_CHUNKS} SELECT doc_id, chunk_id, md5(array_to_string(headings, chr(10)) || chr(10) || text) AS md5 FROM c"""
_PROV = "SELECT doc_id, chunk_id, unnest(provenance) AS p, generate_subscripts(provenance, 1) - 1 AS nth FROM c"
CHUNK_PROVENANCE = f"""WITH {CTE_CHUNKS} SELECT doc_id, chunk_id, CAST(nth AS INT) AS nth, p.self_ref, p.label, p.page_no, p.bbox.coord_origin AS coord_origin
  FROM ({_PROV})"""
CHUNK_PAGES = f"""WITH {CTE_CHUNKS}, p AS (SELECT doc_id, chunk_id, list_sort(list_distinct(list(p.page_no) FILTER (p.page_no IS NOT NULL))) AS l
  FROM ({_PROV}) GROUP BY ALL)
SELECT c.doc_id, c.chunk_id, coalesce(array_to_string(l, ','), '') AS pages FROM c LEFT JOIN p USING (doc_id, chunk_id)"""
RAW_STRUCTURE = f"""WITH {CTE_BLOCKS}, h AS (
  SELECT *, last_value(CASE WHEN block_index % 12 = 0 THEN {collapse("text")} END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY block_index) AS heading FROM blocks)
SELECT doc_id, CAST(block_index // 4 AS INT) AS chunk_id, coalesce({strip("arg_min(heading, block_index)")}, '') AS headings,
  coalesce(array_to_string(list_sort(list_distinct(list(page_number) FILTER (block_index % 13 <> 12))), ','), '') AS pages,
  string_agg('#/texts/' || block_index, ',' ORDER BY block_index) AS refs,
  md5(string_agg(text, chr(10) ORDER BY block_index)) AS md5 FROM h GROUP BY doc_id, block_index // 4"""
DOC_SECTIONS = f"""WITH {CTE_CHUNKS}, e AS (
  SELECT doc_id, chunk_id, pages, unnest(hs) AS heading, generate_subscripts(hs, 1) AS pos FROM (
    SELECT *, list_transform(list_filter(headings, lambda x: x IS NOT NULL AND x <> ''), lambda x: {strip("x")}) AS hs FROM c)),
s AS (SELECT doc_id, lower(heading) AS k, arg_min(heading, chunk_id * 1000 + pos) AS heading,
        list_sort(list_distinct(list(chunk_id))) AS cs, list_sort(list_distinct(flatten(list(pages)))) AS ps FROM e GROUP BY ALL)
SELECT doc_id, heading, {heading("heading")}, array_to_string(cs, ',') AS chunk_ids,
  array_to_string(list_filter(ps, lambda x: x IS NOT NULL), ',') AS pages FROM s"""
MAX_CHUNKS = "SELECT DISTINCT filename AS doc_id, chunk_id FROM chunks WHERE chunk_id < 3"
SECTION_LINK = """SELECT DISTINCT s.doc_id, s.section_ord, s.chunk_id FROM (
  SELECT filename AS doc_id, section_ord, unnest(chunk_ids) AS chunk_id FROM (SELECT DISTINCT filename, section_ord, chunk_ids FROM document_sections)) s
  JOIN (SELECT DISTINCT filename, chunk_id FROM chunks) c ON c.filename = s.doc_id AND c.chunk_id = s.chunk_id"""

CTE_SENT = """sent AS (
  SELECT o_custkey AS doc_id, CAST(pos // 3 AS INT) AS chunk_id, CAST(pos AS INT) AS pos, o, k, name,
    CASE k WHEN 0 THEN name || ' shall deliver order ' || o || ' within ' || (o % 30 + 1) || ' days.'
           WHEN 1 THEN name || ' may not assign order ' || o || '.'
           WHEN 2 THEN name || ' may cancel order ' || o || ' if the priority is ' || o_orderpriority || '.'
           WHEN 3 THEN '"Order ' || o || '" means the order placed by ' || name || '.'
           WHEN 4 THEN '"Order ' || o || '" shall mean the order placed by ' || name || '.'
           WHEN 5 THEN name || ' is bound by Section ' || (o % 9 + 1) || '.' || (o % 5 + 1) || ' and Exhibit A.'
           ELSE 'This Agreement is between ' || name || ' ("Customer ' || o_custkey || '") and the Supplier.' END AS sentence
  FROM (SELECT o_custkey, o_orderpriority, o_orderkey AS o, o_orderkey % 7 AS k, c_name AS name,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos
        FROM orders JOIN customer ON o_custkey = c_custkey)),
ch AS (SELECT doc_id, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM sent GROUP BY ALL)"""
SENTENCES = f"WITH {CTE_SENT} SELECT doc_id, chunk_id, sentence FROM sent"
X_PARTIES = f"""WITH {CTE_SENT} SELECT doc_id, chunk_id, name, 'Customer ' || doc_id AS designation, sentence AS source_text FROM sent WHERE k = 6"""
X_TERMS = f"""WITH {CTE_SENT} SELECT doc_id, chunk_id, 'Order ' || o AS term, 'the order placed by ' || name AS definition,
  sentence AS source_text FROM sent WHERE k IN (3, 4)"""
X_OBLIGATIONS = f"""WITH {CTE_SENT} SELECT doc_id, chunk_id, name AS party,
  CASE k WHEN 0 THEN 'deliver order ' || o ELSE 'not assign order ' || o END AS action, CAST(NULL AS VARCHAR) AS condition,
  CASE k WHEN 0 THEN 'within ' || (o % 30 + 1) || ' days' END AS deadline, sentence AS source_text FROM sent WHERE k IN (0, 1)"""
X_OBJECTS = f"""WITH {CTE_SENT} SELECT doc_id, chunk_id, 'order ' || o AS object, sentence AS source_text FROM sent WHERE k IN (0, 1)"""
CACHE_STORE = """SELECT filename, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN -1 ELSE 1 END * max(length(text)) AS n FROM chunks
  WHERE filename IS NOT NULL AND chunk_id IS NOT NULL GROUP BY filename, chunk_id"""
CLIENT_ERRORS = """SELECT DISTINCT filename AS doc_id, chunk_id, 'no answer' AS error FROM chunks WHERE chunk_id % 5 = 3"""
X_RIGHTS = f"""WITH {CTE_SENT} SELECT doc_id, chunk_id, name AS party, 'cancel order ' || o AS action,
  regexp_extract(sentence, '(if the priority is .*)[.]$', 1) AS condition, CAST(NULL AS VARCHAR) AS deadline,
  sentence AS source_text FROM sent WHERE k = 2"""
X_REFERENCES = f"""WITH {CTE_SENT} SELECT doc_id, chunk_id, 'Section ' || (o % 9 + 1) || '.' || (o % 5 + 1) AS target,
  sentence AS source_text, 'section_reference' AS reference_type FROM sent WHERE k = 5
  UNION ALL SELECT doc_id, chunk_id, 'Exhibit A', sentence, 'exhibit_reference' FROM sent WHERE k = 5
  UNION ALL SELECT doc_id, chunk_id, 'This Agreement', sentence, 'agreement_reference' FROM sent WHERE k = 6"""
_KINDS = (("party", "(6)"), ("defined_term", "(3, 4)"), ("obligation", "(0, 1)"), ("right", "(2)"))
EXTRACT_ONE = (
    f"WITH {CTE_SENT} "
    + " UNION ALL ".join(
        f"""SELECT doc_id, '{k}' AS item_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS item_index,
  sentence AS source_text FROM sent WHERE chunk_id = 1 AND k IN {ks}"""
        for k, ks in _KINDS
    )
    + """ UNION ALL SELECT doc_id, 'reference', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, n) - 1 AS INT), sentence
  FROM (SELECT *, unnest(CASE k WHEN 5 THEN [1, 2] WHEN 6 THEN [1] ELSE [] END) AS n FROM sent WHERE chunk_id = 1)"""
)

GROUNDED = f"""SELECT doc_id, item_id FROM (SELECT doc_id, {fold("text")} AS h FROM documents) d
  JOIN (SELECT item_id, {fold("text")} AS n FROM eval_items) e ON contains(h, n)"""

# Templated sentences are ASCII, so folding needs no compatibility forms here.
_f = lambda x: f"lower(trim(regexp_replace({x}, '[^a-zA-Z0-9]+', ' ', 'g')))"
_q = lambda s: "'" + s.replace("'", "''") + "'"
CTE_CAND = (
    CTE_SENT
    + f""", cand AS (
  SELECT s.doc_id, s.chunk_id, s.pos AS item_index, s.o, s.k, s.name, s.o % 10 AS p, ch.text AS chunk, {_f("ch.text")} AS fc,
    CASE s.o % 10 WHEN 2 THEN 'Elsewhere ' || s.o || ' nobody said this.' WHEN 6 THEN '  ' WHEN 7 THEN '...' ELSE sentence END AS source_text
  FROM sent s JOIN ch USING (doc_id, chunk_id)),
cf AS (SELECT *, {_f("source_text")} AS fs, trim(source_text) <> '' AND contains(fc, {_f("source_text")}) AS grounded FROM cand)"""
)


def _decide(kind: str, mode: str = "compat") -> str:
    if kind == "party":
        body = f"""SELECT *, CASE WHEN p = 3 THEN 'Unknown GmbH' ELSE name END AS n,
          CASE p WHEN 4 THEN 'Nobody' WHEN 5 THEN '' WHEN 8 THEN NULL ELSE 'Customer ' || doc_id END AS alias FROM cf WHERE k = 6"""
        return f"""SELECT *, CASE WHEN NOT grounded THEN {_q(v.UNSUPPORTED)} WHEN NOT contains(fc, {_f("n")}) THEN {_q(v.NO_NAME)} END AS bad,
          coalesce(alias, '') <> '' AND NOT (source_text <> '' AND contains(fs, {_f("coalesce(alias, '')")})) AS fix FROM ({body})"""
    if kind == "defined_term":
        verbs = v.VERBS_COMPAT if mode == "compat" else v.VERBS_FIXED
        hit = " OR ".join(f"contains(fs || ' ', {_f('n')} || ' {w} ')" for w in verbs)
        body = "SELECT *, CASE WHEN p = 3 THEN 'Other Order' ELSE 'Order ' || o END AS n FROM cf WHERE k IN (3, 4)"
        return f"""SELECT *, CASE WHEN NOT grounded THEN {_q(v.UNSUPPORTED)} WHEN NOT contains(fc, {_f("n")}) THEN {_q(v.NO_TERM)}
          WHEN NOT ({hit}) THEN {_q(v.NO_PATTERN)} END AS bad, false AS fix FROM ({body})"""
    if kind in ("obligation", "right"):
        a, b, ks = (v.NO_OBLIGED, v.NO_DUTY, "(0, 1)") if kind == "obligation" else (v.NO_HOLDER, v.NO_RIGHT, "(2)")
        return f"""SELECT *, CASE WHEN p = 0 THEN {_q(a)} WHEN p = 1 THEN {_q(b)} WHEN NOT grounded THEN {_q(v.UNSUPPORTED)} END AS bad,
          false AS fix FROM cf WHERE k IN {ks}"""
    return f"""SELECT *, CASE WHEN NOT grounded THEN {_q(v.UNSUPPORTED)} WHEN source_text = '' OR NOT contains(fs, lower(n)) THEN {_q(v.NO_TARGET)} END AS bad,
      false AS fix FROM (SELECT *, CASE WHEN p = 5 THEN 'Schedule 9' ELSE 'Exhibit A' END AS n FROM cf WHERE k = 5)"""


def _status(kind: str, mode: str = "compat") -> str:
    return f"""SELECT doc_id, chunk_id, item_index, CASE WHEN bad IS NOT NULL THEN 'reject' WHEN fix THEN 'repair' ELSE 'accept' END AS status,
      coalesce(bad, CASE WHEN fix THEN {_q(v.NO_DESIGNATION)} END) AS reason FROM ({_decide(kind, mode)})"""


VALIDATE = {k: f"WITH {CTE_CAND} {_status(k)}" for k in v.TYPE_ORDER}
VALIDATE_FIXED = f"WITH {CTE_CAND} {_status('defined_term', 'fixed')}"

_js = lambda x: f"coalesce('\"' || replace({x}, '\"', '\\\"') || '\"', 'null')"
_BLANKED = "CASE WHEN p = 0 THEN ' ' ELSE name END"
_ACTION = "CASE WHEN p = 1 THEN '' ELSE 'order ' || o END"
_ITEM = {
    "party": [("name", "n"), ("designation", "alias")],
    "defined_term": [("term", "n"), ("definition", "'the order placed by ' || name")],
    "obligation": [("party", _BLANKED), ("action", _ACTION), ("object", "NULL"), ("condition", "NULL"), ("deadline", "NULL")],
    "right": [("party", _BLANKED), ("action", _ACTION), ("condition", "NULL"), ("deadline", "NULL")],
    "reference": [("target", "n"), ("reference_type", "'exhibit_reference'")],
}


def _json(kind: str, *tail: str) -> str:
    pairs = [*_ITEM[kind], ("source_text", "source_text")]
    inner = " || ',' || ".join(f"""'"{k}":' || {_js(f"({x})::VARCHAR")}""" for k, x in pairs)
    return "'{' || " + inner + "".join(f" || {t}" for t in tail) + " || '}'"


ISSUES = f"WITH {CTE_CAND} " + " UNION ALL ".join(
    f"""SELECT doc_id, chunk_id, {v.TYPE_ORDER[k]} AS type_ord,
  CASE WHEN bad IS NULL THEN 'party_designation' ELSE '{k}' END AS item_type, item_index,
  coalesce(bad, {_q(v.NO_DESIGNATION)}) AS reason, source_text, {_json(k, "',\"source_chunk_id\":null'")} AS item
  FROM ({_decide(k)}) WHERE bad IS NOT NULL OR fix"""
    for k in v.TYPE_ORDER
)
_LONG = " UNION ALL ".join(f"SELECT doc_id, chunk_id, '{k}' AS item_type, bad, fix FROM ({_decide(k)})" for k in v.TYPE_ORDER)
REPORT = f"""WITH {CTE_CAND}, i AS (SELECT doc_id, count(*) AS n FROM ({_LONG}) WHERE bad IS NOT NULL OR fix GROUP BY ALL),
  c AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY ALL)
  SELECT c.doc_id, CAST(c.n AS INT) AS chunks_validated, CAST(coalesce(i.n, 0) AS INT) AS n_issues FROM c LEFT JOIN i USING (doc_id)"""
ACCEPTED = f"""WITH {CTE_CAND} SELECT doc_id, chunk_id, item_type, count(*) AS n FROM ({_LONG}) WHERE bad IS NULL GROUP BY ALL"""
FACTS = f"WITH {CTE_CAND} " + " UNION ALL ".join(
    f"SELECT doc_id, chunk_id, '{k}' AS item_type, item_index, source_text, {_json(k)} AS item FROM ("
    + (
        f"SELECT * REPLACE (CASE WHEN NOT fix THEN alias END AS alias) FROM ({_decide(k)})"
        if k == "party"
        else _decide(k)
    )
    + ") WHERE bad IS NULL"
    for k in v.TYPE_ORDER
)
CTE_JOINED = f"cc AS (SELECT DISTINCT filename, chunk_id, text, {fold('text')} AS fc FROM chunks)"


def _grounded_table(name: str, key: str, *columns: str) -> str:
    cols = "".join(f", {c}" for c in columns)
    return f"""SELECT o.*, cc.text AS chunk, coalesce({_blank("o.source_text")} = false AND contains(fc, fs), false) AS grounded, fc
      FROM (SELECT DISTINCT filename, source_chunk_id, {key}, source_text{cols}, {fold("source_text")} AS fs FROM {name}) o
      LEFT JOIN cc ON cc.filename = o.filename AND cc.chunk_id = o.source_chunk_id"""


def _blank(x: str) -> str:
    return f"coalesce({strip(x)} = '', true)"


def _verdict(key: str, cases: str, body: str) -> str:
    return f"SELECT {key}, CASE WHEN reason IS NULL THEN 'accept' ELSE 'reject' END AS status, reason FROM (SELECT *, CASE {cases} END AS reason FROM ({body}))"


CHECK_OBLIGATIONS = f"WITH {CTE_JOINED} " + _verdict(
    "obligation_id",
    f"WHEN {_blank('party')} THEN {_q(v.NO_OBLIGED)} WHEN {_blank('action')} THEN {_q(v.NO_DUTY)} WHEN NOT grounded THEN {_q(v.UNSUPPORTED)}",
    _grounded_table("obligations", "obligation_id", "party", "action"),
)
CHECK_REFERENCES = (
    f"WITH {CTE_JOINED} SELECT doc_id, status, reason, count(*) AS n FROM ("
    + _verdict(
        "filename AS doc_id",
        f"WHEN NOT grounded THEN {_q(v.UNSUPPORTED)} WHEN NOT coalesce(target <> '' AND source_text <> '' AND contains(fs, {fold('target')}), false) THEN {_q(v.NO_TARGET)}",
        _grounded_table("contract_references", "ref_id", "target"),
    )
    + ") GROUP BY ALL"
)
_VERBS = " OR ".join(f"contains(fs || ' ', {fold('term')} || ' {w} ')" for w in v.VERBS_COMPAT)
CHECK_TERMS = f"WITH {CTE_JOINED} " + _verdict(
    "term_id",
    f"""WHEN NOT grounded THEN {_q(v.UNSUPPORTED)} WHEN NOT coalesce(term <> '' AND chunk <> '' AND contains(fc, {fold("term")}), false) THEN {_q(v.NO_TERM)}
    WHEN NOT coalesce({fold("term")} <> '' AND ({_VERBS}), false) THEN {_q(v.NO_PATTERN)}""",
    _grounded_table("defined_terms", "term_id", "term"),
)

DEDUPE_PARTIES = f"""WITH {CTE_SENT}, n AS (
  SELECT CAST(doc_id // 10 AS BIGINT) AS doc_id, doc_id AS chunk_id, pos AS item_index,
    CASE o % 3 WHEN 0 THEN upper(name) WHEN 1 THEN chr(160) || ' ' || name || ' ' ELSE name END AS name,
    CASE WHEN pos % 4 = 2 THEN 'Alias ' || o END AS designation, sentence AS source_text FROM sent)
SELECT doc_id, k AS party_key, f.name, designation, f.source_text, f.chunk_id, f.item_index FROM (
  SELECT doc_id, lower({strip("name")}) AS k, arg_min({{'name': name, 'source_text': source_text, 'chunk_id': chunk_id, 'item_index': item_index}}, chunk_id * 1000 + item_index) AS f,
    arg_min(designation, chunk_id * 1000 + item_index) FILTER (designation IS NOT NULL) AS designation FROM n GROUP BY ALL)"""
DEDUPE_TERMS = f"""SELECT filename AS doc_id, lower({strip("term")}) AS term_key, {strip("definition")} AS definition_key, min(term_id) AS term_id,
  arg_min(term, term_id) AS term FROM defined_terms GROUP BY ALL"""
EVIDENCE_LOOKUP = f"""WITH {CTE_CHUNKS}, p AS ({_PROV})
  SELECT f.doc_id, obligation_id, source_chunk_id, CAST(nth AS INT) AS prov_no, p.p.self_ref, p.p.label, p.p.page_no, round(p.p.bbox.l, 3) AS l
  FROM (SELECT DISTINCT filename AS doc_id, obligation_id, source_chunk_id FROM obligations) f
  JOIN p ON p.doc_id = f.doc_id AND p.chunk_id = f.source_chunk_id"""
_P, _T, _O, _R = (f"(SELECT * FROM ({_decide(k)}) WHERE bad IS NULL)" for k in ("party", "defined_term", "obligation", "right"))
VERTICES = f"""WITH {CTE_CAND} SELECT DISTINCT doc_id, type, key FROM (
  SELECT doc_id, 'Party' AS type, n AS key FROM {_P} UNION ALL SELECT doc_id, 'DefinedTerm', n FROM {_T}
  UNION ALL SELECT doc_id, 'Party', name FROM {_O} UNION ALL SELECT doc_id, 'Party', name FROM {_R}
  UNION ALL SELECT doc_id, 'Contract', doc_id::VARCHAR FROM {_P} UNION ALL SELECT doc_id, 'Contract', doc_id::VARCHAR FROM {_T})"""
GRAPH_EDGES = f"""WITH {CTE_CAND}
  SELECT DISTINCT doc_id, 'Contract' AS src_type, doc_id::VARCHAR AS src, 'HAS_PARTY' AS label, 'Party' AS dst_type, n AS dst FROM {_P}
  UNION SELECT doc_id, 'Contract', doc_id::VARCHAR, 'HAS_DEFINED_TERM', 'DefinedTerm', n FROM {_T}
  UNION SELECT doc_id, 'Obligation', 'obligation:' || chunk_id || ':' || item_index, 'IMPOSES_ON', 'Party', name FROM {_O}
  UNION SELECT doc_id, 'Right', 'right:' || chunk_id || ':' || item_index, 'GRANTED_TO', 'Party', name FROM {_R}"""
REPRESENTATION = f"""WITH {CTE_SENT} SELECT doc_id, CAST(count(DISTINCT chunk_id) AS INT) AS n_chunks,
  CAST(count(DISTINCT name) FILTER (k = 6) AS INT) AS n_parties, CAST(count(*) FILTER (k = 3) AS INT) AS n_terms,
  CAST(count(*) FILTER (k IN (0, 1)) AS INT) AS n_obligations, CAST(count(*) FILTER (k = 2) AS INT) AS n_rights,
  CAST(2 * count(*) FILTER (k = 5) + count(*) FILTER (k = 6) AS INT) AS n_references,
  CAST(count(DISTINCT chunk_id) AS INT) AS chunks_validated, CAST(count(*) FILTER (k = 4) AS INT) AS n_issues FROM sent GROUP BY doc_id"""

_PART = "((sub-?)?(section|clause|paragraph)s?|articles?|(sec|art|cl|para)s?[.]?|§+)".replace("(", "(?:")
_PLACE = "([0-9]+(?:[.][0-9]+)*)(?: ?[(](?:[a-z]|[ivxlc]+)[)])*[.]?"
_TARGET = (
    f"(?i)^(?:{_PART} ?)?{_PLACE}(?: ?(?:and|or|[&,/]) ?(?:{_PART} ?)?{_PLACE})?(?: ?[(][^()]*[)])?"
    "(?: (?:hereof|herein|above|below|of (?:the present|this|the) (?:contract|agreement)))?[.]?$"
)
CTE_ORPHANS = f"""r AS (SELECT ref_id, filename, target, source_chunk_id, min(loaded_at) AS loaded_at FROM contract_references GROUP BY ALL),
k AS (
  SELECT ref_id, filename, loaded_at, 'source_chunk_id' AS field, source_chunk_id::VARCHAR AS key FROM r WHERE source_chunk_id IS NOT NULL
  UNION SELECT ref_id, filename, loaded_at, 'target', unnest([regexp_extract({collapse("target")}, '{_TARGET}', 1), regexp_extract({collapse("target")}, '{_TARGET}', 2)])
  FROM r WHERE regexp_matches({collapse("target")}, '{_TARGET}')),
p AS (
  SELECT filename, 'source_chunk_id' AS field, chunk_id::VARCHAR AS key, min(loaded_at) AS since, bool_or(deleted_at IS NULL) AS live FROM chunks GROUP BY ALL
  UNION ALL SELECT filename, 'target', regexp_replace({strip("locator")}, '[.]$', ''), min(loaded_at), bool_or(deleted_at IS NULL)
  FROM document_sections WHERE locator IS NOT NULL GROUP BY ALL),
o AS (SELECT ref_id, k.field, k.key AS missing_key, k.loaded_at,
  CASE WHEN p.key IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN since > loaded_at THEN 'late' END AS status
  FROM k LEFT JOIN p USING (filename, field, key) WHERE k.key <> '')"""
P6_FOUND = f"WITH {CTE_ORPHANS} SELECT ref_id, field, missing_key, status FROM o WHERE status IS NOT NULL"
P6_COUNTS = f"""WITH {CTE_ORPHANS} SELECT field, strftime(loaded_at, '%Y-%m') AS month, status, count(*) AS n FROM o
  WHERE status IS NOT NULL GROUP BY ALL"""


def _members(x: str) -> str:
    """Positions and members of a JSON list or of an object keyed by positions, as two lists to unnest."""
    keys = f"CASE json_type({x}) WHEN 'OBJECT' THEN json_keys({x}) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length({x}) AS BIGINT)), lambda k: k::VARCHAR) ELSE [] END"
    return f"unnest({keys}) AS pos"


P5_FOUND = f"""WITH RECURSIVE readable AS (
  SELECT raw_id, CAST(payload AS JSON) AS j FROM raw_chunks WHERE json_valid(payload)),
meta AS (
  SELECT raw_id, CASE json_type(j, '$.metadata') WHEN 'VARCHAR' THEN CAST(json_extract_string(j, '$.metadata') AS JSON)
         ELSE json_extract(j, '$.metadata') END AS m FROM readable WHERE json_type(j) = 'OBJECT'),
tops AS (SELECT raw_id, json_extract(m, '$.doc_items') AS list FROM meta WHERE json_type(m) = 'OBJECT'),
items(raw_id, path, item) AS (
  SELECT raw_id, pos, json_extract(list, '$."' || pos || '"') FROM (SELECT raw_id, list, {_members("list")} FROM tops WHERE json_type(list) = 'OBJECT')
  UNION ALL
  SELECT raw_id, pos, json_extract(list, '$[' || pos || ']') FROM (SELECT raw_id, list, {_members("list")} FROM tops WHERE json_type(list) = 'ARRAY')
  UNION ALL
  SELECT raw_id, path || '/' || pos, json_extract(kids, '$[' || pos || ']') FROM (
    SELECT raw_id, path, kids, {_members("kids")} FROM (
      SELECT raw_id, path, json_extract(item, '$.children') AS kids FROM items) WHERE json_type(kids) = 'ARRAY'))
SELECT raw_id, path AS item_path, unnest(CASE json_type(item, '$.prov') WHEN 'OBJECT' THEN [0]
  WHEN 'ARRAY' THEN CASE WHEN json_array_length(item, '$.prov') = 0 THEN [-1]
                         ELSE list_transform(range(CAST(json_array_length(item, '$.prov') AS BIGINT)), lambda k: k::INT) END
  ELSE [-1] END) AS prov_no FROM items WHERE json_type(item) = 'OBJECT'"""


CLAUSE_REFERENCES = f"""WITH n AS (
  SELECT filename AS doc_id, source_chunk_id AS chunk_id, unnest([regexp_extract({collapse("target")}, '{_TARGET}', 1), regexp_extract({collapse("target")}, '{_TARGET}', 2)]) AS dst
  FROM contract_references WHERE regexp_matches({collapse("target")}, '{_TARGET}')),
l AS (SELECT filename AS doc_id, regexp_replace({strip("locator")}, '[.]$', '') AS locator, chunk_ids FROM document_sections WHERE locator IS NOT NULL),
s AS (SELECT doc_id, locator AS src, unnest(chunk_ids) AS chunk_id FROM l)
SELECT DISTINCT doc_id, 'Clause' AS src_type, src, 'REFERENCES' AS label, 'Clause' AS dst_type, dst
FROM n JOIN s USING (doc_id, chunk_id) WHERE dst <> '' AND EXISTS (SELECT 1 FROM l WHERE l.doc_id = n.doc_id AND l.locator = n.dst)"""
CHUNK_BOUNDS = """SELECT filename AS doc_id, 'chunk_index 20 is out of range: the document has ' || (max(chunk_id) + 1) || ' chunks.' AS error
  FROM chunks GROUP BY filename HAVING max(chunk_id) < 20"""
