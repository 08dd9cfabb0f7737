"""DuckDB SQL that gives the same rows as the queries of the core library."""

from __future__ import annotations

from lectern.functions.text import STOP_WORDS
from lectern.operators import journal

_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
_WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NWS = _WS.replace("[", "[^", 1)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


_CHUNKS = "chunks AS MATERIALIZED (SELECT id, any_value(doc_name) AS doc_name, any_value(text) AS text, any_value(char_count) AS char_count, any_value(page) AS page FROM chunk_metadata GROUP BY id)"
_NAMES = """
names AS MATERIALIZED (
  SELECT doc_name,
    coalesce((SELECT arg_min(multiplier, ord) FROM authority_tiers WHERE multiplier IS NOT NULL AND contains(lower(doc_name), lower(pattern))), 1.0) AS boost,
    coalesce((SELECT arg_min(author, ord) FROM author_map WHERE author IS NOT NULL AND contains(lower(doc_name), lower(pattern))), 'Unknown') AS author
  FROM (SELECT DISTINCT doc_name FROM chunk_metadata WHERE doc_name IS NOT NULL))"""
_BOOST = "boosts AS MATERIALIZED (SELECT c.id, c.doc_name, coalesce(n.boost, 1.0) AS boost FROM chunks c LEFT JOIN names n USING (doc_name))"


def _words(table: str, key: str, text: str, least: int = 3) -> str:
    return f"""(SELECT {key} AS id, w, row_number() OVER (PARTITION BY {key} ORDER BY i) AS n FROM (
      SELECT {key}, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT {key}, regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}_]+') AS a FROM {table}))
      WHERE length(w) >= {least} AND w NOT IN {_STOP})"""


def _terms(name: str, table: str, key: str, text: str) -> str:
    """Words of two characters and more, and pairs of neighbours, with their number."""
    return f"""{name}_w AS MATERIALIZED {_words(table, key, text, 2)},
{name} AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (
  SELECT id, w AS term FROM {name}_w UNION ALL
  SELECT id, w || ' ' || nxt FROM (SELECT id, w, lead(w) OVER (PARTITION BY id ORDER BY n) AS nxt FROM {name}_w) WHERE nxt IS NOT NULL) GROUP BY 1, 2)"""


_TFIDF = f"""
{_terms("posted", "chunks", "id", "text")},
vocab AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, ln((1e0 + (SELECT count(*) FROM chunks)) / (1e0 + count(*))) + 1e0 AS idf
  FROM posted GROUP BY term HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 8000),
cells AS (SELECT id, term, (1e0 + ln(tf)) * idf AS w FROM posted JOIN vocab USING (term)),
weights AS MATERIALIZED (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM cells)"""
_QTFIDF = f"""
{_terms("qposted", "eval_cases", "id", "prompt")},
qcells AS (SELECT id, term, (1e0 + ln(tf)) * idf AS w FROM qposted JOIN vocab USING (term)),
qweights AS MATERIALIZED (SELECT id AS query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS q FROM qcells),
raw AS MATERIALIZED (SELECT query_id::BIGINT AS query_id, id, sum(weight * q) AS score FROM weights JOIN qweights USING (term) GROUP BY 1, 2)"""
_BM25 = f"""
bw AS MATERIALIZED {_words("chunks", "id", "text")},
bp AS MATERIALIZED (SELECT id, w AS term, count(*) AS tf FROM bw GROUP BY 1, 2),
bl AS (SELECT id, sum(tf) AS dl FROM bp GROUP BY 1),
bt AS (SELECT term, ln((SELECT count(*) FROM chunks) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS raw FROM bp GROUP BY 1),
bi AS (SELECT term, CASE WHEN raw < 0 THEN 0.25e0 * (SELECT avg(raw) FROM bt) ELSE raw END AS idf FROM bt),
bq AS (SELECT id AS query_id, w AS term, count(*) AS q FROM {_words("eval_cases", "id", "prompt")} GROUP BY 1, 2),
bscore AS MATERIALIZED (SELECT query_id::BIGINT AS query_id, id, sum(q * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / ((SELECT sum(dl) FROM bl)::DOUBLE / (SELECT count(*) FROM chunks))))) AS score
  FROM bp JOIN bl USING (id) JOIN bi USING (term) JOIN bq USING (term) GROUP BY 1, 2)"""


def _top(source: str, k: int, tie: str, columns: str = "id", boost: bool = True) -> str:
    """Ranked rows of ``source (query_id, id, score)``."""
    score = "score * boost" if boost else "score"
    joined = f"{source} JOIN boosts USING (id)" if boost else source
    return f"""(SELECT query_id, {columns}, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, {tie}) AS rank
      FROM (SELECT *, {score} AS s FROM {joined}) WHERE s > 0 QUALIFY rank <= {k})"""


_KEYWORD = rf"""
kq AS (SELECT id::BIGINT AS query_id, lower(coalesce(prompt, '')) AS q FROM eval_cases),
kt AS (
  SELECT query_id, 'p' || i AS term_no, true AS phrase, v AS variant FROM (SELECT query_id, unnest(regexp_extract_all(q, '"([^"]+)"', 1)) AS v, generate_subscripts(regexp_extract_all(q, '"([^"]+)"', 1), 1) AS i FROM kq)
  UNION ALL
  SELECT DISTINCT query_id, 'w' || i, false, unnest(list_filter([w,
      CASE WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] END, CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3] END, CASE WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-2] END,
      CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' END, CASE WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] END, CASE WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] END], lambda x: x IS NOT NULL))
  FROM (SELECT query_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT query_id, regexp_split_to_array(regexp_replace(q, '"[^"]+"', '', 'g'), '{_WS}+') AS a FROM kq))
  WHERE length(w) > 2 AND w NOT IN {_STOP}),
kv AS MATERIALIZED (SELECT DISTINCT variant FROM kt),
kc AS MATERIALIZED (SELECT id, variant, ((length(low) - length(replace(low, variant, ''))) // length(variant))::BIGINT AS n FROM (SELECT id, lower(text) AS low FROM chunks) JOIN kv ON contains(low, variant)),
kh AS (SELECT query_id, id, term_no, phrase, max(n) AS n FROM kc JOIN kt USING (variant) GROUP BY 1, 2, 3, 4),
kp AS (SELECT query_id, count(DISTINCT term_no) AS phrases FROM kt WHERE phrase GROUP BY 1),
ks AS (SELECT query_id, id, sum(CASE WHEN phrase THEN 3 * n ELSE n END)::BIGINT AS hits, count(*) FILTER (WHERE phrase) AS found FROM kh GROUP BY 1, 2),
kb AS (SELECT ks.query_id, b.doc_name, ks.id, hits, hits * boost AS score, boost, min(ks.id) OVER (PARTITION BY ks.query_id, b.doc_name) AS first FROM ks LEFT JOIN kp USING (query_id) JOIN boosts b ON b.id = ks.id WHERE found = coalesce(phrases, 0)),
kd AS (SELECT * FROM kb QUALIFY row_number() OVER (PARTITION BY query_id, doc_name ORDER BY round(score, 9) DESC, id) = 1),
keyword AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank FROM kd WHERE score > 0 QUALIFY rank <= 15)"""
_BASE = f"WITH {_CHUNKS}, {_NAMES}, {_BOOST}"
_SEM = f"sem AS MATERIALIZED {_top('raw', 15, 'id DESC', 'id, boost')}"

def _runs(k: int | None, width: int = 1) -> str:
    """Hits of every run (``k`` at most), the chunks up to ``width`` places beside them, and both by document."""
    return f"""
hits AS MATERIALIZED (SELECT run_id AS query_id, id, relevance_score AS score, row_number() OVER (PARTITION BY run_id ORDER BY round(relevance_score, 9) DESC, result_id) AS rank
  FROM (SELECT DISTINCT result_id, run_id, id, relevance_score FROM results) WHERE relevance_score > 0 AND NOT isnan(relevance_score) AND run_id IS NOT NULL {f"QUALIFY rank <= {k}" if k else ""}),
placed AS MATERIALIZED (SELECT id, doc_name, text, row_number() OVER (PARTITION BY doc_name ORDER BY id) AS no FROM chunks WHERE doc_name IS NOT NULL),
asked AS (SELECT h.query_id, h.rank, h.id, p.doc_name, p.no, unnest(range(-{width}, {width} + 1)) AS "offset" FROM hits h JOIN placed p USING (id)),
windows AS MATERIALIZED (SELECT a.query_id, a.rank, a.id, a."offset"::INT AS "offset", b.id AS near_id, b.text AS near_text, a.doc_name FROM asked a JOIN placed b ON b.doc_name = a.doc_name AND b.no = a.no + a."offset"),
firsts AS (SELECT query_id, doc_name, near_text, rank, "offset" FROM windows QUALIFY row_number() OVER (PARTITION BY query_id, doc_name, near_text ORDER BY rank, "offset") = 1),
docs AS (SELECT query_id, doc_name, min(rank * 10 + "offset" + {width}) AS spot, list(near_text ORDER BY rank, "offset") FILTER (WHERE near_text IS NOT NULL) AS texts, count(*) AS n FROM firsts GROUP BY 1, 2),
grp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot, doc_name) AS doc_ord, row_number() OVER (PARTITION BY query_id ORDER BY doc_name) AS ref FROM docs)"""


def _context(numbered: bool) -> str:
    head = "'### [' || ref || '] ' || doc_name" if numbered else "'### ' || doc_name"
    return f"""ctx AS MATERIALIZED (SELECT query_id, count(*) AS docs, sum(n)::BIGINT AS chunks,
  string_agg({head} || chr(10) || coalesce(array_to_string(texts, chr(10) || '…' || chr(10)), ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_ord) AS context,
  string_agg(ref || '. ' || doc_name, chr(10) ORDER BY ref) AS refs FROM grp GROUP BY 1)"""


_SENT = rf"""
segs AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\[PDF_PAGE:[0-9]+\]')) AS seg, unnest(list_concat([NULL], regexp_extract_all(text, '\[PDF_PAGE:([0-9]+)\]', 1)))::INT AS page,
  generate_subscripts(regexp_split_to_array(text, '\[PDF_PAGE:[0-9]+\]'), 1) AS sn FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, page, sn, unnest(a) AS s, generate_subscripts(a, 1) AS k FROM (SELECT *, string_split(regexp_replace(seg, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)) AS a FROM segs)),
sents AS MATERIALIZED (SELECT doc_id, page, s, length(s)::INT AS len, row_number() OVER (PARTITION BY doc_id ORDER BY sn, k) - 1 AS n FROM pieces WHERE regexp_matches(s, '{_NWS}'))"""
_PACK = f"""
pre AS MATERIALIZED (SELECT *, sum(len + 1) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM sents),
os AS MATERIALIZED (SELECT a.doc_id, a.n, min(b.n) AS o FROM pre a JOIN pre b ON b.doc_id = a.doc_id AND b.n < a.n AND b.n >= a.n - 200 AND (a.p - a.len - 1) - (b.p - b.len - 1) - 1 < 200 GROUP BY 1, 2),
step AS MATERIALIZED (SELECT p.doc_id, p.n, p.len, p.p, coalesce(os.o, p.n) AS o FROM pre p LEFT JOIN os USING (doc_id, n)),
fold AS (
  SELECT doc_id, n, 0::BIGINT AS s, len::BIGINT AS cur, NULL::BIGINT AS out_s FROM step WHERE n = 0
  UNION ALL
  SELECT t.doc_id, t.n, CASE WHEN f.cur + t.len + 1 > 1500 THEN greatest(t.o, f.s) ELSE f.s END,
    CASE WHEN f.cur + t.len + 1 > 1500 THEN t.p - (SELECT x.p - x.len - 1 FROM step x WHERE x.doc_id = t.doc_id AND x.n = greatest(t.o, f.s)) ELSE f.cur + t.len + CASE WHEN f.cur <> 0 THEN 1 ELSE 0 END END,
    CASE WHEN f.cur + t.len + 1 > 1500 THEN f.s END
  FROM fold f JOIN step t ON t.doc_id = f.doc_id AND t.n = f.n + 1),
spans AS (SELECT doc_id, out_s AS s, n - 1 AS e FROM fold WHERE out_s IS NOT NULL UNION ALL SELECT doc_id, s, n FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1),
packs AS MATERIALIZED (SELECT p.doc_id, p.s, p.e, {_strip("string_agg(t.s, ' ' ORDER BY t.n)")} AS text, any_value(t.page) FILTER (WHERE t.n = p.s) AS page FROM spans p JOIN sents t ON t.doc_id = p.doc_id AND t.n BETWEEN p.s AND p.e GROUP BY 1, 2, 3)"""

_HEAD = r"\n(## Section [0-9]+ – [^\n]+)\n"
_SECT = rf"""
parts AS (SELECT doc_id, unnest(a) AS part, generate_subscripts(a, 1) AS seq FROM (SELECT doc_id, string_split(regexp_replace(text, '{_HEAD}', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS a FROM documents WHERE text IS NOT NULL)),
cut AS (SELECT doc_id, seq, string_split(part, chr(2))[1] AS heading, substr(part, instr(part, chr(2)) + 1) AS body FROM parts WHERE seq > 1),
sections AS MATERIALIZED (SELECT doc_id, seq, regexp_replace({_strip(f"regexp_replace(regexp_replace(heading, '^## Section [0-9]+ – ', ''), '{_WS}*' || chr(92) || '(' || chr(92) || '[[0-9:]+' || chr(92) || ']' || chr(92) || ')', '', 'g')")}, '[.]$', '') AS section_title, {_strip("body")} AS body FROM cut)"""

_PAGES = r"""
pg AS MATERIALIZED (SELECT doc_name, page, string_agg(text, chr(10) ORDER BY id) AS text FROM chunks WHERE page IS NOT NULL AND doc_name IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
""" + rf"""
ln AS (SELECT doc_name, page, l, row_number() OVER (PARTITION BY doc_name, page ORDER BY i) AS n FROM (SELECT doc_name, page, {_strip("unnest(string_split(text, chr(10)))")} AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pg) WHERE l <> ''),
nums AS (SELECT *, coalesce(nullif(regexp_extract(l, '^([0-9]{{1,4}})$', 1), ''), nullif(regexp_extract(l, '^([0-9]{{1,4}})(?:\t| *\|)', 1), ''), nullif(regexp_extract(l, '\| *([0-9]{{1,4}})$', 1), ''))::INT AS near, nullif(regexp_extract(l, '^([0-9]{{1,4}})$', 1), '')::INT AS far FROM ln),
found AS (SELECT doc_name, page, coalesce(arg_min(near, n) FILTER (WHERE n <= 6 AND near IS NOT NULL), arg_min(far, n) FILTER (WHERE far IS NOT NULL)) AS journal_page FROM nums GROUP BY 1, 2),
mapped AS MATERIALIZED (SELECT doc_name AS issue, journal_page, min(page) AS pdf_page FROM found WHERE journal_page IS NOT NULL GROUP BY 1, 2),
content AS MATERIALIZED (SELECT * FROM mapped WHERE journal_page < 1000)"""


def _nearest(asked: str) -> str:
    return f"(SELECT a.issue, a.page, (SELECT arg_min(m.pdf_page, abs(m.journal_page - a.page) * 2 + CASE WHEN m.journal_page > a.page THEN 1 ELSE 0 END) FROM content m WHERE m.issue = a.issue AND abs(m.journal_page - a.page) <= 7) AS pdf_page FROM {asked} a)"


_EXTENTS = f"""
starts AS MATERIALIZED (SELECT issue, journal_page AS ord, journal_page AS page FROM content),
lasts AS (SELECT issue, max(journal_page) AS lastp, max(pdf_page) AS pages FROM content GROUP BY 1),
ends AS (SELECT s.issue, s.ord, s.page AS start_page, coalesce(lead(s.page) OVER (PARTITION BY s.issue ORDER BY s.ord) - 1, l.lastp) AS end_page, pages FROM starts s JOIN lasts l USING (issue)),
fs AS MATERIALIZED {_nearest("(SELECT DISTINCT issue, start_page AS page FROM ends)")},
fe AS MATERIALIZED {_nearest("(SELECT DISTINCT issue, end_page AS page FROM ends)")},
extents AS MATERIALIZED (SELECT e.issue, e.ord, e.start_page, e.end_page, fs.pdf_page AS start_pdf, least(CASE WHEN fe.pdf_page >= fs.pdf_page THEN fe.pdf_page ELSE fs.pdf_page + 30 END, pages) AS end_pdf
  FROM ends e JOIN fs ON fs.issue = e.issue AND fs.page = e.start_page LEFT JOIN fe ON fe.issue = e.issue AND fe.page = e.end_page WHERE fs.pdf_page IS NOT NULL)"""
_TOC = r"""
toc AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '\t([0-9]{1,4})(\n|$)', chr(9) || chr(10) || '\1\2', 'g'), chr(10)) AS a FROM documents WHERE starts_with(text, 'CONTENTS' || chr(10))))"""
_LABELS = "(" + ", ".join(f"'{x}'" for x in journal.SECTION_LABELS) + ")"
_CREDENTIAL = r"\b(?:" + "|".join(journal.CREDENTIALS) + r")\b"


def _label(x: str) -> str:
    return f"(upper({_strip(x)}) IN {_LABELS} OR regexp_matches(upper({_strip(x)}), '^{journal.PANEL}$'))"


def _last_name(x: str) -> str:
    one = f"string_split(regexp_replace({_strip(x)}, '^(?:Reviewed by:? ?|Review: ?|Reviewer: ?|Presenter: ?|Introduction by:? ?|Introduction: ?)', ''), ' and ')[1]"
    bare = _collapse(f"regexp_replace(regexp_replace({one}, ',?\\s*{_CREDENTIAL}', '', 'g'), '[,;\\s]+$', '')")
    return f"CASE WHEN {x} IS NULL THEN 'Unknown' ELSE coalesce(nullif(regexp_replace(string_split({bare}, ' ')[-1], '^[.,;]+|[.,;]+$', '', 'g'), ''), 'Unknown') END"


def _file_name(issue: str, author: str, title: str) -> str:
    words = f"list_filter(string_split({title}, ' '), lambda w: w <> '')"
    kept = f"CASE WHEN lower({words}[1]) IN ('a', 'an', 'the', 'on') THEN {words}[2:] ELSE {words} END"
    return _collapse(f"regexp_replace('Journal ' || {issue} || ' ' || {author} || ' ' || coalesce(array_to_string(({kept})[1:5], ' '), '') || '.txt', '[<>:\"/\\\\|?*\\x00-\\x1F''‘’]', '', 'g')")


_TOC_TOKENS = rf"""{_TOC},
tk AS MATERIALIZED (SELECT doc_id, pos, t AS type, CASE WHEN t = 'HEADER' THEN upper({_strip("line")}) WHEN t <> 'PAGE' THEN {_strip("line")} END AS text_val, CASE WHEN t = 'PAGE' THEN {_strip("line")}::INT END AS page_val
  FROM (SELECT *, CASE WHEN regexp_matches({_strip("line")}, '^[0-9]{{1,4}}$') THEN 'PAGE' WHEN {_label("line")} THEN 'HEADER' WHEN ends_with(line, chr(9)) THEN 'TAB' ELSE 'TEXT' END AS t FROM toc WHERE {_strip("line")} <> ''))"""
_TOC_ENTRIES = rf"""{_TOC_TOKENS},
ts AS (SELECT *, coalesce(lead(type) OVER (PARTITION BY doc_id ORDER BY pos) = 'PAGE', false) AS at_page,
  first_value(CASE WHEN type <> 'TEXT' THEN {{'t': type, 'p': page_val}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM tk),
tb AS (SELECT *, coalesce(type = 'TAB' AND nxt.t = 'PAGE', false) AS starts FROM ts),
tg AS (SELECT *, sum((starts OR type = 'HEADER')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM tb),
tr AS (SELECT *, first_value(starts) OVER (PARTITION BY doc_id, block ORDER BY pos) AS opens, CASE WHEN NOT starts AND type IN ('TAB', 'TEXT') THEN
  CASE WHEN regexp_matches(text_val, '^(?:Reviewed by|Review|Reviewer)(?::| )') THEN 0 WHEN regexp_matches(text_val, '{_CREDENTIAL}') THEN 1 WHEN type = 'TEXT' THEN 2 END END AS r FROM tg),
ta AS (SELECT doc_id, block, arg_min(text_val, r * 100000 + pos) AS author, arg_min(pos, r * 100000 + pos) AS author_pos FROM tr WHERE opens AND r IS NOT NULL GROUP BY 1, 2),
tf AS (SELECT tr.doc_id, tr.block, min(pos) AS pos, any_value(author) AS author, min(CASE WHEN starts THEN nxt.p END) AS page,
  min(CASE WHEN starts AND at_page AND regexp_matches(text_val, '{journal._EDITOR}') THEN text_val END) AS editor,
  {_collapse("coalesce(string_agg(text_val, ' ' ORDER BY pos) FILTER (WHERE type = 'TAB' AND r IS NULL AND pos < coalesce(author_pos, 1073741824)), '')")} AS title
  FROM tr LEFT JOIN ta USING (doc_id, block) WHERE opens GROUP BY 1, 2),
entries AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, CASE WHEN editor IS NOT NULL THEN 'FROM THE EDITOR' ELSE title END AS title, {_last_name("coalesce(editor, author)")} AS author, page
  FROM tf WHERE editor IS NOT NULL OR title <> '' AND NOT {_label("title")})"""
_OCR = rf"""
ol AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (SELECT doc_id, {_strip("unnest(a)")} AS l, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, string_split(replace(text, chr(9), chr(10)), chr(10)) AS a FROM documents WHERE starts_with(text, 'CONTENTS' || chr(10)))) WHERE l <> ''),
oc AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(l, '^[0-9]{{1,4}}$') AND NOT (l::INT BETWEEN 1990 AND 2029) THEN l::INT END AS n, {_label("regexp_replace(l, '_+$', '')")} AS label FROM (SELECT * FROM ol)),
op AS (SELECT a.doc_id, a.pos, a.n,
  (SELECT coalesce(max(b.pos), a.pos - 5) FROM oc b WHERE b.doc_id = a.doc_id AND b.pos BETWEEN a.pos - 4 AND a.pos - 1 AND (b.n IS NOT NULL OR b.label)) AS low,
  (SELECT coalesce(min(b.pos), a.pos + 6) FROM oc b WHERE b.doc_id = a.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 AND (b.n IS NOT NULL OR b.label)) AS high FROM oc a WHERE a.n IS NOT NULL),
ot AS (SELECT p.doc_id, p.pos, p.n, arg_max(b.l, b.pos) FILTER (WHERE b.pos < p.pos AND length(b.l) > 2 AND NOT starts_with(b.l, '-')) AS title,
  arg_min(b.l, b.pos) FILTER (WHERE b.pos > p.pos AND (regexp_matches(b.l, '{_CREDENTIAL}') OR regexp_matches(b.l, '^(?:Reviewed by|Review|Reviewer)(?::| )'))) AS author
  FROM op p JOIN oc b ON b.doc_id = p.doc_id AND b.pos > p.low AND b.pos < p.high GROUP BY 1, 2, 3)"""
_TRANSCRIPT = rf"""
raw_t AS (SELECT doc_name AS stem, regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1) AS m, regexp_replace(text, '(?s)^---\n.*?\n---\n', '') AS body FROM documents WHERE text IS NOT NULL),
cleaned AS (SELECT stem, m, {_strip("regexp_replace(regexp_replace(replace(" + _strip("body") + ", chr(10) || '---' || chr(10), chr(10) || chr(10)), '" + _WS + r"*\(\[[0-9:]+\]\)', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM raw_t WHERE regexp_matches(body, '(?m)^## Section [0-9]+')),
heads AS (SELECT stem, text, CASE WHEN regexp_matches(m, '(?m)^Title:') THEN regexp_extract(m, '(?m)^Title: *"?([^"\n]*)"?$', 1) ELSE stem END AS title,
  nullif(regexp_extract(m, '(?m)^Presenter: *"?([^"\n]*)"?$', 1), '') AS presenter, nullif(nullif(regexp_extract(m, '(?m)^Lecture date: *"?([^"\n]*)"?$', 1), ''), '1980-01-01') AS date FROM cleaned)"""


ORACLES: dict[str, str] = {
    "chunk_sentences": f"WITH {_SENT} SELECT doc_id, n, len AS characters, page FROM sents",
    "chunk_pack": f"WITH RECURSIVE {_SENT}, {_PACK} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1)::INT AS seq, page, length(text) AS characters, md5(text) AS digest FROM packs",
    "section_chunks": f"WITH {_SECT} SELECT doc_id, section_title, length(t) AS characters, md5(t) AS digest FROM (SELECT doc_id, section_title, '[' || section_title || ']' || chr(10) || chr(10) || body AS t FROM sections WHERE body <> '')",
    "chunk_table": f"""WITH RECURSIVE {_SENT}, {_PACK}, {_SECT},
        both_ways AS (
          SELECT p.doc_id, p.e AS seq, '' AS section_title, p.text, p.page FROM packs p JOIN documents d USING (doc_id) WHERE NOT regexp_matches(d.text, '(?m)^## Section [0-9]+')
          UNION ALL SELECT s.doc_id, s.seq, s.section_title, '[' || s.section_title || ']' || chr(10) || chr(10) || s.body, NULL FROM sections s JOIN documents d USING (doc_id) WHERE s.body <> '' AND regexp_matches(d.text, '(?m)^## Section [0-9]+')),
        numbered AS (SELECT b.*, d.doc_name, row_number() OVER (ORDER BY d.kind = 'pdf' NULLS FIRST, d.path NULLS FIRST, b.doc_id, b.seq) - 1 AS id FROM both_ways b JOIN documents d USING (doc_id))
        SELECT id, doc_name, section_title, length(text) AS char_count, page, row_number() OVER (PARTITION BY doc_name ORDER BY id) AS chunk_pos, count(*) OVER (PARTITION BY doc_name) AS doc_chunk_count, md5(text) AS digest FROM numbered""",
    "chunk_positions": "SELECT id, CASE WHEN page IS NOT NULL THEN 'p.' || page WHEN chunk_pos > 0 AND doc_chunk_count > 1 THEN '~' || round_even(chunk_pos::DOUBLE / doc_chunk_count * 100, 0)::BIGINT || '%' END AS badge FROM (SELECT id, any_value(page) AS page, any_value(chunk_pos) AS chunk_pos, any_value(doc_chunk_count) AS doc_chunk_count FROM chunk_metadata GROUP BY id)",
    "corpus_stats": f"WITH {_CHUNKS} SELECT count(*) AS chunks, count(DISTINCT doc_name) AS documents, sum(char_count)::BIGINT AS characters FROM chunks",
    "list_documents": "SELECT DISTINCT doc_name FROM chunk_metadata WHERE doc_name IS NOT NULL",
    "doc_catalogue": f"{_BASE} SELECT c.doc_name, count(*) AS chunks, sum(char_count)::BIGINT AS characters, min(id) AS first_id, any_value(author) AS author, any_value(boost) AS boost FROM chunks c JOIN names USING (doc_name) GROUP BY 1",
    "known_authors": "SELECT author, min(ord) AS ord FROM author_map WHERE author IS NOT NULL GROUP BY 1",
    "tokenize_bm25": f"SELECT d.doc_id, count(w) AS words, md5(coalesce(string_agg(w, ' ' ORDER BY n), '')) AS digest FROM documents d LEFT JOIN {_words('documents', 'doc_id', 'text')} t ON t.id = d.doc_id GROUP BY 1",
    "term_df": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM (SELECT id, w AS term, count(*) AS tf FROM {_words('documents', 'doc_id', 'text')} GROUP BY 1, 2) GROUP BY 1",
    "tfidf_vocab": f"WITH {_CHUNKS}, {_TFIDF} SELECT term, df, total, round(idf, 6) AS idf FROM vocab",
    "tfidf_weights": f"WITH {_CHUNKS}, {_TFIDF} SELECT id, count(*) AS terms, round(sum(weight), 6) AS total FROM weights GROUP BY 1",
    "embedded_chunks": f"""WITH {_CHUNKS}, t AS (SELECT id, coalesce(text, '') AS t FROM chunks)
        SELECT id AS chunk_id, length(t)::DOUBLE AS characters, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS spaces, (length(t) - length(replace(t, chr(10), '')))::DOUBLE AS breaks FROM t""",
    "stale_embeddings": "SELECT id AS key, 'embedding' AS missing FROM (SELECT DISTINCT id FROM chunk_metadata) WHERE id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'chunk' FROM embeddings WHERE vec_id NOT IN (SELECT id FROM chunk_metadata)",
    "excerpts": f"WITH {_CHUNKS} SELECT id, {_collapse('substr(text, 1, 220)')} AS excerpt FROM chunks",
    "formatted_chunks": rf"""WITH {_CHUNKS}, body AS (SELECT id, regexp_replace(text, '^\[[^\n\]]+\]\n\n', '') AS b FROM chunks),
        par AS (SELECT id, {_strip("regexp_replace(replace(unnest(a), chr(10), ' '), ' {2,}', ' ', 'g')")} AS p, generate_subscripts(a, 1) AS i FROM (SELECT id, regexp_split_to_array(b, '\n{{2,}}') AS a FROM body))
        SELECT b.id, CASE WHEN any_value(b.b) IS NOT NULL THEN coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (WHERE p <> ''), '') END AS body FROM body b LEFT JOIN par USING (id) GROUP BY 1""",
    "view_source": f"WITH {_CHUNKS} SELECT doc_name, md5(text) AS digest, id FROM chunks WHERE doc_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_name ORDER BY id) = 1",
    "frontmatter": r"""SELECT doc_id, regexp_extract(b, '(?m)^Title: *"?([^"\n]*)"?$', 1) AS title, regexp_extract(b, '(?m)^Presenter: *"?([^"\n]*)"?$', 1) AS presenter, regexp_extract(b, '(?m)^Lecture date: *"?([^"\n]*)"?$', 1) AS date
        FROM (SELECT doc_id, regexp_extract(text, '(?s)^---\n(.*?)\n---\n', 1) AS b FROM documents WHERE starts_with(text, '---' || chr(10)))""",
    "toc_tokens": f"WITH {_TOC_TOKENS} SELECT * FROM tk",
    "toc_entries": f"WITH {_TOC_ENTRIES} SELECT * FROM entries",
    "toc_files": f"WITH {_TOC_ENTRIES} SELECT doc_id, ord, {_file_name('doc_id', 'author', 'title')} AS file_name FROM entries",
    "ocr_entries": f"""WITH {_OCR} SELECT doc_id, n AS page, t AS title, {_last_name('author')} AS author
        FROM (SELECT *, {_strip("regexp_replace(regexp_replace(title, '^[''" + chr(34) + "]+', ''), '_+$', '')")} AS t FROM ot) WHERE t <> ''""",
    "transcripts": rf"""WITH {_TRANSCRIPT} SELECT stem, substr({_collapse("regexp_replace(concat_ws(' - ', title, presenter, date), '[<>:" + chr(34) + "/\\\\|?*]', '', 'g')")}, 1, 200) || '.txt' AS file_name,
        length(regexp_replace(text, '(?m)^## Section [0-9]+', chr(1), 'g')) - length(replace(regexp_replace(text, '(?m)^## Section [0-9]+', chr(1), 'g'), chr(1), '')) AS sections, len(regexp_extract_all(text, '{_NWS}+')) AS words, md5(text) AS digest FROM heads""",
    "transcript_files": rf"""WITH {_TRANSCRIPT} SELECT file_name, count(*) AS copies, md5(arg_max(text, stem || ' ' || md5(text))) AS digest FROM (SELECT stem, text, substr({_collapse("regexp_replace(concat_ws(' - ', title, presenter, date), '[<>:" + chr(34) + "/\\\\|?*]', '', 'g')")}, 1, 200) || '.txt' AS file_name FROM heads) GROUP BY 1""",
    "page_map": f"WITH {_CHUNKS}, {_PAGES} SELECT * FROM mapped",
    "nearest_page": f"WITH {_CHUNKS}, {_PAGES}, asked AS (SELECT issue, unnest(generate_series(a, b))::INT AS page FROM (SELECT issue, min(journal_page) AS a, max(journal_page) AS b FROM content GROUP BY 1)) SELECT * FROM {_nearest('asked')}",
    "article_extents": f"WITH {_CHUNKS}, {_PAGES}, {_EXTENTS} SELECT * FROM extents",
    "article_text": f"""WITH {_CHUNKS}, {_PAGES}, {_EXTENTS} SELECT e.issue, e.ord, count(*) AS pages, md5(string_agg(replace(p.text, chr(173), ''), chr(10) || chr(10) ORDER BY p.page)) AS digest
        FROM extents e JOIN pg p ON p.doc_name = e.issue AND p.page BETWEEN e.start_pdf AND e.end_pdf WHERE {_strip("replace(p.text, chr(173), '')")} <> '' GROUP BY 1, 2""",
    "article_records": rf"""WITH {_CHUNKS}, {_PAGES}, {_EXTENTS},
        atext AS (SELECT e.issue, e.ord, string_agg(replace(p.text, chr(173), ''), chr(10) || chr(10) ORDER BY p.page) AS text
          FROM extents e JOIN pg p ON p.doc_name = e.issue AND p.page BETWEEN e.start_pdf AND e.end_pdf WHERE {_strip("replace(p.text, chr(173), '')")} <> '' GROUP BY 1, 2),
        titled AS (SELECT s.issue, s.ord, {_collapse(r"coalesce(regexp_extract(text, '([^ \t\n\r\f\x0B][^\n]{0,40})', 1), '')")} AS title, coalesce(text, '') AS text, start_page, end_page FROM starts s LEFT JOIN extents USING (issue, ord) LEFT JOIN atext USING (issue, ord))
        SELECT issue, ord, {_file_name('issue', "'Unknown'", 'title')} AS file_name, length(r) AS characters, md5(r) AS digest, CASE WHEN start_page IS NULL THEN 'unmapped' WHEN {_strip('text')} = '' THEN 'empty' END AS warning
        FROM (SELECT *, 'Journal Vol. ' || issue || chr(10) || 'Title: ' || title || chr(10) || 'Author: Unknown' || chr(10) || 'Pages: ' || start_page || '-' || end_page || chr(10) || chr(10) || text AS r FROM titled)""",
    "issue_contents": f"""WITH {_CHUNKS}, {_PAGES}, firsts AS (SELECT doc_name, min(page) AS p FROM pg GROUP BY 1)
        SELECT doc_name AS issue, 'TAB' AS toc_format, length(t) AS characters, md5(t) AS digest FROM (SELECT f.doc_name, string_agg(text, chr(10) ORDER BY page) AS t FROM firsts f JOIN pg ON pg.doc_name = f.doc_name AND page BETWEEN p AND p + 1 WHERE p <= 500 GROUP BY 1)""",
    "index_metrics": f"""WITH {_CHUNKS}, {_TFIDF} SELECT (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT doc_name) FROM chunks) AS documents, (SELECT count(*) FROM vocab) AS features,
        (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings) > 0 AS has_embeddings, true AS has_bm25""",
    "stored_weights": f"""WITH {_CHUNKS}, {_BM25} SELECT term, count(*) AS chunks, round(sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / ((SELECT sum(dl) FROM bl)::DOUBLE / (SELECT count(*) FROM chunks))))), 5) AS total
        FROM bp JOIN bl USING (id) JOIN bi USING (term) GROUP BY 1""",
    "score_labels": f"""{_BASE}, {_TFIDF}, {_QTFIDF}, {_SEM}, {_KEYWORD},
        every AS (SELECT query_id, 'keyword' AS mode, rank, id, score, boost FROM keyword UNION ALL SELECT query_id, 'semantic', rank, id, score, boost FROM sem),
        store AS (SELECT id, any_value(page) AS page, any_value(chunk_pos) AS chunk_pos, any_value(doc_chunk_count) AS doc_chunk_count FROM chunk_metadata GROUP BY id)
        SELECT query_id, mode, rank, e.id, CASE WHEN mode = 'keyword' THEN round_even(round(score, 9) / boost, 0)::BIGINT || ' hits' || CASE WHEN boost > 1 THEN ' ×' || regexp_replace(boost::VARCHAR, '[.]0$', '') || ' ★' ELSE '' END
            ELSE round_even(round(score, 9) * 100, 0)::BIGINT || '%' || CASE WHEN boost > 1 THEN ' ★' ELSE '' END END AS label,
          CASE WHEN mode = 'keyword' THEN 'violet' WHEN round(score, 9) > 0.4 THEN 'green' WHEN round(score, 9) > 0.15 THEN 'amber' ELSE 'grey' END AS color,
          CASE WHEN page IS NOT NULL THEN 'p.' || page WHEN chunk_pos > 0 AND doc_chunk_count > 1 THEN '~' || round_even(chunk_pos::DOUBLE / doc_chunk_count * 100, 0)::BIGINT || '%' END AS badge FROM every e JOIN store s ON s.id = e.id""",
    "appendix": rf"""WITH {_CHUNKS}, {_runs(30, 2)},
        each_text AS (SELECT query_id, ref, doc_name, unnest(texts) AS t, generate_subscripts(texts, 1) AS k FROM grp),
        par AS (SELECT query_id, ref, k, {_strip("regexp_replace(replace(unnest(a), chr(10), ' '), ' {2,}', ' ', 'g')")} AS p, generate_subscripts(a, 1) AS i FROM (SELECT *, regexp_split_to_array(regexp_replace(t, '^\[[^
\]]+\]

', ''), '
{{2,}}') AS a FROM each_text)),
        one AS (SELECT query_id, ref, k, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (WHERE p <> ''), '') AS b FROM par GROUP BY 1, 2, 3),
        whole AS (SELECT query_id, ref, string_agg(b, chr(10) || chr(10) ORDER BY k) AS body FROM one GROUP BY 1, 2)
        SELECT g.query_id, g.ref, g.doc_name, length(coalesce(body, '')) AS characters, md5(coalesce(body, '')) AS digest FROM grp g LEFT JOIN whole w ON w.query_id = g.query_id AND w.ref = g.ref""",
    "eval_run": f"""{_BASE}, {_TFIDF}, {_QTFIDF}, t AS {_top('raw', 3, 'id DESC', 'id', False)},
        rows AS (SELECT query_id, count(*) AS n, string_agg('{{"rank":' || rank || ',"id":' || id || CASE WHEN doc_name IS NULL THEN '' ELSE ',"doc_name":' || to_json(doc_name)::VARCHAR END || ',"relevance_score":' || round(score, 4) || ',"relevance_percent":' || trunc(round(score, 9) * 100)::INT || '}}', ',' ORDER BY rank) AS j FROM t JOIN chunks USING (id) GROUP BY 1)
        SELECT c.id::BIGINT AS eval_id, '{{' || CASE WHEN prompt IS NULL THEN '' ELSE '"prompt":' || to_json(prompt)::VARCHAR || ',' END || '"num_results":' || coalesce(n, 0) || ',"results":[' || coalesce(j, '') || ']}}' AS result FROM eval_cases c LEFT JOIN rows r ON r.query_id = c.id""",
    "tier_rollup": f"{_BASE} SELECT author, boost, count(*) AS chunks, sum(char_count)::BIGINT AS characters, grouping(author, boost)::INT AS level FROM chunks JOIN names USING (doc_name) GROUP BY ROLLUP (author, boost)",
    "search_bm25": f"{_BASE}, {_BM25} SELECT query_id, rank, id, round(score, 6) AS score FROM {_top('bscore', 15, 'id DESC')}",
    "search_tfidf": f"{_BASE}, {_TFIDF}, {_QTFIDF} SELECT query_id, rank, id, round(score, 6) AS score FROM {_top('raw', 15, 'id DESC')}",
    "search_cli": f"{_BASE}, {_TFIDF}, {_QTFIDF} SELECT query_id, rank, id, round(score, 6) AS score, trunc(round(score, 9) * 100)::INT AS relevance_percent FROM {_top('raw', 5, 'id DESC', 'id', False)}",
    "search_keyword": f"{_BASE}, {_KEYWORD} SELECT query_id, rank, id, doc_name, hits, round(score, 6) AS score FROM keyword",
    "search_combined": f"""{_BASE}, {_TFIDF}, {_QTFIDF}, {_SEM}, {_KEYWORD},
        both_ways AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.id, k.id) AS id, coalesce(s.score, k.score) AS score, CASE WHEN s.id IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS mode, k.rank AS kr, s.rank AS sr
          FROM sem s FULL JOIN keyword k ON k.query_id = s.query_id AND k.id = s.id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, kr NULLS LAST, sr NULLS LAST) AS rank, id, round(score, 6) AS score, mode FROM both_ways QUALIFY rank <= 15""",
    "search_top_docs": f"""{_BASE}, {_TFIDF}, {_QTFIDF},
        r AS (SELECT query_id, doc_name, id, score, boost, row_number() OVER (PARTITION BY query_id, doc_name ORDER BY round(score, 9) DESC, id DESC) AS n, min(id) OVER (PARTITION BY query_id, doc_name) AS first FROM raw JOIN boosts USING (id) WHERE score > 0 AND doc_name IS NOT NULL),
        d AS (SELECT query_id, doc_name, max(id) FILTER (WHERE n = 1) AS id, sum(score) * any_value(boost) AS score, any_value(first) AS first FROM r WHERE n <= 3 GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first) AS rank, doc_name, id, round(score, 6) AS score FROM d QUALIFY rank <= 15""",
    "search_embedding": """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id DESC) AS rank, id, round(s, 6) AS score
        FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE s > 0 QUALIFY rank <= 15""",
    "search_hybrid": f"""{_BASE}, {_BM25}, b AS {_top('bscore', 60, 'id DESC')},
        vs AS (SELECT c.id::BIGINT AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) * coalesce(o.boost, 1.0) AS score FROM eval_cases c JOIN embeddings q ON q.vec_id = c.id, embeddings v LEFT JOIN boosts o ON o.id = v.vec_id),
        e AS {_top('vs', 60, 'id DESC', 'id', False)},
        f AS (SELECT coalesce(b.query_id, e.query_id) AS query_id, coalesce(b.id, e.id) AS id, coalesce(1e0 / (59 + b.rank), 0) + coalesce(1e0 / (59 + e.rank), 0) AS score FROM b FULL JOIN e ON b.query_id = e.query_id AND b.id = e.id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, round(score, 9) AS score, round(score / (2e0 / 60), 6) AS share FROM f QUALIFY rank <= 15""",
    "author_filter": f"{_BASE}, {_BM25}, t AS {_top('bscore', 30, 'id DESC')} SELECT query_id, rank, id, doc_name FROM t JOIN boosts USING (id) WHERE doc_name IN (SELECT doc_name FROM names WHERE author = (SELECT arg_min(author, ord) FROM author_map))",
    "context_window": f"WITH {_CHUNKS}, {_runs(None)} SELECT query_id, rank, id, \"offset\", near_id FROM windows",
    "context_group": f"WITH {_CHUNKS}, {_runs(None)} SELECT query_id, doc_name, doc_ord, n AS texts, md5(coalesce(array_to_string(texts, chr(10) || '…' || chr(10)), '')) AS digest FROM grp",
    "report_refs": f"WITH {_CHUNKS}, {_runs(30, 2)} SELECT query_id, doc_name, ref FROM grp",
    "prompt_rows": f"""WITH {_CHUNKS}, {_runs(30, 2)}, {_context(True)}
        SELECT query_id, length(p) AS characters, md5(p) AS digest FROM (SELECT c.query_id, 'Topic: ' || e.prompt || chr(10) || chr(10) || 'Sources (' || docs || '):' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'At least 800 words. Cite sources by number.' || chr(10) || chr(10) || 'References:' || chr(10) || refs || chr(10) AS p
        FROM ctx c JOIN eval_runs r ON r.run_id = c.query_id JOIN eval_cases e ON e.id = r.eval_id)""",
    "chat_messages": f"""WITH {_CHUNKS}, {_runs(12)}, {_context(False)}, l AS (SELECT eval_id, count(*) AS messages, arg_max(run_id, (run_at, run_id)) AS latest FROM eval_runs GROUP BY 1)
        SELECT l.eval_id AS session_id, messages, md5(CASE WHEN context IS NULL THEN e.prompt ELSE '[Retrieved ' || chunks || ' chunks from ' || docs || ' documents]' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || e.prompt END) AS last_digest
        FROM l JOIN eval_cases e ON e.id = l.eval_id LEFT JOIN ctx ON ctx.query_id = l.latest""",
    "chat_sources": f"WITH {_CHUNKS}, {_runs(12)} SELECT query_id, doc_name, {_collapse('substr(text, 1, 150)')} AS excerpt FROM (SELECT h.query_id, c.doc_name, arg_min({{'t': c.text}}, h.rank).t AS text FROM hits h JOIN chunks c USING (id) WHERE c.doc_name IS NOT NULL GROUP BY 1, 2)",
    "staged_merge": f"""{_BASE}, {_BM25}, {_KEYWORD}, fresh AS {_top('bscore', 15, 'id DESC')}
        SELECT query_id, id, source, rank FROM (SELECT query_id, id, 0 AS source, rank FROM keyword UNION ALL SELECT query_id, id, 1, rank FROM fresh) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY source, rank) = 1""",
    "cli_print": f"""{_BASE}, {_TFIDF}, {_QTFIDF}, t AS {_top('raw', 3, 'id DESC', 'id', False)}
        SELECT query_id, string_agg('Result ' || rank || ': ' || coalesce(doc_name, '') || chr(10) || 'Relevance: ' || trunc(round(score, 9) * 100)::INT || '%' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS printed FROM t JOIN chunks USING (id) GROUP BY 1""",
    "report_files": f"""WITH {_CHUNKS}, {_runs(30, 2)}, {_context(True)}
        SELECT query_id, file_name, length(doc) AS characters, md5(doc) AS digest FROM (SELECT r.run_id AS query_id, replace(replace(replace(substr(e.prompt, 1, 50), ' ', '_'), '/', '-'), ':', '') || '.md' AS file_name,
          '---' || chr(10) || 'topic: ' || e.prompt || chr(10) || 'generated: 2021-01-01' || chr(10) || '---' || chr(10) || chr(10) || 'Sources:' || chr(10) || coalesce(refs, '') || chr(10) || chr(10) || e.prompt AS doc
          FROM eval_runs r JOIN eval_cases e ON e.id = r.eval_id LEFT JOIN ctx ON ctx.query_id = r.run_id)""",
}
_BY_VECTOR = f"""{_BASE},
        vs AS (SELECT c.id::BIGINT AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) * coalesce(o.boost, 1.0) AS score FROM eval_cases c JOIN embeddings q ON q.vec_id = c.id, embeddings v LEFT JOIN boosts o ON o.id = v.vec_id)
        SELECT query_id, rank, id FROM {_top('vs', 15, 'id DESC', 'id', False)}"""
_MODES = {"top-docs": ORACLES["search_top_docs"], "semantic": ORACLES["search_tfidf"], "keyword": ORACLES["search_keyword"], "embedding": _BY_VECTOR, "hybrid": ORACLES["search_hybrid"], "combined": ORACLES["search_combined"]}
_HITS = " UNION ALL ".join(f"SELECT '{mode}' AS mode, query_id, rank, id FROM ({sql})" for mode, sql in _MODES.items())
ORACLES["run_modes"] = f"""SELECT run_id, mode, rank, h.id FROM (SELECT run_id, eval_id, CASE WHEN mode_name IN ('top-docs', 'semantic', 'keyword', 'embedding', 'hybrid') THEN mode_name ELSE 'combined' END AS mode FROM eval_runs) r
        JOIN ({_HITS}) h USING (mode) WHERE h.query_id = r.eval_id"""
