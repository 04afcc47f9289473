"""DuckDB SQL of the cleaner, the grouping and the chunker, as steps that follow each other.

Rules are written out here in SQL; only the fixed values are those that the operators read. RE2's word boundary knows ASCII
alone, so text is searched with its other letters masked by `_`, a letter of a word that no pattern names."""

from __future__ import annotations

import re
import string

from .. import fixed
from . import fixtures as fx


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def masked(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '_', 'g')"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({masked(c)}, {q(pattern.replace('(?!\\d)', ''))})"


def any_rx(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(rx(c, p) for p in patterns) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def words(c: str) -> str:
    return f"regexp_extract_all({c}, '\\S+')"


def lines(c: str) -> str:
    return f"(CASE WHEN {c} = '' THEN [] WHEN right({c}, 1) = chr(10) THEN list_slice(string_split({c}, chr(10)), 1, -2) ELSE string_split({c}, chr(10)) END)"


def head(n: int) -> str:
    return f"array_to_string(list_slice(string_split(raw_text, chr(10)), 1, {n}), chr(10))"


def has_fact(c: str) -> str:
    m = f"regexp_replace({masked(c)}, {q(fixed.FORM_REVISION_DATE)}, ' ', 'g')"
    some = " OR ".join(f"regexp_matches({m}, {q(p)})" for p in (fixed.DOLLAR, fixed.CASE_NUMBER, *fixed.DATE_PATTERNS))
    return f"(regexp_matches({c}, '[0-9]') AND NOT {rx(c, fixed.PRINTING_MARK)} AND ({some}))"


def without_marks(c: str) -> str:
    return f"regexp_replace(regexp_replace({masked(c)}, {q(fixed.FORM_REVISION_DATE)}, ' ', 'g'), {q(fixed.PRINTING_CODE)}, ' ', 'g')"


def found(c: str, *patterns: str) -> str:
    return "list_sort(list_distinct(" + " || ".join(f"regexp_extract_all({c}, {q(p)})" for p in patterns) + "))"


def is_artifact(x: str) -> str:
    return f"(length({x}) >= 3 AND NOT {has_fact(x)} AND (regexp_matches({x}, '[@{{}}]|::') OR (regexp_matches({x}, '\\p{{L}}') AND length(regexp_replace({x}, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length({x}) > 0.3)))"


def is_stamp(line: str) -> str:
    s = strip(line)
    n = f"len(regexp_extract_all({masked(s)}, {q(fixed.STAMP)}))"
    strange = f"len(list_filter({words(s)}, lambda w: NOT regexp_matches(w, {q(fixed.STAMP_ALONE)}) AND regexp_matches(w, '\\p{{L}}')))"
    return f"({n} >= 2 OR ({n} = 1 AND ({rx(s, fixed.STAMP_WITH_BLANK)} OR (len({words(s)}) <= 3 AND {strange} = 0))))"


def line_class(line: str) -> str:
    s, w = strip(line), words(line)
    few = f"len(list_filter({w}, lambda x: length(x) > 4)) = 0 AND 2 * len(list_filter({w}, lambda x: regexp_matches(x, '^[aeiouAEIOU]+$'))) >= len({w})"
    return f"""CASE WHEN {s} = '' OR {has_fact(s)} THEN 'kept'
 WHEN length({s}) <= 3 THEN CASE WHEN {s} IN ({', '.join(map(q, fixed.SHORT_KEEPLIST))}) THEN 'kept' ELSE 'orphan' END
 WHEN len({w}) >= 6 AND {few} THEN 'rule-artifact'
 WHEN len({w}) >= 6 AND 10 * len(list_filter({w}, lambda x: regexp_matches(x, '^[A-Z]{{2,3}}$'))) >= 7 * len({w}) THEN 'bureau-codes'
 WHEN length(regexp_replace({s}, '[^A-Za-z]', '', 'g')) / length({s}) < 0.40 THEN 'soup' ELSE 'kept' END"""


def without_furniture(ls: str) -> str:
    return f"list_filter({ls}, lambda x: {has_fact('x')} OR NOT {any_rx('x', fixed.TELETYPE_FURNITURE)})"


def joined(ls: str) -> str:
    return f"array_to_string({ls}, chr(10))"


def exemptions(c: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({masked(c)}, {q(fixed.EXEMPTION)}), lambda x: lower(regexp_replace(x, '[()\\s]', '', 'g')))))"


TEMPLATE = "CASE " + " ".join(f"WHEN {rx(head(20), p)} THEN '{n}'" for p, n in fixed.TEMPLATE_PATTERNS) + " ELSE 'unknown' END"
_FIELD = {k: (f"regexp_extract(raw_text, {q(p)}, 1)", f"strpos(raw_text, regexp_extract(raw_text, {q(p)}))", f"regexp_matches(raw_text, {q(p)})") for k, p in fixed.CLIPPING_FIELDS.items()}
_FIELDS = "list_filter([" + ", ".join(f"CASE WHEN {there} THEN '{k}=' || {strip(value)} END" for k, (value, _, there) in _FIELD.items()) + "], lambda x: x IS NOT NULL)"
_FIRST = "list_min(list_filter([" + ", ".join(f"CASE WHEN {there} THEN {at} END" for _, at, there in _FIELD.values()) + "], lambda x: x IS NOT NULL))"
_FACTS = {"dates": fixed.DATE_PATTERNS, "dollars": [fixed.DOLLAR], "case_numbers": [fixed.CASE_NUMBER]}


def _flag(kind: str) -> str:
    lost = f"list_sort(list_filter({found('raw_facts', *_FACTS[kind])}, lambda x: NOT list_contains({found('clean_facts', *_FACTS[kind])}, x)))"
    return f"CASE WHEN len({lost}) > 0 THEN '{kind}:' || array_to_string({lost}, ';') END"


#: clean: every page with what the cleaner says of it.
CLEAN = f"""WITH RECURSIVE f AS (SELECT *, CASE WHEN doc_no % 17 = 3 THEN 'skipped' ELSE 'clean' END AS bucket FROM ({fx.FORMS}) x),
c1 AS (SELECT *, {TEMPLATE} AS template, {lines('raw_text')} AS ls FROM f),
c2 AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: {rx('ls[i]', fixed.END_OF_TEXT)}) AS bt,
 coalesce(list_filter(range(1, len(ls) + 1), lambda i: {rx('ls[i]', fixed.PAGE_CONTINUATION)})[1], 1) AS start FROM c1),
c3 AS (SELECT *, CASE template WHEN '4-750' THEN ''
 WHEN 'FD-36' THEN {joined(f"CASE WHEN len(bt) >= 2 THEN list_slice(ls, bt[1] + 1, bt[len(bt)] - 1) WHEN len(bt) = 1 THEN {without_furniture(f'list_concat(list_filter(list_slice(ls, 1, bt[1] - 1), lambda y: {any_rx("y", fixed.ROUTING_PROVENANCE)}), list_slice(ls, bt[1] + 1, len(ls)))')} ELSE {without_furniture('ls')} END")}
 WHEN 'FD-36-cont' THEN {joined("list_slice(ls, start, coalesce(list_max(list_filter(bt, lambda i: i > start)), len(ls) + 1) - 1)")}
 WHEN 'FD-350' THEN CASE WHEN {_FIRST} IS NULL THEN regexp_replace(raw_text, {q(fixed.MOUNT_CLIPPING)}, '', 'g') ELSE left(regexp_replace(raw_text, {q(fixed.MOUNT_CLIPPING)}, '', 'g'), {_FIRST} - 1) END
 WHEN 'FD-xxx' THEN {joined(f"list_filter(ls, lambda x: NOT {rx('x', fixed.GENERIC_FORM_HEADER)})")} ELSE raw_text END AS body,
 CASE template WHEN 'FD-36' THEN CASE WHEN len(bt) >= 2 THEN 'high' WHEN len(bt) = 1 THEN 'medium' ELSE 'low' END WHEN 'FD-350' THEN CASE WHEN len({_FIELDS}) > 0 THEN 'high' ELSE 'low' END WHEN 'unknown' THEN 'low' ELSE 'high' END AS confidence FROM c2),
c4 AS (SELECT *, {lines("regexp_replace(body, '[\\x00-\\x08\\x0B-\\x1F\\x7F]|\\p{Cf}', '', 'g')")} AS every FROM c3),
c5 AS (SELECT *, list_filter(list_filter(every, lambda x: NOT {is_stamp('x')}), lambda y: {line_class('y')} = 'kept') AS kept FROM c4),
c6 AS (SELECT *, {words(joined('kept'))} AS toks FROM c5),
c7 AS (SELECT *, list_transform(toks, lambda x: {is_artifact('x')}) AS arts FROM c6),
c8 AS (SELECT *, list_filter(range(1, len(toks) + 1), lambda i: NOT (arts[i] AND i > 1 AND (arts[i - 1] OR toks[i - 1] = '[REDACTED]'))) AS units FROM c7),
c9 AS (SELECT *, array_to_string(list_transform(units, lambda i: CASE WHEN arts[i] THEN '[REDACTED]' ELSE toks[i] END), ' ') AS clean_text, len(list_filter(units, lambda i: arts[i])) AS labels FROM c8),
c10 AS (SELECT *, {without_marks('raw_text')} AS raw_facts, {without_marks('clean_text')} AS clean_facts FROM c9),
clean AS (SELECT source_stem, page_no, doc_no, raw_text, bucket, template, confidence, clean_text, template = '4-750' AS routed,
 CASE WHEN template = '4-750' THEN regexp_extract({masked('raw_text')}, {q(fixed.DELETION_REFERENCE)}) ELSE '' END AS reference,
 CASE WHEN template = '4-750' THEN {exemptions('raw_text')} ELSE [] END AS exemptions,
 CASE WHEN template = 'FD-350' THEN array_to_string({_FIELDS}, '|') ELSE '' END AS clipping,
 CASE WHEN template = '4-750' THEN 0 ELSE len(ls) - len({lines('body')}) + len(every) - len(kept) END AS removed, CASE WHEN template = '4-750' THEN 0 ELSE labels END AS redactions,
 CASE WHEN template = '4-750' THEN '' ELSE array_to_string(list_filter([{', '.join(map(_flag, _FACTS))}], lambda x: x IS NOT NULL), '|') END AS flags FROM c10)"""

CLEAN_PAGES = CLEAN + """
SELECT source_stem, page_no, template, confidence AS template_confidence, routed, reference, array_to_string(exemptions, ',') AS exemptions, clipping, clean_text,
 CAST(removed AS INT) AS boilerplate_lines_removed, CAST(redactions AS INT) AS redactions_inserted, flags FROM clean"""

_FIRST_LINE = f"list_filter(list_transform({lines('raw_text')}, lambda x: {strip('x')}), lambda y: regexp_matches(y, '\\p{{L}}'))[1]"
_LAST_LINE = f"list_filter(list_transform({lines('raw_text')}, lambda x: {strip('x')}), lambda y: y <> '')[-1]"
_OVERLAP = "list_has_any(rc, cases)"
_GO = f"""CASE WHEN template = '4-750' THEN false
 WHEN cover THEN rk = 'cover'
 WHEN template = 'FD-36-cont' THEN rk IN ('teletype', 'teletype-cont', 'loose')
 WHEN page_n THEN rk IN ('teletype', 'teletype-cont', 'newspaper', 'loose') AND (len(cases) = 0 OR len(rc) = 0 OR {_OVERLAP})
 WHEN cont THEN rk IN ('newspaper', 'loose')
 WHEN header THEN false
 ELSE template = 'unknown' AND prev_mid AND starts_mid AND {_OVERLAP} END"""
_KIND = "CASE WHEN cover AND template <> '4-750' THEN 'cover' WHEN template = '4-750' THEN 'deletion-sheet' WHEN template = 'FD-36' THEN 'teletype' WHEN template = 'FD-36-cont' THEN 'teletype-cont' WHEN template = 'FD-350' THEN 'newspaper' WHEN template = 'FD-xxx' THEN 'form' ELSE 'loose' END"

#: paged: every page with its document; a page at a time, each decision with the open document of the one before.
GROUPED = f"""{CLEAN},
s1 AS (SELECT source_stem, page_no, template, page_no <= 3 AND {rx('raw_text', fixed.COVER_MARKERS)} AS cover, {rx(head(20), fixed.PAGE_CONTINUATION)} AS page_n, {rx('raw_text', fixed.CONTINUED_FROM)} AS cont, {rx(head(6), fixed.FORM_HEADER)} AS header,
 coalesce(right({_LAST_LINE}, 1) NOT IN ('.', '!', '?', '"', '”'), true) AS ends_mid,
 coalesce(regexp_matches({_FIRST_LINE}, '^\\p{{Ll}}') OR (length({words(_FIRST_LINE)}[1]) <= 2 AND lower({words(_FIRST_LINE)}[1]) NOT IN ({', '.join(map(q, fixed.SHORT_STARTS))})), false) AS starts_mid,
 list_distinct(list_transform(regexp_extract_all({masked('raw_text')}, {q(fixed.FILE_NUMBER)}), lambda x: regexp_replace(x, '\\D', '', 'g'))) AS cases
 FROM clean WHERE bucket = 'clean' AND {strip('raw_text')} <> ''),
s2 AS (SELECT *, row_number() OVER w AS i, lag(ends_mid) OVER w AS prev_mid FROM s1 WINDOW w AS (PARTITION BY source_stem ORDER BY page_no)),
walk AS (SELECT source_stem, page_no, i, 1 AS n, {_KIND} AS kind, cases AS open_cases, 1 AS place FROM s2 WHERE i = 1
 UNION ALL SELECT source_stem, page_no, i, CASE WHEN go THEN rn ELSE rn + 1 END, CASE WHEN go THEN rk ELSE {_KIND} END, CASE WHEN go THEN list_distinct(list_concat(rc, cases)) ELSE cases END, CASE WHEN go THEN rp + 1 ELSE 1 END
 FROM (SELECT j.*, {_GO} AS go FROM (SELECT s2.*, walk.n AS rn, walk.kind AS rk, walk.open_cases AS rc, walk.place AS rp FROM walk JOIN s2 ON s2.source_stem = walk.source_stem AND s2.i = walk.i + 1) j) g),
paged AS (SELECT walk.source_stem, walk.page_no, walk.source_stem || '__doc-' || lpad(CAST(n AS VARCHAR), 3, '0') AS doc_id, kind, place, count(*) OVER (PARTITION BY walk.source_stem, n) AS pages, s2.cases, s2.template FROM walk JOIN s2 USING (source_stem, i)),
docs AS (SELECT source_stem, doc_id, arg_min(kind, page_no) AS kind, list_sort(list(page_no)) AS page_nos, count(*) AS page_count, arg_min(template, page_no) AS first_template, list_sort(list_distinct(flatten(list(cases)))) AS case_nums FROM paged GROUP BY 1, 2)"""

GROUP_DOCUMENTS = GROUPED + " SELECT f.source_stem, f.page_no, doc_id, kind AS doc_kind, CAST(place AS INT) AS doc_page_index, CAST(pages AS INT) AS doc_page_count FROM f LEFT JOIN paged USING (source_stem, page_no)"
DOC_SUMMARY = GROUPED + " SELECT source_stem, doc_id, kind, array_to_string(page_nos, ',') AS page_nos, CAST(page_count AS INT) AS page_count, first_template, array_to_string(case_nums, ',') AS case_nums FROM docs"
DOC_SIZES = GROUPED + " SELECT kind, CASE WHEN page_count = 1 THEN '1' WHEN page_count = 2 THEN '2' WHEN page_count <= 5 THEN '3-5' ELSE '6+' END AS pages, count(*) AS docs FROM docs GROUP BY 1, 2"


def sentences(c: str) -> str:
    """A boundary after an abbreviation or a single capital is held by a mark, twice as such words may follow each other."""
    guard = f"(^|[ \\t\\n])({'|'.join(fixed.ABBREVIATIONS)}|\\p{{Lu}})([.!?])(\\s)"
    held = c
    for _ in range(2):
        held = f"regexp_replace({held}, {q(guard)}, '\\1\\2\\3' || chr(2) || '\\4', 'g')"
    cut = f"string_split(replace(regexp_replace({held}, '([.!?])\\s+([A-Z\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(2), ''), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"


def tokens(c: str) -> str:
    return f"greatest(1, len({words(c)}) * 13 // 10)"


def packed(units: str, key: str) -> str:
    """pieces (key, k, i, j, tokens) of units (key, tok list): whole up to 600 tokens, else 500 with 100 of overlap."""
    return f"""b AS (SELECT {key}, tok, len(tok) AS n, list_sum(tok) AS total FROM {units} WHERE len(tok) > 0),
u AS (SELECT {key}, n, unnest(range(0, n + 1)) AS i, tok FROM b WHERE total > 600),
p AS (SELECT {key}, n, i, CAST(coalesce(sum(CASE WHEN i > 0 THEN tok[i] END) OVER (PARTITION BY {key} ORDER BY i), 0) AS BIGINT) AS s FROM u),
e AS (SELECT a.{key}, a.n, a.i, a.s, greatest(a.i + 1, max(z.i)) AS j FROM p a JOIN p z ON a.{key} = z.{key} AND z.i BETWEEN a.i AND a.i + 501 AND z.s - a.s <= 500 WHERE a.i < a.n GROUP BY 1, 2, 3, 4),
o AS (SELECT e.{key}, e.n, e.i, e.j, z.s - e.s AS tokens, z.s AS upto FROM e JOIN p z ON z.{key} = e.{key} AND z.i = e.j),
g AS (SELECT o.{key}, o.n, o.i, o.j, o.tokens, greatest(o.i + 1, coalesce(max(z.i), 0)) AS nxt FROM o LEFT JOIN p z ON z.{key} = o.{key} AND z.i BETWEEN o.i AND o.j AND o.upto - z.s >= 100 GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT {key}, 1 AS k, i, j, tokens, nxt, n FROM g WHERE i = 0 UNION ALL SELECT g.{key}, r.k + 1, g.i, g.j, g.tokens, g.nxt, g.n FROM r JOIN g ON g.{key} = r.{key} AND g.i = r.nxt AND r.j < r.n),
pieces AS (SELECT {key}, k, i, j, tokens FROM r UNION ALL SELECT {key}, 1, 0, n, total FROM b WHERE total <= 600)"""


SENTENCES = f"WITH s AS (SELECT doc_id, {sentences('text')} AS ss FROM documents) SELECT doc_id, CAST(len(ss) AS INT) AS sentences, md5({joined('ss')}) AS digest FROM s"
PACK_BOUNDS = f"""WITH RECURSIVE d AS (SELECT doc_id, list_transform(ss, lambda x: {tokens('x')}) AS tok FROM (SELECT doc_id, {sentences('text')} AS ss FROM documents)),
{packed('d', 'doc_id')} SELECT doc_id, CAST(k AS INT) AS piece, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(tokens AS INT) AS tokens FROM pieces"""

_MANY = "CASE WHEN len({}) > 1 THEN 's' ELSE '' END"
_NOTE = f"""'FOIA deletion placeholder. Page' || {_MANY.format('nos')} || ' ' || array_to_string(nos, ', ') || ' of the ' || source_stem || ' FBI release was withheld and is not available in this release.'
 || CASE WHEN len(ex) > 0 THEN ' The withholding cites FOIA exemption' || {_MANY.format('ex')} || ' ' || array_to_string(ex, ', ') || '.' ELSE '' END
 || CASE WHEN len(refs) > 0 THEN ' Reference: ' || array_to_string(refs, '; ') || '.' ELSE '' END"""

#: chunks: every chunk of the grouped, cleaned pages.
CHUNKS = f"""{GROUPED},
h1 AS (SELECT paged.source_stem, doc_id, page_no, kind, clean.template, clean.reference, clean.exemptions, {sentences("clean_text")} AS ss FROM paged JOIN clean USING (source_stem, page_no)),
h2 AS (SELECT *, list_transform(ss, lambda x, i: CASE WHEN i = 1 THEN '[p.' || page_no || '] ' || x ELSE x END) AS marked FROM h1),
h3 AS (SELECT source_stem, doc_id, arg_min(kind, page_no) AS kind, arg_min(template, page_no) AS template, list_sort(list(page_no)) AS nos, list(reference ORDER BY page_no) FILTER (reference <> '') AS refs0,
 list_sort(list_distinct(flatten(list(exemptions)))) AS ex, flatten(list(marked ORDER BY page_no)) AS ss, flatten(list(list_transform(marked, lambda x: page_no) ORDER BY page_no)) AS froms FROM h2 GROUP BY 1, 2),
h4 AS (SELECT *, coalesce(refs0, []) AS refs, list_transform(ss, lambda x: {tokens('x')}) AS tok FROM h3),
units AS (SELECT * FROM h4 WHERE kind <> 'deletion-sheet'),
{packed('units', 'doc_id')},
texts AS (SELECT doc_id, source_stem, kind, template, k, array_to_string(list_slice(ss, i + 1, j), ' ') AS text, list_sort(list_distinct(list_slice(froms, i + 1, j))) AS page_nos, tokens FROM pieces JOIN units USING (doc_id)
 UNION ALL SELECT doc_id, source_stem, kind, template, 1, text, nos, {tokens('text')} FROM (SELECT *, {_NOTE} AS text FROM h4 WHERE kind = 'deletion-sheet')),
chunks AS (SELECT doc_id || '__chunk-' || lpad(CAST(k AS VARCHAR), 2, '0') AS chunk_id, t.doc_id, t.source_stem, t.kind AS doc_kind, t.template AS doc_template, t.page_nos, docs.case_nums, CAST(k AS INT) AS chunk_index,
 CAST(count(*) OVER (PARTITION BY t.doc_id) AS INT) AS chunk_count, CAST(tokens AS INT) AS token_estimate, CAST(length(text) AS INT) AS char_count, text FROM texts t JOIN docs USING (doc_id))"""

PACK_CHUNKS = CHUNKS + " SELECT chunk_id, doc_id, source_stem, doc_kind, doc_template, array_to_string(page_nos, ',') AS page_nos, array_to_string(case_nums, ',') AS case_nums, chunk_index, chunk_count, token_estimate, char_count, text FROM chunks"
CHUNK_STATS = CHUNKS + """, k AS (SELECT token_estimate AS c, row_number() OVER (ORDER BY token_estimate) AS rk, count(*) OVER () AS n FROM chunks)
SELECT count(*) AS chunks, (SELECT count(DISTINCT doc_id) FROM chunks) AS docs, min(c) AS min_tokens, max(c) AS max_tokens, CAST(sum(c) // count(*) AS BIGINT) AS mean_tokens,
 min(c) FILTER (rk > n // 4) AS q1_tokens, min(c) FILTER (rk > n // 2) AS median_tokens, min(c) FILTER (rk > 3 * n // 4) AS q3_tokens FROM k"""
TOKEN_RANGES = CHUNKS + " SELECT CASE WHEN token_estimate < 50 THEN 'under 50' WHEN token_estimate < 100 THEN '50-99' WHEN token_estimate < 200 THEN '100-199' WHEN token_estimate < 400 THEN '200-399' WHEN token_estimate <= 500 THEN '400-500' ELSE 'over 500' END AS token_range, count(*) AS chunks FROM chunks GROUP BY 1"
MULTI_CHUNK_DOCS = CHUNKS + " SELECT doc_id, count(*) AS chunks, array_to_string(list_sort(list_distinct(flatten(list(page_nos)))), ',') AS page_nos FROM chunks GROUP BY 1 HAVING count(*) > 1"
CHUNK_INTEGRITY = CHUNKS + """ SELECT doc_id, count(*) AS n, count(DISTINCT chunk_id) = count(*) AS ids_unique, bool_and(chunk_count = (SELECT count(*) FROM chunks b WHERE b.doc_id = a.doc_id)) AS count_agrees,
 min(chunk_index) = 1 AND max(chunk_index) = count(*) AND count(DISTINCT chunk_index) = count(*) AS indexes_complete FROM chunks a GROUP BY doc_id"""
CHUNK_AUDIT = CHUNKS + """, a AS (SELECT *, len(regexp_extract_all(text, '\\[REDACTED\\]')) AS r, len(regexp_extract_all(text, '\\[p\\.[0-9]+\\]')) AS marks FROM chunks)
SELECT chunk_id, array_to_string(list_filter([CASE WHEN len(page_nos) = 0 THEN 'no pages' END, CASE WHEN page_nos <> list_sort(list_distinct(page_nos)) THEN 'pages not sorted and distinct' END,
 CASE WHEN len(list_filter(case_nums, lambda x: NOT regexp_matches(x, '^[0-9]+$'))) > 0 THEN 'case number not digits' END, CASE WHEN strlen(text) > 39000 THEN 'metadata too large' END], lambda x: x IS NOT NULL), '|') AS faults,
 CAST(r AS INT) AS redactions, CAST(marks AS INT) AS page_marks, round(r / token_estimate, 6) AS share, CAST(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS INT) AS non_ascii, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text), 6) AS letter_ratio FROM a"""
REDACTION_SUMMARY = CHUNKS + ", a AS (SELECT len(regexp_extract_all(text, '\\[REDACTED\\]')) AS r, token_estimate AS t FROM chunks) SELECT CAST(min(r) AS INT) AS min_redactions, CAST(max(r) AS INT) AS max_redactions, CAST(sum(r) AS BIGINT) AS redactions, count(*) FILTER (r >= 10) AS heavy, count(*) FILTER (r / t > 0.2) AS over_fifth FROM a"
METADATA_COUNTS = CHUNKS + " SELECT 'doc_kind' AS field, doc_kind AS value, count(*) AS chunks FROM chunks GROUP BY 2 UNION ALL SELECT 'doc_template', doc_template, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'source_stem', source_stem, count(*) FROM chunks GROUP BY 2"
COVERAGE_GAP = CHUNKS + """, named AS (SELECT DISTINCT source_stem, unnest(page_nos) AS page_no FROM chunks)
SELECT source_stem, page_no, 'no chunk' AS gap FROM paged ANTI JOIN named USING (source_stem, page_no) UNION ALL SELECT source_stem, page_no, 'no page' FROM named ANTI JOIN paged USING (source_stem, page_no)"""


def match_form(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {rx('line', p)} THEN '{k}' END" for k, p in fixed.FACT_SIGNALS.items()) + "], lambda x: x IS NOT NULL)"
FACT_SIGNALS = f"WITH f AS ({fx.FORMS}) SELECT doc_no, " + ", ".join(f"{rx('raw_text', p)} AS {k}" for k, p in fixed.FACT_SIGNALS.items()) + " FROM f"

#: lost: lines of the raw text with signals that the clean text does not keep.
LOST = f"""{CLEAN},
l1 AS (SELECT source_stem, page_no, {match_form('clean_text')} AS whole, unnest(list_transform({lines('raw_text')}, lambda x: {strip('x')})) AS line, generate_subscripts({lines('raw_text')}, 1) - 1 AS line_no FROM clean),
l2 AS (SELECT *, {_TAGS} AS tags, list_filter({words(match_form('line'))}, lambda w: length(w) >= 3) AS ws FROM l1 WHERE length(line) >= 4),
lost AS (SELECT source_stem, page_no, CAST(line_no AS INT) AS line_no, line, array_to_string(tags, ',') AS tags FROM l2 WHERE len(tags) > 0 AND 10 * len(list_filter(ws, lambda w: contains(whole, w))) < 7 * len(ws))"""
LOST_FACT_LINES = LOST + " SELECT * FROM lost"

#: A run of six of any one character, without a back reference.
_RUNS = "|".join(f"{re.escape(c)}{{6,}}" for c in string.printable[:94] + "".join(map(chr, range(0xC0, 0x100))))
_POOR = "list_filter(string_split(regexp_replace(clean_text, '\\.\\s+', '.' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 50 AND length(regexp_replace(x, '[^\\p{L}]', '', 'g')) < 0.35 * length(x))"
_SINGLE = f"list_filter({words('clean_text')}, lambda x: length(x) = 1 AND NOT regexp_matches(x, '^[\\p{{L}}\\p{{N}}]$'))"
NOISE = f"""{LOST},
n1 AS (SELECT source_stem, page_no, 'furniture' AS rule, unnest(regexp_extract_all({masked('clean_text')}, {q(fixed.FURNITURE_LEFTOVERS)})) AS x FROM clean
 UNION ALL SELECT source_stem, page_no, 'repeated-char', unnest(regexp_extract_all(clean_text, {q(_RUNS)})) FROM clean
 UNION ALL SELECT source_stem, page_no, 'tiny-words', unnest(list_filter(list_transform(regexp_extract_all({masked('clean_text')}, {q(fixed.TINY_WORDS)}), lambda x: {strip('x')}), lambda x: length(x) > 12)) FROM clean
 UNION ALL SELECT source_stem, page_no, 'low-letters', unnest(list_transform({_POOR}, lambda x: left(x, 80))) FROM clean
 UNION ALL SELECT source_stem, page_no, 'stray-symbols', array_to_string(list_slice({_SINGLE}, 1, 8), ' ') FROM clean WHERE len({_SINGLE}) >= 5)"""
RESIDUAL_NOISE = NOISE + " SELECT source_stem, page_no, rule, count(*) AS times, CAST(sum(length(x)) AS BIGINT) AS chars FROM n1 GROUP BY 1, 2, 3"
AUDIT_COUNTS = NOISE + """ SELECT count(*) AS pages, (SELECT count(*) FROM (SELECT DISTINCT source_stem, page_no FROM lost)) AS with_lost_lines, (SELECT count(*) FROM (SELECT DISTINCT source_stem, page_no FROM n1)) AS with_noise,
 count(*) FILTER (flags <> '') AS with_flags, count(*) FILTER (routed) AS routed FROM clean"""
CHUNK_LISTINGS = CHUNKS + """, a AS (SELECT *, len(regexp_extract_all(text, '\\[REDACTED\\]')) / token_estimate AS share, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS odd, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) AS ratio FROM chunks),
ranked AS (SELECT 'noisiest' AS listing, chunk_id, row_number() OVER (ORDER BY ratio, chunk_id) AS place FROM a UNION ALL SELECT 'redacted', chunk_id, row_number() OVER (ORDER BY share DESC, chunk_id) FROM a
 UNION ALL SELECT 'non-ascii', chunk_id, row_number() OVER (ORDER BY odd DESC, chunk_id) FROM a WHERE odd > 20 UNION ALL SELECT 'tiny', chunk_id, row_number() OVER (ORDER BY token_estimate, chunk_id) FROM a WHERE token_estimate < 30)
SELECT listing, chunk_id FROM ranked WHERE place <= CASE listing WHEN 'noisiest' THEN 10 WHEN 'redacted' THEN 8 WHEN 'non-ascii' THEN 5 ELSE 1000000000 END
UNION ALL SELECT 'missing ' || field, CAST(n AS VARCHAR) FROM (SELECT count(*) FILTER (coalesce(chunk_id, '') = '') AS chunk_id, count(*) FILTER (coalesce(doc_id, '') = '') AS doc_id, count(*) FILTER (coalesce(source_stem, '') = '') AS source_stem, count(*) FILTER (coalesce(doc_kind, '') = '') AS doc_kind, count(*) FILTER (coalesce(text, '') = '') AS text FROM chunks) UNPIVOT (n FOR field IN (chunk_id, doc_id, source_stem, doc_kind, text))"""
_NEAR_FACT = "strpos(raw_text, fact)"
PAGE_LISTINGS = f"""{CLEAN}, lost1 AS (SELECT source_stem, page_no, raw_text, split_part(x, ':', 1) AS kind, unnest(string_split(substr(x, strpos(x, ':') + 1), ';')) AS fact FROM (SELECT source_stem, page_no, raw_text, unnest(string_split(flags, '|')) AS x FROM clean WHERE flags <> ''))
SELECT source_stem, page_no, 'unknown' AS listing, array_to_string(list_slice(list_filter(list_transform({lines('raw_text')}, lambda x: {strip('x')}), lambda y: y <> ''), 1, 5), '|') AS what FROM clean WHERE bucket = 'clean' AND template = 'unknown'
UNION ALL SELECT source_stem, page_no, kind, fact || ' in ' || translate(substr(raw_text, greatest(1, {_NEAR_FACT} - 40), {_NEAR_FACT} + length(fact) + 40 - greatest(1, {_NEAR_FACT} - 40)), chr(10), ' ') FROM lost1"""
STAMP_LINES = f"WITH f AS ({fx.FORMS}) SELECT doc_no, count(*) AS stamps FROM (SELECT doc_no, unnest({lines('raw_text')}) AS line FROM f) WHERE {is_stamp('line')} GROUP BY 1"
LINE_CLASSES = f"WITH f AS ({fx.FORMS}) SELECT doc_no, {line_class('line')} AS class, count(*) AS n FROM (SELECT doc_no, unnest({lines('raw_text')}) AS line FROM f) WHERE {strip('line')} <> '' GROUP BY 1, 2"
EXEMPTIONS = f"WITH f AS ({fx.FORMS}) SELECT doc_no, array_to_string({exemptions('raw_text')}, ',') AS exemptions FROM f"
FACT_EXTRACT = f"""WITH m AS (SELECT doc_no, {without_marks('raw_text')} AS t FROM ({fx.FORMS}) f)
SELECT doc_no, {', '.join(f"array_to_string({found('t', *p)}, '|') AS {k}" for k, p in _FACTS.items())} FROM m"""
_LOSSY = "regexp_replace(raw_text, '[0-9]{4}', '', 'g')"
FACT_GUARDRAIL = f"""WITH m AS (SELECT doc_no, {without_marks('raw_text')} AS t, {without_marks(_LOSSY)} AS c FROM ({fx.FORMS}) f)
SELECT doc_no, {', '.join(f"array_to_string(list_filter({found('t', *p)}, lambda x: NOT list_contains({found('c', *p)}, x)), '|') AS lost_{k}" for k, p in _FACTS.items())} FROM m"""
REDACTION_LABELS = f"""WITH k AS (SELECT doc_id, {words('text')} AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM k),
a AS (SELECT doc_id, i, x, {is_artifact('x')} AS art FROM u),
b AS (SELECT *, lag(art OR x = '[REDACTED]') OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM a)
SELECT d.doc_id, CAST(count(*) FILTER (art AND NOT coalesce(prev, false)) AS INT) AS redactions,
 md5(coalesce(string_agg(CASE WHEN art THEN '[REDACTED]' ELSE x END, ' ' ORDER BY i) FILTER (NOT (art AND coalesce(prev, false))), '')) AS digest
FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id GROUP BY d.doc_id"""
