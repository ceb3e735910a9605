"""For every registered query the same answer in ANSI SQL over the given tables.

Written relationally (joins, windows, recursion) where the Spark side works inside rows, so
agreement says something.
"""

from __future__ import annotations

from folioflow import vocab
from folioflow.operators import prompts as prompt_texts
from folioflow.plans import view_sql, views
from folioflow.plans.view_sql import (
    NL,
    chunk_id_sql,
    heading_sql,
    quote,
    ranked_sql,
    section_type_sql,
    sql_case,
    sql_list,
    view,
    with_views,
)
from folioflow.sources import dimensions, reports

ORACLES: dict[str, str] = {}

#: Weights of the two values around the rank are whole hundredths.
P95 = (
    "CAST(round_even((list_sort(list(ms))[95 * (count(*) - 1) // 100 + 1] * (100 - 95 * (count(*) - 1) % 100) "
    "+ coalesce(list_sort(list(ms))[95 * (count(*) - 1) // 100 + 2], 0) * (95 * (count(*) - 1) % 100)) / 100.0, 0) AS BIGINT)"
)


def oracle(name: str, needs: tuple[str, ...], sql: str) -> None:
    ORACLES[name] = with_views(needs, sql)


WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {WS})"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def humanise(x: str) -> str:
    words = f"string_split({x}, '_')"
    return (
        f"array_to_string(list_transform({words}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    )


def pick(values, index: str) -> str:
    return f"({sql_list(values)})[CAST(1 + {index} AS INTEGER)]"


def flags(**conditions: str) -> str:
    """Comma-joined names of the conditions that hold."""
    arms = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items())
    return f"concat_ws(',', {arms})"


# --- structure -------------------------------------------------------------------------------------

view(
    "items",
    ("doc_lines",),
    f"""
SELECT doc_id, lang, 'header' AS kind, line_no // 4 AS pos, -1 AS j, 1 AS depth,
       CASE WHEN (doc_id + line_no // 4) % 7 = 0 THEN '' ELSE {heading_sql("doc_id", "lang", "line_no // 4")} END AS txt,
       (doc_id + line_no // 4) % 9 AS level,
       CASE WHEN (line_no // 4) % 4 <> 3 THEN line_no // 4 + 1 END AS page
FROM doc_lines WHERE line_no % 4 = 0
UNION ALL
SELECT doc_id, lang, 'text', line_no // 4, line_no % 4, CASE WHEN line_no % 11 = 5 THEN 2 ELSE 1 END,
       {strip("line")}, NULL, line_no // 4 + 1 + (line_no % 4) // 2
FROM doc_lines""",
)
view(
    "built_sections",
    ("items",),
    f"""
SELECT h.doc_id, 'doc_' || h.doc_id AS document_id,
       CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY h.pos) - 1 AS INTEGER) AS section_pos,
       h.txt AS heading, CAST(CASE WHEN h.level = 0 THEN 1 ELSE least(6, h.level) END AS INTEGER) AS level,
       {strip("coalesce(b.txt, '')")} AS text,
       CAST(coalesce(h.page, b.first_page) AS INTEGER) AS page_start,
       CAST(coalesce(b.last_page, h.page) AS INTEGER) AS page_end
FROM items h LEFT JOIN (
  SELECT doc_id, pos, string_agg(txt, {NL} ORDER BY j) FILTER (txt <> '') AS txt,
         arg_min(page, j) AS first_page, arg_max(page, j) AS last_page
  FROM items WHERE kind = 'text' AND depth = 1 GROUP BY doc_id, pos) b
  ON b.doc_id = h.doc_id AND b.pos = h.pos
WHERE h.kind = 'header' AND h.txt <> ''""",
)
oracle(
    "layout_sections",
    ("built_sections",),
    "SELECT document_id, section_pos, heading, level, text, page_start, page_end FROM built_sections",
)
oracle(
    "document_titles",
    ("items",),
    """
SELECT 'doc_' || d.doc_id AS document_id,
       CASE WHEN d.doc_id % 4 = 0 THEN 'Title of doc_' || d.doc_id
            ELSE coalesce(h.first_heading, 'name_' || d.doc_id) END AS title
FROM documents d LEFT JOIN (SELECT doc_id, arg_min(txt, pos) AS first_heading FROM items
                            WHERE kind = 'header' AND txt <> '' GROUP BY doc_id) h USING (doc_id)""",
)
oracle(
    "table_grids",
    ("table_texts",),
    """
SELECT 'doc_' || doc_id AS document_id, CAST(page AS INTEGER) AS page, CAST(n_rows AS BIGINT) AS rows,
       txt AS table_text FROM table_texts""",
)
view(
    "layout_tables",
    ("built_sections", "table_texts"),
    """
SELECT doc_id, document_id, section_pos, heading, page FROM (
  SELECT s.*, t.page, row_number() OVER (PARTITION BY s.doc_id ORDER BY
           CASE WHEN t.page BETWEEN s.page_start AND s.page_end THEN 0 WHEN s.page_start <= t.page THEN 1 ELSE 2 END,
           CASE WHEN t.page BETWEEN s.page_start AND s.page_end THEN s.section_pos ELSE -s.section_pos END) AS rn
  FROM built_sections s JOIN table_texts t USING (doc_id)) WHERE rn = 1""",
)
oracle(
    "table_sections",
    ("layout_tables",),
    "SELECT document_id, section_pos, heading, CAST(page AS INTEGER) AS page FROM layout_tables",
)
oracle(
    "parse_summary",
    ("built_sections", "layout_tables"),
    """
SELECT 'doc_' || d.doc_id AS document_id, CAST(coalesce(s.n, 0) AS BIGINT) AS section_count,
       CAST(coalesce(t.n, 0) AS BIGINT) AS table_count, CAST(s.last_page AS BIGINT) AS last_page,
       CAST(coalesce(s.chars, 0) AS BIGINT) AS text_length
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n, max(page_end) AS last_page, sum(length(text)) AS chars
           FROM built_sections GROUP BY doc_id) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM layout_tables GROUP BY doc_id) t USING (doc_id)""",
)

# --- chunking ------------------------------------------------------------------------------------------

oracle(
    "chunk_table",
    ("chunks",),
    """
SELECT chunk_id, document_id, programme, call_id, source_status, CAST(chunk_index AS INTEGER) AS chunk_index,
       CAST(section_pos AS INTEGER) AS section_pos, heading AS section_heading, section_type, is_table,
       CAST(page AS INTEGER) AS page, CAST(char_start AS INTEGER) AS char_start,
       CAST(char_end AS INTEGER) AS char_end, text
FROM chunks""",
)


def _small_spans() -> str:
    t, tol, overlap, least = 300, 40, 60, 50
    window = f"substr(txt, s + {t - tol} + 1, least(length(txt), s + {t + tol}) - (s + {t - tol}))"
    last = " ".join(
        f"WHEN contains({window}, {m}) THEN s + {t - tol} + length({window}) "
        f"- instr(reverse({window}), reverse({m})) + 1"
        for m in (f"{NL} || {NL}", "'. '", "'? '", "'! '")
    )
    end = f"CASE WHEN length(txt) - s <= {t} THEN length(txt) ELSE CASE {last} ELSE s + {t} END END"
    return f"""
SELECT document_id, section_pos, CAST(k AS INTEGER) AS k, CAST(s AS INTEGER) AS char_start,
       CAST(CASE WHEN k = top - 1 AND short THEN last_e ELSE e END AS INTEGER) AS char_end
FROM (SELECT *, max(k) OVER w AS top, max(e) OVER w AS last_e,
             bool_or(length(txt) - s <= {t} AND k > 0 AND e - s < {least}) OVER w AS short
      FROM (SELECT document_id, CAST(pos AS INTEGER) AS section_pos, txt, s, k, {end} AS e FROM walk)
      WINDOW w AS (PARTITION BY document_id, section_pos))
WHERE NOT (k = top AND short)"""


def _small_walk() -> str:
    t, tol, overlap = 300, 40, 60
    window = f"substr(txt, s + {t - tol} + 1, least(length(txt), s + {t + tol}) - (s + {t - tol}))"
    last = " ".join(
        f"WHEN contains({window}, {m}) THEN s + {t - tol} + length({window}) "
        f"- instr(reverse({window}), reverse({m})) + 1"
        for m in (f"{NL} || {NL}", "'. '", "'? '", "'! '")
    )
    return f"""
SELECT document_id, pos, txt, 0 AS s, 0 AS k FROM sections WHERE length(txt) > 0
UNION ALL
SELECT document_id, pos, txt, greatest((CASE {last} ELSE s + {t} END) - {overlap}, s + 1), k + 1
FROM walk WHERE length(txt) - s > {t}"""


view("walk", ("sections",), _small_walk())
oracle("chunk_spans", ("walk",), _small_spans())
oracle(
    "section_types",
    ("sections",),
    f"SELECT {section_type_sql('heading')} AS section_type, count(*) AS sections FROM sections GROUP BY 1",
)
oracle(
    "document_metadata",
    ("sections", "proposals"),
    """
SELECT p.document_id, p.programme, p.call_id, p.topic_id, p.year, p.outcome AS source_status, p.proposal_title,
       p.consortium_acronym, p.source_path, p.language, p.ingested_at, p.content_hash, count(*) AS sections
FROM sections s JOIN proposals p USING (doc_id) GROUP BY ALL""",
)

# --- call texts ---------------------------------------------------------------------------------------------

view(
    "calls",
    (),
    f"""
SELECT doc_id, regexp_replace(raw, '\\n{{3,}}', {NL} || {NL}, 'g') AS t
FROM (SELECT doc_id,
  'Programme: Research' || {NL} || 'Call: ' || {pick(views.CALL_NAMES, "doc_id % 8")} || {NL}
  || 'Topic: ' || CAST(950000 + doc_id AS VARCHAR)
  || CASE WHEN doc_id % 3 <> 1 THEN {NL} || '  topic title : Title ' || source ELSE '' END
  || {NL} || 'Destination: Area ' || lang || repeat({NL}, 4) || 'Expected Outcomes:' || {NL}
  || CASE WHEN doc_id % 4 = 3 THEN array_to_string(ls, {NL} || {NL})
          ELSE array_to_string(list_transform(ls, lambda x, i: CASE WHEN i % 2 = 1 THEN {pick(views.BULLETS, "doc_id % 3")} || x ELSE x END), {NL}) END
  || CASE WHEN doc_id % 7 <> 2 THEN {NL} || 'Scope' || {NL} || array_to_string(ls, {NL} || ' ' || {NL}) ELSE '' END
  || {NL} || 'Methodology guidance:' || {NL} || 'Use sound   methods.' || {NL}
  || CASE WHEN doc_id % 2 = 0 THEN 'Impact guidance' || {NL} || {NL} || 'Show impact.' || {NL} ELSE '' END
  || 'Type of action: RIA' || {NL} AS raw
  FROM (SELECT *, string_split(text, {NL}) AS ls FROM documents))""",
)

ALIASES = sql_case("upper(token)", vocab.PROGRAMME_ALIASES)
STOP_TAIL = f"(?i)(-({'|'.join(vocab.CALL_ID_STOP_TOKENS)}))+$"


def call_fields(text: str) -> dict[str, str]:
    """Programme, call and topic of a text without look-around."""
    token = f"regexp_extract({text}, '(?i)(?:^|[^A-Za-z0-9])({vocab.PROGRAMME_TOKEN})(?:[^A-Za-z0-9]|$)', 1)"
    rest = f"regexp_extract({text}, '(?is)(?:^|[^A-Za-z0-9])((?:{vocab.PROGRAMME_TOKEN})(?:[^A-Za-z0-9].*|$))', 1)"
    run = f"regexp_replace(regexp_extract({rest}, '^[\\p{{L}}\\p{{N}}-]+'), '{STOP_TAIL}', '')"
    programme = ALIASES.replace("token", token)
    return {
        "programme": programme,
        "call_id": f"CASE WHEN {programme} IS NOT NULL AND contains({run}, '-') THEN {run} END",
        "topic_id": f"nullif(regexp_extract({text}, '(?:^|[^0-9])([0-9]{{6,7}})(?:[^0-9]|$)', 1), '')",
    }


_STOPS = "|".join(
    vocab.BLOCK_HEADINGS + tuple(h.title() for h in vocab.GUIDANCE_HEADINGS)
)
view(
    "call_lines",
    ("calls",),
    f"""
SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
FROM (SELECT doc_id, string_split(t, {NL}) AS ls FROM calls)""",
)
_WANTED = ["expected outcomes", "scope", *vocab.GUIDANCE_HEADINGS]
view(
    "call_blocks",
    ("call_lines",),
    f"""
SELECT doc_id, heading, {strip(f"string_agg(line, {NL} ORDER BY n)")} AS block
FROM (SELECT l.doc_id, h.heading, l.n, l.line, h.at,
             (SELECT min(e.n) FROM call_lines e WHERE e.doc_id = l.doc_id AND e.n > h.at
                AND regexp_matches(e.line, '(?i)^[ \\t]*({_STOPS})[ \\t]*(:|$)')) AS stop
      FROM call_lines l JOIN (
        SELECT c.doc_id, w.heading, min(c.n) AS at
        FROM call_lines c JOIN (SELECT unnest({sql_list(_WANTED)}) AS heading) w
          ON regexp_matches(c.line, '(?i)^[ \\t]*' || w.heading || '[ \\t]*:?[ \\t]*$')
        GROUP BY ALL) h ON h.doc_id = l.doc_id AND l.n > h.at)
WHERE n < coalesce(stop, 1000000000) GROUP BY doc_id, heading""",
)
_call = call_fields("c.t")
oracle(
    "topic_fields",
    ("calls", "call_lines", "call_blocks"),
    f"""
SELECT doc_id, programme, call_id, topic_id, topic_title, destination, scope, 'pasted_text' AS source,
       raw_length, topic_id IS NULL AND topic_title IS NULL AND outcomes IS NULL AS is_empty
FROM (
  SELECT c.doc_id, {_call["programme"]} AS programme, {_call["call_id"]} AS call_id, {_call["topic_id"]} AS topic_id,
       CASE WHEN NOT regexp_full_match(coalesce(tt.v, tp.v), '[0-9]{{6,7}}') THEN coalesce(tt.v, tp.v) END AS topic_title,
       ds.v AS destination, nullif(sc.paragraphs, '') AS scope, length(c.t) AS raw_length, ob.block AS outcomes
  FROM calls c
  LEFT JOIN (SELECT doc_id, arg_min({strip("regexp_extract(line, '(?i)^[ \\t]*topic title[ \\t]*:(.*)$', 1)")}, n) AS v
             FROM call_lines WHERE regexp_matches(line, '(?i)^[ \\t]*topic title[ \\t]*:.') GROUP BY 1) tt USING (doc_id)
  LEFT JOIN (SELECT doc_id, arg_min({strip("regexp_extract(line, '(?i)^[ \\t]*topic[ \\t]*:(.*)$', 1)")}, n) AS v
             FROM call_lines WHERE regexp_matches(line, '(?i)^[ \\t]*topic[ \\t]*:.') GROUP BY 1) tp USING (doc_id)
  LEFT JOIN (SELECT doc_id, arg_min({strip("regexp_extract(line, '(?i)^[ \\t]*destination[ \\t]*:(.*)$', 1)")}, n) AS v
             FROM call_lines WHERE regexp_matches(line, '(?i)^[ \\t]*destination[ \\t]*:.') GROUP BY 1) ds USING (doc_id)
  LEFT JOIN (SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(block, '\\n\\s*\\n'),
                    lambda p: {collapse("p")}), lambda p: p <> ''), {NL} || {NL}) AS paragraphs
             FROM call_blocks WHERE heading = 'scope') sc USING (doc_id)
  LEFT JOIN (SELECT doc_id, nullif(block, '') AS block FROM call_blocks WHERE heading = 'expected outcomes') ob USING (doc_id))""",
)
_MARK = "'^[ \\t]*([-*•]|[0-9]+\\.)\\s+'"
view("outcome_blocks", ("call_blocks",), "SELECT doc_id, block FROM call_blocks WHERE heading = 'expected outcomes'")
view(
    "outcome_lines",
    ("outcome_blocks",),
    f"""
SELECT *, regexp_matches(line, {_MARK}) AS m,
       sum(CAST(regexp_matches(line, {_MARK}) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS grp
FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
      FROM (SELECT doc_id, string_split(block, {NL}) AS ls FROM outcome_blocks))""",
)
view(
    "outcomes",
    ("outcome_lines", "outcome_blocks"),
    f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS n, outcome
FROM (SELECT doc_id, grp, {strip(f"string_agg({strip(f'regexp_replace(line, {_MARK}, chr(32))')}, ' ' ORDER BY i)")} AS outcome
      FROM outcome_lines WHERE grp > 0 AND (m OR {strip("line")} <> '') GROUP BY doc_id, grp
      UNION ALL
      SELECT doc_id, i, {strip("p")} FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
        FROM (SELECT doc_id, string_split_regex(block, '\\n\\s*\\n') AS ps FROM outcome_blocks
              WHERE doc_id NOT IN (SELECT doc_id FROM outcome_lines WHERE m))))
WHERE outcome <> ''""",
)
view(
    "outcome_list",
    ("outcomes",),
    f"SELECT doc_id, string_agg('* ' || outcome, {NL} ORDER BY n) AS listing FROM outcomes GROUP BY doc_id",
)
oracle("topic_outcomes", ("outcomes",), "SELECT doc_id, n, outcome FROM outcomes")
oracle(
    "topic_guidance",
    ("call_blocks",),
    f"""
SELECT doc_id, {sql_case("heading", vocab.GUIDANCE_HEADINGS)} AS section_type, block AS guidance
FROM call_blocks WHERE heading LIKE '%guidance' AND block <> ''""",
)
_flat = call_fields("f.flat")
oracle(
    "parsed_topic_fields",
    ("sections",),
    f"""
SELECT document_id, sha256(flat) AS flat_hash, {_flat["programme"]} AS programme, {_flat["call_id"]} AS call_id,
       {_flat["topic_id"]} AS topic_id, 'pdf_excerpt' AS source, document_id AS source_path
FROM (SELECT s.document_id, CASE WHEN d.title <> '' THEN d.title || {NL} || {NL} ELSE '' END || s.body AS flat
      FROM (SELECT doc_id, document_id, string_agg(heading || {NL} || txt, {NL} || {NL} ORDER BY pos) AS body
            FROM sections GROUP BY ALL) s
      JOIN (SELECT doc_id, string_split(text, {NL})[1] AS title FROM documents) d USING (doc_id)) f""",
)
view(
    "names",
    (),
    f"""
SELECT doc_id, source, lang,
  CASE WHEN doc_id % 3 = 0 THEN 'proposal_' ELSE '' END || {pick(views.CALL_NAMES, "doc_id % 8")}
  || CASE WHEN doc_id % 5 < 2 THEN '_' || CAST(880000 + doc_id AS VARCHAR) ELSE '' END
  || CASE doc_id % 4 WHEN 1 THEN '-PartB' WHEN 2 THEN '-SEALED-Final' ELSE '' END
  || CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '.PDF' ELSE '.pdf' END AS file_name
FROM documents""",
)
_up = call_fields("t")
oracle(
    "upload_suggestions",
    ("names",),
    f"""
SELECT doc_id, {_up["programme"]} AS programme, {_up["call_id"]} AS call_id, {_up["topic_id"]} AS topic_id,
       'A title for HE-' || source AS proposal_title
FROM (SELECT doc_id, source, file_name || {NL} || 'A title for HE-' || source AS t FROM names)""",
)
_STEM = "regexp_replace(file_name, '\\.(pdf|PDF)$', '')"
_fn = call_fields("t")
oracle(
    "file_name_metadata",
    ("names",),
    f"""
SELECT doc_id, coalesce({_fn["programme"]}, 'horizon_europe') AS programme,
       coalesce({_fn["call_id"]}, 'UNSPECIFIED-CALL') AS call_id, {_fn["topic_id"]} AS topic_id,
       CAST(CASE WHEN doc_id % 2 = 0 THEN 2015 + doc_id % 9 ELSE 2024 END AS INTEGER) AS year,
       'funded' AS outcome, lang AS language, t AS proposal_title,
       '/corpus/' || source || '/' || file_name AS source_path
FROM (SELECT *, {_STEM} AS t FROM names)""",
)

# --- portal links ----------------------------------------------------------------------------------------------

_TOPIC = "printf('HORIZON-CL%d-2026-%06d-A', page_id % 9, page_id)"
oracle(
    "portal_topics",
    (),
    f"""
SELECT page_id, CASE WHEN page_id % 8 < 4 THEN {_TOPIC} END AS topic_id,
       CASE page_id % 8 WHEN 4 THEN 'foreign_host' WHEN 5 THEN 'no_topic_segment'
            WHEN 6 THEN 'bad_topic_shape' WHEN 7 THEN 'bad_scheme' END AS reason
FROM pages""",
)
oracle(
    "portal_contexts",
    (),
    f"""
SELECT page_id, CASE WHEN found AND NOT empty THEN 'CALL-' || topic END AS call_id,
       CASE WHEN found AND NOT empty THEN 'Topic page ' || page_id END AS topic_title,
       CASE WHEN found AND NOT empty THEN 'Call of ' || topic END AS call_title,
       CASE WHEN NOT found THEN 'topic_not_found' WHEN empty THEN 'payload_incomplete' END AS reason
FROM (SELECT page_id, {_TOPIC} AS topic, page_id % 7 = 0 AS empty,
             page_id % 11 <> 0 AND (page_id % 3 <> 0 OR page_id % 5 <> 0) AS found FROM pages)""",
)


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n - 1}) || '…' ELSE {x} END"


oracle(
    "chunk_snippets",
    ("chunks",),
    f"""
SELECT chunk_id, {cut("flat", 300)} AS snippet, {cut("flat", 200)} AS listing_snippet
FROM (SELECT chunk_id, {collapse("text")} AS flat FROM chunks)""",
)

# --- drafts ------------------------------------------------------------------------------------------------------

view(
    "draft_keys",
    (),
    "SELECT conv_id, turn, text AS base, CAST((conv_id + turn) % 6 AS INTEGER) AS n, conv_id % 12 AS flaw "
    "FROM conversations WHERE role = 'assistant'",
)
view(
    "cites",
    ("draft_keys",),
    f"""
SELECT conv_id, turn, 'drafts/' || conv_id || '/' || turn || '.json' AS draft_path, i,
       {pick(vocab.SECTION_TYPES, "conv_id % 11")} AS section_type,
       CASE WHEN flaw = 1 AND i = 2 THEN 1 WHEN flaw = 2 AND i = 2 THEN 9 ELSE i END AS citation_id,
       CASE WHEN flaw = 3 AND i = 1 THEN NULL ELSE {pick(vocab.SOURCE_STATUSES, "(conv_id + i) % 4")} END AS source_status,
       CASE WHEN flaw = 4 AND i = 1 THEN ' ' ELSE {pick(vocab.PROGRAMMES, "(conv_id + i) % 5")} END AS programme,
       CASE WHEN flaw = 5 AND i = 1 THEN '' ELSE 'CALL|' || (conv_id + i) END AS call_id,
       CASE WHEN (conv_id + i) % 3 <> 0 THEN 'Proposal ' || (conv_id + i) END AS proposal_title,
       CASE WHEN (conv_id + i) % 4 <> 1 THEN {pick(views.HEADINGS, "(conv_id + i) % 12")} END AS section_heading,
       CASE WHEN (conv_id + i) % 5 <> 2 THEN CAST(1 + (conv_id + i) % 30 AS INTEGER) END AS page,
       'doc_' || (conv_id + i) || '::0' AS chunk_id,
       CASE WHEN flaw = 6 AND i = 1 THEN '  ' ELSE 'Excerpt ' || (conv_id + i) END AS snippet
FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM draft_keys)""",
)
view(
    "drafts",
    ("draft_keys", "cites"),
    f"""
SELECT k.conv_id, k.turn, 'drafts/' || k.conv_id || '/' || k.turn || '.json' AS draft_path, k.conv_id AS draft_id,
       CAST((k.turn + 1) // 2 AS INTEGER) AS iteration, {pick(vocab.SECTION_TYPES, "k.conv_id % 11")} AS section_type,
       k.base || coalesce(' Evidence' || m.markers, '')
       || CASE WHEN flaw = 7 THEN ' See [' || (k.conv_id * 3 + k.turn) || '] and [012] again [100].' ELSE '' END
       || CASE WHEN flaw = 8 THEN {NL} || '## References' || {NL} || 'As said [1].' ELSE '' END
       || CASE WHEN flaw = 9 THEN ' ' || {quote(vocab.NO_EVIDENCE_SENTENCE)} ELSE '' END
       || CASE WHEN flaw = 10 THEN ' This sentence references retrieved example [1] as supporting evidence.' ELSE '' END
       || CASE WHEN k.conv_id % 5 = 0 THEN ' ' || {NL} ELSE '' END AS text,
       k.n, k.flaw, CAST(k.conv_id * 7 % 900 + k.turn AS INTEGER) AS elapsed_ms, CAST(1 + k.conv_id % 20 AS INTEGER) AS top_k,
       CASE WHEN k.conv_id % 6 = 0 THEN '  ' ELSE k.base END AS critique
FROM draft_keys k
LEFT JOIN (SELECT conv_id, turn, string_agg(' [' || i || ']', '' ORDER BY i) AS markers FROM cites GROUP BY 1, 2) m
  USING (conv_id, turn)""",
)
oracle(
    "citation_labels",
    ("cites",),
    f"""
SELECT draft_path, CAST(i - 1 AS INTEGER) AS pos, {humanise("programme")} AS programme,
       coalesce('p. ' || page, 'p. n/a') AS page, coalesce(section_heading, 'n/a') AS section,
       coalesce(proposal_title, 'untitled') AS title, replace(call_id, '|', chr(92) || '|') AS call_id
FROM cites""",
)


def markers(x: str, digits: str = "+") -> str:
    found = f"regexp_extract_all({x}, '\\[([0-9]{digits})\\]', 1)"
    return f"list_transform({found}, lambda m: CAST(CAST(m AS HUGEINT) AS VARCHAR))"


oracle(
    "text_markers",
    ("drafts",),
    f"""
SELECT draft_path, array_to_string({markers("text")}, ',') AS markers,
       array_to_string({markers("text", "{1,2}")}, ',') AS short_markers FROM drafts""",
)
view(
    "marks",
    ("drafts",),
    f"SELECT draft_path, unnest({markers('text')}) AS m FROM drafts",
)
oracle(
    "allowlist_hosts",
    (),
    """
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) END AS host,
       CASE page_id % 5 WHEN 1 THEN 'has_scheme' WHEN 2 THEN 'has_path' WHEN 3 THEN 'has_whitespace' WHEN 4 THEN 'empty_host' END AS reason
FROM pages""",
)
oracle(
    "source_paths",
    ("proposals", "names"),
    f"""
SELECT p.doc_id, {_STEM} AS file_document_id, lower(right(file_name, 4)) = '.pdf' AS is_pdf,
       CASE WHEN p.doc_id % 3 = 0 THEN '/abs/' || file_name ELSE '/meta/side/' || source_path END AS resolved,
       programme || '-' || replace(replace(call_id || '/x' || chr(92) || 'y', '/', '_'), chr(92), '_') || '-'
       || coalesce(topic_id, 'whole-call') || '-'
       || CASE WHEN p.doc_id % 2 = 0 THEN file_name ELSE 'tok__' || file_name END AS archive_name
FROM proposals p JOIN names USING (doc_id)""",
)
oracle("content_hashes", (), "SELECT doc_id, sha256(text) AS content_hash FROM documents")
oracle(
    "flat_metadata",
    ("chunks",),
    """
SELECT chunk_id, programme AS "proposal.programme", call_id AS "proposal.call_id", topic_id AS "proposal.topic_id",
       year AS "proposal.year", source_status AS "proposal.outcome", proposal_title AS "proposal.proposal_title",
       consortium_acronym AS "proposal.consortium_acronym", source_path AS "proposal.source_path",
       language AS "proposal.language", ingested_at AS "proposal.ingested_at", content_hash AS "proposal.content_hash",
       document_id AS "anchor.document_id", heading AS "anchor.section_heading", CAST(page AS INTEGER) AS "anchor.page",
       CAST(char_start AS INTEGER) AS "anchor.char_start", CAST(char_end AS INTEGER) AS "anchor.char_end", section_type,
       heading AS parent_section_heading, CAST(chunk_index AS INTEGER) AS chunk_index, source_status FROM chunks""",
)

# a document's fields come back from its sidecar unless that is spoilt: no mapping, an extra key or a list for a number
oracle(
    "sidecar_metadata",
    ("proposals",),
    "SELECT doc_id, problem, "
    + ", ".join(
        f"CASE WHEN problem IS NULL THEN {n} END AS {n}"
        for n in ("programme", "call_id", "topic_id", "year", "outcome", "proposal_title", "consortium_acronym", "source_path",
                  "language", "ingested_at", "content_hash")
    )
    + """ FROM (SELECT *, CASE doc_id % 17 WHEN 5 THEN 'malformed' WHEN 7 THEN 'not_a_mapping' WHEN 8 THEN 'not_a_mapping'
                       WHEN 9 THEN 'extra:snippet' WHEN 3 THEN 'type:year' END AS problem FROM proposals)""",
)

# --- validation ---------------------------------------------------------------------------------------------------

oracle(
    "proposal_validation",
    ("proposals",),
    f"""
SELECT doc_id, {strip("c")} AS call_id,
       {flags(programme="doc_id % 11 IN (3, 4)", call_id="doc_id % 13 = 5", year="doc_id % 17 IN (1, 2)",
              outcome="doc_id % 19 = 1", source_path="doc_id % 23 = 1",
              content_hash="doc_id % 7 = 1 AND upper(content_hash) <> content_hash")} AS reasons
FROM (SELECT *, CASE WHEN doc_id % 13 = 5 THEN ' ' || chr(9) ELSE ' ' || call_id END AS c FROM proposals)""",
)
oracle(
    "chunk_validation",
    ("chunks",),
    f"""
SELECT chunk_id, {flags(section_type="chunk_index % 11 = 3", source_status="chunk_index % 7 = 5",
       page="chunk_index % 5 = 4", char_end="chunk_index % 9 = 2 AND char_start IS NOT NULL",
       status_drift="chunk_index % 7 = 5 OR (chunk_index % 7 = 3 AND source_status <> 'funded')")} AS reasons
FROM chunks""",
)
oracle(
    "event_validation",
    (),
    f"""
SELECT event_id, {flags(
    not_json="f = 33",
    event_type="f = 19 AND event_id % 4 = 3",
    **{"extra:snippet": "f = 26 AND f <> 33", "extra:user_intent": "f = 0",
       "missing:model": "f = 11 AND event_id % 4 = 0",
       "type:generation_time_ms": "f = 13 AND event_id % 4 = 1",
       "range:top_k_examples": "f = 7 AND event_id % 4 = 0",
       "range:citation_count": "f = 17 AND event_id % 4 = 1"})} AS reasons
FROM (SELECT event_id, event_id % 50 AS f FROM events)""",
)
oracle(
    "vector_width",
    (),
    "SELECT vec_id, CAST(CASE WHEN vec_id % 10 = 0 THEN 60 ELSE len(embedding) END AS BIGINT) AS width, "
    "vec_id % 10 <> 0 AS accepted FROM embeddings",
)
oracle(
    "request_validation",
    ("requests",),
    f"""
SELECT query_id,
       {flags(query="query_id % 8 = 5", top_k="query_id % 6 IN (1, 2)",
              programme="query_id % 9 = 4")} AS search_reasons,
       {flags(query="query_id % 8 = 5", top_k="query_id % 6 IN (1, 2, 3)",
              programme="query_id % 9 = 4")} AS drafting_reasons
FROM requests""",
)
oracle(
    "result_count_check",
    ("drafts",),
    """
SELECT draft_path AS query_id, CAST(declared AS BIGINT) AS result_count, CAST(n AS BIGINT) AS actual
FROM (SELECT *, (draft_id + 2 * iteration - 1) % 6 + CASE WHEN draft_id % 5 = 2 THEN 1 ELSE 0 END AS declared
      FROM drafts) WHERE declared <> n""",
)

# --- vectors ---------------------------------------------------------------------------------------------------------

oracle(
    "hash_vectors",
    ("chunk_weights",),
    "SELECT key AS chunk_id, count(*) AS buckets, round(sum(w * (CAST(bucket AS BIGINT) + 1)), 4) AS checksum "
    "FROM chunk_weights GROUP BY key",
)
oracle(
    "model_vectors",
    (),
    f"SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS words, "
    f"len(string_split(text, {NL})) AS lines FROM documents",
)
oracle(
    "missing_vectors",
    ("chunk_weights", "chunks"),
    """
SELECT c.chunk_id, CAST(CASE WHEN c.chunk_index % 2 = 0 THEN 4 ELSE 384 END AS BIGINT) AS width,
       CASE WHEN c.chunk_index % 2 = 0 THEN 5.0 ELSE w.s END AS checksum
FROM chunks c LEFT JOIN (SELECT key, round(sum(w * (CAST(bucket AS BIGINT) + 1)), 4) AS s FROM chunk_weights GROUP BY key) w
  ON w.key = c.chunk_id""",
)
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
oracle(
    "cosine_neighbours",
    (),
    f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)


def _nearest(condition: str) -> str:
    return f"""
SELECT query_id, match_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS place
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS match_id, round({_COS}, 12) + 0.0 AS score
        FROM embeddings a JOIN embeddings b ON {condition}))
WHERE place <= 5"""


oracle("vector_top_k", (), _nearest("true"))
oracle("vector_top_k_blocks", (), _nearest("true"))
oracle("vector_top_k_same_label", (), _nearest("a.label = b.label"))

# --- retrieval -----------------------------------------------------------------------------------------------------------

oracle("candidate_pools", ("pool",), "SELECT * REPLACE (round(score, 6) AS score) FROM pool")
oracle("policy_retrieval", ("pool", "requests"), ranked_sql())
LENIENT = ranked_sql(threshold=0.05, fraction=1.0)
oracle("policy_retrieval_lenient", ("pool", "requests"), LENIENT)
oracle(
    "policy_retrieval_cautious",
    ("pool", "requests"),
    ranked_sql(
        threshold=0.2,
        offset=-0.15,
        lessons_mode=True,
        include_esr=False,
        funded_first=False,
        fraction=0.29,
    ),
)

# --- duplicates --------------------------------------------------------------------------------------------------------------

def slot(values: tuple) -> str:
    return f"({list(values)})[1 + doc_id // 4 % 6]"


view(
    "incoming",
    ("proposals",),
    f"""
SELECT doc_id AS position,
  CASE doc_id % 4 WHEN 0 THEN 'copy_' || document_id WHEN 1 THEN document_id WHEN 2 THEN 'alt_' || document_id
       ELSE 'new_' || (doc_id // 24 * 10 + {slot(views.FRESH_IDS)}) END AS document_id,
  CASE doc_id % 4 WHEN 0 THEN content_hash WHEN 1 THEN sha256(content_hash || ' revised')
       WHEN 2 THEN CASE WHEN doc_id % 16 <> 2 THEN sha256(content_hash || ' revised') END
       ELSE sha256('fresh ' || (doc_id // 24 * 10 + {slot(views.FRESH_HASHES)})) END AS content_hash,
  CASE doc_id % 4 WHEN 3 THEN 'Fresh proposal ' || (doc_id // 24 * 10 + {slot(views.FRESH_TITLES)})
       WHEN 2 THEN CASE WHEN doc_id % 12 <> 6 THEN proposal_title ELSE '  ' END ELSE proposal_title END AS proposal_title,
  CASE doc_id % 4 WHEN 3 THEN 'CALL-NEW' ELSE call_id END AS call_id
FROM proposals""",
)
view(
    "matched",
    ("incoming", "proposals"),
    f"""
SELECT i.*, (SELECT min(p.document_id) FROM proposals p WHERE p.content_hash = i.content_hash) AS by_hash,
       EXISTS (SELECT 1 FROM proposals p WHERE p.document_id = i.document_id) AS by_id,
       (SELECT min(p.document_id) FROM proposals p WHERE p.proposal_title = i.proposal_title
          AND p.call_id = i.call_id AND {strip("i.proposal_title")} <> '') AS by_title
FROM incoming i""",
)
view(
    "decided",
    ("matched",),
    """
SELECT position, document_id, CASE WHEN by_hash IS NOT NULL THEN 'block_hard' WHEN by_id THEN 'reindex'
            WHEN by_title IS NOT NULL THEN 'block_soft' ELSE 'none' END AS action,
       CASE WHEN by_hash IS NOT NULL THEN by_hash WHEN by_id THEN document_id ELSE by_title END AS conflicting_document_id
FROM matched""",
)
oracle(
    "hash_lookup",
    ("proposals",),
    "SELECT content_hash, min(document_id) AS hash_match, count(*) AS documents FROM proposals "
    "WHERE content_hash IS NOT NULL GROUP BY 1",
)
oracle(
    "title_call_lookup",
    ("proposals",),
    "SELECT proposal_title, call_id, min(document_id) AS title_match, count(*) AS documents FROM proposals "
    f"WHERE {strip('proposal_title')} <> '' GROUP BY 1, 2",
)
oracle(
    "chunks_per_document",
    ("chunks",),
    "SELECT document_id, count(*) AS chunk_count FROM chunks GROUP BY 1",
)
oracle(
    "document_registry",
    ("chunks",),
    "SELECT document_id, content_hash, proposal_title, call_id, count(*) AS chunk_count FROM chunks GROUP BY ALL",
)
oracle("duplicate_decisions", ("decided",), "SELECT * FROM decided")
view(
    "admissions",
    ("decided",),
    """
SELECT position, document_id, forced, CASE WHEN action = 'none' THEN 'added' WHEN action = 'reindex' THEN 'reindexed'
            WHEN action = 'block_soft' AND forced THEN 'reindexed' ELSE 'skipped' END AS outcome,
       CASE WHEN action = 'reindex' OR (action = 'block_soft' AND forced) THEN conflicting_document_id END AS replaced_document_id
FROM decided, (VALUES (false), (true)) f(forced)""",
)
oracle(
    "duplicate_admission",
    ("admissions",),
    "SELECT position, forced, outcome, replaced_document_id FROM admissions",
)
# one document after the other: the state is the index itself, from which replaced records are deleted
view(
    "records",
    ("proposals",),
    f"SELECT document_id, content_hash, CASE WHEN {strip('proposal_title')} <> '' THEN proposal_title || '|' || call_id END "
    "AS title_key FROM proposals",
)
view(
    "queue",
    ("incoming",),
    f"SELECT position, document_id, content_hash, row_number() OVER (ORDER BY position) AS turn, "
    f"CASE WHEN {strip('proposal_title')} <> '' THEN proposal_title || '|' || call_id END AS title_key FROM incoming",
)


def _batch_walk(admitted: str) -> str:
    return f"""
SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS document_id,
       CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS conflicting_document_id,
       (SELECT list({{id: document_id, h: content_hash, t: title_key}}) FROM records) AS live
UNION ALL
SELECT turn, position, document_id, action, conflict,
       CASE WHEN action IN ({admitted})
            THEN list_append(list_filter(live, lambda r: r.id <> coalesce(conflict, '')), {{id: document_id, h: content_hash, t: title_key}})
            ELSE live END
FROM (SELECT *, CASE WHEN by_hash IS NOT NULL THEN 'block_hard' WHEN by_id THEN 'reindex'
                     WHEN by_title IS NOT NULL THEN 'block_soft' ELSE 'none' END AS action,
             CASE WHEN by_hash IS NOT NULL THEN by_hash WHEN by_id THEN document_id ELSE by_title END AS conflict
      FROM (SELECT q.*, w.live,
                   list_min(list_transform(list_filter(w.live, lambda r: r.h = q.content_hash), lambda r: r.id)) AS by_hash,
                   list_contains(list_transform(w.live, lambda r: r.id), q.document_id) AS by_id,
                   list_min(list_transform(list_filter(w.live, lambda r: r.t = q.title_key), lambda r: r.id)) AS by_title
            FROM WALK w JOIN queue q ON q.turn = w.turn + 1))"""


view("batch_walk", ("queue", "records"), _batch_walk("'none', 'reindex'").replace("WALK", "batch_walk"))
view("forced_walk", ("queue", "records"), _batch_walk("'none', 'reindex', 'block_soft'").replace("WALK", "forced_walk"))
oracle(
    "batch_decisions",
    ("batch_walk",),
    "SELECT position, document_id, action, conflicting_document_id FROM batch_walk WHERE turn > 0",
)
oracle(
    "batch_decisions_forced",
    ("forced_walk",),
    """
SELECT position, document_id, action, conflicting_document_id,
       CASE action WHEN 'none' THEN 'added' WHEN 'block_hard' THEN 'skipped' ELSE 'reindexed' END AS outcome,
       EXISTS (SELECT 1 FROM (SELECT unnest(live) AS r FROM forced_walk WHERE turn = (SELECT max(turn) FROM forced_walk)) e
               WHERE e.r.id = w.document_id AND action <> 'block_hard'
                 AND turn = (SELECT max(turn) FROM forced_walk x WHERE x.document_id = w.document_id AND x.action <> 'block_hard')) AS stays
FROM forced_walk w WHERE turn > 0""",
)
oracle(
    "batch_outcomes",
    ("batch_walk", "chunks"),
    """
SELECT outcome, count(*) AS documents, CAST(sum(CASE WHEN outcome = 'skipped' THEN 0 ELSE n END) AS BIGINT) AS chunks
FROM (SELECT position, CASE action WHEN 'none' THEN 'added' WHEN 'reindex' THEN 'reindexed' ELSE 'skipped' END AS outcome
      FROM batch_walk WHERE turn > 0) a
LEFT JOIN (SELECT document_id AS d, count(*) AS n FROM chunks GROUP BY 1) c ON c.d = 'doc_' || a.position GROUP BY 1""",
)
view(
    "revised",
    ("chunks",),
    "SELECT CASE WHEN length(text) % 2 = 1 THEN chunk_id ELSE chunk_id || '-v2' END AS chunk_id, document_id, "
    "text || ' v2' AS text FROM chunks",
)
oracle(
    "chunk_upsert",
    ("revised", "chunks"),
    """
SELECT coalesce(n.chunk_id, o.chunk_id) AS chunk_id, coalesce(n.document_id, o.document_id) AS document_id,
       sha256(coalesce(n.text, o.text)) AS text_hash
FROM chunks o FULL JOIN revised n ON n.chunk_id = o.chunk_id""",
)
oracle(
    "chunk_deletes",
    ("incoming", "chunks"),
    "SELECT i.document_id, count(c.chunk_id) AS removed FROM (SELECT DISTINCT document_id FROM incoming) i "
    "LEFT JOIN chunks c USING (document_id) GROUP BY 1",
)
oracle(
    "chunk_reindex",
    ("admissions", "revised", "chunks"),
    """
SELECT chunk_id, document_id, sha256(text) AS text_hash FROM chunks
WHERE document_id NOT IN (SELECT replaced_document_id FROM admissions WHERE NOT forced AND outcome = 'reindexed')
UNION ALL
SELECT chunk_id, document_id, sha256(text) FROM revised
WHERE document_id IN (SELECT replaced_document_id FROM admissions WHERE NOT forced AND outcome = 'reindexed')""",
)
oracle(
    "indexed_proposals",
    ("chunks",),
    "SELECT document_id, count(*) AS chunks, count(*) AS embedded FROM chunks GROUP BY 1",
)
oracle(
    "collection_counts",
    ("chunks",),
    "SELECT programme AS collection, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM chunks GROUP BY 1",
)

# --- citations and prompts --------------------------------------------------------------------------------------------------------

view("lenient", ("pool", "requests"), LENIENT)
view(
    "found",
    ("lenient", "chunks"),
    f"""
SELECT query_id, citation_id, source_status, programme, call_id, proposal_title, section_heading, page, chunk_id,
       {cut("flat", 300)} AS snippet
FROM (SELECT r.query_id, r.rank AS citation_id, r.source_status, c.programme, c.call_id, c.proposal_title,
             c.heading AS section_heading, CAST(c.page AS INTEGER) AS page, r.chunk_id, {collapse("c.text")} AS flat
      FROM lenient r JOIN chunks c USING (chunk_id))""",
)
oracle("retrieval_citations", ("found",), "SELECT * FROM found")
view(
    "evidence",
    ("found", "requests"),
    f"""
SELECT q.query_id, count(f.query_id) AS citations, coalesce({rstrip(f'''string_agg('[' || f.citation_id || '] **'
       || {sql_case("f.source_status", vocab.PROMPT_STATUS_LABEL)} || '** — ' || {humanise("f.programme")} || ' call '
       || f.call_id || ', ' || coalesce('p. ' || f.page, 'p. ?') || ', §' || f.section_heading || {NL} || '    > '
       || f.snippet, {NL} || {NL} ORDER BY f.citation_id)''')}, '(no examples retrieved)') AS evidence
FROM requests q LEFT JOIN found f USING (query_id) GROUP BY q.query_id""",
)
oracle("evidence_blocks", ("evidence",), "SELECT query_id, evidence FROM evidence")


def _profile_case(field: str) -> str:
    arms = []
    for programme, p in dimensions.PROFILES.items():
        for section in vocab.SECTION_TYPES:
            if field == "name":
                value = quote(p["name"])
            elif field == "outputs":
                rows = p["expected_outputs"].get(section)
                value = quote("\n".join(f"* {o}" for o in rows)) if rows else "NULL"
            else:
                g = p["section_guidance"].get(section)
                value = quote(g) if g else "NULL"
            arms.append(f"WHEN programme = {quote(programme)} AND section_type = {quote(section)} THEN {value}")
    return f"CASE {' '.join(arms)} END"


_P = prompt_texts


def lit(text: str) -> str:
    return "(" + quote(text).replace("\n", f"' || {NL} || '") + ")"


_topic = call_fields("t")
oracle(
    "drafting_prompts",
    ("requests", "evidence", "calls", "call_blocks", "outcome_list"),
    f"""
SELECT query_id, section_type, profile_name,
  {lit(_P.TITLE)} || {NL} || '**Section type:** ' || {humanise("section_type")} || {NL}
  || '**Programme:** ' || coalesce({humanise("programme")}, {lit(_P.ANY_PROGRAMME)}) || {NL}
  || '**User intent:** ' || query || {NL} || {NL} || '## Section guidance' || {NL}
  || coalesce(profile_guidance, {sql_case("section_type", dimensions.SECTION_GUIDANCE)}) || {NL}
  || coalesce({NL} || {lit(_P.TOPIC_GUIDANCE)} || topic_guidance || {NL}, '')
  || coalesce({NL} || '## Expected outputs' || {NL} || {lit(_P.OUTPUTS_INTRO)} || outputs || {NL}, '')
  || {NL} || '## Call / topic context' || {NL} || context || {NL} || {NL} || '## Retrieved evidence' || {NL}
  || {lit(_P.EVIDENCE_INTRO)} || {NL} || evidence || {NL} || {NL} || '## Output instructions' || {NL}
  || {lit(_P.OUTPUT_INSTRUCTIONS)} || CASE WHEN listing IS NOT NULL THEN {lit(_P.OUTCOMES_INSTRUCTION)} ELSE '' END || {NL} AS prompt,
  citations AS citation_count
FROM (
 SELECT *, {_profile_case("name")} AS profile_name, {_profile_case("guidance")} AS profile_guidance,
   {_profile_case("outputs")} AS outputs,
   CASE WHEN t IS NULL THEN CASE WHEN notes = '' THEN '(none provided)' ELSE notes END ELSE
   {strip(f'''concat_ws({NL}, '**Programme:** ' || {humanise("tp")}, '**Call ID:** ' || tc, '**Topic ID:** ' || ti,
     '**Topic title:** ' || title, '**Destination:** ' || destination,
     {NL} || '**Expected outcomes:**' || {NL} || listing, {NL} || '**Scope:** ' || scope,
     CASE WHEN notes <> '' THEN {NL} || '**Free-text notes:**' || {NL} || notes END)''')} END AS context
 FROM (
  SELECT q.query_id, coalesce(q.section_type, 'other') AS section_type, q.programme, q.query, e.evidence, e.citations,
    CASE WHEN q.query_id % 3 = 0 THEN 'Note ' || q.query_id ELSE '' END AS notes, c.t,
    {_topic["programme"]} AS tp, {_topic["call_id"]} AS tc, {_topic["topic_id"]} AS ti,
    CASE WHEN q.query_id % 3 <> 1 THEN regexp_extract(c.t, 'topic title : ([^\\n]*)', 1) END AS title,
    regexp_extract(c.t, 'Destination: ([^\\n]*)', 1) AS destination, o.listing,
    (SELECT nullif(array_to_string(list_filter(list_transform(string_split_regex(block, '\\n\\s*\\n'),
        lambda p: {collapse("p")}), lambda p: p <> ''), {NL} || {NL}), '') FROM call_blocks b
     WHERE b.doc_id = c.doc_id AND b.heading = 'scope') AS scope,
    (SELECT nullif(any_value(block), '') FROM call_blocks b WHERE b.doc_id = c.doc_id
       AND {sql_case("b.heading", vocab.GUIDANCE_HEADINGS)} = coalesce(q.section_type, 'other')) AS topic_guidance
  FROM requests q JOIN evidence e USING (query_id)
  LEFT JOIN calls c ON c.doc_id = q.query_id AND q.query_id % 5 <> 4
  LEFT JOIN outcome_list o ON o.doc_id = c.doc_id))""",
)

# --- audits -------------------------------------------------------------------------------------------------------------------------

oracle(
    "marker_validation",
    ("drafts", "cites"),
    f"""
SELECT draft_path, CAST(len(ms) AS BIGINT) AS markers, len(ms) = 0 AS no_markers,
       array_to_string(list_sort(bad), ',') AS invalid_markers, len(bad) = 0 AS valid
FROM (SELECT draft_path, ms, list_filter(list_transform(list_distinct(ms), lambda m: CAST(m AS INTEGER)),
               lambda m: NOT list_contains(ids, m)) AS bad
      FROM (SELECT d.draft_path, {markers("d.text", "{1,2}")} AS ms,
                   coalesce((SELECT list(c.citation_id) FROM cites c WHERE c.draft_path = d.draft_path), []) AS ids
            FROM drafts d))""",
)
_ID = "CAST(c.citation_id AS VARCHAR)"
view(
    "draft_body",
    ("drafts",),
    f"""
SELECT draft_path, string_split('# ' || {humanise("section_type")} || {NL} || {NL} || {rstrip("text")}
       || {NL} || {NL} || '## References', '## References')[1] AS body FROM drafts""",
)
view(
    "body_marks",
    ("draft_body",),
    f"SELECT draft_path, unnest({markers('body')}) AS m FROM draft_body",
)
view(
    "findings",
    ("drafts", "cites", "marks", "body_marks"),
    f"""
SELECT draft_path, 'error' AS severity, 'missing_status' AS code, {_ID} AS citation_id FROM cites c WHERE source_status IS NULL
UNION ALL SELECT draft_path, 'error', 'empty_programme', {_ID} FROM cites c WHERE trim(programme) = ''
UNION ALL SELECT draft_path, 'error', 'empty_call_id', {_ID} FROM cites c WHERE trim(call_id) = ''
UNION ALL SELECT draft_path, 'warning', 'empty_snippet', {_ID} FROM cites c WHERE trim(snippet) = ''
UNION ALL SELECT draft_path, 'error', 'duplicate_citation_id', CAST(citation_id AS VARCHAR) FROM cites
          GROUP BY draft_path, citation_id HAVING count(*) > 1
UNION ALL SELECT draft_path, 'error', 'non_sequential_citation_ids', NULL FROM cites GROUP BY draft_path
          HAVING min(citation_id) <> 1 OR max(citation_id) <> count(*) OR count(DISTINCT citation_id) <> count(*)
UNION ALL SELECT m.draft_path, 'error', 'marker_without_citation', m.m FROM marks m
          WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.draft_path = m.draft_path AND {_ID} = m.m)
UNION ALL SELECT draft_path, 'warning', 'unused_citation', {_ID} FROM cites c
          WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.draft_path = c.draft_path AND m.m = {_ID})
UNION ALL SELECT draft_path, 'error', 'no_evidence_escape', NULL FROM drafts WHERE flaw = 9 AND n = 0
UNION ALL SELECT draft_path, 'error', 'placeholder_text', NULL FROM drafts WHERE flaw = 10
UNION ALL SELECT t.draft_path, 'error', 'bad_render', t.m
          FROM (SELECT draft_path, m, count(*) AS k FROM marks GROUP BY 1, 2) t
          LEFT JOIN (SELECT draft_path, m, count(*) AS k FROM body_marks GROUP BY 1, 2) b USING (draft_path, m)
          WHERE coalesce(b.k, 0) < t.k""",
)
view(
    "verdicts",
    ("findings", "drafts"),
    """
SELECT d.draft_path, d.section_type, CAST(d.n AS BIGINT) AS citation_count, count(f.code) AS finding_count,
       coalesce(bool_and(f.severity <> 'error'), true) AS passed,
       coalesce(bool_or(f.severity = 'error' AND f.code <> 'placeholder_text'), false) AS smoke
FROM drafts d LEFT JOIN findings f USING (draft_path) GROUP BY ALL""",
)
oracle("audit_findings", ("findings",), "SELECT * FROM findings")
oracle(
    "audit_verdicts",
    ("verdicts",),
    "SELECT draft_path, section_type, citation_count, finding_count, passed FROM verdicts",
)
_PLACE = "replace({}, '|', chr(92) || '|')"
view(
    "rendered",
    ("drafts", "cites"),
    f"""
SELECT d.draft_path, '# ' || {humanise("d.section_type")} || {NL} || {NL} || {rstrip("d.text")} || {NL} || {NL}
  || '## References' || {NL} || {NL}
  || coalesce({lit(vocab.REFERENCES_TABLE_HEAD)} || {NL} || r.body || {NL} || {NL} || '### Notes' || {NL} || {NL} || r.notes,
              '_No citations._') || {NL} AS rendered
FROM drafts d LEFT JOIN (
  SELECT draft_path,
    string_agg('| ' || citation_id || ' | ' || coalesce({sql_case("source_status", vocab.STATUS_LABEL)}, '') || ' | '
      || {humanise("programme")} || ' | ' || {_PLACE.format("call_id")} || ' | ' || coalesce(section_heading, 'n/a') || ' | '
      || coalesce(CAST(page AS VARCHAR), 'n/a') || ' | ' || coalesce(proposal_title, 'untitled') || ' |', {NL} ORDER BY i) AS body,
    string_agg('- [' || citation_id || '] ' || coalesce({sql_case("source_status", vocab.STATUS_BADGE)}, '') || ' — '
      || {humanise("programme")} || ' call ' || call_id || ', ' || coalesce('p. ' || page, 'p. n/a') || ', §'
      || coalesce(section_heading, 'n/a')
      || coalesce({NL} || '  ' || nullif({sql_case("source_status", vocab.STATUS_CAVEAT)}, ''), ''), {NL} ORDER BY i) AS notes
  FROM cites GROUP BY draft_path) r USING (draft_path)""",
)
oracle("rendered_drafts", ("rendered",), "SELECT * FROM rendered")
oracle(
    "exported_drafts",
    ("rendered", "verdicts"),
    "SELECT draft_path, section_type, CAST(octet_length(encode(rendered)) AS BIGINT) AS byte_count "
    "FROM rendered JOIN verdicts USING (draft_path) WHERE passed",
)
view(
    "totals",
    ("verdicts", "cites"),
    """
SELECT count(*) AS audited_drafts, count(*) FILTER (passed) AS passed_drafts, count(*) FILTER (NOT passed) AS failed_drafts,
       (SELECT count(*) FROM cites) AS citation_count,
       (SELECT count(*) FROM cites WHERE source_status IS NULL) AS unlabeled_citation_count,
       coalesce(bool_and(passed), true) AS passed, count(*) AS total_drafts FROM verdicts""",
)
oracle("release_totals", ("totals",), "SELECT * FROM totals")
view(
    "release_rows",
    ("cites",),
    "SELECT draft_path, section_type, CAST(citation_id AS INTEGER) AS citation_id, "
    "coalesce(source_status, 'unknown') AS source_status, programme, call_id, proposal_title, section_heading, page, chunk_id FROM cites",
)
oracle("release_citations", ("release_rows",), "SELECT * FROM release_rows")
oracle(
    "release_sample",
    ("drafts",),
    "SELECT draft_path, section_type FROM drafts ORDER BY sha256('42:' || draft_path), draft_path LIMIT 25",
)


def _release_report(totals: str, verdicts: str, rows: str, sample: str = "") -> str:
    return f"""
SELECT 0 AS part, '' AS key, {lit("# Release Audit Report" + chr(10) + chr(10) + "**Verdict:** ")}
  || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || {lit(chr(10) + chr(10) + "## Summary" + chr(10) + chr(10) + "- Audit directory: `drafts`" + chr(10))}
  || '- Total drafts on disk: ' || total_drafts || {NL} || '- Audited drafts: ' || audited_drafts || {NL}
  || '- Passed drafts: ' || passed_drafts || {NL} || '- Failed drafts: ' || failed_drafts || {NL}
  || '- Citations audited: ' || citation_count || {NL} || '- Unlabeled citations: ' || unlabeled_citation_count || {NL} || {lit(sample)} || {NL}
  || '## Per-draft Results' || {NL} || {NL}
  || {lit("| Status | Section | Citations | Draft |" + chr(10) + "|--------|---------|-----------|-------|")} AS value FROM {totals}
UNION ALL
SELECT 1, draft_path, '| ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END || ' | ' || section_type || ' | ' || citation_count
  || ' | `' || draft_path || '` |' FROM {verdicts}
UNION ALL
SELECT 2, '', {lit(chr(10) + "## Citation Fidelity" + chr(10) + chr(10) + "| Status | Programme | Call | Page | Section | Source | Chunk ID | Draft |" + chr(10) + "|--------|-----------|------|------|---------|--------|----------|-------|")}
UNION ALL
SELECT 3, draft_path || printf('%012d', citation_id), '| ' || source_status || ' | ' || programme || ' | ' || call_id || ' | '
  || coalesce(CAST(page AS VARCHAR), 'n/a') || ' | ' || coalesce(section_heading, 'n/a') || ' | '
  || coalesce(proposal_title, 'untitled') || ' | ' || chunk_id || ' | `' || draft_path || '` |' FROM {rows}"""


oracle("release_report", ("totals", "verdicts", "release_rows"), _release_report("totals", "verdicts", "release_rows"))
view(
    "picked",
    ("drafts",),
    "SELECT draft_path FROM drafts ORDER BY sha256('42:' || draft_path), draft_path LIMIT 25",
)
oracle(
    "release_report_sampled",
    ("picked", "totals", "verdicts", "release_rows", "cites"),
    _release_report(
        """(SELECT (SELECT total_drafts FROM totals) AS total_drafts, count(*) AS audited_drafts, count(*) FILTER (passed) AS passed_drafts,
             count(*) FILTER (NOT passed) AS failed_drafts, bool_and(passed) AS passed,
             (SELECT count(*) FROM cites SEMI JOIN picked USING (draft_path)) AS citation_count,
             (SELECT count(*) FROM cites SEMI JOIN picked USING (draft_path) WHERE source_status IS NULL) AS unlabeled_citation_count
           FROM verdicts SEMI JOIN picked USING (draft_path))""",
        "(SELECT * FROM verdicts SEMI JOIN picked USING (draft_path))",
        "(SELECT * FROM release_rows SEMI JOIN picked USING (draft_path))",
        "- Sample size: 25" + chr(10) + "- Sample seed: 42" + chr(10),
    ),
)
oracle(
    "release_gate",
    ("verdicts",),
    "SELECT section_type, bool_or(NOT passed) AS release_blocked, bool_or(smoke) AS smoke_blocked FROM verdicts GROUP BY 1",
)
oracle(
    "release_issues",
    ("findings", "drafts"),
    "SELECT draft_path, section_type, code, citation_id FROM findings JOIN drafts USING (draft_path) WHERE severity = 'error'",
)

# --- iterations and ratings -----------------------------------------------------------------------------------------------------------


def _outputs_case() -> str:
    arms = []
    for programme, p in dimensions.PROFILES.items():
        for section, rows in p["expected_outputs"].items():
            arms.append(
                f"WHEN programme = {quote(programme)} AND section_type = {quote(section)} THEN {quote('; ' + '; '.join(rows))}"
            )
    return f"CASE {' '.join(arms)} ELSE '' END"


oracle(
    "requirements",
    ("calls",),
    f"""
SELECT doc_id, 'default-section-guidance' || {_outputs_case()} || '; topic:methodology'
       || CASE WHEN doc_id % 2 = 0 THEN '; topic:impact' ELSE '' END AS requirements
FROM (SELECT c.doc_id, {call_fields("c.t")["programme"]} AS programme,
             {pick(vocab.SECTION_TYPES, "c.doc_id % 11")} AS section_type FROM calls c)""",
)


def _signed(x: str) -> str:
    return f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {x}"


oracle(
    "change_summaries",
    ("drafts",),
    f"""
SELECT draft_id, iteration AS iteration_index,
       CASE WHEN dc = 0 AND dn = 0 THEN {quote(vocab.CHANGE_NONE)} WHEN dc > 0 THEN {quote(vocab.CHANGE_GROWN)}
            ELSE {quote(vocab.CHANGE_SHRUNK)} END
       || ' text ' || {_signed("dc")} || ' chars, citations ' || {_signed("dn")} || '.' AS changes_summary,
       sha256(CASE WHEN {strip("critique")} = '' THEN {quote(vocab.EMPTY_CRITIQUE)} ELSE {cut("critique", 4000)} END) AS critique_hash,
       iteration >= 5 AS stopped
FROM (SELECT b.draft_id, b.iteration, length(b.text) - length(a.text) AS dc, b.n - a.n AS dn, b.critique
      FROM drafts a JOIN drafts b ON b.draft_id = a.draft_id AND b.iteration = a.iteration + 1 WHERE b.iteration <= 5)""",
)
oracle(
    "iteration_history",
    ("drafts",),
    """
SELECT a.draft_id, a.iteration AS iteration_index, CAST(count(*) + 1 AS INTEGER) AS total_iterations,
       string_agg(CAST(b.iteration AS VARCHAR), ',' ORDER BY b.iteration) AS history
FROM drafts a JOIN drafts b ON b.draft_id = a.draft_id AND b.iteration BETWEEN 2 AND a.iteration
WHERE a.iteration BETWEEN 2 AND 3 GROUP BY a.draft_id, a.iteration""",
)
view(
    "pilots",
    (),
    "SELECT DISTINCT user_id AS pilot_id, CASE WHEN user_id % 3 = 0 THEN 'smoke' ELSE 'coordinator' END AS mode, "
    "user_id % 17 <> 0 AS smoke_passed, user_id % 13 <> 0 AS audit_passed, user_id % 6 = 0 AS smoke_blocking FROM events",
)
view(
    "pilot_sections",
    ("pilots",),
    f"SELECT pilot_id, CAST(s AS INTEGER) AS section_pos, {pick(vocab.SECTION_TYPES, 's')} AS section_type "
    "FROM (SELECT pilot_id, unnest(range(0, CASE WHEN pilot_id % 19 <> 0 THEN 1 + pilot_id % 3 ELSE 0 END)) AS s FROM pilots)",
)
view(
    "ratings",
    (),
    f"""
SELECT user_id AS pilot_id, {pick(vocab.SECTION_TYPES, "event_id % 4")} AS section_type,
       CASE WHEN event_id % 10 <> 3 THEN 5 - CASE WHEN user_id % 2 = 0 THEN event_id % 2 ELSE event_id % 4 END END AS rating
FROM events""",
)
oracle(
    "rating_attachment",
    ("ratings", "pilot_sections"),
    """
SELECT section_type, known, count(*) AS ratings, count(rating) AS given
FROM (SELECT r.*, EXISTS (SELECT 1 FROM pilot_sections s WHERE s.pilot_id = r.pilot_id AND s.section_type = r.section_type) AS known
      FROM ratings r) GROUP BY ALL""",
)
view(
    "section_means",
    ("ratings", "pilot_sections"),
    """
SELECT s.pilot_id, s.section_pos, s.section_type, avg(r.rating) AS mean_rating, count(r.rating) AS ratings,
       CASE WHEN avg(r.rating) IS NULL THEN 'conditional' WHEN avg(r.rating) < 4 THEN 'no_go' END AS deciding
FROM pilot_sections s LEFT JOIN ratings r USING (pilot_id, section_type) GROUP BY ALL""",
)
oracle(
    "section_ratings",
    ("section_means",),
    "SELECT pilot_id, section_pos, section_type, round(mean_rating, 6) AS mean_rating, ratings, deciding FROM section_means",
)
view(
    "pilot_verdict",
    ("section_means", "pilots"),
    """
SELECT pilot_id, mode, smoke_passed, CASE WHEN NOT smoke_passed OR (mode = 'coordinator' AND NOT audit_passed)
              OR (mode = 'smoke' AND smoke_blocking) THEN 'no_go'
            WHEN mode = 'smoke' THEN 'conditional' ELSE coalesce(deciding, 'go') END AS verdict
FROM pilots LEFT JOIN (SELECT DISTINCT ON (pilot_id) pilot_id, deciding FROM section_means WHERE deciding IS NOT NULL
                       ORDER BY pilot_id, section_pos) USING (pilot_id)""",
)
oracle("pilot_verdicts", ("pilot_verdict",), "SELECT pilot_id, mode, verdict FROM pilot_verdict")
view(
    "pilot_ratings",
    ("pilot_sections",),
    f"""
SELECT * FROM (SELECT event_id, user_id AS pilot_id, {pick(vocab.SECTION_TYPES, "event_id % 4")} AS section_type,
         'coord_' || (event_id % 7) AS coordinator_id,
         CASE WHEN event_id % 10 <> 3 THEN 5 - CASE WHEN user_id % 2 = 0 THEN event_id % 2 ELSE event_id % 4 END END AS rating,
         CASE WHEN event_id % 4 <> 2 THEN event_id % 90 END AS saved
       FROM events WHERE user_id % 5 <> 1) SEMI JOIN pilot_sections USING (pilot_id, section_type)""",
)
view(
    "pilot_records",
    ("pilot_verdict", "pilot_sections"),
    f"""
SELECT v.*, n, total, mean, most, slow, coalesce(audited, 0) AS audited, coalesce(ok, 0) AS ok, coalesce(cited, 0) AS cited
FROM pilot_verdict v
JOIN (SELECT user_id AS pilot_id, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total, avg(ms) AS mean, max(ms) AS most,
             {P95} AS slow
      FROM (SELECT user_id, CAST(floor(value) AS INTEGER) AS ms FROM events) GROUP BY 1) USING (pilot_id)
LEFT JOIN (SELECT pilot_id, count(*) AS audited, count(*) FILTER ((pilot_id + section_pos) % 4 <> 0) AS ok,
                  CAST(sum((pilot_id + section_pos) % 6) AS BIGINT) AS cited FROM pilot_sections GROUP BY 1) USING (pilot_id)""",
)
_ADVICE = sql_case("verdict", reports.PILOT_ADVICE)
oracle(
    "pilot_report",
    ("pilot_records", "pilot_ratings", "pilot_sections"),
    f"""
SELECT pilot_id, 0 AS part, '' AS key, '# MVP Pilot Validation Report' || {NL} || {NL} || '- **Mode:** `' || mode || '`' || {NL}
  || '- **Call ID:** `CALL-' || pilot_id % 9 || '`' || {NL} || '- **Proposal:** Pilot proposal ' || pilot_id || {NL}
  || '- **Generated at (UTC):** ' || strftime(make_timestamp((1700000000 + pilot_id * 3600) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' || {NL}
  || '- **Verdict:** **' || upper(verdict) || '**' || CASE WHEN pilot_id % 3 = 0 THEN {NL} || '- **Notes:** note ' || pilot_id ELSE '' END
  || {NL} || {NL} || {lit(reports.PILOT_SECTIONS_HEAD)} AS value FROM pilot_verdict
UNION ALL
SELECT pilot_id, 1, printf('%06d', section_pos), '| ' || (section_pos + 1) || ' | ' || section_type || ' | '
  || (pilot_id + section_pos) % 6 || ' | ' || (pilot_id + section_pos) * 31 || ' | ' || (pilot_id + section_pos) % 90
  || CASE WHEN (pilot_id + section_pos) % 4 <> 0 THEN ' | PASS' ELSE ' | FAIL' END || ' | `d/' || (pilot_id + section_pos) || '` |'
FROM pilot_sections
UNION ALL
SELECT pilot_id, 2, '', {lit(reports.PILOT_RATINGS_HEAD)}
  || CASE WHEN pilot_id IN (SELECT pilot_id FROM pilot_ratings) THEN '' ELSE {NL} || {lit(reports.PILOT_NO_RATINGS)} END
FROM pilot_verdict
UNION ALL
SELECT pilot_id, 3, section_type || '/' || printf('%012d', event_id), '| ' || section_type || ' | ' || coordinator_id || ' | '
  || coalesce(CAST(rating AS VARCHAR), '<pending>') || ' | ' || coalesce(CAST(saved AS VARCHAR), '<pending>') || ' |  |'
FROM pilot_ratings
UNION ALL
SELECT pilot_id, 4, '', {lit(reports.PILOT_ISSUES_HEAD)} || {NL}
  || CASE WHEN pilot_id IN (SELECT pilot_id FROM pilot_sections WHERE (pilot_id + section_pos) % 4 = 0)
          THEN {lit(reports.PILOT_ISSUES_TABLE)} ELSE {lit(reports.PILOT_NO_ISSUES)} END FROM pilot_verdict
UNION ALL
SELECT pilot_id, 5, section_type || '/d/' || (pilot_id + section_pos) || '/missing_status', '| ' || section_type
  || ' | `missing_status` | no status | `d/' || (pilot_id + section_pos) || '` |'
FROM pilot_sections WHERE (pilot_id + section_pos) % 4 = 0
UNION ALL
SELECT pilot_id, 6, '', {NL} || '- Audit summary: ' || ok || ' passed, ' || (audited - ok) || ' failed of ' || audited || ' audited ('
  || cited || ' citations).' || {NL} || {NL} || '## Performance (AC3)' || {NL} || {NL}
  || '- Runtime: `stub` (LLM `deterministic-stub-v1`, embedder `hash-384`)' || {NL} || '- Platform: `linux`' || {NL}
  || CASE WHEN pilot_id % 5 <> 2 THEN '- Indexing: ' || n || ' chunks in ' || total || ' ms ('
          || printf('%.1f', round_even(CASE WHEN total = 0 THEN 0.0 ELSE n / (total / 1000.0) END, 1)) || ' chunks/sec)' || {NL} ELSE '' END
  || CASE WHEN pilot_id % 7 <> 3 THEN '- Retrieval (top-5, ' || n || ' queries): avg ' || printf('%.1f', round_even(mean, 1))
          || ' ms / p95 ' || slow || ' ms' || {NL} ELSE '' END
  || CASE WHEN pilot_id % 4 <> 1 THEN '- Generation (' || {pick(vocab.SECTION_TYPES, "pilot_id % 11")} || '): ' || most || ' ms, ' || pilot_id % 6
          || ' citations, prompt ' || n * 100 || ' chars' || {NL} ELSE '' END
  || {lit(reports.PILOT_SMOKE_HEAD)} || '- Verdict: **' || CASE WHEN smoke_passed THEN 'PASS' ELSE 'FAIL' END
  || '** (exit code ' || CASE WHEN smoke_passed THEN 0 ELSE 1 END || ')'
  || CASE WHEN smoke_passed THEN '' ELSE {NL} || '- Detail: probe ' || pilot_id || ' got out' END
  || {lit(reports.PILOT_VERDICT_HEAD)} || '**' || upper(verdict) || '**' || {NL} || {NL} || {_ADVICE} FROM pilot_records""",
)
oracle(
    "section_results",
    ("drafts", "verdicts"),
    "SELECT d.draft_path, d.section_type, v.citation_count, length(d.text) AS draft_length, d.elapsed_ms, v.passed AS audit_passed "
    "FROM drafts d JOIN verdicts v USING (draft_path)",
)
oracle(
    "latency_rollup",
    (),
    f"""
SELECT event_type AS probe, count(*) AS query_count, min(ms) AS elapsed_ms_min, round(avg(ms), 6) AS elapsed_ms_avg,
       {P95} AS elapsed_ms_p95, max(ms) AS elapsed_ms_max,
       round(avg(event_id % 6), 6) AS result_count_avg
FROM (SELECT *, CAST(floor(value) AS INTEGER) AS ms FROM events) GROUP BY 1""",
)
oracle(
    "indexing_throughput",
    ("chunks",),
    """
SELECT call_id, proposal_count, chunk_count, elapsed_ms, round(elapsed_ms / proposal_count, 6) AS per_proposal_ms_avg,
       round(CASE WHEN elapsed_ms = 0 THEN 0.0 ELSE chunk_count / (elapsed_ms / 1000.0) END, 6) AS chunks_per_second
FROM (SELECT call_id, count(DISTINCT document_id) AS proposal_count, count(*) AS chunk_count,
             CAST(sum(length(text)) // 100000 AS BIGINT) AS elapsed_ms FROM chunks GROUP BY 1)""",
)
oracle(
    "generation_measurements",
    ("drafts",),
    "SELECT draft_path, section_type, elapsed_ms, CAST(n AS BIGINT) AS citation_count, top_k AS top_k_examples, "
    "length(critique) AS prompt_length, length(text) AS draft_length FROM drafts",
)
oracle(
    "guidance_coverage",
    ("chunks",),
    f"""
SELECT programme, section_type, chunks, {_profile_case("name")} AS profile_name,
       coalesce({_profile_case("guidance")}, {sql_case("section_type", dimensions.SECTION_GUIDANCE)}) AS guidance,
       coalesce(len(string_split({_profile_case("outputs")}, {NL})), 0) AS outputs
FROM (SELECT programme, section_type, count(*) AS chunks FROM chunks GROUP BY 1, 2)""",
)
oracle(
    "status_notes",
    ("chunks",),
    f"""
SELECT source_status, count(*) AS chunks, {sql_case("source_status", vocab.STATUS_LABEL)} AS label,
       {sql_case("source_status", vocab.STATUS_BADGE)} AS badge, {sql_case("source_status", vocab.STATUS_CAVEAT)} AS caveat
FROM chunks GROUP BY source_status""",
)

# --- events and egress --------------------------------------------------------------------------------------------------------------------

_MIX = ", ".join(
    f"CASE WHEN {s} > 0 THEN '\"{s}\":' || {s} END" for s in vocab.SOURCE_STATUSES
)
_COUNTS = ", ".join(
    f"count(*) FILTER (c.source_status = '{s}') AS {s}" for s in vocab.SOURCE_STATUSES
)
oracle(
    "draft_events",
    ("drafts", "cites"),
    f"""
SELECT draft_path, 'draft_completed' AS event_type, section_type, elapsed_ms AS generation_time_ms,
       CAST(n AS BIGINT) AS citation_count, '{{' || concat_ws(',', {_MIX}) || '}}' AS source_status_mix,
       iteration AS iteration_count
FROM (SELECT d.draft_path, d.section_type, d.elapsed_ms, d.n, d.iteration, {_COUNTS}
      FROM drafts d LEFT JOIN cites c USING (draft_path) GROUP BY ALL)""",
)
_SORTED_MIX = ", ".join(f"CASE WHEN {s} > 0 THEN '\"{s}\":' || {s} END" for s in sorted(vocab.SOURCE_STATUSES))


def _line(**fields: str) -> str:
    """A JSON object with these fields in the order of their names; values are SQL, strings quoted by to_json."""
    parts = [f"'\"{name}\":' || coalesce(CAST({value} AS VARCHAR), 'null')" for name, value in sorted(fields.items())]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _at(number: str) -> str:
    return f"to_json(strftime(make_timestamp((1700000000 + {number} * 7) * 1000000), '%Y-%m-%dT%H:%M:%SZ'))"


_STUB = "'\"deterministic-stub-v1\"'"
_PROFILE_NAME = sql_case("programme", {k: p["name"] for k, p in dimensions.PROFILES.items()})
oracle(
    "usage_event_lines",
    ("requests", "drafts", "cites", "rendered", "verdicts"),
    f"""
SELECT 'request ' || query_id AS origin, {_line(
        event_type="'" + '"draft_started"' + "'", section_type="to_json(section_type)", target_programme="to_json(programme)",
        top_k_examples="top_k", lessons_learned="coalesce(lessons_learned, false)", model=_STUB,
        drafting_profile=f"to_json({_PROFILE_NAME})", topic_context_present="query_id % 3 = 0", timestamp=_at("query_id"))} AS value
FROM requests WHERE section_type IS NOT NULL
UNION ALL
SELECT 'draft ' || draft_path, {_line(
        event_type="'" + '"draft_completed"' + "'", section_type="to_json(section_type)", generation_time_ms="elapsed_ms",
        citation_count="n", source_status_mix="'{' || concat_ws(',', " + _SORTED_MIX + ") || '}'", model=_STUB,
        drafting_profile="NULL", iteration_count="iteration", timestamp=_at("length(text)"))}
FROM (SELECT d.draft_path, d.section_type, d.elapsed_ms, d.n, d.iteration, d.text, {_COUNTS}
      FROM drafts d LEFT JOIN cites c USING (draft_path) GROUP BY ALL)
UNION ALL
SELECT 'export ' || draft_path, {_line(
        event_type="'" + '"export"' + "'", kind="'" + '"markdown"' + "'", byte_count="size", section_type="to_json(section_type)",
        timestamp=_at("size"))}
FROM (SELECT draft_path, section_type, CAST(octet_length(encode(rendered)) AS BIGINT) AS size
      FROM rendered JOIN verdicts USING (draft_path) WHERE passed)
UNION ALL
SELECT 'signal ' || event_id, {_line(
        event_type="'" + '"feedback"' + "'", feedback_type="to_json(['thumbs_up', 'thumbs_down', 'regenerate'][1 + event_id % 3])",
        accepted="event_id % 2 = 0", section_type=f"to_json(CASE WHEN event_id % 5 <> 0 THEN {pick(vocab.SECTION_TYPES, 'event_id % 11')} END)",
        iteration_index="CASE WHEN event_id % 4 <> 0 THEN event_id % 6 END", timestamp=_at("event_id"))}
FROM events""",
)
oracle(
    "event_export_counts",
    (),
    "SELECT event_id // 1000 AS part, count(*) FILTER (event_id % 9 <> 4) AS exported, "
    "count(*) FILTER (event_id % 9 = 4) AS blank FROM events GROUP BY 1",
)
view(
    "attempts",
    (),
    f"""
SELECT page_id, epoch_ms((1700000000 + page_id * 61) * 1000) AS ts,
       CASE WHEN page_id % 4 = 3 THEN {pick(views.LOOPBACKS, "(page_id // 4) % 8")} ELSE upper(substr(h, 1, 1)) || substr(h, 2) END AS host,
       CASE WHEN scheme = 'https' THEN 443 ELSE 80 END AS port, scheme, path, 'job_' || (page_id % 3) AS source
FROM (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h,
             regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS path FROM pages)""",
)
_LIST = ", ".join(f"({p}, {quote(h.lower())}, {port}, {quote(r)})" for p, h, port, r in views.ALLOWLIST)
_LOOP = sql_list(
    [h for h in views.LOOPBACKS if h not in ("127.1", "128.0.0.1")]
)
view(
    "egress",
    ("attempts",),
    f"""
SELECT a.*, CASE WHEN list_contains({_LOOP}, host) OR l.reason IS NOT NULL THEN 'ALLOWED' ELSE 'DENIED' END AS decision,
       CASE WHEN list_contains({_LOOP}, host) THEN 'loopback' WHEN l.reason IS NOT NULL THEN 'allowlist match: ' || l.reason
            ELSE 'not on allowlist' END AS decision_reason
FROM attempts a LEFT JOIN (SELECT h, p, arg_min(r, i) AS reason FROM (VALUES {_LIST}) v(i, h, p, r) GROUP BY 1, 2) l
  ON l.h = lower(a.host) AND l.p = a.port""",
)
oracle(
    "egress_decisions",
    ("egress",),
    "SELECT page_id, host, CAST(port AS INTEGER) AS port, decision, decision_reason FROM egress",
)
oracle(
    "egress_log",
    ("egress",),
    """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, lower(host) AS host, CAST(port AS INTEGER) AS port, scheme,
       '/' || regexp_extract(path, '^/*([^/?#]*)', 1) AS path, decision, decision_reason AS reason, source FROM egress""",
)
