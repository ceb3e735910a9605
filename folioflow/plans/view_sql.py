"""The same views as ANSI SQL, written relationally, for checking against another engine."""

from __future__ import annotations

from folioflow import vocab
from folioflow.plans.views import HEADINGS, HEADINGS_ES, PROGRAMME_BY_LANG


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_case(key: str, mapping, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items())
    return f"CASE {key} {arms} ELSE {default} END"


NL = "chr(10)"


def section_type_sql(heading: str) -> str:
    arms = " ".join(
        f"WHEN contains(lower({heading}), {quote(needle)}) THEN {quote(section)}"
        for needle, section in vocab.SECTION_TYPE_RULES
    )
    return f"CASE {arms} ELSE 'other' END"


def chunk_id_sql(doc: str, heading: str, index: str) -> str:
    return (
        f"{doc} || '::' || substr(sha256(coalesce(nullif({heading}, ''), '{vocab.NO_SECTION}')), 1, 12)"
        f" || '::' || printf('%06d', {index})"
    )


def heading_sql(doc: str, lang: str, pos: str) -> str:
    return (
        f"({sql_list(HEADINGS)})[1 + ({doc} + {pos}) % "
        f"(CASE WHEN {lang} = 'es' THEN {HEADINGS_ES} ELSE {len(HEADINGS)} END)]"
    )


def _span_end(start: str) -> str:
    t, tol = vocab.TARGET_CHARS, vocab.BREAK_TOLERANCE
    at = f"({start} + {t})"
    window = f"substr(txt, {at} - {tol} + 1, least(n, {at} + {tol}) - ({at} - {tol}))"
    patterns = {
        "\n\n": "(?s)^.*\\n\\n",
        ". ": "(?s)^.*\\. ",
        "? ": "(?s)^.*\\? ",
        "! ": "(?s)^.*! ",
    }
    arms = " ".join(
        f"WHEN length(regexp_extract({window}, {quote(p)})) > 0 "
        f"THEN {at} - {tol} + length(regexp_extract({window}, {quote(p)}))"
        for p in patterns.values()
    )
    return f"CASE WHEN n - {start} <= {t} THEN n ELSE CASE {arms} ELSE {at} END END"


# name -> (names it needs, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, needs: tuple[str, ...], body: str) -> None:
    VIEWS[name] = (needs, body)


def with_views(needs: tuple[str, ...], final: str) -> str:
    """``WITH RECURSIVE`` clause holding ``needs`` and all they build on, then ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEWS[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{final}" if order else final


view(
    "proposals",
    (),
    f"""
SELECT d.doc_id, 'doc_' || d.doc_id AS document_id,
       {sql_case("d.lang", PROGRAMME_BY_LANG, "'other'")} AS programme,
       'CALL-' || upper(d.source) AS call_id,
       CASE WHEN d.doc_id % 3 = 0 THEN CAST(900000 + d.doc_id % 100000 AS VARCHAR) END AS topic_id,
       CAST(2014 + d.doc_id % 12 AS INTEGER) AS year,
       CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.quality = 0 THEN 'rejected'
            WHEN l.toxic = 1 THEN 'esr_note' ELSE 'funded' END AS outcome,
       string_split(d.text, {NL})[1] AS proposal_title,
       CASE WHEN d.doc_id % 5 = 0 THEN 'ACR-' || d.doc_id % 97 END AS consortium_acronym,
       CASE WHEN d.doc_id % 7 <> 3 THEN strftime(make_timestamp((1700000000 + d.doc_id * 60) * 1000000), '%Y-%m-%dT%H:%M:%S')
            || '+00:00' END AS ingested_at,
       'corpus/' || d.source || '/doc_' || d.doc_id || '.pdf' AS source_path,
       d.lang AS language, sha256(d.text) AS content_hash
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)

view(
    "doc_lines",
    (),
    f"""
SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no, len(ls) AS n_lines
FROM (SELECT doc_id, lang, string_split(text, {NL}) AS ls FROM documents)""",
)

view(
    "sections",
    ("doc_lines",),
    f"""
SELECT doc_id, 'doc_' || doc_id AS document_id, pos, {heading_sql("doc_id", "lang", "pos")} AS heading,
       txt, pos + 1 AS page
FROM (SELECT doc_id, any_value(lang) AS lang, line_no // 4 AS pos,
             CASE WHEN doc_id % 2 = 1 THEN string_agg(line, {NL} || {NL} ORDER BY line_no)
                  ELSE string_agg(line, {NL} ORDER BY line_no) END AS txt
      FROM doc_lines GROUP BY doc_id, line_no // 4)""",
)

view(
    "table_cells",
    ("doc_lines",),
    """
SELECT doc_id, line_no AS r, (j - 1) % 5 AS c, arg_max(word, j) AS cell
FROM (SELECT doc_id, line_no, unnest(ws) AS word, generate_subscripts(ws, 1) AS j
      FROM (SELECT doc_id, line_no, n_lines, string_split(line, ', ') AS ws FROM doc_lines)
     ) GROUP BY doc_id, line_no, (j - 1) % 5""",
)

view(
    "table_texts",
    ("table_cells", "doc_lines"),
    f"""
SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 1 + doc_id % 4 END AS page,
       string_agg(row_text, {NL} ORDER BY r) AS txt, count(*) AS n_rows
FROM (SELECT g.doc_id, g.r, string_agg(coalesce(trim(t.cell), ''), ' | ' ORDER BY g.c) AS row_text
      FROM (SELECT doc_id, line_no AS r, unnest([0, 1, 2, 3]) AS c FROM doc_lines
            WHERE line_no < n_lines - doc_id % 2) g
      LEFT JOIN table_cells t ON t.doc_id = g.doc_id AND t.r = g.r AND t.c = g.c
      GROUP BY g.doc_id, g.r)
GROUP BY doc_id""",
)

view(
    "table_homes",
    ("table_texts", "sections"),
    """
SELECT doc_id, page, txt, n_rows, pos, heading, section_page FROM (
  SELECT t.doc_id, t.page, t.txt, t.n_rows, s.pos, s.heading, s.page AS section_page,
         row_number() OVER (PARTITION BY t.doc_id ORDER BY
            CASE WHEN s.page = t.page THEN 0 WHEN s.page <= t.page THEN 1 ELSE 2 END,
            CASE WHEN s.page = t.page THEN s.pos ELSE -s.pos END) AS pick
  FROM table_texts t JOIN sections s ON s.doc_id = t.doc_id)
WHERE pick = 1""",
)

view(
    "raw_spans",
    ("sections",),
    f"""
SELECT doc_id, pos, txt, length(txt) AS n, 0 AS s, {_span_end("0").replace("n -", "length(txt) -").replace("least(n,", "least(length(txt),").replace("THEN n ELSE", "THEN length(txt) ELSE")} AS e,
       length(txt) <= {vocab.TARGET_CHARS} AS fin, 0 AS k
FROM sections WHERE length(txt) > 0
UNION ALL
SELECT doc_id, pos, txt, n, s2, {_span_end("s2")}, n - s2 <= {vocab.TARGET_CHARS}, k + 1
FROM (SELECT *, greatest(e - {vocab.OVERLAP_CHARS}, s + 1) AS s2 FROM raw_spans WHERE NOT fin)""",
)

view(
    "spans",
    ("raw_spans",),
    f"""
SELECT doc_id, pos, k, s AS char_start,
       CASE WHEN k = last_k - 1 AND tail_short THEN last_e ELSE e END AS char_end, txt
FROM (SELECT *, max(k) OVER w AS last_k, max(e) OVER w AS last_e,
             bool_or(fin AND k > 0 AND e - s < {vocab.MIN_CHUNK_CHARS}) OVER w AS tail_short
      FROM raw_spans WINDOW w AS (PARTITION BY doc_id, pos))
WHERE NOT (k = last_k AND tail_short)""",
)

view(
    "pieces",
    ("spans", "sections", "table_homes"),
    """
SELECT doc_id, pos, heading, false AS is_table, page, char_start, char_end,
       substr(sp.txt, char_start + 1, char_end - char_start) AS txt, k
FROM spans sp JOIN sections USING (doc_id, pos)
UNION ALL
SELECT doc_id, pos, heading, true, coalesce(page, section_page), NULL, NULL, txt, 0 FROM table_homes""",
)

view(
    "chunks",
    ("pieces", "proposals"),
    f"""
SELECT {chunk_id_sql("document_id", "heading", "chunk_index")} AS chunk_id, *
FROM (SELECT p.document_id, p.programme, p.call_id, p.topic_id, p.year, p.outcome AS source_status,
             p.proposal_title, p.consortium_acronym, p.source_path, p.language, p.ingested_at, p.content_hash,
             row_number() OVER (PARTITION BY c.doc_id ORDER BY c.pos, c.is_table, c.k) - 1 AS chunk_index,
             c.pos AS section_pos, c.heading, {section_type_sql("c.heading")} AS section_type,
             c.is_table, c.page, c.char_start, c.char_end, c.txt AS text
      FROM pieces c JOIN proposals p ON p.doc_id = c.doc_id
      WHERE trim(c.txt, ' ' || chr(9) || chr(10) || chr(13)) <> '')""",
)

view(
    "requests",
    (),
    f"""
SELECT item_id AS query_id, text AS query, CAST(3 + item_id % 5 AS INTEGER) AS top_k,
       CASE WHEN item_id % 4 <> 0 THEN ({sql_list(vocab.PROGRAMMES)})[1 + item_id % 5] END AS programme,
       CASE WHEN item_id % 3 <> 0 THEN ({sql_list(vocab.SECTION_TYPES)})[1 + item_id % 11] END AS section_type,
       CASE WHEN item_id % 10 = 9 THEN ({sql_list(vocab.SOURCE_STATUSES)})[1 + (item_id // 10) % 4] END AS source_status,
       CASE item_id % 4 WHEN 1 THEN true WHEN 2 THEN false END AS lessons_learned,
       CASE WHEN item_id % 7 = 5 THEN false END AS section_type_fallback
FROM benchmark""",
)

# --- vectors and scores -----------------------------------------------------------------


def _buckets(source: str, key: str, text: str) -> str:
    """Float bucket weights of a text, one row per (key, bucket)."""
    return f"""
SELECT key, bucket, CAST(CAST(CAST(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY key)) AS FLOAT) AS DOUBLE) AS DOUBLE) AS w
FROM (SELECT key, ('0x' || substr(sha256(tok), 1, 16))::UBIGINT % {vocab.HASH_EMBEDDING_DIM} AS bucket,
             CAST(count(*) AS DOUBLE) AS cnt
      FROM (SELECT {key} AS key, unnest(string_split_regex(lower({text}), '\\s+')) AS tok FROM {source})
      WHERE tok <> '' GROUP BY 1, 2)"""


view("chunk_weights", ("chunks",), _buckets("chunks", "chunk_id", "text"))
view("request_weights", ("requests",), _buckets("requests", "query_id", "query"))
view(
    "chunk_norms", ("chunk_weights",), "SELECT key, sqrt(sum(w * w)) AS norm FROM chunk_weights GROUP BY key"
)
view(
    "request_norms",
    ("request_weights",),
    "SELECT key, sqrt(sum(w * w)) AS norm FROM request_weights GROUP BY key",
)
view(
    "scores",
    ("chunk_norms", "request_norms"),
    """
SELECT q.query_id, c.chunk_id, round(coalesce(s.dot / (qn.norm * cn.norm), 0.0), 12) AS score
FROM requests q CROSS JOIN chunks c
LEFT JOIN (SELECT a.key AS chunk_id, b.key AS query_id, sum(a.w * b.w) AS dot
           FROM chunk_weights a JOIN request_weights b ON a.bucket = b.bucket GROUP BY 1, 2) s
  ON s.chunk_id = c.chunk_id AND s.query_id = q.query_id
LEFT JOIN chunk_norms cn ON cn.key = c.chunk_id
LEFT JOIN request_norms qn ON qn.key = q.query_id""",
)
view(
    "pools",
    ("scores", "requests"),
    """
SELECT query_id, chunk_id, source_status, score, relaxed FROM (
  SELECT s.query_id, s.chunk_id, c.source_status, s.score, v.relaxed, q.top_k,
         row_number() OVER (PARTITION BY s.query_id, v.relaxed ORDER BY s.score DESC, s.chunk_id) AS place
  FROM scores s JOIN chunks c USING (chunk_id) JOIN requests q USING (query_id)
  CROSS JOIN (VALUES (0), (1)) v(relaxed)
  WHERE (q.programme IS NULL OR q.programme = c.programme)
    AND (q.source_status IS NULL OR q.source_status = c.source_status)
    AND (v.relaxed = 1 OR q.section_type IS NULL OR q.section_type = c.section_type)
    AND (v.relaxed = 0 OR (q.section_type IS NOT NULL AND q.source_status IS NULL
                           AND coalesce(q.section_type_fallback, true))))
WHERE place <= least(100, 4 * top_k)""",
)
view(
    "pool",
    ("pools",),
    """
SELECT query_id, chunk_id, source_status, score, relaxed = 1 AS fell_back FROM pools p
WHERE relaxed = (SELECT min(relaxed) FROM pools o WHERE o.query_id = p.query_id)""",
)


def ranked_sql(
    threshold: float = 0.3,
    offset: float = 0.0,
    lessons_mode: bool = False,
    include_esr: bool = True,
    funded_first: bool = True,
    fraction: float = 0.4,
) -> str:
    """Ranking of ``pool`` under a policy."""
    shifted = min(1.0, max(0.0, threshold + offset))
    order = "priority, score DESC, chunk_id" if funded_first else "score DESC, priority, chunk_id"
    esr = "" if include_esr else "AND source_status <> 'esr_note'"
    cap = (
        f"WHERE lessons OR source_status <> 'rejected' OR nth <= floor(top_k * CAST({fraction} AS DOUBLE))"
        if fraction < 1.0
        else ""
    )
    reasons = sql_case("source_status", vocab.REASON_BY_STATUS)
    priority = " ".join(f"WHEN '{s}' THEN {p}" for s, p in vocab.STATUS_PRIORITY.items())
    return f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, source_status, round(score, 6) AS score,
       CASE WHEN source_status = 'rejected' AND lessons THEN '{vocab.REASON_LESSONS}' ELSE {reasons} END
       || CASE WHEN fell_back THEN '{vocab.REASON_FALLBACK_SUFFIX}' ELSE '' END AS policy_reason
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
      FROM (SELECT *, count(*) FILTER (source_status = 'rejected')
                        OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS nth
            FROM (SELECT p.*, q.top_k, coalesce(q.lessons_learned, {str(lessons_mode).lower()}) AS lessons,
                         CASE p.source_status {priority} END AS priority
                  FROM pool p JOIN requests q USING (query_id))
            WHERE score >= CASE WHEN lessons AND source_status = 'rejected' THEN {shifted} ELSE {threshold} END
            {esr})
      {cap})
WHERE rank <= top_k"""
