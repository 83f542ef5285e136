"""For each query of the catalogue that SQL can express, DuckDB SQL over the same tables that gives the same rows."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"


def _bm25(top_k: int, where: str = "TRUE", least: str = "score > 0") -> str:
    """Common table expressions up to bm (query_id, chunk_id, score, rank)."""
    return rf"""
    d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents WHERE {where}),
    st AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM d),
    tok AS (SELECT chunk_id, len(t) AS l, unnest(t) AS term FROM d),
    q AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM benchmark),
    p AS (SELECT term, chunk_id, l, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT query_id, chunk_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS score
          FROM p JOIN df USING (term) JOIN q USING (term) CROSS JOIN st GROUP BY ALL),
    bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE {least}) WHERE rank <= {top_k})"""


_HASHED = """list_transform(range(32), lambda k: CAST(('0x' || substr(sha256(text), CAST(k * 2 + 1 AS BIGINT), 2)) AS INTEGER) / 255.0::DOUBLE)"""


def _dense_hash(top_k: int) -> str:
    return f"""
    dq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {_HASHED} AS v FROM benchmark),
    dp AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_HASHED} AS v FROM documents),
    dsc AS (SELECT query_id, chunk_id, list_cosine_similarity(dq.v, dp.v) AS score FROM dq CROSS JOIN dp),
    de AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM dsc) WHERE rank <= {top_k})"""


def _hybrid(top_k: int, k: int) -> str:
    return f"""{_bm25(top_k)}, {_dense_hash(top_k)},
    fu AS (SELECT query_id, chunk_id, coalesce({k}.0 / ({k} + de.rank), 0) + coalesce({k}.0 / ({k} + bm.rank), 0) AS score, coalesce(de.rank, 0) AS dr, coalesce(bm.rank, 0) AS br
           FROM de FULL JOIN bm USING (query_id, chunk_id)),
    hy AS (SELECT * FROM (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 9) DESC, dr, br, chunk_id) AS INTEGER) AS rank FROM fu) WHERE rank <= {top_k})"""


_HIT = "SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM "


def _dense(where: str = "TRUE", top_k: int = 5, least: str = "TRUE") -> str:
    return f"""WITH s AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS chunk_id,
        list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
        FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0 AND {where}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE {least})
    {_HIT} r WHERE rank <= {top_k}"""


_GOLD = "gold AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_GRID = "grid AS (SELECT CAST(item_id AS VARCHAR) AS query_id, k FROM benchmark, (SELECT unnest([1, 3, 5, 10]) AS k))"


def _at_k(hits: str) -> str:
    return f"""
    g_n AS (SELECT query_id, count(*) AS size FROM gold GROUP BY 1),
    h AS (SELECT r.query_id, r.rank, r.chunk_id, g.chunk_id IS NOT NULL AS hit FROM {hits} r LEFT JOIN gold g ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id),
    atk AS (SELECT x.query_id, x.k, coalesce(count(*) FILTER (hit) / nullif(count(h.rank), 0), 0) AS precision, coalesce(count(DISTINCT h.chunk_id) FILTER (hit) / any_value(size), 0) AS recall
            FROM grid x LEFT JOIN h ON x.query_id = h.query_id AND h.rank <= x.k LEFT JOIN g_n ON x.query_id = g_n.query_id GROUP BY 1, 2),
    mrr AS (SELECT q.query_id, coalesce(1.0::DOUBLE / min(h.rank) FILTER (hit), 0) AS reciprocal_rank FROM (SELECT DISTINCT query_id FROM grid) q LEFT JOIN h USING (query_id) GROUP BY 1)"""


def _strategy(name: str, ctes: str, hits: str) -> str:
    return f"""SELECT * FROM (WITH {ctes}, {_GOLD}, {_GRID}, {_at_k(hits)}
    SELECT '{name}' AS strategy, CAST(k AS INTEGER) AS k, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, (SELECT round(avg(reciprocal_rank), 6) FROM mrr) AS mrr FROM atk GROUP BY k)"""


_DAMAGED = "CASE length(text) % 4 WHEN 0 THEN text || '(cid:12)(cid:7)' WHEN 1 THEN chr(65533) || chr(65533) || text WHEN 2 THEN text || chr(1) || chr(2) ELSE text END"


def _quality(text: str) -> str:
    def total(p: str, x: str) -> str:
        return f"length(array_to_string(regexp_extract_all({x}, '{p}'), ''))"

    plain = f"translate({text}, chr(10) || chr(13) || chr(9), '')"
    bad = rf"({total(r'\(cid:\d+\)', text)} + {total('�', text)} + {total(r'[\p{Cc}\p{Cf}\p{Co}]', plain)})"
    return f"CASE WHEN length({text}) = 0 THEN 1.0 ELSE round(greatest(0.0, 1 - {bad} / greatest(length({text}), 1)), 6) END"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _key(x: str) -> str:
    return rf"regexp_replace(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), '\d+', '#', 'g')"


_BLOCKS = """bl AS (SELECT source AS doc_id, doc_id AS page, unnest([
        {'edge': true, 'text': 'Report  on ' || source || ' 2024'}, {'edge': false, 'text': text}, {'edge': true, 'text': 'Page ' || doc_id || ' of 99'}], recursive := true) FROM documents)"""
_EDGES = f"""{_BLOCKS}, pn AS (SELECT doc_id, count(DISTINCT page) AS pages FROM bl GROUP BY 1),
    kn AS (SELECT doc_id, {_key("text")} AS key, count(*) AS n FROM bl WHERE edge GROUP BY 1, 2),
    re AS (SELECT doc_id, key, n FROM kn JOIN pn USING (doc_id) WHERE n >= greatest(2, ceil(pages * 0.6)))"""

_SENTENCES = rf"""list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: {_strip("s")}), lambda s: s <> '')"""
_PARAS = rf"""list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda s: {_strip("s")}), lambda s: s <> '')"""
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
_MID = r"""CASE WHEN regexp_replace(x, '\s+', '', 'g') = '' THEN FALSE ELSE NOT regexp_matches(regexp_replace(x, '[\s"''”’)\]}]+$', ''), '[.!?]$') END"""

_FIXED = f"""WITH RECURSIVE doc AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_SENTENCES} AS s FROM documents WHERE {_strip("text")} <> ''),
    f(doc_id, i, done, cur, run) AS (
        SELECT doc_id, 0, CAST([] AS VARCHAR[]), '', 0 FROM doc
        UNION ALL
        SELECT f.doc_id, f.i + 1,
            CASE WHEN f.cur <> '' AND f.run + n > 100 AND greatest(1, length(f.cur) // 4) >= 10 THEN list_append(f.done, f.cur) ELSE f.done END,
            CASE WHEN f.cur <> '' AND f.run + n > 100 THEN carried ELSE joined END,
            CASE WHEN f.cur <> '' AND f.run + n > 100 THEN greatest(1, length(carried) // 4) ELSE f.run + n END
        FROM (SELECT f.*, greatest(1, length(doc.s[f.i + 1]) // 4) AS n,
                (CASE WHEN greatest(1, length(f.cur) // 4) <= 10 THEN f.cur ELSE right(f.cur, 40) END) || ' ' || doc.s[f.i + 1] AS carried,
                CASE WHEN f.cur = '' THEN doc.s[f.i + 1] ELSE f.cur || ' ' || doc.s[f.i + 1] END AS joined
              FROM f JOIN doc USING (doc_id) WHERE f.i < len(doc.s)) f),
    e AS (SELECT f.* FROM f JOIN doc USING (doc_id) WHERE f.i = len(doc.s)),
    a AS (SELECT doc_id, list_concat(done, CASE WHEN greatest(1, length(cur) // 4) > 100
            THEN list_concat([cur], list_filter(list_transform(range(0, length(cur), 400), lambda j: substr(cur, CAST(j + 1 AS BIGINT), 400)), lambda w: greatest(1, length(w) // 4) >= 10))
            WHEN cur <> '' AND greatest(1, length(cur) // 4) >= 10 THEN [cur] ELSE [] END) AS done FROM e),
    u AS (SELECT doc_id, unnest(done) AS text, generate_subscripts(done, 1) - 1 AS chunk_index FROM a),
    c AS (SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, {_strip("text")} AS text FROM u)
    SELECT doc_id, chunk_index, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count,
        'chunk_' || doc_id || '_' || substr(sha256(doc_id || ':' || chunk_index || ':1:1'), 1, 8) || '_' || substr(sha256(text), 1, 16) AS chunk_id FROM c"""

_HEAD = r"regexp_replace(line, '\s+', ' ', 'g')"
_HEADS = f"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT doc_id, n, CASE (doc_id + n) % 8 WHEN 0 THEN 'Item ' || ((doc_id + n) % 16) || 'A. ' || {_HEAD} WHEN 1 THEN translate({_HEAD}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN 'Years ended ' || {_HEAD}
    WHEN 3 THEN '(' || {_HEAD} || ')' WHEN 4 THEN {_HEAD} || ', Inc.' WHEN 5 THEN '2013 and 201' || ((doc_id + n) % 10)
    WHEN 6 THEN ['REPORT OF INDEPENDENT REGISTERED PUBLIC ACCOUNTING FIRM', 'INDEX TO CONSOLIDATED FINANCIAL STATEMENTS', 'SIGNATURES', 'PART I', 'PART II', 'PART III', 'PART IV'][(doc_id + n) % 7 + 1] ELSE {_HEAD} END AS h FROM l),
    t AS (SELECT doc_id, n, {_strip("h")} AS s FROM h),
    f AS (SELECT *, regexp_matches(s, ',$|^\\d{{4}}(\\s+\\d{{4}})+\\s+\\(|Data:$|\\d{{4}} and \\d{{4}}$|^\\s*\\(|^Years ended |^As of ') AS label,
        regexp_matches(s, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(INC\\.?|CORP\\.?|CORPORATION|LLC\\.?|LTD\\.?|LIMITED|CO\\.?|COMPANY)\\.?$|(^|[^\\p{{L}}\\p{{N}}_])AND\\s+SUBSIDIARIES\\.?$') AS company,
        regexp_matches(s, '(?i)^ITEM\\s+\\d+[A-C]?\\.\\s*\\S') AS item,
        upper(s) IN ('REPORT OF INDEPENDENT REGISTERED PUBLIC ACCOUNTING FIRM', 'INDEX TO CONSOLIDATED FINANCIAL STATEMENTS', 'SIGNATURES', 'PART I', 'PART II', 'PART III', 'PART IV') AS marker FROM t)"""

_SIDES = """tg AS (SELECT 'd' || doc_id AS id, source AS doc_id, source || '.pdf' AS source_file, lang AS section_heading FROM documents),
    so AS (SELECT tg.id, tg.doc_id, CASE WHEN quality = 1 THEN source_file ELSE '' END AS source_file, section_heading FROM tg JOIN labels l ON tg.id = 'd' || l.doc_id
        UNION ALL SELECT 'c' || conv_id || '-' || turn, 'conv' || conv_id, NULL, '' FROM conversations),
    ac AS (SELECT coalesce(t.id, s.id) AS id, coalesce(t.doc_id, s.doc_id) AS doc_id,
        CASE WHEN s.id IS NULL THEN 'upsert' WHEN t.id IS NULL THEN 'delete'
             WHEN nullif(t.source_file, '') IS DISTINCT FROM nullif(s.source_file, '') OR nullif(t.section_heading, '') IS DISTINCT FROM nullif(s.section_heading, '') THEN 'patch' ELSE 'keep' END AS action
        FROM tg t FULL JOIN so s ON t.id = s.id)"""

_HITS = """hi AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, conv_id || '-' || turn AS chunk_id, role AS doc_id, CASE WHEN length(text) % 11 = 0 THEN 'dir/' || role ELSE role || '.pdf' END AS source_file,
    CAST(turn AS INTEGER) AS page_start, CAST(turn + length(text) % 3 - 1 AS INTEGER) AS page_end, CASE WHEN length(text) % 5 = 0 THEN 'Notes [1]' ELSE 'Notes' END AS section_heading, text, turn FROM conversations),
    ev AS (SELECT *, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY turn, chunk_id) AS evidence_id FROM hi)"""
_REPLIES = f"""{_HITS}, rp AS (SELECT query_id, substr(text, 3, 20) AS quote, length(text) % 5 AS kind, text, source_file, page_start, page_end, section_heading FROM ev WHERE evidence_id = 'E1')"""


def _uuid5(name: str) -> str:
    h = f"sha1(unhex('00000000000000000000000000000001') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({h}, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


_CID = "'chunk_' || conv_id || '_' || substr(sha256(conv_id || ':' || turn || ':1:2'), 1, 8) || '_' || substr(sha256(text), 1, 16)"


def _json_length(c: str) -> str:
    return rf"""(length({c}) + 2 + length(regexp_replace({c}, '[^"\\\n\r\t\x08\f]', '', 'g')) + 5 * length(regexp_replace({c}, '[^\x00-\x07\x0B\x0E-\x1F]', '', 'g')))"""


_GRID_ROWS = f"""wg AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(0, len(w), 3), lambda k: w[k + 1:k + 3]) AS grid FROM wg WHERE len(w) > 0)"""
_CELL = r"""replace(trim(regexp_replace(regexp_replace(c, '[\p{Co}\p{Cf}]', '', 'g'), '\s+', ' ', 'g')), '|', '\|')"""
_LINES = f"""list_transform(grid, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: {_CELL}), list_transform(range(CAST(list_max(list_transform(grid, lambda y: len(y))) - len(r) AS BIGINT)), lambda z: '')), ' | ') || ' |')"""


def _tokens(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def _merge(name: str, source: str, size: int, overlap: int, least: int) -> str:
    """Common table expressions up to name (id, chunks): the parts of source (id, parts) in chunks, as lists."""
    enough = lambda x: f"CASE WHEN {x} <> '' AND {_tokens(x)} >= {least} THEN [{x}] ELSE CAST([] AS VARCHAR[]) END"
    windows = f"list_filter(list_transform(range(0, length(s1), {4 * size}), lambda j: substr(s1, CAST(j + 1 AS BIGINT), {4 * size})), lambda w: {_tokens('w')} >= {least})"
    return rf"""
    {name}_se AS (SELECT id, k, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)) AS s FROM (SELECT id, generate_subscripts(parts, 1) AS k, unnest(parts) AS p FROM {source}) WHERE k > 1 AND {_tokens('p')} > {size}),
    {name}_bf(id, k, i, done, cur) AS (
        SELECT id, k, 0, CAST([] AS VARCHAR[]), '' FROM {name}_se
        UNION ALL
        SELECT id, k, i + 1,
            CASE WHEN {_tokens('s1')} > {size} THEN list_concat(done, list_concat({enough('cur')}, {windows})) WHEN cur = '' OR {_tokens("cur || ' ' || s1")} <= {size} THEN done ELSE list_concat(done, {enough('cur')}) END,
            CASE WHEN {_tokens('s1')} > {size} THEN '' WHEN cur = '' THEN s1 WHEN {_tokens("cur || ' ' || s1")} <= {size} THEN cur || ' ' || s1 ELSE s1 END
        FROM (SELECT b.*, e.s[b.i + 1] AS s1 FROM {name}_bf b JOIN {name}_se e USING (id, k) WHERE b.i < len(e.s))),
    {name}_bu AS (SELECT b.id, b.k, list_concat(b.done, {enough('b.cur')}) AS burst FROM {name}_bf b JOIN {name}_se e USING (id, k) WHERE b.i = len(e.s)),
    {name}_f(id, i, done, cur) AS (
        SELECT id, 1, CAST([] AS VARCHAR[]), parts[1] FROM {source} WHERE len(parts) > 0
        UNION ALL
        SELECT id, i + 1,
            CASE WHEN {_tokens('p')} > {size} THEN list_concat(done, list_concat({enough('cur')}, burst)) WHEN {_tokens("cur || ' ' || p")} <= {size} THEN done ELSE list_concat(done, {enough('cur')}) END,
            CASE WHEN {_tokens('p')} > {size} THEN '' WHEN {_tokens("cur || ' ' || p")} <= {size} THEN cur || ' ' || p WHEN tail <> '' THEN tail || ' ' || p ELSE p END
        FROM (SELECT f.*, d.parts[f.i + 1] AS p, b.burst, CASE WHEN {_tokens('f.cur')} <= {overlap} THEN f.cur ELSE right(f.cur, {4 * overlap}) END AS tail
              FROM {name}_f f JOIN {source} d USING (id) LEFT JOIN {name}_bu b ON b.id = f.id AND b.k = f.i + 1 WHERE f.i < len(d.parts))),
    {name} AS (SELECT f.id, list_concat(f.done, {enough('f.cur')}) AS chunks FROM {name}_f f JOIN {source} d USING (id) WHERE f.i = len(d.parts))"""


def _split(text: str, size: int) -> str:
    """Paragraphs, else sentences, else groups of words."""
    paragraphs = rf"list_filter(list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')"
    sentences = _SENTENCES.replace("(text,", f"({text},")
    words = _WORDS.replace("(text,", f"({text},")
    groups = f"list_transform(range(0, len({words}), {size // 4}), lambda k: array_to_string({words}[k + 1:k + {size // 4}], ' '))"
    return f"CASE WHEN len({paragraphs}) > 1 THEN {paragraphs} WHEN len({sentences}) > 1 THEN {sentences} ELSE {groups} END"


_CHUNK_ID = "'chunk_' || doc_id || '_' || substr(sha256(doc_id || ':' || chunk_index || ':' || page || ':' || page), 1, 8) || '_' || substr(sha256(text), 1, 16)"
_RECURSIVE = f"""WITH RECURSIVE dp AS (SELECT doc_id AS id, {_split('text', 100)} AS parts FROM documents WHERE {_strip('text')} <> ''), {_merge('mg', 'dp', 100, 10, 10)},
    c AS (SELECT CAST(id AS VARCHAR) AS doc_id, 1 AS page, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk_index, unnest(chunks) AS raw FROM mg),
    d AS (SELECT *, {_strip('raw')} AS text FROM c)
    SELECT doc_id, chunk_index, CAST({_tokens('text')} AS INTEGER) AS token_count, {_CHUNK_ID} AS chunk_id FROM d"""

_TABLES = f"""WITH RECURSIVE {_GRID_ROWS}, gl AS (SELECT doc_id, list_transform({_LINES}, lambda l: trim(l)) AS lines, '| ' || array_to_string(list_transform(range(CAST(list_max(list_transform(grid, lambda y: len(y))) AS BIGINT)), lambda z: '---'), ' | ') || ' |' AS rule FROM g),
    h AS (SELECT doc_id, lines, lines[1] || chr(10) || rule AS head FROM gl),
    f(doc_id, i, used, part) AS (
        SELECT doc_id, 2, {_tokens('head')} + {_tokens('lines[2]')}, 0 FROM h WHERE len(lines) > 1
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN used + n + 1 > 100 THEN base + n ELSE used + n + 1 END, CASE WHEN used + n + 1 > 100 THEN part + 1 ELSE part END
        FROM (SELECT f.*, {_tokens('h.lines[f.i + 1]')} AS n, {_tokens('h.head')} AS base FROM f JOIN h USING (doc_id) WHERE f.i < len(h.lines))),
    t AS (SELECT f.doc_id, f.part, any_value(h.head) || chr(10) || string_agg(h.lines[f.i], chr(10) ORDER BY f.i) AS text FROM f JOIN h USING (doc_id) GROUP BY 1, 2
        UNION ALL SELECT doc_id, 0, head FROM h WHERE len(lines) = 1),
    u AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, part, part = max(part) OVER (PARTITION BY doc_id) AS last FROM t),
    c AS (SELECT doc_id, text, 1 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS chunk_index FROM u WHERE NOT last OR {_tokens('text')} >= 10)
    SELECT doc_id, chunk_index, CAST({_tokens('text')} AS INTEGER) AS token_count, {_CHUNK_ID} AS chunk_id FROM c"""


def _bare(x: str) -> str:
    flat = rf"regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        flat = f"replace({flat}, '{entity}', '{char}')"
    return f"trim({flat})"


def _without(html: str) -> str:
    for tag in ("nav", "footer", "script", "style", "head"):
        html = rf"regexp_replace({html}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    return html


_HTML = rf"""hb AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, {_without("coalesce(html, '')")} AS body FROM pages),
    hl AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(body, '(?is)<(?:h1|p|li)\b[^>]*>(.*?)</(?:h1|p|li)>', 1), lambda x: {_bare('x')}), lambda x: x <> '') AS blocks,
        list_filter(list_transform(regexp_extract_all(body, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), lambda x: {_bare('x')}), lambda x: x <> '') AS h1 FROM hb),
    hp AS (SELECT doc_id, array_to_string(blocks, chr(10)) AS text, list_filter(h1, lambda x, i: list_position(h1, x) = i) AS headings FROM hl)"""
_LABEL = r"',$|^\d{4}(\s+\d{4})+\s+\(|Data:$|\d{4} and \d{4}$|^\s*\(|^Years ended |^As of '"
_DETECTED = rf"""WITH {_HTML}, ln AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS position, unnest(string_split(text, chr(10))) AS line, headings FROM hp),
    sz AS (SELECT doc_id, position, trim(regexp_replace(regexp_replace(line, '[\p{{Co}}\p{{Cf}}]', '', 'g'), '\s+', ' ', 'g')) AS heading, CASE WHEN list_contains(headings, line) THEN 18.0 ELSE 10.0 END AS size FROM ln),
    bs AS (SELECT *, median(size) OVER (PARTITION BY doc_id) AS base, regexp_matches(heading, '(?i)^Item\s+\d+[A-C]?\.\s+\S') AS item FROM sz)
    SELECT doc_id, 1 AS page_number, CAST(min(position) AS INTEGER) AS position, heading FROM bs WHERE heading <> '' AND length(heading) <= CASE WHEN item THEN 160 ELSE 60 END
        AND NOT regexp_matches(heading, '^(,$|\d{{4}}(\s+\d{{4}})+\s+\()') AND (size >= base * 1.25 OR item) GROUP BY doc_id, heading"""

_LINE_HEAD = r"""(regexp_matches(s, '^[A-Z][A-Z\s\d.\-,:]+$') OR regexp_matches(s, '^[\d.]+\s+[A-Z]') OR regexp_matches(s, '^[A-Z][A-Z\s\d.\-]{2,}$') OR regexp_matches(s, '(?i)^Item\s+\d+[A-Z]?\.\s*\S?'))"""
_STRUCTURE = rf"""WITH RECURSIVE {_HTML},
    kn AS (SELECT doc_id, text, generate_subscripts(headings, 1) AS n, unnest(headings) AS h FROM hp),
    po AS (SELECT doc_id, text, n, h, unnest(list_filter(range(1, length(text) - length(h) + 2), lambda p: substr(text, p, length(h)) = h)) AS p FROM kn),
    li AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM hp WHERE doc_id NOT IN (SELECT doc_id FROM po)),
    lo AS (SELECT *, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin, {_strip('line')} AS s FROM li),
    hd AS (SELECT doc_id, text, n, h, p FROM po UNION ALL SELECT doc_id, text, n, s, CAST(begin + length(line) - length(ltrim(line)) AS BIGINT) FROM lo WHERE s <> '' AND length(s) < 150 AND {_LINE_HEAD}),
    hx AS (SELECT *, p - length(regexp_extract(substr(text, 1, p - 1), '[^\n]*$')) AS begin, CASE WHEN strpos(substr(text, p), chr(10)) > 0 THEN p + strpos(substr(text, p), chr(10)) - 1 ELSE length(text) + 1 END AS stop FROM hd),
    hn AS (SELECT *, row_number() OVER w AS j, lead(begin, 1, length(text) + 2) OVER w AS below FROM hx WINDOW w AS (PARTITION BY doc_id ORDER BY p, n)),
    bd AS (SELECT doc_id, j, h, {_strip("array_to_string(list_concat(list_filter([" + _strip("substr(text, begin, p - begin)") + ", " + _strip("substr(text, p + length(h), stop - p - length(h))") + "], lambda x: x <> ''), CASE WHEN below > stop + 1 THEN [substr(text, stop + 1, below - stop - 2)] ELSE [] END), chr(10))")} AS body FROM hn),
    sx AS (SELECT doc_id, j, h, h || chr(10) || chr(10) || body AS text FROM bd WHERE body <> ''
        UNION ALL SELECT doc_id, 0, NULL, {_strip('substr(text, 1, begin - 1)')} FROM hn WHERE j = 1 AND {_strip('substr(text, 1, begin - 1)')} <> ''
        UNION ALL SELECT doc_id, 0, NULL, text FROM hp WHERE doc_id NOT IN (SELECT doc_id FROM hn) AND {_strip('text')} <> ''),
    dp AS (SELECT {{'doc': doc_id, 'j': j, 'h': h}} AS id, {_split('text', 100)} AS parts FROM sx), {_merge('mg', 'dp', 100, 10, 10)},
    c AS (SELECT id.doc AS doc_id, id.h AS section_heading, id.j AS j, generate_subscripts(chunks, 1) AS k, unnest(chunks) AS raw FROM mg),
    d AS (SELECT doc_id, section_heading, 1 AS page, {_strip('raw')} AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j, k) - 1 AS INTEGER) AS chunk_index FROM c)
    SELECT doc_id, chunk_index, section_heading, CAST({_tokens('text')} AS INTEGER) AS token_count, {_CHUNK_ID} AS chunk_id FROM d"""

_ATTACHED = rf"""WITH RECURSIVE tu AS (SELECT conv_id, turn, translate(substr(text, 1, 24), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS h, translate(substr(text, 1, 24), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || ' ' || text AS text FROM conversations WHERE text IS NOT NULL),
    dp AS (SELECT {{'c': conv_id, 't': turn}} AS id, {_split('text', 60)} AS parts FROM tu WHERE {_strip('text')} <> ''), {_merge('mg', 'dp', 60, 6, 5)},
    t AS (SELECT conv_id, turn, h, {_strip('h')} AS s FROM tu),
    v AS (SELECT conv_id, turn, h FROM t WHERE s <> '' AND length(s) <= CASE WHEN regexp_matches(s, '(?i)^ITEM\s+\d+[A-C]?\.\s*\S') THEN 160 ELSE 60 END AND NOT regexp_matches(s, {_LABEL})
        AND NOT regexp_matches(s, '(?i)(^|[^\p{{L}}\p{{N}}_])(INC\.?|CORP\.?|CORPORATION|LLC\.?|LTD\.?|LIMITED|CO\.?|COMPANY)\.?$|(^|[^\p{{L}}\p{{N}}_])AND\s+SUBSIDIARIES\.?$')),
    c AS (SELECT id.c AS conv_id, id.t AS page, generate_subscripts(chunks, 1) AS k, unnest(chunks) AS raw FROM mg),
    d AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS doc_id, page, {_strip('raw')} AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page, k) - 1 AS INTEGER) AS chunk_index FROM c)
    SELECT doc_id, chunk_index, {_CHUNK_ID} AS chunk_id, (SELECT arg_max(v.h, v.turn) FROM v WHERE v.conv_id = d.conv_id AND v.turn <= d.page) AS section_heading, CAST(NULL AS VARCHAR) AS subheading FROM d"""

_STATES = """WITH RECURSIVE e AS (SELECT user_id, ['accept', 'start', 'parsed', 'indexed', 'error', 'delete', 'erased', 'interrupted'][event_id % 8 + 1] AS ev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s(user_id, n, st) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 'none' FROM e UNION ALL
        SELECT e.user_id, e.n, CASE WHEN ev = 'delete' AND st <> 'deleted' THEN 'deleting' WHEN ev = 'accept' AND st IN ('none', 'failed', 'deleted') THEN 'queued' WHEN st = 'queued' AND ev = 'start' THEN 'processing'
            WHEN st = 'processing' AND ev = 'parsed' THEN 'indexing' WHEN st = 'indexing' AND ev = 'indexed' THEN 'ready' WHEN st = 'processing' AND ev = 'error' THEN 'failed'
            WHEN st IN ('queued', 'processing') AND ev = 'interrupted' THEN 'failed' WHEN st = 'deleting' AND ev = 'erased' THEN 'deleted' ELSE st END
        FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS doc_id, arg_max(st, n) AS status, arg_max(st, n) NOT IN ('indexing', 'cleanup_required', 'deleting') AS readable FROM s GROUP BY user_id"""

_LIMITER = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s(event_id, user_id, n, start_at, c) AS (SELECT event_id, user_id, n, tm, 1 FROM e WHERE n = 1 UNION ALL
        SELECT e.event_id, e.user_id, e.n, CASE WHEN e.tm >= s.start_at + 86400 THEN e.tm ELSE s.start_at END, CASE WHEN e.tm >= s.start_at + 86400 THEN 1 ELSE s.c + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT event_id, c <= 3 AS allowed FROM s"""

ORACLES: dict[str, str] = {
    "chunk_recursive": _RECURSIVE,
    "chunk_structure": _STRUCTURE,
    "chunk_tables": _TABLES,
    "attached_headings": _ATTACHED,
    "html_text": f"WITH {_HTML} SELECT doc_id, length(text) AS char_count, array_to_string(headings, ' / ') AS headings, {_quality('text')} AS text_quality FROM hp",
    "detected_headings": _DETECTED,
    "document_states": _STATES,
    "login_limiter": _LIMITER,
    "bm25_topk": f"WITH {_bm25(5)} {_HIT} bm",
    "bm25_filtered_lang": f"WITH {_bm25(5, where="lang = 'de'")} {_HIT} bm",
    "bm25_min_score": f"WITH {_bm25(20, least='score >= 25.0')} {_HIT} bm",
    "dense_topk": _dense(),
    "dense_filtered": _dense("b.label = 3"),
    "dense_min_score": _dense("TRUE", 50, "score >= 0.3"),
    "hash_embed": f"SELECT doc_id, CAST(unnest(range(32)) AS INTEGER) AS pos, round(unnest({_HASHED}), 9) AS value FROM documents",
    "dense_hash_topk": f"WITH {_dense_hash(5)} {_HIT} de",
    "hybrid_rrf": f"WITH {_hybrid(5, 60)} {_HIT} hy",
    "hybrid_rrf_k10": f"WITH {_hybrid(10, 10)} {_HIT} hy",
    "rerank_fake": f"""WITH {_bm25(20)}, rr AS (SELECT bm.query_id, bm.chunk_id, 1000.0::DOUBLE / (length(b.text) + length(d.text) + 1) AS score, bm.rank AS first FROM bm JOIN benchmark b ON bm.query_id = CAST(b.item_id AS VARCHAR) JOIN documents d ON bm.chunk_id = CAST(d.doc_id AS VARCHAR)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, chunk_id) AS INTEGER) AS rank FROM rr) {_HIT} r WHERE rank <= 5""",
    "hit_records": f"""WITH {_bm25(5)} SELECT query_id, rank, bm.chunk_id, source AS doc_id, source || '.pdf' AS source_file, 1 AS page_start, 1 AS page_end, lang AS section_heading, 'text' AS chunk_type, round(score, 6) AS score, 'bm25' AS retriever,
        '[' || source || '.pdf, p. 1, ' || lang || ']' AS citation, substr(translate(text, chr(10), ' '), 1, 120) AS snippet FROM bm JOIN documents d ON bm.chunk_id = CAST(d.doc_id AS VARCHAR)""",
    "eval_at_k": f"WITH {_bm25(10)}, {_GOLD}, {_GRID}, {_at_k('bm')} SELECT query_id, CAST(k AS INTEGER) AS k, round(precision, 6) AS precision, round(recall, 6) AS recall FROM atk",
    "eval_mrr": f"WITH {_bm25(10)}, {_GOLD}, {_GRID}, {_at_k('bm')} SELECT query_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM mrr",
    "eval_by_strategy": " UNION ALL ".join((_strategy("bm25", _bm25(10), "bm"), _strategy("dense", _dense_hash(10), "de"), _strategy("hybrid", _hybrid(10, 60), "hy"))),
    "gold_version": "SELECT item_id, substr(sha256(text), 1, 12) AS version FROM benchmark",
    "text_quality": f"WITH x AS (SELECT doc_id, {_DAMAGED} AS text FROM documents) SELECT doc_id, {_quality('text')} AS quality FROM x",
    "clean_text": r"""WITH x AS (SELECT doc_id, '  ' || replace(text, 'th', 't-' || chr(10) || 'h') || chr(173) || ' ' || chr(10) AS text FROM documents)
        SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '[\p{Co}\p{Cf}]', '', 'g'), '\s+', ' ', 'g'))) AS clean_sha256 FROM x""",
    "frequency_key": f"SELECT page_id, {_key("'  Page ' || url")} AS key FROM pages",
    "repeated_edges": f"WITH {_EDGES} SELECT doc_id, key, n FROM re",
    "edge_removed": rf"""WITH {_EDGES}, x AS (SELECT bl.doc_id, edge AND (re.key IS NOT NULL OR regexp_matches(replace({_key("text")}, '#', '1'), '(?i)^(?:page\s*)?\d+(?:\s*(?:of|/)\s*\d+)?$')) AS gone FROM bl LEFT JOIN re ON bl.doc_id = re.doc_id AND {_key("bl.text")} = re.key)
        SELECT doc_id, count(*) FILTER (gone) AS removed, count(*) FILTER (NOT gone) AS kept FROM x GROUP BY 1""",
    "page_assembly": rf"""WITH x AS (SELECT source AS doc_id, CAST(doc_id AS INTEGER) AS page_number, trim(regexp_replace(regexp_replace(text, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\s+', ' ', 'g')) AS text FROM documents)
        SELECT doc_id, page_number, length(text) AS char_count, 1.0 AS text_quality, sha256(text) AS text_sha256 FROM x WHERE text <> ''""",
    "reading_order": """WITH b AS (SELECT p_brand AS doc_id, p_size AS page_number, p_partkey * 37 % 400 AS x0, p_partkey * 91 % 700 AS y0, p_partkey * 37 % 400 + p_partkey % 180 + 20 AS x1, CAST(p_partkey AS VARCHAR) AS text FROM part),
        s AS (SELECT *, x1 <= 306 AS l, x0 >= 306 AND NOT x1 <= 306 AS r, bool_or(x1 <= 306) OVER w AND bool_or(x0 >= 306) OVER w AND count(*) OVER w > 1 AS two FROM b WINDOW w AS (PARTITION BY doc_id, page_number)),
        t AS (SELECT *, min(CASE WHEN l OR r THEN y0 END) OVER (PARTITION BY doc_id, page_number) AS top FROM s),
        z AS (SELECT *, CASE WHEN NOT two THEN 0 WHEN l THEN 1 WHEN r THEN 2 WHEN y0 + 20 <= top THEN 0 ELSE 3 END AS zone FROM t)
        SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY zone, y0, CASE WHEN two THEN 0 ELSE x0 END, x0, text) AS INTEGER) AS position, text FROM z""",
    "usable_tables": f"""WITH {_GRID_ROWS}, x AS (SELECT doc_id, list_max(list_transform(grid, lambda r: len(r))) AS wide, list_max(list_transform(grid, lambda r: len(r))) >= 2 AS usable FROM g) SELECT doc_id, usable FROM x""",
    "markdown_tables": f"""WITH {_GRID_ROWS}, l AS (SELECT doc_id, {_LINES} AS lines, list_max(list_transform(grid, lambda r: len(r))) AS wide FROM g)
        SELECT doc_id, sha256(array_to_string(list_concat(lines[1:1], ['| ' || array_to_string(list_transform(range(CAST(wide AS BIGINT)), lambda z: '---'), ' | ') || ' |'], lines[2:]), chr(10))) AS markdown_sha256 FROM l""",
    "page_quality": f"""WITH x AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, text || CASE WHEN length(text) % 3 = 0 THEN repeat(chr(65533), 40) ELSE '' END AS text FROM conversations), y AS (SELECT doc_id, {_quality('text')} AS q FROM x)
        SELECT doc_id, count(*) AS pages, count(*) FILTER (q < 0.9) AS low_quality FROM y GROUP BY 1""",
    "query_lines": f"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM documents), y AS (SELECT doc_id, {_strip('v')} AS line FROM x)
        SELECT doc_id, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM y WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY 1""",
    "doc_identity": "SELECT doc_id, 'doc_' || lower(sha256(text)) AS identity FROM documents",
    "source_names": r"""WITH x AS (SELECT doc_id, regexp_extract(translate('C:\raw/' || lang || '\' || source || '_' || doc_id || '.pdf', '\', '/'), '([^/]*)/*$', 1) AS name FROM documents)
        SELECT doc_id, name, array_to_string(list_transform(string_split(translate(regexp_replace(name, '\.pdf$', ''), '_-', '  '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title, TRUE AS safe FROM x""",
    "upload_gate": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'type' WHEN doc_id % 5 = 0 THEN 'name' WHEN strlen(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '' END || text) > 20000 OR strlen(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '' END || text) = 0 THEN 'size'
        WHEN doc_id % 3 <> 0 THEN 'signature' ELSE 'accepted' END AS verdict FROM documents""",
    "sentence_split": f"WITH x AS (SELECT doc_id, {_SENTENCES} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS n, sha256(array_to_string(s, '|')) AS sentences_sha256 FROM x",
    "recursive_split": rf"""WITH x AS (SELECT doc_id, {_PARAS} AS p, {_SENTENCES.replace("(text,", "(replace(text, chr(10), chr(10) || chr(10)),")} AS s, {_WORDS} AS w FROM documents),
        y AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p WHEN len(s) > 1 THEN s ELSE list_transform(range(0, len(w), 25), lambda k: array_to_string(w[k + 1:k + 25], ' ')) END AS parts FROM x)
        SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, sha256(array_to_string(parts, '|')) AS parts_sha256 FROM y""",
    "token_counts": "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents",
    "chunk_fixed": _FIXED,
    "chunk_ids": f"SELECT conv_id, turn, {_CID} AS chunk_id, {_uuid5(f'({_CID})')} AS point_id FROM conversations",
    "chunk_quality": f"""WITH x AS (SELECT conv_id, turn, {_DAMAGED} AS text FROM conversations), p AS (SELECT conv_id, turn, {_quality('text')} AS q FROM x)
        SELECT a.conv_id || '-' || a.turn AS chunk_id, round(avg(b.q), 6) AS text_quality FROM p a JOIN p b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + 1 GROUP BY 1""",
    "mid_sentence": f"""WITH t AS (SELECT role, text || CASE WHEN length(text) % 3 = 0 THEN '" )' ELSE '' END AS x FROM conversations), y AS (SELECT role, {_MID} AS m FROM t) SELECT role, count(*) AS n, count(*) FILTER (m) AS n_mid FROM y GROUP BY 1""",
    "heading_flags": rf"""WITH {_HEADS.replace("\\\\", "\\")} SELECT doc_id, CAST(n AS INTEGER) AS n, label, company, item, marker, item OR marker AS section, s <> '' AND length(s) <= CASE WHEN item THEN 160 ELSE 60 END AND NOT label AND NOT company AS valid,
        s <> '' AND NOT item AND length(s) <= 60 AND NOT label AND NOT company AND NOT regexp_matches(s, '^\d{{4}}\s*(?:[-–]\s*\d{{4}})?\s*$|^\d{{4}}\s+and\s+\d{{4}}$|Years ended |As of |\(.*\)') AND NOT regexp_matches(s, '^[\d,\s().]+$') AND NOT ends_with(s, ':') AND NOT regexp_matches(s, '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Zl}}\p{{Zp}}]') AND regexp_matches(s, '[A-Za-z]{{2,}}') AS sub,
        s <> '' AND length(s) < 150 AND (regexp_matches(s, '^[A-Z][A-Z\s\d.\-,:]+$') OR regexp_matches(s, '^[\d.]+\s+[A-Z]') OR regexp_matches(s, '^[A-Z][A-Z\s\d.\-]{{2,}}$') OR regexp_matches(s, '(?i)^Item\s+\d+[A-Z]?\.\s*\S?')) AS line FROM f""",
    "heading_offsets": r"""WITH x AS (SELECT doc_id, text, substr(text, 21, 25) || CASE WHEN doc_id % 4 = 0 THEN chr(127) ELSE '' END AS h FROM documents)
        SELECT doc_id, CAST(CASE WHEN h = '' THEN 0 WHEN strpos(text, h) > 0 THEN strpos(text, h) - 1 WHEN strpos(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(h, '\s+', ' ', 'g'))) > 0 THEN strpos(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(h, '\s+', ' ', 'g'))) - 1 ELSE length(text) END AS INTEGER) AS off FROM x""",
    "heading_carry_forward": """SELECT a.conv_id || '-' || a.turn AS chunk_id, (SELECT arg_max(h.text, (h.turn, length(h.text))) FROM conversations h WHERE h.role = 'user' AND h.conv_id = a.conv_id AND (h.turn < a.turn OR (h.turn = a.turn AND length(h.text) <= 0))) AS heading FROM conversations a""",
    "contained_heading": """SELECT a.conv_id || '-' || a.turn AS chunk_id, arg_max(h.text, (length(h.text), h.text)) AS heading FROM conversations a JOIN conversations h ON a.conv_id = h.conv_id AND a.turn = h.turn AND h.role = 'user' AND length(h.text) BETWEEN 0 AND 120 GROUP BY 1""",
    "token_stats": """WITH x AS (SELECT lang, list_sort(list(CAST(greatest(1, length(text) // 4) AS INTEGER))) AS v FROM documents GROUP BY 1)
        SELECT lang, len(v) AS n, len(list_filter(v, lambda t: t > 512)) AS n_over, round(100 * len(list_filter(v, lambda t: t > 512)) / len(v), 6) AS percent_over, v[len(v) // 2 + 1] AS median, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99, list_min(v) AS least, list_max(v) AS most FROM x""",
    "chunk_summary": f"""WITH x AS (SELECT source AS doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS n_tok, doc_id % 9 <> 0 AS is_text, text AS x FROM documents), y AS (SELECT *, is_text AND {_MID} AS mid FROM x),
        z AS (SELECT doc_id, count(*) AS n, avg(n_tok) AS m, quantile_cont(n_tok, 0.5) AS med, list_sort(list(n_tok)) AS v, count(*) FILTER (is_text) AS nt, count(*) FILTER (mid) AS nm FROM y GROUP BY GROUPING SETS ((doc_id), ()))
        SELECT 'document' AS strategy, doc_id, n, round(m, 6) AS mean_tokens, CAST(med AS DOUBLE) AS median_tokens, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95_tokens, round(CASE WHEN nt > 0 THEN nm / nt ELSE 0 END, 6) AS mid_share, n - nt AS n_tables FROM z""",
    "model_tokens": rf"""WITH x AS (SELECT lang, source AS doc_id, CAST(len(regexp_extract_all(lower(text), '{WORD}')) AS INTEGER) AS m, CAST(greatest(1, length(text) // 4) AS INTEGER) AS t FROM documents),
        y AS (SELECT lang, doc_id, count(*) AS n, count(*) FILTER (m > 400) AS n_over, quantile_cont(m, 0.5) AS mm, list_sort(list(m)) AS v, quantile_cont(t, 0.5) AS mt, quantile_cont(m / t, 0.5) AS mr FROM x GROUP BY 1, 2)
        SELECT lang, doc_id, n, n_over, round(100 * n_over / n, 6) AS percent_over, CAST(mm AS DOUBLE) AS median_model_tokens, v[CAST(floor(n * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(n * 0.99) AS BIGINT) + 1] AS p99, v[len(v)] AS most, CAST(mt AS DOUBLE) AS median_tokens, round(mr, 6) AS median_ratio FROM y""",
    "index_run_totals": f"WITH {_SIDES} SELECT count(DISTINCT doc_id) AS documents, count(*) FILTER (action = 'upsert') AS upserted, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action IN ('patch', 'keep')) AS skipped, count(*) FILTER (action = 'patch') AS payload_updated FROM ac",
    "heading_coverage": """SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) FILTER (length(text) % 4 <> 0) AS with_heading, count(*) FILTER (length(text) % 4 = 0) AS without_heading FROM conversations GROUP BY 1""",
    "top_headings": """WITH x AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, role AS heading, count(*) AS n, CAST(min(turn) AS INTEGER) AS first_page, CAST(max(turn) AS INTEGER) AS last_page FROM conversations WHERE length(text) % 4 <> 0 GROUP BY 1, 2),
        y AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_page, heading) AS INTEGER) AS place FROM x) SELECT * FROM y WHERE place <= 10""",
    "example_chunks": """WITH x AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, CASE WHEN turn % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type, conv_id || '-' || turn AS chunk_id, turn, greatest(1, length(text) // 4) AS tok FROM conversations)
        SELECT doc_id, chunk_type, arg_min(chunk_id, (CASE WHEN chunk_type = 'text' AND tok < 30 THEN 1 ELSE 0 END, turn)) AS chunk_id FROM x GROUP BY 1, 2""",
    "ingestion_totals": f"""WITH d AS (SELECT conv_id, text AS t0, {_DAMAGED} AS text FROM conversations), q AS (SELECT conv_id, t0, {_quality('text')} AS ql, CASE WHEN conv_id % 3 = 0 THEN 'skipped' WHEN conv_id % 7 = 0 THEN 'failed' ELSE 'processed' END AS status FROM d)
        SELECT count(DISTINCT conv_id) FILTER (status = 'processed') AS processed, count(DISTINCT conv_id) FILTER (status = 'skipped') AS skipped, count(DISTINCT conv_id) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'processed') AS pages,
        count(*) FILTER (status = 'processed' AND length(t0) % 5 = 0) AS tables, count(*) FILTER (status = 'processed' AND length(t0) % 2 = 0) AS warnings, count(*) FILTER (status = 'processed' AND ql < 0.9) AS low_quality FROM q""",
    "sync_actions": f"WITH {_SIDES} SELECT id, doc_id, action FROM ac",
    "sync_counts": f"WITH {_SIDES} SELECT count(*) FILTER (action = 'upsert') AS upserted, count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action IN ('patch', 'keep')) AS skipped, count(*) FILTER (action = 'patch') AS payload_updated FROM ac",
    "synced_index": f"WITH {_SIDES} SELECT tg.id, tg.doc_id, tg.source_file, round(CAST(CAST(('0x' || substr(sha256(CASE WHEN action = 'upsert' THEN tg.id ELSE 'old' END), 1, 2)) AS INTEGER) / 255.0::DOUBLE AS FLOAT)::DOUBLE, 4) AS v1 FROM tg JOIN ac USING (id)",
    "inventory": f"""WITH {_SIDES}, m AS (SELECT source AS doc_id, source || '.pdf' AS filename, CASE WHEN count(*) % 5 = 0 THEN 'deleted' ELSE 'ready' END AS status, count(*) AS chunk_count FROM documents GROUP BY 1)
        SELECT * FROM m WHERE status <> 'deleted' UNION ALL SELECT doc_id, min(source_file), 'external', count(*) FROM so WHERE doc_id NOT IN (SELECT doc_id FROM m) GROUP BY 1""",
    "ingest_skip": """WITH s AS (SELECT DISTINCT sha256(d.text) AS h FROM documents d JOIN labels USING (doc_id)) SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS file_hash, CASE WHEN sha256(text) IN (SELECT h FROM s) THEN 'skipped' ELSE 'pending' END AS status FROM documents""",
    "index_scan": f"WITH {_SIDES} SELECT doc_id, count(*) AS points, count(*) FILTER (source_file <> '') AS named FROM so GROUP BY 1",
    "evidence_valid": rf"""WITH {_HITS} SELECT query_id, chunk_id, CASE WHEN {_strip('chunk_id')} = '' OR {_strip('doc_id')} = '' OR {_strip('source_file')} = '' OR {_strip('text')} = '' THEN 'blank field' WHEN regexp_matches(source_file, '[/\\\r\n\[\]]') THEN 'file name'
        WHEN page_start < 1 OR page_end < page_start THEN 'page range' WHEN regexp_matches(section_heading, '[\r\n\[\]]') THEN 'heading' END AS problem FROM hi""",
    "evidence_labels": f"WITH {_HITS} SELECT query_id, chunk_id, evidence_id FROM ev",
    "evidence_budget": f"""WITH {_HITS}, x AS (SELECT query_id, count(*) AS n, CAST(sum({_json_length('evidence_id')} + {_json_length('doc_id')} + {_json_length('source_file')} + length(CAST(page_start AS VARCHAR)) + length(CAST(page_end AS VARCHAR)) + {_json_length('text')} + 86) + 2 * (count(*) - 1) + 2 AS BIGINT) AS chars FROM ev GROUP BY 1)
        SELECT query_id, n, chars, n <= 12 AND chars <= 24000 AS within FROM x""",
    "quote_validation": f"""WITH {_REPLIES} SELECT query_id, CASE WHEN kind = 3 THEN 'insufficient_evidence' ELSE 'answered' END AS status, CASE kind WHEN 3 THEN TRUE WHEN 2 THEN FALSE WHEN 1 THEN contains(text, quote || '#') ELSE TRUE END AND (kind = 3 OR {_strip('quote')} <> '') AS valid FROM rp""",
    "answers": f"""WITH {_REPLIES}, c AS (SELECT *, '"' || quote || CASE WHEN kind = 1 THEN '#' ELSE '' END || '" [' || source_file || ', ' || CASE WHEN page_end > page_start THEN 'pp. ' || page_start || '-' || page_end ELSE 'p. ' || page_start END || ', ' || section_heading || ']' AS line FROM rp)
        SELECT query_id, CASE WHEN kind = 3 THEN 'insufficient_evidence' ELSE 'answered' END AS status, CASE WHEN kind = 3 THEN 'I don''t have enough evidence in the retrieved documents to answer this question.' ELSE 'The retrieved documents state:' || chr(10) || chr(10) || line || CASE WHEN kind = 2 THEN chr(10) || chr(10) || line ELSE '' END END AS answer FROM c""",
    "reply_parse": f"""WITH {_REPLIES}, c AS (SELECT *, CAST(query_id AS BIGINT) % 3 = 0 AS valid FROM rp) SELECT query_id, CASE WHEN valid THEN CASE WHEN kind = 3 THEN 'insufficient_evidence' ELSE 'answered' END END AS status, valid FROM c""",
    "latest_sessions": "WITH x AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM events) SELECT * FROM x WHERE place <= 16",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
