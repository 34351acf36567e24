"""DuckDB SQL for the registered queries, on the same tables."""

from __future__ import annotations

# The system message, stated here anew.
SYSTEM_PROMPT = (
    "Bạn là một chuyên gia trợ lý pháp luật chuyên nghiệp, am hiểu sâu sắc về hệ thống pháp luật Việt Nam. \n"
    "Nhiệm vụ của bạn là cung cấp câu trả lời chính xác, khách quan và có căn cứ pháp lý.\n\n"
    "Quy tắc suy nghĩ và sử dụng công cụ:\n"
    "1. Khi nhận được câu hỏi, hãy kiểm tra phần \"Ngữ cảnh\" được cung cấp từ kết quả tìm kiếm tự động (RAG).\n"
    "2. Nếu \"Ngữ cảnh\" đã đầy đủ để trả lời, hãy trả lời ngay.\n"
    "3. Nếu câu hỏi đề cập đích danh một Điều, Khoản, Điểm cụ thể nhưng \"Ngữ cảnh\" chưa có hoặc chưa đầy đủ, "
    "hãy sử dụng công cụ `extract_clause_point` để lấy nội dung chính xác.\n"
    "4. Nếu cần tìm các quy định liên quan (như mức phạt, hình phạt bổ sung) được dẫn chiếu từ Điều này, hãy dùng "
    "`extract_relevant_clause_point` hoặc `extract_clause_point_references`.\n"
    "5. Luôn ưu tiên sự chính xác. Nếu phải dùng công cụ, hãy gọi công cụ trước khi đưa ra câu trả lời cuối cùng.\n\n"
    "Quy tắc trình bày:\n"
    "1. Câu trả lời phải mang tính trang trọng, ngôn ngữ pháp lý chuẩn xác, cấu trúc rõ ràng.\n"
    "2. Trích dẫn cụ thể: Điều, Khoản, Điểm, số hiệu văn bản pháp luật.\n"
    "3. Nếu sau khi dùng công cụ vẫn không có thông tin, hãy báo rõ là tài liệu hiện tại không đề cập, "
    "không tự bịa đặt."
)

# Whitespace as in functions.text, for RE2.
_WS = r"\s\x1c-\x1f\x85\p{Z}"
_NL = "chr(10)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return _words(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_{_WS}]', '', 'g')")


def _bm25(docs: str, id_col: str, prefix: str = "") -> str:
    """CTEs of a corpus: tokens, lengths, term counts, statistics, idf, weights."""
    p = prefix
    return f"""
{p}tok AS (SELECT {id_col} AS id, {_tokens('text')} AS t FROM {docs}),
{p}len AS (SELECT id, len(t) AS dl FROM {p}tok),
{p}tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM {p}tok) GROUP BY ALL),
{p}stats AS (SELECT count(*) AS n, sum(dl)::BIGINT AS total, sum(dl) / count(*)::DOUBLE AS avgdl FROM {p}len),
{p}idf AS (SELECT term, count(*) AS df,
  ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf
  FROM {p}tf, {p}stats GROUP BY term),
{p}w AS (SELECT id, term,
  idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / avgdl)))) AS w
  FROM {p}tf JOIN {p}len USING (id) JOIN {p}idf USING (term), {p}stats)"""


def _query_weights(queries: str, id_col: str) -> str:
    """CTEs of queries weighted with the corpus statistics."""
    return f"""
qtok AS (SELECT {id_col} AS qid, {_tokens('text')} AS t FROM {queries}),
qlen AS (SELECT qid, len(t) AS dl FROM qtok),
qtf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(t) AS term FROM qtok) GROUP BY ALL),
qw AS (SELECT qid, term,
  idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / avgdl)))) AS w
  FROM qtf JOIN qlen USING (qid) JOIN idf USING (term), stats)"""


def _top(source: str, k: int, order: str = "score DESC, id") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank
  FROM {source}) WHERE rank <= {k}"""


_SPARSE = f"""{_bm25('documents', 'doc_id')},{_query_weights('benchmark', 'item_id')},
sp_all AS (SELECT qid, id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL)"""

_COSINE = "list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)))"
_METRICS = {
    "cosine": _COSINE,
    "dot": "list_inner_product(a, b)",
    "euclid": "list_distance(a, b)",
    "manhattan": "list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2])))",
}


def _dense_all(metric: str = "cosine") -> str:
    return f"""de_all AS (SELECT qid, id, round({_METRICS[metric]}, 6) AS score FROM
  (SELECT item_id AS qid, embedding::DOUBLE[] AS a FROM embeddings JOIN benchmark ON vec_id = item_id),
  (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings))"""


def _dense(metric: str, k: int, order: str = "score DESC, id", where: str = "true") -> str:
    return f"""WITH {_dense_all(metric)}, f AS (SELECT * FROM de_all WHERE {where})
SELECT qid AS item_id, id AS vec_id, score, rank FROM ({_top('f', k, order)})"""


def _hybrid(limit: int) -> str:
    return f"""{_SPARSE}, {_dense_all()},
sp AS ({_top('sp_all', 2 * limit)}), de AS ({_top('de_all', 2 * limit)}),
fu AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS total_score,
  max(ds) AS dense_score, max(ss) AS sparse_score
  FROM (SELECT qid, id, rank, score AS ds, NULL::DOUBLE AS ss FROM de
    UNION ALL SELECT qid, id, rank, NULL, score FROM sp) GROUP BY qid, id),
hy AS ({_top('fu', limit, 'total_score DESC, id')})"""


# Units of the documents, as the statutes are written from them.
_UNITS = rf"""units AS (SELECT doc_id, lang, source, u, i - 1 AS i FROM (
  SELECT doc_id, lang, source, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM (
    SELECT doc_id, lang, source, list_filter(list_transform(
      regexp_split_to_array(text, '[.\n]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS us
    FROM documents))),
lined AS (SELECT *, i // 36 AS chapter_pos, (i % 36) // 6 AS article_pos, i // 6 + 1 AS article_number,
  lead(u) OVER (PARTITION BY doc_id ORDER BY i) AS next_u FROM units),
art AS (SELECT doc_id, chapter_pos, chapter_pos + 1 AS chapter_number,
  'Phần ' || (chapter_pos + 1) AS chapter_title, article_pos, article_number,
  'Điều ' || article_number || '. ' || u AS article_title,
  'Mục ' || (i // 18 + 1) || '. Nhóm ' || (i // 18 + 1) AS category
  FROM lined WHERE i % 6 = 0),
cl AS (SELECT doc_id, article_number, CASE WHEN i % 6 = 1 THEN 0 ELSE 1 END AS clause_pos,
  CASE WHEN i % 6 = 1 THEN 1 ELSE 2 END AS clause_number, u AS content
  FROM lined WHERE i % 6 IN (1, 5)),
pt AS (SELECT doc_id, article_number, 1 AS clause_number, CASE WHEN i % 6 = 2 THEN 0 ELSE 1 END AS point_pos,
  CASE WHEN i % 6 = 2 THEN 'a' ELSE 'đ' END AS point,
  CASE WHEN i % 6 = 2 AND next_u IS NOT NULL THEN u || ' - ' || next_u ELSE u END AS content
  FROM lined WHERE i % 6 IN (2, 4)),
tot AS (SELECT d.doc_id, 'NGHỊ ĐỊNH ' || source AS document_title, 'Căn cứ ' || lang AS legal_basis,
  coalesce(n_chapters, 0) AS n_chapters, coalesce(n_articles, 0) AS n_articles
  FROM documents d LEFT JOIN (SELECT doc_id, count(DISTINCT chapter_pos) AS n_chapters,
    count(*) AS n_articles FROM art GROUP BY doc_id) USING (doc_id)),
slots AS (SELECT a.*, document_title, c.clause_pos, c.clause_number, c.content AS clause_content,
  p.point_pos, p.point, p.content AS point_content
  FROM art a JOIN tot USING (doc_id) JOIN cl c USING (doc_id, article_number)
  LEFT JOIN pt p USING (doc_id, article_number, clause_number)),
chunks AS (SELECT doc_id, 'clause' AS kind, chapter_pos, article_pos, clause_pos, -1 AS point_pos,
    article_title || chr(10) || clause_content AS text, document_title, chapter_number, chapter_title,
    article_number, article_title, category AS article_category, clause_number, '-1' AS point,
    false AS is_point FROM slots WHERE point IS NULL
  UNION ALL SELECT doc_id, 'point', chapter_pos, article_pos, clause_pos, point_pos,
    article_title || chr(10) || 'Khung hình phạt/Quy định: ' || clause_content || chr(10)
      || 'Chi tiết (' || point || '): ' || point_content, document_title, chapter_number, chapter_title,
    article_number, article_title, category, clause_number, point, true
    FROM slots WHERE point IS NOT NULL
  UNION ALL SELECT doc_id, 'legal_basis', n_chapters, -1, -1, -1,
    'Căn cứ pháp lý của văn bản:' || chr(10) || legal_basis, document_title, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL FROM tot)"""

# The same where a section's heading stands in a point and first clauses of even documents have no number.
_HARD = (
    _UNITS.replace("'Mục ' || (i // 18 + 1) || '. Nhóm ' || (i // 18 + 1) AS category",
                   "CASE WHEN i % 36 < 3 THEN '' ELSE 'Mục ' || ((i - 4) // 18 + 1) || '. Nhóm ' || ((i - 4) // 18 + 1) END AS category")
    .replace("CASE WHEN i % 6 = 1 THEN 1 ELSE 2 END AS clause_number, u AS content",
             "CASE WHEN i % 6 = 1 THEN doc_id % 2 ELSE 2 END AS clause_number, "
             "CASE WHEN i % 6 = 1 AND doc_id % 2 = 0 THEN 'Nội dung ' || u ELSE u END AS content")
    .replace("pt AS (SELECT doc_id, article_number, 1 AS clause_number", "pt AS (SELECT doc_id, article_number, doc_id % 2 AS clause_number")
)

_POS = "doc_id, chapter_pos, article_pos, clause_pos, point_pos"
_POS_BIG = ("doc_id, chapter_pos::BIGINT AS chapter_pos, article_pos::BIGINT AS article_pos, "
            "clause_pos::BIGINT AS clause_pos, point_pos::BIGINT AS point_pos")
_LINEAGE = ("document_title, chapter_number::BIGINT AS chapter_number, chapter_title, "
            "article_number::BIGINT AS article_number, article_title, article_category, "
            "clause_number::BIGINT AS clause_number, point, is_point")

# The code kept in tables, as chunks.
_CODE = """pts AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp,
  max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
code AS (SELECT r_regionkey::BIGINT AS doc_id, n_nationkey::BIGINT AS chapter_pos, c_custkey AS article_pos,
  o_orderkey AS clause_pos, coalesce(l_linenumber, -1)::BIGINT AS point_pos,
  'NGHỊ ĐỊNH ' || r_name AS document_title, c_custkey + 1 AS article_number,
  'Điều ' || (c_custkey + 1) || '. ' || c_name AS article_title, o_orderkey AS clause_number,
  CASE WHEN l_linenumber IS NULL THEN '-1' ELSE chr(96 + l_linenumber) END AS point,
  l_linenumber IS NOT NULL AS is_point,
  'Điều ' || (c_custkey + 1) || '. ' || c_name || chr(10) || CASE WHEN l_linenumber IS NULL
    THEN o_orderpriority
    ELSE 'Khung hình phạt/Quy định: ' || o_orderpriority || chr(10) || 'Chi tiết ('
      || chr(96 + l_linenumber) || '): part ' || part END AS text,
  CASE WHEN flag = 'R' THEN supp + 1 WHEN o_orderstatus = 'P' THEN n_nationkey + 1 END AS ref_article,
  CASE WHEN flag = 'R' THEN NULL WHEN o_orderstatus = 'P' THEN 'a' END AS ref_point
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN pts ON l_orderkey = o_orderkey)"""
_DOC_ORDER = "doc_id, chapter_pos, article_pos, clause_pos, point_pos"
_DIRECT_REQ = """req AS (SELECT o_orderkey AS req_id,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey + 1 ELSE 0 END AS article,
  CASE WHEN o_orderpriority IN ('2-HIGH', '4-NOT SPECIFIED') THEN o_orderkey END AS clause,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN 'a' WHEN '4-NOT SPECIFIED' THEN 'b' END AS point FROM orders)"""
_SUPPLIER_REQ = """req AS (SELECT s_suppkey AS req_id, s_suppkey + 1 AS article, NULL::BIGINT AS clause,
  CASE WHEN s_acctbal < 0 THEN 'a' END AS point FROM supplier)"""
_HIT = "rank, doc_id, article_number, clause_number, point, text"


def _lookup(on: str, cap: int, req: str = "req") -> str:
    return f"""SELECT * FROM (SELECT r.req_id, c.*, row_number() OVER
  (PARTITION BY r.req_id ORDER BY {', '.join('c.' + x for x in _DOC_ORDER.split(', '))}) AS rank
  FROM {req} r JOIN code c ON {on}) WHERE rank <= {cap}"""


_AT = ("r.article <> 0 AND c.article_number = r.article AND (r.clause IS NULL OR c.clause_number = r.clause) "
       "AND (r.point IS NULL OR c.point = r.point)")
_TO = "r.article <> 0 AND c.ref_article = r.article AND r.clause IS NULL AND (r.point IS NULL OR c.ref_point = r.point)"


def _outbound(req: str = "req", p: str = "") -> str:
    """CTEs of the outbound look-up; result in ``{p}outb``."""
    return f"""{p}src AS ({_lookup(_AT, 100, req)}),
{p}refs AS (SELECT req_id, ref_article, ref_point, min(rank) AS seen FROM {p}src
  WHERE ref_article IS NOT NULL GROUP BY ALL),
{p}want AS (SELECT DISTINCT ref_article, ref_point FROM {p}refs),
{p}tgt AS (SELECT * FROM (SELECT w.ref_article AS wa, w.ref_point AS wp, c.*, row_number() OVER
  (PARTITION BY w.ref_article, w.ref_point ORDER BY {', '.join('c.' + x for x in _DOC_ORDER.split(', '))}) AS trank
  FROM {p}want w JOIN code c ON c.article_number = w.ref_article
    AND (w.ref_point IS NULL OR c.point = w.ref_point)) WHERE trank <= 100),
{p}hit AS (SELECT req_id, seen, trank, t.* EXCLUDE (wa, wp, trank, ref_article, ref_point) FROM {p}refs r
  JOIN {p}tgt t ON t.wa = r.ref_article AND t.wp IS NOT DISTINCT FROM r.ref_point),
{p}one AS (SELECT * FROM (SELECT *, row_number() OVER
  (PARTITION BY req_id, {_DOC_ORDER} ORDER BY seen, trank) AS nth FROM {p}hit) WHERE nth = 1),
{p}outb AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY seen, trank) AS rank FROM {p}one)"""


def _record(f: str) -> str:
    return f"""'--- Kết quả ' || {f}.rank || ' (Điểm ' || {f}.point ||
  CASE WHEN {f}.clause_number <> 0 THEN ', Khoản ' || {f}.clause_number ELSE '' END ||
  ', Điều ' || {f}.article_number || ', (' || {f}.article_title || ')) ---' || chr(10) || {f}.text"""


# Statute chunks found for the benchmark texts.
_KEY = ("lpad(doc_id::VARCHAR, 12, '0') || '/' || lpad(chapter_pos::VARCHAR, 6, '0') || '/' || "
        "lpad(article_pos::VARCHAR, 6, '0') || '/' || lpad(clause_pos::VARCHAR, 6, '0') || '/' || "
        "lpad(point_pos::VARCHAR, 6, '0')")
_CITATION = """'--- Trích dẫn ' || rank || ' (' || CASE WHEN kind = 'legal_basis'
    THEN 'Căn cứ pháp lý của: ' || document_title
    ELSE 'Điểm ' || point || ', Khoản ' || clause_number || ', Điều ' || article_number || ' ('
      || article_title || '), Chương ' || chapter_number END || ') ---' || chr(10)"""
_FOUND = f"""{_UNITS}, keyed AS (SELECT *, {_KEY} AS key FROM chunks),{_bm25('keyed', 'key')},
{_query_weights('benchmark', 'item_id')},
sp_all AS (SELECT qid, id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL),
top AS ({_top('sp_all', 7)}),
cited AS (SELECT qid, rank, {_CITATION} || text AS block
  FROM top JOIN keyed ON id = key),
ctx AS (SELECT item_id AS query_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank), '') AS context
  FROM benchmark LEFT JOIN cited ON qid = item_id GROUP BY item_id)"""


def _prompt(context: str, query: str) -> str:
    return f"""'Dưới đây là các tài liệu liên quan đến câu hỏi của bạn. Hãy đọc kỹ và trả lời câu hỏi ở cuối.'
  || chr(10) || chr(10) || '### Ngữ cảnh:' || chr(10) || {context} || chr(10) || chr(10)
  || '### Câu hỏi:' || chr(10) || {query} || chr(10) || chr(10) || '### Trả lời:' || chr(10)"""


# Calls written in the derived responses.
_CALLS = """sup AS (SELECT s_suppkey AS resp_id, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
calls AS (
  SELECT resp_id, 1 AS call_id, 'extract_clause_point' AS name, true AS known, true AS callable,
    NULL::VARCHAR AS document, resp_id + 1 AS article, NULL::BIGINT AS clause, NULL::VARCHAR AS point
    FROM sup WHERE r = 0
  UNION ALL SELECT resp_id, 1, 'extract_relevant_clause_point', true, true, 'Nghị định này', resp_id + 1, NULL, NULL
    FROM sup WHERE r = 1
  UNION ALL SELECT resp_id, 1, 'extract_clause_point_references', true, true, NULL, resp_id + 1, NULL, 'a'
    FROM sup WHERE r = 2
  UNION ALL SELECT resp_id, 1, 'search_law', false, false, NULL, NULL, NULL, NULL FROM sup WHERE r = 3
  UNION ALL SELECT resp_id, 2, 'extract_clause_point', true, true, NULL, resp_id + 1, NULL, NULL FROM sup WHERE r = 3
  UNION ALL SELECT resp_id, i, 'extract_clause_point', true, false, NULL, NULL, NULL, NULL
    FROM sup, (VALUES (1), (2)) AS n(i) WHERE r = 4)"""


def _asked(name: str) -> str:
    return f"(SELECT resp_id * 10 + call_id AS req_id, article, clause, point FROM calls WHERE callable AND name = '{name}')"


_RESOLVED = f"""{_CODE}, {_CALLS},
reqo AS (SELECT * FROM {_asked('extract_clause_point_references')}), {_outbound('reqo', 'o_')},
found AS (
  SELECT req_id, rank, point, clause_number, article_number, article_title, text
    FROM ({_lookup(_AT, 50, _asked('extract_clause_point'))})
  UNION ALL SELECT req_id, rank, point, clause_number, article_number, article_title, text
    FROM ({_lookup(_TO, 50, _asked('extract_relevant_clause_point'))})
  UNION ALL SELECT req_id, rank, point, clause_number, article_number, article_title, text FROM o_outb)"""

_FOLLOW_UP = f"""{_RESOLVED},
fmt AS (SELECT c.resp_id, c.call_id, coalesce(string_agg({_record('f')}, chr(10) || chr(10) ORDER BY rank),
    'Không tìm thấy dữ liệu phù hợp.') AS body
  FROM calls c LEFT JOIN found f ON f.req_id = c.resp_id * 10 + c.call_id WHERE callable GROUP BY ALL),
fup AS (SELECT resp_id, 'Kết quả từ các công cụ:' || chr(10)
    || string_agg(body, chr(10) || chr(10) ORDER BY call_id) || chr(10) || chr(10)
    || 'Dựa trên thông tin bổ sung này, hãy trả lời câu hỏi của tôi một cách chi tiết và chính xác.' AS content
  FROM fmt GROUP BY resp_id)"""

# The responses as they are written.
_RESPONSES = """SELECT resp_id, CASE r
  WHEN 0 THEN 'Tra cứu. <tool_call>{''name'': ''extract_clause_point'', ''arguments'': {''article'': 1}}</tool_call>'
    || '<tool_call>{"name": "extract_clause_point", "arguments": {"article": ' || (resp_id + 1) || '}}}</tool_call>' || d
  WHEN 1 THEN '<tool_call>' || chr(10) || '{"name": "extract_relevant_clause_point", "arguments": {"document": '
    || '"Nghị định này", "article": ' || (resp_id + 1) || ', "clause": null}}' || chr(10) || '</tool_call>'
  WHEN 2 THEN '<tool_call>{"name": "extract_clause_point", "arguments": {"article": </tool_call><tool_call>'
    || '{"name": "extract_clause_point_references", "arguments": {"article": ' || (resp_id + 1)
    || ', "point": "a"}}</tool_call>'
  WHEN 3 THEN '<tool_call>{"name": "search_law", "arguments": {"q": "' || s_name || '"}}</tool_call>'
    || chr(10) || d || '<tool_call>{'
  ELSE '<tool_call>{"name": "extract_clause_point"}</tool_call> không cần<tool_call>{"name": "extract_clause_point", '
    || '"arguments": "{\\"article\\": ' || (resp_id + 1) || '}"}</tool_call>' END AS response
FROM (SELECT s_suppkey AS resp_id, s_name, n_regionkey AS r, '<tool_call>{"name": "extract_clause_point", '
  || '"arguments": {"article": ' || (s_suppkey + 1) || '}}</tool_call>' AS d
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

_SYSTEM = SYSTEM_PROMPT.replace("'", "''")
_VOWELS = "aeiou"


def _vowel(c: str) -> str:
    return f"(length(text) - length(replace(text, '{c}', '')))"


_VOWEL_NORM = "sqrt((" + " + ".join(f"{_vowel(c)} * {_vowel(c)}" for c in _VOWELS) + ")::DOUBLE)"


def _embedded(c: str) -> str:
    """The zero vector stays zero."""
    return (f"round(CASE WHEN {_VOWEL_NORM} = 0 THEN 0::FLOAT ELSE ({_vowel(c)} / {_VOWEL_NORM})::FLOAT END"
            f"::DOUBLE, 6) AS v_{c}")


# The statutes' passages in a collection: vowels as vectors, words as terms.
_CHUNK_ID = "sha256(concat_ws('/', doc_id, chapter_pos, article_pos, clause_pos, point_pos))"


def _vowel_vector() -> str:
    parts = ", ".join(f"({_vowel(c)} / {_VOWEL_NORM})::FLOAT::DOUBLE" for c in _VOWELS)
    return f"CASE WHEN {_VOWEL_NORM} = 0 THEN [0.0, 0, 0, 0, 0]::DOUBLE[] ELSE [{parts}] END"


def _stored(queries: str, qid: str, before: str = "") -> str:
    """CTEs of the search for ``queries`` in the collection."""
    return f"""{_UNITS}, keyed AS (SELECT *, {_CHUNK_ID} AS key FROM chunks),{_bm25('keyed', 'key')},{before}
{_query_weights(queries, qid)},
sp_all AS (SELECT qid, id, round(sum(qw.w * w.w), 6) AS score FROM qw JOIN w USING (term) GROUP BY ALL),
de_all AS (SELECT qid, id, round(CASE WHEN list_sum(a) = 0 OR list_sum(b) = 0 THEN 0 ELSE {_COSINE} END, 6) AS score FROM
  (SELECT {qid} AS qid, {_vowel_vector()} AS a FROM {queries}), (SELECT key AS id, {_vowel_vector()} AS b FROM keyed))"""


_STORED = _stored("benchmark", "item_id")


def _fused(limit: int) -> str:
    return f"""sp AS ({_top('sp_all', 2 * limit)}), de AS ({_top('de_all', 2 * limit)}),
fu AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS total_score,
  max(ds) AS dense_score, max(ss) AS sparse_score
  FROM (SELECT qid, id, rank, score AS ds, NULL::DOUBLE AS ss FROM de
    UNION ALL SELECT qid, id, rank, NULL, score FROM sp) GROUP BY qid, id),
hy AS ({_top('fu', limit, 'total_score DESC, id')})"""


_TOLD = """text, document_title, article_number::BIGINT AS article_number, clause_number::BIGINT AS clause_number, point"""

_LENS = f"""lens AS (SELECT 'chars' AS measure, length(text) AS len FROM documents
  UNION ALL SELECT 'words', len({_words('text')}) FROM documents)"""

ORACLES: dict[str, str] = {
    "token_stats": f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms
        FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)""",
    "bm25_corpus_stats": f"""WITH {_bm25('documents', 'doc_id')}
        SELECT n AS doc_count, total AS total_len, round(avgdl, 6) AS avgdl FROM stats""",
    "bm25_vocab": f"""WITH {_bm25('documents', 'doc_id')}
        SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, round(idf, 6) AS idf FROM idf""",
    "bm25_sparse_vectors": f"""WITH {_bm25('documents', 'doc_id')}
        SELECT id AS doc_id, term, round(w, 6) AS weight FROM w""",
    "bm25_pair_score": f"""WITH {_bm25('documents', 'doc_id')},{_query_weights('benchmark', 'item_id')},
        pairs AS (SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents)
        SELECT item_id, doc_id, round(coalesce(sum(qtf.tf * w.w), 0), 6) AS score
        FROM pairs LEFT JOIN qtf ON qtf.qid = item_id LEFT JOIN w ON w.id = doc_id AND w.term = qtf.term
        GROUP BY item_id, doc_id""",
    "sparse_topk": f"WITH {_SPARSE} SELECT qid AS item_id, id AS doc_id, score, rank FROM ({_top('sp_all', 14)})",
    "dense_topk": _dense("cosine", 14),
    "dense_threshold": _dense("cosine", 14, where="score >= 0.4"),
    "dense_dot": _dense("dot", 7),
    "dense_euclid": _dense("euclid", 7, "score, id"),
    "dense_manhattan": _dense("manhattan", 7, "score, id"),
    "vector_normalize": """SELECT vec_id, (i - 1)::BIGINT AS pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x
        FROM (SELECT vec_id, v, unnest(generate_series(1, len(v))) AS i FROM
          (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE * 3) AS v FROM embeddings))""",
    "embed_documents": "SELECT doc_id, " + ", ".join(_embedded(c) for c in _VOWELS) + " FROM documents",
    "hybrid_rrf": f"""WITH {_hybrid(7)}
        SELECT qid AS item_id, id AS doc_id, total_score, dense_score, sparse_score, rank FROM hy""",
    "hybrid_dense_fallback": f"""WITH {_dense_all()}, f AS (SELECT * FROM de_all WHERE score >= 0.4)
        SELECT qid AS item_id, id AS vec_id, score AS total_score, score AS dense_score,
          0.0::DOUBLE AS sparse_score, rank FROM ({_top('f', 7)})""",
    "rerank_bm25": f"""WITH {_hybrid(20)},
        sc AS (SELECT hy.qid, hy.id, hy.rank AS old, round(coalesce(sum(qtf.tf * w.w), 0), 6) AS score
          FROM hy JOIN documents ON doc_id = hy.id LEFT JOIN qtf ON qtf.qid = hy.qid
          LEFT JOIN w ON w.id = hy.id AND w.term = qtf.term GROUP BY ALL)
        SELECT qid AS item_id, id AS doc_id, score AS total_score, rank
        FROM ({_top('sc', 5, 'score DESC, old')})""",
    "chunk_lengths": f"""WITH {_UNITS} SELECT {_POS_BIG}, length(text) AS n_chars,
        len({_words('text')})::BIGINT AS n_words FROM chunks""",
    "length_summary": """SELECT count(*) AS n_chunks, round(avg(length(text)), 6) AS avg_chars,
        max(length(text)) AS max_chars, min(length(text)) AS min_chars,
        median(length(text))::DOUBLE AS median_chars FROM documents""",
    "length_histogram": f"""WITH {_LENS},
        rng AS (SELECT measure, min(len)::DOUBLE AS lo, (max(len) - min(len))::DOUBLE AS span FROM lens GROUP BY measure),
        b AS (SELECT measure, least(floor((len - lo) * 30 / span), 29)::BIGINT AS bin, count(*) AS n
          FROM lens JOIN rng USING (measure) GROUP BY ALL)
        SELECT measure, bin, round(lo + span * bin / 30, 6) AS lo, round(lo + span * (bin + 1) / 30, 6) AS hi,
          coalesce(n, 0) AS n
        FROM (SELECT rng.*, unnest(generate_series(0, 29)) AS bin FROM rng) LEFT JOIN b USING (measure, bin)""",
    "length_density": f"""WITH {_LENS},
        rng AS (SELECT measure, min(len) AS lo, max(len) AS hi, count(*) AS total,
          power(count(*), -0.2::DOUBLE) * stddev_samp(len) AS h FROM lens GROUP BY measure),
        g AS (SELECT rng.*, grid, lo + (hi - lo) * grid / 49.0::DOUBLE AS x
          FROM (SELECT rng.*, unnest(generate_series(0, 49)) AS grid FROM rng) AS rng)
        SELECT measure, grid, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * power((x - len) / h, 2)))
          / (any_value(total) * any_value(h) * sqrt(2 * pi())), 9) AS density
        FROM g JOIN lens USING (measure) GROUP BY measure, grid, x""",
    "preamble_lines": f"""SELECT doc_id, n AS preamble_lines, n AS body_lines, words AS body_words FROM
        (SELECT doc_id, len(list_filter(list_transform(string_split(text, {_NL}),
          lambda x: {_strip('x')}), lambda x: x <> ''))::BIGINT AS n,
          len({_words('text')})::BIGINT AS words FROM documents)""",
    "parse_documents": f"""WITH {_UNITS} SELECT doc_id, document_title, legal_basis, n_chapters, n_articles FROM tot""",
    "parse_articles": f"""WITH {_UNITS} SELECT doc_id, chapter_pos, article_pos, chapter_number, chapter_title,
        article_number, article_title, category FROM art""",
    "parse_clauses": f"""WITH {_UNITS} SELECT doc_id, article_number, clause_pos::BIGINT AS clause_pos,
        clause_number::BIGINT AS clause_number, content FROM cl""",
    "parse_points": f"""WITH {_UNITS} SELECT doc_id, article_number, clause_number::BIGINT AS clause_number,
        point_pos::BIGINT AS point_pos, point, content FROM pt""",
    "chunk_clauses": f"WITH {_UNITS} SELECT {_POS_BIG}, text, {_LINEAGE} FROM chunks WHERE kind = 'clause'",
    "chunk_points": f"WITH {_UNITS} SELECT {_POS_BIG}, text, {_LINEAGE} FROM chunks WHERE kind = 'point'",
    "chunk_legal_basis": f"""WITH {_UNITS} SELECT c.doc_id, chapter_pos::BIGINT AS chapter_pos,
        article_pos::BIGINT AS article_pos, clause_pos::BIGINT AS clause_pos, point_pos::BIGINT AS point_pos,
        text, c.document_title, 'legal_basis' AS type, n_chapters AS chapter_total, n_articles AS article_total
        FROM chunks c JOIN tot USING (doc_id) WHERE kind = 'legal_basis'""",
    "chunk_code": f"""WITH {_CODE} SELECT {_POS}, text, point, is_point, CASE WHEN ref_article IS NULL THEN ''
        ELSE 'Nghị định này|' || ref_article || coalesce('|' || ref_point, '') END AS refs FROM code""",
    "lookup_direct": f"WITH {_CODE}, {_DIRECT_REQ} SELECT req_id, {_HIT} FROM ({_lookup(_AT, 50)})",
    "lookup_inbound": f"WITH {_CODE}, {_SUPPLIER_REQ} SELECT req_id, {_HIT} FROM ({_lookup(_TO, 50)})",
    "lookup_outbound": f"WITH {_CODE}, {_SUPPLIER_REQ}, {_outbound()} SELECT req_id, {_HIT} FROM outb",
    "format_records": f"""WITH {_CODE}, {_DIRECT_REQ}, hits AS ({_lookup(_AT, 50)})
        SELECT req.req_id, coalesce(string_agg({_record('hits')}, chr(10) || chr(10) ORDER BY rank),
          'Không tìm thấy dữ liệu phù hợp.') AS formatted
        FROM req LEFT JOIN hits USING (req_id) GROUP BY req.req_id""",
    "format_context": f"WITH {_FOUND} SELECT query_id, context FROM ctx",
    "rag_prompt": f"""WITH {_FOUND} SELECT query_id, {_prompt('context', 'text')} AS prompt
        FROM ctx JOIN benchmark ON item_id = query_id""",
    "conversation_messages": f"""WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id),
        asked AS (SELECT conv_id, text FROM conversations JOIN l USING (conv_id) WHERE turn = last AND role = 'user'),
        {_stored('asked', 'conv_id')}, {_fused(7)},
        cited AS (SELECT qid, rank, {_CITATION} || text AS block FROM hy JOIN keyed ON id = key),
        ctx AS (SELECT conv_id, any_value(text) AS text, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY rank), '') AS context
          FROM asked LEFT JOIN (SELECT qid, rank, block FROM cited) ON qid = conv_id GROUP BY conv_id)
        SELECT conv_id, 0::BIGINT AS part, 0::BIGINT AS turn, 'system' AS role, '{_SYSTEM}' AS content FROM l
        UNION ALL SELECT conv_id, 1, turn, role, text FROM conversations JOIN l USING (conv_id) WHERE turn < last
        UNION ALL SELECT conv_id, 2, 0, 'user', {_prompt('context', 'text')} FROM ctx""",
    "tool_calls": f"""WITH {_CALLS} SELECT resp_id, call_id::BIGINT AS call_id, name, known, callable, document,
        article, clause, point FROM calls""",
    "tool_call_status": f"""WITH {_RESOLVED}, cnt AS (SELECT req_id, count(*) AS n FROM found GROUP BY req_id)
        SELECT resp_id, call_id::BIGINT AS call_id, name, CASE WHEN callable THEN 'success' ELSE 'error' END AS status,
          CASE WHEN callable THEN coalesce(n, 0) END AS results_count,
          CASE WHEN NOT known THEN 'Hàm không tồn tại' WHEN NOT callable THEN 'bad arguments' END AS error
        FROM calls LEFT JOIN cnt ON req_id = resp_id * 10 + call_id""",
    "tool_call_follow_up": f"""WITH {_FOLLOW_UP} SELECT resp_id, content FROM fup""",
    "tool_call_messages": f"""WITH {_FOLLOW_UP}
        SELECT resp_id, 3::BIGINT AS part, 0::BIGINT AS turn, 'assistant' AS role, response AS content
          FROM fup JOIN ({_RESPONSES}) USING (resp_id)
        UNION ALL SELECT resp_id, 4, 0, 'user', content FROM fup""",
    "answer_records": f"""WITH {_RESOLVED}, cnt AS (SELECT req_id, count(*) AS n FROM found GROUP BY req_id),
        js AS (SELECT resp_id, string_agg('{{"id":' || call_id || ',"name":"' || name || '","args":' || CASE
            WHEN name = 'search_law' THEN '{{"q":"' || s_name || '"}}' WHEN NOT callable AND call_id = 2
              THEN '"{{\\"article\\": ' || (resp_id + 1) || '}}"' WHEN NOT callable THEN '{{}}'
            WHEN name = 'extract_clause_point' THEN '{{"article":' || article || '}}'
            WHEN name = 'extract_relevant_clause_point'
              THEN '{{"article":' || article || ',"clause":null,"document":"Nghị định này"}}'
            ELSE '{{"article":' || article || ',"point":"a"}}' END || CASE
            WHEN callable THEN ',"status":"success","results_count":' || coalesce(n, 0)
            WHEN known THEN ',"status":"error","error":"bad arguments"'
            ELSE ',"status":"error","error":"Hàm không tồn tại"' END || '}}', ',' ORDER BY call_id) AS calls
          FROM calls JOIN supplier ON resp_id = s_suppkey LEFT JOIN cnt ON req_id = resp_id * 10 + call_id
          GROUP BY resp_id),
        {_STORED}, {_fused(7)},
        passage AS (SELECT qid, string_agg('{{"id":"' || id || '","total_score":' || total_score || ',"sparse_score":'
            || coalesce(sparse_score::VARCHAR, 'null') || ',"dense_score":' || coalesce(dense_score::VARCHAR, 'null')
            || ',"text":' || to_json(text) || ',"metadata":' || CASE WHEN kind = 'legal_basis'
            THEN '{{"article_total":' || n_articles || ',"chapter_total":' || n_chapters || ',"doc_id":' || keyed.doc_id
              || ',"document_title":' || to_json(keyed.document_title) || ',"references":[],"type":"legal_basis"}}'
            ELSE '{{"article_category":' || to_json(article_category) || ',"article_number":' || article_number
              || ',"article_title":' || to_json(article_title) || ',"chapter_number":' || chapter_number
              || ',"chapter_title":' || to_json(chapter_title) || ',"clause_number":' || clause_number || ',"doc_id":'
              || keyed.doc_id || ',"document_title":' || to_json(keyed.document_title) || ',"is_point":' || is_point
              || ',"point":' || to_json(point) || ',"references":[]}}' END || '}}', ',' ORDER BY rank) AS docs
          FROM hy JOIN keyed ON id = key JOIN tot ON tot.doc_id = keyed.doc_id GROUP BY qid)
        SELECT s_suppkey AS resp_id, '{{"docs":[' || coalesce(docs, '') || '],"answer":"'
          || s_name || '","thinking":[],"tool_calls":[' || coalesce(calls, '') || ']}}' AS record
        FROM supplier LEFT JOIN js ON resp_id = s_suppkey
        LEFT JOIN passage ON qid = s_suppkey % (SELECT count(*) FROM benchmark)""",
    "points_build": f"""WITH {_bm25('documents', 'doc_id')},
        ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM idf),
        v AS (SELECT id, count(*) AS n, min(term_id) AS lo, max(term_id) AS hi, sum(w) AS s
          FROM w JOIN ids USING (term) GROUP BY id)
        SELECT doc_id::VARCHAR AS chunk_id, 5::BIGINT AS dim, coalesce(n, 0) AS n_terms, lo AS first_id,
          hi AS last_id, round(coalesce(s, 0), 5) AS weight FROM documents LEFT JOIN v ON id = doc_id""",
    "points_upsert": """SELECT doc_id::VARCHAR AS chunk_id,
        CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v2 ' || text ELSE text END AS text FROM documents""",
    "collection_sparse_topk": f"WITH {_SPARSE} SELECT qid AS item_id, id AS doc_id, score, rank FROM ({_top('sp_all', 14)})",
    "segmented_tokens": f"""SELECT doc_id, len(t)::BIGINT AS n_tokens,
        len(list_filter(t, lambda w: w = 'of_the'))::BIGINT AS n_joined
        FROM (SELECT doc_id, {_tokens("replace(text, 'of the', 'of_the')")} AS t FROM documents)""",
    "model_round_trip": f"""WITH {_bm25('documents', 'doc_id')}
        SELECT term, df, round(idf, 6) AS idf FROM idf""",
    "chunk_ids": f"""WITH {_UNITS} SELECT {_POS_BIG}, sha256(concat_ws('/', doc_id, chapter_pos, article_pos,
        clause_pos, point_pos)) AS chunk_id FROM chunks""",
    "texts_round_trip": "SELECT item_id, text FROM benchmark",
    "documents_json_round_trip": """SELECT doc_id, doc_id % 7 <> 0 AS good, doc_id % 7 <> 0 AS same
        FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "documents_json_lines_round_trip": "SELECT doc_id, doc_id % 7 <> 0 AS good, doc_id % 7 <> 0 AS same FROM documents",
    "collection_scan": f"""WITH {_UNITS} SELECT {_POS_BIG}, text FROM chunks WHERE article_number = 1
        ORDER BY {_DOC_ORDER} LIMIT 100""",
    "stream_ingest": f"WITH {_UNITS} SELECT {_POS_BIG}, text FROM chunks",
    "dense_index_cosine": _dense("cosine", 14),
    "dense_index_euclid": _dense("euclid", 7, "score, id"),
    "block_max_topk": f"WITH {_SPARSE} SELECT qid AS item_id, id AS doc_id, score, rank FROM ({_top('sp_all', 14)})",
    "ingest_replacements": f"WITH {_UNITS} SELECT {_POS_BIG}, text, 5::BIGINT AS dim FROM chunks",
    "ingest_model": f"""WITH {_UNITS}, keyed AS (SELECT *, {_CHUNK_ID} AS key FROM chunks),{_bm25('keyed', 'key')}
        SELECT term, df, round(idf, 6) AS idf FROM idf""",
    "index_lookup_direct": f"WITH {_CODE}, {_DIRECT_REQ} SELECT req_id, {_HIT} FROM ({_lookup(_AT, 50)})",
    "index_lookup_inbound": f"WITH {_CODE}, {_SUPPLIER_REQ} SELECT req_id, {_HIT} FROM ({_lookup(_TO, 50)})",
    "index_lookup_outbound": f"WITH {_CODE}, {_SUPPLIER_REQ}, {_outbound()} SELECT req_id, {_HIT} FROM outb",
    "retrieve_hybrid": f"""WITH {_STORED}, {_fused(7)}
        SELECT qid AS item_id, rank, id, total_score, sparse_score, dense_score, {_TOLD} FROM hy JOIN keyed ON id = key""",
    "retrieve_dense": f"""WITH {_STORED}, f AS (SELECT * FROM de_all WHERE score >= 0.4)
        SELECT qid AS item_id, rank, id, score AS total_score, 0.0::DOUBLE AS sparse_score, score AS dense_score, {_TOLD}
        FROM ({_top('f', 7)}) JOIN keyed ON id = key""",
    "retrieve_reranked": f"""WITH {_STORED}, {_fused(20)},
        pair AS (SELECT hy.qid, hy.id, hy.rank AS place, len(list_intersect(
            list_filter(regexp_split_to_array(b.text, '[{_WS}]+'), lambda w: w <> ''),
            list_filter(regexp_split_to_array(k.text, '[{_WS}]+'), lambda w: w <> '')))::DOUBLE / (1 + length(k.text)) AS score
          FROM hy JOIN keyed k ON hy.id = key JOIN benchmark b ON item_id = hy.qid)
        SELECT qid AS item_id, rank, id, round(score, 6) AS total_score
        FROM ({_top('pair', 5, 'score DESC, place')})""",
    "parse_blocks_points": f"""WITH {_UNITS} SELECT doc_id, article_number, clause_number::BIGINT AS clause_number,
        point_pos::BIGINT AS point_pos, point, content FROM pt""",
    "parse_blocks_clauses": f"""WITH {_HARD} SELECT doc_id, article_number, clause_pos::BIGINT AS clause_pos,
        clause_number::BIGINT AS clause_number, content FROM cl""",
    "preamble_split": f"""WITH {_UNITS}, n AS (SELECT doc_id, count(*)::BIGINT AS n FROM units GROUP BY doc_id),
        head AS (SELECT doc_id, 'NGHỊ ĐỊNH ' || source || chr(10) || 'Căn cứ ' || lang || chr(10) AS preamble, coalesce(n, 0) AS n,
            'NGHỊ ĐỊNH ' || source AS first FROM documents LEFT JOIN n USING (doc_id))
        SELECT doc_id, preamble, CASE WHEN n = 0 THEN 2 ELSE n + 2 * ((n + 35) // 36) + (n + 17) // 18 END AS body_lines,
          CASE WHEN n = 0 THEN first ELSE 'Chương I' END AS body_head FROM head""",
    "chunk_hard": f"WITH {_HARD} SELECT {_POS_BIG}, text, {_LINEAGE} FROM chunks WHERE kind <> 'legal_basis'",
    "chunk_defaults": f"""WITH {_UNITS} SELECT {_POS_BIG},
        CASE WHEN doc_id % 2 = 1 THEN document_title ELSE 'Untitled Document' END AS document_title,
        CASE WHEN chapter_pos % 2 = 1 THEN 'No Title' ELSE chapter_title END AS chapter_title, article_title, text
        FROM chunks WHERE kind <> 'legal_basis'""",
    "collection_recreated": f"WITH {_UNITS} SELECT {_POS_BIG}, text FROM chunks WHERE doc_id % 2 = 1",
}
