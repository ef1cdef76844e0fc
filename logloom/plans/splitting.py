"""Queries that cut documents into chunks; their SQL walks the lines with a recursive table."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import chunks
from logloom.sources import gateway

docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet")


def typed(s, d):
    """Documents of three types in turn, with headings."""
    kinds = F.element_at(F.array(*map(F.lit, ("markdown", "code", "text"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return gateway.headed_documents(s, d).withColumn("file_type", kinds)


QUERIES = {
    "split_text": lambda s, d: chunks.split_text(docs(s, d)),
    "split_text_small": lambda s, d: chunks.split_text(gateway.lined_documents(s, d), size=40, overlap=15),
    "split_markdown": lambda s, d: chunks.split_markdown(gateway.headed_documents(s, d), size=60, overlap=20),
    "split_code": lambda s, d: chunks.split_code(gateway.lined_documents(s, d), gateway.code_symbols(s, d), size=50, overlap=10),
    "split_by_type": lambda s, d: chunks.split_by_type(typed(s, d), gateway.code_symbols(s, d)),
}

#: White space as a class of the SQL engine's expressions.
SPACE = r"[\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def cut(name: str, source: str, size: int, overlap: int) -> str:
    """Tables that cut `source`(id, text) as plain text into `name`(id, line, k, first, last, content)."""
    target, shared = 4 * size, 4 * overlap
    return f"""{name}_l AS (SELECT id, string_split(text, chr(10)) AS ls FROM {source} WHERE text <> ''),
{name}_n AS (SELECT id, ls, list_transform(ls, lambda x: length(x)) AS n FROM {name}_l),
{name}_p AS (SELECT id, ls, n, list_transform(range(len(n) + 1), lambda k: coalesce(list_sum(n[1:k]), 0) + k) AS p FROM {name}_n),
{name}_r(id, i, start, used, f, t, long) AS (SELECT id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM {name}_p
UNION ALL SELECT id, i + 1,
  CASE WHEN m > {target} THEN i + 1 WHEN full_ AND fits THEN keep WHEN full_ THEN i ELSE start END,
  CASE WHEN m > {target} THEN 0 WHEN full_ AND fits THEN p[i + 1] - p[keep + 1] + m + 1 WHEN full_ THEN m + 1 ELSE used + m + 1 END,
  CASE WHEN start < i AND (m > {target} OR full_) THEN start END, CASE WHEN start < i AND (m > {target} OR full_) THEN i - 1 END, m > {target}
FROM (SELECT *, p[i + 1] - p[keep + 1] + m <= {target} AS fits FROM (SELECT *, start < i AND used + m > {target} AS full_,
  least(i - 1, coalesce(list_min(list_filter(range(start, i), lambda k: p[i + 1] - p[k + 1] <= {shared})), i - 1)) AS keep
  FROM (SELECT r.id, i, start, used, p, n[i + 1] AS m FROM {name}_r r JOIN {name}_p USING (id) WHERE i < len(n))))),
{name}_e AS (SELECT id, i AS line, 0 AS k, f AS first, t AS last FROM {name}_r WHERE f IS NOT NULL
  UNION ALL SELECT id, i, 1, i - 1, i - 1 FROM {name}_r WHERE long
  UNION ALL SELECT id, i + 1, 0, start, i - 1 FROM {name}_r JOIN {name}_p USING (id) WHERE i = len(n) AND start < i),
{name} AS (SELECT id, line, 0 AS k, first, last, array_to_string(ls[first + 1:last + 1], chr(10)) AS content FROM {name}_e JOIN {name}_p USING (id) WHERE k = 0
  UNION ALL SELECT id, line, k, first, last, substr(ls[first + 1], CAST((k - 1) * {target} + 1 AS INT), {target}) FROM
  (SELECT id, line, first, last, ls, unnest(range(1, (length(ls[first + 1]) + {target - 1}) // {target} + 1)) AS k FROM {name}_e JOIN {name}_p USING (id) WHERE k = 1))"""


TOKENS = "CAST((length(content) + 3) // 4 AS BIGINT) AS token_count"
LINES = "CAST(first AS BIGINT) AS line_start, CAST(last AS BIGINT) AS line_end"
NUMBER = "row_number() OVER (PARTITION BY doc_id ORDER BY {}) - 1 AS chunk_index"

LINED = "SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text FROM documents"
HEADED = """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i: CASE WHEN i % 7 = 3 THEN ' ## ' ELSE '' END || line), chr(10)) AS text FROM documents"""


def markdown(size: int, overlap: int, docs: str) -> str:
    """Tables that end in `md`(doc_id, o1, o2, o3, first, last, content, heading)."""
    return f"""h AS ({docs}), hl AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM h WHERE text <> ''),
hs AS (SELECT *, list_filter(range(len(ls)), lambda i: regexp_matches(ls[i + 1], '^{SPACE}*#')) AS heads FROM hl),
hx AS (SELECT *, list_distinct(list_concat([0], heads)) AS froms FROM hs),
sec AS (SELECT doc_id, ls, heads, unnest(froms) AS a FROM hx),
sb AS (SELECT doc_id, a, coalesce(list_min(list_filter(heads, lambda x: x > a)), len(ls)) AS b, ls,
  CASE WHEN list_contains(heads, a) THEN regexp_replace(regexp_replace(ls[a + 1], '^{SPACE}*#+', ''), '^{SPACE}+|{SPACE}+$', '', 'g') END AS heading FROM sec),
st AS (SELECT doc_id, a, b, heading, array_to_string(ls[a + 1:b], chr(10)) AS body, len(heads) AS n_heads FROM sb JOIN (SELECT doc_id, heads FROM hs) USING (doc_id)),
big AS (SELECT doc_id * 1000000 + a AS id, body AS text FROM st WHERE n_heads = 0 OR length(body) > {8 * size} AND NOT regexp_full_match(body, '{SPACE}*')),
{cut("mc", "big", size, overlap)},
md AS (SELECT doc_id, a AS o1, CAST(0 AS BIGINT) AS o2, CAST(0 AS BIGINT) AS o3, a AS first, b - 1 AS last, body AS content, heading FROM st
  WHERE n_heads > 0 AND length(body) <= {8 * size} AND NOT regexp_full_match(body, '{SPACE}*')
UNION ALL SELECT doc_id, a, line, k, a + first, a + last, CASE WHEN heading IS NULL THEN '' ELSE '# ' || heading || chr(10) END || content, heading
  FROM mc JOIN st ON id = doc_id * 1000000 + a)"""


#: Symbols as the source derives them, and line by line what is under none of them.
SYMBOLS = """sn AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM ld WHERE text IS NOT NULL AND doc_id % 4 <> 3),
sk AS (SELECT doc_id, n, unnest(range(doc_id % 6)) AS k FROM sn),
sy AS (SELECT doc_id, n - 1 AS z, (k * 5 + doc_id) % (n + 2) AS s, (k * 5 + doc_id) % (n + 2) + (k * 7) % 9 AS e, 's' || k AS symbol_name,
  list_extract(['function', 'class', 'type_alias'], CAST(k % 3 + 1 AS INT)) AS symbol_kind, CASE WHEN k % 2 = 0 THEN 'sig ' || k END AS signature FROM sk)"""


def code(size: int, overlap: int, docs: str) -> str:
    """Tables that end in `cd`(doc_id, o0, o1, o2, o3, first, last, content, names)."""
    return f"""ld AS ({LINED}), {SYMBOLS}, cx AS ({docs}),
cl AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM cx WHERE text <> ''),
cs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e, symbol_name, symbol_kind, signature) AS place, doc_id * 1000000 + row_number() OVER (PARTITION BY doc_id ORDER BY s, e, symbol_name) AS id,
  least(s, len(ls) - 1) AS a, least(e, len(ls) - 1) AS b, array_to_string(ls[least(s, len(ls) - 1) + 1:least(e, len(ls) - 1) + 1], chr(10)) AS body FROM sy JOIN cl USING (doc_id)),
cb AS (SELECT id, body AS text FROM cs WHERE length(body) > {8 * size} UNION ALL SELECT doc_id * 1000000, text FROM cl WHERE doc_id NOT IN (SELECT doc_id FROM cs)),
{cut("cc", "cb", size, overlap)},
un AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM cl WHERE doc_id IN (SELECT doc_id FROM cs)),
fr AS (SELECT doc_id, ls, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM un WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.doc_id = un.doc_id AND un.i BETWEEN a AND b)),
gp AS (SELECT doc_id, min(i) AS a, max(i) AS b, array_to_string(any_value(ls)[min(i) + 1:max(i) + 1], chr(10)) AS body FROM fr GROUP BY doc_id, island),
cd AS (SELECT doc_id, a AS o0, place AS o1, CAST(0 AS BIGINT) AS o2, CAST(0 AS BIGINT) AS o3, a AS first, b AS last, body AS content, symbol_name, symbol_kind, signature FROM cs WHERE length(body) <= {8 * size}
UNION ALL SELECT doc_id, a + first, place, line, k, a + first, a + last, content, symbol_name, symbol_kind, signature FROM cc JOIN cs USING (id)
UNION ALL SELECT doc_id, first, CAST(0 AS BIGINT), line, k, first, last, content, NULL, NULL, NULL FROM cc JOIN cl ON id = doc_id * 1000000
UNION ALL SELECT doc_id, a, CAST(1 AS BIGINT) << 40, a, 0, a, b, body, NULL, NULL, NULL FROM gp WHERE NOT regexp_full_match(body, '{SPACE}*'))"""


def plain(docs: str, size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT doc_id AS id, text FROM ({docs})), {cut("c", "s", size, overlap)}
SELECT id AS doc_id, {NUMBER.format("line, k").replace("doc_id", "id")}, {LINES}, content, {TOKENS} FROM c"""


SQL = {
    "split_text": plain("FROM documents", 512, 64),
    "split_text_small": plain(LINED, 40, 15),
    "split_markdown": f"WITH RECURSIVE {markdown(60, 20, HEADED)} SELECT doc_id, {NUMBER.format('o1, o2, o3')}, {LINES}, content, {TOKENS}, heading FROM md",
    "split_code": f"WITH RECURSIVE {code(50, 10, LINED)} SELECT doc_id, {NUMBER.format('o0, o1, o2, o3')}, {LINES}, content, {TOKENS}, symbol_name, symbol_kind, signature FROM cd",
    "split_by_type": f"""WITH RECURSIVE {markdown(512, 64, f"FROM ({HEADED}) WHERE doc_id % 3 = 0")}, {code(512, 64, f"FROM ({HEADED}) WHERE doc_id % 3 = 1")},
tx AS (SELECT doc_id AS id, text FROM ({HEADED}) WHERE doc_id % 3 = 2), {cut("tc", "tx", 512, 64)}
SELECT doc_id, {NUMBER.format('o1, o2, o3')}, {LINES}, content, {TOKENS}, heading, CAST(NULL AS VARCHAR) AS symbol_name, CAST(NULL AS VARCHAR) AS symbol_kind, CAST(NULL AS VARCHAR) AS signature FROM md
UNION ALL SELECT doc_id, {NUMBER.format('o0, o1, o2, o3')}, {LINES}, content, {TOKENS}, NULL, symbol_name, symbol_kind, signature FROM cd
UNION ALL SELECT id, {NUMBER.format("line, k").replace("doc_id", "id")}, {LINES}, content, {TOKENS}, NULL, NULL, NULL, NULL FROM tc""",
}
