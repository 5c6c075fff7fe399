"""DuckDB statements for the registered queries that SQL can express, over whole tables."""

from agorametric.llm.chat import CONTROL, END, TURN

# Both replicas' records compared directly, without trees.
MERKLE = """
WITH sides AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         coalesce(CASE WHEN page_id % 101 = 7
                       THEN substr(html, 1, length(html) // 2) || '#' || substr(html, length(html) // 2 + 2)
                       ELSE html END, '') AS copied
  FROM pages
), written AS (
  SELECT page_id, url, 'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e
           || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || e
           || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || e || e || html || e || e AS record,
         'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || url || e
           || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || e
           || 'Content-Length: ' || CAST(strlen(copied) AS VARCHAR) || e || e || copied || e || e AS copy
  FROM (SELECT *, chr(13) || chr(10) AS e FROM sides) AS ended
), hashed AS (
  SELECT page_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS left_sha256, sha256(copy) AS copy_sha256,
         coalesce('pages-' || CAST(CAST(floor(page_id / 512.0) AS BIGINT) AS VARCHAR), 'none-' || substr(md5(url), 1, 3)) AS file
  FROM written
), placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, left_sha256
                                   ROWS UNBOUNDED PRECEDING) AS BIGINT) - length AS "offset"
  FROM hashed
)
SELECT file, "offset", length, CASE WHEN page_id % 103 = 9 THEN 'missing' ELSE 'changed' END AS kind, left_sha256,
       CASE WHEN page_id % 103 = 9 THEN '' ELSE copy_sha256 END AS right_sha256
FROM placed
WHERE page_id % 103 = 9 OR left_sha256 <> copy_sha256
"""


def _share(depth: str, above: str, level: str, weight: str, source: str, parent: str) -> str:
    """One level of the tree: children in order of supply for their weight, and the line up to which they are filled."""
    keys = f"{above}{level}"
    match = " AND ".join(f"p.{key.strip()} = n.{key.strip()}" for key in above.split(",") if key.strip()) or "TRUE"
    partition = f"PARTITION BY {above.rstrip(', ')}" if above else ""
    every = f"{partition} ORDER BY CAST(supply AS DOUBLE) / weight, {level}"
    return f"""
{depth}_nodes AS (
  SELECT n.*, p.share AS given FROM (
    SELECT {keys}, CAST(sum(supply) AS BIGINT) AS supply, {weight} AS weight FROM {source} GROUP BY ALL) AS n
  JOIN {parent} AS p ON {match}
), {depth}_each AS (
  SELECT *, (given - CAST(coalesce(sum(supply) OVER before, 0) AS DOUBLE))
            / CAST(sum(weight) OVER ({partition}) - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS each
  FROM {depth}_nodes
  WINDOW before AS ({every} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {depth}_line AS (
  SELECT *, first_value(CASE WHEN supply > weight * each THEN each END IGNORE NULLS) OVER (
    {every} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS line
  FROM {depth}_each
), {depth} AS (
  SELECT {keys}, CASE WHEN line IS NULL OR supply <= weight * line THEN CAST(supply AS DOUBLE) ELSE weight * line END AS share
  FROM {depth}_line
)"""


_DOMAIN_WEIGHT = "CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'notes' THEN 2 ELSE 1 END"
_LANG_WEIGHT = "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END"

BUDGETS = f"""
WITH numbered AS (
  SELECT doc_id, lang, source, (length(text) + 3) // 4 AS n_tokens, md5(coalesce(text, '')) AS hash,
         TRY_CAST(regexp_extract(source, '([0-9]{{1,4}})$', 1) AS INTEGER) AS number
  FROM documents
), named AS (
  SELECT doc_id, lang AS own_lang, source AS own_source, n_tokens, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CASE WHEN number = 0 THEN 'web' WHEN number < 10 THEN 'books' ELSE 'notes' END AS domain,
         coalesce(n_tokens, 0) AS tokens, coalesce(CAST(doc_id AS VARCHAR), '') || '|' || hash AS place
  FROM numbered
), leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS held, 3 * CAST(sum(tokens) AS BIGINT) AS supply FROM named GROUP BY ALL
), root AS (
  SELECT CAST(CAST(coalesce(sum(supply), 0) AS BIGINT) // 3 AS DOUBLE) AS share FROM leaves
), {_share("domains", "", "domain", _DOMAIN_WEIGHT, "leaves", "root")},
{_share("langs", "domain, ", "lang", _LANG_WEIGHT, "leaves", "domains")},
{_share("sources", "domain, lang, ", "source", "1", "leaves", "langs")},
passes AS (
  SELECT domain, lang, source, held, CAST(floor(share) AS BIGINT) AS given,
         CASE WHEN held = 0 THEN 0 ELSE CAST(floor(share) AS BIGINT) // held END AS whole
  FROM sources JOIN leaves USING (domain, lang, source)
), reached AS (
  SELECT n.*, p.whole, p.given - p.whole * p.held AS rest,
         sum(tokens) OVER (PARTITION BY n.domain, n.lang, n.source ORDER BY md5('0|' || p.whole || '|' || n.place)) AS reached
  FROM named AS n JOIN passes AS p ON p.domain = n.domain AND p.lang = n.lang AND p.source = n.source
)
SELECT doc_id, own_lang AS lang, own_source AS source, n_tokens,
       CAST(unnest(range(whole + CASE WHEN whole < 3 AND reached <= rest THEN 1 ELSE 0 END)) AS BIGINT) AS epoch
FROM reached
"""

# Every query against every candidate.
POSTINGS = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole AS q JOIN whole AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5
"""


def _escaped(column: str) -> str:
    """Length of a text with its control strings broken and its backslashes doubled."""
    counts = [f"(length({column}) - length(replace({column}, '{text}', ''))) // {len(text)}" for text in ("\\", *CONTROL)]
    return " + ".join([f"length({column})", *counts])


# Straight from the turns, without rendering or tokens.
CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum({len(TURN) + len(END) + 2} + {_escaped("role")} + length(role) - length(replace(role, chr(10), ''))
             + {_escaped("text")}) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, lines, row_number() OVER () AS place FROM split
), keyed AS (
  SELECT doc_id, place, unnest(lines) AS line, unnest(range(len(lines))) AS spot FROM numbered
), trimmed AS (
  SELECT *, translate(trim(line, {_BLANKS}), '{_CAPITALS}', '{_CAPITALS.lower()}') AS key FROM keyed
), owners AS (
  SELECT key, min(doc_id) AS owner FROM trimmed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT t.*, coalesce(t.doc_id > o.owner, FALSE) AS is_dropped FROM trimmed AS t LEFT JOIN owners AS o ON o.key = t.key
), grouped AS (
  SELECT doc_id, place, count(*) AS n_lines, count(*) FILTER (WHERE is_dropped) AS n_dropped,
         coalesce(string_agg(CASE WHEN NOT is_dropped THEN line END, chr(10) ORDER BY spot), '') AS kept
  FROM judged GROUP BY doc_id, place
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM grouped
"""


def _terms(column: str) -> str:
    small = f"translate(coalesce({column}, ''), '{_CAPITALS}', '{_CAPITALS.lower()}')"
    return f"regexp_extract_all({small}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


# Every term of every document.
LEXICAL = f"""
WITH numbered AS (
  SELECT row_number() OVER () AS place, doc_id, {_terms("text")} AS terms FROM documents
), held AS (
  SELECT * FROM numbered WHERE len(terms) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM held
), postings AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM held) GROUP BY place, term
), weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), asked AS (
  SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark
), scored AS (
  SELECT a.item_id, h.doc_id,
         CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(h.terms) * t.docs) // t.words)))) AS BIGINT) AS score
  FROM asked AS a JOIN postings AS p ON p.term = a.term JOIN weighted AS w ON w.term = a.term
  JOIN held AS h ON h.place = p.place, totals AS t
  GROUP BY a.item_id, h.place, h.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
