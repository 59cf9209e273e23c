"""The registered queries again, as DuckDB SQL over the same tables."""

from __future__ import annotations

import numpy as np

DIM = 64
NUM_PERM = 128
SPACES = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(32)||chr(133)||chr(160)"
)


def _words(text: str) -> str:
    """Words in order. Punctuation that joins two letters or two digits gets a mark first.

    Twice, because neighbouring joints share a character.
    """
    marked = f"lower({text})"
    for _ in range(2):
        marked = f"regexp_replace({marked}, '([\\p{{L}}\\p{{M}}])([:.''’·‧])(\\p{{L}})', '\\1\\2\ue000\\3', 'g')"
        marked = f"regexp_replace({marked}, '(\\p{{N}})([,;.''’])(\\p{{N}})', '\\1\\2\ue000\\3', 'g')"
    run = "[\\p{L}\\p{M}\\p{N}_]"
    word = f"_*[\\p{{L}}\\p{{N}}]{run}*(?:[:.''’·‧,;]\ue000{run}+)*"
    return f"list_transform(regexp_extract_all({marked}, '{word}'), lambda w: replace(w, '\ue000', ''))"


def _body(text: str) -> str:
    """Text after its first line, or all of it when there is one line only."""
    return f"CASE WHEN contains({text}, chr(10)) THEN substr({text}, instr({text}, chr(10)) + 1) ELSE {text} END"


def _hash(term: str) -> str:
    """First four bytes of SHA-1, read little-endian."""
    bytes_back = " || ".join(f"substr(sha1({term}), {at}, 2)" for at in (7, 5, 3, 1))
    return f"('0x' || {bytes_back})::BIGINT"


def _word_lists(name: str, table: str, key: str) -> str:
    """Distinct words of every text in order of first appearance."""
    return f"""
{name}_all AS MATERIALIZED (SELECT {key}, {_words('text')} AS words FROM {table}),
{name} AS MATERIALIZED (
  SELECT {key}, coalesce(words, []) AS words
  FROM (SELECT {key} FROM {table}) LEFT JOIN (
    SELECT {key}, list(term ORDER BY place) AS words
    FROM (SELECT {key}, term, min(place) AS place
          FROM (SELECT {key}, unnest(words) AS term, unnest(range(len(words))) AS place FROM {name}_all)
          GROUP BY ALL)
    GROUP BY ALL) USING ({key}))
"""


def _doc_words(table: str, text: str) -> str:
    return f"""
doc_len AS MATERIALIZED (SELECT doc_id, {_words(text)} AS words FROM {table}),
doc_words AS MATERIALIZED (SELECT doc_id, unnest(words) AS term FROM doc_len),
doc_tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM doc_words GROUP BY ALL)
"""


DOC_WORDS = _doc_words("documents", "text")
DOC_SKILLS = "doc_skill AS MATERIALIZED (SELECT doc_id, term FROM doc_tf)"

CV_WORDS = f"""
cv_words AS MATERIALIZED (SELECT item_id AS cv_id, unnest({_words('text')}) AS term FROM benchmark),
cv_tf AS MATERIALIZED (SELECT cv_id, term, count(*) AS tf FROM cv_words GROUP BY ALL)
"""


def _ranked(scored: str, source: str, k: int = 10) -> str:
    return f"""
    SELECT cv_id, doc_id, '{source}' AS source, rank, score AS raw_score FROM (
      SELECT cv_id, doc_id, score,
             row_number() OVER (PARTITION BY cv_id ORDER BY score DESC, doc_id)::INTEGER AS rank
      FROM ({scored})) WHERE rank <= {k}
    """


def _bm25(times: str) -> str:
    scored = f"""
      SELECT c.cv_id, d.doc_id,
             round(sum(2.0::DOUBLE * {times}
                       * ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE))
                       * d.tf * 2.2::DOUBLE
                       / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(l.words) / s.mean_length))), 6) AS score
      FROM cv_tf c
      JOIN doc_tf d ON d.term = c.term
      JOIN doc_len l ON l.doc_id = d.doc_id
      JOIN (SELECT term, count(*) AS df FROM doc_tf GROUP BY term) df ON df.term = c.term,
      (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM doc_len) s
      GROUP BY c.cv_id, d.doc_id
    """
    return _ranked(scored, "bm25")


def _sketch_ctes() -> str:
    # Seed 1, and in turn a multiplier from 1 and an offset from 0 below 2^61 - 1.
    draw, below = np.random.RandomState(1), 2**61 - 1
    drawn = [draw.randint(1 - i % 2, below, dtype=np.uint64) for i in range(2 * NUM_PERM)]
    values = ", ".join(f"({i}, {drawn[2 * i]}::HUGEINT, {drawn[2 * i + 1]}::HUGEINT)" for i in range(NUM_PERM))
    return f"""
perm(pos, a, b) AS MATERIALIZED (VALUES {values}),
hashed AS MATERIALIZED (
  SELECT term, {_hash('term')} AS h FROM (SELECT term FROM doc_skill UNION SELECT term FROM cv_tf)),
mixed AS MATERIALIZED (
  SELECT term, pos, ((((a * h + b) % 18446744073709551616) % 2305843009213693951) % 4294967296)::BIGINT AS v
  FROM hashed, perm),
doc_sketch AS MATERIALIZED (
  SELECT doc_id, pos, min(v) AS v FROM doc_skill JOIN mixed USING (term) GROUP BY doc_id, pos),
cv_sketch AS MATERIALIZED (
  SELECT cv_id, pos, min(v) AS v FROM cv_tf JOIN mixed USING (term) GROUP BY cv_id, pos),
pair_same AS MATERIALIZED (
  SELECT c.cv_id, d.doc_id, count(*) AS same, count(*) FILTER (c.pos < 32) AS bands
  FROM cv_sketch c JOIN doc_sketch d ON c.pos = d.pos AND c.v = d.v GROUP BY c.cv_id, d.doc_id),
candidate AS MATERIALIZED (SELECT * FROM pair_same WHERE bands > 0)
"""


TEXT_CTES = DOC_WORDS + "," + CV_WORDS
SKETCH_CTES = ",".join([TEXT_CTES, DOC_SKILLS, _sketch_ctes()])

LSH = _ranked(f"SELECT cv_id, doc_id, round(same / {NUM_PERM}::DOUBLE, 6) AS score FROM candidate", "lsh_minhash")

EXACT = _ranked(
    """
    SELECT p.cv_id, p.doc_id, round(i.shared / (c.n + d.n - i.shared)::DOUBLE, 6) AS score
    FROM candidate p
    JOIN (SELECT c.cv_id, d.doc_id, count(*) AS shared
          FROM cv_tf c JOIN doc_tf d ON c.term = d.term GROUP BY ALL) i
      ON i.cv_id = p.cv_id AND i.doc_id = p.doc_id
    JOIN (SELECT cv_id, count(*) AS n FROM cv_tf GROUP BY cv_id) c ON c.cv_id = p.cv_id
    JOIN (SELECT doc_id, count(*) AS n FROM doc_tf GROUP BY doc_id) d ON d.doc_id = p.doc_id
    """,
    "lsh_minhash",
)


def _embedding(name: str, table: str, id_column: str, text: str) -> str:
    """Signed word counts per cell, and the squared length per text."""
    return f"""
{name}_cell AS MATERIALIZED (
  SELECT id, h % {DIM} AS cell, sum(1 - 2 * ((h // {DIM}) % 2))::BIGINT AS x
  FROM (SELECT id, {_hash('term')} AS h
        FROM (SELECT {id_column} AS id, unnest({_words(text)}) AS term FROM {table}))
  GROUP BY ALL),
{name}_norm AS MATERIALIZED (SELECT id, sqrt(sum(x * x)::DOUBLE) AS norm FROM {name}_cell GROUP BY id HAVING sum(x * x) > 0)
"""


def _cosine(cv: str, doc: str, source: str) -> str:
    # A pair without a common cell has cosine 0 and still takes part in the ranking.
    scored = f"""
      SELECT c.id AS cv_id, d.id AS doc_id, round(coalesce(p.dot, 0) / (c.norm * d.norm) + 1, 6) AS score
      FROM {cv}_norm c CROSS JOIN {doc}_norm d
      LEFT JOIN (SELECT c.id AS cv_id, d.id AS doc_id, sum(c.x * d.x)::DOUBLE AS dot
                 FROM {cv}_cell c JOIN {doc}_cell d ON c.cell = d.cell GROUP BY ALL) p
        ON p.cv_id = c.id AND p.doc_id = d.id
    """
    return _ranked(scored, source)


def _hybrid_ctes(sketches: str, documents: str) -> str:
    embeddings = [
        _embedding("cv_text", "benchmark", "item_id", "text"),
        _embedding("cv_body", "benchmark", "item_id", _body("text")),
        _embedding("doc_text", documents, "doc_id", "text"),
        _embedding("doc_body", documents, "doc_id", _body("text")),
    ]
    return ",".join([sketches, *embeddings]) + f""",
hits AS MATERIALIZED (
  {_cosine('cv_text', 'doc_text', 'sem_description_vector')}
  UNION ALL {_cosine('cv_body', 'doc_body', 'sem_experience_vector')}
  UNION ALL {LSH}
  UNION ALL {_bm25('c.tf')}),
fused AS MATERIALIZED (
  SELECT cv_id, doc_id, rrf_score,
         row_number() OVER (PARTITION BY cv_id ORDER BY rrf_score DESC, doc_id)::INTEGER AS rank
  FROM (SELECT cv_id, doc_id,
               round(sum(CASE source WHEN 'sem_description_vector' THEN 1.2::DOUBLE
                                     WHEN 'sem_experience_vector' THEN 0.8::DOUBLE
                                     WHEN 'lsh_minhash' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank)), 6) AS rrf_score
        FROM hits GROUP BY cv_id, doc_id))
"""


HYBRID_CTES = _hybrid_ctes(SKETCH_CTES, "documents")

# One row per document, as its message reads after decoding.
MESSAGES = f"""
{_word_lists('doc_list', 'documents', 'doc_id')},
messages AS MATERIALIZED (
  SELECT doc_id, text,
         CASE WHEN lang = 'de' THEN 'Unknown' ELSE text END AS title,
         CASE WHEN lang = 'es' THEN '' ELSE source || chr(10) || ' 12 lượt xem' || chr(10) || lang END AS location,
         'MÔ TẢ CÔNG VIỆC:' || chr(160) || chr(10) || chr(10) || text AS description,
         array_to_string(words, ' , ') AS required_skills,
         CASE WHEN len(words) = 0 THEN [] ELSE
           list_transform(string_split(array_to_string(words, ' , '), ','), lambda w: trim(w)) END AS skills,
         n_chars || ' năm' AS min_experience_years,
         {_body('text')} AS job_requirements,
         'http://h/' || doc_id || '//?x=1#top' AS link, lang, source, n_chars
  FROM documents JOIN doc_list USING (doc_id))
"""

# Documents as they are stored after ingest: id, title and skills have gone through a message.
STORED_CTES = _hybrid_ctes(
    ",".join(
        [
            MESSAGES,
            """
stored AS MATERIALIZED (
  SELECT sha256('http://h/' || doc_id || '//?x=1') AS doc_id, CASE WHEN lang = 'de' THEN 'Unknown' ELSE text END AS title, text,
         skills
  FROM messages)""",
            _doc_words("stored", "title"),
            CV_WORDS,
            "doc_skill AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(skills) AS term FROM stored) WHERE term <> '')",
            _sketch_ctes(),
        ]
    ),
    "stored",
)

VECTOR_TOPK = _ranked(
        """
        SELECT c.vec_id AS cv_id, d.vec_id AS doc_id,
               round(list_cosine_similarity(c.v, d.v) + 1, 6) AS score
        FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) c,
             (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) d
        """,
        "sem_vector",
    )

# Pivots are the square root of all and one, by the MD5 of their id; a margin of 2e-6 besides the sixth digit.
PIVOT_REACH = """
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
pivots AS MATERIALIZED (
  SELECT vec_id AS p, v FROM (SELECT *, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) AS n FROM v)
  WHERE n <= (SELECT floor(sqrt(count(*))) + 1 FROM v)),
near AS MATERIALIZED (
  SELECT v.vec_id, p, greatest(-1, least(1, list_cosine_similarity(v.v, pivots.v))) AS cosine FROM v, pivots),
home AS (
  SELECT vec_id, arg_max(p, cosine) AS p, acos(max(cosine)) AS angle FROM near GROUP BY vec_id),
floors AS (
  SELECT vec_id, acos(greatest(-1, round(cosine + 1, 6) - 1 - 0.000001 - 0.000002)) AS reach
  FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC) AS n FROM near) WHERE n = 10)
SELECT f.vec_id AS cv_id, count(*) AS candidates
FROM floors f JOIN near q ON q.vec_id = f.vec_id JOIN home h ON h.p = q.p
WHERE abs(acos(q.cosine) - h.angle) <= f.reach GROUP BY f.vec_id
"""

LINKS = """
all_links AS (
  SELECT page_id, page_url, i - 1 AS position, hrefs[i] AS url
  FROM (SELECT page_id, page_url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i
        FROM (SELECT page_id, url AS page_url,
                     regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages))),
found AS (
  SELECT page_id, position::INTEGER AS position, url, rtrim(split_part(split_part(url, '?', 1), '#', 1), '/') AS url_key,
         page_url LIKE 'https:%' AS crawled
  FROM all_links WHERE url <> '' AND contains(url, '/') AND NOT contains(url, ',')),
fresh AS (
  SELECT url_key, page_id, position, url FROM (
    SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id, position, url) AS n
    FROM found WHERE NOT crawled AND url_key NOT IN (SELECT url_key FROM found WHERE crawled))
  WHERE n = 1)
"""


def _inner_text(html: str) -> str:
    text = f"regexp_replace({html}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g')"
    text = f"regexp_replace({text}, '(?i)<br\\s*/?>|</(?:p|div|li|h1|h2|h3|tr)>', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    # A reference cut off before its semicolon is one all the same.
    for entity, plain in [("copy", "chr(169)"), ("middot", "chr(183)"), ("lt", "'<'"), ("gt", "'>'"),
                          ("quot", "chr(34)"), ("amp", "'&'")]:
        text = f"regexp_replace({text}, '&{entity};?', {plain}, 'g')"
    return f"trim({text}, {SPACES})"


def _field(pattern: str) -> str:
    return _inner_text(f"regexp_extract(html, '{pattern}', 1)")


CLEAN_POSTING = f"""
WITH {MESSAGES},
cells AS (
  SELECT doc_id, h % {DIM} AS cell, sum(1 - 2 * ((h // {DIM}) % 2))::BIGINT AS x
  FROM (SELECT doc_id, {_hash('term')} AS h
        FROM (SELECT doc_id, unnest({_words('text')}) AS term FROM documents)) GROUP BY ALL),
vectors AS (
  SELECT doc_id, string_agg(coalesce(x, 0)::VARCHAR, ' ' ORDER BY g.cell) AS vector
  FROM (SELECT doc_id, cell FROM documents, range({DIM}) r(cell)) g LEFT JOIN cells USING (doc_id, cell)
  GROUP BY doc_id)
SELECT sha256('http://h/' || doc_id || '//?x=1') AS posting_id, 'job' AS doc_type, title,
       to_json(skills)::VARCHAR AS skills, array_to_string(skills, ' ') AS skills_text,
       trim(regexp_replace(text, '\\n+', chr(10), 'g'), {SPACES}) AS description,
       vector AS description_vector,
       job_requirements AS experience,
       CASE WHEN lang = 'es' THEN '' ELSE source || ', ' || lang END AS location,
       n_chars::INTEGER AS experience_years, link, 'job_description' AS origin
FROM messages JOIN vectors USING (doc_id)
"""

def _vector_list(name: str, cells: str) -> str:
    return f"""
{name} AS (
  SELECT doc_id, list(coalesce(x, 0)::FLOAT ORDER BY g.cell) AS vector
  FROM (SELECT doc_id, r.cell FROM documents, range({DIM}) r(cell)) g
  LEFT JOIN {cells} t ON t.id = g.doc_id AND t.cell = g.cell GROUP BY doc_id)"""


INDEX_DOCUMENTS = f"""
WITH {MESSAGES}, {CV_WORDS},
doc_skill AS MATERIALIZED (
  SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(skills) AS term FROM messages) WHERE term <> ''),
{_sketch_ctes()},
{_embedding('doc_text', 'documents', 'doc_id', 'text')},
{_embedding('doc_body', 'documents', 'doc_id', _body('text'))},
{_vector_list('text_vector', 'doc_text_cell')},
{_vector_list('body_vector', 'doc_body_cell')},
sketch_list AS (
  SELECT doc_id, list('hash_' || coalesce(v, 4294967295) ORDER BY pos) AS signature
  FROM (SELECT doc_id, pos FROM documents, perm) LEFT JOIN doc_sketch USING (doc_id, pos) GROUP BY doc_id)
SELECT sha256('http://h/' || doc_id || '//?x=1') AS id, to_json({{
  'doc_type': 'job', 'title': title, 'skills': skills, 'skills_signature': signature,
  'skills_text': array_to_string(skills, ' '),
  'description': trim(regexp_replace(text, '\\n+', chr(10), 'g'), {SPACES}),
  'description_vector': t.vector,
  'experience': job_requirements,
  'experience_vector': CASE WHEN job_requirements <> '' THEN b.vector END,
  'location': CASE WHEN lang = 'es' THEN '' ELSE source || ', ' || lang END,
  'experience_years': n_chars::INTEGER, 'link': link,
  'metadata': {{'source': 'job_description', 'indexed_at': '2024-01-31T15:00:00Z'}}}})::VARCHAR AS document
FROM messages JOIN sketch_list USING (doc_id) JOIN text_vector t USING (doc_id) JOIN body_vector b USING (doc_id)
"""

RESUME = f"""
{_word_lists('turn_list', 'conversations', 'conv_id, turn')},
resumes AS (SELECT conv_id, turn, role, text, words FROM conversations JOIN turn_list USING (conv_id, turn))
"""

ORACLES: dict[str, str] = {
    "corpus_stats": f"""WITH {DOC_WORDS}
        SELECT term, count(*) AS docs, sum(tf)::BIGINT AS occurrences FROM doc_tf GROUP BY term""",
    "corpus_totals": f"""WITH {DOC_WORDS}
        SELECT count(*) AS docs, sum(len(words))::BIGINT AS total_tokens, round(avg(len(words)), 6) AS mean_length
        FROM doc_len""",
    "bm25_topk": f"WITH {TEXT_CTES} {_bm25('c.tf')}",
    "bm25_distinct_terms": f"WITH {TEXT_CTES} {_bm25('1')}",
    "minhash_signature": f"""WITH {SKETCH_CTES}
        SELECT doc_id, string_agg('hash_' || coalesce(v, 4294967295), ' ' ORDER BY pos) AS signature
        FROM (SELECT doc_id, pos FROM documents, perm) LEFT JOIN doc_sketch USING (doc_id, pos) GROUP BY doc_id""",
    "lsh_bands": f"""WITH {SKETCH_CTES}
        SELECT doc_id, pos::INTEGER AS band, coalesce(v, 4294967295)::VARCHAR AS bucket
        FROM (SELECT doc_id, pos FROM documents, perm WHERE pos < 32) LEFT JOIN doc_sketch USING (doc_id, pos)""",
    "lsh_candidates": f"""WITH {SKETCH_CTES}
        SELECT cv_id, count(*) FILTER (doc_id IS NOT NULL) AS candidates
        FROM (SELECT DISTINCT cv_id FROM cv_tf) LEFT JOIN candidate USING (cv_id) GROUP BY cv_id""",
    "lsh_topk": f"WITH {SKETCH_CTES} {LSH}",
    "skill_jaccard_exact": f"WITH {SKETCH_CTES} {EXACT}",
    "vector_topk": VECTOR_TOPK,
    "pivot_topk": VECTOR_TOPK,
    "pivot_reach": PIVOT_REACH,
    "sketch_pairs": f"WITH {SKETCH_CTES} SELECT cv_id, doc_id, raw_score AS score FROM ({LSH})",
    "vector_pairs": f"SELECT cv_id, doc_id, rank, raw_score AS score FROM ({VECTOR_TOPK})",
    "hash_embed": f"""WITH {_embedding('doc_text', 'documents', 'doc_id', 'text')}
        SELECT doc_id, string_agg(coalesce(x, 0)::VARCHAR, ' ' ORDER BY g.cell) AS vector
        FROM (SELECT doc_id, r.cell FROM documents, range({DIM}) r(cell)) g
        LEFT JOIN doc_text_cell t ON t.id = g.doc_id AND t.cell = g.cell GROUP BY doc_id""",
    "model_embed": f"""SELECT doc_id, length(text)::DOUBLE AS characters,
        (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks,
        CASE WHEN {_body('text')} <> '' THEN length({_body('text')}) END::DOUBLE AS body_characters FROM documents""",
    "stored_vectors": f"""
        WITH t AS (SELECT doc_id, text, {_body('text')} AS body FROM documents),
        early AS (SELECT DISTINCT text AS x FROM t WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND text <> ''),
        late AS (SELECT text AS x FROM t WHERE text <> '' UNION SELECT body FROM t WHERE body <> '')
        SELECT doc_id, length(text)::DOUBLE AS characters,
               CASE WHEN body <> '' THEN length(body) - length(replace(body, ' ', '')) END::DOUBLE AS body_blanks,
               (SELECT count(*) FROM early) AS first_calls,
               (SELECT count(*) FROM (SELECT * FROM late EXCEPT SELECT * FROM early)) AS last_calls
        FROM t""",
    "channel_counts": f"WITH {HYBRID_CTES} SELECT cv_id, source, count(*) AS hits FROM hits GROUP BY ALL",
    "rrf_fusion": f"""WITH {HYBRID_CTES}
        SELECT f.cv_id, f.doc_id, f.rank, f.rrf_score, h.source, h.rank AS source_rank, h.raw_score
        FROM fused f JOIN hits h ON h.cv_id = f.cv_id AND h.doc_id = f.doc_id""",
    "hybrid_match": f"WITH {HYBRID_CTES} SELECT cv_id, doc_id, rrf_score, rank FROM fused WHERE rank <= 5",
    "match_report": f"""WITH {HYBRID_CTES}, {_word_lists('doc_list', 'documents', 'doc_id')}
        SELECT cv_id, rank, doc_id, left(text, 40) AS title, format('{{:.5f}}', rrf_score) AS score,
               list_aggregate(words, 'string_agg', ', ') AS skills,
               left({_body('text')}, 100) || '...' AS experience, why
        FROM fused JOIN documents USING (doc_id) JOIN doc_list USING (doc_id) JOIN (
          SELECT cv_id, doc_id, '{{' || string_agg('"' || source || '":{{"rank":' || rank || ',"raw_score":' || raw_score || '}}', ','
                                                   ORDER BY source) || '}}' AS why
          FROM hits GROUP BY cv_id, doc_id) USING (cv_id, doc_id) WHERE rank <= 5""",
    "discover_links": f"WITH {LINKS} SELECT page_id, position, url, url_key FROM found",
    "scoped_links": """
        SELECT page_id, CAST(i - 1 AS INTEGER) AS position, 'http' || scheme || '://' || host || path AS url,
               rtrim('http' || scheme || '://' || host || path, '/') AS url_key
        FROM (SELECT *, unnest(paths) AS path, unnest(range(1, len(paths) + 1)) AS i FROM (
          SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 's' ELSE '' END AS scheme,
                 split_part(split_part(url, '//', 2), '/', 1) AS host,
                 regexp_extract_all(html, '<a href="([^"]*)"', 1) AS paths
          FROM pages WHERE contains(html, '<html lang="en"')))
        WHERE NOT contains(path, ',')""",
    "url_frontier": f"WITH {LINKS} SELECT url_key, page_id, position, url FROM fresh",
    "merged_history": f"""WITH {LINKS}
        SELECT url_key FROM found WHERE crawled UNION SELECT url_key FROM fresh""",
    "stream_links": f"WITH {LINKS} SELECT url_key FROM fresh",
    "page_urls": """
        SELECT o_orderpriority, total, page::INTEGER AS page, 'http://host/list?page=' || page AS page_url
        FROM (SELECT o_orderpriority, format('{:,}', n) AS total, unnest(range(1, (n + 49) // 50 + 1)) AS page
              FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1))""",
    "page_count": "SELECT l_suppkey, ((count(*) + 49) // 50)::INTEGER AS pages FROM lineitem GROUP BY l_suppkey",
    "page_fields": f"""
        SELECT page_id, {_field('(?s)<h1[^>]*>(.*?)</h1>')} AS title,
               regexp_extract(html, '<html lang="([^"]*)"', 1) AS location,
               {_field('(?s)<article[^>]*>(.*?)</article>')} AS description,
               {_field('(?s)<nav[^>]*>(.*?)</nav>')} AS required_skills,
               page_id::VARCHAR AS min_experience_years,
               {_field('(?s)<footer>(.*?)</footer>')} AS job_requirements,
               url AS link
        FROM pages""",
    "convert_documents": f"""
        SELECT 'crawl/' || page_id || '.v1.HTML' AS path, page_id::VARCHAR AS stem,
               sha256('crawl/' || page_id || '.v1.HTML') || '_' || page_id || '.v1.HTML' AS name, {_inner_text('html')} AS text,
               CAST(NULL AS VARCHAR) AS error
        FROM pages""",
    "converted_texts": """
        SELECT page_id::VARCHAR AS stem,
               CASE WHEN contains(html, '</html>') THEN split_part(split_part(html, '<title>', 2), '</title>', 1) END AS text,
               CASE WHEN NOT contains(html, '</html>') THEN 'cut off' END AS error
        FROM pages""",
    "stored_history": f"WITH {LINKS} SELECT url, count(*) AS times FROM found WHERE NOT crawled GROUP BY url",
    "catalog_postings": f"""WITH {MESSAGES}
        SELECT sha256('http://h/' || doc_id || '//?x=1') AS posting_id, CASE WHEN lang = 'de' THEN 'Unknown' ELSE text END AS title,
               len(skills)::INTEGER AS n_skills, 7::BIGINT AS batch_id
        FROM messages""",
    "zero_queries": f"""WITH {_embedding('cv_text', 'benchmark', 'item_id', 'text')},
        {_embedding('doc_text', 'documents', 'doc_id', 'text')}
        SELECT cv_id, doc_id, rank FROM ({_cosine('cv_text', 'doc_text', 'v')}) WHERE rank = 1 AND cv_id % 2 = 1""",
    "compacted_postings": """
        SELECT sha256('http://h/' || doc_id || '//?x=1') AS posting_id,
               CASE WHEN doc_id % 4 = 0 AND doc_id % 6 <> 0 THEN 'again' WHEN lang = 'de' THEN 'Unknown' ELSE text END AS title,
               'job' AS doc_type
        FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "json_lines": "SELECT * FROM conversations",
    "model_profiles": """
        SELECT conv_id, turn, CASE WHEN length(text) % 3 <> 0 THEN split_part(text, ' ', 1) END AS title,
               CASE WHEN length(text) % 3 <> 0 THEN length(text)::VARCHAR END AS description,
               CASE WHEN length(text) % 3 = 0 THEN 'not a JSON object' END AS reason
        FROM conversations""",
    "profile_extract": f"""WITH {RESUME}
        SELECT conv_id, turn, role || ' ' || conv_id AS title, coalesce(list_aggregate(words, 'string_agg', ' '), '') AS skills,
               trim(text, {SPACES}) AS description,
               CASE WHEN role = 'assistant' THEN 'N/A' ELSE trim(text, {SPACES}) END AS experience
        FROM resumes WHERE role <> 'system'""",
    "profile_rejects": "SELECT conv_id, turn, 'missing or wrong: skills' AS reason FROM conversations WHERE role = 'system'",
    "profile_replies": f"""
        SELECT conv_id, turn, role AS title, list_aggregate({_words('text')}, 'string_agg', ' ') AS skills,
               text AS description, CASE WHEN role = 'user' THEN 'N/A' ELSE text END AS experience
        FROM conversations WHERE role <> 'system' AND turn <> 0""",
    "profile_reply_rejects": """
        SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'not a JSON object' ELSE 'missing or wrong: description' END AS reason
        FROM conversations WHERE role = 'system' OR turn = 0""",
    "decode_messages": f"""WITH {MESSAGES}
        SELECT doc_id, title, location, description, required_skills,
               min_experience_years, job_requirements, link, NULL::DOUBLE AS min_experience_number
        FROM messages""",
    "decode_rejects": """
        SELECT 'doc ' || doc_id AS id, 'not JSON' AS reason FROM documents
        UNION ALL SELECT 'user ' || event_id, 'not an object' FROM events""",
    "clean_posting": CLEAN_POSTING,
    "stream_enrich": CLEAN_POSTING,
    "stored_match": f"WITH {STORED_CTES} SELECT cv_id, doc_id, rrf_score, rank FROM fused WHERE rank <= 5",
    "stored_one_scan": f"WITH {STORED_CTES} SELECT cv_id, doc_id, rrf_score, rank FROM fused WHERE rank <= 5",
    "stored_lsh": f"WITH {STORED_CTES} {LSH}",
    "stored_bm25": f"WITH {STORED_CTES} {_bm25('c.tf')}",
    "stored_bands": f"""WITH {STORED_CTES}
        SELECT doc_id, pos::INTEGER AS band, v::VARCHAR AS bucket FROM doc_sketch WHERE pos < 32""",
    "stored_terms": f"""WITH {STORED_CTES}
        SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tokens FROM doc_tf GROUP BY term
        UNION ALL SELECT '', count(*), sum(len(words))::BIGINT FROM doc_len""",
    "index_documents": INDEX_DOCUMENTS,
    "stream_rejects": "SELECT sha256(text) AS value_hash, 'not JSON' AS reason FROM documents",
    "stream_balance": """
        SELECT 3 * n + blanks AS received, blanks AS empty, n AS saved, n AS rejected, n AS replaced, 0::BIGINT AS missing
        FROM (SELECT count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS blanks FROM documents)""",
    "stream_status": "SELECT count(*)::BIGINT AS saved, count(*)::BIGINT AS rejected FROM documents",
    "clean_location": f"""
        SELECT conv_id, turn,
               list_aggregate(list_transform(string_split(text, chr(10)), lambda l: trim(l, {SPACES})), 'string_agg', ', ') AS location
        FROM conversations""",
    "publish_json": """
        SELECT NULL::VARCHAR AS key,
               to_json({'event_id': event_id, 'ts': strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 'user_id': user_id,
                        'event_type': event_type, 'props': props})::VARCHAR AS value
        FROM events""",
    "latest_postings": """
        SELECT posting_id, batch_id, n_chars FROM (
          SELECT sha256(text) AS posting_id, doc_id AS batch_id, n_chars,
                 row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS n FROM documents)
        WHERE n = 1""",
}
ORACLES["incremental_compaction"] = ORACLES["compacted_postings"]
ORACLES["stream_links_ttl"] = ORACLES["stream_links"]
ORACLES["bulk_refused"] = "SELECT doc_id::VARCHAR AS id, 'no de' AS reason FROM documents WHERE lang = 'de'"
ORACLES["bulk_status"] = """
    SELECT doc_id % 2 AS batch_id, count(*) FILTER (lang IS DISTINCT FROM 'de') AS saved, count(*) FILTER (lang = 'de') AS refused
    FROM documents GROUP BY ALL"""
ORACLES["posting_pages"] = """
    SELECT 'job ' || doc_id AS title, source AS location, 'about ' || lang || chr(10) || doc_id AS description,
           lang || ', SQL' AS required_skills, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 7)::VARCHAR ELSE '0' END AS min_experience_years,
           'needs ' || lang AS job_requirements, 'http://h/' || doc_id AS link
    FROM documents"""
ORACLES["message_values"] = """
    SELECT 'http://h/' || doc_id AS link, CASE WHEN doc_id % 2 <> 0 THEN 'Unknown' END AS title,
           CASE WHEN doc_id % 3 <> 0 THEN '' END AS required_skills,
           CASE doc_id % 5 WHEN 3 THEN '2-' || n_chars WHEN 4 THEN '0' END AS min_experience_years,
           CASE doc_id % 5 WHEN 1 THEN -n_chars::DOUBLE WHEN 2 THEN n_chars + 0.5::DOUBLE END AS min_experience_number,
           CASE doc_id % 5 WHEN 1 THEN -n_chars WHEN 2 THEN n_chars WHEN 3 THEN 2 ELSE 0 END::INTEGER AS years
    FROM documents"""
ORACLES["document_files"] = "SELECT conv_id, turn, text FROM conversations WHERE turn < 4 AND role IN ('user', 'assistant')"
