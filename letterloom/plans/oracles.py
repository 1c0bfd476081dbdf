"""The SQL that each registered query is checked against."""

import re

from letterloom.constants import (
    BANNED_CLOSINGS,
    BANNED_OPENINGS,
    DEFAULT_SECTIONS,
    DEFAULT_VOICE,
    FILLER_WORDS,
    NO_REFRAME,
    NOT_SPECIFIED,
)
from letterloom.plans.fixtures import LEXICON, WORD_PAIRS
from letterloom.plans.queries import AS_OF_M, HINTS, SECTIONS, VALUE_WORDS, VERBS

EDGE = r"^[\s\x0B\p{Z}\x{FEFF}]+|[\s\x0B\p{Z}\x{FEFF}]+$"
BULLET = r"(?:^|\n)[ \t]*[-*•] "


def strip(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"


def sentences(x: str) -> str:
    return f"regexp_extract_all({x}, '[^.!?]+[.!?]+')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def words(x: str) -> str:
    return count(x, r"\S+")


def paragraphs(x: str, separator: str) -> str:
    return (
        f"list_filter(regexp_split_to_array({strip(x)}, '{separator}'), "
        f"lambda p: length({strip('p')}) > 0)"
    )


def normalised(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(column: str, items: list[str]) -> str:
    return f"(SELECT unnest([{', '.join(quoted(i) for i in items)}]) AS {column})"


def has_phrase(x: str, phrase: str) -> str:
    return f"contains(concat(' ', {normalised(x)}, ' '), concat(' ', {normalised(phrase)}, ' '))"


VIEWS = {
    "v_samples": """
SELECT source AS author_id, CASE WHEN doc_id % 3 = 0 THEN 'resume' ELSE 'cover_letter' END AS kind,
  doc_id, text FROM documents""",
    "v_sample_files": """
SELECT *, concat(CASE WHEN doc_id % 13 = 0 THEN '.' ELSE '' END, author_id, '_',
  lpad(CAST(doc_id AS VARCHAR), 9, '0'), '.md') AS file_name FROM v_samples""",
    "v_fetched": """
SELECT page_id, url, CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 23 = 0 THEN '  short  ' ELSE html END AS body FROM pages""",
    "v_requests": """
SELECT page_id, CASE page_id % 7
  WHEN 0 THEN concat('job_', page_id, '.txt')
  WHEN 1 THEN replace(url, 'http', 'HTTP')
  WHEN 2 THEN regexp_replace(url, '^(https?://)([^/]*)', '\\1www.\\2:8443')
  WHEN 3 THEN concat(url, '/Stellen angebote/für Ä')
  WHEN 4 THEN concat(regexp_replace(url, '[?#].*$', ''), repeat('/long-path', 10))
  ELSE url END AS source FROM pages""",
    "v_mentions": """
SELECT o_custkey AS applicant_id, p_name AS skill
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "v_skills": "SELECT DISTINCT applicant_id, skill FROM v_mentions",
    "v_requirements": """
SELECT job_id, skill, rnk, CASE WHEN rnk <= 8 THEN 'required' ELSE 'preferred' END AS level
FROM (SELECT l_suppkey AS job_id, p_name AS skill,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_name) AS rnk
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_name) t""",
    "v_applications": """
SELECT DISTINCT o_custkey AS applicant_id, l_suppkey AS job_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
WHERE c_nationkey = s_nationkey""",
    "v_roles": """
SELECT o_custkey AS applicant_id, o_orderkey AS role_id, o_orderpriority AS title, o_orderstatus AS company,
  12 * year(o_orderdate) + month(o_orderdate) AS start_m,
  12 * year(o_orderdate) + month(o_orderdate) + CAST(o_orderkey % 24 AS INT) AS end_m,
  o_orderkey % 11 = 0 AS is_current FROM orders""",
    "v_bullets": """
SELECT l_orderkey AS role_id, l_linenumber AS bullet_no,
  CASE WHEN l_quantity >= 25 THEN concat('Delivered ', CAST(CAST(l_quantity AS INT) AS VARCHAR), ' units of ', p_name)
       ELSE concat('responsible for ', p_name) END AS text
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_outputs": """
SELECT conv_id AS application_id, turn, text FROM conversations WHERE role = 'assistant'""",
    "v_outputs_num": """
SELECT l_orderkey AS role_id, l_linenumber AS bullet_no,
  concat('Delivered ', CAST(CAST(l_quantity AS INT) + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR), ' units') AS text
FROM lineitem""",
    "v_related": """
SELECT DISTINCT a.p_name AS skill, b.p_name AS covers
FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b
  ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND a.p_name <> b.p_name""",
    "v_claims": """
SELECT applicant_id, 'skill' AS kind,
  CASE WHEN applicant_id % 5 = 0 THEN concat(skill, ' expert') ELSE skill END AS value FROM v_skills""",
    "v_gap": """
SELECT applicant_id, job_id, skill FROM v_applications JOIN v_requirements r USING (job_id)
WHERE level = 'required'
  AND NOT EXISTS (SELECT 1 FROM v_skills s WHERE s.applicant_id = v_applications.applicant_id AND s.skill = r.skill)""",
    "v_match": """
SELECT applicant_id, job_id, skill, level FROM v_applications JOIN v_requirements USING (job_id)
JOIN v_skills USING (applicant_id, skill)""",
    "v_mitigated": f"""
SELECT g.applicant_id, g.job_id, g.skill AS missing_skill, count(s.skill) AS n_via,
  CASE WHEN count(s.skill) = 0 THEN '{NO_REFRAME}'
       ELSE concat('transferable from ', min(s.skill), ', covers ', g.skill) END AS mitigation
FROM v_gap g LEFT JOIN v_related r ON r.covers = g.skill
LEFT JOIN v_skills s ON s.applicant_id = g.applicant_id AND s.skill = r.skill
GROUP BY g.applicant_id, g.job_id, g.skill""",
    "v_links": """
SELECT DISTINCT b.role_id, b.bullet_no, b.text, r.skill, len(string_split(r.skill, ' ')) AS overlap
FROM v_bullets b JOIN (SELECT DISTINCT skill FROM v_requirements) r
  ON contains(concat(' ', lower(b.text), ' '), concat(' ', r.skill, ' '))""",
    "v_top_roles": """
SELECT * , count(*) OVER (PARTITION BY applicant_id, job_id) < 2 AS below_minimum FROM (
  SELECT applicant_id, job_id, role_id, count(*) AS score, string_agg(skill, ', ' ORDER BY skill) AS reason,
    row_number() OVER (PARTITION BY applicant_id, job_id ORDER BY count(*) DESC, start_m DESC, role_id) AS role_rank
  FROM v_applications JOIN v_requirements USING (job_id)
  JOIN (SELECT DISTINCT applicant_id, role_id, start_m, skill FROM v_links JOIN v_roles USING (role_id)) l
    USING (applicant_id, skill)
  GROUP BY applicant_id, job_id, role_id, start_m) t
WHERE role_rank <= 4""",
    "v_top_bullets": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role_id
    ORDER BY regexp_matches(text, '[0-9]') DESC, bullet_no, text) AS bullet_rank FROM v_bullets) t
WHERE bullet_rank <= 4""",
    "v_hooks": """
SELECT * FROM (SELECT applicant_id, job_id, skill AS posting_detail, text AS applicant_detail,
    row_number() OVER (PARTITION BY applicant_id, job_id
      ORDER BY overlap DESC, regexp_matches(text, '[0-9]') DESC, rnk, role_id, bullet_no, text) AS hook_rank
  FROM v_applications JOIN v_requirements USING (job_id)
  JOIN (SELECT v_links.*, applicant_id FROM v_links JOIN v_roles USING (role_id)) l
    USING (applicant_id, skill)) t
WHERE hook_rank <= 3""",
    "v_letters": """
SELECT application_id, turn, o.job_id, applicant_id,
  concat('Dear Hiring Manager,', chr(10), chr(10),
    CASE WHEN application_id % 4 = 0 THEN 'I am excited about this role. ' ELSE '' END, text, chr(10), chr(10),
    CASE WHEN application_id % 3 = 0 THEN concat('At ', s_name, ' I would help. ') ELSE '' END,
    CASE WHEN application_id % 6 = 0 THEN concat('I can Maintain ', skill, '.') ELSE '' END, chr(10), chr(10),
    CASE WHEN application_id % 5 = 0 THEN 'Thank you for your consideration.' ELSE 'Let us talk.' END,
    chr(10), chr(10),
    CASE WHEN application_id % 8 = 0 THEN 'Yours,' ELSE 'Best regards,' END, chr(10),
    CASE WHEN application_id % 7 = 0 THEN 'Someone Else' ELSE c_name END) AS text
FROM (SELECT *, application_id % (SELECT count(*) FROM supplier) AS job_id,
        application_id % (SELECT count(*) FROM customer) AS applicant_id FROM v_outputs) o
JOIN supplier ON s_suppkey = o.job_id JOIN customer ON c_custkey = applicant_id
JOIN v_requirements r ON r.job_id = o.job_id AND rnk = 2""",
    "v_jobs": """
SELECT s_suppkey AS job_id, s_name,
  concat(n_name, CASE s_suppkey % 4 WHEN 0 THEN ' (Remote)' WHEN 1 THEN ' (Hybrid, 2 days)'
    WHEN 2 THEN ' (On-site)' ELSE '' END) AS location,
  concat(CASE WHEN s_suppkey % 3 = 0 THEN 'Senior ' ELSE '' END, 'Planner') AS title,
  CASE s_suppkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'On-site' ELSE 'Not specified' END AS policy,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Not specified'
    ELSE concat('$', 50000 + s_suppkey * 10, ' - $', 70000 + s_suppkey * 10) END AS pay,
  2 + s_suppkey % 7 AS years, s_suppkey % 3 = 0 AS is_senior,
  regexp_replace(regexp_replace(lower(concat(s_name, '_', CASE WHEN s_suppkey % 3 = 0 THEN 'Senior ' ELSE '' END, 'Planner')),
    '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug,
  top1, top2, n_skills
FROM supplier JOIN nation ON s_nationkey = n_nationkey
JOIN (SELECT job_id, max(CASE WHEN rnk = 1 THEN skill END) AS top1, max(CASE WHEN rnk = 2 THEN skill END) AS top2,
        count(*) AS n_skills
      FROM v_requirements GROUP BY job_id) r ON r.job_id = s_suppkey""",
    "v_styled": """
SELECT job_id, CASE job_id % 4
  WHEN 0 THEN concat('# ', title, chr(10), s_name, ' - ', n_name, chr(10), chr(10), '**About us**', chr(10), 'We value ownership.',
    chr(10), chr(10), '## Responsibilities', chr(10), '* Take ownership of ', top1, chr(10), '* Maintain ', top2, chr(10), chr(10),
    '**Requirements**', chr(10), starred, chr(10), '## Nice to have', chr(10), wished_starred, chr(10), '**Compensation:** $', low,
    'k-', high, 'k', chr(10), 'Apply soon.')
  WHEN 1 THEN concat(title, ' at ', s_name, chr(10), 'Place: ', n_name, chr(10), 'What you will do:', chr(10), '1. Take ownership of ',
    top1, chr(10), '2. Maintain ', top2, chr(10), 'Requirements (must):', chr(10), numbered, 'Bonus', chr(10), wished_numbered,
    'Benefits:', chr(10), '- free tea', chr(10), 'We pay €', low, ',000 – €', high, ',000 a year')
  WHEN 2 THEN concat('Position: ', title, chr(10), 'Employer: ', s_name, chr(10), 'Must-have skills:', chr(10), dashed,
    'Preferred qualifications (plus):', chr(10), wished_dashed, chr(10), chr(10))
  ELSE replace(concat('Role: ', title, chr(10), 'Organisation: ', s_name, chr(10), 'Office: ', n_name, chr(10), 'Pay range: £', low,
    ',000', chr(10), 'ESSENTIAL SKILLS', chr(10), dotted), chr(10), chr(13) || chr(10)) END AS text
FROM (SELECT job_id, s_name, title, top1, top2, 50 + job_id % 40 AS low, 70 + job_id % 40 AS high FROM v_jobs) j
JOIN (SELECT s_suppkey AS job_id, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) n USING (job_id)
JOIN (SELECT job_id, string_agg(concat('* ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk <= 8) AS starred,
    string_agg(concat('* ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk >= 7) AS wished_starred,
    string_agg(concat(rnk, ') ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk <= 8) AS numbered,
    string_agg(concat('(', rnk - 6, ') ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk >= 7) AS wished_numbered,
    string_agg(concat('– ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk <= 8) AS dashed,
    string_agg(concat('  — ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk >= 7) AS wished_dashed,
    string_agg(concat('• ', skill, chr(10)), '' ORDER BY rnk) FILTER (rnk <= 8) AS dotted
  FROM v_requirements GROUP BY job_id) r USING (job_id)""",
    "v_parsed": r"""
WITH numbered AS (SELECT job_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS raw,
    generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS no FROM v_styled),
told AS (SELECT job_id, no, trim(regexp_replace(raw, '^#+ +|[*][*]', '', 'g')) AS plain, regexp_matches(raw, '^#|^[*][*]') AS marked,
    regexp_extract(trim(raw), '^(?:[-*•–—]|[(]?[0-9]+[.)]) +(.+)$', 1) AS item FROM numbered WHERE trim(raw) <> ''),
labelled AS (SELECT *, regexp_extract(plain, '^([A-Z][A-Za-z ]*): +(.+)$', 2) AS said,
    CASE WHEN item = '' THEN CASE lower(regexp_extract(plain, '^([A-Z][A-Za-z ]*): +(.+)$', 1)) WHEN 'position' THEN 'title' WHEN 'role' THEN 'title'
      WHEN 'employer' THEN 'company' WHEN 'organisation' THEN 'company' WHEN 'place' THEN 'location' WHEN 'office' THEN 'location'
      WHEN 'compensation' THEN 'salary' WHEN 'pay range' THEN 'salary' END END AS label,
    CASE WHEN item = '' THEN CASE lower(regexp_replace(regexp_replace(plain, ':$', ''), ' *[(].*[)]$', ''))
      WHEN 'responsibilities' THEN 'responsibility' WHEN 'what you will do' THEN 'responsibility' WHEN 'requirements' THEN 'required'
      WHEN 'must-have skills' THEN 'required' WHEN 'essential skills' THEN 'required' WHEN 'nice to have' THEN 'preferred'
      WHEN 'bonus' THEN 'preferred' WHEN 'preferred qualifications' THEN 'preferred' WHEN 'about us' THEN 'about'
      ELSE CASE WHEN marked OR ends_with(plain, ':') THEN 'other' END END END AS heading FROM told),
kinds AS (SELECT *, CASE WHEN item <> '' THEN 'item' WHEN label IS NOT NULL THEN 'label' WHEN heading IS NOT NULL THEN 'heading'
    ELSE 'text' END AS kind FROM labelled)
SELECT job_id, no, kind, coalesce(label, heading, '') AS name,
  CASE kind WHEN 'item' THEN item WHEN 'label' THEN said ELSE plain END AS value,
  coalesce(last_value(CASE WHEN kind = 'text' AND before = 'item' THEN '' ELSE coalesce(label, heading) END IGNORE NULLS)
    OVER (PARTITION BY job_id ORDER BY no), '') AS section,
  row_number() OVER (PARTITION BY job_id ORDER BY no) AS place
FROM (SELECT *, lag(kind) OVER (PARTITION BY job_id ORDER BY no) AS before FROM kinds) k""",
    "v_templates": r"""
SELECT p_partkey AS template_id, p_partkey % 6 AS form, p_name, p_brand, p_type,
  concat('$& \item ', p_brand) AS name_value,
  CASE p_partkey % 6
    WHEN 0 THEN 'Dear {{NAME}}, {{NAME}} knows {{SKILL}}.'
    WHEN 1 THEN 'Spaced {{ NAME }} and {{SKILL}}.'
    WHEN 2 THEN 'Triple {{{NAME}}} and {{SKILL}}.'
    WHEN 3 THEN concat('No hole for ', p_name)
    WHEN 4 THEN 'Dotted {{a.b}} and {{axb}}.'
    ELSE 'Chained {{OUTER}} then {{NAME}}; never {{LOST}}.' END AS text FROM part""",
    "v_filled": """
SELECT template_id, replace(replace(replace(replace(text, '{{OUTER}}', concat('[{{NAME}} ', p_type, ']')),
  '{{NAME}}', name_value), '{{SKILL}}', p_name), '{{a.b}}', 'dot') AS filled FROM v_templates""",
    "v_resumes": """
SELECT o_orderkey AS role_id, o_custkey AS applicant_id, c_name, o_orderpriority AS title, o_orderstatus AS company,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END AS location, o_orderdate,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y')
    WHEN 2 THEN strftime(o_orderdate, '%b %Y') ELSE strftime(o_orderdate, '%m/%Y') END AS start,
  CASE o_orderkey % 11 WHEN 0 THEN 'Present' WHEN 1 THEN '' ELSE '2003-05' END AS end_text,
  CASE WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-01') ELSE strftime(o_orderdate, '%Y-%m') END AS start_date,
  CASE o_orderkey % 11 WHEN 0 THEN 'present' WHEN 1 THEN '' ELSE '2003-05' END AS end_date,
  concat('BSc in ', c_mktsegment) AS degree, concat('School of ', n_name) AS school,
  CAST(1980 + o_orderkey % 20 AS INT) AS graduation_year, o_orderkey % 9 <> 0 AS year_is_whole
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_styled_resumes": """
SELECT o_orderkey AS role_id, concat(c_name, chr(10), CASE o_orderkey % 3
  WHEN 0 THEN concat('* ', o_orderpriority, ' at Works ', o_orderstatus, ' (', since, ' – ', till, ')', chr(10), '* ', degree,
    ' (', graduated, ')')
  WHEN 1 THEN concat('1. ', o_orderpriority, ' · Works ', o_orderstatus, ' · ', n_name, ' · ', since, ' until ', till, chr(10),
    '2) ', degree, ', ', graduated - 4, ' - ', graduated)
  ELSE concat('• ', o_orderpriority, ', Works ', o_orderstatus, ', ', since, ' - ', till, chr(10), '• ', degree, ', ', graduated) END,
  chr(10), '- Led a team of ', c_custkey % 9) AS text
FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS since, CASE WHEN o_orderkey % 11 = 0 THEN 'today' ELSE '2003-05' END AS till,
    concat('BSc in ', c_mktsegment, ', School of ', n_name) AS degree, 1980 + o_orderkey % 20 AS graduated
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) t""",
    "v_latest": """
SELECT * FROM (SELECT user_id AS applicant_id, event_type AS field, value, event_id,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) t
WHERE n = 1""",
    "v_role_mentions": """
SELECT applicant_id, role_id * 3 + version AS mention_id, role_id, version,
  CASE version WHEN 1 THEN concat('Senior ', title) ELSE title END AS title,
  CASE version WHEN 0 THEN concat('Works ', company) WHEN 1 THEN concat('works ', company, ' GmbH')
    ELSE concat('WORKS ', company, ', Inc.') END AS company,
  CASE version WHEN 2 THEN '' ELSE concat('Hall ', role_id % 4) END AS location,
  CASE WHEN version = 0 THEN start_m WHEN version = 1 THEN (start_m - 1) // 12 * 12 + 1
    WHEN role_id % 5 > 0 THEN start_m + 1 END AS start_m,
  CASE WHEN is_current THEN NULL ELSE end_m END AS end_m
FROM (SELECT *, unnest(range(0, role_id % 3 + 1)) AS version FROM v_roles) t""",
    "v_role_keys": f"""
SELECT *, greatest(least(coalesce(end_m, {AS_OF_M}), {AS_OF_M}), start_m + 1) AS to_m FROM (
  SELECT *, array_to_string(list_filter({tokens('company')}, lambda w: w NOT IN ('gmbh', 'inc')), ' ') AS company_key,
    {normalised('title')} AS title_key FROM v_role_mentions) t""",
    "v_role_runs": """
WITH marked AS (SELECT *,
    CASE WHEN start_m < max(to_m) OVER by_company THEN NULL ELSE start_m END AS company_first,
    CASE WHEN start_m < max(to_m + 6) OVER by_title THEN NULL ELSE start_m END AS title_first
  FROM v_role_keys WHERE start_m IS NOT NULL
  WINDOW by_company AS (PARTITION BY applicant_id, company_key ORDER BY start_m, mention_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         by_title AS (PARTITION BY applicant_id, company_key, title_key ORDER BY start_m, mention_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, max(company_first) OVER (PARTITION BY applicant_id, company_key ORDER BY start_m, mention_id) AS company_start,
  max(title_first) OVER (PARTITION BY applicant_id, company_key, title_key ORDER BY start_m, mention_id) AS title_start
FROM marked""",
    "v_role_starts": """
WITH RECURSIVE runs AS (SELECT DISTINCT applicant_id, company_key, company_start, title_key, title_start FROM v_role_runs),
bridges AS (SELECT DISTINCT a.applicant_id, a.company_key, a.company_start AS one, b.company_start AS other
  FROM runs a JOIN runs b USING (applicant_id, company_key, title_key, title_start) WHERE a.company_start <> b.company_start),
reached AS (SELECT DISTINCT applicant_id, company_key, company_start, company_start AS seen FROM runs
  UNION SELECT r.applicant_id, r.company_key, r.company_start, b.other FROM reached r JOIN bridges b
    ON b.applicant_id = r.applicant_id AND b.company_key = r.company_key AND b.one = r.seen)
SELECT applicant_id, company_key, company_start, min(seen) AS role_start FROM reached GROUP BY ALL""",
    "v_resolved": """
WITH dated AS (SELECT applicant_id, company_key, title_key, mention_id, role_start
  FROM v_role_runs JOIN v_role_starts USING (applicant_id, company_key, company_start)),
newest AS (SELECT applicant_id, company_key, title_key, max(role_start) AS role_start FROM dated GROUP BY ALL)
SELECT applicant_id, mention_id, concat(company_key, '|', coalesce(CAST(role_start AS VARCHAR), concat('undated ', title_key))) AS role_ref
FROM (SELECT * FROM dated UNION ALL BY NAME
  SELECT applicant_id, company_key, title_key, mention_id, role_start FROM v_role_keys
  LEFT JOIN newest USING (applicant_id, company_key, title_key) WHERE start_m IS NULL) t""",
    "v_mention_bullets": """
SELECT mention_id, CASE version WHEN 2 THEN concat(text, ' on time') ELSE text END AS text
FROM v_bullets JOIN v_role_mentions USING (role_id) WHERE (bullet_no + version) % 3 < 2""",
    "v_versions": f"""
SELECT role_id, version, text FROM (SELECT *, row_number() OVER (PARTITION BY role_id, version
    ORDER BY length(text) DESC, text) AS n
  FROM (SELECT role_id, text, {normalised('text')} AS version FROM v_bullets) a) b
WHERE n = 1""",
    "v_merged": """
SELECT role_id, version, text FROM v_versions m WHERE NOT EXISTS (
  SELECT 1 FROM v_versions o WHERE o.role_id = m.role_id AND starts_with(o.version, concat(m.version, ' ')))""",
    "v_profile_rows": """
SELECT applicant_id, 'fact' AS section, '' AS ref, field AS item FROM v_latest
UNION ALL SELECT DISTINCT applicant_id, 'name', '', c_name FROM v_resumes
UNION ALL SELECT applicant_id, 'skill', '', skill FROM v_skills
UNION ALL SELECT applicant_id, 'role', CAST(role_id AS VARCHAR),
  concat(title, ' | ', company, CASE WHEN location = '' THEN '' ELSE ' | ' END, location, ' | ', start_date, ' | ', end_date)
  FROM v_resumes
UNION ALL SELECT applicant_id, 'bullet', CAST(role_id AS VARCHAR), text
  FROM v_merged JOIN (SELECT applicant_id, role_id FROM v_resumes) r USING (role_id)""",
    "v_degrees": "SELECT DISTINCT applicant_id, degree, school, graduation_year FROM v_resumes",
    "v_text_pages": r"""
SELECT page_id, url, body, status, regexp_replace(trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
      '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
      '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<nav[^>]*>.*?</nav>', ' ', 'g'),
      '(?s)<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
  '\s+', ' ', 'g')), '"""
    + EDGE
    + """', '', 'g') AS text FROM v_fetched""",
}

_ESCAPED = r"""CASE WHEN regexp_matches(c, '[^\x21-\x7E]|["<>`{}^]') THEN url_encode(c) ELSE c END"""


def url_key(url: str) -> str:
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]*)?(/[^?#]*)?"
    host = f"lower(regexp_extract({url}, '{pattern}', 1))"
    path = f"regexp_extract({url}, '{pattern}', 2)"
    escaped = f"array_to_string(list_transform(string_split({path}, ''), lambda c: {_ESCAPED}), '')"
    place = f"regexp_replace(regexp_replace(concat({host}, {escaped}), '^www\\.', ''), '/$', '')"
    return (
        f"substring(regexp_replace(regexp_replace({place}, '[^a-zA-Z0-9]+', '_', 'g'), "
        "'^_|_$', '', 'g'), 1, 80)"
    )


def slug(text: str) -> str:
    made = f"regexp_replace(regexp_replace(lower({text}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
    return f"coalesce(nullif({made}, ''), 'unnamed')"


def used(lexicon: list[str], text: str, word: str = "word") -> str:
    return has_phrase(text, word)


LETTER_KEYS = "application_id, turn"
CHANCES = " ".join(
    f"WHEN '{w}' THEN bool_or("
    + " OR ".join(has_phrase("text", quoted(h)) for h in hints)
    + ")"
    for w, hints in HINTS.items()
)


def absent(lexicon: list[str], chances: str = "") -> str:
    chance = f"CASE word {chances} ELSE true END" if chances else "true"
    return f"""
SELECT author_id, word FROM v_samples, {values('word', lexicon)} w
GROUP BY author_id, word HAVING NOT bool_or({has_phrase('text', 'word')}) AND {chance}"""


def banned(phrases: list[str], at: int) -> str:
    return f"""
SELECT {LETTER_KEYS}, phrase FROM v_letters, {values('phrase', phrases)} p
WHERE contains(lower(coalesce(({paragraphs('text', NEWLINES)})[{at}], '')), lower(phrase))"""


NEWLINES = r"\n\s*\n"
FORBIDDEN = [*LEXICON, "der die", "de la"]
SENTENCE_SUMS = f"""
SELECT author_id, count(*) AS n, sum(w) AS words, sum(w * w) AS squares,
  count(*) FILTER (w <= 8) AS short, count(*) FILTER (w >= 20) AS long, count(*) FILTER (semicolon) AS semicolons
FROM (SELECT author_id, {words('s')} AS w, contains(s, ';') AS semicolon
      FROM (SELECT author_id, unnest({sentences('text')}) AS s FROM %s) a) b GROUP BY author_id"""
SPREAD = """round(sqrt(greatest(CAST(squares AS DOUBLE) / n
    - (CAST(words AS DOUBLE) / n) * (CAST(words AS DOUBLE) / n), 0)), 6) AS sd_words"""


def habits(source: str, separator: str) -> str:
    return f"""
SELECT author_id, count(*) AS n_docs, sum({count('text', '!')}) AS exclamations,
  sum({count('text', '[—–]| - ')}) AS dashes, sum({count('text', '[(]')}) AS brackets,
  sum({count('text', BULLET)}) AS bullets, CAST(sum(len({paragraphs('text', separator)})) AS BIGINT) AS n_paragraphs,
  sum(len({sentences('text')})) AS sentences FROM {source} GROUP BY author_id"""


def openings(source: str) -> str:
    return f"""
SELECT author_id, phrase, count(*) AS n_docs FROM (
  SELECT author_id, unnest(list_distinct(list_transform({sentences('text')},
    lambda s: array_to_string(({tokens('s')})[1:2], ' ')))) AS phrase FROM {source}) t
WHERE contains(phrase, ' ') GROUP BY author_id, phrase"""


def most_common(source: str, value: str, name: str) -> str:
    return f"""
SELECT author_id, {name}, support FROM (SELECT author_id, {name}, count(*) AS support,
    row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, {name}) AS n
  FROM (SELECT author_id, {value} AS {name} FROM {source}) a GROUP BY author_id, {name}) b WHERE n = 1"""


OPENER = f"array_to_string(({tokens('text')})[1:2], ' ')"
SIGN_OFF = strip(f"(string_split({strip('text')}, chr(10)))[-1]")
ONCE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY author_id, text ORDER BY doc_id) AS copy
  FROM v_samples WHERE kind = 'cover_letter') a WHERE copy = 1)"""

_CUSTOMER_ERRORS = """
SELECT c_custkey AS applicant_id, '$.email' AS path, 'missing' AS problem, 'string' AS expected, 'undefined' AS found
FROM customer WHERE c_custkey % 10 = 1
UNION ALL SELECT c_custkey, '$.experience[0].company', 'missing', 'string', 'undefined' FROM customer WHERE c_custkey % 10 = 2
UNION ALL SELECT c_custkey, '$.skills[0]', 'wrong type', 'string', 'number' FROM customer WHERE c_custkey % 10 = 4
UNION ALL SELECT c_custkey, '$.skills', 'wrong type', 'array', 'string' FROM customer WHERE c_custkey % 10 = 5
UNION ALL SELECT c_custkey, '$', 'not JSON', 'object', 'text' FROM customer WHERE c_custkey % 10 = 6
UNION ALL SELECT c_custkey, '$.linkedin', 'wrong type', 'string', 'null' FROM customer WHERE c_custkey % 10 = 7"""

_REPORT = f"""
SELECT {LETTER_KEYS}, 'length' AS rule, CAST({words('text')} AS VARCHAR) AS detail FROM v_letters
WHERE NOT {words('text')} BETWEEN 280 AND 350
UNION ALL SELECT {LETTER_KEYS}, 'opening', phrase FROM ({banned(BANNED_OPENINGS, 2)})
UNION ALL SELECT {LETTER_KEYS}, 'closing', phrase FROM ({banned(BANNED_CLOSINGS, -2)})
UNION ALL SELECT {LETTER_KEYS}, 'bullets', CAST({count('text', BULLET)} AS VARCHAR) FROM v_letters
  WHERE {count('text', BULLET)} > 0
UNION ALL SELECT {LETTER_KEYS}, 'structure', CAST(greatest(len({paragraphs('text', NEWLINES)}) - 2, 0) AS VARCHAR)
  FROM v_letters WHERE NOT greatest(len({paragraphs('text', NEWLINES)}) - 2, 0) BETWEEN 4 AND 5
UNION ALL SELECT {LETTER_KEYS}, 'company', '' FROM v_letters WHERE application_id % 6 <> 0
UNION ALL SELECT {LETTER_KEYS}, 'sign-off', '' FROM v_letters
  WHERE application_id % 7 = 0 OR (CASE WHEN application_id % 8 = 0 THEN 'Yours,' ELSE 'Best regards,' END)
    <> (CASE WHEN applicant_id % 16 = 0 THEN 'Yours,' ELSE 'Best regards,' END)
UNION ALL SELECT {LETTER_KEYS}, 'forbidden', phrase FROM v_letters, {values('phrase', FILLER_WORDS + LEXICON[:4])} p
  WHERE {has_phrase('text', 'phrase')}
UNION ALL SELECT DISTINCT {LETTER_KEYS}, 'numbers', number
  FROM (SELECT *, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS number FROM v_letters) l
  JOIN customer ON c_custkey = applicant_id WHERE number <> regexp_extract(c_name, '[0-9]+')"""

CHOICES = " UNION ALL ".join(
    f"""
SELECT author_id, '{a}' AS word_a, '{b}' AS word_b, n_a, n_b,
  CASE WHEN n_a > n_b THEN '{a}' WHEN n_b > n_a THEN '{b}' ELSE '' END AS preferred
FROM (SELECT author_id, CAST(sum(len(list_filter(t, lambda w: w = '{a}'))) AS BIGINT) AS n_a,
        CAST(sum(len(list_filter(t, lambda w: w = '{b}'))) AS BIGINT) AS n_b
      FROM (SELECT author_id, {tokens('text')} AS t FROM v_samples) x GROUP BY author_id) y"""
    for a, b in WORD_PAIRS
)

SQL = {
    "read_samples": """
SELECT doc_id, 'cover_letter' AS kind, length(text) + 1 AS n_chars,
  sha256(concat(text, chr(10))) AS text_hash FROM v_samples""",
    "read_postings": "SELECT job_id, s_name AS company_name, 8 AS n_required FROM v_jobs",
    "read_profiles": """
SELECT c_custkey AS applicant_id, ok AS is_valid,
  CASE WHEN ok THEN concat('c', c_custkey, '@example.com') ELSE '' END AS email,
  CASE WHEN ok THEN c_mktsegment ELSE '' END AS last_skill,
  CASE WHEN ok THEN CAST(1990 + c_custkey % 20 AS DOUBLE) ELSE 0.0 END AS graduation_year,
  CASE WHEN ok THEN 0 ELSE 1 END AS n_violations
FROM (SELECT *, c_custkey % 10 IN (0, 3, 8, 9) AS ok FROM customer) t""",
    "read_templates": """
SELECT job_id, concat('{{NAME}} for ', s_name, ' {{SKILLS}}', chr(10)) AS text, 'NAME, SKILLS' AS keys FROM v_jobs""",
    "read_style_cache": """
SELECT author_id, count(*) FILTER (kind = 'resume') AS n_resumes,
  count(*) FILTER (kind = 'cover_letter') AS n_cover_letters FROM v_samples GROUP BY author_id""",
    "load_fetched": "SELECT page_id, url, status, length(body) AS n_chars FROM v_fetched",
    "write_state": """
SELECT user_id AS applicant_id, event_type AS field, CASE WHEN event_type = 'click' THEN newest ELSE first END AS event_id
FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) a
JOIN (SELECT applicant_id AS user_id, field AS event_type, event_id AS newest FROM v_latest) b USING (user_id, event_type)""",
    "update_store": """
SELECT user_id AS applicant_id, event_type AS field,
  CASE WHEN event_type = 'click' OR user_id = 7 THEN newest ELSE first END AS event_id
FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type) a
JOIN (SELECT applicant_id AS user_id, field AS event_type, event_id AS newest FROM v_latest) b USING (user_id, event_type)""",
    "read_store_version": """
SELECT user_id AS applicant_id, event_type AS field, min(event_id) AS event_id FROM events GROUP BY user_id, event_type""",
    "write_profile": """
SELECT c_custkey AS applicant_id, c_name AS name, true AS same FROM customer WHERE c_custkey % 10 IN (0, 3, 8, 9)""",
    "write_outputs": f"""
SELECT {LETTER_KEYS}, concat('company_', job_id, '_planner') AS job_slug,
  CASE WHEN job_id % 2 = 0 THEN 2 ELSE 1 END AS version FROM v_letters""",
    "write_posting_cache": f"""
SELECT url_key, page_id, n_chars FROM (
  SELECT {url_key('url')} AS url_key, page_id, length(text) AS n_chars,
    row_number() OVER (PARTITION BY url ORDER BY page_id) AS n
  FROM v_text_pages WHERE status = 200 AND length({strip('body')}) >= 50) t WHERE n = 1""",
    "to_pretty_json": """
SELECT job_id, rnk, concat('{', chr(10), '  "job_id" : ', job_id, ',', chr(10), '  "skill" : "', skill, '",', chr(10),
  '  "level" : "', level, '"', chr(10), '}') AS json FROM v_requirements""",
    "visible_only": "SELECT doc_id, file_name FROM v_sample_files WHERE doc_id % 13 <> 0",
    "route_sources": """
SELECT page_id, source, CASE WHEN starts_with(source, 'http://') OR starts_with(source, 'https://') THEN 'url' ELSE 'file' END AS route
FROM v_requests""",
    "accept_pages": f"""
SELECT page_id, status, CASE WHEN status <> 200 THEN 'HTTP 404'
  WHEN length({strip('body')}) < 50 THEN 'too short or empty' ELSE '' END AS reject_reason FROM v_fetched""",
    "page_text": "SELECT page_id, text FROM (%s) t" % VIEWS["v_text_pages"].replace(
        "v_fetched", "(SELECT page_id, url, html AS body, 200 AS status FROM pages) p"
    ),
    "url_key": f"""
SELECT *, concat(url_key, '.md') AS file_name
FROM (SELECT page_id, {url_key('source')} AS url_key FROM v_requests WHERE page_id % 7 <> 0) t""",
    "job_slug": f"""
SELECT doc_id, {slug("concat(author_id, '_', regexp_extract(text, '^([^' || chr(10) || ']*)', 1))")} AS job_slug
FROM v_samples""",
    "validate_profiles": _CUSTOMER_ERRORS,
    "keep_declared_fields": """
SELECT c_custkey AS applicant_id, CASE WHEN c_custkey % 10 = 6 THEN '' ELSE c_name END AS name, true AS declared_only
FROM customer""",
    "dry_run_report": """
SELECT applicant_id, n_resumes, n_cover_letters, reason = '' AS ready, reason,
  NOT has_profile AND n_resumes > 0 AS will_extract
FROM (SELECT *, CASE WHEN applicant_id % 9 = 0 THEN 'job posting not found'
        WHEN NOT has_profile AND n_resumes = 0 THEN 'no profile and no resumes'
        WHEN has_profile AND applicant_id % 10 NOT IN (0, 3, 8, 9) THEN 'invalid profile' ELSE '' END AS reason
  FROM (SELECT c_custkey AS applicant_id, c_custkey % 2 = 0 AS has_profile,
          coalesce(r, 0) AS n_resumes, coalesce(l, 0) AS n_cover_letters
        FROM customer LEFT JOIN (SELECT doc_id - doc_id % 3 AS owner, count(*) FILTER (kind = 'resume') AS r,
            count(*) FILTER (kind = 'cover_letter') AS l FROM v_samples GROUP BY 1) s ON owner = c_custkey) a) b""",
    "key_collisions": f"""
SELECT key, count(DISTINCT doc_id) AS n_sources
FROM (SELECT doc_id, {slug("concat(author_id, '_', regexp_extract(text, '^([^ ]*)', 1))")} AS key FROM v_samples) t
GROUP BY key HAVING count(DISTINCT doc_id) > 1""",
    "assemble": """
SELECT applicant_id, job_id, s_name AS company_name, c_name AS name,
  CASE WHEN applicant_id % 4 > 0 THEN concat('style ', applicant_id) ELSE '' END AS style
FROM v_applications JOIN supplier ON s_suppkey = job_id JOIN customer ON c_custkey = applicant_id""",
    "style_or_default": f"""
SELECT DISTINCT source AS author_id, '{DEFAULT_VOICE['tone']}' AS tone, '{', '.join(DEFAULT_SECTIONS)}' AS sections,
  source >= 'src2' AS is_default FROM documents""",
    "split_cached": """
SELECT source AS author_id, CASE WHEN source < 'src2' THEN 'reuse' ELSE 'measure' END AS action, count(*) AS n_docs
FROM documents GROUP BY source""",
    "skill_match": "SELECT applicant_id, job_id, skill, level FROM v_match",
    "skill_gap": "SELECT applicant_id, job_id, skill FROM v_gap",
    "coverage": """
SELECT applicant_id, job_id, count(*) AS n_required, count(s.skill) AS n_matched,
  count(*) - count(s.skill) AS n_missing, round(CAST(count(s.skill) AS DOUBLE) / count(*), 6) AS coverage
FROM v_applications JOIN v_requirements USING (job_id) LEFT JOIN v_skills s USING (applicant_id, skill)
WHERE level = 'required' GROUP BY applicant_id, job_id""",
    "transferable": "SELECT * FROM v_mitigated",
    "transferable_by_cover": f"""
WITH vocabulary AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 1) AS head, split_part(p_name, ' ', 2) AS noun FROM part),
covers AS (SELECT a.p_name AS skill, b.p_name AS covers FROM vocabulary a JOIN vocabulary b
  ON (a.noun = b.noun AND a.p_name < b.p_name) OR (a.head = b.head AND a.noun < b.noun))
SELECT g.applicant_id, g.job_id, g.skill AS missing_skill, count(s.skill) AS n_via,
  CASE WHEN count(s.skill) = 0 THEN '{NO_REFRAME}' ELSE concat('transferable from ', min(s.skill), ', covers ', g.skill) END AS mitigation
FROM v_gap g LEFT JOIN covers c ON c.covers = g.skill LEFT JOIN v_skills s ON s.applicant_id = g.applicant_id AND s.skill = c.skill
GROUP BY g.applicant_id, g.job_id, g.skill""",
    "absent_words": absent(LEXICON, CHANCES),
    "forbidden_hits": f"""
SELECT {LETTER_KEYS}, phrase, n FROM (
  SELECT {LETTER_KEYS}, phrase, CASE WHEN contains(phrase, ' ')
    THEN len(list_filter(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1]) = phrase))
    ELSE len(list_filter(t, lambda w: w = phrase)) END AS n
  FROM (SELECT {LETTER_KEYS}, {tokens('text')} AS t FROM v_outputs) o, {values('phrase', FORBIDDEN)} p) c WHERE n > 0""",
    "phrase_hits": f"""
WITH phrases AS (SELECT phrase, {normalised('phrase')} AS run, len({tokens('phrase')}) AS n_words FROM (
    SELECT DISTINCT array_to_string(regexp_split_to_array(trim(text, ' '), '\\s+')[1:CASE WHEN doc_id % 50 = 0 THEN 12
      ELSE doc_id % 3 + 1 END], ' ') AS phrase FROM documents) p),
words AS (SELECT doc_id, {tokens('text')} AS w FROM documents),
runs AS (SELECT doc_id, n_words, array_to_string(w[s : s + n_words - 1], ' ') AS run FROM (
    SELECT doc_id, n_words, w, unnest(range(1, len(w) - n_words + 2)) AS s
    FROM words, (SELECT DISTINCT n_words FROM phrases WHERE n_words > 0) z) a)
SELECT doc_id, phrase, count(*) AS n FROM runs JOIN phrases USING (n_words, run) GROUP BY doc_id, phrase""",
    "forbidden_by_author": f"""
SELECT {LETTER_KEYS}, author_id, phrase, count(*) AS n
FROM (SELECT {LETTER_KEYS}, concat('src', application_id % 20) AS author_id, unnest({tokens('text')}) AS phrase
      FROM v_outputs) o
JOIN (SELECT author_id, CASE WHEN preferred = word_a THEN word_b ELSE word_a END AS phrase
      FROM ({CHOICES}) c WHERE preferred <> '') f USING (author_id, phrase)
GROUP BY {LETTER_KEYS}, author_id, phrase""",
    "untraceable_numbers": """
WITH known AS (SELECT DISTINCT role_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) AS number FROM v_bullets)
SELECT role_id, bullet_no, number
FROM (SELECT role_id, bullet_no, unnest(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'))) AS number
      FROM v_outputs_num) o
WHERE NOT EXISTS (SELECT 1 FROM known WHERE known.role_id = o.role_id AND known.number = o.number)""",
    "untraceable_entities": """
SELECT * FROM v_claims c
WHERE NOT EXISTS (SELECT 1 FROM v_skills s WHERE s.applicant_id = c.applicant_id AND s.skill = c.value)""",
    "link_bullets": "SELECT * FROM v_links",
    "input_inventory": """
SELECT author_id, count(*) FILTER (kind = 'resume') AS n_resumes,
  count(*) FILTER (kind = 'cover_letter') AS n_cover_letters FROM v_samples GROUP BY author_id""",
    "concat_samples": """
SELECT author_id, part_no, count(*) AS n_docs, length(string_agg(entry, chr(10) || chr(10) ORDER BY doc_id)) AS n_chars,
  sha256(string_agg(entry, chr(10) || chr(10) ORDER BY doc_id)) AS text_hash
FROM (SELECT *, CAST(coalesce(sum(length(entry)) OVER (PARTITION BY author_id ORDER BY doc_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 50000 AS part_no
  FROM (SELECT author_id, doc_id, concat('--- Sample: ', file_name, ' ---', chr(10), text) AS entry
        FROM v_sample_files WHERE doc_id % 13 <> 0) a) b
GROUP BY author_id, part_no""",
    "sentence_profile": f"""
SELECT author_id, n AS n_sentences, round(CAST(words AS DOUBLE) / n, 6) AS mean_words, {SPREAD},
  round(short / n, 6) AS short_share, round(long / n, 6) AS long_share, round(semicolons / n, 6) AS semicolon_share
FROM ({SENTENCE_SUMS % 'v_samples'}) s""",
    "formatting_habits": f"""
SELECT author_id, n_docs, exclamations = 0 AS never_exclaims, dashes > brackets AS prefers_dashes,
  bullets = 0 AS never_bullets, n_paragraphs,
  round(CAST(sentences AS DOUBLE) / greatest(n_paragraphs, 1), 6) AS sentences_per_paragraph
FROM ({habits('v_samples', chr(92) + 'n')}) h""",
    "usual_opener": most_common("v_samples", OPENER, "opener"),
    "usual_sign_off": most_common("v_samples", SIGN_OFF, "sign_off"),
    "recurring_patterns": f"""
SELECT author_id, CASE WHEN n_docs >= 2 THEN 'reliable' ELSE 'weak' END AS signal, n_docs, count(*) AS n_phrases,
  min(phrase) AS first_phrase, max(phrase) AS last_phrase
FROM (SELECT author_id, phrase, count(*) AS n_docs FROM (
    SELECT author_id, unnest(list_distinct(list_transform(range(1, len(t) - 1),
      lambda i: concat(t[i], ' ', t[i + 1], ' ', t[i + 2])))) AS phrase
    FROM (SELECT author_id, {tokens('text')} AS t FROM v_samples) a) b GROUP BY author_id, phrase) c
GROUP BY author_id, n_docs""",
    "majority_value": most_common(
        "(SELECT source AS author_id, lang AS l FROM documents)", "l", "lang"
    ),
    "word_choice": CHOICES,
    "distinct_skills": "SELECT * FROM v_skills",
    "merge_bullets": "SELECT * FROM v_merged",
    "resolve_roles": "SELECT * FROM v_resolved",
    "merge_roles": f"""
WITH told AS (SELECT * FROM v_role_mentions JOIN v_resolved USING (applicant_id, mention_id)),
versions AS (SELECT DISTINCT applicant_id, role_ref, {normalised('text')} AS version, text
  FROM v_mention_bullets JOIN v_resolved USING (mention_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY applicant_id, role_ref, version ORDER BY length(text) DESC, text) AS n
  FROM versions) v WHERE n = 1),
kept AS (SELECT * FROM once o WHERE NOT EXISTS (SELECT 1 FROM once l WHERE l.applicant_id = o.applicant_id
  AND l.role_ref = o.role_ref AND starts_with(l.version, concat(o.version, ' ')))),
counts AS (SELECT applicant_id, role_ref, count(*) AS n_bullets, max(text) AS last_bullet FROM kept GROUP BY ALL),
merged AS (SELECT applicant_id, role_ref, count(*) AS n_mentions,
    max_by(title, version * 1000000000000 + mention_id) AS title, max_by(company, version * 1000000000000 + mention_id) AS company,
    coalesce(max_by(location, version * 1000000000000 + mention_id) FILTER (location <> ''), '') AS location
  FROM told GROUP BY ALL),
dated AS (SELECT applicant_id, role_ref, start_m, coalesce(end_m, 0) AS end_m FROM (SELECT *, row_number() OVER (
    PARTITION BY applicant_id, role_ref ORDER BY version DESC, mention_id DESC) AS n FROM told WHERE start_m IS NOT NULL) t WHERE n = 1)
SELECT applicant_id, role_ref, n_mentions, title, company, location, coalesce(start_m, 0) AS start_m, coalesce(end_m, 0) AS end_m,
  coalesce(n_bullets, 0) AS n_bullets, coalesce(last_bullet, '') AS last_bullet
FROM merged LEFT JOIN dated USING (applicant_id, role_ref) LEFT JOIN counts USING (applicant_id, role_ref)""",
    "metric_habits": """
SELECT role_id, count(*) AS n_bullets,
  round(count(*) FILTER (regexp_matches(text, '[0-9]')) / count(*), 6) AS with_number,
  round(count(*) FILTER (regexp_matches(text, '^[^A-Za-z0-9]*[0-9]')) / count(*), 6) AS leads_with_number,
  round(count(*) FILTER (regexp_matches(text, '[0-9] ?%')) / count(*), 6) AS with_percentage,
  round(count(*) FILTER (regexp_matches(text, '[0-9] ?[-–] ?[0-9]')) / count(*), 6) AS with_range
FROM v_bullets GROUP BY role_id""",
    "density": """
SELECT applicant_id, count(*) AS n_roles, round(CAST(sum(coalesce(n, 0)) AS DOUBLE) / count(*), 6) AS bullets_per_role,
  round(CAST(sum(coalesce(chars, 0)) AS DOUBLE) / greatest(sum(coalesce(n, 0)), 1), 6) AS chars_per_bullet,
  min(start_m) AS oldest_start_m
FROM v_roles LEFT JOIN (SELECT role_id, count(*) AS n, sum(length(text)) AS chars FROM v_bullets GROUP BY role_id) b
  USING (role_id) GROUP BY applicant_id""",
    "section_order": f"""
SELECT author_id, sections, false AS is_default FROM (
  SELECT author_id, sections, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, sections) AS n
  FROM (SELECT CAST(s_suppkey // 5 AS VARCHAR) AS author_id,
          concat(CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '{SECTIONS[0]}, ' END,
            CASE WHEN s_suppkey % 2 = 0 THEN '{SECTIONS[1]}, ' ELSE '' END, '{', '.join(SECTIONS[2:])}') AS sections
        FROM supplier JOIN (SELECT DISTINCT job_id FROM v_requirements) r ON job_id = s_suppkey) a
  GROUP BY author_id, sections) b WHERE n = 1""",
    "page_budget": f"""
WITH spans AS (SELECT applicant_id, start_m, CASE WHEN is_current THEN greatest(end_m, {AS_OF_M}) ELSE end_m END AS end_m
  FROM v_roles),
islands AS (SELECT *, max(end_m) OVER (PARTITION BY applicant_id ORDER BY start_m, end_m
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
held AS (SELECT applicant_id, CAST(sum(greatest(0, end_m - greatest(start_m, coalesce(reached, start_m)))) AS BIGINT) AS n_months
  FROM islands GROUP BY applicant_id)
SELECT applicant_id, n_months, CASE WHEN n_months < 84 THEN 1 ELSE 2 END AS max_pages FROM held""",
    "ats_coverage": f"""
SELECT {LETTER_KEYS}, count(*) AS n_terms, count(*) FILTER (contains(lower(text), lower(skill))) AS n_found,
  round(count(*) FILTER (contains(lower(text), lower(skill))) / count(*), 6) AS share
FROM v_letters JOIN v_requirements USING (job_id) WHERE level = 'required' GROUP BY {LETTER_KEYS}""",
    "culture_repeats": f"""
SELECT job_id, term, CASE term WHEN 'ownership' THEN 2 ELSE 1 END AS n_sections,
  CASE term WHEN 'ownership' THEN 2 ELSE 1 END AS n_mentions
FROM v_jobs, {values('term', VALUE_WORDS)} t WHERE term <> 'autonomy'""",
    "latest_wins": "SELECT applicant_id, field, value, event_id FROM v_latest",
    "top_roles": "SELECT applicant_id, job_id, role_rank, role_id, score, reason, below_minimum FROM v_top_roles",
    "top_bullets": "SELECT role_id, bullet_rank, bullet_no, text FROM v_top_bullets",
    "top_transitions": f"""
SELECT *, count(*) OVER (PARTITION BY author_id) >= 3 AS enough FROM (
  SELECT author_id, phrase, n_docs, row_number() OVER (PARTITION BY author_id ORDER BY n_docs DESC, phrase) AS position
  FROM ({openings('v_samples')}) o) t WHERE position <= 8""",
    "hook_pairs": "SELECT applicant_id, job_id, hook_rank, posting_detail, applicant_detail FROM v_hooks",
    "sentence_variation": f"""
SELECT {LETTER_KEYS}, len(l) AS n_sentences, CASE WHEN len(l) > 1 THEN
    round(CAST(list_sum(list_transform(range(2, len(l) + 1), lambda i: abs(l[i] - l[i - 1]))) AS DOUBLE) / (len(l) - 1), 6)
  ELSE 0.0 END AS mean_change
FROM (SELECT {LETTER_KEYS}, list_transform({sentences('text')}, lambda s: {words('s')}) AS l FROM v_outputs) t""",
    "requirement_rank": """
SELECT job_id, 1 AS position, concat('Take ownership of ', top1) AS responsibility FROM v_jobs
UNION ALL SELECT job_id, 2, concat('Maintain ', top2) FROM v_jobs""",
    "order_sections": """
SELECT job_id, section, CASE section WHEN 'Required' THEN 1 WHEN 'Preferred' THEN 2 WHEN 'Responsibilities' THEN 3 ELSE 4 END AS position
FROM v_jobs, (SELECT unnest(['Title', 'Company', 'Location', 'Salary', 'Hiring manager', 'About', 'Responsibilities', 'Required', 'Preferred']) AS section) s
WHERE NOT (section = 'Salary' AND job_id % 5 = 0) AND NOT (section = 'Hiring manager' AND job_id % 2 = 1)""",
    "preferred_only": "SELECT job_id, skill FROM v_requirements WHERE level = 'preferred'",
    "skills_to_list": "SELECT DISTINCT applicant_id, job_id, skill FROM v_match",
    "all_postings": f"""
SELECT url_key, origin, page_id, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY origin, page_id) AS n FROM (
    SELECT url, {url_key('url')} AS url_key, 'url' AS origin, page_id, length(text) AS n_chars
    FROM v_text_pages WHERE status = 200 AND length({strip('body')}) >= 50
    UNION ALL SELECT url, {url_key('url')}, 'file', page_id, length(html) FROM pages WHERE page_id % 5 = 0) a) b
WHERE n = 1""",
    "dedup_documents": """
SELECT author_id, min(doc_id) AS doc_id, sha256(text) AS text_hash FROM v_samples GROUP BY author_id, text""",
    "posting_header": f"""
SELECT job_id, title AS job_title, s_name AS company_name,
  concat('we value ownership. Asks for ', years, '+ years.') AS company_description, location,
  '{NOT_SPECIFIED}' AS team_or_department FROM v_jobs""",
    "read_lines": "SELECT job_id, no, kind, name, value, section FROM v_parsed",
    "unread_lines": """
SELECT job_id, no, value FROM v_parsed WHERE NOT (kind IN ('heading', 'label') OR (kind = 'item' AND section <> 'other')
  OR section = 'about' OR (job_id % 4 = 0 AND place <= 2) OR (job_id % 4 = 1 AND (place = 1 OR contains(value, '€'))))""",
    "posting_facts": """
SELECT job_id, coalesce(max(value) FILTER (name = 'title'),
    max(split_part(value, ' at ', 1)) FILTER (place = 1)) AS job_title,
  coalesce(max(value) FILTER (name = 'company'), max(split_part(value, ' at ', 2)) FILTER (place = 1 AND contains(value, ' at ')),
    max(split_part(value, ' - ', 1)) FILTER (place = 2)) AS company_name,
  coalesce(max(value) FILTER (name = 'location'), max(split_part(value, ' - ', 2)) FILTER (place = 2 AND kind = 'text'), '') AS location,
  coalesce(max(value) FILTER (name = 'salary'), max(value) FILTER (contains(value, '€')), '') AS pay,
  coalesce(max(value) FILTER (section = 'about' AND kind = 'text'), '') AS about,
  coalesce(string_agg(value, '|' ORDER BY no) FILTER (section = 'responsibility' AND kind = 'item'), '') AS responsibilities,
  string_agg(value, '|' ORDER BY no) FILTER (section = 'required' AND kind = 'item') AS required,
  coalesce(string_agg(value, '|' ORDER BY no) FILTER (section = 'preferred' AND kind = 'item' AND NOT again), '') AS preferred
FROM (SELECT *, count(*) FILTER (section = 'required' AND kind = 'item') OVER (PARTITION BY job_id, value) > 0 AS again FROM v_parsed) p
GROUP BY job_id""",
    "remote_policy": "SELECT job_id, policy AS remote_policy FROM v_jobs",
    "salary_range": """
SELECT job_id, pay AS salary_range, CASE WHEN job_id % 5 = 0 THEN NULL ELSE CAST(50000 + job_id * 10 AS DOUBLE) END AS salary_low,
  CASE WHEN job_id % 5 = 0 THEN NULL ELSE CAST(70000 + job_id * 10 AS DOUBLE) END AS salary_high,
  CASE WHEN job_id % 5 = 0 THEN '' ELSE 'USD' END AS currency FROM v_jobs""",
    "section_items": """
SELECT job_id, level AS kind, CASE WHEN level = 'required' THEN rnk ELSE rnk - 8 END AS position, skill AS item FROM v_requirements
UNION ALL SELECT job_id, 'responsibility', 1, concat('Take ownership of ', top1) FROM v_jobs
UNION ALL SELECT job_id, 'responsibility', 2, concat('Maintain ', top2) FROM v_jobs""",
    "seniority": """
SELECT job_id, CASE WHEN is_senior OR years >= 6 THEN 'Senior' WHEN years >= 3 THEN 'Mid-level' ELSE 'Junior' END AS level,
  concat(CASE WHEN is_senior THEN 'title includes Senior; ' ELSE '' END, 'asks for ', years, '+ years') AS signals FROM v_jobs""",
    "contacts": rf"""
SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AS email,
  {strip("coalesce([p for p in regexp_extract_all(text, '[+]?[0-9][0-9 ().-]{7,}[0-9]') if length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT regexp_matches(p, '^[(]?(?:19|20)[0-9]{2}[ ().-]+(?:19|20)[0-9]{2}$')][1], '')")} AS phone,
  regexp_extract(text, '(?:https?://)?(?:www\.)?linkedin\.com/[A-Za-z0-9_/-]+') AS linkedin FROM v_samples""",
    "skill_mentions": """
SELECT DISTINCT role_id, bullet_no, p_name AS skill FROM v_bullets b JOIN (SELECT DISTINCT p_name FROM part) p
  ON contains(concat(' ', lower(b.text), ' '), concat(' ', p_name, ' '))""",
    "education_rows": "SELECT role_id, degree, school, graduation_year, year_is_whole FROM v_resumes",
    "role_rows": """
SELECT role_id, c_name AS name, title, company, location, start, end_text AS "end" FROM v_resumes""",
    "resume_rows": """
WITH told AS (SELECT role_id, lines[1] AS name, regexp_replace(lines[2], '^[^ ]+ ', '') AS role,
    regexp_replace(lines[3], '^[^ ]+ ', '') AS study, substr(lines[4], 3) AS unread
  FROM (SELECT role_id, string_split(text, chr(10)) AS lines FROM v_styled_resumes) l),
split AS (SELECT *, CASE WHEN contains(role, ' · ') THEN string_split(role, ' · ')
    WHEN contains(role, ' at ') THEN [split_part(role, ' at ', 1), split_part(split_part(role, ' at ', 2), ' (', 1),
      rtrim(split_part(role, '(', 2), ')')] ELSE string_split(role, ', ') END AS parts FROM told)
SELECT role_id, name, parts[1] AS title, parts[2] AS company, CASE WHEN len(parts) = 4 THEN parts[3] ELSE '' END AS location,
  split_part(parts[-1], ' ', 1) AS start, regexp_extract(parts[-1], '([^ ]*)$', 1) AS "end",
  split_part(study, ', ', 1) AS degree, regexp_replace(split_part(study, ', ', 2), ' [(].*$', '') AS school,
  CAST(regexp_extract(study, '([0-9]{4})[)]?$', 1) AS INT) AS graduation_year, unread
FROM split""",
    "role_dates": """
SELECT role_id, start_date, end_date, end_date = 'present' AS is_current, concat(start_date, '-01') AS start_day FROM v_resumes""",
    "salutation": """
SELECT job_id, CASE WHEN job_id % 2 = 0 THEN concat('Dear Manager ', job_id, ',') ELSE 'Dear Hiring Manager,' END AS greeting FROM v_jobs""",
    "group_skills": """
SELECT applicant_id, skill, CASE WHEN count(*) OVER (PARTITION BY applicant_id) > 8 THEN category ELSE '' END AS category
FROM v_skills JOIN (SELECT p_name AS skill, min(p_type) AS category FROM part GROUP BY p_name) c USING (skill)""",
    "length_check": f"""
SELECT {LETTER_KEYS}, {words('text')} AS n_words, {words('text')} BETWEEN 280 AND 350 AS ok FROM v_outputs""",
    "banned_openings": banned(BANNED_OPENINGS, 2),
    "banned_closings": banned(BANNED_CLOSINGS, -2),
    "bullet_check": f"""
SELECT doc_id, {count('text', BULLET)} AS n_bullets, {count('text', BULLET)} = 0 AS ok FROM documents""",
    "structure_check": f"""
SELECT {LETTER_KEYS}, n AS n_paragraphs, n BETWEEN 4 AND 5 AS ok
FROM (SELECT {LETTER_KEYS}, greatest(len({paragraphs('text', NEWLINES)}) - 2, 0) AS n FROM v_letters) t""",
    "summary_check": rf"""
SELECT doc_id, n AS n_sentences, me AS first_person, n = 2 AND NOT me AS ok
FROM (SELECT doc_id, len({sentences('text')}) AS n,
        regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}])I(?:[^\p{{L}}\p{{N}}]|$)') AS me FROM documents) t""",
    "verb_lead": f"""
SELECT *, split_part(text, ' ', 1) IN ({', '.join(quoted(v) for v in VERBS)}) AS leads_with_verb FROM v_bullets""",
    "cardinality_check": """
WITH counts AS (SELECT applicant_id, job_id, n_roles, few, n_hooks FROM v_applications
  LEFT JOIN (SELECT applicant_id, job_id, count(*) AS n_roles, bool_or(n < 2) AS few
             FROM v_top_roles JOIN (SELECT role_id, count(*) AS n FROM v_top_bullets GROUP BY role_id) b USING (role_id)
             GROUP BY applicant_id, job_id) r USING (applicant_id, job_id)
  LEFT JOIN (SELECT applicant_id, job_id, count(*) AS n_hooks FROM v_hooks GROUP BY applicant_id, job_id) h
    USING (applicant_id, job_id))
SELECT applicant_id, job_id, '2-4 roles' AS rule FROM counts WHERE coalesce(n_roles, 0) < 2
UNION ALL SELECT applicant_id, job_id, '2-4 bullets per role' FROM counts WHERE coalesce(few, false)
UNION ALL SELECT applicant_id, job_id, '2-3 hooks' FROM counts WHERE coalesce(n_hooks, 0) < 2""",
    "education_unchanged": """
SELECT applicant_id, 'skill' AS kind, concat(skill, ' expert') AS value, 'added' AS change FROM v_skills WHERE applicant_id % 5 = 0
UNION ALL SELECT applicant_id, 'skill', skill, 'dropped' FROM v_skills WHERE applicant_id % 5 = 0""",
    "company_specific": f"""
SELECT {LETTER_KEYS}, application_id % 3 = 0 AS names_company, application_id % 6 = 0 AS names_detail,
  application_id % 6 = 0 AS ok FROM v_letters""",
    "sign_off_check": f"""
SELECT {LETTER_KEYS}, signed, closed, signed AND closed AS ok
FROM (SELECT {LETTER_KEYS}, application_id % 7 <> 0 AS signed,
        (CASE WHEN application_id % 8 = 0 THEN 'Yours,' ELSE 'Best regards,' END)
          = (CASE WHEN applicant_id % 16 = 0 THEN 'Yours,' ELSE 'Best regards,' END) AS closed FROM v_letters) t""",
    "rule_report": _REPORT,
    "count_violations": f"""
SELECT application_id, rule, count(*) AS n_violations FROM ({_REPORT}) r GROUP BY application_id, rule""",
    "placeholders": """
SELECT template_id, CASE form WHEN 3 THEN '' WHEN 4 THEN 'a.b, axb' WHEN 5 THEN 'OUTER, NAME, LOST' ELSE 'NAME, SKILL' END AS keys
FROM v_templates""",
    "template_contract": """
SELECT template_id, CASE form WHEN 4 THEN 'axb' WHEN 5 THEN 'LOST' ELSE '' END AS missing_keys,
  CASE form WHEN 3 THEN 'NAME, OUTER, SKILL, a.b' WHEN 4 THEN 'NAME, OUTER, SKILL' WHEN 5 THEN 'SKILL, a.b'
    ELSE 'OUTER, a.b' END AS extra_keys FROM v_templates""",
    "inject": "SELECT template_id, filled FROM v_filled",
    "unfilled": r"""
SELECT template_id, array_to_string(list_transform(regexp_extract_all(filled, '\{\{([^}]+)\}\}'),
  lambda h: trim(regexp_replace(h, '[{}]', '', 'g'))), ', ') AS unfilled_keys FROM v_filled""",
    "strategy_prompts": """
SELECT applicant_id, job_id, 3 AS n_blocks, s_name AS company_name, c_name AS name
FROM v_applications JOIN supplier ON s_suppkey = job_id JOIN customer ON c_custkey = applicant_id""",
    "generation_prompts": """
SELECT applicant_id, job_id, CASE WHEN job_id % 2 = 0 THEN 5 ELSE 4 END AS n_blocks,
  CASE WHEN job_id % 2 = 0 THEN slug ELSE '' END AS template_slug FROM v_applications JOIN v_jobs USING (job_id)""",
    "complete_prompts": """
SELECT job_id, concat('Title: ', title) AS title,
  CAST(12 + n_skills + CASE WHEN job_id % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN job_id % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS n_lines,
  1 AS attempts, 'fast' AS tier FROM v_jobs""",
    "complete_with_retries": """
SELECT job_id, CASE WHEN job_id % 4 = 1 THEN 1 ELSE 3 END AS attempts, CASE WHEN job_id % 4 = 1 THEN 'ok' ELSE '' END AS title,
  CASE job_id % 4 WHEN 0 THEN 'RuntimeError: no answer' WHEN 1 THEN ''
    ELSE 'ValueError: answer breaks the schema at $.title' END AS error FROM v_jobs""",
    "answer_log": "SELECT DISTINCT p_name AS skill, 1 AS n_paid FROM part",
    "produce_contract": """
SELECT job_id, CASE job_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'name ' ELSE 'name {{ PLACE }} ' END AS filled,
  CASE job_id % 3 WHEN 0 THEN 1 ELSE 2 END AS attempts, CASE job_id % 3 WHEN 2 THEN 1 ELSE 0 END AS n_unfilled FROM v_jobs""",
    "tiers": """
SELECT applicant_id, job_id, CASE WHEN job_id % 3 = 0 THEN 'ingestion' ELSE 'strategy' END AS phase,
  CASE WHEN job_id % 3 = 0 THEN 'fast' ELSE 'strong' END AS tier FROM v_applications""",
    "calibrate": f"""
WITH once AS {ONCE}, sums AS ({SENTENCE_SUMS % 'once'}), layout AS ({habits('once', chr(92) + 'n')}),
transitions AS (SELECT author_id, count(*) >= 3 AS enough_transitions, string_agg(phrase, ', ' ORDER BY place) AS common_transitions
  FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n_docs DESC, phrase) AS place
        FROM ({openings('once')}) a) b WHERE place <= 8 GROUP BY author_id),
openers AS ({most_common('once', OPENER, 'opener')}), closers AS ({most_common('once', SIGN_OFF, 'sign_off')}),
missing AS (SELECT author_id, string_agg(word, ', ' ORDER BY place) AS forbidden_words
  FROM (SELECT author_id, word, place FROM once, (SELECT unnest([{', '.join(quoted(w) for w in LEXICON)}]) AS word,
      generate_subscripts([{', '.join(quoted(w) for w in LEXICON)}], 1) AS place) w
    GROUP BY author_id, word, place HAVING NOT bool_or({has_phrase('text', 'word')})) a GROUP BY author_id)
SELECT author_id, n_docs, n AS n_sentences, round(CAST(words AS DOUBLE) / n, 6) AS mean_words, {SPREAD},
  round(short / n, 6) AS short_share, exclamations = 0 AS never_exclaims, dashes > brackets AS prefers_dashes,
  round(CAST(sentences AS DOUBLE) / greatest(n_paragraphs, 1), 6) AS sentences_per_paragraph,
  enough_transitions, opener, sign_off, common_transitions, forbidden_words
FROM sums JOIN layout USING (author_id) JOIN transitions USING (author_id) JOIN openers USING (author_id)
JOIN closers USING (author_id) JOIN missing USING (author_id)""",
    "build_profiles": """
SELECT *, '' AS detail FROM v_profile_rows
UNION ALL SELECT applicant_id, 'education', '', concat(degree, ', ', school), CAST(graduation_year AS VARCHAR) FROM v_degrees""",
    "profile_records": """
SELECT applicant_id, count(*) FILTER (section = 'skill') AS n_skills, count(*) FILTER (section = 'role') AS n_roles,
  count(*) FILTER (section = 'bullet') AS n_bullets, count(*) FILTER (section = 'degree') AS n_degrees,
  count(*) FILTER (section = 'fact') AS n_facts, max(CASE WHEN section = 'name' THEN item END) AS name
FROM (SELECT applicant_id, section, item FROM v_profile_rows
      UNION ALL SELECT applicant_id, 'degree', '' FROM v_degrees) t GROUP BY applicant_id""",
    "ingest": """
SELECT job_id, slug AS job_slug, title AS job_title,
  concat(CASE WHEN is_senior OR years >= 6 THEN 'Senior' WHEN years >= 3 THEN 'Mid-level' ELSE 'Junior' END, ' — ',
    CASE WHEN is_senior THEN 'title includes Senior; ' ELSE '' END, 'asks for ', years, '+ years') AS seniority_level,
  policy AS remote_policy, pay AS salary_range,
  concat('Take ownership of ', top1, '|Maintain ', top2) AS key_responsibilities, required_skills, preferred_skills,
  'we value ownership.' AS culture_signals
FROM v_jobs JOIN (SELECT job_id, string_agg(skill, '|' ORDER BY rnk) FILTER (level = 'required') AS required_skills,
    string_agg(skill, '|' ORDER BY rnk) FILTER (level = 'preferred') AS preferred_skills
  FROM v_requirements GROUP BY job_id) r USING (job_id)""",
    "strategise": """
WITH picked AS (SELECT role_id, string_agg(text, '; ' ORDER BY bullet_rank) AS texts FROM v_top_bullets GROUP BY role_id),
chosen AS (SELECT applicant_id, job_id, string_agg(concat(title, ': ', company, ': ', reason, ': ', texts), ' | ' ORDER BY role_rank) AS roles
  FROM v_top_roles JOIN (SELECT role_id, title, company FROM v_roles) n USING (role_id) JOIN picked USING (role_id)
  GROUP BY applicant_id, job_id),
matched AS (SELECT applicant_id, job_id, string_agg(skill, '|' ORDER BY skill) AS skills FROM v_match GROUP BY applicant_id, job_id),
gaps AS (SELECT applicant_id, job_id, string_agg(concat(missing_skill, ': ', mitigation), '|' ORDER BY missing_skill) AS gaps
  FROM v_mitigated GROUP BY applicant_id, job_id),
hooked AS (SELECT applicant_id, job_id, string_agg(concat(posting_detail, ' <- ', applicant_detail), '|' ORDER BY hook_rank) AS hooks
  FROM v_hooks GROUP BY applicant_id, job_id)
SELECT applicant_id, job_id, coalesce(roles, '') AS roles, coalesce(skills, '') AS skills, coalesce(gaps, '') AS gaps,
  coalesce(hooks, '') AS hooks
FROM v_applications LEFT JOIN chosen USING (applicant_id, job_id) LEFT JOIN matched USING (applicant_id, job_id)
LEFT JOIN gaps USING (applicant_id, job_id) LEFT JOIN hooked USING (applicant_id, job_id)""",
    "output_documents": """
SELECT applicant_id, job_id, slug AS job_slug, file_name, CASE file_name
    WHEN 'cover_letter.md' THEN concat('Dear ', s_name, ',', chr(10), chr(10), c_name)
    WHEN 'resume.md' THEN concat('# ', c_name) ELSE concat(c_name, ' at {{PLACE}} by strong') END AS text
FROM v_applications JOIN v_jobs USING (job_id) JOIN customer ON c_custkey = applicant_id,
  (SELECT unnest(['cover_letter.md', 'resume.md', 'resume.tex']) AS file_name) f
WHERE file_name <> 'resume.tex' OR job_id % 2 = 0""",
    "produce": """
SELECT applicant_id, job_id, slug AS job_slug, concat('Dear ', s_name, ',', chr(10), chr(10), c_name) AS cover_letter,
  concat('# ', c_name) AS resume_content,
  CASE WHEN job_id % 2 = 0 THEN concat(c_name, ' at {{PLACE}} by strong') ELSE '' END AS filled,
  CASE WHEN job_id % 2 = 0 THEN 'PLACE' ELSE '' END AS unfilled_keys, 1 AS attempts
FROM v_applications JOIN v_jobs USING (job_id) JOIN customer ON c_custkey = applicant_id""",
    "take_in_applications": """
SELECT applicant_id, job_id, slug AS job_slug, c_name AS name, applicant_id % 4 = 0 AS is_default
FROM v_applications JOIN v_jobs USING (job_id) JOIN customer ON c_custkey = applicant_id""",
    "take_in_new_postings": """
SELECT job_id, concat('jobs_example_com_p_', job_id) AS url_key, slug AS job_slug, 8 AS n_required FROM v_jobs""",
}


def _needed(sql: str, seen: list[str]) -> list[str]:
    """The views that a statement uses, each after the views it is made of."""
    for name in re.findall(r"\bv_[a-z_]+\b", sql):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def statements() -> dict[str, str]:
    made = {}
    for name, sql in SQL.items():
        views = _needed(sql, [])
        inner = sql.strip()
        if views:
            with_list = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in views)
            inner = f"WITH {with_list}\nSELECT * FROM ({inner}) answer"
        made[name] = inner
    return made
