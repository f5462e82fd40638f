"""Reference SQL for DuckDB, one text per query of workload.queries."""

from vacanta.functions.cleaning import LINKEDIN_RULES, PAGE_RULES
from vacanta.functions.rules import AMBIGUOUS, FLAG_WORDS, FUNCTION_WORDS, SALARY, SENIORITY_WORDS, SKILLS, URGENT, YEARS
from vacanta.functions.text import BROWSER_SPACE, DECODER_SPACE
from vacanta.operators.documents import PROMPT_INTRO, PROMPT_RULES, PROMPT_SHAPE
from workload import queries as q
from workload import tables as t

JOBS, SKILLS_SQL, MESSAGES, CHANGES = (t.duck(x) for x in (t.JOBS, t.JOB_SKILLS, t.MESSAGES, t.CHANGES))
WITH = f"with jobs as ({JOBS}), job_skills as ({SKILLS_SQL}) "
WITH_MESSAGES = f"with m as ({MESSAGES}) "
ORACLES = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def trim(x: str, space: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{space}+', ''), '{space}+$', '')"


def replace_all(x: str, rules) -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"
    return x


def utf16(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"


def clean(x: str) -> str:
    return trim(replace_all(x, PAGE_RULES), BROWSER_SPACE)


def cut(x: str, marker: str) -> str:
    return f"case when strpos({x}, {lit(marker)}) > 1 then substr({x}, 1, strpos({x}, {lit(marker)}) - 1) else {x} end"


def docs(extra: str) -> str:
    return f"(select doc_id, {extra} as text from documents)"


def extract_url(x: str) -> str:
    return trim(f"regexp_extract({x}, 'URL:([^\\n]*)', 1)", DECODER_SPACE)


# ---------------------------------------------------------------- sources and sinks

PLANTED = docs(t.PLANTED_TEXT)
ORACLES["read_captures"] = f"""
select doc_id as capture_id, 'https://x.example/' || doc_id as url, 'doc' as title, text,
       {utf16('text')} as content_length from {PLANTED}"""
ORACLES["read_pages"] = "select page_id, url, html from pages"
ORACLES["read_board_jobs"] = """
select regexp_extract(html, '<h1>(.*?)</h1>', 1) as title,
       case when page_id % 3 = 0 then '' else 'City ' || page_id end as location,
       case when page_id % 4 = 0 then 'none' else 'Data|Ops' end as departments,
       url, '2024-01-02T03:04:05Z' as updated_at, length(html) as content_chars from pages"""
ORACLES["read_postings"] = WITH_MESSAGES + """
select url as source_url, extracted_at, title as job_title, salary_min, salary_max, remote as is_remote_friendly from m"""
ORACLES["write_postings"] = WITH_MESSAGES + """
select url as source_url, extracted_at, salary_min, skill_cloud is null as null_list_kept from m"""
ORACLES["write_raw"] = f"select doc_id, text, '2024-06-01' as ingest_date from {PLANTED}"
ORACLES["job_store"] = WITH + """
select source_url, job_title, status, (select count(*) from job_skills s where s.job_id = jobs.id) as skills from jobs"""
ORACLES["register_views"] = WITH + """
select department, skill_category, count(*) as cnt, max(salary_max) as top_salary
from job_skills join jobs on id = job_id group by all"""

# ---------------------------------------------------------------- routing

URL = f"(select page_id, {t.PLANTED_URL} as url from pages)"
ORACLES["route_source"] = """
select page_id, case page_id % 6 when 1 then 'wellfound' when 2 then 'remoterocketship' when 3 then 'linkedin'
       when 5 then 'generic' else 'greenhouse' end as site from pages"""
ORACLES["host_predicates"] = f"""
select page_id, contains(url, 'wellfound.com/jobs/') or contains(url, 'angel.co/jobs/') as wellfound,
       contains(url, 'remoterocketship.com/company/') as rocketship, contains(url, 'linkedin.com/jobs/view/') as linkedin
from {URL}"""
ORACLES["board_ids"] = """
select page_id, case when page_id % 6 = 0 then 'acme' || page_id end as board_token,
       case page_id % 6 when 0 then cast(page_id + 1000 as varchar) when 4 then page_id || '+1' end as job_id,
       case page_id % 6 when 0 then 'direct' when 4 then 'embedded' end as type from pages"""
ORACLES["board_token_from_frames"] = """
select page_id, case when page_id % 3 = 0 then 'co' || page_id else 'none' end as board_token from pages"""

ORACLES["board_links"] = """
select page_id, cast(page_id as varchar) as job_id, case when page_id % 2 = 0 then 'co' || page_id else 'none' end as board_token
from pages"""

# ---------------------------------------------------------------- pages to text


def decode(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{name}', {lit(char)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def plain(x: str) -> str:
    """Text of markup: comments, tags and a tag cut off by the end of the page are removed."""
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    return decode(f"regexp_replace(regexp_replace({x}, '<[a-zA-Z/!][^>]*>', '', 'g'), '<[a-zA-Z/!][^>]*$', '')")


def without(x: str, *tags: str) -> str:
    for tag in tags:
        x = f"regexp_replace({x}, '<{tag}[ >].*?</{tag}>', '', 'gs')"
        x = f"regexp_replace({x}, '<{tag}[ >].*$', '', 's')"
    return x


def one_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"


def shown(x: str) -> str:
    """Visible text with one blank between blocks."""
    blocks = f"regexp_replace({x}, '</?(nav|ul|li|div|article|main|h1|p|footer|br)( [^>]*)?>', ' ', 'g')"
    return one_space(plain(blocks))


BODY = "regexp_replace(regexp_extract(html, '<body>(.*)', 1, 's'), '</body>.*', '', 's')"
ORACLES["page_text"] = f"select page_id, {shown(BODY)} as text from pages"
NO_AD = f"regexp_replace({without(BODY, 'script', 'style', 'nav', 'footer')}, '<div class=\"ad\">.*?</div>', '', 's')"
ORACLES["drop_elements"] = f"select page_id, {plain(NO_AD)} as text from pages"

SITE = f"(select page_id, url, {t.SITE_HTML} as html from pages)"
H1 = one_space(plain("regexp_extract(html, '<h1>(.*?)</h1>', 1)"))
ARTICLE = "regexp_replace(regexp_extract(html, '<article>(.*)', 1, 's'), '</article>.*', '', 's')"
SALARY_TEXT = "case when page_id % 2 = 0 then '€' || page_id || 'k' else '' end"
FIELDS = f"""(select page_id, url, case when {utf16(H1)} < 150 then {H1} else '' end as title,
  {SALARY_TEXT} as salary, 'Lyon ' || page_id as location, {plain(ARTICLE)} as article,
  {plain(without(BODY, 'script', 'style', 'nav', 'footer'))} as body, {shown(BODY)} as shown from {SITE})"""
ORACLES["first_field"] = f"select page_id, title, salary, location from {FIELDS}"


def part(label: str, x: str) -> str:
    return f"case when {x} <> '' then '{label}: ' || {x} || chr(10) || chr(10) else '' end"


APPLY = trim("('Apply' || article)", BROWSER_SPACE)
MAIN = trim(
    "('Lyon ' || page_id || case when page_id % 2 = 0 then '€' else '' end || page_id || 'kApply' || article)",
    BROWSER_SPACE,
)
WELLFOUND = f"""{part('JOB TITLE', 'title')} || {part('COMPENSATION', 'salary')} || {part('LOCATION', 'location')}
  || 'DESCRIPTION:' || chr(10) || case when {utf16(APPLY)} > 500 then {APPLY} else {MAIN} end"""
LINKEDIN = f"""{part('JOB TITLE', 'title')} || {part('COMPANY', 'location')} || {part('LOCATION', 'location')}
  || 'DESCRIPTION:' || chr(10) || {trim('article', BROWSER_SPACE)}"""


def linkedin_clean(x: str) -> str:
    """A scalar subquery, so that the cut does not repeat the chain of replacements."""
    phrases = replace_all(clean(x), LINKEDIN_RULES)
    return f"(select {trim(cut('z', 'Close your conversation with'), BROWSER_SPACE)} from (select {phrases} as z))"


def rocketship(x: str) -> str:
    second = cut("y", "Discover 100,000+ Remote Jobs")
    return clean(f"(select {second} from (select {cut('x', 'Similar Jobs')} as y from (select {x} as x)))")


ORACLES["wellfound_text"] = f"select page_id, {clean(WELLFOUND)} as text from {FIELDS}"
ORACLES["rocketship_text"] = f"select page_id, {rocketship('body')} as text from {FIELDS}"
ORACLES["linkedin_text"] = f"select page_id, {linkedin_clean(LINKEDIN)} as text from {FIELDS}"
ORACLES["pages_to_text"] = f"""
select page_id, case page_id % 6 when 1 then 'wellfound' when 2 then 'remoterocketship' when 3 then 'linkedin'
         when 5 then 'generic' else 'greenhouse' end as site,
       {one_space('text')} as text
from (select page_id, case page_id % 6 when 1 then {clean(WELLFOUND)} when 2 then {rocketship('body')}
             when 3 then {linkedin_clean(LINKEDIN)} else shown end as text from {FIELDS})"""
ORACLES["board_text"] = f"""
select title, url, chr(10) || 'JOB TITLE: ' || title || chr(10) || chr(10) || 'LOCATION: '
  || case when page_id % 3 = 0 then 'Not specified' else 'City ' || page_id end || chr(10) || chr(10) || 'DEPARTMENT: '
  || case when page_id % 4 = 0 then 'Not specified' else 'Data, Ops' end || chr(10) || chr(10) || 'DESCRIPTION:' || chr(10)
  || text || chr(10) || chr(10) || 'URL: ' || url || chr(10) || 'UPDATED: 2024-01-02T03:04:05Z' || chr(10)
  || 'SOURCE: Greenhouse API' || chr(10) as text
from (select page_id, url, regexp_extract(html, '<h1>(.*?)</h1>', 1) as title, {plain(BODY)} as text from pages)"""
HIDDEN_SHOWN = f"""case when page_id % 8 in (3, 4, 6) then 'shown ' else '' end"""
# The article with its visible blocks only, as if nothing had been hidden in it.
VISIBLE = f"""(select page_id, replace(html, '<article>', '<div>' || {HIDDEN_SHOWN} || '</div><article><p>back </p>') as html from pages)"""
ORACLES["hidden_elements"] = f"select page_id, {shown(BODY)} as text from {VISIBLE}"
ACME = f"""{part('JOB TITLE', 'title')} || {part('COMPENSATION', 'salary')} || {part('LOCATION', 'location')}
  || 'DESCRIPTION:' || chr(10) || {trim('article', BROWSER_SPACE)}"""
ORACLES["added_site"] = f"select page_id, 'acme' as site, {clean(ACME)} as text from {FIELDS}"
ORACLES["cut_at_marker"] = f"select doc_id, {cut('text', 'Similar Jobs')} as text from {PLANTED}"
ORACLES["clean_text"] = f"select doc_id, {clean('text')} as text from {PLANTED}"
ORACLES["clean_linkedin_text"] = f"select doc_id, {linkedin_clean('text')} as text from {docs(t.LINKEDIN_TEXT)}"
ORACLES["capture_envelope"] = f"""
select doc_id, {utf16('text')} as content_length,
       chr(10) || 'URL: https://x.example/' || doc_id || chr(10) || 'SOURCE: '
       || case when doc_id % 2 = 0 then 'LinkedIn' else 'Generic' end || ' (Scraped)' || chr(10) || chr(10) || text || chr(10) as text
from {PLANTED}"""
ORACLES["first_capture"] = """
select conv_id as capture_id, turn as ts, text, role from conversations
qualify row_number() over (partition by conv_id order by turn) = 1"""
ORACLES["is_complete"] = f"select doc_id, {utf16('text')} > 500 as complete from {PLANTED}"

# ---------------------------------------------------------------- text to posting

PROMPT = f"""{lit(PROMPT_INTRO)} || text || {lit(PROMPT_SHAPE)} || ',' || chr(10) || '  "extracted_at": "{q.STAMP}",'
  || chr(10) || '  "source_url": "' || {extract_url('text')} || '"' || chr(10) || '}}' || {lit(PROMPT_RULES)}"""
ORACLES["build_prompt"] = f"select doc_id, md5({PROMPT}) as prompt_md5 from {PLANTED}"
FENCE = "chr(96) || chr(96) || chr(96)"
UNFENCED = trim("response", DECODER_SPACE)
ORACLES["strip_fences"] = f"""
select doc_id, {trim("regexp_replace(regexp_replace(regexp_replace(" + UNFENCED + ", '^```json', ''), '^```', ''), '```$', '')", DECODER_SPACE)} as text
from {docs(q.FENCED).replace(' as text', ' as response')}"""
ORACLES["parse_posting"] = WITH_MESSAGES + """
select seq as ingest_seq, outcome, case when outcome = 'accepted' and seq % 9 <> 3 then title else '' end as job_title,
       case when outcome = 'accepted' and seq % 9 <> 3 then salary_min else 0 end as salary_min, '' as education_level
from (select *, case seq % 9 when 0 then 'not a single JSON object' when 1 then 'wrong type in a field'
      when 2 then 'empty response' when 4 then 'not a single JSON object' when 5 then 'not a single JSON object'
      when 6 then 'wrong type in a field' else 'accepted' end as outcome from m)"""
ORACLES["extract_url"] = f"select doc_id, {extract_url('text')} as source_url from {PLANTED}"
ORACLES["resolve_source_url"] = WITH_MESSAGES + """
select seq as ingest_seq, case when seq % 2 = 0 then 'https://given.example/' else url end as resolved from m"""
ORACLES["extract_with"] = f"""
select doc_id, case when doc_id % 3 = 0 then 'perplexity/' else 'ollama/' end
       || case when doc_id % 5 = 0 then 'own-model' when doc_id % 3 = 0 then 'sonar-pro' else 'qwen2.5:7b' end as asked,
       length({PROMPT}) as prompt_chars, case when doc_id % 2 = 0 then 'https://given.example/' else '' end as resolved
from {PLANTED}"""
ORACLES["extract_isolated"] = """
select doc_id, case when doc_id % 61 = 0 then 'no text' when doc_id % 50 = 0 then 'model call failed: ConnectionError: refused'
                    when doc_id % 73 = 1 then 'model call failed: ValueError: 0 answers to 1 prompts' else 'stored' end as outcome,
       case when doc_id % 61 = 0 or doc_id % 50 = 0 or doc_id % 73 = 1 then '' else 'ollama/m' end as asked
from documents"""

RULE_DOCS = f"(select doc_id, {q.TITLE} as title, {q.RULE_TEXT} as text from documents)"


def number(x: str) -> str:
    return f"coalesce(try_cast(replace({x}, ',', '') as bigint), 0)"


def group(pattern: str, i: int) -> str:
    return f"regexp_extract(text, {lit(pattern)}, {i})"


YEARS_SQL = [number(group(YEARS, i)) for i in (1, 2)]
LOW, HIGH = number(group(SALARY, 2)), number(group(SALARY, 4))
HIGH_K = f"{group(SALARY, 5)} <> ''"
SALARY_SQL = [
    f"case when {group(SALARY, 3)} <> '' or ({HIGH_K} and {LOW} < 1000) then {LOW} * 1000 else {LOW} end",
    f"case when {HIGH_K} then {HIGH} * 1000 else {HIGH} end",
    f"case upper({group(SALARY, 1)}) when '$' then 'USD' when '€' then 'EUR' when '£' then 'GBP' else upper({group(SALARY, 1)}) end",
]


def first_match(x: str, words, other: str) -> str:
    whens = " ".join(f"when regexp_matches({x}, {lit(p)}) then '{name}'" for name, p in words)
    return f"case {whens} else {other} end"


SENIORITY_SQL = first_match("title", SENIORITY_WORDS, "case when title = '' then '' else 'Mid' end")
URGENCY_SQL = f"case when regexp_matches(text, {lit(URGENT)}) then 'Urgent' else 'Standard' end"
ORACLES["years_experience"] = f"select doc_id, {YEARS_SQL[0]} as years_min, {YEARS_SQL[1]} as years_max from {RULE_DOCS}"
ORACLES["seniority"] = f"select doc_id, {SENIORITY_SQL} as seniority from {RULE_DOCS}"
job_function = first_match("title", FUNCTION_WORDS, "''")
ORACLES["job_function"] = f"select doc_id, {job_function} as job_function from {RULE_DOCS}"
ORACLES["salary_range"] = f"""
select doc_id, {SALARY_SQL[0]} as salary_min, {SALARY_SQL[1]} as salary_max, {SALARY_SQL[2]} as currency from {RULE_DOCS}"""
flag_columns = ", ".join(f"regexp_matches(text, {lit(p)}) as {name}" for name, (p, _) in FLAG_WORDS.items())
ORACLES["flags"] = f"select doc_id, {flag_columns} from {RULE_DOCS}"
ORACLES["urgency"] = f"select doc_id, {URGENCY_SQL} as urgency from {RULE_DOCS}"

spellings = ", ".join(
    f"({lit(field)}, {lit(spelled)}, {lit(name)})"
    for field, names in SKILLS.items()
    for name in names
    for spelled in dict.fromkeys([name] if name in AMBIGUOUS else [name, name.lower()])
)
skill_columns = ", ".join(
    f"coalesce(string_agg(case when field = {lit(f)} then name end, '|' order by pos), '') as {f}" for f in SKILLS
)
# Words and pairs as rows joined to the dictionary, where the query intersects arrays.
ORACLES["technical_skills"] = f"""
with dictionary(field, spelled, name) as (values {spellings}),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i, w
          from (select doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}.][\\p{{L}}\\p{{N}}+#.]*'),
                                              lambda x: regexp_replace(x, '\\.+$', '')) as w from {RULE_DOCS})),
offers as (select doc_id, word, i as pos from words
           union all select doc_id, word || ' ' || w[i + 1], 1000000000 + i from words where i < len(w)),
hits as (select doc_id, field, name, min(pos) as pos from offers join dictionary on word = spelled group by all)
select doc_id, {skill_columns} from (select doc_id from documents) left join hits using (doc_id) group by doc_id"""


def cut_words(x: str) -> str:
    return f"""list_transform(regexp_extract_all({x}, '[\\p{{L}}.][\\p{{L}}\\p{{N}}+#.]*'), lambda x: regexp_replace(x, '\\.+$', ''))"""


ORACLES["match_terms"] = f"""
with texts as (select {cut_words(q.HEADING)} as w from pages union all select {cut_words('text')} from benchmark),
runs as (select w, unnest(range(1, len(w) + 1)) as i from texts),
terms as (
  select distinct array_to_string(list_slice(w, i, least(i + n - 1, len(w))), ' ') as term
  from runs, (values (1), (2), (3)) as lengths(n)),
known as (
  select term, lower(term) as name, case when length(term) % 2 = 0 then 'databases' else 'other' end as category,
         length(term) % 5 = 0 as exact from terms where term <> ''),
docs as (select doc_id, {cut_words('text')} as w from documents),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from docs),
found as (
  select doc_id, i - 1 as place, array_to_string(list_slice(w, i, i + n - 1), ' ') as run
  from places, (values (1), (2), (3)) as lengths(n) where i + n - 1 <= len(w)),
hits as (
  select doc_id, name, category, min(place) as place, count(*) as cnt
  from found join known on lower(run) = name and (not exact or run = term) group by all)
select doc_id, category, count(*) as names, sum(cnt)::bigint as hits, sum(place)::bigint as places, min(name) as first_name
from hits group by all"""
ORACLES["rules_extract"] = f"""
select doc_id, title, {SENIORITY_SQL} as seniority, 'Lyon' as city, {YEARS_SQL[0]} as years_min,
       {SALARY_SQL[1]} as salary_max, regexp_matches(text, {lit(FLAG_WORDS['has_equity'][0])}) as has_equity,
       {URGENCY_SQL} as urgency, 'https://x.example/a' as source_url from {RULE_DOCS}"""
ORACLES["skill_count"] = WITH_MESSAGES + """
select seq as ingest_seq, 7 + case when skill_cloud is null then 0 else 1 end as num_required, 2 as num_nice_to_have from m"""

# ---------------------------------------------------------------- flatten and explode

UNSET_TEXT = [
    "company_size", "industry", "location_country", "workplace_type", "job_type", "timezone_requirements",
    "education_level", "team_structure", "soft_skills",
]
UNSET_FLAGS = [
    "requires_specific_degree", "has_remote_stipend", "offers_visa_sponsorship", "offers_health_insurance",
    "offers_pto", "offers_professional_development", "offers_401k", "has_take_home", "has_pair_programming",
]
LISTS = """duty1 || chr(10) || '• ' || duty2 as key_responsibilities, duty1 || ', ' || duty1 as benefits,
       duty2 || '; ' || duty1 as nice_to_have"""
ORACLES["flatten_posting"] = WITH_MESSAGES + f"""
select seq as ingest_seq, url as source_url, extracted_at as extracted_at_raw, title as job_title, company as company_name,
       place as location_full, city as location_city, seniority as seniority_level, department, job_function,
       remote as is_remote_friendly, years_min as years_experience_min, years_max as years_experience_max,
       salary_min, salary_max, currency as salary_currency, equity as has_equity, urgency as urgency_level,
       rounds as interview_rounds, summary, {LISTS}, 'saved' as status, company as raw_json,
       {', '.join(f"'' as {c}" for c in UNSET_TEXT)}, {', '.join(f'false as {c}' for c in UNSET_FLAGS)} from m"""
ORACLES["join_lists"] = WITH_MESSAGES + f"select seq as ingest_seq, {LISTS}, '' as soft_skills from m"


def skill_rows(key: str, source: str, db: str = "skill_db") -> str:
    pairs = [
        ("skill_lang", "programming_language"), ("skill_framework", "framework"), (db, "database"),
        ("skill_cloud", "cloud"), ("skill_devops", "devops"), ("skill_lang", "other"), ("skill_lang", "other"),
    ]
    return " union all ".join(
        f"select {key}, {name} as skill_name, '{category}' as skill_category from {source} where {name} <> ''"
        for name, category in pairs
    )


ORACLES["explode_skills"] = WITH_MESSAGES + f"select *, true as is_required from ({skill_rows('seq as job_id', 'm')})"
ORACLES["flat_skill_list"] = WITH_MESSAGES + """
select seq as ingest_seq, skill_lang || '||' || skill_framework || '|' || skill_db || '|'
  || coalesce(skill_cloud || '|', '') || skill_devops || '|' || skill_lang || '|' || skill_lang as skills from m"""

# ---------------------------------------------------------------- changes

# Two batches of messages in order; the second repeats the first with changed values.
BATCHES = f"""with m as ({MESSAGES}),
log as (select 1 as batch, * from m union all
        select 2, * replace (case when seq % 3 = 0 then url || '/new' else url end as url, title || ' II' as title,
                             'moved' as city, 'moved db' as skill_db) from m),
ranked as (select *, row_number() over (partition by url order by batch, seq) as first,
                  row_number() over (partition by url order by batch desc, seq desc) as last,
                  min(batch) over (partition by url) as opened, max(batch) over (partition by url) as touched from log),
a as (select * from ranked where first = 1), z as (select * from ranked where last = 1) """
ORACLES["upsert_jobs"] = BATCHES + """
select a.url as source_url, z.title as job_title, z.company as company_name, z.salary_min, z.salary_max,
       a.city as location_city, a.currency as salary_currency, a.extracted_at as extracted_at_raw, 'saved' as status,
       z.city as raw_city, '2024-06-0' || a.opened as created, '2024-06-0' || a.touched as updated
from a join z using (url)"""
ORACLES["replace_skills"] = BATCHES + skill_rows("url as source_url", "z")
ORACLES["ingest_stream"] = BATCHES + f""", s as ({skill_rows('url', 'z')})
select url as source_url, z.title as job_title, z.salary_min, a.city as location_city, 'saved' as status,
       (select count(*) from s where s.url = z.url) as skills from a join z using (url)"""


def last_change(name: str, valid: str) -> str:
    return f"arg_max({name}, seq) filter (where {valid}) as new_{name}"


def tracked(edits: list[tuple[str, str]], where: str = "", extra: str = "") -> str:
    cols = {"status": "j.status", "notes": "j.notes", "rating": "j.rating"}
    touched = " or ".join(f"new_{n} is not null" for n, _ in edits)
    for name, _ in edits:
        cols[name] = f"coalesce(new_{name}, j.{name})"
    return f"""with jobs as ({JOBS}), changes as ({CHANGES}), job_skills as ({SKILLS_SQL}),
latest as (select id, {', '.join(last_change(n, v) for n, v in edits)}, bool_or(action = 'delete') as deleted
           from changes group by id)
select {extra or "j.id, case when " + touched + " then '2024-06-01' else '2024-01-01' end as updated"},
       {cols['status']} as status, coalesce({cols['notes']}, '-') as notes, coalesce({cols['rating']}, -1) as rating
from jobs j left join latest on latest.id = j.id {where}"""


STATUS_EDIT, NOTES_EDIT, RATING_EDIT = ("status", "status <> ''"), ("notes", "notes is not null"), ("rating", "rating is not null")
KEPT = "where not coalesce(deleted, false)"
ORACLES["update_status"] = tracked([("status", "status is not null")])
ORACLES["update_notes"] = tracked([NOTES_EDIT])
ORACLES["update_rating"] = tracked([RATING_EDIT])
ORACLES["apply_patch"] = tracked([STATUS_EDIT, NOTES_EDIT])
ORACLES["apply_changes"] = tracked([STATUS_EDIT, NOTES_EDIT, RATING_EDIT], KEPT)
ORACLES["tracking_stream"] = tracked(
    [STATUS_EDIT, NOTES_EDIT, RATING_EDIT], KEPT,
    "j.source_url, (select count(*) from job_skills s where s.job_id = j.id) as skills",
)
ORACLES["delete_jobs"] = f"""
with jobs as ({JOBS}), changes as ({CHANGES}), job_skills as ({SKILLS_SQL}),
gone as (select id from changes where action = 'delete')
select 'jobs' as kind, status as name, count(*) as cnt from jobs where id not in (select id from gone) group by all
union all
select 'skills', skill_category, count(*) from job_skills where job_id not in (select id from gone) group by all"""

# ---------------------------------------------------------------- listing and analytics

SALARY_COLUMN = "coalesce(salary_min || '-' || salary_max || ' ' || coalesce(salary_currency, ''), '')"
LISTED = f"""select id, job_title as title, company_name as company, location_full as location, job_type, workplace_type,
  seniority_level as level, department, {SALARY_COLUMN} as salary_range, status, extracted_at, source_url as url from jobs"""
ORACLES["list_jobs"] = WITH + LISTED + " order by extracted_at desc, id desc limit 100"
ORACLES["list_jobs_by_status"] = WITH + LISTED + " where status = 'interview' order by extracted_at desc, id desc limit 25 offset 50"
ORACLES["salary_column"] = WITH + f"select id, {SALARY_COLUMN} as salary_range from jobs"
ORACLES["get_jobs"] = WITH_MESSAGES + """
select seq as id, title, company, place as location, url, 'saved' as status,
       case when seq % 2 = 0 then 'n' else '' end as notes, case when seq % 3 = 0 then 4 else 0 end as rating,
       skill_lang || '||' || skill_framework || '|' || skill_db || '|' || coalesce(skill_cloud || '|', '')
       || skill_devops || '|' || skill_lang || '|' || skill_lang as skills, urgency from m"""
ORACLES["search_jobs"] = WITH + """
select id, job_title as title, company_name as company, location_full as location, workplace_type, status,
       extracted_at, source_url as url from jobs
where lower(job_title) like '%machinery%low%' or lower(company_name) like '%machinery%low%' or lower(location_full) like '%machinery%low%'
order by extracted_at desc, id desc limit 50"""


def like_any(term: str) -> str:
    low = lit(f"%{term.lower()}%")
    return " or ".join(f"lower({c}) like {low}" for c in ("job_title", "company_name", "location_full"))


ORACLES["search_indexed"] = WITH + " union all ".join(
    f"(select {lit(term)} as term, id, job_title as title, status from jobs where {like_any(term)} order by extracted_at desc, id desc limit 50)"
    for term in q.TERMS
)
PAGED = f"select {{page}} as page, {{part}} as part, id, job_title as title, status, {SALARY_COLUMN} as salary_range from jobs"
ORACLES["read_pages_by_position"] = WITH + " union all ".join(
    "(" + PAGED.format(page=page, part=lit(part)) + where + f" order by extracted_at desc, id desc limit 10 offset {10 * page})"
    for page in (0, 2, 140) for part, where in (("all", ""), ("interview", " where status = 'interview'"))
)
ORACLES["filter_listing"] = WITH + """
select id, job_title as title, company_name as company, status from jobs
where (contains(lower(job_title), 'build') or contains(lower(company_name), 'build')) and status = 'offer'"""
STATUS_COUNTS = ", ".join(
    f"count(*) filter (where status = '{s}') as {s}" for s in ("saved", "applied", "interview", "offer", "rejected")
)
ORACLES["job_stats"] = WITH + f"select count(*) as total, {STATUS_COUNTS} from jobs"
TOP = "select skill_name, skill_category, count(*) as cnt from job_skills {where} group by all order by cnt desc, skill_name, skill_category limit {n}"
ORACLES["top_skills"] = WITH + TOP.format(where="", n=20)
ORACLES["top_skills_by_category"] = WITH + TOP.format(where="where skill_category = 'database'", n=15)
CATEGORY_TOP = """select skill_category, skill_name, count(*) as cnt,
         row_number() over (partition by skill_category order by count(*) desc, skill_name) as rank
  from job_skills where skill_category <> 'framework' group by skill_category, skill_name qualify rank <= 15"""
ORACLES["top_skills_all_categories"] = WITH + CATEGORY_TOP
STATUS_TOP = """select status, skill_name, skill_category, count(*) as cnt,
         row_number() over (partition by status order by count(*) desc, skill_name, skill_category) as rank
  from job_skills join jobs on id = job_id group by status, skill_name, skill_category qualify rank <= 10"""
ORACLES["skills_by_status"] = WITH + STATUS_TOP
ORACLES["skill_locations"] = WITH + f"""
select coalesce(location_city, location_full, 'Unknown') as location, count(*) as cnt from job_skills join jobs on id = job_id
where skill_name = '{q.SKILL}' group by 1 order by cnt desc, 1 limit 10"""
TITLES = "select job_title, count(*) as cnt from jobs where job_title <> '' group by 1 order by cnt desc, 1 limit 15"
ORACLES["top_job_titles"] = WITH + TITLES
ORACLES["analytics_parts"] = WITH + f"""
select 'status' as part, '' as grp, status as name, count(*) as cnt from jobs group by status
union all select 'status', '', 'total', count(*) from jobs
union all select 'category', skill_category, skill_name, cnt from ({CATEGORY_TOP})
union all select 'by_status', status, skill_name, cnt from ({STATUS_TOP})
union all select 'title', '', job_title, cnt from ({TITLES})"""
# The bundle over the tables as two change logs leave them: the last status of each log, none where either deletes.
ORACLES["counts_kept"] = f"""
with old_jobs as ({JOBS}), changes as ({CHANGES}), old_skills as ({SKILLS_SQL}),
edits as (
  select id, seq % 2 as half, max_by(status, seq) filter (where status <> '') as status,
         bool_or(action = 'delete') as deleted from changes group by all),
jobs as (
  select j.* replace (coalesce(b.status, a.status, j.status) as status)
  from old_jobs j left join edits a on a.id = j.id and a.half = 0 left join edits b on b.id = j.id and b.half = 1
  where not coalesce(a.deleted, false) and not coalesce(b.deleted, false)),
job_skills as (
  select s.* from old_skills s where job_id not in (select id from edits where deleted and id in (select id from old_jobs)))
""" + ORACLES["analytics_parts"].removeprefix(WITH)
STATUS_LIST = "['saved', 'applied', 'interview', 'offer', 'rejected']"
ORACLES["skill_status_matrix"] = WITH + f"""
select skill_name, min(list_position({STATUS_LIST}, status) * 1000000000::bigint + rank) as sort_key,
       {', '.join(f"coalesce(max(case when status = '{s}' then cnt end), 0) as {s}" for s in ("saved", "applied", "interview", "offer", "rejected"))}
from ({STATUS_TOP}) group by skill_name"""
ORACLES["summary_line"] = WITH + f"""
select 'You have ' || total || ' jobs tracked. Applied: ' || applied || ', Interview: ' || interview || ', Offer: ' || offer || '.' as summary
from (select count(*) as total, {STATUS_COUNTS} from jobs)"""
ORACLES["job_report"] = WITH_MESSAGES + """
select seq as id, title, company || ' · ' || place as subtitle,
       skill_lang || ', , ' || skill_framework || ', ' || skill_db || ', ' || coalesce(skill_cloud || ', ', '')
       || skill_devops || ', ' || skill_lang || ', ' || skill_lang as skills,
       '• ' || duty1 || chr(10) || '• ' || duty2 as responsibilities,
       years_min || '–' || years_max || ' years' as experience, 'Not specified' as education,
       trim(salary_min || '–' || salary_max || ' ' || currency) as salary, duty1 || ', ' || duty1 as benefits,
       case when urgency = '' then 'Standard' else urgency end as urgency, cast(rounds as varchar) as interview_rounds,
       case when equity then 'Yes' else 'No' end as equity, case when remote then 'Yes' else 'No' end as remote_friendly,
       '—' as team_structure from m"""
ORACLES["category_labels"] = WITH_MESSAGES + """
select seq as id, 0 as position, 'Programming languages' as label, skill_lang || ', ' as names from m
union all select seq, 1, 'Frameworks', skill_framework from m
union all select seq, 2, 'Databases', skill_db from m
union all select seq, 3, 'Cloud platforms', skill_cloud from m where skill_cloud is not null
union all select seq, 4, 'DevOps tools', skill_devops from m
union all select seq, 5, 'Other', skill_lang || ', ' || skill_lang from m"""

# ---------------------------------------------------------------- first capture per period

ORACLES["first_capture_stream"] = f"""
with recursive captures as (select 'user ' || user_id as url, event_id as capture_id, epoch_us(ts) // 1000000 as s, epoch_us(ts) as us, props as text from events),
opened as (
  select url, min(s) as s from captures group by url
  union all
  select url, s from (select o.url, (select min(c.s) from captures c where c.url = o.url and c.s >= o.s + {q.PERIOD}) as s from opened o)
  where s is not null)
select url, arg_min(capture_id, us) as capture_id, arg_min(text, us) as text
from captures join opened using (url, s) group by url, s"""

ORACLES["capture_periods_stream"] = f"""
with recursive captures as (
  select {q.PAGE_URL} as url, event_id as capture_id, {q.PAGE_LENGTH} as length, epoch_us(ts) // {q.SLOWER} as us,
         (epoch_us(ts) // {q.SLOWER}) // 1000000 as s from events),
seconds as (
  select url, s, coalesce(bool_or(length > 500), false) as complete, case when url like '%x.example%' then 20 else 15 end as lasts
  from captures group by url, s),
ends as (
  select url, s, least(s + lasts, coalesce((select min(c.s) from seconds c where c.url = o.url and c.complete and c.s >= o.s and c.s < o.s + o.lasts) + 2,
                                           s + lasts)) as until from seconds o),
follows as (select url, s, (select min(c.s) from seconds c where c.url = e.url and c.s >= e.until) as next from ends e),
opened as (
  select url, min(s) as s from seconds group by url
  union all
  select o.url, f.next from opened o join follows f on f.url = o.url and f.s = o.s where f.next is not null)
select url, f.capture_id, f.length
from (select url, min({{'us': us, 'capture_id': capture_id, 'length': length}}) as f from captures join opened using (url, s) group by url, s)"""
