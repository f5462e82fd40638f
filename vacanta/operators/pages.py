"""Web pages and captures to posting text.

One mapInPandas stage reads each page once and emits the candidate texts its site's rules may need.
Choosing, formatting and cleaning are column expressions.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from vacanta.functions import markup
from vacanta.functions.cleaning import (
    ROCKETSHIP_MARKERS,
    finish_linkedin,
    strip_linkedin_phrases,
    strip_markup,
    strip_page_phrases,
)
from vacanta.functions.postings import list_or_empty
from vacanta.functions.text import cut_at_marker, or_default, trim_browser, utf16_length
from vacanta.functions.urls import board_ids, board_token_from_frames, route_source

# Selectors per site and field in the order they are tried, and the elements dropped
# from a description before its text is taken.
WELLFOUND = {
    "title": ["h1", '[class*="JobTitle"]', '[class*="job-title"]'],
    "salary": ['[class*="salary"]', '[class*="compensation"]', '[class*="Salary"]'],
    "location": ['[class*="location"]', '[class*="Location"]'],
    "description": [
        '[class*="JobDescription"]', '[class*="job-description"]', '[class*="description"]', "main section", "main",
    ],
    "description_drop": [
        "script", "style", "nav", "header", "footer", '[class*="similar"]', '[class*="Similar"]',
        '[class*="navigation"]', '[class*="cookie"]', '[class*="consent"]', '[id*="consent"]',
    ],
    "fallback": ["main"],
    "fallback_drop": [
        "script", "style", "nav", "header", "footer", '[class*="similar"]', '[class*="Similar"]',
        '[class*="cookie"]', '[class*="consent"]', '[id*="consent"]',
    ],
}
LINKEDIN = {
    "title": [".top-card-layout__title", "h1.topcard__title", "h1"],
    "company": [".topcard__org-name-link", ".topcard__flavor", "a.topcard__org-name-link"],
    "location": [".topcard__flavor--bullet", ".top-card-layout__second-subline"],
    "description": [
        ".show-more-less-html__markup", ".jobs-description__content", ".description__text",
        '[class*="job-description"]',
    ],
    "description_drop": ["button", '[class*="show-more"]'],
    "fallback": ['[class*="jobs-description"]', "article", "main"],
    "fallback_drop": [
        "nav", "header", "aside", '[class*="messaging"]', '[class*="global-nav"]', '[class*="artdeco-modal"]',
        "button", "form",
    ],
}
ROCKETSHIP_DROP = ["script", "style", "nav", "header", "footer", '[class*="similar"]', '[class*="Similar"]']
MIN_DESCRIPTION = {"wellfound": 500, "linkedin": 200}
COMPLETE_LENGTH = 500
SOURCE_NAMES = {
    "wellfound": "Wellfound", "remoterocketship": "Remote Rocketship", "linkedin": "LinkedIn", "generic": "Generic",
}

FIELDS = ["title", "salary", "company", "location", "description"]
SITE_RULES = {"wellfound": WELLFOUND, "linkedin": LINKEDIN}


#: Rows that a table of sites may have. Its rules go to every worker.
SITE_ROWS = 10_000
SITE_FIELDS = ["title", "salary", "company", "location", "description", "description_drop", "fallback", "fallback_drop"]
MIN_DESCRIPTION_OF_OTHERS = 200


def site_rules(table: DataFrame) -> tuple[dict, dict]:
    """Rules and hosts of further sites from a table with `site`, `host`, `field`, `position` and `selector`.

    A row gives one selector of a field (SITE_FIELDS; tried by position) or, where its field is NULL, a host of the site,
    which stands for its subdomains too. What cannot be read raises an error that names it.
    """
    rows = table.select("site", "host", "field", "position", "selector").limit(SITE_ROWS + 1).collect()
    if len(rows) > SITE_ROWS:
        raise ValueError(f"a table of sites may have {SITE_ROWS} rows")
    rules: dict[str, dict[str, list[str]]] = {}
    hosts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["position"] or 0, r["selector"] or "")):
        spec = rules.setdefault(r["site"], {f: [] for f in SITE_FIELDS})
        if r["host"]:
            hosts[r["host"].lower()] = r["site"]
        if r["field"] is None:
            continue
        if r["field"] not in SITE_FIELDS:
            raise ValueError(f"{r['site']}: no field {r['field']}")
        markup.compile_selector(r["selector"])
        spec[r["field"]].append(r["selector"])
    taken = {*SITE_RULES, *SOURCE_NAMES, "greenhouse"} & rules.keys()
    if taken:
        raise ValueError(f"sites with rules of their own: {sorted(taken)}")
    return rules, hosts


def _host_site(url: Column, hosts: dict[str, str]) -> Column:
    """The site that names the URL's host or one it is a subdomain of, the longest name first; else NULL."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    found = F.lit(None).cast("string")
    for name in sorted(hosts, key=len):
        found = F.when((host == name) | F.endswith(host, F.lit("." + name)), hosts[name]).otherwise(found)
    return found


def _one_page(html: str, site: str, rules: dict) -> dict:
    """Candidate texts of one page under one site's rules."""
    root, nodes = markup.parse(html)
    head_title = markup.first(nodes, lambda n: n.tag == "title")
    body = markup.first(nodes, lambda n: n.tag == "body") or root
    out = {"page_title": markup.SPACES.sub(" ", markup.text_content(head_title)).strip(" ") if head_title else ""}
    styles = markup.Styles(nodes)
    out["frames"] = [n.attrs["src"] for n in nodes if n.tag == "iframe" and n.attrs.get("src")]
    if site == "remoterocketship":
        out["body"] = markup.text_content(body, rules[site])
    elif site in rules:
        spec = rules[site]
        for field in ("title", "salary", "company", "location"):
            found = [markup.first(nodes, m) for m in spec.get(field, [])]
            out[field] = [markup.rendered(n, styles) for n in found if n is not None]
        found = [markup.first(nodes, m) for m in spec["description"]]
        out["description"] = [markup.text_content(n, spec["description_drop"]) for n in found if n is not None]
        node = next((n for n in (markup.first(nodes, m) for m in spec["fallback"]) if n is not None), None)
        out["body"] = markup.text_content(node, spec["fallback_drop"]) if node is not None else ""
    else:
        out["body"] = markup.rendered(body, styles)
    return out


def page_candidates(pages: DataFrame, site: str = "site", html: str = "html", more: dict | None = None) -> DataFrame:
    """Replace the HTML column by the texts found under the rules of each page's site, those of `more` sites among them.

    Adds page_title, body (whole-page or fallback text), frames (addresses of embedded pages) and one array per
    field with the text of the first element of each selector that has one, in selector order.
    """
    kept = [f for f in pages.schema.fields if f.name != html]
    added = [StructField("page_title", StringType()), StructField("body", StringType())]
    added += [StructField(f, ArrayType(StringType())) for f in [*FIELDS, "frames"]]
    keep_names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = {
            name: {k: [markup.compile_selector(s) for s in v] for k, v in spec.items()}
            for name, spec in {**SITE_RULES, **(more or {})}.items()
        }
        rules["remoterocketship"] = [markup.compile_selector(s) for s in ROCKETSHIP_DROP]
        for batch in batches:
            rows = [_one_page(h, s, rules) for h, s in zip(batch[html], batch[site])]
            out = batch[keep_names].copy()
            out["page_title"] = [r["page_title"] for r in rows]
            out["body"] = [r["body"] for r in rows]
            for field in [*FIELDS, "frames"]:
                out[field] = [r.get(field) for r in rows]
            yield out

    return pages.mapInPandas(run, StructType(kept + added))


def page_text(pages: DataFrame, mode: str = "rendered", drop: tuple[str, ...] = (), html: str = "html") -> DataFrame:
    """Replace the HTML column by `text`: the body as rendered, or its raw text without the dropped elements."""
    kept = [f for f in pages.schema.fields if f.name != html]
    keep_names = [f.name for f in kept]

    def one(source, tests):
        root, nodes = markup.parse(source)
        body = markup.first(nodes, lambda n: n.tag == "body") or root
        return markup.rendered(body, markup.Styles(nodes)) if mode == "rendered" else markup.text_content(body, tests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = [markup.compile_selector(s) for s in drop]
        for batch in batches:
            yield batch[keep_names].assign(text=[one(h, tests) for h in batch[html]])

    return pages.mapInPandas(run, StructType([*kept, StructField("text", StringType())]))


def drop_elements(pages: DataFrame, selectors: tuple[str, ...], html: str = "html") -> DataFrame:
    """Raw page text without the subtrees that match the selectors."""
    return page_text(pages, "text_content", tuple(selectors), html)


def first_field(candidates: Column, accept) -> Column:
    """The first candidate, trimmed, that the test accepts; '' when none is."""
    trimmed = F.transform(list_or_empty(candidates), trim_browser)
    return F.coalesce(F.get(F.filter(trimmed, accept), 0), F.lit(""))


def _length_between(low: int, high: int):
    return lambda t: (utf16_length(t) > low) & (utf16_length(t) < high)


def _has_money_sign(t: Column) -> Column:
    return F.contains(t, F.lit("$")) | F.contains(t, F.lit("€")) | F.contains(t, F.lit("%"))


def site_fields(candidates: DataFrame) -> DataFrame:
    """Choose title, salary, company, location and description by each site's acceptance tests.

    A site from a table accepts a description of more than 200 characters and any salary with a sign of money.
    """
    wellfound = F.col("site") == "wellfound"
    minimum = F.when(wellfound, MIN_DESCRIPTION["wellfound"]).when(
        F.col("site") == "linkedin", MIN_DESCRIPTION["linkedin"]
    ).otherwise(MIN_DESCRIPTION_OF_OTHERS)
    place = _length_between(0, 200)
    found = first_field(F.col("description"), lambda t: utf16_length(t) > minimum)
    chosen = candidates.withColumns({
        "title": first_field(F.col("title"), _length_between(0, 150)),
        "salary": first_field(F.col("salary"), _has_money_sign),
        "company": first_field(F.col("company"), lambda t: utf16_length(t) > 0),
        "location": first_field(
            F.col("location"), lambda t: place(t) & (wellfound | ~F.contains(t, F.lit("applicants")))
        ),
        "description": found,
    })
    return chosen.withColumn(
        "description", F.when(F.col("description") == "", trim_browser(F.col("body"))).otherwise(F.col("description"))
    )


def _part(label: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(label + ": "), value, F.lit("\n\n"))).otherwise("")


def posting_layout() -> Column:
    """Chosen fields in the order they are shown; blank ones are left out, the description never is."""
    return F.concat(
        _part("JOB TITLE", F.col("title")),
        _part("COMPENSATION", F.col("salary")),
        _part("COMPANY", F.col("company")),
        _part("LOCATION", F.col("location")),
        F.lit("DESCRIPTION:\n"),
        F.col("description"),
    )


def rocketship_cut(body: Column) -> Column:
    for marker in ROCKETSHIP_MARKERS:
        body = cut_at_marker(body, marker)
    return body


def pages_to_text(pages: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Cleaned posting text of each page by the rules of its site.

    Takes pages with `url` and `html` and returns all other columns plus site, page_title and text. `sites` adds sites
    by a table, see `site_rules`; their hosts are asked first.
    """
    kept = [c for c in pages.columns if c != "html"]
    rules, hosts = site_rules(sites) if sites is not None else ({}, {})
    routed = pages.withColumn("site", F.coalesce(_host_site(F.col("url"), hosts), route_source(F.col("url"))))
    fields = site_fields(page_candidates(routed, more=rules))
    ruled = F.col("site").isin([*SITE_RULES, *rules])
    raw = fields.withColumn(
        "_raw",
        F.when(ruled, posting_layout())
        .when(F.col("site") == "remoterocketship", rocketship_cut(F.col("body")))
        .otherwise(F.col("body")),
    ).select(*kept, "site", "page_title", "_raw")
    cleans = ~F.col("site").isin("generic", "greenhouse")
    return clean_columns(raw, "_raw", "text", cleans, F.col("site") == "linkedin").drop("_raw")


def clean_columns(df: DataFrame, source: str, target: str, page_rules: Column, linkedin_rules: Column) -> DataFrame:
    """Cleaned text in `target`, for rows where a rule set applies; one column per part, so that no chain of
    replacements is evaluated twice."""
    parts = ["_stripped", "_cleaned", "_phrased"]

    def where(rules: Column, part, name: str) -> Column:
        return F.when(rules, part(F.col(name))).otherwise(F.col(name))

    return (
        df.withColumn(parts[0], where(page_rules, strip_markup, source))
        .withColumn(parts[1], where(page_rules, strip_page_phrases, parts[0]))
        .withColumn(parts[2], where(linkedin_rules, strip_linkedin_phrases, parts[1]))
        .withColumn(target, where(linkedin_rules, finish_linkedin, parts[2]))
        .drop(*parts)
    )


def clean_text(df: DataFrame, source: str = "text") -> DataFrame:
    """The page clean-up over a text column."""
    return clean_columns(df, source, source, F.lit(True), F.lit(False))


def clean_linkedin_text(df: DataFrame, source: str = "text") -> DataFrame:
    """The page and LinkedIn clean-up over a text column."""
    return clean_columns(df, source, source, F.lit(True), F.lit(True))


def wellfound_text(pages: DataFrame) -> DataFrame:
    return pages_to_text(pages).filter(F.col("site") == "wellfound")


def linkedin_text(pages: DataFrame) -> DataFrame:
    return pages_to_text(pages).filter(F.col("site") == "linkedin")


def rocketship_text(pages: DataFrame) -> DataFrame:
    return pages_to_text(pages).filter(F.col("site") == "remoterocketship")


def board_links(pages: DataFrame) -> DataFrame:
    """Board token and job id of the pages that show a job-board posting.

    The token stands in the page's own URL or, for an embedded posting, in the first frame that names one; it
    is NULL when neither does.
    """
    ids = pages.withColumn("_board", board_ids(F.col("url"))).filter(F.col("_board").isNotNull())
    framed = page_candidates(ids.withColumn("site", F.lit("greenhouse")))
    token = F.coalesce(F.col("_board.board_token"), board_token_from_frames(F.col("frames")))
    kept = [c for c in pages.columns if c != "html"]
    return framed.select(*kept, F.col("_board.job_id").alias("job_id"), token.alias("board_token"))


def board_text(jobs: DataFrame) -> DataFrame:
    """Posting text of job-board records; the description is the raw text of their HTML content."""
    departments = F.array_join(
        F.transform(list_or_empty(F.col("departments.name")), lambda n: F.coalesce(n, F.lit(""))), ", "
    )
    blank = F.lit("")
    flat = jobs.select(
        F.coalesce("title", blank).alias("title"),
        or_default(F.col("location.name"), "Not specified").alias("location"),
        or_default(departments, "Not specified").alias("department"),
        F.coalesce("absolute_url", blank).alias("url"),
        F.coalesce("updated_at", blank).alias("updated_at"),
        "content",
    )
    layout = F.concat(
        F.lit("\nJOB TITLE: "), F.col("title"),
        F.lit("\n\nLOCATION: "), F.col("location"),
        F.lit("\n\nDEPARTMENT: "), F.col("department"),
        F.lit("\n\nDESCRIPTION:\n"), F.col("text"),
        F.lit("\n\nURL: "), F.col("url"),
        F.lit("\nUPDATED: "), F.col("updated_at"),
        F.lit("\nSOURCE: Greenhouse API\n"),
    )
    return page_text(flat, "text_content", html="content").select("title", "url", layout.alias("text"))


def capture_envelope(texts: DataFrame) -> DataFrame:
    """Captures from posting texts (url, site, page_title, text): the text is wrapped, its length is from before.

    A NULL URL is blank; a NULL text stays NULL, which extraction refuses.
    """
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    source = F.coalesce(F.try_element_at(names, F.col("site")), F.lit(SOURCE_NAMES["generic"]))
    return texts.withColumns({
        "contentLength": utf16_length(F.col("text")),
        "text": F.concat(
            F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\nSOURCE: "), source, F.lit(" (Scraped)\n\n"), F.col("text"),
            F.lit("\n"),
        ),
    }).withColumnRenamed("page_title", "title")


def is_complete(content_length: Column) -> Column:
    """Whether a capture is long enough to end its collection early."""
    return content_length > COMPLETE_LENGTH


def first_capture(captures: DataFrame, key: str = "capture_id", order: str = "ts") -> DataFrame:
    """Of all frames of a capture the one that arrived first, whatever its length; one without a time is first."""
    others = [c for c in captures.columns if c != key]
    return captures.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(order)).alias("f")).select(
        key, *[F.col(f"f.{c}").alias(c) for c in others]
    )
