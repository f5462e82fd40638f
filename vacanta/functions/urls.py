"""Routing by URL and job-board identifiers, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL fragments that identify each site.
WELLFOUND_PARTS = ["wellfound.com/jobs/", "angel.co/jobs/"]
ROCKETSHIP_PARTS = ["remoterocketship.com/company/"]
LINKEDIN_PARTS = ["linkedin.com/jobs/view/"]
BOARD_PATH = r"greenhouse\.io/([^/]+)/jobs/([0-9]+)"
BOARD_JOB_PARAM = "gh_jid"
BOARD_FRAME = r"greenhouse\.io[^\n\r\x{2028}\x{2029}]*[?&]for=([^&]+)"

# An absolute URL: for the web schemes a non-empty host without forbidden characters, for others a scheme.
# Java's URI class is no substitute, it refuses hosts and characters that browsers accept.
WEB_SCHEME = r"(?i)^(https?|wss?|ftp):"
WEB_URL = (
    r"(?i)^(https?|wss?|ftp):[/\\]*([^/\\?#@]*@)?"
    r"(\[[0-9a-f:.]+\]|[^\x00-\x20/\\?#:@<>^|%\[\]]+)(:[0-9]{0,5})?([/\\?#]|\z)"
)
ANY_SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*:"


def is_absolute_url(url: Column) -> Column:
    return F.coalesce(
        F.when(url.rlike(WEB_SCHEME), url.rlike(WEB_URL)).otherwise(url.rlike(ANY_SCHEME)), F.lit(False)
    )


def query_param(url: Column, name: str) -> Column:
    """Decoded value of the first query parameter with this name, NULL when absent."""
    pairs = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")

    def decode(part: Column) -> Column:
        return F.coalesce(F.try_url_decode(part), part)

    hits = F.filter(pairs, lambda p: decode(F.regexp_extract(p, r"^([^=]*)", 1)) == name)
    return decode(F.regexp_extract(F.get(hits, 0), r"^[^=]*=?([\s\S]*)", 1))


def board_ids(url: Column) -> Column:
    """struct(board_token, job_id, type): 'direct' from the path, 'embedded' from the query, else NULL."""
    job_id = F.nullif(F.regexp_extract(url, BOARD_PATH, 2), F.lit(""))
    embedded = F.nullif(query_param(url, BOARD_JOB_PARAM), F.lit(""))
    none = F.lit(None).cast("string")
    return F.when(
        is_absolute_url(url) & job_id.isNotNull(),
        F.struct(
            F.regexp_extract(url, BOARD_PATH, 1).alias("board_token"),
            job_id.alias("job_id"),
            F.lit("direct").alias("type"),
        ),
    ).when(
        is_absolute_url(url) & embedded.isNotNull(),
        F.struct(none.alias("board_token"), embedded.alias("job_id"), F.lit("embedded").alias("type")),
    )


def board_token_from_frames(frame_urls: Column) -> Column:
    """Board token named by the first frame URL that carries one, NULL when none does."""
    hits = F.filter(frame_urls, lambda u: u.rlike(BOARD_FRAME))
    return F.regexp_extract(F.get(hits, 0), BOARD_FRAME, 1)


def _has_any(url: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(url, F.lit(part))
    return F.coalesce(found, F.lit(False))


def is_wellfound(url: Column) -> Column:
    return _has_any(url, WELLFOUND_PARTS)


def is_rocketship(url: Column) -> Column:
    return _has_any(url, ROCKETSHIP_PARTS)


def is_linkedin(url: Column) -> Column:
    return _has_any(url, LINKEDIN_PARTS)


def route_source(url: Column) -> Column:
    """Name of the rule set for a page; the first test that holds wins."""
    return (
        F.when(board_ids(url).isNotNull(), "greenhouse")
        .when(is_wellfound(url), "wellfound")
        .when(is_rocketship(url), "remoterocketship")
        .when(is_linkedin(url), "linkedin")
        .otherwise("generic")
    )
