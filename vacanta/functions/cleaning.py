"""Removal of page furniture from posting text: ordered replacements, then a trim."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacanta.functions.text import BROWSER_SPACE, FAST_BROWSER_SPACE, NOT_LINE_END, cut_at_marker, trim_browser

NOT_SPACE = BROWSER_SPACE.replace("[", "[^", 1)
LINE = NOT_LINE_END + "*"
LAZY = NOT_LINE_END + "*?"

# The clean-up phrases and their order decide the text that is kept.
PAGE_RULES = [
    (r"@font-face[\s\S]*?\}", ""),
    (r"/\*[\s\S]*?\*/", ""),
    (r"\{[\s\S]*?\}", ""),
    (rf"https?://{NOT_SPACE}+", ""),
    (r"(?i)[a-z-]+\.(woff2?|ttf|eot)", ""),
    (r"\n{4,}", "\n\n"),
    (BROWSER_SPACE + "{3,}", " "),
    (rf"(?i)DiscoverFind JobsFor Recruiters{LAZY}Sign Up", ""),
    (rf"(?i)Copyright{LINE}\z", ""),
    (rf"(?i)©{LINE}\d{{4}}{LINE}\z", ""),
    (rf"(?i)Cookie Preferences{LINE}", ""),
    (rf"(?i)Browse by:{LINE}", ""),
    (rf"(?i)Similar Jobs{LINE}", ""),
    (rf"(?i)Find Your Dream Remote Job{LINE}", ""),
    (rf"(?i)Loved by \d+{LINE}remote workers", ""),
    (rf"(?i)Wall of Love{LINE}", ""),
    (rf"(?i)Frequently asked questions{LINE}", ""),
]

LINKEDIN_RULES = [
    (rf"(?i)Skip to search{LAZY}Skip to main content", ""),
    (r"(?i)Keyboard shortcuts", ""),
    (r"(?i)\d+ notifications total", ""),
    (r"(?i)Home My Network Jobs Messaging Notifications", ""),
    (r"(?i)Show more options", ""),
    (rf"(?i)Apply{LAZY}Reposted{LAZY}ago", ""),
    (r"(?i)Over \d+ people clicked apply", ""),
    (r"(?i)Responses managed off LinkedIn", ""),
    (rf"(?i)Matches your job preferences{LINE}", ""),
    (r"(?i)No longer accepting applications", ""),
    (rf"(?i)Job activity{LINE}", ""),
    (r"(?i)See more jobs like this", ""),
    (rf"(?i)Learn skills to get a new job{LINE}", ""),
    (rf"(?i)Looking for talent{LINE}Post a job", ""),
    (rf"(?i)About Accessibility{LINE}LinkedIn Corporation", ""),
    (rf"(?i)Status is online Messaging{LINE}", ""),
    (rf"(?i)You are on the messaging overlay{LINE}", ""),
    (r"(?i)Premium insights", ""),
    (rf"(?i)More jobs{LINE}", ""),
    (rf"(?i)Get hired faster with the help of AI tools{LINE}", ""),
    (rf"(?i)See how you compare to others{LINE}", ""),
    (rf"(?i)Exclusive Job Seeker Insights{LINE}", ""),
    (rf"(?i)Powered by Bing{LINE}", ""),
]

LINKEDIN_CHAT_MARKER = "Close your conversation with"
ROCKETSHIP_MARKERS = ["Similar Jobs", "Discover 100,000+ Remote Jobs"]


# A text without any of these, in lower case, holds nothing that the rules of a group could remove, so the
# group is skipped as a whole. Rules are never skipped one by one: a removal may create a later phrase.
_MARKUP_RULES, _SPACE_RULE, _PHRASE_RULES = PAGE_RULES[:6], PAGE_RULES[6], PAGE_RULES[7:]
_MARKUP_SIGNS = ["@font-face", "/*", "{", "http", ".woff", ".ttf", ".eot", "\n\n\n\n"]
_PAGE_SIGNS = [
    "discoverfind jobsfor recruiters", "copyright", "©", "cookie preferences", "browse by:", "similar jobs",
    "find your dream remote job", "loved by ", "wall of love", "frequently asked questions",
]
_LINKEDIN_SIGNS = [
    "skip to search", "keyboard shortcuts", " notifications total", "home my network jobs messaging notifications",
    "show more options", "apply", "responses managed off linkedin",
    "matches your job preferences", "no longer accepting applications", "job activity", "see more jobs like this",
    "learn skills to get a new job", "looking for talent", "about accessibility", "status is online messaging",
    "you are on the messaging overlay", "premium insights", "more jobs",
    "get hired faster with the help of ai tools", "see how you compare to others",
    "exclusive job seeker insights", "powered by bing",
]


def _replace(text: Column, rules) -> Column:
    return reduce(
        lambda acc, rule: F.regexp_replace(acc, rule[0].replace(BROWSER_SPACE, FAST_BROWSER_SPACE), rule[1]), rules, text
    )


def _replace_if(text: Column, signs, rules) -> Column:
    lower = F.lower(text)
    present = reduce(lambda acc, sign: acc | F.contains(lower, F.lit(sign)), signs, F.lit(False))
    return F.when(present, _replace(text, rules)).otherwise(text)


def strip_markup(text: Column) -> Column:
    """First part of the page clean-up: style remains, links, and long runs of whitespace."""
    return _replace(_replace_if(text, _MARKUP_SIGNS, _MARKUP_RULES), [_SPACE_RULE])


def strip_page_phrases(stripped: Column) -> Column:
    """Second part of the page clean-up, for the result of strip_markup."""
    return trim_browser(_replace_if(stripped, _PAGE_SIGNS, _PHRASE_RULES))


def strip_linkedin_phrases(cleaned: Column) -> Column:
    """Second half of the LinkedIn clean-up, for the result of clean_text."""
    return _replace_if(cleaned, _LINKEDIN_SIGNS, LINKEDIN_RULES)


def finish_linkedin(stripped: Column) -> Column:
    return trim_browser(cut_at_marker(stripped, LINKEDIN_CHAT_MARKER))


def clean_text(text: Column) -> Column:
    """The whole page clean-up. Each part reads its input more than once, so for much text put every
    part in a column of its own, as vacanta.operators.pages.clean_columns does."""
    return strip_page_phrases(strip_markup(text))


def clean_linkedin_text(text: Column) -> Column:
    """Page clean-up, LinkedIn phrases, then a cut before the chat panel."""
    return finish_linkedin(strip_linkedin_phrases(clean_text(text)))
