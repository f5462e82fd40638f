from pyspark.sql import functions as F

from vacanta.functions import cleaning, rules, text, urls


def test_trim_takes_all_browser_whitespace(values):
    assert values(text.trim_browser, ["﻿  a b　\n", "\u0085x\u0085"]) == ["a b", "\u0085x\u0085"]
    assert values(text.trim_decoder, ["\u0085 a\t", "﻿x"]) == ["a", "﻿x"]


def test_utf16_length(values):
    assert values(text.utf16_length, ["", "aé", "a😀"]) == [0, 2, 3]


def test_marker_at_start_is_not_cut(values):
    cut = lambda c: text.cut_at_marker(c, "MARK")
    assert values(cut, ["MARK a", "a MARK b MARK", "none", ""]) == ["MARK a", "a ", "none", ""]


def test_strip_fences(values):
    cases = ["```json\n{}\n```", "```\n{}\n```", " {} ", "```json```{}", "```JSON\n{}```", "``````json{}"]
    assert values(text.strip_fences, cases) == ["{}", "{}", "{}", "{}", "JSON\n{}", "```json{}"]


def test_strip_fences_like_three_replacements(values):
    import itertools
    import re

    cases = ["".join(x) for n in range(5) for x in itertools.product(["```", "```json", "`", " ", "\u2003\n", "é{}"], repeat=n)]

    def want(response):
        space = text.DECODER_SPACE_CHARS
        body = re.sub(r"\A```json", "", response.strip(space))
        return re.sub(r"```\Z", "", re.sub(r"\A```", "", body)).strip(space)

    assert values(text.strip_fences, [*cases, None]) == [*map(want, cases), None]


def test_extract_url(values):
    cases = ["a\nURL: https://x/1 \nURL: other", "CURL:b", "nothing", "URL:\nnext", "URL: c\r\n"]
    assert values(text.extract_url, cases) == ["https://x/1", "b", "", "", "c"]


PAGE_CASES = {
    "a@font-face {x: y} b": "a b",
    "a /* c\nd */ b": "a  b",
    "a { x\ny } b": "a  b",
    "a https://x.y/z?q=1 b http://c": "a  b",
    "x My-Font.WOFF2 y arial.ttf z": "x  y  z",
    "a\n\n\nb": "a b",
    "a\n\nb": "a\n\nb",
    "a  ﻿ b": "a b",
    "a DiscoverFind JobsFor Recruiters x Sign Up b": "a  b",
    "a\nCopyright 2024 x": "a",
    "a\nCopyright x\nb": "a\nCopyright x\nb",
    "a\n© 2024 inc": "a",
    "a © inc": "a © inc",
    "a\ncookie preferences x\nkeep": "a\n\nkeep",
    "a Browse by: x\nkeep": "a \nkeep",
    "a Similar jobs zzz\nkeep": "a \nkeep",
    "Find Your Dream Remote Job now\nkeep": "keep",
    "Loved by 100 happy remote workers ok": "ok",
    "Wall of Love x": "",
    "Frequently asked questions x": "",
    "  plain  ": "plain",
}


def test_page_rules_one_by_one(values):
    got = dict(zip(PAGE_CASES, values(cleaning.clean_text, list(PAGE_CASES))))
    assert got == PAGE_CASES


def test_phrase_before_final_newline_is_kept_as_the_browser_does(values):
    # The end of the text is the end, a final newline is not it. The trim comes after.
    assert values(cleaning.clean_text, ["a\nCopyright x\n"]) == ["a\nCopyright x"]


def test_a_removal_may_create_a_later_phrase(values):
    assert values(cleaning.clean_text, ["a\nSimil{x}ar Jobs b", "Copy/* */right x"]) == ["a", ""]


LINKEDIN_CASES = {
    "Skip to search x Skip to main content a": "a",
    "a Keyboard shortcuts b": "a  b",
    "12 notifications total a": "a",
    "a Apply now Reposted 3 days ago b": "a  b",
    "Over 50 people clicked apply a": "a",
    "a Job activity x\nb": "a \nb",
    "Looking for talent? Post a job a": "a",
    "a More jobs x": "a",
    "a Close your conversation with B": "a",
    "Close your conversation with B": "Close your conversation with B",
    "a Powered by Bing x\nb": "a \nb",
}


def test_linkedin_rules(values):
    got = dict(zip(LINKEDIN_CASES, values(cleaning.clean_linkedin_text, list(LINKEDIN_CASES))))
    assert got == LINKEDIN_CASES


def test_cleaning_twice_is_cleaning_once(values):
    once = values(cleaning.clean_text, list(PAGE_CASES))
    assert values(cleaning.clean_text, once) == once


URLS = [
    ("https://boards.greenhouse.io/acme/jobs/123", "greenhouse", ("acme", "123", "direct")),
    ("https://x.com/?gh_jid=77", "greenhouse", (None, "77", "embedded")),
    ("https://x.com/a b?c=1&gh_jid=7%2B1&gh_jid=9#t", "greenhouse", (None, "7+1", "embedded")),
    ("https://x.com/?gh_jid=&gh_jid=5", "generic", None),
    ("https://x.com/#?gh_jid=5", "generic", None),
    ("greenhouse.io/acme/jobs/1", "generic", None),
    ("https://wellfound.com/jobs/1", "wellfound", None),
    ("https://angel.co/jobs/1", "wellfound", None),
    ("https://remoterocketship.com/company/x", "remoterocketship", None),
    ("https://www.linkedin.com/jobs/view/1", "linkedin", None),
    ("https://www.linkedin.com/jobs/search", "generic", None),
    ("not a url", "generic", None),
    ("https://my_host.example/?gh_jid=3", "greenhouse", (None, "3", "embedded")),
    (None, "generic", None),
]


def test_routing(values):
    assert values(urls.route_source, [u for u, _, _ in URLS]) == [s for _, s, _ in URLS]
    ids = [tuple(b) if b is not None else None for b in values(urls.board_ids, [u for u, _, _ in URLS])]
    assert ids == [i for _, _, i in URLS]


def test_board_token_from_frames(spark):
    frames = ["https://a", "https://boards.greenhouse.io/embed?x=1&for=acme&t=2", "https://b.greenhouse.io/?for=late"]
    df = spark.createDataFrame([(frames,), (["https://a"],), ([],)], "f array<string>").coalesce(1)
    got = [r[0] for r in df.select(urls.board_token_from_frames(F.col("f"))).collect()]
    assert got == ["acme", None, None]


def test_years(values):
    fn = lambda c: rules.years_experience(rules.years_text(c, F.lower(c)))
    cases = ["3-5 years", "5+ years of", "2 to 4 yrs", "7 years", "none", "100 years", "10–12+ Years", None, "9" * 30 + " years"]
    got = [tuple(v) for v in values(fn, cases)]
    assert got == [(3, 5), (5, 0), (2, 4), (7, 0), (0, 0), (100, 0), (10, 12), (0, 0), (0, 0)]


def test_salary(values):
    fn = lambda c: rules.salary_range(rules.salary_statement(c, F.lower(c)))
    cases = ["€80k-100k", "$90,000 - $120,000", "GBP 50-60k", "£45k to £50k", "80000 - 90000", "USD 100000–120000",
             "GBP 1000000000-2000000000", "$" + "9" * 18 + "-" + "9" * 30 + "k"]
    got = [tuple(v) for v in values(fn, cases)]
    assert got == [
        (80000, 100000, "EUR"), (90000, 120000, "USD"), (50000, 60000, "GBP"), (45000, 50000, "GBP"), (0, 0, ""),
        (100000, 120000, "USD"), (10**9, 2 * 10**9, "GBP"), (10**18 - 1, 0, "USD"),
    ]


def test_titles(values):
    titles = ["Senior Data Engineer", "Jr. iOS Developer", "Head of Security", "Full-Stack Engineer", ""]
    assert values(rules.seniority, titles) == ["Senior", "Junior", "Lead", "Mid", ""]
    assert values(rules.job_function, titles) == ["Data", "Mobile", "Security", "FullStack", ""]


def test_skills_need_their_own_word(values):
    def fn(c):
        return rules.skills_by_category(rules.known_skills(rules.skill_words(c), F.lower(c)))

    got = values(fn, ["We go to Google Cloud with Go, golang, python. Python C++ and SQL Server.", "good reactor", None])
    assert got[0].programming_languages == ["Go", "Golang", "Python", "C++", "SQL"]
    assert got[0].cloud_platforms == ["Google Cloud"] and got[0].databases == ["SQL Server"]
    assert all(list(v) == [[]] * 6 for v in got[1:])


def test_every_flag_piece_is_part_of_its_words(values):
    texts = [
        "degree in computer science is required", "equity", "home office budget", "we sponsor visas",
        "medical coverage", "paid time off", "conference budget", "401(k)", "Hybrid", "take-home", "pair programming",
    ]
    names = list(rules.FLAG_WORDS)
    got = values(lambda c: rules.flags(c, F.lower(c)), texts)
    assert all(got[i][name] for i, name in enumerate(names))
    # Pieces alone state nothing.
    assert not any(values(lambda c: rules.flags(c, F.lower(c)), ["homework, plans, paid, budgets, pursue, 4010"])[0])
    assert values(lambda c: rules.urgency(c, F.lower(c)), ["ASAP", "hiring immediately", "insurgent"]) == ["Urgent", "Urgent", "Standard"]
