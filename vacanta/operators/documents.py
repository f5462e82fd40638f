"""From posting text to the nested posting document, and from the document to table rows."""

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from vacanta.functions import rules
from vacanta.functions.postings import join_list, list_or_empty, zero_filled
from vacanta.functions.text import bound, extract_url, is_blank, strip_fences, trim_decoder
from vacanta.schemas import (
    CATEGORIES,
    JOB_FUNCTIONS,
    POSTING_SCHEMA,
    SENIORITY,
    SKILL_FIELDS,
)

# ---------------------------------------------------------------- prompt

PROMPT_INTRO = (
    "Read the job posting below and answer with one JSON object that describes it. "
    "Use only facts the posting states.\n\nPosting:\n"
)

_FIELD_HINTS = {
    "seniority_level": "|".join(SENIORITY),
    "job_function": "|".join(JOB_FUNCTIONS),
    "education_level": "None|Bachelor's|Master's|PhD",
    "salary_currency": "USD|EUR|GBP or empty",
    "workplace_type": "Remote|Hybrid|On-site",
    "job_type": "Full-time|Part-time|Contract|Internship",
    "timezone_requirements": "EMEA|US|APAC|Flexible or empty",
    "urgency_level": "Standard|Urgent|Immediate",
}


def _skeleton(schema: StructType, depth: int = 1) -> str:
    pad = "  " * depth
    lines = []
    for field in schema.fields:
        kind = field.dataType.simpleString()
        if isinstance(field.dataType, StructType):
            value = _skeleton(field.dataType, depth + 1)
        elif kind == "array<string>":
            value = "[]"
        elif kind == "bigint":
            value = "0"
        elif kind == "boolean":
            value = "false"
        else:
            value = f'"{_FIELD_HINTS.get(field.name, "")}"'
        lines.append(f'{pad}"{field.name}": {value}')
    return "{\n" + ",\n".join(lines) + "\n" + "  " * (depth - 1) + "}"


# Left open at the end: the stamp and the URL of the request close it.
PROMPT_SHAPE = "\n\nShape of the answer:\n" + _skeleton(
    StructType([f for f in POSTING_SCHEMA.fields if f.name not in ("extracted_at", "source_url")])
)[:-2]

PROMPT_RULES = """

Rules:
- Years of experience: "3-5 years" is 3 and 5, "5+ years" is 5 and 0.
- Seniority comes from the title, the function from the kind of role.
- Salaries are whole numbers: "€80k-100k" is 80000 and 100000.
- Skills are short names, not sentences.
- A flag is true only when the posting says so.
- Urgency is "Urgent" for immediate, ASAP or urgent, otherwise "Standard".
Answer with the JSON object alone."""


def build_prompt(text: Column, source_url: Column, stamp: Column) -> Column:
    """Prompt for one posting: text, time stamp and URL set into a fixed template; what is NULL is left blank."""
    text, source_url, stamp = (F.coalesce(c, F.lit("")) for c in (text, source_url, stamp))
    return F.concat(
        F.lit(PROMPT_INTRO), text, F.lit(PROMPT_SHAPE),
        F.lit(',\n  "extracted_at": "'), stamp, F.lit('",\n  "source_url": "'), source_url, F.lit('"\n}'),
        F.lit(PROMPT_RULES),
    )


def local_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX")


# ---------------------------------------------------------------- parsing

_CORRUPT = "_corrupt"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_ONLY = f"_{uuid.uuid4().hex}"
_SYNTAX_ONLY = ArrayType(StructType([StructField("source_url", StringType())]))


def parse_posting(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Add `posting` (zero-filled document) and `reject_reason` (NULL when the document is accepted).

    A document of the wrong type is refused, and so is text after the object. Unknown keys are ignored.
    Use `accepted` and `rejected` to split the result; a refused row's `posting` has no meaning.
    """
    text = F.col(json_col)
    permissive = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, **_STRICT}
    corrupt = StructField(_CORRUPT, StringType())
    # As the only member of an array, an object followed by anything else no longer parses. The array stands below a name
    # that no text holds, so that one parse finds both the document and text after it.
    inside = F.concat(F.lit(f'{{"{_ONLY}":['), text, F.lit("]}"))
    only = F.from_json(inside, StructType([StructField(_ONLY, ArrayType(POSTING_SCHEMA)), corrupt]), permissive)
    # The one-row explodes keep the optimizer from copying the parse into every later use of its fields,
    # which would parse the text once per use and make the plan grow without end.
    looked = df.select(*df.columns, F.explode(F.array(only)).alias("_o"))
    first = F.get(F.col(f"_o.{_ONLY}"), F.lit(0))
    good = F.col(f"_o.{_CORRUPT}").isNull() & (F.size(F.col(f"_o.{_ONLY}")) == 1) & first.isNotNull()

    def judged(typed: Column) -> Column:
        """The document and the reason why it is refused, if it is, of a text that is not simply one good object."""
        alone = F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), _SYNTAX_ONLY, _STRICT)) == 1
        typed_ok = typed.isNotNull() & typed.getField(_CORRUPT).isNull()
        reason = (
            F.when(is_blank(text), "empty response")
            .when(F.coalesce(trim_decoder(text) == "null", F.lit(False)), None)
            .when(~F.coalesce(alone, F.lit(False)), "not a single JSON object")
            .when(~typed_ok, "wrong type in a field")
        )
        doc = F.struct(*[typed.getField(f.name).alias(f.name) for f in POSTING_SCHEMA.fields])
        return F.struct(doc.alias("doc"), reason.cast("string").alias("reason"))

    typed = F.from_json(text, StructType([*POSTING_SCHEMA.fields, corrupt]), permissive)
    taken = F.struct(first.alias("doc"), F.lit(None).cast("string").alias("reason"))
    once = F.when(F.coalesce(good, F.lit(False)), taken).otherwise(bound(typed, judged))
    parsed = looked.select(*df.columns, F.explode(F.array(once)).alias("_p"))
    return parsed.select(*df.columns, F.col("_p.reason").alias("reject_reason"), zero_filled("_p.doc").alias("posting"))


def parse_stored(df: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """Add `posting` and `unreadable` from documents that `posting_json` wrote: one parse, no checks of form.

    An unreadable document keeps its row, with an empty posting.
    """
    schema = StructType([*POSTING_SCHEMA.fields, StructField(_CORRUPT, StringType())])
    doc = F.from_json(json_col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    once = df.select(*df.columns, F.explode(F.array(doc)).alias("_p"))
    broken = F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull()
    return once.select(*df.columns, zero_filled("_p").alias("posting"), broken.alias("unreadable"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).drop("posting")


def resolve_source_url(df: DataFrame, setting: str = "source_url") -> DataFrame:
    """A non-empty URL given with the request replaces the one in the document."""
    chosen = F.when(is_blank(F.col(setting)), F.col("posting.source_url")).otherwise(F.col(setting))
    return df.withColumn("posting", F.col("posting").withField("source_url", chosen))


# ---------------------------------------------------------------- extraction

# Provider names and the models used when a request names none.
CLOUD_PROVIDER = "perplexity"
DEFAULT_MODELS = {"perplexity": "sonar-pro", "ollama": "qwen2.5:7b"}

NO_TEXT = "no text"
CALL_FAILED = "model call failed"

# Fixed value: how many seconds a model call may take.
CALL_SECONDS = 60.0
#: Rows that one call gets at most.
CALL_ROWS = 64

ModelFn = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]


def _call(fn: ModelFn, rows: pd.DataFrame, seconds: float) -> list[str | None]:
    """The model's answers to these rows; raises if it fails, is late, or answers another number of rows.

    A late call cannot be stopped. It goes on in a thread that nobody waits for, and its answers are dropped.
    """
    out: dict = {}

    def run() -> None:
        try:
            out["answers"] = list(fn(rows["prompt"], rows["provider"], rows["model"]))
        except BaseException as error:  # noqa: BLE001  whatever a model raises is a call that failed
            out["error"] = error if isinstance(error, Exception) else RuntimeError(repr(error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TimeoutError(f"no answer in {seconds:g} s")
    if "error" in out:
        raise out["error"]
    if len(out["answers"]) != len(rows):
        raise ValueError(f"{len(out['answers'])} answers to {len(rows)} prompts")
    return [None if a is None or a != a else str(a) for a in out["answers"]]


def _asked(fn: ModelFn, rows: pd.DataFrame, seconds: float) -> tuple[list[str | None], list[str | None]]:
    """Answers and failures, row by row. Rows of a call that fails are asked again in halves, down to single rows."""
    answers: list[str | None] = [None] * len(rows)
    failures: list[str | None] = [None] * len(rows)
    left = [(0, len(rows))]
    while left:
        begin, end = left.pop()
        try:
            answers[begin:end] = _call(fn, rows.iloc[begin:end], seconds)
        except Exception as error:  # noqa: BLE001
            if end - begin == 1:
                failures[begin] = f"{CALL_FAILED}: {type(error).__name__}: {error}"[:500]
            else:
                middle = (begin + end) // 2
                left += [(middle, end), (begin, middle)]
    return answers, failures


def extract_with(
    requests: DataFrame, fn: ModelFn, stamp: Column | None = None, seconds: float = CALL_SECONDS, rows: int = CALL_ROWS,
) -> DataFrame:
    """Run a model over request rows and parse its answers.

    Rows have `text` and may have `source_url`, `provider` and `model`; blank ones get their defaults.
    `fn(prompts, providers, models)` gets up to `rows` rows as pandas Series and returns the responses. It has
    `seconds` for them. If it raises, is late or returns another number of answers, its rows are asked again in halves;
    a row that fails alone is refused with the reason, and all others are kept. So one row costs no more than itself.

    A call is made again when its executor is lost, so write the result once before using it twice. A row without
    text never reaches the model and is refused.
    """
    stamp = local_stamp(F.current_timestamp()) if stamp is None else stamp
    missing = [c for c in ("source_url", "provider", "model") if c not in requests.columns]
    requests = requests.withColumns({c: F.lit("") for c in missing})
    provider = F.when(F.col("provider") == CLOUD_PROVIDER, CLOUD_PROVIDER).otherwise("ollama")
    default = F.when(F.col("provider") == CLOUD_PROVIDER, DEFAULT_MODELS[CLOUD_PROVIDER]).otherwise(
        DEFAULT_MODELS["ollama"]
    )
    prepared = requests.withColumns({
        "provider": provider,
        "model": F.when(is_blank(F.col("model")), default).otherwise(F.col("model")),
        "prompt": build_prompt(F.col("text"), extract_url(F.col("text")), stamp),
    })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at:at + rows]
                known = part[part["text"].notna()]
                answers, failures = _asked(fn, known, seconds) if len(known) else ([], [])
                yield part.drop(columns="prompt").assign(**{
                    name: pd.Series(values, index=known.index, dtype=object).reindex(part.index)
                    for name, values in (("response", answers), ("_failure", failures))
                })

    out_schema = StructType(
        [f for f in prepared.schema.fields if f.name != "prompt"]
        + [StructField("response", StringType()), StructField("_failure", StringType())]
    )
    answered = prepared.mapInPandas(run, out_schema)
    parsed = parse_posting(answered.withColumn("json", strip_fences(F.col("response"))), "json")
    reason = F.when(F.col("text").isNull(), NO_TEXT).otherwise(F.coalesce("_failure", "reject_reason"))
    return resolve_source_url(parsed.drop("json").withColumn("reject_reason", reason).drop("_failure"))


def _line_after(text: Column, label: str) -> Column:
    """The rest of the first line that starts with a label, '' when there is none."""
    after = F.split_part(F.concat(F.lit("\n"), text), F.lit(f"\n{label}:"), F.lit(2))
    return trim_decoder(F.substring_index(after, "\n", 1))


def rules_extract(df: DataFrame, text_col: str = "text", stamp: Column | None = None) -> DataFrame:
    """Add a `posting` read from the text by rules alone; only a row without text is refused (`reject_reason`).

    A non-empty `source_url` or else `url` of the row is the posting's URL, whatever its text says.
    """
    stamp = F.lit("") if stamp is None else stamp
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = df.withColumns({
        "_words": rules.skill_words(text),
        "_lower": F.lower(text),
        "_title": _line_after(text, "JOB TITLE"),
        "_place": _line_after(text, "LOCATION"),
    }).withColumns({
        "_years": rules.years_text(text, F.col("_lower")),
        "_salary": rules.salary_statement(text, F.col("_lower")),
        "_urgency": rules.urgency(text, F.col("_lower")),
        "_flags": rules.flags(text, F.col("_lower")),
        "_found": rules.known_skills(F.col("_words"), F.col("_lower")),
    })
    years, salary = rules.years_experience(F.col("_years")), rules.salary_range(F.col("_salary"))
    blank, empty, zero = F.lit(""), F.array().cast("array<string>"), F.lit(0).cast("bigint")
    values = {
        "metadata.job_title": F.col("_title"),
        "metadata.department": _line_after(text, "DEPARTMENT"),
        "metadata.seniority_level": rules.seniority(F.col("_title")),
        "metadata.job_function": rules.job_function(F.col("_title")),
        "company_info.company_name": _line_after(text, "COMPANY"),
        "company_info.location_full": F.col("_place"),
        "company_info.location_city": trim_decoder(F.regexp_extract(F.col("_place"), r"^([^,]*),", 1)),
        "requirements.years_experience_min": years.getField("min"),
        "requirements.years_experience_max": years.getField("max"),
        "requirements.technical_skills": rules.skills_by_category(F.col("_found")),
        "compensation.salary_min": salary.getField("min"),
        "compensation.salary_max": salary.getField("max"),
        "compensation.salary_currency": salary.getField("currency"),
        "market_signals.urgency_level": F.col("_urgency"),
        "extracted_at": stamp,
        "source_url": extract_url(text),
    }

    def build(schema: StructType, prefix: str) -> Column:
        parts = []
        for field in schema.fields:
            path, kind = prefix + field.name, field.dataType
            if path in values:
                part = values[path]
            elif isinstance(kind, StructType):
                part = build(kind, path + ".")
            elif field.name in rules.FLAG_WORDS:
                part = F.col(f"_flags.{field.name}")
            elif kind.simpleString() == "array<string>":
                part = empty
            elif kind.simpleString() == "bigint":
                part = zero
            else:
                part = blank
            parts.append(part.alias(field.name))
        return F.struct(*parts)

    done = facts.withColumns({"posting": build(POSTING_SCHEMA, ""), "reject_reason": F.when(F.col(text_col).isNull(), NO_TEXT)})
    given = next((c for c in ("source_url", "url") if c in df.columns), None)
    done = resolve_source_url(done, given) if given else done
    return done.drop(
        "_words", "_lower", "_title", "_place", "_years", "_salary", "_urgency", "_flags", "_found"
    )


# ---------------------------------------------------------------- flatten and explode

# The bullet between responsibilities, and the scalar columns of a row by document part.
LIST_BREAK = "\n• "
FLAT_FIELDS = [
    ("metadata", ["job_title"]),
    ("company_info", [
        "company_name", "company_size", "industry", "location_full", "location_city", "location_country",
    ]),
    ("metadata", ["seniority_level", "department", "job_function"]),
    ("work_arrangement", ["workplace_type", "job_type", "is_remote_friendly", "timezone_requirements"]),
    ("requirements", [
        "years_experience_min", "years_experience_max", "education_level", "requires_specific_degree",
    ]),
    ("compensation", [
        "salary_min", "salary_max", "salary_currency", "has_equity", "has_remote_stipend",
        "offers_visa_sponsorship", "offers_health_insurance", "offers_pto", "offers_professional_development",
        "offers_401k",
    ]),
    ("market_signals", ["urgency_level", "interview_rounds", "has_take_home", "has_pair_programming"]),
]


def posting_json(posting: Column) -> Column:
    return F.to_json(posting, {"ignoreNullFields": "false"})


def flatten_posting(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One `jobs` row (the inserted columns) per posting, plus the columns named in `keep`."""
    p = "posting."
    scalars = [F.col(f"{p}{group}.{name}").alias(name) for group, names in FLAT_FIELDS for name in names]
    return df.select(
        *keep,
        F.col(p + "source_url").alias("source_url"),
        F.col(p + "extracted_at").alias("extracted_at_raw"),
        F.try_to_timestamp(F.col(p + "extracted_at")).alias("extracted_at"),
        *scalars,
        F.col(p + "role_details.summary").alias("summary"),
        join_list(F.col(p + "role_details.key_responsibilities"), LIST_BREAK).alias("key_responsibilities"),
        F.col(p + "role_details.team_structure").alias("team_structure"),
        join_list(F.col(p + "compensation.benefits"), ", ").alias("benefits"),
        join_list(F.col(p + "requirements.soft_skills"), ", ").alias("soft_skills"),
        join_list(F.col(p + "requirements.nice_to_have"), "; ").alias("nice_to_have"),
        F.lit("saved").alias("status"),
        posting_json(F.col("posting")).alias("raw_json"),
    )


def _with_category(names: Column, category: str) -> Column:
    return F.transform(names, lambda s: F.struct(s.alias("skill_name"), F.lit(category).alias("skill_category")))


def explode_skills(df: DataFrame, job_id: str = "job_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One job_skills row per non-empty skill name, categories in their fixed order, duplicates kept."""
    tech = F.col("posting.requirements.technical_skills")
    tagged = [_with_category(list_or_empty(tech.getField(f)), c) for f, c in zip(SKILL_FIELDS, CATEGORIES)]
    rows = df.select(*keep, F.col(job_id).alias("job_id"), F.posexplode(F.concat(*tagged)).alias("pos", "skill"))
    return rows.filter(F.col("skill.skill_name") != "").select(
        F.xxhash64("job_id", "pos").alias("id"),
        "job_id",
        F.col("skill.skill_name").alias("skill_name"),
        F.col("skill.skill_category").alias("skill_category"),
        F.lit(True).alias("is_required"),
        *keep,
    )
