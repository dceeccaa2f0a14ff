"""String functions: Column to Column, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in lexical search.
STOP_WORDS = """
a an the is are was were be been being have has had do does did
will would could should may might shall can of in on at to for
with by from as into through during before after above below
between out off over under again further then once here there
when where why how all both each few more most other some such
no nor not only own same so than too very just i me my we our
you your he she it its they them their what which who this that
these those am and but or if while s t re ve ll d m
""".split()

# Names and patterns of unsafe input, in the order of their report.
GUARD_RULES = [
    ("instruction_override", r"ignore\s+(all\s+)?(previous|prior|above|earlier|preceding)\s+(instructions?|prompts?|context|rules?|guidelines?)"),
    ("role_hijacking", r"you\s+are\s+(now|no\s+longer)\s+(a|an|the)?\s*\w+"),
    ("system_prompt_leak", r"(repeat|show|reveal|display|print|output)\s+(the\s+)?(exact|full|original|entire|complete)?\s*(system\s+)?(prompt|instructions?|rules?|guidelines?)"),
    ("new_instruction", r"\b(new|updated?|revised?|override)\s+(system\s+)?(instruction|prompt|directive|command|role)"),
    ("context_escape", r"(end\s+of\s+(context|instructions?|prompt|document)|<\/?(system|instruction|prompt|context)>|\[\s*\/?\s*(SYSTEM|INST|SYS|INSTRUCTION)\s*\])"),
    ("roleplay", r"\b(act\s+as|pretend\s+(to\s+be|you\s+are)|simulate|roleplay|role-play)\b"),
    ("format_hijack", r"return\s+(this|the\s+following)\s+(json|xml|html|text)\s*(instead|:)"),
]
REJECTION = "Input rejected: detected prompt injection ("
#: Beyond the ASCII blanks, the separators of Unicode count as blank.
BLANK = r"^[\p{Z}\s]*$"


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def strip(text: Column) -> Column:
    """Without white space (tab and newline too) at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """True for null, '' and white space alone."""
    return text.isNull() | text.rlike(BLANK)


def normalize(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def fingerprint(text: Column) -> Column:
    """Hex SHA-256 of the normalised text; null counts as ''."""
    return F.sha2(normalize(F.coalesce(text, F.lit(""))), 256)


def eval_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 of two or more characters; [] for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0)), none_of("string"))


def index_tokens(text: Column) -> Column:
    """eval_tokens() without stop words."""
    return F.filter(eval_tokens(text), lambda x: ~x.isin(STOP_WORDS))


def detections(text: Column) -> Column:
    """Names of the guard rules that match, in the rules' order; [] for null."""
    hits = F.array(*[F.when(F.coalesce(text, F.lit("")).rlike("(?i)" + p), F.lit(n)) for n, p in GUARD_RULES])
    return F.filter(hits, lambda x: x.isNotNull())


def is_safe(text: Column) -> Column:
    return F.size(detections(text)) == 0


def rejection_message(text: Column) -> Column:
    """Null for safe text."""
    found = detections(text)
    return F.when(F.size(found) > 0, F.concat(F.lit(REJECTION), F.array_join(found, ", "), F.lit(")")))


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero after scaling, as databases round doubles: F.round() goes by the shortest decimal, and 14.549999999999999 * 10 is 145.5."""
    scale = float(10**digits)
    return F.round(x * scale) / scale


def percent(share: Column) -> Column:
    return F.concat(rounded(share * 100, 1).cast("string"), F.lit("%"))


def span(text: Column, start: Column, end: Column) -> Column:
    """Characters start to end - 1, counted from 0."""
    return F.substring(text, start + 1, end - start)


def with_context(context: Column, content: Column) -> Column:
    """``context content``, or the content alone if the context is blank."""
    return F.when(is_blank(context), content).otherwise(F.concat_ws(" ", context, content))


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(part))


def sub_queries(response: Column, query: Column) -> Column:
    """The non-empty lines of a decomposition without their numbers; the query itself if there are none.

    A number goes before the line is stripped, so an indented number stays.
    """
    lines = F.transform(F.split(strip(F.coalesce(response, F.lit(""))), "\n"), lambda x: strip(F.regexp_replace(x, r"^\d+[.)]\s*", "")))
    kept = F.filter(lines, lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(query))


def rerank_scores(response: Column, n: Column) -> Column:
    """n scores from 0 to 10 out of a model's answer: its first list of numbers, or n tens."""
    parsed = F.from_json(F.regexp_extract(F.coalesce(response, F.lit("")), r"\[\s*\d[\d\s,]*\]", 0), "array<double>")
    sound = F.coalesce((F.size(parsed) == n) & ~F.exists(parsed, lambda x: x.isNull()), F.lit(False))
    return F.when(sound, F.transform(parsed, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(10.0)).cast("int"))).otherwise(F.array_repeat(F.lit(10), n))
