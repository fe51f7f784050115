"""Scalar functions over names, paths and source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normal_path(path: Column) -> Column:
    """Forward slashes, none at either end."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")


def path_parts(path: Column) -> Column:
    return F.filter(F.split(normal_path(path), "/"), lambda p: p != "")


def parent_path(path: Column) -> Column:
    """The directory of a normal path, null at the top."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))


def ancestors(path: Column, depth: int = 4) -> Column:
    """The directories above a path, outermost first, at most ``depth`` of them."""
    parts = path_parts(path)
    n = F.least(F.size(parts) - 1, F.lit(depth))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def node_id(job_id: Column, prefix: str, value: Column) -> Column:
    """Deterministic id: the job's first eight characters, the kind, and the value in lower case without / and dots."""
    return F.concat(F.left(job_id, F.lit(8)), F.lit(f"_{prefix}_"), F.lower(F.translate(value, "/.", "__")))


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, of the file name; empty without one."""
    name = last_segment(F.translate(path, "\\", "/"))
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.element_at(F.split(name, r"\."), -1)))).otherwise("")


def count_lines(text: Column) -> Column:
    """Lines as a reader counts them: a final line break ends the last line."""
    n = F.size(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\u0085  ]", -1))
    return F.when(F.length(text) == 0, 0).otherwise(n - F.when(text.rlike(r"(?s)[\n\r\x0B\x0C\x1C\x1D\x1E\u0085  ]\z"), 1).otherwise(0))


def strip_code(text: Column) -> Column:
    """Source text without comments; string literals are emptied."""
    for pattern, by in ((r"(?s)/\*.*?\*/", " "), (r"//[^\n]*", " "), (r"`[^`]*`", '""'), (r'"(?:[^"\\]|\\.)*"', '""'), (r"'(?:[^'\\]|\\.)*'", "''")):
        text = F.regexp_replace(text, pattern, by)
    return text


# Tokens that add a branch, and words before a parenthesis that are no calls.
BRANCH_TOKENS = r"\bif\b|\belse\s+if\b|\bfor\b|\bwhile\b|\bswitch\b|\bcatch\b|\?\s*(?![\?\.:])|&&|\|\|"
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "instanceof", "new", "delete", "throw", "await", "yield")


def branch_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BRANCH_TOKENS))


def brace_depth(text: Column) -> Column:
    """The deepest nesting of braces."""
    braces = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, brace: Column) -> Column:
        now = acc["now"] + F.when(brace == "{", 1).when(brace == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(braces, start, step, lambda acc: acc["most"])


def call_count(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(r"\b(\w+)\s*\("), F.lit(1))
    return F.size(F.filter(names, lambda n: ~n.isin(*CALL_KEYWORDS)))


# Words that a question's keywords leave out.
STOP_WORDS = "what how why where when does do is are the a an in of to and or for with this that it can you me about tell explain describe show".split()


def keywords(question: Column) -> Column:
    words = F.filter(F.split(F.lower(F.regexp_replace(question, r"[?,]", "")), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    return words


def search_tokens(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 2)


def diagram_label(text: Column, most: int = 40) -> Column:
    """Text that is safe inside a quoted label."""
    plain = F.translate(text, '"<>{}[]|`#\n', "'()()()/' ")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 1), F.lit("…"))).otherwise(plain)


def safe_name(text: Column, most: int) -> Column:
    return F.left(F.regexp_replace(text, "[^a-zA-Z0-9_]", "_"), F.lit(most))


def title_key(text: Column) -> Column:
    """Each run of letters with a capital first letter, underscores dropped: customer_id's ``customer`` names Customer."""
    return F.array_join(F.transform(F.split(text, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")


def to_bool(value: Column) -> Column:
    """Tolerant reading of a property as a truth value."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1", "yes"), F.lit(False))


def to_int(value: Column) -> Column:
    """Tolerant reading of a property as a whole number."""
    return F.coalesce(F.try_to_number(value.cast("string"), F.lit("S9999999999")).cast("int"), F.lit(0))


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def age(then: Column, now: Column) -> Column:
    """Relative time in words."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    count = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(count(60), F.lit("m ago"))).when(seconds < 86400, F.concat(count(3600), F.lit("h ago"))).otherwise(F.concat(count(86400), F.lit("d ago")))
