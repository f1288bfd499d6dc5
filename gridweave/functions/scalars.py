"""Scalar helpers as column expressions: names, durations, memory sizes, messages, keys. All stay in generated code."""

from __future__ import annotations

import getpass
import re
import socket
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factors of memory units and of time units, ends of file names.
MEMORY_UNITS = {"": 1, "K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4, "P": 1024**5}
FILE_NAME = r"\.(csv|txt|rds|dat|tsv|json|xml|nii|gz)$"
TIME_UNITS = {"d": 86400, "day": 86400, "days": 86400, "h": 3600, "hr": 3600, "hrs": 3600, "hour": 3600, "hours": 3600, "m": 60, "min": 60, "mins": 60, "minute": 60, "minutes": 60, "s": 1, "sec": 1, "secs": 1, "second": 1, "seconds": 1}


def parse_hms(text: Column) -> Column:
    """Seconds of a duration as schedulers write it, days-hours:minutes:seconds with as many parts as there are, from minutes
    on; or of a plain number. Null for anything else."""
    s = F.regexp_replace(text, r"\s+", "")
    clock = r"^(?:(?:(\d+)-)?(\d{1,2}):)?(\d{1,2}):(\d{2})$"
    total = F.lit(0.0)
    for place, seconds in enumerate((86400, 3600, 60, 1), 1):
        total = total + F.coalesce(F.regexp_extract(s, clock, place).try_cast("double"), F.lit(0.0)) * seconds
    return F.when(s.rlike(clock), total).otherwise(s.try_cast("double"))


def parse_memory(text: Column) -> Column:
    """Bytes of a size such as 12, 1.5k, 8G, 8GB or 4Gn (of a node) and 4Gc (of a core); null for anything else."""
    size = r"^(\d+(?:\.\d+)?)([KMGTP]?)(?:I?B)?[NC]?$"
    s = F.upper(F.trim(text))
    factors = F.create_map(*[F.lit(x) for unit, factor in MEMORY_UNITS.items() for x in (unit, float(factor))])
    found = F.regexp_extract(s, size, 1).try_cast("double") * F.try_element_at(factors, F.regexp_extract(s, size, 2))
    return F.when(s.rlike(size), found).otherwise(s.try_cast("double"))


def format_bytes(value: Column) -> Column:
    """Bytes as text with one decimal from 1 K on; NA for null."""
    out = F.format_string("%dB", value.cast("long"))
    for power, unit in enumerate("KMGTP", 1):
        out = F.when(value >= 1024.0**power, F.format_string(f"%.1f{unit}", (value / 1024.0**power).cast("double"))).otherwise(out)
    return F.when(value.isNull(), F.lit("NA")).otherwise(out)


def hms(seconds: Column) -> Column:
    """Whole seconds as H:MM:SS."""
    s = seconds.cast("long")
    return F.when(s.isNotNull(), F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60))


def normal_time(text: Column) -> Column:
    """A duration (2h, 90min, H:MM, H:MM:SS) as H:MM:SS; null where it is none."""
    s = F.lower(F.regexp_replace(text, r"\s+", ""))
    pattern = rf"^(\d+)({'|'.join(sorted(TIME_UNITS, key=lambda u: (-len(u), u)))})$"
    unit = F.regexp_extract(s, pattern, 2)
    factor = F.lit(None).cast("long")
    for name, value in TIME_UNITS.items():
        factor = F.when(unit == name, F.lit(value).cast("long")).otherwise(factor)
    short = r"^(\d+):(\d{2})$"
    return (
        F.when(s.rlike(short), F.format_string("%d:%02d:00", F.regexp_extract(s, short, 1).try_cast("int"), F.regexp_extract(s, short, 2).try_cast("int")))
        .when(s.rlike(r"^\d+:\d{2}:\d{2}$"), s)
        .when(s.rlike(pattern), hms(F.regexp_extract(s, pattern, 1).try_cast("long") * factor))
    )


def offset(seconds: Column) -> Column:
    """Seconds from a start as +H:MM:SS."""
    return F.when(seconds.isNull(), F.lit("    ?    ")).otherwise(F.concat(F.lit("+"), hms(seconds)))


def exit_code(text: Column) -> Column:
    """status:signal as a struct of two integers."""
    parts = F.split(text, ":")
    return F.struct(F.get(parts, F.lit(0)).try_cast("int").alias("status"), F.get(parts, F.lit(1)).try_cast("int").alias("signal"))


def safe_name(name: Column, default: str = "job", most: int = 128) -> Column:
    """A name of letters, digits and ``_.+-`` only, of at most ``most`` characters; ``default`` if nothing is left."""
    s = F.trim(F.regexp_replace(name, r"[\r\n\t]", " "))
    for pattern, to in ((r"\s+", "-"), (r"[^A-Za-z0-9_.+-]", "-"), (r"-{2,}", "-"), (r"^[.-]+", ""), (r"[.-]+$", "")):
        s = F.regexp_replace(s, pattern, to)
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit(default))


def stem(path: Column, pattern: str | None = None) -> Column:
    """The last part of a path without its last extension; with a pattern, what its first group (or all of it) matches
    there, or the whole where it matches nothing."""
    whole = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    if pattern is None:
        return whole
    group = 1 if re.compile(pattern).groups else 0
    return F.when(whole.rlike(pattern), F.regexp_extract(whole, pattern, group)).otherwise(whole)


def indexed_name(number: Column, prefix: str = "job", width: int = 0) -> Column:
    """prefix-number, with leading zeros up to ``width``."""
    return F.concat(F.lit(f"{prefix}-"), F.format_string(f"%0{width}d" if width else "%d", number))


def digest_name(value: Column, prefix: str = "job", length: int = 8) -> Column:
    """prefix and the first characters of the content's hash."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.md5(value), 1, length))


def named_by(rule: str | Callable[[Column, Column], Column], element: Column, number: Column, **options) -> Column:
    """Job names by a rule: index, stem, digest, auto (the stem of what looks like a file, else the index), or a function
    of element and number."""
    index = indexed_name(number, **{k: v for k, v in options.items() if k in ("prefix", "width")})
    if callable(rule):
        return F.coalesce(F.nullif(safe_name(rule(element, number), ""), F.lit("")), index)
    if rule == "index":
        return index
    if rule == "digest":
        return digest_name(element.cast("string"), **{k: v for k, v in options.items() if k in ("prefix", "length")})
    own = F.coalesce(F.nullif(safe_name(stem(element.cast("string"), options.get("pattern")), ""), F.lit("")), index)
    if rule == "stem":
        return own
    if rule == "auto":
        return F.when(element.cast("string").rlike(FILE_NAME), own).otherwise(index)
    raise ValueError(f"no rule {rule}")


def one_line(text: Column, what: str = "a value") -> Column:
    """The text, or an error where it has a line break."""
    return F.when(text.rlike(r"[\r\n]"), F.raise_error(F.lit(f"{what} has a line break")).cast("string")).otherwise(text)


def path_values(now: datetime | None = None, **given) -> dict[str, Column]:
    """Columns for the places of a path template: date, time, run, user and host have defaults."""
    now = now or datetime.now()
    known = {"date": f"{now:%Y%m%d}", "time": f"{now:%H%M%S}", "run": f"{now:%Y%m%d_%H%M%S}", "user": getpass.getuser(), "host": socket.gethostname()}
    return {k: v if isinstance(v, Column) else F.lit(v) for k, v in (known | given).items()}


def event_brief(kind: Column, chunk: Column, stage: Column, attempt: Column, message: Column, summary: Column, duration_ms: Column) -> Column:
    """An event in one line: what it is, of which chunk and stage, and what it says."""
    where = F.when(chunk.isNotNull(), F.concat(F.lit("chunk "), chunk.cast("string"), F.lit(" / "), F.coalesce(stage, F.lit("stage")))).otherwise(F.coalesce(F.nullif(stage, F.lit("")), F.lit("worker")))
    which = F.when(attempt.isNotNull(), F.concat(F.lit(" (attempt "), attempt.cast("string"), F.lit(")"))).otherwise("")
    took = F.when(duration_ms.isNotNull(), F.format_string(" (%.1fs)", duration_ms / 1000)).otherwise("")
    told = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(": "), c)).otherwise("")
    what = F.replace(kind, F.lit("_"), F.lit(" "))
    return F.when(kind.startswith("run_"), F.concat(what, told(summary))).otherwise(F.concat(what, F.lit(" "), where, which, took, told(message)))


def submit_error(message: Column) -> Column:
    """struct(class, retryable) of an error at submission."""
    quota, passing = message.contains("QOSMaxSubmitJobPerUserLimit"), message.rlike("(?i)socket|temporar|transient|timed out")
    kind = F.when(quota, "submission_quota_limit").when(passing, "submission_transient_error").otherwise("submission_failed")
    return F.struct(kind.alias("class"), F.coalesce(quota | passing, F.lit(False)).alias("retryable"))


def expand(template: str, **columns: Column) -> Column:
    """A path or name template with ``{name}`` places."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, closed, rest = tail.partition("}")
        if not closed or name not in columns:
            raise KeyError(f"no value for {{{name}}} in {template!r}")
        out += [F.lit(head), columns[name].cast("string")]
    return F.concat(*out, F.lit(rest)) if out else F.lit(rest)


class path_patterns:
    """Places of files that come up again and again, as columns. ``now`` is a time, the current one unless given."""

    @staticmethod
    def _stamp(now: Column | None, form: str) -> Column:
        return F.date_format(F.current_timestamp() if now is None else now, form)

    @staticmethod
    def timestamped(folder: Column, name: Column, extension: Column, now: Column | None = None) -> Column:
        """A file named by the time that it is from."""
        return F.concat(folder, F.lit("/"), path_patterns._stamp(now, "yyyyMMdd_HHmmss"), F.lit("_"), name, F.lit("."), extension)

    @staticmethod
    def experiment(exp_id: Column, name: Column, run: Column) -> Column:
        """The folder of one run of an experiment."""
        return F.concat(F.lit("experiments/"), exp_id, F.lit("/"), name, F.lit("/run_"), F.format_string("%03d", run))

    @staticmethod
    def user_workspace(*parts: Column, user: str | None = None) -> Column:
        """A place in the workspace of the user who builds the query."""
        return F.concat_ws("/", F.lit("workspace"), F.lit(user or getpass.getuser()), *parts)

    @staticmethod
    def daily_log(name: Column, now: Column | None = None) -> Column:
        """A log in a folder for each day."""
        return F.concat(F.lit("logs/"), path_patterns._stamp(now, "yyyyMMdd"), F.lit("/"), name, F.lit("_"), path_patterns._stamp(now, "HHmmss"), F.lit(".log"))

    @staticmethod
    def checkpoint(model: Column, epoch: Column, now: Column | None = None) -> Column:
        """A model's state after an epoch."""
        return F.concat(F.lit("checkpoints/"), model, F.lit("/epoch_"), F.format_string("%04d", epoch), F.lit("_"), path_patterns._stamp(now, "yyyyMMdd"), F.lit(".pkl"))


def normal_message(message: Column) -> Column:
    """An error message without what changes between runs: line numbers, folders, addresses, times, runs of blanks."""
    # These patterns decide which messages have one fingerprint.
    s = F.coalesce(message, F.lit(""))
    s = F.regexp_replace(s, r"(?i)\bat\s+line\s+\d+", "at line <N>")
    s = F.regexp_replace(s, r"/[^ ]+/([^ /]+)", "<path>/$1")
    s = F.regexp_replace(s, r"0x[0-9a-fA-F]+", "<addr>")
    s = F.regexp_replace(s, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}", "<time>")
    return F.regexp_replace(F.btrim(s, F.lit(" \t\r\n")), r"\s+", " ")


def message_fingerprint(message: Column) -> Column:
    return F.md5(normal_message(message))


def error_signature(chunk: Column, stage: Column, row: Column, message: Column) -> Column:
    """What makes an error the same as one seen before: chunk, stage, row and the first hundred characters."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (chunk, stage, row, F.substring(message, 1, 100))]
    return F.sha2(F.concat_ws("\x1f", *text), 256)


def row_key(*names: str) -> Column:
    """SHA-1 of the JSON of the named columns in the order of their names."""
    return F.sha1(F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"}))


def attempt_id(run: Column, row: Column, stage: Column) -> Column:
    return F.concat(F.lit("att-"), F.substring(F.sha1(F.concat_ws("\x1f", run, row, stage)), 1, 16))


def lossless_int(value: Column) -> Column:
    """An integer where the number is one, else null: casting never changes a value."""
    whole = value.try_cast("int")
    return F.when(whole.cast("double") == value, whole)


def clean_params(params: Column) -> Column:
    """Parameters without names that begin with or hold a dot, sorted by name."""
    kept = F.map_filter(params, lambda k, _: ~k.contains("."))
    return F.map_from_entries(F.array_sort(F.map_entries(kept)))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def coerced(text: Column) -> Column:
    """Script arguments by what they look like: struct of kind (boolean, integer, double, string) and the values."""
    flag = F.lower(text).isin("true", "false")
    whole, number = text.rlike(r"^[+-]?\d+$"), text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    kind = F.when(flag, "boolean").when(whole, "integer").when(number, "double").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(flag, F.lower(text) == "true").alias("as_boolean"), F.when(whole, text.try_cast("long")).alias("as_integer"), F.when(number, text.try_cast("double")).alias("as_double"), text.alias("as_string"))
