"""Column -> Column text functions (all JVM-side built-ins)."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


class SecurityServiceError(RuntimeError):
    """Raised on the driver when redaction cannot be configured: fail closed."""


# kind of private information -> pattern that finds it. "Persons names" has a
# token but no matcher, as in the original service.
REDACTION_PATTERNS = {"Financial information": K.ACCOUNT_NUMBER_PATTERN}


def _java_replacement(token: str) -> str:
    return token.replace("\\", "\\\\").replace("$", "\\$")


def redact(text: Column, redaction_map: dict | None, patterns: dict[str, str] | None = None) -> Column:
    """Replace every match of each kind's pattern by the configured token (H1, H2).

    ``patterns`` adds kinds to the shipped ones. ``(?U)`` gives Unicode ``\\d`` and ``\\b`` like Python's ``re``.
    A map that is missing, or lacks a string token for a kind with a pattern, raises before any plan is built (H3).
    """
    patterns = REDACTION_PATTERNS | (patterns or {})
    for kind in patterns:
        if not isinstance((redaction_map or {}).get(kind), str):
            raise SecurityServiceError(f"redaction map lacks a token for {kind!r}")
    for kind in redaction_map:
        if kind not in patterns and kind not in K.REDACTION_TOKENS:  # the shipped kinds have tokens, not all of them a matcher
            raise SecurityServiceError(f"no pattern finds {kind!r}, which has a token")
    out = text
    for kind, pattern in patterns.items():
        out = F.regexp_replace(out, "(?U)" + pattern, _java_replacement(redaction_map[kind]))
    return out


def filled(template: str, **values: Column) -> Column:
    """A template with columns in its fields; what stands in the columns is never read as a template."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] * bool(text) + ([values[name]] if name else [])
    return F.concat(*parts)


def format_context(text: Column, title: Column, url: Column, has_meta: Column) -> Column:
    """H6: ``[title: '{title}', url: '{url}']\\n{text}\\n`` or ``{text}\\n``."""
    shown = F.coalesce(text, F.lit("None"))
    with_meta = filled(K.CONTEXT_WITH_METADATA, title=F.coalesce(title, F.lit("None")), url=F.coalesce(url, F.lit("")), text=shown)
    plain = filled(K.CONTEXT_PLAIN, text=shown)
    return F.when(has_meta, with_meta).otherwise(plain)


def char_tokens(text: Column) -> Column:
    """Default token counter (H7/K4): one token per character."""
    return F.length(text)


def word_tokens(text: Column) -> Column:
    """Alternative counter: whitespace-separated words."""
    t = F.trim(text)
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


TokenCounter = Callable[[Column], Column]


def build_prompt(user_query: Column, context: Column, template: str = "basic",
                 eos_token: str = K.EOS_TOKEN) -> Column:
    """H8: template text + EOS. ``concat`` keeps ``%`` and braces in the text intact."""
    if template == "basic":
        body = filled(K.PROMPT_BASIC, user_query=user_query, context=context)
    else:
        body = F.concat(user_query, context)
    return F.concat(body, F.lit(eos_token))


def prompt_too_long(prompt: Column, max_length: int) -> Column:
    """H9: flag raised when ``max_length - len(prompt) <= 10`` (the service only logs it)."""
    return (F.lit(max_length) - F.length(prompt)) <= 10


def strip_prompt(generated: Column, model_input: Column) -> Column:
    """``generated[len(input) - 1:]`` with Python slice semantics."""
    n = F.length(model_input)
    return F.when(n == 0, F.substring(generated, -1, 1)).otherwise(F.call_function("substring", generated, n))


def event_id(key: Column, ts: Column) -> Column:
    """Uuid-shaped id + timestamp text, like ``str(uuid4()) + str(now)``.

    The uuid part is derived from a stable key (sha-256), so a recomputed partition
    after an executor loss produces the same ids.
    """
    h = F.sha2(key.cast("string"), 256)
    uuid_part = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                            F.substring(h, 17, 4), F.substring(h, 21, 12))
    return F.concat(uuid_part, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def event_time(event_id_col: Column) -> Column:
    """Parse the timestamp text that starts at character 37 of an event id."""
    return F.try_to_timestamp(F.substring(event_id_col, 37, 26), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))


def digit_encode(text: Column, size: int) -> Column:
    """First ``size`` characters as digits -> array<float>; NULL if they are not digits."""
    head = F.substring(text, 1, size)
    vec = F.transform(F.split(head, ""), lambda c: c.cast("float"))
    return F.when(head.rlike(rf"^[0-9]{{{size}}}$"), vec)


def json_field(log: Column, name: str) -> Column:
    """A top-level field of a JSON log value as text."""
    return F.get_json_object(log, f"$.{name}")
