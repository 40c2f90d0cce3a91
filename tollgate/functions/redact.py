"""Text redaction (J1): ordered rule chain over a string column.

Two engines with the same contract:

* ``native`` (default): 25 ``regexp_replace`` steps evaluated in the JVM
  inside whole-stage codegen.  A rule's label is recorded when its step
  changed the text (a hit always changes it: no rule can match the
  placeholder exactly, and no rule matches the empty string).
* ``python``: an Arrow-batched pandas UDF running Python ``re``; the exact
  dialect of the rule shapes (for parity checks and odd Unicode input).

Rules always run on the text already rewritten by the earlier rules, so
they are a chain of steps and never one combined regex.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import (
    DEFAULT_PLACEHOLDER,
    DETECTION_RULES,
    FOLD_FROM,
    FOLD_TO,
    MAX_RUN,
    OPAQUE_CHARSET,
    OPAQUE_MIN_LENGTH,
    RULE_GUARDS,
)

# Python's str.isspace() also counts the information separators U+001C..U+001F
# as white space; Java's Unicode \s does not.  Add them so both agree.
_EXTRA_SPACE = r"\x1C-\x1F"


def _java_dialect(pattern: str, ignore_case: bool) -> str:
    """Adapt a Python-syntax rule to java.util.regex with Python semantics.

    (?U): Unicode \\b \\d \\w \\s as in Python str patterns (implies Unicode
    case folding); (?d): only '\\n' ends a line, so '.' excludes just '\\n'.
    """
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            pair = pattern[i:i + 2]
            if pair == r"\s":
                out.append(r"\s" + _EXTRA_SPACE if in_class else "[\\s" + _EXTRA_SPACE + "]")
            else:
                out.append(pair)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    flags = "(?idU)" if ignore_case else "(?dU)"
    return flags + "".join(out)


JAVA_RULES: list[tuple[str, str]] = [(label, _java_dialect(p, ic)) for label, p, ic in DETECTION_RULES]
PY_RULES: list[tuple[str, re.Pattern]] = [
    (label, re.compile(p, re.IGNORECASE if ic else 0)) for label, p, ic in DETECTION_RULES
]
_PY_OPAQUE = re.compile("[" + OPAQUE_CHARSET + "]+")
_PY_DIGIT = re.compile(r"\d")
_ASCII = bytes(range(128))
# Digits read as "0", all other bytes as a space.
_DIGIT_RUNS = bytes(48 if 48 <= b <= 57 else 32 for b in range(256))
_WORD = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789_")
_FOLD_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)


def effective_guards(placeholder: str) -> list[dict]:
    """Per-rule guards that stay necessary conditions for this placeholder.

    Rules run on text that may already contain placeholders, so a guard
    component is dropped when the placeholder itself could satisfy it (or
    could form a guard string across its edge with neighbouring text)."""
    folded_ph = placeholder.translate(_FOLD_TABLE).lower()
    edges = {placeholder[:1], placeholder[-1:]} if placeholder else set()
    out = []
    for g in RULE_GUARDS:
        eff: dict = {}
        if g.get("digit") and not _PY_DIGIT.search(placeholder):
            # Without a placeholder, digits on both sides of a hit meet.
            eff["digit"] = g["digit"] if placeholder else 1
        for key, hay in (("raw", placeholder), ("fold", folded_ph)):
            subs = g.get(key)
            if not subs:
                continue
            spans = any(e and e.lower() in sub.lower() for e in edges for sub in subs)
            if not spans and not any(sub in hay for sub in subs):
                eff[key] = subs
        if "fold" in eff:
            eff["fold_bytes"] = [sub.encode() for sub in eff["fold"]]
            eff["word"] = g.get("word", False)
        out.append(eff)
    return out


def _guard_inputs(text: str) -> tuple[bytes, int]:
    """The text as bytes with A-Z (and what folds to ASCII) in lower case, and
    the length of its longest run of digits, up to ``MAX_RUN``.  A text with
    digits beyond ASCII counts as one long run: its rules always run."""
    folded = text.translate(_FOLD_TABLE) if any(c in text for c in FOLD_FROM) else text
    raw = folded.encode("utf-8", "surrogatepass")
    if not text.isascii():
        rest = raw.translate(None, _ASCII).decode("utf-8", "surrogatepass")
        if _PY_DIGIT.search(rest):
            return raw.lower(), MAX_RUN
    runs = raw.translate(_DIGIT_RUNS)
    longest = 0
    while longest < MAX_RUN and b"0" * (longest + 1) in runs:
        longest += 1
    return raw.lower(), longest


def _py_guard_ok(g: dict, text: str, folded: bytes, longest: int) -> bool:
    if g.get("digit", 0) > longest:
        return False
    if "raw" in g and not any(sub in text for sub in g["raw"]):
        return False
    if "fold" in g and not any((_begins_word if g["word"] else bytes.__contains__)(folded, sub) for sub in g["fold_bytes"]):
        return False
    return True


def _begins_word(folded: bytes, sub: bytes) -> bool:
    """Whether ``sub`` stands in ``folded`` without an ASCII word character before it."""
    at = folded.find(sub)
    while at > 0 and folded[at - 1] in _WORD:
        at = folded.find(sub, at + 1)
    return at >= 0


def is_opaque(text: Column) -> Column:
    """A base64/URL-safe blob that must not be scanned."""
    return (
        (F.length(text) > OPAQUE_MIN_LENGTH)
        & ~text.contains(" ")
        & text.rlike(r"\A[" + OPAQUE_CHARSET + r"]+\z")
    )


def redact_text(
    df: DataFrame,
    text_col: str,
    out_text: str = "redacted_text",
    out_labels: str = "redacted_fields",
    placeholder: str = DEFAULT_PLACEHOLDER,
    engine: str = "native",
) -> DataFrame:
    """Append ``out_text`` (redacted string) and ``out_labels`` (array of the
    labels of the rules that hit, in rule order) to ``df``.

    Null input gives null text and an empty label array.  Opaque strings are
    returned unchanged with no labels.
    """
    if engine == "python":
        scanned = redact_text_udf(placeholder)(F.col(text_col))
        return df.withColumn("__scan", scanned).withColumn(out_text, F.col("__scan.text")).withColumn(
            out_labels, F.col("__scan.labels")
        ).drop("__scan")
    if engine != "native":
        raise ValueError(f"unknown engine {engine!r}")
    src = F.col(text_col)
    steps = [f"__rx{i}" for i in range(len(JAVA_RULES) + 1)]
    # Opaque (and null) strings start the chain as null: regexp_replace(null)
    # costs nothing, and coalesce restores the original at the end.
    out = df.withColumn(steps[0], F.when(~is_opaque(src), src))
    # Guard inputs, computed once per row: case-folded text and "has a digit".
    out = out.withColumns({
        "__g_fold": F.lower(F.translate(src, FOLD_FROM, FOLD_TO)),
        "__g_digit": src.rlike(r"(?U)\d"),
    })
    # One projection per rule: each step reads the previous one, so Catalyst
    # keeps them as separate (non-duplicated) expressions in one codegen stage.
    # A rule whose guard fails keeps the text without converting or scanning it.
    literal = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    guards = effective_guards(placeholder)
    for i, (_, pattern) in enumerate(JAVA_RULES, start=1):
        prev = F.col(steps[i - 1])
        replaced = F.regexp_replace(prev, pattern, literal)
        cond = _spark_guard(guards[i - 1], src)
        out = out.withColumn(steps[i], replaced if cond is None else F.when(cond, replaced).otherwise(prev))
    hits = [
        F.when(F.col(steps[i]) != F.col(steps[i - 1]), F.lit(label))
        for i, (label, _) in enumerate(JAVA_RULES, start=1)
    ]
    out = out.withColumn(out_labels, F.array_compact(F.array(*hits))).withColumn(
        out_text, F.coalesce(F.col(steps[-1]), src)
    )
    return out.drop(*steps, "__g_fold", "__g_digit")


def _spark_guard(g: dict, src: Column):
    conds = []
    if g.get("digit"):
        conds.append(F.col("__g_digit"))
    if "raw" in g:
        conds.append(_any([src.contains(sub) for sub in g["raw"]]))
    if "fold" in g:
        conds.append(_any([F.col("__g_fold").contains(sub) for sub in g["fold"]]))
    if not conds:
        return None
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


# ---------------------------------------------------------------------------
# Python-side helper (used by the Arrow UDFs: exact dialect, JSON walk)
# ---------------------------------------------------------------------------

def py_is_opaque(text: str) -> bool:
    return len(text) > OPAQUE_MIN_LENGTH and " " not in text and _PY_OPAQUE.fullmatch(text) is not None


_GUARD_CACHE: dict[str, list[dict]] = {}


def py_redact_string(text: str, placeholder: str = DEFAULT_PLACEHOLDER) -> tuple[str, list[str]]:
    """Redact one string; returns (text, labels)."""
    if py_is_opaque(text):
        return text, []
    labels: list[str] = []
    guards = _GUARD_CACHE.get(placeholder)
    if guards is None:
        guards = _GUARD_CACHE.setdefault(placeholder, effective_guards(placeholder))
    folded, longest = _guard_inputs(text)
    for (label, rx), g in zip(PY_RULES, guards):
        if not _py_guard_ok(g, text, folded, longest):
            continue
        new_text, n = rx.subn(lambda _m: placeholder, text)
        if n:
            labels.append(label)
            text = new_text
    return text, labels


REDACT_STRUCT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
])


def redact_text_udf(placeholder: str = DEFAULT_PLACEHOLDER):
    """Arrow-batched UDF: string -> struct<text, labels>."""

    @F.pandas_udf(REDACT_STRUCT)
    def _redact(texts: pd.Series) -> pd.DataFrame:
        out_text, out_labels = [], []
        for t in texts:
            if t is None:
                out_text.append(None)
                out_labels.append([])
                continue
            new_text, labels = py_redact_string(t, placeholder)
            out_text.append(new_text)
            out_labels.append(labels)
        return pd.DataFrame({"text": out_text, "labels": out_labels})

    return _redact
