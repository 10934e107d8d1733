"""Column expressions over text: regex translation, spans, splicing.

Regular expressions are written in ECMAScript semantics and translated to Java:
``\\b`` is ASCII, ``\\s`` covers Unicode spaces, ``/i`` folds Unicode letters and
``$`` is the absolute end unless ``m`` is set. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_NOT_AFTER, _NOT_BEFORE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_SPACES = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPAN = "array<struct<start:int,end:int,matched:string>>"


def _class_end(source: str, k: int) -> int:
    """Index of the bracket that ends the class that starts at ``k``."""
    k += 1
    while source[k] != "]":
        k += 2 if source[k] == "\\" else 1
    return k


def _group_end(source: str, k: int) -> int:
    """Index of the parenthesis that ends the group that starts at ``k``; the length if none does."""
    depth = 0
    while k < len(source):
        if source[k] == "\\":
            k += 1
        elif source[k] == "[":
            k = _class_end(source, k)
        elif source[k] == "(":
            depth += 1
        elif source[k] == ")":
            depth -= 1
            if depth <= 0:
                return k
        k += 1
    return k


def _branches(source: str) -> list[str]:
    """The alternatives of a pattern at its top level, up to the end of the group it stands in."""
    out, k, last = [], 0, 0
    while k < len(source) and source[k] != ")":
        if source[k] == "\\":
            k += 1
        elif source[k] == "[":
            k = _class_end(source, k)
        elif source[k] == "(":
            k = _group_end(source, k)
        elif source[k] == "|":
            out.append(source[last:k])
            last = k + 1
        k += 1
    return [*out, source[last:k]]


def first_chars(source: str) -> str | None:
    """What a match of ``source`` can start with, as the inside of a character class; None if that isn't
    always one ASCII letter, digit or underscore."""
    branches = _branches(source)
    if len(branches) > 1:
        found = [first_chars(b) for b in branches]
        return None if None in found else "".join(found)
    source = branches[0]
    while source.startswith("(?!"):
        source = source[_group_end(source, 0) + 1 :]
    if not source:
        return None
    if source[0] == "(":
        end = _group_end(source, 0)
        inside, after = source[1:end].removeprefix("?:"), source[end + 1 :]
        got = first_chars(inside)
    elif source[0] == "[":
        end = _class_end(source, 0)
        inside, after = source[1:end], source[end + 1 :]
        got = inside if re.fullmatch(r"(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_]|\\d)+", inside) else None
    elif source.startswith(r"\d"):
        got, after = r"\d", source[2:]
    else:
        got, after = (source[0] if re.fullmatch("[A-Za-z0-9_]", source[0]) else None), source[1:]
    if got is None or not re.match(r"[?*]|\{0", after):
        return got
    rest = first_chars(re.sub(r"^(?:[?*]|\{0[^}]*\})", "", after))
    return None if rest is None else got + rest


def _ends_in_word(source: str) -> bool:
    """Whether what stands at the end of ``source`` surely is one ASCII letter, digit or underscore."""
    if source.endswith(")"):
        starts = [k for k in range(len(source)) if source[k] == "(" and _group_end(source, k) == len(source) - 1]
        inside = source[starts[0] + 1 : -1].removeprefix("?:") if starts else "?"
        return not inside.startswith("?") and all(map(_ends_in_word, _branches(inside)))
    last = re.search(r"(\\.|\[(?:\\.|[^\]\\])*\]|[^\\)])(\{[1-9]\d*(?:,\d*)?\}|\+)?$", source)
    return bool(last) and first_chars(last[1]) is not None


def needs(source: str) -> set[str]:
    """What every match of ``source`` holds: ``\\d`` for a digit, and signs that are no letters."""
    branches = _branches(source)
    if len(branches) > 1:
        return set.intersection(*map(needs, branches))
    source, k, out = branches[0], 0, set()
    while k < len(source):
        if source[k] == "(":
            end = _group_end(source, k)
            got = set() if re.match(r"\(\?[!<=]", source[k:]) else needs(source[k + 1 : end].removeprefix("?:"))
        elif source[k] == "[":
            end = _class_end(source, k)
            got = {r"\d"} if re.fullmatch(r"(?:[0-9]-[0-9]|[0-9]|\\d)+", source[k + 1 : end]) else set()
        elif source[k] == "\\":
            end = k + 1
            got = {r"\d"} if source[end] == "d" else set() if source[end].isalnum() else {source[end]}
        else:
            end, got = k, {source[k]} if source[k] in "@:/#%" else {r"\d"} if source[k].isdigit() else set()
        more = re.match(r"[?*+]|\{[^}]*\}", source[end + 1 :])
        if not (more and re.match(r"[?*]|\{0", more[0])):
            out |= got
        k = end + 1 + (len(more[0]) if more else 0)
    return out


def java_regex(source: str, flags: str = "g") -> str:
    """An ECMAScript pattern as a Java one.

    A word boundary beside a character that surely is an ASCII word character needs one
    lookaround; before it, the class of that character comes first, as most places fail there.
    """
    out, inside, k = [], False, 0
    while k < len(source):
        ch = source[k]
        if ch == "\\" and k + 1 < len(source):
            two = source[k : k + 2]
            if two == r"\b" and not inside:
                head = first_chars(_branches(source[k + 2 :])[0])
                out.append(f"(?=[{head}]){_NOT_AFTER}" if head else _NOT_BEFORE if _ends_in_word(source[:k]) else _EDGE)
            elif two == r"\s":
                out.append(_SPACES if inside else f"[{_SPACES}]")
            else:
                out.append(two)
            k += 2
            continue
        if ch == "[" and not inside:
            inside = True
        elif ch == "]" and inside:
            inside = False
        elif ch == "$" and not inside and "m" not in flags:
            ch = r"\z"
        out.append(ch)
        k += 1
    return ("(?iu)" if "i" in flags else "") + ("(?m)" if "m" in flags else "") + "".join(out)


def _cut(text: Column, marked: Column) -> Column:
    """Spans between pairs of the sentinel U+0001 in ``marked``."""
    parts = F.split(marked, "\u0001")
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("odd"), F.array().cast(SPAN).alias("found"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part)
        hit = F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), F.substring(text, acc["pos"] + 1, F.length(part)).alias("matched")))
        return F.struct(end.alias("pos"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(parts, start, step, lambda acc: acc["found"])


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the text and of whether it has a digit, both evaluated once."""
    both = F.struct(text.alias("text"), F.coalesce(text.rlike("[0-9]"), F.lit(False)).alias("digits"))
    return once(both, lambda x: body(x["text"], x["digits"]))


def _marked(text: Column, source: str, regex: str, mark: str, digits: Column | None) -> Column:
    """Spans of ``regex``, which ``mark`` puts between sentinels; cheap tests of what every match holds come first."""
    held = needs(source)
    test = text.rlike(regex)
    for sign in sorted(held - {r"\d"}):
        test = F.contains(text, F.lit(sign)) & test
    if r"\d" in held:
        test = (text.rlike("[0-9]") if digits is None else digits) & test
    clean = F.replace(text, F.lit("\u0001"), F.lit("\u0002"))
    return F.when(F.coalesce(test, F.lit(False)), _cut(text, F.regexp_replace(clean, regex, mark))).otherwise(F.array().cast(SPAN))


def spans(text: Column, source: str, flags: str = "g", digits: Column | None = None) -> Column:
    """All matches, left to right: array<struct<start,end,matched>>. ``digits``: whether the text has one, if that is known."""
    return _marked(text, source, java_regex(source, flags), "\u0001$0\u0001", digits)


def group_spans(text: Column, before: str, group: str, after: str, flags: str = "g", digits: Column | None = None) -> Column:
    """Matches of ``group`` that stand between ``before`` and ``after``."""
    whole = f"({before})({group})({after})"
    return _marked(text, whole, java_regex(whole, flags), "$1\u0001$2\u0001$3", digits)


def splice(text: Column, findings: Column, replacement) -> Column:
    """Replace disjoint, sorted findings; ``replacement`` maps a finding to a string column."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, f["start"] - acc["pos"])
        return F.struct(f["end"].alias("pos"), F.concat(acc["out"], gap, replacement(f)).alias("out"))

    return F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def disjoint(found: Column, fields: list[str]) -> Column:
    """Greedy de-overlap: start ascending, end descending, then priority; keep what starts
    at or after the last kept end. ``found`` has start, end, prio and ``fields``."""
    keyed = F.transform(found, lambda f: F.struct(f["start"].alias("start"), (-f["end"]).alias("neg"), f["prio"].alias("prio"), *[f[x].alias(x) for x in fields]))
    as_out = lambda f: F.struct(*[f[x].alias(x) for x in fields[:2]], f["start"].alias("start"), (-f["neg"]).alias("end"), *[f[x].alias(x) for x in fields[2:]])
    walk = lambda ordered: F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("last"), F.slice(ordered, 1, 0).alias("kept")),
        lambda acc, f: F.when(f["start"] >= acc["last"], F.struct((-f["neg"]).alias("last"), F.concat(acc["kept"], F.array(f)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return F.transform(once(F.sort_array(keyed), walk), as_out)
