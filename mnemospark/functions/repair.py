"""Model output brought to its contract, as column expressions over a small scanner.

``scan`` reads a text into tokens (numbers, words, single marks), and ``shape`` writes a token row as one character a
token: N a number, U a unit of seconds, l a single letter, w another word, marks as they are. What a contract asks for is
then a place where the shape reads as it should, whatever the spacing: ``N-NU`` is a span of time.
"""

from __future__ import annotations

import ast
import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemospark.functions.text import answer_normalise

_TOKEN = r"[0-9]+(?:\.[0-9]+)?|[A-Za-z]+|[^\sA-Za-z0-9]"
_UNITS = ("second", "seconds", "sec", "secs")
_BLANK = " \t\r\n\f\x0b"

#: The rated aspects of the two assessment tasks, in the order of their output.
SKILLS = ["Respect for tissue", "Suture/needle handling", "Time and motion", "Flow of operation", "Overall performance", "Quality of final product"]
SAFETY_VIEWS = ["Two structures", "Cystic plate", "Hepatocystic triangle"]


def _once(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def scan(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def shape(tokens: Column) -> Column:
    def kind(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        word = F.when(F.lower(t).isin(*_UNITS), "U").when(F.length(t) == 1, "l").otherwise("w")
        return F.when(first.between("0", "9"), "N").when(F.lower(first).between("a", "z"), word).otherwise(t)

    return F.array_join(F.transform(tokens, kind), "")


def places(tokens: Column, like: str) -> Column:
    """The token rows of all places whose shape is like."""
    n = len(like)

    def of(s: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
        return F.transform(F.filter(starts, lambda i: F.substring(s, i, F.lit(n)) == like), lambda i: F.slice(tokens, i, F.lit(n)))

    return _once(shape(tokens), of)


def _trim(x: Column, marks: str = "") -> Column:
    return F.btrim(x, F.lit(_BLANK + marks))


def _some(x: Column) -> Column:
    return F.when(x != "", x)


def _lines_of(rows: Column) -> Column:
    return _some(F.array_join(rows, "\n"))


def without_label(text: Column, *labels: str) -> Column:
    """The text after its first colon where one of labels stands before it."""
    head = F.lower(_trim(F.substring_index(text, ":", 1)))
    return F.when(F.contains(text, F.lit(":")) & head.isin(*labels), _trim(F.substring(text, F.instr(text, ":") + 1, F.length(text)))).otherwise(text)


def without_fences(text: Column) -> Column:
    """Code fences go, with the language named at the beginning of one; what they hold stays."""
    parts = F.transform(F.split(text, "```"), lambda part, k: F.when(k % 2 == 1, F.regexp_replace(part, r"^\w+(?=\s|$)", "")).otherwise(part))
    return _trim(F.array_join(parts, ""))


def _in_order(a: Column, b: Column) -> Column:
    return a.cast("double") <= b.cast("double")


def spans(text: Column) -> Column:
    """'a-b, c-d seconds.' from all spans of time that do not run backwards."""
    found = F.filter(places(scan(text), "N-NU"), lambda t: _in_order(t[0], t[2]))
    return F.concat(_some(F.array_join(F.transform(found, lambda t: F.concat(t[0], F.lit("-"), t[2])), ", ")), F.lit(" seconds."))


def boxes(text: Column) -> Column:
    """A line 't seconds: [a, b, c, d]' for each box with its time."""
    line = lambda t: F.concat(t[0], F.lit(" seconds: ["), F.concat_ws(", ", t[4], t[6], t[8], t[10]), F.lit("]"))
    return _lines_of(F.transform(places(scan(text), "NU:[N,N,N,N]"), line))


def events(text: Column) -> Column:
    """A line 'a-b seconds: label: description' for each line that has the three parts."""

    def line(parts: Column) -> Column:
        span, label, told = scan(parts[0]), _trim(parts[1]), _trim(parts[2])
        fits = shape(span).isin("N-NU", "N-NU.") & _in_order(span[0], span[2]) & (label != "") & (told != "")
        return F.when(fits, F.concat(span[0], F.lit("-"), span[2], F.lit(" seconds: "), label, F.lit(": "), told))

    lines = F.transform(F.split(text, "\n"), lambda x: F.split(x, ":", 3))
    return _lines_of(F.filter(F.transform(F.filter(lines, lambda p: F.size(p) == 3), line), lambda x: x.isNotNull()))


def ratings(text: Column, names: list[str], marks: list[str], out_of: str = "") -> Column:
    """'name: mark, ...' in the order of names, where all of them have one of marks (and '/ out_of' after it)."""
    flat = F.regexp_replace(F.lower(text), r"\s*:\s*", ":")

    def rating(name: str) -> Column:
        after = F.slice(F.split(flat, rf"\Q{name.lower()}:\E"), 2, 1_000_000)
        ends = F.transform(after, lambda x: F.slice(scan(x), 1, 3))
        fits = lambda t: F.get(t, 0).isin(*marks) & ((F.get(t, 1) == "/") & (F.get(t, 2) == out_of) if out_of else F.lit(True))
        return F.get(F.filter(ends, fits), 0)[0]

    got = [rating(n) for n in names]
    shown = [F.concat(F.lit(f"{n}: "), g, F.lit(f"/{out_of}" if out_of else "")) for n, g in zip(names, got, strict=True)]
    every = got[0].isNotNull()
    for g in got[1:]:
        every = every & g.isNotNull()
    return F.when(every, F.concat_ws(", ", *shown))


def action(text: Column) -> Column:
    """The first line without its label, quotes and closing dots."""
    first = _trim(F.substring_index(without_label(text, "next action"), "\n", 1), "`\"'")
    return _some(_trim(F.rtrim(first, F.lit("."))))


def prose(text: Column) -> Column:
    """One line without its label."""
    return _some(_trim(F.regexp_replace(without_label(text, "summary", "description"), r"\s+", " ")))


#: The task families, by whole name or (with *) by prefix, in the order in which they are tried.
CONTRACTS = {
    "tal": spans,
    "stg": boxes,
    "dense_captioning*": events,
    "skill_assessment": lambda text: ratings(text, SKILLS, ["1", "2", "3", "4", "5"], "5"),
    "cvs_assessment": lambda text: ratings(text, SAFETY_VIEWS, ["0", "1", "2"]),
    "next_action": action,
    "video_summary*": prose,
    "region_caption*": prose,
}


def is_family(qa_type: Column, family: str) -> Column:
    return qa_type.startswith(family[:-1]) if family.endswith("*") else qa_type == family


def repair_prediction(qa_type: Column, response: Column) -> Column:
    """A response that meets its task's contract, or null where repair would be a guess."""

    def of(text: Column) -> Column:
        out = None
        for family, rule in CONTRACTS.items():
            out = F.when(is_family(qa_type, family), rule(text)) if out is None else out.when(is_family(qa_type, family), rule(text))
        return F.when(text != "", out.otherwise(text))

    return _once(without_label(without_fences(F.coalesce(response, F.lit(""))), "answer", "response", "prediction"), of)


def is_repairable(qa_type: Column, status: Column, response: Column) -> Column:
    """A record that is done: its call succeeded and its response can be brought to its contract."""
    return (status == "success") & repair_prediction(qa_type, response).isNotNull()


_ALONE = [f"{a}l{b}{c}" for a in ("", "(") for b in ("", ")") for c in ("", ".")]


def choice_letter(response: Column, choices: Column) -> Column:
    """The choice that a response names; choices: map<letter, text>.

    Its whole text may be a choice, with or without the letter. Else it is the last valid letter that stands alone on
    a line or begins the word after 'answer is', 'answer:' or 'answer -'.
    """
    listed = F.map_entries(choices)
    whole = answer_normalise(F.coalesce(response, F.lit("")))
    spelled = lambda e: [answer_normalise(x) for x in (e["value"], F.concat(F.upper(e["key"]), F.lit(". "), e["value"]), F.concat(F.lit("("), F.upper(e["key"]), F.lit(") "), e["value"]))]
    exact = F.filter(listed, lambda e: whole.isin(*spelled(e)))

    def named(line: Column) -> Column:
        def of(t: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(t), F.lit(1)) - 1), lambda i: (F.lower(F.get(t, i)) == "answer") & F.lower(F.get(t, i + 1)).isin("is", ":", "-"))
            marked = F.transform(at, lambda i: F.when(F.get(t, i + 2) == "(", F.get(t, i + 3)).otherwise(F.get(t, i + 2)))
            return F.when(shape(t).isin(*_ALONE), F.filter(t, lambda x: x.rlike("^[A-Za-z]$"))).otherwise(marked)

        return _once(scan(line), of)

    letters = F.flatten(F.transform(F.split(F.coalesce(response, F.lit("")), r"[\r\n]+"), named))
    valid = F.transform(F.map_keys(choices), lambda k: F.upper(k))
    firsts = F.filter(F.transform(letters, lambda x: F.upper(F.substring(x, 1, 1))), lambda x: F.array_contains(valid, x))
    last = F.get(firsts, F.size(firsts) - 1)
    return F.coalesce(F.upper(F.get(exact, 0)["key"]), last)


def repair_json(text: Column) -> Column:
    """Valid JSON stays; else what follows the last comma goes and the brackets that are open there are closed."""
    head = _once(F.split(text, ","), lambda parts: F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ","))
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def read(state: Column, c: Column) -> Column:
        inside, escaped = state["quoted"], state["escaped"]
        last = F.right(state["open"], F.lit(1))
        closes = (c == last) & c.isin("}", "]")
        stack = F.when(inside, state["open"]).when(c == "{", F.concat(state["open"], F.lit("}"))).when(c == "[", F.concat(state["open"], F.lit("]")))
        stack = stack.when(closes, F.left(state["open"], F.length(state["open"]) - 1)).otherwise(state["open"])
        quoted = F.when((c == '"') & ~escaped, ~inside).otherwise(inside)
        return F.struct(stack.alias("open"), quoted.alias("quoted"), (inside & (c == "\\") & ~escaped).alias("escaped"))

    closers = F.aggregate(F.split(head, ""), start, read, lambda s: F.reverse(s["open"]))
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.concat(head, closers))


def json_payload(text: Column) -> Column:
    """The JSON object or array in a reply: inside a fence, or from the first opening to the last closing bracket.

    Without a closing bracket it goes on to the end, for repair_json to close.
    """

    def of(body: Column) -> Column:
        outer, rest = (F.regexp_extract(body, p, 0) for p in (r"(?s)[{\[].*[}\]]", r"(?s)[{\[].*"))
        return F.coalesce(_some(outer), _some(rest), _some(_trim(body)))

    return _once(F.when(F.contains(text, F.lit("```")), without_fences(F.regexp_extract(text, r"(?s)```.*", 0))).otherwise(text), of)


@F.pandas_udf(StringType())
def json_of_literal(payloads: pd.Series) -> pd.Series:
    """Payloads as JSON; one that is no JSON but a literal of Python's is written as JSON, anything else is null."""

    def one(x):
        if pd.isna(x):
            return None
        try:
            json.loads(x)
            return x
        except ValueError:
            pass
        try:
            return json.dumps(ast.literal_eval(x), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return pd.Series([one(x) for x in payloads], dtype=object)


def sections(text: Column) -> Column:
    """'[[ ## name ## ]]' sections of a reply as a map; of equal names the last stays."""
    parts = F.slice(F.split(text, r"\[\[ ## "), 2, 1_000_000)
    named = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit(" ## ]]"))), lambda p: F.struct(F.substring_index(p, " ## ]]", 1).alias("k"), _trim(F.substring(p, F.instr(p, " ## ]]") + 6, F.length(p))).alias("v")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda later: later["k"] == e["k"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    r"""\uXXXX escapes as characters; surrogate pairs join."""
    run = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
    return texts.map(lambda x: run.sub(lambda m: bytes.fromhex(m[0].replace("\\u", "")).decode("utf-16-be", "replace"), x), na_action="ignore")


@F.pandas_udf(StringType())
def nearest(texts: pd.Series, candidates: pd.Series) -> pd.Series:
    """The candidate that is most alike by difflib's ratio, whatever its likeness."""
    found = [difflib.get_close_matches(t, [c for c in cs if c is not None], n=1, cutoff=0.0) if t is not None and cs is not None else [] for t, cs in zip(texts, candidates, strict=True)]
    return pd.Series([f[0] if f else None for f in found], dtype=object)
