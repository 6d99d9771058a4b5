"""Text normalisation, answer and choice parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the answer that stands for a failed generation.
NO_ANSWER = "Unable to generate answer"
_ASCII_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def kg_normalise(x: Column) -> Column:
    """Graph phrases: lower case, all but A-Z, a-z, 0-9 and space become spaces, outer spaces go, inner ones stay."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^A-Za-z0-9 ]", " "))


def qa_normalise(x: Column) -> Column:
    """Answers: lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(x), _ASCII_PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def label_normalise(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def answer_normalise(x: Column) -> Column:
    """Lower case, outer white space and closing dots, commas and brackets removed."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[.,)]+$", "")


def strip_option(x: Column) -> Column:
    """'A. text' or 'B) text' without its letter."""
    return F.regexp_replace(x, r"^\s*[A-Z][.)]\s*", "")


def leading_letter(response: Column) -> Column:
    """The last marked answer letter ('answer is (B)', 'answer: B'), else a letter that stands at the beginning."""
    marked = F.regexp_extract_all(response, F.lit(r"(?i)answer\s*(?:is|:)?\s*:?\s*\(?([A-D])\b"), F.lit(1))
    first = F.regexp_extract(response, r"^\s*\(?([A-Da-d])(?:[).:,\s]|$)", 1)
    return F.upper(F.when(F.size(marked) > 0, F.element_at(marked, -1)).when(first != "", first))


def report_letter(response: Column) -> Column:
    """A letter for reports: in brackets, before a mark, or alone."""
    tries = [F.regexp_extract(response, p, 1) for p in (r"\(([A-D])\)", r"\b([A-D])[.):]", r"^\s*([A-D])\s*$")]
    return F.coalesce(*[F.when(t != "", t) for t in tries])


def choices_map(choices: dict[str, Column]) -> Column:
    """letter -> text, without empty options."""
    pairs = F.create_map(*[x for k, c in choices.items() for x in (F.lit(k), c)])
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def question_text(question: Column, choices: Column) -> Column:
    """The question, then '(A) text' of each choice in order."""
    listed = F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"]))
    return F.concat_ws(" ", question, F.array_join(listed, " "))


def valid_triples(triples: Column) -> Column:
    """Triples of exactly three elements, first occurrence kept, in order."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def alphanumerics(x: Column) -> Column:
    """How many ASCII letters and digits x has."""
    return F.length(F.regexp_replace(x, r"[^A-Za-z0-9]", ""))


def seeded_hash(seed: int, *key: Column) -> Column:
    """MD5 of ``seed:key``, the parts of the key joined by colons: an order or a draw that any engine can replay."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def with_title(title: Column, text: Column) -> Column:
    """'Title. text'; the title's closing dots and spaces are not doubled."""
    bare = F.regexp_replace(title, r"[. ]+$", "")
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat(bare, F.lit(". "), text))


def chunk_id(text: Column, prefix: str = "chunk-") -> Column:
    """Content key: prefix and MD5 of the text."""
    return F.concat(F.lit(prefix), F.md5(text.cast("binary")))


def fact_id(s: Column, p: Column, o: Column) -> Column:
    """Key of a fact: MD5 of its canonical JSON."""
    return F.concat(F.lit("fact-"), F.md5(F.to_json(F.array(s, p, o)).cast("binary")))


def segment_key(name: Column, box: Column | None = None) -> Column:
    """File-safe key: the first 80 code points with odd ones replaced, and eight hex digits of the SHA-1 of the name.

    box: the signature of a region; a name with one has a key of its own.
    """
    whole = name if box is None else F.when(box.isNull(), name).otherwise(F.concat(name, F.lit("#rc:"), box))
    return F.concat(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), 1, 80), F.lit("-"), F.substring(F.sha1(whole.cast("binary")), 1, 8))


def box_signature(start_frame: Column, box: Column) -> Column:
    """The region of an item as JSON; null where the frame or the box is missing or empty."""
    numbers = F.array_join(F.transform(box, lambda x: x.cast("string")), ", ")
    return F.when((F.coalesce(start_frame, F.lit("")) != "") & (F.coalesce(F.size(box), F.lit(0)) > 0), F.concat(F.lit("["), numbers, F.lit("]")))


def frame_path(path: Column, prefix: str, root: str) -> Column:
    """A frame's path under root; the prefix that it was recorded with goes."""
    bare = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    return F.concat(F.lit(root.rstrip("/") + "/"), bare)


def required_output(qa_type: Column, formats: dict[str, str]) -> Column:
    """The output format of a task type: by its whole name, else by the first prefix (a key ending in *)."""
    exact = F.lit(None).cast("string")
    for name, told in reversed(formats.items()):
        test = qa_type.startswith(name[:-1]) if name.endswith("*") else qa_type == name
        exact = F.when(test, told).otherwise(exact)
    return exact


def asked_question(text: Column, qa_type: Column, formats: dict[str, str]) -> Column:
    """The question without its media mark, and what its output has to look like."""
    bare = F.regexp_replace(text, r"^<video>\n", "")
    told = required_output(qa_type, formats)
    return F.when(told.isNull(), bare).otherwise(F.concat(bare, F.lit("\n\nOutput requirement: "), told))


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds < 30, "short").when(seconds <= 300, "medium").otherwise("long")


def decision(raw: Column) -> Column:
    """struct<decision, memory_type, search_query> from the JSON object in raw; the decision defaults to 'answer'."""
    schema = "decision string, selected_memory struct<memory_type: string, search_query: string>, memory_type string, search_query string"
    got = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), schema)
    lower = F.lower(F.trim(F.coalesce(got["decision"], F.lit("answer"))))
    return F.struct(
        F.when(lower == "search", "search").otherwise("answer").alias("decision"),
        F.lower(F.coalesce(got["memory_type"], got["selected_memory"]["memory_type"])).alias("memory_type"),
        F.coalesce(got["search_query"], got["selected_memory"]["search_query"]).alias("search_query"),
    )


def id_list(raw: Column, valid: Column) -> Column:
    """Ids of the first [...] in raw that are valid, else the valid ids that raw mentions."""
    listed = F.from_json(F.regexp_extract(raw, r"(?s)(\[.*?\])", 1), "array<string>")
    found = F.filter(listed, lambda x: F.array_contains(valid, x))
    return F.when(F.size(found) > 0, found).otherwise(F.filter(valid, lambda v: F.contains(raw, v)))


def metric_block(log: Column, names: list[str]) -> Column:
    """map of metrics 'name: value' from the last block of a scorer's log; absent names have no entry."""
    pairs = [F.struct(F.lit(n).alias("key"), F.try_element_at(F.regexp_extract_all(log, F.lit(rf"(?m)^\s*{n}\s*[:=]\s*([-+]?\d+(?:\.\d+)?)"), F.lit(1)), F.lit(-1)).cast("double").alias("value")) for n in names]
    some = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())
    return F.map_from_entries(some)


def first_person(text: Column, name: str) -> Column:
    """'Name: ' goes, "Name's" becomes my, Name becomes I."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, rf"{name}:\s*", ""), rf"{name}'s\b", "my"), rf"\b{name}\b", "I")


def inline_choices(question: Column, letters: str = "ABCD") -> Column:
    """map letter -> text of '(A) … (B) …' inside a question; null unless all letters stand there, in order, with text."""
    pattern = r"\s*".join(rf"\({c}\)\s*(.+?)" for c in letters) + r"\s*$"
    whole = rf"(?s)^.*?{pattern}"
    parts = F.array(*[F.trim(F.regexp_extract(question, whole, k + 1)) for k in range(len(letters))])
    return F.when(question.rlike(whole) & ~F.array_contains(parts, ""), F.map_from_arrays(F.array(*[F.lit(c) for c in letters]), parts))


def task_bucket(qa_type: Column, prefixes: dict[str, str], other: str = "other") -> Column:
    """The bucket of the first prefix that a task type has."""
    out = F.lit(other)
    for prefix, bucket in reversed(prefixes.items()):
        out = F.when(qa_type.startswith(prefix), bucket).otherwise(out)
    return out


#: Unicode punctuation and its plain form.
PLAIN_PUNCTUATION = {"，": ",", "。": ".", "、": ",", "„": '"', "”": '"', "“": '"', "«": '"', "»": '"', "１": '"', "」": '"', "「": '"', "《": '"', "》": '"', "´": "'", "∶": ":", "：": ":", "？": "?", "！": "!", "（": "(", "）": ")", "；": ";", "–": "-", "—": " - ", "．": ". ", "～": "~", "’": "'", "…": "...", "━": "-", "〈": "<", "〉": ">", "【": "[", "】": "]", "％": "%", "►": "-"}


def plain_punctuation(x: Column) -> Column:
    """Unicode punctuation as ASCII: single characters in one translate, longer replacements after it."""
    short = {k: v for k, v in PLAIN_PUNCTUATION.items() if len(v) == 1}
    out = F.translate(x, "".join(short), "".join(short.values()))
    for k, v in PLAIN_PUNCTUATION.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


#: Characters that training texts lose, the plain forms of single ones, and replacements of several characters, in their order.
LOST_CHARACTERS = "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\u00ad"
PLAIN_CHARACTERS = {" ": "\x0b\x0c\u0085", "-": "‐‑⁃‒–—―−－⁻", '"': "“”„‟", "'": "‘’‚‛՚Ꞌꞌ＇`´′‵", "/": "⁄∕"}
PLAIN_SEQUENCES = {"″": "''", "‶": "''", "‴": "'''", "‷": "'''", "⁗": "''''", "…": "...", " . . . ": " ... "}


def plain_text(x: Column) -> Column:
    """A training text without control characters, with one form of hyphens, quotes, slashes and ellipses."""
    froms, tos = "".join(PLAIN_CHARACTERS.values()), "".join(k * len(v) for k, v in PLAIN_CHARACTERS.items())
    out = F.translate(x, froms + LOST_CHARACTERS, tos)
    for k, v in PLAIN_SEQUENCES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def extracted_entities(raw: Column) -> Column:
    """array<string> of '"named_entities": [...]' in a reply; empty where it is not there or broken."""
    got = F.from_json(F.regexp_extract(raw, r'(?s)"named_entities"\s*:\s*(\[[^\]]*\])', 1), "array<string>")
    return F.coalesce(F.array_distinct(got), F.array().cast("array<string>"))


def extracted_triples(raw: Column) -> Column:
    """Valid triples of '"triples": [[...], ...]' in a reply; empty where it is not there or broken."""
    got = F.from_json(F.regexp_extract(raw, r'(?s)"triples"\s*:\s*(\[\s*(?:\[[^\]]*\]\s*,?\s*)*\])', 1), "array<array<string>>")
    return F.coalesce(valid_triples(got), F.array().cast("array<array<string>>"))


def render(template: str, **columns: Column) -> Column:
    """A prompt template with ${name} or {name} places filled from columns; null fills as empty text."""
    import re

    parts = re.split(r"\$?\{(\w+)\}", template)
    return F.concat(*[F.coalesce(columns[p].cast("string"), F.lit("")) if k % 2 and p in columns else F.lit(p) for k, p in enumerate(parts)])


def caption_line(start: Column, end: Column, text: Column) -> Column:
    """'[start - end] text' with display times."""
    from mnemospark.functions.timecode import display

    return F.concat(F.lit("["), display(start), F.lit(" - "), display(end), F.lit("] "), text)


def triple_line(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", s, p, o), F.lit(")"))


def last_turn(turns: Column, role: str) -> Column:
    """The text of the last turn of a role in array<struct<role, text>>."""
    return F.try_element_at(F.filter(turns, lambda t: t["role"] == role), F.lit(-1))["text"]


def final_answer(reply: Column) -> Column:
    """What follows the last 'Answer:'; the whole reply where there is none."""
    return F.trim(F.element_at(F.split(reply, "Answer:"), -1))


def entry_span(entries: Column) -> Column:
    """struct<start_time, end_time> of array<struct<start, end>>: earliest and latest as eight digits; null without both."""
    code = lambda x: F.concat(F.lpad(x.cast("long").cast("string"), 6, "0"), F.lit("00"))
    first, last = F.array_min(F.transform(entries, lambda e: e["start"])), F.array_max(F.transform(entries, lambda e: e["end"]))
    return F.when(first.isNotNull() & last.isNotNull(), F.struct(code(first).alias("start_time"), code(last).alias("end_time")))


def progress_line(done: Column, total: Column, width: int = 20) -> Column:
    """'[####----] 4/8 50%': a line for logs."""
    share = F.when(total > 0, F.least(done / total, F.lit(1.0))).otherwise(0.0)
    full = F.floor(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), F.lit(width) - full), F.lit("] "), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" "), F.floor(share * 100).cast("string"), F.lit("%"))


def compact(x: Column, most: int) -> Column:
    """One line of at most most code points; what is cut off shows as dots (a display)."""
    line = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def as_number(x: Column) -> Column:
    """A number from text or null; outer blanks do not count."""
    return F.trim(x.cast("string")).try_cast("double")


def as_flag(x: Column) -> Column:
    """A flag from its usual spellings, else null."""
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low.isin("true", "yes", "1", "y", "on"), True).when(low.isin("false", "no", "0", "n", "off"), False)
