"""Registry of dataset parsers: each brings a dataset's rows to one schema for evaluation or training.

Evaluation sets are declared here, training sets in ``sources.training``: column expressions for the common schema over the dataset's own columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.sources.training import TRAINING

EVALUATION: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}


def register(registry: dict, *names: str):
    def put(f):
        registry.update(dict.fromkeys(names, f))
        return f

    return put


def parse(registry: dict, name: str, rows: DataFrame, conf: dict | None = None) -> DataFrame:
    if name not in registry:
        raise ValueError(f"no parser {name!r}; known: {sorted(registry)}")
    return registry[name](rows, conf or {})


@dataclass
class Shape:
    """How a dataset's columns become the common schema; values are SQL expressions over them."""

    query: str
    names: str  # the candidates' names, by which a prediction is judged
    label: str
    texts: str = ""  # what a model sees of the candidates, where it is not their names
    prompt: str = ""
    media: str | None = None  # what the query shows
    keep: str = "true"


def _evaluation(shape: Shape):
    def run(rows: DataFrame, conf: dict) -> DataFrame:
        s = {k: conf.get(k, getattr(shape, k)) for k in ("query", "names", "label", "texts", "prompt", "media", "keep")}
        asked = F.expr(s["query"]).cast("string")
        text = F.concat(F.lit(s["prompt"] + " "), asked) if s["prompt"] else asked
        media: Column = F.expr(s["media"]) if s["media"] else F.lit(None).cast("string")
        shown = F.expr(s["texts"] or s["names"])
        kept = rows.filter(F.expr(s["keep"]))
        return kept.select(text.alias("query_text"), media.cast("string").alias("query_media"), F.expr(s["names"]).cast("array<string>").alias("cand_names"), shown.cast("array<string>").alias("cand_texts"), F.expr(s["label"]).cast("string").alias("label_name"))

    return run


#: The prompts of the evaluation sets.
ANSWER_PROMPT = "Given a video and a question, select the most accurate answer from the provided candidates. Return only the exact text of your chosen answer. Question: "
RETRIEVAL_PROMPTS = {
    "didemo": "Find a video that includes the following described scenes:",
    "msrvtt": "Find a video that contains the following visual content:",
    "msvd": "Find the video snippet that corresponds to the given summary:",
    "vatex": "Select a video that fits the description provided:",
    "youcook2": "Find a video that demonstrates the following action while making a recipe:",
    "moment_retrieval": "Find the clip that corresponds to the described scene in the given video:",
    "visrag": "Find a document image that matches the given query:",
    "vidore": "",
}

# Pieces of the expressions below.
_lettered = lambda options: f"transform({options}, (x, i) -> concat('(', chr(65 + i), ') ', x))"
_listed = lambda options: f"rtrim(concat(question, '\n', 'Options:\n', array_join({_lettered(options)}, '\n')))"
_bare = lambda options: f"transform({options}, x -> trim(BOTH '. ' FROM if(locate('. ', x) > 0, substring(x, locate('. ', x)), right(x, 1))))"
_stem = lambda path: f"regexp_replace(regexp_extract({path}, '([^/]+)$', 1), '\\\\.[^.]+$', '')"
_instructed = "concat(replace(qry_inst, '<|image_1|>', ''), ' ', qry_text)"
_clip = "x -> replace(split(x, '.mp4', 2)[0], '/', '_')"

#: How each evaluation set's own columns are read.
DATASETS: dict[str, Shape] = {
    "activitynetqa": Shape("concat(question, '? (A) yes; (B) no.')", "array('yes', 'no')", "answer", prompt=ANSWER_PROMPT, media="concat('v_', video_name, '.mp4')"),
    "egoschema": Shape("concat(question, array_join(option, ' '))", "option", "get(option, int(answer))", _bare("option"), ANSWER_PROMPT, "concat(video_idx, '.mp4')"),
    "mvbench": Shape(_listed("candidates"), _lettered("candidates"), "get(" + _lettered("candidates") + ", int(array_position(candidates, answer)) - 1)", "", ANSWER_PROMPT, "concat(subset, '/', video)"),
    "nextqa": Shape(_listed("array(a0, a1, a2, a3, a4)"), "array(a0, a1, a2, a3, a4)", "get(array(a0, a1, a2, a3, a4), int(answer))", "", ANSWER_PROMPT, "concat(video, '.mp4')"),
    "videomme": Shape("concat(question, '\n', array_join(options, '\n'))", "options", "get(options, ascii(answer) - 65)", _bare("options"), ANSWER_PROMPT, "concat(videoID, '.mp4')"),
    "videommmu": Shape(_listed("options"), "options", "answer", _bare("options"), ANSWER_PROMPT, "concat(subset, '/', id, '.mp4')", "question_type = 'multiple-choice'"),
    "msrvtt": Shape("caption", "array(video_id)", "video_id"),
    "msvd": Shape("get(caption, 0)", "array(video_id)", "video_id"),
    "vatex": Shape("get(enCap, 0)", "array(videoID)", "videoID"),
    "youcook2": Shape("sentence", "array(id)", "id"),
    "didemo": Shape("caption", f"array({_stem('video')})", _stem("video")),
    "ssv2": Shape("''", "neg_text", "pos_text", media="concat(video_id, '.mp4')"),
    "video_classification": Shape("''", "array(pos_text)", "pos_text", media="concat(video_id, '.mp4')"),
    "moment_retrieval": Shape("query", "clips", "get(filter(clips, x -> startswith(regexp_extract(x, '([^/]+)$', 1), 'positive')), 0)", media="regexp_extract(video_path, '([^/]+)$', 1)"),
    "momentseeker": Shape("query", f"transform(concat(positive_frames, negative_frames), {_clip})", f"get(transform(positive_frames, {_clip}), 0)", media="input_frames"),
    "vidore": Shape("query", "corpus_ids", "get(corpus_ids, 0)"),
    "visrag": Shape("query", "corpus_ids", "get(corpus_ids, 0)", "transform(corpus_ids, x -> concat(left(regexp_replace(x, '\\\\.[^.]+$', ''), 50), '_', left(md5(x), 8), regexp_extract(x, '(\\\\.[^.]+)?$', 1)))"),
    "image_cls": Shape(f"concat(replace({_instructed}, ' \n', '\n'), '\n')", "tgt_text", "get(tgt_text, 0)", media="qry_img_path"),
    "image_i2t": Shape(f"concat(replace({_instructed}, ' \n', '\n'), '\n')", "tgt_text", "get(tgt_text, 0)", media="qry_img_path"),
    "image_qa": Shape(f"concat('\n', replace(trim({_instructed}), ' \n', '\n'), '\n')", "tgt_text", "get(tgt_text, 0)", media="qry_img_path"),
    "image_t2i": Shape(f"concat({_instructed}, '\n')", "tgt_img_path", "get(tgt_img_path, 0)", "transform(tgt_text, x -> trim(concat(replace(tgt_inst, '<|image_1|>', ''), ' ', x)))"),
    "image_i2i_vg": Shape(f"concat('\n', replace(trim({_instructed}), ' \n', '\n'), '\n')", "zip_with(tgt_img_path, tgt_text, (p, t) -> concat(p, ':', trim(BOTH '\"' FROM t)))", "concat(get(tgt_img_path, 0), ':', trim(BOTH '\"' FROM get(tgt_text, 0)))", "transform(tgt_text, x -> trim(concat(replace(tgt_inst, '<|image_1|>', ''), ' ', x)))", media="qry_img_path"),
}
for name, shape in DATASETS.items():
    shape.prompt = shape.prompt or RETRIEVAL_PROMPTS.get(name, "")
    register(EVALUATION, name)(_evaluation(shape))


def multiple_choice_rows(rows: DataFrame, duration: str | None = None) -> DataFrame:
    """Evaluation rows from a benchmark's Parquet: fields renamed, option letters stripped, one duration class if given."""
    opt = lambda k: F.regexp_replace(F.get("options", F.lit(k)), r"^\s*[A-Z][.)]\s*", "")
    x = rows.filter(F.col("duration") == duration) if duration else rows
    return x.select(F.col("question_id").alias("ID"), F.struct(F.lit("DAY1").alias("date"), F.lit("23595999").alias("time")).alias("query_time"), F.col("task_type").alias("type"), F.col("videoID").alias("video_id"), "duration", "domain", "sub_category", "question", *[opt(k).alias(f"choice_{c}") for k, c in enumerate("abcd")], "answer")
