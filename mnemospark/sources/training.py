"""Training sets, each read by its own columns, as one schema: a query, a positive and negatives, with the media that each shows.

Most sets are declared as SQL expressions over their columns; text retrieval, instruction and label sets choose their positives and
negatives by seeded draws (the MD5 of seed, number and key), so a run can be repeated and replayed elsewhere. Media are paths: pages,
or the folder of a video's frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mnemospark.functions.text import plain_text, with_title
from mnemospark.operators.mixing import draw_share, hard_negative_chain, label_contrasts, sampled

TRAINING: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}

MOST_LABELS = 10_000  # labels that negatives are drawn from when a configuration does not name them

#: Media tokens, instructions and prompts of the training sets.
IMAGE_TOKEN, VIDEO_TOKEN, OLD_IMAGE_TOKEN = "<|image_pad|>", "<|video_pad|>", "<|image_1|>"
UNDERSTAND = "Understand the content of the provided video"
CLASSIFY = {
    "Kinetics-700": "Recognize the category of the video content.",
    "SmthSmthV2": "What actions or object interactions are being performed by the person in the video?",
    "UCF101": "What activities or sports are being performed by the person in the video?",
    "HMDB51": "What actions or objects interactions are the person in the video doing?",
    "Breakfast": "Recognize the breakfast type that the person is cooking in the video. ",
}
SCENES, VISUAL = "Find a video that includes the following described scenes:", "Find a video that contains the following visual content:"
VIDEO_QA = "Answer a question based on the content of a video. "
PDF_QUERY, PDF_PAGES = "Given the question below, retrieve the most relevant PDF document that can help answer it:\n: ", "Represent the following PDF pages: "
PAGE_QUERY, PAGE_IMAGE = "Retrieve documents that best answer the following query: ", "Generate an embedding for the following document, in the format of images: "
PAGE_SOURCES = {
    "NeurIPS Papers": "This query is about a research paper from NeurIPS, a leading AI/ML conference. The document contains technical discussions, methodologies, and findings. Identify relevant papers and sections that address the query: ",
    "Textbooks": "This query is related to a college-level textbook, which provides structured explanations, definitions, and examples. Find the most relevant concepts or explanations that address the query: ",
    "ICML Papers": "This query is about a research paper from ICML, a leading AI/ML conference. The document contains theoretical insights, experiments, and applications. Identify relevant papers and sections that best answer the query: ",
    "Manuallib": "This query pertains to a product manual, which contains detailed technical specifications, usage instructions, and troubleshooting steps. Find the most relevant section that answers the query: ",
    "ArxivQA": "This query is related to retrieving a relevant figure from an ArXiv research paper. The retrieved figure should contain scientific plots, mathematical visualizations, or experimental results that best address the query: ",
    "ChartQA": "This query is related to retrieving a relevant chart that visually represents numerical or categorical data. The retrieved chart should contain bar graphs, line charts, or other visual elements necessary to analyze trends, compare values, or extract insights related to the query: ",
    "MP-DocVQA": "This query is related to retrieving a relevant page from a multi-page document, such as reports, invoices, or research papers. The retrieved document should contain text, tables, or structured information necessary to answer the query: ",
    "InfoVQA": "This query is related to retrieving an infographic that visually presents statistical or factual information using charts, icons, and structured layouts. The retrieved image should contain the necessary visual elements to provide the best context for answering the query: ",
    "PlotQA": "This query relates to retrieving a relevant plot or chart that visually represents numerical data. The retrieved figure should contain the necessary information to analyze trends, compare values, or extract key insights related to the query: ",
    "SlideVQA": "This query is related to retrieving a relevant presentation slide that visually presents structured information. The retrieved slide should contain the necessary text, charts, or graphics to provide the best answer to the query: ",
}
PAGE_TARGETS = {
    "Textbooks": "A textbook page with structured educational content and explanations.",
    "ICML Papers": "A research paper from ICML, covering machine learning topics.",
    "NeurIPS Papers": "A research paper from NeurIPS on AI and ML topics.",
    "Manuallib": "A product manual page with technical specifications and instructions.",
    "InfoVQA": "An infographic with structured data, charts, and annotations.",
    "PlotQA": "A numerical data visualization, such as bar charts or line graphs.",
    "SlideVQA": "A presentation slide with text, bullet points, and diagrams.",
    "ArxivQA": "A figure from a research paper, including plots or experimental results.",
    "MP-DocVQA": "A page from a multi-page document with text or tables.",
    "ChartQA": "A statistical chart comparing values or analyzing trends.",
}


def register(name: str):
    def put(f):
        TRAINING[name] = f
        return f

    return put


def _finished(rows: DataFrame, conf: dict, name: str, query: Column, pos: Column, neg: Column, query_media: Column | None = None, pos_media: Column | None = None, neg_media: Column | None = None) -> DataFrame:
    """The common schema; conf["carry"] names columns that come along."""
    none = F.lit(None).cast("array<string>")
    media = {"query_media": query_media, "pos_media": pos_media, "neg_media": neg_media}
    shown = [(none if c is None else c.cast("array<string>")).alias(k) for k, c in media.items()]
    texts = [query.cast("string").alias("query_text"), pos.cast("string").alias("pos_text"), neg.cast("array<string>").alias("neg_text")]
    return rows.select(*conf.get("carry", []), *texts, *shown, F.lit(conf.get("name", name)).alias("global_dataset_name")).filter("query_text is not null and pos_text is not null")


@dataclass
class Pair:
    """A declared set. Expressions may use image, video and root, the configuration's tokens and folder, and instruction."""

    query: str
    pos: str
    neg: str = "array()"
    query_media: str = "null"
    pos_media: str = "null"
    neg_media: str = "null"
    keep: str = "true"
    instruction: str = ""
    optional: tuple[str, ...] = ()  # columns that the set may lack


def _declared(name: str, shape: Pair):
    def run(rows: DataFrame, conf: dict) -> DataFrame:
        known = {"_image": conf.get("image_token", IMAGE_TOKEN), "_video": conf.get("video_token", VIDEO_TOKEN), "_root": conf.get("root", ""), "_instruction": conf.get("instruction", CLASSIFY.get(conf.get("dataset", ""), shape.instruction))}
        x = rows.withColumns({k: F.lit(v) for k, v in known.items()} | {c: F.lit(None).cast("string") for c in shape.optional if c not in rows.columns})
        part = {f.name: F.expr(conf.get(f.name, getattr(shape, f.name))) for f in fields(Pair) if f.name not in ("instruction", "optional")}
        return _finished(x.filter(part.pop("keep")), conf, name, **part)

    return run


# Pieces of the expressions below.
_under = lambda path: f"if(_root = '', {path}, concat(_root, '/', {path}))"
_token = lambda x: f"replace({x}, '{OLD_IMAGE_TOKEN}', _image)"
_stem = lambda path: f"regexp_replace(regexp_extract({path}, '([^/]+)$', 1), '\\\\.[^.]+$', '')"
_listed = lambda path: f"if(startswith({path}, '['), from_json({path}, 'array<string>'), array({path}))"
_paths = lambda path: f"transform({_listed(path)}, x -> {_under('x')})"
_one = lambda path: f"if(coalesce({path}, '') = '', null, array({_under(path)}))"
_many = lambda path: f"if(coalesce({path}, '') = '', null, {_paths(path)})"
_shown = lambda text, path: f"(coalesce({text}, '') <> '' or coalesce({path}, '') <> '')"
_said = lambda k: f"get(conversations, {k}).value"
_asked = f"replace({_said(0)}, '<video>', _video)"
_captioned = "concat(_instruction, if(coalesce({0}, '') = '', '', concat(' ', {0})))"
_clip = f"concat(_video, ' {UNDERSTAND}.')"
_mapped = lambda table, key: "element_at(map(" + ", ".join(f"'{k}', '{v}'" for k, v in table.items()) + f"), {key})"
_sourced = lambda table, text, end: f"concat(coalesce(concat({_mapped(table, 'source')}, ' '), ''), {text}, ' ', {end})"
_negatives = f"if(coalesce(neg_text, '') = '', array(), array({_token('neg_text')}))"

#: How each declared set's own columns are read.
PAIRS: dict[str, Pair] = {
    "didemo": Pair(_captioned.format("caption"), _clip, pos_media=f"array({_under(_stem('video'))})", instruction=SCENES),
    "msrvtt": Pair(_captioned.format("get(caption, 0)"), _clip, pos_media=f"array({_under('video_id')})", instruction=VISUAL),
    "msvd": Pair(_captioned.format("get(caption, 0)"), _clip, pos_media=f"array({_under('video_id')})", instruction=VISUAL),
    "video_classification": Pair("concat(_video, ' ', _instruction)", "pos_text", query_media=f"array({_under('cast(video_id as string)')})"),
    "ssv2": Pair("concat(_video, ' ', _instruction)", "pos_text", query_media=f"array({_under('cast(video_id as string)')})", instruction=CLASSIFY["SmthSmthV2"]),
    "llavahound_caption": Pair(_asked, _said(1), query_media=f"array({_under('video')})"),
    "llavahound_qa": Pair(f"concat('{VIDEO_QA}', {_asked})", _said(1), query_media=f"array({_under('video')})"),
    "mmeb": Pair(_token("qry"), _token("pos_text"), _negatives, _one("qry_image_path"), _one("pos_image_path"), _one("neg_image_path"), f"{_shown('qry', 'qry_image_path')} and {_shown('pos_text', 'pos_image_path')}", optional=("neg_text", "neg_image_path")),
    "gui": Pair(_token("qry_text"), _token("pos_text"), _negatives, _many("qry_image_path"), _many("pos_image_path"), _many("neg_image_path"), f"{_shown('qry_text', 'qry_image_path')} and {_shown('pos_text', 'pos_image_path')}", optional=("neg_text", "neg_image_path")),
    "pixmo": Pair(f"concat('{PAGE_QUERY}', query_text)", f"concat('{PAGE_IMAGE}', _image)", pos_media="array(" + _under("concat(get(positive_document_ids, 0), '.png')") + ")"),
    "vidore": Pair("concat(_image, ' ', query)", "answer", query_media="array(image.path)"),
    "visrag": Pair(_sourced(PAGE_SOURCES, "query", "''"), _sourced(PAGE_TARGETS, "''", "_image"), pos_media="array(image.path)"),
}
for _name, _shape in PAIRS.items():
    register(_name)(_declared(_name, _shape))

#: The caption set's other use: a caption finds its video.
FIND_VIDEO = Pair(f"concat('{VISUAL} ', {_said(1)})", f"concat('{UNDERSTAND}: ', _video)", pos_media=f"array({_under('video')})")


@register("llavahound_caption")
def captions_or_videos(rows: DataFrame, conf: dict) -> DataFrame:
    """conf["mode"]: caption_retrieval (a video finds its caption) or video_retrieval."""
    modes = {"caption_retrieval": PAIRS["llavahound_caption"], "video_retrieval": FIND_VIDEO}
    if (mode := conf.get("mode", "caption_retrieval")) not in modes:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(modes)}")
    return _declared("llavahound_caption", modes[mode])(rows, conf)


def _drawn(values: Column, conf: dict, key: Column, salt: int) -> Column:
    return F.get(sampled(values, 1, conf.get("seed", 0), key, salt), F.lit(0))


def _said_with(prompt: str, text: Column) -> Column:
    return plain_text(F.concat(F.lit(prompt), text))


def _bounds(span: str | None) -> tuple[int, int] | None:
    """'2-10' as (2, 10); an empty end is open."""
    if not span:
        return None
    first, last = span.split("-")
    return int(first or 0), int(last) if last else (1 << 31) - 1


@register("docmatix")
def documents_of_pages(rows: DataFrame, conf: dict) -> DataFrame:
    """One drawn question of each document's texts (array<struct<user, ...>>) finds its pages, images (array<struct<path, ...>>)."""
    asked = _drawn(F.col("texts"), conf, F.to_json("texts"), 0)["user"]
    tokens = F.repeat(F.lit(conf.get("image_token", IMAGE_TOKEN)), F.size("images"))
    return _finished(rows, conf, "docmatix", F.concat(F.lit(f"{PDF_QUERY} Q: "), asked), F.concat(F.lit(f"{PDF_PAGES} "), tokens), F.array(), pos_media=F.transform("images", lambda i: i["path"]))


def _texts(rows: DataFrame, column: str, titled: bool) -> Column:
    """An array of strings, or of structs (title, text), as strings."""
    kind = rows.schema[column].dataType.elementType
    if isinstance(kind, StringType):
        return F.col(column)
    return F.transform(column, lambda e: with_title(e["title"], e["text"]) if titled and "title" in kind.names else e["text"])


@register("beir")
def text_retrieval(rows: DataFrame, conf: dict) -> DataFrame:
    """Retrieval rows: query, pos, neg (strings, or structs with title, text, doc_id), neg_scores, neg_docids; pos_score, posbased_neg_docids,
    posbased_neg_scores, prev_neg, BM25_query and dataset where there are any.

    conf: num_hardneg and the filters of ``hard_negative_chain`` (posbased_filter_range, posbased_filter_score, neg_score_threshold, posneg_margin,
    posneg_ratio, hardneg_range); query_group_name with query_group_range, which asks a generated query instead; prevneg_ratio, how often the first
    negatives come from an earlier round; query_prompt, doc_prompt. A name that ends in _title leaves titles out.
    Queries left with fewer than 80 % of their negatives go. A row without a positive goes.
    """
    name, n, seed = conf.get("name", "beir"), conf.get("num_hardneg", 0), conf.get("seed", 0)
    titled, has = not name.endswith("_title"), set(rows.columns).__contains__
    key = F.to_json("query") if not isinstance(rows.schema["query"].dataType, StringType) else F.col("query")
    asked = key if isinstance(rows.schema["query"].dataType, StringType) else with_title(F.col("query.title"), F.col("query.text")) if titled else F.col("query.text")
    if conf.get("query_group_name"):
        some = F.filter(F.transform("BM25_query", lambda q: F.trim(q)), lambda q: q != "")
        span = _bounds(conf.get("query_group_range"))
        other = _drawn(F.slice(some, span[0] + 1, span[1] - span[0]), conf, key, 0) if span else F.get(some, F.lit(0))
        asked = F.coalesce(other, asked)
    x = rows.withColumn("_key", F.coalesce(key, F.lit(""))).withColumn("_asked", asked).withColumn("_pos", _drawn(_texts(rows, "pos", titled), conf, F.col("_key"), 1))
    negatives = F.array().cast("array<string>")
    if n > 0:
        part = lambda ids, scores, texts=None: F.transform(ids if texts is None else texts, lambda t, i: F.struct(F.coalesce(F.get(ids, i), F.lit("")).alias("id"), F.get(scores, i).cast("double").alias("score"), (t if texts is not None else F.lit(None).cast("string")).alias("text")))
        empty = F.array().cast("array<struct<id:string,score:double,text:string>>")
        ids = F.col("neg_docids") if has("neg_docids") else F.array().cast("array<string>")
        whole = part(ids, F.col("neg_scores"), _texts(rows, "neg", titled))
        before = _texts(rows, "prev_neg", titled) if has("prev_neg") else None
        x = x.withColumns({
            "negatives": F.slice(whole, F.lit(1), F.size("neg_scores")),
            "by_positive": F.coalesce(part(F.col("posbased_neg_docids"), F.col("posbased_neg_scores")), empty) if has("posbased_neg_docids") else empty,
            "positive_score": F.coalesce(F.col("pos_score").cast("double"), F.lit(float("inf"))) if has("pos_score") else F.lit(float("inf")),
            "earlier": F.transform(before, lambda t: F.struct(F.lit("").alias("id"), F.lit(None).cast("double").alias("score"), t.alias("text"))) if before is not None else F.lit(None).cast("array<struct<id:string,score:double,text:string>>"),
            "_before": F.coalesce(before, F.array().cast("array<string>")) if before is not None else F.array().cast("array<string>"),
        })
        own = has("dataset") and has("neg_docids") and "doc_id" in getattr(rows.schema["pos"].dataType.elementType, "names", [])
        x = x.withColumn("positive_id", F.when(F.contains("dataset", F.lit("arguana")), F.col("pos")[0]["doc_id"]).otherwise("\x00-") if own else F.lit("\x00-"))
        x = hard_negative_chain(x, n, own, _bounds(conf.get("posbased_filter_range")), conf.get("posbased_filter_score"), conf.get("neg_score_threshold"), conf.get("posneg_margin"), conf.get("posneg_ratio"), _bounds(conf.get("hardneg_range")))
        negatives = sampled(F.transform("negatives", lambda e: e["text"]), n, seed, F.col("_key"), 2)
        if ratio := conf.get("prevneg_ratio", 0.0):
            k = -int(-(n * ratio) // 1)
            first = F.when(F.size("_before") < k, F.col("_before")).otherwise(sampled(F.col("_before"), k, seed, F.col("_key"), 2 + n))
            swapped = F.concat(first, F.slice(negatives, F.size(first) + 1, F.lit(n)))
            negatives = F.when((F.size("_before") > 0) & (draw_share(seed, F.lit(-1), F.col("_key")) < ratio), swapped).otherwise(negatives)
    doc = conf.get("doc_prompt", "")
    return _finished(x, conf, "beir", _said_with(conf.get("query_prompt", ""), F.col("_asked")), _said_with(doc, F.col("_pos")), F.transform(negatives, lambda t: _said_with(doc, t)))


@register("berri")
def instructed_retrieval(rows: DataFrame, conf: dict) -> DataFrame:
    """question ('instruction[SEP]question') with positive_ctxs, hard_negative_ctxs and negative_ctxs (structs: title is an instruction, text).

    conf: num_hardneg, add_prompt_ratio (how many rows show instructions), query_prompt and doc_prompt, which replace a row's own. Random negatives fill up
    where there are fewer hard ones than asked.
    """
    n, seed, key = conf.get("num_hardneg", 0), conf.get("seed", 0), F.coalesce("question", F.lit(""))
    parts = F.split("question", r"\[SEP\]", 2)
    own = F.when(F.size(parts) == 2, parts[0]).otherwise("")
    text = F.get(parts, F.size(parts) - 1)
    tell = draw_share(seed, F.lit(-1), key) < conf.get("add_prompt_ratio", 1.0)
    put = lambda prompt, t: F.when(tell & (F.coalesce(prompt, F.lit("")) != ""), F.concat(prompt, F.lit(":\t"), t)).otherwise(t)
    by = lambda given, mine: F.lit(given) if given else mine
    query = put(by(conf.get("query_prompt"), own), text)
    context = lambda e: plain_text(put(by(conf.get("doc_prompt"), e["title"]), e["text"]))
    hard = F.coalesce("hard_negative_ctxs", F.slice("negative_ctxs", 1, 0))
    some = F.when((F.size(hard) == 0) | (F.size(hard) < n), F.concat(hard, "negative_ctxs")).otherwise(hard)
    negatives = F.transform(sampled(some, n, seed, key, 1), context)
    return _finished(rows, conf, "berri", plain_text(query), context(_drawn(F.col("positive_ctxs"), conf, key, 0)), negatives)


def _label_set(rows: DataFrame, conf: dict, label: Column) -> list[str]:
    """conf["labels"], or the labels of the rows if there are at most MOST_LABELS."""
    if conf.get("labels"):
        return sorted(conf["labels"])
    found = [r[0] for r in rows.select(label.alias("l")).filter("l is not null").distinct().limit(MOST_LABELS + 1).collect()]
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: name them in the configuration, or draw negatives against texts")
    return sorted(found)


def _against_texts(rows: DataFrame, conf: dict, name: str, text: Column, label: Column, alone: bool) -> DataFrame:
    """Positives are texts of the same label, negatives texts of others; where there is no other label, the text's second half."""
    n, prompt = conf.get("num_hardneg", 0), conf.get("query_prompt", "")
    x = rows.withColumn("_text", text).withColumn("_label", label).filter("_text is not null")
    order = conf.get("order", ["_text"])
    x = x.select(*dict.fromkeys(["_text", "_label", *order, *conf.get("carry", [])]))  # what the text was made of stays behind
    x = label_contrasts(x, "_label", "_text", order, n, conf.get("seed", 0))
    x = x if alone else x.filter("n_label > 1")
    half = F.array_repeat(F.substring("_text", F.floor(F.length("_text") / 2).cast("int") + 1, F.length("_text")), n)
    others = F.when(F.size("others") > 0, F.col("others")).otherwise(half)
    return _finished(x, conf, name, _said_with(prompt, F.col("_text")), _said_with(prompt, F.col("same")), F.transform(others, lambda t: _said_with(prompt, t)))


def _first(rows: DataFrame, *names: str) -> str | None:
    return next((c for c in names if c in rows.columns), None)


@register("mteb_cluster")
def clustered_texts(rows: DataFrame, conf: dict) -> DataFrame:
    """title (headline) with abstract (short_description) and category (categories, label); categories holds several labels by blanks.

    conf: data_format p2p (title and abstract) or s2s (title alone); data_type against_text, or, by default, labels as positives and negatives; num_hardneg, labels,
    query_prompt, doc_prompt, order (columns that number the rows). Against texts, a label's only row goes. In sets named after arxiv half of the
    labels are cut to their field (cs.AI to cs).
    """
    name, n = conf.get("name", "mteb_cluster"), conf.get("num_hardneg", 0)
    title, body, label = _first(rows, "title", "headline"), _first(rows, "abstract", "short_description"), _first(rows, "category", "categories", "label")
    text = F.col(title) if conf.get("data_format", "p2p") == "s2s" else F.concat(title, F.lit("\n"), F.coalesce(F.col(body), F.lit("")) if body else F.lit(""))
    all_of = F.filter(F.split(label, r"\s+"), lambda s: s != "") if label == "categories" else F.array(label)
    if conf.get("data_type") == "against_text":
        return _against_texts(rows, conf, "mteb_cluster", text, F.get(all_of, F.lit(0)), alone=False)
    key = F.coalesce(text, F.lit(""))
    pos = _drawn(all_of, conf, key, 0)
    if "arxiv" in name:
        top = F.split(F.replace(pos, F.lit("-"), F.lit(".")), r"\.")[0]
        pos = F.when(draw_share(conf.get("seed", 0), F.lit(-1), key) < 0.5, top).otherwise(pos)
    negatives = F.array().cast("array<string>")
    if n > 0:
        known = _label_set(rows, conf, F.explode(all_of))
        negatives = sampled(F.array_except(F.array(*map(F.lit, known)).cast("array<string>"), all_of), n, conf.get("seed", 0), key, 1)
    doc = conf.get("doc_prompt", "")
    return _finished(rows, conf, "mteb_cluster", _said_with(conf.get("query_prompt", ""), text), _said_with(doc, pos), F.transform(negatives, lambda t: _said_with(doc, t)))


@register("mteb_training")
def labelled_texts(rows: DataFrame, conf: dict) -> DataFrame:
    """query or text with pos or label_text (lower case, trimmed), and neg where the set gives negatives.

    conf: data_type against_text draws a positive of the same label, and negatives of others where none are given; else labels are both. num_hardneg, labels,
    query_prompt, doc_prompt, order.
    """
    n, seed, doc = conf.get("num_hardneg", 0), conf.get("seed", 0), conf.get("doc_prompt", "")
    text, label = F.col(_first(rows, "query", "text")), F.lower(F.trim(F.col(_first(rows, "pos", "label_text"))))
    key, given = F.coalesce(text, F.lit("")), "neg" in rows.columns
    told = F.transform(sampled(F.col("neg"), n, seed, key, 1), lambda t: _said_with(doc, t)) if given else F.array().cast("array<string>")
    if conf.get("data_type") == "against_text":
        x = rows.withColumn("_told", told)
        out = _against_texts(x, conf | {"carry": [*conf.get("carry", []), "_told"]}, "mteb_training", text, label, alone=True)
        return out.withColumn("neg_text", F.when(F.size("_told") > 0, F.col("_told")).otherwise(F.col("neg_text"))).drop("_told")
    negatives = told
    if n > 0 and (conf.get("labels") or not given):
        others = F.array_except(F.array(*map(F.lit, _label_set(rows, conf, label))).cast("array<string>"), F.array(label))
        negatives = F.when(F.size(told) > 0, told).otherwise(F.transform(sampled(others, n, seed, key, 1), lambda t: _said_with(doc, t)))
    return _finished(rows, conf, "mteb_training", _said_with(conf.get("query_prompt", ""), text), _said_with(doc, label), negatives)
