"""Training sets over the documents, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.text import LOST_CHARACTERS, PLAIN_CHARACTERS, PLAIN_SEQUENCES
from mnemospark.plans.registry import query
from mnemospark.plans.tables import table
from mnemospark.sources import parsers

SEED, NEGATIVES = 7, 3

_quoted = lambda s: s.replace("'", "''")


def _plain_sql(x: str) -> str:
    for froms, to in [(c, k) for k, v in PLAIN_CHARACTERS.items() for c in v] + [(c, "") for c in LOST_CHARACTERS] + list(PLAIN_SEQUENCES.items()):
        x = f"replace({x}, chr({ord(froms)}), '{_quoted(to)}')" if len(froms) == 1 else f"replace({x}, '{froms}', '{to}')"
    return x


def _share_sql(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:' || ({salt}) || ':' || {key}), 1, 8))::BIGINT / 4294967296.0)"


def _places_sql(i: str, size: str, key: str, salt: int, n: int = NEGATIVES) -> str:
    low, high = f"(({i}) * ({size})) // {n}", f"(({i}) + 1) * ({size}) // {n}"
    return f"({low} + floor({_share_sql(f'{i} + {salt}', key)} * ({high} - {low}))::BIGINT)"


_BY_LABEL = f"""WITH d AS (SELECT doc_id, lang, source || chr(10) || coalesce(text, '') AS body FROM documents WHERE lang IS NOT NULL),
  x AS (SELECT *, row_number() OVER (ORDER BY lang, doc_id) - 1 AS spot, count(*) OVER (PARTITION BY lang) AS own, count(*) OVER () AS t FROM d),
  s AS (SELECT *, min(spot) OVER (PARTITION BY lang) AS start FROM x),
  u AS (SELECT doc_id, own, t, start, spot, i, {_places_sql('i', 't - own', 'spot', 1)} AS u FROM s, (SELECT unnest(range({NEGATIVES})) AS i) WHERE t > own),
  n AS (SELECT u.doc_id, list('Q: ' || {_plain_sql('o.body')} ORDER BY i) AS neg FROM u JOIN s o ON o.spot = CASE WHEN u.u < u.start THEN u.u ELSE u.u + u.own END GROUP BY 1)
  SELECT s.doc_id, md5('Q: ' || {_plain_sql('s.body')}) AS asked, md5('Q: ' || {_plain_sql('p.body')}) AS positive, md5(array_to_string(neg, '|')) AS negatives
  FROM s JOIN s p ON p.spot = s.start + floor({_share_sql('0', 's.spot')} * s.own)::BIGINT LEFT JOIN n ON n.doc_id = s.doc_id WHERE s.own > 1"""

_md5 = lambda c: F.md5(c.cast("binary"))


@query("training_against_texts", _BY_LABEL)
def training_against_texts(spark, sf_dir):
    """Every document with a drawn text of its language and three of other languages, out of all documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("abstract"), F.col("lang").alias("category"))
    conf = {"data_type": "against_text", "num_hardneg": NEGATIVES, "seed": SEED, "order": ["doc_id"], "carry": ["doc_id"], "query_prompt": "Q: "}
    x = parsers.parse(parsers.TRAINING, "mteb_cluster", d, conf)
    return x.select("doc_id", _md5(F.col("query_text")).alias("asked"), _md5(F.col("pos_text")).alias("positive"), _md5(F.array_join("neg_text", "|")).alias("negatives"))


_SETS = {
    "didemo": ("'Find a video that includes the following described scenes: ' || source", "'<|video_pad|> Understand the content of the provided video.'", "'r/clip' || doc_id"),
    "msrvtt": ("'Find a video that contains the following visual content: ' || source", "'<|video_pad|> Understand the content of the provided video.'", "'r/' || doc_id"),
    "msvd": ("'Find a video that contains the following visual content: ' || source", "'<|video_pad|> Understand the content of the provided video.'", "'r/' || doc_id"),
    "video_classification": ("'<|video_pad|> What activities or sports are being performed by the person in the video?'", "lang", "'r/' || doc_id"),
    "ssv2": ("'<|video_pad|> What actions or object interactions are being performed by the person in the video?'", "lang", "'r/' || doc_id"),
    "llavahound_caption": ("'<|video_pad|> ' || source", "text", "'r/' || doc_id"),
    "llavahound_qa": ("'Answer a question based on the content of a video. <|video_pad|> ' || source", "text", "'r/' || doc_id"),
    "mmeb": ("'<|image_pad|>' || source", "lang", "'r/' || doc_id || '.png'"),
    "gui": ("source", "lang", "'r/a' || doc_id || ',r/b' || doc_id"),
    "pixmo": ("'Retrieve documents that best answer the following query: ' || source", "'Generate an embedding for the following document, in the format of images: <|image_pad|>'", "'r/' || doc_id || '.png'"),
    "vidore": ("'<|image_pad|> ' || source", "lang", "doc_id || '.png'"),
    "visrag": ("source || ' '", "' <|image_pad|>'", "doc_id || '.png'"),
    "docmatix": ("'Given the question below, retrieve the most relevant PDF document that can help answer it:' || chr(10) || ':  Q: ' || source", "'Represent the following PDF pages:  <|image_pad|><|image_pad|>'", "doc_id || '.png,b.png'"),
}


@query("training_sets", "WITH d AS (SELECT doc_id, source, lang, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{k}' AS name, doc_id, md5({q}) AS asked, md5({p}) AS positive, {m} AS media FROM d" for k, (q, p, m) in _SETS.items()))
def training_sets(spark, sf_dir):
    """Documents, as thirteen training sets would hold them, through their parsers."""
    d = table(spark, sf_dir, "documents").filter("lang is not null and text is not null").select("doc_id", F.col("doc_id").cast("string").alias("id"), "source", "lang", "text")
    png, said = F.concat("id", F.lit(".png")), F.struct(F.col("text").alias("value"))
    talk = F.array(F.struct(F.concat(F.lit("<video> "), "source").alias("value")), said)
    clip = lambda caption: d.select("doc_id", F.col("id").alias("video_id"), caption.alias("caption"))
    video = d.select("doc_id", F.col("id").alias("video"), talk.alias("conversations"))
    pages = d.select("doc_id", F.col("source").alias("query"), F.struct(png.alias("path")).alias("image"), F.col("lang").alias("answer"), F.lit("other").alias("source"))
    held = {
        "didemo": d.select("doc_id", F.col("source").alias("caption"), F.concat(F.lit("x/clip"), "id", F.lit(".mp4")).alias("video")),
        "msrvtt": clip(F.array("source")),
        "msvd": clip(F.array("source", "lang")),
        "video_classification": d.select("doc_id", F.col("doc_id").alias("video_id"), F.col("lang").alias("pos_text")),
        "ssv2": d.select("doc_id", F.col("id").alias("video_id"), F.col("lang").alias("pos_text")),
        "llavahound_caption": video,
        "llavahound_qa": video,
        "mmeb": d.select("doc_id", F.concat(F.lit("<|image_1|>"), "source").alias("qry"), png.alias("qry_image_path"), F.col("lang").alias("pos_text"), F.lit(None).cast("string").alias("pos_image_path")),
        "gui": d.select("doc_id", F.col("source").alias("qry_text"), F.format_string("['a%s', 'b%s']", "id", "id").alias("qry_image_path"), F.col("lang").alias("pos_text"), F.lit("").alias("pos_image_path")),
        "pixmo": d.select("doc_id", F.col("source").alias("query_text"), F.array("id").alias("positive_document_ids")),
        "vidore": pages,
        "visrag": pages,
        "docmatix": d.select("doc_id", F.array(F.struct(F.col("source").alias("user"))).alias("texts"), F.array(F.struct(png.alias("path")), F.struct(F.lit("b.png").alias("path"))).alias("images")),
    }
    out = None
    for name, rows in held.items():
        conf = {"carry": ["doc_id"], "root": "r"} | ({"dataset": "UCF101"} if name == "video_classification" else {})
        x = parsers.parse(parsers.TRAINING, name, rows, conf)
        one = x.select(F.col("global_dataset_name").alias("name"), "doc_id", _md5(F.col("query_text")).alias("asked"), _md5(F.col("pos_text")).alias("positive"), F.array_join(F.coalesce("query_media", "pos_media"), ",").alias("media"))
        out = one if out is None else out.unionByName(one)
    return out
