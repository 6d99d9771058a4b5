"""Queries that write through the sinks and read back through the readers, with SQL twins of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as tx
from mnemospark.operators import gates, mixing, records, store
from mnemospark.operators.segmented import prefix
from mnemospark.plans.registry import query
from mnemospark.plans.tables import EVENTS_SQL, FACTS_SQL, clock_events, star_facts, table
from mnemospark.session import shared_dir, written
from mnemospark.sources import captions, files, parsers, sinks


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_NATION_CAPTIONS = """cap AS (SELECT '10sec' AS granularity, row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name AS text, 'DAY' || (n_regionkey + 1) AS date, lpad((n_nationkey * 100)::VARCHAR, 8, '0') AS t FROM nation
  UNION ALL SELECT '1h', row_number() OVER (ORDER BY r_regionkey) - 1, r_name, 'DAY' || (r_regionkey + 1), '9000000' FROM region)"""


def _captions_of(rows, key: str, name: str, day: str, time):
    return rows.select(F.col(key).alias("k"), F.struct(F.col(name).alias("text"), time.alias("start_time"), time.alias("end_time"), F.concat(F.lit("DAY"), (F.col(day) + 1).cast("string")).alias("date")).alias("c"))


@query("caption_files", f"WITH {_NATION_CAPTIONS} SELECT granularity || '_' || idx AS id, text, (substr(date, 4) || lpad(t, 8, '0'))::BIGINT AS start_ts, '' AS video_path, src FROM cap, (SELECT unnest(['file', 'memory']) AS src)")
def caption_files(spark, sf_dir):
    """Captions from JSON arrays in files and from memory; a granularity that is not known is skipped."""
    nation = _captions_of(table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_regionkey", F.lpad((F.col("n_nationkey") * 100).cast("string"), 8, "0"))
    region = _captions_of(table(spark, sf_dir, "region"), "r_regionkey", "r_name", "r_regionkey", F.lit("9000000"))
    root, paths, rows = _folder(spark, "captions"), {}, {}
    for g, part in (("10sec", nation), ("1h", region), ("week", region)):  # tables of 25 and 5 rows
        listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda e: e["c"])
        part.agg(F.to_json(listed).alias("value")).coalesce(1).write.text(f"{root}/{g}")
        paths[g] = f"{root}/{g}"
        rows[g] = [r.c.asDict() for r in part.orderBy("k").collect()]
    both = captions.read_captions(spark, paths).withColumn("src", F.lit("file")).unionByName(captions.captions_from_rows(spark, rows).withColumn("src", F.lit("memory")))
    return both.select("id", "text", "start_ts", "video_path", "src")


@query("vector_store_files", "WITH v AS (SELECT 'chunk-' || vec_id AS hash_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm FROM embeddings) SELECT hash_id, norm FROM v WHERE label <> 3")
def vector_store_files(spark, sf_dir):
    """Vectors appended twice, compacted, deleted by id, and read by namespace."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.lit("chunk").alias("namespace"), F.concat(F.lit("chunk-"), F.col("vec_id").cast("string")).alias("hash_id"), F.col("label").cast("string").alias("content"), "embedding")
    root = _folder(spark, "vectors")
    sinks.append_vectors(rows, f"{root}/log")
    sinks.append_vectors(rows.unionByName(rows.withColumn("namespace", F.lit("entity"))), f"{root}/log")
    sinks.compact(spark, f"{root}/log", f"{root}/store")
    kept = store.delete(files.read_vectors(spark, f"{root}/store", "chunk"), rows.filter("content = '3'"))
    return kept.select("hash_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


@query("merge_embedding_splits", "SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS split, label FROM embeddings")
def merge_embedding_splits(spark, sf_dir):
    """Of two split files the later one wins for the keys that it has."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return sinks.merge_splits(e.withColumn("split", F.lit(1)).unionByName(e.filter("key % 3 = 0").withColumn("split", F.lit(2))))


@query("rows_by_asked_order", "SELECT row_number() OVER (ORDER BY label, vec_id DESC) AS ordinal, CASE WHEN vec_id % 4 <> 0 THEN vec_id END AS found FROM embeddings")
def rows_by_asked_order(spark, sf_dir):
    """Point lookups keep the order asked for; ids that the store lacks stay, without a row."""
    e = table(spark, sf_dir, "embeddings")
    ids = prefix(e, [], ["label", F.desc("vec_id")]).select((F.col("position") + 1).alias("ordinal"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("hash_id"))
    held = e.filter("vec_id % 4 <> 0").select(F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("hash_id"), F.col("vec_id").alias("found"))
    return store.rows_in_order(held, ids).select("ordinal", "found")


@query("clip_embeddings", f"WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'by id' WHEN event_id % 5 = 1 THEN 'by path' WHEN event_id % 5 = 2 THEN 'by start' END AS how FROM ev")
def clip_embeddings(spark, sf_dir):
    """A clip's embedding is keyed by its id, else its path, else its start."""
    e = clock_events(spark, sf_dir).select("event_id", *[F.concat(F.lit(p), F.col("event_id").cast("string")).alias(c) for p, c in (("id", "clip_id"), ("path", "source_video_path"), ("start", "start_time"))])
    k = F.col("event_id") % 5
    named = lambda c, how, at: e.filter(at).select(F.col(c).alias("key"), F.lit(how).alias("embedding"))
    vectors = named("clip_id", "by id", k == 0).unionByName(named("source_video_path", "by path", k <= 1)).unionByName(named("start_time", "by start", k <= 2))
    return captions.clips_with_embeddings(e, vectors).select("event_id", F.col("embedding").alias("how"))


@query("extraction_files", "SELECT 'chunk-' || n_nationkey AS idx, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE lower(n_name) || ',place' END AS entities, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE 1 END AS n_triples FROM nation")
def extraction_files(spark, sf_dir):
    """An offline extraction file, read back and merged into documents; malformed triples and lacking results are empty."""
    n = table(spark, sf_dir, "nation").withColumns({"idx": F.concat(F.lit("chunk-"), F.col("n_nationkey").cast("string")), "low": F.lower("n_name")})
    some = n.filter("n_nationkey % 4 <> 0")  # a table of 25 rows
    maps = some.agg(
        F.map_from_entries(F.collect_list(F.struct("idx", F.array("low", F.lit("place"), "low")))).alias("ner_results"),
        F.map_from_entries(F.collect_list(F.struct("idx", F.array(F.array("low", F.lit("is a"), F.lit("place")), F.array("low", F.lit("short")))))).alias("triple_results"),
    )
    path = _folder(spark, "openie")
    maps.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(path)
    entities, triples = captions.read_openie(spark, path)
    gates.require_same_size(entities, triples)
    docs = records.merged_documents(n.select("idx"), entities, triples)
    return docs.select("idx", F.array_join(F.array_sort("extracted_entities", lambda a, b: F.when(a == "place", 1).when(b == "place", -1).otherwise(0)), ",").alias("entities"), F.size("extracted_triples").alias("n_triples"))


@query("subtitle_files", f"WITH {EVENTS_SQL} SELECT user_id, count(*) AS cues, sum(sec % 3600 + 11 * 3600)::DOUBLE AS starts, max(event_type) AS last_text FROM ev GROUP BY user_id")
def subtitle_files(spark, sf_dir):
    """Cues of each user written as a subtitle file whose name has an hour, and read back with the hour added."""
    e = clock_events(spark, sf_dir)
    cues = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_11000000")).alias("name"), F.col("event_id").alias("cue"), (F.col("sec") % 3600).alias("start_seconds"), (F.col("sec") % 3600 + 2).alias("end_seconds"), F.concat_ws("\n", F.lit("first line"), "event_type").alias("text"))
    path = _folder(spark, "subtitles")
    sinks.write_subtitles(cues, path)
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.concat(F.regexp_extract(F.input_file_name(), r"name=([^/]+)/", 1), F.lit(".srt")).alias("path"), "value")
    back = captions.hour_offset(captions.parse_subtitles(read, last_line=True))
    user = F.regexp_extract("path", r"u(\d+)_", 1).cast("long")
    return back.groupBy(user.alias("user_id")).agg(F.count(F.lit(1)).alias("cues"), F.sum("start_seconds").alias("starts"), F.max("text").alias("last_text"))


@query("translated_captions", f"WITH {EVENTS_SQL} SELECT event_id, lpad(sec::VARCHAR, 8, '0') AS start_time, lpad((sec + 30)::VARCHAR, 8, '0') AS end_time, event_type AS text FROM ev")
def translated_captions(spark, sf_dir):
    """JSON lines in their original order, written and read; start and end are the last parts of the id."""
    e = clock_events(spark, sf_dir)
    clock = lambda c: F.lpad(c.cast("string"), 8, "0")
    path = _folder(spark, "translated")
    lines = e.select("event_id", F.concat_ws("-", F.lit("A1-x"), clock(F.col("sec")), clock(F.col("sec") + 30)).alias("custom_id"), F.col("event_type").alias("text"))
    sinks.write_in_order(lines, "event_id", path)
    back = spark.read.schema("event_id long, custom_id string, text string").json(path)
    return back.select("event_id").join(captions.translated_captions(back.select("custom_id", "text", "event_id"), keep=["event_id"]), "event_id")


@query("multiple_choice_rows", "SELECT doc_id::VARCHAR AS \"ID\", lang AS duration, 'one ' || doc_id AS choice_a, CASE WHEN doc_id % 2 = 0 THEN 'two' END AS choice_b, 'B' AS answer FROM documents WHERE lang = 'en'")
def multiple_choice_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    options = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("A. one "), F.col("doc_id").cast("string")), F.lit("B. two"))).otherwise(F.array(F.concat(F.lit("A. one "), F.col("doc_id").cast("string"))))
    rows = d.select(F.col("doc_id").cast("string").alias("question_id"), F.lit("t").alias("task_type"), F.col("source").alias("videoID"), F.col("lang").alias("duration"), F.lit("d").alias("domain"), F.lit("s").alias("sub_category"), F.lit("q").alias("question"), options.alias("options"), F.lit("B").alias("answer"))
    return parsers.multiple_choice_rows(rows, "en").select("ID", "duration", "choice_a", "choice_b", "answer")


@query("flattened_questions", "SELECT conv_id, conv_id || '-' || turn || '-' || n AS uid, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM conversations)")
def flattened_questions(spark, sf_dir):
    """Records with a list of questions, one row a question; a uid that occurs twice is an error."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    qa = c.groupBy("conv_id").agg(F.collect_list(F.struct(F.concat_ws("-", "conv_id", "turn", "n").alias("uid"), "role")).alias("qa"))
    out = captions.flattened_questions(qa).select("conv_id", "uid", "role")
    return gates.require_unique(out, "uid")


@query("indexed_rows", "SELECT row_number() OVER (ORDER BY pos DESC) AS ordinal, pos, n_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation) WHERE pos % 2 = 1")
def indexed_rows(spark, sf_dir):
    """Elements of a JSON array in a file, selected by a manifest of positions, in its order."""
    from mnemospark.operators.evallog import select_manifest

    path = _folder(spark, "array")
    n = table(spark, sf_dir, "nation").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda e: F.struct(e["n_name"].alias("n_name")))).alias("value"))
    n.coalesce(1).write.text(path)
    rows = files.indexed_rows(spark, path, "n_name: string").withColumn("pos", F.col("pos").cast("long"))
    manifest = prefix(rows.filter("pos % 2 = 1"), [], [F.desc("pos")]).select((F.col("position") + 1).alias("ordinal"), "pos")
    return select_manifest(gates.require_known(rows, rows, "pos"), manifest, "pos").select("ordinal", "pos", "n_name")


@query("consecutive_groups", f"WITH {EVENTS_SQL}, x AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM ev) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first FROM x WHERE ok GROUP BY ALL")
def consecutive_groups(spark, sf_dir):
    e = clock_events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return captions.consecutive_groups(e, "user_id", "event_id", "ok").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("concatenated_datasets", "SELECT 'docs' AS subset, doc_id, text IS NOT NULL AS has_text, CAST(NULL AS BIGINT) AS item_id FROM documents UNION ALL SELECT 'bench', NULL, true, item_id FROM benchmark")
def concatenated_datasets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNotNull().alias("has_text"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.lit(True).alias("has_text"))
    return mixing.concatenate({"docs": d, "bench": b}).select("subset", "doc_id", "has_text", "item_id")


_ASK = "'" + parsers.ANSWER_PROMPT + " '"


@query(
    "dataset_parsers",
    f"""WITH d AS (SELECT doc_id, source, coalesce(lang, 'xx') AS lang FROM documents),
    x AS (SELECT 'msvd' AS name, 'Find the video snippet that corresponds to the given summary: ' || source AS query_text, doc_id::VARCHAR AS label_name, 1 AS n, doc_id::VARCHAR AS first_text, NULL AS query_media FROM d
    UNION ALL SELECT 'mvbench', {_ASK} || source || chr(10) || 'Options:' || chr(10) || '(A) ' || lang || chr(10) || '(B) none', '(B) none', 2, '(A) ' || lang, 's/' || doc_id FROM d
    UNION ALL SELECT 'nextqa', {_ASK} || source || chr(10) || 'Options:' || chr(10) || '(A) a' || chr(10) || '(B) b' || chr(10) || '(C) ' || lang || chr(10) || '(D) d' || chr(10) || '(E) e', lang, 5, 'a', doc_id || '.mp4' FROM d
    UNION ALL SELECT 'videomme', {_ASK} || source || chr(10) || 'A. ' || lang || '.' || chr(10) || 'B. two', 'B. two', 2, lang, doc_id || '.mp4' FROM d
    UNION ALL SELECT 'videommmu', {_ASK} || source || chr(10) || 'Options:' || chr(10) || '(A) A. ' || lang || '.' || chr(10) || '(B) B. two', 'B', 2, lang, 'sub/' || doc_id || '.mp4' FROM d WHERE doc_id % 2 = 0
    UNION ALL SELECT 'activitynetqa', {_ASK} || source || '? (A) yes; (B) no.', 'no', 2, 'yes', 'v_' || doc_id || '.mp4' FROM d
    UNION ALL SELECT 'didemo', 'Find a video that includes the following described scenes: ' || source, 'clip' || doc_id, 1, 'clip' || doc_id, NULL FROM d
    UNION ALL SELECT 'momentseeker', source, 'pos_' || doc_id, 2, 'pos_' || doc_id, 'in.mp4' FROM d
    UNION ALL SELECT 'visrag', 'Find a document image that matches the given query: ' || source, doc_id || '.png', 1, doc_id || '_' || substr(md5(doc_id || '.png'), 1, 8) || '.png', NULL FROM d
    UNION ALL SELECT 'image_i2i_vg', chr(10) || 'Look ' || source || chr(10), doc_id || '.png:' || lang, 1, 'Pick "' || lang || '"', 'q.png' FROM d
    UNION ALL SELECT 'image_cls', 'Look' || chr(10) || ' ' || source || chr(10), lang, 1, lang, 'q.png' FROM d
    UNION ALL SELECT 'mteb_cluster', source, lang, 0, NULL, NULL FROM d)
    SELECT name, md5(query_text) AS asked, label_name, n::BIGINT AS n, first_text, query_media FROM x""",
)
def dataset_parsers(spark, sf_dir):
    """Rows of one table, as a dozen datasets would hold them, through their parsers; a configuration file renames columns."""
    d = table(spark, sf_dir, "documents").select("source", F.coalesce("lang", F.lit("xx")).alias("lang"), F.col("doc_id").cast("string").alias("id"), "doc_id")
    files.put_file(spark, path := f"{_folder(spark, 'config')}/sets.json", '{"msvd": {"query": "source", "names": "array(id)", "label": "id"}}')
    conf = files.read_config(spark, path)
    mp4 = F.concat("id", F.lit(".mp4"))
    pair = F.array(F.concat(F.lit("A. "), "lang", F.lit(".")), F.lit("B. two"))
    q = F.col("source").alias("question")
    image = [F.lit("q.png").alias("qry_img_path"), F.array(F.concat(F.lit('"'), "lang", F.lit('"'))).alias("tgt_text"), F.lit("Pick<|image_1|>").alias("tgt_inst"), F.array(F.concat("id", F.lit(".png"))).alias("tgt_img_path"), F.col("source").alias("qry_text")]
    held = {
        "msvd": d,
        "mvbench": d.select(q, F.array("lang", F.lit("none")).alias("candidates"), F.lit("none").alias("answer"), F.lit("s").alias("subset"), F.col("id").alias("video")),
        "nextqa": d.select(q, *[F.lit(x).alias(f"a{k}") if k != 2 else F.col("lang").alias("a2") for k, x in enumerate("abcde")], F.lit(2).alias("answer"), F.col("id").alias("video")),
        "videomme": d.select(q, pair.alias("options"), F.lit("B").alias("answer"), F.col("id").alias("videoID")),
        "videommmu": d.select(q, pair.alias("options"), F.lit("B").alias("answer"), "id", F.lit("sub").alias("subset"), F.when(F.col("doc_id") % 2 == 0, "multiple-choice").otherwise("open").alias("question_type")),
        "activitynetqa": d.select(q, F.lit("no").alias("answer"), F.col("id").alias("video_name")),
        "didemo": d.select(F.col("source").alias("caption"), F.concat(F.lit("x/clip"), mp4).alias("video")),
        "momentseeker": d.select(F.col("source").alias("query"), F.array(F.concat(F.lit("pos/"), mp4)).alias("positive_frames"), F.array(F.lit("neg/1.mp4")).alias("negative_frames"), F.lit("in.mp4").alias("input_frames")),
        "visrag": d.select(F.col("source").alias("query"), F.array(F.concat("id", F.lit(".png"))).alias("corpus_ids")),
        "image_i2i_vg": d.select(F.lit("<|image_1|> Look").alias("qry_inst"), *image),
        "image_cls": d.select(F.lit("Look \n<|image_1|>").alias("qry_inst"), *image[:1], F.array("lang").alias("tgt_text"), image[4]),
    }
    out = None
    for name, rows in held.items():
        one = parsers.parse(parsers.EVALUATION, name, rows, conf.get(name)).select(F.lit(name).alias("name"), F.md5(F.col("query_text").cast("binary")).alias("asked"), "label_name", F.size("cand_names").cast("long").alias("n"), F.get("cand_texts", F.lit(0)).alias("first_text"), "query_media")
        out = one if out is None else out.unionByName(one)
    trained = parsers.parse(parsers.TRAINING, "mteb_cluster", d.select(F.col("source").alias("title"), F.col("lang").alias("label")), {"data_format": "s2s"})
    return out.unionByName(trained.select(F.col("global_dataset_name").alias("name"), F.md5(F.col("query_text").cast("binary")).alias("asked"), F.col("pos_text").alias("label_name"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("first_text"), F.lit(None).cast("string").alias("query_media")))


@query("unit_files", "SELECT 'unit' || n_nationkey AS unit_id, n_nationkey % 3 = 0 AS has_video FROM nation WHERE n_nationkey % 2 = 0")
def unit_files(spark, sf_dir):
    """Units are the folders that hold a base caption file; their videos are found by key, then by stem."""
    root = _folder(spark, "units")
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows
    for k in keys:
        files.put_file(spark, f"{root}/unit{k}/{'10sec' if k % 2 == 0 else 'other'}.json", "[]")
        if k % 3 == 0:
            files.put_file(spark, f"{root}/videos/deep/unit{k}.mp4", "x")
    units = files.units_with(spark, root)
    videos = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(root).select("path")
    found = files.resolved_videos(units.select("unit_id", F.concat("unit_id", F.lit(".mp4")).alias("name")), videos, root)
    return found.select("unit_id", F.col("path").isNotNull().alias("has_video"))


@query("image_folder", "SELECT n_nationkey::BIGINT AS frame_index, length(n_name)::BIGINT AS n_bytes, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def image_folder(spark, sf_dir):
    """Images in natural order: frame10 comes after frame9."""
    root = _folder(spark, "images")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        files.put_file(spark, f"{root}/frame{r.n_nationkey}.jpg", r.n_name)
    images = captions.natural_order(files.read_images(spark, root), "path")
    return prefix(images, [], ["frame_index"]).select("frame_index", F.length("content").cast("long").alias("n_bytes"), (F.col("position") + 1).alias("place"))


@query("graph_files", f"WITH {FACTS_SQL} SELECT src, dst, count(*) AS n FROM (SELECT s AS src, o AS dst FROM facts WHERE s <> o) GROUP BY ALL")
def graph_files(spark, sf_dir):
    f = star_facts(spark, sf_dir)
    edges = f.filter("s <> o").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    path = _folder(spark, "graph")
    files.write_graph(f.select(F.explode(F.array("s", "o")).alias("id")).distinct(), edges, path)
    vertices, back = files.read_graph(spark, path)
    return back.join(vertices.withColumnRenamed("id", "src"), "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("result_files", f"WITH {EVENTS_SQL} SELECT event_type, count(*) AS logged, count(*) AS once FROM ev GROUP BY 1")
def result_files(spark, sf_dir):
    """A log appended in two parts, and a result that is written once, kept while readable, and made again when broken."""
    e = clock_events(spark, sf_dir).select("event_id", "event_type")
    root = _folder(spark, "results")
    for part in (0, 1):
        sinks.append_log(e.filter(F.col("event_id") % 2 == part), f"{root}/log")
    files.put_file(spark, f"{root}/final/broken.json", "{")
    sinks.write_once(e, f"{root}/final")
    sinks.write_once(e.limit(1), f"{root}/final")  # the whole result is there and stays
    count = lambda path, name: spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias(name))
    return count(f"{root}/log", "logged").join(count(f"{root}/final", "once"), "event_type")


@query("source_files", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def source_files(spark, sf_dir):
    path = _folder(spark, "sources")
    sinks.by_source(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))


@query("retrieval_files", f"WITH {EVENTS_SQL}, q AS (SELECT DISTINCT user_id, event_type, value FROM ev) SELECT event_type AS doc_id, 'text of ' || event_type AS text, count(*) AS judged, count(DISTINCT user_id) AS queries FROM q GROUP BY 1")
def retrieval_files(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    pairs = e.select(F.col("user_id").alias("query_id"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"), F.col("event_type").alias("doc_id"), F.concat(F.lit("text of "), F.col("event_type")).alias("text"), F.col("value").alias("score"))
    path = _folder(spark, "beir")
    sinks.retrieval_tables(pairs, path)
    q, c, r = (spark.read.json(f"{path}/{n}") for n in ("queries", "corpus", "qrels"))
    return r.join(q, "query_id").join(c, "doc_id").groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("judged"), F.countDistinct("query_id").alias("queries"))


@query("cached_calls", "SELECT count(DISTINCT coalesce(text, '')) AS prompts, count(DISTINCT coalesce(text, '')) AS answered, (SELECT count(DISTINCT coalesce(text, '')) FROM documents WHERE coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE lang = 'en')) AS called_again FROM documents")
def cached_calls(spark, sf_dir):
    """Responses and vectors of prompts that the cache has are read from it; only the others are asked for."""
    from mnemospark.functions.providers import HashEmbedder, embed_column

    d = table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).alias("prompt"), F.lit("m").alias("model"), F.lit("text").alias("format"))
    call = lambda misses: embed_column(misses, "key", "prompt", HashEmbedder(8)).select("key", F.to_json("vector").alias("response"))
    none = spark.createDataFrame([], "key string, response string")
    cache = written(sinks.cached_calls(d.filter("lang = 'en'").drop("lang"), none, call), "cache")
    whole = written(sinks.cached_calls(d.drop("lang"), cache, call), "cache")
    again = whole.join(cache.select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("called_again"))
    return whole.agg(F.countDistinct("key").alias("prompts"), F.count_if(F.col("response").isNotNull()).alias("answered")).join(F.broadcast(again))


_REPORT = "r AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY lang)"


@query(
    "report_pages",
    f"""WITH {_REPORT} SELECT 'markdown' AS format, '# Documents & <langs>' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS page FROM r
    UNION ALL SELECT 'json', '[' || string_agg('{{"lang": "' || lang || '", "n": ' || n || '}}', ', ' ORDER BY lang) || ']' FROM r
    UNION ALL SELECT 'html', '<!doctype html><title>Documents &amp; &lt;langs&gt;</title><table><tr><th>lang</th><th>n</th></tr>' || string_agg('<tr><td>' || lang || '</td><td>' || n || '</td></tr>', '' ORDER BY lang) || '</table>' FROM r""",
)
def report_pages(spark, sf_dir):
    r = table(spark, sf_dir, "documents").filter("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang")
    path = _folder(spark, "report")
    sinks.write_report(spark, r, "Documents & <langs>", path)
    read = lambda kind: spark.read.text(f"{path}/report.{kind}", wholetext=True).select(F.lit({"md": "markdown"}.get(kind, kind)).alias("format"), F.col("value").alias("page"))
    return read("md").unionByName(read("json")).unionByName(read("html"))


@query("submission_files", f"WITH {EVENTS_SQL}, l AS (SELECT user_id, arg_max(event_type, event_id) AS t, max(event_id) AS e FROM ev GROUP BY 1) SELECT 'submission' AS file, count(*) AS n, sum(e)::BIGINT AS checksum FROM l WHERE t = 'purchase' UNION ALL SELECT 'missing', count(*), sum(user_id)::BIGINT FROM l WHERE t <> 'purchase' UNION ALL SELECT 'manifest', (SELECT count(*) FROM l), (SELECT count(*) FROM l WHERE t = 'purchase')")
def submission_files(spark, sf_dir):
    """The successful answers as a submission, what it lacks, and a manifest of the run with both counts."""
    e = clock_events(spark, sf_dir)
    asked = e.select(F.col("user_id").alias("key")).distinct()
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "success").otherwise("error").alias("status"), F.col("event_id").cast("string").alias("answer"))
    path = _folder(spark, "submission")
    sinks.write_submission(asked, log, "key", "seq", {"run": "r1"}, path)
    sub = spark.read.schema("key long, answer string").json(f"{path}/submission").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("answer").cast("long")).alias("checksum"))
    gap = spark.read.schema("key long").json(f"{path}/missing").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("checksum"))
    run = spark.read.schema("run string, expected long, answered long").json(f"{path}/manifest").select(F.col("expected").alias("n"), F.col("answered").alias("checksum"))
    named = lambda df, name: df.select(F.lit(name).alias("file"), "n", "checksum")
    return named(sub, "submission").unionByName(named(gap, "missing")).unionByName(named(run, "manifest"))


@query("incremental_store", "SELECT 'chunk-' || md5(text) AS hash_id, count(*) AS copies, 1::BIGINT AS stored FROM documents WHERE text IS NOT NULL GROUP BY 1")
def incremental_store(spark, sf_dir):
    """Documents arrive as two folders of files; a stream adds what the store lacks, and a second run adds nothing."""
    from mnemospark.streaming import streams

    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tx.chunk_id(F.col("text")).alias("hash_id"), F.col("text").alias("content"))
    root = _folder(spark, "arrivals")
    embed = lambda df: df.select("hash_id", F.length("content").alias("vector"))
    for part in (0, 1, 1):
        if part == 0 or spark.read.parquet(f"{root}/in").filter(F.col("doc_id") % 2 == 1).isEmpty():
            d.filter(F.col("doc_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        arriving = streams.folder(spark, f"{root}/in", "doc_id long, hash_id string, content string").select("hash_id", "content")
        streams.upsert_store(arriving, f"{root}/store", embed, f"{root}/mark").awaitTermination()
    kept = spark.read.parquet(f"{root}/store").groupBy("hash_id").agg(F.count(F.lit(1)).alias("stored"))
    return d.groupBy("hash_id").agg(F.count(F.lit(1)).alias("copies")).join(kept, "hash_id")


@query("appended_log_stream", f"WITH {EVENTS_SQL} SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS event_type FROM ev GROUP BY 1")
def appended_log_stream(spark, sf_dir):
    """Events through an exactly-once file sink, resumed from its checkpoint; the last record of each user wins."""
    from mnemospark.operators.evallog import latest
    from mnemospark.streaming import streams

    e = clock_events(spark, sf_dir).select("event_id", "user_id", "event_type")
    root = _folder(spark, "log-stream")
    for part in (0, 1):
        e.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/in")
        stream = streams.folder(spark, f"{root}/in", "event_id long, user_id long, event_type string")
        streams.appended(stream, f"{root}/out", f"{root}/mark").awaitTermination()
    return latest(spark.read.parquet(f"{root}/out"), "user_id", "event_id").select("user_id", F.col("event_id").alias("last_event"), "event_type")


@query("versioned_vector_store", "SELECT 'chunk-' || md5(text) AS hash_id, any_value(text) AS content, length(any_value(text))::DOUBLE AS size FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING min(doc_id) % 7 <> 0 OR bool_or(doc_id % 3 = 0)")
def versioned_vector_store(spark, sf_dir):
    """A stream of changes over a versioned store: two thirds of the documents arrive, every seventh is deleted, the last third brings some back."""
    from mnemospark.streaming import streams
    from mnemospark.sources.versioned import VectorStore

    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", tx.chunk_id(F.col("text")).alias("hash_id"), F.col("text").alias("content"))
    first = d.groupBy("hash_id").agg(F.min("doc_id").alias("first"), F.any_value("content").alias("content"))
    root = _folder(spark, "versions")
    embed = lambda df: df.select("hash_id", "content", F.array(F.length("content").cast("double")).alias("embedding"))
    arrivals = [first.select("hash_id", "content", F.lit(False).alias("gone")), first.filter("first % 7 = 0").select("hash_id", F.lit(None).cast("string").alias("content"), F.lit(True).alias("gone")), d.filter("doc_id % 3 = 0").select("hash_id", "content", F.lit(False).alias("gone"))]
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{root}/in")
        changes = streams.folder(spark, f"{root}/in", "hash_id string, content string, gone boolean")
        streams.maintain_store(changes, f"{root}/store", embed, f"{root}/mark").awaitTermination()
    return VectorStore(spark, f"{root}/store").read().select("hash_id", "content", F.col("embedding")[0].alias("size"))


_STAYS = "kept AS (SELECT * FROM facts WHERE length(chunk) % 2 = 1 OR right(chunk, 1) IN ('0', '3', '6'))"


@query("incremental_graph", f"WITH {FACTS_SQL}, {_STAYS} SELECT src, dst, count(*)::DOUBLE AS weight FROM (SELECT s AS src, o AS dst FROM kept WHERE s <> o UNION ALL SELECT o, s FROM kept WHERE s <> o) GROUP BY ALL")
def incremental_graph(spark, sf_dir):
    """The fact graph after chunks were added, taken out and added again by signed counts; the twin builds it from what stays."""
    from mnemospark.operators.graph_delta import IncrementalGraph

    facts = star_facts(spark, sf_dir)
    g = IncrementalGraph(spark, _folder(spark, "graph"))
    odd = F.length("chunk") % 2 == 1
    back = F.substring("chunk", -1, 1).isin("0", "3", "6")
    g.add(facts.filter(odd))
    g.add(facts)  # what is there is not counted twice
    g.delete(facts.filter(~odd).select("chunk"))
    g.add(facts.filter(~odd & back))
    g.compact(most=2)
    return g.weights()


@query("ranged_json_array", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id, text, lang FROM documents")
def ranged_json_array(spark, sf_dir):
    """All documents as one JSON array in one file, read back by byte ranges."""
    from mnemospark.sources.json_ranges import read_array

    d = prefix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), [], ["doc_id"], size="n")
    first, last = F.col("position") == 0, F.col("position") == F.col("n") - 1
    line = F.concat(F.when(first, "[\n").otherwise(""), F.to_json(F.struct("doc_id", "text", "lang")), F.when(last, "\n]").otherwise(","))
    root = _folder(spark, "array")
    d.select("position", line.alias("value")).coalesce(1).sortWithinPartitions("position").select("value").write.text(root)  # one file, as it comes
    return read_array(spark, f"{root}/part-*", "doc_id long, text string, lang string", range_bytes=100_000).select("pos", "doc_id", "text", "lang")
