"""From raw files to recognised documents: text files written from ``documents``, pages and embedded text from ``conversations``."""

import os
import re
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from dossierlens.catalog import bindings as b
from dossierlens.catalog.registry import query
from dossierlens.plans import recognition
from dossierlens.sources import readers
from dossierlens.storage import scratch_path

THRESHOLD = 0.6
# By conversation: a PDF with embedded text, a scanned one, an image, or a type nobody knows; every eleventh has no recognised word.
MIME = """element_at(array('application/pdf', 'application/pdf', 'IMAGE/PNG ', 'application/octet-stream'), cast(conv_id % 4 as int) + 1)"""

# A file per document: every task moves its own files to their place, where the default leaves them all to the driver.
ONE_FILE_A_ROW = {"compression": "none", "mapreduce.fileoutputcommitter.algorithm.version": "2"}
# Ids of a folder where tasks write the files themselves; every folder is listed by its own call and known to the driver.
FOLDER_IDS = 1000


def _local(path):
    """The plain name of a path on the local file system (or one mounted there), None for other stores."""
    found = re.match(r"(?:file:(?://(?=/))?)?(/(?!/).*)", path)
    return found and found.group(1)


def _files_of_a_task(root):
    """Writes the rows of a task as ``<root>/doc_id=<ids>/part-<task>-doc_id=<id>.txt``, one line per row; a file appears whole, and a
    repeated task replaces its files by the same ones."""
    def write(batches):
        task, known, rows = TaskContext.get(), set(), 0
        lines = ((key, line) for batch in batches for key, line in zip(
            batch.column("doc_id").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()))
        for key, group in groupby(lines, lambda row: row[0]):
            ids = "none" if key is None else f"{key - key % FOLDER_IDS}-{key - key % FOLDER_IDS + FOLDER_IDS - 1}"
            folder = f"{root}/doc_id={ids}"
            if folder not in known:
                os.makedirs(folder, exist_ok=True)
                known.add(folder)
            name = f"part-{task.partitionId():05d}-doc_id={key}.txt"
            hidden = f"{folder}/.{name}-{task.taskAttemptId()}"
            with open(hidden, "wb") as out:
                for _, line in group:
                    out.write(line + b"\n")
                    rows += 1
            os.replace(hidden, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])
    return write


def write_text_files(texts, path):
    """One text file per ``doc_id``, the lines of which are its rows. Hadoop's local file system starts a process for each permission
    it sets, two a file, so there the tasks write their files themselves; other stores go through Spark's writer."""
    root = _local(path)
    if root is None:
        texts.write.options(**ONE_FILE_A_ROW).partitionBy("doc_id").text(path)
    else:
        os.makedirs(root, exist_ok=True)
        texts.sortWithinPartitions("doc_id").mapInArrow(_files_of_a_task(root), "n long").agg(F.sum("n")).collect()


def text_files(spark, sf_dir):
    """The texts of ``documents`` as files of the raw zone, read back as such."""
    path = scratch_path(spark, "raw")
    write_text_files(b.spread(b.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value")), "doc_id"), path)
    accepted, _ = readers.read_raw(spark, path, accepted=["text/plain"])
    return accepted.select(F.concat(F.lit("doc-"), F.regexp_extract("path", r"doc_id=([0-9]+)(?:/|\.txt$)", 1)).alias("document_id"), "mime_type", "content")


@query("s01_read_raw", """
    SELECT 'doc-' || doc_id AS document_id, 'text/plain' AS mime_type, cast(strlen(coalesce(text, '')) + 1 AS bigint) AS length FROM documents""")
def read_raw(spark, sf_dir):
    return text_files(spark, sf_dir).select("document_id", "mime_type", F.octet_length("content").cast("bigint").alias("length"))


@query("s02_decode_text", r"""
    WITH c AS (SELECT doc_id, regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '0([A-Z])', 'O\1', 'g'),
        '([A-Z])0', '\1O', 'g'), '\|', 'I', 'g'), '§IRET', 'SIRET'), '§IREN', 'SIREN'), '[ \t]+', ' ', 'g') AS t FROM documents),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c),
    j AS (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM l
        WHERE regexp_matches(line, '[a-zA-Z0-9€]') GROUP BY doc_id)
    SELECT 'doc-' || doc_id AS path, md5(coalesce(j.t, '')) AS text_hash, 1.0::double AS confidence, 'plain_text' AS method,
      cast(len(regexp_extract_all(coalesce(j.t, ''), '[^ \t\r\n]+')) AS integer) AS word_count FROM c LEFT JOIN j USING (doc_id)""")
def decode_text(spark, sf_dir):
    files = text_files(spark, sf_dir).withColumnRenamed("document_id", "path")
    return readers.decode_text(files).select("path", F.md5(F.col("text").cast("binary")).alias("text_hash"), "confidence", "method", "word_count")


def scanned_files(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").select("conv_id").distinct().selectExpr(
        "concat('conv-', conv_id) as document_id", f"{MIME} as mime_type", "cast('%PDF' as binary) as content")


def embedded_text(spark, sf_dir):
    """The turns of every fourth conversation as the text of a PDF; the first turn alone where it is the only one kept."""
    turns = b.table(spark, sf_dir, "conversations").where("conv_id % 4 = 0")
    return turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n\n").alias("text")).select(
        F.concat(F.lit("conv-"), "conv_id").alias("document_id"), F.when(F.col("conv_id") % 8 == 0, F.col("text")).otherwise(
            F.substring("text", 1, 40)).alias("text"))


def page_words(spark, sf_dir):
    """Two recognition passes over every turn, the page of a document."""
    turns = b.spread(b.table(spark, sf_dir, "conversations").where("conv_id % 11 <> 10"), "conv_id")
    lines = turns.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    words = lines.select("*", F.posexplode(F.split("l", " ")).alias("pos", "text")).withColumn("pass_no", F.explode(F.array(F.lit(0), F.lit(1))))
    return words.selectExpr(
        "concat('conv-', conv_id) as document_id", "cast(turn as int) as page", "pass_no", "1 as block_num", "1 as par_num",
        "cast(line as int) as line_num", "cast(pos as int) as word_num", "text",
        "cast((conv_id * 7 + turn * 3 + line * 11 + pos * 37 + pass_no * 53) % 101 as double) as conf")


def page_candidates(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "explode(array(0, 1, 2)) as try_order").selectExpr(
        "concat('conv-', conv_id) as document_id", "cast(turn as int) as page", "try_order", "concat('strategy-', try_order) as strategy",
        "cast((conv_id * 31 + turn * 17 + try_order * 57) % 40 as double) as score")


def fallback_pages(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").where("(conv_id + turn) % 3 = 0").selectExpr(
        "concat('conv-', conv_id) as document_id", "cast(turn as int) as page", "concat('lu par le repli ', turn) as text",
        "((conv_id * 3 + turn) % 10) / 10.0D as confidence")


RECOGNISED = r"""
    WITH raw_ AS (SELECT 'doc-' || doc_id AS document_id, 'plain' AS route, coalesce(text, '') AS text, 1.0::double AS confidence,
        'plain_text' AS method, NULL AS ocr_config, 1 AS page_count, NULL AS preprocessing_strategy FROM documents),
    native AS (SELECT conv_id, CASE WHEN conv_id % 8 = 0 THEN t ELSE substr(t, 1, 40) END AS t FROM (
        SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations WHERE conv_id % 4 = 0 GROUP BY conv_id)),
    usable AS (SELECT * FROM native WHERE length(regexp_replace(t, '[ \t\r\n]+', '', 'g')) >= 50),
    l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
        FROM conversations WHERE conv_id % 11 <> 10),
    w AS (SELECT conv_id, turn, line, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) - 1 AS pos FROM l),
    k AS (SELECT *, (conv_id * 7 + turn * 3 + line * 11 + pos * 37 + p * 53) % 101 AS conf FROM w, range(2) r(p)
        WHERE (conv_id * 7 + turn * 3 + line * 11 + pos * 37 + p * 53) % 101 >= 40 AND trim(word, ' ' || chr(9) || chr(13) || chr(160)) <> ''),
    ln AS (SELECT conv_id, turn, p, line, string_agg(word, ' ' ORDER BY pos) AS t, sum(conf) AS c, count(*) AS n FROM k GROUP BY ALL),
    kept AS (SELECT conv_id, turn, p, string_agg(t, chr(10) ORDER BY line) AS text, sum(c)::double / sum(n) / 100 AS confidence FROM ln GROUP BY ALL),
    passes AS (SELECT t.conv_id, t.turn, p, coalesce(k.text, '') AS text, coalesce(k.confidence, 0.0) AS confidence FROM (
        SELECT conv_id, turn, p FROM conversations, range(2) r(p) WHERE conv_id % 11 <> 10) t LEFT JOIN kept k USING (conv_id, turn, p)),
    scored AS (SELECT *, confidence * least(length(text) / 500.0::double, 1.0::double) AS score FROM passes),
    both_ AS (SELECT a.conv_id, a.turn, a.text AS t0, a.confidence AS c0, a.score AS s0, z.text AS t1, z.confidence AS c1, z.score AS s1
        FROM scored a JOIN scored z USING (conv_id, turn) WHERE a.p = 0 AND z.p = 1),
    best AS (SELECT conv_id, turn, CASE WHEN s0 > 0 AND c0 >= 0.65 THEN 0 WHEN s1 > s0 THEN 1 WHEN s0 > 0 THEN 0 ELSE -1 END AS pick, t0, c0, t1, c1 FROM both_),
    page AS (SELECT b.conv_id, b.turn, CASE pick WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE '' END AS text, CASE pick WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE 0.0 END AS confidence,
        CASE WHEN pick = 1 THEN '--oem 3 --psm 6 -l fra+eng' ELSE '--oem 3 --psm 3 -l fra+eng' END AS ocr_config,
        (SELECT 'strategy-' || arg_max(o, ((conv_id * 31 + turn * 17 + o * 57) % 40) * 10 - o) FROM range(3) r(o)) AS strategy FROM best b),
    swapped AS (SELECT *, confidence < 0.6 AND (conv_id + turn) % 3 = 0 AND ((conv_id * 3 + turn) % 10) / 10.0::double > confidence AS swap FROM page),
    final AS (SELECT conv_id, turn, CASE WHEN swap THEN 'lu par le repli ' || turn ELSE text END AS text,
        CASE WHEN swap THEN ((conv_id * 3 + turn) % 10) / 10.0::double ELSE confidence END AS confidence,
        CASE WHEN NOT swap THEN ocr_config END AS ocr_config, CASE WHEN swap THEN 'trocr' ELSE strategy END AS strategy FROM swapped),
    scanned AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) || '--- PAGE SUIVANTE ---' || chr(10) || chr(10) ORDER BY turn) AS text,
        avg(confidence) AS confidence, last(ocr_config ORDER BY turn) AS ocr_config, last(strategy ORDER BY turn) AS strategy, count(*) AS n
        FROM final GROUP BY conv_id),
    everything AS (SELECT document_id, text, confidence, method, ocr_config, page_count, preprocessing_strategy FROM raw_
      UNION ALL SELECT 'conv-' || c.conv_id, coalesce(u.t, s.text, ''), CASE WHEN u.t IS NOT NULL THEN 0.98 ELSE coalesce(s.confidence, 0.0) END,
        CASE WHEN u.t IS NOT NULL THEN 'native_pdf' WHEN s.conv_id IS NULL THEN 'failed' WHEN s.strategy = 'trocr' THEN 'trocr'
          WHEN s.n > 1 THEN 'tesseract_multi' ELSE 'tesseract' END,
        CASE WHEN u.t IS NULL THEN s.ocr_config END,
        CASE WHEN u.t IS NOT NULL THEN (length(u.t) - length(replace(u.t, chr(10) || chr(10), ''))) // 2 + 1 ELSE coalesce(s.n, 0) END,
        CASE WHEN u.t IS NULL THEN s.strategy END
      FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN usable u USING (conv_id) LEFT JOIN scanned s USING (conv_id)),
    c AS (SELECT * REPLACE (regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '0([A-Z])', 'O\1', 'g'),
        '([A-Z])0', '\1O', 'g'), '\|', 'I', 'g'), '§IRET', 'SIRET'), '§IREN', 'SIREN'), '[ \t]+', ' ', 'g') AS text) FROM everything),
    cl AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c),
    clean AS (SELECT document_id, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM cl
        WHERE regexp_matches(line, '[a-zA-Z0-9€]') GROUP BY document_id)
    SELECT document_id, md5(coalesce(t, '')) AS text_hash, round(confidence, 9) AS confidence, method, ocr_config, cast(page_count AS integer) AS page_count,
      cast(len(regexp_extract_all(coalesce(t, ''), '[^ \t\r\n]+')) AS integer) AS word_count, preprocessing_strategy
    FROM c LEFT JOIN clean USING (document_id)"""


@query("p03_recognise_files", RECOGNISED)
def recognise_files(spark, sf_dir):
    """Every file of the raw zone, whatever its type, to one recognised document."""
    files = text_files(spark, sf_dir).unionByName(scanned_files(spark, sf_dir))
    pages = recognition.recognise_pages(page_words(spark, sf_dir), page_candidates(spark, sf_dir), fallback_pages(spark, sf_dir), THRESHOLD)
    found = recognition.recognise(files, embedded_text(spark, sf_dir), pages)
    return found.select("document_id", F.md5(F.col("text").cast("binary")).alias("text_hash"), F.round("confidence", 9).alias("confidence"),
                        "method", "ocr_config", "page_count", "word_count", "preprocessing_strategy")
