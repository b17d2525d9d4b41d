"""Readers of transcripts, labels, timelines and manifests. All read through Spark, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import schemas
from voxloom.functions import text
from voxloom.operators import ranks
from voxloom.sources import wav
from voxloom.sources.shared import bounded_batches


def _lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(record_id, line, value): lines of text files, or of packed documents, with their number in the file."""
    files = read_packed(spark, path) if packed else spark.read.text(path, wholetext=True).select(_record(F.col("_metadata.file_path")).alias("record_id"), "value")
    return files.select("record_id", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, value) of documents that ``writers.write_packed`` has written."""
    return spark.read.schema("record_id string, value string").json(path, mode="FAILFAST")


def _record(path: Column) -> Column:
    """A record's id: of the folder that the writers made for it, else the file's name up to ``__``."""
    folder = F.regexp_extract(F.url_decode(path), r"/record_id=([^/]+)/", 1)
    return F.when(folder != "", folder).otherwise(text.stem_prefix(F.url_decode(path)))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """Segments of RTTM files: comments, short lines and other kinds than SPEAKER are skipped."""
    field = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(~F.trim("value").startswith(";;")).select(field.alias("f")).filter((F.size("f") >= 9) & (F.get("f", 0) == "SPEAKER"))
    start, size = F.get("f", 3).cast("double"), F.get("f", 4).cast("double")
    return rows.select(F.get("f", 1).alias("record_id"), start.alias("start_s"), (start + size).alias("end_s"), F.get("f", 7).alias("speaker"))


def read_soft_labels(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Turns of ``START END SPEAKER: text`` files; lines of another form are skipped. ``also``: speakers embedded as [HS:id.

    packed: files as write_packed has put them together; a file a record is much work for the driver beyond some thousands.
    """
    # two numbers, then a speaker up to the first colon, then what was said
    head, said = F.split_part("value", F.lit(":"), F.lit(1)), F.regexp_replace("value", "^[^:]*:\\s*", "")
    field = F.split(F.trim(head), r"\s+", 3)
    number = lambda k: F.get(field, k).try_cast("double")
    rows = _lines(spark, path, packed).filter(F.col("value").contains(":") & (F.size(field) == 3) & F.get(field, 0).rlike(r"^[\d.]+$") & F.get(field, 1).rlike(r"^[\d.]+$"))
    also = F.regexp_extract_all(said, F.lit(r"\[HS:([^\s\]]+)"), F.lit(1))
    return rows.select(
        "record_id", F.col("line").cast("long").alias("line"), number(0).alias("start_s"), number(1).alias("end_s"), F.trim(F.get(field, 2)).alias("speaker"), said.alias("text"), also.alias("also")
    )


def soft_label_references(turns: DataFrame) -> DataFrame:
    """(record_id, raw, normalized): texts of a record's turns in file order, prepared turn by turn, empty ones left out."""
    clean = text.clean_markup(F.col("text"))
    rows = turns.select("record_id", "line", text.post_edit_raw(clean).alias("raw"), text.normalize_for_eval(text.post_edit_raw(clean)).alias("norm"))
    ordered = lambda c: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", c))), lambda x: x[c]), lambda t: t != ""), " ")
    return rows.groupBy("record_id").agg(ordered("raw").alias("raw"), ordered("norm").alias("normalized"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, province, region, date, duration_s) of a table whose columns stand two blanks or more apart; # starts a comment."""
    # from the left the id, from the right duration and date; province and region are what stands between
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.trim(F.regexp_replace("value", r"\s+$", "")).alias("value"))
    words = F.split("value", r"\s+")
    n = F.size(words)
    rows = rows.filter((n >= 9) & F.element_at(words, -1).rlike(r"^\d+:\d+:\d+$") & F.array_join(F.slice(words, -6, 5), " ").rlike(r"^\d{1,2} de \S+ de \d{4}$"))
    date, length = F.array_join(F.slice(words, -6, 5), " "), F.element_at(words, -1)
    places = F.split(F.trim(F.regexp_replace(F.regexp_replace("value", r"(\s+\S+){6}$", ""), r"^\S+\s+", "")), r"\s{2,}", 2)
    return rows.filter(F.size(places) == 2).select(
        F.get(words, 0).alias("file_id"), F.get(places, 0).alias("province"), F.get(places, 1).alias("region"), date.alias("date"), text.hms_seconds(length).alias("duration_s")
    )


def read_segment_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of audio, path and text; a bad line fails."""
    return spark.read.schema(schemas.SEGMENT_LABELS).json(path, mode="FAILFAST")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of submissions; bad lines are skipped."""
    return spark.read.schema(schemas.SUBMISSIONS).json(path, mode="DROPMALFORMED")


def read_rules(spark: SparkSession, path: str) -> list[text.DialectRule]:
    """Dialect rules of one JSON document; a small table by nature, as it becomes an expression."""
    schema = "rules array<struct<id:string,canonical:string,variants:array<string>,context:string,applies_to:array<string>>>"
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    return [
        text.DialectRule(r["canonical"], tuple(r["variants"] or ()), r["context"] or "word_whole", tuple(r["applies_to"] or ()))
        for r in (row["rules"] if row and row["rules"] else [])
    ]


def read_tsv(spark: SparkSession, path: str, limit: int = 0, order: Column | None = None) -> DataFrame:
    """A table with a header, tabs between columns; limit keeps the first rows by the order, which it needs (0: all)."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    if limit and order is None:
        raise ValueError("a limit needs an order: rows of a distributed table have none")
    return rows.orderBy(order).limit(limit) if limit else rows


def read_clips(spark: SparkSession, path: str, clips: DataFrame, order: Column, limit: int = 0, name: str = "path") -> DataFrame:
    """Rows of a table of clips whose audio is there (clips: the names); the limit cuts first, so fewer rows may be left."""
    return read_tsv(spark, path, limit, order).join(clips.select(F.col(clips.columns[0]).alias(name)).distinct(), name, "left_semi")


def read_meta_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METADATA).csv(path, header=True)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_id, rate, channels, bits, duration_s) from the headers of WAV files."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", _record(F.col("path")).alias("record_id"), wav.probe(F.col("content")).alias("p")).select("path", "record_id", "p.*")


def build_manifest(spark: SparkSession, segments: str, longform: str, meta: DataFrame) -> DataFrame:
    """Segments and long recordings with their transcripts and metadata.

    A segment without a transcript goes; a long recording stays without one, in a split of its own. No rows: ValueError.
    """

    def side(folder: str, kind: str) -> DataFrame:
        audio = read_wav(spark, folder).withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.wav$", ""))
        words = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(
            F.col("_metadata.file_path").alias("transcript_path"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("transcript"),
            F.regexp_replace(F.element_at(F.split(F.url_decode(F.col("_metadata.file_path")), "/"), -1), r"\.txt$", "").alias("stem"),
        )
        rows = audio.join(words, "stem", "inner" if kind == "segment" else "left").join(meta, "record_id", "left")
        return rows.select(
            F.col("stem").alias("segment_id"), "record_id", F.col("path").alias("audio_path"), "transcript_path", "transcript", "duration_s", F.lit(kind).alias("kind"),
            "province", F.col("age").alias("speaker_age"), "speaker_id", "topic", "year", "channel", F.lit("longform" if kind == "longform" else None).cast("string").alias("split"),
        )

    rows = side(segments, "segment").unionByName(side(longform, "longform"))
    if rows.isEmpty():
        raise ValueError("no audio found")
    return rows


def vox_manifest(segments: DataFrame, audio: DataFrame, n: int = 0) -> DataFrame:
    """(record_id, path, duration_s, n_speakers) of the first n records by name that have audio (0: all)."""
    speakers = segments.groupBy("record_id").agg(F.countDistinct("speaker").alias("n_speakers"))
    if n:
        speakers = speakers.orderBy("record_id").limit(n)
    return speakers.join(audio.select("record_id", "path", "duration_s"), "record_id").select("record_id", "path", "duration_s", "n_speakers")


def numbered(rows: DataFrame, order: Column, out: str = "ordinal") -> DataFrame:
    """rows with a running number by the order, from 0."""
    return ranks.numbered(rows, [order], out=out).withColumn(out, F.col(out) - 1)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(province, topic, rank, word) of what writers.write_lexicon has written; universal words have neither province nor topic."""
    return spark.read.schema("province string, topic string, rank int, word string").json(path)


def read_word_edges(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, time_s) of JSON arrays of times, one document a record."""
    rows = spark.read.text(path, wholetext=True).select(_record(F.col("_metadata.file_path")).alias("record_id"), F.from_json("value", "array<double>").alias("t"))
    return rows.select("record_id", F.explode("t").alias("time_s"))
