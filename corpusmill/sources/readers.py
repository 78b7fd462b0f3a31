"""Readers for the corpus's file formats, each into an explicit schema; bad lines go to a reject table, never away.

Files are read by Spark's own readers, so any store that Spark reaches will do, and each reader is one lazy plan.
"""

from __future__ import annotations

import html
import io
import re
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.functions import text as tx
from corpusmill.functions.brackets import tier

# The columns and fields of the corpus's own formats.
LABELS = "file_id string, wav string, lang string, start double, end double, text string"
SPEAKER_COLUMNS = (
    "type,creator,version,update,ID,sex,birthYear,birthPlace,birthRegion,language,firstLang,homeLang,workLang,resPlace,resRegion,"
    "eduPlace,eduRegion,eduSize,education,eduLevel,occupation,occLevel,notes"
).split(",")
MANIFEST = "sentence string, audiofilename string, sampling_rate int, start_time double, end_time double"
PREFIX = T.StructType([T.StructField("prefix", T.StringType())])


def scan(spark: SparkSession, path: str, where: Column | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with filter and columns pushed into the scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.filter(where)
    return df.select(*columns) if columns else df


def lines(spark: SparkSession, path: str) -> DataFrame:
    """filename and line of each non-empty line."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("line")).filter("line != ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """filename, line_no (from 1, in the file's order) and line of each non-empty line, of files of any size.

    A file is read block by block, in as many tasks; a line's number is its place in the block and the lines of the
    blocks before.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"), F.monotonically_increasing_id().alias("_place"),
    )
    blocks = rows.groupBy("_file", "_block").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.filter("line != ''").join(blocks, ["_file", "_block"])
    return numbered.select("filename", (F.col("_place") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


def _fields(df: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Tab-separated ``line`` by position: (rows whose typed fields can be read, rejected rows)."""
    parts = F.split("line", "\t")
    kept = [c for c in df.columns if c != "line"]
    typed, ok = [], F.lit(True)
    for i, field in enumerate(T._parse_datatype_string(schema).fields):
        value = F.try_element_at(parts, F.lit(i + 1))
        value = value if isinstance(field.dataType, T.StringType) else F.btrim(value).try_cast(field.dataType)
        typed.append(value.alias(field.name))
        ok &= value.isNotNull()
    return df.filter(ok).select(*kept, *typed), df.filter(~ok)


def council_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """file_id, wav, lang, start, end, text, with duration; and rejected lines."""
    good, bad = _fields(lines(spark, path).drop("filename"), LABELS)
    return good.withColumn("duration", F.col("end") - F.col("start")), bad


def annotation_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables with a header row: (segments, background rows, rejected rows); the last column is tmax."""
    rows = lines(spark, path).withColumn("parts", F.split("line", "\t")).filter(F.element_at("parts", 1) != "tmin")
    number = lambda i: F.btrim(F.try_element_at("parts", F.lit(i))).try_cast("double")
    rows = rows.withColumn("tmin", number(1)).withColumn("tmax", number(-1)).withColumn("label", F.try_element_at("parts", F.lit(3)))
    rows = rows.withColumn("tier", tier(F.coalesce(F.try_element_at("parts", F.lit(2)), F.lit(""))))
    read = F.col("tmin").isNotNull() & F.col("tmax").isNotNull() & (F.size("parts") >= 4)
    out = ["filename", "tmin", "tmax", "label"]
    return (
        rows.filter(read & (F.col("tier.kind") == "ok")).select(*out, "tier.speaker", "tier.gender", "tier.language"),
        rows.filter(read & (F.col("tier.kind") == "background")).select(*out),
        rows.filter(~read | (F.col("tier.kind") == "rejected")).select("filename", "line"),
    )


def spoken_tables(spark: SparkSession, path: str, sample: int | None = None, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """start, speaker_id, text, end of each line, with duration; and rejected lines. ``sample`` files by hash of name and seed."""
    rows = lines(spark, path)
    if sample is not None:
        chosen = rows.select("filename").distinct().orderBy(F.md5(F.concat("filename", F.lit(seed)).cast("binary"))).limit(sample)
        rows = rows.join(chosen, "filename", "left_semi")
    good, bad = _fields(rows, "start double, speaker_id string, text string, end double")
    return good.withColumn("duration", F.col("end") - F.col("start")), bad


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """Speaker table with its 23 columns; age in 2000 and sex besides."""
    df = spark.read.csv(path, sep="\t", header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in SPEAKER_COLUMNS]))
    return df.withColumn("age", tx.age(F.col("birthYear"))).withColumn("gender", tx.sex_name(F.col("sex")))


def audio_info(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``id <tab> path,channels,rate,...,seconds=samples,...``: one row a file; and lines whose numbers can't be read."""
    parts, own = F.split("line", "\t"), F.split(F.col("body"), ",")
    rows = lines(spark, path).select("line", F.element_at(parts, 1).alias("file_id"), F.try_element_at(parts, F.lit(2)).alias("body"))
    item = lambda i: F.try_element_at(own, F.lit(i))
    samples = F.regexp_extract(F.coalesce(item(5), F.lit("")), r"(\d+)\s*samples", 1).try_cast("long")
    samples = F.coalesce(samples, F.element_at(F.split(F.coalesce(item(5), F.lit("")), "="), -1).try_cast("long"))
    found = rows.select(
        "line", "file_id", item(1).alias("path"), item(2).try_cast("int").alias("channels"), item(3).try_cast("int").alias("sample_rate"), item(4).alias("precision"),
        samples.alias("samples"), item(6).alias("file_size"), item(7).alias("bit_rate"), item(8).alias("encoding"),
    ).withColumn("seconds", F.col("samples") / F.col("sample_rate"))
    read = F.col("channels").isNotNull() & F.col("sample_rate").isNotNull() & F.col("samples").isNotNull()
    return found.filter(read).drop("line"), found.filter(~read).select("line")


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, id and text of each page of an XML dump."""
    schema = "title string, id string, revision struct<text:string>"
    df = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return df.select("title", "id", F.coalesce("revision.text", F.lit("")).alias("text"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder: path, name, folder, kind and size; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return df.select("path", name.alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("kind"), F.col("length").alias("size"), "modificationTime")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """All folders below a folder that have files in them or further below."""
    root = F.regexp_replace(F.lit(path.rstrip("/")), "^file:/*", "/")
    below = listed(spark, path).select(F.regexp_replace("folder", "^file:/*", "/").alias("folder")).distinct()
    parts = F.split(F.substr("folder", F.length(root) + 2), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(root, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return below.filter(F.col("folder") != root).select(F.explode(every).alias("folder")).distinct()


def _paragraphs(contents: pd.Series) -> pd.Series:
    """Text of word-processor documents: paragraphs of the main part; None where that can't be read."""

    def one(content):
        try:
            body = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()
        except (zipfile.BadZipFile, KeyError, UnicodeDecodeError, TypeError):
            return None
        paragraphs = re.findall(r"<w:p[ >].*?</w:p>", body, re.DOTALL)
        return "\n".join(html.unescape("".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", p, re.DOTALL))) for p in paragraphs)

    return pd.Series([one(c) for c in contents], dtype=object)


def _recording(contents: pd.Series) -> pd.DataFrame:
    """Rate and samples, in [-1, 1) and as the mean of the channels, of WAV files; None where one can't be read."""
    rows = []
    for content in contents:
        try:
            with wave.open(io.BytesIO(content)) as w:
                rate, width, channels, raw = w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
        except (wave.Error, EOFError, TypeError):
            rows.append((None, None))
            continue
        kind = {1: "u1", 2: "<i2", 4: "<i4"}.get(width)
        if kind is None:
            rows.append((None, None))
            continue
        x = np.frombuffer(raw, kind).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
        rows.append((rate, x.reshape(-1, channels).mean(axis=1).tolist()))
    return pd.DataFrame(rows, columns=["rate", "samples"])


def recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """path, rate and mono samples of the WAV files below a folder; and the paths of those that can't be read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    df = df.select("path", F.pandas_udf(_recording, "rate int, samples array<double>")("content").alias("r"))
    return df.filter("r.rate is not null").select("path", "r.rate", "r.samples"), df.filter("r.rate is null").select("path")


def _resampled(waves: pd.Series, rates: pd.Series, wanted: pd.Series) -> pd.Series:
    """By a windowed sinc: a low pass under the lower of both rates, six zero crossings to each side."""

    def one(x, rate, to):
        x = np.asarray(x, np.float64)
        if rate == to or not len(x):
            return x.tolist()
        n, cut = int(np.ceil(len(x) * to / rate)), min(1.0, to / rate) * 0.99
        reach = int(np.ceil(6 / cut))
        centre = np.arange(n) * rate / to
        near = np.floor(centre).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        t = (near - centre[:, None]) * cut
        weight = np.where(np.abs(t) < 6, cut * np.sinc(t) * np.cos(np.clip(t / 6, -1, 1) * np.pi / 2) ** 2, 0.0)
        inside = (near >= 0) & (near < len(x))
        return (np.where(inside, x[np.clip(near, 0, len(x) - 1)], 0.0) * weight).sum(axis=1).tolist()

    return pd.Series([None if w is None else one(w, r, t) for w, r, t in zip(waves, rates, wanted, strict=True)])


def resampled(wave_: Column, rate: Column, wanted: int) -> Column:
    """Samples at another rate."""
    return F.pandas_udf(_resampled, "array<double>")(wave_, rate, F.lit(wanted))


def documents(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("txt", "rtf", "docx")) -> DataFrame:
    """Files below a folder: path, kind, text, and an error where the kind can't be read here (the row stays)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    df = df.select("path", kind.alias("kind"), "content")
    raw = F.try_to_binary(F.lit(None).cast("string"))
    plain = F.col("kind").isin(*[k for k in kinds if k != "docx"])
    decoded = F.decode(F.when(plain, F.col("content")).otherwise(raw), "UTF-8")
    packed = F.pandas_udf(_paragraphs, "string")(F.when(F.col("kind") == "docx", F.col("content"))) if "docx" in kinds else F.lit(None).cast("string")
    bare = F.regexp_replace(F.regexp_replace(decoded, r"\\par\b ?", "\n"), r"\\[a-z]+-?\d* ?|[{}]", "")
    found = df.select("path", "kind", F.when(F.col("kind") == "rtf", F.btrim(bare)).when(F.col("kind") == "docx", packed).otherwise(decoded).alias("text"))
    return found.withColumn("error", F.col("text").isNull())


def path_language(path: Column) -> Column:
    """Language of the first folder that names one."""
    parts = F.split(F.lower(path), "/")
    name = lambda p: F.when(p.contains("fries") | p.contains("frl"), "Frisian").when(p.contains("nederlands") | (p == "nl"), "Dutch")
    return F.try_element_at(F.filter(F.transform(parts, name), lambda x: x.isNotNull()), F.lit(1))


def pronunciations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """word and pron by tabs, and lines without both."""
    rows = lines(spark, path).select("line", F.split("line", "\t").alias("parts"))
    return rows.filter(F.size("parts") >= 2).select(F.element_at("parts", 1).alias("word"), F.element_at("parts", 2).alias("pron")), rows.filter(F.size("parts") < 2).select("line")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word is the first run of non-blanks, pron the rest."""
    return lines(spark, path).select(F.regexp_extract("line", r"^(\S*)", 1).alias("word"), F.btrim(F.regexp_replace("line", r"^\S*", "")).alias("pron"))


#: Lexicons by name: the file in a folder of lexicons, and the language of its words (None: labelled word by word).
LEXICONS = {"council": ("council", None), "council_old": ("council_old", None), "fame": ("fame", None), "twente": ("twente", "Dutch"), "frysk": ("frysk", "Frisian")}


def named_lexicon(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """word, pron and language of a known lexicon; labels on words and phonemes are taken off, and words without one have none."""
    if name not in LEXICONS:
        raise ValueError(f"no lexicon {name!r}: {', '.join(LEXICONS)}")
    file, language = LEXICONS[name]
    rows = lexicon(spark, f"{folder}/{file}").filter("word != ''")
    if language:
        return rows.withColumn("language", F.lit(language))
    own = F.when(F.col("word").endswith("-nl"), "Dutch").when(F.col("word").endswith("-fr"), "Frisian")
    return rows.select(F.regexp_replace("word", "-(nl|fr)$", "").alias("word"), F.regexp_replace("pron", "-(nl|fr)", "").alias("pron"), own.alias("language"))


def overlap_words(spark: SparkSession, folder: str) -> DataFrame:
    """The words that both languages have, from the list ``overlap_wordlist``."""
    return lines(spark, f"{folder}/overlap_wordlist").select(F.col("line").alias("word")).distinct()


def bilingual_words(spark: SparkSession, path: str) -> DataFrame:
    """word and language; only a -nl or -fr at the end is taken off."""
    w = F.regexp_extract("line", r"^(\S*)", 1)
    found = F.when(w.endswith("-nl"), "Dutch").when(w.endswith("-fr"), "Frisian")
    return lines(spark, path).select(F.when(found.isNotNull(), F.regexp_replace(w, "-(nl|fr)$", "")).otherwise(w).alias("word"), found.alias("language"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """First token of each line; the first occurrence gives its number, from 0."""
    rows = numbered_lines(spark, path).select("filename", "line_no", F.regexp_extract("line", r"^(\S+)", 1).alias("word")).filter("word != ''")
    first = rows.groupBy("word").agg(F.min(F.struct("filename", "line_no")).alias("at"))
    from corpusmill.operators.windows import global_rank

    return global_rank(first, ["at"], "idx").select("word", "idx")


def integer_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="word string, idx int")


def number_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``int word`` lines as number and word, and the lines that don't start with a number or have no word."""
    parts = F.split("line", " +", 2)
    rows = lines(spark, path).select("line", F.element_at(parts, 1).try_cast("long").alias("number"), F.try_element_at(parts, F.lit(2)).alias("word"))
    good = F.col("number").isNotNull() & F.col("word").isNotNull()
    return rows.filter(good).select("number", "word"), rows.filter(~good).select("line")


def written_numbers(df: DataFrame, number: str, table: DataFrame, name: str = "word") -> DataFrame:
    """Each row with the word that a number table has for its number; null if none."""
    return df.join(table.select(F.col("number").alias("_n"), F.col("word").alias(name)), F.col(number).cast("long") == F.col("_n"), "left").drop("_n")


def scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Four lines an utterance (ref, hyp, eval, counts) as one row: id, ref, hyp, codes, counts; and lines without id or kind."""
    rows = lines(spark, path).select("line", F.regexp_extract("line", r"pk-(\d+)", 1).try_cast("long").alias("pk"), F.regexp_extract("line", r"^\S+\s+(ref|hyp|op|#csid)\b", 1).alias("kind"), F.regexp_replace("line", r"^\S+\s+\S+\s*", "").alias("body"))
    read = F.col("pk").isNotNull() & (F.col("kind") != "")
    wide = rows.filter(read).groupBy("pk").pivot("kind", ["ref", "hyp", "op", "#csid"]).agg(F.first("body", ignorenulls=True))
    return wide.select("pk", "ref", "hyp", F.col("op").alias("codes"), F.col("`#csid`").alias("counts")), rows.filter(~read).select("line")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Records under the key ``data``."""
    return spark.read.schema(f"data array<struct<{', '.join(p.replace(' ', ':', 1) for p in MANIFEST.split(', '))}>>").json(path, multiLine=True).select(F.inline("data"))


def dataset(spark: SparkSession, folder: str, split: str = "train+validation", drop: tuple[str, ...] = ()) -> DataFrame:
    """Splits of a dataset, ``a+b`` as their union, without the columns in ``drop``."""
    names = split.split("+")
    out = spark.read.parquet(f"{folder}/{names[0]}")
    for name in names[1:]:
        out = out.unionByName(spark.read.parquet(f"{folder}/{name}"), allowMissingColumns=True)
    return out.drop(*drop)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as lines with their place."""
    return numbered_lines(spark, path)


def wave_section(wave: Column, start: Column, end: Column, rate: int) -> Column:
    """Samples of a section given in seconds."""
    begin = tx.samples(start, rate)
    return F.slice(wave, begin.cast("int") + 1, (tx.samples(end, rate) - begin).cast("int"))


def mono(channels: Column) -> Column:
    """Mean over channels (an array of equally long arrays)."""
    n = F.size(channels)
    return F.transform(F.element_at(channels, 1), lambda _, i: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.element_at(c, i + 1)) / n)


def ground_truth(spark: SparkSession, truth: str, predicted: str) -> DataFrame:
    """Lines of two files, or of the files of equal name in two folders, paired by number: filename, line_no, ref, hyp.

    ``filename`` is that of the truth; two single files are a pair whatever their names.
    """
    a = numbered_lines(spark, truth).withColumnRenamed("line", "ref")
    b = numbered_lines(spark, predicted).withColumnRenamed("line", "hyp")
    single = all(len(spark.read.format("binaryFile").load(p).select("path").take(2)) == 1 for p in (truth, predicted))
    paired = a.join(b.drop("filename"), "line_no") if single else a.join(b, ["filename", "line_no"])
    return paired.select("filename", "line_no", "ref", "hyp")


def prefixes(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], PREFIX)
