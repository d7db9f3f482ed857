"""Files as sources: scan, completeness, and the text formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of source by extension.
KINDS = {"vtt": "vtt", "txt": "txt", "md": "md", "msg": "msg", "eml": "eml", "xlsx": "xlsx", "docx": "docx", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image"}
TIMING = r"((?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3})\s+-->\s+((?:\d{1,2}:)?\d{2}:\d{2}[.,]\d{3})"


def typed(files: DataFrame) -> DataFrame:
    """Files (path, content, ...) with their kind and content hash."""
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[extension], F.lit("unsupported"))
    return files.withColumn("kind", kind).withColumn("hash", F.sha2("content", 256))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    return typed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def completeness(kind: str, content: str) -> Column:
    """Why a file looks cut off, or null: empty or blank (Spark lists no files of no bytes at all), a zip without its end record, a transcript that ends on a timing line, mail
    without a body."""
    text = F.col(content).cast("string")
    tail = F.element_at(F.split(F.regexp_replace(text, r"\s+$", ""), r"\r?\n"), -1)
    zipped = F.hex(content).contains("504B0506")
    return (
        F.when((F.length(content) == 0) | ~text.rlike(r"\S"), "empty").when(F.col(kind).isin("docx", "xlsx") & ~zipped, "no end record")
        .when((F.col(kind) == "vtt") & tail.rlike(TIMING), "ends on a timing line").when((F.col(kind) == "eml") & ~text.rlike(r"\r?\n\r?\n"), "no body")
    )


def milliseconds(stamp: Column) -> Column:
    parts = F.split(F.regexp_replace(stamp, ",", "."), ":")
    hours = F.when(F.size(parts) == 3, F.get(parts, F.lit(0)).cast("long")).otherwise(F.lit(0))
    minutes = F.element_at(parts, -2).cast("long")
    return ((hours * 60 + minutes) * 60000 + F.round(F.element_at(parts, -1).cast("double") * 1000)).cast("long")


def cues(documents: DataFrame, id_: str = "source_id", text: str = "text") -> DataFrame:
    """(id, cue, start_ms, end_ms, speaker, tagged, open, payload) of transcripts: blocks between blank lines with a timing
    line; the speaker from a voice tag, or from a short "Name: " before the text."""
    blocks = documents.select(id_, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*\n+")).alias("cue", "block")).where(F.col("block").rlike(TIMING))
    body = F.trim(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""))
    b = blocks.select(id_, "cue", milliseconds(F.regexp_extract("block", TIMING, 1)).alias("start_ms"), milliseconds(F.regexp_extract("block", TIMING, 2)).alias("end_ms"), body.alias("body"))
    voice, prefix = F.regexp_extract("body", r"<v(?:\.[^ >]+)?\s+([^>]+)>", 1), F.regexp_extract("body", r"^([^:!?;,\n]{1,60}):\s+\S", 1)
    short = (prefix != "") & (F.size(F.split(F.trim(prefix), r"\s+")) <= 6)
    from regista.functions.texts import strip_markup

    plain = strip_markup("body")
    return b.select(
        id_, "cue", "start_ms", "end_ms", F.when(voice != "", F.trim(voice)).when(short, F.trim(prefix)).alias("speaker"), (voice != "").alias("tagged"),
        ((voice != "") & ~F.col("body").contains("</v>")).alias("open"), F.when((voice == "") & short, F.regexp_replace(plain, r"^[^:]+:\s+", "")).otherwise(plain).alias("payload"),
    )


def vtt_segments(documents: DataFrame, id_: str = "source_id", text: str = "text") -> DataFrame:
    """Segments of transcripts; a cue after an unclosed voice span keeps its speaker."""
    from pyspark.sql import Window

    order = Window.partitionBy(id_).orderBy("cue")
    c = cues(documents, id_, text)
    c = c.withColumn("span", F.sum(F.col("speaker").isNotNull().cast("int")).over(order))
    in_span = Window.partitionBy(id_, "span").orderBy("cue")
    carried = F.when(F.first("open").over(in_span), F.first("speaker").over(in_span))
    return c.select(id_, F.row_number().over(order).alias("seq"), "start_ms", "end_ms", F.coalesce("speaker", carried).alias("speaker"), F.col("payload").alias("text"))


def quoted_printable(body: str) -> Column:
    """Text of a quoted-printable body in UTF-8: escapes rewritten as those of a URL, in which two equal signs stand for one (as
    Python's decoder has it), soft line breaks and an escape cut off at the end go, and whatever is no escape stays."""
    text = F.replace(F.replace(F.col(body), F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    text = F.regexp_replace(F.replace(text, F.lit("=="), F.lit("%3D")), "=([0-9A-Fa-f]{2})", "%$1")
    return F.url_decode(F.regexp_replace(text, r"=(?:\n|\z)", ""))


def mail(documents: DataFrame, id_: str = "source_id", text: str = "text") -> DataFrame:
    """(id, sender, sent, subject, body) of e-mails: headers unfolded, the body decoded by its transfer encoding, markup out."""
    from regista.functions.texts import strip_markup

    d = documents.withColumn("t", F.regexp_replace(text, r"\r\n?", "\n"))
    d = d.withColumn("head", F.regexp_replace(F.regexp_extract("t", r"(?s)^(.*?)\n\n", 1), r"\n[ \t]+", " ")).withColumn("raw", F.regexp_replace("t", r"(?s)^.*?\n\n", ""))
    header = lambda name: F.trim(F.regexp_extract("head", rf"(?im)^{name}:\s*(.*)$", 1))
    code = F.lower(header("Content-Transfer-Encoding"))
    base = F.decode(F.try_to_binary(F.regexp_replace("raw", r"\s", ""), F.lit("base64")), "UTF-8")
    body = F.when(code == "base64", base).when(code == "quoted-printable", quoted_printable("raw")).otherwise(F.col("raw"))
    html = F.lower(header("Content-Type")).contains("html")
    d = d.withColumn("body", body)
    return d.select(id_, header("From").alias("sender"), header("Date").alias("sent"), header("Subject").alias("subject"), F.when(html, strip_markup("body")).otherwise(F.trim("body")).alias("body"))


def mail_segments(documents: DataFrame, id_: str = "source_id", text: str = "text") -> DataFrame:
    """Segments of e-mails: the subject, then the body's paragraphs, spoken by the sender."""
    m = mail(documents, id_, text)
    parts = F.concat(F.array("subject"), F.filter(F.split("body", r"\n\s*\n"), lambda p: F.trim(p) != ""))
    return m.select(id_, "sender", F.posexplode(parts).alias("k", "part")).select(id_, (F.col("k") + 1).alias("seq"), F.col("sender").alias("speaker"), F.trim("part").alias("text"))


def docx_files(documents: DataFrame, id_: str = "source_id", text: str = "text") -> DataFrame:
    """(path, content): texts as Word files, a paragraph for each line, the first one a heading."""

    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'

    def packed(body: str | None) -> bytes:
        lines = [x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for x in (body or "").split("\n")]
        paragraphs = "".join(f"<w:p>{'' if i else style}<w:r><w:t>{x}</w:t></w:r></w:p>" for i, x in enumerate(lines))
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:document>{paragraphs}</w:document>")
        return file.getvalue()

    named = documents.select(F.concat(F.col(id_).cast("string"), F.lit(".docx")).alias("path"), F.col(text).alias("body"))
    return named.mapInArrow(_each(packed, "body", "content", pa.binary()), "path string, content binary")


#: Bytes that a Python worker of file contents gives at a time.
GIVEN = 4 << 20


def _each(function: Callable, source: str, target: str, kind: pa.DataType) -> Callable:
    """For ``mapInArrow``: (path, target) with ``function`` of each value of ``source``. Values are made one at a time and given on
    as soon as they hold ``GIVEN`` bytes, so a worker holds the batch it was sent and little else, however many rows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, out, size, begin = batch.column("path"), [], 0, 0
            for k, value in enumerate(batch.column(source)):
                out.append(function(value.as_py()))
                size += len(out[-1] or "")
                if size >= GIVEN or k + 1 == batch.num_rows:
                    yield pa.record_batch([paths.slice(begin, len(out)), pa.array(out, kind)], ["path", target])
                    out, size, begin = [], 0, k + 1

    return run


def docx_xml(files: DataFrame) -> DataFrame:
    """(path, xml): the main part of Word files. Only the unzipping is Python; a file that is no zip has a null."""

    def unpacked(content: bytes | None) -> str | None:
        try:
            return zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return None

    return files.select("path", "content").mapInArrow(_each(unpacked, "content", "xml", pa.string()), "path string, xml string")


def docx_segments(files: DataFrame) -> DataFrame:
    """(path, seq, style, text) of the paragraphs of Word files."""
    from regista.functions.texts import strip_markup

    p = docx_xml(files).select("path", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?s)<w:p[ >].*?</w:p>"), 0)).alias("k", "p"))
    text = strip_markup(F.regexp_replace(F.regexp_replace("p", r"<w:(?:tab|br)[^>]*/>", " "), r"</w:t>\s*(?:</w:r>\s*<w:r[^>]*>\s*(?:<w:rPr>.*?</w:rPr>)?)?\s*<w:t[^>]*>", ""))
    return p.select("path", "k", F.regexp_extract("p", r'<w:pStyle w:val="([^"]+)"', 1).alias("style"), text.alias("text")).where("text <> ''")
