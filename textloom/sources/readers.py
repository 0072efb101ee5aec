"""Scans: Parquet of any of the known layouts, row and file identity, mails, documents, pages, tab-separated indexes."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import read_blocks
from ..functions.vectorised import vectorised

# The names under which each logical column may come, and the names of French.
ALIASES = {
    "row_id": "row_id id doc_id",
    "text_en": "unofficial_text_en text_en",
    "text_fr": "unofficial_text_fr text_fr",
    "title": "name_en name_fr SubjectofBusiness title name",
    "citation": "citation_en citation_fr ID citation",
    "date": "document_date_en document_date_fr Date",
    "dataset": "dataset jurisdiction source",
    "url": "url_en source_url url_fr url",
    "license": "upstream_license license",
    "speaker": "PersonSpeaking speaker",
    "title_fr": "name_fr name_en SubjectofBusiness title name",
    "citation_fr": "citation_fr citation_en ID citation",
    "url_fr": "url_fr url_en source_url url",
    "date_fr": "document_date_fr document_date_en Date",
}
ANY_TEXT = "Intervention speech_text text content"
FRENCH = ("fr", "fra", "french", "français", "francais")
DEPTH = 12  # of messages inside messages


class NoText(ValueError):
    """A table without any text column."""


def projected(df: DataFrame) -> DataFrame:
    """The logical columns of a table, by alias whatever the case of names: the first that is set, as text, else ''.

    Without a text column of a language, a text column of any language goes to French where `language` says so, else to
    English. A table without either has no text.
    """
    there = {c.lower() for c in df.columns}
    known = lambda names: any(a.lower() in there for a in names.split())
    if any(known(ALIASES[k]) for k in ("text_en", "text_fr")):
        return df.select(*[_logical(df, c) for c in ALIASES])
    if not known(ANY_TEXT):
        raise NoText(f"no text among {df.columns}")
    french = F.lower(_first(df, "language")).isin(*FRENCH)
    text = _first(df, ANY_TEXT)
    own = {"text_en": F.when(french, "").otherwise(text), "text_fr": F.when(french, text).otherwise("")}
    return df.select(*[own[c].alias(c) if c in own else _logical(df, c) for c in ALIASES])


def in_language(language: str) -> list[Column]:
    """Text, title, citation, url and date in a language, else in the other."""
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    if language == "fr":
        return [F.col("text_fr").alias("text"), *[pick(f"{c}_fr", c).alias(c) for c in ("title", "citation", "url", "date")]]
    return [F.col("text_en").alias("text"), *[pick(c, f"{c}_fr").alias(c) for c in ("title", "citation", "url", "date")]]


def accepted(dataset: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """The row filter: part of the dataset's name, and days."""
    out = F.lit(True)
    if dataset:
        out = out & F.contains(F.lower("dataset"), F.lit(dataset.lower()))
    if since:
        out = out & (F.col("date") >= since)
    if until:
        out = out & (F.substring("date", 1, 10) <= until)
    return out


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files under a folder, in the logical columns, with the identity of file and row and a type."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    spoken = any(c.lower() in ("intervention", "personspeaking") for c in raw.columns)
    kept = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"), *[F.col(f"_metadata.{c}").alias(f"__{c}") for c in ("file_size", "file_modification_time")])
    projected(raw)  # raises where there is no text
    kind = F.lit("secondary") if spoken else F.when(F.col("__file").rlike("(?i)laws|legislat"), "legislation").otherwise("case")
    identity = F.sha2(F.concat_ws("|", "__file", F.col("__file_size").cast("string"), F.col("__file_modification_time").cast("string")), 256)
    return kept.select(*[_logical(kept, c) for c in ALIASES], F.col("__row").alias("row_index"), identity.alias("file_id"), kind.alias("doc_type"))


def _first(df: DataFrame, names: str) -> Column:
    """The first of the named columns that is set, whatever the case of names, as text; else ''."""
    there = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.col(f"`{there[a.lower()]}`").cast("string"), F.lit("")) for a in names.split() if a.lower() in there]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def _logical(df: DataFrame, name: str) -> Column:
    return _first(df, ALIASES[name]).alias(name)


def snapshot(spark: SparkSession, base: str, files: list[dict]) -> DataFrame:
    """(path, size, sha256, intact) of the files of a pinned snapshot, from any store that Spark reads: files names each
    path below base with the size and SHA-256 that it must have. A missing file is not intact."""
    wanted = spark.createDataFrame([(f["path"], int(f["size"]), f["sha256"].lower()) for f in files], "path string, size long, sha256 string")
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    # The names of the list are matched at the end of the full paths, whatever scheme the store has.
    got = got.select(F.col("path").alias("full"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))
    met = wanted.join(got, F.col("full").endswith(F.concat(F.lit("/"), F.col("path"))), "left")
    good = (F.col("bytes") == F.col("size")) & (F.col("digest") == F.col("sha256"))
    return met.groupBy("path", "size", "sha256").agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("intact"))


def register(spark: SparkSession, paths: list[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each readable file's logical table, and what was wrong with the others."""
    good, bad = {}, {}
    for p in paths:
        try:
            good[p] = corpus(spark, p)
        except Exception as e:  # one bad file must not stop the rest; its error is returned
            bad[p] = str(e).splitlines()[0]
    return good, bad


def row_count(spark: SparkSession, path: str) -> int:
    """From the files' footers."""
    return spark.read.parquet(path).count()


def resumed(df: DataFrame, processed: int) -> DataFrame:
    return df.where(F.col("row_index") >= processed)


def tsv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A tab-separated index, plain or gzip; lines that start with # and lines with fewer cells are left out."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(cells) >= len(names)))
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def prefixed_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(key, item) of a file whose `#pN` lines hold prefixes and whose other lines are key, then N:rest."""
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").rlike("^#p[0-9]+\t")).select(F.regexp_extract("value", "^#p([0-9]+)\t", 1).alias("n"), F.regexp_replace("value", "^#p[0-9]+\t", "").alias("prefix"))
    body = lines.where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 2)
    body = body.select(F.col("c")[0].alias("key"), F.split(F.col("c")[1], ":", 2).alias("i")).select("key", F.get("i", F.lit(0)).alias("n"), F.get("i", F.lit(1)).alias("rest"))
    return body.join(heads, "n").select("key", F.concat("prefix", "rest").alias("item"))


def configured(df: DataFrame, include: list[str], dataset: str = "dataset", exclude: list[tuple[list[str], str]] = (), text: str = "text", head: int = 5000) -> DataFrame:
    """Rows of the included datasets (a trailing * is a prefix) without those whose head matches an exclusion."""
    keep = F.lit(False)
    for i in include:
        keep = keep | (F.startswith(dataset, F.lit(i[:-1])) if i.endswith("*") else F.col(dataset) == i)
    for datasets, pattern in exclude:
        keep = keep & ~(F.col(dataset).isin(datasets) & F.substring(text, 1, head).rlike("(?i)" + pattern))
    return df.where(keep)


def jdbc(spark: SparkSession, url: str, table: str, kind: str | None = None, **options) -> DataFrame:
    """A database's documents, filtered there by type."""
    out = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return out.where(F.col("doc_type") == kind) if kind else out


BLOCKS = "array<struct<part: string, locator: string, text: string>>"


def read_mail(data: bytes, depth: int = 0) -> list[dict]:
    """Header lines, paragraphs and attachments of a message; messages inside it in turn."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    if "encrypted" in (message.get_content_type() or ""):
        raise ValueError("the message is encrypted")
    out = [{"part": "header", "locator": k, "text": str(message[k])} for k in ("From", "To", "Date", "Subject") if message[k]]
    body = message.get_body(preferencelist=("plain", "html"))
    if body is not None:
        text = body.get_content()
        if body.get_content_type() == "text/html":
            text = "\n\n".join(x for _, x in read_blocks(text)[0])
        out += [{"part": "body", "locator": str(i), "text": p.strip()} for i, p in enumerate(re.split(r"\n\s*\n", text)) if p.strip()]
    for part in message.iter_attachments():
        name = part.get_filename() or ""
        if part.get_content_type() == "message/rfc822" and depth < DEPTH:
            out += [x | {"part": f"message/{x['part']}"} for x in read_mail(part.get_content().as_bytes(), depth + 1)]
        elif name.lower().endswith(".docx"):
            out += [x | {"part": f"{name}/{x['part']}"} for x in read_word(part.get_content())]
        else:
            out.append({"part": "attachment", "locator": name, "text": part.get_content() if part.get_content_maintype() == "text" else ""})
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_word(data: bytes, revision: str = "current") -> list[dict]:
    """Paragraphs of a document and its notes and comments, with tracked changes accepted or (original) undone."""
    skip = _W + ("del" if revision == "current" else "ins")
    out = []

    def text(node) -> str:
        if node.tag == skip:
            return ""
        if node.tag in (_W + "t", _W + "delText"):
            return node.text or ""
        if node.tag in (_W + "tab", _W + "br"):
            return "\t" if node.tag == _W + "tab" else "\n"
        return "".join(map(text, node))

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in ("document", "footnotes", "endnotes", "comments"):
            if f"word/{part}.xml" in z.namelist():
                root = ElementTree.fromstring(z.read(f"word/{part}.xml"))
                out += [{"part": part, "locator": str(i), "text": t} for i, t in enumerate(text(p).strip() for p in root.iter(_W + "p")) if t]
    return out


def read_any(name: str, data: bytes) -> list[dict]:
    kind = name.lower().rsplit(".", 1)[-1]
    if kind == "eml":
        return read_mail(data)
    if kind == "docx":
        return read_word(data)
    if kind == "pdf":
        return read_pdf(data)
    text = data.decode("utf-8-sig", errors="replace")
    if kind in ("html", "htm"):
        return [{"part": t, "locator": str(i), "text": x} for i, (t, x) in enumerate(read_blocks(text)[0])]
    return [{"part": "body", "locator": str(i), "text": p.strip()} for i, p in enumerate(re.split(r"\n\s*\n", text)) if p.strip()]


@vectorised(BLOCKS)
def document_blocks(name: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([read_any(n, bytes(d)) for n, d in zip(name, data, strict=True)])


def files(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, blocks) of every file under a folder; equal contents are read once."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    once = raw.withColumn("id", F.sha2("content", 256)).dropDuplicates(["id"])
    return once.select("id", F.element_at(F.split("path", "/"), -1).alias("name"), "content").select("id", "name", document_blocks("name", "content").alias("blocks"))


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, set, type, query, docs, passage) of a JSON list of test queries."""
    schema = "id string, `set` string, type string, query string, docs array<string>, passage struct<doc: string, start: int, len: int>"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def keyed(df: DataFrame, keys: list[str] | None = None, prefix: str | None = None, key: str = "key") -> DataFrame:
    """Stored records by key list or by prefix."""
    out = df.where(F.col(key).isin(keys)) if keys is not None else df
    return out.where(F.col(key).startswith(prefix)) if prefix else out


def scoped(df: DataFrame, scope: str, current: str | None = None, group: list[str] | None = None, window: str | None = None) -> DataFrame:
    """Rows of the current document, of a group of them, of a window, or all."""
    if scope == "current":
        return df.where(F.col("doc_id") == current)
    if scope == "group":
        return df.where(F.col("doc_id").isin(group or []))
    return df.where(F.col("window_id") == window) if scope == "window" else df


def read_pdf(data: bytes) -> list[dict]:
    """Lines of a PDF's text layer; needs the optional library pypdf. Pages without text would need OCR, which is outside."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    out = []
    for n, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages):
        out += [{"part": f"page {n + 1}", "locator": str(i), "text": t.strip()} for i, t in enumerate(page.extract_text().split("\n")) if t.strip()]
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by key where its scan has fewer partitions than the cluster has cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
