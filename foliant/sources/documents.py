"""Documents from files, and tables written so that readers never see half of them."""

from __future__ import annotations

import re
import time
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import ship

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SCHEMA = "doc_id string, path string, kind string, file_size long, file_mtime double, file_hash string, text string"


def _runs(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_WORD}t"))


def docx_text(raw: bytes) -> str:
    """Paragraphs by line, table rows as [表格行N] a | b, numbered through the document."""
    with zipfile.ZipFile(BytesIO(raw)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_WORD}body")
    out, row_no = [], 0
    for block in body if body is not None else ():
        if block.tag == f"{_WORD}p":
            out.append(_runs(block))
        elif block.tag == f"{_WORD}tbl":
            for row in block.iter(f"{_WORD}tr"):
                row_no += 1
                out.append(f"[表格行{row_no}] " + " | ".join(_runs(cell) for cell in row.iter(f"{_WORD}tc")))
    return "\n".join(x for x in out if x)


def html_text(raw: bytes) -> str:
    """The title and the text of a page, without scripts, styles and tags."""
    page = raw.decode("utf-8", "replace")
    page = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", page)
    page = re.sub(r"(?i)<(?:br|/p|/div|/tr|/li|/h\d|/title)\s*/?>", "\n", page)
    page = re.sub(r"<[^>]+>", "", page)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        page = page.replace(entity, char)
    return "\n".join(line.strip() for line in page.splitlines() if line.strip())


def _pdf_text(raw: bytes) -> str:
    try:
        from pypdf import PdfReader  # optional
    except ImportError as missing:
        raise ValueError("no reader for PDF here") from missing
    return "\n".join(page.extract_text() for page in PdfReader(BytesIO(raw)).pages)


#: Readers by kind; more may be registered before the first read.
PARSERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "html": html_text, "text": lambda raw: raw.decode("utf-8", "replace"), "pdf": _pdf_text}


def kind_of(path: str, head: bytes) -> str | None:
    """By the name, or else by the first bytes."""
    suffix = path.rsplit(".", 1)[-1].lower()
    known = {"docx": "docx", "html": "html", "htm": "html", "txt": "text", "md": "text", "pdf": "pdf"}.get(suffix)
    return known or ("docx" if head[:2] == b"PK" else "pdf" if head[:4] == b"%PDF" else None)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for frame in batches:
        out = []
        for r in frame.itertuples():
            kind = kind_of(r.path, r.content)
            try:
                text = PARSERS[kind](r.content) if kind else None
            except Exception:  # a broken file is a row without text, not a failed job
                text = None
            name = r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            out.append((name, r.path, kind, r.length, r.modificationTime.timestamp(), hashlib.md5(r.content).hexdigest(), text))
        yield pd.DataFrame(out, columns=["doc_id", "path", "kind", "file_size", "file_mtime", "file_hash", "text"])


def read_documents(spark: SparkSession, folder: str, glob: str = "*", after: str | None = None) -> DataFrame:
    """Files below a folder, parsed where they are read: (doc_id, path, kind, file_size, file_mtime, file_hash, text).

    text is null for files of unknown kinds and for broken ones. ``after``: only documents whose id is greater (a cursor).
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    if after is not None:
        files = files.where(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1) > after)
    return files.mapInPandas(_parse, _SCHEMA)


def pair_by_stem(left: DataFrame, right: DataFrame) -> DataFrame:
    """Documents of two folders with the same name."""
    return left.select("doc_id", F.col("path").alias("left_path"), F.col("text").alias("left_text")).join(right.select("doc_id", F.col("path").alias("right_path"), F.col("text").alias("right_text")), "doc_id")


def sample_pairs(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A sample of n rows that depends on their keys and the seed alone."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its join key, so that later joins on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def replace_table(rows: DataFrame, target: str) -> str:
    """Writes a new version beside the old ones; it counts once it is complete. Returns its path."""
    path = f"{target}/version={time.time_ns():020d}"
    rows.write.parquet(path)
    return path


def current_table(spark: SparkSession, target: str) -> DataFrame:
    """The newest version that was written completely."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(target)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(s.getPath().toString() for s in files.listStatus(base) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1])
