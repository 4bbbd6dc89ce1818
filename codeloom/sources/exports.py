"""Exports of a run on the driver's file system: archives, word-processor documents, job records."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import markdown_class, strip_inline

META = "job_id string, status string, url string, outputs array<struct<name:string,label:string>>, error string, created_at string"
_STYLE = {"h1": "Heading1", "h2": "Heading2", "h3": "Heading3", "bullet": "ListBullet", "numbered": "ListNumber"}


def write_zip(folder: str, to: str, hidden: Iterable[str] = ("meta.json",)) -> list[str]:
    """Pack every file below a folder but the hidden ones; the names in the archive, sorted."""
    root, names = Path(folder), []
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(x for x in root.rglob("*") if x.is_file() and x.name not in set(hidden) and x.resolve() != Path(to).resolve()):
            names.append(p.relative_to(root).as_posix())
            z.write(p, names[-1])
    return names


def document_lines(lines: DataFrame, order: str = "line_no", text: str = "line") -> DataFrame:
    """(order, style, text) of Markdown lines: headings, lists and plain paragraphs, without marks; blank lines drop out."""
    kind = markdown_class(F.col(text))
    bare = strip_inline(F.regexp_replace(F.trim(F.col(text)), r"^(?:#{1,3} |[-*•] |\d+\.\s+)", ""))
    return lines.select(F.col(order), kind.alias("style"), bare.alias("text")).where("style <> 'blank'")


def write_docx(lines: DataFrame, to: str, order: str = "line_no", text: str = "line") -> int:
    """One document of Markdown lines, streamed to the file partition by partition; the number of paragraphs."""
    n = 0
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        with z.open("word/document.xml", "w") as out:
            out.write(b'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>')
            for r in document_lines(lines, order, text).orderBy(order).toLocalIterator():
                style = f'<w:pPr><w:pStyle w:val="{_STYLE[r["style"]]}"/></w:pPr>' if r["style"] in _STYLE else ""
                out.write(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(r["text"])}</w:t></w:r></w:p>'.encode())
                n += 1
            out.write(b"</w:body></w:document>")
    return n


def write_meta(job: dict, folder: str) -> str:
    """The record of a job beside its outputs."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    to = Path(folder, "meta.json")
    to.write_text(json.dumps(job, indent=1, sort_keys=True), encoding="utf-8")
    return str(to)


def read_meta(spark: SparkSession, pattern: str) -> DataFrame:
    """The records of jobs on disk."""
    return spark.read.schema(META).json(pattern, multiLine=True)


def known_jobs(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """Every job once, as it is in memory or else on disk."""
    cols = [c for c in memory.columns if c != "job_id"]
    a, b = memory.alias("a"), disk.alias("b")
    pick = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) if c in disk.columns else F.col(f"a.{c}") for c in cols]
    return a.join(b, F.col("a.job_id") == F.col("b.job_id"), "full_outer").select(F.coalesce("a.job_id", "b.job_id").alias("job_id"), *pick)
