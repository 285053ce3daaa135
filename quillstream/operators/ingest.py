"""Files: classification, metadata, and loading each only once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def classified(files: DataFrame, path: str = "file_url", images: bool = False) -> DataFrame:
    """files with file_type, file_status and reason."""
    p = F.col(path)
    ext = extension(p)
    embedded = F.array_contains(F.split(p, "/"), "img_folder")
    image, page, pdf, known = ext.isin(*IMAGES), ext.isin("html", "htm"), ext == "pdf", ext.isin("doc", "docx", "svg")
    kind = F.when(pdf, "pdf").when(page, "html").when(image, "image").otherwise("unknown")
    status = F.when(embedded, "skipped").when(pdf | page, "candidate").when(image, "candidate" if images else "skipped").otherwise("unsupported")
    reason = F.when(embedded, "embedded_resource").when(pdf | page, "supported").when(image, "supported" if images else "images_disabled").when(known, F.concat(F.lit("unsupported_extension:"), ext)).otherwise("unknown_extension")
    return files.withColumns({"file_type": kind, "file_status": status, "reason": reason})


def metadata(files: DataFrame, path: str = "file_url") -> DataFrame:
    """files with stem and stated company (before the first underscore, else null)."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.withColumns({"stem": stem, "stated_company": F.when(F.instr(stem, "_") > 0, F.split_part(stem, F.lit("_"), F.lit(1)))})


def ingested(files: DataFrame, loaded: DataFrame, limit: int, path: str = "file_url") -> DataFrame:
    """files with the outcome of a load: duplicates of loaded ones, the first `limit` new candidates in path order, and the rest."""
    known = loaded.select(path).distinct().withColumn("_known", F.lit(True))
    joined = classified(files, path).join(known, path, "left")
    fresh = (F.col("file_status") == "candidate") & F.col("_known").isNull()
    # the cut is a global order of few columns: Spark sorts by range and takes the first ones
    chosen = joined.filter(fresh).select(path).distinct().orderBy(path).limit(limit).withColumn("_chosen", F.lit(True))
    joined = joined.join(chosen, path, "left")
    outcome = F.when(F.col("file_status") != "candidate", F.col("file_status")).when(F.col("_known"), "duplicate").when(F.col("_chosen"), "imported").otherwise("waiting")
    return joined.withColumn("outcome", outcome).drop("_known", "_chosen")


def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title and body text: hidden elements go, tags are line ends, lines are trimmed and blank ones dropped."""
    h = F.col(html)
    for tag in ("script", "style", "noscript", "svg", "nav", "footer"):
        h = F.regexp_replace(h, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    body = F.regexp_replace(F.regexp_replace(h, r"(?is)<head[^>]*>.*?</head>", ""), r"(?s)<[^>]*>", "\n")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(sign))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    title = F.trim(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.withColumns({"title": title, "body": F.array_join(lines, "\n")})


def latest(files: DataFrame, by: str, order: str) -> DataFrame:
    return files.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
