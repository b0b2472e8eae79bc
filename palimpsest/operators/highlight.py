"""From a search to highlighted copies of Word files, in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import docx
from . import locate as P
from . import report as R
from .lines import explode, rows, sentences
from .matching import Found, SearchParams, search, segmented


@dataclass
class Highlighted:
    """``copies(path, content, n_parts, n_agree, error)``: a copy for each file with a match that was found again, and
    how many of its parts it was verified to shade. ``located(doc_id, src_id, src_line, tgt_line, rate, status)``: what
    became of each match. ``found``: the search itself; releasing it frees what it keeps."""

    copies: DataFrame
    located: DataFrame
    found: Found


def highlighted(sources: DataFrame, files: DataFrame, params: SearchParams = SearchParams()) -> Highlighted:
    """``sources(src_id, text)`` searched in the Word ``files(path, content)``; each matched line is looked up in
    its file's paragraphs and shaded there by its rate. A path is a document's id.

    Files that cannot be read have no text and so no copy; a match whose line is too short to look for is
    ``skipped``. A file's parts are held together when its copy is written, as the copy is."""
    read = docx.read(files).filter("error is null").select(F.col("path").alias("doc_id"), "para_no", "text")
    ordered = F.sort_array(F.collect_list(F.struct("para_no", "text")))
    joined = read.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text")).persist()
    found = search(sources, joined, params)
    found.kept.frames.append(joined)
    cut = segmented(joined, "doc_id", params) if params.segmenter else joined
    lines = explode(cut, "doc_id", (rows if params.segmenter else sentences)(F.col("text"))).select("doc_id", F.col("line_no").alias("tgt_line"), F.col("text").alias("line"))
    key = ["src_id", "src_line", "tgt_line", "rate"]
    hits = lines.join(found.kept.checked(found.matches.select("doc_id", *key)), ["doc_id", "tgt_line"])
    spans = P.spans_in(hits.withColumn("search", P.prepared(F.col("line"))), joined, key).persist()
    found.kept.frames.append(spans)
    status = F.when(F.col("search").isNull(), "skipped").when(F.size("spans") > 0, "found").otherwise("not found")
    located = spans.select("doc_id", *key, status.alias("status"))
    named = F.concat_ws(" ", "src_id", "src_line", "tgt_line")
    each = spans.select("doc_id", F.posexplode("spans").alias("nth", "span"), named.alias("name"), "rate").select("doc_id", F.concat_ws(" ", "name", "nth").alias("span_no"), "span.begin", "span.end", R.colour(F.col("rate"), True).alias("colour"))
    offsets = P.paragraph_offsets(read.withColumnRenamed("para_no", "line_no"), "doc_id")
    parts = P.overlapping(each, offsets, "doc_id").join(each.select("doc_id", "span_no", "colour"), ["doc_id", "span_no"])
    parts = parts.select(F.col("doc_id").alias("path"), "line_no", "from", "to", "colour").distinct()
    return Highlighted(docx.copies(files, parts), located, found)
