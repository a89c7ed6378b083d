"""Operator 2: exact n-gram Jaccard join with set-relation skipping (see simjoin)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simjoin import components, similarity_classes


def ngram_jaccard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Two texts link when the Jaccard similarity of their sets of ``shingle``-word shingles is num/den or
    more. Words are runs of other than ASCII white space, ASCII letters in lower case; a shorter text is
    one shingle. component_id is the smallest id reachable by links. Null, empty and blank texts have no
    shingles, no links, and their own id. Repeated rows come back as often as they are given; a row of null id
    comes back with null component. Ids are whole numbers of up to 64 bits. An empty table gives an empty result. A long
    text is one step of a task, at about 60 bytes of memory a word. Other columns of ``docs`` are ignored,
    whatever their names."""
    part = 96 if 10 * num >= 9 * den else 48
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts, classes = similarity_classes(base.where("id is not null"), k=shingle, num=num, den=den, part=part)
    return components(base, texts, classes, id_col)


def one_of_each(docs: DataFrame, joined: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (rows of null id stay)."""
    keep = joined.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(keep, docs[id_col] == keep["_kept"], "left_semi").union(docs.where(F.col(id_col).isNull()))
