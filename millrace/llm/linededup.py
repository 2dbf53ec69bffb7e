"""Line dedup with a tree of line templates of fixed depth.

As log parsers do, a line goes down a tree: tokens with digits are variable fields and
masked; the first level is the number of tokens, the next ones the leading tokens. In a
leaf, a token is constant where it is frequent at its place, and a line whose tokens are
mostly constant takes the leaf's template, with wildcards for the rest. A template that
occurs in many documents is boilerplate: its lines are dropped, but for the first one,
so that no text is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACE_RUN, WORD, forget, free, let, packed, saved, table, unpacked, written

#: Leading tokens that lead to a leaf.
DEPTH = 3
#: A template recurs if at least so many documents have it; a token is constant if so many have it at its place.
MIN_DOCS = 10
#: A line is generalised beyond its masked fields if so large a share of its tokens is constant.
CONSTANT = 0.75

NUMBERED = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _masked(line: Column) -> Column:
    """The tokens of a line, joined by single spaces, those with digits masked.

    Regular expressions run on the few lines that need them.
    """
    single = F.when(line.rlike(r"[\x09-\x0D]|  "), F.regexp_replace(line, SPACE_RUN, " ")).otherwise(line)
    trimmed = F.trim(single)
    return F.when(trimmed.rlike("[0-9]"), F.regexp_replace(trimmed, NUMBERED, "<*>")).otherwise(trimmed)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, i, masked) for every line with a word; h tells texts of one id apart.

    The digest and the lines of a text are taken below the generator, once a document.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", "\n").alias("lines"))
    lines = rows.select("doc_id", "h", F.posexplode("lines").alias("i", "line"))
    return lines.select("doc_id", "h", "i", _masked(F.col("line")).alias("masked")).where("masked != ''")


def _size(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _leaf(masked: Column) -> Column:
    return F.xxhash64(_size(masked), F.substring_index(masked, " ", DEPTH))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, h, i): the lines to drop, of ``docs`` (doc_id, text).

    Documents are told apart by id and text, so that repeated rows count once. The texts
    are read once: their lines are written with hashes and masked text side by side, and
    what follows reads the hashes, and the text of open leaves only.
    """
    masked = F.col("masked")
    lines = saved(_lines(docs).select("doc_id", "h", "i", _leaf(masked).alias("leaf"), F.xxhash64(masked).alias("line"), _size(masked).alias("n"), "masked"), "lines")
    once = lines.groupBy("doc_id", "h", "leaf", "line", "n").agg(F.min("i").alias("i"))
    counted = saved(once.groupBy("leaf", "line", "n").agg(F.count(F.lit(1)).alias("docs")), "counted")
    # leaves in which something can be generalised: several lines, in enough documents
    leaves = counted.groupBy("leaf").agg(F.sum("docs").alias("all"), F.count(F.lit(1)).alias("kinds")).where((F.col("all") >= min_docs) & (F.col("kinds") > 1)).select("leaf")
    leaves = saved(leaves, "leaves")
    # a line of a million documents is one row of each task before anything is shuffled
    texts = lines.select("leaf", "line", "masked").join(leaves, "leaf", "left_semi").distinct()
    held = saved(texts.join(counted, ["leaf", "line"]).select("leaf", "line", "n", "docs", F.split("masked", " ").alias("tokens")), "open")
    placed = held.select("leaf", "line", "n", "docs", F.posexplode("tokens").alias("at", "token"))
    frequent = placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).select("leaf", "at", "token")
    # the constant tokens of a line, as a set of places, decide its template
    marked = placed.join(saved(frequent, "frequent"), ["leaf", "at", "token"], "left_semi").groupBy("leaf", "line", "n").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("constant"))
    templates = saved(marked.where(F.size("constant") >= CONSTANT * F.col("n")).select("leaf", "line", F.xxhash64("leaf", F.col("constant")).alias("template")), "templates")

    def named(df: DataFrame) -> DataFrame:
        return df.join(templates, ["leaf", "line"], "left").withColumn("template", F.coalesce("template", "line"))

    support = named(once).groupBy("template", "doc_id", "h").agg(F.min("i").alias("i")).groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "h", "i")).alias("first"))
    # written, so that the join below reads both sides from shuffles: then a hot template's rows can be split over tasks
    support = saved(support.where(F.col("docs") >= min_docs).drop("docs"), "support")
    found = named(lines.select("doc_id", "h", "i", "leaf", "line")).join(support, "template")
    return found.where(~F.struct("doc_id", "h", "i").eqNullSafe(F.col("first"))).select("doc_id", "h", "i")


def drop_recurring(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``df`` with recurring lines removed from ``text``, and the new columns n_lines and n_dropped (long).

    Lines are what stands between \\n. The first line of a recurring template (by id, text
    hash and place; a null id comes first) stays. Null texts stay null, with 0 lines;
    lines without a word always stay. Rows with a null id are documents like others. A
    text of any length is cut into its lines where it lies; only a line must fit a task.
    Other columns and repeated rows pass through; columns called n_lines or n_dropped
    are replaced.
    """
    df = free(df, ["n_lines", "n_dropped"])
    own = F.col(f"`{text}`")
    rows = df.select(packed(df).alias("row"), F.col(f"`{key}`").alias("id"), F.xxhash64(own).alias("h"), own.alias("text"))
    since = written()
    dropped = recurring(rows.select(F.col("id").alias("doc_id"), "text"), min_docs).groupBy("doc_id", "h").agg(F.collect_set("i").alias("gone"))
    dropped = saved(dropped, "dropped")
    forget(df.sparkSession, since, 1)
    # texts are joined by sorting at every size: what is dropped grows with the documents
    joined = rows.drop("text").alias("l").join(dropped.hint("merge").alias("r"), F.col("l.id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.h") == F.col("r.h")), "left").select("row", "gone")
    whole = F.col(f"row.c{df.columns.index(text)}")
    lines = F.split(whole, "\n")
    # an array's difference is taken by hashing, so that long texts cost no more than their length
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    return joined.select(
        *unpacked(df.columns, "row", {text: F.when(F.col("gone").isNull(), whole).otherwise(left)}),
        F.when(whole.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its lines, how many of them were dropped, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, t FROM (
    SELECT doc_id, i, regexp_extract_all(regexp_replace(line, '{NUMBERED}', '<*>', 'g'), '{WORD}') AS t FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
    )
  ) WHERE len(t) > 0
), once AS (
  SELECT doc_id, t, min(i) AS i FROM lines GROUP BY doc_id, t
), counted AS (
  SELECT t, len(t) AS n, len(t) || ' ' || array_to_string(t[1:{DEPTH}], ' ') AS leaf, count(*) AS docs FROM once GROUP BY t
), leaves AS (
  SELECT leaf FROM counted GROUP BY leaf HAVING sum(docs) >= {MIN_DOCS} AND count(*) > 1
), placed AS (
  SELECT leaf, t, n, docs, unnest(t) AS token, generate_subscripts(t, 1) AS spot FROM counted WHERE leaf IN (SELECT leaf FROM leaves)
), frequent AS (
  SELECT leaf, spot, token FROM placed GROUP BY leaf, spot, token HAVING sum(docs) >= {MIN_DOCS}
), templates AS (
  SELECT p.t, p.leaf || ' @ ' || string_agg(p.spot || ':' || p.token, ' ' ORDER BY p.spot) AS template
  FROM placed p JOIN frequent f ON p.leaf = f.leaf AND p.spot = f.spot AND p.token = f.token
  GROUP BY p.t, p.leaf, p.n HAVING count(*) >= {CONSTANT} * p.n
), named AS (
  SELECT l.doc_id, l.i, coalesce(m.template, array_to_string(l.t, ' ')) AS template FROM lines l LEFT JOIN templates m ON m.t = l.t
), support AS (
  SELECT template, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), gone AS (
  SELECT n.doc_id, list(n.i) AS d FROM named n JOIN support s ON s.template = n.template
  WHERE struct_pack(doc_id := n.doc_id, i := n.i) <> s.first GROUP BY n.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.d), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN g.d IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: NOT list_contains(g.d, k - 1)), chr(10)) END) AS text_sha256
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id
"""
