r"""Line deduplication by a log-template tree, with DataFrame functions only.

Each line falls through a tree of fixed depth: first by its number of tokens, then by its leading ``LEAD`` tokens, where
tokens with a digit count as a wildcard. Leaves that occur in ``MIN_TEXTS`` different texts or more are looked into. There the
template is the most frequent token at each place (tokens with a digit as a wildcard); places where lines differ are its
variable fields. A line that agrees with its leaf's template in ``ALIKE`` of 10 places or more is an instance; every other
wording, with its wildcards, is a template of its own. A template with more wildcards than words is none: rows of figures are data.
Where instances recur in ``MIN_TEXTS`` different texts, they are dropped, but for those of the document with the smallest
id, which keeps the wording in the corpus once. The lines that are left of a leaf in which something was found go through
this again, until nothing is found in any leaf, so that a leaf holds any number of templates; a round takes one template and
all recurring wordings out of each leaf, and later rounds work on the leaves of several templates alone. Exact copies of a
text count once: copies of documents are another operator's matter.

Leaves, templates and wordings meet the lines by a broadcast where their tables are small, else by a join that deals hot
leaves into parts. The numbers of the dropped lines meet the texts in a shuffle, at every size: their number grows with the
corpus, so no bound could hold for a broadcast.

Lines are what ``\n`` parts; tokens are runs of characters other than ``\x20 \x09-\x0D``; lines without tokens always stay.

Edge cases (tested): a null text stays null and has no lines; an empty one stays empty; a null id is no smallest id, and
its instances are dropped, unless no instance has an id: then all stay; rows that repeat are all treated alike; of equally
frequent tokens the larger by code point is the template's; an empty table gives an empty result; further columns are
carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common

LEAD = 3
MIN_TEXTS = 10
ALIKE = 7
#: Rounds that the SQL spells out: more than the leaves of the tables need.
SQL_ROUNDS = 12


def _general(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), "<*>").otherwise(token)


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, line_no, tokens, leaf of each line with tokens."""
    text = F.col("`text`")
    for space in "\t\x0b\f\r":  # cuts at one character need no pattern
        text = F.replace(text, F.lit(space), F.lit(" "))
    rows = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64(F.col("`text`")).alias("mark"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.withColumn("tokens", F.array_remove(F.split("line", " "), "")).filter(F.size("tokens") > 0)
    lead = F.concat_ws(" ", *[_general(F.get("tokens", F.lit(k))) for k in range(LEAD)])
    return rows.select("doc_id", "mark", "line_no", "tokens", F.xxhash64(F.size("tokens"), lead).alias("leaf"))


def _worded(tokens: str) -> Column:
    return 2 * F.size(F.array_remove(tokens, "<*>")) >= F.size(tokens)


def _met(many: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Lines with what a written table has for their key, once."""
    return many.join(F.broadcast(few), on) if common.small(few) else common.salted_join(many, few, on, "mark", many)


def recurring_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, alike: int = ALIKE) -> DataFrame:
    """doc_id, mark, line_no of the lines to drop."""
    lines = _lines(docs)
    leaves = common.durable(lines.select("leaf", "mark").distinct().groupBy("leaf").count().filter(F.col("count") >= min_texts).select("leaf"))
    pool = common.durable(_met(lines, leaves, ["leaf"]).withColumn("tokens", F.transform("tokens", _general)))
    dropped = None
    while dropped is None or not pool.isEmpty():
        places = pool.select("leaf", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").count()
        best = places.groupBy("leaf", "place").agg(F.max(F.struct("count", "token"))["token"].alias("token"))
        templates = best.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("template"))
        templates = common.durable(templates.withColumn("template", F.when(_worded("template"), F.col("template"))))  # a row a leaf
        agrees = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: a == b), lambda x: x))
        instance = F.col("template").isNotNull() & (10 * agrees >= alike * F.size("tokens"))
        told = _met(pool, templates, ["leaf"]).select("leaf", "doc_id", "mark", "line_no", "tokens", F.when(~instance, F.array_join("tokens", " ")).alias("wording"))
        told = common.durable(told.withColumn("wording", F.when(F.col("wording").isNull(), 0).otherwise(F.xxhash64("wording"))))
        kept = told.filter((F.col("wording") == 0) | _worded("tokens")).groupBy("leaf", "wording", "mark").agg(F.min("doc_id").alias("first"))
        kept = kept.groupBy("leaf", "wording").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
        kept = common.durable(kept.filter(F.col("texts") >= min_texts).drop("texts"))
        gone = common.durable(_met(told, kept, ["leaf", "wording"]).filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "mark", "line_no"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
        # where nothing was found, another round would find nothing
        again = common.durable(kept.select("leaf").distinct())
        left = _met(told, again, ["leaf"]).join(common.maybe_broadcast(kept), ["leaf", "wording"], "left_anti").drop("wording")
        last, pool = pool, common.durable(left)
        common.release(last, templates, told, kept, again)
    return dropped


def drop_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, alike: int = ALIKE) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_lines and n_dropped besides (columns so named give way)."""
    dropped = recurring_lines(docs, min_texts, alike)
    gone = dropped.groupBy(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark")).agg(F.collect_set("line_no").alias("cut_lines")).hint("merge")
    # by text as well as id: rows that share an id and differ in text are told apart
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # one column: no name can clash
    meets = F.col("row.doc_id").cast("long").eqNullSafe(F.col("cut_id")) & (F.xxhash64(F.col("row.text")) == F.col("cut_mark"))
    rows = rows.join(gone, meets, "left")
    lines = F.split(F.col("row.text"), "\n")
    stays = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("cut_lines", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("cut_lines").isNull(), F.col("row.text")).otherwise(F.array_join(stays, "\n"))
    kept = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*kept, F.greatest(F.coalesce(F.size(lines), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("cut_lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _round_sql(r: int) -> str:
    """One round over the lines ``i<r>``: which wording each has, which recur, which lines go, and the lines of the next round."""
    return f"""
p{r} AS (SELECT leaf, generate_subscripts(tokens, 1) AS place, unnest(tokens) AS token FROM i{r}),
q{r} AS (SELECT leaf, place, token, count(*) AS n FROM p{r} GROUP BY ALL),
b{r} AS (SELECT leaf, place, token FROM q{r} QUALIFY row_number() OVER (PARTITION BY leaf, place ORDER BY n DESC, token DESC) = 1),
t{r} AS (SELECT leaf, list(token ORDER BY place) AS template FROM b{r} GROUP BY leaf HAVING 2 * count(*) FILTER (WHERE token <> '<*>') >= count(*)),
m{r} AS (SELECT i.*, CASE WHEN t.leaf IS NOT NULL AND 10 * len(list_filter(list_zip(i.tokens, t.template), lambda x: x[1] = x[2])) >= {ALIKE} * len(i.tokens)
  THEN '' ELSE array_to_string(i.tokens, ' ') END AS wording FROM i{r} i LEFT JOIN t{r} t USING (leaf)),
f{r} AS (SELECT leaf, wording, min(doc_id) AS first FROM m{r} WHERE wording = '' OR 2 * len(list_filter(tokens, lambda x: x <> '<*>')) >= len(tokens)
  GROUP BY leaf, wording HAVING count(DISTINCT mark) >= {MIN_TEXTS}),
x{r} AS (SELECT m.doc_id, m.mark, m.line_no FROM m{r} m JOIN f{r} f USING (leaf, wording) WHERE m.doc_id IS DISTINCT FROM f.first),
i{r + 1} AS (SELECT m.leaf, m.doc_id, m.mark, m.line_no, m.tokens FROM m{r} m LEFT JOIN f{r} f USING (leaf, wording) WHERE f.leaf IS NULL AND m.leaf IN (SELECT leaf FROM f{r})),"""


OP7_SQL = rf"""
WITH l AS (SELECT doc_id, md5(text) AS mark, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT doc_id, mark, line_no, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens FROM l),
n AS (SELECT *, len(tokens) || ' ' || array_to_string(tokens[1:{LEAD}], ' ') AS leaf FROM k WHERE len(tokens) > 0),
c AS (SELECT leaf FROM n GROUP BY leaf HAVING count(DISTINCT mark) >= {MIN_TEXTS}),
i0 AS (SELECT n.leaf, n.doc_id, n.mark, n.line_no, n.tokens FROM n JOIN c USING (leaf)),{"".join(map(_round_sql, range(SQL_ROUNDS)))}
x AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT * FROM x{r}" for r in range(SQL_ROUNDS))})),
r AS (SELECT l.doc_id, l.mark, count(*) AS n_lines, count(x.line_no) AS n_dropped,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE x.line_no IS NULL), '') AS kept
  FROM l LEFT JOIN x ON l.doc_id IS NOT DISTINCT FROM x.doc_id AND l.mark = x.mark AND l.line_no = x.line_no GROUP BY l.doc_id, l.mark)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND md5(d.text) = r.mark
"""
