"""The catalogue: each capability as a query over the driver's tables, with the SQL that it must equal.

A document is a source and its lines are passages; `source` plays the project, `labels` the index (a document without a
label isn't indexed), `embeddings` the vectors of the documents with the same id, `conversations` the threads, `events` the
change feed, and region > nation > customer > orders the folder tree.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import policy
from lodestone.functions import text as tx
from lodestone.operators import incremental, layout, relational, search, select, storage, vectors
from lodestone.operators.index import Field, Index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TERMS = ["the", "of", "and", "license", "de"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


P = "p AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)"
T = "list_distinct(regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+'))"
LIST = "['the', 'of', 'and', 'license', 'de']"


# --- passages, terms, lexical retrieval ---------------------------------------------------------------------------------


@query(f"WITH {P} SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(length(line) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p")
def passages_by_line(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return passages(spark, d).select("doc_id", big("ordinal").alias("ordinal"), big(F.length("line")).alias("n_chars"), big(F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0))).alias("start"))


@query("WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:_[\\p{L}\\p{N}]+)*')) AS term FROM documents) SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 50")
def token_frequency_topk(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(tx.TERM))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(50)


QUERY_TERMS = r"""WITH l AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)*') AS l FROM documents),
w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM l), f AS (SELECT doc_id, t, min(i) AS i FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f), g AS (SELECT doc_id, string_agg(t, ' ' ORDER BY k) AS terms FROM r WHERE k <= 32 GROUP BY 1)
SELECT doc_id, coalesce(terms, '') AS terms FROM l LEFT JOIN g USING (doc_id)"""


@query(QUERY_TERMS)
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", tx.query_terms(F.col("text"))).alias("terms"))


#: A line's own words, and the labels in front of it at half their weight (a binary fraction: sums don't depend on their order).
LINE_FIELDS = Field("line"), Field("prefix", 0.5, body=False)


def _labelled(lines: DataFrame) -> DataFrame:
    return lines.withColumn("prefix", F.concat_ws(" ", F.lit("project"), "source", F.lit("language"), "lang"))


def line_index(spark: SparkSession, d: str) -> Index:
    """The index over all lines of documents; stored once a session for the same files, as its users would keep it."""
    return storage.once(spark, f"{d}/documents.parquet", "line-index", lambda: Index.build(_labelled(passages(spark, d)), storage.fresh_path(spark, "line-index"), LINE_FIELDS))


def _place(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ordinal", big("ordinal"))


LEX = f"""WITH {P}, s AS (SELECT doc_id, ordinal, source, len(list_intersect({T}, {LIST})) AS hits FROM p)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, round(hits / 5.0, 6) AS coverage, row_number() OVER (ORDER BY hits DESC, doc_id, ordinal) AS rank FROM s WHERE hits > 0"""


@query(LEX + " ORDER BY rank LIMIT 24")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """Reads the postings of the question's terms alone."""
    return _coverage(line_index(spark, d).top(TERMS, 24, "hits"))


def _coverage(found: DataFrame) -> DataFrame:
    best = search.ranked(found, F.desc("hits"), F.asc("doc_id"), F.asc("ordinal"))
    return _place(best.select("doc_id", "ordinal", F.round(F.col("hits") / F.lit(float(len(TERMS))), 6).alias("coverage"), big("rank").alias("rank")))


@query(LEX.replace("FROM s WHERE", "FROM s SEMI JOIN labels USING (doc_id) WHERE source IN ('src0', 'src1') AND") + " ORDER BY rank LIMIT 24")
def lexical_search_scoped(spark: SparkSession, d: str) -> DataFrame:
    mine = table(spark, d, "documents").filter(F.col("source").isin("src0", "src1")).select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return _coverage(line_index(spark, d).top(TERMS, 24, "hits", mine))


@query(f"WITH {P}, h AS (SELECT doc_id, ordinal, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM p), r AS (SELECT doc_id, ordinal, CAST(count(*) AS DOUBLE) AS r FROM h WHERE list_contains({LIST}, term) GROUP BY ALL) SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, round(r / (r + 1), 6) AS score FROM r ORDER BY r DESC, doc_id, ordinal LIMIT 50")
def weighted_rank(spark: SparkSession, d: str) -> DataFrame:
    found = line_index(spark, d).top(TERMS, 50)
    return _place(found.select("doc_id", "ordinal", F.round(F.col("raw") / (F.col("raw") + 1), 6).alias("score")))


W = "regexp_extract_all(lower(line), '[\\p{L}\\p{N}_]+')"
POSTED = f"WITH {P}, w AS (SELECT doc_id, ordinal, unnest({W}) AS term, generate_subscripts({W}, 1) AS pos FROM p)"


@query(f"{POSTED} SELECT term, count(*) AS passages, sum(n)::BIGINT AS positions, max(n) AS most FROM (SELECT term, doc_id, ordinal, count(*) AS n FROM w GROUP BY ALL) GROUP BY term")
def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term's passages and positions, from the stored postings."""
    n = F.size("positions")
    rows = line_index(spark, d).postings().filter("field = 0")
    return rows.groupBy("term").agg(F.count("*").alias("passages"), big(F.sum(n)).alias("positions"), big(F.max(n)).alias("most"))


CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN coalesce(text, '') || ' the lodestar' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 1)"


@query(f"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM {CHANGED}), w AS (SELECT doc_id, ordinal, unnest({W}) AS term FROM p) SELECT term, count(DISTINCT (doc_id, ordinal)) AS passages, count(*) AS positions, sum(doc_id)::BIGINT AS ids FROM w GROUP BY term")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the documents changed and a tenth gone: a delta segment over the stored index, then all merged, gives what an index over the
    changed documents would."""
    docs = table(spark, d, "documents")
    new = docs.filter("doc_id % 10 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" the lodestar")))
    lines = new.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    base = Index.build(_labelled(passages(spark, d)), storage.fresh_path(spark, "updated-index"), LINE_FIELDS)
    rows = base.update(_labelled(lines), docs.filter("doc_id % 10 = 1").select("doc_id")).merge().postings().filter("field = 0")
    return rows.groupBy("term").agg(F.count("*").alias("passages"), big(F.sum(F.size("positions"))).alias("positions"), big(F.sum(F.col("doc_id") * F.size("positions"))).alias("ids"))


@query(f"{POSTED}, h AS (SELECT doc_id, ordinal, pos, term, lag(pos) OVER o AS before, lag(term) OVER o AS other FROM w WHERE term IN ('the', 'of') WINDOW o AS (PARTITION BY doc_id, ordinal ORDER BY pos)), s AS (SELECT doc_id, ordinal, sum(1.0::DOUBLE / (pos - before)) FILTER (other <> term) AS raw FROM h GROUP BY ALL) SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, round(raw / (raw + 1), 6) AS score FROM s WHERE raw IS NOT NULL")
def cover_density(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold both words, by how close they stand: of two words, every change from one to the other bounds a minimal cover."""
    found = line_index(spark, d).covers(["the", "of"])
    return _place(found.select("doc_id", "ordinal", F.round(F.col("raw") / (F.col("raw") + 1), 6).alias("score")))


ASKED = "['the', 'license', 'of', 'src0', 'house']"


@query(f"WITH {P}, q AS (SELECT doc_id, ordinal, [x for x in {W} if list_contains({ASKED}, x)] AS b, [x for x in regexp_extract_all(lower(concat_ws(' ', 'project', source, 'language', lang)), '[\\p{{L}}\\p{{N}}_]+') if list_contains({ASKED}, x)] AS f FROM p), t AS (SELECT doc_id, ordinal, b, len(b) + 0.5::DOUBLE * len(f) AS raw FROM q WHERE len(b) + len(f) > 0 ORDER BY raw DESC, doc_id, ordinal LIMIT 24), s AS (SELECT doc_id, ordinal, len(list_distinct(b)) / 5.0::DOUBLE AS coverage, raw / (raw + 1) AS r FROM t WHERE len(b) > 0) SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, round(coverage, 6) AS coverage, round(r, 6) AS index_rank, row_number() OVER (ORDER BY coverage + r DESC, doc_id, ordinal) AS rank FROM s")
def rescored_search(spark: SparkSession, d: str) -> DataFrame:
    """The 24 best by the index's rank over text and labels, then by coverage and rank; what only the labels match goes."""
    found = line_index(spark, d).rescored(["the", "license", "of", "src0", "house"], 24)
    return _place(found.select("doc_id", "ordinal", F.round("coverage", 6).alias("coverage"), F.round("index_rank", 6).alias("index_rank"), big("rank").alias("rank")))


@query("SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z])(latest|newest|most recent|current|right now|how many|count of|timestamp)([^a-z]|$)') AS gated FROM conversations WHERE role = 'user'")
def gate_exact_question(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", search.needs_live_answer(F.col("text")).alias("gated"))


@query(f"WITH {P}, n AS (SELECT doc_id, count(*) AS lines, arg_max(ordinal, (len(list_intersect({T}, {LIST})), -ordinal)) AS best FROM p GROUP BY doc_id) SELECT doc_id, lines, CAST(best AS BIGINT) AS best FROM n")
def best_block(spark: SparkSession, d: str) -> DataFrame:
    """Each document's line with the most of the terms, its first where none has any; the lines are counted from the index's own table."""
    index = line_index(spark, d)
    found = index.scored(TERMS).filter("hits > 0").groupBy("doc_id").agg(F.max_by("ordinal", F.struct("hits", (-F.col("ordinal")).alias("o"))).alias("best"))
    lines = index.passages().groupBy("doc_id").agg(F.count("*").alias("lines"))
    return lines.join(found, "doc_id", "left").select("doc_id", "lines", big(F.coalesce("best", F.lit(0))).alias("best"))


# --- vectors and fusion -------------------------------------------------------------------------------------------------

ALL_COS = "(SELECT q.vec_id AS q, e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS s FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id AND q.vec_id % 50 = 0)"


@query(f"SELECT q, vec_id, s AS similarity, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM {ALL_COS} QUALIFY rank <= 24")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 24 nearest vectors of every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return vectors.neighbours(e.filter("vec_id % 50 = 0"), e, 24).select("q", "vec_id", F.col("s").alias("similarity"), big("rk").alias("rank"))


PAIR_COS = "(SELECT q.vec_id AS q, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, embeddings q WHERE e.vec_id <> q.vec_id AND q.vec_id % 50 = 0)"


@query(f"SELECT q, vec_id, round(s, 6) AS similarity FROM {PAIR_COS} WHERE 1 - s <= 1 - 0.15")
def cosine_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Everything near enough to any vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    return vectors.within(e.filter("vec_id % 50 = 0"), e, 0.15).select("q", "vec_id", F.round("s", 6).alias("similarity"))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def approximate_recall(spark: SparkSession, d: str) -> DataFrame:
    """Inverted lists against exact search: whether of the 24 nearest of all queries nine tenths are found at least."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0")
    index = vectors.InvertedLists(e, lists=32)
    near = index.neighbours(q, 24, probes=index.probes_for(24)).select("q", "vec_id", F.lit(1).alias("found"))
    exact = vectors.neighbours(q, e, 24).select("q", "vec_id")
    return exact.join(near, ["q", "vec_id"], "left").agg(F.count_distinct("q").alias("queries"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


@query("SELECT count(*) AS vectors, count(*) FILTER (len(embedding) = 64) AS right_size, count(*) FILTER (list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0) AS non_zero FROM embeddings")
def vector_norm_validity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") == 64).alias("right_size"), F.count_if(vectors.valid(F.col("embedding"), 64)).alias("non_zero"))


RRF = f"""WITH {P}, l AS (SELECT doc_id, row_number() OVER (ORDER BY max(len(list_intersect({T}, {LIST}))) DESC, doc_id) AS rk FROM p GROUP BY doc_id QUALIFY rk <= 24),
v AS (SELECT q, vec_id AS doc_id, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rk FROM {ALL_COS} QUALIFY rk <= 24),
u AS (SELECT q.vec_id AS q, l.doc_id, rk FROM l, (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q UNION ALL SELECT * FROM v)"""


@query(RRF + " SELECT q, doc_id, round(sum(1.0 / (60 + rk)), 8) AS score, count(*) AS lists FROM u GROUP BY ALL")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 50: its nearest ones and the lexical list, fused."""
    return search.fuse_each(*_lists(spark, d)).select("q", "doc_id", F.round("score", 8).alias("score"), "lists")


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    """(q, doc_id, rank): the 24 best documents by a line's terms, the same for every q, and each q's 24 nearest vectors."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0")
    order = F.desc("hits"), F.asc("doc_id")
    best = line_index(spark, d).scored(TERMS).groupBy("doc_id").agg(F.max("hits").alias("hits")).orderBy(*order).limit(24)
    short = search.ranked(best, *order).select("doc_id", "rank").collect()  # 24 rows
    listed = F.array(*[F.struct(F.lit(r["doc_id"]).alias("doc_id"), F.lit(r["rank"]).alias("rank")) for r in short]).cast("array<struct<doc_id:bigint,rank:int>>")
    lexical = q.select(F.col("vec_id").alias("q"), F.explode(listed).alias("l")).select("q", "l.doc_id", "l.rank")
    near = vectors.neighbours(q, e, 24)
    return [lexical, near.select("q", F.col("vec_id").alias("doc_id"), F.col("rk").alias("rank"))]


@query(RRF + ", f AS (SELECT q, doc_id, round(sum(1.0 / (60 + rk)), 8) AS score FROM u GROUP BY ALL), r AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 24) SELECT q, doc_id, rank, CAST(e.vec_id IS NOT NULL AS BIGINT) AS vector_ready FROM r LEFT JOIN embeddings e ON e.vec_id = r.doc_id")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    fused = search.fuse_each(*_lists(spark, d)).withColumn("score", F.round("score", 8))
    best = relational.first_n(fused, ["q"], [F.desc("score"), F.asc("doc_id")], 24, "rank")
    ready = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    return best.join(ready, "doc_id", "left").select("q", "doc_id", big("rank").alias("rank"), big(F.coalesce("has", F.lit(0))).alias("vector_ready"))


@query("SELECT source, count(*) AS total, count(e.vec_id) AS ready, count(*) = count(e.vec_id) AS active FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY source")
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    return vectors.coverage(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["source"])


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings) e USING (doc_id) ORDER BY doc_id LIMIT 16")
def pending_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id").orderBy("doc_id").limit(16)


@query("SELECT lang, source FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY ALL HAVING count(*) FILTER (e.vec_id IS NULL) = 0")
def activation_ready(spark: SparkSession, d: str) -> DataFrame:
    return vectors.coverage(table(spark, d, "documents"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["lang", "source"]).filter("total = ready").select("lang", "source")


PROFILED = "(SELECT doc_id AS passage, sha256(text) AS input_hash, sha256('[\"m\",\"1\",\"64\",\"plain\"]') AS profile FROM documents JOIN embeddings ON vec_id = doc_id UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END, sha256('[\"m\",\"2\",\"64\",\"plain\"]') FROM documents JOIN embeddings ON vec_id = doc_id WHERE source <> 'src2')"


@query(f"WITH v AS {PROFILED}, p AS (SELECT doc_id AS passage, source, sha256(text) AS input_hash FROM documents), t AS (SELECT source, count(*) AS total FROM p GROUP BY 1), r AS (SELECT profile, source, count(*) AS ready FROM p JOIN (SELECT DISTINCT * FROM v) v USING (passage, input_hash) GROUP BY ALL) SELECT k.profile, t.source, total, coalesce(ready, 0) AS ready, coalesce(ready, 0) = total AS active FROM t, (SELECT DISTINCT profile FROM v) k LEFT JOIN r ON r.profile = k.profile AND r.source = t.source")
def profile_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of vectors at once, one of them partly made from texts that have changed: neither lends the other its coverage."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    both = docs.join(e, F.col("vec_id") == F.col("doc_id")).select(F.col("doc_id").alias("passage"), "source", "text", "embedding")

    def kind(revision: str) -> Column:
        return vectors.profile_key(F.lit("m"), F.lit(revision), F.lit(64), F.lit("plain"))

    first = both.select("passage", F.sha2("text", 256).alias("input_hash"), kind("1").alias("profile"), "embedding")
    then = F.when(F.col("passage") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    second = both.filter("source <> 'src2'").select("passage", F.sha2(then, 256).alias("input_hash"), kind("2").alias("profile"), "embedding")
    mine = docs.select(F.col("doc_id").alias("passage"), "source", F.sha2("text", 256).alias("input_hash"))
    return vectors.profile_coverage(mine, first.unionByName(second), ["source"])


@query("SELECT sha, CAST(ceil(n / 16.0) AS BIGINT) AS batch FROM (SELECT sha, row_number() OVER (ORDER BY sha) AS n FROM (SELECT DISTINCT sha256(text) AS sha FROM documents d ANTI JOIN (SELECT vec_id AS doc_id FROM embeddings) e USING (doc_id)))")
def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    return vectors.batches(docs.select(F.sha2("text", 256).alias("sha")), "sha", 16)


@query(f"WITH r AS (SELECT a.vec_id AS q, b.label = a.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rk FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT q, max(CASE WHEN hit THEN 1.0 ELSE 0 END) AS recall, max(CASE WHEN hit THEN 1.0 / rk ELSE 0 END) AS rr, sum(CASE WHEN hit THEN 1 / log2(rk + 1.0) ELSE 0 END) AS dcg FROM r WHERE rk <= 10 GROUP BY q) SELECT CAST(round(avg(recall), 6) AS DOUBLE) AS recall, CAST(round(avg(rr), 6) AS DOUBLE) AS mrr, round(avg(dcg), 6) AS dcg FROM k")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.metrics(vectors.neighbours(e.filter("vec_id % 50 = 0"), e, 10), 10)


# --- duplicates, neighbours, threads, selection -------------------------------------------------------------------------

NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


@query(f"SELECT sha256({NORM}) AS fingerprint, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2(tx.collapse(F.col("text")), 256).alias("fingerprint")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


@query(f"SELECT lang, round(1 - count(DISTINCT sha256({NORM})) / count(*), 6) AS rate FROM documents GROUP BY lang")
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.round(1 - F.count_distinct(F.sha2(tx.collapse(F.col("text")), 256)) / F.count("*"), 6).alias("rate"))


@query(f"WITH k AS (SELECT doc_id, {NORM} AS t, array_to_string(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), ',') AS nums FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY t, nums) AS keep_id FROM k")
def redundant_pairs(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("\0", tx.collapse(F.col("text")), F.concat_ws(",", tx.numbers(F.col("text")))), 256).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.min("doc_id").alias("keep_id")), "k").select("doc_id", "keep_id")


@query(f"WITH {P}, n AS (SELECT doc_id, ordinal, sha256(line) AS h, lag(sha256(line)) OVER w AS before, lead(sha256(line)) OVER w AS after FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)) SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, before, after FROM n")
def neighbour_passages(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    return passages(spark, d).select("doc_id", "ordinal", F.sha2("line", 256).alias("h")).select("doc_id", big("ordinal").alias("ordinal"), F.lag("h").over(w).alias("before"), F.lead("h").over(w).alias("after"))


@query("SELECT a.conv_id, a.turn, b.turn AS other FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE a.turn = 1 QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn) <= 6")
def thread_context(spark: SparkSession, d: str) -> DataFrame:
    return select.thread(table(spark, d, "conversations"), F.col("turn") == 1, 6)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS place FROM conversations")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", F.when(F.col("role") == "user", 0).otherwise(1))
    return table(spark, d, "conversations").select("conv_id", "turn", big(F.row_number().over(w)).alias("place"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def latest_turn_per_conv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"))


@query(f"WITH {P}, w AS (SELECT doc_id, ordinal, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS used FROM p) SELECT doc_id, count(*) AS chosen, CAST(max(used) AS BIGINT) AS used FROM w WHERE used <= 3000 AND ordinal < 6 GROUP BY doc_id")
def budget_select_running(spark: SparkSession, d: str) -> DataFrame:
    return select.prefix_budget(passages(spark, d).withColumn("cost", F.length("line")), ["doc_id"], "ordinal", 3000, 6)


@query(f"WITH RECURSIVE {P}, r AS (SELECT DISTINCT doc_id, -1::BIGINT AS k, ''::VARCHAR AS chosen, 0::BIGINT AS n, 0::BIGINT AS used FROM p UNION ALL SELECT r.doc_id, r.k + 1, CASE WHEN used + length(line) <= 3000 AND n < 6 THEN chosen || ',' || (r.k + 1) ELSE chosen END, CASE WHEN used + length(line) <= 3000 AND n < 6 THEN n + 1 ELSE n END, CASE WHEN used + length(line) <= 3000 AND n < 6 THEN used + length(line) ELSE used END FROM r JOIN p ON p.doc_id = r.doc_id AND p.ordinal = r.k + 1) SELECT doc_id, ltrim(arg_max(chosen, k), ',') AS chosen, arg_max(used, k) AS used FROM r GROUP BY doc_id")
def budget_select_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Lines in order as far as they fit, skipping those that don't."""
    found = select.greedy_budget(passages(spark, d).withColumn("cost", F.length("line")), "doc_id", "ordinal", 3000, 6)
    return found.select("doc_id", F.array_join("chosen", ",").alias("chosen"), "used")


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def citation_containment(spark: SparkSession, d: str) -> DataFrame:
    return search.quotes(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


@query("SELECT d.lang, count(DISTINCT b.item_id) AS items, count(*) AS pairs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY d.lang")
def contamination_pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return search.quotes(docs.select("doc_id", "text"), table(spark, d, "benchmark")).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count_distinct("item_id").alias("items"), F.count("*").alias("pairs"))


# --- relational core ----------------------------------------------------------------------------------------------------


@query("SELECT source, count(DISTINCT d.doc_id) AS documents, count(l.doc_id) AS labels, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    return table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), big(F.coalesce(F.sum("n"), F.lit(0))).alias("labels"), big(F.coalesce(F.sum("good"), F.lit(0))).alias("good"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1996-01-01') AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o_custkey AND c.c_acctbal > 0)")
def authorized_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("account_id"), (F.col("o_orderstatus") == "O").alias("is_active"), F.col("o_orderdate").alias("access_expires_at"))
    accounts = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("account_id"))
    return relational.accessible(orders, accounts, "1996-01-01", ["account_id"]).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unindexed_anti(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN quality = 0 THEN NULL ELSE doc_id END FROM labels)")
def null_aware_not_in(spark: SparkSession, d: str) -> DataFrame:
    """Empty, since the list holds nulls; null_aware_not_in_rows has a list of each kind."""
    listed = table(spark, d, "labels").select(F.when(F.col("quality") != 0, F.col("doc_id")).alias("doc_id"))
    return relational.not_in(table(spark, d, "documents").select("doc_id"), listed, "doc_id")


@query("SELECT 'plain' AS list, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) UNION ALL SELECT 'null', doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN quality = 0 THEN NULL ELSE doc_id END FROM labels) UNION ALL SELECT 'empty', doc_id FROM documents WHERE (CASE WHEN doc_id % 2 = 0 THEN doc_id END) NOT IN (SELECT doc_id FROM labels WHERE quality = 7) UNION ALL SELECT 'null value', doc_id FROM documents WHERE (CASE WHEN doc_id % 2 = 0 THEN doc_id END) NOT IN (SELECT doc_id FROM labels)")
def null_aware_not_in_rows(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    half = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("key"))
    lists = {
        "plain": relational.not_in(docs, labels.filter("toxic = 0").select("doc_id"), "doc_id"),
        "null": relational.not_in(docs, labels.select(F.when(F.col("quality") != 0, F.col("doc_id")).alias("doc_id")), "doc_id"),
        "empty": relational.not_in(half, labels.filter("quality = 7").select(F.col("doc_id").alias("key")), "key").select("doc_id"),
        "null value": relational.not_in(half, labels.select(F.col("doc_id").alias("key")), "key").select("doc_id"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("list"), "doc_id") for k, df in lists.items()])


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F' AND p_size < 25 GROUP BY 1")
def composite_membership(spark: SparkSession, d: str) -> DataFrame:
    li, o, p, s = (table(spark, d, t) for t in ("lineitem", "orders", "part", "supplier"))
    joined = li.join(o.filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).join(p.filter("p_size < 25"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT (SELECT count(*) FROM lineitem) AS total, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned, (SELECT max(l_linenumber) FROM lineitem)::BIGINT AS version")
def scalar_subquery_receipt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), big(F.max("l_linenumber")).alias("version"))


@query("WITH RECURSIVE c AS (SELECT conv_id, turn, 0 AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT t.conv_id, t.turn, c.depth + 1 FROM c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn + 1) SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth FROM c")
def recursive_closure(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn")
    edges = t.select(F.concat_ws("/", "conv_id", "turn").alias("child"), F.concat_ws("/", "conv_id", F.col("turn") - 1).alias("parent"))
    roots = t.filter("turn = 0").select(F.concat_ws("/", "conv_id", "turn").alias("node"))
    found = relational.descendants(edges, roots)
    part = F.split("node", "/")
    return found.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), big("depth").alias("depth"))


@query("SELECT c_custkey, n_name || ' < ' || r_name AS path, CAST(2 AS BIGINT) AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def ancestor_chain(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    up = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return up.select("c_custkey", F.concat_ws(" < ", "n_name", "r_name").alias("path"), big(F.lit(2)).alias("depth"))


TREE = """SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 50 <> 0
UNION SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 6 = 5 THEN 'n' || n_nationkey || 'x' ELSE 'r' || n_regionkey END FROM nation
UNION SELECT 'n' || n_nationkey || 'x', 'n' || n_nationkey FROM nation WHERE n_nationkey % 6 = 5 UNION SELECT 'r1', 'w1' UNION SELECT 'w' || i, 'w' || (i + 1) FROM range(1, 9) t(i)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """Orders below customers below nations below regions; with customers that have no nation, nations below themselves, and a region
    far below the top."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))

    def edge(rows: DataFrame, child: Column, parent: Column) -> DataFrame:
        return rows.select(child.alias("child"), parent.alias("parent"))

    def name(letter: str, key: Column | str) -> Column:
        return F.concat(F.lit(letter), (F.col(key) if isinstance(key, str) else key).cast("string"))

    own, looped = name("n", "n_nationkey"), F.col("n_nationkey") % 6 == 5
    beside = F.concat(own, F.lit("x"))
    above = edge(spark.range(1, 9), name("w", "id"), name("w", F.col("id") + 1)).union(spark.createDataFrame([("r1", "w1")], "child string, parent string"))
    parts = [edge(o, name("o", "o_orderkey"), name("c", "o_custkey")), edge(c.filter("c_custkey % 50 <> 0"), name("c", "c_custkey"), name("n", "c_nationkey")), edge(n, own, F.when(looped, beside).otherwise(name("r", "n_regionkey"))), edge(n.filter(looped), beside, own), above]
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH RECURSIVE e AS ({TREE}), w AS (SELECT 'o' || o_orderkey AS start, 'o' || o_orderkey AS node, 0 AS depth, ['o' || o_orderkey] AS path, false AS cycle FROM orders UNION ALL SELECT w.start, e.parent, w.depth + 1, list_append(w.path, e.parent), list_contains(w.path, e.parent) FROM w JOIN e ON e.child = w.node WHERE NOT w.cycle AND w.depth < 8), l AS (SELECT start, max(depth) AS depth, arg_max(node, depth) AS node, arg_max(array_to_string(path, '<'), depth) AS path, bool_or(cycle) AS cycle FROM w GROUP BY start) SELECT start, node, CAST(depth AS BIGINT) AS depth, path, CASE WHEN cycle THEN 'cycle' WHEN node IN (SELECT child FROM e) THEN 'bound' WHEN node LIKE 'r%' THEN 'root' ELSE 'orphan' END AS ended FROM l")
def ancestor_walk(spark: SparkSession, d: str) -> DataFrame:
    """Every order's ancestors, eight at most, with the path and how the walk ended."""
    from lodestone.operators import walks

    starts = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("node"))
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    found = walks.ancestors(_tree(spark, d), starts, roots, 8)
    return found.select("start", "node", big("depth").alias("depth"), F.array_join("path", "<").alias("path"), "ended")


REACH = "SELECT DISTINCT 'c' || o_custkey AS child, 's' || l_suppkey AS parent FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation"


@query(f"WITH RECURSIVE e AS ({REACH}), w AS (SELECT 'c' || c_custkey AS start, 'c' || c_custkey AS node, 0 AS depth FROM customer UNION SELECT w.start, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.node WHERE w.depth < 8), f AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY min(depth), node) AS place FROM w GROUP BY start, node) SELECT start, count(*) AS visited, bool_or(node = 'r3') AS found FROM f WHERE place <= 64 GROUP BY start")
def search_upwards(spark: SparkSession, d: str) -> DataFrame:
    """Whether a region is among the first 64 places above a customer, by suppliers, nations and regions."""
    from lodestone.operators import walks

    def edge(rows: DataFrame, a: str, child: str, b: str, parent: str) -> DataFrame:
        return rows.select(F.concat(F.lit(a), F.col(child)).alias("child"), F.concat(F.lit(b), F.col(parent)).alias("parent"))

    bought = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = edge(bought, "c", "o_custkey", "s", "l_suppkey").union(edge(table(spark, d, "supplier"), "s", "s_suppkey", "n", "s_nationkey")).union(edge(table(spark, d, "nation"), "n", "n_nationkey", "r", "n_regionkey"))
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    wanted = table(spark, d, "region").filter("r_regionkey = 3").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"))
    return walks.search_upwards(edges, starts, wanted)


# --- semi-structured trees ----------------------------------------------------------------------------------------------

NESTED = """SELECT e.event_id, CASE event_id % 5 WHEN 0 THEN '{"user":{"id":' || user_id || ',"a/b~":[' || props || ',[],null,true]},"type":"' || event_type || '"}' WHEN 1 THEN '[' || props || ',1.5]'
WHEN 2 THEN '{"n":1e5,"t":"1e5"}' WHEN 3 THEN '{"k":1,"k":2}' ELSE props END AS j FROM events e"""


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON: nested, in a list, with a number that isn't exact, with a key that repeats, and as they are."""
    text = F.expr("""CASE event_id % 5 WHEN 0 THEN '{"user":{"id":' || user_id || ',"a/b~":[' || props || ',[],null,true]},"type":"' || event_type || '"}' WHEN 1 THEN '[' || props || ',1.5]'
      WHEN 2 THEN '{"n":1e5,"t":"1e5"}' WHEN 3 THEN '{"k":1,"k":2}' ELSE props END""")
    return table(spark, d, "events").select("event_id", text.alias("j"))


@query(f"SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'inexact' WHEN 3 THEN 'malformed' ELSE 'exact' END AS state FROM ({NESTED})")
def json_states(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators import walks

    return _nested(spark, d).select("event_id", walks.json_state("j").alias("state"))


@query(f"SELECT n.event_id, replace(replace(replace(replace(substr(t.fullkey, 2), '.\"a/b~\"', '/a~1b~0'), '[', '/'), ']', ''), '.', '/') AS path, CASE t.type WHEN 'OBJECT' THEN 'OBJECT' WHEN 'ARRAY' THEN 'ARRAY' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'BOOLEAN' THEN 'BOOLEAN' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE 'BIGINT' END AS kind, CASE WHEN t.type NOT IN ('OBJECT', 'ARRAY') OR t.value::VARCHAR IN ('[]', '{{}}') THEN t.value::VARCHAR END AS leaf FROM ({NESTED}) n, json_tree(n.j::JSON) t WHERE n.event_id % 5 NOT IN (2, 3)")
def json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The paths, kinds and leaves of all nodes of the events' JSON that may be read."""
    from lodestone.operators import walks

    good = _nested(spark, d).filter(walks.json_state("j") == "exact")
    return walks.json_nodes(good, "event_id", "j").select("event_id", "path", "kind", "leaf")


# --- authorization and integrity ----------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents d WHERE source = 'src1' AND doc_id % 7 <> 0 AND (doc_id % 5 <> 1 OR doc_id % 10 = 1) AND doc_id % 11 <> 3 AND (doc_id % 3 = 0 OR EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = d.doc_id % 100 AND 'src' || (c.c_nationkey % 3) = d.source AND c.c_acctbal > 0 AND c.c_mktsegment <> 'BUILDING'))")
def authorised_sources(spark: SparkSession, d: str) -> DataFrame:
    """What a viewer may read: their own parsed, active sources whose lease runs, uploaded or of an account of theirs that is connected and valid."""
    from lodestone.operators import answers

    k = F.col("doc_id")
    lease = F.when((k % 5 == 1) & (k % 10 != 1), "2024-01-01").when(k % 10 == 1, "2026-01-01").cast("timestamp")
    sources = table(spark, d, "documents").select("doc_id", F.col("source").alias("owner"), F.when(k % 11 == 3, "failed").otherwise("parsed").alias("status"), (k % 7 != 0).alias("is_active"), lease.alias("access_expires_at"), F.when(k % 3 != 0, k % 100).alias("account"))
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.concat(F.lit("src"), F.col("c_nationkey") % 3).alias("owner"), F.when(F.col("c_acctbal") > 0, "connected").otherwise("revoked").alias("status"), F.when(F.col("c_mktsegment") != "BUILDING", "valid").otherwise("expired").alias("authentication"))
    return answers.readable(sources, accounts, answers.Viewer("src1", "2025-01-01")).select("doc_id")


@query("WITH b AS (SELECT doc_id, n_chars IS NOT NULL AND length(text) = n_chars + (CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END) AS sized, trim(coalesce(text, '')) <> '' AS filled, doc_id % 13 <> 0 AS fresh FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN NOT filled THEN 'has_content' END, CASE WHEN NOT coalesce(sized, false) THEN 'size' END, CASE WHEN NOT fresh THEN 'stale_fingerprint' END) AS broken FROM b WHERE NOT (filled AND coalesce(sized, false) AND fresh)")
def integrity_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Documents that may not be served, with the rules that they break; a stale fingerprint fails closed."""
    from lodestone.operators import canonical

    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") + F.when(k % 17 == 0, 1).otherwise(0)).alias("size"), F.sha2("text", 256).alias("fingerprint"))
    stored = docs.select("doc_id", F.when(k % 13 == 0, "another").otherwise(F.col("fingerprint")).alias("fingerprint"))
    rules = {"has_content": F.trim("text") != "", "size": F.length("text") == F.col("size")}
    return canonical.served(docs, "doc_id", rules, stored)[1].select("doc_id", F.concat_ws(",", "broken").alias("broken"))


@query("SELECT user_id FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sets(spark, d)
    return a.union(b).distinct()


@query("SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sets(spark, d)
    return a.subtract(b)


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sets(spark, d)
    return a.intersect(b)


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "events").filter("event_type = 'click'").select("user_id"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3")
def having_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).filter("n > 3")


@query("SELECT event_type, list_sort(list(value))[CAST(ceil(0.5 * count(*)) AS BIGINT)] AS p50, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS p95, list_sort(list(value))[CAST(ceil(0.99 * count(*)) AS BIGINT)] AS p99 FROM events GROUP BY 1")
def percentiles_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return relational.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 4) AS mean_chars, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def cross_lang_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_distinct("source").alias("sources"))


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'O') < 3 AS admitted FROM orders GROUP BY 1")
def admission_capacity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("active")).withColumn("admitted", F.col("active") < 3)


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS queued, count(*) FILTER (event_type = 'view') AS unchanged, count(*) FILTER (event_type NOT IN ('click', 'view')) AS removed FROM events GROUP BY 1")
def progress_counters(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(e == "click").alias("queued"), F.count_if(e == "view").alias("unchanged"), F.count_if(~e.isin("click", "view")).alias("removed"))


@query("SELECT count(*) FILTER (NOT (o_totalprice >= 0)) AS negative_price, count(*) FILTER (NOT (o_orderstatus IN ('O', 'F', 'P'))) AS bad_status, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer)) AS orphans FROM orders")
def check_predicates(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    return o.join(c, "o_custkey", "left").agg(F.count_if(~(F.col("o_totalprice") >= 0)).alias("negative_price"), F.count_if(~F.col("o_orderstatus").isin("O", "F", "P")).alias("bad_status"), F.count_if(F.col("known").isNull()).alias("orphans"))


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN (SELECT min(CAST(ts AS DATE)) + 2 FROM events) AND (SELECT min(CAST(ts AS DATE)) + 4 FROM events)")
def date_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return spark.sql("SELECT event_id FROM {e} WHERE to_date(ts) BETWEEN (SELECT date_add(min(to_date(ts)), 2) FROM {e}) AND (SELECT date_add(min(to_date(ts)), 4) FROM {e})", e=e)


@query("SELECT a.c_custkey AS account, b.s_suppkey AS companion FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND a.c_custkey % 10 = b.s_suppkey % 10 WHERE a.c_mktsegment = 'BUILDING'")
def companion_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of one owner with one external id, every pair of them."""
    a = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("account"), F.col("c_nationkey").alias("owner"), (F.col("c_custkey") % 10).alias("external"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("companion"), F.col("s_nationkey").alias("owner"), (F.col("s_suppkey") % 10).alias("external"))
    return a.join(b, ["owner", "external"]).select("account", "companion")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3")
def latest_per_group(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, "place").select("o_custkey", "o_orderkey", big("place").alias("place"))


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice, o_orderkey) < (SELECT (o_totalprice, o_orderkey) FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1 OFFSET 99) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    last = o.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(100).agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("last"))
    return relational.after_key(o.join(F.broadcast(last)), F.struct("o_totalprice", "o_orderkey"), F.col("last"), 50).select("o_orderkey")


# --- windows over reading order -----------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, row_number() OVER (PARTITION BY doc_id, line ORDER BY ordinal) - 1 AS occurrence FROM p")
def block_occurrences(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("doc_id", F.sha2("line", 256)).orderBy("ordinal")
    return passages(spark, d).select("doc_id", big("ordinal").alias("ordinal"), big(F.row_number().over(w) - 1).alias("occurrence"))


@query("WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, n")
def islands(spark: SparkSession, d: str) -> DataFrame:
    return relational.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) > F.expr("INTERVAL 30 MINUTE")).groupBy("user_id", "island").agg(F.min("ts").alias("started"), F.count("*").alias("events")).drop("island")


@query("SELECT user_id, max(gap) AS widest FROM (SELECT user_id, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS gap FROM events) GROUP BY 1")
def widest_gap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.expr("timestampdiff(SECOND, date_trunc('SECOND', before), date_trunc('SECOND', ts))")
    return table(spark, d, "events").withColumn("before", F.lag("ts").over(w)).withColumn("gap", seconds).groupBy("user_id").agg(big(F.max("gap")).alias("widest"))


@query(f"WITH {P}, r AS (SELECT doc_id, ordinal, length(line) AS n, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY ordinal) AS used, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS k FROM p) SELECT doc_id, CAST(max(CASE WHEN used <= 7800 AND k <= 5 THEN ordinal END) + 1 AS BIGINT) AS next_ordinal, count(*) FILTER (used <= 7800 AND k <= 5) AS pieces FROM r GROUP BY doc_id")
def page_read(spark: SparkSession, d: str) -> DataFrame:
    return select.page(passages(spark, d).withColumn("cost", F.length("line")), ["doc_id"], "ordinal", 7800, 5)


#: Lines set in two columns: what the first thirty characters hold, and six blanks further what the next thirty hold.
SET = "rpad(substr(line, 1, 30), 36, ' ') || substr(line, 31, 30)"
PLACED = f"{P}, w AS (SELECT doc_id, ordinal, unnest(string_split({SET}, ' ')) AS word, generate_subscripts(string_split({SET}, ' '), 1) AS i FROM p), x AS (SELECT doc_id, length(word) AS n, sum(length(word) + 1) OVER (PARTITION BY doc_id, ordinal ORDER BY i) - 1 AS x1 FROM w), b AS (SELECT doc_id, x1 - n AS x0, x1 FROM x WHERE n > 0)"


@query(f"WITH {PLACED}, e AS (SELECT doc_id, x, sum(d) AS d FROM (SELECT doc_id, x0 AS x, 1 AS d FROM b UNION ALL SELECT doc_id, x1, -1 FROM b) GROUP BY ALL), s AS (SELECT doc_id, x AS x0, lead(x) OVER o AS x1, sum(d) OVER o AS open FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY x)), g AS (SELECT doc_id, x0, x1 FROM s WHERE open = 0 AND x1 - x0 >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY x1 - x0 DESC, x0) = 1) SELECT g.doc_id, g.x0::BIGINT AS x0, g.x1::BIGINT AS x1, count(*) FILTER (b.x0 < g.x0) AS \"left\", count(*) FILTER (b.x0 >= g.x1) AS \"right\" FROM g JOIN b ON b.doc_id = g.doc_id GROUP BY ALL")
def column_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as pages of two columns, and where their words leave the widest gap."""
    pages = passages(spark, d).select("doc_id", "ordinal", F.expr(SET).alias("line"))
    return layout.column_split(layout.words(pages, "doc_id"), "doc_id")


@query(f"WITH {P}, l AS (SELECT doc_id, ordinal, line, lag(line) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM p), k AS (SELECT doc_id, ordinal, line, sum(CASE WHEN coalesce(length(before) >= 60 AND NOT regexp_matches(before, '[.!?:;]\\s*$') AND regexp_matches(line, '^\\p{{Ll}}'), false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ordinal) AS island FROM l) SELECT doc_id, CAST(min(ordinal) AS BIGINT) AS first, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM k GROUP BY doc_id, island")
def soft_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """Lines joined to paragraphs where they only look wrapped."""
    rows = layout.wrapped(passages(spark, d), "doc_id")
    return rows.groupBy("doc_id", "island").agg(big(F.min("ordinal")).alias("first"), F.count("*").alias("lines"), big(F.sum(F.length("line"))).alias("chars")).drop("island")


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS BIGINT) AS garbled, CAST(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS BIGINT) AS non_ascii FROM documents")
def garbled_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", big(tx.garbled_count(t)).alias("garbled"), big(tx.non_ascii_count(t)).alias("non_ascii"))


@query("SELECT lang, round(sum(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) / sum(length(text)), 6) AS ratio FROM documents GROUP BY lang")
def non_ascii_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.sum(tx.non_ascii_count(F.col("text"))) / F.sum(F.length("text")), 6).alias("ratio"))


POLICY_SQL = "'" + "|".join(policy.ISSUERS.values()).replace("'", "''") + "'"
ASSIGN = "'((?:token|secret|password|api_key)\\s*[=:]\\s*)(\"[^\"<$]+\"|[^\\s\"<$]+)'"


@query(f"SELECT doc_id, sha256(regexp_replace(text, {ASSIGN}, '\\1[REDACTED]', 'g')) AS redacted FROM documents")
def redact_assignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.redact_assignments(F.col("text")), 256).alias("redacted"))


@query(f"SELECT doc_id, regexp_matches(text, {ASSIGN}) AS secret FROM documents")
def secret_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.has_secret(F.col("text")).alias("secret"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, {POLICY_SQL}, '[REDACTED]', 'g')) AS redacted FROM (SELECT doc_id, text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'AKIA' || upper(substr(sha256(doc_id::VARCHAR), 1, 16)) WHEN 1 THEN 'ghp_' || sha256(doc_id::VARCHAR) WHEN 2 THEN 'xoxb-' || sha256(doc_id::VARCHAR) ELSE 'sk_live_' || sha256(doc_id::VARCHAR) END || ' end' AS text FROM documents)")
def secret_free(spark: SparkSession, d: str) -> DataFrame:
    """Credentials by issuer, planted into every document beside those that it holds, and replaced."""
    k = F.sha2(F.col("doc_id").cast("string"), 256)
    planted = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(k, 1, 16)))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("ghp_"), k)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("xoxb-"), k)).otherwise(F.concat(F.lit("sk_live_"), k))
    text = F.concat("text", F.lit(" "), planted, F.lit(" end"))
    return table(spark, d, "documents").select("doc_id", F.sha2(policy.issued_free(text), 256).alias("redacted"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text, '\\d+(?:\\.\\d+)?'), ',') AS numbers FROM documents")
def number_sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", tx.numbers(F.col("text"))).alias("numbers"))


@query("SELECT doc_id, sha256(text) AS sha, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS lock_key FROM documents")
def sha_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), tx.lock_key(F.col("text")).alias("lock_key"))


@query("SELECT doc_id, ('0x' || substr(sha256(text), 1, 4))::BIGINT % 2048 AS bucket FROM documents")
def stable_bucket(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", big(tx.stable_bucket(F.col("text"))).alias("bucket"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages")
def parse_url_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"))


@query("SELECT n_nationkey, '| ' || n_nationkey || ' | ' || replace(n_name, '|', '\\|') || ' |' AS line FROM nation")
def table_render(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", tx.table_row(F.col("n_nationkey"), F.col("n_name")).alias("line"))


@query("SELECT p_partkey, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INT)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INT)) AS letters, n AS back FROM (SELECT p_partkey, p_partkey % 2000 + 1 AS n FROM part)")
def base26_columns(spark: SparkSession, d: str) -> DataFrame:
    """A spreadsheet's column letters for every part, and the number that they stand for."""
    letters = table(spark, d, "part").select("p_partkey", tx.column_letters(F.col("p_partkey") % 2000 + 1).alias("letters"))
    return letters.withColumn("back", tx.column_number(F.col("letters")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 50")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", big(F.get_json_object("props", "$.k")).alias("k")).filter("k < 50")


LOG = """WITH e AS (SELECT *, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp FROM events)
SELECT user_id, day, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) - 1 AS ordinal, stamp, 'e' || event_id AS request, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS lines FROM e"""


@query(LOG)
def log_records(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events of a day written as a log file, a third of them with a second line, and read back record by record."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    line = F.concat(stamp, F.lit(" "), F.col("event_type"), F.lit(" request_id=e"), F.col("event_id"), F.when(F.col("event_id") % 3 == 0, "\n  more").otherwise(""))
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.struct("event_id", line.alias("line")).alias("l"))
    logs = rows.groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    return search.log_records(logs, "text", "user_id", "day").select("user_id", "day", big("ordinal").alias("ordinal"), "stamp", "request", big("lines").alias("lines"))


VTT = r"""WITH t AS (SELECT conv_id, role, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '-->', '', 'g')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)
SELECT conv_id, CAST(i AS BIGINT) AS ordinal, CAST(i * 2 AS DOUBLE) AS starts, i * 2 + 1.5::DOUBLE AS ends, role AS speaker, said FROM t WHERE role IS NOT NULL"""


@query(VTT)
def transcript_cues(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as transcripts, two seconds a turn, and read back cue by cue."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]*>", ""), r"\s+", " "), "-->", "")
    turns = table(spark, d, "conversations").select("conv_id", "role", F.trim(said).alias("said"), (F.row_number().over(w) - 1).alias("i")).filter("role IS NOT NULL")

    def clock(seconds: Column, rest: str) -> Column:
        return F.format_string(f"%02d:%02d:%02d.{rest}", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)

    cue = F.concat(clock(F.col("i") * 2, "000"), F.lit(" --> "), clock(F.col("i") * 2 + 1, "500"), F.lit("\n<v "), F.col("role"), F.lit(">"), F.col("said"))
    texts = turns.select("conv_id", F.struct("i", cue.alias("cue")).alias("c")).groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["cue"]), "\n\n")).alias("text"))
    return search.cues(texts, "text", "conv_id").select("conv_id", big("ordinal").alias("ordinal"), "starts", "ends", "speaker", "said")


# --- headers, addresses, labels, audit, structured queries --------------------------------------------------------------

HEADERS = "array<struct<name:string,value:string>>"


@query("SELECT conv_id, lower(role) AS name, arg_min(text, (turn, text)) AS value FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY ALL")
def first_header_wins(spark: SparkSession, d: str) -> DataFrame:
    """A map whose first entry of a name, whatever its case, wins."""
    c = table(spark, d, "conversations").filter("role IS NOT NULL AND text IS NOT NULL")
    return c.groupBy("conv_id", F.lower("role").alias("name")).agg(F.min_by("text", F.struct("turn", "text")).alias("value"))


@query("SELECT c_custkey, regexp_full_match(a, '[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+') AS valid, lower(regexp_extract(a, '@([^@\\s]+)$', 1)) AS domain FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@Example.org' WHEN 1 THEN c_name WHEN 2 THEN c_name || '@x@y.org' ELSE c_name || '@host' END AS a FROM customer)")
def address_check(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_name")
    a = F.when(k % 4 == 0, F.concat(F.lower(F.replace(n, F.lit("#"), F.lit("."))), F.lit("@Example.org"))).when(k % 4 == 1, n).when(k % 4 == 2, F.concat(n, F.lit("@x@y.org"))).otherwise(F.concat(n, F.lit("@host")))
    return table(spark, d, "customer").select("c_custkey", tx.is_address(a).alias("valid"), tx.address_domain(a).alias("domain"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 120 THEN rtrim(substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 119)) || '…' ELSE regexp_replace(text, '\\s+', ' ', 'g') END AS brief FROM documents WHERE text IS NOT NULL")
def bounded_brief(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.brief(F.col("text"), 120).alias("brief"))


@query("SELECT doc_id, concat_ws(chr(10), 'Project: ' || source, 'Language: ' || lang, CASE WHEN l.doc_id IS NOT NULL THEN 'Quality: ' || quality END) AS prefix FROM documents LEFT JOIN labels l USING (doc_id)")
def labelled_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", tx.labelled(Project=F.col("source"), Language=F.col("lang"), Quality=F.col("quality")).alias("prefix"))


@query("SELECT o_orderkey, o_totalprice, n > 20 AS truncated FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, least(count(*) OVER (), 21) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000) WHERE k <= 20")
def structured_query(spark: SparkSession, d: str) -> DataFrame:
    """Filters and an order over a recorded table; one row more than the limit tells whether the answer is whole."""
    found = select.structured(table(spark, d, "orders"), [("o_orderstatus", "=", "O"), ("o_totalprice", ">=", 1000)], ["-o_totalprice", "o_orderkey"], 20)
    return found.select("o_orderkey", "o_totalprice", "truncated")


@query("WITH q AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000) SELECT o_orderkey, o_totalprice, total > 60 AS truncated, total FROM q WHERE k > 40 AND k <= 60")
def structured_pages(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a structured query, by the cursor of the second, with the number of all rows."""
    rows, tests, order = table(spark, d, "orders"), [("o_orderstatus", "=", "O"), ("o_totalprice", ">=", 1000)], ["-o_totalprice", "o_orderkey"]
    cursor = None
    for _ in range(2):
        last = select.structured(rows, tests, order, 20, after=cursor).orderBy(F.asc("o_totalprice"), F.desc("o_orderkey")).first()
        cursor = [last["o_totalprice"], last["o_orderkey"]]
    return select.structured(rows, tests, order, 20, after=cursor, count=True).select("o_orderkey", "o_totalprice", "truncated", big("total").alias("total"))


@query("SELECT doc_id FROM documents WHERE (lang IN ('de', 'fr') OR source IN ('src1', 'de')) AND n_chars > 100")
def label_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Documents that carry one of the wanted labels at least."""
    held = F.array_compact(F.array("lang", "source"))
    return table(spark, d, "documents").filter(F.arrays_overlap(held, F.array(*map(F.lit, ("de", "fr", "src1")))) & (F.col("n_chars") > 100)).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE false")
def empty_scope(spark: SparkSession, d: str) -> DataFrame:
    """A request without any allowed source reads nothing: the plan is an empty relation."""
    return select.structured(table(spark, d, "orders"), [("o_orderkey", "in", [])], ["o_orderkey"], 20).select("o_orderkey")


@query("SELECT event_type AS action, user_id AS actor, event_id AS target, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE event_type <> 'view'")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """An audit trail grows only: entries of a first batch keep their numbers when a later one is appended."""
    e = table(spark, d, "events").filter("event_type <> 'view'").select(F.col("event_type").alias("action"), F.col("user_id").alias("actor"), F.col("event_id").alias("target"), "ts")
    cut = F.lit("2024-01-01").cast("timestamp_ntz")
    trail = incremental.appended(None, e.filter(F.col("ts") < cut), ["actor"], ["ts", "target"])
    return incremental.appended(trail, e.filter(F.col("ts") >= cut), ["actor"], ["ts", "target"]).select("action", "actor", "target", big("seq").alias("seq"))


@query("SELECT doc_id, source AS project, 'pending' AS status, CAST(0 AS INTEGER) AS attempts FROM documents ANTI JOIN labels USING (doc_id)")
def insert_literals(spark: SparkSession, d: str) -> DataFrame:
    """Jobs for what isn't indexed: a select with literal columns, inserted where no job is."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("project"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"))
    return docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


# --- pages: headings, blocks, sections ----------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title, CAST(len(regexp_extract_all(html, '<h[1-6][ >]')) AS BIGINT) AS headings FROM pages")
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("title"), big(F.size(F.regexp_extract_all("html", F.lit("(<h[1-6][ >])")))).alias("headings"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p[^>]*>[^<]*</p>')) AS BIGINT) AS paragraphs, CAST(length(array_to_string(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1), '')) AS BIGINT) AS chars FROM pages")
def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)</p>"))
    return table(spark, d, "pages").select("page_id", big(F.size(found)).alias("paragraphs"), big(F.length(F.array_join(found, ""))).alias("chars"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """A parser's blocks; no SQL parses HTML."""
    from lodestone.sources import blocks

    return blocks.parsed(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("html").alias("modality"), F.col("html").alias("text")))


HEADS = "h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])', 1)) AS level, generate_subscripts(regexp_extract_all(html, '<h([1-6])', 1), 1) - 1 AS ordinal FROM pages)"


@query(f"WITH {HEADS} SELECT a.page_id, CAST(a.ordinal AS BIGINT) AS ordinal, CAST(max(b.ordinal) AS BIGINT) AS parent FROM h a LEFT JOIN h b ON a.page_id = b.page_id AND b.ordinal < a.ordinal AND CAST(b.level AS INT) < CAST(a.level AS INT) GROUP BY 1, 2")
def section_tree(spark: SparkSession, d: str) -> DataFrame:
    return relational.section_parents(_heads(spark, d), ["page_id"], "ordinal", "level").select("page_id", big("ordinal").alias("ordinal"), big("parent").alias("parent"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])"))).alias("ordinal", "level")).withColumn("level", F.col("level").cast("int"))


@query(f"WITH {HEADS} SELECT page_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(lead(ordinal) OVER (PARTITION BY page_id ORDER BY ordinal) AS BIGINT) AS next FROM h")
def next_edges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("ordinal")
    return _heads(spark, d).select("page_id", big("ordinal").alias("ordinal"), big(F.lead("ordinal").over(w)).alias("next"))


@query(f"WITH {P} SELECT p.doc_id, round(1 - count(DISTINCT line) / count(*), 6) AS duplicate_rate, round(sum(length(regexp_replace(line, '[^\\x{{FFFD}}]', '', 'g'))) / greatest(sum(length(line)), 1), 6) AS garbled, bool_or(l.quality = 0) AS flagged FROM p LEFT JOIN labels l ON l.doc_id = p.doc_id GROUP BY 1")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    bad = F.length(F.regexp_replace("line", r"[^\x{FFFD}]", ""))
    report = passages(spark, d).groupBy("doc_id").agg(F.round(1 - F.count_distinct(F.sha2("line", 256)) / F.count("*"), 6).alias("duplicate_rate"), F.round(F.sum(bad) / F.greatest(F.sum(F.length("line")), F.lit(1)), 6).alias("garbled"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 0).alias("flagged"))
    return report.join(labels, "doc_id", "left")


# --- incremental --------------------------------------------------------------------------------------------------------

OLD = "(SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0)"
NEW = "(SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return old, new


@query(f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM {OLD} o FULL JOIN {NEW} n ON o.doc_id = n.doc_id")
def change_detection(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changes(*_snapshots(spark, d), ["doc_id"], "h")


@query(f"SELECT n.doc_id FROM {NEW} n JOIN {OLD} o ON o.doc_id = n.doc_id AND o.h = n.h")
def unchanged_reuse(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return new.join(old, ["doc_id", "h"], "left_semi").select("doc_id")


@query(f"SELECT doc_id, h FROM {NEW} UNION ALL SELECT doc_id, h FROM {OLD} o WHERE NOT EXISTS (SELECT 1 FROM {NEW} n WHERE n.doc_id = o.doc_id)")
def merge_newer_wins(spark: SparkSession, d: str) -> DataFrame:
    return incremental.newer_wins(*_snapshots(spark, d), ["doc_id"])


@query(f"SELECT doc_id, h FROM {OLD} UNION ALL SELECT doc_id, h FROM {NEW} n WHERE NOT EXISTS (SELECT 1 FROM {OLD} o WHERE n.doc_id = o.doc_id)")
def upsert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return incremental.insert_missing(*_snapshots(spark, d), ["doc_id"])


@query(f"SELECT o.doc_id FROM {OLD} o WHERE NOT EXISTS (SELECT 1 FROM {NEW} n WHERE n.doc_id = o.doc_id)")
def inventory_sweep(spark: SparkSession, d: str) -> DataFrame:
    return incremental.swept(*_snapshots(spark, d), ["doc_id"]).select("doc_id")


@query("WITH s AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)) AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM s)) AS children")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    parents, children = incremental.delete_cascade(o, o.filter("o_orderstatus = 'P'"), ["o_orderkey"], li.withColumnRenamed("l_orderkey", "o_orderkey"))
    return parents.agg(F.count("*").alias("parents")).join(children.agg(F.count("*").alias("children")))


@query("SELECT count(*) AS rows_to_move, count(*) FILTER (c.text IS NOT NULL) AS conflicts FROM (SELECT text FROM documents WHERE source = 'src1') a LEFT JOIN (SELECT DISTINCT text FROM documents WHERE source = 'src0') c ON a.text = c.text")
def guarded_reassign(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"))
    return incremental.reassign_preview(docs, "source", "src1", "src0", "h")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_event_wins(spark: SparkSession, d: str) -> DataFrame:
    return incremental.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("state"), "event_id")


@query("SELECT user_id, count(*) AS pending FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts > e.ts) GROUP BY 1")
def event_drain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    done = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("done"))
    return e.filter("event_type = 'view'").join(done, "user_id", "left").filter("done IS NULL OR done <= ts").groupBy("user_id").agg(F.count("*").alias("pending"))


@query("SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS full FROM events GROUP BY user_id")
def coalesced_jobs(spark: SparkSession, d: str) -> DataFrame:
    return incremental.coalesce_jobs(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase")


@query("SELECT o_orderkey, attempt, least(CAST(pow(2, attempt) AS BIGINT), 3600) AS wait, CASE WHEN attempt >= 8 THEN 'failed' ELSE 'queued' END AS state FROM (SELECT l_orderkey AS o_orderkey, count(*) * 2 AS attempt FROM lineitem GROUP BY 1)")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    """How long each job waits after its attempts, here two for each line of an order, and whether it is tried again."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count("*") * 2).alias("attempt"))
    return a.select("o_orderkey", "attempt", tx.backoff(F.col("attempt")).alias("wait"), F.when(F.col("attempt") >= 8, "failed").otherwise("queued").alias("state"))


@query("SELECT CAST(('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 4))::BIGINT % 64 AS BIGINT) AS bucket, date_trunc('hour', ts) AS hour, count(*) AS hits, count(*) > 20 AS limited FROM events GROUP BY 1, 2")
def keyed_quotas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(big(tx.stable_bucket(F.col("user_id").cast("string"), 64)).alias("bucket"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("hits")).withColumn("limited", F.col("hits") > 20)


# --- streams ------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def event_dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming import jobs

    return jobs.run_once(jobs.deduplicated(jobs.events(spark, d)), "event_dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def rate_window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming import jobs

    out = jobs.run_once(jobs.tumbling(jobs.events(spark, d)), "rate_window")
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, n")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes").alias("s")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).drop("s")


FIRST_HIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS k FROM events WHERE (epoch_us(ts) // 1000) <= (SELECT max((epoch_us(ts) // 1000)) - 3600000 FROM events)),
w AS (SELECT user_id, event_id, event_type, ms, k, ms AS start, 1 AS n FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.event_type, e.ms, e.k, CASE WHEN e.ms >= w.start + {width} THEN e.ms ELSE w.start END, CASE WHEN e.ms >= w.start + {width} THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
"""


@query(FIRST_HIT.format(width=86_400_000) + "SELECT user_id, event_id, n <= 2 AS allowed, CASE WHEN n <= 2 THEN 0 ELSE start + 86400000 - ms END::BIGINT AS wait_ms FROM w")
def first_hit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Rate windows of a day that begin at a user's first hit: two hits pass, the others are told to wait."""
    from lodestone.streaming import jobs, keyed

    return jobs.run_once(keyed.rate_limited(jobs.events(spark, d), 86_400, 2), "first_hit")


@query(FIRST_HIT.format(width=86_400_000) + "SELECT user_id, start AS started_ms, count(*) AS requests, bool_or(event_type = 'purchase') AS full FROM w WHERE start + 86400000 <= (SELECT max((epoch_us(ts) // 1000)) - 3600000 FROM events) GROUP BY user_id, start")
def coalesced_requests(spark: SparkSession, d: str) -> DataFrame:
    """A user's requests within a day of the first one become one job; a purchase among them makes it a full one."""
    from lodestone.streaming import jobs, keyed

    return jobs.run_once(keyed.coalesced(jobs.events(spark, d), 86_400, "event_type = 'purchase'"), "coalesced")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def exactly_once_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, upserted batch by batch from the stream into a versioned table; then all batches once more by a stream that has
    lost its checkpoint, which changes nothing."""
    from lodestone.operators.manifest import KeyedTable, upsert_stream
    from lodestone.streaming import jobs

    table_ = KeyedTable.create(spark, storage.fresh_path(spark, "user-states"), "user_id long, state string, ts timestamp, event_id long", ["user_id"], buckets=8)
    stream = jobs.events(spark, d).select("user_id", F.col("event_type").alias("state"), F.col("at").alias("ts"), "event_id")
    for _ in range(2):
        upsert_stream(stream, table_, ["ts", "event_id"], "events", storage.fresh_path(spark, "user-states-checkpoint"), newer=True).awaitTermination()
    return table_.read().drop("ts")


# --- extensions that Spark adds -----------------------------------------------------------------------------------------


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts > p.ts")
def asof_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return relational.asof(e.filter("event_type = 'purchase'"), e.filter("event_type = 'view'"), ["user_id"], "ts", "event_id").select("event_id", "before")
