"""The registry that the query modules fill, the frames they share, and the same frames as SQL.

The tables hold no business records, so linkage records are derived from two of them. ``documents``: tokens 1-6 are the name, all
tokens from the seventh on the address (so every token of a text belongs to its record), the language is the country, and the
id modulo 3 gives the source; equal texts serve as gold. ``part``: the part's name is the name, and size, type, brand and price
make an address of a few words with numbers; the fuzzy features of short fields run over these.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import candidates as C
from ..session import ensure_importable, materialise, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its SQL equivalent, where there is one."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def linkage_records(spark: SparkSession, sf_dir: str, often: bool = False) -> DataFrame:
    """Records of ``documents``; where they are read ``often`` and have to be dealt out, that is done once and written."""
    whole = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs = spread(whole, "doc_id")
    if often and docs is not whole:
        docs = materialise(docs, "dealt-documents")
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " "), lambda t: t != "")
    source = (1 + F.col("doc_id") % 3).cast("int")
    return docs.withColumn("t", tokens).select(
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        source.alias("source"),
        F.coalesce("lang", F.lit("")).alias("country"),
        F.array_join(F.slice("t", 1, 6), " ").alias("name"),
        F.array_join(F.slice("t", 7, 1 << 30), " ").alias("address"),
        "text",
    )


def catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``part``; names and addresses as written, with capitals and punctuation."""
    source = (1 + F.col("p_partkey") % 3).cast("int")
    cents = F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        source.alias("source"),
        F.lit("").alias("country"),
        F.initcap("p_name").alias("name"),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit(" Rd. "), F.col("p_brand"), F.lit(", No "), cents).alias("address"),
    )


def catalogue_pairs(records: DataFrame) -> DataFrame:
    """Candidates that share rare numbers, the best ten of each source, with their score."""
    return C.rare_digits(records, k=10).select("s1_id", "t_id", "score")


def lowered(records: DataFrame) -> DataFrame:
    """Records whose name and address are lower-cased words and numbers."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{N}]+", " "))
    return records.withColumns({"name": plain("name"), "address": plain("address")})


def gold(records: DataFrame) -> DataFrame:
    """(s1_id, t_id) with equal texts; a target belongs to one query, the one with the smallest id, so links grow with the records."""
    h = F.md5(F.col("text").cast("binary"))
    some = records.where(F.length("text") > 0)
    s = some.where(F.col("source") == 1).groupBy(h.alias("h")).agg(F.min("entity_id").alias("s1_id"))
    t = some.where(F.col("source") > 1).select(F.col("entity_id").alias("t_id"), h.alias("h"))
    return s.join(t, "h").select("s1_id", "t_id")


def entities(records: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(s1_id, truth_len) of all queries; ``links`` is ``gold`` where it is at hand."""
    n = (gold(records) if links is None else links).groupBy("s1_id").agg(F.count("*").alias("truth_len"))
    q = records.where(F.col("source") == 1).select(F.col("entity_id").alias("s1_id"))
    return q.join(n, "s1_id", "left").withColumn("truth_len", F.coalesce("truth_len", F.lit(0)).cast("long"))


def scored_pairs(records: DataFrame) -> DataFrame:
    """Rare-token candidates with the Jaccard similarity of their names as score, and the gold label."""
    pairs = C.rare_names(records).select("s1_id", "t_id")
    names = records.select("entity_id", F.array_distinct(T.words(F.col("name"))).alias("w"))
    p = pairs.join(names.select(F.col("entity_id").alias("s1_id"), F.col("w").alias("a")), "s1_id").join(names.select(F.col("entity_id").alias("t_id"), F.col("w").alias("b")), "t_id")
    labelled = p.join(gold(records).withColumn("label", F.lit(1)), ["s1_id", "t_id"], "left")
    return labelled.select("s1_id", "t_id", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("score"), F.coalesce("label", F.lit(0)).alias("label"))


def filter_list(records: DataFrame) -> DataFrame:
    """Scored pairs as a filter's output: filter_score, filter_rank (from 0), label."""
    from ..operators.lists import ranked

    return ranked(scored_pairs(records).withColumnRenamed("score", "filter_score"), "filter_score", "filter_rank")


ROUTE_NAMES = [*C.ROUTES, "rare_digits"]


def query_routes(records: DataFrame) -> DataFrame:
    """The six default routes and the digits of the whole text, each with its top 100 (exact names: all)."""
    return C.all_routes(records, {**C.ROUTES, "rare_digits": lambda r: C.rare_digits(r, "text", rank=False)})


def fused_query_routes(records: DataFrame, evidence: bool = False) -> DataFrame:
    """``query_routes`` fused. Names and addresses are written once, without texts: the digits alone read the texts."""
    short = materialise(records.drop("text"), "records")
    return C.fused_routes(short, {**C.ROUTES, "rare_digits": lambda _: C.rare_digits(records, "text", rank=False)}, evidence=evidence)


def dense_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every embedding is a query and a target; the label is the place."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("place"), F.col("embedding").alias("vector"))
    return e.withColumnRenamed("vec_id", "s1_id"), e.withColumnRenamed("vec_id", "t_id")


# ---- the same frames in SQL ----

R_SQL = r"""
tok AS (
  SELECT doc_id, coalesce(lang, '') AS country, text,
         list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS t
  FROM documents
), r AS (
  SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, CAST(1 + doc_id % 3 AS INTEGER) AS source, country,
         array_to_string(t[1:6], ' ') AS name, array_to_string(t[7:], ' ') AS address, text
  FROM tok
), q AS (SELECT * FROM r WHERE source = 1), g AS (SELECT * FROM r WHERE source > 1)
"""

GOLD_SQL = """
gold AS (SELECT o.s1_id, g.entity_id AS t_id FROM (SELECT md5(text) AS h, min(entity_id) AS s1_id FROM q WHERE text <> '' GROUP BY 1) o JOIN g ON o.h = md5(g.text) WHERE g.text <> ''),
ent AS (
  SELECT q.entity_id AS s1_id, CAST(count(gold.t_id) AS BIGINT) AS truth_len FROM q LEFT JOIN gold ON gold.s1_id = q.entity_id GROUP BY 1
)
"""


CATALOGUE_SQL = r"""
part_r AS (
  SELECT 'S' || (1 + p_partkey % 3) || '-' || p_partkey AS entity_id, CAST(1 + p_partkey % 3 AS INTEGER) AS source, '' AS country,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name,
         p_size || ' ' || p_type || ' Rd. ' || p_brand || ', No ' || CAST(round(p_retailprice * 100) AS BIGINT) AS address
  FROM part
), r AS (SELECT * FROM part_r), q AS (SELECT * FROM r WHERE source = 1), g AS (SELECT * FROM r WHERE source > 1),
low AS (SELECT entity_id, source, country, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS name, trim(regexp_replace(lower(address), '[^\p{L}\p{N}]+', ' ', 'g')) AS address FROM r)
"""


def rare_sql(prefix: str, tokens: str, k: int = 100) -> str:
    """CTEs of the rare-token route over a token expression; the result is ``{prefix}_top`` (s1_id, t_id, source, score, rank)."""
    return f"""
{prefix}_t AS (SELECT source, country, entity_id AS t_id, unnest(list_distinct({tokens})) AS token FROM g),
{prefix}_df AS (SELECT source, country, token, count(*) AS df FROM {prefix}_t GROUP BY ALL HAVING count(*) <= 128),
{prefix}_q AS (SELECT country, entity_id AS s1_id, unnest(list_distinct({tokens})) AS token FROM q),
{prefix}_pick AS (
  SELECT * FROM (SELECT s1_id, source, country, token, df, row_number() OVER (PARTITION BY s1_id, source ORDER BY df, token) AS n FROM {prefix}_q JOIN {prefix}_df USING (country, token)) WHERE n <= 2
),
{prefix}_score AS (
  SELECT s1_id, t_id, source, round(sum(1 / log2(2 + df)), 9) AS score FROM {prefix}_pick JOIN {prefix}_t USING (source, country, token) GROUP BY ALL
),
{prefix}_top AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, t_id) AS INTEGER) AS rank FROM {prefix}_score) WHERE rank <= {k}
)
"""


NAME_TOKENS = "list_filter(string_split(name, ' '), lambda x: length(x) >= 2)"
ADDRESS_DIGITS = r"list_filter(regexp_extract_all(address, '\p{Nd}+'), lambda x: length(x) >= 2)"
PAIRS_SQL = CATALOGUE_SQL + "," + rare_sql("digit", ADDRESS_DIGITS, 10) + ", scored AS (SELECT s1_id, t_id, score FROM digit_top)"
TEXT_DIGITS = r"list_filter(regexp_extract_all(coalesce(text, ''), '\p{Nd}+'), lambda x: length(x) >= 2)"

SCORED_SQL = (
    R_SQL
    + ","
    + GOLD_SQL
    + ","
    + rare_sql("rare", NAME_TOKENS)
    + """,
scored AS (
  SELECT p.s1_id, p.t_id,
         round(len(list_intersect(list_distinct(list_filter(string_split(a.name, ' '), lambda x: x <> '')), list_distinct(list_filter(string_split(b.name, ' '), lambda x: x <> ''))))::DOUBLE
           / len(list_distinct(list_filter(list_concat(string_split(a.name, ' '), string_split(b.name, ' ')), lambda x: x <> ''))), 6) AS score,
         CASE WHEN gold.t_id IS NULL THEN 0 ELSE 1 END AS label
  FROM rare_top p JOIN r a ON a.entity_id = p.s1_id JOIN r b ON b.entity_id = p.t_id LEFT JOIN gold ON gold.s1_id = p.s1_id AND gold.t_id = p.t_id
),
listed AS (
  SELECT s1_id, t_id, score AS filter_score, label, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, t_id) - 1 AS INTEGER) AS filter_rank FROM scored
)
"""
)

KEY_SQL = """
exact_top AS (
  SELECT q.entity_id AS s1_id, g.entity_id AS t_id, g.source, 1.0::DOUBLE AS score,
         CAST(row_number() OVER (PARTITION BY q.entity_id, g.source ORDER BY g.entity_id) AS INTEGER) AS rank
  FROM q JOIN g ON q.country = g.country AND q.name = g.name WHERE q.name <> ''
),
cut AS (
  SELECT entity_id, source, country, regexp_replace(name, '(\\S)(?: (?:corp|corporation|pvt|private|ltd|limited)){1,2}$', '\\1') AS name FROM r
),
suffix_top AS (
  SELECT a.entity_id AS s1_id, b.entity_id AS t_id, b.source, 1.0::DOUBLE AS score,
         CAST(row_number() OVER (PARTITION BY a.entity_id, b.source ORDER BY b.entity_id) AS INTEGER) AS rank
  FROM cut a JOIN cut b ON a.source = 1 AND b.source > 1 AND a.country = b.country AND a.name = b.name WHERE a.name <> ''
)
""".replace("\\\\", "\\")

def grams_sql(field: str) -> str:
    """Character 3- and 4-grams of a column, with repeats."""
    part = "list_transform(generate_series(1, length({0}) - {2}), lambda i: substr({0}, i, {1}))"
    return f"list_concat({part.format(field, 3, 2)}, {part.format(field, 4, 3)})"


_WORDS = r"regexp_extract_all(name, '[\p{L}\p{N}_]+')"
WORD_GRAMS = f"list_concat({_WORDS}, list_transform(generate_series(1, len({_WORDS}) - 1), lambda i: ({_WORDS})[i] || ' ' || ({_WORDS})[i + 1]))"


def tfidf_sql(prefix: str, grams: str, max_df: float | None, k: int = 100) -> str:
    """CTEs of the TF-IDF route over a list expression of grams with repeats; the result is ``{prefix}_top`` (s1_id, t_id, source, score, rank)."""
    p = prefix
    cap = "" if max_df is None else f" WHERE df <= greatest(2.0, n * {max_df}::DOUBLE)"
    return f"""
{p}_tt AS (SELECT source, country, entity_id AS id, gram, 1 + ln(count(*)) AS tf FROM (SELECT source, country, entity_id, unnest({grams}) AS gram FROM g) GROUP BY ALL),
{p}_tq AS (SELECT country, entity_id AS id, gram, 1 + ln(count(*)) AS tf FROM (SELECT country, entity_id, unnest({grams}) AS gram FROM q) GROUP BY ALL),
{p}_sz AS (SELECT source, country, count(*) AS n FROM g GROUP BY ALL),
{p}_idf AS (
  SELECT source, country, gram, ln((1.0 + n) / (1.0 + df)) + 1 AS idf
  FROM (SELECT source, country, gram, count(*) AS df FROM {p}_tt GROUP BY ALL) JOIN {p}_sz USING (source, country){cap}
),
{p}_wt AS (SELECT source, country, id, gram, tf * idf AS w FROM {p}_tt JOIN {p}_idf USING (source, country, gram)),
{p}_wq AS (SELECT source, country, id, gram, tf * idf AS w FROM {p}_tq JOIN {p}_idf USING (country, gram)),
{p}_nt AS (SELECT source, country, id, sqrt(sum(w * w)) AS norm FROM {p}_wt GROUP BY ALL),
{p}_nq AS (SELECT source, country, id, sqrt(sum(w * w)) AS norm FROM {p}_wq GROUP BY ALL),
{p}_dots AS (SELECT source, country, a.id AS s1_id, b.id AS t_id, sum(a.w * b.w) AS dot FROM {p}_wq a JOIN {p}_wt b USING (source, country, gram) GROUP BY ALL),
{p}_sc AS (
  SELECT s1_id, t_id, d.source, round(dot / (nt.norm * nq.norm), 6) AS score FROM {p}_dots d
  JOIN {p}_nt nt ON nt.source = d.source AND nt.country = d.country AND nt.id = t_id JOIN {p}_nq nq ON nq.source = d.source AND nq.country = d.country AND nq.id = s1_id
),
{p}_top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id, source ORDER BY score DESC, t_id) AS INTEGER) AS rank FROM {p}_sc) WHERE rank <= {k})
"""


ROUTES_SQL = (
    ",".join(
        [
            R_SQL,
            GOLD_SQL,
            KEY_SQL,
            rare_sql("rare", NAME_TOKENS),
            rare_sql("digit", TEXT_DIGITS),
            tfidf_sql("name_char", grams_sql("name"), 0.01),
            tfidf_sql("name_word", WORD_GRAMS, 0.1),
            tfidf_sql("address_char", grams_sql("address"), 0.01),
        ]
    )
    + """,
routes AS (
  SELECT *, 'exact_name' AS route, 1 AS bit FROM exact_top UNION ALL SELECT *, 'suffix_exact', 2 FROM suffix_top UNION ALL SELECT *, 'rare_name', 4 FROM rare_top
  UNION ALL SELECT *, 'name_char', 8 FROM name_char_top UNION ALL SELECT *, 'name_word', 16 FROM name_word_top UNION ALL SELECT *, 'address_char', 32 FROM address_char_top
  UNION ALL SELECT *, 'rare_digits', 64 FROM digit_top
),
placed AS (SELECT *, row_number() OVER (PARTITION BY s1_id, route ORDER BY score DESC, t_id) AS position FROM routes),
sums AS (
  SELECT s1_id, t_id, CAST(bit_or(bit) AS BIGINT) AS route_bits, CAST(count(DISTINCT route) AS BIGINT) AS n_routes, round(sum(1.0::DOUBLE / (60 + position)), 9) AS rrf FROM placed GROUP BY ALL
),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY rrf DESC, t_id) - 1 AS INTEGER) AS rrf_rank FROM sums)
"""
)

DENSE_SQL = """
dv AS (SELECT vec_id, label AS place, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ds AS (SELECT a.vec_id AS s1_id, b.vec_id AS t_id, round(list_cosine_similarity(a.v, b.v), 6) AS dense_score FROM dv a JOIN dv b USING (place)),
dense AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY dense_score DESC, t_id) - 1 AS INTEGER) AS dense_rank FROM ds) WHERE dense_rank < 50
)
"""
