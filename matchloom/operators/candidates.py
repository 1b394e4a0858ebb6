"""Candidate routes: equi-joins, rare tokens, TF-IDF and dense neighbours, all within (source, country).

Records are frames with entity_id, source (1 queries, 2 and 3 targets), country, name, address. A route returns
(s1_id, t_id, source, score, rank): rank from 1 within (s1_id, source), ordered by descending score, then id.

Every route is an equi-join on a key with partial aggregation on both sides of its exchange and a top-k window that Spark
pushes below the exchange. Frequent keys are dropped by the document-frequency rule of the route, before the join.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grams as G
from ..functions.text import address_digits, name_tokens, strip_legal_suffix
from ..session import materialise

PLACE = ["source", "country"]
_CELLS = 1 << 21
# Candidates that are fused together.
_LISTED = 1 << 17
# Vocabularies of character grams up to so many rows are broadcast; beyond, grams are joined.
_VOCABULARY = 4_000_000
# Records in a block of the whole comparison, and the share of a place's records from which a gram is a column of a matrix.
_ROWS = 2048
_FREQUENT = 0.035


def queries_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("source") == 1)


def targets_of(records: DataFrame) -> DataFrame:
    return records.where(F.col("source") > 1)


def top_k(scored: DataFrame, k: int | None, rank: bool = True) -> DataFrame:
    """Ranks from 1 within (s1_id, source) by (-score, t_id); the first ``k`` stay. Without ``rank`` all rows, with ``k`` beside them."""
    if not rank:
        return scored.select("s1_id", "t_id", "source", "score", F.lit(k).cast("int").alias("k"))
    by = Window.partitionBy("s1_id", "source").orderBy(F.col("score").desc_nulls_last(), "t_id")
    ranked = scored.withColumn("rank", F.row_number().over(by))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("s1_id", "t_id", "source", "score", "rank")


def key_route(records: DataFrame, key: Column, k: int | None = None, rank: bool = True) -> DataFrame:
    """Equal non-empty keys; all duplicates count, with score 1.

    As all scores are equal, the first ``k`` targets of a key by id are the first ``k`` of each of its queries: they are cut
    before the join, so a key that a third of all records share costs ``k`` rows a query. Without ``k`` every pair is a row;
    ``key_classes`` holds the same links in one row a record.
    """
    q = queries_of(records).select(F.col("entity_id").alias("s1_id"), F.col("country").alias("c"), key.alias("k1")).where(F.col("k1") != "")
    t = targets_of(records).select(F.col("entity_id").alias("t_id"), "source", "country", key.alias("k2")).where(F.col("k2") != "")
    if k is not None:
        t = t.withColumn("place", F.row_number().over(Window.partitionBy("source", "country", "k2").orderBy("t_id"))).where(F.col("place") <= k)
    pairs = q.join(t, (F.col("c") == F.col("country")) & (F.col("k1") == F.col("k2")))
    return top_k(pairs.select("s1_id", "t_id", "source", F.lit(1.0).alias("score")), k, rank)


def key_classes(records: DataFrame, key: Column) -> DataFrame:
    """(entity_id, class_id, n_links) of every record with a key: the class's smallest id, and how many records of the other side share the key.

    The links of ``key_route`` as a table that grows with the records and not with the square of a class: a query and a target
    link if they have the same class. Counts are summed on both sides of the exchange and joined back, where adaptive execution
    can split a key with many records.
    """
    rows = records.select("entity_id", (F.col("source") == 1).alias("asks"), "country", key.alias("k")).where(F.col("k") != "")
    n = lambda c: F.sum(c.cast("long"))
    classes = rows.groupBy("country", "k").agg(F.min("entity_id").alias("class_id"), n(F.col("asks")).alias("asking"), n(~F.col("asks")).alias("asked"))
    linked = rows.join(classes, ["country", "k"])
    return linked.select("entity_id", "class_id", F.when(F.col("asks"), F.col("asked")).otherwise(F.col("asking")).alias("n_links"))


def exact_name(records: DataFrame, k: int | None = None, rank: bool = True) -> DataFrame:
    return key_route(records, F.col("name"), k, rank)


def suffix_exact(records: DataFrame, k: int | None = None, rank: bool = True) -> DataFrame:
    return key_route(records, strip_legal_suffix(F.col("name")), k, rank)


def rare_token_route(records: DataFrame, tokens: Column, max_df: int = 128, max_query_tokens: int = 2, k: int = 100, rank: bool = True) -> DataFrame:
    """Inverted index over tokens in at most ``max_df`` targets of the place; a query uses its rarest few of them."""
    t = targets_of(records).select("source", "country", F.col("entity_id").alias("t_id"), F.explode(tokens).alias("token"))
    df = t.groupBy("source", "country", "token").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    q = queries_of(records).select(F.col("entity_id").alias("s1_id"), "country", F.explode(tokens).alias("token"))
    rarest = Window.partitionBy("s1_id", "source").orderBy("df", "token")
    chosen = q.join(df, ["country", "token"]).withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= max_query_tokens)
    hits = chosen.join(t, ["source", "country", "token"])
    scored = hits.groupBy("s1_id", "t_id", "source").agg(F.sum(1 / F.log2(2 + F.col("df"))).alias("score"))
    return top_k(scored.withColumn("score", F.round("score", 9)), k, rank)


def rare_names(records: DataFrame, **options) -> DataFrame:
    return rare_token_route(records, name_tokens(F.col("name")), **options)


def rare_digits(records: DataFrame, text: str = "address", **options) -> DataFrame:
    return rare_token_route(records, address_digits(F.col(text)), **options)


def char_grams(text: Column, low: int = 3, high: int = 4) -> Column:
    """Character n-grams over the whole string, blanks included, with repeats; one pass a length, whatever the string's length.

    The second half of a surrogate pair starts no gram.
    """
    return F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)])


def word_grams(text: Column) -> Column:
    """Words and pairs of neighbouring words."""
    w = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def tfidf_route(records: DataFrame, grams: Column, max_df: float = 0.01, least_cap: int = 2, k: int | None = 100, block: int = 1 << 21, rank: bool = True) -> DataFrame:
    """Cosine of TF-IDF vectors fitted on the targets of each place.

    tf is 1 + ln(count), idf is ln((1 + n) / (1 + df)) + 1; grams in more than ``max_df`` of the targets are dropped on both sides before
    the norms (the cap is at least ``least_cap``, so that small places keep some grams).

    Grams above the cap are few whatever the number of records (a place has at most the grams of a record over ``max_df`` of them), so
    they are broadcast and dropped where a record is read; only rare grams are moved. Each record's vector becomes one row, and
    vectors meet as blocks of about ``block`` entries (see ``_sparse_top``), so pairs are never rows before they are among the best ``k`` of a block.
    """
    t = targets_of(records).select(*PLACE, F.col("entity_id").alias("id"), grams.alias("grams"))
    q = queries_of(records).select("country", F.col("entity_id").alias("id"), grams.alias("grams"))
    size = targets_of(records).groupBy(*PLACE).agg(F.count("*").alias("n"))
    # The outer form of explode: the plain one makes Catalyst compute the grams a second time, to filter empty arrays.
    gram = F.explode_outer("grams").alias("gram")
    once = t.select(*PLACE, F.explode_outer(F.array_distinct("grams")).alias("gram"))
    twice = materialise(targets_of(records).groupBy(*PLACE, F.col("entity_id").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n"), "tfidf-repeated")
    if not twice.isEmpty():
        # Records with the same id are one record.
        same = [t[c].eqNullSafe(twice[c]) for c in (*PLACE, "id")]
        once = t.join(twice, same, "left_anti").select(*PLACE, F.explode_outer(F.array_distinct("grams")).alias("gram"))
        once = once.unionByName(t.join(twice, same, "left_semi").select(*PLACE, "id", gram).distinct().select(*PLACE, "gram"))
    df = once.where(F.col("gram").isNotNull()).groupBy(*PLACE, "gram").agg(F.count("*").alias("df")).join(size, PLACE)
    idf = (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf")
    often = F.col("df") > F.greatest(F.lit(least_cap).cast("double"), F.col("n") * max_df)
    # Written out, so that a gram's number is the same wherever it is read.
    known = materialise(df.select(*PLACE, "gram", F.monotonically_increasing_id().alias("gid"), idf, often.alias("often")), "tfidf-grams")
    places = known.select(*PLACE).distinct().groupBy("country").agg(F.count("*").alias("sources"))
    common = known.where("often").select(*PLACE, "gram")
    everywhere = common.groupBy("country", "gram").agg(F.count("*").alias("n")).join(places, "country").where(F.col("n") == F.col("sources")).select("country", "gram")
    if common.count() <= 1_000_000:
        common, everywhere = F.broadcast(common), F.broadcast(everywhere)
    rare = known.where(~F.col("often")).select(*PLACE, "gram", "gid", "idf")
    tf = (1 + F.log(F.count("*"))).alias("tf")

    def vectors(rows: DataFrame, keys: list[str], drop: DataFrame, label: str) -> DataFrame:
        counted = rows.select(*keys, "id", gram).where(F.col("gram").isNotNull()).join(drop, [*keys, "gram"], "left_anti").groupBy(*keys, "id", "gram").agg(tf)
        entry = F.struct("gid", (F.col("tf") * F.col("idf")).alias("w"))
        rows = counted.join(rare, [*keys, "gram"]).groupBy(*PLACE, "id").agg(F.array_sort(F.collect_list(entry)).alias("v"))
        return materialise(rows.select(*PLACE, "id", F.col("v.gid").alias("gids"), F.col("v.w").alias("ws")), label)

    return top_k(_sparse_top(vectors(q, ["country"], everywhere, "tfidf-queries"), vectors(t, PLACE, common, "tfidf-targets"), k, block), k, rank)


def _sparse_top(queries: DataFrame, targets: DataFrame, k: int | None, block: int) -> DataFrame:
    """(s1_id, t_id, source, score): cosine, to six digits, of each query with its best ``k`` targets of each block, of those that share an entry.

    Rows are (source, country, id, gids, ws). Both sides of a place are cut by a digest of the id into blocks of a third of its entries, at most
    ``block``; each two blocks meet in one task. A task multiplies some queries at a time with the block's inverted lists.
    """
    least = min(block, 1 << 14)
    blocks = lambda df, name: df.groupBy(*PLACE).agg(F.ceil(F.sum(F.size("gids")) / F.greatest(F.lit(least), F.least(F.lit(block), F.sum(F.size("gids")) / 3))).cast("int").alias(name))
    sizes = materialise(blocks(targets, "t_blocks").join(blocks(queries, "q_blocks"), PLACE), "tfidf-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = queries.join(sizes, PLACE).select(*PLACE, own("q_blocks").alias("q_block"), every("t_blocks").alias("t_block"), "id", "gids", "ws")
    t = targets.join(sizes, PLACE).select(*PLACE, every("q_blocks").alias("q_block"), own("t_blocks").alias("t_block"), "id", "gids", "ws")
    kind = dict(queries.dtypes)["id"], dict(targets.dtypes)["id"], dict(targets.dtypes)["source"]

    def entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, gram and weight of each entry, and each row's norm."""
        lists = rows.column("gids").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        weights = rows.column("ws").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return row, lists.flatten().to_numpy(zero_copy_only=False), weights, np.sqrt(np.bincount(row, weights * weights, minlength=len(sizes)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right.column("id")))  # rows in the order of ids, which settles ties
            q_row, q_gid, q_w, q_norm = entries(left)
            t_row, t_gid, t_w, t_norm = entries(right)
            by = np.argsort(t_gid, kind="stable")
            t_row, t_gid, t_w = t_row[by], t_gid[by], t_w[by]
            low, high = np.searchsorted(t_gid, q_gid, "left"), np.searchsorted(t_gid, q_gid, "right")
            n, width = left.num_rows, right.num_rows
            entry_at = np.searchsorted(q_row, np.arange(n + 1))
            work = np.r_[0, np.cumsum(high - low)][entry_at]
            start = 0
            while start < n:
                stop = min(start + max(1, _CELLS // width), max(start + 1, int(np.searchsorted(work, work[start] + _CELLS, "right")) - 1), n)
                a, b = entry_at[start], entry_at[stop]
                times = high[a:b] - low[a:b]
                span = np.repeat(np.arange(a, b), times)
                at = low[span] + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)
                dots = np.bincount((q_row[span] - start) * width + t_row[at], q_w[span] * t_w[at], minlength=(stop - start) * width)
                hit = np.flatnonzero(dots)
                q_at, t_at = hit // width + start, hit % width
                score = np.floor(dots[hit] / (t_norm[t_at] * q_norm[q_at]) * 1e6 + 0.5) / 1e6
                edges = np.searchsorted(q_at, np.arange(start, stop + 1))
                if k is not None and (np.diff(edges) > k).any():
                    kept = np.ones(len(hit), dtype=bool)
                    for i in np.flatnonzero(np.diff(edges) > k).tolist():
                        own = score[edges[i] : edges[i + 1]]
                        last = np.partition(own, len(own) - k)[len(own) - k]
                        stays = own > last
                        stays[np.flatnonzero(own == last)[: k - int(stays.sum())]] = True
                        kept[edges[i] : edges[i + 1]] = stays
                    q_at, t_at, score = q_at[kept], t_at[kept], score[kept]
                found.append((q_at, t_at, score))
                start = stop
        q_at, t_at, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        place = right if right.num_rows else left
        source = np.full(len(score), place.column("source")[0].as_py(), dtype=np.int64)
        columns = [left.column("id").take(pa.array(q_at)), right.column("id").take(pa.array(t_at)), pa.array(source).cast(place.schema.field("source").type), pa.array(score)]
        return pa.table(columns, ["s1_id", "t_id", "source", "score"])

    met = [*PLACE, "q_block", "t_block"]
    return q.groupBy(*met).cogroup(t.groupBy(*met)).applyInArrow(search, f"s1_id {kind[0]}, t_id {kind[1]}, source {kind[2]}, score double")


def _texts(records: DataFrame, text: str) -> DataFrame:
    """(source, country, id, texts): a record's text, or all texts of the records that share an id in a place."""
    rows = records.where(F.col("country").isNotNull()).select(*PLACE, F.col("entity_id").alias("id"), F.array(text).alias("texts"))
    twice = materialise(rows.groupBy(*PLACE, "id").agg(F.count("*").alias("n")).where(F.col("n") > 1).drop("n"), "tfidf-repeated")
    if twice.isEmpty():
        return rows
    key = [*PLACE, "id"]
    same = rows.join(twice, key, "left_semi").groupBy(*key).agg(F.flatten(F.collect_list("texts")).alias("texts"))
    return rows.join(twice, key, "left_anti").select(*PLACE, "id", "texts").unionByName(same)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``_texts`` in groups of bounded size and one place, with their grams (see ``grams.count``)."""
    for batch in batches:
        for source, country in sorted(set(zip(*(batch.column(c).to_pylist() for c in PLACE)))):
            part = batch.filter(pc.and_(pc.equal(batch.column("source"), source), pc.equal(batch.column("country"), country)))
            texts = part.column("texts")
            sizes = texts.value_lengths().to_numpy()
            whole = ["".join(x or "" for x in t) if n > 1 else t[0] or "" for t, n in zip(texts.to_pylist(), sizes.tolist())]
            for start, stop in G.groups(whole):
                rows = part.slice(start, stop - start)
                flat = [x for t in rows.column("texts").to_pylist() for x in t]
                yield rows, *G.count(flat, np.repeat(np.arange(stop - start), sizes[start:stop]))


def _vocabulary(rows: DataFrame, records: DataFrame, max_df: float | None, least_cap: int) -> DataFrame:
    """(source, country, gram, df, idf) of the targets' grams, without those above the cap; ``max_df`` None: all."""
    kind = dict(rows.dtypes)["source"]

    def frequencies(batches):
        for part, words, _, gram, _ in _counted(batches):
            df = np.bincount(gram, minlength=len(words))
            place = [pa.repeat(part.column(c)[0], len(words)) for c in PLACE]
            yield pa.RecordBatch.from_arrays([*place, pa.array(words, pa.string()), pa.array(df, pa.int64())], [*PLACE, "gram", "df"])

    found = rows.where(F.col("source") > 1).mapInArrow(frequencies, f"source {kind}, country string, gram string, df long")
    size = targets_of(records).groupBy(*PLACE).agg(F.count("*").alias("n"))
    df = found.groupBy(*PLACE, "gram").agg(F.sum("df").alias("df")).join(size, PLACE)
    if max_df is not None:
        df = df.where(F.col("df") <= F.greatest(F.lit(least_cap).cast("double"), F.col("n") * max_df))
    return materialise(df.select(*PLACE, "gram", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf")), "tfidf-grams")


def char_tfidf_route(records: DataFrame, text: str, max_df: float = 0.01, least_cap: int = 2, k: int | None = 100, block: int = 1 << 21, rank: bool = True) -> DataFrame:
    """``tfidf_route`` over the ``char_grams`` of a column, with grams counted in numpy: a gram is a row once a batch and place, not once a record.

    The vocabulary below the cap is broadcast; one of more than ``_VOCABULARY`` rows is joined by ``tfidf_route``.
    """
    spark = records.sparkSession
    rows = _texts(records, text)
    known = _vocabulary(rows, records, max_df, least_cap)
    if known.count() > _VOCABULARY:
        return tfidf_route(records, char_grams(F.col(text)), max_df, least_cap, k, block, rank)
    table = known.toArrow()
    of_country: dict[str, dict[int, dict[str, tuple[int, float]]]] = {}
    for i, (source, country, gram, idf) in enumerate(zip(*(table.column(c).to_pylist() for c in (*PLACE, "gram", "idf")))):
        of_country.setdefault(country, {}).setdefault(source, {})[gram] = i, idf
    shared = spark.sparkContext.broadcast(of_country)
    kind = dict(records.dtypes)["entity_id"]
    kinds = dict(records.dtypes)["source"]

    def weigh(batches):
        for part, words, owner, gram, n in _counted(batches):
            country, source = (part.column(c)[0] for c in ("country", "source"))
            tf = 1 + np.log(n)
            for of, ids in shared.value.get(country.as_py(), {}).items():
                if source.as_py() in (1, of):
                    looked = [ids.get(w, (-1, 0.0)) for w in words]
                    gid, idf = np.array([x for x, _ in looked], dtype=np.int64), np.array([x for _, x in looked])
                    kept = np.flatnonzero(gid[gram] >= 0) if len(words) else np.zeros(0, dtype=np.int64)
                    own, entry, w = owner[kept], gid[gram[kept]], (tf * idf[gram])[kept] if len(words) else tf[kept]
                    by = np.lexsort((entry, own))
                    held = np.bincount(own, minlength=part.num_rows)
                    some = np.flatnonzero(held)
                    edges = pa.array(np.r_[0, np.cumsum(held[some])], pa.int32())
                    place = [pa.repeat(pa.scalar(of, part.schema.field("source").type), len(some)), pa.repeat(country, len(some))]
                    lists = [pa.ListArray.from_arrays(edges, pa.array(v[by])) for v in (entry, w)]
                    yield pa.RecordBatch.from_arrays([*place, part.column("id").take(pa.array(some)), *lists], [*PLACE, "id", "gids", "ws"])

    shape = f"source {kinds}, country string, id {kind}, gids array<long>, ws array<double>"
    vectors = lambda condition, label: materialise(rows.where(condition).mapInArrow(weigh, shape), label)
    return top_k(_sparse_top(vectors("source = 1", "tfidf-queries"), vectors("source > 1", "tfidf-targets"), k, block), k, rank)


def char_tfidf_whole(records: DataFrame, text: str, k: int = 100) -> DataFrame:
    """The best ``k`` targets of each query by cosine of TF-IDF over all ``char_grams`` of a column: no gram is dropped for its frequency.

    Records become packed blocks of up to ``_ROWS`` of a place, gram numbers and counts, which are about as large as the texts. Each two
    blocks of a country meet as one row of a product without an exchange, so disk does not grow with the number of pairs. There, grams of many
    records are columns of a matrix product, in double precision, the rest goes through inverted lists, and a block of queries keeps its
    best ``k`` while targets pass. The vocabulary is collected and broadcast.
    """
    spark = records.sparkSession
    rows = _texts(records, text)
    known = _vocabulary(rows, records, None, 0).toArrow()
    numbers: dict[str, dict[str, int]] = {}
    weights: dict[tuple[int, str], tuple[list[int], list[int], list[float]]] = {}
    for source, country, gram, df, idf in zip(*(known.column(c).to_pylist() for c in (*PLACE, "gram", "df", "idf"))):
        own = numbers.setdefault(country, {})
        for values, x in zip(weights.setdefault((source, country), ([], [], [])), (own.setdefault(gram, len(own)), df, idf)):
            values.append(x)
    sizes = {(r.source, r.country): r.n for r in targets_of(records).groupBy(*PLACE).agg(F.count("*").alias("n")).collect()}
    vocabulary, model = spark.sparkContext.broadcast(numbers), spark.sparkContext.broadcast((weights, sizes, {c: len(v) for c, v in numbers.items()}))
    kind, kinds = dict(records.dtypes)["entity_id"], dict(records.dtypes)["source"]

    def pack(batches):
        waiting: dict[tuple, list] = {}

        def packed(source, country, held):
            ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
            values = [np.concatenate([h[i] for h in held]).astype(np.uint32) for i in (1, 2, 3)]
            row = [pa.repeat(source, 1), pa.repeat(country, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
            return pa.RecordBatch.from_arrays([*row, *(pa.array([zlib.compress(v.tobytes(), 1)], pa.binary()) for v in values)], [*PLACE, "ids", "sizes", "gids", "counts"])

        for part, words, owner, gram, n in _counted(batches):
            country, source = part.column("country")[0], part.column("source")[0]
            ids = vocabulary.value.get(country.as_py())
            if ids is None:
                continue
            gid = np.array([ids.get(w, -1) for w in words], dtype=np.int64)
            entry = gid[gram] if len(words) else gram
            keep = np.flatnonzero(entry >= 0)
            own, entry, n = owner[keep], entry[keep], n[keep]
            by = np.lexsort((entry, own))
            held = waiting.setdefault((source.as_py(), country.as_py()), [])
            edges = np.r_[0, np.cumsum(np.bincount(own, minlength=part.num_rows))]
            for start in range(0, part.num_rows, _ROWS):
                stop = min(start + _ROWS, part.num_rows)
                if held and sum(len(h[0]) for h in held) + stop - start > _ROWS:
                    yield packed(source, country, held)
                    held.clear()
                mine = by[edges[start] : edges[stop]]
                held.append((part.column("id").slice(start, stop - start), np.diff(edges[start : stop + 1]), entry[mine], n[mine]))
        for (source, country), held in waiting.items():
            if held:
                yield packed(pa.scalar(source, pa.int32() if kinds == "int" else pa.int64()), pa.scalar(country), held)

    shape = f"source {kinds}, country string, ids array<{kind}>, sizes binary, gids binary, counts binary"
    blocks = materialise(rows.mapInArrow(pack, shape), "tfidf-blocks")
    q = blocks.where("source = 1").select("country", *[F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "gids", "counts")], F.monotonically_increasing_id().alias("block"))
    met = q.join(blocks.where("source > 1").hint("shuffle_replicate_nl"), "country")

    def entries(sizes, gids, counts):
        n, gid, c = (np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32).astype(np.int64) for x in (sizes, gids, counts))
        return np.repeat(np.arange(len(n)), n), gid, 1 + np.log(c), len(n)

    def unit(row, gid, tf, n, idf, seen):
        """Entries of grams of the place with weights of unit vectors."""
        kept = seen[gid]
        row, gid, w = row[kept], gid[kept], (tf * idf[gid])[kept]
        norm = np.sqrt(np.bincount(row, w * w, minlength=n))
        return row, gid, w / norm[row]

    def matrix(row, column, w, n, width):
        out = np.zeros((n, width))
        out[row, column] = w
        return out

    def search(batches):
        block = left = None
        found: dict[int, dict] = {}

        def compact(best):
            at, t, score = (np.concatenate(x) for x in zip(*best["rows"]))
            ids = pa.chunked_array(best["ids"]).combine_chunks()
            place = np.empty(len(ids), dtype=np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            by = np.lexsort((place[t], -score, at))
            at, t, score = at[by], t[by], score[by]
            nth = np.arange(len(at)) - np.searchsorted(at, at, "left")
            stays = nth < k
            best["rows"] = [(at[stays], t[stays], score[stays])]
            best["least"][at[nth == k - 1]] = score[nth == k - 1]
            return ids

        def flush():
            for source, best in found.items():
                if best["rows"]:
                    ids = compact(best)
                    at, t, score = best["rows"][0]
                    some, first = np.unique(at, return_index=True)
                    edges = pa.array(np.r_[first, len(at)], pa.int32())
                    lists = [pa.ListArray.from_arrays(edges, x) for x in (ids.take(pa.array(t)), pa.array(score))]
                    yield pa.RecordBatch.from_arrays([left[0].take(pa.array(some)), pa.array(np.full(len(some), source)).cast(pa.int32() if kinds == "int" else pa.int64()), *lists], ["s1_id", "source", "t_ids", "scores"])
            found.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i]  # noqa: B023, E731
                if value("block").as_py() != block:
                    yield from flush()
                    block = value("block").as_py()
                    left = value("q_ids").values, entries(value("q_sizes"), value("q_gids"), value("q_counts"))
                source, country = value("source").as_py(), value("country").as_py()
                grams, dfs, idfs = model.value[0][source, country]
                width = model.value[2][country]
                idf, df, seen = np.zeros(width), np.zeros(width), np.zeros(width, dtype=bool)
                idf[grams], df[grams], seen[grams] = idfs, dfs, True
                best = found.get(source)
                if best is None:
                    wide = np.flatnonzero(df >= _FREQUENT * model.value[1][source, country])
                    column = np.full(width, -1)
                    column[wide] = np.arange(len(wide))
                    row, gid, w = unit(*left[1], idf, seen)
                    dense = column[gid] >= 0
                    n = len(left[0])
                    best = found[source] = {"column": column, "width": len(wide), "ids": [], "n_ids": 0, "rows": [], "least": np.zeros(n)}
                    best["matrix"] = matrix(row[dense], column[gid[dense]], w[dense], n, len(wide))
                    best["rare"] = row[~dense], gid[~dense], w[~dense]
                own = entries(value("sizes"), value("gids"), value("counts"))
                row, gid, w = unit(*own, idf, seen)
                dense = best["column"][gid] >= 0
                n = own[3]
                dots = best["matrix"] @ matrix(row[dense], best["column"][gid[dense]], w[dense], n, best["width"]).T
                t_row, t_gid, t_w = row[~dense], gid[~dense], w[~dense]
                by = np.argsort(t_gid, kind="stable")
                t_row, t_gid, t_w = t_row[by], t_gid[by], t_w[by]
                q_row, q_gid, q_w = best["rare"]
                low, high = np.searchsorted(t_gid, q_gid, "left"), np.searchsorted(t_gid, q_gid, "right")
                work = np.cumsum(high - low)
                start = 0
                while start < len(q_gid):
                    # Whole rows of queries, so that no two parts add to one cell.
                    stop = max(int(np.searchsorted(work, (work[start - 1] if start else 0) + _CELLS, "right")), start + 1)
                    stop = int(np.searchsorted(q_row, q_row[stop - 1], "right"))
                    times = high[start:stop] - low[start:stop]
                    span = np.repeat(np.arange(start, stop), times)
                    at = low[span] + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)
                    first, last = int(q_row[start]), int(q_row[stop - 1]) + 1
                    dots[first:last] += np.bincount((q_row[span] - first) * n + t_row[at], q_w[span] * t_w[at], minlength=(last - first) * n).reshape(last - first, n)
                    start = stop
                apart = dots <= 0
                np.floor(np.add(np.multiply(dots, 1e6, out=dots), 0.5, out=dots), out=dots)
                dots[apart] = -1
                least = best["least"]
                if n > k:
                    least = np.maximum(least, np.partition(dots, n - k, axis=1)[:, n - k])
                q_at, t_at = np.nonzero(dots >= least[:, None])
                best["rows"].append((q_at, t_at + best["n_ids"], dots[q_at, t_at]))
                best["ids"].append(value("ids").values)
                best["n_ids"] += n
                compact(best)
        yield from flush()

    kept = met.mapInArrow(search, f"s1_id {kind}, source {kinds}, t_ids array<{kind}>, scores array<double>")
    pair = F.arrays_zip((F.transform("scores", lambda x: -x)).alias("score"), F.col("t_ids").alias("t_id"))
    merged = kept.select("s1_id", "source", pair.alias("found")).groupBy("s1_id", "source").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    listed = merged.select("s1_id", "source", F.posexplode("found").alias("place", "one"))
    return listed.select("s1_id", F.col("one.t_id").alias("t_id"), "source", (-F.col("one.score") / 1e6).alias("score"), (F.col("place") + 1).alias("rank"))


def name_char_tfidf(records: DataFrame, **options) -> DataFrame:
    return char_tfidf_route(records, "name", **options)


def address_char_tfidf(records: DataFrame, **options) -> DataFrame:
    return char_tfidf_route(records, "address", **options)


def name_word_tfidf(records: DataFrame, max_df: float = 0.1, **options) -> DataFrame:
    return tfidf_route(records, word_grams(F.col("name")), max_df=max_df, **options)


ROUTES = {
    "exact_name": exact_name,
    "suffix_exact": suffix_exact,
    "rare_name": rare_names,
    "name_char": name_char_tfidf,
    "name_word": name_word_tfidf,
    "address_char": address_char_tfidf,
}


def _united(records: DataFrame, routes: dict | None) -> DataFrame:
    """All candidates with their route's name and bit, not cut yet: ``k`` is the cut of their route, null where it is done."""
    out = None
    for bit, (name, route) in enumerate((routes or ROUTES).items()):
        rows = route(records, rank=False) if route in ROUTES.values() else route(records)
        if "k" not in rows.columns:
            rows = rows.select("s1_id", "t_id", "source", "score", F.lit(None).cast("int").alias("k"))
        rows = rows.withColumns({"route": F.lit(name), "bit": F.lit(1 << bit).cast("long")})
        out = rows if out is None else out.unionByName(rows)
    return out


def all_routes(records: DataFrame, routes: dict | None = None) -> DataFrame:
    """Union of the routes' candidates with the route's name and bit, dealt by ``s1_id``.

    Routes of this module, and others that return ``k`` in place of ``rank``, are ranked and cut behind the union, so that all
    candidates are moved once, to the place where they are fused (see ``lists.fuse``).
    """
    out = _united(records, routes)
    by = Window.partitionBy("s1_id", "route", "source").orderBy(F.col("score").desc_nulls_last(), "t_id")
    ranked = out.repartition("s1_id").withColumn("rank", F.row_number().over(by)).where(F.col("k").isNull() | (F.col("rank") <= F.col("k")))
    return ranked.select("s1_id", "t_id", "source", "score", "rank", "route", "bit")


def fused_routes(records: DataFrame, routes: dict | None = None, constant: int = 60, evidence: bool = False, keep: int | None = None) -> DataFrame:
    """``lists.fuse`` (with ``evidence``: ``lists.route_evidence``) of ``all_routes``, in numpy; with ``keep`` the first of each list only.

    Candidates are dealt and sorted by ``s1_id`` alone, once; whole lists of about ``_LISTED`` rows are then cut, placed, summed and
    ranked together, so that the four orders that fusion needs are orders of numbers and no row passes through the JVM between them.
    """
    names = list(routes or ROUTES)
    out = _united(records, routes).select("s1_id", "t_id", "source", F.col("score").cast("double").alias("score"), "k", "bit")
    kind = dict(out.dtypes)["s1_id"], dict(out.dtypes)["t_id"]

    def fuse(rows: pa.Table) -> pa.RecordBatch:
        def numbered(name):
            """Numbers in the order of the values, and the values."""
            coded = rows.column(name).combine_chunks().dictionary_encode()
            by = pc.sort_indices(coded.dictionary)
            place = np.empty(len(by), dtype=np.int64)
            place[by.to_numpy()] = np.arange(len(by))
            return place[coded.indices.to_numpy()], coded.dictionary.take(by)

        (s, lists), (t, targets) = numbered("s1_id"), numbered("t_id")
        source = numbered("source")[0]
        worst = -rows.column("score").to_numpy()
        route = np.log2(rows.column("bit").to_numpy()).astype(np.int64)
        cut = pc.fill_null(rows.column("k"), -1).to_numpy()

        def place(key, at):
            """Order by key, score and target, and places from 1 within the key."""
            by = at[np.lexsort((t[at], worst[at], key[at]))]
            edge = np.flatnonzero(np.r_[True, key[by[1:]] != key[by[:-1]]])
            return by, np.arange(len(by)) - np.repeat(edge, np.diff(np.r_[edge, len(by)])) + 1

        own = s * len(names) + route
        by, rank = place(own * (int(source.max()) + 1) + source, np.arange(len(s)))
        stays = (cut[by] < 0) | (rank <= cut[by])
        by, rank = by[stays], rank[stays]
        ranks = np.zeros(len(s), dtype=np.int32)
        ranks[by] = rank
        by, position = place(own, by)
        pair = s[by] * len(targets) + t[by]
        order = np.argsort(pair, kind="stable")
        by, position, pair = by[order], position[order], pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pair)]))
        bits = np.bitwise_or.reduceat(1 << route[by], first)
        rrf = np.floor(np.add.reduceat(1.0 / (constant + position), first) * 1e9 + 0.5) / 1e9
        gs, gt = s[by][first], t[by][first]
        final = np.lexsort((gt, -rrf, gs))
        start = np.searchsorted(gs[final], gs[final], "left")
        place_at = np.arange(len(final)) - start
        if keep is not None:
            final, place_at = final[place_at < keep], place_at[place_at < keep]
        columns = [lists.take(pa.array(gs[final])), targets.take(pa.array(gt[final])), pa.array(bits[final]), pa.array(np.bitwise_count(bits[final]).astype(np.int64)), pa.array(rrf[final]), pa.array(place_at.astype(np.int32))]
        if evidence:
            least, best = [], []
            for i in range(len(names)):
                mine = np.flatnonzero(route[by] == i)
                high, low = np.full(len(first), -np.inf), np.full(len(first), np.iinfo(np.int32).max, dtype=np.int32)
                some, scored = np.zeros(len(first), dtype=bool), np.zeros(len(first), dtype=bool)
                some[group[mine]] = True
                known = mine[~np.isnan(worst[by[mine]])]
                scored[group[known]] = True
                np.maximum.at(high, group[known], -worst[by[known]])
                np.minimum.at(low, group[mine], ranks[by[mine]])
                best.append(pa.array(high[final], mask=~scored[final]))
                least.append(pa.array(low[final], mask=~some[final]))
            columns += [*best, *least, pa.array(np.bincount(gs, minlength=len(lists))[gs[final]])]
        return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            n, ids = batch.num_rows, batch.column("s1_id")
            if not n:
                continue
            if sum(b.num_rows for b in held) >= _LISTED:
                # All rows of the last list go on: it ends where another id begins.
                last = held[-1].column("s1_id")[-1]
                begins = pc.index(pc.not_equal(ids, last), True).as_py()
                if begins >= 0:
                    yield fuse(pa.Table.from_batches([*held, batch.slice(0, begins)]))
                    held, batch = [], batch.slice(begins)
            held.append(batch)
        if held:
            yield fuse(pa.Table.from_batches(held))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lists(batches):
            yield batch.rename_columns(columns)

    shape = [f"s1_id {kind[0]}", f"t_id {kind[1]}", "route_bits long", "n_routes long", "rrf double", "rrf_rank int"]
    if evidence:
        shape += [*[f"score_{n} double" for n in names], *[f"rank_{n} int" for n in names], "cand_count long"]
    columns = [c.split(" ")[0] for c in shape]
    fused = out.repartition("s1_id").sortWithinPartitions("s1_id").mapInArrow(named, ", ".join(shape))
    return fused.select(*columns[:5], *columns[6:-1], "rrf_rank", "cand_count") if evidence else fused


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _dense_blocks(queries: DataFrame, targets: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their own block and one row for each block of the other side of their place."""
    blocks = lambda df, name: df.groupBy("place").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = blocks(targets, "t_blocks").join(blocks(queries, "q_blocks"), "place").withColumnRenamed("place", "in_place")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    t = targets.join(sizes, F.col("place") == F.col("in_place")).select("t_id", F.col("place").alias("t_place"), own("t_id", "t_blocks").alias("t_block"), F.col("vector").alias("t_vector"), every("q_blocks").alias("t_with"))
    q = queries.join(sizes, F.col("place") == F.col("in_place")).select("s1_id", "place", "vector", own("s1_id", "q_blocks").alias("block"), every("t_blocks").alias("with"))
    return q, t


def dense_neighbours(queries: DataFrame, targets: DataFrame, k: int = 50, block: int = 4096) -> DataFrame:
    """Exact top-k by cosine within a place: (s1_id, t_id, dense_score, dense_rank from 0).

    ``queries``: s1_id, place, vector; ``targets``: t_id, place, vector. Both sides of a place are cut into blocks of about
    ``block`` rows by a digest of their id; each two blocks meet in one task, as one matrix product, and the blocks' top k are then
    ranked together. So a task holds two blocks, whatever the size of its place. A place without targets gives no rows.
    """
    q, t = _dense_blocks(queries, targets, block)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"s1_id": pd.Series(dtype=left["s1_id"].dtype), "t_id": pd.Series(dtype=right["t_id"].dtype), "dense_score": pd.Series(dtype="float64")})
        if left.empty or right.empty:
            return empty
        b = _unit(np.stack(right["t_vector"].to_numpy()).astype(np.float64))
        ids = right["t_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        b, ids = b[order], ids[order]
        parts = []
        for start in range(0, len(left), 1024):
            a = _unit(np.stack(left["vector"].iloc[start : start + 1024].to_numpy()).astype(np.float64))
            scores = np.round(a @ b.T, 6)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(a)), best.shape[1])
            parts.append(pd.DataFrame({"s1_id": left["s1_id"].to_numpy()[start + rows], "t_id": ids[best.ravel()], "dense_score": scores[rows, best.ravel()]}))
        return pd.concat(parts) if parts else empty

    kinds = dict(queries.dtypes)["s1_id"], dict(targets.dtypes)["t_id"]
    found = q.groupBy("place", "block", "with").cogroup(t.groupBy("t_place", "t_with", "t_block")).applyInPandas(search, f"s1_id {kinds[0]}, t_id {kinds[1]}, dense_score double")
    by = Window.partitionBy("s1_id").orderBy(F.col("dense_score").desc(), "t_id")
    return found.withColumn("dense_rank", F.row_number().over(by) - 1).where(F.col("dense_rank") < k)


def dense_link_counts(queries: DataFrame, targets: DataFrame, least: float, block: int = 4096) -> DataFrame:
    """(place, links): how many pairs of a query and a target have a cosine of at least ``least``, for places that have any.

    Pairs are counted where two blocks meet and never become rows.
    """
    q, t = _dense_blocks(queries, targets, block)
    place = dict(queries.dtypes)["place"]

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = 0
        if len(left) and len(right):
            b = _unit(np.stack(right["t_vector"].to_numpy()).astype(np.float64)).T
            for start in range(0, len(left), 1024):
                a = _unit(np.stack(left["vector"].iloc[start : start + 1024].to_numpy()).astype(np.float64))
                n += int((~(np.round(a @ b, 6) < least)).sum())  # NaN counts as large, as in Spark
        return pd.DataFrame({"place": left["place"].iloc[:1], "n": [n] * min(1, len(left))})

    counts = q.groupBy("place", "block", "with").cogroup(t.groupBy("t_place", "t_with", "t_block")).applyInPandas(count, f"place {place}, n long")
    return counts.groupBy("place").agg(F.sum("n").alias("links")).where(F.col("links") > 0)


def new_dense_pairs(dense: DataFrame, listed: DataFrame, keep: int = 20) -> DataFrame:
    """Dense rows below rank ``keep`` that the list lacks."""
    return dense.where(F.col("dense_rank") < keep).join(listed.select("s1_id", "t_id"), ["s1_id", "t_id"], "left_anti")


def augment(listed: DataFrame, new: DataFrame, dense: DataFrame, base: int = 40, score: float = -20.0, missing_rank: float = 999.0) -> DataFrame:
    """The list with the new pairs behind it (rank ``base`` + dense rank) and everyone's dense score and rank."""
    fresh = new.select("s1_id", "t_id", F.lit(score).alias("filter_score"), (F.col("dense_rank") + base).cast("int").alias("filter_rank"))
    both = listed.select("s1_id", "t_id", "filter_score", F.col("filter_rank").cast("int").alias("filter_rank")).unionByName(fresh)
    joined = both.join(dense.select("s1_id", "t_id", "dense_score", "dense_rank"), ["s1_id", "t_id"], "left")
    return joined.withColumn("dense_rank", F.coalesce(F.col("dense_rank").cast("double"), F.lit(missing_rank)))
