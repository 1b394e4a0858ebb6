"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts are lower-cased words (letters or digits; marks belong to letters, decimal points and commas to numbers). Words
become typed placeholders where a question's parameters sit: ``<num>`` for numbers, ``<unit>`` for units of measure
and ``<name>`` for words written with a capital inside a sentence or listed as given names; the replaced words are kept
beside the template as slots. Every window of ``width`` template words of the benchmark is hashed; document windows meet
them by an equi-join on the hash. A re-parameterised question ("Tom has 3 apples" → "Ann has 7 apples") has the same
windows, and its names and units must be consistent: the same value of the item always maps to one and the same value
of the document. Numbers may change freely (two of them may become equal, and equal ones different), as long as at least
half of the matched words are ordinary ones; tables of numbers must map one to one.

Windows of one alignment (document position minus item position) are judged together; where they are not consistent, only
windows copied word for word count. A window without any ordinary word (a table of numbers) always has to be copied word for
word. Alignments of an item are then united, the one with most windows first, each further one only if no name or unit of the
item would map to two values; the windows copied word for word in all alignments are the other set that can count. An item
is found in a document where one of these sets holds at least ``share`` of its windows, so a word put in or left out does not
hide it, or where in one consistent alignment at least ``share`` of its words stand in their places, so a few replaced words
do not hide it either. Items shorter than a window form one window of their whole length; items under ``least_words`` words
occur in any text by chance and are found only where they are a document's whole text, word for word.

Scale: the corpus is read and cut into words once, for windows of all lengths; only windows whose hash is in the benchmark leave
the scan stage. The benchmark's windows are broadcast while there are at most ``broadcast_windows`` of them (counted first), and
joined by shuffle beyond that. Windows with the same hash in one item keep all their places; a common window cannot pile up, as
partial sums per (document, item, alignment) are taken on both sides of the exchange.

Defined cases: null and empty texts match nothing; null ids are kept as ids; items without words match nothing; rows
repeated in full give one result row per distinct (doc_id, item_id); empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, shielded, spread

# Units of measure and given names that count as slots.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars euro euros cent cents degree degrees mph kmh watt watts volt volts"
).split()
NAMES = (
    "alice bob carol dave tom ann anna mary john james maria jose pierre marie hans peter paul lucas emma olivia noah liam sophia mia "
    "ben sam sara sarah david daniel laura lisa max leo julia thomas michael robert linda susan karen jane jack kate"
).split()

_TOKEN = r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}_]+"


def _template(word: F.Column, inside: bool) -> F.Column:
    """The template word of a word as written; ``inside``: it does not start a sentence."""
    low = F.lower(word)
    first = F.ascii(word)
    named = low.isin(*NAMES)
    if inside:
        initial = F.substring(word, 1, 1)
        named = named | ((initial != F.lower(initial)) & (F.length(word) > 1))
    return (
        F.when(first.between(97, 122), F.when(word.isin(*UNITS), F.lit("<unit>")).when(word.isin(*NAMES), F.lit("<name>")).otherwise(low))
        .when(word.rlike(r"^\p{N}"), F.lit("<num>"))
        .when(low.isin(*UNITS), F.lit("<unit>"))
        .when(named, F.lit("<name>"))
        .otherwise(low)
    )


def _marked(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words`` (as written, with a leading dot where a sentence starts) by one pass of the text."""
    spaced = F.regexp_replace(F.concat(F.lit(". "), F.coalesce(F.col(text), F.lit(""))), r"[.!?:;\n]+[^\p{L}\p{N}]*", " \u0001")
    return df.withColumn("words", F.regexp_extract_all(spaced, F.lit("\u0001?(?:" + _TOKEN + ")"), F.lit(0)))


def _template_word(marked: F.Column) -> F.Column:
    return F.when(marked.startswith("\u0001"), _template(F.substring(marked, 2, 1 << 30), False)).otherwise(_template(marked, True))


def _with_template(df: DataFrame) -> DataFrame:
    """Adds ``template`` beside ``words``: the digest of each template word, so that windows hash numbers and not strings."""
    return df.withColumn("template", F.transform("words", lambda w: F.xxhash64(_template_word(w))))


def _plain(words: F.Column) -> F.Column:
    return F.transform(words, lambda w: F.lower(F.ltrim(w, F.lit("\u0001"))))


def _windows(template: F.Column, width: int) -> F.Column:
    """Hash of every window of ``width`` hashed words (of the whole where it is shorter), by start."""
    n = F.size(template)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(F.slice(template, i + 1, width)))
    )


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_uid, template, slots) of every item; item_uid is a digest of id and text, a slot is "" for an ordinary word."""
    items = _with_template(_marked(benchmark.select("item_id", "text"), "text"))
    typed = F.transform("words", _template_word)
    slots = F.zip_with(typed, _plain(F.col("words")), lambda t, w: F.when(t.startswith("<"), w).otherwise(F.lit("")))
    return items.select("item_id", F.xxhash64("item_id", "text").alias("item_uid"), "template", slots.alias("slots"))


def _single(pairs: F.Column, side: str) -> F.Column:
    """Whether each value of a side of distinct pairs occurs once."""
    return F.size(F.array_distinct(F.transform(pairs, lambda x: x[side]))) == F.size(pairs)


def _consistent(pairs: F.Column, numbers_free: F.Column) -> F.Column:
    """Whether distinct slot pairs (a of the item, b of the document) can be one item with other parameters."""
    numbers = F.filter(pairs, lambda x: x["a"].rlike(r"^\p{N}"))
    others = F.filter(pairs, lambda x: ~x["a"].rlike(r"^\p{N}"))
    return _single(others, "a") & (numbers_free | (_single(numbers, "a") & _single(numbers, "b")))


def benchmark_windows(benchmark: DataFrame, width: int, least_words: int = 4) -> DataFrame:
    """(item_id, item_uid, item_at, hash, item_slots, n_windows, n_words, item_width, bare) of every window of the benchmark; bare: without an ordinary word."""
    items = benchmark_items(benchmark).withColumn("n_words", F.size("template")).withColumn("hashes", _windows(F.col("template"), width)).withColumn("n_windows", F.size("hashes"))
    rows = items.select("item_id", "item_uid", "slots", "n_windows", "n_words", F.least(F.size("template"), F.lit(width)).alias("item_width"), F.posexplode("hashes").alias("item_at", "hash"))
    rows = rows.where(F.col("item_width") >= least_words).withColumn("item_slots", F.slice("slots", F.col("item_at") + 1, width))
    return rows.select("item_id", "item_uid", "item_at", "hash", "n_windows", "n_words", "item_width", "item_slots", (~F.array_contains("item_slots", "")).alias("bare")).distinct()


def _short_items(benchmark: DataFrame, least_words: int) -> DataFrame:
    """(item_id, known_words) of the items under ``least_words`` words, as lower-cased words."""
    items = _marked(benchmark.select("item_id", "text"), "text")
    return items.where(F.size("words").between(1, least_words - 1)).select("item_id", F.array_join(_plain(F.col("words")), " ").alias("known_words")).distinct()


def _found(docs: DataFrame, benchmark: DataFrame, width: int, share: float, broadcast_windows: int, least_words: int = 4) -> DataFrame:
    """(doc_id, uid, item_id, n_matched, n_windows, pairs) of every item found; uid is a digest of the text."""
    known = benchmark_windows(benchmark, width, least_words)
    sizes = known.agg(F.count("*").alias("n"), F.collect_set("item_width").alias("widths")).first()
    widths = sorted(sizes["widths"]) or [width]
    short = _short_items(benchmark, least_words)
    small = sizes["n"] + short.count() <= broadcast_windows
    hint = F.broadcast if small else (lambda x: x)
    marked = _marked(docs.select("doc_id", "text"), "text").select("doc_id", F.xxhash64("text").alias("uid"), "words")
    rows = _with_template(marked)

    def windows(w: int) -> F.Column:
        starts = F.sequence(F.lit(0), F.size("template") - w)
        each = F.transform(starts, lambda i: F.struct(i.alias("doc_at"), F.lit(w).alias("doc_width"), F.xxhash64(F.slice("template", i + 1, w)).alias("doc_hash")))
        return F.when(F.size("template") >= w, each).otherwise(F.array().cast("array<struct<doc_at:int,doc_width:int,doc_hash:bigint>>"))

    at = rows.select("doc_id", "uid", "words", F.inline(windows(widths[0]) if len(widths) == 1 else F.concat(*[windows(w) for w in widths])))
    same_window = (F.col("doc_hash") == F.col("hash")) & (F.col("doc_width") == F.col("item_width"))
    doc_slots = _plain(F.slice("words", F.col("doc_at") + 1, F.col("doc_width")))
    hits = at.join(hint(known), same_window & (~F.col("bare") | (doc_slots == F.col("item_slots"))))
    start = F.greatest(F.col("doc_at") - F.col("item_at"), F.lit(0))
    beside = F.slice("words", start + 1, F.col("doc_at") - F.col("item_at") + F.col("n_words") - start)
    hits = hits.withColumns({"doc_slots": doc_slots, "beside": beside, "shift": F.col("doc_at") - F.col("item_at")})
    hits = hits.withColumn("pairs", F.filter(F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != ""))
    copied = ~F.exists("pairs", lambda x: x["a"] != x["b"])
    lined = hits.groupBy("doc_id", "uid", "item_id", "item_uid", "shift").agg(
        F.collect_set("item_at").alias("places"),
        F.collect_set(F.when(copied, F.col("item_at"))).alias("copied"),
        F.max("n_windows").alias("n_windows"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.first("beside").alias("beside"),
    )
    # The whole item beside the document's words at the same alignment, also outside the windows that met.
    items = benchmark_items(benchmark).select(F.col("item_uid").alias("known_uid"), "template", "slots").dropDuplicates(["known_uid"])
    lined = lined.join(hint(items), F.col("item_uid") == F.col("known_uid"))
    before = F.greatest(-F.col("shift"), F.lit(0))
    own = F.arrays_zip(F.slice("template", before + 1, 1 << 30).alias("t"), F.slice("slots", before + 1, 1 << 30).alias("a"))
    theirs = F.arrays_zip(F.transform("beside", lambda w: F.xxhash64(_template_word(w))).alias("u"), _plain(F.col("beside")).alias("b"))
    same = F.filter(F.zip_with(own, theirs, lambda x, y: F.struct(x["t"].alias("t"), x["a"].alias("a"), y["u"].alias("u"), y["b"].alias("b"))), lambda x: x["t"] == x["u"])
    lined = lined.withColumn("same", F.transform(same, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    lined = lined.withColumn("all_pairs", F.array_distinct(F.filter("same", lambda x: x["a"] != "")))
    free = 2 * F.size(F.filter("same", lambda x: x["a"] == "")) >= F.size("same")
    lined = lined.withColumn("ok", _consistent(F.col("pairs"), free)).withColumn("all_ok", _consistent(F.col("all_pairs"), free))
    judged = lined.select(
        "doc_id",
        "uid",
        "item_id",
        "item_uid",
        "shift",
        "n_windows",
        "copied",
        F.when(F.col("ok"), F.col("places")).otherwise(F.col("copied")).alias("places"),
        F.when(F.col("ok"), F.col("pairs")).otherwise(F.filter("pairs", lambda x: x["a"] == x["b"])).alias("pairs"),
        (F.col("ok") & F.col("all_ok") & (F.size("same") >= F.col("n_words") * share)).alias("in_place"),
    )
    alignment = F.struct((-F.size("places")).alias("fewer"), "shift", "places", "pairs")
    joined = judged.where(F.size("places") > 0).groupBy("doc_id", "uid", "item_id", "item_uid").agg(
        F.array_sort(F.collect_list(alignment)).alias("alignments"),
        F.size(F.array_distinct(F.flatten(F.collect_set("copied")))).alias("n_copied"),
        F.max("n_windows").alias("n_windows"),
        F.max("in_place").alias("in_place"),
    )
    none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<struct<a:string,b:string>>").alias("pairs"))
    joined = joined.withColumn("united", F.aggregate("alignments", none, _unite))
    joined = joined.withColumn("n_united", F.size("united.places"))
    windowed = joined.select(
        "doc_id",
        "uid",
        "item_id",
        F.greatest("n_united", "n_copied").alias("n_matched"),
        "n_windows",
        F.when(F.col("n_united") >= F.col("n_copied"), F.col("united.pairs")).otherwise(F.filter("united.pairs", lambda x: x["a"] == x["b"])).alias("pairs"),
        "in_place",
    )
    windowed = windowed.where((F.col("n_matched") >= F.col("n_windows") * share) | F.col("in_place")).drop("in_place")
    whole = marked.where(F.size("words").between(1, least_words - 1)).withColumn("doc_words", F.array_join(_plain(F.col("words")), " "))
    whole = whole.join(hint(short), F.col("doc_words") == F.col("known_words"))
    whole = whole.select("doc_id", "uid", "item_id", F.lit(1).alias("n_matched"), F.lit(1).alias("n_windows"), F.array().cast("array<struct<a:string,b:string>>").alias("pairs"))
    return windowed.unionByName(whole)


def _unite(so_far: F.Column, alignment: F.Column) -> F.Column:
    """The set of alignments with one more, unless a name or unit of the item would then map to two values."""
    both = F.array_distinct(F.concat(so_far["pairs"], alignment["pairs"]))
    fits = _single(F.filter(both, lambda x: ~x["a"].rlike(r"^\p{N}")), "a")
    places = F.array_union(so_far["places"], alignment["places"])
    return F.when(fits, F.struct(places.alias("places"), both.alias("pairs"))).otherwise(F.struct(so_far["places"].alias("places"), so_far["pairs"].alias("pairs")))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 6, share: float = 0.5, broadcast_windows: int = 200_000) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots, changed) of every item found in a document."""
    changed = F.exists("pairs", lambda x: x["a"] != x["b"])
    best = F.max(F.struct("n_matched", (-F.size("pairs")).alias("fewer"), "n_windows", changed.alias("changed"))).alias("best")
    return _found(docs, benchmark, width, share, broadcast_windows).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        F.col("best.n_matched").cast("long").alias("n_matched"),
        F.col("best.n_windows").cast("long").alias("n_windows"),
        (-F.col("best.fewer")).cast("long").alias("n_slots"),
        F.col("best.changed").alias("changed"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 6, share: float = 0.5, broadcast_windows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns."""
    docs, back = shielded(docs, ("__bad_id", "__bad_uid"))
    bad = _found(docs, benchmark, width, share, broadcast_windows).select(F.col("doc_id").alias("__bad_id"), F.col("uid").alias("__bad_uid")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__bad_id")) & (F.xxhash64("text") == F.col("__bad_uid")), "left_anti").withColumnsRenamed(back)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """All (document, benchmark item) pairs where the document contains the item, as it is or with other parameters."""
    return contaminated(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), read_table(spark, sf_dir, "benchmark"))
